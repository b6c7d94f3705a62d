"""Metadata of an annotation: a map from names to variants.

A name that is missing and a name whose value is null are told apart by :func:`has`. Null
metadata counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIND = "map<string,variant>"


def _whole(metadata: Column) -> Column:
    return F.coalesce(metadata, F.create_map().cast(KIND))


def parse(json: Column) -> Column:
    """Metadata of a JSON object; what is no object gives none."""
    return _whole(F.try_variant_get(F.try_parse_json(json), "$", KIND))


def to_json(metadata: Column) -> Column:
    """A JSON object, names in order."""
    return F.to_json(F.to_variant_object(_whole(metadata)))


def has(metadata: Column, name: str) -> Column:
    return F.map_contains_key(_whole(metadata), name)


def get(metadata: Column, name: str, kind: str, default: Column | None = None) -> Column:
    """The value as ``kind``, null if it isn't one; ``default`` only where the name is missing."""
    value = F.try_variant_get(F.try_element_at(_whole(metadata), F.lit(name)), "$", kind)
    return F.when(has(metadata, name), value).otherwise(default if default is not None else F.lit(None))


def require(metadata: Column, name: str, kind: str) -> Column:
    """As :func:`get`, but a missing name ends the query."""
    return get(metadata, name, kind, F.raise_error(F.lit(f"{name} not found in metadata")).cast(kind))


def without(metadata: Column, name: str) -> Column:
    return F.map_filter(_whole(metadata), lambda k, _: k != name)


def put(metadata: Column, name: str, value: Column) -> Column:
    """``metadata`` with the value, which must be of a plain type, in place of any it had."""
    if not name.isidentifier():
        raise ValueError(f"`{name}` is not a valid name in metadata")
    return F.map_concat(without(metadata, name), F.create_map(F.lit(name), value.cast("variant")))


def names(metadata: Column) -> Column:
    return F.map_keys(_whole(metadata))


def values(metadata: Column) -> Column:
    return F.map_values(_whole(metadata))


def items(metadata: Column) -> Column:
    return F.map_entries(_whole(metadata))


def size(metadata: Column) -> Column:
    return F.cardinality(_whole(metadata))


def equal(a: Column, b: Column) -> Column:
    """Whether both have the same names with the same values, in any order."""
    return to_json(a) == to_json(b)
