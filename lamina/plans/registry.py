"""The registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Cases of a few given rows and what they give: checked by the tests, but no queries, since they read no table.
FIXTURES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def fixture(sql: str):
    """Keeps a function of (spark, sf_dir) whose rows are given in it, with SQL for what they give."""

    def add(f):
        FIXTURES[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Layers as common table expressions, for the oracles.
LAYERS = r"""
    parts AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) AS n
              FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(\S+|\s+)', 1) AS p FROM documents)),
    placed AS (SELECT *, (sum(length(text)) OVER (PARTITION BY doc_id ORDER BY n) - length(text))::BIGINT AS s FROM parts),
    tokens AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS pos, s AS "start", s + length(text) AS "end", text
               FROM placed WHERE NOT regexp_matches(text, '^\s')),
    lines AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS pos
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
    rows_ AS (SELECT doc_id, pos::BIGINT AS pos, (sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(text) - 1)::BIGINT AS "start",
                     (sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1)::BIGINT AS "end", text, (pos // 40)::BIGINT AS page FROM lines),
    pages_ AS (SELECT doc_id, page AS pos, min("start") AS "start", max("end") AS "end", count(*) AS n_rows FROM rows_ GROUP BY 1, 2),
    sent_parts AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) AS n
              FROM (SELECT doc_id, regexp_extract_all(replace(replace(replace(coalesce(text, ''),'. ', '.' || chr(1) || ' '), '! ', '!' || chr(1) || ' '), '? ', '?' || chr(1) || ' '), '[^\x01]+') AS p
                    FROM (SELECT doc_id, replace(replace(replace(text, '.' || chr(10), '.' || chr(1) || chr(10)), '!' || chr(10), '!' || chr(1) || chr(10)), '?' || chr(10), '?' || chr(1) || chr(10)) AS text FROM documents))),
    sent_placed AS (SELECT *, (sum(length(text)) OVER (PARTITION BY doc_id ORDER BY n) - length(text))::BIGINT AS s,
                    length(text) - length(regexp_replace(text, '^\s+', '')) AS lead, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS bare FROM sent_parts),
    sentences AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS pos, s + lead AS "start", s + lead + length(bare) AS "end", bare AS text
                  FROM sent_placed WHERE bare <> ''),
    boxed AS (SELECT t.doc_id, t.pos, t."start", t."end", t.text, r.pos AS row_pos, r.page, (t."start" - r."start") / 100 AS l,
                     (r.pos % 40) / 40 AS t, (t."end" - t."start") / 100 AS w, 1 / 40 AS h
              FROM tokens t JOIN rows_ r ON t.doc_id = r.doc_id AND t."start" < r."end" AND t."end" > r."start"),
    blocks AS (SELECT doc_id, pos // 5 AS pos, page, 0.0::DOUBLE AS l, min(pos % 40) / 40 AS t, max(length(text)) / 100 AS w, count(*) / 40 AS h
               FROM rows_ GROUP BY doc_id, pos // 5, page)
"""


def with_layers(body: str) -> str:
    return "WITH " + LAYERS + body
