"""Quality rules and perplexity bands of a modified Kneser-Ney model.

The model is over characters: grams of ``ORDER`` symbols are counted by Spark over the
distinct texts of a language that pass the rules, and discounts, continuation counts and
back-off weights are made of the counts with joins and sums. Texts are dealt into two
folds by their hash, each fold has a model, and a text is scored by that of the other: no
text and none of its copies teaches the model that judges it.

Tasks look grams up in arrays sorted by hash. Models stand in shards of at most
``MOST_ENTRIES`` grams, and a text is scored by the shard that holds its model. A model
larger than a shard is split by the last symbol of the context, a symbol whose grams are
still more by the last two, and so on; a shard also has the entries of the shorter ends
of its contexts. All that one context needs stands in one shard, so the sums are the same.
Spark deals the entries out to their shards, sorts them and writes a file for each to the
shared folder; tasks read the file of the shard that they score by, one at a time, and no
entry goes through the driver.

A document is rejected if its mean log-perplexity lies outside the band of its language;
the bands come from the median and the quartiles of the distinct texts that pass the
rules, which junk that makes up a tenth of a language hardly moves.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import cut, join_groups, remove_folder, shared_folder, slices, texts
from lamina.llm.exact_dedup import filter_bits, repeat_filter, tested
from lamina.llm.warc import Store

ORDER, BITS = 5, 12
CLASSES = 1 << BITS
#: Bound of a shard, of which a task holds one: 16 bytes a gram, so 40 MB.
MOST_ENTRIES = 2_500_000
#: Grams of the highest level in a partition; the tables of the model are dealt by it, not by the partitions of the texts.
PART_GRAMS = 100_000
#: Discounts and places, a row a language, are broadcast up to here and shuffled beyond.
MOST_LANGUAGES = 4096
#: The like for the ends of contexts by which split models are dealt out, some 40 bytes each.
MOST_ROUTES = 250_000
#: How far a band reaches from the median, in distances of the quartiles from it; 2.7 sigma for normal values.
REACH = 4.0
#: Distinct texts that pass the rules, from which a language has a band.
LEAST_TEXTS = 20
#: Code points from here on are two symbols: the first says which 2048 code points, and is no symbol of any other.
WIDE = 3072
SPACE = re.compile(r"\s+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 8


def classes(text: str) -> np.ndarray:
    """The 12-bit symbols of a text, lower-cased, white space as one space; 0 stands before a text.

    Code points below ``WIDE`` are a symbol, all others two, so no two texts share symbols.
    """
    points = np.frombuffer(SPACE.sub(" ", text.lower()).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    wide = points >= WIDE
    if not wide.any():
        return np.maximum(points, 1)
    ends = np.cumsum(1 + wide)
    out = np.empty(ends[-1], np.int64)
    out[ends - 1] = np.where(wide, (points & 2047) + 1, np.maximum(points, 1))
    out[ends[wide] - 2] = WIDE + (points[wide] >> 11)
    return out


def grams(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each symbol of each text, and the number of symbols of each."""
    parts = [classes(t) for t in batch]
    sizes = np.array([len(p) for p in parts], np.int64)
    gap = np.zeros(ORDER - 1, np.int64)
    flat = np.concatenate([x for p in parts for x in (gap, p)]) if parts else gap
    key = np.zeros(len(flat), np.int64)
    for back in range(ORDER - 1, 0, -1):
        key[back:] |= flat[: len(flat) - back] << (BITS * back)
    key |= flat
    inside = np.ones(len(flat), bool)
    starts = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    for k in range(ORDER - 1):
        inside[starts + k] = False
    return key[inside], sizes


def count_grams(docs: DataFrame, lang: str, text: str, counts: Callable[[str], bool] = lambda text: True) -> DataFrame:
    """(lang, gram, n) over all texts that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            languages = np.array(part.column("lang").to_pylist(), object)
            batch = np.array(texts(part, "text"), object)
            for language in dict.fromkeys(languages):
                keys, _ = grams([t for t in batch[languages == language] if counts(t)])
                found, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(found), pa.string()), pa.array(found), pa.array(n.astype(np.int64))],
                    names=["lang", "gram", "n"],
                )

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, level, gram, logp, logb): log-probability of each gram's last character, back-off of it as a context.

    ``level`` is the number of characters. Interpolated modified Kneser-Ney: the highest
    level uses counts, the others numbers of different characters in front. A context has
    at most ``CLASSES`` grams, so windows over contexts are small.
    """
    counts = cut(counts)
    parts = -(-counts.count() // PART_GRAMS) or 1
    few = counts.select("lang").distinct().count() <= MOST_LANGUAGES
    levels = {ORDER: counts.coalesce(parts)}
    for level in range(ORDER - 1, 0, -1):
        short = F.col("gram").bitwiseAND(F.lit((1 << (BITS * level)) - 1))
        levels[level] = cut(levels[level + 1].groupBy("lang", short.alias("gram")).agg(F.count("*").alias("n")).coalesce(parts))
    tables, lower = [], None
    for level in range(1, ORDER + 1):
        shape = levels[level].groupBy("lang").agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

        def discount(k: int, y=y):
            usual = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
            return F.when((usual > 0) & (usual < k), usual).otherwise(F.lit(0.5 * k)).alias(f"d{k}")

        shape = shape.select("lang", discount(1), discount(2), discount(3))
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = Window.partitionBy("lang", "context")
        own = (
            levels[level].join(F.broadcast(shape) if few else shape, "lang")
            .select("lang", "gram", F.shiftright("gram", BITS).alias("context"), "n", taken.alias("taken"))
            .withColumn("all", F.sum("n").over(context)).withColumn("back", F.sum("taken").over(context) / F.col("all"))
            .withColumn("own", (F.col("n") - F.col("taken")) / F.col("all"))
            .withColumn("leads", F.col("gram") == F.min("gram").over(context))
        )
        if lower is None:
            made = own.withColumn("p", F.col("own") + F.col("back") / CLASSES)
        else:
            short = F.col("gram").bitwiseAND(F.lit((1 << (BITS * (level - 1))) - 1))
            made = own.withColumn("short", short).join(
                lower.select("lang", F.col("gram").alias("short"), F.col("p").alias("q")), ["lang", "short"]
            ).withColumn("p", F.col("own") + F.col("back") * F.col("q"))
        lower = cut(made.select("lang", "gram", "p", F.when(F.col("leads"), F.col("back")).alias("back")).coalesce(parts))
        none = F.lit(None).cast("double")
        tables.append(lower.select("lang", F.lit(level).alias("level"), "gram", F.log("p").alias("logp"), none.alias("logb")))
        # Contexts of this level are grams of the one below, kept under their own number.
        tables.append(
            lower.where("back is not null").select(
                "lang", F.lit(level - 1).alias("level"), F.shiftright("gram", BITS).alias("gram"), none.alias("logp"), F.log("back").alias("logb")
            )
        )
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy("lang", "level", "gram").agg(F.max("logp").alias("logp"), F.max("logb").alias("logb")).coalesce(parts)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashed(language: int, level: int, gram: np.ndarray) -> np.ndarray:
    salt = (language * 16 + level + 1) * 0xD1B54A32D192ED03 % (1 << 64)
    x = (gram.astype(np.uint64) + np.uint64(salt)) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class Arrays:
    """A shard of the model: hashes in order, and what belongs to each."""

    def __init__(self, languages: list[str], entries: pa.Table):
        self.number = {x: i for i, x in enumerate(languages)}
        self.key = entries.column("key").to_numpy()
        self.logp, self.logb = (entries.column(name).to_numpy() for name in ("logp", "logb"))

    def _at(self, language: int, level: int, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = hashed(language, level, gram).view(np.int64)
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return at, self.key[at] == wanted

    def log_probability(self, language: str, gram: np.ndarray) -> np.ndarray:
        """Of the last character of each gram after the others."""
        out = np.zeros(len(gram))
        if language not in self.number or not len(self.key):
            return out - np.log(CLASSES)
        lang, open_ = self.number[language], np.arange(len(gram))
        for level in range(ORDER, 0, -1):
            short = gram[open_] & ((1 << (BITS * level)) - 1)
            at, there = self._at(lang, level, short)
            there &= ~np.isnan(self.logp[at])
            out[open_[there]] += self.logp[at[there]]
            open_, short = open_[~there], short[~there]
            if not len(open_):
                return out
            at, there = self._at(lang, level - 1, short >> BITS)
            there &= ~np.isnan(self.logb[at])
            out[open_[there]] += self.logb[at[there]]
        out[open_] -= np.log(CLASSES)
        return out


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a run of ``WINDOW`` words which occurs twice."""
    if len(words) < WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    if len(number) == len(words):
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(np.array(ids, np.int32), WINDOW)
    # A window whose words are all unique in the text can't occur twice.
    common = (np.bincount(ids) > 1)[windows].all(1)
    spots = np.flatnonzero(common)
    if len(spots) < 2:
        return 0
    _, back, n = np.unique(
        np.ascontiguousarray(windows[spots]).view(f"V{4 * WINDOW}").ravel(), return_inverse=True, return_counts=True
    )
    covered = np.zeros(len(words) + 1, np.int64)
    twice = spots[n[back] > 1]
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + WINDOW, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    points = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(words), points, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words)


@dataclass
class Shard:
    """Languages whose models stand in it; of a language that is split, the contexts that it settles.

    These end in the ``depth`` - 1 symbols of ``parent``, and with one symbol more they are
    one of ``routes``, or, where ``seen`` is given, none of ``seen``.
    """

    languages: list[str]
    depth: int = 0
    parent: int = 0
    routes: list[int] = field(default_factory=list)
    seen: list[int] | None = None

    def owns(self, context: np.ndarray) -> np.ndarray:
        if not self.depth:
            return np.ones(len(context), bool)
        end = context & _ones(self.depth)
        mine = np.isin(end, np.array(self.routes, np.int64))
        if self.seen is not None:
            mine |= ~np.isin(end, np.array(self.seen, np.int64))
        return mine & (context & _ones(self.depth - 1) == self.parent)


def _ones(symbols: int) -> int:
    return (1 << (BITS * symbols)) - 1


def _end(symbols: int) -> Column:
    return F.col("context").bitwiseAND(F.lit(_ones(symbols)))


def _by_context(model: DataFrame) -> DataFrame:
    """Each entry as a gram under its context and as a context under itself, with the ``symbols`` of that."""
    none = F.lit(None).cast("double")
    as_gram = model.where("logp is not null").select(
        "lang", "level", "gram", "logp", none.alias("logb"), F.shiftright("gram", BITS).alias("context"), (F.col("level") - 1).alias("symbols")
    )
    as_context = model.where("logb is not null").select(
        "lang", "level", "gram", none.alias("logp"), "logb", F.col("gram").alias("context"), F.col("level").alias("symbols")
    )
    return as_gram.unionByName(as_context)


def _split(entries: DataFrame, language: str, depth: int = 1, parent: int = 0) -> list[Shard]:
    """Shards of the contexts that end in the symbols of ``parent``, by the symbol before these."""
    inside = entries.where((F.col("symbols") >= depth) & (_end(depth - 1) == parent))
    routes = inside.groupBy(_end(depth).alias("route")).count().collect()  # at most 4096 rows
    shards, heavy, room = [Shard([language], depth, parent)], [], MOST_ENTRIES
    for r in sorted(routes, key=lambda r: (-r["count"], r["route"])):
        if r["count"] > MOST_ENTRIES and depth < ORDER - 1:
            heavy.append(r["route"])
            continue
        if r["count"] > room:
            shards.append(Shard([language], depth, parent))
            room = MOST_ENTRIES
        shards[-1].routes.append(r["route"])
        room -= r["count"]
    # Contexts that the model doesn't have are settled by their shorter ends, in the first shard.
    shards[0].seen = [r["route"] for r in routes]
    for route in heavy:
        shards += _split(entries, language, depth + 1, route)
    return shards


def _shards(model: DataFrame) -> list[Shard]:
    """Shards of all languages; one that is too large stands in several."""
    sizes = {r["lang"]: r["count"] for r in model.groupBy("lang").count().collect()}
    out: list[Shard] = []
    room = 0
    for lang in sorted((x for x in sizes if sizes[x] <= MOST_ENTRIES), key=lambda x: (-sizes[x], x)):
        if sizes[lang] > room:
            out.append(Shard([]))
            room = MOST_ENTRIES
        out[-1].languages.append(lang)
        room -= sizes[lang]
    for lang in sorted(x for x in sizes if sizes[x] > MOST_ENTRIES):
        out += _split(_by_context(model.where(F.col("lang") == lang)), lang)
    return out


def _dealt(model: DataFrame, shards: list[Shard]) -> DataFrame:
    """(shard, number, level, gram, logp, logb): the entries of each shard; ``number`` is the place of the language in it."""
    spark = model.sparkSession
    whole = [(x, i, n) for i, s in enumerate(shards) if not s.depth for n, x in enumerate(s.languages)]
    places = spark.createDataFrame(whole, "lang string, shard int, number int")
    out = model.join(F.broadcast(places) if len(whole) <= MOST_LANGUAGES else places, "lang").select("shard", "number", "level", "gram", "logp", "logb")
    # A shard of a split language wants what its routes end in, and the shorter ends of its contexts: at most 4097 for each of these.
    wants = [
        (s.languages[0], i, *w)
        for i, s in enumerate(shards)
        if s.depth
        for w in [*[(True, s.depth, r) for r in s.routes], *[(False, n, s.parent & _ones(n)) for n in range(s.depth)]]
    ]
    if not wants:
        return out
    wanted = spark.createDataFrame(wants, "lang string, shard int, at_end boolean, symbols int, context long")
    as_end = [
        F.when(F.col("symbols") >= d, F.struct(F.lit(True).alias("at_end"), F.lit(d).alias("symbols"), _end(d).alias("context")))
        for d in range(1, ORDER)
    ]
    as_whole = F.struct(F.lit(False).alias("at_end"), F.col("symbols").alias("symbols"), F.col("context").alias("context"))
    entries = _by_context(model.where(F.col("lang").isin(sorted({w[0] for w in wants}))))
    met = entries.select("lang", "level", "gram", "logp", "logb", F.explode(F.array_compact(F.array(*as_end, as_whole))).alias("w"))
    met = met.select("lang", "level", "gram", "logp", "logb", "w.*").join(
        F.broadcast(wanted) if len(wants) <= MOST_ROUTES else wanted, ["lang", "at_end", "symbols", "context"]
    )
    # An entry that stands in a shard both as a gram and as a context is one.
    both = met.groupBy("shard", "level", "gram").agg(F.max("logp").alias("logp"), F.max("logb").alias("logb"))
    return out.unionByName(both.withColumn("number", F.lit(0)))


def write_shards(model: DataFrame, shards: list[Shard], folder: str) -> None:
    """A file for each shard, ``shard=i`` under ``folder``, with its entries hashed and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, level, gram = (batch.column(c).to_numpy() for c in ("number", "level", "gram"))
            key = np.empty(len(gram), np.uint64)
            for i, n in set(zip(number.tolist(), level.tolist(), strict=True)):
                rows = (number == i) & (level == n)
                key[rows] = hashed(i, n, gram[rows])
            # A task reads missing values as NaN, so they are written as such.
            logs = [pa.array(batch.column(c).to_numpy(zero_copy_only=False).astype(np.float32)) for c in ("logp", "logb")]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(key.view(np.int64)), *logs], names=["shard", "key", "logp", "logb"])

    rows = _dealt(model, shards).mapInArrow(run, "shard int, key long, logp float, logb float")
    rows.repartition("shard").sortWithinPartitions("shard", "key").write.partitionBy("shard").parquet(folder)


@lru_cache(maxsize=1)
def _held(folder: str, shard: int, languages: tuple[str, ...]) -> Arrays:
    """The arrays of a shard; a worker holds those it read last."""
    fs, where = Store(folder).open()
    return Arrays(list(languages), pq.read_table(posixpath.join(where, f"shard={shard}"), columns=["key", "logp", "logb"], filesystem=fs, partitioning=None))


def score(docs: DataFrame, shards: list[Shard], folder: str, carry: list[str], lang: str, text: str) -> DataFrame:
    """``carry``, the base counts, and the sum of log-probabilities and characters of each text.

    ``folder`` has the shards as :func:`write_shards` writes them, and is read whenever the result is.
    Texts whose language has no model get the same probability for each symbol.
    """
    kinds = [docs.schema[c].dataType.simpleString() for c in carry]
    head = ", ".join(f"__k{i} {k}" for i, k in enumerate(kinds))
    base = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    names = [f"__k{i}" for i in range(len(carry))] + ["__row"] + [x.split()[0] for x in base.split(", ")] + ["total", "chars"]
    rows = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(carry)], F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumn("__row", F.xxhash64(*[f"__k{i}" for i in range(len(carry))], "lang", "text"))

    def scored(rows: DataFrame, number: int | None, shard: Shard, with_base: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                arrays = None if number is None else _held(folder, number, tuple(shard.languages))
                batch = texts(part, "text")
                languages_ = np.array(part.column("lang").to_pylist(), object)
                total, n = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
                for language in dict.fromkeys(languages_):
                    rows_ = np.flatnonzero(languages_ == language)
                    keys, sizes = grams([batch[i] for i in rows_])
                    if arrays is None or language not in arrays.number:
                        logp = np.full(len(keys), -np.log(CLASSES))
                    else:
                        found, back = np.unique(keys, return_inverse=True)
                        of_found = arrays.log_probability(language, found)
                        of_found[~shard.owns(found >> BITS)] = 0
                        logp = of_found[back]
                    sums = np.r_[0, np.cumsum(logp)]
                    # The first symbols of wide characters are none of their own.
                    points = np.r_[0, np.cumsum((keys & (CLASSES - 1)) < WIDE)]
                    ends = np.cumsum(sizes)
                    total[rows_], n[rows_] = sums[ends] - sums[ends - sizes], points[ends] - points[ends - sizes]
                counts = zip(*map(base_counts, batch), strict=True) if with_base else [[0] * len(batch)] * 5
                columns = [part.column(x) for x in names[: len(carry) + 1]]
                columns += [pa.array(c, pa.int64()) for c in counts] + [pa.array(total), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return rows.mapInArrow(run, f"{head}, __row long, {base}, total double, chars long")

    known = sorted({x for s in shards for x in s.languages})
    unknown = ~F.col("lang").isin(known) if known else F.lit(True)
    parts, split = [], {}
    for i, shard in enumerate(shards):
        mine = F.col("lang").isin(shard.languages)
        if shard.depth:
            some = split.setdefault(shard.languages[0], [])
            some.append(scored(rows.where(mine), i, shard, not some))
        else:
            # Texts without a model go with those of the first shard, which spares a scan.
            parts.append(scored(rows.where(mine if parts else mine | unknown), i, shard, True))
    if not parts:
        parts.append(scored(rows.where(unknown), None, Shard([]), True))
    for some in split.values():
        met = some[0]
        for got in some[1:]:
            met = met.unionByName(got)
        # Rows that are alike in everything have alike sums, so each counts the copies once for all shards.
        keys = [*names[: len(carry) + 1], "chars"]
        met = met.groupBy(*keys).agg(
            F.sum("total").alias("total"), *[F.max(x).alias(x) for x in names[len(carry) + 1 : -2]], F.count("*").alias("__copies")
        )
        met = met.withColumn("__copies", (F.col("__copies") / len(some)).cast("int")).withColumn(
            "total", F.col("total") / F.col("__copies")
        ).withColumn("__each", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
        parts.append(met.select(*names))
    out = parts[0]
    for got in parts[1:]:
        out = out.unionByName(got)
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(carry)], *names[len(carry) + 1 :])


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(lang, text), each once. Only texts whose hash may occur twice are shuffled; the others pass straight through."""
    rows = docs.select("lang", "text", F.xxhash64("lang", "text").alias("__of"))
    hashes = cut(rows.select("__of"))
    bits = filter_bits(hashes.count())
    found = tested(rows, cut(repeat_filter(hashes, "__of", bits)), bits, "__of")
    return found.where("not __maybe").select("lang", "text").unionByName(found.where("__maybe").select("lang", "text").distinct())


def judge_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_repeated: int = 30, least_words: int = 20
) -> DataFrame:
    """One row per row of ``docs``: the id, the base counts, log_perplexity, the band, base_failed, kept.

    Words are runs outside ASCII white space. A null text has no words and fails the
    rules, as every text of fewer than ``least_words`` words does. A null language is a
    language of its own. Languages with fewer than ``LEAST_TEXTS`` distinct texts that pass
    the rules have no band, and nothing more to reject. Null and repeated ids are judged as
    any others; an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    docs = docs.withColumn("of", F.xxhash64("text"))
    fold = F.pmod("of", F.lit(2))

    def counts(text: str) -> bool:
        words = text.encode().split()
        return len(words) >= least_words and repeated_words(words) * 100 <= len(words) * most_repeated

    taught = distinct_texts(docs.select(F.concat(fold.cast("string"), "lang").alias("lang"), "text"))
    model = cut(kneser_ney(count_grams(taught, "lang", "text", counts)))
    shards, folder = _shards(model), posixpath.join(shared_folder(docs.sparkSession), f"grams-{uuid.uuid4().hex}")
    write_shards(model, shards, folder)
    judged_by = docs.withColumn("by", F.concat((1 - fold).cast("string"), "lang"))
    scored = score(judged_by, shards, folder, ["id", "lang", "of"], "by", "text")
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)
    rows = cut(
        scored.withColumn("base_failed", failed).withColumn("log_perplexity", F.when(F.col("chars") > 0, -F.col("total") / F.col("chars")))
    )
    remove_folder(docs.sparkSession, folder)
    distinct = rows.where(~F.col("base_failed")).groupBy("lang", "of").agg(F.min("log_perplexity").alias("log_perplexity"))
    quartiles = distinct.groupBy("lang").agg(
        F.count("*").alias("texts"), F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10_000).alias("q")
    ).where(F.col("texts") >= LEAST_TEXTS)
    low = F.col("q")[1] - REACH * (F.col("q")[1] - F.col("q")[0])
    high = F.col("q")[1] + REACH * (F.col("q")[2] - F.col("q")[1])
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    bands = cut(sizes.join(quartiles, "lang", "left").select("lang", "n", low.alias("low"), high.alias("high")))
    judged = join_groups(rows.drop("of"), bands, ["lang"], "n", rows.count())
    outside = F.coalesce((F.col("log_perplexity") < F.col("low")) | (F.col("log_perplexity") > F.col("high")), F.lit(False))
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "log_perplexity", F.col("low").alias("band_low"), F.col("high").alias("band_high"), "base_failed",
        (~F.col("base_failed") & ~outside).alias("kept"),
    )
