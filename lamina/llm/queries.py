"""The queries of the training-data operators, and SQL that says the same where SQL can."""

from __future__ import annotations

import posixpath
import uuid
import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import bpe, exact_dedup, licenses, near_dedup, packing, perplexity, prefix_trie, quality_cnn, simhash, substring_dedup, tandem_runs, toxicity, warc
from lamina.llm.common import cut, shared_folder, table


def vocabulary(name: str) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def _fold(of: int):
    """crc32 of the id as text, modulo ``of``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of, F.lit(0))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = posixpath.join(shared_folder(spark), f"warc-{uuid.uuid4().hex}")
    index = warc.write_bundles(warc.plan_records(table(spark, sf_dir, "pages")), folder)
    return warc.read_bundles(folder, index).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    pieces = packing.tokenise(docs, vocabulary("word_bpe_49k.json"))
    placed = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(cut(placed)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op4_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = quality_cnn.learn(docs, labels.where(_fold(5) != 0))
    return quality_cnn.score_quality(docs, net).select(
        "doc_id", (_fold(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.learn(docs, labels.where(_fold(3) != 1))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (_fold(3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.mark_near_duplicates(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_exact_duplicates(table(spark, sf_dir, "documents"))


def op10_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge_quality(table(spark, sf_dir, "documents"))


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document of which every tenth, by crc32 of its id, ends in a repetition; rows without an id don't."""
    g, kind = divmod(zlib.crc32(str(doc_id).encode()), 10)
    n = len(words)
    if doc_id is None or kind or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def op11_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its runs, and what is left of it without their repeats, as digests; the strongest run in full."""
    marked = tandem_runs.mark_runs(table(spark, sf_dir, "documents"), rewrite=repeat_tail)
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    best = F.col("strongest")
    return marked.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.start.alias("start"), best.length.alias("length"), best.period.alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its fingerprint and the smallest doc_id that links of at most three bits reach."""
    return simhash.mark_similar(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node of the trie of all ``conversations``, rebuilt as their contract says; rows without a conv_id are in none."""
    turns = prefix_trie.conversations_of(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.share_first_turns(cut(turns))).drop("digest")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_warc, op2_license_scan, op3_packing, op4_quality_cnn, op5_toxicity, op6_near_dedup,
            op7_substring_dedup, op8_bpe, op9_exact_dedup, op10_perplexity, op11_tandem_runs, op12_simhash, op13_prefix_trie,
        )
    }


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    """The canonical form of a licence text, written out for DuckDB."""
    form = f"lower({text})"
    for one, other in (
        ("licence", "license"), ("organisation", "organization"), ("authorise", "authorize"), ("merchantibility", "merchantability"),
        ("non-infringement", "noninfringement"), ("noncommercial", "non-commercial"), ("per cent", "percent"), ("https://", "http://"), ("©", "(c)"),
    ):
        form = f"replace({form}, {_quote(one)}, {_quote(other)})"
    lines = f"list_filter(string_split({form}, chr(10)), lambda x: NOT ("
    lines += " OR ".join(
        f"regexp_full_match(x, {_quote(p)})"
        for p in (
            r"[ \t#*/;%-]*copyright\b.*([12]\d{3}|\(c\)).*", r"[ \t#*/;%-]*\(c\) ?[12]\d{3}.*", r"[ \t#*/;%-]*all rights reserved[. ]*",
        )
    )
    form = f"array_to_string({lines})), chr(10))"
    return f"trim(regexp_replace({form}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    known = ", ".join(f"({_quote(k)}, {_quote(t)})" for k, t in sorted(licenses.KNOWN.items()))
    digests = ", ".join(f"({_quote(k)}, {_quote(d)})" for k, d in sorted(licenses.DIGESTS.items()))
    return {
        "op1_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
            m AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
                         max(page_id) OVER (PARTITION BY h) AS first FROM p)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
            FROM m""",
        "op2_license_scan": f"""
            WITH known(license, text) AS (VALUES {known}),
            whole(license, digest) AS (VALUES {digests}),
            k AS (SELECT digest, min(license) AS license
                  FROM (SELECT license, sha256({_canonical("text")}) AS digest FROM known UNION ALL SELECT license, digest FROM whole) GROUP BY 1),
            d AS (SELECT doc_id, sha256({_canonical("coalesce(text, '')")}) AS digest FROM documents)
            SELECT doc_id, d.digest AS canonical_sha256, license FROM d LEFT JOIN k ON d.digest = k.digest""",
        "op9_exact_dedup": f"""
            WITH d AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256 FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, text_sha256
            FROM d WINDOW w AS (PARTITION BY text_sha256)""",
        "op6_near_dedup": """
            WITH RECURSIVE t AS (
                SELECT doc_id, list_filter(regexp_split_to_array(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
            s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
                  FROM t),
            n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
            e AS (SELECT doc_id, unnest(g) AS g FROM s),
            p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
            l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 75 * (x.n + y.n - i)),
            u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
            r AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT u.b, r.c FROM r JOIN u ON r.v = u.a),
            c AS (SELECT v, min(c) AS component_id FROM r GROUP BY 1)
            SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON doc_id = v""",
        "op13_prefix_trie": """
            WITH o AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
            t AS (SELECT c, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || x)) AS w FROM o GROUP BY c),
            h AS (SELECT c, w, xor(list_reduce(flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: list_concat([ascii(s)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]))),
                      lambda k, e: CASE WHEN e >= 0 THEN xor(k, e) ELSE xor(k >> 1, (k & 1) * 3988292384) END, 4294967295), 4294967295) % 9 AS h FROM t),
            b AS (SELECT h.c, list_concat(coalesce(g.w[1:h.h], []), h.w[h.h + 1:]) AS w FROM h LEFT JOIN t g ON g.c = h.c - h.c % 5),
            p AS (SELECT c, len(w) AS n, d, w[1:d] AS k, w[d].x AS last, w[1:d - 1] AS up FROM b, unnest(range(0, len(w) + 1)) AS u(d)),
            n AS (SELECT d, k, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(coalesce(strlen(last), 0)) AS bytes,
                         max(n) = d AS leaf, sha256(coalesce(string_agg(CASE WHEN n = d THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
                  FROM p GROUP BY d, k),
            s AS (SELECT a.d, a.k, sum(b.leaf::BIGINT)::BIGINT AS n_leaves, sum((b.n_convs - 1) * b.bytes)::BIGINT AS saved_tokens,
                         count(*) FILTER (b.d = a.d + 1) AS n_children FROM n a JOIN n b ON b.d >= a.d AND b.k[1:a.d] = a.k GROUP BY 1, 2)
            SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
            FROM n JOIN s ON n.d = s.d AND n.k = s.k LEFT JOIN n q ON q.d = n.d - 1 AND q.k = n.up AND n.d > 0""",
    }
