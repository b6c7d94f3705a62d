"""Words from tokens: dictionary and classifier routes, and text of spans through words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import text as tx
from lamina.operators import inrow, segments

#: Punctuation that is a word by itself; a hyphen belongs to the word that it stands in.
PUNCTUATION_WORDS = tx.DOCUMENT_PUNCTUATION.replace("-", "")


def clusters_of(tokens: DataFrame) -> DataFrame:
    """One row per white-space cluster of tokens (doc_id, pos, start, end, text, cluster, row)."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "text", "start", "end")))
    out = tokens.groupBy("doc_id", "cluster").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("row").alias("first_row"),
        F.max("row").alias("last_row"), listed.alias("tokens"), F.min("start").alias("start"), F.max("end").alias("end"),
    )
    raw = F.array_join("tokens.text", "")
    solid = F.filter(F.transform("tokens", lambda t, i: F.struct(i.alias("i"), tx.is_punctuation(t["text"]).alias("p"))), lambda x: ~x["p"])
    n_left = F.coalesce(F.try_element_at(solid, F.lit(1))["i"], F.size("tokens"))
    n_right = F.size("tokens") - 1 - F.coalesce(F.try_element_at(solid, F.lit(-1))["i"], F.lit(-1))
    return out.select(
        "*", raw.alias("text"), F.when(F.size("tokens") > 1, n_left).otherwise(0).alias("n_left"),
        F.when(F.size("tokens") > 1, n_right).otherwise(0).alias("n_right"), (F.size(solid) == 0).alias("all_punct"),
    )


def dictionary_words(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Words of documents: doc_id, pos, start, end, text.

    ``dictionary`` has a column ``word``. The clusters of a document that no row break
    splits count as words of its own dictionary. A cluster stays whole if the dictionary
    knows it, and else loses the punctuation at its right end. A cluster that a row break
    splits at a hyphen is joined with the next: as it is, without the hyphen, or, as a
    last resort, with it; each is tried with and without right punctuation. Punctuation
    at the left end of a word always comes apart, unless there is nothing else.
    """
    clusters = clusters_of(tokens)
    w = Window.partitionBy("doc_id").orderBy("first")
    opens = (F.lead("first_row").over(w) != F.col("last_row")) & F.col("text").endswith("-") & (F.col("text") != "-")
    marked = clusters.withColumn("opens", F.coalesce(opens, F.lit(False)))
    marked = marked.withColumn("closes", F.coalesce(F.lag("opens").over(w), F.lit(False)))
    own = marked.where("not opens and not closes").select("doc_id", tx.strip_punctuation(F.col("text"), "").alias("word")).distinct()
    shared = dictionary.select(F.lower(F.trim("word")).alias("word"), F.lit(True).alias("shared")).distinct()

    tail = lambda c, n: F.array_join(F.transform(F.slice(c, 1, F.greatest(F.size(c) - n, F.lit(0))), lambda t: t["text"]), "")
    nxt = {c: F.lead(c).over(w) for c in ("tokens", "text", "n_right", "end", "last")}
    joined = marked.withColumns({f"next_{c}": v for c, v in nxt.items()})
    bare_next = tail(F.col("next_tokens"), F.col("next_n_right"))
    stem = F.regexp_replace("text", "-$", "")
    heads = joined.where("not closes").withColumns({
        "t1": F.when(F.col("opens"), F.concat("text", "next_text")).otherwise(F.col("text")),
        "t2": F.when(F.col("opens"), F.concat(stem, "next_text")),
        "t3": F.when(F.col("opens"), F.concat(stem, bare_next)),
        "t4": F.when(F.col("opens"), F.concat("text", bare_next)).otherwise(tail(F.col("tokens"), F.col("n_right"))),
    })
    for t in ("t1", "t2", "t3"):
        key = F.lower(F.trim(t))
        heads = heads.withColumn("__k", key)
        mine = own.select("doc_id", F.col("word").alias("__k"), F.lit(True).alias(f"own_{t}"))
        known = shared.select(F.col("word").alias("__k"), F.col("shared").alias(f"shared_{t}"))
        heads = heads.join(mine, ["doc_id", "__k"], "left").join(known, "__k", "left").drop("__k")
    knows = lambda t: F.coalesce(F.col(f"own_{t}"), F.col(f"shared_{t}"), F.lit(False))
    whole = F.when(knows("t1"), 1).when(F.col("opens") & knows("t2"), 2).when(F.col("opens") & knows("t3"), 3).otherwise(4)
    picked = heads.withColumn("way", whole)
    all_tokens = F.when(F.col("opens"), F.concat("tokens", "next_tokens")).otherwise(F.col("tokens"))
    off_right = F.when(F.col("way") >= 3, F.when(F.col("opens"), F.col("next_n_right")).otherwise(F.col("n_right"))).otherwise(0)
    off_left = F.when(F.col("all_punct") & ~F.col("opens"), 0).otherwise(F.col("n_left"))
    text = F.when(F.col("way") == 1, F.col("t1")).when(F.col("way") == 2, F.col("t2")).when(F.col("way") == 3, F.col("t3")).otherwise(F.col("t4"))
    core = picked.select("doc_id", all_tokens.alias("all"), off_left.alias("a"), off_right.alias("b"), text.alias("word"))
    n = F.size("all")
    lead = F.array_join(F.transform(F.slice("all", 1, F.col("a")), lambda t: t["text"]), "")
    body_word = F.substring(F.col("word"), F.length(lead) + 1, F.length("word"))
    alone = lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["text"].alias("text"))
    left = F.transform(F.slice("all", 1, F.col("a")), alone)
    right = F.transform(F.slice("all", n - F.col("b") + 1, F.col("b")), alone)
    inner = F.slice("all", F.col("a") + 1, F.greatest(n - F.col("a") - F.col("b"), F.lit(0)))
    whole_word = F.struct(F.try_element_at(inner, F.lit(1))["start"].alias("start"), F.try_element_at(inner, F.lit(-1))["end"].alias("end"), body_word.alias("text"))
    body = F.when(F.size(inner) > 0, F.array(whole_word))
    placed = core.select("doc_id", F.inline(F.concat(left, F.coalesce(body, F.array().cast("array<struct<start:bigint,end:bigint,text:string>>")), right)))
    return segments.renumber(placed, ["doc_id"], ["start"]).select("doc_id", "pos", "start", "end", "text")


def dictionary_words_of_texts(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """:func:`dictionary_words` of documents (doc_id, text), each id once, in the rows of the documents.

    A cluster that is not joined is in the dictionary of its own document, so the shared one is asked only for those that a row break splits.
    """
    shared = dictionary.select(F.lower(F.trim("word")).alias("word"), F.lit(True).alias("shared")).distinct()
    tried = inrow.open_clusters(docs, tx.DOCUMENT_PUNCTUATION).join(shared, "word", "left")
    known = F.min(F.when(F.col("own") | F.col("shared"), F.col("way")))
    picked = tried.groupBy("doc_id", "nth").agg(F.coalesce(known, F.lit(4)).alias("way"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("nth", "way"))), lambda x: x["way"])
    ways = picked.groupBy(F.col("doc_id").alias("__id")).agg(listed.alias("ways"))
    met = docs.join(ways, F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("doc_id", "text", F.coalesce("ways", F.array().cast("array<int>")).alias("ways"))
    return inrow.cluster_words(met, tx.DOCUMENT_PUNCTUATION)


def hyphen_words(words: DataFrame, score: Callable[[Column, Column], Column], threshold: float = -1.5) -> DataFrame:
    """Joins a word that ends in a hyphen with the next: with the hyphen if ``score(prefix, suffix)`` exceeds the threshold."""
    return scored_pairs(paired_words(words), score, threshold)


def paired_words(words: DataFrame) -> DataFrame:
    """Words (doc_id, pos, start, end, text), and in ``next`` the word behind one that ends in a hyphen; that one has no row, and its end is the pair's."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    opens = F.col("text").endswith("-") & (F.col("text") != "-") & F.lead("text").over(w).isNotNull()
    marked = words.withColumns({"opens": opens, "next": F.lead("text").over(w), "next_end": F.lead("end").over(w)})
    marked = marked.withColumn("closed", F.coalesce(F.lag("opens").over(w), F.lit(False)))
    return marked.where("not closed").select(
        "doc_id", "pos", "start", F.when(F.col("opens"), F.col("next_end")).otherwise(F.col("end")).alias("end"),
        "text", F.when(F.col("opens"), F.col("next")).alias("next"),
    )


def scored_pairs(paired: DataFrame, score: Callable[[Column, Column], Column], threshold: float = -1.5) -> DataFrame:
    """doc_id, pos, start, end, text of what :func:`paired_words` gives; :func:`inrow.hyphened_tokens` gives the same of texts."""
    stem = tx.without_trailing_hyphens(F.col("text"))
    kept = F.when(score(stem, F.col("next")) > threshold, F.concat("text", "next")).otherwise(F.concat(stem, F.col("next")))
    return paired.select("doc_id", "pos", "start", "end", F.when(F.col("next").isNotNull(), kept).otherwise(F.col("text")).alias("text"))


def hyphen_features(words: DataFrame, shares: DataFrame, default: float) -> DataFrame:
    """A row for each hyphen of each distinct word (word): hyphen, from 1, and the features that a classifier of it takes.

    ``shares`` (word, prob) has how common words are; ``default`` is for those it lacks. A
    word that starts or ends with a hyphen is an error; one without hyphens has no rows.
    """
    edge = F.when(F.col("word").startswith("-") | F.col("word").endswith("-"), F.raise_error(F.lit("words must not start or end with hyphens")))
    parts = F.split("word", "-")
    rows = words.select("word", F.posexplode(F.when(edge.isNull(), parts)).alias("hyphen", "__part")).where("hyphen > 0")
    rows = rows.select("word", "hyphen", F.array_join(F.slice(parts, 1, F.col("hyphen")), "-").alias("pre"),
                       F.array_join(F.slice(parts, F.col("hyphen") + 1, F.size(parts)), "-").alias("suf"))
    share = lambda name, key: shares.select(F.col("word").alias(key), F.col("prob").alias(name))
    rows = rows.join(share("__whole", "word"), "word", "left")
    rows = rows.withColumn("__both", F.concat("pre", "suf")).join(share("__joined", "__both"), "__both", "left")
    flag = lambda c, pattern: F.when(c.rlike(pattern), 1).otherwise(0)
    pre, suf = F.col("pre"), F.col("suf")
    behind = lambda c, n: F.when(F.length(c) > n, F.substring(c, n, 2)).otherwise("") if n > 1 else F.left(c, F.lit(2))
    before = lambda n: F.when(F.length(pre) > n, F.reverse(F.left(F.right(pre, F.lit(n + 1)), F.lit(2)))).otherwise("")
    dense = {}
    for name, c in (("p", pre), ("s", suf)):
        dense |= {
            f"{name}_upper": flag(c, r"^\p{Lu}"), f"{name}_number": flag(c, r"^\p{N}+$"), f"{name}_isalpha": flag(c, r"^\p{L}+$"), f"{name}_len": F.length(c),
        }
    dense["uni_prob"] = F.coalesce("__whole", F.lit(default)) - F.coalesce("__joined", F.lit(default))
    dense["multi_hyphen"] = F.when(F.size(parts) > 2, 1).otherwise(0)
    sparse = {"shape": F.regexp_replace("word", r"(?U)\w", "x"), "s_lower": F.lower(suf)} | {f"s_bg{n}": behind(suf, n) for n in (1, 2, 3)}
    sparse |= {"p_lower": F.lower(pre)} | {f"p_bg{n}": before(n) for n in (1, 2, 3)}
    return rows.select("word", F.col("hyphen").cast("bigint").alias("hyphen"), *[v.alias(k) for k, v in (sparse | dense).items()])


def hyphen_edits(scored: DataFrame, threshold: float = -1.5) -> DataFrame:
    """Words (word, hyphen, score) with the hyphens that score above the threshold: original, new, is_edit."""
    kept = F.map_from_entries(F.collect_list(F.struct("hyphen", (F.col("score") > threshold).alias("kept"))))
    made = scored.groupBy("word").agg(kept.alias("kept"))
    piece = lambda part, i: F.concat(F.when(F.col("kept")[i.cast("bigint")], "-").otherwise(""), part)
    new = F.array_join(F.transform(F.split("word", "-"), piece), "")
    return made.select(F.col("word").alias("original"), new.alias("new")).withColumn("is_edit", F.col("original") != F.col("new"))


def solid_words(tokens: DataFrame, punctuation: str = PUNCTUATION_WORDS) -> DataFrame:
    """Neighbouring tokens of one cluster as a word, each punctuation token by itself: doc_id, pos, start, end, text.

    Blank tokens are left out. A hyphen has to be a token by itself; one within a token is an error.
    """
    text = F.col("text")
    within = F.contains(text, F.lit("-")) & (text != "-")
    checked = F.when(within, F.raise_error(F.concat(F.lit("a hyphen is no token by itself: "), text))).otherwise(text)
    solid = tokens.where(F.trim(F.regexp_replace("text", r"\s", " ")) != "").withColumn("text", checked)
    grouped = segments.punctuation_groups(solid, tx.is_punctuation(text, punctuation))
    made = grouped.groupBy("doc_id", "group").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda t: t["text"]), "").alias("text"),
    )
    return segments.renumber(made, ["doc_id"], ["group"]).select("doc_id", "pos", "start", "end", "text")


def joined_words(tokens: DataFrame, punctuation: str = PUNCTUATION_WORDS) -> DataFrame:
    """Words of :func:`solid_words`, and those that end in a hyphen with the next: doc_id, pos, start, end, text, opens.

    ``opens`` says which were joined: not a word that is or starts with a hyphen, and not with a word that ends in
    one, so no word is in two joins. :func:`inrow.hyphen_words` gives the same of texts, without an exchange.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    text, after = F.col("text"), F.col("next")
    paired = solid_words(tokens, punctuation).withColumns({"next": F.lead("text").over(w), "next_end": F.lead("end").over(w)})
    opens = text.endswith("-") & ~text.startswith("-") & ~after.endswith("-")
    marked = paired.withColumn("opens", F.coalesce(opens, F.lit(False)))
    marked = marked.withColumn("closed", F.coalesce(F.lag("opens").over(w), F.lit(False)))
    heads = segments.renumber(marked.where("not closed"), ["doc_id"], ["pos"])
    both = lambda whole, part: F.when(F.col("opens"), whole).otherwise(F.col(part)).alias(part)
    return heads.select("doc_id", "pos", "start", both(F.col("next_end"), "end"), both(F.concat("text", "next"), "text"), "opens")


def classified_words(
    joined: DataFrame, score: Callable[[DataFrame], DataFrame], shares: DataFrame, default: float, threshold: float = -1.5
) -> DataFrame:
    """Words of documents, of which a scorer says which hyphens stay: doc_id, pos, start, end, text.

    ``joined`` is as :func:`joined_words` has it. ``score`` adds a column ``score`` to the rows of :func:`hyphen_features`,
    of which there are some for each distinct joined word, however often it occurs, and hyphens at or below the
    threshold go. ``shares`` and ``default`` are those of :func:`hyphen_features`. The places stay those of the text.
    """
    return classified_parts(joined.where("opens"), joined.where("not opens"), score, shares, default, threshold)


def classified_parts(
    opened: DataFrame, rest: DataFrame, score: Callable[[DataFrame], DataFrame], shares: DataFrame, default: float, threshold: float = -1.5
) -> DataFrame:
    """:func:`classified_words` of what was joined and the rest, where these can be had apart."""
    # Only what was joined meets the scores; all else passes straight through.
    open_words = opened.withColumnRenamed("text", "original")
    scored = score(hyphen_features(open_words.select(F.col("original").alias("word")).distinct(), shares, default))
    edited = open_words.join(hyphen_edits(scored, threshold), "original").select("doc_id", "pos", "start", "end", F.col("new").alias("text"))
    return rest.drop("opens").unionByName(edited)


def stringify(queries: DataFrame, words: DataFrame, joiner: str = " ", allow_partial: bool = True, normalize: bool = True) -> DataFrame:
    """Text of each query span (doc_id, pos, start, end) through the words it overlaps.

    Words with anything between them are set apart by ``joiner``. A word that only partly
    lies in the span counts whole if ``allow_partial``, and raises an error else.
    """
    from lamina.operators.intervals import interval_join

    met = interval_join(queries, words.select("doc_id", "pos", "start", "end", "text"), ["doc_id"], "word_")
    if not allow_partial:
        part = (F.col("word_start") < F.col("start")) | (F.col("word_end") > F.col("end"))
        met = met.withColumn("word_text", F.when(part, F.raise_error(F.lit("a word lies partly in a span"))).otherwise(F.col("word_text")))
    w = Window.partitionBy("doc_id", "pos").orderBy("word_start")
    apart = F.col("word_start") > F.lag("word_end").over(w)
    piece = F.concat(F.when(apart, F.lit(joiner)).otherwise(F.lit("")), F.col("word_text"))
    listed = met.withColumn("piece", piece).groupBy("doc_id", "pos", "start", "end").agg(
        F.array_sort(F.collect_list(F.struct("word_start", "piece"))).alias("p"), F.count("*").alias("n_words")
    )
    text = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    text = F.trim(F.regexp_replace(text, r"\s+", " ")) if normalize else text
    return listed.select("doc_id", "pos", "start", "end", text.alias("text"), "n_words")
