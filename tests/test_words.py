"""Words from tokens in one go, against a plain walk over the tokens of each document."""

import random

import pytest
from pyspark.sql import functions as F

from lamina.operators import inrow, words

TOKENS = "doc_id long, pos long, start long, end long, text string, cluster long"


def rule(features):
    """Keeps a hyphen behind a prefix of an odd length."""
    return features.withColumn("score", F.when(F.col("p_len") % 2 == 1, 0.0).otherwise(-9.0))


def tokens_of(doc, clusters):
    out, at = [], 0
    for c, cluster in enumerate(clusters):
        for t in cluster:
            out.append((doc, len(out), at, at + len(t), t, c))
            at += len(t)
        at += 1
    return out


def truth(tokens):
    made, cluster_before, open_word = [], None, False
    for doc, _, start, end, text, cluster in tokens:
        if not text.strip():
            continue
        alone = text in words.PUNCTUATION_WORDS
        if alone or not open_word or cluster != cluster_before:
            made.append([doc, start, end, text])
        else:
            made[-1][2], made[-1][3] = end, made[-1][3] + text
        open_word, cluster_before = not alone, cluster
    out, i = [], 0
    while i < len(made):
        doc, start, end, text = made[i]
        if i + 1 < len(made) and text.endswith("-") and not text.startswith("-") and not made[i + 1][3].endswith("-"):
            parts = (text + made[i + 1][3]).split("-")
            text, before = parts[0], len(parts[0])
            for p in parts[1:]:
                text += "-" * (before % 2) + p
                before += 1 + len(p)
            end, i = made[i + 1][2], i + 1
        out.append((doc, len(out), start, end, text))
        i += 1
    return out


def classified(spark, rows):
    made = words.classified_words(words.joined_words(spark.createDataFrame(rows, TOKENS)), rule, spark.createDataFrame([], "word string, prob double"), 0.0)
    return sorted(map(tuple, made.select("doc_id", "pos", "start", "end", "text").collect()))


def test_words_of_random_tokens(spark):
    rng = random.Random(4)
    kinds = ["-", "-", "ab", "abc", "Xyz", "7", ",", "(", "\u00a7", " "]
    docs = [tokens_of(d, [[rng.choice(kinds) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(0, 12))]) for d in range(150)]
    assert classified(spark, [t for d in docs for t in d]) == sorted(w for d in docs for w in truth(d))


def test_words_of_given_tokens(spark):
    given = {
        1: [["fine", "-"], ["tuning", "."]],  # joined over white space; four letters, so the hyphen goes
        2: [["few", "-"], ["shot"]],  # three, so it stays
        3: [["-"], ["5"]],  # a hyphen alone is a word
        4: [["end", "-"]],  # nothing follows
        5: [["a", "-"], ["b", "-"], ["c"]],  # the next ends in a hyphen, so only the second is joined
        6: [["state", "-", "of", "-"], ["art"]],
        7: [["(", "see", ")", ","]],
        8: [["-", "x", "-"], ["y"]],  # starts with a hyphen
    }
    got = classified(spark, [t for d, c in given.items() for t in tokens_of(d, c)])
    texts = {d: [r[4] for r in got if r[0] == d] for d in given}
    assert texts == {
        1: ["finetuning", "."], 2: ["few-shot"], 3: ["-", "5"], 4: ["end-"], 5: ["a-", "b-c"],
        6: ["state-ofart"], 7: ["(", "see", ")", ","], 8: ["-x-", "y"],
    }
    assert classified(spark, []) == []


def test_a_hyphen_within_a_token_is_an_error(spark):
    with pytest.raises(Exception, match="a hyphen is no token by itself"):
        classified(spark, tokens_of(1, [["a-b"]]))


def test_words_in_the_row_are_those_of_tokens(spark):
    rng = random.Random(8)
    pieces = ["-", "-", "a", "bc", "x_", "_", ",", "(", "\u00a7", "\u2013", "\u00e9", "\U0001f600", " ", " ", "\n"]
    texts = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    docs = spark.createDataFrame([*texts, (None, "a- b"), (7, None), (8, "")], "doc_id long, text string").repartition(3)
    by_tokens = words.joined_words(inrow.placed_split_tokens(docs.where("doc_id is not null and text is not null")))
    in_row = inrow.hyphen_words(docs, words.PUNCTUATION_WORDS).where("doc_id is not null")
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "pos", "start", "end", "text", "opens").collect()))
    assert rows(in_row) == rows(by_tokens)
    assert inrow.hyphen_words(docs.where("doc_id is null"), words.PUNCTUATION_WORDS).first().text == "a-b"
    assert inrow.hyphen_words(docs.limit(0), words.PUNCTUATION_WORDS).count() == 0


def test_joined_words_and_others_apart(spark):
    """No more leaves a task than is asked for."""
    docs = spark.createDataFrame([(1, "a- b c-d- e, f- - g-"), (2, ""), (3, None), (4, "x- y- z")], "doc_id long, text string")
    both = inrow.hyphen_words(docs, words.PUNCTUATION_WORDS)
    for joined in (True, False):
        part = inrow.hyphen_words(docs, words.PUNCTUATION_WORDS, joined)
        assert sorted(part.collect()) == sorted(both.where("opens" if joined else "not opens").collect()) and part.count()
