"""String measures and features as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.ascii import to_ascii

#: Fixed values, in natural order; of documents, with the en dash and the section sign.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
DOCUMENT_PUNCTUATION = PUNCTUATION + "\u2013\u00a7"
TOP_LEVEL_KEYWORDS = [
    "abstract", "introduction", "conclusions", "references", "acknowledgements",
    "methods", "discussion", "keywords", "appendix",
]


def levenshtein(a: Column, b: Column, case_sensitive: bool = True, strip_spaces: bool = False, normalize: bool = False) -> Column:
    """Edit distance in code points; ``normalize`` divides by the longer length, two empty strings give 0."""
    for_both = lambda f: (f(a), f(b))
    if not case_sensitive:
        a, b = for_both(F.lower)
    if strip_spaces:
        a, b = for_both(lambda c: F.replace(c, F.lit(" "), F.lit("")))
    distance = F.levenshtein(a, b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(distance / longest) if normalize else distance


def similarity(a: Column, b: Column) -> Column:
    """1 less the normalised distance; two empty strings are equal."""
    return 1 - levenshtein(a, b, normalize=True)


def char_ngrams(text: Column, n: int) -> Column:
    """Runs of ``n`` characters; none if the text is shorter."""
    count = F.length(text) - n + 1
    return F.when(count < 1, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(text, i, n))
    )


def jaccard(a: Column, b: Column) -> Column:
    """Share of the distinct elements that both arrays have; 0 if neither has any."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def jaccard_ngrams(source: Column, target: Column, n: int, prefix: int = 50) -> Column:
    return jaccard(char_ngrams(source, n), char_ngrams(F.left(target, F.lit(prefix)), n))


def runs(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def jaccard_numeric(source: Column, target: Column) -> Column:
    return jaccard(runs(source, "[0-9]+"), runs(F.left(target, F.lit(100)), "[0-9]+"))


def jaccard_alpha(source: Column, target: Column) -> Column:
    return jaccard(runs(source, "[A-Za-z]+"), runs(F.left(target, F.lit(50)), "[A-Za-z]+"))


def match_numeric(source: Column, target: Column) -> Column:
    """1 if every number of the source stands in the target's first 100 characters, or if it has none."""
    rest = F.array_except(runs(source, "[0-9]+"), runs(F.left(target, F.lit(100)), "[0-9]+"))
    return F.when(F.size(rest) == 0, 1).otherwise(0)


def has_text(source: Column) -> Column:
    return F.when(source.rlike(r"(?U)[^\s\x1c-\x1f]"), 1).otherwise(0)


def strip_and_tokenize(text: Column) -> Column:
    bare = F.lower(F.regexp_replace(text, r"[()\[\],.&;]", ""))
    return F.filter(F.split(bare, r"\s+"), lambda t: t != "")


def match_source_tokens(source: Column, target: Column) -> Column:
    """1 if all words of the source but et, al and and stand in the target; 0 for an empty source."""
    words = strip_and_tokenize(source)
    wanted = F.filter(words, lambda t: ~t.isin("et", "al", "and"))
    rest = F.array_except(wanted, strip_and_tokenize(target))
    return F.when((F.size(words) > 0) & (F.size(rest) == 0), 1).otherwise(0)


def first_position(source: Column, target: Column) -> Column:
    """Place, from 0, of the source's first word among those of the target's first 50 characters; NaN if absent."""
    first = F.try_element_at(strip_and_tokenize(source), F.lit(1))
    place = F.array_position(strip_and_tokenize(F.left(target, F.lit(50))), first)
    return F.when(place > 0, (place - 1).cast("double")).otherwise(F.lit(float("nan")))


def match_first_token(source: Column, target: Column) -> Column:
    return F.when(F.isnan(first_position(source, target)), 0).otherwise(1)


def indel_ratio(a: Column, b: Column) -> Column:
    """Similarity from 0 to 100 by insertions and deletions alone."""

    @F.pandas_udf("int")
    def ratio(x, y):
        import pandas as pd

        def one(s: str | None, t: str | None) -> int | None:
            if s is None or t is None:
                return None
            if not s and not t:
                return 100
            # Longest common subsequence, a bit for each character of ``t``.
            at: dict[str, int] = {}
            for j, d in enumerate(t):
                at[d] = at.get(d, 0) | 1 << j
            free = full = (1 << len(t)) - 1
            for c in s:
                met = free & at.get(c, 0)
                free = ((free + met) | (free - met)) & full
            return round(200 * (len(t) - free.bit_count()) / (len(s) + len(t)))

        return pd.Series([one(s, t) for s, t in zip(x, y, strict=True)], dtype="Int32")

    return ratio(a, b)


def citation_features(source: Column, target: Column) -> dict[str, Column]:
    """The twelve features of a mention and a bibliography entry, named and in the order that a model of them takes."""
    grams = {f"jaccard_{n}gram": jaccard_ngrams(source, target, n) for n in (1, 2, 3, 4)}
    return {"fuzz_ratio": indel_ratio(source, target)} | grams | {
        "heuristic": match_source_tokens(source, target), "has_source_text": has_text(source),
        "jaccard_numeric": jaccard_numeric(source, target), "match_numeric": match_numeric(source, target),
        "jaccard_alpha": jaccard_alpha(source, target), "match_first_token": match_first_token(source, target),
        "first_position": first_position(source, target),
    }


def citation_source(source: Column) -> Column:
    """What :func:`citation_features` takes from a mention, whatever the entry: to be made once for each."""
    grams = [char_ngrams(source, n).alias(f"grams_{n}") for n in (1, 2, 3, 4)]
    return F.struct(
        *grams, strip_and_tokenize(source).alias("words"), has_text(source).alias("has_text"), runs(source, "[0-9]+").alias("numbers"), runs(source, "[A-Za-z]+").alias("letters")
    )


def citation_target(target: Column) -> Column:
    """What :func:`citation_features` takes from an entry, whatever the mention."""
    start = F.left(target, F.lit(50))
    grams = [char_ngrams(start, n).alias(f"grams_{n}") for n in (1, 2, 3, 4)]
    return F.struct(
        *grams, strip_and_tokenize(target).alias("words"), strip_and_tokenize(start).alias("first_words"),
        runs(F.left(target, F.lit(100)), "[0-9]+").alias("numbers"), runs(start, "[A-Za-z]+").alias("letters"),
    )


def citation_features_of(s: Column, t: Column) -> dict[str, Column]:
    """:func:`citation_features` but the ratio, from :func:`citation_source` and :func:`citation_target`."""
    one_if = lambda c: F.when(c, 1).otherwise(0)
    wanted = F.filter(s["words"], lambda w: ~w.isin("et", "al", "and"))
    place = F.array_position(t["first_words"], F.try_element_at(s["words"], F.lit(1)))
    return {f"jaccard_{n}gram": jaccard(s[f"grams_{n}"], t[f"grams_{n}"]) for n in (1, 2, 3, 4)} | {
        "heuristic": one_if((F.size(s["words"]) > 0) & (F.size(F.array_except(wanted, t["words"])) == 0)), "has_source_text": s["has_text"],
        "jaccard_numeric": jaccard(s["numbers"], t["numbers"]), "match_numeric": one_if(F.size(F.array_except(s["numbers"], t["numbers"])) == 0),
        "jaccard_alpha": jaccard(s["letters"], t["letters"]), "match_first_token": one_if(place > 0),
        "first_position": F.when(place > 0, (place - 1).cast("double")).otherwise(F.lit(float("nan"))),
    }


def strip_punctuation(text: Column, punctuation: str = PUNCTUATION) -> Column:
    """A dictionary form: trimmed, lower case, without punctuation at its ends."""
    return F.btrim(F.lower(F.trim(text)), F.lit(punctuation))


def is_punctuation(text: Column, punctuation: str = DOCUMENT_PUNCTUATION) -> Column:
    """Whether a token is a stretch of the punctuation string, as the empty string is too."""
    return F.contains(F.lit(punctuation), text)


def without_trailing_hyphens(text: Column) -> Column:
    return F.rtrim(text, F.lit("-"))


def without_nul(text: Column) -> Column:
    return F.replace(text, F.char(F.lit(0)), F.lit(""))


#: White space, that of Unicode too, as a class of Java's patterns.
_SPACE = r"(?U)[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, _SPACE + r"+\z", ""), r"\A" + _SPACE + "+", "")


def clean_doi(text: Column) -> Column:
    """In lower case and without white space; null unless it begins with ``10.``, white space in front aside."""
    bare = F.lower(strip(text))
    return F.when(bare.startswith("10."), F.regexp_replace(bare, _SPACE, ""))


def clean_field(text: Column) -> Column:
    """In ASCII as far as :mod:`ascii` goes, with words joined again at hyphens before white space; null if nothing is left."""
    return F.nullif(F.regexp_replace(to_ascii(strip(text)), "-" + _SPACE + "+", ""), F.lit(""))


def number_prefix(text: Column) -> Column:
    """Leading section number without a final period; null if there is none."""
    found = F.regexp_extract(text, r"^([0-9.]+)", 1)
    return F.when(found != "", F.regexp_replace(found, r"\.$", ""))


def implied_parent(text: Column) -> Column:
    """The number one level up; null at the top."""
    number = number_prefix(text)
    return F.when(F.contains(number, F.lit(".")), F.regexp_replace(number, r"\.[^.]*$", ""))


def has_period_prefix(text: Column) -> Column:
    """A first word of at most three characters with one period, its last, before other words."""
    parts = F.split(F.trim(text), " ")
    first = F.try_element_at(parts, F.lit(1))
    periods = F.length(first) - F.length(F.replace(first, F.lit("."), F.lit("")))
    return (F.size(parts) > 1) & first.endswith(".") & (periods == 1) & (F.length(first) <= 3)


def is_top_level_keyword(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(text)), r"[.:]$", "")
    ends = F.lit(False)
    for word in TOP_LEVEL_KEYWORDS:
        ends = ends | bare.endswith(word)
    return (bare != "") & (F.size(F.split(bare, " ")) <= 2) & ends


def is_all_caps(text: Column) -> Column:
    bare = F.trim(text)
    return (bare != "") & (F.upper(bare) == bare)


def has_upper_letter_prefix(text: Column) -> Column:
    parts = F.split(F.trim(text), " ")
    first = F.try_element_at(parts, F.lit(1))
    return (F.size(parts) > 1) & (F.length(first) == 1) & first.between("A", "Z")


def heading_features(text: Column) -> dict[str, Column]:
    return {
        "prefix": number_prefix(text), "implied_parent": implied_parent(text),
        "top_level_prefix": number_prefix(text).isNotNull() & implied_parent(text).isNull(),
        "period_prefix": has_period_prefix(text), "top_level_keyword": is_top_level_keyword(text),
        "all_caps": is_all_caps(text), "upper_letter_prefix": has_upper_letter_prefix(text),
    }


def is_hyphen_candidate(text: Column) -> Column:
    return F.contains(text, F.lit("-")) & ~text.startswith("-") & ~text.endswith("-")


def hyphen_features(prefix: Column, suffix: Column) -> dict[str, Column]:
    """Features of joining two parts of a word at a hyphen."""
    shape = lambda c: F.regexp_replace(c, r"\w", "x")
    return {
        "prefix": prefix, "suffix": suffix, "prefix_shape": shape(prefix), "suffix_shape": shape(suffix),
        "prefix_tail": F.right(prefix, F.lit(2)), "suffix_head": F.left(suffix, F.lit(2)),
        "prefix_length": F.length(prefix), "suffix_length": F.length(suffix),
    }


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def random_letters(length: Column, *keys: Column, seed: int = 0) -> Column:
    """As many of a-z as ``length`` says, by the hash of the keys, so a task that runs again gives the same ones."""
    letter = lambda i: F.chr(F.pmod(F.xxhash64(F.lit(seed), *keys, i), F.lit(26)) + 97)
    made = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), letter), "")
    return F.substring(made, F.lit(1), length)
