"""Letters of Latin, Greek and Cyrillic script, and common signs, in ASCII, as expressions.

The tables follow from the decomposition classes of Unicode: what decomposes into ASCII and
marks becomes that ASCII. Only letters and signs that don't decompose are listed.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, by script: small letters and signs without a decomposition into ASCII. Capitals follow.
LATIN = {"ß": "ss", "æ": "ae", "ð": "d", "ø": "o", "þ": "th", "đ": "d", "ħ": "h", "ı": "i", "ł": "l", "ŋ": "ng", "œ": "oe", "ŧ": "t"}
GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n",
    "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "ς": "s", "σ": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k", "л": "l", "м": "m", "н": "n",
    "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch",
    "ъ": "'", "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia", "ё": "io", "ђ": "dj", "є": "ie", "ѕ": "dz", "і": "i", "ј": "j",
    "љ": "lj", "њ": "nj", "џ": "dzh",
}
SIGNS = {
    "¡": "!", "§": "SS", "©": "(c)", "«": "<<", "®": "(r)", "°": "deg", "±": "+-", "´": "'", "·": "*", "»": ">>", "¿": "?", "×": "x", "÷": "/",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "--", "―": "--", "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "„": ",,",
    "†": "+", "•": "*", "′": "'", "″": '"', "‹": "<", "›": ">", "⁄": "/",
}
#: Blocks whose characters are looked at: Latin to Cyrillic, Latin and Greek with marks, signs and numbers, ligatures, wide forms.
BLOCKS = ((0xA0, 0x530), (0x1E00, 0x2070), (0x2070, 0x20A0), (0x2100, 0x2190), (0xFB00, 0xFB07), (0xFF01, 0xFF5F))


@functools.cache
def table() -> dict[str, str]:
    """Each character that has an ASCII form, with that form; marks have the empty one."""
    small = LATIN | GREEK | CYRILLIC
    # The capital of some small letters is no single character, or that of another.
    capitals = {c.upper(): v.capitalize() for c, v in small.items() if len(c.upper()) == 1 and c.upper().lower() == c}
    fixed = capitals | small | SIGNS
    out = dict(fixed)
    for c in (chr(x) for a, b in BLOCKS for x in range(a, b)):
        parts = [p for p in unicodedata.normalize("NFKD", c) if not unicodedata.combining(p)]
        made = "".join(fixed.get(p, p) for p in parts)
        if c not in fixed and made.isascii() and (made or unicodedata.combining(c)):
            out[c] = made
    return out


def to_ascii(text: Column) -> Column:
    """The text with every character that has an ASCII form in that form; others stay. Null stays null, and ASCII costs one test."""
    forms = sorted(table().items(), key=lambda kv: (len(kv[1]) != 1, kv[0]))
    one_for_one = [(c, v) for c, v in forms if len(v) < 2]  # marks, which have no counterpart, come last
    longer = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(v).alias("v")) for c, v in forms if len(v) > 1])
    short = F.translate(text, "".join(c for c, _ in one_for_one), "".join(v for _, v in one_for_one))
    beyond = lambda c: c.rlike(r"[^\x00-\x7f]")
    long = F.aggregate(longer, short, lambda t, x: F.replace(t, x["c"], x["v"]))
    return F.when(beyond(text), F.when(beyond(short), long).otherwise(short)).otherwise(text)
