"""Text columns: trimming, UTF-16 lengths, folding, tokens, snippets."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters ECMAScript counts as white space, as a plain
# string (for btrim) and as a Java character class.
WHITESPACE = (
    "\t\n\u000b\f\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WS = "[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"

# Fixed value: letters, numbers and private-use characters form tokens.
TOKEN = "([\\p{L}\\p{N}\\p{Co}]+)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_ws(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return trim_ws(col) == ""


def utf16_length(col: Column) -> Column:
    """Length in UTF-16 units; plain ``length`` counts an emoji once, not twice."""
    return F.when(F.octet_length(col) == F.length(col), F.length(col)).otherwise(
        (F.octet_length(F.encode(col, "UTF-16BE")) / 2).cast("int")
    )


def utf16_left(col: Column, n: int) -> Column:
    """First ``n`` UTF-16 units; half of a cut surrogate pair is dropped."""
    units = F.encode(col, "UTF-16BE")
    last = F.hex(F.substring(units, 2 * n - 1, 2))
    keep = F.when(last.between("D800", "DBFF"), 2 * n - 2).otherwise(2 * n)
    cut = F.decode(F.substring(units, F.lit(1), keep), "UTF-16BE")
    return F.when(utf16_length(col) == F.length(col), F.left(col, F.lit(n))).otherwise(cut)


def newline_count(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit("")))


@lru_cache(maxsize=1)
def latin_fold_table() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the ASCII letter each one folds to.

    Built from the Unicode decompositions: base letter a-z followed by marks only.
    """
    source, target = [], []
    for code in range(0x00C0, 0x1F00):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if (
            len(parts) > 1
            and "a" <= parts[0] <= "z"
            and all(unicodedata.category(p) == "Mn" for p in parts[1:])
        ):
            source.append(char)
            target.append(parts[0])
    return "".join(source), "".join(target)


def fold(col: Column) -> Column:
    """Lower-case and strip diacritics; ASCII text skips the table look-up."""
    source, target = latin_fold_table()
    lowered = F.lower(col)
    folded = F.regexp_replace(F.translate(lowered, source, target), "\\p{M}+", "")
    return F.when(F.octet_length(col) == F.length(col), lowered).otherwise(folded)


def tokens(col: Column) -> Column:
    """Folded tokens in order (NULL gives an empty array)."""
    text = fold(F.coalesce(col, F.lit("")))
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def query_phrases(col: Column) -> Column:
    """White-space separated phrases of a query, each one an array of tokens.

    A phrase of several tokens must match as adjacent tokens; phrases without any
    token are dropped.
    """
    parts = F.filter(F.split(col, WS + "+"), lambda p: p != "")
    return F.filter(F.transform(parts, tokens), lambda p: F.size(p) > 0)


def snippet(col: Column, chars: int = 200) -> Column:
    """First ``chars`` characters, with ``...`` when something was cut."""
    return F.when(
        utf16_length(col) > chars, F.concat(utf16_left(col, chars), F.lit("..."))
    ).otherwise(col)


def token_estimate(col: Column, chars_per_token: int = 4) -> Column:
    return F.ceil(utf16_length(col) / chars_per_token).cast("int")


def content_hash(col: Column) -> Column:
    return F.sha2(col, 256)


def score_band(norm: Column) -> Column:
    """Band of a max-normalised score."""
    return (
        F.when(norm >= 0.8, "high")
        .when(norm >= 0.5, "moderate")
        .when(norm >= 0.2, "low")
        .otherwise("skip")
    )
