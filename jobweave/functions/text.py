"""Text expressions built from Spark's own functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def fold_map() -> tuple[str, str]:
    """(from, to) for `translate`: letters with one accent lose it, loose accents vanish.

    Built by rule from the Unicode decompositions of the Latin, Greek and Cyrillic blocks.
    """
    source, target = [], []
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00)):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if len(parts) == 2 and unicodedata.combining(parts[1]) and char == char.lower():
            source.append(char)
            target.append(parts[0])
    accents = [chr(code) for code in range(0x300, 0x370)]
    return "".join(source + accents), "".join(target)


FOLD_FROM, FOLD_TO = fold_map()


def fold(col: Column) -> Column:
    """Lower case without accents.  Plain ASCII, one byte per character, has none to fold."""
    ascii_only = F.octet_length(col) == F.length(col)
    return F.when(ascii_only, F.lower(col)).otherwise(F.translate(F.lower(col), FOLD_FROM, FOLD_TO))


def tokens(col: Column) -> Column:
    """Runs of letters and digits, folded; `_` and punctuation split."""
    return F.regexp_extract_all(fold(F.coalesce(col, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks.

    The pattern reads every character of a long text, so it serves only where a text ends in a line end that is no white
    space to it: `$` matches before that one too.
    """
    odd = reduce(lambda a, b: a | b, (F.endswith(col, F.lit(end)) for end in ("\u0085", "\u2028", "\u2029")))
    return F.when(odd, F.regexp_replace(col, r"^\s+|\s+$", "")).otherwise(F.btrim(col, F.lit(" \t\n\x0b\x0c\r")))


def squeeze(col: Column) -> Column:
    """Collapse runs of white space to one blank and trim."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def words(col: Column) -> Column:
    """White-space separated words; a blank text has none."""
    return F.filter(F.split(col, r"\s+"), lambda w: w != "")


def normalise_query(col: Column) -> Column:
    """Lower case, anything but letters, digits, `_` and blanks turned into a blank, blanks collapsed."""
    return squeeze(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}_\s]", " "))


def any_of(col: Column, needles: Iterable[str]) -> Column:
    """Does the text hold any of the needles, whatever the case?

    A chain of plain substring tests: they run on the bytes, a pattern with alternatives is several times slower.
    """
    return any_in(F.lower(col), needles)


def any_in(low: Column, needles: Iterable[str]) -> Column:
    """`any_of` for a text that is in lower case already, so that long texts are folded once, not once per needle."""
    return reduce(lambda a, b: a | b, (low.contains(n.lower()) for n in needles))


def first_of(col: Column, pairs: Sequence[tuple[str, object]], default: object) -> Column:
    """Value of the first needle, in the given order, that the text holds."""
    low = F.lower(col)
    hits = [F.when(low.contains(needle), F.lit(value)) for needle, value in pairs]
    return F.coalesce(*hits, F.lit(default))


def blank_to_null(col: Column, *also: str) -> Column:
    """Trimmed text, with blank and the `also` values (any case) as null."""
    clean = strip(col)
    return F.when(~F.lower(clean).isin("", *also), clean)


def value_or_blank(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))
