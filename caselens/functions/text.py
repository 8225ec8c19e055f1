"""Column expressions on text; all stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselens.functions.matching import once

# Blanks beyond ASCII: no-break, figure, narrow, ideographic and the other spaces of fixed width.
WIDE_BLANKS = "\u00A0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202F\u205F\u3000"
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85" + WIDE_BLANKS
# Single characters below 256 are one table look-up in a pattern, anything else is compared one by one: wide blanks are looked for among characters
# of their range only.
LATIN_BLANKS = r"\x20\x09\x0A\x0B\x0C\x0D\x1C\x1D\x1E\x1F\x85\xA0"
BLANK_RUN = rf"[{LATIN_BLANKS}[ -　&&[  -     　]]]+"
LATIN_BLANK_RUN = f"[{LATIN_BLANKS}]+"


def _accent_table() -> tuple[str, str]:
    """Lower-case accented letters and their base letter, one character each."""
    accented, base = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        if letter == letter.lower() and plain != letter and len(plain) == 1:
            accented.append(letter)
            base.append(plain)
    return "".join(accented), "".join(base)


ACCENTED, BASE = _accent_table()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Q01: lower case without accents; one character in, one out, so offsets hold."""
    return F.translate(F.lower(col(c)), ACCENTED, BASE)


def compact(c: Column | str) -> Column:
    """Q02: folded text reduced to letters a-z and digits."""
    return F.regexp_replace(fold(c), "[^a-z0-9]+", "")


def strip(c: Column | str) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.trim(col(c), F.lit(BLANKS))


def squash(c: Column | str) -> Column:
    """Collapse runs of blanks to one space and trim."""
    return F.trim(F.regexp_replace(col(c), BLANK_RUN, " "))


def unmarked(c: Column | str) -> Column:
    """Text without combining marks, so that decomposed accents fold like composed ones; offsets move."""
    return F.regexp_replace(col(c), r"\p{Mn}+", "")


def squash_fold(c: Column | str) -> Column:
    return squash(fold(unmarked(c)))


def words(c: Column | str) -> Column:
    """Blank-separated words; empty text gives an empty array."""
    return F.filter(F.split(col(c), BLANK_RUN), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\n")


def present(c: Column) -> Column:
    """Non-null and not blank."""
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def _folded(c: Column) -> Column:
    """Folded text without combining marks; ASCII text only needs lower case."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(fold(unmarked(c)))


def index_tokens(c: Column | str) -> Column:
    """Tokens of the index side: every run of letters and digits, short ones included."""
    return F.regexp_extract_all(_folded(col(c)), F.lit(r"[\p{L}\p{N}]++"), F.lit(0))


def ascii_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(_folded(col(c)), F.lit("[a-z0-9]++"), F.lit(0))


def runs(values: Column) -> Column:
    """array<struct<value, n>>: how often each value is in a sorted array."""
    differs = lambda i: (i == 0) | (F.get(values, i) != F.get(values, i - 1))
    starts = F.when(F.size(values) > 0, F.filter(F.sequence(F.lit(0), F.size(values) - 1), differs)).otherwise(F.expr("cast(array() as array<int>)"))
    # An empty array has one end more than it has starts.
    return once(starts, lambda at: F.filter(F.zip_with(
        at, F.concat(F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), F.array(F.size(values))),
        lambda i, j: F.when(i.isNotNull(), F.struct(F.get(values, i).alias("value"), (j - i).cast("bigint").alias("n")))), lambda r: r.isNotNull()))


def flags(*pairs: tuple[Column, str | Column]) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    whens = [F.when(cond, F.lit(label) if isinstance(label, str) else label) for cond, label in pairs]
    return F.filter(F.array(*whens), lambda x: x.isNotNull())


