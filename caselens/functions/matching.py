"""Regular-expression matches with their offsets, as array expressions on the row."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Stands for a match while the text between the matches is measured; texts that hold it themselves are split at the pattern.
MARK = "\uE0FF"


def any_word(words: Iterable[str]) -> str:
    """Pattern of the words with common beginnings written once; where two of them match, the longer is tried first."""
    ends: dict[str, list[str]] = {}
    for w in words:
        ends.setdefault(w[:1], []).append(w[1:])
    whole = ends.pop("", None) is not None
    parts = [re.escape(head) + any_word(rest) for head, rest in ends.items()]
    body = parts[0] if len(parts) == 1 and not whole else f"(?:{'|'.join(parts)})" if parts else ""
    return f"{body}?" if whole and parts else body


def match_spans(text: Column, pattern: str) -> Column:
    """All matches as array<struct<start, stop, value>>, zero-based; the pattern must not match nothing.

    Spark returns the matches and, by splitting where they were, the text between them; running lengths
    give the offsets. Most texts hold no match, which the one search for matches tells.
    """
    # Spark compiles a pattern to split at anew for every row; to split at one character needs none.
    parts = F.when(F.contains(text, F.lit(MARK)), F.split(text, pattern, -1)).otherwise(F.split(F.regexp_replace(text, pattern, MARK), MARK, -1))
    zero = F.expr("cast(array() as array<struct<start:int,stop:int,value:string>>)")

    def add(acc: Column, p: Column) -> Column:
        start = F.coalesce(F.try_element_at(acc, F.lit(-1))["stop"], F.lit(0)) + p["gap"]
        return F.concat(acc, F.array(F.struct(
            start.alias("start"), (start + F.length(p["value"])).alias("stop"), p["value"].alias("value"))))

    def placed(found: Column) -> Column:
        gaps = F.slice(parts, F.lit(1), F.size(found))
        pairs = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("value")))
        return F.when(F.size(found) == 0, zero).otherwise(F.aggregate(pairs, zero, add))

    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def plain_spans(text: Column, pattern: str) -> Column:
    """``match_spans`` of a pattern that looks at nothing beside its match (no boundaries, no lookaround beyond it).

    What such a pattern finds it would also find at an earlier place, so each match stands at the first place of its letters after the last one.
    """
    zero = F.expr("cast(array() as array<struct<start:int,stop:int,value:string>>)")

    def add(acc: Column, value: Column) -> Column:
        start = F.call_function("locate", value, text, F.coalesce(F.try_element_at(acc, F.lit(-1))["stop"], F.lit(0)) + 1) - 1
        return once(start, lambda at: F.concat(acc, F.array(F.struct(at.alias("start"), (at + F.length(value)).alias("stop"), value.alias("value")))))

    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), zero, add)


def first_match(text: Column, pattern: str) -> Column:
    """Zero-based start of the first match, NULL when there is none."""
    return F.when(text.rlike(pattern), F.length(F.element_at(F.split(text, pattern, 2), 1)))


def cut(text: Column, start: Column, stop: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int"))


def excerpt(text: Column, position: Column, limit: int) -> Column:
    """Blank-collapsed stretch of text that begins a quarter of the limit before the position."""
    start = F.greatest(F.lit(0), position - limit // 4)
    return F.trim(F.regexp_replace(cut(text, start, start + limit), r"\s+", " "))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed a single time per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed once per row.

    A plain column is copied into every later filter that mentions it; a generated one is not, which keeps
    nested regular expressions from being evaluated again and the plan from growing.
    """
    if name in df.columns:
        return df.withColumn(name, F.explode(F.array(value)))
    # Inlined, as the type of what is exploded would be made out anew for every row, which costs much for nested expressions.
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))
