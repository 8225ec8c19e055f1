"""Text in composed spelling that knows where each of its characters stands in the stored one.

A stored text may spell an accented letter as a letter and a combining mark, or two letters as one ligature. Rules and quotations are written in
composed letters, so they are compared with the composed form; what they find is cut out of the stored text. Only texts that
hold a mark or a ligature pay for it.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselens.functions.matching import cut, once
from caselens.functions.text import col

#: Combining marks and the Latin ligatures.
SPECIAL = "[\\p{Mn}ﬀ-ﬆ]"
#: A character with the marks that follow it (at the text's begin also those before it).
CLUSTER = r"(?s)(?:^\p{Mn}+)?\P{Mn}\p{Mn}*"


def _pairs() -> dict[str, str]:
    """Decomposed to composed spelling of Latin letters, and ligatures to their letters."""
    letters = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    found = {unicodedata.normalize("NFD", x): x for x in letters if len(unicodedata.normalize("NFD", x)) > 1}
    return found | {chr(c): unicodedata.normalize("NFKD", chr(c)) for c in range(0xFB00, 0xFB07)}


#: Spellings are looked up in one of so many small tables; a map is read entry by entry.
TABLES = 64
#: Letters that have marks of their own, by code point.
FIRST, LAST = 0xC0, 0x1EFF
LETTER = f"[{chr(FIRST)}-{chr(LAST)}]"


def _composed_of(cluster: Column) -> Column:
    """Composed spelling of a letter and its marks, or of a ligature; NULL of anything else."""
    tables: list[list[str]] = [[] for _ in range(TABLES)]
    for spelling, letter in _pairs().items():
        tables[ord(spelling[0]) % TABLES].append(f"{spelling}:{letter}")
    maps = F.array(*[F.str_to_map(F.lit(",".join(t)), F.lit(","), F.lit(":")) for t in tables])
    return F.try_element_at(F.get(maps, F.ascii(cluster) % TABLES), cluster)


def aligned(c: Column | str) -> Column:
    """STRUCT(text, clusters, at): composed text; of texts that are spelled otherwise also the stored clusters and, for each composed
    character, the number of its cluster. A mark that fits no letter is left out."""
    stored = col(c)
    clusters = F.regexp_extract_all(stored, F.lit(CLUSTER), F.lit(0))
    spelled = lambda x: F.coalesce(F.when((F.length(x) > 1) | x.rlike(SPECIAL), _composed_of(x)), F.regexp_replace(x, r"\p{Mn}+", ""))
    letters = lambda found: F.transform(found, lambda x: F.when(F.octet_length(x) == 1, x).otherwise(spelled(x)))
    numbers = lambda made: F.flatten(F.transform(made, lambda x, i: F.array_repeat(i, F.length(x))))
    plain = F.struct(stored.alias("text"), F.lit(None).cast("array<string>").alias("clusters"), F.lit(None).cast("array<int>").alias("at"))
    view = once(clusters, lambda found: once(letters(found), lambda made: F.struct(
        F.array_join(made, "").alias("text"), found.alias("clusters"), numbers(made).alias("at"))))
    return F.when(stored.rlike(SPECIAL), view).otherwise(plain)


def composed(c: Column | str) -> Column:
    """The composed spelling alone."""
    return F.when(col(c).rlike(SPECIAL), aligned(c)["text"]).otherwise(col(c))


def decomposed(c: Column | str) -> Column:
    """Every accented Latin letter as a letter and its marks."""
    apart = {b: a for a, b in _pairs().items() if len(b) == 1}
    table = F.split(F.lit(",".join(apart.get(chr(x), chr(x)) for x in range(FIRST, LAST + 1))), ",")
    # Only the letters in question are looked at one by one, by their code point.
    runs = F.regexp_extract_all(col(c), F.lit(f"{LETTER}|[^{LETTER[1:-1]}]+"), F.lit(0))
    spelled = F.transform(runs, lambda x: F.when(x.rlike(f"^{LETTER}"), F.get(table, F.ascii(x) - FIRST)).otherwise(x))
    return F.when(col(c).rlike(LETTER), F.array_join(spelled, "")).otherwise(col(c))


def stored_at(view: Column, offset: Column) -> Column:
    """Offset in the stored text of an offset in the composed text; the marks of a letter belong to it."""
    number = F.when(offset >= F.size(view["at"]), F.size(view["clusters"])).otherwise(F.get(view["at"], offset))
    return F.when(view["clusters"].isNull(), offset).otherwise(F.length(F.array_join(F.slice(view["clusters"], F.lit(1), number), ""))).cast("int")


def stored_cut(stored: Column, view: Column, start: Column, stop: Column) -> Column:
    """What the stored text has from start to stop of the composed one."""
    return cut(stored, stored_at(view, start), stored_at(view, stop))
