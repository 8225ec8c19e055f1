"""Benchmark decontamination: pigeonhole edit matching.

Texts and test items are normalised to lower-cased words joined by single blanks. An item of m characters may occur with up to
e = floor(rate * m) edits. Cut into e + 1 pieces, one of which an occurrence leaves unchanged, it is found by exact piece hits (one
automaton over the pieces of a block of items), and each hit's surroundings are verified by Myers' bit-parallel edit distance. Whole
texts are searched; every hit is verified unless it lies where the item's last verification has looked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.08
#: Items that are broadcast at a time; more are searched in blocks.
BLOCK = 20_000
#: Items under so many characters must match exactly and between word ends.
SHORT = 24
#: Starts behind a hit's that are verified with it.
AHEAD = 64
WORD = re.compile(r"\w+")
SCHEMA = "doc_id long, item_id long, distance int, start long, end long"


def normal(text: str | None) -> str:
    return " ".join(WORD.findall((text or "").lower()))


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """(offset, piece) of the e + 1 parts of almost equal length."""
    count = int(rate * len(item)) + 1 if len(item) >= SHORT else 1
    ends = [len(item) * i // count for i in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def best_match(item: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end in text) of the item's best occurrence within the budget, the first of equals; Myers' bit vectors."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (~(xh | up) & full)
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full  # the item may begin anywhere
        up = mh | (~(xv | ph) & full)
        down = ph & xv
        if score <= budget and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def search(text: str, machine: ahocorasick.Automaton, items: list[tuple[int, str]], rate: float = RATE) -> dict[int, tuple[int, int]]:
    """item id -> (distance, end) of its best occurrence in a normalised text."""
    found: dict[int, tuple[int, int]] = {}
    done: dict[int, tuple[int, int]] = {}  # of each item, the starts up to which its last surroundings were verified
    for end, hits in machine.iter(text):
        for k, offset, length in hits:
            item_id, item = items[k]
            m = len(item)
            budget = int(rate * m) if m >= SHORT else 0
            start = end + 1 - length - offset
            if m < SHORT:
                if (start == 0 or text[start - 1] == " ") and (start + m == len(text) or text[start + m] == " "):
                    found.setdefault(item_id, (0, start + m))
                continue
            first, last = done.get(k, (1, 0))
            if first <= start <= last:
                continue
            # an occurrence with this piece begins within the budget of the hit's start and ends within it of start + m
            low = max(0, start - 2 * budget)
            got = best_match(item, text[low : start + AHEAD + m + budget], budget)
            done[k] = start - budget, start + AHEAD
            if got and (item_id not in found or (got[0], low + got[1]) < found[item_id]):
                found[item_id] = (got[0], low + got[1])
    return found


def automaton(items: list[tuple[int, str]], rate: float = RATE) -> ahocorasick.Automaton | None:
    keys: dict[str, list[tuple[int, int, int]]] = {}
    for k, (_, item) in enumerate(items):
        for offset, piece in pieces(item, rate):
            keys.setdefault(piece, []).append((k, offset, len(piece)))
    if not keys:
        return None
    machine = ahocorasick.Automaton()
    for piece, hits in keys.items():
        machine.add_word(piece, hits)
    machine.make_automaton()
    return machine


def _place(text: str, end: int, length: int) -> tuple[int, int]:
    """Normalised (end, length) as code points of the text itself."""
    at, first, last = 0, None, 0
    low = text.lower()
    # a few letters have two code points in lower case
    source = None if len(low) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()]
    for word in WORD.finditer(low):
        stop = at + len(word[0])
        if first is None and stop > end - length:
            first = word.start()
        if at < end:
            last = word.end()
        at = stop + 1
        if at >= end:
            break
    first = first or 0
    return (first, last) if source is None else (source[first], source[last - 1] + 1)


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """(item_id, normal text) of all items, about ``BLOCK`` at a time; items without an id or words are left out."""
    blocks = max(1, -(-items.count() // BLOCK))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).select("item_id", "text").distinct().collect()
        yield [(r["item_id"], text) for r in rows if r["item_id"] is not None and (text := normal(r["text"]))]


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance, start, end: the best occurrence of each item in each text, if there is one within the budget.

    start and end are code points of the whole text. Null and empty texts and items match nothing; items with equal normal text each
    match; a repeated row of ``docs`` gives repeated rows; other columns are not read.
    """
    out = None
    for part in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            part = shared.value
            machine, length = automaton(part, rate), {}
            for item_id, item in part:
                length[item_id] = len(item)
            for batch in batches:
                rows = []
                if machine is not None:
                    for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                        if text.is_valid and (whole := text.as_py()):
                            for item_id, (distance, end) in search(normal(whole), machine, part, rate).items():
                                rows.append((doc_id.as_py(), item_id, distance, *_place(whole, end, length[item_id])))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "distance", "start", "end"])

        found = docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
        out = found if out is None else out.union(found)
    return out


def uncontaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """All columns of the rows in which no item occurs. Each row is judged by its own text, whatever its doc_id, and no row is shuffled."""
    for part in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            part = shared.value
            machine = automaton(part, rate)
            for batch in batches:
                clean = [machine is None or not t.is_valid or not search(normal(t.as_py()), machine, part, rate) for t in batch.column("text")]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
