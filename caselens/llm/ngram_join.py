"""N-gram Jaccard join by PartEnum signatures.

Every document is the set of its distinct word 5-grams. Set sizes are dealt into bands; a pair belongs to the band of its larger
set, of greatest size r, where similarity t bounds the symmetric difference by k = floor(2 r (1 - t) / (1 + t)). The domain of
shingles is hashed into n1 groups of n2 cells each. With n1 * (k2 + 1) > k, some group has at most k2 differing cells, so that the
enumerated subsets of n2 - k2 cells of each group hold one on which the pair agrees fully: its content's hash is the shared
signature. No similar pair is lost; an exact comparison of the sets follows, for pairs that parity marks (see ``parity_marks``) don't rule out.

For all but the smallest sets there are twice as many cells as k + 1 (n2 = 1), so a similar pair agrees on m = n1 - k cells or more.
Each set then leaves out its m - 1 least telling cells, in an order that depends on the content alone: the most telling cell that a
pair shares has m - 1 shared ones behind it, so both sides keep it. Least telling are empty cells, then those without a rare shingle, which would
gather unrelated documents that share a passage; shingles found in three or more of every eighth class of equal sets aren't rare. Which
ones count as rare changes the cost, never the result.

Documents with equal sets are one class from the start. A signature's smallest class is its head; every class is first compared with the
head that it meets most often (a star), and the matches are merged into components. In the next rounds one class of each component in a
signature meets one of its largest component, another one each time, until a round finds nothing: so a group of near copies costs a
row per member, not a row per pair. What is left are signatures of components that may or may not be linked: there all classes of different components meet, a block
of 4,096 per signature and round, but only pairs that parity marks leave open become rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions.scratch import removed, written
from caselens.llm import words as W
from caselens.llm.bits import bit_filter, passes

#: Classes seen by a task whose signatures are not sent again.
SEEN = 200_000
#: Common shingles that are broadcast at most (8 bytes each); they are counted in one class in ``SHARE`` and found in ``OFTEN`` of these at least.
COMMON = 1 << 20
SHARE = 8
OFTEN = 3
#: Bits of the filter for candidate documents at most (16 MB).
FILTER_BITS = 1 << 27
#: Rounds in which one class of each component in a signature meets one of the largest.
TURNS = 2
#: Classes of one signature that meet all others of it in one round, after that.
BLOCK = 4096
#: 64-bit words of a set's parity marks, and their columns.
MARKS = 8
MARK_COLUMNS = [f"mark{i}" for i in range(MARKS)]


def bands(limit: int, percent: int) -> list[tuple[int, int, int, int, int]]:
    """(greatest size, k, n1, n2, k2) of each band up to a size of ``limit``."""
    out, top = [], 0
    while top < limit:
        top = max(top + 1, top * 8 // 5)
        k = 2 * top * (100 - percent) // (100 + percent)
        if k == 0:
            out.append((top, k, 1, 1, 0))
        elif k <= 2:
            out.append((top, k, 1, 6, k))
        else:
            out.append((top, k, 2 * (k + 1), 1, 0))
    return out


def set_signatures(places: np.ndarray, codes: np.ndarray, rare: np.ndarray, table: list, percent: int) -> np.ndarray:
    """Signatures of one set: its own band and those in which a larger partner may lie.

    ``places`` deal the elements into cells, ``codes`` are summed to a cell's content, ``rare`` marks those that aren't common.
    """
    size, found = len(places), []
    tops = [b[0] for b in table]
    first, last = np.searchsorted(tops, size), np.searchsorted(tops, size * 100 // percent)
    for band in range(int(first), int(last) + 1):
        _, k, n1, n2, k2 = table[band]
        cells = n1 * n2
        cell = ((places * np.uint64(cells)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        content = W.segment_sums(codes[order], np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=cells))]))
        tag = np.uint64((band + 1) * 0x632BE59BD9B4E019 & W.MASK)
        coded = W.mix(content + np.arange(cells, dtype=np.uint64) * np.uint64(W.BASE) + tag)
        if n2 == 1:
            telling = (np.bincount(cell[rare], minlength=cells) << 32) + np.bincount(cell, minlength=cells)
            found.append(coded[np.lexsort((coded, telling))][cells - k - 1 :])
        else:
            coded = coded.reshape(n1, n2)
            for kept in combinations(range(n2), n2 - k2):
                found.append(W.mix(coded[:, list(kept)].sum(axis=1, dtype=np.uint64) + np.uint64(sum(1 << i for i in kept))))
    return np.concatenate(found)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distinct shingle hashes, offsets per row) of runs of rows."""
    data, at = W.text_bytes(batch.column("text"))
    for first, end, part, offsets in W.chunks(data, at):
        hashes, row = W.words(part, offsets)
        yield first, *W.row_sets(*W.shingles(hashes, row, end - first, width), end - first)


def _identity(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of each row's set; 0 for the empty set."""
    return W.mix(W.segment_sums(W.mix(values ^ np.uint64(0x5851F42D4C957F2D)), at) + np.diff(at).astype(np.uint64)) * (np.diff(at) > 0)


def shingle_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, cls (hash of the set; 0 if empty) per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, values, at in _sets(batch, width):
                ids = batch.column("doc_id").slice(first, len(at) - 1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at)), pa.array(_identity(values, at).view(np.int64))], ["doc_id", "n_shingles", "cls"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, cls long")


def common_shingles(docs: DataFrame, firsts: DataFrame, width: int = 5) -> np.ndarray:
    """Sorted hashes of the shingles seen most often in one of ``SHARE`` classes, ``OFTEN`` times at least; ``COMMON`` of them at most.

    Copies of one set would count as many documents: a bit filter of the classes' first documents leaves them out, but for a few.
    """
    some = firsts.where(F.pmod(F.col("cls"), F.lit(SHARE)) == 0)
    first = docs.sparkSession.sparkContext.broadcast(bit_filter(some.select(F.xxhash64("class_id").alias("key")), "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(first.value, batch.column("key").to_numpy())))
            for _, values, at in _sets(batch, width):
                keep = _identity(values, at).view(np.int64) % SHARE == 0
                yield pa.RecordBatch.from_arrays([pa.array(values[np.repeat(keep, np.diff(at))].view(np.int64))], ["item"])

    often = docs.select("text", F.xxhash64("doc_id").alias("key")).mapInArrow(run, "item long").groupBy("item").count().where(F.col("count") >= OFTEN)
    rows = often.orderBy(F.desc("count"), "item").limit(COMMON).select("item").toArrow()
    return np.sort(rows["item"].to_numpy().view(np.uint64))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def signatures(docs: DataFrame, firsts: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """sig, cls, size: the signatures of every distinct set. A task sends those of a class once."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, firsts, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        table, common = bands(2048, percent), shared.value
        for batch in batches:
            for _, values, at in _sets(batch, width):
                kinds, sizes = _identity(values, at), np.diff(at)
                if len(sizes) and table[-1][0] < sizes.max() * 2:
                    table = bands(int(sizes.max()) * 2, percent)
                places, codes = W.mix(values ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32), W.mix(values + np.uint64(0xE7037ED1A0B428DB))
                rare = ~among(values, common)
                sigs, who = [], []
                for r in np.flatnonzero(sizes).tolist():
                    if (kind := int(kinds[r])) not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(kind)
                        s = slice(at[r], at[r + 1])
                        sigs.append(set_signatures(places[s], codes[s], rare[s], table, percent))
                        who.append(r)
                if not sigs:
                    continue
                many = np.repeat(who, [len(s) for s in sigs])
                out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(kinds[many].view(np.int64)), pa.array(sizes[many].astype(np.int32))], ["sig", "cls", "size"])
                for k in range(0, out.num_rows, 50_000):
                    yield out.slice(k, 50_000)

    return docs.select("doc_id", "text").mapInArrow(run, "sig long, cls long, size int")


def shared_signatures(sigs: DataFrame) -> DataFrame:
    """sig, cls, size, rank, head, head_size: signatures of two classes or more; rank numbers a signature's classes from 0, head is
    the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int32())], ["sig", "cls", "size"])
        head: tuple[int, int, int, int] | None = None  # sig, class, size, rows of it that are out already

        def groups(table: pa.RecordBatch) -> pa.RecordBatch | None:
            nonlocal head
            sig, cls, size = (table.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(sig):
                return None
            fresh = np.ones(len(sig), bool)
            fresh[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
            sig, cls, size = sig[fresh], cls[fresh], size[fresh]
            start = np.ones(len(sig), bool)
            start[1:] = sig[1:] != sig[:-1]
            at = np.flatnonzero(start)
            count = np.diff(np.append(at, len(sig)))
            group = np.cumsum(start) - 1
            rank, heads = np.arange(len(sig)) - at[group], at[group]
            keep = count[group] > 1
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (sig, cls, size, rank.astype(np.int32), cls[heads], size[heads])], ["sig", "cls", "size", "rank", "head", "head_size"])

        for batch in batches:
            table = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()
            table = table[0] if table else rest
            sig = table.column("sig").to_numpy()
            cut = int(np.searchsorted(sig, sig[-1])) if len(sig) else 0  # the last signature may go on in the next batch
            rest = table.slice(cut)
            if (out := groups(table.slice(0, cut))) is not None and out.num_rows:
                yield out
        if (out := groups(rest)) is not None and out.num_rows:
            yield out

    return sigs.repartition("sig").sortWithinPartitions("sig", "cls").mapInArrow(run, "sig long, cls long, size int, rank int, head long, head_size int")


def parity_marks(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``MARKS`` words per set: its elements are dealt into 64 * ``MARKS`` places, a bit tells whether a place has an odd number.

    An element that only one of two sets has changes one bit, so the marks of two sets differ in no more bits than the sets in elements.
    """
    places, sets = 64 * MARKS, len(at) - 1
    place = (W.mix(values ^ np.uint64(0x8EBC6AF09C88C6E3)) % np.uint64(places)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(sets), np.diff(at)) * places + place, minlength=sets * places) & 1
    return np.packbits(odd.astype(np.uint8).reshape(sets, places), axis=1).view(np.int64).reshape(sets, MARKS)


def _near(percent: int) -> Column:
    """Whether parity marks leave it open that sets a and b are similar: they bound the symmetric difference from below."""
    apart = sum((F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in MARK_COLUMNS), F.lit(0))
    return (100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b"))


def _marked(rows: DataFrame, sets: DataFrame, key: str, kind: str) -> DataFrame:
    """Rows with the size and the parity marks of the class in column ``key``, as columns ending in ``kind``."""
    return rows.join(sets.select(F.col("cls").alias(key), F.col("n").alias(f"n_{kind}"), *[F.col(m).alias(f"{m}_{kind}") for m in MARK_COLUMNS]), key)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets are similar enough; pairs that parity marks rule out should have gone before."""
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("items").alias("items_a")), "a").join(sets.select(F.col("cls").alias("b"), F.col("items").alias("items_b")), "b")
    common = F.size(F.array_intersect("items_a", "items_b"))
    return both.where(100 * common >= percent * (F.size("items_a") + F.size("items_b") - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that is reachable, for every node of an edge (a, b).

    Rounds of neighbour minima followed by a jump to the label's label; each round is written, so the plan stays short.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("label", "least").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        step = step.join(jump, step["label"] == jump["at"], "left").select("node", F.least("label", "further").alias("label"), "was")
        step = written(step, "labels")
        removed(labels)
        labels = step.select("node", "label")
        if step.where("label <> was").isEmpty():
            removed(both)
            return labels


def similar_classes(docs: DataFrame, firsts: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """cls, label: the smallest class of its component, for each class that has a similar one.

    ``firsts`` has a document of each class (cls, class_id).
    """
    shared = written(shared_signatures(signatures(docs, firsts, width, percent)), "shared")
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    met = shared.where("rank > 0").select(F.explode(F.array("cls", "head")).alias("cls")).distinct()
    wanted = written(firsts.join(met, "cls").select("cls", F.col("class_id").alias("doc_id")), "wanted")
    sets = written(class_sets(docs, wanted, width), "sets")
    removed(wanted)

    def found(pairs: DataFrame, tried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(pairs with those tried before, the similar ones of the new)."""
        fresh = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        fresh = written(_marked(_marked(fresh, sets, "a", "a"), sets, "b", "b").where(_near(percent)).select("a", "b"), "tried")
        return fresh if tried is None else tried.union(fresh), written(_verified(fresh, sets, percent), "edges")

    stars = shared.where((F.col("rank") > 0) & fits(F.col("size"), F.col("head_size"))).groupBy(F.col("cls").alias("b"), "head").count()
    tried, edges = found(stars.groupBy("b").agg(F.max_by("head", F.struct("count", "head")).alias("a")).select("a", "b"), None)
    labels, low, turn = components(edges), 0, 0
    while True:
        named = shared.join(labels, shared["cls"] == labels["node"], "left").select("sig", "cls", "size", "rank", F.coalesce("label", "cls").alias("label"))
        open_ = named.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("rank").alias("top")).where(f"x <> y and top > {low}")
        open_ = written(open_.select("sig"), "open")
        if open_.isEmpty():
            for table in (shared, sets, open_):
                removed(table)
            return labels.select(F.col("node").alias("cls"), "label")
        named = named.join(open_, "sig")
        if turn < TURNS:
            # one class of each component in a signature against one of its largest component: a row per component
            drawn = F.struct(F.xxhash64("cls", F.lit(turn)), "cls", "size")
            ones = named.groupBy("sig", "label").agg(F.min(drawn).alias("one"), F.count(F.lit(1)).alias("n"))
            hubs = ones.groupBy("sig").agg(F.max(F.struct("n", "label", "one")).alias("hub"))
            pairs = ones.join(hubs, "sig").where((F.col("label") != F.col("hub.label")) & fits(F.col("one.size"), F.col("hub.one.size")))
            pairs = pairs.select(F.least("one.cls", "hub.one.cls").alias("a"), F.greatest("one.cls", "hub.one.cls").alias("b")).distinct()
            tried, more = found(pairs, tried)
            turn += 1
        else:
            rows = written(_marked(named, sets, "cls", "b").withColumnRenamed("cls", "b"), "members")
            block = rows.where(F.col("rank").between(low, low + BLOCK - 1))
            block = block.select("sig", F.col("b").alias("a"), F.col("size").alias("s1"), F.col("rank").alias("r1"), F.col("label").alias("l1"), *[F.col(f"{c}_b").alias(f"{c}_a") for c in ("n", *MARK_COLUMNS)])
            pairs = rows.join(block, "sig").where((F.col("rank") > F.col("r1")) & (F.col("label") != F.col("l1")) & fits(F.col("size"), F.col("s1")) & _near(percent))
            pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "tried")
            tried, more = tried.union(pairs), written(_verified(pairs, sets, percent), "edges")
            removed(rows)
            low += BLOCK
        removed(open_)
        if more.isEmpty():
            turn = TURNS
        else:
            edges = edges.union(more)
            removed(labels)
            labels = components(edges)


def class_sets(docs: DataFrame, wanted: DataFrame, width: int = 5) -> DataFrame:
    """cls, n, items and parity marks: the shingle hashes of each class in ``wanted`` (cls, doc_id: one of its documents).

    A bit filter of bounded size keeps most other documents from being shuffled; the join is what decides.
    """
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(12, (wanted.count() * 16).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    marks = wanted.groupBy((place / 64).cast("long").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) as int)))").alias("mark")).toPandas()
    mask = np.zeros(max(1, bits // 64), dtype=np.int64)
    mask[marks["word"].to_numpy(dtype=np.int64)] = marks["mark"].to_numpy(dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("place").to_numpy()
            maybe = (shared.value[at // 64] >> (at % 64)) & 1 > 0
            some = batch.filter(pa.array(maybe))
            for first_row, values, offsets in _sets(some, width):
                items = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
                ids, marks = some.column("doc_id").slice(first_row, len(offsets) - 1), parity_marks(values, offsets)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offsets)), items, *[pa.array(m.copy()) for m in marks.T]], ["doc_id", "n", "items", *MARK_COLUMNS])

    sets = docs.select("doc_id", "text", place.alias("place")).mapInArrow(run, f"doc_id long, n long, items array<long>, {', '.join(f'{m} long' for m in MARK_COLUMNS)}")
    return sets.dropDuplicates(["doc_id"]).join(wanted, "doc_id").select("cls", "n", "items", *MARK_COLUMNS)


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id per row of ``docs``.

    component_id is the smallest doc_id that is reachable by links, class_id that of the documents with the same set. A null or
    empty text has no shingles and is linked with nothing; rows with a null doc_id are dropped from linking and come out with a
    null component_id; repeated rows come out as often as they came in; other columns are not read.
    """
    base = written(shingle_sets(docs, width), "shingles")
    firsts = base.where("cls <> 0").groupBy("cls").agg(F.min("doc_id").alias("class_id"))
    labels = similar_classes(docs.where(F.col("doc_id").isNotNull()), firsts, width, percent)
    named = written(firsts.join(labels, "cls", "left").select("cls", "class_id", "label"), "classes")
    least = named.where("label is not null").groupBy("label").agg(F.min("class_id").alias("component_id"))
    named = named.join(least, "label", "left").select("cls", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    return base.join(named, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """All columns of the rows that stay: one of each component, its smallest doc_id; a doc_id that repeats stays once.

    Rows with a null doc_id stay, as they can be linked with nothing.
    """
    kept = ngram_components(docs, width, percent).where("doc_id = component_id").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi")
    # repeated ids are rare: only those rows meet in a window
    twice = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[c for c in docs.columns if c != "doc_id"]))
    double = one.join(twice, "doc_id", "left_semi").withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")
    return one.join(twice, "doc_id", "left_anti").union(double).union(docs.where("doc_id is null")).select(*docs.columns)
