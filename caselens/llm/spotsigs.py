"""Document fingerprints by SpotSigs, with DataFrame functions only.

A signature is a run of common words (the anchor) with the chain of content words that follow it. A text's fingerprint is the sorted
set of its signatures' 32-bit hashes, eight hexadecimal digits each; a text without signatures has the hash of itself, an empty text
none. The likeness of two fingerprints is their Jaccard similarity.

To find all similar pairs, sets are partitioned by length: partners of a set lie in its own partition or the next. Inside, sets meet
over the rarest signatures of each, as many as one of them must hold, and the sets are compared if their lengths still allow it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Common words of English, German, French and Spanish.
ANCHORS = (
    "the", "and", "of", "to", "a", "in", "is", "it", "that", "for", "on", "as", "with", "was", "be", "by", "are", "at", "this", "from", "or", "an", "not", "have", "which",
    "der", "die", "das", "und", "ist", "von", "zu", "den", "mit", "für", "auf", "ein", "eine", "einer", "dem", "des", "im", "nicht", "sich", "auch",
    "le", "la", "les", "de", "des", "et", "est", "un", "une", "du", "que", "qui", "dans", "pour", "sur", "par", "pas", "au", "avec", "ou",
    "el", "los", "las", "y", "en", "es", "una", "por", "con", "para", "del", "se", "no", "su", "al", "lo", "como",
)
#: Content words of a chain.
CHAIN = 2
#: Documents whose ids share this many low bits less are neighbours of one block.
BLOCK = 256
SUPER = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> Column:
    """Sorted distinct signature hashes (array<int>) of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    marked = F.transform(words, lambda w: F.concat(F.when(w.isin(*anchors), "\x01").otherwise("\x02"), w))
    # each part is a content word and the anchors behind it; the first has the anchors before any content
    parts = F.split(F.array_join(marked, ""), "\x02")

    def chains(part: Column) -> Column:
        heads = F.transform(part, lambda p: F.substring_index(p, "\x01", 1))

        def zipped(content: Column) -> Column:
            after = [F.slice(content, F.lit(k + 2), F.size(content)).alias(f"w{k}") for k in range(chain)]
            links = F.arrays_zip(part.alias("p"), *after)
            links = F.filter(links, lambda z: (F.instr(z["p"], "\x01") > 0) & z["w0"].isNotNull())
            return F.transform(links, lambda z: F.hash(F.regexp_extract(z["p"], "\x01.*", 0), *[z[f"w{k}"] for k in range(chain)]))

        return let(heads, zipped)

    found = F.array_sort(F.array_distinct(let(parts, chains)))
    return let(found, lambda f: F.when((F.size(f) == 0) & (text != ""), F.array(F.hash(text))).otherwise(f))


def printed(sigs: Column) -> Column:
    """The fingerprint: eight hexadecimal digits per signature."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 1 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return let(common, lambda c: F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(c / (F.size(a) + F.size(b) - c)))


def _with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sigs and those of the next row by descending doc_id (after the last: the first) as next_text, next_sigs.

    Rows are dealt by blocks of ids; a block ends in a copy of the first row of the next block that isn't empty, so that no order
    over all rows is needed. Of equal ids the order is that of the text's hash. Rows with a null id have no neighbours.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    rows = rows.withColumn("block", F.floor(F.col("doc_id") / BLOCK))
    heads = rows.groupBy("block").agg(F.max_by("text", F.struct("doc_id", F.xxhash64("text"))).alias("text"))
    blocks = rows.select("block").distinct().withColumn("upper", F.floor(F.col("block") / SUPER))
    tops = blocks.groupBy("upper").agg(F.max("block").alias("top"))
    line = Window.orderBy("upper")  # a row per million ids
    tops = tops.select("upper", F.coalesce(F.lag("top").over(line), F.last("top").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    follows = blocks.withColumn("lower", F.lag("block").over(Window.partitionBy("upper").orderBy("block")))
    follows = follows.join(tops, "upper").select(F.col("block").alias("at"), F.coalesce("lower", "before").alias("block"))
    ends = heads.join(follows, "block").select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("at").alias("block"))
    both = rows.withColumn("end", F.lit(0)).union(ends.select("doc_id", "text", "block", F.lit(1).alias("end")))
    both = both.withColumn("sigs", signatures(F.col("text")))
    order = Window.partitionBy("block").orderBy("end", F.desc("doc_id"), F.desc(F.xxhash64("text")))
    both = both.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sigs", F.lead("sigs").over(order)).where("end = 0")
    alone = docs.where("doc_id is null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sigs", signatures(F.col("text")))
    alone = alone.withColumn("next_text", F.lit("")).withColumn("next_sigs", F.array().cast("array<int>"))
    columns = ["doc_id", "text", "sigs", "next_text", "next_sigs"]
    return both.select(*columns).union(alone.select(*columns))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document's. Null text
    counts as empty; a single row is its own neighbour; rows with a null doc_id lose their second half; other columns are not read.
    """
    rows = _with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "sigs", "next_sigs", F.struct(edited.alias("text"), signatures(edited).alias("sigs")).alias("edited"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited.text", 256).alias("edited_sha256"), printed(F.col("sigs")).alias("fingerprint"), printed(F.col("edited.sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited.sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def similar_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """a, b (a < b), likeness: all pairs of rows (id, sigs) with that likeness or more. Empty sets and null ids are in no pair."""
    sets = prints.select("id", F.array_distinct("sigs").alias("sigs")).where((F.size("sigs") > 0) & F.col("id").isNotNull()).withColumn("n", F.size("sigs"))
    sets = sets.withColumn("part", F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold) + 1e-9))
    entries = sets.select("id", "n", "part", F.explode("sigs").alias("sig"))
    often = entries.groupBy("sig").agg(F.count(F.lit(1)).alias("often"))
    ranked = entries.join(often, "sig").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("often", "sig")))
    index = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("id", "n", "part", "sig")
    probe = index.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "sig", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    fits = (F.col("a") < F.col("id")) & (F.least("n", "n_a") >= threshold * F.greatest("n", "n_a") - 1e-9)
    pairs = probe.join(index, ["part", "sig"]).where(fits).select("a", F.col("id").alias("b")).distinct()
    left, right = sets.select(F.col("id").alias("a"), F.col("sigs").alias("sigs_a")), sets.select(F.col("id").alias("b"), F.col("sigs").alias("sigs_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("sigs_a"), F.col("sigs_b")).alias("likeness")).where(F.col("likeness") >= threshold - 1e-9)
