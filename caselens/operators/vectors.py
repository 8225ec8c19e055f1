"""Vector retrieval: hash embedding, exact cosine, model ensembles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.matching import pinned
from caselens.functions.numbering import top_per_key
from caselens.functions.scratch import written
from caselens.functions.text import ascii_tokens

HASH_DIMS = 384
CHUNK_KEY = ["case_id", "page_number", "chunk_index"]


def hash_slots(text: Column, dims: int = HASH_DIMS) -> Column:
    """Vector index of every token, repeats kept."""
    if dims <= 0:
        raise ValueError("dims must be positive")
    head = lambda t: F.conv(F.substring(F.sha2(t, 256), 1, 8), 16, 10).cast("bigint")
    return F.transform(ascii_tokens(text), lambda t: F.pmod(head(t), F.lit(dims)).cast("int"))


def slots_norm(slots: Column) -> Column:
    """Length of the count vector, from the run lengths of the sorted indexes: n^2 = sum of 2i-1."""
    zero = F.struct(F.lit(-1).alias("at"), F.lit(0).cast("bigint").alias("run"), F.lit(0).cast("bigint").alias("sq"))

    def step(acc: Column, slot: Column) -> Column:
        run = F.when(acc["at"] == slot, acc["run"] + 1).otherwise(F.lit(1).cast("bigint"))
        return F.struct(slot.alias("at"), run.alias("run"), (acc["sq"] + 2 * run - 1).alias("sq"))

    return F.sqrt(F.aggregate(F.sort_array(slots), zero, step, lambda acc: acc["sq"].cast("double")))


def vector_id() -> Column:
    """V07."""
    return F.format_string("%s-p%04d-c%04d", F.col("case_id"), F.col("page_number"), F.col("chunk_index"))


def hash_embed(df: DataFrame, dims: int = HASH_DIMS, text: str = "text") -> DataFrame:
    """Token indexes and norm on the row itself; the vector is count(index) / norm."""
    return pinned(df, "slots", hash_slots(F.col(text), dims)).withColumn("norm", slots_norm(F.col("slots")))


def hash_weights(embedded: DataFrame, keys: list[str]) -> DataFrame:
    """V01 in sparse rows: one (index, weight) per non-zero dimension."""
    rows = embedded.select(*keys, "norm", F.explode("slots").alias("idx"))
    return rows.groupBy(*keys, "norm", "idx").agg(F.count(F.lit(1)).alias("n")).select(
        *keys, "idx", (F.col("n") / F.col("norm")).alias("weight"))


def l2_normalize(df: DataFrame, vec: str = "vec", dims: int | None = None) -> DataFrame:
    """Zero vectors stay; a vector of another size is an error."""
    values = F.col(vec).cast("array<double>")
    if dims is not None:
        values = F.when(F.size(values) == dims, values).otherwise(
            F.raise_error(F.concat(F.lit("unexpected vector size "), F.size(values).cast("string"))))
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x))
    return df.withColumn(vec, values).withColumn("_norm", norm).withColumn(
        vec, F.when(F.col("_norm") == 0, F.col(vec)).otherwise(F.transform(vec, lambda x: x / F.col("_norm")))
    ).drop("_norm")


def _clip(similarity: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity))


def _best(scored: DataFrame, k: int, keys: list[str]) -> DataFrame:
    return top_per_key(scored, keys, [F.desc("score"), F.col("page_number"), F.col("chunk_index")], k)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact cosine. ``vectors`` and ``queries`` hold unit vectors; both carry case_id and model.

    The join is on the case of the question; Spark picks broadcast from the measured size of the question
    side and splits a large case otherwise. Each input partition is cut to k rows per question before the shuffle.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    asked = queries.select("query_id", "case_id", "model", F.col("vec").alias("_q"))
    dot = F.aggregate(F.zip_with("vec", "_q", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    scored = vectors.join(asked, ["case_id", "model"]).select(
        "query_id", "model", *CHUNK_KEY, F.round(_clip(dot), 6).alias("score"))
    return _best(scored, k, ["query_id", "case_id", "model"])


def hash_search(chunks: DataFrame, queries: DataFrame, k: int, dims: int = HASH_DIMS) -> DataFrame:
    """V01 + V03 without vectors: only the slots that a question of the case uses meet its weights, on (case, slot).

    A chunk that shares no slot with a question scores 0. Such chunks only fill up lists with fewer than k others, in
    page order, so the first 2k chunks of a case are enough of them.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    embedded = hash_embed(queries, dims, "question").where(F.col("norm") > 0)
    asked = hash_weights(embedded, ["query_id", "case_id"])
    # Every token of a chunk adds the question's weight of its slot, so slots need not be counted first.
    held = hash_embed(chunks, dims).select(*CHUNK_KEY, "norm", F.explode("slots").alias("idx"))
    met = held.join(asked, ["case_id", "idx"]).groupBy("query_id", *CHUNK_KEY, "norm").agg(F.sum("weight").alias("_dot"))
    scored = met.select("query_id", *CHUNK_KEY, F.round(_clip(F.col("_dot") / F.col("norm")), 6).alias("score"))
    best = written(_best(scored, k, ["query_id", "case_id"]).drop("rank"), "best")
    full = best.groupBy("query_id", "case_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k)
    short = embedded.select("query_id", "case_id").join(full, ["query_id", "case_id"], "left_anti")
    head = chunks.join(short.select("case_id").distinct(), "case_id", "left_semi").select(*CHUNK_KEY)
    head = top_per_key(head, ["case_id"], [F.col("page_number"), F.col("chunk_index")], 2 * k).drop("rank")
    rest = head.join(short, "case_id").join(best, ["query_id", *CHUNK_KEY], "left_anti").select("query_id", *CHUNK_KEY, F.lit(0.0).alias("score"))
    return _best(best.unionByName(rest), k, ["query_id", "case_id"])


def _vote(hits: DataFrame, keys: list[str], per_model: int, best_of: Column) -> DataFrame:
    item = 0.5 * F.col("score") + 0.5 / F.col("rank")
    return hits.where(F.col("rank") <= per_model).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("votes"), F.round(F.sum(item), 9).alias("score_sum"),
        F.max(best_of).alias("best"), F.min(F.struct("model", "rank")).alias("_seen"))


def ensemble_search(hits: DataFrame, models: int, k: int) -> DataFrame:
    """``hits`` carries query_id, case_id, page_number, chunk_index, model, rank, score."""
    keys = ["query_id", *CHUNK_KEY]
    item = 0.5 * F.col("score") + 0.5 / F.col("rank")
    voted = _vote(hits, keys, max(2 * k, 5), item)
    ranked = top_per_key(voted, ["query_id", "case_id"],
                         [F.desc("votes"), F.desc("score_sum"), F.desc("best"), F.col("_seen")], k)
    final = 0.65 * F.col("score_sum") / F.col("votes") + 0.35 * F.col("votes") / models
    return ranked.withColumn("score", F.round(final, 4)).drop("_seen", "best")


def ensemble_docs(hits: DataFrame, k: int) -> DataFrame:
    """Same vote over whole documents; the last tie-break is the best rank score alone."""
    voted = _vote(hits, ["query_id", "doc_id"], max(2 * k, 10), 1.0 / F.col("rank"))
    return top_per_key(voted, ["query_id"],
                       [F.desc("votes"), F.desc("score_sum"), F.desc("best"), F.col("_seen")], k).drop("_seen")


def stale_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cases whose vector count differs from their chunk count."""
    stored = vectors.groupBy("case_id").agg(F.count(F.lit(1)).alias("vector_count"))
    wanted = chunks.groupBy("case_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    both = stored.join(wanted, "case_id", "full_outer").na.fill(0, ["vector_count", "chunk_count"])
    return both.where(F.col("vector_count") != F.col("chunk_count"))


def union_models(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
