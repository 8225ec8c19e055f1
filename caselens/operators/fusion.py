"""Rank fusion and the making of a source list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions.numbering import first_per_key, top_per_key
from caselens.functions.scratch import written
from caselens.functions.text import fold, strip, words
from caselens.operators.lexical import CHUNK_KEY, bm25_search, needs_lexical_priority
from caselens.operators.vectors import hash_search

RANK_OFFSET = 60
EXCERPT_CHARS = 700
BUDGET_CHARS = 10_000
ITEM = ["page_number", "chunk_index"]


def unique_queries(queries: DataFrame, keys: list[str]) -> DataFrame:
    """columns question, weight, pos; the order of first appearance is kept."""
    kept = queries.withColumn("question", strip("question")).where((F.length("question") > 0) & (F.col("weight") > 0))
    return kept.groupBy(*keys, "question").agg(F.max("weight").alias("weight"), F.min("pos").alias("pos"))


def rrf(hits: DataFrame, keys: list[str], k: int, total_weight: DataFrame | None = None) -> DataFrame:
    """fuse ranked lists.

    ``hits``: keys, list_no, weight, page_number, chunk_index, rank. The divisor is the best possible score of the
    lists that hold anything, or of ``total_weight`` (keys, total) when given. Ties keep the order in which the
    items were first seen: list, then rank.
    """
    if total_weight is None:
        total_weight = (
            hits.where(F.col("rank") == 1).groupBy(*keys, "list_no").agg(F.max("weight").alias("weight"))
            .groupBy(*keys).agg(F.sum("weight").alias("total"))
        )
    fused = hits.groupBy(*keys, *ITEM).agg(
        F.round(F.sum(F.col("weight") / (RANK_OFFSET + F.col("rank"))), 12).alias("fused"),
        F.min(F.struct("list_no", "rank")).alias("seen"))
    ranked = top_per_key(fused, keys, [F.desc("fused"), F.col("seen")], k)
    return (
        ranked.join(total_weight, keys)
        .withColumn("score", F.round(F.col("fused") * (RANK_OFFSET + 1) / F.col("total"), 4))
        .drop("seen", "total", "fused")
    )


def hybrid(semantic: DataFrame, lexical: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """F03 and F04. Both sides carry query_id, case_id, page_number, chunk_index, rank, score, cut at 2k.

    One empty side passes the other through with its own scores; a question that asks for an exact fact
    gets the first lexical hit on rank 1.
    """
    keys = ["query_id", "case_id"]
    cols = [*keys, *ITEM, "rank", "score"]
    both = (
        semantic.select(*cols).withColumn("list_no", F.lit(0))
        .unionByName(lexical.select(*cols).withColumn("list_no", F.lit(1)))
        .withColumn("weight", F.lit(1.0))
    )
    # Everything below works on at most 4k rows per question.
    sides = both.groupBy(*keys).agg(F.count_distinct("list_no").alias("sides"))
    fused = rrf(both, keys, k).join(sides, keys)
    alone = both.join(sides.where("sides = 1"), keys).where(F.col("rank") <= k)
    out = fused.where("sides = 2").select(*cols).unionByName(alone.select(*cols))
    wanted = queries.where(needs_lexical_priority(F.col("question"))).select(*keys)
    first = (
        lexical.where(F.col("rank") == 1).join(wanted, keys, "left_semi")
        .join(sides.where("sides = 2"), keys, "left_semi").select(*cols)
    )
    marked = out.withColumn("_lead", F.lit(1)).unionByName(first.withColumn("_lead", F.lit(0)))
    # The preferred hit brings its own score and displaces its fused copy.
    single = first_per_key(marked, [*keys, *ITEM], [F.col("_lead")])
    return top_per_key(single.withColumnRenamed("rank", "_rank"), keys, [F.col("_lead"), F.col("_rank")], k).drop(
        "_lead", "_rank")


def hybrid_search(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """F03 on chunks with the hash embedding as the semantic side."""
    semantic = written(hash_search(chunks, queries, 2 * k), "semantic")
    lexical = written(bm25_search(chunks, queries, 2 * k), "lexical")
    return hybrid(semantic, lexical, queries, k)


def fuse_queries(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """F05 on given per-query hits (each list already cut at 2k).

    ``queries``: question_id, case_id, query_id, pos, question, weight; ``hits``: query_id, case_id, item, rank, score.
    """
    keys = ["question_id", "case_id"]
    counts = queries.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total"))
    named = hits.join(queries.select(*keys, "query_id", "pos", "weight", "question"), ["case_id", "query_id"]).join(
        counts, keys)
    cols = [*keys, *ITEM, "rank", "score"]
    single = named.where((F.col("n") == 1) & (F.col("rank") <= k)).select(*cols)
    many = named.where("n > 1").withColumn("list_no", F.col("pos"))
    fused = rrf(many, keys, k, counts.where("n > 1").select(*keys, "total"))
    # The last enriched query that asks for an exact fact forces its top hit into the list.
    first_pos = queries.groupBy(*keys).agg(F.min("pos").alias("first_pos"))
    forced = many.join(first_pos, keys).where(
        (F.col("rank") == 1) & (F.col("pos") > F.col("first_pos")) & needs_lexical_priority(F.col("question")))
    forced = first_per_key(forced, keys, [F.desc("pos")]).select(*keys, *ITEM, F.col("score").alias("_own"))
    absent = forced.join(fused.select(*keys, *ITEM), [*keys, *ITEM], "left_anti")
    replaced = absent.select(*keys, F.lit(True).alias("_full"))
    kept = fused.join(replaced, keys, "left").where(F.col("_full").isNull() | (F.col("rank") < k)).select(*cols)
    size = kept.groupBy(*keys).agg(F.max("rank").alias("_n"))
    added = absent.join(size, keys).select(*keys, *ITEM, (F.col("_n") + 1).alias("rank"), F.col("_own").alias("score"))
    return single.unionByName(kept).unionByName(added)


def multi_query_search(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """all queries of all questions in one job. A lone query is answered at k, several at 2k each."""
    keys = ["question_id", "case_id"]
    counts = queries.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    lone = queries.join(counts.where("n = 1"), keys, "left_semi")
    several = queries.join(counts.where("n > 1"), keys, "left_semi")
    # One search for all: a shorter list is the head of a longer one.
    semantic = written(hash_search(chunks, queries, 4 * k), "semantic")
    lexical = written(bm25_search(chunks, queries, 4 * k), "lexical")

    def part(asked: DataFrame, size: int) -> DataFrame:
        ids = asked.select("query_id", "case_id")
        cut = lambda side: side.where(F.col("rank") <= 2 * size).join(ids, ["query_id", "case_id"], "left_semi")
        return hybrid(cut(semantic), cut(lexical), asked, size)

    hits = written(part(lone, k).unionByName(part(several, 2 * k)), "hits")
    return fuse_queries(hits, queries, k)


def multi_query_lexical(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """F06."""
    keys = ["question_id", "case_id"]
    hits = bm25_search(chunks, queries, 2 * k).join(
        queries.select(*keys, "query_id", "weight", F.col("pos").alias("list_no")), ["case_id", "query_id"])
    return rrf(hits, keys, k)


def diverse_sources(anchors: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """anchors first, then one hit of each query list in turn; the first occurrence of a chunk counts.

    ``anchors``: case_id, item, rank; ``lists``: case_id, query_no, item, rank.
    """
    anchor_limit = min(k, max(4, -(-5 * k // 6)))
    head = anchors.where(F.col("rank") <= anchor_limit).select(
        *CHUNK_KEY, F.struct(F.lit(0).alias("g"), F.col("rank").cast("int").alias("r"), F.lit(0).alias("q")).alias("o"))
    tail = lists.select(
        *CHUNK_KEY, F.struct(F.lit(1).alias("g"), F.col("rank").cast("int").alias("r"),
                             F.col("query_no").cast("int").alias("q")).alias("o"))
    seen = head.unionByName(tail).groupBy(*CHUNK_KEY).agg(F.min("o").alias("o"))
    return top_per_key(seen, ["case_id"], [F.col("o")], k).drop("o")


def list_limit(k: int, n_queries: int) -> int:
    """Hits asked of each query before mixing."""
    return max(4, min(k, -(-k // n_queries) * 2))


def _phrases(question: Column) -> Column:
    """Phrases of two to four words, and single words of at least seven letters."""
    w = words(fold(question))
    empty = F.array().cast("array<string>")

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - n + 1)
        found = F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(F.size(w) >= n, found).otherwise(empty)

    return F.concat(runs(2), runs(3), runs(4), F.filter(w, lambda x: F.length(x) >= 7))


def _excerpt(text: Column, centre: Column, limit: Column) -> Column:
    size = F.length(text)
    stop = F.least(size, F.greatest(F.lit(0), centre - F.floor(limit / 3)) + limit)
    start = F.greatest(F.lit(0), stop - limit)
    return F.when(size <= limit, text).otherwise(
        strip(F.substring(text, (start + 1).cast("int"), (stop - start).cast("int"))))


def budget_excerpts(hits: DataFrame, queries: DataFrame, each: int = EXCERPT_CHARS, total: int = BUDGET_CHARS) -> DataFrame:
    """``hits``: query_id, case_id, page_number, chunk_index, rank, text; ``queries``: query_id, question.

    The excerpt is centred on the best phrase found: most words, most characters, earliest position. What a hit
    may use depends on the excerpts before it, so the ranked hits of one question (at most its top k) are folded.
    """
    keys = ["query_id", "case_id"]
    phrases = queries.select("query_id", F.array_distinct(_phrases(F.col("question"))).alias("_phrases"))
    found = F.filter(F.transform("_phrases", lambda p: F.struct(
        F.size(F.split(p, " ")).alias("n"), F.length(p).alias("size"),
        (-F.position(p, F.col("_folded"))).alias("at"))), lambda s: s["at"] < 0)
    centred = hits.join(phrases, "query_id").withColumn("_folded", fold("text")).withColumn(
        "centre", F.coalesce(-F.array_max(found)["at"] - 1, F.lit(0)))
    item = F.struct(F.col("rank").cast("int").alias("rank"), *ITEM, "centre", "text")
    ranked = centred.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_hits"))
    zero = F.expr("named_struct('used', 0, 'cut', cast(array() as array<string>))")

    def take(acc: Column, hit: Column) -> Column:
        limit = F.least(F.lit(each), F.lit(total) - acc["used"])
        text = F.when(limit > 0, _excerpt(hit["text"], hit["centre"], limit))
        return F.struct((acc["used"] + F.coalesce(F.length(text), F.lit(0))).alias("used"),
                        F.concat(acc["cut"], F.array(text)).alias("cut"))

    cut = F.aggregate("_hits", zero, take, lambda acc: acc["cut"])
    return (
        ranked.select(*keys, F.explode(F.arrays_zip(F.col("_hits").alias("h"), cut.alias("excerpt"))).alias("z"))
        .select(*keys, "z.h.rank", "z.h.page_number", "z.h.chunk_index", "z.excerpt")
        .where(F.col("excerpt").isNotNull())
    )
