"""Mixing sources to target weights: temperature mixing with budgeted block permutations.

A source with a share q of all tokens gets the weight q^a / sum of q^a. The exponent a is bisected: the greatest one whose weights
reach the target entropy, raised again where a source would be repeated too often. A source's budget is its weight of the token
budget: some whole passes over it and part of another. Its documents are dealt into a fixed number of blocks; every pass has the
blocks in an order of its own, and the last pass takes blocks from the front as long as they fit the budget. So no document is cut,
and a source gets its budget but for less than a block and its rounding.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks a source is dealt into.
BLOCKS = 1024
#: Sources at most: their totals come to the driver.
SOURCES = 200_000
#: Rows of the table of blocks that are broadcast at most.
BROADCAST_ROWS = 100_000


def weights(shares: np.ndarray, exponent: float) -> np.ndarray:
    """Normalised q^exponent; sources without tokens get none."""
    some = shares > 0
    out = np.zeros(len(shares))
    logs = exponent * np.log(shares[some])
    out[some] = np.exp(logs - logs.max()) if some.any() else 0
    return out / out.sum() if out.sum() else out


def entropy(w: np.ndarray) -> float:
    w = w[w > 0]
    return float(-(w * np.log(w)).sum())


def find_exponent(tokens: np.ndarray, budget: float, target: float, most: float) -> float:
    """Exponent in [0, 1]: entropy of ``target`` times its maximum, unless that repeats a source more than ``most`` times.

    If even shares as they are (1) repeat more, 1 is the answer. Entropy falls and the greatest repetition falls as it grows.
    """
    some = tokens[tokens > 0]
    if len(some) < 2:
        return 1.0
    q = some / some.sum()
    spread = lambda a: entropy(weights(q, a)) >= target * math.log(len(q))
    repeated = lambda a: float((budget * weights(q, a) / some).max()) > most
    a = 1.0
    if not spread(1.0):
        low, high = 0.0, 1.0  # reaches it; does not
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if spread(mid) else (low, mid)
        a = low
    if repeated(a):
        low, high = a, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if repeated(mid) else (low, mid)
        a = high
    return a


def n_tokens(text: str) -> Column:
    """Words of a text, as runs of other than blanks; 0 for null."""
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def _unit(*parts: Column | str | int) -> Column:
    """Number in [0, 1) from the hash of the parts."""
    return F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(1 << 40)) / float(1 << 40)


def mix(docs: DataFrame, budget: float | None = None, target: float = 0.9, most: float = 4.0, seed: int = 0, blocks: int = BLOCKS) -> DataFrame:
    """The columns of ``docs`` with mix_tokens, mix_weight, mix_pass, mix_block, mix_order: a row per document and pass that takes it.

    ``budget`` is in tokens (default: all that there are). mix_order in [0, 1) is the place in the mixture: passes and blocks of a
    source are spread evenly, blocks keep together. A null source is a source of its own; texts without words cost no tokens and go
    with their block. Columns of ``docs`` named mix_... are replaced. Repeated rows share a block and an order.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    rows = docs.withColumn("mix_tokens", n_tokens("text")).withColumn("mix_block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(blocks)).cast("int"))
    totals = rows.groupBy("source", "mix_block").agg(F.sum("mix_tokens").alias("tokens"))
    per_source = totals.groupBy("source").agg(F.sum("tokens").alias("tokens")).orderBy("source").limit(SOURCES + 1).collect()
    if len(per_source) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    tokens = np.array([r["tokens"] for r in per_source], dtype=float)
    budget = float(tokens.sum()) if budget is None else float(budget)
    w = weights(tokens / max(tokens.sum(), 1.0), find_exponent(tokens, budget, target, most))
    plan = [(r["source"], float(x), int(budget * x // t) if t else 0, float(budget * x % t) if t else 0.0) for r, x, t in zip(per_source, w, tokens, strict=True)]
    named = docs.sparkSession.createDataFrame(plan, "source string, mix_weight double, whole int, rest double")
    named = named.withColumn("source", F.col("source").cast(docs.schema["source"].dataType))
    # the last pass: blocks in its own order, as long as their running sum fits
    part = totals.join(named, totals["source"].eqNullSafe(named["source"])).drop(named["source"])
    order = Window.partitionBy("source").orderBy(_unit(F.lit(seed), F.lit("pass"), F.col("whole"), F.col("mix_block")), "mix_block").rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("passes", F.col("whole") + (F.sum("tokens").over(order) <= F.col("rest")).cast("int"))
    part = part.select(F.col("source").alias("__source"), F.col("mix_block").alias("__block"), "mix_weight", "passes").where("passes > 0")
    part = F.broadcast(part) if len(per_source) * blocks <= BROADCAST_ROWS else part
    out = rows.join(part, rows["source"].eqNullSafe(part["__source"]) & (rows["mix_block"] == part["__block"]))
    out = out.withColumn("mix_pass", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    at = _unit(F.lit(seed), F.lit("pass"), F.col("mix_pass") - 1, F.col("mix_block"))
    within = _unit(F.lit(seed), F.col("mix_pass"), F.col("doc_id")) / blocks
    out = out.withColumn("mix_order", (F.col("mix_pass") - 1 + at * (1 - 1 / blocks) + within) / F.col("passes"))
    return out.select(*docs.columns, "mix_tokens", "mix_weight", "mix_pass", "mix_block", "mix_order")
