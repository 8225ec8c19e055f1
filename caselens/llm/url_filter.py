"""URL filters: rules, and link-graph propagation for what no rule fits.

Rules (host, path prefix) fit a host and its subdomains; the longest one decides. A host of whose pages rules allow half or more is
a trusted seed, one of whose pages they block half or more a distrusted one, each by its number of such pages. Trust flows as a personalised PageRank along host edges; distrust
flows the same way along reversed edges, to those that link to bad hosts. Host edges are the links of pages to other hosts, and each
host with its parent domain, either way. A host is blocked where its distrust exceeds its trust and a share of the mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.scratch import written

# The rules of the standard query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
ROUNDS = 12
#: Rounds whose plan is cut by a written table.
CUT = 4
#: A blocked host has at least this much of the mean distrust.
SHARE = 0.1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]+)"""


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    rest = F.coalesce(_rest(url), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.coalesce(_rest(url), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; of equally long ones the first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: links between different hosts (weight: pages that hold one), and 1 for a host and its parent, either way."""
    linked = pages.where(F.contains(F.col("html"), F.lit("//")) & (F.col("host") != "")).select("page_id", "host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("link"))
    links = linked.select(F.col("host").alias("src"), F.translate(F.regexp_extract("link", r"//([^/?#]*)", 1), UPPER, LOWER).alias("dst")).where("dst <> '' and src <> dst")
    links = links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    names = pages.select("host").where("host <> ''").distinct().union(links.select("dst")).distinct()
    parent = names.select("host", F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("parent")).where("parent <> ''")
    # each level of a deep name in turn
    levels = names.select(F.split("host", r"\.").alias("p")).where(F.size("p") > 2)
    levels = levels.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 2), lambda k: F.struct(F.array_join(F.slice("p", k, F.size("p")), ".").alias("host"), F.array_join(F.slice("p", k + 1, F.size("p")), ".").alias("parent")))).alias("x"))
    family = levels.select("x.host", "x.parent").union(parent).distinct()
    family = family.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("parent").alias("dst")), F.struct(F.col("parent").alias("src"), F.col("host").alias("dst")))).alias("e")).select("e.src", "e.dst", F.lit(1.0).alias("weight"))
    return links.union(family).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, score after ``rounds`` steps from seeds (host, weight), whose weights are brought to a sum of 1.

    Each step: score = (1 - damping) * seed + damping * what comes in over edges, dealt by their weights. Hosts with no way out keep
    nothing.
    """
    total = seeds.agg(F.sum("weight")).first()[0] or 0.0
    start = seeds.groupBy("host").agg((F.sum("weight") / (total or 1.0)).alias("seed"))
    outgoing = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    share = written(edges.join(outgoing, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")), "edges")
    start = written(start, "seeds")
    score = start.select("host", F.col("seed").alias("score"))
    for k in range(rounds):
        come = share.join(score, share["src"] == score["host"]).select(F.col("dst").alias("host"), (F.col("share") * F.col("score") * damping).alias("score"))
        score = come.union(start.select("host", (F.col("seed") * (1 - damping)).alias("score"))).groupBy("host").agg(F.sum("score").alias("score"))
        if k % CUT == CUT - 1:
            score = written(score, "scores")
    return score


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust per row.

    A null url or one without ``://`` has an empty host and path; such pages, and hosts that nothing reaches, are allowed unless a
    rule fits. Null html has no links; repeated rows count as often as they come; other columns are not read.
    """
    named = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = named.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    edges = written(host_edges(named), "host_edges")
    ruled = named.where("host <> ''").groupBy("host").agg(*(F.count_if(F.col("fit.verdict") == v).cast("double").alias(v) for v in ("allow", "block")), F.count(F.lit(1)).alias("pages"))
    ruled = written(ruled, "ruled")
    trust = personalised_rank(edges, ruled.where("2 * allow >= pages").select("host", F.col("allow").alias("weight")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = personalised_rank(back, ruled.where("2 * block >= pages").select("host", F.col("block").alias("weight")))
    hosts = edges.select("src").union(edges.select("dst")).union(ruled.select("host")).distinct().count()
    both = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") * max(hosts, 1) >= SHARE)
    both = written(both.withColumn("method", F.when(bad, "block").otherwise("allow")), "verdicts")
    out = named.drop("html").join(both, "host", "left")
    zero = F.lit(0.0)
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "method", F.lit("allow")).alias("verdict"), F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"))
