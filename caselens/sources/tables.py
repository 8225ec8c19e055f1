"""Reading and writing case tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.functions.text import squash
from caselens.sources.store import BUCKETS, Store

PAGE_SCHEMA = T.StructType([
    T.StructField("case_id", T.StringType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("native_text", T.StringType()),
    T.StructField("ocr_text", T.StringType()),
    T.StructField("image_count", T.IntegerType()),
    T.StructField("ocr_engine", T.StringType()),
    T.StructField("ocr_engine_version", T.StringType()),
    T.StructField("ocr_device", T.StringType()),
    T.StructField("ocr_cache_hit", T.BooleanType()),
    T.StructField("ocr_fallback_used", T.BooleanType()),
])
# Order in which a stored case may be reused.
REUSE_ORDER = {"concluido": 0, "processando": 1, "pendente": 2}


def read_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """One row per case page."""
    return spark.read.schema(PAGE_SCHEMA).format(format).load(path)


def strip_markup(df: DataFrame, cols: list[str], out: str = "text") -> DataFrame:
    """Fields joined by newlines, tags replaced by a space."""
    joined = F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return df.withColumn(out, F.regexp_replace(joined, "<[^>]+>", " "))


def merge_cases(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace the old rows of the same keys (case, or case and topic for results)."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_cases(spark: SparkSession, new: DataFrame, path: str, keys: list[str] | None = None,
                  buckets: int = BUCKETS) -> None:
    """S05 on a stored table: only the buckets touched by ``new`` are written, beside the old ones; readers switch at once.

    A bucket is a directory, not a task: a large case is written by as many tasks as hold its rows.
    Writing the same rows again gives the same table.
    """
    keys = keys or ["case_id"]
    Store(spark, path, buckets).commit({"rows": (new, new)}, keys)


def stored_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """What ``replace_cases`` has stored; None if nothing was."""
    return Store(spark, path).read("rows")


def invalidate(derived: DataFrame, replaced_cases: DataFrame) -> DataFrame:
    """Drop results derived from the former text of re-ingested cases."""
    return derived.join(replaced_cases.select("case_id").distinct(), "case_id", "left_anti")


def stale_cases(cases: DataFrame, results: DataFrame, schema_version: int, catalog_version: str,
                keys: list[str] | None = None) -> DataFrame:
    """Work list of cases without a result of the current versions."""
    keys = keys or ["case_id"]
    current = results.where((F.col("schema_version") == schema_version) & (F.col("catalog_version") == catalog_version))
    return cases.join(current.select(*keys).distinct(), keys, "left_anti")


def dedupe_ingest(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Which stored case answers for an uploaded file.

    ``new``: case_id, sha256, seq; ``existing``: case_id, sha256, status, updated_at. Copies are reduced to one
    winner per hash by a partial aggregate before they meet the new rows.
    """
    order = F.create_map(*[F.lit(x) for pair in REUSE_ORDER.items() for x in pair])
    stored = existing.where(F.col("status").isin(*REUSE_ORDER)).groupBy("sha256").agg(
        F.min_by("case_id", F.struct(order[F.col("status")].alias("o"),
                                     (-F.unix_micros("updated_at")).alias("t"), "case_id")).alias("_stored"))
    first = new.groupBy("sha256").agg(F.min_by("case_id", "seq").alias("_first"))
    answer = first.join(stored, "sha256", "left").select("sha256", F.coalesce("_stored", "_first").alias("answer_id"))
    return new.join(answer, "sha256").withColumn("reused", F.col("answer_id") != F.col("case_id"))


def _digest_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by case and page; one running hash is all the state."""
    case, digest = None, None
    for pdf in batches:
        done = []
        for case_id, text in zip(pdf["case_id"], pdf["text"]):
            if case_id != case:
                if digest is not None:
                    done.append((case, digest.hexdigest()))
                case, digest = case_id, hashlib.sha256()
            else:
                digest.update(b"\n\f\n")
            digest.update(text.encode("utf-8"))
        if done:
            yield pd.DataFrame(done, columns=["case_id", "text_sha256"])
    if digest is not None:
        yield pd.DataFrame([(case, digest.hexdigest())], columns=["case_id", "text_sha256"])


def text_sha256(pages: DataFrame) -> DataFrame:
    """Fingerprint of the blank-collapsed pages joined by newline, form feed, newline.

    SHA-256 of a text is sequential by definition, so a case is read in page order by one task; the text is
    streamed through the hash in batches and never gathered in one row.
    """
    text = pages.select("case_id", "page_number", squash(F.coalesce("text", F.lit(""))).alias("text"))
    ordered = text.repartition("case_id").sortWithinPartitions("case_id", "page_number")
    return ordered.select("case_id", "text").mapInPandas(_digest_partition, "case_id string, text_sha256 string")


def verify_fingerprints(cases: DataFrame, manifest: DataFrame) -> DataFrame:
    """The text hash decides when the manifest holds one, else the binary hash."""
    has_text = F.coalesce(F.col("want_text_sha256"), F.lit("")) != ""
    verdict = (
        F.when(F.col("text_sha256").isNull() & F.col("sha256").isNull(), "ausente")
        .when(has_text, F.when(F.col("want_text_sha256") == F.col("text_sha256"), "ok").otherwise("texto_divergente"))
        .when(F.col("want_sha256").isNull() | (F.col("want_sha256") == F.col("sha256")), "ok")
        .otherwise("binario_divergente")
    )
    return manifest.join(cases, "case_id", "left").withColumn("fingerprint", verdict)


def write_report(df: DataFrame, path: str) -> None:
    """S12."""
    df.write.mode("overwrite").json(path)
