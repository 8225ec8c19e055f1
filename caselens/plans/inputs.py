"""The driver tables seen as case files, in Spark and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions.numbering import number_rows
from caselens.operators.chunks import chunk_pages
from caselens.operators.quality import grade_pages


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where a table comes in fewer pieces than there are cores; a large table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in ("documents", "orders") else df


def raw_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One document is one page of the case named by its source."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    fifth = F.col("doc_id") % 5 == 0
    return number_rows(docs, ["source"], "doc_id", "page_number").select(
        F.col("source").alias("case_id"), "page_number", "doc_id",
        F.col("text").alias("native_text"),
        F.when(fifth, F.col("text")).otherwise("").alias("ocr_text"),
        (F.col("doc_id") % 3).cast("int").alias("image_count"),
        F.when(fifth, "easyocr").alias("ocr_engine"),
        F.when(fifth, "1.7").alias("ocr_engine_version"),
        F.when(fifth, "cpu").alias("ocr_device"),
        (F.col("doc_id") % 10 == 0).alias("ocr_cache_hit"),
        (F.col("doc_id") % 15 == 0).alias("ocr_fallback_used"),
    )


def graded_pages(spark: SparkSession, sf: str) -> DataFrame:
    return grade_pages(raw_pages(spark, sf))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_pages(graded_pages(spark, sf))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark passage is a question to one case; even ones ask for an exact fact."""
    tail = F.when(F.col("item_id") % 2 == 0, " resultado").otherwise("")
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("case_id"),
        F.concat("text", tail).alias("question"),
    )


def weighted_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Each question with an enriched second query; every third question stands alone."""
    base = questions(spark, sf)
    nexts = table(spark, sf, "benchmark").select((F.col("item_id") - 1).alias("query_id"), F.col("text").alias("more"))
    first = base.select(F.col("query_id").alias("question_id"), "case_id", (F.col("query_id") * 2).alias("query_id"),
                        F.lit(0).alias("pos"), "question", F.lit(1.0).alias("weight"))
    second = base.join(nexts, "query_id").where("query_id % 3 <> 0").select(
        F.col("query_id").alias("question_id"), "case_id", (F.col("query_id") * 2 + 1).alias("query_id"),
        F.lit(1).alias("pos"), F.concat("more", F.lit(" prazo")).alias("question"), F.lit(0.35).alias("weight"))
    return first.unionByName(second)


RAW_PAGES = """
raw_pages AS (
  SELECT source AS case_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number, doc_id,
    text AS native_text, CASE WHEN doc_id % 5 = 0 THEN text ELSE '' END AS ocr_text, doc_id % 3 AS image_count,
    CASE WHEN doc_id % 5 = 0 THEN 'easyocr' END AS ocr_engine, doc_id % 10 = 0 AS ocr_cache_hit,
    doc_id % 15 = 0 AS ocr_fallback_used
  FROM documents)"""

NORMALIZED = """
normalized AS (
  SELECT * REPLACE (array_to_string(list_filter(list_transform(
      string_split(replace(native_text, chr(13), chr(10)), chr(10)),
      lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS native_text)
  FROM raw_pages)"""

# Number of blank-separated words, and words of at least n characters.
def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"


def glued_sql(c: str) -> str:
    blanks = f"(length({c}) - length(replace({c}, ' ', '')))"
    return (f"(length({c}) >= 1000 AND {blanks} <= 0.07 * length({c}) "
            f"AND len(list_filter({_words(c)}, lambda w: length(w) >= 40)) >= 3)")


GRADED = f"""
flagged AS (
  SELECT *, {glued_sql('native_text')} AS native_glued FROM normalized),
needed AS (
  SELECT *, ((image_count > 0 AND length(native_text) < 500) OR native_glued) AS ocr_needed FROM flagged),
used AS (
  SELECT * REPLACE (CASE WHEN ocr_needed THEN ocr_text ELSE '' END AS ocr_text) FROM needed),
facts AS (
  SELECT *, length(ocr_text) >= 160 AND len({_words('ocr_text')}) >= 20 AS good_ocr,
    {glued_sql('ocr_text')} AS ocr_glued,
    trim(native_text, chr(10) || ' ') <> '' AS has_native, trim(ocr_text, chr(10) || chr(13) || chr(9) || ' ') <> '' AS has_ocr
  FROM used),
chosen AS (
  SELECT *, good_ocr AND (native_glued OR (image_count > 0 AND length(native_text) < 500)) AS ocr_replaced_native
  FROM facts),
graded AS (
  SELECT *,
    CASE WHEN ocr_replaced_native THEN ocr_text WHEN has_native AND has_ocr THEN native_text || chr(10) || chr(10) || ocr_text
      WHEN has_native THEN native_text WHEN has_ocr THEN ocr_text ELSE '' END AS text,
    CASE WHEN ocr_replaced_native THEN 'ocr_recovery' WHEN has_native AND has_ocr THEN 'native_plus_ocr'
      WHEN has_ocr THEN 'ocr' WHEN has_native THEN 'native' ELSE 'empty' END AS extraction_method,
    CASE WHEN NOT ocr_needed AND has_native THEN 'alta' WHEN NOT ocr_needed THEN 'baixa'
      WHEN NOT native_glued AND length(native_text) >= 500 THEN 'alta'
      WHEN good_ocr AND NOT ocr_glued THEN 'media' ELSE 'baixa' END AS source_confidence
  FROM chosen)"""

BLANKS_SQL = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

CHUNKED = f"""
trimmed AS (SELECT * REPLACE (trim(text, {BLANKS_SQL}) AS text) FROM graded),
cut AS (
  SELECT * EXCLUDE (text), text AS full_text,
    unnest(range(CASE WHEN length(text) <= 1800 THEN 1 ELSE CAST(ceil((length(text) - 180) / 1620.0) AS BIGINT) END)) AS chunk_index
  FROM trimmed WHERE text <> ''),
chunks AS (
  SELECT case_id, page_number, chunk_index, trim(substring(full_text, chunk_index * 1620 + 1, 1800), {BLANKS_SQL}) AS text,
    source_confidence, ocr_engine, ocr_cache_hit, ocr_fallback_used
  FROM cut)"""

QUESTIONS = """
questions AS (
  SELECT item_id AS query_id, 'src' || (item_id % 20) AS case_id,
    text || CASE WHEN item_id % 2 = 0 THEN ' resultado' ELSE '' END AS question
  FROM benchmark)"""

PAGES_CTE = "WITH" + RAW_PAGES + "," + NORMALIZED
GRADED_CTE = PAGES_CTE + "," + GRADED
CHUNKS_CTE = GRADED_CTE + "," + CHUNKED
SEARCH_CTE = CHUNKS_CTE + "," + QUESTIONS
