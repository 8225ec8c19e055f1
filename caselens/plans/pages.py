"""Pages, chunks, sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from caselens.functions.scratch import shared_dir
from caselens.functions.text import compact, fold
from caselens.operators import chunks as C
from caselens.operators import quality as Q
from caselens.plans import inputs as I
from caselens.plans.inputs import CHUNKS_CTE, GRADED_CTE, PAGES_CTE, RAW_PAGES, table
from caselens.plans.registry import query
from caselens.sources import tables as S
from caselens.sources.store import Store
from caselens.streaming.ingest import ingest_stream, page_stream


@query("s01_pages", "WITH" + RAW_PAGES + """
SELECT case_id, page_number, length(native_text) AS native_chars, length(ocr_text) AS ocr_chars, image_count,
  ocr_engine FROM raw_pages""")
def s01(spark, sf):
    return I.raw_pages(spark, sf).select(
        "case_id", "page_number", F.length("native_text").alias("native_chars"),
        F.length("ocr_text").alias("ocr_chars"), "image_count", "ocr_engine")


@query("s04_strip_markup", """
SELECT page_id, regexp_replace(url || chr(10) || html, '<[^>]+>', ' ', 'g') AS text FROM pages""")
def s04(spark, sf):
    return S.strip_markup(table(spark, sf, "pages"), ["url", "html"]).select("page_id", "text")


@query("s05_replace_cases", CHUNKS_CTE + """
SELECT case_id, page_number, chunk_index, text FROM chunks
  WHERE case_id NOT IN (SELECT case_id FROM chunks WHERE source_confidence = 'baixa')
UNION ALL SELECT case_id, page_number, 0, 'relido ' || case_id FROM (
  SELECT DISTINCT case_id, page_number FROM chunks WHERE source_confidence = 'baixa')""")
def s05(spark, sf):
    stored = I.chunks(spark, sf).select("case_id", "page_number", "chunk_index", "text", "source_confidence")
    new = stored.where("source_confidence = 'baixa'").select("case_id", "page_number").distinct().select(
        "case_id", "page_number", F.lit(0).alias("chunk_index"), F.concat(F.lit("relido "), "case_id").alias("text"))
    path = shared_dir(spark, "chunks")
    S.replace_cases(spark, stored.drop("source_confidence"), path, buckets=8)
    S.replace_cases(spark, new, path, buckets=8)
    return S.stored_rows(spark, path)


@query("s05_upsert_results", """
WITH old AS (SELECT o_custkey AS case_id, o_orderpriority AS topic_id, max(o_totalprice) AS score FROM orders GROUP BY 1, 2),
fresh AS (SELECT o_custkey AS case_id, o_orderpriority AS topic_id, min(o_totalprice) AS score FROM orders
  WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT case_id, topic_id, coalesce(fresh.score, old.score) AS score FROM old LEFT JOIN fresh USING (case_id, topic_id)""")
def s05_upsert(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("topic_id"), "o_totalprice", "o_orderstatus")
    old = rows.groupBy("case_id", "topic_id").agg(F.max("o_totalprice").alias("score"))
    new = rows.where("o_orderstatus = 'F'").groupBy("case_id", "topic_id").agg(F.min("o_totalprice").alias("score"))
    return S.merge_cases(old, new, ["case_id", "topic_id"])


@query("s06_invalidate", """
SELECT o_custkey AS case_id, o_orderpriority AS kind, count(*) AS n FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1, 2""")
def s06(spark, sf):
    derived = table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    replaced = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("case_id"))
    return S.invalidate(derived, replaced)


@query("s07_stale_cases", """
SELECT c_custkey AS case_id FROM customer WHERE c_custkey NOT IN (
  SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW')""")
def s07(spark, sf):
    results = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("schema_version"),
        F.col("o_orderpriority").alias("catalog_version"))
    cases = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"))
    return S.stale_cases(cases, results, 2, "5-LOW")


def _uploads(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("case_id"), F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("seq"),
        F.element_at(F.array(*[F.lit(s) for s in ("concluido", "processando", "pendente", "erro")]),
                     (F.col("doc_id") % 4 + 1).cast("int")).alias("status"),
        F.timestamp_seconds(F.col("doc_id") * 7919 % 1000).alias("updated_at"), "source")


@query("s08_dedupe_ingest", """
WITH up AS (SELECT doc_id AS case_id, sha256(text) AS sha, doc_id % 4 AS status, doc_id * 7919 % 1000 AS t,
  source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9') AS stored FROM documents),
best AS (SELECT sha, arg_min(case_id, (status, -t, case_id)) AS id FROM up WHERE stored AND status < 3 GROUP BY sha),
firsts AS (SELECT sha, min(case_id) AS id FROM up WHERE NOT stored GROUP BY sha)
SELECT up.case_id, coalesce(best.id, firsts.id) AS answer_id, coalesce(best.id, firsts.id) <> up.case_id AS reused
FROM up LEFT JOIN best USING (sha) LEFT JOIN firsts USING (sha) WHERE NOT up.stored""")
def s08(spark, sf):
    up = _uploads(spark, sf)
    stored = F.col("source").isin(*[f"src{i}" for i in range(10)])
    return S.dedupe_ingest(up.where(~stored), up.where(stored)).select("case_id", "answer_id", "reused")


@query("s09_ingest_stream", f"""
WITH up AS (SELECT *, sha256(text) AS sha, CASE WHEN text LIKE 'The %' THEN 'cabecalho' WHEN length(text) = 0 THEN 'vazio' WHEN length(text) > 20000 THEN 'tamanho' END AS reason FROM documents),
kept AS (SELECT min(doc_id) AS id FROM up WHERE reason IS NULL GROUP BY sha),
norm AS (SELECT doc_id, trim(array_to_string(list_filter(list_transform(string_split(text, chr(10)),
    lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)), {I.BLANKS_SQL}) AS text
  FROM documents WHERE doc_id IN (SELECT id FROM kept)),
cut AS (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 1800 THEN 1 ELSE CAST(ceil((length(text) - 180) / 1620.0) AS BIGINT) END)) AS i FROM norm WHERE text <> ''),
parts AS (SELECT 'doc' || doc_id AS case_id, i, trim(substring(text, i * 1620 + 1, 1800), {I.BLANKS_SQL}) AS text FROM cut)
SELECT 'chunk' AS kind, case_id, i AS n, text FROM parts
UNION ALL SELECT 'index', case_id, count(*), term FROM (
  SELECT DISTINCT case_id, i, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+')) AS term FROM parts) GROUP BY case_id, term
UNION ALL SELECT 'vector', case_id, count(*), NULL FROM parts GROUP BY case_id
UNION ALL SELECT 'refusal', 'doc' || doc_id, doc_id, reason FROM up WHERE reason IS NOT NULL
UNION ALL SELECT 'result', 'doc' || doc_id, doc_id, 'tese' FROM documents WHERE doc_id NOT IN (SELECT id FROM kept)""")
def s09(spark, sf):
    """All documents are uploaded to a store that holds a result of each: results of read files go, those of refused files and copies stay."""
    schema = table(spark, sf, "documents").schema
    docs = page_stream(spark, f"{sf}/documents*.parquet", schema)
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("case_id")
    files = docs.select(
        name, F.sha2("text", 256).alias("sha256"),
        F.col("doc_id").alias("seq"), F.when(F.startswith("text", F.lit("The ")), "<html").otherwise("%PDF").alias("head"),
        F.length("text").alias("size_bytes"), F.timestamp_seconds("doc_id").alias("created_at"),
        F.lit(1).alias("page_number"), F.col("text").alias("native_text"), F.lit("").alias("ocr_text"),
        F.lit(0).alias("image_count"))
    store = Store(spark, shared_dir(spark, "store"), 8)
    former = table(spark, sf, "documents").select(name, F.col("doc_id").alias("n"), F.lit("tese").alias("kind"))
    store.commit({"results": (former, former)})
    ingest_stream(files, store, shared_dir(spark, "ingest"), max_bytes=20000).awaitTermination()
    text = lambda kind, df, n, c: df.select(F.lit(kind).alias("kind"), "case_id", n.cast("bigint").alias("n"), c.alias("text"))
    vectors = store.read("vectors").groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    parts = [text("chunk", store.read("chunks"), F.col("chunk_index"), F.col("text")), text("index", store.read("terms"), F.col("df"), F.col("term")),
             text("vector", vectors, F.col("n"), F.lit(None).cast("string")), text("refusal", store.read("refusals"), F.col("seq"), F.col("reason")),
             text("result", store.read("results"), F.col("n"), F.col("kind"))]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("s10_text_sha256", "WITH" + RAW_PAGES + """
SELECT case_id, sha256(string_agg(trim(regexp_replace(native_text, '\\s+', ' ', 'g')), chr(10) || chr(12) || chr(10)
  ORDER BY page_number)) AS text_sha256 FROM raw_pages GROUP BY case_id""")
def s10(spark, sf):
    return S.text_sha256(I.raw_pages(spark, sf).withColumnRenamed("native_text", "text"))


@query("s11_verify_fingerprints", """
SELECT doc_id AS case_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'texto_divergente' END
  WHEN doc_id % 5 = 0 THEN 'binario_divergente' ELSE 'ok' END AS fingerprint FROM documents""")
def s11(spark, sf):
    docs = table(spark, sf, "documents")
    cases = docs.select(F.col("doc_id").alias("case_id"), F.sha2("text", 256).alias("text_sha256"),
                        F.sha2(F.concat("text", "lang"), 256).alias("sha256"))
    manifest = docs.select(
        F.col("doc_id").alias("case_id"),
        F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).otherwise("x"))
        .alias("want_text_sha256"),
        F.when(F.col("doc_id") % 5 == 0, "y").when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("text", "lang"), 256))
        .alias("want_sha256"))
    return S.verify_fingerprints(cases, manifest).select("case_id", "fingerprint")


@query("s12_write_report", """
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type""")
def s12(spark, sf):
    path = shared_dir(spark, "report")
    S.write_report(table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")), path)
    return spark.read.schema("event_type string, n bigint, total double").json(path)


@query("q01_fold", "SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents")
def q01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fold("text").alias("folded"))


@query("q02_compact", "SELECT doc_id, regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '', 'g') AS flat FROM documents")
def q02(spark, sf):
    return table(spark, sf, "documents").select("doc_id", compact("text").alias("flat"))


@query("q03_normalize_pages", PAGES_CTE + " SELECT case_id, page_number, native_text FROM normalized")
def q03(spark, sf):
    return Q.normalize_pages(I.raw_pages(spark, sf)).select("case_id", "page_number", "native_text")


@query("q04_flag_glued", "WITH" + RAW_PAGES + f"""
SELECT case_id, page_number, {I.glued_sql('flat')} AS native_glued
FROM (SELECT *, CASE WHEN image_count = 1 THEN replace(native_text, ' ', '') ELSE native_text END AS flat FROM raw_pages)""")
def q04(spark, sf):
    squeezed = F.when(F.col("image_count") == 1, F.replace("native_text", F.lit(" "), F.lit(""))).otherwise(F.col("native_text"))
    return Q.flag_glued(I.raw_pages(spark, sf).withColumn("native_text", squeezed)).select(
        "case_id", "page_number", "native_glued")


@query("q05_ocr_needed", GRADED_CTE + " SELECT case_id, page_number, ocr_needed FROM needed")
def q05(spark, sf):
    return Q.ocr_needed(Q.normalize_pages(I.raw_pages(spark, sf))).select("case_id", "page_number", "ocr_needed")


@query("q06_choose_text", GRADED_CTE + " SELECT case_id, page_number, ocr_replaced_native, text FROM graded")
def q06(spark, sf):
    return Q.choose_text(Q.normalize_pages(I.raw_pages(spark, sf))).select(
        "case_id", "page_number", "ocr_replaced_native", "text")


@query("q07_q08_grade_pages", GRADED_CTE + """
SELECT case_id, page_number, extraction_method, source_confidence, length(text) AS char_count FROM graded""")
def q07(spark, sf):
    return I.graded_pages(spark, sf).select(
        "case_id", "page_number", "extraction_method", "source_confidence", "char_count")


NOTES_SQL = """
noted AS (SELECT *, list_filter([
  CASE WHEN native_glued THEN 'texto_nativo_com_palavras_coladas' END,
  CASE WHEN ocr_needed THEN 'ocr_aplicado' END,
  CASE WHEN ocr_needed AND has_ocr THEN 'ocr_com_texto' END,
  CASE WHEN ocr_needed AND ocr_glued THEN 'ocr_com_palavras_coladas' END,
  CASE WHEN ocr_needed AND NOT has_ocr THEN 'ocr_sem_texto' END,
  CASE WHEN ocr_replaced_native THEN 'ocr_substituiu_texto_nativo_inadequado' END,
  CASE WHEN ocr_needed AND ocr_engine IS NOT NULL THEN 'ocr_motor_' || ocr_engine END,
  CASE WHEN ocr_needed AND ocr_cache_hit THEN 'ocr_resultado_reutilizado_do_cache' END,
  CASE WHEN ocr_needed AND ocr_fallback_used THEN 'ocr_fallback_rapidocr' END,
  CASE WHEN ocr_needed THEN 'confianca_' || source_confidence END,
  CASE WHEN NOT has_native THEN 'sem_texto_nativo' END,
  CASE WHEN NOT has_native AND image_count > 0 THEN 'possivel_pagina_escaneada_ou_imagem' END,
  CASE WHEN has_native AND image_count > 0 AND length(native_text) < 500 THEN 'imagem_com_texto_curto' END,
  CASE WHEN has_native AND image_count > 0 AND length(native_text) < 500 THEN 'provavel_necessidade_de_ocr' END,
  CASE WHEN has_native AND image_count = 0 AND length(native_text) < 80 THEN 'baixo_texto_extraido' END,
  CASE WHEN has_native AND NOT (image_count > 0 AND length(native_text) < 500) AND length(native_text) >= 80
    THEN 'texto_nativo_extraido' END], lambda x: x IS NOT NULL) AS quality_notes FROM graded)"""


@query("q09_quality_notes", GRADED_CTE + "," + NOTES_SQL + """
SELECT case_id, page_number, array_to_string(quality_notes, '|') AS quality_notes FROM noted""")
def q09(spark, sf):
    return Q.quality_notes(I.graded_pages(spark, sf)).select("case_id", "page_number", "quality_notes")


@query("q10_extraction_report", GRADED_CTE + "," + NOTES_SQL + """
SELECT case_id, count(*) AS page_count, CAST(sum(length(text)) AS BIGINT) AS total_chars,
  count(*) FILTER (trim(text, chr(10) || ' ') = '') AS empty_pages,
  count(*) FILTER (list_contains(quality_notes, 'baixo_texto_extraido')) AS low_text_pages,
  count(*) FILTER (image_count > 0) AS image_pages, count(*) FILTER (ocr_needed) AS ocr_pages,
  count(*) FILTER (extraction_method = 'native') AS native_pages,
  count(*) FILTER (extraction_method = 'ocr_recovery') AS recovered_pages
FROM noted GROUP BY case_id""")
def q10(spark, sf):
    report = Q.extraction_report(Q.quality_notes(I.graded_pages(spark, sf)))
    count = lambda m: F.coalesce(F.try_element_at("method_counts", F.lit(m)), F.lit(0).cast("bigint"))
    return report.withColumn("native_pages", count("native")).withColumn(
        "recovered_pages", count("ocr_recovery")).drop("method_counts")


@query("q11_document_type", """
SELECT o_orderkey AS case_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'edital' WHEN o_orderpriority LIKE '2%' THEN 'decisao'
  WHEN o_orderpriority LIKE '3%' THEN 'audiencia' WHEN o_orderpriority LIKE '4%' THEN 'sentenca' END AS document_type FROM orders""")
def q11(spark, sf):
    words = F.element_at(
        F.array(*[F.lit(w) for w in ("EDITAL com decisão", "Decisão na audiência", "Audiência e sentença", "Sentença", "Ata")]),
        F.substring("o_orderpriority", 1, 1).cast("int"))
    pages = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.concat(F.lit("Nos autos: "), words).alias("text"))
    return Q.document_type(pages).select("case_id", "document_type")


@query("q12_drop_margin_boxes", """
SELECT l_orderkey AS page_id, string_agg(l_returnflag || l_linenumber, chr(10) ORDER BY l_linenumber, l_returnflag) AS ocr_text
FROM lineitem WHERE l_discount > 0.005 AND l_discount * 10 > 0.05 AND l_discount * 10 < 0.95 GROUP BY 1""")
def q12(spark, sf):
    x = F.col("l_discount") * 1000
    point = lambda dx: F.struct((x + dx).alias("x"), F.lit(0.0).alias("y"))
    boxes = table(spark, sf, "lineitem").select(
        F.lit("c").alias("case_id"), F.col("l_orderkey").alias("page_number"), F.col("l_linenumber").alias("box_no"),
        F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"),
        F.array(point(-4), point(4), point(-4), point(4)).alias("points"), F.lit(100).alias("image_width"))
    return Q.drop_margin_boxes(boxes).select(F.col("page_number").alias("page_id"), "ocr_text")


def _cases(spark, sf):
    """Customers as cases with a progress state."""
    c = F.col("c_custkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (c % len(v) + 1).cast("int"))
    return table(spark, sf, "customer").select(
        c.alias("case_id"), pick("concluido", "processando", "erro", "pendente").alias("status"),
        pick("indexando", "erro", "extraindo").alias("progress_stage"), (c % 11).cast("int").alias("progress_current"),
        (c % 7).cast("int").alias("progress_total"), (c % 5).cast("int").alias("chunk_count"),
        F.timestamp_seconds(c * 37).alias("created_at"))


@query("q13_case_status", """
WITH c AS (SELECT c_custkey AS case_id, c_custkey % 4 AS s, c_custkey % 3 AS g, c_custkey % 11 AS cur, c_custkey % 7 AS tot,
  c_custkey % 5 AS n FROM customer)
SELECT case_id, case_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS needs_reprocessing,
  CAST(CASE WHEN s = 0 THEN 100 WHEN tot = 0 THEN 0 ELSE least(100, round_even(cur / tot * 100, 0)) END AS BIGINT) AS progress_percent,
  CASE WHEN s = 0 THEN 'hibrida' WHEN n > 0 AND g IN (0, 1) THEN 'lexical' ELSE 'indisponivel' END AS search_mode FROM c""")
def q13(spark, sf):
    chunk = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("case_id"),
        F.when(F.col("o_orderstatus") == "P", "desconhecida").otherwise("alta").alias("source_confidence"))
    return Q.case_status(_cases(spark, sf), chunk).select("case_id", "needs_reprocessing", "progress_percent", "search_mode")


@query("q14_recent_cases", "SELECT c_custkey AS case_id FROM customer ORDER BY c_custkey DESC LIMIT 10")
def q14(spark, sf):
    return Q.recent_cases(_cases(spark, sf), 10).select("case_id")


@query("q15_repair_mojibake", "SELECT doc_id, text FROM documents")
def q15(spark, sf):
    """Damage every text once or twice, repair it, and expect the original."""
    spoil = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    spoiled = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, spoil(F.col("text"))).otherwise(spoil(spoil(F.col("text")))).alias("text"))
    return Q.repair_mojibake(spoiled, "text")


@query("c01_chunk_pages", CHUNKS_CTE + " SELECT case_id, page_number, chunk_index, text, source_confidence FROM chunks")
def c01(spark, sf):
    return I.chunks(spark, sf).select("case_id", "page_number", "chunk_index", "text", "source_confidence")


@query("c02_split_sources", f"""
WITH RECURSIVE src AS (SELECT doc_id, trim(text, {I.BLANKS_SQL}) AS t FROM documents WHERE trim(text, {I.BLANKS_SQL}) <> ''),
bounds AS (
  SELECT doc_id, t, 0 AS part_no, 0::BIGINT AS start, CASE WHEN length(t) <= 6000 THEN length(t)
    WHEN strpos(reverse(substring(t, 3001, 3000)), ' ') > 0 THEN 6000 - strpos(reverse(substring(t, 3001, 3000)), ' ')
    ELSE 6000 END AS stop FROM src
  UNION ALL
  SELECT doc_id, t, part_no + 1, nxt, CASE WHEN length(t) <= nxt + 6000 THEN length(t)
    WHEN strpos(reverse(substring(t, nxt + 3001, 3000)), ' ') > 0
      THEN nxt + 6000 - strpos(reverse(substring(t, nxt + 3001, 3000)), ' ') ELSE nxt + 6000 END
  FROM (SELECT *, greatest(start + 1, stop - 400) AS nxt FROM bounds WHERE stop < length(t)))
SELECT doc_id, CAST(part_no AS BIGINT) AS part_no, trim(substring(t, start + 1, stop - start), {I.BLANKS_SQL}) AS text FROM bounds""")
def c02(spark, sf):
    return C.split_sources(table(spark, sf, "documents").select("doc_id", "text"))


@query("c03_c04_rebuild_pages", CHUNKS_CTE + """
, parts AS (SELECT case_id, page_number, list(text ORDER BY chunk_index) AS parts, min(source_confidence) AS source_confidence,
  arg_min(ocr_engine, chunk_index) AS ocr_engine, bool_or(ocr_cache_hit) AS ocr_cache_hit,
  bool_or(ocr_fallback_used) AS ocr_fallback_used FROM chunks GROUP BY 1, 2)
SELECT case_id, page_number, ocr_engine, ocr_cache_hit, ocr_fallback_used, source_confidence,
  list_reduce(parts, lambda acc, x: CASE
    WHEN contains(acc[greatest(1, length(acc) - length(x) - 600 + 1):], x) THEN acc
    ELSE acc || CASE WHEN list_max(list_filter(range(1, least(length(acc), length(x), 600) + 1),
        lambda n: ends_with(acc, x[1:n]))) IS NULL THEN chr(10) || x
      ELSE x[list_max(list_filter(range(1, least(length(acc), length(x), 600) + 1), lambda n: ends_with(acc, x[1:n]))) + 1:] END
    END) AS text FROM parts""")
def c03(spark, sf):
    return C.rebuild_pages(I.chunks(spark, sf)).select(
        "case_id", "page_number", "ocr_engine", "ocr_cache_hit", "ocr_fallback_used", "source_confidence", "text")


@query("c05_page_ranges", "WITH" + RAW_PAGES + """
, docs AS (SELECT *, (page_number - 1) // 4 AS doc_no FROM raw_pages),
ranges AS (SELECT *, coalesce(sum(length(native_text) + 2) OVER (PARTITION BY case_id, doc_no ORDER BY page_number
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM docs)
SELECT case_id, page_number, CAST(a AS BIGINT) AS range_start, CAST(a + length(native_text) AS BIGINT) AS range_stop FROM ranges""")
def c05(spark, sf):
    docs = I.raw_pages(spark, sf).withColumn("doc_no", F.floor((F.col("page_number") - 1) / 4)).withColumnRenamed("native_text", "text")
    return C.page_ranges(docs, ["case_id", "doc_no"]).select("case_id", "page_number", "range_start", "range_stop")


@query("c05_offset_pages", "WITH" + RAW_PAGES + """
, docs AS (SELECT *, (page_number - 1) // 4 AS doc_no FROM raw_pages),
ranges AS (SELECT *, coalesce(sum(length(native_text) + 2) OVER (PARTITION BY case_id, doc_no ORDER BY page_number
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM docs),
probes AS (SELECT case_id, doc_no, unnest(range(0, sum(length(native_text))::BIGINT + 500, 500)) AS probe FROM docs GROUP BY 1, 2)
SELECT case_id, CAST(doc_no AS BIGINT) AS doc_no, probe AS "offset", coalesce(
  (SELECT min(page_number) FROM ranges r WHERE r.case_id = p.case_id AND r.doc_no = p.doc_no AND probe >= a
    AND probe < a + length(native_text)),
  (SELECT max(page_number) FROM ranges r WHERE r.case_id = p.case_id AND r.doc_no = p.doc_no)) AS page_number FROM probes p""")
def c05_offsets(spark, sf):
    docs = I.raw_pages(spark, sf).withColumn("doc_no", F.floor((F.col("page_number") - 1) / 4)).withColumnRenamed("native_text", "text")
    size = docs.groupBy("case_id", "doc_no").agg(F.sum(F.length("text")).alias("n"))
    probes = size.select("case_id", "doc_no", F.explode(F.sequence(F.lit(0), F.col("n") + 499, F.lit(500))).alias("offset"))
    return C.offset_pages(probes, C.page_ranges(docs, ["case_id", "doc_no"]), ["case_id", "doc_no"])


@query("c06_assemble_documents", "WITH" + RAW_PAGES + """
, p AS (SELECT case_id, page_number, doc_id % 7 = 0 AS is_start, doc_id % 13 = 5 AS stop_before, doc_id % 11 = 3 AS stop_after
  FROM raw_pages),
seen AS (SELECT *, max(CASE WHEN is_start THEN page_number END) OVER w AS start_page, max(CASE WHEN stop_before THEN page_number END) OVER w AS blocked,
  max(CASE WHEN stop_after THEN page_number END) OVER (PARTITION BY case_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed,
  lead(is_start) OVER (PARTITION BY case_id ORDER BY page_number) AS next_start
  FROM p WINDOW w AS (PARTITION BY case_id ORDER BY page_number ROWS UNBOUNDED PRECEDING)),
doc AS (SELECT *, row_number() OVER (PARTITION BY case_id, start_page ORDER BY page_number DESC) AS back FROM seen
  WHERE start_page IS NOT NULL AND coalesce(blocked <= start_page, true) AND coalesce(closed < start_page, true))
SELECT case_id, start_page, page_number, max(CASE WHEN back = 1 THEN CASE WHEN stop_after THEN 'fechado' WHEN next_start THEN 'inicio' WHEN next_start IS NULL THEN 'ausente'
  ELSE 'outro_documento' END END) OVER (PARTITION BY case_id, start_page) AS stop_reason FROM doc""")
def c06(spark, sf):
    d = F.col("doc_id")
    pages = I.raw_pages(spark, sf).select(
        "case_id", "page_number", (d % 7 == 0).alias("is_start"), (d % 13 == 5).alias("stop_before"), (d % 11 == 3).alias("stop_after"))
    return C.assemble_documents(pages, block=64).select("case_id", "start_page", "page_number", "stop_reason")
