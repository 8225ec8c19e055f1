"""Suites and relevance sets: written from the tables, read back through the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.functions.scratch import shared_dir
from caselens.operators import suites as B
from caselens.plans.inputs import table
from caselens.plans.registry import query
from caselens.sources import suites as S


@query("s02_read_qrels", """
SELECT 'document' AS kind, doc_id AS id, NULL::BIGINT AS query_id, NULL::BIGINT AS score,
  lang || chr(10) || source || chr(10) || chr(10) || text || chr(10) || ' x ' || chr(10) || chr(10) AS text FROM documents
UNION ALL SELECT 'query', item_id, item_id, NULL, text FROM benchmark
UNION ALL SELECT 'judgement', doc_id, doc_id % 40, 2, NULL FROM labels WHERE doc_id % 40 IN (SELECT item_id FROM benchmark)""")
def s02(spark, sf):
    folder = shared_dir(spark, "qrels")
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("KEY"), F.col("lang").alias("AREA"), F.col("source").alias("TEMA"), F.lit("").alias("SUBTEMA"), F.col("text").alias("ENUNCIADO"),
        F.lit("<b>x</b>").alias("EXCERTO"), F.lit("").alias("INDEXADORESCONSOLIDADOS"), F.lit("").alias("REFERENCIALEGAL"))
    save = lambda df, name: df.write.csv(f"{folder}/{name}", header=True, escape='"', quoteAll=True)
    save(docs, "doc.csv")
    save(table(spark, sf, "benchmark").select(F.col("item_id").alias("ID"), F.col("text").alias("TEXT")), "query.csv")
    save(table(spark, sf, "labels").select((F.col("doc_id") % 40).alias("QUERY_ID"), F.col("doc_id").alias("DOC_ID"), F.lit("2.0").alias("SCORE")), "qrel.csv")
    documents, queries, judgements = S.read_qrels(spark, folder)
    none = F.lit(None).cast("bigint")
    return documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), none.alias("query_id"), none.alias("score"), "text").unionByName(
        queries.select(F.lit("query").alias("kind"), F.col("query_id").alias("id"), "query_id", none.alias("score"), F.col("question").alias("text"))).unionByName(
        judgements.select(F.lit("judgement").alias("kind"), F.col("doc_id").alias("id"), "query_id", "score", F.lit(None).cast("string").alias("text")))


@query("s03_read_suite", """
SELECT o_custkey::VARCHAR AS suite_id, o_orderkey::VARCHAR AS case_id, 'q' || (o_orderkey % 3) AS engine, CASE WHEN o_orderkey % 2 = 0 THEN 'test' ELSE 'development' END AS split,
  (o_orderkey % 7) || '|' || (o_orderkey % 5 + 10) AS relevant_pages FROM orders""")
def s03(spark, sf):
    path, k = shared_dir(spark, "suite"), F.col("o_orderkey")
    case = F.struct(k.cast("string").alias("id"), F.concat(F.lit("q"), (k % 3).cast("string")).alias("engine"),
                    F.when(k % 2 == 0, "test").otherwise("development").alias("split"), F.struct(F.array(k % 7, k % 5 + 10).alias("relevant_pages")).alias("expected"))
    table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.collect_list(case).alias("cases")).write.json(path)
    return S.read_suite(spark, path, multi_line=False).select("suite_id", "case_id", "engine", "split", "relevant_pages")


@query("s03_read_reference_suite", """
SELECT o_custkey::VARCHAR AS process_id, o_orderkey::VARCHAR AS case_id, 'Pergunta ' || o_orderkey AS question, o_orderstatus AS review_status FROM orders""")
def s03_reference(spark, sf):
    path, k = shared_dir(spark, "reference"), F.col("o_orderkey").cast("string")
    case = F.struct(k.alias("id"), F.concat(F.lit("Pergunta "), k).alias("pergunta"), F.col("o_orderstatus").alias("review_status"))
    process = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.collect_list(case).alias("cases"))
    process.select(F.lit("s").alias("id"), F.array(F.struct("id", "cases")).alias("processes")).write.json(path)
    return S.read_reference_suite(spark, path, multi_line=False)[1].select("process_id", "case_id", "question", "review_status")


@query("s03_read_observations", "SELECT user_id::VARCHAR AS suite_id, event_id::VARCHAR AS case_id, event_type AS label, event_id % 900 AS latency_ms FROM events")
def s03_observations(spark, sf):
    path, e = shared_dir(spark, "observations"), F.col("event_id")
    row = F.struct(e.cast("string").alias("case_id"), F.col("event_type").alias("label"), (e % 900).alias("latency_ms"))
    table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("suite_id")).agg(F.collect_list(row).alias("observations")).write.json(path)
    return S.read_observations(spark, path, multi_line=False).select("suite_id", "case_id", "label", "latency_ms")


def _cases(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("process_id"), k.alias("case_id"), F.concat(F.lit("P "), k.cast("string")).alias("question"), F.array(k % 3, k % 5 + 2).alias("expected_pages"),
        F.array(F.concat(F.lit("a"), (k % 4).cast("string")), F.concat(F.lit(" A"), (k % 6).cast("string"))).alias("expected_terms"),
        F.when(k % 4 == 0, "approved").when(k % 4 == 1, "rejected").when(k % 4 == 2, "pending").otherwise("talvez").alias("review_status"),
        F.when(k % 3 == 0, "rev1").alias("reviewer"))


def _report(spark, sf):
    k = F.col("case_id")
    return _cases(spark, sf).where(k % 10 != 9).select(
        "process_id", F.when(k % 50 == 1, -k).otherwise(k).alias("case_id"), F.when(k % 20 == 3, "outra").otherwise(F.col("question")).alias("question"),
        F.when(k % 20 == 5, F.array(k)).otherwise(F.col("expected_pages")).alias("expected_pages"), F.array(k % 3, k % 3, k % 7).alias("pages"), (k % 2 == 0).alias("hit"), (k % 900).alias("latency_ms"))


def _tests(spark, sf):
    return table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("process_id"))


@query("b16_adapt_suite", """
SELECT o_custkey || '.' || o_orderkey AS case_id, CASE WHEN o_custkey % 3 = 0 THEN 'test' ELSE 'development' END AS split,
  CASE o_orderkey % 4 WHEN 0 THEN 'legal_approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS review_status,
  CASE WHEN o_orderkey % 2 = 0 THEN 'fontes_relevantes_localizadas' ELSE 'fontes_relevantes_nao_localizadas' END AS label,
  CASE WHEN o_orderkey % 3 = o_orderkey % 7 THEN (o_orderkey % 3)::VARCHAR ELSE (o_orderkey % 3) || '|' || (o_orderkey % 7) END AS source_pages
FROM orders WHERE o_orderkey % 10 <> 9 AND o_orderkey % 50 <> 1""")
def b16(spark, sf):
    adapted, _ = B.adapt_suite(_cases(spark, sf), _report(spark, sf), _tests(spark, sf))
    return adapted.select("case_id", "split", "review_status", "label", "source_pages")


@query("b16_adapt_violations", """
SELECT o_custkey AS process_id, o_orderkey AS case_id, 'caso_ausente_no_relatorio' AS violation FROM orders WHERE o_orderkey % 10 = 9 OR o_orderkey % 50 = 1
UNION ALL SELECT o_custkey, -o_orderkey, 'caso_desconhecido_no_relatorio' FROM orders WHERE o_orderkey % 50 = 1
UNION ALL SELECT o_custkey, o_orderkey, 'pergunta_divergente' FROM orders WHERE o_orderkey % 20 = 3
UNION ALL SELECT o_custkey, o_orderkey, 'paginas_divergentes' FROM orders WHERE o_orderkey % 20 = 5
UNION ALL SELECT c_custkey, NULL, 'processo_de_teste_desconhecido' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def b16_violations(spark, sf):
    return B.adapt_suite(_cases(spark, sf), _report(spark, sf), _tests(spark, sf))[1]


@query("b17_suite_violations", """
WITH c AS (SELECT o_custkey AS process_id, o_orderkey AS k, o_orderkey AS case_id FROM orders)
SELECT process_id, case_id, 'pagina_nao_positiva' AS violation FROM c WHERE k % 3 = 0
UNION ALL SELECT process_id, case_id, 'paginas_fora_de_ordem' FROM c WHERE k % 3 >= k % 5 + 2
UNION ALL SELECT process_id, case_id, 'pagina_inexistente' FROM c WHERE greatest(k % 3, k % 5 + 2) > 5
UNION ALL SELECT process_id, case_id, 'termos_duplicados' FROM c WHERE k % 4 = k % 6
UNION ALL SELECT process_id, case_id, 'revisao_invalida' FROM c WHERE k % 4 = 3
UNION ALL SELECT process_id, case_id, 'revisor_em_pendente' FROM c WHERE k % 4 = 2 AND k % 3 = 0
UNION ALL SELECT process_id, case_id, 'revisor_ausente' FROM c WHERE k % 4 <> 2 AND k % 3 <> 0""")
def b17(spark, sf):
    counts = table(spark, sf, "customer").select(F.col("c_custkey").alias("process_id"), F.lit(5).alias("page_count"))
    return B.suite_violations(_cases(spark, sf), counts)
