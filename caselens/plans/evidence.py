"""Evidence checks; claims are made from the tables so that the truth is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.functions.aligned import composed, decomposed
from caselens.functions.text import squash, words
from caselens.operators import evidence as K
from caselens.plans.inputs import table
from caselens.plans.registry import query


def _sources(spark, sf):
    """Orders as sources of their customer, with a text that names the order."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("case_id"), k.alias("source_id"), (k % 40).alias("page_number"), (k % 4).alias("chunk_index"),
        F.concat(F.lit("Consta  do termo\nnúmero "), k.cast("string"), F.lit(" que o réu (sic) foi ouvido no dia. Houve prisão em "),
                 F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" e nada mais.")).alias("text"),
        F.when(k % 3 == 0, "media").otherwise("alta").alias("source_confidence"))


def _quote(k):
    """Good quotations in another case and with other blanks; one in four is invented, one in five too short."""
    return (F.when(k % 4 == 3, "texto que não existe").when(k % 5 == 4, "réu")
            .otherwise(F.concat(F.lit(' "TERMO número '), k.cast("string"), F.lit(' QUE O RÉU (sic)" '))))


def _claims(spark, sf):
    """Every line quotes the order it belongs to; equal quotations repeat."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("item_no"), "l_returnflag", "l_linestatus", "l_suppkey")
    case = table(spark, sf, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("case_id"))
    return li.join(case, "source_id").withColumn("quote", _quote(F.col("source_id") + F.col("item_no") % 2))


# A quotation is true when the number it names is the order it is checked against.
TRUE = "(l_linenumber % 2 = 0 AND l_orderkey % 4 <> 3 AND l_orderkey % 5 <> 4)"


# The short quotation names no order and stands in every text.
SHORT = "((l_orderkey + l_linenumber % 2) % 4 <> 3 AND (l_orderkey + l_linenumber % 2) % 5 = 4)"


@query("k01_check_quotes", f"""
SELECT o_custkey AS case_id, l_orderkey AS source_id, l_returnflag AS claim, min(l_linenumber)::BIGINT AS item_no,
  'termo' || chr(10) || 'número ' || l_orderkey || ' que o réu (sic)' AS exact
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE {TRUE} GROUP BY 1, 2, 3""")
def k01(spark, sf):
    claims = _claims(spark, sf).withColumnRenamed("l_returnflag", "claim")
    return K.check_quotes(claims, _sources(spark, sf), ["case_id", "claim"]).select("case_id", "source_id", "claim", "item_no", "exact")


@query("k01_decomposed_quotes", """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents),
q AS (SELECT doc_id, trim(array_to_string(ws[3:9], ' '), ' "') AS quote FROM w WHERE len(ws) >= 3)
SELECT doc_id AS case_id, lower(quote) AS quote FROM q WHERE length(quote) >= 8""")
def k01_decomposed(spark, sf):
    """Texts are stored with decomposed accents, quotations come with composed ones: each is found, in the spelling of the text."""
    docs = table(spark, sf, "documents").where("text is not null")
    ws = words(F.col("text"))
    sources = docs.select(F.col("doc_id").alias("case_id"), F.col("doc_id").alias("source_id"), decomposed("text").alias("text"), F.lit(1).alias("page_number"))
    claims = docs.where(F.size(ws) >= 3).select(
        F.col("doc_id").alias("case_id"), F.col("doc_id").alias("source_id"), F.lit(1).alias("item_no"), F.array_join(F.slice(ws, 3, 7), " ").alias("quote"))
    found = K.check_quotes(claims, sources, ["case_id"])
    # nothing composed is left in what was cut out of the stored text
    stored = found.where(F.col("exact") == decomposed("exact"))
    return stored.select("case_id", F.lower(squash(composed("exact"))).alias("quote"))


@query("k02_sanitize_comparisons", """
WITH c AS (SELECT DISTINCT o_custkey AS case_id, o_orderkey AS a, (o_orderkey * 7 % 3) AS s, o_orderkey % 4 <> 3 AND o_orderkey % 5 <> 4 AS ok FROM orders)
SELECT case_id, a::VARCHAR AS a_id, CASE s WHEN 0 THEN 'coincidente' ELSE 'potencial' END AS state, ok AS valid,
  'cmp-' || substr(sha256(case_id || '|' || least(a::VARCHAR, 'x' || a) || '|' || greatest(a::VARCHAR, 'x' || a) || '|1.0|1.0'), 1, 16) AS comparison_id FROM c""")
def k02(spark, sf):
    src = _sources(spark, sf)
    k = F.col("source_id")
    speech = src.select("case_id", k.cast("string").alias("testimony_id"), "page_number", "text").unionByName(
        src.select("case_id", F.concat(F.lit("x"), k.cast("string")).alias("testimony_id"), "page_number", "text"))
    claims = src.select(
        "case_id", k.cast("string").alias("a_id"), F.concat(F.lit("x"), k.cast("string")).alias("b_id"),
        F.when(k * 7 % 3 == 0, "coincidente").otherwise("potencial").alias("state"), F.explode(F.array(F.lit(1), F.lit(2))).alias("item_no"),
        F.lit("ouvido no DIA").alias("quote_a"), _quote(k).alias("quote_b"))
    out = K.sanitize_comparisons(claims, speech)
    return out.select("case_id", "a_id", "state", "valid", "comparison_id").distinct()


@query("k03_sanitize_questions", f"""
WITH s AS (SELECT o_custkey AS case_id, o_orderkey AS k, count(*) AS supports, count(DISTINCT l_linestatus) AS testimonies
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE {TRUE} GROUP BY 1, 2),
q AS (SELECT *, 'O que houve no termo ' || (k // 2) || '?' AS question, CASE WHEN k % 3 = 0 THEN 'contradicao_potencial' ELSE 'esclarecimento' END AS kind, k % 5 AS priority FROM s),
v AS (SELECT * FROM q WHERE kind <> 'contradicao_potencial' OR testimonies >= 2),
u AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY case_id, question ORDER BY k) = 1)
SELECT case_id, k AS item_no, question, kind, row_number() OVER (PARTITION BY case_id ORDER BY priority, k) AS position FROM u""")
def k03(spark, sf):
    src = _sources(spark, sf)
    k = F.col("source_id")
    sources = _claims(spark, sf).select("case_id", "source_id", "l_linestatus").distinct().join(src, ["case_id", "source_id"]).select(
        "case_id", F.concat_ws("-", k.cast("string"), "l_linestatus").alias("source_id"), F.col("l_linestatus").alias("testimony_id"), "text")
    supports = _claims(spark, sf).select(
        "case_id", k.alias("item_no"), F.col("item_no").alias("support_no"), F.concat_ws("-", k.cast("string"), "l_linestatus").alias("source_id"), "quote")
    claims = src.select("case_id", k.alias("item_no"), F.concat(F.lit("  O que houve  no termo "), F.floor(k / 2).cast("string")).alias("question"),
                        F.when(k % 3 == 0, "Contradicao_potencial ").otherwise("outra").alias("kind"), (k % 5).alias("priority"))
    return K.sanitize_questions(claims, supports, sources).select("case_id", "item_no", "question", "kind", "position")


@query("k04_fingerprint", """
SELECT o_custkey AS case_id, substr(sha256(string_agg(o_orderkey || ':' || o_orderpriority, '|' ORDER BY o_orderkey || ':' || o_orderpriority)), 1, 16) AS fingerprint
FROM orders GROUP BY 1""")
def k04(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").cast("string").alias("comparison_id"),
                                             F.col("o_orderpriority").alias("updated_at"))
    return K.fingerprint(rows, ["case_id"])


CATEGORIES = ["aplicabilidade", "validade", "validade", "prejuizo", "contrapeso"]


def _topics(spark):
    rows = [(f"t{t}", f"r{i}", i, c, f"Requisito {i}", t == 1, [f"lei{i}"], ["lei1", "lei2", "lei9"]) for t in (0, 1) for i, c in enumerate(CATEGORIES, 1)]
    return spark.createDataFrame(rows, "topic_id string, requirement_id string, requirement_no int, category string, label string, decisive boolean, "
                                       "legal_ids array<string>, topic_legal_ids array<string>")


def _requirements(spark, sf):
    """Each order is a case of one topic; its lines 1 to 5 answer the requirements, the first line number wins. One blank where the text has two is no quotation."""
    o = table(spark, sf, "orders")
    cases = o.select(F.col("o_orderkey").alias("case_id"), F.concat(F.lit("t"), (F.col("o_orderkey") % 2).cast("string")).alias("topic_id"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("requirement_id"),
                                             F.col("l_linenumber").alias("item_no"), "l_returnflag", "l_linestatus", "l_suppkey")
    flag = F.col("flag")
    claims = li.groupBy("case_id", "requirement_id").agg(F.min("l_returnflag").alias("flag")).join(cases, "case_id").select(
        "case_id", "topic_id", "requirement_id", F.when(flag == "A", " Observado").when(flag == "N", "nao_observado").otherwise("talvez").alias("result"),
        F.lit("porque sim").alias("justification"), F.when(flag == "A", F.array(F.lit("lei9"), F.lit("lei7"))).alias("claimed_legal_ids"))
    evidence = li.join(cases, "case_id").select(
        "case_id", "topic_id", "requirement_id", "item_no", F.col("case_id").alias("source_id"),
        F.when(F.col("l_linestatus") == "F", ' "CONSTA  do TERMO" ').otherwise("consta DO TERMO").alias("quote"))
    sources = _sources(spark, sf).withColumn("case_id", F.col("source_id"))
    return K.requirements(_topics(spark), cases, claims, evidence, sources)


REQS = f"""
cat(n, category) AS (VALUES (1, 'aplicabilidade'), (2, 'validade'), (3, 'validade'), (4, 'prejuizo'), (5, 'contrapeso')),
said AS (SELECT l_orderkey AS case_id, l_linenumber AS n, min(l_returnflag) AS flag, max((l_linestatus = 'F')::INT) AS ok FROM lineitem GROUP BY 1, 2),
reqs AS (SELECT o_orderkey AS case_id, 't' || (o_orderkey % 2) AS topic_id, cat.n, category, o_orderkey % 2 = 1 AS decisive, coalesce(ok, 0) AS evidence_count,
  o_orderkey % 3 = 0 AND coalesce(ok, 0) = 1 AS media_source, flag,
  CASE WHEN flag IN ('A', 'N') AND ok = 1 THEN CASE flag WHEN 'A' THEN 'observado' ELSE 'nao_observado' END ELSE 'nao_localizado' END AS result,
  CASE WHEN flag IS NULL THEN '{K.NOT_FOUND}' WHEN flag IN ('A', 'N') AND ok = 0 THEN '{K.UNPROVED}' ELSE 'porque sim' END AS justification,
  CASE WHEN flag = 'A' THEN 'lei9' ELSE 'lei' || cat.n END AS legal_ids
  FROM orders CROSS JOIN cat LEFT JOIN said ON said.case_id = o_orderkey AND said.n = cat.n)"""


@query("k05_requirements", "WITH" + REQS + """
SELECT case_id, topic_id, 'r' || n AS requirement_id, category, result, justification, evidence_count::BIGINT AS evidence_count, legal_ids FROM reqs""")
def k05(spark, sf):
    return _requirements(spark, sf).select("case_id", "topic_id", "requirement_id", "category", "result", "justification", "evidence_count", "legal_ids")


@query("k06_topic_has_evidence", """
SELECT o_custkey AS case_id, topic_id, CASE topic_id WHEN 'livre' THEN true WHEN 'prisao' THEN true WHEN 'termo7' THEN bool_or(contains('numero ' || o_orderkey || ' que', 'numero 7')) ELSE false END AS has_evidence
FROM orders, (SELECT unnest(['livre', 'prisao', 'termo7', 'nada']) AS topic_id) GROUP BY 1, 2""")
def k06(spark, sf):
    src = _sources(spark, sf)
    none = F.array().cast("array<string>")
    topic = lambda name, *terms: F.struct(F.lit(name).alias("topic_id"), (F.array(*[F.lit(t) for t in terms]) if terms else none).alias("terms"))
    topics = src.select("case_id").distinct().select("case_id", F.explode(F.array(
        topic("livre"), topic("prisao", "zzz", "Prisão"), topic("termo7", "Número  7"), topic("nada", "inexistente"))).alias("t")).select("case_id", "t.*")
    return K.topic_has_evidence(src, topics)


@query("k06_recognition_evidence", """
SELECT o_orderkey AS source_id, o_orderkey % 3 = 0 OR o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 AS found FROM orders""")
def k06_recognition(spark, sf):
    k = F.col("source_id")
    text = F.concat("text", F.when(k % 3 == 0, " Reconhecimento do SUSPEITO").when(k % 3 == 1, F.concat(
        F.lit(" A vítima já conhecia o autor"), F.when(k % 2 == 0, " e confirmar  os dados").otherwise(""))).otherwise(""))
    return _sources(spark, sf).select("source_id", K.recognition_evidence(text).alias("found"))


CONCLUDED = """
counts AS (SELECT case_id, topic_id, count(*) FILTER (category = 'aplicabilidade' AND result = 'observado') AS app_yes,
  count(*) FILTER (category = 'aplicabilidade' AND result = 'nao_observado') AS app_no,
  count(*) FILTER (category = 'validade' AND result = 'nao_observado') AS bad, count(*) FILTER (category = 'validade' AND result = 'observado') AS fine,
  count(*) FILTER (category = 'prejuizo' AND result = 'observado') AS harm, count(*) FILTER (category = 'contrapeso' AND result = 'observado') AS counter,
  bool_or(decisive) AS decisive, sum(CASE WHEN result <> 'nao_localizado' THEN evidence_count ELSE 0 END)::BIGINT AS cited,
  bool_or(result <> 'nao_localizado' AND media_source) AS media_cited FROM reqs GROUP BY 1, 2),
concluded AS (SELECT *, CASE WHEN app_yes = 0 THEN CASE WHEN app_no > 0 THEN 'nao_configurada' ELSE 'inconclusiva' END
  WHEN bad > 0 THEN CASE WHEN (decisive OR harm > 0) AND counter = 0 THEN 'configurada' ELSE 'indicios_suficientes' END
  WHEN fine = 2 THEN 'nao_configurada' ELSE 'inconclusiva' END AS conclusion FROM counts)"""


@query("k07_conclusion", "WITH" + REQS + "," + CONCLUDED + " SELECT case_id, topic_id, conclusion, cited, media_cited FROM concluded")
def k07(spark, sf):
    return K.conclusion(_requirements(spark, sf))


@query("k08_recognition_conclusion", "WITH" + REQS + """
, c AS (SELECT case_id, max(result) FILTER (n = 1) AS known, count(*) FILTER (category = 'validade' AND result = 'nao_observado') AS bad,
  count(*) FILTER (category = 'validade' AND result = 'observado') AS fine FROM reqs GROUP BY 1),
a AS (SELECT *, CASE known WHEN 'observado' THEN 'sim' WHEN 'nao_observado' THEN 'nao' ELSE 'inconclusiva' END AS applicability FROM c)
SELECT case_id, applicability, CASE WHEN applicability = 'nao' THEN 'rito_formal_nao_aplicavel' WHEN applicability <> 'sim' THEN 'inconclusivo'
  WHEN bad > 0 THEN 'forte_fundamento_para_alegar_invalidade' WHEN fine = 2 THEN 'procedimento_aparentemente_regular' ELSE 'inconclusivo' END AS conclusion FROM a""")
def k08(spark, sf):
    reqs = _requirements(spark, sf).withColumn("requirement_id", F.when(F.col("requirement_id") == "r1", "pessoa_desconhecida").otherwise(F.col("requirement_id")))
    return K.recognition_conclusion(reqs, reqs.select("case_id").distinct().withColumn("applicability", F.lit("Sim ")))


@query("k09_cap_confidence", "WITH" + REQS + "," + CONCLUDED + """
SELECT case_id, CASE WHEN conclusion = 'inconclusiva' OR raw = 'baixa' THEN 'baixa' WHEN conclusion = 'nao_configurada' THEN 'media'
  WHEN cited = 0 THEN 'baixa' WHEN media_cited THEN 'media' ELSE 'alta' END AS confidence
FROM (SELECT *, CASE WHEN case_id % 5 = 0 THEN 'baixa' ELSE 'alta' END AS raw FROM concluded)""")
def k09(spark, sf):
    rows = K.conclusion(_requirements(spark, sf)).withColumn("raw_confidence", F.when(F.col("case_id") % 5 == 0, "x").otherwise("Alta"))
    return K.cap_confidence(rows).select("case_id", "confidence")


@query("k10_gaps", "WITH" + REQS + """
, m AS (SELECT case_id, list('Confirmar no processo: Requisito ' || n || '.' ORDER BY n) AS m FROM reqs WHERE result = 'nao_localizado' GROUP BY 1)
SELECT o_orderkey AS case_id, array_to_string(list_concat(['falta um'], CASE WHEN o_orderkey % 2 = 0 THEN ['Confirmar no processo: Requisito 2.'] ELSE [] END,
  list_filter(coalesce(m, []), lambda x: NOT (o_orderkey % 2 = 0 AND x = 'Confirmar no processo: Requisito 2.'))), '|') AS gaps
FROM orders LEFT JOIN m ON case_id = o_orderkey""")
def k10(spark, sf):
    reqs = _requirements(spark, sf)
    second = F.when(F.col("case_id") % 2 == 0, "Confirmar no  processo: Requisito 2.").otherwise(" ")
    model = reqs.select("case_id", "topic_id").distinct().withColumn("gaps", F.array(F.lit(" falta  um"), F.lit("falta um"), second))
    return K.gaps(reqs, model).select("case_id", "gaps")


@query("k11_theses", f"""
WITH e AS (SELECT o_custkey AS case_id, l_orderkey AS item_no, l_orderkey % 40 AS page, max((l_returnflag <> 'R')::INT) AS pro
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE {TRUE} GROUP BY 1, 2, 3),
c AS (SELECT o_custkey AS case_id, o_orderkey AS item_no, 't' || (o_orderkey % 6) AS thesis_id, o_orderkey % 3 AS priority FROM orders),
v AS (SELECT c.* FROM c JOIN e USING (case_id, item_no) WHERE pro = 1 AND thesis_id <> 't5'
  QUALIFY row_number() OVER (PARTITION BY case_id, thesis_id ORDER BY item_no) = 1)
SELECT case_id, item_no, thesis_id, 'inicial' AS support_level, row_number() OVER (PARTITION BY case_id ORDER BY priority, thesis_id) AS position FROM v""")
def k11(spark, sf):
    k = F.col("o_orderkey")
    claims = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), k.alias("item_no"),
                                               F.concat(F.lit("t"), (k % 6).cast("string")).alias("thesis_id"), (k % 3).alias("priority"))
    evidence = _claims(spark, sf).select(
        "case_id", F.col("source_id").alias("_k"), F.when(F.col("l_returnflag") != "R", "favoravel").otherwise("contraria").alias("side"),
        F.col("item_no").alias("quote_no"), "source_id", "quote").withColumnRenamed("_k", "item_no")
    catalog = spark.createDataFrame([(f"t{i}", f"Tese {i}") for i in range(5)], "thesis_id string, title string")
    return K.theses(claims, evidence, catalog, _sources(spark, sf)).select("case_id", "item_no", "thesis_id", "support_level", "position")


@query("k15_dossier_contradictions", f"""
SELECT o_custkey AS case_id, min(l_orderkey * 10 + l_linenumber)::BIGINT AS item_no, 'termo número ' || l_orderkey || ' que o réu (sic)' AS exact_a
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE {TRUE} GROUP BY o_custkey, l_orderkey
UNION ALL SELECT o_custkey, min(l_orderkey * 10 + l_linenumber)::BIGINT, 'réu' FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE {SHORT} GROUP BY o_custkey""")
def k15(spark, sf):
    claims = _claims(spark, sf).select(
        "case_id", (F.col("source_id") * 10 + F.col("item_no")).alias("item_no"), F.col("source_id").alias("source_a"), F.trim(F.replace("quote", F.lit('"'), F.lit(""))).alias("quote_a"),
        F.col("source_id").alias("source_b"), F.lit("FOI  ouvido").alias("quote_b"))
    return K.dossier_contradictions(claims, _sources(spark, sf)).select("case_id", "item_no", "exact_a")


@query("k16_audit_references", f"""
WITH r AS (SELECT DISTINCT o_custkey AS case_id, l_orderkey AS k, l_linenumber AS n, ({TRUE} OR {SHORT}) AS good FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT case_id, k * 10 + n AS item_no, CASE WHEN k % 7 = 6 THEN 'source_not_found' WHEN NOT good THEN 'source_excerpt_not_literal'
  WHEN k % 3 = 0 THEN 'source_confidence_mismatch' END AS code, k % 7 <> 6 AND good AND k % 3 <> 0 AND n <> 4 AS holds_literal FROM r""")
def k16_refs(spark, sf):
    return K.audit_references(*_audit_tables(spark, sf)[1:]).select("case_id", "item_no", "code", "holds_literal")


def _audit_tables(spark, sf):
    base = _claims(spark, sf).select("case_id", "source_id", F.col("item_no").alias("n"), "quote").distinct()
    k, n = F.col("source_id"), F.col("n")
    rows = base.select("case_id", F.element_at(F.array(*[F.lit(s) for s in K.SECTION_KEYS]), (k % 3 + 1).cast("int")).alias("section"),
                       (k * 10 + n).alias("item_no"), F.lit("").alias("part"), k.alias("k"), n, F.trim(F.replace("quote", F.lit('"'), F.lit(""))).alias("excerpt"))
    items = rows.select("case_id", "section", "item_no", "part", F.when(F.col("n") == 4, "outra coisa").otherwise("ouvido  NO dia").alias("literal"))
    refs = rows.select("case_id", "section", "item_no", "part", F.when(F.col("k") % 7 == 6, -1).otherwise(F.col("k")).alias("page_number"),
                       F.lit(0).alias("chunk_index"), "excerpt", F.lit("alta").alias("confidence"))
    chunks = _sources(spark, sf).withColumns({"page_number": F.col("source_id"), "chunk_index": F.lit(0)})
    status = F.when((F.col("c_custkey") % 11 == 0) & (F.col("s") == "contradicoes"), "erro").otherwise("concluido")
    sections = table(spark, sf, "customer").select("c_custkey", F.explode(F.array(*[F.lit(s) for s in K.SECTION_KEYS])).alias("s")).select(
        F.col("c_custkey").alias("case_id"), F.when(F.col("c_custkey") % 11 == 0, "parcial").otherwise("concluido").alias("dossier_status"),
        F.col("s").alias("section"), status.alias("status"), F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(3).alias("item_count"),
        (F.col("c_custkey") % 3).alias("open_fields"), (F.col("c_custkey") % 5).alias("open_gaps"))
    return sections, items, refs, chunks


AUDIT = f"""
r0 AS (SELECT DISTINCT o_custkey AS case_id, l_orderkey AS k, l_linenumber AS n, ({TRUE} OR {SHORT}) AS good FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
r AS (SELECT *, ['marcos_essenciais', 'depoimentos', 'contradicoes'][k % 3 + 1] AS section, CASE WHEN k % 7 = 6 THEN 'source_not_found' WHEN NOT good THEN 'source_excerpt_not_literal'
  WHEN k % 3 = 0 THEN 'source_confidence_mismatch' END AS code, k % 7 <> 6 AND good AND k % 3 <> 0 AND n <> 4 AS lit FROM r0 WHERE NOT (case_id % 11 = 0 AND k % 3 = 2)),
sec AS (SELECT c_custkey AS c, unnest(['marcos_essenciais', 'depoimentos', 'contradicoes']) AS section FROM customer),
f AS (SELECT case_id, section, 'erro' AS severity, code FROM r WHERE code IS NOT NULL
  UNION ALL SELECT case_id, section, 'erro', CASE section WHEN 'marcos_essenciais' THEN 'event_value_not_literal' WHEN 'depoimentos' THEN 'testimony_not_literal' ELSE 'contradiction_claim_not_literal' END FROM r WHERE NOT lit
  UNION ALL SELECT c, section, 'erro', 'section_not_completed' FROM sec WHERE c % 11 = 0 AND section = 'contradicoes'
  UNION ALL SELECT c, section, 'aviso', 'empty_section' FROM sec WHERE c % 2 = 0 AND section <> 'contradicoes'
  UNION ALL SELECT c, section, 'aviso', 'no_supported_contradiction' FROM sec WHERE c % 2 = 0 AND c % 11 <> 0 AND section = 'contradicoes'
  UNION ALL SELECT c, section, 'aviso', 'essential_fields_missing' FROM sec WHERE c % 3 > 0 AND section = 'marcos_essenciais'
  UNION ALL SELECT c, section, 'aviso', 'testimony_coverage_gaps' FROM sec WHERE c % 5 > 0 AND section = 'depoimentos')"""


@query("k16_audit_findings", "WITH" + AUDIT + " SELECT case_id, section, severity, code, count(*) AS n FROM f GROUP BY ALL")
def k16_findings(spark, sf):
    findings, _ = K.audit_dossiers(*_audit_tables(spark, sf))
    return findings.groupBy("case_id", "section", "severity", "code").agg(F.count(F.lit(1)).alias("n"))


@query("k16_audit_report", "WITH" + AUDIT + """
, n AS (SELECT case_id, count(*) FILTER (severity = 'erro') AS errors, count(*) FILTER (severity = 'aviso') AS warnings FROM f GROUP BY 1),
a AS (SELECT case_id, round(count(*) FILTER (code IS NULL) / count(*), 4) AS ra, round(count(*) FILTER (lit) / count(*), 4) AS la FROM r GROUP BY 1)
SELECT c_custkey AS case_id, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(ra, 1.0) AS reference_accuracy, coalesce(la, 1.0) AS literal_accuracy,
  CASE WHEN c_custkey % 11 = 0 OR coalesce(errors, 0) > 0 THEN 'falha_estrutural' WHEN coalesce(warnings, 0) > 0 THEN 'aprovado_com_revisao' ELSE 'aprovado_estruturalmente' END AS verdict
FROM customer LEFT JOIN n ON n.case_id = c_custkey LEFT JOIN a ON a.case_id = c_custkey""")
def k16_report(spark, sf):
    _, report = K.audit_dossiers(*_audit_tables(spark, sf))
    return report.select("case_id", "errors", "warnings", "reference_accuracy", "literal_accuracy", "verdict")


@query("k17_dossier_status", """
WITH s AS (SELECT l_orderkey AS case_id, l_linenumber AS n, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2)
SELECT case_id, CASE WHEN count(*) FILTER (f <> 'R') = 3 THEN 'concluido' WHEN count(*) FILTER (f <> 'R') > 0 THEN 'parcial' ELSE 'erro' END AS status,
  CASE WHEN count(*) FILTER (f <> 'R') = 3 THEN NULL WHEN count(*) FILTER (f <> 'R') > 0 THEN 'Uma ou mais secoes precisam ser tentadas novamente.'
    ELSE coalesce('falha ' || min(n) FILTER (n % 2 = 0), 'Nenhuma secao pode ser concluida.') END AS error_message FROM s GROUP BY 1""")
def k17(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("section_no")).agg(F.max("l_returnflag").alias("f"))
    bad = F.col("f") == "R"
    return K.dossier_status(rows.select(
        "case_id", "section_no", F.when(bad, "erro").otherwise("concluido").alias("status"),
        F.when(bad & (F.col("section_no") % 2 == 0), F.concat(F.lit("falha "), F.col("section_no").cast("string"))).otherwise("").alias("error_message")))


@query("k18_topic_batch_status", """
WITH t AS (SELECT o_custkey AS case_id, o_orderpriority AS topic, bool_or(o_orderstatus = 'F') AS done FROM orders GROUP BY 1, 2)
SELECT case_id, CASE WHEN bool_and(done) THEN 'concluido' WHEN bool_or(done) THEN 'parcial' ELSE 'erro' END AS status,
  coalesce(string_agg(topic, '|' ORDER BY topic) FILTER (NOT done), '') AS failed_topics FROM t GROUP BY 1""")
def k18(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("topic_id"), "o_orderstatus")
    return K.topic_batch_status(rows.select("case_id", "topic_id"), rows.where("o_orderstatus = 'F'"))


@query("k14_dossier_testimonies", f"""
WITH x AS (SELECT o_custkey AS case_id, l_orderkey AS k, l_orderkey // 8 AS item, l_linenumber AS n, l_linenumber % 2 = 0 AND l_orderkey % 4 <> 3 AND l_orderkey % 5 <> 4 AS good,
  (l_orderkey + l_linenumber % 2) % 4 <> 3 AND (l_orderkey + l_linenumber % 2) % 5 = 4 AS short FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT case_id, item AS item_no, count(*) FILTER (NOT good AND NOT short) AS invalid_quotes, count(*) FILTER (short) AS short_quotes,
  count(DISTINCT k) FILTER (good) AS excerpts FROM x GROUP BY 1, 2 HAVING count(*) FILTER (good) > 0""")
def k14(spark, sf):
    c = _claims(spark, sf)
    excerpts = c.select("case_id", F.floor(F.col("source_id") / 8).alias("item_no"), F.col("item_no").alias("excerpt_no"), "source_id",
                        F.trim(F.replace("quote", F.lit('"'), F.lit(""))).alias("quote"))
    claims = excerpts.select("case_id", "item_no").distinct().withColumns({
        "coverage": F.lit("Integral"), "start_found": F.lit(True), "end_found": F.lit(True)})
    return K.dossier_testimonies(claims, excerpts, _sources(spark, sf)).select("case_id", "item_no", "invalid_quotes", "short_quotes", "excerpts")


@query("k13_dossier_events", """
WITH rules AS (SELECT o_custkey AS case_id, o_orderkey AS n, 'recebimento_denuncia' AS t, o_orderpriority AS v FROM orders WHERE o_orderstatus = 'P'),
model AS (SELECT o_custkey AS case_id, o_orderkey AS n, 'prisao' AS t, strftime(o_orderdate, '%d/%m/%Y') AS v FROM orders WHERE o_orderkey % 3 <> 2)
SELECT case_id, 0::BIGINT AS origin, n AS item_no, t AS event_type, v AS value FROM rules UNION ALL SELECT case_id, 1, n, t, v FROM model
QUALIFY row_number() OVER (PARTITION BY case_id, t, v, n % 40 ORDER BY n) = 1""")
def k13(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    rules = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("case_id"), k.alias("event_no"), F.lit("recebimento_denuncia").alias("event_type"),
                                                  F.col("o_orderpriority").alias("value"), (k * 1000000).alias("page_number"))
    claims = o.select(F.col("o_custkey").alias("case_id"), k.alias("item_no"),
                      F.when(k % 3 == 0, "Prisao").when(k % 3 == 1, "prisao").otherwise("audiencia").alias("event_type"),
                      F.date_format("o_orderdate", "dd/MM/yyyy").alias("value"), F.lit("").alias("person"), k.alias("source_id"))
    return K.dossier_events(rules, claims, _sources(spark, sf)).select("case_id", "origin", "item_no", "event_type", "value")
