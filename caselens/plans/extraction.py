"""Decisions, testimonies and key events, on pages written from the orders so that the truth is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.functions.scratch import written
from caselens.operators import decisions as D
from caselens.operators import testimonies as T
from caselens.plans.inputs import table
from caselens.plans.registry import query

WORDS = ["dois", "três", "quatro", "vinte e um"]
VALUES = [2, 3, 4, 21]


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _pages(spark, sf, texts):
    """Pages 4k, 4k+1, ... of the customer's case for every order k."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("case_id"), k.alias("k"), F.posexplode(F.array(*texts)).alias("i", "text"),
        F.when(k % 10 == 9, "baixa").otherwise("alta").alias("source_confidence")).select(
        "case_id", (F.col("k") * 4 + F.col("i")).alias("page_number"), "text", "source_confidence", F.lit(False).alias("has_glued_words"))


def _decision_pages(spark, sf):
    """Heading, operative part, and a certificate (even orders) or a closing page (odd ones)."""
    k, s = F.col("o_orderkey"), lambda c: c.cast("string")
    guilty = F.concat(
        F.lit("Relatados.\nDiante do exposto, JULGO PROCEDENTE o pedido e CONDENO o réu como incurso no art. "), s(k % 50 + 120),
        F.lit(" do CP, conforme os fundamentos acima, que ficam fazendo parte integrante desta decisão para todos os fins de direito. Pena-base em "), _pick(WORDS, k % 4), F.lit(" anos de reclusão. Torno definitiva a pena em "), s(k % 9 + 1),
        F.lit(" (n) anos e "), s(k % 11 + 1), F.lit(" meses de reclusão, mais "), s(k % 90 + 10),
        F.lit(" dias-multa. Fixo o regime inicial "), _pick(["fechado", "semiaberto", "aberto"], k % 3), F.lit(". Substituo a pena privativa."))
    free = F.concat(F.lit("Isto posto, ABSOLVO o acusado da imputação do artigo "), s(k % 50 + 120), F.lit("."))
    end = F.when(k % 2 == 0, F.concat(F.lit("CERTIDÃO DE TRÂNSITO EM JULGADO\nCertifico que transitou em julgado para "),
                                      F.when(k % 4 == 0, "ambas as partes").otherwise("a defesa"), F.lit(" em "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("."))
                 ).otherwise("Publique-se. Deixo de conceder o sursis.")
    return _pages(spark, sf, [F.concat(F.lit("PODER JUDICIÁRIO\nS E N T E N Ç A\nAutos "), s(k)), F.when(k % 6 == 0, free).otherwise(guilty), end])


def _docs(spark, sf):
    return D.decision_documents(_decision_pages(spark, sf))


STARTS = """
st AS (SELECT o_custkey AS case_id, o_orderkey AS k, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)"""


@query("x07_decision_starts", "WITH" + STARTS + " SELECT case_id, k * 4 AS page_number, 'sentenca' AS decision_type, n AS decision_no FROM st")
def x07(spark, sf):
    return D.decision_starts(_decision_pages(spark, sf))


@query("x08_disposition", "WITH" + STARTS + """
SELECT case_id, k * 4 AS start_page, CASE WHEN k % 6 = 0 THEN 'Isto posto, AB' ELSE 'Diante do expo' END AS head,
  CASE WHEN k % 2 = 0 THEN (k * 4 + 1)::VARCHAR ELSE (k * 4 + 1) || '|' || (k * 4 + 2) END AS pages FROM st""")
def x08(spark, sf):
    return D.disposition(_docs(spark, sf)).select(
        "case_id", "start_page", F.substring("disposition.text", 1, 14).alias("head"), F.col("disposition.pages").alias("pages"))


@query("x09_decision_result", """
SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'mista' WHEN 1 THEN 'condenatoria' WHEN 2 THEN 'absolutoria' ELSE 'nao_identificado' END AS result FROM orders""")
def x09(spark, sf):
    text = _pick(["Condeno A e absolvo B", "resolvo CONDENAR o réu", "Absolvo.", "Condenação mantida; absolvição negada"], F.col("o_orderkey") % 4)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), D.decision_result(text).alias("result"))


@query("x10_penalties", "WITH" + STARTS + """
SELECT case_id, k * 4 AS start_page, 'base' AS phase, [2, 3, 4, 21][k % 4 + 1]::BIGINT AS years, 0::BIGINT AS months, k * 4 + 1 AS page_number FROM st WHERE k % 6 <> 0
UNION ALL SELECT case_id, k * 4, 'definitiva', k % 9 + 1, k % 11 + 1, k * 4 + 1 FROM st WHERE k % 6 <> 0""")
def x10(spark, sf):
    return D.penalties(_docs(spark, sf)).select("case_id", "start_page", "phase", "years", "months", "page_number")


@query("x11_number_words", """
SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 22 WHEN 1 THEN 12 WHEN 2 THEN 100 END::BIGINT AS n FROM orders""")
def x11(spark, sf):
    text = _pick(["vinte e dois", "12 (doze)", " cem ", "vinte e algo"], F.col("o_orderkey") % 4)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), D.number_words(text).alias("n"))


@query("x12_day_fine", "WITH" + STARTS + " SELECT case_id, k * 4 AS start_page, k % 90 + 10 AS day_fine, k * 4 + 1 AS page_number FROM st WHERE k % 6 <> 0")
def x12(spark, sf):
    return D.day_fine(_docs(spark, sf)).select("case_id", "start_page", "day_fine", "page_number")


@query("x13_regime", "WITH" + STARTS + """
SELECT case_id, k * 4 AS start_page, ['fechado', 'semiaberto', 'aberto'][k % 3 + 1] AS regime, k * 4 + 1 AS page_number FROM st WHERE k % 6 <> 0""")
def x13(spark, sf):
    return D.regime(_docs(spark, sf)).select("case_id", "start_page", "regime", "page_number")


@query("x14_binary_decision", "WITH" + STARTS + """
SELECT case_id, k * 4 AS start_page, CASE WHEN k % 6 <> 0 THEN 'deferida' ELSE 'nao_localizada' END AS substitution,
  CASE WHEN k % 2 = 1 THEN 'indeferida' ELSE 'nao_localizada' END AS suspension FROM st""")
def x14(spark, sf):
    docs = _docs(spark, sf)
    a = D.binary_decision(docs, *D.SUBSTITUTION).select(*D.DOC, F.col("result").alias("substitution"))
    return a.join(D.binary_decision(docs, *D.SUSPENSION).select(*D.DOC, F.col("result").alias("suspension")), D.DOC)


@query("x15_applied_articles", "WITH" + STARTS + """
SELECT case_id, k * 4 AS start_page, CASE WHEN k % 6 = 0 THEN 'artigo ' ELSE 'art. ' END || (k % 50 + 120) AS article, k * 4 + 1 AS page_number FROM st""")
def x15(spark, sf):
    return D.applied_articles(D.disposition(_docs(spark, sf))).select("case_id", "start_page", "article", "page_number")


@query("x16_final_judgments", """
SELECT o_custkey AS case_id, CASE WHEN o_orderkey % 4 = 0 THEN 'ambas_partes' ELSE 'defesa' END AS scope, o_orderdate::DATE::VARCHAR AS value,
  min(o_orderkey * 4 + 2) AS page_number FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2, 3""")
def x16(spark, sf):
    return D.final_judgments(_decision_pages(spark, sf)).select("case_id", "scope", "value", "page_number")


@query("x17_decisions", "WITH" + STARTS + """
SELECT case_id, k * 4 AS start_page, CASE WHEN k % 2 = 0 THEN k * 4 + 1 ELSE k * 4 + 2 END AS end_page, CASE WHEN k % 6 = 0 THEN 'absolutoria' ELSE 'condenatoria' END AS result,
  CASE WHEN k % 6 = 0 THEN 0 ELSE 2 END::BIGINT AS n_penalties, k % 10 = 9 AS review_required FROM st""")
def x17(spark, sf):
    found = D.decisions(written(_decision_pages(spark, sf), "pages"))
    return found.select("case_id", "start_page", "end_page", "result", F.coalesce(F.size("penalties"), F.lit(0)).alias("n_penalties"), "review_required")


@query("x17_structure_status", "WITH" + STARTS + """
SELECT c_custkey AS case_id, CASE WHEN count(k) = 0 THEN 'nao_localizada' WHEN bool_or(k % 10 = 9) THEN 'revisao_necessaria' ELSE 'concluido' END AS structure_status
FROM customer LEFT JOIN st ON case_id = c_custkey GROUP BY 1""")
def x17_status(spark, sf):
    cases = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"))
    return D.structure_status(cases, D.decisions(written(_decision_pages(spark, sf), "pages")))


def _testimony_pages(spark, sf):
    """k % 3: 0 a closed two-page form, 1 a form without end, 2 an interrogation that another document cuts off."""
    k, s = F.col("o_orderkey"), lambda c: c.cast("string")
    name = F.translate(s(k), "0123456789", "ABCDEFGHIJ")
    witness = F.concat(F.lit("POLÍCIA CIVIL - DELEGACIA DE POLÍCIA\nTERMO DE DEPOIMENTO\nTestemunha: MARIA "), name, F.lit("x DA SILVA, brasileira, residente\nDisse: que viu o fato "), s(k),
                       F.when(k % 3 == 0, ".\nPag. 1 de 2").otherwise("."))
    accused = F.concat(F.lit("INQUÉRITO\nTermo de interrogatório\nInterrogado: JOÃO "), name, F.lit("Y; filho de A\nRespondeu que nada sabe de "), s(k), F.lit("."))
    more = F.when(k % 3 == 0, F.concat(F.lit("Segue o relato "), s(k), F.lit(". Nada mais disse nem lhe foi perguntado."))).when(
        k % 3 == 1, "Continua a fala.").otherwise("LAUDO PERICIAL de local")
    return _pages(spark, sf, [F.when(k % 3 == 2, accused).otherwise(witness), more])


@query("x18_testimony_starts", """
SELECT o_custkey AS case_id, o_orderkey * 4 AS page_number, CASE WHEN o_orderkey % 3 = 2 THEN 'interrogatorio_reu' ELSE 'depoimento_testemunha' END AS document_type,
  CASE WHEN o_orderkey % 3 = 2 THEN 'reu' ELSE 'testemunha' END AS role FROM orders""")
def x18(spark, sf):
    return T.testimony_starts(_testimony_pages(spark, sf)).select("case_id", "page_number", "document_type", "role")


@query("x19_testimony_pages", """
SELECT o_custkey AS case_id, o_orderkey * 4 AS start_page, o_orderkey * 4 + i AS page_number, CASE WHEN o_orderkey % 3 = 0 THEN 'integral' ELSE 'parcial' END AS coverage
FROM orders, (SELECT unnest([0, 1]) AS i) WHERE i = 0 OR o_orderkey % 3 <> 2""")
def x19(spark, sf):
    pages = _testimony_pages(spark, sf)
    return T.testimony_pages(pages, T.testimony_starts(pages)).select("case_id", "start_page", "page_number", "coverage")


@query("x20_identify_person", """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 2 THEN 'JOÃO ' || translate(o_orderkey::VARCHAR, '0123456789', 'ABCDEFGHIJ') || 'Y'
  ELSE 'MARIA ' || translate(o_orderkey::VARCHAR, '0123456789', 'ABCDEFGHIJ') || 'x DA SILVA' END AS name, 'rotulo_cabecalho' AS method FROM orders""")
def x20(spark, sf):
    found = T.testimonies(written(_testimony_pages(spark, sf), "pages"))
    return found.select(F.expr("start_page div 4").alias("k"), F.col("person.name").alias("name"), F.col("person.method").alias("method"))


@query("x21_speech_body", """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'segmentada' ELSE 'revisao_necessaria' END AS body_status,
  CASE o_orderkey % 3 WHEN 0 THEN 'Disse: que viu o fato ' || o_orderkey || '.' || chr(10) || 'Pag. 1 de 2|Segue o relato ' || o_orderkey || '.'
    WHEN 1 THEN 'Disse: que viu o fato ' || o_orderkey || '.|Continua a fala.' ELSE 'Respondeu que nada sabe de ' || o_orderkey || '.' END AS speech FROM orders""")
def x21(spark, sf):
    found = T.testimonies(written(_testimony_pages(spark, sf), "pages"))
    return found.select(F.expr("start_page div 4").alias("k"), "body_status", F.transform("segments", lambda s: s["text"]).alias("speech"))


@query("x22_testimonies", """
SELECT o_custkey AS case_id, 'dep-p' || CASE WHEN o_orderkey * 4 < 1000 THEN lpad((o_orderkey * 4)::VARCHAR, 4, '0') ELSE (o_orderkey * 4)::VARCHAR END || '-'
    || CASE WHEN o_orderkey % 3 = 2 THEN 'interrogatorio_reu' ELSE 'depoimento_testemunha' END AS testimony_id,
  'inquerito' AS phase, NOT (o_orderkey % 3 = 0 AND o_orderkey % 10 <> 9) AS review_required FROM orders""")
def x22(spark, sf):
    return T.testimonies(written(_testimony_pages(spark, sf), "pages")).select("case_id", "testimony_id", "phase", "review_required")


@query("x22_transcription_status", """
SELECT c_custkey AS case_id, CASE WHEN count(o_orderkey) = 0 THEN 'sem_depoimentos' WHEN bool_or(NOT (o_orderkey % 3 = 0 AND o_orderkey % 10 <> 9)) THEN 'revisao_necessaria'
  ELSE 'concluido' END AS transcription_status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def x22_status(spark, sf):
    cases = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"))
    return T.transcription_status(cases, T.testimonies(written(_testimony_pages(spark, sf), "pages")))


@query("x06_key_events", """
WITH o AS (SELECT *, strftime(o_orderdate, '%d/%m/%Y') AS d FROM orders)
SELECT o_custkey AS case_id, 1::BIGINT AS rule_no, arg_min(d, o_orderkey) AS value, min(o_orderkey) AS page_number FROM o WHERE o_orderkey % 3 = 0 GROUP BY 1
UNION ALL SELECT o_custkey, 2, arg_min(d, o_orderkey), min(o_orderkey) FROM o WHERE o_orderkey % 3 = 1 GROUP BY 1
UNION ALL SELECT o_custkey, 6, d || ' às 14:30h', o_orderkey FROM o WHERE o_orderkey % 3 = 2""")
def x06(spark, sf):
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "dd/MM/yyyy")
    text = (F.when(k % 3 == 0, F.concat(F.lit("O réu, Nascido aos "), d)).when(k % 3 == 1, F.concat(F.lit("RECEBO A DENÚNCIA.\nCumpra-se, liberado nos autos em "), d))
            .otherwise(F.concat(F.lit("Data e hora da Audiência: "), d, F.lit(" às 14:30h"))))
    hits = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), k.alias("rank"), k.alias("page_number"), text.alias("text"))
    return T.key_events(hits).select("case_id", "rule_no", "value", "page_number")


@query("k12_judgment_sources", "WITH" + STARTS + """,
ok AS (SELECT * FROM st WHERE k % 10 <> 9),
final AS (SELECT o_custkey AS case_id, arg_min(o_orderkey, o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey, o_orderkey % 4 = 0, o_orderdate::DATE)
SELECT case_id, 'dispositivo_sentenca' AS origin, 'dispositivo' AS part, k * 4 + 1 AS page_number FROM ok
UNION ALL SELECT case_id, 'pena_aplicada', 'pena_aplicada-' || i, k * 4 + 1 FROM ok, (SELECT unnest([1, 2]) AS i) WHERE k % 6 <> 0
UNION ALL SELECT case_id, 'artigo_sentenca', 'artigo_sentenca-1', k * 4 + 1 FROM ok
UNION ALL SELECT case_id, u.o, u.p, k * 4 + 1 FROM ok, (SELECT unnest([{'o': 'multa', 'p': 'multa'}, {'o': 'regime_inicial', 'p': 'regime_inicial'}, {'o': 'substituicao_pena', 'p': 'substituicao_pena'}]) AS u) WHERE k % 6 <> 0
UNION ALL SELECT case_id, 'sursis', 'sursis', k * 4 + 2 FROM ok WHERE k % 2 = 1
UNION ALL SELECT case_id, 'transito_em_julgado', 'transito', k * 4 + 2 FROM final WHERE k % 10 <> 9""")
def k12(spark, sf):
    from caselens.operators.evidence import judgment_sources

    pages = written(_decision_pages(spark, sf), "pages")
    found = D.decisions(pages)
    one = lambda c: F.when(F.col(f"{c}.page_number").isNotNull(), F.struct(
        F.col(f"{c}.excerpt").alias("excerpt"), F.array(F.col(f"{c}.page_number").cast("int")).alias("pages"))).alias(c)
    many = lambda c: F.transform(c, lambda v: F.struct(v["excerpt"].alias("excerpt"), F.array(v["page_number"].cast("int")).alias("pages"))).alias(c)
    shaped = found.select(
        "case_id", "decision_id", "source_confidence",
        F.struct(F.col("disposition.text").alias("excerpt"), F.col("disposition.pages").cast("array<int>").alias("pages")).alias("disposition"),
        many("penalties"), many("articles"), one("fine"), one("regime"), one("substitution"), one("suspension"))
    certificates = D.final_judgments(pages).select(
        "case_id", "source_confidence", F.col("page_number").alias("certificate_no"), "excerpt", F.array(F.col("page_number").cast("int")).alias("pages"))
    part = F.when(F.col("origin") == "transito_em_julgado", "transito").otherwise(F.regexp_extract("source_id", "^dec-[0-9a-f]+-(.*)$", 1))
    return judgment_sources(shaped, certificates).select("case_id", "origin", part.alias("part"), F.element_at("pages", 1).alias("page_number"))
