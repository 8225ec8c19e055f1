"""Grounding of answers and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.functions.numbering import top_per_key
from caselens.operators import evaluation as B
from caselens.operators import grounding as G
from caselens.plans import inputs as I
from caselens.plans.inputs import CHUNKS_CTE, table
from caselens.plans.registry import query

# Assistant turns of the conversations, with citations and set phrases added by turn number.
TAILS = [" Nao consta. ver [p. 1, 7 e 9]", " [pag. 12]", " deve ser confirmado, nao ha base suficiente", " [pp. 3-5]", ""]
ANSWERS = f"""
answers AS (
  SELECT conv_id AS case_id, turn AS seq, text || ' [p. ' || (turn % 4) || ']'
    || (CASE conv_id % 5 WHEN 0 THEN '{TAILS[0]}' WHEN 1 THEN '{TAILS[1]}' WHEN 2 THEN '{TAILS[2]}' WHEN 3 THEN '{TAILS[3]}' ELSE '' END)
    || chr(10) || '- ' || text || chr(10) || '2. ' || text AS content,
    CASE WHEN conv_id % 3 = 0 THEN [1, 2, 3, 7, 9] WHEN conv_id % 3 = 1 THEN [0, 1, 2, 3, 5, 12] ELSE []::INT[] END AS source_pages
  FROM conversations WHERE role = 'assistant')"""


def _answers(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    tail = F.element_at(F.array(*[F.lit(t) for t in TAILS]), (F.col("conv_id") % 5 + 1).cast("int"))
    ints = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<int>")
    third = F.col("conv_id") % 3
    return c.select(
        F.col("conv_id").alias("case_id"), F.col("turn").alias("seq"),
        F.concat("text", F.lit(" [p. "), (F.col("turn") % 4).cast("string"), F.lit("]"), tail,
                 F.lit("\n- "), F.col("text"), F.lit("\n2. "), F.col("text")).alias("content"),
        F.when(third == 0, ints(1, 2, 3, 7, 9)).when(third == 1, ints(0, 1, 2, 3, 5, 12)).otherwise(ints()).alias("source_pages"))


CITED = """
cited AS (SELECT *, list_sort(list_distinct(list_transform(list_concat(
    regexp_extract_all(content, '(?i)\\[?\\s*(?:p|pag|pagina)\\.?\\s*(\\d+)\\s*\\]?', 1),
    flatten(list_transform(regexp_extract_all(content, '(?i)\\[\\s*(?:p|pp|pag|pagina)s?\\.?\\s*([0-9][0-9,\\s;e-]*)\\]', 1),
      lambda b: regexp_extract_all(b, '\\d+')))), lambda x: x::BIGINT))) AS cited FROM answers),
lined AS (SELECT *, list_filter(list_transform(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)),
    lambda x: x <> '' AND NOT starts_with(x, '#')), lambda x: trim(regexp_replace(x, '^[*\\-\\d.\\s]+', ''))),
    lambda x: length(x) >= 45 AND regexp_matches(x, '[A-Za-z]')) AS claims FROM cited),
covered AS (SELECT *, len(claims)::BIGINT AS claim_lines,
    len(list_filter(claims, lambda x: regexp_matches(x, '(?i)\\[?\\s*(?:p|pag|pagina)\\.?\\s*(\\d+)\\s*\\]?')))::BIGINT AS cited_claim_lines FROM lined),
rated AS (SELECT *, CASE WHEN claim_lines = 0 THEN 0.0 ELSE round(cited_claim_lines / claim_lines, 4) END AS citation_coverage,
    list_filter(cited, lambda x: NOT list_contains(source_pages, x)) AS unsupported,
    contains(lower(content), 'nao encontrei base suficiente') OR contains(lower(content), 'nao ha base suficiente') AS no_source_answer FROM covered)"""


def _count_sql(phrase: str) -> str:
    return f"(len(string_split(lower(content), '{phrase}')) - 1)"


CAUTION = "(" + " + ".join(_count_sql(p) for p in G.CAUTION_PHRASES) + ")::BIGINT"


@query("g01_cited_pages", "WITH" + ANSWERS + "," + CITED + """
SELECT case_id, seq, array_to_string(cited, '|') AS cited_pages FROM cited""")
def g01(spark, sf):
    return G.cited_pages(_answers(spark, sf)).select("case_id", "seq", "cited_pages")


@query("g02_citation_coverage", "WITH" + ANSWERS + "," + CITED + """
SELECT case_id, seq, claim_lines, cited_claim_lines, citation_coverage::DOUBLE AS citation_coverage FROM rated""")
def g02(spark, sf):
    return G.citation_coverage(_answers(spark, sf)).select("case_id", "seq", "claim_lines", "cited_claim_lines", "citation_coverage")


RISK = """CASE WHEN len(unsupported) > 0 THEN 'alto' WHEN no_source_answer THEN 'baixo'
  WHEN claim_lines >= 3 AND citation_coverage < 0.35 THEN 'alto' WHEN claim_lines >= 3 AND citation_coverage < 0.65 THEN 'medio' ELSE 'baixo' END"""


@query("g03_g04_grounding", "WITH" + ANSWERS + "," + CITED + f"""
SELECT case_id, seq, array_to_string(unsupported, '|') AS unsupported_pages, {CAUTION} AS uncertainty_markers, no_source_answer,
  {RISK} AS rule_risk, array_to_string(list_filter([
    CASE WHEN len(source_pages) = 0 AND NOT no_source_answer THEN 'resposta sem fontes recuperadas' END,
    CASE WHEN len(unsupported) > 0 THEN 'citou pagina que nao veio das fontes recuperadas' END,
    CASE WHEN claim_lines >= 3 AND citation_coverage < 0.65 THEN 'muitas linhas afirmativas sem citacao de pagina' END,
    CASE WHEN {CAUTION} > 0 THEN 'usa linguagem de cautela ou confirma lacunas' END,
    CASE WHEN no_source_answer THEN 'resposta declarou falta de base suficiente' END], lambda x: x IS NOT NULL), '|') AS notes FROM rated""")
def g03(spark, sf):
    return G.grounding(_answers(spark, sf)).select(
        "case_id", "seq", "unsupported_pages", "uncertainty_markers", "no_source_answer", "rule_risk", "notes")


CALIBRATED = f"""
judged AS (SELECT case_id, seq, {RISK} AS rule_risk, CASE seq % 4 WHEN 1 THEN 'alto' WHEN 3 THEN 'medio' WHEN 2 THEN 'baixo' END AS judge_risk FROM rated),
calibrated AS (SELECT *, CASE WHEN judge_risk IS NULL THEN rule_risk WHEN rule_risk = 'alto' THEN 'alto'
  WHEN judge_risk = 'alto' AND rule_risk = 'baixo' THEN 'revisao_manual' WHEN judge_risk = 'alto' THEN 'alto'
  WHEN judge_risk = 'medio' OR rule_risk = 'medio' THEN 'medio' ELSE 'baixo' END AS calibrated_risk FROM judged)"""


def _judged(spark, sf):
    turn = F.col("seq") % 4
    return G.calibrated_risk(G.grounding(_answers(spark, sf)).withColumn(
        "judge_risk", F.when(turn == 1, "alto").when(turn == 3, "medio").when(turn == 2, "baixo")))


@query("g05_calibrated_risk", "WITH" + ANSWERS + "," + CITED + "," + CALIBRATED + " SELECT case_id, seq, calibrated_risk FROM calibrated")
def g05(spark, sf):
    return _judged(spark, sf).select("case_id", "seq", "calibrated_risk")


@query("g06_parse_judgements", """
WITH r AS (SELECT event_id, value, event_type, event_id % 4 AS k FROM events)
SELECT event_id, CASE WHEN k = 3 THEN 1 ELSE greatest(1, least(5, floor(value)))::BIGINT END AS fidelidade_fontes,
  CASE WHEN k = 3 THEN 'indefinido' ELSE event_type END AS risco_alucinacao,
  CASE WHEN k = 3 THEN '' ELSE 'a|' || event_type END AS problemas,
  CASE WHEN k = 3 THEN 'avaliador retornou JSON invalido' END AS error FROM r""")
def g06(spark, sf):
    body = F.format_string('{"fidelidade_fontes": %s, "risco_alucinacao": "%s", "problemas": ["a", " ", "%s"]}',
                           F.floor("value").cast("string"), "event_type", "event_type")
    kind = F.col("event_id") % 4
    reply = (F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Segue:\n```json\n"), body, F.lit("\n```\nfim {x}")))
             .when(kind == 2, F.concat(F.lit("resultado "), body, F.lit(" ok"))).otherwise(F.concat(body, body)))
    return G.parse_judgements(table(spark, sf, "events").select("event_id", reply.alias("raw_response"))).select(
        "event_id", "fidelidade_fontes", "risco_alucinacao", "problemas", "error")


@query("g07_answer_report", "WITH" + ANSWERS + "," + CITED + "," + CALIBRATED + """
SELECT case_id % 7 AS grp, coalesce(round(avg(1 + seq % 5) FILTER (seq % 6 <> 5 AND judge_risk IS NOT NULL), 4), 0.0) AS average_fidelidade_fontes,
  count(*) FILTER (judge_risk = 'alto') AS high_risk_count, count(*) FILTER (calibrated_risk = 'alto') AS calibrated_high_risk_count,
  count(*) FILTER (calibrated_risk = 'revisao_manual') AS manual_review_count FROM calibrated GROUP BY 1""")
def g07(spark, sf):
    rows = _judged(spark, sf).withColumns({
        "grp": F.col("case_id") % 7, "error": F.when(F.col("seq") % 6 == 5, "x"),
        **{s: 1 + F.col("seq") % 5 for s in G.SCORES}})
    return G.answer_report(rows, ["grp"]).select(
        "grp", "average_fidelidade_fontes", "high_risk_count", "calibrated_high_risk_count", "manual_review_count")


@query("g08_abstention", """
WITH h AS (SELECT o_orderkey AS query_id, count(l_orderkey) AS n, count(*) FILTER (l_returnflag <> 'R') AS safe,
  count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS usable
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT query_id, CASE WHEN n = 0 THEN 'sem_fontes' WHEN safe = 0 THEN 'fontes_adversariais' WHEN usable = 0 THEN 'baixa_confianca'
  ELSE 'respondivel' END AS reason FROM h""")
def g08(spark, sf):
    hits = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), (F.col("l_returnflag") == "R").alias("hostile"),
        F.when(F.col("l_linestatus") == "F", "alta").otherwise("baixa").alias("source_confidence"))
    queries = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"))
    return G.abstention(queries, hits).select("query_id", "reason")


@query("g09_notices", """
SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || 'Aviso de seguranca: trechos potencialmente adversariais foram desconsiderados em [p. '
    || conv_id || '], [p. ' || turn || '].' ELSE '' END
  || CASE WHEN turn % 3 = 0 THEN chr(10) || chr(10) || 'Aviso de extracao: fontes de baixa confianca ou ainda nao classificadas foram desconsideradas em [p. '
    || turn || '].' ELSE '' END
  || CASE WHEN role = 'user' THEN chr(10) || chr(10) || 'Limite de cobertura: esta resposta usa os trechos mais relevantes recuperados e nao garante uma leitura integral de todas as paginas.'
    ELSE '' END AS decorated FROM conversations""")
def g09(spark, sf):
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("text").alias("answer"),
        F.when(F.col("role") == "user", "Faca a Análise completa").otherwise("Qual?").alias("question"),
        F.when(F.col("turn") % 2 == 0, F.array("conv_id", "turn")).otherwise(F.array().cast("array<bigint>")).alias("flagged_pages"),
        F.when(F.col("turn") % 3 == 0, F.array("turn")).otherwise(F.array().cast("array<bigint>")).alias("excluded_pages"))
    return G.notices(rows).select("conv_id", "turn", "decorated")


@query("g10_answer_log", """
WITH hits AS (SELECT conv_id, turn, unnest([turn % 3, turn % 2, conv_id % 5]) AS page FROM conversations WHERE role = 'assistant'),
sets AS (SELECT conv_id, turn, string_agg(DISTINCT page::VARCHAR, '|' ORDER BY page::VARCHAR) AS pages FROM hits GROUP BY 1, 2)
SELECT conv_id AS case_id, turn AS seq, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position,
  coalesce(pages, '') AS retrieved_pages FROM conversations LEFT JOIN sets USING (conv_id, turn)""")
def g10(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("seq"), "role")
    hits = c.where("role = 'assistant'").select(
        "case_id", "seq", F.explode(F.array(F.col("seq") % 3, F.col("seq") % 2, F.col("case_id") % 5)).alias("page_number"))
    return G.answer_log(c, hits)


@query("g11_latency_summary", """
WITH t AS (SELECT user_id AS case_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT case_id, first(value) FILTER (n = 1) AS first_ms, round(coalesce(median(value) FILTER (n > 1), first(value) FILTER (n = 1)), 4) AS warm_ms,
  round(50.0 + first(value) FILTER (n = 1) + 20.0, 4) AS cold_total,
  round(round(coalesce(median(value) FILTER (n > 1), first(value) FILTER (n = 1)), 4) + 20.0, 4) AS warm_total FROM t GROUP BY 1""")
def g11(spark, sf):
    timings = table(spark, sf, "events").select(
        F.col("user_id").alias("case_id"), F.struct("ts", "event_id").alias("run_order"), F.col("value").alias("latency"))
    return G.latency_summary(timings, 50.0, 20.0)


# Orders as questions, their dearest five lines as hits.
HITS = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber, l_suppkey) AS rank FROM lineitem),
hits AS (SELECT l_orderkey AS case_id, rank, l_suppkey AS page_number, p_name AS text FROM ranked JOIN part ON p_partkey = l_partkey WHERE rank <= 5),
cases AS (SELECT o_orderkey AS case_id, o_orderpriority AS model, coalesce(pages, []) AS expected_pages,
  CASE WHEN o_orderpriority LIKE '1%' THEN ['Red', 'WIDGET'] WHEN o_orderpriority LIKE '2%' THEN ['small'] WHEN o_orderpriority LIKE '3%' THEN []::VARCHAR[]
    ELSE ['ring', 'blue', 'red'] END AS expected_terms
  FROM orders LEFT JOIN (SELECT l_orderkey, list(DISTINCT l_suppkey) AS pages FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey),
found AS (SELECT case_id, min(rank) AS first FROM hits JOIN cases USING (case_id) WHERE list_contains(expected_pages, page_number) GROUP BY 1),
texts AS (SELECT case_id, lower(string_agg(text, ' ' ORDER BY rank)) AS t FROM hits GROUP BY 1),
parts AS (SELECT c.*, coalesce(round(1.0 / first, 4), 0)::DOUBLE AS reciprocal_rank, first IS NOT NULL AS hit,
  CASE WHEN len(expected_terms) = 0 THEN 0.0 ELSE len(list_filter(expected_terms, lambda x: contains(coalesce(t, ''), lower(x)))) / len(expected_terms) END AS term_score
  FROM cases c LEFT JOIN found USING (case_id) LEFT JOIN texts USING (case_id)),
scored AS (SELECT *, round(0.7 * hit::INT::DOUBLE + 0.3 * term_score, 4) AS score FROM parts)"""


def _hits_and_cases(spark, sf):
    li = table(spark, sf, "lineitem")
    top = top_per_key(li, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")], 5)
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("text"))
    hits = top.join(part, "l_partkey").select(F.col("l_orderkey").alias("case_id"), "rank", F.col("l_suppkey").alias("page_number"), "text")
    pages = li.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_set("l_suppkey").alias("expected_pages"))
    text = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    p = F.col("o_orderpriority").substr(1, 1)
    cases = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("model"),
        F.when(p == "1", text("Red", "WIDGET")).when(p == "2", text("small")).when(p == "3", text())
        .otherwise(text("ring", "blue", "red")).alias("expected_terms")).join(pages, "case_id", "left")
    return hits, cases.withColumn("expected_pages", F.coalesce("expected_pages", F.array().cast("array<bigint>")))


def _scored(spark, sf):
    return B.score_retrieval(*_hits_and_cases(spark, sf))


@query("b01_score_retrieval", "WITH" + HITS + " SELECT case_id, hit, reciprocal_rank, term_score, score FROM scored")
def b01(spark, sf):
    return _scored(spark, sf).select("case_id", "hit", "reciprocal_rank", "term_score", "score")


@query("b02_leaderboard", "WITH" + HITS + """
, m AS (SELECT model, round(avg(score), 4) AS average_score, round(avg(hit::INT), 4) AS hit_rate, round(avg(reciprocal_rank), 4) AS mrr FROM scored GROUP BY 1)
SELECT *, (average_score, mrr) = (SELECT max((average_score, mrr)) FROM m) AS is_best FROM m""")
def b02(spark, sf):
    return B.leaderboard(_scored(spark, sf))


SCORED_ANSWERS = """
exp AS (SELECT *, [0, 1, 12] AS expected_pages, ['la', 'the', 'xyzw'] AS expected_terms,
  CASE WHEN seq % 6 = 5 THEN 'x' END AS error, 'm' || (case_id % 3) AS model FROM cited),
graded AS (SELECT case_id, seq, model, error, CASE WHEN error IS NOT NULL THEN 0.0 ELSE round(
  0.55 * (len(list_intersect(cited, expected_pages)) / 3) + 0.45 * (len(list_filter(expected_terms,
    lambda t: contains(trim(regexp_replace(strip_accents(lower(content)), '\\s+', ' ', 'g')), t))) / 3), 4) END AS score FROM exp)"""


def _graded_answers(spark, sf):
    answers = _answers(spark, sf).withColumns({
        "error": F.when(F.col("seq") % 6 == 5, "x"), "model": F.concat(F.lit("m"), (F.col("case_id") % 3).cast("string"))})
    cases = answers.select("case_id").distinct().withColumns({
        "expected_pages": F.array(F.lit(0), F.lit(1), F.lit(12)), "expected_terms": F.array(F.lit("la"), F.lit("the"), F.lit("xyzw"))})
    return B.score_answers(answers, cases)


@query("b03_score_answers", "WITH" + ANSWERS + "," + CITED + "," + SCORED_ANSWERS + " SELECT case_id, seq, score FROM graded")
def b03(spark, sf):
    return _graded_answers(spark, sf).select("case_id", "seq", "score")


@query("b03_best_answer_model", "WITH" + ANSWERS + "," + CITED + "," + SCORED_ANSWERS + """
SELECT model, avg(score) AS mean_score FROM graded WHERE error IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def b03_best(spark, sf):
    return B.best_answer_model(_graded_answers(spark, sf))


# The routed variant is the answer of the order seven keys further on.
VARIANTS = """
vs AS (SELECT case_id, hit, reciprocal_rank, round(0.6 * hit::INT::DOUBLE + 0.25 * reciprocal_rank + 0.15 * round(term_score, 4), 4) AS score, case_id % 97 AS latency FROM scored),
compared AS (SELECT a.case_id, a.hit AS raw_hit, b.hit AS routed_hit, a.reciprocal_rank AS raw_rr, b.reciprocal_rank AS routed_rr,
  a.score AS raw_score, b.score AS routed_score, a.latency AS raw_latency, b.latency AS routed_latency, round(b.score - a.score, 4) AS score_delta
  FROM vs a JOIN vs b ON b.case_id = a.case_id + 7),
judged_v AS (SELECT *, CASE WHEN score_delta > 0.0001 THEN 'melhorou' WHEN score_delta < -0.0001 THEN 'piorou' ELSE 'empatou' END AS outcome FROM compared)"""


def _compared(spark, sf):
    scored = _scored(spark, sf).withColumn("latency_ms", F.col("case_id") % 97)
    return B.compare_variants(scored, scored.withColumn("case_id", F.col("case_id") - 7))


@query("b04_compare_variants", "WITH" + HITS + "," + VARIANTS + " SELECT case_id, raw_score, routed_score, score_delta, outcome FROM judged_v")
def b04(spark, sf):
    return _compared(spark, sf).select("case_id", "raw_score", "routed_score", "score_delta", "outcome")


REPORTS = """
reports AS (SELECT case_id % 20 AS process, count(*) AS total_cases, round(avg(raw_hit::INT), 4) AS raw_hit_rate, round(avg(routed_hit::INT), 4) AS routed_hit_rate,
  round(avg(raw_rr), 4) AS raw_mrr, round(avg(routed_rr), 4) AS routed_mrr, round(avg(raw_score), 4) AS raw_average_score,
  round(avg(routed_score), 4) AS routed_average_score, round(avg(raw_latency), 4) AS raw_average_latency_ms, round(avg(routed_latency), 4) AS routed_average_latency_ms,
  count(*) FILTER (outcome = 'melhorou') AS improved_cases, count(*) FILTER (outcome = 'piorou') AS degraded_cases,
  count(*) FILTER (outcome = 'empatou') AS tied_cases, count(*) FILTER (case_id % 3 > 0) AS guided_cases FROM judged_v GROUP BY 1)"""


def _reports(spark, sf):
    rows = _compared(spark, sf).withColumns({"process": F.col("case_id") % 20, "guide_count": F.col("case_id") % 3})
    return B.variant_report(rows, ["process"])


@query("b05_variant_report", "WITH" + HITS + "," + VARIANTS + "," + REPORTS + " SELECT * FROM reports")
def b05(spark, sf):
    return _reports(spark, sf)


@query("b06_weighted_report", "WITH" + HITS + "," + VARIANTS + "," + REPORTS + """
SELECT process % 3 AS suite, count(*) AS total_processes, sum(total_cases)::BIGINT AS total_cases,
  round(sum(raw_hit_rate * total_cases) / sum(total_cases), 4) AS raw_hit_rate, round(sum(routed_hit_rate * total_cases) / sum(total_cases), 4) AS routed_hit_rate,
  round(sum(raw_mrr * total_cases) / sum(total_cases), 4) AS raw_mrr, round(sum(routed_mrr * total_cases) / sum(total_cases), 4) AS routed_mrr,
  sum(improved_cases)::BIGINT AS improved_cases, sum(degraded_cases)::BIGINT AS degraded_cases, sum(tied_cases)::BIGINT AS tied_cases
FROM reports GROUP BY 1""")
def b06(spark, sf):
    return B.weighted_report(_reports(spark, sf).withColumn("suite", F.col("process") % 3), ["suite"])


@query("b06_status_counts", "SELECT o_orderpriority AS review_status, count(*) AS n FROM orders GROUP BY 1")
def b06_status(spark, sf):
    return B.status_counts(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("review_status")))


VOCABULARY = ["with", "other", "inging", "their", "avec", "dans", "queque", "nicht", "auch", "eine", "para", "como", "elle", "rest", "thest"]
WORDS_SQL = ", ".join(f"'{w}'" for w in VOCABULARY if w not in ("para", "como"))
GENERATED = f"""
vocab AS (SELECT case_id, page_number, chunk_index, text, list_intersect([{WORDS_SQL}],
  regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+')) AS v FROM chunks),
term_pages AS (SELECT case_id, term, list(DISTINCT page_number) AS pages FROM (SELECT case_id, page_number, unnest(v) AS term FROM vocab) GROUP BY 1, 2),
ranked_terms AS (
  SELECT case_id, page_number, chunk_index, term, pages, row_number() OVER (PARTITION BY case_id, page_number, chunk_index
    ORDER BY len(pages), -((length(text) - length(replace(lower(text), term, ''))) // length(term)), -length(term), term) AS i
  FROM (SELECT case_id, page_number, chunk_index, text, unnest(v) AS term FROM vocab WHERE length(trim(text)) >= 180) JOIN term_pages USING (case_id, term)),
lists AS (SELECT case_id, page_number, chunk_index, list(term ORDER BY i) AS terms, list(pages ORDER BY i) AS ps FROM ranked_terms GROUP BY 1, 2, 3),
walked AS (SELECT *, list_transform(range(1, len(terms) + 1), lambda m: list_reduce(ps[1:m], lambda a, b: list_intersect(a, b))) AS common FROM lists WHERE len(terms) >= 2),
stops AS (SELECT *, list_min(list_filter(range(2, len(terms) + 1), lambda m: len(common[m]) <= 5)) AS need FROM walked),
built AS (SELECT case_id, page_number, chunk_index, terms[1:least(need, 3)] AS ts, list_sort(common[need]) AS expected_pages FROM stops WHERE need IS NOT NULL),
asked AS (SELECT *, 'O que o processo informa sobre ' || CASE WHEN len(ts) = 2 THEN ts[1] || ' e ' || ts[2] ELSE ts[1] || ', ' || ts[2] || ' e ' || ts[3] END
  || ' e em qual contexto isso aparece?' AS question FROM built),
firsts AS (SELECT * FROM asked QUALIFY row_number() OVER (PARTITION BY case_id, question, expected_pages ORDER BY page_number, chunk_index) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY page_number, chunk_index) - 1 AS nth, count(*) OVER (PARTITION BY case_id) AS size FROM firsts)"""


@query("b07_generate_cases", CHUNKS_CTE + "," + GENERATED + """
SELECT case_id, 'auto_p' || lpad(page_number::VARCHAR, 4, '0') || '_c' || lpad(chunk_index::VARCHAR, 3, '0') AS id, question,
  array_to_string(expected_pages, '|') AS expected_pages, array_to_string(ts, '|') AS expected_terms FROM placed
WHERE size <= 5 OR nth IN (SELECT round_even(j * (size - 1) / 4, 0) FROM (SELECT unnest(range(0, 5)) AS j))""")
def b07(spark, sf):
    return B.generate_cases(I.chunks(spark, sf), VOCABULARY, 5).select(
        "case_id", "id", "question", "expected_pages", "expected_terms")


@query("b08_even_sample", """
WITH p AS (SELECT o_custkey AS case_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS nth,
  count(*) OVER (PARTITION BY o_custkey) AS size FROM orders)
SELECT case_id, o_orderkey FROM p WHERE size <= 4 OR nth IN (SELECT round_even(j * (size - 1) / 3, 0) FROM (SELECT unnest(range(0, 4)) AS j))""")
def b08(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), "o_orderkey")
    return B.even_sample(rows, 4, ["case_id"], "o_orderkey")


RELEVANT = """
rel AS (SELECT DISTINCT l_orderkey AS query_id, l_suppkey AS doc_id FROM lineitem WHERE l_returnflag = 'R'),
per AS (SELECT query_id, min(rank) FILTER (rel.doc_id IS NOT NULL) AS first, round(count(rel.doc_id) / count(*), 4) AS p
  FROM (SELECT case_id AS query_id, page_number AS doc_id, rank FROM hits) h LEFT JOIN rel USING (query_id, doc_id) GROUP BY 1),
metrics AS (SELECT q.query_id, first IS NOT NULL AS hit, coalesce(round(1.0 / first, 4), 0)::DOUBLE AS reciprocal_rank, coalesce(p, 0.0) AS precision_at_k
  FROM (SELECT DISTINCT query_id FROM rel) q LEFT JOIN per USING (query_id))"""


def _relevance(spark, sf):
    hits, _ = _hits_and_cases(spark, sf)
    rel = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("doc_id"))
    return B.relevance_metrics(hits.select(F.col("case_id").alias("query_id"), F.col("page_number").alias("doc_id"), "rank"), rel)


@query("b09_relevance_metrics", "WITH" + HITS + "," + RELEVANT + " SELECT * FROM metrics")
def b09(spark, sf):
    return _relevance(spark, sf)


@query("b09_relevance_summary", "WITH" + HITS + "," + RELEVANT + """
SELECT round(avg(hit::INT), 4) AS hit_rate, round(avg(reciprocal_rank), 4) AS mrr, round(avg(precision_at_k), 4) AS average_precision_at_k FROM metrics""")
def b09_summary(spark, sf):
    return B.relevance_summary(_relevance(spark, sf))


@query("b10_set_scores", """
WITH s AS (SELECT o_orderkey AS case_id, coalesce(list(DISTINCT l_suppkey) FILTER (l_returnflag = 'R'), []) AS seen,
  coalesce(list(DISTINCT l_suppkey) FILTER (l_linestatus = 'F'), []) AS want FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT case_id, CASE WHEN len(seen) = 0 THEN (len(want) = 0)::INT::DOUBLE ELSE round(len(list_intersect(seen, want)) / len(seen), 4) END AS set_precision,
  CASE WHEN len(want) = 0 THEN 1.0 ELSE round(len(list_intersect(seen, want)) / len(want), 4) END AS set_recall FROM s""")
def b10(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("seen"),
        F.collect_set(F.when(F.col("l_linestatus") == "F", F.col("l_suppkey"))).alias("want"))
    none = F.array().cast("array<bigint>")
    sets = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id")).join(li, "case_id", "left").select(
        "case_id", F.coalesce("seen", none).alias("seen"), F.coalesce("want", none).alias("want"))
    return sets.select("case_id", B.set_precision(F.col("seen"), F.col("want")).alias("set_precision"),
                       B.set_recall(F.col("seen"), F.col("want")).alias("set_recall"))


@query("b11_item_found", """
SELECT doc_id, contains(f, 'the of') OR contains(f, 'rien') AS found FROM (
  SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')) AS f FROM documents)""")
def b11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", B.item_found(F.col("text"), F.lit("The, ÓF||  ||Rién")).alias("found"))


# Labels as benchmark cases and observations.
BENCH = """
lab AS (SELECT *, doc_id % 3 AS g FROM labels),
docs2 AS (SELECT doc_id, text FROM documents),
bench AS (SELECT doc_id AS case_id, 'q' || g AS engine, CASE WHEN doc_id % 4 = 0 THEN 'development' ELSE 'test' END AS split,
  CASE WHEN g = 0 THEN 'technical_approved' ELSE 'legal_approved' END AS review_status, quality::VARCHAR AS expected_label,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE [doc_id % 5, doc_id % 3, 4] END AS relevant_pages, doc_id % 11 = 0 AS missing,
  [doc_id % 4, doc_id % 5] AS source_pages, [doc_id % 4, 9] AS cited_pages, toxic::VARCHAR AS label, doc_id % 6 = 0 AS should_abstain,
  doc_id % 9 = 0 AS abstained, (doc_id * 37 % 1000) AS latency_ms, doc_id % 2 AS llm_calls, CASE WHEN doc_id % 13 = 0 THEN 'falha' END AS error,
  contains(lower(text), 'the') AS has_the, contains(lower(text), 'der') AS has_der FROM lab JOIN docs2 USING (doc_id)),
scored_b AS (SELECT *, CASE WHEN missing THEN 'observacao ausente' ELSE error END AS err,
  NOT missing AND label = expected_label AS label_correct,
  CASE WHEN NOT missing AND relevant_pages IS NOT NULL THEN round(len(list_intersect(source_pages, list_distinct(relevant_pages))) / len(list_distinct(source_pages)), 4) END AS page_precision,
  CASE WHEN NOT missing AND relevant_pages IS NOT NULL THEN round(len(list_intersect(list_distinct(relevant_pages), source_pages)) / len(list_distinct(relevant_pages)), 4) END AS page_recall,
  CASE WHEN NOT missing AND relevant_pages IS NOT NULL THEN len(list_intersect(source_pages, relevant_pages)) > 0 END AS page_hit,
  CASE WHEN NOT missing THEN round(len(list_intersect(list_distinct(cited_pages), source_pages)) / len(list_distinct(cited_pages)), 4) END AS citation_fidelity,
  CASE WHEN NOT missing THEN CASE WHEN has_the THEN 1.0 ELSE 0.5 END END AS item_recall,
  NOT missing AND has_der AS false_positive, CASE WHEN NOT missing THEN should_abstain = abstained END AS abstention_correct,
  CASE WHEN NOT missing THEN latency_ms END AS lat, CASE WHEN missing THEN 0 ELSE llm_calls END AS calls FROM bench)"""


def _bench(spark, sf):
    d = F.col("doc_id")
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    case = F.col("doc_id").alias("case_id")
    strings = lambda *v: F.array(*[F.lit(x) for x in v])
    cases = rows.select(
        case, F.concat(F.lit("q"), (d % 3).cast("string")).alias("engine"),
        F.when(d % 4 == 0, "development").otherwise("test").alias("split"),
        F.when(d % 3 == 0, "technical_approved").otherwise("legal_approved").alias("review_status"),
        F.col("quality").cast("string").alias("expected_label"),
        F.when(d % 7 != 0, F.array(d % 5, d % 3, F.lit(4).cast("bigint"))).alias("relevant_pages"),
        strings("The||zzzz", "Resposta  DADA").alias("required_items"), strings("DER").alias("forbidden_items"),
        (d % 6 == 0).alias("should_abstain"))
    obs = rows.where(d % 11 != 0).select(
        case, F.array(d % 4, d % 5).alias("source_pages"), F.array(d % 4, F.lit(9).cast("bigint")).alias("cited_pages"),
        F.col("toxic").cast("string").alias("label"), strings("resposta dada").alias("items"), (d % 9 == 0).alias("abstained"),
        F.when(F.lit(True), d * 37 % 1000).alias("latency_ms"), (d % 2).cast("int").alias("llm_calls"),
        F.when(d % 13 == 0, "falha").alias("error"), F.col("text").alias("response"))
    return B.score_cases(cases, obs)


@query("b12_score_cases", "WITH" + BENCH + """
SELECT case_id, label_correct, page_precision, page_recall, page_hit, citation_fidelity, item_recall::DOUBLE AS item_recall, false_positive, abstention_correct, err AS error
FROM scored_b""")
def b12(spark, sf):
    return _bench(spark, sf).select(
        "case_id", "label_correct", "page_precision", "page_recall", "page_hit", "citation_fidelity", "item_recall",
        "false_positive", "abstention_correct", "error")


def _metrics_sql(where: str = "true") -> str:
    return f"""
SELECT engine, count(*) AS cases_count, round(avg(label_correct::INT), 4) AS label_accuracy, round(avg(page_precision), 4) AS page_precision,
  round(avg(page_recall), 4) AS page_recall, round(avg(page_hit::INT), 4) AS page_hit_rate, round(avg(citation_fidelity), 4) AS citation_fidelity,
  round(avg(item_recall), 4)::DOUBLE AS item_recall, round(avg(abstention_correct::INT), 4) AS abstention_accuracy, round(avg(false_positive::INT), 4) AS false_positive_case_rate,
  round(count(err) / count(*), 4) AS error_rate, quantile_disc(lat, 0.5) AS p50_latency_ms, quantile_disc(lat, 0.95) AS p95_latency_ms,
  sum(calls)::BIGINT AS total_llm_calls, round(sum(calls) / count(*), 4) AS average_llm_calls FROM scored_b WHERE {where} GROUP BY 1"""


@query("b13_engine_metrics", "WITH" + BENCH + _metrics_sql())
def b13(spark, sf):
    m = B.engine_metrics(_bench(spark, sf))
    return m.withColumns({c: F.col(c).cast("bigint") for c in ("p50_latency_ms", "p95_latency_ms")})


GATE = {"label_accuracy": 0.6, "page_recall": 0.5, "item_recall": 0.1, "error_rate": 0.12, "p95_latency_ms": 900.0}
FAILURES = """
checks(check_no, metric, thr) AS (VALUES (0, 'label_accuracy', 0.6), (2, 'page_recall', 0.5), (5, 'item_recall', 0.1), (8, 'error_rate', 0.12), (9, 'p95_latency_ms', 900.0)),
valued AS (SELECT engine, check_no, metric, CASE metric WHEN 'label_accuracy' THEN label_accuracy WHEN 'page_recall' THEN page_recall
  WHEN 'item_recall' THEN item_recall WHEN 'error_rate' THEN error_rate ELSE p95_latency_ms END::DOUBLE AS value,
  CASE WHEN engine = 'q1' AND metric = 'error_rate' THEN 0.01 ELSE thr END::DOUBLE AS thr FROM m, checks),
failing AS (SELECT engine, check_no, metric, metric || '=' || format('{:.4f}', value) || CASE WHEN check_no < 7 THEN ' abaixo de ' ELSE ' acima de ' END
  || format('{:.4f}', thr) AS failure FROM valued WHERE (check_no < 7 AND value < thr) OR (check_no >= 7 AND value > thr))"""


def _overrides(spark):
    return spark.createDataFrame([("q1", "error_rate", 0.01)], "engine string, metric string, threshold double")


@query("b14_gate_failures", "WITH" + BENCH + ", m AS (" + _metrics_sql() + ")," + FAILURES + """
SELECT engine, check_no::BIGINT AS check_no, metric, failure FROM failing""")
def b14(spark, sf):
    return B.gate_failures(B.engine_metrics(_bench(spark, sf)), GATE, _overrides(spark))


STATUS = ("WITH" + BENCH + ", m AS (" + _metrics_sql("split = 'test' AND review_status = 'legal_approved'") + ")," + FAILURES + """
, st AS (SELECT e.engine, coalesce(m.cases_count, 0) AS eligible_cases, CASE WHEN m.cases_count IS NULL THEN 'not_eligible'
  WHEN e.engine IN (SELECT engine FROM failing) THEN 'failed' ELSE 'passed' END AS gate_status
  FROM (SELECT DISTINCT engine FROM bench) e LEFT JOIN m USING (engine))""")


@query("b15_gate_status", STATUS + " SELECT * FROM st")
def b15(spark, sf):
    return B.gate_status(_bench(spark, sf), GATE, _overrides(spark))


@query("b15_report_status", STATUS + """
SELECT CASE WHEN bool_or(gate_status = 'failed') THEN 'failed' WHEN bool_and(gate_status = 'passed') THEN 'passed' ELSE 'not_eligible' END AS report_status FROM st""")
def b15_report(spark, sf):
    return B.report_status(B.gate_status(_bench(spark, sf), GATE, _overrides(spark)))


# Orders as nullity cases: one requirement per line number, its expected result the smallest return flag.
CLASSIFIED = f"""
reqs AS (SELECT l_orderkey AS case_id, l_linenumber AS req, min(l_returnflag) AS want, max(l_returnflag) AS got, min(l_suppkey) AS page, max(l_suppkey) AS p_page
  FROM lineitem GROUP BY 1, 2),
per_case AS (SELECT case_id, count(*) AS total, count(*) FILTER (want = got) AS right_n, count(*) FILTER (want <> 'N') AS pages_asked,
  count(*) FILTER (want <> 'N' AND page = p_page) AS pages_right FROM reqs GROUP BY 1),
rows_c AS (SELECT o_orderpriority AS model, o_orderkey AS case_id, o_custkey % 17 = 0 AS bad,
  CASE o_orderkey % 3 WHEN 0 THEN '{B.STRONG}' WHEN 1 THEN 'inconclusivo' ELSE 'sem_indicio' END AS want_c,
  CASE o_custkey % 3 WHEN 0 THEN '{B.STRONG}' WHEN 1 THEN 'inconclusivo' ELSE 'sem_indicio' END AS got_c, o_orderstatus AS want_i,
  CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus ELSE 'F' END AS got_i, o_custkey AS elapsed, p.*
  FROM orders JOIN per_case p ON p.case_id = o_orderkey),
graded_c AS (SELECT *, NOT bad AND want_c = got_c AS c_ok, NOT bad AND want_i = got_i AS i_ok, CASE WHEN bad THEN 0 ELSE right_n END AS r_ok,
  CASE WHEN bad THEN 0 ELSE pages_right END AS p_ok FROM rows_c),
final_c AS (SELECT *, round((5 * c_ok::INT + 2 * i_ok::INT + r_ok + p_ok) / (7 + total + pages_asked) * 100, 2) AS weighted,
  NOT bad AND got_c = '{B.STRONG}' AND want_c <> '{B.STRONG}' AS fp FROM graded_c)"""


@query("b18_classification_report", "WITH" + CLASSIFIED + """
, r AS (SELECT model, count(*) AS cases_count, count(*) FILTER (bad) AS errors_count, round(avg(c_ok::INT), 4) AS conclusion_accuracy,
  round(avg(i_ok::INT), 4) AS impact_accuracy, round(sum(r_ok) / sum(total), 4) AS requirement_accuracy, round(sum(p_ok) / sum(pages_asked), 4) AS page_reference_accuracy,
  round(avg(weighted), 2) AS average_weighted_score, round(avg(elapsed), 2) AS average_elapsed_ms, count(*) FILTER (fp) AS false_positive_count FROM final_c GROUP BY 1)
SELECT *, errors_count = 0 AND false_positive_count = 0 AND conclusion_accuracy >= 0.8 AND requirement_accuracy >= 0.8 AND page_reference_accuracy >= 0.9 AS gate_passed FROM r""")
def b18(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").cast("string").alias("req")).agg(
        F.min("l_returnflag").alias("want"), F.max("l_returnflag").alias("got"),
        F.min("l_suppkey").alias("page"), F.max("l_suppkey").alias("p_page"))
    as_map = lambda v, n: F.map_from_entries(F.collect_list(F.struct("req", v))).alias(n)
    none = F.array().cast("array<bigint>")
    maps = li.groupBy("case_id").agg(
        as_map(F.col("want"), "results"), as_map(F.col("got"), "p_results"),
        as_map(F.when(F.col("want") != "N", F.array("page")).otherwise(none), "pages"), as_map(F.array("p_page"), "p_pages"))
    names = lambda c: F.element_at(F.array(F.lit(B.STRONG), F.lit("inconclusivo"), F.lit("sem_indicio")), (c % 3 + 1).cast("int"))
    rows = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "case_id").join(maps, "case_id")
    gold = rows.select("case_id", names(F.col("case_id")).alias("conclusion"), F.col("o_orderstatus").alias("impact"), "results", "pages",
                       none.alias("impact_pages"))
    cust = F.col("o_custkey")
    pred = rows.select(F.col("o_orderpriority").alias("model"), "case_id", names(cust).alias("p_conclusion"),
                       F.when(cust % 2 == 0, F.col("o_orderstatus")).otherwise("F").alias("p_impact"), "p_results", "p_pages",
                       none.alias("p_impact_pages"), cust.alias("elapsed_ms"), F.when(cust % 17 == 0, "erro").alias("error"))
    return B.classification_report(pred, gold)


READ = """
engines(engine, family) AS (VALUES ('a', 'rapid'), ('b', 'easy'), ('c', 'rapid')),
read AS (SELECT engine, family, doc_id, CASE engine WHEN 'a' THEN text WHEN 'b' THEN replace(text, 'th', 'x') ELSE replace(text, ' ', '') END AS t,
  CASE engine WHEN 'a' THEN 3 WHEN 'b' THEN 2 ELSE 1 END AS ms FROM documents, engines),
norm AS (SELECT *, trim(regexp_replace(strip_accents(lower(t)), '[^a-z0-9]+', ' ', 'g')) AS f FROM read),
rec AS (SELECT engine, family, count(*) AS page_count, sum(contains(f, 'of the')::INT + contains(f, 'der')::INT + contains(f, 'que')::INT)::BIGINT AS matched,
  3 * count(*) AS expected, count(*) FILTER (length(t) >= 1000 AND length(t) - length(replace(t, ' ', '')) <= 0.07 * length(t)
    AND len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: length(w) >= 40)) >= 3) AS glued_pages, sum(ms)::BIGINT AS elapsed_ms FROM norm GROUP BY 1, 2)"""


def _reading(spark, sf):
    docs = table(spark, sf, "documents")
    variants = F.explode(F.array(*[F.struct(F.lit(e).alias("engine"), F.lit(f).alias("family"), t.alias("text"), F.lit(ms).alias("elapsed_ms"))
                                   for e, f, t, ms in (
        ("a", "rapid", F.col("text"), 3), ("b", "easy", F.replace("text", F.lit("th"), F.lit("x")), 2),
        ("c", "rapid", F.replace("text", F.lit(" "), F.lit("")), 1))]))
    pages = docs.select(F.col("doc_id").alias("page_id"), variants.alias("v")).select("page_id", "v.*")
    gold = docs.select(F.col("doc_id").alias("page_id"), F.array(F.lit("of, the"), F.lit("Dér"), F.lit("que")).alias("phrases"))
    return pages, gold


@query("b19_phrase_recall", "WITH" + READ + " SELECT *, matched / expected AS recall FROM rec")
def b19(spark, sf):
    return B.phrase_recall(*_reading(spark, sf))


@query("b19_phrase_gate", "WITH" + READ + """
SELECT arg_min(engine, (-matched / expected, glued_pages, elapsed_ms, engine)) AS best_engine, count(DISTINCT family) >= 2 AS comparison_ready,
  max(matched / expected) >= 0.9 AS gate_passed FROM rec""")
def b19_gate(spark, sf):
    pages, gold = _reading(spark, sf)
    return B.phrase_gate(B.phrase_recall(pages, gold), gold, True)


@query("b20_extraction_timing", I.GRADED_CTE + """
, r AS (SELECT case_id, count(*) AS page_count, sum(length(text))::BIGINT AS total_chars FROM graded GROUP BY 1),
f AS (SELECT source AS case_id, (sum(doc_id) % 1000)::BIGINT AS elapsed_ms FROM documents GROUP BY 1)
SELECT case_id, elapsed_ms, page_count, total_chars, round(elapsed_ms / page_count, 2) AS ms_per_page FROM f LEFT JOIN r USING (case_id)""")
def b20(spark, sf):
    from caselens.operators.quality import extraction_report, quality_notes

    files = table(spark, sf, "documents").groupBy(F.col("source").alias("case_id")).agg((F.sum("doc_id") % 1000).alias("elapsed_ms"))
    report = extraction_report(quality_notes(I.graded_pages(spark, sf)))
    return B.extraction_timing(files, report).select("case_id", "elapsed_ms", "page_count", "total_chars", "ms_per_page")
