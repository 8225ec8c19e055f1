"""Limitation periods and dated text."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.functions.aligned import decomposed
from caselens.operators import dates as X
from caselens.operators import intervals as J
from caselens.plans.inputs import table
from caselens.plans.registry import query


def _offences(spark, sf):
    """Orders as offences of their customer."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.to_date("o_orderdate")
    status = F.when(k % 3 == 0, "proferida").when(k % 3 == 1, "nao_proferida").otherwise("desconhecida")
    plus = lambda d, n: F.date_add(d, n.cast("int"))
    return table(spark, sf, "orders").select(
        c.alias("case_id"), k.alias("offence_id"), (k * 7 % 160 + 1).cast("int").alias("max_months"), F.lit("consumacao").alias("term_type"),
        day.alias("term_date"), plus(day, -(k % 5)).alias("fact_date"),
        F.when(c % 9 != 0, plus(F.lit("1925-01-01").cast("date"), c * 37 % 21000)).alias("birth_date"),
        status.alias("sentence_status"), F.when((k % 3 == 0) & (k % 4 != 0), plus(day, k % 900 + 400)).alias("sentence_date"),
        F.lit("2003-01-01").cast("date").alias("reference_date"),
        F.when(k % 2 == 0, k % 5 == 0).alias("sexual_violence_against_woman"))


def _milestones(spark, sf):
    """Odd lines shipped after the order."""
    odd = table(spark, sf, "lineitem").where("l_linenumber % 2 = 1").select(
        F.col("l_orderkey").alias("offence_id"), F.to_date("l_shipdate").alias("event_date"),
        F.when(F.col("l_linenumber") == 7, "sentenca_condenatoria_recorrivel").otherwise("recebimento_denuncia").alias("event_type"))
    term = table(spark, sf, "orders").select(F.col("o_orderkey").alias("offence_id"), F.to_date("o_orderdate").alias("t"))
    return odd.join(term, "offence_id").where("event_date >= t").drop("t")


def _suspensions(spark, sf):
    """Even lines; one in fifty has no end."""
    start = F.to_date("l_shipdate")
    return table(spark, sf, "lineitem").where("l_linenumber % 2 = 0").select(
        F.col("l_orderkey").alias("offence_id"), start.alias("start_date"),
        F.when(F.col("l_quantity") < 50, F.date_add(start, F.col("l_quantity").cast("int"))).alias("end_date"),
        F.when(F.col("l_returnflag") == "R", "cpp_366").otherwise("art_116").alias("suspension_type"))


INPUTS = """
offences AS (SELECT o_custkey AS case_id, o_orderkey AS offence_id, o_orderkey * 7 % 160 + 1 AS max_months, o_orderdate::DATE AS term_date,
  o_orderdate::DATE - (o_orderkey % 5)::INT AS fact_date,
  CASE WHEN o_custkey % 9 <> 0 THEN DATE '1925-01-01' + (o_custkey * 37 % 21000)::INT END AS birth_date,
  CASE o_orderkey % 3 WHEN 0 THEN 'proferida' WHEN 1 THEN 'nao_proferida' ELSE 'desconhecida' END AS sentence_status,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN o_orderdate::DATE + (o_orderkey % 900 + 400)::INT END AS sentence_date,
  DATE '2003-01-01' AS reference_date, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 = 0 END AS violence FROM orders),
milestones AS (SELECT l_orderkey AS offence_id, l_shipdate::DATE AS event_date,
  CASE WHEN l_linenumber = 7 THEN 'sentenca_condenatoria_recorrivel' ELSE 'recebimento_denuncia' END AS event_type
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber % 2 = 1 AND l_shipdate >= o_orderdate),
suspensions AS (SELECT l_orderkey AS offence_id, l_shipdate::DATE AS start_date,
  CASE WHEN l_quantity < 50 THEN l_shipdate::DATE + l_quantity::INT END AS end_date,
  CASE WHEN l_returnflag = 'R' THEN 'cpp_366' ELSE 'art_116' END AS suspension_type FROM lineitem WHERE l_linenumber % 2 = 0),
periods AS (SELECT *, CASE WHEN max_months > 144 THEN 240 WHEN max_months > 96 THEN 192 WHEN max_months > 48 THEN 144 WHEN max_months > 24 THEN 96
  WHEN max_months >= 12 THEN 48 ELSE 36 END AS base_period FROM offences),
edges AS (SELECT *, CASE WHEN start_date > max(end_date) OVER (PARTITION BY offence_id ORDER BY start_date, end_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  THEN 1 ELSE 0 END AS opens FROM suspensions WHERE end_date IS NOT NULL),
islands AS (SELECT offence_id, start_date, end_date, sum(opens) OVER (PARTITION BY offence_id ORDER BY start_date, end_date ROWS UNBOUNDED PRECEDING) AS island FROM edges),
merged AS (SELECT offence_id, min(start_date) AS start_date, max(end_date) AS end_date FROM islands GROUP BY offence_id, island)"""



RULES = f"""
aged AS (SELECT *, birth_date IS NOT NULL AND (year(fact_date) - year(birth_date) - (strftime(fact_date, '%m%d') < strftime(birth_date, '%m%d'))::INT) < 21 AS young,
  birth_date IS NOT NULL AND sentence_status = 'proferida' AND sentence_date IS NOT NULL
    AND (year(sentence_date) - year(birth_date) - (strftime(sentence_date, '%m%d') < strftime(birth_date, '%m%d'))::INT) > 70 AS old,
  birth_date IS NOT NULL AND sentence_status = 'desconhecida'
    AND (year(reference_date) - year(birth_date) - (strftime(reference_date, '%m%d') < strftime(birth_date, '%m%d'))::INT) > 70 AS maybe FROM periods),
reduced AS (SELECT *, list_filter([CASE WHEN birth_date IS NULL THEN '{J.MISSING_BIRTH}' END,
    CASE WHEN birth_date IS NOT NULL AND sentence_status = 'proferida' AND sentence_date IS NULL THEN '{J.MISSING_SENTENCE}' END,
    CASE WHEN maybe THEN '{J.MISSING_STATE}' END], lambda x: x IS NOT NULL) AS missing,
  list_filter([CASE WHEN young THEN '{J.YOUNG}' END, CASE WHEN old THEN '{J.OLD}' END], lambda x: x IS NOT NULL) AS reasons FROM aged)"""


def chain_sql(source: str, period: str) -> str:
    """Interval chain by one recursive walk per offence over its sorted events."""
    fold = """list_reduce(susp, lambda a, s: CASE WHEN s.s < {end} AND s.e > greatest(s.s, {start}) AND greatest(s.s, {start}) <= a.d
        THEN {{'s': a.s, 'e': a.e, 'd': a.d + (s.e - greatest(s.s, {start}))::INT, 'n': a.n + (s.e - greatest(s.s, {start}))}}
        ELSE {{'s': a.s, 'e': a.e, 'd': a.d, 'n': a.n}} END,
        {{'s': {start}, 'e': {start}, 'd': (({start} + to_months({period}))::DATE - 1)::DATE, 'n': 0::BIGINT}})"""
    return f"""
lists AS (SELECT offence_id, list({{'s': start_date, 'e': end_date, 'd': start_date, 'n': 0::BIGINT}} ORDER BY start_date) AS susp FROM merged GROUP BY 1),
events2 AS (SELECT offence_id, event_date, min(event_type) AS event_type, 0 AS last FROM milestones GROUP BY 1, 2
  UNION ALL SELECT offence_id, reference_date, 'data_referencia', 1 FROM {source}),
seq AS (SELECT e.*, {period} AS months, coalesce(susp, []) AS susp,
  coalesce(lag(event_date) OVER (PARTITION BY e.offence_id ORDER BY last, event_date), term_date) AS start_date
  FROM events2 e JOIN {source} o ON o.offence_id = e.offence_id LEFT JOIN lists l ON l.offence_id = e.offence_id),
walked AS (SELECT *, {fold.format(end='event_date', start='start_date', period='months')} AS r FROM seq),
flagged2 AS (SELECT *, r.d AS deadline, r.n AS days, event_date > r.d AS late FROM walked),
ordered AS (SELECT *, coalesce(bool_or(late AND last = 0) OVER (PARTITION BY offence_id ORDER BY last, event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM flagged2),
chain AS (SELECT offence_id, start_date, deadline, event_date AS end_date, event_type AS end_reason, last, days AS suspended_days,
  CASE WHEN last = 0 AND late THEN 'prazo_esgotado_antes_do_marco' WHEN last = 0 THEN 'interrompido_em_tempo' WHEN late THEN 'prazo_esgotado_no_calculo'
    WHEN event_date = deadline THEN 'vence_na_data_referencia' ELSE 'prazo_nao_esgotado_no_calculo' END AS status FROM ordered WHERE NOT gone)"""


@query("j01_base_period", "WITH" + INPUTS + " SELECT offence_id, base_period::BIGINT AS base_period FROM periods")
def j01(spark, sf):
    return _offences(spark, sf).select("offence_id", J.base_period(F.col("max_months")).alias("base_period"))


@query("j02_age_reduction", "WITH" + INPUTS + "," + RULES + """
SELECT offence_id, array_to_string(missing, '|') AS missing_fields, array_to_string(reasons, '|') AS reasons FROM reduced""")
def j02(spark, sf):
    return J.age_reduction(_offences(spark, sf)).select("offence_id", "missing_fields", "reasons")


@query("j03_merge_intervals", "WITH" + INPUTS + """
SELECT offence_id, start_date::VARCHAR AS start_date, end_date::VARCHAR AS end_date FROM merged""")
def j03(spark, sf):
    return J.merge_intervals(_suspensions(spark, sf))


@query("j04_j05_limitation_intervals", "WITH" + INPUTS + "," + chain_sql("periods", "base_period") + """
SELECT offence_id, start_date::VARCHAR AS start_date, deadline::VARCHAR AS deadline, end_date::VARCHAR AS end_date, end_reason, status,
  suspended_days FROM chain""")
def j04(spark, sf):
    offences = _offences(spark, sf).withColumn("period", J.base_period(F.col("max_months")))
    return J.limitation_intervals(offences, _milestones(spark, sf), _suspensions(spark, sf))


FINAL = RULES + f""",
more AS (SELECT r.*, list_concat(missing, list_filter([
    CASE WHEN sentence_status = 'proferida' AND offence_id NOT IN (SELECT offence_id FROM milestones WHERE event_type = 'sentenca_condenatoria_recorrivel') THEN '{J.MISSING_CONVICTION}' END,
    CASE WHEN offence_id IN (SELECT offence_id FROM suspensions WHERE end_date IS NULL) THEN '{J.MISSING_END}' END], lambda x: x IS NOT NULL)) AS all_missing FROM reduced r),
complete AS (SELECT *, CASE WHEN len(reasons) > 0 THEN base_period // 2 ELSE base_period END AS applied FROM more WHERE len(all_missing) = 0),""" + chain_sql("complete", "applied") + """,
final AS (SELECT offence_id, arg_max(status, (end_date, last)) AS status, arg_max(deadline, (end_date, last)) AS deadline FROM chain GROUP BY 1),
out AS (SELECT m.case_id, m.offence_id, CASE WHEN len(all_missing) > 0 THEN 'inconclusivo' WHEN f.status = 'prazo_esgotado_antes_do_marco' THEN 'prazo_esgotado_no_calculo'
  ELSE f.status END AS status, f.deadline, (f.deadline - reference_date) AS days, all_missing FROM more m LEFT JOIN final f USING (offence_id))"""


@query("j06_limitation_status", "WITH" + INPUTS + "," + FINAL + """
SELECT offence_id, status, deadline::VARCHAR AS final_deadline, days AS days_to_deadline, array_to_string(all_missing, '|') AS missing_fields FROM out""")
def j06(spark, sf):
    return J.limitation_status(_offences(spark, sf), _milestones(spark, sf), _suspensions(spark, sf)).select(
        "offence_id", "status", "final_deadline", "days_to_deadline", "missing_fields")


@query("j06_overall_status", "WITH" + INPUTS + "," + FINAL + """
SELECT case_id, CASE WHEN bool_or(status = 'inconclusivo') THEN 'inconclusivo' WHEN bool_or(status = 'prazo_esgotado_no_calculo') THEN 'ha_prazo_esgotado_no_calculo'
  WHEN bool_or(status = 'vence_na_data_referencia') THEN 'ha_prazo_no_limite' ELSE 'prazos_nao_esgotados_no_calculo' END AS overall_status FROM out GROUP BY 1""")
def j06_overall(spark, sf):
    return J.overall_status(J.limitation_status(_offences(spark, sf), _milestones(spark, sf), _suspensions(spark, sf)))


@query("j07_limitation_violations", "WITH" + INPUTS + """
, day AS (SELECT offence_id, event_date, count(*) AS n, bool_or(event_type LIKE 'sentenca%') AS conv FROM milestones GROUP BY 1, 2),
v AS (
  SELECT offence_id, 'nascimento_futuro' AS violation FROM offences WHERE birth_date > reference_date UNION ALL
  SELECT offence_id, 'sentenca_futura' FROM offences WHERE sentence_date > reference_date UNION ALL
  SELECT offence_id, 'marco_futuro' FROM day JOIN offences USING (offence_id) WHERE event_date > reference_date UNION ALL
  SELECT offence_id, 'marcos_na_mesma_data' FROM day WHERE n > 1 UNION ALL
  SELECT offence_id, 'marco_condenatorio_sem_sentenca' FROM day JOIN offences USING (offence_id) WHERE conv AND sentence_status <> 'proferida' UNION ALL
  SELECT offence_id, 'marco_dentro_de_suspensao' FROM day JOIN suspensions USING (offence_id) WHERE start_date <= event_date AND event_date < end_date UNION ALL
  SELECT offence_id, 'suspensao_antes_do_termo' FROM suspensions JOIN offences USING (offence_id) WHERE start_date < term_date UNION ALL
  SELECT offence_id, 'suspensao_futura' FROM suspensions JOIN offences USING (offence_id) WHERE start_date > reference_date UNION ALL
  SELECT offence_id, 'fim_da_suspensao_futuro' FROM suspensions JOIN offences USING (offence_id) WHERE end_date > reference_date)
SELECT DISTINCT offence_id, violation FROM v""")
def j07(spark, sf):
    return J.limitation_violations(_offences(spark, sf), _milestones(spark, sf), _suspensions(spark, sf))


@query("x01_parse_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderdate::DATE::VARCHAR END AS value FROM orders""")
def x01(spark, sf):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    month = F.element_at(F.array(*[F.lit(m) for m in X.MONTHS]), F.month(d))
    text = (F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.date_format(d, "d-M-yy"))
            .when(k == 2, F.concat(F.day(d).cast("string"), F.lit(" de "), F.replace(F.initcap(month), F.lit("Marco"), F.lit("Março")),
                                   F.lit(" de "), F.year(d).cast("string"))).otherwise(F.date_format(d, "'31/02/'yyyy")))
    return table(spark, sf, "orders").select("o_orderkey", X.parse_date(text).alias("value"))


def _dated_chunks(spark, sf):
    """One chunk per order; the true date is the order date, a second date stands further away."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("case_id"), k.alias("page_number"), F.lit(0).alias("chunk_index"),
        F.concat(F.when(k % 2 == 0, "Decisão de 01/02/1990 nos autos. ").otherwise(""), F.lit("Recebo a denúncia em "), F.date_format(d, "dd/MM/yyyy"),
                 F.lit(". O réu, nascido aos "), F.date_format(F.date_add(F.to_date(d), -9000), "dd-MM-yyyy"),
                 F.lit(", responde pelo art. "), (k % 50 + 120).cast("string"),
                 F.when(k % 3 == 0, ", pena - reclusão, de 2 a 8 anos").otherwise("")).alias("text"),
        F.when(k % 5 == 0, "baixa").when(k % 5 == 1, "media").otherwise("alta").alias("source_confidence"))


EVENTS = """
ev AS (
  SELECT o_custkey AS case_id, o_orderkey AS page_number, 'recebimento_denuncia' AS event_type, o_orderdate::DATE AS value FROM orders UNION ALL
  SELECT o_custkey, o_orderkey, 'nascimento_reu', o_orderdate::DATE - 9000 FROM orders),
conf AS (SELECT *, CASE WHEN page_number % 5 = 0 THEN 'baixa' ELSE 'media' END AS confidence FROM ev)"""


@query("x02_dated_events", "WITH" + EVENTS + " SELECT case_id, page_number, event_type, value::VARCHAR AS value, confidence FROM conf")
def x02(spark, sf):
    return X.dated_events(_dated_chunks(spark, sf)).select("case_id", "page_number", "event_type", "value", "confidence")


@query("x02_decomposed_events", "WITH" + EVENTS + " SELECT case_id, page_number, event_type, value::VARCHAR AS value, confidence FROM conf")
def x02_decomposed(spark, sf):
    """The same texts with decomposed accents give the same events; raw values are cut out of the stored spelling."""
    chunks = _dated_chunks(spark, sf)
    found = X.dated_events(chunks.withColumn("text", decomposed("text")))
    return found.where(F.col("raw_value") == decomposed("raw_value")).select("case_id", "page_number", "event_type", "value", "confidence")


@query("x03_dedupe_events", "WITH" + EVENTS + """
SELECT case_id, event_type, value::VARCHAR AS value, arg_min(page_number, (confidence = 'baixa', page_number)) AS page_number,
  max(confidence) AS confidence FROM conf GROUP BY 1, 2, 3""")
def x03(spark, sf):
    return X.dedupe_events(X.dated_events(_dated_chunks(spark, sf))).select("case_id", "event_type", "value", "page_number", "confidence")


@query("x04_offence_citations", """
SELECT o_custkey AS case_id, 'art. ' || (o_orderkey % 50 + 120) AS article,
  CASE WHEN min(o_orderkey % 3) = 0 THEN 96::BIGINT END AS max_months, arg_min(o_orderkey, (o_orderkey % 3 <> 0, o_orderkey)) AS page_number
FROM orders GROUP BY 1, 2""")
def x04(spark, sf):
    return X.offence_citations(_dated_chunks(spark, sf)).select("case_id", "article", "max_months", "page_number")


@query("x05_missing_fields", f"""
SELECT c_custkey AS case_id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN '{X.REQUIRED[0][1]}'
  ELSE '{X.REQUIRED[0][1]}|{X.REQUIRED[1][1]}|{X.REQUIRED[2][1]}|{X.MISSING_OFFENCE}' END AS missing_fields FROM customer""")
def x05(spark, sf):
    chunks = _dated_chunks(spark, sf)
    cases = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"))
    return X.missing_fields(cases, X.dated_events(chunks), X.offence_citations(chunks))
