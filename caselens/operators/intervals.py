"""Limitation periods over date intervals.

Dates of one offence are few by nature: after the removal of repeats there is at most one row per day, so
everything per offence works on short sorted arrays or windows of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions.text import flags

# Fixed values: (longest penalty in months from, period in months), types and the date of the rule change.
PERIODS = [(145, 240), (97, 192), (49, 144), (25, 96), (12, 48), (1, 36)]
EXCEPTION_FROM = "2025-07-04"
CONVICTIONS = ("sentenca_condenatoria_recorrivel", "acordao_condenatorio_recorrivel")
MILESTONE_TYPES = (
    "recebimento_denuncia",
    "recebimento_queixa",
    "pronuncia",
    "confirmacao_pronuncia",
    "sentenca_condenatoria_recorrivel",
    "acordao_condenatorio_recorrivel",
)
TERM_TYPES = ("consumacao", "fim_tentativa", "fim_permanencia", "conhecimento_fato", "vitima_18_anos")
SUSPENSION_TYPES = ("art_116", "cpp_366", "cpp_368", "outra_legal")
SENTENCE_STATES = ("nao_proferida", "proferida", "desconhecida")
MISSING_BIRTH = "Data de nascimento do reu para avaliar o art. 115 do Codigo Penal."
MISSING_SENTENCE = "Data da sentenca condenatoria informada como proferida."
MISSING_STATE = "Situacao e data da sentenca para avaliar se o reu tinha mais de 70 anos."
MISSING_VIOLENCE = (
    "Confirmacao sobre violencia sexual contra mulher para aplicar a redacao vigente do art. 115 do Codigo Penal."
)
MISSING_CONVICTION = (
    "Data de publicacao da sentenca ou acordao condenatorio recorrivel como marco interruptivo."
)
MISSING_END = "Data final de cada periodo de suspensao; suspensao aberta nao e estimada."
WARNING_366 = "A suspensao do art. 366 do CPP exige conferir o limite da Sumula 415 do STJ."
YOUNG = "reu_menor_de_21_na_data_do_fato"
OLD = "reu_maior_de_70_na_data_da_sentenca"
LATE = "prazo_esgotado_no_calculo"


def base_period(months: Column) -> Column:
    """NULL for a penalty that is not positive."""
    out = F.when(months >= PERIODS[0][0], PERIODS[0][1])
    for start, period in PERIODS[1:]:
        out = out.when(months >= start, period)
    return out


def age_on(birth: Column, day: Column) -> Column:
    before = (F.month(day) * 100 + F.day(day)) < (F.month(birth) * 100 + F.day(birth))
    return F.year(day) - F.year(birth) - before.cast("int")


def age_reduction(offences: DataFrame) -> DataFrame:
    """Adds missing_fields and reasons."""
    birth, known = F.col("birth_date"), F.col("birth_date").isNotNull()
    passed, unknown = F.col("sentence_status") == "proferida", F.col("sentence_status") == "desconhecida"
    dated = F.col("sentence_date").isNotNull()
    young = known & (age_on(birth, F.col("fact_date")) < 21)
    old = known & passed & dated & (age_on(birth, F.col("sentence_date")) > 70)
    exception = (young | old) & (F.col("fact_date") >= F.lit(EXCEPTION_FROM).cast("date"))
    violence = F.col("sexual_violence_against_woman")
    reasons = flags((young, YOUNG), (old, OLD))
    none = F.array().cast("array<string>")
    return offences.withColumn("missing_fields", flags(
        (~known, MISSING_BIRTH),
        (known & passed & ~dated, MISSING_SENTENCE),
        (known & unknown & (age_on(birth, F.col("reference_date")) > 70), MISSING_STATE),
        (exception & violence.isNull(), MISSING_VIOLENCE),
    )).withColumn("reasons", F.when(exception & F.coalesce(violence, F.lit(False)), none).otherwise(reasons))


def merge_intervals(df: DataFrame, key: str = "offence_id") -> DataFrame:
    """Union of closed intervals; intervals that touch are one."""
    longest = df.where(F.col("end_date").isNotNull()).groupBy(key, "start_date").agg(F.max("end_date").alias("end_date"))
    order = Window.partitionBy(key).orderBy("start_date")
    reach = F.max("end_date").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start_date") > reach).cast("int"), F.lit(1))
    island = F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        longest.withColumn("_open", opens).withColumn("_island", island)
        .groupBy(key, "_island").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"))
        .drop("_island")
    )


def deadline_with_suspensions(start: Column, months: Column, suspensions: Column, end: Column) -> Column:
    """struct(deadline, suspended_days). A suspension counts if it begins by the deadline as already extended,
    so the merged suspensions are folded in order."""
    zero = F.struct(F.date_sub(F.add_months(start, months), 1).alias("deadline"), F.lit(0).alias("suspended_days"))

    def extend(acc: Column, s: Column) -> Column:
        begin = F.greatest(s["start_date"], start)
        counts = (s["start_date"] < end) & (s["end_date"] > begin) & (begin <= acc["deadline"])
        days = F.when(counts, F.date_diff(s["end_date"], begin)).otherwise(0)
        return F.struct(F.date_add(acc["deadline"], days).alias("deadline"),
                        (acc["suspended_days"] + days).alias("suspended_days"))

    return F.aggregate(suspensions, zero, extend)


def suspension_lists(suspensions: DataFrame) -> DataFrame:
    merged = merge_intervals(suspensions)
    return merged.groupBy("offence_id").agg(
        F.sort_array(F.collect_list(F.struct("start_date", "end_date"))).alias("suspensions"))


def limitation_intervals(offences: DataFrame, milestones: DataFrame, suspensions: DataFrame) -> DataFrame:
    """J04 and J05. ``offences``: offence_id, term_date, period (months), reference_date; ``milestones``: offence_id,
    event_type, event_date; ``suspensions``: offence_id, start_date, end_date.

    One row per interval; nothing follows the first milestone after its deadline.
    """
    none = F.array().cast("array<struct<start_date:date,end_date:date>>")
    base = offences.select("offence_id", "term_date", "period", "reference_date").join(
        suspension_lists(suspensions), "offence_id", "left").withColumn("suspensions", F.coalesce("suspensions", none))
    events = milestones.groupBy("offence_id", "event_date").agg(F.min("event_type").alias("event_type"))
    rows = (
        events.withColumn("_last", F.lit(False)).join(base, "offence_id")
        .unionByName(base.withColumns({"event_date": F.col("reference_date"), "event_type": F.lit("data_referencia"),
                                       "_last": F.lit(True)}))
    )
    order = Window.partitionBy("offence_id").orderBy("_last", "event_date")
    start = F.coalesce(F.lag("event_date").over(order), F.col("term_date"))
    timed = rows.withColumn("start_date", start).withColumn(
        "_d", deadline_with_suspensions(F.col("start_date"), F.col("period"), F.col("suspensions"), F.col("event_date")))
    late = F.col("event_date") > F.col("_d.deadline")
    earlier = F.coalesce(F.bool_or(~F.col("_last") & F.col("_late")).over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    status = (
        F.when(~F.col("_last"), F.when(F.col("_late"), "prazo_esgotado_antes_do_marco").otherwise("interrompido_em_tempo"))
        .when(F.col("_late"), LATE).when(F.col("event_date") == F.col("_d.deadline"), "vence_na_data_referencia")
        .otherwise("prazo_nao_esgotado_no_calculo")
    )
    return (
        timed.withColumn("_late", late).withColumn("_cut", earlier).where(~F.col("_cut"))
        .select("offence_id", "start_date", F.col("_d.deadline").alias("deadline"), F.col("event_date").alias("end_date"),
                F.col("event_type").alias("end_reason"), status.alias("status"),
                F.col("_d.suspended_days").alias("suspended_days"))
    )


def limitation_status(offences: DataFrame, milestones: DataFrame, suspensions: DataFrame) -> DataFrame:
    """One row per offence. An offence with missing facts is inconclusive and has no deadline."""
    convicted = milestones.where(F.col("event_type").isin(*CONVICTIONS)).select("offence_id").distinct().withColumn(
        "_convicted", F.lit(True))
    opened = suspensions.where(F.col("end_date").isNull()).groupBy("offence_id").agg(
        F.lit(True).alias("_open"), F.bool_or(F.col("suspension_type") == "cpp_366").alias("_open366"))
    facts = (
        age_reduction(offences).join(convicted, "offence_id", "left").join(opened, "offence_id", "left")
        .withColumn("base_period", base_period(F.col("max_months")))
    )
    no = F.lit(False)
    more = flags(
        ((F.col("sentence_status") == "proferida") & ~F.coalesce("_convicted", no), MISSING_CONVICTION),
        (F.coalesce("_open", no), MISSING_END))
    facts = facts.withColumn("missing_fields", F.concat("missing_fields", more)).withColumn(
        "warnings", flags((F.coalesce("_open366", no), WARNING_366)))
    complete = F.size("missing_fields") == 0
    halved = F.when(F.size("reasons") > 0, F.floor(F.col("base_period") / 2)).otherwise(F.col("base_period")).cast("int")
    facts = facts.withColumn("period", F.when(complete, halved))
    last = limitation_intervals(facts.where(complete), milestones, suspensions).groupBy("offence_id").agg(
        F.max_by(F.struct("status", "deadline"), F.struct("end_date", F.col("end_reason") == "data_referencia")).alias("_l"))
    status = F.when(~complete, "inconclusivo").when(F.col("_l.status") == "prazo_esgotado_antes_do_marco", LATE).otherwise(
        F.col("_l.status"))
    return (
        facts.join(last, "offence_id", "left")
        .withColumn("status", status).withColumn("final_deadline", F.col("_l.deadline"))
        .withColumn("days_to_deadline", F.date_diff("final_deadline", "reference_date"))
        .select("case_id", "offence_id", "status", "base_period", F.col("period").alias("applied_period"),
                F.when(complete, F.col("reasons")).otherwise(F.array().cast("array<string>")).alias("reasons"),
                "final_deadline", "days_to_deadline", "missing_fields", "warnings")
    )


def overall_status(offence_status: DataFrame) -> DataFrame:
    """J06 per case: the worst offence decides."""
    has = lambda s: F.bool_or(F.col("status") == s)
    return offence_status.groupBy("case_id").agg(
        F.when(has("inconclusivo"), "inconclusivo").when(has(LATE), "ha_prazo_esgotado_no_calculo")
        .when(has("vence_na_data_referencia"), "ha_prazo_no_limite")
        .otherwise("prazos_nao_esgotados_no_calculo").alias("overall_status"))


def limitation_violations(offences: DataFrame, milestones: DataFrame, suspensions: DataFrame) -> DataFrame:
    """(offence_id, violation), one row per broken input rule."""
    o = lambda n: F.col(n)
    has_sentence, ref = o("sentence_date").isNotNull(), o("reference_date")
    per_offence = offences.select("offence_id", F.explode(flags(
        (~o("sentence_status").isin(*SENTENCE_STATES), "situacao_sentenca_invalida"),
        ((o("sentence_status") != "proferida") & has_sentence, "data_sentenca_sem_sentenca"),
        (o("birth_date") > ref, "nascimento_futuro"),
        (has_sentence & (o("sentence_date") > ref), "sentenca_futura"),
        (o("max_months") <= 0, "pena_invalida"),
        (~o("term_type").isin(*TERM_TYPES), "termo_inicial_nao_suportado"),
        (o("fact_date") > ref, "fato_futuro"),
        (o("term_date") < o("fact_date"), "termo_antes_do_fato"),
        (o("term_date") > ref, "termo_futuro"),
        (has_sentence & (o("sentence_date") < o("term_date")), "sentenca_antes_do_termo"),
    )).alias("violation"))
    repeated = offences.groupBy("case_id", "offence_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "offence_id", F.lit("delito_repetido").alias("violation"))
    context = offences.select("offence_id", "term_date", "reference_date", "sentence_status").distinct()
    # Milestones are reduced to one row per offence and day before anything is compared.
    days = milestones.groupBy("offence_id", "event_date").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(~F.col("event_type").isin(*MILESTONE_TYPES)).alias("unknown"),
        F.bool_or(F.col("event_type").isin(*CONVICTIONS)).alias("conviction"))
    listed = suspensions.where(F.col("end_date") > F.col("start_date"))
    inside = F.exists("suspensions", lambda s: (s["start_date"] <= F.col("event_date")) & (F.col("event_date") < s["end_date"]))
    per_day = days.join(context, "offence_id").join(suspension_lists(listed), "offence_id", "left").select(
        "offence_id", F.explode(flags(
            (F.col("unknown"), "marco_nao_suportado"),
            (F.col("event_date") < F.col("term_date"), "marco_antes_do_termo"),
            (F.col("event_date") > ref, "marco_futuro"),
            (F.col("n") > 1, "marcos_na_mesma_data"),
            (F.col("conviction") & (F.col("sentence_status") != "proferida"), "marco_condenatorio_sem_sentenca"),
            (F.coalesce(inside, F.lit(False)), "marco_dentro_de_suspensao"),
        )).alias("violation"))
    per_suspension = suspensions.join(context, "offence_id").select("offence_id", F.explode(flags(
        (~F.col("suspension_type").isin(*SUSPENSION_TYPES), "suspensao_nao_suportada"),
        (F.col("start_date") < F.col("term_date"), "suspensao_antes_do_termo"),
        (F.col("start_date") > ref, "suspensao_futura"),
        (F.col("end_date") <= F.col("start_date"), "fim_da_suspensao_invalido"),
        (F.col("end_date") > ref, "fim_da_suspensao_futuro"),
    )).alias("violation"))
    return per_offence.unionByName(repeated).unionByName(per_day).unionByName(per_suspension).distinct()
