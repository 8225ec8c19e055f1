"""Suite adaptation and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.functions.text import flags, present

# States and names of the adapted suite.
REVIEW_STATES = ("pending", "approved", "rejected")
ENGINE = "recuperacao_hibrida"
FOUND, NOT_FOUND = "fontes_relevantes_localizadas", "fontes_relevantes_nao_localizadas"


def adapt_suite(cases: DataFrame, report: DataFrame, test_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(adapted cases with their observation, violations).

    ``cases``: process_id, case_id, question, expected_pages, review_status; ``report``: process_id, case_id, question,
    expected_pages, pages, hit, latency_ms; ``test_ids``: process_id. A process goes to one split as a whole.
    """
    keys = ["process_id", "case_id"]
    left = cases.withColumn("_left", F.lit(True))
    right = report.select(*keys, F.col("question").alias("r_question"), F.col("expected_pages").alias("r_expected"), "pages", "hit", "latency_ms",
                          F.lit(True).alias("_right"))
    both = left.join(right, keys, "full_outer")
    codes = flags(
        (F.col("_right").isNull(), "caso_ausente_no_relatorio"), (F.col("_left").isNull(), "caso_desconhecido_no_relatorio"),
        (F.col("_left") & F.col("_right") & ~F.col("question").eqNullSafe(F.col("r_question")), "pergunta_divergente"),
        (F.col("_left") & F.col("_right") & ~F.col("expected_pages").eqNullSafe(F.col("r_expected")), "paginas_divergentes"),
        (F.col("_right") & F.col("hit").isNull(), "hit_ausente"), (F.col("latency_ms") < 0, "latencia_negativa"))
    unknown = test_ids.join(cases.select("process_id").distinct(), "process_id", "left_anti").select(
        "process_id", F.lit(None).cast(cases.schema["case_id"].dataType).alias("case_id"), F.lit("processo_de_teste_desconhecido").alias("violation"))
    violations = both.select(*keys, F.explode(codes).alias("violation")).unionByName(unknown)
    tests = test_ids.select("process_id").distinct().withColumn("_test", F.lit(True))
    status = F.when(F.col("review_status") == "approved", "legal_approved").when(F.col("review_status") == "rejected", "rejected").otherwise("pending")
    adapted = both.where(F.col("_left") & F.col("_right")).join(tests, "process_id", "left").select(
        "process_id", F.concat_ws(".", F.col("process_id").cast("string"), F.col("case_id").cast("string")).alias("case_id"), F.lit(ENGINE).alias("engine"),
        F.when(F.col("_test"), "test").otherwise("development").alias("split"), status.alias("review_status"), F.lit(FOUND).alias("expected_label"),
        F.col("expected_pages").alias("relevant_pages"), F.when(F.col("hit"), FOUND).otherwise(NOT_FOUND).alias("label"),
        F.array_distinct("pages").alias("source_pages"), "latency_ms", F.lit(0).alias("llm_calls"))
    return adapted, violations


def suite_violations(cases: DataFrame, page_counts: DataFrame | None = None) -> DataFrame:
    """(process_id, case_id, violation). Ids must be unique, pages ascending and within the process, terms unique,
    and a review state needs its reviewer. ``page_counts``: process_id, page_count."""
    pages, terms = F.col("expected_pages"), F.transform("expected_terms", lambda t: F.lower(F.trim(t)))
    status, reviewer = F.col("review_status"), F.col("reviewer").isNotNull()
    rows = cases if page_counts is None else cases.join(page_counts, "process_id", "left")
    bound = F.lit(False) if page_counts is None else F.array_max(pages) > F.col("page_count")
    codes = flags(
        (F.coalesce(F.size(pages), F.lit(0)) <= 0, "paginas_vazias"), (F.array_min(pages) <= 0, "pagina_nao_positiva"),
        (pages != F.array_sort(F.array_distinct(pages)), "paginas_fora_de_ordem"), (bound, "pagina_inexistente"),
        (F.coalesce(F.size(terms), F.lit(0)) <= 0, "termos_vazios"), (F.exists(terms, lambda t: t == ""), "termo_vazio"),
        (F.size(terms) > F.size(F.array_distinct(terms)), "termos_duplicados"), (~status.isin(*REVIEW_STATES), "revisao_invalida"),
        (F.col("reviewer").isNotNull() & ~present(F.col("reviewer")), "revisor_vazio"),
        ((status == "pending") & reviewer, "revisor_em_pendente"), ((status != "pending") & ~reviewer, "revisor_ausente"))
    keys = ["process_id", "case_id"]
    repeated = cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, F.lit("id_duplicado").alias("violation"))
    return rows.select(*keys, F.explode(codes).alias("violation")).unionByName(repeated)
