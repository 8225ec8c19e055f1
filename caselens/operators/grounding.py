"""What an answer cites, how far it is covered, and the answer log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.numbering import number_rows
from caselens.functions.text import flags, strip

# Page citation forms and phrases an answer is read for.
PAGE_CITATION = r"(?i)\[?\s*(?:p|pag|pagina)\.?\s*(\d+)\s*\]?"
PAGE_BLOCK = r"(?i)\[\s*(?:p|pp|pag|pagina)s?\.?\s*([0-9][0-9,\s;e-]*)\]"
CAUTION_PHRASES = (
    "nao consta",
    "nao ha base",
    "nao foi encontrado",
    "precisa ser confirmado",
    "precisa ser confirmada",
    "precisa confirmar",
    "deve ser confirmado",
    "deve ser confirmada",
    "as fontes indicam",
    "os trechos indicam",
    "ponto de conferencia",
)
NO_SOURCE_PHRASES = ("nao encontrei base suficiente", "nao ha base suficiente")
BROAD_PHRASES = (
    "processo inteiro",
    "todo o processo",
    "todos os fatos",
    "todas as provas",
    "todos os documentos",
    "resumo completo",
    "analise completa",
    "análise completa",
    "visao geral completa",
    "visão geral completa",
)
MIN_CLAIM_CHARS = 45


def cited_pages_of(text: Column) -> Column:
    """Single citations and every number of a bracketed list."""
    single = F.regexp_extract_all(text, F.lit(PAGE_CITATION), F.lit(1))
    blocks = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(PAGE_BLOCK), F.lit(1)),
                                   lambda b: F.regexp_extract_all(b, F.lit(r"(\d+)"), F.lit(1))))
    pages = F.transform(F.concat(single, blocks), lambda p: p.try_cast("bigint"))
    return F.array_sort(F.array_distinct(F.filter(pages, lambda p: p.isNotNull())))


def cited_pages(answers: DataFrame) -> DataFrame:
    return answers.withColumn("cited_pages", cited_pages_of(F.col("content")))


def claim_lines_of(text: Column) -> Column:
    stripped = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip)
    plain = F.filter(stripped, lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    bare = F.transform(plain, lambda x: strip(F.regexp_replace(x, r"^[*\-\d.\s]+", "")))
    return F.filter(bare, lambda x: (F.length(x) >= MIN_CLAIM_CHARS) & x.rlike("[A-Za-z]"))


def citation_coverage(answers: DataFrame) -> DataFrame:
    """G02."""
    counted = answers.withColumn("_claims", claim_lines_of(F.col("content")))
    cited = F.size(F.filter("_claims", lambda x: x.rlike(PAGE_CITATION)))
    return (
        counted.withColumn("claim_lines", F.size("_claims"))
        .withColumn("cited_claim_lines", cited)
        .withColumn("citation_coverage", F.coalesce(
            F.round(F.try_divide(F.col("cited_claim_lines"), F.col("claim_lines")), 4), F.lit(0.0)))
        .drop("_claims")
    )


def _count_phrase(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))
    return (removed / len(phrase)).cast("int")


def _has_any(text: Column, phrases: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.contains(text, F.lit(phrase))
    return hit


def grounding(answers: DataFrame) -> DataFrame:
    """G01-G04. ``answers``: content, source_pages (array of page numbers given to the model)."""
    lowered = F.lower("content")
    caution = sum((_count_phrase(lowered, p) for p in CAUTION_PHRASES[1:]), _count_phrase(lowered, CAUTION_PHRASES[0]))
    read = (
        citation_coverage(cited_pages(answers))
        .withColumn("unsupported_pages", F.array_except("cited_pages", F.col("source_pages").cast("array<bigint>")))
        .withColumn("uncertainty_markers", caution)
        .withColumn("no_source_answer", _has_any(lowered, NO_SOURCE_PHRASES))
    )
    unsupported = F.size("unsupported_pages") > 0
    many, coverage = F.col("claim_lines") >= 3, F.col("citation_coverage")
    risk = (
        F.when(unsupported, "alto").when(F.col("no_source_answer"), "baixo")
        .when(many & (coverage < 0.35), "alto").when(many & (coverage < 0.65), "medio").otherwise("baixo")
    )
    return read.withColumn("rule_risk", risk).withColumn("notes", flags(
        ((F.size("source_pages") == 0) & ~F.col("no_source_answer"), "resposta sem fontes recuperadas"),
        (unsupported, "citou pagina que nao veio das fontes recuperadas"),
        (many & (coverage < 0.65), "muitas linhas afirmativas sem citacao de pagina"),
        (F.col("uncertainty_markers") > 0, "usa linguagem de cautela ou confirma lacunas"),
        (F.col("no_source_answer"), "resposta declarou falta de base suficiente"),
    ))


def calibrated_risk(df: DataFrame) -> DataFrame:
    """judge_risk is NULL where no judge ran."""
    judge, rule = F.col("judge_risk"), F.col("rule_risk")
    return df.withColumn("calibrated_risk", F.when(judge.isNull(), rule)
                         .when(rule == "alto", "alto")
                         .when((judge == "alto") & (rule == "baixo"), "revisao_manual")
                         .when(judge == "alto", "alto")
                         .when((judge == "medio") | (rule == "medio"), "medio")
                         .otherwise("baixo"))


SCORES = ("fidelidade_fontes", "completude_juridica", "utilidade_audiencia")
LISTS = ("pontos_fortes", "problemas", "faltou")


def parse_judgements(df: DataFrame, reply: str = "raw_response") -> DataFrame:
    """Fields of the JSON object in a fence or between the outer braces; a bad reply is a failed row."""
    text = strip(reply)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    body = F.when(fenced != "", fenced).when(braces != "", braces)
    # As the only element of a list, text after the object makes the reply invalid.
    parsed = df.withColumn("_p", F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))))
    only = F.try_variant_get("_p", "$[0]", "variant")
    is_object = F.schema_of_variant(only).startswith("OBJECT") & F.try_variant_get("_p", "$[1]", "variant").isNull()
    parsed = parsed.withColumn("_ok", F.coalesce(is_object, F.lit(False)))

    def field(name: str, kind: str) -> Column:
        return F.when(F.col("_ok"), F.try_variant_get("_p", f"$[0].{name}", kind))

    def score(name: str) -> Column:
        number = F.floor(F.coalesce(field(name, "double"), F.trim(field(name, "string")).try_cast("bigint").cast("double")))
        return F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(number.cast("int"), F.lit(1))))

    def items(name: str) -> Column:
        listed = F.filter(field(name, "array<string>"), lambda x: F.length(strip(x)) > 0)
        return F.coalesce(listed, F.array().cast("array<string>"))

    def words(name: str, default: str) -> Column:
        value = field(name, "string")
        return F.when(F.coalesce(value, F.lit("")) == "", F.lit(default)).otherwise(value)

    failed = "Nao foi possivel avaliar a qualidade juridica automaticamente."
    out = parsed
    for name in SCORES:
        out = out.withColumn(name, score(name))
    for name in LISTS:
        out = out.withColumn(name, items(name))
    return (
        out.withColumn("risco_alucinacao", words("risco_alucinacao", "indefinido"))
        .withColumn("veredito", F.when(F.col("_ok"), words("veredito", "Avaliacao sem veredito.")).otherwise(failed))
        .withColumn("error", F.when(~F.col("_ok"), "avaliador retornou JSON invalido"))
        .drop("_p", "_ok")
    )


def answer_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """Means over judged rows without an error; risks over all rows."""
    judged = F.col("error").isNull() & F.col("judge_risk").isNotNull()
    means = [F.coalesce(F.round(F.avg(F.when(judged, F.col(s))), 4), F.lit(0.0)).alias(f"average_{s}") for s in SCORES]
    return df.groupBy(*keys).agg(
        *means,
        F.count_if(F.coalesce(F.col("judge_risk") == "alto", F.lit(False))).alias("high_risk_count"),
        F.count_if(F.col("calibrated_risk") == "alto").alias("calibrated_high_risk_count"),
        F.count_if(F.col("calibrated_risk") == "revisao_manual").alias("manual_review_count"),
    )


def abstention(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``hits``: query_id, source_confidence, hostile (boolean)."""
    safe = ~F.col("hostile")
    counts = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_sources"), F.count_if(safe).alias("n_safe"),
        F.count_if(safe & F.col("source_confidence").isin("alta", "media")).alias("n_usable"))
    reason = (
        F.when(F.coalesce("n_sources", F.lit(0)) == 0, "sem_fontes").when(F.col("n_safe") == 0, "fontes_adversariais")
        .when(F.col("n_usable") == 0, "baixa_confianca").otherwise("respondivel")
    )
    return queries.join(counts, "query_id", "left").withColumn("reason", reason).na.fill(
        0, ["n_sources", "n_safe", "n_usable"])


def notices(df: DataFrame) -> DataFrame:
    """``df``: question, answer, flagged_pages, excluded_pages."""
    def pages(name: str) -> Column:
        return F.array_join(F.transform(name, lambda p: F.concat(F.lit("[p. "), p.cast("string"), F.lit("]"))), ", ")

    parts = flags(
        (F.size("flagged_pages") > 0, F.concat(
            F.lit("Aviso de seguranca: trechos potencialmente adversariais foram desconsiderados em "),
            pages("flagged_pages"), F.lit("."))),
        (F.size("excluded_pages") > 0, F.concat(
            F.lit("Aviso de extracao: fontes de baixa confianca ou ainda nao classificadas foram desconsideradas em "),
            pages("excluded_pages"), F.lit("."))),
        (_has_any(F.lower("question"), BROAD_PHRASES),
         "Limite de cobertura: esta resposta usa os trechos mais relevantes recuperados e nao garante uma leitura "
         "integral de todas as paginas."),
    )
    return df.withColumn("decorated", F.concat_ws("\n\n", F.array(F.col("answer")), parts))


def answer_log(messages: DataFrame, hits: DataFrame, block: int = 65536) -> DataFrame:
    """Messages in order, each with the set of pages it was answered from (at most its top k)."""
    pages = hits.groupBy("case_id", "seq").agg(F.array_sort(F.collect_set("page_number")).alias("retrieved_pages"))
    ordered = number_rows(messages, ["case_id"], "seq", "position", block)
    empty = F.array().cast("array<int>")
    return ordered.join(pages, ["case_id", "seq"], "left").withColumn(
        "retrieved_pages", F.coalesce(F.col("retrieved_pages").cast("array<int>"), empty))


def latency_summary(timings: DataFrame, setup_ms: float = 0.0, call_ms: float | None = None) -> DataFrame:
    """First run, median of the others (or the first again), cold and warm totals.

    ``timings``: case_id, run_order (sortable and unique per case), latency. No ordering of whole cases is
    needed: the first run is a partial aggregate and is taken out of the exact median by its order value.
    """
    first = timings.groupBy("case_id").agg(F.min_by("latency", "run_order").alias("first_ms"),
                                           F.min("run_order").alias("_first"))
    rest = timings.join(first.select("case_id", "_first"), "case_id").where(F.col("run_order") > F.col("_first"))
    warm = rest.groupBy("case_id").agg(F.median("latency").alias("_warm"))
    out = first.drop("_first").join(warm, "case_id", "left").withColumn(
        "warm_ms", F.round(F.coalesce("_warm", "first_ms"), 4)).drop("_warm")
    call = F.lit(call_ms).cast("double")
    return out.withColumn("cold_total", F.round(F.lit(setup_ms) + F.col("first_ms") + call, 4)).withColumn(
        "warm_total", F.round(F.col("warm_ms") + call, 4))
