"""Checking claimed quotations and deriving conclusions from checked evidence only.

Model output comes as tables of claims. A quotation counts only where it stands in the stored text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.aligned import SPECIAL, aligned, composed, stored_cut
from caselens.functions.matching import once, pinned
from caselens.functions.numbering import first_per_key, top_per_key
from caselens.functions.scratch import written
from caselens.functions.text import BLANK_RUN, LATIN_BLANK_RUN, flags, fold, present, squash, squash_fold, strip
from caselens.operators.safety import USABLE, injection_reasons_of

# Limits and vocabularies of the checks.
MIN_QUOTE_CHARS = 8
MIN_QUESTION_CHARS = 12
MIN_EXCERPT_CHARS = 25
MIN_EXCERPT_WORDS = 6
RESULTS = ("observado", "nao_observado", "nao_localizado", "nao_aplicavel")
UNPROVED = "O resultado proposto nao possuia trecho literal validado no processo."
NOT_FOUND = "Nao foi localizada informacao suficiente para este requisito."
CONFIDENCES = ("baixa", "media", "alta")
QUESTION_TYPES = ("esclarecimento", "cronologia", "percepcao", "contradicao_potencial", "confirmacao")
SINGLE_EVENTS = ("data_fato", "nascimento_reu", "recebimento_denuncia")
EVENT_TYPES = ("data_fato", "nascimento_reu", "recebimento_denuncia", "suspensao_inicio", "suspensao_fim", "prisao",
               "liberdade", "audiencia", "outro")
EVENT_TERMS = {
    "data_fato": ("dos fatos", "fato ocorreu", "consta do incluso inquerito"),
    "nascimento_reu": ("nascid", "data de nascimento"),
    "recebimento_denuncia": ("recebo a denuncia", "recebimento da denuncia"),
    "suspensao_inicio": ("suspens", "artigo 366", "art. 366"),
    "suspensao_fim": ("suspens", "artigo 366", "art. 366"),
    "prisao": ("prisao", "preso"),
    "liberdade": ("liberdade", "soltura", "cautelar"),
    "audiencia": ("audiencia",),
}
RECOGNITION_CONTEXT = ("fotograf", "pessoal", "suspeit", "acusad", "vitima", "testemunh", "autor", "identific")
KNOWN_PERSON = ("ja conhecia", "conhecia o acusado", "conhecia o investigado", "conhecia o suspeito",
                "pessoa previamente conhecida", "indicou seu nome", "indicou o nome")
KNOWN_PERSON_ACTS = ("identific", "fotograf", "confirmar os dados")
SECTION_KEYS = ("marcos_essenciais", "depoimentos", "contradicoes")


def cleaned_quote(c: Column) -> Column:
    return strip(F.trim(strip(c), F.lit('"')))


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\^$.|?*+()\[\]{}])", r"\\$1")


def find_quote(text: Column, quote: Column) -> Column:
    """Stored spelling of a quotation: any case, any run of blanks of any kind for a space, accents composed or not; NULL when it is not there."""
    pattern = F.concat(F.lit("(?iu)"), F.replace(_escaped(composed(quote)), F.lit(" "), F.lit(BLANK_RUN)))

    def stored(view: Column) -> Column:
        place = lambda hit: F.instr(view["text"], hit) - 1
        return once(F.regexp_substr(view["text"], pattern), lambda hit: F.when(
            hit.isNotNull(), once(place(hit), lambda at: stored_cut(text, view, at, at + F.length(hit)))))

    return F.when(text.rlike(SPECIAL), once(aligned(text), stored)).otherwise(F.regexp_substr(text, pattern))


#: Latin-1, whose lower case is one character each and equal just where a pattern that ignores case takes two letters as equal.
LATIN = r"\A[\x00-\xFF]*+\z"


def find_loose(text: Column, quote: Column) -> Column:
    """As find_quote with every blank of the quotation loose; the result has single blanks.

    With single blanks on both sides, a Latin-1 quotation is a plain part of the lower-cased text. Only others need a pattern, which is compiled
    per quotation.
    """
    single = lambda c: F.trim(F.regexp_replace(c, LATIN_BLANK_RUN, " "))

    def plain(view: Column) -> Column:
        return once(F.instr(F.lower(view["text"]), F.lower(view["quote"])), lambda at: F.when(
            (at > 0) & (view["quote"] != ""), F.substring(view["text"], at, F.length(view["quote"]))))

    view = F.struct(single(text).alias("text"), single(quote).alias("quote"))
    return F.when(text.rlike(LATIN) & quote.rlike(LATIN), once(view, plain)).otherwise(squash(find_quote(text, squash(quote))))


def find_exact(text: Column, quote: Column) -> Column:
    """Stored spelling of a quotation that stands there as it is, case apart."""
    return F.regexp_substr(text, F.concat(F.lit("(?iu)"), _escaped(quote)))


def check_quotes(claims: DataFrame, sources: DataFrame, keys: list[str], min_chars: int = MIN_QUOTE_CHARS, loose: bool = True) -> DataFrame:
    """``claims``: case_id, source_id, item_no, quote, keys; ``sources``: case_id, source_id, text, page_number, ...

    Keeps what is found, in stored spelling (``exact``); repeats of a quotation count once per claim. With ``loose`` blanks and
    the spelling of accents don't matter.
    """
    asked = claims.withColumn("_q", cleaned_quote(F.col("quote"))).where(F.length("_q") >= min_chars)
    met = asked.join(sources, ["case_id", "source_id"])
    found = pinned(met, "exact", (find_quote if loose else find_exact)(F.col("text"), F.col("_q"))).where(F.col("exact").isNotNull()).drop("_q", "text")
    return first_per_key(found.withColumn("_fold", F.lower("exact")), [*keys, "source_id", "_fold"], [F.col("item_no")]).drop("_fold")


def pair_id(case: Column, a: Column, b: Column, *versions: str) -> Column:
    seed = F.concat_ws("|", case.cast("string"), F.least(a, b), F.greatest(a, b), *[F.lit(v) for v in versions])
    return F.concat(F.lit("cmp-"), F.substring(F.sha2(seed, 256), 1, 16))


def _speech_quote(claims: DataFrame, speech: DataFrame, who: str, quote: str, out: str) -> DataFrame:
    """First page of a testimony that holds the quotation."""
    segments = speech.select("case_id", F.col("testimony_id").alias(who), "page_number", "text")
    rows = claims.withColumn("_q", cleaned_quote(F.col(quote))).join(segments, ["case_id", who], "left")
    hit = pinned(rows, "_hit", F.when(F.length("_q") >= MIN_QUOTE_CHARS, find_quote(F.col("text"), F.col("_q"))))
    return hit.groupBy(*claims.columns).agg(
        F.min_by("_hit", F.when(F.col("_hit").isNotNull(), F.col("page_number"))).alias(out),
        F.min(F.when(F.col("_hit").isNotNull(), F.col("page_number"))).alias(f"{out}_page"))


def _first(df: DataFrame, keys: list[str], order: list[Column], limit: int | None) -> DataFrame:
    return df if limit is None else top_per_key(df, keys, order, limit, "_n").drop("_n")


def sanitize_comparisons(claims: DataFrame, speech: DataFrame, versions: tuple[str, ...] = ("1.0", "1.0"), limit: int | None = None) -> DataFrame:
    """``claims``: case_id, a_id, b_id, state, item_no, quote_a, quote_b; with ``limit`` only the first ones of a list."""
    listed = _first(claims, ["case_id", "a_id", "b_id", "state"], [F.col("item_no")], limit)
    both = _speech_quote(_speech_quote(listed, speech, "a_id", "quote_a", "exact_a"), speech, "b_id", "quote_b", "exact_b")
    valid = F.col("exact_a").isNotNull() & F.col("exact_b").isNotNull()
    named = both.withColumn("comparison_id", pair_id(F.col("case_id"), F.col("a_id"), F.col("b_id"), *versions)).withColumn("valid", valid)
    keys = ["case_id", "a_id", "b_id", "state", "_a", "_b"]
    kept = first_per_key(named.where("valid").withColumn("_a", F.lower("exact_a")).withColumn("_b", F.lower("exact_b")),
                         keys, [F.col("item_no")]).drop("_a", "_b")
    return kept.unionByName(named.where("not valid"))


def sanitize_questions(claims: DataFrame, supports: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """``claims``: case_id, item_no, question, kind, priority; ``supports``: case_id, item_no, support_no, source_id, quote;
    ``sources``: case_id, source_id, testimony_id, text. With ``limit`` only the first supports of a question count."""
    first = supports if limit is None else supports.where(F.col("support_no") <= limit)
    met = first.withColumnRenamed("support_no", "_s").join(sources, ["case_id", "source_id"])
    q = cleaned_quote(F.col("quote"))
    good = met.where((F.length(q) >= MIN_QUOTE_CHARS) & find_quote(F.col("text"), q).isNotNull())
    counted = good.groupBy("case_id", "item_no").agg(
        F.count(F.lit(1)).alias("supports"), F.count_distinct("testimony_id").alias("testimonies"))
    text = squash("question")
    asked = F.when(F.length(text) >= MIN_QUESTION_CHARS, F.when(F.endswith(text, F.lit("?")), text).otherwise(F.concat(text, F.lit("?"))))
    kind = F.lower(F.trim("kind"))
    rows = claims.join(counted, ["case_id", "item_no"]).withColumn("question", asked).withColumn(
        "kind", F.when(kind.isin(*QUESTION_TYPES), kind).otherwise("esclarecimento"))
    valid = rows.where(F.col("question").isNotNull() & ((F.col("kind") != "contradicao_potencial") | (F.col("testimonies") >= 2)))
    single = first_per_key(valid.withColumn("_k", F.lower("question")), ["case_id", "_k"], [F.col("item_no")]).drop("_k")
    return top_per_key(single, ["case_id"], [F.col("priority"), F.col("item_no")], 2**31 - 1, "position")


def fingerprint(comparisons: DataFrame, keys: list[str]) -> DataFrame:
    """Digest of the related comparisons; those of one testimony are few."""
    entry = F.concat_ws(":", "comparison_id", F.col("updated_at").cast("string"))
    joined = F.array_join(F.sort_array(F.collect_list(entry)), "|")
    return comparisons.groupBy(*keys).agg(F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))


def guide_id(case: Column, testimony: Column, transcription_version: str, mark: Column, guide_version: str) -> Column:
    seed = F.concat_ws("|", case.cast("string"), testimony, F.lit(transcription_version),
                       F.coalesce(mark, F.lit("sem-comparacoes")), F.lit(guide_version))
    return F.concat(F.lit("rot-"), F.substring(F.sha2(seed, 256), 1, 16))


def requirements(topics: DataFrame, cases: DataFrame, claims: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per case and catalogue requirement of its topic.

    ``topics``: topic_id, requirement_id, category, label, decisive, legal_ids, topic_legal_ids; ``cases``: case_id, topic_id;
    ``claims``: case_id, topic_id, requirement_id, result, justification, claimed_legal_ids; ``evidence``: case_id, topic_id,
    requirement_id, item_no, source_id, quote; ``sources``: case_id, source_id, text, page_number, source_confidence.
    """
    keys = ["case_id", "topic_id", "requirement_id"]
    checked = check_quotes(evidence, sources, keys, 1, loose=False).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evidence_count"), F.bool_or(F.col("source_confidence") == "media").alias("media_source"),
        F.array_sort(F.collect_set("page_number")).alias("pages"))
    rows = cases.join(topics, "topic_id").join(claims, keys, "left").join(checked, keys, "left")
    said = F.lower(F.trim(F.col("result")))
    result = F.when(said.isin(*RESULTS), said).otherwise("nao_localizado")
    count = F.coalesce("evidence_count", F.lit(0).cast("bigint"))
    proved = ~F.col("result").isin("observado", "nao_observado") | (F.col("evidence_count") > 0)
    none = F.array().cast("array<string>")
    chosen = F.array_intersect(F.coalesce("claimed_legal_ids", none), "topic_legal_ids")
    answered = F.col("justification").isNotNull()
    return (
        rows.withColumn("result", result).withColumn("evidence_count", count).withColumn("_proved", proved)
        .withColumn("justification", F.when(~answered, NOT_FOUND).when(~F.col("_proved"), UNPROVED).otherwise(F.trim("justification")))
        .withColumn("result", F.when(F.col("_proved"), F.col("result")).otherwise("nao_localizado"))
        .withColumn("legal_ids", F.when(F.size(chosen) > 0, chosen).otherwise(F.col("legal_ids")))
        .withColumn("media_source", F.coalesce("media_source", F.lit(False)))
        .withColumn("pages", F.coalesce("pages", F.array().cast("array<bigint>")))
        .drop("_proved", "claimed_legal_ids", "topic_legal_ids")
    )


def topic_has_evidence(sources: DataFrame, topics: DataFrame) -> DataFrame:
    """``topics``: case_id, topic_id, terms ARRAY; no terms means always. One pass, no text leaves its row."""
    terms = F.transform("terms", squash_fold)
    text = sources.select("case_id", squash_fold("text").alias("_t"))
    hit = text.join(topics, "case_id").where(F.exists(terms, lambda t: F.contains(F.col("_t"), t))).select("case_id", "topic_id").distinct()
    return topics.join(hit.withColumn("_hit", F.lit(True)), ["case_id", "topic_id"], "left").select(
        "case_id", "topic_id", (F.coalesce("_hit", F.lit(False)) | (F.size("terms") == 0)).alias("has_evidence"))


def _any_of(text: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(text, F.lit(term))
    return out


def recognition_evidence(text: Column) -> Column:
    """K06, recognition form."""
    t = squash_fold(text)
    return (F.contains(t, F.lit("reconhec")) & _any_of(t, RECOGNITION_CONTEXT)) | (_any_of(t, KNOWN_PERSON) & _any_of(t, KNOWN_PERSON_ACTS))


def conclusion(reqs: DataFrame) -> DataFrame:
    """Counts per category decide."""
    category, result, shown = F.col("category"), F.col("result"), F.col("evidence_count") > 0
    n = lambda cond: F.count_if(cond)
    violated = (category == "validade") & (result == "nao_observado") & shown
    counts = reqs.groupBy("case_id", "topic_id").agg(
        n(category == "aplicabilidade").alias("app"),
        n((category == "aplicabilidade") & (result == "observado") & shown).alias("app_yes"),
        n((category == "aplicabilidade") & result.isin("nao_observado", "nao_aplicavel") & shown).alias("app_no"),
        n(category == "validade").alias("val"), n(violated).alias("violations"),
        n((category == "validade") & result.isin("observado", "nao_aplicavel")).alias("val_fine"),
        n((category == "prejuizo") & (result == "observado") & shown).alias("harm"),
        n((category == "contrapeso") & (result == "observado") & shown).alias("counter"),
        n(violated & F.col("decisive")).alias("decisive"),
        F.sum(F.when(result.isin("observado", "nao_observado"), F.col("evidence_count")).otherwise(0)).alias("cited"),
        F.bool_or(result.isin("observado", "nao_observado") & F.col("media_source")).alias("media_cited"))
    c = F.col
    verdict = (
        F.when((c("app") > 0) & (c("app_yes") == 0), F.when(c("app_no") > 0, "nao_configurada").otherwise("inconclusiva"))
        .when(c("violations") > 0, F.when(((c("decisive") > 0) | (c("harm") > 0)) & (c("counter") == 0), "configurada")
              .otherwise("indicios_suficientes"))
        .when((c("val") > 0) & (c("val_fine") == c("val")), "nao_configurada").otherwise("inconclusiva")
    )
    return counts.select("case_id", "topic_id", verdict.alias("conclusion"), "cited", "media_cited")


def recognition_conclusion(reqs: DataFrame, raw: DataFrame) -> DataFrame:
    """``raw``: case_id, applicability (what the model said); the structured requirement wins."""
    category, result = F.col("category"), F.col("result")
    counts = reqs.groupBy("case_id").agg(
        F.max(F.when(F.col("requirement_id") == "pessoa_desconhecida", result)).alias("known"),
        F.count_if(category == "validade").alias("val"), F.count_if((category == "validade") & (result == "nao_observado")).alias("bad"),
        F.count_if((category == "validade") & result.isin("observado", "nao_aplicavel")).alias("fine"))
    said = F.lower(F.trim("applicability"))
    applies = (
        F.when(F.col("known") == "observado", "sim").when(F.col("known") == "nao_observado", "nao")
        .when(F.col("known").isNotNull(), "inconclusiva")
        .when(said.isin("sim", "nao", "inconclusiva"), said).otherwise("inconclusiva")
    )
    joined = raw.join(counts, "case_id", "left").withColumn("applicability", applies)
    zero = lambda name: F.coalesce(F.col(name), F.lit(0).cast("bigint"))
    verdict = (
        F.when(F.col("applicability") == "nao", "rito_formal_nao_aplicavel").when(F.col("applicability") != "sim", "inconclusivo")
        .when(zero("bad") > 0, "forte_fundamento_para_alegar_invalidade")
        .when((zero("val") > 0) & (zero("fine") == zero("val")), "procedimento_aparentemente_regular").otherwise("inconclusivo")
    )
    return joined.select("case_id", "applicability", verdict.alias("conclusion"))


def _rank(c: Column) -> Column:
    return F.greatest(F.array_position(F.array(*[F.lit(x) for x in CONFIDENCES]), F.coalesce(c, F.lit(""))), F.lit(1))


def cap_confidence(df: DataFrame) -> DataFrame:
    """``df``: conclusion, cited, media_cited, raw_confidence."""
    weak = F.col("conclusion").isin("inconclusiva", "inconclusivo", "reconhecimento_nao_localizado")
    negative = F.col("conclusion").isin("nao_configurada", "procedimento_aparentemente_regular", "rito_formal_nao_aplicavel")
    rank = _rank(F.lower(F.trim("raw_confidence")))
    top = F.when(weak, 1).when(negative, 2).when(F.col("cited") == 0, 1).when(F.col("media_cited"), 2).otherwise(3)
    names = F.array(*[F.lit(x) for x in CONFIDENCES])
    return df.withColumn("confidence", F.element_at(names, F.least(rank, top).cast("int")))


def gaps(reqs: DataFrame, model_gaps: DataFrame, model_limit: int | None = None, limit: int | None = None, chars: int | None = None) -> DataFrame:
    """Model gaps first, then unlocated requirements; a topic has few requirements.

    With ``model_limit`` and ``limit`` only the first ones, of the model's and of all; with ``chars`` each of the model's is cut.
    """
    cut = lambda c, n: c if n is None else F.slice(c, 1, n)
    said = cut(F.array_distinct(F.filter(F.transform("gaps", squash), lambda g: g != "")), model_limit)
    said = said if chars is None else F.transform(said, lambda g: F.substring(g, 1, chars))
    missing = reqs.where("result = 'nao_localizado'").groupBy("case_id", "topic_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("requirement_no", "label"))),
                    lambda r: F.concat(F.lit("Confirmar no processo: "), r["label"], F.lit("."))).alias("_m"))
    none = F.array().cast("array<string>")
    return model_gaps.join(missing, ["case_id", "topic_id"], "left").withColumn(
        "gaps", cut(F.array_union(said, F.coalesce("_m", none)), limit)).drop("_m")


def theses(
    claims: DataFrame, evidence: DataFrame, catalog: DataFrame, sources: DataFrame, limit: int | None = None, favourable: int | None = None, contrary: int | None = None,
) -> DataFrame:
    """``claims``: case_id, item_no, thesis_id, priority; ``evidence``: case_id, item_no, side, quote_no, source_id, quote;
    ``catalog``: thesis_id, title; ``sources``: case_id, source_id, page_number, text. With ``limit`` only the first claims of a case, with
    ``favourable`` and ``contrary`` only the first quotations of a side are read."""
    keys = ["case_id", "item_no"]
    listed = _first(claims, ["case_id"], [F.col("item_no")], limit).join(catalog, "thesis_id")
    allowed = F.when(F.col("side") == "favoravel", F.lit(favourable)).otherwise(F.lit(contrary))
    read = evidence.where(F.coalesce(F.col("quote_no") <= allowed, F.lit(True)))
    checked = check_quotes(read.withColumnRenamed("item_no", "claim_no").withColumnRenamed("quote_no", "item_no"), sources,
                           ["case_id", "claim_no", "side"]).drop("item_no").withColumnRenamed("claim_no", "item_no")
    # A quotation used in favour cannot also count against.
    sided = checked.groupBy(*keys, "source_id", F.lower("exact").alias("_q"), "page_number").agg(
        F.max((F.col("side") == "favoravel").cast("int")).alias("_pro"))
    per = sided.groupBy(*keys).agg(
        F.sum("_pro").alias("favourable"), F.sum(1 - F.col("_pro")).alias("contrary"),
        F.count_distinct(F.when(F.col("_pro") == 1, F.col("page_number"))).alias("favourable_pages"))
    # An unproved claim does not use up the thesis.
    valid = first_per_key(listed.join(per, keys).where("favourable > 0"), ["case_id", "thesis_id"], [F.col("item_no")])
    level = F.when(F.col("contrary") > 0, "controvertido").when(
        (F.col("favourable_pages") >= 2) | (F.col("favourable") >= 2), "amplo").otherwise("inicial")
    return top_per_key(valid.withColumn("support_level", level), ["case_id"], [F.col("priority"), F.col("title")], 2**31 - 1, "position")


def judgment_sources(decisions: DataFrame, certificates: DataFrame, chars: int | None = None) -> DataFrame:
    """``decisions``: case_id, decision_id, source_confidence, disposition, penalties, articles, fine, regime,
    substitution, suspension - each STRUCT or ARRAY<STRUCT> with excerpt and pages; ``certificates``: case_id, certificate_no,
    excerpt, pages, source_confidence. Whole texts are checked for hostile passages; with ``chars`` they are cut after that."""
    part = "struct<source_id:string,text:string,pages:array<int>,origin:string>"
    d = F.col("decision_id")

    def one(name: str, label: str, origin: str) -> Column:
        item = F.struct(F.concat(d, F.lit(f"-{label}")).alias("source_id"), F.col(f"{name}.excerpt").alias("text"),
                        F.col(f"{name}.pages").alias("pages"), F.lit(origin).alias("origin"))
        return F.array(item.cast(part))

    def many(name: str, origin: str) -> Column:
        items = F.transform(name, lambda v, i: F.struct(
            F.concat(d, F.lit(f"-{origin}-"), (i + 1).cast("string")).alias("source_id"), v["excerpt"].alias("text"),
            v["pages"].alias("pages"), F.lit(origin).alias("origin")).cast(part))
        return F.coalesce(items, F.array().cast(f"array<{part}>"))

    parts = F.concat(
        one("disposition", "dispositivo", "dispositivo_sentenca"), many("penalties", "pena_aplicada"), many("articles", "artigo_sentenca"),
        one("fine", "multa", "multa"), one("regime", "regime_inicial", "regime_inicial"),
        one("substitution", "substituicao_pena", "substituicao_pena"), one("suspension", "sursis", "sursis"))
    # Pinned, as Spark would read each decision once more to leave out those without parts.
    listed = pinned(decisions, "_parts", parts).select("case_id", "source_confidence", F.explode("_parts").alias("p")).select("case_id", "source_confidence", "p.*")
    final = certificates.select(
        "case_id", "source_confidence", F.concat(F.lit("transito-"), F.col("certificate_no").cast("string")).alias("source_id"),
        F.col("excerpt").alias("text"), "pages", F.lit("transito_em_julgado").alias("origin"))
    kept = listed.unionByName(final).where(present(F.col("text")) & (F.size("pages") > 0))
    checked = pinned(kept, "hostile", F.size(injection_reasons_of(F.col("text"))) > 0)
    checked = checked.where(F.col("hostile") | F.col("source_confidence").isin(*USABLE))
    return checked if chars is None else checked.withColumn("text", F.substring("text", 1, chars))


def _event_supported(kind: Column, text: Column) -> Column:
    t = fold(composed(text))
    out = None
    for name, terms in EVENT_TERMS.items():
        out = (F.when if out is None else out.when)(kind == name, _any_of(t, terms))
    return out.otherwise(True)


def dossier_events(rule_events: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """``rule_events``: case_id, event_no, event_type, value, page_number; ``claims``: case_id, item_no, event_type, value,
    person, source_id (one row per cited source); ``sources``: case_id, source_id, page_number, text."""
    kind = F.lower(F.trim("event_type"))
    met = claims.withColumn("event_type", F.when(kind.isin(*EVENT_TYPES), kind).otherwise("outro")).join(sources, ["case_id", "source_id"])
    read = pinned(met, "_hit", find_loose(F.col("text"), F.col("value"))).withColumn(
        "_fits", _event_supported(F.col("event_type"), F.col("text")))
    # A claim cites a handful of sources; its literal value comes from the first that holds it.
    per = read.groupBy("case_id", "item_no", "event_type", F.coalesce("person", F.lit("")).alias("person")).agg(
        F.min_by("_hit", F.when(F.col("_hit").isNotNull(), F.col("source_id"))).alias("value"),
        F.bool_or("_fits").alias("_fits"), F.array_sort(F.collect_list("page_number")).alias("pages"))
    model = per.where(F.col("_fits") & F.col("value").isNotNull())
    rules = first_per_key(rule_events.withColumn("_v", F.lower("value")), ["case_id", "event_type", "_v", "page_number"], [F.col("event_no")]).select(
        "case_id", F.lit(0).alias("origin"), F.col("event_no").alias("item_no"), "event_type", F.lit("").alias("person"), "value",
        F.array("page_number").alias("pages"))
    single = F.col("event_type").isin(*SINGLE_EVENTS)
    both = rules.unionByName(model.select("case_id", F.lit(1).alias("origin"), "item_no", "event_type", "person", "value", "pages"))
    unique = first_per_key(both.withColumn("_v", F.lower("value")).withColumn("_p", F.lower("person")),
                           ["case_id", "event_type", "_v", "_p", "pages"], [F.col("origin"), F.col("item_no")]).drop("_v", "_p")
    started = unique.where(single).groupBy("case_id", "event_type").agg(F.min(F.struct("origin", "item_no")).alias("_first"))
    later = F.col("origin") == 1
    return unique.join(started, ["case_id", "event_type"], "left").where(
        F.col("_first").isNull() | ~later | (F.struct("origin", "item_no") == F.col("_first"))).drop("_first")


def dossier_testimonies(claims: DataFrame, excerpts: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """``claims``: case_id, item_no, coverage, start_found, end_found; ``excerpts``: case_id, item_no, excerpt_no, source_id,
    quote (with ``limit`` the first ones per item); ``sources``: case_id, source_id, page_number, chunk_index, text."""
    read = (excerpts if limit is None else excerpts.where(F.col("excerpt_no") <= limit)).join(sources, ["case_id", "source_id"], "left")
    exact = pinned(read, "exact", find_loose(F.col("text"), F.col("quote")))
    words = F.regexp_count("exact", F.lit("[A-Za-zÀ-ÿ0-9]+"))
    long_enough = (F.length("exact") >= MIN_EXCERPT_CHARS) & (words >= MIN_EXCERPT_WORDS)
    spot = F.struct(F.col("page_number").cast("bigint").alias("p"), F.col("chunk_index").cast("bigint").alias("c"))
    good = F.col("exact").isNotNull() & long_enough
    per = exact.groupBy("case_id", "item_no").agg(
        F.count_if(F.col("exact").isNull()).alias("invalid_quotes"),
        F.count_if(F.col("exact").isNotNull() & ~long_enough).alias("short_quotes"),
        F.array_sort(F.collect_set(F.when(good, spot))).alias("_spots"),
        F.count_distinct(F.when(good, F.struct(spot, F.lower("exact")))).alias("excerpts"))
    steps = F.zip_with(F.slice("_spots", F.lit(1), F.size("_spots") - 1), F.slice("_spots", F.lit(2), F.size("_spots") - 1), lambda a, b:
                       ((b["p"] == a["p"]) & (b["c"] == a["c"] + 1)) | ((b["p"] == a["p"] + 1) & (b["c"] == 0)))
    run = F.when(F.size("_spots") <= 1, F.lit(True)).otherwise(F.forall(steps, lambda s: s))
    whole = F.lower(F.trim("coverage")) == "integral"
    proved = whole & F.col("start_found") & F.col("end_found") & (F.col("invalid_quotes") == 0) & run
    return (
        claims.join(per, ["case_id", "item_no"]).where("excerpts > 0")
        .withColumn("downgraded", whole & ~proved).withColumn("coverage", F.when(proved, "integral").otherwise("parcial")).drop("_spots")
    )


def dossier_contradictions(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """``claims``: case_id, item_no, source_a, quote_a, source_b, quote_b."""
    side = lambda s: sources.select("case_id", F.col("source_id").alias(f"source_{s}"), F.col("text").alias(f"_t{s}"))
    met = claims.join(side("a"), ["case_id", "source_a"]).join(side("b"), ["case_id", "source_b"])
    read = pinned(met, "exact_a", find_loose(F.col("_ta"), F.col("quote_a")))
    read = pinned(read, "exact_b", find_loose(F.col("_tb"), F.col("quote_b"))).drop("_ta", "_tb")
    a, b = F.lower("exact_a"), F.lower("exact_b")
    kept = read.where(F.col("exact_a").isNotNull() & F.col("exact_b").isNotNull() & (a != b))
    return first_per_key(kept.withColumn("_a", a).withColumn("_b", b), ["case_id", "_a", "_b"], [F.col("item_no")]).drop("_a", "_b")


LITERAL_CODES = {"marcos_essenciais": "event_value_not_literal", "depoimentos": "testimony_not_literal",
                 "contradicoes": "contradiction_claim_not_literal"}


def audit_references(items: DataFrame, references: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every reference with its finding (NULL when valid) and whether its chunk holds the item's text.

    ``items``: case_id, section, item_no, part, literal; ``references``: case_id, section, item_no, part, page_number, chunk_index,
    excerpt, confidence; ``chunks``: case_id, page_number, chunk_index, text, source_confidence.
    """
    keys = ["case_id", "section", "item_no", "part"]
    stored = chunks.select("case_id", "page_number", "chunk_index", F.col("text").alias("_text"), "source_confidence")
    joined = references.join(stored, ["case_id", "page_number", "chunk_index"], "left").join(items.select(*keys, "literal"), keys)
    holds = lambda c: present(F.col(c)) & find_loose(F.col("_text"), F.col(c)).isNotNull()
    code = (
        F.when(F.col("_text").isNull(), "source_not_found").when(~F.coalesce(holds("excerpt"), F.lit(False)), "source_excerpt_not_literal")
        .when(F.coalesce(F.col("confidence") != F.col("source_confidence"), F.lit(True)), "source_confidence_mismatch")
    )
    coded = pinned(joined, "code", code)
    return coded.withColumn("holds_literal", F.col("code").isNull() & F.coalesce(holds("literal"), F.lit(False))).drop("_text")


def audit_dossiers(sections: DataFrame, items: DataFrame, references: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, report). ``sections``: case_id, dossier_status, section, status, item_count, open_fields, open_gaps."""
    keys = ["case_id", "section", "item_no", "part"]
    done = sections.where("status = 'concluido'").select("case_id", "section")
    items = items.join(done, ["case_id", "section"], "left_semi")
    checked = written(audit_references(items, references, chunks).select(*keys, "code", "holds_literal"), "references")
    per_item = items.join(checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_refs"), F.bool_or("holds_literal").alias("_ok")), keys, "left")
    literal_ok = F.coalesce("_ok", F.lit(False))
    literal_code = F.element_at(F.create_map(*[F.lit(x) for p in LITERAL_CODES.items() for x in p]), F.col("section"))
    item_codes = F.filter(F.array(F.when(F.col("_refs").isNull(), F.lit("source_missing")), F.when(~literal_ok, literal_code)), lambda x: x.isNotNull())
    cols = ["case_id", "section", "severity", "code"]
    empty = (F.col("status") == "concluido") & (F.col("item_count") == 0)
    section_codes = F.filter(F.array(
        F.when(F.col("status") != "concluido", F.struct(F.lit("erro").alias("severity"), F.lit("section_not_completed").alias("code"))),
        F.when(empty & F.col("section").isin("marcos_essenciais", "depoimentos"), F.struct(F.lit("aviso").alias("severity"), F.lit("empty_section").alias("code"))),
        F.when((F.col("section") == "marcos_essenciais") & (F.col("open_fields") > 0), F.struct(F.lit("aviso").alias("severity"), F.lit("essential_fields_missing").alias("code"))),
        F.when((F.col("section") == "depoimentos") & (F.col("open_gaps") > 0), F.struct(F.lit("aviso").alias("severity"), F.lit("testimony_coverage_gaps").alias("code"))),
        F.when(empty & (F.col("section") == "contradicoes"), F.struct(F.lit("aviso").alias("severity"), F.lit("no_supported_contradiction").alias("code"))),
    ), lambda x: x.isNotNull())
    findings = (
        checked.where(F.col("code").isNotNull()).withColumn("severity", F.lit("erro")).select(*cols)
        .unionByName(per_item.withColumn("code", F.explode(item_codes)).withColumn("severity", F.lit("erro")).select(*cols))
        .unionByName(sections.withColumn("x", F.explode(section_codes)).select("case_id", "section", "x.severity", "x.code"))
    )
    counts = findings.groupBy("case_id").agg(F.count_if(F.col("severity") == "erro").alias("errors"), F.count_if(F.col("severity") == "aviso").alias("warnings"))
    refs = checked.groupBy("case_id").agg(F.count(F.lit(1)).alias("reference_checks"), F.count_if(F.col("code").isNull()).alias("valid_references"))
    lits = per_item.groupBy("case_id").agg(F.count(F.lit(1)).alias("literal_checks"), F.count_if(literal_ok).alias("valid_literals"))
    base = sections.groupBy("case_id").agg(F.max("dossier_status").alias("dossier_status"))
    numbers = ["errors", "warnings", "reference_checks", "valid_references", "literal_checks", "valid_literals"]
    joined = base.join(counts, "case_id", "left").join(refs, "case_id", "left").join(lits, "case_id", "left").na.fill(0, numbers)
    share = lambda a, b: F.coalesce(F.round(F.try_divide(F.col(a), F.col(b)), 4), F.lit(1.0))
    passed = (F.col("dossier_status") == "concluido") & (F.col("errors") == 0)
    report = (
        joined.withColumn("reference_accuracy", share("valid_references", "reference_checks"))
        .withColumn("literal_accuracy", share("valid_literals", "literal_checks")).withColumn("passed", passed)
        .withColumn("verdict", F.when(~passed, "falha_estrutural").when(F.col("warnings") > 0, "aprovado_com_revisao")
                    .otherwise("aprovado_estruturalmente"))
    )
    return findings, report


def dossier_status(sections: DataFrame, expected: int = len(SECTION_KEYS)) -> DataFrame:
    """``sections``: case_id, section_no, status, error_message."""
    error = F.nullif(F.col("error_message"), F.lit(""))
    per = sections.groupBy("case_id").agg(
        F.count_if(F.col("status") == "concluido").alias("completed"),
        F.min_by(error, F.when(error.isNotNull(), F.col("section_no"))).alias("_first"))
    done, some = F.col("completed") == expected, F.col("completed") > 0
    return per.select("case_id", F.when(done, "concluido").when(some, "parcial").otherwise("erro").alias("status"),
                      F.when(done, F.lit(None).cast("string")).when(some, "Uma ou mais secoes precisam ser tentadas novamente.")
                      .otherwise(F.coalesce("_first", F.lit("Nenhuma secao pode ser concluida."))).alias("error_message"))


def topic_batch_status(requested: DataFrame, results: DataFrame) -> DataFrame:
    """``requested``: case_id, topic_id; ``results``: case_id, topic_id."""
    made = results.select("case_id", "topic_id").distinct().withColumn("_made", F.lit(True))
    joined = requested.distinct().join(made, ["case_id", "topic_id"], "left")
    missing = F.array_sort(F.collect_set(F.when(F.col("_made").isNull(), F.col("topic_id"))))
    per = joined.groupBy("case_id").agg(F.count_if(F.coalesce("_made", F.lit(False))).alias("done"), missing.alias("failed_topics"))
    return per.select("case_id", F.when(F.size("failed_topics") == 0, "concluido").when(F.col("done") > 0, "parcial").otherwise("erro").alias("status"),
                      "failed_topics")
