"""Testimonies: where they start, which pages, who speaks, what is said; key events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.aligned import composed
from caselens.functions.matching import cut, match_spans, once, pinned
from caselens.functions.numbering import number_rows
from caselens.functions.scratch import written
from caselens.functions.text import compact, flags, lines, present, squash, strip
from caselens.operators.chunks import assemble_documents, confidence_name, confidence_rank
from caselens.operators.documents import document_rows, joined_text

# Limits, markers (compared without blanks) and text patterns.
CONTEXT_CHARS = 700
# A printed page total counts up to this; a greater one is taken for digits that follow it.
PAGES_FROM_HINT = 12
FORM_CONTEXT = ("inquerito", "policiacivil", "delegacia", "autodeprisaoemflagrante", "audienciadeinstrucao", "pag1de")
INTERROGATION = ("termodeinterrogatorio", "autodequalificacaoeinterrogatorio")
TESTIMONY = ("termodedepoimento", "termodeoitiva")
DECLARATIONS = ("termodedeclaracoes",)
DECLARATION = ("termodedeclaracao",)
TESTIMONY_VICTIM = ("prestaavitima", "depoimentodavitima", "oitivadavitima")
DECLARATION_VICTIM = ("prestaavitima", "declaracoesdavitima", "ofendido", "lesado")
CLOSING = ("nadamaisdisse", "nadamaisdeclarou", "nadalhefoiperguntado", "fosseencerradoestetermo", "encerrouseopresente", "encerradoopresente")
OTHER_DOCUMENTS = ("certidao", "relatoriofinal", "laudopericial", "laudodeexame", "mandadode", "decisao", "sentenca", "denuncia")
INQUEST = ("inquerito", "delegacia", "policiacivil", "autodeprisaoemflagrante")
COURT = ("audienciadeinstrucao", "emjuizo", "juizo")
SPEECH_START = (
    r"(?i)(?:(?=[DIREA])\b(?:DISSE|DECLAROU|INFORMOU|RELATOU|ESCLARECEU|AFIRMOU|RESPONDEU)\s*[:,;]?\s+QUE\b"
    r"|(?=P)\b(?:PASSOU|PASSA)\s+A\s+(?:DECLARAR|RELATAR|INFORMAR)\s*[:,;]?\s+QUE\b"
    r"|(?:^|\n)\s*QUE\b(?!\s+(?:PRESTA|COMPARECE|FOI\s+QUALIFICAD[OA])))"
)
SPEECH_END = (
    r"(?i)(?=[NE])(?:\bNADA\s+MAIS\s+(?:DISSE|DECLAROU|RESPONDEU)\b|\bNADA\s+(?:MAIS\s+)?LHE\s+FOI\s+PERGUNTADO\b"
    r"|\bE\s+COMO\s+NADA\s+MAIS\b|\bENCERROU-SE\s+O\s+PRESENTE\b)"
)
NAME = r"([A-ZÀ-ÖØ-Ý][A-ZÀ-ÖØ-Ýa-zà-öø-ÿ .\r\n'-]{3,160}?)"
QUALIFIERS = (
    r"nacionalidade|naturalidade|brasileir[oa]|estado\s+civil|profiss[aã]o|residente|filh[oa]|nascid[oa]|rg|cpf"
)
TERMINATOR = rf"(?=\s*(?:(?:,|;)\s*(?:{QUALIFIERS})|\n\s*(?:{QUALIFIERS})|(?:\d{{1,3}}\s*)?inqu[eé]rito|$))"
ROLE_LABELS = {
    "vitima": r"(?:a\s+)?(?:v[ií]tima|ofendid[oa]|lesad[oa])",
    "testemunha": r"(?:a\s+)?testemunha",
    "condutor": r"(?:o\s+)?condutor",
    "reu": r"(?:o\s+)?(?:infrator|interrogado|autuado|acusado|indiciado|investigado|r[eé]u)",
    "declarante": r"(?:o|a)?\s*declarante",
    "informante": r"(?:o|a)?\s*informante",
}
LABEL_SEPARATOR = r"(?:\s*[(（]\s*a\s*[)）])?\s*(?::|-)\s*"
ACCUSED_SEPARATOR = r"(?:\s*[(（]\s*a\s*[)）])?\s*(?:(?::|-)\s*|\s+)"
TITLES = {
    "declarante": r"termo\s+de\s+declara(?:ç[aã]o|cao|ç[oõ]es|coes)\s+de\s+",
    "testemunha": r"termo\s+de\s+(?:depoimento|oitiva)\s+de\s+",
    "informante": r"termo\s+de\s+(?:depoimento|oitiva)\s+de\s+",
    "vitima": r"termo\s+de\s+(?:depoimento|oitiva)\s+de\s+",
    "reu": r"termo\s+de\s+interrogat[oó]rio\s+de\s+",
}
PRESENCE = r"compareceu\s+(?:em\s+)?cart[oó]rio\s+"
REJECTED_NAMES = ("naoinformado", "naoconsta", "testemunha", "vitima", "condutor", "declarante", "interrogado", "infrator")
REJECTED_PARTS = ("inquerito", "nacionalidade", "naturalidade", "disseque")
# Event type, label, pattern with the value as first group, first source only.
KEY_EVENT_RULES = [
    ("data_fato", "Data, horario e local do fato",
     r"(?iu)no\s+dia\s+(\d{1,2}\s+de\s+[A-Za-zÀ-ÿ]+\s+de\s+\d{4},\s*às?\s*\d{1,2}h(?:\d{2})?,\s*na\s+Rua\s+[^,]+,\s*"
     r"n[.º°]*\s*\d+,\s*Apto\.?\s*\d+,\s*Centro,\s*desta\s+Urbe)", True),
    ("nascimento_reu", "Data de nascimento do reu", r"(?iu)nascid[oa]\s+aos?\s+(\d{2}/\d{2}/\d{4})", True),
    ("recebimento_denuncia", "Recebimento da denuncia",
     r"(?isu)RECEBO\s+A\s+DEN[ÚU]NCIA.*?liberado\s+nos\s+autos\s+em\s+(\d{2}/\d{2}/\d{4})", True),
    ("prisao", "Prisao em flagrante",
     r"(?isu)no\s+dia\s+(\d{1,2}\s+de\s+[A-Za-zÀ-ÿ]+\s+de\s+\d{4},\s*às?\s*\d{1,2}h).*?foi\s+preso\s+em\s+flagrante", True),
    ("liberdade", "Liberdade provisoria", r"(?iu)(concedida\s+a\s+liberdade\s+provis[óo]ria)", True),
    ("liberdade", "Periodo das medidas cautelares",
     r"(?iu)Per[íi]odo\s+do\s+Cumprimento\s+da\s+Medida\s+(In[íi]cio:\s*\d{2}/\d{2}/\d{4}\s*-\s*Fim:\s*\d{2}/\d{2}/\d{4})", True),
    ("audiencia", "Audiencia designada", r"(?iu)Data\s+e\s+hora\s+da\s+audi[êe]ncia:\s*(\d{2}/\d{2}/\d{4}\s+às?\s+\d{1,2}:\d{2}h)", False),
    ("audiencia", "Audiencia redesignada",
     r"(?iu)redesignando\s+a\s+audi[êe]ncia\s+para\s+o\s+dia\s+(\d{1,2}\s+de\s+[A-Za-zÀ-ÿ]+\s+de\s+\d{4},\s*às?\s*\d{1,2}:\d{2}h)", False),
]
DOC = ["case_id", "start_page"]


def key_events(hits: DataFrame) -> DataFrame:
    """``hits``: case_id, rank, page_number, text. Rules marked first-only keep the best ranked source."""
    values = F.array(*[F.struct(F.lit(no).alias("rule_no"), F.lit(kind).alias("event_type"), F.lit(label).alias("label"), F.lit(first).alias("first_only"),
                                F.regexp_substr("text", F.lit(pattern)).alias("match"), F.regexp_extract("text", pattern, 1).alias("value"))
                       for no, (kind, label, pattern, first) in enumerate(KEY_EVENT_RULES)])
    rows = hits.select("case_id", "rank", "page_number", F.explode(values).alias("v")).select("case_id", "rank", "page_number", "v.*").where(
        F.col("match").isNotNull()).drop("match")
    once = rows.where("first_only").groupBy("case_id", "rule_no").agg(
        F.min_by(F.struct("rank", "page_number", "event_type", "label", "first_only", "value"), "rank").alias("k")).select("case_id", "rule_no", "k.*")
    return once.unionByName(rows.where("not first_only")).drop("first_only")


def _any(text: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def _first_at(text: Column, markers: tuple[str, ...]) -> Column:
    """Zero-based first position of any marker, NULL when absent."""
    return F.array_min(F.filter(F.array(*[F.instr(text, m) - 1 for m in markers]), lambda p: p >= 0))


def _heading(line_list: Column, markers: tuple[str, ...]) -> Column:
    """A line, or two neighbours, that shows a marker in capitals or at its start."""
    def good(line: Column) -> Column:
        letters, capitals = F.regexp_count(line, F.lit(r"\p{L}")), F.regexp_count(line, F.lit(r"\p{Lu}"))

        def shown(flat: Column) -> Column:
            starts = F.lit(False)
            for m in markers:
                starts = starts | F.startswith(flat, F.lit(m))
            return _any(flat, markers) & ((F.coalesce(F.try_divide(capitals, letters), F.lit(0.0)) >= 0.65) | (starts & (F.length(line) <= 220)))

        return once(compact(line), shown)

    pairs = F.zip_with(line_list, F.slice(line_list, 2, 1_000_000), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.exists(line_list, good) | F.exists(F.filter(pairs, lambda p: p.isNotNull()), good)


def _within(text: Column, markers: tuple[str, ...], chars: int | None) -> Column:
    """Whether a marker is there; with ``chars`` only in the first ones."""
    return _any(text, markers) if chars is None else _first_at(text, markers) <= chars


def testimony_starts(pages: DataFrame, limit: int | None = None, chars: int | None = None) -> DataFrame:
    """document_type and role of every page that opens a testimony form, numbered per case in page order.

    With ``limit`` only the first ones of a case, with ``chars`` only headings in the first characters of a page.
    """
    read = pinned(pages, "_flat", compact("text")).where(_any(F.col("_flat"), FORM_CONTEXT))
    read = pinned(read, "_lines", F.filter(F.transform(lines("text"), strip), lambda x: x != ""))
    flat = F.col("_flat")

    def opens(markers: tuple[str, ...]) -> Column:
        return _within(flat, markers, chars) & _heading(F.col("_lines"), markers)

    def context(markers: tuple[str, ...]) -> Column:
        return F.substring(flat, _first_at(flat, markers) + 1, F.lit(CONTEXT_CHARS))

    t, d = context(TESTIMONY), context(DECLARATIONS)
    kind = (
        F.when(opens(INTERROGATION), "interrogatorio_reu")
        .when(opens(TESTIMONY), F.when(F.contains(t, F.lit("condutor")), "depoimento_condutor").when(_any(t, TESTIMONY_VICTIM), "depoimento_vitima")
              .when(F.contains(t, F.lit("informante")), "depoimento_informante").otherwise("depoimento_testemunha"))
        .when(opens(DECLARATIONS), F.when(_any(d, DECLARATION_VICTIM), "declaracoes_vitima").otherwise("declaracoes"))
        .when(opens(DECLARATION), "declaracao")
    )
    role = (F.when(F.col("document_type") == "interrogatorio_reu", "reu").when(F.col("document_type").isin("declaracoes", "declaracao"), "declarante")
            .otherwise(F.element_at(F.split("document_type", "_"), -1)))
    found = pinned(read, "document_type", kind).where(F.col("document_type").isNotNull()).withColumn("role", role)
    # Written once, as numbering reads it twice.
    forms = written(found.select("case_id", "page_number", "document_type", "role"), "forms")
    named = number_rows(forms, ["case_id"], "page_number", "testimony_no")
    return named if limit is None else named.where(F.col("testimony_no") <= limit)


def page_total_hint(flat: Column) -> Column:
    total = F.nullif(F.regexp_extract(flat, r"pag(?:ina)?1de(\d{1,2})", 1), F.lit("")).try_cast("int")
    return F.when(total.between(1, PAGES_FROM_HINT), total)


def testimony_pages(pages: DataFrame, starts: DataFrame, limit: int | None = None, chars: int | None = None) -> DataFrame:
    """Member pages; coverage is integral only when the form is closed, complete and not interrupted.

    With ``limit`` a form without a page total has so many pages at most, with ``chars`` other documents are told by the first characters of a page.
    """
    flat = F.col("_flat")
    other = _within(flat, OTHER_DOCUMENTS, chars)
    marked = pinned(pages.select("case_id", "page_number", "text"), "_flat", compact("text")).select(
        "case_id", "page_number", page_total_hint(flat).alias("hint"), F.coalesce(other, F.lit(False)).alias("stop_before"),
        _any(flat, CLOSING).alias("stop_after"))
    marked = marked.join(starts.select("case_id", "page_number", F.lit(True).alias("is_start")), ["case_id", "page_number"], "left").withColumn(
        "is_start", F.coalesce("is_start", F.lit(False)))
    # Written once: texts are read for their marks a single time, then only marks are assembled.
    members = written(assemble_documents(written(marked, "marks"), limit, "hint"), "members")
    per = members.groupBy(*DOC).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("page_number") == F.col("start_page"), F.col("hint"))).alias("total_hint"),
        F.bool_or("stop_after").alias("closed"), F.max("stop_reason").alias("stop_reason"))
    interrupted = F.coalesce(F.col("stop_reason").isin("inicio", "ausente", "outro_documento"), F.lit(False))
    complete = F.when(F.col("total_hint").isNotNull(), F.col("_n") == F.col("total_hint")).otherwise(F.col("closed"))
    coverage = F.when(complete & F.col("closed") & ~interrupted, "integral").otherwise("parcial")
    return members.select(*DOC, "page_number").join(
        per.select(*DOC, "closed", coverage.alias("coverage")), DOC)


def _clean_name(raw: Column) -> Column:
    def good(parts: Column, flat: Column) -> Column:
        return (F.size(parts).between(2, 12) & F.forall(parts, lambda w: w.rlike(r"\p{L}")) & ~flat.isin(*REJECTED_NAMES)
                & ~compact(F.element_at(parts, 1)).isin(*REJECTED_NAMES) & ~_any(flat, REJECTED_PARTS))

    trimmed = F.trim(F.regexp_replace(raw, r"\s+", " "), F.lit(" .,:;-()"))
    return once(trimmed, lambda name: once(F.split(name, " "), lambda parts: once(compact(name), lambda flat: F.when(good(parts, flat), name))))


def _found_name(pattern: str, method: str, confidence: str, chars: int | None) -> Column:
    """First acceptable name in page order; with ``chars`` in the first characters of a page."""
    def on_page(p: Column) -> Column:
        head = p["text"] if chars is None else F.substring(p["text"], 1, chars)
        named = lambda w, n: F.struct(
            n.alias("name"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"),
            F.substring(squash(w), 1, 240).alias("evidence"), p["page_number"].cast("bigint").alias("page_number"))
        made = lambda whole: F.zip_with(whole, F.regexp_extract_all(head, F.lit(pattern), F.lit(1)), lambda w, n: once(_clean_name(n), lambda c: F.when(c.isNotNull(), named(w, c))))
        # Most pages name nobody, which one search tells.
        return once(F.regexp_extract_all(head, F.lit(pattern), F.lit(0)), lambda whole: F.when(F.size(whole) > 0, made(whole)))

    return F.get(F.flatten(F.transform("pages", lambda p: F.filter(F.coalesce(on_page(p), F.array()), lambda f: f.isNotNull()))), F.lit(0))


def identify_person(docs: DataFrame, chars: int | None = None) -> DataFrame:
    """Label in the header, then the name in the title, then the qualification; ``docs`` carries role and pages."""
    role, found = F.col("role"), None
    for name, label in ROLE_LABELS.items():
        separator = ACCUSED_SEPARATOR if name == "reu" else LABEL_SEPARATOR
        steps = [_found_name(rf"(?iu){label}{separator}{NAME}{TERMINATOR}", "rotulo_cabecalho", "alta", chars)]
        if name in TITLES:
            steps.append(_found_name(rf"(?iu){TITLES[name]}{NAME}{TERMINATOR}", "titulo_nominal", "alta", chars))
        if name == "declarante":
            steps.append(_found_name(rf"(?iu){PRESENCE}{NAME}{TERMINATOR}", "qualificacao", "media", chars))
        found = (F.when if found is None else found.when)(role == name, F.coalesce(*steps))
    none = F.struct(F.lit(None).cast("string").alias("name"), F.lit("nao_identificado").alias("method"), F.lit("baixa").alias("confidence"),
                    F.lit(None).cast("string").alias("evidence"), F.lit(None).cast("bigint").alias("page_number"))
    return pinned(docs, "person", F.coalesce(found, none))


def speech_body(docs: DataFrame) -> DataFrame:
    """Literal speech between the first start marker and the first end marker after it, page by page."""
    first = F.transform("pages", lambda p, i: F.struct(i.alias("i"), F.get(match_spans(p["text"], SPEECH_START), F.lit(0)).alias("s")))
    started = pinned(docs, "_start", F.get(F.filter(first, lambda f: f["s"].isNotNull()), F.lit(0)))
    lead = F.length("_start.s.value") - F.length(F.ltrim(F.col("_start.s.value"), F.lit(" \t\n\r\x0b\x0c")))
    started = started.withColumn("_from", F.col("_start.s.start") + lead)
    ends = F.transform("pages", lambda p, i: F.struct(i.alias("i"), F.get(F.filter(
        match_spans(p["text"], SPEECH_END), lambda m: (i > F.col("_start.i")) | (m["start"] >= F.col("_start.s.stop"))), F.lit(0)).alias("s")))
    closed = pinned(started, "_end", F.get(F.filter(ends, lambda f: f["s"].isNotNull() & (f["i"] >= F.col("_start.i"))), F.lit(0)))
    last = F.coalesce(F.col("_end.i"), F.size("pages") - 1)
    spoken = F.transform("pages", lambda p, i: F.struct(
        p["page_number"].cast("bigint").alias("page_number"),
        F.when((i >= F.col("_start.i")) & (i <= last), strip(cut(
            p["text"], F.when(i == F.col("_start.i"), F.col("_from")).otherwise(0),
            F.when((i == last) & F.col("_end").isNotNull(), F.col("_end.s.start")).otherwise(F.length(p["text"]))))).alias("text")))
    read = pinned(closed, "segments", F.filter(spoken, lambda s: present(s["text"])))
    nothing = F.col("_start").isNull() | (F.size("segments") == 0)
    marker = F.ltrim(F.col("_start.s.value"), F.lit(" \t\n\r\x0b\x0c"))
    return read.withColumns({
        "body_status": F.when(nothing, "nao_localizada").when(F.col("_end").isNull(), "revisao_necessaria").otherwise("segmentada"),
        "body_confidence": F.when(nothing, "baixa").when(F.col("_end").isNull(), "media").otherwise("alta"),
        "start_marker": marker, "end_marker": F.col("_end.s.value"),
    }).drop("_start", "_end", "_from")


def phase_of(text: Column) -> Column:
    return once(compact(text), lambda flat: F.when(_any(flat, INQUEST), "inquerito").when(_any(flat, COURT), "juizo").otherwise("outro"))


def testimonies(pages: DataFrame) -> DataFrame:
    """One record per testimony with phase, coverage, person, speech (in composed spelling) and the review flag."""
    pages = pages.withColumn("text", composed("text"))
    starts = written(testimony_starts(pages), "starts")
    members = testimony_pages(pages, starts)
    kinds = starts.select("case_id", F.col("page_number").alias("start_page"), "document_type", "role")
    docs = document_rows(members, pages, ["closed", "coverage"]).join(kinds, DOC)
    read = speech_body(identify_person(docs))
    doubtful = F.exists("pages", lambda p: ~F.coalesce(p["source_confidence"].isin("alta", "media"), F.lit(False)))
    glued = F.exists("pages", lambda p: p["has_glued_words"]) if "has_glued_words" in pages.columns else F.lit(False)
    review = ((F.col("coverage") == "parcial") | (F.col("person.confidence") != "alta") | (F.col("body_status") != "segmentada") | glued | doubtful)
    return read.withColumns({
        "testimony_id": F.format_string("dep-p%04d-%s", "start_page", "document_type"),
        "phase": phase_of(joined_text(F.col("pages"))),
        "end_page": F.array_max(F.transform("pages", lambda p: p["page_number"])),
        "source_confidence": confidence_name(F.array_min(F.transform("pages", lambda p: confidence_rank(p["source_confidence"])))),
        "warnings": flags(
            (~F.col("closed"), "O encerramento formal do termo nao foi localizado."),
            (F.col("person.name").isNull(), "A pessoa ouvida nao foi identificada com seguranca."),
            (glued, "Ha palavras coladas na extracao."), (doubtful, "A fonte tem confianca baixa ou desconhecida.")),
        "review_required": review,
    })


def transcription_status(cases: DataFrame, found: DataFrame) -> DataFrame:
    """X22 per case."""
    per = found.groupBy("case_id").agg(F.bool_or("review_required").alias("_r"))
    return cases.join(per, "case_id", "left").withColumn(
        "transcription_status", F.when(F.col("_r").isNull(), "sem_depoimentos").when(F.col("_r"), "revisao_necessaria").otherwise("concluido")).drop("_r")
