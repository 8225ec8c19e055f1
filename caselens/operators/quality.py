"""Page quality: which text to use, how it was read, how far it can be trusted (Q03-Q15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.matching import pinned
from caselens.functions.text import WIDE_BLANKS, flags, present, word_count, words

# Fixed values of the data model.
SPARSE_IMAGE_CHARS = 500
LOW_TEXT_CHARS = 80
OCR_MIN_CHARS = 160
OCR_MIN_WORDS = 20
GLUED_MIN_CHARS = 1000
GLUED_MAX_BLANK_RATIO = 0.07
GLUED_TOKEN_CHARS = 40
GLUED_MIN_TOKENS = 3
LAYOUT_TOKEN_CHARS = 35
DOCUMENT_TYPES = {
    "edital": ("edital",),
    "decisao": ("decisao", "decisão"),
    "audiencia": ("audiencia", "audiência"),
    "sentenca": ("sentenca", "sentença"),
}
# Blanks of ASCII other than the space and the ends of lines, inside a pattern.
NARROW = r"\t\x0B\f\x1C-\x1F"
REUSABLE_STATUS = ("concluido", "processando", "pendente")


def normalized(c: Column) -> Column:
    unix = F.replace(c, F.lit("\r"), F.lit("\n"))
    # Single spaces, most of all blanks, stay as they are; texts in ASCII need no look at the wide ones.
    squeeze = lambda blanks: F.regexp_replace(unix, rf"[{blanks}][ {blanks}]*+| [ {blanks}]++", " ")
    one_blank = F.when(F.octet_length(c) == F.length(c), squeeze(NARROW)).otherwise(squeeze(rf"{NARROW}\x85{WIDE_BLANKS}"))
    return F.trim(F.regexp_replace(one_blank, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def normalize_pages(pages: DataFrame) -> DataFrame:
    """Q03. The text is made once per row, whatever later filters ask of it."""
    return pinned(pages, "native_text", normalized(F.coalesce("native_text", F.lit(""))))


def _long_tokens(text: Column, size: int) -> Column:
    return F.size(F.filter(words(text), lambda w: F.length(w) >= size))


def is_glued(text: Column) -> Column:
    blanks = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return (
        (F.length(text) >= GLUED_MIN_CHARS)
        & (blanks / F.length(text) <= GLUED_MAX_BLANK_RATIO)
        & (_long_tokens(text, GLUED_TOKEN_CHARS) >= GLUED_MIN_TOKENS)
    )


def has_glued_layout(text: Column) -> Column:
    """Looser variant used on rebuilt pages."""
    return is_glued(text) | (_long_tokens(text, LAYOUT_TOKEN_CHARS) >= GLUED_MIN_TOKENS)


def flag_glued(pages: DataFrame) -> DataFrame:
    """Q04."""
    return pages.withColumn("native_glued", F.coalesce(is_glued(F.col("native_text")), F.lit(False)))


def ocr_needed(pages: DataFrame) -> DataFrame:
    """Q05: an image with little or no native text, or a glued text layer."""
    sparse = (F.col("image_count") > 0) & (F.length("native_text") < SPARSE_IMAGE_CHARS)
    return flag_glued(pages).withColumn("ocr_needed", sparse | F.col("native_glued"))


def _substantial(text: Column) -> Column:
    return (F.length(text) >= OCR_MIN_CHARS) & (word_count(text) >= OCR_MIN_WORDS)


def choose_text(pages: DataFrame) -> DataFrame:
    """Q06: recognised text is looked at only where it was needed."""
    native, ocr = F.col("native_text"), F.col("ocr_text")
    both = F.concat_ws("\n\n", F.when(present(native), native), F.when(present(ocr), ocr))
    sparse = (F.col("image_count") > 0) & (F.length(native) < SPARSE_IMAGE_CHARS)
    return (
        ocr_needed(pages)
        .withColumn("ocr_text", F.when(F.col("ocr_needed"), F.coalesce(ocr, F.lit(""))).otherwise(""))
        .withColumn("ocr_replaced_native", _substantial(ocr) & (F.col("native_glued") | sparse))
        .withColumn("text", F.when(F.col("ocr_replaced_native"), ocr).otherwise(both))
    )


def grade_pages(pages: DataFrame) -> DataFrame:
    """Q07 and Q08 on top of Q03-Q06."""
    native, ocr = F.col("native_text"), F.col("ocr_text")
    method = (
        F.when(F.col("ocr_replaced_native"), "ocr_recovery")
        .when(present(native) & present(ocr), "native_plus_ocr")
        .when(present(ocr), "ocr")
        .when(present(native), "native")
        .otherwise("empty")
    )
    readable = _substantial(ocr) & ~F.coalesce(is_glued(ocr), F.lit(False))
    confidence = (
        F.when(~F.col("ocr_needed"), F.when(present(native), "alta").otherwise("baixa"))
        .when(~F.col("native_glued") & (F.length(native) >= SPARSE_IMAGE_CHARS), "alta")
        .when(readable, "media")
        .otherwise("baixa")
    )
    return (
        choose_text(normalize_pages(pages))
        .withColumn("extraction_method", method)
        .withColumn("source_confidence", confidence)
        .withColumn("char_count", F.length("text"))
        .withColumn("word_count", word_count("text"))
    )


def quality_notes(graded: DataFrame) -> DataFrame:
    """Q09: ordered list of facts about how a page was read."""
    native, ocr = F.col("native_text"), F.col("ocr_text")
    used, image = F.col("ocr_needed"), F.col("image_count") > 0
    blank, size = ~present(native), F.length(native)
    sparse = ~blank & image & (size < SPARSE_IMAGE_CHARS)
    low = ~blank & ~sparse & (size < LOW_TEXT_CHARS)
    return graded.withColumn(
        "quality_notes",
        flags(
            (F.col("native_glued"), "texto_nativo_com_palavras_coladas"),
            (used, "ocr_aplicado"),
            (used & present(ocr), "ocr_com_texto"),
            (used & F.coalesce(is_glued(ocr), F.lit(False)), "ocr_com_palavras_coladas"),
            (used & ~present(ocr), "ocr_sem_texto"),
            (F.col("ocr_replaced_native"), "ocr_substituiu_texto_nativo_inadequado"),
            (used & F.col("ocr_engine").isNotNull(), F.concat(F.lit("ocr_motor_"), F.col("ocr_engine"))),
            (used & F.col("ocr_cache_hit"), "ocr_resultado_reutilizado_do_cache"),
            (used & F.col("ocr_fallback_used"), "ocr_fallback_rapidocr"),
            (used, F.concat(F.lit("confianca_"), F.col("source_confidence"))),
            (blank, "sem_texto_nativo"),
            (blank & image, "possivel_pagina_escaneada_ou_imagem"),
            (sparse, "imagem_com_texto_curto"),
            (sparse, "provavel_necessidade_de_ocr"),
            (low, "baixo_texto_extraido"),
            (~blank & ~sparse & ~low, "texto_nativo_extraido"),
        ),
    )


def extraction_report(pages: DataFrame) -> DataFrame:
    """Q10: per case; ``pages`` carries quality_notes."""
    per_case = pages.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.sum("char_count").alias("total_chars"),
        F.count_if(~present(F.col("text"))).alias("empty_pages"),
        F.count_if(F.array_contains("quality_notes", "baixo_texto_extraido")).alias("low_text_pages"),
        F.count_if(F.col("image_count") > 0).alias("image_pages"),
        F.count_if(F.col("ocr_needed")).alias("ocr_pages"),
    )
    methods = pages.groupBy("case_id", "extraction_method").agg(F.count(F.lit(1)).alias("n"))
    # At most five methods exist, so the list per case is short.
    as_map = methods.groupBy("case_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("extraction_method", "n")))).alias("method_counts")
    )
    return per_case.join(as_map, "case_id")


def document_type_of(text: Column) -> Column:
    lowered = F.lower(text)
    out = None
    for label, keywords in DOCUMENT_TYPES.items():
        hit = F.contains(lowered, F.lit(keywords[0]))
        for keyword in keywords[1:]:
            hit = hit | F.contains(lowered, F.lit(keyword))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def document_type(df: DataFrame) -> DataFrame:
    """Q11."""
    return df.withColumn("document_type", document_type_of(F.col("text")))


def drop_margin_boxes(boxes: DataFrame, margin: float = 0.05) -> DataFrame:
    """Q12: page text from positioned boxes; ``points`` is ARRAY<STRUCT<x, y>>, boxes of one page only."""
    centre = F.aggregate("points", F.lit(0.0), lambda acc, p: acc + p["x"]) / F.size("points")
    width = F.col("image_width")
    kept = boxes.where((centre > width * margin) & (centre < width * (1 - margin)) & present(F.col("text")))
    return kept.groupBy("case_id", "page_number").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("box_no", "text"))), lambda b: b["text"]), "\n"
        ).alias("ocr_text")
    )


def case_status(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """Q13."""
    unknown = (
        chunks.where(F.col("source_confidence") == "desconhecida")
        .select("case_id").distinct().withColumn("needs_reprocessing", F.lit(True))
    )
    done = F.col("status") == "concluido"
    percent = F.bround(F.try_divide(F.col("progress_current"), F.col("progress_total")) * 100).cast("int")
    return (
        cases.join(unknown, "case_id", "left")
        .withColumn("needs_reprocessing", F.coalesce("needs_reprocessing", F.lit(False)))
        .withColumn("progress_percent", F.when(done, 100).otherwise(
            F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(percent, F.lit(0))))))
        .withColumn("search_mode", F.when(done, "hibrida")
                    .when((F.col("chunk_count") > 0) & F.col("progress_stage").isin("indexando", "erro"), "lexical")
                    .otherwise("indisponivel"))
    )


def recent_cases(cases: DataFrame, n: int = 10) -> DataFrame:
    """Q14."""
    return cases.orderBy(F.desc("created_at"), "case_id").limit(n)


# First characters of UTF-8 pairs read as Latin-1.
MOJIBAKE_MARKERS = ("\u00c3", "\u00c2", "\u00e2")


def repair_mojibake(df: DataFrame, column: str) -> DataFrame:
    """Q15: at most two passes; text that would not be valid UTF-8 after the pass is left alone."""
    text = F.col(column)
    for _ in range(2):
        suspicious = text.rlike("[" + "".join(MOJIBAKE_MARKERS) + "]") & text.rlike(r"^[\x00-\xff]*$")
        raw = F.encode(F.when(suspicious, text), "ISO-8859-1").cast("string")
        text = F.coalesce(F.when(F.is_valid_utf8(raw), raw), text)
    return df.withColumn(column, text)
