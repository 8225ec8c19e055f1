"""Cutting pages into chunks and putting pages together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselens.functions.text import present, strip
from caselens.operators.quality import document_type_of, has_glued_layout

CHUNK_CHARS = 1800
CHUNK_OVERLAP = 180
SOURCE_CHARS = 6000
SOURCE_OVERLAP = 400
MAX_OVERLAP_CHECK = 600
PROVENANCE = ["ocr_engine", "ocr_engine_version", "ocr_device", "ocr_cache_hit", "ocr_fallback_used"]
CONFIDENCE_ORDER = ["desconhecida", "baixa", "media", "alta"]


def confidence_rank(c: Column) -> Column:
    """Position in the confidence order; anything unknown ranks lowest."""
    known = F.array_position(F.array(*[F.lit(v) for v in CONFIDENCE_ORDER]), F.coalesce(c, F.lit("")))
    return F.greatest(known - 1, F.lit(0)).cast("int")


def confidence_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in CONFIDENCE_ORDER]), (rank + 1).cast("int"))


def chunk_pages(pages: DataFrame, max_chars: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """A narrow job; every chunk is cut from its own page row."""
    if max_chars <= 0 or overlap < 0 or overlap >= max_chars:
        raise ValueError("need max_chars > overlap >= 0")
    step = max_chars - overlap
    size = F.length("_text")
    parts = F.when(size <= max_chars, 1).otherwise(F.ceil((size - overlap) / F.lit(step))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), parts - 1),
                      lambda i: strip(F.substring(F.col("_text"), i * step + 1, F.lit(max_chars))))
    carried = [c for c in ["source_confidence", *PROVENANCE] if c in pages.columns]
    return (
        pages.where(present(F.col("text")))
        .withColumn("_text", strip("text"))
        .select("case_id", "page_number", *carried, F.posexplode(cut).alias("chunk_index", "text"))
        .withColumn("document_type", document_type_of(F.col("text")))
    )


def split_sources(df: DataFrame, max_chars: int = SOURCE_CHARS, overlap: int = SOURCE_OVERLAP) -> DataFrame:
    """Windows end at the last blank of their second half; starts depend on the previous end."""
    text = F.col("_text")
    size = F.length(text)
    # A window consumes more than max_chars/2 - overlap characters, which bounds the number of steps.
    steps = F.sequence(F.lit(0), F.ceil(size / F.lit(max_chars // 2 - overlap)).cast("int"))
    piece = "struct<start:int,stop:int>"

    def advance(found: Column, _: Column) -> Column:
        last = F.element_at(found, -1)
        start = F.when(F.size(found) == 0, 0).otherwise(
            F.greatest(F.element_at(found, -1)["start"] + 1, last["stop"] - overlap))
        limit = F.least(size, start + max_chars)
        low = start + max_chars // 2
        tail = F.substring(text, (low + 1).cast("int"), (limit - low).cast("int"))
        blank = F.instr(F.reverse(tail), " ")
        stop = F.when((limit < size) & (blank > 0), limit - blank).otherwise(limit)
        nxt = F.array(F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop")))
        done = (F.size(found) > 0) & (last["stop"] >= size)
        return F.when(done, found).otherwise(F.concat(found, nxt))

    spans = F.aggregate(steps, F.expr(f"cast(array() as array<{piece}>)"), advance)
    kept = [c for c in df.columns if c != "text"]
    parts = F.transform(spans, lambda s: strip(F.substring(text, s["start"] + 1, s["stop"] - s["start"])))
    return (
        df.where(present(F.col("text"))).withColumn("_text", strip("text"))
        .select(*kept, F.posexplode(F.filter(parts, lambda p: p != "")).alias("part_no", "text"))
    )


def _append(merged: Column, text: Column) -> Column:
    """Add a chunk, dropping the longest suffix of the merged text that is its prefix."""
    size = F.length(text)
    window = F.when(F.length(merged) > size + MAX_OVERLAP_CHECK,
                    F.substring(merged, -(size + MAX_OVERLAP_CHECK), size + MAX_OVERLAP_CHECK)).otherwise(merged)
    limit = F.least(F.length(merged), size, F.lit(MAX_OVERLAP_CHECK))
    sizes = F.filter(F.sequence(F.lit(1), limit),
                     lambda n: F.endswith(merged, F.substring(text, F.lit(1), n)))
    overlap = F.coalesce(F.array_max(sizes), F.lit(0))
    return (
        F.when(size == 0, merged)
        .when(F.length(merged) == 0, text)
        .when(F.contains(window, text), merged)
        .when(overlap > 0, F.concat(merged, F.substring(text, overlap + 1, size)))
        .otherwise(F.concat_ws("\n", merged, text))
    )


def rebuild_pages(chunks: DataFrame) -> DataFrame:
    """A page is the unit of grouping, so a large case spreads over all tasks."""
    filled = chunks.where(present(F.col("text")))

    def first_text(name: str) -> Column:
        c = F.col(name)
        return F.min_by(c, F.when(c.isNotNull() & (c != ""), F.col("chunk_index"))).alias(name)

    facts = [first_text(c) for c in PROVENANCE[:3] if c in chunks.columns]
    facts += [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in PROVENANCE[3:] if c in chunks.columns]
    parts = F.sort_array(F.collect_list(F.struct("chunk_index", strip("text").alias("text"))))
    grouped = filled.groupBy("case_id", "page_number").agg(
        parts.alias("_parts"),
        F.min(confidence_rank(F.col("source_confidence"))).alias("_rank"),
        *facts,
    )
    merged = F.aggregate(F.transform("_parts", lambda p: p["text"]), F.lit(""), _append)
    return (
        grouped.withColumn("text", strip(merged))
        .withColumn("source_confidence", confidence_name(F.col("_rank")))
        .withColumn("has_glued_words", F.coalesce(has_glued_layout(F.col("text")), F.lit(False)))
        .drop("_parts", "_rank")
    )


def page_ranges(pages: DataFrame, doc_keys: list[str]) -> DataFrame:
    """[start, stop) of each page in the document joined by two newlines.

    Only page lengths enter the window. ``doc_keys`` name one document, which is a bounded run of pages.
    """
    earlier = Window.partitionBy(*doc_keys).orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(earlier), F.lit(0))
    return pages.withColumn("range_start", start.cast("int")).withColumn(
        "range_stop", (F.col("range_start") + F.length("text")).cast("int"))


def offset_pages(offsets: DataFrame, ranges: DataFrame, doc_keys: list[str]) -> DataFrame:
    """Page of an absolute character offset; past the end counts as the last page."""
    span = ranges.select(*doc_keys, F.col("page_number").alias("page"), "range_start", "range_stop")
    last = span.groupBy(*doc_keys).agg(F.max("page").alias("_last"))
    inside = (F.col("offset") >= F.col("range_start")) & (F.col("offset") < F.col("range_stop"))
    found = (
        offsets.join(span, doc_keys, "left").where(inside)
        .select(*doc_keys, "offset", F.col("page").alias("_page")).distinct()
    )
    return (
        offsets.join(found, [*doc_keys, "offset"], "left").join(last, doc_keys, "left")
        .withColumn("page_number", F.coalesce("_page", "_last")).drop("_page", "_last")
    )


def assemble_documents(pages: DataFrame, limit: int | None = None, hint: str | None = None, case_key: str = "case_id", block: int = 4096) -> DataFrame:
    """Pages of each document, with start_page, has_hint and the document's stop_reason.

    ``pages`` carries is_start, stop_before (a page that may not be added), stop_after (a page that closes
    the document) and, with ``hint``, a page total that replaces the limit and switches both stop rules off.
    A document goes on over adjoining pages to the next start, to a stop rule or, if one is set, to the limit: it may
    have any number of pages.

    A page belongs to the last start before it, if no gap and no stop rule lies between. These last places are running
    maxima, taken inside blocks of page numbers and carried from block to block: only block summaries go through
    the window of a case. Pages without a number belong to nothing.
    """
    number, rule = F.col("page_number").cast("bigint"), F.col(hint) if hint else F.lit(None).cast("int")
    inside = Window.partitionBy(case_key, "_b").orderBy("page_number")
    upto, earlier = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    at = lambda flag: F.when(F.coalesce(F.col(flag), F.lit(False)), number)
    begin = F.when(F.coalesce(F.col("is_start"), F.lit(False)), F.struct(number.alias("page"), rule.cast("int").alias("hint")))
    rows = pages.where("page_number is not null").withColumn("_b", F.floor(F.col("page_number") / block)).withColumns({
        "_before": F.lag(number).over(inside), "_start": F.max(begin).over(upto), "_blocked": F.max(at("stop_before")).over(upto),
        "_closed": F.max(at("stop_after")).over(earlier)})
    rows = rows.withColumn("_gap", F.max(F.when(number - F.col("_before") > 1, number)).over(upto))
    sums = rows.groupBy(case_key, "_b").agg(
        F.min(number).alias("first"), F.max(number).alias("last"), F.max("_start").alias("start"), F.max("_blocked").alias("blocked"),
        F.max(at("stop_after")).alias("closed"), F.max("_gap").alias("gap"))
    order = Window.partitionBy(case_key).orderBy("_b")
    passed = order.rowsBetween(Window.unboundedPreceding, -1)
    torn = F.when(F.coalesce(F.lag("last").over(order) != F.col("first") - 1, F.lit(True)), F.col("first"))
    sums = sums.withColumn("torn", torn).withColumn("gap", F.coalesce("gap", "torn"))
    carried = sums.select(case_key, "_b", "torn", *[F.max(c).over(passed).alias(f"_c_{c}") for c in ("start", "blocked", "closed", "gap")])
    rows = rows.join(carried, [case_key, "_b"])
    start = F.coalesce("_start", "_c_start")
    none = F.lit(-(2**62)).cast("bigint")
    last = lambda own, *past: F.coalesce(own, *past, none)
    length = F.coalesce(F.col("_at.hint"), F.lit(limit))
    placed = rows.withColumn("_at", start).where("_at is not null").withColumns({
        "start_page": F.col("_at.page"), "has_hint": F.col("_at.hint").isNotNull()})
    free = (last("_blocked", "_c_blocked") <= F.col("start_page")) & (last("_closed", "_c_closed") < F.col("start_page"))
    whole = last("_gap", "torn", "_c_gap") <= F.col("start_page")
    member = whole & (F.col("has_hint") | free) & F.coalesce(number - F.col("start_page") < length, F.lit(True))
    found = placed.where(member).withColumn("_length", length).drop(
        "_b", "_before", "_start", "_blocked", "_closed", "_gap", "torn", "_at", *[f"_c_{c}" for c in ("start", "blocked", "closed", "gap")])
    # What ended a document stands on its last page or on the one after it.
    ends = found.groupBy(case_key, "start_page").agg(F.max(F.struct(number.alias("page"), "has_hint", "_length", F.coalesce("stop_after", F.lit(False)).alias("closes"))).alias("_e"))
    after = pages.select(case_key, number.alias("_next"), F.coalesce("is_start", F.lit(False)).alias("_is_start"))
    ends = ends.withColumn("_next", F.col("_e.page") + 1).join(after, [case_key, "_next"], "left")
    reason = (F.when(~F.col("_e.has_hint") & F.col("_e.closes"), "fechado").when(F.col("_next") - F.col("start_page") >= F.col("_e._length"), "limite")
              .when(F.col("_is_start"), "inicio").when(F.col("_is_start").isNull(), "ausente").otherwise("outro_documento"))
    ends = ends.select(case_key, "start_page", reason.alias("stop_reason")).dropDuplicates([case_key, "start_page"])
    # Every document has one row there, so where the reason isn't asked for, nothing is joined.
    return found.drop("_length").join(ends, [case_key, "start_page"], "left")
