"""Long texts cost in proportion to their length, and texts are read once."""

import time
import unicodedata

from pyspark.sql import functions as F

from caselens.functions.aligned import composed, decomposed
from caselens.functions.matching import MARK, match_spans
from caselens.functions.text import BLANK_RUN, LATIN_BLANK_RUN, WIDE_BLANKS, squash
from caselens.operators import decisions as D
from caselens.operators import evidence as K
from caselens.operators import lexical as L
from caselens.operators import routing as G
from caselens.operators import safety as H
from caselens.operators.chunks import chunk_pages
from caselens.operators.quality import grade_pages
from caselens.sources.store import Store
from caselens.streaming import ingest


def test_spelling_of_a_long_text(spark):
    text = "ação, não é ﬁm " * 200000
    row = spark.createDataFrame([(text,)], "t string").select(decomposed("t").alias("d"))
    started = time.time()
    got = row.select(F.sha2("d", 256).alias("d"), F.sha2(composed("d"), 256).alias("c")).collect()[0]
    apart = "".join(unicodedata.normalize("NFD", c) for c in text)
    assert time.time() - started < 25
    want = spark.createDataFrame([(apart, text.replace("ﬁ", "fi"))], "d string, c string").select(F.sha2("d", 256).alias("d"), F.sha2("c", 256).alias("c")).collect()[0]
    assert got == want


def test_spans_beside_the_mark(spark):
    rows = spark.createDataFrame([(1, f"a1{MARK}b22"), (2, "a1b22"), (3, "none"), (4, None)], "i int, t string")
    got = {r.i: r.s and [tuple(x) for x in r.s] for r in rows.select("i", match_spans(F.col("t"), r"\d+").alias("s")).collect()}
    assert got == {1: [(1, 2, "1"), (4, 6, "22")], 2: [(1, 2, "1"), (3, 5, "22")], 3: [], 4: None}


def test_names_in_a_long_page(spark):
    text = "uma folha qualquer 12 " * 30000 + "MARIA da  Silva fim"
    pages = spark.createDataFrame([("c", 1, text), ("d", 1, "abc")], "case_id string, page_number int, text string")
    aliases = spark.createDataFrame([("c", "m", "da  silva", "[N]"), ("c", "x", "Joaquim Xavier", "[X]")], "case_id string, alias_id string, value string, replacement string")
    started = time.time()
    got = {(r.case_id, r.text[-13:], len(r.alias_hits)) for r in H.pseudonymize(pages, aliases).collect()}
    assert got == {("c", "MARIA [N] fim", 1), ("d", "abc", 0)}
    assert time.time() - started < 40


def test_headings_are_read_once(spark):
    pages = spark.createDataFrame([(1, 1, "S E N T E N Ç A\nAutos", "alta", False), (1, 2, "fim", "alta", False), (1, 3, "Certidão de trânsito em julgado", "alta", False)],
                                  "case_id int, page_number int, text string, source_confidence string, has_glued_words boolean")
    docs = D.decision_documents(pages)
    assert "certidaode" not in docs._jdf.queryExecution().toString()
    assert [(r.start_page, r.decision_type, [p.page_number for p in r.pages]) for r in docs.collect()] == [(1, "sentenca", [1, 2])]


def test_guides_meet_in_blocks(spark, monkeypatch):
    words = "furto roubo prova pena fiança multa réu juiz autos prazo".split()
    text = lambda i, n: " ".join(words[(i * (j + 3) + j * j) % 10] for j in range(n))
    queries = spark.createDataFrame([(i, text(i, 1 + i % 7)) for i in range(40)] + [(40, ""), (41, None)], "query_id int, question string")
    guides = spark.createDataFrame(
        [(f"g{i}", f"{text(i // 2, 2)} - x", "a", "b", "ver", text(i // 3, 2 + i % 6), ["uma_tag"], i % 4 == 0, i) for i in range(60)]
        + [("geral_resultado_julgamento", "Prova pena - x", "a", "b", "ver", "roubo prova pena", [], True, 60)],
        "guide_id string, title string, area string, audience string, goal string, question string, tags array<string>, official boolean, pos int")
    scored = G.score_guides(queries, guides)
    assert "Join" not in scored._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: sorted(map(tuple, df.select("query_id", "guide_id", "topic", "score").collect()))
    want, routed = rows(scored), sorted(map(tuple, G.route(scored).select("query_id", "rank", "guide_id", "score").collect()))
    tokens = {r.query_id: set(r.t) for r in queries.select("query_id", G.routing_tokens(F.col("question")).alias("t")).collect() if r.t}
    whole = F.concat_ws(" ", "title", "area", "audience", "goal", "question", F.array_join("tags", " "))
    known = {r.guide_id: set(r.t) for r in guides.select("guide_id", G.routing_tokens(whole).alias("t")).collect()}
    met = {(q, g) for q, a in tokens.items() for g, b in known.items() if len(a & b) >= (2 if len(a) > 1 else 1) and g != "geral_resultado_julgamento"}
    assert {(q, g) for q, g, _, _ in want} == met and routed
    for name, value in (("BLOCK", 7), ("CELLS", 5), ("COUNTERS", 20), ("PENDING", 10)):
        monkeypatch.setattr(G, name, value)
    assert rows(G.score_guides(queries, guides)) == want
    pruned = G.score_guides(queries, guides, G.MIN_GUIDE_SCORE, G.GUIDE_LIMIT)
    assert sorted(map(tuple, G.route(pruned).select("query_id", "rank", "guide_id", "score").collect())) == routed


def test_terms_are_counted_on_the_row(spark):
    texts = ["b a b, B ç c 9", "", "Ação área ACAO", "x"]
    chunks = spark.createDataFrame([("c", i, 0, t) for i, t in enumerate(texts)], "case_id string, page_number int, chunk_index int, text string")
    found = L.postings(chunks)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.page_number, r.term): (r.tf, r.chunk_len) for r in found.collect()}
    assert got == {(0, "9"): (1, 7), (0, "a"): (1, 7), (0, "b"): (3, 7), (0, "c"): (2, 7), (2, "acao"): (2, 3), (2, "area"): (1, 3), (3, "x"): (1, 1)}
    asked = spark.createDataFrame([("c", "b"), ("d", "x")], "case_id string, term string")
    index = L.index_tables(chunks, asked)
    assert [(r.page_number, r.term, r.tf) for r in index.postings.where("term is not null").collect()] == [(0, "b", 3)]
    assert [(r.n_docs, r.avg_len) for r in index.cases.collect()] == [(4, 11 / 4)]


def test_pages_are_normalised_once(spark):
    pages = spark.createDataFrame([("c", 1, "a \t b\x1c\n \n c  d \r e  f", "", 0), ("c", 2, " x\ty ", "", 0)],
                                  "case_id string, page_number int, native_text string, ocr_text string, image_count int")
    chunks = chunk_pages(grade_pages(pages)).select("page_number", "text")
    assert chunks._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 3
    assert [r.text for r in chunks.orderBy("page_number").collect()] == ["a b\nc d\ne f", "x y"]


def test_ingest_deals_pages_anew(spark, tmp_path, monkeypatch):
    """A batch in one piece is worked on by as many tasks as its size asks for, with adaptive execution; the session is as before then."""
    schema = "case_id string, sha256 string, seq long, head string, size_bytes long, created_at timestamp, page_number int, native_text string, ocr_text string, image_count int"
    rows = [(f"c{i}", str(i), i, "%PDF", ingest.TASK_BYTES, None, 1, f"palavra {i}", "", 0) for i in range(40)]
    names = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.maxPartitionBytes")
    settings = lambda: [spark.conf.get(n, None) for n in names]
    seen = []

    def index(chunks):
        seen.append((len(chunks.inputFiles()), settings()[:2]))
        return L.index_tables(chunks)

    monkeypatch.setattr(ingest, "index_tables", index)
    before, store = settings(), Store(spark, str(tmp_path / "store"), 2)
    assert ingest.ingest_batch(spark.createDataFrame(rows, schema).coalesce(1), 0, store)
    assert seen[0][0] > 8 and seen[0][1] == ["true", "40"] and settings() == before
    assert store.read("terms").count() == 80


def test_loose_quotations_without_a_pattern(spark):
    """Latin-1 quotations are found by plain comparison, with what the pattern finds; blanks are those of before."""
    texts = ["Consta  do termo\nnúmero 12\xa0que o RÉU\x1c(sic) foi\tdito [x].*", "straße µ ÿ ß", "a  b a b", "", None, "  ", "Kelvin ſoft İi µμ", "acúcar e aço ﬁm", "a b  c", "x\\E$1 y", "ΑΣ ας"]
    quotes = ["termo número 12 QUE o réu (SIC)", "[X].*", "STRASSE", "STRAßE Μ", "Μ", "Ÿ", "ÿ SS", "ÿ ß", "A B", "b  A", "", " ", None, "kelvin SOFT", "K", "i̇I", "I", "açúcar", "AÇO fim", "A B C", "X\\e$1  Y", "ασ", "zz", "\n(sic)\xa0"]
    rows = spark.createDataFrame([(t, q) for t in texts for q in quotes], "t string, q string")
    found = rows.select("t", "q", K.find_loose(F.col("t"), F.col("q")).alias("got"), squash(K.find_quote(F.col("t"), squash(F.col("q")))).alias("want"))
    assert "instr(lower(" in found._jdf.queryExecution().optimizedPlan().toString()
    got = found.collect()
    assert [(r.t, r.q, r.got) for r in got] == [(r.t, r.q, r.want) for r in got] and sum(r.got is not None for r in got) > 15
    chars = spark.range(0x10000).where("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    assert chars.where(F.col("c").rlike(BLANK_RUN) != F.col("c").rlike(rf"[\s\x1C-\x1F\x85{WIDE_BLANKS}]+")).count() == 0
    assert chars.where(F.col("c").rlike(r"[\x00-\xFF]") & (F.col("c").rlike(BLANK_RUN) != F.col("c").rlike(LATIN_BLANK_RUN))).count() == 0


def test_references_are_read_once(spark):
    sections = spark.createDataFrame([(1, "concluido", "depoimentos", "concluido", 1, 0, 0)], "case_id int, dossier_status string, section string, status string, item_count int, open_fields int, open_gaps int")
    items = spark.createDataFrame([(1, "depoimentos", 1, "", "foi  dito")], "case_id int, section string, item_no int, part string, literal string")
    references = spark.createDataFrame([(1, "depoimentos", 1, "", 1, 0, "isto FOI", "alta")], "case_id int, section string, item_no int, part string, page_number int, chunk_index int, excerpt string, confidence string")
    chunks = spark.createDataFrame([(1, 1, 0, "Isto foi\ndito", "media")], "case_id int, page_number int, chunk_index int, text string, source_confidence string")
    findings, _ = K.audit_dossiers(sections, items, references, chunks)
    assert "instr" not in findings._jdf.queryExecution().optimizedPlan().toString().lower() and "regexp" not in findings._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(r.code for r in findings.collect()) == ["source_confidence_mismatch", "testimony_not_literal"]
