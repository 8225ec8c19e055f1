"""Pages of testimonies are read once, then only their marks are assembled."""

from pyspark.sql import functions as F

from caselens.operators import testimonies as T

PAGES = [(1, 1, "DELEGACIA DE POLÍCIA\nTERMO DE DEPOIMENTO\nTestemunha: MARIA DA SILVA, brasileira\nDisse: que viu", "alta"), (1, 2, None, "alta"),
         (1, 3, "e mais. Nada mais disse.", "alta"), (1, 4, "LAUDO PERICIAL", "alta")]


def test_marks_are_read_once(spark):
    pages = spark.createDataFrame(PAGES, "case_id int, page_number int, text string, source_confidence string")
    starts = T.testimony_starts(pages)
    members = T.testimony_pages(pages, starts)
    for found in (starts, members):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp" not in plan and "translate(" not in plan
    assert sorted((r.start_page, r.page_number) for r in members.collect()) == [(1, 1), (1, 2), (1, 3)]


def test_person_beside_a_page_without_text(spark):
    pages = spark.createDataFrame(PAGES, "case_id int, page_number int, text string, source_confidence string")
    found = T.testimonies(pages)
    assert [(r.person.name, r.person.page_number, r.phase, r.body_status) for r in found.collect()] == [("MARIA DA SILVA", 1, "inquerito", "segmentada")]
    flat = spark.createDataFrame([("em juízo",)], "t string").select(T.phase_of(F.col("t")).alias("p"))
    assert flat._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
