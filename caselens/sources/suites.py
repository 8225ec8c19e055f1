"""Suites, observations, catalogues and relevance sets, read with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.sources.tables import strip_markup

# File shapes.
RELEVANCE_FIELDS = ["AREA", "TEMA", "SUBTEMA", "ENUNCIADO", "EXCERTO", "INDEXADORESCONSOLIDADOS", "REFERENCIALEGAL"]
GATE = ("min_label_accuracy double, min_page_precision double, min_page_recall double, min_page_hit_rate double, min_citation_fidelity double, "
        "min_item_recall double, min_abstention_accuracy double, max_false_positive_case_rate double, max_error_rate double, "
        "max_p95_latency_ms double, max_average_llm_calls double")
SUITE = (
    f"schema_version string, id string, description string, gates struct<default:struct<{GATE.replace(' double', ':double')}>,"
    f"engines:map<string,struct<{GATE.replace(' double', ':double')}>>>, cases array<struct<id:string,engine:string,split:string,provenance:string,"
    "review_status:string,description:string,tags:array<string>,source:struct<reference_id:string,document:string,title:string,url:string,sha256:string,"
    "text_sha256:string>,expected:struct<label:string,relevant_pages:array<bigint>,required_items:array<string>,forbidden_items:array<string>,should_abstain:boolean>>>"
)
OBSERVATIONS = (
    "schema_version string, suite_id string, run_id string, producer string, generated_at string, observations array<struct<case_id:string,label:string,"
    "source_pages:array<bigint>,cited_pages:array<bigint>,items:array<string>,abstained:boolean,latency_ms:bigint,llm_calls:int,prompt_tokens:bigint,"
    "completion_tokens:bigint,estimated_cost_usd:double,error:string,model:string,fallback_used:boolean,response:string>>"
)
REFERENCE = (
    "schema_version string, id string, description string, processes array<struct<id:string,domain:string,document:string,source:string,source_url:string,sha256:string,"
    "text_sha256:string,cases:array<struct<id:string,pergunta:string,expected_pages:array<bigint>,expected_terms:array<string>,response_relevant_pages:array<bigint>,"
    "response_expected_terms:array<string>,review_status:string,reviewer:string,review_notes:string>>>>"
)
TOPIC = (
    "schema_version string, topic struct<id:string,title:string,version:string,verified_at:string,scope:string,search_queries:array<string>,evidence_terms:array<string>,"
    "sources:array<struct<id:string,title:string,reference:string,url:string>>,requirements:array<struct<id:string,category:string,label:string,condition:string,"
    "legal_source_ids:array<string>,decisive_without_prejudice:boolean>>>"
)
QUESTION_SOURCES = (
    "version string, description string, sources array<struct<id:string,title:string,url:string,kind:string,official:boolean,area:string,audiencia:string,license_note:string,topics:array<string>>>"
)
EVAL_CASES = "cases array<struct<id:string,pergunta:string,expected_pages:array<bigint>,expected_terms:array<string>>>"
NULLITY = (
    "schema_version int, id string, legal_review_status string, cases array<struct<id:string,title:string,sources:array<struct<page:bigint,chunk_index:int,document_type:string,"
    "source_confidence:string,text:string>>,expected:struct<conclusion:string,procedural_impact:string,requirement_results:map<string,string>,"
    "requirement_pages:map<string,array<bigint>>,impact_pages:array<bigint>>>>"
)
OCR_GOLD = "id string, description string, human_review_status string, cases array<struct<page_number:int,label:string,expected_phrases:array<string>>>"


def _json(spark: SparkSession, path: str, schema: str, multi_line: bool) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=multi_line)


def read_suite(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per case of every suite file."""
    rows = _json(spark, path, SUITE, multi_line).select(F.col("id").alias("suite_id"), F.explode("cases").alias("c"))
    expected = [F.col("c.expected.label").alias("expected_label"), *[F.col(f"c.expected.{n}").alias(n) for n in (
        "relevant_pages", "required_items", "forbidden_items", "should_abstain")]]
    return rows.select("suite_id", F.col("c.id").alias("case_id"), *[F.col(f"c.{n}").alias(n) for n in (
        "engine", "split", "provenance", "review_status", "description", "tags", "source")], *expected)


def read_gates(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(suite_id, engine, metric bound, threshold); engine is NULL for the default."""
    rows = _json(spark, path, SUITE, multi_line)
    names = [part.split()[0] for part in GATE.split(", ")]
    bounds = lambda c: F.array(*[F.struct(F.lit(n).alias("bound"), F.col(f"{c}.{n}").alias("threshold")) for n in names])
    default = rows.select(F.col("id").alias("suite_id"), F.lit(None).cast("string").alias("engine"), F.col("gates.default").alias("g"))
    engines = rows.select(F.col("id").alias("suite_id"), F.explode("gates.engines").alias("engine", "g"))
    both = default.unionByName(engines)
    return both.select("suite_id", "engine", F.explode(bounds("g")).alias("b")).select("suite_id", "engine", "b.*").where("threshold is not null")


def read_observations(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return _json(spark, path, OBSERVATIONS, multi_line).select("suite_id", "run_id", "producer", F.explode("observations").alias("o")).select(
        "suite_id", "run_id", "producer", "o.*")


def read_reference_suite(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(processes, cases)."""
    rows = _json(spark, path, REFERENCE, multi_line).select(F.col("id").alias("suite_id"), F.explode("processes").alias("p"))
    kept = ("domain", "document", "source", "source_url", "sha256", "text_sha256")
    processes = rows.select("suite_id", F.col("p.id").alias("process_id"), *[F.col(f"p.{n}").alias(n) for n in kept])
    cases = rows.select("suite_id", F.col("p.id").alias("process_id"), F.explode("p.cases").alias("c")).select(
        "suite_id", "process_id", F.col("c.id").alias("case_id"), F.col("c.pergunta").alias("question"), *[F.col(f"c.{n}").alias(n) for n in (
            "expected_pages", "expected_terms", "response_relevant_pages", "response_expected_terms", "review_status", "reviewer", "review_notes")])
    return processes, cases


def read_topics(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(topics, requirements)."""
    rows = _json(spark, path, TOPIC, multi_line).select("topic.*")
    topics = rows.select(F.col("id").alias("topic_id"), "title", "version", "verified_at", "scope", "search_queries", F.col("evidence_terms").alias("terms"),
                         F.transform("sources", lambda s: s["id"]).alias("topic_legal_ids"))
    requirements = rows.select(F.col("id").alias("topic_id"), F.posexplode("requirements").alias("requirement_no", "r")).select(
        "topic_id", "requirement_no", F.col("r.id").alias("requirement_id"), F.col("r.category").alias("category"), F.col("r.label").alias("label"),
        F.col("r.condition").alias("condition"), F.col("r.legal_source_ids").alias("legal_ids"),
        F.coalesce("r.decisive_without_prejudice", F.lit(False)).alias("decisive"))
    return topics, requirements


def read_question_sources(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return _json(spark, path, QUESTION_SOURCES, multi_line).select(F.explode("sources").alias("s")).select(
        F.col("s.id").alias("source_id"), "s.title", "s.url", "s.kind", "s.official", "s.area", F.col("s.audiencia").alias("audience"), "s.license_note", "s.topics")


def read_eval_cases(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return _json(spark, path, EVAL_CASES, multi_line).select(F.explode("cases").alias("c")).select(
        F.col("c.id").alias("case_id"), F.col("c.pergunta").alias("question"), "c.expected_pages", "c.expected_terms")


def read_nullity_suite(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return _json(spark, path, NULLITY, multi_line).select(F.col("id").alias("suite_id"), "legal_review_status", F.explode("cases").alias("c")).select(
        "suite_id", "legal_review_status", F.col("c.id").alias("case_id"), "c.title", "c.sources", F.col("c.expected.conclusion").alias("conclusion"),
        F.col("c.expected.procedural_impact").alias("impact"), F.col("c.expected.requirement_results").alias("results"),
        F.col("c.expected.requirement_pages").alias("pages"), F.col("c.expected.impact_pages").alias("impact_pages"))


def read_ocr_gold(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return _json(spark, path, OCR_GOLD, multi_line).select(F.col("id").alias("suite_id"), "human_review_status", F.explode("cases").alias("c")).select(
        "suite_id", "human_review_status", F.col("c.page_number").alias("page_id"), "c.label", F.col("c.expected_phrases").alias("phrases"))


def read_qrels(spark: SparkSession, folder: str, queries: int | None = None, distractors: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, queries, judgements) of a relevance set, markup stripped from the documents.

    With ``queries`` only the first ones by id and their judgements; with ``distractors`` all judged documents and only the
    first other ones by key.
    """
    def csv(name: str, schema: str) -> DataFrame:
        return spark.read.csv(f"{folder}/{name}", schema=schema, header=True, multiLine=True, escape='"', enforceSchema=False)

    texts = ", ".join(f"{f} string" for f in RELEVANCE_FIELDS)
    asked = csv("query.csv", "ID bigint, TEXT string")
    asked = (asked if queries is None else asked.orderBy("ID").limit(queries)).select(F.col("ID").alias("query_id"), F.col("TEXT").alias("question"))
    judged = csv("qrel.csv", "QUERY_ID bigint, DOC_ID bigint, SCORE string").select(
        F.col("QUERY_ID").alias("query_id"), F.col("DOC_ID").alias("doc_id"), F.col("SCORE").try_cast("double").cast("int").alias("score")).join(
        asked.select("query_id"), "query_id", "left_semi")
    docs = strip_markup(csv("doc.csv", f"KEY bigint, {texts}"), RELEVANCE_FIELDS).select(F.col("KEY").alias("doc_id"), "text")
    if distractors is None:
        return docs, asked, judged
    wanted = judged.select("doc_id").distinct()
    # Only the keys are ranked; the texts of the chosen documents are joined afterwards.
    others = docs.select("doc_id").join(wanted, "doc_id", "left_anti").orderBy("doc_id").limit(distractors)
    return docs.join(wanted.unionByName(others), "doc_id", "left_semi"), asked, judged
