"""Lexical, vector and fused retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselens.functions.numbering import first_per_key
from caselens.functions.scratch import shared_dir, written
from caselens.operators import fusion as R
from caselens.operators import lexical as L
from caselens.operators import vectors as V
from caselens.plans import inputs as I
from caselens.plans.inputs import CHUNKS_CTE, QUESTIONS, SEARCH_CTE, table
from caselens.plans.registry import query
from caselens.sources.store import Store

# Questions to tokens; the list of ignored words is the fixed value of the lexical operator.
STOP_SQL = ", ".join(f"'{w}'" for w in L.STOP_WORDS)
QUERY_TOKENS = f"""
query_terms AS (
  SELECT DISTINCT query_id, case_id, term FROM (
    SELECT query_id, case_id, unnest(regexp_extract_all(strip_accents(lower(replace(question, '_', ' '))), '[a-z0-9]+')) AS term
    FROM questions) WHERE length(term) >= 3 AND term NOT IN ({STOP_SQL}))"""
INDEX = """
tokens AS (SELECT case_id, page_number, chunk_index, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS t FROM chunks),
lens AS (SELECT case_id, page_number, chunk_index, len(t) AS chunk_len FROM tokens),
stats AS (SELECT case_id, count(*) AS n_docs, avg(chunk_len) AS avg_len FROM lens GROUP BY 1),
postings AS (SELECT case_id, page_number, chunk_index, term, count(*) AS tf
  FROM (SELECT case_id, page_number, chunk_index, unnest(t) AS term FROM tokens) GROUP BY ALL),
dfs AS (SELECT case_id, term, count(*) AS df FROM postings GROUP BY 1, 2)"""


def bm25_ctes(k: str, suffix: str = "") -> str:
    return f"""
scored{suffix} AS (
  SELECT query_id, case_id, page_number, chunk_index, round(sum(
    greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * chunk_len / avg_len))), 9) AS bm25
  FROM query_terms{suffix} JOIN postings USING (case_id, term) JOIN dfs USING (case_id, term) JOIN stats USING (case_id)
    JOIN lens USING (case_id, page_number, chunk_index) GROUP BY 1, 2, 3, 4),
lexical{suffix} AS (
  SELECT *, round(1.0 / rank, 4) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, case_id ORDER BY bm25 DESC, page_number, chunk_index) AS rank FROM scored{suffix})
  WHERE rank <= {k})"""


def tokens_cte(source: str, suffix: str) -> str:
    return QUERY_TOKENS.replace("query_terms", "query_terms" + suffix).replace("FROM questions", f"FROM {source}")


# Hash embedding: index of a token is the head of its SHA-256 modulo 384.
SLOT = "CAST(('0x' || substr(sha256(token), 1, 8)) AS BIGINT) % 384"
HASHED = f"""
chunk_w AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY case_id, page_number, chunk_index)) AS w FROM (
  SELECT case_id, page_number, chunk_index, {SLOT} AS idx, count(*)::DOUBLE AS n FROM (
    SELECT case_id, page_number, chunk_index, unnest(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+')) AS token FROM chunks)
  GROUP BY ALL))"""


def semantic_ctes(source: str, k: str, suffix: str = "") -> str:
    return f"""
query_w{suffix} AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS w FROM (
  SELECT query_id, case_id, {SLOT} AS idx, count(*)::DOUBLE AS n FROM (
    SELECT query_id, case_id, unnest(regexp_extract_all(strip_accents(lower(question)), '[a-z0-9]+')) AS token FROM {source})
  GROUP BY ALL)),
dots{suffix} AS (
  SELECT q.query_id, c.case_id, c.page_number, c.chunk_index, round(greatest(0, least(1, coalesce(d.dot, 0))), 6) AS score
  FROM (SELECT DISTINCT query_id, case_id FROM query_w{suffix}) q JOIN chunks c USING (case_id) LEFT JOIN (
    SELECT query_id, case_id, page_number, chunk_index, sum(q.w * c.w) AS dot
    FROM query_w{suffix} q JOIN chunk_w c USING (case_id, idx) GROUP BY ALL) d
    ON d.query_id = q.query_id AND d.case_id = c.case_id AND d.page_number = c.page_number AND d.chunk_index = c.chunk_index),
semantic{suffix} AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, case_id ORDER BY score DESC, page_number, chunk_index) AS rank FROM dots{suffix})
  WHERE rank <= {k})"""


def hybrid_ctes(source: str, k: str, suffix: str = "") -> str:
    """Fused list of one query; both sides are already cut at 2k."""
    return f"""
both_sides{suffix} AS (SELECT query_id, case_id, page_number, chunk_index, rank, score, 0 AS side FROM semantic{suffix}
  UNION ALL SELECT query_id, case_id, page_number, chunk_index, rank, score, 1 FROM lexical{suffix}),
n_sides{suffix} AS (SELECT query_id, count(DISTINCT side) AS sides FROM both_sides{suffix} GROUP BY 1),
merged{suffix} AS (
  SELECT query_id, case_id, page_number, chunk_index, round(sum(1.0 / (60 + rank)), 12) AS fused, min(side * 1000 + rank) AS seen
  FROM both_sides{suffix} JOIN n_sides{suffix} USING (query_id) WHERE sides = 2 GROUP BY 1, 2, 3, 4),
fused{suffix} AS (SELECT query_id, case_id, page_number, chunk_index, round(fused * 61 / 2, 4) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, seen) AS rank FROM merged{suffix}
  UNION ALL SELECT query_id, case_id, page_number, chunk_index, score, rank
    FROM both_sides{suffix} JOIN n_sides{suffix} USING (query_id) WHERE sides = 1),
best_k{suffix} AS (SELECT * FROM fused{suffix} WHERE rank <= {k}),
preferred{suffix} AS (
  SELECT l.query_id, l.case_id, l.page_number, l.chunk_index, l.score FROM lexical{suffix} l JOIN n_sides{suffix} n USING (query_id)
  WHERE l.rank = 1 AND n.sides = 2 AND l.query_id IN (
    SELECT query_id FROM query_terms{suffix} WHERE term IN ('data', 'decisao', 'numero', 'prazo', 'resultado', 'valor'))),
hybrid{suffix} AS (
  SELECT * EXCLUDE (o) FROM (SELECT query_id, case_id, page_number, chunk_index, score, o,
    row_number() OVER (PARTITION BY query_id ORDER BY o) AS rank FROM (
      SELECT *, 0 AS o FROM preferred{suffix}
      UNION ALL SELECT query_id, case_id, page_number, chunk_index, score, rank FROM best_k{suffix} c
        WHERE NOT EXISTS (SELECT 1 FROM preferred{suffix} p WHERE p.query_id = c.query_id
          AND p.page_number = c.page_number AND p.chunk_index = c.chunk_index))) WHERE rank <= {k})"""


@query("l01_query_tokens", "WITH" + QUESTIONS + "," + QUERY_TOKENS + """
SELECT query_id, string_agg(term, '|' ORDER BY term) AS tokens FROM query_terms GROUP BY 1""")
def l01(spark, sf):
    return L.query_tokens(I.questions(spark, sf)).select("query_id", "tokens")


@query("l02_postings", CHUNKS_CTE + "," + INDEX + """
SELECT case_id, page_number, chunk_index, term, tf, chunk_len FROM postings JOIN lens USING (case_id, page_number, chunk_index)""")
def l02_postings(spark, sf):
    return L.postings(I.chunks(spark, sf))


@query("l02_term_statistics", CHUNKS_CTE + "," + INDEX + " SELECT case_id, term, df FROM dfs")
def l02_terms(spark, sf):
    return L.term_statistics(L.postings(I.chunks(spark, sf)))


@query("l02_case_statistics", CHUNKS_CTE + "," + INDEX + " SELECT case_id, n_docs, avg_len FROM stats")
def l02_cases(spark, sf):
    return L.case_statistics(I.chunks(spark, sf))


@query("l02_refresh_index", CHUNKS_CTE + """,
reread AS (SELECT case_id, page_number, chunk_index, text FROM chunks WHERE case_id NOT IN (SELECT case_id FROM chunks WHERE page_number % 7 = 3 AND chunk_index = 0 AND source_confidence = 'baixa')
  UNION ALL SELECT case_id, page_number, 0, 'relido Relido às ' || page_number FROM (SELECT DISTINCT case_id, page_number FROM chunks WHERE page_number % 7 = 3 AND source_confidence = 'baixa')
    WHERE case_id IN (SELECT case_id FROM chunks WHERE page_number % 7 = 3 AND chunk_index = 0 AND source_confidence = 'baixa')),""" + INDEX.replace("FROM chunks)", "FROM reread)") + """
SELECT 'posting' AS kind, case_id, page_number, chunk_index, term, tf, chunk_len::BIGINT AS n, NULL::DOUBLE AS avg_len FROM postings JOIN lens USING (case_id, page_number, chunk_index)
UNION ALL SELECT 'term', case_id, NULL, NULL, term, NULL, df, NULL FROM dfs
UNION ALL SELECT 'case', case_id, NULL, NULL, NULL, NULL, n_docs, avg_len FROM stats""")
def l02_refresh(spark, sf):
    """Cases with a doubtful page are read again: only their part of the stored index is made anew."""
    chunks = written(I.chunks(spark, sf).select("case_id", "page_number", "chunk_index", "text", "source_confidence"), "chunks")
    store = Store(spark, shared_dir(spark, "index"), 8)
    L.refresh_index(store, chunks)
    again = chunks.where("page_number % 7 = 3 and source_confidence = 'baixa'")
    cases = again.where("chunk_index = 0").select("case_id").distinct()
    new = again.join(cases, "case_id", "left_semi").select("case_id", "page_number").distinct().select(
        "case_id", "page_number", F.lit(0).alias("chunk_index"), F.concat(F.lit("relido Relido às "), F.col("page_number").cast("string")).alias("text"))
    L.refresh_index(store, new, cases)
    found = L.stored_index(store)
    none = lambda kind: F.lit(None).cast(kind)
    return found.postings.where("term is not null").select(
        F.lit("posting").alias("kind"), *L.CHUNK_KEY, "term", "tf", F.col("chunk_len").cast("bigint").alias("n"), none("double").alias("avg_len")).unionByName(
        found.terms.select(F.lit("term").alias("kind"), "case_id", none("int").alias("page_number"), none("int").alias("chunk_index"), "term", none("bigint").alias("tf"), F.col("df").alias("n"), none("double").alias("avg_len"))).unionByName(
        found.cases.select(F.lit("case").alias("kind"), "case_id", none("int").alias("page_number"), none("int").alias("chunk_index"), none("string").alias("term"), none("bigint").alias("tf"), F.col("n_docs").alias("n"), "avg_len"))


BM25_SQL = SEARCH_CTE + "," + QUERY_TOKENS + "," + INDEX + "," + bm25_ctes("5") + """
SELECT query_id, case_id, page_number, chunk_index, rank, bm25, score FROM lexical"""


@query("l03_bm25_search", BM25_SQL)
def l03(spark, sf):
    """Flagship: the index of all chunks is stored, then asked; no chunk is read again."""
    store = Store(spark, shared_dir(spark, "index"), 8)
    L.refresh_index(store, I.chunks(spark, sf))
    return L.bm25_search(None, I.questions(spark, sf), 5, L.stored_index(store))


@query("l04_bm25_transient", BM25_SQL)
def l04(spark, sf):
    return L.bm25_search(I.chunks(spark, sf), I.questions(spark, sf), 5)


@query("l05_lexical_priority", "WITH" + QUESTIONS + "," + QUERY_TOKENS + """
SELECT query_id, bool_or(term IN ('data', 'decisao', 'numero', 'prazo', 'resultado', 'valor')) AS priority
FROM query_terms GROUP BY 1""")
def l05(spark, sf):
    return I.questions(spark, sf).select("query_id", L.needs_lexical_priority(F.col("question")).alias("priority"))


ANCHORS = [("the and", 2), ("ou en", 3), ("der", 2), ("of the", 4)]
ANCHORED = """
flat AS (SELECT case_id, page_number, chunk_index, regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '', 'g') AS f FROM chunks),
wanted(no, phrase, lim) AS (VALUES (0, 'theand', 2), (1, 'ouen', 3), (2, 'der', 2), (3, 'ofthe', 4)),
found AS (SELECT *, row_number() OVER (PARTITION BY case_id, no ORDER BY page_number, chunk_index) AS nth
  FROM flat JOIN wanted ON contains(f, phrase)),
limited AS (SELECT case_id, no, nth, page_number, chunk_index FROM found WHERE nth <= lim),
both_steps AS (SELECT *, 0 AS step FROM limited UNION ALL
  SELECT l.case_id, no, nth, l.page_number, l.chunk_index + 1, 1 FROM limited l JOIN chunks c
    ON c.case_id = l.case_id AND c.page_number = l.page_number AND c.chunk_index = l.chunk_index + 1),
firsts AS (SELECT case_id, page_number, chunk_index, min((no, nth, step)) AS o FROM both_steps GROUP BY 1, 2, 3),
anchors AS (SELECT case_id, page_number, chunk_index, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY o) AS rank FROM firsts) WHERE rank <= 10)"""


@query("l06_pattern_anchors", CHUNKS_CTE + "," + ANCHORED + " SELECT *, round(1.0 / rank, 4) AS score FROM anchors")
def l06(spark, sf):
    return L.pattern_anchors(I.chunks(spark, sf), ANCHORS, 10)


@query("v01_hash_embed", CHUNKS_CTE + "," + HASHED + """
SELECT case_id || '-p' || lpad(page_number::VARCHAR, 4, '0') || '-c' || lpad(chunk_index::VARCHAR, 4, '0') AS vector_id, idx, w AS weight
FROM chunk_w""")
def v01(spark, sf):
    named = I.chunks(spark, sf).select(V.vector_id().alias("vector_id"), "text")
    return V.hash_weights(V.hash_embed(named), ["vector_id"])


@query("v07_vector_id", CHUNKS_CTE + """
SELECT case_id || '-p' || lpad(page_number::VARCHAR, 4, '0') || '-c' || lpad(chunk_index::VARCHAR, 4, '0') AS vector_id FROM chunks""")
def v07(spark, sf):
    return I.chunks(spark, sf).select(V.vector_id().alias("vector_id"))


def _vectors(spark, sf):
    """Two models over the same rows: the stored vector and its reverse."""
    e = table(spark, sf, "embeddings").select(
        F.col("label").alias("case_id"), F.col("vec_id").alias("page_number"), F.lit(0).alias("chunk_index"),
        F.lit("m").alias("model"), F.col("embedding").cast("array<double>").alias("vec"))
    # The second model leaves out the last coordinate's sign, so the two lists differ.
    other = e.withColumn("model", F.lit("r")).withColumn("vec", F.transform("vec", lambda x: F.abs(x)))
    return V.l2_normalize(V.union_models([e, other]), "vec", 64)


def _vector_queries(spark, sf):
    """The first vector of each label asks its own case."""
    first = first_per_key(_vectors(spark, sf), ["case_id", "model"], [F.col("page_number")])
    return first.select(F.col("case_id").alias("query_id"), "case_id", "model", "vec")


VECTORS = """
vectors AS (
  SELECT label AS case_id, vec_id AS page_number, 'm' AS model, CAST(embedding AS DOUBLE[]) AS raw FROM embeddings UNION ALL
  SELECT label, vec_id, 'r', list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) FROM embeddings),
units AS (SELECT * EXCLUDE (raw), list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS vec FROM vectors),
asked AS (SELECT case_id, model, arg_min(vec, page_number) AS q FROM units GROUP BY 1, 2),
sims AS (SELECT case_id, page_number, model, round(greatest(0, least(1, list_dot_product(vec, q))), 6) AS score
  FROM units JOIN asked USING (case_id, model)),
vec_hits AS (SELECT *, row_number() OVER (PARTITION BY case_id, model ORDER BY score DESC, page_number) AS rank FROM sims)"""


@query("v02_l2_normalize", """
SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / n)), 6) AS total, round(list_dot_product(v, v) / (n * n), 6) AS length
FROM (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))""")
def v02(spark, sf):
    unit = V.l2_normalize(table(spark, sf, "embeddings").withColumnRenamed("embedding", "vec"), "vec", 64)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return unit.select("vec_id", F.round(add(F.col("vec")), 6).alias("total"),
                       F.round(add(F.transform("vec", lambda x: x * x)), 6).alias("length"))


@query("v03_vector_search", "WITH" + VECTORS + """
SELECT case_id::BIGINT AS query_id, model, page_number, rank, score FROM vec_hits WHERE rank <= 10""")
def v03(spark, sf):
    return V.vector_search(_vectors(spark, sf), _vector_queries(spark, sf), 10).select(
        "query_id", "model", "page_number", "rank", "score")


@query("v03_hash_search", SEARCH_CTE + "," + HASHED + "," + semantic_ctes("questions", "5") + """
SELECT query_id, case_id, page_number, chunk_index, score, rank FROM semantic""")
def v03_hash(spark, sf):
    return V.hash_search(I.chunks(spark, sf), I.questions(spark, sf), 5)


def _vote_sql(limit: int, best: str, k: int) -> str:
    return f"""
, voted AS (SELECT case_id, page_number, count(*) AS votes, round(sum(0.5 * score + 0.5 / rank), 9) AS score_sum, max({best}) AS best,
  min((model, rank)) AS seen FROM vec_hits WHERE rank <= {limit} GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY votes DESC, score_sum DESC, best DESC, seen) AS rank FROM voted)"""


@query("v04_ensemble_search", "WITH" + VECTORS + _vote_sql(10, "0.5 * score + 0.5 / rank", 5) + """
SELECT case_id::BIGINT AS query_id, page_number, votes, rank, round(0.65 * score_sum / votes + 0.35 * votes / 2, 4) AS score
FROM ranked WHERE rank <= 5""")
def v04(spark, sf):
    hits = V.vector_search(_vectors(spark, sf), _vector_queries(spark, sf), 10)
    return V.ensemble_search(hits, 2, 5).select("query_id", "page_number", "votes", "rank", "score")


@query("v05_ensemble_docs", "WITH" + VECTORS + _vote_sql(20, "1.0 / rank", 10) + """
SELECT case_id::BIGINT AS query_id, page_number AS doc_id, votes, rank FROM ranked WHERE rank <= 10""")
def v05(spark, sf):
    hits = V.vector_search(_vectors(spark, sf), _vector_queries(spark, sf), 20).withColumnRenamed("page_number", "doc_id")
    return V.ensemble_docs(hits, 10).select("query_id", "doc_id", "votes", "rank")


@query("v06_stale_vectors", CHUNKS_CTE + """
, v AS (SELECT case_id, count(*) AS vector_count FROM chunks WHERE source_confidence <> 'baixa' GROUP BY 1),
c AS (SELECT case_id, count(*) AS chunk_count FROM chunks GROUP BY 1)
SELECT case_id, coalesce(vector_count, 0) AS vector_count, chunk_count FROM c LEFT JOIN v USING (case_id)
WHERE coalesce(vector_count, 0) <> chunk_count""")
def v06(spark, sf):
    chunks = I.chunks(spark, sf)
    return V.stale_vectors(chunks.where("source_confidence <> 'baixa'"), chunks)


@query("f01_unique_queries", """
WITH q AS (SELECT user_id, trim(event_type) AS question, (value - 5) AS weight, event_id AS pos FROM events)
SELECT user_id, question, max(weight) AS weight, min(pos) AS pos FROM q WHERE question <> '' AND weight > 0 GROUP BY 1, 2""")
def f01(spark, sf):
    rows = table(spark, sf, "events").select(
        "user_id", F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("question"),
        (F.col("value") - 5).alias("weight"), F.col("event_id").alias("pos"))
    return R.unique_queries(rows, ["user_id"])


@query("f02_rrf", "WITH" + VECTORS + """
, lists AS (SELECT *, CASE model WHEN 'm' THEN 0 ELSE 1 END AS no, CASE model WHEN 'm' THEN 1.0 ELSE 0.35 END AS weight FROM vec_hits
  WHERE rank <= 10),
total AS (SELECT case_id, sum(w) AS total FROM (SELECT DISTINCT case_id, no, weight::DOUBLE AS w FROM lists) GROUP BY 1),
fused AS (SELECT case_id, page_number, round(sum(weight::DOUBLE / (60 + rank)), 12) AS fused, min((no, rank)) AS seen FROM lists GROUP BY 1, 2)
SELECT case_id::BIGINT AS case_id, page_number, rank, round(fused * 61 / total, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY fused DESC, seen) AS rank FROM fused) JOIN total USING (case_id)
WHERE rank <= 10""")
def f02(spark, sf):
    hits = V.vector_search(_vectors(spark, sf), _vector_queries(spark, sf), 10)
    first = F.col("model") == "m"
    lists = hits.withColumn("list_no", F.when(first, 0).otherwise(1)).withColumn(
        "weight", F.when(first, 1.0).otherwise(0.35))
    return R.rrf(lists, ["case_id"], 10).select("case_id", "page_number", "rank", "score")


def _stored_chunks(spark, sf):
    """The chunk table, made once and read by every branch of a fused search."""
    return written(I.chunks(spark, sf), "chunks")


@query("f03_f04_hybrid", SEARCH_CTE + "," + QUERY_TOKENS + "," + INDEX + "," + bm25_ctes("10") + "," + HASHED + ","
       + semantic_ctes("questions", "10") + "," + hybrid_ctes("questions", "5") + """
SELECT query_id, case_id, page_number, chunk_index, rank, score FROM hybrid""")
def f03(spark, sf):
    return R.hybrid_search(_stored_chunks(spark, sf), I.questions(spark, sf), 5)


WEIGHTED = """
weighted AS (
  SELECT query_id AS question_id, case_id, query_id * 2 AS query_id, 0 AS pos, question, 1.0::DOUBLE AS weight FROM questions
  UNION ALL SELECT q.query_id, q.case_id, q.query_id * 2 + 1, 1, b.text || ' prazo', 0.35::DOUBLE
  FROM questions q JOIN benchmark b ON b.item_id = q.query_id + 1 WHERE q.query_id % 3 <> 0),
sizes AS (SELECT question_id, count(*) AS n, sum(weight) AS total FROM weighted GROUP BY 1),
lone AS (SELECT w.* FROM weighted w JOIN sizes USING (question_id) WHERE n = 1),
several AS (SELECT w.* FROM weighted w JOIN sizes USING (question_id) WHERE n > 1)"""


def _multi_sql(k: int) -> str:
    return (SEARCH_CTE + "," + WEIGHTED + "," + INDEX + "," + HASHED + ","
            + tokens_cte("lone", "_1") + "," + bm25_ctes(str(2 * k), "_1") + "," + semantic_ctes("lone", str(2 * k), "_1") + ","
            + hybrid_ctes("lone", str(k), "_1") + ","
            + tokens_cte("several", "_2") + "," + bm25_ctes(str(4 * k), "_2") + "," + semantic_ctes("several", str(4 * k), "_2") + ","
            + hybrid_ctes("several", str(2 * k), "_2") + f"""
, summed AS (SELECT question_id, w.case_id, page_number, chunk_index, round(sum(weight / (60 + rank)), 12) AS fused, min((pos, rank)) AS seen
  FROM hybrid_2 JOIN several w USING (query_id) GROUP BY 1, 2, 3, 4),
top AS (SELECT question_id, case_id, page_number, chunk_index, rank, round(fused * 61 / total, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY fused DESC, seen) AS rank FROM summed) JOIN sizes USING (question_id)
  WHERE rank <= {k}),
forced AS (SELECT question_id, w.case_id, page_number, chunk_index, score FROM hybrid_2 h JOIN several w USING (query_id)
  WHERE rank = 1 AND pos = 1),
absent AS (SELECT * FROM forced f WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.question_id = f.question_id
  AND t.page_number = f.page_number AND t.chunk_index = f.chunk_index)),
kept AS (SELECT * FROM top t WHERE rank < {k} OR question_id NOT IN (SELECT question_id FROM absent))
SELECT question_id, case_id, page_number, chunk_index, rank, score FROM kept UNION ALL
SELECT question_id, case_id, page_number, chunk_index, (SELECT max(rank) + 1 FROM kept k WHERE k.question_id = a.question_id), score
FROM absent a UNION ALL
SELECT question_id, w.case_id, page_number, chunk_index, rank, score FROM hybrid_1 JOIN lone w USING (query_id)""")


@query("f05_multi_query_search", _multi_sql(5))
def f05(spark, sf):
    return R.multi_query_search(_stored_chunks(spark, sf), I.weighted_queries(spark, sf), 5)


@query("f06_multi_query_lexical", SEARCH_CTE + "," + WEIGHTED + "," + INDEX + "," + tokens_cte("weighted", "_w") + ","
       + bm25_ctes("10", "_w") + """
, lists AS (SELECT question_id, l.case_id, page_number, chunk_index, rank, pos, weight FROM lexical_w l JOIN weighted w USING (query_id)),
total AS (SELECT question_id, sum(weight) AS total FROM (SELECT DISTINCT question_id, pos, weight FROM lists) GROUP BY 1),
summed AS (SELECT question_id, case_id, page_number, chunk_index, round(sum(weight / (60 + rank)), 12) AS fused, min((pos, rank)) AS seen
  FROM lists GROUP BY 1, 2, 3, 4)
SELECT question_id, case_id, page_number, chunk_index, rank, round(fused * 61 / total, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY fused DESC, seen) AS rank FROM summed) JOIN total USING (question_id)
WHERE rank <= 5""")
def f06(spark, sf):
    return R.multi_query_lexical(_stored_chunks(spark, sf), I.weighted_queries(spark, sf), 5)


@query("f07_diverse_sources", SEARCH_CTE + "," + QUERY_TOKENS + "," + INDEX + "," + bm25_ctes("4") + "," + ANCHORED + """
, ordered AS (SELECT case_id, page_number, chunk_index, (0, rank, 0) AS o FROM anchors WHERE rank <= 5 UNION ALL
  SELECT case_id, page_number, chunk_index, (1, rank, query_id) FROM lexical),
firsts2 AS (SELECT case_id, page_number, chunk_index, min(o) AS o FROM ordered GROUP BY 1, 2, 3)
SELECT case_id, page_number, chunk_index, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY o) AS rank FROM firsts2) WHERE rank <= 6""")
def f07(spark, sf):
    chunks = _stored_chunks(spark, sf)
    lists = L.bm25_search(chunks, I.questions(spark, sf), R.list_limit(6, 2)).withColumnRenamed("query_id", "query_no")
    return R.diverse_sources(L.pattern_anchors(chunks, ANCHORS, 10), lists, 6)


@query("f08_budget_excerpts", SEARCH_CTE + "," + QUERY_TOKENS + "," + INDEX + "," + bm25_ctes("20") + f"""
, hits AS (SELECT l.query_id, l.case_id, l.page_number, l.chunk_index, l.rank, c.text FROM lexical l JOIN chunks c USING (case_id, page_number, chunk_index)),
qw AS (SELECT query_id, list_filter(regexp_split_to_array(strip_accents(lower(question)), '\\s+'), lambda w: w <> '') AS ws FROM questions),
phrases AS (
  SELECT DISTINCT query_id, n, p FROM (
    SELECT query_id, n, array_to_string(ws[i:i + n - 1], ' ') AS p FROM (
      SELECT query_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM qw, (SELECT unnest([2, 3, 4]) AS n) WHERE len(ws) >= n)
    UNION ALL SELECT query_id, 1, w FROM (SELECT query_id, unnest(ws) AS w FROM qw) WHERE length(w) >= 7)),
centres AS (
  SELECT query_id, page_number, chunk_index, max((n, length(p), -strpos(f, p))) AS best FROM (
    SELECT h.query_id, page_number, chunk_index, strip_accents(lower(text)) AS f, n, p FROM hits h JOIN phrases USING (query_id))
  WHERE strpos(f, p) > 0 GROUP BY 1, 2, 3),
placed AS (SELECT h.*, coalesce(-best[3] - 1, 0) AS centre FROM hits h LEFT JOIN centres USING (query_id, page_number, chunk_index)),
walk AS (
  WITH RECURSIVE w AS (
    SELECT query_id, 0::BIGINT AS rank, 0::BIGINT AS page_number, 0::BIGINT AS chunk_index, ''::VARCHAR AS excerpt, 0::BIGINT AS used
    FROM questions
    UNION ALL
    SELECT query_id, rank, page_number, chunk_index, e, used + length(e) FROM (
      SELECT p.query_id, p.rank, p.page_number, p.chunk_index, w.used, CASE WHEN length(p.text) <= least(700, 10000 - w.used) THEN p.text
        ELSE trim(substring(p.text, 1 + greatest(0, least(length(p.text), greatest(0, p.centre - least(700, 10000 - w.used) // 3)
          + least(700, 10000 - w.used)) - least(700, 10000 - w.used)), least(700, 10000 - w.used)), {I.BLANKS_SQL}) END AS e
      FROM w JOIN placed p ON p.query_id = w.query_id AND p.rank = w.rank + 1 WHERE w.used < 10000))
  SELECT * FROM w WHERE rank > 0)
SELECT query_id, rank, page_number, chunk_index, excerpt FROM walk""")
def f08(spark, sf):
    chunks, asked = _stored_chunks(spark, sf), I.questions(spark, sf)
    hits = L.bm25_search(chunks, asked, 20).join(chunks.select(*L.CHUNK_KEY, "text"), L.CHUNK_KEY)
    return R.budget_excerpts(hits, asked).select("query_id", "rank", "page_number", "chunk_index", "excerpt")
