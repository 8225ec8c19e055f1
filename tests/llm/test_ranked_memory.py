"""Readers of the index hold one segment at a time, however many a task has made."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from caselens.llm import ranked_search
from caselens.llm.tables import set_worker_path


def test_files_of_one_segment(spark, monkeypatch, tmp_path):
    set_worker_path(spark)
    monkeypatch.setattr(ranked_search, "SEGMENT", 2000)
    monkeypatch.setattr(ranked_search, "FIRST", 3)
    monkeypatch.setattr(ranked_search, "STRETCH", 7)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * k % 37).cast("string")) for k in range(1, 9)], F.lit("")), 400).alias("text")).coalesce(1)
    seen, real = [], ranked_search.search_index
    monkeypatch.setattr(ranked_search, "search_index", lambda segments, *rest: seen.append(segments) or real(segments, *rest))
    items = spark.createDataFrame([(1, "w1 w5 w5"), (2, "w36")], "item_id long, text string")
    got = ranked_search.search_all(docs, items, 4).collect()
    rows = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata.num_rows for f in seen[0].inputFiles()]
    assert len(rows) > 5 and set(rows) == {1}
    monkeypatch.setattr(ranked_search, "SEGMENT", 1 << 23)
    assert sorted(got) == sorted(ranked_search.search_all(docs, items, 4).collect())
