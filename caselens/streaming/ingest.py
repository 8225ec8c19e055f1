"""Incremental ingest of new case files into one store.

A micro-batch writes every table that follows from its files - files, refusals, chunks, index, vectors - and drops what was derived
from the former text of replaced cases (S06), in one commit under the number of the batch. A batch that fails half way leaves
the store as it was; a batch that is delivered again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caselens.functions.scratch import written
from caselens.operators.chunks import chunk_pages
from caselens.operators.lexical import CHUNK_KEY, INDEX_ORDER, index_tables
from caselens.operators.quality import grade_pages
from caselens.operators.vectors import hash_embed
from caselens.sources.store import Store
from caselens.sources.tables import dedupe_ingest

MAX_BYTES = 100 * 1024 * 1024
HEADER = "%PDF"
WRITER = "ingest"
#: Bytes of uploaded files per task: tasks grow in number with the batch, not in size.
TASK_BYTES = 8 * 1024 * 1024


def checked(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Header and size check of uploaded files: ``reason`` names the first that fails, NULL when the file is accepted."""
    size = F.coalesce("size_bytes", F.lit(0))
    return files.withColumn("reason", F.when(~F.coalesce(F.startswith("head", F.lit(HEADER)), F.lit(False)), "cabecalho")
                            .when(size <= 0, "vazio").when(size > max_bytes, "tamanho"))


@contextmanager
def _sized(spark: SparkSession, tasks: int) -> Iterator[None]:
    """A stream's session plans without adaptive execution, so each shuffle had the same few tasks for a batch of any size."""
    wanted = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(tasks),
              "spark.sql.files.maxPartitionBytes": str(4 * TASK_BYTES)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def ingest_batch(batch: DataFrame, number: int, store: Store, max_bytes: int = MAX_BYTES, derived: tuple[str, ...] = ("results",)) -> bool:
    """One micro-batch; False if it was committed before. ``derived`` names tables of results that depend on a case's text."""
    if store.done(WRITER, number):
        return False
    spark = batch.sparkSession
    files = written(checked(batch.select("case_id", "sha256", "seq", "head", "size_bytes", "created_at").distinct(), max_bytes), "files")
    refused = files.where("reason is not null").select("case_id", "sha256", "seq", "reason")
    stored = store.read("files")
    if stored is None:
        stored = spark.createDataFrame([], "case_id string, sha256 string, status string, updated_at timestamp")
    answered = dedupe_ingest(files.where("reason is null"), stored)
    done = written(answered.where(~F.col("reused")).select(
        "case_id", "sha256", F.lit("concluido").alias("status"), F.col("created_at").alias("updated_at")), "done")
    size = files.where("reason is null").agg(F.sum("size_bytes")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    with _sized(spark, tasks):
        # Files come in as many pieces as they were uploaded in; their pages are dealt anew.
        pages = batch.join(done.select("case_id"), "case_id", "left_semi").repartition(tasks, "case_id", "page_number")
        chunks = written(chunk_pages(grade_pages(pages)), "chunks")
        index = index_tables(chunks)
        vectors = hash_embed(chunks).select(*CHUNK_KEY, "slots", "norm")
        tables = {"files": (done, done), "refusals": (refused, refused), "chunks": (chunks, done), "vectors": (vectors, done)}
        tables |= {name: (rows, done) for name, rows in index._asdict().items()}
        for name in derived:
            if (old := store.read(name)) is not None:
                tables[name] = (old.limit(0), done)
        return store.commit(tables, batch=(WRITER, number), order=INDEX_ORDER)


def ingest_stream(source: DataFrame, store: Store, checkpoint: str, max_bytes: int = MAX_BYTES, derived: tuple[str, ...] = ("results",)) -> StreamingQuery:
    """Start the stream over ``source`` (one row per page with its file's sha256, seq, head, size_bytes, created_at)."""
    return (
        source.writeStream.foreachBatch(lambda batch, number: ingest_batch(batch, number, store, max_bytes, derived))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def page_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
