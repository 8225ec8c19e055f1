"""Tables of one store under one manifest: rows are replaced by case, and all tables switch together.

Rows lie in folders by version, table and bucket of the case. A commit writes the touched buckets anew, beside the old ones, and then
puts a manifest with the next number in place: a small file that names the folder of every bucket. Readers take the last
manifest, so they see a commit whole or not at all; what a failed one left is in no manifest. The manifest also keeps the
last batch number of each writer, so a batch that is delivered again changes nothing. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 256


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        where = self._hadoop(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("case_id"), F.lit(self.buckets)).cast("int")

    def manifest(self) -> dict:
        """The last manifest; of a new store, an empty one."""
        found = max((n for n in self._names(f"{self.path}/manifest") if n.endswith(".json")), default=None)
        if found is None:
            return {"number": 0, "tables": {}, "batches": {}}
        stream = self._fs.open(self._hadoop(f"{self.path}/manifest/{found}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, only: list[int] | None = None) -> DataFrame | None:
        """Rows of a table, with ``only`` of these buckets; None if it was never written."""
        table = self.manifest()["tables"].get(name)
        if table is None:
            return None
        schema = T.StructType.fromJson(table["schema"])
        folders = [f for b, f in table["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def done(self, writer: str, batch: int) -> bool:
        return self.manifest()["batches"].get(writer, -1) >= batch

    def commit(
        self, tables: dict[str, tuple[DataFrame, DataFrame]], keys: list[str] | None = None, batch: tuple[str, int] | None = None, order: dict[str, list[str]] | None = None,
    ) -> bool:
        """Replace rows of several tables at once; False if the batch was committed before.

        ``tables``: name -> (new rows, keys whose old rows go); ``keys``: case_id, or case_id and others; ``order`` sorts the rows of a
        table within each file. At most ``buckets`` numbers per table reach the driver.
        """
        keys, state = keys or ["case_id"], self.manifest()
        if batch is not None and state["batches"].get(batch[0], -1) >= batch[1]:
            return False
        version = uuid.uuid4().hex
        for name, (rows, replaced) in tables.items():
            replaced = replaced.select(*keys).distinct()
            touched = [r[0] for r in replaced.select(self.bucket()).distinct().collect()]
            old = self.read(name, touched)
            new = rows if old is None else old.join(replaced, keys, "left_anti").unionByName(rows)
            folder = f"{self.path}/data/{version}/{name}"
            placed = new.withColumn("case_bucket", self.bucket())
            if order and name in order:
                placed = placed.sortWithinPartitions("case_bucket", *order[name])
            placed.write.partitionBy("case_bucket").parquet(folder)
            present = {int(n.split("=")[1]) for n in self._names(folder) if n.startswith("case_bucket=")}
            table = state["tables"].setdefault(name, {"schema": rows.schema.jsonValue(), "buckets": {}})
            table["buckets"] = {b: f for b, f in table["buckets"].items() if int(b) not in touched}
            table["buckets"] |= {str(b): f"{folder}/case_bucket={b}" for b in sorted(present)}
        state["number"] += 1
        if batch is not None:
            state["batches"][batch[0]] = batch[1]
        self._switch(state)
        return True

    def _switch(self, state: dict) -> None:
        """Put a manifest in place, whole."""
        name = f"{self.path}/manifest/{state['number']:012d}.json"
        draft = self._hadoop(f"{name}.draft")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(self._hadoop(name)) or not self._fs.rename(draft, self._hadoop(name)):
            raise RuntimeError(f"another writer has put {name} in place")

    def vacuum(self) -> list[str]:
        """Delete the versions that the last manifest does not name; for when no reader is on an older one."""
        used = {f.split("/data/")[1].split("/")[0] for t in self.manifest()["tables"].values() for f in t["buckets"].values()}
        gone = [v for v in self._names(f"{self.path}/data") if v not in used]
        for v in gone:
            self._fs.delete(self._hadoop(f"{self.path}/data/{v}"), True)
        return gone
