"""A commit log over the tables of one root, and tables by key as a base and deltas.

Batches of a root are numbered one after the other. A batch writes a folder of its own in
each table and then one small manifest; readers go by the newest manifest, so of a batch
that stopped on its way nothing is seen, and when it runs again it goes on from the folders
that are whole. The clock of a batch is written down before anything else: a batch that runs again has the
rows that it had. A batch that is committed is not run again.

Append tables are the folders of all batches. Tables by key hold parts that can be merged
(sums, least and greatest values, first claims): a base, in folders by a hash of the key,
and the deltas of the batches since. A look-up reads the base's folders that its keys fall
into and at most ``open_deltas`` deltas; then the deltas are merged into a new base.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import Folders, delete

KEPT_MANIFESTS = 8
BUCKETS = 64


class Files(Folders):
    """Small files of the root's file system."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark)
        self.spark = spark

    def names(self, path: str) -> list[str]:
        fs, where = self.at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def exists(self, path: str) -> bool:
        fs, where = self.at(path)
        return fs.exists(where)

    def read(self, path: str) -> str:
        fs, where = self.at(path)
        stream = fs.open(where)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Whole or not at all: under another name first."""
        fs, where = self.at(path)
        _, draft = self.at(f"{path}.draft")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not fs.rename(draft, where):
            raise OSError(f"{path} is there already")


@dataclass
class Manifest:
    """``done``: the last committed batch; ``streams``: what is added to a stream's batch
    ids; ``bases``: of tables by key, the base's folder and the batch up to which it goes."""

    version: int = -1
    done: int = -1
    streams: dict[str, int] = field(default_factory=dict)
    bases: dict[str, dict] = field(default_factory=dict)


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def manifest(self) -> Manifest:
        names = [n for n in self.files.names(f"{self.root}/_log") if n.endswith(".json")]
        return Manifest(**json.loads(self.files.read(f"{self.root}/_log/{names[-1]}"))) if names else Manifest()

    def _publish(self, m: Manifest) -> None:
        m.version += 1
        self.files.write(f"{self.root}/_log/{m.version:020d}.json", json.dumps(m.__dict__))
        old = [n for n in self.files.names(f"{self.root}/_log") if n.endswith(".json")][:-KEPT_MANIFESTS]
        for n in old:
            delete(self.spark, f"{self.root}/_log/{n}")

    # ------------------------------------------------------------ batches

    def begin(self, stream: str, batch_id: int, now: str) -> tuple[int, str] | None:
        """(number, clock) of a batch that is to run, or None if it is committed. A stream
        that is new to the root goes on behind what is there."""
        m = self.manifest()
        number = batch_id + m.streams.get(stream, m.done + 1 - batch_id)
        if number <= m.done:
            return None
        if number != m.done + 1:
            raise ValueError(f"batch {number} of {self.root} comes before batch {m.done + 1}: a root takes one stream at a time")
        path = f"{self.root}/_clocks/{number:020d}"
        if not self.files.exists(path):
            self.files.write(path, now)
        return number, self.files.read(path)

    def commit(self, stream: str, batch_id: int, number: int) -> None:
        m = self.manifest()
        m.streams[stream], m.done = number - batch_id, number
        self._publish(m)
        delete(self.spark, f"{self.root}/_clocks/{number - 1:020d}")

    def write(self, rows: DataFrame, name: str, number: int, *by: str) -> DataFrame:
        """A batch's folder of a table, and its rows read back. It is written under another
        name and then renamed, which has to be atomic on the root's file system; a folder
        that an earlier try has finished stays, so who follows the folders as a stream never
        meets rows twice."""
        schema, path, draft = f"{self.root}/_schemas/{name}.json", f"{self.root}/{name}/batch_id={number}", f"{self.root}/_drafts/{name}-{number}"
        if not self.files.exists(schema):
            self.files.write(schema, rows.schema.json())
        if not self.files.exists(path):
            rows.write.mode("overwrite").partitionBy(*by).parquet(draft)
            self.files.rename(draft, path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def schema(self, name: str) -> StructType:
        return StructType.fromJson(json.loads(self.files.read(f"{self.root}/_schemas/{name}.json")))

    def _read(self, name: str, paths: list[str], *more: tuple[str, str]) -> DataFrame | None:
        """Folders of a table, of which some may be empty or not there."""
        paths = [p for p in paths if self.files.exists(p)]
        if not paths:
            return None
        schema = self.schema(name)
        for column, kind in more:
            schema = schema.add(column, kind)
        return self.spark.read.schema(schema).parquet(*paths)

    def table(self, name: str) -> DataFrame | None:
        """An append table: the rows of all committed batches, with their batch_id."""
        rows = self._read(name, [f"{self.root}/{name}"], ("batch_id", "long"))
        return None if rows is None else rows.where(F.col("batch_id") <= self.manifest().done)

    # ------------------------------------------------------------ tables by key

    @staticmethod
    def bucket(keys: list[str]):
        return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")

    def parts(self, name: str, keys: list[str], of: DataFrame | None = None) -> DataFrame | None:
        """The parts that committed batches have left, not merged; with ``of`` only those
        that may have its keys: the base is read in their folders alone."""
        m = self.manifest()
        base = m.bases.get(name, {"path": None, "upto": -1})
        rows = self._read(name, [f"{self.root}/{name}/batch_id={n}" for n in range(base["upto"] + 1, m.done + 1)])
        old = self._read(name, [base["path"]], ("bucket", "integer")) if base["path"] else None
        if old is None:
            return rows
        if of is not None:
            touched = [r[0] for r in of.select(self.bucket(keys)).distinct().collect()]  # BUCKETS numbers at most
            old = old.where(F.col("bucket").isin(touched))
        old = old.drop("bucket")
        return old if rows is None else old.unionByName(rows)

    def compact(self, name: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], open_deltas: int = 0) -> bool:
        """Merge a table's deltas, if they are more than ``open_deltas``, into a new base.
        Readers of the manifest before still find the old files until the next time."""
        m = self.manifest()
        base = m.bases.get(name, {"path": None, "upto": -1, "stale": []})
        parts = self.parts(name, keys) if m.done - base["upto"] > open_deltas else None
        if parts is None:
            return False
        path = f"{self.root}/{name}/base-{m.done}"
        merged = merge(parts).withColumn("bucket", self.bucket(keys))
        merged.repartition("bucket", F.pmod(F.xxhash64(*keys), F.lit(16 * BUCKETS))).write.mode("overwrite").partitionBy("bucket").parquet(path)
        stale = [p for p in [base["path"]] if p] + [f"{self.root}/{name}/batch_id={n}" for n in range(base["upto"] + 1, m.done + 1)]
        m.bases[name] = {"path": path, "upto": m.done, "stale": stale}
        self._publish(m)
        for old in base.get("stale", []):
            delete(self.spark, old)
        return True
