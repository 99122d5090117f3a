"""Tables that an operator stores in the shared folder between its steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: what a finished write has shuffled is not needed again, as the table is read instead
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}  # by application: the folder of a session on a single machine


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only on a
    single machine (tests) may it be unset; a new temporary folder takes its place."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="visitlens-")
    return path.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


class Folders:
    """Names in a file system that Spark can reach."""

    def __init__(self, spark: SparkSession):
        self._path, self._conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsparkSession.sessionState().newHadoopConf()

    def at(self, path: str):
        where = self._path(path)
        return where.getFileSystem(self._conf), where

    def of_days(self, path: str) -> list[str]:
        """All folders day=..., from names alone."""
        fs, where = self.at(path)
        out = []
        for s in fs.listStatus(where) if fs.exists(where) else []:
            name = s.getPath().getName()
            if s.isDirectory() and not name.startswith(("_", ".")):
                out += [s.getPath().toString()] if name.startswith("day=") and name[4] != "_" else self.of_days(s.getPath().toString())
        return sorted(out)

    def rename(self, old: str, new: str) -> None:
        fs, where = self.at(new)
        fs.mkdirs(where.getParent())
        if not fs.rename(self._path(old), where):
            raise OSError(f"{old} cannot become {new}")


class Scratch:
    """Stored tables of one operator, which it deletes once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back. This cuts the lineage: a lost executor costs
        only its running tasks."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            path, _ = self.paths.pop(id(t), (None, None))
            if path is not None:
                delete(self.spark, path)
