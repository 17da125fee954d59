"""Tables that outlive a plan: staged intermediate results, and versioned fact storage."""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import uuid
from itertools import groupby

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset.

    A folder of our own is on this machine's disk, so on a cluster the setting must be there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        set_dir = spark.sparkContext.getCheckpointDir()
        found = os.path.dirname(set_dir) if set_dir else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="hornlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def files(spark: SparkSession, path: str):
    """Hadoop's file system and path object for a path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    system, at = files(spark, path)
    system.delete(at, True)


@atexit.register
def release() -> None:
    """Delete all staged tables of this process."""
    while _made:
        spark, path = _made.pop()
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


def new_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/facts-{uuid.uuid4().hex}-{name}"
    _made.append((spark, path))
    return path


def stage(df: DataFrame, name: str, codec: str = "zstd") -> tuple[str, DataFrame]:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor costs one read."""
    path = new_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame, name: str, counted: Column | None = None) -> tuple[str, DataFrame, int]:
    """stage(), and the number of rows, or of rows where `counted` holds, which the write itself counts."""
    seen, what = Observation(), F.count(F.lit(1)) if counted is None else F.count_if(counted)
    path, out = stage(df.observe(seen, what.alias("n")), name)
    n = seen.get.get("n")
    return path, out, out.agg(what).first()[0] if n is None else n


#: New or retracted rows of at most this number are broadcast to the stored ones.
FEW = 10_000
#: Delete segments after which a table is rewritten without them.
DELETES = 16


class FactTable:
    """Distinct (subject, object) rows in immutable segments; a manifest names the segments of the current version.

    Storing appends a segment of the rows that are new, retracting a segment of rows to leave out (its name begins with
    a minus); neither rewrites what is stored.  Readers of an older version keep theirs: no path is written twice.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        system, at = files(spark, f"{self.path}/manifest")
        versions = sorted(int(s.getPath().getName().split(".")[0]) for s in system.listStatus(at)) if system.exists(at) else []
        self.version = versions[-1] if versions else 0
        self.segments: list[str] = json.loads(self._text(f"{self.path}/manifest/{self.version}.json")) if versions else []

    def _text(self, path: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect())

    def _commit(self, segments: list[str]) -> None:
        system, at = files(self.spark, f"{self.path}/manifest/{self.version + 1}.json")
        out = system.create(at, False)  # fails if another writer made this version
        out.write(bytearray(json.dumps(segments).encode()))
        out.close()
        self.version, self.segments = self.version + 1, segments

    def _write(self, rows: DataFrame) -> str:
        name = f"segments/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _segments(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{s.removeprefix('-')}" for s in names))

    def read(self) -> DataFrame:
        """The live rows: each run of delete segments takes its rows out of all that was stored before it."""
        if not self.segments:
            return self.spark.createDataFrame([], self.schema)
        out = None
        for deletes, run in groupby(self.segments, lambda s: s.startswith("-")):
            part = self._segments([*run])
            if deletes:
                out = out.join(part, ["subject", "object"], "left_anti")
            else:
                out = part if out is None else out.union(part)
        return out

    def store(self, rows: DataFrame, few: bool = False) -> None:
        """`few`: the rows are at most FEW, so they are sent to the stored ones and not these to them."""
        rows = rows.dropDuplicates(["subject", "object"])
        if not self.segments:
            return self._commit([self._write(rows)])
        there = self.read()
        if few:
            there = F.broadcast(there.join(F.broadcast(rows), ["subject", "object"], "left_semi"))
        self._commit([*self.segments, self._write(rows.join(there, ["subject", "object"], "left_anti"))])

    def retract(self, rows: DataFrame) -> None:
        if not self.segments:
            return
        self._commit([*self.segments, "-" + self._write(rows.distinct())])
        if sum(s.startswith("-") for s in self.segments) >= DELETES:
            self.compact()

    def compact(self) -> None:
        """Rewrite the live rows as one segment."""
        self._commit([self._write(self.read())])
