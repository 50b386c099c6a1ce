"""Shared storage: tables of their own, and tables that are replaced whole or by key without ever being half written.

A stored table is a folder of data, written once and never changed, and a log of small manifests. A manifest names the
data of one version. A write puts its rows beside the others, reads them back, and only then adds its manifest; until then, and
for good if it fails, readers see the version before. So a table can be rewritten from itself.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where driver and executors are one process and none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut and outlives executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_of(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_beside(df: DataFrame, folder: str, write) -> None:
    """Writes df by ``write(rows, folder)`` beside a folder and only then puts it in its place, so that df may come from there and a failed write costs nothing.

    A reader finds the old files or the new ones; between two renames it may find none for a moment (``StoredTable`` has no such moment).
    """
    spark, folder = df.sparkSession, folder.rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path
    target = path(folder)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fresh, old = (path(f"{folder}.{kind}-{uuid.uuid4().hex}") for kind in ("new", "old"))
    try:
        write(df, fresh.toString())
    except BaseException:
        fs.delete(fresh, True)
        raise
    if fs.exists(target):
        fs.rename(target, old)
    else:
        fs.mkdirs(target.getParent())
    if not fs.rename(fresh, target):
        fs.rename(old, target)
        raise RuntimeError(f"{folder} could not be replaced")
    fs.delete(old, True)


class Log:
    """Manifests of a folder, numbered from 1; a number is taken once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_log")
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version, 0 for none."""
        if not self.fs.exists(self.root):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(self.root)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def get(self, version: int | None = None) -> dict | None:
        version = self.version() if version is None else version
        if not version:
            return None
        stream = self.fs.open(self.jvm.org.apache.hadoop.fs.Path(self.root, f"{version:08d}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def add(self, manifest: dict, after: int) -> int:
        """The next version; fails if somebody else has written since ``after``."""
        at = self.jvm.org.apache.hadoop.fs.Path(self.root, f"{after + 1:08d}")
        beside = self.jvm.org.apache.hadoop.fs.Path(self.root, f".{uuid.uuid4().hex}")
        out = self.fs.create(beside, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        if self.fs.exists(at) or not self.fs.rename(beside, at):
            self.fs.delete(beside, False)
            raise RuntimeError(f"version {after + 1} of {self.folder} was written meanwhile")
        return after + 1

    def delete(self, path: str) -> None:
        self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(path), True)


class StoredTable:
    """A table in a folder, replaced whole (``replace``) or by key (``upsert``), version by version.

    Rows lie in buckets of their key, and a version names the folder of each bucket, so an upsert writes only the buckets that its keys
    fall into. ``keep`` versions stay readable.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str | None = None, buckets: int = 16, keep: int = 2):
        self.spark, self.folder, self.key, self.buckets, self.keep = spark, folder.rstrip("/"), key, buckets, keep
        self.log = Log(spark, folder)

    def exists(self) -> bool:
        return self.log.version() > 0

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest unless one is named."""
        found = self.log.get(version)
        if found is None:
            raise FileNotFoundError(f"no table in {self.folder}")
        return self._read(found, found["data"])

    def _read(self, manifest: dict, data: dict[str, str]) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.folder}/{p}" for p in sorted(set(data.values()))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame) -> tuple[dict[str, str], int]:
        """Folders of the buckets that rows were written to, and how many rows they hold when read back."""
        data = f"data/{uuid.uuid4().hex}"
        where = bucket_of(F.col(f"`{self.key}`"), self.buckets) if self.key else F.lit(0)
        dealt = rows.withColumn("_bucket", where)
        dealt = dealt.repartition("_bucket") if self.key else dealt
        dealt.write.partitionBy("_bucket").parquet(f"{self.folder}/{data}")
        back = self.spark.read.schema("_bucket int").parquet(f"{self.folder}/{data}").groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each bucket
        return {str(r["_bucket"]): f"{data}/_bucket={r['_bucket']}" for r in back}, sum(r["n"] for r in back)

    def _switch(self, before: int, rows: DataFrame, data: dict[str, str], n: int) -> int:
        version = self.log.add({"schema": rows.schema.jsonValue(), "data": data, "rows": n}, before)
        self._vacuum(version)
        return version

    def _vacuum(self, version: int) -> None:
        """Data that only versions before the kept ones name goes."""
        last = version - self.keep
        if last > 0 and (old := self.log.get(last)):
            kept = {p for v in range(last + 1, version + 1) if (m := self.log.get(v)) for p in m["data"].values()}
            for path in set(old["data"].values()) - kept:
                self.log.delete(f"{self.folder}/{path}")

    def replace(self, rows: DataFrame, expected: int | None = None) -> int:
        """A new version of exactly these rows, which may come from the table itself. expected: refuses if their number is another."""
        before = self.log.version()
        data, n = self._write(rows)
        if expected is not None and n != expected:
            raise ValueError(f"{n} rows instead of {expected}: not written")
        return self._switch(before, rows, data, n)

    def upsert(self, new: DataFrame, newest_by: str, expected: int | None = None) -> int:
        """A new version in which each key of ``new`` has its newest row by a column; ties go to the row that is last in order of a hash of all columns.

        expected: how many rows ``new`` must have (one vector for each id, say), else nothing is written. Rows without key are left out.
        """
        if self.key is None:
            raise ValueError("a table without key can only be replaced")
        new = new.where(F.col(f"`{self.key}`").isNotNull())
        if expected is not None and (n := new.count()) != expected:
            raise ValueError(f"{n} rows instead of {expected}: not written")
        before = self.log.version()
        found = self.log.get(before) or {"data": {}, "rows": 0}
        touched = [str(r[0]) for r in new.select(bucket_of(F.col(f"`{self.key}`"), self.buckets)).distinct().collect()]  # bucket numbers
        both = new
        if old := {b: p for b, p in found["data"].items() if b in touched}:
            both = self._read(found, old).unionByName(new)
        every = F.xxhash64(*(F.col(f"`{c}`") for c in both.columns))
        last = F.max_by(F.struct(*(F.col(f"`{c}`") for c in both.columns)), F.struct(F.col(f"`{newest_by}`"), every))
        merged = both.groupBy(F.col(f"`{self.key}`").alias("_key")).agg(last.alias("_row")).select("_row.*")
        data, n = self._write(merged)
        kept = {b: p for b, p in found["data"].items() if b not in touched}
        total = n + (self._read(found, kept).count() if kept else 0)
        return self._switch(before, merged, kept | data, total)
