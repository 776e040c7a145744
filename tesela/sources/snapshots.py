"""Versioned Parquet snapshots: a table of a collection, a manifest or a log, replaced by writing the next version and a pointer."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


class Pointer:
    """A table of rows (seq, ...) under `pointer` of a folder, appended one at a time; the highest seq counts.

    Lines that can't be read are left out with a warning, so a torn write leaves the row before it in force.
    """

    def __init__(self, spark: SparkSession, folder: str, fields: str):
        self.spark, self.fields = spark, fields
        self.path = f"{folder.rstrip('/')}/pointer"

    def frame(self) -> DataFrame:
        """The rows that can be read."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], f"seq long, {self.fields}")
        lines = self.spark.read.schema(f"seq long, {self.fields}, _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(self.path)
        return lines.filter(F.col("seq").isNotNull() & F.col("_broken").isNull()).drop("_broken")

    def newest(self, n: int) -> list[Row]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return []
        if self.spark.read.text(self.path).filter(F.trim("value") != "").count() != self.frame().count():
            warnings.warn(f"{self.path} holds lines that can't be read; the newest good one counts", stacklevel=3)
        return self.frame().orderBy(F.desc("seq"), *[F.col(f.split()[0]) for f in self.fields.split(", ")]).limit(n).collect()

    def last(self) -> Row | None:
        return next(iter(self.newest(1)), None)

    def add(self, **values) -> None:
        last = self.last()
        row = self.spark.createDataFrame([((last["seq"] if last else 0) + 1, *(values[f.split()[0]] for f in self.fields.split(", ")))], f"seq long, {self.fields}")
        row.coalesce(1).write.mode("append").json(self.path)


class SnapshotStore:
    """A folder with versions and a pointer table, both read and written by Spark, so any shared store will do.

    The pointer is appended last, as (version, seq), and the highest seq counts: a write that broke off is never seen.  A broken pointer
    row, or one whose version is gone, leaves the last good version in force; without any, the table is as if never written.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.pointer = Pointer(spark, folder, "version string")

    def _pointer(self) -> str | None:
        """The newest version that is there."""
        for row in self.pointer.newest(16):
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions/{row['version']}")
            if row["version"] and at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
                return row["version"]
            warnings.warn(f"{self.folder}: version {row['version']} is gone; an older one counts", stacklevel=3)
        return None

    def exists(self) -> bool:
        return self._pointer() is not None

    def read(self, schema: str | None = None) -> DataFrame:
        """The current version; an empty frame of the schema if nothing was written yet."""
        at = self._pointer()
        if at is None:
            if schema is None:
                raise FileNotFoundError(self.folder)
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.folder}/versions/{at}")

    def write(self, df: DataFrame, partition_by: str | None = None) -> None:
        """Replace the table.  df may read the version before."""
        version = uuid.uuid4().hex
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(f"{self.folder}/versions/{version}")
        self.pointer.add(version=version)

    def replace(self, changed: DataFrame, rows: DataFrame, schema: str | None = None) -> None:
        """Take the rows of the changed sources (source) out and put rows in."""
        self.write(upsert(without_sources(self.read(schema), changed), rows))

    def reset(self, schema: str) -> None:
        self.write(self.spark.createDataFrame([], schema))


class SourceStore(SnapshotStore):
    """A table with a source column, laid out in buckets by a hash of the source, each a folder of its own.

    A version is a list of its buckets' folders.  A sync writes the buckets of the sources that it changes and lists the others where they
    are; reading some sources reads their buckets, within which rows are sorted by source, so row groups are left out too.  A bucket with
    a very common source is written as several files.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        super().__init__(spark, folder)
        self.buckets = buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("source"), F.lit(self.buckets)).cast("int")

    def _layout(self) -> dict[int, str] | None:
        """Folders of the buckets that have rows, at most as many as there are buckets."""
        at = self._pointer()
        return None if at is None else {r["bucket"]: r["path"] for r in self.spark.read.schema("bucket int, path string").parquet(f"{self.folder}/versions/{at}").collect()}

    def _from(self, paths: list[str], schema: str | None) -> DataFrame:
        if paths:
            return self.spark.read.schema(schema).parquet(*paths) if schema else self.spark.read.parquet(*paths)
        if schema is None:
            raise FileNotFoundError(self.folder)
        return self.spark.createDataFrame([], schema)

    def read(self, schema: str | None = None) -> DataFrame:
        return self._from(sorted((self._layout() or {}).values()), schema)

    def read_sources(self, sources: list[str], schema: str | None = None) -> DataFrame:
        """The rows of some sources, from their buckets only."""
        layout = self._layout() or {}
        asked = self.spark.createDataFrame([(x,) for x in sources], "source string")
        wanted = {r["b"] for r in asked.select(self._bucket().alias("b")).distinct().collect()}
        return self._from(sorted(layout[b] for b in wanted & layout.keys()), schema or (None if not layout else self.read().schema)).filter(F.col("source").isin(sources))

    def _write(self, rows: DataFrame, others: dict[int, str]) -> None:
        version, data = uuid.uuid4().hex, uuid.uuid4().hex
        spread = self.spark.sql("SELECT /*+ REBALANCE(bucket) */ * FROM {rows}", rows=rows.withColumn("bucket", self._bucket()))
        spread.sortWithinPartitions("bucket", "source").write.partitionBy("bucket").parquet(f"{self.folder}/data/{data}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data/{data}")
        names = [s.getPath().getName() for s in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)]
        made = {int(n[7:]): f"{self.folder}/data/{data}/{n}" for n in names if n.startswith("bucket=")}
        self.spark.createDataFrame(sorted((others | made).items()), "bucket int, path string").coalesce(1).write.parquet(f"{self.folder}/versions/{version}")
        self.pointer.add(version=version)

    def write(self, df: DataFrame, partition_by: str | None = None) -> None:
        self._write(df, {})

    def replace(self, changed: DataFrame, rows: DataFrame, schema: str | None = None) -> None:
        """Take the rows of the changed sources (source) out and put rows in; only buckets of either are read and written."""
        layout = self._layout() or {}
        named = changed.select("source").union(rows.select("source"))
        touched = {r["b"] for r in named.select(self._bucket().alias("b")).distinct().collect()}
        old = [layout[b] for b in sorted(touched & layout.keys())]
        kept = upsert(without_sources(self._from(old, schema), changed), rows) if old or schema else rows
        self._write(kept, {b: p for b, p in layout.items() if b not in touched})


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """old with the rows of new inserted, or replacing those of their key; missing columns are null (is_table: false).

    Of new rows that share a key, the greatest stays, compared by their columns in order.
    """
    new = new.groupBy(key).agg(F.max(F.struct(*[c for c in new.columns if c != key])).alias("_row")).select(key, "_row.*").select(*new.columns)
    if "is_table" in old.columns and "is_table" not in new.columns:
        new = new.withColumn("is_table", F.lit(False))
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without_sources(collection: DataFrame, sources: DataFrame) -> DataFrame:
    return collection.join(sources.select("source"), "source", "left_anti")


def with_warnings_column(log: DataFrame) -> DataFrame:
    """A log of the old shape with warnings, empty where it had none."""
    none = F.array().cast("array<struct<kind:string,claim:string>>")
    return log.withColumn("warnings", F.coalesce("warnings", none) if "warnings" in log.columns else none)


LOG = "id long, ts timestamp, question string, answer string, sources array<struct<source:string,page:int,section_hint:string,distance:double>>, latency_ms long, llm_model string, embedding_model string, warnings array<struct<kind:string,claim:string>>"
