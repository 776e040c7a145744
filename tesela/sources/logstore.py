"""A query log that is appended to."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.sources.snapshots import LOG, Pointer, with_warnings_column
from tesela.sources.stage import drop_stage, staged


def dense_ids(rows: DataFrame, order: list[str], start: int = 0) -> tuple[DataFrame, int]:
    """rows with id long, from start + 1 without gaps in the order of the given columns, and the last id.

    Rows are dealt by ranges of the order; each task numbers its own, and the counts before it, a number for each task, are added.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the lower 33 bits count a partition's rows
    numbered = staged(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = {r["_part"]: r["count"] for r in numbered.groupBy("_part").count().collect()}
    before, total = [], start
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    offsets = spark.createDataFrame(before, "_part int, _before long")
    return numbered.join(F.broadcast(offsets), "_part").withColumn("id", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before"), total


class LogStore:
    """Rows of LOG under date=/batch= of a shared folder, each batch a set of files of its own, and a pointer that names the batches.

    A batch counts once the pointer has it, so an append that broke off is never seen, and its ids are given again.  Retention drops whole
    dates; rows of the cutoff's own date are left out by the cutoff, which the pointer keeps.  There is one writer.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.rows = spark, f"{folder.rstrip('/')}/rows"
        self.pointer = Pointer(spark, folder, "batch string, last_id long, cutoff long")

    def read(self) -> DataFrame:
        """The log, warnings empty where rows of an old shape have none."""
        last = self.pointer.last()
        if last is None:
            return self.spark.createDataFrame([], LOG)
        files = self.spark._jvm.org.apache.hadoop.fs.Path(self.rows)
        if not files.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(files):
            return self.spark.createDataFrame([], LOG)
        named = self.pointer.frame().filter(F.col("batch").isNotNull()).select("batch")
        log = self.spark.read.schema(f"{LOG}, date date, batch string").parquet(self.rows).join(named, "batch", "left_semi")
        if last["cutoff"] is not None:
            at = F.timestamp_micros(F.lit(last["cutoff"]))
            log = log.filter((F.col("date") >= F.to_date(at)) & (F.col("ts") >= at))
        return with_warnings_column(log.drop("date", "batch"))

    def append(self, rows: DataFrame) -> int:
        """Add rows (ts, question, ...), which get the next ids in order of time and question; the last id.  Only they are written."""
        last = self.pointer.last()
        numbered, total = dense_ids(rows, ["ts", "question"], last["last_id"] if last else 0)
        batch = uuid.uuid4().hex
        shaped = self.spark.createDataFrame([], LOG).unionByName(numbered, allowMissingColumns=True)
        shaped.withColumns({"date": F.to_date("ts"), "batch": F.lit(batch)}).write.mode("append").partitionBy("date", "batch").parquet(self.rows)
        self.pointer.add(batch=batch, last_id=total, cutoff=last["cutoff"] if last else None)
        return total

    def purge(self, cutoff: Column) -> int:
        """Remove the rows older than the cutoff; how many those were.  No row is rewritten."""
        at, day = self.spark.range(1).select(F.unix_micros(cutoff), F.date_format(cutoff, "yyyy-MM-dd")).first()
        last = self.pointer.last()
        if last is None or (last["cutoff"] is not None and last["cutoff"] >= at):
            return 0
        removed = self.read().filter(F.col("ts") < F.timestamp_micros(F.lit(at))).count()
        if removed:
            self.pointer.add(batch=None, last_id=last["last_id"], cutoff=at)
            files = self.spark._jvm.org.apache.hadoop.fs.Path(self.rows)
            dates = [s.getPath().getName() for s in files.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(files)]
            for name in dates:  # one folder a day
                if name.startswith("date=") and name[5:] < day:
                    drop_stage(self.spark, f"{self.rows}/{name}")
        return removed
