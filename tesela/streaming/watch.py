"""Watching a folder, and bursts of events in a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesela.sources.files import is_supported
from tesela.sources.stage import drop_stage, shared_dir

QUIET_SECONDS = 2


def watch_folder(spark: SparkSession, folder: str, sync: Callable[[], object], checkpoint: str, every: str = f"{QUIET_SECONDS} seconds") -> StreamingQuery:
    """Run sync() at once, then after each trigger in which the folder's file stream has rows.

    File streams see new files only, not changes or removals, so sync itself compares hashes; the trigger's interval gathers a burst of
    files into one run.  FolderWatch also notices changes and removals.
    """
    sync()
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    names = files.select(F.regexp_extract("path", r"([^/\\]+)\z", 1).alias("source")).filter(is_supported(F.col("source")))

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            sync()

    return names.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


LISTING = "path string, modified timestamp, length long"
EVENTS = "ts timestamp, kind string, path string, is_directory boolean"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, length) of a folder's files now, sub-folders left out; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def listing_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, path) of what happened between two listings: created, modified (another time or length) or deleted.

    A move is a removal and a creation.  Both sides are dealt by path; files that stayed as they were give no row.
    """
    old = before.select("path", F.struct("modified", "length").alias("_old"))
    new = after.select("path", F.struct("modified", "length").alias("_new"))
    kind = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified")
    return old.join(new, "path", "full_outer").select(kind.alias("kind"), "path").filter(F.col("kind").isNotNull())


class FolderWatch:
    """Creations, changes and removals in a folder, and one sync for each burst of them.

    At each tick of a clock stream the folder is listed and compared with the listing before; both are tables in the shared folder, so a
    listing may be of any size.  Events of supported files are appended to the table `events`, if one is named, which is itself a source for
    readStream (see bursts_stream).  sync(reason) runs after the first tick without an event: ticks are `quiet` seconds apart, so no burst is
    cut.  The reason is the last event, as `kind:name`.

    The first listing is taken before a first sync at the start, so nothing that happens in between is lost, and a watch that was stopped
    starts anew with a sync.
    """

    def __init__(self, spark: SparkSession, folder: str, sync: Callable[[str], object], events: str | None = None):
        self.spark, self.folder, self.sync, self.events = spark, folder, sync, events
        self.base = f"{shared_dir(spark).rstrip('/')}/watch-{uuid.uuid4().hex}"
        self.reason: str | None = None
        self.at = 0
        self.known = self._kept(listing(spark, folder))
        sync("start")

    def _kept(self, rows: DataFrame) -> DataFrame:
        self.at += 1
        rows.write.parquet(f"{self.base}/{self.at}")
        return self.spark.read.schema(LISTING).parquet(f"{self.base}/{self.at}")

    def tick(self) -> None:
        """Compare with the listing before; sync if a burst is over."""
        now = self._kept(listing(self.spark, self.folder))
        found = relevant(listing_events(self.known, now).select(F.current_timestamp().alias("ts"), "kind", "path", F.lit(False).alias("is_directory")))
        last = found.orderBy("kind", "path").limit(1).collect()
        if last:
            if self.events:
                found.write.mode("append").parquet(self.events)
            self.reason = f"{last[0]['kind']}:{last[0]['path'].rsplit('/', 1)[-1]}"
        elif self.reason is not None:
            reason, self.reason = self.reason, None
            self.sync(reason)
        drop_stage(self.spark, f"{self.base}/{self.at - 1}")
        self.known = now

    def start(self, checkpoint: str, quiet: float = QUIET_SECONDS) -> StreamingQuery:
        clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return clock.writeStream.foreachBatch(lambda batch, _: self.tick()).option("checkpointLocation", checkpoint).trigger(processingTime=f"{quiet} seconds").start()


def sync_every(spark: SparkSession, sync: Callable[[], object], checkpoint: str, every: str = f"{QUIET_SECONDS} seconds") -> StreamingQuery:
    """Run sync() at each trigger of a clock stream, so changed and removed files are noticed, too."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(lambda batch, _: sync()).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def relevant(events: DataFrame) -> DataFrame:
    """Events (ts, kind, path, is_directory) that call for a sync; a move counts by the name that it moved from."""
    return events.filter(~F.col("is_directory") & F.col("kind").isin("created", "modified", "deleted", "moved") & is_supported(F.regexp_extract("path", r"([^/\\]+)\z", 1)))


def bursts_stream(events: DataFrame, late: str = "10 seconds", quiet: int = QUIET_SECONDS) -> DataFrame:
    """(folder, started, ended, n, reason) of each run of a folder's relevant events with no gap over `quiet` seconds; the last event's kind
    is the reason."""
    rows = relevant(events).withWatermark("ts", late).withColumn("folder", F.regexp_extract("path", r"\A(.*)[/\\\\]", 1))
    session = F.session_window("ts", f"{quiet} seconds")
    return rows.groupBy("folder", session).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n"), F.max_by("kind", "ts").alias("reason")).drop("session_window")
