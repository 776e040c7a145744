import os
import time

import pytest
from pyspark.sql import functions as F

from tesela.streaming import watch


def wait_for(condition, seconds=60):
    end = time.monotonic() + seconds
    while not condition() and time.monotonic() < end:
        time.sleep(0.2)
    assert condition()


def test_one_sync_for_each_burst_of_changes_and_removals(spark, tmp_path):
    """No new file is ever made."""
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a.txt", "b.md", "c.txt", "d.docx"):
        (folder / name).write_text("x")
    runs = []
    w = watch.FolderWatch(spark, str(folder), runs.append, str(tmp_path / "events"))
    query = w.start(str(tmp_path / "cp"), 1)
    try:
        assert runs == ["start"]
        (folder / "a.txt").write_text("edited")
        (folder / "b.md").write_text("edited, too")
        wait_for(lambda: len(runs) == 2)
        assert runs[1] in ("modified:a.txt", "modified:b.md")
        (folder / "c.txt").unlink()
        wait_for(lambda: len(runs) == 3)
        assert runs[2] == "deleted:c.txt"
        (folder / "d.docx").write_text("no kind of file that counts")
        time.sleep(4)
        assert len(runs) == 3
    finally:
        query.stop()
    events = spark.read.parquet(str(tmp_path / "events"))
    assert sorted((r.kind, r.path.rsplit("/", 1)[1]) for r in events.collect()) == [("deleted", "c.txt"), ("modified", "a.txt"), ("modified", "b.md")]
    assert len(os.listdir(w.base.removeprefix("file:"))) <= 2  # a tick may have been cut off


def test_a_burst_that_goes_on_is_one_sync(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("x")
    runs = []
    w = watch.FolderWatch(spark, str(folder), runs.append)
    for i in range(3):
        (folder / "a.txt").write_text("x" * (i + 2))
        w.tick()
    (folder / "a.txt").rename(folder / "z.txt")
    w.tick()
    assert runs == ["start"]
    w.tick()
    w.tick()
    assert runs == ["start", "created:z.txt"]


def test_events_are_a_stream_of_bursts(spark, tmp_path):
    """What a watch writes, the burst stream reads."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("x")
    w = watch.FolderWatch(spark, str(folder), lambda reason: None, str(tmp_path / "events"))
    (folder / "a.txt").write_text("xy")
    w.tick()
    later = spark.read.parquet(str(tmp_path / "events")).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    later.write.mode("append").parquet(str(tmp_path / "events"))
    events = spark.readStream.schema(watch.EVENTS).parquet(str(tmp_path / "events"))
    query = watch.bursts_stream(events).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r.n, r.reason) for r in spark.sql("SELECT n, reason FROM bursts").collect()] == [(1, "modified")]


@pytest.mark.parametrize(("before", "after", "want"), [([], [], []), ([("a", 1)], [], [("deleted", "a")]), ([], [("a", 1)], [("created", "a")]), ([("a", 1), ("b", 1)], [("a", 2), ("b", 1)], [("modified", "a")])])
def test_listing_events(spark, before, after, want):
    frame = lambda rows: spark.createDataFrame(rows, "path string, length long").withColumn("modified", F.lit(None).cast("timestamp"))
    assert [tuple(r) for r in watch.listing_events(frame(before), frame(after)).collect()] == want
