import datetime as dt
import os
import warnings

import pytest
from pyspark.sql import functions as F

from tesela.sources import snapshots
from tesela.sources.logstore import LogStore, dense_ids
from tesela.sources.snapshots import SnapshotStore, SourceStore


def files(folder):
    return {os.path.join(d, n) for d, _, names in os.walk(folder) for n in names if n.endswith((".parquet", ".json"))}


def day(n, hour=12):
    return dt.datetime(2026, 1, n, hour)


def rows(spark, *said):
    return spark.createDataFrame(list(said), "ts timestamp, question string, latency_ms long")


def test_an_append_writes_only_its_rows(spark, tmp_path):
    log = LogStore(spark, str(tmp_path / "log"))
    assert log.read().count() == 0 and log.purge(F.current_timestamp()) == 0
    assert log.append(rows(spark, (day(2), "q", 5), (day(1), "p", 6), (day(1), "a", 7))) == 3
    before = files(tmp_path)
    stamps = {f: os.stat(f).st_mtime_ns for f in before}
    assert log.append(rows(spark, (day(1, 1), "z", 1))) == 4
    assert before <= files(tmp_path) and all(os.stat(f).st_mtime_ns == t for f, t in stamps.items())
    got = [(r.id, r.question, r.warnings, r.sources) for r in log.read().orderBy("id").collect()]
    assert got == [(1, "a", [], None), (2, "p", [], None), (3, "q", [], None), (4, "z", [], None)]


def test_an_append_that_broke_off_is_not_seen(spark, tmp_path):
    log = LogStore(spark, str(tmp_path / "log"))
    log.append(rows(spark, (day(1), "a", 1)))
    add, log.pointer.add = log.pointer.add, None
    with pytest.raises(TypeError):
        log.append(rows(spark, (day(1), "lost", 1)))
    log.pointer.add = add
    log.append(rows(spark, (day(2), "b", 1)))
    assert [(r.id, r.question) for r in log.read().orderBy("id").collect()] == [(1, "a"), (2, "b")]


def test_retention_drops_dates_and_keeps_the_cutoff_itself(spark, tmp_path):
    log = LogStore(spark, str(tmp_path / "log"))
    log.append(rows(spark, (day(1), "a", 1), (day(3, 11), "b", 1), (day(3, 12), "c", 1), (day(4), "d", 1)))
    stamps = {f: os.stat(f).st_mtime_ns for f in files(tmp_path)}
    at = F.lit(day(3, 12)).cast("timestamp")
    assert log.purge(at) == 2 and log.purge(at) == 0
    assert [r.question for r in log.read().orderBy("id").collect()] == ["c", "d"]
    left = files(tmp_path)
    assert not any("date=2026-01-01" in f for f in left) and all(os.stat(f).st_mtime_ns == t for f, t in stamps.items() if f in left)
    assert log.append(rows(spark, (day(5), "e", 1))) == 5
    assert log.purge(F.lit(day(9)).cast("timestamp")) == 3 and log.read().count() == 0
    assert log.append(rows(spark, (day(10), "f", 1))) == 6  # ids are never given twice


def test_dense_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    numbered, last = dense_ids(df, ["x"], 5)
    assert last == 1005 and numbered.filter("id <> x + 6").count() == 0 and numbered.count() == 1000
    assert dense_ids(df.limit(0), ["x"], 5)[1] == 5


def test_a_broken_pointer_leaves_the_last_good_version(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.write(spark.range(1))
    store.write(spark.range(2))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert store.read().count() == 2
    (tmp_path / "s" / "pointer" / "torn.json").write_text('{"seq": 9, "version": "ab')
    with pytest.warns(UserWarning, match="can't be read"):
        assert store.read().count() == 2
    (tmp_path / "s" / "pointer" / "gone.json").write_text('{"seq": 10, "version": "nowhere"}\n')
    with pytest.warns(UserWarning, match="nowhere is gone"):
        assert store.read().count() == 2
    with pytest.warns(UserWarning):
        store.write(spark.range(3))
        assert store.read().count() == 3


def test_a_manifest_of_broken_lines_is_an_empty_one(spark, tmp_path):
    (tmp_path / "m" / "pointer").mkdir(parents=True)
    (tmp_path / "m" / "pointer" / "x.json").write_text("not json\n")
    store = SnapshotStore(spark, str(tmp_path / "m"))
    with pytest.warns(UserWarning):
        assert not store.exists() and store.read("source string, sha256 string").count() == 0
    assert not SnapshotStore(spark, str(tmp_path / "none")).exists()


def test_old_logs_get_warnings(spark):
    old = spark.createDataFrame([(1, "q")], "id long, question string")
    assert [r.warnings for r in snapshots.with_warnings_column(old).collect()] == [[]]


def chunks(spark, *sources, text="x"):
    return spark.createDataFrame([(f"{s}::p1::c{i}", s, text) for s in sources for i in range(3)], "chunk_id string, source string, text string")


def test_a_sync_of_few_sources_touches_few_files(spark, tmp_path):
    store = SourceStore(spark, str(tmp_path / "c"), buckets=8)
    names = [f"d{i}.txt" for i in range(40)]
    store.write(chunks(spark, *names))
    assert store.read().count() == 120 and len(store.read().inputFiles()) == 8
    one = store.read_sources(["d7.txt"])
    assert len(one.inputFiles()) == 1 and one.count() == 3 and {r.source for r in one.collect()} == {"d7.txt"}
    before = files(tmp_path / "c" / "data")
    store.replace(spark.createDataFrame([("d7.txt",), ("d8.txt",)], "source string"), chunks(spark, "d7.txt", "new.md", text="y"))
    made = files(tmp_path / "c" / "data") - before
    assert 1 <= len(made) <= 3 and before <= files(tmp_path / "c" / "data")
    now = {}
    for r in store.read().collect():
        now.setdefault(r.source, []).append(r.text)
    assert now == {n: ["x"] * 3 for n in names if n not in ("d7.txt", "d8.txt")} | {"d7.txt": ["y"] * 3, "new.md": ["y"] * 3}
    assert store.read_sources(["d8.txt"]).count() == 0 == store.read_sources(["nobody"]).count()


def test_a_collection_by_source_may_be_empty(spark, tmp_path):
    shape = "chunk_id string, source string, text string"
    store = SourceStore(spark, str(tmp_path / "c"))
    assert not store.exists() and store.read(shape).count() == 0 == store.read_sources(["a"], shape).count()
    with pytest.raises(FileNotFoundError):
        store.read()
    store.replace(chunks(spark).select("source"), chunks(spark, "a"), shape)
    assert store.read().count() == 3
    store.replace(chunks(spark, "a").select("source"), chunks(spark), shape)
    assert store.exists() and store.read(shape).count() == 0


def test_both_stores_replace_alike(spark, tmp_path):
    got = []
    for store in (SnapshotStore(spark, str(tmp_path / "a")), SourceStore(spark, str(tmp_path / "b"), 4)):
        store.write(chunks(spark, "a", "b", "c"))
        store.replace(spark.createDataFrame([("a",), ("c",)], "source string"), chunks(spark, "c", "d", text="z"))
        got.append(sorted(map(tuple, store.read().select("chunk_id", "source", "text").collect())))
    assert got[0] == got[1] and len(got[0]) == 9
