import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from tesela.functions import models
from tesela.operators import embedcache
from tesela.sources.snapshots import SnapshotStore


def plain(keys, capacity):
    held, out = OrderedDict(), []
    for k in keys:
        out.append(k in held)
        held[k] = None
        held.move_to_end(k)
        if len(held) > capacity:
            held.popitem(last=False)
    return out, len(held)


@pytest.mark.parametrize(("capacity", "kinds", "n"), [(3, 5, 200), (8, 40, 500), (100, 20, 100), (1, 2, 30), (4, 3, 0)])
def test_replay_equals_one_pass(spark, capacity, kinds, n):
    rng = random.Random(capacity)
    keys = [rng.choice([None, *(f"k{int(rng.random() ** 2 * kinds)}" for _ in range(9))]) for _ in range(n)]
    df = spark.createDataFrame([(i // 7, i % 7, k) for i, k in enumerate(keys)], "a int, b int, k string").repartition(3)
    done = embedcache.replayed(df, "k", ["a", "b"], capacity)
    hits, size = plain(keys, capacity)
    assert [r.hit for r in done.orderBy("a", "b").collect()] == hits
    row = embedcache.bounded_stats(done, capacity).first()
    assert (row.hits, row.misses, row["size"], row.maxsize) == (sum(hits), n - sum(hits), size, capacity)
    assert row.hit_rate == (pytest.approx(sum(hits) / n, abs=1e-6) if n else 0.0)


def test_a_stored_cache_forgets_the_least_recently_used(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def counted(texts):
        calls.add(len(texts))
        return models.hashed_embedder(texts)

    cache = embedcache.EmbeddingCache(SnapshotStore(spark, str(tmp_path / "cache")), capacity=3)

    def ask(*texts, model="m"):
        before = calls.value
        df = spark.createDataFrame(list(enumerate(texts)), "at long, text string")
        rows = cache.embed(df, "text", ["at"], model, counted).orderBy("at").collect()
        assert [r.text for r in rows] == list(texts)
        assert [list(r.vector) for r in rows] == [pytest.approx(v) for v in models.hashed_embedder([t or "" for t in texts])]
        return calls.value - before

    assert ask("a", "b", "a", None) == 3
    assert ask("b") == 0
    assert ask("c") == 1  # a goes: b and the empty text were used later
    assert ask("b", "c", "") == 0
    assert ask("a") == 1
    assert ask("a", model="other") == 1
    assert cache.entries().count() == 3
    cache.clear()
    assert cache.entries().count() == 0 and ask("a") == 1


def test_more_texts_than_entries(spark, tmp_path):
    cache = embedcache.EmbeddingCache(SnapshotStore(spark, str(tmp_path / "cache")), capacity=4)
    df = spark.range(20).select("id", F.concat(F.lit("t"), "id").alias("text"))
    assert cache.embed(df, "text", ["id"], "m").count() == 20
    want = [F.sha2(F.lit(f"t{i}"), 256) for i in range(16, 20)]
    held = {r.text_sha256 for r in cache.entries().collect()}
    assert len(held) == 4 and held == {r[0] for r in spark.range(1).select(F.explode(F.array(*want))).collect()}
