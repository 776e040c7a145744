"""A bounded cache of embeddings, least recently used first out.

Replaying requests needs no single task.  What a cache holds after a stretch of requests is its last distinct keys, by recency; and what it
holds after two stretches is the second's keys, then those of the first that the second doesn't have, cut at the capacity.  So stretches
are summarised on their own, summaries are combined by doubling, and each stretch is replayed from the state before it.
"""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.functions import models
from tesela.sources.snapshots import SnapshotStore
from tesela.sources.stage import staged

# Fixed value: entries that the cache keeps.
CAPACITY = 2048

STORED = "text_sha256 string, model string, vector array<float>, used long"


def _merged(newer: Column, older: Column, capacity: int) -> Column:
    return F.slice(F.concat(newer, F.array_except(older, newer)), 1, capacity)


def _replay(capacity: int):
    """Requests of one stretch in order, with the state before it: hit, and the entries held after the request."""

    def run(requests: pa.Table, state: pa.Table) -> pa.Table:
        held = OrderedDict((k, None) for k in reversed(state.column("keys")[0].as_py() if state.num_rows else []))
        order = pa.compute.sort_indices(requests.column("pos"))
        hits, sizes = [], []
        for key in requests.column("key").take(order).to_pylist():
            hits.append(key in held)
            held[key] = None
            held.move_to_end(key)
            if len(held) > capacity:
                held.popitem(last=False)
            sizes.append(len(held))
        return pa.table([requests.column("row").take(order), requests.column("pos").take(order), pa.array(hits, pa.bool_()), pa.array(sizes, pa.int32())], names=["row", "pos", "hit", "size"])

    return run


def replayed(requests: DataFrame, key: str, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """The rows of requests with hit boolean and size int, the entries held after the request; the cache starts empty.

    Requests are in the order of the given columns (rows that agree in all of them in any); a null key is a key.  Stretches are ranges of
    that order, as many as there are shuffle partitions; a task holds one stretch and the keys of a cache.
    """
    spark = requests.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = requests.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    named = F.coalesce(F.sha2(F.col(key).cast("string").cast("binary"), 256), F.lit(""))
    rows = staged(dealt.select(F.struct(*[F.col(f"`{c}`") for c in requests.columns]).alias("row"), named.alias("key"), F.spark_partition_id().alias("stretch"), F.monotonically_increasing_id().alias("pos")))
    last = rows.groupBy("stretch", "key").agg(F.max("pos").alias("pos"))
    recent = last.withColumn("_n", F.row_number().over(Window.partitionBy("stretch").orderBy(F.desc("pos")))).filter(F.col("_n") <= capacity)
    keys = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("pos")).alias("at"), "key"))), lambda x: x.key)
    # stretches without a request pass on what they get
    state = spark.range(parts).select(F.col("id").cast("int").alias("stretch")).join(recent.groupBy("stretch").agg(keys.alias("keys")), "stretch", "left")
    state = staged(state.select("stretch", F.coalesce("keys", F.array().cast("array<string>")).alias("keys")))
    step = 1
    while step < parts:  # after it, the last `step` stretches are summed up in each
        before = state.select((F.col("stretch") + step).alias("stretch"), F.col("keys").alias("_older"))
        state = staged(state.join(before, "stretch", "left").select("stretch", F.when(F.col("_older").isNull(), F.col("keys")).otherwise(_merged(F.col("keys"), F.col("_older"), capacity)).alias("keys")))
        step *= 2
    first = state.select((F.col("stretch") + 1).alias("stretch"), "keys")
    shape = rows.select("row", "pos", F.lit(True).alias("hit"), F.lit(0).alias("size")).schema
    out = rows.groupBy("stretch").cogroup(first.groupBy("stretch")).applyInArrow(_replay(capacity), shape)
    return out.select("row.*", "hit", "size", "pos")


def bounded_stats(done: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row of replayed(): hits, misses, size at the end, maxsize and hit_rate (0 if unused)."""
    n, hits = F.count(F.lit(1)), F.count_if("hit")
    return done.agg(
        hits.alias("hits"), (n - hits).alias("misses"), F.coalesce(F.max_by("size", "pos"), F.lit(0)).cast("long").alias("size"), F.lit(capacity).cast("long").alias("maxsize"),
        F.when(n > 0, F.round(hits / F.nullif(n, F.lit(0)), 6)).otherwise(0.0).alias("hit_rate"),
    )


class EmbeddingCache:
    """A stored cache of embeddings by text and model.  A batch's texts that it holds reach no model; after the batch, the entries used last
    stay, up to the capacity, whatever model they are of."""

    def __init__(self, store: SnapshotStore, capacity: int = CAPACITY):
        self.store, self.capacity = store, capacity

    def entries(self) -> DataFrame:
        return self.store.read(STORED)

    def clear(self) -> None:
        """Empty it, as when the model changes."""
        self.store.reset(STORED)

    def embed(self, df: DataFrame, text: str, order: list[str], model: str, embedder: models.Embedder = models.hashed_embedder) -> DataFrame:
        """df with vector array<float>.  A text counts as used by its last row in the order of the given columns."""
        held = self.entries()
        keyed = df.withColumn("_key", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
        known = held.filter(F.col("model") == model).select(F.col("text_sha256").alias("_key"), F.col("vector").alias("_known"))
        asked = keyed.groupBy("_key").agg(F.any_value(F.coalesce(F.col(text), F.lit(""))).alias("_text"), F.max(F.struct(*order)).alias("_last")).join(known, "_key", "left")
        fresh = models.embed_distinct(asked.filter(F.col("_known").isNull()).drop("_known"), "_text", model, embedder)
        both = staged(fresh.select("_key", "_last", "vector").unionByName(asked.filter(F.col("_known").isNotNull()).select("_key", "_last", F.col("_known").alias("vector"))))
        # of a batch, no more than the capacity can stay
        kept = both.orderBy(F.desc("_last"), "_key").limit(self.capacity)
        newest = held.agg(F.coalesce(F.max("used"), F.lit(0)).alias("_newest"))
        numbered = kept.withColumn("_back", F.row_number().over(Window.orderBy(F.desc("_last"), "_key"))).crossJoin(F.broadcast(newest))
        used = numbered.select(F.col("_key").alias("text_sha256"), F.lit(model).alias("model"), "vector", (F.col("_newest") + self.capacity + 1 - F.col("_back")).cast("long").alias("used"))
        self.store.write(used.unionByName(held.join(used.select("text_sha256", "model"), ["text_sha256", "model"], "left_anti")).orderBy(F.desc("used")).limit(self.capacity))
        return keyed.join(both.select("_key", "vector"), "_key").drop("_key")
