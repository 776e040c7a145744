"""Keeping a collection in step with its files by content hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.sources.snapshots import SnapshotStore, upsert, without_sources

MANIFEST = "source string, sha256 string"


def sync_state(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """(source, status, sha256): unchanged, new, modified or deleted; the hash is the current one, null for deleted."""
    old = manifest.select("source", F.col("sha256").alias("_old"))
    new = current.select("source", F.col("sha256").alias("_new"))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("modified")
    return old.join(new, "source", "full_outer").select("source", status.alias("status"), F.col("_new").alias("sha256"))


def has_changes(state: DataFrame) -> bool:
    return not state.filter(F.col("status") != "unchanged").isEmpty()


def applied(collection: DataFrame, state: DataFrame, chunks: DataFrame) -> DataFrame:
    """The collection without the chunks of deleted and modified sources and with those of new and modified ones."""
    gone = state.filter(F.col("status").isin("deleted", "modified"))
    come = state.filter(F.col("status").isin("new", "modified")).select("source")
    return upsert(without_sources(collection, gone), chunks.join(come, "source", "left_semi"))


def next_manifest(state: DataFrame, chunks: DataFrame) -> DataFrame:
    """The manifest after a sync: sources that gave no chunk stay out, so they are new again next time."""
    have = chunks.select("source").distinct()
    same = state.filter(F.col("status") == "unchanged").select("source", "sha256")
    come = state.filter(F.col("status").isin("new", "modified")).join(have, "source", "left_semi").select("source", "sha256")
    return same.unionByName(come)


def rebuilt_manifest(collection: DataFrame, current: DataFrame) -> DataFrame:
    """A manifest of the indexed sources with the hashes that their files have now."""
    return current.join(collection.select("source").distinct(), "source", "left_semi").select("source", "sha256")


def sync(collection: SnapshotStore, manifest: SnapshotStore, files: DataFrame, index: Callable[[DataFrame], DataFrame], schema: str) -> dict[str, int]:
    """Bring a collection in step with files (source, sha256, ...); index makes chunks of files.  Counts of what was done.

    A collection without a manifest gets one of its sources first.  The collection is replaced before the manifest, so a sync that
    broke off is repeated by the next one with the same result.  A collection laid out by source has only the buckets of what changed rewritten.
    """
    stored = collection.read(schema)
    if not manifest.exists() and collection.exists():
        manifest.write(rebuilt_manifest(stored, files))
    state = sync_state(manifest.read(MANIFEST), files.select("source", "sha256")).cache()
    counts = {r["status"]: r["count"] for r in state.groupBy("status").count().collect()}  # four rows at most
    out = {k: counts.get(k, 0) for k in ("unchanged", "new", "modified", "deleted")} | {"indexed_chunks": 0}
    if sum(out[k] for k in ("new", "modified", "deleted")):
        come = files.join(state.filter(F.col("status").isin("new", "modified")).select("source"), "source", "left_semi")
        chunks = index(come).cache()
        out["indexed_chunks"] = chunks.count()
        collection.replace(state.filter(F.col("status") != "unchanged").select("source"), chunks, schema)
        manifest.write(next_manifest(state, chunks))
        chunks.unpersist()
    state.unpersist()
    return out
