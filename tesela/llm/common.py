"""What the operators of this subpackage share: the cluster's folder and NumPy views of Arrow texts."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesela.sources.stage import shared_dir

_U64 = np.uint64


def stash(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back: cuts the lineage, and outlives executors.

    made: a list that gets the path, for clear() once nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, made: list[str]) -> None:
    """Delete stashed tables."""
    for path in made:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    made.clear()


def release() -> None:
    """Give a worker's freed memory back to the machine: idle workers live on between stages and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def whole_row(df: DataFrame, without: list[str]) -> Column:
    """The columns of a frame but some as one struct, _row, so that no name of theirs meets a name used on the way."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in without]).alias("_row")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_ranges(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cut rows into consecutive ranges whose sizes sum to at most limit, but at least one row each."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    start = 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(total, total[start] + limit, "right")) - 1)
        yield start, end
        start = end


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class RangeHash:
    """64-bit polynomial hashes of any byte ranges of a buffer from prefix sums, for all ranges at once.

    The hash of bytes s..e is sum(code[b_i] * base**(i-s)) modulo 2**64, so equal ranges have equal hashes wherever they lie.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int):
        base = int(mixed(np.array([seed + 1], _U64))[0]) | 1
        self._pow, self._inv = self._tables(base, len(data) + 1)
        codes = mixed(np.arange(256, dtype=_U64) + _U64((seed + 7) * 1000003))
        self._sum = np.zeros(len(data) + 1, _U64)
        np.cumsum(codes[data] * self._pow[: len(data)], out=self._sum[1:])

    @classmethod
    def _tables(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(base)
        if have is None or len(have[0]) < n:
            size = 1 << max(16, (n - 1).bit_length())
            inverse = pow(base, -1, 1 << 64)
            have = tuple(np.concatenate((np.ones(1, _U64), np.cumprod(np.full(size - 1, b, _U64)))) for b in (base, inverse))
            if size <= 1 << 23:  # very long texts make their own
                cls._powers[base] = have
        return have

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sum[end] - self._sum[start]) * self._inv[start]

    def windows(self, width: int) -> np.ndarray:
        """The hash of every window of that width."""
        n = len(self._sum) - width
        return (self._sum[width:] - self._sum[:-width]) * self._inv[:n] if n > 0 else np.zeros(0, _U64)
