"""Blocks of a corpus beside blocks of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of questions that go to all workers.
BROADCAST = 32 << 20


def beside(blocks: DataFrame, key: str, packed: DataFrame, q_key: str, weight: int) -> DataFrame:
    """Each row of blocks beside each row of packed, a stated set of questions that weigh so many bytes.

    Up to BROADCAST bytes go to all workers.  More of them, as lines of that size, and the blocks, as cells, meet by the pair of both: a
    line is sent once a cell, and a cell once a line.
    """
    parts = max(1, int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lines = -(-weight // BROADCAST)
    if lines <= 1:
        return blocks.crossJoin(F.broadcast(packed))
    dealt = blocks.withColumn("_cell", F.pmod(F.xxhash64(key), F.lit(parts))).withColumn("_line", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))))
    asked = packed.withColumn("_line", F.pmod(F.xxhash64(q_key), F.lit(lines))).withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(asked, ["_cell", "_line"]).drop("_cell", "_line")
