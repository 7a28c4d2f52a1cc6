"""Candidate blocks for similarity joins: linear in the index entries, whatever a key's frequency.

Rows that share an index key are put under one pivot, the member of the least priority (a size:
small members have few keys, so blocks stay small), so a key of m members makes m - 1 (pivot, member) rows and not m squared.  Two rows that share
a key share that key's pivot, so comparing all rows under each pivot loses no pair.  A pivot
with many members is cut into parts, and each two parts form a cell of bounded weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpoint, skew_join


def blocks(entries: DataFrame, ratio: Fraction | None = None) -> DataFrame:
    """(pivot, member), distinct, of (key, node, priority) entries; pivots are members of their own blocks.

    The order by priority is the same under every key, so overlapping keys mostly share their pivot.
    ``ratio``: priorities are sizes, and partners' sizes differ by that ratio at most.  Where
    two sizes next to each other under a key are further apart, no pair lies across, and a new pivot begins.
    """
    by_key = Window.partitionBy("key").orderBy("priority", "node")
    led = entries.select("key", "node", "priority")
    if ratio is None:
        led = led.withColumn("pivot", F.first("node").over(by_key))
    else:
        before = F.lag("priority").over(by_key)
        begins = before.isNull() | (before.cast("bigint") * ratio.denominator < F.col("priority").cast("bigint") * ratio.numerator)
        led = led.withColumn("begins", F.when(begins, F.col("node"))).withColumn("pivot", F.last("begins", ignorenulls=True).over(by_key))
    pairs = led.where("pivot <> node").select("pivot", F.col("node").alias("member")).distinct()
    both = F.explode(F.array(F.struct("pivot", "member"), F.struct("pivot", F.col("pivot").alias("member")))).alias("x")
    return pairs.select(both).select("x.pivot", "x.member").distinct()


def dealt(cells: DataFrame) -> DataFrame:
    """Cells spread over more tasks than their bytes alone would ask for: comparing them is what takes time."""
    n = 4 * int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, "pivot", "part_a", "part_b")


def in_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list[np.ndarray]]]:
    """The groups of rows with equal first ``keys`` columns, as arrays per column; one list of groups per batch.

    Rows are sorted by those columns.  Small groups are many, so they are cut from whole batches.
    """
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        n = len(columns[0])
        if not n:
            continue
        new = np.zeros(n, bool)
        for c in columns[:keys]:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        held = [c[cuts[-1] :] for c in columns]
        yield [[c[a:b] for c in columns] for a, b in zip(cuts, cuts[1:])]
    if held is not None:
        yield [held]


def cells(members: DataFrame, weight: Column, limit: int) -> DataFrame:
    """Adds part_a <= part_b and own (the part of the row): a cell (pivot, part_a, part_b) weighs about 2 * limit at most.

    A block of p parts sends each row to p cells; blocks within the limit have one cell.
    """
    sizes = checkpoint(members.groupBy("pivot").agg(F.ceil(F.sum(weight) / F.lit(limit)).cast("int").alias("parts"), F.count("*").alias("n_members")))
    rows = skew_join(members, sizes, ["pivot"], "n_members")
    own = F.pmod(F.xxhash64("member", F.lit(23)), F.greatest("parts", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.greatest("parts", F.lit(1)) - 1))
    rows = rows.withColumn("own", own).withColumn("other", other)
    return rows.select("*", F.least("own", "other").alias("part_a"), F.greatest("own", "other").alias("part_b")).drop("other", "parts", "n_members")
