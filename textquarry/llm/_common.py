"""Pieces shared by the operators: checkpoints, row ids, vectorised word hashes, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.checkpoints import checkpoint

#: Bytes below which a side may be broadcast; callers measure first.
BROADCAST_BYTES = 64 << 20

#: Bytes of text hashed in one go by a Python worker; a longer text is one piece.
CHUNK_BYTES = 1 << 20

_M64 = (1 << 64) - 1
_R = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def quoted(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(columns: Iterable[str], base: str) -> str:
    """A name like ``base`` that no column has, whatever its case."""
    taken, name = {c.lower() for c in columns}, base
    while name.lower() in taken:
        name += "_"
    return name


#: Plan nodes that keep a row's partition and position from one run to the next.
_STEADY = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation", "LogicalRDD", "LocalRelation"}


def replayable(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a table or a checkpoint under filters and projections, else a checkpoint of it.

    Row ids are functions of partition and position, and a plan with a shuffle may place
    rows otherwise when it runs again.
    """
    plan = df._jdf.queryExecution().analyzed()
    nodes, steady = [plan], bool(plan.deterministic())
    while nodes and steady:
        node = nodes.pop()
        steady = node.nodeName() in _STEADY
        below = node.children()
        nodes += [below.apply(i) for i in range(below.size())]
    return df if steady else checkpoint(df)


def with_row_id(df: DataFrame, name: str = "__rid") -> DataFrame:
    """Adds a row id that keeps repeated and null keys apart; ``df`` has to be ``replayable``."""
    return df.withColumn(name, F.monotonically_increasing_id())


def skew_join(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, how: str = "inner", parts: int = 1000) -> DataFrame:
    """``rows`` joined to ``keyed``, one row per key with the number of ``rows`` it will meet in column ``count``.

    Keys that meet more than 1 / ``parts`` of all such rows, of which there can't be more than
    ``parts``, are broadcast, so that their rows stay where they are; the others are shuffled.
    ``keyed`` is read twice: give a checkpoint.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    bound = max(1, total // parts)
    values = [c for c in keyed.columns if c not in on]
    hot = keyed.where(F.col(count) > bound).select(*on, F.struct(*values).alias("__hot"))
    marked = rows.join(F.broadcast(hot), on, "left")
    # rows of hot keys are dealt anywhere: their own hash takes the place of the key
    here = F.when(F.col("__hot").isNull(), F.xxhash64(*on)).otherwise(F.xxhash64(*rows.columns, F.lit(1)))
    cold = keyed.where(F.col(count) <= bound).select(F.xxhash64(*on).alias("__at"), *[F.col(c).alias(f"__key{i}") for i, c in enumerate(on)], F.struct(*values).alias("__cold"))
    same = F.col("__hot").isNull() & (F.col("__here") == F.col("__at"))
    for i, c in enumerate(on):
        same &= F.col(c) == F.col(f"__key{i}")
    met = marked.withColumn("__here", here).join(cold, same, "left")
    met = met.select(*rows.columns, F.coalesce("__hot", "__cold").alias("__met"))
    if how == "inner":
        met = met.where("__met is not null")
    return met.select(*rows.columns, *[F.col("__met")[c].alias(c) for c in values])


def bitmap(values: DataFrame, column: str, n: int, most_bits: int = 1 << 25, each: int = 32) -> tuple[Column, int]:
    """A scalar subquery, array<bigint>, with a bit for each of about ``n`` distinct 64-bit values, and its number of bits.

    At most ``most_bits``, so that every task can hold it; with more values it lets more pass ``in_bitmap``.
    """
    bits = min(most_bits, 1 << max(12, (each * n).bit_length()))
    slots = values.select(F.pmod(column, F.lit(bits)).alias("slot"))
    longs = slots.groupBy(F.shiftright("slot", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("x"))
    every = values.sparkSession.range(bits // 64, numPartitions=1).join(longs, "id", "left")
    made = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("x", F.lit(0)).cast("bigint").alias("x")))), lambda r: r["x"]).alias("bits"))
    return made.scalar(), bits


def in_bitmap(value: Column, held: Column, bits: int) -> Column:
    """Whether the bit of the value is set; true for all values the bitmap was made of, and for few others."""
    slot = F.pmod(value, F.lit(bits))
    return F.call_function("getbit", F.get(held, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1


# --------------------------------------------------------------------------- workers

_kept: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """What a Python worker keeps from one task to the next, until a ``lean`` function of another name runs in it."""
    return _kept.setdefault(name, {})


def drop_caches(own: str | None = None) -> None:
    for name, held in _kept.items():
        if name != own:
            held.clear()


def give_back() -> None:
    """Returns freed memory to the system, where the C library can; it would keep it as long as the worker lives."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable, own: str | None = None) -> Callable:
    """``run``, a function over Arrow batches, that begins without the caches of others and leaves no freed memory behind.

    Workers outlive tasks and stages, and their memory is the executor's.
    """

    def lean_run(batches):
        drop_caches(own)
        try:
            yield from run(batches)
        finally:
            give_back()

    return lean_run


# --------------------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit values so that every bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per worker and grown on demand."""
    have = _powers.get((base, 0))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, np.uint64(base), dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[(base, 0)] = have
    return have[:n]


class Words:
    """Words of a run of texts: 64-bit hashes, byte spans and, per text, offsets into them."""

    __slots__ = ("data", "hashes", "starts", "ends", "offsets")

    def __init__(self, data, hashes, starts, ends, offsets):
        self.data, self.hashes, self.starts, self.ends, self.offsets = data, hashes, starts, ends, offsets


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offsets of the rows) of pieces of about ``limit`` bytes.

    A single longer text forms a piece of its own.  Null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Hashes the runs of bytes outside space and 09-0D, each text apart.

    ``lower`` lower-cases A-Z first.  UTF-8 continuation bytes are never ASCII, so the
    split on bytes is the split on characters.
    """
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(data, np.zeros(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64))
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    finishes = solid.copy()
    finishes[:-1] &= ~solid[1:] | edge[1:n]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(finishes) + 1
    word_offsets = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(data, np.zeros(0, np.uint64), starts, ends, word_offsets)
    lengths = ends - starts
    # position in the word, by a running count that restarts at each word
    pos = np.arange(n, dtype=np.int64)
    pos[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, n)))
    pos[~solid] = 0
    values = _TABLE[data]
    values *= powers(_R, int(lengths.max()))[np.minimum(pos, lengths.max() - 1)]
    values[~solid] = 0
    hashes = np.add.reduceat(values, starts) + lengths.astype(np.uint64)
    return Words(data, mix(hashes), starts, ends, word_offsets)


_GRAM = 0xD6E8FEB86659FD93


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by start; the last k-1 starts are absent.  Crossing texts is up to the caller."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = powers(_GRAM, k)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * p[j]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# --------------------------------------------------------------------------- components


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (u, v longs), root the least node reachable.

    Alternating large-star and small-star rounds: each is a grouped minimum and an
    equi-join, every round ends in a reliable checkpoint, and nothing but a count and a
    checksum reaches the driver.  Rounds go on until nothing changes; they are logarithmic
    in the longest path.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = checkpoint(e)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        e = checkpoint(small)
        now = e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.sum(F.expr("cast(xxhash64(v, u) % 1000003 as bigint)")).alias("s")).first()
        now = (now["n"], now["x"], now["s"])
        if now == before or not now[0]:
            break
        before = now
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


class Unions:
    """Union-find over 0..n-1 whose roots are the least members."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True


def hex_digest(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)
