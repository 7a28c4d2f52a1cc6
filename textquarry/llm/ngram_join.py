"""Jaccard self-join of documents over word n-grams, by token-combination prefixes.

A document is its set of distinct k-word shingles.  Sets that are equal are one class from the
start.  Shingles are ordered by class, rare before frequent, then by hash; the class comes
from counts over all documents in a table of fixed size.  A document misses at most
n - ceil(t n) of its shingles in any partner, and the two differ in at most
d = (1 - t) / (1 + t) (n + n / t) shingles.  So linked documents share

* a rare shingle within the first n - ceil(t n) + 1 of each, or
* only frequent ones.  Their d' differences (d without the rare shingles) break at most 2 d' pairs of
  neighbours in the order, and shift others by at most d' places; so they share a
  pair of neighbours within the first 2 d' + 2 frequent shingles of each.

Rare shingles are indexed singly, frequent ones by pairs of neighbours in the extended prefix, so
the entries are linear in the set, however large it is.  (Sets of less than four shingles or so, where
the count of pairs proves nothing, index frequent shingles singly; the two forms overlap in size, so no
pair of documents falls between them.)  Blocks of candidates are thinned by a lower bound on the
symmetric difference and then verified on the whole texts.  Verified links are reduced to
a spanning forest inside each cell, and components are found by joins.

Null or empty texts have no shingles and link to nothing; equal non-empty sets link whatever
their ids.  A null id takes no part in the least id of its component.  Repeated rows stay rows.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._blocks import blocks, cells, dealt, in_runs
from ._common import Unions, bitmap, checkpoint, connected_components, gram_hashes, hash_words, in_bitmap, lean, mix, quoted, replayable, signed, text_chunks, unused, with_row_id

COUNT_BITS = 16
#: Slots of the smallest sketch; a set of n shingles has a power of two of at least n / 8 slots.
SKETCH = 64
CELL_SHINGLES = 1_000_000
CELL_SKETCHES = 2048


def shingle_sets(column: pa.Array, k: int):
    """(row, sorted distinct uint64) for every text of an Arrow column."""
    for first, end, data, offsets in text_chunks(column):
        w = hash_words(data, offsets, lower=True)
        grams = gram_hashes(w.hashes, k)
        for i in range(end - first):
            a, b = w.offsets[i], w.offsets[i + 1]
            if b - a >= k:
                s = np.sort(grams[a : b - k + 1])
                if len(s) > 1:
                    s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                s = gram_hashes(w.hashes[a:b], int(b - a)) + np.uint64(b - a)
            else:
                s = np.zeros(0, np.uint64)
            yield first + i, s


def frequent_table(docs: DataFrame, k: int, factor: int = 4, least: int = 1000) -> np.ndarray:
    """Which of the 2**COUNT_BITS slots hold frequent shingles: over ``least`` documents and ``factor`` times the mean."""

    def run(batches):
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        held, size = [], 0

        def add():
            nonlocal size
            if held:
                counts[:] += np.bincount(np.concatenate(held), minlength=len(counts))
            held.clear()
            size = 0

        for batch in batches:
            for _, s in shingle_sets(batch.column(0), k):
                held.append((s >> np.uint64(64 - COUNT_BITS)).astype(np.int64))
                size += len(s)
                if size > 200_000:
                    add()
        add()
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(counts[slots])], ["slot", "n"])

    counted = checkpoint(docs.select("text").mapInArrow(lean(run), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")))
    mean = counted.agg(F.sum("n")).first()[0] or 0
    bound = max(least, factor * mean >> COUNT_BITS)
    table = np.zeros(1 << COUNT_BITS, bool)
    for r in counted.where(F.col("n") > bound).select("slot").collect():  # at most 2**COUNT_BITS rows, in fact a share of them
        table[r["slot"]] = True
    return table


def index_keys(s: np.ndarray, frequent: np.ndarray, t: Fraction) -> np.ndarray:
    """Index keys of a sorted set; see the module's text."""
    n = len(s)
    miss = n - int(-(-t * n // 1))
    if miss <= 0 and (n + 1) * t > n:  # a partner could only be the same set; else one of n + 1 may hold all of this one
        return np.zeros(0, np.uint64)
    often = frequent[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
    rare = s[~often]
    keys = [mix(rare[: miss + 1] + np.uint64(1))]
    left = miss - len(rare)  # how many of the frequent ones may be missing
    if left >= 0:
        f = s[often]
        # two sets of at least ``least`` shingles share more than they differ, plus one
        least = -((1 + t) // -(2 * t - 1)) if 2 * t > 1 else n + 1
        if n >= least:
            differ = int((1 - t) / (1 + t) * (n + n / t // 1)) - len(rare)
            p = f[: 2 * max(0, differ) + 2]
            keys.append(mix(p[:-1] * np.uint64(0xA24BAED4963EE407) + mix(p[1:] + np.uint64(2))))
        if n * t < least:
            keys.append(mix(f[: left + 1] + np.uint64(3)))
    return np.concatenate(keys)


def sketch(s: np.ndarray) -> bytes:
    """Shingles per slot of the low bits, up to 255: the sum of differences of two sketches bounds the symmetric difference from below."""
    slots = max(SKETCH, 1 << max(0, (len(s) - 1) // 8).bit_length())
    return np.minimum(np.bincount((s & np.uint64(slots - 1)).astype(np.int64), minlength=slots), 255).astype(np.uint8).tobytes()


def _folded(sketches: list[bytes], slots: int) -> np.ndarray:
    """Sketches of that many slots or twice as many, as rows of that many."""
    out = np.empty((len(sketches), slots), np.int16)
    for row, x in enumerate(sketches):
        v = np.frombuffer(x, np.uint8)
        out[row] = v if len(v) == slots else np.minimum(v[:slots].astype(np.int16) + v[slots:], 255)  # still a count up to 255
    return out


def _entries(docs: DataFrame, k: int, frequent: np.ndarray, t: Fraction) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(frequent)
    id_type = docs.schema["id"].dataType

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            sizes, d1, d2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            sketches, keys = [b""] * n, [None] * n
            for i, s in shingle_sets(batch.column(2), k):
                sizes[i] = len(s)
                d1[i], d2[i] = np.add.reduce(mix(s ^ np.uint64(0x5555))), np.add.reduce(mix(s ^ np.uint64(0xAAAA0000)))
                sketches[i] = sketch(s)
                keys[i] = index_keys(s, held.value, t)
            flat = np.concatenate([x for x in keys if x is not None] or [np.zeros(0, np.uint64)])
            offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes), pa.array(signed(d1)), pa.array(signed(d2)), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(flat)))],
                ["rid", "id", "n", "d1", "d2", "sketch", "keys"],
            )

    long = T.LongType()
    schema = T.StructType([T.StructField("rid", long), T.StructField("id", id_type), *[T.StructField(c, long) for c in ("n", "d1", "d2")], T.StructField("sketch", T.BinaryType()), T.StructField("keys", T.ArrayType(long))])
    return docs.select("rid", "id", "text").mapInArrow(lean(run), schema)


def _grouped(t: Fraction, parted: bool, own: np.ndarray, member: np.ndarray, n: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, member, n) of the members of a cell that may link, by sizes and sketches.

    The groups are the components of possible links, named by their least member, so that the
    same documents found under many pivots come out as the same rows.
    """
    up, down = t.numerator, t.denominator
    order = np.argsort(n, kind="stable")
    own, member, n, sketches = own[order], member[order], n[order], sketches[order]
    ends = np.searchsorted(n * up, n * down, side="right")  # partners are at most n / t large
    found = Unions(len(n))
    if len(n) > 1 and (ends > np.arange(1, len(n) + 1)).any():
        slots = np.fromiter(map(len, sketches), np.int64, len(sketches))
        for level in np.unique(slots):
            mine = np.flatnonzero(slots == level)
            first, last = int(mine[0]), int(ends[mine[-1]])  # sizes ascend, and so do slots
            while slots[last - 1] > 2 * level:
                last -= 1
            rows = _folded(sketches[first:last].tolist(), int(level))
            for i in mine.tolist():
                hi = min(int(ends[i]), last)
                if hi <= i + 1:
                    continue
                near = np.abs(rows[i + 1 - first : hi - first] - rows[i - first]).sum(1, dtype=np.int64)
                ok = near * (up + down) <= (n[i] + n[i + 1 : hi]) * (down - up)
                if parted:
                    ok &= own[i + 1 : hi] != own[i]
                if ok.any():
                    for root in set(found.up[np.flatnonzero(ok) + i + 1].tolist()):
                        found.join(i, root)
    roots = np.array([found.find(i) for i in range(len(n))], np.int64)
    many = np.bincount(roots, minlength=len(n))[roots] > 1
    least = np.full(len(n), np.iinfo(np.int64).max)
    np.minimum.at(least, roots, member)
    return least[roots][many], member[many], n[many]


def _plausible(t: Fraction):
    """Over cells sorted by (pivot, part_a, part_b): the rows of ``_grouped``."""

    def run(batches):
        for groups in in_runs(batches, 3):
            out = [_grouped(t, bool(g[1][0] != g[2][0]), *g[3:]) for g in groups if len(g[0]) > 1]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["pivot", "member", "n"])

    return run


def _verified(k: int, t: Fraction):
    """Spanning edges of the links inside a cell, on the whole texts."""
    up, down = t.numerator, t.denominator

    def run(key, table):
        order = np.argsort(table.column("member").to_numpy(), kind="stable")
        table = table.take(order)
        nodes, own = table.column("member").to_numpy(), table.column("own").to_numpy()
        sets = [s for _, s in shingle_sets(table.column("text"), k)]
        n = np.array([len(s) for s in sets], np.int64)
        tokens = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        del sets, table
        starts = np.concatenate([[0], np.cumsum(n)])
        mark = np.zeros(int(tokens.max()) + 1 if len(tokens) else 1, np.int32)
        found = Unions(len(n))
        parted = key[1].as_py() != key[2].as_py()
        for i in range(len(n) - 1):
            if not n[i]:
                continue
            mine = tokens[starts[i] : starts[i + 1]]
            mark[mine] = 1
            rest = starts[i + 1]
            shared = np.add.reduceat(np.append(mark[tokens[rest:]], 0), starts[i + 1 : -1] - rest) if rest < starts[-1] else np.zeros(0, np.int64)
            mark[mine] = 0
            later = n[i + 1 :]
            shared = np.where(later > 0, shared, 0)
            linked = shared * down >= up * (n[i] + later - shared)
            if parted:
                linked &= own[i + 1 :] != own[i]
            for j in np.flatnonzero(linked & (later > 0)):
                found.join(i, i + 1 + int(j))
        roots = np.array([found.find(i) for i in range(len(n))], np.int64)
        moved = roots != np.arange(len(n))
        return pa.table({"u": nodes[moved], "v": nodes[roots[moved]]})

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, threshold: Fraction = Fraction(9, 10)) -> DataFrame:
    """One row per document: rid, id, n_shingles, class_id (least row of the documents with the same set), root (least row reachable, whatever the ids) and component_id (least id reachable)."""
    source = with_row_id(replayable(docs).select(quoted(id_col).alias("id"), quoted(text_col).alias("text")), "rid")
    entries = checkpoint(_entries(source, k, frequent_table(source, k), threshold))
    classes = checkpoint(entries.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("rid").alias("rep"), F.min("id").alias("least")))
    reps = entries.drop("n").join(classes.select(F.col("rep").alias("rid"), "n").hint("shuffle_hash"), "rid")
    found = checkpoint(blocks(reps.select(F.explode("keys").alias("key"), F.col("rid").alias("node"), F.col("n").cast("int").alias("priority")), threshold))
    # rows are cut into cells while they are narrow; sketches, and texts of likely members alone, move once
    weight = F.greatest(F.lit(CELL_SHINGLES // CELL_SKETCHES), F.col("n"))
    celled = cells(found.join(entries.select(F.col("rid").alias("member"), "n"), "member"), weight, CELL_SHINGLES)
    sketched = celled.join(entries.select(F.col("rid").alias("member"), "sketch").hint("shuffle_hash"), "member")
    sorted_cells = dealt(sketched.select("pivot", "part_a", "part_b", "own", "member", "n", "sketch")).sortWithinPartitions("pivot", "part_a", "part_b")
    likely = checkpoint(sorted_cells.mapInArrow(lean(_plausible(threshold)), "pivot long, member long, n long").distinct())
    likely = checkpoint(cells(likely, weight, CELL_SHINGLES))
    marks, bits = bitmap(likely.select(F.xxhash64("member").alias("hash")), "hash", likely.count())
    held = source.where(in_bitmap(F.xxhash64("rid"), marks, bits))
    texts = held.select(F.col("rid").alias("member"), "text").join(likely.hint("shuffle_hash"), "member")
    edges = dealt(texts).groupBy("pivot", "part_a", "part_b").applyInArrow(_verified(k, threshold), "u long, v long")
    roots = connected_components(edges)
    labelled = classes.select("d1", "d2", "n", "rep", "least").join(roots, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep"))
    labelled = checkpoint(labelled.select("d1", "d2", "n", "rep", "root", "least"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component"))
    named = labelled.join(least, "root").select("d1", "d2", "n", F.col("rep").alias("class_id"), "root", "component")
    joined = entries.select("rid", "id", "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left")
    return joined.select("rid", "id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "rid").alias("class_id"), F.coalesce("root", "rid").alias("root"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """``docs`` with one row of each component, that of the least id (ties: the first row); documents without words all stay."""
    docs = replayable(docs)
    found = jaccard_components(docs, id_col, text_col, k, threshold)
    # by root, as component_id is no key: unrelated rows may share an id, and null ids name nothing
    grouped = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("first"))
    first = grouped.select("first.rid").unionByName(found.where("n_shingles = 0").select("rid"))
    # most rows stay: those whose bit isn't set do so without a shuffle
    rid = unused(docs.columns, "__rid")
    gone = checkpoint(found.select("rid").join(first, "rid", "left_anti")).withColumnRenamed("rid", rid)
    marks, bits = bitmap(gone.select(F.xxhash64(rid).alias("hash")), "hash", gone.count())
    rows, marked = with_row_id(docs, rid), in_bitmap(F.xxhash64(rid), marks, bits)
    return rows.where(~marked).unionByName(rows.where(marked).join(gone.hint("shuffle_hash"), rid, "left_anti")).drop(rid)
