"""Line dedup by edit distance: a segment-partition join.

A line of L characters is cut into ``edits`` + 1 segments; a line within that many edits still
holds one of them, shifted by a bounded number of places.  Each line is indexed by its segments and
probes, for every length it may match, the substrings that can stand for a segment of
that length.  Lines that share an entry are candidates; they are verified with a banded
bit-parallel edit distance after cheap bounds.  Copies of a line are one line from the start, and
lines join into classes by chains of matches.

Lines shorter than ``least`` characters match longer ones within the edits, and each other only
if they are equal.  Lines without a word, null texts and empty texts take no part.  The first
occurrence of a class, by id (nulls last), row and line number, stays; the others are removed.
Lines are told apart by a 64-bit hash.  Repeated rows are occurrences like any other.  Extra columns
may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import blocks, cells, dealt, in_runs
from ._common import Unions, bitmap, checkpoint, connected_components, in_bitmap, lean, mix, powers, quoted, replayable, signed, skew_join, unused, with_row_id

LEAST = 20
EDITS = 2
CELL_CHARACTERS = 2_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BAG = 32


def edit_distance_within(a: str, b: str, limit: int) -> int:
    """The edit distance of a and b if it is at most ``limit``, else ``limit`` + 1.

    The common ends are cut first.  What is left is aligned inside a band of 2 limit + 1
    diagonals whose column is kept as two bit vectors of differences (+1 and -1 down the band).
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > limit:
        return limit + 1
    lo, n = 0, len(a)
    while lo < n and a[lo] == b[lo]:
        lo += 1
    cut = 0
    while cut < n - lo and a[n - 1 - cut] == b[len(b) - 1 - cut]:
        cut += 1
    a, b = a[lo : n - cut], b[lo : len(b) - cut]
    if not a:
        return len(b) if len(b) <= limit else limit + 1
    # b runs down the band and a across; bit k of column j (from 0) is row j + limit - width + 1 + k of b.
    most, limit = limit, min(limit, len(b))
    width = 2 * limit + 2
    band, top = (1 << width) - 1, 1 << (width - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus, score = band & ~((1 << (width - 1 - limit)) - 1), 0, limit
    shift, turn, probe = limit + 1 - width, len(b) - limit, top
    for j, c in enumerate(a):
        eq = where.get(c, 0)
        eq = (eq >> shift if shift >= 0 else eq << -shift) & band
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & band
        across_plus = (minus | ~(d0 | plus)) & band
        across_minus = d0 & plus
        if j < turn:  # follow the lowest diagonal down to b's last row
            score += not d0 & top
            if score > 2 * limit + most:
                return most + 1
        else:  # then along that row
            probe >>= 1
            score += bool(across_plus & probe) - bool(across_minus & probe)
        down = d0 >> 1
        plus, minus = (across_minus | ~(down | across_plus)) & band, down & across_plus
        shift += 1
    return score if score <= most else most + 1


# ------------------------------------------------------------------------ index entries


def _hashes_of(prefix: np.ndarray, inverse: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (prefix[start + length] - prefix[start]) * inverse[start]


def index_entries(texts: list[str], edits: int = EDITS) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of every entry: the segments of each line, and what it probes for."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    values = mix(codes + np.uint64(1)) * powers(_BASE, len(codes) + 1)[: len(codes)]
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    inverse = powers(_INVERSE, len(codes) + 1)
    lines, keys = [], []
    every = np.arange(len(texts))
    parts = edits + 1

    def add(which, target, segment, start, length):
        h = _hashes_of(prefix, inverse, begin[which] + start, length)
        lines.append(which)
        keys.append(mix(h + mix(target.astype(np.uint64) * np.uint64(parts) + np.uint64(segment + 1))))

    for behind in range(parts):  # the length of the indexed line is that much less
        which = every[sizes - behind >= parts]
        target = sizes[which] - behind
        short, extra = target // parts, target % parts  # the last ``extra`` segments are one longer
        for i in range(parts):
            length = short + (i >= parts - extra)
            start = i * short + np.maximum(0, i - (parts - extra))
            for move in range(-edits, edits + 1):
                if behind == 0 and move == 0:
                    add(which, target, i, start, length)
                    continue
                if abs(move) > i or abs(move - behind) > edits - i:
                    continue
                at = start + move
                ok = (at >= 0) & (at + length <= sizes[which])
                add(which[ok], target[ok], i, at[ok], length[ok])
    return np.concatenate(lines), np.concatenate(keys)


def _entries(lines: DataFrame, edits: int) -> DataFrame:
    """(key, node) of every line (node, line); a line is indexed once per Arrow batch that holds it."""

    def run(batches):
        for batch in batches:
            nodes, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            texts = batch.column(1).take(pa.array(first)).to_pylist()
            at = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size > 500_000 or i == len(texts) - 1:
                    which, keys = index_entries(texts[at : i + 1], edits)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(nodes[at : i + 1][which])], ["key", "node"])
                    at, size = i + 1, 0

    return lines.select("node", "line").mapInArrow(lean(run), "key long, node long")


# ------------------------------------------------------------------------- verification


def _bags(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), _BAG), np.int32)
    for i, t in enumerate(texts):
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[i] = np.bincount(c % _BAG, minlength=_BAG)
    return out


def _links(edits: int, least: int, parted: bool, own: np.ndarray, nodes: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): spanning edges of the matches inside a cell; one line of each has at least ``least`` characters."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    order = np.lexsort([nodes, size])
    nodes, own, size, texts = nodes[order], own[order], size[order], lines[order].tolist()
    ends = np.searchsorted(size, size + edits, side="right")
    found = Unions(len(nodes))
    if (ends > np.arange(1, len(nodes) + 1)).any():
        bags = _bags(texts)
        for i in range(len(nodes)):
            hi = int(ends[i])
            if hi <= i + 1:
                continue
            ok = (np.abs(bags[i + 1 : hi] - bags[i]).sum(1) <= 2 * edits) & (size[i + 1 : hi] >= least)
            if parted:
                ok &= own[i + 1 : hi] != own[i]
            for j in (np.flatnonzero(ok) + i + 1).tolist():
                if found.find(i) != found.find(j) and edit_distance_within(texts[i], texts[j], edits) <= edits:
                    found.join(i, j)
    roots = np.array([found.find(i) for i in range(len(nodes))])
    moved = roots != np.arange(len(nodes))
    return nodes[moved], nodes[roots[moved]]


def _verified(edits: int, least: int):
    """Over cells sorted by (pivot, part_a, part_b): the rows of ``_links``."""

    def run(batches):
        for groups in in_runs(batches, 3):
            out = [_links(edits, least, bool(g[1][0] != g[2][0]), *g[3:]) for g in groups if len(g[0]) > 1]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["u", "v"])

    return run


# ----------------------------------------------------------------------------- operator


def _occurrences(source: DataFrame, least: int = 1) -> DataFrame:
    """Every line with a word and at least that many characters, wherever it occurs."""
    lines = source.select("rid", "id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(r"[^ \t-\r]") & (F.length("line") >= least)).select("rid", "id", "line_no", F.xxhash64("line").alias("node"), "line")


def line_classes(source: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(node, root) of the lines that match another, different line; source: rid, id, text."""
    lines = _occurrences(source, max(min(least, 1), least - edits)).select("node", "line")
    found = checkpoint(blocks(_entries(lines, edits).withColumn("priority", F.lit(0))))
    # most lines have no candidate and need not move; the bitmap only thins them, the join decides
    members = found.select("member").distinct()
    held, bits = bitmap(members, "member", members.count())
    # copies of a line meet in the task that reads them, so a common one is a row per task
    texts = lines.where(in_bitmap(F.col("node"), held, bits)).groupBy(F.col("node").alias("member")).agg(F.first("line").alias("line")).join(found.hint("shuffle_hash"), "member")
    celled = cells(texts, F.length("line"), CELL_CHARACTERS)
    in_order = dealt(celled.select("pivot", "part_a", "part_b", "own", "member", "line")).sortWithinPartitions("pivot", "part_a", "part_b")
    edges = in_order.mapInArrow(lean(_verified(edits, least)), "u long, v long")
    return connected_components(edges)


def removed_lines(source: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(rid, gone): sorted numbers of the lines of a text that are not the first of their class."""
    roots = line_classes(source, edits, least)
    lines = _occurrences(source).select("rid", "id", "line_no", "node")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "rid", "line_no")
    nodes = lines.groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(roots.hint("shuffle_hash"), "node", "left")
    nodes = checkpoint(nodes.where("n > 1 or root is not null"))
    classes = nodes.where("root is not null").groupBy("root").agg(F.min("first").alias("stays"))
    of_class = nodes.where("root is not null").join(classes, "root").select("node", "n", "stays.rid", "stays.line_no")
    alone = nodes.where("root is null").select("node", "n", "first.rid", "first.line_no")
    stays = checkpoint(of_class.unionByName(alone).withColumnsRenamed({"rid": "stays_in", "line_no": "stays_at"}))
    held, bits = bitmap(stays, "node", stays.count())
    gone = skew_join(lines.drop("id").where(in_bitmap(F.col("node"), held, bits)), stays, ["node"], "n").where("stays_in <> rid or stays_at <> line_no")
    return gone.groupBy("rid").agg(F.sort_array(F.collect_list("line_no")).alias("gone"))


def _with_left(df: DataFrame, text: str, gone: str, lines: str, left: str) -> DataFrame:
    """Adds the column ``left``, the text without the lines of the numbers ``gone``; linear in the text."""
    df = df.withColumn(lines, F.when(F.col(gone).isNotNull(), F.split(quoted(text), "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return df.withColumn(left, F.when(F.col(gone).isNull(), quoted(text)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")))


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the later lines of each class taken out of the texts; all columns stay.

    ``drop_emptied`` drops rows that lost lines and have no word left; else all rows stay.
    """
    rid, gone, lines, left = (unused(docs.columns, f"__{x}") for x in ("rid", "gone", "lines", "left"))
    rows = with_row_id(replayable(docs), rid)
    found = removed_lines(rows.select(F.col(rid).alias("rid"), quoted(id_col).alias("id"), quoted(text_col).alias("text")), edits, least)
    whole = rows.join(found.select(F.col("rid").alias(rid), F.col("gone").alias(gone)).hint("shuffle_hash"), rid, "left")
    whole = _with_left(whole, text_col, gone, lines, left)
    if drop_emptied:
        whole = whole.where(F.col(gone).isNull() | F.col(left).rlike(r"[^ \t-\r]"))
    return whole.select(*[F.col(left).alias(c) if c == text_col else quoted(c) for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """One row per document: id, n_lines, removed (numbers of the lines taken out) and left, the text that stays."""
    source = with_row_id(replayable(docs).select(quoted(id_col).alias("id"), quoted(text_col).alias("text")), "rid")
    whole = source.join(removed_lines(source, edits, least).hint("shuffle_hash"), "rid", "left")
    whole = _with_left(whole, "text", "gone", "lines", "left")
    return whole.select(
        F.col("id").alias(id_col), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).alias("n_lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("removed"), "left"
    )
