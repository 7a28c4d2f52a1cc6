"""Substring dedup: FM-indexes of word sequences, one per shard, over wavelet matrices.

Every window of ``window`` words is filed under its anchor, the least hash of the ``gram``-word
runs inside it; equal windows have equal anchors, so a shard that holds all windows of
an anchor decides about them alone.  Anchors that occur once can't belong to a repeated
window and are dropped before any text moves.  For the others, the runs of windows that
share an anchor (segments) are grouped, equal segments counted once with their multiplicity, and
each shard builds the Burrows-Wheeler transform of its segments in a wavelet matrix with two-level ranks;
the segments' words and multiplicities are not kept beside it, but for a sorted list of the suffixes that count twice.
The documents' segments are streamed through backward search in batches, which yields the longest suffix that
occurs twice or more; where that stops short of the segment's start, its other windows are searched
one by one.  Anchors of very many segments are split: their windows are filed singly, under the
hash of the whole window, so no shard has to hold one anchor's segments.

A window counts as repeated if its words start anywhere else too, in the same text or another.
Words are told apart by a 64-bit hash within a shard.

Words covered by a repeated window are removed, judged on the input.  Null and empty texts
have no words.  Repeated rows are occurrences like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bitmap, checkpoint, gram_hashes, hash_words, in_bitmap, mix, powers, quoted, replayable, signed, skew_join, text_chunks, with_row_id

GRAM = 8
#: Words a shard's index should hold, and occurrences from which an anchor's windows are filed singly.
SHARD_WORDS = 500_000
HOT_ANCHOR = 50_000
#: Words of 64 bits per block of ranks, as a power of two, and segments streamed at a time.
BLOCK_BITS = 3
STREAMED = 1 << 15
MASKS = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


# ----------------------------------------------------------------------------- index


class WaveletMatrix:
    """Bits of a sequence by level, with ranks; maps prefixes of the sequence symbol by symbol."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        n = len(sequence)
        self.words, self.ranks, self.steps, self.zeros = [], [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (sequence >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.append(packed, np.zeros(-len(packed) % 8 + 8, np.uint8)).view(np.uint64)
            before = np.zeros(len(packed), np.int64)
            np.cumsum(np.bitwise_count(packed[:-1]), out=before[1:])
            base = before[:: 1 << BLOCK_BITS]
            self.words.append(packed)
            self.ranks.append(base.astype(np.uint32))  # ones before each block, and in a block before each word
            self.steps.append((before - np.repeat(base, 1 << BLOCK_BITS)[: len(packed)]).astype(np.uint16))
            self.zeros.append(n - int(bit.sum()))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefixes of length ``at`` end among the positions of ``symbols``, in the last level's order."""
        for k, (words, ranks, steps, zeros) in enumerate(zip(self.words, self.ranks, self.steps, self.zeros)):
            word = at >> 6
            ones = ranks[word >> BLOCK_BITS].astype(np.int64) + steps[word] + np.bitwise_count(words[word] & MASKS[at & 63])
            at = np.where(symbols >> (self.levels - 1 - k) & 1, zeros + ones, at - ones)
        return at


def suffix_order(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Suffix array by doubling.  Separators have symbols of their own, so ``longest`` symbols decide."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    step = 1
    while True:
        key = rank * np.int64(n + 1 if step > 1 else int(symbols.max()) + 2)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
        step *= 2
        if step > longest or rank[order[-1]] == n - 1:
            return order


class FMIndex:
    """Counts occurrences, with multiplicities, of word sequences in a set of segments."""

    def __init__(self, numbers: np.ndarray, sizes: np.ndarray, counts: np.ndarray):
        """numbers: the segments' words one after the other, as numbers from 0; sizes: words per segment."""
        words = numbers.astype(np.int32) + 1  # 0 separates
        self.sigma = int(words.max()) + 1
        starts = np.cumsum(sizes + 1) - sizes - 1
        n = int(sizes.sum()) + len(sizes)
        text = np.zeros(n, np.int32)
        inside = np.ones(n, bool)
        inside[starts + sizes] = False
        text[inside] = words
        distinct = np.where(inside, text + len(sizes), 0)
        distinct[~inside] = np.arange(len(sizes))
        order = suffix_order(distinct, int(sizes.max()) + 1)
        self.matrix = WaveletMatrix(text[order - 1], self.sigma)
        every = np.arange(self.sigma)
        first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])[:-1]
        self.shift = first - self.matrix.descend(every, np.zeros(self.sigma, np.int64))
        # twice or more is all that is asked, so a multiplicity above two counts as two
        self.twice = np.flatnonzero(np.repeat(counts > 1, sizes + 1)[order]).astype(np.int32)
        self.n = n

    def occurrences(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of the suffixes from lo to hi, those of a segment that occurs more than once counted twice."""
        return hi - lo + np.searchsorted(self.twice, hi) - np.searchsorted(self.twice, lo)

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.matrix.descend(np.concatenate([symbols, symbols]), np.concatenate([lo, hi]))
        shift = self.shift[symbols]
        return both[: len(lo)] + shift, both[len(lo) :] + shift

    def matched(self, streamed: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each run of ``lengths`` words of ``streamed`` before ``ends``: how many of its last words occur twice in all."""
        out = np.zeros(len(ends), np.int64)
        live = np.flatnonzero(lengths > 0)
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n)
        step = 0
        while len(live):
            lo, hi = self.extend(streamed[ends[live] - 1 - step].astype(np.int64) + 1, lo, hi)
            ok = self.occurrences(lo, hi) >= 2
            step += 1
            out[live[ok]] = step
            ok &= lengths[live] > step
            live, lo, hi = live[ok], lo[ok], hi[ok]
        return out


def repeated_spans(numbers: np.ndarray, sizes: np.ndarray, counts: np.ndarray, window: int) -> list[list[int]]:
    """Per segment, the merged word spans [a0, b0, a1, b1, ...] covered by windows that occur twice or more."""
    index = FMIndex(numbers, sizes, counts)
    stops = np.cumsum(sizes)
    return [x for lo in range(0, len(sizes), STREAMED) for x in _streamed_spans(index, numbers, stops[lo : lo + STREAMED], sizes[lo : lo + STREAMED], window)]


def _streamed_spans(index: FMIndex, numbers: np.ndarray, ends: np.ndarray, sizes: np.ndarray, window: int) -> list[list[int]]:
    suffix = index.matched(numbers, ends, sizes)
    full = suffix == sizes
    out: list[list[int]] = [[0, int(n)] if f else [] for n, f in zip(sizes, full)]
    part = np.flatnonzero(~full)
    if not len(part):
        return out
    n_windows = sizes[part] - window + 1
    owner = np.repeat(part, n_windows)
    start = np.arange(int(n_windows.sum())) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    known = start >= sizes[owner] - suffix[owner]  # inside the suffix that repeats
    ask = np.flatnonzero(~known)
    good = known.copy()
    good[ask] = index.matched(numbers, (ends - sizes)[owner[ask]] + start[ask] + window, np.full(len(ask), window)) == window
    for i, a in zip(owner[good].tolist(), start[good].tolist()):
        spans = out[i]
        if spans and a <= spans[-1]:
            spans[-1] = a + window
        else:
            spans += [a, a + window]
    return out


# ----------------------------------------------------------------------------- anchors


def anchors(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For one text: the hashes of its grams, and for each window the position of its anchor."""
    g = gram_hashes(hashes, gram)
    if len(hashes) < window:
        return g, np.zeros(0, np.int64)
    reach = window - gram + 1
    view = np.lib.stride_tricks.sliding_window_view(g, reach)
    where = np.empty(len(view), np.int64)
    for lo in range(0, len(view), 100_000):
        where[lo : lo + 100_000] = view[lo : lo + 100_000].argmin(axis=1)
    return g, where + np.arange(len(view))


def _anchor_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, rids): the texts of an Arrow batch that have the anchor, with repeats; a common anchor is one row per batch."""

    def run(batches):
        for batch in batches:
            rids = batch.column(0).to_numpy()
            rows, found = [], []
            for first, end, data, offsets in text_chunks(batch.column(1)):
                w = hash_words(data, offsets)
                for i in range(end - first):
                    g, where = anchors(w.hashes[w.offsets[i] : w.offsets[i + 1]], window, gram)
                    if len(where):
                        h = g[where[np.concatenate(([True], where[1:] != where[:-1]))]]
                        found.append(h)
                        rows.append(np.full(len(h), rids[first + i]))
            if found:
                h, r = np.concatenate(found), np.concatenate(rows)
                order = np.argsort(h, kind="stable")
                h, r = h[order], r[order]
                begins = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(h)).astype(np.int32)), pa.array(r))
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[begins])), lists], ["anchor", "rids"])

    return docs.select("rid", "text").mapInArrow(run, "anchor long, rids array<long>")


_TURN = 0xD1342543DE82EF95
_BACK = pow(_TURN, -1, 1 << 64)


def _segments(docs: DataFrame, window: int, gram: int, words: bool) -> DataFrame:
    """rid, start, anchor, s1, s2[, words] of the segments; ``docs`` has the kept anchors and the hot ones.

    s1 and s2 are two hashes of the segment's words, from running sums over the text.
    """

    def run(batches):
        for batch in batches:
            rids = batch.column(0).to_numpy()
            wanted, hot = batch.column(3), batch.column(4)
            for first, end, data, offsets in text_chunks(batch.column(2)):
                w = hash_words(data, offsets)
                turn, back = powers(_TURN, len(w.hashes) + 1), powers(_BACK, len(w.hashes) + 1)
                zero = np.zeros(1, np.uint64)
                sum1 = np.concatenate([zero, np.cumsum(w.hashes * turn[: len(w.hashes)], dtype=np.uint64)])
                sum2 = np.concatenate([zero, np.cumsum(mix(w.hashes + np.uint64(77)) * turn[: len(w.hashes)], dtype=np.uint64)])
                starts, stops, keys, rows, own = [], [], [], [], []
                for i in range(end - first):
                    a, b = w.offsets[i], w.offsets[i + 1]
                    g, where = anchors(w.hashes[a:b], window, gram)
                    if not len(where):
                        continue
                    firsts = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
                    lasts = np.append(firsts[1:], len(where)) - 1
                    h = g[where[firsts]]
                    keep = np.isin(h, wanted[first + i].values.to_numpy().view(np.uint64))
                    firsts, lasts, h = firsts[keep], lasts[keep], h[keep]
                    single = np.zeros(len(h), bool)
                    if len(hot[first + i]):
                        single = np.isin(h, hot[first + i].values.to_numpy().view(np.uint64))
                        n = np.where(single, lasts - firsts + 1, 1)
                        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                        firsts, lasts, h, single = np.repeat(firsts, n) + step, np.where(np.repeat(single, n), np.repeat(firsts, n) + step, np.repeat(lasts, n)), np.repeat(h, n), np.repeat(single, n)
                    starts.append(firsts + a)
                    stops.append(lasts + window + a)
                    keys.append(h)
                    own.append(single)
                    rows.append(np.full(len(h), i))
                if not starts:
                    continue
                start, stop, key, alone, row = map(np.concatenate, (starts, stops, keys, own, rows))
                s1, s2 = mix((sum1[stop] - sum1[start]) * back[start]), mix((sum2[stop] - sum2[start]) * back[start])
                columns = [pa.array(rids[first + row]), pa.array((start - w.offsets[row]).astype(np.int32)), *[pa.array(signed(x)) for x in (np.where(alone, s1, key), s1, s2)]]
                if words:
                    raw = data.tobytes()
                    columns.append(pa.array([raw[x:y] for x, y in zip(w.starts[start].tolist(), w.ends[stop - 1].tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["rid", "start", "anchor", "s1", "s2", "words"][: len(columns)])

    return docs.select("rid", "id", "text", "wanted", "hot").mapInArrow(run, "rid long, start int, anchor long, s1 long, s2 long" + ", words binary" * words)


def _search(window: int):
    def run(table: pa.Table) -> pa.Table:
        hashes, sizes = [], []
        for _, _, data, offsets in text_chunks(table.column("words")):
            w = hash_words(data, offsets)
            hashes.append(w.hashes)
            sizes.append(np.diff(w.offsets))
        numbers = np.unique(np.concatenate(hashes), return_inverse=True)[1]
        spans = repeated_spans(numbers, np.concatenate(sizes), table.column("n").to_numpy(), window)
        out = pa.table({"s1": table.column("s1"), "s2": table.column("s2"), "spans": pa.array(spans, pa.list_(pa.int32()))})
        return out.filter(pa.compute.greater(pa.compute.list_value_length(out["spans"]), 0))

    return run


def repeated_word_spans(source: DataFrame, window: int = 35, gram: int = GRAM) -> DataFrame:
    """(rid, spans) of the texts with repeated windows; spans: array<struct<a,b>> of word positions, unmerged.  source: rid, id, text, shuffled once by rid."""
    # counts first, so that only anchors that occur again move, thinned by a bitmap of bounded size
    rows = _anchor_rows(source, window, gram)
    counts = checkpoint(rows.groupBy("anchor").agg(F.sum(F.size("rids")).alias("n"), F.count("*").alias("rows")).where("n > 1"))
    marks, bits = bitmap(counts, "anchor", counts.count())
    counted = skew_join(rows.where(in_bitmap(F.col("anchor"), marks, bits)), counts, ["anchor"], "rows")
    hits = counted.select("anchor", "n", F.explode("rids").alias("rid")).groupBy("rid").agg(F.collect_set("anchor").alias("wanted"), F.collect_set(F.when(F.col("n") > HOT_ANCHOR, F.col("anchor"))).alias("hot"))
    hits = checkpoint(hits)
    kept = hits.agg(F.sum(F.size("wanted"))).first()[0] or 0
    shards = max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-kept * (window + 14) // SHARD_WORDS))
    held = source.join(hits.hint("shuffle_hash"), "rid")
    distinct = _segments(held, window, gram, True).groupBy("anchor", "s1", "s2").agg(F.count("*").alias("n"), F.first("words").alias("words"))
    sharded = distinct.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "s1", "s2", "n", "words")
    found = sharded.groupBy("shard").applyInArrow(_search(window), "s1 long, s2 long, spans array<int>")
    # one query with the shuffle of the texts in it once; a passage in very many places is narrow rows, left to adaptive skew joins
    covered = _segments(held, window, gram, False).select("rid", "start", "s1", "s2").join(found, ["s1", "s2"])
    pairs = F.transform(F.sequence(F.lit(0), (F.size("spans") / 2).cast("int") - 1), lambda k: F.struct((F.get("spans", k * 2) + F.col("start")).alias("a"), (F.get("spans", k * 2 + 1) + F.col("start")).alias("b")))
    return covered.select("rid", F.explode(pairs).alias("span")).groupBy("rid").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = GRAM) -> DataFrame:
    """One row per document: id, n_words, n_removed and kept (the words left, joined by one space)."""
    source = with_row_id(replayable(docs).select(quoted(id_col).alias("id"), quoted(text_col).alias("text")), "rid")
    spans = repeated_word_spans(source, window, gram)
    joined = source.join(spans.hint("shuffle_hash"), "rid", "left").select("rid", "id", "text", F.col("spans.a").alias("a"), F.col("spans.b").alias("b"))

    def run(batches):
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):  # bounds the worker's memory
            n_words, n_removed, kept = [], [], []
            for t, a, b in zip(*[batch.column(c).to_pylist() for c in (2, 3, 4)]):
                ws = t.encode("utf-8", "surrogatepass").split() if t else []
                n_words.append(len(ws))
                if a:
                    depth = np.zeros(len(ws) + 1, np.int64)
                    np.add.at(depth, a, 1)
                    np.add.at(depth, b, -1)
                    stay = np.cumsum(depth)[:-1] == 0
                    n_removed.append(int(len(ws) - stay.sum()))
                    ws = [w for w, s in zip(ws, stay.tolist()) if s]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(ws))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)
