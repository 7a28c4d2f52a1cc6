"""Exact and near-duplicate removal: MD5, SimHash, MinHash, and the staged pipeline.

Documents are taken in the order of their ids.  The staged pipeline is greedy and depends on
that order, so chains are not closed: of A~B~C with A unlike C, A and C stay.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import text as tx
from textquarry.functions.checkpoints import checkpoint
from textquarry.functions.shipping import bounded

PRIME = (1 << 61) - 1

#: Shingles of a text that are handled at once.
_STEP = 1 << 16


def fingerprint(text: Column, normalize: bool = True) -> Column:
    return F.md5((tx.normalized(text) if normalize else F.coalesce(text, F.lit(""))).cast("binary"))


def exact_dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalize: bool = True) -> DataFrame:
    """(id, first_id, is_duplicate): the least id of the same normalised text stands for it; rows are told apart by their ids."""
    held = docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), normalize).alias("h"))
    first = held.groupBy("h").agg(F.min("id").alias("first_id"))
    return held.join(first, "h").select("id", "first_id", (~F.col("id").eqNullSafe(F.col("first_id"))).alias("is_duplicate"))


def _tokens(docs: DataFrame, text_col: str) -> Column:
    """The tokens in one string, as arrays of strings take a worker several times the memory; batches are bounded."""
    bounded(docs.sparkSession)
    return F.array_join(tx.dedup_tokens(F.col(text_col)), " ")


def _shingles(tokens: str, k: int) -> list[str]:
    """With repeats; fewer than k tokens are shingles themselves."""
    w = tokens.split()
    return [" ".join(x) for x in zip(*(w[i:] for i in range(k)))] if len(w) >= k else w


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, simhash): bit b is set if more shingles, with repeats, have it than not; texts without tokens give 0.

    Tokens come from the JVM; a text's shingle hashes are summed bit by bit in one vectorised pass, without a shuffle.
    """

    @F.pandas_udf("long")
    def run(tokens: pd.Series) -> pd.Series:
        out = np.zeros(len(tokens), np.int64)
        for row, w in enumerate(tokens):
            shingles, count = _shingles(w, k), np.zeros(64, np.int64)
            for lo in range(0, len(shingles), _STEP):
                raw = np.frombuffer(b"".join([hashlib.sha256(s.encode()).digest()[:8] for s in shingles[lo : lo + _STEP]]), np.uint8).reshape(-1, 8)
                count += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
            out[row] = np.packbits(2 * count > len(shingles)).view(">i8")[0]
        return pd.Series(out)

    return docs.select(F.col(id_col).alias("id"), run(_tokens(docs, text_col)).alias("simhash"))


def near_prints(values: DataFrame, threshold: int = 3) -> DataFrame:
    """(x, y, distance), x < y, of distinct fingerprints (column simhash) within ``threshold`` bits.

    Of threshold + 2 blocks of bits, close values share two, so an equi-join on pairs of blocks loses
    nothing, and a key has about 26 bits at the default, which keeps buckets small.
    """
    if threshold < 0:
        raise ValueError("threshold is not negative")
    n = threshold + 2
    edges = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned(F.shiftleft("simhash", edges[i]), 64 - (edges[i + 1] - edges[i])) for i in range(n)]
    keys = F.array(*[F.struct(F.lit(i * n + j).alias("band"), F.xxhash64(block[i], block[j]).alias("bits")) for i in range(n) for j in range(i)])
    rows = values.select("simhash", F.explode(keys).alias("k")).select("simhash", "k.band", "k.bits")
    near = rows.alias("l").join(rows.alias("r"), ["band", "bits"]).where("l.simhash < r.simhash").select(F.col("l.simhash").alias("x"), F.col("r.simhash").alias("y"))
    return near.withColumn("distance", tx.hamming(F.col("x"), F.col("y"))).where(F.col("distance") <= threshold).distinct()


def banded_pairs(prints: DataFrame, threshold: int = 3) -> DataFrame:
    """(a, b, distance), a < b, of all rows whose fingerprints are within ``threshold`` bits; equal ones are one value until the end."""
    prints = checkpoint(prints)
    values = prints.select("simhash").distinct()
    both = near_prints(values, threshold).unionByName(values.select(F.col("simhash").alias("x"), F.col("simhash").alias("y"), F.lit(0).alias("distance")))
    l, r = prints.select(F.col("id").alias("i"), F.col("simhash").alias("x")), prints.select(F.col("id").alias("j"), F.col("simhash").alias("y"))
    out = both.join(l, "x").join(r, "y").where((F.col("x") != F.col("y")) | (F.col("i") < F.col("j")))
    return out.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.col("distance").cast("int").alias("distance"))


def minhash_parameters(n: int = 128, seed: int = 42) -> list[tuple[int, int]]:
    """a in [1, p-1] and b in [0, p-1] in turn, from the standard generator."""
    rng = random.Random(seed)
    return [(rng.randint(1, PRIME - 1), rng.randint(0, PRIME - 1)) for _ in range(n)]


def permuted(x: np.ndarray, a, b) -> np.ndarray:
    """(a x + b) mod 2**61 - 1 for x below 2**32, in 64-bit words: a is split in 31 and 30 bits so nothing overflows.

    The parts are below 2**61 + 2**32 and 2**62, and b below 2**61, so that one reduction at the end is enough.
    """
    p = np.uint64(PRIME)
    a, b = np.asarray(a, np.uint64), np.asarray(b, np.uint64)
    out = x * (a >> np.uint64(30))
    spare = out >> np.uint64(31)
    out &= np.uint64((1 << 31) - 1)
    out <<= np.uint64(30)
    out += spare
    out += np.multiply(x, a & np.uint64((1 << 30) - 1), out=spare)
    out += b
    np.right_shift(out, np.uint64(61), out=spare)
    out &= p
    out += spare
    # below the prime the difference wraps around and is the greater one
    return np.minimum(out, np.subtract(out, p, out=spare), out=out)


def minhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_hashes: int = 128, k: int = 3, seed: int = 42) -> DataFrame:
    """(id, signature): the least value of every permutation over the distinct shingles; none gives 2**61 - 1 throughout.

    Tokens come from the JVM; all permutations of a run of shingles are one vectorised pass, without a shuffle.
    """
    a, b = (np.array(x, np.uint64)[:, None] for x in zip(*minhash_parameters(n_hashes, seed)))

    @F.pandas_udf("array<long>")
    def run(tokens: pd.Series) -> pd.Series:
        out = []
        for w in tokens:
            raw = b"".join([hashlib.md5(s.encode()).digest() for s in set(_shingles(w, k))])
            x = np.unique(np.frombuffer(raw, ">u4")[3::4]).astype(np.uint64)
            least = np.full(n_hashes, PRIME, np.uint64)
            for lo in range(0, len(x), 256):
                least = np.minimum(least, permuted(x[lo : lo + 256], a, b).min(axis=1))
            out.append(least.astype(np.int64))
        return pd.Series(out)

    return docs.select(F.col(id_col).alias("id"), run(_tokens(docs, text_col)).alias("signature"))


def estimate(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures; 0 for empty ones."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a))


def near_signatures(values: DataFrame, n_hashes: int, threshold: float = 0.8) -> DataFrame:
    """(x, y, jaccard), x < y, of the representatives (columns rep, signature; signatures distinct) at the threshold or above.

    Pairs may differ in at most m places, so of m + 1 bands one is equal: the join loses nothing.
    """
    misses = n_hashes - int(-(-threshold * n_hashes // 1))
    bands = misses + 1
    edges = [n_hashes * i // bands for i in range(bands + 1)]
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.slice("signature", edges[i] + 1, edges[i + 1] - edges[i])).alias("h")) for i in range(bands)])
    rows = values.select("rep", F.explode(keys).alias("k")).select("rep", "k.band", "k.h")
    near = rows.alias("l").join(rows.alias("r"), ["band", "h"]).where("l.rep < r.rep").select(F.col("l.rep").alias("x"), F.col("r.rep").alias("y")).distinct()
    sig = lambda name, s: values.select(F.col("rep").alias(name), F.col("signature").alias(s))
    return near.join(sig("x", "s"), "x").join(sig("y", "t"), "y").select("x", "y", estimate(F.col("s"), F.col("t")).alias("jaccard")).where(F.col("jaccard") >= threshold)


def minhash_pairs(signatures: DataFrame, n_hashes: int, threshold: float = 0.8) -> DataFrame:
    """(a, b, jaccard), a < b, of all rows whose signatures are estimated at the threshold or above; equal ones are one value until the end."""
    signatures = checkpoint(signatures)
    values = checkpoint(signatures.groupBy("signature").agg(F.min("id").alias("rep")))
    both = near_signatures(values, n_hashes, threshold).unionByName(values.select(F.col("rep").alias("x"), F.col("rep").alias("y"), F.lit(1.0).alias("jaccard")))
    member = signatures.join(values, "signature").select("id", "rep")
    l, r = member.select(F.col("id").alias("i"), F.col("rep").alias("x")), member.select(F.col("id").alias("j"), F.col("rep").alias("y"))
    out = both.join(l, "x").join(r, "y").where((F.col("x") != F.col("y")) | (F.col("i") < F.col("j")))
    return out.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "jaccard")


def _settled(nodes: DataFrame, close: DataFrame, alike: DataFrame) -> DataFrame:
    """(node, stage) of every node (node, rep), as if taken one after the other in the order of ``node``.

    close: (a, b), a < b, nodes near by SimHash; alike: (x, y) classes (rep) near by MinHash.  A node
    is removed by SimHash if an earlier neighbour of that kind was not, else by MinHash if an earlier node of
    its own or a near class is unique.  Every round settles all nodes whose earlier neighbours are
    settled as far as they matter (the least open one always is), so no component is held by one task.
    """
    own = nodes.select(F.col("rep").alias("x"), F.col("rep").alias("y")).distinct()
    around = checkpoint(own.unionByName(alike.select("x", "y")).unionByName(alike.select(F.col("y").alias("x"), F.col("x").alias("y"))))
    state = checkpoint(nodes.select("node", "rep", F.lit(None).cast("string").alias("stage")))
    while True:
        seen = close.join(state.select(F.col("node").alias("a"), "stage"), "a").groupBy(F.col("b").alias("node")).agg(F.bool_or(F.col("stage").isin("unique", "minhash")).alias("is_close"), F.bool_or(F.col("stage").isNull()).alias("may_be"))
        of_class = state.groupBy(F.col("rep").alias("x")).agg(F.min(F.when(F.col("stage") == "unique", F.col("node"))).alias("unique"), F.min(F.when(F.col("stage").isNull(), F.col("node"))).alias("open"))
        near = around.join(of_class, "x").groupBy(F.col("y").alias("rep")).agg(F.min("unique").alias("unique"), F.min("open").alias("open"))
        yes = lambda c: F.coalesce(c, F.lit(False))
        settled = (
            F.when(yes(F.col("is_close")), "simhash")
            .when(yes(F.col("may_be")), F.lit(None))
            .when(yes(F.col("unique") < F.col("node")), "minhash")
            .when(yes(F.col("open") < F.col("node")), F.lit(None))
            .otherwise("unique")
        )
        state = checkpoint(state.join(seen, "node", "left").join(near, "rep", "left").select("node", "rep", F.coalesce("stage", settled).alias("stage")))
        if state.where("stage is null").isEmpty():
            return state.select("node", "stage")


def pipeline(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hamming: int = 3, threshold: float = 0.8, n_hashes: int = 128, k: int = 3, skip_simhash: bool = False, skip_minhash: bool = False) -> DataFrame:
    """(id, stage) of every row: 'unique', or the stage that removed it ('exact', 'simhash', 'minhash').

    Rows are taken in the order of their ids (nulls last), rows of one id in any fixed order; ids may be of any
    type that sorts.  Equal fingerprints need no pairs: of rows with one SimHash only the first can get past that stage, and
    rows with one signature have the same neighbours, so links are found between classes.
    """
    rows = checkpoint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    # numbers in the order of ids, from a range sort: partition, then place in it
    numbered = checkpoint(rows.orderBy(F.col("id").isNull(), "id", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).withColumn("node", F.monotonically_increasing_id()))
    held = numbered.select("id", "node", fingerprint(F.col("text")).alias("h"))
    firsts = held.groupBy("h").agg(F.min("node").alias("node"))
    kept = checkpoint(numbered.join(firsts.select("node"), "node", "left_semi").select("node", "text"))
    spark = docs.sparkSession
    close, alike, member = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "x long, y long"), None
    gone = docs.sparkSession.createDataFrame([], "node long, stage string")
    if not skip_simhash:
        prints = checkpoint(simhash(kept, "node", "text", k))
        least = checkpoint(prints.groupBy("simhash").agg(F.min("id").alias("node")))
        gone = prints.join(least.select(F.col("node").alias("id")), "id", "left_anti").select(F.col("id").alias("node"), F.lit("simhash").alias("stage"))
        kept = kept.join(least.select("node"), "node", "left_semi")
        ends = [least.select(F.col("simhash").alias(c), F.col("node").alias(n)) for c, n in (("x", "i"), ("y", "j"))]
        near = near_prints(least, hamming).join(ends[0], "x").join(ends[1], "y")
        close = checkpoint(near.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")))
    if not skip_minhash:
        signatures = checkpoint(minhash(kept, "node", "text", n_hashes, k))
        values = checkpoint(signatures.groupBy("signature").agg(F.min("id").alias("rep")))
        member = checkpoint(signatures.join(values, "signature").select(F.col("id").alias("node"), "rep"))
        alike = checkpoint(near_signatures(values, n_hashes, threshold).select("x", "y"))
    state = _settled(kept.select("node", F.col("node").alias("rep")) if member is None else member, close, alike)
    stages = state.unionByName(gone)
    found = held.select("id", "node").join(stages, "node", "left")
    return found.select("id", F.coalesce("stage", F.lit("exact")).alias("stage"))


def report(stages: DataFrame) -> DataFrame:
    """One row: input, unique and removed counts and the duplicate rate (0 for no input)."""
    n = F.count("*")
    by = lambda s: F.count_if(F.col("stage") == s)
    return stages.agg(
        n.alias("input_count"), by("unique").alias("unique_count"), by("exact").alias("exact_removed"), by("simhash").alias("simhash_removed"), by("minhash").alias("minhash_removed"), F.when(n == 0, 0.0).otherwise((n - by("unique")) / n).alias("duplicate_rate")
    )


def unseen(new: DataFrame, index: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``new`` whose normalised text is not in ``index``; extending the index is a union."""
    key = lambda df: fingerprint(F.col(text_col))
    return new.withColumn("__h", key(new)).join(index.select(key(index).alias("__h")).distinct(), "__h", "left_anti").drop("__h")
