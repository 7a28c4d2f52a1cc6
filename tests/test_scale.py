"""Searches, evaluations, rerankers and folds at any size: the same rows as brute force, and plans whose work and memory grow with the input."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.functions import text as tx
from textquarry.operators import chunking, compress, dedup, evaluate, rerank, vector


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_top_k_looks_at_all_pairs_in_blocks(spark, monkeypatch):
    nan, rng = float("nan"), np.random.default_rng(5)
    rows = [[float(x) for x in rng.integers(-2, 3, 4)] for _ in range(120)] + [None, [0.0] * 4, [1.0, None, 0.0, 2.0], [nan, 1.0, 0.0, 0.0], [1.0, 2.0], [0.0, 0.0], [], [3e-200] * 4, [1e200] * 4]
    rows += [[1.0, 2.0, 3.0, 4.0]] * 30
    v = spark.createDataFrame([(i * 7 % len(rows), x) for i, x in enumerate(rows)], "id long, embedding array<double>")
    q = v.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    brute = v.crossJoin(q).select("query_id", "id", tx.cosine(F.col("embedding"), F.col("query_vector")).alias("score"))
    want = {}
    for r in sorted(brute.collect(), key=lambda r: (2 if r.score is None else not math.isnan(r.score), -(r.score or 0), r.id) if r.score is None or not math.isnan(r.score) else (0, 0, r.id)):
        want.setdefault(r.query_id, []).append((r.id, str(r.score)))
    monkeypatch.setattr(vector, "BLOCK_VALUES", 100)
    found = vector.top_k(q, v, 7)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, str(r.score)))
    assert got == {k: x[:7] for k, x in want.items()}
    # no row for each pair, which took hours where both sides are large
    assert "Join" not in plan(found)


def test_nearest_in_steps(monkeypatch):
    monkeypatch.setattr(vector, "QUERY_STEP", 7)
    monkeypatch.setattr(vector, "VECTOR_STEP", 300)
    monkeypatch.setattr(vector, "EXACT_STEP", 50)
    rows = np.random.default_rng(3).normal(size=(3000, 8))
    rows[1::2] = rows[::2] * np.random.default_rng(4).uniform(0.5, 2, (1500, 1))  # ties but for the last bit
    sizes = np.full(len(rows), 8)
    q, v = vector._Side(rows[:40], sizes[:40]), vector._Side(rows, sizes)
    qi, vi, score = vector._nearest(q, v, 5)
    for i in range(40):
        every = vector._exact(q, v, np.full(len(rows), i), np.arange(len(rows)))
        best = np.lexsort((np.arange(len(rows)), -every))[:5]
        assert vi[qi == i].tolist() == best.tolist()
        assert score[qi == i].tolist() == every[best].tolist()


def test_judgments_shared_by_topic(spark):
    rng = np.random.default_rng(1)
    judged = [("ab"[i % 2], i, float(i % 3 + 1)) for i in range(40)]
    of = [(q, "abc"[q % 3]) for q in range(9)]
    ranked = [(q, r, int(d)) for q in range(10) for r, d in enumerate(rng.permutation(60)[:12], 1)]
    ranks, topics = spark.createDataFrame(ranked, "query_id long, rank int, doc_id long"), spark.createDataFrame(of, "query_id long, topic string")
    shared = spark.createDataFrame(judged, "topic string, doc_id long, gain double")
    pairs = topics.join(shared, "topic").select("query_id", "doc_id", "gain")
    shown = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    for f in (evaluate.at_k, evaluate.per_query, evaluate.evaluate):
        assert shown(f(ranks, shared, topics=topics)) == shown(f(ranks, pairs))


@pytest.fixture
def batches(spark):
    """What the session's bound on batches is once a plan has been made."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    yield lambda: int(spark.conf.get(key).rstrip("b"))
    spark.conf.unset(key)


def test_chunkers_cut_bounded_batches_once(spark, batches):
    docs = spark.createDataFrame([("a", "One. Two. Three."), ("b", None), (None, "Four five.")], "doc_id string, text string")
    for strategy, options in (("fixed", {}), ("sentence", {}), ("recursive", {}), ("semantic", {"embed": vector.hashed_bag_of_words}), ("structure", {})):
        found = chunking.chunk(docs, strategy, **options)
        assert batches() <= 4 << 20
        # the cutter ran twice before, once for a filter, and gave all chunks of a batch as one array value per text
        shown = plan(found.select("id", "chunk_index", F.length("text")))
        assert shown.count("MapInArrow") == 1 and "ArrowEvalPython" not in shown
        assert [(r.id, r.chunk_index, r.text) for r in found.orderBy("id").collect()] == [(None, 0, "Four five."), ("a", 0, "One. Two. Three.")]
    meta = chunking.chunk(docs, "semantic", embed=vector.hashed_bag_of_words, size=4).where("id = 'a'").first().metadata
    assert meta == {"num_sentences": "1"}


def test_prints_come_from_bounded_batches(spark, batches):
    x = np.array([0, 1, 2**32 - 1, 12345678], np.uint64)
    ends = [1, 2**30 - 1, 2**30, 2**31, 2**60, dedup.PRIME - 1]
    for a in ends:
        for b in [0, *ends]:
            assert dedup.permuted(x, a, b).tolist() == [(a * int(v) + b) % dedup.PRIME for v in x]
    text = " ".join(f"w{i % 50} x{i % 7}" for i in range(300))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "lonely word")], "doc_id long, text string")
    words = {1: text.split(), 2: [], 3: ["lonely", "word"]}
    shingles = {i: [" ".join(w[j : j + 3]) for j in range(len(w) - 2)] if len(w) > 2 else w for i, w in words.items()}
    low = lambda s: int(hashlib.md5(s.encode()).hexdigest()[-8:], 16)
    for found in (dedup.minhash(docs), dedup.simhash(docs)):
        assert batches() <= 4 << 20
        # a string of tokens per text, not an array of strings
        assert "array_join" in plan(found)
    for r in dedup.minhash(docs).collect():
        assert r.signature == [min(((a * low(s) + b) % dedup.PRIME for s in shingles[r.id]), default=dedup.PRIME) for a, b in dedup.minhash_parameters()]
    for r in dedup.simhash(docs).collect():
        got = [int.from_bytes(hashlib.sha256(s.encode()).digest()[:8], "big") for s in shingles[r.id]]
        assert r.simhash % 2**64 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in got) > len(got))


def test_compression_folds_bounded_batches(spark, batches):
    chunks = spark.createDataFrame([(1, "apple pear", "Apple one. Nothing here. Pear two."), (2, None, "One. Two."), (3, "x", None)], "chunk_id long, query string, text string")
    for f in (compress.by_score, compress.by_keywords):
        found = f(chunks)
        assert batches() <= 4 << 20
        assert "array_join" in plan(found)
    assert [(r.text, r.hit_count) for r in compress.by_keywords(chunks, window=0).orderBy("chunk_id").collect()] == [("Apple one. ... Pear two.", 2), ("One. Two.", 0), ("", 0)]


def test_shared_corpus_is_ranked_without_shuffling_its_words(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in "bcdfg" for b in "xyzuv"]
    text = lambda n: " ".join(words[int(i)] for i in np.minimum(rng.geometric(0.12, n) - 1, 24))
    docs = [(i, f"d{i}", text(int(rng.integers(1, 40))), float(i % 7)) for i in range(150)] + [(150, "empty", None, 1.0), (151, "once", "unique bx the", 2.0)]
    asked = [(1, text(4)), (2, "vv unique"), (3, None), (4, "nowhere"), (None, "bx")]
    corpus, queries = spark.createDataFrame(docs, "pos long, id string, text string, score double"), spark.createDataFrame(asked, "query_id long, query string")
    per_query = corpus.crossJoin(queries.where("query_id is not null").select("query_id"))
    shown = lambda df: sorted((r.query_id, r["rank"], r.id, r.rerank_score) for r in df.collect())
    for few in (250_000, 3):  # all terms common, some
        monkeypatch.setattr(rerank, "BROADCAST_TERMS", few)
        for f in (rerank.tfidf, rerank.bm25, rerank.blended):
            assert shown(f(queries, corpus, top=9)) == shown(f(queries, per_query, top=9))
    counts = rerank._term_counts(corpus)
    assert sorted((r.term, r.tf, r.n) for r in counts.where("pos = 151").collect()) == [("bx", 1, 2), ("unique", 1, 2)]
    assert "Aggregate" not in plan(counts)


def test_simulated_rankings_take_documents_in_blocks(spark):
    topics = spark.createDataFrame([(q, "ab"[q % 2]) for q in range(12)] + [(12, "none")], "query_id long, topic string")
    judged = spark.createDataFrame([("aab"[i % 3], i) for i in range(90)], "topic string, doc_id long")
    pairs = topics.join(judged, "topic").select("query_id", "doc_id")
    draw = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1_000_000)) / 1_000_000.0
    hashed = F.xxhash64("query_id", "doc_id")
    real = pairs.select("query_id", F.col("doc_id").cast("string").alias("doc_id")).where(draw("query_id", "doc_id", F.lit(1)) < 0.6).select("query_id", hashed.alias("h"), "doc_id", (draw("query_id", F.lit(2)) < 0.5).alias("up"))
    noise = spark.createDataFrame([(q, f"noise_{i}") for q in range(12) for i in range(7)], "query_id long, doc_id string").select("query_id", hashed.alias("h"), "doc_id").collect()
    want = []
    for q in range(12):
        own = sorted((r.h, r.doc_id, r.up) for r in real.where(F.col("query_id") == q).collect())
        first = [own[0]] if own and own[0][2] else []
        rest = sorted([(h, d) for h, d, _ in own[len(first) :]] + [(r.h, r.doc_id) for r in noise if r.query_id == q])
        want += [(q, i, x[1]) for i, x in enumerate([*first, *rest][:10], 1)]
    for found in (evaluate.simulate(judged, topics=topics), evaluate.simulate(pairs)):
        assert sorted((r.query_id, r["rank"], r.doc_id) for r in found.collect()) == want
