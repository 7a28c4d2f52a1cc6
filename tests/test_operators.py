"""Golden values and edge cases on small tables."""

import pytest
from pyspark.sql import functions as F

from textquarry.functions import text as tx
from textquarry.operators import chunking, compress, dedup, evaluate, expand, experiments, fusion, metrics, rerank, vector
from textquarry.sources import readers, sinks
from textquarry.streaming import limiter


def one(df):
    return df.collect()[0]


def test_sentences_around_abbreviations(spark):
    df = spark.createDataFrame([("It held. Mr. X left. Then it rained! (Yes.) No more.",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(tx.sentences(F.col("t"))).collect()]
    assert got == [["It held. Mr. X left.", "Then it rained!", "(Yes.) No more."], [], []]
    assert [r[0] for r in df.select(tx.compression_sentences(F.col("t"))).collect()][1:] == [[""], [""]]
    assert chunking.split_sentences("It held. Mr. X left. Then it rained! (Yes.) No more.") == got[0]


def test_accented_words_are_not_cut(spark):
    df = spark.createDataFrame([("étion the contract",)], "t string")
    assert one(df.select(tx.compression_tokens(F.col("t"))))[0] == ["contract"]


def test_simhash_and_minhash_of_nothing(spark):
    df = spark.createDataFrame([(1, ""), (2, "the of and"), (3, None)], "doc_id long, text string")
    assert {r.simhash for r in dedup.simhash(df).collect()} == {0}
    assert all(set(r.signature) == {dedup.PRIME} for r in dedup.minhash(df, n_hashes=4).collect())


def test_greedy_pipeline_keeps_the_ends_of_a_chain(spark):
    base = [f"word{i}" for i in range(60)]
    b, c = base.copy(), base.copy()
    for i in range(4):
        b[i * 14] = f"x{i}"
    c = b.copy()
    for i in range(4):
        c[i * 14 + 7] = f"y{i}"
    rows = [(1, " ".join(base)), (2, "  ".join(base)), (3, " ".join(b)), (4, " ".join(c)), (5, "quite other words altogether here")]
    got = {r.id: r.stage for r in dedup.pipeline(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.55, skip_simhash=True).collect()}
    assert got[1] == "unique" and got[2] == "exact" and got[5] == "unique"
    assert got[3] == "minhash" and got[4] == "unique"
    report = one(dedup.report(spark.createDataFrame(list(got.items()), "id long, stage string")))
    assert report.input_count == 5 and report.duplicate_rate == pytest.approx(0.4)


def test_banded_pairs_find_all(spark):
    prints = spark.createDataFrame([(1, 0), (2, 7), (3, 15), (4, -1), (5, -2), (6, 0)], "id long, simhash long")
    got = {(r.a, r.b): r.distance for r in dedup.banded_pairs(prints, 3).collect()}
    assert got == {(1, 2): 3, (1, 6): 0, (2, 6): 3, (2, 3): 1, (4, 5): 1}
    with pytest.raises(ValueError):
        dedup.banded_pairs(prints, -1)


def test_chunkers_move_on_and_cover():
    text = "word " * 500
    assert all(b > a for _, a, b, _ in chunking.fixed_size(text, 10, 8))
    assert chunking.fixed_size("   ") == [] and chunking.recursive("") == []
    with pytest.raises(ValueError):
        chunking.fixed_size("x", 10, 10)
    sentences = "One is here. Two is there. Three is gone. Four came late."
    assert [p[0] for p in chunking.by_sentence(sentences, 30, 0, 5)] == ["One is here. Two is there.", "Three is gone. Four came late."]
    assert [p[0] for p in chunking.recursive("x" * 25, 10, 2)] == ["x" * 10, "x" * 10, "x" * 9, "x"]
    long = "A" + "b" * 300 + ". C is short. D too."
    assert chunking.semantic(long, vector.hashed_bag_of_words, size=100)
    assert [p[3]["source"] for p in chunking.by_structure("# One\n" + "a b c. " * 30 + "\n# Two\n" + "d e f. " * 400, 500)][0] == "structure"


def test_sliding_windows(spark):
    text = " ".join(f"Sentence {chr(65 + i)} ends." for i in range(9))
    rows = chunking.chunk(spark.createDataFrame([(1, text), (2, "Short one."), (3, None)], "doc_id long, text string"), "sliding_window").orderBy("id", "chunk_index").collect()
    assert [(r.id, r.metadata and r.metadata["window_start"]) for r in rows] == [(1, "0"), (1, "3"), (1, "6"), (2, None)]
    with pytest.raises(ValueError):
        chunking.chunk(spark.range(1), "unknown")


def _ranked(spark):
    docs = [(0, 0, "a", "contract breach damages", 0.9), (0, 1, "b", "contract contract law", 0.5), (0, 2, "c", "weather report", 0.1), (0, 3, "d", "", 0.0)]
    return spark.createDataFrame([(0, "contract breach")], "query_id int, query string"), spark.createDataFrame(docs, "query_id int, pos long, id string, text string, score double")


def test_rerankers(spark):
    q, c = _ranked(spark)
    for f in (rerank.tfidf, rerank.bm25):
        assert [r.id for r in f(q, c).orderBy("rank").collect()][0] == "a"
        assert f(q, c).count() == 4
    assert [r.id for r in rerank.blended(q, c, alpha=1.0).orderBy("rank").collect()] == ["a", "b", "c", "d"]
    assert [r.id for r in rerank.mmr(q, c, 1.0).orderBy("mmr_rank").collect()][:2] == ["a", "b"]
    with pytest.raises(ValueError):
        rerank.bm25(q, c, k1=-1)
    with pytest.raises(ValueError):
        rerank.get_reranker("nothing")


def test_rrf(spark):
    lists = spark.createDataFrame([(0, 0, 1, "a"), (0, 0, 2, "b"), (0, 1, 1, "b"), (0, 1, 2, None), (0, 1, 3, "c")], "query_id int, list_no int, rank int, id string")
    got = {r.id: (r.rrf_score, r.rrf_rank) for r in rerank.rrf(lists).collect()}
    assert got["b"] == (round(1 / 62 + 1 / 61, 8), 1) and got["a"][1] == 2 and set(got) == {"a", "b", "c"}


def test_windows_and_parents(spark):
    parents = spark.createDataFrame([("p", "One. Two. Three. Four.")], "id string, text string")
    kids = fusion.window_index(parents)
    assert [r.text for r in kids.orderBy("window_start").collect()] == ["One. Two. Three.", "Two. Three. Four.", "Three. Four.", "Four."]
    hits = spark.createDataFrame([(0, 0, "p_w0", 0.5), (0, 1, "p_w1", 0.3), (0, 2, "none", 9.0)], "query_id int, pos int, id string, score double")
    best = one(fusion.fuse_windows(hits, kids))
    assert best.aggregated_score == pytest.approx(0.8) and best.matched_children == 2


def test_variants(spark):
    rows = spark.createDataFrame([("the breach of contract",), ("what is law",), ("",)], "query string")
    got = [r.variants for r in fusion.variants(rows, 10).collect()]
    assert got[0] == ["the breach of contract", "breach contract", "contract of breach the", "What is the breach of contract", "How does the breach of contract", "the breach of contract violation agreement"]
    assert got[1] == ["what is law", "law", "law is what", "what is law statute"]


def test_expansion(spark):
    assert expand.add_synonyms("breach of contract", 2)[1] == ["violation", "infringement", "agreement", "covenant"]
    df = spark.createDataFrame([("What is NLP, really?",)], "q string")
    got = one(df.select(expand.acronyms(F.col("q")).alias("x"))).x
    assert got.expanded == "What is NLP, natural language processing really?" and got.added == ["natural language processing"]
    q = spark.createDataFrame([(0, "alpha")], "query_id int, query string")
    docs = spark.createDataFrame([(0, 1, "alpha beta beta"), (0, 2, "gamma beta"), (0, 9, "never never")], "query_id int, rank int, text string")
    assert "never" not in one(expand.feedback(q, docs)).expanded
    with pytest.raises(ValueError):
        expand.expand(q, [])


def test_compression(spark):
    text = "Cats sleep. The contract was breached. Rain fell. Snow fell. Wind blew. Hail came. A contract binds."
    c = spark.createDataFrame([(1, "contract", text), (2, "contract", ""), (3, "zebra", text)], "chunk_id int, query string, text string")
    got = {r.chunk_id: r for r in compress.by_keywords(c, window=0).collect()}
    assert got[1].text == "The contract was breached. ... A contract binds."
    assert got[2].text == "" and got[2].compression_ratio == 1.0
    assert got[3].text == "Cats sleep. The contract was breached."
    scored = {r.chunk_id: r.text for r in compress.by_score(c).collect()}
    assert scored[1] == "The contract was breached. A contract binds."
    assert {r.compressor for r in compress.by_model(c).collect()} == {"llm_skipped"}


def test_evaluation_golden_values(spark):
    rank = spark.createDataFrame([(0, i + 1, d) for i, d in enumerate("xyzab")], "query_id int, rank int, doc_id string")
    rel = spark.createDataFrame([(0, "a"), (0, "b")], "query_id int, doc_id string")
    one_ = one(evaluate.per_query(rank, rel))
    assert one_.average_precision == pytest.approx((1 / 4 + 2 / 5) / 2) and one_.reciprocal_rank == 0.25
    k5 = {r.k: r for r in evaluate.at_k(rank, rel).collect()}
    assert k5[3].precision == 0 and k5[5].recall == 1 and k5[10].precision == pytest.approx(0.4)


def test_vector_filters_and_formats(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 2001), (2, [0.0, 1.0], 2005), (3, [0.0, 0.0], 2003)], "id long, embedding array<double>, year int")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query_vector array<double>")
    got = vector.search(q, v, 2, 0.5, vector.build_filter({"year_from": 2000, "year_to": 2003})).collect()
    assert [(r.id, r.score) for r in got] == [(1, 1.0)]
    reply = spark.createDataFrame([("Case 1: good match\nother\n Case 2: also: yes",)], "t string")
    assert one(reply.select(vector.parse_explanations(F.col("t"))))[0] == ["good match", "also: yes"]
    with pytest.raises(ValueError):
        vector.predicate({"a": {"$no": 1}})


def test_metrics(spark):
    s = spark.createDataFrame([("m", {"b": "2", "a": "1"}, v) for v in (5.0, 30.0, 75.0, 200.0)], "name string, labels map<string,string>, value double").withColumn("ts", F.current_timestamp())
    assert [r["count"] for r in metrics.histogram(s, [10, 50, 100]).collect()] == [1, 2, 3, 4]
    assert one(metrics.counters(s)).labels == 'a="1",b="2"'
    assert one(metrics.overall(spark.createDataFrame([], "component string, status string"))).status == "healthy"
    assert metrics.prometheus(s).count() == 2


def test_tracker(spark, tmp_path):
    t = experiments.Tracker(spark, str(tmp_path / "runs"))
    with t.start_run("first", ["x"]) as run:
        run.log_metric("mrr", 0.5)
    with pytest.raises(RuntimeError):
        with t.start_run("second") as run:
            run.log_metric("mrr", 0.9)
            raise RuntimeError
    assert one(experiments.best_run(t.runs(), "mrr")).name == "first"
    assert experiments.list_runs(t.runs(), status="failed").count() == 1
    assert experiments.compare(t.runs()).where("best").count() == 1


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a_case-one.txt").write_text("hello", encoding="utf-8")
    row = one(readers.text_cases(spark, str(tmp_path)))
    assert (row.id, row.title, row.text) == ("txt_a_case-one", "A Case One", "hello")
    (tmp_path / "cases.json").write_text('{"cases": [{"id": "1", "text": "t"}]}')
    (tmp_path / "list.json").write_text('[{"id": "1", "text": "t"}, {"id": "2", "text": "u"}]')
    assert readers.json_cases(spark, str(tmp_path / "cases.json")).count() == 1
    assert readers.json_cases(spark, str(tmp_path / "list.json")).count() == 2
    (tmp_path / "bad.json").write_text('{"other": 1}')
    with pytest.raises(ValueError):
        readers.json_cases(spark, str(tmp_path / "bad.json"))
    rows = sinks.ingest(readers.sample_cases(spark), chunk_size=30)
    assert rows.where("chunk_index is not null").count() > 10
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, text string, version int")
    new = spark.createDataFrame([(2, "c" * 2000, 1)], "id int, text string, version int")
    got = {r.id: len(r.text) for r in sinks.upsert(old, new).collect()}
    assert got == {1: 1, 2: 1000} and sinks.delete(old, new).count() == 1


def test_token_bucket_batch_and_stream_agree(spark, tmp_path):
    rows = [("e", i, f"2024-01-01 00:00:{i:02d}", 1) for i in range(10)] + [("f", 100, "2024-01-01 00:00:00", 9)]
    calls = spark.createDataFrame(rows, "endpoint string, call_id long, ts string, tokens int").withColumn("ts", F.to_timestamp("ts"))
    batch = limiter.replay(calls, rate=0.5, burst=2.0)
    allowed = [r.allowed for r in batch.where("endpoint = 'e'").orderBy("call_id").collect()]
    assert allowed == [True, True, True, False, True, False, True, False, True, False]
    assert {r.endpoint: r.throttled for r in limiter.statistics(batch).collect()} == {"e": 4, "f": 1}
    path = str(tmp_path / "calls")
    calls.coalesce(1).write.parquet(path)
    stream = limiter.stream(spark.readStream.schema(calls.schema).parquet(path), rate=0.5, burst=2.0)
    q = stream.writeStream.format("memory").queryName("bucket").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = [r.allowed for r in spark.table("bucket").where("endpoint = 'e'").orderBy("call_id").collect()]
    assert got == allowed


def test_explanations_logging_and_summary(spark, caplog):
    from textquarry.functions import observe

    shown = vector.demo_results(spark, "q")
    assert one(vector.explain(shown, "q", lambda p: "Case 1: fits").orderBy("rank")).relevance_explanation == "fits"
    assert {r[0] for r in vector.explain(shown, "q").select("relevance_explanation").collect()} == {vector.NO_EXPLANATION}

    @observe.timed("step")
    def work():
        return 1

    observe.reset()
    assert work() == 1 and observe.samples(spark).count() == 1
    report = spark.createDataFrame([("mrr", None, 0.5), ("recall", 5, 0.25)], "metric string, k int, value double")
    assert [r.line.split() for r in evaluate.summary(report).collect()] == [["MRR", "0.5000"], ["RECALL@5", "0.2500"]]


def test_staged_dedup_takes_any_ids(spark):
    words = [f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i}" for i in range(40)]
    long = " ".join(words)
    rows = [("b", long.replace(" ", "  ")), ("a", long), ("c", long.upper()), ("d", "something else entirely here"), ("d", "and another text of one id"), (None, "no id at all in this row"), (None, None), ("e", ""), ("f", "???")]
    got = sorted((r.id or "", r.stage) for r in dedup.pipeline(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == [("", "exact"), ("", "unique"), ("a", "unique"), ("b", "exact"), ("c", "simhash"), ("d", "unique"), ("d", "unique"), ("e", "unique"), ("f", "simhash")]
    assert dedup.pipeline(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def test_buckets_on_the_clock():
    now = [0.0]
    b = limiter.Bucket(2.0, 3, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert [b.acquire() for _ in range(4)] == [True, True, True, False] and b.throttle_rate() == 0.25
    assert b.acquire_blocking() and now[0] == 0.5 and b.available_tokens() == 0.0
    assert not b.acquire_blocking(100, timeout=1.0)
    b.reset()
    assert b.available_tokens() == 3
    many = limiter.Buckets(1.0, 1)
    many.register("x", 1.0, 2)
    assert [many.acquire("x") for _ in range(2)] + [many.acquire("y"), many.acquire("y")] == [True, True, True, False]
    assert many.statistics()["y"]["throttled"] == 1

    @limiter.rate_limit(1000.0, 5)
    def called(x):
        return x + 1

    assert called(1) == 2 and called.bucket.total == 1


def test_vector_store_and_ingestion(spark, tmp_path):
    path = str(tmp_path / "cases")
    table = sinks.init_database(spark, path)
    assert table.count() == 10 and set(table.columns) == {"id", "text", "embedding", "metadata", "version"}
    sinks.add_case(spark, {"citation": "[2020] X 1", "title": "T", "text": "fresh words"}, path)
    store = vector.get_vector_store(spark, path)
    hit = store.search(vector.get_embeddings(["fresh words"]), 1).first()
    assert hit["metadata"]["title"] == "T" and hit["id"].startswith("case_") and abs(hit["score"] - 1) < 1e-6
    store.delete([hit["id"]])
    assert store.rows().count() == 10
    asked = spark.createDataFrame([(1, "contract breach")], "query_id int, query string")
    found = vector.retrieve(asked, store.rows(), 3, 0.0, n_queries=1)
    assert found.columns[:3] == ["query_id", "rank", "id"] and found.count() == 3
    docs = spark.createDataFrame([("x", "one two three. " * 20, "T1"), ("y", "short", "T2")], "id string, text string, title string")
    rows = {r.id: r for r in sinks.ingest(docs, 100, path=path).collect()}
    assert rows["y"].title == "T2" and rows["x_0"].title == "T1" and rows["x_0"].chunk_start == 0 and rows["x_0"].total_chunks == len(rows) - 1
    assert sinks.chunk_text("a b c", 3, 0) == ["a b", "c"]
    calls = []

    def fails_once(texts):
        calls.append(1)
        if len(calls) < 2:
            raise OSError("busy")
        return [[1.0]]

    assert vector.retrying(fails_once, first_wait=0.0)(["x"]) == [[1.0]]


def test_expanders_windows_and_fields(spark):
    q = spark.createDataFrame([(1, "zeta rule")], "query_id int, query string")
    r = expand.get_expander("synonym", per_term=1, vocabulary={"zeta": ["omega one", "omega two"]})(q).first()
    assert r.expanded == "zeta rule omega one" and r.added == ["omega one"]
    assert expand.get_expander("prf")(q).first().expanded == "zeta rule"
    assert q.select(expand.all_terms(F.lit("Zeta  RULE x"))).first()[0] == ["zeta", "rule", "x"]
    with pytest.raises(ValueError):
        expand.get_expander("none")
    kids = fusion.window_index(spark.createDataFrame([("p", "One. Two. Three. Four.")], "id string, text string"))
    assert tuple(fusion.window_counts(kids).first()) == (1, 4)
    lists = spark.createDataFrame([(1, 0, 1, "a", "first"), (1, 1, 1, "a", "second"), (1, 1, 2, "b", "only")], "query_id int, list_no int, rank int, id string, title string")
    assert {r.id: r.title for r in rerank.rrf(lists).collect()} == {"a": "first", "b": "only"}
    fused = {r.id: r.variant_hits for r in fusion.fuse_variants(lists.drop("title")).collect()}
    assert fused == {"a": 2, "b": 1}
    found = fusion.retrieve_variants(q, lambda asked: asked.select("query_id", F.lit(1).alias("rank"), F.lit("z").alias("id")))
    assert found.first().id == "z" and found.first().variant_hits > 1


def test_prometheus_kinds(spark):
    import datetime

    t = datetime.datetime(2020, 1, 1)
    s = spark.createDataFrame([("hits.all", {"a": "b"}, 2.0, t), ("load", {}, 0.5, t), ("wait", {}, 30.0, t), ("wait", {}, 5.0, t)], "name string, labels map<string,string>, value double, ts timestamp")
    kinds = spark.createDataFrame([("load", "gauge"), ("wait", "histogram")], "name string, kind string")
    lines = [r.line for r in metrics.prometheus(s, kinds, 12.5, [10, 50]).collect()]
    for want in ("# TYPE hits_all counter", 'hits_all{a="b"} 2.0', "# TYPE load gauge", "load 0.5", "# TYPE wait histogram", 'wait_bucket{le="10"} 1', 'wait_bucket{le="50"} 2', 'wait_bucket{le="+Inf"} 2', "wait_sum 35.0", "wait_count 2", "app_uptime_seconds 12.5"):
        assert want in lines, (want, lines)


def test_rerankers_with_a_shared_corpus(spark):
    texts = ["breach of contract", "contract law and contract remedies", None, "", "weather report", "remedies remedies", "breach of contract", "unrelated words here", "weather weather contract"]
    q = spark.createDataFrame([(1, "contract remedies"), (2, "nothing shared"), (3, None), (4, "weather breach weather")], "query_id int, query string")
    c = spark.createDataFrame([(i, f"d{i}", t, float(i * 7 % 5)) for i, t in enumerate(texts)], "pos int, id string, text string, score double")
    each = q.select("query_id").crossJoin(c)
    for f in (rerank.tfidf, rerank.bm25, rerank.blended):
        for top in (1, 4, 20):
            got, want = (sorted(map(tuple, f(q, x, top=top).collect()), key=str) for x in (c, each))
            assert got == want and len(got) == 4 * min(top, len(texts))
    assert rerank.tfidf(q, c.limit(0), top=3).count() == 0
    with pytest.raises(ValueError):
        rerank.bm25(q, c)


def test_compression_keeps_rows_apart(spark):
    rows = [(1, "contract", "A contract binds. The weather is fine.", "x"), (1, "weather", "A contract binds. The weather is fine.", "y"), (2, "contract", None, "z"), (3, None, "One. Two. Three.", None)]
    c = spark.createDataFrame(rows, "chunk_id int, query string, text string, compressor string").withColumn("a.b", F.lit(7))
    got = {(r.chunk_id, r.text): r for r in compress.by_score(c.withColumnRenamed("compressor", "source")).collect()}
    assert got[1, "A contract binds."].source == "x" and got[1, "The weather is fine."].source == "y" and got[2, ""].kept_sentences == 1
    assert all(r["a.b"] == 7 and r.compressor == "sentence_score" for r in got.values())
    assert {r.text for r in compress.by_keywords(c, window=0).collect()} == {"A contract binds.", "The weather is fine.", "", "One. Two."}
    steps = compress.compress(c, ["keyword_window", "sentence_score"]).collect()
    assert len(steps) == 4 and {r.pipeline_steps for r in steps} == {"keyword_window -> sentence_score"}
