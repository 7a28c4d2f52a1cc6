"""Retrieval quality: precision, recall, reciprocal rank, average precision, NDCG and hit rate.

rankings: (query_id, rank from 1, doc_id); judgments: (query_id, doc_id[, gain]).  A judged
document is relevant whatever its gain.  Precision divides by what was retrieved, recall by what is
relevant; a query with none of either scores 0.  Where queries share what is judged, ``topics`` is
(query_id, topic), one row per query, and judgments are (topic, doc_id[, gain]).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import fixed
from textquarry.functions.checkpoints import checkpoint

#: Judged documents in a block of a simulation.
BLOCK_DOCS = 20_000


def _by_topic(judgments: DataFrame, topics: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(judgments by topic, (query_id, topic)); a query without a topic of its own is one."""
    gain = F.col("gain").cast("double") if "gain" in judgments.columns else F.lit(1.0)
    if topics is None:
        return judgments.select(F.col("query_id").alias("topic"), "doc_id", gain.alias("gain")), judgments.select("query_id", F.col("query_id").alias("topic")).distinct()
    return judgments.select("topic", "doc_id", gain.alias("gain")), topics.select("query_id", "topic")


def _flagged(rankings: DataFrame, judgments: DataFrame, topics: DataFrame | None) -> DataFrame:
    judged, of = _by_topic(judgments, topics)
    j = judged.groupBy("topic", "doc_id").agg(F.max("gain").alias("gain"))
    rows = rankings.select("query_id", "rank", "doc_id").join(of, "query_id", "left").join(j, ["topic", "doc_id"], "left")
    return rows.select("query_id", "rank", "doc_id", F.col("gain").isNotNull().cast("int").alias("rel"), F.coalesce("gain", F.lit(0.0)).alias("gain"))


def _queries(rankings: DataFrame, judgments: DataFrame, topics: DataFrame | None) -> DataFrame:
    judged, of = _by_topic(judgments, topics)
    relevant = of.join(judged.groupBy("topic").agg(F.countDistinct("doc_id").alias("n_relevant")), "topic").select("query_id", "n_relevant")
    retrieved = rankings.groupBy("query_id").agg(F.count("*").alias("n_retrieved"))
    return retrieved.join(relevant, "query_id", "full").select("query_id", F.coalesce("n_retrieved", F.lit(0)).alias("n_retrieved"), F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"))


def at_k(rankings: DataFrame, judgments: DataFrame, ks: list[int] | None = None, topics: DataFrame | None = None) -> DataFrame:
    """(query_id, k, precision, recall, ndcg, hit) for every query and cut-off."""
    ks = fixed.CUTOFFS if ks is None else ks
    flagged = _flagged(rankings, judgments, topics)
    cut = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    # the terms of a sum over few ranks are added in rank order
    dcg = lambda rows: F.aggregate(rows, F.lit(0.0), lambda s, x: s + x["gain"] / (F.log2(x["rank"] + 1.0)))
    seen = flagged.select("*", cut).where("rank <= k").groupBy("query_id", "k").agg(F.count("*").alias("n"), F.sum("rel").alias("hits"), F.array_sort(F.collect_list(F.struct("rank", "gain"))).alias("rows"))
    judged, of = _by_topic(judgments, topics)
    best = judged.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("gain"), "doc_id"))).where(F.col("rank") <= max(ks))
    ideal = best.select("topic", "rank", "gain", cut).where("rank <= k").groupBy("topic", "k").agg(F.array_sort(F.collect_list(F.struct("rank", "gain"))).alias("best"))
    ideal = of.join(ideal, "topic").select("query_id", "k", "best")
    every = _queries(rankings, judgments, topics).select("query_id", "n_relevant", cut)
    joined = every.join(seen, ["query_id", "k"], "left").join(ideal, ["query_id", "k"], "left")
    top = F.coalesce(dcg(F.col("best")), F.lit(0.0))
    return joined.select(
        "query_id",
        "k",
        F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)).alias("precision"),
        F.when(F.col("n_relevant") > 0, F.coalesce(F.col("hits"), F.lit(0)) / F.col("n_relevant")).otherwise(0.0).alias("recall"),
        F.when(top > 0, F.coalesce(dcg(F.col("rows")), F.lit(0.0)) / top).otherwise(0.0).alias("ndcg"),
        (F.coalesce(F.col("hits"), F.lit(0)) > 0).alias("hit"),
    )


def per_query(rankings: DataFrame, judgments: DataFrame, ks: list[int] | None = None, topics: DataFrame | None = None) -> DataFrame:
    """(query_id, reciprocal_rank, average_precision, hit at the largest cut-off, n_retrieved, n_relevant)."""
    ks = fixed.CUTOFFS if ks is None else ks
    flagged = _flagged(rankings, judgments, topics)
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = flagged.withColumn("so_far", F.sum("rel").over(running)).where("rel = 1")
    sums = hits.groupBy("query_id").agg(F.min("rank").alias("first"), F.array_sort(F.collect_list(F.struct("rank", "so_far"))).alias("rows"))
    total = F.aggregate("rows", F.lit(0.0), lambda s, x: s + x["so_far"] / x["rank"])
    joined = _queries(rankings, judgments, topics).join(sums, "query_id", "left")
    return joined.select(
        "query_id",
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(F.col("n_relevant") > 0, F.coalesce(total, F.lit(0.0)) / F.col("n_relevant")).otherwise(0.0).alias("average_precision"),
        F.coalesce(F.col("first") <= max(ks), F.lit(False)).alias("hit"),
        "n_retrieved",
        "n_relevant",
    )


def evaluate(rankings: DataFrame, judgments: DataFrame, ks: list[int] | None = None, topics: DataFrame | None = None) -> DataFrame:
    """(metric, k, value): means over queries; k is null for mrr, map and hit_rate."""
    # both reports read the rankings, which may be a search over everything
    rankings = checkpoint(rankings.select("query_id", "rank", "doc_id"))
    one = per_query(rankings, judgments, ks, topics).agg(F.avg("reciprocal_rank").alias("mrr"), F.avg("average_precision").alias("map"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))
    one = one.select(F.expr("stack(3, 'mrr', mrr, 'map', map, 'hit_rate', hit_rate) as (metric, value)")).select("metric", F.lit(None).cast("int").alias("k"), F.coalesce("value", F.lit(0.0)).alias("value"))
    cut = at_k(rankings, judgments, ks, topics).groupBy("k").agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"), F.avg("ndcg").alias("n"))
    cut = cut.select("k", F.expr("stack(3, 'precision', p, 'recall', r, 'ndcg', n) as (metric, value)")).select("metric", "k", "value")
    return one.unionByName(cut)


def as_json(report: DataFrame) -> DataFrame:
    """The report as one JSON line."""
    named = report.select(F.concat_ws("@", "metric", "k").alias("name"), F.round("value", 4).alias("value"))
    return named.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value"))))).alias("json"))


def simulate(judgments: DataFrame, noise: int = 7, hit_rate: float = 0.6, cut: int = 10, topics: DataFrame | None = None) -> DataFrame:
    """Deterministic stand-in rankings: each relevant document appears with the hit rate, noise fills in, and the order comes from hashes.

    A query and a block of documents that share a topic are one row, of which the first ``cut`` documents are left, as a
    ranking has no more.
    """
    draw = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1_000_000)) / 1_000_000.0
    judged, of = _by_topic(judgments, topics)
    judged = judged.select("topic", F.col("doc_id").cast("string").alias("doc_id"))
    of = of.join(judged.select("topic").distinct(), "topic", "left_semi")
    n_blocks = F.ceil(judged.agg(F.count("*")).scalar() / BLOCK_DOCS).cast("int")
    blocks = judged.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.greatest(n_blocks, F.lit(32))))
    # a block meets many queries, so blocks are dealt out by number and not by their bytes
    parts = int(judgments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.repartition(parts, "topic", "block").groupBy("topic", "block").agg(F.collect_list("doc_id").alias("docs"))
    hit = F.filter("docs", lambda x: draw(F.col("query_id"), x, F.lit(1)) < hit_rate)
    ordered = F.sort_array(F.transform(hit, lambda x: F.struct(F.xxhash64(F.col("query_id"), x).alias("order"), x.alias("doc_id"))))
    pairs = blocks.join(of, "topic").select("query_id", F.explode(F.slice(ordered, 1, cut)).alias("x"))
    best = Window.partitionBy("query_id").orderBy("x.order", "x.doc_id")
    found = pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= cut).select("query_id", "x.doc_id", "place")
    padding = of.select("query_id").distinct().select("query_id", F.explode(F.sequence(F.lit(0), F.lit(noise - 1))).alias("i")).select("query_id", F.concat(F.lit("noise_"), F.col("i").cast("string")).alias("doc_id"), F.lit(0).alias("place"))
    lifted = found.unionByName(padding).withColumn("lift", (F.col("place") == 1) & (draw("query_id", F.lit(2)) < 0.5))
    order = Window.partitionBy("query_id").orderBy(F.desc("lift"), F.xxhash64("query_id", "doc_id"), "doc_id")
    return lifted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cut).select("query_id", "rank", "doc_id")


def summary(report: DataFrame) -> DataFrame:
    """The report as text, one line per metric (line), in a fixed order."""
    name = F.concat_ws("@", F.upper("metric"), "k")
    return report.select(F.format_string("%-14s %.4f", name, "value").alias("line"), "metric", "k").orderBy("metric", "k").select("line")
