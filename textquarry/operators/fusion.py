"""Passage fusion: sentence windows to parents, query variants, and hypothetical passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import fixed
from textquarry.functions import text as tx

from . import rerank
from .expand import synonyms_udf


def window_index(parents: DataFrame, window: int = 3, overlap: bool = True, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, text, parent_id, window_start): windows of sentences, one step apart or side by side; short tail windows stay."""
    held = parents.select(F.col(id_col).alias("parent_id"), tx.plain_sentences(F.col(text_col)).alias("s")).where(F.size("s") > 0)
    starts = F.posexplode(F.sequence(F.lit(0), F.size("s") - 1, F.lit(1 if overlap else window)))
    rows = held.select("parent_id", "s", starts.alias("i", "window_start"))
    return rows.select(F.concat(F.col("parent_id").cast("string"), F.lit("_w"), F.col("i").cast("string")).alias("id"), F.array_join(F.slice("s", F.col("window_start") + 1, F.lit(window)), " ").alias("text"), "parent_id", "window_start")


def window_counts(children: DataFrame) -> DataFrame:
    """One row: parent_count and child_count of a window index; parents without a sentence have no windows."""
    return children.agg(F.countDistinct("parent_id").alias("parent_count"), F.count("*").alias("child_count"))


def fuse_windows(hits: DataFrame, children: DataFrame, top: int = 5) -> DataFrame:
    """Parents by the sum of their children's scores; hits: (query_id, pos, id, score); unknown children are ignored."""
    joined = hits.join(children.select("id", "parent_id"), "id")
    grouped = joined.groupBy("query_id", "parent_id").agg(F.sum("score").alias("aggregated_score"), F.count("*").alias("matched_children"), F.min("pos").alias("pos"))
    order = Window.partitionBy("query_id").orderBy(F.desc("aggregated_score"), "pos")
    return grouped.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("pos")


def variants(queries: DataFrame, limit: int = 5, query_col: str = "query") -> DataFrame:
    """Adds ``variants``, an array: the query, its keywords, its words reversed, question forms and the synonym form, each once."""
    if limit < 1:
        raise ValueError("the limit is at least 1")
    query = F.coalesce(F.col(query_col), F.lit(""))
    words = tx.split_words(query)
    first = F.lower(F.get(words, F.lit(0)))
    asked = F.coalesce(first.isin("what", "how", "why", "when", "where", "who"), F.lit(False))
    forms = [
        query,
        F.array_join(tx.variant_keywords(query), " "),
        F.array_join(F.reverse(words), " "),
        F.when(~asked, F.concat(F.lit("What is "), query)),
        F.when(~asked, F.concat(F.lit("How does "), query)),
        F.col("__synonyms.expanded"),
    ]
    held = queries.withColumn("__synonyms", synonyms_udf(1)(F.col(query_col)))
    # the generator below keeps the forms from being evaluated once per comparison
    rows = held.withColumn("__f", F.array(*[f if i == 0 else tx.strip(f) for i, f in enumerate(forms)]))
    rows = rows.withColumn("__k", F.transform("__f", lambda f: F.lower(tx.strip(f))))
    unique = F.filter(F.arrays_zip("__f", "__k"), lambda x: F.lit(True))
    kept = F.transform(F.filter(F.transform(unique, lambda x, i: F.struct(x["__f"].alias("v"), x["__k"].alias("k"), i.alias("i"))), lambda x: (x["i"] == 0) | ((x["k"] != "") & (F.array_position("__k", x["k"]) == x["i"] + 1))), lambda x: x["v"])
    return rows.withColumn("variants", F.slice(kept, 1, limit)).drop("__f", "__k", "__synonyms")


def fuse_variants(lists: DataFrame, k: int = fixed.RRF_K, top: int = 10) -> DataFrame:
    """Fuses one ranked list per variant, (query_id, list_no, rank, id)."""
    hits = lists.where("id is not null").groupBy("query_id", "id").agg(F.countDistinct("list_no").alias("variant_hits"))
    return rerank.rrf(lists, k, top, digits=None).join(hits, ["query_id", "id"])


def retrieve_variants(queries: DataFrame, retrieve, limit: int = 5, k: int = fixed.RRF_K, top: int = 10) -> DataFrame:
    """Asks ``retrieve`` once with all variants of all queries (query_id, query), and fuses what it finds per query.

    ``retrieve`` takes (query_id, query) and gives (query_id, rank, id).
    """
    asked = variants(queries, limit).select("query_id", F.posexplode("variants").alias("list_no", "query"))
    found = retrieve(asked.select(F.struct("query_id", "list_no").alias("query_id"), "query"))
    return fuse_variants(found.select("query_id.query_id", "query_id.list_no", "rank", "id"), k, top)


def hypothesis(query: Column, domain: str = "legal") -> Column:
    return F.format_string(fixed.HYPOTHESIS, F.lit(domain), query)


def fuse_hypothesis(query_hits: DataFrame, hypothesis_hits: DataFrame, alpha: float = 0.3, k: int = fixed.RRF_K) -> DataFrame:
    """Weighted fusion of (query_id, rank, id) lists; the result is cut to the longer list, 10 at least."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies in [0, 1]")
    both = query_hits.select("query_id", F.lit(0).alias("list_no"), "rank", "id", F.lit(1.0 - alpha).alias("weight")).unionByName(hypothesis_hits.select("query_id", F.lit(1).alias("list_no"), "rank", "id", F.lit(float(alpha)).alias("weight")))
    cut = both.groupBy("query_id", "list_no").agg(F.count("*").alias("n")).groupBy("query_id").agg(F.greatest(F.max("n"), F.lit(10)).alias("cut"))
    return rerank.rrf(both, k, None, digits=None).join(cut, "query_id").where(F.col("rrf_rank") <= F.col("cut")).drop("cut")


METHODS = {"sentence_window": fuse_windows, "multi_query": fuse_variants, "hyde": fuse_hypothesis}


def get_fusion(method: str = "multi_query"):
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {sorted(METHODS)}")
    return METHODS[method]
