"""Query expansion: synonyms, acronyms and pseudo-relevance feedback, and their chain."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import fixed
from textquarry.functions import text as tx

_TOKEN = re.compile("[a-z0-9]+(?:['-][a-z0-9]+)*")
_STOPS = frozenset(fixed.EXPANSION_STOPS)


@lru_cache(maxsize=1)
def _heads() -> dict[str, str]:
    """The first entry that offers a synonym; phrases are keyed with underscores, so no token meets them."""
    out: dict[str, str] = {}
    for head, offered in fixed.SYNONYMS.items():
        for s in offered:
            out.setdefault(s.replace(" ", "_"), head)
    return out


def _offers(token: str, vocabulary: dict[str, list[str]]) -> list[str]:
    """What may be added for a token: its synonyms, then the entry it is a synonym of."""
    if len(token) < 2 or token in _STOPS:
        return []
    head = _heads().get(token)
    return list(dict.fromkeys([*vocabulary.get(token, []), *([head] if head in vocabulary else [])]))


def add_synonyms(query: str, per_term: int = 2, vocabulary: dict[str, list[str]] | None = None) -> tuple[str, list[str]]:
    """The expanded query and the added synonyms; one whose words are all there already is passed over."""
    known = fixed.SYNONYMS if vocabulary is None else vocabulary
    tokens = _TOKEN.findall(query.lower())
    candidates = [(at, s, frozenset(_TOKEN.findall(s.lower()))) for at, t in enumerate(tokens) for s in _offers(t, known)]
    present, taken, extra = set(tokens), Counter(), []
    for at, s, words in candidates:
        if taken[at] < per_term and not words <= present:
            taken[at] += 1
            present |= words
            extra.append(s)
    return " ".join([query, *extra]).strip() if extra else query, extra


def synonyms_udf(per_term: int = 2, vocabulary: dict[str, list[str]] | None = None):
    """Arrow UDF over queries: struct<expanded, added>.  The fold over tokens has state, so it isn't an expression."""

    @F.pandas_udf("expanded string, added array<string>")
    def run(queries: pd.Series) -> pd.DataFrame:
        got = [add_synonyms(q or "", per_term, vocabulary) for q in queries]
        return pd.DataFrame({"expanded": [g[0] for g in got], "added": [sorted(set(g[1])) for g in got]})

    return run


def acronyms(query: Column, extra: dict[str, str] | None = None, keep_original: bool = True) -> Column:
    """struct<expanded, added>: every known acronym is followed (or replaced) by what it stands for."""
    known = fixed.ACRONYMS | {k.lower(): v for k, v in (extra or {}).items()}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    meaning = lambda w: F.element_at(table, F.regexp_replace(F.lower(w), r"^[.,;:!?]+|[.,;:!?]+$", ""))
    words = tx.split_words(query)
    said = F.transform(words, lambda w: F.when(meaning(w).isNull(), w).otherwise(F.concat_ws(" ", w, meaning(w)) if keep_original else meaning(w)))
    added = F.array_sort(F.array_distinct(F.filter(F.transform(words, meaning), lambda x: x.isNotNull())))
    return F.struct(F.array_join(said, " ").alias("expanded"), added.alias("added"))


def feedback_terms(queries: DataFrame, feedback: DataFrame, top_docs: int = 3, top_terms: int = 5, least_docs: int = 1) -> DataFrame:
    """(query_id, term, score, rank): terms of the first feedback documents by tf-idf, the query's own left out.

    queries: (query_id, query); feedback: (query_id, rank from 1, text).
    """
    docs = feedback.where(F.col("rank") <= top_docs).select("query_id", "rank", tx.expansion_tokens(F.col("text")).alias("w"))
    n_docs = docs.groupBy("query_id").agg(F.count("*").alias("docs"), F.greatest(F.sum(F.size("w")), F.lit(1)).alias("all"))
    rows = docs.select("query_id", "rank", F.explode("w").alias("term"))
    counts = rows.groupBy("query_id", "term").agg(F.count("*").alias("tf"), F.countDistinct("rank").alias("df")).where(F.col("df") >= least_docs)
    own = queries.select("query_id", F.explode(tx.expansion_tokens(F.col("query"))).alias("term"))
    fresh = counts.join(own, ["query_id", "term"], "left_anti").join(n_docs, "query_id")
    score = F.col("tf") / F.col("all") * F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("term"))
    return fresh.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms).select("query_id", "term", "score", "rank")


def feedback(queries: DataFrame, docs: DataFrame, **options) -> DataFrame:
    """(query_id, query, expanded, added) by pseudo-relevance feedback."""
    terms = feedback_terms(queries, docs, **options).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    joined = queries.join(terms, "query_id", "left")
    none = F.array().cast("array<string>")
    return joined.select("query_id", "query", F.when(F.col("terms").isNull(), F.col("query")).otherwise(F.concat_ws(" ", "query", F.array_join("terms", " "))).alias("expanded"), F.array_sort(F.coalesce("terms", none)).alias("added"))


EXPANDERS = ("synonym", "acronym", "prf")


def get_expander(name: str, **options):
    """The named expander as a function of queries (query_id, query) that gives (query_id, expanded, added).

    synonym: per_term, vocabulary; acronym: extra, keep_original; prf: docs and the options of ``feedback``.
    """
    if name == "synonym":
        return lambda queries: queries.withColumn("x", synonyms_udf(**options)(F.col("query"))).select("query_id", "x.expanded", "x.added")
    if name == "acronym":
        return lambda queries: queries.withColumn("x", acronyms(F.col("query"), **options)).select("query_id", "x.expanded", "x.added")
    if name != "prf":
        raise ValueError(f"unknown expander {name!r}; one of {sorted(EXPANDERS)}")
    docs = options.pop("docs", None)
    if docs is None:  # nothing to learn from: queries stay as they are
        return lambda queries: queries.select("query_id", F.col("query").alias("expanded"), F.array().cast("array<string>").alias("added"))
    return lambda queries: feedback(queries.select("query_id", "query"), docs, **options).select("query_id", "expanded", "added")


def all_terms(expanded: Column) -> Column:
    """The words of an expanded query, lower-cased."""
    return tx.split_words(F.lower(F.coalesce(expanded, F.lit(""))))


def expand(queries: DataFrame, steps: list[str], docs: DataFrame | None = None, per_term: int = 2, vocabulary: dict[str, list[str]] | None = None) -> DataFrame:
    """Applies the named expanders in turn: (query_id, original, expanded, added, steps)."""
    if not steps:
        raise ValueError("at least one expander is needed")
    unknown = [s for s in steps if s not in EXPANDERS]
    if unknown:
        raise ValueError(f"unknown expanders {unknown}; of {EXPANDERS}")
    none = F.array().cast("array<string>")
    state = queries.select("query_id", F.col("query").alias("original"), "query", none.alias("added"))
    for s in steps:
        if s == "prf":
            if docs is None:
                continue
            got = feedback(state.select("query_id", "query"), docs).select("query_id", "expanded", F.col("added").alias("more"))
            state = state.join(got, "query_id").select("query_id", "original", F.col("expanded").alias("query"), F.array_union("added", "more").alias("added"))
        else:
            got = (synonyms_udf(per_term, vocabulary)(F.col("query")) if s == "synonym" else acronyms(F.col("query"))).alias("x")
            state = state.withColumn("x", got).select("query_id", "original", F.col("x.expanded").alias("query"), F.array_union("added", "x.added").alias("added"))
    return state.select("query_id", "original", F.col("query").alias("expanded"), F.array_sort("added").alias("added"), F.array(*[F.lit(s) for s in steps]).alias("steps"))
