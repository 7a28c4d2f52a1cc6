"""Contextual compression: the sentences of a chunk that answer a query, in document order and within a budget."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import text as tx
from textquarry.functions.shipping import bounded


_FOLDED = "struct<parts array<string>, kept_sentences int, total_sentences int, hit_count int>"


def _scores(sentences: list[list[str]], query: list[str]) -> list[float]:
    """The dot product takes idf once and the norms over the query's tokens with repeats, so scores can exceed 1."""
    counts = [Counter(w) for w in sentences]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log(max(len(sentences), 1) / (n + 1)) + 1 for t, n in df.items()}
    asked = Counter(query)
    q_norm = math.sqrt(sum(n * idf.get(t, 1.0) ** 2 for t, n in asked.items()))
    out = []
    for c in counts:
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        dot = sum(n * idf[t] for t, n in c.items() if t in asked)
        out.append(dot / (norm * q_norm) if norm * q_norm > 0 else 0.0)
    return out


def _within(places: list[int], sentences: list[str], max_chars: int) -> list[int]:
    """Places while the sentences before them take less than the budget; the last may run over it."""
    used, kept = 0, []
    for i in places:
        if used >= max_chars:
            break
        kept.append(i)
        used += len(sentences[i])
    return kept


def _carried(chunks: DataFrame, made: list[str]) -> list[Column]:
    return [F.col(f"`{c.replace('`', '``')}`") for c in chunks.columns if c not in ("query", "text", *made)]


def _folded(chunks: DataFrame, fold: Callable, counts: list[str], name: str) -> DataFrame:
    """One fold per row and no shuffle: rows that share a chunk_id stay apart, and further columns are passed through.

    A null or empty text is one empty sentence, with a ratio of 1; a null query has no words.  A text is a whole array
    value, so a row must fit in a batch of the Arrow exchange; batches are bounded, and a sentence's words are one string in them.
    """
    bounded(chunks.sparkSession)

    @F.pandas_udf(_FOLDED)
    def run(sentences, words, query):
        import pandas as pd

        rows = []
        for s, w, q in zip(sentences, words, query):
            s, w = ([], []) if s is None else (list(s), [x.split() for x in w])
            parts, kept, hits = fold(s, w, [] if q is None else q.split()) if s else ([], 0, 0)
            rows.append((parts, kept, len(s), hits))
        return pd.DataFrame(rows, columns=["parts", "kept_sentences", "total_sentences", "hit_count"])

    # a column of its own, as the split is used twice
    cut = chunks.withColumn("__s", tx.compression_sentences(F.col("text")))
    words = lambda c: F.array_join(tx.compression_tokens(c), " ")
    folded = run(F.col("__s"), F.transform("__s", words), words(F.col("query")))
    made = ["text", *counts, "compressor", "compression_ratio"]
    original, joined = F.coalesce("text", F.lit("")), F.array_join("__x.parts", " ")
    text = F.when(joined != "", joined).otherwise(original)
    return cut.withColumn("__x", folded).select(
        *_carried(chunks, made), text.alias("text"), *[F.col(f"__x.{c}").alias(c) for c in counts], F.lit(name).alias("compressor"), F.round(F.when(F.length(original) == 0, 1.0).otherwise(F.length(text) / F.length(original)), 3).alias("compression_ratio")
    )


def by_score(chunks: DataFrame, max_chars: int = 600, min_score: float = 0.05, min_sentences: int = 1) -> DataFrame:
    """Eligible sentences in document order while the budget lasts; the last may run over it.  chunks: chunk_id, query, text."""

    def fold(sentences, words, query):
        scores = _scores(words, query)
        eligible = [i for i, x in enumerate(scores) if x >= min_score]
        if len(eligible) < min_sentences:
            eligible = sorted(sorted(range(len(scores)), key=lambda i: (-scores[i], i))[:min_sentences])
        kept = _within(eligible, sentences, max_chars)
        return [sentences[i] for i in kept], len(kept), 0

    return _folded(chunks, fold, ["kept_sentences", "total_sentences"], "sentence_score")


def by_keywords(chunks: DataFrame, window: int = 2, max_chars: int = 800) -> DataFrame:
    """Sentences within ``window`` of one that shares a word with the query; gaps are marked, and no hit means the first two.

    ``kept_sentences`` counts what was chosen before the budget.
    """

    def fold(sentences, words, query):
        asked = set(query)
        hits = [i for i, w in enumerate(words) if not asked.isdisjoint(w)]
        near = {j for i in hits for j in range(i - window, i + window + 1)} if hits else {0, 1}
        chosen = [i for i in range(len(sentences)) if i in near]
        kept = _within(chosen, sentences, max_chars)
        parts = [f"... {sentences[i]}" if n and i > kept[n - 1] + 1 else sentences[i] for n, i in enumerate(kept)]
        return parts, len(chosen), len(hits)

    return _folded(chunks, fold, ["kept_sentences", "total_sentences", "hit_count"], "keyword_window")


def by_model(chunks: DataFrame, ask: Callable[[str, str], str] | None = None, skip_if_under: int = 300) -> DataFrame:
    """A model's extract; short texts pass, an empty or NONE reply and any failure fall back to the first 300 characters.  ``ask``: (query, text) to reply."""

    bounded(chunks.sparkSession)

    @F.pandas_udf("text string, compressor string")
    def run(queries, texts):
        import pandas as pd

        out = []
        for q, t in zip(queries, texts):
            t = t or ""
            if len(t) <= skip_if_under:
                out.append((t, "llm_skipped"))
                continue
            try:
                reply = (ask(q, t) if ask else "").strip()
            except Exception:  # a provider that fails must not stop the job
                reply = ""
            out.append((t[:300] if reply in ("", "NONE") else reply, "llm"))
        return pd.DataFrame(out, columns=["text", "compressor"])

    return chunks.withColumn("__x", run(F.col("query"), F.col("text"))).select(*_carried(chunks, ["compressor"]), "__x.text", "__x.compressor")


METHODS = {"sentence_score": by_score, "keyword_window": by_keywords, "llm": by_model}


def get_compressor(strategy: str = "sentence_score"):
    if strategy not in METHODS:
        raise ValueError(f"unknown strategy {strategy!r}; one of {sorted(METHODS)}")
    return METHODS[strategy]


def compress(chunks: DataFrame, strategies: list[str]) -> DataFrame:
    """One strategy after the other, each on what the last left: (chunk_id, text, original_text, pipeline_steps)."""
    if not strategies:
        raise ValueError("at least one strategy is needed")
    state = chunks.select("chunk_id", "query", "text", F.col("text").alias("original_text"), F.col("query").alias("asked"))
    for s in strategies:
        state = get_compressor(s)(state).select("chunk_id", F.col("asked").alias("query"), "text", "original_text", "asked")
    return state.select("chunk_id", "text", "original_text", F.lit(" -> ".join(strategies)).alias("pipeline_steps"))
