"""Exact token counts through a histogram of encoded lengths.

Every document is encoded whole; a task keeps only how many documents have which length,
and the histogram is summed over tasks.  Sums over it, from the long end, answer totals,
quantiles and truncated totals for every context limit.  The histogram has at most as many rows as
the longest document has tokens, whatever the number of documents.

Null and empty texts have length 0 and count as documents; an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens


def length_histogram(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(length, n_docs) of the encoded texts."""
    path = vocabulary or tokens.default_path()

    def run(batches):
        lengths = tokens.encoder(path).lengths
        counts: Counter[int] = Counter()
        for batch in batches:
            for _, _, texts in tokens.text_groups(batch.column(0)):
                counts.update(lengths(texts).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["length", "n"])

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "length long, n long")
    return parts.groupBy("length").agg(F.sum("n").alias("n_docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit: what lies beyond it and what truncation keeps.

    Columns: context_limit, n_docs of that length, docs_within, docs_over, tokens_total, tokens_truncated
    (each document cut to the limit), tokens_lost, quantile (share of documents within).
    """
    up = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("t"))
    h = h.withColumns({"docs_from": F.sum("n_docs").over(down), "tokens_from": F.sum("t").over(down)})
    h = h.withColumns({"docs_within": F.sum("n_docs").over(up), "tokens_within": F.sum("t").over(up)})
    over = F.col("docs_from") - F.col("n_docs")
    total = F.col("tokens_within") + F.col("tokens_from") - F.col("t")
    kept = F.col("tokens_within") + F.col("length") * over
    return h.select(
        F.col("length").alias("context_limit"),
        "n_docs",
        "docs_within",
        over.alias("docs_over"),
        total.alias("tokens_total"),
        kept.alias("tokens_truncated"),
        (total - kept).alias("tokens_lost"),
        (F.col("docs_within") / (F.col("docs_within") + over)).alias("quantile"),
    )


def answer(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, tokens_truncated, docs_over) for any limits, one pass over the histogram."""
    asked = F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in limits])).alias("context_limit")
    rows = histogram.select("length", "n_docs", asked)
    return rows.groupBy("context_limit").agg(
        F.sum(F.least("length", "context_limit") * F.col("n_docs")).alias("tokens_truncated"), F.coalesce(F.sum(F.when(F.col("length") > F.col("context_limit"), F.col("n_docs"))), F.lit(0)).alias("docs_over")
    )
