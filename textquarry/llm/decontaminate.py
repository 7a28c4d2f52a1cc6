"""Benchmark decontamination with DataFrame functions only.

The windows of the benchmark's items form a hash set; its table is broadcast where its measured bytes allow.
Each document is read once: its words are hashed per window start, a bitmap of the set's hashes
(of a fixed greatest size, so that it can be held by every task) sorts out nearly all starts
inside the row, and only the windows that are left, each with its own words and nothing
else of the document, are looked up and compared word for word.  Time and memory are linear in the
document, however long it is.

Nulls and empty texts have no words.  Repeated rows and repeated or null ids each keep
their own result row.  Items with null ids still mark words, but aren't named.  An empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_BYTES, bitmap, in_bitmap, quoted, replayable, with_row_id

#: What lies between words once A-Z is lower-cased.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; the fast built-in serves where no other letter would change."""
    return F.when(text.rlike(r"[\p{Lu}\p{Lt}\p{IsUppercase}&&[^\x00-\x7F]]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATOR), ""), F.array().cast("array<string>"))


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _window_hash(hashes: Column, at: Column | int, n: int) -> Column:
    return F.xxhash64(*[F.get(hashes, at + j) for j in range(n)])


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", ngram: int = 10) -> DataFrame:
    """(hash, len, window, items): the distinct windows; an item shorter than ``ngram`` is one window."""
    items = benchmark.select(quoted(item_col).cast("string").alias("item"), words_of(quoted(text_col)).alias("w")).where(F.size("w") > 0)
    windows = items.select("item", F.least(F.size("w"), F.lit(ngram)).alias("len"), "w").select(
        "item", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda p: F.slice("w", p, F.col("len")))).alias("window")
    )
    grouped = windows.groupBy("len", "window").agg(F.collect_set("item").alias("items"))
    return grouped.select(_window_hash(_word_hashes(F.col("window")), 0, ngram).alias("hash"), "len", "window", "items")


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", ngram: int = 10, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: id, n_words, n_hit, spans (word positions, end exclusive), items, and ``keep`` columns as struct ``kept``."""
    windows = benchmark_windows(benchmark, item_col, item_text_col, ngram)
    bytes_of = F.sum(F.octet_length(F.array_join("window", " ")) + F.octet_length(F.array_join("items", " ")) + 48 + 16 * (F.size("window") + F.size("items")))
    sizes = windows.groupBy("len").agg(F.count("*").alias("n"), bytes_of.alias("bytes")).collect()  # at most ngram rows
    lengths = sorted(r["len"] for r in sizes) or [ngram]
    held, bits = bitmap(windows, "hash", sum(r["n"] for r in sizes))
    if sum(r["bytes"] for r in sizes) <= BROADCAST_BYTES:
        windows = F.broadcast(windows)
    source = replayable(docs)
    rows = with_row_id(source.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), F.struct(*[quoted(c) for c in keep] or [F.lit(0).alias("none")]).alias("kept")))
    rows = rows.select("__rid", "id", "kept", words_of(F.col("text")).alias("words"), held.alias("bits"))
    rows = rows.withColumn("hashes", _word_hashes(F.col("words")))

    def starts(n: int) -> Column:
        whole = F.transform("hashes", lambda h, i: F.xxhash64(h, *[F.get("hashes", i + j) for j in range(1, n)]))
        marked = F.transform(whole, lambda h, i: F.when(in_bitmap(h, F.col("bits"), bits) & (i <= F.size("words") - n), i))
        left = F.filter(marked, lambda i: i.isNotNull())
        return F.transform(left, lambda i: F.struct(F.lit(None).cast(row_type).alias("row"), F.lit(n).alias("len"), i.alias("start"), F.slice("words", i + 1, n).alias("window")))

    row_type = rows.select(F.struct("id", "kept", F.size("words").alias("n_words")).alias("row")).schema["row"].dataType
    itself = F.struct(F.struct("id", "kept", F.size("words").alias("n_words")).alias("row"), F.lit(0).alias("len"), F.lit(0).alias("start"), F.array().cast("array<string>").alias("window"))
    # The first element stands for the document itself, so that one pass returns documents and hits.
    found = rows.select("__rid", F.explode(F.concat(F.array(itself), *[starts(n) for n in lengths])).alias("x")).select("__rid", "x.*")
    # a document's own row meets no window, as it has no words; its row id spreads it if the join is by shuffle
    found = found.withColumn("hash", F.when(F.col("row").isNull(), _window_hash(_word_hashes(F.col("window")), 0, ngram)).otherwise(F.xxhash64("__rid")))
    met = found.join(windows.withColumnsRenamed({"hash": "h", "window": "known", "len": "l"}), (F.col("hash") == F.col("h")) & (F.col("window") == F.col("known")), "left")
    hits = met.where(F.col("row").isNotNull() | F.col("items").isNotNull())
    per_doc = hits.select("__rid", "row", F.when(F.col("items").isNotNull(), F.struct("start", (F.col("start") + F.col("len")).alias("end"))).alias("span"), "items")
    grouped = per_doc.groupBy("__rid").agg(
        F.first("row", ignorenulls=True).alias("row"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("reach")),
        lambda a, x: F.struct((a["hit"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["reach"], x["start"]))).alias("hit"), F.greatest(a["reach"], x["end"]).alias("reach")),
        lambda a: a["hit"],
    )
    return grouped.select(F.col("row.id").alias(id_col), F.col("row.n_words").cast("bigint").alias("n_words"), covered.cast("bigint").alias("n_hit"), "spans", "items", F.col("row.kept").alias("kept"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", mode: str = "documents", min_share: float = 0.0, **names) -> DataFrame:
    """``docs`` without what the benchmark holds, its columns unchanged.

    ``documents`` drops rows whose share of hit words is above ``min_share``; ``spans``
    keeps every row and replaces a hit text by its remaining words, lower-cased and joined by spaces.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is 'documents' or 'spans'")
    columns = docs.columns
    found = contamination(docs, benchmark, id_col, text_col, keep=tuple(columns), **names)
    if mode == "documents":
        return found.where(F.col("n_hit") <= F.lit(min_share) * F.col("n_words")).select("kept.*")
    text = F.col("kept")[text_col]
    hit = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1))))
    left = F.array_except(F.sequence(F.lit(0), F.size("w") - 1), hit)
    out = found.withColumn("w", words_of(text)).withColumn("left", F.when(F.col("n_hit") > 0, F.array_join(F.transform(left, lambda i: F.get("w", i)), " ")).otherwise(text))
    return out.select(*[F.col("left").alias(c) if c == text_col else F.col("kept")[c].alias(c) for c in columns])
