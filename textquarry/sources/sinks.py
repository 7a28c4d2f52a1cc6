"""Vector tables and exports.  A vector table is Parquet with columns id, text, embedding, metadata, version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXPORT_COLUMNS = ["title", "citation", "court", "date", "category", "score", "summary"]


def without_text(metadata: str = "metadata"):
    return F.map_filter(metadata, lambda k, v: k != "text")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def latest(df: DataFrame) -> DataFrame:
    """The newest version of each id."""
    rest = [F.xxhash64(c) for c, kind in df.dtypes if c not in ("id", "version") and not kind.startswith("map")]  # among equal versions, any but always the same
    order = Window.partitionBy("id").orderBy(F.desc("version"), *rest)
    return df.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def upsert(table: DataFrame, new: DataFrame, text_limit: int = 1000) -> DataFrame:
    """Both together, the newest version of each id; texts in the table are cut to the limit as its metadata would be."""
    return latest(table.unionByName(new.withColumn("text", F.substring("text", 1, text_limit))))


def delete(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id").distinct(), "id", "left_anti")


def write_csv(results: DataFrame, path: str) -> None:
    results.select(*EXPORT_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def as_json(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct("*")).alias("json"))


def citations(results: DataFrame) -> DataFrame:
    """One row: the non-empty citations, a line each, in order."""
    kept = results.where(F.coalesce("citation", F.lit("")) != "")
    return kept.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "citation"))), lambda x: x["citation"]), "\n").alias("citations"))


def chunk_text(text: str, size: int = 1000, overlap: int = 200) -> list[str]:
    """One text cut the plain way, as ingestion cuts by default."""
    from textquarry.operators import chunking

    return [piece for piece, _, _, _ in chunking.recursive(text, size, overlap)]


def ingest(docs: DataFrame, chunk_size: int = 1000, strategy: str = "recursive", id_col: str = "id", text_col: str = "text", embed=None, path: str | None = None) -> DataFrame:
    """Chunks texts longer than the size (short ones stay whole), embeds, and returns rows for a vector table.

    Every row keeps the other columns of its document; chunks are named id_index and have parent_id, chunk_index,
    total_chunks, chunk_start and chunk_end besides.  ``path``: appended there too, as rows of a vector table.
    """
    from textquarry.operators import chunking, vector

    options = {"fixed": {"size": chunk_size, "overlap": min(200, chunk_size // 5)}, "recursive": {"size": chunk_size, "overlap": min(200, chunk_size // 5)}, "sentence": {"size": chunk_size}, "structure": {"size": chunk_size}}.get(strategy, {})
    added = ("id", "parent_id", "text", "chunk_index", "total_chunks", "chunk_start", "chunk_end")
    parents = [c for c in docs.columns if c not in (id_col, text_col, *added)]
    long = F.length(F.coalesce(text_col, F.lit(""))) > chunk_size
    held = docs.select(F.struct(id_col, *parents).alias("__doc"), F.col(text_col).alias("__text"), long.alias("__long"))
    cut = chunking.chunk(held.where("__long"), strategy, "__doc", "__text", **options)
    # the pieces of a text leave the chunker together, so their number needs no shuffle of texts
    total = cut.groupBy(F.xxhash64(F.to_json("id")).alias("__h")).agg(F.count("*").alias("total_chunks"))
    ends = [F.col(c).cast("bigint") if c in cut.columns else F.lit(None).cast("bigint") for c in ("start_char", "end_char")]
    key = F.col("id")[id_col].cast("string")
    pieces = cut.withColumn("__h", F.xxhash64(F.to_json("id"))).join(total, "__h").select(
        F.concat_ws("_", key, "chunk_index").alias("id"), key.alias("parent_id"), "text", "chunk_index", "total_chunks", ends[0].alias("chunk_start"), ends[1].alias("chunk_end"), *[F.col("id")[c].alias(c) for c in parents]
    )
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    whole = held.where(~F.col("__long")).select(
        F.col("__doc")[id_col].cast("string").alias("id"), none("parent_id", "string"), F.col("__text").alias("text"), none("chunk_index", "int"), none("total_chunks", "bigint"), none("chunk_start", "bigint"), none("chunk_end", "bigint"), *[F.col("__doc")[c].alias(c) for c in parents]
    )
    rows = pieces.unionByName(whole)
    rows = vector.embed(rows, embed_fn=embed) if embed else vector.embed(rows)
    if path is not None:
        append(as_table(rows), path)
    return rows


def as_table(rows: DataFrame, version: int = 1, text_limit: int = 1000) -> DataFrame:
    """Rows of a vector table: all columns but id, text and embedding become metadata; texts are cut to the limit."""
    others = [c for c in rows.columns if c not in ("id", "text", "embedding")]
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in others]) if others else F.array().cast("array<struct<key:string,value:string>>")
    known = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return rows.select(F.col("id").cast("string").alias("id"), F.substring("text", 1, text_limit).alias("text"), "embedding", known.alias("metadata"), F.lit(version).cast("bigint").alias("version"))


def add_cases(cases: DataFrame, path: str, embed=None) -> DataFrame:
    """Embeds cases and appends them to the vector table at ``path``; a null id becomes a name made of the citation."""
    from textquarry.operators import vector

    named = cases.withColumn("id", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("case_"), F.md5(F.coalesce("citation", "text", F.lit("")).cast("binary")))))
    rows = vector.embed(named, embed_fn=embed) if embed else vector.embed(named)
    append(as_table(rows), path)
    return rows


def add_case(spark, case: dict, path: str, embed=None) -> DataFrame:
    """The same for a single case."""
    from .readers import CASE_SCHEMA

    names = [f.split()[0] for f in CASE_SCHEMA.split(",")]
    return add_cases(spark.createDataFrame([tuple(case.get(n) for n in names)], CASE_SCHEMA), path, embed)


def init_database(spark, path: str, embed=None) -> DataFrame:
    """A vector table of the sample cases, in place of what is at ``path``; returns it as read back."""
    from textquarry.operators import vector

    from .readers import sample_cases

    cases = sample_cases(spark)
    as_table(vector.embed(cases, embed_fn=embed) if embed else vector.embed(cases)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
