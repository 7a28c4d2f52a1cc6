"""Document sources.  All give id, title, text, source and format as far as the source has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASE_SCHEMA = "id string, title string, citation string, court string, date string, year int, category string, summary string, text string"


def json_cases(spark: SparkSession, path: str) -> DataFrame:
    """A file with a list of cases, or with an object that holds the list as ``cases``; anything else is an error."""
    listed = spark.read.schema(f"cases array<struct<{CASE_SCHEMA.replace(' string', ':string').replace(' int', ':int')}>>, {CASE_SCHEMA}").json(path, multiLine=True)
    kinds = listed.agg(F.count("cases").alias("wrapped"), F.count(F.coalesce("id", "text", "title")).alias("bare")).first()
    if kinds["wrapped"]:
        return listed.select(F.inline("cases"))
    if kinds["bare"]:
        return listed.drop("cases")
    raise ValueError("expected a list of cases or an object with 'cases'")


def title_of(stem: Column) -> Column:
    """Underscores and dashes become spaces; letters after anything but a letter are capitals."""
    spaced = F.translate(stem, "_-", "  ")
    parts = F.regexp_extract_all(spaced, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, F.initcap), "")


def _named(files: DataFrame, prefix: str, text: Column, extension: str) -> DataFrame:
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    stem = F.regexp_replace(F.url_decode(F.regexp_replace(name, r"\+", "%2B")), rf"(?i)\.{extension}$", "")
    return files.select(F.concat(F.lit(f"{prefix}_"), stem).alias("id"), title_of(stem).alias("title"), text.alias("text"), F.col("path").alias("source"), F.lit(prefix if prefix != "txt" else "text").alias("format"))


def text_cases(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return _named(files, "txt", F.col("value"), "txt")


def pdf_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Pages joined by empty lines.  Needs an optional PDF library on the executors; files that fail have null text and are dropped."""

    @F.pandas_udf("string")
    def read(contents):
        import io

        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF files needs pypdf on the executors") from e

        def one(raw):
            try:
                return "\n\n".join((p.extract_text() or "") for p in PdfReader(io.BytesIO(raw)).pages)
            except Exception:  # an unreadable file is skipped
                return None

        return contents.map(one)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return _named(files.withColumn("value", read("content")), "pdf", F.col("value"), "pdf").where("text is not null")


def benchmark_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query, relevant_ids) of a benchmark file."""
    raw = spark.read.schema("name string, description string, queries array<struct<query:string,relevant_ids:array<string>>>").json(path, multiLine=True)
    return raw.select(F.inline("queries"))


def sample_cases(spark: SparkSession) -> DataFrame:
    """A small built-in corpus for trials."""
    topics = ["contract breach", "negligence", "data protection", "copyright", "tenancy"]
    rows = [(f"sample_{i}", f"Sample v. Case {i}", f"{2000 + i} SC {i}", "Supreme Court" if i % 2 else "High Court", f"{2000 + i}-01-0{i % 9 + 1}", 2000 + i, topics[i % 5].title(), f"A dispute about {topics[i % 5]}.", f"The court considered {topics[i % 5]}. It held for the {'claimant' if i % 2 else 'respondent'}.") for i in range(10)]
    return spark.createDataFrame(rows, CASE_SCHEMA)
