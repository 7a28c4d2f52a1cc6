"""Text kernels as column expressions.  Families of operators tokenise differently; none is unified with another.

Null text counts as empty everywhere.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _words(text: Column, pattern: str, stops: list[str], least: int) -> Column:
    found = F.regexp_extract_all(F.lower(_text(text)), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= least) & ~w.isin(stops)) if stops else found


def rerank_tokens(text: Column) -> Column:
    return _words(text, "[a-z]+", fixed.RERANK_STOPS, 2)


def dedup_tokens(text: Column) -> Column:
    return _words(text, "[a-z0-9]+", fixed.DEDUP_STOPS, 2)


def compression_tokens(text: Column) -> Column:
    return _words(text, r"(?U)\b[a-z]{2,}\b", fixed.COMPRESSION_STOPS, 2)


def raw_tokens(text: Column) -> Column:
    return _words(text, "[a-z0-9]+(?:['-][a-z0-9]+)*", [], 1)


def expansion_tokens(text: Column) -> Column:
    return _words(text, "[a-z0-9]+(?:['-][a-z0-9]+)*", fixed.EXPANSION_STOPS, 2)


def strip(text: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(_text(text), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def split_words(text: Column) -> Column:
    """Runs of non-space; empty text gives an empty array."""
    return F.filter(F.split(strip(text), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def variant_keywords(text: Column) -> Column:
    return F.filter(split_words(text), lambda w: ~F.lower(w).isin(fixed.VARIANT_STOPS))


def normalized(text: Column) -> Column:
    """White space runs made single spaces, ends stripped."""
    return F.regexp_replace(strip(text), r"(?U)[\s\x1c-\x1f]+", " ")


def _boundary(abbreviations: list[str]) -> str:
    quoted = [re.escape(a) for a in abbreviations]
    behind, ahead = "".join(f"(?<!{a})" for a in quoted), "".join(f"(?!{a})" for a in quoted)
    return rf"(?U)(?<=[.!?]){behind}\s+(?=[A-Z(\[" + '"' + rf"]){ahead}"


def _sentences(text: Column, abbreviations: list[str]) -> Column:
    return F.filter(F.transform(F.split(_text(text), _boundary(abbreviations), -1), strip), lambda s: s != "")


def sentences(text: Column) -> Column:
    """Sentences for chunking; abbreviations neither end nor start one."""
    return _sentences(text, fixed.CHUNK_ABBREVIATIONS)


def compression_sentences(text: Column) -> Column:
    """Sentences for compression: more abbreviations, and an empty text is one empty sentence."""
    found = _sentences(text, fixed.COMPRESSION_ABBREVIATIONS)
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def plain_sentences(text: Column) -> Column:
    """Sentences for passage windows: any white space after a stop."""
    return F.filter(F.split(strip(text), r"(?U)(?<=[.!?])\s+", -1), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(_text(text), r"(?U)\n\s*\n", -1), strip), lambda s: s != "")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(_text(text)) / 4)).cast("bigint")


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(_text(text).cast("binary"), 256), 1, 16)


def sha64(text: Column) -> Column:
    """The first 8 bytes of SHA-256 as a signed long."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 16), 16, -10).cast("bigint")


def md5_low(text: Column) -> Column:
    """The low 32 bits of MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 25, 8), 16, 10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def shingle_rows(docs: DataFrame, id_col: str, text_col: str, k: int = 3) -> DataFrame:
    """(id, pos, shingle), with repeats; texts of fewer than k tokens give their tokens."""
    tokens = docs.select(F.col(id_col).alias("id"), dedup_tokens(F.col(text_col)).alias("w"))
    held = tokens.select("id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.when(F.size("w") < k, F.size("w")).otherwise(F.size("w") - k + 1), F.lit(1)) - 1)).alias("pos"))
    shingle = F.when(F.size("w") < k, F.get("w", F.col("pos"))).otherwise(F.array_join(F.slice("w", F.col("pos") + 1, F.lit(k)), " "))
    return held.select("id", "pos", shingle.alias("shingle")).where(F.col("shingle").isNotNull())


def term_rows(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(id, term, tf, n) of a token array."""
    rows = docs.select(F.col(id_col).alias("id"), tokens.alias("w")).select("id", F.size("w").alias("n"), F.explode("w").alias("term"))
    return rows.groupBy("id", "n", "term").agg(F.count("*").alias("tf"))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of doubles; 0 where a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    norm = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when(norm > 0, dot / norm).otherwise(0.0)
