"""Exact vector search with metadata filters."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions.shipping import bounded
from textquarry.functions.text import strip

#: Numbers in a block of vectors, on each side of a search: 32,768 vectors of 64.
BLOCK_VALUES = 1 << 21
#: Queries and vectors whose products are held at once, and pairs that are scored exactly at once.
QUERY_STEP, VECTOR_STEP, EXACT_STEP = 1024, 8192, 1 << 17


def build_filter(filters: dict | None) -> Column:
    """A predicate the scan can take: year range only if both ends are set; the two 'all' values switch a list off."""
    filters = filters or {}
    out = F.lit(True)
    low, high = filters.get("year_from"), filters.get("year_to")
    if low and high:
        out = out & F.col("year").between(low, high)
    for column, all_value in (("court", "All Courts"), ("category", "All Categories")):
        chosen = filters.get(f"{column}s") or []
        if chosen and all_value not in chosen:
            out = out & F.col(column).isin(list(chosen))
    return out


def predicate(tree: dict) -> Column:
    """The predicate language of nested dicts: $gte, $lte, $in, $and, and bare equality."""
    if "$and" in tree:
        out = F.lit(True)
        for part in tree["$and"]:
            out = out & predicate(part)
        return out
    out = F.lit(True)
    for column, test in tree.items():
        c = F.col(column)
        if not isinstance(test, dict):
            out = out & (c == test)
            continue
        for op, value in test.items():
            if op == "$gte":
                out = out & (c >= value)
            elif op == "$lte":
                out = out & (c <= value)
            elif op == "$in":
                out = out & c.isin(list(value))
            else:
                raise ValueError(f"unknown operator {op}")
    return out


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """(rows of doubles padded with zeros, their lengths) of a list column; null rows, and rows that hold a null, are zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    values = np.asarray(lists.flatten().cast(pa.float64()).fill_null(0.0))
    holes = np.asarray(pc.is_null(lists.flatten()))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    out[row[holes]] = 0.0
    return out, sizes


def _in_order(column) -> np.ndarray:
    """Places of the values in the order of Spark's sort, nulls first."""
    try:
        return np.asarray(pc.sort_indices(column, null_placement="at_start"))
    except pa.ArrowNotImplementedError:
        key = lambda x: (0,) if x is None else (1, [key(y) for y in x.values()]) if isinstance(x, dict) else (1, [key(y) for y in x]) if isinstance(x, list) else (1, x)
        held = column.to_pylist()
        return np.array(sorted(range(len(held)), key=lambda i: key(held[i])), np.int64)


class _Side:
    """The vectors of one side of a block: by dimension, with norms added up as ``cosine`` does, and of length one in single precision."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray):
        self.sizes, self.by_dim = sizes, np.ascontiguousarray(rows.T)
        square = np.zeros(len(rows))
        with np.errstate(over="ignore"):
            for x in self.by_dim:
                square += x * x
        self.norm = np.sqrt(square)
        self.unit = np.divide(rows, self.norm[:, None], out=np.zeros_like(rows), where=self.norm[:, None] > 0).astype(np.float32)
        # what single precision can't judge is passed on to the exact score
        self.unit[~((self.norm > 1e-100) & (self.norm < 1e100)) & (self.norm != 0)] = np.nan

    def padded(self, width: int) -> _Side:
        more = width - len(self.by_dim)
        self.by_dim, self.unit = np.pad(self.by_dim, ((0, more), (0, 0))), np.pad(self.unit, ((0, 0), (0, more)))
        return self


def _exact(q: _Side, v: _Side, qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
    """``cosine`` of pairs, to the last bit; minus infinity stands for null, which vectors of unequal length give."""
    dot = np.zeros(len(qi))
    for x, y in zip(v.by_dim, q.by_dim):
        dot += x[vi] * y[qi]
    norm = v.norm[vi] * q.norm[qi]
    score = np.divide(dot, norm, out=np.zeros_like(dot), where=~(norm <= 0))
    return np.where((v.sizes[vi] != q.sizes[qi]) & ~(norm <= 0), -np.inf, score)


def _first_k(qi: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by query and falling score, NaN first and else as given; place in the query)."""
    order = np.lexsort((np.where(np.isnan(score), -np.inf, -score), ~np.isnan(score), qi))
    held = qi[order]
    return order, np.arange(len(held)) - np.searchsorted(held, held)


def _nearest(q: _Side, v: _Side, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k best of ``v``, whose rows are in the order that breaks ties.

    Products in single precision sort out what can't be among them, by the best k so far less the error; what is left is scored exactly.
    """
    width = max(len(q.by_dim), len(v.by_dim))
    q, v = q.padded(width), v.padded(width)
    margin = np.float32((width + 8) * 2.5e-7)
    uneven = len(np.unique(np.concatenate([q.sizes, v.sizes]))) > 1
    found = []
    with np.errstate(invalid="ignore", over="ignore"):
        for a in range(0, len(q.norm), QUERY_STEP):
            asked, n = q.unit[a : a + QUERY_STEP], len(q.norm[a : a + QUERY_STEP])

            def product(lo: int, hi: int, a=a, asked=asked, n=n) -> np.ndarray:
                s = asked @ v.unit[lo:hi].T
                if uneven:
                    s[(q.sizes[a : a + n, None] != v.sizes[None, lo:hi]) & (q.norm[a : a + n, None] != 0) & (v.norm[None, lo:hi] != 0)] = -np.inf
                return s

            least = np.full(n, -np.inf, np.float32)
            seed = max(1024, 4 * k)
            if seed < len(v.norm):
                least = np.partition(product(0, seed), seed - k, axis=1)[:, seed - k] - margin
            qi, vi, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for lo in range(0, len(v.norm), VECTOR_STEP):
                hi = min(lo + VECTOR_STEP, len(v.norm))
                # not below, so that NaN stays
                at = np.flatnonzero(~(product(lo, hi) < least[:, None]))
                i, j = np.divmod(at, hi - lo)
                for c in range(0, len(i), EXACT_STEP):
                    one, two = i[c : c + EXACT_STEP], j[c : c + EXACT_STEP] + lo
                    qi, vi, score = np.append(qi, one), np.append(vi, two), np.append(score, _exact(q, v, one + a, two))
                    order, place = _first_k(qi, score, k)
                    order = order[place < k]
                    qi, vi, score = qi[order], vi[order], score[order]
                full = np.bincount(qi, minlength=n) >= k
                last = np.cumsum(np.bincount(qi, minlength=n)) - 1
                least[full] = np.fmax(least[full], (score[last[full]] - margin).astype(np.float32))
            found.append((qi + a, vi, score))
    return tuple(np.concatenate(x) for x in zip(*found))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, where: Column | None = None, id_col: str = "id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query_vector", n_queries: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k nearest by cosine, ties by id.  ``n_queries``: spares counting them, if known.

    Exact, so every pair is looked at: both sides are dealt into blocks of bounded size, a task takes one block of each, and
    only k rows of a query leave it.
    """
    kept = (vectors if where is None else vectors.where(where)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("qv"))
    size = lambda df, c: df.agg(F.struct(F.count("*").alias("n"), F.coalesce(F.max(F.size(c)), F.lit(0)).alias("dim")).alias("x")).scalar()
    v_size = size(kept, "v")
    q_count = size(q, "qv")["n"] if n_queries is None else F.lit(n_queries)
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n * F.greatest(v_size["dim"], F.lit(1)) / BLOCK_VALUES)).cast("int")
    n_v, n_q = blocks(v_size["n"]), blocks(q_count)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = q.withColumn("__q", F.pmod(F.xxhash64("query_id", "qv"), n_q).cast("int")).withColumn("__v", every(n_v))
    right = kept.withColumn("__v", F.pmod(F.xxhash64("id", "v"), n_v).cast("int")).withColumn("__q", every(n_q))
    kinds = {f.name: f for f in [*q.schema.fields, *kept.schema.fields]}
    schema = T.StructType([kinds["query_id"], kinds["id"], T.StructField("score", T.DoubleType())])

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        qi = vi = np.zeros(0, np.int64)
        score = np.zeros(0)
        if asked.num_rows and held.num_rows:
            held = held.take(pa.array(_in_order(held["id"])))
            rows, sizes = _matrix(held["v"])
            # of equal vectors only the k first can be among the k best
            key = np.concatenate([rows, sizes[:, None]], axis=1)
            same = np.unique(key.view(np.dtype((np.void, key.shape[1] * 8))).ravel(), return_inverse=True)[1]
            order, place = _first_k(same, np.zeros(len(same)), k)
            stay = np.sort(order[place < k])
            qi, vi, score = _nearest(_Side(*_matrix(asked["qv"])), _Side(rows[stay], sizes[stay]), k)
            vi = stay[vi]
        return pa.table({"query_id": asked["query_id"].take(pa.array(qi)), "id": held["id"].take(pa.array(vi)), "score": pa.array(score, mask=np.isneginf(score))})

    scored = left.groupBy("__v", "__q").cogroup(right.groupBy("__v", "__q")).applyInArrow(run, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(queries: DataFrame, vectors: DataFrame, k: int = 10, threshold: float = 0.5, where: Column | None = None, **names) -> DataFrame:
    """Top 2k, then those at the threshold or above, then the first k of them."""
    hits = top_k(queries, vectors, 2 * k, where, **names).where(F.col("score") >= threshold)
    again = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k)


def relevance_class(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")


def percent(score: Column) -> Column:
    return F.format_string("%.0f%%", score * 100)


def format_results(hits: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw hits (id, text, metadata map, score) with defaults for what metadata lacks."""
    m = lambda key, default: F.coalesce(F.col("metadata")[key], F.lit(default)).alias(key)
    return hits.select(
        *keep, "id", m("title", "Untitled Case"), m("citation", "No citation"), m("court", "Unknown Court"), m("date", "Unknown Date"), m("category", "General"), "score", m("summary", ""), F.substring(F.coalesce("text", F.lit("")), 1, 2000).alias("excerpt"), F.lit("").alias("relevance_explanation")
    )


def result_text(title: Column, summary: Column, excerpt: Column) -> Column:
    """Non-empty title, summary and the first 500 characters of the excerpt, joined by spaces."""
    empty_null = lambda c: F.when(c != "", c)
    return F.concat_ws(" ", empty_null(title), empty_null(summary), empty_null(F.substring(excerpt, 1, 500)))


def parse_explanations(reply: Column) -> Column:
    """What follows the first colon of the lines that start with 'Case ' and hold one."""
    lines = F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), strip)
    kept = F.filter(lines, lambda x: x.startswith("Case ") & x.contains(":"))
    return F.transform(kept, lambda x: strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))))


def hashed_bag_of_words(texts: list[str], dimensions: int = 64) -> list[list[float]]:
    """The offline embedding: words hashed to signed slots, unit length; empty text is the zero vector."""
    out = []
    for t in texts:
        v = [0.0] * dimensions
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
            v[h % dimensions] += 1.0 if h >> 32 & 1 else -1.0
        norm = sum(x * x for x in v) ** 0.5
        out.append([x / norm for x in v] if norm else v)
    return out


#: Embedding providers by name; ``register_provider`` adds one, a function of a list of texts.
PROVIDERS: dict[str, Callable[[list[str]], list[list[float]]]] = {"local": hashed_bag_of_words}


def register_provider(name: str, embed_fn: Callable[[list[str]], list[list[float]]]) -> None:
    PROVIDERS[name] = embed_fn


def provider(name: str = "local") -> Callable[[list[str]], list[list[float]]]:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; one of {sorted(PROVIDERS)}")
    return PROVIDERS[name]


def retrying(call: Callable, attempts: int = 3, first_wait: float = 1.0, most_wait: float = 10.0) -> Callable:
    """``call``, tried again after growing waits; the last failure is raised."""

    def run(*args):
        for left, wait in zip(range(attempts - 1, -1, -1), (min(most_wait, first_wait * 2**i) for i in range(attempts))):
            try:
                return call(*args)
            except Exception:
                if not left:
                    raise
                time.sleep(wait)

    return run


def get_embeddings(texts: list[str], model: str = "local") -> list[list[float]]:
    """Vectors of a few texts, on the driver; tables go through ``embed``."""
    return retrying(provider(model))(list(texts))


class VectorTable:
    """A vector table at a path: add, search, delete."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        from textquarry.sources import sinks

        return sinks.latest(self.spark.read.parquet(self.path))

    def add(self, rows: DataFrame) -> None:
        """rows: id, text, embedding and any other columns, which become metadata."""
        from textquarry.sources import sinks

        sinks.append(sinks.as_table(rows), self.path)

    def search(self, vectors: list[list[float]], k: int = 10, where: Column | None = None) -> DataFrame:
        """(query_id, id, score, rank, text, metadata) for a few query vectors."""
        asked = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "query_id long, query_vector array<double>")
        table = self.rows()
        return top_k(asked, table, k, where, n_queries=len(vectors)).join(table.select("id", "text", "metadata"), "id")

    def delete(self, ids: list[str]) -> None:
        """Rewrites the table without these ids, through a checkpoint of what stays."""
        from textquarry.functions.checkpoints import checkpoint

        checkpoint(self.rows().where(~F.col("id").isin(ids))).write.mode("overwrite").parquet(self.path)


STORES = {"parquet": VectorTable}


def get_vector_store(spark, path: str, kind: str = "parquet"):
    """A store by kind; unknown kinds are taken for the default."""
    return STORES.get(kind, VectorTable)(spark, path)


def retrieve(queries: DataFrame, table: DataFrame, k: int = 10, threshold: float = 0.5, where: Column | None = None, embed_fn=None, n_queries: int | None = None) -> DataFrame:
    """Text queries (query_id, query) against a vector table, whole: embed, filter, top 2k, threshold, format.

    Columns: query_id, rank and those of ``format_results``; explanations are left to ``explain``.
    """
    asked = embed(queries, "query", "query_vector", embed_fn or hashed_bag_of_words).select("query_id", "query_vector")
    hits = search(asked, table, k, threshold, where, n_queries=n_queries)
    full = hits.join(table.select("id", "text", "metadata"), "id")
    return format_results(full, keep=("query_id", "rank"))


def embed(docs: DataFrame, text_col: str = "text", out_col: str = "embedding", embed_fn: Callable[[list[str]], list[list[float]]] = hashed_bag_of_words, batch: int = 32) -> DataFrame:
    """Adds embeddings, by Arrow batches handed to ``embed_fn`` in slices of ``batch``; calls that fail are tried again."""
    call = retrying(embed_fn)
    bounded(docs.sparkSession)

    @F.pandas_udf("array<float>")
    def run(texts):
        import pandas as pd

        rows, values = texts.fillna("").tolist(), []
        for at in range(0, len(rows), batch):
            values.extend(call(rows[at : at + batch]))
        return pd.Series(values)

    return docs.withColumn(out_col, run(F.col(text_col)))


NO_EXPLANATION = "Explanation unavailable."


def explain(results: DataFrame, query: str, ask: Callable[[str], str] | None = None, cases: int = 5) -> DataFrame:
    """Fills relevance_explanation of the first results (rank up to ``cases``) from one model reply; what is missing or fails is a constant.

    The prompt holds at most ``cases`` summaries of 300 characters, so it is asked once, on the driver.
    """
    first = results.where(F.col("rank") <= cases).select("rank", "title", F.substring("summary", 1, 300).alias("summary")).orderBy("rank").limit(cases).collect()
    prompt = f"Query: {query}\n" + "\n".join(f"Case {i}: {r['title']} - {r['summary']}" for i, r in enumerate(first, 1))
    try:
        reply = ask(prompt) if ask else ""
    except Exception:  # a provider that fails must not fail the search
        reply = ""
    said = [line.strip().split(":", 1)[1].strip() for line in reply.split("\n") if line.strip().startswith("Case ") and ":" in line]
    given = F.array(*[F.lit(x) for x in said]) if said else F.array().cast("array<string>")
    return results.withColumn("relevance_explanation", F.coalesce(F.get(given, F.col("rank") - 1), F.lit(NO_EXPLANATION)))


def demo_results(spark, query: str) -> DataFrame:
    """Fixed rows for trials without a table."""
    rows = [(i, f"demo_{i}", f"Demo Case {i}", f"[20{10 + i}] D {i}", "Demo Court", f"20{10 + i}-01-01", "General", round(0.95 - 0.1 * i, 2), "A demonstration.", "A demonstration text.", f"Shown for {query}.") for i in range(1, 6)]
    return spark.createDataFrame(rows, "rank int, id string, title string, citation string, court string, date string, category string, score double, summary string, excerpt string, relevance_explanation string")
