"""Queries over the driver's tables, one or more per operator, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.functions import fixed
from textquarry.functions import text as tx
from textquarry.functions.shipping import ship
from textquarry.operators import chunking, compress, dedup, evaluate, expand, experiments, fusion, metrics, rerank, vector
from textquarry.sources import sinks
from textquarry.streaming import limiter

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _sql_tokens(text: str, pattern: str, stops: list[str], least: int = 2) -> str:
    found = f"regexp_extract_all(lower(coalesce({text}, '')), '{pattern}')"
    return f"list_filter({found}, lambda w: len(w) >= {least} and w not in {_list(stops)})" if stops else found


_RR = lambda text: _sql_tokens(text, "[a-z]+", fixed.RERANK_STOPS)
_DD = lambda text: _sql_tokens(text, "[a-z0-9]+", fixed.DEDUP_STOPS)
_QE = lambda text: _sql_tokens(text, "[a-z0-9]+(?:[''-][a-z0-9]+)*", fixed.EXPANSION_STOPS)
_CM = lambda text: rf"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\pL\pN_]+'), lambda w: regexp_full_match(w, '[a-z]{{2,}}') and w not in {_list(fixed.COMPRESSION_STOPS)})"


def _sql_sentences(text: str, abbreviations: list[str]) -> str:
    held = text
    for i, a in enumerate(abbreviations):
        held = f"replace({held}, '{a}', chr(2)||'{i}'||chr(3))"
    cut = rf"string_split(regexp_replace(regexp_replace({held}, '([.!?])\s+([A-Z(\[" + '"' + rf"])', '\1'||chr(1)||'\2', 'g'), '([.!?])\s+([A-Z(\[" + '"' + r"])', '\1'||chr(1)||'\2', 'g'), chr(1))"
    back = "s"
    for i, a in enumerate(abbreviations):
        back = f"replace({back}, chr(2)||'{i}'||chr(3), '{a}')"
    return rf"list_filter(list_transform({cut}, lambda s: regexp_replace({back}, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


# ------------------------------------------------------------------------------ text


@query(
    f"""select doc_id, len(a) n_rerank, md5(array_to_string(a, ' ')) rerank_md5, len(b) n_dedup, md5(array_to_string(b, ' ')) dedup_md5, len(c) n_compression, md5(array_to_string(c, ' ')) compression_md5,
    len(d) n_raw, md5(array_to_string(d, ' ')) raw_md5, len(e) n_expansion, md5(array_to_string(e, ' ')) expansion_md5, len(f) n_keywords, md5(array_to_string(f, ' ')) keywords_md5
    from (select doc_id, {_RR('text')} a, {_DD('text')} b, {_CM('text')} c, {_sql_tokens('text', "[a-z0-9]+(?:[''-][a-z0-9]+)*", [], 1)} d, {_QE('text')} e,
    list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '' and lower(w) not in {_list(fixed.VARIANT_STOPS)}) f from documents)"""
)
def txt_tokens(spark, d):
    rows = _t(spark, d, "documents")
    kinds = {"rerank": tx.rerank_tokens, "dedup": tx.dedup_tokens, "compression": tx.compression_tokens, "raw": tx.raw_tokens, "expansion": tx.expansion_tokens, "keywords": tx.variant_keywords}
    held = rows.select("doc_id", *[f(F.col("text")).alias(k) for k, f in kinds.items()])
    return held.select("doc_id", *[x for k in kinds for x in (F.size(k).cast("bigint").alias(f"n_{k}"), F.md5(F.array_join(k, " ").cast("binary")).alias(f"{k}_md5"))])


@query(
    f"""select doc_id, len(a) n_chunk, md5(array_to_string(a, '|')) chunk_md5, greatest(len(b), 1) n_compression, md5(array_to_string(b, '|')) compression_md5, len(c) n_plain, md5(array_to_string(c, '|')) plain_md5, len(p) n_paragraphs
    from (select doc_id, {_sql_sentences("coalesce(text, '')", fixed.CHUNK_ABBREVIATIONS)} a, {_sql_sentences("coalesce(text, '')", fixed.COMPRESSION_ABBREVIATIONS)} b,
    list_filter(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1'||chr(1), 'g'), chr(1)), lambda s: s <> '') c,
    list_filter(string_split_regex(coalesce(text, ''), '\\n\\s*\\n'), lambda s: regexp_matches(s, '\\S')) p from documents)"""
)
def txt_sentences(spark, d):
    kinds = {"chunk": tx.sentences, "compression": tx.compression_sentences, "plain": tx.plain_sentences}
    held = _t(spark, d, "documents").select("doc_id", *[f(F.col("text")).alias(k) for k, f in kinds.items()], F.size(tx.paragraphs(F.col("text"))).cast("bigint").alias("n_paragraphs"))
    return held.select("doc_id", "n_paragraphs", *[x for k in kinds for x in (F.size(k).cast("bigint").alias(f"n_{k}"), F.md5(F.array_join(k, "|").cast("binary")).alias(f"{k}_md5"))])


@query(
    r"""select doc_id, greatest(1, length(text) // 4) token_estimate, substr(sha256(text), 1, 16) content_hash, md5(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^ | $', '', 'g')) normalized_md5,
    cast(('0x' || substr(md5(text), 25, 8)) as bigint) md5_low from documents"""
)
def txt_scalars(spark, d):
    t = F.col("text")
    return _t(spark, d, "documents").select("doc_id", tx.token_estimate(t).alias("token_estimate"), tx.content_hash(t).alias("content_hash"), dedup.fingerprint(t).alias("normalized_md5"), tx.md5_low(t).alias("md5_low"))


# ---------------------------------------------------------------------------- vectors

_VEC = """q as (select vec_id query_id, embedding::double[] qv from embeddings where {which}), scored as (select query_id, vec_id id, list_cosine_similarity(embedding::double[], qv) score from embeddings, q where {where}),
top as (select *, row_number() over (partition by query_id order by score desc, id) rank from scored)"""


def _top(spark, d, which, k, where=None):
    v = _t(spark, d, "embeddings")
    q = v.where(which).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vector.top_k(q, v, k, where, id_col="vec_id", n_queries=q.count())


@query(f"with {_VEC.format(which='vec_id % 20 = 0', where='label in (1, 3, 5, 7) and vec_id >= 10')} select query_id, id, round(score, 6) score, cast(rank as integer) rank, case when score >= 0.8 then 'high' when score >= 0.6 then 'medium' else 'low' end relevance from top where rank <= 10")
def vec_topk(spark, d):
    where = vector.predicate({"$and": [{"label": {"$in": [1, 3, 5, 7]}}, {"vec_id": {"$gte": 10}}]})
    return _top(spark, d, "vec_id % 20 = 0", 10, where).select("query_id", "id", F.round("score", 6).alias("score"), "rank", vector.relevance_class(F.col("score")).alias("relevance"))


@query(f"with {_VEC.format(which='vec_id % 20 = 0', where='true')} select query_id, id, round(score, 6) score, cast(rank as integer) rank from top where rank <= 10")
def vec_batch_topk(spark, d):
    return _top(spark, d, "vec_id % 20 = 0", 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"with {_VEC.format(which='vec_id % 20 = 0', where='true')} select query_id, id, round(score, 6) score, cast(rank as integer) rank, format('{{:.0f}}%', round(score * 100)) badge from top where rank <= 10 and score >= 0.3")
def vec_search(spark, d):
    v = _t(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    hits = vector.search(q, v, 10, 0.3, id_col="vec_id", n_queries=q.count())
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank", vector.percent(F.col("score")).alias("badge"))


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where o_totalprice between 50000 and 150000 and o_orderstatus in ('F', 'O')")
def flt_predicate(spark, d):
    where = vector.predicate({"$and": [{"o_totalprice": {"$gte": 50000, "$lte": 150000}}, {"o_orderstatus": {"$in": ["F", "O"]}}]})
    return _t(spark, d, "orders").where(where).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("select doc_id id, coalesce(source, 'Untitled Case') title, 'No citation' citation, coalesce(lang, 'Unknown Court') court, 'Unknown Date' date, 'General' category, 1.0::double score, '' summary, substr(text, 1, 2000) excerpt, '' relevance_explanation from documents")
def prj_format_results(spark, d):
    m = F.map_from_arrays(F.array(F.lit("title"), F.lit("court")), F.array("source", "lang"))
    return vector.format_results(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", m.alias("metadata"), F.lit(1.0).alias("score")))


@query()
def vec_embed(spark, d):
    rows = vector.embed(_t(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.size("embedding").alias("dimensions"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x), 4).alias("square"))


# ------------------------------------------------------------------------------ dedup

_NORMAL = r"md5(trim(regexp_replace(text, '\s+', ' ', 'g')))"


@query(f"select doc_id id, min(doc_id) over (partition by {_NORMAL}) first_id, doc_id <> min(doc_id) over (partition by {_NORMAL}) is_duplicate from documents")
def ddp_exact(spark, d):
    return dedup.exact_dedupe(_t(spark, d, "documents"))


_SHINGLES = f"""tok as (select doc_id id, {_DD('text')} w from documents),
sh as (select id, unnest(case when len(w) < 3 then w else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) end) s from tok)"""
_SIMHASH = f"""{_SHINGLES},
hashed as (select id, cast('0x' || substr(sha256(s), 1, 16) as ubigint) h, count(*) n from sh group by all),
bits as (select id, b, sum(n * (case when (h >> (63 - b)) & 1 = 1 then 1 else -1 end)) v from hashed, (select unnest(range(0, 64)) b) group by all),
prints as (select id, bit_or(case when v > 0 then 1::ubigint << (63 - b)::ubigint else 0::ubigint end) f from bits group by id),
signed as (select d.doc_id id, case when coalesce(f, 0)::hugeint >= 9223372036854775808 then (coalesce(f, 0)::hugeint - 18446744073709551616)::bigint else coalesce(f, 0)::bigint end simhash from documents d left join prints on prints.id = d.doc_id)"""


@query(f"with {_SIMHASH} select id, simhash from signed")
def ddp_simhash(spark, d):
    return dedup.simhash(_t(spark, d, "documents"))


@query(f"with {_SIMHASH} select a.id a, b.id b, cast(bit_count(xor(a.simhash, b.simhash)) as integer) distance from signed a join signed b on a.id < b.id where bit_count(xor(a.simhash, b.simhash)) <= 3")
def ddp_simhash_pairs(spark, d):
    return dedup.banded_pairs(dedup.simhash(_t(spark, d, "documents")))


_N = 128
_PARAMS = ", ".join(f"({i}, {a}::hugeint, {b}::hugeint)" for i, (a, b) in enumerate(dedup.minhash_parameters(_N)))
# the product needs more than 128 bits, so a is taken in two parts here too
_SIGNATURES = f"""p(i, a, b) as (values {_PARAMS}), xs as (select distinct id, cast('0x' || substr(md5(s), 25, 8) as hugeint) x from sh),
m as (select id, i, min((((a >> 30) * x % {dedup.PRIME} * 1073741824 % {dedup.PRIME}) + (a & 1073741823) * x + b) % {dedup.PRIME})::bigint v from xs, p group by all),
sig as (select d.doc_id id, coalesce(v, list_resize([]::bigint[], {_N}, {dedup.PRIME})) signature from documents d left join (select id, list(v order by i) v from m group by id) g on g.id = d.doc_id)"""
_MINHASH = f"{_SHINGLES}, {_SIGNATURES}"


@query(f"with {_MINHASH} select id, array_to_string(signature, ',') signature from sig")
def ddp_minhash(spark, d):
    return dedup.minhash(_t(spark, d, "documents"), n_hashes=_N).select("id", F.array_join("signature", ",").alias("signature"))


@query(
    f"""with {_MINHASH}, pairs as (select a.id a, b.id b, len(list_filter(list_zip(a.signature, b.signature), lambda z: z[1] = z[2])) / {_N}.0::double jaccard from sig a join sig b on a.id < b.id)
    select a, b, round(jaccard, 6) jaccard from pairs where jaccard >= 0.8"""
)
def ddp_minhash_pairs(spark, d):
    found = dedup.minhash_pairs(dedup.minhash(_t(spark, d, "documents"), n_hashes=_N), _N, 0.8)
    return found.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


# the stages replayed document by document: lists of earlier neighbours, then a recursion over the order of ids
_STAGES = f"""with recursive {_SIMHASH}, {_SIGNATURES},
exact as (select doc_id id, min(doc_id) over (partition by {_NORMAL}) first_id from documents),
kept as (select id, row_number() over (order by id) k from exact where id = first_id),
near as materialized (select b.k k, list(a.k) filter (bit_count(xor(x.simhash, y.simhash)) <= 3) s,
  list(a.k) filter (len(list_filter(list_zip(p.signature, q.signature), lambda z: z[1] = z[2])) >= 0.8 * {_N}) m
  from kept a join kept b on a.k < b.k join signed x on x.id = a.id join signed y on y.id = b.id join sig p on p.id = a.id join sig q on q.id = b.id group by b.k),
every as materialized (select list(coalesce(s, []) order by kept.k) s, list(coalesce(m, []) order by kept.k) m, count(*) n from kept left join near using (k)),
walk(k, st) as (select 0::bigint, []::varchar[] union all
  select k + 1, list_append(st, case when len(list_filter(s[k + 1], lambda a: st[a] <> 'simhash')) > 0 then 'simhash' when len(list_filter(m[k + 1], lambda a: st[a] = 'unique')) > 0 then 'minhash' else 'unique' end)
  from walk, every where k < n),
stages as (select e.id, case when e.id <> e.first_id then 'exact' else (select st from walk order by k desc limit 1)[kept.k] end stage from exact e left join kept on kept.id = e.id)"""


@query(f"{_STAGES} select id, stage from stages")
def ddp_pipeline(spark, d):
    return dedup.pipeline(_t(spark, d, "documents"))


@query(
    f"""{_STAGES} select count(*) input_count, count(*) filter (stage = 'unique') unique_count, count(*) filter (stage = 'exact') exact_removed, count(*) filter (stage = 'simhash') simhash_removed,
    count(*) filter (stage = 'minhash') minhash_removed, case when count(*) = 0 then 0.0::double else count(*) filter (stage <> 'unique') / count(*)::double end duplicate_rate from stages"""
)
def ddp_report(spark, d):
    return dedup.report(dedup.pipeline(_t(spark, d, "documents")))


@query(f"select conv_id, turn from conversations where {_NORMAL} not in (select {_NORMAL} from documents)")
def ddp_unseen(spark, d):
    return dedup.unseen(_t(spark, d, "conversations"), _t(spark, d, "documents")).select("conv_id", "turn")


# --------------------------------------------------------------------------- chunking


def _chunks(spark, d, strategy, **options):
    rows = chunking.chunk(_t(spark, d, "documents"), strategy, **options)
    return rows.select("id", "chunk_index", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("md5"))


@query()
def chk_fixed(spark, d):
    return _chunks(spark, d, "fixed")


@query()
def chk_sentence(spark, d):
    return _chunks(spark, d, "sentence")


@query()
def chk_recursive(spark, d):
    return _chunks(spark, d, "recursive")


@query()
def chk_semantic(spark, d):
    return _chunks(spark, d, "semantic", embed=vector.hashed_bag_of_words)


@query()
def chk_structure(spark, d):
    return _chunks(spark, d, "structure")


@query(
    rf"""with s as (select doc_id, text, {_sql_sentences("text", fixed.CHUNK_ABBREVIATIONS)} s from documents where regexp_matches(text, '\S')),
    w as (select doc_id, text, s, unnest(case when len(s) <= 5 then [0] else list_filter(range(0, len(s), 3), lambda i: i = 0 or i - 3 + 5 < len(s)) end) a from s)
    select doc_id id, cast(a // 3 as integer) chunk_index, cast(length(t) as integer) n_chars, md5(t) md5 from (select doc_id, a, case when len(s) <= 5 then regexp_replace(text, '^\s+|\s+$', '', 'g') else array_to_string(s[a+1:a+5], ' ') end t from w)"""
)
def chk_sliding(spark, d):
    return _chunks(spark, d, "sliding_window")


# -------------------------------------------------------------------------- reranking


def _asked(spark, d):
    return _t(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _candidates(spark, d):
    """The queries, and all documents as a corpus that they share."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("id"), "text", (F.col("n_chars") % 1000 / 1000).alias("score"))
    return _asked(spark, d), docs


def _of_queries(hits, corpus):
    """Candidates per query: the rows of the corpus that (query_id, id) names."""
    return corpus.join(F.broadcast(hits.select("query_id", "id")), "id")


_RERANK = f"""ids as (select item_id query_id from benchmark where item_id % 20 = 0), qt as (select item_id query_id, unnest({_RR('text')}) term from benchmark where item_id % 20 = 0), qn as (select query_id, count(*) qn from qt group by query_id), q as (select query_id, term, count(*) qtf from qt group by all),
dw as (select doc_id, n_chars, {_RR('text')} w from documents), big as (select count(*) n, case when avg(len(w)) = 0 then 1.0 else avg(len(w)) end mean, max(n_chars % 1000 / 1000.0) hi, min(n_chars % 1000 / 1000.0) lo from dw),
tf as (select doc_id, len(w) dl, term, count(*) tf from (select doc_id, w, unnest(w) term from dw) group by all), df as (select term, count(*) df from tf group by term),
idf as (select term, ln((n + 1) / (df + 1)::double) + 1 idf from df, big), wt as (select doc_id, term, tf / dl::double * idf w from tf join idf using (term)),
qw as (select query_id, term, qtf / qn::double * idf qw from q join idf using (term) join qn using (query_id)), ql as (select query_id, sqrt(sum(qw * qw)) ql from qw group by query_id), wl as (select doc_id, sqrt(sum(w * w)) wl from wt group by doc_id),
dot as (select query_id, doc_id, sum(w * qw) dot from wt join qw using (term) group by all),
sims as (select ids.query_id, d.doc_id id, n_chars, coalesce(dot / nullif(wl * ql, 0), 0) sim from documents d cross join ids left join dot on dot.doc_id = d.doc_id and dot.query_id = ids.query_id left join wl on wl.doc_id = d.doc_id left join ql on ql.query_id = ids.query_id),
bm as (select query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean)) * qtf) s from tf join q using (term) join df using (term), big group by all),
bms as (select ids.query_id, d.doc_id id, coalesce(s, 0) s from documents d cross join ids left join bm on bm.doc_id = d.doc_id and bm.query_id = ids.query_id),
blend as (select query_id, id, round(0.6 * (n_chars % 1000 / 1000.0::double - lo) / case when case when hi = 0 then 1 else hi end - lo = 0 then 1 else case when hi = 0 then 1 else hi end - lo end + 0.4 * sim, 6) s from sims, big)"""


def _shown(df):
    return df.select("query_id", "id", "rerank_score", "rank")


_RANKED = "select query_id, id, rerank_score, cast(rank as integer) rank from (select *, row_number() over (partition by query_id order by rerank_score desc, id) rank from ({})) where rank <= 20"


@query(f"with {_RERANK} {_RANKED.format('select query_id, id, round(sim, 6) rerank_score from sims')}")
def rrk_tfidf(spark, d):
    q, c = _candidates(spark, d)
    return _shown(rerank.tfidf(q, c, 20))


@query(f"with {_RERANK} {_RANKED.format('select query_id, id, s rerank_score from blend')}")
def rrk_score(spark, d):
    q, c = _candidates(spark, d)
    return _shown(rerank.blended(q, c, 0.6, "score", 20))


@query(f"with {_RERANK} {_RANKED.format('select query_id, id, round(s, 6) rerank_score from bms')}")
def rrk_bm25(spark, d):
    q, c = _candidates(spark, d)
    return _shown(rerank.bm25(q, c, top=20))


@query()
def rrk_mmr(spark, d):
    q, c = _candidates(spark, d)
    return rerank.mmr(q, _of_queries(rerank.bm25(q, c, top=50), c), 0.5, 10).select("query_id", "id", "rerank_score", "mmr_rank")


_LISTS = f"""{_RERANK}, l as (select 0 list_no, * from ({_RANKED.format('select query_id, id, round(sim, 6) rerank_score from sims')}) union all select 1, * from ({_RANKED.format('select query_id, id, round(s, 6) rerank_score from bms')}))"""


def _lists(spark, d):
    q, c = _candidates(spark, d)
    terms = rerank.corpus_terms(c)
    parts = [rerank.tfidf(q, c, 20, terms), rerank.bm25(q, c, top=20, terms=terms)]
    return parts[0].withColumn("list_no", F.lit(0)).unionByName(parts[1].withColumn("list_no", F.lit(1))).select("query_id", "list_no", "rank", "id")


@query(f"with {_LISTS}, f as (select query_id, id, round(sum(1.0::double / (60 + rank)), 8) rrf_score, min(list_no * 1000 + rank) o from l group by all) select query_id, id, rrf_score, cast(row_number() over (partition by query_id order by rrf_score desc, o) as integer) rrf_rank from f qualify rrf_rank <= 10")
def rrk_rrf(spark, d):
    return rerank.rrf(_lists(spark, d), top=10).select("query_id", "id", "rrf_score", "rrf_rank")


@query(f"with {_LISTS}, f as (select query_id, id, sum((case list_no when 0 then 0.7::double else 0.3::double end) / (60 + rank)) s, min(list_no * 1000 + rank) o from l group by all) select query_id, id, round(s, 10) rrf_score, cast(row_number() over (partition by query_id order by s desc, o) as integer) rrf_rank from f qualify rrf_rank <= 20")
def fus_hyde(spark, d):
    lists = _lists(spark, d)
    fused = fusion.fuse_hypothesis(lists.where("list_no = 0"), lists.where("list_no = 1"), 0.3)
    return fused.select("query_id", "id", F.round("rrf_score", 10).alias("rrf_score"), "rrf_rank")


# ----------------------------------------------------------------------------- fusion

_WINDOWS = r"""s as (select doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1'||chr(1), 'g'), chr(1)), lambda x: x <> '') s from documents),
win as (select doc_id parent_id, unnest(range(0, len(s))) i, s from s), kids as (select parent_id, i, parent_id || '_w' || i id, array_to_string(s[i+1:i+3], ' ') t from win)"""


@query(f"with {_WINDOWS} select id, md5(t) md5, parent_id, cast(i as integer) window_start from kids")
def fus_windows(spark, d):
    rows = fusion.window_index(_t(spark, d, "documents"), id_col="doc_id")
    return rows.select("id", F.md5(F.col("text").cast("binary")).alias("md5"), "parent_id", "window_start")


@query(f"with {_WINDOWS}, p as (select parent_id, sum(length(t) % 10 / 10.0::double) s, count(*) n, min(parent_id * 100000 + i) o from kids group by parent_id) select parent_id, round(s, 4) aggregated_score, n matched_children, cast(row_number() over (order by round(s, 4) desc, o) as integer) rank from p qualify rank <= 5")
def fus_parents(spark, d):
    kids = fusion.window_index(_t(spark, d, "documents"), id_col="doc_id")
    hits = kids.select(F.lit(0).alias("query_id"), (F.col("parent_id") * 100000 + F.col("window_start")).alias("pos"), "id", (F.length("text") % 10).cast("decimal(10,1)").alias("ten")).withColumn("score", (F.col("ten") / 10).cast("decimal(12,1)"))
    return fusion.fuse_windows(hits, kids, 5).select("parent_id", F.round(F.col("aggregated_score").cast("double"), 4).alias("aggregated_score"), "matched_children", "rank")


@query()
def fus_variants(spark, d):
    return _t(spark, d, "benchmark").transform(lambda df: fusion.variants(df, query_col="text")).select("item_id", F.posexplode("variants").alias("i", "variant"))


@query(
    f"select item_id, md5(replace(replace('{fixed.HYPOTHESIS}', '%1$s', 'legal'), '%2$s', text)) md5 from benchmark"
)
def fus_hypothesis(spark, d):
    return _t(spark, d, "benchmark").select("item_id", F.md5(fusion.hypothesis(F.col("text")).cast("binary")).alias("md5"))


# -------------------------------------------------------------------------- expansion

_ACRONYM_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in fixed.ACRONYMS.items())


@query(
    rf"""with a(k, v) as (values {_ACRONYM_ROWS}), t as (select conv_id, turn, unnest(w) tok, unnest(range(1, len(w) + 1)) i from (select conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') w from conversations)),
    j as (select conv_id, turn, i, tok || coalesce(' ' || v, '') x from t left join a on a.k = regexp_replace(lower(tok), '^[.,;:!?]+|[.,;:!?]+$', '', 'g'))
    select c.conv_id, c.turn, md5(coalesce(string_agg(x, ' ' order by i), '')) md5 from conversations c left join j using (conv_id, turn) group by all"""
)
def qex_acronym(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.md5(expand.acronyms(F.col("text"))["expanded"].cast("binary")).alias("md5"))


@query()
def qex_synonym(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", expand.synonyms_udf(2)(F.col("text")).alias("x")).select("conv_id", "turn", "x.expanded", F.array_join("x.added", ",").alias("added"))


def _conversation_feedback(spark, d):
    c = _t(spark, d, "conversations")
    return c.where("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("query")), c.where("turn > 0").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text")


@query(
    f"""with dt as (select conv_id, turn, {_QE('text')} w from conversations where turn between 1 and 3), n as (select conv_id, count(*) n, greatest(sum(len(w)), 1) al from dt group by conv_id),
    tf as (select conv_id, term, count(*) tf, count(distinct turn) df from (select conv_id, turn, unnest(w) term from dt) group by all),
    own as (select conv_id, unnest({_QE('text')}) term from conversations where turn = 0),
    sc as (select conv_id, term, tf / al::double * ln((n - df + 0.5) / (df + 0.5) + 1) s from tf join n using (conv_id) where (conv_id, term) not in (select (conv_id, term) from own) and conv_id in (select conv_id from conversations where turn = 0))
    select conv_id query_id, term, round(s, 8) score, cast(row_number() over (partition by conv_id order by s desc, term desc) as integer) rank from sc qualify rank <= 5"""
)
def qex_prf(spark, d):
    q, docs = _conversation_feedback(spark, d)
    return expand.feedback_terms(q, docs).select("query_id", "term", F.round("score", 8).alias("score"), "rank")


@query()
def qex_pipeline(spark, d):
    q, docs = _conversation_feedback(spark, d)
    return expand.expand(q, ["synonym", "acronym", "prf"], docs).select("query_id", "expanded", F.array_join("added", ",").alias("added"), F.array_join("steps", ">").alias("steps"))


# ------------------------------------------------------------------------ compression


def _to_compress(spark, d):
    """All documents; the items of benchmark are dealt to them in turn, so each item is asked of its share."""
    items = _t(spark, d, "benchmark")
    dealt = items.select((F.row_number().over(Window.orderBy("item_id")) - 1).cast("bigint").alias("turn"), F.col("text").alias("query"))
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.pmod("doc_id", items.agg(F.count("*")).scalar()).alias("turn"))
    return docs.join(F.broadcast(dealt), "turn").select("chunk_id", "query", "text")


_COMPRESS = f"""dealt as (select row_number() over (order by item_id) - 1 turn, text qtext from benchmark), qw as (select doc_id, unnest({_CM('qtext')}) term from documents join dealt on turn = doc_id % (select count(*) from benchmark)), qd as (select doc_id, term, count(*) qtf from qw group by all),
s0 as (select doc_id, text, {_sql_sentences('text', fixed.COMPRESSION_ABBREVIATIONS)} s from documents), s1 as (select doc_id, text, case when len(s) = 0 then [''] else s end s from s0),
rows_ as (select doc_id, text, len(s) total, unnest(s) sentence, unnest(range(0, len(s))) i from s1), toks as (select doc_id, i, term, count(*) tf from (select doc_id, i, unnest({_CM('sentence')}) term from rows_) group by all)"""


@query(
    f"""with {_COMPRESS}, df as (select doc_id, term, count(*) df from toks group by all), tot as (select doc_id, max(total) total from rows_ group by doc_id),
    idf as (select doc_id, term, ln(greatest(total, 1) / (df + 1)::double) + 1 idf from df join tot using (doc_id)),
    qi as (select qd.doc_id, qd.term, qtf, coalesce(idf, 1.0) qidf from qd left join idf on idf.doc_id = qd.doc_id and idf.term = qd.term), qn as (select doc_id, sqrt(sum(qtf * qidf * qidf)) qn from qi group by doc_id),
    sc as (select t.doc_id, i, case when sqrt(sum((tf * idf) ** 2)) * any_value(qn) > 0 then coalesce(sum(tf * idf) filter (asked.term is not null), 0) / (sqrt(sum((tf * idf) ** 2)) * any_value(qn)) else 0 end score
      from toks t join idf on idf.doc_id = t.doc_id and idf.term = t.term join qn on qn.doc_id = t.doc_id left join qd asked on asked.doc_id = t.doc_id and asked.term = t.term group by t.doc_id, i),
    al as (select r.doc_id, r.i, text, sentence, total, coalesce(score, 0) score, sum((coalesce(score, 0) >= 0.05)::int) over (partition by r.doc_id) good, row_number() over (partition by r.doc_id order by coalesce(score, 0) desc, r.i) place from rows_ r left join sc on sc.doc_id = r.doc_id and sc.i = r.i),
    el as (select *, coalesce(sum(length(sentence)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) used from al where case when good < 1 then place <= 1 else score >= 0.05 end),
    out as (select doc_id, any_value(text) text, string_agg(sentence, ' ' order by i) made, count(*) k, max(total) total from el where used < 600 group by doc_id)
    select doc_id chunk_id, md5(case when made = '' then text else made end) md5, cast(k as integer) kept_sentences, cast(total as integer) total_sentences from out"""
)
def cmp_score(spark, d):
    return compress.by_score(_to_compress(spark, d)).select("chunk_id", F.md5(F.col("text").cast("binary")).alias("md5"), "kept_sentences", "total_sentences")


@query(
    f"""with {_COMPRESS}, h as (select doc_id, text, total, i, sentence, coalesce(list_has_any({_CM('sentence')}, terms), false)::int hit from rows_ left join (select doc_id, list(term) terms from qd group by doc_id) using (doc_id)),
    n as (select *, max(hit) over (partition by doc_id order by i rows between 2 preceding and 2 following) near, sum(hit) over (partition by doc_id) hits from h),
    k as (select *, count(*) over (partition by doc_id) kept from n where case when hits = 0 then i < 2 else near = 1 end),
    u as (select *, coalesce(sum(length(sentence)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) used, lag(i) over (partition by doc_id order by i) last from k),
    out as (select doc_id, any_value(text) text, string_agg(case when i > last + 1 then '... ' || sentence else sentence end, ' ' order by i) made, max(kept) kept, max(total) total, max(hits) hits from u where used < 800 group by doc_id)
    select doc_id chunk_id, md5(case when made = '' then text else made end) md5, cast(kept as integer) kept_sentences, cast(total as integer) total_sentences, cast(hits as integer) hit_count from out"""
)
def cmp_keywords(spark, d):
    return compress.by_keywords(_to_compress(spark, d)).select("chunk_id", F.md5(F.col("text").cast("binary")).alias("md5"), "kept_sentences", "total_sentences", "hit_count")


@query("select doc_id chunk_id, case when length(text) <= 300 then text else substr(text, 1, 300) end text, case when length(text) <= 300 then 'llm_skipped' else 'llm' end compressor from documents")
def cmp_model(spark, d):
    return compress.by_model(_to_compress(spark, d))


# ------------------------------------------------------------------------- evaluation


def _judged(spark, d):
    v = _t(spark, d, "embeddings")
    rankings = _top(spark, d, "vec_id % 20 = 0", 10).select("query_id", "rank", F.col("id").alias("doc_id"))
    topics = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("topic"))
    return {"rankings": rankings, "judgments": v.select(F.col("label").alias("topic"), F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 3 + 1).alias("gain")), "topics": topics}


_EVAL = f"""{_VEC.format(which='vec_id % 20 = 0', where='true')}, r as (select query_id, rank, id doc_id from top where rank <= 10),
j as (select q.vec_id query_id, e.vec_id doc_id, e.vec_id % 3 + 1 gain from embeddings e join embeddings q on e.label = q.label where q.vec_id % 20 = 0),
f as (select r.*, coalesce(gain, 0) gain, (gain is not null)::int rel from r left join j using (query_id, doc_id)), nr as (select query_id, count(*) n from j group by query_id),
ideal as (select query_id, gain, row_number() over (partition by query_id order by gain desc, doc_id) rank from j), ks as (select unnest([1, 3, 5, 10]) k),
atk as (select query_id, k, avg(rel) "precision", sum(rel) / any_value(n)::double recall, sum(gain / log2(rank + 1)) / any_value(best) ndcg, max(rel) = 1 hit from f join nr using (query_id), ks, lateral (select sum(gain / log2(i.rank + 1)) best from ideal i where i.query_id = f.query_id and i.rank <= k) where rank <= k group by query_id, k),
run as (select *, sum(rel) over (partition by query_id order by rank) so_far from f),
one as (select query_id, coalesce(1.0 / min(rank) filter (rel = 1), 0)::double reciprocal_rank, coalesce(sum(so_far / rank::double) filter (rel = 1), 0) / any_value(n) average_precision, max(rel) = 1 hit, count(*) n_retrieved, any_value(n) n_relevant from run join nr using (query_id) group by query_id)"""


@query(f"with {_EVAL} select query_id, k, round(\"precision\", 8) \"precision\", round(recall, 8) recall, round(ndcg, 8) ndcg, hit from atk")
def evl_at_k(spark, d):
    return evaluate.at_k(**_judged(spark, d)).select("query_id", "k", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "ndcg")], "hit")


@query(f"with {_EVAL} select query_id, round(reciprocal_rank, 8) reciprocal_rank, round(average_precision, 8) average_precision, hit, n_retrieved, n_relevant from one")
def evl_per_query(spark, d):
    return evaluate.per_query(**_judged(spark, d)).select("query_id", F.round("reciprocal_rank", 8).alias("reciprocal_rank"), F.round("average_precision", 8).alias("average_precision"), "hit", "n_retrieved", "n_relevant")


@query(
    f"""with {_EVAL} select case when k is null then metric else metric || '@' || k end metric, round(value, 6) value from (select 'mrr' metric, null::integer k, avg(reciprocal_rank) value from one union all select 'map', null, avg(average_precision) from one union all select 'hit_rate', null, avg(hit::int) from one
    union all select 'precision', k, avg("precision") from atk group by k union all select 'recall', k, avg(recall) from atk group by k union all select 'ndcg', k, avg(ndcg) from atk group by k)"""
)
def evl_report(spark, d):
    return evaluate.evaluate(**_judged(spark, d)).select(F.concat_ws("@", "metric", "k").alias("metric"), F.round("value", 6).alias("value"))


@query()
def evl_simulate(spark, d):
    judged = _judged(spark, d)
    return evaluate.simulate(judged["judgments"], topics=judged["topics"])


# ------------------------------------------------------------------ metrics and tracker


def _samples(spark, d):
    e = _t(spark, d, "events")
    return e.select(F.col("event_type").alias("name"), F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("labels"), "value", "ts")


@query("""select event_type "name", 'k="' || (props::json->>'$.k') || '"' labels, round(sum(value), 4) "value" from events group by all""")
def met_counters(spark, d):
    return metrics.counters(_samples(spark, d)).withColumn("value", F.round("value", 4))


@query('select event_type "name", arg_max(value, struct_pack(ts := ts, value := value)) "value" from events group by event_type')
def met_gauges(spark, d):
    return metrics.gauges(_samples(spark, d))


@query(
    'select event_type "name", le, (select count(*) from events x where x.event_type = e.event_type and x.value <= b) "count" from (select distinct event_type from events) e, (values '
    + ", ".join(f"('{b}', {b}::double)" for b in fixed.LATENCY_MS)
    + ", ('+Inf', 'infinity'::double)) v(le, b)"
)
def met_histogram(spark, d):
    return metrics.histogram(_samples(spark, d))


@query('select event_type "name", count(*) "count", round(sum(value), 4) "sum", round(avg(value), 4) "avg" from events group by event_type')
def met_summary(spark, d):
    return metrics.histogram_summary(_samples(spark, d))


@query('select date_trunc(\'hour\', ts) "start", event_type "name", count(*) "count", round(sum(value), 4) "sum" from events group by all')
def met_windowed(spark, d):
    return metrics.windowed(_samples(spark, d)).withColumn("sum", F.round("sum", 4))


@query()
def met_prometheus(spark, d):
    return metrics.prometheus(_samples(spark, d))


@query("select case max(case when share < 0.05 then 2 when share < 0.15 then 1 else 0 end) when 2 then 'unhealthy' when 1 then 'degraded' else 'healthy' end status from (select avg((l_returnflag = 'R')::int) share from lineitem group by l_linestatus)")
def hlt_overall(spark, d):
    shares = _t(spark, d, "lineitem").groupBy("l_linestatus").agg(F.avg((F.col("l_returnflag") == "R").cast("int")).alias("share"))
    return metrics.overall(shares.select(F.col("l_linestatus").alias("component"), metrics.disk_status(F.col("share")).alias("status")))


def _runs(spark, d):
    e = _t(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.max("value").alias("top"), F.count("*").alias("n"), F.min("ts").cast("string").alias("start_time"))
    return e.select(F.col("event_type").alias("run_id"), F.concat(F.lit("run "), F.col("event_type")).alias("name"), F.lit("completed").alias("status"), "start_time", F.create_map(F.lit("mean"), F.round("mean", 6), F.lit("top"), F.round("top", 6)).alias("metrics"), F.array("event_type").alias("tags"))


_RUNS = "m as (select event_type run_id, round(avg(value), 6) mean, round(max(value), 6) top, min(ts) s from events group by event_type), l as (select run_id, 'mean' metric, mean v from m union all select run_id, 'top', top from m)"


@query(f'with {_RUNS} select metric, run_id, v "value", v = max(v) over (partition by metric) and (select count(*) from m) > 1 best from l')
def exp_compare(spark, d):
    return experiments.compare(_runs(spark, d))


@query(f'with {_RUNS} select run_id, mean "value" from m order by mean desc, s desc, run_id desc limit 1')
def exp_best(spark, d):
    return experiments.best_run(_runs(spark, d), "mean").select("run_id", "value")


@query("select event_type run_id from events where lower('run ' || event_type) like '%c%' group by 1 order by min(ts) desc, 1 desc limit 3")
def exp_list(spark, d):
    return experiments.list_runs(_runs(spark, d), name="C", status="completed", limit=3).select("run_id")


# ---------------------------------------------------------------------- sinks, streams


def _versions(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(0).alias("version"))
    new = _t(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("id"), "text", F.lit(1).alias("version"))
    return docs, new


@query("select id, md5(text) md5, version from (select doc_id id, text, 0 version from documents where doc_id not in (select conv_id from conversations where turn = 0) union all select conv_id, substr(text, 1, 1000), 1 from conversations where turn = 0)")
def snk_upsert(spark, d):
    return sinks.upsert(*_versions(spark, d)).select("id", F.md5(F.col("text").cast("binary")).alias("md5"), "version")


@query("select doc_id id from documents where doc_id not in (select conv_id from conversations where turn = 0)")
def snk_delete(spark, d):
    return sinks.delete(*_versions(spark, d)).select("id")


@query("select string_agg(p_name, chr(10) order by p_partkey) citations from part where p_name <> ''")
def snk_citations(spark, d):
    return sinks.citations(_t(spark, d, "part").select(F.col("p_partkey").alias("rank"), F.col("p_name").alias("citation")))


@query()
def ing_chunks(spark, d):
    rows = sinks.ingest(_t(spark, d, "documents"), id_col="doc_id")
    return rows.select("id", "parent_id", "chunk_index", "total_chunks", F.md5(F.col("text").cast("binary")).alias("md5"), F.size("embedding").alias("dimensions"))


def _calls(spark, d):
    return _t(spark, d, "events").select(F.col("event_type").alias("endpoint"), F.col("event_id").alias("call_id"), "ts", F.lit(1).alias("tokens"))


_BUCKETS = """with recursive c as (select event_type endpoint, event_id call_id, epoch(ts) t, row_number() over (partition by event_type order by ts, event_id) i from events),
b as (select endpoint, call_id, t, i, true allowed, 4.0::double tokens_left from c where i = 1
union all select c.endpoint, c.call_id, c.t, c.i, least(5.0::double, b.tokens_left + greatest(0, c.t - b.t) * 0.002::double) >= 1,
least(5.0::double, b.tokens_left + greatest(0, c.t - b.t) * 0.002::double) - (least(5.0::double, b.tokens_left + greatest(0, c.t - b.t) * 0.002::double) >= 1)::int from b join c on c.endpoint = b.endpoint and c.i = b.i + 1)"""


@query(_BUCKETS + " select endpoint, call_id, allowed, round(tokens_left, 4) tokens_left from b")
def str_token_bucket(spark, d):
    done = limiter.replay(_calls(spark, d), rate=0.002, burst=5.0)
    return done.select("endpoint", "call_id", "allowed", F.round("tokens_left", 4).alias("tokens_left"))


@query(_BUCKETS + " select endpoint, count(*) total, count(*) filter (allowed) allowed, count(*) filter (not allowed) throttled, count(*) filter (not allowed) / count(*)::double throttle_rate from b group by endpoint")
def str_limiter_stats(spark, d):
    return limiter.statistics(limiter.replay(_calls(spark, d), rate=0.002, burst=5.0))


@query()
def search_pipeline(spark, d):
    """Expand, rank twice, fuse, rerank for diversity, compress."""
    q, c = _candidates(spark, d)
    q = expand.expand(q, ["synonym", "acronym"]).select("query_id", F.col("expanded").alias("query"))
    terms = rerank.corpus_terms(c)
    lists = rerank.tfidf(q, c, 30, terms).withColumn("list_no", F.lit(0)).unionByName(rerank.bm25(q, c, top=30, terms=terms).withColumn("list_no", F.lit(1)))
    best = rerank.rrf(lists.select("query_id", "list_no", "rank", "id"), top=20)
    diverse = rerank.mmr(q, _of_queries(best, c), 0.7, 10)
    chunks = _of_queries(diverse, c).join(F.broadcast(q), "query_id").select("query_id", F.col("id").alias("chunk_id"), "query", "text")
    short = compress.by_score(chunks).select("query_id", F.col("chunk_id").alias("id"), F.length("text").alias("n_chars"), "kept_sentences")
    return diverse.select("query_id", "id", "mmr_rank", "rerank_score").join(short, ["query_id", "id"])
