"""The registered queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.shipping import ship

from . import chat, classifier, decontaminate, line_dedup, ngram_join, packing, pii, quality_rules, substring, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
with lowered as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
items as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark),
wins as (select item_id, least(len(w), 10) n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda p: array_to_string(w[p:p + least(len(w), 10) - 1], ' '))) win from items where len(w) > 0),
sizes as (select distinct n from wins),
starts as (select doc_id, n, unnest(range(1, len(w) - n + 2)) p, w from lowered, sizes where len(w) >= n),
hits as (select s.doc_id, s.p, s.n, x.item_id from (select doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') win from starts) s join wins x on x.win = s.win and x.n = s.n),
covered as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + n)) q from (select distinct doc_id, p, n from hits)) group by doc_id),
named as (select doc_id, count(*) n_items, string_agg(i, ',' order by i) ids from (select distinct doc_id, cast(item_id as varchar) i from hits) group by doc_id)
select l.doc_id, cast(len(l.w) as bigint) n_words, cast(coalesce(c.n_hit, 0) as bigint) n_hit, cast(coalesce(n.n_items, 0) as bigint) n_items, sha256(coalesce(n.ids, '')) items_sha256, coalesce(c.n_hit, 0) > 0 contaminated
from lowered l left join covered c using (doc_id) left join named n using (doc_id)
"""


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select -7L conv_id, turn, role, '</s>[INST] ok [/INST]' text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    done = chat.format_chats(rows.unionByName(extra))
    turns = chat.parse_turns(F.col("formatted"))
    loss = F.transform("loss_spans", lambda s: chat.unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"])))
    read = done.select("conv_id", "formatted", "round_trip", turns.alias("turns"), F.array_join(loss, "").alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "round_trip",
    )


OP4_SQL = r"""
with rows_ as (select conv_id, turn, role, coalesce(text, '') t from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
needs as (select conv_id, bool_or(regexp_matches(t, '[\[<]\\*(/?INST\]|/?s>|</?SYS>>)')) e from rows_ group by conv_id),
made as (select r.*, case when e then regexp_replace(t, '([\[<])(\\*)(/?INST\]|/?s>|</?SYS>>)', '\1\\\2\3', 'g') else t end x from rows_ r join needs using (conv_id))
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn)) turns_sha256,
  cast(coalesce(sum(length(t)) filter (role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum(length(x) + case role when 'user' then 15 when 'assistant' then 7 else 16 + length(role) end) as bigint) formatted_chars,
  true round_trip
from made group by conv_id
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score_quality(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("kept_doc").alias("kept"), F.round("posterior", 6).alias("posterior"))


OP7_SQL = r"""
with recursive docs as (select doc_id, row_number() over () rid, t, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) l from (select doc_id, coalesce(text, '') t from documents)),
wins as (select rid, unnest(range(1, len(w) - 1)) p, unnest(list_transform(range(1, len(w) - 1), lambda p: w[p] || ' ' || w[p + 1] || ' ' || w[p + 2])) s from docs),
again as (select rid, p from wins qualify count(*) over (partition by rid, s) > 1),
covered as (select rid, count(distinct q) n from (select rid, unnest([p, p + 1, p + 2]) q from again) group by rid),
measured as (select doc_id, rid, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars, cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) n_symbols,
  cast(len(l) - len(list_distinct(l)) as bigint) n_dup_lines, cast(coalesce(n, 0) as bigint) n_repeat_words, greatest(len(l), 1)::double n_lines, len(list_distinct(w)) n_distinct,
  length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) n_upper, length(regexp_replace(t, '[^!?]+', '', 'g')) n_shouts, length(regexp_replace(t, '[^.]+', '', 'g')) n_stops from docs left join covered using (rid)),
ratios as (select *, greatest(n_words, 1)::double nw, greatest(word_chars, 1)::double nc from measured),
voted as (select *, [case when n_repeat_words / nw > 0.3 then -1 when n_repeat_words / nw < 0.1 then 1 else 0 end, case when n_distinct / nw < 0.2 then -1 else 0 end, case when n_dup_lines / n_lines > 0.5 then -1 else 0 end,
  case when n_upper / nc > 0.4 then -1 else 0 end, case when n_shouts / nw > 0.2 then -1 else 0 end, case when n_symbols / nw > 0.1 then -1 when n_symbols / nw < 0.02 then 1 else 0 end, case when n_symbols / nc > 0.02 then -1 else 0 end,
  case when word_chars / nw < 2 or word_chars / nw > 15 then -1 else 0 end, case when n_stops / nw < 0.004 or n_stops / nw > 0.7 then -1 when n_stops / nw between 0.02 and 0.3 then 1 else 0 end] votes from ratios),
patterns as (select votes, count(*)::double n from voted group by votes),
cast_ as (select votes, n, unnest(votes) v, unnest(range(1, 10)) k from patterns),
guess as (select k, v, g, b from (select unnest(range(1, 10)) k), (values (-1, 0.004::double, 0.25::double), (0, 0.196, 0.15), (1, 0.8, 0.6)) c(v, g, b)),
em as (select 0 it, k, v, g, b, 0.85::double prior, 1::double moved from guess
  union all select it, k, v, g, b, prior, max(greatest(abs(g - old_g), abs(b - old_b))) over () moved from (
    with p as (select votes, n, max(it) it, 1 / (1 + exp(-(ln(max(prior) / (1 - max(prior))) + sum(case when v = 0 then 0 else ln(g / b) end)))) p from cast_ join em using (k, v) where moved > 1e-4 group by votes, n),
    total as (select sum(n * p) good, sum(n * (1 - p)) bad, sum(n) al, max(it) it from p),
    sums as (select k, v, sum(c.n * p) g, sum(c.n * (1 - p)) b from cast_ c join p using (votes) group by k, v)
    select total.it + 1 it, x.k, x.v, least((coalesce(s.g, 0) + 0.1 * al * x.g) / (good + 0.1 * al), case when x.v = -1 then 0.01 else 1 end) g, (coalesce(s.b, 0) + 0.1 * al * x.b) / (bad + 0.1 * al) b,
      least(0.99, greatest(0.01, good / al)) prior, em.g old_g, em.b old_b
    from total, guess x join em on em.k = x.k and em.v = x.v left join sums s on s.k = x.k and s.v = x.v where al is not null)),
model as (select * from em where it = (select max(it) from em)),
judged as (select votes, 1 / (1 + exp(-(ln(max(prior) / (1 - max(prior))) + sum(case when v = 0 then 0 else ln(g / b) end)))) p from cast_ join model using (k, v) group by votes)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and p >= 0.5 kept, round(p, 6) posterior
from voted join judged using (votes)
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_table(token_counts.length_histogram(_table(spark, sf_dir, "documents")))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP3_SQL = r"""
with recursive docs as (select doc_id, row_number() over () rid, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
sets as (select doc_id, rid, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda p: w[p] || ' ' || w[p + 1] || ' ' || w[p + 2]) end) s from docs),
rows_ as (select rid, len(s) n, unnest(s) x from sets),
links as (select a.rid a, b.rid b from rows_ a join rows_ b on a.x = b.x and a.rid <> b.rid and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) group by a.rid, b.rid, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach as (select rid, rid other from sets union select r.rid, l.b from reach r join links l on l.a = r.other)
select s.doc_id, cast(len(s.s) as bigint) n_shingles, c.component_id
from sets s join (select r.rid, min(o.doc_id) component_id from reach r join sets o on o.rid = r.other group by r.rid) c using (rid)
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("spans"), pii.BASE).cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"), F.round(F.array_max(F.transform("spans", lambda s: s["score"])), 2).alias("top_score"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_report(_table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.size("removed").cast("bigint").alias("n_removed"), F.array_join("removed", ",").alias("removed"), F.sha2(F.coalesce("left", F.lit("")).cast("binary"), 256).alias("left_sha256")
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = classifier.fit(docs, _table(spark, sf_dir, "labels"))
    scored = classifier.score(docs, model)
    held = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
with docs as (select doc_id, row_number() over () rid, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
words as (select rid, unnest(w) x, unnest(range(1, len(w) + 1)) p from docs),
wins as (select rid, p, md5(string_agg(x, ' ') over (partition by rid order by p rows between current row and 34 following)) h, count(*) over (partition by rid order by p rows between current row and 34 following) n from words),
again as (select rid, p from wins where n = 35 qualify count(*) over (partition by h) > 1),
gone as (select distinct rid, p + i p from again, (select unnest(range(0, 35)) i)),
kept as (select rid, string_agg(x, ' ' order by p) t, count(*) n from words anti join gone using (rid, p) group by rid)
select doc_id, cast(len(w) as bigint) n_words, cast(len(w) - coalesce(n, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256 from docs left join kept using (rid)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_token_counts": op2_token_counts,
        "op3_ngram_jaccard": op3_ngram_jaccard,
        "op4_chat_formatting": op4_chat_formatting,
        "op5_packing": op5_packing,
        "op6_pii": op6_pii,
        "op7_quality_rules": op7_quality_rules,
        "op8_line_dedup": op8_line_dedup,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_substring_dedup": op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op3_ngram_jaccard": OP3_SQL, "op4_chat_formatting": OP4_SQL, "op7_quality_rules": OP7_SQL, "op10_substring_dedup": OP10_SQL}
