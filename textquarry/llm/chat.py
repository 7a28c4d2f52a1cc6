"""Chat formatting by grammar round trip, with DataFrame functions only.

Grammar of a formatted conversation, turn after turn:

    user        [INST] text [/INST]
    assistant   <s>text</s>
    any other   <<SYS>>role, newline, text<</SYS>>       (role URL-encoded; null role: empty)

A control string inside a text is escaped by one more backslash after its first
character; strings that already look escaped gain one as well, so taking one away
restores every text.  A conversation is first rendered as it is and parsed back; only
where the turns differ from the source are its texts escaped, and the parse is compared again.

A conversation whose output still does not parse back to its turns ends the query with an error;
no input is known that does.

Null text is empty text.  Turns are ordered by ``turn`` (nulls first), ties by role, then text.
Rows whose conversation id is null form one conversation with a null id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import quoted

_CONTROL = r"(/?INST\]|/?s>|</?SYS>>)"
_TURN = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])\\(\\*)" + _CONTROL, r"$1$2$3")


def _render_turn(role: Column, text: Column) -> Column:
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit("<s>"), text, F.lit("</s>")))
        .otherwise(F.concat(F.lit("<<SYS>>"), F.url_encode(role), F.lit("\n"), text, F.lit("<</SYS>>")))
    )


def _parse_turn(raw: Column) -> Column:
    inner = F.substring(raw, F.lit(8), F.length(raw) - 15)
    nl = F.instr(inner, "\n")
    role = F.when(raw.startswith("[INST] "), F.lit("user")).when(raw.startswith("<s>"), F.lit("assistant")).otherwise(F.try_url_decode(F.substring(inner, F.lit(1), nl - 1)))
    text = F.when(raw.startswith("[INST] "), inner).when(raw.startswith("<s>"), F.substring(raw, F.lit(4), F.length(raw) - 7)).otherwise(F.substring(inner, nl + 1, F.length(inner)))
    return F.struct(role.alias("role"), unescape(text).alias("text"))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted conversation."""
    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), _parse_turn)


def loss_spans(formatted: Column) -> Column:
    """array<struct<start,end>>: code points, end exclusive, of the assistants' texts as they stand in the output."""
    spans = F.aggregate(
        F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t)).alias("at"),
            F.when(t.startswith("<s>"), F.concat(a["spans"], F.array(F.struct((a["at"] + 3).alias("start"), (a["at"] + F.length(t) - 4).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return spans


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, formatted, loss_spans, escaped (whether it had to be) and round_trip (true, or the query fails)."""
    turn = F.struct(quoted(turn_col).alias("turn"), F.coalesce(quoted(role_col), F.lit("")).alias("role"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    grouped = conversations.select(quoted(id_col).alias("id"), turn.alias("t")).groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    source = grouped.select("id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    plain = F.array_join(F.transform("turns", lambda t: _render_turn(t["role"], t["text"])), "")
    careful = F.array_join(F.transform("turns", lambda t: _render_turn(t["role"], escape(t["text"]))), "")
    tried = source.withColumn("plain", plain).withColumn("clean", parse_turns(F.col("plain")) == F.col("turns"))
    done = tried.withColumn("formatted", F.when(F.col("clean"), F.col("plain")).otherwise(careful))
    same = parse_turns(F.col("formatted")) == F.col("turns")
    sure = done.withColumn("round_trip", F.when(same, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no round trip: "), F.col("formatted")))))
    return sure.select(F.col("id").alias(id_col), "formatted", loss_spans(F.col("formatted")).alias("loss_spans"), (~F.col("clean")).alias("escaped"), "round_trip")
