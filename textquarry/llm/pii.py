"""Personal data: regular expressions propose, checksums confirm, context words score.

Kinds: email, ip, card (Luhn), phone, iban (mod 97), ssn, key (well-known forms of access keys) and
secret (a long token of mixed characters).  The base kinds, the first four, always stay in the result with
their score; of the others a span counts if its score reaches ``LEAST_SCORE``, so a social security
number or a bare token needs a word that names it nearby.  Every search is linear in the text, however long its runs of one
character class are.  Offsets are code points, end exclusive.

Null and empty texts give an empty list; each input row gives one result row.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import quoted

#: In the order of results; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "key", "secret")
BASE = KINDS[:4]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,72}|AIza[0-9A-Za-z_-]{35}|sk[-_][0-9A-Za-z_-]{20,100})(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,128}={0,2}(?![A-Za-z0-9+/_=-])")
_ALNUM = re.compile(r"[A-Za-z0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"[a-z]+")

#: Words that make a kind likelier within WINDOW characters before or after the span.
CONTEXT = {
    "email": {"email", "mail", "contact", "write"},
    "ip": {"ip", "address", "host", "server"},
    "card": {"card", "visa", "credit", "payment", "mastercard"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax"},
    "iban": {"iban", "account", "bank", "transfer"},
    "ssn": {"ssn", "social", "security"},
    "key": {"key", "token", "access", "api"},
    "secret": {"token", "secret", "key", "apikey", "password", "passwd", "auth", "credential", "credentials", "bearer"},
}
#: Score before context; a checksum is strong evidence.
START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "key": 0.9, "secret": 0.3}
_NAMES = re.compile("|".join(sorted(CONTEXT["secret"])), re.I)
#: What spans of the added kinds must score to count.
LEAST_SCORE = 0.5
WINDOW = 40
BOOST = 0.25

#: Characters of an IBAN by country.
IBAN_LENGTH = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mixed(token: str) -> bool:
    """Whether a token looks drawn at random: digits and letters in turns, and many different characters."""
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    return turns >= len(token) // 6 and len(set(token)) >= 8


def mod97(code: str) -> bool:
    code = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in code)) % 97 == 1


def _emails(text: str):
    end = 0
    at = text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                yield start, m.end()
                end = m.end()
        at = text.find("@", at + 1)


def _ibans(text: str):
    """Spans that satisfy mod 97, of the country's length; where the country is not listed, up to the last word end that does."""
    done = 0
    for at in _IBAN_START.finditer(text):
        if at.start() < done or not (m := _IBAN.match(text, at.start())):
            continue
        code, ends = "", []
        for i in range(m.start(), m.end()):
            if text[i] != " ":
                code += text[i]
                if len(code) >= 15 and not _ALNUM.match(text, i + 1):
                    ends.append((len(code), i + 1))
        known = IBAN_LENGTH.get(code[:2])
        for n, end in reversed(ends):
            if known in (None, n) and mod97(code[:n]):
                yield m.start(), end
                done = end
                break


def find_spans(text: str | None, least_score: float = LEAST_SCORE) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; ``least_score`` binds the added kinds."""
    out: list[tuple[str, int, int, float]] = []
    if not text:
        return out

    def add(kind: str, start: int, end: int) -> None:
        near = _WORD.findall(f"{text[max(0, start - WINDOW) : start]} {text[end : end + WINDOW]}".lower())
        score = min(1.0, START_SCORE[kind] + (BOOST if CONTEXT[kind] & set(near) else 0.0))
        if kind in BASE or score >= least_score:
            out.append((kind, start, end, round(score, 2)))

    if "@" in text:
        for s, e in _emails(text):
            add("email", s, e)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            add("ip", m.start(), m.end())
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start():
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                add("card", m.start(), m.end())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                add("phone", m.start(), m.end())
    for s, e in _ibans(text):
        add("iban", s, e)
    for m in _SSN.finditer(text):
        add("ssn", m.start(), m.end())
    for m in _KEY.finditer(text):
        add("key", m.start(), m.end())
    if least_score > START_SCORE["secret"] and not _NAMES.search(text):
        return out
    known = {i for _, s, e, _ in out for i in (s, e)}
    for m in _SECRET.finditer(text):
        if m.start() not in known and m.end() not in known and mixed(m[0]):
            add("secret", m.start(), m.end())
    return out


_SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """One row per document: id and spans (kind, start, end, score)."""
    source = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in find_spans(t, least_score)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], ["id", "spans"])

    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("spans", T._parse_datatype_string(_SPANS))])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """``docs`` with every span of at least that score replaced by its kind in brackets; other columns as they were."""

    @F.pandas_udf("string")
    def cover(texts):
        def one(t):
            if not t:
                return t
            parts, end = [], 0
            for k, s, e, x in sorted(find_spans(t), key=lambda m: (m[1], -m[2])):
                if x >= least and s >= end:
                    parts += [t[end:s], f"[{k.upper()}]"]
                    end = e
            return "".join([*parts, t[end:]])

        return texts.map(one, na_action="ignore")

    return docs.select(*[cover(quoted(c)).alias(c) if c == text_col else quoted(c) for c in docs.columns])


def joined(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end, comma-joined, of the spans of those kinds."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
