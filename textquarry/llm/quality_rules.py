"""Quality rules as weak supervision, with DataFrame functions only.

Each rule votes -1 (bad), 1 (good) or 0 (abstains).  Documents are counted by their vote
pattern, of which there are at most 3**rules however many documents there are; expectation
maximisation runs over that small table and estimates, per rule and class, how often it
casts each vote.  A document's posterior probability of being good decides.

Null and empty texts have no words: the base test fails them.  Repeated rows and ids each
keep their result; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint, quoted

#: Rounds after which expectation maximisation is given up with an error.
ROUNDS = 1000
SPACE = r"[ \t-\r]+"


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the counts the rules read, and ``keep`` columns as struct ``kept``; one row per input row.

    Repeated 3-word windows are found inside the row: their 64-bit hashes, sorted with their
    positions, put equal windows side by side.  Only documents in which some hash
    occurs twice are sorted.  No limit on words or lines.
    """
    text = F.coalesce(quoted(text_col), F.lit(""))
    df = docs.select(quoted(id_col).alias("id"), F.struct(*[quoted(c) for c in keep] or [F.lit(0).alias("none")]).alias("kept"), text.alias("text"))
    df = df.select("id", "kept", "text", F.array_remove(F.split("text", SPACE), "").alias("words"), F.split("text", "\n").alias("all_lines"))
    count = lambda rx: F.length(F.regexp_replace("text", rx, "")).cast("bigint")
    df = df.select(
        "id",
        "kept",
        "words",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        count(r"[^#*$%&|<>]+").alias("n_symbols"),
        count(r"[^\p{Lu}]+").alias("n_upper"),
        count(r"[^!?]+").alias("n_shouts"),
        count(r"[^.]+").alias("n_stops"),
        F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct"),
        F.filter("all_lines", lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"),
        F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))).alias("grams"),
    )
    df = df.select("*", F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines")).drop("lines", "words")
    df = df.withColumn("sorted", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter("sorted", lambda x, i: F.coalesce(F.get("sorted", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("sorted", i + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("again", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(
        "again",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(a["reach"], p)).alias("n"), (p + 3).alias("reach")),
        lambda a: a["n"],
    )
    return df.select("id", "kept", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"), "n_lines", "n_distinct", "n_upper", "n_shouts", "n_stops")


@dataclass(frozen=True)
class Rule:
    """A named vote, -1, 0 or 1, over the measured counts."""

    name: str
    vote: Column


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _steps(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), F.lit(0)).when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def default_rules() -> list[Rule]:
    """Votes on repetition, variety, repeated lines, capitals, exclamation, symbols, word length and sentences.

    Each kind of junk is named by two rules at least, so that agreement between rules, which
    is all that expectation maximisation has to go by, tells their accuracy.
    """
    repeat, dup, upper = _ratio("n_repeat_words", "n_words"), _ratio("n_dup_lines", "n_lines"), _ratio("n_upper", "word_chars")
    shout, symbol, mean, stops = _ratio("n_shouts", "n_words"), _ratio("n_symbols", "n_words"), _ratio("word_chars", "n_words"), _ratio("n_stops", "n_words")
    distinct, share, never = _ratio("n_distinct", "n_words"), _ratio("n_symbols", "word_chars"), F.lit(False)
    return [
        Rule("repeats", _steps(repeat, repeat < 0.1, repeat > 0.3)),
        Rule("variety", _steps(distinct, never, distinct < 0.2)),
        Rule("repeated_lines", _steps(dup, never, dup > 0.5)),
        Rule("capitals", _steps(upper, never, upper > 0.4)),
        Rule("shouting", _steps(shout, never, shout > 0.2)),
        Rule("symbols", _steps(symbol, symbol < 0.02, symbol > 0.1)),
        Rule("symbol_share", _steps(share, never, share > 0.02)),
        Rule("word_length", _steps(mean, never, (mean < 2) | (mean > 15))),
        Rule("sentences", _steps(stops, (stops >= 0.02) & (stops <= 0.3), (stops < 0.004) | (stops > 0.7))),
    ]


@dataclass(frozen=True)
class LabelModel:
    """prior: share of good documents; chance[(rule, class, vote)]: how often the rule casts the vote in the class."""

    prior: float
    chance: dict[tuple[str, int, int], float]

    def weight(self, rule: str, vote: int) -> float:
        """Evidence of a vote; abstaining is none."""
        return 0.0 if vote == 0 else math.log(self.chance[rule, 1, vote] / self.chance[rule, 0, vote])

    def weights(self, rules: list[str]) -> Column:
        """The prior's evidence, then that of each rule's votes -1, 0 and 1."""
        found = [math.log(self.prior / (1 - self.prior)), *[self.weight(r, v) for r in rules for v in (-1, 0, 1)]]
        # an array that is folded to one literal, so that the code generated for a round serves the next
        return F.split(F.lit(",".join(map(repr, found))), ",").cast("array<double>")

    def posterior(self, rules: list[str]) -> Column:
        """Probability of being good, of the columns of votes named as the rules."""
        held = self.weights(rules)
        odds = F.get(held, F.lit(0))
        for k, r in enumerate(rules):
            odds = odds + F.get(held, F.col(r) + F.lit(3 * k + 2))
        return 1 / (1 + F.exp(-odds))

    def posterior_of(self, rules: list[str], votes: str) -> Column:
        """The same, of one array of votes in the order of the rules."""
        held = self.weights(rules)
        odds = F.aggregate(F.transform(votes, lambda v, i: F.get(held, v + 3 * i + 2)), F.get(held, F.lit(0)), lambda a, x: a + x)
        return 1 / (1 + F.exp(-odds))


def first_guess(rules: list[str], prior: float = 0.85) -> LabelModel:
    """What a rule is taken for before the data speak: rarely wrong, and a bad vote rarer still in good documents."""
    chance = {}
    for r in rules:
        chance |= {(r, 1, -1): 0.004, (r, 1, 0): 0.196, (r, 1, 1): 0.80, (r, 0, -1): 0.25, (r, 0, 0): 0.15, (r, 0, 1): 0.60}
    return LabelModel(prior, chance)


def fit(votes: DataFrame, rules: list[str], tolerance: float = 1e-4, strength: float = 0.1, false_alarms: float = 0.01) -> LabelModel:
    """Expectation maximisation over the pattern counts of all documents, until no chance moves by more than ``tolerance``.

    ``strength``: weight of the first guess, as a share of the documents of each class; it
    keeps the classes from trading places.  ``false_alarms`` bounds how often a rule is taken
    to vote bad on a good document, so that a common kind of junk cannot pass for normal.
    An empty table gives the first guess.
    """
    guess = model = first_guess(rules)
    patterns = votes.groupBy(*rules).agg(F.count("*").alias("n")).select("n", F.array(*rules).alias("votes"))
    patterns = checkpoint(patterns.coalesce(1))  # at most 3**rules rows
    for _ in range(ROUNDS):
        cast = patterns.select("n", model.posterior_of(rules, "votes").alias("p"), "votes").select("n", "p", F.posexplode("votes").alias("rule", "vote"))
        sums = cast.groupBy("rule", "vote").agg(F.sum(F.col("n") * F.col("p")).alias("good"), F.sum(F.col("n") * (1 - F.col("p"))).alias("bad"))
        got = {(rules[s["rule"]], s["vote"]): s for s in sums.collect()}  # at most three rows a rule
        if not got:
            break
        good, bad = (sum(s[c] for (r, _), s in got.items() if r == rules[0]) for c in ("good", "bad"))
        weight = strength * (good + bad)
        chance = {}
        for r in rules:
            for v in (-1, 0, 1):
                g, b = (got[r, v]["good"], got[r, v]["bad"]) if (r, v) in got else (0.0, 0.0)
                chance[r, 1, v] = (g + weight * guess.chance[r, 1, v]) / (good + weight)
                chance[r, 0, v] = (b + weight * guess.chance[r, 0, v]) / (bad + weight)
            chance[r, 1, -1] = min(chance[r, 1, -1], false_alarms)
        before, model = model, LabelModel(min(0.99, max(0.01, good / (good + bad))), chance)
        if max(abs(chance[x] - before.chance[x]) for x in chance) <= tolerance:
            break
    else:
        raise RuntimeError(f"the chances still moved after {ROUNDS} rounds")
    return model


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the measured counts, the votes, posterior, base_failed, kept_doc and the ``keep`` columns as struct ``kept``."""
    rules = default_rules() if rules is None else rules
    names = [f"vote_{r.name}" for r in rules]
    measured = checkpoint(measure(docs, id_col, text_col, keep))  # numbers, so that texts are measured once
    voted = measured.withColumns({n: r.vote for n, r in zip(names, rules)})
    model = fit(voted, names)
    scored = voted.withColumn("posterior", model.posterior(names))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept_doc", ~F.col("base_failed") & (F.col("posterior") >= threshold)).withColumnRenamed("id", id_col if id_col != "kept" else "id")
