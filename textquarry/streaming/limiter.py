"""Token buckets per endpoint, by event time: a batch replay and a streaming processor with one state."""

from __future__ import annotations

import functools
import threading
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def step(tokens: float, last: float, now: float, asked: float, rate: float, burst: float) -> tuple[float, bool]:
    """Refills for the time passed, then takes what is asked if it is there."""
    tokens = min(burst, tokens + max(0.0, now - last) * rate)
    return (tokens - asked, True) if tokens >= asked else (tokens, False)


Limits = dict[str, tuple[float, float]]


def replay(calls: DataFrame, rate: float = 10.0, burst: float = 20.0, limits: Limits | None = None) -> DataFrame:
    """(endpoint, call_id, ts, allowed, tokens_left) of calls (endpoint, call_id, ts, tokens) in the order of (ts, call_id).

    ``limits``: (rate, burst) of endpoints that have their own.

    The bucket is a fold over one endpoint's calls.  They are sorted by Spark and stream through in
    batches, so an endpoint with a third of all calls needs no more memory than any other.
    """
    kind = dict(calls.dtypes)["call_id"]
    ordered = calls.select("endpoint", "call_id", "ts", F.col("tokens").cast("double").alias("tokens")).repartition("endpoint").sortWithinPartitions("endpoint", "ts", "call_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, left, last = None, burst, 0.0
        for pdf in batches:
            allowed, remaining = [], []
            for endpoint, ts, asked in zip(pdf["endpoint"], pdf["ts"], pdf["tokens"]):
                now = ts.timestamp()
                if endpoint != at:
                    speed, most = (limits or {}).get(endpoint, (rate, burst))
                    at, left, last = endpoint, most, now
                left, ok = step(left, last, now, asked, speed, most)
                last = now
                allowed.append(ok)
                remaining.append(left)
            yield pdf[["endpoint", "call_id", "ts"]].assign(allowed=allowed, tokens_left=remaining)

    return ordered.mapInPandas(run, f"endpoint string, call_id {kind}, ts {dict(calls.dtypes)['ts']}, allowed boolean, tokens_left double")


def statistics(decisions: DataFrame) -> DataFrame:
    """(endpoint, total, allowed, throttled, throttle_rate)."""
    throttled = F.count_if(~F.col("allowed"))
    return decisions.groupBy("endpoint").agg(F.count("*").alias("total"), F.count_if("allowed").alias("allowed"), throttled.alias("throttled"), (throttled / F.count("*")).alias("throttle_rate"))


def stream(calls: DataFrame, rate: float = 10.0, burst: float = 20.0, limits: Limits | None = None) -> DataFrame:
    """The same decisions over a stream: (endpoint, call_id, ts, allowed, tokens_left); the state is the bucket and its last time."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        speed, most = (limits or {}).get(key[0], (rate, burst))
        left, last = state.get if state.exists else (most, None)
        for pdf in [pd.concat(list(batches))]:
            pdf = pdf.sort_values(["ts", "call_id"])
            allowed, remaining = [], []
            for ts, asked in zip(pdf["ts"], pdf["tokens"]):
                now = ts.timestamp()
                left, ok = step(left, now if last is None else last, now, asked, speed, most)
                last = now if last is None else max(last, now)
                allowed.append(ok)
                remaining.append(left)
            state.update((float(left), float(last)))
            yield pdf[["endpoint", "call_id", "ts"]].assign(allowed=allowed, tokens_left=remaining)

    return calls.select("endpoint", "call_id", "ts", F.col("tokens").cast("double").alias("tokens")).groupBy("endpoint").applyInPandasWithState(
        run, f"endpoint string, call_id {dict(calls.dtypes)['call_id']}, ts {dict(calls.dtypes)['ts']}, allowed boolean, tokens_left double", "left double, last double", "append", "NoTimeout"
    )


class Bucket:
    """One bucket on the wall clock, for callers of remote providers in this process."""

    def __init__(self, rate: float = 10.0, burst: float = 20.0, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.lock, self.total, self.allowed, self.throttled, self.waited = threading.Lock(), 0, 0, 0, 0.0
        self.reset()

    def reset(self) -> None:
        self.left, self.last = float(self.burst), self.clock()

    def _take(self, asked: float) -> bool:
        now = self.clock()
        self.left, ok = step(self.left, self.last, now, asked, self.rate, self.burst)
        self.last = now
        return ok

    def available_tokens(self) -> float:
        with self.lock:
            self._take(0)
            return self.left

    def acquire(self, tokens: float = 1) -> bool:
        with self.lock:
            ok = self._take(tokens)
            self.total += 1
            self.allowed, self.throttled = self.allowed + ok, self.throttled + (not ok)
            return ok

    def acquire_blocking(self, tokens: float = 1, timeout: float = 30.0) -> bool:
        """Waits until there are enough tokens; false once the timeout has passed."""
        began = self.clock()
        while (passed := self.clock() - began) < timeout:
            if self.acquire(tokens):
                self.waited += passed
                return True
            self.sleep(max(0.0, min(tokens / self.rate, timeout - passed)))
        self.throttled += 1
        return False

    def throttle_rate(self) -> float:
        return self.throttled / self.total if self.total else 0.0


class Buckets:
    """Buckets by endpoint; those not registered get the default limits at their first call."""

    def __init__(self, rate: float = 10.0, burst: float = 20.0):
        self.default, self.held = (rate, burst), {}

    def register(self, endpoint: str, rate: float, burst: float) -> None:
        self.held[endpoint] = Bucket(rate, burst)

    def acquire(self, endpoint: str = "default", tokens: float = 1) -> bool:
        return self.held.setdefault(endpoint, Bucket(*self.default)).acquire(tokens)

    def statistics(self) -> dict[str, dict]:
        return {e: {"total": b.total, "allowed": b.allowed, "throttled": b.throttled, "waited": b.waited, "throttle_rate": b.throttle_rate()} for e, b in self.held.items()}


def rate_limit(rate: float = 10.0, burst: float = 20.0):
    """Decorates a function so that its calls wait for tokens; the bucket is its attribute ``bucket``."""
    bucket = Bucket(rate, burst)

    def decorate(call):
        @functools.wraps(call)
        def waiting(*args, **kwargs):
            bucket.acquire_blocking()
            return call(*args, **kwargs)

        waiting.bucket = bucket
        return waiting

    return decorate


def fresh_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", ts_col: str | None = None, within: str = "30 days") -> DataFrame:
    """Exact incremental dedup over a stream: the first of each normalised text passes.

    With ``ts_col`` the state forgets a text once the watermark is ``within`` past it; without, it grows with the stream.
    """
    from textquarry.operators.dedup import fingerprint

    marked = docs.withColumn("content", fingerprint(F.col(text_col)))
    return marked.withWatermark(ts_col, within).dropDuplicatesWithinWatermark(["content"]) if ts_col else marked.dropDuplicates(["content"])
