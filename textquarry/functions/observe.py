"""Driver-side logging and timing: JSON lines, correlation ids, timed calls that feed metric samples."""

from __future__ import annotations

import contextvars
import functools
import json
import logging
import time
import uuid
from datetime import datetime, timezone

_correlation: contextvars.ContextVar[str] = contextvars.ContextVar("correlation", default="")

#: (name, value in ms, time) of the timed calls of this process, for ``samples``.
_timings: list[tuple[str, float, datetime]] = []


def new_correlation(value: str | None = None) -> str:
    _correlation.set(value or uuid.uuid4().hex)
    return _correlation.get()


def correlation() -> str:
    return _correlation.get()


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"time": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage(), "correlation_id": correlation() or None}
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        return json.dumps(out | getattr(record, "fields", {}), default=str)


def setup(level: str = "INFO", as_json: bool = True) -> logging.Logger:
    """One handler on the package's logger, however often it is called."""
    log = logging.getLogger("textquarry")
    log.handlers = [logging.StreamHandler()]
    log.handlers[0].setFormatter(JsonLines() if as_json else logging.Formatter("%(asctime)s %(levelname)-8s %(name)s %(message)s"))
    log.setLevel(level)
    log.propagate = False
    return log


def timed(name: str):
    """Decorator: logs how long a call took, failed or not, and keeps it as a latency sample."""

    def wrap(f):
        @functools.wraps(f)
        def run(*args, **kwargs):
            began = time.perf_counter()
            try:
                return f(*args, **kwargs)
            finally:
                ms = (time.perf_counter() - began) * 1000
                _timings.append((name, ms, datetime.now(timezone.utc).replace(tzinfo=None)))
                logging.getLogger("textquarry").info("%s took %.1f ms", name, ms)

        return run

    return wrap


def samples(spark):
    """The timed calls as rows (name, labels, value, ts) for the metric operators."""
    return spark.createDataFrame([(n, {}, v, t) for n, v, t in _timings], "name string, labels map<string,string>, value double, ts timestamp")


def reset() -> None:
    _timings.clear()
