"""Experiment runs: a driver-side tracker that appends JSON rows, and queries over them."""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN_SCHEMA = "run_id string, name string, status string, start_time string, end_time string, duration_seconds double, params map<string,string>, metrics map<string,double>, tags array<string>, artifacts map<string,string>, notes string"


class Run:
    """What one run logs; saved when its block ends, whether it failed or not."""

    def __init__(self, name: str, tags: list[str] | None = None):
        self.name, self.status, self.tags, self.notes = name, "created", list(tags or []), ""
        self.params: dict[str, str] = {}
        self.metrics: dict[str, float] = {}
        self.artifacts: dict[str, str] = {}
        self.run_id = f"{name[:40].replace(' ', '_')}_{datetime.now(timezone.utc):%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:6]}"

    def log_param(self, key: str, value) -> None:
        self.params[key] = str(value)

    def log_params(self, values: dict) -> None:
        for k, v in values.items():
            self.log_param(k, v)

    def log_metric(self, key: str, value: float) -> None:
        self.metrics[key] = float(value)

    def log_metrics(self, values: dict[str, float]) -> None:
        for k, v in values.items():
            self.log_metric(k, v)

    def log_artifact(self, name: str, data) -> None:
        self.artifacts[name] = data if isinstance(data, str) else data.decode("utf-8", "replace") if isinstance(data, bytes) else json.dumps(data, default=str)

    def set_tag(self, tag: str) -> None:
        if tag not in self.tags:
            self.tags.append(tag)

    def set_notes(self, notes: str) -> None:
        self.notes = notes


class Tracker:
    """Runs in a folder that the session's file system can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @contextmanager
    def start_run(self, name: str, tags: list[str] | None = None):
        run, began, clock = Run(name, tags), datetime.now(timezone.utc), time.monotonic()
        run.status = "running"
        try:
            yield run
            run.status = "completed"
        except BaseException:
            run.status = "failed"
            raise
        finally:
            ended = datetime.now(timezone.utc)
            row = (run.run_id, run.name, run.status, began.isoformat(), ended.isoformat(), time.monotonic() - clock, run.params, run.metrics, run.tags, run.artifacts, run.notes)
            self.spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("append").json(self.path)

    def runs(self) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).json(self.path)

    def delete(self, run_id: str, to: str) -> None:
        """Writes the other runs to a new folder."""
        self.runs().where(F.col("run_id") != run_id).write.mode("overwrite").json(to)


def list_runs(runs: DataFrame, name: str | None = None, tag: str | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    """Newest first; the name filter is a case-insensitive part of the name."""
    if name:
        runs = runs.where(F.lower("name").contains(name.lower()))
    if tag:
        runs = runs.where(F.array_contains("tags", tag))
    if status:
        runs = runs.where(F.col("status") == status)
    return runs.orderBy(F.desc("start_time"), F.desc("run_id")).limit(limit)


def compare(runs: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """(metric, run_id, value, best): best marks the maximum of a metric, if several runs are compared."""
    rows = runs.select("run_id", F.explode("metrics").alias("metric", "value"))
    if metrics:
        rows = rows.where(F.col("metric").isin(metrics))
    whole = Window.partitionBy("metric")
    n = runs.agg(F.countDistinct("run_id").alias("n"))
    return rows.join(F.broadcast(n)).withColumn("best", (F.col("value") == F.max("value").over(whole)) & (F.col("n") > 1)).drop("n")


def best_run(runs: DataFrame, metric: str, higher_is_better: bool = True) -> DataFrame:
    """The completed run with the best value of the metric; ties go to the newest."""
    done = runs.where((F.col("status") == "completed") & F.col("metrics")[metric].isNotNull()).withColumn("value", F.col("metrics")[metric])
    return done.orderBy(F.desc("value") if higher_is_better else F.asc("value"), F.desc("start_time"), F.desc("run_id")).limit(1)
