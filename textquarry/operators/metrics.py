"""Counters, gauges and histograms over sample rows (name, labels map, value, ts), and health roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import fixed

BOUNDS = {"latency": fixed.LATENCY_MS, "result_count": fixed.RESULT_COUNT, "doc_size": fixed.DOC_SIZE}


def bounds_for(name: str) -> list[int]:
    return BOUNDS.get(name, fixed.LATENCY_MS)


def label_key(labels: Column) -> Column:
    """k="v" of the sorted labels, comma-joined."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")


def counters(samples: DataFrame) -> DataFrame:
    return samples.groupBy("name", label_key(F.coalesce("labels", F.create_map().cast("map<string,string>"))).alias("labels")).agg(F.sum("value").alias("value"))


def gauges(samples: DataFrame) -> DataFrame:
    """The last value written; of two at one time, the larger."""
    return samples.groupBy("name").agg(F.max_by("value", F.struct("ts", "value")).alias("value"))


def histogram(samples: DataFrame, bounds: list[float] | None = None, by: str = "name") -> DataFrame:
    """(name, le, count): cumulative buckets, the last bound infinite."""
    bounds = fixed.LATENCY_MS if bounds is None else bounds
    counted = samples.groupBy(by).agg(*[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count("*").alias("all"))
    rows = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("count")))
    return counted.select(F.col(by).alias("name"), F.inline(rows))


def histogram_summary(samples: DataFrame, by: str = "name") -> DataFrame:
    return samples.groupBy(by).agg(F.count("*").alias("count"), F.round(F.sum("value"), 4).alias("sum"), F.round(F.avg("value"), 4).alias("avg")).withColumnRenamed(by, "name")


def prometheus(samples: DataFrame, kinds: DataFrame | None = None, uptime_seconds: float | None = None, bounds: list[float] | None = None) -> DataFrame:
    """Text exposition, one line per row: (name, part, line); by name and part the lines are in order within a kind's block.

    kinds: (name, kind), kind one of counter, gauge, histogram; names it lacks are counters.  Dots and dashes in
    names become underscores.
    """
    safe = F.translate("name", ".-", "__")
    kind = F.lit("counter")
    if kinds is not None:
        samples = samples.join(F.broadcast(kinds.select("name", "kind")), "name", "left")
        kind = F.coalesce("kind", F.lit("counter"))
    samples = samples.withColumn("kind", kind)
    number = lambda c: F.col(c).cast("string")
    c = counters(samples.where("kind = 'counter'")).withColumn("name", safe)
    shown = F.when(F.col("labels") == "", F.col("name")).otherwise(F.concat("name", F.lit("{"), "labels", F.lit("}")))
    blocks = [c.select("name", F.lit(0).alias("part"), F.format_string("# TYPE %s counter", "name").alias("line")).distinct(), c.select("name", F.lit(1).alias("part"), F.concat_ws(" ", shown, number("value")).alias("line"))]
    if kinds is not None:
        g = gauges(samples.where("kind = 'gauge'")).withColumn("name", safe)
        blocks += [g.select("name", F.lit(0).alias("part"), F.format_string("# TYPE %s gauge", "name").alias("line")), g.select("name", F.lit(1).alias("part"), F.concat_ws(" ", "name", number("value")).alias("line"))]
        measured = samples.where("kind = 'histogram'")
        h, sums = histogram(measured, bounds).withColumn("name", safe), histogram_summary(measured).withColumn("name", safe)
        blocks += [
            sums.select("name", F.lit(0).alias("part"), F.format_string("# TYPE %s histogram", "name").alias("line")),
            h.select("name", F.lit(1).alias("part"), F.concat("name", F.lit('_bucket{le="'), "le", F.lit('"} '), number("count")).alias("line")),
            sums.select("name", F.lit(2).alias("part"), F.concat("name", F.lit("_sum "), number("sum")).alias("line")),
            sums.select("name", F.lit(3).alias("part"), F.concat("name", F.lit("_count "), number("count")).alias("line")),
        ]
    if uptime_seconds is not None:
        text = ["# HELP app_uptime_seconds Application uptime in seconds", "# TYPE app_uptime_seconds gauge", f"app_uptime_seconds {uptime_seconds}"]
        blocks.append(samples.sparkSession.createDataFrame([("app_uptime_seconds", i, t) for i, t in enumerate(text)], "name string, part int, line string"))
    out = blocks[0]
    for more in blocks[1:]:
        out = out.unionByName(more)
    return out


def windowed(samples: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums per event-time window and name; batch or, with a watermark, streaming."""
    rows = samples.withWatermark("ts", late) if late else samples
    return rows.groupBy(F.window("ts", size), "name").agg(F.count("*").alias("count"), F.sum("value").alias("sum")).select(F.col("window.start").alias("start"), "name", "count", "sum")


def disk_status(free_share: Column) -> Column:
    return F.when(free_share < 0.05, "unhealthy").when(free_share < 0.15, "degraded").otherwise("healthy")


def overall(statuses: DataFrame) -> DataFrame:
    """The worst of (component, status); none is healthy."""
    level = F.max(F.when(F.col("status") == "unhealthy", 2).when(F.col("status") == "healthy", 0).otherwise(1))
    return statuses.agg(F.coalesce(level, F.lit(0)).alias("l")).select(F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unhealthy")), F.col("l") + 1).alias("status"))
