"""Counters, histograms, rates and alerts over request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds of the histograms' buckets.
DURATION_BUCKETS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
COST_BUCKETS = (0.00001, 0.0001, 0.001, 0.01, 0.1)
API_BUCKETS = (0.01, 0.05, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0)


def counter(log: DataFrame, *labels: str) -> DataFrame:
    return log.groupBy(*labels).agg(F.count("*").alias("value"))


def histogram(log: DataFrame, value: Column, bounds: tuple[float, ...], *labels: str) -> DataFrame:
    """Cumulative buckets as rows (labels, le, count), with the sum and the number.

    One aggregation with a count for each bound; the bounds become rows afterwards,
    so the log isn't multiplied.
    """
    n = len(bounds)
    counts = [F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    a = log.groupBy(*labels).agg(*counts, F.count(value).alias("n"), F.round(F.sum(value), 6).alias("total"))
    buckets = F.array(
        *(F.struct(F.lit(str(b)).alias("le"), F.lit(b).alias("bound"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)),
        F.struct(F.lit("+Inf").alias("le"), F.lit(float("inf")).alias("bound"), F.col("n").alias("count")),
    )
    assert n
    return a.select(*labels, "n", "total", F.explode(buckets).alias("b")).select(*labels, "b.le", "b.bound", "b.count", "n", "total")


def histogram_quantile(buckets: DataFrame, q: float, *labels: str) -> DataFrame:
    """The q-quantile of cumulative buckets, linear inside the first bucket that reaches
    it; the last finite bound if that is the open one; null without observations."""
    w = Window.partitionBy(*labels).orderBy("bound") if labels else Window.partitionBy(F.lit(1)).orderBy("bound")
    rank = F.lit(q) * F.col("n")
    b = buckets.withColumns({"below": F.coalesce(F.lag("count").over(w), F.lit(0)), "from": F.coalesce(F.lag("bound").over(w), F.lit(0.0))})
    inside = F.when(F.col("bound") == float("inf"), F.col("from")).otherwise(
        F.col("from") + (F.col("bound") - F.col("from")) * F.try_divide(rank - F.col("below"), F.col("count") - F.col("below"))
    )
    hit = (F.col("count") >= rank) & (F.col("n") > 0)
    return b.groupBy(*labels).agg(F.round(F.min_by(F.when(hit, inside), F.when(hit, F.col("bound"))), 6).alias("quantile"))


def rate(events: DataFrame, *, ts: str = "created_at", window: str = "5 minutes", every: str = "15 seconds", labels: tuple[str, ...] = ()) -> DataFrame:
    """Events a second over a sliding window, at each of its ends."""
    seconds = {"5 minutes": 300, "1 hour": 3600}.get(window) or int(window.split()[0])
    return events.groupBy(F.window(ts, window, every).alias("w"), *labels).agg(F.count("*").alias("n")).select(
        F.col("w.end").alias("at"), *labels, "n", F.round(F.col("n") / seconds, 6).alias("per_second")
    )


def increase(samples: DataFrame, *, by: list[str], ts: str, value: str) -> DataFrame:
    """Growth of counter samples by key; a fall means the counter began anew at 0."""
    w = Window.partitionBy(*by).orderBy(ts)
    before = F.lag(value).over(w)
    step = F.when(before.isNull(), 0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return samples.withColumn("step", step).groupBy(*by).agg(F.sum("step").alias("increase"))


def held(ticks: DataFrame, *, by: list[str], ts: str, firing: str, hold: str) -> DataFrame:
    """Stretches of ticks (by, since, until, ticks) on which the condition held without
    a break for at least the hold time."""
    w = Window.partitionBy(*by).orderBy(ts) if by else Window.partitionBy(F.lit(1)).orderBy(ts)
    marked = ticks.withColumn("island", F.sum((~F.col(firing)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.where(F.col(firing)).groupBy(*by, "island").agg(F.min(ts).alias("since"), F.max(ts).alias("until"), F.count("*").alias("ticks"))
    return runs.where(F.col("until") >= F.col("since") + F.expr(f"INTERVAL {hold}")).drop("island")


def success_ticks(log: DataFrame, *, window: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Success rate and the share of requests above ten seconds at each end of tumbling windows."""
    return log.groupBy(F.window("created_at", window).alias("w"), *by).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "completed").alias("ok"), F.count_if(F.col("latency_ms") > 10000).alias("slow")
    ).select(F.col("w.end").alias("at"), *by, "n", (F.col("ok") / F.col("n")).alias("success_rate"), (F.col("slow") / F.col("n")).alias("slow_share"))


def mean_duration(log: DataFrame, value: Column, *, ts: str = "created_at", window: str = "5 minutes", every: str = "1 minute", labels: tuple[str, ...] = ()) -> DataFrame:
    """The ratio of the rates of a histogram's sum and its count at each end of a sliding window."""
    w = log.withColumn("_value", value).groupBy(F.window(ts, window, every).alias("w"), *labels).agg(F.sum("_value").alias("total"), F.count("_value").alias("n"))
    return w.select(F.col("w.end").alias("at"), *labels, F.try_divide("total", "n").alias("mean"))


def health_samples(log: DataFrame, *, ts: str = "created_at", window: str = "5 minutes", every: str = "1 minute", bounds: tuple[float, ...] = API_BUCKETS) -> DataFrame:
    """(at, metric, value) of the metrics that a request log can feed: requests, success_rate, p95_seconds.

    There is a tick at each window's end from the first to the last, windows without
    requests too: requests is 0 there and the others are null.
    """
    w = log.select(F.window(ts, window, every).alias("w"), "status", (F.col("latency_ms") / 1000).alias("s")).select(F.col("w.end").alias("at"), "status", "s")
    counted = w.groupBy("at").agg(F.count("*").cast("double").alias("requests"), (F.count_if(F.col("status") == "completed") / F.count("*")).alias("success_rate"))
    tail = histogram_quantile(histogram(w, F.col("s"), bounds, "at"), 0.95, "at").withColumnRenamed("quantile", "p95_seconds")
    ends = counted.agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first IS NOT NULL")
    ticks = ends.select(F.explode(F.sequence("first", "last", F.expr(f"INTERVAL {every}"))).alias("at"))
    all_ticks = ticks.join(counted, "at", "left").join(tail, "at", "left").withColumn("requests", F.coalesce("requests", F.lit(0.0)))
    return all_ticks.unpivot("at", ["requests", "success_rate", "p95_seconds"], "metric", "value")


#: name, metric, how it is compared, limit, hold time, severity
ALERT_RULES = (
    ("low_success_rate", "success_rate", "<", 0.90, "5 minutes", "warning"),
    ("deep_queue", "queue_depth", ">", 500, "10 minutes", "warning"),
    ("high_memory", "memory_bytes", ">", 0.85 * 2 * 1024**3, "3 minutes", "critical"),
    ("pool_exhausted", "pool_active", ">=", 10, "1 minute", "critical"),
    ("slow_requests", "p95_seconds", ">", 10, "5 minutes", "warning"),
    ("no_requests", "requests", "=", 0, "5 minutes", "info"),
)


def alerts(samples: DataFrame, rules: tuple = ALERT_RULES) -> DataFrame:
    """(alert, severity, since, until, ticks) of all rules over (at, metric, value) samples."""
    out = None
    for name, metric, op, limit, hold, severity in rules:
        own = samples.where(F.col("metric") == metric).withColumn("firing", F.coalesce(F.expr(f"value {op} {limit!r}"), F.lit(False)))
        found = held(own, by=["metric"], ts="at", firing="firing", hold=hold).select(F.lit(name).alias("alert"), F.lit(severity).alias("severity"), "since", "until", "ticks")
        out = found if out is None else out.unionByName(found)
    return out


def exposition(metrics: DataFrame, name: str, label: str, value: str = "value") -> DataFrame:
    """Lines of the text format that metric scrapers read; a label's backslashes, quotes and line ends are escaped."""
    safe = F.col(label).cast("string")
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        safe = F.replace(safe, F.lit(raw), F.lit(escaped))
    return metrics.select(F.format_string(f'{name}{{{label}="%s"}} %s', safe, F.col(value).cast("string")).alias("line"))


def scraped(lines: DataFrame, label: str, line: str = "value") -> DataFrame:
    """(metric, label, value) of lines in that format; comments and lines of another form are left out."""
    form = r'^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})? +(\S+)(?: +-?[0-9]+)?$'
    part = lambda i: F.regexp_extract(line, form, i)
    raw = F.regexp_extract(part(2), f'(?:^|,) *{label}="((?:[^"\\\\]|\\\\.)*)"', 1)
    # escaped backslashes are set aside under a mark, so that they aren't read with what follows
    mark = F.lit("\x00")
    plain = F.replace(raw, F.lit("\\\\"), mark)
    plain = F.replace(F.replace(plain, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return lines.where(F.col(line).rlike(form)).select(part(1).alias("metric"), F.replace(plain, mark, F.lit("\\")).alias(label), part(3).try_cast("double").alias("value"))
