"""Percentiles, success tables, gold comparisons and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .usage import whole_percent


def nearest_rank(values: Column, p: float) -> Column:
    """Of a sorted array the element at floor(p/100 * n), the last at most."""
    n = F.size(values)
    return F.get(values, F.least(n - 1, F.floor(F.lit(p) / 100 * n).cast("int")))


def percentiles(df: DataFrame, by: list[str], value: str, ps: tuple[int, ...] = (50, 95, 99), *, times: str | None = None) -> DataFrame:
    """Nearest-rank percentiles of each group without gathering a group in one task.

    Values are counted first (``times`` says how often a row counts), so a group's rows are its different values; a running
    count then finds where each rank falls.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(times) if times else F.count("*")).alias("_times"))
    w = Window.partitionBy(*by).orderBy(value)
    ranked = counted.withColumns({"_upto": F.sum("_times").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_times").over(Window.partitionBy(*by))})
    at = lambda p: F.least(F.col("_all") - 1, F.floor(F.lit(p) / 100 * F.col("_all")))
    return ranked.groupBy(*by).agg(F.first("_all").alias("n"), *(F.min(F.when(F.col("_upto") > at(p), F.col(value))).alias(f"p{p}") for p in ps))


def against_targets(measured: DataFrame, targets: DataFrame, key: str, ps: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Measured percentiles beside their targets; groups without a target are left out."""
    joined = measured.join(targets, key)
    return joined.select(key, *(c for p in ps for c in (f"p{p}", f"target_p{p}")), *(F.when(F.col(f"p{p}") <= F.col(f"target_p{p}"), "PASS").otherwise("MISS").alias(f"verdict_p{p}") for p in ps))


def success_matrix(runs: DataFrame, by: str, *, ok: str = "ok", ms: str = "latency_ms", tier: str = "tier", quality: str = "quality") -> DataFrame:
    return runs.groupBy(by).agg(
        F.count("*").alias("runs"), F.count_if(ok).alias("passed"), F.floor(F.avg(ms) + 0.5).cast("long").alias("avg_ms"),
        F.round(F.avg(tier), 1).alias("avg_tier"), F.round(F.avg(quality), 2).alias("avg_quality"),
    ).withColumn("success_pct", whole_percent(F.col("passed"), F.col("runs")))


def top_reasons(runs: DataFrame, by: str, reason: str = "error_message", most: int = 3) -> DataFrame:
    """The most frequent reasons of each group, by the text before the colon."""
    counted = runs.where(F.col(reason).isNotNull()).groupBy(by, F.substring_index(reason, ":", 1).alias("reason")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), "reason")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def bench_summary(runs: DataFrame, *, ok: str = "ok", ms: str = "latency_ms", sets: tuple[str, ...] = ("tier", "status")) -> DataFrame:
    """Runs, pass per cent, mean and maximum overall, by the first and by the second
    column, with the nearest-rank median and 95th percentile of the runs that passed."""
    a, b = sets
    grouped = runs.groupingSets([[], [a], [b]], a, b).agg(
        F.count("*").alias("runs"), F.count_if(ok).alias("passed"), F.round(F.avg(ms), 4).alias("mean_ms"), F.max(ms).alias("max_ms"),
        F.grouping_id().alias("g"),
    )
    name = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, F.concat(F.lit(f"{a}="), F.col(a).cast("string"))).otherwise(F.concat(F.lit(f"{b}="), F.col(b).cast("string")))
    text = lambda c: F.concat(F.lit(f"{c}="), F.col(c).cast("string"))
    slices = runs.where(ok).groupBy(a, b, ms).agg(F.count("*").alias("_runs")).select(F.explode(F.array(F.lit("all"), text(a), text(b))).alias("slice"), ms, "_runs")
    ranks = percentiles(slices, ["slice"], ms, (50, 95), times="_runs").select("slice", F.col("p50").alias("median_ms"), F.col("p95").alias("p95_ms"))
    out = grouped.select(name.alias("slice"), "runs", "passed", whole_percent(F.col("passed"), F.col("runs")).alias("pass_pct"), "mean_ms", "max_ms")
    return out.join(ranks, "slice", "left")


def competitors(runs: DataFrame, by: str, price: str, *, ok: str = "ok", ms: str = "latency_ms") -> DataFrame:
    """Median and 95th percentile of successes, and money for one success."""
    a = runs.groupBy(by).agg(F.count("*").alias("attempted"), F.count_if(ok).alias("succeeded"), F.max(price).cast("double").alias("unit"))
    p = percentiles(runs.where(ok), [by], ms, (50, 95)).select(by, F.col("p50").alias("median_ms"), F.col("p95").alias("p95_ms"))
    return a.join(p, by, "left").select(by, "attempted", "succeeded", "median_ms", "p95_ms", F.round(F.try_divide(F.col("unit") * F.col("attempted"), F.col("succeeded")), 8).alias("cost_per_success"))


def load_summary(runs: DataFrame, *, ms: str = "latency_ms", ok: str = "ok", seconds: float = 60.0) -> DataFrame:
    """Interpolated percentiles, rate and failures of a whole run."""
    # a row a value, so that what meets in the last task doesn't grow with the log
    counted = runs.groupBy(ms).agg(F.count("*").alias("_n"), F.count_if(~F.col(ok)).alias("_failed"))
    pick = F.percentile(ms, F.array(*map(F.lit, (0.5, 0.9, 0.95, 0.99))), F.col("_n"))
    known = F.sum(F.when(F.col(ms).isNotNull(), F.col("_n")))
    a = counted.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("requests"), (F.sum(F.col(ms) * F.col("_n")) / known).alias("avg"), pick.alias("p"), F.max(ms).alias("max_ms"),
        F.coalesce(F.sum("_failed"), F.lit(0)).alias("failed"),
    )
    return a.select(
        "requests", F.round(F.col("requests") / seconds, 4).alias("per_second"), F.round("avg", 4).alias("avg_ms"),
        *(F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p50_ms", "p90_ms", "p95_ms", "p99_ms"))), "max_ms",
        F.round(F.try_divide("failed", "requests"), 6).alias("failed_rate"),
    )


def gold_compare(gold: DataFrame, got: DataFrame, key: str = "url") -> DataFrame:
    """Per record and field: true, false, or null where nothing was extracted."""
    g, x = gold.alias("g"), got.alias("x")
    c = lambda f: (F.col(f"g.{f}"), F.col(f"x.{f}"))
    (gt, xt), (gp, xp), (ga, xa), (gr, xr) = c("title"), c("price"), c("availability"), c("rating")
    return g.join(x, F.col(f"g.{key}") == F.col(f"x.{key}"), "left").select(
        F.col(f"g.{key}").alias(key), F.col(f"x.{key}").isNull().alias("skipped"), (F.trim(gt) == F.trim(xt)).alias("title"),
        (F.abs(gp - xp) < 0.02).alias("price"), F.contains(F.lower(xa), F.lower(ga)).alias("availability"), (gr == xr).alias("rating"),
    )


def field_accuracy(compared: DataFrame, fields: tuple[str, ...] = ("title", "price", "availability", "rating")) -> DataFrame:
    """Per field the per cent of records that weren't skipped and agree."""
    rows = compared.where("NOT skipped").select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(f, F.lit(False)).alias("ok")) for f in fields))).alias("r")).select("r.*")
    return rows.groupBy("field").agg(whole_percent(F.count_if("ok"), F.count("*")).alias("accuracy"))


def calibration(scores: DataFrame, score: str, good: Column) -> DataFrame:
    """How often good pages score at least 0.7 and bad ones less than 0.4."""
    right = F.when(good, F.col(score) >= 0.7).otherwise(F.col(score) < 0.4)
    a = scores.agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"), F.count_if(good & right).alias("good_right"), F.count_if(~good & right).alias("bad_right"))
    return a.withColumn("overall_pct", whole_percent(F.col("good_right") + F.col("bad_right"), F.col("good") + F.col("bad")))


def paired_runs(runs: DataFrame, key: str, mode: str, a: str, b: str, value: str) -> DataFrame:
    """Two kinds of run side by side, with the per cent that the first saves."""
    p = runs.groupBy(key).agg(F.sum(F.when(F.col(mode) == a, F.col(value))).alias(a), F.sum(F.when(F.col(mode) == b, F.col(value))).alias(b))
    return p.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("saved_pct", F.floor((1 - F.try_divide(F.col(a), F.col(b))) * 100 + 0.5).cast("long"))


def stable_tiers(runs: DataFrame, by: str, order: list[str], tier: str) -> DataFrame:
    """Whether all later runs have the first one's tier, or -1."""
    w = Window.partitionBy(by).orderBy(*order)
    return runs.withColumn("first", F.first(tier).over(w)).groupBy(by).agg(
        F.bool_and((F.col(tier) == F.col("first")) | (F.col(tier) == -1)).alias("stable"), F.count("*").alias("runs")
    )


def gaps(events: DataFrame, by: list[str], ts: str, least: str) -> DataFrame:
    """Calls, and how many came sooner after the one before than they should."""
    w = Window.partitionBy(*by).orderBy(ts)
    soon = F.col(ts) < F.lag(ts).over(w) + F.expr(f"INTERVAL {least}")
    return events.withColumn("soon", F.coalesce(soon, F.lit(False))).groupBy(*by).agg(F.count("*").alias("calls"), F.count_if("soon").alias("too_soon"))


# What a fingerprint page says of a browser that was or wasn't noticed.
RED_FLAGS = (
    "headless: true", "headless: yes", "webdriver: true", '"webdriver":true', "webdriver present", "automation: detected", "bot detected",
    "puppeteer", "missing image", "navigator.webdriver", "chrome: failed",
)
GOOD_SIGNALS = ("webdriver: false", "headless: false", '"webdriver":false', "no bot signals", "chrome: passed")


def flags(text: Column) -> Column:
    from ..functions.quality import phrases_in

    low = F.lower(text)
    return F.struct(phrases_in(low, RED_FLAGS).alias("red"), phrases_in(low, GOOD_SIGNALS).alias("good"))
