"""Routing of fetches by tier, and the state that earlier fetches leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import in_domains

# Hosts whose pages need scripts, and hosts that only a full browser gets.
JS_HEAVY = (
    "msn.com", "bing.com", "amazon.com", "reuters.com", "medium.com", "instagram.com", "linkedin.com", "facebook.com", "tiktok.com",
    "twitter.com", "x.com",
)
HARD = ("nowsecure.nl", "walmart.com", "google.com")
TRUST_RATE, TRUST_SAMPLES = 0.5, 3
STATE_GAP = "24 hours"
PROXY_GAP = "168 hours"


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def next_tier(tier: Column, ok: Column) -> Column:
    """The tier that the state keeps: the fetch's own or the next, four at most."""
    return F.when(ok, F.least(tier, F.lit(4))).otherwise(F.least(tier + 1, F.lit(4)))


def route_decision(host: Column, *, browser: Column, tier: Column, success_rate: Column, samples: Column) -> Column:
    """The first path that holds: browser, hard, cached, js-heavy, escalate."""
    trusted = F.coalesce((success_rate >= TRUST_RATE) & (samples >= TRUST_SAMPLES), F.lit(False))
    return (
        F.when(browser, "browser").when(in_domains(host, HARD), "browser")
        .when(trusted & (tier >= 3), "browser").when(trusted, F.concat(F.lit("cached-"), tier.cast("string")))
        .when(tier.isNull() & in_domains(host, JS_HEAVY), "escalate-from-3").otherwise("escalate")
    )


def first_accepted(attempts: DataFrame, key: str = "page_id", tier: str = "tier", ok: str = "ok") -> DataFrame:
    """Each key's accepted attempt of the lowest tier."""
    row = F.struct(*(F.col(c) for c in attempts.columns if c != key))
    return attempts.where(F.col(ok)).groupBy(key).agg(F.min_by(row, F.col(tier)).alias("r")).select(key, "r.*")


def escalation(attempts: DataFrame, *, key: str = "page_id", tier: str = "tier", ok: str = "ok") -> DataFrame:
    """(key, tier, accepted): the first accepted tier, else the last resort.

    The last tier's page is taken whatever its score; without it the browser tier's
    page is, and without that the fetch fails.
    """
    a = attempts.groupBy(key).agg(F.min(F.when(F.col(ok), F.col(tier))).alias("first"), F.max(F.when(F.col(tier) >= 4, F.col(tier))).alias("last"))
    return a.select(key, F.coalesce("first", "last").alias("tier"), F.col("first").isNotNull().alias("accepted"))


def sessions(df: DataFrame, keys: list[str], ts: str, gap: str) -> DataFrame:
    """df with ``session``: 1 and up within a key, a new one after a pause of the gap."""
    w = Window.partitionBy(*keys).orderBy(ts, *[c for c in ("seq",) if c in df.columns])
    late = F.col(ts) >= F.lag(ts).over(w) + F.expr(f"INTERVAL {gap}")
    return df.withColumn("session", F.sum(F.when(F.lag(ts).over(w).isNull() | late, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def running_latency(latencies: Column) -> Column:
    """The mean that is rounded at each step, so its order matters: a fold."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"))
    step = lambda a, x: F.struct(
        (a["n"] + 1).alias("n"), round_half_up((a["mean"] * a["n"] + x) / (a["n"] + 1)).cast("double").alias("mean")
    )
    return F.aggregate(latencies, start, step)["mean"]


def last_session(log: DataFrame, by: list[str], *, ts: str, seq: str, latency: str, gap: str) -> DataFrame:
    """The rows of each key's last session, with ``_step`` where they can move its mean.

    The rounded mean of n latencies that span r stays where it is once n + 1 is more than
    twice r + 1: the next latency moves it by less than a half.  So a session's fold needs
    its first 2 (r + 1) steps and no later one, however long the session is; ``_step`` is
    null for those.  A latency that is null makes the mean null.
    """
    s = sessions(log.withColumn("seq", F.col(seq)), by, ts, gap)
    x = F.col(latency).cast("double")
    of_each = s.groupBy(*by, "session").agg((F.max(x) - F.min(x)).alias("range"), F.count_if(x.isNull()).alias("blank"))
    last = of_each.groupBy(*by).agg(F.max_by(F.struct("session", "range", "blank"), F.col("session")).alias("l")).select(*by, F.col("l.session").alias("session"), F.col("l.range").alias("_range"), F.col("l.blank").alias("_blank"))
    n = F.row_number().over(Window.partitionBy(*by).orderBy(ts, "seq"))
    rows = s.join(last, [*by, "session"]).withColumn("_n", n)
    counts = (F.col("_blank") == 0) & (F.col("_n") <= 2 * (F.col("_range") + 1))
    return rows.withColumn("_step", F.when(counts, F.struct(F.col("_n"), x.alias("latency"))))


def mean_of_steps() -> Column:
    """The stepwise rounded mean of a group of ``last_session``'s rows; null if a latency is."""
    return F.when(F.max("_blank") == 0, running_latency(F.sort_array(F.collect_list("_step"))["latency"]))


def domain_strategy(log: DataFrame, *, host: str = "domain", ts: str = "created_at", tier: str = "tier_used", latency: str = "latency_ms", ok: str = "ok", seq: str = "seq") -> DataFrame:
    """The state of each host after its last session of fetches."""
    rows = last_session(log, [host], ts=ts, seq=seq, latency=latency, gap=STATE_GAP).groupBy(host).agg(
        F.count("*").alias("sample_size"), F.count_if(ok).alias("successes"), mean_of_steps().cast("int").alias("avg_latency_ms"),
        F.max_by(F.struct(tier, ok), F.struct(ts, "seq")).alias("last"), F.max(ts).alias("last_updated"),
    )
    return rows.select(
        host, next_tier(F.col(f"last.{tier}"), F.col(f"last.{ok}")).alias("tier"), "sample_size", (F.col("successes") / F.col("sample_size")).alias("success_rate"), "avg_latency_ms", "last_updated"
    )


def strategy_before(log: DataFrame, *, host: str = "domain", ts: str = "created_at", seq: str = "seq", tier: str = "tier_used", ok: str = "ok") -> DataFrame:
    """log with the host's state just before each fetch: samples, rate and tier of
    the same session; null at a session's start."""
    s = sessions(log.withColumn("seq", F.col(seq)), [host], ts, STATE_GAP)
    w = Window.partitionBy(host, "session").orderBy(ts, "seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumns(
        {
            "prior_samples": F.nullif(F.count("*").over(before), F.lit(0)), "prior_rate": F.avg(F.col(ok).cast("int")).over(before),
            "prior_tier": next_tier(F.lag(tier).over(w), F.lag(ok).over(w)),
        }
    )


def proxy_base_score(successes: Column, failures: Column, latency: Column, hours: Column) -> Column:
    """Half success rate, three tenths speed, two tenths freshness; 0.5 if unused."""
    n = successes + failures
    value = F.try_divide(successes, n) * 0.5 + F.lit(0.3) / (F.lit(1) + latency / 5000) + F.lit(0.2) * F.greatest(F.lit(0.0), F.lit(1) - hours / 168)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.5).otherwise(value)


def proxy_domain_score(base: Column, successes: Column, failures: Column) -> Column:
    """The host's own rate counts six tenths once there are three samples."""
    n = successes + failures
    return F.when(n >= 3, F.try_divide(successes, n) * 0.6 + base * 0.4).otherwise(base)


def should_demote(successes: Column, failures: Column) -> Column:
    n = successes + failures
    return (n >= 5) & (F.try_divide(successes, n) < 0.7)


def should_promote(successes: Column, failures: Column) -> Column:
    n = successes + failures
    return (n >= 10) & (F.try_divide(successes, n) > 0.95)


def proxy_stats(log: DataFrame, *, now: str, by: list[str], ts: str = "created_at", ok: str = "ok", latency: str = "latency_ms", seq: str = "seq") -> DataFrame:
    """Counts, stepwise rounded latency and hours since the last use, of the last session."""
    return last_session(log, by, ts=ts, seq=seq, latency=latency, gap=PROXY_GAP).groupBy(*by).agg(
        F.count_if(ok).alias("successes"), F.count_if(~F.col(ok)).alias("failures"), mean_of_steps().alias("avg_latency"),
        ((F.unix_timestamp(F.lit(now)) - F.unix_timestamp(F.max(ts))) / 3600).alias("hours"),
    )


def proxy_tier_before(log: DataFrame, *, host: str = "domain", ts: str = "created_at", seq: str = "seq", kind: str = "proxy_tier", ok: str = "ok", default: str = "datacenter") -> DataFrame:
    """log with ``prior_kind``: the kind of proxy of the host's last success before each
    fetch, if that is less than a day old, else the default."""
    before = Window.partitionBy(host).orderBy(ts, seq).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(ok), F.struct(F.col(ts).alias("at"), F.col(kind).alias("kind"))), ignorenulls=True).over(before)
    fresh = F.col("_last.at") + F.expr(f"INTERVAL {STATE_GAP}") > F.col(ts)
    return log.withColumn("_last", last).withColumn("prior_kind", F.when(fresh, F.col("_last.kind")).otherwise(default)).drop("_last")


def pick_proxy(ranked: DataFrame, *, by: str, provider: str, score: str) -> DataFrame:
    """One provider of each key: the best of at most two, else one of the best three,
    chosen by the key's hash."""
    w = Window.partitionBy(by).orderBy(F.desc(score), provider)
    top = ranked.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    n = top.groupBy(by).agg(F.count("*").alias("n"))
    chosen = F.when(F.col("n") <= 2, 1).otherwise(F.conv(F.substring(F.md5(F.col(by).cast("string")), 1, 4), 16, 10).cast("int") % 3 + 1)
    return top.join(n, by).where(F.col("rank") == chosen).select(by, provider, score, "rank")


def proxy_sessions(log: DataFrame, provider: str, order: list[str], parts: int | None = None) -> DataFrame:
    """log with ``session``: a round-robin counter of each provider, in base 36.

    The log is dealt to ranges of the order, each is numbered by itself, and the counts
    of the ranges before are added, so a provider's rows needn't meet in one task.  The
    order must be a whole one.
    """
    spark = log.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = order[0]
    bounds = log.agg(F.percentile_approx(F.unix_micros(first), [k / parts for k in range(1, parts)], 10_000).alias("b")).first()["b"] if parts > 1 else None
    part = F.lit(0)
    for b in sorted(set(bounds or [])):
        part = part + (F.unix_micros(first) > b).cast("int")
    dealt = log.withColumn("_part", part)
    counts = dealt.groupBy(provider, "_part").agg(F.count("*").alias("_n"))  # a row a provider and range
    before = Window.partitionBy(provider).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(provider, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(provider, "_part").orderBy(*order)))
    n = (F.col("_before") + F.col("_own")).cast("string")
    return numbered.join(offsets, [provider, "_part"]).withColumn("session", F.lower(F.conv(n, 10, 36))).drop("_part", "_own", "_before")


PROXY_ORDER = ("none", "datacenter", "residential", "mobile")


def next_proxy_tier(current: Column, available: Column) -> Column:
    """The next kind of proxy, in order, that there is."""
    place = lambda c: F.array_position(F.array(*map(F.lit, PROXY_ORDER)), c)
    later = F.filter(F.array(*map(F.lit, PROXY_ORDER)), lambda p: F.array_contains(available, p) & (place(p) > place(current)))
    return F.get(later, F.lit(0))
