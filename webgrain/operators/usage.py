"""Usage, logs and accounts over the request log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .routing import round_half_up


def whole_percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, round_half_up(part * 100 / total)).otherwise(0).cast("long")


def whole_mean(x: str) -> Column:
    """The mean, rounded to a whole number; 0 without rows."""
    return F.coalesce(F.round(F.avg(x)).cast("int"), F.lit(0))


def hundredths_mean(x: str) -> Column:
    """The mean of numbers of two places, rounded half up to two places in whole numbers; 0 without any."""
    total, n = F.sum(F.round(F.col(x) * 100).cast("long")), F.count(x)
    return F.coalesce(F.floor(F.try_divide(2 * total + n, 2 * n)), F.lit(0)).cast("double") / 100


def log_filter(log: DataFrame, user_id, *, status: str | None = None, domain: str | None = None, tier: int | None = None, tier_from: int | None = None) -> DataFrame:
    """Rows of a user that fit all given conditions; domain is a part of the name, in
    any case, where ``%`` and ``_`` are wildcards."""
    tests = [F.col("user_id") == user_id]
    if status:
        tests.append(F.col("status") == status)
    if domain:
        tests.append(F.col("domain").ilike(f"%{domain}%"))
    if tier:
        tests.append(F.col("tier_used") == tier)
    if tier_from:
        tests.append(F.col("tier_used") >= tier_from)
    return log.where(reduce(lambda a, b: a & b, tests))


def log_page(log: DataFrame, *, page: int = 1, page_size: int = 25) -> DataFrame:
    """A page of the log, newest first, at most 100 rows."""
    n = min(page_size, 100)
    return log.orderBy(F.desc("created_at"), F.desc("id")).offset((page - 1) * n).limit(n)


def overview(log: DataFrame, now: str) -> DataFrame:
    """Requests, successes, mean latency and success per cent of the day."""
    today = log.where(F.to_date("created_at") == F.to_date(F.lit(now)))
    a = today.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("successful"), whole_mean("latency_ms").alias("avg_latency_ms"))
    return a.withColumn("success_rate", whole_percent(F.col("successful"), F.col("total")))


def month_cost(log: DataFrame, now: str) -> DataFrame:
    since = F.date_trunc("month", F.lit(now).cast("timestamp"))
    return log.where(F.col("created_at") >= since).agg(F.coalesce(F.sum("total_cost"), F.lit(0)).cast("double").alias("total_cost"))


def daily_requests(log: DataFrame, now: str, days: int = 30) -> DataFrame:
    since = F.date_sub(F.to_date(F.lit(now)), days)
    return log.where(F.to_date("created_at") >= since).groupBy(F.to_date("created_at").alias("date")).agg(F.count("*").alias("requests"))


def tier_breakdown(log: DataFrame, now: str, days: int = 30) -> DataFrame:
    since = F.date_sub(F.to_date(F.lit(now)), days)
    name = F.concat(F.lit("Tier "), F.coalesce(F.col("tier_used").cast("string"), F.lit("null")))
    return log.where(F.to_date("created_at") >= since).groupBy(name.alias("tier")).agg(F.count("*").alias("requests"))


def usage_by(log: DataFrame, *keys: Column | str) -> DataFrame:
    """The measures of a day's usage, for any grouping."""
    tier = F.col("tier_used")
    return log.groupBy(*keys).agg(
        F.count("*").alias("total_requests"), F.count_if(F.col("status") == "completed").alias("successful_requests"),
        F.count_if(F.col("status") == "failed").alias("failed_requests"), F.count_if("cached").alias("cached_requests"),
        F.count_if(tier == 1).alias("tier1_requests"), F.count_if(tier == 2).alias("tier2_requests"),
        F.count_if(tier == 3).alias("tier3_requests"), F.count_if(tier >= 4).alias("tier4_requests"),
        F.coalesce(F.sum("total_cost"), F.lit(0)).cast("double").alias("total_cost"), whole_mean("latency_ms").alias("avg_latency_ms"),
        hundredths_mean("quality_score").alias("avg_quality_score"),
    )


def usage_daily(log: DataFrame, *more: str) -> DataFrame:
    return usage_by(log, *more, F.to_date("created_at").alias("date"))


def range_totals(daily: DataFrame) -> DataFrame:
    """Totals of daily rows: the mean of daily means, and the mean over requests beside it."""
    a = daily.agg(
        F.coalesce(F.sum("total_requests"), F.lit(0)).alias("requests"), F.round(F.coalesce(F.sum("total_cost"), F.lit(0.0)), 6).alias("cost"),
        F.coalesce(round_half_up(F.avg("avg_latency_ms")), F.lit(0)).cast("long").alias("avg_latency_ms"),
        F.coalesce(round_half_up(F.sum(F.col("avg_latency_ms") * F.col("total_requests")) / F.sum("total_requests")), F.lit(0)).cast("long").alias("weighted_latency_ms"),
        F.sum("successful_requests").alias("ok"),
    )
    return a.withColumn("success_rate", whole_percent(F.coalesce("ok", F.lit(0)), F.col("requests"))).drop("ok")


def metered_usage(users: DataFrame, log: DataFrame, now: str, hours: int = 1) -> DataFrame:
    """Requests of each user in the last hours; users without any are left out."""
    recent = log.where((F.col("created_at") > F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))) & (F.col("created_at") <= F.lit(now).cast("timestamp")))
    counted = recent.groupBy("user_id").agg(F.count("*").alias("requests"))  # before the join: a row a user
    return users.join(counted, users["id"] == counted["user_id"]).select(users["id"].alias("user_id"), "requests")


def authenticate(requests: DataFrame, keys: DataFrame, users: DataFrame, header: str = "authorization") -> DataFrame:
    """requests with user_id, plan, and code: 200, or 401 for a key that isn't known or active."""
    from ..functions.urls import api_key_hash, bearer_key

    known = keys.where("is_active").join(users, keys["user_id"] == users["id"]).select(keys["key_hash"], keys["user_id"], keys["rate_limit_per_minute"], users["plan"])
    asked = requests.withColumn("own_hash", api_key_hash(bearer_key(F.col(header))))
    return asked.join(known, asked["own_hash"] == known["key_hash"], "left").drop("own_hash", "key_hash").withColumn("code", F.when(F.col("user_id").isNull(), 401).otherwise(200))


def rejected(requests: DataFrame, keys: DataFrame, header: str = "authorization") -> DataFrame:
    """Requests whose key isn't known or active."""
    from ..functions.urls import api_key_hash, bearer_key

    active = keys.where("is_active").select(F.col("key_hash").alias("own_hash"))
    return requests.withColumn("own_hash", api_key_hash(bearer_key(F.col(header)))).join(active, "own_hash", "left_anti").drop("own_hash")


def account_summary(users: DataFrame, keys: DataFrame, log: DataFrame) -> DataFrame:
    """Each user's active keys and requests, 0 where there are none."""
    k = keys.where("is_active").groupBy("user_id").agg(F.count("*").alias("active_keys"))
    r = log.groupBy("user_id").agg(F.count("*").alias("requests"))
    u = users.select(F.col("id").alias("user_id"), "plan")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return u.join(k, "user_id", "left").join(r, "user_id", "left").select("user_id", "plan", zero("active_keys"), zero("requests"))


def update_where(df: DataFrame, test: Column, **values: Column) -> DataFrame:
    """A copy in which the rows that fit have other values."""
    hit = F.coalesce(test, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Table and rows with one row a key: that of the highest version."""
    both = table.unionByName(rows, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("r")).select(*keys, "r.*")


def rotate_keys(keys: DataFrame, which: Column, now: str) -> DataFrame:
    """The keys, those chosen being revoked, and a new key for each of them."""
    hit = F.coalesce(which & F.col("is_active"), F.lit(False))
    fresh = keys.where(hit).select(
        *(F.col(c) for c in keys.columns if c not in ("id", "key_hash", "key_prefix", "name")),
        F.sha2(F.concat(F.lit("rotated:"), F.col("id").cast("string")), 256).alias("key_hash"), F.col("key_prefix"),
        F.concat("name", F.lit(" (rotated)")).alias("name"), (-F.col("id")).alias("id"), F.lit(None).cast("timestamp").alias("revoked_at"),
    )
    old = keys.withColumn("revoked_at", F.when(hit, F.lit(now).cast("timestamp"))).withColumn("is_active", F.col("is_active") & ~hit)
    return old.unionByName(fresh)


def issue_keys(asked: DataFrame, now: str, *, per_minute: int = 60) -> DataFrame:
    """The key rows of (user_id, name, secret) requests, with the ids that they got.

    The id is made of the secret's hash, so a request that is run again gives the same row.
    """
    from ..functions.urls import api_key_hash

    of_secret = api_key_hash(F.col("secret"))
    return asked.select(
        F.substring(of_secret, 1, 32).alias("id"), "user_id", of_secret.alias("key_hash"), F.substring("secret", 1, 12).alias("key_prefix"), "name",
        F.lit(True).alias("is_active"), F.lit(per_minute).alias("rate_limit_per_minute"), F.lit(now).cast("timestamp").alias("created_at"),
    )
