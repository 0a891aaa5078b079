"""Rate limits, caches, outcome classes and delivery, as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATE_WINDOW_MS = 60_000


def rate_limit(calls: DataFrame, *, key: str, ts: str, limit: Column | int) -> DataFrame:
    """calls with the count of the key's last minute, itself included, and the decision.

    Calls that are refused count too.
    """
    ms = F.unix_millis(ts)
    w = Window.partitionBy(key).orderBy(ms).rangeBetween(-(RATE_WINDOW_MS - 1), 0)
    most = limit if isinstance(limit, Column) else F.lit(limit)
    return calls.withColumn("calls", F.count("*").over(w)).withColumns(
        {
            "code": F.when(F.col("calls") > most, 429).otherwise(200), "remaining": F.greatest(F.lit(0), most - F.col("calls")).cast("long"),
            "reset": F.ceil((ms + RATE_WINDOW_MS) / 1000),
        }
    )


def cache_lookup(requests: DataFrame, cache: DataFrame, *, key: str = "key", at: str = "ts") -> DataFrame:
    """requests with the stored result if it hasn't expired, and whether there is one."""
    c = cache.select(F.col(key).alias("cache_key"), "result", "expires_at")
    hit = F.col("cache_key").isNotNull() & (F.col("expires_at") > F.col(at))
    joined = requests.join(c, F.col(key) == F.col("cache_key"), "left")
    return joined.select(*requests.columns, F.when(hit, F.col("result")).alias("result"), F.coalesce(hit, F.lit(False)).alias("cached"))


def poisoned(schema: Column, json: Column) -> Column:
    """Structured data was asked for, and there is none: no result to keep."""
    trimmed = F.regexp_replace(json, r"[ \t\n\r]", "")
    return schema.isNotNull() & (json.isNull() | trimmed.isin("", "null", "{}", "[]"))


def cache_rows(results: DataFrame, *, ts: str = "ts", ttl: str = "cache_ttl") -> DataFrame:
    """What is stored of results: (key, result, expires_at), the last of each key."""
    good = results.where((F.col(ttl) > 0) & ~poisoned(F.col("extract_schema"), F.col("json")))
    row = F.struct("result", (F.col(ts) + F.make_dt_interval(secs=F.col(ttl).cast("decimal(18,6)"))).alias("expires_at"))
    return good.groupBy("key").agg(F.max_by(row, F.col(ts)).alias("r")).select("key", "r.*")


def is_permanent_error(message: Column) -> Column:
    return F.coalesce(message.rlike(r"(?i)ERR_NAME_NOT_RESOLVED|ERR_INVALID_URL|ENOTFOUND|invalid url"), F.lit(False))


def webhook_outcome(status: Column, attempt: Column) -> Column:
    """delivered, stop, retry or gave up; no status means that no answer came."""
    stop = (status >= 400) & (status < 500) & (status != 429)
    return F.when(status.between(200, 299), "delivered").when(stop, "stop").when(attempt >= 3, "gave up").otherwise("retry")


def backoff_ms(attempt: Column) -> Column:
    return (F.lit(1000) * F.pow(F.lit(2), attempt - 1)).cast("long")


def model_outcome(status: Column, message: Column) -> Column:
    """What a failed model call leads to: a smaller prompt, the next model, or none."""
    return F.when(F.coalesce(F.contains(F.lower(message), F.lit("too large")), F.lit(False)), "retry smaller").when(status.isin(413, 429) | (status >= 500), "next").otherwise("stop")


# Kinds of resource and parts of addresses that a page can do without.
BLOCKED_TYPES = ("media", "font", "manifest", "prefetch")
BLOCKED_PARTS = (
    "google-analytics.com", "googletagmanager.com", "facebook.net", "doubleclick.net", "hotjar.com", "segment.com", "mixpanel.com",
    "amplitude.com", "adservice.google.com", "pagead2.googlesyndication.com", "cdn.jsdelivr.net/npm/cookieconsent", "ads.", "tracking.",
)


def resource_blocked(kind: Column, url: Column) -> Column:
    from ..functions.quality import has_any

    return kind.isin(*BLOCKED_TYPES) | has_any(url, BLOCKED_PARTS)


def queue_order(jobs: DataFrame) -> DataFrame:
    """Jobs in the order in which they are taken: by priority, then as they came."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in (("realtime", 1), ("standard", 2), ("batch", 3), ("background", 4)) for x in p)), F.col("queue")), F.lit(4))
    w = Window.partitionBy("worker").orderBy("priority", "created_at", "job_id")
    return jobs.withColumn("priority", rank).withColumn("place", F.row_number().over(w))


def latest_result(results: DataFrame, key: str = "job_id", ts: str = "ts", ttl: str = "1 hour", now: str | None = None) -> DataFrame:
    """The last result of each job that is younger than its time to live."""
    rest = [c for c in results.columns if c != key]
    out = results.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(ts)).alias("r")).select(key, "r.*")
    return out.where(F.col(ts) + F.expr(f"INTERVAL {ttl}") > F.lit(now).cast("timestamp")) if now else out


def sign(payload: str = "payload", secret: str = "secret") -> Column:
    """``sha256=`` and the hex HMAC of each payload, nulls giving null: two nested hashes
    over the key, filled up to a block of 64 bytes, with each byte's bits turned."""
    key = F.encode(F.col(secret), "UTF-8")
    block = F.rpad(F.hex(F.when(F.octet_length(key) > 64, F.unhex(F.sha2(key, 256))).otherwise(key)), 128, "0")
    digits = "0123456789ABCDEF"
    turned = {pad: "".join(f"{d ^ pad:X}" for d in range(16)) for pad in (3, 6, 5, 12)}

    def padded(high: int, low: int) -> Column:  # the first digit of a byte and its second one
        pairs = F.sequence(F.lit(1), F.lit(127), F.lit(2))
        cells = F.transform(pairs, lambda i: F.concat(F.translate(block.substr(i, F.lit(1)), digits, turned[high]), F.translate(block.substr(i + 1, F.lit(1)), digits, turned[low])))
        return F.unhex(F.array_join(cells, ""))

    inner = F.unhex(F.sha2(F.concat(padded(3, 6), F.encode(F.col(payload), "UTF-8")), 256))
    return F.when(key.isNotNull(), F.concat(F.lit("sha256="), F.sha2(F.concat(padded(5, 12), inner), 256)))
