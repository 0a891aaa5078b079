"""Readers, and the request log, attempts and accounts derived from the test tables.

The derived tables are synthetic: they give the engine's queries rows where no
captured log exists.  ``DERIVED_SQL`` states the same rows in portable SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import GOLD_FILE, LOAD_SUMMARY, SCRAPE_REQUEST

#: The time that relative filters count from.
NOW = "2024-01-30 23:59:59"
TIERS = (1, 2, 3, 4, 5)
# Money for a fetch by tier, and by kind of proxy.
COMPUTE_COST = {1: "0.000010", 2: "0.000020", 3: "0.000100", 4: "0.000500", 5: "0.000800"}
DEFAULT_COMPUTE_COST = "0.000500"
PROXY_COST = {"datacenter": "0.000050", "residential": "0.000300", "mobile": "0.000800"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def compute_cost(tier):
    """Money for a fetch at a tier; an unknown tier costs as the browser does."""
    out = F.lit(DEFAULT_COMPUTE_COST).cast("decimal(10,6)")
    for k, v in COMPUTE_COST.items():
        out = F.when(tier == k, F.lit(v).cast("decimal(10,6)")).otherwise(out)
    return out


def proxy_cost(kind):
    out = F.lit("0").cast("decimal(10,6)")
    for k, v in PROXY_COST.items():
        out = F.when(kind == k, F.lit(v).cast("decimal(10,6)")).otherwise(out)
    return out


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log row for each event."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    log = e.select(
        i.alias("id"), "user_id", F.col("ts").cast("timestamp").alias("created_at"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        (1 + i % 5).cast("int").alias("tier_used"), F.floor(F.col("value") * 100).cast("int").alias("latency_ms"),
        (((i * 37) % 101) / F.lit(100)).cast("decimal(3,2)").alias("quality_score"),
        F.concat(F.lit("site"), (F.col("user_id") % 20).cast("string"), F.lit(".example.com")).alias("domain"),
        F.element_at(F.array(*map(F.lit, ("none", *PROXY_COST))), (1 + i % 4).cast("int")).alias("proxy_tier"),
        (i % 7 == 0).alias("cached"), F.col("event_type"),
        F.when(F.col("event_type") == "error", F.element_at(F.array(*map(F.lit, ERRORS)), (1 + i % len(ERRORS)).cast("int"))).alias("error_message"),
    )
    return log.withColumn("total_cost", (compute_cost(F.col("tier_used")) + proxy_cost(F.col("proxy_tier"))).cast("decimal(10,6)"))


ERRORS = ("timeout: 60000 ms", "ERR_NAME_NOT_RESOLVED: no such host", "blocked: 403", "blocked: captcha", "network: reset")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five tries of each page, one a tier, without the page's html."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    t = p.withColumn("tier", F.explode(F.array(*map(F.lit, TIERS))))
    return with_outcome(t)


def with_outcome(tries: DataFrame) -> DataFrame:
    """status_code, latency_ms and created_at of (page_id, tier) rows."""
    i, k = F.col("page_id"), F.col("tier")
    return tries.select(
        "*",
        F.when((i + k) % 4 == 0, 403).when((i * 3 + k) % 11 == 0, 429).when((i + 2 * k) % 13 == 0, 500).otherwise(200).alias("status_code"),
        ((i * 37 + k * 911) % 20000).cast("int").alias("latency_ms"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(i * 5 + k).cast("int"))).alias("created_at"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"), F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("plan"))


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    secret = F.concat(F.lit("sf_live_"), k.cast("string"))
    return c.select(
        k.alias("id"), k.alias("user_id"), F.sha2(secret, 256).alias("key_hash"), F.substring(secret, 1, 12).alias("key_prefix"),
        F.concat(F.lit("key "), k.cast("string")).alias("name"), (k % 10 != 0).alias("is_active"), (F.lit(60) + k % 3 * 30).cast("int").alias("rate_limit_per_minute"),
    )


_errors = " ".join(f"WHEN {n} THEN '{e}'" for n, e in enumerate(ERRORS))
_compute = " ".join(f"WHEN {k} THEN {v}" for k, v in COMPUTE_COST.items())
_proxy = " ".join(f"WHEN '{k}' THEN {v}" for k, v in PROXY_COST.items())
#: The derived tables as common table expressions.
DERIVED_SQL = {
    "request_log": f"""request_log AS (
  SELECT id, user_id, created_at, status, tier_used, latency_ms, quality_score, domain, proxy_tier, cached, event_type, error_message,
         CAST(CASE tier_used {_compute} ELSE {DEFAULT_COMPUTE_COST} END + CASE proxy_tier {_proxy} ELSE 0 END AS DECIMAL(10,6)) AS total_cost
  FROM (
    SELECT event_id AS id, user_id, ts AS created_at, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
           CAST(1 + event_id % 5 AS INT) AS tier_used, CAST(floor(value * 100) AS INT) AS latency_ms,
           CAST(((event_id * 37) % 101) / 100.0 AS DECIMAL(3,2)) AS quality_score, concat('site', CAST(user_id % 20 AS VARCHAR), '.example.com') AS domain,
           CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'datacenter' WHEN 2 THEN 'residential' ELSE 'mobile' END AS proxy_tier,
           event_id % 7 = 0 AS cached, event_type, CASE WHEN event_type = 'error' THEN CASE event_id % {len(ERRORS)} {_errors} END END AS error_message
    FROM events))""",
    "attempts": """attempts AS (
  SELECT page_id, url, CAST(tier AS INT) AS tier,
         CASE WHEN (page_id + tier) % 4 = 0 THEN 403 WHEN (page_id * 3 + tier) % 11 = 0 THEN 429 WHEN (page_id + 2 * tier) % 13 = 0 THEN 500 ELSE 200 END AS status_code,
         CAST((page_id * 37 + tier * 911) % 20000 AS INT) AS latency_ms, TIMESTAMP '2024-01-01' + to_minutes(CAST(page_id * 5 + tier AS INT)) AS created_at
  FROM pages, (SELECT unnest([1, 2, 3, 4, 5]) AS tier))""",
    "users": """users AS (
  SELECT c_custkey AS id, concat(lower(c_name), '@example.com') AS email, c_name AS name, lower(c_mktsegment) AS plan FROM customer)""",
    "api_keys": """api_keys AS (
  SELECT c_custkey AS id, c_custkey AS user_id, sha256('sf_live_' || c_custkey) AS key_hash, substr('sf_live_' || c_custkey, 1, 12) AS key_prefix,
         'key ' || c_custkey AS name, c_custkey % 10 <> 0 AS is_active, CAST(60 + c_custkey % 3 * 30 AS INT) AS rate_limit_per_minute FROM customer)""",
}


def sql_with(*names: str, more: str = "") -> str:
    """The WITH clause that has the named derived tables."""
    return "WITH " + ",\n".join([DERIVED_SQL[n] for n in names] + ([more] if more else [])) + "\n"


def gold_items(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """(url, title, price, availability, rating) of gold files: one object a file, or one a line."""
    return spark.read.schema(GOLD_FILE).json(path, multiLine=not lines).select(F.explode("items").alias("i")).select("i.url", "i.expected.*")


def load_summary(spark: SparkSession, path: str) -> DataFrame:
    """(metric, measure, value) of a load-test summary."""
    metrics = spark.read.schema(LOAD_SUMMARY).json(path, multiLine=True).select(F.explode("metrics").alias("metric", "m"))
    return metrics.select("metric", F.explode("m.values").alias("measure", "value"))


def requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Request bodies as JSON text, parsed; text that isn't JSON gives null fields."""
    return bodies.withColumn("request", F.from_json(body, SCRAPE_REQUEST))


def read_any(spark: SparkSession, path: str, kind: str, schema=None, **options) -> DataFrame:
    """CSV, JSON, ORC, Parquet or text files; without a schema the files' own, or a guess."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)
