"""Schemas of the data model, as DDL: requests, results, state and the log store."""

from __future__ import annotations

SCRAPE_REQUEST = (
    "url STRING, formats ARRAY<STRING>, waitFor STRING, timeout INT, proxy STRING, headers MAP<STRING,STRING>, "
    "cookies ARRAY<STRUCT<name: STRING, value: STRING, domain: STRING, path: STRING>>, screenshot BOOLEAN, mobile BOOLEAN, "
    "blockResources BOOLEAN, cacheTtl INT, webhookUrl STRING, extractSchema STRING, schema STRING"
)
REQUEST_LOG = (
    "id STRING, user_id STRING, api_key_id STRING, job_id STRING, url STRING, domain STRING, method STRING, tier_used SMALLINT, "
    "proxy_tier STRING, status STRING, status_code INT, latency_ms INT, cost_breakdown STRING, total_cost DECIMAL(10,6), "
    "quality_score DECIMAL(3,2), cached BOOLEAN, error_message STRING, created_at TIMESTAMP, completed_at TIMESTAMP"
)
USAGE_DAILY = (
    "user_id STRING, date DATE, total_requests INT, successful_requests INT, failed_requests INT, cached_requests INT, "
    "tier1_requests INT, tier2_requests INT, tier3_requests INT, tier4_requests INT, total_cost DECIMAL(10,4), "
    "avg_latency_ms INT, avg_quality_score DECIMAL(3,2)"
)
API_KEYS = (
    "id STRING, user_id STRING, key_hash STRING, key_prefix STRING, name STRING, is_active BOOLEAN, rate_limit_per_minute INT, "
    "created_at TIMESTAMP, last_used_at TIMESTAMP, expires_at TIMESTAMP, revoked_at TIMESTAMP"
)
USERS = ("id STRING, email STRING, name STRING, plan STRING, created_at TIMESTAMP, updated_at TIMESTAMP")
DOMAIN_STRATEGY = ("domain STRING, tier INT, proxyTier STRING, successRate DOUBLE, avgLatencyMs INT, sampleSize INT, lastUpdated TIMESTAMP")
PROXY_STATS = ("provider STRING, successes LONG, failures LONG, avgLatency DOUBLE, lastUsed TIMESTAMP")
STORED_SCRIPT = ("host STRING, schema_key STRING, spec STRING, requiredKeys ARRAY<STRING>, execCount INT, avgQuality DOUBLE, updated_at TIMESTAMP")
PROGRESS_EVENT = ("job_id STRING, event STRING, data STRING, ts TIMESTAMP")
GOLD_FILE = (
    "_comment STRING, _verifiedOn STRING, _count INT, items ARRAY<STRUCT<url: STRING, expected: STRUCT<title: STRING, price: DOUBLE, availability: STRING, rating: INT>>>"
)
LOAD_SUMMARY = (
    "summary STRUCT<vus: INT, duration: STRING, total_requests: BIGINT, throughput_rps: DOUBLE, http_req_duration_ms: MAP<STRING, DOUBLE>, "
    "http_req_failed_rate: DOUBLE, check_pass_rate: DOUBLE>, metrics MAP<STRING, STRUCT<type: STRING, contains: STRING, values: MAP<STRING, DOUBLE>>>"
)
