"""Queries over captured pages: scores, blocks, routes, addresses, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import text as X
from ..functions import urls as U
from ..operators import evaluate, requests, routing
from ..sources.tables import attempts, sql_with, table, with_outcome

_SP = r"[ \t\n\r\f\x0B]"


def _facts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", U.host(F.col("url")).alias("host"), *Q.PageFacts.of(F.col("html")).named())


def page_quality(spark, sf_dir):
    stored, status, latency = Q.PageFacts.stored(), F.lit(200), F.lit(0)
    return _facts(spark, sf_dir).select(
        "page_id", "host", "html_length", "text_length", "tag_count", "indicators", Q.quality_score(stored, status, latency).alias("score"),
        F.array_join(Q.quality_signals(stored, status, latency), "; ").alias("signals"),
    )


def page_quality_by_host(spark, sf_dir):
    return page_quality(spark, sf_dir).groupBy("host").agg(
        F.count("*").alias("pages"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.count_if(F.col("score") >= Q.ACCEPT) / F.count("*"), 6).alias("accepted_share")
    )


_seen = "html"
for _tag in Q.UNSEEN:
    _seen = f"regexp_replace({_seen}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', ' ', 'g')"


def _sql_any(text: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
# The patterns for unseen elements are taken one tag at a time: this dialect has no back-references.
FACTS_SQL = f"""facts AS (
  SELECT page_id, url, {_HOST} AS host, CAST(length(html) AS INT) AS html_length,
         CAST(length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_seen},
           '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '(?i)&nbsp;|&#160;', ' ', 'g'), '{_SP}+', ' ', 'g'))) AS INT) AS text_length,
         CAST(len(regexp_extract_all(html, '(?i)<(?:p|h[1-6]|li|td|article|section|div)(?:>|{_SP})')) AS INT) AS tag_count,
         CAST({" + ".join(f"CAST(contains(lower(html), '{p}') AS INT)" for p in Q.BOT_INDICATORS)} AS INT) AS indicators
  FROM pages)"""


def _score_sql(status: str, latency: str) -> str:
    return f"""greatest(0, least(100, 100 - CASE WHEN {status} <> 200 THEN 30 ELSE 0 END - CASE WHEN html_length < 1000 THEN 20 ELSE 0 END
      - CASE WHEN html_length >= 1000 AND text_length < 500 THEN 50 WHEN html_length >= 1000 AND text_length < 1500 THEN 15 ELSE 0 END
      - CASE WHEN html_length > 5000 AND text_length * 100 < html_length * 3 THEN 20 ELSE 0 END
      - CASE WHEN text_length < 5000 THEN 30 * indicators ELSE 0 END - CASE WHEN tag_count < 3 THEN 10 ELSE 0 END
      - CASE WHEN {latency} > 15000 THEN 10 ELSE 0 END)) / 100.0"""


_SIGNALS = """concat_ws('; ', CASE WHEN html_length < 1000 THEN 'short html' END,
      CASE WHEN html_length >= 1000 AND text_length < 500 THEN 'very little text: ' || text_length END,
      CASE WHEN html_length >= 1000 AND text_length >= 500 AND text_length < 1500 THEN 'little text: ' || text_length END,
      CASE WHEN html_length > 5000 AND text_length * 100 < html_length * 3 THEN 'text share ' || printf('%.1f', text_length * 100.0 / html_length) || '%' END,
      CASE WHEN text_length < 5000 AND indicators > 0 THEN 'bot indicators: ' || indicators END, CASE WHEN tag_count < 3 THEN 'few content tags' END,
      CASE WHEN score >= 0.8 THEN 'good content' END)"""
_QUALITY = f"scored AS (SELECT *, CAST({_score_sql('200', '0')} AS DOUBLE) AS score FROM facts)"


def _blocks(spark, sf_dir):
    """Attempts with the reason for which they are block pages; html is judged once a page."""
    p = table(spark, sf_dir, "pages")
    html = p.select("page_id", Q.block_reason(F.col("html"), F.lit(200), F.col("url")).alias("page_reason"), *Q.PageFacts.of(F.col("html")).named())
    s = F.col("status_code")
    bad = F.when(s.isin(403, 429, 503) | (s >= 500), "status")
    tries = with_outcome(html.withColumn("tier", F.explode(F.array(*map(F.lit, (1, 2, 3, 4, 5))))))
    score = Q.quality_score(Q.PageFacts.stored(), s, F.col("latency_ms"))
    return tries.select("page_id", "tier", "status_code", "latency_ms", F.coalesce(bad, "page_reason").alias("reason"), score.alias("score"))


def block_detection(spark, sf_dir):
    return _blocks(spark, sf_dir).select("page_id", "tier", "status_code", F.coalesce("reason", F.lit("content")).alias("reason"), F.col("reason").isNull().alias("valid"))


def _accepted(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    threshold = F.when(F.col("tier") == 5, 0.0).otherwise(Q.ACCEPT)
    reason = F.when(F.col("reason").isNotNull(), "invalid content").when(F.col("score") < threshold, "low score").otherwise("ok")
    return b.select("page_id", "tier", "score", (reason == "ok").alias("ok"), reason.alias("verdict"), "latency_ms")


def tier_acceptance(spark, sf_dir):
    return _accepted(spark, sf_dir)


def first_ok_tier(spark, sf_dir):
    return routing.first_accepted(_accepted(spark, sf_dir))


def escalation(spark, sf_dir):
    return routing.escalation(_accepted(spark, sf_dir))


_BLOCKS = f"""blocks AS (
  SELECT a.page_id, a.tier, a.status_code, a.latency_ms, f.html_length, f.text_length, f.tag_count, f.indicators,
         CASE WHEN a.status_code IN (403, 429, 503) OR a.status_code >= 500 THEN 'status' WHEN f.html_length = 0 THEN 'empty'
              WHEN f.html_length < 10000 AND {_sql_any('lower(p.html)', Q.BLOCK_PHRASES)} THEN 'phrase'
              WHEN f.html_length >= 10000 AND {_sql_any('lower(p.html[1:4000])', Q.STRUCTURAL_MARKERS)} THEN 'marker'
              WHEN f.html_length < 1000 AND ({" OR ".join(f"f.host = '{d}' OR suffix(f.host, '.{d}')" for d in Q.CONTENT_HEAVY)}) THEN 'short body' END AS reason
  FROM attempts a JOIN facts f USING (page_id) JOIN pages p USING (page_id)),
tries AS (
  SELECT *, CASE WHEN reason IS NOT NULL THEN 'invalid content' WHEN score < CASE WHEN tier = 5 THEN 0 ELSE 0.55 END THEN 'low score' ELSE 'ok' END AS verdict
  FROM (SELECT *, CAST({_score_sql('status_code', 'latency_ms')} AS DOUBLE) AS score FROM blocks))"""

_CASES = (
    "http://localhost/a", "https://LOCALHOST:8080/", "http://127.0.0.1/", "http://10.1.2.3/x", "http://172.16.0.1/", "http://172.32.0.1/", "http://192.168.1.1/",
    "http://169.254.169.254/latest", "http://[::1]/", "http://[fe80::1]/", "ftp://example.com/", "https://example.com/ok", "not a url", "file:///etc/hosts", "http://0.0.0.0/",
)


def url_safety(spark, sf_dir):
    cases = spark.createDataFrame([(u,) for u in _CASES], "url string")
    urls = table(spark, sf_dir, "pages").select("url").unionByName(cases)
    return urls.select("url", U.url_safe(F.col("url")).alias("safe"))


_HOST6 = "lower(coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://\\[([^\\]]*)\\]', 1), ''), regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)))"


def request_validation(spark, sf_dir):
    i = F.col("page_id")
    body = F.to_json(
        F.struct(
            F.when(i % 5 == 0, "not a url").otherwise(F.col("url")).alias("url"), ((i * 977) % 150000).cast("int").alias("timeout"),
            F.element_at(F.array(*map(F.lit, ("auto", "none", "mobile", "satellite"))), (i % 4 + 1).cast("int")).alias("proxy"),
            F.when(i % 3 == 0, F.array(F.lit("markdown"), F.lit("pdf"))).when(i % 3 == 1, F.array(F.lit("json"))).alias("formats"),
            F.when(i % 2 == 0, "").otherwise("https://hooks.example.com/a").alias("webhookUrl"), F.when(i % 6 == 0, "{}").when(i % 6 < 4, '{"title": "string"}').alias("schema"),
        )
    )
    from ..sources.tables import requests as parse

    parsed = parse(table(spark, sf_dir, "pages").select("page_id", body.alias("body")))
    errors = U.request_errors("request", needs_schema=True)
    filled = parsed.select("page_id", errors.alias("e"), U.with_defaults("request").alias("r"))
    return filled.select(
        "page_id", F.array_join("e", ",").alias("errors"), (F.size("e") == 0).alias("valid"), F.col("r.cacheTtl").alias("cache_ttl"),
        F.array_join(U.with_formats(F.col("r.formats"), "json", "markdown"), ",").alias("formats"), F.col("r.webhookUrl").alias("webhook"),
    )


def cache_keys(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    formats = F.when(F.col("page_id") % 2 == 0, F.array(F.lit("markdown"))).otherwise(F.array(F.lit("json"), F.lit("markdown")))
    schema = F.when(F.col("page_id") % 3 == 0, F.lit('{"title":"string"}'))
    return p.select("page_id", U.cache_key(F.col("url"), formats, F.lit("auto"), schema).alias("key"), U.script_key(F.coalesce(schema, F.lit("{}"))).alias("script"))


def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.html_title(F.col("html")).alias("title"))


def plain_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.plain_text(F.col("html")).alias("text"))


_plain = "html"
for _tag in ("script", "style", "noscript"):
    _plain = f"regexp_replace({_plain}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', ' ', 'g')"


def token_cost(spark, sf_dir):
    t = X.estimate_tokens(F.col("html"))
    p = table(spark, sf_dir, "pages").select("page_id", t.alias("tokens"))
    return p.select("page_id", "tokens", *(F.round(X.token_cost(F.col("tokens"), F.lit(500), m), 9).alias(m) for m in X.MODEL_PRICES))


def extraction_prompt(spark, sf_dir):
    prompt = X.extraction_prompt(F.col("html"), F.lit('{"title":"string"}'))
    return table(spark, sf_dir, "pages").select("page_id", F.length(prompt).alias("chars"), F.sha2(prompt, 256).alias("sha256"))


_KINDS = ("document", "script", "media", "font", "xhr")


def resource_blocking(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("page_id") % 5 + 1).cast("int"))
    url = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("https://www.google-analytics.com/c?u="), "url")).otherwise(F.col("url"))
    return p.select("page_id", kind.alias("kind"), requests.resource_blocked(kind, url).alias("blocked"))


def domain_membership(spark, sf_dir):
    """Pages below a listed domain, by a semi join of all suffixes of their hosts."""
    domains = spark.createDataFrame([("example.net",), ("tionsh.example.net",), ("example.com",)], "domain string")
    hosts = table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("host"))
    each = hosts.select("page_id", "host", F.explode(U.suffixes(F.col("host"))).alias("domain"))
    return each.join(F.broadcast(domains), "domain", "left_semi").select("page_id", "host").distinct()  # three rows


def tier_stability(spark, sf_dir):
    a = attempts(spark, sf_dir).withColumn("got", F.when(F.col("status_code") == 200, F.col("tier") % 2).otherwise(-1))
    return evaluate.stable_tiers(a, "page_id", ["tier"], "got")


def smart_vs_forced(spark, sf_dir):
    a = attempts(spark, sf_dir).withColumn("mode", F.when(F.col("tier") == 1, "smart").when(F.col("tier") == 4, "forced"))
    return evaluate.paired_runs(a.where("mode IS NOT NULL"), "page_id", "mode", "smart", "forced", "latency_ms")


def _gold(spark, sf_dir):
    i = F.col("page_id")
    base = table(spark, sf_dir, "pages").select("page_id", "url", X.html_title(F.col("html")).alias("title"))
    gold = base.select("url", "title", (i % 50 + 0.99).alias("price"), F.lit("In stock").alias("availability"), (i % 5 + 1).cast("int").alias("rating"))
    got = base.where(i % 4 != 0).select(
        "url", F.when(i % 7 == 0, F.concat("title", F.lit("!"))).otherwise(F.concat(F.lit(" "), "title")).alias("title"), (i % 50 + 0.99 + (i % 5) * 0.01).alias("price"),
        F.when(i % 6 == 0, "gone").otherwise("in stock (3 available)").alias("availability"), F.when(i % 9 == 0, 1).otherwise(i % 5 + 1).cast("int").alias("rating"),
    )
    return evaluate.gold_compare(gold, got)


def gold_accuracy(spark, sf_dir):
    return evaluate.field_accuracy(_gold(spark, sf_dir))


_TITLE = "nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '')"

QUERIES = {
    f.__name__: f
    for f in (
        page_quality, page_quality_by_host, block_detection, tier_acceptance, first_ok_tier, escalation, url_safety, request_validation, cache_keys,
        page_title, plain_text, token_cost, extraction_prompt, resource_blocking, domain_membership, tier_stability, smart_vs_forced, gold_accuracy,
    )
}
_PROMPT = (
    "'Extract the data that fits the JSON schema from the page below. Answer with JSON only: an array if the page lists several items, else one object; "
    "null for fields that the page lacks; numbers without currency signs.' || chr(10) || chr(10) || '--- SCHEMA ---' || chr(10) || '{\"title\":\"string\"}' "
    "|| chr(10) || chr(10) || '--- HTML ---' || chr(10) || html"
)
SQL = {
    "page_quality": f"WITH {FACTS_SQL}, {_QUALITY} SELECT page_id, host, html_length, text_length, tag_count, indicators, score, {_SIGNALS} AS signals FROM scored",
    "page_quality_by_host": f"WITH {FACTS_SQL}, {_QUALITY} SELECT host, count(*) AS pages, round(avg(score), 6) AS mean_score, round(count(*) FILTER (WHERE score >= 0.55) / count(*), 6) AS accepted_share FROM scored GROUP BY host",
    "block_detection": sql_with("attempts", more=f"{FACTS_SQL}, {_BLOCKS}") + "SELECT page_id, tier, status_code, coalesce(reason, 'content') AS reason, reason IS NULL AS valid FROM blocks",
    "tier_acceptance": sql_with("attempts", more=f"{FACTS_SQL}, {_BLOCKS}") + "SELECT page_id, tier, score, verdict = 'ok' AS ok, verdict, latency_ms FROM tries",
    "first_ok_tier": sql_with("attempts", more=f"{FACTS_SQL}, {_BLOCKS}")
    + "SELECT page_id, tier, score, true AS ok, verdict, latency_ms FROM tries WHERE verdict = 'ok' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY tier) = 1",
    "escalation": sql_with("attempts", more=f"{FACTS_SQL}, {_BLOCKS}")
    + "SELECT page_id, coalesce(min(tier) FILTER (WHERE verdict = 'ok'), max(tier) FILTER (WHERE tier >= 4)) AS tier, count(*) FILTER (WHERE verdict = 'ok') > 0 AS accepted FROM tries GROUP BY page_id",
    "url_safety": f"""WITH u AS (SELECT url FROM pages UNION ALL SELECT unnest([{", ".join(f"'{c}'" for c in _CASES)}]) AS url),
h AS (SELECT url, {_HOST6} AS host FROM u)
SELECT url, regexp_matches(url, '(?i)^https?://[^/ ]') AND host <> '' AND NOT regexp_matches(host, '^localhost$|^127\\.|^10\\.|^172\\.(1[6-9]|2[0-9]|3[01])\\.|^192\\.168\\.|^0\\.|^169\\.254\\.|^::1$|^fc00:|^fe80:') AS safe FROM h""",
    "request_validation": """WITH e AS (
  SELECT page_id, page_id % 5 = 0 AS e_url, page_id % 3 = 0 AS e_formats, (page_id * 977) % 150000 NOT BETWEEN 1000 AND 120000 AS e_timeout, page_id % 4 = 3 AS e_proxy,
         page_id % 6 = 0 OR page_id % 6 >= 4 AS e_schema FROM pages)
SELECT page_id, concat_ws(',', CASE WHEN e_url THEN 'url' END, CASE WHEN e_formats THEN 'formats' END, CASE WHEN e_timeout THEN 'timeout' END, CASE WHEN e_proxy THEN 'proxy' END, CASE WHEN e_schema THEN 'schema' END) AS errors,
       NOT (e_url OR e_formats OR e_timeout OR e_proxy OR e_schema) AS valid, CAST(3600 AS INT) AS cache_ttl,
       CASE WHEN page_id % 3 = 0 THEN 'json,markdown,pdf' ELSE 'json,markdown' END AS formats, CASE WHEN page_id % 2 = 1 THEN 'https://hooks.example.com/a' END AS webhook FROM e""",
    "cache_keys": """SELECT page_id, sha256('{"url":"' || url || '","formats":' || CASE WHEN page_id % 2 = 0 THEN '["markdown"]' ELSE '["json","markdown"]' END || ',"proxy":"auto"'
       || CASE WHEN page_id % 3 = 0 THEN ',"extractSchema":"{\\"title\\":\\"string\\"}"' ELSE '' END || '}')[1:16] AS key, sha256(CASE WHEN page_id % 3 = 0 THEN '{"title":"string"}' ELSE '{}' END)[1:12] AS script FROM pages""",
    "page_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "plain_text": f"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace({_plain}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '{_SP}+', ' ', 'g')) AS text FROM pages",
    "token_cost": "SELECT page_id, tokens, " + ", ".join(f"round((tokens * {a} + 500 * {b}) / 1000000, 9) AS {m}" for m, (a, b) in X.MODEL_PRICES.items()) + " FROM (SELECT page_id, CAST(ceil(length(html) / 4) AS BIGINT) AS tokens FROM pages)",
    "extraction_prompt": f"SELECT page_id, CAST(length(prompt) AS INT) AS chars, sha256(prompt) AS sha256 FROM (SELECT page_id, {_PROMPT} AS prompt FROM pages)",
    "resource_blocking": f"""SELECT page_id, kind, kind IN ('media', 'font', 'manifest', 'prefetch') OR {_sql_any("u", requests.BLOCKED_PARTS)} AS blocked
FROM (SELECT page_id, CASE page_id % 5 {" ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS))} END AS kind, CASE WHEN page_id % 7 = 0 THEN 'https://www.google-analytics.com/c?u=' || url ELSE url END AS u FROM pages)""",
    "domain_membership": f"SELECT page_id, host FROM (SELECT page_id, {_HOST} AS host FROM pages) WHERE host = 'example.net' OR suffix(host, '.example.net') OR host = 'example.com' OR suffix(host, '.example.com')",
    "tier_stability": sql_with("attempts") + """SELECT page_id, bool_and(got = f OR got = -1) AS stable, count(*) AS runs
FROM (SELECT page_id, got, first_value(got) OVER (PARTITION BY page_id ORDER BY tier) AS f FROM (SELECT page_id, tier, CASE WHEN status_code = 200 THEN tier % 2 ELSE -1 END AS got FROM attempts)) GROUP BY page_id""",
    "smart_vs_forced": sql_with("attempts") + """SELECT page_id, smart, forced, CAST(floor((1 - smart / nullif(forced, 0)) * 100 + 0.5) AS BIGINT) AS saved_pct
FROM (SELECT page_id, CAST(sum(latency_ms) FILTER (WHERE tier = 1) AS BIGINT) AS smart, CAST(sum(latency_ms) FILTER (WHERE tier = 4) AS BIGINT) AS forced FROM attempts GROUP BY page_id)""",
    "gold_accuracy": """WITH g AS (SELECT page_id AS i, page_id % 7 <> 0 AS title, abs((page_id % 50 + 0.99::DOUBLE) - (page_id % 50 + 0.99::DOUBLE + (page_id % 5) * 0.01::DOUBLE)) < 0.02::DOUBLE AS price, page_id % 6 <> 0 AS availability, page_id % 9 <> 0 OR page_id % 5 = 0 AS rating FROM pages WHERE page_id % 4 <> 0),
r AS (SELECT unnest(['title', 'price', 'availability', 'rating']) AS field, unnest([title, price, availability, rating]) AS ok FROM g)
SELECT field, CAST(floor(count(*) FILTER (WHERE ok) * 100 / count(*) + 0.5) AS BIGINT) AS accuracy FROM r GROUP BY field""",
}
