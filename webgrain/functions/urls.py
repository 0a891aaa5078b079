"""URL columns: host, safety, request validation, cache keys, API keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts that must not be fetched, as patterns.
UNSAFE_HOSTS = (
    r"(?i)^localhost$", r"^127\.", r"^10\.", r"^172\.(1[6-9]|2[0-9]|3[01])\.", r"^192\.168\.", r"^0\.", r"^169\.254\.",
    r"^::1$", r"(?i)^fc00:", r"(?i)^fe80:",
)
FORMATS = ("html", "markdown", "text", "screenshot", "json")
PROXIES = ("none", "datacenter", "residential", "mobile", "auto")
TIMEOUT, CACHE_TTL = (1000, 120000), (0, 2592000)
KEY_PREFIX = "sf_live_"


def host(url: Column) -> Column:
    """Host in lower case without port, null if the URL can't be parsed."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def url_safe(url: Column) -> Column:
    """Whether an address may be fetched: http(s), and no private or local host.

    Brackets of an IPv6 host are dropped before the test.
    """
    bare = F.regexp_replace(host(url), r"^\[|\]$", "")
    bad = F.lit(False)
    for pattern in UNSAFE_HOSTS:
        bad = bad | bare.rlike(pattern)
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return F.coalesce(~bad & scheme.isin("http", "https"), F.lit(False))


def suffixes(name: Column) -> Column:
    """A host and all domains above it, longest first: for joins with domain lists."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def in_domains(name: Column, domains: tuple[str, ...]) -> Column:
    """Whether a host is one of the domains or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | (name == d) | name.endswith(f".{d}")
    return F.coalesce(out, F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def request_errors(r: str, *, needs_schema: bool = False) -> Column:
    """Error codes of a parsed request struct; an empty array if it is valid."""
    f = lambda n: F.col(f"{r}.{n}")
    is_url = lambda c: F.coalesce(F.try_parse_url(c, F.lit("HOST")).isNotNull(), F.lit(False))
    tests = [
        (~is_url(f("url")), "url"), (F.exists(f("formats"), lambda x: ~x.isin(*FORMATS)), "formats"),
        (~f("timeout").between(*TIMEOUT), "timeout"), (~f("proxy").isin(*PROXIES), "proxy"), (~f("cacheTtl").between(*CACHE_TTL), "cacheTtl"),
        (blank_to_null(f("webhookUrl")).isNotNull() & ~is_url(f("webhookUrl")), "webhookUrl"),
    ]
    if needs_schema:
        tests.append((F.coalesce(F.size(F.json_object_keys(f("schema"))), F.lit(0)) == 0, "schema"))
    return F.array_compact(F.array(*(F.when(test, code) for test, code in tests)))


def with_defaults(r: str) -> Column:
    """The request struct with its defaults filled in."""
    f = lambda n: F.col(f"{r}.{n}")
    filled = {
        "formats": F.coalesce(f("formats"), F.array(F.lit("markdown"))), "waitFor": blank_to_null(f("waitFor")), "timeout": F.coalesce(f("timeout"), F.lit(60000)),
        "proxy": F.coalesce(f("proxy"), F.lit("auto")), "screenshot": F.coalesce(f("screenshot"), F.lit(False)), "mobile": F.coalesce(f("mobile"), F.lit(False)),
        "blockResources": F.coalesce(f("blockResources"), F.lit(True)), "cacheTtl": F.coalesce(f("cacheTtl"), F.lit(3600)), "webhookUrl": blank_to_null(f("webhookUrl")),
    }
    out = F.col(r)
    for name, value in filled.items():
        out = out.withField(name, value)
    return out


def with_formats(formats: Column, *more: str) -> Column:
    """More formats, each once, in order; the given ones come after them."""
    return F.array_distinct(F.concat(F.array(*map(F.lit, more)), formats))


def cache_key(url: Column, formats: Column, proxy: Column, extract_schema: Column | None = None) -> Column:
    """16 hex digits of the options' JSON; absent options leave no key in it."""
    fields = [url.alias("url"), formats.alias("formats"), proxy.alias("proxy")]
    if extract_schema is not None:
        fields.append(extract_schema.alias("extractSchema"))
    return F.substring(F.sha2(F.to_json(F.struct(*fields)), 256), 1, 16)


def script_key(schema_json: Column) -> Column:
    return F.substring(F.sha2(schema_json, 256), 1, 12)


def api_key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def bearer_key(header: Column) -> Column:
    """The API key of an Authorization header, null if it has none of the right form."""
    key = F.regexp_extract(header, "^Bearer (.+)$", 1)
    return F.when(key.startswith(KEY_PREFIX), key)


# Beginnings of paths that need no key, and of those that no rate limit counts.
KEYLESS_ROUTES = ("/health", "/metrics", "/docs", "/openapi.json", "/v1/scrape/stream")
UNLIMITED_ROUTES = ("/health", "/metrics", "/docs", "/docs/json")


def is_public_route(path: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return out
