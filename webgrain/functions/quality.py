"""Page quality, block pages and what a fetch tier accepts, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import host, in_domains

# Phrases of bot walls that cost a page some of its score.
BOT_INDICATORS = (
    "captcha", "challenge", "verify you are human", "access denied", "you have been blocked", "rate limit",
    "unusual traffic", "please enable javascript to view",
)
# Phrases that make a small page a block page.
BLOCK_PHRASES = (
    "cf-browser-verification", "challenge-platform", "ddos-protection", "captcha-delivery", "access denied", "please verify you are human",
    "just a moment", "enable javascript and cookies to continue", "to discuss automated access to amazon data", "errors/validatecaptcha",
    "unusual traffic from your computer network", "our systems have detected unusual traffic", "robot or human", "blocked.gif", "px-captcha",
    "pxcaptcha", "perimeterx", "datadome", "shieldsquare",
)
# Markers that give a block page away in the head of a large page.
STRUCTURAL_MARKERS = ("cf-browser-verification", "challenge-platform", "captcha-delivery", "errors/validatecaptcha", "px-captcha", "pxcaptcha")
# Hosts whose real pages are never short.
CONTENT_HEAVY = tuple(f"{d}.com" for d in ("walmart", "amazon", "target", "ebay", "bestbuy", "google", "youtube", "linkedin", "facebook", "instagram", "twitter", "x"))
# Elements whose text isn't seen.
UNSEEN = ("script", "style", "noscript", "svg", "template", "iframe")
ACCEPT = 0.55
SPACE = r"[ \t\n\r\f\x0B]"


def text_length(html: Column) -> Column:
    """Visible characters, by patterns: no parser is needed for a score."""
    out = F.regexp_replace(html, rf"(?is)<({'|'.join(UNSEEN)})[^>]*>.*?</\1>", " ")
    for pattern in (r"(?s)<!--.*?-->", r"<[^>]+>", r"(?i)&nbsp;|&#160;", rf"{SPACE}+"):
        out = F.regexp_replace(out, pattern, " ")
    return F.length(F.trim(out))


def tag_count(html: Column) -> Column:
    """Opening tags that carry content."""
    return F.regexp_count(html, F.lit(rf"(?i)<(p|h[1-6]|li|td|article|section|div)(>|{SPACE})"))


def phrases_in(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


def has_any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


@dataclass(frozen=True)
class PageFacts:
    """Columns that hold what the score needs of a page's html, counted once."""

    size: Column
    text: Column
    tags: Column
    indicators: Column

    @classmethod
    def of(cls, html: Column) -> PageFacts:
        return cls(F.length(html), text_length(html), tag_count(html), F.size(phrases_in(F.lower(html), BOT_INDICATORS)))

    def named(self) -> list[Column]:
        return [self.size.alias("html_length"), self.text.alias("text_length"), self.tags.alias("tag_count"), self.indicators.alias("indicators")]

    @classmethod
    def stored(cls) -> PageFacts:
        return cls(*map(F.col, ("html_length", "text_length", "tag_count", "indicators")))


def _penalties(facts: PageFacts, status: Column, latency: Column) -> list[tuple[Column, Column, Column]]:
    """(when, how many hundredths, signal), in the order of the signals."""
    size, text = facts.size, facts.text
    h = lambda n: F.lit(n)
    ratio = F.format_string("%.1f", text / F.greatest(size, F.lit(1)) * 100.0)
    return [
        (status != 200, h(30), F.concat(F.lit("status "), status.cast("string"))),
        (size < 1000, h(20), F.lit("short html")),
        ((size >= 1000) & (text < 500), h(50), F.concat(F.lit("very little text: "), text.cast("string"))),
        ((size >= 1000) & (text >= 500) & (text < 1500), h(15), F.concat(F.lit("little text: "), text.cast("string"))),
        ((size > 5000) & (text * 100 < size * 3), h(20), F.concat(F.lit("text share "), ratio, F.lit("%"))),
        ((text < 5000) & (facts.indicators > 0), facts.indicators * 30, F.concat(F.lit("bot indicators: "), facts.indicators.cast("string"))),
        (facts.tags < 3, h(10), F.lit("few content tags")),
        (latency > 15000, h(10), F.lit("slow")),
    ]


def quality_score(facts: PageFacts, status: Column, latency: Column) -> Column:
    """0 to 1 in steps of a hundredth, so sums of penalties are exact."""
    total = F.lit(100)
    for when, points, _ in _penalties(facts, status, latency):
        total = total - F.when(when, points).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), total)) / F.lit(100.0)


def quality_signals(facts: PageFacts, status: Column, latency: Column) -> Column:
    found = [F.when(when, signal) for when, _, signal in _penalties(facts, status, latency)]
    good = F.when(quality_score(facts, status, latency) >= 0.8, "good content")
    return F.array_compact(F.array(*found, good))


def block_reason(html: Column, status: Column, url: Column | None = None) -> Column:
    """Why a response is a block page; null if it is content."""
    low, size = F.lower(html), F.length(html)
    out = (
        F.when(status.isin(403, 429, 503) | (status >= 500), "status").when(F.coalesce(size, F.lit(0)) == 0, "empty")
        .when((size < 10000) & has_any(low, BLOCK_PHRASES), "phrase")
        .when((size >= 10000) & has_any(F.lower(F.substring(html, 1, 4000)), STRUCTURAL_MARKERS), "marker")
    )
    if url is not None:
        out = out.when((size < 1000) & in_domains(host(url), CONTENT_HEAVY), "short body")
    return out


def is_content(html: Column, status: Column, url: Column | None = None) -> Column:
    return block_reason(html, status, url).isNull()


def tier_verdict(content: Column, score: Column, threshold: float = ACCEPT) -> Column:
    """struct(ok, reason): content with a score at the threshold or above."""
    reason = F.when(~content, "invalid content").when(score < threshold, "low score").otherwise("ok")
    return F.struct((reason == "ok").alias("ok"), reason.alias("reason"))
