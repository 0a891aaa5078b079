"""Text, Markdown, JSON and money columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f\x0B]"
# Money for a million tokens in and out.
MODEL_PRICES = {"small": (0.075, 0.30), "large": (0.10, 0.40)}


def clean_markdown(md: Column) -> Column:
    out = F.regexp_replace(md, r"!\[\]\(data:image[^)]{0,200}\)", "")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\(javascript:[^)]*\)", "$1")
    out = F.regexp_replace(out, r"(?m)^[ \t\n\r\f\x0B;]+$", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, rf"\A{SPACE}+|{SPACE}+\z", "")


def with_heading(md: Column, title: Column) -> Column:
    """The text under its title, unless it begins with a heading."""
    has = md.rlike(rf"\A{SPACE}*#{SPACE}+")
    return F.when((F.coalesce(title, F.lit("")) != "") & ~has, F.concat(F.lit("# "), F.trim(title), F.lit("\n\n"), md)).otherwise(md)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")).cast("long")


def html_title(html: Column) -> Column:
    """The title element's text, trimmed; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def plain_text(html: Column) -> Column:
    """Text by patterns: without scripts, styles and tags, blanks collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    for pattern in (r"(?s)<!--.*?-->", r"<[^>]+>", rf"{SPACE}+"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(out)


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def body_to_html(text: Column, title: Column) -> Column:
    """Paragraphs of a text that is parted by blank lines, under a heading."""
    parts = F.filter(F.transform(F.split(text, r"\n{2,}"), lambda p: F.trim(p)), lambda p: p != "")
    body = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), escape_html(p), F.lit("</p>"))), "")
    return F.concat(F.coalesce(F.concat(F.lit("<h1>"), escape_html(title), F.lit("</h1>")), F.lit("")), body)


def decode_entities(text: Column) -> Column:
    for a, b in (("&amp;", "&"), ("&#39;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def token_cost(tokens_in: Column, tokens_out: Column, model: str = "small") -> Column:
    a, b = MODEL_PRICES[model]
    return (tokens_in * a + tokens_out * b) / 1_000_000


def unfence(text: Column, kinds: str = "json") -> Column:
    """What stands in the first code fence, else the text; trimmed."""
    trim = lambda c: F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")
    inside = F.regexp_extract(text, rf"(?s)```(?:{kinds})?{SPACE}*(.*?)```", 1)
    return F.when(text.rlike(rf"(?s)```(?:{kinds})?{SPACE}*.*?```"), trim(inside)).otherwise(trim(text))


def json_span(text: Column) -> Column:
    """The outer object or array of a text with prose around it."""
    t = unfence(text)
    first = lambda c: F.instr(t, c)
    last = lambda c: F.when(F.instr(t, c) > 0, F.length(t) - F.instr(F.reverse(t), c) + 1).otherwise(0)
    o, oe, a, ae = first("{"), last("}"), first("["), last("]")
    array = (a > 0) & ((o == 0) | (a < o)) & (ae > a)
    return F.when(array, F.substring(t, a, ae - a + 1)).when((o > 0) & (oe > o), F.substring(t, o, oe - o + 1)).otherwise(t)


def repaired_json(text: Column) -> Column:
    """The JSON text if it parses, else null."""
    span = json_span(text)
    return F.when(F.try_parse_json(span).isNotNull(), span)


def schema_keys(schema: Column) -> Column:
    """Field names: of ``properties``, else of ``items.properties``, else the top level."""
    keys = lambda path: F.json_object_keys(F.get_json_object(schema, path))
    return F.coalesce(keys("$.properties"), keys("$.items.properties"), F.json_object_keys(schema), F.array().cast("array<string>"))


def first_item(json: Column) -> Column:
    """The object itself, or the first of an array, as a map of texts."""
    item = F.when(F.ltrim(json).startswith("["), F.get_json_object(json, "$[0]")).otherwise(json)
    return F.from_json(item, "map<string,string>")


def filled_keys(json: Column) -> Column:
    item = first_item(json)
    return F.coalesce(F.map_keys(F.map_filter(item, lambda k, v: v.isNotNull() & (v != ""))), F.array().cast("array<string>"))


def fill_score(json: Column, schema: Column) -> Column:
    """Share of the schema's fields that the first item fills; 1 without fields."""
    keys = schema_keys(schema)
    filled = F.size(F.array_intersect(keys, filled_keys(json)))
    return F.when(F.size(keys) == 0, 1.0).when(first_item(json).isNull(), 0.0).otherwise(filled / F.size(keys))


def missing_keys(required: Column, json: Column) -> Column:
    return F.array_except(required, filled_keys(json))


def extraction_prompt(html: Column, schema: Column) -> Column:
    """A prompt that asks for JSON of a page by a schema."""
    return F.concat(
        F.lit("Extract the data that fits the JSON schema from the page below. Answer with JSON only: an array if the page lists "
              "several items, else one object; null for fields that the page lacks; numbers without currency signs.\n\n--- SCHEMA ---\n"),
        schema, F.lit("\n\n--- HTML ---\n"), html,
    )


def fidelity_checks(md: Column, html_length: Column) -> Column:
    """Eight tests of converted Markdown."""
    return F.struct(
        md.rlike(r"(^|\n)# ").alias("has_h1"), md.rlike(r"(^|\n)## ").alias("has_h2"), md.rlike(r"(^|\n)### ").alias("has_h3"),
        md.rlike(r"\[[^\]]+\]\([^)]+\)").alias("has_links"), md.rlike(r"(^|\n)[-*] ").alias("has_list_items"),
        (~F.substring(md, 1, 1000).rlike(r"(?i)\b(Main page|Contents menu|Navigation menu|Donate)\b")).alias("no_nav_junk"),
        ((F.length(md) > 5000) & (F.length(md) < html_length)).alias("reasonable_length"),
        (md.rlike(r"\[[0-9]+\]") | F.contains(md, F.lit("[edit]"))).alias("has_citations"),
    )


def product_record(html: Column) -> Column:
    """Title, price, availability and rating of a product page, by patterns."""
    get = lambda pattern: F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))
    words = F.create_map(*(F.lit(x) for i, w in enumerate(("One", "Two", "Three", "Four", "Five")) for x in (w, i + 1)))
    return F.struct(
        decode_entities(F.trim(get(r"(?s)<div class=\"col-sm-6 product_main\">.*?<h1>([^<]+)</h1>"))).alias("title"),
        get(r"<p class=\"price_color\">[^£]*£([0-9.]+)\s*</p>").try_cast("double").alias("price"),
        get(r"(?is)<p class=\"instock availability\">.*?(In stock|Out of stock)").alias("availability"),
        F.try_element_at(words, get(r"<p class=\"star-rating (One|Two|Three|Four|Five)\"")).alias("rating"),
    )
