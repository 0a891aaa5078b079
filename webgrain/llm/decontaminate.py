"""Benchmark decontamination with a distributed positional inverted index.

Built-in DataFrame functions only.  Test texts are cut into windows of words.
One pass over the corpus counts the test vocabulary; a window with a word that
the corpus lacks can't occur.  A second pass stores the postings (word,
document, position) of each window's rarest words as a table.  Lists of the two
rarest words of a window, each shifted by the word's place in it, are
intersected; what is left is compared word by word with the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, narrow, sized, written

#: What parts words: ASCII characters but digits and small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Rarest words of a window whose lists are intersected.
ANCHORS = 2


def words_of(text: Column) -> Column:
    """Splitting costs an eighth of what matching the words does."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN), "")


def windows_of(texts: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """Distinct windows: words, items (the ids of the texts that have it).

    A text of fewer words, but not none, is one window.
    """
    w = F.col("all_words")
    cut = F.when(F.size(w) == 0, F.array().cast("array<array<string>>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (size - 1))), lambda i: F.slice(w, i, size))
    )
    return (
        narrow(texts, item, text).select(F.col(item).alias("item"), words_of(F.col(text)).alias("all_words"))
        .select("item", F.explode(cut).alias("words")).groupBy("words").agg(F.collect_set(F.col("item").cast("string")).alias("items"))
        .withColumn("window", F.xxhash64(F.array_join("words", " ")))
    )


def postings(docs: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """The index: (term, key, position) of all occurrences of the given terms."""
    tokens = docs.select(F.col(key).alias("key"), F.posexplode(words_of(F.col(text))).alias("position", "term"))
    return tokens.join(terms, "term")


def anchors_of(windows: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """(window, term, place, rank) of the n rarest words of each window that can occur."""
    placed = windows.select("window", F.posexplode("words").alias("place", "term"))
    counted = placed.join(counts, "term", "left").groupBy("window").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "term"))).alias("by")
    )  # at most as many rows in a group as a window has words
    return counted.where(F.col("by")[0]["n"] > 0).select(
        "window", F.least(F.size("by"), F.lit(n)).alias("anchors"), F.posexplode(F.slice("by", 1, n)).alias("rank", "a")
    ).select("window", "anchors", "rank", F.col("a.term").alias("term"), F.col("a.place").alias("place"))


def candidates(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(key, window, start) where all anchors of a window stand in their places."""
    shifted = index.join(sized(anchors), "term").select(
        "key", "window", (F.col("position") - F.col("place")).alias("start"), "anchors", F.expr("shiftleft(1, rank)").alias("bit")
    )
    return (
        shifted.where("start >= 0").groupBy("key", "window", "start").agg(F.bit_or("bit").alias("bits"), F.first("anchors").alias("anchors"))
        .where(F.col("bits") == F.expr("shiftleft(1, anchors) - 1")).select("key", "window", "start")
    )


def counted_terms(docs: DataFrame, key: str, text: str, windows: DataFrame) -> DataFrame:
    """(term, n): how often each word of the windows occurs in the corpus."""
    terms = windows.select(F.explode("words").alias("term")).distinct()
    return postings(docs, key, text, sized(terms)).groupBy("term").agg(F.count("*").alias("n"))


def find_occurrences(docs: DataFrame, windows: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hits): candidate starts of windows in each document that has any, as
    an array of (start, words, window)."""
    counts = written(counted_terms(docs, key, text, windows), "counts")
    anchors = written(anchors_of(windows, counts, ANCHORS), "anchors")
    index = written(postings(docs, key, text, sized(anchors.select("term").distinct())), "postings")
    found = candidates(index, anchors).join(sized(windows.select("window", "words")), "window")
    return found.groupBy("key").agg(F.collect_list(F.struct("start", "words", "window")).alias("hits"))


def decontaminate(
    docs: DataFrame, tests: DataFrame, *, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", size: int = WINDOW, keep_text: bool = False,
) -> DataFrame:
    """A row for each document: key, n_words, n_hit, n_items, items, contaminated.

    n_hit counts the document's words inside any occurrence of a window, items
    are the ids, as sorted strings, of the tests whose windows occur.  Null and
    empty texts have no words and no hits; rows that repeat are judged each for
    itself, also if they share a key or have none; an empty table of documents or
    tests gives no rows or no hits; other columns are dropped.
    """
    docs = narrow(docs, key, text)
    windows = written(windows_of(tests, item, item_text, size), "windows")
    hits = written(find_occurrences(docs, windows, key=key, text=text).withColumnRenamed("key", "hit_key"), "hits")
    same = F.col(key).eqNullSafe(F.col("hit_key"))
    ids = sized(hits.select("hit_key"))
    named = docs.join(ids, same, "left_semi").join(hits, same)
    # the words are bound as a lambda's variable, or they would be split anew for each hit
    verified = F.transform(
        F.array(words_of(F.col(text))),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.filter("hits", lambda h: F.slice(w, h["start"] + 1, F.size(h["words"])) == h["words"]).alias("hits")
        ),
    )[0]
    judged = named.withColumn("found", verified).select(
        F.monotonically_increasing_id().alias("row_id"), key, *([text] if keep_text else []), F.col("found.n_words").alias("n_words"),
        F.size(F.array_distinct(F.flatten(F.transform("found.hits", lambda h: F.sequence(h["start"], h["start"] + F.size(h["words"]) - 1))))).cast("long").alias("n_hit"),
        F.array_distinct(F.transform("found.hits", lambda h: h["window"])).alias("occurring"),
    )
    judged = written(judged, "judged")  # as a table its rows' numbers stand
    tests_of = windows.select("window", F.explode("items").alias("item"))
    of_row = judged.select("row_id", F.explode("occurring").alias("window")).join(sized(tests_of), "window").groupBy("row_id").agg(F.collect_set("item").alias("items"))
    judged = judged.join(of_row, "row_id", "left").drop("row_id", "occurring").withColumn("items", F.array_sort(F.coalesce("items", F.array().cast("array<string>"))))
    clean = docs.join(ids, same, "left_anti").select(
        key, *([text] if keep_text else []), F.size(words_of(F.col(text))).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"),
    )
    return judged.unionByName(clean).select(
        key, *([text] if keep_text else []), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated")
    )


def search(docs: DataFrame, phrases: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", slop: int = 0) -> DataFrame:
    """(key, item, start, exact) of exact phrase and proximity matches.

    The rarest word of a phrase fixes where the phrase would start; the match
    holds if each word of the phrase occurs at most ``slop`` positions from its
    place there, and is exact if all are in place.  Phrases without words and
    documents without text match nothing, nor does an empty table of either.  A
    match lies in one row: rows that share a key, or have none, are searched each
    for itself, and rows that repeat whole give their matches once.
    """
    docs = narrow(docs, key, text).select(F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("hash")).alias("row"), text)
    windows = written(windows_of(phrases, item, item_text, 1 << 30), "phrases")
    counts = written(counted_terms(docs, "row", text, windows), "counts")
    places = written(anchors_of(windows, counts, 1 << 30), "places")
    index = written(postings(docs, "row", text, sized(places.select("term").distinct())), "postings")
    each = index.join(sized(places), "term").select("key", "window", "anchors", "rank", (F.col("position") - F.col("place")).alias("start"))
    width = 2 * slop + 1
    first = each.where("rank = 0").select("key", "window", "anchors", F.col("start").alias("base")).withColumn(
        "cell", F.explode(F.array(*(F.floor(F.col("base") / width) + d for d in (-1, 0, 1))))
    )
    near = first.join(each.drop("anchors").withColumn("cell", F.floor(F.col("start") / width)), ["key", "window", "cell"]).where(F.abs(F.col("start") - F.col("base")) <= slop)
    off = near.groupBy("key", "window", "anchors", "base", "rank").agg(F.min(F.abs(F.col("start") - F.col("base"))).alias("off"))
    full = off.groupBy("key", "window", "anchors", "base").agg(F.count("*").alias("n"), F.max("off").alias("most")).where("n = anchors")
    return full.join(sized(windows), "window").select(
        F.col("key.key").alias(key), F.explode("items").alias(item), F.col("base").alias("start"), (F.col("most") == 0).alias("exact")
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, tests).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


_DUCK_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
OP7_SQL = f"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_DUCK_WORDS} AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, array_to_string(w[i : i + 9], ' ') AS g, least(len(w), 10) AS size
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM win
), d AS (
  SELECT doc_id, {_DUCK_WORDS} AS w FROM documents
), g AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)
), m AS (
  SELECT g.doc_id, g.i, g.size, win.item FROM g JOIN win ON g.g = win.g AND g.size = win.size
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM m) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
