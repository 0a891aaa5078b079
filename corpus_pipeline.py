"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; each but the last returns the columns of documents.  Rows are told apart by
their id and a hash of their text, so repeated ids do no harm; columns that
documents don't have are dropped; an empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.llm import decontaminate, language, minhash_dedup, packing, quality
from webgrain.llm.common import narrow, sized, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document's language must be this certain.
LEAST_CERTAIN = 0.3


def _rows(docs: DataFrame) -> DataFrame:
    """(row, text): whole rows as a key that operators hand on."""
    return narrow(docs, *COLUMNS).select(F.struct(*COLUMNS).alias("row"), "text")


def _keyed(docs: DataFrame) -> DataFrame:
    return narrow(docs, *COLUMNS).withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("hash")))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key isn't one of the keys."""
    gone = sized(keys.select(F.col("key").alias("gone")).distinct())
    return docs.join(gone, F.col("key").eqNullSafe(F.col("gone")), "left_anti")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a language that the network knows and is certain of."""
    net = language.train(docs)
    judged = language.identify(_rows(docs), net, key="row")
    return judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_CERTAIN)).select("row.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the rules score at the threshold or above."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(_rows(docs), model, key="row").where("predicted = 1").select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, of the smallest id, of each group of near-duplicates."""
    docs = _keyed(docs)
    near = written(minhash_dedup.near_duplicates(docs, key="key"), "near")
    left = _without(docs, near.where("NOT kept"))
    again = near.where("kept").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")  # rows that repeat whole
    some = sized(again.select(F.col("key").alias("again")))
    same = F.col("key").eqNullSafe(F.col("again"))
    once = left.join(some, same, "left_semi").dropDuplicates(["key"])
    return left.join(some, same, "left_anti").unionByName(once).select(*COLUMNS)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no window of a benchmark text occurs."""
    docs = _keyed(docs)
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = written(decontaminate.decontaminate(docs, tests, key="key").where("contaminated").select("key"), "contaminated")
    return _without(docs, hits).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near-duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("packing", packed),
]
#: Two stages are trained models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage before it keeps is a table of its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
