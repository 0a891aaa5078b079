"""Sinks: the request log by day, results by key, signed payloads, job stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .requests import sign


def append_log(rows: DataFrame, path: str) -> None:
    """Appends log rows, a folder for each day."""
    rows.withColumn("date", F.to_date("created_at")).write.mode("append").partitionBy("date").parquet(path)


def webhook_payloads(results: DataFrame, secret: str, *columns: str) -> DataFrame:
    """The JSON bodies that go out, with their signatures."""
    body = F.to_json(F.struct(*columns))
    return results.select(*columns, body.alias("payload"), F.lit(secret).alias("secret")).withColumn("signature", sign()).drop("secret")


def progress_rows(results: DataFrame) -> DataFrame:
    from ..streaming.streams import progress_events

    return progress_events(results)
