"""Page extraction over DataFrames: content, structured records, stored specs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_item, missing_keys, schema_keys
from ..functions.urls import host

CONTENT = "html string, markdown string, text string, title string, description string, method string"
QUALITY_FLOOR, TRIAL_RUNS = 0.7, 3
SPEC_GAP = "168 hours"


def _mapped(df: DataFrame, html: str, keep: list[str], schema: str, one: Callable[[str], dict]) -> DataFrame:
    """One Python pass over small batches; each page is parsed once."""
    fields = [f.split()[0] for f in schema.split(", ")]
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [one(h) if isinstance(h, str) else {} for h in pdf[html]]
            out = pdf[keep].copy()
            for f in fields:
                out[f] = pd.Series([r.get(f) for r in rows], index=out.index, dtype="object")
            yield out

    return df.select(*keep, html).mapInPandas(run, f"{kept}, {schema}")


def extract_pages(df: DataFrame, formats: tuple[str, ...] = ("markdown", "text"), *, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """df's kept columns with the content that the formats ask for."""

    def one(page: str) -> dict:
        from ..html.extract import extract

        return extract(page, formats)

    return _mapped(df, html, keep or [c for c in df.columns if c != html], CONTENT, one)


def prune_pages(df: DataFrame, *, html: str = "html", keep: list[str], max_chars: int = 60_000) -> DataFrame:
    def one(page: str) -> dict:
        from ..html.prune import prune

        return {"pruned": prune(page, max_chars)}

    return _mapped(df, html, keep, "pruned string", one)


def extract_structured(df: DataFrame, spec: dict, *, html: str = "html", keep: list[str]) -> DataFrame:
    """df's kept columns with ``json``: an object, or an array for a listing."""
    text = json.dumps(spec)

    def one(page: str) -> dict:
        from ..html.prune import records

        s = json.loads(text)
        found = records(page, s)
        return {"json": json.dumps(found if s.get("item") else found[0], ensure_ascii=False) if found else None}

    return _mapped(df, html, keep, "json string", one)


def items(df: DataFrame, fields: list[str], json_column: str = "json") -> DataFrame:
    """A row for each record of an object or array, with a text column for each field."""
    array = F.when(F.ltrim(json_column).startswith("["), F.col(json_column)).otherwise(F.concat(F.lit("["), json_column, F.lit("]")))
    parsed = F.from_json(array, "array<struct<" + ",".join(f"`{f}`:string" for f in fields) + ">>")
    return df.select("*", F.posexplode(parsed).alias("item_no", "i")).select(*df.columns, "item_no", "i.*")


def stored_spec(df: DataFrame, specs: DataFrame, *, url: str = "url", schema_key: str = "schema_key") -> DataFrame:
    """df with the spec that is stored for its host and schema, if there is one."""
    s = specs.select(F.col("host").alias("spec_host"), F.col("schema_key").alias("spec_key"), "spec", "requiredKeys", "execCount", "avgQuality")
    return df.join(s, (host(F.col(url)) == F.col("spec_host")) & (F.col(schema_key) == F.col("spec_key")), "left").drop("spec_host", "spec_key")


def spec_outcome(json: Column, required: Column, quality: Column, avg: Column, count: Column) -> Column:
    """What comes of a run of a stored spec, in the order of its gates."""
    return (
        F.when(required.isNull(), "miss").when((avg < QUALITY_FLOOR) & (count >= TRIAL_RUNS), "dropped: drift").when(first_item(json).isNull(), "empty")
        .when(F.size(missing_keys(required, json)) > 0, "dropped: coverage").when(quality < QUALITY_FLOOR, "poor").otherwise("ok")
    )


def spec_quality(runs: DataFrame, by: list[str], quality: str = "quality") -> DataFrame:
    """Runs and their mean quality; the score that a spec begins with has no weight."""
    return runs.groupBy(*by).agg(F.count("*").alias("execCount"), F.avg(quality).alias("avgQuality"))


__all__ = ["extract_pages", "extract_structured", "items", "prune_pages", "schema_keys", "spec_outcome", "spec_quality", "stored_spec"]
