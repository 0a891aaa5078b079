"""Groups of rows streamed through tasks, and connected components of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and where in them each group begins (and the last ends).

    Rows come sorted by their first column, the group; a group may go on in the
    next batch, so the last one is held back.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        group = table.column(0).to_numpy()
        cut = np.flatnonzero(group[1:] != group[:-1]) + 1
        if not len(cut):
            held = table
            continue
        yield table.slice(0, int(cut[-1])), np.concatenate([[0], cut])
        held = table.slice(int(cut[-1]))
    if held is not None:
        yield held, np.array([0, held.num_rows])


def local_labels(hits: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and each column reaches over the hits."""
    most = np.iinfo(np.int64).max
    a, b = rows.copy(), columns.copy()
    while True:
        b2 = np.minimum(b, np.where(hits, a[:, None], most).min(axis=0, initial=most))
        a2 = np.minimum(a, np.where(hits, b2[None, :], most).min(axis=1, initial=most))
        # the same id may stand on both sides
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def star_edges(hits: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (smallest id, other id) that connect what the hits connect: no more
    than there are ids, however many hits."""
    a, b = local_labels(hits, rows, columns)
    ids, labels = np.concatenate([rows, columns]), np.concatenate([a, b])
    far = ids != labels
    return labels[far], ids[far]


def components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, component) of all nodes of the edges; component is the smallest node.

    Large and small stars in turn: each step links every node to the smallest of
    its neighbours, so the number of edges never grows, and long chains shorten to
    half.  Each step is a table in the shared folder; only counts reach the driver.
    rows is about the number of edges, if it is known.
    """
    now = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u < v").distinct()
    now, before = written(now, "edges", rows=rows), None
    rows = now.count()
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        # the large star: larger neighbours of v go to the smallest that v sees
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v").distinct()
        small = large.groupBy("v").agg(F.min("u").alias("m"))
        now = written(
            large.join(small, "v").select(F.explode(F.when(F.col("u") == F.col("m"), F.array(F.struct("v", F.col("m").alias("u")))).otherwise(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u"))))).alias("e")).select("e.*").where("u < v").distinct(),
            "edges", rows=rows,
        )  # the small star: v and its smaller neighbours go to the smallest of them
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
    tails = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return tails.unionByName(tails.select(F.col("component").alias("node"), "component").distinct())
