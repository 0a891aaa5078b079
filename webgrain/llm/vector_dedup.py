"""Embedding near-dedup by lattice hashing.

Vectors are scaled to length one and projected at random to a few blocks of
eight dimensions, several times over.  Each block is decoded to its nearest
point of the E8 lattice; a table's cell is named by the points of its blocks.  A
vector is at home in one cell of each table and also visits the neighbouring
cells whose walls are nearest, reached by one minimal vector of one block.  Who
is at home in a cell is compared with all who are there, by cosine in double
precision.

Cells yield links as stars, never as all pairs; connected vectors are then
compared within their component, so that links that no cell showed count too.
Cells and components of many vectors are split into blocks, a task each.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, mix, narrow, written
from .graph import components, runs, star_edges

COSINE = 0.95
#: At cosine 0.95 one table brings a pair together with a probability of 0.57,
#: eight tables of 0.999; unrelated vectors meet in a table about once in 70,000.
TABLES, BLOCKS, SCALE, PROBES = 8, 2, 2.0, 4
#: Vectors of a cell or component that one task compares with as many others.
SIDE = 512


def _minimal() -> np.ndarray:
    """The 240 minimal vectors of E8."""
    pairs = [(i, j, a, b) for i in range(8) for j in range(i + 1, 8) for a in (1, -1) for b in (1, -1)]
    whole = np.zeros((len(pairs), 8))
    for row, (i, j, a, b) in zip(whole, pairs):
        row[i], row[j] = a, b
    half = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.concatenate([whole, np.array(half)])


MINIMAL = _minimal()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: if rounding gives an odd one, the
    coordinate that was furthest off is rounded the other way."""
    near = np.rint(x)
    off = x - near
    odd = near.sum(axis=1) % 2 != 0
    rows, worst = np.arange(len(x)), np.abs(off).argmax(axis=1)
    near[rows, worst] += np.where(odd, np.where(off[rows, worst] >= 0, 1, -1), 0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 moved by one half: the nearer of the nearest points of both."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _name(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    h = np.full(len(points), table * 1_000_003 + dim, dtype=np.uint64)
    for c in np.rint(points * 2).astype(np.int64).astype(np.uint64).T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c)
    return h.view(np.int64)


def cells(x: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE, probes: int = PROBES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each table: the names of the vectors' own cells (n), of visited ones (n, probes)."""
    n, dim = x.shape
    for table in range(tables):
        rng = np.random.Generator(np.random.PCG64([table, dim]))
        y = (unit(x) @ rng.standard_normal((dim, 8 * blocks))) / scale
        home = np.concatenate([nearest_e8(y[:, 8 * b : 8 * b + 8]) for b in range(blocks)], axis=1)
        # a wall is the nearer, the further the rest points along its minimal vector
        along = np.concatenate([(y - home)[:, 8 * b : 8 * b + 8] @ MINIMAL.T for b in range(blocks)], axis=1)
        order = np.argpartition(-along, probes, axis=1)[:, :probes]
        visited = np.empty((n, probes), np.int64)
        for p in range(probes):
            other = home.copy()
            block, move = order[:, p] // len(MINIMAL), MINIMAL[order[:, p] % len(MINIMAL)]
            for b in range(blocks):
                other[:, 8 * b : 8 * b + 8] += np.where((block == b)[:, None], move, 0)
            visited[:, p] = _name(other, table, dim)
        yield _name(home, table, dim), visited


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) by dimension."""
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten()).astype(np.float64)
    ends = np.cumsum(sizes)
    out = []
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        out.append((rows, flat[(ends[rows] - dim)[:, None] + np.arange(dim)]))
    return out


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node = batch.column(0).to_numpy()
        for rows, x in _matrix(batch.column(1)):
            for a in range(0, len(rows), 4096):
                who = node[rows[a : a + 4096]]
                for home, visited in cells(x[a : a + 4096]):
                    cell = np.concatenate([home, visited.ravel()])
                    at_home = np.arange(len(cell)) < len(home)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.concatenate([who, np.repeat(who, visited.shape[1])])), pa.array(at_home)], names=["cell", "node", "home"])


def _links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in runs(batches):
            side, node = table.column("side").to_numpy(), table.column("node").to_numpy()
            us, vs = [], []
            parts = _matrix(table.column("embedding").combine_chunks())
            whole = len(parts) == 1 and unit(parts[0][1])
            for a, b in zip(cuts[:-1], cuts[1:]):
                some = [(np.arange(a, b), whole[a:b])] if whole is not False else [(r[m], unit(x[m])) for r, x in parts if (m := (r >= a) & (r < b)).any()]
                for rows, x in some:
                    left, right = (side[rows] & 1) > 0, (side[rows] & 2) > 0
                    hits = x[left] @ x[right].T >= threshold
                    if hits.any():
                        u, v = star_edges(hits, node[rows[left]], node[rows[right]])
                        us.append(u)
                        vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["a", "b"])

    return run


def _degrees(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in runs(batches):
            side, node, n = (table.column(c).to_numpy() for c in ("side", "node", "n"))
            sums = np.zeros(len(node))
            parts = _matrix(table.column("embedding").combine_chunks())
            for a, b in zip(cuts[:-1], cuts[1:]):
                for r, x in parts:
                    m = (r >= a) & (r < b)
                    if not m.any():
                        continue
                    rows, v = r[m], unit(x[m])
                    left, right = (side[rows] & 1) > 0, (side[rows] & 2) > 0
                    hits = v[left] @ v[right].T >= threshold
                    hits &= node[rows[left]][:, None] != node[rows[right]][None, :]
                    sums[rows[left]] += hits @ n[rows[right]]
                    if not (left & right).any():
                        sums[rows[right]] += n[rows[left]] @ hits
            some = sums > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(np.rint(sums[some]).astype(np.int64))], names=["node", "links"])

    return run


def _grouped(rows: DataFrame, classes: DataFrame, *more: str) -> DataFrame:
    """(g, side, node, embedding, ...) with a group's rows together and in order."""
    full = rows.join(classes.select("node", "embedding", *more), "node").select("g", "side", "node", "embedding", *more)
    return full.repartition("g").sortWithinPartitions("g")


def near_duplicates(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", threshold: float = COSINE) -> DataFrame:
    """A row for each vector: key, n_links, component_id, kept.

    n_links counts the other rows whose vectors have at least the cosine with this
    row's.  Vectors that are null, empty, all zero or hold null or non-finite
    components link with nothing, as do vectors of different length; rows that
    repeat a key are vectors of their own, and all of them are kept if the key is
    the component's smallest; a null key is never the smallest unless alone; an
    empty table gives an empty table; other columns are dropped.
    """
    v = F.col(vector)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = narrow(df, key, vector).select(key, F.when(good, F.xxhash64(vector)).alias("node"), F.when(good, v).alias(vector))
    classes = written(
        rows.where("node IS NOT NULL").groupBy("node").agg(F.min(key).alias("first_id"), F.count("*").alias("n"), F.any_value(vector).alias("embedding")), "classes"
    )
    posted = written(classes.select("node", "embedding").mapInArrow(lean(_post), "cell long, node long, home boolean"), "cells")
    size = posted.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("there")).where("homes > 0 AND there > 1")
    split = lambda n: F.ceil(F.col(n) / SIDE).cast("int")
    among = posted.join(size, "cell").select("cell", "node", "home", split("homes").alias("ka"), split("there").alias("kb"))
    one = (F.col("ka") == 1) & (F.col("kb") == 1)
    i, k = F.pmod(F.xxhash64("node"), F.col("ka")).cast("int"), F.pmod(F.xxhash64("node"), F.col("kb")).cast("int")
    none = F.array().cast("array<struct<i:int,k:int,side:int>>")
    row = lambda i, k, side: F.struct(i.alias("i"), k.alias("k"), F.lit(side).alias("side"))
    dealt = F.when(one, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("k"), F.when(F.col("home"), 3).otherwise(2).alias("side")))).otherwise(
        F.concat(
            F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("kb") - 1), lambda x: row(i, x, 1))).otherwise(none),
            F.transform(F.sequence(F.lit(0), F.col("ka") - 1), lambda x: row(x, k, 2)),
        )
    )
    tasks = among.select("cell", "node", F.explode(dealt).alias("t")).select(F.xxhash64("cell", "t.i", "t.k").alias("g"), "t.side", "node")
    edges = _grouped(tasks, classes).mapInArrow(lean(_links(threshold), None), "a long, b long")
    found = written(components(edges), "components")

    sizes = found.groupBy("component").agg(F.count("*").alias("there"))
    placed = found.join(sizes, "component").select("component", "node", split("there").alias("k")).withColumn("at", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    pairs = placed.select("component", "node", "at", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")).select(
        F.xxhash64("component", F.least("at", "other"), F.greatest("at", "other")).alias("g"),
        F.when(F.col("at") == F.col("other"), 3).when(F.col("at") < F.col("other"), 1).otherwise(2).alias("side"), "node",
    )
    links = _grouped(pairs, classes, "n").mapInArrow(lean(_degrees(threshold), None), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))

    about = classes.select("node", "n", "first_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = about.groupBy("component").agg(F.min("first_id").alias("component_id"))
    facts = about.join(smallest, "component").join(links, "node", "left").select(
        F.col("node").alias("own"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    return (
        rows.select(key, "node").join(facts, F.col("node") == F.col("own"), "left")
        .select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("own").isNull(), F.col(key)).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
    )


def op1_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), low AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), deg AS (
  SELECT a, count(*) AS n FROM link GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links, low.component_id, e.vec_id = low.component_id AS kept
FROM embeddings e LEFT JOIN deg ON deg.a = e.vec_id LEFT JOIN low ON low.a = e.vec_id
"""
