"""MinHash near-dedup by a join of signature coordinates.

A text's set of word shingles gets a signature of minimum hashes.  Texts of equal
sets are one node.  Each node is posted under its (coordinate, value) pairs; two
nodes above the similarity agree in at least ``matches`` of them (but, at the very
threshold, for about one pair in 33,000 at 85 per cent and in 76,000 at 80).  So a node with fewer pairs that others share has no
partner and is skipped, and of the others only the rarest pairs, the prefix that
must hold one agreement, are merged.  In each merged list collisions of whole
signatures are counted, first with the list's smallest node, then of what did not
match it with all others.  Pairs above the match threshold join nodes to groups
of candidates.

Within a group, full sets decide: all nodes against the group's smallest, then
those not linked to it against all others.  So a large group of copies costs as
many comparisons as it has members, and no list of all pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, LOWER, chunks, lean, mix, narrow, sized, span_hashes, spans, text_bytes, written
from .graph import components, runs, star_edges

#: Production parameters of near-duplicate stages: words in a shingle, per cent of similarity.
WORDS, PERCENT = 5, 80
COORDINATES = 48
#: Members of a list or group that one task compares with as many others.
SIDE = 512
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(48))
_MULTIPLY = _rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles as hashes of runs of ``width`` words; the
    whole sequence if it is shorter; nothing without words."""
    raw = LOWER[raw]
    starts, ends, counts = spans(raw, offsets, BLANK)
    words = span_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    n = max(0, len(words) - width + 1)
    grams = np.full(n, width, np.uint64)
    for k in range(width if n else 0):
        grams += words[k : k + n] * _PLACE[k]
    grams = mix(grams)
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(grams[at : at + c - width + 1]))
        elif c:
            few = np.array([c], np.uint64)
            for k in range(c):
                few += words[at + k : at + k + 1] * _PLACE[k]
            out.append(mix(few))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    best = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(shingles), 4096):
        part = (shingles[a : a + 4096, None] * _MULTIPLY[:coordinates] + _ADD[:coordinates]) >> np.uint64(32)
        np.minimum(best, part.min(axis=0).astype(np.uint32), out=best)
    return best


def node_of(shingles: np.ndarray) -> int:
    """One id for equal sets."""
    m = mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    both = np.array([np.add.reduce(m), np.bitwise_xor.reduce(m)]) + np.array([len(m), 0], np.uint64)
    return int(mix(both[:1] ^ mix(both[1:]))[0].view(np.int64))


def least_matches(coordinates: int, percent: int) -> int:
    s = percent / 100
    return max(1, floor(coordinates * s - 4.2 * sqrt(coordinates * s * (1 - s))))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def signed(docs: DataFrame, key: str, text: str, width: int, coordinates: int) -> DataFrame:
    """(key, n_shingles, node, sig) of each row; node and sig are null without words."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for i, j in chunks(offsets, CHUNK_BYTES):
                sets = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array([signature(s, coordinates).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["key", "n_shingles", "node", "sig"],
                )

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias(text)).mapInArrow(lean(run), f"key {kind}, n_shingles long, node long, sig binary")


def posted(classes: DataFrame, coordinates: int) -> DataFrame:
    """(token, node) for each coordinate; token names the coordinate and its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, coordinates)
            tokens = mix(values.astype(np.uint64) + (np.arange(coordinates, dtype=np.uint64) << np.uint64(32)))
            yield pa.RecordBatch.from_arrays([pa.array(tokens.ravel().view(np.int64)), pa.array(np.repeat(node, coordinates))], names=["token", "node"])

    return classes.select("node", "sig").mapInArrow(lean(run), "token long, node long")


def dealt(rows: DataFrame, group: str, *more: str, side: int = SIDE) -> DataFrame:
    """(g, side, *more): tasks that compare a group's ``rest`` rows with all its rows.

    rows have ``rest`` and, for their group, ``n_rest`` and ``n_all``.  A task gets
    one block of either; side is 1 for the block of the rest, 2 for the other, 3
    for a row that is in both.
    """
    ka, kb = (F.ceil(F.col(c) / side).cast("int") for c in ("n_rest", "n_all"))
    i, k = F.pmod(F.xxhash64("node"), ka).cast("int"), F.pmod(F.xxhash64("node"), kb).cast("int")
    at = lambda i, k, s: F.struct(i.cast("int").alias("i"), k.cast("int").alias("k"), F.lit(s).alias("side"))
    zero = F.lit(0)
    many = F.concat(
        F.when(F.col("rest"), F.transform(F.sequence(zero, kb - 1), lambda x: at(i, x, 1))).otherwise(F.array().cast("array<struct<i:int,k:int,side:int>>")),
        F.transform(F.sequence(zero, ka - 1), lambda x: at(x, k, 2)),
    )
    one = F.when(F.col("rest"), F.array(at(zero, zero, 3))).otherwise(F.array(at(zero, zero, 2)))
    return rows.select("*", F.explode(F.when((ka == 1) & (kb == 1), one).otherwise(many)).alias("t")).select(F.xxhash64(group, "t.i", "t.k").alias("g"), "t.side", *more)


def in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("g").sortWithinPartitions("g")


def _signatures(column: pa.ChunkedArray, coordinates: int) -> np.ndarray:
    """Low halves of the coordinates: enough to count collisions."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, coordinates).astype(np.uint16)


def _collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) * len(b) < 4096:
        return (a[:, None, :] == b[None, :, :]).sum(axis=2)
    out = np.zeros((len(a), len(b)), np.uint16)
    for x, y in zip(a.T, b.T):
        out += x[:, None] == y[None, :]
    return out


def candidate_groups(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(node, component) of nodes that are joined by pairs above the match threshold."""
    posts, scale = posted(classes, coordinates), classes.count()
    # as tables, counts are sides of their own, and their joins may split a hot token's rows
    shared = written(posts.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "shared", rows=scale)
    lists = posts.join(shared, "token").groupBy("node").agg(F.collect_list(F.struct("n", "token")).alias("by"))  # at most ``coordinates`` in a group
    # of the prefix, pairs that no other node has come first: they are left out already
    prefix = F.lit(coordinates - matches + 1 - coordinates) + F.size("by")
    kept = written(lists.where(F.size("by") >= matches).select("node", F.explode(F.slice(F.array_sort("by"), 1, prefix)["token"]).alias("token")), "lists", rows=scale)
    heads = written(kept.groupBy("token").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1"), "heads", rows=scale)
    sigs = classes.select("node", "sig")
    members = (
        kept.join(heads.select("token", "head"), "token").join(sigs, "node")
        .join(sigs.select(F.col("node").alias("head"), F.col("sig").alias("head_sig")), "head")
    )

    def against_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, head = (_signatures(batch.column(c), coordinates) for c in ("sig", "head_sig"))
            hit = (sig == head).sum(axis=1) >= matches
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("node"), batch.column("head"), pa.array(~hit)], names=["token", "node", "head", "rest"])

    tried = written(members.select("token", "node", "head", "sig", "head_sig").mapInArrow(lean(against_head), "token long, node long, head long, rest boolean"), "tried")
    mixed = tried.groupBy("token").agg(F.sum(F.col("rest").cast("long")).alias("n_rest"), F.count("*").alias("n_all")).where("n_rest > 0")
    tasks = dealt(tried.join(mixed, "token"), "token", "node").join(sigs, "node").select("g", "side", "node", "sig")

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in runs(batches):
            side, node = table.column("side").to_numpy(), table.column("node").to_numpy()
            sig = _signatures(table.column("sig"), coordinates)
            us, vs = [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                left, right = a + np.flatnonzero(side[a:b] & 1), a + np.flatnonzero(side[a:b] & 2)
                hits = _collisions(sig[left], sig[right]) >= matches
                if hits.any():
                    u, v = star_edges(hits, node[left], node[right])
                    us.append(u)
                    vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["a", "b"])

    edges = tried.where("NOT rest AND node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return components(edges.unionByName(in_order(tasks).mapInArrow(lean(among, None), "a long, b long")), rows=scale)


def full_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the wanted (node, first_id) from one document of each."""
    ids = sized(wanted.select(F.col("first_id").alias("wanted_id")).distinct())
    some = docs.join(ids, F.col(key).eqNullSafe(F.col("wanted_id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            for i, j in chunks(offsets, CHUNK_BYTES):
                sets = [s for s in shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    sets = some.select(F.col(text).cast("string").alias(text)).mapInArrow(lean(run), "node long, shingles binary")
    return sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def confirmed(groups: DataFrame, sets: DataFrame, sigs: DataFrame, coordinates: int, matches: int, percent: int) -> DataFrame:
    """(a, b) edges that connect exactly what full sets link within the groups."""
    heads = groups.where("node = component").select("component").join(sets.withColumnRenamed("node", "component"), "component").withColumnRenamed("shingles", "head_set")
    pairs = groups.join(sets, "node").join(heads, "component").select("component", "node", "shingles", "head_set")

    def against_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, head = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in (2, 3))
            linked = np.array([similar(x, y, percent) for x, y in zip(own, head)], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(~linked)], names=["component", "node", "rest"])

    tried = written(pairs.mapInArrow(lean(against_head), "component long, node long, rest boolean"), "linked")
    mixed = tried.groupBy("component").agg(F.sum(F.col("rest").cast("long")).alias("n_rest"), F.count("*").alias("n_all")).where("n_rest > 0")
    tasks = dealt(tried.join(mixed, "component"), "component", "node", "rest", "component").join(sets, "node").join(sigs, "node")

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in runs(batches):
            side, node, rest, head = (table.column(c).to_numpy() for c in ("side", "node", "rest", "component"))
            sig, raw = _signatures(table.column("sig"), coordinates), table.column("shingles")
            edges = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                # what is linked to the group's smallest node is connected already
                parent = {int(x): int(x if r else h) for x, r, h in zip(node[a:b], rest[a:b], head[a:b])}
                parent[int(head[a])] = int(head[a])

                def root(x: int) -> int:
                    while parent[x] != x:  # noqa: B023
                        parent[x] = x = parent[parent[x]]  # noqa: B023
                    return x

                left, right = a + np.flatnonzero(side[a:b] & 1), a + np.flatnonzero(side[a:b] & 2)
                hits = _collisions(sig[left], sig[right])
                i, k = np.nonzero(hits >= matches)
                sets_of: dict[int, np.ndarray] = {}
                get = lambda r: sets_of.get(r) if r in sets_of else sets_of.setdefault(r, np.frombuffer(raw[r].as_py(), np.uint64))  # noqa: B023, E731
                for p in np.argsort(-hits[i, k].astype(np.int64), kind="stable"):
                    x, y = int(left[i[p]]), int(right[k[p]])
                    u, v = root(int(node[x])), root(int(node[y]))
                    if u != v and similar(get(x), get(y), percent):
                        parent[max(u, v)] = min(u, v)
                        edges.append((int(node[x]), int(node[y])))
            if edges:
                us, vs = zip(*edges)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["a", "b"])

    stars = tried.where("NOT rest AND node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    return stars.unionByName(in_order(tasks.select("g", "side", "node", "rest", "component", "shingles", "sig")).mapInArrow(lean(among, None), "a long, b long"))


def near_duplicates(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, coordinates: int = COORDINATES
) -> DataFrame:
    """A row for each document: key, n_shingles, component_id, kept.

    Documents are linked if 100 * shared shingles >= percent * all shingles of the
    two; component_id is the smallest key reachable.  Texts that are null, empty or
    blank have no shingles and link with nothing; shorter texts are one shingle;
    rows that repeat a key are documents of their own, all kept if it is the
    smallest; a null key is never the smallest unless alone; an empty table gives
    an empty table; other columns are dropped.
    """
    docs = narrow(df, key, text)
    matches = least_matches(coordinates, percent)
    rows = written(signed(docs, key, text, words, coordinates), "signatures")
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("key").alias("first_id"), F.any_value("sig").alias("sig"))
    scale = rows.count()
    classes = written(classes, "classes", rows=scale)
    groups = written(candidate_groups(classes, coordinates, matches), "groups", rows=scale)
    sets = written(full_sets(docs, key, text, classes.select("node", "first_id").join(groups.select("node"), "node"), words), "sets")
    edges = confirmed(groups, sets, classes.select("node", "sig"), coordinates, matches, percent)
    found = written(components(edges, rows=scale), "components", rows=scale)
    smallest = classes.select("node", "first_id").join(found, "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = found.join(smallest, "component").select("node", "component_id")
    facts = classes.select("node", "first_id").join(linked, "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id"))
    facts = written(facts, "facts", rows=scale)  # as a table it is a side of its own, and the join may split a hot node's rows
    return (
        rows.select(F.col("key").alias(key), "n_shingles", "node").join(facts, "node", "left")
        .select(key, "n_shingles", F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
    )


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)


OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM w WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM (SELECT c.a, c.b, c.n AS shared, p.n + q.n - c.n AS all_of_both FROM common c JOIN size p ON p.doc_id = c.a JOIN size q ON q.doc_id = c.b)
  WHERE 100 * shared >= 85 * all_of_both
), both_ways AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), low AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, low.component_id, d.doc_id = low.component_id AS kept
FROM documents d LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""
