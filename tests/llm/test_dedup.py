"""Near-duplicate operators and the graph helpers against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webgrain.llm import common, graph, minhash_dedup, vector_dedup
from webgrain.llm.common import BLANK, chunks, span_hashes, spans, text_bytes

from .test_filters import DOCS, LOW, with_clashes


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "random", "star", "none"])
def test_components(spark, shape):
    rng = np.random.default_rng(3)
    edges = {
        "chain": [(i, i + 1) for i in range(40)] + [(100, 101)], "random": [tuple(map(int, rng.integers(0, 60, 2))) for _ in range(45)],
        "star": [(7, i) for i in range(20, 50)], "none": [],
    }[shape]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == roots(nodes, [e for e in edges if e[0] != e[1]])


def test_runs_hold_back_the_last_group():
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64())], names=["g"]) for x in ([1, 1, 2], [2, 2], [], [2, 3, 4], [4])]
    out = [[t.column(0).to_pylist()[a:b] for a, b in zip(c[:-1], c[1:])] for t, c in graph.runs(iter(batches))]
    assert [g for part in out for g in part] == [[1, 1], [2, 2, 2, 2], [3], [4, 4]]


def test_word_hashes_tell_words_and_texts_apart():
    texts = ["ab cd", "", None, "ab\tcd ab", "abcd", "É ab", "x" * 3000]
    raw, offsets = text_bytes(pa.array(texts))
    starts, ends, counts = spans(raw, offsets, BLANK)
    assert counts.tolist() == [2, 0, 0, 3, 1, 2, 1]
    h = span_hashes(raw, starts, ends)
    word = [raw[a:b].tobytes() for a, b in zip(starts, ends)]
    assert len(set(h.tolist())) == len(set(word))
    assert {w: x for w, x in zip(word, h.tolist())} == {w: x for w, x in reversed(list(zip(word, h.tolist())))}
    assert [b - a for a, b in chunks(offsets, 10)] and sum(b - a for a, b in chunks(offsets, 10)) == len(texts)


# -- texts -------------------------------------------------------------------------


def shingles(text, n):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(docs, n, percent):
    sets = [shingles(t, n) for _, t in docs]
    links = []
    for i in range(len(docs)):
        for k in range(i):
            inter = len(sets[i] & sets[k])
            if inter and 100 * inter >= percent * (len(sets[i]) + len(sets[k]) - inter):
                links.append((i, k))
    group = roots(range(len(docs)), links)
    low = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            low[group[i]] = min(low.get(group[i], k), k)
    return [(k, len(s), low.get(group[i])) for i, ((k, _), s) in enumerate(zip(docs, sets))]


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"new{rng.integers(1000)}" for w in words)


def corpus(rng):
    words = [f"w{i}" for i in range(300)]
    docs = []
    for g in range(25):  # groups of copies from exact to far
        base = list(rng.choice(words, rng.integers(30, 200)))
        for k in range(int(rng.integers(1, 7))):
            docs.append((len(docs), edited(rng, base, 0.004 * k * (g % 5))))
    base = list(rng.choice(words, 150))
    chain = list(base)
    for k in range(25):  # a chain: the ends are unlike
        for _ in range(2):
            chain[rng.integers(len(chain))] = f"c{rng.integers(1000)}"
        docs.append((len(docs), " ".join(chain)))
    docs += [(len(docs) + i, edited(rng, base, 0.01)) for i in range(40)]
    docs += [(900, None), (901, ""), (902, " \n"), (903, "one Two"), (904, "ONE two"), (905, "one"), (905, "one"), (905, "other words entirely here"), (None, "one"), (None, "no id here at all"), (906, "long " * 50000)]
    return docs


@pytest.mark.parametrize("n,percent,side", [(3, 85, 512), (5, 80, 8)])
def test_minhash_dedup_against_brute_force(spark, monkeypatch, n, percent, side):
    monkeypatch.setattr(minhash_dedup.dealt, "__kwdefaults__", {"side": side})  # small blocks: groups are split
    docs = corpus(np.random.default_rng(n))
    df = with_clashes(spark.createDataFrame(docs, DOCS).repartition(3))
    rows = minhash_dedup.near_duplicates(df, words=n, percent=percent).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=key) == sorted(brute_components(docs, n, percent), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_minhash_dedup_of_nothing(spark):
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = minhash_dedup.near_duplicates(spark.createDataFrame([(1, None), (2, "a b c")], DOCS)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows} == {(1, 0, 1, True), (2, 1, 2, True)}


def test_least_matches_is_below_what_links_have():
    rng = np.random.default_rng(5)
    need = minhash_dedup.least_matches(48, 85)
    assert 25 < need < 41
    short = 0
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 860, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 70, dtype=np.uint64)])) for _ in range(2))
        short += (minhash_dedup.signature(a, 48) == minhash_dedup.signature(b, 48)).sum() < need
    assert short == 0


# -- vectors -----------------------------------------------------------------------


def test_nearest_e8_is_the_nearest_lattice_point():
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1.5, (200, 8))
    found = vector_dedup.nearest_e8(x)
    twice = np.rint(found * 2)
    assert (np.abs(found * 2 - twice) < 1e-9).all() and ((twice % 2 == 0).all(axis=1) | (twice % 2 == 1).all(axis=1)).all() and (found.sum(axis=1) % 2 == 0).all()
    for move in vector_dedup.MINIMAL:  # no neighbour is nearer
        assert (((x - found) ** 2).sum(axis=1) <= ((x - found - move) ** 2).sum(axis=1) + 1e-9).all()
    assert len(vector_dedup.MINIMAL) == 240 and np.allclose((vector_dedup.MINIMAL**2).sum(axis=1), 2)


def test_lattice_recall_at_the_threshold():
    rng = np.random.default_rng(8)
    a = vector_dedup.unit(rng.normal(size=(3000, 64)))
    z = rng.normal(size=a.shape)
    z = vector_dedup.unit(z - (z * a).sum(axis=1, keepdims=True) * a)
    met = np.zeros(len(a), bool)
    for (ha, va), (hb, vb) in zip(vector_dedup.cells(a), vector_dedup.cells(0.95 * a + np.sqrt(1 - 0.95**2) * z)):
        met |= (ha == hb) | (va == hb[:, None]).any(axis=1) | (vb == ha[:, None]).any(axis=1)
    assert met.mean() > 0.99


def vectors():
    rng = np.random.default_rng(9)
    out = []
    for size in (1, 1, 2, 5, 40, 90):
        centre = rng.normal(size=32)
        out += [centre + rng.normal(size=32) * rng.uniform(0.02, 0.25) for _ in range(size)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(out)]
    return rows + [(500, rows[3][1]), (501, [2 * x for x in rows[3][1]]), (502, None), (503, []), (504, [0.0] * 32), (505, [float("nan")] + [1.0] * 31), (506, [None] + [1.0] * 31),
                   (507, [float("inf")] * 32), (508, [1.0, 2.0]), (509, [2.0, 4.0]), (3, rows[3][1]), (None, rows[4][1])]


@pytest.mark.parametrize("side", [1024, 16])
def test_lattice_dedup_against_brute_force(spark, monkeypatch, side):
    monkeypatch.setattr(vector_dedup, "SIDE", side)
    rows = vectors()
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    fine = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links, degree = [], [0] * len(rows)
    for i, (_, a) in enumerate(rows):
        for k, (_, b) in enumerate(rows):
            if i != k and fine(a) and fine(b) and len(a) == len(b):
                x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.95:
                    links.append((i, k))
                    degree[i] += 1
    group = roots(range(len(rows)), links)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[group[i]] = min(low.get(group[i], k), k)
    want = sorted((str(k), degree[i], str(low.get(group[i]))) for i, (k, _) in enumerate(rows))
    got = vector_dedup.near_duplicates(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_lattice_dedup_of_nothing(spark):
    assert vector_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    (r,) = vector_dedup.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()
    assert (r.n_links, r.component_id, r.kept) == (0, 1, True)


def test_sized_broadcasts_small_tables_only(spark):
    df = spark.range(10)
    assert "broadcast" in common.sized(df)._jdf.queryExecution().logical().toString().lower()
    long = df.select(F.array(F.repeat(F.lit("x"), 100)).alias("texts"))
    for big in (common.sized(df, 5), common.sized(long, most=900)):
        assert "broadcast" not in big._jdf.queryExecution().logical().toString().lower()
    assert df.join(common.sized(spark.range(3), 1), "id").count() == 3


def test_few_rows_are_not_many_files(spark):
    """Each file costs forks of an executor on a local disk; all rows stay, and many rows keep their tasks."""
    df = spark.range(1000).repartition(60)
    few, many = (common.written(df, "some", rows=n) for n in (1000, 10**6))
    assert len(few.inputFiles()) == 16 and len(many.inputFiles()) == 60
    assert few.count() == many.count() == 1000


def test_steps_of_components_are_few_files(spark, monkeypatch):
    files, keep = [], graph.written

    def written(df, name, **more):
        out = keep(df, name, **more)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(graph, "written", written)
    settings = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        edges = spark.range(400).selectExpr("id AS a", "id + 1 AS b").where("a % 20 < 19")
        assert graph.components(edges, rows=400).select("component").distinct().count() == 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 2 and max(files) <= 16
