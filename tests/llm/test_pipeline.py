"""The corpus pipeline against each stage's own reading, on a small fixture."""

import numpy as np
import pytest

import corpus_pipeline
from webgrain.llm import language, quality

from .test_dedup import brute_components
from .test_filters import TESTS, brute_hits, check_pieces, with_clashes
from .test_models import graded, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    docs, labels = graded(rng, 220)
    docs = [(k, t, "en") for k, t in docs]
    docs += [(300 + i, prose(rng, "fr", 60), "fr") for i in range(60)]
    base = docs[0][1]
    good = next(t for k, t, _ in docs if dict(labels).get(k) == 1 and len(t) > 200)
    docs += [(400, good, "en"), (401, good, "en"), (402, good + " more", "en"), (403, None, "en"), (404, "!!! 12", None), (405, "", None), (406, good + " " + TESTS[0][1], "en"), (401, good, "en")]
    docs += [(None, prose(rng, "fr", 50), "fr"), (407, prose(rng, "fr", 9000), "fr"), (400, base, "en")]
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(k, t, lang, "s", len(t or "")) for k, t, lang in docs]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(TESTS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_are_what_is_listed():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near-duplicates", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_each_stage_on_its_own_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = corpus_pipeline.known_language(spark, with_clashes(docs), sf_dir)
    assert known.columns == list(corpus_pipeline.COLUMNS)
    net = language.train(docs)
    one = lambda t: language.pooled(net, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])).max() if t and any(c.isalpha() for c in t) else 0
    want = sorted((tuple(r) for r in docs.collect() if one(r.text) >= corpus_pipeline.LEAST_CERTAIN), key=repr)
    assert rows_of(known) == want and 280 < len(want) < docs.count()

    good = corpus_pipeline.good_quality(spark, known, sf_dir)
    model = quality.train(known, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {(r.doc_id, r.text) for r in known.collect()}
    kept = {(r.doc_id, r.text) for r in good.collect()}
    assert kept < scores and model.rules
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    right = [(k, t) in kept for k, t in scores if k in labels and k < 300 and labels[k] == 1]
    wrong = [(k, t) in kept for k, t in scores if k in labels and k < 300 and labels[k] == 0]
    assert np.mean(right) > 0.97 and np.mean(wrong) < 0.1

    once = corpus_pipeline.one_of_each(spark, good, sf_dir).collect()
    source = [(r.doc_id, r.text) for r in good.collect()]
    index = [(i, t) for i, (_, t) in enumerate(source)]
    groups = {}
    for (i, _, c), (k, _) in zip(brute_components(index, 5, 80), source):
        groups.setdefault(c, []).append(k)
    assert len(once) == len(groups)
    smallest = lambda g: None if None in g else min(g)
    assert sorted((str(r.doc_id) for r in once)) == sorted(str(smallest(g)) for g in groups.values())

    clean = corpus_pipeline.uncontaminated(spark, spark.createDataFrame(once, SCHEMA), sf_dir).collect()
    hit = {(k, n, h > 0) for k, n, h, _ in brute_hits([(r.doc_id, r.text) for r in once], TESTS)}
    assert sorted(str(r.doc_id) for r in clean) == sorted(str(k) for k, _, bad in hit if not bad)

    texts = [(r.doc_id, r.text) for r in clean]
    assert len({k for k, _ in texts}) == len(texts)
    packed = corpus_pipeline.packed(spark, spark.createDataFrame(clean, SCHEMA), sf_dir).collect()
    check_pieces(texts, packed)


def test_run_goes_through_all_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {403, 404, 405, 406}.isdisjoint({r.doc_id for r in rows})


def test_pipeline_of_nothing(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
