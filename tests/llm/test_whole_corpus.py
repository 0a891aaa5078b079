"""LM scoring learns from all training documents."""

from collections import Counter

import numpy as np
import pyarrow as pa

from webgrain.llm import lm_score
from webgrain.llm.common import text_bytes

from .test_filters import DOCS


def sequences(texts, sub):
    words = lm_score.words_of(*text_bytes(pa.array(texts)))
    spelling = lm_score.Spelling.of(words, sub)
    cuts = np.cumsum(words.counts)[:-1]
    return list(zip(np.split(spelling.first[words.tokens], cuts), np.split(spelling.last[words.tokens], cuts)))


def loss(net, texts):
    """Of all windows of a text."""
    pad = np.full(lm_score.BLOCK, -1, np.int64)
    out = []
    for t in texts:
        first, last = (np.concatenate([pad, [net.end], x, pad]) for x in t)
        begin = np.full(-(-len(t[0]) // lm_score.BLOCK), lm_score.BLOCK)
        out.append(lm_score.gradients(net, first, last, begin + np.arange(len(begin)) * lm_score.BLOCK, begin)[0])
    return float(np.mean(out))


def test_ids_are_classed_and_windows_trained_on_over_the_whole_corpus(spark):
    sub = lm_score.Subwords(lm_score.rank_path())
    long = "zebra quartz " * 60000  # longer than what the sample takes, and than a stored sequence
    texts = ["the cat sat"] * 30 + [long]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    all_ids = sequences(texts, sub)
    scanned = [lm_score.scan_corpus(d, "doc_id", "text", lm_score.rank_path()) for d in (df, df.repartition(5))]
    words = scanned[0].where("kind = 0").groupBy("item", "first", "a").sum("n").withColumnRenamed("sum(n)", "n")
    net, spells = lm_score.models_of(words, scanned[0].where("kind = 1").select("item", "n"), sub)
    counts = np.bincount(np.concatenate([f for f, _ in all_ids]), minlength=sub.size)
    assert (net.class_of == lm_score.classes_of(counts, lm_score.ALONE, lm_score.BANDS)).all()
    assert (spells.tokens == counts).all() and spells.kinds.sum() == 1 + len({w for t in texts for w in t.split()})
    kept = Counter(len(bytes(r.a)) // 2 for r in scanned[0].where("kind = 2").collect())
    assert kept == Counter([4] * 30 + [lm_score.SEQUENCE, 120001 - lm_score.SEQUENCE])
    net = lm_score.fit(net, all_ids[:30], steps=20)
    shards = [lm_score.fit_shards(net, s, 2) for s in scanned]
    assert loss(shards[0], all_ids[30:]) < 0.9 * loss(net, all_ids[30:])
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(shards[0].weights(), shards[1].weights()))
