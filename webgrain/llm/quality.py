"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on statistics of labelled texts.  Each path from a root
to a node is a conjunctive rule; a lasso-penalised logistic model weighs the
rules and drops most of them.  What is left is compiled into one Spark column
over the statistics, which are counted for whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, LOWER, chunks, crc_mod, first_by_hash, lean, narrow, span_hashes, spans, text_bytes

#: Labelled rows the model is fitted on: the first by a hash of their id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, LEAF, LASSO = 40, 3, 20, 2e-3
THRESHOLD = 0.3
CHUNK_BYTES = 1 << 20

_MARKS = "!*$%#&|.,"
#: Byte classes: 0 other ASCII, 1 small, 2 capital, 3 digit, 4 beyond ASCII, 5 blank, 6 new line, then the marks.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:], _CLASS[BLANK] = 1, 2, 3, 4, 5
_CLASS[10] = 6
for _i, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = 7 + _i
_LINE = np.zeros(256, bool)
_LINE[[10, 13]] = True
STATISTICS = (
    "size", "words", "word_length", "longest_word", "capitals", "digits", "beyond_ascii", "other_marks", "line_words",
    "distinct_words", "repeated_lines", "doubled_marks", "marked_words", "capital_words",
    *(f"mark_{ord(c)}" for c in _MARKS),
)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(doc * 16 + _CLASS[raw], minlength=n * 16).reshape(n, 16).astype(np.float64)
    per = lambda positions: np.diff(np.searchsorted(positions, offsets)).astype(np.float64)
    size = np.diff(offsets).astype(np.float64)
    starts, ends, words = spans(raw, offsets, BLANK)
    word_doc = np.repeat(np.arange(n), words)
    words = words.astype(np.float64)
    length = ends - starts
    longest = np.zeros(n)
    np.maximum.at(longest, word_doc, length)
    hashes = span_hashes(LOWER[raw], starts, ends) if len(starts) else np.zeros(0, np.uint64)
    distinct = np.bincount((np.unique((word_doc.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))) >> np.uint64(40)).astype(np.int64), minlength=n)
    ls, le, lines = spans(raw, offsets, _LINE)
    line_doc = np.repeat(np.arange(n), lines)
    line_hash = span_hashes(raw, ls, le) if len(ls) else np.zeros(0, np.uint64)
    distinct_lines = np.bincount((np.unique((line_doc.astype(np.uint64) << np.uint64(40)) | (line_hash >> np.uint64(24))) >> np.uint64(40)).astype(np.int64), minlength=n)
    last = _CLASS[raw[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    odd = (last >= 7) & (last < 14) | (last == 0)
    first = _CLASS[raw[starts]] == 2 if len(starts) else np.zeros(0, bool)
    second = np.zeros(len(starts), bool)
    long = length > 1
    second[long] = _CLASS[raw[starts[long] + 1]] == 2
    same = np.flatnonzero((raw[1:] == raw[:-1]) & ((_CLASS[raw[1:]] >= 7) | (_CLASS[raw[1:]] == 0))) if len(raw) > 1 else np.zeros(0, np.int64)
    one, some = np.maximum(size, 1), np.maximum(words, 1)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2], 1)
    out = [
        np.log1p(size), np.log1p(words), (size - kinds[:, 5] - kinds[:, 6]) / some, longest, kinds[:, 2] / letters, kinds[:, 3] / one,
        kinds[:, 4] / one, kinds[:, 0] / one, words / np.maximum(lines, 1), distinct / some, (lines - distinct_lines) / np.maximum(lines, 1),
        per(same) / some, np.bincount(word_doc, odd, n) / some, np.bincount(word_doc, first & second, n) / some,
        *(kinds[:, 7 + i] / some for i in range(len(_MARKS))),
    ]
    return np.column_stack(out)


def with_statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and the statistics of each row's whole text; null counts as empty."""
    source = narrow(df, key, text).select(F.col(key), F.col(text).cast("string").alias(text))
    schema = f"{key} {source.schema[key].dataType.simpleString()}, " + ", ".join(f"{s} double" for s in STATISTICS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            found = [statistics(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets, CHUNK_BYTES)]
            table = np.concatenate(found) if found else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in table.T)], names=[key, *STATISTICS])

    return source.mapInArrow(lean(count), schema)


Path = tuple[tuple[int, bool, float], ...]  # (statistic, over, limit): x > limit if over, else x <= limit


@dataclass
class RuleModel:
    rules: list[Path]
    weights: list[float]
    bias: float

    def column(self) -> Column:
        """The score as a Spark column over the statistics."""
        total = F.lit(float(self.bias))
        for path, weight in zip(self.rules, self.weights):
            test = None
            for k, over, limit in path:
                x = F.col(STATISTICS[k])
                one = x > float(limit) if over else x <= float(limit)
                test = one if test is None else test & one
            total = total + F.when(test, float(weight)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(path: Path, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, over, limit in path:
        out &= x[:, k] > limit if over else x[:, k] <= limit
    return out


def grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], rng: np.random.Generator, path: Path, depth: int) -> Iterator[Path]:
    """The paths to all nodes below, of a tree on random statistics."""
    if depth == 0 or len(y) < 2 * LEAF or y.min() == y.max():
        return
    best, n, ones = (1e-9, None), len(y), y.sum()
    base = ones * (n - ones) / n
    for k in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
        if not len(cuts[k]):
            continue
        slot = np.searchsorted(cuts[k], x[:, k])
        left = np.cumsum(np.bincount(slot, minlength=len(cuts[k]) + 1))[:-1]
        left_ones = np.cumsum(np.bincount(slot, y, len(cuts[k]) + 1))[:-1]
        right, right_ones = n - left, ones - left_ones
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = base - left_ones * (left - left_ones) / left - right_ones * (right - right_ones) / right
        gain[(left < LEAF) | (right < LEAF)] = -1
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = (gain[at], (int(k), float(cuts[k][at])))
    if best[1] is None:
        return
    k, limit = best[1]
    for over in (False, True):
        side = x[:, k] > limit if over else x[:, k] <= limit
        below = (*path, (k, over, limit))
        yield below
        yield from grow(x[side], y[side], cuts, rng, below, depth - 1)


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal gradient; the bias is free."""
    n, d = a.shape
    w, b = np.zeros(d), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    step = 4 * n / max(float(np.linalg.norm(np.column_stack([a, np.ones(n, a.dtype)]), 2)) ** 2, 1e-9)
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(a @ v.astype(a.dtype) + c))) - y
        w2, b2 = v - step * (a.T @ g.astype(a.dtype)) / n, c - step * g.mean()
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> RuleModel:
    """Without rows of both labels the score is the smoothed share of ones."""
    if len(y) < 2 * LEAF or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel([], [], float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 49))) for c in x.T]
    rules: dict[bytes, Path] = {}
    for _ in range(TREES):
        rows = rng.integers(0, len(y), len(y))
        for path in grow(x[rows], y[rows], cuts, rng, (), DEPTH):
            rules.setdefault(np.packbits(holds(path, x)).tobytes(), path)
    paths = list(rules.values())
    if not paths:
        return fit(x[:0], y)
    a = np.column_stack([holds(p, x) for p in paths]).astype(np.float32)
    w, b = lasso_logistic(a, y.astype(np.float64), LASSO)
    keep = np.flatnonzero(w)
    return RuleModel([paths[k] for k in keep], [float(w[k]) for k in keep], float(b))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """A model of at most ``sample_rows`` labelled documents outside the held-out fold."""
    usable = narrow(labels, key, label).where(F.col(label).isin(0, 1) & (crc_mod(F.col(key), 5) != 0))
    chosen = first_by_hash(usable.select(F.col(key).alias("label_key"), F.col(label).cast("int").alias("label")), "label_key", sample_rows)
    wanted = narrow(docs, key, text).join(F.broadcast(chosen), F.col(key) == F.col("label_key"))  # at most sample_rows rows
    # several labels of one document are several rows of the sample
    joined = with_statistics(wanted.select(F.struct(F.col(key).alias("k"), "label").alias("row"), text).select(F.to_json("row").alias("row"), text), "row", text)
    rows = joined.withColumn("label", F.get_json_object("row", "$.label").cast("int")).orderBy("row").drop("row").toPandas()
    y = rows.pop("label").to_numpy(dtype=np.float64) if len(rows) else np.zeros(0)
    return fit(rows.to_numpy(dtype=np.float64).reshape(len(y), len(STATISTICS)), y)


def score(docs: DataFrame, model: RuleModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted of each row, repeated ones too.

    Null and empty texts have statistics of zero and get the score of those; an
    empty table gives an empty table; other columns are dropped.
    """
    return with_statistics(docs, key, text).select(key, (crc_mod(F.col(key), 5) == 0).alias("held_out"), model.column().alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
