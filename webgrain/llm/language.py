"""Language ID: a bidirectional gated recurrent network over bytes.

Texts are cut into segments of bytes.  Two gated recurrent layers read each
segment, one from either end, a linear layer gives every position probabilities
of the languages, and a document's are the mean over all its positions.  The
network is trained here in numpy by backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, crc_mod, first_by_hash, lean, narrow, text_bytes

HIDDEN = 12
SEGMENT = 128
#: The sample that the network is trained on: so many documents of each language, the
#: first by a hash of their id, and of each a run of so many characters at most, from a
#: place that depends on the id, so that long texts are learnt from as well.
SAMPLE_DOCS, SAMPLE_CHARS = 500, 4096
STEPS, BATCH, CROP = 500, 192, 64
#: Segments that are read side by side.
SIDE_BY_SIDE = 768
CHUNK_BYTES = 1 << 20
UNKNOWN = "und"
_PAD = 256


@dataclass
class Network:
    langs: list[str]
    x: np.ndarray  # (2, 257, 3H): what each byte adds to the update gate, the reset gate and the candidate
    u: np.ndarray  # (2, H, 3H)
    out: np.ndarray  # (2H, L)
    bias: np.ndarray  # (L,)

    def parameters(self) -> list[np.ndarray]:
        return [self.x, self.u, self.out, self.bias]


def fresh(langs: list[str], hidden: int = HIDDEN, seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    f = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    return Network(langs, f(2, 257, 3 * hidden), f(2, hidden, 3 * hidden), f(2 * hidden, len(langs)), np.zeros(len(langs), np.float32))


def _both(tokens: np.ndarray) -> np.ndarray:
    """(T, 2, B): what the forward and the backward layer read at each step."""
    return np.stack([tokens.T, tokens.T[::-1]], axis=1)


def run_layers(net: Network, tokens: np.ndarray, keep: bool = False):
    """States (T, 2, B, H) by step; with ``keep`` also what the gradient needs.

    Padding stands at the ends of segments, which the backward layer reads first:
    its state stays zero there.
    """
    read = _both(tokens)
    steps, _, batch = read.shape
    hidden = net.u.shape[1]
    h = np.zeros((2, batch, hidden), np.float32)
    states = np.empty((steps, 2, batch, hidden), np.float32)
    kept = []
    live = (read != _PAD).astype(np.float32)[..., None]
    forward, backward = np.arange(2)[:, None], None
    for t in range(steps):
        a = net.x[forward, read[t]]
        hu = h @ net.u
        gates = a[..., : 2 * hidden] + hu[..., : 2 * hidden]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, r = gates[..., :hidden], gates[..., hidden:]
        inner = hu[..., 2 * hidden :]
        n = np.tanh(a[..., 2 * hidden :] + r * inner)
        new = h - n
        new *= z
        new += n
        new *= live[t]
        if keep:
            kept.append((h, z, r, inner, n, live[t]))
        states[t] = h = new
    return (states, read, kept) if keep else states


def position_probabilities(net: Network, states: np.ndarray) -> np.ndarray:
    """(T, B, L): each position from the state before it and the state after it."""
    hidden = net.u.shape[1]
    logits = states[:, 0] @ net.out[:hidden] + states[::-1, 1] @ net.out[hidden:] + net.bias
    logits -= logits.max(axis=-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=-1, keepdims=True)
    return logits


def gradients(net: Network, tokens: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all positions and its gradients, backwards through time."""
    states, read, kept = run_layers(net, tokens, keep=True)
    steps, _, batch, hidden = states.shape
    p = position_probabilities(net, states)
    live = (tokens.T != _PAD).astype(np.float32)
    total = max(float(live.sum()), 1.0)
    loss = -float((np.log(p[:, np.arange(batch), labels] + 1e-9) * live).sum()) / total
    d = p
    d[:, np.arange(batch), labels] -= 1
    d *= live[..., None] / total
    both = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)
    g_out = both.reshape(-1, 2 * hidden).T @ d.reshape(-1, d.shape[-1])
    back = d @ net.out.T
    d_states = np.stack([back[..., :hidden], back[::-1, :, hidden:]], axis=1)
    g_x, g_u, dh = np.zeros_like(net.x), np.zeros_like(net.u), np.zeros_like(states[0])
    for t in range(steps - 1, -1, -1):
        h, z, r, inner, n, on = kept[t]
        dh = (dh + d_states[t]) * on
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * inner * r * (1 - r)
        dx = np.concatenate([dz, dr, dn], axis=-1)
        dhu = np.concatenate([dz, dr, dn * r], axis=-1)
        g_u += h.transpose(0, 2, 1) @ dhu
        for k in range(2):
            np.add.at(g_x[k], read[t, k], dx[k])
        dh = dh * z + dhu @ net.u.transpose(0, 2, 1)
    return loss, [g_x, g_u, g_out, d.reshape(-1, d.shape[-1]).sum(axis=0)]


def fit(samples: list[tuple[bytes, str]], steps: int = STEPS, seed: int = 5) -> Network:
    """A network for the languages of the samples, each language drawn as often."""
    langs = sorted({lang for _, lang in samples})
    net = fresh(langs)
    if len(langs) < 2:
        return net
    by = {lang: [t for t, x in samples if x == lang and t] for lang in langs}
    langs_with = [k for k, lang in enumerate(langs) if by[lang]]
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, steps + 1):
        labels = rng.choice(langs_with, BATCH)
        tokens = np.full((BATCH, CROP), _PAD, np.int64)
        for i, k in enumerate(labels):
            text = by[langs[k]][rng.integers(len(by[langs[k]]))]
            at = rng.integers(max(1, len(text) - CROP + 1))
            piece = np.frombuffer(text[at : at + CROP], np.uint8)
            tokens[i, : len(piece)] = piece
        _, grads = gradients(net, tokens, labels)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for p, g, (m, v) in zip(net.parameters(), grads, moments):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def pooled(net: Network, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each text's probabilities: the mean over all its positions (empty: even)."""
    n, langs = len(offsets) - 1, len(net.langs)
    sizes = np.diff(offsets)
    pieces = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(n), pieces)
    first = np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = offsets[:-1][doc] + (np.arange(len(doc)) - first) * SEGMENT
    length = np.minimum(offsets[1:][doc] - start, SEGMENT)
    sums = np.zeros((n, langs))
    order = np.argsort(length, kind="stable")
    for a in range(0, len(order), SIDE_BY_SIDE):
        part = order[a : a + SIDE_BY_SIDE]
        most = int(length[part].max())
        at = start[part][:, None] + np.arange(most)
        live = np.arange(most) < length[part][:, None]
        tokens = np.where(live, raw[np.minimum(at, len(raw) - 1)].astype(np.int64), _PAD)
        p = position_probabilities(net, run_layers(net, tokens))
        np.add.at(sums, doc[part], np.einsum("tbl,bt->bl", p, live.astype(np.float32)))
    return np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], 1 / max(langs, 1))


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Network:
    """A network of a bounded sample of labelled documents outside the held-out fold."""
    usable = narrow(docs, key, text, lang).where((crc_mod(F.col(key), 3) != 1) & F.col(lang).isNotNull() & (F.length(text) > 0))
    place = F.pmod(F.xxhash64(key), F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    crops = usable.select(key, F.col(lang).cast("string").alias(lang), F.col(text).cast("string").alias(text)).withColumn(text, F.col(text).substr(place, F.lit(SAMPLE_CHARS)))
    rows = first_by_hash(crops, key, sample_docs, by=lang).orderBy(lang, F.xxhash64(key), key, text).collect()
    return fit([(r[text].encode(), r[lang]) for r in rows])


def identify(docs: DataFrame, net: Network, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, lang_pred, score of each row, repeated ones too.

    ``und`` with a score of 0 comes for null texts and texts without a letter, and
    for all if the network has no language; an empty table gives an empty table;
    other columns are dropped.
    """
    source = narrow(docs, key, text).select(F.col(key), F.col(text).cast("string").alias(text))
    source = source.select(key, F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias(text))
    schema = f"{key} {source.schema[key].dataType.simpleString()}, lang_pred string, score double"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            blank = ~np.asarray(batch.column(1).is_valid()) | (not net.langs)
            found = [pooled(net, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets, CHUNK_BYTES)] if net.langs else []
            p = np.concatenate(found) if found else np.zeros((len(blank), 1))
            best = p.argmax(axis=1)
            names = [UNKNOWN if b else net.langs[k] for b, k in zip(blank, best)]
            scores = np.where(blank, 0.0, np.clip(p[np.arange(len(p)), best], 0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[key, "lang_pred", "score"])

    return source.mapInArrow(lean(read), schema).withColumn("held_out", crc_mod(F.col(key), 3) == 1)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
