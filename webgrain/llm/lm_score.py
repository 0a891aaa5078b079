"""LM scoring: causal self-attention over subword ids, beside a unigram baseline.

Words are lower-cased runs between blanks.  Each word, with a blank before it, is
cut into subword ids of a public vocabulary; an end id closes each text.  An
attention layer with learned biases by distance reads the words before, each as
its first and its last id, and predicts the class of the next word's first id;
within its class the id has the share that it has, after a word of the last one's
class, in the whole training corpus.  The ids that follow inside a word are
predicted from the ids before them in it: the count of the whole word among the
words with that first id, interpolated (as Witten and Bell do) with the product
of its ids' shares after one another in the distinct words of the corpus.  So the
probabilities of all words, known or not, sum to one.

Overlapping windows of two blocks are scored in batches: the queries of a block
see their own block, causally masked, and the block before it, so each token is
scored once.  Classes, words and ids are counted over all training documents.
The network is trained in numpy: it begins on a bounded sample, then each shard of
the training documents goes on from there over all its windows, and the shards'
weights are averaged by their numbers of tokens.

Counts of the most frequent words, a bounded number, go to all tasks.  Of the
other words each document's own are joined with the table of counts; so are the
pairs of ids inside words, where a corpus has more than go to all tasks.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, LOWER, chunks, crc_mod, first_by_hash, lean, narrow, span_hashes, spans, text_bytes, written

END_HASH = np.uint64(1)
#: So many words' counts, and so many pairs' of ids, are sent to the tasks at most.
FREQUENT = 500_000
#: The sample that the network begins on: documents, and characters of each, cut out
#: of longer ones at a place that depends on the key.
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 1 << 14
WIDTH, HIDDEN, BLOCK, OWN_INPUTS = 16, 32, 16, 1024
#: Classes of first ids: the most frequent alone, the others in bands of like mass.
ALONE, BANDS = 56, 8
CLASSES = ALONE + BANDS
#: The same of the ids that others follow inside a word.
SPELL_ALONE, SPELL_BANDS = 112, 16
#: Steps on the sample; blocks of a step, and how many of them stand in a row, so that
#: they share what they read before them.
STEPS, BATCH, RUN = 900, 256, 8
#: Tokens of a shard, about; tokens that it holds at a time; its highest rate of learning.
SHARD_TOKENS, HELD_TOKENS, SHARD_RATE = 1 << 21, 1 << 21, 0.002
#: Tokens of a stored sequence at most: a longer text is several.
SEQUENCE = 1 << 16
#: What an id that was never seen counts; counts that the share of an id in its class
#: is worth beside those after a class.
UNSEEN, PRIOR = 0.05, 20.0
CHUNK_BYTES = 1 << 21
#: Different words or pairs of ids that a task counts before it passes them on.
HELD_WORDS = 1 << 20
#: Words from this many bytes on are cut into ids one by one.
LONG = 2000


class Subwords:
    """Ids of words by a rank file of byte pairs."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        self.encoding = tiktoken.Encoding("score", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(self.size, bool)
        self.opens[self.end] = True
        for token, k in ranks.items():
            self.opens[k] = token[:1] == b" "

    def one(self, word: bytes) -> list[int]:
        return self.encoding.encode_ordinary(" " + word.decode("utf-8", "replace"))

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids in a row, and the number of ids of each word.

        A word's ids don't depend on its neighbours: short words are encoded as one
        text, where only a word's first id begins with a blank; long ones, and all
        of them if the numbers differ (other blanks than ASCII ones), are encoded
        one by one.
        """
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        long = [i for i, w in enumerate(words) if len(w) >= LONG]
        if long:
            short = [w for w in words if len(w) < LONG]
            ids, n = self.of(short)
            parts = np.split(ids, np.cumsum(n)[:-1]) if len(n) else []
            for i in long:
                parts.insert(i, np.array(self.one(words[i]), np.int64))
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        ids = np.array(self.encoding.encode_ordinary((b" " + b" ".join(words)).decode("utf-8", "replace")), dtype=np.int64)
        first = np.flatnonzero(self.opens[ids])
        if len(first) == len(words):
            return ids, np.diff(first, append=len(ids))
        each = [self.one(w) for w in words]
        return np.concatenate([np.array(e, np.int64) for e in each]), np.array([len(e) for e in each], np.int64)


def rank_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Words:
    """The words of some texts: distinct ones by hash, and which one each token is.

    Each text's tokens end with the end token, which is the first distinct one.
    """

    hashes: np.ndarray
    strings: list[bytes]
    tokens: np.ndarray
    counts: np.ndarray  # tokens of each text


def words_of(raw: np.ndarray, offsets: np.ndarray) -> Words:
    raw = LOWER[raw]
    starts, ends, counts = spans(raw, offsets, BLANK)
    h = span_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    which, distinct = pd.factorize(h)  # in the order of their first places
    first = np.empty(len(distinct), np.int64)
    first[which[::-1]] = np.arange(len(h))[::-1]
    data = raw.tobytes()
    strings = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    tokens = np.insert(which + 1, np.cumsum(counts), 0)
    return Words(np.concatenate([[END_HASH], distinct]), strings, tokens, counts + 1)


@dataclass
class Spelling:
    """The ids of distinct words, the end token's being the end id."""

    ids: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, words: Words, subwords: Subwords) -> Spelling:
        ids, lengths = subwords.of(words.strings)
        return cls(np.concatenate([[subwords.end], ids]), np.concatenate([[1], lengths]))

    @property
    def first(self) -> np.ndarray:
        return self.ids[np.cumsum(self.lengths) - self.lengths]

    @property
    def last(self) -> np.ndarray:
        return self.ids[np.cumsum(self.lengths) - 1]

    def steps(self, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, the one that follows, word) inside words; the end id follows a word's last."""
        after = np.append(self.ids[1:], end)
        after[np.cumsum(self.lengths) - 1] = end
        word = np.repeat(np.arange(len(self.lengths)), self.lengths)
        return self.ids[1:], after[1:], word[1:]  # the end token isn't spelled


# -- the network ---------------------------------------------------------------


@dataclass
class Attention:
    own_first: np.ndarray  # of each id: its row of ``embed`` as a word's first one
    own_last: np.ndarray  # as its last one
    class_of: np.ndarray  # of each first id
    within: np.ndarray  # by the class of the word before and the first id: log10 share of the id in its class
    embed: np.ndarray
    wq: np.ndarray
    wk: np.ndarray
    wv: np.ndarray
    near: np.ndarray  # bias by distance, 0 to 2 BLOCK - 1
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    end: int

    def weights(self) -> list[np.ndarray]:
        return [getattr(self, f) for f in WEIGHTS]


#: Fields that training changes.
WEIGHTS = ("embed", "wq", "wk", "wv", "near", "w1", "b1", "w2", "b2")


def classes_of(counts: np.ndarray, alone: int, bands: int) -> np.ndarray:
    """Each id's class: the most frequent alone, the others in bands of like mass."""
    order = np.argsort(-counts, kind="stable")
    out = np.empty(len(counts), np.int64)
    out[order[:alone]] = np.arange(min(alone, len(order)))
    rest = order[alone:]
    mass = np.cumsum(counts[rest] + UNSEEN)
    if len(rest):
        out[rest] = alone + np.minimum((mass / mass[-1] * bands).astype(np.int64), bands - 1)
    return out


def ranks_of(counts: np.ndarray) -> np.ndarray:
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return rank


def fresh(pairs: np.ndarray, last: np.ndarray, class_of: np.ndarray, opens: np.ndarray, end: int, seed: int = 11) -> Attention:
    """Untrained; pairs counts first ids by the class of the word before them, last
    counts words' last ids.  Ids that open no word have no share."""
    n = len(class_of)
    counts = np.where(opens, pairs.sum(axis=0) + UNSEEN, 0.0)
    mass = np.bincount(class_of, counts, CLASSES)
    share = counts / np.maximum(mass, 1e-30)[class_of]
    within = np.empty((CLASSES, n), np.float32)
    with np.errstate(divide="ignore"):
        for c in range(CLASSES):
            within[c] = np.log10((pairs[c] + PRIOR * share) / (np.bincount(class_of, pairs[c], CLASSES) + PRIOR)[class_of])
    rank, rank_last = ranks_of(counts), ranks_of(last)
    own_first = np.where(rank < OWN_INPUTS, rank, OWN_INPUTS + class_of)
    own_last = OWN_INPUTS + CLASSES + np.minimum(rank_last, OWN_INPUTS)
    rng = np.random.default_rng(seed)
    f = lambda scale, *s: rng.normal(0, scale, s).astype(np.float32)
    return Attention(
        own_first, own_last, class_of, within, f(0.35, 2 * OWN_INPUTS + CLASSES + 1, WIDTH), f(0.25, WIDTH, WIDTH), f(0.25, WIDTH, WIDTH), f(0.25, WIDTH, WIDTH),
        np.zeros(2 * BLOCK, np.float32), f(0.2, 2 * WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32), f(0.1, HIDDEN, CLASSES),
        np.log((mass + UNSEEN) / (mass + UNSEEN).sum()).astype(np.float32), end,
    )


_I, _J = np.arange(BLOCK)[:, None], np.arange(2 * BLOCK)[None, :]
#: How far back each key of a window is from each query; negative: still to come.
DISTANCE = _I + BLOCK - _J
_HIDDEN_KEY = np.float32(-1e9)

Sequence = tuple[np.ndarray, np.ndarray]  # a text's words: first ids and last ids, the end token's included


def _rows_added(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """(n, width): the sums of the values by row."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    out = np.zeros((n, values.shape[1]), np.float32)
    out[rows[begins]] = np.add.reduceat(values[order], begins, axis=0)
    return out


def gradients(net: Attention, first: np.ndarray, last: np.ndarray, start: np.ndarray, begin: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss of the windows that start at the given places, and its gradients.

    first and last are ids in a row, -1 where there is none; start is where what
    stands before a block's first token is, begin where its text's opening end id is,
    a whole number of blocks before.
    """
    key_at = start[:, None] + np.arange(-BLOCK, BLOCK)
    key_at = np.where((key_at < begin[:, None]) | (first[key_at] < 0), begin[:, None], key_at)
    targets = first[start[:, None] + 1 + np.arange(BLOCK)]
    rows = [own[ids[key_at]].reshape(-1, 2, BLOCK) for own, ids in ((net.own_first, first), (net.own_last, last))]
    y = np.where(targets < 0, -1, net.class_of[np.maximum(targets, 0)])
    return run_gradients(net, *rows, (start == begin)[:, None], y[:, None])


def run_gradients(net: Attention, row_f: np.ndarray, row_l: np.ndarray, opens: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The same of runs of blocks, (runs, blocks, BLOCK).

    row_f and row_l are the rows of ``embed`` of what stands before each token, of one
    block more, which each run's first one follows; opens tells the blocks that open a
    text, y the tokens' classes, -1 where there is no token, at a text's end.
    """
    runs, blocks = opens.shape
    flat = lambda m: m.reshape(-1, m.shape[-1])
    wide = lambda m: m.reshape(runs, blocks + 1, BLOCK, -1)
    windows = lambda m: np.concatenate([m[:, :-1], m[:, 1:]], axis=2)

    def single(d: np.ndarray) -> np.ndarray:
        """Sums by block of what two windows have of it."""
        out = np.zeros((runs, blocks + 1, BLOCK, d.shape[-1]), np.float32)
        out[:, 1:] = d[:, :, BLOCK:]
        out[:, :-1] += d[:, :, :BLOCK]
        return out

    y = y.ravel()
    live = y >= 0
    e = net.embed[row_f] + net.embed[row_l]
    eq = np.ascontiguousarray(e[:, 1:])
    q = (flat(eq) @ (net.wq / np.float32(WIDTH**0.5))).reshape(eq.shape)
    k, v = windows(wide(flat(e) @ net.wk)), windows(wide(flat(e) @ net.wv))
    s = q @ k.swapaxes(2, 3)
    np.minimum(s, 60, out=s)  # as in scoring: so that no sum of exponentials leaves the range of floats
    s += np.where(DISTANCE >= 0, net.near[np.maximum(DISTANCE, 0)], _HIDDEN_KEY).astype(np.float32)
    s[opens, :, :BLOCK] = _HIDDEN_KEY
    p = np.exp(s, out=s)
    p /= p.sum(axis=3, keepdims=True)
    both = np.concatenate([flat(eq), flat(p @ v)], axis=1)
    h = both @ net.w1
    h += net.b1
    np.maximum(h, 0, out=h)
    z = h @ net.w2
    z += net.b2
    np.minimum(z, 80, out=z)
    np.maximum(z, -80, out=z)
    d = np.exp(z, out=z)
    at = np.arange(len(d))
    y = np.maximum(y, 0)
    n = max(int(live.sum()), 1)
    mass = d @ np.ones(CLASSES, np.float32)
    loss = -float((np.log(np.maximum(d[at, y] / mass, 1e-30)) * live).sum()) / n
    weight = live.astype(np.float32) / np.float32(n)
    d *= (weight / mass)[:, None]
    d[at, y] -= weight
    g_w2, g_b2 = h.T @ d, np.ones(len(d), np.float32) @ d
    dh = d @ net.w2.T
    dh *= h > 0
    g_w1, g_b1 = both.T @ dh, np.ones(len(dh), np.float32) @ dh
    dboth = dh @ net.w1.T
    da = np.ascontiguousarray(dboth[:, WIDTH:]).reshape(eq.shape)
    dv = single(p.swapaxes(2, 3) @ da)
    ds = da @ v.swapaxes(2, 3)
    ds -= (ds * p).sum(axis=3, keepdims=True)
    ds *= p
    g_near = np.bincount(np.maximum(DISTANCE, 0).ravel(), (ds.sum(axis=(0, 1)) * (DISTANCE >= 0)).ravel(), 2 * BLOCK).astype(np.float32)
    dq, dk = flat(ds @ k) / np.float32(WIDTH**0.5), single(ds.swapaxes(2, 3) @ q)
    g_wq, g_wk, g_wv = flat(eq).T @ dq, flat(e).T @ flat(dk), flat(e).T @ flat(dv)
    de = wide(flat(dk) @ net.wk.T + flat(dv) @ net.wv.T)
    de[:, 1:] += (dq @ net.wq.T + dboth[:, :WIDTH]).reshape(eq.shape)
    de = flat(de)
    g_embed = _rows_added(np.concatenate([row_f.ravel(), row_l.ravel()]), np.concatenate([de, de]), len(net.embed))
    return loss, [g_embed, g_wq, g_wk, g_wv, g_near, g_w1, g_b1, g_w2, g_b2]


def fit(net: Attention, texts: list[Sequence], steps: int | None = STEPS, seed: int = 13, most: float = 0.01) -> Attention:
    """Trains the weights on random runs of the texts' blocks; without a number of steps, on
    each block once."""
    if not texts:
        return net
    rng = np.random.default_rng(seed)
    sizes = np.array([len(t[0]) for t in texts])
    blocks = -(-sizes // BLOCK)
    before = np.cumsum(blocks) - blocks
    total = -(-int(blocks.sum()) // RUN) * RUN
    places = np.arange(sizes.sum()) + np.repeat(before * BLOCK - np.cumsum(sizes) + sizes, sizes)

    def rows_of(own: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """(1 + blocks, BLOCK): rows of what stands before each token, one block first that nobody sees."""
        out = np.full((total + 1) * BLOCK + 1, own[net.end], np.int16)
        out[BLOCK + 1 + places] = own[ids]
        out[(before + 1) * BLOCK] = own[net.end]  # an end before each text opens it
        return out[:-1].reshape(-1, BLOCK)

    first = np.concatenate([t[0] for t in texts])
    row_f, row_l = rows_of(net.own_first, first), rows_of(net.own_last, np.concatenate([t[1] for t in texts]))
    y = np.full(total * BLOCK, -1, np.int16)
    y[places] = net.class_of[first]
    y = y.reshape(-1, BLOCK)
    opens = np.ones(total, bool)
    opens[: blocks.sum()] = False
    opens[before] = True
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    if steps is None:
        steps = -(-total // BATCH)
        picks = iter(np.array_split(rng.permutation(total // RUN), steps))
    else:
        picks = (rng.integers(total // RUN, size=BATCH // RUN) for _ in range(steps))
    for step, pick in enumerate(picks, 1):
        at = pick[:, None] * RUN + np.arange(RUN + 1)
        _, grads = run_gradients(net, row_f[at], row_l[at], opens[at[:, :-1]], y[at[:, :-1]])
        rate = most * min(1, step / 30) * (1 - 0.95 * step / steps)
        for w, g, (m, u) in zip(net.weights(), grads, moments):
            m += 0.1 * (g - m)
            u += 0.01 * (g * g - u)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    """Scores texts in blocks; the layers are tables by distinct word."""

    def __init__(self, net: Attention):
        self.net = net
        bias = net.near[np.maximum(DISTANCE, 0)]
        self.bias = np.where(DISTANCE >= 0, bias, _HIDDEN_KEY).astype(np.float32)

    def text_scores(self, words: Words, first: np.ndarray, last: np.ndarray, batch: int = 128) -> np.ndarray:
        """log10 probability of the first ids of each text's tokens."""
        net, counts, n = self.net, words.counts, len(words.counts)
        e = net.embed[net.own_first[first]] + net.embed[net.own_last[last]]
        query, key, value = e @ (net.wq / np.float32(WIDTH**0.5)), e @ net.wk, e @ net.wv
        direct = e @ net.w1[:WIDTH] + net.b1
        kind = net.class_of[first]
        blocks = -(-counts // BLOCK)
        before = np.cumsum(blocks) - blocks
        text = np.repeat(np.arange(n), blocks)
        opening = np.zeros(len(text), bool)
        opening[before] = True
        at = np.full((len(text) + 1) * BLOCK, -1, np.int64)  # tokens in blocks of their texts
        text_of = np.repeat(np.arange(n), counts)
        at[before[text_of] * BLOCK + np.arange(len(words.tokens)) - (np.cumsum(counts) - counts)[text_of]] = words.tokens
        given = np.empty_like(at)  # the token before each
        given[1:] = at[:-1]
        given[before * BLOCK] = 0  # the end token
        given = np.maximum(given, 0)[: len(text) * BLOCK].reshape(-1, BLOCK)
        target = at[: len(text) * BLOCK].reshape(-1, BLOCK)
        total = np.zeros(n)
        for a in range(0, len(text), batch):
            b = min(a + batch, len(text))
            own = given[a:b]
            seen = np.concatenate([given[max(a - 1, 0) : max(a, 1)], own])  # each block after the one before it
            k, v = (np.concatenate([m[:-1], m[1:]], axis=1) for m in (key[seen], value[seen]))
            s = query[own] @ k.transpose(0, 2, 1)
            np.minimum(s, 60, out=s)
            s += self.bias
            s[opening[a:b], :, :BLOCK] = _HIDDEN_KEY  # nothing stands before a text's first block
            np.exp(s, out=s)
            att = s @ v
            att /= (s @ np.ones(2 * BLOCK, np.float32))[:, :, None]
            h = att.reshape(-1, WIDTH) @ net.w1[WIDTH:]
            h += direct[own.ravel()]
            np.maximum(h, 0, out=h)
            z = h @ net.w2
            z += net.b2
            np.minimum(z, 80, out=z)
            np.maximum(z, -80, out=z)  # so that no sum of exponentials leaves the range of floats
            goal = target[a:b].ravel()
            live = goal >= 0
            goal = np.maximum(goal, 0)
            got = z[np.arange(len(z)), kind[goal]]
            np.exp(z, out=z)
            log = (got - np.log(z @ np.ones(CLASSES, np.float32))) / np.float32(np.log(10)) + net.within[kind[own.ravel()], first[goal]]
            total += np.bincount(np.repeat(text[a:b], BLOCK), np.where(live, log, 0), n)
        return total


# -- the corpus ----------------------------------------------------------------


@dataclass
class Spells:
    """What a word's ids after the first tell: counts by first id, shares after the id before."""

    tokens: np.ndarray  # of each first id: training tokens that begin so
    kinds: np.ndarray  # distinct ones of them
    class_of: np.ndarray
    after: np.ndarray  # by the class of an id and the id: share of the id after it in a word
    pairs: np.ndarray  # the frequent pairs, id * ids + next id, ascending
    times: np.ndarray  # how often
    sums: np.ndarray  # of each id: pairs that it begins, all and distinct ones
    different: np.ndarray
    end: int
    whole: bool = True  # all pairs are frequent ones

    def share(self, prev: np.ndarray, then: np.ndarray) -> np.ndarray:
        """Of an id after another: its class's share, interpolated with the pair's count."""
        out = self.after[self.class_of[prev], then].astype(np.float64)
        n = 0
        if len(self.pairs):
            item = prev * len(self.class_of) + then
            at = np.minimum(np.searchsorted(self.pairs, item), len(self.pairs) - 1)
            n = np.where(self.pairs[at] == item, self.times[at], 0)
        some = self.different[prev]
        return (n + some * out + (some == 0) * out) / (self.sums[prev] + some + (some == 0))

    def beyond(self, spelling: Spelling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, pair, mass) of the pairs that aren't frequent ones: what ``of`` takes a count
        of none for, and what the class gives the pair, in counts.  With a count of n the
        word's ``own`` is log10(1 + n / mass) larger."""
        prev, then, word = spelling.steps(self.end)
        item = prev * len(self.class_of) + then
        at = np.minimum(np.searchsorted(self.pairs, item), max(len(self.pairs) - 1, 0))
        some = (self.different[prev] > 0) & ((self.pairs[at] != item) if len(self.pairs) else True)
        prev, then = prev[some], then[some]
        return word[some], item[some], self.different[prev] * self.after[self.class_of[prev], then].astype(np.float64)

    def of(self, spelling: Spelling) -> tuple[np.ndarray, np.ndarray]:
        """(own, below) of each distinct word: log10 of the mass that its spelling alone
        gives it, and of the mass of all words with its first id.  With a count of n
        its probability, given the first id, is (n + own) / below."""
        prev, then, word = spelling.steps(self.end)
        spelled = np.bincount(word, np.log10(self.share(prev, then)), len(spelling.lengths))
        first = spelling.first
        kinds = np.maximum(self.kinds[first], 1)
        return np.log10(kinds) + spelled, np.log10(self.tokens[first] + kinds)


def word_logs(n: np.ndarray, own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.where(n > 0, np.log10(n + 10.0**own), own) - below


def _cut(values: np.ndarray, lengths: np.ndarray, kind: type) -> pa.Array:
    """Runs of the values as binary cells."""
    ends = np.append(0, np.cumsum(lengths)) * np.dtype(kind).itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values.astype(kind))]).cast(pa.binary())


def _cell_type(ids: int) -> type:
    return np.uint16 if ids <= 1 << 16 else np.uint32


def scan_corpus(docs: DataFrame, key: str, text: str, ranks: str) -> DataFrame:
    """(kind, item, first, n, a, b).  Kind 0 counts words by hash, with their first ids
    and, in a, all their ids; kind 1 counts pairs of first ids of neighbours, as
    id * ids + next id; kind 2 has the texts' words as sequences of first (a) and last
    (b) ids, item being a hash of the row and n the sequence's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(ranks)
        size, end = subwords.size, subwords.end
        small = _cell_type(size)
        held: tuple[list, list] = ([], [])

        def out(kind: int, item, first, n, a=None, b=None) -> pa.RecordBatch:
            rows = len(item)
            cells = [pa.array(np.full(rows, kind, np.int32)), pa.array(item), pa.array(first, pa.int32()), pa.array(n, pa.int64())]
            return pa.RecordBatch.from_arrays([*cells, *(pa.nulls(rows, pa.binary()) if x is None else x for x in (a, b))], names=["kind", "item", "first", "n", "a", "b"])

        def flush(kind: int) -> pa.RecordBatch:
            all_items = np.concatenate([h[0] for h in held[kind]])
            which, items = pd.factorize(all_items)
            n = np.bincount(which, np.concatenate([h[1] for h in held[kind]]), len(items)).astype(np.int64)
            first, spelled = np.zeros(len(items), np.int32), None
            if kind == 0:
                place = np.empty(len(items), np.int64)
                place[which] = np.arange(len(all_items))
                first = np.concatenate([h[2] for h in held[0]])[place]
                spelled = pa.concat_arrays([h[3] for h in held[0]]).take(pa.array(place))
            held[kind].clear()
            return out(kind, items.astype(np.uint64).view(np.int64), first, n, spelled)

        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            rows = batch.column(1).to_numpy()
            for i, j in chunks(offsets, CHUNK_BYTES):
                words = words_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                spelling = Spelling.of(words, subwords)
                first, last = spelling.first, spelling.last
                held[0].append((words.hashes, np.bincount(words.tokens, minlength=len(words.hashes)), first, _cut(spelling.ids, spelling.lengths, small)))
                firsts, lasts = first[words.tokens], last[words.tokens]
                # each text ends with the end token, which so stands before the next
                which, pairs = pd.factorize(np.concatenate([[end], firsts[:-1]]) * size + firsts)
                held[1].append((pairs, np.bincount(which, minlength=len(pairs))))
                parts = -(-words.counts // SEQUENCE)
                number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                lengths = np.minimum(np.repeat(words.counts, parts) - number * SEQUENCE, SEQUENCE)
                yield out(2, np.repeat(rows[i:j], parts), np.zeros(len(number), np.int32), number, _cut(firsts, lengths, small), _cut(lasts, lengths, small))
                for kind in (0, 1):
                    if sum(len(h[0]) for h in held[kind]) > HELD_WORDS:
                        yield flush(kind)
        for kind in (0, 1):
            if held[kind]:
                yield flush(kind)

    rows = docs.select(F.col(text).cast("string").alias("text"), F.xxhash64(key, text).alias("row"))
    return rows.mapInArrow(lean(run), "kind int, item long, first int, n long, a binary, b binary")


def spelled_pairs(words: DataFrame, end: int, size: int) -> DataFrame:
    """(item, n): pairs of ids, as id * ids + next id, inside the distinct words of a column
    of ids; the end id follows a word's last."""
    small = _cell_type(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def flush() -> pa.RecordBatch:
            which, items = pd.factorize(np.concatenate([h for h, _ in held]))
            n = np.bincount(which, np.concatenate([n for _, n in held]), len(items)).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(items), pa.array(n)], names=["item", "n"])

        for batch in batches:
            cells = batch.column(0).to_pylist()
            lengths = np.array([len(c) for c in cells], np.int64) // np.dtype(small).itemsize
            ids = np.frombuffer(b"".join(cells), small).astype(np.int64)
            prev, then, _ = Spelling(np.append(end, ids), np.append(1, lengths)).steps(end)
            which, pairs = pd.factorize(prev * size + then)
            held.append((pairs, np.bincount(which, minlength=len(pairs))))
            if sum(len(h) for h, _ in held) > HELD_WORDS:
                yield flush()
        if held:
            yield flush()

    return words.mapInArrow(lean(run, None), "item long, n long").groupBy("item").agg(F.sum("n").alias("n"))


def inner_pairs(words: DataFrame, subwords: Subwords) -> DataFrame:
    """(item, n): the table of all pairs of ids inside words."""
    return written(spelled_pairs(words.where(F.col("first") != subwords.end).select("a"), subwords.end, subwords.size), "spelled")


def _by_class(both: DataFrame, class_of: np.ndarray, classes: int, size: int) -> np.ndarray:
    """(classes, ids): counts of ids by the class of the id before."""
    table = both.sparkSession.createDataFrame(pa.table({"before": np.arange(size), "class": class_of}))  # a row an id of the vocabulary file
    found = both.join(F.broadcast(table), "before").groupBy("class", "id").agg(F.sum("n").alias("n")).toArrow()  # at most classes * ids
    out = np.zeros((classes, size))
    out[found.column(0).to_numpy(), found.column(1).to_numpy()] = found.column(2).to_numpy()
    return out


def _totals(df: DataFrame, by: str, size: int, value: str = "n") -> np.ndarray:
    """Sums by id: at most as many rows as the vocabulary file has ids."""
    found = df.groupBy(by).agg(F.sum(value).alias("total")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def models_of(words: DataFrame, neighbours: DataFrame, subwords: Subwords, inner: DataFrame | None = None) -> tuple[Attention, Spells]:
    """An untrained network and the spelling of words, by counts over the corpus; inner is
    the table of pairs inside words, if it is there."""
    size, end = subwords.size, subwords.end
    split = lambda df: df.select(F.expr(f"CAST(item div {size} AS INT)").alias("before"), (F.col("item") % size).cast("int").alias("id"), "n")
    pairs = split(neighbours)
    class_of = classes_of(_totals(pairs, "id", size), ALONE, BANDS)
    table = inner_pairs(words, subwords) if inner is None else inner
    inside = split(table)
    last = _totals(inside.where(F.col("id") == end), "before", size)
    net = fresh(_by_class(pairs, class_of, CLASSES, size), last, class_of, subwords.opens, end)
    sums, different = _totals(inside, "before", size), _totals(inside.withColumn("one", F.lit(1)), "before", size, "one")
    spell_class = classes_of(sums, SPELL_ALONE, SPELL_BANDS)
    n = _by_class(inside, spell_class, SPELL_ALONE + SPELL_BANDS, size)
    share = n.sum(axis=0) + UNSEEN
    share /= share.sum()
    after = ((n + PRIOR * share) / (n.sum(axis=1, keepdims=True) + PRIOR)).astype(np.float32)
    items, times = frequent(table)
    items = items.view(np.int64)
    by_first = written(words.groupBy("first").agg(F.sum("n").alias("tokens"), F.count("*").alias("kinds")), "firsts")
    return net, Spells(
        _totals(by_first, "first", size, "tokens"), _totals(by_first, "first", size, "kinds"), spell_class, after, items, times,
        sums, different, end, len(items) == different.sum(),
    )


def fit_shards(net: Attention, scanned: DataFrame, shards: int) -> Attention:
    """Trains on each window of all training documents once: the shards, by a hash of
    the rows, from the same weights, which are then averaged by numbers of tokens."""
    sent = scanned.sparkSession.sparkContext.broadcast(net)
    small = _cell_type(len(net.class_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = replace(sent.value, **{f: getattr(sent.value, f).copy() for f in WEIGHTS})
        texts: list[Sequence] = []
        held = seen = 0
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.append((np.frombuffer(a, small), np.frombuffer(b, small)))
                held += len(texts[-1][0])
                if held >= HELD_TOKENS:
                    fit(own, texts, None, most=SHARD_RATE)
                    texts, held, seen = [], 0, seen + held
        if texts:
            fit(own, texts, None, most=SHARD_RATE)
            seen += held
        if seen:
            flat = np.concatenate([w.ravel() for w in own.weights()]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(flat))), pa.array(np.concatenate([[1.0], flat]) * seen)], names=["item", "n"])

    h = F.xxhash64("item", "n")
    texts = scanned.where("kind = 2").select("item", "n", "a", "b").repartition(shards, h).sortWithinPartitions("item", "n").select("a", "b")
    rows = texts.mapInArrow(lean(run), "item long, n double").groupBy("item").agg(F.sum("n").alias("n")).toArrow()  # a row a weight
    n = np.empty(len(rows))
    n[rows.column(0).to_numpy() + 1] = rows.column(1).to_numpy()
    flat, at, mean = (n[1:] / n[0]).astype(np.float32), 0, {}
    for f in WEIGHTS:
        shape = getattr(net, f).shape
        mean[f] = flat[at : at + math.prod(shape)].reshape(shape)
        at += math.prod(shape)
    return replace(net, **mean)


def frequent(words: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Items, ascending, and counts of all above a count that at most so many have."""
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = words.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()  # at most 16 for each doubling
    least, total = None, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        total += r["words"]
        if total > most:
            break
        least = r["level"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = words.where(level >= least).select("item", "n").toArrow()
    items, n = (table.column(c).to_numpy() for c in ("item", "n"))
    order = np.argsort(items.view(np.uint64))
    return items.view(np.uint64)[order], n[order]


def _sample(training: DataFrame, key: str, text: str, docs: int, subwords: Subwords) -> list[Sequence]:
    """A bounded number of documents, of each at most SAMPLE_CHARS characters in a row."""
    place = F.pmod(F.xxhash64(key), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    some = first_by_hash(training, key, docs).select(F.col(key), F.col(text).cast("string").alias("text")).where("text <> ''")
    crops = some.select(F.col("text").substr(place.cast("int"), F.lit(SAMPLE_CHARS)).alias("text")).orderBy(F.xxhash64("text")).toArrow().column(0)
    if not len(crops):
        return []
    words = words_of(*text_bytes(crops))
    spelling = Spelling.of(words, subwords)
    cuts = np.cumsum(words.counts)[:-1]
    return list(zip(np.split(spelling.first[words.tokens], cuts), np.split(spelling.last[words.tokens], cuts)))


@dataclass
class Model:
    """What scoring needs: the network, the spelling, and counts of the frequent words."""

    net: Attention
    spells: Spells
    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    vocabulary: int

    def __post_init__(self):
        #: Of the frequent words, once they were met: first and last id, own and mass.
        self.ids = np.full((2, len(self.hashes)), -1, np.int32)
        self.logs = np.zeros((2, len(self.hashes)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("ids", "logs")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.__post_init__()

    def spelled(self, words: Words, at: np.ndarray, subwords: Subwords) -> tuple:
        """First ids, last ids, own, mass of the distinct words, and (word, pair, mass) of the
        pairs that aren't frequent ones, None if all are; at is each word's place among the
        frequent ones, -1 without one."""
        met = (at >= 0) & (self.ids[0, at] >= 0) if len(self.hashes) else np.zeros(len(at), bool)
        met[0] = False  # the end token
        new = np.flatnonzero(~met)
        some = Spelling.of(Words(words.hashes[new], [words.strings[i - 1] for i in new[1:].tolist()], words.tokens, words.counts), subwords)
        ids, logs = np.empty((2, len(at)), np.int64), np.empty((2, len(at)))
        ids[:, new], logs[:, new] = (some.first, some.last), self.spells.of(some)
        ids[:, met], logs[:, met] = self.ids[:, at[met]], self.logs[:, at[met]]
        whole, beyond = np.ones(len(new), bool), None
        if not self.spells.whole:
            which, pair, mass = self.spells.beyond(some)
            whole[which] = False
            beyond = new[which], pair, mass
        keep = new[whole & (at[new] >= 0)]
        self.ids[:, at[keep]], self.logs[:, at[keep]] = ids[:, keep], logs[:, keep]
        return *ids, *logs, beyond

    def below(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.vocabulary + 1)))


def train(training: DataFrame, key: str, text: str, ranks: str, sample_docs: int = SAMPLE_DOCS) -> tuple[Model, DataFrame, DataFrame]:
    """The model of all rows, and the tables (item, n) of all its words and pairs of ids."""
    subwords = Subwords(ranks)
    scanned = written(scan_corpus(training, key, text, ranks), "scanned")
    counted = written(scanned.where("kind = 0").groupBy("item", "first", "a").agg(F.sum("n").alias("n")), "words")
    words = counted.select("item", "n")
    tokens, vocabulary = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    pairs = inner_pairs(counted, subwords)
    net, spells = models_of(counted, scanned.where("kind = 1").select("item", "n"), subwords, pairs)
    net = fit(net, _sample(training, key, text, sample_docs, subwords))
    if tokens:
        net = fit_shards(net, scanned, -(-tokens // SHARD_TOKENS))
    return Model(net, spells, *frequent(words), int(tokens), int(vocabulary)), words, pairs


def score(df: DataFrame, *, key: str = "doc_id", text: str = "text", ranks: str | None = None, folds: int = 5, fold: int = 1, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """A row for each document: key, held_out, n_tokens, n_known, train_tokens,
    base_score, score; learnt from documents outside the held-out fold.

    Null and empty texts are the end token alone; rows that repeat are scored each
    for itself; keys may be of any type; with no training document all words are
    unknown and the network is untrained; an empty table gives an empty table;
    other columns are dropped.
    """
    spark, ranks = df.sparkSession, ranks or rank_path()
    docs = narrow(df, key, text)
    kind = docs.schema[key].dataType.simpleString()
    model, words, pairs = train(docs.where(crc_mod(F.col(key), folds) != fold), key, text, ranks, sample_docs)
    sent, below = spark.sparkContext.broadcast(model), model.below()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        subwords, scorer = Subwords(ranks), Scorer(model.net)
        row = TaskContext.get().partitionId() << 33
        kinds = {"rare": pa.bool_(), "row": pa.int64(), "key": None, "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "item": pa.int64(), "n": pa.int64(), "own": pa.float64(), "below": pa.float64(), "chunk": pa.int64(), "pair": pa.int64(), "mass": pa.float64()}

        def out(rows: int, **columns) -> pa.RecordBatch:
            cells = [pa.nulls(rows, t) if c not in columns else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], t) for c, t in kinds.items()]
            return pa.RecordBatch.from_arrays(cells, names=list(kinds))

        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            kinds["key"] = batch.column(0).type
            for i, j in chunks(offsets, CHUNK_BYTES):
                words = words_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = j - i
                doc = np.repeat(np.arange(n), words.counts)
                at = np.minimum(np.searchsorted(model.hashes, words.hashes), max(len(model.hashes) - 1, 0))
                known = model.hashes[at] == words.hashes if len(model.hashes) else np.zeros(len(words.hashes), bool)
                first, last, own, mass, open_pairs = model.spelled(words, np.where(known, at, -1), subwords)
                if open_pairs is not None:
                    which, pair, share = open_pairs  # once a chunk, not once a text
                    known[which] = False  # by the join
                    yield out(len(pair), chunk=np.full(len(pair), row), item=words.hashes[which].view(np.int64), pair=pair, mass=share)
                times = np.where(known, model.counts[at], 0) if len(model.hashes) else np.zeros(len(words.hashes))
                base = np.where(known, np.log10(times + 0.5) - model.below(), 0.0)
                inside = np.where(known, word_logs(times, own, mass), 0.0)
                inside[0] = 0.0  # the end token is its first id
                rare = ~known[words.tokens]
                which, pair = pd.factorize(doc[rare] * len(words.hashes) + words.tokens[rare])
                if len(pair):
                    word = pair % len(words.hashes)
                    mine = np.where(word > 0, own[word], 0.0), np.where(word > 0, mass[word], np.nan)
                    yield out(
                        len(pair), rare=np.ones(len(pair), bool), row=row + pair // len(words.hashes), item=words.hashes[word].view(np.int64), n=np.bincount(which, minlength=len(pair)),
                        own=mine[0], below=pa.array(mine[1], pa.float64(), from_pandas=True), chunk=np.full(len(pair), row),
                    )
                yield out(
                    n, rare=np.zeros(n, bool), row=np.arange(row, row + n), key=batch.column(0).slice(i, n), n_tokens=words.counts,
                    n_known=np.bincount(doc, known[words.tokens], n).astype(np.int64), base=np.bincount(doc, base[words.tokens], n),
                    score=scorer.text_scores(words, first, last) + np.bincount(doc, inside[words.tokens], n),
                )
                row += n

    schema = f"rare boolean, row long, key {kind}, n_tokens long, n_known long, base double, score double, item long, n long, own double, below double, chunk long, pair long, mass double"
    both = written(docs.select(F.col(key), F.col(text).cast("string").alias(text)).mapInArrow(lean(run), schema), "scores")
    times, n = F.col("times"), F.coalesce("n", F.lit(0))
    rare = both.where("rare").select("row", "item", F.col("n").alias("times"), "own", "below", "chunk")
    if not model.spells.whole:
        spelled = both.where("rare IS NULL").select("chunk", "item", "pair", "mass").join(pairs.select(F.col("item").alias("pair"), "n"), "pair")
        more = spelled.groupBy("chunk", "item").agg(F.sum(F.log10(1 + F.col("n") / F.col("mass"))).alias("spelled"))
        rare = rare.join(more, ["chunk", "item"], "left").withColumn("own", F.col("own") + F.coalesce("spelled", F.lit(0.0)))
    rest = (
        rare.join(words, "item", "left")
        .groupBy("row").agg(
            F.sum(times * (F.log10(n + 0.5) - below)).alias("more"), F.sum(F.when(n > 0, times).otherwise(0)).alias("more_known"),
            # no mass below: the end token, which is its first id
            F.sum(F.when(F.col("below").isNotNull(), times * (F.when(n > 0, F.log10(n + F.pow(F.lit(10.0), "own"))).otherwise(F.col("own")) - F.col("below"))).otherwise(0.0)).alias("more_score"),
        )
    )
    return both.where("NOT rare").select("row", "key", "n_tokens", "n_known", "base", "score").join(rest, "row", "left").select(
        F.col("key").alias(key), (crc_mod(F.col("key"), folds) == fold).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
