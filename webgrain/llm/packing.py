"""Hierarchical multi-length packing of tokenised documents.

Documents are cut into windows of the largest context and a rest.  The rest is
routed to the tier of the smallest context size that holds it.  Each tier is packed
into windows of its own size, long ones first: what its own piece leaves of a window
is filled from the shorter tiers, best fit first, and what no whole piece can fill
takes the first part of one, whose remainder goes back to the tier that now holds it.
So windows of all sizes are full, but for one at a task's end, which is padded to the
largest size unless its length is a power of two.

A task packs the rows of its own partition in pools of bounded size and hands what
fills no window on to its next pool, so no text is shuffled and memory doesn't grow
with the input.  Windows are then numbered over the whole table, size by size, from
their counts by task, and dealt to step groups in turn: two groups differ by one
window of each size at most.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, narrow, sized, written

#: Context sizes, ascending powers of two.
TIERS = (128, 256, 512, 1024)
#: Rests of this many tokens are packed together.
POOL_TOKENS = 1 << 18
STEP_GROUPS = 8
END_ID = 0
_SPECIAL = "<|endoftext|>"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as the tokenizers library gives them for the JSON file.

    The same vocabulary's rank file goes through a faster library, which agrees
    on texts of common letters; other texts, and those with the special token's
    string, go through the JSON file itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None):
        import base64
        import re

        import tiktoken
        from public_tokenizers import PATTERN

        self.json_path = json_path
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path or json_path.removesuffix("json") + "tiktoken", "rb"))}
        self.fast = tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.common = re.compile("[\\x00-\\x84\\x86-\\u024f\\u0370-\\u0377\\u0391-\\u03a1\\u03b1-\\u03c9\\u0410-\\u044f\\u2010-\\u2027\\u20ac]*")
        self.run = re.compile(r"\S{400}|\s{400}")  # one piece this long is slow there

    @functools.cached_property
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def __call__(self, text: str) -> np.ndarray:
        if self.common.fullmatch(text) and _SPECIAL not in text and not self.run.search(text):
            return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


class Pool:
    """Rests by length, for the longest that fits a gap."""

    def __init__(self, pieces: list[tuple]):
        self.by = defaultdict(list)
        for p in pieces:
            self.by[len(p[2])].append(p)
        self.lengths = sorted(self.by)

    def add(self, piece: tuple) -> None:
        n = len(piece[2])
        if not self.by.get(n):
            bisect.insort(self.lengths, n)
        self.by[n].append(piece)

    def take(self, most: int) -> tuple | None:
        """The longest of at most so many tokens."""
        k = bisect.bisect_right(self.lengths, most) - 1
        return self._pop(k) if k >= 0 else None

    def shortest(self) -> tuple | None:
        return self._pop(0) if self.lengths else None

    def _pop(self, k: int) -> tuple:
        n = self.lengths[k]
        piece = self.by[n].pop()
        if not self.by[n]:
            del self.by[n], self.lengths[k]
        return piece


def tier_of(n: int, tiers: tuple[int, ...] = TIERS) -> int:
    return next(t for t in tiers if n <= t)


Piece = tuple[tuple, int, np.ndarray]  # row, start, ids


def pack_pool(pieces: list[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """(windows, left): full windows as (size, pieces), and the pieces that fill none,
    which are fewer tokens than the largest size.  No piece is longer than that."""
    pools = {t: Pool([]) for t in tiers}
    for p in pieces:
        pools[tier_of(len(p[2]), tiers)].add(p)
    windows = []
    for k in range(len(tiers) - 1, -1, -1):  # when a size is done, its tier is empty
        size, at_most = tiers[k], tiers[: k + 1]
        while (first := pools[size].take(size)) is not None:
            window, gap = [first], size - len(first[2])
            while gap:
                piece = next((p for t in reversed(at_most) if (p := pools[t].take(gap))), None)
                if piece is None:  # nothing whole fits: cut the shortest that is left
                    piece = next((p for t in at_most if (p := pools[t].shortest())), None)
                    if piece is None:
                        return windows, window
                    row, start, ids = piece
                    pools[tier_of(len(ids) - gap, tiers)].add((row, start + gap, ids[gap:]))
                    piece = (row, start, ids[:gap])
                window.append(piece)
                gap -= len(piece[2])
            windows.append((size, window))
    return windows, []


def pieces_of(source: DataFrame, key: str, text: str, path: str, tiers: tuple[int, ...], pool_tokens: int, with_ids: bool) -> DataFrame:
    """A row for each piece, with its window's number among its task's windows of that size."""
    kind = source.schema[key].dataType.simpleString()
    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, offset long, sequence_tokens long, tier int, task long, number long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.replace(f"key {kind}", "key").split(", ")]
    most = tiers[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        task = TaskContext.get().partitionId()
        made = dict.fromkeys(tiers, 0)
        ready: list[tuple[int, list[Piece]]] = []
        pool: list[Piece] = []
        held, types = 0, None

        def out(found: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in names]
            for size, window in found:
                used, offset = sum(len(p[2]) for p in window), 0
                for (k, n), start, ids in window:
                    cells = (k, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, offset, used, size, task, made[size], *([ids.astype(np.int32)] if with_ids else []))
                    for c, x in zip(cols, cells):
                        c.append(x)
                    offset += len(ids)
                made[size] += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for batch in batches:
            types = [batch.column(0).type, *[pa.int64()] * 6, pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(t or ""), np.uint32(END_ID))
                n = len(ids)
                whole = n // most * most
                ready += [(most, [((k, n), s, ids[s : s + most])]) for s in range(0, whole, most)]
                if n > whole:
                    pool.append(((k, n), whole, ids[whole:].copy()))
                    held += n - whole
                if held >= pool_tokens:
                    full, pool = pack_pool(pool, tiers)
                    ready += full
                    held = sum(len(p[2]) for p in pool)
                if len(ready) >= 2048:
                    yield out(ready)
                    ready = []
        full, pool = pack_pool(pool, tiers)
        ready += full + ([(most, pool)] if pool else [])
        if ready:
            yield out(ready)

    return source.select(F.col(key), F.col(text).cast("string").alias(text)).mapInArrow(lean(run), schema)


def pack(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str | None = None,
    tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS, step_groups: int = STEP_GROUPS, with_ids: bool = False,
) -> DataFrame:
    """A row for each piece of each document.

    Columns: key, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_tokens, padding, tier (the window's size), step_group; with ``with_ids``
    the piece's ids.  Each row that is read is one document, repeated ones too, with a
    key of any type; null and empty texts are the end id alone; a text of any length
    is cut; an empty table gives an empty table; other columns are dropped.
    sequence_id holds the task's number in its upper half, so ids are unique.  Tables
    read in other parts are packed otherwise, with the same pieces of long documents.
    """
    pieces = written(pieces_of(narrow(df, key, text), key, text, tokenizer or tokenizer_path(), tiers, pool_tokens, with_ids), "pieces")
    counts = pieces.groupBy("task", "tier").agg((F.max("number") + 1).alias("windows"))  # a row a task and size
    before = lambda *by: F.coalesce(F.sum("windows").over(Window.partitionBy(by[0]).orderBy(by[1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select(F.col("task").alias("of_task"), F.col("tier").alias("of_tier"), before("tier", "task").alias("table_before"), before("task", "tier").alias("task_before"))
    n, used = F.col("number"), F.col("sequence_tokens")
    return pieces.join(sized(placed), (F.col("task") == F.col("of_task")) & (F.col("tier") == F.col("of_tier"))).select(
        F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", (F.shiftleft("task", 32) + F.col("task_before") + n).alias("sequence_id"), "offset", "sequence_tokens",
        F.when(used.bitwiseAND(used - 1) == 0, 0).otherwise(tiers[-1] - used).cast("long").alias("padding"), "tier",
        ((F.col("table_before") + n) % step_groups).cast("int").alias("step_group"), *(["ids"] if with_ids else []),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
