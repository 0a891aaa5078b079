"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where tables go in a session that names no shared folder (tests, one machine).
LOCAL_WORK_DIR = "file:///tmp/checkpoints/webgrain"


#: Bytes of a batch that goes to a Python worker; texts make 10,000 rows far larger.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the session's Arrow batches, if they have Spark's own bound of 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == f"{64 << 20}b":
        spark.conf.set(name, str(BATCH_BYTES))


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, taken by exact name, the first of several alike.

    Other columns, whatever they are called (a second ``text``, a ``TEXT``, a
    ``score``), are dropped, so that they can't clash with computed ones.
    """
    bound_batches(df.sparkSession)
    at = [df.columns.index(n) for n in names]
    flat = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return flat.select(*(F.col(f"c{i}").alias(n) for i, n in zip(at, names)))


def work_dir(spark: SparkSession) -> str:
    """A new folder's path in the folder that the cluster shares."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or LOCAL_WORK_DIR
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Files of a table whose scale is known: one for so many rows, and so many at least.
FILE_ROWS, LEAST_FILES = 5_000, 16


def written(df: DataFrame, name: str, *, partition_by: str | None = None, rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder: computed once, safe from lost executors.

    With rows, about how many it has, few of them don't become many files: each file
    costs round trips, and on a local disk forks of the executor, which for a moment
    count as a second one.  Only for tables whose last step deals rows out evenly.
    """
    path = f"{work_dir(df.sparkSession)}-{name}"
    schema = df.schema
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS)))
    out = df.write.mode("overwrite")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


#: A table of more rows, or of more bytes, is joined by a shuffle, not broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def _row_bytes(schema) -> Column:
    """About what a row takes: its texts and arrays as they are, other cells 16 bytes."""
    total = F.lit(16)
    for f in schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            size = F.octet_length(c)
        elif kind.startswith(("array", "map", "struct")):
            size = F.octet_length(F.to_json(F.struct(c)))
        else:
            size = F.lit(0)
        total = total + F.coalesce(size, F.lit(0)) + 16
    return total.cast("long")


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for a broadcast if it has been measured to be small in rows and bytes."""
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(_row_bytes(df.schema)), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= most else df


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other letters kept: lower() does that for ASCII texts."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def first_by_hash(df: DataFrame, key: str, rows: int, *, by: str | None = None) -> DataFrame:
    """The first rows of df, in all or of each value of ``by``, in the order of a hash of the key.

    Rows are counted first, and only those whose hash falls in the share that holds
    about four times as many as are wanted go on to be sorted, so what meets in a
    task doesn't grow with the table.  At most ``rows`` rows, or ``rows`` of each value.
    """
    h = F.xxhash64(key)
    if by is None:
        n = df.select(key).count()
        some = df.where(F.pmod(h, F.lit(n)) < 4 * rows) if n > 4 * rows else df
        return some.orderBy(h, key).limit(rows)
    counts = df.groupBy(by).agg(F.count("*").alias("count_of")).withColumnRenamed(by, "value_of")
    some = df.join(sized(counts), F.col(by) == F.col("value_of")).where(F.pmod(h, F.col("count_of")) < 4 * rows)
    w = Window.partitionBy(by).orderBy(h, key)
    return some.withColumn("place_of", F.row_number().over(w)).where(F.col("place_of") <= rows).drop("value_of", "count_of", "place_of")


# -- Python workers ------------------------------------------------------------

#: Rows of a batch that are worked on at once.
ROWS_AT_ONCE = 1024


def give_back() -> None:
    """Returns freed memory to the system."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int | None = ROWS_AT_ONCE):
    """A function for mapInArrow that gets its rows in small batches and, when it ends,
    gives back what its worker has freed: idle workers keep little memory."""

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows or max(1, batch.num_rows)):
                yield batch.slice(at, rows)

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(small(batches))
        finally:
            give_back()

    return wrapped


# -- texts as bytes in numpy -------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that separate words where a word is [^\x20\x09-\x0D]+.
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(2024)).integers(0, 1 << 64, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets into them; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_utf8())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        at = np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most so many bytes together; a longer text is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def spans(raw: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and each text's number of words."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    word = ~sep[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end], the same wherever a word stands.

    Differences of a running polynomial over random byte values give all words'
    hashes in a few passes over the bytes.
    """
    n = len(raw)
    if len(_POWERS.get("up", ())) < n:
        for name, r in (("up", _R), ("down", _R_INV)):
            p = np.full(n, r, dtype=np.uint64)
            p[:1] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    run = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * _POWERS["up"][:n], out=run[1:])
    h = (run[ends] - run[starts]) * _POWERS["down"][starts]
    if n > 1 << 23:  # a very long text's powers aren't kept
        _POWERS.clear()
    return mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
