"""Helpers shared by the operators: shared tables, size-checked broadcasts, text buffers."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinframe.storage import forget, settle, shared_dir  # noqa: F401

#: Rows up to which an id set may be broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 1_000_000
#: Keys at most that count as heavy: those with more than 1 / MOST_HEAVY of the rows.
MOST_HEAVY = 2_000
#: Bytes of text handled by numpy at a time, unless a single text is longer.
CHUNK_BYTES = 1 << 20

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors' Python and bound Arrow batches. Call it before any Python stage."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="skeinframe-")
        path = os.path.join(folder, "skeinframe_src.zip")
        with zipfile.ZipFile(path, "w") as z:
            for top, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(top, name)
                        z.write(full, os.path.join("skeinframe", os.path.relpath(full, root)))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def release() -> None:
    """Give memory that this process has freed back to the system; allocators keep it else."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/skeinframe/{name}-{uuid.uuid4().hex}"


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df, a settled table, has at most limit rows."""
    return df.count() <= limit


def attach(df: DataFrame, side: DataFrame, on: str | list[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df joined with side, a settled table: by broadcast if it has at most limit rows, else by shuffle. Same result."""
    return df.join(F.broadcast(side) if few(side, limit) else side, on, how)


def meet(df: DataFrame, side: DataFrame, on: list[str], n: str, limit: int = BROADCAST_ROWS, how: str = "inner") -> DataFrame:
    """df joined with side, a settled table with a row a key, whose column n says how many rows of df have the key.

    A side of at most limit rows is broadcast. Of a larger one the keys with more than 1/MOST_HEAVY of all rows are, at most
    MOST_HEAVY of them, so that no key's rows gather in one task; the others meet by shuffle. Same result.
    """
    if few(side, limit):
        return df.join(F.broadcast(side.drop(n)), on, how)
    total = side.agg(F.sum(n)).first()[0] or 0
    heavy = F.broadcast(side.where(F.col(n) > total / MOST_HEAVY).drop(n))
    rest = df.join(heavy.select(*on), on, "left_anti").join(side.where(F.col(n) <= total / MOST_HEAVY).drop(n), on, how)
    return df.join(heavy, on).unionByName(rest)


def numbered(df: DataFrame, order: F.Column, name: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with each row's place from 0 in the order: by a window over all rows if they are few, else by ranges and counts of them."""
    df = settle(df, "numbered")
    if few(df, limit):
        return df.withColumn(name, F.row_number().over(Window.orderBy(order)) - 1)
    part = fresh(df, "__part")
    ranges = settle(df.repartitionByRange(order).withColumn(part, F.spark_partition_id()), "ranges")
    before = F.sum("count").over(Window.orderBy(part)) - F.col("count")
    offsets = ranges.groupBy(part).count().select(part, before.alias("__before"))
    place = F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1
    return ranges.withColumn(name, place).join(F.broadcast(offsets), part).withColumn(name, F.col(name) + F.col("__before")).drop(part, "__before")


def keep_one(docs: DataFrame, decided: DataFrame, id_col: str, key: F.Column) -> DataFrame:
    """docs, all columns, without the rows that decided drops.

    decided has a row (id, key, kept) for every row of docs that is dropped or may be a repeated one; key tells texts apart,
    as the expression `key` over docs does. Rows meet by id and key, null ids being equal. A row goes if no row of its id and
    key is kept. Of several rows with an id and key that are kept one stays; if their other columns differ, any one.
    """
    per = settle(decided.groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(F.max("kept").alias("__kept"), F.count("*").alias("__n")).where("not __kept or __n > 1"), "decided")
    near = few(per)

    def matched(rows: DataFrame, side: DataFrame, how: str) -> DataFrame:
        k, i, x = fresh(rows, "__k_key"), fresh(rows, "__k_id"), rows.columns
        side = side.select(F.col("__id").alias(i), F.col("__key").alias(k))
        same = rows[id_col].eqNullSafe(F.col(i)) & (key == F.col(k))
        return rows.join(F.broadcast(side) if near else side, same, how).select([rows[f"`{c}`"] for c in x])

    left = matched(docs, per.where("not __kept"), "left_anti")
    twice = per.where("__kept")
    if not twice.take(1):
        return left
    by = [fresh(docs, "__one_id"), fresh(docs, "__one_key")]
    once = matched(left, twice, "left_semi").withColumns({by[0]: F.col(f"`{id_col}`"), by[1]: key}).dropDuplicates(by).drop(*by)
    return matched(left, twice, "left_anti").union(once)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` in lower-cased UTF-8.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) of runs of rows with about `most` bytes at most. Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_BYTE_KEYS = mix(np.arange(1, 257, dtype=_U64) * _U64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = [np.ones(1, _U64), np.ones(1, _U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and their inverses, mod 2^64."""
    if len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, _U64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=_U64)
    return _powers[0][:n], _powers[1][:n]


class Spans:
    """64-bit hashes of any spans of a sequence of 64-bit keys, from prefix sums."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        p, self.inverse = powers(n + 1)
        self.prefix = np.zeros(n + 1, _U64)
        np.cumsum(keys * p[:n], out=self.prefix[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])


def lowered(buf: np.ndarray) -> np.ndarray:
    return LOWER[buf]


def byte_spans(low: np.ndarray) -> Spans:
    return Spans(_BYTE_KEYS[low])


def word_bounds(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes, and per text the index of its first word (one longer than the texts)."""
    n = len(low)
    is_word = IS_WORD[low]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    first, last = is_word.copy(), is_word.copy()
    if n:
        first[1:] &= ~is_word[:-1] | cut[1:n]
        last[:-1] &= ~is_word[1:] | cut[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_hash(word: str) -> int:
    """The hash that byte_spans gives to a word."""
    b = np.frombuffer(word.encode(), np.uint8)
    return int(byte_spans(b).hash(np.array([0]), np.array([len(b)]))[0])
