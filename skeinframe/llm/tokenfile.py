"""Token ids in binary blocks with Elias-Fano document boundaries.

A block holds the ids of consecutive documents in one array of 16- or 32-bit
little-endian integers. The documents' end offsets are Elias-Fano coded: l low
bits each, and the high parts in unary, 2 + log2(ids / documents) bits a document
in place of 64. The documents' own ids, ascending too, are coded in the same way. Every
SAMPLE-th set bit's place is kept, so that select() finds some documents' ends without
decoding the others. All offsets that read() and lookup() return come from select().

Blocks are rows of a Parquet data set, written through Spark's committer: a lost
or repeated task leaves no half-written or doubled block, and any store that
Spark writes to will do. `shard` and `block` give their order, `before` the ids of the same
shard that precede a block.

Layout of a payload (little-endian), fixed values:
  8 bytes  magic "SKNEF\\x02\\0\\0"
  u32 bits of an id, u32 documents n, u32 of them, the first ones, without an id, u64 ids u, i64 least document id
  twice, for the ends and for the document ids less the least one (of the n - m that have one), an Elias-Fano sequence:
    u32 low bits l, u32 bytes of the high part,
    ceil(n * l / 8) bytes  low parts;  the high part;  u32 per SAMPLE values  their set bits' places
  the ids
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinframe.llm import _common, bpe

MAGIC = b"SKNEF\x02\0\0"
HEAD, PART = struct.Struct("<8sIIIQq"), struct.Struct("<II")
SAMPLE = 64
#: A block ends with the document that brings it to this many ids.
BLOCK_IDS = 1 << 18


def to_bits(values: np.ndarray, width: int) -> bytes:
    """The values' low `width` bits, one after the other."""
    return np.packbits(((values[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


class EliasFano:
    """Ascending numbers from 0 on; nothing is decoded before it is asked for."""

    def __init__(self, data: memoryview, n: int):
        self.n = n
        self.low, high = PART.unpack_from(data)
        ends = np.cumsum([PART.size, (n * self.low + 7) // 8, high, 4 * -(-n // SAMPLE)]).tolist()
        self._low, self._high = (np.frombuffer(data[a:b], np.uint8) for a, b in zip(ends[:2], ends[1:3]))
        self._samples = np.frombuffer(data[ends[2] : ends[3]], "<u4")
        self.bytes = ends[3]

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n = len(values)
        low = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        places = (values >> low) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        high = np.packbits(high, bitorder="little").tobytes()
        return b"".join([PART.pack(low, len(high)), to_bits(values, low), high, places[::SAMPLE].astype("<u4").tobytes()])

    def select(self, index: np.ndarray) -> np.ndarray:
        """The numbers at ascending places. Of the high part only the runs from one sample to the next that hold them are read."""
        out = np.zeros(len(index), np.int64)
        run = index // SAMPLE
        edge = np.flatnonzero(np.diff(run, prepend=-1, append=-1)).tolist()
        for a, b in zip(edge[:-1], edge[1:]):
            k = int(run[a])
            begin = int(self._samples[k]) // 8
            end = int(self._samples[k + 1]) // 8 + 1 if k + 1 < len(self._samples) else len(self._high)
            bits = np.flatnonzero(np.unpackbits(self._high[begin:end], bitorder="little")) + 8 * begin
            bits = bits[bits >= self._samples[k]]
            out[a:b] = (bits[index[a:b] - k * SAMPLE] - index[a:b]) << self.low
        if self.low:
            at = index[:, None] * self.low + np.arange(self.low)
            out |= ((self._low[at >> 3] >> (at & 7)) & 1).astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))
        return out

    def rank(self, value: int) -> int:
        """How many numbers are below value: a search by select()."""
        a, b = 0, self.n
        while a < b:
            m = (a + b) // 2
            a, b = (m + 1, b) if self.select(np.array([m]))[0] < value else (a, m)
        return a


def encode(keys: list, ends: np.ndarray, ids: np.ndarray, id_bits: int) -> bytes:
    """keys: document ids, ascending, nulls first; ends: their end offsets, ascending, the last len(ids)."""
    named = np.array([k for k in keys if k is not None], np.int64)
    least = int(named[0]) if len(named) else 0
    head = HEAD.pack(MAGIC, id_bits, len(keys), len(keys) - len(named), len(ids), least)
    return b"".join([head, EliasFano.encode(ends), EliasFano.encode(named - least), ids.astype(f"<u{id_bits // 8}").tobytes()])


class Block:
    """A payload's parts."""

    def __init__(self, payload: bytes):
        magic, self.id_bits, self.n, self.nulls, self.u, self.least = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        view = memoryview(payload)
        self.ends = EliasFano(view[HEAD.size :], self.n)
        self.names = EliasFano(view[HEAD.size + self.ends.bytes :], self.n - self.nulls)
        self._ids = view[HEAD.size + self.ends.bytes + self.names.bytes :]

    def keys(self) -> list:
        return [None] * self.nulls + (self.names.select(np.arange(self.names.n)) + self.least).tolist()

    def bounds(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the documents at ascending places begin and end."""
        both = self.ends.select(np.unique(np.concatenate([index - 1, index]).clip(0)))
        at = {i: x for i, x in zip(np.unique(np.concatenate([index - 1, index]).clip(0)).tolist(), both.tolist())}
        return np.array([at[i - 1] if i else 0 for i in index.tolist()], np.int64), np.array([at[i] for i in index.tolist()], np.int64)

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        return np.frombuffer(self._ids, f"<u{self.id_bits // 8}")[start:end]

    def find(self, key: int) -> np.ndarray:
        """The places of the documents with an id."""
        if not self.names.n or key < self.least:
            return np.zeros(0, np.int64)
        return self.nulls + np.arange(self.names.rank(key - self.least), self.names.rank(key - self.least + 1))


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocab: str = bpe.VOCAB, end_id: int = 0, id_bits: int = 16, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all texts, each with end_id at its end, in ascending order of id_col (a bigint or narrower).

    id_bits: 16 if all ids are below 65536, else 32. The only shuffle deals out the texts by ranges of id_col.
    Cases: a null text counts as empty; null ids come first; rows with equal ids follow each other by their texts'
    hash;
    an empty table gives a data set without rows; other columns are ignored.
    """
    _common.prepare(docs.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, before, encoder = TaskContext.get().partitionId(), 0, 0, bpe.load(vocab)
        keys: list = []
        counts: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, before, held
            ids = np.concatenate(parts)
            if len(ids) and id_bits < 32 and ids.max() >> id_bits:
                raise ValueError(f"an id doesn't fit {id_bits} bits")
            payload = encode(keys, np.cumsum(np.concatenate(counts)), ids, id_bits)
            out = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "before": pa.array([before], pa.int64()), "n_docs": pa.array([len(keys)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "payload": pa.array([payload], pa.binary())})
            keys.clear(), counts.clear(), parts.clear()
            block, before, held = block + 1, before + len(ids), 0
            return out

        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, j, ids, n in encoder.column(batch.column(1)):
                ids, off = bpe.with_end(ids, n, end_id)
                while i < j:
                    k = min(j, i + 1 + int(np.searchsorted(off[1:], off[0] + block_ids - held)))
                    m = k - i
                    keys += names[i:k]
                    counts.append(np.diff(off[: m + 1]))
                    parts.append(ids[off[0] : off[m]])
                    held += int(off[m] - off[0])
                    off, i = off[m:], k
                    if held >= block_ids:
                        yield flush()
        if keys:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    # the text's hash orders rows that share an id, and lets them part
    rows = rows.repartitionByRange("k", F.xxhash64("t")).sortWithinPartitions("k", F.xxhash64("t"))
    rows.mapInArrow(blocks, "shard int, block int, before long, n_docs long, n_ids long, payload binary").write.mode("overwrite").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """A row per document from the files alone: the id, start (ids of all documents before it), n_tokens, ids_crc32.

    Shards follow each other in order; the first id of each comes from a sum over one row a shard.
    """
    _common.prepare(spark)
    blocks = spark.read.schema("shard int, block int, before long, n_docs long, n_ids long, payload binary").parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    starts = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"))
    starts = _common.settle(starts, "tokenfile-starts")  # a row a shard

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(payload.as_py())
                first, ends = block.bounds(np.arange(block.n))
                raw = memoryview(block.ids().astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block.keys(), pa.int64()), pa.array(first + base), pa.array(ends - first), pa.array(crc, pa.int64())], ["k", "start", "n_tokens", "ids_crc32"])

    joined = _common.attach(blocks.select("shard", "before", "payload"), starts, "shard", "inner").select((F.col("first") + F.col("before")).alias("base"), "payload")
    return joined.mapInArrow(documents, "k long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("k", id_col)


def lookup(spark: SparkSession, path: str, wanted: list[int], id_col: str = "doc_id") -> DataFrame:
    """The ids of some documents: id_col, ids (array). Blocks are searched by their coded document ids; only what is found is decoded.

    A document id that isn't there gives no row, a repeated one a row each time. An empty list gives no rows.
    """
    _common.prepare(spark)
    wanted = sorted(set(wanted))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                block = Block(payload.as_py())
                for key in wanted:
                    at = block.find(key)
                    if len(at):
                        ids = [block.ids(a, b).tolist() for a, b in zip(*block.bounds(at), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["k", "ids"])

    blocks = spark.read.schema("payload binary").parquet(path)
    return blocks.mapInArrow(searched, "k long, ids array<int>").withColumnRenamed("k", id_col)
