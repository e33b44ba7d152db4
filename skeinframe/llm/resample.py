"""Target-distribution importance resampling over hashed word n-grams, by sorted streams of buckets.

1. Each text's features are its runs of one to three words; a feature's bucket is the CRC-32 of its words, joined by blanks,
   modulo BUCKETS. CRC-32 is linear, so a run's value comes from its words' values and lengths: words are read once.
2. The buckets are written, packed as uint16, in streams of a few texts with the texts' offsets into them.
3. Counts: each stream is sorted and run-length encoded; a task adds up its streams' runs and hands on BUCKETS sums at most.
4. Gains of the BUCKETS buckets, from the counts in the corpus and in the target, are broadcast; the streams are read once
   more, and np.add.reduceat over the gathered gains gives the texts' weights.
5. Gumbel noise, a function of seed and id, turns the weights' order into draws without replacement; ranks are distributed
   over ranges of the score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinframe.llm import _common
from skeinframe.operators.order import numbered

BUCKETS, LONGEST_RUN = 10_000, 3
#: Least words of a text that may be drawn, and the share of such texts that is, in hundredths.
LEAST_WORDS, PERCENT = 20, 5
SEED = 42
#: Words up to this many bytes have their CRC-32 taken together, a byte at a time; longer ones by zlib.
SHORT = 48

U = np.uint32
_STEP = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], U)  # CRC-32 is linear: zero's entry is 0


def _step(crc: np.ndarray, byte) -> np.ndarray:
    """The value after one more byte."""
    inner = crc ^ U(0xFFFFFFFF)
    return (_STEP[(inner ^ byte) & U(0xFF)] ^ (inner >> U(8))) ^ U(0xFFFFFFFF)


def _advances() -> np.ndarray:
    """Of each power of two, up to 2^31 bytes: what each byte of a value becomes when so many zero bytes follow, 4 x 256 a power."""
    one = np.zeros((4, 256), U)
    for k in range(4):
        x = np.arange(256, dtype=U) << U(8 * k)
        one[k] = _STEP[x & U(0xFF)] ^ (x >> U(8))
    tables = [one]
    for _ in range(31):
        last = tables[-1]
        tables.append(np.stack([_through(last, last[k]) for k in range(4)]))
    return np.stack(tables)


def _through(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & U(0xFF)] ^ table[1][(x >> U(8)) & U(0xFF)] ^ table[2][(x >> U(16)) & U(0xFF)] ^ table[3][x >> U(24)]


_ADVANCE = _advances()


def joined(crc: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of strings from those of their beginnings, and of their ends, which have so many bytes."""
    out = crc.copy()
    for bit in range(int(length.max()).bit_length() if len(length) else 0):
        some = np.flatnonzero((length >> bit) & 1)
        out[some] = _through(_ADVANCE[bit], out[some])
    return out ^ other


def word_values(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each word."""
    crc, length = np.zeros(len(start), U), end - start
    for at in np.flatnonzero(length > SHORT).tolist():
        crc[at] = zlib.crc32(low[start[at] : end[at]])
    left = np.flatnonzero(length <= SHORT)
    for k in range(SHORT):
        left = left[length[left] > k]
        if not len(left):
            break
        crc[left] = _step(crc[left], low[start[left] + k])
    return crc


def buckets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: all their features' buckets, text by text; where a text's begin (one longer than the texts); each text's words."""
    low = _common.lowered(buf)
    start, end, first = _common.word_bounds(low, off)
    n, length = np.diff(first), end - start
    one = word_values(low, start, end)
    text = np.repeat(np.arange(len(n)), n)
    parts, owners, last = [one], [text], one
    for run in range(1, LONGEST_RUN):
        # runs that begin at a word and stay in its text
        at = np.arange(len(one) - run)
        at = at[text[at] == text[at + run]] if len(one) > run else np.zeros(0, np.int64)
        # the shorter runs that begin at a word, by the word
        longer = np.zeros(len(one), U)
        longer[at] = joined(_step(last[at], U(32)), one[at + run], length[at + run])
        parts.append(longer[at])
        owners.append(text[at])
        last = longer
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    stream = (np.concatenate(parts)[order] % U(BUCKETS)).astype(np.uint16)
    offsets = np.zeros(len(n) + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=len(n)), out=offsets[1:])
    return stream, offsets, n


def streams(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The texts' packed streams, settled: ids, words, offsets (a list each, offsets one longer), stream (uint16, little-endian)."""
    _common.prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    as_list = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in _common.text_chunks(batch.column(1)):
                stream, offsets, words = buckets(buf, off)
                ids = batch.column(0).slice(i, j - i)
                yield pa.RecordBatch.from_arrays([as_list(ids), as_list(pa.array(words)), as_list(pa.array(offsets)), pa.array([stream.astype("<u2").tobytes()], pa.binary())], ["ids", "words", "offsets", "stream"])

    return _common.settle(rows.mapInArrow(packed, f"ids array<{kind}>, words array<long>, offsets array<long>, stream binary"), "resample-streams")


def counts(packed: DataFrame) -> np.ndarray:
    """Features in each bucket, of streams(): a task's runs are added up in it, and only its sums move."""

    def run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for data in batch.column(0):
                values = np.sort(np.frombuffer(data.as_buffer(), "<u2"))
                first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
                total[values[first]] += np.diff(np.append(first, len(values)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in packed.select("stream").mapInArrow(run_lengths, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the buckets' smoothed shares in the target over those in the source, floors."""
    s, t = source.astype(float), target.astype(float)
    big_s, big_t = float(source.sum()), float(target.sum())
    ratio = (t + 1) * (big_s + BUCKETS) / ((s + 1) * (big_t + BUCKETS))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weights(packed: DataFrame, gain: np.ndarray, id_col: str) -> DataFrame:
    """A row per text: the id, words, n_features, weight."""
    held = packed.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers
    kind = packed.schema["ids"].dataType.elementType.simpleString()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, words, offsets = (batch.column(c)[k].values for c in range(3))
                at = offsets.to_numpy()
                n, values = np.diff(at), held.value[np.frombuffer(batch.column(3)[k].as_buffer(), "<u2")]
                weight, some = np.zeros(len(n), np.int64), np.flatnonzero(n)
                if len(some):
                    weight[some] = np.add.reduceat(values, at[:-1][some])
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(n), pa.array(weight)], [id_col, "words", "n_features", "weight"])

    return packed.mapInArrow(gathered, f"`{id_col}` {kind}, words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """A row per document: the id, n_features, weight, score, rank.

    Of the documents with at least `least_words` words, floor(percent * their number / 100) with the highest scores are drawn;
    rank is their place from 1, ties going to the smaller id (a null one is the smallest; rows that share id and score come in any
    order). Others have rank null. Null and empty texts have no features and weight 0; the noise of a null id is that of an empty
    one, repeated rows have equal scores, and each counts. An empty table gives no rows; an empty target leaves the gains that its
    smoothed counts give. Other columns are ignored.
    """
    packed, aim = streams(docs, id_col, text_col), streams(target.select(F.lit(0).alias("id"), F.col(f"`{target_text}`").alias("text")), "id", "text")
    gain = gains(counts(packed), counts(aim))
    noise = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    scored = weights(packed, gain, id_col).withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(noise))))
    scored = _common.settle(scored, "resample-scores")
    long_enough = F.col("words") >= least_words
    drawn = percent * scored.where(long_enough).count() // 100
    placed = numbered(scored.where(long_enough), [F.col("score").desc(), F.col(f"`{id_col}`").asc()], "rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    out = placed.unionByName(scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long")))
    _common.forget(packed, aim)
    return out.select(id_col, "n_features", "weight", "score", "rank")
