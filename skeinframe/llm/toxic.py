"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and the words' beginnings of 4 to 8 bytes (A-Z in
lower case), hashed; a term that comes 2 or 4 times or more is a term of its own
besides. learn() gives every term a weight and a small vector: a score adds the
weights and the products of all pairs' vectors, so that two terms together may say
what neither says alone. No term is chosen beforehand: all have part in all rounds,
by dual averaging, which leaves at zero what gradients don't move more than chance.
Weights are learned first and vectors after them, from what the weights leave
unexplained: a pair part that weights had to make up for would grow with the square
of a text's terms, and long texts' scores without bound.

Only a sample of labelled rows reaches the driver, bounded in rows and in bytes.
Scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinframe.llm import _common

BITS = 20
PREFIXES = (4, 5, 6, 8)
#: Counts from which a repeated term is a further term.
LEVELS = (1, 2, 4)
#: Labelled rows of each label that are learned from, at most: those with the smallest hash of the id; and bytes of their terms.
SAMPLE, SAMPLE_BYTES = 2_000, 14 << 20
FACTORS, BATCH = 3, 64
#: Rounds over the sample for the weights, and those for the vectors after them.
EPOCHS, EPOCHS_FACTORS = 5, 10
#: Step sizes of weights and vectors; standard errors that their gradients' sums must pass; the size of the vectors' first values.
RATE, RATE_FACTORS, SURE, SURE_FACTORS, START = 0.5, 0.1, 4.0, 4.5, 0.003
#: Documents' worth of chance that every term has beforehand, and the part of the labels' log odds that the bias ends with.
FEW, PRIOR = 5, 0.5


def terms(buf: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of the texts, repeats included, and where each text's begin (one longer than the texts)."""
    low = _common.lowered(buf)
    start, end, first = _common.word_bounds(low, off)
    spans = _common.byte_spans(low)
    salts = [np.uint64(0x632BE59BD9B4E019 * (k + 1) % (1 << 64)) for k in range(len(PREFIXES) + 1)]
    columns = [_common.mix(spans.hash(start, stop) ^ salt) >> np.uint64(64 - bits) for stop, salt in zip([end, *(np.minimum(end, start + p) for p in PREFIXES)], salts, strict=True)]
    return np.stack(columns, axis=1).ravel().astype(np.int64), first * len(columns)


@dataclass
class Machine:
    bits: int
    terms: np.ndarray  # in order: level * 2^bits + hash of those whose weight or vector isn't zero
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def __post_init__(self):
        self.place = np.full(len(LEVELS) << self.bits, -1, np.int32)
        self.place[self.terms] = np.arange(len(self.terms))

    def __reduce__(self):
        return Machine, (self.bits, self.terms, self.bias, self.weight, self.factor)

    def margins(self, index: np.ndarray, first: np.ndarray) -> np.ndarray:
        """first: one longer than the texts; index: places of distinct terms."""
        n = len(first) - 1
        text = np.repeat(np.arange(n), np.diff(first))
        out = self.bias + np.bincount(text, self.weight[index], n)
        for f in range(self.factor.shape[1]):
            v = self.factor[index, f]
            out += 0.5 * (np.bincount(text, v, n) ** 2 - np.bincount(text, v * v, n))
        return out

    def kept(self, hashed: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of each text's distinct terms, and where they begin."""
        text, width = np.repeat(np.arange(len(first) - 1), np.diff(first)), max(len(self.terms), 1)
        pairs = []
        for level, least in enumerate(LEVELS):
            index = self.place[hashed + (level << self.bits)]
            some = index >= 0
            pair, count = np.unique(text[some] * width + index[some], return_counts=True)
            pairs.append(pair[count >= least])
        pair = np.sort(np.concatenate(pairs))
        return pair % width, np.searchsorted(pair, np.arange(len(first)) * width)

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*self.kept(*terms(buf, off, self.bits))), -30, 30)))


def levelled(hashed: np.ndarray, bits: int = BITS) -> np.ndarray:
    """A text's distinct terms, those for repeats among them: level * 2^bits + hash."""
    distinct, counts = np.unique(hashed, return_counts=True)
    return np.concatenate([distinct[counts >= least] + (level << bits) for level, least in enumerate(LEVELS)])


def learn(texts: list[np.ndarray], labels: np.ndarray, bits: int = BITS, seed: int = 7) -> Machine:
    """texts: each one's terms, of levelled(). Without texts of both labels, the score is the share of label 1."""
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return Machine(bits, np.zeros(0, np.int64), 30.0 if share else -30.0, np.zeros(0), np.zeros((0, FACTORS)))
    # terms that no text of the sample has would keep a weight of zero
    flat, first = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    there = np.zeros(len(LEVELS) << bits, bool)
    there[flat] = True
    names = np.flatnonzero(there)
    place = np.zeros(len(LEVELS) << bits, np.int32)
    place[names] = np.arange(len(names))
    flat = place[flat]
    rng = np.random.default_rng(seed)
    bias, bias_square = 0.0, 1.0
    start = rng.normal(0, START, (len(names), FACTORS)).astype(np.float32)
    # both labels weigh alike
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    # sums of gradients, and of the squares that a document's has by chance, whatever its label: what a term's own
    # documents have would be too small where all of them are of the frequent label, and too large where of the rare one
    unexplained = float((balance * balance).mean()) / 4
    beforehand = FEW * unexplained
    g_weight, q_weight = np.zeros(len(names), np.float32), np.full(len(names), beforehand, np.float32)
    batches, order = [], rng.permutation(len(texts))
    for s in range(0, len(order), BATCH):
        part = order[s : s + BATCH]
        size = first[part + 1] - first[part]
        begin = np.append(0, np.cumsum(size))
        used, at = np.unique(np.concatenate([flat[first[i] : first[i + 1]] for i in part]), return_inverse=True)
        at = at.astype(np.int32)
        by_term = np.argsort(at, kind="stable").astype(np.int32)
        text = np.repeat(np.arange(len(part), dtype=np.int16), size)[by_term]
        batches.append((part, begin, used.astype(np.int32), at, text, np.flatnonzero(np.diff(at[by_term], prepend=-1))))
    del flat

    def moved(g: np.ndarray, q: np.ndarray, rate: float, sure: float) -> np.ndarray:
        """Dual averaging: against the sum of gradients, less what chance gives it; epochs repeat the same chance."""
        root = np.sqrt(q)
        return -rate * np.sign(g) * np.maximum(np.abs(g) / root - sure, 0)

    def summed(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
        out, some = np.zeros((len(begin) - 1, *values.shape[1:]), np.float32), begin[1:] > begin[:-1]
        out[some] = np.add.reduceat(values, begin[:-1][some], axis=0)
        return out

    def slopes(part: np.ndarray, margin: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]).astype(np.float32) * balance[part]

    for epoch in range(EPOCHS):
        for b in rng.permutation(len(batches)).tolist():
            part, begin, used, at, text, runs = batches[b]
            if not len(used):
                continue
            w = moved(g_weight[used], q_weight[used], RATE, SURE * (1 + epoch) ** 0.5)
            g = slopes(part, bias + summed(w[at], begin))
            g_weight[used] += np.add.reduceat(g[text], runs)
            q_weight[used] += float((g * g).mean()) * np.diff(runs, append=len(text))
            bias_square += float(g.sum()) ** 2
            bias -= 0.1 * float(g.sum()) / np.sqrt(bias_square)
    weight = moved(g_weight, q_weight, RATE, SURE * EPOCHS**0.5)
    del g_weight, q_weight
    g_factor, q_factor = np.zeros((len(names), FACTORS), np.float32), np.full((len(names), FACTORS), beforehand * START**2, np.float32)
    for _ in range(EPOCHS_FACTORS):
        for b in rng.permutation(len(batches)).tolist():
            part, begin, used, at, text, runs = batches[b]
            if not len(used):
                continue
            v = start[used] + moved(g_factor[used], q_factor[used], RATE_FACTORS, SURE_FACTORS)
            sums, squares = summed(v[at], begin), summed((v * v).sum(axis=1)[at], begin)
            g = slopes(part, bias + summed(weight[used][at], begin) + 0.5 * ((sums * sums).sum(axis=1) - squares))
            g_factor[used] += np.add.reduceat((g[:, None] * sums)[text], runs, axis=0) - np.add.reduceat(g[text], runs)[:, None] * v
            # chance is that of documents that nothing explains: by what the weights leave of them, it would shrink to
            # nothing where they explain all, and any rest move the vectors
            q_factor[used] += unexplained * np.add.reduceat((sums * sums)[text], runs, axis=0)
    factor = moved(g_factor, q_factor, RATE_FACTORS, SURE_FACTORS)
    bias += PRIOR * float(np.log(share / (1 - share)))
    some = (weight != 0) | (factor != 0).any(axis=1)
    return Machine(bits, names[some].astype(np.int64), bias, weight[some].astype(float), factor[some].astype(float))


def remainder(id_col: F.Column, by: int) -> F.Column:
    """crc32 of the id as text, modulo `by`."""
    return F.crc32(id_col.cast("string").cast("binary")) % by


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, most: int = SAMPLE_BYTES, folds: int = 5, seed: int = 7) -> Machine:
    """Learn from at most `sample` rows of each label and `most` bytes of terms, none of them with crc32(id as text) mod folds = 0.

    Cases: rows of labels with a null id, or another label than 0 or 1, aren't learned from; an id with both labels counts as 1;
    of rows of docs that share an id one is learned from, the one whose terms are smallest as bytes; null texts are empty ones.
    Without texts of both labels every score is 0, or 1 if all labels are. Empty tables are such a case.
    """
    _common.prepare(docs.sparkSession)
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (remainder(F.col("id"), folds) != 0))
    # one label an id: the larger, if rows differ
    named = named.groupBy("id").agg(F.max("y").alias("y"))
    parts = [named.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    chosen = _common.settle(parts[0].unionByName(parts[1]), "toxic-sample")  # 2 * sample rows at most

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in _common.text_chunks(batch.column(1)):
                hashed, first = terms(buf, off)
                rows = [levelled(hashed[a:b]).astype("<i4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in (0, 2)), pa.array(rows, pa.binary())], ["id", "y", "terms"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), "id").select("id", "t", "y")
    kind = docs.schema[id_col].dataType.simpleString()
    # an id that many rows repeat counts once: its smallest row of terms
    found = rows.mapInArrow(extracted, f"id {kind}, y int, terms binary").groupBy("id", "y").agg(F.min("terms").alias("terms"))
    found = _common.settle(found, "toxic-terms")  # 2 * sample rows at most
    # of each label as many whole texts, in the order of the hash, as make half of the bytes; one at least
    line = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id")
    sizes = found.select("id", "y", F.octet_length("terms").alias("n")).withColumn("before", F.sum("n").over(line) - F.col("n"))
    fitting = sizes.where((F.col("before") + F.col("n") <= most // 2) | (F.col("before") == 0)).select("id", "y")
    got = found.join(F.broadcast(fitting), ["id", "y"]).orderBy(F.xxhash64("id"), "id").select("y", "terms").toArrow()
    texts = [np.frombuffer(t.as_buffer(), "<i4") for t in got.column("terms")]  # views, not copies
    machine = learn(texts, got.column("y").to_numpy().astype(int), seed=seed)
    del texts, got
    _common.release()  # the pipeline's later stages share this process's limit
    return machine


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """A row per document: the id, held_out (crc32(id as text) mod folds = 0), score, predicted (score >= 0.5).

    Cases: null and empty texts get the score of a text without terms; a null id is held out of nothing; repeated rows score
    alike; an empty table gives no rows; other columns are ignored.
    """
    _common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in _common.text_chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(shared.value.scores(buf, off))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(scored, f"id {kind}, score double")
    held = F.coalesce(remainder(F.col("id"), folds) == 0, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """docs, all columns, without those whose score is 0.5 or more.

    Every row is judged by its own text, whatever its id: rows with a null or repeated id are like others, and repeated rows
    stay or go together. Null and empty texts get the score of a text without terms. An empty table gives no rows.
    """
    _common.prepare(docs.sparkSession)
    shared, at, names = docs.sparkSession.sparkContext.broadcast(machine), docs.columns.index(text_col), docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in _common.text_chunks(batch.column(at).cast(pa.string())):
                yield batch.slice(i, j - i).filter(pa.array(shared.value.scores(buf, off) < 0.5))

    return docs.select([F.col(f"`{c}`") for c in names]).mapInArrow(clean, docs.schema)
