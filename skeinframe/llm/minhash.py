"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

1. A text's words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` once A-Z is in lower case; its shingles are five
   consecutive words (all its words if it has fewer). Weights are tf * idf with idf = ln(1 + documents / df). Document
   frequencies come from a count sketch of one row and 2^40 counters: tasks add up their texts' shingles by the first 40 bits
   of their hashes and only counters that aren't zero are moved, four bytes each. A counter is too high by the shingles that
   share it, shingles / 2^40 on average, which is 1e-6 of FLOOR or less for texts of up to 1,000 words, however many they are.
   Shingles in FLOOR of the documents or less, or in one, weigh most and alike, so that a group of copies up to that share
   of the table doesn't weigh its members' edits above the text that they share. The others, at most (shingles a document) /
   FLOOR, are looked up in a broadcast table of about 4 bytes each.
2. Each text gets `bands` x `rows` consistent weighted samples; two texts agree in one with probability equal to their
   weighted Jaccard similarity. A band's samples are a bucket.
3. Texts with the same shingles become one node, whatever their ids. The others' buckets name candidates. Each is first
   verified against the smallest of its bucket; then, for buckets that still hold several components, all pairs across
   components are, in blocks. So every candidate pair is verified or already connected, without a row per pair.
4. Classes are the connected components of pairs with weighted Jaccard similarity >= threshold.
5. Copies mustn't make their own text look common. With `by_class`, as in the query and near_dedup, df is counted once more, over
   one document of each class that the first round found: texts with a shingle that weighs more by it are sampled anew, and
   candidates of different components are verified with the new weights. Weighted similarity alone decides in both rounds.

A pair at weighted similarity 0.8 is missed by all 14 bands of 3 with probability 4e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinframe.llm import _common
from skeinframe.llm._common import mix
from skeinframe.llm.components import components

U = np.uint64
SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 14, 3
#: Share of the documents up to which all shingles weigh alike: no text common to fewer counts as a commonplace.
FLOOR = 1e-3
#: Bits of the counters' numbers; counters summed together, about; shingles that a task holds before it adds them up.
SLOT_BITS, PART, HELD = 40, 1 << 19, 1 << 20
#: Texts compared with each other at a time, and members of a bucket dealt to a task.
BLOCK, DEALT = 256, 128
TABLE_BITS = 16
#: Entries of the idf table that are looked through one by one: 2^LOAD_BITS on average at most.
LOAD_BITS = 2


def shingles(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its distinct shingles' hashes in order, their counts, and where a text's begin (one longer than the texts)."""
    low = _common.lowered(buf)
    start, end, first = _common.word_bounds(low, off)
    words = _common.byte_spans(low).hash(start, end)
    n = np.diff(first)
    each = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    text = np.repeat(np.arange(len(n)), each)
    upto = np.zeros(len(n) + 1, np.int64)
    np.cumsum(each, out=upto[1:])
    at = np.arange(upto[-1]) + (first[:-1] - upto[:-1])[text]
    hashes = _common.Spans(words).hash(at, np.minimum(at + size, first[1:][text]))
    for begin, end in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        hashes[begin:end].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    place = np.flatnonzero(new)
    return hashes[place], np.diff(np.append(place, len(hashes))), np.searchsorted(place, upto)


class Idf:
    """ln of the idf of shingles: of those in the table by their df, to 1/254 of its logarithm's range, of others the largest.

    The table is sorted by the first bits of the hashes: `loads` says how many entries share these, `tags` tells them apart by
    16 further bits, and a level stands for a df between floor (1) and documents (255).
    """

    def __init__(self, documents: int, floor: float, bits: int, loads: np.ndarray, tags: np.ndarray, levels: np.ndarray):
        self.bits, self.loads, self.tags, self.levels = bits, loads, tags, levels
        df = floor * (max(documents, 1) / floor) ** (np.arange(-1, 255) / 254)
        df[0] = floor
        self.logs = np.log(np.log1p(documents / df)).astype(np.float32) if documents else np.zeros(256, np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "starts"}

    def __setstate__(self, state):
        self.__dict__ = state
        self.starts = np.zeros(len(self.loads) + 1, np.int32)
        np.cumsum(self.loads, out=self.starts[1:])

    @staticmethod
    def tag(slots: np.ndarray, bits: int) -> np.ndarray:
        """The 16 bits after the first `bits`, zeros beyond the last."""
        shift = SLOT_BITS - bits - 16
        return (slots >> U(shift) if shift >= 0 else slots << U(-shift)).astype(np.uint16)

    @staticmethod
    def level(df: np.ndarray, documents: int, floor: float) -> np.ndarray:
        return (1 + np.rint(254 * np.log(df / floor) / max(np.log(max(documents, 1) / floor), 1e-9))).clip(1, 255).astype(np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        level = np.zeros(len(hashes), np.uint8)
        if len(self.tags) and len(hashes):
            slots = hashes >> U(64 - SLOT_BITS)
            at, tag = (slots >> U(SLOT_BITS - self.bits)).astype(np.int64), self.tag(slots, self.bits)
            load, start = self.loads[at], self.starts[at]
            left = np.flatnonzero(load)
            j = 0
            while len(left):
                place = start[left] + j
                hit = self.tags[place] == tag[left]
                level[left[hit]] = self.levels[place[hit]]
                j += 1
                left = left[~hit & (load[left] > j)]
        return self.logs[level]


class Sampler:
    """Improved consistent weighted sampling; a shingle's random numbers come from tables that its hash picks from."""

    def __init__(self, samples: int, seed: int):
        rng = np.random.default_rng(seed)
        n = 1 << TABLE_BITS
        self.r = rng.gamma(2, 1, n).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2, 1, n)).astype(np.float32)
        self.beta = rng.random(n).astype(np.float32)
        self.keys = rng.integers(1, 1 << 63, samples, dtype=np.uint64) | U(1)

    def __call__(self, hashes: np.ndarray, ln_w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A 64-bit sample per text and key; texts without shingles get 0. first: as of shingles()."""
        sizes = np.diff(first)
        some = np.flatnonzero(sizes)
        out = np.zeros((len(sizes), len(self.keys)), U)
        if not len(some):
            return out
        begin, sizes = first[:-1][some], sizes[some]
        owner = np.repeat(np.arange(len(some)), sizes)
        mask = (1 << TABLE_BITS) - 1
        for k, key in enumerate(self.keys):
            z = hashes * key
            r = self.r[(z >> U(64 - TABLE_BITS)).astype(np.int32)]
            c = self.ln_c[(z >> U(32)).astype(np.int32) & mask]
            b = self.beta[(z >> U(16)).astype(np.int32) & mask]
            t = np.floor(ln_w / r + b)
            a = c - r * (t - b + np.float32(1))
            least = np.minimum.reduceat(a, begin)
            at = np.flatnonzero(a == np.repeat(least, sizes))[::-1]
            pick = np.zeros(len(some), np.int64)
            pick[owner[at]] = at  # the first of equal ones
            out[some, k] = mix(hashes[pick] + t[pick].astype(np.int64).astype(U) * U(0x9E3779B97F4A7C15))
        return out


def similarity(a: tuple[np.ndarray, np.ndarray, float], b: tuple[np.ndarray, np.ndarray, float], threshold: float) -> bool:
    """Whether the weighted Jaccard similarity of two texts (hashes in order, weights, sum of weights) is at least threshold."""
    x, y, threshold = a[2], b[2], threshold * (1 - 1e-9)
    if min(x, y) < threshold * max(x, y):
        return False
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    least = float(np.minimum(a[1][same], b[1][at[same]]).sum(dtype=np.float64))
    return least >= threshold * (x + y - least)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, float]:
    n = len(data) // 12
    w = np.frombuffer(data, np.float32, n, 8 * n)
    return np.frombuffer(data, U, n), w, float(w.sum(dtype=np.float64))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows with equal keys, over sorted batches."""
    from itertools import chain, groupby

    rows = chain.from_iterable(batch.to_pylist() for batch in (part for b in batches for part in (b.slice(i, 64) for i in range(0, b.num_rows, 64))))
    return groupby(rows, lambda row: tuple(row[k] for k in keys))


def added_up(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with the sums of their counts."""
    if not len(values):
        return values, counts
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[first], np.add.reduceat(counts, first)


PARTS = "part int, ones binary, slots binary, counts binary"


def counters(texts: DataFrame, size: int, bits: int, sign: int = 1) -> DataFrame:
    """Of texts (t, n: how often each counts) the sketch's counters, in pieces: PARTS. part: a counter's first `bits` bits."""
    low = SLOT_BITS - bits

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            slots = np.concatenate([h for h, _ in held]) >> U(64 - SLOT_BITS)
            slots, counts = added_up(slots, np.concatenate([c for _, c in held]))
            held.clear()
            edge = np.searchsorted(slots, np.arange((1 << bits) + 1, dtype=np.uint64) << U(low))
            slots = (slots & U((1 << low) - 1)).astype("<u4")
            one, rows = counts == 1, []
            for part in np.flatnonzero(np.diff(edge)).tolist():
                s, c, x = (v[edge[part] : edge[part + 1]] for v in (slots, counts, one))
                rows.append((part, s[x].tobytes(), s[~x].tobytes(), c[~x].astype("<i8").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "ones", "slots", "counts"])

        for batch in batches:
            often = batch.column(1).to_numpy().astype(np.int64)
            for i, j, buf, off in _common.text_chunks(batch.column(0)):
                hashes, _, first = shingles(buf, off, size)
                if len(hashes):
                    held.append((hashes, np.repeat(often[i:j], np.diff(first))))
                if sum(len(h) for h, _ in held) >= HELD:
                    yield flush()
        if held:
            yield flush()
        pa.default_memory_pool().release_unused()

    return texts.select("t", F.col("n").cast("long")).mapInArrow(added, PARTS).withColumn("sign", F.lit(sign))


def frequencies(pieces: DataFrame, least: float) -> DataFrame:
    """The sums of pieces' counters by part, less those of sign -1; only counters above `least`. Settled: PARTS, n (their number)."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), rows in grouped(batches, ["part"]):
            values, counts = [], []
            for row in rows:
                ones, slots, more = (np.frombuffer(row[k], t) for k, t in (("ones", "<u4"), ("slots", "<u4"), ("counts", "<i8")))
                values += [ones, slots]
                counts += [np.full(len(ones), row["sign"], np.int64), more * row["sign"]]
            values, counts = added_up(np.concatenate(values), np.concatenate(counts))
            keep = counts > least
            if keep.any():
                columns = [[part], [b""], [values[keep].tobytes()], [counts[keep].tobytes()], [int(keep.sum())]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["part", "ones", "slots", "counts", "n"])

    return _common.settle(pieces.repartition("part").sortWithinPartitions("part").mapInArrow(summed, f"{PARTS}, n long"), "minhash-df")


def idf_table(df: DataFrame, documents: int, floor: float, bits: int) -> Idf:
    """The table of frequencies() as broadcast: it is put in order on the executors, and the driver joins its parts."""
    entries = df.agg(F.sum("n")).first()[0] or 0
    top = min(max(bits, int(np.ceil(np.log2(max(entries, 1)))) - LOAD_BITS), 31)
    local = top - bits

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, slots, counts in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                slots, counts = np.frombuffer(slots, "<u4").astype(np.uint64), np.frombuffer(counts, "<i8")
                loads = np.bincount((slots >> U(SLOT_BITS - top)).astype(np.int64), minlength=1 << local)
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((part, loads.astype("<u2").tobytes(), Idf.tag(slots, top).tobytes(), Idf.level(counts, documents, floor).tobytes()), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "loads", "tags", "levels"])

    got = df.select("part", "slots", "counts").mapInArrow(sliced, "part int, loads binary, tags binary, levels binary").toArrow().sort_by("part")
    loads, data = np.zeros((1 << bits, 1 << local), np.uint16), None
    for part, data in zip(got.column("part").to_pylist(), got.column("loads"), strict=True):
        loads[part] = np.frombuffer(data.as_buffer(), "<u2")
    tags, levels = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in got.column(name))]) for name, kind in (("tags", np.uint16), ("levels", np.uint8)))
    del got, data
    pa.default_memory_pool().release_unused()
    return Idf(documents, floor, top, loads.ravel(), tags, levels)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, floor: float = FLOOR, seed: int = 5, by_class: bool = False) -> DataFrame:
    """A row per document, settled: id, h (the text's xxhash64), class_id, class_size, kept (of each class one row is)."""
    spark = docs.sparkSession
    _common.prepare(spark)
    whole = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    total, bytes_ = whole.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    bits = int(min(max(np.ceil(np.log2(max((bytes_ or 0) / 6 / PART, 1))), 8), 20))
    least = max(floor * total, 1.0)
    df = frequencies(counters(whole.select("t", F.lit(1).alias("n")), size, bits), least)
    idf = spark.sparkContext.broadcast(idf_table(df, total, least, bits))
    band = np.arange(1, bands + 1, dtype=U)

    def bucketed(sampler: Sampler, hashes: np.ndarray, ln_w: np.ndarray, first: np.ndarray) -> pa.Array:
        """Of each text its bands' buckets."""
        samples = sampler(hashes, ln_w, first).reshape(-1, bands, rows)
        buckets = band * U(0xD1342543DE82EF95) + np.zeros((len(samples), bands), U)
        for k in range(rows):
            buckets = mix(buckets + samples[:, :, k])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(samples) + 1, bands), pa.int32()), pa.array(buckets.ravel().view(np.int64)))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, weigh = Sampler(bands * rows, seed), idf.value
        for batch in batches:
            for i, j, buf, off in _common.text_chunks(batch.column(1), 1 << 20):
                hashes, tf, first = shingles(buf, off, size)
                lists = bucketed(sampler, hashes, np.log(tf).astype(np.float32) + weigh(hashes), first)
                digest = []
                for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
                    terms = mix(hashes * U(salt) + tf.astype(U))
                    sums = np.zeros(len(terms) + 1, U)
                    np.cumsum(terms, out=sums[1:])
                    digest.append(pa.array((sums[first[1:]] - sums[first[:-1]]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in (0, 2, 3)), *digest, pa.array(np.diff(first)), lists], ["id", "h", "row", "d1", "d2", "n", "buckets"])

    def against_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members in grouped(batches, ["pivot", "salt"]):
            pivot = next(members)  # comes first
            base = unpacked(pivot["vec"])
            linked = [m["id"] for m in members if similarity(base, unpacked(m["vec"]), threshold)]
            if linked:
                yield pa.RecordBatch.from_arrays([pa.array(linked, pa.int64()), pa.array([pivot["id"]] * len(linked), pa.int64())], ["a", "b"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, left, right), members in grouped(batches, ["bucket", "bi", "bj"]):
            rows = [(m["id"], m["part"], m["side"], unpacked(m["vec"])) for m in members]
            joined = {r[1]: r[1] for r in rows}

            def root(x: int) -> int:
                while joined[x] != x:
                    joined[x] = x = joined[joined[x]]
                return x

            a, b = [], []
            for n, x in enumerate(rows):
                for y in rows[n + 1 :] if left == right else (rows[n + 1 :] if x[2] != right else []):
                    if (left == right or x[2] != y[2]) and root(x[1]) != root(y[1]) and similarity(x[3], y[3], threshold):
                        joined[root(x[1])] = root(y[1])
                        a.append(x[0])
                        b.append(y[0])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def fetched(keys: DataFrame, extra: str) -> DataFrame:
        """Column extra and the text t of the nodes in keys (rep, id, h, extra), settled, by id and text; of a repeated row several, at most."""
        side = keys.select("rep", F.col("id").alias("__id"), F.col("h").alias("__h"), *([extra] if extra != "rep" else []))
        same = whole["id"].eqNullSafe(F.col("__id")) & (whole["h"] == F.col("__h"))
        return whole.join(F.broadcast(side) if _common.few(keys) else side, same).select(extra, "t")

    def linked(texts: DataFrame, idf, known: DataFrame | None = None) -> DataFrame:
        """known and the edges found among texts (rep, was, buckets) of which a bucket holds several; was: the component so far."""

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weigh, seen = idf.value, set()
            for batch in batches:
                # a repeated row is one node
                new = [r not in seen and not seen.add(r) for r in batch.column(0).to_pylist()]
                batch = batch if all(new) else batch.filter(pa.array(new))
                for i, j, buf, off in _common.text_chunks(batch.column(1)):
                    hashes, tf, first = shingles(buf, off, size)
                    w = (tf * np.exp(weigh(hashes))).astype(np.float32)
                    data = [hashes[a:b].tobytes() + w[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(data, pa.binary())], ["id", "vec"])

        dealt = texts.select("rep", "was", F.explode("buckets").alias("bucket"))
        shared = dealt.groupBy("bucket").agg(F.min(F.struct("rep", "was")).alias("head"), F.min("was").alias("low"), F.max("was").alias("high"), F.count("*").alias("n")).where("low < high")
        shared = _common.settle(shared.select("bucket", "n", F.col("head.rep").alias("pivot"), F.col("head.was").alias("pivot_was")), "minhash-shared")
        live = _common.settle(_common.meet(dealt, shared, ["bucket"], "n"), "minhash-live")

        # the shingles of texts that share a bucket, once each
        need = _common.settle(_common.attach(reps.select("rep", "id", "h"), _common.settle(live.select("rep").distinct(), "minhash-need"), "rep", "left_semi"), "minhash-keys")
        found = fetched(need, "rep").mapInArrow(vectors, "id long, vec binary")
        kept = _common.settle(found, "minhash-vectors")
        found = kept.dropDuplicates(["id"])

        pairs = live.where("was <> pivot_was").select("rep", "pivot").distinct()
        salts = pairs.groupBy("pivot").agg(F.count("*").alias("n"), F.ceil(F.count("*") / DEALT).cast("int").alias("salts"))
        salts = _common.settle(salts, "minhash-salts")
        pairs = _common.meet(pairs, salts, ["pivot"], "n").select("pivot", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"), F.col("rep").alias("id"), F.lit(1).alias("member"))
        heads = salts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("pivot").alias("id"), F.lit(0).alias("member"))
        met = pairs.unionByName(heads).join(found, "id").select("pivot", "salt", "member", "id", "vec")
        edges = met.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "member", "id").mapInArrow(against_pivot, "a long, b long")
        edges = _common.settle(edges, "minhash-edges")
        edges = edges if known is None else known.unionByName(edges)
        parts = _common.settle(components(edges), "minhash-parts")

        # buckets whose texts aren't all connected yet: all pairs across components. A bucket of two was settled above, and of
        # buckets with the same texts one will do.
        labelled = live.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("part"))
        sizes = labelled.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("y"))
        open_ = sizes.groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("parts"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
        open_ = open_.where("parts > 1 and n > 2").groupBy("x", "y", "n").agg(F.min("bucket").alias("bucket"), F.min("top").alias("top"))
        # blocks of the largest component come after those of the rest, and aren't paired with each other
        open_ = open_.select("bucket", F.col("top.part").alias("main"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("few"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("many"), "n")
        open_ = _common.settle(open_, "minhash-open")
        left = _common.meet(labelled, open_, ["bucket"], "n")
        is_main = F.col("part") == F.col("main")
        left = left.withColumn("side", F.when(is_main, F.col("few") + F.pmod(F.xxhash64("rep"), F.col("many"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("few"))).cast("int"))
        last = F.when(is_main, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
        left = left.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        left = left.select("bucket", F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj"), "side", "part", F.col("rep").alias("id"))
        keys = ["bucket", "bi", "bj"]
        met = left.join(found, "id").select(*keys, "side", "part", "id", "vec").repartition(*keys).sortWithinPartitions(*keys, "side", "id")
        more = _common.settle(met.mapInArrow(across, "a long, b long"), "minhash-more")
        _common.forget(shared, live, need, kept, salts, parts, open_)
        return edges.unionByName(more)

    kind = whole.schema["id"].dataType.simpleString()
    numbered = whole.select("id", "t", "h", F.monotonically_increasing_id().alias("row"))
    sketches = _common.settle(numbered.mapInArrow(sketched, f"id {kind}, h long, row long, d1 long, d2 long, n long, buckets array<long>"), "minhash-sketches")
    worded = sketches.where("n > 0")
    # a node is a set of shingles; it goes by the row of one of its texts
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    reps = worded.groupBy("d1", "d2").agg(F.min(F.struct("row", "id", "h")).alias("one"), best, F.count("*").alias("m"), F.first("buckets").alias("buckets"))
    reps = _common.settle(reps.select("d1", "d2", F.col("one.row").alias("rep"), "one.id", "one.h", "best", "m", "buckets"), "minhash-reps")
    edges = linked(reps.select("rep", F.col("rep").alias("was"), "buckets"), idf)

    def named(edges: DataFrame) -> DataFrame:
        """Each node's class: rep, d1, d2, id, h, m, part, first (of its rows), class_size."""
        parts = _common.settle(components(edges).withColumnRenamed("node", "rep"), "minhash-classes")
        whole_ = _common.settle(reps.drop("buckets").join(parts, "rep", "left").withColumn("part", F.coalesce("component", "rep")), "minhash-nodes")
        names = whole_.groupBy("part").agg(F.min("best").alias("first"), F.sum("m").alias("class_size"), F.count("*").alias("nodes"))
        out = _common.settle(_common.meet(whole_.drop("component"), _common.settle(names, "minhash-names"), ["part"], "nodes"), "minhash-named")
        _common.forget(parts, whole_)
        return out

    nodes = named(edges)

    # the second round: df over one document of each class
    if by_class:
        copies = nodes.where("class_size > 1").withColumn("n", F.col("m") - (F.col("best") == F.col("first")).cast("long")).where("n > 0")
        copies = _common.settle(copies.select("rep", "id", "h", "n"), "minhash-copies")
        if copies.take(1):
            fewer = frequencies(df.drop("n").withColumn("sign", F.lit(1)).unionByName(counters(fetched(copies, "n").select("t", "n"), size, bits, -1)), least)
            raised = spark.sparkContext.broadcast(idf_table(fewer, total, least, bits))

            def sketched_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                sampler, before, after, seen = Sampler(bands * rows, seed), idf.value, raised.value, set()
                for batch in batches:
                    new = [h not in seen and not seen.add(h) for h in batch.column(0).to_pylist()]
                    batch = batch if all(new) else batch.filter(pa.array(new))
                    for i, j, buf, off in _common.text_chunks(batch.column(1), 1 << 20):
                        hashes, tf, first = shingles(buf, off, size)
                        ln_w = after(hashes)
                        hit = np.zeros(len(hashes) + 1, np.int64)
                        np.cumsum(ln_w != before(hashes), out=hit[1:])
                        some = hit[first[1:]] > hit[first[:-1]]
                        if some.any():
                            mine = np.repeat(some, np.diff(first))
                            first = np.append(0, np.cumsum(np.diff(first)[some]))
                            lists = bucketed(sampler, hashes[mine], np.log(tf[mine]).astype(np.float32) + ln_w[mine], first)
                            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).filter(pa.array(some)), lists], ["h", "buckets"])

            again = _common.settle(whole.select("h", "t").mapInArrow(sketched_again, "h long, buckets array<long>"), "minhash-again").dropDuplicates(["h"])
            again = again.join(nodes.select("h", "rep", F.col("part").alias("was")), "h").select("rep", "was", "buckets")
            nodes = named(linked(_common.settle(again, "minhash-anew"), raised, edges))
            _common.forget(fewer, copies)
            raised.destroy()

    members = _common.meet(worded.select("id", "h", "row", "d1", "d2"), nodes.select("d1", "d2", "m", "first", "class_size"), ["d1", "d2"], "m")
    members = members.select("id", "h", F.col("first.id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"))
    alone = sketches.where("n = 0").select("id", "h", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    out = _common.settle(members.unionByName(alone), "minhash-members")
    _common.forget(df, sketches, reps, nodes)
    idf.destroy()  # nothing is computed from it any more
    return out


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """A row per document: the id, class_id (the smallest id of its class), kept, class_size. Options: those of classes().

    Of each class one row has kept true, one with the smallest id. Rows are told apart by themselves, not by their ids: rows
    that share an id may be of different classes, and rows without an id are documents like others (class_id is null if none
    of the class has one; such a row is kept only if no other is). Texts without a word, null ones among them, are classes of
    their own; repeated rows share a class; an empty table gives no rows; other columns are ignored.
    """
    return classes(docs, id_col, text_col, **more).select(F.col("id").alias(id_col), "class_id", "kept", "class_size")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """docs, all columns, with one row of each class: one with the smallest id.

    Rows are told apart by id and text, so one that shares its id with a near copy, but not its text, stays. Of a row that is
    repeated one stays. Texts without a word all stay. An empty table gives no rows.
    """
    decided = classes(docs, id_col, text_col, **{"by_class": True} | more).where("class_size > 1")
    return _common.keep_one(docs, decided.select("id", F.col("h").alias("key"), "kept"), id_col, F.xxhash64(F.col(f"`{text_col}`").cast("string")))
