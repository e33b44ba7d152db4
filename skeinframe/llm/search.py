"""Exact top-k inner products of integer vectors, block at a time, by bounds.

1. Components become whole numbers. Vectors are put in order of their length, of the nearest of PIVOTS sampled vectors and of
   their id; successive ones are a block of BLOCK, and successive blocks a shard. The order only makes ranges narrow: every
   vector is in a block.
2. A block's forward index is its matrix; with it go each component's least and greatest value. A query's bound for a block,
   or for a shard, is the sum over its components of the larger product with these two.
3. Each query first goes to the shard with the largest bound. There, blocks are taken in order of their bounds, and scored,
   until a bound falls below the k-th score so far.
4. With that k-th score a query goes to the other shards whose bounds reach it, and on in the same way; each gives at most k
   results, which meet by query.

A task holds a shard's blocks; queries pass by it. There are SHARDS shards at most, whose bounds are broadcast. A shard that many
queries go to is dealt to several tasks, with the queries. Rows are never paired as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinframe.llm import _common
from skeinframe.operators.order import numbered

TOP, SCALE = 10, 1024
#: Vectors in a block; least in a shard; shards at most; queries of a shard that a task takes; queries handled at a time.
BLOCK, SHARD, SHARDS, DEALT, TOGETHER = 32, 4096, 4096, 1 << 16, 256
#: The bounded sample that orders vectors: so many of all, those with the least hashes.
PIVOTS = 256
EXACT = float(1 << 53)
_LONG = (-(1 << 63), (1 << 63) - 1)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of 2, 4 and 8 bytes each, little-endian."""
    for kind in ("<i2", "<i4"):
        if not len(x) or np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max:
            return x.astype(kind).tobytes()
    return x.astype("<i8").tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    """n numbers of _packed()."""
    return np.frombuffer(data, f"<i{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) in 64 bits; what is beyond them is their nearest number."""
    with np.errstate(over="ignore"):
        y = np.floor(SCALE * x)
    out = np.clip(y, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    out[y >= 2.0**63] = _LONG[1]
    return out


def bounds(queries: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Queries by ranges: the largest inner product that vectors between lows and highs may have, never too small."""
    q, lo, hi = queries.astype(float), lows.astype(float), highs.astype(float)
    out = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
    size = np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T
    return out + np.where(size >= EXACT, size * 1e-12, 0)


def scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products; doubles where these are exact, else Python's whole numbers, of which those beyond 64 bits become the nearest."""
    if not vectors.size or float(np.abs(vectors).max()) * float(np.abs(query).max()) * len(query) < EXACT:
        return (vectors.astype(float) @ query.astype(float)).astype(np.int64)
    return np.array([min(max(int(s), _LONG[0]), _LONG[1]) for s in vectors.astype(object) @ query.astype(object)], np.int64)


class Shard:
    """Blocks of vectors of one length: matrix, bounds, ids (None: no id), places."""

    def __init__(self, n: int, blocks: list[dict]):
        self.sizes = np.array([len(b["places"]) for b in blocks])
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.matrix = np.concatenate([_unpacked(b["data"], n * len(b["places"])).reshape(len(b["places"]), n) for b in blocks])
        self.lows, self.highs = (np.stack([_unpacked(b[k], n) for b in blocks]) for k in ("lows", "highs"))
        self.ids = np.concatenate([np.array([_LONG[1] if i is None else i for i in b["ids"]], np.int64) for b in blocks])
        self.none = np.concatenate([np.array([i is None for i in b["ids"]]) for b in blocks])
        self.places = np.concatenate([np.array(b["places"], np.int64) for b in blocks])

    def best(self, query: np.ndarray, own: int, bound: np.ndarray, kth: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Of one query the rows of the k best but its own, their scores, and how many blocks were scored. bound: of each block."""
        order = np.argsort(-bound, kind="stable")
        rows, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done, many = 0, 1
        while done < len(order) and bound[order[done]] >= kth:
            now = order[done : done + many]
            now = now[bound[now] >= kth]
            at = np.concatenate([np.arange(self.first[b], self.first[b + 1]) for b in now])
            at = at[self.places[at] != own]
            rows, found = np.concatenate([rows, at]), np.concatenate([found, scores(self.matrix[at], query)])
            best = self._top(rows, found, k)
            rows, found = rows[best], found[best]
            if len(rows) == k:
                kth = max(kth, float(found[-1]))
            done, many = done + len(now), many * 2
        return rows, found, done

    def _top(self, rows: np.ndarray, found: np.ndarray, k: int) -> np.ndarray:
        some = np.arange(len(found))
        if len(found) > k:
            some = np.flatnonzero(found >= np.partition(found, len(found) - k)[len(found) - k])
        order = np.lexsort((self.places[rows[some]], self.ids[rows[some]], self.none[rows[some]], ~found[some]))
        return some[order][:k]


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Settled: id, n, data, pivot, place (from 0, in order), of vectors without null and non-finite components."""
    spark = df.sparkSession
    _common.prepare(spark)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where("v is not null")

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            values = pc.fill_null(pc.list_flatten(lists), np.nan).to_numpy(zero_copy_only=False)
            upto = np.concatenate([[0], np.cumsum(sizes)])
            keep = np.array([bool(np.isfinite(values[a:b]).all()) for a, b in zip(upto[:-1], upto[1:], strict=True)], bool)
            data = [_packed(whole(values[upto[i] : upto[i + 1]])) for i in np.flatnonzero(keep)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.array(sizes[keep].astype(np.int64)), pa.array(data, pa.binary())], ["id", "n", "data"])

    numbers = _common.settle(rows.mapInArrow(integers, "id long, n long, data binary"), "search-numbers")
    sample: dict[int, list] = {}
    for n, data in numbers.select("n", "data").orderBy(F.xxhash64("data"), "data").limit(PIVOTS).collect():
        sample.setdefault(n, []).append(_unpacked(bytes(data), n).astype(float))
    pivots = spark.sparkContext.broadcast({n: np.stack(x) for n, x in sample.items()})

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, data = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            pivot = np.zeros(len(sizes), np.int64)
            for n in np.unique(sizes).tolist():
                if n in pivots.value and n:
                    mine, p = np.flatnonzero(sizes == n), pivots.value[n]
                    x = np.stack([_unpacked(data[i], n) for i in mine]).astype(float)
                    with np.errstate(all="ignore"):
                        pivot[mine] = ((p * p).sum(1) - 2 * x @ p.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot)], ["id", "n", "data", "pivot"])

    ordered = numbered(numbers.mapInArrow(nearest, "id long, n long, data binary, pivot long"), [F.col(c).asc() for c in ("n", "pivot", "id", "data")], "place")
    out = _common.settle(ordered, "search-vectors")
    _common.forget(numbers)
    return out


def blocks_of(ordered: DataFrame, shard: int) -> DataFrame:
    """Settled: shard, n, data, lows, highs, ids, places: a row a block, of shards of so many vectors."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "n", "data", "lows", "highs", "ids", "places"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        key, held = None, []

        def block() -> pa.RecordBatch:
            x = np.stack([_unpacked(d, key[1]) for _, d, _ in held])
            row = [key[0], key[1], _packed(x.ravel()), _packed(x.min(0)), _packed(x.max(0)), [i for i, _, _ in held], [p for _, _, p in held]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for s, n, i, d, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = s, n, p // BLOCK
                if held and now != key:
                    yield block()
                key = now
                held.append((i, d, p))
        if held:
            yield block()

    rows = ordered.select(F.floor(F.col("place") / shard).alias("shard"), "n", "id", "data", "place").repartition("shard").sortWithinPartitions("shard", "place")
    return _common.settle(rows.mapInArrow(built, "shard long, n long, data binary, lows binary, highs binary, ids array<long>, places array<long>"), "search-blocks")


def _ranges(blocks: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length the shards that have such vectors, and their least and greatest components: a row a shard and length."""

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple] = {}
        for batch in batches:
            for s, n, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lo, hi = _unpacked(lo, n), _unpacked(hi, n)
                old = found.get((s, n))
                found[s, n] = (np.minimum(old[0], lo), np.maximum(old[1], hi)) if old else (lo, hi)
        for (s, n), (lo, hi) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([n]), pa.array([_packed(lo)]), pa.array([_packed(hi)])], ["shard", "n", "lows", "highs"])

    merged: dict[int, dict[int, tuple]] = {}
    for s, n, lo, hi in blocks.select("shard", "n", "lows", "highs").mapInArrow(narrowed, "shard long, n long, lows binary, highs binary").collect():
        lo, hi = _unpacked(bytes(lo), n), _unpacked(bytes(hi), n)
        old = merged.setdefault(n, {}).get(s)
        merged[n][s] = (np.minimum(old[0], lo), np.maximum(old[1], hi)) if old else (lo, hi)
    return {n: (np.array(sorted(by)), np.stack([by[s][0] for s in sorted(by)]), np.stack([by[s][1] for s in sorted(by)])) for n, by in merged.items()}


def top_k(df: DataFrame, queries: F.Column | None = None, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query row the k rows with the highest scores but itself, all if fewer.

    queries: a condition over `id`, by default that it is divisible by 100. A score is the inner product of the components'
    floor(1024 * x); equal ones go to the smaller id, a null one last. Null vectors and those that hold null or non-finite components
    take no part; vectors of another length than the query's aren't compared with it; empty vectors score 0 with each other.
    Repeated rows and rows that share an id are rows each for itself: a query's copies are candidates, and each is a query.
    What is beyond 64 bits is taken as their nearest number. An empty table gives no rows; other columns are ignored.
    """
    queries = F.col("id") % 100 == 0 if queries is None else queries
    ordered = vectors(df, id_col, vector_col)
    total = ordered.count()
    size = -(-max(SHARD, -(-total // SHARDS)) // BLOCK) * BLOCK
    blocks = blocks_of(ordered, size)
    ranges = df.sparkSession.sparkContext.broadcast(_ranges(blocks))
    asked = ordered.where(queries).select("id", "n", "data", "place")

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of queries (id, n, data, place, was, kth) the shards to go to: without `was` the one with the largest bound, else all others that reach kth."""
        for batch in batches:
            sizes, data, was, kth = batch.column(1).to_numpy(), batch.column(2), batch.column(4).to_numpy(), batch.column(5).to_numpy()
            who, where = [], []
            for n in np.unique(sizes).tolist():
                shards, lows, highs = ranges.value[n]
                mine = np.flatnonzero(sizes == n)
                for at in (mine[i : i + TOGETHER] for i in range(0, len(mine), TOGETHER)):
                    b = bounds(np.stack([_unpacked(data[int(i)].as_py(), n) for i in at]), lows, highs)
                    first = was[at] < 0
                    reach = (b >= kth[at][:, None]) & (shards[None] != was[at][:, None])
                    reach[first] = False
                    reach[first, b[first].argmax(1)] = True
                    i, j = np.nonzero(reach)
                    who.append(at[i])
                    where.append(shards[j])
            if who:
                who = pa.array(np.concatenate(who))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(who) for c in (0, 1, 2, 3, 5)), pa.array(np.concatenate(where))], ["id", "n", "data", "place", "kth", "shard"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept, held, shards = None, [], [], {}

        def answers() -> Iterator[pa.RecordBatch]:
            for n in sorted({q["n"] for q in held}):
                if n not in shards:
                    shards[n] = Shard(n, [b for b in kept if b["n"] == n])
                mine, shard = [q for q in held if q["n"] == n], shards[n]
                x = np.stack([_unpacked(q["data"], n) for q in mine])
                for q, v, b in zip(mine, x, bounds(x, shard.lows, shard.highs), strict=True):
                    rows, found, _ = shard.best(v, q["place"], b, q["kth"], k)
                    if len(rows):
                        fixed = [pa.array([v] * len(rows), pa.int64()) for v in (q["place"], q["id"], key[0])]
                        yield pa.RecordBatch.from_arrays([*fixed, pa.array(shard.ids[rows], mask=shard.none[rows]), pa.array(shard.places[rows]), pa.array(found)], ["query", "query_id", "shard", "vec_id", "place", "score"])
            held.clear()

        for batch in batches:
            for row in (r for i in range(0, batch.num_rows, 64) for r in batch.slice(i, 64).to_pylist()):
                if (row["shard"], row["salt"]) != key:
                    yield from answers()
                    key, kept, shards = (row["shard"], row["salt"]), [], {}
                if row["lows"] is not None:
                    kept.append(row)
                else:
                    held.append(row)
                    if len(held) == TOGETHER:
                        yield from answers()
        yield from answers()

    def results(routes: DataFrame, name: str) -> DataFrame:
        routes = _common.settle(routes.mapInArrow(routed, "id long, n long, data binary, place long, kth double, shard long"), f"search-routes-{name}")
        dealt = routes.groupBy("shard").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("salts"))  # SHARDS rows at most
        left = blocks.join(F.broadcast(dealt), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        right = routes.join(F.broadcast(dealt), "shard").withColumn("salt", F.pmod(F.xxhash64("place"), F.col("salts")).cast("int"))
        met = left.select("shard", "salt", "n", "data", "lows", "highs", "ids", "places").unionByName(right.select("shard", "salt", "n", "data", "id", "place", "kth"), allowMissingColumns=True)
        met = met.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("lows").isNull().asc())
        found = met.mapInArrow(searched, "query long, query_id long, shard long, vec_id long, place long, score long")
        found = _common.settle(found, f"search-found-{name}")
        _common.forget(routes)
        return found

    first = results(asked.select("*", F.lit(-1).cast("long").alias("was"), F.lit(float("-inf")).alias("kth")), "first")
    # of each query where it was, and its k-th score if it has k
    seen = first.groupBy("query").agg(F.first("shard").alias("was"), F.when(F.count("*") == k, F.min("score").cast("double")).alias("kth"))
    home = F.coalesce("was", F.lit(-2).cast("long"))
    more = asked.join(seen, F.col("place") == F.col("query"), "left").select("id", "n", "data", "place", home.alias("was"), F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
    # a query whose first shard held nothing but itself goes there again, for nothing
    more = more.withColumn("was", F.when(F.col("was") == -2, F.lit(1 << 62)).otherwise(F.col("was")))
    every = first.unionByName(results(more, "more"))
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "place")
    out = every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    _common.forget(ordered, blocks)
    return out.select("query_id", "rank", "vec_id", "score")
