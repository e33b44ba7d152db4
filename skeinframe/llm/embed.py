"""Near-duplicate embeddings by random-hyperplane sign hashing in several tables.

1. Exact copies (same label and vector) become one node with a weight, whatever their ids.
2. Every such vector gets a code per table: the signs of its products with k random hyperplanes.
   k follows the largest label's size, so that unrelated vectors seldom meet; the number of tables
   follows from k and the threshold, so that a pair at the threshold is missed with probability `miss`.
3. Codes that one vector alone has go. The others' vectors meet in blocks of at most BLOCK a side
   and are compared by cosine in double precision. A pair is counted in the first table where its codes agree.
4. A block returns a row per linked vector: its links there and the smallest vector that it reaches there.
   Pairs are never rows, however large a group is.
5. Connected components over those rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinframe.llm import _common
from skeinframe.llm.components import components, roots

BLOCK = 1024
#: Pairs whose codes are compared at a time.
AT_ONCE = 1 << 16


def shape(largest: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits of a code, tables) for labels of at most `largest` vectors."""
    bits = min(40, max(8, math.ceil(math.log2(max(2, largest))) + 2))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - agree)))


def unit_rows(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, scaled to length 1 in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def codes(rows: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """A code per row and table."""
    planes = np.random.default_rng(seed).standard_normal((rows.shape[1], tables * bits))
    signs = (rows @ planes > 0).reshape(len(rows), tables, bits)
    return signs.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def by_length(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        yield batch if (sizes == n).all() else batch.filter(pa.array(sizes == n))


def link_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, miss: float = 1e-6, seed: int = 11) -> DataFrame:
    """A row per vector: the id, n_links, component_id, kept.

    Two vectors are linked if their labels are equal and not null, their lengths are equal, and their cosine is at least
    `threshold` (above 0). Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Rows
    that repeat an id, or have none, count as vectors of their own; component_id is the smallest id reachable, null if no
    vector of the component has one, and kept tells whether it is the row's own. An empty table gives no rows; other columns
    are ignored.
    """
    spark = vectors.sparkSession
    _common.prepare(spark)
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size(v) > 0) & ~bad & some, F.lit(False))
    rows = rows.withColumn("ok", usable)
    valid = rows.where("ok").select("id", F.xxhash64("label", F.size("v"), "v").alias("h1"), F.xxhash64(F.lit("2"), "v", "label").alias("h2"), F.xxhash64("label", F.size("v")).alias("space"), "v")
    groups = valid.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("m"), F.first("space").alias("space"), F.first("v").alias("v"))
    # nodes are numbered as they are written
    groups = _common.settle(groups.withColumn("rep", F.monotonically_increasing_id()), "embed-groups")
    largest = groups.groupBy("space").count().agg(F.max("count")).first()[0] or 0
    bits, tables = shape(largest, threshold, miss)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_length(whole, 2):
                own = codes(unit_rows(batch.column(2)), bits, tables, seed)
                bucket = (own | (np.arange(tables, dtype=np.int64) << 48)).ravel()
                pick = np.repeat(np.arange(len(own)), tables)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(bucket)], ["rep", "space", "bucket"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # parts of the group at hand: unit rows, rep, m, side
        key = None

        def group() -> Iterator[pa.RecordBatch]:
            rows, rep, m, side = held[0] if len(held) == 1 else (np.concatenate(x) for x in zip(*held, strict=True))
            one = key[2] == key[3]
            first, second = (np.arange(len(rep)),) * 2 if one else (np.flatnonzero(side == key[2]), np.flatnonzero(side == key[3]))
            close = rows[first] @ rows[second].T >= threshold
            i, j = np.nonzero(np.triu(close, 1) if one else close)
            i, j = first[i], second[j]
            if len(i):
                own = codes(rows, bits, tables, seed)
                here = key[1] >> 48
                keep = np.concatenate([(own[i[s : s + AT_ONCE]] == own[j[s : s + AT_ONCE]]).argmax(axis=1) == here for s in range(0, len(i), AT_ONCE)])
                i, j = i[keep], j[keep]
            if len(i):
                links = np.bincount(i, m[j], len(rep)) + np.bincount(j, m[i], len(rep))
                order = np.argsort(rep)
                place = np.empty(len(rep), np.int64)
                place[order] = np.arange(len(rep))
                root = rep[order][roots(place[i], place[j], len(rep))][place]
                got = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(rep[got]), pa.array(links[got].astype(np.int64)), pa.array(root[got])], ["rep", "links", "root"])

        for whole in batches:
            # a group's vectors have one length, and rows of a group follow each other
            sizes = pc.list_value_length(whole.column(7)).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.diff(sizes)) + 1
            for begin, end in zip([0, *edge.tolist()], [*edge.tolist(), len(sizes)], strict=True):
                batch = whole.slice(begin, end - begin)
                if not batch.num_rows:
                    continue
                space, bucket, bi, bj, side, rep, m = (batch.column(c).to_numpy() for c in range(7))
                parts = (unit_rows(batch.column(7)), rep, m, side)
                new = np.flatnonzero((np.diff(space) != 0) | (np.diff(bucket) != 0) | (np.diff(bi) != 0) | (np.diff(bj) != 0)) + 1
                for s, e in zip([0, *new.tolist()], [*new.tolist(), len(rep)], strict=True):
                    k = (int(space[s]), int(bucket[s]), int(bi[s]), int(bj[s]))
                    if k != key:
                        if held:
                            yield from group()
                        held, key = [], k
                    held.append(tuple(x[s:e] for x in parts))
        if held:
            yield from group()

    all_codes = _common.settle(groups.select("rep", "space", "v").mapInArrow(hashed, "rep long, space long, bucket long"), "embed-codes")
    shared = all_codes.groupBy("space", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = _common.settle(shared.select("space", "bucket", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "embed-shared")
    live = _common.meet(all_codes, shared, ["space", "bucket"], "n")
    live = live.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    live = live.select("rep", "space", "bucket", "side", F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj"))
    live = live.join(groups.select("rep", "m", "v"), "rep").select("space", "bucket", "bi", "bj", "side", "rep", "m", "v")
    keys = ["space", "bucket", "bi", "bj"]
    found = live.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compared, "rep long, links long, root long")
    found = _common.settle(found, "embed-links")
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = groups.select("h1", "h2", "rep", "least", "m").join(sums, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("h1", "h2", "m", "least", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("part"))
    known = _common.settle(known, "embed-known")
    names = known.groupBy("part").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    known = _common.settle(_common.meet(known, _common.settle(names, "embed-names"), ["part"], "nodes").select("h1", "h2", "m", "n_links", "component_id"), "embed-results")
    _common.forget(all_codes, found)
    members = _common.meet(valid.select("id", "h1", "h2"), known, ["h1", "h2"], "m").select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = members.unionByName(alone)
    return both.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
