"""Connected regions of a matrix that is a table: labels inside tiles, a union over the tiles' borders, numbers by counts.

A region's part in a tile is named by the first linear index in it. Only names that touch across a border enter the union, which
contracts the graph of names round by round: each name joins its least neighbour, chains are shortened by doubling, and edges are
renamed; twice as many rounds as the logarithm of the names are enough. No task holds more than a tile of elements.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinframe.functions.kernels import image as I
from skeinframe.operators import stencil
from skeinframe.operators.gather import meet
from skeinframe.operators.order import numbered
from skeinframe.operators.tensor import Tensor, linear
from skeinframe.storage import forget, settle


def _renamed(rows: DataFrame, column: str, parents: DataFrame, places: int) -> DataFrame:
    """rows with the names in a column replaced by their parents; all of them have one."""
    other = [c for c in rows.columns if c != column]
    met = meet(parents.select(F.col("node").alias(column), F.col("parent").alias("__new")), rows, column, places, 1)
    return met.select(*other, F.col("__new").alias(column))


def union(edges: DataFrame) -> DataFrame:
    """label, root: for each name in edges (a, b) the least name of its component. An empty table gives an empty one."""
    edges = settle(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "region-edges")
    names, first = None, True
    while (n := edges.count()) or first:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        parents = settle(both.groupBy("node").agg(F.least("node", F.min("near")).alias("parent")), "region-parents")
        while True:
            step = _renamed(parents.withColumn("old", F.col("parent")), "parent", parents, 2 * n)
            shorter = settle(step, "region-parents")
            forget(parents)
            parents = shorter.select("node", "parent")
            parents.settled_at = shorter.settled_at
            if not shorter.where("parent != old").limit(1).count():
                break
        if first:
            names = settle(parents.select(F.col("node").alias("label"), F.col("parent").alias("root")), "region-names")
        else:  # names whose root isn't in this round's graph keep it
            there = parents.select(F.col("node").alias("root"), "parent")
            known = names.count()
            moved = meet(there, names.join(there.select("root"), "root", "left_semi"), "root", known, 1).select("label", F.col("parent").alias("root"))
            now = settle(moved.unionByName(names.join(there.select("root"), "root", "left_anti").select("label", "root")), "region-names")
            forget(names)
            names = now
        left = _renamed(_renamed(edges, "a", parents, n), "b", parents, n).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        after = settle(left, "region-edges")
        forget(edges, parents)
        edges, first = after, False
    forget(edges)
    return names


def regions(t: Tensor, connectivity: int = 4, tile: int | None = None) -> Tensor:
    """Connected parts of the elements that aren't zero, numbered from 1 in column-major order of their first element; 0 elsewhere.

    One matrix; connectivity 4 or 8. NULL counts as zero, NaN as an element that isn't.
    """
    if t.dims[2:] != (1, 1) or connectivity not in (4, 8):
        raise ValueError("regions are of one matrix, with connectivity 4 or 8")
    tile = stencil.TILE if tile is None else tile
    n0 = t.dims[0]

    def labels(a: np.ndarray, row: int, column: int) -> np.ndarray:
        found = I.regions(a, connectivity).ravel(order="F").astype(int)
        i, j = (x.ravel(order="F") for x in np.indices(a.shape))
        _, first = np.unique(found, return_index=True)
        place = (i + row + n0 * (j + column))[first]
        if found.size and found.min() > 0:
            place = np.concatenate([[-1], place])
        else:
            place[:1] = -1
        return place[found].reshape(a.shape, order="F")

    local = stencil.neighbourhood(t.map(lambda v: F.coalesce(v.cast("double"), F.lit(0.0))), labels, (0, 0), tile, 0.0, True)
    cells = settle(local.df.select("d0", "d1", "d2", "d3", F.col("v").cast("long").alias("label")), "region-cells")
    on = cells.where("label >= 0")
    edge = on.where(F.pmod("d0", F.lit(tile)).isin(0, tile - 1) | F.pmod("d1", F.lit(tile)).isin(0, tile - 1)).select("d0", "d1", "label")
    steps = [(1, 0), (0, 1)] + ([(1, 1), (-1, 1)] if connectivity == 8 else [])
    other = lambda c, o: F.floor((F.col(c) + o) / tile) != F.floor(F.col(c) / tile)
    across = F.array(*[F.when(other("d0", x) | other("d1", y), F.struct((F.col("d0") + x).alias("d0"), (F.col("d1") + y).alias("d1"))) for x, y in steps])
    out = edge.select(F.col("label").alias("a"), F.explode(F.filter(across, lambda s: s.isNotNull())).alias("s")).select("a", "s.*")
    names = union(out.join(edge.withColumnRenamed("label", "b"), ["d0", "d1"]).select("a", "b"))
    # an element at its own name's place tells that the name is there
    rooted = settle(on.where(F.col("label") == linear(t.dims)).select("label").join(names, "label", "left").select("label", F.coalesce("root", "label").alias("root")), "region-roots")
    forget(names)
    number = numbered(rooted.where("label = root").select("root"), [F.col("root").asc()], "number")
    table = meet(number, rooted, "root", rooted.count(), 1).select("label", (F.col("number") + 1).alias("number"))
    # elements of no region share one label, which may be that of most rows: they go beside the join
    met = on.join(table, "label").select("d0", "d1", "d2", "d3", F.col("number").alias("v"))
    off = cells.where("label < 0").select("d0", "d1", "d2", "d3", F.lit(0).cast("long").alias("v"))
    return Tensor(met.unionByName(off), t.dims, "u32")
