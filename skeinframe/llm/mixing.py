"""Mixing sources to target weights.

Words are summed per source, targets follow from the weights, and each document is
emitted floor(rate) times plus once more with probability equal to the fraction.

The extra copies are a systematic draw. A source's documents are ordered by size, and
those of one size by a hash of the id, the text and the seed. With documents
0, 1, ... in that order and u a hash of the source and the seed, as many of the first i
are copied as floor(i * fraction + u). So each document is copied with probability
equal to the fraction, whatever the seed, and the copied words stay within one document
of their target. Draws depend on the rows and the seed only: reruns agree.

No source is ordered in one task. Counts of (source, size) say how many documents of
each size are copied; these are the ones with the smallest hashes, so a bar a size
decides, which lies in one of many hash buckets and is found by counts of buckets and a
window over a single one, of about BUCKET_ROWS rows. Only rows that have the very hash
of a bar, repeated rows of one document, are numbered, in blocks of one task's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinframe.llm import _common

#: The weights of the sources in order, repeating, and the most that a source is repeated.
WEIGHTS, MOST_REPEATS = (5, 2, 1), 3
#: Documents of a hash bucket, about.
BUCKET_ROWS = 4096
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def number(text: F.Column, digits: int) -> F.Column:
    """The first hexadecimal digits of MD5, 15 at most, as a number."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def draw(id_col: F.Column, text_col: F.Column, seed: int) -> F.Column:
    """60 bits that tell documents apart: of the id, the text and the seed."""
    return number(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}:"), F.md5(F.coalesce(text_col.cast("string"), F.lit("")))), 15)


def source_rates(sized: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Per source of sized (src, size): source_size, target. Settled.

    Sources come by code point, null last; their weights repeat. Targets share the words of all sources by weight, stop at
    `most` times their source's words, and what is over goes to the others by weight until none is above.
    """
    sums = _common.numbered(sized.groupBy("src").agg(F.sum("size").alias("source_size")), F.col("src").asc_nulls_last(), "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    sums = _common.settle(sums.select("src", "source_size", weight.alias("w"), (F.col("source_size") * float(most)).alias("cap")), "mix-sources")
    total = float(sums.agg(F.sum("source_size")).first()[0] or 0)
    # sources are full where the level, words a weight, passes cap / w; each round shares what the full ones leave
    level, full = 0.0, -1
    while True:
        is_full = F.col("cap") < level * F.col("w") if full >= 0 else F.lit(False)
        n, caps, w = sums.agg(F.count_if(is_full), F.sum(F.when(is_full, F.col("cap")).otherwise(0.0)), F.sum(F.when(is_full, 0.0).otherwise(F.col("w")))).first()
        if n == full or not w:
            break
        level, full = (total - caps) / w, n
    return sums.select("src", "source_size", F.least(F.col("cap"), F.col("w") * level).alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, weights: tuple = WEIGHTS, most: int = MOST_REPEATS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents: id, src, size, z, row; sources: src, source_size, target, times; bars: src, size, bar, here; open), all settled.

    A document is taken `times` times, and once more if its draw z is below its size's bar. Of those whose draw is the bar
    itself, `here` are taken once more: all of them, or open has a row (src, size, z, here) and copies() numbers them.
    """
    columns = [F.col(id_col).alias("id"), F.col(source_col).alias("src"), word_count(F.col(text_col)).alias("size"), draw(F.col(id_col), F.col(text_col), seed).alias("z"), F.monotonically_increasing_id().alias("row")]
    sized = _common.settle(docs.select(*columns), "mix-sizes")
    rates = source_rates(sized, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    times = F.least(F.floor(rate + F.lit(1e-12)), F.lit(most)).cast("int")
    start = number(F.concat(F.coalesce(F.col("src"), F.lit("")), F.lit(f":{seed}")), 13).cast("double") / float(1 << 52)
    fraction = F.when(F.col("times") < most, F.greatest(F.lit(0.0), rate - F.col("times"))).otherwise(0.0)
    rates = rates.withColumn("times", times).select("src", "source_size", "target", "times", fraction.alias("fraction"), start.alias("start"))
    rates = _common.settle(rates, "mix-rates")
    # how many documents of each size are copied
    sizes = sized.groupBy("src", "size").agg(F.count("*").alias("n"))
    sizes = _same(sizes, rates, ["src"])
    upto = F.sum("n").over(Window.partitionBy("src").orderBy("size"))
    copied = lambda i: F.floor(i * F.col("fraction") + F.col("start"))
    sizes = sizes.withColumn("upto", upto).select("src", "size", "n", (copied(F.col("upto")) - copied(F.col("upto") - F.col("n"))).alias("k"))
    sizes = _common.settle(sizes.where("k > 0"), "mix-strata")
    # all of a size: no bar to be found
    whole = sizes.where("k >= n").select("src", "size", F.lit(1 << 60).alias("bar"), F.lit(0).cast("long").alias("here"))
    some = sizes.where("k < n").select("src", "size", "k", F.ceil(F.col("n") / BUCKET_ROWS).alias("buckets"))
    dealt = _same(sized.select("src", "size", "z"), some, ["src", "size"]).withColumn("b", F.floor(F.col("z") / F.lit(float(1 << 60)) * F.col("buckets")))
    counts = dealt.groupBy("src", "size", "b").agg(F.count("*").alias("n"), F.first("k").alias("k"))
    line = Window.partitionBy("src", "size").orderBy("b")
    crossing = counts.withColumn("before", F.sum("n").over(line) - F.col("n")).where("before < k and before + n >= k")
    crossing = _common.settle(crossing.select("src", "size", "b", (F.col("k") - F.col("before")).alias("left")), "mix-crossing")
    # rows with one draw count together: only they may be many
    near = _same(dealt.select("src", "size", "b", "z"), crossing, ["src", "size", "b"]).groupBy("src", "size", "z").agg(F.count("*").alias("n"), F.first("left").alias("left"))
    line = Window.partitionBy("src", "size").orderBy("z")
    bars = near.withColumn("before", F.sum("n").over(line) - F.col("n")).where("before < left and before + n >= left")
    bars = bars.select("src", "size", F.col("z").alias("bar"), (F.col("left") - F.col("before")).alias("here"), "n")
    bars = _common.settle(bars.unionByName(whole.withColumn("n", F.lit(0).cast("long"))), "mix-bars")
    open_ = bars.where("here < n").select("src", "size", F.col("bar").alias("z"), "here")
    _common.forget(sizes, crossing)
    return sized, rates, bars.drop("n"), open_


def _same(rows: DataFrame, side: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows and side's other columns where `on` is the same, null sources being equal; side is broadcast if it is small."""
    named = side.select([F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in side.columns])
    same = [rows[c].eqNullSafe(named[f"__{c}"]) for c in on]
    return rows.join(F.broadcast(named) if _common.few(side) else named, same, how).drop(*[f"__{c}" for c in on])


def _numbered(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """Of settled rows (src, size, z, row) those of open: row, more (1 for the first `here` of each). A window holds one task's rows."""
    found = _same(rows, open_, ["src", "size", "z"]).withColumn("part", F.shiftright("row", 33))
    parts = found.groupBy("src", "size", "z", "part").agg(F.count("*").alias("n"))
    parts = _common.settle(parts.withColumn("before", F.sum("n").over(Window.partitionBy("src", "size", "z").orderBy("part")) - F.col("n")).drop("n"), "mix-parts")
    place = F.row_number().over(Window.partitionBy("src", "size", "z", "part").orderBy("row"))
    return _same(found.withColumn("place", place), parts, ["src", "size", "z", "part"]).select("row", (F.col("before") + F.col("place") <= F.col("here")).cast("int").alias("more"))


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **more) -> DataFrame:
    """A row per document: the id, size, source_size, target (its source's), taken (words that the mix takes, repeats counted).

    Cases: a null text has size 0; null sources are one source, the last; rows with a null or repeated id are documents each
    for itself; an empty table gives no rows; other columns are ignored.
    """
    sized, sources, bars, open_ = plan(docs, id_col, text_col, source_col, **more)
    joined = _same(_same(sized, sources.select("src", "source_size", "target", "times"), ["src"]), bars, ["src", "size"], "left")
    extra = F.when((F.col("z") < F.col("bar")) | ((F.col("z") == F.col("bar")) & (F.col("here") > 0)), 1).otherwise(0)
    if open_.take(1):
        joined = joined.join(_numbered(sized, open_), "row", "left")
        extra = F.coalesce("more", extra)
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * (F.col("times") + extra)).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **more) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it. Texts aren't shuffled: bars of sources and sizes go to them.

    Cases: as for mix_sizes. Rows that share an id, text and source are copied as often in all as so many documents; if their
    other columns differ, any of them. Only where a part of such rows is copied are these written out, to be numbered.
    """
    _, sources, bars, open_ = plan(docs, id_col, text_col, source_col, seed=seed, **more)
    helper = {c: _common.fresh(docs, f"__mix_{c}") for c in ("src", "size", "z", "row", "copy", "times", "bar", "here")}
    rows = docs.withColumns({helper["src"]: F.col(f"`{source_col}`"), helper["size"]: word_count(F.col(f"`{text_col}`")), helper["z"]: draw(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), seed)})

    def side(table: DataFrame) -> DataFrame:
        return table.select([F.col(c).alias(helper[c]) for c in table.columns])

    joined = _same(_same(rows, side(sources.select("src", "times")), [helper["src"]]), side(bars), [helper["src"], helper["size"]], "left")
    z, bar = F.col(helper["z"]), F.col(helper["bar"])
    extra = F.when((z < bar) | ((z == bar) & (F.col(helper["here"]) > 0)), 1).otherwise(0)
    out = joined.withColumn(helper["copy"], F.col(helper["times"]) + extra)
    if open_.take(1):
        keys = [helper[c] for c in ("src", "size", "z")]
        held = _common.settle(_same(out, side(open_.drop("here")), keys).withColumn(helper["row"], F.monotonically_increasing_id()), "mix-open")
        numbers = _numbered(held.select([F.col(helper[c]).alias(c) for c in ("src", "size", "z", "row")]), open_)
        counted = held.join(numbers.withColumnRenamed("row", helper["row"]), helper["row"]).withColumn(helper["copy"], F.col(helper["times"]) + F.col("more"))
        rest = _same(out, side(open_.drop("here")), keys, "left_anti")
        out = rest.select(*docs.columns, helper["copy"]).unionByName(counted.select(*docs.columns, helper["copy"]))
    copies = F.explode(F.array_repeat(F.lit(0), F.col(helper["copy"]).cast("int")))
    return out.select([F.col(f"`{c}`") for c in docs.columns] + [copies.alias(helper["row"])]).drop(helper["row"])
