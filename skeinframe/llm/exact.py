"""Exact dedup by digest with a split of heavy hitters, in DataFrame operations only.

1. Every text's SHA-256 is taken once; (id, digest) goes to a shared table.
2. Misra-Gries summaries (DataFrame.freqItems: mergeable, 1/share counters) name every digest with more than `share` of the rows.
3. Their exact counts and winners come from one map-side aggregate; those verified as frequent, at most 1/share, are broadcast.
4. Rows of verified digests meet their winner on the map side; only the others are shuffled, by digest, without any text,
   and of those the winners of digests that come twice go back: by broadcast if they are few, else by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinframe.llm import _common

#: Share of all rows above which a digest is frequent; at most 1 / SHARE digests are.
SHARE = 1 / 2000


def normalised(text: F.Column) -> F.Column:
    """text with A-Z in lower case; null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.translate(text, *_common.AZ)


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """A row per document, settled: id, d (the digest), keep_id, group_size, kept. Of equal texts exactly one row is kept."""
    digests = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("d"), F.monotonically_increasing_id().alias("row"))
    digests = _common.settle(digests, "exact-digests")
    total = digests.count()
    best = [F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("group_size")]
    # Misra-Gries over hex strings: the summary's values come back as an array in one row of at most 1 / share items
    found = digests.select(F.hex("d").alias("h")).freqItems(["h"], share).select(F.explode("h_freqItems").alias("h")).select(F.unhex("h").alias("d"))
    heavy = digests.join(F.broadcast(found), "d", "left_semi").groupBy("d").agg(*best).where(F.col("group_size") > share * total)
    heavy = _common.settle(heavy, "exact-heavy")  # at most 1 / share rows
    light = digests.join(F.broadcast(heavy.select("d")), "d", "left_anti")
    # of the others only digests that come twice have a winner to send back
    pairs = _common.settle(light.groupBy("d").agg(*best).where("group_size > 1"), "exact-light")
    met = digests.join(F.broadcast(heavy), "d").unionByName(_common.attach(light, pairs, "d", "left"))
    me = F.struct("id", "row")
    out = met.select("id", "d", F.coalesce("best", me)["id"].alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (me == F.coalesce("best", me)).alias("kept"))
    out = _common.settle(out, "exact-decided")
    _common.forget(digests, heavy, pairs)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """A row per document: the id, keep_id, group_size, kept, text_sha256.

    Of equal texts (identical once A-Z is in lower case; null counts as empty) the row with the largest id stays; among rows
    that share that id too, which are the same row repeated, one has kept true, and group_size counts them all. A null id is
    smaller than any other. An empty table gives no rows; other columns are ignored.
    """
    return decide(docs, id_col, text_col, share).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("d")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each text: the one with the largest id.

    Rows are told apart by id and text, so one that shares its id with a copy, but not its text, stays. Of a row that is
    repeated one stays; a row without an id stays if no other has its text. An empty table gives no rows.
    """
    decided = decide(docs, id_col, text_col).where("group_size > 1")
    return _common.keep_one(docs, decided.select("id", F.xxhash64("d").alias("key"), "kept"), id_col, F.xxhash64(F.unhex(F.sha2(normalised(F.col(f"`{text_col}`")), 256))))
