import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinframe.llm import resample
from tests.llm.conftest import text

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def features(t):
    w = WORD.findall(lower(t))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target):
    """(doc_id, n_features, weight, score) in order of rank, then those not drawn."""
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for x in texts:
            for b in features(x)[1]:
                counts[b] += 1
    big_s, big_t = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((float(t[b]) + 1) * (float(big_s) + 10000) / ((float(s[b]) + 1) * (float(big_t) + 10000)))) for b in range(10000)]
    out, drawable = [], []
    for i, x in docs:
        n, f = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        row = [i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if n >= 20:
            drawable.append(row)
    drawable.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, row in enumerate(drawable[: 5 * len(drawable) // 100]):
        row[4] = rank + 1
    return sorted((tuple(r) for r in out), key=str)


def test_crc_of_joined_words():
    rng = np.random.default_rng(1)
    words = ["".join(chr(rng.integers(97, 123)) for _ in range(n)) for n in [1, 2, 3, 47, 48, 49, 50, 300, 70_000, 5]] + ["é", "日本語"]
    t = "  ".join(words).encode()
    stream, offsets, n = resample.buckets(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
    assert sorted(stream.tolist()) == sorted(features(t.decode())[1]) and offsets.tolist() == [0, len(stream)] and n.tolist() == [len(words)]
    assert [len(x) for x in resample.buckets(np.zeros(0, np.uint8), np.zeros(1, np.int64))] == [0, 1, 0]


def test_against_brute_force(spark, corpus):
    import random

    rng = random.Random(4)
    long = " ".join(f"word{rng.randrange(5000)}" for _ in range(60_000))
    docs = [(i, t) for i, t, _, _ in corpus] + [(900, None), (901, ""), (None, "Null id " * 12), (902, "a"), (903, "a b"), (904, "A\tb C"), (905, long), (7, corpus[7][1]), (7, corpus[7][1]), (906, "ÀÉ straße " * 9), (907, "x" * 100_000)]
    target = [text(rng, 30), text(rng, 60, "fr"), None, "the of and"]
    df = spark.createDataFrame([(i, t, 1, "?") for i, t in docs], "doc_id long, text string, rank int, words string").repartition(7)
    got = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and got.schema["rank"].dataType.simpleString() == "bigint"
    want = brute(docs, target)
    plain = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert plain(got.collect()) == want
    assert plain(resample.resample(df.repartition(3), spark.createDataFrame([(t,) for t in target], "text string")).collect()) == want


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")]])
def test_empty_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = resample.resample(df, spark.createDataFrame([], "text string")).collect()
    assert sorted(tuple(r)[:3] + (r["rank"],) for r in got) == [(i, 0, 0, None) for i, _ in rows]


def test_ties_go_to_the_smaller_id_and_hot_rows_are_spread(spark):
    same = "one two three four five " * 5
    df = spark.createDataFrame([(5, same)] * 300 + [(3, same)] * 100, "doc_id long, text string")
    got = resample.resample(df, spark.createDataFrame([("one two",)], "text string"))
    ranked = [r["doc_id"] for r in got.where("rank is not null").orderBy("rank").collect()]
    scores = {r["doc_id"]: r["score"] for r in got.select("doc_id", "score").distinct().collect()}
    assert len(ranked) == 20 and set(ranked) == {max(scores, key=scores.get)}
    assert "SinglePartition" not in got.select(F.col("rank"))._jdf.queryExecution().toString()
