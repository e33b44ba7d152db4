"""Every operator: nulls, empty and long texts, repeated rows, empty tables, clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinframe.llm import embed, exact, langid, license, minhash, mixing, packing, secrets, tokenfile, toxic
from tests.llm.conftest import SCHEMA

LONG = "long " * 60_000
ROWS = [
    (1, None, None, None), (2, "", "en", None), (3, "  \n\t ", "en", "a"), (4, "One two three.", "en", "a"), (4, "One two three.", "en", "a"), (5, "one TWO three.", None, "b"),
    (6, LONG, "en", "b"), (None, "A row without an id.", "fr", "b"), (None, None, None, None), (7, "é" * 5000, "fr", "ü"), (8, "12345 !!!", "de", "c"), (9, "\x00 odd text \U0001f600", "de", "c"),
]
CLASH = ["id", "t", "d", "u", "v", "size", "taken", "kept", "keep_id", "score", "label", "start", "bucket", "__gone", "__mix_src", "__mix_copy"]


def learned(spark):
    return toxic.learn([], np.zeros(0, int))


def token_files(df):
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir") + f"/tok{id(df)}"
    tokenfile.write(df, path)
    return tokenfile.read(spark, path)


OPERATORS = {
    "license": license.scan, "mix_sizes": mixing.mix_sizes, "mix": mixing.mix, "exact_groups": exact.exact_groups, "exact_dedup": exact.exact_dedup, "near_groups": minhash.near_groups, "near_dedup": minhash.near_dedup, "pack": packing.pack,
    "secrets": lambda d: secrets.digest(secrets.scan(d)), "toxic": lambda d: toxic.score(d, learned(d.sparkSession)), "drop_toxic": lambda d: toxic.drop_toxic(d, learned(d.sparkSession)), "files": token_files, "langid": lambda d: langid.predict(d, langid.fit(d)),
}
PER_DOCUMENT = {"license", "mix_sizes", "exact_groups", "near_groups", "secrets", "toxic", "files", "langid"}
SAME_COLUMNS = {"mix", "exact_dedup", "near_dedup", "drop_toxic"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_names(spark, name):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})
    out = OPERATORS[name](df)
    rows = out.collect()
    if name in PER_DOCUMENT:
        assert sorted((r["doc_id"] or -1) for r in rows) == sorted((r[0] or -1) for r in ROWS)
    if name in SAME_COLUMNS:
        assert out.columns == df.columns


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_defined_results(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    groups = {r["doc_id"]: r for r in exact.exact_groups(df).where("doc_id is not null").orderBy("kept").collect()}
    assert groups[4]["keep_id"] == 5 and groups[4]["group_size"] == 3 and not groups[4]["kept"] and groups[5]["kept"]
    assert groups[1]["text_sha256"] == groups[2]["text_sha256"] and groups[1]["keep_id"] == 2
    near = {r["doc_id"]: r["class_id"] for r in minhash.near_groups(df).where("doc_id is not null").collect()}
    assert near[4] == near[5] == 4 and near[1] == 1 and near[2] == 2
    lang = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, langid.fit(df)).where("doc_id is not null").collect()}
    assert lang[1] == lang[2] == lang[3] == lang[8] == "und" and lang[6] != "und"
    pieces = packing.pack(df).where("doc_id = 1 or doc_id = 2").collect()
    assert [p["length"] for p in pieces] == [1, 1]
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix_sizes(df).where("doc_id is not null").collect()}
    assert sizes[1] == sizes[2] == sizes[3] == 0 and sizes[4] == 3 and sizes[6] == 60_000


def test_embedding_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, None], 1), (10, [1.0, 0.0], None), (11, [1.0, 0.0, 0.0], 1), (None, [0.0, 1.0], 1), (None, [0.01, 1.0], 1), (12, [1e200, 1e190], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("id", "v", "h1", "rep", "m")})
    out = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in embed.link_groups(df).collect())
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r[0], []).append(r[1:])
    assert by[1] == [(3, 1, True)] and by[2] == [(3, 1, False)] * 2 and by[12] == [(3, 1, False)]
    for k in (3, 4, 5, 6, 7, 8, 9, 10, 11):
        assert by[k] == [(0, k, True)]
    assert by[-1] == [(1, None, True)] * 2  # rows without an id link with each other
    assert embed.link_groups(df.limit(0)).collect() == []
    # rows that share an id are vectors of their own
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (2, [0.0, 1.0], 0), (3, [0.01, 1.0], 0), (None, [1.0, 0.02], 0)]
    out = embed.link_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in out) == [(-1, 2, 1), (1, 2, 1), (2, 1, 2), (2, 2, 1), (3, 1, 2)]


def test_repeated_ids_with_other_texts_stay(spark):
    """Rows are dropped by themselves: one that shares its id with a copy or a toxic text, but not the text, stays."""
    rows = [(1, "One text that is a copy."), (1, "Another one, alone."), (2, "one text that is a COPY."), (9, "rep"), (9, "rep"), (9, "REP"), (None, "null"), (None, "null"), (None, "rep")]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], SCHEMA).repartition(3)
    left = sorted((r["doc_id"] or -1, r["text"].lower()) for r in exact.exact_dedup(df).collect())
    assert left == [(-1, "null"), (1, "another one, alone."), (2, "one text that is a copy."), (9, "rep")]
    groups = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_groups(df).collect()]
    assert sorted(g for g in groups if g[0] == 9) == [(9, 9, 4, False), (9, 9, 4, False), (9, 9, 4, True)] and (None, 9, 4, False) in groups and groups.count((None, None, 2, True)) == 1
    bad = np.unique([toxic.terms(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0] for w in (b"another", b"null")])
    machine = toxic.Machine(toxic.BITS, bad, -9.0, np.full(len(bad), 20.0), np.zeros((len(bad), 1)))
    assert sorted((r["doc_id"] or -1, r["text"]) for r in toxic.drop_toxic(df, machine).collect()) == sorted((i or -1, t) for i, t in rows if not t.startswith(("Another", "null")))


def test_heavy_keys_meet_by_broadcast(spark, monkeypatch):
    """Beyond the broadcast limit the same rows come out, hot keys aside."""
    from skeinframe.llm import _common

    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    side = _common.settle(df.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")), "side")
    small = sorted(map(tuple, _common.meet(df, side, ["k"], "n").collect()))
    large = sorted(map(tuple, _common.meet(df, side, ["k"], "n", limit=0).select(*_common.meet(df, side, ["k"], "n").columns).collect()))
    assert small == large and len(small) == 3000
    order = _common.numbered(df.select("id"), F.col("id").desc(), "place", limit=0)
    assert all(r["id"] + r["place"] == 2999 for r in order.collect())
    rows = spark.createDataFrame(ROWS, SCHEMA)
    whole = {name: sorted(map(str, OPERATORS[name](rows).collect())) for name in ("exact_groups", "exact_dedup", "near_groups", "near_dedup", "mix_sizes")}
    monkeypatch.setattr(_common.few, "__defaults__", (0,))
    monkeypatch.setattr(_common.meet, "__defaults__", (0, "inner"))
    monkeypatch.setattr(_common.attach, "__defaults__", (0,))
    monkeypatch.setattr(_common.numbered, "__defaults__", (0,))
    assert {name: sorted(map(str, OPERATORS[name](rows).collect())) for name in whole} == whole


def test_settled_tables_go(spark):
    from skeinframe.llm import _common

    table = _common.settle(spark.range(3), "gone")
    path = table.settled_at.removeprefix("file://")
    assert __import__("os").path.exists(path)
    _common.forget(table, None)
    assert not __import__("os").path.exists(path)
