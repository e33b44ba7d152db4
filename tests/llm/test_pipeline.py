"""The pipeline's stages against brute force on a small corpus."""

import hashlib
import random
import re

import pytest

from tests.llm.conftest import tongues

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    insult = lambda i: " You pathetic worthless scumbag." if i % 9 == 0 else ""
    rows = [(i, t + insult(i), lang, source, len(t)) for i, t, lang, source in corpus]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] % 9 == 0)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), {r[0]: r for r in rows}


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/out-{name}")
        docs = spark.read.parquet(f"{path}/out-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        seen[name] = docs
    clean = {r["doc_id"] for r in seen["toxicity"].collect()}
    right = sum((i in clean) == (i % 9 != 0) for i in rows)
    assert right >= 0.97 * len(rows) and all(i in clean for i in rows if i % 9)
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t)
    best = {}
    for i in clean:
        key = hashlib.sha256(low(rows[i][1]).encode()).digest()
        best[key] = max(best.get(key, -1), i)
    unique = {r["doc_id"] for r in seen["exact_dedup"].collect()}
    assert unique == set(best.values())
    apart = {r["doc_id"] for r in seen["near_dedup"].collect()}
    assert apart < unique
    mixed = seen["mix_sources"].collect()
    assert {r["doc_id"] for r in mixed} <= apart
    pieces = seen["pack_windows"].collect()
    assert sum(p["length"] == min(1024, p["doc_tokens"] - p["start"]) for p in pieces) == len(pieces)
    assert sum(p["start"] == 0 for p in pieces) == len(mixed)


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mix_sources", "pack_windows"]


def test_toxicity_of_long_texts(spark, tmp_path):
    """Toxic texts go and clean ones stay in a language of long texts, whose words share a few syllables."""
    rows = list(enumerate(tongues(random.Random(4), 1000)))
    spark.createDataFrame([(i, t) for i, (t, _) in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, (_, y) in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.toxicity(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    for label in (0, 1):
        some = [i for i, (_, y) in rows if y == label]
        assert sum((i in kept) == (label == 0) for i in some) >= 0.95 * len(some)
