import contextlib
import io

from skeinframe.llm import embed, exact, license, mixing, secrets


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_exact_dedup_is_native_and_shuffles_no_text(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    text = plan(exact.exact_groups(spark.read.parquet(str(tmp_path / "d"))))
    assert not any(x in text for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
    assert "text#" not in text  # digests alone are read from here on


def test_scans_dont_shuffle(docs):
    for df in (license.scan(docs), secrets.digest(secrets.scan(docs))):
        text = plan(df)
        assert "MapInArrow" in text and "hashpartitioning" not in text


def test_mixing_is_native(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    text = plan(mixing.mix(spark.read.parquet(str(tmp_path / "d"))))
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text


def test_embeddings_have_no_cross_join(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(20)], "vec_id long, embedding array<double>, label int")
    text = plan(embed.link_groups(df))
    assert "Cartesian" not in text and "NestedLoop" not in text
