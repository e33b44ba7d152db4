"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinframe.llm import _common, embed, exact, langid, license, minhash, mixing, packing, repair, resample, search, secrets, sql, tokenfile, toxic


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), by_class=True)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.link_groups(table(spark, sf_dir, "embeddings"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, model=secrets.fit(docs)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic.score(docs, toxic.fit(docs, table(spark, sf_dir, "labels")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _common.new_path(spark, "token-ids")
    tokenfile.write(table(spark, sf_dir, "documents"), path)
    return tokenfile.read(spark, path)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op11_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "embeddings"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"), damage=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license, op2_mixing, op3_exact_dedup, op4_near_dedup, op5_packing, op6_embedding_dedup, op7_secrets, op8_toxicity, op9_token_files, op10_language, op11_exact_search, op12_resampling, op13_conversation_repair)}


_LOWER = f"translate(coalesce(text, ''), '{_common.AZ[0]}', '{_common.AZ[1]}')"


def _pattern(markup: str) -> str:
    """A template as a regular expression over words that a blank follows."""
    out = []
    for mark, word in re.findall(r"<<(.*?)>>|([^\s<>]+)", markup):
        kind, _, rest = mark.partition(";")
        if kind == "beginOptional":
            out.append("(?:")
        elif kind == "endOptional":
            out.append(")?")
        elif kind == "var":
            least, most = rest.removeprefix("match=").split("-")
            out.append(f"(?:[^ ]+ ){{{least},{most}}}")
        elif kind == "alt":
            out.append(f"(?:{rest}) ")
        else:
            out.append(f"{word} ")
    return "".join(out)


def _license_sql() -> str:
    base, full = {}, {}
    for markup, label in license.BASE:
        base.setdefault(label, []).append(f"regexp_matches(line, ' {_pattern(markup)}')")
    for markup, label in license.TEMPLATES:
        full.setdefault(label, []).append(f"regexp_matches(line, ' {_pattern(markup)}')")
    every = {k: base.get(k, []) + full.get(k, []) for k in sorted({*base, *full})}
    names = lambda hits: "concat_ws(',', " + ", ".join(f"CASE WHEN {' OR '.join(hits[k])} THEN '{k}' END" for k in sorted(hits)) + ")"
    places = " || ".join(f"list_filter(range(n_words), lambda i: list_slice(words, i + 1, i + {len(p.split())}) = {p.split()})" for p, _ in license.BASE)
    return f"""
        WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
        l AS (SELECT doc_id, words, len(words) AS n_words, ' ' || array_to_string(words, ' ') || ' ' AS line FROM w),
        p AS (SELECT *, {places} AS places FROM l)
        SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, {names(base)} AS base_labels, {names(every)} AS labels,
        CASE WHEN {' OR '.join(sum(full.values(), []))} THEN 1.0::DOUBLE WHEN len(places) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM p"""


ORACLES = {
    "op1_license": _license_sql(),
    "op2_mixing": """
        WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
            CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17:' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS z FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, CAST('0x' || substr(md5(coalesce(source, '') || ':17'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS start FROM d GROUP BY source),
        w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w, 3.0::DOUBLE * n AS cap, CAST(sum(n) OVER () AS DOUBLE) AS total FROM s),
        l AS (SELECT *, (total - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level FROM w
            WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT source, start, n AS source_size, least(cap, coalesce((SELECT arg_min(level, cap / w) FROM l WHERE level <= cap / w) * w, cap)) AS target FROM l),
        r AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size + 1e-12), 3) ELSE 0 END AS times FROM t),
        f AS (SELECT *, CASE WHEN times < 3 AND source_size > 0 THEN greatest(0.0::DOUBLE, target / source_size - times) ELSE 0.0::DOUBLE END AS fraction FROM r),
        n AS (SELECT source, size, count(*) AS n, sum(count(*)) OVER (PARTITION BY source ORDER BY size) AS upto FROM d GROUP BY source, size),
        k AS (SELECT n.source, n.size, floor(CAST(upto AS DOUBLE) * fraction + start) - floor(CAST(upto - n AS DOUBLE) * fraction + start) AS k FROM n JOIN f ON n.source IS NOT DISTINCT FROM f.source),
        x AS (SELECT *, row_number() OVER (PARTITION BY source, size ORDER BY z) AS place FROM d)
        SELECT x.doc_id, x.size, f.source_size, f.target, CAST(x.size * (f.times + CASE WHEN x.place <= k.k THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM x JOIN f ON x.source IS NOT DISTINCT FROM f.source JOIN k ON x.source IS NOT DISTINCT FROM k.source AND x.size = k.size""",
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
        FROM d JOIN g USING (text_sha256)""",
    "op11_exact_search": sql.SEARCH,
    "op12_resampling": sql.RESAMPLE,
    "op13_conversation_repair": sql.REPAIR,
    "op6_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
        parts AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN parts ON parts.a = v.vec_id LEFT JOIN counts ON counts.a = v.vec_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
