"""DuckDB's SQL for sampling by importance, for repair of conversations, and for search among vectors."""

from __future__ import annotations

from skeinframe.llm import _common

_LOWER = f"translate(coalesce(text, ''), '{_common.AZ[0]}', '{_common.AZ[1]}')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: A row with the CRC-32 of the 256 bytes' registers, and the CRC-32 of a string's UTF-8 bytes by it, byte after byte.
_CRC_TABLE = "(SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS crc_table FROM range(256) r(i))"
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(range(strlen({0})), lambda i: CAST('0x' || substr(hex(encode({0})), 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"


def _runs(words: str) -> str:
    """All runs of one to three words, a row each."""
    two, three = (" || ' ' || ".join(f"{words}[i + {k}]" for k in range(1, n + 1)) for n in (2, 3))
    return f"unnest(list_concat({words}, list_transform(range(greatest(len({words}) - 1, 0)), lambda i: {two}), list_transform(range(greatest(len({words}) - 2, 0)), lambda i: {three})))"


RESAMPLE = f"""
    WITH t AS {_CRC_TABLE},
    d AS (SELECT row_number() OVER () AS r, * FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
    fd AS (SELECT r, {_runs('w')} AS f FROM d), fb AS (SELECT {_runs('w')} AS f FROM (SELECT {_WORDS} AS w FROM benchmark)),
    n AS (SELECT f, sum(a) AS a, sum(b) AS b FROM (SELECT f, 1 AS a, 0 AS b FROM fd UNION ALL SELECT f, 0, 1 FROM fb) GROUP BY f),
    h AS (SELECT f, a, b, {_CRC.format('f')} % 10000 AS bucket FROM n, t),
    k AS (SELECT bucket, CAST(sum(a) AS DOUBLE) AS s, CAST(sum(b) AS DOUBLE) AS t FROM h GROUP BY bucket),
    g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM k),
    e AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM fd JOIN h USING (f) JOIN g USING (bucket) GROUP BY r),
    x AS (SELECT doc_id, len(w) >= 20 AS ok, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
        (CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM d LEFT JOIN e USING (r)),
    y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM x),
    z AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY score DESC, doc_id NULLS FIRST) AS place, 5 * count(*) OVER (PARTITION BY ok) // 100 AS drawn FROM y)
    SELECT doc_id, n_features, weight, score, CASE WHEN ok AND place <= drawn THEN place END AS rank FROM z"""

_INK = "regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '')"

REPAIR = f"""
    WITH RECURSIVE t AS {_CRC_TABLE},
    c AS (SELECT row_number() OVER () AS id, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
    k AS (SELECT id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("key")} % 20 AS k
        FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations) v JOIN c ON c.conv_id IS NOT DISTINCT FROM v.conv_id, t),
    d AS (SELECT id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE k <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, {_INK} AS ink FROM d),
    s AS (SELECT *, CASE WHEN ink = '' THEN 'b' WHEN row_number() OVER (PARTITION BY id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
        lag(role[1:1]) OVER (PARTITION BY id ORDER BY i) || role[1:1] AS pair FROM o),
    way(p, st, gap) AS (VALUES ('', 's', ''), ('', 'u', ''), ('', 'a', 'u'), ('s', 'u', ''), ('s', 'a', 'u'), ('u', 'u', 'a'), ('u', 'a', ''), ('a', 'u', ''), ('a', 'a', 'u')),
    act(edit, price) AS (VALUES ('D', 4), ('K', 0), ('R', 3)),
    best AS (
        SELECT id, CAST(0 AS BIGINT) AS i, '' AS st, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS turns FROM c
        UNION ALL
        SELECT id, i, st, b.cost, b.audit, b.turns FROM (
            SELECT id, i, st, min({{'cost': cost, 'audit': audit, 'turns': turns}}) AS b FROM (
                SELECT b.id, s.i, b.st, b.cost + 4 AS cost, b.audit || 'D' AS audit, b.turns FROM best b JOIN s ON s.id = b.id AND s.i = b.i + 1
                UNION ALL
                SELECT b.id, s.i, w.st, b.cost + price + CASE WHEN fault = 't' THEN 3 ELSE 0 END + 3 * strlen(gap), b.audit || repeat('I', strlen(gap)) || edit,
                    b.turns || CASE gap WHEN 'u' THEN 'user:' || chr(10) WHEN 'a' THEN 'assistant:' || chr(10) ELSE '' END || CASE WHEN edit = 'K' THEN role WHEN w.st = 'u' THEN 'user' ELSE 'assistant' END || ':' || text || chr(10)
                FROM best b JOIN s ON s.id = b.id AND s.i = b.i + 1 JOIN way w ON w.p = b.st JOIN act ON edit = 'K' AND role[1:1] = w.st OR edit = 'R' AND w.st <> 's'
                WHERE fault NOT IN ('b', 'd')) GROUP BY id, i, st)),
    n AS (SELECT id, count(*) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM s GROUP BY id),
    f AS (SELECT id, min({{'cost': cost + CASE st WHEN 's' THEN 6 WHEN 'u' THEN 3 ELSE 0 END, 'audit': audit || CASE st WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END,
        'turns': turns || CASE st WHEN 's' THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 'u' THEN 'assistant:' || chr(10) ELSE '' END}}) AS b
        FROM best LEFT JOIN n USING (id) WHERE i = coalesce(n, 0) GROUP BY id)
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.cost AS cost, b.audit AS audit,
        sha256(CASE WHEN b.turns = '' THEN '' ELSE left(b.turns, len(b.turns) - 1) END) AS repaired_sha256 FROM c JOIN f USING (id) LEFT JOIN n USING (id)"""

#: Integers up to 2^53 are exact in doubles.
SEARCH = """
    WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
    SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
