import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skeinframe.llm import bpe, components, embed, exact, langid, license, minhash, mixing, packing, queries, secrets, tokenfile, toxic
from tests.llm.conftest import text, tongues

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


ODD = ["", "a", "  ", "   a  b\n\n c", " it's we're I'll 've 'stop ''s \"'s\" a's' 'd", "x'", "'", "'s", "'re", "'r", "'l l", "1'll", "don't 　 x \t\n y ", "é'été 12½ ²", "日本語 テスト", "a\x85b\x1cc\x1d \x1e", "  lead", "trail  \n", "\n\n", "<|endoftext|> a", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "plain", "<|endoftext|", "x <|endoftext|>", "😀 'm😀", "a​b", "Ᲊ unassigned once", "w" * 5000 + " end"]


def library(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*e.ids, 0], "<u4") for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_batch_ids_are_the_librarys(corpus):
    texts = ODD + [r[1] for r in corpus]
    got = []
    for _ in range(2):  # the second time from the table
        got = []
        for _, _, ids, counts in bpe.load().column(pa.array(texts)):
            out, off = bpe.with_end(ids, counts, 0)
            got += [out[a:b].tolist() for a, b in zip(off[:-1], off[1:])]
    assert got == [x.tolist() for x in library(texts)]


def test_pretoken_classes():
    kinds, split = bpe.load().kinds, bpe.load().tokenizer.pre_tokenizer.pre_tokenize_str
    for c in [*range(1, 0x3400, 7), *range(0xA000, 0x11000, 31)]:
        if 0xD800 <= c < 0xE000 or kinds[c] == bpe.UNKNOWN or c == 0x20:
            continue
        spans = [s for _, s in split(f"a{chr(c)}1")]
        assert spans == {bpe.LETTER: [(0, 2), (2, 3)], bpe.NUMBER: [(0, 1), (1, 3)]}.get(int(kinds[c]), [(0, 1), (1, 2), (2, 3)]), hex(c)


def test_automata():
    a = license.Automaton("under the <<beginOptional>> terms of the <<endOptional>> <<alt;x|mit>> license <<var;match=1-2>> end")
    w = lambda t: [license._common.word_hash(x) for x in t.split()]
    assert a.accepts(w("under the mit license one end"))
    assert a.accepts(w("under the terms of the x license one two end more"))
    assert not a.accepts(w("under the terms of mit license one end"))
    assert not a.accepts(w("under the mit license end"))
    assert not a.accepts(w("under the mit license a b c end"))


def test_license(docs, corpus):
    rows = {r["doc_id"]: r for r in license.scan(docs).collect()}
    for i, t, _, _ in corpus:
        words, starts, labels = WORD.findall(low(t)), [], set()
        for phrase, label in license.BASE:
            p = phrase.split()
            for k in range(len(words) - len(p) + 1):
                if words[k : k + len(p)] == p:
                    starts.append(k)
                    labels.add(label)
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
    assert rows[3]["labels"] == "mit" and rows[4]["labels"] == "apache-2" and rows[4]["score"] == 1.0


def test_whole_licenses(spark):
    """Each template's own text, with its optional parts and without, is found as it is and not with a mandatory word changed."""
    rng, texts = random.Random(5), []
    for markup, label in license.TEMPLATES:
        for optional in (True, False):
            words, skipped = [], 0
            for mark, word in license._PART.findall(markup):
                kind, _, rest = mark.partition(";")
                skipped += (kind == "beginOptional") - (kind == "endOptional")
                if kind in ("beginOptional", "endOptional") or skipped and not optional:
                    continue
                words += ["some"] * int(rest.removeprefix("match=").split("-")[1]) if kind == "var" else [rest.split("|")[0]] if kind == "alt" else [word]
            texts.append((label, words))
            own = license.Automaton(markup)
            hashes = [license._common.word_hash(w) for w in words]
            assert own.accepts(hashes)
            fixed = [k for k, w in enumerate(words) if f" {w} " in f" {markup} " and "<<" not in w and w not in ("some",)]
            if not optional and len(fixed) == len(words):
                k = rng.choice(fixed)
                assert not own.accepts([*hashes[:k], 1, *hashes[k + 1 :]])
    df = spark.createDataFrame([(i, "Intro. " + ", ".join(w.capitalize() for w in words) + " End.") for i, (_, words) in enumerate(texts)], "doc_id long, text string")
    for r in license.scan(df).collect():
        assert texts[r["doc_id"]][0] in r["labels"].split(",") and r["score"] == 1.0


def test_exact(docs, corpus):
    rows = {r["doc_id"]: r for r in exact.exact_groups(docs).collect()}
    groups = defaultdict(list)
    for i, t, _, _ in corpus:
        groups[hashlib.sha256(low(t).encode()).hexdigest()].append(i)
    for digest, ids in groups.items():
        for i in ids:
            r = rows[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(ids), len(ids), i == max(ids), digest)
    assert sorted(r["doc_id"] for r in exact.exact_dedup(docs).collect()) == sorted(max(x) for x in groups.values())


def test_exact_heavy_groups(spark):
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "warm").otherwise(F.col("id").cast("string")).alias("text"))
    out = exact.exact_groups(df.repartition(6), share=1 / 100)
    assert out.where("text_sha256 = sha2('hot', 256)").agg(F.count("*"), F.min("group_size"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first()[:] == (3000, 3000, 8997, 1)
    assert out.where("group_size = 1").count() == out.where("group_size = 1 and kept").count() > 0


def test_mixing(docs, corpus):
    rows = mixing.mix_sizes(docs).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_sizes(docs.repartition(3)).collect()}
    sizes, taken, target = Counter(), Counter(), {}
    source = {r[0]: r[3] for r in corpus}
    for r in rows:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"] and again[r["doc_id"]] == r["taken"]
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    for s in sizes:
        assert target[s] <= 3 * sizes[s] + 1e-9 and abs(taken[s] - target[s]) <= 80
    expanded = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert all(expanded[r["doc_id"]] * r["size"] == r["taken"] for r in rows)


def test_mixing_draws(spark):
    """Each document is copied with its source's fraction, over many seeds; sums stay within one document; rows without an id count."""
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 9)), "a") for i in range(12)] + [(50, "x " * 7, "b")] + [(None, "ten words " * 5, "c")] * 9 + [(60, "twice twice", "d"), (60, "twice twice", "d"), (60, "other text of it", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    seeds, taken = 10, Counter()
    for seed in range(seeds):
        got = mixing.mix_sizes(docs, seed=seed).collect()
        assert len(got) == len(rows)
        sums, targets, largest = Counter(), {}, Counter()
        for r in got:
            sums[r["source_size"]] += r["taken"]
            targets[r["source_size"]], largest[r["source_size"]] = r["target"], max(largest[r["source_size"]], r["size"])
            taken[r["doc_id"], r["size"]] += r["taken"] / r["size"]
        assert all(abs(sums[s] - targets[s]) <= largest[s] + 1e-6 for s in targets)
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abcd"}
    number = Counter((i, len(t.split())) for i, t, _ in rows)
    for (i, n), total in taken.items():
        s = next(x for j, t, x in rows if j == i and len(t.split()) == n)
        rate = targets[size[s]] / size[s]
        part = rate - int(rate + 1e-12)
        mean = number[i, n] * seeds * rate
        assert abs(total - mean) <= 3.5 * (number[i, n] ** 2 * seeds * part * (1 - part)) ** 0.5 + 1e-6
    expanded = Counter((r["doc_id"], r["text"]) for r in mixing.mix(docs).collect())
    sizes = Counter()
    for r in mixing.mix_sizes(docs).collect():
        sizes[r["doc_id"], r["size"]] += r["taken"] // r["size"]
    assert {(i, len(t.split())): n for (i, t), n in expanded.items()} == {k: n for k, n in sizes.items() if n}


def test_mixing_in_buckets(spark, monkeypatch):
    """Small hash buckets and windows give what one order of the whole source gives."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 3 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 5 == 0, "b").otherwise("c").alias("source"))
    whole = sorted(map(tuple, mixing.mix_sizes(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    monkeypatch.setattr(mixing._common, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, mixing.mix_sizes(docs).collect())) == whole


def test_targets_are_reshared(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 1), (None, 500)], "src string, size long")
    got = {r["src"]: r["target"] for r in mixing.source_rates(df).collect()}
    weight, size = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, {"a": 10, "b": 1000, "c": 1000, "d": 1, None: 500}
    full = set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in full)
        share = {s: 3 * size[s] if s in full else rest * weight[s] / sum(weight[x] for x in weight if x not in full) for s in weight}
        over = {s for s in share if s not in full and share[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    assert got == pytest.approx(share)


def near_by_brute_force(rows, by_class):
    """Of (id, text) each place's class by the smallest place in it: all pairs by weighted similarity, with df over all rows, then also with df over the first of each class."""
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t))
        sets.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    n = len(rows)
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _ in range(1 + by_class):
        df = Counter(s for k in range(n) if root(k) == k for s in sets[k])
        idf = lambda s: np.log1p(n / max(df[s], 1))
        for a in range(n):
            for b in range(a):
                if root(a) != root(b) and sets[a].keys() & sets[b].keys():
                    both = sum(min(sets[a][s], sets[b][s]) * idf(s) for s in sets[a].keys() & sets[b].keys())
                    every = sum(max(sets[a][s], sets[b][s]) * idf(s) for s in sets[a].keys() | sets[b].keys())
                    if both >= 0.8 * every:
                        x, y = sorted((root(a), root(b)))
                        parent[y] = x
    return [root(k) for k in range(n)]


@pytest.mark.parametrize("by_class", [False, True])
def test_near_duplicates(docs, corpus, by_class):
    want = near_by_brute_force([r[:2] for r in corpus], by_class)
    got = minhash.near_groups(docs, by_class=by_class).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {corpus[k][0]: corpus[root][0] for k, root in enumerate(want)}
    assert {r["doc_id"] for r in got if r["kept"]} == {corpus[k][0] for k, root in enumerate(want) if k == root}


def test_registered_near_duplicates_and_their_stage(spark, tmp_path):
    """queries.op4_near_dedup and the pipeline's stage against brute force, over groups of edited copies and texts of one passage."""
    import corpus_pipeline

    rng = random.Random(12)
    words = lambda n, tag: [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]
    rows = [" ".join(words(rng.randint(5, 90), "a")) for _ in range(150)]
    for _ in range(8):  # copies with edits of their own
        base = words(rng.randint(40, 120), "b")
        for _ in range(rng.randint(2, 9)):
            new = list(base)
            for _ in range(rng.randint(0, 2)):
                new[rng.randrange(len(new))] = f"edit{rng.randrange(10**6)}"
            rows.append(" ".join(new))
    passage = words(56, "p")
    rows += [" ".join(words(4, "own") + passage) for _ in range(25)]
    rows = list(enumerate([*rows, "", None, " . "]))
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    want = near_by_brute_force([(i, t or "") for i, t in rows], True)
    got = queries.op4_near_dedup(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == list(enumerate(want))
    left = corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == sorted(((i, t) for i, t in rows if want[i] == i), key=lambda r: r[0])


def test_a_shared_passage_makes_no_copies(spark):
    """Texts of four words of their own and 56 that all of them share stay, among other texts and alone."""
    passage = " ".join(f"p{k}" for k in range(56))
    own = lambda n: [(i, " ".join(f"own{i}x{k}" for k in range(4)) + " " + passage) for i in range(n)]
    others = [(1000 + i, " ".join(f"o{i}x{k}" for k in range(30))) for i in range(2000)]
    for rows, n in ((own(40) + others, 40), (own(300), 300)):
        kept = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).where("doc_id < 1000").count()
        assert kept == n


def test_document_frequencies(spark, monkeypatch):
    """Counters, moved in many small pieces, against a Counter; the table gives every shingle's idf."""
    monkeypatch.setattr(minhash, "HELD", 50)
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    df, hashes = Counter(), {}
    for t in texts:
        b = np.frombuffer(t.encode(), np.uint8)
        h = minhash.shingles(b, np.array([0, len(b)]), 2)[0]
        df.update(h.tolist())
    pieces = minhash.counters(spark.createDataFrame([(t, 1) for t in texts], "t string, n int").repartition(3), 2, 8)
    for least in (1.0, 30.0):
        table = minhash.frequencies(pieces, least)
        assert table.agg(F.sum("n")).first()[0] == sum(c > least for c in df.values())
        idf = minhash.idf_table(table, 200, least, 8)
        idf.__setstate__(idf.__getstate__())
        names = np.array(sorted(df), np.uint64)
        want = np.array([np.log(np.log1p(200 / max(df[int(h)], least))) for h in names])
        assert np.abs(idf(names) - want).max() < 0.02


def test_rows_are_told_apart_by_themselves(spark):
    """Near copies that share ids with other texts, repeated rows, and rows without an id."""
    base = " ".join(f"n{k}" for k in range(60))
    rows = [(7, base), (7, "a text of its own that is like no other one here"), (3, base + " more"), (None, base + " less"), (None, "alone and without any id at all, it stays"), (9, base), (9, base)]
    rows += [(100 + i, " ".join(f"q{i}x{k}" for k in range(30))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for options in ({}, {"by_class": True}):
        got = minhash.near_groups(df, **options).collect()
        assert sorted((r["doc_id"] or -1, r["class_id"] or -1, r["kept"], r["class_size"]) for r in got if (r["doc_id"] or 0) < 100) == sorted([(-1, 3, False, 5), (-1, -1, True, 1), (3, 3, True, 5), (7, 3, False, 5), (7, 7, True, 1), (9, 3, False, 5), (9, 3, False, 5)])
    left = Counter((r["doc_id"], r["text"]) for r in minhash.near_dedup(df).collect())
    assert left == Counter([rows[1], rows[2], rows[4], *rows[7:]])
    twice = spark.createDataFrame([(1, base), (1, base), (2, base + " x")], "doc_id long, text string")
    assert [tuple(r) for r in minhash.near_dedup(twice).collect()] == [(1, base)]


def test_near_duplicate_chains(spark):
    """A chain of texts, each like its neighbours but not like the first, and a large group of near copies in small blocks."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words = words[2:] + [f"x{i}", f"y{i}"]
    base = [f"b{k}" for k in range(80)]
    rows += [(1000 + i, " ".join(base) + f" t{i}") for i in range(300)]
    out = {r["doc_id"]: r["class_id"] for r in minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {v for k, v in out.items() if k < 1000} == {0} and {v for k, v in out.items() if k >= 1000} == {1000}


def test_near_duplicates_in_large_groups(spark, tmp_path):
    """A third of the rows are copies of a text: with edits of their own, which weigh more than what all share, as brute force has
    it, or exact ones beside two that only weights over classes join."""
    rng = random.Random(8)
    plain = lambda i: " ".join(f"p{i}x{k}" for k in range(60))
    base = [f"b{k}" for k in range(300)]
    edited = []
    for i in range(100):
        words = list(base)
        for k in (rng.randrange(10, 90), rng.randrange(110, 190), rng.randrange(210, 290)):
            words[k] = f"e{i}y{k}"
        edited.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(edited)] + [(1000 + i, plain(i)) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r["class_id"] for r in queries.op4_near_dedup(spark, str(tmp_path)).collect()}
    assert out == {rows[k][0]: rows[root][0] for k, root in enumerate(near_by_brute_force(rows, True))} and all(out[1000 + i] == 1000 + i for i in range(200))
    thrice = " ".join(base[:100] * 3)
    rows = [(i, thrice) for i in range(98)] + [(98 + j, thrice + "".join(f" o{j}z{k}" for k in range(20))) for j in range(2)] + rows[100:]
    kept = {r["doc_id"] for r in minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert kept == {0, *range(1000, 1200)}


def test_near_copies_in_large_groups_of_large_tables(spark, tmp_path):
    """Of 20,000 texts 20 are copies of one, each with edits of its own, any two 0.82 alike in plain similarity: one class, as the text of a
    thousandth of the table is no commonplace. Texts that share a passage which more of the table holds stay apart."""
    base = [f"b{k}" for k in range(300)]
    rows = [(i, " ".join(f"e{i}y{k}" if k in (5 * i + 2, 5 * i + 102, 5 * i + 202) else w for k, w in enumerate(base))) for i in range(20)]
    passage = " ".join(f"p{k}" for k in range(56))
    rows += [(100 + i, " ".join(f"own{i}x{k}" for k in range(4)) + " " + passage) for i in range(400)]
    others = spark.range(1000, 1000 + 20_000 - len(rows)).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("o"), "id", F.lit(f"x{k}")) for k in range(7)]).alias("text"))
    spark.createDataFrame(rows, "doc_id long, text string").unionByName(others).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r["class_id"] for r in queries.op4_near_dedup(spark, str(tmp_path)).collect()}
    assert {i: c for i, c in out.items() if c != i} == dict.fromkeys(range(1, 20), 0) and len(out) == 20_000


def test_sampling_matches_similarity():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 1 << 63, 600, dtype=np.uint64)
    a, b = np.sort(h[:500]), np.sort(h[100:])
    wa, wb = (np.exp(rng.normal(0, 0.7, 500)).astype(np.float32) for _ in range(2))
    both = np.intersect1d(a, b)
    ia, ib = np.searchsorted(a, both), np.searchsorted(b, both)
    low_ = np.minimum(wa[ia], wb[ib]).sum()
    true = low_ / (wa.sum() + wb.sum() - low_)
    s = minhash.Sampler(4000, 1)
    got = (s(a, np.log(wa), np.array([0, 500])) == s(b, np.log(wb), np.array([0, 500]))).mean()
    assert abs(got - true) < 0.03


def test_packing(docs, corpus):
    ids = {r[0]: x for r, x in zip(corpus, library([r[1] for r in corpus]))}
    for size, windows in ((1024, 64), (64, 3)):
        pieces = packing.pack(docs, size=size, open_windows=windows).collect()
        by_doc, by_window = defaultdict(list), defaultdict(list)
        for p in pieces:
            whole = ids[p["doc_id"]]
            assert p["doc_tokens"] == len(whole) and p["ids_crc32"] == zlib.crc32(whole[p["start"] : p["start"] + p["length"]].tobytes())
            by_doc[p["doc_id"]].append((p["start"], p["length"]))
            by_window[p["sequence_id"]].append((p["offset"], p["length"]))
        assert set(by_doc) == set(ids)
        for i, spans in by_doc.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
            assert at == len(ids[i])
        for spans in by_window.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= size
        assert len(by_window) * size <= 1.1 * sum(map(len, ids.values())) + size


def test_embedding_groups(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 16))
    near = base[:40] + rng.normal(size=(40, 16)) * 0.05
    crowd = base[0] + rng.normal(size=(120, 16)) * 0.02
    vectors = np.concatenate([base, near, crowd, base[:10]])
    labels = rng.integers(0, 3, len(vectors))
    labels[190:310] = 1
    df = spark.createDataFrame([(i, [float(x) for x in v], int(k)) for i, (v, k) in enumerate(zip(vectors, labels))], "vec_id long, embedding array<double>, label int").repartition(4)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.98) & (labels[:, None] == labels) & ~np.eye(len(vectors), dtype=bool)
    a, b = np.nonzero(link)
    root = components.roots(a, b, len(vectors))
    old = embed.BLOCK
    for block in (old, 16):
        embed.BLOCK = block
        try:
            out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed.link_groups(df).collect()}
        finally:
            embed.BLOCK = old
        assert out == {i: (int(link[i].sum()), int(root[i]), int(root[i]) == i) for i in range(len(vectors))}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(300)] + [(5, 5)]
    out = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert out == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_few_edges_are_few_jobs(spark):
    """Small graphs end in one task; the rounds give the same, alone or before it."""
    rng = random.Random(4)
    edges = spark.createDataFrame([(rng.randrange(10**6), rng.randrange(10**6)) for _ in range(3000)] + [(10**7 + i, 10**7 + i + 1) for i in range(500)], "a long, b long").repartition(7)
    sc = spark.sparkContext
    sc.setJobGroup("components", "")
    out = sorted(components.components(edges).collect())
    jobs = len(sc.statusTracker().getJobIdsForGroup("components"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 6
    for few in (0, 200):
        assert sorted(components.components(edges, few).collect()) == out


def test_secrets(docs, corpus):
    rows = {r["doc_id"]: r for r in secrets.digest(secrets.scan(docs)).collect()}
    for i, t, _, _ in corpus:
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate([("assign", secrets.ASSIGN, 2, 12), ("access", secrets.ACCESS, 0, 18), ("hex", secrets.HEX, 0, 16)]) for m in p.finditer(t) if len(m.group(g)) >= least)
        listed = [(("assign", "access", "hex")[k], a, b) for a, k, b in spans]
        r = rows[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[0] == k for x in listed) for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == secrets.sha256_of(listed)
        assert all(f"{k}:{a}:{b}" in r["spans"].split(",") for k, a, b in listed)
    assert "format:" in rows[5]["spans"] and rows[3]["n_hex"] == 1 and rows[3]["n_assign"] == 1 and rows[4]["n_access"] == 1


def test_inferred_formats(spark):
    rng = random.Random(9)
    keys = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(300)]
    words = ["".join(rng.choices(["heit", "lich", "tion", "ment"], k=rng.randint(4, 7))) for _ in range(300)]
    docs = spark.createDataFrame([(f'see token = "{k}" and {w}, then',) for k, w in zip(keys, words)], "text string").repartition(3)
    model = secrets.fit(docs)
    held = secrets.labelled_credentials(100, seed=50)
    assert np.mean([model.judge(x)[1] for x in held]) > 0.9
    assert np.mean([model.judge("".join(rng.choices("0123456789abcdef", k=40)))[1] for _ in range(200)]) > 0.9
    for plain in ("internationalization", "this_is_not_a_secret_at_all", "some-long-hyphenated-word", "heitlichtionment", "deadbeefheitlich"):
        assert not model.judge(plain)[1] and not secrets.model_spans(plain, model)
    # found from its own start, as long as it is, wherever it is glued to
    key = held[0]
    for before, after in (("", ""), ("key_", ""), ("a/b.", "/end"), ("x-", ".")):
        assert [(a, b) for a, b, _ in secrets.model_spans(before + key + after, model)] == [(len(before), len(before + key))]
    states = sum(len(set(x)) for x in (held,)) * 20
    assert len(model.credentials) < states / 10


def brute_score(text, model):
    """By recursion over the automaton."""

    def go(s, at):
        if not s:
            return model[at][0]
        step = model[at][1].get(s[0])
        return -np.inf if step is None else step[0] + go(s[1:], step[1])

    return go(secrets.symbols(text), 0) / (len(text) + 1)


def test_candidates_against_brute_force():
    """Every part of a run between marks is scored; from the left the longest that is taken wins."""
    model = secrets.default_model()
    held = secrets.labelled_credentials(3, seed=12)
    for run in ["a-" + "_".join(held[k::7][:2]) + ".z" for k in range(7)] + ["no_secret-in.here/at=all", "AIza" * 12]:
        starts = [i for i in range(len(run)) if i == 0 or run[i - 1] in secrets.MARK]
        want, upto = [], 0
        for i in starts:
            if i < upto:
                continue
            ends = [j for j in range(i + secrets.LEAST, len(run) + 1) if j == len(run) or run[j] in secrets.MARK]
            taken = [j for j in ends if brute_score(run[i:j], model.credentials) >= max(secrets.LEAST_SCORE, brute_score(run[i:j], model.plain) + secrets.MARGIN)]
            if taken:
                want.append((i, max(taken)))
                upto = max(taken)
        assert [(a, b) for a, b, _ in secrets.model_spans(run, model)] == want
        for a, b, own in secrets.model_spans(run, model):
            assert own == pytest.approx(brute_score(run[a:b], model.credentials))


def unseen_credentials(rng):
    """One of each of some public formats that no automaton has learned."""
    letters, hexa = secrets.UPPER + secrets.LOWER, "0123456789abcdef"
    of = lambda a, k: "".join(rng.choices(a, k=k))
    mixed = letters + secrets.DIGITS
    return ["ghs_" + of(mixed, 36), "dop_v1_" + of(hexa, 64), "hf_" + of(letters, 34), "shpat_" + of(hexa, 32), f"SG.{of(mixed, 22)}.{of(mixed, 43)}", f"eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.{of(mixed, 50)}.{of(mixed, 43)}"]


def test_shapes_of_unseen_formats(spark):
    rng = random.Random(21)
    keys = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(100)]
    model = secrets.fit(spark.createDataFrame([(f'token = "{k}" internationalization and-some-hyphenated-word',) for k in keys], "text string"))
    unseen = [k for _ in range(40) for k in unseen_credentials(rng)]
    assert np.mean([any(b - a >= len(k) / 2 for a, b, _ in secrets.shape_spans(k, model, [])) for k in unseen]) > 0.9
    plain = [*secrets.plain_strings(100, seed=60), "internationalization", "this_is_not_a_secret_at_all", "https/docs.example.org/3/library/index.html", "2024-01-15T10.30.00", "user_id_to_name_map_v2"]
    assert np.mean([bool(secrets.shape_spans(x, model, [])) for x in plain]) < 0.01
    # through the scan, whole texts; what is a format or a base span's secret is no shape besides
    texts = [f"see {unseen[0]}, then", f"key {secrets.labelled_credentials(1, seed=5)[0]}", f"token={unseen[0]}", "", None, "plain words-and-more_words only"]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["found"]] for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model=model).collect()}
    assert got[0] == [("shape", 4, 4 + len(unseen[0]))] and [k for k, *_ in got[1]] == ["format"] and [k for k, *_ in got[2]] == ["assign"] and not (got[3] or got[4] or got[5])


def test_shapes_against_brute_force():
    """Outside what is taken, from the left, the longest part between marks whose mean passes the plain shapes' by the margin; a part that falls far behind ends the search from its start."""
    model, rng = secrets.default_model(), random.Random(8)

    def mean(text, automaton, ends=True):
        at, total = 0, 0.0
        for c in secrets.symbols(text, 0):
            total, at = total + automaton[at][1][c][0], automaton[at][1][c][1]
        return (total + automaton[at][0]) / (len(text) + 1) if ends else total

    for state in (*model.shapes, *model.plain_shapes):
        assert len(state[1]) == 11 and np.exp(state[0]) + sum(np.exp(p) for p, _ in state[1].values()) == pytest.approx(1)
    for _ in range(60):
        run = rng.choice("_-.").join(rng.sample(unseen_credentials(rng) + secrets.plain_strings(1, seed=rng.randrange(99)), 2))
        cut = sorted(rng.sample(range(len(run) + 1), 2)) if rng.random() < 0.5 else None
        taken = [tuple(cut)] if cut and cut[0] < cut[1] else []
        want, upto = [], 0
        for i in range(len(run)):
            stop = min((a for a, b in taken if b > i), default=len(run))
            if i < upto or i >= stop or run[i] in secrets.MARK or not (i == 0 or run[i - 1] in secrets.MARK):
                continue
            ends = []
            for j in range(i + 1, stop + 1):
                if mean(run[i:j], model.shapes, False) - mean(run[i:j], model.plain_shapes, False) < -secrets.BEHIND:
                    break
                ahead = (mean(run[i:j], model.shapes) - mean(run[i:j], model.plain_shapes)) * (j - i + 1)
                if j - i >= secrets.LEAST and run[j - 1] not in secrets.MARK and (j == stop or run[j] in secrets.MARK) and ahead >= secrets.SHAPE_MARGIN * (j - i + 1):
                    ends.append(j)
            if ends:
                want.append((i, max(ends)))
                upto = max(ends)
        got = secrets.shape_spans(run, model, taken)
        assert [(a, b) for a, b, _ in got] == want
        assert all(own == pytest.approx(mean(run[a:b], model.shapes)) for a, b, own in got)


def test_toxicity_learns_words_and_pairs(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(3000):
        kind = i % 6
        body = text(rng, 40).rstrip(".").split()
        toxic_ = kind == 0
        extra = {0: ["vile", "group"] if i % 12 else ["scumword"], 1: ["vile"], 2: ["group"]}.get(kind, [])
        for w in extra:
            body.insert(rng.randrange(len(body)), w)
        rows.append((i, " ".join(body)))
        labels.append((i, int(toxic_)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    machine = toxic.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = {r["doc_id"]: r for r in toxic.score(docs, machine).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in out.items() if r["held_out"]} == set(held)
    right = [out[i]["predicted"] == y for i, y in labels if out[i]["held_out"]]
    assert np.mean(right) > 0.97
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in out.values())
    left = {r["doc_id"] for r in toxic.drop_toxic(docs, machine).collect()}
    assert left == {i for i, r in out.items() if r["predicted"] == 0}


def test_toxicity_learns_what_single_words_dont_say(spark):
    """Two words, each neutral alone: the label is whether both or neither are there."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(300)}" for _ in range(30)] + ["alpha"] * a + ["bravo"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(a == b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = {r["doc_id"]: r for r in toxic.score(docs, toxic.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()}
    assert np.mean([out[i]["predicted"] == y for i, y in labels if out[i]["held_out"]]) >= 0.95


def test_toxicity_of_long_texts():
    """Long texts of a few syllables aren't flagged for their length, and no clean text scores above the toxic ones, in whatever order they are learned from."""
    rows = tongues(random.Random(2), 1400)
    labels = np.array([y for _, y in rows])
    buf, off = np.frombuffer("".join(t for t, _ in rows).encode(), np.uint8), np.cumsum([0, *(len(t) for t, _ in rows)])
    hashed, first = toxic.terms(buf, off)
    texts = [toxic.levelled(hashed[a:b]) for a, b in zip(first[:800], first[1:801])]
    for seed in range(4):
        score = toxic.learn(texts, labels[:800], seed=seed).scores(buf, off)[800:]
        bad, clean = score[labels[800:] == 1], score[labels[800:] == 0]
        assert (bad >= 0.5).mean() >= 0.95 and (clean < 0.5).mean() >= 0.95
        assert (bad > np.quantile(clean, 0.99)).mean() >= 0.95


def test_scores_against_all_pairs():
    """A score is the bias, the weights, and the products of every pair of different terms."""
    rng = np.random.default_rng(4)
    texts = ["vile group vile group again", "group", "", "a b c d e f g h"]
    names = np.unique(np.concatenate([toxic.levelled(toxic.terms(b, np.array([0, len(b)]))[0]) for b in (np.frombuffer(t.encode(), np.uint8) for t in texts)]))
    names = names[rng.random(len(names)) < 0.7]
    machine = toxic.Machine(toxic.BITS, names, -0.3, rng.normal(size=len(names)), rng.normal(size=(len(names), 3)) / 3)
    buf, off = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    for t, got in zip(texts, machine.scores(buf, off)):
        b = np.frombuffer(t.encode(), np.uint8)
        own = toxic.levelled(toxic.terms(b, np.array([0, len(b)]))[0])
        at = [int(np.flatnonzero(names == x)[0]) for x in own if x in names]
        margin = -0.3 + sum(machine.weight[i] for i in at) + sum(machine.factor[i] @ machine.factor[j] for n, i in enumerate(at) for j in at[:n])
        assert got == pytest.approx(1 / (1 + np.exp(-margin)))


def test_toxicity_labels(spark):
    """Null and odd labels aren't learned from, an id with both counts as toxic, and the bytes that are learned from are bounded."""
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(i, "bad word" if i % 2 else "good word") for i in range(400)] + [(None, "bad"), (1, None)], schema)
    odd = [(i, i % 2) for i in range(400)] + [(3, None), (None, 1), (5, 7), (2, 1), (2, 0)]
    machine = toxic.fit(docs, spark.createDataFrame(odd, "doc_id long, toxic int"), most=40_000)
    out = {r["doc_id"]: r["predicted"] for r in toxic.score(docs.where("doc_id > 5"), machine).collect()}
    assert out == {i: i % 2 for i in range(6, 400)}
    for labels in ([], [(i, 1) for i in range(9)], [(i, None) for i in range(9)]):
        machine = toxic.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r["score"] > 0.5 for r in toxic.score(docs, machine).collect()} == {bool(labels and labels[0][1])}


def test_elias_fano_block():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 500):
        sizes = rng.integers(1, 40, n)
        sizes[rng.integers(0, n)] = 5000
        ends = np.cumsum(sizes)
        ids = rng.integers(0, 50257, ends[-1]).astype(np.uint32)
        keys = [None] * (n // 3) + sorted(rng.integers(-(10**6), 10**6, n - n // 3).tolist())
        for bits in (16, 32):
            payload = tokenfile.encode(keys, ends, ids, bits)
            block = tokenfile.Block(payload)
            assert block.keys() == keys and (block.ids() == ids).all()
            first, last = block.bounds(np.arange(n))
            assert (last == ends).all() and (first == ends - sizes).all()
            some = np.sort(rng.choice(n, min(n, 7), replace=False))
            assert (block.bounds(some)[1] == ends[some]).all()
            assert all(k in block.find(keys[k]) for k in range(n // 3, n)) and not len(block.find(2 * 10**6)) and not len(block.find(-(2 * 10**6)))
    assert len(payload) - 4 * len(ids) < 500 * 8  # ids and ends of documents: less than one 64-bit table


def test_token_files(spark, docs, corpus):
    path = spark.conf.get("spark.checkpoint.dir") + "/token-test"
    tokenfile.write(docs, path, block_ids=500)
    rows = tokenfile.read(spark, path).orderBy("doc_id").collect()
    ids = library([r[1] for r in sorted(corpus)])
    starts = np.cumsum([0, *map(len, ids)])[:-1]
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows] == [(r[0], int(s), len(x), zlib.crc32(x.tobytes())) for r, s, x in zip(sorted(corpus), starts, ids)]
    got = {r["doc_id"]: r["ids"] for r in tokenfile.lookup(spark, path, [17, 250, 9999]).collect()}
    assert got == {i: ids[i].tolist() for i in (17, 250)}


def test_language(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, rng.randint(15, 80), lang), lang) for i in range(600) for lang in [("en", "fr", "de")[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    out = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in out.items() if r["held_out"]} == {i for i, _ in held}
    assert np.mean([out[i]["lang_pred"] == lang for i, lang in held]) > 0.95


def test_language_is_the_smallest_size(spark):
    """Against zstandard itself; of equal sizes the language with more known words."""
    import zstandard

    rng = random.Random(11)
    books = {lang: " ".join(text(rng, 60, lang) for _ in range(20)) for lang in ("en", "fr", "de")}
    books = {lang: langid.plain(t).encode() for lang, t in books.items()}
    model = langid.Model(books)
    for _ in range(60):
        t = text(rng, rng.randint(1, 30), rng.choice(["en", "fr", "de"]))
        raw = langid.plain(t).strip().encode()
        sizes = {}
        for lang in sorted(books):
            data = zstandard.ZstdCompressionDict(books[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[lang] = len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False).compress(raw))
        best = [lang for lang in sizes if sizes[lang] == min(sizes.values())]
        name, score, sure = model.predict(t)
        assert name in best and 0 <= score <= 1 and (not sure or len(best) == 1)
    rare = spark.createDataFrame([(i, f"w{i} word", f"lang{i}") for i in range(400)], "doc_id long, text string, lang string")
    learned = {f"lang{i}" for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(langid.fit(rare)) == learned  # however many and rare


def test_held_out_labels_are_not_learned(spark):
    rows = [(i, f"word{i} " * 20, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else "yy") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.fit(docs)) == {"yy"}


def test_registered_queries():
    assert sorted(queries.queries(), key=lambda n: int(re.match(r"op(\d+)_", n)[1]))[0].startswith("op1_") and len(queries.queries()) == 13
    assert set(queries.oracle_sql()) <= set(queries.queries())
