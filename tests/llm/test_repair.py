import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from skeinframe.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
WELL = re.compile("(s?(ua)+)?")


def damage(rows):
    out = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if k:
            row = (c, t, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x)
            out += [row] * (2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        ink = re.sub("[\x20\x09-\x0d]", "", x)
        out.append("b" if not ink else "d" if (r, x) in seen else "t" if ink[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def cheapest(rows, flaws):
    """By trying all edits: (cost, audit, repaired), of rows up to a handful."""
    best = None
    n = len(rows)
    for edits in itertools.product("DKR", repeat=n):
        if any(e != "D" and f in ("b", "d") and f for e, f in zip(edits, flaws)):
            continue
        for new in itertools.product(["user", "assistant"], repeat=edits.count("R")):
            roles, kept = iter(new), []
            for e, row in zip(edits, rows):
                kept.append(None if e == "D" else (row[2] if e == "K" else next(roles), row[3]))
            base = sum(4 if e == "D" else (3 if e == "R" else 0) + (3 if f == "t" else 0) for e, f in zip(edits, flaws))
            # insertions before each row and at the end, up to two of them: with more it costs more
            for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=n + 1):
                many = sum(map(len, gaps))
                if many > n + 2 or best and base + 3 * many > best[0]:
                    continue
                out, audit = [], ""
                for k in range(n + 1):
                    out += [({"u": "user", "a": "assistant"}[g], "") for g in gaps[k]]
                    audit += "I" * len(gaps[k]) + (edits[k] if k < n else "")
                    if k < n and kept[k]:
                        out.append(kept[k])
                if all(r for r, _ in out) and WELL.fullmatch("".join(r[0] for r, _ in out)):
                    found = base + 3 * many, audit, "\n".join(f"{r}:{x}" for r, x in out)
                    best = found if best is None else min(best, found)
    return best


def brute(rows, hurt):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        mine = damage(mine) if hurt else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in mine]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        flaws = faults(mine)
        turns = {r[1] for r in mine} - {None}
        pairs = [(a[2][:1] + b[2][:1]) for a, b in zip(mine, mine[1:])]
        cost, audit, repaired = cheapest(mine, flaws)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(flaws.count(f) for f in "bdt"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(repaired.encode()).hexdigest())
    return out


def got(df, **more):
    rows = repair.repair(df, **more).collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("hurt", [False, True])
def test_against_all_sequences_of_edits(spark, hurt):
    rng = random.Random(7)
    texts = ["Yes.", "No!", "Why?", "cut", "", " \t\n", "Good. ", "more \x0b", "é?", None, " "]
    rows = []
    for conv in range(130):
        for turn in range(rng.choice([1, 2, 2, 3, 3, 4])):
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "u", "", None]), rng.choice(texts)))
    rows += [(None, 1, "user", "A."), (None, None, "assistant", "B."), (None, None, "user", "C."), (900, None, "user", "D."), (900, None, "user", "D.")]
    # identical roles and texts at a turn are what ties are
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", row string").repartition(5)
    assert got(df, damage=hurt) == brute(rows, hurt)


def test_without_rows_after_damage_and_empty(spark):
    conv = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "Hi.")], SCHEMA)
    assert got(df, damage=True) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repair(df.where("false")).collect() == []


def test_long_conversations_and_texts(spark):
    """A conversation of 20,000 turns that need nothing, one of equal rows, one very long text."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(20_000)]
    rows += [(2, 0, "user", "same.")] * 5_000
    rows += [(3, 0, "user", "long " * 1_000_000 + "."), (3, 1, "assistant", "Ok.")]
    out = got(spark.createDataFrame(rows, SCHEMA))
    assert out[1] == (0, 0, 0, 0, 0, 0, "K" * 20_000, hashlib.sha256("\n".join(f"{r}:{x}" for _, _, r, x in rows[:20_000]).encode()).hexdigest())
    assert out[2] == (0, 0, 4_999, 0, 4_999, 4 * 4_999 + 3, "K" + "D" * 4_999 + "I", hashlib.sha256(b"user:same.\nassistant:").hexdigest())
    assert out[3][5:7] == (0, "KK") and out[3][7] == hashlib.sha256(f"user:{rows[-2][3]}\nassistant:Ok.".encode()).hexdigest()


def test_random_long_ones_against_a_plain_programme(spark):
    """Costs and edits by carrying whole strings of edits along, row by row."""
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "user", "assistant", "?"]), rng.choice(["a.", "b", "c!", "", f"{t}.", f"{t}?", f"{t}"])) for c in range(60) for t in range(rng.randint(5, 40))]

    def plain(mine):
        best = {"": (0, "")}
        for (_, _, r, _), f in zip(mine, faults(mine)):
            new = {}
            for s, (c, a) in best.items():
                ways = [(s, c + 4, a + "D")]
                if f not in ("b", "d") or not f:
                    for to, price, e in [(r[0], 0, "K"), ("u", 3, "R"), ("a", 3, "R")]:
                        gap = {"s": "" if s == "" else None, "u": "a" if s == "u" else "", "a": "" if s == "u" else "u"}.get(to)
                        if gap is not None:
                            ways.append((to, c + price + 3 * (f == "t") + 3 * len(gap), a + "I" * len(gap) + e))
                for to, cost, audit in ways:
                    if to not in new or (cost, audit) < new[to]:
                        new[to] = cost, audit
            best = new
        return min((c + 3 * len(x), a + "I" * len(x)) for s, (c, a) in best.items() for x in [{"": "", "s": "ua", "u": "a", "a": ""}[s]])

    out = got(spark.createDataFrame(rows, SCHEMA))
    for c in range(60):
        assert out[c][5:7] == plain([r for r in rows if r[0] == c])


def test_faults_of_texts(spark):
    texts = ["", " ", "\t\n\x0b\x0c\r ", "a", "a.", "a. \n", "a!x", "?", ". ", " ", "日本。", "x" * 10 + "!" + " " * 1000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(repair.text_faults(F.col("t"))).collect()] == [1, 1, 1, 3, 0, 0, 3, 0, 3, 3, 3, 0]
