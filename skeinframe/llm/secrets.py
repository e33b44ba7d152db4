"""Secret scans: fixed patterns, and formats inferred from labelled credentials.

fit() takes the credentials that the base patterns find in the table, and the public
formats, as labelled; other runs of credential characters are labelled as plain. Of
each label infer() builds the prefix tree and merges states whose continuations are
statistically compatible (Hoeffding bounds on how often a string ends there and on each
symbol, checked down the tree), each state with the nearest of those that it may merge
with. The results are two probabilistic automata. Every candidate of a text is scored
by its mean log-likelihood a symbol under the credentials' automaton, and it is found
if that is high enough and above the one under the plain strings' by a margin. What
these two leave of a run goes through a second pair, of shapes: no symbol stands for
itself there, the beginning's states merge like others, and any symbol may follow any,
so that a credential whose beginning nobody has labelled has a score too. No row is
shuffled but the bounded sample that is learned from.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinframe.llm import _common

# The base kinds in order, their patterns, and the least length of the group named.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{16,}")  # the same matches as HEX of 16 or more: runs are taken whole
KINDS = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX_LONG, 0, 16))
HINTS = ("password", "passwd", "secret", "token", "api")

#: Candidates are parts of such runs, from their start or after a mark to their end or before a mark, of LEAST symbols or more.
RUN, MARK, LEAST = re.compile(r"[A-Za-z0-9+/_.=-]{16,}"), frozenset("+/_.=-"), 16
#: Symbols at the start of a string that stand for themselves; later ones stand for their kind.
LITERAL = 4
#: Mean natural log-likelihood a symbol below which a candidate is no credential, and by how much it must pass that of plain strings.
LEAST_SCORE, MARGIN = -2.0, 0.1
#: Strings of each label and base kind that are learned from, at most (those with the smallest hash), and the symbols of the longest.
SAMPLE, LONGEST = 300, 200
#: By how much a shape's mean must pass that of plain shapes, and by how much the sum may fall behind before no longer part is tried.
SHAPE_MARGIN, BEHIND = 0.35, 12.0
#: Part of each state's probability that any symbol has.
ANY = 0.05
#: Passes of a state below which it is like any other.
FEW = 4

UPPER, LOWER, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
# Public token formats (prefix, alphabet, least and most further characters).
FORMATS = (
    ("ghp_", UPPER + LOWER + DIGITS, 36, 36),
    ("gho_", UPPER + LOWER + DIGITS, 36, 36),
    ("glpat-", UPPER + LOWER + DIGITS + "_-", 20, 20),
    ("sk_live_", UPPER + LOWER + DIGITS, 24, 32),
    ("xoxb-", DIGITS, 24, 40),
    ("AIza", UPPER + LOWER + DIGITS + "_-", 35, 35),
    ("npm_", UPPER + LOWER + DIGITS, 36, 36),
)

PUBLIC = re.compile("|".join(prefix for prefix, *_ in FORMATS))


def labelled_credentials(each: int = 200, seed: int = 3) -> list[str]:
    """`each` credentials of every public format."""
    rng = random.Random(seed)
    return [prefix + "".join(rng.choices(alphabet, k=rng.randint(least, most))) for prefix, alphabet, least, most in FORMATS for _ in range(each)]


def plain_strings(each: int = 100, seed: int = 4) -> list[str]:
    """Runs that are no credentials, by rule: `each` of words, words joined, capitals, names with numbers, dates and numbers."""
    rng = random.Random(seed)

    def word(least: int = 3, most: int = 10) -> str:
        return "".join(rng.choice(LOWER[:6] if rng.random() < 0.27 else LOWER[6:]) for _ in range(rng.randint(least, most)))

    def joined(mark: str, parts: list[str]) -> str:
        return mark.join(parts)

    out = []
    for _ in range(each):
        words = [word() for _ in range(rng.randint(3, 5))]
        number = str(rng.randrange(1, 10 ** rng.randint(1, 4)))
        out += [word(16, 30), joined(rng.choice("_-./"), words), joined("", [w.capitalize() for w in words]), joined(rng.choice("_-"), words).upper()]
        out += [joined(".", [words[0] + number, *words[1:]]), joined("/", [*words, number]), joined(rng.choice("-./"), [f"{rng.randrange(10**4):0{rng.choice((2, 4))}d}" for _ in range(4)])]
    return [s for s in out if len(s) >= LEAST]


_KINDS = {c: k for k, chars in (("f", "abcdef"), ("a", LOWER[6:]), ("F", "ABCDEF"), ("A", UPPER[6:]), ("0", DIGITS)) for c in chars}


def symbols(text: str, literal: int = LITERAL) -> list[str]:
    return [c if i < literal else _KINDS.get(c, c) for i, c in enumerate(text)]


class Tree:
    """Frequencies of a prefix tree: how many strings pass a state, end there, and go on with a symbol."""

    def __init__(self, strings: list[list[str]]):
        self.end: list[int] = [0]
        self.seen: list[int] = [0]
        self.next: list[dict[str, int]] = [{}]
        for s in strings:
            at = 0
            self.seen[0] += 1
            for c in s:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.end)
                    self.end.append(0)
                    self.seen.append(0)
                    self.next.append({})
                at = self.next[at][c]
                self.seen[at] += 1
            self.end[at] += 1


def infer(credentials: list[str], alpha: float = 0.05, literal: int = LITERAL) -> list[tuple[float, dict[str, tuple[float, int]]]]:
    """The probabilistic automaton: per state the log probability of ending and, by symbol, of going on, with the next state."""
    tree = Tree([symbols(c, literal) for c in credentials])
    factor = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > factor * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(p: int, q: int) -> bool:
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            n1, n2 = tree.seen[p], tree.seen[q]
            if differ(tree.end[p], n1, tree.end[q], n2):
                return False
            for c in tree.next[p].keys() | tree.next[q].keys():
                a, b = tree.next[p].get(c), tree.next[q].get(c)
                if differ(tree.seen[a] if a is not None else 0, n1, tree.seen[b] if b is not None else 0, n2):
                    return False
                if a is not None and b is not None and a != b:
                    stack.append((a, b))
        return True

    def fold(p: int, q: int) -> None:
        """Add the tree below q to state p."""
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            tree.seen[p] += tree.seen[q]
            tree.end[p] += tree.end[q]
            for c, b in tree.next[q].items():
                if c in tree.next[p]:
                    stack.append((tree.next[p][c], b))
                else:
                    tree.next[p][c] = b

    def distance(p: int, q: int) -> float:
        """Between what follows two states."""
        shares = ({c: tree.seen[x] / tree.seen[s] for c, x in tree.next[s].items()} | {"": tree.end[s] / tree.seen[s]} for s in (p, q))
        a, b = shares
        return sum(abs(a.get(c, 0) - b.get(c, 0)) for c in a.keys() | b.keys())

    depth = {0: 0}
    red = [0]
    while blue := min(((depth[p] + 1, p, c) for p in red for c, q in tree.next[p].items() if q not in depth), default=None):
        deep, p, c = blue
        q = tree.next[p][c]
        fits = [r for r in red if (tree.seen[q] < FEW or compatible(r, q))]
        match = min(fits, key=lambda r: (distance(r, q), r), default=None)
        if match is None or distance(match, q) > 1.5:
            depth[q] = deep
            red.append(q)
        else:
            tree.next[p][c] = match
            fold(match, q)
    place = {s: i for i, s in enumerate(red)}
    # count what really leaves each state by running the credentials through the automaton
    ends, goes = [0] * len(red), [{} for _ in red]
    for text in credentials:
        at = 0
        for c in symbols(text, literal):
            goes[at][c] = goes[at].get(c, 0) + 1
            at = place[tree.next[red[at]][c]]
        ends[at] += 1
    model = []
    for s, e, g in zip(red, ends, goes, strict=True):
        n = e + sum(g.values())
        model.append((math.log(e / n) if e else -math.inf, {c: (math.log(k / n), place[tree.next[s][c]]) for c, k in g.items()}))
    return model


def score(text: str, model: list, literal: int = LITERAL) -> float:
    """Mean log-likelihood a symbol, the end counted as one; -inf if the automaton has no such string."""
    at, total, s = 0, 0.0, symbols(text, literal)
    for c in s:
        step = model[at][1].get(c)
        if step is None:
            return -math.inf
        total += step[0]
        at = step[1]
    return (total + model[at][0]) / (len(s) + 1)


def completed(model: list) -> list:
    """The automaton with every symbol in every state: one that a state hasn't leads to where it leads most often elsewhere."""
    alphabet = sorted(set(_KINDS.values()) | MARK)
    leads: dict[str, dict[int, float]] = {c: {} for c in alphabet}
    for _, steps in model:
        for c, (own, to) in steps.items():
            leads[c][to] = leads[c].get(to, 0.0) + math.exp(own)
    usual = {c: max(to, key=lambda s: (to[s], -s)) if to else 0 for c, to in leads.items()}
    floor = ANY / (len(alphabet) + 1)
    log = lambda own: math.log((1 - ANY) * math.exp(own) + floor)
    return [(log(end), {c: (log(steps[c][0] if c in steps else -math.inf), steps[c][1] if c in steps else usual[c]) for c in alphabet}) for end, steps in model]


def shapes_of(credentials: list[str], plain: list[str]) -> tuple[list, list]:
    return completed(infer(credentials, literal=0)), completed(infer(plain, literal=0))


class Model(NamedTuple):
    credentials: list
    plain: list
    shapes: list
    plain_shapes: list

    def longest_shape(self, run: str, start: int, stop: int) -> tuple[int, float] | None:
        """(end, score) of the longest part of run[:stop] that begins at start and has a credential's shape."""
        at, other, total, ahead, best = 0, 0, 0.0, 0.0, None
        for i in range(start, stop):
            c = _KINDS.get(run[i], run[i])
            (own, at), (theirs, other) = self.shapes[at][1][c], self.plain_shapes[other][1][c]
            total, ahead, n = total + own, ahead + own - theirs, i - start + 1
            if ahead < -BEHIND:
                break
            if n >= LEAST and run[i] not in MARK and (i + 1 == stop or run[i + 1] in MARK):
                end = self.shapes[at][0]
                if (ahead + end - self.plain_shapes[other][0]) / (n + 1) >= SHAPE_MARGIN:
                    best = (i + 1, (total + end) / (n + 1))
        return best

    def judge(self, text: str) -> tuple[float, bool]:
        """(score under the credentials' automaton, whether the text is taken for a credential)."""
        own = score(text, self.credentials)
        return own, own >= LEAST_SCORE and own >= score(text, self.plain) + MARGIN

    def longest(self, run: str, start: int) -> tuple[int, float] | None:
        """(end, score) of the longest credential of a run that begins at start."""
        at, total, best = 0, 0.0, None
        for i in range(start, len(run)):
            c = run[i] if i - start < LITERAL else _KINDS.get(run[i], run[i])
            step = self.credentials[at][1].get(c)
            if step is None:
                break
            total, at, n = total + step[0], step[1], i - start + 1
            if n >= LEAST and (i + 1 == len(run) or run[i + 1] in MARK):
                own = (total + self.credentials[at][0]) / (n + 1)
                if own >= LEAST_SCORE and own >= score(run[start : i + 1], self.plain) + MARGIN:
                    best = (i + 1, own)
        return best


@lru_cache(maxsize=1)
def default_model() -> Model:
    """Of the public formats alone."""
    return Model(infer(labelled_credentials()), infer([]), *shapes_of(labelled_credentials(40), plain_strings()))


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Learn from at most `sample` strings of each base kind and as many plain ones of the table, and from the public formats.

    Null and empty texts hold none; repeated strings count once; an empty table leaves the public formats.
    """
    _common.prepare(docs.sparkSession)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict[str, int]] = [{} for _ in range(len(KINDS) + 1)]

        def cut(k: int, most: int) -> None:
            if len(found[k]) > most:
                found[k] = dict(sorted(found[k].items(), key=lambda x: (x[1], x[0]))[:sample])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                spans = base_spans(text, True)
                inside = [s for part in spans for s in part]
                for k, part in enumerate(spans):
                    found[k].update((text[a:b], zlib.crc32(text[a:b].encode())) for a, b in part if b - a <= LONGEST)
                    cut(k, 8 * sample)
                plain = ((m.group(), m.span()) for m in RUN.finditer(text))
                found[-1].update((t, zlib.crc32(t.encode())) for t, (i, j) in plain if len(t) <= LONGEST and not any(a < j and i < b for a, b in inside) and not PUBLIC.search(t))
                cut(-1 % len(found), 8 * sample)
        for k in range(len(found)):
            cut(k, sample)
        rows = [(k, t) for k, part in enumerate(found) for t in part]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([t for _, t in rows], pa.string())], ["kind", "s"])

    strings = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(labelled, "kind int, s string").distinct()
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.crc32(F.col("s").cast("binary")), "s"))
    got = strings.withColumn("place", place).where(F.col("place") <= sample).orderBy("kind", "s").select("kind", "s").collect()  # sample rows a kind at most
    own = [r["s"] for r in got if r["kind"] < len(KINDS)]
    plain = [r["s"] for r in got if r["kind"] == len(KINDS)]
    # shapes come from the table first: of each public format a few only
    return Model(infer(labelled_credentials() + own), infer(plain), *shapes_of(labelled_credentials(40) + own, plain_strings() + plain))


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """In order, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def base_spans(text: str, secret: bool = False) -> list[list[tuple[int, int]]]:
    """Of each base kind its spans, or those of the secrets in them."""
    low = text.lower()
    out = []
    for kind, pattern, group, least in KINDS:
        if kind == "assign" and not any(h in low for h in HINTS) or kind == "access" and "AKIA" not in text:
            out.append([])
        else:
            out.append([m.span(group if secret else 0) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least])
    return out


def model_spans(text: str, model: Model) -> list[tuple[int, int, float]]:
    """(start, end, score) of the candidates taken for credentials, from the left, each as long as may be; none overlap."""
    begins = model.credentials[0][1]
    out = []
    for m in RUN.finditer(text):
        run, start = m.group(), 0
        while start <= len(run) - LEAST:
            best = model.longest(run, start) if (start == 0 or run[start - 1] in MARK) and run[start] in begins else None
            if best:
                out.append((m.start() + start, m.start() + best[0], best[1]))
            start = best[0] if best else start + 1
    return out


def shape_spans(text: str, model: Model, taken: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """(start, end, score) of the parts of runs outside `taken`, which is in order, that have a credential's shape; none overlap."""
    out, k = [], 0
    for m in RUN.finditer(text):
        run, start, base = m.group(), 0, m.start()
        while start <= len(run) - LEAST:
            while k < len(taken) and taken[k][1] <= base + start:
                k += 1
            stop = min(len(run), taken[k][0] - base) if k < len(taken) else len(run)
            if stop - start < LEAST:
                start = taken[k][1] - base if stop < len(run) else len(run)
                continue
            best = model.longest_shape(run, start, stop) if run[start] not in MARK and (start == 0 or run[start - 1] in MARK) else None
            if best:
                out.append((base + start, base + best[0], best[1]))
            start = best[0] if best else start + 1
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """A row per document: the id and the found spans, array<struct<kind, start, end, score>> by start, then kind.

    Kinds `format` and `shape` are the automata's; they leave out what is just a base span or its secret, and shapes are sought
    outside of formats and of the base spans' secrets. score is the mean log-likelihood of the secret under the credentials' automaton
    (for a shape, of shapes), null if it has no such string. Places count code points, ends exclusive.
    Cases: a null text is an empty one, without spans; any id, null or repeated, is passed on; an empty table gives no rows;
    other columns are ignored.
    """
    _common.prepare(docs.sparkSession)
    model = default_model() if model is None else model
    kind = docs.schema[id_col].dataType
    names = [k for k, *_ in KINDS] + ["format", "shape"]
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                spans, secrets = base_spans(text), base_spans(text, True)
                found = [(a, k, b, score(text[i:j], model.credentials)) for k in range(len(KINDS)) for (a, b), (i, j) in zip(spans[k], secrets[k], strict=True)]
                known = {s for part in (*spans, *secrets) for s in part}
                formats = model_spans(text, model)
                found += [(a, len(KINDS), b, own) for a, b, own in formats if (a, b) not in known]
                taken = _union([*((a, b) for a, b, _ in formats), *(s for k in (0, 1) for s in secrets[k])])
                found += [(a, len(KINDS) + 1, b, own) for a, b, own in shape_spans(text, model, taken) if (a, b) not in known]
                rows.append([{"kind": names[k], "start": a, "end": b, "score": own if own > -math.inf else None} for a, k, b, own in sorted(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(struct))], ["id", "found"])

    schema = f"id {kind.simpleString()}, found array<struct<kind: string, start: bigint, end: bigint, score: double>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(scanned, schema).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of scan()'s rows: the id, n_assign, n_access, n_hex, base_sha256, spans, best_score (the largest; null if there is none)."""
    spans = F.col("found")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    line = lambda which: F.concat_ws(",", F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter(spans, lambda s: ~s["kind"].isin("format", "shape"))
    return found.select(id_col, count("assign"), count("access"), count("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(spans).alias("spans"), F.array_max(F.transform(spans, lambda s: s["score"])).alias("best_score"))


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
