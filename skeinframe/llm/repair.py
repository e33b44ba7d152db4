"""Repair of the structure of conversations: a cheapest sequence of edits that makes roles alternate.

1. Rows are damaged or taken as they are; each row's fault comes from its text alone (blank, truncated) or, for duplicates,
   from an aggregate over (conversation, role and text), of which only those that come twice go back to their rows.
2. Rows without their texts go to their conversation's task in order of turn and are read once. The programme chooses the
   turns that are retained, as they are or with another role. States are the roles that the last retained turn may have.
   Deleted turns in a gap add the difference of two prefix sums, so a state's running minimum of cost less prefix, kept up to date
   row by row, prices every gap at once; the pair of roles at a gap's ends tells which turns must be inserted. Equal costs
   are told apart by the edits' initials, of which only the order among the states is kept, and what each state chose at a row:
   a byte a row and state. Few vectors of costs and orders ever occur, so that steps are remembered.
3. Texts go to their conversation's task in the same order, behind its edits, and are hashed as they pass.

A task holds edits of one conversation, not its texts; sorting spills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinframe.llm import _common

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANK, REPEATED, CUT = 1, 2, 3
#: States: nothing retained yet, or the last retained role's initial.
NONE, S, U, A = range(4)
#: Turns inserted between the last retained role and the next one (NONE: the end); None where no insertion helps.
_GAP = {
    NONE: {NONE: "", S: "", U: "", A: "u"},
    S: {NONE: "ua", U: "", A: "u"},
    U: {NONE: "a", U: "a", A: ""},
    A: {NONE: "", U: "", A: "u"},
}
_STATE = {"s": S, "u": U, "a": A}
_ROLE = {"u": "user", "a": "assistant"}


def text_faults(text: Column) -> Column:
    """BLANK, CUT or 0. Blank: nothing but blanks; cut: the last character that isn't one is none of . ! ?"""
    # trimmed from the right, and only there looked at: no pattern runs over the text
    end = F.rtrim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(end == "", BLANK).when(~F.substring(end, -1, 1).isin(".", "!", "?"), CUT).otherwise(0)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) by the remainder of their id and turn: dropped (they stay, with gone true), emptied,
    without their full stops, repeated, or the user's."""
    nulls = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(nulls("conv"), F.lit(":"), nulls("turn"))) % 20
    text = F.when(k == 1, "").when(k == 2, F.translate(nulls("text"), ".!?", "")).otherwise(nulls("text"))
    out = rows.select("conv", "turn", F.when(k == 4, "user").otherwise(nulls("role")).alias("role"), text.alias("text"), k.alias("k"))
    return out.withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv", "turn", "role", "text", (F.col("k") == 0).alias("gone"))


def undamaged(rows: DataFrame) -> DataFrame:
    nulls = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select("conv", "turn", nulls("role").alias("role"), nulls("text").alias("text"), F.lit(False).alias("gone"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


_steps: dict[tuple, tuple] = {}


def _step(costs: tuple, ranks: tuple, role: int, must_go: bool, cut: bool) -> tuple[int, tuple, tuple, bytes]:
    """Of each state the cheapest way to have it after one more row: what all costs grew by, costs above the least, the order of
    their edits, and for each state the choice: 16 * the state before + the row's initial (D, K, R) as 0, 1, 2. Missing: None."""
    key = costs, ranks, role, must_go, cut
    if (known := _steps.get(key)) is not None:
        return known
    ways: list[list[tuple]] = [[] for _ in range(4)]
    for p in range(4):
        if costs[p] is None:
            continue
        ways[p].append((costs[p] + DELETE, ranks[p], "D", p, 0))
        if must_go:
            continue
        late = TRUNCATED * cut
        # the gap's deletions come before its insertions, being smaller, and are part of ranks[p]
        for to, price, initial, code in ((role, KEEP, "K", 1), (U, REROLE, "R", 2), (A, REROLE, "R", 2)):
            if to is not None and to in _GAP[p]:
                gap = _GAP[p][to]
                ways[to].append((costs[p] + price + late + INSERT * len(gap), ranks[p], "I" * len(gap) + initial, p, code))
    best = [min(w) if w else None for w in ways]
    least = min(b[0] for b in best if b)
    order = {edits: n for n, edits in enumerate(sorted({b[1:3] for b in best if b}))}
    out = least, tuple(b and b[0] - least for b in best), tuple(b and order[b[1:3]] for b in best), bytes(16 * b[3] + b[4] if b else 255 for b in best)
    if len(_steps) < 100_000:
        _steps[key] = out
    return out


class Programme:
    """The programme over one conversation's rows."""

    def __init__(self):
        self.total, self.costs, self.ranks, self.choices = 0, (0, None, None, None), (0, None, None, None), bytearray()

    def add(self, initial: str, fault: int) -> None:
        grew, self.costs, self.ranks, chosen = _step(self.costs, self.ranks, _STATE.get(initial), fault in (BLANK, REPEATED), fault == CUT)
        self.total += grew
        self.choices += chosen

    def result(self) -> tuple[int, str]:
        """The cost and the edits' initials in order."""
        cost, _, tail, state = min((c + INSERT * len(_GAP[p][NONE]), self.ranks[p], "I" * len(_GAP[p][NONE]), p) for p, c in enumerate(self.costs) if c is not None)
        # from the end; a gap's deletions come before its insertions, which stand before the row that ends it
        out = [tail]
        for at in range(len(self.choices) - 4, -1, -4):
            before, code = divmod(self.choices[at + state], 16)
            out.append("DKR"[code])
            if code:
                out.append("I" * len(_GAP[before][state]))
            state = before
        return self.total + cost, "".join(reversed(out))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = False) -> DataFrame:
    """A row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    With damage, rows are damaged first (see damaged()); conversations that lose all their rows have zeros, an empty audit and the
    hash of the empty string. Rows are taken by turn, null turns first; those of one turn in order of their role and then of
    their text's SHA-256. Nulls of role and text count as one blank; a role that doesn't begin with s, u or a can't be kept.
    Rows with a null id are one conversation, whose id is null. Repeated rows are duplicates of each other. An empty table gives no
    rows; other columns are ignored.
    """
    _common.prepare(rows.sparkSession)
    rows = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    whole = (damaged if damage else undamaged)(rows)
    whole = whole.withColumn("digest", F.unhex(F.sha2("text", 256)))
    same = F.xxhash64("role", "digest"), F.xxhash64(F.lit(7), "digest", "role")
    light = whole.select("conv", "turn", "role", "digest", "gone", text_faults(F.col("text")).alias("fault"), F.monotonically_increasing_id().alias("row"), same[0].alias("x"), same[1].alias("y"))
    light = _common.settle(light, "repair-rows")
    # duplicates: of rows with the same role and text, by 128 bits, all but the first
    order = F.struct("turn", "role", "digest", "row")
    firsts = light.where("not gone").groupBy("conv", "x", "y").agg(F.min(order)["row"].alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = _common.settle(firsts.select(F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("c"), F.col("conv").isNull().alias("none"), "x", "y", "first", "n"), "repair-firsts")
    keyed = light.withColumns({"c": F.coalesce(F.col("conv").cast("string"), F.lit("")), "none": F.col("conv").isNull()})
    met = _common.meet(keyed, firsts, ["c", "none", "x", "y"], "n", how="left")
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("first") != F.col("row"), REPEATED).otherwise(F.col("fault"))
    facts = met.select("conv", "gone", "turn", "role", "digest", fault.cast("int").alias("fault"))
    # of repeated rows the first comes first
    sort = ["conv", "turn", "role", "digest"]
    facts = facts.repartition("conv").sortWithinPartitions(*sort, (F.col("fault") == REPEATED).asc())
    kind = whole.schema["conv"].dataType.simpleString()

    def programmes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        started, now = False, None

        def close() -> None:
            cost, audit = programme.result()
            gaps = last - first + 1 - turns if turns else 0
            out.append((now, gaps, found[BLANK], found[REPEATED], found[CUT], illegal, cost, audit))

        def taken() -> pa.RecordBatch:
            types = [columns.field(n).type for n in columns.names]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema=columns)
            out.clear()
            return batch

        columns = None
        for batch in batches:
            columns = columns or pa.schema([("conv", batch.schema.field(0).type), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
            for conv_, gone, turn_, initial, fault_ in _runs([batch]):
                if not started or conv_ != now:
                    if started:
                        close()
                        if len(out) >= 1000:
                            yield taken()
                    started, now = True, conv_
                    programme, found, illegal, before, first, last, turns = Programme(), [0] * 4, 0, None, None, None, 0
                if gone:
                    continue
                if turn_ is not None and (not turns or turn_ != last):
                    first, last, turns = first if turns else turn_, turn_, turns + 1
                found[fault_] += 1
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
                programme.add(initial, fault_)
        if started:
            close()
            yield taken()

    light_facts = facts.select("conv", "gone", "turn", F.substring("role", 1, 1).alias("initial"), "fault")
    results = light_facts.mapInArrow(programmes, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    results = _common.settle(results, "repair-audits")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state: tuple | None = None  # conversation, its edits, where in them, the hash, the role that comes next, whether a row was written

        def inserted(edits: str, at: int, digest, next_: str, some: bool) -> tuple[int, str, bool]:
            while at < len(edits) and edits[at] == "I":
                digest.update(f"{chr(10) * some}{_ROLE[next_]}:".encode())
                at, next_, some = at + 1, "a" if next_ == "u" else "u", True
            return at, next_, some

        def close() -> None:
            conv_, edits, at, digest, next_, some = state
            inserted(edits, at, digest, next_, some)
            out.append((conv_, digest.hexdigest()))

        for batch in batches:
            for conv_, audit, role_, text_ in _runs([batch]):
                if audit is not None:  # comes first
                    if state:
                        close()
                    state = conv_, audit, 0, hashlib.sha256(), "u", False
                    continue
                conv_, edits, at, digest, next_, some = state
                at, next_, some = inserted(edits, at, digest, next_, some)
                if edits[at] != "D":
                    if edits[at] == "R":
                        role_ = _ROLE[next_]
                    digest.update(f"{chr(10) * some}{role_}:{text_}".encode())
                    some, next_ = True, "a" if role_[0] == "u" else "u"
                state = conv_, edits, at + 1, digest, next_, some
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], batch.schema.field(0).type), pa.array([h for _, h in out])], ["conv", "repaired_sha256"])
                out.clear()
        if state:
            close()
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], batch.schema.field(0).type), pa.array([h for _, h in out])], ["conv", "repaired_sha256"])

    null = F.lit(None)
    texts = whole.where("not gone").select("conv", F.lit(1).alias("member"), "turn", "role", "digest", null.cast("string").alias("audit"), "text")
    heads = results.select("conv", F.lit(0).alias("member"), null.cast(whole.schema["turn"].dataType).alias("turn"), null.cast("string").alias("role"), null.cast("binary").alias("digest"), "audit", null.cast("string").alias("text"))
    met = heads.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "member", "turn", "role", "digest")
    hashes = met.select("conv", "audit", "role", "text").mapInArrow(hashed, f"conv {kind}, repaired_sha256 string")
    hashes = _common.settle(hashes.withColumnRenamed("conv", "__conv"), "repair-hashes")
    out = results.join(hashes, F.col("conv").eqNullSafe(F.col("__conv"))).drop("__conv").withColumnRenamed("conv", conv)
    _common.forget(light, firsts)
    return out
