"""Cheapest repair of damaged conversations, as a stream over rows sorted by turn.

A repaired conversation has the roles (system)? (user assistant)+, or no turns at all. The
cheapest edits follow from a table of costs with one row per turn and one column per state
(nothing yet, after system, after user, after assistant). Both ways through a conversation
are streams of sorted rows in which state is carried from one Arrow batch to the next:

backwards, over rows without text, each turn adds a row of costs and leaves one byte, the
edit to choose in each state. Bytes are handed on in chunks as rows, so of a conversation of
any length only a chunk is held;

forwards, over rows with text, the chunks come sorted in front of the turns they are for,
and the edits, the audit and the digest of what is left follow turn by turn.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightframes.llm.tables import staged

BLANKS = " \t\n\x0b\x0c\r"
# Turns whose edits travel in one row: a byte each.
CHUNK = 4096
# States: nothing yet, after system, after user, after assistant.
NEXT_INSERT = (2, 2, 3, 2)
ENDS = (0, 3)
# Edits by their initials' order, which decides between equal costs, and what they cost.
DELETE, INSERT, KEEP, REROLE = range(4)
COSTS = (3, 2, 0, 2)
CUT = 1
NEVER = 1 << 40
# What a row is, from 0: gone (only its conversation's id is left), or how it may be edited,
# by role initial and fault.
ROLES = ("s", "u", "a", "")
GONE, BLANK, DUPLICATE, TRUNCATED, SOUND = range(5)


def kept_state(state: int, role: int) -> int | None:
    """State after keeping a row with the given role initial (place in ROLES), if it may stay."""
    if role == 0:
        return 1 if state == 0 else None
    if role == 1:
        return 2 if state != 2 else None
    return 3 if role == 2 and state == 2 else None


def costs_before(after: tuple[int, ...], role: int, fault: int) -> tuple[tuple[int, ...], int]:
    """Costs of the rest of a conversation in each state before a row, and its edits, two bits a state."""
    extra = CUT if fault == TRUNCATED else 0
    options = []
    for state in range(4):
        found = {DELETE: COSTS[DELETE] + after[state]}
        if fault not in (BLANK, DUPLICATE):
            to = kept_state(state, role)
            if to is not None:
                found[KEEP] = COSTS[KEEP] + extra + after[to]
            found[REROLE] = COSTS[REROLE] + extra + after[NEXT_INSERT[state]]
        options.append(found)
    best = [min(o.values()) for o in options]
    for _ in range(3):  # insertions in a row
        best = [min(best[s], COSTS[INSERT] + best[NEXT_INSERT[s]]) for s in range(4)]
    packed = 0
    for state, found in enumerate(options):
        found[INSERT] = COSTS[INSERT] + best[NEXT_INSERT[state]]
        packed |= min(e for e, cost in found.items() if cost == best[state]) << (2 * state)
    return tuple(best), packed


def final_costs() -> tuple[int, ...]:
    best = [0 if s in ENDS else NEVER for s in range(4)]
    for _ in range(3):
        best = [min(best[s], COSTS[INSERT] + best[NEXT_INSERT[s]]) for s in range(4)]
    return tuple(best)


class Backward:
    """Costs relative to the least one: few are ever met, so each step is looked up."""

    def __init__(self):
        self.known: dict = {}
        self.end = final_costs()

    def step(self, costs: tuple[int, ...], role: int, fault: int) -> tuple[tuple[int, ...], int, int]:
        key = (costs, role, fault)
        if key not in self.known:
            best, packed = costs_before(costs, role, fault)
            least = min(best)
            self.known[key] = tuple(b - least for b in best), packed, least
        return self.known[key]


PLAN = (
    "conv bigint, unknown boolean, turn bigint, role string, digest binary, nth int, chunk bigint, edits binary,"
    " gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
)
_PLAN_ARROW = pa.schema(
    [
        ("conv", pa.int64()), ("unknown", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()),
        ("digest", pa.binary()), ("nth", pa.int32()), ("chunk", pa.int64()), ("edits", pa.binary()),
        *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    ]
)
LEGAL = {"su", "ua", "au"}


def plan_rows(batches):
    """Edits of each conversation in chunks, last turns first; the first chunk's turns have the sums too."""
    back = Backward()
    out: list[tuple] = []
    conv: tuple | None = None
    edits, place, chunk = bytearray(), None, 0
    costs, total, last, least, most, distinct, met, following, illegal = back.end, 0, None, None, None, 0, [0] * 5, None, 0

    def hand_on(sums):
        nonlocal chunk
        out.append((*conv, *place, chunk, bytes(edits[::-1]), *sums))
        edits.clear()
        chunk += 1

    def close():
        gaps = 0 if least is None else most - least + 1 - distinct
        hand_on((gaps, met[BLANK], met[DUPLICATE], met[TRUNCATED], illegal, total + costs[0]))

    def flush():
        columns = list(zip(*out)) if out else [[]] * len(_PLAN_ARROW)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PLAN_ARROW)], schema=_PLAN_ARROW)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv", "unknown", "turn", "role", "digest", "nth", "fault"))
        for own, unknown, turn, role, digest, nth, fault in zip(*columns):
            if (own, unknown) != conv:
                if conv is not None:
                    close()
                conv, chunk, place = (own, unknown), 0, (None, None, None, 0)
                costs, total, last, least, most, distinct, following, illegal = back.end, 0, None, None, None, 0, None, 0
                met = [0] * 5
            if fault == GONE:
                continue
            if len(edits) == CHUNK:
                hand_on((None,) * 6)
            initial = role[:1]
            if fault != BLANK and nth > 1:
                fault = DUPLICATE
            met[fault] += 1
            if following is not None and initial + following not in LEGAL:
                illegal += 1
            following = initial
            if turn is not None:
                distinct += turn != last or most is None
                most = turn if most is None else most
                least = last = turn
            kind = ROLES.index(initial) if initial in ("s", "u", "a") else 3
            costs, packed, add = back.step(costs, kind, fault)
            total += add
            edits.append(packed)
            place = (turn, role, digest, nth)
        yield flush()
    if conv is not None:
        close()
        yield flush()


REPAIRED = (
    "conv bigint, unknown boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint,"
    " cost bigint, audit string, repaired_sha256 string"
)
_REPAIRED_ARROW = pa.schema(
    [
        ("conv", pa.int64()), ("unknown", pa.bool_()),
        *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        ("audit", pa.string()), ("repaired_sha256", pa.string()),
    ]
)
NEW_ROLE = {2: b"user", 3: b"assistant"}
KEPT = {"s": 0, "u": 1, "a": 2}


class Forward:
    """One conversation's edits as its turns pass; of the turns only the running digest stays."""

    def __init__(self):
        self.state, self.audit, self.digest, self.any = 0, bytearray(), hashlib.sha256(), False

    def put(self, role: bytes, text: bytes) -> None:
        if self.any:
            self.digest.update(b"\n")
        self.any = True
        self.digest.update(role + b":")
        self.digest.update(text)

    def insert(self) -> None:
        self.audit += b"I"
        self.state = NEXT_INSERT[self.state]
        self.put(NEW_ROLE[self.state], b"")

    def turn(self, packed: int, role: str, text: str) -> None:
        while (edit := packed >> (2 * self.state) & 3) == INSERT:
            self.insert()
        self.audit += b"DIKR"[edit : edit + 1]
        if edit == KEEP:
            self.state = kept_state(self.state, KEPT[role[:1]])
            self.put(role.encode(), text.encode())
        elif edit == REROLE:
            self.state = NEXT_INSERT[self.state]
            self.put(NEW_ROLE[self.state], text.encode())

    def end(self) -> tuple[str, str]:
        while self.state not in ENDS:
            self.insert()
        return self.audit.decode(), self.digest.hexdigest()


def repair_rows(batches):
    """One row per conversation, from its turns in order with the chunks of edits in front of them."""
    out: list[tuple] = []
    conv = run = sums = None
    waiting: list[bytes] = []
    edits, at = b"", 0

    def flush():
        columns = list(zip(*out)) if out else [[]] * len(_REPAIRED_ARROW)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _REPAIRED_ARROW)], schema=_REPAIRED_ARROW)

    names = ("conv", "unknown", "role", "text", "edits", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    for batch in batches:
        for own, unknown, role, text, found, *more in zip(*(batch.column(c).to_pylist() for c in names)):
            if (own, unknown) != conv:
                if conv is not None:
                    out.append((*conv, *sums, *run.end()))
                conv, run, waiting, edits, at = (own, unknown), Forward(), [], b"", 0
            if found is not None:
                if more[0] is not None:
                    sums = more
                waiting.append(found)
                continue
            while at == len(edits):
                edits, at = waiting.pop(0), 0
            run.turn(edits[at], role, text)
            at += 1
        yield flush()
    if conv is not None:
        out.append((*conv, *sums, *run.end()))
        yield flush()


def prepared(turns: DataFrame) -> DataFrame:
    """conv (0 for none), unknown (whether there is none), turn, role, text, present; null role and text are one space."""
    conv = F.col("conv_id").cast("bigint")
    present = F.coalesce(F.col("present").cast("boolean"), F.lit(True)) if "present" in turns.columns else F.lit(True)
    return turns.select(
        F.coalesce(conv, F.lit(0)).alias("conv"),
        conv.isNull().alias("unknown"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
        present.alias("present"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: conversations damaged by CRC-32 of ``conv_id:turn``, null as one space.

    A row that is dropped stays once, with ``present`` false, so that its conversation is known.
    """
    conv, turn = F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")
    name = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    case = F.crc32(name.cast("binary")) % 20
    text = F.coalesce(F.col("text"), F.lit(" "))
    rows = conversations.select(
        conv.alias("conv_id"),
        turn.alias("turn"),
        F.when(case == 4, "user").otherwise(F.coalesce(F.col("role"), F.lit(" "))).alias("role"),
        F.when(case == 1, "").when(case == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        case.alias("case"),
    )
    copies = F.when(F.col("case") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("copy", F.explode(copies)).select(
        "conv_id", "turn", "role", "text", (F.col("case") != 0).alias("present")
    )


def fault(text: Column) -> Column:
    """BLANK, TRUNCATED or SOUND; duplicates are seen only next to other rows."""
    stripped = F.rtrim(text, F.lit(BLANKS))
    ends = F.substring(stripped, -1, 1).isin(".", "!", "?")
    return F.when(stripped == "", BLANK).when(ends, SOUND).otherwise(TRUNCATED)


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``turns`` has conv_id, turn, role, text and possibly ``present``; rows where that is
    false only name their conversation. Turns are taken in ascending order with null first;
    of one turn's rows by role and then the SHA-256 of role and text. A null role or text is
    one space; such rows are blank, or have a role that is nobody's. A row's first fault
    counts: blank (nothing but blanks), duplicate (role and text seen earlier in the
    conversation), truncated (the last character that is no blank is none of ``.!?``).
    Keeping a row costs 0, giving it the role user or assistant 2, deleting it 3, which
    blank and duplicate ones must be, a new turn without text 2, a truncated row that stays
    1 more. The cheapest edits whose role initials are ``(s?(ua)+)?`` are chosen, of equal
    ones those with the least audit in ASCII order; a row with an empty role cannot be kept
    as it is. ``repaired_sha256`` is over ``role:text`` of what is left, newline between.

    Rows without conv_id are one conversation, shown under null. Repeated rows are
    duplicates. One text is held at a time, however long, and one conversation is read by
    one task, as its digest asks for, whatever its number of turns. An empty table gives no
    rows; other columns are ignored.
    """
    rows = prepared(turns)
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.withColumn("digest", digest)
    light = rows.select(
        "conv", "unknown", "turn", "role", "digest",
        F.when(F.col("present"), fault(F.col("text"))).otherwise(GONE).alias("fault"),
    )
    gone = F.col("fault") == GONE
    same = Window.partitionBy("conv", "unknown", gone, "digest").orderBy(F.col("turn").asc_nulls_first())
    # equal rows lie in the same partition as their conversation, so this shuffles once
    numbered = light.repartition("conv", "unknown").withColumn("nth", F.row_number().over(same))
    backwards = numbered.sortWithinPartitions(
        "conv", "unknown", F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("digest").desc(), F.col("nth").desc()
    )
    plan = staged(backwards.mapInArrow(plan_rows, PLAN), "plan")
    texts = rows.filter("present").select("conv", "unknown", "turn", "role", "digest", "text")
    both = plan.unionByName(texts, allowMissingColumns=True)
    dealt = both.repartition("conv", "unknown").sortWithinPartitions(
        "conv", "unknown", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("digest").asc_nulls_first(),
        F.col("edits").isNull(), F.col("chunk").desc(),
    )
    found = dealt.select(
        "conv", "unknown", "role", "text", "edits", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"
    ).mapInArrow(repair_rows, REPAIRED)
    return found.select(F.when(~F.col("unknown"), F.col("conv")).alias("conv_id"), *found.columns[2:])
