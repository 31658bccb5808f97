"""Secret scans with one combined automaton over all rules.

All bytes of a slice are run through the automaton once. Where it accepts, the exact match
is taken from the same rule's own automata: reversed from the accepting byte for the
leftmost start, forward from there for the longest end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightframes.llm.automaton import Automaton
from nightframes.llm.buffers import flat, slices

VALUE = r"[A-Za-z0-9+/_.=\-]"
# (kind, pattern, letters of any case, least length of the match, of its value if it has one).
# The first three are the base rules; the others are added to them.
RULES = (
    ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?" + VALUE + "+", True, 6),
    ("access", r"AKIA[A-Z0-9]+", False, 20),
    ("hex", r"[0-9a-f]{24,}", False, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", False, 40),
    ("private_key", r"-----BEGIN\x20([A-Z0-9]+\x20)*PRIVATE\x20KEY(\x20BLOCK)?-----", False, 27),
)
# What a match goes on with after its pattern. A private key goes to its END line if no other
# five dashes come first; else over header fields and all base64 that follows, if the first
# run of that looks like no word (digits, signs, capitals inside). Words that follow a key
# without END are taken for base64 up to the next sign that is none.
KEY_TEXT, BASE64, BETWEEN = r"[\x09\x0a\x0d -,.-~\x80-ÿ]", "[A-Za-z0-9+/=]", r"[\x09\x0a\x0d\x20\x5c\"'>]"
FIELD = r"[A-Za-z\-]+:([ -[\x5d-~\x80-ÿ]*(\x0d?\x0a|\x5cn)|\x20*[!-~]+(\x20[!-~]*[!-*,-.:-<>-@_][!-~]*)*\x20)"
NO_WORD = rf"{BASE64}*([0-9+/=]|[a-z][A-Z]|[A-Z][A-Z][a-z]){BASE64}*"
BODIES = {
    "private_key": (
        rf"(-?-?-?-?{KEY_TEXT})*-----END\x20([A-Z0-9]+\x20)*PRIVATE\x20KEY(\x20BLOCK)?-----",
        rf"({BETWEEN}*{FIELD})*{BETWEEN}*{NO_WORD}({BETWEEN}*{BASE64}+)*",
    )
}
BASE = ("assign", "access", "hex")
SPANS = "spans array<struct<kind: string, start: bigint, end: bigint>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


class Scanner:
    """Compiled rules: a search automaton for all, and matching automata for each, without and with its bodies."""

    def __init__(self, rules=RULES):
        self.rules = rules
        self.all = Automaton([(pattern, fold) for _, pattern, fold, _ in rules])
        each = [[Automaton([(pattern + body, fold)], search=False) for body in ("", *BODIES.get(kind, ()))] for kind, pattern, fold, _ in rules]
        self.tables = [[(a.table.tolist(), a.accepts.tolist(), a.start) for a in own] for own in each]
        # bytes with which a rule can begin
        self.first = [frozenset(np.flatnonzero(a.table[a.start * 256 :][:256]).tolist()) for a, *_ in each]

    def longest(self, rule: int, data: bytes, start: int, stop: int) -> int:
        """End of the longest match at ``start``, or -1."""
        end = -1
        for table, accepts, state in self.tables[rule]:
            for i in range(start, stop):
                state = table[state * 256 + data[i]]
                if not state:
                    break
                if accepts[state]:
                    end = max(end, i + 1)
        return end

    def spans(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, rule, start, end) in bytes of the slice, by text, start and rule."""
        joined = np.zeros(len(data) + len(bounds), np.uint8)  # a zero byte ends each text
        where = np.arange(len(data)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        joined[where] = data
        states = self.all.run(joined)
        hits = np.flatnonzero(self.all.accepts[states])
        if not len(hits):
            return []
        raw, limits = joined.tobytes(), bounds + np.arange(len(bounds))
        text = np.searchsorted(limits, hits, side="right") - 1
        rules = self.all.accepts[states[hits]]
        idle = states == self.all.start
        found = []
        for rule in range(len(self.rules)):
            own = np.flatnonzero(rules >> rule & 1)
            done, after = -1, -1
            for hit, t in zip(hits[own].tolist(), text[own].tolist()):
                if hit < done:
                    continue
                lo, stop = int(limits[t]), int(limits[t + 1]) - 1
                at = max(lo, after, begin_of(idle, hit))
                done = hit + 1
                while at <= hit:  # leftmost start whose match reaches the accepting byte
                    if raw[at] in self.first[rule] and (end := self.longest(rule, raw, at, stop)) > 0:
                        found.append((t, rule, at - t, end - t))
                        at = after = end
                    else:
                        at += 1
                done = max(done, after)
        return sorted(found, key=lambda x: (x[0], x[2], x[1]))


def begin_of(idle: np.ndarray, hit: int) -> int:
    """The first byte after the automaton last was where a search begins."""
    step, hi = 256, hit
    while hi > 0:
        lo = max(0, hi - step)
        back = np.flatnonzero(idle[lo:hi])
        if len(back):
            return lo + int(back[-1]) + 1
        hi, step = lo, step * 4
    return 0


def value_length(kind: str, match: bytes) -> int:
    """What the rule's least length is held against: the value of an assignment, else the match."""
    if kind != "assign":
        return len(match)
    rest = match[min(x for x in (match.find(b":"), match.find(b"=")) if x >= 0) + 1 :].lstrip(b" ")
    return len(rest) - (rest[:1] in (b'"', b"'"))


def span_rows(scanner: Scanner, columns: list[str]):
    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                data, bounds = flat(part.column("text"))
                raw, own = data.tobytes(), [[] for _ in range(part.num_rows)]
                # characters before each byte: all that do not continue one
                points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                for t, rule, start, end in scanner.spans(data, bounds):
                    kind, _, _, least = scanner.rules[rule]
                    if value_length(kind, raw[start:end]) >= least:
                        base = points[bounds[t]]
                        own[t].append(
                            {"kind": kind, "start": int(points[start] - base), "end": int(points[end] - base)}
                        )
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.array(own, SPAN_TYPE)], [*columns, "spans"]
                )

    return scan


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id and spans (array of struct kind, start, end in characters, end exclusive).

    Matches of one kind are leftmost and do not overlap; kinds may overlap each other. Spans
    are in order of start, then of the rules. Null and empty texts have no spans; every row
    of the table is returned, repeated ones too. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(span_rows(Scanner(rules), ["doc_id"]), f"doc_id bigint, {SPANS}")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with the same columns; each stretch that a secret covers becomes ``[kind]``.

    The kind is that of the first span of the stretch. ``n_chars``, where there is such a
    column, follows the new text. Rows without secrets are returned as they are.
    """

    scanner = span_rows(Scanner(rules), ["text"])

    def cleaned(batches):
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column("text")], ["text"])
            spans = [s for out in scanner(iter([texts])) for s in out.column("spans").to_pylist()]
            values = batch.column("text").to_pylist()
            for i, own in enumerate(spans):
                if own:
                    values[i] = without(values[i], own)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))

    found = docs.mapInArrow(cleaned, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.col("text").isNotNull() & F.col("n_chars").isNotNull()
        found = found.withColumn("n_chars", F.when(changed, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found


def without(text: str, spans: list[dict]) -> str:
    out, at, end = [], 0, -1
    for s in spans:
        if s["start"] >= end:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
        at = end = max(end, s["end"])
    return "".join(out) + text[at:]
