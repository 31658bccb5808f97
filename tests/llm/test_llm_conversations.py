"""Conversation repair and the prefix trie against brute force, with nulls, ties, giants and empty tables."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from nightframes.llm import prefix_trie as P
from nightframes.llm import turn_repair as R

COLUMNS = "conv_id bigint, turn bigint, role string, text string, conv string, fault int, key string, depth int, edits int, present_ string"


def table(spark, rows):
    """Conversations with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3, "z") for r in rows], COLUMNS)


@pytest.fixture
def small_batches(spark):
    """Arrow batches of a few rows, so that state has to be carried."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def sample(seed=1, conversations=40):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "uncle", None, ""]
    texts = ["Yes.", "No!", "Why?", "cut", "cut  \n", "", " \t\n", None, "Fine. \n", "Wirklich, naïve.", "x" * 70_000 + "."]
    rows = []
    for c in range(conversations):
        c = rnd.choice([c, c, c - 20])
        for t in range(rnd.randrange(1, 10)):
            role = ("user", "assistant")[t % 2] if rnd.random() < 0.7 else rnd.choice(roles)
            rows.append((c, rnd.choice([t, t, t + 3, None]), role, rnd.choice(texts)))
    rows += [(None, None, None, None), (None, 1, "user", "Hello."), (None, 1, "user", "Hello."), (700, 5, "user", None)]
    rows += [(800, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(60)]
    rows += rows[5:9]
    rnd.shuffle(rows)
    return rows


def crc(text):
    return zlib.crc32(text.encode())


def nulls_first(turn):
    return (turn is not None, turn or 0)


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        case = crc(f"{' ' if c is None else c}:{' ' if t is None else t}") % 20
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        out += [(c, t, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return out


def cheapest(turns):
    """Least (cost, audit, repaired) over all edits, by search from the least cost on."""
    heap, seen = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, roles, kept = heapq.heappop(heap)
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, kept
        tail = (i, roles[:1] if len(roles) == 1 else roles[-2:])
        if tail in seen:
            continue
        seen.add(tail)

        def go(c, letter, j, role="", text=None):
            now = roles + role[:1]
            if any(re.fullmatch("(s?(ua)+)?", now + more) for more in ("", "a", "ua")):
                heapq.heappush(heap, (cost + c, audit + letter, j, now, kept if text is None else (*kept, f"{role}:{text}")))

        for role in ("user", "assistant"):
            go(2, "I", i, role, "")
        if i < len(turns):
            role, text, fault = turns[i]
            go(3, "D", i + 1)
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if role:
                    go(extra, "K", i + 1, role, text)
                for new in ("user", "assistant"):
                    go(2 + extra, "R", i + 1, new, text)


def brute_repair(all_rows, rows):
    by_conv = defaultdict(list)
    for c, t, role, text in rows:
        by_conv[c].append((nulls_first(t), role, digest(role, text), text, t))
    out = []
    for c in {r[0] for r in all_rows}:
        found = sorted(by_conv[c])
        met, faults, seen = [], defaultdict(int), set()
        for _, role, _, text, _ in found:
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated"
            seen.add((role, text))
            faults[fault] += 1
            met.append((role, text, fault))
        turns = [t for *_, t in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(met, met[1:]))
        cost, audit, kept = cheapest(met)
        sha = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((c, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha))
    return sorted(out, key=repr)


def repaired(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("chunk", [3, 4096])
def test_repair_against_search(spark, small_batches, monkeypatch, chunk):
    monkeypatch.setattr(R, "CHUNK", chunk)
    rows = sample()
    assert repaired(R.repair(R.damaged(table(spark, rows)))) == brute_repair(rows, damage(rows))


def test_repair_of_undamaged_turns(spark, small_batches):
    rows = sample(2, 60)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert repaired(R.repair(table(spark, rows))) == brute_repair(rows, plain)


def test_costs_of_single_rows(spark):
    rows = [
        (1, 0, "user", "Hi."), (2, 0, "system", "Be."), (3, 0, "assistant", "Hi."), (4, 0, "user", " "),
        (5, 0, "system", "Be."), (5, 1, "user", "Hi"), (5, 2, "user", "Hi."), (5, 3, "assistant", "Yes."),
    ]
    got = {r.conv_id: (r.cost, r.audit) for r in R.repair(table(spark, rows)).collect()}
    # 5: deleting the cut turn costs as much as keeping it and answering it, and comes first
    assert got == {1: (2, "KI"), 2: (3, "D"), 3: (2, "IK"), 4: (3, "D"), 5: (3, "KDKK")}


def test_repair_of_empty_tables(spark):
    assert R.repair(table(spark, [])).collect() == []
    assert R.repair(R.damaged(table(spark, []))).collect() == []
    gone = next(c for c in range(1000) if crc(f"{c}:0") % 20 == 0)
    row = R.repair(R.damaged(table(spark, [(gone, 0, "user", "Hello.")]))).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repair_deals_once_each_way(spark):
    """One exchange backwards and one forwards: the numbering of equal rows needs none of its own."""
    plan = R.repair(R.damaged(table(spark, sample())))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def rebuild(rows):
    by_conv = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by_conv[c].append((nulls_first(t), role, digest(role, text), text))
    turns = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in by_conv.items()}
    out = {}
    for c, own in turns.items():
        h = crc(str(c)) % 9
        lender = int(c - (abs(c) % 5) * (1 if c >= 0 else -1))
        out[c] = turns.get(lender, [])[:h] + own[h:]
    return turns, out


def brute_trie(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for n in members:
        if n:
            children[n[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(conversations[c]) == len(n))
        parent = min(members[n[:-1]]) if n else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(n), parent, len(m), children[n], leaves[n], saved[n], sha))
    return sorted(out, key=repr)


def trie(df):
    columns = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 4])
def test_trie_against_brute_force(spark, small_batches, seed):
    rows = sample(seed, 60)
    own, rebuilt = rebuild(rows)
    assert trie(P.prefix_trie(table(spark, rows), rebuilt=True)) == brute_trie(rebuilt)
    assert trie(P.prefix_trie(table(spark, rows))) == brute_trie(own)


def test_trie_of_copies_and_of_turnless_conversations(spark):
    turns = [("user", f"t{k}") for k in range(12)]
    rows = [(c, t, *turns[t]) for c in range(30) for t in range(1 + c % 12)] + [(99, 0, "user", "other")]
    short = next(c for c in range(101, 1000) if c % 5 and crc(str(c)) % 9 > 0)
    rows.append((short, 0, "user", "replaced by a lender that is not there"))
    own, rebuilt = rebuild(rows)
    assert rebuilt[short] == []
    assert trie(P.prefix_trie(table(spark, rows), rebuilt=True)) == brute_trie(rebuilt)
    assert trie(P.prefix_trie(table(spark, rows))) == brute_trie(own)


def test_trie_of_empty_tables(spark):
    assert P.prefix_trie(table(spark, []), rebuilt=True).collect() == []
    assert P.prefix_trie(table(spark, [(None, 1, "user", "x")])).collect() == []
    assert trie(P.prefix_trie(table(spark, [(3, None, None, None)]))) == brute_trie({3: [("", "")]})
