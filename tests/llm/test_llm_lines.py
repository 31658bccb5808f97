"""Line dedup and its filters against brute force, and that what was inserted can be taken out."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from nightframes.llm import line_dedup as L
from nightframes.llm.cuckoo import CuckooFilter, FilterBank

LAST = (1 << 63) - 1


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, index_rows, chars, documents):
    count, holder = defaultdict(int), {}
    for i, t in index_rows:
        i = LAST if i is None else i
        for k in {key_of(x) for x in (t or "").split("\n")}:
            if len(k) >= chars:
                count[k] += 1
                holder[k] = max(i, holder.get(k, i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [
            x for x in lines
            if count[key_of(x)] < documents or holder[key_of(x)] == (LAST if i is None else i)
        ]
        out.append((LAST if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def found(df):
    return sorted((LAST if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect())


def lines_table(n=60, seed=3):
    rnd = random.Random(seed)
    pool = ["", "short", "  ", "The Same long line of text, everywhere", "  the same LONG line of text, everywhere \t"]
    pool += [f"a line number {k} with enough letters é" for k in range(12)] + ["é" * 20, "é" * 19, "x" * 20, "x" * 19]
    rows = [(k * 7 % 61, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 9)))) for k in range(n)]
    long_text = "\n".join(f"row {k % 4000} of a very long text" for k in range(30_000))
    rows += [(500, long_text), (501, long_text), (502, long_text + "\n")]
    return rows + [(None, pool[3]), (None, "\n".join(pool)), (None, None), (600, None), (601, ""), (5, pool[3]), (5, pool[3]), (-3, pool[3])]


@pytest.mark.parametrize("chars, documents", [(20, 3), (1, 2)])
def test_corpus_against_brute_force(docs_of, monkeypatch, chars, documents):
    monkeypatch.setattr(L, "SHARD_KEYS", 500)  # several shards
    rows = lines_table()
    assert found(L.dedup_corpus(docs_of(rows), chars, documents)) == brute(rows, rows, chars, documents)


def test_without_filters_and_without_broadcast(docs_of, monkeypatch):
    monkeypatch.setattr(L, "FILTER_BYTES", -1)
    monkeypatch.setattr(L, "BROADCAST_KEYS", -1)
    rows = lines_table(30)
    assert found(L.dedup_corpus(docs_of(rows))) == brute(rows, rows, 20, 3)


def state(index):
    exact = sorted(tuple(r) for r in L.entries(index).collect())
    return exact, sorted((r.high, r.low) for r in L.entries(index, index.least_documents).collect())


def asks_true(index):
    """Every frequent key passes the filter of its shard."""
    bank = L.bank_of(index).value
    keys = L.entries(index, index.least_documents).collect()
    low = np.array([r.low for r in keys], np.int64)
    high = np.array([r.high for r in keys], np.int64).view(np.uint64)
    return bool(bank.contains(low & (index.size - 1), high).all())


def test_documents_come_and_go(spark, docs_of, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 300)
    rows = lines_table(80, seed=9)
    first, second = rows[:50], rows[50:]
    ids = {i for i, _ in first}
    second = [(i, t) for i, t in second if i not in ids]
    one = L.insert(L.empty_index(spark), docs_of(first))
    both = L.insert(one, docs_of(second))
    assert both.size > one.size  # dealt anew to more shards
    assert found(L.dedup_lines(docs_of(second), one)) == brute(second, first, 20, 3)
    assert found(L.dedup_lines(docs_of(rows), both)) == brute(rows, first + second, 20, 3)
    back = L.delete(both, docs_of([(i, None) for i, _ in second] + [(987654, None)]))
    assert state(back) == state(one)
    assert asks_true(both) and asks_true(back)
    assert found(L.dedup_lines(docs_of(rows), back)) == brute(rows, first, 20, 3)
    # the largest holder goes and another one takes its place
    largest = max(i for i, _ in first if i is not None)
    less = L.delete(one, docs_of([(largest, None)]))
    assert state(less) == state(L.insert(L.empty_index(spark), docs_of([r for r in first if r[0] != largest])))
    again = L.insert(less, docs_of([r for r in first if r[0] == largest]))
    assert state(again) == state(one)
    nothing = L.delete(one, docs_of(first))
    assert state(nothing) == ([], [])


def test_empty_tables(spark, docs_of):
    index = L.insert(L.empty_index(spark), docs_of([]))
    assert L.dedup_lines(docs_of([]), index).collect() == []
    assert L.dedup_corpus(docs_of([])).collect() == []
    blank = [(1, None), (2, ""), (None, "\n \n")]
    assert found(L.dedup_lines(docs_of(blank), index)) == brute(blank, [], 20, 3)
    assert found(L.dedup_corpus(docs_of(blank))) == brute(blank, blank, 20, 3)
    assert state(L.delete(index, docs_of([(1, None)]))) == ([], [])


def test_filter_inserts_and_deletes():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64) * np.uint64(2))
    half = len(keys) // 2
    cuckoo = CuckooFilter.of(keys)
    assert cuckoo.contains(keys).all() and np.count_nonzero(cuckoo.table) == len(keys)
    cuckoo.delete(keys[half:])
    assert cuckoo.contains(keys[:half]).all() and np.count_nonzero(cuckoo.table) == half
    assert cuckoo.contains(keys[half:]).mean() < 0.01
    assert cuckoo.insert(keys[half:]) and cuckoo.contains(keys).all()
    again = CuckooFilter.from_bytes(cuckoo.to_bytes())
    again.delete(keys)
    assert not again.table.any()
    # equal fingerprints in the same buckets are told apart by number
    same = np.array([7, 7 + (1 << 40), 7 + (2 << 40)], np.uint64)
    few = CuckooFilter.of(same)
    few.delete(same[:2])
    assert few.contains(same[2:]).all() and np.count_nonzero(few.table) == 1
    bank = FilterBank([few.table, cuckoo.table])
    assert bank.contains(np.ones(len(keys), np.int64), keys).all()
    assert not CuckooFilter.sized(1).room(100)
