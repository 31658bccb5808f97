from __future__ import annotations

import random
import re

import pytest

from nightframes.llm import suffix_dedup
from nightframes.llm.seed_extend import dedup_passages
from nightframes.llm.suffix_dedup import dedup_substrings

LAST = (1 << 63) - 1


def brute(rows, split, length):
    """(id, text) -> (units, removed flags), windows judged by the smallest id that has them."""
    first = {}
    cut = [(LAST if i is None else i, split(t or "")) for i, t in rows]
    for i, u in cut:
        for p in range(len(u) - length + 1):
            w = tuple(u[p : p + length])
            first[w] = min(i, first.get(w, i))
    out = []
    for i, u in cut:
        gone = [False] * len(u)
        for p in range(len(u) - length + 1):
            if first[tuple(u[p : p + length])] < i:
                gone[p : p + length] = [True] * length
        out.append((i, u, gone))
    return out


def key(i):
    return LAST if i is None else i


def spans(gone):
    edges = [p for p in range(len(gone) + 1) if (p < len(gone) and gone[p]) != (p > 0 and gone[p - 1])]
    return list(zip(edges[::2], edges[1::2]))


@pytest.mark.parametrize("length, anchor", [(50, 24), (12, 5)])
def test_bytes_against_brute_force(docs_of, odd_rows, length, anchor):
    got = [
        (key(r.doc_id), r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept))
        for r in dedup_substrings(docs_of(odd_rows), length, anchor).collect()
    ]
    want = [
        (i, len(u), spans(gone), bytes(b for b, g in zip(u, gone) if not g))
        for i, u, gone in brute(odd_rows, lambda t: t.encode(), length)
    ]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("length, anchor", [(13, 6), (4, 2)])
def test_words_against_brute_force(docs_of, odd_rows, length, anchor):
    got = [
        (key(r.doc_id), r.n_words, [(s.start, s.end) for s in r.spans], r.kept)
        for r in dedup_passages(docs_of(odd_rows), length, anchor).collect()
    ]
    want = [
        (i, len(u), spans(gone), " ".join(w for w, g in zip(u, gone) if not g))
        for i, u, gone in brute(odd_rows, lambda t: re.findall(r"[^\x20\t-\r]+", t), length)
    ]
    assert sorted(got) == sorted(want)


def test_empty_table(docs_of):
    assert dedup_substrings(docs_of([])).collect() == []
    assert dedup_passages(docs_of([])).collect() == []


def test_suffix_order_is_the_order_of_the_bytes():
    import numpy as np

    rnd = random.Random(3)
    data = bytes(rnd.choice(b"ab") for _ in range(900))
    flat = np.frombuffer(data, np.uint8)
    rolling = suffix_dedup.Rolling(suffix_dedup.BYTE_VALUES[flat])
    starts = np.array(rnd.sample(range(880), 300))
    group = np.sort(np.array([rnd.randrange(4) for _ in starts]))
    order = suffix_dedup.suffix_order(flat, rolling, starts, group, 20)
    want = sorted(range(300), key=lambda i: (group[i], data[starts[i] : starts[i] + 20], i))
    assert order.tolist() == want


def test_suffixes_that_differ_early_are_not_compared_one_by_one(monkeypatch):
    import numpy as np

    rnd = random.Random(4)
    anchor = bytes(rnd.choice(b"abcdefgh") for _ in range(24))
    pieces = [bytes(rnd.choice(b"abcdefgh") for _ in range(13)) + anchor + bytes(rnd.choice(b"abcdefgh") for _ in range(13)) for _ in range(1000)]
    data = b"".join([*pieces, *pieces[:100], *(p[:21] + p[21:37] + b"x" * 13 for p in pieces[:100])])
    flat = np.frombuffer(data, np.uint8)
    rolling = suffix_dedup.Rolling(suffix_dedup.BYTE_VALUES[flat])
    compared, before = [], suffix_dedup.before
    monkeypatch.setattr(suffix_dedup, "before", lambda *a: compared.append(len(a[2])) or before(*a))
    starts = np.arange(1200) * 50
    order = suffix_dedup.suffix_order(flat, rolling, starts, np.zeros(1200, np.int64), 50)
    assert order.tolist() == sorted(range(1200), key=lambda i: (data[i * 50 : i * 50 + 50], i))
    assert sum(compared) < 1200
