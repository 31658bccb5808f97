from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from nightframes.llm import exact_dedup, jaccard_join
from nightframes.llm.perfect_hash import PerfectHash

LAST = (1 << 63) - 1


def key(i):
    return LAST if i is None else i


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_against_brute_force(docs_of, odd_rows):
    got = exact_dedup.mark_duplicates(docs_of(odd_rows)).collect()
    groups = {}
    for i, t in odd_rows:
        groups.setdefault(normal(t), []).append((-len(t or ""), key(i)))
    want = sorted(
        (key(i), min(groups[normal(t)])[1], len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest())
        for i, t in odd_rows
    )
    assert sorted((key(r.doc_id), key(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_distinct_documents_keep_their_columns(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    kept = exact_dedup.distinct_documents(docs)
    assert kept.schema.names == docs.schema.names
    texts = [normal(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({normal(t) for _, t in odd_rows})
    assert exact_dedup.mark_duplicates(docs_of([])).collect() == []
    assert exact_dedup.distinct_documents(docs_of([])).collect() == []


def test_perfect_hash_gives_every_key_a_slot_of_its_own():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    table = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    assert PerfectHash.from_bytes(PerfectHash.build(keys[:0]).to_bytes()).slots(keys[:3]).tolist() == [-1] * 3


def shingles(text, width):
    words = re.findall(r"[^\x20\t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def components(rows, width, percent):
    sets, parent = [shingles(t, width) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for x, (i, _) in enumerate(rows):
        least[find(x)] = min(key(i), least.get(find(x), LAST))
    return [(key(i), len(sets[x]), least[find(x)]) for x, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("width, percent", [(3, 90), (2, 60)])
def test_jaccard_against_all_pairs(docs_of, odd_rows, width, percent):
    got = jaccard_join.linked_documents(docs_of(odd_rows), width, percent).collect()
    assert sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in got) == sorted(
        components(odd_rows, width, percent)
    )


@pytest.mark.parametrize("block", [3, 4096])
def test_a_chain_of_near_copies_is_one_component(docs_of, monkeypatch, block):
    """Neighbours link, the ends do not: the list's first member does not reach all."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    words = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join([*words[: 100 - 5 * i], *[f"u{k}" for k in range(5 * i)]])) for i in range(15)]
    rows = [(14 - i if i % 2 else i + 20, t) for i, t in rows]
    got = jaccard_join.linked_documents(docs_of(rows), 2, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(components(rows, 2, 85))


def test_bitmaps_of_different_sizes_never_tell_more_apart_than_the_sets():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 24, 1100)
    sets = [base[:k] for k in (1, 200, 256, 257, 500, 520, 1000, 1030, 1100)]
    n = np.array([len(x) for x in sets])
    wide = jaccard_join.bitmap_bits(n)
    assert len(set(wide.tolist())) > 2 and (wide >= 2 * n).all()
    packed = [np.packbits((np.bincount(x % w, minlength=w) & 1).astype(np.uint8)).tobytes() for x, w in zip(sets, wide)]
    bits = jaccard_join.Bitmaps(pa.array(packed, pa.binary()))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(n)), np.arange(len(n))))
    found = bits.differ(a, bits, b)
    assert (found <= np.abs(n[a] - n[b])).all() and (found[a == b] == 0).all()
    # 1099 random shingles apart, folded to 512 bits: some 252 are to be expected
    assert 200 < found[(a == 0) & (b == 8)][0] < 300


def test_forest_keeps_what_joins():
    assert jaccard_join.forest([1, 2, 3, 5], [2, 3, 1, 4], {1: 1, 2: 2, 3: 3, 4: 3, 5: 3}) == [0, 1]


def test_representatives(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    kept = jaccard_join.representatives(docs, 5, 80)
    assert kept.schema.names == docs.schema.names
    whole = components(odd_rows, 5, 80)
    blank = sorted(key(i) for i, n, _ in whole if not n)
    want = sorted({c for _, n, c in whole if n})
    got = kept.collect()
    assert sorted(key(r.doc_id) for r in got if shingles(r.text, 5)) == want
    assert sorted(key(r.doc_id) for r in got if not shingles(r.text, 5)) == blank
    assert jaccard_join.representatives(docs_of([])).collect() == []


def test_slices_without_any_word(spark, docs_of):
    """A partition of blanks beside others, and a table of blanks only."""
    blanks, texts = [(i, t) for i, t in enumerate([None, "", " \n"])], [(i, f"words of the text {i // 2}") for i in range(10, 50)]
    mixed = docs_of(blanks).coalesce(1).union(docs_of(texts).coalesce(1))
    for rows, docs in ((blanks, docs_of(blanks)), (blanks + texts, mixed)):
        got = jaccard_join.linked_documents(docs, 3, 90).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(components(rows, 3, 90))
        stay = jaccard_join.representatives(docs).collect()
        assert sorted(r.doc_id for r in stay) == sorted({c for _, n, c in components(rows, 5, 80)})


def test_shards_follow_the_larger_side_of_uneven_ids(docs_of, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", 20)
    rows = [(0, "text 7"), *((10**12 + i, f"text {i % 150}") for i in range(300))]
    keyed = exact_dedup.keyed(docs_of(rows))
    first, rest = keyed.filter("id = 0"), keyed.filter("id > 0")
    shards = exact_dedup.shards_of(first, rest)
    assert 6 <= shards <= 10
    # most shards of the index are empty
    for found in (exact_dedup.look_up(exact_dedup.build_index(first, shards), rest, shards), exact_dedup.decide(keyed)):
        assert sorted((r.id, r.size) for r in found.collect()) == sorted((0, 3) if i == 7 else (10**12 + i, 2) for i in range(150))


def test_members_that_fit_none_of_their_list_in_size_leave_it():
    def listed(members):  # (key, node, size) of one bucket
        key, node, size = zip(*members)
        columns = {"keys": (key, np.uint64), "nodes": (node, np.int64), "sizes": (size, np.uint32), "counts": ([1] * len(key), np.uint32)}
        packed = pa.table({c: pa.array([np.array(x, t).tobytes()], pa.binary()) for c, (x, t) in columns.items()})
        return jaccard_join.shared_lists(90)(packed).to_pylist()

    got = listed([(7, 1, 100), (7, 2, 50), (7, 3, 91), (7, 4, 20), (7, 5, 83), (7, 6, 52), (8, 1, 100), (8, 2, 50)])
    chains = {}
    for r in got:
        chains.setdefault(r["list"], {})[r["node"]] = r["lead"]
    # 83 fits 91, not 100: one chain; a lead is the first member of the whole list
    assert sorted(map(sorted, chains.values())) == [[1, 3, 5], [2, 6]]
    assert {n: lead for c in chains.values() for n, lead in c.items()} == {1: -1, 2: -1, 3: 1, 5: -1, 6: -1}
    rng = np.random.default_rng(3)
    members = [(int(k), n, int(s)) for n, (k, s) in enumerate(zip(rng.integers(0, 9, 300), rng.integers(1, 200, 300)))]
    together = {}
    for r in listed(members):
        together.setdefault(r["list"], set()).add(r["node"])
    pairs = {p for c in together.values() for p in itertools.combinations(sorted(c), 2)}
    for (k, a, m), (other, b, n) in itertools.combinations(members, 2):
        assert k != other or 100 * min(m, n) < 90 * max(m, n) or (a, b) in pairs
