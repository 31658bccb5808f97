"""Suffix-array dedup: bytes covered by a 50-byte string that an earlier document has too.

Suffixes are compared through prefix polynomial hashes: a binary search over the length of
the common prefix finds where suffixes part with a logarithmic number of probes. The suffixes
of each bucket are put in order by the first bytes that tell those of a run apart, a few times,
and by mergesort with such comparisons where they still agree. Neighbours in that order with
equal hashes of the whole length are compared byte by byte before they count.
Fragments equal as a whole do not come that far: they are taken for equal by hashes
(bucket and 32 bits of the anchor, 48 of the fragment), named by 64 bits, neither sorted nor compared.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nightframes.llm.buffers import BYTE_VALUES, Rolling, ranges, slices
from nightframes.llm.repeats import Kind, chunks, lengths, repeated_spans, runs, span_lists, text_spans

LENGTH = 50
# Bytes of an anchor. Shorter ones would be fewer, but many would recur by chance.
ANCHOR = 24
# Bytes that suffixes of a run are put in order by before the mergesort: what a 64-bit number holds.
WORD = 8
# How often runs are cut by such bytes; each time most suffixes find their place.
CUTS = 3
# Windows compared byte by byte at once.
VERIFY_ROWS = 1 << 17


def byte_units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return BYTE_VALUES[data], bounds, data


def common_prefix(rolling: Rolling, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Length of the common prefix, at most ``length``, by binary search on equal hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), length, np.int64)
    for _ in range(int(length).bit_length()):
        middle = (low + high + 1) >> 1
        same = rolling.of(a, a + middle) == rolling.of(b, b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def before(rolling: Rolling, data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int, ties: np.ndarray) -> np.ndarray:
    """Whether suffix a comes before suffix b by its first ``length`` bytes; ``ties`` if they are equal."""
    shared = common_prefix(rolling, a, b, length)
    whole = shared == length
    at = np.minimum(shared, length - 1)
    return np.where(whole, ties, data[a + at] < data[b + at])


def shared_prefix(rolling: Rolling, starts: np.ndarray, run: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Length of the prefix that all suffixes of a run share, at most ``length``, by binary search on equal hashes."""
    heads = starts[first]
    low, high = np.zeros(len(first), np.int64), np.full(len(first), length, np.int64)
    for _ in range(int(length).bit_length()):
        middle = (low + high + 1) >> 1
        alike = rolling.of(starts, starts + middle[run]) == rolling.of(heads, heads + middle)[run]
        same = np.logical_and.reduceat(alike, first)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def cut_runs(data: np.ndarray, rolling: Rolling, starts: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes within each run of ``group`` by what tells most of them apart, and the runs still to sort.

    All suffixes of a run share a prefix (prefix hashes tell how long); they are put in order by
    the WORD bytes after it, equal ones as they came. The second array numbers the runs of
    suffixes, in that order, that agree in these too; it is -1 where nothing is left to sort.
    """
    first = runs(group)
    size = lengths(first, len(starts))
    run = np.repeat(np.arange(len(first)), size)
    shared = shared_prefix(rolling, starts, run, first, length)
    width = min(WORD, length)
    at = starts + np.minimum(shared, length - width)[run]
    word = np.zeros(len(starts), np.uint64)
    for step in range(width):
        word = word << np.uint64(8) | data[at + step]
    order = np.lexsort((word, run))
    first = runs(run, word[order])
    size = lengths(first, len(starts))
    done = (size == 1) | (shared[run[first]] == length)
    return order, np.repeat(np.where(done, -1, np.arange(len(first))), size)


def suffix_order(data: np.ndarray, rolling: Rolling, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Order of the suffixes within each run of ``group`` (which must be sorted) by their first ``length`` bytes.

    Runs are cut by their first different bytes a few times; those that agree there as well are merge-sorted.
    """
    order, todo = np.arange(len(starts)), np.arange(len(starts))
    for _ in range(CUTS):
        if len(todo):
            part = order[todo]
            cut, group = cut_runs(data, rolling, starts[part], group, length)
            order[todo] = part[cut]
            todo, group = todo[group >= 0], group[group >= 0]
    if len(todo):
        part = order[todo]
        order[todo] = part[merged_order(data, rolling, starts[part], group, length)]
    return order


def merged_order(data: np.ndarray, rolling: Rolling, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Order of the suffixes within each run of ``group`` by mergesort, equal ones as they came.

    All merges of one level are done together: each suffix finds its rank in the sorted
    neighbour run by binary search.
    """
    n = len(starts)
    order = np.arange(n)
    first = runs(group)
    size = lengths(first, n)
    begin, size = np.repeat(first, size), np.repeat(size, size)
    place = order - begin
    run = 1
    while run < (int(size.max()) if n else 0):
        left = place % (2 * run) < run
        other = begin + place - place % (2 * run) + np.where(left, run, 0)
        stop = np.minimum(other + run, begin + size)
        moving = np.flatnonzero(other < stop)
        low, high = other[moving], stop[moving]
        mine, is_left = starts[order[moving]], left[moving]
        open_ = np.arange(len(moving))
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            probe = starts[order[middle]]
            # a left suffix stays before equal right ones
            earlier = before(rolling, data, probe, mine[open_], length, ~is_left[open_])
            low[open_] = np.where(earlier, middle + 1, low[open_])
            high[open_] = np.where(earlier, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        place_new = place.copy()
        within = place[moving] % run
        place_new[moving] = (place[moving] - place[moving] % (2 * run)) + within + (low - other[moving])
        next_order = np.empty_like(order)
        next_order[begin + place_new] = order
        order = next_order
        place = np.arange(n) - begin
        run *= 2
    return order


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    same = np.ones(len(a), bool)
    for lo in range(0, len(a), VERIFY_ROWS):
        part = slice(lo, lo + VERIFY_ROWS)
        for step in range(length):
            same[part] &= data[a[part] + step] == data[b[part] + step]
    return same


def smallest(data: np.ndarray, rolling: Rolling, start: np.ndarray, key: np.ndarray, own: np.ndarray, length: int) -> np.ndarray:
    """For each window the least of ``own`` among the equal windows of its group."""
    order = suffix_order(data, rolling, start, key, length)
    start = start[order]
    same = np.zeros(len(start), bool)
    whole = rolling.of(start, start + length)
    near = np.flatnonzero((key[1:] == key[:-1]) & (whole[1:] == whole[:-1])) + 1
    same[near[same_bytes(data, start[near - 1], start[near], length)]] = True
    first = np.flatnonzero(~same)
    answer = np.empty_like(own)
    answer[order] = np.repeat(np.minimum.reduceat(own[order], first), lengths(first, len(own)))
    return answer


def kind_of(length: int, anchor: int) -> Kind:
    def payload(data, rolling, first, last):
        nth, step = ranges(last - first + length)
        return data[first[nth] + step], last - first + length

    def least(keys, windows, places, prints, data, own):
        begin = np.cumsum(windows + length - 1) - (windows + length - 1)
        at = np.cumsum(windows) - windows
        fragment, step = ranges(windows)
        answer = own[fragment]
        order = np.lexsort((prints, keys))
        first = runs(keys[order])
        size = lengths(first, len(order))
        several = np.zeros(len(keys), bool)
        several[order] = np.repeat(size > 1, size)
        rolling = Rolling(BYTE_VALUES[data])
        todo = np.flatnonzero(several[fragment])
        if not len(todo):
            return answer
        start = begin[fragment[todo]] + step[todo]
        key = keys[fragment[todo]].astype(np.int64) * length + (places[fragment[todo]] - step[todo])
        # only windows with the anchor at the same place can be equal
        order = np.argsort(key, kind="stable")
        todo, start, key = todo[order], start[order], key[order]
        first = runs(key)
        for groups in chunks(lengths(first, len(key))):
            stop = first[groups.stop] if groups.stop < len(first) else len(key)
            part = slice(first[groups.start], stop)
            answer[todo[part]] = smallest(data, rolling, start[part], key[part], answer[todo[part]], length)
        return answer

    return Kind(length, anchor, "uint8", byte_units, payload, least)


def kept_rows(kind: Kind, buckets: int):
    def kept(batches):
        for part in chain.from_iterable(map(slices, batches)):
            spans, stays, sizes = text_spans(kind, buckets, part), [], []
            for data, pairs in zip(part.column("text").cast(pa.binary()).to_pylist(), spans):
                sizes.append(len(data))
                cuts = [0, *pairs.reshape(-1).tolist(), len(data)]
                stays.append(b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), span_lists(spans), pa.array(stays, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    return kept


def dedup_substrings(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Remove bytes covered by a string of ``length`` bytes that also starts in a smaller doc_id.

    Returns doc_id, n_bytes, spans (array of struct start, end: maximal removed runs of
    bytes) and kept (binary: the remaining bytes). Strings are judged on the input and never
    cross documents. Null text is empty; texts below ``length`` bytes are kept whole. Of
    equal texts the one with the smallest doc_id stays whole. A row without doc_id comes
    after all others; rows that share a doc_id do not remove each other's bytes. An empty
    table gives none; other columns are ignored.
    """
    kind = kind_of(length, anchor)
    told, buckets = repeated_spans(docs, kind)
    return told.mapInArrow(
        kept_rows(kind, buckets),
        "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary",
    )
