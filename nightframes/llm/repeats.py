"""Stretches of a fixed number of units that also start in a document with a smaller id.

Both substring operators share these steps; they differ in the unit (byte or word), in how
equal windows are recognised inside a bucket, and in what is rebuilt at the end.

1. *Anchors.* Every window's k-gram of least rank is its anchor. About one unit in fourteen
   (bytes) or five (words) is one. The stretch of all windows of an anchor is its fragment.
   Tasks send anchors to buckets as packed rows: 32 bits of the anchor's hash, 48 of its
   fragment's, and ids run-length coded; a task sends few rows to a bucket, not one each.
2. *Seeds.* A bucket finds the anchors that occur under different ids. Where the same
   fragment has a smaller id too, its document is told that all of it repeats. The first
   document of each fragment is told to look closer, if the anchor has other fragments.
   Everything else needs no further work.
3. *Fragments.* Those first documents send their fragments, each distinct one once.
4. *Windows.* A bucket finds equal windows among the fragments of an anchor, and answers
   with the spans that a smaller id has too.

Documents are shuffled once, by id: all joins read the same exchange. The number of buckets
follows the bytes of text, so a bucket holds about as much at any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframes.llm.buffers import Rolling, flat, minimizers, mix, ranges, slices
from nightframes.llm.tables import binary_column, identified, parts_for, staged, unpacked

BUCKET_BYTES = 12 << 20
# Anchors, and bytes of fragments, that a task gathers before it sends them on.
FLUSH_ANCHORS = 1 << 19
FLUSH_BYTES = 8 << 20
# Windows of a bucket looked at together.
CHUNK_WINDOWS = 1 << 19


@dataclass(frozen=True)
class Kind:
    """What a window is made of.

    units: bytes and bounds of texts -> a 64-bit value per unit, the texts' bounds, the units.
    payload: units, Rolling, first and last windows -> what a bucket needs to know of fragments.
    least: fragments -> for each of their windows the smallest id that has an equal one.
    """

    length: int
    k: int
    payload_type: str
    units: Callable
    payload: Callable
    least: Callable


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(bucket: np.ndarray, buckets: int) -> np.ndarray:
    return np.argsort(bucket.astype(np.uint16) if buckets <= 65536 else bucket, kind="stable")


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal rows starts."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def chunks(sizes: np.ndarray) -> list[slice]:
    """Cut a sequence into stretches whose sizes add up to about CHUNK_WINDOWS."""
    part = (np.cumsum(sizes) - sizes) // CHUNK_WINDOWS
    first = runs(part)
    return [slice(a, a + n) for a, n in zip(first.tolist(), lengths(first, len(part)).tolist())]


def anchors_of(kind: Kind, part: pa.RecordBatch):
    """Units, text bounds, and of each anchor: place, first and last window, hash, print."""
    values, bounds, raw = kind.units(*flat(part.column("text")))
    rolling = Rolling(values)
    grams = rolling.grams(kind.k)
    at, first, last = minimizers(grams, kind.k, kind.length, bounds)
    key = grams[at]
    prints = mix(rolling.of(first, last + kind.length) ^ mix(key + (at - first).astype(np.uint64)))
    return (raw, rolling, bounds), at, first, last, key, prints


def anchor_rows(kind: Kind, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(held: list) -> pa.RecordBatch:
        key, prints, owner = (np.concatenate(x) for x in zip(*held))
        bucket = bucket_of(key, buckets)
        order = by_bucket(bucket, buckets)
        key, prints, owner, bucket = key[order].astype(np.uint32), prints[order], owner[order], bucket[order]
        rows, spans = runs(bucket), runs(bucket, owner)
        each, of_row = lengths(rows, len(key)), lengths(np.searchsorted(spans, rows), len(spans))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[rows]),
                binary_column(key, each),
                binary_column((prints >> np.uint64(32)).astype(np.uint32), each),
                binary_column((prints >> np.uint64(16)).astype(np.uint16), each),
                binary_column(owner[spans], of_row),
                binary_column(lengths(spans, len(key)).astype(np.uint32), of_row),
            ],
            ["bucket", "keys", "high", "low", "ids", "counts"],
        )

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in slices(batch):
                owner = np.asarray(part.column("id"), np.int64)
                (_, _, bounds), at, _, _, key, prints = anchors_of(kind, part)
                held.append((key, prints, owner[np.searchsorted(bounds, at, side="right") - 1]))
                n += len(at)
                if n > FLUSH_ANCHORS:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return anchors


def seed_rows(group: pa.Table) -> pa.Table:
    """What the documents of a bucket's anchors have to know: seeds that repeat as a whole, seeds to extend."""
    bucket = group.column("bucket")[0].as_py()
    keys, _ = unpacked(group.column("keys"), np.uint32)
    prints = unpacked(group.column("high"), np.uint32)[0].astype(np.int64) << 16
    prints |= unpacked(group.column("low"), np.uint16)[0]
    ids, _ = unpacked(group.column("ids"), np.int64)
    counts, _ = unpacked(group.column("counts"), np.uint32)
    owner = np.repeat(ids, counts)
    order = np.argsort(keys)
    keys, prints, owner = keys[order], prints[order], owner[order]
    first = runs(keys)
    size = lengths(first, len(keys))
    warm = np.repeat(np.minimum.reduceat(owner, first) < np.maximum.reduceat(owner, first), size)
    keys, prints, owner = keys[warm], prints[warm], owner[warm]
    order = np.lexsort((owner, prints, keys))
    keys, prints, owner = keys[order], prints[order], owner[order]
    once = runs(keys, prints, owner)
    keys, prints, owner = keys[once], prints[once], owner[once]
    same = runs(keys, prints)  # each fragment under its smallest id
    whole = np.ones(len(keys), bool)
    whole[same] = False
    first = runs(keys)
    mixed = np.repeat(lengths(np.searchsorted(same, first), len(same)) > 1, lengths(first, len(keys)))
    keep = whole | mixed
    names = seed_names(keys[keep].astype(np.uint64) | np.uint64(bucket << 32), prints[keep].astype(np.uint64))
    return packed_seeds(group.column("parts")[0].as_py(), names, owner[keep], whole[keep])


def packed_seeds(parts: int, names: np.ndarray, owner: np.ndarray, whole: np.ndarray) -> pa.Table:
    """Seeds by part of the ids, with ids run-length coded."""
    part = (mix(owner.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((~whole, owner, part))
    part, names, owner, whole = part[order], names[order], owner[order], whole[order]
    rows, each = runs(part), runs(owner)
    many = lengths(np.searchsorted(each, rows), len(each))
    full = np.add.reduceat(whole.astype(np.int64), each) if len(each) else each
    return pa.table(
        {
            "part": pa.array(part[rows]),
            "ids": binary_column(owner[each], many),
            "full": binary_column(full, many),
            "rest": binary_column(lengths(each, len(owner)) - full, many),
            "names": binary_column(names, lengths(rows, len(names))),
        }
    )


def seeds_by_id(group: pa.Table) -> pa.Table:
    """One row per id of a part: the seeds that repeat as a whole, and those to extend."""
    ids, full, rest = (unpacked(group.column(c), np.int64)[0] for c in ("ids", "full", "rest"))
    names = unpacked(group.column("names"), np.uint64)[0]
    owner = np.repeat(ids, full + rest)
    whole = np.repeat(np.tile([True, False], len(ids)), np.stack([full, rest], 1).reshape(-1))
    order = np.lexsort((~whole, owner))
    names, owner, whole = names[order], owner[order], whole[order]
    first = runs(owner)
    size = lengths(first, len(owner))
    full = np.add.reduceat(whole.astype(np.int64), first) if len(first) else size
    return pa.table(
        {
            "id": pa.array(owner[first]),
            "whole": binary_column(names[whole], full),
            "extend": binary_column(names[~whole], size - full),
        }
    )


def seed_names(full: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """64 bits that stand for an anchor's bucket and hash and its fragment's print of 48 bits."""
    return mix(full + mix(prints))


def asked(part: pa.RecordBatch, field: str, text: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which anchors (``text`` and seed name) are among the packed names in column ``field``."""
    keys, per_text = unpacked(part.column(field), np.uint64)
    owner = np.repeat(np.arange(len(per_text)), per_text).astype(np.uint64)
    salt = np.uint64(0x9E3779B97F4A7C15)
    return np.isin(names + text.astype(np.uint64) * salt, keys + owner * salt)


def own_names(key: np.ndarray, prints: np.ndarray, buckets: int) -> np.ndarray:
    full = (key & np.uint64(0xFFFFFFFF)) | (bucket_of(key, buckets).astype(np.uint64) << np.uint64(32))
    return seed_names(full, prints >> np.uint64(16))


def fragment_rows(kind: Kind, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    fields = ("bucket", "key", "print", "nth", "id", "mark", "start", "windows", "place")

    def flush(held: dict[str, list]) -> pa.RecordBatch:
        # nth: number of the fragment's payload among those held
        col = {name: np.concatenate(held[name]) for name in fields}
        order = np.lexsort((col["print"], col["bucket"]))
        col = {name: v[order] for name, v in col.items()}
        new = runs(col["bucket"], col["print"])
        payload, sizes = np.concatenate(held["payload"]), np.concatenate(held["sizes"])
        begins = np.cumsum(sizes) - sizes
        fragment = np.repeat(np.arange(len(new)), lengths(new, len(order)))
        distinct = {name: v[new] for name, v in col.items()}
        rows = runs(distinct["bucket"])
        in_row = lengths(rows, len(new))
        within = fragment - np.repeat(np.searchsorted(new, new[rows]), in_row)[fragment]
        where = np.searchsorted(col["bucket"], distinct["bucket"][rows])
        nth, step = ranges(sizes[distinct["nth"]])
        taken = payload[begins[distinct["nth"]][nth] + step]
        of_row = np.add.reduceat(sizes[distinct["nth"]], rows)
        met = lengths(where, len(order))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(distinct["bucket"][rows]),
                binary_column(distinct["key"].astype(np.uint32), in_row),
                binary_column(distinct["windows"].astype(np.uint32), in_row),
                binary_column(distinct["place"].astype(np.uint32), in_row),
                binary_column(distinct["print"], in_row),
                binary_column(taken, of_row),
                binary_column(within.astype(np.uint32), met),
                binary_column(col["id"], met),
                binary_column(col["mark"], met),
                binary_column(col["start"].astype(np.int64), met),
            ],
            ["bucket", "keys", "windows", "places", "prints", "payload", "fragment", "ids", "marks", "starts"],
        )

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, payloads = {f: [] for f in (*fields, "payload", "sizes")}, 0, 0
        for batch in batches:
            for part in slices(batch):
                (raw, rolling, bounds), at, first, last, key, prints = anchors_of(kind, part)
                text = np.searchsorted(bounds, at, side="right") - 1
                hit = asked(part, "extend", text, own_names(key, prints, buckets))
                at, first, last, key, text, prints = (x[hit] for x in (at, first, last, key, text, prints))
                if not len(at):
                    continue
                data, sizes = kind.payload(raw, rolling, first, last)
                found = {
                    "bucket": bucket_of(key, buckets),
                    "key": key,
                    "print": prints,
                    "nth": payloads + np.arange(len(at)),
                    "id": np.asarray(part.column("id"), np.int64)[text],
                    "mark": np.asarray(part.column("mark"), np.int64)[text],
                    "start": first - bounds[text],
                    "windows": last - first + 1,
                    "place": at - first,
                    "payload": data,
                    "sizes": sizes,
                }
                for name, v in found.items():
                    held[name].append(v)
                payloads += len(at)
                n += data.nbytes + 60 * len(at)
                if n > FLUSH_BYTES:
                    yield flush(held)
                    held, n, payloads = {f: [] for f in held}, 0, 0
        if n:
            yield flush(held)

    return fragments


def span_rows(kind: Kind) -> Callable[[pa.Table], pa.Table]:
    """Spans of units to remove, as answers to documents."""

    def removed_runs(least, begin, windows, fragment, ids, marks, starts):
        occurrence, step = ranges(windows[fragment])
        gone = least[begin[fragment][occurrence] + step] < ids[occurrence]
        occurrence, step = occurrence[gone], step[gone]
        new = np.ones(len(occurrence), bool)
        new[1:] = (occurrence[1:] != occurrence[:-1]) | (step[1:] != step[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(occurrence))[: len(first)] - 1
        at = occurrence[first]
        return ids[at], marks[at], starts[at] + step[first], starts[at] + step[last] + kind.length

    def spans(group: pa.Table) -> pa.Table:
        keys, per_row = unpacked(group.column("keys"), np.uint32)
        windows = unpacked(group.column("windows"), np.uint32)[0].astype(np.int64)
        places = unpacked(group.column("places"), np.uint32)[0].astype(np.int64)
        prints = unpacked(group.column("prints"), np.uint64)[0]
        payload = unpacked(group.column("payload"), np.dtype(kind.payload_type))[0]
        fragment, met = unpacked(group.column("fragment"), np.uint32)
        base = np.cumsum(per_row) - per_row
        fragment = fragment.astype(np.int64) + np.repeat(base, met)
        ids, marks, starts = (unpacked(group.column(c), np.int64)[0] for c in ("ids", "marks", "starts"))
        own = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(own, fragment, ids)
        least = kind.least(keys, windows, places, prints, payload, own)
        begin = np.cumsum(windows) - windows
        found = [removed_runs(least, begin, windows, fragment[part], ids[part], marks[part], starts[part])
                 for part in chunks(windows[fragment])]
        doc, mark, lo, hi = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((lo, mark, doc))
        doc, mark, lo, hi = doc[order], mark[order], lo[order], hi[order]
        first = runs(doc, mark)
        size = lengths(first, len(doc))
        return pa.table(
            {
                "id": pa.array(doc[first]),
                "mark": pa.array(mark[first]),
                "spans": binary_column(np.stack([lo, hi], 1).reshape(-1), 2 * size),
            }
        )

    return spans


def repeated_spans(docs: DataFrame, kind: Kind) -> tuple[DataFrame, int]:
    """doc_id, id, mark, text, and what text_spans makes the removed spans of; number of buckets."""
    known = identified(docs)
    buckets = parts_for(known, BUCKET_BYTES)
    anchors = known.select("id", "text").mapInArrow(
        anchor_rows(kind, buckets),
        "bucket bigint, keys binary, high binary, low binary, ids binary, counts binary",
    )
    packed = anchors.withColumn("parts", F.lit(max(8, buckets // 8))).groupBy("bucket").applyInArrow(
        seed_rows, "part bigint, ids binary, full binary, rest binary, names binary"
    )
    seeds = packed.groupBy("part").applyInArrow(seeds_by_id, "id bigint, whole binary, extend binary")
    seeds = staged(seeds, "seeds")
    placed = known.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    told = placed.join(seeds, "id", "left")
    fragments = told.mapInArrow(
        fragment_rows(kind, buckets),
        "bucket bigint, keys binary, windows binary, places binary, prints binary, payload binary, fragment binary,"
        " ids binary, marks binary, starts binary",
    )
    spans = fragments.groupBy("bucket").applyInArrow(span_rows(kind), "id bigint, mark bigint, spans binary")
    found = spans.groupBy("id").agg(F.collect_list(F.struct("mark", "spans")).alias("spans"))
    return told.join(found, "id", "left").select("doc_id", "mark", "text", "whole", "spans"), buckets


def text_spans(kind: Kind, buckets: int, part: pa.RecordBatch) -> list[np.ndarray]:
    """For each text the removed runs of units, in order and joined where they touch; shape (n, 2)."""
    (_, _, bounds), at, first, last, key, prints = anchors_of(kind, part)
    text = np.searchsorted(bounds, at, side="right") - 1
    hit = asked(part, "whole", text, own_names(key, prints, buckets))
    whole = np.stack([first - bounds[text], last - bounds[text] + kind.length], 1)[hit]
    begin = np.searchsorted(text[hit], np.arange(part.num_rows + 1))
    found, marks = part.column("spans").to_pylist(), part.column("mark").to_pylist()
    out = []
    for i, (more, mark) in enumerate(zip(found, marks)):
        own = [np.frombuffer(x["spans"], np.int64).reshape(-1, 2) for x in more or () if x["mark"] == mark]
        out.append(merged(np.concatenate([whole[begin[i] : begin[i + 1]], *own])))
    return out


def merged(pairs: np.ndarray) -> np.ndarray:
    if not len(pairs):
        return pairs
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.flatnonzero(np.append(True, pairs[1:, 0] > reach[:-1]))
    return np.stack([pairs[new, 0], reach[np.append(new[1:], len(pairs)) - 1]], 1)


def span_lists(spans: list[np.ndarray]) -> pa.Array:
    items = [[{"start": int(a), "end": int(b)} for a, b in pairs] for pairs in spans]
    return pa.array(items, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
