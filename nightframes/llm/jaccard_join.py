"""Size-aware join of documents whose sets of word shingles have a high Jaccard similarity.

Small sets are enumerated: two of them link only if they share a subset of the size of their
overlap, so each sends all subsets it may have in common with another. Large sets go to
inverted lists: in an order of all shingles from rare to common, two sets that link share one
of their first few, so only these are listed. A set near the boundary does both. Where the
boundary lies follows from the cost of either way on the table at hand.

How common a shingle is comes from a count sketch of fixed size over all documents. It only
sets the order, so its errors cost time and lose nothing.

Members of a list are first compared with the list's first member: of the first members that
size and a parity bitmap allow (neither rejects a link), each document tries the closest. What
is linked then is one component. Lists that still hold several components are searched in pairs
of blocks for members that may link across components; they are handed on as the edges that
join them into clusters, never as all pairs. Each such document then sends its whole set to its
cluster once (in pairs of blocks, where a cluster is large), where all pairs across components
are decided, and a spanning forest of the links comes out.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightframes.llm.buffers import Rolling, flat, mix, ranges, slices, word_hashes, words
from nightframes.llm.components import roots
from nightframes.llm.repeats import by_bucket, lengths, runs
from nightframes.llm.tables import NO_ID, binary_column, identified, staged, trimmed, unpacked

SKETCH = 1 << 21
SKETCH_BLOCK = 1 << 16
# Bits of the smallest and the largest bitmap; between them it has at least two for each shingle.
BITS, MOST_BITS = 512, 1 << 24
# Bits of the filter for texts to look up, 8 MB whatever the size of the table, and bytes of
# a block of it.
FILTER_BITS = 1 << 26
FILTER_BLOCK = 1 << 16
# Subsets of one set up to which enumerating them is considered at all.
MOST_SUBSETS = 600
# Members of a list, and shingles of a cluster, that make one block.
BLOCK = 4096
BLOCK_GRAMS = 1 << 21
# Keys of lists, and members of lists with several components, in one bucket.
BUCKET_KEYS = 1 << 20
BUCKET_MEMBERS = 1 << 16
# Slices over which the rows of one component are spread.
SLICES = 16


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each text, in order, and how many there are."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, first = words(low, bounds)
    hashes = word_hashes(low, starts, ends)
    rolling = Rolling(hashes)
    n = np.diff(first)
    many = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    text, step = ranges(many)
    begin = first[text] + step
    size = np.minimum(n[text], width)
    grams = mix(rolling.of(begin, begin + size) + size.astype(np.uint64))
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    once = runs(text, grams)
    return grams[once], np.bincount(text[once], minlength=len(n))


def sketch_rows(width: int):
    """How many documents have shingles of each cell, summed over a task."""

    def count(batches):
        met = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for part in slices(batch):
                grams, _ = shingle_sets(*flat(part.column("text")), width)
                met += np.bincount((grams & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        blocks = np.minimum(met, 65535).astype(np.uint16).reshape(-1, SKETCH_BLOCK)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(blocks))), binary_column(blocks.reshape(-1), np.full(len(blocks), SKETCH_BLOCK))],
            ["block", "counts"],
        )

    return count


def summed(group: pa.Table) -> pa.Table:
    total = np.zeros(SKETCH_BLOCK, np.int64)
    for one in group.column("counts"):
        total += np.frombuffer(one.as_py(), np.uint16)
    ranks = np.round(8 * np.log2(1.0 + total)).astype(np.uint16)
    return pa.table({"block": group.column("block").slice(0, 1), "ranks": pa.array([ranks.tobytes()], pa.binary())})


def shingle_ranks(known: DataFrame, width: int) -> np.ndarray:
    """The rank of each cell from rare to common: 4 MB, whatever the size of the table."""
    rows = known.select("text").mapInArrow(trimmed(sketch_rows(width)), "block bigint, counts binary")
    found = rows.groupBy("block").applyInArrow(summed, "block bigint, ranks binary").collect()
    out = np.zeros(SKETCH, np.uint16)
    for r in found:
        out[r["block"] * SKETCH_BLOCK : (r["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(r["ranks"], np.uint16)
    return out


def least_overlap(n, percent: int):
    """Overlap below which a set of n links with no other."""
    return -(-percent * n // 100)


def subset_count(n: int, percent: int) -> int:
    return sum(comb(n, k) for k in range(n - least_overlap(n, percent) + 1))


def bitmap_bits(n: np.ndarray) -> np.ndarray:
    """Powers of two that grow with the sets, so that bitmaps of long texts tell them apart as well."""
    return np.int64(1) << np.ceil(np.log2(np.clip(2 * n, BITS, MOST_BITS))).astype(np.int64)


SIGNATURE = "id bigint, mark bigint, n bigint, high bigint, low bigint, keys binary, small binary, bitmap binary, cost double"


def signature_rows(width: int, percent: int, ranks, most_small: int):
    """Per document: size and print of its set, its rarest shingles, a parity bitmap, small sets whole."""

    def sign(batches):
        rank_of = ranks.value
        for batch in batches:
            for part in slices(batch):
                grams, n = shingle_sets(*flat(part.column("text")), width)
                text = np.repeat(np.arange(len(n)), n)
                rank = rank_of[(grams & np.uint64(SKETCH - 1)).astype(np.int64)]
                order = np.lexsort((grams, rank, text))
                first = np.cumsum(n) - n
                listed = np.where(n > 0, n - least_overlap(n, percent) + 1, 0)
                nth, step = ranges(listed)
                picked = order[first[nth] + step]
                cost = np.bincount(nth, weights=2.0 ** (rank[picked] / 8.0), minlength=len(n)).astype(np.float64)
                wide = bitmap_bits(n)
                spot = np.repeat(np.cumsum(wide) - wide, n) + ((grams >> np.uint64(40)).astype(np.int64) & (wide[text] - 1))
                packed = np.packbits((np.bincount(spot, minlength=wide.sum()) & 1).astype(np.uint8))
                whole = np.where(n <= most_small, n, 0)
                s_nth, s_step = ranges(whole)
                prefix = np.append(np.uint64(0), np.cumsum(mix(grams)))
                second = np.append(np.uint64(0), np.cumsum(mix(grams + np.uint64(12345))))
                stop = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("mark"),
                        pa.array(n),
                        pa.array((prefix[stop] - prefix[first]).view(np.int64)),
                        pa.array((second[stop] - second[first]).view(np.int64)),
                        binary_column(grams[picked], listed),
                        binary_column(grams[first[s_nth] + s_step], whole),
                        binary_column(packed, wide // 8),
                        pa.array(cost),
                    ],
                    ["id", "mark", "n", "high", "low", "keys", "small", "bitmap", "cost"],
                )

    return sign


def boundary(signatures: DataFrame, percent: int, most_small: int) -> int:
    """The size up to which enumerating subsets costs less than scanning lists."""
    found = signatures.filter((F.col("n") > 0) & (F.col("n") <= most_small)).groupBy("n")
    rows = {r["n"]: (r["many"], r["cost"]) for r in found.agg(F.count("*").alias("many"), F.sum("cost").alias("cost")).collect()}
    costs, enumerated = [], 0.0
    scanned = sum(many + cost for many, cost in rows.values())
    for n in range(most_small + 1):
        many, cost = rows.get(n, (0, 0.0))
        enumerated += many * (subset_count(n, percent) if n else 0)
        scanned -= many + cost
        costs.append((enumerated + scanned, n))
    return min(costs)[1]


def subset_keys(grams: np.ndarray, percent: int) -> list[int]:
    """Keys of all subsets of the sizes at which this set can overlap with one it links with."""
    values = mix(grams).tolist()
    total, out = sum(values), []
    for gone in range(len(grams) - int(least_overlap(len(grams), percent)) + 1):
        size = (len(grams) - gone) * 0x9E3779B97F4A7C15
        for left_out in combinations(values, gone):
            out.append((total - sum(left_out) + size) & (2**64 - 1))
    return out


def list_rows(percent: int, light: int, buckets: int):
    """Subset keys of light sets and list keys of the others, to buckets as packed rows."""
    both = least_overlap(light + 1, percent)

    def flush(held):
        key, node, size = (np.concatenate(x) for x in zip(*held))
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = by_bucket(bucket, buckets)
        key, node, size, bucket = key[order], node[order], size[order], bucket[order]
        # keys one by one, nodes and sizes once for the keys of a node in a bucket
        rows, same = runs(bucket), runs(bucket, node)
        many = lengths(np.searchsorted(same, rows), len(same))
        columns = (node[same], size[same].astype(np.uint32), lengths(same, len(key)).astype(np.uint32))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[rows]), binary_column(key, lengths(rows, len(key))), *(binary_column(x, many) for x in columns)],
            ["bucket", "keys", "nodes", "sizes", "counts"],
        )

    def rows(batches):
        held, n = [], 0
        for batch in batches:
            size = np.asarray(batch.column("n"), np.int64)
            node = np.asarray(batch.column("node"), np.int64)
            keys, many = unpacked(batch.column("keys"), np.uint64)
            heavy = np.repeat(size >= both, many)
            held.append((mix(keys[heavy]), np.repeat(node, many)[heavy], np.repeat(size, many)[heavy]))
            small, many = unpacked(batch.column("small"), np.uint64)
            begin = np.cumsum(many) - many
            for i in np.flatnonzero((size <= light) & (size > 0)).tolist():
                own = np.array(subset_keys(small[begin[i] : begin[i] + many[i]], percent), np.uint64)
                held.append((mix(own), np.full(len(own), node[i]), np.full(len(own), size[i])))
            n += len(keys)
            if n > 1 << 19:
                yield flush(held)
                held, n = [], 0
        if held and sum(len(x[0]) for x in held):
            yield flush(held)

    return rows


def size_chains(key: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For members in order of list: a number for their chain of sizes in the list, and its length.

    In order of size, a chain ends where the next member is too large to link with the one before
    it. Then no member of a chain can link with one of another.
    """
    order = np.lexsort((size, key))
    ordered, sizes = key[order], size[order]
    begins = np.ones(len(order), bool)
    begins[1:] = (ordered[1:] != ordered[:-1]) | ~size_fits(sizes[:-1], sizes[1:], percent)
    first = np.flatnonzero(begins)
    many = lengths(first, len(order))
    number, length = np.empty(len(order), np.uint64), np.empty(len(order), np.int64)
    number[order] = np.repeat(mix(ordered[first] + sizes[first].astype(np.uint64)), many)
    length[order] = np.repeat(many, many)
    return number, length


def shared_lists(percent: int):
    """Members of the lists with more than one, with the list's first member.

    A list is cut into chains of sizes that may link; members that are alone in theirs go.
    """

    def members(group: pa.Table) -> pa.Table:
        kinds = {"keys": np.uint64, "nodes": np.int64, "sizes": np.uint32, "counts": np.uint32}
        key, node, size, count = (unpacked(group.column(c), t)[0] for c, t in kinds.items())
        node, size = np.repeat(node, count), np.repeat(size.astype(np.int64), count)
        order = np.lexsort((node, key))
        key, node, size = key[order], node[order], size[order]
        once = runs(key, node)
        key, node, size = key[once], node[once], size[once]
        first = runs(key)
        lead = np.repeat(first, lengths(first, len(key)))
        fits = size_fits(size, size[lead], percent) & (node != node[lead])
        chain, many = size_chains(key, size, percent)
        keep = many > 1
        return pa.table(
            {
                "list": pa.array(chain[keep].view(np.int64)),
                "node": pa.array(node[keep]),
                "lead": pa.array(np.where(fits, node[lead], -1)[keep]),
            }
        )

    return members


def decided(percent: int):
    """The pairs that link, from their whole sets."""

    def links(batches):
        for batch in batches:
            a, b = batch.column("a_set").to_pylist(), batch.column("b_set").to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(a, b)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    keep.append(i)
            if keep:
                yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return links


def set_rows(width: int):
    def sets(batches):
        for batch in batches:
            for part in slices(batch):
                grams, n = shingle_sets(*flat(part.column("text")), width)
                yield pa.RecordBatch.from_arrays([part.column("node"), binary_column(grams, n)], ["node", "grams"])

    return sets


class Bitmaps:
    """Bitmaps of different sizes; the larger of two is folded to the size of the smaller."""

    def __init__(self, column):
        self.words, self.size = unpacked(column, np.uint64)
        self.at = np.cumsum(self.size) - self.size

    def folded(self, which: np.ndarray, size: int, to: int) -> np.ndarray:
        rows = self.words[self.at[which][:, None] + np.arange(size)]
        return np.bitwise_xor.reduce(rows.reshape(len(which), size // to, to), axis=1)

    def differ(self, own: np.ndarray, other: "Bitmaps", which: np.ndarray) -> np.ndarray:
        """In how many bits own[k] of these and which[k] of the other bitmaps differ."""
        x, y = self.size[own], other.size[which]
        out = np.zeros(len(own), np.int64)
        for kind in np.unique((x << 32) | y).tolist():
            a, b = kind >> 32, kind & (2**32 - 1)
            rows = np.flatnonzero((x == a) & (y == b))
            apart = self.folded(own[rows], a, min(a, b)) ^ other.folded(which[rows], b, min(a, b))
            out[rows] = np.bitwise_count(apart).sum(axis=1, dtype=np.int64)
        return out


def size_fits(n, other_n, percent: int):
    return 100 * np.minimum(n, other_n) >= percent * np.maximum(n, other_n)


def bits_fit(differ, n, percent: int):
    """Whether sets of ``n`` shingles together may link if their bitmaps differ in so many bits."""
    return differ * (100 + percent) <= n * (100 - percent)


def possible(bits: Bitmaps, n: np.ndarray, own: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of the places ``others`` in ``own`` may link with place ``i`` by size and bitmap."""
    fits = size_fits(n[own[others]], n[own[i]], percent)
    near = own[others[fits]]
    differ = bits.differ(np.full(len(near), own[i]), bits, near)
    fits[fits] = bits_fit(differ, n[near] + n[own[i]], percent)
    return fits


def closest_leads(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """For each node b the one a, of those it may link with, whose bitmap is closest."""

    def allowed(batches):
        for batch in batches:
            a_n, b_n = (np.asarray(batch.column(c), np.int64) for c in ("a_n", "b_n"))
            every = np.arange(len(a_n))
            differ = Bitmaps(batch.column("a_bitmap")).differ(every, Bitmaps(batch.column("b_bitmap")), every)
            keep = size_fits(a_n, b_n, percent) & bits_fit(differ, a_n + b_n, percent)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(differ)], ["a", "b", "differ"])
            yield out.filter(pa.array(keep))

    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("bitmap").alias("a_bitmap"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("bitmap").alias("b_bitmap"))
    joined = pairs.distinct().join(a, "a").join(b, "b").select("a", "b", "a_n", "b_n", "a_bitmap", "b_bitmap")
    found = joined.mapInArrow(allowed, "a bigint, b bigint, differ bigint")
    return found.groupBy("b").agg(F.min(F.struct("differ", "a")).alias("x")).select("x.a", "b")


def bit_rows(batches):
    """The bits of a task's marks, in blocks."""
    met = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        met[np.asarray(batch.column("mark"), np.int64) % FILTER_BITS] = True
    blocks = np.packbits(met).reshape(-1, FILTER_BLOCK)
    some = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(some), binary_column(blocks[some].reshape(-1), np.full(len(some), FILTER_BLOCK))], ["block", "bits"]
    )


def joined_bits(group: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in group.column("bits")])
    return pa.table({"block": group.column("block").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})


def marked_texts(known: DataFrame, needed: DataFrame) -> DataFrame:
    """Rows that may be needed: a filter of fixed size keeps most other texts out of the shuffle."""
    found = needed.select("mark").mapInArrow(bit_rows, "block bigint, bits binary")
    found = found.groupBy("block").applyInArrow(joined_bits, "block bigint, bits binary").collect()
    packed = np.zeros((FILTER_BITS // 8 // FILTER_BLOCK, FILTER_BLOCK), np.uint8)
    for r in found:
        packed[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    shared = known.sparkSession.sparkContext.broadcast(packed.reshape(-1))

    def kept(batches):
        bits = shared.value
        for batch in batches:
            at = np.asarray(batch.column("mark"), np.int64) % FILTER_BITS
            yield batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))

    return known.select("id", "mark", "text").mapInArrow(kept, "id bigint, mark bigint, text string")


def whole_sets(needed: DataFrame, known: DataFrame, width: int, name: str) -> DataFrame:
    """(node, grams) of the nodes of ``needed`` (node, id, mark); only their texts are looked up."""
    texts = marked_texts(known, needed).join(needed.select("node", "id", "mark"), ["id", "mark"])
    texts = texts.dropDuplicates(["id", "mark"]).select("node", "text")
    return staged(texts.mapInArrow(trimmed(set_rows(width)), "node bigint, grams binary"), name)


def lead_links(lists: DataFrame, nodes: DataFrame, known: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of documents with the closest first member of their lists."""
    first = lists.filter("lead >= 0").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    pairs = staged(closest_leads(first, nodes, percent), "lead-pairs")
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    needed = staged(needed.join(nodes.select("node", "id", "mark"), "node"), "lead-needed")
    sets = whole_sets(needed, known, width, "lead-sets")
    a = sets.select(F.col("node").alias("a"), F.col("grams").alias("a_set"))
    b = sets.select(F.col("node").alias("b"), F.col("grams").alias("b_set"))
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "a_set", "b_set")
    return staged(both.mapInArrow(trimmed(decided(percent)), "a bigint, b bigint"), "lead-links")


def block_pairs(members: DataFrame, group: str, weight, limit: int) -> DataFrame:
    """Members (node, root, ...) of groups with several roots, dealt to pairs of blocks (first, second).

    Any two members of different roots meet in a pair of blocks. A group up to ``limit`` is one
    block. In a larger one the members of its largest root have blocks of their own and meet only
    the others.
    """
    parts = members.groupBy(group, "root").agg(F.sum(weight).alias("weight"))
    split = parts.groupBy(group).agg(
        F.max_by("root", "weight").alias("main"), F.count("*").alias("roots"),
        F.sum("weight").alias("weight"), F.max("weight").alias("main_weight"),
    ).filter("roots > 1")
    whole, one, none = F.col("weight") <= limit, F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    split = split.select(
        group,
        "main",
        F.when(whole, one).otherwise(F.ceil((F.col("weight") - F.col("main_weight")) / limit)).alias("others"),
        F.when(whole, none).otherwise(F.ceil(F.col("main_weight") / limit)).alias("mains"),
    )
    own, is_main = F.xxhash64("node"), (F.col("root") == F.col("main")) & (F.col("mains") > 0)
    block = F.when(is_main, F.col("others") + F.pmod(own, F.greatest("mains", one))).otherwise(F.pmod(own, "others"))
    meets = F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains"))
    dealt = members.join(split, group).withColumn("block", block)
    dealt = dealt.withColumn("other", F.explode(F.sequence(none, meets - 1)))
    return dealt.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})


def blocks_of(group: pa.Table, name: str):
    """For each pair of blocks: its rows, and those of the first and of the second block."""
    listed, first, second, block = (np.asarray(group.column(c), np.int64) for c in (name, "first", "second", "block"))
    order = np.lexsort((second, first, listed))
    cut = runs(listed[order], first[order], second[order])
    for at, size in zip(cut.tolist(), lengths(cut, len(order)).tolist()):
        own = order[at : at + size]
        own = own[np.argsort(block[own], kind="stable")]
        asks = np.flatnonzero(block[own] == first[own[0]])
        base = asks if first[own[0]] == second[own[0]] else np.flatnonzero(block[own] == second[own[0]])
        yield own, asks, base


def merged(part: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Make one part of those of ``i`` and ``others``; one of others for each part that was not yet that of i."""
    parts, at = np.unique(part[others], return_index=True)
    new = parts != part[i]
    part[np.isin(part, parts[new])] = part[i]
    return others[at[new]]


def forest(a: list[int], b: list[int], root_of: dict[int, int]) -> list[int]:
    """The places of edges that join something not yet joined by roots or the edges before them."""
    up: dict[int, int] = {}

    def top(x):
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a, b)):
        x, y = top(root_of[x]), top(root_of[y])
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append(k)
    return kept


def open_edges(percent: int):
    """Members that may link with one of another component of their list, and edges that join all such.

    A row (a, b) is an edge; where a member is on none it comes with itself. There are at most
    as many edges as members.
    """

    def edges(group: pa.Table) -> pa.Table:
        node, n, root = (np.asarray(group.column(c), np.int64) for c in ("node", "n", "root"))
        bits = Bitmaps(group.column("bitmap"))
        met, left, right = np.zeros(len(node), bool), [], []
        for own, asks, base in blocks_of(group, "list"):
            own_root, within = root[own], asks is base
            part = np.unique(own_root, return_inverse=True)[1]
            for k, i in enumerate(asks.tolist()):
                rest = base[k + 1 :] if within else base
                rest = rest[own_root[rest] != own_root[i]]
                fits = rest[possible(bits, n, own, i, rest, percent)]
                if len(fits):
                    met[own[i]] = True
                    met[own[fits]] = True
                    for j in merged(part, i, fits).tolist():
                        left.append(int(node[own[i]]))
                        right.append(int(node[own[j]]))
        some = np.unique(node[met])
        kept = forest(left, right, dict(zip(node[met].tolist(), root[met].tolist())))
        left, right = [left[k] for k in kept], [right[k] for k in kept]
        alone = np.setdiff1d(some, np.array(left + right, np.int64)).tolist()
        return pa.table({"a": pa.array(left + alone, pa.int64()), "b": pa.array(right + alone, pa.int64())})

    return edges


def open_members(lists: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): documents that may link across components, and what joins them into clusters."""
    placed = nodes.select("node", "n").join(labels, "node", "left")
    placed = placed.select("node", "n", F.coalesce("root", "node").alias("root"))
    rooted = lists.select("list", "node").join(placed, "node")
    # a bitmap grows with its set
    dealt = block_pairs(rooted, "list", F.expr("1 + n div 1024"), BLOCK).join(nodes.select("node", "bitmap"), "node")
    buckets = buckets_for(lists.sparkSession, lists.count(), BUCKET_MEMBERS)
    bucket = F.pmod(F.xxhash64("list", "first", "second"), F.lit(buckets)).alias("bucket")
    dealt = dealt.select("list", "first", "second", "block", "node", "n", "root", "bitmap", bucket)
    return dealt.groupBy("bucket").applyInArrow(open_edges(percent), "a bigint, b bigint").distinct()


def spanning_links(percent: int):
    """Decides all pairs of a cluster's blocks that lie in different components; links that join these."""

    def links(group: pa.Table) -> pa.Table:
        node, n, root = (np.asarray(group.column(c), np.int64) for c in ("node", "n", "root"))
        bits = Bitmaps(group.column("bitmap"))
        grams, many = unpacked(group.column("grams"), np.uint64)
        begin = np.cumsum(many) - many
        left, right = [], []
        for own, asks, base in blocks_of(group, "cluster"):
            own_n, within = n[own], asks is base
            nth, step = ranges(own_n)
            named = np.unique(grams[begin[own][nth] + step], return_inverse=True)[1]
            start = np.cumsum(own_n) - own_n
            here = np.zeros(len(named), bool)
            part = np.unique(root[own], return_inverse=True)[1]
            for k, i in enumerate(asks.tolist()):
                rest = base[k + 1 :] if within else base
                rest = rest[part[rest] != part[i]]
                rest = rest[possible(bits, n, own, i, rest, percent)]
                if not len(rest):
                    continue
                mine = named[start[i] : start[i] + own_n[i]]
                here[mine] = True
                nth, step = ranges(own_n[rest])
                shared = np.bincount(nth, weights=here[named[start[rest][nth] + step]], minlength=len(rest)).astype(np.int64)
                here[mine] = False
                linked = rest[100 * shared >= percent * (own_n[i] + own_n[rest] - shared)]
                for j in merged(part, i, linked).tolist():
                    left.append(int(node[own[i]]))
                    right.append(int(node[own[j]]))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return links


def cross_links(
    lists: DataFrame, nodes: DataFrame, labels: DataFrame, known: DataFrame, width: int, percent: int
) -> DataFrame:
    """Links across the components of ``labels`` that join them as all links would."""
    edges = staged(open_members(lists, nodes, labels, percent), "open")
    for_a, for_b = (labels.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
    joins = edges.filter("a <> b").join(for_a, "a", "left").join(for_b, "b", "left")
    joins = joins.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).distinct()
    clusters = staged(roots(joins, "clusters").withColumnRenamed("root", "cluster"), "clusters")
    needed = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().join(labels, "node", "left")
    needed = needed.select("node", F.coalesce("root", "node").alias("root"))
    needed = needed.join(clusters.select(F.col("node").alias("root"), "cluster"), "root")
    needed = staged(needed.join(nodes.select("node", "id", "mark", "n", "bitmap"), "node"), "open-needed")
    sets = whole_sets(needed, known, width, "open-sets")
    total = needed.agg(F.sum("n")).first()[0] or 0
    buckets = buckets_for(lists.sparkSession, total, BLOCK_GRAMS)
    dealt = block_pairs(needed.drop("id", "mark"), "cluster", F.col("n"), BLOCK_GRAMS).join(sets, "node")
    bucket = F.pmod(F.xxhash64("cluster", "first", "second"), F.lit(buckets)).alias("bucket")
    dealt = dealt.select("cluster", "first", "second", "block", "node", "n", "root", "bitmap", "grams", bucket)
    return staged(dealt.groupBy("bucket").applyInArrow(spanning_links(percent), "a bigint, b bigint"), "open-links")


def buckets_for(spark, items: int, each: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items // each))


def key_count(nodes: DataFrame, percent: int, light: int) -> int:
    """How many keys all nodes send to lists."""
    subsets = F.array(*[F.lit(subset_count(n, percent) if n else 0) for n in range(light + 1)])
    listed = F.when(F.col("n") >= least_overlap(light + 1, percent), F.octet_length("keys") / 8).otherwise(0)
    small = F.when(F.col("n") <= light, F.get(subsets, F.col("n").cast("int"))).otherwise(0)
    return int(nodes.agg(F.sum(listed + small)).first()[0] or 0)


def linked_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, component_id of every row.

    Two documents link if ``100 * intersection >= percent * union`` holds for their sets of
    distinct ``width``-word shingles (words are runs of anything but blanks, A-Z in lower
    case; fewer words are one shingle). component_id is the smallest doc_id that links reach.
    Null, empty and blank texts have no shingles and link with nothing: their component is
    their own doc_id. Rows without doc_id take part under the largest id and show null only
    if all of their component has none. Repeated rows are in one component. An empty table
    gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    known = identified(docs)
    most_small = max(n for n in range(1, 200) if subset_count(n, percent) <= MOST_SUBSETS)
    ranks = spark.sparkContext.broadcast(shingle_ranks(known, width))
    sign = signature_rows(width, percent, ranks, most_small)
    signed = known.select("id", "mark", "text").mapInArrow(trimmed(sign), SIGNATURE)
    signed = staged(signed.withColumn("node", F.monotonically_increasing_id()), "signatures")
    full = signed.filter("n > 0")
    light = boundary(full, percent, most_small)
    # one node for each distinct set
    group = full.groupBy("high", "low", "n")
    nodes = staged(group.agg(F.min(F.struct("node", "id", "mark", "keys", "small", "bitmap")).alias("x"))
                   .select("high", "low", "n", "x.*"), "nodes")
    buckets = buckets_for(spark, key_count(nodes, percent, light), BUCKET_KEYS)
    packed = nodes.select("node", "n", "keys", "small").mapInArrow(
        trimmed(list_rows(percent, light, buckets)), "bucket bigint, keys binary, nodes binary, sizes binary, counts binary"
    )
    lists = packed.groupBy("bucket").applyInArrow(shared_lists(percent), "list bigint, node bigint, lead bigint")
    lists = staged(lists, "lists")
    links = lead_links(lists, nodes, known, width, percent)
    labels = staged(roots(links, "stars"), "labels")
    links = links.union(cross_links(lists, nodes, labels, known, width, percent))
    labels = staged(roots(links, "stars"), "labels")
    placed = signed.select("id", "mark", "n", "high", "low", F.col("node").alias("own")).join(
        nodes.select("high", "low", "n", "node"), ["high", "low", "n"], "left"
    )
    placed = placed.join(labels, "node", "left").select(
        "id", "mark", "n", F.coalesce("root", "node", "own").alias("root")
    )
    placed = staged(placed, "placed")
    # only roots of several rows are joined; a large one is spread over slices
    least = placed.groupBy("root").agg(F.min("id").alias("component"), F.count("*").alias("rows")).filter("rows > 1")
    least = least.select("root", "component", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    sliced = placed.withColumn("slice", F.pmod(F.xxhash64("id", "mark"), F.lit(SLICES)).cast("int"))
    component = F.coalesce("component", "id")
    return sliced.join(least, ["root", "slice"], "left").select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"),
        "mark",
        F.col("n").alias("n_shingles"),
        F.nullif(component, F.lit(NO_ID)).alias("component_id"),
    )


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all columns: the smallest doc_id, and of its rows one.

    Rows without shingles stay all. Links are those of linked_documents.
    """
    found = linked_documents(docs, width, percent)
    own, to = F.coalesce("doc_id", F.lit(NO_ID)), F.coalesce("component_id", F.lit(NO_ID))
    first = found.filter((own == to) & (F.col("n_shingles") > 0)).groupBy(own.alias("__nf_id")).agg(F.min("mark").alias("__nf_mark"))
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumns({"__nf_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)), "__nf_mark": F.xxhash64(text)})
    told = marked.join(first.withColumn("__nf_stays", F.lit(True)), ["__nf_id", "__nf_mark"], "left")
    nth = F.row_number().over(Window.partitionBy("__nf_id", "__nf_mark").orderBy("__nf_stays"))
    blank = F.translate(text, " \t\n\x0b\x0c\r", "") == ""
    kept = told.withColumn("__nf_nth", nth).filter(blank | (F.col("__nf_stays") & (F.col("__nf_nth") == 1)))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
