"""Packing of documents into sequences of a fixed number of tokens by best-two-fit.

Which lengths go together depends on how many documents have each length and on nothing
else, so the plan is made from the histogram of lengths (as many numbers as a sequence has
tokens, whatever the size of the table) and holds for all documents at once. A document
then finds its place from its rank among those of its length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightframes.llm.buffers import ranges, slices
from nightframes.llm.encoder import WordEncoder, default_path
from nightframes.llm.tables import binary_column, identified, kept, staged, trimmed

SIZE = 2048
END = 0
# Rows of (length, task) offsets, 24 bytes each, up to which they are broadcast.
BROADCAST_ROWS = 1_000_000
RANK_BITS = 48


def plan_sequences(counts: np.ndarray, size: int) -> list[tuple[int, list[int]]]:
    """(how many sequences, lengths in each) so that every counted document is placed.

    A sequence is filled greedily with the longest documents that fit. If a gap is left, its
    shortest document goes back when two others fit the widened gap more tightly. The same
    choice is repeated as often as the documents last.
    """
    left = np.asarray(counts, np.int64).copy()
    out = []
    while left.any():
        have = np.flatnonzero(left).tolist()
        chosen, gap = [], size
        used: Counter = Counter()
        at = len(have) - 1
        while gap and at >= 0:
            at = min(at, bisect_right(have, gap) - 1)
            if at < 0:
                break
            length = have[at]
            n = min(gap // length, int(left[length]))
            chosen += [length] * n
            used[length] += n
            gap -= n * length
            at -= 1
        if gap and len(chosen):
            pair = tighter_pair(left, used, chosen[-1], gap, size)
            if pair:
                used[chosen.pop()] -= 1
                chosen = sorted([*chosen, *pair], reverse=True)
                used.update(pair)
        repeats = min(int(left[x]) // n for x, n in used.items() if n)
        for length, n in used.items():
            left[length] -= n * repeats
        out.append((repeats, chosen))
    return out


def tighter_pair(left: np.ndarray, used: Counter, last: int, gap: int, size: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum above ``last`` within ``gap + last``."""
    free = left.copy()
    for length, n in used.items():
        free[length] -= n
    room = gap + last
    first = np.flatnonzero(free[: room + 1] > 0)
    first = first[first > 0]
    if not len(first):
        return None
    below = np.maximum.accumulate(np.where(free > 0, np.arange(len(free)), 0))
    second = below[np.minimum(room - first, first)]
    alone = (second == first) & (free[first] < 2)
    second[alone] = below[first[alone] - 1]
    total = np.where(second > 0, first + second, 0)
    best = int(np.argmax(total))
    return (int(first[best]), int(second[best])) if total[best] > last else None


def place_table(plan: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """For each length and stretch of ranks: sequences, copies in one sequence, first offset."""
    rows, base = [], 0
    taken: Counter = Counter()
    for repeats, lengths in plan:
        offset = 0
        for length, n in Counter(lengths).items():
            rows.append(((length << RANK_BITS) + taken[length], n, base, offset))
            taken[length] += n * repeats
            offset += n * length
        base += repeats
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("key", "copies", "sequence", "offset"), np.ascontiguousarray(table.T)))


def piece_rows(path: str, size: int, end: int):
    """Cut documents into pieces; number each piece among those of its length in the task."""

    def pieces(batches):
        encoder = kept(("words", path), lambda: WordEncoder(path))
        close = np.array([end], encoder.dtype).tobytes()
        width = np.dtype(encoder.dtype).itemsize
        met = np.zeros(size + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch):
                ids = encoder.encode([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
                # all ids of the slice in one array, each document's with its end
                flat_ids = np.frombuffer(close.join([*ids, b""]), encoder.dtype).astype("<u4")
                tokens = np.array([len(x) for x in ids], np.int64) // width + 1
                which, nth = ranges(-(-tokens // size))
                length = np.minimum(tokens[which] - nth * size, size)
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order])
                rank = np.empty(len(length), np.int64)
                rank[order] = met[length[order]] + np.arange(len(length)) - first
                met += np.bincount(length, minlength=size + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pc.take(part.column("doc_id"), pa.array(which)),
                        pa.array(nth.astype(np.int32)),
                        pa.array(nth * size),
                        pa.array(length),
                        binary_column(flat_ids, length),
                        pa.array(np.full(len(length), task, np.int32)),
                        pa.array(rank),
                    ],
                    ["doc_id", "piece", "start", "length", "ids", "task", "rank"],
                )

    return pieces


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens.

    A document is the ids of its text and then ``end``. Only documents longer than ``size``
    are cut. Returns one row per piece: doc_id, piece, start, length, ids (binary, unsigned
    little-endian 32-bit), sequence_id, offset. Null text is empty: one piece, the end id.
    Repeated rows and rows without doc_id are packed as they come. An empty table gives none;
    other columns are ignored.
    """
    known = identified(docs).select("doc_id", "text")
    pieces = known.mapInArrow(
        trimmed(piece_rows(path or default_path(), size, end)),
        "doc_id bigint, piece int, start bigint, length bigint, ids binary, task int, rank bigint",
    )
    pieces = staged(pieces, "pieces", compression="zstd")
    met = staged(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(size + 1, np.int64)
    for length, n in met.groupBy("length").agg(F.sum("n")).collect():  # at most ``size`` rows
        counts[length] = n
    table = place_table(plan_sequences(counts, size))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        key = (length << RANK_BITS) + rank
        at = np.searchsorted(table["key"], key, side="right") - 1
        turn, copy = np.divmod(key - table["key"][at], table["copies"][at])
        return pd.DataFrame({"sequence_id": table["sequence"][at] + turn, "offset": table["offset"][at] + copy * length})

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = met.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    if met.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)
    placed = pieces.join(before, ["length", "task"]).withColumn("at", place("length", F.col("before") + F.col("rank")))
    return placed.select("doc_id", "piece", "start", "length", "ids", "at.sequence_id", "at.offset")
