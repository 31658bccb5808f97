"""Lines that many documents share, counted in an index that documents can join and leave.

A line's key is the SHA-256 (first 128 bits) of its normal form. The index deals keys to
shards. A shard holds an exact table, one entry per key with the number of documents that
have it and the largest of their ids, and a cuckoo filter of the keys that have reached the
threshold: a document's lines are asked of the filter first, and only hits are looked up.
Inserting and deleting documents adds to and takes from the counts; a key that crosses the
threshold enters or leaves the filter. What each document brought is kept as references, so
a deletion can be undone and leaves the index as if the document had never been there.

Counts are combined on the map side before keys are dealt, so a line that a third of all
documents have is one row per task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframes.llm.buffers import slices
from nightframes.llm.cuckoo import CuckooFilter, FilterBank
from nightframes.llm.tables import NO_ID, binary_column, identified, staged, unpacked

LEAST_CHARS = 20
LEAST_DOCUMENTS = 3
# Distinct keys in one shard: 32 bytes each in the exact table, some 2 in the filter.
SHARD_KEYS = 200_000
# Bytes of all filters up to which every worker gets them, some 25 million keys; beyond
# that lines are looked up in the exact tables without asking the filters first.
FILTER_BYTES = 64 << 20
# Frequent keys, 24 bytes each, up to which they are broadcast for the exact lookup.
BROADCAST_KEYS = 500_000
BLANKS = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

SHARD = "shard bigint, high binary, low binary, counts binary, holders binary, filter binary"
REFERENCES = "id bigint, mark bigint, keys binary"


@dataclass(frozen=True)
class LineIndex:
    """``references``: what each document brought; ``shards``: exact tables and filters."""

    references: DataFrame
    shards: DataFrame
    size: int
    least_chars: int = LEAST_CHARS
    least_documents: int = LEAST_DOCUMENTS


def line_key(line: bytes, least: int) -> bytes | None:
    """The key of a line, or None where its normal form is shorter than ``least`` code points."""
    line = line.strip(BLANKS)
    if len(line) < least or (len(line) < 4 * least and len(line.decode(errors="replace")) < least):
        return None
    return hashlib.sha256(line.translate(LOWER)).digest()[:16]


def reference_rows(least: int):
    """The distinct keys of each document."""

    def rows(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                keys = [b"".join({k for x in (t or b"").split(b"\n") if (k := line_key(x, least))}) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("mark"), pa.array(keys, pa.binary())], ["id", "mark", "keys"]
                )

    return rows


def pair_rows(bank=None, shards: int = 1):
    """References one by one, as two halves of the key; of those that pass the filters, if there are any."""

    def rows(batches):
        for batch in batches:
            words, n = unpacked(batch.column("keys"), np.uint64)
            row = np.repeat(np.arange(len(n)), n // 2)
            high, low = words[0::2], words[1::2]
            if bank is not None:
                hit = bank.value.contains((low & np.uint64(shards - 1)).astype(np.int64), high)
                row, high, low = row[hit], high[hit], low[hit]
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pc.take(batch.column("id"), row), pc.take(batch.column("mark"), row),
                    pa.array(high.view(np.int64)), pa.array(low.view(np.int64)),
                ],
                ["id", "mark", "high", "low"],
            )

    return rows


def pairs(references: DataFrame, bank=None, shards: int = 1) -> DataFrame:
    schema = "id bigint, mark bigint, high bigint, low bigint"
    return references.mapInArrow(pair_rows(bank, shards), schema)


def opened(state: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    kinds = {"high": np.uint64, "low": np.uint64, "counts": np.int64, "holders": np.int64}
    return tuple(unpacked(state.column(c), kind)[0] for c, kind in kinds.items())


def changed(least_documents: int, leaving: bool):
    """One shard after the counts of arriving or leaving documents."""

    def merge(batch: pa.Table, state: pa.Table) -> pa.Table:
        high, low, counts, holders = opened(state)
        held = state.column("filter").to_pylist()
        cuckoo = CuckooFilter.from_bytes(held[0]) if held else CuckooFilter.sized(0)
        shard = (state if len(state) else batch).column("shard")[0].as_py()
        added = {c: np.asarray(batch.column(c), np.int64) for c in ("high", "low", "n", "holder")}
        # entries of the shard first, then the change of the same key
        all_high = np.append(high, added["high"].view(np.uint64))
        all_low = np.append(low, added["low"].view(np.uint64))
        order = np.lexsort((np.arange(len(all_high)) >= len(high), all_low, all_high))
        all_high, all_low = all_high[order], all_low[order]
        new = np.ones(len(order), bool)
        new[1:] = (all_high[1:] != all_high[:-1]) | (all_low[1:] != all_low[:-1])
        first = np.flatnonzero(new)
        before = np.append(counts, np.zeros(len(batch), np.int64))[order]
        change = np.append(np.zeros(len(high), np.int64), added["n"])[order]
        holder = np.append(holders, added["holder"])[order]
        if len(first):
            before, after = np.add.reduceat(before, first), np.add.reduceat(before + change, first)
            # the last row of a key is its change, which knows the holder among those that stay
            last = np.append(first[1:], len(order)) - 1
            holder = holder[last] if leaving else np.maximum.reduceat(holder, first)
        else:
            before = after = holder = np.zeros(0, np.int64)
        high, low = all_high[first], all_low[first]
        entering = high[(after >= least_documents) & (before < least_documents)]
        cuckoo.delete(high[(after < least_documents) & (before >= least_documents)])
        if not (cuckoo.room(len(entering)) and cuckoo.insert(entering)):
            cuckoo = CuckooFilter.of(high[after >= least_documents])
        stays = after > 0
        columns = [x[stays].tobytes() for x in (high, low, after, holder)]
        names = ["shard", "high", "low", "counts", "holders", "filter"]
        values = [pa.array([shard], pa.int64()), *(pa.array([c], pa.binary()) for c in [*columns, cuckoo.to_bytes()])]
        return pa.table(dict(zip(names, values)))

    return merge


def apply(index: LineIndex, batch: DataFrame, leaving: bool) -> DataFrame:
    """The shards after ``batch`` (high, low, n, holder; one row per key)."""
    shard = F.col("low").bitwiseAND(F.lit(index.size - 1))  # a power of two
    dealt = batch.withColumn("shard", shard).groupBy("shard")
    found = dealt.cogroup(index.shards.groupBy("shard")).applyInArrow(changed(index.least_documents, leaving), SHARD)
    return staged(found, "shards", compression="zstd")


def empty_index(spark: SparkSession, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> LineIndex:
    """An index without documents."""
    return LineIndex(
        spark.createDataFrame([], REFERENCES), spark.createDataFrame([], SHARD), 1, least_chars, least_documents
    )


def shard_rows(least: int):
    """Entries of the exact tables with a count of at least ``least``."""

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                high, low, counts, holders = opened(pa.Table.from_batches([batch.slice(i, 1)]))
                keep = counts >= least
                arrays = (high.view(np.int64), low.view(np.int64), counts, holders)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[keep]) for x in arrays], ["high", "low", "n", "holder"]
                )

    return rows


def entries(index: LineIndex, least: int = 1) -> DataFrame:
    """high, low, n, holder of every key that at least ``least`` documents have."""
    return index.shards.mapInArrow(shard_rows(least), "high bigint, low bigint, n bigint, holder bigint")


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with the documents of ``docs`` (doc_id, text) in it.

    Every row is a document; rows that share a doc_id are counted one by one. Null and empty
    texts have no keys, of a very long one only the keys are held. Other columns are ignored.
    """
    known = identified(docs).select("id", "mark", "text")
    brought = staged(known.mapInArrow(reference_rows(index.least_chars), REFERENCES), "references")
    counts = pairs(brought).groupBy("high", "low").agg(F.count("*").alias("n"), F.max("id").alias("holder"))
    total = brought.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    held = index.shards.agg(F.sum(F.octet_length("high"))).first()[0] or 0
    needed = 1 << max(0, -(-(total // 16 + held // 8) // SHARD_KEYS) - 1).bit_length()
    if needed > index.size:  # more shards: the entries are dealt anew
        fresh = replace(index, shards=index.shards.limit(0), size=needed)
        index = replace(fresh, shards=apply(fresh, entries(index), leaving=False))
    return replace(
        index, references=index.references.union(brought), shards=apply(index, counts, leaving=False)
    )


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents whose doc_id is in ``doc_ids``; unknown ids change nothing.

    A null doc_id stands for all rows without one.
    """
    gone = doc_ids.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id")).distinct()
    leaving = index.references.join(gone, "id", "left_semi")
    stay = staged(index.references.join(gone, "id", "left_anti"), "references")
    taken = staged(pairs(leaving).groupBy("high", "low").agg(F.count("*").alias("taken")), "taken")
    # the largest id among the documents that stay, for the keys of those that go
    left = pairs(stay).join(taken, ["high", "low"], "left_semi").groupBy("high", "low").agg(F.max("id").alias("holder"))
    batch = taken.join(left, ["high", "low"], "left").select(
        "high", "low", (-F.col("taken")).alias("n"), F.coalesce("holder", F.lit(NO_ID)).alias("holder")
    )
    return replace(index, references=stay, shards=apply(index, batch, leaving=True))


def bank_of(index: LineIndex):
    """All filters as a broadcast, or None where they are larger than FILTER_BYTES."""
    if (index.shards.agg(F.sum(F.octet_length("filter"))).first()[0] or 0) > FILTER_BYTES:
        return None
    tables = [np.zeros((1, 4), np.uint16)] * index.size
    for r in index.shards.select("shard", "filter").collect():  # at most FILTER_BYTES
        tables[r["shard"]] = CuckooFilter.from_bytes(r["filter"]).table
    return index.shards.sparkSession.sparkContext.broadcast(FilterBank(tables))


def kept_rows(least: int):
    """Documents without the lines whose keys are listed for them."""

    def rows(batches):
        for batch in batches:
            for part in slices(batch):
                text = part.column("text")
                n_lines = pc.add(pc.cast(pc.count_substring(text, "\n"), pa.int64()), 1).to_numpy(False).copy()
                dropped = np.zeros(len(n_lines), np.int64)
                kept = text.to_pylist()
                for i, keys in enumerate(part.column("keys").to_pylist()):
                    if not keys:
                        continue
                    known = {(k["high"], k["low"]) for k in keys}
                    out = []
                    for line in kept[i].encode().split(b"\n"):
                        key = line_key(line, least)
                        if key is None or (
                            int.from_bytes(key[:8], "little", signed=True),
                            int.from_bytes(key[8:], "little", signed=True),
                        ) not in known:
                            out.append(line)
                    dropped[i] = n_lines[i] - len(out)
                    kept[i] = b"\n".join(out).decode()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_lines), pa.array(dropped), pa.array(kept, pa.string())],
                    ["doc_id", "n_lines", "n_dropped", "kept"],
                )

    return rows


def dedup_lines(docs: DataFrame, index: LineIndex) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (text) of every row of ``docs``.

    A line goes if its key is in at least ``least_documents`` documents of the index and the
    document is not the one with the largest doc_id among them. Keys have at least
    ``least_chars`` code points after blanks at both ends are stripped; A-Z count as a-z. A
    null or empty text is one empty line. Rows without doc_id come after all others: they
    keep their lines. Rows that share a doc_id keep or lose a line together. A very long text
    is held once in a task, with its lines. An empty table gives none; other columns are
    ignored. ``docs`` need not be in the index.
    """
    known = identified(docs)
    asked = known.select("id", "mark", "text").mapInArrow(reference_rows(index.least_chars), REFERENCES)
    return without_lines(known, asked, index)


def without_lines(known: DataFrame, references: DataFrame, index: LineIndex) -> DataFrame:
    bank = bank_of(index)
    frequent = staged(entries(index, index.least_documents).select("high", "low", "holder"), "frequent")
    if frequent.count() <= BROADCAST_KEYS:
        frequent = F.broadcast(frequent)
    hits = pairs(references, bank, index.size).join(frequent, ["high", "low"]).filter("id <> holder")
    drops = hits.groupBy("id", "mark").agg(F.collect_set(F.struct("high", "low")).alias("keys"))
    told = known.join(drops, ["id", "mark"], "left").select("doc_id", "text", "keys")
    return told.mapInArrow(kept_rows(index.least_chars), "doc_id bigint, n_lines bigint, n_dropped bigint, kept string")


def dedup_corpus(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``dedup_lines`` of a table against the index of the table itself."""
    index = insert(empty_index(docs.sparkSession, least_chars, least_documents), docs)
    return without_lines(identified(docs), index.references, index)
