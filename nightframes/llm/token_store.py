"""Token ids in binary shards with a perfect-hash index by document key.

A shard is two files in the shared folder: ``.ids`` holds the raw ids of its documents, one
after the other (16-bit little-endian if the vocabulary allows, else 32-bit), and ``.key``
an index: a minimal perfect hash of the keys, and for each slot the key's fingerprint and
the range of its documents, whose offsets follow. A key is found in constant time, and a
key that is not there is told by its fingerprint.

Shards are key ranges in ascending order. Each task writes its shard under a name of its
own, and only names that the committed manifest lists are read: a task that is run again
leaves at most an unlisted file.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightframes.llm.buffers import mix, ranges, slices
from nightframes.llm.encoder import WordEncoder, default_path
from nightframes.llm.perfect_hash import PerfectHash
from nightframes.llm.tables import NO_ID, binary_column, identified, kept, parts_for, shared_dir, staged

END = 2
SHARD_BYTES = 24 << 20
MANIFEST = "shard int, file string, width int, documents bigint, tokens bigint, first bigint, last bigint"


def filesystem(folder: str):
    """The store and path of a folder given as a path or URI."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def index_bytes(ids: np.ndarray, offsets: np.ndarray) -> bytes:
    """The index of documents with ascending ``ids`` that start at ``offsets`` (one more than ids)."""
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    prints = mix(ids[first].astype(np.uint64))
    table = PerfectHash.build(prints)
    slots = table.slots(prints)
    entries = np.zeros((len(first), 3), np.int64)
    entries[slots] = np.stack([prints.view(np.int64), first, np.diff(np.append(first, len(ids)))], 1)
    packed = table.to_bytes()
    return np.array([len(packed), len(first), len(ids)], np.int64).tobytes() + packed + entries.tobytes() + offsets.tobytes()


class ShardIndex:
    def __init__(self, data: bytes):
        size, keys, documents = np.frombuffer(data, np.int64, 3).tolist()
        self.table = PerfectHash.from_bytes(data[24 : 24 + size])
        self.entries = np.frombuffer(data, np.int64, 3 * keys, 24 + size).reshape(-1, 3)
        self.offsets = np.frombuffer(data, np.int64, documents + 1, 24 + size + 24 * keys)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the asked keys each found document answers, and the document's number."""
        prints = mix(ids.astype(np.uint64))
        slots = self.table.slots(prints)
        there = slots >= 0
        there[there] = self.entries[slots[there], 0] == prints[there].view(np.int64)
        asked = np.flatnonzero(there)
        entry = self.entries[slots[asked]]
        which, step = ranges(entry[:, 2])
        return asked[which], entry[which, 1] + step


def write_rows(path: str, folder: str, end: int):
    def write(batches):
        encoder = kept(("words", path), lambda: WordEncoder(path))
        close = np.array([end], encoder.dtype).tobytes()
        store, base = filesystem(folder)
        shard = TaskContext.get().partitionId()
        name = f"{base}/{shard:07d}-{uuid.uuid4().hex}"
        ids, sizes = [], []
        with store.open_output_stream(f"{name}.ids") as out:
            for batch in batches:
                for part in slices(batch):
                    for x in encoder.encode(part.column("text").cast(pa.binary()).to_pylist()):
                        out.write(x + close)
                        sizes.append(len(x) + len(close))
                    ids.append(np.asarray(part.column("id"), np.int64))
        if not sizes:
            store.delete_file(f"{name}.ids")
            return
        width = np.dtype(encoder.dtype).itemsize
        keys = np.concatenate(ids)
        offsets = np.append(0, np.cumsum(sizes)) // width
        with store.open_output_stream(f"{name}.key") as out:
            out.write(index_bytes(keys, offsets))
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "shard": shard, "file": name, "width": width, "documents": len(keys),
                    "tokens": int(offsets[-1]), "first": int(keys[0]), "last": int(keys[-1]),
                }
            ],
            pa.schema(
                [("shard", pa.int32()), ("file", pa.string()), ("width", pa.int32())]
                + [(c, pa.int64()) for c in ("documents", "tokens", "first", "last")]
            ),
        )

    return write


def write_store(docs: DataFrame, folder: str | None = None, path: str | None = None, end: int = END) -> DataFrame:
    """Write the ids of every document, then ``end``, in ascending doc_id order.

    Returns the manifest, one row per shard, with the number of tokens before it in
    ``before``. Null text is empty; rows without doc_id come last, under one key; rows that
    share a doc_id lie next to each other, by their text's hash. An empty table writes
    nothing. Other columns are ignored. ``folder`` is one that all executors share; without
    it, one below the session's shared folder.
    """
    spark = docs.sparkSession
    folder = folder or os.path.join(shared_dir(spark), "staged", f"tokens-{uuid.uuid4().hex}")
    known = identified(docs)
    store, base = filesystem(folder)
    store.create_dir(base, recursive=True)
    ordered = known.select("id", "mark", "text").repartitionByRange(parts_for(known, SHARD_BYTES), "id")
    written = ordered.sortWithinPartitions("id", "mark").select("id", "text")
    manifest = staged(written.mapInArrow(write_rows(path or default_path(), folder, end), MANIFEST), "manifest")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return manifest.withColumn("before", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))).withColumn("folder", F.lit(folder))


def read_shard(manifest: pa.Table, asked: pa.Table) -> pa.Table:
    """The documents of the asked keys from one shard."""
    out = {"id": [], "start": [], "n_tokens": [], "ids": []}
    keys = np.asarray(asked.column("id"), np.int64)
    for row in manifest.to_pylist():
        store, _ = filesystem(row["folder"])
        with store.open_input_file(f"{row['file']}.key") as f:
            index = ShardIndex(f.read())
        which, number = index.find(keys)
        if not len(which):
            continue
        with store.open_input_file(f"{row['file']}.ids") as f:
            raw = np.frombuffer(f.read(), np.uint16 if row["width"] == 2 else np.uint32)
        first, size = index.offsets[number], index.offsets[number + 1] - index.offsets[number]
        nth, step = ranges(size)
        out["id"].append(pa.array(keys[which]))
        out["start"].append(pa.array(first + row["before"]))
        out["n_tokens"].append(pa.array(size))
        out["ids"].append(binary_column(raw[first[nth] + step].astype("<u4"), size))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table({c: pa.chunked_array(v, kind) for (c, v), kind in zip(out.items(), kinds)})


def read_keys(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, unsigned little-endian 32-bit) of the asked doc_ids.

    ``keys`` has a column doc_id; a key asked for twice counts once, an unknown key gives no
    row, a null key the rows without doc_id. Keys go to the shard whose range holds them;
    the list of ranges has one entry for each SHARD_BYTES of text.
    """
    ends = np.array([r[0] for r in manifest.orderBy("shard").select("last").collect()], np.int64)

    @F.pandas_udf("int")
    def nth(ids):
        import pandas as pd

        return pd.Series(np.searchsorted(ends, ids.to_numpy(np.int64)).astype(np.int32))

    asked = keys.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id")).distinct()
    by_order = Window.orderBy("shard")
    numbered = manifest.withColumn("nth", F.row_number().over(by_order) - 1)
    found = numbered.groupBy("nth").cogroup(asked.withColumn("nth", nth("id")).groupBy("nth"))
    rows = found.applyInArrow(read_shard, "id bigint, start bigint, n_tokens bigint, ids binary")
    return rows.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "start", "n_tokens", "ids")
