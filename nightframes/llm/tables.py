"""Shared steps of the document operators: identities, sizes, staged tables, packed rows."""

from __future__ import annotations

import ctypes
import os
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframes.session import shared_dir  # noqa: F401

# Rows without doc_id come after all others wherever documents are put in order.
NO_ID = (1 << 63) - 1


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: no lineage, and computed once."""
    path = os.path.join(shared_dir(df.sparkSession), "staged", f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(key, make):
    """What ``make`` gives, made once in a Python worker and kept for its later tasks."""
    store = vars(sys).setdefault("_nightframes_kept", {})
    if key not in store:
        store[key] = make()
    return store[key]


def give_back() -> None:
    """Return memory that was freed, but is held for reuse, to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the C library this is known of
        pass


def trimmed(rows):
    """``rows``, a function for mapInArrow, in tasks that leave no freed memory in their worker.

    A Python worker outlives its task; in a run of several stages the idle ones would hold on
    to the most that any stage before took.
    """

    def run(batches):
        give_back()
        yield from rows(batches)
        give_back()

    return run


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def identified(docs: DataFrame) -> DataFrame:
    """Columns doc_id, id (doc_id, or the largest number for null), mark (of the text), text.

    Other columns go. Rows with equal id are told apart by ``mark``; rows that also have the
    same text are treated alike.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(
        doc_id.alias("doc_id"),
        F.coalesce(doc_id, F.lit(NO_ID)).alias("id"),
        F.xxhash64(text).alias("mark"),
        text.alias("text"),
    )


def parts_for(docs: DataFrame, part_bytes: int, column: str = "text") -> int:
    """Number of parts of about ``part_bytes`` of text, at least one for each shuffle partition."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-total // part_bytes))


def binary_column(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array whose values are ``counts`` consecutive items of ``data``."""
    sizes = np.asarray(counts, np.int64) * data.dtype.itemsize
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    raw = np.ascontiguousarray(data)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]
    ).cast(pa.binary())


def unpacked(column: pa.Array | pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All items of a binary column in one array, and how many each row holds; null is empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    found, sizes = [], []
    for chunk in chunks:
        if not len(chunk):
            continue
        chunk = chunk.fill_null(b"").cast(pa.large_binary())
        offsets = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        if chunk.buffers()[2] is not None:
            found.append(np.frombuffer(chunk.buffers()[2], np.uint8)[offsets[0] : offsets[-1]])
        sizes.append(np.diff(offsets))
    whole = np.concatenate(found) if found else np.zeros(0, np.uint8)
    counts = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return whole.view(dtype) if len(whole) else np.zeros(0, dtype), counts // np.dtype(dtype).itemsize
