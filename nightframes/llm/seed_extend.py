"""Substring dedup by seed and extend: words covered by 13 words that an earlier document has too.

Documents are joined on winnowed anchors of a few words (the seeds). In place of an extension
word by word, all windows of 13 words around a seed are hashed to 64 bits and equal hashes
under one seed are grouped; no words are compared. What such windows cover is joined to
maximal repeats where they touch. Only a collision of hashes could change the result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nightframes.llm.buffers import flat, mix, ranges, slices, word_hashes, words
from nightframes.llm.repeats import Kind, lengths, repeated_spans, runs, span_lists, text_spans

LENGTH = 13
ANCHOR = 6


def word_units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, None]:
    starts, ends, first = words(data, bounds)
    return word_hashes(data, starts, ends), first, None


def kind_of(length: int, anchor: int) -> Kind:
    def payload(_, rolling, first, last):
        """The hash of every way to extend the seed to ``length`` words."""
        nth, step = ranges(last - first + 1)
        at = first[nth] + step
        return mix(rolling.of(at, at + length)), last - first + 1

    def least(keys, windows, places, prints, extended, own):
        fragment, _ = ranges(windows)
        answer = own[fragment]
        order = np.argsort(extended)
        first = runs(extended[order])
        small = np.minimum.reduceat(answer[order], first) if len(order) else answer
        answer[order] = np.repeat(small, lengths(first, len(order)))
        return answer

    return Kind(length, anchor, "uint64", word_units, payload, least)


def kept_rows(kind: Kind, buckets: int):
    def kept(batches):
        for part in chain.from_iterable(map(slices, batches)):
            data, bounds = flat(part.column("text"))
            starts, ends, first = words(data, bounds)
            spans, raw, stays = text_spans(kind, buckets, part), data.tobytes(), []
            for pairs, lo, hi in zip(spans, first[:-1].tolist(), first[1:].tolist()):
                cuts = [lo, *(pairs.reshape(-1) + lo).tolist(), hi]
                runs_kept = [raw[starts[a] : ends[b - 1]] for a, b in zip(cuts[::2], cuts[1::2]) if a < b]
                stays.append(b" ".join(w for x in runs_kept for w in x.split()).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(first), pa.int64()), span_lists(spans), pa.array(stays, pa.string())],
                ["doc_id", "n_words", "spans", "kept"],
            )

    return kept


def dedup_passages(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Remove words covered by ``length`` words in a row that also start in a smaller doc_id.

    Words are runs of anything but space and the control characters 9 to 13. Returns doc_id,
    n_words, spans (array of struct start, end: maximal removed runs of words) and kept (the
    remaining words, joined by one space). Windows are judged on the input and never cross
    documents. Null text has no words; texts below ``length`` words are kept whole. Of equal
    texts the one with the smallest doc_id stays whole. A row without doc_id comes after all
    others; rows that share a doc_id do not remove each other's words. An empty table gives
    none; other columns are ignored.
    """
    kind = kind_of(length, anchor)
    told, buckets = repeated_spans(docs, kind)
    return told.mapInArrow(
        kept_rows(kind, buckets),
        "doc_id bigint, n_words bigint, spans array<struct<start: bigint, end: bigint>>, kept string",
    )
