"""Texts of an Arrow batch as flat byte arrays: slices, words, polynomial hashes, minimizers.

Everything works on all texts of a slice at once with numpy; no loop runs per byte or word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text handled at once, at up to 120 bytes of arrays each. One longer text is a
# slice of its own.
SLICE_BYTES = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
# Bits of a position inside a slice when it is packed below a k-gram's rank.
POSITION_BITS = 30


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(lo, hi - lo)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in one array, and where each text starts; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))


class Rolling:
    """Prefix polynomial hashes of a sequence: the hash of any stretch in constant time."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.powers = np.cumprod(np.full(n + 1, MULTIPLIER, np.uint64))
        inverse = np.cumprod(np.full(n, INVERSE, np.uint64))
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values * inverse, out=self.prefix[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the stretches [start, end); equal stretches have equal hashes."""
        return (self.prefix[ends] - self.prefix[starts]) * self.powers[starts]

    def grams(self, k: int) -> np.ndarray:
        """Mixed hashes of all stretches of ``k`` values."""
        n = len(self.prefix) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[k:] - self.prefix[:n]) * self.powers[:n])


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the first word of each text.

    The last array has one entry more than there are texts.
    """
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[bounds] = True
    edges = np.flatnonzero(edge)
    starts, ends = edges[:-1], edges[1:]
    keep = inside[starts] if len(data) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(Rolling(BYTE_VALUES[data]).of(starts, ends) + (ends - starts).astype(np.uint64))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values, in about log2(width) passes."""
    out, span = values, 1
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[:-step], out[step:])
        span += step
    return out


def minimizers(
    grams: np.ndarray, k: int, length: int, bounds: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of ``length`` values that lie within one text.

    A window's anchor is its k-gram of least rank, the leftmost of equal ones, so equal
    windows have equal anchors at equal places. Returns the anchors' positions and the first
    and last window that each is the anchor of.
    """
    none = np.zeros(0, np.int64)
    if len(grams) + k - 1 < length:
        return none, none, none
    low = np.uint64((1 << POSITION_BITS) - 1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_minimum(packed, length - k + 1) & low).astype(np.int64)
    sizes = np.diff(bounds)
    usable = np.maximum(sizes - length + 1, 0)
    text, offset = ranges(usable)
    windows = bounds[text] + offset
    if not len(windows):
        return none, none, none
    anchor = anchor[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(windows)) - 1
    return anchor[first], windows[first], windows[last]


def ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group its number, and a running index within it, as long as ``counts`` sums to."""
    counts = np.asarray(counts, np.int64)
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
