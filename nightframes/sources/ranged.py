"""Data source that reads FITS files by byte ranges.

Three tables: ``units`` and ``cards`` read header blocks and skip over data; ``lines`` reads
the scanlines that a query asks for. Planning needs a listing only: a file is cut into byte
ranges as text files are, and a task finds out from the header which scanlines begin in its
range. Filters on path, plane and y are pushed down, so one plane of a cube is one stretch
of the file.

Files are opened through pyarrow, which knows local folders and the common object stores;
nothing of a file passes through the JVM before it is decoded, so files of any size can be
read.
"""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from nightframes.session import ship

ship(__name__)

NAME = "nightframes_fits"
# Block and card size of the format.
BLOCK = 2880
CARD = 80
# Numpy types of the sample types, as stored.
STORED = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
# Bytes of file one task decodes; what opening a file costs, as bytes, when small files are
# put together in a task; blocks of a header that are read at once.
SPLIT_BYTES = 64 << 20
OPEN_BYTES = 256 << 10
HEADER_BLOCKS = 4
# Samples per Arrow batch sent back to the JVM.
BATCH_SAMPLES = 1 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

SCHEMAS = {
    "units": "path string, hdu int, header_at bigint, cards int, data_at bigint, bitpix int, "
    "axes array<bigint>, is_image boolean, is_tiled boolean, complete boolean",
    "cards": "path string, ord int, card string",
    "lines": "path string, plane int, y int, samples array<double>, error string",
}
_UNITS = pa.schema(
    [
        ("path", pa.string()), ("hdu", pa.int32()), ("header_at", pa.int64()), ("cards", pa.int32()),
        ("data_at", pa.int64()), ("bitpix", pa.int32()), ("axes", pa.list_(pa.int64())), ("is_image", pa.bool_()),
        ("is_tiled", pa.bool_()), ("complete", pa.bool_()),
    ]
)
_CARDS = pa.schema([("path", pa.string()), ("ord", pa.int32()), ("card", pa.string())])
_LINES = pa.schema(
    [("path", pa.string()), ("plane", pa.int32()), ("y", pa.int32()), ("samples", pa.list_(pa.float64())), ("error", pa.string())]
)


# --- files --------------------------------------------------------------------------


def store_of(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The store of a path, the path inside it, and what Spark puts in front of such paths."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    if not scheme or scheme[1] == "file":
        local = re.sub(r"^file:(//(?=/))?", "", path)
        return pafs.LocalFileSystem(), local, "file:"
    store, inside = pafs.FileSystem.from_uri(path)
    return store, inside, path[: path.index(inside)] if inside in path else f"{scheme[1]}://"


def listed(paths: list[str]) -> list[tuple[str, int]]:
    """(path, length) of named files, of the files inside named folders, and of name patterns."""
    out = []
    for path in paths:
        store, inside, front = store_of(path)
        inside = inside.rstrip("/")
        folder, _, name = inside.rpartition("/")
        found = [] if set(name) & set("*?[") else [store.get_file_info(inside)]
        if not found:
            inner = store.get_file_info(pafs.FileSelector(folder))
            found = [x for x in inner if fnmatch.fnmatchcase(x.base_name, name)]
        if not found or found[0].type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"PATH_NOT_FOUND: {path}")
        for info in found:
            inner = store.get_file_info(pafs.FileSelector(info.path)) if info.type == pafs.FileType.Directory else [info]
            for one in inner:
                hidden = one is not info and one.base_name[0] in "._"
                if one.type == pafs.FileType.File and not hidden:
                    out.append((front + one.path, one.size))
    return sorted(set(out))


# --- headers ------------------------------------------------------------------------


def read_header(file, at: int, length: int) -> tuple[dict[str, str], list[bytes], int] | None:
    """First value of each keyword, the cards before END, and where data starts; None without END."""
    values: dict[str, str] = {}
    cards: list[bytes] = []
    while at + len(cards) * CARD < length:
        file.seek(at + len(cards) * CARD)
        # cards lie in whole blocks, so a read that stops at a block's end ends a card
        block = file.read(BLOCK * HEADER_BLOCKS)
        for i in range(0, len(block) - CARD + 1, CARD):
            card = block[i : i + CARD]
            name = card[:8].decode("ascii", "replace").rstrip()
            if name == "END":
                used = (len(cards) + 1) * CARD
                return values, cards, at + -(-used // BLOCK) * BLOCK
            if card[8:10] == b"= ":
                text = card[10:].decode("ascii", "replace")
                values.setdefault(name, text.split("/")[0].strip().strip("'").strip())
            cards.append(card)
        if len(block) < BLOCK * HEADER_BLOCKS:
            return None
    return None


def _number(values: dict[str, str], name: str, default: int) -> int:
    return int(values[name]) if re.fullmatch(r"[+-]?\d+", values.get(name, "")) else default


def units_of(file, length: int) -> Iterator[tuple[dict, list[bytes]]]:
    """Every unit of a file with its cards; data is skipped, not read."""
    at, hdu = 0, 0
    while at < length:
        found = read_header(file, at, length)
        if found is None:
            return
        values, cards, data = found
        bitpix = _number(values, "BITPIX", 8)
        axes = [_number(values, f"NAXIS{i + 1}", 0) for i in range(_number(values, "NAXIS", 0))]
        count = 1 if axes else 0
        for n in axes:
            count *= n
        size = abs(bitpix) // 8 * _number(values, "GCOUNT", 1) * (_number(values, "PCOUNT", 0) + count)
        kind = values.get("XTENSION", "")
        unit = {
            "hdu": hdu,
            "header_at": at,
            "cards": len(cards),
            "data_at": data,
            "bitpix": bitpix,
            "axes": axes,
            "is_image": count > 0 and kind in ("", "IMAGE") and bitpix in STORED,
            "is_tiled": values.get("ZIMAGE") == "T",
            "complete": data + abs(bitpix) // 8 * count <= length,
        }
        yield unit, cards
        at, hdu = data + -(-max(size, 0) // BLOCK) * BLOCK, hdu + 1


def first_image(file, length: int) -> tuple[dict, list[bytes]] | None:
    return next((x for x in units_of(file, length) if x[0]["is_image"] or x[0]["is_tiled"]), None)


# --- rows ---------------------------------------------------------------------------


def unit_batches(path: str, file, length: int) -> Iterator[pa.RecordBatch]:
    rows = [{"path": path, **unit} for unit, _ in units_of(file, length)]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_UNITS)


def card_batches(path: str, file, length: int) -> Iterator[pa.RecordBatch]:
    found = first_image(file, length)
    if found and found[1]:
        texts = [c.decode("ascii", "replace").rstrip(" ") for c in found[1]]
        columns = [pa.array([path] * len(texts)), pa.array(np.arange(len(texts), dtype=np.int32)), pa.array(texts)]
        yield pa.RecordBatch.from_arrays(columns, schema=_CARDS)


def wanted_stretches(rows: tuple[int, int], height: int, bounds: dict) -> Iterator[tuple[int, int]]:
    """Stretches of scanline numbers inside ``rows`` whose plane and y lie within ``bounds``."""
    first, stop = rows
    least, most = bounds.get("y", (0, height - 1))
    least, most = max(0, least), min(height - 1, most)
    low, high = bounds.get("plane", (0, stop // height if height else 0))
    if (least, most) == (0, height - 1):
        start, end = max(first, low * height), min(stop, (high + 1) * height)
        if start < end:
            yield start, end
        return
    for plane in range(max(low, first // height), min(high, (stop - 1) // height) + 1):
        start, end = max(first, plane * height + least), min(stop, plane * height + most + 1)
        if start < end:
            yield start, end


def line_batches(path: str, file, length: int, start: int, stop: int, bounds: dict) -> Iterator[pa.RecordBatch]:
    """Scanlines that begin in the bytes [start, stop) of a file; its error, if any, with the first bytes."""
    found = first_image(file, length)
    error = None
    if found is None:
        error = f"no image data found in {path}"
    elif not found[0]["is_image"]:
        error = "tile-compressed images are not supported"
    elif not found[0]["complete"]:
        error = "file ends before its image data"
    if error:
        if start == 0:
            yield pa.RecordBatch.from_pylist([{"path": path, "error": error}], schema=_LINES)
        return
    unit = found[0]
    width = unit["axes"][0]
    height = unit["axes"][1] if len(unit["axes"]) > 1 else 1
    total = 1
    for n in unit["axes"][1:]:
        total *= n
    stored = np.dtype(STORED[unit["bitpix"]])
    size = width * stored.itemsize
    rows = tuple(min(total, max(0, -(-(at - unit["data_at"]) // size))) for at in (start, stop))
    step = max(1, BATCH_SAMPLES // width)
    for begin, end in wanted_stretches(rows, height, bounds):
        for first in range(begin, end, step):
            n = min(step, end - first)
            file.seek(unit["data_at"] + first * size)
            block = np.frombuffer(file.read(n * size), stored).astype(np.float64)
            row = np.arange(first, first + n)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([path] * n),
                    pa.array((row // height).astype(np.int32)),
                    pa.array((row % height).astype(np.int32)),
                    pa.ListArray.from_arrays(offsets, pa.array(block)),
                    pa.nulls(n, pa.string()),
                ],
                schema=_LINES,
            )


# --- the source ---------------------------------------------------------------------


def packed(pieces: list[tuple[str, int, int, int]], costs: list[int], most: int) -> list[list[tuple]]:
    """Pieces in order, put together up to ``most`` bytes."""
    out: list[list[tuple]] = []
    room = 0
    for piece, cost in zip(pieces, costs):
        if cost > room or not out:
            out.append([])
            room = most
        out[-1].append(piece)
        room -= cost
    return out


class FitsReader(DataSourceReader):
    """``names``: the paths asked for, or None; ``bounds``: least and greatest plane and y asked for."""

    def __init__(self, table: str, paths: list[str], split_bytes: int):
        self.table, self.paths, self.split_bytes = table, paths, split_bytes
        self.names: set[str] | None = None
        self.bounds: dict[str, tuple[int, int]] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "path" and isinstance(f, (EqualTo, In)):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = named if self.names is None else self.names & named
            elif column in ("plane", "y") and self.table == "lines" and self._narrow(column, f):
                pass
            else:
                yield f

    def _narrow(self, column: str, f: Filter) -> bool:
        """Take a comparison of plane or y into the bounds; whether it is wholly taken."""
        low, high = self.bounds.get(column, (0, 1 << 62))
        if isinstance(f, EqualTo):
            low, high = max(low, f.value), min(high, f.value)
        elif isinstance(f, GreaterThan):
            low = max(low, f.value + 1)
        elif isinstance(f, GreaterThanOrEqual):
            low = max(low, f.value)
        elif isinstance(f, LessThan):
            high = min(high, f.value - 1)
        elif isinstance(f, LessThanOrEqual):
            high = min(high, f.value)
        else:
            return False
        self.bounds[column] = (low, high)
        return True

    def partitions(self) -> list[InputPartition]:
        files = [(p, n) for p, n in listed(self.paths) if self.names is None or p in self.names]
        if self.table == "lines":
            size = self.split_bytes
            # a range that begins beyond the first one holds no error row
            pieces = [(p, n, at, min(n, at + size)) for p, n in files for at in range(0, max(n, 1), size)]
            costs = [OPEN_BYTES + stop - at for _, _, at, stop in pieces]
        else:
            pieces = [(p, n, 0, n) for p, n in files]
            costs = [OPEN_BYTES] * len(pieces)
        return [InputPartition(x) for x in packed(pieces, costs, self.split_bytes)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path, length, start, stop in partition.value or ():
            store, inside, _ = store_of(path)
            with store.open_input_file(inside) as file:
                if self.table == "units":
                    yield from unit_batches(path, file, length)
                elif self.table == "cards":
                    yield from card_batches(path, file, length)
                else:
                    for batch in line_batches(path, file, length, start, stop, self.bounds):
                        # a line without plane (an error) answers no filter on plane or y
                        if not (self.bounds and batch.column("plane").null_count):
                            yield batch


class FitsSource(DataSource):
    """``spark.read.format(NAME)``; options: table (units, cards or lines), paths (JSON list), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "lines")]

    def reader(self, schema) -> FitsReader:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return FitsReader(self.options.get("table", "lines"), paths, int(self.options.get("splitBytes", SPLIT_BYTES)))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed down to it."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(FitsSource)


def read_source(spark: SparkSession, table: str, paths: list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    register(spark)
    reader = spark.read.format(NAME).option("table", table).option("splitBytes", split_bytes)
    return reader.option("paths", json.dumps(paths)).load()
