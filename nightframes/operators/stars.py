"""Star detection: threshold, 8-connected components, acceptance, shape, frame medians.

The unit of work is a run: a stretch of neighbouring pixels above the threshold in one
scanline. Runs are few next to pixels, carry their own sums, and are joined into
components in two steps: inside bands of scanlines (bounded groups), then across bands
by contracting the graph of the band components that touch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightframes.functions import scalars as S
from nightframes.operators import planes as P
from nightframes.operators.stats import (
    frame_medians,
    in_order,
    is_finite,
    median_and_mad,
    order_statistics,
)
from nightframes.session import attach, matched, ship, staged

ship(__name__)

# Detection threshold in MADs, area bounds in pixels, FWHM per sigma.
SIGMA_K = 5.0
MIN_PIXELS = 5
MAX_PIXELS = 2000
FWHM_PER_SIGMA = 2.3548

# Scanlines per band. A band's runs are one group of the local labelling.
BAND_ROWS = 128
# A run: its pixels in the scanline, their sums above the background, and the frame's numbers.
RUNS = (
    "frame_id {frame_id}, y int, x0 int, x1 int, n bigint, peak double, flux double, fx double, background double,"
    " width int, height int, saturation double, values array<double>"
)
# Slices of y a component's runs are spread over when joined with its accepted label.
SPREAD = 32


# --- background ---------------------------------------------------------------------


def plane_background(plane_rows: DataFrame) -> DataFrame:
    """``median, mad`` of every detection plane.

    A plane whose source has a ceiling has a bounded number of values and is counted;
    others are sorted by range.
    """
    bounded = F.col("bounded")

    def pixels(rows: DataFrame) -> DataFrame:
        found = rows.select("frame_id", "y", F.posexplode("values").alias("x", "v"))
        return found.filter(is_finite(F.col("v")))

    counts = pixels(plane_rows.filter(bounded)).groupBy("frame_id", "v")
    counted = median_and_mad(counts.agg(F.count(F.lit(1)).alias("n")))
    free_rows = plane_rows.filter(~bounded)
    if free_rows.isEmpty():
        return counted
    return counted.unionByName(order_statistics(in_order(pixels(free_rows)))[1])


# --- runs ---------------------------------------------------------------------------


def runs_above(plane_rows: DataFrame, background: DataFrame, sigma_k: float = SIGMA_K) -> DataFrame:
    """Runs of pixels strictly above median + k * MAD, one row each.

    Columns: frame_id, y, x0, x1, n, peak, flux, fx (flux * x summed), background,
    values, width, height, saturation. ``background`` must be a staged table.
    """
    rows = attach(plane_rows, background.select("frame_id", "median", "mad"), ["frame_id"], F.col("y"))
    threshold = F.col("median") + sigma_k * F.col("mad")
    lines = rows.select(
        "frame_id", "y", "width", "height", "saturation", F.col("median").alias("background"), threshold.alias("threshold"), "values"
    )
    key = lines.schema["frame_id"].dataType.simpleString()
    return lines.mapInArrow(_line_runs, RUNS.format(frame_id=key))


def _line_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of all scanlines of a batch at once; a scanline is a row, so nothing is shuffled."""
    for batch in batches:
        lines = batch.column("values").fill_null([])
        size = np.asarray(lines.value_lengths(), np.int64)
        v = np.asarray(lines.flatten().fill_null(np.nan), np.float64)
        row = np.repeat(np.arange(len(size)), size)
        x = np.arange(len(v)) - np.repeat(np.cumsum(size) - size, size)
        level, base = (np.asarray(batch.column(c).fill_null(np.nan), np.float64) for c in ("threshold", "background"))
        at = np.flatnonzero(v > level[row])
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
        first = np.flatnonzero(new)
        if not len(first):
            continue
        many = np.diff(np.append(first, len(at)))
        flux = v[at] - base[row[at]]
        begin = at[first]
        taken = batch.take(pa.array(row[begin]))
        offsets = pa.array(np.append(0, np.cumsum(many)).astype(np.int32))
        columns = {
            "x0": x[begin].astype(np.int32),
            "x1": (x[begin] + many - 1).astype(np.int32),
            "n": many,
            "peak": np.maximum.reduceat(v[at], first),
            "flux": np.add.reduceat(flux, first),
            "fx": np.add.reduceat(flux * x[at], first),
        }
        yield pa.RecordBatch.from_arrays(
            [
                taken.column("frame_id"),
                taken.column("y"),
                *map(pa.array, columns.values()),
                *(taken.column(c) for c in ("background", "width", "height", "saturation")),
                pa.ListArray.from_arrays(offsets, pa.array(v[at])),
            ],
            ["frame_id", "y", *columns, "background", "width", "height", "saturation", "values"],
        )


def run_id(y: Column, x0: Column) -> Column:
    """A number that identifies a run inside its frame and orders runs by position."""
    return F.shiftleft(y.cast("bigint"), 31) + x0


# --- components ---------------------------------------------------------------------


def _touching(line: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of runs in consecutive lines that touch, also diagonally.

    Runs are sorted by (line, x0), so the partners of a run are one slice of the next line.
    """
    stride = int(x1.max()) + 3
    starts, ends = line * stride + x0, line * stride + x1
    first = np.searchsorted(ends, (line + 1) * stride + x0 - 1, side="left")
    last = np.searchsorted(starts, (line + 1) * stride + x1 + 1, side="right")
    size = np.maximum(last - first, 0)
    upper = np.repeat(np.arange(len(line)), size)
    offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return upper, np.repeat(first, size) + offset


def _smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label every node with the smallest node index of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _band_starts(rows: pa.Table) -> np.ndarray:
    """Whether a row is the first of its (frame, band)."""
    same = np.ones(len(rows) - 1, dtype=bool)
    for name in ("frame_id", "band"):
        column = rows[name].combine_chunks()
        same &= pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.concatenate(([True], ~same))


def _label_rows(rows: pa.Table) -> pa.Table:
    """Add ``part``, the smallest run of the component, for whole bands of sorted runs."""
    y, x0, x1, run = (rows[c].to_numpy().astype(np.int64) for c in ("y", "x0", "x1", "run"))
    # Number the lines so that they follow each other inside a band only.
    band = np.cumsum(_band_starts(rows))
    line = y - y.min() + band * (y.max() - y.min() + 2)
    label = _smallest_labels(len(run), *_touching(line, x0, x1))
    return rows.drop_columns(["band"]).append_column("part", pa.array(run[label]))


def _label_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label bands as they arrive; the last band of a batch waits for its remaining runs."""
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        cut = int(np.flatnonzero(_band_starts(rows))[-1])
        if cut:
            yield from _label_rows(rows.slice(0, cut)).to_batches()
        held = rows.slice(cut)
    if held is not None:
        yield from _label_rows(held).to_batches()


def label_runs(runs: DataFrame, band_rows: int = BAND_ROWS) -> DataFrame:
    """``frame_id, run, label`` for runs ``frame_id, y, x0, x1``.

    The label is the component's smallest run id. Bands are shuffled and sorted by Spark and
    labelled in Arrow batches, many bands at a time.
    """
    slim = runs.select(
        "frame_id",
        F.floor(F.col("y") / band_rows).alias("band"),
        F.col("y").cast("int").alias("y"),
        F.col("x0").cast("int").alias("x0"),
        F.col("x1").cast("int").alias("x1"),
        run_id(F.col("y"), F.col("x0")).alias("run"),
    )
    schema = f"frame_id {dict(runs.dtypes)['frame_id']}, y int, x0 int, x1 int, run bigint, part bigint"
    parts = staged(
        slim.repartition("frame_id", "band")
        .sortWithinPartitions("frame_id", "band", "y", "x0")
        .mapInArrow(_label_bands, schema),
        "parts",
    )
    merged = _merge_parts(parts, band_rows)
    if merged is None:
        return parts.select("frame_id", "run", F.col("part").alias("label"))
    return matched(parts, merged, ["frame_id", "part"], "left").select(
        "frame_id", "run", F.coalesce("label", "part").alias("label")
    )


def _merge_parts(parts: DataFrame, band_rows: int) -> DataFrame | None:
    """Final labels of band components that touch another band's, or None if none does.

    Components are contracted: in each round nodes move together and the edges inside go, so
    edges shrink by a share every time and a long snake ends in rounds as the logarithm of its
    length. Runs on both sides of a band edge meet on 64-pixel cells of x, at most 33 runs each,
    so a busy scanline never compares all its runs with all of the next one.
    """
    y, x0, x1 = F.col("y"), F.col("x0"), F.col("x1")

    def cells(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor(lo / 64), F.floor(hi / 64)))

    last = parts.filter(y % band_rows == band_rows - 1).select(
        "frame_id",
        (y + 1).alias("edge"),
        cells(x0 - 1, x1 + 1).alias("cell"),
        (x0 - 1).alias("lo"),
        (x1 + 1).alias("hi"),
        F.col("part").alias("a"),
    )
    first = parts.filter((y % band_rows == 0) & (y > 0)).select(
        "frame_id", y.alias("edge"), cells(x0, x1).alias("cell"), x0, x1, F.col("part").alias("b")
    )
    edges = staged(
        matched(last, first, ["frame_id", "edge", "cell"])
        .filter((x0 <= F.col("hi")) & (x1 >= F.col("lo")))
        .select("frame_id", "a", "b")
        .distinct(),
        "edges",
    )
    if edges.isEmpty():
        return None
    steps = []
    while not edges.isEmpty():
        moved = staged(_hooked(edges, len(steps)), "moved")
        steps.append(moved)
        ends = {c: moved.select("frame_id", F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b")}
        edges = staged(
            matched(matched(edges, ends["a"], ["frame_id", "a"]), ends["b"], ["frame_id", "b"])
            .filter(F.col("a_to") != F.col("b_to"))
            .select("frame_id", F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
            .distinct(),
            "edges",
        )
    # from the last round, with the fewest nodes, back to the first
    found = steps.pop()
    while steps:
        later = found.select("frame_id", F.col("node").alias("to"), F.col("to").alias("last"))
        found = matched(steps.pop(), later, ["frame_id", "to"], "left")
        found = staged(found.select("frame_id", "node", F.coalesce("last", "to").alias("to")), "found")
    least = found.groupBy("frame_id", "to").agg(F.min("node").alias("label"))
    return matched(found, least, ["frame_id", "to"]).select("frame_id", F.col("node").alias("part"), "label")


def _hooked(edges: DataFrame, turn: int) -> DataFrame:
    """``frame_id, node, to``: every node moves to the first of itself and its neighbours, and on to that one's first.

    Which node is first is drawn anew each turn, so that a chain of any numbering loses more
    than half its nodes, and edges inside what moves together are dropped with them.
    """
    both = edges.unionByName(edges.select("frame_id", F.col("b").alias("a"), F.col("a").alias("b")))

    def drawn(c: str) -> Column:
        return F.struct(F.xxhash64(F.lit(turn), c).alias("draw"), F.col(c).alias("node"))

    first = both.groupBy("frame_id", "a").agg(F.min(drawn("b")).alias("near"))
    hooks = first.select("frame_id", F.col("a").alias("node"), F.least(drawn("a"), "near")["node"].alias("to"))
    onward = hooks.select("frame_id", F.col("node").alias("to"), F.col("to").alias("far"))
    return matched(hooks, onward, ["frame_id", "to"]).select("frame_id", "node", F.col("far").alias("to"))


# --- stars --------------------------------------------------------------------------


def accepted_components(
    labelled: DataFrame, min_pixels: int = MIN_PIXELS, max_pixels: int = MAX_PIXELS
) -> DataFrame:
    """Components within the area bounds, off the border and nowhere saturated.

    Columns: frame_id, label, area, flux, cx, cy (flux-weighted centre).
    """
    y = F.col("y")
    total = labelled.groupBy("frame_id", "label").agg(
        F.sum("n").alias("area"),
        F.min("x0").alias("x_min"),
        F.max("x1").alias("x_max"),
        F.min("y").alias("y_min"),
        F.max("y").alias("y_max"),
        F.max("peak").alias("peak"),
        F.sum("flux").alias("flux"),
        F.sum("fx").alias("fx"),
        F.sum(F.col("flux") * y).alias("fy"),
        F.first("width").alias("width"),
        F.first("height").alias("height"),
        F.first("saturation").alias("saturation"),
    )
    return total.filter(
        F.col("area").between(min_pixels, max_pixels)
        & (F.col("x_min") > 0)
        & (F.col("y_min") > 0)
        & (F.col("x_max") + 1 < F.col("width"))
        & (F.col("y_max") + 1 < F.col("height"))
        & (F.col("peak") < F.col("saturation"))
        & (F.col("flux") > 0)
    ).select(
        "frame_id",
        "label",
        "area",
        "flux",
        (F.col("fx") / F.col("flux")).alias("cx"),
        (F.col("fy") / F.col("flux")).alias("cy"),
    )


def eccentricity(mxx: Column, myy: Column, mxy: Column) -> Column:
    """0 for a round star, towards 1 for a streak, from the second moments."""
    mean = (mxx + myy) / 2
    half = (mxx - myy) / 2
    spread = F.sqrt(half * half + mxy * mxy)
    ratio = S.clamp((mean - spread) / F.nullif(mean + spread, F.lit(0.0)), 0.0, 1.0)
    return F.when(mean + spread <= 0, 0.0).otherwise(F.sqrt(1.0 - ratio))


def measure(labelled: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row per star: frame_id, label, x, y, area, flux, hfr, fwhm, eccentricity.

    The second pass over pixels sees accepted components only. A rejected component may
    be huge (a nebula), so its runs are spread over slices of y for the join.
    """
    slot = F.pmod(F.col("y").cast("bigint"), F.lit(SPREAD))
    slots = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint")))
    found = labelled.select("frame_id", "label", "y", "x0", "background", "values", slot.alias("slot"))
    found = matched(found, accepted.withColumn("slot", slots), ["frame_id", "label", "slot"])
    pixels = found.select("*", F.posexplode("values").alias("i", "v"))
    f = F.col("v") - F.col("background")
    dx = F.col("x0") + F.col("i") - F.col("cx")
    dy = F.col("y") - F.col("cy")
    moments = pixels.groupBy("frame_id", "label").agg(
        F.first("cx").alias("x"),
        F.first("cy").alias("y"),
        F.first("area").alias("area"),
        F.first("flux").alias("flux"),
        F.sum(f * F.sqrt(dx * dx + dy * dy)).alias("fr"),
        F.sum(f * dx * dx).alias("fxx"),
        F.sum(f * dy * dy).alias("fyy"),
        F.sum(f * dx * dy).alias("fxy"),
    )
    mxx, myy, mxy = (F.col(c) / F.col("flux") for c in ("fxx", "fyy", "fxy"))
    return moments.select(
        "frame_id",
        "label",
        "x",
        "y",
        "area",
        "flux",
        (F.col("fr") / F.col("flux")).alias("hfr"),
        (FWHM_PER_SIGMA * F.sqrt(F.greatest((mxx + myy) / 2, F.lit(0.0)))).alias("fwhm"),
        eccentricity(mxx, myy, mxy).alias("eccentricity"),
    )


def find_stars(
    plane_rows: DataFrame,
    background: DataFrame | None = None,
    sigma_k: float = SIGMA_K,
    min_pixels: int = MIN_PIXELS,
    max_pixels: int = MAX_PIXELS,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """All stars on the given detection planes."""
    if background is None:
        background = staged(plane_background(plane_rows), "background")
    runs = staged(runs_above(plane_rows, background, sigma_k), "runs")
    labels = label_runs(runs, band_rows)
    numbered = runs.withColumn("run", run_id(F.col("y"), F.col("x0")))
    labelled = staged(matched(numbered, labels, ["frame_id", "run"]), "labelled")
    return measure(labelled, accepted_components(labelled, min_pixels, max_pixels))


def star_stats(stars: DataFrame, frames: DataFrame) -> DataFrame:
    """Star count and median shape per frame; count 0 and NULL shapes without a star."""
    stars = staged(stars.select("frame_id", "hfr", "fwhm", "eccentricity"), "stars")
    names = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in ("hfr", "fwhm", "eccentricity")])
    long = stars.select("frame_id", F.explode(names).alias("m")).select("frame_id", "m.name", "m.v").filter("v is not null")
    medians = frame_medians(long, ["frame_id", "name"])
    middle = medians.groupBy("frame_id").agg(
        *[F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in ("hfr", "fwhm", "eccentricity")]
    )
    counts = stars.groupBy("frame_id").agg(F.count(F.lit(1)).alias("star_count"))
    shapes = matched(counts, middle, ["frame_id"], "left")
    return matched(frames.select("frame_id"), shapes, ["frame_id"], "left").withColumn(
        "star_count", F.coalesce("star_count", F.lit(0).cast("bigint"))
    )


def detect_stars(
    scanlines: DataFrame, frames: DataFrame, sigma_k: float = SIGMA_K, background: DataFrame | None = None
) -> DataFrame:
    """Star statistics and plane size of every frame a detection plane exists for.

    ``background`` (frame_id, median, mad), if it is known already, saves a pass over the planes.
    """
    rows = P.detection_rows(scanlines)
    stars = find_stars(rows, background, sigma_k=sigma_k)
    described = P.with_shape(frames)
    mosaic = F.col("shape") == "mosaic"
    usable = described.filter(
        F.col("shape").isin("mono", "rgb_cube")
        | (mosaic & S.cfa_pattern(F.col("bayerpat")).isNotNull())
    )

    def side(c: str) -> Column:
        return F.when(mosaic, F.floor(F.col(c) / 2).cast("int")).otherwise(F.col(c))

    sizes = usable.select(
        "frame_id", side("width").alias("plane_width"), side("height").alias("plane_height")
    )
    return matched(star_stats(stars, sizes), sizes, ["frame_id"])


def plane_note(
    plane_width: Column, plane_height: Column, width: Column, height: Column, channels: Column
) -> Column:
    """Says which plane the stars were measured on when it is not the frame itself."""
    halved = F.format_string(
        "measured on the green super-pixel plane, %d x %d", plane_width, plane_height
    )
    return F.when((plane_width != width) | (plane_height != height), halved).when(
        channels == 3, "measured on the green channel of the RGB cube"
    )
