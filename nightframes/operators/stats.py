"""Per-frame pixel statistics.

Input rows are samples: ``frame_id, raw`` plus the frame's descriptor columns
``sample_type, bscale, bzero`` and, for the dispatcher, ``plane, axes, planes, bayerpat``. The
descriptor travels with the samples (it compresses to nothing in Parquet), so no
pixel-sized join is needed to scale or route them.

8- and 16-bit samples are first reduced to value counts, at most 65 536 rows per frame
whatever its size; everything else is derived from those. Float and wide-integer samples
take the general path: they are sorted once by range, over all frames, and median and MAD
are found by rank in that table; everything else is an aggregate that combines on the map
side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightframes.functions import scalars as S
from nightframes.session import BROADCAST_ROWS, attach, dealt, gathered, matched, staged

HISTOGRAM_BINS = 256
MAD_TO_SIGMA = 1.4826
# Neighbouring samples in order that make a block, as a power of two. A task sees a row per
# block of its frames, and the samples of the few blocks that hold a central deviation.
BLOCK_BITS = 12
COUNTED_TYPES = ("U8", "I16")

STAT_COLUMNS = (
    "min max mean median zeros min_count max_count count sigma mad mode saturated saturation "
    "histogram nonfinite"
).split()


# --- value counts -------------------------------------------------------------------


def value_counts(samples: DataFrame, keys: list[str] = ["frame_id"]) -> DataFrame:
    """Occurrences ``n`` of every raw value per frame, with its physical value ``v``.

    Counting combines on the map side, so even a frame that holds most of the data
    shuffles at most 65 536 rows per task. Where all frames are small that saves little, and
    they are dealt out whole first. Scaling is applied to the counts only.
    """
    total, most = _sizes(samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")))
    counts = gathered(samples, keys, total, most).groupBy(*keys, "raw").agg(
        F.count(F.lit(1)).alias("n"),
        F.first("bscale").alias("bscale"),
        F.first("bzero").alias("bzero"),
        F.first(
            S.sample_saturation(F.col("sample_type"), F.col("bscale"), F.col("bzero"))
        ).alias("saturation"),
    )
    return counts.select(
        *keys,
        S.physical(F.col("raw").cast("double"), F.col("bscale"), F.col("bzero")).alias("v"),
        "n",
        "saturation",
    )


def _sizes(per_frame: DataFrame) -> tuple[int, int]:
    """Samples of all frames and of the largest, from the ``total`` of each."""
    found = per_frame.agg(F.sum("total"), F.max("total")).first()
    return found[0] or 0, found[1] or 0


def value_at_rank(counts: DataFrame, rank: Column, name: str, keys: list[str] = ["frame_id"]) -> DataFrame:
    """The value holding 0-based ``rank`` in each frame's sorted samples.

    ``rank`` may use ``total``, the number of samples of the frame.
    """
    w = Window.partitionBy(*keys)
    running = counts.withColumn("cum", F.sum("n").over(_running(w, "v"))).withColumn(
        "total", F.sum("n").over(w)
    )
    return (
        running.filter((F.col("cum") - F.col("n") <= rank) & (rank < F.col("cum")))
        .groupBy(*keys)
        .agg(F.min("v").alias(name))
    )


def _running(w, *order):
    return w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _mid_ranks(total: Column) -> tuple[Column, Column]:
    """0-based ranks of the two central samples (the same one twice for an odd number)."""
    return F.floor((total - 1) / 2), F.floor(total / 2)


def _with_deviations(counts: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Add the frame's ``total, lo, hi, mean, top_n, median`` and each value's ``dev, cum_dev``.

    One shuffle by frame, into groups bounded by the sample type's number of values; two
    sorts inside it, by value and by deviation. Columns not used later are pruned. Tasks
    follow the number of counts; without ``rows`` they are staged for that.
    """
    if rows is None:
        counts = staged(counts, "counts")
        rows = counts.count()
    counts = dealt(counts, keys, rows)
    w = Window.partitionBy(*keys)
    by_value = w.orderBy("v")
    whole = by_value.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v, n = F.col("v"), F.col("n")
    low, high = _mid_ranks(F.col("total"))

    def holder(rank: Column) -> Column:
        return F.max(F.when(F.col("cum") - n <= rank, v)).over(whole)

    return (
        counts.withColumns(
            {
                "cum": F.sum("n").over(_running(w, "v")),
                "total": F.sum("n").over(whole),
                "lo": F.min("v").over(whole),
                "hi": F.max("v").over(whole),
                "mean": F.sum(v * n).over(whole) / F.sum("n").over(whole),
                "top_n": F.max("n").over(whole),
            }
        )
        .withColumn("median", (holder(low) + holder(high)) / 2)
        .withColumn("dev", F.abs(v - F.col("median")))
        .withColumn("cum_dev", F.sum("n").over(_running(w, "dev", "v")))
    )


def _deviation_at(rank: Column) -> Column:
    """Aggregate: the deviation holding ``rank`` in the sorted deviations."""
    return F.max(F.when(F.col("cum_dev") - F.col("n") <= rank, F.col("dev")))


def median_and_mad(counts: DataFrame, keys: list[str] = ["frame_id"], rows: int | None = None) -> DataFrame:
    """``median, mad`` per key from counts of values, which may repeat; ``rows`` is their number, if known."""
    low, high = _mid_ranks(F.col("total"))
    return (
        _with_deviations(counts, keys, rows)
        .groupBy(*keys)
        .agg(
            F.first("median").alias("median"),
            (MAD_TO_SIGMA * ((_deviation_at(low) + _deviation_at(high)) / 2)).alias("mad"),
        )
    )


# --- histogram ----------------------------------------------------------------------


def bin_index(v: Column, lo: Column, hi: Column, bins: int = HISTOGRAM_BINS) -> Column:
    """Bin of ``v`` among equal bins over [lo, hi]; the top value falls in the last bin."""
    scaled = (v - lo) * (F.lit(float(bins)) / F.nullif(hi - lo, F.lit(0.0)))
    return F.when(hi > lo, F.least(scaled.cast("int"), F.lit(bins - 1))).otherwise(0)


def dense(pairs: Column, bins: int = HISTOGRAM_BINS) -> Column:
    """Array of ``bins`` counts from an array of (bin, count) structs without repeats."""
    return S.bound(
        F.map_from_entries(pairs),
        lambda by_bin: F.transform(
            F.sequence(F.lit(0), F.lit(bins - 1)),
            lambda i: F.coalesce(F.try_element_at(by_bin, i), F.lit(0).cast("bigint")),
        ),
    )


def histogram_heights(histogram: Column) -> Column:
    """Bar heights in 0..1 on a logarithmic scale; all zero for an empty frame."""
    return S.bound(
        F.ln((F.array_max(histogram) + 1).cast("double")),
        lambda top: F.transform(
            histogram, lambda c: F.when(top > 0, F.ln((c + 1).cast("double")) / top).otherwise(0.0)
        ),
    )


def histogram_levels(histogram: Column, width: int, rows: int = 10, log: bool = False) -> Column:
    """Resample to ``width`` columns with heights in quarter steps of ``rows`` rows.

    A non-empty column is at least one step high.
    """
    n = F.size(histogram)

    def column_sum(j: Column) -> Column:
        start = F.floor(j * n / width).cast("int")
        end = F.least(F.greatest(F.floor((j + 1) * n / width).cast("int"), start + 1), n)
        return F.aggregate(
            F.slice(histogram, start + 1, end - start), F.lit(0).cast("bigint"), lambda a, c: a + c
        )

    columns = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), column_sum)

    def weight(c: Column) -> Column:
        return F.ln((c + 1).cast("double")) if log else c.cast("double")

    def level(c: Column, top: Column) -> Column:
        steps = F.greatest(S.half_away(weight(c) / top * (rows * 4)), F.lit(1.0))
        return F.when(c > 0, steps).otherwise(0.0).cast("int")

    return S.bound(
        columns,
        lambda cols: S.bound(
            weight(F.array_max(cols)), lambda top: F.transform(cols, lambda c: level(c, top))
        ),
    )


# --- statistics from counts ---------------------------------------------------------


def stats_from_counts(counts: DataFrame, keys: list[str] = ["frame_id"], rows: int | None = None) -> DataFrame:
    """All statistics fields per frame from ``keys, v, n, saturation``; ``rows`` is their number, if known."""
    v, n, mean = F.col("v"), F.col("n"), F.col("mean")
    low, high = _mid_ranks(F.col("total"))
    placed = _with_deviations(counts, keys, rows)
    # Two levels of grouping inside the same partitioning: bins, then frames.
    per_bin = placed.groupBy(*keys, bin_index(v, F.col("lo"), F.col("hi")).alias("bin")).agg(
        F.sum("n").alias("bin_n"),
        F.sum(F.when(v == F.col("lo"), n).otherwise(0)).alias("min_count"),
        F.sum(F.when(v == F.col("hi"), n).otherwise(0)).alias("max_count"),
        F.sum(F.when(v == 0, n).otherwise(0)).alias("zeros"),
        F.sum(F.when(v == F.col("saturation"), n).otherwise(0)).alias("saturated"),
        F.sum(n * (v - mean) * (v - mean)).alias("sq"),
        F.min(F.when(n == F.col("top_n"), v)).alias("mode"),
        _deviation_at(low).alias("dev_low"),
        _deviation_at(high).alias("dev_high"),
        *[F.first(c).alias(c) for c in ("lo", "hi", "mean", "median", "total", "saturation")],
    )
    return (
        per_bin.groupBy(*keys)
        .agg(
            F.first("lo").alias("min"),
            F.first("hi").alias("max"),
            F.first("mean").alias("mean"),
            F.first("median").alias("median"),
            F.sum("zeros").alias("zeros"),
            F.sum("min_count").alias("min_count"),
            F.sum("max_count").alias("max_count"),
            F.first("total").alias("count"),
            F.sqrt(F.sum("sq") / F.first("total")).alias("sigma"),
            (MAD_TO_SIGMA * ((F.max("dev_low") + F.max("dev_high")) / 2)).alias("mad"),
            F.min("mode").alias("mode"),
            F.sum("saturated").alias("saturated"),
            F.first("saturation").alias("saturation"),
            dense(F.collect_list(F.struct("bin", "bin_n"))).alias("histogram"),
        )
        .withColumn("nonfinite", F.lit(0).cast("bigint"))
    )


def integer_stats(samples: DataFrame) -> DataFrame:
    """Statistics of 8- and 16-bit frames."""
    return stats_from_counts(value_counts(samples))


# --- general path -------------------------------------------------------------------


def is_finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def position(rows: DataFrame, value: str) -> Column:
    """What a frame's rows are spread by: their place, or the value where there is none."""
    place = [c for c in ("plane", "y", "x") if c in rows.columns]
    return F.xxhash64(*(place or [value]))


def in_order(values: DataFrame, keys: list[str] = ["frame_id"], value: str = "v") -> DataFrame:
    """``values`` in one sort by range, staged: keys, ``v, _part, _at``.

    Ranges are of (key, value, place), so a frame holding a large part of all samples, even
    of one value, is spread over many tasks. ``_at`` rises with the value inside a part.
    """
    at = F.col("_at") if "_at" in values.columns else position(values, value)
    rows = values.select(*keys, F.col(value).alias("v"), at.alias("_tie"))
    dealt = rows.repartitionByRange(*keys, "v", "_tie").sortWithinPartitions(*keys, "v")
    return staged(
        dealt.select(
            *keys, "v", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")
        ),
        "ordered",
    )


def blocks_of(ordered: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of neighbouring rows of one key, staged: where they begin, their ends and moments.

    NaN and infinite values lie at both ends of a key's rows; they are only counted.
    """
    v = F.col("v")
    usable = F.when(is_finite(v), v)
    # ``_at`` numbers the rows of a part without gaps, so its quotient is a block of a part
    block = F.shiftright("_at", BLOCK_BITS).alias("block")
    return staged(
        ordered.groupBy(*keys, block).agg(
            F.count(usable).alias("n"),
            F.min(F.when(is_finite(v), F.col("_at"))).alias("first"),
            F.min(usable).alias("lo"),
            F.max(usable).alias("hi"),
            F.avg(usable).alias("mean"),
            F.var_pop(usable).alias("spread"),
            F.count_if(v == 0).alias("zeros"),
            F.count_if(~is_finite(v)).alias("nonfinite"),
        ),
        "blocks",
    )


def order_statistics(ordered: DataFrame, keys: list[str] = ["frame_id"]) -> tuple[DataFrame, DataFrame]:
    """Moments (staged; ``total, lo, hi, mean, sigma, zeros, nonfinite``) and ``median, mad`` per key.

    ``ordered`` are rows put ``in_order``; all but ``nonfinite`` are of finite values. A fixed number of passes for every size: from the blocks' counts follow the places of the
    two central values, and from the blocks' ends and the median two bounds between which the
    central deviations lie. Deviations below are counted; those between, of a few blocks, are
    put in order.
    """
    blocks = blocks_of(ordered, keys)
    rows = blocks.count()
    by_frame = dealt(blocks, keys, rows)
    v, n, total = F.col("v"), F.col("n"), F.col("total")
    low, high = _mid_ranks(total)
    # a row per block from here on
    w = Window.partitionBy(*keys)
    placed = (
        by_frame.withColumn("cum", F.sum("n").over(_running(w, "block")))
        .withColumn("total", F.sum("n").over(w))
        .withColumn("centre", F.sum(n * F.col("mean")).over(w) / F.sum("n").over(w))
    )

    def place(rank: Column) -> Column:
        inside = (F.col("cum") - n <= rank) & (rank < F.col("cum"))
        return F.max(F.when(inside, F.col("first") + rank - (F.col("cum") - n)))

    centre = staged(
        placed.groupBy(*keys).agg(
            place(low).alias("low_at"),
            place(high).alias("high_at"),
            F.first("total").alias("total"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.first("centre").alias("mean"),
            F.sqrt(
                F.sum(n * (F.col("spread") + (F.col("mean") - F.col("centre")) * (F.col("mean") - F.col("centre"))))
                / F.first("total")
            ).alias("sigma"),
            F.sum("zeros").alias("zeros"),
            F.sum("nonfinite").alias("nonfinite"),
        ),
        "centre",
    )
    total_rows, most_rows, groups = _frame_sizes(centre)
    central = attach(ordered, centre.select(*keys, "low_at", "high_at"), keys, F.col("_at"), count=groups)
    middle = central.filter((F.col("_at") == F.col("low_at")) | (F.col("_at") == F.col("high_at")))
    # dealt like the blocks, which then stay where they are when joined
    medians = dealt(middle, keys, rows).groupBy(*keys).agg(((F.min(v) + F.max(v)) / 2).alias("median"))
    least = F.when(F.col("lo") >= F.col("median"), F.col("lo") - F.col("median")).when(
        F.col("hi") <= F.col("median"), F.col("median") - F.col("hi")
    )
    most = F.greatest(F.abs(F.col("lo") - F.col("median")), F.abs(F.col("hi") - F.col("median")))
    spans = (
        matched(by_frame.select(*keys, "n", "lo", "hi").filter("n > 0"), medians, keys)
        .withColumns({"least": F.coalesce(least, F.lit(0.0)), "most": most})
        .withColumn("total", F.sum("n").over(w))
        .withColumn("surely", F.sum("n").over(_running(w, "most")))
        .withColumn("maybe", F.sum("n").over(_running(w, "least")) - n)
    )
    bounds = spans.groupBy(*keys).agg(
        F.first("median").alias("median"),
        F.first("total").alias("total"),
        F.max(F.when(F.col("maybe") <= low, F.col("least"))).alias("dev_lo"),
        F.min(F.when(F.col("surely") > high, F.col("most"))).alias("dev_hi"),
    )
    dev = F.abs(v - F.col("median"))
    near = _with_frames(ordered, bounds, keys, total_rows, most_rows, groups).filter(dev <= F.col("dev_hi"))
    # one row for all deviations below the bounds, one for each value between them
    counted = near.groupBy(*keys, F.when(dev >= F.col("dev_lo"), dev).alias("dev")).agg(
        F.count(F.lit(1)).alias("n"), F.first("total").alias("total"), F.first("median").alias("median")
    )
    cum = counted.withColumn("cum_dev", F.sum("n").over(_running(w, F.col("dev").asc_nulls_first())))
    found = cum.groupBy(*keys).agg(
        F.first("median").alias("median"),
        (MAD_TO_SIGMA * ((_deviation_at(low) + _deviation_at(high)) / 2)).alias("mad"),
    )
    return centre.drop("low_at", "high_at"), found


def _frame_sizes(centre: DataFrame) -> tuple[int, int, int]:
    """Samples of all frames and of the largest, and the number of frames, from the moments."""
    sizes = centre.select((F.coalesce("total", F.lit(0)) + F.col("nonfinite")).alias("total"))
    return *_sizes(sizes), centre.count()


def _with_frames(
    ordered: DataFrame, per_frame: DataFrame, keys: list[str], total: int, most: int, groups: int
) -> DataFrame:
    """``ordered`` with the columns of ``per_frame``, small frames dealt out whole.

    What is grouped or put in order by frame afterwards then needs no other shuffle.
    """
    rows = gathered(ordered, keys, total, most)
    if rows is ordered:
        return attach(ordered, per_frame, keys, F.col("_at"), count=groups)
    # without a broadcast both sides are dealt alike, else Spark takes the partitions of the smaller one
    if groups <= BROADCAST_ROWS:
        return rows.join(F.broadcast(per_frame), keys)
    return matched(rows, dealt(per_frame, keys, total), keys)


def frame_medians(values: DataFrame, keys: list[str] = ["frame_id"], value: str = "v") -> DataFrame:
    """Exact median per key, the mean of the two central values."""
    return order_statistics(in_order(values, keys, value), keys)[1].select(*keys, "median")


def _bin_summary() -> list[Column]:
    return [
        F.sum("at_min").alias("min_count"),
        F.sum("at_max").alias("max_count"),
        F.max(F.struct("n", (-F.col("bin")).alias("neg"))).alias("peak"),
        dense(F.collect_list(F.struct("bin", "n"))).alias("histogram"),
    ]


def stats_from_values(values: DataFrame) -> DataFrame:
    """All statistics fields per frame from ``frame_id, v`` rows of any distribution.

    NaN and infinite samples are left out and counted in ``nonfinite``. The mode is the
    centre of the fullest bin; saturation is the observed maximum. ``plane, y, x``, where
    there are such columns, spread a large frame's rows.

    Samples are sorted once, by range; every other pass reads that table and combines on the
    map side.
    """
    ordered = in_order(values)
    return fields_in_order(ordered, *order_statistics(ordered))


def fields_in_order(ordered: DataFrame, base: DataFrame, central: DataFrame) -> DataFrame:
    """All statistics fields from sorted rows, their moments and their median and MAD."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    bins = (
        _with_frames(ordered.filter(is_finite(v)), base.select("frame_id", "lo", "hi"), ["frame_id"], *_frame_sizes(base))
        .groupBy("frame_id", bin_index(v, lo, hi).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(v == lo).alias("at_min"),
            F.count_if(v == hi).alias("at_max"),
        )
        .groupBy("frame_id")
        .agg(*_bin_summary())
    )
    zero = F.lit(0).cast("bigint")
    centre = lo + (0.5 - F.col("peak")["neg"]) * (hi - lo) / HISTOGRAM_BINS
    described = matched(matched(base, central, ["frame_id"], "left"), bins, ["frame_id"], "left")
    return described.select(
        "frame_id",
        F.coalesce(lo, F.lit(float("inf"))).alias("min"),
        F.coalesce(hi, F.lit(float("-inf"))).alias("max"),
        F.coalesce("mean", F.lit(0.0)).alias("mean"),
        F.coalesce("median", F.lit(0.0)).alias("median"),
        F.coalesce("zeros", zero).alias("zeros"),
        F.coalesce("min_count", zero).alias("min_count"),
        F.coalesce("max_count", zero).alias("max_count"),
        F.coalesce("total", zero).alias("count"),
        F.coalesce("sigma", F.lit(0.0)).alias("sigma"),
        F.coalesce("mad", F.lit(0.0)).alias("mad"),
        F.when(hi > lo, centre).otherwise(F.coalesce(lo, F.lit(float("inf")))).alias("mode"),
        F.coalesce("max_count", zero).alias("saturated"),
        F.coalesce(hi, F.lit(float("-inf"))).alias("saturation"),
        F.coalesce("histogram", F.array_repeat(zero, HISTOGRAM_BINS)).alias("histogram"),
        "nonfinite",
    )


def general_stats(samples: DataFrame) -> DataFrame:
    """Statistics of float and wide-integer frames."""
    raw = F.col("raw").cast("double")
    return stats_from_values(samples.withColumn("v", S.physical(raw, F.col("bscale"), F.col("bzero"))))


def green_stats(green: DataFrame) -> DataFrame:
    """Statistics of cubes' green planes, rows ``frame_id, v, saturation``.

    With a known ceiling the values are rounded into [0, ceiling] and counted; a plane
    without one takes the general path.
    """
    bounded = F.col("saturation").between(0.0, 65535.999)
    top = F.floor("saturation").cast("double")
    whole = F.least(F.greatest(S.half_away(F.col("v")), F.lit(0.0)), top)
    counts = (
        green.filter(bounded)
        .groupBy("frame_id", whole.alias("v"))
        .agg(F.count(F.lit(1)).alias("n"), F.first(top).alias("saturation"))
    )
    unbounded = stats_from_values(green.filter(~bounded))
    return stats_from_counts(counts).unionByName(unbounded)


def pixel_stats(samples: DataFrame) -> DataFrame:
    """Statistics of any mix of frames: cubes on green, 8/16-bit by counts, others in general."""
    from nightframes.operators.planes import green_value

    cube = S.is_rgb_cube(F.col("axes"), F.col("planes"), F.col("bayerpat"))
    counted = ~cube & F.col("sample_type").isin(*COUNTED_TYPES) & (F.col("bscale") > 0)
    green = samples.filter(cube & (F.col("plane") == 1)).select(
        "frame_id", *green_value(F.col("raw"), F.col("sample_type"), F.col("bscale"), F.col("bzero"))
    )
    return (
        green_stats(green)
        .unionByName(integer_stats(samples.filter(counted)))
        .unionByName(general_stats(samples.filter(~cube & ~counted)))
    )


def saturated_percent(saturated: Column, count: Column) -> Column:
    return F.when(count > 0, F.round(saturated * 100.0 / count, 3)).otherwise(0.0)
