"""Session time series of frame metrics, their plot geometry and CSV rows.

The ``metrics`` table has one row per frame: ``path, session_id, time, time_str``, the ten
pixel metrics, and ``star_count, hfr, fwhm, eccentricity``. ``stars_measured`` says whether
stars were asked for; without it the star metrics are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframes.functions import scalars as S
from nightframes.session import attach, staged

# Metric column, label and family, in listing order.
METRICS = (
    ("min", "Min ADU", "pixel"),
    ("max", "Max ADU", "pixel"),
    ("median", "Median ADU", "pixel"),
    ("mean", "Mean ADU", "pixel"),
    ("max_count", "Max-ADU count", "pixel"),
    ("min_count", "Min-ADU count", "pixel"),
    ("sigma", "Noise sigma", "pixel"),
    ("mad", "Noise MAD", "pixel"),
    ("mode", "Sky background", "pixel"),
    ("saturated", "Saturated pixels", "pixel"),
    ("star_count", "Star count", "star"),
    ("hfr", "HFR", "star"),
    ("fwhm", "FWHM", "star"),
    ("eccentricity", "Eccentricity", "star"),
)
DEFAULT_METRIC = {"pixel": "mean", "star": "hfr"}
# Steps of a time axis in seconds.
TIME_STEPS = (
    1.0, 2.0, 5.0, 10.0, 15.0, 30.0,
    60.0, 120.0, 300.0, 600.0, 900.0, 1800.0,
    3600.0, 7200.0, 10800.0, 21600.0, 43200.0, 86400.0,
)

SERIES_KEYS = ["session_id", "metric"]


def metric_catalog(spark: SparkSession) -> DataFrame:
    """The 14 metrics with position, label and family."""
    rows = [(i, name, label, family) for i, (name, label, family) in enumerate(METRICS)]
    return spark.createDataFrame(rows, "ord int, metric string, label string, family string")


def metric_values(metrics: DataFrame) -> DataFrame:
    """One row per frame and metric; NULL where the frame has no value for it.

    Metrics the input has no column for are left out.
    """
    present = [m for m in METRICS if m[0] in metrics.columns]
    measured = F.col("stars_measured") if "stars_measured" in metrics.columns else F.lit(True)

    def value(name: str, family: str) -> Column:
        v = F.col(name).cast("double")
        if name == "star_count":
            v = F.coalesce(v, F.lit(0.0))
        return F.when(measured, v) if family == "star" else v

    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), value(name, family).alias("value"))
            for name, _, family in present
        ]
    )
    return metrics.select(
        "session_id", "path", "time", "time_str", F.explode(pairs).alias("m")
    ).select("session_id", "m.metric", "time", "time_str", "m.value", "path")


def build_series(values: DataFrame, metric: str | None = None) -> DataFrame:
    """Points of the series: frames that have a value. Order them by time, then path."""
    rows = values if metric is None else values.filter(F.col("metric") == metric)
    return rows.filter(F.col("value").isNotNull())


def ordered(series: DataFrame) -> DataFrame:
    return series.orderBy("session_id", "metric", "time", "path")


def series_summary(values: DataFrame) -> DataFrame:
    """Points and frames without a value, per session and metric."""
    return values.groupBy(*SERIES_KEYS).agg(
        F.count("value").alias("points"), F.count_if(F.col("value").isNull()).alias("unavailable")
    )


# --- axes ---------------------------------------------------------------------------


def nice_step(span: Column, intervals: int = 4) -> Column:
    """1, 2, 5 or 10 times a power of ten giving about ``intervals`` steps over ``span``."""
    raw = span / intervals
    magnitude = F.pow(F.lit(10.0), F.floor(F.log10(raw)).cast("double"))
    share = raw / magnitude
    step = F.when(share <= 1.0, 1.0).when(share <= 2.0, 2.0).when(share <= 5.0, 5.0).otherwise(10.0)
    return F.when(F.isnan(span) | (span <= 0), 1.0).otherwise(step * magnitude)


def value_axis(lo: Column, hi: Column) -> Column:
    """Struct (lo, hi, step, count): bounds on multiples of a nice step, ±1 when flat."""
    low = F.when(hi > lo, lo).otherwise(lo - 1.0)
    high = F.when(hi > lo, hi).otherwise(hi + 1.0)
    step = nice_step(high - low)
    first = F.floor(low / step) * step
    last = F.ceil(high / step) * step
    return F.struct(
        first.alias("lo"),
        last.alias("hi"),
        step.alias("step"),
        F.greatest(S.half_away((last - first) / step), F.lit(1.0)).cast("int").alias("count"),
    )


def series_axes(series: DataFrame) -> DataFrame:
    """Time range and value axis per series."""
    spans = series.groupBy(*SERIES_KEYS).agg(
        F.min("time").alias("t_lo"),
        F.max("time").alias("t_hi"),
        F.min("value").alias("v_lo"),
        F.max("value").alias("v_hi"),
    )
    return spans.select(
        *SERIES_KEYS, "t_lo", "t_hi", value_axis(F.col("v_lo"), F.col("v_hi")).alias("axis")
    )


def _x(t: Column) -> Column:
    lo, hi = F.col("t_lo"), F.col("t_hi")
    return F.when(hi > lo, (t - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(0.5)


def _y(v: Column) -> Column:
    lo, hi = F.col("axis.lo"), F.col("axis.hi")
    return F.when(hi > lo, 1.0 - (v - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(0.5)


def plot_points(series: DataFrame) -> DataFrame:
    """Points in 0..1 plot space with time and value labels.

    The axis of a series is two extremes; they are aggregated, staged and joined back
    instead of holding a whole session in one window.
    """
    axes = staged(series_axes(series), "axes")
    rows = attach(series, axes, SERIES_KEYS, F.col("path"))
    return rows.select(
        *SERIES_KEYS,
        "path",
        "time",
        _x(F.col("time")).alias("x"),
        _y(F.col("value")).alias("y"),
        S.format_stamp(F.col("time")).alias("time_label"),
        S.format_stat(F.col("value")).alias("value_label"),
    )


def value_ticks(axes: DataFrame) -> DataFrame:
    """Ticks of the value axis, from its low end up."""
    tick = F.col("axis.lo") + F.col("i") * F.col("axis.step")
    return axes.select(
        "*", F.explode(F.sequence(F.lit(0), F.col("axis.count"))).alias("i")
    ).select(*SERIES_KEYS, "i", tick.alias("tick"), _y(tick).alias("pos"), S.format_stat(tick).alias("label"))


def time_ticks(axes: DataFrame) -> DataFrame:
    """Ticks on multiples of the smallest step that gives at most about six intervals.

    A single instant, or a range without a multiple, gets one tick at its start. The date
    shows on the first tick and where it differs from the tick before.
    """
    lo, hi = F.col("t_lo"), F.col("t_hi")
    steps = F.array(*[F.lit(s) for s in TIME_STEPS])
    fitting = F.filter(steps, lambda s: s >= (hi - lo) / 6.0)
    rows = axes.withColumn("step", F.coalesce(F.array_min(fitting), F.lit(TIME_STEPS[-1])))
    step = F.col("step")
    first, last = F.ceil(lo / step), F.floor(hi / step)
    multiples = F.transform(F.sequence(first, last), lambda k: k * step)
    ticks = F.when((hi > lo) & (first <= last), multiples).otherwise(F.array(lo))
    t = F.col("t")
    rolled = (F.col("i") == 0) | (S.format_date(t) != S.format_date(t - step))
    return rows.select("*", F.posexplode(ticks).alias("i", "t")).select(
        *SERIES_KEYS,
        "i",
        t.alias("tick"),
        _x(t).alias("pos"),
        S.format_time(t).alias("label"),
        F.when(rolled, S.format_date(t)).otherwise("").alias("date_label"),
    )


# --- CSV ----------------------------------------------------------------------------


def csv_rows(series: DataFrame) -> DataFrame:
    """Series points as the text fields of the CSV export."""
    return series.select(
        *SERIES_KEYS,
        "time",
        "path",
        F.col("time_str").alias("time_iso"),
        S.shortest_float(F.col("time")).alias("epoch_seconds"),
        S.shortest_float(F.col("value")).alias("csv_value"),
    )


def write_series_csv(series: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write every series below ``path`` as ``session_id=…/metric=…`` CSV, in time order.

    Rows are range-partitioned by series and time: a long session becomes several files
    that follow each other, not one task's work. Columns: time_iso, epoch_seconds, value.
    """
    rows = csv_rows(series)
    order = [*SERIES_KEYS, "time", "path"]
    (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(*SERIES_KEYS, "time_iso", "epoch_seconds", F.col("csv_value").alias("value"))
        .write.mode(mode)
        .partitionBy(*SERIES_KEYS)
        .option("header", True)
        .csv(path)
    )
