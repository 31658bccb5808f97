"""Queries for star detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframes.operators import incremental as N
from nightframes.operators import planes as P
from nightframes.operators import series as T
from nightframes.operators import stars as D
from nightframes.plans import fixtures as X
from nightframes.plans.registry import query, six
from nightframes.plans.statistics import STAT_NAMES, shown, star_frames, stats_sql
from nightframes.session import staged


def components_sql(source: str, width: int | str, height: int | str, ceiling: float | str) -> str:
    """CTEs ending in ``stars`` over ``source`` (frame_id, y, x, v): unrestricted reachability."""
    return f"""med as (select frame_id, quantile_cont(v, 0.5) as median from {source} group by frame_id),
bg as (select frame_id, median, 1.4826 * quantile_cont(abs(v - median), 0.5) as mad from {source} join med using (frame_id) group by frame_id, median),
lit as (select frame_id, y, x, v, v - median as f from {source} join bg using (frame_id) where v > median + 5 * mad),
islands as (select *, x - row_number() over (partition by frame_id, y order by x) as island from lit),
runs as (select frame_id, y, min(x) as x0, max(x) as x1, y::bigint * 2147483648 + min(x) as run from islands group by frame_id, y, island),
adj as (
 select a.frame_id, a.run as a, b.run as b from runs a join runs b
 on a.frame_id = b.frame_id and b.y = a.y + 1 and a.x0 <= b.x1 + 1 and a.x1 >= b.x0 - 1),
both_ways as (select * from adj union all select frame_id, b, a from adj),
reach as (
 select frame_id, run, run as other from runs
 union select r.frame_id, r.run, e.b from reach r join both_ways e on e.frame_id = r.frame_id and e.a = r.other),
labels as (select frame_id, run, min(other) as label from reach group by frame_id, run),
comp_px as (
 select i.frame_id, l.label, i.y, i.x, i.v, i.f
 from (select *, y::bigint * 2147483648 + min(x) over (partition by frame_id, y, island) as run from islands) i
 join labels l on l.frame_id = i.frame_id and l.run = i.run),
comps as (
 select frame_id, label, count(*) as area, sum(f) as flux, sum(f * x) / sum(f) as cx, sum(f * y) / sum(f) as cy
 from comp_px group by frame_id, label
 having count(*) between 5 and 2000 and min(x) > 0 and min(y) > 0 and max(x) + 1 < {width} and max(y) + 1 < {height}
  and max(v) < {ceiling} and sum(f) > 0),
moments as (
 select c.frame_id, c.label, c.cx, c.cy, c.area, c.flux, sum(f * sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) / c.flux as hfr,
  sum(f * (x - cx) * (x - cx)) / c.flux as mxx, sum(f * (y - cy) * (y - cy)) / c.flux as myy, sum(f * (x - cx) * (y - cy)) / c.flux as mxy
 from comps c join comp_px p on p.frame_id = c.frame_id and p.label = c.label
 group by c.frame_id, c.label, c.cx, c.cy, c.area, c.flux),
axes as (select *, (mxx + myy) / 2 as mean, sqrt(((mxx - myy) / 2) * ((mxx - myy) / 2) + mxy * mxy) as spread from moments),
stars as (
 select frame_id, label, cx as x, cy as y, area, flux, hfr, 2.3548 * sqrt(greatest(mean, 0)) as fwhm,
  case when mean + spread <= 0 then 0 else sqrt(1 - least(greatest((mean - spread) / (mean + spread), 0), 1)) end as eccentricity
 from axes)"""


def star_stats_sql(frames: str) -> str:
    return f"""star_stats as (
 select f.frame_id, count(s.label) as star_count, median(hfr) as hfr, median(fwhm) as fwhm, median(eccentricity) as eccentricity
 from ({frames}) f left join stars s on s.frame_id = f.frame_id group by f.frame_id)"""


_STARS = f"with recursive {X.STAR_SQL}, {components_sql('star', X.STAR_SIDE, X.STAR_SIDE, 65535)}"
_STAR_STATS = f"{_STARS}, {star_stats_sql('select distinct frame_id from star')}"


def star_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(P.detection_rows(X.star_lines(spark, sf_dir)), "planes")


@query(f"{_STARS} select frame_id, run, label from labels")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star_planes(spark, sf_dir)
    runs = D.runs_above(rows, staged(D.plane_background(rows), "background"))
    return D.label_runs(staged(runs, "runs"))


@query(f"{_STARS} select frame_id, run, label from labels")
def connected_components_narrow_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with bands of four scanlines, so most components span several bands."""
    rows = star_planes(spark, sf_dir)
    runs = D.runs_above(rows, staged(D.plane_background(rows), "background"))
    return D.label_runs(staged(runs, "runs"), band_rows=4)


@query(
    f"{_STARS} select frame_id, label, area, round(flux, 6) as flux, round(cx, 6) as cx, round(cy, 6) as cy from comps"
)
def accepted_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star_planes(spark, sf_dir)
    runs = staged(D.runs_above(rows, staged(D.plane_background(rows), "background")), "runs")
    labelled = runs.withColumn("run", D.run_id(F.col("y"), F.col("x0"))).join(
        D.label_runs(runs), ["frame_id", "run"]
    )
    accepted = D.accepted_components(labelled)
    return accepted.select("frame_id", "label", "area", six("flux"), six("cx"), six("cy"))


_STAR_FIELDS = "x y flux hfr fwhm eccentricity".split()


@query(
    f"{_STARS} select frame_id, label, area, {', '.join(f'round({c}, 6) as {c}' for c in _STAR_FIELDS)} from stars"
)
def measured_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = D.find_stars(star_planes(spark, sf_dir))
    return stars.select("frame_id", "label", "area", *[six(c) for c in _STAR_FIELDS])


_SHAPE = ["hfr", "fwhm", "eccentricity"]


@query(
    f"""{_STAR_STATS} select frame_id, star_count, round(hfr, 6) as hfr, round(fwhm, 6) as fwhm, round(eccentricity, 6) as eccentricity,
 60 as plane_width, 60 as plane_height from star_stats"""
)
def star_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = staged(X.star_lines(spark, sf_dir), "lines")
    out = D.detect_stars(lines, star_frames(spark, sf_dir))
    return out.select("frame_id", "star_count", *[six(c) for c in _SHAPE], "plane_width", "plane_height")


# --- frames of all shapes ---------------------------------------------------------------

# What is added to the ids of cubes, mosaics and float frames, so that all lie in one table.
CUBES, MOSAICS, FLOATS = 1_000_000, 2_000_000, 3_000_000


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star fields, float cubes, mosaics and float frames together."""
    parts = [
        X.star_lines(spark, sf_dir),
        X.cube_lines(spark, sf_dir).filter("planes = 3").withColumn("frame_id", F.col("frame_id") + CUBES),
        X.mosaic_lines(spark, sf_dir).withColumn("frame_id", F.col("frame_id") + MOSAICS),
        X.vector_lines(spark, sf_dir).withColumn("frame_id", F.col("frame_id") + FLOATS),
    ]
    columns = ["frame_id", "plane", "y", "samples", *P.DESCRIPTOR]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def mixed_frames(lines: DataFrame) -> DataFrame:
    return lines.filter("y = 0 and plane = 0").select("frame_id", *P.DESCRIPTOR)


_CEILING = f"(case when frame_id >= {MOSAICS} then 32767 else 65535 end)"
_STAR_CEILING = f"(case when frame_id >= {FLOATS} then 'infinity'::double else {_CEILING} end)"
_SIDE = f"(case when frame_id < {CUBES} then {X.STAR_SIDE} else 8 end)"
MIXED_SQL = f"""{X.STAR_SQL}, {X.CUBE_SQL}, {X.MOSAIC_SQL},
counted as (
 select frame_id, y, x, v from star
 union all select frame_id + {CUBES}, y, x, greatest(least(round(raw * 65535), 65535), 0) from cube where planes = 3 and plane = 1
 union all select frame_id + {MOSAICS}, y, x, raw::double from mosaic),
floats as (select frame_id + {FLOATS} as frame_id, y, x, raw as v from vector),
detect as (
 select * from counted where frame_id < {MOSAICS} union all select * from floats
 union all select frame_id + {MOSAICS}, y // 2, x // 2, avg(raw) from mosaic
 where (x + y) % 2 = case when cfa in ('RGGB', 'BGGR') then 1 else 0 end group by frame_id, y // 2, x // 2),
{components_sql('detect', _SIDE, _SIDE, _STAR_CEILING)}, {star_stats_sql('select distinct frame_id from detect')},
{stats_sql('counted', _CEILING)}, {stats_sql('floats', None, 'float_')},
measured as (
 select s.*, star_count, round(hfr, 6) as hfr, round(fwhm, 6) as fwhm, round(eccentricity, 6) as eccentricity
 from (select * from stats union all select * from float_stats) s join star_stats using (frame_id))"""
_MEASURED = f"frame_id, {', '.join(STAT_NAMES)}, histogram, star_count, hfr, fwhm, eccentricity"


@query(f"with recursive {MIXED_SQL} select {_MEASURED}, {_SIDE} as plane_width from measured")
def measured_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and stars asked for together, of frames of all shapes."""
    lines = staged(mixed_lines(spark, sf_dir), "lines")
    out = N.measure_frames(lines, mixed_frames(lines), pixel_stats=True, stars=True)
    return shown(out, "star_count", *[six(c) for c in _SHAPE], "plane_width")


_MOSAIC_PLANE = f"""{X.MOSAIC_SQL},
detect as (
 select frame_id, y // 2 as y, x // 2 as x, avg(raw) as v from mosaic
 where (x + y) % 2 = case when cfa in ('RGGB', 'BGGR') then 1 else 0 end group by frame_id, y // 2, x // 2)"""


@query(
    f"""with recursive {_MOSAIC_PLANE}, {components_sql('detect', 8, 8, 32767)}, {star_stats_sql('select distinct frame_id from detect')}
 select frame_id, star_count, round(hfr, 6) as hfr,
 'measured on the green super-pixel plane, 8 x 8' as note from star_stats"""
)
def mosaic_star_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = X.mosaic_frames(spark, sf_dir)
    out = D.detect_stars(X.mosaic_lines(spark, sf_dir), frames).join(P.with_shape(frames), "frame_id")
    sizes = [F.col(c) for c in ("plane_width", "plane_height", "width", "height", "channels")]
    return out.select("frame_id", "star_count", six("hfr"), D.plane_note(*sizes).alias("note"))


@query(
    f"""{_STAR_STATS}, asked as (select *, frame_id % 3 <> 0 as stars_measured from star_stats)
 select frame_id, m.metric as metric, round(m.value, 6) as value from (select frame_id, unnest([
  {{'metric': 'star_count', 'value': case when stars_measured then star_count::double end}},
  {{'metric': 'hfr', 'value': case when stars_measured then hfr end}},
  {{'metric': 'fwhm', 'value': case when stars_measured then fwhm end}},
  {{'metric': 'eccentricity', 'value': case when stars_measured then eccentricity end}}]) as m from asked)"""
)
def star_metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star count of zero is a value; nothing is one where stars were not asked for."""
    lines = staged(X.star_lines(spark, sf_dir), "lines")
    stats = D.detect_stars(lines, star_frames(spark, sf_dir))
    metrics = stats.select(
        F.lit(0).alias("session_id"),
        F.col("frame_id").alias("path"),
        F.lit(0.0).alias("time"),
        F.lit("").alias("time_str"),
        (F.col("frame_id") % 3 != 0).alias("stars_measured"),
        "star_count",
        *_SHAPE,
    )
    values = T.metric_values(metrics)
    return values.select(F.col("path").alias("frame_id"), "metric", six("value"))


_ANALYZED = f"""{_STAR_STATS}, st as (
 select frame_id, round(max(v), 6) as max, round(quantile_cont(v, 0.5), 6) as median from star group by frame_id)
select frame_id, case when frame_id % 5 = 0 then 'skipped_no_date' else 'analyzed' end as status,
 case when frame_id % 5 <> 0 then 1704067200.0::double + frame_id end as time,
 case when frame_id % 5 <> 0 then max end as max, case when frame_id % 5 <> 0 then median end as median,
 case when frame_id % 5 <> 0 then star_count end as star_count, case when frame_id % 5 <> 0 then round(hfr, 6) end as hfr
from star_stats join st using (frame_id)"""


@query(_ANALYZED)
def analyzed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = staged(X.star_lines(spark, sf_dir), "lines")
    seconds = F.col("frame_id").cast("double")
    stamp = F.concat(
        F.lit("2024-01-01T"),
        F.lpad(F.floor(seconds / 3600).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((F.floor(seconds / 60) % 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((F.col("frame_id") % 60).cast("string"), 2, "0"),
    )
    frames = star_frames(spark, sf_dir).select(
        "*",
        F.col("frame_id").cast("string").alias("path"),
        F.lit(1).alias("session_id"),
        F.when(F.col("frame_id") % 5 == 0, "not a date").otherwise(stamp).alias("date_obs"),
        F.lit(" ").alias("date_loc"),
    )
    out = N.analyze_frames(lines, frames, stars=True)
    return out.select(
        "frame_id", "status", "time", six("max"), six("median"), "star_count", six("hfr")
    )
