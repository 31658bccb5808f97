"""Queries for pixel statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframes.operators import planes as P
from nightframes.operators import stars as D
from nightframes.operators import stats as A
from nightframes.plans import fixtures as X
from nightframes.plans.registry import listed, query, six
from nightframes.session import staged

STAT_NAMES = (
    "min max mean median zeros min_count max_count count sigma mad mode saturated saturation"
).split()


def shown(stats: DataFrame, *more: Column | str) -> DataFrame:
    """Statistics with comparable column types, and further columns."""
    whole = ("zeros", "min_count", "max_count", "count", "saturated")
    return stats.select(
        "frame_id",
        *[F.col(c).cast("bigint").alias(c) if c in whole else six(c) for c in STAT_NAMES],
        listed("histogram"),
        *more,
    )


def stats_sql(source: str, ceiling: str | None, prefix: str = "") -> str:
    """CTEs ending in ``{prefix}stats`` over ``source`` (frame_id, v).

    With ``ceiling`` the mode is the most frequent value and saturated counts the ceiling;
    without, they come from the fullest bin and the maximum.
    """
    p = prefix
    if ceiling is not None:
        mode = f"(select min(v) from {p}peaks k where k.frame_id = b.frame_id)"
        saturated = f"(select count(*) from {source} s where s.frame_id = b.frame_id and s.v = {ceiling})"
        saturation = f"cast({ceiling} as double)"
    else:
        mode = (
            f"case when b.hi > b.lo then b.lo + ((select min(bin) from {p}fullest f where f.frame_id = b.frame_id) + 0.5)"
            f" * (b.hi - b.lo) / 256 else b.lo end"
        )
        saturated = f"(select count(*) from {source} s where s.frame_id = b.frame_id and s.v = b.hi)"
        saturation = "b.hi"
    return f"""{p}base as (
 select frame_id, min(v) as lo, max(v) as hi, avg(v) as mean, quantile_cont(v, 0.5) as median, count(*) as n,
  count(*) filter (v = 0) as zeros from {source} group by frame_id),
{p}freq as (select frame_id, v, count(*) as n from {source} group by frame_id, v),
{p}peaks as (select f.* from {p}freq f where n = (select max(n) from {p}freq g where g.frame_id = f.frame_id)),
{p}spread as (
 select s.frame_id, 1.4826 * quantile_cont(abs(s.v - b.median), 0.5) as mad, sqrt(avg((s.v - b.mean) * (s.v - b.mean))) as sigma
 from {source} s join {p}base b using (frame_id) group by s.frame_id),
{p}binned as (
 select frame_id, bin, count(*) as n from (
  select frame_id, case when hi > lo then least(cast(trunc((v - lo) * (256 / (hi - lo))) as int), 255) else 0 end as bin
  from {source} join {p}base using (frame_id)) group by frame_id, bin),
{p}fullest as (select f.* from {p}binned f where n = (select max(n) from {p}binned g where g.frame_id = f.frame_id)),
{p}hist as (
 select b.frame_id, string_agg(cast(coalesce(h.n, 0) as varchar), ',' order by i) as histogram, max(h.n) as top
 from {p}base b cross join (select range as i from range(256)) left join {p}binned h on h.frame_id = b.frame_id and h.bin = i group by b.frame_id),
{p}stats as (
 select b.frame_id, round(lo, 6) as min, round(hi, 6) as max, round(mean, 6) as mean, round(median, 6) as median, zeros,
  (select count(*) from {source} s where s.frame_id = b.frame_id and s.v = b.lo) as min_count,
  (select count(*) from {source} s where s.frame_id = b.frame_id and s.v = b.hi) as max_count,
  n as count, round(sigma, 6) as sigma, round(mad, 6) as mad, round({mode}, 6) as mode, {saturated} as saturated,
  round({saturation}, 6) as saturation, histogram
 from {p}base b join {p}spread using (frame_id) join {p}hist using (frame_id))"""


_QUANTITY = f"{X.QUANTITY_SQL}, px as (select frame_id, raw::double as v from quantity)"
_FIELDS = "frame_id, " + ", ".join(STAT_NAMES) + ", histogram"


@query(f"with {X.QUANTITY_SQL} select frame_id, raw, count(*) as n from quantity group by frame_id, raw")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = A.value_counts(X.quantity_samples(spark, sf_dir))
    return counts.select("frame_id", F.col("v").cast("int").alias("raw"), "n")


@query(f"with {_QUANTITY}, {stats_sql('px', '255')} select {_FIELDS} from stats")
def integer_pixel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(A.integer_stats(X.quantity_samples(spark, sf_dir)))


@query(f"with {_QUANTITY}, {stats_sql('px', '65535')} select {_FIELDS} from stats")
def unsigned16_pixel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(A.integer_stats(X.quantity_samples(spark, sf_dir, unsigned16=True)))


_VECTOR = f"{X.VECTOR_SQL}, px as (select frame_id, raw as v from vector)"


@query(f"with {_VECTOR}, {stats_sql('px', None)} select {_FIELDS} from stats")
def general_pixel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(A.general_stats(P.explode_samples(X.vector_lines(spark, sf_dir))))


_GREEN = f"""{X.CUBE_SQL},
green as (select frame_id, y, x, greatest(least(round(raw * 65535), 65535), 0) as v from cube where planes = 3 and plane = 1)"""


@query(f"with {_GREEN}, {stats_sql('green', '65535')} select {_FIELDS} from stats")
def green_plane_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(A.green_stats(P.green_plane(X.cube_lines(spark, sf_dir))))


_MIXED = f"""with {_GREEN}, {X.QUANTITY_SQL},
ints as (select frame_id, raw::double as v from quantity),
floats as (select 1000000 + frame_id as frame_id, raw as v from vector
 union all select 2000000 + frame_id, raw from cube where planes <> 3),
greens as (select 2000000 + frame_id as frame_id, v from green),
{stats_sql('ints', '255', 'i_')}, {stats_sql('floats', None, 'f_')}, {stats_sql('greens', '65535', 'g_')}
select * from i_stats union all select * from f_stats union all select * from g_stats"""


@query(_MIXED)
def mixed_pixel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ints = X.quantity_samples(spark, sf_dir).withColumn("plane", F.lit(0))
    floats = P.explode_samples(X.vector_lines(spark, sf_dir))
    cubes = P.explode_samples(X.cube_lines(spark, sf_dir))
    kept = "frame_id plane raw sample_type bscale bzero axes planes bayerpat".split()

    def numbered(df: DataFrame, base: int) -> DataFrame:
        return df.withColumns(
            {"frame_id": F.col("frame_id") + base, "raw": F.col("raw").cast("double")}
        ).select(kept)

    samples = numbered(ints, 0).unionByName(numbered(floats, 1000000))
    return shown(A.pixel_stats(samples.unionByName(numbered(cubes, 2000000))))


@query(
    f"with {_QUANTITY}, {stats_sql('px', '255')} select frame_id, unnest(range(256))::int as bin,"
    " unnest(string_split(histogram, ','))::bigint as n from stats"
)
def histogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = A.integer_stats(X.quantity_samples(spark, sf_dir))
    return stats.select("frame_id", F.posexplode("histogram").alias("bin", "n"))


@query(
    f"""with {_QUANTITY}, ranked as (
 select frame_id, v, row_number() over (partition by frame_id order by v) - 1 as r, count(*) over (partition by frame_id) as n from px)
select frame_id, max(v) filter (r = n // 4) as lower_quartile, max(v) filter (r = 0) as lowest from ranked group by frame_id"""
)
def rank_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = A.value_counts(X.quantity_samples(spark, sf_dir))
    quarter = A.value_at_rank(counts, F.floor(F.col("total") / 4), "lower_quartile")
    return quarter.join(A.value_at_rank(counts, F.lit(0), "lowest"), "frame_id")


@query(
    f"""with {_QUANTITY} select frame_id, count(*) filter (v = 50) as saturated, count(*) as count,
 round(100.0 * count(*) filter (v = 50) / count(*), 3)::double as percent from px group by frame_id"""
)
def saturated_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of pixels at the observed maximum, with 50 as the ceiling of this data."""
    counts = A.value_counts(X.quantity_samples(spark, sf_dir)).withColumn("saturation", F.lit(50.0))
    stats = A.stats_from_counts(counts)
    percent = A.saturated_percent(F.col("saturated"), F.col("count"))
    return stats.select("frame_id", "saturated", "count", percent.alias("percent"))


@query(
    f"""with {_QUANTITY}, {stats_sql('px', '255')} select b.frame_id, i::int as bin, round(ln(coalesce(h.n, 0) + 1.0) / ln(t.top + 1.0), 6) as height
 from base b cross join (select range as i from range(256)) left join binned h on h.frame_id = b.frame_id and h.bin = i join hist t on t.frame_id = b.frame_id"""
)
def histogram_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = A.integer_stats(X.quantity_samples(spark, sf_dir))
    heights = stats.select(
        "frame_id", F.posexplode(A.histogram_heights(F.col("histogram"))).alias("bin", "height")
    )
    return heights.select("frame_id", "bin", six("height"))


def _levels_sql(log: bool) -> str:
    w = "ln(n + 1.0)" if log else "n"
    top = "ln(max(n) over (partition by frame_id) + 1.0)" if log else "max(n) over (partition by frame_id)"
    return f"""cols as (select frame_id, bin // 4 as col, sum(n) as n from binned group by frame_id, bin // 4),
levels as (select frame_id, col, greatest(round({w} / {top} * 40), 1)::int as level from cols)
select b.frame_id, string_agg(cast(coalesce(level, 0) as varchar), ',' order by i) as levels
 from base b cross join (select range as i from range(64)) left join levels l on l.frame_id = b.frame_id and l.col = i group by b.frame_id"""


@query(f"with {_QUANTITY}, {stats_sql('px', '255')}, {_levels_sql(False)}")
def histogram_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = A.integer_stats(X.quantity_samples(spark, sf_dir))
    return stats.select("frame_id", listed(A.histogram_levels(F.col("histogram"), 64), "levels"))


@query(f"with {_VECTOR}, {stats_sql('px', None)}, {_levels_sql(True)}")
def histogram_columns_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = A.general_stats(P.explode_samples(X.vector_lines(spark, sf_dir)))
    levels = A.histogram_levels(F.col("histogram"), 64, log=True)
    return stats.select("frame_id", listed(levels, "levels"))


_PLANES = f"""{X.STAR_SQL}, {X.MOSAIC_SQL},
sites as (
 select frame_id, y // 2 as y, x // 2 as x, raw from mosaic
 where (x + y) % 2 = case when cfa in ('RGGB', 'BGGR') then 1 else 0 end),
detect as (select frame_id, y, x, avg(raw) as v from sites group by frame_id, y, x)"""


@query(
    f"""with {_PLANES}, {X.VECTOR_SQL},
px as (select frame_id, v from star union all select 1000000 + frame_id, v from detect union all select 2000000 + frame_id, raw from vector),
med as (select frame_id, quantile_cont(v, 0.5) as median from px group by frame_id)
select frame_id, round(median, 6) as median, round(1.4826 * quantile_cont(abs(v - median), 0.5), 6) as mad from px join med using (frame_id) group by frame_id, median"""
)
def plane_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = P.detection_rows(X.star_lines(spark, sf_dir))
    mosaics = P.detection_rows(X.mosaic_lines(spark, sf_dir)).withColumn("frame_id", F.col("frame_id") + 1000000)
    floats = P.detection_rows(X.vector_lines(spark, sf_dir)).withColumn("frame_id", F.col("frame_id") + 2000000)
    planes = staged(stars.unionByName(mosaics).unionByName(floats), "planes")
    background = D.plane_background(planes)
    return background.select("frame_id", six("median"), six("mad"))


def star_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.star_lines(spark, sf_dir).filter("y = 0")
    return lines.select("frame_id", *P.DESCRIPTOR)
