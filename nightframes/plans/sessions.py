"""Queries for session series, plots, incremental runs and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframes.functions import scalars as S
from nightframes.operators import incremental as N
from nightframes.operators import result_cache as R
from nightframes.operators import series as T
from nightframes.plans import fixtures as X
from nightframes.plans.header_catalog import SUMMARY_SQL
from nightframes.plans.registry import listed, query, six
from nightframes.plans.star_fields import CUBES, MIXED_SQL, MOSAICS, mixed_frames, mixed_lines
from nightframes.session import shared_dir, staged
from nightframes.streaming import continuous as G

_SERIES = f"{X.SESSION_SQL}, {X.SERIES_SQL}"


def session_values(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    frames = X.session_frames(spark, sf_dir, in_order).filter("status = 'analyzed'")
    return T.metric_values(frames)


# --- series -------------------------------------------------------------------------


@query(f"with {_SERIES} select session_id, metric, round(time, 6) as time, time_str, round(value, 6) as value, path from series")
def metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = T.ordered(T.build_series(session_values(spark, sf_dir)))
    return series.select("session_id", "metric", six("time"), "time_str", six("value"), "path")


_CATALOG_SQL = "catalog as (select * from (values " + ", ".join(
    f"({i}, '{m}', '{label}', '{family}')" for i, (m, label, family) in enumerate(T.METRICS)
) + ") as t(ord, metric, label, family))"


@query(
    f"""with {_SERIES}, {_CATALOG_SQL} select session_id, metric, ord, label, family, count(value) as points, count(*) filter (value is null) as unavailable
 from long join catalog using (metric) group by session_id, metric, ord, label, family"""
)
def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = T.series_summary(session_values(spark, sf_dir))
    return summary.join(F.broadcast(T.metric_catalog(spark)), "metric")


@query(
    f"""with {_SERIES} select session_id, metric, path, time_str as time_iso,
 rtrim(rtrim(printf('%.6f', time), '0'), '.') as epoch_seconds, regexp_replace(cast(value as varchar), '\\.0$', '') as csv_value from series"""
)
def series_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values keep all their digits, so their sums are taken in event order."""
    return T.csv_rows(T.build_series(session_values(spark, sf_dir, in_order=True))).drop("time")


_NICE = "case when {r} <= 1 then 1 when {r} <= 2 then 2 when {r} <= 5 then 5 else 10 end"
_AXES = f"""{_SERIES}, spans as (
 select session_id, metric, min(time) as t_lo, max(time) as t_hi, min(value) as lo0, max(value) as hi0 from series group by session_id, metric),
wide as (select *, case when hi0 > lo0 then lo0 else lo0 - 1 end as lo1, case when hi0 > lo0 then hi0 else hi0 + 1 end as hi1 from spans),
mags as (select *, pow(10::double, floor(log10((hi1 - lo1) / 4))) as mag from wide),
steps as (select *, {_NICE.format(r='((hi1 - lo1) / 4 / mag)')} * mag as step from mags),
axes as (select *, floor(lo1 / step) * step as lo, ceil(hi1 / step) * step as hi from steps)"""


@query(
    f"""with {_AXES} select session_id, metric, path,
 round(case when t_hi > t_lo then (time - t_lo) / (t_hi - t_lo) else 0.5 end, 6) as x, round(1 - (value - lo) / (hi - lo), 6) as y,
 strftime(make_timestamp((floor(time) * 1000000)::bigint), '%Y-%m-%d %H:%M:%S') as time_label
 from series join axes using (session_id, metric)"""
)
def plot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = T.plot_points(T.build_series(session_values(spark, sf_dir)))
    return points.select("session_id", "metric", "path", six("x"), six("y"), "time_label")


@query(
    f"""with {_AXES}, t as (select *, unnest(range(greatest(round((hi - lo) / step), 1)::bigint + 1)) as i from axes)
 select session_id, metric, i::int as i, round(lo + i * step, 6) as tick, round(1 - (lo + i * step - lo) / (hi - lo), 6) as pos from t"""
)
def value_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = T.series_axes(T.build_series(session_values(spark, sf_dir)))
    return T.value_ticks(axes).select("session_id", "metric", "i", six("tick"), six("pos"))


_STEPS = ", ".join(f"({s})" for s in T.TIME_STEPS)


@query(
    f"""with {_AXES}, stepped as (
 select session_id, metric, t_lo, t_hi, coalesce((select min(s) from (values {_STEPS}) v(s) where s >= (t_hi - t_lo) / 6), 86400)::double as s from axes),
 many as (select *, unnest(range(ceil(t_lo / s)::bigint, floor(t_hi / s)::bigint + 1)) * s as tick from stepped where t_hi > t_lo),
 ticks as (select session_id, metric, t_lo, t_hi, tick from many
  union all select session_id, metric, t_lo, t_hi, t_lo from stepped where t_hi <= t_lo or ceil(t_lo / s) > floor(t_hi / s)),
 texts as (select *, make_timestamp((floor(tick) * 1000000)::bigint) as ts, row_number() over (partition by session_id, metric order by tick) - 1 as i from ticks)
 select session_id, metric, i::int as i, round(tick, 6) as tick, round(case when t_hi > t_lo then (tick - t_lo) / (t_hi - t_lo) else 0.5 end, 6) as pos,
 strftime(ts, '%H:%M') as label, case when i = 0 or strftime(ts, '%Y-%m-%d') <> lag(strftime(ts, '%Y-%m-%d')) over (partition by session_id, metric order by tick)
 then strftime(ts, '%Y-%m-%d') else '' end as date_label from texts"""
)
def time_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = T.series_axes(T.build_series(session_values(spark, sf_dir)))
    return T.time_ticks(axes).select("session_id", "metric", "i", six("tick"), six("pos"), "label", "date_label")


_HOURS = """axes as (
 select user_id // 10 as session_id, (epoch_us(ts) // 3600000000)::bigint as hour, min(epoch_us(ts) / 1e6) as t_lo, max(epoch_us(ts) / 1e6) as t_hi
 from events group by 1, 2)"""


@query(
    f"""with {_HOURS}, stepped as (
 select session_id, hour, t_lo, t_hi, coalesce((select min(s) from (values {_STEPS}) v(s) where s >= (t_hi - t_lo) / 6), 86400)::double as s from axes),
 many as (select *, unnest(range(ceil(t_lo / s)::bigint, floor(t_hi / s)::bigint + 1)) * s as tick from stepped where t_hi > t_lo),
 ticks as (select session_id, hour, tick from many union all select session_id, hour, t_lo from stepped where t_hi <= t_lo or ceil(t_lo / s) > floor(t_hi / s))
 select session_id, cast(hour as varchar) as metric, round(tick, 6) as tick, strftime(make_timestamp((floor(tick) * 1000000)::bigint), '%H:%M') as label from ticks"""
)
def short_range_time_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of hour-long ranges, which use the small steps."""
    events = X.table(spark, sf_dir, "events").selectExpr(
        "user_id div 10 as session_id", f"{X.epoch('ts')} as time", "value"
    )
    hourly = events.withColumn("metric", F.floor(F.col("time") / 3600).cast("string"))
    return T.time_ticks(T.series_axes(hourly)).select("session_id", "metric", six("tick"), "label")


# --- incremental --------------------------------------------------------------------


def _plan_sql(family: str) -> str:
    covers = "c.stars_measured" if family == "star" else "true"
    return f"""plan as (
 select s.path, s.session_id, case when c.path is null or s.length <> c.length or s.stamp <> c.stamp or not (c.status = 'skipped_no_date' or {covers}) then 'todo'
  when c.status = 'skipped_no_date' then 'no_date' else 'metrics' end as action from session s left join cache c using (path))"""


def _plan(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    frames = X.session_frames(spark, sf_dir)
    targets = frames.select("path", "session_id", "length", "stamp")
    return N.plan_batch(targets, X.session_cache(frames), family)


@query(f"with {X.SESSION_SQL}, {X.CACHE_SQL}, {_plan_sql('pixel')} select path, session_id, action from plan")
def pixel_batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, "pixel").select("path", "session_id", "action")


@query(f"with {X.SESSION_SQL}, {X.CACHE_SQL}, {_plan_sql('star')} select path, session_id, action from plan")
def star_batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, "star").select("path", "session_id", "action")


@query(
    f"""with {X.SESSION_SQL} select status, stars_measured, status <> 'error' as pixel,
 status = 'skipped_no_date' or (status = 'analyzed' and stars_measured) as star, count(*) as n from session group by all"""
)
def coverage_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, measured = F.col("status"), F.col("stars_measured")
    groups = X.session_frames(spark, sf_dir).groupBy("status", "stars_measured").agg(F.count(F.lit(1)).alias("n"))
    return groups.select(
        "*", N.satisfies(status, measured, "pixel").alias("pixel"), N.satisfies(status, measured, "star").alias("star")
    )


@query(
    f"""with {X.SESSION_SQL}, {X.CACHE_SQL}, {_plan_sql('pixel')},
 results as (select s.* from session s join plan p using (path) where p.action = 'todo')
 select path, length, stamp, status from cache where path not in (select path from results where status <> 'error')
 union all select path, length, stamp, status from results where status <> 'error'"""
)
def updated_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = X.session_frames(spark, sf_dir)
    work = N.todo(_plan(spark, sf_dir, "pixel")).select("path")
    results = frames.join(work, "path", "left_semi")
    return N.upsert(X.session_cache(frames), results).select("path", "length", "stamp", "status")


@query(
    f"""with {X.SESSION_SQL}, {X.CACHE_SQL}, {_plan_sql('pixel')},
 results as (select s.* from session s join plan p using (path) where p.action = 'todo' and s.status <> 'error')
 select path, length, stamp, status from cache where path not in (select path from results)
 union all select path, length, stamp, status from results"""
)
def stored_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache as a stored table: kept results, then a batch over all frames, which is repeated."""
    frames = staged(X.session_frames(spark, sf_dir), "frames")
    folder = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    R.write_results(X.session_cache(frames), folder, 0)
    targets = frames.select("path", "length", "stamp")
    for _ in range(2):
        R.answer_batch(targets, folder, 1, lambda work: frames.join(work.select("path"), "path", "left_semi"))
    return R.read_results(spark, folder).select("path", "length", "stamp", "status")


@query(
    f"""with {X.SESSION_SQL}, {X.CACHE_SQL}
 select 'working' as kind, case when length % 3 = 0 then concat(path, '.fz') else path end as path from session
 union all select 'cache', path from cache where length % 3 <> 0"""
)
def replaced_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = X.session_frames(spark, sf_dir)
    moved = frames.filter("length % 3 = 0").selectExpr("path as old_path", "concat(path, '.fz') as new_path")
    working, cache = N.replace_paths(frames.select("path"), X.session_cache(frames), moved)
    return working.select(F.lit("working").alias("kind"), "path").unionByName(
        cache.select(F.lit("cache").alias("kind"), "path")
    )


@query(
    f"""with {X.SESSION_SQL} select session_id, count(*) as processed, count(*) filter (status = 'analyzed') as ok,
 count(*) filter (status = 'skipped_no_date') as skipped, count(*) filter (status = 'error') as failed from session group by session_id"""
)
def batch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.outcome_counts(X.session_frames(spark, sf_dir), ["session_id"])


@query(
    f"""with {_SERIES}, counts as (select session_id, count(*) filter (status = 'skipped_no_date') as skipped, count(*) filter (status = 'error') as failed from session group by session_id),
 sums as (select session_id, metric, count(value) as points, count(*) filter (value is null) as unavailable from long group by session_id, metric)
 select session_id, skipped, failed, metric, points, unavailable from counts left join sums using (session_id)"""
)
def result_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = staged(X.session_frames(spark, sf_dir), "frames")
    values = T.metric_values(frames.filter("status = 'analyzed'"))
    return N.result_view(frames, T.series_summary(values))


_HEIGHTS = """list_transform(string_split(histogram, ','), lambda c: cast(round(
  case when top > 0 then ln(c::bigint + 1) / ln(top + 1) else 0 end * 1000000) as bigint))"""


@query(
    f"""with recursive {MIXED_SQL}, {SUMMARY_SQL},
 headers as (select frame_id, string_agg(concat(name, '=', coalesce(value, '')), chr(10) order by ord) as cards from cards group by frame_id),
 lines as (select frame_id, string_agg(concat(label, ': ', value), chr(10) order by ord) as summary from summary group by frame_id),
 tops as (select *, list_max(list_transform(string_split(histogram, ','), lambda c: c::bigint)) as top from measured)
 select m.frame_id, case when m.frame_id >= {CUBES} and m.frame_id < {MOSAICS} then 'G' end as channel, coalesce(h.cards, '') as cards,
  coalesce(l.summary, '') as summary, min, max, mean, median, sigma, mad, zeros, array_to_string({_HEIGHTS}, ',') as heights,
  star_count, hfr, fwhm, eccentricity
 from tops m left join headers h on h.frame_id = m.frame_id % {CUBES} left join lines l on l.frame_id = m.frame_id % {CUBES}"""
)
def document_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole bundle of frames of all shapes; lists are shown as text."""
    lines = staged(mixed_lines(spark, sf_dir), "lines")
    frames = mixed_frames(lines)
    measured = N.measure_frames(lines, frames, pixel_stats=True, stars=True)
    # each frame gets the header of the order its number stands for
    headers = X.header_cards(spark, sf_dir).withColumnRenamed("frame_id", "order").withColumn("comment", F.lit(""))
    cards = frames.select("frame_id", (F.col("frame_id") % CUBES).alias("order")).join(headers, "order").drop("order")
    out = N.document_bundle(frames, cards, measured)

    def text(column: str, left: str, glue: str, right: str) -> Column:
        rows = F.transform(column, lambda r: F.concat(r[left], F.lit(glue), r[right]))
        return F.array_join(rows, "\n").alias(column)

    return out.select(
        "frame_id",
        "channel",
        text("cards", "name", "=", "value"),
        text("summary", "label", ": ", "value"),
        *[six(c) for c in "min max mean median sigma mad".split()],
        "zeros",
        listed(F.transform("heights", lambda h: F.round(h * 1000000).cast("bigint")), "heights"),
        "star_count",
        *[six(c) for c in ("hfr", "fwhm", "eccentricity")],
    )


# --- streams ------------------------------------------------------------------------

_ROLLING = (
    "select user_id as session_id, strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as window_start,"
    " count(*) as frames, round(avg(value), 6) as mean_value from events group by 1, 2"
)


def _timed_events(events: DataFrame) -> DataFrame:
    """Events with ``ts`` read as UTC, whatever the session's zone."""
    micros = F.expr(f"timestamp_micros(cast({X.epoch('ts')} * 1000000 as bigint))")
    return events.withColumn("ts", micros).withColumnRenamed("user_id", "session_id")


def _rolling_rows(rows: DataFrame) -> DataFrame:
    start = S.format_stamp(F.unix_micros("window_start") / 1000000).alias("window_start")
    return rows.select("session_id", start, "frames", six("mean_value"))


@query(_ROLLING)
def rolling_session_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _timed_events(X.table(spark, sf_dir, "events"))
    return _rolling_rows(G.rolling_metric(events, "ts", "value"))


@query(_ROLLING.replace("from events group", "from events where time_bucket(interval 1 hour, ts) + interval 1 hour <= (select max(ts) from events) group"))
def streamed_session_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream in append mode: windows the watermark has not passed stay open."""
    schema = X.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = G.write_stream(
        G.rolling_metric(_timed_events(events), "ts", "value", delay="0 seconds"), shared_dir(spark), "rolling"
    )
    return _rolling_rows(spark.read.parquet(out))
