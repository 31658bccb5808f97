"""Queries for image-plane transforms, stretching and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframes.functions import scalars as S
from nightframes.operators import planes as P
from nightframes.operators import resample as R
from nightframes.operators import stretch as T
from nightframes.plans import fixtures as X
from nightframes.plans.registry import query, six
from nightframes.session import staged

CUBE_BASE, MONO_BASE = 1000000, 2000000


def numbered(lines: DataFrame, base: int) -> DataFrame:
    return lines.withColumn("frame_id", F.col("frame_id") + base)


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mosaics, cubes (with an incomplete one where the vectors run out) and mono frames."""
    return (
        X.mosaic_lines(spark, sf_dir)
        .unionByName(numbered(X.cube_lines(spark, sf_dir), CUBE_BASE))
        .unionByName(numbered(X.vector_lines(spark, sf_dir), MONO_BASE))
    )


def all_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = all_lines(spark, sf_dir).filter("y = 0")
    return lines.select("frame_id", *P.DESCRIPTOR).distinct()


# --- demosaic in SQL: neighbours from the mosaic's own formula, mirrored at the edges ---


def _at(x: str, y: str) -> str:
    return f"(({x})*37+({y})*101+frame_id*7)%4096"


_L, _R = "(case when x=0 then 1 else x-1 end)", "(case when x=15 then 14 else x+1 end)"
_U, _D = "(case when y=0 then 1 else y-1 end)", "(case when y=15 then 14 else y+1 end)"
_ACROSS = f"({_at(_L, 'y')} + {_at(_R, 'y')}) // 2"
_ALONG = f"({_at('x', _U)} + {_at('x', _D)}) // 2"
_CROSS = f"({_at(_L, 'y')} + {_at(_R, 'y')} + {_at('x', _U)} + {_at('x', _D)}) // 4"
_CORNERS = f"({_at(_L, _U)} + {_at(_R, _U)} + {_at(_L, _D)} + {_at(_R, _D)}) // 4"
DEMOSAIC_SQL = f"""{X.MOSAIC_SQL},
sited as (
 select *, case cfa when 'RGGB' then 0 when 'GRBG' then 0 else 1 end as ry, case cfa when 'RGGB' then 0 when 'GBRG' then 0 else 1 end as rx from mosaic),
demosaiced as (
 select frame_id, y, x,
  cast(case when y%2=ry and x%2=rx then raw when y%2=ry then {_ACROSS} when x%2=rx then {_ALONG} else {_CORNERS} end as int) as r,
  cast(case when (y%2=ry) = (x%2=rx) then {_CROSS} else raw end as int) as g,
  cast(case when y%2<>ry and x%2<>rx then raw when y%2<>ry then {_ACROSS} when x%2<>rx then {_ALONG} else {_CORNERS} end as int) as b
 from sited)"""

_U16 = "cast(greatest(least(round({v}), 65535), 0) as int)"
_SCALED = _U16.format(v="greatest(raw, 0) * (65535.0::double / top)")
RGB_SQL = f"""{DEMOSAIC_SQL}, {X.CUBE_SQL},
tops as (select {CUBE_BASE} + frame_id as frame_id, greatest(max(raw), 0) as top from cube group by frame_id
 union all select {MONO_BASE} + frame_id, greatest(max(raw), 0) from vector group by frame_id),
display as (select p.*, case when top > 0 then {_SCALED} else 0 end as s from (
  select {CUBE_BASE} + frame_id as frame_id, plane, y, x, raw, planes from cube
  union all select {MONO_BASE} + frame_id, 0, y, x, raw, 1 from vector) p join tops using (frame_id)),
rgb as (
 select frame_id, y, x, r, g, b, 'Demosaiced' as notice from demosaiced
 union all select frame_id, y, x, max(s) filter (plane = 0), max(s) filter (plane = 1), max(s) filter (plane = 2), 'AlreadyDebayeredRgbCube'
  from display where planes = 3 group by frame_id, y, x
 union all select frame_id, y, x, s, s, s, 'AlreadyDebayeredMono' from display where frame_id >= {MONO_BASE})"""


def stretch_sql(source: str, linked: bool, brightness: float = 0.25, carried: str = "") -> str:
    """CTEs ending in ``stretched`` over ``source`` (frame_id, y, x, r, g, b), 16-bit samples.

    Every pixel row is joined once with its frame's row of parameters; ``carried`` names
    columns to keep.
    """

    def mtf(m: str, x: str) -> str:
        return (
            f"case when {x} <= 0 then 0 when {x} >= 1 then 1 when abs({x} - {m}) < pow(2, -23) then 0.5::double"
            f" else (({m} - 1) * {x}) / ((2 * {m} - 1) * {x} - {m}) end"
        )

    keys = {c: -1 if linked else i for i, c in enumerate("rgb")}
    wide = ", ".join(
        f"max({v}) filter (channel = {k}) as {c}_{v}" for c, k in keys.items() for v in ("shadows", "midtones")
    )
    above = ", ".join(
        f"case when 1 - {c}_shadows > 0 then least(greatest(({c} / 65535.0::double - {c}_shadows) / (1 - {c}_shadows), 0), 1)"
        f" else 0 end as {c}_v"
        for c in "rgb"
    )
    out = ", ".join(f"{_U16.format(v=mtf(f'{c}_midtones', f'{c}_v') + ' * 65535.0::double')} as {c}" for c in "rgb")
    carried = f", {carried}" if carried else ""

    def central(value: str) -> str:
        """Mean of the two central values, from counts with running sums."""
        return f"(min({value}) filter (cum > (total - 1) // 2) + min({value}) filter (cum > total // 2)) / 2"

    return f"""pixels as materialized (select frame_id, y, x, r, g, b{carried} from {source}),
counts as materialized (
 select frame_id, channel, level / 65535.0::double as v, sum(n)::bigint as n from (
  select frame_id, {keys['r']} as channel, r as level, count(*) as n from pixels group by frame_id, r
  union all select frame_id, {keys['g']}, g, count(*) from pixels group by frame_id, g
  union all select frame_id, {keys['b']}, b, count(*) from pixels group by frame_id, b) group by frame_id, channel, level),
by_value as (
 select *, sum(n) over (partition by frame_id, channel order by v) as cum, sum(n) over (partition by frame_id, channel) as total from counts),
meds as materialized (select frame_id, channel, {central('v')} as median from by_value group by frame_id, channel),
devs as (select frame_id, channel, median, abs(v - median) as dev, n from counts join meds using (frame_id, channel)),
by_dev as (
 select *, sum(n) over (partition by frame_id, channel order by dev) as cum, sum(n) over (partition by frame_id, channel) as total from devs),
mads as materialized (
 select frame_id, channel, median, 1.4826 * ({central('dev')}) as mad from by_dev group by frame_id, channel, median),
shadow as (select *, least(greatest(median - 2.8 * mad, 0), 1) as shadows, {brightness}::double as t from mads),
lifted as (select *, median - shadows as d from shadow),
params as materialized (select frame_id, channel, median, mad, shadows, least(greatest({mtf('t', 'd')}, pow(2, -23)), 1 - pow(2, -23)) as midtones from lifted),
wide as materialized (select frame_id, {wide} from params group by frame_id),
scaled as (select pixels.*, wide.* exclude (frame_id), {above} from pixels join wide using (frame_id)),
stretched as (select frame_id, y, x, {out}{carried} from scaled)"""


# --- planes -------------------------------------------------------------------------


@query(
    f"with {X.CUBE_SQL} select frame_id, y, x, round(10 + 0.5 * raw, 6) as v from cube where plane = 1"
)
def physical_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.cube_lines(spark, sf_dir).withColumns({"bscale": F.lit(0.5), "bzero": F.lit(10.0)})
    return P.physical_pixels(lines, 1).select("frame_id", "y", "x", six("v"))


@query(
    f"""with {X.CUBE_SQL}, {X.MOSAIC_SQL},
 sites as (select frame_id, y // 2 as y, x // 2 as x, raw from mosaic where (x + y) % 2 = case when cfa in ('RGGB', 'BGGR') then 1 else 0 end)
 select frame_id, y::int as y, x::int as x, round(avg(raw), 6) as v, 32767.0::double as saturation from sites group by frame_id, y, x
 union all select {CUBE_BASE} + frame_id, y, x, greatest(least(round(raw * 65535), 65535), 0), 65535 from cube where planes = 3 and plane = 1
 union all select {MONO_BASE} + frame_id, y, x, round(raw, 6), 'infinity'::double from vector"""
)
def detection_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = P.detection_pixels(all_lines(spark, sf_dir))
    return px.select("frame_id", "y", "x", six("v"), "saturation")


@query(
    f"""with {X.CUBE_SQL} select distinct {CUBE_BASE} + frame_id as frame_id,
 'no single plane to look for stars on: 3 axes' as error from cube where planes <> 3
 union all select frame_id, error from (select distinct frame_id, 'no mosaic layout is called odd' as error from (select s_suppkey as frame_id from supplier) where frame_id % 4 = 3)"""
)
def detection_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("bayerpat") == "GRBG", "odd").otherwise(F.col("bayerpat"))
    return P.detection_errors(all_frames(spark, sf_dir).withColumn("bayerpat", bad))


@query(
    f"with {X.CUBE_SQL} select frame_id, y, x, greatest(least(round(raw * 65535), 65535), 0) as v, 65535.0::double as saturation from cube where planes = 3 and plane = 1"
)
def green_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.green_plane(X.cube_lines(spark, sf_dir))


@query(
    f"""with {X.MOSAIC_SQL} select cfa, y % 2 as sy, x % 2 as sx, count(*) as n, sum(raw)::bigint as total from mosaic
 where case when cfa in ('RGGB', 'BGGR') then (x % 2, y % 2) in ((1, 0), (0, 1)) else (x % 2, y % 2) in ((0, 0), (1, 1)) end group by all"""
)
def green_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = P.explode_samples(X.mosaic_lines(spark, sf_dir))
    green = px.filter(P.is_green_site(F.col("x"), F.col("y"), F.col("bayerpat")))
    return green.groupBy(
        F.col("bayerpat").alias("cfa"), (F.col("y") % 2).alias("sy"), (F.col("x") % 2).alias("sx")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("raw").cast("bigint").alias("total"))


@query(f"with {DEMOSAIC_SQL} select frame_id, y, x, r, g, b, 16 as depth from demosaiced")
def demosaiced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.demosaic(X.mosaic_lines(spark, sf_dir)).drop("width", "height")


@query(f"with {RGB_SQL} select frame_id, y, x, r, g, b, notice from rgb")
def loaded_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.load_rgb(all_lines(spark, sf_dir)).select("frame_id", "y", "x", *"rgb", "notice")


@query(
    f"""with {X.CUBE_SQL} select distinct {CUBE_BASE} + frame_id as frame_id, 'a mosaic has 2 axes, this frame has 3' as error from cube
 union all select distinct {MONO_BASE} + vec_id, 'the mosaic layout is not known' from embeddings"""
)
def forced_demosaic_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rgb_errors(all_frames(spark, sf_dir), force=True)


@query(
    f"""with {X.CUBE_SQL} select frame_id, y, x, round(max(raw) filter (plane = 0), 6) as r, round(max(raw) filter (plane = 1), 6) as g,
 round(max(raw) filter (plane = 2), 6) as b from cube where planes = 3 group by frame_id, y, x"""
)
def interleaved_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cubes = P.with_shape(X.cube_lines(spark, sf_dir)).filter("shape = 'rgb_cube'")
    return P.interleave(cubes).select("frame_id", "y", "x", *[six(c) for c in "rgb"])


@query(f"with {X.CUBE_SQL} select frame_id, plane, y, x, round(raw, 6) as v from cube where planes = 3")
def deinterleaved_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cubes = P.with_shape(X.cube_lines(spark, sf_dir)).filter("shape = 'rgb_cube'")
    return P.deinterleave(P.interleave(cubes)).select("frame_id", "plane", "y", "x", six("v"))


@query(f"with {X.MOSAIC_SQL} select frame_id, y, x, raw as r, raw as g, raw as b from mosaic")
def raw_grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.load_mono_raw(X.mosaic_lines(spark, sf_dir)).select("frame_id", "y", "x", *"rgb")


@query(
    f"""with {DEMOSAIC_SQL}, {X.CUBE_SQL}
 select frame_id, y, x, unnest(['r', 'g', 'b']) as channel, unnest([r, g, b])::double as v from demosaiced
 union all select {CUBE_BASE} + frame_id, y, x, ['r', 'g', 'b'][plane + 1], round(raw, 6) from cube where planes = 3"""
)
def split_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.split_channels(all_lines(spark, sf_dir))
    return out.select("frame_id", "y", "x", "channel", six("v"))


@query(
    f"""with {X.CUBE_SQL}, bad as (select distinct {CUBE_BASE} + frame_id as frame_id from cube where planes <> 3
 union select {MONO_BASE} + vec_id from embeddings)
 select frame_id, 'neither a mosaic layout nor three planes to split' as error from bad"""
)
def split_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_errors(all_frames(spark, sf_dir))


@query(
    f"with {DEMOSAIC_SQL} select frame_id, y, x, r, g, b, 'I16' as sample_type, 1.0::double as bscale, 0.0::double as bzero, 'Demosaiced' as notice from demosaiced"
)
def debayered(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.debayer(X.mosaic_lines(spark, sf_dir), X.mosaic_frames(spark, sf_dir))
    return out.drop("width", "height", "depth")


@query(
    f"""with {DEMOSAIC_SQL}, planar as (select frame_id, y, x, unnest([0, 1, 2]) as plane, unnest([r, g, b]) as v from demosaiced)
 select frame_id, plane, y, x, least(greatest(round((v - 1000) / 0.125::double), -32768), 32767) + 0.0::double as raw from planar"""
)
def written_as_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = X.mosaic_frames(spark, sf_dir)
    source = frames.withColumns({"bscale": F.lit(0.125), "bzero": F.lit(1000.0)})
    return P.encode_rgb_as_source(P.debayer(X.mosaic_lines(spark, sf_dir), source))


@query(f"with {DEMOSAIC_SQL}, planar as (select frame_id, y, x, unnest([0, 1, 2]) as plane, unnest([r, g, b]) as v from demosaiced)"
       " select frame_id, plane, y, x, (v - 32768)::double as raw, 32768.0::double as bzero from planar")
def rgb16_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.export_planes(P.demosaic(X.mosaic_lines(spark, sf_dir)), "i16")


@query(
    f"""with {X.VECTOR_SQL}, tops as (select frame_id, greatest(max(raw), 0) as top from vector group by frame_id)
 select frame_id, y, x, case when top > 0 then {_SCALED} else 0 end as s from vector join tops using (frame_id)"""
)
def float_to_u16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = P.rgb_from_mono(X.vector_lines(spark, sf_dir))
    return rgb.select("frame_id", "y", "x", F.col("r").alias("s"))


# --- stretch ------------------------------------------------------------------------

_PARAMS = "frame_id, channel, round(median, 6) as median, round(mad, 6) as mad, round(shadows, 6) as shadows, round(midtones, 6) as midtones"


@query(f"with {RGB_SQL}, {stretch_sql('rgb', False)} select {_PARAMS} from params")
def stretch_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = T.stretch_params(P.load_rgb(all_lines(spark, sf_dir)))
    return params.select("frame_id", "channel", *[six(c) for c in ("median", "mad", "shadows", "midtones")])


@query(f"with {RGB_SQL}, {stretch_sql('rgb', False)} select * from stretched")
def auto_stretched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.load_and_stretch(all_lines(spark, sf_dir)).select("frame_id", "y", "x", *"rgb")


@query(f"with {RGB_SQL}, {stretch_sql('rgb', True, 0.4)} select * from stretched")
def linked_stretched(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.load_and_stretch(all_lines(spark, sf_dir), linked=True, brightness=0.4)
    return out.select("frame_id", "y", "x", *"rgb")


_MTF = "case when {x} <= 0 then 0 when {x} >= 1 then 1 when abs({x} - {m}) < pow(2, -23) then 0.5::double else (({m} - 1) * {x}) / ((2 * {m} - 1) * {x} - {m}) end"


@query(
    f"""with t as (select l_orderkey, l_partkey, l_suppkey, (l_partkey % 1000) / 1000.0::double as v, (l_discount * 5)::double as shadows,
  (1 + l_suppkey % 98) / 100.0::double as m from lineitem),
 s as (select *, case when 1 - shadows > 0 then least(greatest((v - shadows) / (1 - shadows), 0), 1) else 0 end as x from t)
 select l_orderkey, l_partkey, l_suppkey, round({_MTF.format(x='x', m='m')}, 6) as stretched, round({_MTF.format(x='v', m='m')}, 6) as curve from s"""
)
def midtones_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = X.table(spark, sf_dir, "lineitem").withColumns(
        {
            "v": F.expr("(l_partkey % 1000) / 1000D"),
            "shadows": F.col("l_discount") * 5,
            "m": F.expr("(1 + l_suppkey % 98) / 100D"),
        }
    )
    v, shadows, m = F.col("v"), F.col("shadows"), F.col("m")
    return items.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        six(T.transfer(v, shadows, m), "stretched"),
        six(T.mtf(m, v), "curve"),
    )


@query(
    f"""with {RGB_SQL}, raw_rgb as (select frame_id, y, x, raw as r, raw as g, raw as b, 'RawMono' as source from mosaic
 union all select frame_id, y, x, r, g, b, notice from rgb where frame_id >= {CUBE_BASE}), {stretch_sql('raw_rgb', False, carried='source')}
 select * from stretched"""
)
def rendered_without_debayer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = T.render(all_lines(spark, sf_dir), debayer=False, stretch=True)
    return rgb.select("frame_id", "y", "x", *"rgb", "source")


@query(f"with {RGB_SQL} select frame_id, y, x, r, g, b, notice as source from rgb")
def rendered_without_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = T.render(all_lines(spark, sf_dir), debayer=True, stretch=False)
    return rgb.select("frame_id", "y", "x", *"rgb", "source")


@query(
    f"""with {RGB_SQL}, planar as (select frame_id, y, x, unnest([0, 1, 2]) as plane, unnest([r, g, b]) as v from rgb)
 select frame_id, plane, y, x, (v >> 8)::double as i8, (v - 32768)::double as i16, v::double as f32 from planar"""
)
def exported_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = staged(P.load_rgb(all_lines(spark, sf_dir)), "rgb")
    planar = P.deinterleave(rgb)
    sample = S.to_output_depth(F.col("v"), F.col("depth"), 16)
    return planar.select(
        "frame_id",
        "plane",
        "y",
        "x",
        *[S.export_sample(sample, target)[0].alias(target) for target in ("i8", "i16", "f32")],
    )


# --- resample -----------------------------------------------------------------------


def _resized_sql(w: int, h: int) -> str:
    return f"""with {DEMOSAIC_SQL}, spans as (
 select dx, dy, dx * 16 // {w} as x0, greatest((dx + 1) * 16 // {w}, dx * 16 // {w} + 1) as x1,
  dy * 16 // {h} as y0, greatest((dy + 1) * 16 // {h}, dy * 16 // {h} + 1) as y1
 from (select range as dx from range({w})) cross join (select range as dy from range({h})))
 select frame_id, dy::int as y, dx::int as x, (sum(r) // count(*))::int as r, (sum(g) // count(*))::int as g, (sum(b) // count(*))::int as b
 from demosaiced join spans on x >= x0 and x < x1 and y >= y0 and y < y1 group by frame_id, dy, dx"""


def _resized(spark: SparkSession, sf_dir: str, w: int, h: int) -> DataFrame:
    out = R.resize(P.demosaic(X.mosaic_lines(spark, sf_dir)), F.lit(w), F.lit(h))
    return out.select("frame_id", "y", "x", *"rgb")


@query(_resized_sql(5, 7))
def shrunk_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resized(spark, sf_dir, 5, 7)


@query(_resized_sql(24, 10))
def stretched_wide_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enlarged in one direction and shrunk in the other."""
    return _resized(spark, sf_dir, 24, 10)


@query(_resized_sql(9, 9))
def frames_fitted_to_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.resize_to_fit(P.demosaic(X.mosaic_lines(spark, sf_dir)), 9, 11)
    return out.select("frame_id", "y", "x", *"rgb")


_SIZES = "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_partkey % 5000 as w, l_suppkey % 4000 as h from lineitem"


@query(
    f"""with t as ({_SIZES}), s as (select *, least(1920.0::double / nullif(w, 0), 1080.0::double / nullif(h, 0)) as k from t)
 select l_orderkey, l_partkey, l_suppkey, l_linenumber,
 case when w = 0 or h = 0 then 0 else greatest(round(w * k)::int, 1) end as fit_w,
 case when w = 0 or h = 0 then 0 else greatest(round(h * k)::int, 1) end as fit_h from s"""
)
def fitted_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = X.table(spark, sf_dir, "lineitem").withColumns(
        {"w": F.expr("l_partkey % 5000"), "h": F.expr("l_suppkey % 4000")}
    )
    fit = R.fit_dimensions(F.col("w"), F.col("h"), F.lit(1920), F.lit(1080))
    return sizes.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", fit["width"].alias("fit_w"), fit["height"].alias("fit_h")
    )


@query(
    """with f as (select o_orderkey as frame_id, 1 + o_custkey % 6000 as w, 1 + o_orderkey % 5000 as h from orders),
 t as (select *, greatest(least(round(least(w, h) * 0.1::double), 256, least(w, h)), 1)::int as size from f),
 r as (select *, unnest(range(9))::int as region from t)
 select frame_id, size, region, (case region % 3 when 0 then 0 when 1 then greatest(w - size, 0) // 2 else greatest(w - size, 0) end)::int as x0,
 (case region // 3 when 0 then 0 when 1 then greatest(h - size, 0) // 2 else greatest(h - size, 0) end)::int as y0 from r"""
)
def inspection_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = X.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as frame_id", "1 + o_custkey % 6000 as width", "1 + o_orderkey % 5000 as height"
    )
    return R.frame_regions(frames).withColumn("size", F.col("size").cast("int"))


@query(
    f"""with {DEMOSAIC_SQL}, r as (select unnest(range(9))::int as region),
 o as (select region, (case region % 3 when 0 then 0 when 1 then 7 else 14 end) as x0, (case region // 3 when 0 then 0 when 1 then 7 else 14 end) as y0 from r)
 select frame_id, region, (y - y0)::int as ty, (x - x0)::int as tx, r, g, b from demosaiced join o on x >= x0 and x < x0 + 2 and y >= y0 and y < y0 + 2"""
)
def cropped_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.crop_regions(P.demosaic(X.mosaic_lines(spark, sf_dir)))
