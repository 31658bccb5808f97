"""Queries for header cards, the frame catalog and scalar functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframes.functions import scalars as S
from nightframes.operators import catalog as C
from nightframes.operators import headers as H
from nightframes.operators import planes as P
from nightframes.plans import fixtures as X
from nightframes.plans.registry import query, six
from nightframes.session import staged

# Number text in SQL: whole values without a fraction, others with six decimals trimmed.
_TRIM = "case when {v} = floor({v}) and abs({v}) < 1e15 then cast(cast({v} as bigint) as varchar) else regexp_replace(printf('%.6f', {v}), '\\.?0+$', '') end"


def trim(v: str) -> str:
    return _TRIM.format(v=v)


_KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
_KEYS = _KEY.split(", ")

# --- units and cards ----------------------------------------------------------------


@query(
    "select l_orderkey as path, min(l_linenumber) as hdu, max(l_quantity) filter (l_linenumber = m) as width from"
    " (select *, min(l_linenumber) over (partition by l_orderkey) as m from lineitem where l_returnflag <> 'R') group by l_orderkey"
)
def first_image_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as units of an order's file; returned ones hold no image."""
    units = X.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as path", "l_linenumber as hdu", "l_returnflag <> 'R' as is_image", "l_quantity as width"
    )
    merged = units.groupBy("path", "hdu", "is_image").agg(F.max("width").alias("width"))
    return C.first_image(merged)


@query(
    """select o_orderkey as frame_id, 1 as ord, 'OBJECT' as name, o_orderpriority as value, 'string' as vtype, 'it''s' as comment from orders
 union all select o_orderkey, 2, 'EXPTIME', cast(cast(o_totalprice as decimal(18,2)) as varchar), 'number', 'seconds' from orders
 union all select o_orderkey, 3, 'NOTE', concat('o''', o_orderstatus, '/x'), 'string', '' from orders
 union all select o_orderkey, 4, 'SIMPLE', 'T', 'logical', '' from orders
 union all select o_orderkey, 5, 'HISTORY', null, null, concat('made ', cast(o_custkey as varchar)) from orders"""
)
def parsed_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """80-column cards written from orders and parsed back."""
    quote, c = F.lit("'"), F.col

    def card(*parts) -> Column:
        return F.rpad(F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]), 80, " ")

    price = c("o_totalprice").cast("decimal(18,2)").cast("string")
    cards = F.array(
        card("OBJECT  = ", quote, F.rpad("o_orderpriority", 16, " "), quote, " / it's"),
        card("EXPTIME = ", F.lpad(price, 20, " "), " / seconds"),
        card("NOTE    = ", quote, "o", quote, quote, c("o_orderstatus"), "/x", quote),
        card("SIMPLE  =                    T"),
        card("HISTORY made ", c("o_custkey").cast("string")),
    )
    raw = X.table(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("frame_id"), F.posexplode(cards).alias("pos", "card")
    )
    return C.header_cards(raw.selectExpr("frame_id", "pos + 1 as ord", "card"))


# --- catalog ------------------------------------------------------------------------

_FIRST = "(array_agg(value order by ord) filter (name = '{k}' and value is not null))[1]"


def first_value(keyword: str) -> str:
    return _FIRST.format(k=keyword)


CATALOG_SQL = f"""{X.CARDS_SQL}, texts as (
 select frame_id, {first_value('BITPIX')} as bitpix, {first_value('NAXIS')} as axes, {first_value('NAXIS3')} as planes,
  {first_value('OBJECT')} as object, {first_value('FILTER')} as filter, {first_value('EXPTIME')} as exptime, {first_value('DATE-OBS')} as date_obs,
  {first_value('DATE-LOC')} as date_loc, {first_value('BAYERPAT')} as bayerpat, {first_value('BZERO')} as bzero,
  {first_value('TELESCOP')} as telescope, {first_value('FOCALLEN')} as focal from cards group by frame_id),
catalog as (
 select frame_id, try_cast(bitpix as bigint) as bitpix, try_cast(axes as bigint) as axes, try_cast(planes as bigint) as planes,
  case when bayerpat is null and try_cast(axes as bigint) = 3 and try_cast(planes as bigint) = 3 then 3 else 1 end as channels,
  coalesce(bitpix = '16' and try_cast(bzero as double) = 32768, false) as is_unsigned16, trim(bayerpat) as bayerpat, object, filter,
  try_cast(exptime as double) as exptime_s, date_obs, date_loc, telescope, try_cast(focal as double) as focal_len_mm from texts)"""


def quoted(name: str) -> str:
    return f'"{name}"'


_TYPED = {"bigint": "try_cast({v} as bigint)", "double": "try_cast({v} as double)", "string": "{v}"}
_PLAIN = ", ".join(
    f"{_TYPED[kind].format(v=first_value(keyword))} as {quoted(column)}" for column, keyword, kind in C.CATALOG_FIELDS
)
_CATALOG = [column for column, _, _ in C.CATALOG_FIELDS if column not in ("bayerpat", "xbinning", "ybinning")]


@query(
    f"""with {X.MORE_CARDS_SQL}, plain as (select frame_id, {_PLAIN} from cards group by frame_id)
 select frame_id, {', '.join(map(quoted, _CATALOG))}, trim(bayerpat) as bayerpat,
  case when bayerpat is null and axes = 3 and planes = 3 then 3 else 1 end as channels,
  coalesce(bitpix = 16 and bzero = 32768, false) as is_unsigned16,
  case when xbinning is not null and ybinning is not null then concat(xbinning, 'x', ybinning) end as binning from plain"""
)
def frame_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the catalog."""
    catalog = C.catalog(X.more_cards(spark, sf_dir), X.card_rows(spark, sf_dir, 16))
    pair = F.concat(F.col("binning.x").cast("string"), F.lit("x"), F.col("binning.y").cast("string"))
    return catalog.withColumn("binning", pair)


SUMMARY_SQL = f"""{CATALOG_SQL}, fields as (
 select frame_id, unnest([
  {{'ord': 0, 'label': 'Resolution', 'value': '0 x 0'}},
  {{'ord': 1, 'label': 'Bit depth', 'value': case when is_unsigned16 then '16-bit unsigned integer' else '16-bit integer' end}},
  {{'ord': 2, 'label': 'Channels', 'value': concat(channels, ' (', case when channels = 3 then 'debayered RGB' when bayerpat is not null then 'mosaic' else 'monochrome (debayered)' end, ')')}},
  {{'ord': 3, 'label': 'Bayer', 'value': bayerpat}},
  {{'ord': 4, 'label': 'Object', 'value': trim(object)}},
  {{'ord': 8, 'label': 'Exposure', 'value': {trim('exptime_s')} || ' s'}},
  {{'ord': 12, 'label': 'Filter', 'value': trim(filter)}},
  {{'ord': 14, 'label': 'Telescope', 'value': case when telescope is not null and focal_len_mm is not null then concat(trim(telescope), ' (', {trim('focal_len_mm')}, 'mm)')
    when telescope is not null then trim(telescope) else {trim('focal_len_mm')} || 'mm' end}},
  {{'ord': 15, 'label': 'Date-obs', 'value': trim(date_obs)}}]) as f from catalog),
summary as (
 select frame_id, f.ord as ord, f.label as label, f.value as value from fields where f.value is not null and f.value <> '')"""


@query(f"with {SUMMARY_SQL} select * from summary")
def frame_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.summary(C.catalog(X.header_cards(spark, sf_dir), X.card_rows(spark, sf_dir)))


_DATE_TEXTS = {
    "plain": "concat(d, 'T', '20:15:30.25')",
    "zulu": "concat('  ', d, 'T01:02:03ZZ ')",
    "leap": "concat(d, 'T23:59:60')",
    "bare": "d",
    "rolled": "concat(substr(d, 1, 8), '31T00:00:00')",
    "short": "concat(d, 'T10:11')",
    "hour": "concat(d, 'T24:00:00')",
    "month": "concat(substr(d, 1, 5), '13-01T00:00:00')",
    "one_digit": "concat(substr(d, 1, 4), '-3-4T5:6:7')",
}


@query(
    """with t as (select o_orderkey, cast(cast(o_orderdate as date) as varchar) as d, epoch(cast(o_orderdate as date)) as e,
  epoch(make_date(year(o_orderdate), month(o_orderdate), 1)) as m, epoch(make_date(year(o_orderdate), 3, 4)) as q from orders),
 r as (select o_orderkey, unnest(['plain','zulu','leap','bare','rolled','short','hour','month','one_digit']) as kind,
  unnest([e + 72930.25, e + 3723, e + 86400, null, m + 30 * 86400, null, null, null, q + 18367]::double[]) as seconds from t)
 select o_orderkey, kind, seconds from r"""
)
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = X.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "cast(cast(o_orderdate as date) as string) as d"
    )
    variants = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.expr(e).alias("text")) for k, e in _DATE_TEXTS.items()]
    )
    return orders.select("o_orderkey", F.explode(variants).alias("v")).select(
        "o_orderkey", "v.kind", S.parse_date_obs(F.col("v.text")).alias("seconds")
    )


@query(
    f"""with {CATALOG_SQL} select frame_id,
 case when length(trim(date_loc)) > 0 then epoch(cast(trim(date_loc) as timestamp)) else epoch(cast(date_obs as timestamp)) end as time,
 case when length(trim(date_loc)) > 0 then trim(date_loc) else date_obs end as time_str from catalog"""
)
def acquisition_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = C.catalog(X.header_cards(spark, sf_dir), X.card_rows(spark, sf_dir))
    return frames.select("frame_id", *C.acquisition_time(F.col("date_loc"), F.col("date_obs")))


@query(
    """select event_id, strftime(ts, '%Y-%m-%d') as date_text, strftime(ts, '%H:%M') as time_text, strftime(ts, '%Y-%m-%d %H:%M:%S') as stamp_text,
 strftime(ts - interval 20000 days, '%Y-%m-%d %H:%M:%S') as early_stamp, date_diff('day', date '1970-01-01', cast(ts as date)) as day_number from events"""
)
def epoch_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = X.table(spark, sf_dir, "events").selectExpr("event_id", "ts", f"{X.epoch('ts')} as t")
    t = F.col("t")
    return events.select(
        "event_id",
        S.format_date(t).alias("date_text"),
        S.format_time(t).alias("time_text"),
        S.format_stamp(t).alias("stamp_text"),
        S.format_stamp(t - 20000 * 86400.0).alias("early_stamp"),
        F.unix_date(F.to_date(S.format_date(t))).cast("bigint").alias("day_number"),
    )


@query(
    f"""with t as (select {_KEY}, l_extendedprice as p, l_extendedprice / 7 as q from lineitem)
 select {_KEY}, {trim('p')} as trimmed, {trim('q')} as trimmed_part, case when p = floor(p) then printf('%.0f', p) else printf('%.3f', p) end as stat,
 printf('%.2f', p) as star, round(p / 7, 2) as rounded from t"""
)
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_extendedprice")
    return X.table(spark, sf_dir, "lineitem").select(
        *_KEYS,
        S.trim_float(p).alias("trimmed"),
        S.trim_float(p / 7).alias("trimmed_part"),
        S.format_stat(p).alias("stat"),
        S.format_star(p).alias("star"),
        S.round_to(p / 7, 2).alias("rounded"),
    )


def _sexagesimal_sql(v: str, prefix: str) -> str:
    total = f"(round(abs({v}) * 3600 * 100) / 100)"
    return (
        f"floor({total} / 3600)::bigint as {prefix}w, floor(({total} - floor({total} / 3600) * 3600) / 60)::bigint as {prefix}m,"
        f" {total} - floor({total} / 3600) * 3600 - floor(({total} - floor({total} / 3600) * 3600) / 60) * 60 as {prefix}s"
    )


@query(
    f"""with t as (select o_orderkey, o_totalprice / 1000 - 250 as d, (o_totalprice / 1000 - 250) / 15 as h from orders),
 p as (select *, {_sexagesimal_sql('h', 'h')}, {_sexagesimal_sql('d', 'd')} from t)
 select o_orderkey, concat(case when h < 0 then '-' else '' end, hw, 'h ', printf('%02d', hm), 'm ', printf('%05.2f', hs), 's (', {trim('h')}, 'h)') as ra,
 concat(case when d < 0 then '-' else '' end, dw, '° ', printf('%02d', dm), ''' ', printf('%05.2f', ds), '" (', {trim('d')}, '°)') as dec,
 case when o_orderkey % 3 = 0 then '20 30 00' end as fallback from p"""
)
def sky_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = X.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_totalprice / 1000 - 250 as d")
    nothing = F.lit(None).cast("double")
    text = F.when(F.col("o_orderkey") % 3 == 0, " 20 30 00 ").otherwise("  ")
    return orders.select(
        "o_orderkey",
        S.coordinate("ra", F.col("d"), F.lit("x")).alias("ra"),
        S.coordinate("dec", F.col("d"), F.lit(None)).alias("dec"),
        S.coordinate("ra", nothing, text).alias("fallback"),
    )


@query(
    f"""with t as (select p_partkey, case when p_partkey % 3 = 0 then '  ' when p_partkey % 7 <> 0 then concat(' ', p_name) end as name,
  case when p_partkey % 2 = 0 then p_retailprice end as focal, case when p_partkey % 5 < 2 then p_size / 10.0::double end as ratio from part),
 o as (select p_partkey, nullif(trim(name), '') as name, nullif(concat_ws(' ', {trim('focal')} || 'mm', 'F/' || {trim('ratio')}), '') as optics from t)
 select p_partkey, case when name is not null and optics is not null then concat(name, ' (', optics, ')') else coalesce(name, optics) end as label from o"""
)
def telescope_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = X.table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        "case when p_partkey % 3 = 0 then '  ' when p_partkey % 7 <> 0 then concat(' ', p_name) end as name",
        "case when p_partkey % 2 = 0 then p_retailprice end as focal",
        "case when p_partkey % 5 < 2 then p_size / 10D end as ratio",
    )
    return parts.select(
        "p_partkey", S.telescope_label(F.col("name"), F.col("focal"), F.col("ratio")).alias("label")
    )


# --- shapes, patterns, samples ------------------------------------------------------

_SHAPES = "(2 + o_orderkey % 3)::int as axes, (1 + o_custkey % 4)::int as planes, case when o_custkey % 5 = 0 then 'RGGB' end as bayerpat"


@query(
    f"""with t as (select o_orderkey, {_SHAPES} from orders)
 select o_orderkey, case when bayerpat is null then case when axes = 3 and planes = 3 then 'rgb_cube' when axes = 2 then 'mono' else 'other' end
 when axes = 2 then 'mosaic' else 'other' end as shape, case when bayerpat is null and axes = 3 and planes = 3 then 3 else 1 end as channels from t"""
)
def frame_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "2 + o_orderkey % 3 as axes",
        "1 + o_custkey % 4 as planes",
        "case when o_custkey % 5 = 0 then 'RGGB' end as bayerpat",
    )
    return P.with_shape(rows).select("o_orderkey", "shape", "channels")


@query(
    """with t as (select o_orderkey, case o_orderkey % 6 when 0 then ' rggb ' when 1 then 'GbRg' when 2 then 'bggr' when 3 then 'GRBG ' when 4 then 'XTRANS' end as p from orders)
 select o_orderkey, case when upper(trim(p)) in ('RGGB', 'GBRG', 'BGGR', 'GRBG') then upper(trim(p)) end as cfa, 'BGGR' as forced,
 case when p is null or p = 'XTRANS' then 'error' else 'ok' end as status from t"""
)
def cfa_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "case o_orderkey % 6 when 0 then ' rggb ' when 1 then 'GbRg' when 2 then 'bggr' when 3 then 'GRBG ' when 4 then 'XTRANS' end as p",
    )
    cfa = S.cfa_pattern(F.col("p"))
    return rows.select(
        "o_orderkey",
        cfa.alias("cfa"),
        S.cfa_pattern(F.col("p"), "BGGR").alias("forced"),
        F.when(cfa.isNull(), "error").otherwise("ok").alias("status"),
    )


_SCALES = "case when o_orderkey % 3 = 0 then 2.0 when o_orderkey % 7 = 0 then -1.0 end as bscale, case when o_orderkey % 4 = 0 then 32768.0 end as bzero"


@query(
    f"""with t as (select o_orderkey, o_custkey, case o_custkey % 4 when 0 then 'U8' when 1 then 'I16' when 2 then 'F32' else 'I32' end as st, {_SCALES} from orders),
 d as (select *, coalesce(bscale, 1)::double as s, coalesce(bzero, 0)::double as z from t)
 select o_orderkey, s as scale, z as zero, z + s * o_custkey as physical,
 case when s <= 0 or st in ('F32', 'I32') then 'infinity'::double when st = 'U8' then z + s * 255 else z + s * 32767 end as saturation from d"""
)
def sample_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "o_custkey",
        "case o_custkey % 4 when 0 then 'U8' when 1 then 'I16' when 2 then 'F32' else 'I32' end as st",
        "case when o_orderkey % 3 = 0 then 2D when o_orderkey % 7 = 0 then -1D end as bscale",
        "case when o_orderkey % 4 = 0 then 32768D end as bzero",
    )
    scale, zero = S.default_scale(F.col("bscale")), S.default_zero(F.col("bzero"))
    return rows.select(
        "o_orderkey",
        scale.alias("scale"),
        zero.alias("zero"),
        S.physical(F.col("o_custkey"), scale, zero).alias("physical"),
        S.sample_saturation(F.col("st"), scale, zero).alias("saturation"),
    )


@query(
    f"""with t as (select {_KEY}, l_extendedprice - 20000 as v from lineitem), u as (select *, greatest(least(round(v), 65535), 0)::int as u from t)
 select {_KEY}, u as u16, u >> 8 as high, u::bigint as to16, (u >> 8)::bigint as to8, u::bigint * 65537 as to32,
 (u >> 8)::bigint * 257 as up16, (u >> 8)::bigint * 16843009 as up32 from u"""
)
def sample_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = S.round_to_u16(F.col("l_extendedprice") - 20000)
    low = S.high_byte(u)
    d16, d8 = F.lit(16), F.lit(8)
    return X.table(spark, sf_dir, "lineitem").select(
        *_KEYS,
        u.alias("u16"),
        low.alias("high"),
        S.to_output_depth(u, d16, 16).alias("to16"),
        S.to_output_depth(u, d16, 8).alias("to8"),
        S.to_output_depth(u, d16, 32).alias("to32"),
        S.to_output_depth(low, d8, 16).alias("up16"),
        S.to_output_depth(low, d8, 32).alias("up32"),
    )


@query(
    f"""with t as (select {_KEY}, (l_extendedprice - 1000) / 0.5::double as r from lineitem)
 select {_KEY}, greatest(least(round(r), 255), 0) as u8, greatest(least(round(r), 32767), -32768) as i16, round(r) as i32, r::float::double as f32, r as f64 from t"""
)
def source_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    def encoded(kind: str):
        return S.encode_as_source(F.col("l_extendedprice"), F.lit(kind), F.lit(0.5), F.lit(1000.0)).alias(kind.lower())

    return X.table(spark, sf_dir, "lineitem").select(
        *_KEYS, *[encoded(k) for k in ("U8", "I16", "I32", "F32", "F64")]
    )


@query(
    f"""with t as (select {_KEY}, l_extendedprice - 30000.5 as v from lineitem)
 select {_KEY}, greatest(least(round(v), 255), 0) + 0.0::double as i8, greatest(least(round(v), 65535), 0) - 32768 as i16,
 greatest(least(round(v), 4294967295), 0) - 2147483648 as i32, v::float::double as f32, v as f64 from t"""
)
def channel_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("l_extendedprice") - 30000.5
    return X.table(spark, sf_dir, "lineitem").select(
        *_KEYS, *[S.encode_channel(v, k)[0].alias(k) for k in ("i8", "i16", "i32", "f32", "f64")]
    )


# --- header rules -------------------------------------------------------------------

_RESERVED = "(" + ", ".join(f"'{n}'" for n in H.RESERVED) + ")"
_IS_RESERVED = f"({{n}} in {_RESERVED} or regexp_matches({{n}}, '^({'|'.join(H.RESERVED_FAMILIES)})[0-9]+$'))"


def is_reserved_sql(name: str) -> str:
    return _IS_RESERVED.format(n=name)


@query(
    f"""with {X.CARDS_SQL}, n as (select frame_id, ord, unnest([name, concat(name, frame_id % 10), concat(name, 'A')]) as name from cards)
 select name, {is_reserved_sql('name')} as reserved, count(*) as n from n group by name"""
)
def reserved_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = (F.col("frame_id") % 10).cast("string")
    names = F.array(F.col("name"), F.concat("name", digit), F.concat(F.col("name"), F.lit("A")))
    rows = X.header_cards(spark, sf_dir).select(F.explode(names).alias("name"))
    counts = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("name", H.is_reserved(F.col("name")).alias("reserved"), "n")


_CFA = "('BAYERPAT', 'XBAYROFF', 'YBAYROFF', 'BAYOFFX', 'BAYOFFY')"
_MERGE = f"""{X.CARDS_SQL}, {X.PAIRS_SQL},
cubes as (select distinct c.frame_id from cards c where name = 'NAXIS' and value = '3' and exists (select 1 from cards d where d.frame_id = c.frame_id and d.name = 'NAXIS3' and d.value = '3')),
candidates as (
 select p.source_id, p.target_id as frame_id, c.ord, c.name, c.value,
  row_number() over (partition by p.source_id, p.target_id, c.name, c.value is null order by c.ord) as nth
 from pairs p join cards c on c.frame_id = p.source_id
 where not {is_reserved_sql('c.name')} and not (c.name in {_CFA} and p.target_id in (select frame_id from cubes))),
missing as (
 select source_id, frame_id, ord, name, value from candidates k
 where value is null or (nth = 1 and not exists (select 1 from cards t where t.frame_id = k.frame_id and t.name = k.name)))"""


def _merged(operator: Callable[..., DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = staged(X.header_cards(spark, sf_dir), "cards")
    return operator(cards, X.header_pairs(spark, sf_dir), 2 * cards.count())


@query(f"with {_MERGE} select source_id, frame_id, ord, name, value from missing")
def missing_header_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _merged(H.missing_cards, spark, sf_dir)
    return out.select("source_id", "frame_id", "ord", "name", "value")


@query(
    f"""with {_MERGE} select p.source_id, p.target_id as frame_id, count(m.ord) as copied from pairs p
 left join missing m on m.source_id = p.source_id and m.frame_id = p.target_id group by p.source_id, p.target_id"""
)
def copied_card_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(H.copied_counts, spark, sf_dir)


@query(
    f"""with {_MERGE}, last as (select frame_id, max(ord) as last from cards group by frame_id)
 select p.source_id, c.frame_id, c.ord, c.name, c.value, false as copied from pairs p join cards c on c.frame_id = p.target_id
 union all select m.source_id, m.frame_id, m.ord + l.last, m.name, m.value, true from missing m join last l using (frame_id)"""
)
def copied_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _merged(H.copy_header, spark, sf_dir)
    return out.select("source_id", "frame_id", "ord", "name", "value", "copied")


@query(f"with {X.CARDS_SQL} select * from cards where not {is_reserved_sql('name')} and name not in ('BAYERPAT', 'OBJECT')")
def carried_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.carried_metadata(X.header_cards(spark, sf_dir), ("bayerpat", "Object"))


@query(f"with {X.CARDS_SQL} select * from cards where not {is_reserved_sql('name')} or name = 'BZERO'")
def carried_with_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.carried_with_scaling(X.header_cards(spark, sf_dir))


@query(
    f"""with {X.CARDS_SQL} select frame_id, ord, name, value, null as comment from cards
 union all select frame_id, max(ord) + 1, 'HISTORY', null, 'stretched' from cards group by frame_id"""
)
def provenance_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.add_history(X.header_cards(spark, sf_dir), "stretched").select(
        "frame_id", "ord", "name", "value", "comment"
    )


@query(
    f"""with {X.CARDS_SQL} select frame_id, ord, name, value from cards where not {is_reserved_sql('name')} and name not in {_CFA}
 union all select distinct frame_id, -1, 'BZERO', '32768.0' from cards union all select distinct frame_id, 0, 'BSCALE', '1.0' from cards"""
)
def written_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.output_cards(X.header_cards(spark, sf_dir), 1.0, 32768.0, P.CFA_KEYWORDS)


# --- working set and hashes ---------------------------------------------------------


@query(
    """with old as (select distinct o_custkey as c from orders where o_orderstatus = 'F'), o as (select c, row_number() over (order by c) - 1 as ord from old),
 fresh as (select o_custkey as c, min(o_orderkey) as first from orders where o_custkey not in (select c from old) group by o_custkey)
 select concat('f', c) as path, c as ord, false as added, false as first_added from old
 union all select concat('f', c), row_number() over (order by first) - 1 + (select max(c) + 1 from old), true, row_number() over (order by first) = 1 from fresh"""
)
def extended_working_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = X.table(spark, sf_dir, "orders")
    path = F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("path")
    working = orders.filter("o_orderstatus = 'F'").select(path, F.col("o_custkey").alias("ord")).distinct()
    new = orders.select(path, F.col("o_orderkey").alias("ord"))
    return C.add_paths(working, new)


@query(
    f"""with {X.CARDS_SQL}, blocks as (
 select frame_id, ord // 256 as b, sha256(string_agg(concat(name, '=', coalesce(value, '')), chr(10) order by ord)) as digest from cards group by frame_id, ord // 256)
 select frame_id, sha256(string_agg(digest, '' order by b)) as sha256 from blocks group by frame_id"""
)
def header_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.header_hash(X.header_cards(spark, sf_dir))


@query(
    f"""with {X.MOSAIC_SQL}, lines as (select frame_id, y, sha256(unhex(string_agg(format('{{:04x}}', raw), '' order by x))) as digest from mosaic group by frame_id, y),
 blocks as (select frame_id, y // 1024 as b, sha256(string_agg(digest, '' order by y)) as digest from lines group by frame_id, y // 1024)
 select frame_id, sha256(string_agg(digest, '' order by b)) as sha256 from blocks group by frame_id"""
)
def pixel_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pixel_hash(X.mosaic_lines(spark, sf_dir))


@query("select doc_id, sha256(text) as sha256 from documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "documents")
    return docs.select("doc_id", C.content_hash(F.col("text").cast("binary")).alias("sha256"))
