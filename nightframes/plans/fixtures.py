"""The driver's tables reshaped as frames, in Spark and as SQL for the oracle.

Nothing here is synthesised beyond what follows from a table row: every frame belongs to
one supplier, vector, order or user, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nightframes.session import dealt

STAR_SIDE = 60
MOSAIC_SIDE = 16
# Rows of a table one task turns into pixels or cards, about half a million of them.
SUPPLIERS_PER_TASK, VECTORS_PER_TASK, ORDERS_PER_TASK = 128, 8192, 32768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, per_task: int) -> DataFrame:
    """Rows over all cores, and over more tasks where one would have more than ``per_task`` rows.

    A row grows to hundreds of pixels afterwards, so a small table makes large tasks; one with
    enough splits stays as it is. The count comes from the table's footers.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // per_task))
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "supplier").select("s_suppkey"), SUPPLIERS_PER_TASK)


def _described(df: DataFrame, w: int, h: int, sample_type: str, axes: int = 2, **extra: str) -> DataFrame:
    """Add the frame descriptor; ``extra`` overrides columns by SQL expression."""
    columns = {
        "width": f"{w}",
        "height": f"{h}",
        "axes": f"{axes}",
        "planes": "1",
        "sample_type": f"'{sample_type}'",
        "bscale": "cast(1 as double)",
        "bzero": "cast(0 as double)",
        "bayerpat": "cast(null as string)",
        **extra,
    }
    return df.select("*", *[F.expr(e).alias(c) for c, e in columns.items()])


# --- integer frames without positions ----------------------------------------------


def quantity_samples(spark: SparkSession, sf_dir: str, unsigned16: bool = False) -> DataFrame:
    """Quantities of each supplier's line items as an 8-bit or unsigned-16 frame."""
    px = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey as frame_id", f"cast(l_quantity as int) - {32768 if unsigned16 else 0} as raw"
    )
    if unsigned16:
        return _described(px, 0, 0, "I16", bzero="cast(32768 as double)")
    return _described(px, 0, 0, "U8")


QUANTITY_SQL = "quantity as (select l_suppkey as frame_id, cast(l_quantity as int) as raw from lineitem)"

# --- float planes -------------------------------------------------------------------


def vector_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as an 8x8 float frame."""
    vectors = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), VECTORS_PER_TASK)
    rows = vectors.select(
        F.col("vec_id").alias("frame_id"),
        F.lit(0).alias("plane"),
        F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y"),
        "embedding",
    )
    rows = rows.select("frame_id", "plane", "y", F.slice("embedding", F.col("y") * 8 + 1, 8).cast("array<double>").alias("samples"))
    return _described(rows, 8, 8, "F32")


VECTOR_SQL = """vector as (
 select vec_id as frame_id, cast(pos // 8 as int) as y, cast(pos % 8 as int) as x, cast(e as double) as raw
 from (select vec_id, unnest(embedding) as e, generate_subscripts(embedding, 1) - 1 as pos from embeddings))"""


def cube_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three embeddings in a row as an 8x8x3 float cube; an incomplete one is no cube."""
    rows = vector_lines(spark, sf_dir).select(
        F.expr("frame_id div 3").alias("frame_id"),
        F.expr("cast(frame_id % 3 as int)").alias("plane"),
        "y",
        "samples",
    )
    counts = (
        table(spark, sf_dir, "embeddings")
        .groupBy(F.expr("vec_id div 3").alias("frame_id"))
        .agg(F.count(F.lit(1)).cast("int").alias("n"))
    )
    rows = rows.join(counts, "frame_id")
    return _described(rows, 8, 8, "F32", 3, planes="n").drop("n")


CUBE_SQL = (
    VECTOR_SQL
    + """, cube as (
 select frame_id // 3 as frame_id, cast(frame_id % 3 as int) as plane, y, x, raw,
  count(distinct frame_id % 3) over (partition by frame_id // 3) as planes from vector)"""
)

# --- star fields --------------------------------------------------------------------

_STAR = """round(1000 + (({x}*7+{y}*13)%5)
 + 5000*exp(-0.5*(power(({x}-(15+s_suppkey%30))/(1.5+(s_suppkey%3)),2)+power(({y}-(15+(s_suppkey*7)%30))/2.0,2)))
 + 3000*exp(-0.5*(power(({x}-(45-s_suppkey%30))/1.5,2)+power(({y}-(50-(s_suppkey*3)%40))/1.5,2))))"""


def star_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 60x60 unsigned-16 field with two stars per supplier.

    The formula of ``_STAR`` in doubles. A star is the product of its profiles across and along,
    which are computed once per field and line; pixels are spelled out, as a lambda over them
    would be interpreted. No level leaves 1000 to 9004. Fields repeat after 120 suppliers.
    """
    sides = range(STAR_SIDE)
    rows = _suppliers(spark, sf_dir).selectExpr(
        "s_suppkey",
        *[f"5000 * exp(-0.5D * power(({x} - (15 + s_suppkey % 30)) / (1.5D + s_suppkey % 3), 2)) as a{x}" for x in sides],
        *[f"3000 * exp(-0.5D * power(({x} - (45 - s_suppkey % 30)) / 1.5D, 2)) as b{x}" for x in sides],
    )
    rows = rows.selectExpr("*", f"explode(sequence(0, {STAR_SIDE - 1})) as y").selectExpr(
        "*",
        "exp(-0.5D * power((y - (15 + (s_suppkey * 7) % 30)) / 2.0D, 2)) as along_a",
        "exp(-0.5D * power((y - (50 - (s_suppkey * 3) % 40)) / 1.5D, 2)) as along_b",
    )
    level = "floor(1000.5D + ({x} * 7 + y * 13) % 5 + a{x} * along_a + b{x} * along_b)"
    pixels = [f"cast({level.format(x=x)} - 32768 as double)" for x in sides]
    rows = rows.selectExpr("s_suppkey as frame_id", "0 as plane", "y", f"array({', '.join(pixels)}) as samples")
    return _described(rows, STAR_SIDE, STAR_SIDE, "I16", bzero="cast(32768 as double)")


STAR_SQL = f"""star as (
 select s_suppkey as frame_id, cast(y as int) as y, cast(x as int) as x,
  greatest(least({_STAR.format(x="x", y="y")}, 65535.0), 0.0)::double as v
 from supplier cross join (select range as x from range({STAR_SIDE})) gx cross join (select range as y from range({STAR_SIDE})) gy)"""

# --- mosaics ------------------------------------------------------------------------

_PATTERN = (
    "case s_suppkey%4 when 0 then 'RGGB' when 1 then 'GBRG' when 2 then 'BGGR' else 'GRBG' end"
)
_MOSAIC = "cast(({x}*37+{y}*101+s_suppkey*7)%4096 as int)"


def mosaic_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as frame_id", f"{_PATTERN} as cfa")
    return _described(rows, MOSAIC_SIDE, MOSAIC_SIDE, "I16", bayerpat="cfa").drop("cfa")


def mosaic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 16x16 signed-16 mosaic per supplier, all four patterns."""
    rows = _suppliers(spark, sf_dir).selectExpr(
        "s_suppkey", f"{_PATTERN} as cfa", f"explode(sequence(0, {MOSAIC_SIDE - 1})) as y"
    )
    pixels = [f"cast({_MOSAIC.format(x=x, y='y')} as double)" for x in range(MOSAIC_SIDE)]
    rows = rows.selectExpr(
        "s_suppkey as frame_id",
        "0 as plane",
        "y",
        f"array({', '.join(pixels)}) as samples",
        "cfa",
    )
    return _described(rows, MOSAIC_SIDE, MOSAIC_SIDE, "I16", bayerpat="cfa").drop("cfa")


MOSAIC_SQL = f"""mosaic as (
 select s_suppkey as frame_id, cast(y as int) as y, cast(x as int) as x, {_MOSAIC.format(x="x", y="y")} as raw,
  {_PATTERN} as cfa
 from supplier cross join (select range as x from range({MOSAIC_SIDE})) gx cross join (select range as y from range({MOSAIC_SIDE})) gy)"""

# --- header cards -------------------------------------------------------------------


def _cards(string: str) -> str:
    return f"""
 select o_orderkey as frame_id, 1 as ord, 'BITPIX' as name, '16' as value from orders
 union all select o_orderkey, 2, 'NAXIS', case when o_orderkey%5=0 then '3' else '2' end from orders
 union all select o_orderkey, 3, 'NAXIS3', '3' from orders where o_orderkey%5=0
 union all select o_orderkey, 4, 'OBJECT', o_orderpriority from orders where o_orderkey%2=0
 union all select o_orderkey, 5, 'FILTER', o_orderstatus from orders where o_custkey%3<>0
 union all select o_orderkey, 6, 'EXPTIME', cast(cast(o_totalprice as decimal(18,2)) as {string}) from orders
 union all select o_orderkey, 7, 'DATE-OBS', concat(cast(cast(o_orderdate as date) as {string}),'T00:00:00') from orders where o_orderkey%11<>0
 union all select o_orderkey, 8, 'DATE-LOC', case when o_orderkey%4=0 then '   ' else concat(cast(cast(o_orderdate as date) as {string}),'T20:00:00.5') end from orders where o_orderkey%2=0
 union all select o_orderkey, 9, 'BAYERPAT', ' rggb ' from orders where o_orderkey%3=0 and o_orderkey%5<>0
 union all select o_orderkey, 10, 'HISTORY', cast(null as {string}) from orders where o_orderkey%2=1
 union all select o_orderkey, 11, 'BZERO', '32768' from orders where o_orderkey%7=0
 union all select o_orderkey, 12, 'TELESCOP', concat(' Scope ', cast(o_custkey%10 as {string})) from orders where o_orderkey%6=1
 union all select o_orderkey, 13, 'FOCALLEN', cast(cast(o_custkey%500 as double) / 2 as {string}) from orders where o_orderkey%4=1
 union all select o_orderkey, 14, 'OBJECT', 'second' from orders where o_orderkey%9=0
 union all select o_orderkey, 15, 'TFORM1', 'E' from orders where o_orderkey%13=0"""


def card_rows(spark: SparkSession, sf_dir: str, each: int = 8) -> int:
    """About how many cards the headers have; ``more_cards`` gives twice as many."""
    return each * table(spark, sf_dir, "orders").count()


def header_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of one header per order: repeated, blank, missing and valueless ones included.

    Every order row is exploded into its cards, so the table is read once.
    """
    text = "cast({} as string)".format
    day = text("cast(o_orderdate as date)")
    always = "true"
    cards = [
        (1, "BITPIX", "'16'", always),
        (2, "NAXIS", "case when o_orderkey%5=0 then '3' else '2' end", always),
        (3, "NAXIS3", "'3'", "o_orderkey%5=0"),
        (4, "OBJECT", "o_orderpriority", "o_orderkey%2=0"),
        (5, "FILTER", "o_orderstatus", "o_custkey%3<>0"),
        (6, "EXPTIME", text("cast(o_totalprice as decimal(18,2))"), always),
        (7, "DATE-OBS", f"concat({day},'T00:00:00')", "o_orderkey%11<>0"),
        (
            8,
            "DATE-LOC",
            f"case when o_orderkey%4=0 then '   ' else concat({day},'T20:00:00.5') end",
            "o_orderkey%2=0",
        ),
        (9, "BAYERPAT", "' rggb '", "o_orderkey%3=0 and o_orderkey%5<>0"),
        (10, "HISTORY", "cast(null as string)", "o_orderkey%2=1"),
        (11, "BZERO", "'32768'", "o_orderkey%7=0"),
        (12, "TELESCOP", f"concat(' Scope ', {text('o_custkey%10')})", "o_orderkey%6=1"),
        (13, "FOCALLEN", text("cast(o_custkey%500 as double) / 2"), "o_orderkey%4=1"),
        (14, "OBJECT", "'second'", "o_orderkey%9=0"),
        (15, "TFORM1", "'E'", "o_orderkey%13=0"),
    ]
    structs = [
        f"case when {condition} then named_struct('ord', {ord_}, 'name', '{name}', 'value', {value}) end"
        for ord_, name, value, condition in cards
    ]
    return (
        spread(table(spark, sf_dir, "orders"), ORDERS_PER_TASK)
        .selectExpr("o_orderkey as frame_id", f"explode(filter(array({','.join(structs)}), c -> c is not null)) as c")
        .select("frame_id", "c.*")
    )


CARDS_SQL = f"cards as ({_cards('varchar')})"

# Further cards, for every column of the catalog: number, keyword, value, which orders have it.
_MORE_CARDS = [
    (20, "NAXIS1", "cast(o_custkey % 6000 as {string})", "o_orderkey % 7 <> 0"),
    (21, "NAXIS2", "cast(o_custkey % 4000 as {string})", "true"),
    (22, "BSCALE", "'0.5'", "o_orderkey % 8 = 0"),
    (23, "OBJCTRA", "case when o_orderkey % 4 = 0 then '10 20 30.5' else cast(o_custkey % 360 as {string}) end", "o_orderkey % 3 <> 1"),
    (24, "OBJCTDEC", "concat('-', cast(o_custkey % 90 as {string}))", "o_orderkey % 3 = 0"),
    (25, "OBJCTROT", "concat(cast(o_custkey % 360 as {string}), '.25')", "o_orderkey % 5 = 1"),
    (26, "GAIN", "'1.5'", "o_orderkey % 2 = 1"),
    (27, "OFFSET", "case when o_orderkey % 6 = 0 then 'none' else cast(o_custkey % 50 as {string}) end", "true"),
    (28, "XBINNING", "'2'", "o_orderkey % 3 = 0"),
    (29, "YBINNING", "case when o_orderkey % 6 = 0 then '1' else 'x' end", "o_orderkey % 2 = 0"),
    (30, "INSTRUME", "concat('cam ', o_orderstatus)", "o_orderkey % 4 <> 2"),
    (31, "FOCRATIO", "'4.5'", "o_orderkey % 5 = 2"),
    (32, "GAIN", "'9'", "true"),
]


def more_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of header_cards and those of the other catalog columns."""
    structs = [
        f"case when {where} then named_struct('ord', {ord_}, 'name', '{name}', 'value', {value.format(string='string')}) end"
        for ord_, name, value, where in _MORE_CARDS
    ]
    more = spread(table(spark, sf_dir, "orders"), ORDERS_PER_TASK).selectExpr(
        "o_orderkey as frame_id", f"explode(filter(array({','.join(structs)}), c -> c is not null)) as c"
    )
    return header_cards(spark, sf_dir).unionByName(more.select("frame_id", "c.*"))


MORE_CARDS_SQL = "cards as (" + _cards("varchar") + "".join(
    f" union all select o_orderkey, {ord_}, '{name}', {value.format(string='varchar')} from orders where {where}"
    for ord_, name, value, where in _MORE_CARDS
) + ")"
PAIRS_SQL = "pairs as (select o_orderkey as source_id, o_orderkey + 1 as target_id from orders where o_orderkey + 1 in (select o_orderkey from orders))"


def header_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's header as the source for the next one's."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    pairs = orders.selectExpr("o_orderkey as source_id", "o_orderkey + 1 as target_id")
    return pairs.join(orders.selectExpr("o_orderkey as target_id"), "target_id", "left_semi").select(
        "source_id", "target_id"
    )


# --- sessions -----------------------------------------------------------------------


def epoch(ts: str) -> str:
    """Epoch seconds of a zone-free timestamp as a double."""
    return (
        f"((unix_date(cast({ts} as date)) * 86400L + hour({ts}) * 3600 + minute({ts}) * 60) * 1000000L"
        f" + cast(extract(second from {ts}) * 1000000 as bigint)) / 1000000D"
    )


def session_frames(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """A frame per user and day of events, with metrics, stamp and analysis status.

    With ``in_order`` the mean's sum is taken in event order, so its last digits do not depend
    on how the table is split.
    """
    events = table(spark, sf_dir, "events")
    columns = "event_id", "user_id", "ts", "value", "cast(ts as date) as day"
    rows = dealt(events.selectExpr(*columns), ["user_id", "day"], events.count())
    mean = F.avg("value")
    if in_order:
        so_far = Window.partitionBy("user_id", "day").orderBy("event_id", "value")
        so_far = so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("running", F.sum("value").over(so_far))
        mean = F.max_by("running", F.struct("event_id", "value")) / F.count("value")
    rows = rows.groupBy("user_id", "day").agg(
        F.min("ts").alias("ts"),
        F.count(F.lit(1)).alias("length"),
        F.max("event_id").alias("stamp"),
        mean.alias("mean"),
        F.max("value").alias("max"),
    )
    return rows.selectExpr(
        "concat('u', cast(user_id as string), '/', cast(day as string)) as path",
        "user_id as session_id",
        "ts",
        "day",
        f"{epoch('ts')} as time",
        "concat(cast(day as string), 'T', lpad(cast(hour(ts) as string), 2, '0'), ':', lpad(cast(minute(ts) as string), 2, '0'), ':',"
        " lpad(cast(cast(floor(extract(second from ts)) as int) as string), 2, '0')) as time_str",
        "length",
        "stamp",
        "mean",
        "max",
        "user_id % 2 = 0 as stars_measured",
        "case when user_id % 2 = 0 then length - 1 end as star_count",
        "case when user_id % 2 = 0 and length > 1 then mean / 10 end as hfr",
        "case when user_id % 11 = 0 then 'skipped_no_date' when length % 5 = 0 then 'error' else 'analyzed' end as status",
    )


SESSION_SQL = """day_frames as (
 select user_id, cast(ts as date) as day, min(ts) as ts, count(*) as length, max(event_id) as stamp, avg(value) as mean, max(value) as max
 from events group by user_id, cast(ts as date)),
session as (
 select concat('u', cast(user_id as varchar), '/', cast(day as varchar)) as path, user_id as session_id, ts, day,
  epoch_us(ts) / 1e6 as time, strftime(ts, '%Y-%m-%dT%H:%M:%S') as time_str, length, stamp, mean, max,
  user_id % 2 = 0 as stars_measured,
  case when user_id % 2 = 0 then length - 1 end as star_count,
  case when user_id % 2 = 0 and length > 1 then mean / 10 end as hfr,
  case when user_id % 11 = 0 then 'skipped_no_date' when length % 5 = 0 then 'error' else 'analyzed' end as status
 from day_frames)"""


def session_cache(frames: DataFrame) -> DataFrame:
    """Kept results: first half of each month, without errors, some stamps out of date."""
    return frames.filter("dayofmonth(day) <= 15 and status <> 'error'").withColumn(
        "stamp", F.expr("case when session_id % 7 = 0 then stamp + 1 else stamp end")
    )


CACHE_SQL = """cache as (
 select * replace (case when session_id % 7 = 0 then stamp + 1 else stamp end as stamp)
 from session where day(day) <= 15 and status <> 'error')"""

SERIES_SQL = """long as (
 select session_id, m.metric, time, time_str, m.value, path from (
  select *, unnest([{'metric': 'max', 'value': max}, {'metric': 'mean', 'value': mean},
   {'metric': 'star_count', 'value': case when stars_measured then cast(coalesce(star_count, 0) as double) end},
   {'metric': 'hfr', 'value': case when stars_measured then hfr end}]) as m from session where status = 'analyzed')),
series as (select * from long where value is not null)"""
