"""Header cards: carry-over, fill-in, scaling and provenance.

Cards are rows ``frame_id, ord, name, value`` (value NULL for commentary); other columns
are passed through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightframes.operators.planes import CFA_KEYWORDS
from nightframes.session import dealt

# Keywords that describe the pixel layout and are never carried over.
RESERVED = (
    "SIMPLE BITPIX NAXIS EXTEND XTENSION PCOUNT GCOUNT BSCALE BZERO BLANK DATAMIN DATAMAX "
    "CHECKSUM DATASUM TFIELDS THEAP EXTNAME ZIMAGE ZCMPTYPE ZBITPIX ZNAXIS ZQUANTIZ ZDITHER0 "
    "ZBLANK ZMASKCMP ZSIMPLE ZEXTEND ZTENSION ZPCOUNT ZGCOUNT ZHECKSUM ZDATASUM END CONTINUE"
).split()
# Families that are reserved when a number follows.
RESERVED_FAMILIES = (
    "NAXIS TFORM TTYPE TUNIT TSCAL TZERO TNULL TDIM TDISP ZNAXIS ZTILE ZNAME ZVAL"
).split()
SCALING_KEYWORDS = ("BSCALE", "BZERO", "BLANK")


def is_reserved(name: Column) -> Column:
    families = "^(" + "|".join(RESERVED_FAMILIES) + ")[0-9]+$"
    return name.isin(*RESERVED) | name.rlike(families)


def is_droppable(name: Column, drop: Sequence[str] = ()) -> Column:
    dropped = F.upper(name).isin(*[d.upper() for d in drop]) if drop else F.lit(False)
    return is_reserved(name) | dropped


def carried_metadata(cards: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """The cards an output frame takes over from its source."""
    return cards.filter(~is_droppable(F.col("name"), drop))


def scaling_cards(cards: DataFrame) -> DataFrame:
    """The first BSCALE, BZERO and BLANK card of every frame."""
    first = F.row_number().over(Window.partitionBy("frame_id", "name").orderBy("ord"))
    return (
        cards.filter(F.col("name").isin(*SCALING_KEYWORDS))
        .withColumn("_first", first)
        .filter("_first = 1")
        .drop("_first")
    )


def carried_with_scaling(cards: DataFrame) -> DataFrame:
    """Metadata plus scaling, for copies that keep the raw samples."""
    return carried_metadata(cards).unionByName(scaling_cards(cards))


def add_history(cards: DataFrame, text: str) -> DataFrame:
    """Append a HISTORY card behind the last card of every frame."""
    history = cards.groupBy("frame_id").agg((F.max("ord") + 1).alias("ord"))
    card = history.select(
        "frame_id",
        "ord",
        F.lit("HISTORY").alias("name"),
        F.lit(None).cast("string").alias("value"),
        F.lit(text).alias("comment"),
    )
    return cards.unionByName(card, allowMissingColumns=True)


def output_cards(cards: DataFrame, bscale: float, bzero: float, drop: Sequence[str] = ()) -> DataFrame:
    """Cards of a written frame: BZERO and BSCALE unless 0 and 1, then carried metadata."""
    carried = carried_metadata(cards, drop)
    if bscale == 1.0 and bzero == 0.0:
        return carried
    scaling = F.explode(
        F.array(
            F.struct(F.lit(-1).alias("ord"), F.lit("BZERO").alias("name"), F.lit(str(bzero)).alias("value")),
            F.struct(F.lit(0).alias("ord"), F.lit("BSCALE").alias("name"), F.lit(str(bscale)).alias("value")),
        )
    )
    added = cards.select("frame_id").distinct().select("frame_id", scaling.alias("c"))
    return carried.unionByName(added.select("frame_id", "c.*"), allowMissingColumns=True)


def cube_targets(cards: DataFrame) -> DataFrame:
    """Frames whose header says NAXIS = 3 and NAXIS3 = 3."""
    number = F.col("value").try_cast("bigint")
    return (
        cards.filter(F.col("name").isin("NAXIS", "NAXIS3"))
        .groupBy("frame_id")
        .agg(
            F.min_by(F.when(F.col("name") == "NAXIS", number), F.when(F.col("name") == "NAXIS", F.col("ord"))).alias("naxis"),
            F.min_by(F.when(F.col("name") == "NAXIS3", number), F.when(F.col("name") == "NAXIS3", F.col("ord"))).alias("naxis3"),
        )
        .filter("naxis = 3 and naxis3 = 3")
        .select("frame_id")
    )


def missing_cards(cards: DataFrame, pairs: DataFrame, rows: int | None = None) -> DataFrame:
    """Cards each target takes over from its source, as ``source_id, frame_id, ord, …``.

    ``pairs`` holds ``source_id, target_id``. Reserved cards stay behind, as do CFA cards when
    the target is a cube; a name the target has is kept; of a name repeated in the source
    only the first valued card is new to the target; commentary is always taken. ``rows`` says
    about how many cards both sides of all pairs have, so that tasks follow their number.
    """
    key, name = ["source_id", "frame_id", "name"], F.col("name")
    cubes = cube_targets(cards).withColumn("_cube", F.lit(True))
    routed = pairs.withColumnRenamed("target_id", "frame_id")
    offered = (
        cards.filter(~is_reserved(name))
        .withColumnRenamed("frame_id", "source_id")
        .join(routed.join(cubes, "frame_id", "left"), "source_id")
        .filter(~name.isin(*CFA_KEYWORDS) | F.col("_cube").isNull())
    )
    fields = [c for c in cards.columns if c not in ("frame_id", "name")]
    card = F.struct(*fields)
    offered = offered.select(*key, F.lit(False).alias("_has"), card.alias("_card"))
    held = cards.select("frame_id", "name").join(routed, "frame_id")
    held = held.select(*key, F.lit(True).alias("_has"), F.lit(None).cast(offered.schema["_card"].dataType).alias("_card"))
    # One grouping tells what the target has, the first valued card and all commentary.
    order, valued = F.col("_card.ord"), F.col("_card.value").isNotNull()
    said = ~valued & F.col("_card").isNotNull()
    both = offered.unionByName(held)
    both = both if rows is None else dealt(both, ["source_id", "frame_id"], rows)
    merged = both.groupBy(*key).agg(
        F.max("_has").alias("_has"),
        F.min_by("_card", F.when(valued, order)).alias("_first"),
        F.min(F.when(said, order)).alias("_said"),
        F.collect_list(F.when(said, F.col("_card"))).alias("_commentary"),
    )
    # A commentary card of the same name further up already gives the target that name.
    new = ~F.col("_has") & F.col("_first").isNotNull() & (F.col("_said").isNull() | (F.col("_first.ord") < F.col("_said")))
    taken = F.concat("_commentary", F.when(new, F.array("_first")).otherwise(F.slice("_commentary", 1, 0)))
    return merged.select(*key, F.explode(taken).alias("_card")).select(*key, "_card.*")


def copy_header(cards: DataFrame, pairs: DataFrame, rows: int | None = None) -> DataFrame:
    """The targets' cards with what they lacked behind them, in source order.

    A target may have several sources in ``pairs``; each pair is merged on its own, keyed by
    ``source_id, frame_id``; ``rows`` as in ``missing_cards``.
    """
    targets = cards.join(pairs.withColumnRenamed("target_id", "frame_id"), "frame_id")
    last = targets.groupBy("source_id", "frame_id").agg(F.max("ord").alias("_last"))
    added = (
        missing_cards(cards, pairs, rows)
        .join(last, ["source_id", "frame_id"])
        .withColumn("ord", F.col("ord") + F.col("_last"))
        .drop("_last")
    )
    return targets.withColumn("copied", F.lit(False)).unionByName(
        added.withColumn("copied", F.lit(True))
    )


def copied_counts(cards: DataFrame, pairs: DataFrame, rows: int | None = None) -> DataFrame:
    """Number of cards copied per pair, zero included; ``rows`` as in ``missing_cards``."""
    added = missing_cards(cards, pairs, rows).groupBy("source_id", "frame_id").agg(
        F.count(F.lit(1)).alias("copied")
    )
    return (
        pairs.withColumnRenamed("target_id", "frame_id")
        .join(added, ["source_id", "frame_id"], "left")
        .withColumn("copied", F.coalesce("copied", F.lit(0).cast("bigint")))
    )
