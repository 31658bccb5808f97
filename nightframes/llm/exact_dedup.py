"""Exact dedup of documents against a perfect-hash index of historical digests.

The history's distinct digests are dealt to shards; each shard is a minimal perfect hash
whose slots hold the full digest, the row that stays and the number of rows. Arriving rows
are first brought down to one row per digest, map-side; each is looked up in its shard and
accepted only if all 32 bytes agree. Digests the history does not have form groups of their
own. Only digests and numbers are shuffled, never texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightframes.llm.buffers import mix
from nightframes.llm.perfect_hash import PerfectHash
from nightframes.llm.tables import NO_ID, binary_column, identified, staged, unpacked

BLANKS = " \t\n\x0b\x0c\r"
# Distinct digests in one shard of the index: about 14 MB with its slots.
SHARD_DIGESTS = 200_000
ENTRY = "digest binary, chars bigint, id bigint, row bigint, size bigint"


def digest(text: Column) -> Column:
    """SHA-256 of the text without blanks; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANKS, ""), 256))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, id, row, digest, chars: what decides, without the text. Staged, so ``row`` is fixed."""
    rows = identified(docs).select(
        "doc_id",
        "id",
        F.monotonically_increasing_id().alias("row"),
        digest(F.col("text")).alias("digest"),
        F.char_length("text").cast("bigint").alias("chars"),
    )
    return staged(rows, "keyed")


def groups(rows: DataFrame) -> DataFrame:
    """One row per digest: the row with most characters, then least id, then first row; its group's size."""
    best = F.max(F.struct("chars", (-F.col("id")).alias("low"), (-F.col("row")).alias("first"))).alias("best")
    found = rows.groupBy("digest").agg(best, F.count("*").alias("size"))
    return found.select(
        "digest", F.col("best.chars").alias("chars"), (-F.col("best.low")).alias("id"),
        (-F.col("best.first")).alias("row"), "size",
    )


def folded(digests: np.ndarray, seed: int) -> np.ndarray:
    """64-bit keys of 32-byte digests; ``seed`` is changed until those of a shard differ."""
    parts = digests.reshape(-1, 4)
    out = np.full(len(parts), seed, np.uint64)
    for i in range(4):
        out = mix(out + parts[:, i])
    return out


def build_shard(group: pa.Table) -> pa.Table:
    digests, _ = unpacked(group.column("digest"), np.uint64)
    seed, keys = 1, folded(digests, 1)
    while len(np.unique(keys)) < len(keys):
        seed += 1
        keys = folded(digests, seed)
    index = PerfectHash.build(keys)
    order = np.argsort(index.slots(keys))
    columns = {
        "digests": digests.reshape(-1, 4)[order].reshape(-1),
        **{c: np.asarray(group.column(c), np.int64)[order] for c in ("chars", "id", "row", "size")},
    }
    packed = {c: binary_column(v, np.array([len(v)])) for c, v in columns.items()}
    head = {"shard": group.column("shard").slice(0, 1).combine_chunks(), "seed": pa.array([seed], pa.int64())}
    return pa.table({**head, "slots": pa.array([index.to_bytes()], pa.binary()), **packed})


def shards_of(history: DataFrame, arriving: DataFrame) -> int:
    """Shards so that neither side has more digests in one than about SHARD_DIGESTS."""
    n = max(side.agg(F.approx_count_distinct("digest")).first()[0] for side in (history, arriving))
    return max(1, -(-n // SHARD_DIGESTS))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index of keyed rows: one row per shard that has any, staged. ``history`` may be empty."""
    dealt = groups(history).withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    return staged(
        dealt.groupBy("shard").applyInArrow(
            build_shard,
            "shard bigint, seed bigint, slots binary, digests binary, chars binary, id binary, row binary, size binary",
        ),
        "digest-index",
    )


def looked_up(shard: pa.Table, arriving: pa.Table) -> pa.Table:
    """Merge a shard of the index with the arriving digests that fall to it."""
    names = ("chars", "id", "row", "size")
    mine = unpacked(arriving.column("digest"), np.uint64)[0].reshape(-1, 4)
    new = {c: np.asarray(arriving.column(c), np.int64) for c in names}
    if not shard.num_rows:
        old_digests, old = np.zeros((0, 4), np.uint64), {c: np.zeros(0, np.int64) for c in names}
        found = np.full(len(mine), -1)
    else:
        old_digests = unpacked(shard.column("digests"), np.uint64)[0].reshape(-1, 4)
        old = {c: unpacked(shard.column(c), np.int64)[0].copy() for c in names}
        index = PerfectHash.from_bytes(shard.column("slots")[0].as_py())
        found = index.slots(folded(mine.reshape(-1), shard.column("seed")[0].as_py()))
        there = found >= 0
        there[there] = (old_digests[found[there]] == mine[there]).all(axis=1)
        found[~there] = -1
    hit = np.flatnonzero(found >= 0)
    at = found[hit]
    rank = [(new[c][hit], old[c][at]) for c in ("chars", "id", "row")]
    better = (rank[0][0] > rank[0][1]) | (
        (rank[0][0] == rank[0][1])
        & ((rank[1][0] < rank[1][1]) | ((rank[1][0] == rank[1][1]) & (rank[2][0] < rank[2][1])))
    )
    for c in ("chars", "id", "row"):
        old[c][at[better]] = new[c][hit[better]]
    old["size"][at] += new["size"][hit]
    rest = np.flatnonzero(found < 0)
    digests = np.concatenate([old_digests, mine[rest]])
    return pa.table(
        {
            "digest": binary_column(digests.reshape(-1), np.full(len(digests), 4)),
            **{c: pa.array(np.concatenate([old[c], new[c][rest]])) for c in names},
        }
    )


def look_up(index: DataFrame, arriving: DataFrame, shards: int) -> DataFrame:
    """One row per digest of history and arrivals: digest, chars, id, row, size."""
    dealt = groups(arriving).withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    return index.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(looked_up, ENTRY)


def decide(rows: DataFrame) -> DataFrame:
    """Winner and size of each digest among keyed rows: the rows up to the median id are the history."""
    split = rows.agg(F.percentile_approx("id", 0.5)).first()[0]
    split = 0 if split is None else split
    history, arriving = rows.filter(F.col("id") <= split), rows.filter(F.col("id") > split)
    shards = shards_of(history, arriving)
    return staged(look_up(build_index(history, shards), arriving, shards), "decided")


def mark_duplicates(docs: DataFrame) -> DataFrame:
    """For every row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are without blanks (space, 9 to 13). Of equal texts the row with
    most characters as it came stays, then the smallest doc_id (null comes last, and is then
    the keep_id), then any one of rows that are equal in both. Null text counts as empty, and
    all empty texts are one group. An empty table gives none; other columns are ignored.
    """
    rows = keyed(docs)
    winners = decide(rows).select("digest", F.col("id").alias("keep"), F.col("row").alias("keep_row"), "size")
    # both sides are ENSURE_REQUIREMENTS exchanges, so a digest with very many rows is split
    found = rows.join(winners.hint("merge"), "digest")
    return found.select(
        "doc_id",
        F.nullif("keep", F.lit(NO_ID)).alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rules as in mark_duplicates."""
    winners = decide(keyed(docs)).select(F.col("id").alias("__nf_id"), F.col("digest").alias("__nf_digest"))
    marked = docs.withColumns(
        {"__nf_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)), "__nf_digest": digest(F.col("text"))}
    )
    marked = marked.withColumn("__nf_chars", -F.char_length(F.coalesce("text", F.lit(""))))
    stays = marked.join(winners.hint("shuffle_hash"), ["__nf_id", "__nf_digest"], "left_semi")
    once = Window.partitionBy("__nf_id", "__nf_digest").orderBy("__nf_chars")
    return stays.withColumn("__nf_nth", F.row_number().over(once)).filter("__nf_nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
