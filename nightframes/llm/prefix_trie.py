"""Trie of the turns that conversations begin with, built by peeling truncated conversations.

Peeling goes from the greatest depth to the root. At each depth the conversations that end
there join the nodes that survived from below, equal prefixes merge into one node, its sums
are complete and written, and what is left of it, one turn shorter, survives to the next
depth. A node is found and its subtree summed up in the same grouping, which combines on
the map side, so a prefix that a third of all conversations share is one row per task.

Turns that no other conversation shares need no grouping: they are peeled off first, all at
once, and a conversation enters the loop at its deepest shared turn. The number of rounds is
the depth of the deepest shared prefix, not of the longest conversation.

Texts are never shuffled. A prefix is named by a chain of SHA-256 digests over its turns, of
which 128 bits are kept.
"""

from __future__ import annotations

import hashlib
import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightframes.llm.tables import shared_dir, staged

ROOT = b""
# Fixed values of the rebuilding rule: conversations are lent turns by the one whose id is
# the multiple of LENDERS below, and at most LONGEST of them.
LENDERS = 5
LONGEST = 8
STEP = "conv_id bigint, depth bigint, key binary, parent binary, bytes bigint, last boolean"
_STEP_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()),
        ("bytes", pa.int64()), ("last", pa.bool_()),
    ]
)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def crc32_of(value: Column) -> Column:
    return F.crc32(value.cast("string").cast("binary"))


def step_rows(batches):
    """The prefixes of each conversation, one row per depth, from turns in order.

    Of what lies between two batches only the last turn and the few turns that may still be
    lent are carried, so a conversation may be as long as it likes.
    """
    group = conv = held = None
    lent: list[tuple[bytes, int]] = []
    key, depth, position, borrowed = ROOT, 0, 0, 0
    out: list[tuple] = []

    def step(digest: bytes, size: int):
        nonlocal key, depth, held
        parent, key, depth = key, hashlib.sha256(key + digest).digest()[:16], depth + 1
        out.append((*held, False))
        held = (conv, depth, key, parent, size)

    def flush():
        columns = list(zip(*out)) if out else [[]] * 6
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _STEP_ARROW)], schema=_STEP_ARROW)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("lender", "conv_id", "borrows", "digest", "bytes"))
        for lender, own, borrows, digest, size in zip(*columns):
            if own != conv:
                if held is not None:
                    out.append((*held, True))
                if lender != group:
                    group, lent = lender, []
                conv, key, depth, position = own, ROOT, 0, 0
                held = (conv, 0, ROOT, None, 0)
                borrowed = 0 if own == lender else borrows
                for turn in lent[:borrowed]:
                    step(*turn)
            if own == lender and position < LONGEST:
                lent.append((digest, size))
            if position >= borrowed:
                step(digest, size)
            position += 1
        yield flush()
    if held is not None:
        out.append((*held, True))
        yield flush()


def prefixes(conversations: DataFrame, rebuilt: bool = False) -> DataFrame:
    """conv_id, depth, key, parent, bytes (of the last text), last, for every prefix of every conversation.

    With ``rebuilt`` the first h turns of a conversation are replaced by those of its lender,
    where h is the CRC-32 of its id modulo LONGEST + 1.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("bigint")
    turns = conversations.select(
        conv.alias("conv_id"),
        (conv - conv % LENDERS if rebuilt else conv).alias("lender"),
        (crc32_of(conv) % (LONGEST + 1) if rebuilt else F.lit(0).cast("bigint")).alias("borrows"),
        F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    ).filter("conv_id is not null")
    dealt = turns.repartition("lender").sortWithinPartitions(
        "lender", F.abs(F.col("conv_id") - F.col("lender")), "conv_id", F.col("turn").asc_nulls_first(), "role", "digest"
    )
    return dealt.select("lender", "conv_id", "borrows", "digest", "bytes").mapInArrow(step_rows, STEP)


def ends_rows(batches):
    """SHA-256 over the ids that end at each node, from rows in order; an id at a time is held."""
    key, running = None, None
    for batch in batches:
        done = []
        for own, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if own != key:
                if running is not None:
                    done.append((key, running.hexdigest()))
                key, running = own, hashlib.sha256(b"%d" % conv)
            else:
                running.update(b",%d" % conv)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["key", "ends_sha256"])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([running.hexdigest()])], ["key", "ends_sha256"])


def peel(entering: DataFrame, folder: str) -> None:
    """Write the nodes of every depth below ``folder``, from the deepest to the root.

    ``entering`` holds, by ``depth``, the conversations whose deepest shared turn it is:
    conv_id, tail (whether turns of their own follow), path (key and bytes of each depth).
    """
    spark = entering.sparkSession
    deepest = entering.agg(F.max("depth")).first()[0]
    if deepest is None:
        return
    survivors = None
    for depth in range(deepest, -1, -1):
        tail = F.col("tail").cast("bigint")
        frontier = entering.filter(F.col("depth") == depth).select(
            "path", "conv_id", F.lit(1).cast("bigint").alias("n"), tail.alias("children"), tail.alias("leaves"),
            F.lit(0).cast("bigint").alias("saved"),
        )
        if survivors is not None:
            frontier = frontier.unionByName(survivors)
        top = F.try_element_at("path", F.lit(depth)) if depth else F.lit(None).cast("struct<key:binary,bytes:bigint>")
        merged = frontier.groupBy((top["key"] if depth else F.lit(ROOT)).alias("key")).agg(
            F.first("path").alias("path"),
            F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
        )
        parent = F.try_element_at("path", F.lit(depth - 1))["key"] if depth > 1 else F.lit(ROOT if depth else None)
        nodes = merged.select(
            "key", "path", "conv_id", "n", "children", parent.cast("binary").alias("parent"),
            F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).alias("leaves"),
            (F.col("saved") + (F.col("n") - 1) * F.coalesce(top["bytes"], F.lit(0))).alias("saved"),
        )
        nodes.write.parquet(f"{folder}/depth={depth}")
        if depth:
            read = spark.read.schema(nodes.schema).parquet(f"{folder}/depth={depth}")
            survivors = read.select(
                F.slice("path", 1, depth - 1).alias("path"), "conv_id", "n",
                F.lit(1).cast("bigint").alias("children"), "leaves", "saved",
            )


def prefix_trie(conversations: DataFrame, rebuilt: bool = False) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key.

    A node is a distinct sequence of the first ``depth`` turns (role and text, null is
    empty) of some conversation; the root has none. conv_id is its smallest member,
    n_leaves counts the childless nodes of its subtree, itself included, and saved_tokens
    sums there, for each node, the bytes of its last text times its members but one.
    ends_sha256 is the SHA-256 of the comma-joined ascending ids of the members that end at
    the node. Turns are taken in ascending order with null first; of one turn's rows, also
    repeated ones, by role and then the digest of the text. Texts of any length are hashed
    where they are. Rows without conv_id belong to no conversation and are left out; an
    empty table has no root. Other columns are ignored.
    """
    spark = conversations.sparkSession
    steps = staged(prefixes(conversations, rebuilt), "prefixes")
    # prefixes that only one conversation has
    counted = steps.filter("depth > 0").groupBy("key").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        F.min("parent").alias("parent"), F.max("last").alias("last"),
    )
    alone = staged(counted.filter("n = 1").drop("n"), "alone")
    tails = alone.groupBy("conv_id").agg((F.min("depth") - 1).alias("shared"))
    rows = steps.join(tails, "conv_id", "left").filter("depth <= coalesce(shared, depth)")
    path = F.collect_list(F.when(F.col("depth") > 0, F.struct("depth", "key", "bytes")))
    entering = rows.groupBy("conv_id").agg(
        F.max("depth").alias("depth"), F.max("shared").isNotNull().alias("tail"),
        F.transform(F.array_sort(path), lambda t: F.struct(t["key"].alias("key"), t["bytes"].alias("bytes"))).alias("path"),
    )
    base = os.path.join(shared_dir(spark), "staged", f"trie-{uuid.uuid4().hex}")
    entering.write.partitionBy("depth").parquet(f"{base}/entering")
    entering = spark.read.schema(entering.schema).parquet(f"{base}/entering")
    peel(entering, f"{base}/nodes")
    ended = entering.filter(~F.col("tail")).select(
        F.coalesce(F.try_element_at("path", F.lit(-1))["key"], F.lit(ROOT)).alias("key"), "conv_id"
    )
    ends = ended.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(ends_rows, "key binary, ends_sha256 string")
    node = (
        "key binary, path array<struct<key:binary,bytes:bigint>>, conv_id bigint, n bigint, children bigint,"
        " parent binary, leaves bigint, saved bigint, depth bigint"
    )
    empty = entering.limit(1).count() == 0
    shared = spark.createDataFrame([], node) if empty else spark.read.schema(node).parquet(f"{base}/nodes")
    none = F.lit(0).cast("bigint")
    own = F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(NO_ENDS)
    nodes = (
        shared.join(ends, "key", "left")
        .select(
            "key", "parent", "conv_id", "depth", "n", "children", "leaves", "saved",
            F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
        .unionByName(
            alone.select(
                "key", "parent", "conv_id", "depth", F.lit(1).cast("bigint").alias("n"),
                F.when(F.col("last"), 0).otherwise(1).cast("bigint").alias("children"),
                F.lit(1).cast("bigint").alias("leaves"), none.alias("saved"), own.alias("ends_sha256"),
            )
        )
    )
    # the root is everybody's parent at depth 1, so it is not looked up
    first = shared.filter("depth = 0").first()
    root = F.lit(first["conv_id"] if first else None).cast("bigint")
    parents = shared.filter("depth > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    high = nodes.filter("depth < 2").withColumn("parent_conv_id", F.when(F.col("depth") == 1, root))
    deep = nodes.filter("depth > 1").join(parents, "parent", "left")
    deep = deep.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id"))
    return high.unionByName(deep).select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256", "key",
    )
