"""Exact top-k search by BM25 over sharded inverted indexes with block-max bounds.

A shard holds some thousand documents in order of length: sorted term hashes, and for each
its postings. Queries come in blocks of bounded size. For a block, document frequencies are
summed over all shards, so every shard scores with the same global statistics. In a shard,
the postings of rare terms are added up; frequent terms are first bounded by their largest
contribution in each block of documents, and a block is scored only if its bound reaches the
query's k-th best score so far. The best of all shards are merged; no bound ever cuts a
document that belongs to the result.

This is not block-max WAND: there are no document cursors and no pivots, and no posting of a
rare term is skipped. Whole blocks are dropped by bounds, the rest is a matrix product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframes.llm.buffers import flat, ranges, slices, word_hashes, words
from nightframes.llm.repeats import lengths, runs
from nightframes.llm.tables import binary_column, staged, unpacked

K1, B = 1.2, 0.75
SHARD_BYTES = 12 << 20
# Documents in a block with a bound of its own.
BLOCK = 32
# A term in more than one of so many documents of a shard is frequent there.
FREQUENT = 16
# Terms of the queries that are handled together.
QUERY_TERMS = 800_000
# Queries whose partial results travel as one row.
GROUP = 128
DIGITS = 6
INDEX = "docs binary, sizes binary, terms binary, counts binary, posting binary, tf binary"


def term_pairs(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and document of every word, A-Z in lower case, and the words of each document."""
    data, bounds = flat(part.column("text"))
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, first = words(low, bounds)
    size = np.diff(first)
    return word_hashes(low, starts, ends), np.repeat(np.arange(len(size)), size), size


def index_rows(batches):
    def flush(held):
        hashes, docs, size, ids = [], [], [], []
        base = 0
        for h, d, s, i in held:
            hashes.append(h)
            docs.append(d + base)
            size.append(s)
            ids.append(i)
            base += len(s)
        h, d, size, ids = np.concatenate(hashes), np.concatenate(docs), np.concatenate(size), np.concatenate(ids)
        by_size = np.argsort(size, kind="stable")
        place = np.empty(len(size), np.int64)
        place[by_size] = np.arange(len(size))
        d = place[d]
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        each = runs(h, d)
        tf = lengths(each, len(h))
        h, d = h[each], d[each]
        term = runs(h)
        values = (ids[by_size], size[by_size], h[term], lengths(term, len(h)), d, tf)
        kinds = (np.int64, np.uint32, np.uint64, np.uint32, np.uint32, np.uint32)
        columns = [binary_column(v.astype(k), np.array([len(v)])) for v, k in zip(values, kinds)]
        return pa.RecordBatch.from_arrays(columns, ["docs", "sizes", "terms", "counts", "posting", "tf"])

    held, n = [], 0
    for batch in batches:
        for part in slices(batch):
            h, d, size = term_pairs(part)
            held.append((h, d, size, np.asarray(part.column("doc_id"), np.int64)))
            n += part.column("text").nbytes
            if n > SHARD_BYTES:
                yield flush(held)
                held, n = [], 0
    if held:
        yield flush(held)


def build_index(docs: DataFrame) -> DataFrame:
    """One row per shard, staged. Rows without doc_id cannot be found and are left out."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return staged(rows.filter("doc_id is not null").mapInArrow(index_rows, INDEX), "search-index", "zstd")


def query_rows(batches):
    for batch in batches:
        for part in slices(batch):
            h, d, _ = term_pairs(part)
            order = np.lexsort((h, d))
            h, d = h[order], d[order]
            once = runs(d, h)
            counts = np.bincount(d[once], minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), binary_column(h[once], counts), pa.array(counts)], ["query_id", "terms", "n"])


def frequencies(vocabulary):
    """Documents of the task's shards that have each term, in pieces."""

    def count(batches):
        wanted = vocabulary.value
        met = np.zeros(len(wanted), np.uint32)
        for batch in batches:
            for i in range(batch.num_rows):
                terms, _ = unpacked(batch.column("terms").slice(i, 1), np.uint64)
                counts, _ = unpacked(batch.column("counts").slice(i, 1), np.uint32)
                at = np.minimum(np.searchsorted(terms, wanted), max(len(terms) - 1, 0))
                if len(terms):
                    hit = terms[at] == wanted
                    met[hit] += counts[at[hit]]
        pieces = np.array_split(met, max(1, len(met) // 8192))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(pieces))), pa.array([p.tobytes() for p in pieces], pa.binary())], ["piece", "counts"]
        )

    return count


def added(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.uint32).astype(np.int64) for x in group.column("counts"))
    return pa.table({"piece": group.column("piece").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by rounded score, then id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


class Shard:
    """The part of a shard's index that a block of queries needs."""

    def __init__(self, row: pa.RecordBatch, wanted: np.ndarray, average: float):
        self.ids, size, terms, counts, posting, tf = (
            unpacked(row.column(c), t)[0]
            for c, t in zip(("docs", "sizes", "terms", "counts", "posting", "tf"), (np.int64, np.uint32, np.uint64, *[np.uint32] * 3))
        )
        self.n = len(self.ids)
        begin = np.cumsum(counts, dtype=np.int64) - counts
        at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1) if len(terms) else np.zeros(len(wanted), np.int64)
        here = terms[at] == wanted if len(terms) else np.zeros(len(wanted), bool)
        self.count = np.where(here, counts[at] if len(terms) else 0, 0).astype(np.int64)
        self.begin = np.where(here, begin[at] if len(terms) else 0, 0)
        self.posting = posting.astype(np.int64)
        weight = K1 * (1 - B + B * size / average)
        self.impact = tf * (K1 + 1) / (tf + weight[self.posting])
        # frequent terms as rows over all documents, and their maxima over blocks
        self.frequent = np.flatnonzero(self.count * FREQUENT > self.n)
        self.row = np.full(len(wanted), -1)
        self.row[self.frequent] = np.arange(len(self.frequent))
        self.blocks = -(-self.n // BLOCK)
        self.dense = np.zeros((len(self.frequent), self.blocks * BLOCK))
        which, step = ranges(self.count[self.frequent])
        place = self.begin[self.frequent][which] + step
        self.dense[which, self.posting[place]] = self.impact[place]
        self.maxima = self.dense.reshape(len(self.frequent), self.blocks, BLOCK).max(axis=2)

    def rare(self, terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
        which, step = ranges(self.count[terms])
        place = self.begin[terms][which] + step
        return np.bincount(self.posting[place], weights=idf[terms][which] * self.impact[place], minlength=self.blocks * BLOCK)


def search_rows(block, k: int):
    def search(batches):
        queries, wanted, idf, average = block.value
        top = [(np.zeros(0, np.int64), np.zeros(0)) for _ in queries]
        for batch in batches:
            for i in range(batch.num_rows):
                scan(Shard(batch.slice(i, 1), wanted, average), queries, idf, top, k)
        for lo in range(0, len(queries), GROUP):
            part = top[lo : lo + GROUP]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lo // GROUP]),
                    pa.array([np.array([len(x[0]) for x in part], np.int64).tobytes()], pa.binary()),
                    pa.array([np.concatenate([x[0] for x in part]).tobytes()], pa.binary()),
                    pa.array([np.concatenate([x[1] for x in part]).tobytes()], pa.binary()),
                ],
                ["group", "counts", "ids", "scores"],
            )

    return search


def scan(shard: Shard, queries, idf, top, k: int) -> None:
    """Merge what a shard has into the queries' best so far."""
    for lo in range(0, len(queries), GROUP):
        part = queries[lo : lo + GROUP]
        weights = np.zeros((len(part), len(shard.frequent)))
        for j, terms in enumerate(part):
            row = shard.row[terms]
            weights[j, row[row >= 0]] = idf[terms[row >= 0]]
        bounds = weights @ shard.maxima
        rare = np.stack([shard.rare(terms[shard.row[terms] < 0], idf) for terms in part])
        bounds += rare.reshape(len(part), shard.blocks, BLOCK).max(axis=2)
        least = np.array([top[lo + j][1].min() if len(top[lo + j][1]) == k else 0.0 for j in range(len(part))])
        # a margin above the rounding of scores and sums keeps every tie
        alive = bounds >= least[:, None] - 10.0**-DIGITS
        alive &= bounds > 0
        used = np.flatnonzero(alive.any(axis=0))
        if not len(used):
            continue
        docs = (used[:, None] * BLOCK + np.arange(BLOCK)).reshape(-1)
        docs = docs[docs < shard.n]
        # most blocks alive: no copy of what is scored
        whole = 2 * len(docs) > shard.n
        scores = rare + weights @ shard.dense if whole else rare[:, docs] + weights @ shard.dense[:, docs]
        docs = np.arange(shard.n) if whole else docs
        scores = np.round(scores[:, : len(docs)], DIGITS)
        for j in range(len(part)):
            hit = np.flatnonzero((scores[j] >= least[j]) & (scores[j] > 0))
            if not len(hit):
                continue
            ids, values = np.append(top[lo + j][0], shard.ids[docs[hit]]), np.append(top[lo + j][1], scores[j, hit])
            keep = best(ids, values, k)
            top[lo + j] = (ids[keep], values[keep])


def merged(query_ids, k: int):
    def merge(group: pa.Table) -> pa.Table:
        number = group.column("group")[0].as_py()
        own = query_ids[number * GROUP : (number + 1) * GROUP]
        counts = np.stack([np.frombuffer(x.as_py(), np.int64) for x in group.column("counts")])
        ids, scores = unpacked(group.column("ids"), np.int64)[0], unpacked(group.column("scores"), np.float64)[0]
        query = np.repeat(np.tile(np.arange(len(own)), len(counts)), counts.reshape(-1))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        first = runs(query)
        rank = np.arange(len(query)) - np.repeat(first, lengths(first, len(query))) + 1
        keep = rank <= k
        return pa.table(
            {
                "query_id": pa.array(np.asarray(own, np.int64)[query[keep]]),
                "rank": pa.array(rank[keep].astype(np.int32)),
                "doc_id": pa.array(ids[keep]),
                "score": pa.array(scores[keep]),
            }
        )

    return merge


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, doc_id, score of the ``k`` best documents for each query.

    The score is the sum over the distinct terms of the query (words between blanks, A-Z in
    lower case) of ``ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b
    + b * words / mean words))``, rounded to six digits; equal scores go by doc_id. Only
    documents with a term of the query are found. Null or empty queries find nothing; rows
    without id neither ask nor are found; repeated rows count and are found each. ``queries``
    has doc_id and text.
    """
    spark = docs.sparkSession
    index = build_index(docs)

    def totals(batches):
        for batch in batches:
            sizes, many = unpacked(batch.column("sizes"), np.uint32)
            yield pa.RecordBatch.from_pydict({"documents": [int(many.sum())], "words": [int(sizes.sum(dtype=np.int64))]})

    sums = index.select("sizes").mapInArrow(totals, "documents bigint, words bigint").agg(F.sum("documents"), F.sum("words"))
    documents, total = sums.first()
    average = max((total or 0) / max(documents or 0, 1), 1e-9)
    asked = queries.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = asked.filter("doc_id is not null").mapInArrow(query_rows, "query_id bigint, terms binary, n bigint")
    asked = staged(asked.filter("n > 0"), "queries")
    blocks = max(1, -(-(asked.agg(F.sum("n")).first()[0] or 0) // QUERY_TERMS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    found = []
    for number in range(blocks):
        # one block of about QUERY_TERMS terms at a time
        own = asked.filter(F.col("block") == number).select("query_id", "terms").orderBy("query_id").collect()
        if not own:
            continue
        terms = [np.frombuffer(r["terms"], np.uint64) for r in own]
        wanted = np.unique(np.concatenate(terms))
        vocabulary = spark.sparkContext.broadcast(wanted)
        pieces = index.select("terms", "counts").mapInArrow(frequencies(vocabulary), "piece bigint, counts binary")
        pieces = pieces.groupBy("piece").applyInArrow(added, "piece bigint, counts binary").collect()
        df = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(pieces, key=lambda r: r["piece"])])
        idf = np.log1p((documents - df + 0.5) / (df + 0.5))
        block = spark.sparkContext.broadcast(([np.searchsorted(wanted, t) for t in terms], wanted, idf, average))
        partial = index.mapInArrow(search_rows(block, k), "group bigint, counts binary, ids binary, scores binary")
        rows = partial.groupBy("group").applyInArrow(
            merged([r["query_id"] for r in own], k), "query_id bigint, rank int, doc_id bigint, score double"
        )
        found.append(staged(rows, "found"))
        vocabulary.unpersist()
        block.unpersist()
    empty = spark.createDataFrame([], "query_id bigint, rank int, doc_id bigint, score double")
    for rows in found:
        empty = empty.union(rows)
    return empty
