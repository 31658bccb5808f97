"""Registered queries of the operators and the SQL some are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframes.llm import (
    best_two_fit,
    exact_dedup,
    jaccard_join,
    line_dedup,
    prefix_trie,
    search,
    secrets,
    seed_extend,
    sentence_pieces,
    suffix_dedup,
    token_store,
    toxicity,
    turn_repair,
)
from nightframes.llm.tables import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def crc32_sql(text: str) -> str:
    """SQL for the CRC-32 of an ASCII text, bit by bit."""
    return f"""xor(4294967295, list_reduce(
        list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT)),
        lambda c, b: list_reduce(range(8), lambda x, j: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)),
        CAST(4294967295 AS BIGINT)))"""


def removed() -> Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed")


@query(
    """
    WITH keyed AS (
        SELECT doc_id, length(coalesce(text, '')) AS chars,
               sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))
                   AS text_sha256
        FROM documents
    ), chosen AS (
        SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id
        FROM keyed
    )
    SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, text_sha256 FROM chosen
    """
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document of equal texts stays."""
    return exact_dedup.mark_duplicates(documents(spark, sf_dir))


@query(
    """
    WITH words AS (
        SELECT doc_id, unnest(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x20\\x09-\\x0D]+')) AS term
        FROM documents
    ), tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
    sizes AS (
        SELECT d.doc_id, coalesce(s.n, 0) AS n, avg(coalesce(s.n, 0)) OVER () AS mean, count(*) OVER () AS documents
        FROM documents d LEFT JOIN (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id) s USING (doc_id)
    ), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    scored AS (
        SELECT q.doc_id AS query_id, t.doc_id,
               round(sum(ln(1 + (s.documents - f.df + 0.5) / (f.df + 0.5)) * t.tf * 2.2
                         / (t.tf + 1.2 * (0.25 + 0.75 * s.n / s.mean))), 6) AS score
        FROM tf q JOIN tf t USING (term) JOIN df f USING (term) JOIN sizes s ON s.doc_id = t.doc_id
        WHERE q.doc_id % 100 = 0 GROUP BY ALL
    ), ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
               doc_id, score
        FROM scored
    )
    SELECT * FROM ranked WHERE rank <= 10
    """
)
def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 100."""
    docs = documents(spark, sf_dir)
    return search.search(docs, docs.filter("doc_id % 100 = 0"))


@query()
def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents as they are read back from the shards by key."""
    docs = documents(spark, sf_dir)
    found = token_store.read_keys(token_store.write_store(docs), docs)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles agree to nine tenths."""
    found = jaccard_join.linked_documents(documents(spark, sf_dir), width=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


@query()
def op5_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by kind and place."""
    found = secrets.find_secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[of(kind) for kind in secrets.BASE],
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_documents(documents(spark, sf_dir), labels)


@query()
def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    packed = best_two_fit.pack(documents(spark, sf_dir))
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


@query()
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat a 50-byte string of an earlier one."""
    found = suffix_dedup.dedup_substrings(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_bytes",
        removed(),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query()
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and what they decode to."""
    ids = sentence_pieces.encoded(documents(spark, sf_dir))
    return sentence_pieces.decoded(ids).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query()
def op10_seed_extend_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat a 13-word passage of an earlier one."""
    found = seed_extend.dedup_passages(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", removed(), F.sha2("kept", 256).alias("kept_sha256"))


@query(
    """
    WITH lines AS (
        SELECT doc_id, unnest(range(1, len(parts) + 1)) AS place, unnest(parts) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
    ), keyed AS (
        SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines
    ), shared AS (
        SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
    ), judged AS (
        SELECT k.doc_id, k.place, k.line, s.key IS NOT NULL AND k.doc_id <> s.holder AS gone
        FROM keyed k LEFT JOIN shared s USING (key)
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
    """
)
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that at least three documents share, and what stays."""
    found = line_dedup.dedup_corpus(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    f"""
    WITH RECURSIVE named AS (
        SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
        FROM conversations
    ), cases AS (SELECT *, {crc32_sql("name")} % 20 AS c FROM named),
    damaged AS (
        SELECT conv, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role,
               CASE c WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
        FROM cases CROSS JOIN range(2) WHERE c <> 0 AND (range = 0 OR c = 3)
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role,
                                     sha256(strlen(role) || ':' || role || text)) AS i,
               count(*) OVER (PARTITION BY conv) AS n
        FROM damaged
    ), judged AS (
        SELECT *, substr(role, 1, 1) AS initial,
               CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                    WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'd'
                    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault
        FROM placed
    ), faults AS (
        SELECT conv, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
               count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
               count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal
        FROM (SELECT *, lag(initial) OVER (PARTITION BY conv ORDER BY i) AS before FROM judged) GROUP BY conv
    ), edits AS (
        SELECT *, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS x, fault IN ('b', 'd') AS must FROM judged
    ), back(conv, i, role, text, c0, c1, c2, c3, e0, e1, e2, e3) AS (
        SELECT conv, n + 1, '', '', 0, 4, 2, 0, '', 'I', 'I', '' FROM edits WHERE i = n
        UNION ALL
        SELECT conv, i, role, text, c0, c1, c2, c3,
               CASE WHEN d0 = c0 THEN 'D' WHEN 2 + c2 = c0 THEN 'I' WHEN k0 = c0 THEN 'K' ELSE 'R' END,
               CASE WHEN d1 = c1 THEN 'D' WHEN 2 + c2 = c1 THEN 'I' WHEN k1 = c1 THEN 'K' ELSE 'R' END,
               CASE WHEN d2 = c2 THEN 'D' WHEN 2 + c3 = c2 THEN 'I' WHEN k2 = c2 THEN 'K' ELSE 'R' END,
               CASE WHEN d3 = c3 THEN 'D' WHEN 2 + c2 = c3 THEN 'I' WHEN k1 = c3 THEN 'K' ELSE 'R' END
        FROM (
            SELECT *, least(b0, 2 + b2, 4 + b3) AS c0, least(b1, 2 + b2, 4 + b3) AS c1, least(b2, 2 + b3) AS c2,
                   least(b3, 2 + b2) AS c3
            FROM (
                SELECT *, least(d0, k0, r_user) AS b0, least(d1, k1, r_user) AS b1, least(d2, k2, r_assistant) AS b2,
                       least(d3, k1, r_user) AS b3
                FROM (
                    SELECT e.conv, e.i, e.role, e.text, 3 + b.c0 AS d0, 3 + b.c1 AS d1, 3 + b.c2 AS d2, 3 + b.c3 AS d3,
                           CASE WHEN must THEN 999999 WHEN initial = 's' THEN b.c1 + x WHEN initial = 'u' THEN b.c2 + x
                                ELSE 999999 END AS k0,
                           CASE WHEN NOT must AND initial = 'u' THEN b.c2 + x ELSE 999999 END AS k1,
                           CASE WHEN NOT must AND initial = 'a' THEN b.c3 + x ELSE 999999 END AS k2,
                           CASE WHEN must THEN 999999 ELSE 2 + b.c2 + x END AS r_user,
                           CASE WHEN must THEN 999999 ELSE 2 + b.c3 + x END AS r_assistant
                    FROM back b JOIN edits e ON e.conv IS NOT DISTINCT FROM b.conv AND e.i = b.i - 1
                )
            )
        )
    ), forward(conv, i, state, done, audit, lines) AS (
        SELECT conv, 1, 0, false, '', [] :: VARCHAR[] FROM edits WHERE i = 1
        UNION ALL
        SELECT conv, CASE WHEN e IN ('I', '') THEN i ELSE i + 1 END, CASE WHEN e IN ('D', '') THEN state ELSE target END,
               e = '', audit || e, CASE WHEN e IN ('D', '') THEN lines ELSE list_append(lines, CASE e
                   WHEN 'K' THEN role || ':' || text
                   WHEN 'R' THEN [NULL, 'user', 'assistant'][target] || ':' || text
                   ELSE [NULL, 'user', 'assistant'][target] || ':' END) END
        FROM (
            SELECT f.*, b.role, b.text, [e0, e1, e2, e3][state + 1] AS e,
                   CASE WHEN [e0, e1, e2, e3][state + 1] = 'K' AND b.role[1] = 's' THEN 1
                        WHEN state = 2 THEN 3 ELSE 2 END AS target
            FROM forward f JOIN back b ON b.conv IS NOT DISTINCT FROM f.conv AND b.i = f.i WHERE NOT done
        )
    ), repaired AS (SELECT conv, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM forward WHERE done)
    SELECT a.conv AS conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank,
           coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal,
           CAST(coalesce(b.c0, 0) AS BIGINT) AS cost, coalesce(r.audit, '') AS audit,
           coalesce(r.repaired_sha256, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv FROM named) a LEFT JOIN faults f ON f.conv IS NOT DISTINCT FROM a.conv
    LEFT JOIN back b ON b.conv IS NOT DISTINCT FROM a.conv AND b.i = 1
    LEFT JOIN repaired r ON r.conv IS NOT DISTINCT FROM a.conv
    """
)
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of damaged conversations and their cheapest repair."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turn_repair.repair(turn_repair.damaged(conversations))


@query(
    f"""
    WITH turns AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
        FROM conversations WHERE conv_id IS NOT NULL
    ), convs AS (
        SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)
    ), rebuilt AS (
        SELECT c.conv_id, t.role, t.text, 0 AS part, t.place
        FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.place <= c.h
        UNION ALL
        SELECT c.conv_id, t.role, t.text, 1 AS part, t.place
        FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h
    ), steps AS (
        SELECT conv_id, strlen(text) AS bytes, row_number() OVER w AS depth,
               string_agg(sha256(role) || sha256(text), '') OVER w AS prefix
        FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)
        UNION ALL SELECT conv_id, 0, 0, '' FROM convs
    ), marked AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM steps),
    nodes AS (
        SELECT prefix, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n, min(bytes) AS bytes,
               sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
        FROM marked GROUP BY prefix
    ), children AS (
        SELECT substr(prefix, 1, 128 * (depth - 1)) AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
    ), sums AS (
        SELECT a.prefix, count(*) FILTER (WHERE c.n IS NULL) AS leaves, sum((x.n - 1) * x.bytes) AS saved
        FROM nodes x LEFT JOIN children c ON c.prefix = x.prefix
        CROSS JOIN range(0, x.depth + 1) r(d) JOIN nodes a ON a.prefix = substr(x.prefix, 1, 128 * r.d)
        GROUP BY a.prefix
    )
    SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(c.n, 0) AS n_children,
           s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, x.ends_sha256
    FROM nodes x JOIN sums s ON s.prefix = x.prefix LEFT JOIN children c ON c.prefix = x.prefix
    LEFT JOIN nodes p ON x.depth > 0 AND p.prefix = substr(x.prefix, 1, 128 * (x.depth - 1))
    """
)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie.prefix_trie(conversations, rebuilt=True).drop("key")
