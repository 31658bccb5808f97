from __future__ import annotations

import zlib

import numpy as np
import pytest

from nightframes.llm import best_two_fit, encoder, sentence_pieces, token_store

STRANGE = ["don't WE'LL's", "A1b2 É é ﬁ İx Σς", "a​b <|endoftext|> x<|startoftext|>y", "\x01a a\x1cb", "ß 日本 a b Ⅷ ½",
           "  <s> </s>▁▁ <0x0A>\r\n\t ", "_a_ ' ''s \u0085x ŉ ǆ Å · ªº"]


@pytest.fixture(scope="module")
def rows(odd_rows):
    return [*odd_rows, *enumerate(STRANGE, 500)]


@pytest.fixture(scope="module")
def encoded(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(encoder.default_path())
    return [x.ids for x in tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_encoder_gives_the_librarys_ids(rows, encoded):
    one = encoder.WordEncoder(encoder.default_path())
    got = one.encode([(t or "").encode() for _, t in rows])
    assert [np.frombuffer(x, one.dtype).tolist() for x in got] == encoded


def test_store_reads_back_what_it_wrote(spark, docs_of, rows, encoded, tmp_path):
    docs = docs_of(rows)
    manifest = token_store.write_store(docs, str(tmp_path / "tokens"))
    got = token_store.read_keys(manifest, docs).collect()
    ordered = sorted(got, key=lambda r: r.start)
    at = 0
    for r in ordered:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    keys = [token_store.NO_ID if r.doc_id is None else r.doc_id for r in ordered]
    assert keys == sorted(keys)
    want = sorted((str(i), crc([*ids, 2])) for (i, _), ids in zip(rows, encoded))
    assert sorted((str(r.doc_id), zlib.crc32(r.ids)) for r in got) == want
    some = spark.createDataFrame([(3,), (3,), (999_999,), (None,)], "doc_id bigint")
    assert sorted(str(r.doc_id) for r in token_store.read_keys(manifest, some).collect()) == ["3", "None", "None"]


def test_empty_tables(docs_of):
    empty = docs_of([])
    assert token_store.read_keys(token_store.write_store(empty), empty).collect() == []
    assert best_two_fit.pack(empty).collect() == []
    assert sentence_pieces.encoded(empty).collect() == []


@pytest.mark.parametrize("size", [2048, 64])
def test_packing(docs_of, rows, encoded, size):
    got = best_two_fit.pack(docs_of(rows), size=size).collect()
    want = []
    for (i, _), ids in zip(rows, encoded):
        whole = [*ids, 0]
        for k in range(0, len(whole), size):
            want.append((str(i), k // size, k, len(whole[k : k + size]), crc(whole[k : k + size])))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    least = -(-sum(x[3] for x in want) // size)
    assert len(bins) <= least + max(2, least // 20)


def test_plan_replaces_the_shortest_by_a_tighter_pair():
    counts = np.zeros(11, int)
    counts[[6, 3, 2]] = 1, 1, 2  # 6 + 3 leaves a gap of 1; 6 + 2 + 2 leaves none
    plan = best_two_fit.plan_sequences(counts, 10)
    assert plan[0] == (1, [6, 2, 2]) and plan[1] == (1, [3])


def test_pieces_are_the_librarys(docs_of, rows):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=sentence_pieces.default_path())
    docs = docs_of(rows)
    ids = sentence_pieces.encoded(docs)
    assert sorted((str(r.doc_id), r.ids) for r in ids.collect()) == sorted(
        (str(i), bytearray(np.array(model.encode(t or ""), "<u4").tobytes())) for i, t in rows
    )
    texts = sentence_pieces.decoded(ids).collect()
    assert sorted((str(r.doc_id), bytes(r.text).decode()) for r in texts) == sorted(
        (str(i), (t or "").replace("▁", " ")) for i, t in rows
    )


def test_a_worker_gives_back_what_a_task_has_freed():
    import numpy as np
    import pyarrow as pa

    from nightframes.llm.jaccard_join import set_rows
    from nightframes.llm.tables import trimmed

    def held():
        return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6

    rng = np.random.default_rng(7)
    texts = [" ".join(map(str, rng.integers(0, 10**6, n))) for n in rng.integers(50, 2000, 1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["node", "text"])
    # every task leaves its worker with no more than the first did
    for _ in trimmed(set_rows(3))([batch]):
        pass
    first = held()
    for _ in set_rows(3)([batch]):
        pass
    untrimmed = held()
    for _ in trimmed(set_rows(3))([batch]):
        pass
    assert held() < first + 15
    assert untrimmed > first + 30
