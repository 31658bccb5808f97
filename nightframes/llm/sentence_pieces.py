"""SentencePiece encoding with one forward pass over the shared prefixes of all words.

A text is cut before each run of word marks; no piece of such a model goes on across one, so
the pieces of a text are those of its marked words. The distinct words of a slice are sorted,
which lays them out as the depth-first walk of a trie: what two neighbours have in common is
scored once. For each prefix the forward table holds the last piece of its best encoding.

The model at hand merges pieces by priority, where the best encoding is not the one with the
largest sum of scores. A prefix of such an encoding is itself an encoding, so the last piece
is the one that may follow the last piece of what is left before it: encoding the two together
gives the two again. Characters the model does not know become bytes.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframes.llm.buffers import slices
from nightframes.llm.tables import kept

MARK = "▁"
# A line end that is in no piece becomes a byte, so words part there too.
WORDS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
# Words and pairs of pieces a worker keeps; the store starts anew beyond that.
KEPT_WORDS = 320_000
KEPT_PAIRS = 350_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary, and encoding and decoding with it."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.ids = {model.id_to_piece(i): i for i in range(n) if not special[i]}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that go on across a word mark or line end are not supported")
        # lengths of the pieces that end with the same two letters, longest first
        ends: dict[str, set[int]] = {}
        for p in self.ids:
            ends.setdefault(p[-2:], set()).add(len(p))
        self.ends = {e: tuple(sorted(n, reverse=True)) for e, n in ends.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.texts = [b"" if special[i] else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        for b, i in enumerate(self.bytes):
            self.texts[i] = bytes([b])
        self.pairs: dict[str, dict[str, bool]] = {}
        self.held_pairs = 0
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging neighbours, best score first and leftmost of equals."""
        parts = list(text)
        scores = self.scores
        while len(parts) > 1:
            found = [scores.get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
            best = max((s for s in found if s is not None), default=None)
            if best is None:
                break
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, before: str, piece: str) -> bool:
        """Whether ``piece`` may come after ``before`` (empty at the beginning)."""
        if self.held_pairs > KEPT_PAIRS:
            for x in self.pairs.values():
                x.clear()
            self.held_pairs = 0
        self.held_pairs += 1
        found = self.merged(before + piece) == ([before, piece] if before else [piece])
        self.pairs[before][piece] = found
        return found

    def encode_sorted(self, words: list[str]) -> None:
        """Encode sorted distinct words, keeping the forward table of the common prefix."""
        last: list[str] = []  # the last piece of each prefix of the current word
        previous = ""
        ids, ends, pairs, follows, none = self.ids, self.ends, self.pairs, self.follows, ()
        for word in words:
            shared, most = 0, min(len(word), len(previous))
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            del last[shared:]
            for end in range(shared + 1, len(word) + 1):
                letter = word[end - 1]
                if letter not in ids:
                    last.append(letter)
                    continue
                for n in ends.get(word[end - 2 : end], none) if end > 1 else none:
                    if n > end:
                        continue
                    piece = word[end - n : end]
                    if piece in ids:
                        before = last[end - n - 1] if end > n else ""
                        known = pairs.get(before)
                        if known is None:
                            known = pairs[before] = {}
                        fits = known.get(piece)
                        if fits or (fits is None and follows(before, piece)):
                            last.append(piece)
                            break
                else:
                    last.append(letter)  # the letter alone is what is left
            out, end = [], len(word)
            while end:
                piece = last[end - 1]
                found = ids.get(piece)
                out += [found] if found is not None else [self.bytes[b] for b in reversed(piece.encode())]
                end -= len(piece)
            self.known[word] = np.array(out[::-1], "<u4").tobytes()
            previous = word

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; an empty text has none."""
        parted = [WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set(chain.from_iterable(parted)).difference(self.known)
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known.clear()
            new = set(chain.from_iterable(parted))
        self.encode_sorted(sorted(new))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in parted]

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, without the blank that encoding puts before it."""
        texts = self.texts
        return b"".join([texts[i] for i in np.frombuffer(ids, "<u4").tolist()])[1:]


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (binary, unsigned little-endian 32-bit) of every row.

    The ids are those of the sentencepiece library. Null and empty texts have none. Every
    row, repeated or without doc_id, is encoded as it comes; an empty table gives none; other
    columns are ignored.
    """
    path = path or default_path()

    def encode(batches):
        pieces = kept(("pieces", path), lambda: Pieces(path))
        for part in chain.from_iterable(map(slices, batches)):
            ids = pieces.encode([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(encode, "doc_id bigint, ids binary")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, and the text (binary, as ids need not make whole characters) of rows of ids; null ids are empty."""
    path = path or default_path()

    def decode(batches):
        pieces = kept(("pieces", path), lambda: Pieces(path))
        for batch in batches:
            texts = [pieces.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "ids"]).columns, pa.array(texts, pa.binary())], ["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, ids binary, text binary")
