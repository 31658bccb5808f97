"""Token ids of texts, word by word, with a tokenizers file whose pre-tokenizer drops white space.

Such a tokenizer never joins characters across white space, so the ids of a text are those
of its words, one after the other. Each distinct word is encoded once and kept; the rest is
looking up. Only ASCII blanks part words here, a subset of white space.

A new word goes through the library as a whole, or, where the file's steps before the model
are the plain ones this module knows, straight to the library's model in its pre-tokens. That
skips the offsets and masks the library makes up for every text, and gives the same ids.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

# Words a worker keeps, about 110 MB; the store starts anew beyond that, which changes no result.
KEPT_WORDS = 600_000
# Pre-tokens kept likewise: words that differ in case or punctuation share them.
KEPT_PARTS = 300_000
# Below this character lower case is one character for one, whatever stands around it.
PLAIN_LIMIT = "İ"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Known(dict):
    """Ids of words or pre-tokens met so far; what is not there yet is encoded when it is asked for."""

    def __init__(self, encode, most: int):
        self.encode, self.most = encode, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = ids = self.encode(key)
        return ids


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.width = np.dtype(self.dtype).itemsize
        self.known = Known(self.word, KEPT_WORDS)
        self.parts = Known(self.part, KEPT_PARTS)
        self.pattern = self.plain_steps(path)
        self.model = self.tokenizer.model
        self.letters = {b: c for b, c in byte_letters().items()}
        self.ascii = re.compile(rb"[!-~]+")

    @staticmethod
    def plain_steps(path: str):
        """The file's pre-token pattern if its other steps are the known ones."""
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, split = spec["normalizer"] or {}, (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        known = before.get("normalizers") == NORMALIZERS and split[1:] == [BYTE_LEVEL]
        known = known and (split[0].get("behavior"), split[0].get("invert")) == ("Removed", True)
        # added tokens are found before all this; words that may hold one take the long way
        known = known and all(t["content"].startswith("<|") for t in spec["added_tokens"])
        return regex.compile(split[0]["pattern"]["Regex"]) if known else None

    def part(self, part: str) -> bytes:
        """Ids of one pre-token, in the letters of the byte-level vocabulary."""
        return b"".join([t.id.to_bytes(self.width, "little") for t in self.model.tokenize(part)])

    def plain(self, word: bytes) -> bytes | None:
        """Ids of a word by its pre-tokens, or None where that might differ from the whole way."""
        if b"<|" in word:
            return None
        text = word.decode().lower()
        if word.isalpha():  # ASCII letters only: one pre-token
            return self.parts[text]
        if self.ascii.fullmatch(word):
            parts = self.pattern.findall(text)
        else:
            if max(text) >= PLAIN_LIMIT or min(text) < "!" or not unicodedata.is_normalized("NFC", text):
                return None
            parts = ["".join([self.letters[b] for b in p.encode()]) for p in self.pattern.findall(text)]
        return b"".join([self.parts[p] for p in parts])

    def word(self, word: bytes) -> bytes:
        """Ids of one word as bytes of ``dtype``."""
        ids = self.plain(word) if self.pattern else None
        if ids is None:
            ids = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, self.dtype).tobytes()
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as bytes of ``dtype``."""
        get = self.known.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]
