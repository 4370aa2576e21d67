"""Token ids of whole texts by a tokenizer file of the ``tokenizers`` library, for use inside tasks.

The word tokenizer lower-cases, drops white space and never lets a token cross it, so a text's ids are its
words' ids in a row. Words repeat far more often than texts: an encoder keeps the ids of words it saw lately and
asks the library for new words only. A tokenizer of another build is asked for every text as a whole.
"""

from __future__ import annotations

import json
import re
import struct

from tokenizers import Tokenizer

from stallwatch.llm.common import worker_state

# A lower-cased word of plain Latin letters with ASCII marks behind it (no apostrophe, which starts contractions).
PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, every other byte for the next code point from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) if b in own else chr(256 + other.index(b)) for b in range(256)}


class Encoder:
    """Ids of UTF-8 texts as little-endian unsigned 32-bit bytes, special tokens not added."""

    def __init__(self, path: str, most_words: int = 800_000):
        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            build = json.load(f)
        self.by_word = _splits_at_spaces(build)
        self.words = _Words(self.tokenizer, most_words)

    def ids(self, text: bytes) -> bytes:
        if self.by_word:
            return b"".join(map(self.words.__getitem__, text.split()))
        return _packed(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)


class _Recent(dict):
    """A bounded table in two generations: when the young one is full it becomes the old one, which later look-ups still reach."""

    def __init__(self, most: int):
        self.most, self.old = most // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class _Words(_Recent):
    """Word (bytes between ASCII white space) to ids."""

    def __init__(self, tokenizer: Tokenizer, most: int):
        super().__init__(most)
        self.tokenizer, self.stems = tokenizer, _Stems(tokenizer, most)

    def make(self, word: bytes) -> bytes:
        spelled = word.decode("utf-8", "replace")
        plain = PLAIN.fullmatch(spelled.lower())
        if not plain:
            return _packed(self.tokenizer.encode(spelled, add_special_tokens=False).ids)
        stem, marks = plain.groups()
        return self.stems[stem] + self[marks.encode()] if marks else self.stems[stem]


class _Stems(_Recent):
    """Lower-case Latin letters to ids, by the tokenizer's model alone: nothing is left to normalise or to cut."""

    def __init__(self, tokenizer: Tokenizer, most: int):
        super().__init__(most)
        self.model, self.letters = tokenizer.model, byte_letters()

    def make(self, stem: str) -> bytes:
        spelled = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.model.tokenize(spelled)])


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _splits_at_spaces(build: dict) -> bool:
    """Whether the file is of the build whose tokens never cross white space: NFC, spaces, lower case; letters, digits, marks apart."""
    steps = [s["type"] for s in (build.get("normalizer") or {}).get("normalizers", [])]
    cuts = (build.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True
        and cuts[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and cuts[1].get("use_regex") is False and cuts[1].get("add_prefix_space") is False
        and build["model"].get("dropout") is None
        and all(not t["lstrip"] and not t["rstrip"] and not set(t["content"]) & set(" \t\n\r\x0b\x0c") for t in build["added_tokens"])
    )


def encoder(path: str) -> Encoder:
    """The encoder of ``path``, built once in each Python worker."""
    return worker_state(f"encoder {path}", lambda: Encoder(path))
