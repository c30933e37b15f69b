"""Byte-pair encoders that give exactly the ids of the tokenizers library for two of its public files.

The library is the authority and encodes whatever is out of the ordinary. For ordinary texts (all characters below
U+0300, no special token's string) the same merges, read from the same file, run in tiktoken's core, which does not
build the offsets and strings that the library builds for each token.
"""

from __future__ import annotations

import json
import re
from collections import OrderedDict
from functools import cached_property

import numpy as np


def _alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE files: a visible byte is its own Latin-1 character, the others follow from U+0100."""
    seen = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _class(kind: str) -> str:
    """Inside of a character class: the characters below U+0300 of a Unicode category."""
    import unicodedata

    return "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c)).startswith(kind))


class _Encoder:
    """Pickles as its path; files are read where they are used, once in a process."""

    _known: dict = {}

    def __init__(self, path: str) -> None:
        self.path = path

    def __reduce__(self):
        return type(self).opened, (self.path,)

    @classmethod
    def opened(cls, path: str):
        if (cls, path) not in _Encoder._known:
            _Encoder._known[cls, path] = cls(path)
        return _Encoder._known[cls, path]

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def file(self) -> dict:
        """Read anew each time: it is large, and only what is built from it stays."""
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    @cached_property
    def special(self) -> dict[str, int]:
        return {t["content"]: t["id"] for t in self.file()["added_tokens"]}

    @cached_property
    def unusual(self) -> re.Pattern:
        special = "|".join(map(re.escape, self.special))
        return re.compile(rf"[^\x00-˿]|{special}" if special else r"[^\x00-˿]")

    @property
    def vocabulary(self) -> int:
        return max([*self.file()["model"]["vocab"].values(), *self.special.values()]) + 1

    def _exact(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def decode(self, ids) -> str:
        return self.library.decode(np.asarray(ids).tolist(), skip_special_tokens=False)


class ByteEncoder(_Encoder):
    """Byte-level BPE whose words keep the blank before them."""

    @cached_property
    def _cores(self):
        import tiktoken

        alphabet = _alphabet()
        ranks = {bytes(alphabet[c] for c in token): k for token, k in self.file()["model"]["vocab"].items() if token not in self.special}
        # fixed values: the file format's word pattern, without the look-ahead that only longer white space needs
        short = r" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
        full = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return [tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (short, full)]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.unusual.search(text):
            return self._exact(text)
        core = self._cores[bool(_RUN.search(text))]
        return np.array(core.encode_ordinary(text), dtype=np.uint32)


_RUN = re.compile(r"\s\s")


class WordEncoder(_Encoder):
    """BPE with word ends, over lower-cased words; white space is dropped.

    The core knows no word ends, so each word is followed by a mark: a byte that a lower-cased word cannot hold.
    A last letter joined with the mark is in the file's first entries, before all merges, and so joins first.
    """

    MARK = "A"

    @cached_property
    def _core(self):
        import tiktoken

        alphabet, model, ranks = _alphabet(), self.file()["model"], {}
        end = model["end_of_word_suffix"]
        for token, k in model["vocab"].items():
            if token in self.special:
                continue
            whole = len(token) > len(end) and token.endswith(end)
            ranks[bytes(alphabet[c] for c in (token[: -len(end)] if whole else token)) + self.MARK.encode() * whole] = k
        return tiktoken.Encoding("own", pat_str=rf"[^{self.MARK}]*{self.MARK}", mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def _words(self) -> re.Pattern:
        letters, digits = _class("L"), _class("N")
        return re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{digits}]|[^\s\x1c-\x1f{letters}{digits}]+|[\x1c-\x1f]+")

    @cached_property
    def _odd(self) -> re.Pattern:
        return re.compile(self.unusual.pattern + "|[\x1c-\x1fİ]")

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self._odd.search(text):
            return self._exact(text)
        words = self._words.findall(text.lower())
        if not words:
            return np.zeros(0, np.uint32)
        return np.array(self._core.encode_ordinary(self.MARK.join(words) + self.MARK), dtype=np.uint32)

    def decode_table(self) -> tuple[list[bytes], bytes]:
        """UTF-8 of each id's token, and what the library puts between tokens: a file without a decoder gets spaces."""
        file = self.file()
        if file["decoder"] is not None:
            raise ValueError("only files without a decoder")
        tokens = {k: t.encode() for t, k in (file["model"]["vocab"] | self.special).items()}
        return [tokens.get(k, b"") for k in range(max(tokens) + 1)], b" "


class ChunkCache:
    """Least recently used chunks go when their bytes are over a bound."""

    def __init__(self, most: int = 48 << 20) -> None:
        self.most, self.size, self.held = most, 0, OrderedDict()

    def get(self, key: bytes):
        if (x := self.held.get(key)) is not None:
            self.held.move_to_end(key)
        return x

    def put(self, key: bytes, value: tuple, size: int) -> None:
        self.held[key] = value
        self.size += size
        while self.size > self.most:
            _, old = self.held.popitem(last=False)
            self.size -= old[-1]
