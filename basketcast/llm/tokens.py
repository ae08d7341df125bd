"""Byte-level BPE ids of whole texts, encoded once per distinct word in a task.

The split pattern never matches across a single space between two non-space
characters, so such a text is cut there and each piece (its space in front) encoded on
its own; the pieces of a task repeat, and a bounded memory of them saves the merges.
Texts with two white-space characters in a row are encoded whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

_TWO_SPACES = re.compile(r"\s\s")
MEMORY_WORDS = 300_000


def byte_of_char() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable Latin-1
    characters stand for themselves, the other bytes follow from 256 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memory(dict):
    """Word -> bytes of its ids; emptied when it holds ``limit`` words."""

    def __init__(self, encode, limit: int = MEMORY_WORDS):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = self[word] = np.asarray(self.encode(" " + word), dtype="<u2").tobytes()
        return ids


class JsonTokenizer:
    """Ids as the tokenizers library gives them for a byte-level BPE file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_of_char()
        added = spec.get("added_tokens", [])
        self.special = [t["content"] for t in added]
        vocab = {w: i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        self.size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in added)])
        if self.size > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.bytes_of = {i: bytes(chars[c] for c in w) for w, i in vocab.items()}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, special_tokens={},
                                      mergeable_ranks={b: i for i, b in self.bytes_of.items()})
        self.path, self._whole = path, None
        self.memory = Memory(self.fast.encode_ordinary)

    def whole(self, text: str) -> list[int]:
        self._whole = self._whole or Tokenizer.from_file(self.path)
        return self._whole.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.asarray(self.whole(text), dtype="<u2")
        if _TWO_SPACES.search(text):
            return np.asarray(self.fast.encode_ordinary(text), dtype="<u2")
        first, *rest = text.split(" ")
        head = np.asarray(self.fast.encode_ordinary(first), dtype="<u2").tobytes()
        return np.frombuffer(head + b"".join(map(self.memory.__getitem__, rest)), dtype="<u2")


@lru_cache(maxsize=2)
def json_tokenizer(path: str, pattern: str) -> JsonTokenizer:
    return JsonTokenizer(path, pattern)
