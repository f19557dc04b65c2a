"""Token boundaries of public tokenizers, loaded once per process from the path given."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import regex

#: Default vocabulary: a file of ranks for tiktoken. Never copied, only read where it is.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Instead of a file: one kana or Chinese character, a run of other letters, digits and underscores, or one other character.
PLAIN = "plain"
# Fixed value: the pattern that these vocabularies split text by before merging.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Han}]|[[\p{L}\p{N}_]--[\p{Hiragana}\p{Katakana}\p{Han}]]+|[^\s]", regex.V1)


class Ranks:
    """A byte-level vocabulary. Special tokens do not exist, so their strings are ordinary text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(path, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def ends(self, text: str) -> np.ndarray:
        """Where each token ends, in characters; a token that ends inside a character counts as ending after it."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        at = np.cumsum(self.lengths[ids]) if len(ids) else np.empty(0, np.int64)
        if text.isascii():
            return at
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        return np.cumsum((raw & 0xC0) != 0x80)[at - 1]


class Plain:
    """Countable without a vocabulary."""

    def count(self, text: str) -> int:
        return sum(1 for _ in _PLAIN.finditer(text))

    def ends(self, text: str) -> np.ndarray:
        return np.fromiter((m.end() for m in _PLAIN.finditer(text)), np.int64)


@lru_cache(4)
def tokenizer(path: str) -> Ranks | Plain:
    return Plain() if path == PLAIN else Ranks(path)
