"""Texts above a limit into pieces within it, cut at natural boundaries, with an overlap.

A text is read as a tree: sections by heading level, then blocks between blank lines, lines (list items, table rows),
sentences, words and characters. Sibling subtrees are merged bottom-up as far as the limit allows, and only nodes that are
too large themselves are descended into.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.tokens import VOCABULARY, tokenizer
from kinweave.session import python_path

LIMIT = 512
OVERLAP = 64

#: Where a sibling begins, from the top of the tree to words; characters come last.
_LEVELS = [
    regex.compile(r"(?m)^(?=#[ \t]|<h1\b)"),
    regex.compile(r"(?m)^(?=##[ \t]|<h2\b)"),
    regex.compile(r"(?m)^(?=#{3,6}[ \t]|<h[3-6]\b)"),
    regex.compile(r"\n[ \t]*\n\s*(?=\S)|\n(?=<(?:p|div|table|ul|ol|section|article)\b)"),
    regex.compile(r"\n(?=[ \t]*(?:[-*+•]|\d+[.)])[ \t])|\n(?=\S)"),
    regex.compile(r"(?<=[.!?…]['\"”’»)\]]*)\s+(?=\S)|(?<=[。！？][」』）]*)(?=[^\s」』）])"),
    regex.compile(r"\s+(?=\S)|(?<=[、，；：;|&])(?=\S)"),
]


class _Tree:
    def __init__(self, text: str, ends: np.ndarray):
        self.text, self.ends = text, ends
        self.cuts: dict[int, np.ndarray] = {}

    def tokens(self, start: int, end: int) -> int:
        return int(np.searchsorted(self.ends, end, "right") - np.searchsorted(self.ends, start, "right"))

    def children(self, start: int, end: int, level: int) -> list[tuple[int, int]]:
        if level not in self.cuts:
            if level < len(_LEVELS):
                self.cuts[level] = np.fromiter((m.end() for m in _LEVELS[level].finditer(self.text)), np.int64)
            else:
                self.cuts[level] = np.unique(self.ends)
        c = self.cuts[level]
        inner = c[np.searchsorted(c, start, "right") : np.searchsorted(c, end, "left")].tolist()
        return list(zip([start, *inner], [*inner, end]))

    def pack(self, start: int, end: int, most: int, level: int = 0) -> list[tuple[int, int]]:
        """Consecutive spans of at most `most` tokens."""
        if self.tokens(start, end) <= most:
            return [(start, end)]
        kids = self.children(start, end, level)
        while len(kids) == 1 and level <= len(_LEVELS):
            level += 1
            kids = self.children(start, end, level)
        if len(kids) == 1 or level > len(_LEVELS) and all(self.tokens(*k) > most for k in kids):
            return kids
        out: list[tuple[int, int]] = []
        for kid in kids:
            for s, e in self.pack(*kid, most, level + 1) if level < len(_LEVELS) else [kid]:
                if out and self.tokens(out[-1][0], e) <= most:
                    out[-1] = (out[-1][0], e)
                else:
                    out.append((s, e))
        return out


def pieces(text: str | None, vocabulary: str = VOCABULARY, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """`(start, new, end, tokens)` of each piece `text[start:end]`, where `text[start:new]` repeats the end of the piece before.

    Each piece, tokenized on its own, has at most `limit` tokens, and repeats the last `overlap` tokens of the one before
    (more only where a token ends inside a character). Null gives nothing, a text within the limit a single piece.
    """
    if text is None:
        return []
    tok = tokenizer(vocabulary)
    if len(text) <= limit:  # a character has one token at least where this returns more than one piece
        n = tok.count(text)
        if n <= limit:
            return [(0, 0, len(text), n)]
    ends = tok.ends(text)
    if len(ends) <= limit:
        return [(0, 0, len(text), len(ends))]
    tree = _Tree(text, ends)
    todo = tree.pack(0, len(text), limit - overlap)[::-1]
    out, back = [], 0
    while todo:
        s, e = todo.pop()
        own = tok.ends(text[back:e])
        while len(own) > limit:
            # Tokens of the piece alone may be more than in the whole text: cut a little earlier, at an end of a token.
            fewer = [c for c in tree.children(s, e, len(_LEVELS) - 1) if c[1] < e] or [c for c in tree.children(s, e, len(_LEVELS)) if c[1] < e]
            cut = max((c[1] for c in fewer if tree.tokens(back, c[1]) <= limit - (len(own) - limit)), default=0)
            if cut <= s:
                cut = next((c[1] for c in tree.children(s, e, len(_LEVELS)) if c[1] > s), e)
            if cut >= e:
                cut = s + 1
            if cut >= e:  # one character that alone is beyond the limit
                break
            todo.append((cut, e))
            e = cut
            own = tok.ends(text[back:e])
        out.append((back, s, e, len(own)))
        # The last `overlap` tokens begin where the token before them ends, or at the start of the character it ends in.
        k = len(own) - overlap
        back_to = back + int(own[k - 1]) if k > 0 else back
        while k > 0 and back_to > back and len(tok.ends(text[back_to:e])) < overlap:
            back_to -= 1
        back = back_to
    return out


_ROWS = "doc long, piece int, start long, new long, end long, tokens int, text string"
_SCHEMA = pa.schema([("doc", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("new", pa.int64()), ("end", pa.int64()), ("tokens", pa.int32()), ("text", pa.string())])


def split(docs: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """`doc, piece, start, new, end, tokens, text` of every piece of every text; a map-only plan.

    Pieces count from 0. A null text gives no piece, an empty text one empty piece. Repeated rows give their pieces again.
    """
    python_path(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _SCHEMA]
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, (start, new, end, n) in enumerate(pieces(body, vocabulary, limit, overlap)):
                    for c, v in zip(out, (doc, k, start, new, end, n, body[start:end] if with_text else None)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SCHEMA)], schema=_SCHEMA)

    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).filter("text is not null").mapInArrow(cut, _ROWS)
