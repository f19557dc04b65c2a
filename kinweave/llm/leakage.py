"""Passages of held-out texts inside a corpus.

Texts become sequences of words. Every window of as many words as a passage must have, in items and documents alike, is
embedded by CGK random walks, which turn an edit distance into a Hamming distance. Each of several independent samplings of
the embedding's positions gives the window a hash, windows with an equal hash are candidates, and the exact edit distance of
their words decides. Equal windows have equal walks, so exact passages are never missed; how many walks and samplings reach
the target recall for changed ones is measured in the tests.

The windows of the held-out items are small beside the corpus; up to `MAX_ITEM_CHARS` characters of items, their hashes go
to every task, and the corpus is read in a map-only pass. A larger set is met by a shuffle join on the hashes, in which a
filter of fixed size keeps windows that no item has from being shuffled at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.session import python_path

#: Words in a window.
WINDOW = 12
#: Most characters of items whose hashed windows are broadcast: at most 500,000 windows, with 20 bytes for each hash.
MAX_ITEM_CHARS = 1_000_000
#: Bits of the filter of item hashes on the shuffle path; a power of two, so always 8 MB.
FILTER_BITS = 1 << 26
#: Walks, samplings of each, and positions in a sampling, by the edits allowed; the tests measure their recall.
PLANS = {0: (1, 1, 6), 1: (3, 4, 4), 2: (6, 6, 3), 3: (6, 8, 3)}
#: Windows embedded at a time.
_SLICE = 1 << 15
_ONE, _HALF, _ODD = np.uint64(1), np.uint64(29), np.uint64(0x9E3779B97F4A7C15)
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def words(text: str | None) -> list[str]:
    """Runs of letters or digits, in lower case; none for null."""
    return _WORD.findall(text.lower()) if text else []


@lru_cache(1 << 20)
def _word_id(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) | 1


def _ids(ws: list[str]) -> np.ndarray:
    return np.fromiter(map(_word_id, ws), np.uint64, len(ws))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Embedding:
    """CGK walks of windows of `length` words: `walks` independent ones, each with `samplings` sets of `samples` positions."""

    def __init__(self, length: int, walks: int, samplings: int, samples: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.length, self.count = length, walks * samplings
        self.seeds = rng.integers(1, 1 << 63, walks, dtype=np.uint64)
        # One position from each of equal stretches, so that no hash rests on a few neighbouring words. A walk takes about two
        # steps a word, so what lies past 9/4 of the window is mostly padding.
        edges = np.linspace(0, min(3 * length, 9 * length // 4), min(samples, length) + 1).astype(int)
        self.samples = [[set(int(rng.integers(a, max(a + 1, b))) for a, b in zip(edges, edges[1:])) for _ in range(samplings)] for _ in range(walks)]

    def hashes(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """The hashes of all windows, one array per sampling; a walk is taken once for all of its samplings."""
        for seed, samplings in zip(self.seeds, self.samples):
            coins = _mix(ids ^ seed)  # one coin per word and step
            at, end, last = starts.copy(), starts + self.length, len(ids) - 1
            out = [np.full(len(starts), seed + np.uint64(k), np.uint64) for k in range(len(samplings))]
            for step in range(max(map(max, samplings)) + 1):
                # Before as many steps as words no walk can have left its window.
                within = step < self.length
                here = at if within else np.minimum(at, last)
                inside = None if within else at < end
                using = [h for h, chosen in zip(out, samplings) if step in chosen]
                if using:
                    seen = ids[here]
                    if not within:
                        seen *= inside
                    for h in using:
                        h ^= seen
                        h *= _ODD
                        h ^= h >> _HALF
                coin = coins[here]
                coin >>= np.uint64(step & 63)
                coin &= _ONE
                if not within:
                    coin *= inside
                at += coin.view(np.int64)
            yield from out


def starts_of(lengths: list[int], window: int) -> np.ndarray:
    """Start positions, in the concatenated words, of all windows that lie inside one text."""
    parts, at = [], 0
    for n in lengths:
        if n >= window:
            parts.append(np.arange(at, at + n - window + 1))
        at += n
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def edits(a: list[str], b: list[str], most: int) -> int:
    """Edit distance in words, or `most` + 1 when it is larger."""
    if a == b:
        return 0
    if not most or abs(len(a) - len(b)) > most:
        return most + 1
    if most == 1 and len(a) == len(b):
        return min(sum(x != y for x, y in zip(a, b)), 2)  # one edit that keeps the length is a changed word
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y)))
        if min(row) > most:
            return most + 1
        prev = row
    return min(prev[-1], most + 1)


class Index:
    """Hashed windows of the items, sorted by hash, with what is needed to verify a hit."""

    def __init__(self, items: list[tuple[int, str]], embedding: Embedding, most: int):
        self.embedding, self.most = embedding, most
        self.words = [(item, words(text)) for item, text in items]
        flat = [w for _, ws in self.words for w in ws]
        lengths = [len(ws) for _, ws in self.words]
        starts = starts_of(lengths, embedding.length)
        self.ids = _ids(flat)
        self.offsets = offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        owner = np.searchsorted(offsets, starts, "right") - 1
        self.tables = []
        #: Low bits of a hash; far fewer hashes pass this table than are looked up.
        self.mask = np.uint64((1 << max(12, (16 * len(starts)).bit_length())) - 1)
        for h in embedding.hashes(self.ids, starts) if len(starts) else ():
            order = np.argsort(h, kind="stable")
            low = np.zeros(int(self.mask) + 1, bool)
            low[h & self.mask] = True
            self.tables.append((low, h[order], owner[order], (starts - offsets[owner])[order]))

    def hits(self, texts: list[list[str]]) -> Iterator[tuple[int, int, int]]:
        """Verified (text number, item, edits), each pair once with the fewest edits found."""
        window, most = self.embedding.length, self.most
        lengths = [len(t) for t in texts]
        starts = starts_of(lengths, window)
        if not len(starts) or not self.tables:
            return
        ids = np.concatenate([_ids(t) for t in texts])
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        best: dict[tuple[int, int], int] = {}
        span = np.arange(window)
        for lo in range(0, len(starts), _SLICE):
            part = starts[lo : lo + _SLICE]
            for (low, keys, owner, place), h in zip(self.tables, self.embedding.hashes(ids, part)):
                maybe = np.flatnonzero(low[h & self.mask])
                first, behind = np.searchsorted(keys, h[maybe], "left"), np.searchsorted(keys, h[maybe], "right")
                maybe, first, n = maybe[first < behind], first[first < behind], (behind - first)[first < behind]
                done = np.cumsum(n)
                for x in range(0, len(n), 4096):
                    # Every pair of a window and an equally hashed one of an item, as two lists of positions.
                    m = n[x : x + 4096]
                    entry = np.repeat(first[x : x + 4096] - (done[x : x + 4096] - m - (done[x - 1] if x else 0)), m) + np.arange(m.sum())
                    ours, theirs = np.repeat(part[maybe[x : x + 4096]], m), self.offsets[owner[entry]] + place[entry]
                    if most < 2:  # windows of one length that are one edit apart differ in one word
                        d = (ids[ours[:, None] + span] != self.ids[theirs[:, None] + span]).sum(axis=1)
                        near = np.flatnonzero(d <= most)
                        ours, entry, d = ours[near], entry[near], d[near]
                    else:
                        d = np.full(len(ours), most)
                    for at, e, least in zip(ours.tolist(), entry.tolist(), d.tolist()):
                        doc, item = int(np.searchsorted(offsets, at, "right") - 1), int(owner[e])
                        known = best.get((doc, item), most + 1)
                        if known > (0 if most > 1 else least):
                            at -= int(offsets[doc])
                            d1 = edits(self.words[item][1][place[e] : place[e] + window], texts[doc][at : at + window], known - 1)
                            if d1 < known:
                                best[doc, item] = d1
        for (doc, item), d in best.items():
            yield doc, self.words[item][0], d


_FOUND = "item long, doc long, edits int"


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, window: int = WINDOW, max_edits: int = 0, plan: tuple[int, int, int] | None = None) -> DataFrame:
    """`item, doc, edits`: every item and document that hold windows of `window` words at most `max_edits` edits apart.

    Pairs that share a window word for word are all listed. Of the others the listing has a recall, which `plan` (walks,
    samplings, positions) raises at more cost. Null and short texts hold no window; repeated rows collapse; texts of any
    length are read whole.
    """
    python_path(docs.sparkSession)
    if not 0 <= max_edits < window:
        raise ValueError("max_edits must be from 0 to one less than the window")
    embedding = Embedding(window, *(plan or PLANS.get(max_edits, PLANS[3])))
    held = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null").distinct()
    corpus = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).filter("doc is not null and text is not null")
    if (held.agg(F.sum(F.length("text") + 1)).first()[0] or 0) > MAX_ITEM_CHARS:
        return _joined(corpus, held, embedding, max_edits)
    shared = docs.sparkSession.sparkContext.broadcast(Index([(r["item"], r["text"]) for r in held.collect()], embedding, max_edits))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["doc"].tolist()
            out = [(item, ids[k], d) for k, item, d in shared.value.hits([words(t) for t in pdf["text"]])]
            yield pd.DataFrame(out, columns=["item", "doc", "edits"])

    return corpus.mapInPandas(scan, _FOUND).groupBy("item", "doc").agg(F.min("edits").alias("edits"))


def _joined(corpus: DataFrame, held: DataFrame, embedding: Embedding, max_edits: int) -> DataFrame:
    """The same by a shuffle join on the hashes, for a set of items too large to broadcast."""
    spark = corpus.sparkSession
    window, mask = embedding.length, np.uint64(FILTER_BITS - 1)

    def windows(name: str, known=None):
        """`name, bucket, sampling, name_words` of every window, or of those whose hash is in the filter."""

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            bits = None if known is None else np.frombuffer(known.value, np.uint8)
            for pdf in batches:
                for key, text in zip(pdf[name], pdf["text"]):
                    ws = words(text)
                    starts, ids = starts_of([len(ws)], window), _ids(ws)
                    for lo in range(0, len(starts), _SLICE):
                        part = starts[lo : lo + _SLICE]
                        for k, h in enumerate(embedding.hashes(ids, part)):
                            use = part
                            if bits is not None:
                                low = h & mask
                                has = (bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1
                                use, h = part[has], h[has]
                            yield pd.DataFrame({name: key, "bucket": h.view(np.int64), "sampling": k, f"{name}_words": pd.Series([" ".join(ws[s : s + window]) for s in use], dtype=object)})

        return cut

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = [edits(a.split(), b.split(), max_edits) for a, b in zip(pdf["item_words"], pdf["doc_words"])]
            yield pd.DataFrame({"item": pdf["item"], "doc": pdf["doc"], "edits": d})[lambda x: x["edits"] <= max_edits]

    left = held.mapInPandas(windows("item"), "item long, bucket long, sampling int, item_words string")
    # Spark's bitmaps count positions from 1; 32,768 of them to a row, so the filter has a fixed number of rows.
    place = F.col("bucket").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    rows = left.groupBy(F.bitmap_bucket_number(place).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits = bytearray(FILTER_BITS // 8)
    for r in rows:
        bits[(r["n"] - 1) * 4096 : r["n"] * 4096] = r["bits"]
    known = spark.sparkContext.broadcast(bytes(bits))
    right = corpus.mapInPandas(windows("doc", known), "doc long, bucket long, sampling int, doc_words string")
    met = left.join(right, ["bucket", "sampling"]).select("item", "doc", "item_words", "doc_words").distinct()
    return met.mapInPandas(verify, _FOUND).groupBy("item", "doc").agg(F.min("edits").alias("edits"))
