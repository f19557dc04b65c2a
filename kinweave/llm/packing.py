"""Texts into containers of a fixed number of tokens with little unused space.

Large lengths are sorted into groups of equal cardinality and rounded up to the largest of their group, so that few sizes
remain. A linear program over container configurations of these sizes is solved by column generation; its rounded-down
solution is filled with the actual texts of each group. What is left over is placed by best fit, longest first, and the
small texts fill what space remains, again by best fit.

Containers are formed within shards of bounded size, so only a few integers per text are shuffled, and no task grows with
how much text there is.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.tokens import VOCABULARY, tokenizer
from kinweave.session import checkpoint, python_path

CAPACITY = 1024
#: Mean number of texts in a shard.
SHARD = 20_000
#: Lengths above this part of the capacity are large.
LARGE = 1 / 8
GROUPS = 128


def _knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value of a container, with how many of each size; any number of a size that fits."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for k in np.argsort(-values / sizes):
        s, v = int(sizes[k]), float(values[k])
        if v <= 1e-12:
            continue
        for lo in range(s, capacity + 1, s):  # one block of length s at a time, so a size can be taken again
            hi = min(lo + s, capacity + 1)
            with_k = best[lo - s : hi - s] + v
            better = with_k > best[lo:hi] + 1e-12
            best[lo:hi][better] = with_k[better]
            choice[lo:hi][better] = k
    take = np.zeros(len(sizes), np.int64)
    at = int(np.argmax(best))
    while at > 0 and choice[at] >= 0:
        take[choice[at]] += 1
        at -= int(sizes[choice[at]])
    return float(values @ take), take


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int | None = None) -> list[tuple[np.ndarray, float]]:
    """Configurations with their amounts in a solution of the linear program: fewest containers that hold `counts` of `sizes`.

    Columns are generated until none would improve the solution. Degenerate steps could go on for ever, so there are at most
    50 a size, or `rounds`; what is found by then still holds everything, in a few containers more.
    """
    m = len(sizes)
    rounds = 50 * m if rounds is None else rounds
    basis = np.diag((capacity // sizes).astype(float))  # a column per configuration
    amount = counts / np.diag(basis)
    inverse = np.diag(1 / np.diag(basis))
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        value, take = _knapsack(np.maximum(prices, 0), sizes, capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ take
        usable = step > 1e-9
        if not usable.any():
            break
        ratio = np.where(usable, amount / np.where(usable, step, 1), np.inf)
        out = int(np.argmin(ratio))
        # Replace one column of the basis, and update its inverse.
        amount = amount - ratio[out] * step
        amount[out] = ratio[out]
        basis[:, out] = take
        inverse[out] /= step[out]
        for i in np.flatnonzero(np.abs(step) > 1e-12):
            if i != out:
                inverse[i] -= step[i] * inverse[out]
    return [(basis[:, j].astype(np.int64), float(amount[j])) for j in range(m)]


def pack(sizes: list[int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[int]:
    """The container number of each size, from 0. Every size lies between 1 and the capacity."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    large = [i for i in order if sizes[i] > capacity * LARGE]
    small = order[len(large) :]
    place = [-1] * len(sizes)
    free: list[int] = []  # by container

    def put(i: int, c: int) -> None:
        place[i] = c
        free[c] -= sizes[i]

    if large:
        g = min(groups, len(large))
        parts = [list(p) for p in np.array_split(np.array(large), g)]
        merged: dict[int, list[int]] = {}
        for p in parts:  # equal sizes are one size, whichever groups they fall into
            merged.setdefault(sizes[p[0]], []).extend(int(i) for i in p)
        rounded = np.array(sorted(merged, reverse=True))
        queues = [merged[s][::-1] for s in rounded.tolist()]
        for take, amount in configurations(rounded, np.array([len(q) for q in queues], float), capacity):
            for _ in range(int(amount + 1e-9)):
                if any(len(queues[k]) < n for k, n in enumerate(take)):
                    break
                free.append(capacity)
                for k in np.flatnonzero(take):
                    for _ in range(take[k]):
                        put(queues[k].pop(), len(free) - 1)
        small = sorted((i for q in queues for i in q), key=lambda i: (-sizes[i], i)) + small
    # Best fit: the fullest container that still has room. Open ones are kept in order of their space.
    open_ = sorted((f, c) for c, f in enumerate(free) if f)
    for i in small:
        k = bisect_left(open_, (sizes[i], -1))
        if k < len(open_):
            _, c = open_.pop(k)
        else:
            free.append(capacity)
            c = len(free) - 1
        put(i, c)
        if free[c]:
            insort(open_, (free[c], c))
    return place


_SIZES = "doc long, size long, form long"


def sizes(docs: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """`doc, size, form`: the tokens and the hash of every text; null texts count as empty."""
    python_path(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        for batch in batches:
            n = [tok.count(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2)], names=["doc", "size", "form"])

    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("form")).mapInArrow(count, _SIZES)


def containers(docs: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """`container, doc, part, first_token, tokens`: where every token of every text goes.

    Only texts above the capacity are split: into full containers of their own and a rest that is placed like any other text.
    Null and empty texts need no place and have no row. Repeated rows of a text are placed once; other
    texts of the same or no id have their own places. Ties are broken by the order of (doc, part, tokens, hash), so the result is the same each run.
    """
    n = docs.count()  # of the footers only, for a table of files
    shards = max(1, ceil(n / shard))
    sized = checkpoint(sizes(docs, doc_id, text, vocabulary).filter("size > 0").distinct())  # three integers a text; tokenized once
    full, rest = F.floor(F.col("size") / capacity).cast("long"), F.col("size") % capacity
    cap = F.lit(capacity).cast("long")
    whole = sized.filter(F.col("size") >= capacity).select("doc", "size", "form", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("part"))
    whole = whole.select(F.concat_ws("-", F.lit("full"), "doc", "size", "form", "part").alias("container"), "doc", "part", (F.col("part") * cap).alias("first_token"), cap.alias("tokens"))
    items = sized.filter(rest > 0).select("doc", full.alias("part"), (full * cap).alias("first_token"), rest.alias("tokens"), "form", F.pmod(F.xxhash64("doc", "size"), F.lit(shards)).alias("shard"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc", "part", "tokens", "form"], kind="stable")
        names = [f"{s}-{c}" for s, c in zip(pdf["shard"], pack(pdf["tokens"].tolist(), capacity))]
        return pd.DataFrame({"container": names, "doc": pdf["doc"], "part": pdf["part"], "first_token": pdf["first_token"], "tokens": pdf["tokens"]})

    return whole.unionByName(items.groupBy("shard").applyInPandas(fill, "container string, doc long, part long, first_token long, tokens long"))
