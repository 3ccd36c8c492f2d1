"""Best-fit packing of documents into sequences of bounded length, by large-item matching.

A sequence holds at most two pieces above one third of its capacity. So each shard first
takes the large pieces, longest first, and pairs each with the longest large piece that
still fits beside it (at most two in a bin); then the smaller pieces, longest first, go to
the bin whose gap they fill best, and open a bin only when no gap is wide enough.

Rows are dealt to shards by a hash of their number, about ``SHARD_TOKENS`` and at most about ``SHARD_ROWS``
each, so that every shard sees the same mix of lengths and equal rows don't meet in one; the cost of sharding
is at most a few bins each.
Only lengths travel: the texts are encoded where they are read.

Defined results: a null or empty text is its end id alone; repeated rows are packed once
each; a null doc_id is packed like any other; pieces of equal length go in order of doc_id and start; a
very long text is one row like any other, in memory of some 10 times its size; columns besides doc_id and text are
left out; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogrid.llm.common import group_arrow, map_arrow, staged
from heliogrid.llm.tokens import batches, encoder

#: Characters of text that are encoded at a time, where memory counts more than time and else.
BATCH, WIDE_BATCH = 1 << 20, 8 << 20
SHARD_TOKENS = 8_000_000
SHARD_ROWS = 250_000


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, lean: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Longer documents are cut, the short piece first.

    ``lean``: workers that other stages use too encode less at a time, and give most of their memo back after a task.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end_id, True)
        for batch in it:
            ids = batch.column("doc_id")
            for first, texts in batches(batch.column("text").to_pylist(), BATCH if lean else WIDE_BATCH):
                rows: list[tuple[int, int, int, int, int]] = []
                for k, b in enumerate(enc.encode_all(texts), first):
                    n = len(b) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    rows += [(k, j, s, e - s, zlib.crc32(b[4 * s : 4 * e])) for j, (s, e) in enumerate(zip(cuts, cuts[1:]))]
                a = np.array(rows, np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(a[:, 0])), pa.array(a[:, 1].astype(np.int32)), pa.array(a[:, 2]), pa.array(a[:, 3]), pa.array(a[:, 4])],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        if lean:
            enc.rest()

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Gaps:
    """Open bins by free space: the smallest gap of at least a width is a bit scan."""

    def __init__(self, capacity: int):
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, gap: int, b: int) -> None:
        self.bins[gap].append(b)
        self.mask |= 1 << gap

    def best(self, width: int) -> tuple[int, int] | None:
        m = self.mask >> width
        if not m:
            return None
        gap = width + (m & -m).bit_length() - 1
        b = self.bins[gap].pop()
        if not self.bins[gap]:
            self.mask &= ~(1 << gap)
        return gap, b


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; every length is 1 to ``capacity``."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    third = capacity // 3  # three pieces longer than this can't share a sequence
    n_large = int(np.searchsorted(-lengths[order], -third, side="left"))
    gaps, opened = _Gaps(capacity), 0
    # the large pieces, by length: each bin takes its longest, then the longest one left that fits
    left: list[list[int]] = [[] for _ in range(capacity + 1)]
    present = 0
    for i in order[:n_large][::-1].tolist():
        w = int(lengths[i])
        left[w].append(i)
        present |= 1 << w

    def take(most: int) -> int | None:
        nonlocal present
        m = present & ((1 << (most + 1)) - 1)
        if not m:
            return None
        w = m.bit_length() - 1
        i = left[w].pop()
        if not left[w]:
            present &= ~(1 << w)
        return i

    while (i := take(capacity)) is not None:
        bins[i], gap = opened, capacity - int(lengths[i])
        if (j := take(gap)) is not None:
            bins[j], offsets[j] = opened, lengths[i]
            gap -= int(lengths[j])
        if gap:
            gaps.add(gap, opened)
        opened += 1
    for i in order[n_large:].tolist():
        w = int(lengths[i])
        gap, b = gaps.best(w) or (capacity, opened)
        opened += b == opened
        bins[i], offsets[i] = b, capacity - gap
        if gap > w:
            gaps.add(gap - w, b)
    return bins, offsets


def packed(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` rows with sequence_id and offset."""
    cut = staged(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")  # written at once, so the numbers hold
    total, n = cut.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-total // SHARD_TOKENS), -(-n // SHARD_ROWS))

    def one(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        b, o = pack(t.column("length").to_numpy(), capacity)
        t = t.append_column("sequence_id", pa.array(b * shards + key[0].as_py())).append_column("offset", pa.array(o))
        return t.drop_columns(["shard", "row"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return group_arrow(dealt, ["shard"], one, schema)


def best_fit(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, lean: bool = True) -> DataFrame:
    """Pieces of ``docs`` with the sequence and the place in it that each takes."""
    return packed(pieces(docs, path, capacity, end_id, lean), capacity)
