"""Flat unsigned integer token files with 64-bit document offsets.

Layout in one folder of the shared file system, for part k in ascending doc_id order:
``part-k-<attempt>.bin``  ids, little-endian, 2 bytes each if the vocabulary fits, else 4;
``part-k-<attempt>.idx``  per document doc_id and the end of its ids, counted in ids from the
start of the part, as little-endian signed 64-bit integers (two per document).
A task writes files of its own name and reports them only when they are whole, so the
manifest, which lists one attempt a part, is not touched by retries or lost executors.
The base of a part, which turns its offsets into offsets of the whole set, is the prefix sum
of the parts before it. The files are read back through a memory map.

Texts are encoded where they are read; what travels and is sorted by doc_id is the ids, about half a byte a
character. Parts are ranges between quantiles of doc_id, so many that each holds some ``PART`` bytes of ids; rows of
a doc_id that fills several ranges, or of none, are split over these by a hash of the text.

Defined results: a null or empty text is its end id alone; rows that share a doc_id follow
each other, ordered by a hash of their text; a null doc_id sorts first and is kept; a very long text is one row like
any other, in memory of some 10 times its size; an id too large for the files' integers ends the job; columns
besides doc_id and text are left out; an empty table gives no files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliogrid.llm.common import map_arrow, n_parts, new_folder, staged
from heliogrid.llm.tokens import batches, encoder

NULL_ID = -(2**63)
#: Characters of text that are encoded at a time.
BATCH = 2 << 20
#: Bytes of ids in one part.
PART = 64 << 20


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    at = urlparse(folder)
    if at.scheme in ("", "file"):
        return pafs.LocalFileSystem(), at.path
    return pafs.FileSystem.from_uri(folder)


def _bounds(rows: DataFrame, itemsize: int) -> np.ndarray:
    """Quantiles of doc_id between parts of about ``PART`` bytes; one that is there twice stands for a range of one doc_id."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-size * itemsize // (4 * PART))  # at four bytes of text a token
    if parts < 2:
        return np.zeros(0, np.int64)
    at = [k / parts for k in range(1, parts)]
    key = F.coalesce("doc_id", F.lit(NULL_ID))
    return np.array(rows.agg(F.percentile_approx(key, at, max(10_000, 20 * parts)).alias("q")).first()["q"], np.int64)


def _by_part(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows of one part."""
    for batch in it:
        part = batch.column("part").to_numpy()
        cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
        for s, e in zip(cuts, cuts[1:]):
            yield int(part[s]), batch.slice(s, e - s)


def write(docs: DataFrame, folder: str, path: str, end_id: int = 2, vocabulary: int | None = None) -> DataFrame:
    """Write the files; the manifest: part, bin, idx, n_docs, n_ids, first doc and base of every part.

    ``vocabulary``: ids are below it; by default the size of the tokenizer's.
    """
    vocabulary = vocabulary or encoder(path, end_id, False).library.get_vocab_size(with_added_tokens=True)
    kind = np.dtype("<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4")

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    bounds = _bounds(rows, kind.itemsize)

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end_id, False)
        for batch in it:
            keys, tie = batch.column("doc_id").fill_null(NULL_ID).to_numpy(), batch.column("tie").to_numpy()
            low, high = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
            part = low + tie % (high - low + 1)
            for first, texts in batches(batch.column("text").to_pylist(), BATCH):
                got = enc.encode_all(texts)
                here = slice(first, first + len(got))
                sizes = np.array(list(map(len, got))) // 4
                ids = np.frombuffer(b"".join(got), "<u4")
                if int(ids.max()) > np.iinfo(kind).max:
                    raise ValueError(f"id {ids.max()} doesn't fit into {kind.itemsize} bytes")
                raw, ends = ids.astype(kind).tobytes(), (np.cumsum(sizes) * kind.itemsize).tolist()
                parts = [raw[s:e] for s, e in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([pa.array(part[here]), pa.array(keys[here]), pa.array(tie[here]), pa.array(sizes), pa.array(parts, pa.binary())], ["part", "key", "tie", "n", "ids"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _place(folder)
        store.create_dir(top, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for part, runs in groupby(_by_part(it), key=lambda x: x[0]):
            name, n, docs_n = f"part-{part:06d}-{attempt}", 0, 0
            with store.open_output_stream(f"{top}/{name}.bin") as ids, store.open_output_stream(f"{top}/{name}.idx") as idx:
                for _, rows in runs:
                    ends = n + np.cumsum(rows.column("n").to_numpy())
                    n = int(ends[-1])
                    for x in rows.column("ids"):
                        ids.write(x.as_buffer())
                    idx.write(np.stack([rows.column("key").to_numpy(), ends], 1).astype("<i8").tobytes())
                    docs_n += rows.num_rows
            yield pa.RecordBatch.from_pydict({"part": [part], "bin": [f"{name}.bin"], "idx": [f"{name}.idx"], "n_docs": [docs_n], "n_ids": [n], "bytes": [kind.itemsize]})

    dealt = map_arrow(rows, encode, "part long, key long, tie long, n long, ids binary").repartition(len(bounds) + 1, "part").sortWithinPartitions("part", "key", "tie")
    done = staged(map_arrow(dealt, run, "part long, bin string, idx string, n_docs long, n_ids long, bytes long"), "manifest")
    # one row a part, so the prefix sum over parts fits one task: some 10 MB for a million parts of 64 MB
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return done.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (ids as unsigned 32-bit) of every document, from the files."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _place(folder)
        for batch in it:
            for row in batch.to_pylist():
                kind = f"<u{row['bytes']}"
                if isinstance(store, pafs.LocalFileSystem):
                    ids = np.memmap(f"{top}/{row['bin']}", kind, "r")
                    idx = np.memmap(f"{top}/{row['idx']}", "<i8", "r").reshape(-1, 2)
                else:
                    ids = np.frombuffer(store.open_input_file(f"{top}/{row['bin']}").read_buffer(), kind)
                    idx = np.frombuffer(store.open_input_file(f"{top}/{row['idx']}").read_buffer(), "<i8").reshape(-1, 2)
                if (len(idx), len(ids)) != (row["n_docs"], row["n_ids"]):
                    raise ValueError(f"{row['bin']} holds {len(ids)} ids of {len(idx)} documents; the manifest says otherwise")
                ends = np.array(idx[:, 1])
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                keys = np.array(idx[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, mask=keys == NULL_ID), pa.array(starts + row["base"]), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spark = manifest.sparkSession
    dealt = manifest.repartition(n_parts(spark), "part")
    return map_arrow(dealt, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int = 2, vocabulary: int | None = None, folder: str | None = None) -> DataFrame:
    folder = folder or new_folder(docs.sparkSession, "tokens")
    return read(write(docs, folder, path, end_id, vocabulary), folder)
