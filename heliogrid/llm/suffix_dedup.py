"""Removal of every byte of a long passage that occurs elsewhere, by a difference-cover suffix sort.

The suffix order is needed to the depth of the passage length L only, so the algorithm is the
difference-cover one, bounded in depth and with unique names discarded:

1. *Sampled tuples.* Positions i of a document with i mod v in a difference cover D (v = q*q + q + 1,
   |D| = q + 1) are named by their next w = L - v + 1 bytes. Tuples are dealt over tasks by name and
   sorted there. For any two equal passages of L bytes at i and j there is d < v with i + d and j + d
   both sampled, and their tuples lie inside the passages. So a sampled position whose name is
   unique cannot lie in a repeated passage at such a d, and is discarded.
2. *Names of names.* The name of L bytes at i is made from the names at i, i + (L - w) / 2 and
   i + L - w, which together cover the L bytes. The depth is bounded, so one such step takes the place of
   the recursion.
3. *Merge of the remaining suffixes.* All positions that reach a surviving sample, sampled or not,
   are sorted by that name, dealt over tasks by it.
4. *Adjacent prefixes.* Neighbours with equal names are compared byte for byte: of the passages that are
   to go, some are chosen that cover all their bytes, and each goes to the block that stands before its
   own in the sorted order of the name, which compares L bytes. Only then anything is removed.

Names are 64-bit hashes and not ranks, so the order among them is not that of the bytes: full ranks would
have to move every sampled tuple's bytes, several times the input. Equal bytes have equal names, so
no repeat is missed; a comparison that fails shows two passages of one name, and then all is done again with
another hash function. Texts travel as compressed blocks; a task sends each distinct name of a block once,
so a passage with very many copies costs one entry a block. Documents that equal another one (128-bit
cryptographic digest) are found first and go whole; one of each group stays in the sort.

Defined results: a null or empty text has 0 bytes and no span; texts shorter than L stay whole;
rows that repeat are documents of their own, and so each other's copies, so all of them lose the passage (no
copy is preferred); other columns pass through (clashing result names: the result wins); an empty table gives
no rows; one text is never split over blocks, so a task needs about 60 times the bytes of its longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliogrid.llm.common import group_arrow, map_arrow, n_parts, staged
from heliogrid.llm.hashing import U, mix, window_hashes

BLOCK = 2 << 20
#: Column that holds the columns besides the text.
OTHERS = "__others"
#: Hash functions that are tried before giving up.
ATTEMPTS = 4
#: Bytes of text whose names make up one part.
PART = 16 << 20
RESULT = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "spans": "array<struct<start:long,end:long>>", "kept": "string"}


@cache
def difference_cover(q: int) -> tuple[int, tuple[int, ...]]:
    """(v, D) for a prime q: exponents i below v = q*q + q + 1 whose power of a root x has no square term in GF(q)[x]."""
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):  # x**3 = a x**2 + b x + c
                x2, x1, x0, found = 0, 0, 1, []
                for i in range(v):
                    if x2 == 0:
                        found.append(i)
                    x2, x1, x0 = (x1 + a * x2) % q, (x0 + b * x2) % q, c * x2 % q
                if len(found) == q + 1 and len({(i - j) % v for i in found for j in found}) == v:
                    return v, tuple(found)
    raise ValueError(f"no cover for {q}")


class _Block:
    """One block of documents with the names of its windows."""

    def __init__(self, row: dict, length: int, q: int, parts: int, names: tuple[int, int] | None):
        """``names``: seed and bits of the hash; None where no names are needed."""
        self.lens = np.array(row["lens"], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.raw = zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=int(self.lens.sum()) or 1) if self.lens.sum() else b""
        self.b = np.frombuffer(self.raw, np.uint8)
        self.length, self.parts = length, parts
        self.v, cover = difference_cover(q)
        self.w = length - self.v + 1
        self.copy = np.zeros(len(self.lens), bool)
        if names is None:
            return
        seed, self.bits = names
        rep = np.zeros(len(self.lens), bool)
        for x in row.get("copies") or []:
            self.copy[x["pos"]] = True
            rep[x["pos"]] = x["rep"]
        active = (self.lens >= length) & (rep | ~self.copy)
        self.pos = (np.arange(len(self.b)) - np.repeat(self.starts, self.lens)).astype(np.int32)
        self.rest = np.repeat(np.where(active, self.lens, 0), self.lens).astype(np.int32) - self.pos
        self.h = window_hashes(self.b, self.w, seed)
        self.in_cover = np.zeros(self.v, bool)
        self.in_cover[list(cover)] = True

    def _names(self, at: np.ndarray, x: np.ndarray, part: np.ndarray) -> tuple:
        """Places; of each the number of its name; of the names their count here, part, value, first and last place."""
        order = np.lexsort((x, part))
        p, s = part[order], x[order]
        new = np.ones(len(s), bool)
        new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
        number = np.empty(len(s), np.int64)
        number[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        count = np.diff(np.concatenate([first, [len(s)]]))
        return at, number, count, p[first], s[first], at[order[first]], at[order[first + count - 1]]

    def samples(self) -> tuple:
        at = np.flatnonzero(self.in_cover[self.pos % self.v] & (self.rest >= self.w))
        x = self._few(self.h[at])
        return self._names(at, x.astype(np.uint32), ((x >> U(40)) % U(self.parts)).astype(np.int64))

    def candidates(self, named: dict[int, bytes]) -> tuple:
        """Positions of L-byte passages that reach a sample whose name is repeated."""
        at, number, count, part, *_ = self.samples()
        hit = at[((count > 1) | _marks(part, named)[0])[number]]
        n = len(self.b)
        near = _covered(hit - np.minimum(self.v - 1, self.pos[hit]), hit + 1, n)
        at = np.flatnonzero(near & (self.rest >= self.length))
        half = (self.length - self.w) // 2
        x = self._few(mix(self.h[at] * U(0xA24BAED4963EE407) + mix(self.h[at + half] + U(0x9FB21C651E98DF25)) + self.h[at + self.length - self.w] * U(0xD6E8FEB86659FD93)))
        return self._names(at, x, ((x >> U(40)) % U(self.parts)).astype(np.int64))

    def _few(self, x: np.ndarray) -> np.ndarray:
        return x if self.bits == 64 else mix(x >> U(64 - self.bits))

    def windows(self, at: np.ndarray) -> np.ndarray:
        """The L bytes at each place, a row each."""
        return np.lib.stride_tricks.sliding_window_view(self.b, self.length)[at] if len(at) else np.zeros((0, self.length), np.uint8)

    def removed(self, named: dict[int, tuple], repeated: dict[int, tuple]) -> tuple:
        """Which bytes go; whether neighbours in this block differ under one name; and of passages to compare elsewhere the block, name and place."""
        at, number, count, part, names, first, last = self.candidates(named)
        flags, holder = _marks(part, repeated)
        bad = np.flatnonzero(((count > 1) | flags)[number])
        n = len(self.b)
        gone = _covered(at[bad], at[bad] + self.length, n)
        doc = np.repeat(np.arange(len(self.lens)), self.lens)
        chosen = bad[~self.copy[doc[at[bad]]]]
        chosen = chosen[_cover(at[chosen], self.length)]
        gone |= np.repeat(self.copy & (self.lens >= self.length), self.lens)
        k, place = number[chosen], at[chosen]
        here = count[k] > 1
        k_here, mine = k[here], place[here]
        other = np.where(first[k_here] != mine, first[k_here], last[k_here])
        odd = bool((self.windows(mine) != self.windows(other)).any())
        return gone, odd, holder[k[~here]], names[k[~here]], place[~here]

    def differing(self, named: dict[int, tuple], asked: list[dict]) -> int:
        """How many of the asked passages are not what stands here under their names."""
        _, _, _, _, names, first, _ = self.candidates(named)
        order = np.argsort(names)
        odd = 0
        for x in asked:
            want = np.frombuffer(x["names"], "<u8")
            k = np.minimum(np.searchsorted(names, want, sorter=order), max(0, len(names) - 1))
            if not len(names) or (names[order[k]] != want).any():
                odd += len(want)
                continue
            data = np.frombuffer(zstandard.decompress(x["data"]), np.uint8).reshape(-1, self.length)
            odd += int((self.windows(first[order[k]]) != data).any(1).sum())
        return odd


def _cover(at: np.ndarray, length: int) -> list[int]:
    """Numbers of some of the passages (places in order) that cover all bytes that all of them cover."""
    out: list[int] = []
    k = 0
    while k < len(at):
        out.append(k)
        to = int(np.searchsorted(at, at[k] + length, side="right")) - 1  # the last one that leaves no gap
        k = to if to > k else k + 1
    return out


def _covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step, dtype=np.int32)[:n] > 0


def _marks(part: np.ndarray, got: dict[int, tuple[bytes, bytes | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the names (sorted by part), from one packed bit string a part; and the block before this one in the order of a flagged name."""
    out, holder = np.zeros(len(part), bool), np.full(len(part), -1, np.int64)
    edges = np.flatnonzero(np.diff(part)) + 1
    for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(part)]):
        if e > s and (hit := got.get(int(part[s]))):
            out[s:e] = np.unpackbits(np.frombuffer(zstandard.decompress(hit[0]), np.uint8), count=e - s).astype(bool)
            if hit[1] is not None:
                planes = np.frombuffer(zstandard.decompress(hit[1]), np.uint8).reshape(8, -1)
                holder[s:e][out[s:e]] = np.ascontiguousarray(planes.T).view("<i8").ravel()
    return out, holder


def _as_dict(x: list[dict] | None) -> dict[int, tuple[bytes, bytes | None]]:
    return {y["part"]: (y["bits"], y["before"]) for y in x or []}


def _blocks(docs: DataFrame, text: str) -> DataFrame:
    """Rows of about ``BLOCK`` bytes of text, compressed, with the other columns packed beside them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, task, made = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
        for batch in it:
            texts = [(t or "").encode() for t in batch.column(text).to_pylist()]
            others = pa.RecordBatch.from_struct_array(batch.column(OTHERS))
            first = 0
            while first < len(texts):
                last, n = first, 0
                while last < len(texts) and (last == first or n + len(texts[last]) <= BLOCK):
                    n += len(texts[last])
                    last += 1
                part = texts[first:last]
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, others.schema) as out:
                    out.write_batch(others.slice(first, last - first))
                marks = [int.from_bytes(hashlib.blake2b(t, digest_size=16).digest()) for t in part]
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": [task << 32 | made],
                        "lens": [[len(t) for t in part]],
                        "mark": [[x.to_bytes(16) for x in marks]],
                        "text": [squeeze.compress(b"".join(part))],
                        "others": [sink.getvalue().to_pybytes()],
                    }
                )
                first, made = last, made + 1

    return staged(map_arrow(docs, run, "block long, lens array<long>, mark array<binary>, text binary, others binary"), "blocks")


def _copies(blocks: DataFrame, length: int) -> DataFrame:
    """Per block the documents that equal another one, and which of them stand for their group."""
    docs = blocks.select("block", F.posexplode(F.arrays_zip("lens", "mark"))).select("block", "pos", "col.*").where(F.col("lens") >= length)
    groups = docs.groupBy("mark").agg(F.min(F.struct("block", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = staged(groups.select("mark", "first"), "groups")  # a table of its own, so that Spark can split a large group in the join
    found = docs.join(groups, "mark").select("block", F.struct("pos", (F.struct("block", "pos") == F.col("first")).alias("rep")).alias("x"))
    return found.groupBy("block").agg(F.collect_list("x").alias("copies"))


def _exchange(sent: DataFrame, kind: str, neighbours: bool = False) -> DataFrame:
    """Bit strings a (block, part): which of the names that the block sent occur in other blocks too; and the block before it in the order of each of these."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        blocks = t.column("block").to_numpy()
        got = [np.frombuffer(x, kind) for x in t.column("names").to_pylist()]
        sizes = list(map(len, got))
        names, block = np.concatenate(got), np.repeat(blocks, sizes)
        order = np.lexsort((block, names)) if neighbours else np.argsort(names, kind="stable")
        s = names[order]
        same = np.concatenate([[False], s[1:] == s[:-1], [False]])
        flags = np.empty(len(s), bool)
        flags[order] = same[1:] | same[:-1]
        cuts = np.cumsum(sizes)[:-1]
        bits = [zstandard.compress(np.packbits(f).tobytes()) if f.any() else None for f in np.split(flags, cuts)]
        before = [None] * len(bits)
        if neighbours:
            first = np.flatnonzero(~same[:-1])
            last = np.concatenate([first[1:], [len(s)]]) - 1
            prior = np.arange(len(s)) - 1
            prior[first] = last  # the first of a name follows the last
            held = np.empty(len(s), np.int64)
            held[order] = block[order[prior]]
            before = [zstandard.compress(np.ascontiguousarray(h[f].view(np.uint8).reshape(-1, 8).T).tobytes()) if f.any() else None for h, f in zip(np.split(held, cuts), np.split(flags, cuts))]
        out = pa.table({"block": pa.array(blocks), "part": pa.array([key[0].as_py()] * len(got), pa.int64()), "bits": pa.array(bits, pa.binary()), "before": pa.array(before, pa.binary())})
        return out.filter(out.column("bits").is_valid())

    back = group_arrow(sent, ["part"], run, "block long, part long, bits binary, before binary")
    return back.groupBy("block").agg(F.collect_list(F.struct("part", "bits", "before")).alias("back"))


def _sent(block: int, named: tuple, kind: str) -> pa.RecordBatch:
    _, _, _, part, names, *_ = named
    edges = np.flatnonzero(np.diff(part)) + 1
    ranges = [(s, e) for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(part)]) if e > s]
    return pa.RecordBatch.from_arrays(
        [pa.array([int(part[s]) for s, _ in ranges], pa.int64()), pa.array([block] * len(ranges), pa.int64()), pa.array([names[s:e].astype(kind).tobytes() for s, e in ranges], pa.binary())],
        ["part", "block", "names"],
    )


def _each(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in it:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _found(blocks: DataFrame, copies: DataFrame, length: int, q: int, parts: int, names: tuple[int, int]) -> DataFrame | None:
    """(block, gone): the byte ranges of every block that go; None if two passages of one name differ."""
    base = blocks.select("block", "lens", "text").join(copies, "block", "left")

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(it):
            yield _sent(row["block"], _Block(row, length, q, parts, names).samples(), "<u4")

    sent = "part long, block long, names binary"
    named = staged(_exchange(map_arrow(base, first, sent), "<u4").withColumnRenamed("back", "named"), "named")
    side = copies.join(named, "block", "full")

    def second(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(it):
            yield _sent(row["block"], _Block(row, length, q, parts, names).candidates(_as_dict(row["named"])), "<u8")

    near = blocks.select("block", "lens", "text").join(side, "block")
    repeated = staged(_exchange(map_arrow(near, second, sent), "<u8", neighbours=True).withColumnRenamed("back", "repeated"), "repeated")

    def third(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for row in _each(it):
            block = _Block(row, length, q, parts, names)
            gone, odd, holder, name, place = block.removed(_as_dict(row["named"]), _as_dict(row["repeated"]))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            cols: list[list] = [[row["block"]], [None], [edge.astype("<u4").tobytes()], [odd], [None], [None]]
            order = np.lexsort((name, holder))
            cuts = np.flatnonzero(np.diff(holder[order], prepend=-1)).tolist()
            for s, e in zip(cuts, [*cuts[1:], len(order)]):
                at = order[s:e]
                for c, x in zip(cols, (row["block"], int(holder[at[0]]), None, False, name[at].astype("<u8").tobytes(), squeeze.compress(block.windows(place[at]).tobytes()))):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["block", "holder", "gone", "odd", "names", "data"])

    # all blocks: some have repeats among their own documents only
    known = base.join(named, "block", "left").join(repeated, "block", "left")
    chosen = staged(map_arrow(known, third, "block long, holder long, gone binary, odd boolean, names binary, data binary"), "chosen")

    def fourth(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(it):
            yield pa.RecordBatch.from_pydict({"odd": [_Block(row, length, q, parts, names).differing(_as_dict(row["named"]), row["asked"])]})

    asked = chosen.where("holder is not null").groupBy(F.col("holder").alias("block")).agg(F.collect_list(F.struct("names", "data")).alias("asked"))
    differ = map_arrow(near.join(asked, "block"), fourth, "odd long").agg(F.sum("odd")).first()[0] or 0
    if differ or not chosen.where("odd").isEmpty():
        return None
    return chosen.where("gone is not null").select("block", "gone")


def dedup(docs: DataFrame, length: int = 200, text: str = "text", q: int = 11, with_text: bool = True, name_bits: int = 64) -> DataFrame:
    """Other columns of ``docs`` with n_bytes, n_removed, n_spans, kept_sha256, spans and kept.

    ``spans`` are the removed byte ranges; ``kept`` is the rest as text, where a character that was
    cut apart is dropped (``kept_sha256`` is of the bytes); without ``with_text`` both are null. ``q`` is a prime with
    q*q + q < length. ``name_bits``: of the names at the first attempt; fewer than 64 make names collide, for tests.
    """
    if difference_cover(q)[0] + 2 > length or 3 * (length - difference_cover(q)[0] + 1) < length:
        raise ValueError("length must leave three tuples that cover it: choose a smaller q")
    own = [c for c in docs.columns if c != text and c not in RESULT]
    # as one struct, so that names with dots in them pass; one field more, as a struct can't be without any
    packed = F.struct(*[F.col(f"`{c}`") for c in own], F.lit(0).alias(OTHERS)).alias(OTHERS)
    docs = docs.select(packed, F.col(f"`{text}`").alias("__text"))
    blocks = _blocks(docs, "__text")
    size = blocks.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    parts = max(n_parts(docs.sparkSession), -(-size // PART))
    copies = staged(_copies(blocks, length), "copies")
    for seed in range(ATTEMPTS):
        found = _found(blocks, copies, length, q, parts, (seed, 64 if seed else name_bits))
        if found is not None:
            break
    else:
        raise RuntimeError("different passages had equal names under every hash function")

    def last(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(it):
            others = next(iter(pa.ipc.open_stream(row["others"])))
            block = _Block(row, length, q, parts, None)
            edge = np.frombuffer(row["gone"] or b"", "<u4").astype(np.int64)
            out: dict[str, list] = {c: [] for c in RESULT}
            for s, n in zip(block.starts.tolist(), block.lens.tolist(), strict=True):
                i, j = np.searchsorted(edge[1::2], s, side="right"), np.searchsorted(edge[0::2], s + n)
                spans = [(max(0, a - s), min(n, b - s)) for a, b in zip(edge[0::2][i:j].tolist(), edge[1::2][i:j].tolist())] if n else []
                raw = block.raw[s : s + n]
                kept = b"".join(raw[a:b] for a, b in zip([0, *[b for _, b in spans]], [*[a for a, _ in spans], n], strict=True)) if spans else raw
                out["n_bytes"].append(n)
                out["n_removed"].append(n - len(kept))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["spans"].append([{"start": a, "end": b} for a, b in spans] if with_text else None)
                out["kept"].append(kept.decode(errors="ignore") if with_text else None)
            kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
            cols = [pa.array(out[c], kinds.get(c, pa.string())) for c in RESULT]
            packed = pa.StructArray.from_arrays(others.columns, fields=list(others.schema))
            yield pa.RecordBatch.from_arrays([packed, *cols], [OTHERS, *RESULT])

    final = blocks.drop("mark").join(found, "block", "left")
    schema = T.StructType([docs.schema[OTHERS], *[T.StructField(c, T._parse_datatype_string(t)) for c, t in RESULT.items()]])
    return map_arrow(final, last, schema).select(*[F.col(f"{OTHERS}.`{c}`").alias(c) for c in own], *RESULT)
