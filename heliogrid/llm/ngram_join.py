"""Exact n-gram Jaccard join: a blocked sparse product of the document by n-gram matrix.

Rows are the distinct shingle sets, columns the shingles. The product of the matrix with its
transpose counts overlaps, and a size-derived bound discards pairs early:

* Columns are ordered from rare to common (a fixed-size sketch of column counts over all
  documents; the order affects cost, never the result). A set of n shingles can only reach
  ``t = 0.75`` with another if both hold a common column among the first
  ``n - ceil(t n) + 1`` of each, so the product is formed over these prefixes only.
* The prefixes are dealt over tasks in blocks of columns; each block sums the overlaps of its
  pairs before they travel. Of two sets, one has its last prefix column first; all its later
  columns number ``ceil(t n) - 1``, so a pair whose prefix overlap plus that bound stays
  below ``ceil(3 (na + nb) / 7)`` is dropped. What is left is verified on the whole sets.
* A column shared by many sets doesn't emit all its pairs. It meets every set with a few hubs, and in some
  more rounds with members of the column's largest component; the verified links form components. Sets of
  a crowded column that are then still in different components are settled exactly (``_settle``): their
  whole sets are counted once more among themselves. Two of them that share a column of few sets are
  verified as a pair. Two that share none overlap in crowded columns alone, so all sets with the same crowded
  columns form a class, in which only sizes differ: the smallest member links with whatever any member links
  with. Classes are compared in blocks by exact overlap, and a block emits a spanning forest of
  its links and the best partner of each class, at most a few rows for each row it has read.

So no link between different texts is lost, while a group of very many near copies, or of texts around one
common passage, costs a few rows a text. The number of column parts follows the number of shingles.

Equal sets share one row of the matrix (keyed by a 63-bit hash of the set), so exact copies cost
nothing but their membership row. Every set has a second hash of its own: where it tells apart sets of one key, all sets of
that key take it as their key in place of the first (``_keys``), so that different sets don't pass for copies. Shingles are 64-bit hashes.

Defined results: a null, empty or blank text has no shingle and is linked with nothing (component:
its own doc_id); rows that share a doc_id belong to one component; a null doc_id takes part, and
is the component only where no other id is in it; an empty table gives no rows; a very long text is one set
like any other, in memory in proportion to its length; columns besides doc_id and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogrid.llm.common import components, group_arrow, joined_components, map_arrow, n_parts, scratch, spanning_forest, staged
from heliogrid.llm.hashing import U, mix, shingle_sets
from heliogrid.llm.tokens import batches

#: Buckets of the sketch of column counts: 4 MB, whatever the input.
SKETCH = 1 << 20
SLICES = 16
#: A column with more sets than this links them through hubs first.
ALL_PAIRS = 16
HUBS = 3
ROUNDS = 3
#: Classes of a bundle of crowded columns that meet in one task, on either side.
PIECE = 1000
#: Keys that may stand for several sets each: some 500 are expected of 10**11 different sets, 50,000 of 10**12.
CLASHES = 1_000_000
#: Characters of text that are hashed at a time: some 100 bytes of arrays for each.
BATCH = 1 << 19
#: Shingles whose prefixes make up one part of the columns.
PART = 4_000_000
#: Shingles of whole sets that make up one part, where sets of crowded columns are counted once more.
WHOLE = 1_000_000


def _need(n: np.ndarray | Column):
    """Least overlap of a set of n shingles with any other at 0.75."""
    return (3 * n + 3) // 4 if isinstance(n, np.ndarray) else F.ceil(F.lit(3) * n / F.lit(4))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    for first, texts in batches(batch.column("text").to_pylist(), BATCH):
        doc, sh = shingle_sets([t.encode() for t in texts])
        yield first, doc, sh, len(texts)


class _Keys(NamedTuple):
    """Bits of the first hash of a set, and its values that stand for several sets."""

    bits: int
    clashes: np.ndarray


class _Rows(NamedTuple):
    docs: DataFrame
    sets: DataFrame
    keys: _Keys


def _hash(doc: np.ndarray, sh: np.ndarray, n: np.ndarray, salt: int, bits: int = 63) -> np.ndarray:
    """Hash of every set (0 for the empty one), another for each salt."""
    sums = np.zeros(len(n), U)
    if len(doc):
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        sums[doc[first]] = np.add.reduceat(mix(sh ^ U(salt)), first)
    return np.where(n > 0, mix(sums + n.astype(U)) >> U(64 - bits), U(0)).astype(np.int64)


def _first(doc: np.ndarray, sh: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    return _hash(doc, sh, n, 0x5851F42D4C957F2D, bits)


def _second(doc: np.ndarray, sh: np.ndarray, n: np.ndarray) -> np.ndarray:
    return _hash(doc, sh, n, 0x2545F4914F6CDD1D)


def _nodes(doc: np.ndarray, sh: np.ndarray, n: np.ndarray, keys: _Keys) -> np.ndarray:
    """Key of every set."""
    node = _first(doc, sh, n, keys.bits)
    if len(keys.clashes) and (at := np.isin(node, keys.clashes) & (n > 0)).any():
        node = np.where(at, _second(doc, sh, n), node)
    return node


def _keys(counted: DataFrame, bits: int) -> tuple[DataFrame, _Keys]:
    """(doc_id, key, n, node) of every document under keys that no two different sets share."""
    sets = counted.where("slice is null")

    def shared(node: Column) -> list[int]:
        per = sets.where("n > 0").groupBy(node.alias("node")).agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min("other").alias("least"), F.max("other").alias("most"))
        return [r["node"] for r in per.where("lo <> hi or least <> most").select("node").limit(CLASHES + 1).collect()]

    clashes, node = shared(F.col("node")), F.col("node")
    if clashes:
        node = F.when((F.col("n") > 0) & F.col("node").isin(clashes), F.col("other")).otherwise(F.col("node"))
        if len(clashes) > CLASHES or shared(node):
            raise ValueError("too many different sets for keys of 63 bits")
    return sets.select("doc_id", "key", "n", node.alias("node")), _Keys(bits, np.array(clashes, np.int64))


def _count(docs: DataFrame, bits: int) -> DataFrame:
    """Of every document its set's size and hashes; and slices of the sketch of column counts, one set a task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = np.zeros(SKETCH, np.int64), ["doc_id", "key", "n", "node", "other", "slice", "counts"]
        for batch in it:
            for first, doc, sh, size in _texts(batch):
                n = np.bincount(doc, minlength=size)
                counts += np.bincount((sh & U(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
                ids, keys = (batch.column(c).slice(first, size) for c in ("doc_id", "key"))
                none = pa.nulls(size, pa.int64())
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array(n), pa.array(_first(doc, sh, n, bits)), pa.array(_second(doc, sh, n)), none, pa.nulls(size, pa.binary())], names)
        if counts.any():
            parts = [zstandard.compress(x.astype("<u4").tobytes()) for x in np.split(counts, SLICES)]
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(range(SLICES), pa.int64()), pa.array(parts, pa.binary())], names)

    return staged(map_arrow(docs, run, "doc_id long, key long, n long, node long, other long, slice long, counts binary"), "sets")


def _sketch(counted: DataFrame) -> np.ndarray:
    """The summed sketch: a fixed size, so the driver can hold and broadcast it."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH // SLICES, np.int64)
        for x in t.column("counts"):
            total += np.frombuffer(zstandard.decompress(x.as_py()), "<u4")
        return pa.table({"slice": [key[0].as_py()], "counts": [np.minimum(total, 2**32 - 1).astype("<u4").tobytes()]})

    rows = group_arrow(counted.where("slice is not null").select("slice", "counts"), ["slice"], run, "slice long, counts binary").collect()
    out = np.zeros(SKETCH, "<u4")
    size = SKETCH // SLICES
    for r in rows:
        out[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["counts"], "<u4")
    return out


def _prefixes(docs: DataFrame, sketch: np.ndarray, parts: int, keys: _Keys) -> DataFrame:
    """Blocks of columns: of some documents the prefix columns in one part, packed row by row."""
    held = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = held.value
        for batch in it:
            for _, doc, sh, size in _texts(batch):
                n = np.bincount(doc, minlength=size)
                node = _nodes(doc, sh, n, keys)
                _, once = np.unique(node, return_index=True)  # copies within the block count once
                mine = np.zeros(size, bool)
                mine[once] = True
                at = mine[doc]
                doc, sh = doc[at], sh[at]
                order = np.lexsort((sh, common[(sh & U(SKETCH - 1)).astype(np.int64)], doc))
                doc, sh = doc[order], sh[order]
                rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
                at = rank < (n - _need(n) + 1)[doc]
                doc, sh = doc[at], sh[at]
                part = ((sh >> U(34)) % U(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                doc, sh, part = doc[order], sh[order].astype("<u4"), part[order]
                edges = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
                cols: list[list] = [[], [], [], [], []]
                for s, e in zip(edges, [*edges[1:], len(part)]):
                    rows, counts = np.unique(doc[s:e], return_counts=True)
                    for c, x in zip(cols, (int(part[s]), node[rows].tobytes(), n[rows].astype("<u4").tobytes(), counts.astype("<u4").tobytes(), sh[s:e].tobytes())):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["part", "nodes", "ns", "counts", "columns"])

    return map_arrow(docs, run, "part long, nodes binary, ns binary, counts binary, columns binary")


def _pairs_within(node: np.ndarray, n: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(a, b, overlap) of the sets that share a column of at most ``ALL_PAIRS`` sets, summed over columns."""
    found: list[np.ndarray] = []
    for m in range(2, ALL_PAIRS + 1):
        s = starts[sizes == m]
        if len(s):
            i, j = np.triu_indices(m, 1)
            found.append(np.stack([(s[:, None] + i).ravel(), (s[:, None] + j).ravel()], 1))
    at = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return _summed(node, n, at[:, 0], at[:, 1])


def _summed(node: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
    ok = 4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])
    i, j = i[ok], j[ok]
    a, b = node[i], node[j]
    swap = a > b
    a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, n[j], n[i]), np.where(swap, n[i], n[j])
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    return a[first], b[first], na[first], nb[first], np.diff(np.concatenate([first, [len(a)]]))


def _product(prefixes: DataFrame) -> DataFrame:
    """Overlaps of pairs in each part (``shared``; ``hub``: counts of hub pairs), and the rows of crowded columns."""
    names = ["a", "b", "na", "nb", "shared", "hub", "column"]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        part = key[0].as_py()
        get = lambda c, k: np.concatenate([np.frombuffer(x.as_py(), k) for x in t.column(c)])
        counts = get("counts", "<u4")
        node, n, col = np.repeat(get("nodes", "<i8"), counts), np.repeat(get("ns", "<u4").astype(np.int64), counts), get("columns", "<u4")
        order = np.lexsort((node, col))
        node, n, col = node[order], n[order], col[order]
        new = np.ones(len(col), bool)
        new[1:] = (col[1:] != col[:-1]) | (node[1:] != node[:-1])
        node, n, col = node[new], n[new], col[new]
        starts = np.flatnonzero(np.diff(col.astype(np.int64), prepend=-1))
        sizes = np.diff(np.concatenate([starts, [len(col)]]))
        small = _pairs_within(node, n, starts, sizes)
        out = [pa.table([*[pa.array(x) for x in small], pa.nulls(len(small[0]), pa.int64()), pa.nulls(len(small[0]), pa.int64())], names)]
        i, j, rows = [], [], []
        for s, m in zip(starts[sizes > ALL_PAIRS].tolist(), sizes[sizes > ALL_PAIRS].tolist()):
            at = np.arange(s, s + m)
            rows.append(at)
            for h in at[:HUBS]:  # the sets of least key: most columns of a group of near copies agree on them
                i.append(at[at != h])
                j.append(np.full(m - 1, h))
        if rows:
            hubs = _summed(node, n, np.concatenate(i), np.concatenate(j))
            out.append(pa.table([*[pa.array(x) for x in hubs[:4]], pa.nulls(len(hubs[0]), pa.int64()), pa.array(hubs[4]), pa.nulls(len(hubs[0]), pa.int64())], names))
            at = np.concatenate(rows)
            none = pa.nulls(len(at), pa.int64())
            out.append(pa.table([pa.array(node[at]), none, pa.array(n[at]), none, none, none, pa.array(col[at].astype(np.int64) * 65536 + part % 65536)], names))
        return pa.concat_tables(out)

    return staged(group_arrow(prefixes, ["part"], run, ", ".join(f"{c} long" for c in names)), "product")


def _may_link(na: Column, nb: Column, shared: Column) -> Column:
    reach = shared + F.greatest(_need(na), _need(nb)) - 1
    return 7 * reach >= 3 * (na + nb)


def _held(wanted: DataFrame, rows: _Rows) -> DataFrame:
    """(node, set) of the wanted nodes: the whole set as 64-bit numbers, from one row that has it."""
    docs, sets, keys = rows
    first = sets.join(wanted, "node").groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("f")).select("node", F.col("f.doc_id").alias("d"), F.col("f.key").alias("k"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for first_row, doc, sh, size in _texts(batch):
                n = np.bincount(doc, minlength=size)
                node = _nodes(doc, sh, n, keys)
                cuts = np.cumsum(n)[:-1]
                held = [x.astype("<u8").tobytes() for x in np.split(sh, cuts)]
                ok = pa.array(node == batch.column("node").slice(first_row, size).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(held, pa.binary())], ["node", "set"]).filter(ok)

    # a row is found by doc_id and text, so that very many rows of one doc_id, or of none, don't meet each other
    texts = docs.join(first, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select("node", "text")
    return staged(map_arrow(texts, run, "node long, set binary"), "held").dropDuplicates(["node"])


def _verify(pairs: DataFrame, rows: _Rows) -> DataFrame:
    """The pairs (a, b, na, nb) that reach 0.75 on their whole sets."""
    pairs = staged(pairs.select("a", "b", "na", "nb"), "pairs")
    if pairs.isEmpty():
        return pairs.select("a", "b")
    held = _held(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), rows)
    both = pairs.join(held.toDF("a", "sa"), "a").join(held.toDF("b", "sb"), "b")

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                s, t = (np.frombuffer(z.as_buffer(), "<u8") for z in (x, y))
                both_n = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both_n >= 75 * (len(s) + len(t) - both_n))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return staged(map_arrow(both, check, "a long, b long"), "links")


def _crowded(product: DataFrame, comp: DataFrame) -> DataFrame:
    """Sets of the crowded columns that hold more than one component; of columns with equal sets one, with their number as weight."""
    rows = product.where("column is not null").select("column", F.col("a").alias("node"), F.col("na").alias("n"))
    rows = rows.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mark = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark{k}") for k in (0, 1)]
    columns = rows.groupBy("column").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), *mark).where("lo <> hi")
    kept = columns.groupBy("size", "mark0", "mark1").agg(F.min("column").alias("column"), F.count("*").alias("weight")).select("column", "weight")
    kept = staged(kept, "columns")
    return staged(rows.join(kept, "column"), "crowd")


def _stars(crowd: DataFrame, turn: int) -> DataFrame:
    """For every set outside the largest component of one of its columns, the member of that component it meets most often."""
    member = F.min_by(F.struct("node", "n"), F.xxhash64("node", F.lit(turn))).alias("hub")
    per = crowd.groupBy("column", "component").agg(F.count("*").alias("size"), member)
    main = per.groupBy("column").agg(F.max_by(F.struct("component", "hub"), F.struct("size", "component")).alias("main"))
    main = staged(main, "main")  # a table of its own, so that Spark can split a crowded column in the join
    met = crowd.join(main, "column").where("component <> main.component and 4 * least(n, main.hub.n) >= 3 * greatest(n, main.hub.n)")
    met = met.groupBy("node", "n", "main.hub").agg(F.sum("weight").alias("c"))
    best = met.groupBy("node").agg(F.max_by(F.struct("n", "hub"), F.struct("c", "hub.node")).alias("m"))
    a, b = F.struct("node", "m.n"), F.struct("m.hub.node", "m.hub.n")
    low, high = F.least(a, b), F.greatest(a, b)
    return best.select(low.getField("node").alias("a"), high.getField("node").alias("b"), low.getField("n").alias("na"), high.getField("n").alias("nb")).distinct()


def _shared_columns(held: DataFrame, parts: int) -> DataFrame:
    """The whole sets once more by column: pairs that share a column of few sets, with their number; and of every set its crowded columns.

    Rows (a, b, na, nb, shared) of pairs; rows (a, na, shared, x0, x1, columns) of sets, one a part: number, hashes and list.
    """

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            nodes, sets = batch.column("node").to_numpy(), [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column("set")]
            some = np.cumsum(list(map(len, sets))) // 1_000_000  # about a million numbers at a time
            for first in np.flatnonzero(np.diff(some, prepend=-1)).tolist():
                last = int(np.searchsorted(some, some[first], side="right"))
                node, got = nodes[first:last], sets[first:last]
                n = np.array(list(map(len, got)), np.int64)
                row, col = np.repeat(np.arange(len(node)), n), np.concatenate(got)
                part = (mix(col) % U(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                row, col, part = row[order], col[order], part[order]
                edges = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
                cols: list[list] = [[], [], [], [], []]
                for s, e in zip(edges, [*edges[1:], len(part)]):
                    rows, counts = np.unique(row[s:e], return_counts=True)
                    for c, x in zip(cols, (int(part[s]), node[rows].tobytes(), n[rows].astype("<u4").tobytes(), counts.astype("<u4").tobytes(), col[s:e].astype("<u8").tobytes())):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["part", "nodes", "ns", "counts", "columns"])

    names = ["a", "b", "na", "nb", "shared", "x0", "x1", "columns"]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        get = lambda c, k: np.concatenate([np.frombuffer(x.as_py(), k) for x in t.column(c)])
        counts = get("counts", "<u4")
        node, n, col = np.repeat(get("nodes", "<i8"), counts), np.repeat(get("ns", "<u4").astype(np.int64), counts), get("columns", "<u8")
        order = np.lexsort((node, col))
        node, n, col = node[order], n[order], col[order]
        starts = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(col)]]))
        small = _pairs_within(node, n, starts, sizes)
        none = lambda m, kind=pa.int64(): pa.nulls(m, kind)
        m = len(small[0])
        out = [pa.table([*[pa.array(x) for x in small], none(m), none(m), none(m, pa.binary())], names)]
        many = np.repeat(sizes, sizes)
        at = np.flatnonzero(many > ALL_PAIRS)
        if len(at):
            at = at[np.argsort(node[at], kind="stable")]
            first = np.flatnonzero(np.concatenate([[True], node[at][1:] != node[at][:-1]]))
            k = np.diff(np.concatenate([first, [len(at)]]))
            x = [np.bitwise_xor.reduceat(mix(col[at] ^ U(salt)), first).view(np.int64) for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)]
            packed = np.stack([many[at].astype("<u8"), col[at]], 1).tobytes()
            lists = [packed[16 * s : 16 * (s + m)] for s, m in zip(first.tolist(), k.tolist())]
            m = len(first)
            out.append(pa.table([pa.array(node[at][first]), none(m), pa.array(n[at][first]), none(m), pa.array(k), *map(pa.array, x), pa.array(lists, pa.binary())], names))
        return pa.concat_tables(out)

    dealt = map_arrow(held, deal, "part long, nodes binary, ns binary, counts binary, columns binary")
    return staged(group_arrow(dealt, ["part"], run, "a long, b long, na long, nb long, shared long, x0 long, x1 long, columns binary"), "shared")


def _class_columns(classes: DataFrame) -> DataFrame:
    """Classes with ``columns`` as one list, and in ``prefix`` those by which they may meet: the first k - ceil(3 n / 4) + 1, rare ones first."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists, prefixes = [], []
            for n, parts in zip(batch.column("n").to_pylist(), batch.column("parts").to_pylist()):
                c = np.frombuffer(b"".join(parts), "<u8").reshape(-1, 2)
                c = c[np.lexsort((c[:, 1], c[:, 0])), 1]
                lists.append(c.tobytes())
                prefixes.append(c[: max(0, len(c) - (3 * n + 3) // 4 + 1)].astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("cls", "n", "k", "component", "mixed", "x0", "x1")], pa.array(lists, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], ["cls", "n", "k", "component", "mixed", "x0", "x1", "columns", "prefix"])

    return staged(map_arrow(classes, run, "cls long, n long, k long, component long, mixed boolean, x0 long, x1 long, columns binary, prefix array<long>"), "classes")


def _class_links(classes: DataFrame) -> DataFrame:
    """Rows (a, b, room) of linked classes in different components: a forest (room null), and partners b of a.

    Every member of a whose size is at most ``room`` / 3 links with the smallest member of b.
    """
    light = classes.select("cls", "component", F.explode("prefix").alias("column"))
    # columns whose classes are nearly the same mostly have the same class of least hash: they are bundled by it, so
    # that a class takes part in few bundles, whatever the number of its columns
    columns = light.groupBy("column").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("cls", F.xxhash64("cls")).alias("bundle"))
    columns = staged(columns.where("lo <> hi").select("column", "bundle"), "bundles")
    rows = staged(light.join(columns, "column").select("bundle", "cls", "component").distinct(), "bundled")
    sizes = rows.groupBy("bundle", "component").agg(F.count("*").alias("m"))
    sizes = sizes.groupBy("bundle").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("most"))
    sizes = staged(sizes.select("bundle", "main", F.ceil(F.col("all") / PIECE).alias("js"), F.ceil((F.col("all") - F.col("most")) / PIECE).alias("is")), "pieces")
    # those outside the largest component on one side, all on the other
    i, j = F.pmod(F.xxhash64("cls", F.lit(11)), F.col("is")), F.pmod(F.xxhash64("cls", F.lit(12)), F.col("js"))
    one = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    left = F.when(F.col("component") != F.col("main"), F.transform(upto(F.col("js")), lambda x: one(i, x, 0))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint,side:int>>"))
    right = F.transform(upto(F.col("is")), lambda x: one(x, j, 1))
    dealt = rows.join(sizes, "bundle").where("is > 0").select("bundle", "cls", F.explode(F.concat(left, right)).alias("at"))
    dealt = dealt.join(classes.select("cls", "n", "component", "columns"), "cls").select("bundle", "at.*", "cls", "n", "component", "columns")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        cls, n, comp = (t.column(c).to_numpy() for c in ("cls", "n", "component"))
        lists = [np.frombuffer(x.as_py(), "<u8") for x in t.column("columns")]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        flat = lambda at: (np.repeat(np.arange(len(at)), [len(lists[k]) for k in at]), np.concatenate([lists[k] for k in at] or [np.zeros(0, "<u8")]))
        (x, p), (y, q) = flat(left), flat(right)
        both = np.intersect1d(p, q)
        over = np.zeros((len(left), len(right)), np.float32)
        for s in range(0, len(both), 2048):  # the product of the two incidence matrices, some columns at a time
            some = both[s : s + 2048]
            dense = []
            for rows, cols, m in ((x, p, len(left)), (y, q, len(right))):
                at = np.minimum(np.searchsorted(some, cols), len(some) - 1)
                hit = some[at] == cols
                a = np.zeros((m, len(some)), np.float32)
                a[rows[hit], at[hit]] = 1
                dense.append(a)
            over += dense[0] @ dense[1].T
        # counts are whole and below 2**24 wherever a set has fewer shingles than that
        room = 7 * over.astype(np.int64)
        ok = (room >= 3 * (n[left][:, None] + n[right][None])) & (comp[left][:, None] != comp[right][None])
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = []
        none = np.iinfo(np.int64).min
        for r, a, b in ((np.where(ok, room - 3 * n[right][None], none), left, right), (np.where(ok, room - 3 * n[left][:, None], none).T, right, left)):
            if r.size:
                best = r.argmax(1)
                top = r[np.arange(len(a)), best]
                out.append((cls[a][top > none], cls[b[best]][top > none], top[top > none]))
        a, b = spanning_forest(ok)
        out.append((cls[left[a]], cls[right[b]], None))
        return pa.concat_tables([pa.table({"a": pa.array(a), "b": pa.array(b), "room": pa.nulls(len(a), pa.int64()) if r is None else pa.array(r)}) for a, b, r in out])

    return staged(group_arrow(dealt, ["bundle", "i", "j"], run, "a long, b long, room long"), "classlinks")


def _settle(crowd: DataFrame, comp: DataFrame, rows: _Rows) -> DataFrame:
    """Links (a, b) that connect all sets of crowded columns as far as they are linked.

    With "few" and "many" counted over the whole sets of all of them: two that share a column of few sets
    are a pair here. Two that share none overlap in columns of many sets only, K1 and K2, and link where
    3 (na + nb) <= 7 |K1 and K2|. That depends on their classes and sizes, so where any two members of two
    classes link, both link with the smallest member of the other class, and these with each other.
    """
    nodes = crowd.select("node", "n").distinct()
    size = nodes.agg(F.sum("n")).first()[0]
    shared = _shared_columns(_held(nodes.select("node"), rows), -(-size // WHOLE))
    crowded = shared.where("b is null").groupBy(F.col("a").alias("node")).agg(F.first("na").alias("n"), F.sum("shared").alias("k"), F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1"), F.collect_list("columns").alias("parts"))
    crowded = crowded.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    crowded = staged(crowded, "members")

    pairs = shared.where("b is not null").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("shared").alias("shared"))
    for c in ("a", "b"):
        pairs = pairs.join(crowded.select(F.col("node").alias(c), F.col("k").alias(f"k{c}")), c, "left").join(comp.toDF(c, f"c{c}"), c, "left")
        pairs = pairs.withColumns({f"k{c}": F.coalesce(f"k{c}", F.lit(0)), f"c{c}": F.coalesce(f"c{c}", c)})
    found = _verify(pairs.where("ca <> cb and 7 * (shared + least(ka, kb)) >= 3 * (na + nb)"), rows)

    members = crowded.select("node", "n", "x0", "x1")
    least = F.min(F.struct("n", "node")).alias("m")
    classes = crowded.groupBy("x0", "x1").agg(least, F.first("k").alias("k"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    classes = classes.select("x0", "x1", "k", F.col("m.node").alias("cls"), F.col("m.n").alias("n"), F.expr("lo <> hi").alias("mixed"), F.expr("if(lo <> hi, -1 - m.node, lo)").alias("component"))
    classes = classes.join(crowded.select(F.col("node").alias("cls"), "parts"), "cls")
    classes = _class_columns(classes)
    met = _class_links(classes)
    partner = met.where("room is not null").groupBy(F.col("a").alias("cls")).agg(F.max_by("b", F.struct("room", "b")).alias("b"), F.max("room").alias("room"))
    partner = staged(classes.select("cls", "x0", "x1").join(partner, "cls").select("x0", "x1", "b", "room"), "partners")
    own = staged(classes.where("mixed").select("x0", "x1", F.col("cls").alias("b"), (7 * F.col("k") - 3 * F.col("n")).alias("room")), "own")
    attached = [members.join(x, ["x0", "x1"]).where("3 * n <= room and node <> b").select(F.col("node").alias("a"), "b") for x in (partner, own)]
    return staged(found.union(met.where("room is null").select("a", "b")).union(attached[0]).union(attached[1]), "settled")


def _linked(docs: DataFrame, one_by_id: bool, key_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The staged counts, the sets in them, and (node, component) of all that are linked."""
    counted = _count(docs, key_bits)
    sets, keys = _keys(counted, key_bits)
    rows = _Rows(docs, sets, keys)
    parts = max(n_parts(docs.sparkSession), -(-(sets.agg(F.sum("n")).first()[0] or 0) // PART))
    product = _product(_prefixes(docs, _sketch(counted), parts, keys))

    sums = product.where("column is null").groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("na", "nb")], *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("shared", "hub")])
    sums = staged(sums, "overlaps")
    # first one link a set, to the partner it shares most with; then what is still apart
    both = sums.select(F.col("b").alias("x"), "a", "b", "na", "nb", "shared", "hub").union(sums.select("a", "a", "b", "na", "nb", "shared", "hub"))
    nearest = both.groupBy("x").agg(F.max_by(F.struct("a", "b", "na", "nb"), F.struct(F.col("shared") + F.col("hub"), -F.col("a"))).alias("p")).select("p.*").distinct()
    comp = staged(components(_verify(nearest, rows)), "comp")
    likely = sums.where(_may_link(F.col("na"), F.col("nb"), F.col("shared") + F.col("hub")))
    for c in ("a", "b"):
        likely = likely.join(comp.toDF(c, f"c{c}"), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    more = _verify(likely.where("ca <> cb").join(nearest.select("a", "b"), ["a", "b"], "left_anti"), rows)
    if not more.isEmpty():
        comp = joined_components(comp, more)
    # crowded columns: sets apart from the largest component of a column try a member of it, round by round
    crowd = _crowded(product, comp)
    for turn in range(ROUNDS):
        if crowd.isEmpty() or (more := _verify(_stars(crowd, turn), rows)).isEmpty():
            break
        comp = joined_components(comp, more)
        crowd = _crowded(product, comp)
    if not crowd.isEmpty():
        comp = joined_components(comp, _settle(crowd, comp, rows))

    if one_by_id:
        ends = sets.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
        same = staged(sets.where("n > 0").join(ends, "doc_id").select("a", F.col("node").alias("b")).distinct(), "same")
        if not same.isEmpty():
            comp = joined_components(comp, same)
    return counted, sets, comp


def link(docs: DataFrame, one_by_id: bool = True, key_bits: int = 63) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, component (a number) and component_id of every row of ``docs`` (doc_id, text).

    With ``one_by_id`` rows that share a doc_id are one document, else documents of their own. ``key_bits``: of the first
    hash of a set; fewer than 63 make it stand for several sets, for tests.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("key"))
    with scratch(docs.sparkSession) as keep:
        counted, sets, comp = _linked(docs, one_by_id, key_bits)
        keep(counted, comp)  # the result reads these two only
    first = sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    named = first.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = named.join(least, "component").select("node", "component", "component_id")
    out = sets.join(of_node, "node", "left")
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), "component", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    return link(docs).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """Of each component of ``docs`` (doc_id, text, any others) the row of least doc_id, nulls last, then of least hash of its text.

    Of rows that share doc_id and text one stays; rows that share a doc_id only are documents of their own. Rows
    without a word are linked with nothing and stay.
    """
    rows = link(docs.select("doc_id", "text"), one_by_id=False).where("n_shingles > 0")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("w")).select(F.col("w.doc_id").alias("__d"), F.col("w.key").alias("__k"))
    keyed = docs.withColumns({"__key": F.xxhash64("text"), "__id": F.col("doc_id").cast("long")})
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    stay = keyed.join(staged(first, "first"), F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")), "left_semi").where(~blank).dropDuplicates(["__id", "__key"])
    own = [F.col(f"`{c}`") for c in docs.columns]
    return stay.select(*own).union(docs.where(blank).select(*own))
