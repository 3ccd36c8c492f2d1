"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

Every unit vector is projected on ``PROJECTIONS`` random directions. Two vectors collide in a
projection where their values differ by at most the window half-width. For a pair exactly at the
cosine threshold the chance of a collision is known (the difference is normal with the pair's
distance as deviation), so the count a pair has to reach is set from the binomial law such that
``RECALL`` of those pairs pass; pairs that pass are verified in double precision.

``SCANS`` of the projections are sorted into windows: a row meets the rows of its own window and of
the next. A window with more rows than ``ROWS`` is split by a hash of the row, and the pieces meet
piece by piece, so no task holds more than two pieces. The count of a pair is taken over all
projections at once where the pair meets, in the first scan in which it collides. A pair that collides in
enough projections but in none of the scanned ones is missed; ``recall`` gives the chance of both,
0.9993 at the threshold and more above it. Sorting all projections would meet nearly all pairs of a
label several times, as a window is a fifth of a projection wide.

A pair meets once, so links are counted where it meets: a task returns for each of its rows the number of
links, weighted by copies, and a spanning forest of the links, at most two rows for each row it has read.

Vectors that are equal share one row (class); they are linked with each other by definition.

Defined results: vectors that are null, zero, empty or hold null or non-finite components, and rows
with a null label or vec_id, link with nothing (n_links 0, component = vec_id); vectors of
different lengths don't link; repeated rows count as vectors of their own, and so do rows that share a vec_id
but not the vector; a pair whose cosine is within rounding (about 1e-15) of the threshold may fall on either
side; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogrid.llm.common import components, group_arrow, map_arrow, spanning_forest, staged

PROJECTIONS = 24
SCANS = 3
SIGMAS = 2.0
RECALL = 0.999
ROWS = 2000
#: Rows a side that are compared at a time.
TILE = 500


def calibrate(cosine: float) -> tuple[float, int]:
    """(window half-width, least count) for pairs at the threshold."""
    distance = math.sqrt(2 - 2 * cosine)
    p = math.erf(SIGMAS / math.sqrt(2))
    tail, least = 0.0, PROJECTIONS + 1
    while least > 1 and tail < RECALL:
        least -= 1
        tail += math.comb(PROJECTIONS, least) * p**least * (1 - p) ** (PROJECTIONS - least)
    return SIGMAS * distance, least


def recall(cosine: float) -> float:
    """Share of pairs at the threshold that reach the count and collide in a scanned projection."""
    p, (_, least) = math.erf(SIGMAS / math.sqrt(2)), calibrate(cosine)
    law = lambda n, k: math.comb(n, k) * p**k * (1 - p) ** (n - k)
    rest = PROJECTIONS - SCANS
    return sum(law(SCANS, i) * law(rest, j) for i in range(1, SCANS + 1) for j in range(max(0, least - i), rest + 1))


def _directions(dim: int) -> np.ndarray:
    return np.random.default_rng([20_011, dim]).standard_normal((dim, PROJECTIONS))


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label)."""
    width, least = calibrate(cosine)
    v = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite & F.exists("x", lambda c: c != 0)
    keys = [F.xxhash64("label", "x").alias("k1"), F.xxhash64(F.lit(7), "x", "label").alias("k2")]
    v = staged(v.withColumn("ok", F.coalesce(ok, F.lit(False))).select("*", *keys), "vectors")
    classes = v.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("x").alias("x"))

    def project(it):
        for batch in it:
            rows = [np.array(x, float) for x in batch.column("x").to_pylist()]
            out = []
            for x in rows:
                # scaled by its largest component first, so that no square leaves the range of doubles
                u = x / np.abs(x).max()
                out.append(((u / np.sqrt(u @ u)) @ _held(len(x))).astype(np.float32).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float32()))], [*batch.schema.names, "y"])

    held: dict[int, np.ndarray] = {}

    def _held(dim: int) -> np.ndarray:
        if dim not in held:
            held[dim] = _directions(dim)
        return held[dim]

    made = map_arrow(
        # written at once, so the numbers hold
        classes.select(F.monotonically_increasing_id().alias("rep"), "k1", "k2", "least", F.col("label").cast("string").alias("label"), "copies", "x"),
        project,
        "rep long, k1 long, k2 long, least long, label string, copies long, x array<double>, y array<float>",
    )
    rows = staged(made, "projected")
    window = ["label", "dim", "scan", "cell"]
    scans = F.explode(F.sequence(F.lit(0), F.lit(SCANS - 1))).alias("scan")
    cells = rows.select("rep", "copies", "label", F.size("x").alias("dim"), scans, "x", "y").withColumn("cell", F.floor(F.get("y", F.col("scan")) / width))
    counts = cells.groupBy(*window).agg(F.ceil(F.count("*") / ROWS).alias("pieces"))
    after = counts.select("label", "dim", "scan", (F.col("cell") - 1).alias("cell"), F.col("pieces").alias("next"))
    before = counts.select("label", "dim", "scan", (F.col("cell") + 1).alias("cell"), F.col("pieces").alias("last"))
    plan = staged(counts.join(after, window, "left").join(before, window, "left").na.fill(0, ["next", "last"]), "windows")
    one = lambda cell, i, step, j, side: F.struct(cell.alias("at"), i.alias("i"), F.lit(step).alias("step"), j.alias("j"), F.lit(side).alias("side"))
    span = lambda low, high: F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
    mine, c = F.pmod(F.xxhash64("rep"), F.col("pieces")).alias("piece"), F.col("cell")
    p, zero = F.col("piece"), F.lit(0).cast("long")
    meets = F.concat(
        F.transform(span(p, F.col("pieces")), lambda j: one(c, p, 0, j, 0)),
        F.transform(span(zero, p), lambda i: one(c, i, 0, p, 1)),
        F.transform(span(zero, F.col("next")), lambda j: one(c, p, 1, j, 0)),
        F.transform(span(zero, F.col("last")), lambda i: one(c - 1, i, 1, p, 1)),
    )
    dealt = cells.join(plan, window).select("*", mine).select("label", "dim", "scan", F.explode(meets).alias("m"), "rep", "copies", "x", "y").select("label", "dim", "scan", "m.*", "rep", "copies", "x", "y")

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        _, _, scan, _, i, step, j = (k.as_py() for k in key)
        rep, copies = t.column("rep").to_numpy(), t.column("copies").to_numpy()
        x = t.column("x").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        y = t.column("y").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        side = t.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = step == 0 and i == j
        if same:
            right = left
        # sorted by the scanned projection, so that tiles far apart in it are left out whole
        left, right = (at[np.argsort(y[at, scan], kind="stable")] for at in (left, right))
        counts, group, edges = np.zeros(len(rep), np.int64), _Groups(len(rep)), []
        order = [scan, *[k for k in range(PROJECTIONS) if k != scan]]
        for s in range(0, len(left), TILE):
            a = left[s : s + TILE]
            first = int(np.searchsorted(y[right, scan], y[a[0], scan] - width))
            last = int(np.searchsorted(y[right, scan], y[a[-1], scan] + width, side="right"))
            for z in range(s if same else first, last, TILE):
                b = right[z : min(z + TILE, last)]
                hits, ok = np.zeros((len(a), len(b)), np.int8), None
                for done, k in enumerate(order, 1):
                    near = np.abs(y[a, k][:, None] - y[b, k][None]) <= width
                    hits += near
                    if k == scan:
                        ok = near
                    elif k < scan:  # met there already
                        ok &= ~near
                    if done % 8 == 0:
                        ok &= hits >= least - (PROJECTIONS - done)
                        if not ok.any():
                            break
                else:
                    ok &= hits >= least
                    if same and z == s:
                        ok = np.triu(ok, 1)
                    if ok.any():
                        linked = ok & (x[a] @ x[b].T >= cosine)
                        counts[a] += linked @ copies[b]
                        counts[b] += copies[a] @ linked
                        p, q = spanning_forest(linked)
                        edges += group.join(a[p].tolist(), b[q].tolist())
        linked = np.flatnonzero(counts)
        e = np.array(edges, np.int64).reshape(-1, 2)
        out = [pa.table({"a": rep[linked], "b": pa.nulls(len(linked), pa.int64()), "n": counts[linked]}), pa.table({"a": rep[e[:, 0]], "b": rep[e[:, 1]], "n": pa.nulls(len(e), pa.int64())})]
        return pa.concat_tables(out)

    met = staged(group_arrow(dealt, ["label", "dim", "scan", "at", "i", "step", "j"], meet, "a long, b long, n long"), "links")
    others = met.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    comp = components(met.where("n is null").select("a", "b")).select(F.col("node").alias("rep"), "component")
    per = rows.select("rep", "k1", "k2", "least", "copies").join(others, "rep", "left").join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    per = staged(per.select("k1", "k2", "least", "component", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n")), "classes")
    lowest = staged(per.groupBy("component").agg(F.min("least").alias("c")), "lowest")  # a table of its own, so that Spark can split a large component in the join
    per = per.join(lowest, "component").select("k1", "k2", "n", "c")
    out = v.select("vec_id", "ok", "k1", "k2").join(per, ["k1", "k2"], "left")
    n, component = F.when(F.col("ok"), F.col("n")).otherwise(F.lit(0)), F.when(F.col("ok"), F.col("c")).otherwise(F.col("vec_id"))
    return out.select("vec_id", n.alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


class _Groups:
    """Union by smallest number, which keeps the links that join two groups."""

    def __init__(self, n: int):
        self.of = list(range(n))

    def _root(self, i: int) -> int:
        of = self.of
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    def join(self, p: list[int], q: list[int]) -> list[tuple[int, int]]:
        """The pairs that join what was apart."""
        out = []
        for i, j in zip(p, q):
            a, b = self._root(i), self._root(j)
            if a != b:
                self.of[max(a, b)] = min(a, b)
                out.append((i, j))
        return out
