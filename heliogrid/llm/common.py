"""Shared helpers: table access, the shared work folder, staged tables, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliogrid.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a
    temporary folder is set; on a cluster no machine's own folder would do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="heliogrid-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage at a place every executor can read again, so a lost
    executor costs only its running tasks.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    for made in _recording:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


#: Lists that note the paths of staged tables while an operator works.
_recording: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Notes what is staged inside; calling it with the tables that are still read deletes all others."""
    made: list[str] = []
    _recording.append(made)

    def keep(*tables: DataFrame) -> None:
        for path in set(made) - {t._path for t in tables}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    try:
        yield keep
    finally:
        _recording.remove(made)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package importable in the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def group_arrow(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """``df.groupBy(keys).applyInArrow`` with this package importable in the workers."""
    ship_package(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(run, schema)


def n_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bound(value: Column, body) -> Column:
    """``let x = value in body(x)``: evaluates ``value`` once per row inside one projection."""
    return F.transform(F.array(value), body).getItem(0)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph with edges (a, b); component = smallest node.

    Alternating large-star / small-star rounds: each round is a partial-aggregated
    minimum and an equi-join, so a hub with very many neighbours never sits in one
    task whole. Every round is cut with a checkpoint in the shared folder. Nodes
    without an edge to another node do not appear. Null ends are ignored.
    """
    spark = edges.sparkSession
    e = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    e = staged(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    while not e.isEmpty():
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # large star: neighbours above u are hung onto u's smallest neighbour
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: the smaller neighbours of u, and u, are hung onto the smallest
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(small.union(low2.select("u", F.col("m").alias("v"))).distinct(), "cc")
        # done when every edge leads to a root: no upper end is a lower end too, or has two
        below = e.select(F.col("v").alias("u"))
        if e.join(below, "u", "left_semi").isEmpty() and e.groupBy("u").count().where("count > 1").isEmpty():
            break
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)


def joined_components(comp: DataFrame, more: DataFrame) -> DataFrame:
    """``comp`` (node, component) once the links ``more`` (a, b) are there too: only what they join is worked on."""
    for c in ("a", "b"):
        more = more.join(comp.toDF(c, f"c{c}"), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    small = staged(components(more.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "joined")
    moved = comp.join(small.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return staged(moved.union(small.join(comp.select("node"), "node", "left_anti")), "comp")


def spanning_forest(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the entries of a Boolean matrix that make up a spanning forest of its bipartite graph."""
    rows, cols, a, b = np.zeros(ok.shape[0], bool), np.zeros(ok.shape[1], bool), [], []
    for s in np.flatnonzero(ok.any(1)).tolist():
        todo = [] if rows[s] else [(True, s)]
        rows[s] = True
        while todo:
            is_row, k = todo.pop()
            near = np.flatnonzero(ok[k] & ~cols if is_row else ok[:, k] & ~rows).tolist()
            (cols if is_row else rows)[near] = True
            todo += [(not is_row, x) for x in near]
            a += [k] * len(near) if is_row else near
            b += near if is_row else [k] * len(near)
    return np.array(a, np.int64), np.array(b, np.int64)
