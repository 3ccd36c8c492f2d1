"""Merging rows by key on plain Parquet: read, combine, write a new version, then move the pointer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def last_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last by ``order`` (nulls first). A maximum, so a hot key is reduced where it is read."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_last")
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(last).select(*[F.col(f"_last.{c}").alias(c) for c in rows.columns])


def replace_by_key(current: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``batch`` put in place of those with equal keys (null keys are equal)."""
    condition = [current[k].eqNullSafe(batch[k]) for k in keys]
    return current.join(batch, condition, "left_anti").unionByName(batch, allowMissingColumns=True)


def merge_registry(current: DataFrame, batch: DataFrame, keys: list[str], overwrite: list[str], coalesce: list[str], order: list[str]) -> DataFrame:
    """Registry upsert: of a key, ``overwrite`` columns take the last row's value even if null,
    ``coalesce`` columns the last value that isn't null.

    The last row is that of greatest ``order``, whichever batch it came with. The registry keeps it, and for each coalesced column
    the ``<column>_<order>`` of its value, so batches may come late and in any order.
    """
    own = lambda c: [f"{c}_{o}" for o in order]
    there = lambda c: [F.when(F.col(c).isNotNull(), F.col(o)).alias(x) for o, x in zip(order, own(c), strict=True)]
    rows = batch.select(*keys, *overwrite, *coalesce, *order, *[x for c in coalesce for x in there(c)])
    rows = current.select(*rows.columns).unionByName(rows)
    last = F.max_by(F.struct(*overwrite, *order), F.struct(*order)).alias("_last")
    named = [F.max_by(F.struct(c, *own(c)), F.when(F.col(c).isNotNull(), F.struct(*own(c)))).alias(f"_{c}") for c in coalesce]
    out = rows.groupBy(*keys).agg(last, *named)
    return out.select(*keys, *[F.col(f"_last.{c}") for c in overwrite], *[F.col(f"_{c}.{c}") for c in coalesce], *[F.col(f"_last.{o}") for o in order], *[F.col(f"_{c}.{x}") for c in coalesce for x in own(c)])


def cascade(children: DataFrame, removed_parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Children that stay once the parents are gone."""
    return children.join(removed_parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def checked(rows: DataFrame, **rules: str) -> DataFrame:
    """``rows``, failing at run time where a named SQL condition is false."""
    for name, rule in rules.items():
        broken = F.raise_error(F.lit(f"constraint {name} is violated")).cast("boolean")
        rows = rows.where(F.when(F.expr(rule) | F.expr(rule).isNull(), F.lit(True)).otherwise(broken))
    return rows


class VersionedTable:
    """Parquet versions under one folder, and an empty pointer file for each that is complete.

    A writer reads version v, writes v + 1 in full and only then creates its pointer, so readers never see half a version and
    a repeated batch rewrites the same one. Pointers are listed, never read; ``vacuum`` leaves those of the last versions.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _store(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _pointers(self) -> list[tuple[int, int]]:
        """(version, batch) of complete versions, in order."""
        store, at = self._store(f"{self.path}/pointer")
        if not store.exists(at):
            return []
        names = [f.getPath().getName() for f in store.listStatus(at)]
        return sorted(tuple(int(x) for x in n.split(".")) for n in names)

    def version(self) -> int | None:
        held = self._pointers()
        return held[-1][0] if held else None

    def has_batch(self, batch: int) -> bool:
        """Batches come in order, so one that isn't greater than the last is there."""
        held = self._pointers()
        return bool(held) and batch <= max(b for _, b in held)

    def read(self, schema: str | None = None, version: int | None = None) -> DataFrame:
        v = version or self.version()
        if v is None:
            if schema is None:
                raise ValueError("no version yet")
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema) if schema else self.spark.read
        return rows.parquet(f"{self.path}/v{v}")

    def write(self, rows: DataFrame, batch: int = -1) -> int:
        v = (self.version() or 0) + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v{v}")
        store, at = self._store(f"{self.path}/pointer/{v}.{batch}")
        store.create(at, False).close()
        return v

    def vacuum(self, keep: int = 2) -> list[int]:
        """Delete all but the last ``keep`` versions; readers of those must be done."""
        gone = self._pointers()[:-keep]
        for v, batch in gone:
            for name in (f"pointer/{v}.{batch}", f"v{v}"):
                store, at = self._store(f"{self.path}/{name}")
                store.delete(at, True)
        return [v for v, _ in gone]
