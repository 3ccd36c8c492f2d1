"""Scoring with a model artefact: a pickled estimator that names its features, shipped to the workers and loaded once in each.

The order of the features is the artefact's, never the caller's: a file of names beside the model, else the names that the estimator was
fitted with (``feature_names_in_``, or its booster's). Features that the rows don't have are an error that names them, before
any task starts. An artefact runs code when it is loaded, so only files that one trusts belong here.
"""

from __future__ import annotations

import os
import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogrid.session import ship_package

#: Models of this worker, by the path that they were shipped to.
_loaded: dict[str, Any] = {}


def load(path: str) -> Any:
    with open(path, "rb") as f:
        return pickle.load(f)


def feature_order(model: Any, features: Any = None) -> list[str]:
    """Names of the model's features in the order in which it takes them."""
    if features is not None:
        if isinstance(features, str) or not hasattr(features, "__iter__"):
            raise TypeError(f"features have to be a list of names, not {type(features).__name__}")
        return [str(f) for f in features]
    names = getattr(model, "feature_names_in_", None)
    if names is None and hasattr(model, "get_booster"):
        names = model.get_booster().feature_names
    if names is None or not len(names):
        raise LookupError("the artefact names no features, and there is no file of names beside it")
    return [str(n) for n in names]


def score(rows: DataFrame, model: str, features: str | None = None, name: str = "raw_kw") -> DataFrame:
    """``rows`` with the prediction of the artefact in file ``model``; ``features``: a file of feature names.

    The file is shipped under its own name, which has to be one artefact's alone in a session.
    """
    spark = rows.sparkSession
    columns = feature_order(load(model), load(features) if features else None)
    if missing := [c for c in columns if c not in rows.columns]:
        raise KeyError(f"the model takes features that the rows don't have: {missing}")
    ship_package(spark)
    spark.sparkContext.addFile(model)
    file = os.path.basename(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        at = SparkFiles.get(file)
        if at not in _loaded:
            _loaded[at] = load(at)
        for x in batches:
            yield pd.Series(_loaded[at].predict(x[columns]), dtype="float64")

    return rows.withColumn(name, run(F.struct(*[F.col(f"`{c}`").alias(c) for c in columns])))
