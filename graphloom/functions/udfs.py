"""SQL functions over tables of pattern graphs. Executors get the code by value, so they need not have the package installed."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import dfscode
from .dfscode import format_code, min_dfs_code

for _module in (dfscode, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)


def _least(labels: pd.Series, edges: pd.Series) -> pd.Series:
    def one(own, of) -> str | None:
        if own is None or of is None:
            return None
        return format_code(min_dfs_code([int(x) for x in own], [(int(e["u"]), int(e["v"]), int(e["label"])) for e in of]))

    return pd.Series([one(a, b) for a, b in zip(labels, edges, strict=True)], dtype=object)


def register(spark: SparkSession) -> None:
    """min_dfs_code(vertex labels array<int>, edges array<struct<u, v, label>>): text of the least code; null for a null graph, '' without edges."""
    spark.udf.register("min_dfs_code", F.pandas_udf(_least, "string"))
