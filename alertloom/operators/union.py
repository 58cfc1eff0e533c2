"""One table from several data sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_datasets(datasets: dict[str, DataFrame | None]) -> DataFrame:
    """All rows, duplicates included, with the data set they came from; absent sets are skipped."""
    parts = [df.withColumn("dataset", F.lit(name)) for name, df in datasets.items() if df is not None]
    if not parts:
        raise ValueError("no data loaded")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
