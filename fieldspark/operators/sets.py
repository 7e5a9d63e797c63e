"""Set operations on tracks, and the first rows of groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.operators.resample import scattered


def neutral(every: DataFrame, awb: DataFrame, cwb: DataFrame) -> DataFrame:
    return every.join(awb.union(cwb).distinct(), every.columns, "left_anti").distinct()


def omega(awb: DataFrame, cwb: DataFrame) -> DataFrame:
    return awb.intersect(cwb)


def named(sets: dict[str, DataFrame]) -> DataFrame:
    """One table (ids, variant) of several sets."""
    return reduce(DataFrame.unionByName, [d.withColumn("variant", F.lit(n)) for n, d in sets.items()])


def combine(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def first_n(df: DataFrame, by: str, n: int) -> DataFrame:
    return df.orderBy(by).limit(n)


def seeded_pick(df: DataFrame, by: str, seed: int, n: int = 1) -> DataFrame:
    """n rows drawn by a scattered number of ``by``: the same at any size of cluster."""
    return scattered(df, "_x", seed, F.pmod(F.col(by), F.lit(1 << 31))).orderBy("_x", by).limit(n).drop("_x")
