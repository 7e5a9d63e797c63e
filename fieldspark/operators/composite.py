"""Vertical means, composites and coefficient statistics.

Missing values are NULL and every aggregate skips them; sums and valid counts
are kept apart so that partial composites can be merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.constants import MEAN_LEVELS, SCALE_HEIGHT

PREFIXES = ("prp__", "int__", "ax__", "ay__", "beta__")


def vertical_mean(cells: DataFrame, fields: list[str], keys: list[str], levels=MEAN_LEVELS, mask: str = "field", weight: str = "height") -> DataFrame:
    """Weighted mean over ``levels`` of every field.

    ``weight``: "height" (exp(-z / H), z in metres, a column) or "dp" (half the
    pressure between the neighbouring levels).  ``mask``: "field" leaves gaps
    out of both sums; "none" keeps the weight of a gap (the mean is then missing
    as soon as one value is).
    """
    c = cells.filter(F.col("level").isin(*levels)) if levels else cells
    if weight == "height":
        c = c.withColumn("_w", F.exp(-F.col("z") / SCALE_HEIGHT))
    else:
        w = Window.partitionBy(*keys).orderBy("level")
        c = c.withColumn("_w", (F.coalesce(F.lead("level").over(w), F.col("level")) - F.coalesce(F.lag("level").over(w), F.col("level"))) / 2.0)
    aggs = []
    for f in fields:
        total = F.sum(F.col("_w") * F.col(f))
        if mask == "field":
            mean = total / F.sum(F.when(F.col(f).isNotNull(), F.col("_w")))
        else:
            mean = F.when(F.count(f) == F.count("*"), total / F.sum("_w"))
        aggs.append(mean.alias(f))
    return c.groupBy(*keys).agg(*aggs)


def nearest_level(cells: DataFrame, hpa: float, keys: list[str]) -> DataFrame:
    """The level nearest to ``hpa`` in each group; ties to the smaller level."""
    best = F.min_by("level", F.struct(F.abs(F.col("level") - hpa), F.col("level"))).over(Window.partitionBy(*keys))
    return cells.withColumn("_b", best).filter(F.col("level") == F.col("_b")).drop("_b")


def reduce_2d(cells: DataFrame, fields: list[str], keys: list[str], mode) -> DataFrame:
    """``mode``: "pass" (already flat), a level in hPa, or "mean"."""
    if mode == "pass":
        return cells.select(*keys, *fields)
    if mode == "mean":
        return vertical_mean(cells, fields, keys)
    return nearest_level(cells, float(mode), keys).select(*keys, *fields)


def align_levels(cells: DataFrame, levels: list[int], keys: list[str]) -> DataFrame:
    """Keeps the reference levels of the patches that have all of them."""
    c = cells.filter(F.col("level").isin(*levels))
    n = c.select(*keys, "level").distinct().groupBy(*keys).agg(F.count("*").alias("_n"))
    return c.join(n.filter(F.col("_n") == len(set(levels))).drop("_n"), keys, "left_semi")


def composite_fields(df: DataFrame, keys: list[str]) -> list[str]:
    """Numeric columns that are neither keys nor results of a projection."""
    return [f for f, t in df.dtypes if f not in keys and t in ("double", "float") and not f.startswith(PREFIXES)]


def with_variants(patches: DataFrame, members: DataFrame) -> DataFrame:
    """Each patch under "original" and every variant it belongs to (stage, track_id, variant)."""
    every = members.select("stage", "track_id").distinct().withColumn("variant", F.lit("original"))
    return patches.join(members.select("stage", "track_id", "variant").unionByName(every).distinct(), ["stage", "track_id"])


def build_composites(cells: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """sum_<f> and n_<f> (valid values) of every field by ``keys``."""
    return cells.groupBy(*keys).agg(*[x for f in fields for x in (F.sum(f).alias(f"sum_{f}"), F.count(f).alias(f"n_{f}"))])


def composite_mean(comp: DataFrame, fields: list[str]) -> DataFrame:
    """Means, missing where nothing was valid."""
    keys = [c for c in comp.columns if not c.startswith(("sum_", "n_"))]
    return comp.select(*keys, *[F.try_divide(F.col(f"sum_{f}"), F.col(f"n_{f}")).alias(f) for f in fields])


def merge_composites(a: DataFrame, b: DataFrame) -> DataFrame:
    keys = [c for c in a.columns if not c.startswith(("sum_", "n_"))]
    return a.unionByName(b).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in a.columns if c not in keys])


def composite_count(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.count_distinct("track_id").alias("n_events"))


def available_hours(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_set("dh")).alias("hours"))


def coef_stats(coefs: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """mean, std, sem and n of coefficients."""
    return coefs.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n")
    )


def field_corr(cells: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Correlation, and the ratio of mean absolute values."""
    return cells.groupBy(*keys).agg(F.corr(a, b).alias("corr"), (F.avg(F.abs(a)) / F.avg(F.abs(b))).alias("ratio"))


def xsection(cells: DataFrame, field: str, keys: list[str], middle: int) -> DataFrame:
    """By level and ix: the middle row, the mean over rows and its departure from the level's mean."""
    s = cells.groupBy(*keys, "level", "ix").agg(F.max(F.when(F.col("iy") == middle, F.col(field))).alias("middle"), F.avg(field).alias("mean"))
    return s.withColumn("departure", F.col("mean") - F.avg("mean").over(Window.partitionBy(*keys, "level")))


def color_range(cells: DataFrame, field: str, keys: list[str], share: float = 0.95) -> DataFrame:
    return cells.groupBy(*keys).agg(F.percentile(F.abs(field), share).alias("vmax"))


def eddy_covariance(cells: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Mean of products, product of means, and their difference."""
    return cells.groupBy(*keys).agg(F.avg(F.col(a) * F.col(b)).alias("mean_product"), (F.avg(a) * F.avg(b)).alias("product_mean"), F.covar_pop(a, b).alias("covariance"))


def rmse(f: Column, g: Column) -> Column:
    return F.sqrt(F.avg(F.pow(f - g, 2)))


def fill_median(field: str, keys: list[str]) -> Column:
    return F.coalesce(F.col(field), F.median(field).over(Window.partitionBy(*keys)))


def column_range(field: str, keys: list[str]) -> tuple[Column, Column]:
    w = Window.partitionBy(*keys)
    return F.min(field).over(w), F.max(field).over(w)


def sig_summary(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Share of significant cells and mean absolute residual."""
    return cells.groupBy(*keys).agg(F.avg(F.col("sig").cast("int")).alias("share"), F.avg(F.abs("resid")).alias("resid"))


# --- climatology ---


def compute_climatology(field: DataFrame, fields: list[str], keys: list[str], years: tuple[int, int] | None = None) -> DataFrame:
    """Mean over years by month, day, hour and ``keys``; 29 February has its own leap years."""
    if years:
        field = field.filter((F.year("ts") >= years[0]) & (F.year("ts") < years[1]))
    return field.groupBy(F.month("ts").alias("month"), F.day("ts").alias("day"), F.hour("ts").alias("hour"), *keys).agg(*[F.avg(f).alias(f"{f}_bar") for f in fields])


def anomaly(field: DataFrame, clim: DataFrame, fields: list[str], keys: list[str], how: str = "inner", missing: float | None = None) -> DataFrame:
    """Adds <f>_bar and <f>_anom by calendar; ``how`` = "left" with ``missing`` = 0 for split winds."""
    f = field.withColumn("month", F.month("ts")).withColumn("day", F.day("ts")).withColumn("hour", F.hour("ts"))
    j = f.join(clim, ["month", "day", "hour", *keys], how)
    for c in fields:
        if missing is not None:
            j = j.withColumn(f"{c}_bar", F.coalesce(f"{c}_bar", F.lit(missing)))
        j = j.withColumn(f"{c}_anom", F.col(c) - F.col(f"{c}_bar"))
    return j
