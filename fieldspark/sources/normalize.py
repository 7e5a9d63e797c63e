"""Names, headers, filters and unit conversions at the edge of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.columns import finite, wrap_lon

#: Other names of the axes.
ALIASES = {
    "valid_time": "ts", "time": "ts", "pressure_level": "level", "isobaricInhPa": "level", "lev": "level", "plev": "level",
    "latitude": "lat", "longitude": "lon",
}
ARTEFACTS = ("number", "expver")


def normalize_dims(df: DataFrame) -> DataFrame:
    """Renames axis aliases, drops archive artefacts."""
    names = {a: b for a, b in ALIASES.items() if a in df.columns and b not in df.columns}
    return df.withColumnsRenamed(names).drop(*ARTEFACTS)


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating columns become NULL."""
    return df.select(*[finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def fold_lon(df: DataFrame) -> DataFrame:
    return df.withColumn("lon", wrap_lon(F.col("lon")))


def select_levels(df: DataFrame, levels: list[int]) -> DataFrame:
    return df.filter(F.col("level").isin(*levels))


def crop_nh(df: DataFrame, min_lat: float = 0.0) -> DataFrame:
    return df.filter(F.col("lat") >= min_lat)


def filter_years(df: DataFrame, start: int, stop: int) -> DataFrame:
    """start <= year < stop, by the first of year, timestamp, base_ts that exists."""
    for c in ("year", "timestamp", "base_ts"):
        if c in df.columns:
            y = F.col(c) if c == "year" else F.year(c)
            return df.filter((y >= start) & (y < stop))
    raise ValueError("no year, timestamp or base_ts column")


def filter_stages(df: DataFrame, stages: list[str]) -> DataFrame:
    return df.filter(F.col("stage").isin(*stages))


def exclude(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids, "track_id", "left_anti")


def keep_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids, "track_id", "left_semi")


def pick(comp: DataFrame, variant: str, stage: str, dh: int) -> DataFrame:
    """One composite, names in any case."""
    return comp.filter((F.lower("variant") == variant.lower()) & (F.lower("stage") == stage.lower()) & (F.col("dh") == dh))
