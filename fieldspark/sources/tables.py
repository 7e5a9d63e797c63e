"""Readers and writers: catalogues, tracks, exclude lists, fields, patches, composites."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions.columns import dh_of, wrap_lon
from fieldspark.functions.constants import R_EARTH, VARIABLES
from fieldspark.sources.normalize import clean, normalize_dims

EVENT = T.StructType(
    [T.StructField(n, t) for n, t in (("event_type", T.StringType()), ("stage", T.StringType()), ("track_id", T.LongType()), ("lat0", T.DoubleType()), ("lon0", T.DoubleType()), ("base_ts", T.TimestampType()))]
)
TRACK = "track_id long, step int, ts timestamp, lat double, lon double, area double"


def events_from(raw: DataFrame) -> DataFrame:
    """A catalogue with any of the known headers as the event table.

    lat / lat0, lon / lon180 / lon0, type / evt_name, base_ts / timestamp;
    the stage defaults to the event's name and then to "onset".
    """
    have = {c.lower(): c for c in raw.columns}
    first = lambda *names, default=None: F.coalesce(*[F.col(have[n]) for n in names if n in have], F.lit(default))
    kind = first("evt_name", "event_type", "type")
    return raw.select(
        kind.cast("string").alias("event_type"), F.coalesce(first("stage"), kind, F.lit("onset")).cast("string").alias("stage"),
        (first("track_id") if "track_id" in have else F.monotonically_increasing_id()).cast("long").alias("track_id"),
        first("lat0", "lat").cast("double").alias("lat0"), first("lon0", "lon180", "lon").cast("double").alias("lon0"),
        first("base_ts", "timestamp").cast("timestamp").alias("base_ts"),
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Columns are read as text and cast: files differ in what they hold."""
    return events_from(spark.read.option("header", True).csv(path))


def tracks_from(lines: DataFrame) -> DataFrame:
    """Text lines ``id, hour, "time", lat, lon, area`` (tabs or blanks) as the track table; other lines are dropped."""
    m = lambda g: F.regexp_extract("value", r"""^\s*(\d+)\s+(-?\d+)\s+"([^"]+)"\s+(\S+)\s+(\S+)\s+(\S+)""", g)
    t = lines.filter(m(1) != "")
    return t.select(
        m(1).cast("long").alias("track_id"), m(2).cast("int").alias("step"), F.to_timestamp(m(3)).alias("ts"), m(4).cast("double").alias("lat"),
        wrap_lon(m(5).cast("double")).alias("lon"), m(6).cast("double").alias("area"),
    )


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    return tracks_from(spark.read.text(path))


def exclude_from(lines: DataFrame) -> DataFrame:
    """track_id: the first number of every line that begins with one."""
    n = F.regexp_extract("value", r"^\s*(\d+)", 1)
    return lines.filter(n != "").select(n.cast("long").alias("track_id")).distinct()


def read_exclude(spark: SparkSession, path: str | None) -> DataFrame:
    """A missing file (or None) excludes nothing."""
    empty = spark.createDataFrame([], "track_id long")
    if path is None:
        return empty
    try:
        return exclude_from(spark.read.text(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty


def merge_variables(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """One wide table of several variables; cells that all of them have."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, keys)
    return out


def write_field(df: DataFrame, root: str) -> None:
    """Cells by year and month; keys and fields as they are, floats narrow."""
    d = clean(normalize_dims(df)).withColumn("year", F.year("ts")).withColumn("month", F.month("ts"))
    narrow = [F.col(c).cast("float").alias(c) if c in VARIABLES else F.col(c) for c in d.columns]
    d.select(*narrow).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(root)


def read_field(spark: SparkSession, root: str, variables: list[str], start: datetime, stop: datetime) -> DataFrame:
    """The window's months only, the asked variables only."""
    df = spark.read.parquet(root)
    a, b = start.year * 12 + start.month, stop.year * 12 + stop.month
    df = df.filter((F.col("year") * 12 + F.col("month")).between(a, b)).filter((F.col("ts") >= F.lit(start)) & (F.col("ts") <= F.lit(stop)))
    return df.select(*[c for c in ("ts", "level", "ilat", "ilon", "lat", "lon") if c in df.columns], *[F.col(v).cast("double").alias(v) for v in variables])


def write_clim(df: DataFrame, root: str, smooth: bool) -> None:
    df.withColumn("smooth", F.lit(smooth)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("smooth", "month").parquet(root)


def read_clim(spark: SparkSession, root: str, months: list[int] | None = None, prefer_smooth: bool = False) -> DataFrame:
    """Raw or smoothed climatology, whichever is preferred and there; none at all is an error."""
    df = spark.read.parquet(root)
    if months:
        df = df.filter(F.col("month").isin(*months))
    kinds = {r["smooth"] for r in df.select("smooth").distinct().collect()}
    if not kinds:
        raise FileNotFoundError(f"no climatology for {months} in {root}")
    return df.filter(F.col("smooth") == (prefer_smooth if prefer_smooth in kinds else not prefer_smooth)).drop("smooth")


def read_split_clim(spark: SparkSession, root: str, month: int) -> DataFrame:
    """Split winds of the climatology of one month, only its folder; a month that is not there gives no rows."""
    df = spark.read.parquet(root).filter(F.col("month") == month)
    parts = [f"{c}_{k}_bar" for c in "uv" for k in ("rot", "div")]
    return df.select("month", "day", "hour", "level", "ilat", "ilon", *[c for c in parts if c in df.columns])


def write_patches(df: DataFrame, root: str) -> None:
    """Patches by type, stage and hour; a repeated hour replaces its own part only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_type", "stage", "dh").parquet(root)


def read_patches(spark: SparkSession, root: str, stage: str | None = None, dh: int | None = None, on_corrupt: str = "fail") -> DataFrame:
    """``dh=+0``, ``dh=-0`` and ``dh=0`` are the same hour; ``on_corrupt`` = "skip" leaves unreadable files out."""
    df = spark.read.option("ignoreCorruptFiles", on_corrupt == "skip").parquet(root)
    df = df.withColumn("dh", F.col("dh").cast("int"))
    if stage is not None:
        df = df.filter(F.col("stage") == stage)
    return df.filter(F.col("dh") == dh) if dh is not None else df


def patch_meta(patches: DataFrame) -> DataFrame:
    """One row per patch: keys and centre, no fields."""
    keys = [c for c in ("event_type", "stage", "dh", "track_id", "ts", "lat_c", "lon_c") if c in patches.columns]
    return patches.select(*keys).distinct()


def missing_patches(wanted: DataFrame, read: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that were expected and could not be read."""
    return wanted.select(*keys).distinct().join(read.select(*keys).distinct(), keys, "left_anti")


def unreadable(wanted: DataFrame, read: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """How many expected patches could not be read, by hour or whatever ``by`` names."""
    return missing_patches(wanted, read, keys).groupBy(*by).agg(F.count("*").alias("n_missing"))


def hours_from_names(files: DataFrame, column: str = "path") -> DataFrame:
    return files.select(column, dh_of(F.col(column)).alias("dh"))


def write_composite(df: DataFrame, root: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("variant", "stage").parquet(root)


def read_composite(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


write_variants, read_variants = write_composite, read_composite


def synthetic_vortex(spark: SparkSession, ny: int = 101, nx: int = 121, spacing_m: float = 60e3, beta: float = 2e-6, ax: float = 10.0, ay: float = 5.0, gamma: float = 0.08, seconds: float = 3600.0) -> DataFrame:
    """t (0, 1), iy, ix, x, y (m), q: a Gaussian anomaly now and after growing, moving and shearing for an hour."""
    cells = spark.range(2 * ny * nx).select((F.col("id") % 2).cast("int").alias("t"), F.floor(F.col("id") / (2 * nx)).cast("int").alias("iy"), (F.floor(F.col("id") / 2) % nx).cast("int").alias("ix"))
    c = cells.withColumn("x", (F.col("ix") - (nx - 1) / 2) * spacing_m).withColumn("y", (F.col("iy") - (ny - 1) / 2) * spacing_m)
    h, s = F.col("t") * seconds, 600e3
    x, y = F.col("x") - ax * h, F.col("y") - ay * h
    return c.withColumn("q", -1e-6 * (1 + beta * h) * F.exp(-(x * x + y * y) / (2 * s * s)) * (1 + gamma * F.col("t") * x * y / (R_EARTH * s)))
