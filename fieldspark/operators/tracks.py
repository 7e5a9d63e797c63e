"""Moving centres: velocity, integration, errors, series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.columns import great_circle_deg
from fieldspark.functions.constants import R_EARTH


def track_velocity(tracks: DataFrame) -> DataFrame:
    """Adds u_c, v_c (m/s): centred differences of the place, one-sided at the ends."""
    w = Window.partitionBy("track_id").orderBy("ts")
    pick = lambda c: (F.coalesce(F.lead(c).over(w), F.col(c)), F.coalesce(F.lag(c).over(w), F.col(c)))
    (lat1, lat_1), (lon1, lon_1) = pick("lat"), pick("lon")
    t1, t_1 = (x for x in (F.coalesce(F.lead(F.unix_seconds("ts")).over(w), F.unix_seconds("ts")), F.coalesce(F.lag(F.unix_seconds("ts")).over(w), F.unix_seconds("ts"))))
    dlon = F.pmod(lon1 - lon_1 + 180.0, F.lit(360.0)) - 180.0
    dt = F.when(t1 > t_1, (t1 - t_1).cast("double"))
    m = F.radians(F.lit(1.0)) * R_EARTH
    return tracks.withColumn("u_c", dlon * m * F.cos(F.radians("lat")) / dt).withColumn("v_c", (lat1 - lat_1) * m / dt)


def interior(tracks: DataFrame) -> DataFrame:
    """Drops the first and last row of every track."""
    w = Window.partitionBy("track_id")
    n = tracks.withColumn("_r", F.row_number().over(w.orderBy("ts"))).withColumn("_n", F.count("*").over(w))
    return n.filter((F.col("_r") > 1) & (F.col("_r") < F.col("_n"))).drop("_r", "_n")


def integrate_track(speed: DataFrame, start: DataFrame, seconds: float = 3600.0) -> DataFrame:
    """Places that speeds (track_id, dh, ax, ay in m/s) lead to from start (track_id, lat0, lon0).

    A missing speed means no move.  Latitude is summed first; each step east
    is then shrunk by the cosine of the latitude where it began.
    """
    w = Window.partitionBy("track_id").orderBy("dh").rowsBetween(Window.unboundedPreceding, -1)
    deg = 180.0 / (3.141592653589793 * R_EARTH)
    j = speed.join(start, "track_id")
    j = j.withColumn("lat", F.col("lat0") + F.coalesce(F.sum(F.coalesce("ay", F.lit(0.0)) * seconds * deg).over(w), F.lit(0.0)))
    east = F.coalesce("ax", F.lit(0.0)) * seconds * deg / F.cos(F.radians("lat"))
    return j.withColumn("lon", F.col("lon0") + F.coalesce(F.sum(east).over(w), F.lit(0.0))).select("track_id", "dh", "lat", "lon")


def endpoint_error(found: DataFrame, truth: DataFrame) -> DataFrame:
    """track_id, km between the last places of two versions (track_id, dh, lat, lon)."""
    last = lambda d, p: d.groupBy("track_id").agg(F.max_by(F.struct("lat", "lon"), "dh").alias(p))
    j = last(found, "f").join(last(truth, "t"), "track_id")
    deg = great_circle_deg(F.col("t.lat"), F.col("t.lon"), F.col("f.lat"), F.col("f.lon"))
    return j.select("track_id", (F.radians(deg) * R_EARTH / 1000.0).alias("km"))


def stacked(life: DataFrame, value: str) -> DataFrame:
    """Running sums of positive and negative values of each dh by term: bar tops and bottoms."""
    w = Window.partitionBy("dh").orderBy("term")
    return life.withColumn("top", F.sum(F.greatest(F.col(value), F.lit(0.0))).over(w)).withColumn("bottom", F.sum(F.least(F.col(value), F.lit(0.0))).over(w))


def runs(df: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """Adds run: rows of consecutive integers of ``axis`` share one."""
    return df.withColumn("run", F.col(axis) - F.row_number().over(Window.partitionBy(*keys).orderBy(axis)))


def longest_run(df: DataFrame, keys: list[str], axis: str, least: int = 1) -> DataFrame:
    """Keeps each group's longest run (the first of equals) if it has ``least`` rows."""
    r = runs(df, keys, axis).withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "run")))
    best = F.max(F.struct(F.col("_n"), -F.col("run"))).over(Window.partitionBy(*keys))
    return r.withColumn("_b", best).filter((F.col("_n") == F.col("_b")["_n"]) & (F.col("_n") >= least) & (-F.col("run") == F.col("_b")["col2"])).drop("_b", "_n", "run")


def coef_series(coefs: DataFrame, value: str, variants: list | None = None) -> DataFrame:
    """Mean by dh, one column per variant if several are asked for."""
    g = coefs.groupBy("dh")
    return g.pivot("variant", variants).agg(F.avg(value)) if variants else g.agg(F.avg(value).alias(value))
