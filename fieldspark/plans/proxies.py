"""Field-shaped views of the driver tables, as DataFrames and as SQL.

Each view is small work over whole tables: sums by key.  The SQL text of a
view is a common table expression with the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NLEV, NLAT, NLON = 7, 10, 24
DLAT, DLON, LAT0 = 6.0, 15.0, 20.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c: Column, scale: float = 1.0, digits: int = 6) -> Column:
    """Rounded for comparison; -0.0 becomes 0.0."""
    return F.round(c * scale, digits) + F.lit(0.0)


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """level (hPa), ilat, ilon, lat, lon and the fields u v w t z q pv."""
    li = table(spark, sf, "lineitem")
    found = li.groupBy(
        F.col("l_linenumber").cast("int").alias("k"),
        (F.col("l_suppkey") % NLAT).cast("int").alias("ilat"),
        (F.col("l_partkey") % NLON).cast("int").alias("ilon"),
    ).agg(
        F.avg("l_quantity").alias("u"),
        F.avg(100 * F.col("l_discount")).alias("v"),
        F.avg(F.col("l_quantity") - 25.0).alias("w"),
        (250 + F.avg("l_quantity")).alias("t"),
        F.avg("l_extendedprice").alias("z"),
        (F.avg(F.col("l_tax")) / 10).alias("q"),
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("pv"),
    )
    cells = spark.range(NLEV * NLAT * NLON).select(
        (F.floor(F.col("id") / (NLAT * NLON)) + 1).cast("int").alias("k"),
        (F.floor(F.col("id") / NLON) % NLAT).cast("int").alias("ilat"),
        (F.col("id") % NLON).cast("int").alias("ilon"),
    )
    k = F.col("k")
    return cells.join(found, ["k", "ilat", "ilon"], "left").select(
        (100 * k + 10 * k * k).cast("int").alias("level"), "ilat", "ilon",
        (LAT0 + DLAT * F.col("ilat")).alias("lat"), (-180.0 + DLON * F.col("ilon")).alias("lon"),
        "u", "v", "w", "t", "z", "q", "pv",
    )


GRID = """grid AS (
  SELECT 100 * k + 10 * k * k AS level, ilat, ilon, 20.0 + 6.0 * ilat AS lat, -180.0 + 15.0 * ilon AS lon, u, v, w, t, z, q, pv
  FROM (SELECT CAST(a.k AS INT) AS k, CAST(b.ilat AS INT) AS ilat, CAST(c.ilon AS INT) AS ilon
        FROM range(1, 8) a(k), range(0, 10) b(ilat), range(0, 24) c(ilon)) cells
  LEFT JOIN (
    SELECT CAST(l_linenumber AS INT) AS k, CAST(l_suppkey % 10 AS INT) AS ilat, CAST(l_partkey % 24 AS INT) AS ilon,
      avg(l_quantity) AS u, avg(100 * l_discount) AS v, avg(l_quantity - 25.0) AS w, 250 + avg(l_quantity) AS t,
      avg(l_extendedprice) AS z, avg(l_tax) / 10 AS q, avg(l_extendedprice / l_quantity) AS pv
    FROM lineitem GROUP BY 1, 2, 3) f USING (k, ilat, ilon))"""


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """d (date) and x: mean price of every ship date."""
    return table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.avg("l_extendedprice").alias("x"))


CALENDAR = "calendar AS (SELECT CAST(l_shipdate AS DATE) AS d, avg(l_extendedprice) AS x FROM lineitem GROUP BY 1)"


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """track_id, ts (hour), lat, lon, area: a user's events by the hour."""
    ev = table(spark, sf, "events")
    return ev.groupBy(F.col("user_id").alias("track_id"), F.date_trunc("hour", "ts").alias("ts")).agg(
        (30 + F.avg("value") / 10).alias("lat"), (F.avg(F.col("event_id") % 360) - 180.0).alias("lon"), F.sum("value").alias("area")
    )


TRACKS = """tracks AS (
  SELECT user_id AS track_id, date_trunc('hour', ts) AS ts, 30 + avg(value) / 10 AS lat, avg(event_id % 360) - 180.0 AS lon, sum(value) AS area
  FROM events GROUP BY 1, 2)"""


def lifecycle_events(spark: SparkSession, sf: str) -> DataFrame:
    """event_type, stage, track_id, base_ts: first, largest and last hour of every track."""
    t = tracks(spark, sf)
    base = t.groupBy("track_id").agg(
        F.min("ts").alias("onset"), F.max_by("ts", F.struct("area", "ts")).alias("peak"), F.max("ts").alias("decay")
    )
    return base.select(
        F.lit("user").alias("event_type"),
        F.explode(F.create_map(F.lit("onset"), "onset", F.lit("peak"), "peak", F.lit("decay"), "decay")).alias("stage", "base_ts"),
        "track_id",
    )


EVENTS = TRACKS + """,
base AS (SELECT track_id, min(ts) AS onset, arg_max(ts, (area, ts)) AS peak, max(ts) AS decay FROM tracks GROUP BY 1),
evts AS (
  SELECT 'user' AS event_type, 'onset' AS stage, onset AS base_ts, track_id FROM base
  UNION ALL SELECT 'user', 'peak', peak, track_id FROM base UNION ALL SELECT 'user', 'decay', decay, track_id FROM base)"""


def patches(spark: SparkSession, sf: str) -> DataFrame:
    """track_id, variant, dh, iy, ix, x_rel, y_rel, a, b: embeddings as 8 x 8 patches."""
    e = table(spark, sf, "embeddings")
    cells = e.select(F.col("vec_id").alias("track_id"), F.col("label").alias("variant"), F.posexplode("embedding").alias("pos", "value"))
    value, pos = F.col("value").cast("double"), F.col("pos")
    iy, ix = F.floor(pos / 8).cast("int"), (pos % 8).cast("int")
    return cells.select(
        "track_id", "variant", (F.col("track_id") % 5).cast("int").alias("dh"), iy.alias("iy"), ix.alias("ix"),
        ((ix - 3.5) * 1.5).alias("x_rel"), ((iy - 3.5) * 1.5).alias("y_rel"),
        value.alias("a"), (value * (1 + pos % 3) + 0.01 * (F.col("track_id") % 7)).alias("b"),
    )


PATCHES = """patches AS (
  SELECT track_id, variant, dh, iy, ix, (ix - 3.5) * 1.5 AS x_rel, (iy - 3.5) * 1.5 AS y_rel, a, a * (1 + pos % 3) + 0.01 * (track_id % 7) AS b
  FROM (SELECT vec_id AS track_id, label AS variant, CAST(vec_id % 5 AS INT) AS dh, CAST(pos // 8 AS INT) AS iy, CAST(pos % 8 AS INT) AS ix, pos,
          CAST(embedding[pos + 1] AS DOUBLE) AS a
        FROM embeddings, range(0, 64) r(pos)))"""


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """event_type, nation, track_id, stage, base_ts, price: first, dearest and last order of every customer."""
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    keys = [F.col("c_mktsegment").alias("event_type"), F.col("n_name").alias("nation"), F.col("c_custkey").alias("track_id")]
    first, last = F.struct("o_orderdate", "o_orderkey"), F.struct("o_orderdate", "o_orderkey")
    top = F.struct("o_totalprice", "o_orderkey")
    g = j.groupBy(*keys).agg(
        F.min_by(F.struct("o_orderdate", "o_totalprice"), first).alias("onset"),
        F.max_by(F.struct("o_orderdate", "o_totalprice"), top).alias("peak"),
        F.max_by(F.struct("o_orderdate", "o_totalprice"), last).alias("decay"),
    )
    g = g.select(
        "event_type", "nation", "track_id",
        F.explode(F.create_map(F.lit("onset"), "onset", F.lit("peak"), "peak", F.lit("decay"), "decay")).alias("stage", "o"),
    )
    return g.select("event_type", "nation", "track_id", "stage", F.col("o.o_orderdate").alias("base_ts"), F.col("o.o_totalprice").alias("price"))


CATALOG = """cat0 AS (
  SELECT c_mktsegment AS event_type, n_name AS nation, c_custkey AS track_id,
    arg_min({'d': o_orderdate, 'p': o_totalprice}, (o_orderdate, o_orderkey)) AS onset,
    arg_max({'d': o_orderdate, 'p': o_totalprice}, (o_totalprice, o_orderkey)) AS peak,
    arg_max({'d': o_orderdate, 'p': o_totalprice}, (o_orderdate, o_orderkey)) AS decay
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3),
catalog AS (
  SELECT event_type, nation, track_id, 'onset' AS stage, onset.d AS base_ts, onset.p AS price FROM cat0
  UNION ALL SELECT event_type, nation, track_id, 'peak', peak.d, peak.p FROM cat0
  UNION ALL SELECT event_type, nation, track_id, 'decay', decay.d, decay.p FROM cat0)"""
