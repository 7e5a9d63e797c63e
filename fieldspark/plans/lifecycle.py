"""Queries: events, hours, tracks, patches, composites, calendars, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldspark.functions import columns as C
from fieldspark.functions.constants import R_EARTH
from fieldspark.operators import composite as K
from fieldspark.operators import patches as P
from fieldspark.operators import stencil as S
from fieldspark.operators import tracks as T
from fieldspark.plans.fields import PI, RAD
from fieldspark.plans.proxies import CALENDAR, CATALOG, DLAT, DLON, EVENTS, GRID, LAT0, NLAT, NLON, PATCHES, TRACKS, calendar, catalog, grid, lifecycle_events, patches, r, table, tracks
from fieldspark.operators.resample import scattered_sql
from fieldspark.plans.registry import register

# --- flagship: events at their hours, anomaly of the hour, composite by stage and hour ---

_LIFE = EVENTS + """,
ex AS (SELECT stage, track_id, CAST(dh AS INT) AS dh, base_ts + to_hours(CAST(dh AS INT)) AS ts FROM evts, range(-6, 7) h(dh)),
cl AS (SELECT hour(ts) AS hour, avg(area) AS area_bar FROM tracks GROUP BY 1),
an AS (SELECT track_id, ts, area, area - area_bar AS area_anom FROM tracks JOIN cl ON hour(ts) = hour)"""


@register("lifecycle_composite", f"""WITH {_LIFE} SELECT stage, dh, count(DISTINCT track_id) AS n_events, count(area) AS n_area, round(sum(area), 6) + 0.0 AS sum_area, round(avg(area_anom), 6) + 0.0 AS area_anom
 FROM ex JOIN an USING (track_id, ts) GROUP BY 1, 2""")
def lifecycle_composite(spark, sf):
    t = tracks(spark, sf)
    cl = t.groupBy(F.hour("ts").alias("hour")).agg(F.avg("area").alias("area_bar"))
    an = t.withColumn("hour", F.hour("ts")).join(cl, "hour").withColumn("area_anom", F.col("area") - F.col("area_bar"))
    ex = P.expand_hours(lifecycle_events(spark, sf), range(-6, 7))
    j = ex.join(an.select("track_id", "ts", "area", "area_anom"), ["track_id", "ts"])
    return j.groupBy("stage", "dh").agg(F.count_distinct("track_id").alias("n_events"), F.count("area").alias("n_area"), r(F.sum("area")).alias("sum_area"), r(F.avg("area_anom")).alias("area_anom"))


@register("expand_hours", f"WITH {EVENTS} SELECT stage, track_id, CAST(dh AS INT) AS dh, strftime(base_ts + to_hours(CAST(dh AS INT)), '%Y-%m-%d %H') AS ts FROM evts, range(-49, 25, 6) h(dh)")
def expand_hours(spark, sf):
    e = P.expand_hours(lifecycle_events(spark, sf), C.dh_range("-49:25:6"))
    return e.select("stage", "track_id", "dh", F.date_format("ts", "yyyy-MM-dd HH").alias("ts"))


@register("window_months", f"""WITH {CATALOG}, w AS (SELECT stage, track_id, date_trunc('month', CAST(base_ts - INTERVAL 49 HOUR AS DATE)) AS a, date_trunc('month', CAST(base_ts + INTERVAL 24 HOUR AS DATE)) AS b FROM catalog)
 SELECT stage, track_id, CAST(year(m) AS INT) AS year, CAST(month(m) AS INT) AS month FROM (SELECT stage, track_id, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM w)""")
def window_months(spark, sf):
    return P.window_months(catalog(spark, sf), -49, 24).select("stage", "track_id", "year", "month")


@register("lagrangian_centre", f"""WITH {EVENTS}, ex AS (SELECT stage, track_id, CAST(dh AS INT) AS dh, base_ts + to_hours(CAST(dh AS INT)) AS ts FROM evts, range(-3, 4) h(dh))
 SELECT stage, track_id, dh, round(coalesce(lat, 45.0), 6) + 0.0 AS lat_c, round(coalesce(lon, track_id), 6) + 0.0 AS lon_c FROM ex LEFT JOIN tracks USING (track_id, ts)""")
def lagrangian_centre(spark, sf):
    e = P.expand_hours(lifecycle_events(spark, sf), range(-3, 4)).withColumn("lat0", F.lit(45.0)).withColumn("lon0", F.col("track_id").cast("double"))
    c = P.lagrangian_centre(e, tracks(spark, sf))
    return c.select("stage", "track_id", "dh", r(F.col("lat_c")).alias("lat_c"), r(F.col("lon_c")).alias("lon_c"))


_CENTRES = f"""ctr AS (SELECT track_id, CAST(least(greatest(floor((lat - 20) / 6 + 0.5), 0), 9) AS INT) AS jc, CAST((floor((lon + 180) / 15 + 0.5) + 24) % 24 AS INT) AS ic
  FROM (SELECT track_id, arg_max(lat, (area, ts)) AS lat, arg_max(lon, (area, ts)) AS lon FROM tracks GROUP BY 1))"""


def _centres(spark, sf):
    t = tracks(spark, sf).groupBy("track_id").agg(F.max_by("lat", F.struct("area", "ts")).alias("lat"), F.max_by("lon", F.struct("area", "ts")).alias("lon"))
    return P.nearest_cell(t, "lat", "lon", LAT0, DLAT, NLAT, -180.0, DLON, NLON).select("track_id", "jc", "ic")


@register("nearest_cell", f"WITH {TRACKS}, {_CENTRES} SELECT track_id, jc, ic FROM ctr")
def nearest_cell(spark, sf):
    return _centres(spark, sf)


def _cut(extra: str = "", wrap: bool = True) -> str:
    rows = "CAST((ic + b + 24) % 24 AS INT)" if wrap else "CAST(ic + b AS INT)"
    gate = "" if wrap else "WHERE ic + b BETWEEN 0 AND 23"
    return f"""WITH {TRACKS}, {_CENTRES}, {GRID}, cells AS (SELECT track_id, CAST(a AS INT) AS iy, CAST(b AS INT) AS ix, CAST(jc + a AS INT) AS ilat, {rows} AS ilon FROM (SELECT * FROM ctr {extra}) c, range(-2, 3) x(a), range(-3, 4) y(b) {gate})
 SELECT track_id, iy, ix, g.level, round(u, 6) + 0.0 AS u FROM cells LEFT JOIN grid g USING (ilat, ilon)"""


def _patches(spark, sf, **kw):
    p = P.extract_patches(_centres(spark, sf), grid(spark, sf), 2, 3, NLAT, NLON, [], **kw)
    return p.select("track_id", "iy", "ix", "level", r(F.col("u")).alias("u"))


@register("extract_patches", _cut())
def extract_patches(spark, sf):
    return _patches(spark, sf)


@register("extract_patches_inside", _cut("WHERE jc BETWEEN 2 AND 7"))
def extract_patches_inside(spark, sf):
    return _patches(spark, sf, partial=False)


@register("extract_patches_no_wrap", _cut(wrap=False))
def extract_patches_no_wrap(spark, sf):
    return _patches(spark, sf, wrap=False)


@register("sample_to_patch", f"""WITH {TRACKS}, {_CENTRES}, {GRID} SELECT track_id, level, round(t, 6) + 0.0 AS t FROM ctr LEFT JOIN grid ON ilat = jc AND ilon = ic""")
def sample_to_patch(spark, sf):
    c = _centres(spark, sf).withColumnsRenamed({"jc": "ilat", "ic": "ilon"})
    return P.sample_to_patch(grid(spark, sf), c, [], ["level", "t"]).select("track_id", "level", r(F.col("t")).alias("t"))


@register("match_track", f"""WITH {EVENTS}, e AS (SELECT stage, track_id, base_ts, 40.0 AS lat0, CAST(track_id AS DOUBLE) AS lon0 FROM evts),
 d AS (SELECT e.stage, e.track_id, t.track_id AS match_id, sqrt(pow(lat - lat0, 2) + pow((((lon - lon0 + 180) % 360 + 360) % 360 - 180) * cos(lat0 * {RAD}), 2)) AS dist FROM e JOIN tracks t ON base_ts = ts)
 SELECT stage, track_id, arg_min(match_id, (dist, match_id)) AS match_id, round(min(dist), 6) + 0.0 AS dist FROM d GROUP BY 1, 2""")
def match_track(spark, sf):
    e = lifecycle_events(spark, sf).select("stage", "track_id", "base_ts", F.lit(40.0).alias("lat0"), F.col("track_id").cast("double").alias("lon0"))
    return P.match_track(e, tracks(spark, sf)).select("stage", "track_id", "match_id", r(F.col("dist")).alias("dist"))


@register("track_window", f"""WITH {EVENTS}, r AS (SELECT track_id, base_ts + INTERVAL 30 MINUTE AS ref FROM evts WHERE stage = 'peak'), n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ts) AS rn FROM tracks),
 c AS (SELECT n.*, ref, abs(epoch(ts) - epoch(ref)) AS gap FROM n JOIN r USING (track_id)), a AS (SELECT track_id, arg_min(rn, (gap, rn)) AS at0 FROM c GROUP BY 1)
 SELECT track_id, CAST(rn - at0 AS INT) AS at, round(area, 6) + 0.0 AS area FROM c JOIN a USING (track_id) WHERE abs(rn - at0) <= 2""")
def track_window(spark, sf):
    ref = lifecycle_events(spark, sf).filter("stage = 'peak'").select("track_id", (F.col("base_ts") + F.expr("INTERVAL 30 MINUTES")).alias("ref_ts"))
    return P.track_window(tracks(spark, sf), ref, 2).select("track_id", F.col("at").cast("int").alias("at"), r(F.col("area")).alias("area"))


_HOURS = f"""{EVENTS}, hrs AS (SELECT track_id, CAST(round((epoch(ts) - epoch(base_ts)) / 3600) AS INT) AS dh, area, lat, lon, ts FROM tracks JOIN evts USING (track_id) WHERE stage = 'peak')"""


def hours(spark, sf):
    """Tracks by hours from their peak: track_id, dh, area, lat, lon, ts."""
    e = lifecycle_events(spark, sf).filter("stage = 'peak'").select("track_id", "base_ts")
    dh = F.round((F.unix_seconds("ts") - F.unix_seconds("base_ts")) / 3600).cast("int")
    return tracks(spark, sf).join(e, "track_id").select("track_id", dh.alias("dh"), "area", "lat", "lon", "ts")


@register("previous_hour_blend", f"""WITH {_HOURS} SELECT h.track_id, h.dh, round(0.75 * h.area + 0.25 * (CASE WHEN p.track_id IS NULL THEN h.area ELSE p.area END), 6) + 0.0 AS blended FROM hrs h LEFT JOIN hrs p ON p.track_id = h.track_id AND p.dh = h.dh - 1""")
def previous_hour_blend(spark, sf):
    p = P.with_previous_hour(hours(spark, sf), ["track_id"], ["area"])
    return p.select("track_id", "dh", r(C.blend(F.col("area"), F.col("area_prev"), 0.75)).alias("blended"))


@register("pending_work", f"WITH {_HOURS}, w AS (SELECT DISTINCT track_id, CAST(d AS INT) AS dh FROM evts, range(-5, 6) x(d)) SELECT track_id, dh FROM w ANTI JOIN hrs USING (track_id, dh)")
def pending_work(spark, sf):
    want = P.expand_hours(lifecycle_events(spark, sf), range(-5, 6)).select("track_id", "dh").distinct()
    return P.pending(want, hours(spark, sf), ["track_id", "dh"])


def _near(k: int, key: str, step: int) -> str:
    """SQL: the area exactly k steps on (back, if negative)."""
    at = f"{abs(k) * step} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
    return f"first_value(area) OVER (PARTITION BY track_id ORDER BY {key} RANGE BETWEEN {at} AND {at})"


@register("following_tendency", f"WITH {_HOURS} SELECT track_id, dh, round(1e3 * ({_near(1, 'dh', 1)} - {_near(-1, 'dh', 1)}) / 7200, 6) + 0.0 AS dadt FROM hrs")
def following_tendency(spark, sf):
    h = hours(spark, sf)
    return h.select("track_id", "dh", r(P.following_tendency("area", ["track_id"]), 1e3).alias("dadt"))


_M = f"({PI} / 180 * {R_EARTH})"


@register("track_velocity", f"""WITH {TRACKS}, v AS (SELECT *, coalesce(lead(lat) OVER w, lat) - coalesce(lag(lat) OVER w, lat) AS dl, coalesce(lead(lon) OVER w, lon) - coalesce(lag(lon) OVER w, lon) AS dx,
  coalesce(lead(epoch(ts)) OVER w, epoch(ts)) - coalesce(lag(epoch(ts)) OVER w, epoch(ts)) AS dt FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY ts))
 SELECT track_id, strftime(ts, '%Y-%m-%d %H') AS hour, round(CASE WHEN dt > 0 THEN (((dx + 180) % 360 + 360) % 360 - 180) * {_M} * cos(lat * {RAD}) / dt END, 6) + 0.0 AS u_c, round(CASE WHEN dt > 0 THEN dl * {_M} / dt END, 6) + 0.0 AS v_c FROM v""")
def track_velocity(spark, sf):
    t = T.track_velocity(tracks(spark, sf))
    return t.select("track_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), r(F.col("u_c")).alias("u_c"), r(F.col("v_c")).alias("v_c"))


@register("track_interior", f"WITH {TRACKS}, n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ts) AS k, count(*) OVER (PARTITION BY track_id) AS n FROM tracks) SELECT track_id, strftime(ts, '%Y-%m-%d %H') AS hour FROM n WHERE k > 1 AND k < n")
def track_interior(spark, sf):
    return T.interior(tracks(spark, sf)).select("track_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"))


_INT = f"""{_HOURS}, sp AS (SELECT track_id, dh, CASE WHEN dh % 5 = 0 THEN NULL ELSE lon / 20 END AS ax, lat / 10 AS ay FROM hrs),
 la AS (SELECT *, 40.0 + coalesce(sum(coalesce(ay, 0) * 3600 * 180 / (pi() * {R_EARTH})) OVER w, 0) AS lat FROM sp WINDOW w AS (PARTITION BY track_id ORDER BY dh ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 lo AS (SELECT track_id, dh, lat, 10.0 + coalesce(sum(coalesce(ax, 0) * 3600 * 180 / (pi() * {R_EARTH}) / cos(lat * {RAD})) OVER w, 0) AS lon FROM la WINDOW w AS (PARTITION BY track_id ORDER BY dh ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _integrated(spark, sf):
    sp = hours(spark, sf).select("track_id", "dh", F.when(F.col("dh") % 5 != 0, F.col("lon") / 20).alias("ax"), (F.col("lat") / 10).alias("ay"))
    start = sp.select("track_id").distinct().select("track_id", F.lit(40.0).alias("lat0"), F.lit(10.0).alias("lon0"))
    return T.integrate_track(sp, start)


@register("integrate_track", f"WITH {_INT} SELECT track_id, dh, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon FROM lo")
def integrate_track(spark, sf):
    return _integrated(spark, sf).select("track_id", "dh", r(F.col("lat")).alias("lat"), r(F.col("lon")).alias("lon"))


@register("endpoint_error", f"""WITH {_INT}, f AS (SELECT track_id, arg_max(lat, dh) AS lat, arg_max(lon, dh) AS lon FROM lo GROUP BY 1), t AS (SELECT track_id, arg_max(lat, dh) AS lat, arg_max(lon, dh) AS lon FROM hrs GROUP BY 1)
 SELECT track_id, round({PI} / 180 * {R_EARTH} / 1000 * sqrt(pow(f.lat - t.lat, 2) + pow((((f.lon - t.lon + 180) % 360 + 360) % 360 - 180) * cos(t.lat * {RAD}), 2)), 3) + 0.0 AS km FROM f JOIN t USING (track_id)""")
def endpoint_error(spark, sf):
    return T.endpoint_error(_integrated(spark, sf), hours(spark, sf)).select("track_id", r(F.col("km"), 1, 3).alias("km"))


@register("stacked_bars", f"""WITH {CATALOG}, l AS (SELECT nation AS term, year(base_ts) AS dh, avg(price) - 150000 AS v FROM catalog GROUP BY 1, 2)
 SELECT dh, term, round(sum(greatest(v, 0)) OVER w, 4) + 0.0 AS top, round(sum(least(v, 0)) OVER w, 4) + 0.0 AS bottom FROM l WINDOW w AS (PARTITION BY dh ORDER BY term)""")
def stacked_bars(spark, sf):
    life = catalog(spark, sf).groupBy(F.col("nation").alias("term"), F.year("base_ts").cast("long").alias("dh")).agg((F.avg("price") - 150000).alias("v"))
    return T.stacked(life, "v").select("dh", "term", r(F.col("top"), 1, 4).alias("top"), r(F.col("bottom"), 1, 4).alias("bottom"))


@register("longest_runs", f"""WITH {_HOURS}, a AS (SELECT track_id, dh, dh - row_number() OVER (PARTITION BY track_id ORDER BY dh) AS run FROM hrs), b AS (SELECT *, count(*) OVER (PARTITION BY track_id, run) AS n FROM a),
 c AS (SELECT track_id, arg_max(run, (n, -run)) AS run FROM b GROUP BY 1) SELECT b.track_id, b.dh FROM b JOIN c USING (track_id, run) WHERE n >= 2""")
def longest_runs(spark, sf):
    return T.longest_run(hours(spark, sf).select("track_id", "dh"), ["track_id"], "dh", 2)


@register("coef_series", f"""WITH {CATALOG} SELECT year(base_ts) AS dh, {', '.join(f"round(avg(price) FILTER (stage = '{s}'), 4) + 0.0 AS {s}" for s in ('onset', 'peak', 'decay'))} FROM catalog GROUP BY 1""")
def coef_series(spark, sf):
    c = catalog(spark, sf).select(F.year("base_ts").cast("long").alias("dh"), F.col("stage").alias("variant"), "price")
    s = T.coef_series(c, "price", ["onset", "peak", "decay"])
    return s.select("dh", *[r(F.col(v), 1, 4).alias(v) for v in ("onset", "peak", "decay")])


# --- calendar ---


@register("climatology", f"WITH {CALENDAR} SELECT month(d) AS month, day(d) AS day, round(avg(x), 6) + 0.0 AS x_bar, count(*) AS n FROM calendar WHERE year(d) >= 1996 AND year(d) < 2001 GROUP BY 1, 2")
def climatology(spark, sf):
    c = calendar(spark, sf).select(F.col("d").cast("timestamp").alias("ts"), "x")
    m = K.compute_climatology(c, ["x"], [], (1996, 2001))
    n = c.filter("year(ts) >= 1996 AND year(ts) < 2001").groupBy(F.month("ts").alias("month"), F.day("ts").alias("day")).agg(F.count("*").alias("n"))
    return m.join(n, ["month", "day"]).select(F.col("month").cast("long").alias("month"), F.col("day").cast("long").alias("day"), r(F.col("x_bar")).alias("x_bar"), "n")


@register("anomaly", f"WITH {CALENDAR}, c AS (SELECT month(d) AS m, day(d) AS dd, avg(x) AS b FROM calendar GROUP BY 1, 2) SELECT strftime(d, '%Y-%m-%d') AS d, round(x - b, 6) + 0.0 AS x_anom FROM calendar JOIN c ON month(d) = m AND day(d) = dd")
def anomaly(spark, sf):
    c = calendar(spark, sf).select(F.col("d").cast("timestamp").alias("ts"), "x")
    a = K.anomaly(c, K.compute_climatology(c, ["x"], []), ["x"], [])
    return a.select(F.date_format("ts", "yyyy-MM-dd").alias("d"), r(F.col("x_anom")).alias("x_anom"))


@register("split_anomaly_left", f"WITH {CALENDAR}, c AS (SELECT month(d) AS m, day(d) AS dd, avg(x) AS b FROM calendar WHERE month(d) < 7 GROUP BY 1, 2) SELECT strftime(d, '%Y-%m-%d') AS d, round(x - coalesce(b, 0), 6) + 0.0 AS x_anom FROM calendar LEFT JOIN c ON month(d) = m AND day(d) = dd")
def split_anomaly_left(spark, sf):
    c = calendar(spark, sf).select(F.col("d").cast("timestamp").alias("ts"), "x")
    a = K.anomaly(c, K.compute_climatology(c.filter("month(ts) < 7"), ["x"], []), ["x"], [], "left", 0.0)
    return a.select(F.date_format("ts", "yyyy-MM-dd").alias("d"), r(F.col("x_anom")).alias("x_anom"))


@register("smooth_climatology", f"""WITH {CALENDAR}, m AS (SELECT month(d) - 1 AS k, avg(x) AS x FROM calendar GROUP BY 1),
 c AS (SELECT avg(x) AS m0, {', '.join(f"2 * sum(x * cos(2 * {PI} * {m} * k / 12)) / 12 AS c{m}, 2 * sum(x * sin(2 * {PI} * {m} * k / 12)) / 12 AS s{m}" for m in (1, 2, 3, 4))} FROM m)
 SELECT CAST(k AS INT) AS k, round(m0 + {' + '.join(f"c{m} * cos(2 * {PI} * {m} * k / 12) + s{m} * sin(2 * {PI} * {m} * k / 12)" for m in (1, 2, 3, 4))}, 6) + 0.0 AS x FROM m, c""")
def smooth_climatology(spark, sf):
    m = calendar(spark, sf).groupBy((F.month("d") - 1).alias("k")).agg(F.avg("x").alias("x"))
    return S.fourier_filter(m, "x", "y", [], "k", 12, 4).select("k", r(F.col("y")).alias("x"))


_SEC = "CAST(epoch(ts) AS BIGINT)"


@register("time_derivative", f"WITH {_HOURS} SELECT track_id, dh, round(1e3 * CASE WHEN b IS NULL AND a IS NULL THEN NULL WHEN b IS NULL THEN (a - area) / 3600 WHEN a IS NULL THEN (area - b) / 3600 ELSE (a - b) / 7200 END, 6) + 0.0 AS dadt FROM (SELECT *, {_near(-1, _SEC, 3600)} AS b, {_near(1, _SEC, 3600)} AS a FROM hrs)")
def time_derivative(spark, sf):
    return hours(spark, sf).select("track_id", "dh", r(S.ddt(F.col("area"), ["track_id"], 3600.0), 1e3).alias("dadt"))


@register("time_derivative_second_order", f"""WITH {_HOURS} SELECT track_id, dh, round(1e3 * CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a - b) / 7200 WHEN a IS NOT NULL AND a2 IS NOT NULL THEN (-3 * area + 4 * a - a2) / 7200 WHEN b IS NOT NULL AND b2 IS NOT NULL THEN (3 * area - 4 * b + b2) / 7200
   WHEN a IS NOT NULL THEN (a - area) / 3600 WHEN b IS NOT NULL THEN (area - b) / 3600 END, 6) + 0.0 AS dadt FROM (SELECT *, {_near(-1, _SEC, 3600)} AS b, {_near(1, _SEC, 3600)} AS a, {_near(-2, _SEC, 3600)} AS b2, {_near(2, _SEC, 3600)} AS a2 FROM hrs)""")
def time_derivative_second_order(spark, sf):
    return hours(spark, sf).select("track_id", "dh", r(S.ddt(F.col("area"), ["track_id"], 3600.0, 2), 1e3).alias("dadt"))


# --- composites on embedding patches ---


@register("build_composites", f"WITH {PATCHES} SELECT variant, dh, iy, ix, round(sum(a), 6) + 0.0 AS sum_a, count(a) AS n_a, round(sum(b), 6) + 0.0 AS sum_b, count(b) AS n_b FROM patches GROUP BY 1, 2, 3, 4")
def build_composites(spark, sf):
    c = K.build_composites(patches(spark, sf), ["a", "b"], ["variant", "dh", "iy", "ix"])
    return c.select("variant", "dh", "iy", "ix", r(F.col("sum_a")).alias("sum_a"), "n_a", r(F.col("sum_b")).alias("sum_b"), "n_b")


@register("composite_mean_gaps", f"WITH {PATCHES} SELECT variant, iy, ix, round(avg(CASE WHEN a > 0 THEN a END), 6) + 0.0 AS a FROM patches GROUP BY 1, 2, 3")
def composite_mean_gaps(spark, sf):
    p = patches(spark, sf).withColumn("a", F.when(F.col("a") > 0, F.col("a")))
    return K.composite_mean(K.build_composites(p, ["a"], ["variant", "iy", "ix"]), ["a"]).select("variant", "iy", "ix", r(F.col("a")).alias("a"))


@register("merge_composites", f"WITH {PATCHES} SELECT variant, iy, ix, round(sum(a), 6) + 0.0 AS sum_a, count(a) AS n_a FROM patches GROUP BY 1, 2, 3")
def merge_composites(spark, sf):
    """Composites of odd and even tracks, merged."""
    p, keys = patches(spark, sf), ["variant", "iy", "ix"]
    m = K.merge_composites(K.build_composites(p.filter("track_id % 2 = 0"), ["a"], keys), K.build_composites(p.filter("track_id % 2 <> 0"), ["a"], keys))
    return m.select(*keys, r(F.col("sum_a")).alias("sum_a"), "n_a")


@register("composite_variants", f"""WITH {PATCHES}, e AS (SELECT DISTINCT track_id, variant FROM patches), m AS (SELECT track_id, 'v' || variant AS variant FROM e UNION ALL SELECT track_id, 'even' FROM e WHERE track_id % 2 = 0 UNION ALL SELECT track_id, 'original' FROM e)
 SELECT m.variant, iy, ix, round(sum(a), 6) + 0.0 AS sum_a, count(a) AS n_a FROM m JOIN patches p USING (track_id) GROUP BY 1, 2, 3""")
def composite_variants(spark, sf):
    p = patches(spark, sf).withColumn("stage", F.lit("peak"))
    e = p.select("stage", "track_id", "variant").distinct()
    m = e.select("stage", "track_id", F.concat(F.lit("v"), F.col("variant").cast("string")).alias("variant")).union(e.filter("track_id % 2 = 0").select("stage", "track_id", F.lit("even")))
    c = K.build_composites(K.with_variants(p.drop("variant"), m), ["a"], ["variant", "iy", "ix"])
    return c.select("variant", "iy", "ix", r(F.col("sum_a")).alias("sum_a"), "n_a")


@register("composite_count", f"WITH {PATCHES} SELECT variant, dh, count(DISTINCT track_id) AS n_events FROM patches GROUP BY 1, 2")
def composite_count(spark, sf):
    return K.composite_count(patches(spark, sf), ["variant", "dh"])


@register("available_hours", f"WITH {PATCHES} SELECT variant, array_to_string(list_sort(list(DISTINCT dh)), ',') AS hours FROM patches GROUP BY 1")
def available_hours(spark, sf):
    h = K.available_hours(patches(spark, sf), ["variant"])
    return h.select("variant", F.array_join(F.transform("hours", lambda x: x.cast("string")), ",").alias("hours"))


@register("vertical_mean", f"""WITH {GRID} SELECT ilat, ilon, round(sum(w0 * u) / sum(CASE WHEN u IS NOT NULL THEN w0 END), 6) + 0.0 AS u, round(CASE WHEN count(t) = count(*) THEN sum(w0 * t) / sum(w0) END, 6) + 0.0 AS t
 FROM (SELECT *, exp(-z / 7000.0) AS w0 FROM grid WHERE level IN (240, 390, 560)) GROUP BY 1, 2""")
def vertical_mean(spark, sf):
    g, keys, lv = grid(spark, sf), ["ilat", "ilon"], [240, 390, 560]
    m = K.vertical_mean(g, ["u"], keys, lv).join(K.vertical_mean(g, ["t"], keys, lv, mask="none"), keys)
    return m.select(*keys, r(F.col("u")).alias("u"), r(F.col("t")).alias("t"))


@register("pressure_mean", f"""WITH {GRID} SELECT ilat, ilon, round(sum(dp * u) / sum(CASE WHEN u IS NOT NULL THEN dp END), 6) + 0.0 AS u FROM (SELECT *, (coalesce(lead(level) OVER w, level) - coalesce(lag(level) OVER w, level)) / 2.0 AS dp FROM grid WINDOW w AS (PARTITION BY ilat, ilon ORDER BY level)) GROUP BY 1, 2""")
def pressure_mean(spark, sf):
    return K.vertical_mean(grid(spark, sf), ["u"], ["ilat", "ilon"], None, weight="dp").select("ilat", "ilon", r(F.col("u")).alias("u"))


@register("nearest_level", f"WITH {GRID} SELECT ilat, ilon, level, round(u, 6) + 0.0 AS u FROM grid WHERE level = 560")
def nearest_level(spark, sf):
    return K.reduce_2d(grid(spark, sf), ["level", "u"], ["ilat", "ilon"], 500).select("ilat", "ilon", "level", r(F.col("u")).alias("u"))


@register("align_levels", f"WITH {GRID}, f AS (SELECT * FROM grid WHERE NOT (level = 390 AND (ilat + ilon) % 3 = 0) AND level IN (240, 390, 560)) SELECT ilat, ilon, level, round(u, 6) + 0.0 AS u FROM f WHERE (ilat + ilon) % 3 <> 0")
def align_levels(spark, sf):
    g = grid(spark, sf).filter("NOT (level = 390 AND (ilat + ilon) % 3 = 0)")
    return K.align_levels(g, [240, 390, 560], ["ilat", "ilon"]).select("ilat", "ilon", "level", r(F.col("u")).alias("u"))


@register("coef_stats", f"WITH {CATALOG} SELECT stage, event_type, round(avg(price), 6) + 0.0 AS mean, round(stddev_pop(price), 5) + 0.0 AS std, round(stddev_pop(price) / sqrt(count(price)), 5) + 0.0 AS sem, count(price) AS n FROM catalog GROUP BY 1, 2")
def coef_stats(spark, sf):
    s = K.coef_stats(catalog(spark, sf), "price", ["stage", "event_type"])
    return s.select("stage", "event_type", r(F.col("mean")).alias("mean"), *[r(F.col(c), 1, 5).alias(c) for c in ("std", "sem")], "n")


@register("field_corr", f"WITH {PATCHES} SELECT variant, dh, round(corr(a, b), 6) + 0.0 AS corr, round(avg(abs(a)) / avg(abs(b)), 6) + 0.0 AS ratio FROM patches GROUP BY 1, 2")
def field_corr(spark, sf):
    return K.field_corr(patches(spark, sf), "a", "b", ["variant", "dh"]).select("variant", "dh", r(F.col("corr")).alias("corr"), r(F.col("ratio")).alias("ratio"))


@register("xsection", f"""WITH {GRID}, s AS (SELECT level, ilon AS ix, max(u) FILTER (ilat = 4) AS middle, avg(u) AS mean FROM grid GROUP BY 1, 2) SELECT level, ix, round(middle, 6) + 0.0 AS middle, round(mean, 6) + 0.0 AS mean, round(mean - avg(mean) OVER (PARTITION BY level), 6) + 0.0 AS departure FROM s""")
def xsection(spark, sf):
    x = K.xsection(grid(spark, sf).withColumnsRenamed({"ilat": "iy", "ilon": "ix"}), "u", [], 4)
    return x.select("level", "ix", *[r(F.col(c)).alias(c) for c in ("middle", "mean", "departure")])


@register("color_range", f"WITH {PATCHES} SELECT variant, round(quantile_cont(abs(a), 0.95), 6) + 0.0 AS vmax FROM patches GROUP BY 1")
def color_range(spark, sf):
    return K.color_range(patches(spark, sf), "a", ["variant"]).select("variant", r(F.col("vmax")).alias("vmax"))


@register("eddy_covariance", f"WITH {PATCHES} SELECT variant, iy, round(avg(a * b), 6) + 0.0 AS mean_product, round(avg(a) * avg(b), 6) + 0.0 AS product_mean, round(covar_pop(a, b), 6) + 0.0 AS covariance FROM patches GROUP BY 1, 2")
def eddy_covariance(spark, sf):
    e = K.eddy_covariance(patches(spark, sf), "a", "b", ["variant", "iy"])
    return e.select("variant", "iy", *[r(F.col(c)).alias(c) for c in ("mean_product", "product_mean", "covariance")])


@register("rmse", f"WITH {PATCHES} SELECT track_id, round(sqrt(avg(pow(a - b, 2))), 6) + 0.0 AS rmse FROM patches GROUP BY 1")
def rmse(spark, sf):
    return patches(spark, sf).groupBy("track_id").agg(r(K.rmse(F.col("a"), F.col("b"))).alias("rmse"))


@register("fill_median_range", f"WITH {GRID}, f AS (SELECT level, ilat, ilon, CASE WHEN (ilat + ilon) % 4 <> 0 THEN u END AS u FROM grid) SELECT level, ilat, ilon, round(coalesce(u, median(u) OVER w), 6) + 0.0 AS filled, round(min(u) OVER w, 6) + 0.0 AS lo, round(max(u) OVER w, 6) + 0.0 AS hi FROM f WINDOW w AS (PARTITION BY level)")
def fill_median_range(spark, sf):
    g = grid(spark, sf).withColumn("u", F.when((F.col("ilat") + F.col("ilon")) % 4 != 0, F.col("u")))
    lo, hi = K.column_range("u", ["level"])
    return g.select("level", "ilat", "ilon", r(K.fill_median("u", ["level"])).alias("filled"), r(lo).alias("lo"), r(hi).alias("hi"))


@register("sig_summary", f"WITH {PATCHES} SELECT variant, round(avg(CAST(a > 0.1 AS INT)), 6) + 0.0 AS share, round(avg(abs(a - b)), 6) + 0.0 AS resid FROM patches GROUP BY 1")
def sig_summary(spark, sf):
    p = patches(spark, sf).withColumn("sig", F.col("a") > 0.1).withColumn("resid", F.col("a") - F.col("b"))
    return K.sig_summary(p, ["variant"]).select("variant", r(F.col("share")).alias("share"), r(F.col("resid")).alias("resid"))


# --- predicates, sets, top-k ---


@register("catalog_filters", f"WITH {CATALOG} SELECT event_type, stage, track_id, round(price, 4) + 0.0 AS price FROM catalog WHERE year(base_ts) >= 1996 AND year(base_ts) < 1999 AND stage IN ('onset', 'peak') AND track_id NOT IN (SELECT track_id FROM catalog WHERE nation = 'NATION_3' OR price > 400000)")
def catalog_filters(spark, sf):
    from fieldspark.sources import normalize as N

    c = catalog(spark, sf)
    out = N.exclude(N.filter_stages(N.filter_years(c, 1996, 1999), ["onset", "peak"]), c.filter("nation = 'NATION_3' OR price > 400000").select("track_id").distinct())
    return out.select("event_type", "stage", "track_id", r(F.col("price"), 1, 4).alias("price"))


_SETS = f"{CATALOG}, s AS (SELECT DISTINCT track_id, event_type, price > 200000 AS awb, month(base_ts) < 4 AS cwb FROM catalog WHERE stage = 'peak')"


def _flags(spark, sf):
    c = catalog(spark, sf).filter("stage = 'peak'")
    return c.select("track_id", "event_type", (F.col("price") > 200000).alias("awb"), (F.month("base_ts") < 4).alias("cwb")).distinct()


@register("variant_sets", f"WITH {_SETS} SELECT track_id, 'NEUTRAL' AS variant FROM ((SELECT track_id FROM s) EXCEPT (SELECT track_id FROM s WHERE awb UNION SELECT track_id FROM s WHERE cwb)) UNION ALL SELECT track_id, 'Omega' FROM ((SELECT track_id FROM s WHERE awb) INTERSECT (SELECT track_id FROM s WHERE cwb)) UNION ALL SELECT track_id, 'ALL' FROM s")
def variant_sets(spark, sf):
    from fieldspark.operators import sets as Z

    f = _flags(spark, sf)
    every, awb, cwb = f.select("track_id"), f.filter("awb").select("track_id"), f.filter("cwb").select("track_id")
    return Z.named({"NEUTRAL": Z.neutral(every, awb, cwb), "Omega": Z.omega(awb, cwb), "ALL": every})


@register("combine_types", f"WITH {CATALOG} SELECT track_id, stage, event_type FROM catalog WHERE event_type IN ('BUILDING', 'MACHINERY')")
def combine_types(spark, sf):
    from fieldspark.operators import sets as Z

    c = catalog(spark, sf).select("track_id", "stage", "event_type")
    return Z.combine(c.filter("event_type = 'BUILDING'"), c.filter("event_type = 'MACHINERY'"))


@register("keep_ids", f"WITH {_SETS} SELECT stage, track_id FROM catalog WHERE track_id IN (SELECT track_id FROM s WHERE awb)")
def keep_ids(spark, sf):
    from fieldspark.sources import normalize as N

    return N.keep_ids(catalog(spark, sf), _flags(spark, sf).filter("awb").select("track_id")).select("stage", "track_id")


@register("top_per_group", f"WITH {CATALOG}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type, stage ORDER BY price DESC, track_id) AS k FROM catalog) SELECT event_type, stage, track_id, round(price, 4) + 0.0 AS price FROM r WHERE k = 1")
def top_per_group(spark, sf):
    from fieldspark.operators import sets as Z

    return Z.top_per_group(catalog(spark, sf), ["event_type", "stage"], [F.desc("price"), F.asc("track_id")]).select("event_type", "stage", "track_id", r(F.col("price"), 1, 4).alias("price"))


@register("first_events", f"WITH {CATALOG} SELECT track_id, stage, event_type FROM catalog WHERE stage = 'peak' ORDER BY track_id LIMIT 20")
def first_events(spark, sf):
    from fieldspark.operators import sets as Z

    return Z.first_n(catalog(spark, sf).filter("stage = 'peak'").select("track_id", "stage", "event_type"), "track_id", 20)


@register("seeded_pick", f"WITH {TRACKS} SELECT track_id FROM (SELECT DISTINCT track_id FROM tracks) ORDER BY {scattered_sql(7, 'track_id')}, track_id LIMIT 1")
def seeded_pick(spark, sf):
    from fieldspark.operators import sets as Z

    return Z.seeded_pick(tracks(spark, sf).select("track_id").distinct(), "track_id", 7)


@register("compare_groups", f"""WITH {CATALOG}, g AS (SELECT event_type, year(base_ts) AS term, avg(price) AS m FROM catalog GROUP BY 1, 2)
 SELECT a.term, round(a.m - b.m, 4) + 0.0 AS diff FROM g a JOIN g b ON a.term = b.term AND a.event_type = 'BUILDING' AND b.event_type = 'MACHINERY'""")
def compare_groups(spark, sf):
    g = catalog(spark, sf).groupBy("event_type", F.year("base_ts").cast("long").alias("term")).agg(F.avg("price").alias("m"))
    a, b = (g.filter(F.col("event_type") == t).select("term", F.col("m").alias(n)) for t, n in (("BUILDING", "ma"), ("MACHINERY", "mb")))
    return a.join(b, "term").select("term", r(F.col("ma") - F.col("mb"), 1, 4).alias("diff"))


@register("names_and_keys", f"""WITH {EVENTS} SELECT track_id, stage, 'track_' || track_id || '_' || strftime(base_ts, '%Y%m%d%H') || '_dh+' || (track_id % 3) AS key, track_id AS id_back, CAST(track_id % 3 AS INT) AS dh_back FROM evts""")
def names_and_keys(spark, sf):
    e = lifecycle_events(spark, sf)
    e = e.withColumn("key", C.patch_key(F.col("track_id"), F.col("base_ts"), (F.col("track_id") % 3).cast("int")))
    return e.select("track_id", "stage", "key", C.track_id_of(F.col("key")).alias("id_back"), C.dh_of(F.regexp_replace("key", "_dh", "/dh=")).alias("dh_back"))
