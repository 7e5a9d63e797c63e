"""Queries that go through sources, sinks, streams and whole jobs."""

from __future__ import annotations

from datetime import datetime

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldspark.functions.constants import KAPPA, OMEGA, R_EARTH, SCALE_HEIGHT
from fieldspark.operators import composite as K
from fieldspark.operators import invert
from fieldspark.operators import isentropic as I
from fieldspark.operators import patches as P
from fieldspark.operators import stencil as T
from fieldspark.operators import terms as M
from fieldspark.plans import jobs
from fieldspark.plans.fields import HEAT, PI, RAD, TH, sql_ddp, sql_ddx, sql_ddy, sql_lap
from fieldspark.plans.inversion import WIND
from fieldspark.plans.lifecycle import hours
from fieldspark.plans.proxies import CATALOG, DLAT, DLON, GRID, LAT0, NLAT, NLON, PATCHES, TRACKS, catalog, grid, lifecycle_events, patches, r, tracks
from fieldspark.plans.registry import register
from fieldspark.sources import normalize as N
from fieldspark.sources import tables as S
from fieldspark.sources.scratch import scratch, written
from fieldspark.streaming import incremental


@register("read_events", f"WITH {CATALOG} SELECT event_type, stage, track_id, round(price / 10000, 6) + 0.0 AS lat0, strftime(base_ts, '%Y-%m-%d %H:%M:%S') AS base_ts FROM catalog")
def read_events(spark, sf):
    """Catalogue written as CSV with other headers, read back."""
    path = scratch(spark, "events")
    c = catalog(spark, sf).select(F.col("event_type").alias("type"), "stage", "track_id", (F.col("price") / 10000).alias("lat"), F.lit(0.0).alias("lon180"), F.col("base_ts").alias("timestamp"))
    c.write.option("header", True).csv(path)
    e = S.read_events(spark, path)
    return e.select("event_type", "stage", "track_id", r(F.col("lat0")).alias("lat0"), F.date_format("base_ts", "yyyy-MM-dd HH:mm:ss").alias("base_ts"))


@register("read_tracks", f"WITH {TRACKS} SELECT track_id, CAST(hour(ts) AS INT) AS step, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(lat, 6) + 0.0 AS lat FROM tracks")
def read_tracks(spark, sf):
    """Tracks written as tab-separated text with a header, read back."""
    path = scratch(spark, "tracks")
    line = F.format_string('%d\t%d\t"%s"\t%.9f\t%.9f\t%.6f', "track_id", F.hour("ts"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "lat", F.pmod("lon", F.lit(360.0)), "area")
    t = tracks(spark, sf).select(line.alias("value"))
    t.union(spark.createDataFrame([("id\thour\ttime\tlat\tlon\tarea",)], "value string")).write.text(path)
    return S.read_tracks(spark, path).select("track_id", "step", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), r(F.col("lat")).alias("lat"))


@register("read_exclude", f"WITH {CATALOG} SELECT DISTINCT track_id FROM catalog WHERE price > 300000")
def read_exclude(spark, sf):
    path = scratch(spark, "exclude")
    catalog(spark, sf).filter("price > 300000").select(F.concat(F.col("track_id").cast("string"), F.lit(",too dear")).alias("value")).write.text(path)
    return S.read_exclude(spark, path).union(S.read_exclude(spark, path + "-none"))


@register("field_round_trip", f"WITH {GRID} SELECT ilat, ilon, round(avg(CAST(CAST(u AS FLOAT) AS DOUBLE)), 4) + 0.0 AS u, count(*) AS n FROM grid, (VALUES (6), (7)) m(month) WHERE level <= 560 GROUP BY 1, 2")
def field_round_trip(spark, sf):
    """Three months written with archive headers, the two of the window read back."""
    path = scratch(spark, "field")
    g = grid(spark, sf).withColumn("m", F.explode(F.array(F.lit(5), F.lit(6), F.lit(7)))).withColumn("valid_time", F.make_timestamp(F.lit(2010), "m", F.lit(15), F.lit(0), F.lit(0), F.lit(0)))
    S.write_field(g.drop("m").withColumn("number", F.lit(0)).withColumnsRenamed({"level": "pressure_level", "lat": "latitude", "lon": "longitude"}), path)
    f = N.select_levels(S.read_field(spark, path, ["u"], datetime(2010, 6, 1), datetime(2010, 7, 31)), [110, 240, 390, 560])
    return N.crop_nh(N.fold_lon(f)).groupBy("ilat", "ilon").agg(r(F.avg("u"), 1, 4).alias("u"), F.count("*").alias("n"))


@register("merge_variables", f"WITH {GRID} SELECT level, ilat, ilon, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v FROM grid WHERE u > 20 AND v > 4")
def merge_variables(spark, sf):
    g, keys = grid(spark, sf), ["level", "ilat", "ilon"]
    m = S.merge_variables([g.filter("u > 20").select(*keys, "u"), g.filter("v > 4").select(*keys, "v")], keys)
    return m.select(*keys, r(F.col("u")).alias("u"), r(F.col("v")).alias("v"))


@register("clim_round_trip", f"WITH {GRID} SELECT level, ilat, ilon, round(u, 6) + 0.0 AS u_bar FROM grid")
def clim_round_trip(spark, sf):
    """Raw written, smoothed asked for: raw comes back."""
    path = scratch(spark, "clim")
    S.write_clim(grid(spark, sf).select("level", "ilat", "ilon", F.col("u").alias("u_bar"), F.lit(6).alias("month")), path, False)
    return S.read_clim(spark, path, [6], prefer_smooth=True).select("level", "ilat", "ilon", r(F.col("u_bar")).alias("u_bar"))


@register("patch_round_trip", f"WITH {PATCHES} SELECT track_id, dh, count(*) AS n, round(sum(a), 6) + 0.0 AS a FROM patches WHERE dh = 2 GROUP BY 1, 2")
def patch_round_trip(spark, sf):
    path = scratch(spark, "patches")
    S.write_patches(patches(spark, sf).withColumn("event_type", F.lit("x")).withColumn("stage", F.lit("onset")), path)
    return S.read_patches(spark, path, "onset", 2, "skip").groupBy("track_id", "dh").agg(F.count("*").alias("n"), r(F.sum("a")).alias("a"))


@register("patch_meta", f"WITH {PATCHES} SELECT DISTINCT track_id, dh FROM patches")
def patch_meta(spark, sf):
    return S.patch_meta(patches(spark, sf)).select("track_id", "dh")


@register("composite_round_trip", f"WITH {PATCHES} SELECT iy, ix, round(sum(a), 6) + 0.0 AS sum_a, count(a) AS n_a FROM patches WHERE variant = 3 AND dh = 1 GROUP BY 1, 2")
def composite_round_trip(spark, sf):
    path = scratch(spark, "composite")
    p = patches(spark, sf).withColumn("stage", F.lit("Peak")).withColumn("variant", F.concat(F.lit("V"), F.col("variant").cast("string")))
    S.write_composite(K.build_composites(p, ["a"], ["variant", "stage", "dh", "iy", "ix"]), path)
    return N.pick(S.read_composite(spark, path), "v3", "PEAK", 1).select("iy", "ix", r(F.col("sum_a")).alias("sum_a"), "n_a")


@register("missing_values", f"WITH {GRID} SELECT level, count(u) FILTER (u > 25) AS n FROM grid GROUP BY 1")
def missing_values(spark, sf):
    """NaN and infinities become missing."""
    g = grid(spark, sf).withColumn("u", F.when(F.col("u") > 25, F.col("u")).when(F.col("ilat") % 2 == 0, float("nan")).otherwise(float("inf")))
    return N.clean(g).groupBy("level").agg(F.count("u").alias("n"))


@register("stream_composites", f"WITH {PATCHES} SELECT variant, iy, ix, round(sum(a), 6) + 0.0 AS sum_a, count(a) AS n_a FROM patches GROUP BY 1, 2, 3")
def stream_composites(spark, sf):
    """Three arrivals: every second patch and half the cells of the others, then everything; every cell counts once."""
    src, state, check = (scratch(spark, n) for n in ("arrivals", "state", "offsets"))
    p = patches(spark, sf).select("track_id", "dh", "variant", "iy", "ix", "a")
    args = dict(fields=["a"], keys=["variant", "iy", "ix"], by=["variant"], patch=["dh", "track_id"], cell={"iy": (0, 8), "ix": (0, 8)}, checkpoint=check)
    for arrival in (p.filter("track_id % 2 = 0"), p.filter("track_id % 2 = 1 AND iy < 4"), p):
        arrival.write.mode("append").parquet(src)
        incremental.stream_composites(spark, src, p.schema, state, **args)
    return incremental.current_composite(spark, state, ["variant"]).select("variant", "iy", "ix", r(F.col("sum_a")).alias("sum_a"), "n_a")


@register("stream_pending", f"WITH {CATALOG} SELECT DISTINCT track_id, stage FROM catalog WHERE NOT (stage = 'onset' AND track_id % 2 = 0)")
def stream_pending(spark, sf):
    src, out, check = (scratch(spark, n) for n in ("catalogue", "work", "offsets"))
    c = catalog(spark, sf).select("track_id", "stage")
    c.write.option("header", True).csv(src)
    incremental.stream_pending(spark, src, c.schema, lambda: c.filter("stage = 'onset' AND track_id % 2 = 0"), ["track_id", "stage"], lambda d: d.write.mode("append").parquet(out), check)
    return spark.read.parquet(out).distinct()


# --- jobs on the gridded view, repeated for the hours of the tracks ---

_SPEC = jobs.ComputeConfig(jobs.GridSpec(LAT0, DLAT, NLAT, -180.0, DLON, NLON), 2, 3)


def _world(spark, sf):
    """Three hours of the grid in two years, scaled by hour and year; and its climatology."""
    g = grid(spark, sf).withColumn("h", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("y", F.explode(F.array(F.lit(0), F.lit(1))))
    g = g.withColumn("ts", F.make_timestamp(2010 + F.col("y"), F.lit(6), F.lit(15), F.col("h"), F.lit(0), F.lit(0)))
    g = g.withColumn("pv", F.col("pv") * (1 + 0.1 * F.col("h") + 0.2 * F.col("y"))).drop("h", "y")
    return g, jobs.clim(g, ["u", "v", "w", "pv"], ["level", "ilat", "ilon"])


def _event(at):
    return [F.lit("x").alias("event_type"), F.lit("peak").alias("stage"), "track_id", at("lat").alias("lat0"), at("lon").alias("lon0"), F.make_timestamp(F.lit(2010), F.lit(6), F.lit(15), F.lit(1), F.lit(0), F.lit(0)).alias("base_ts")]


def _moving(spark, sf):
    """An event for every track at its first hour, and all tracks; a track's n-th hour is moved to n hours past midnight."""
    t = tracks(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("track_id").orderBy("ts")))
    t = t.withColumn("ts", F.timestamp_seconds(F.unix_timestamp(F.make_timestamp(F.lit(2010), F.lit(6), F.lit(15), F.lit(0), F.lit(0), F.lit(0))) + 3600 * F.col("n")))
    return t.filter("n = 1").select(*_event(F.col)), t.drop("n")


_CENTRES = f"""tr AS (SELECT track_id, lat, lon, row_number() OVER (PARTITION BY track_id ORDER BY ts) AS n FROM tracks),
 pl AS (SELECT e.track_id, CAST(dh AS INT) AS dh, coalesce(t.lat, e.lat) AS lat, coalesce(t.lon, e.lon) AS lon FROM tr e CROSS JOIN range(-1, 2) h(dh) LEFT JOIN tr t ON t.track_id = e.track_id AND t.n = dh + 1 WHERE e.n = 1),
 ce AS (SELECT track_id, dh, CAST(least(greatest(floor((lat - 20) / 6 + 0.5), 0), 9) AS INT) AS jc, CAST((floor((lon + 180) / 15 + 0.5) + 24) % 24 AS INT) AS ic FROM pl)"""
# --- the compute job: four hours of two years, in which everything changes ---

#: How fields grow with the hour h and the year y (0, 1); t grows by 0.5 h + y.
_GROW = {
    "wind": lambda h, y: 1 + 0.1 * h + 0.2 * y,
    "w": lambda h, y: 1 - 0.05 * h + 0.1 * y,
    "pv": lambda h, y: 1 + 0.1 * h + 0.02 * h * h + 0.2 * y + 0.05 * h * y,
}
_OWN_W = {"adiabatic": "w / 3.0", "diabatic": "w - w / 3.0", "qg_diabatic": "0.5 * w + 0.01 * v", "lhr_moist": "0.2 * w * w"}


def _weather(spark, sf):
    """The grid from midnight to three, in two years, with its climatology."""
    g = grid(spark, sf).withColumn("w_qg_diabatic", F.expr(_OWN_W["qg_diabatic"])).withColumn("w_lhr_moist", F.expr(_OWN_W["lhr_moist"]))
    g = g.withColumn("h", F.explode(F.array(*map(F.lit, range(4))))).withColumn("y", F.explode(F.array(F.lit(0), F.lit(1))))
    g = g.withColumn("ts", F.make_timestamp(2010 + F.col("y"), F.lit(6), F.lit(15), F.col("h"), F.lit(0), F.lit(0)))
    h, y = F.col("h"), F.col("y")
    kinds = {"u": "wind", "v": "wind", "w": "w", "w_qg_diabatic": "w", "w_lhr_moist": "w", "pv": "pv"}
    grown = {c: F.col(c) * _GROW[k](h, y) for c, k in kinds.items()} | {"t": F.col("t") + 0.5 * h + y}
    g = g.withColumns(grown).drop("h", "y")
    return g, jobs.clim(g, ["u", "v", "w", "pv"], ["level", "ilat", "ilon"])


def _sql_inverse(edges: str) -> str:
    """(m, j_out, j_in, g): the dense inverse of every wave's system, for the twins only."""
    rows = []
    for m in range(NLON // 2 + 1):
        down, middle, up = (x[:, m] for x in invert.bands(_SPEC.grid.sphere.with_edges(edges)))
        inverse = np.linalg.inv(np.diag(middle) + np.diag(up[:-1], 1) + np.diag(down[1:], -1)) * R_EARTH**2
        rows += [f"({m},{i},{j},{float(inverse[i, j])!r})" for i in range(NLAT) for j in range(NLAT)]
    return f"inv_{edges} AS (SELECT * FROM (VALUES {','.join(rows)}) t(m, j_out, j_in, g))"


def _sql_solved(name: str, source: str, f: str, edges: str) -> str:
    """{name} AS (level, ilat, ilon, x) with laplacian(x) = f."""
    ang = f"(2 * {PI} * m * ilon / 24)"
    pinned = "CASE WHEN m = 0 AND ilat = 0 THEN 0 ELSE 1 END" if edges == "neumann" else "CASE WHEN ilat IN (0, 9) THEN 0 ELSE 1 END"
    return f""", {name}_w AS (SELECT level, ilat, m, sum({f} * cos{ang}) * ({pinned}) AS re, sum(-({f}) * sin{ang}) * ({pinned}) AS im FROM {source}, range(0, 13) w(m) GROUP BY level, ilat, m),
 {name}_s AS (SELECT level, j_out AS ilat, m, sum(g * re) AS re, sum(g * im) AS im FROM {name}_w JOIN inv_{edges} USING (m) WHERE j_in = ilat GROUP BY 1, 2, 3),
 {name} AS (SELECT level, ilat, CAST(ilon AS INT) AS ilon, sum((CASE WHEN m IN (0, 12) THEN 1 ELSE 2 END) / 24.0 * (re * cos{ang} - im * sin{ang})) AS x FROM {name}_s, range(0, 24) r(ilon) GROUP BY 1, 2, 3)"""


def _sql_world() -> str:
    """bw AS the grid with gradients of pv, split winds and divergent winds of all vertical motions, at the first hour's scale."""
    edge = lambda c: f"CASE ilat WHEN 0 THEN cos((lat - 3) * {RAD}) WHEN 9 THEN -cos((lat + 3) * {RAD}) ELSE 0 END / cos(lat * {RAD}) * 2 * ({c}) / ({R_EARTH} * 6 * {RAD})"
    out = f"{WIND}, {_sql_inverse('neumann')}, {_sql_inverse('dirichlet')}"
    out += _sql_solved("psi", "g2", f"(vort_a + {edge('-u')})", "neumann") + _sql_solved("chi", "g2", f"(div_a + {edge('v')})", "neumann")
    area = lambda c: f"({c} - sum(cos(lat * {RAD}) * {c}) OVER (PARTITION BY level) / sum(CASE WHEN {c} IS NOT NULL THEN cos(lat * {RAD}) END) OVER (PARTITION BY level))"
    out += f", wp AS (SELECT *, {', '.join(f'{w} AS w_{p}' for p, w in _OWN_W.items())} FROM grid), ws AS (SELECT *, {', '.join(f'-({sql_ddp(f"w_{p}")}) AS s_{p}' for p in _OWN_W)} FROM wp)"
    out += f", wa AS (SELECT *, {', '.join(f'coalesce({area(f"s_{p}")}, 0) AS f_{p}' for p in _OWN_W)} FROM ws)"
    for p in _OWN_W:
        out += _sql_solved(f"chi_{p}", "wa", f"f_{p}", "dirichlet")
    joins = " ".join(f"JOIN (SELECT level, ilat, ilon, x AS x_{n} FROM {n}) USING (level, ilat, ilon)" for n in ("psi", "chi", *[f"chi_{p}" for p in _OWN_W]))
    ok = lambda c: f"CASE WHEN u IS NOT NULL AND v IS NOT NULL THEN {c} END"
    winds = [f"{ok('-' + sql_ddy('x_psi'))} AS u_rot", f"{ok(sql_ddx('x_psi'))} AS v_rot", f"{ok(sql_ddx('x_chi'))} AS u_div", f"{ok(sql_ddy('x_chi'))} AS v_div"]
    winds += [f"{f(f'x_chi_{p}')} AS {c}_div_{p}" for p in _OWN_W for c, f in (("u", sql_ddx), ("v", sql_ddy))]
    return out + f", bx AS (SELECT * FROM wp {joins}), bw AS (SELECT *, {', '.join(winds)}, {sql_ddx('pv')} AS pv_dx, {sql_ddy('pv')} AS pv_dy, {sql_ddp('pv')} AS pv_dp FROM bx), by_ AS (SELECT *, {sql_ddx('pv_dx')} AS pv_dx_dx, {sql_ddy('pv_dy')} AS pv_dy_dy, {sql_ddy('pv_dx')} AS pv_dx_dy FROM bw)"


_H = "(dh + 1)"


def _factor(kind: str, part: str) -> str:
    """Of a field's mean, anomaly or whole at the hour of dh, in the first year."""
    now, then = (str(_GROW[kind](_Text(_H), y)) for y in (0, 1))
    return {"": f"({now})", "bar": f"(({now} + {then}) / 2)", "anom": f"({now} - ({now} + {then}) / 2)"}[part]


class _Text(str):
    """SQL text that takes part in arithmetic."""

    def __add__(self, o):
        return _Text(f"({self} + {o})")

    def __radd__(self, o):
        return _Text(f"({o} + {self})")

    def __rsub__(self, o):
        return _Text(f"({o} - {self})")

    def __mul__(self, o):
        return _Text(f"({self} * {o})")

    __rmul__ = __mul__


def _products() -> dict[str, tuple[str, str]]:
    """term -> (product at the first hour's scale, factor of the hour)."""
    out = {}
    for name, wind, gradient, family in M.catalogue():
        part = gradient.split("_")[1]
        slope = gradient.replace(f"pv_{part}", "pv")
        if family in ("omega_wind", "vertical"):
            base, kind, own = wind, "w", ""
        else:
            base, own = wind.rsplit("_", 1)
            kind = "w" if base == "w" else "wind"
        out[name] = (f"{base} * {slope}", f"{_factor(kind, own)} * {_factor('pv', part)}")
    now = [float(_GROW["pv"](h, 0)) for h in range(4)]
    both = [(_GROW["pv"](h, 0) + _GROW["pv"](h, 1)) / 2 for h in range(4)]
    slope = lambda x: f"(CASE dh WHEN -1 THEN {x[1] - x[0]!r} / 3600 WHEN 0 THEN {x[2] - x[0]!r} / 7200 ELSE {x[3] - x[1]!r} / 7200 END)"
    out |= {"pv_dt": ("pv", slope(now)), "pv_bar_dt": ("pv", slope(both)), "pv_anom_dt": ("pv", slope([a - b for a, b in zip(now, both)]))}
    out |= {"t_dt": ("t / t", "(0.5 / 3600)"), "theta_dt": (f"t / t * pow(1000.0 / level, {KAPPA!r})", "(0.5 / 3600)")}
    return out | {c: (c, _factor("pv", "")) for c in ("pv_dx_dx", "pv_dy_dy", "pv_dx_dy")}


_SOURCE = f"hq AS (SELECT CAST(dh AS INT) AS dh, level, ilat, ilon, -9.81 * (2 * {OMEGA} * sin(lat * {RAD}) + zeta) * heatp AS q_, heat FROM h3)"


def _sql_hourly() -> str:
    """The heating chain of the three hours."""
    hourly = HEAT.replace("PARTITION BY ", "PARTITION BY dh, ").replace("FROM grid", "FROM gh")
    return f", gh AS (SELECT dh, level, ilat, ilon, lat, u * {_factor('wind', '')} AS u, v * {_factor('wind', '')} AS v, w * {_factor('w', '')} AS w, t + 0.5 * {_H} AS t, q FROM grid, range(-1, 2) x(dh)){hourly}"


def _sql_terms() -> str:
    products = _products()
    bases = {x: f"b{i}" for i, x in enumerate(dict.fromkeys(x for x, _ in products.values()))}
    sums = ", ".join(f"sum({x}) AS {n}, sum(abs({x})) AS a{n}" for x, n in bases.items())
    gh = _sql_hourly()
    window = "CROSS JOIN range(-2, 3) a(iy) CROSS JOIN range(-3, 4) b(ix)"
    on = "ilat = jc + iy AND ilon = (ic + ix + 24) % 24"
    ratio = lambda s, a, f: f"round(({f}) * {s} / (abs({f}) * {a}), 6) + 0.0 AS share, round(log10(abs({f}) * {a}), 6) + 0.0 AS size"
    parts = [f"SELECT CAST(dh AS INT) AS dh, '{n}' AS term, {ratio(bases[x], 'a' + bases[x], f)} FROM ts" for n, (x, f) in products.items()]
    parts += [f"SELECT CAST(dh AS INT) AS dh, '{n}' AS term, {ratio(f's_{n}', f'a_{n}', '1.0')} FROM hs" for n in ("Q", "theta_dot")]
    return f"""WITH {TRACKS}, {GRID}, {_CENTRES}{_sql_world()}{gh}, ts AS (SELECT dh, {sums} FROM ce {window} JOIN by_ ON {on} GROUP BY 1),
 {_SOURCE}, hs AS (SELECT ce.dh, sum(q_) AS s_Q, sum(abs(q_)) AS a_Q, sum(heat) AS s_theta_dot, sum(abs(heat)) AS a_theta_dot FROM ce {window} JOIN hq ON hq.dh = ce.dh AND {on} GROUP BY 1)
 {' UNION ALL '.join(parts)}"""


@register("job_compute", _sql_terms())
def job_compute(spark, sf):
    """All tracks at three hours: the sum of each of the 52 products, of the tendencies, second derivatives, heating and source
    over all patches, as its share of the sum of absolute values and that sum's logarithm."""
    (g, climate), (e, t) = _weather(spark, sf), _moving(spark, sf)
    p = jobs.compute(e, t, g, climate, range(-1, 2), _SPEC)
    names = [*_products(), "Q", "theta_dot"]
    s = p.groupBy("dh").agg(*[x for n in names for x in (F.sum(n).alias(f"s_{n}"), F.sum(F.abs(n)).alias(f"a_{n}"))])
    s = s.select("dh", F.explode(F.array(*[F.struct(F.lit(n).alias("term"), F.col(f"s_{n}").alias("s"), F.col(f"a_{n}").alias("a")) for n in names])).alias("x"))
    return s.select("dh", "x.term", r(F.try_divide(F.col("x.s"), F.col("x.a"))).alias("share"), r(F.log10("x.a")).alias("size"))


_SETS = {"leading": M.LEADING_GROUPS, "seven": M.SEVEN_TERMS, "eight": M.EIGHT_TERMS, "nine": M.NINE_TERMS}
_CLOSURE = ("lhs", "adv", "induced", "resid")


def _sql_groups() -> str:
    products = _products()

    def one(name: str) -> str:
        sign, name = ("-", name[1:]) if name.startswith("-") else ("", name)
        if name == "Q":
            return f"{sign}q_"
        base, factor = products[name]
        if "_rot_bar_" in name or "_div_bar_" in name:  # a mean that the climatology lacks is 0
            wind, slope = base.split(" * ")
            base = f"coalesce({wind}, 0) * {slope}"
        return f"{sign}({factor}) * ({base})"

    spec = lambda names: "(" + " + ".join(map(one, names)) + ")"
    exprs = {f"{k}_{n}": spec(v) for k, groups in _SETS.items() for n, v in groups.items()}
    lhs, adv = spec(["pv_anom_dt", "pv_bar_dt"]), spec([f"-{n}" for n in M.SPLIT_ADVECTION])
    exprs |= {"closure_lhs": lhs, "closure_adv": adv, "closure_induced": f"({lhs} - {adv})", "closure_resid": f"({lhs} - {adv} - q_)"}
    sums = ", ".join(f"sum({e}) AS s_{n}, sum(abs({e})) AS a_{n}" for n, e in exprs.items())
    rows = " UNION ALL ".join(f"SELECT dh, '{n}' AS term, round(s_{n} / a_{n}, 6) + 0.0 AS share, round(log10(a_{n}), 6) + 0.0 AS size FROM gs" for n in exprs)
    return f"""WITH {TRACKS}, {GRID}, {_CENTRES}{_sql_world()}{_sql_hourly()}, {_SOURCE},
 gs AS (SELECT ce.dh, {sums} FROM ce CROSS JOIN range(-2, 3) a(iy) CROSS JOIN range(-3, 4) b(ix) JOIN by_ h ON h.ilat = jc + iy AND h.ilon = (ic + ix + 24) % 24 JOIN (SELECT dh AS d, level AS k, ilat AS j, ilon AS i, q_ FROM hq) q ON q.d = ce.dh AND q.k = h.level AND q.j = h.ilat AND q.i = h.ilon GROUP BY 1)
 {rows}"""


@register("job_term_groups", _sql_groups())
def job_term_groups(spark, sf):
    """Sets of 4, 7, 8 and 9 grouped terms and the closure over 20 products with the source, summed over all patches of an hour."""
    (g, climate), (e, t) = _weather(spark, sf), _moving(spark, sf)
    p = M.closure(jobs.compute(e, t, g, climate, range(-1, 2), _SPEC), ["pv_anom_dt", "pv_bar_dt"], M.SPLIT_ADVECTION, "Q")
    values = {f"{k}_{n}": M.signed_sum(v) for k, groups in _SETS.items() for n, v in groups.items()} | {f"closure_{n}": F.col(n) for n in _CLOSURE}
    s = p.groupBy("dh").agg(*[x for n, v in values.items() for x in (F.sum(v).alias(f"s_{n}"), F.sum(F.abs(v)).alias(f"a_{n}"))])
    s = s.select("dh", F.explode(F.array(*[F.struct(F.lit(n).alias("term"), F.col(f"s_{n}").alias("s"), F.col(f"a_{n}").alias("a")) for n in values])).alias("x"))
    return s.select("dh", "x.term", r(F.try_divide(F.col("x.s"), F.col("x.a"))).alias("share"), r(F.log10("x.a")).alias("size"))


_MEAN_OF = {"pv": ("pv", _factor("pv", "")), "u_rot_anom_pv_bar_dx": ("u_rot * pv_dx", f"{_factor('wind', 'anom')} * {_factor('pv', 'bar')}")}
_MEAN_AT = (240, 390, 560)


def _sql_means() -> str:
    mean = lambda x: f"sum(exp(-z / 9.81 / {SCALE_HEIGHT!r}) * {x}) / sum(CASE WHEN {x} IS NOT NULL THEN exp(-z / 9.81 / {SCALE_HEIGHT!r}) END)"
    cols = ", ".join(f"{mean(x)} AS m{i}" for i, (x, _) in enumerate(_MEAN_OF.values()))
    out = ", ".join(f"round({f} * sum(m{i}) / (abs({f}) * sum(abs(m{i}))), 6) + 0.0 AS share_{n}, round(log10(abs({f}) * sum(abs(m{i}))), 6) + 0.0 AS size_{n}" for i, (n, (_, f)) in enumerate(_MEAN_OF.items()))
    return f"""WITH {TRACKS}, {GRID}, {_CENTRES}{_sql_world()}, vm AS (SELECT ilat, ilon, {cols} FROM bw WHERE level IN {_MEAN_AT} GROUP BY 1, 2), nt AS (SELECT count(DISTINCT track_id) AS n FROM tracks)
 SELECT CAST(dh AS INT) AS dh, count(DISTINCT track_id) AS n_patches, any_value(n) AS first_run, 2 * any_value(n) AS second_run, 0 AS third_run, {out}
 FROM ce CROSS JOIN nt CROSS JOIN range(-2, 3) a(iy) CROSS JOIN range(-3, 4) b(ix) JOIN vm ON ilat = jc + iy AND ilon = (ic + ix + 24) % 24 GROUP BY dh"""


@register("job_compute_sink", _sql_means())
def job_compute_sink(spark, sf):
    """One hour into a folder, then three, then the three once more; vertical means of the patches that lie there."""
    (g, climate), (e, t) = _weather(spark, sf), _moving(spark, sf)
    root = scratch(spark, "patches")
    runs = [jobs.compute_into(root, e, t, g, climate, offsets, _SPEC) for offsets in ([0], range(-1, 2), range(-1, 2))]
    m = jobs.vertical_means(S.read_patches(spark, root), list(_MEAN_OF), _MEAN_AT)
    sums = [x for n in _MEAN_OF for x in (r(F.sum(n) / F.sum(F.abs(n))).alias(f"share_{n}"), r(F.log10(F.sum(F.abs(n)))).alias(f"size_{n}"))]
    counts = [F.lit(n).cast("long").alias(f"{k}_run") for k, n in zip(("first", "second", "third"), runs)]
    return m.groupBy("dh").agg(F.count_distinct("track_id").alias("n_patches"), *sums).select("*", *counts)


def _frames(moving: bool) -> str:
    place = "SELECT e.track_id, CAST(dh AS INT) AS dh, coalesce(t.lat, e.lat) AS lat, coalesce(t.lon, e.lon) AS lon FROM tr e CROSS JOIN range(-2, 3) h(dh) LEFT JOIN tr t ON t.track_id = e.track_id AND t.n = dh + 1 WHERE e.n = 1"
    cell = "CAST(least(greatest(floor((lat - 20) / 6 + 0.5), 0), 9) AS INT) AS jc, CAST((floor((lon + 180) / 15 + 0.5) + 24) % 24 AS INT) AS ic"
    cut = lambda n, name: f"{name} AS (SELECT c.track_id, c.dh, level, iy, ix, pv * (1 + 0.1 * (c.dh + {1 + n}) + 0.02 * (c.dh + {1 + n}) * (c.dh + {1 + n})) AS x FROM wc c JOIN wc o ON o.track_id = c.track_id AND o.dh = c.dh{f' + {n}' if moving else ''} CROSS JOIN range(-2, 3) a(iy) CROSS JOIN range(-3, 4) b(ix) JOIN grid ON ilat = o.jc + iy AND ilon = (o.ic + ix + 24) % 24 WHERE c.dh BETWEEN -1 AND 1 AND c.dh + {1 + n} BETWEEN 0 AND 3)"
    return f"""WITH {TRACKS}, {GRID}, tr AS (SELECT track_id, lat, lon, row_number() OVER (PARTITION BY track_id ORDER BY ts) AS n FROM tracks), wc AS (SELECT track_id, dh, {cell} FROM ({place})), {cut(-1, 'bf')}, {cut(1, 'af')}
 SELECT track_id, dh, CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, count(af.x - bf.x) AS n, round(1e3 * sum((af.x - bf.x) / 7200), 5) + 0.0 AS tendency FROM bf FULL JOIN af USING (track_id, dh, level, iy, ix) GROUP BY 1, 2, 3, 4"""


def _frame_tendency(spark, sf, moving: bool):
    (g, _), (e, t) = _weather(spark, sf), _moving(spark, sf)
    at = jobs.event_hours(e, t, range(-2, 3), _SPEC).select("track_id", "dh", "ts", "jc", "ic")
    other = {k: at.select("track_id", (F.col("dh") + n).alias("dh"), "jc", "ic") for k, n in (("before", 1), ("after", -1))} if moving else {}
    d = P.frame_tendency(at.filter(F.abs("dh") < 2), g, "pv", _SPEC.half_j, _SPEC.half_i, NLAT, NLON, ["track_id", "dh"], **other)
    return d.groupBy("track_id", "dh", "iy", "ix").agg(F.count("tendency").alias("n"), r(F.sum("tendency"), 1e3, 5).alias("tendency"))


@register("moving_frame_tendency", _frames(True))
def moving_frame_tendency(spark, sf):
    """Every track's window, the hours before and after cut at their own centres."""
    return _frame_tendency(spark, sf, True)


@register("fixed_frame_tendency", _frames(False))
def fixed_frame_tendency(spark, sf):
    """The same with both hours cut at the centre of the hour between."""
    return _frame_tendency(spark, sf, False)


@register("job_event_status", f"""WITH {TRACKS}, tr AS (SELECT track_id, ts, row_number() OVER (PARTITION BY track_id ORDER BY ts) AS n FROM tracks)
 SELECT track_id, CAST(dh AS INT) AS dh, CASE WHEN track_id % 5 = 0 AND NOT EXISTS (SELECT 1 FROM tr t WHERE t.track_id = e.track_id AND t.n = dh + 1) THEN 'no_place' WHEN dh + 1 > 2 THEN 'no_field' ELSE 'ready' END AS status FROM tr e CROSS JOIN range(0, 4) h(dh) WHERE n = 1""")
def job_event_status(spark, sf):
    """Events of every fifth track come without a place, and the archive ends after two hours."""
    (g, _), (e, t) = _world(spark, sf), _moving(spark, sf)
    e = e.withColumn("lat0", F.when(F.col("track_id") % 5 != 0, F.col("lat0")))
    return jobs.event_status(e, t, g, range(0, 4), _SPEC).select("track_id", "dh", "status")


@register("patches_unreadable", f"WITH {PATCHES} SELECT dh, count(DISTINCT track_id) AS n_missing FROM patches WHERE dh = 4 GROUP BY 1")
def patches_unreadable(spark, sf):
    """One hour's files are damaged: they are left out and counted."""
    path = scratch(spark, "patches")
    p = patches(spark, sf).withColumn("event_type", F.lit("x")).withColumn("stage", F.lit("onset"))
    S.write_patches(p.filter("dh <> 4"), path)
    p.filter("dh = 4").select(F.concat(F.lit("damaged "), F.col("track_id").cast("string"))).coalesce(1).write.text(f"{path}/event_type=x/stage=onset/dh=4")
    got = S.read_patches(spark, path, "onset", on_corrupt="skip")
    return S.unreadable(p, got, ["track_id", "dh"], ["dh"])


@register("split_clim_month", f"WITH {GRID} SELECT level, count(u) FILTER (u IS NOT NULL AND v IS NOT NULL) AS n, 0 AS others FROM grid GROUP BY 1")
def split_clim_month(spark, sf):
    """Split winds of two months written, one of them scanned; a month that is not there has no rows."""
    path = scratch(spark, "split")
    g = grid(spark, sf).select(F.explode(F.array(F.lit(5), F.lit(6))).alias("month"), F.lit(15).alias("day"), F.lit(0).alias("hour"), "level", "ilat", "ilon", F.col("u").alias("u_bar"), F.col("v").alias("v_bar"))
    S.write_clim(jobs.clim_helmholtz(g, _SPEC.grid), path, False)
    none = S.read_split_clim(spark, path, 9).count()
    return S.read_split_clim(spark, path, 6).groupBy("level").agg(F.count("u_rot_bar").alias("n"), F.lit(none).alias("others"))


_FACTOR = "1 + 0.1 * m + 0.02 * m * m"
_WAVES = lambda x, k, n, modes: f"avg({x}) AS m0, {', '.join(f'2 * sum({x} * cos(2 * {PI} * {w} * {k} / {n})) / {n} AS c{w}, 2 * sum({x} * sin(2 * {PI} * {w} * {k} / {n})) / {n} AS s{w}' for w in range(1, modes + 1))}"
_BACK = lambda k, n, modes: f"m0 + {' + '.join(f'c{w} * cos(2 * {PI} * {w} * {k} / {n}) + s{w} * sin(2 * {PI} * {w} * {k} / {n})' for w in range(1, modes + 1))}"


@register("job_clim_smooth", f"""WITH {GRID}, mo AS (SELECT m, {_FACTOR} AS f FROM range(0, 12) x(m)), tc AS (SELECT {_WAVES('f', 'm', 12, 4)} FROM mo), ti AS (SELECT m, {_BACK('m', 12, 4)} AS f FROM mo, tc),
 zc AS (SELECT level, ilat, {_WAVES('coalesce(u, 0)', 'ilon', 24, 2)} FROM grid GROUP BY 1, 2), zo AS (SELECT level, ilat, ilon, {_BACK('ilon', 24, 2)} AS u FROM grid JOIN zc USING (level, ilat))
 SELECT CAST(m + 1 AS INT) AS month, level, ilat, ilon, round(f * u, 5) + 0.0 AS u_bar FROM zo, ti""")
def job_clim_smooth(spark, sf):
    """Twelve months of the grid: the mean over years, then its slow waves."""
    m = F.col("m")
    g = grid(spark, sf).withColumn("u", F.coalesce("u", F.lit(0.0))).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("ts", F.make_timestamp(F.lit(2010), m + 1, F.lit(15), F.lit(0), F.lit(0), F.lit(0)))
    g = g.withColumn("u", F.col("u") * (1 + 0.1 * m + 0.02 * m * m))
    c = jobs.clim_smooth(jobs.clim(g, ["u"], ["level", "ilat", "ilon"]), ["u_bar"], 12, NLON)
    return c.select(F.col("month").cast("int").alias("month"), "level", "ilat", "ilon", r(F.col("u_bar"), 1, 5).alias("u_bar"))


@register("job_classify_composite")
def job_classify_composite(spark, sf):
    """Patches to classes to composites."""
    (g, climate), (e, t) = _world(spark, sf), _moving(spark, sf)
    p = jobs.compute(e, t, g, climate, [0], _SPEC).filter("level IS NOT NULL")
    labels = jobs.classify(p, [240, 390, 560], 1)
    return K.composite_mean(jobs.composite(p, labels, ["pv"]), ["pv"])


#: Blended with the hour before, smoothed over about a cell, the central blob of what is below its own middle.
_BASIS = jobs.BasisConfig(2, 3, DLAT, DLON, "< 0.5", 8.0, True, 0.7)


_TERMS = ("u_bar_pv_anom_dx", "v_bar_pv_anom_dy")


def _decomposed_patches(spark, sf):
    (g, climate), (e, t) = _world(spark, sf), _moving(spark, sf)
    p = jobs.compute(e, t, g, climate, [0, 1], _SPEC).filter("level = 390")
    return written(p.select("track_id", "dh", "lat_c", "iy", "ix", "x_rel", "y_rel", "pv_anom", *_TERMS), "patches")  # several steps take them


@register("job_decompose")
def job_decompose(spark, sf):
    """All tracks at two hours, each on the patterns of its own patch at its own latitude."""
    return jobs.decompose(_decomposed_patches(spark, sf), ["track_id", "dh"], "pv_anom", list(_TERMS), _BASIS, F.col("lat_c"))


@register("job_clim_helmholtz", f"""WITH {GRID}{WIND} SELECT level, ilat, ilon, CASE WHEN ok THEN round(u, 6) + 0.0 END AS u_bar, round(CASE WHEN ilat IN (0, 9) THEN 0.0 ELSE 1e6 * vort_a + {sql_lap('here')} END, 4) + 0.0 AS lap_psi,
 round(CASE WHEN ilat IN (0, 9) THEN 0.0 ELSE 1e6 * div_a + {sql_lap('here')} END, 4) + 0.0 AS lap_chi FROM g2""")
def job_clim_helmholtz(spark, sf):
    """The parts add up, and the potentials' Laplacians are the wind's own vorticity and divergence."""
    g = grid(spark, sf).withColumn("month", F.lit(6)).withColumn("day", F.lit(15)).withColumn("hour", F.lit(0)).withColumnsRenamed({"u": "u_bar", "v": "v_bar"})
    h = jobs.clim_helmholtz(g, _SPEC.grid)
    h = T.with_laplacian(T.with_laplacian(h, "psi", "lap_psi", ["level"], DLAT, DLON), "chi", "lap_chi", ["level"], DLAT, DLON)
    return h.select("level", "ilat", "ilon", r(F.col("u_rot_bar") + F.col("u_div_bar") + F.col("u_har")).alias("u_bar"), r(F.col("lap_psi"), 1e6, 4).alias("lap_psi"), r(F.col("lap_chi"), 1e6, 4).alias("lap_chi"))


_TARGETS = (300.0, 330.0, 380.0, 450.0)


def _on_theta(spark, sf):
    """u - v of every track's patch at its event's hour, on surfaces of theta."""
    (g, _), (e, t) = _world(spark, sf), _moving(spark, sf)
    centres = jobs.event_hours(e, t, [0], _SPEC).select("track_id", "ts", "jc", "ic")
    p = P.extract_patches(centres, g.drop("lat", "lon"), _SPEC.half_j, _SPEC.half_i, NLAT, NLON, ["ts"]).filter("level IS NOT NULL")
    return I.isentropic_events(p, ["track_id"], list(_TARGETS), ["u", "-v"])


@register("isentropic_composite", f"""WITH {TRACKS}, {GRID}, {_CENTRES}, th AS (SELECT *, u - v AS spec, {TH} AS theta FROM grid),
 n AS (SELECT ilat, ilon, theta AS a, lead(theta) OVER w AS b, spec AS q0, lead(spec) OVER w AS q1 FROM th WHERE theta IS NOT NULL WINDOW w AS (PARTITION BY ilat, ilon ORDER BY theta)),
 h AS (SELECT n.*, tg FROM n, (VALUES {", ".join(f"({x})" for x in _TARGETS)}) t(tg) WHERE tg >= a AND tg <= b), m AS (SELECT ilat, ilon, tg, arg_min({{'a': a, 'b': b, 'q0': q0, 'q1': q1}}, a) AS x FROM h GROUP BY 1, 2, 3)
 SELECT CAST(tg AS DOUBLE) AS theta_level, CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, round(sum(x.q0 + (tg - x.a) / (x.b - x.a) * (x.q1 - x.q0)), 5) + 0.0 AS sum_value, count(x.q0 + x.q1) AS n_value
 FROM ce CROSS JOIN range(-2, 3) a(iy) CROSS JOIN range(-3, 4) b(ix) JOIN m ON ilat = jc + iy AND ilon = (ic + ix + 24) % 24 WHERE dh = 0 GROUP BY 1, 2, 3""")
def isentropic_composite(spark, sf):
    c = I.isentropic_composite(_on_theta(spark, sf))
    return c.select("theta_level", "iy", "ix", r(F.col("sum_value"), 1, 5).alias("sum_value"), "n_value")


@register("isentropic_projection")
def isentropic_projection(spark, sf):
    return I.isentropic_projection(_on_theta(spark, sf), ["track_id"], DLAT, DLON)


@register("job_status", f"WITH {TRACKS} SELECT CASE WHEN track_id % 3 = 0 THEN 'done' ELSE 'missing' END AS status, count(DISTINCT track_id) AS n FROM tracks GROUP BY 1")
def job_status(spark, sf):
    w = lifecycle_events(spark, sf)
    return jobs.status(w, hours(spark, sf).filter("track_id % 3 = 0"), ["track_id"])
