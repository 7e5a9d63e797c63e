"""Queries: forcing terms, wind splitting and inversion on the gridded view."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldspark.functions import columns as C
from fieldspark.functions.constants import CP_DRY, KAPPA, OMEGA, R_DRY, R_EARTH
from fieldspark.operators import forcing, invert
from fieldspark.operators import stencil as S
from fieldspark.plans.fields import HEAT, LV, PI, RAD, _cells, _sql, heating, sql_ddp, sql_ddx, sql_ddy, sql_dphi, sql_lap, sql_ring
from fieldspark.plans.proxies import DLAT, DLON, GRID, LAT0, NLAT, NLON, grid, r
from fieldspark.plans.registry import register

_SPHERE = invert.Sphere(LAT0, DLAT, NLAT, NLON)

_RAMP = f"(greatest(0.0, least(1.0, (lat - 15) / 10)) * greatest(0.0, least(1.0, (85 - lat) / 5)))"
_F0 = f"(2 * {OMEGA} * sin(45 * {RAD}))"


def _qg(thermal: bool) -> str:
    tl = f"{_F0} * level * 100.0 / {R_DRY} * (-vp) * {R_EARTH} * cos(lat * {RAD})" if thermal else f"{sql_ring('t')} / (2 * 15 * {RAD})"
    tf = f"{_F0} * level * 100.0 / {R_DRY} * up * {R_EARTH}" if thermal else sql_dphi("t")
    return f""", q0 AS (SELECT *, u * {_RAMP} AS ut, v * {_RAMP} AS vt, cos(lat * {RAD}) AS cs, tan(lat * {RAD}) AS tn, {_RAMP} AS ramp FROM grid),
 q1 AS (SELECT *, {sql_ddp('ut')} AS up, {sql_ddp('vt')} AS vp, {sql_ring('ut')} / (2 * 15 * {RAD}) AS ul, {sql_ring('vt')} / (2 * 15 * {RAD}) AS vl, {sql_dphi('ut')} AS uf, {sql_dphi('vt')} AS vf FROM q0),
 q2 AS (SELECT *, {tl} AS tl, {tf} AS tf FROM q1),
 q3 AS (SELECT *, ramp * (tf * (vl / cs + ut * tn) - tl / cs * vf) / ({R_EARTH} * {R_EARTH}) AS qx, ramp * (tf * (-ul / cs + vt * tn) + tl / cs * uf) / ({R_EARTH} * {R_EARTH}) * cs AS qyc FROM q2)"""


def _qg_cols() -> dict:
    div = f"({sql_ring('qx')} / (2 * 15 * {RAD}) + {sql_dphi('qyc')}) / ({R_EARTH} * cs)"
    return dict(a=(f"2 * {R_DRY} / (level * 100.0) * ({div})", 1e18), b=(f"2 * {OMEGA} * sin(lat * {RAD}) * 2 * {OMEGA} * cs / {R_EARTH} * vp * ramp", 1e18))


@register("qg_forcing_thermal_wind", _sql("q3", _qg(True), **_qg_cols()))
def qg_forcing_thermal_wind(spark, sf):
    g = grid(spark, sf).withColumn("ug", F.col("u")).withColumn("vg", F.col("v"))
    g = forcing.qg_forcing(g, [], DLAT, DLON, 45.0)
    return _cells(g, a=(F.col("forcing_a"), 1e18), b=(F.col("forcing_b"), 1e18))


@register("qg_forcing_direct", _sql("q3", _qg(False), **_qg_cols()))
def qg_forcing_direct(spark, sf):
    g = grid(spark, sf).withColumn("ug", F.col("u")).withColumn("vg", F.col("v"))
    g = forcing.qg_forcing(g, [], DLAT, DLON, 45.0, thermal_wind=False)
    return _cells(g, a=(F.col("forcing_a"), 1e18), b=(F.col("forcing_b"), 1e18))


_DXF = f"greatest(15 * {RAD} * {R_EARTH} * cos(lat * {RAD}), 0.1 * 6 * {RAD} * {R_EARTH})"


@register("budget_heating_forcing", _sql("c1", f""", c0 AS (SELECT *, {CP_DRY} * (q + u * {sql_ring('t')} / (2 * {_DXF}) + v * {sql_ddy('t')}) - (1e-6 * pv) * (level * 100.0 / {R_DRY}) * {CP_DRY} * w AS j FROM grid), c1 AS (SELECT *, {sql_lap('j')} AS lj FROM c0)""", c=(f"-({KAPPA!r} / (level * 100.0)) * lj", 1e15)))
def budget_heating_forcing(spark, sf):
    g = grid(spark, sf).withColumn("t_dt", F.col("q")).withColumn("sigma", 1e-6 * F.col("pv"))
    return _cells(forcing.budget_heating(g, [], DLAT, DLON), c=(F.col("forcing_c"), 1e15))


@register("latent_heating_forcing", _sql("c1", HEAT + f", c0 AS (SELECT *, {CP_DRY} * coalesce(heat, 0.0) * t / greatest(th, 1.0) AS j FROM h2), c1 AS (SELECT *, {sql_lap('j')} AS lj FROM c0)", c=(f"-({KAPPA!r} / (level * 100.0)) * lj", 1e15)))
def latent_heating_forcing(spark, sf):
    g = heating(grid(spark, sf)).withColumn("theta_dot", F.col("heat")).withColumn("theta", F.col("th"))
    return _cells(forcing.latent_heating_forcing(g, [], DLAT, DLON), c=(F.col("forcing_l"), 1e15))


@register("qg_residual", f"""WITH {GRID}, r0 AS (SELECT *, 1e-6 * pv * w AS so FROM grid), r1 AS (SELECT *, {sql_lap('so')} AS lo, {sql_ddp('w')} AS op FROM r0), r2 AS (SELECT *, {sql_ddp('op')} AS opp FROM r1)
 SELECT level, round(1e9 * sum(abs(1e-9 * z - lo - {_F0} * {_F0} * opp)), 6) + 0.0 AS l1 FROM r2 GROUP BY 1""")
def qg_residual(spark, sf):
    g = grid(spark, sf).withColumn("sigma", 1e-6 * F.col("pv")).withColumn("forcing", 1e-9 * F.col("z"))
    g = forcing.qg_residual(g, "w", "forcing", [], DLAT, DLON, 45.0)
    return g.groupBy("level").agg(r(F.sum(F.abs("residual")), 1e9).alias("l1"))


@register("remove_area_mean", _sql("grid", u=(f"u - sum(cos(lat * {RAD}) * u) OVER (PARTITION BY level) / sum(CASE WHEN u IS NOT NULL THEN cos(lat * {RAD}) END) OVER (PARTITION BY level)", 1)))
def remove_area_mean(spark, sf):
    return _cells(invert.remove_area_mean(grid(spark, sf), "u", LV), u=(F.col("u"), 1))


@register("zonal_waves", f"""WITH {GRID} SELECT level, ilat, CAST(m AS INT) AS m, round(sum(u * cos(2 * {PI} * m * ilon / 24)), 6) + 0.0 AS re, round(sum(-u * sin(2 * {PI} * m * ilon / 24)), 6) + 0.0 AS im
 FROM grid, range(0, 13) w(m) GROUP BY 1, 2, 3""")
def zonal_waves(spark, sf):
    d = invert.zonal_dft(grid(spark, sf), "u", LV, NLON)
    return d.select("level", "ilat", "m", r(F.col("re")).alias("re"), r(F.col("im")).alias("im"))


@register("zonal_waves_round_trip", _sql("grid", u=("coalesce(u, 0)", 1)))
def zonal_waves_round_trip(spark, sf):
    d = invert.zonal_idft(invert.zonal_dft(grid(spark, sf), "u", LV, NLON), "u", LV, NLON)
    return _cells(d, u=(F.col("u"), 1))


@register("poisson_fixed_edges", f"""WITH {GRID} SELECT level, ilat, ilon, round(CASE WHEN ilat IN (0, 9) THEN 0.0 ELSE coalesce(u, 0) END, 6) + 0.0 AS back FROM grid""")
def poisson_fixed_edges(spark, sf):
    """Laplacian of the inverse gives the source again at inner rows."""
    g = grid(spark, sf)
    x = invert.poisson(g, "u", "x", LV, _SPHERE)
    return S.with_laplacian(x, "x", "back", LV, DLAT, DLON).select("level", "ilat", "ilon", r(F.col("back")).alias("back"))


WIND = f""", g0 AS (SELECT level, ilat, ilon, lat, coalesce(u, 0) AS u, coalesce(v, 0) AS v, u IS NOT NULL AND v IS NOT NULL AS ok FROM grid),
 g1 AS (SELECT *, {sql_ddx('v')} - {sql_ddy('u')} + u * tan(lat * {RAD}) / {R_EARTH} AS vort, {sql_ddx('u')} + {sql_ddy('v')} - v * tan(lat * {RAD}) / {R_EARTH} AS div FROM g0),
 g2 AS (SELECT *, CASE WHEN ok THEN 0.0 END AS here, {', '.join(f"{c} - sum(cos(lat * {RAD}) * {c}) OVER (PARTITION BY level) / sum(cos(lat * {RAD})) OVER (PARTITION BY level) AS {c}_a" for c in ('vort', 'div'))} FROM g1)"""


def _split(spark, sf):
    return invert.helmholtz(grid(spark, sf), LV, _SPHERE)


@register("helmholtz_split", f"""WITH {GRID}{WIND}
 SELECT level, ilat, ilon, CASE WHEN ok THEN round(u, 6) + 0.0 END AS u, CASE WHEN ok THEN round(v, 6) + 0.0 END AS v, CASE WHEN ok THEN round(1e6 * vort, 4) + 0.0 END AS vort FROM g2""")
def helmholtz_split(spark, sf):
    """Rotational, divergent and harmonic parts add up to the wind."""
    h = _split(spark, sf)
    return h.select(
        "level", "ilat", "ilon", r(F.col("u_rot") + F.col("u_div") + F.col("u_har")).alias("u"),
        r(F.col("v_rot") + F.col("v_div") + F.col("v_har")).alias("v"), r(F.col("vort"), 1e6, 4).alias("vort"),
    )


@register("helmholtz_fields", f"""WITH {GRID}{WIND}
 SELECT level, ilat, ilon, round(CASE WHEN ilat IN (0, 9) THEN 0.0 ELSE 1e6 * vort_a + {sql_lap('here')} END, 4) + 0.0 AS lap_psi, round(CASE WHEN ilat IN (0, 9) THEN 0.0 ELSE 1e6 * div_a + {sql_lap('here')} END, 4) + 0.0 AS lap_chi,
 0.0 AS south_psi, 0.0 AS south_chi, true AS winds_fit FROM g2""")
def helmholtz_fields(spark, sf):
    """What pins the potentials: their Laplacians at inner rows are the wind's vorticity and divergence less the area means,
    their means over the first row are 0, and the winds of the parts are the potentials' gradients."""
    h = _split(spark, sf)
    h = S.with_laplacian(S.with_laplacian(h, "psi", "lap_psi", LV, DLAT, DLON), "chi", "lap_chi", LV, DLAT, DLON)
    h = invert.gradient(invert.gradient(h, "psi", ("_px", "_py"), LV, DLAT, DLON), "chi", ("_cx", "_cy"), LV, DLAT, DLON)
    ring = Window.partitionBy("level")
    first = lambda c: F.when(F.col("ilat") == 0, F.col(c))
    south = lambda c: F.when(F.count(first(c)).over(ring) == NLON, r(F.avg(first(c)).over(ring) / F.max(F.abs(c)).over(ring))).otherwise(0.0).alias(f"south_{c}")
    near = lambda a, b: F.coalesce(F.abs(F.col(a) - b) < 1e-9, F.lit(True))
    fit = near("u_rot", -F.col("_py")) & near("v_rot", F.col("_px")) & near("u_div", F.col("_cx")) & near("v_div", F.col("_cy"))
    return h.select("level", "ilat", "ilon", r(F.col("lap_psi"), 1e6, 4).alias("lap_psi"), r(F.col("lap_chi"), 1e6, 4).alias("lap_chi"), south("psi"), south("chi"), fit.alias("winds_fit"))


_PARTS = {"total": "w", "adiabatic": "w / 3.0", "diabatic": "w - w / 3.0", "qg_diabatic": "0.5 * w", "lhr_moist": "0.2 * w * w"}
_OMEGA = f""", om AS ({' UNION ALL '.join(f"SELECT '{n}' AS component, level, ilat, ilon, lat, {w} AS omega FROM grid" for n, w in _PARTS.items())}),
 o1 AS (SELECT *, -({sql_ddp('omega').replace('PARTITION BY ', 'PARTITION BY component, ')}) AS src FROM om),
 o2 AS (SELECT *, src - sum(cos(lat * {RAD}) * src) OVER (PARTITION BY component, level) / sum(CASE WHEN src IS NOT NULL THEN cos(lat * {RAD}) END) OVER (PARTITION BY component, level) AS f FROM o1)"""


@register("omega_divergent_wind", f"""WITH {GRID}{_OMEGA} SELECT component, level, ilat, ilon, round(CASE WHEN ilat IN (0, 9) THEN 0.0 ELSE 1e3 * coalesce(f, 0) END, 5) + 0.0 AS lap_chi, 0.0 AS edge, true AS winds_fit FROM o2""")
def omega_divergent_wind(spark, sf):
    """Total, the four parts and their winds: chi's Laplacian at inner rows is the motion's source, chi is 0 on the edge rows,
    the wind is chi's gradient."""
    g = grid(spark, sf)
    parts = {"total": F.col("w"), "adiabatic": C.omega_dry(F.col("w")), "diabatic": F.col("w") - C.omega_dry(F.col("w")), "qg_diabatic": 0.5 * F.col("w"), "lhr_moist": 0.2 * F.col("w") * F.col("w")}
    keys = ["component", "level"]
    d = invert.omega_winds(g, parts, [], _SPHERE)
    d = invert.gradient(S.with_laplacian(d, "chi", "lap_chi", keys, DLAT, DLON), "chi", ("_cx", "_cy"), keys, DLAT, DLON)
    fit = (F.abs(F.col("u_div") - F.col("_cx")) < 1e-9) & (F.abs(F.col("v_div") - F.col("_cy")) < 1e-9)
    size = F.max(F.abs("chi")).over(Window.partitionBy("component"))
    edge = r(F.when(F.col("ilat").isin(0, NLAT - 1), F.col("chi") / size).otherwise(0.0)).alias("edge")
    return d.select("component", "level", "ilat", "ilon", r(F.col("lap_chi"), 1e3, 5).alias("lap_chi"), edge, F.coalesce(fit, F.lit(True)).alias("winds_fit"))


@register("omega_additivity", f"""WITH {GRID}{_OMEGA} SELECT level, round(1e3 * sum(abs(f)) FILTER (component = 'total' AND ilat NOT IN (0, 9)), 4) + 0.0 AS source, true AS u_ok, true AS v_ok FROM o2 GROUP BY 1""")
def omega_additivity(spark, sf):
    """The parts' winds, inverted each by itself, add up to the total's to 1e-10 of its size; the total is that of its source."""
    g = grid(spark, sf).withColumn("dry", C.omega_dry(F.col("w")))
    d = invert.decompose_omega(g, "w", "dry", [], _SPHERE)
    d = S.with_laplacian(d, "chi", "lap_chi", ["component", "level"], DLAT, DLON)
    e = invert.additivity_error(d, ("u_div", "v_div"))
    size = d.agg(F.max(F.abs("u_div")).alias("u"), F.max(F.abs("v_div")).alias("v"))
    ok = e.crossJoin(size).select((F.col("max_u_div") <= 1e-10 * F.col("u")).alias("u_ok"), (F.col("max_v_div") <= 1e-10 * F.col("v")).alias("v_ok"))  # two single rows
    source = d.filter("component = 'total'").groupBy("level").agg(r(F.sum(F.abs("lap_chi")), 1e3, 4).alias("source"))
    return source.crossJoin(F.broadcast(ok))


@register("unit_conversions", f"WITH {GRID} SELECT level, ilat, ilon, round(z / 9.81, 6) + 0.0 AS height, level * 100.0 AS pa, round(6 * {RAD} * {R_EARTH}, 4) + 0.0 AS metres, round(6 * {RAD} * {R_EARTH} * 15 * {RAD} * {R_EARTH} * cos(lat * {RAD}) / 1e6, 4) + 0.0 AS area_km2 FROM grid")
def unit_conversions(spark, sf):
    g = grid(spark, sf)
    return g.select("level", "ilat", "ilon", r(C.geopotential_to_m(F.col("z"))).alias("height"), (F.col("level") * 100.0).alias("pa"), r(C.deg_to_m(F.lit(DLAT)), 1, 4).alias("metres"), r(C.m2_to_km2(S.dy_m(DLAT) * S.dx_m(F.col("lat"), DLON)), 1, 4).alias("area_km2"))
