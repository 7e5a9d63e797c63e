"""Queries on the gridded view: thermodynamics, derivatives, smoothing, forcing."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import columns as C
from fieldspark.functions.constants import CP_DRY, KAPPA, L_VAPOUR, OMEGA, R_DRY, R_EARTH, R_VAPOUR
from fieldspark.operators import stencil as S
from fieldspark.plans.proxies import DLAT, DLON, GRID, LAT0, NLAT, NLON, grid, r
from fieldspark.plans.registry import register

LV = ["level"]
PI = "3.141592653589793"
RAD = f"({PI} / 180)"


def _lead(c: str, axis: str, keys: str, n: int = 1) -> str:
    return f"lead({c}, {n}) OVER (PARTITION BY {keys} ORDER BY {axis})"


def _lag(c: str, axis: str, keys: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER (PARTITION BY {keys} ORDER BY {axis})"


def sql_ring(c: str) -> str:
    """Centred difference times 2 on the ring of 24 longitudes."""
    k = "level, ilat"
    f = f"first_value({c}) OVER (PARTITION BY {k} ORDER BY ilon ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"((CASE WHEN ilon = 23 THEN {f} ELSE {_lead(c, 'ilon', k)} END) - (CASE WHEN ilon = 0 THEN {f.replace('first_', 'last_')} ELSE {_lag(c, 'ilon', k)} END))"


def sql_ddx(c: str) -> str:
    return f"({sql_ring(c)} / (2 * 15 * {RAD} * {R_EARTH} * cos(lat * {RAD})))"


def sql_ddy(c: str, step: str = f"(6 * {RAD} * {R_EARTH})") -> str:
    n, s = _lead(c, "ilat", "level, ilon"), _lag(c, "ilat", "level, ilon")
    return f"(CASE WHEN ilat = 0 THEN ({n} - {c}) / {step} WHEN ilat = 9 THEN ({c} - {s}) / {step} ELSE ({n} - {s}) / (2 * {step}) END)"


def sql_ddp(c: str) -> str:
    k = "ilat, ilon"
    cp, cm = _lead(c, "level", k), _lag(c, "level", k)
    hp, hm = f"(100.0 * ({_lead('level', 'level', k)} - level))", f"(100.0 * (level - {_lag('level', 'level', k)}))"
    return f"(CASE WHEN level = 110 THEN ({cp} - {c}) / {hp} WHEN level = 1190 THEN ({c} - {cm}) / {hm} ELSE -{hp} / ({hm} * ({hm} + {hp})) * {cm} + ({hp} - {hm}) / ({hm} * {hp}) * {c} + {hm} / ({hp} * ({hm} + {hp})) * {cp} END)"


def sql_dphi(c: str) -> str:
    k, st = "level, ilon", f"(6 * {RAD})"
    n, s, n2, s2 = _lead(c, "ilat", k), _lag(c, "ilat", k), _lead(c, "ilat", k, 2), _lag(c, "ilat", k, 2)
    return f"(CASE WHEN ilat = 0 THEN (-3 * {c} + 4 * {n} - {n2}) / (2 * {st}) WHEN ilat = 9 THEN (3 * {c} - 4 * {s} + {s2}) / (2 * {st}) ELSE ({n} - {s}) / (2 * {st}) END)"


def _cells(df, **cols):
    return df.select("level", "ilat", "ilon", *[r(c, s).alias(k) for k, (c, s) in cols.items()])


def _sql(body: str, with_: str = "", **cols) -> str:
    got = ", ".join(f"round(({c}) * {s}, 6) + 0.0 AS {k}" for k, (c, s) in cols.items())
    return f"WITH {GRID}{with_} SELECT level, ilat, ilon, {got} FROM {body}"


TH = f"(t * pow(1000.0 / level, {KAPPA!r}))"
ES = "(611.2 * exp(17.67 * (t - 273.15) / (t - 29.65)))"
QS = f"(0.622 * {ES} / (level * 100.0 - 0.378 * {ES}))"
THE = f"({TH} * exp({L_VAPOUR} * q / ({CP_DRY} * t)))"
GR = f"((1 + {L_VAPOUR} * {QS} / ({R_DRY} * t)) / (1 + {L_VAPOUR} * {L_VAPOUR} * {QS} / ({CP_DRY} * {R_VAPOUR} * t * t)))"


@register("thermo_functions", _sql("grid", theta=(TH, 1), es=(ES, 1), qs=(QS, 1e3), qs_mix=(f"0.622 * {ES} / (level * 100.0 - {ES})", 1e3), theta_e=(THE, 1), lapse_ratio=(GR, 1), omega_dry=("w / 3.0", 1), omega_rest=("2.0 * w / 3.0", 1)))
def thermo_functions(spark, sf):
    g = grid(spark, sf)
    t, p, q = F.col("t"), F.col("level"), F.col("q")
    return _cells(
        g, theta=(C.theta(t, p), 1), es=(C.saturation_pressure(t), 1), qs=(C.saturation_humidity(t, p), 1e3),
        qs_mix=(C.saturation_humidity(t, p, True), 1e3), theta_e=(C.theta_e(t, p, q), 1),
        lapse_ratio=(C.moist_lapse_ratio(t, C.saturation_humidity(t, p)), 1), omega_dry=(C.omega_dry(F.col("w")), 1), omega_rest=(C.omega_rest(F.col("w")), 1),
    )


HEAT = f""", h0 AS (SELECT *, {TH} AS th, {THE} AS the, {QS} AS qs, {GR} AS gr FROM grid),
h1 AS (SELECT *, {sql_ddp('th')} AS thp, {sql_ddp('the')} AS thep, {sql_ddp('qs')} AS qsp, {sql_ddx('v')} - {sql_ddy('u')} AS zeta FROM h0),
h2 AS (SELECT *, CASE WHEN w < 0 THEN w * (thp - gr * (th / the) * thep) ELSE 0.0 END AS heat FROM h1),
h3 AS (SELECT *, {sql_ddp('heat')} AS heatp FROM h2)"""


def heating(g):
    """theta_dot, its alternative, zeta and the vorticity source Q of gridded fields."""
    t, p, q, w = F.col("t"), F.col("level"), F.col("q"), F.col("w")
    g = g.withColumn("th", C.theta(t, p)).withColumn("the", C.theta_e(t, p, q)).withColumn("qs", C.saturation_humidity(t, p))
    for c in ("th", "the", "qs"):
        g = g.withColumn(f"{c}p", S.ddp(F.col(c), [], p))
    g = g.withColumn("heat", C.latent_heating(w, t, p, q, F.col("thp"), F.col("thep"))).withColumn("heat_alt", C.latent_heating_from_qs(w, t, p, F.col("qsp")))
    g = g.withColumn("heatp", S.ddp(F.col("heat"), [], p))
    g = g.withColumn("_vx", S.ddx(F.col("v"), LV, DLON)).withColumn("_uy", S.ddy(F.col("u"), LV, DLAT)).withColumn("zeta", F.col("_vx") - F.col("_uy"))
    return g.withColumn("Q", C.vorticity_source(C.coriolis(F.col("lat")), F.col("zeta"), F.col("heatp")))


@register("heating_chain", _sql("h3", HEAT, theta_dot=("heat", 1e3), theta_dot_alt=(f"CASE WHEN w < 0 THEN greatest(0.0, -({L_VAPOUR} / {CP_DRY}) * pow(1000.0 / level, {KAPPA!r}) * w * qsp) ELSE 0.0 END", 1e3), zeta=("zeta", 1e6), vort_source=(f"-9.81 * (2 * {OMEGA} * sin(lat * {RAD}) + zeta) * heatp", 1e9)))
def heating_chain(spark, sf):
    return _cells(heating(grid(spark, sf)), theta_dot=(F.col("heat"), 1e3), theta_dot_alt=(F.col("heat_alt"), 1e3), zeta=(F.col("zeta"), 1e6), vort_source=(F.col("Q"), 1e9))


@register("ddx_ddy_ddp", _sql("grid", ux=(sql_ddx("u"), 1e6), uy=(sql_ddy("u"), 1e6), up=(sql_ddp("u"), 1e4)))
def ddx_ddy_ddp(spark, sf):
    g, u = grid(spark, sf), F.col("u")
    return _cells(g, ux=(S.ddx(u, LV, DLON), 1e6), uy=(S.ddy(u, LV, DLAT), 1e6), up=(S.ddp(u, [], F.col("level")), 1e4))


@register("ddx_open_ends", _sql("grid", ux=(f"CASE WHEN ilon = 0 THEN ({_lead('u', 'ilon', 'level, ilat')} - u) WHEN ilon = 23 THEN u - {_lag('u', 'ilon', 'level, ilat')} ELSE ({_lead('u', 'ilon', 'level, ilat')} - {_lag('u', 'ilon', 'level, ilat')}) / 2 END / (15 * {RAD} * {R_EARTH} * cos(lat * {RAD}))", 1e6)))
def ddx_open_ends(spark, sf):
    return _cells(grid(spark, sf), ux=(S.ddx(F.col("u"), LV, DLON, periodic=False), 1e6))


@register("second_derivatives", _sql("d1", f", d0 AS (SELECT *, {sql_ddx('pv')} AS px, {sql_ddy('pv')} AS py FROM grid), d1 AS (SELECT *, {sql_ddx('px')} AS pxx, {sql_ddy('py')} AS pyy, {sql_ddy('px')} AS pxy FROM d0)", pxx=("pxx", 1e9), pyy=("pyy", 1e9), pxy=("pxy", 1e9)))
def second_derivatives(spark, sf):
    g = grid(spark, sf).withColumn("px", S.ddx(F.col("pv"), LV, DLON)).withColumn("py", S.ddy(F.col("pv"), LV, DLAT))
    return _cells(g, pxx=(S.ddx(F.col("px"), LV, DLON), 1e9), pyy=(S.ddy(F.col("py"), LV, DLAT), 1e9), pxy=(S.ddy(F.col("px"), LV, DLAT), 1e9))


@register("angular_derivatives", _sql("grid", dlam=(f"{sql_ring('u')} / (2 * 15 * {RAD})", 1), dphi=(sql_dphi("u"), 1)))
def angular_derivatives(spark, sf):
    u = F.col("u")
    return _cells(grid(spark, sf), dlam=(S.d_dlambda(u, LV, DLON), 1), dphi=(S.d_dphi(u, LV, DLAT), 1))


@register("spherical_divergence", _sql("d0", f", d0 AS (SELECT *, v * cos(lat * {RAD}) AS cv FROM grid)", div=(f"({sql_ring('u')} / (2 * 15 * {RAD}) + {sql_dphi('cv')}) / ({R_EARTH} * cos(lat * {RAD}))", 1e6)))
def spherical_divergence(spark, sf):
    return _cells(S.with_divergence(grid(spark, sf), "u", "v", "d", LV, DLAT, DLON), div=(F.col("d"), 1e6))


TAN = f"(tan(lat * {RAD}) / {R_EARTH})"


@register("vorticity_divergence", _sql("grid", vort=(f"{sql_ddx('v')} - {sql_ddy('u')} + u * {TAN}", 1e6), div=(f"{sql_ddx('u')} + {sql_ddy('v')} - v * {TAN}", 1e6)))
def vorticity_divergence(spark, sf):
    return _cells(S.with_vorticity_divergence(grid(spark, sf), LV, DLAT, DLON), vort=(F.col("vort"), 1e6), div=(F.col("div"), 1e6))


def sql_lap(c: str) -> str:
    k, kk = "level, ilat", "level, ilon"
    e = f"(CASE WHEN ilon = 23 THEN first_value({c}) OVER (PARTITION BY {k} ORDER BY ilon ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE {_lead(c, 'ilon', k)} END)"
    w = f"(CASE WHEN ilon = 0 THEN last_value({c}) OVER (PARTITION BY {k} ORDER BY ilon ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE {_lag(c, 'ilon', k)} END)"
    n, s = _lead(c, "ilat", kk), _lag(c, "ilat", kk)
    dl, dp = f"(15 * {RAD})", f"(6 * {RAD})"
    return f"""(CASE WHEN ilat IN (0, 9) THEN 0.0 ELSE ({e} - 2 * {c} + {w}) / ({R_EARTH} * {R_EARTH} * cos(lat * {RAD}) * cos(lat * {RAD}) * {dl} * {dl})
      + (cos((lat + 3) * {RAD}) * ({n} - {c}) - cos((lat - 3) * {RAD}) * ({c} - {s})) / ({dp} * {dp} * {R_EARTH} * {R_EARTH} * cos(lat * {RAD})) END)"""


@register("laplacian", _sql("grid", lap=(sql_lap("u"), 1e12)))
def laplacian(spark, sf):
    return _cells(S.with_laplacian(grid(spark, sf), "u", "l", LV, DLAT, DLON), lap=(F.col("l"), 1e12))


@register("geostrophic_wind", _sql("grid", ug=(f"-{sql_ddy('z')} / (2 * {OMEGA} * sin(lat * {RAD}))", 1), vg=(f"{sql_ddx('z')} / (2 * {OMEGA} * sin(lat * {RAD}))", 1)))
def geostrophic_wind(spark, sf):
    return _cells(S.with_geostrophic_wind(grid(spark, sf), "z", LV, DLAT, DLON), ug=(F.col("ug"), 1), vg=(F.col("vg"), 1))


@register("static_stability", _sql("s1", f""", s0 AS (SELECT *, -({R_DRY} * t / (level * 100.0)) * (lead(ln(t * pow(1e5 / (level * 100.0), {KAPPA!r}))) OVER w - lag(ln(t * pow(1e5 / (level * 100.0), {KAPPA!r}))) OVER w)
   / (100.0 * (lead(level) OVER w - lag(level) OVER w)) AS s FROM grid WINDOW w AS (PARTITION BY ilat, ilon ORDER BY level)),
  s1 AS (SELECT *, greatest(1e-7, CASE WHEN level = 110 THEN lead(s) OVER w WHEN level = 1190 THEN lag(s) OVER w ELSE s END) AS sigma FROM s0 WINDOW w AS (PARTITION BY ilat, ilon ORDER BY level))""", sigma=("sigma", 1e6)))
def static_stability(spark, sf):
    return _cells(S.with_static_stability(grid(spark, sf), "t", "s", ["ilat", "ilon"]), sigma=(F.col("s"), 1e6))


@register("stability_profile", f"""WITH {GRID}, m AS (SELECT level, avg(t) AS t FROM grid GROUP BY 1),
 s0 AS (SELECT *, -({R_DRY} * t / (level * 100.0)) * (lead(ln(t * pow(1e5 / (level * 100.0), {KAPPA!r}))) OVER w - lag(ln(t * pow(1e5 / (level * 100.0), {KAPPA!r}))) OVER w)
   / (100.0 * (lead(level) OVER w - lag(level) OVER w)) AS s FROM m WINDOW w AS (ORDER BY level))
 SELECT level, round(1e6 * greatest(1e-7, CASE WHEN level = 110 THEN lead(s) OVER w WHEN level = 1190 THEN lag(s) OVER w ELSE s END), 6) + 0.0 AS sigma0 FROM s0 WINDOW w AS (ORDER BY level)""")
def stability_profile(spark, sf):
    m = grid(spark, sf).groupBy("level").agg(F.avg("t").alias("t")).withColumn("k", F.lit(0))
    return S.with_static_stability(m, "t", "s", ["k"]).select("level", r(F.col("s"), 1e6).alias("sigma0"))


@register("smooth_121", _sql("s1", f", s0 AS (SELECT *, CASE WHEN ilat IN (0, 9) THEN t ELSE ({_lag('t', 'ilat', 'level, ilon')} + 2 * t + {_lead('t', 'ilat', 'level, ilon')}) / 4 END AS a FROM grid), s1 AS (SELECT *, CASE WHEN ilon IN (0, 23) THEN a ELSE ({_lag('a', 'ilon', 'level, ilat')} + 2 * a + {_lead('a', 'ilon', 'level, ilat')}) / 4 END AS b FROM s0)", t=("b", 1)))
def smooth_121(spark, sf):
    g = grid(spark, sf).withColumn("a", S.smooth_121(F.col("t"), ["level", "ilon"], "ilat"))
    return _cells(g.withColumn("b", S.smooth_121(F.col("a"), ["level", "ilat"], "ilon")), t=(F.col("b"), 1))


_K = "(VALUES " + ", ".join(f"({i - len(S.kernel(1.0)) // 2}, {w!r})" for i, w in enumerate(S.kernel(1.0))) + ")"


@register("gauss_wrap", _sql("s1", f""", s0 AS (SELECT level, ilat, (ilon + o + 240) % 24 AS ilon, sum(w * t) / sum(w) FILTER (t IS NOT NULL) AS a FROM (SELECT level, ilat, ilon, t FROM grid) g, {_K} k(o, w) GROUP BY 1, 2, 3),
  s1 AS (SELECT level, (ilat + o + 100) % 10 AS ilat, ilon, sum(w * a) / sum(w) FILTER (a IS NOT NULL) AS b FROM s0, {_K} k(o, w) GROUP BY 1, 2, 3)""", t=("b", 1)))
def gauss_wrap(spark, sf):
    return _cells(S.gauss_wrap(grid(spark, sf), "t", "b", LV, 1.0, NLAT, NLON), t=(F.col("b"), 1))


@register("fourier_ring", _sql("f", f""", c AS (SELECT level, ilat, avg(t) AS m0, {', '.join(f"2 * sum(t * cos(2 * {PI} * {m} * ilon / 24)) / 24 AS c{m}, 2 * sum(t * sin(2 * {PI} * {m} * ilon / 24)) / 24 AS s{m}" for m in (1, 2))} FROM grid GROUP BY 1, 2),
  f AS (SELECT level, ilat, ilon, m0 + {' + '.join(f"c{m} * cos(2 * {PI} * {m} * ilon / 24) + s{m} * sin(2 * {PI} * {m} * ilon / 24)" for m in (1, 2))} AS b FROM grid JOIN c USING (level, ilat))""", t=("b", 1)))
def fourier_ring(spark, sf):
    return _cells(S.fourier_filter(grid(spark, sf), "t", "b", ["level", "ilat"], "ilon", NLON, 2), t=(F.col("b"), 1))


_W = [sum(-2 * m * __import__("math").sin(2 * 3.141592653589793 * m * d / 24) for m in range(1, 12)) / 24 for d in range(24)]
_WV = "(VALUES " + ", ".join(f"({d}, {w!r})" for d, w in enumerate(_W)) + ")"


@register("spectral_gradient", _sql("s0", f", s0 AS (SELECT g.level, g.ilat, (g.ilon + d) % 24 AS ilon, any_value(g.lat) AS lat, sum(u * wt) AS a FROM grid g, {_WV} k(d, wt) GROUP BY 1, 2, 3)", ux=(f"a / ({R_EARTH} * cos(lat * {RAD}))", 1e6)))
def spectral_gradient(spark, sf):
    return _cells(S.ddx_spectral(grid(spark, sf), "u", "a", LV, DLON, NLON), ux=(F.col("a"), 1e6))


@register("regrid_bilinear", f"""WITH {GRID}, tg AS (SELECT 20.0 + 7.0 * a AS tlat, -175.0 + 20.0 * b AS tlon FROM range(0, 7) x(a), range(0, 18) y(b)),
 p AS (SELECT *, floor((tlat - 20) / 6) AS j, floor((tlon + 180) / 15) AS i, (tlat - 20) / 6 - floor((tlat - 20) / 6) AS fy, (tlon + 180) / 15 - floor((tlon + 180) / 15) AS fx FROM tg),
 c AS (SELECT tlat, tlon, CAST(j + a AS INT) AS ilat, CAST((i + b) % 24 AS INT) AS ilon, (CASE a WHEN 1 THEN fy ELSE 1 - fy END) * (CASE b WHEN 1 THEN fx ELSE 1 - fx END) AS wt FROM p, range(0, 2) x(a), range(0, 2) y(b))
 SELECT level, tlat, tlon, round(sum(wt * t), 6) + 0.0 AS t FROM grid JOIN c USING (ilat, ilon) WHERE wt > 0 GROUP BY 1, 2, 3 HAVING sum(wt) > 1 - 1e-9 AND count(t) = count(*)""")
def regrid_bilinear(spark, sf):
    target = spark.range(7 * 18).select((20.0 + 7.0 * F.floor(F.col("id") / 18)).alias("tlat"), (-175.0 + 20.0 * (F.col("id") % 18)).alias("tlon"))
    out = S.regrid_bilinear(grid(spark, sf), "t", "o", target, LV, LAT0, DLAT, -180.0, DLON, NLON)
    return out.select("level", "tlat", "tlon", r(F.col("o")).alias("t"))


@register("coriolis_taper_spacing", f"""WITH {GRID} SELECT DISTINCT ilat, round(1e6 * 2 * {OMEGA} * sin(lat * {RAD}), 6) + 0.0 AS f, round(greatest(0.0, least(1.0, (lat - 15) / 10)) * greatest(0.0, least(1.0, (85 - lat) / 5)), 6) + 0.0 AS taper,
 round(15 * {RAD} * {R_EARTH} * cos(lat * {RAD}), 3) + 0.0 AS dx, round(greatest(15 * {RAD} * {R_EARTH} * cos(lat * {RAD}), 0.1 * 6 * {RAD} * {R_EARTH}), 3) + 0.0 AS dx_floor FROM grid""")
def coriolis_taper_spacing(spark, sf):
    lat = F.col("lat")
    g = grid(spark, sf).select("ilat", "lat").distinct()
    return g.select("ilat", r(C.coriolis(lat), 1e6).alias("f"), r(C.taper(lat)).alias("taper"), r(S.dx_m(lat, DLON), 1, 3).alias("dx"), r(S.dx_m(lat, DLON, 0.1, DLAT), 1, 3).alias("dx_floor"))


@register("unwrapped_longitude", f"""WITH {GRID}, a AS (SELECT level, ilat, ilon, ((ilon * 15 + 97 * ilat + 180) % 360) - 180.0 AS lon FROM grid),
 b AS (SELECT *, CASE WHEN lon - lag(lon) OVER w < -180 THEN 360.0 WHEN lon - lag(lon) OVER w > 180 THEN -360.0 ELSE 0.0 END AS jump FROM a WINDOW w AS (PARTITION BY level, ilat ORDER BY ilon))
 SELECT level, ilat, ilon, lon + sum(jump) OVER (PARTITION BY level, ilat ORDER BY ilon) AS lon_u FROM b""")
def unwrapped_longitude(spark, sf):
    g = grid(spark, sf).select("level", "ilat", "ilon", C.wrap_lon((F.col("ilon") * 15 + 97 * F.col("ilat")).cast("double")).alias("lon0"))
    return S.with_unwrapped_lon(g, "lon0", "lon_u", ["level", "ilat"], "ilon").select("level", "ilat", "ilon", "lon_u")
