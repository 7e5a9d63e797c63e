"""Queries: budget terms, basis and projection, resampling, isentropic levels, overturning."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspark.functions import columns as C
from fieldspark.functions.constants import KAPPA
from fieldspark.operators import basis as B
from fieldspark.operators import composite as K
from fieldspark.operators import isentropic as I
from fieldspark.operators import overturn as O
from fieldspark.operators import resample as R
from fieldspark.operators import terms as M
from fieldspark.plans.fields import PI, TH, sql_ddp, sql_ddx, sql_ddy
from fieldspark.plans.proxies import CATALOG, DLAT, DLON, GRID, PATCHES, catalog, grid, patches, r
from fieldspark.operators import stencil as S
from fieldspark.plans.registry import register
from fieldspark.sources.scratch import written

# --- budget terms: bar = mean over the ring, anom = the rest ---

_BUD = f""", b0 AS (SELECT *, {', '.join(f'avg({c}) OVER (PARTITION BY level, ilat) AS {c}_bar, {c} - avg({c}) OVER (PARTITION BY level, ilat) AS {c}_anom' for c in ('u', 'v', 'w', 'pv'))} FROM grid),
b1 AS (SELECT *, {', '.join(f'{f(f"pv_{m}")} AS pv_{m}_{a}' for m in ('bar', 'anom') for a, f in (('dx', sql_ddx), ('dy', sql_ddy), ('dp', sql_ddp)))} FROM b0)"""


def budget_cells(spark, sf):
    """Gridded fields with bar and anomaly winds and the gradients of both."""
    from pyspark.sql import Window

    g, w = grid(spark, sf), Window.partitionBy("level", "ilat")
    for c in ("u", "v", "w", "pv"):
        g = g.withColumn(f"{c}_bar", F.avg(c).over(w)).withColumn(f"{c}_anom", F.col(c) - F.avg(c).over(w))
    for m in ("bar", "anom"):
        q = F.col(f"pv_{m}")
        g = g.withColumn(f"pv_{m}_dx", S.ddx(q, ["level"], DLON)).withColumn(f"pv_{m}_dy", S.ddy(q, ["level"], DLAT)).withColumn(f"pv_{m}_dp", S.ddp(q, [], F.col("level")))
    return g


_BASE = [(n, w, g) for n, w, g, f in M.catalogue() if f == "base"]


@register("budget_products", f"WITH {GRID}{_BUD} SELECT level, ilat, ilon, {', '.join(f'round(1e3 * {w} * {g}, 6) + 0.0 AS {n}' for n, w, g in _BASE)} FROM b1")
def budget_products(spark, sf):
    p = M.product_terms(budget_cells(spark, sf), ("base",), ["level", "ilat", "ilon"])
    return p.select("level", "ilat", "ilon", *[r(F.col(n), 1e3).alias(n) for n, _, _ in _BASE])


_SPLIT = [(n, w, g) for n, w, g, f in M.catalogue() if f != "base"]
_FACTORS = sorted({w for _, w, _ in _SPLIT})


@register("budget_all_products", f"WITH {GRID}{_BUD} SELECT level, ilat, ilon, round(1e3 * ({' + '.join(f'{0.1 * (_FACTORS.index(w) + 1)!r} * u * {g}' for _, w, g in _SPLIT)}), 5) + 0.0 AS total, {len(_SPLIT)} AS n_terms FROM b1")
def budget_all_products(spark, sf):
    """The 40 products of split winds; each split wind stands in as a multiple of u."""
    c = budget_cells(spark, sf)
    for k, w in enumerate(_FACTORS):
        c = c.withColumn(w, 0.1 * (k + 1) * F.col("u"))
    p = M.product_terms(c, ("split", "omega_wind", "vertical"), ["level", "ilat", "ilon"])
    names = [n for n in p.columns if n not in ("level", "ilat", "ilon")]
    return p.select("level", "ilat", "ilon", r(M.signed_sum(names), 1e3, 5).alias("total"), F.lit(len(names)).alias("n_terms"))


_G4 = {k: " + ".join(f"-({w} * {g})" for n, w, g in _BASE if f"-{n}" in v) for k, v in M.FOUR_GROUPS.items()}


@register("grouped_terms", f"WITH {GRID}{_BUD} SELECT level, ilat, ilon, {', '.join(f'round(1e3 * ({e}), 6) + 0.0 AS {k}' for k, e in _G4.items())} FROM b1")
def grouped_terms(spark, sf):
    p = M.product_terms(budget_cells(spark, sf), ("base",))
    p = p.select("level", "ilat", "ilon", *M.grouped_terms(M.FOUR_GROUPS))
    return p.select("level", "ilat", "ilon", *[r(F.col(k), 1e3).alias(k) for k in M.FOUR_GROUPS])


@register("collect_terms", f"WITH {GRID}{_BUD} SELECT level, ilat, ilon, term, round(1e3 * value, 6) + 0.0 AS value FROM ({' UNION ALL '.join(f'''SELECT level, ilat, ilon, '{n}' AS term, -({w} * {g}) AS value FROM b1''' for n, w, g in _BASE[:4])})")
def collect_terms(spark, sf):
    p = M.product_terms(budget_cells(spark, sf), ("base",))
    t = M.collect_terms(p, ["level", "ilat", "ilon"], [n for n, _, _ in _BASE[:4]])
    return t.select("level", "ilat", "ilon", "term", r(F.col("value"), 1e3).alias("value"))


_ADV = "(" + " + ".join(f"{w} * {g}" for _, w, g in _BASE) + ")"


@register("budget_closure", f"WITH {GRID}{_BUD} SELECT level, ilat, ilon, round(-1e3 * {_ADV}, 6) + 0.0 AS adv, round(1e3 * (q + {_ADV}), 6) + 0.0 AS resid FROM b1")
def budget_closure(spark, sf):
    c = M.closure(M.product_terms(budget_cells(spark, sf), ("base",)), "q", [n for n, _, _ in _BASE])
    return c.select("level", "ilat", "ilon", r(F.col("adv"), 1e3).alias("adv"), r(F.col("resid"), 1e3).alias("resid"))


@register("track_budget", f"WITH {GRID}{_BUD} SELECT level, ilat, ilon, round(-1e3 * (u_bar * pv_anom_dx + u_anom * pv_bar_dx + v_bar * pv_anom_dy + v_anom * pv_bar_dy), 6) + 0.0 AS total FROM b1")
def track_budget(spark, sf):
    return M.track_budget(budget_cells(spark, sf)).select("level", "ilat", "ilon", r(F.col("total"), 1e3).alias("total"))


@register("outflow_estimates", f"WITH {GRID}{_BUD} SELECT level, ilat, ilon, {', '.join(f'round(-1e3 * {k} * (u * pv_bar_dx + v * pv_bar_dy), 6) + 0.0 AS {n}' for n, k in (('latent', 0.2), ('budget', 0.3), ('total', 0.5)))} FROM b1")
def outflow_estimates(spark, sf):
    c = budget_cells(spark, sf)
    for n, k in (("lhr_moist", 0.2), ("qg_diabatic", 0.3), ("anom", 0.5)):
        c = c.withColumn(f"u_div_{n}", k * F.col("u")).withColumn(f"v_div_{n}", k * F.col("v"))
    c = M.outflow_estimates(c)
    return c.select("level", "ilat", "ilon", *[r(F.col(f"outflow_{n}"), 1e3).alias(n) for n in ("latent", "budget", "total")])


# --- basis and projection on 8 x 8 patches ---

_U = ["track_id"]
_DX = f"(1.5 * {PI} / 180 * 6371000.0)"


def _d(c: str, axis: str, other: str) -> str:
    w = f"OVER (PARTITION BY track_id, {other} ORDER BY {axis})"
    return f"(CASE {axis} WHEN 0 THEN (lead({c}) {w} - {c}) / {_DX} WHEN 7 THEN ({c} - lag({c}) {w}) / {_DX} ELSE (lead({c}) {w} - lag({c}) {w}) / (2 * {_DX}) END)"


_RAW = f""", r0 AS (SELECT *, a AS p1, {_d('a', 'ix', 'iy')} AS p2, {_d('a', 'iy', 'ix')} AS p3 FROM patches),
r1 AS (SELECT *, {_d('p2', 'ix', 'iy')} AS xx, {_d('p3', 'iy', 'ix')} AS yy, {_d('p2', 'iy', 'ix')} AS p4 FROM r0),
r2 AS (SELECT track_id, variant, dh, iy, ix, x_rel, y_rel, a, b, p1, p2, p3, p4, xx - yy AS p5, xx + yy AS p6 FROM r1)"""


def raw(spark, sf):
    return B.raw_basis(patches(spark, sf), _U, "a", 1.5, 1.5)


@register("raw_basis", f"WITH {PATCHES}{_RAW} SELECT track_id, iy, ix, round(p2 * 1e6, 6) + 0.0 AS phi2, round(p3 * 1e6, 6) + 0.0 AS phi3, round(p4 * 1e12, 6) + 0.0 AS phi4, round(p5 * 1e12, 6) + 0.0 AS phi5, round(p6 * 1e12, 6) + 0.0 AS phi6 FROM r2")
def raw_basis(spark, sf):
    c = raw(spark, sf)
    return c.select("track_id", "iy", "ix", *[r(F.col(f"phi{k}"), s).alias(f"phi{k}") for k, s in ((2, 1e6), (3, 1e6), (4, 1e12), (5, 1e12), (6, 1e12))])


_NORM = _RAW + f""", s AS (SELECT track_id, {', '.join(f'1.0 / quantile_cont(abs(p{k}), 0.95) FILTER (p{k} <> 0) AS s{k}' for k in range(1, 7))} FROM r2 GROUP BY 1),
n AS (SELECT r2.track_id, variant, dh, iy, ix, x_rel, y_rel, a, b, {', '.join(f'p{k} * s{k} AS p{k}' for k in range(1, 7))} FROM r2 JOIN s USING (track_id))"""


@register("prenorm_scales", f"WITH {PATCHES}{_NORM} SELECT track_id, {', '.join(f'round(1 / s{k} * {1 if k == 1 else 1e6 if k < 4 else 1e12}, 6) + 0.0 AS p95_{k}' for k in range(1, 7))} FROM s")
def prenorm_scales(spark, sf):
    c = B.prenorm(raw(spark, sf), _U).groupBy("track_id").agg(*[F.max(f"s{k}").alias(f"s{k}") for k in range(1, 7)])
    return c.select("track_id", *[r(1.0 / F.col(f"s{k}"), 1 if k == 1 else 1e6 if k < 4 else 1e12).alias(f"p95_{k}") for k in range(1, 7)])


def _basis(spark, sf, spec="< 0"):
    c = B.prenorm(raw(spark, sf), _U)
    return B.basis_weights(B.basis_mask(c, spec, "a"), F.col("y_rel") + 45.0)


_W = f"(CASE WHEN a < 0 THEN cos(radians(y_rel + 45.0)) ELSE 0.0 END)"


@register("basis_gram", f"WITH {PATCHES}{_NORM} SELECT track_id, {', '.join(f'round(sum({_W} * p{i + 1} * p{j + 1}), 6) + 0.0 AS g_{i}_{j}' for i in range(6) for j in range(i + 1))} FROM n WHERE {_W} <> 0 GROUP BY 1")
def basis_gram(spark, sf):
    g = B.gram(_basis(spark, sf), _U, [])
    return g.select("track_id", *[r(F.col(c)).alias(c) for c in g.columns if c.startswith("g_")])


def _gs() -> str:
    """Gram-Schmidt step by step, one CTE per field, on the cells themselves."""
    out, prev = "", "n"
    for i in range(2, 7):
        proj = " - ".join([f"p{i}"] + [f"c{j} * p{j}" for j in range(1, i)])
        cs = ", ".join(f"sum({_W} * p{i} * p{j}) / sum({_W} * p{j} * p{j}) AS c{j}" for j in range(1, i))
        out += f", k{i} AS (SELECT track_id, {cs} FROM {prev} GROUP BY 1), o{i} AS (SELECT {prev}.* REPLACE ({proj} AS p{i}) FROM {prev} JOIN k{i} USING (track_id))"
        prev = f"o{i}"
    return out


_COEF = _NORM + _gs() + f""", pr AS (SELECT track_id, {', '.join(f'{B.SIGNS[k - 1]} * sum({_W} * b * p{k}) / sum({_W} * p{k} * p{k}) AS {B.NAMES[k - 1]}' for k in range(1, 7))} FROM o6 GROUP BY 1)"""


@register("projection", f"WITH {PATCHES}{_COEF} SELECT track_id, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in B.NAMES)} FROM pr")
def projection(spark, sf):
    """Coefficients of field b on the six orthogonal patterns of field a."""
    p = B.project(B.gram(_basis(spark, sf), _U, ["b"]), _U, ["b"])
    return p.select("track_id", *[r(F.col(c), 1, 5).alias(c) for c in B.NAMES])


_KM2 = tuple(f"{n}_km2" for n in B.NAMES[3:])


@register("projection_physical", f"WITH {PATCHES}{_COEF}, ph AS (SELECT track_id, {', '.join(f'{n} AS {n}_raw, {n} * s{k} AS {n}' for k, n in enumerate(B.NAMES, 1))} FROM pr JOIN s USING (track_id)) SELECT track_id, {', '.join(f'round({n} * {x}, 5) + 0.0 AS {n}, round({n}_raw, 5) + 0.0 AS {n}_raw' for n, x in zip(B.NAMES, ('1', '1e-6', '1e-6', '1e-12', '1e-12', '1e-12')))}, {', '.join(f'round({n} / 1e6 * 1e-6, 5) + 0.0 AS {n}_km2' for n in B.NAMES[3:])} FROM ph")
def projection_physical(spark, sf):
    """The same coefficients in the units of the fields themselves, those of second derivatives per square kilometre, too."""
    p = B.project(B.gram(_basis(spark, sf), _U, ["b"]), _U, ["b"], physical=True)
    scaled = [r(F.col(n), x, 5).alias(n) for n, x in zip(B.NAMES, (1.0, 1e-6, 1e-6, 1e-12, 1e-12, 1e-12))]
    return p.select("track_id", *scaled, *[r(F.col(f"{n}_raw"), 1, 5).alias(f"{n}_raw") for n in B.NAMES], *[r(F.col(n), 1e-6, 5).alias(n) for n in _KM2])


@register("projection_components", f"WITH {PATCHES}{_COEF}, t AS (SELECT o6.*, beta * p1 AS int, -ax * p2 - ay * p3 AS prop, -gamma1 * p4 AS def1, -gamma2 * p5 AS def2, sigma * p6 AS lap FROM o6 JOIN pr USING (track_id)) SELECT track_id, iy, ix, round(int + prop + def1 + def2 + lap, 5) + 0.0 AS recon, round(CASE WHEN {_W} <> 0 THEN b - (int + prop + def1 + def2 + lap) END, 5) + 0.0 AS resid FROM t")
def projection_components(spark, sf):
    cells = _basis(spark, sf)
    g = B.gram(cells, _U, ["b"])
    c = B.components(B.orthogonal_cells(cells, g, _U), B.project(g, _U, ["b"]), _U, "b")
    return c.select("track_id", "iy", "ix", r(F.col("recon"), 1, 5).alias("recon"), r(F.col("resid"), 1, 5).alias("resid"))


@register("projection_rmse", f"WITH {PATCHES}{_COEF} SELECT track_id, round(sqrt(avg(pow(b - (beta * p1 - ax * p2 - ay * p3 - gamma1 * p4 - gamma2 * p5 + sigma * p6), 2))), 5) + 0.0 AS rmse FROM o6 JOIN pr USING (track_id) WHERE a < 0 GROUP BY 1")
def projection_rmse(spark, sf):
    cells = _basis(spark, sf)
    g = B.gram(cells, _U, ["b"])
    c = B.components(B.orthogonal_cells(cells, g, _U), B.project(g, _U, ["b"]), _U, "b")
    return c.filter("mask").groupBy("track_id").agg(r(K.rmse(F.col("b"), F.col("recon")), 1, 5).alias("rmse"))


def _comp(sql: str) -> str:
    """The same steps on the classes' mean patches: a class takes the unit's place."""
    return sql.replace("FROM patches", "FROM comp")


@register("composite_basis_projection", f"""WITH {PATCHES}, comp AS (SELECT variant AS track_id, variant, 0 AS dh, iy, ix, x_rel, y_rel, avg(a) AS a, 0.0 AS b FROM patches GROUP BY ALL){_comp(_NORM + _gs())},
 pj AS (SELECT p.variant, p.track_id, {', '.join(f'{B.SIGNS[k - 1]} * sum({_W.replace("a <", "o6.a <").replace("y_rel", "o6.y_rel")} * p.b * p{k}) / sum({_W.replace("a <", "o6.a <").replace("y_rel", "o6.y_rel")} * p{k} * p{k}) AS {B.NAMES[k - 1]}' for k in range(1, 7))}
 FROM patches p JOIN o6 ON o6.track_id = p.variant AND o6.iy = p.iy AND o6.ix = p.ix GROUP BY 1, 2) SELECT variant, track_id, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in B.NAMES)} FROM pj""")
def composite_basis_projection(spark, sf):
    """Every patch projected on its class's composite basis."""
    p = patches(spark, sf)
    comp = p.groupBy("variant", "iy", "ix", "x_rel", "y_rel").agg(F.avg("a").alias("a"))
    basis = B.basis_weights(B.basis_mask(B.prenorm(B.raw_basis(comp, ["variant"], "a", 1.5, 1.5), ["variant"]), "< 0", "a"), F.col("y_rel") + 45.0)
    cells = p.drop("a", "x_rel", "y_rel").join(basis.drop("a"), ["variant", "iy", "ix"])
    c = B.project(B.gram(cells, ["variant", "track_id"], ["b"]), ["variant", "track_id"], ["b"])
    return c.select("variant", "track_id", *[r(F.col(n), 1, 5).alias(n) for n in B.NAMES])


_LIFE = f"WITH {PATCHES}{_COEF}, l AS (SELECT variant, dh, beta FROM pr JOIN (SELECT DISTINCT track_id, variant, dh FROM patches) USING (track_id)) "


@register("projection_lifecycle", _LIFE + "SELECT CAST(variant AS VARCHAR) AS stage, dh, round(avg(beta), 5) + 0.0 AS mean, round(stddev_pop(beta) / sqrt(count(beta)), 5) + 0.0 AS sem, count(beta) AS n FROM l GROUP BY 1, 2")
def projection_lifecycle(spark, sf):
    p = B.project(B.gram(_basis(spark, sf), [*_U, "variant", "dh"], ["b"]), [*_U, "variant", "dh"], ["b"])
    s = B.lifecycle(p.withColumn("stage", F.col("variant").cast("string")), "beta")
    return s.select("stage", "dh", r(F.col("mean"), 1, 5).alias("mean"), r(F.col("sem"), 1, 5).alias("sem"), "n")


@register("significant_cells", f"WITH {PATCHES} SELECT track_id, round(sum(CASE WHEN a > 0.1 THEN b ELSE 0.0 END), 6) + 0.0 AS total FROM patches GROUP BY 1")
def significant_cells(spark, sf):
    p = patches(spark, sf).withColumn("sig", F.col("a") > 0.1)
    return p.groupBy("track_id").agg(r(F.sum(B.sig_only("b", "sig"))).alias("total"))


@register("mask_predicates", f"WITH {PATCHES} SELECT track_id, count(*) FILTER (a < 0) AS lt, count(*) FILTER (a >= 1e-1) AS ge, count(*) AS everything FROM patches GROUP BY 1")
def mask_predicates(spark, sf):
    p, n = patches(spark, sf), lambda s: F.count_if(B.mask_predicate(s, F.col("a")))
    return p.groupBy("track_id").agg(n("< 0").alias("lt"), n(" >= 1e-1").alias("ge"), n(None).alias("everything"))


@register("central_blob", f"""WITH RECURSIVE {PATCHES}, m AS (SELECT track_id, iy, ix, x_rel, y_rel FROM patches WHERE a < 0),
 seed AS (SELECT track_id, arg_min(iy, (x_rel * x_rel + y_rel * y_rel, iy, ix)) AS iy, arg_min(ix, (x_rel * x_rel + y_rel * y_rel, iy, ix)) AS ix FROM m GROUP BY 1),
 flood AS (SELECT track_id, iy, ix FROM seed UNION SELECT m.track_id, m.iy, m.ix FROM flood f JOIN m ON m.track_id = f.track_id AND abs(m.iy - f.iy) + abs(m.ix - f.ix) = 1)
 SELECT track_id, count(*) AS n, CAST(sum(iy * 8 + ix) AS BIGINT) AS places FROM flood GROUP BY 1""")
def central_blob(spark, sf):
    c = B.central_blob(patches(spark, sf).withColumn("m", F.col("a") < 0), _U, "m")
    return c.filter("blob").groupBy("track_id").agg(F.count("*").alias("n"), F.sum((F.col("iy") * 8 + F.col("ix")).cast("long")).alias("places"))


@register("centre_region", f"""WITH RECURSIVE {PATCHES}, m AS (SELECT track_id, iy, ix, x_rel, y_rel FROM patches WHERE a < 0.05),
 near AS (SELECT track_id, arg_min(iy, (x_rel * x_rel + y_rel * y_rel, iy, ix)) AS iy, arg_min(ix, (x_rel * x_rel + y_rel * y_rel, iy, ix)) AS ix FROM m GROUP BY 1),
 flood AS (SELECT track_id, iy, ix FROM near UNION SELECT m.track_id, m.iy, m.ix FROM flood f JOIN m ON m.track_id = f.track_id AND abs(m.iy - f.iy) + abs(m.ix - f.ix) = 1),
 ok AS (SELECT DISTINCT track_id FROM flood WHERE iy IN (3, 4) AND ix IN (3, 4))
 SELECT track_id, count(*) AS n, CAST(sum(iy * 8 + ix) AS BIGINT) AS places FROM flood SEMI JOIN ok USING (track_id) GROUP BY 1""")
def centre_region(spark, sf):
    c = B.centre_region(patches(spark, sf), _U, "a", 0.05)
    return c.filter("region").groupBy("track_id").agg(F.count("*").alias("n"), F.sum((F.col("iy") * 8 + F.col("ix")).cast("long")).alias("places"))


@register("callable_spec", f"WITH {PATCHES} SELECT variant, dh, round(sum(2 * a - b * b), 6) + 0.0 AS total, round(sum(-a + b), 6) + 0.0 AS signed FROM patches GROUP BY 1, 2")
def callable_spec(spark, sf):
    """A variable by a function of a column lookup, and by signed names."""
    p = patches(spark, sf)
    spec = M.signed_sum(lambda col: 2 * col("a") - col("b") * col("b"))
    return p.groupBy("variant", "dh").agg(r(F.sum(spec)).alias("total"), r(F.sum(M.signed_sum(["-a", "b"]))).alias("signed"))


@register("discovered_fields", f"WITH {PATCHES} SELECT variant, round(sum(a), 6) + 0.0 AS sum_a, count(a) AS n_a, round(sum(b), 6) + 0.0 AS sum_b, count(b) AS n_b FROM patches GROUP BY 1")
def discovered_fields(spark, sf):
    """Composite of every field that the schema offers: keys and results of projections are left out."""
    p = patches(spark, sf).withColumn("prp__a", F.col("a")).withColumn("beta__b", F.col("b"))
    c = K.build_composites(p, K.composite_fields(p, ["x_rel", "y_rel"]), ["variant"])
    return c.select("variant", *[r(F.col(n)).alias(n) if n.startswith("sum_") else n for n in sorted(c.columns) if n != "variant"])


def _refl(axis: str, other: str, src: str, dst: str) -> str:
    k = ", ".join(f"({i - len(_KR) // 2}, {w!r})" for i, w in enumerate(_KR))
    return f"""{dst} AS (SELECT track_id, {other}, CAST(t AS INT) AS {axis}, sum(wt * v) / sum(wt) AS v FROM (SELECT track_id, {other}, unnest([{axis} + o, -1 - ({axis} + o), 15 - ({axis} + o)]) AS t, wt, v FROM {src}, (VALUES {k}) kk(o, wt)) WHERE t BETWEEN 0 AND 7 GROUP BY 1, 2, 3)"""


_KR = S.kernel(4.0 / 2.355 / 1.5)


@register("gauss_reflect", f"""WITH {PATCHES}, f AS (SELECT track_id, iy, ix, a > -0.1 AS ok, coalesce(CASE WHEN a > -0.1 THEN a END, avg(CASE WHEN a > -0.1 THEN a END) OVER (PARTITION BY track_id)) AS v FROM patches),
 {_refl('ix', 'iy', 'f', 's1')}, {_refl('iy', 'ix', 's1', 's2')} SELECT f.track_id, f.iy, f.ix, round(CASE WHEN ok THEN s2.v END, 6) + 0.0 AS a FROM f JOIN s2 USING (track_id, iy, ix)""")
def gauss_reflect(spark, sf):
    p = patches(spark, sf).withColumn("a", F.when(F.col("a") > -0.1, F.col("a")))
    s = S.gauss_reflect(p, {"a": "s"}, _U, 4.0, 1.5, 8, 8)
    return s.select("track_id", "iy", "ix", r(F.col("s")).alias("a"))


_KEPT = [(my, mx) for my in range(-4, 4) for mx in range(-4, 4) if ((my / 12.0) ** 2 + (mx / 12.0) ** 2) ** 0.5 <= 1 / 5.0 + 1e-12]


@register("fourier_lowpass", f"""WITH {PATCHES}, w(my, mx) AS (VALUES {', '.join(f'({a}, {b})' for a, b in _KEPT)}),
 c AS (SELECT track_id, my, mx, sum(a * cos(2 * {PI} * (my * iy / 8.0 + mx * ix / 8.0))) / 64 AS c, sum(a * sin(2 * {PI} * (my * iy / 8.0 + mx * ix / 8.0))) / 64 AS s FROM patches, w GROUP BY 1, 2, 3)
 SELECT p.track_id, iy, ix, round(sum(c * cos(2 * {PI} * (my * iy / 8.0 + mx * ix / 8.0)) + s * sin(2 * {PI} * (my * iy / 8.0 + mx * ix / 8.0))), 6) + 0.0 AS a FROM patches p JOIN c USING (track_id) GROUP BY 1, 2, 3""")
def fourier_lowpass(spark, sf):
    s = S.fourier_lowpass(patches(spark, sf), "a", "s", _U, 8, 8, 1.5, 1.5, 5.0)
    return s.select("track_id", "iy", "ix", r(F.col("s")).alias("a"))


# --- resampling: every class of the embeddings by itself ---

_B, _SEED = 500, 42
_DRAW = f""", un AS (SELECT variant, track_id, row_number() OVER (PARTITION BY variant ORDER BY track_id) - 1 AS slot, count(*) OVER (PARTITION BY variant) AS n FROM (SELECT DISTINCT variant, track_id FROM patches)),
dw AS (SELECT variant, rep, {R.scattered_sql(_SEED, 'rep', 'slot')} % n AS slot, count(*) AS weight FROM un, range(0, {_B}) x(rep) GROUP BY 1, 2, 3),
dr AS (SELECT variant, rep, track_id, weight FROM dw JOIN un USING (variant, slot))"""
_MM = ", m{v} AS (SELECT variant, iy, ix, rep, sum(weight * {v}) / sum(weight) AS m FROM patches JOIN dr USING (variant, track_id) GROUP BY ALL)"
_BY = ["variant"]
_CELL = ["variant", "iy", "ix"]


def _drawn(spark, sf):
    p = patches(spark, sf)
    return p, written(R.packed_draws(p, "track_id", _B, _BY, _SEED), "draws")


def _interval(b, keys, digits=6):
    return b.select(*keys, *[r(F.col(c), 1, digits).alias(c) for c in ("boot_mean", "lo", "hi")], "sig")


@register("bootstrap_draws", f"WITH {PATCHES}{_DRAW} SELECT variant, rep, track_id, weight FROM dr")
def bootstrap_draws(spark, sf):
    return R.unpacked(_drawn(spark, sf)[1])


_Q = "avg(m) AS bm, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi"
_OUT = "round(bm, 6) + 0.0 AS boot_mean, round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi, lo > 0 OR hi < 0 AS sig"


@register("bootstrap_field", f"WITH {PATCHES}{_DRAW}{_MM.format(v='a')}, q AS (SELECT variant, iy, ix, {_Q} FROM ma GROUP BY 1, 2, 3) SELECT variant, iy, ix, {_OUT} FROM q")
def bootstrap_field(spark, sf):
    p, d = _drawn(spark, sf)
    return _interval(R.bootstrap_field(p, d, "track_id", "a", _CELL), _CELL)


@register("bootstrap_vs_domain", f"WITH {PATCHES}{_DRAW}{_MM.format(v='a')}, v AS (SELECT variant, iy, ix, m - avg(m) OVER (PARTITION BY variant, rep) AS m FROM ma), q AS (SELECT variant, iy, ix, {_Q} FROM v GROUP BY 1, 2, 3) SELECT variant, iy, ix, {_OUT} FROM q")
def bootstrap_vs_domain(spark, sf):
    p, d = _drawn(spark, sf)
    return _interval(R.bootstrap_vs_domain(p, d, "track_id", "a", _CELL, _BY), _CELL)


@register("bootstrap_section", f"WITH {PATCHES}{_DRAW}, s AS (SELECT variant, ix, rep, sum(weight * a) / sum(weight) AS m FROM patches JOIN dr USING (variant, track_id) GROUP BY 1, 2, 3), q AS (SELECT variant, ix, {_Q} FROM s GROUP BY 1, 2) SELECT variant, ix, {_OUT} FROM q")
def bootstrap_section(spark, sf):
    p, d = _drawn(spark, sf)
    return _interval(R.bootstrap_field(p, d, "track_id", "a", ["variant", "ix"]), ["variant", "ix"])


@register("bootstrap_diff", f"WITH {PATCHES}{_DRAW}{_MM.format(v='a')}{_MM.format(v='b')}, df AS (SELECT variant, iy, ix, ma.m - mb.m AS m FROM ma JOIN mb USING (variant, iy, ix, rep)), q AS (SELECT variant, iy, ix, {_Q} FROM df GROUP BY 1, 2, 3) SELECT variant, iy, ix, {_OUT} FROM q")
def bootstrap_diff(spark, sf):
    p, d = _drawn(spark, sf)
    return _interval(R.bootstrap_diff(R.replicate_means(p, d, "track_id", "a", _CELL), R.replicate_means(p, d, "track_id", "b", _CELL), _CELL), _CELL)


@register("bootstrap_coefficients", f"WITH {PATCHES}{_DRAW}{_COEF}, sb AS (SELECT variant, rep, sum(weight * beta) / sum(weight) FILTER (beta IS NOT NULL) AS m FROM pr JOIN dr USING (track_id) GROUP BY 1, 2) SELECT variant, round(avg(m), 5) + 0.0 AS boot_mean, round(quantile_cont(m, {R.alpha_from_sigma(1.5) / 2!r}), 5) + 0.0 AS lo, round(quantile_cont(m, {1 - R.alpha_from_sigma(1.5) / 2!r}), 5) + 0.0 AS hi FROM sb GROUP BY 1")
def bootstrap_coefficients(spark, sf):
    _, d = _drawn(spark, sf)
    p = B.project(B.gram(_basis(spark, sf), ["variant", *_U], ["b"]), ["variant", *_U], ["b"])
    b = R.interval(R.replicate_means(p, d, "track_id", "beta", _BY), _BY, R.alpha_from_sigma(1.5))
    return _interval(b, _BY, 5).drop("sig")


@register("bootstrap_components", f"""WITH {PATCHES}{_DRAW}{_COEF}, t AS (SELECT o6.variant, o6.track_id, iy, ix, beta * p1 AS int, -ax * p2 - ay * p3 AS prop FROM o6 JOIN pr USING (track_id)),
 l AS (SELECT variant, track_id, iy, ix, 'int' AS field, int AS value FROM t UNION ALL SELECT variant, track_id, iy, ix, 'prop', prop FROM t),
 mc AS (SELECT variant, iy, ix, field, rep, sum(weight * value) / sum(weight) FILTER (value IS NOT NULL) AS m FROM l JOIN dr USING (variant, track_id) GROUP BY ALL), q AS (SELECT variant, iy, ix, field, {_Q} FROM mc GROUP BY ALL)
 SELECT variant, iy, ix, field, round(bm, 5) + 0.0 AS boot_mean, round(lo, 5) + 0.0 AS lo, round(hi, 5) + 0.0 AS hi FROM q""")
def bootstrap_components(spark, sf):
    _, d = _drawn(spark, sf)
    cells, unit = _basis(spark, sf), ["variant", *_U]
    g = B.gram(cells, unit, ["b"])
    c = B.components(B.orthogonal_cells(cells, g, unit), B.project(g, unit, ["b"]), unit, "b")
    b = R.bootstrap_components(c, d, "track_id", ["int", "prop"], _CELL)
    return _interval(b, [*_CELL, "field"], 5).drop("sig")


@register("bootstrap_hashed")
def bootstrap_hashed(spark, sf):
    p = patches(spark, sf)
    d = written(R.packed_hash_draws(p, "track_id", _B, _BY, _SEED), "draws")
    return R.bootstrap_field(p, d, "track_id", M.signed_sum(["-a", "b"]), _CELL)


@register("tilt_data", f"WITH {PATCHES}{_DRAW}{_MM.format(v='a')}{_MM.format(v='b')}, qa AS (SELECT variant, iy, ix, {_Q} FROM ma GROUP BY 1, 2, 3), qb AS (SELECT variant, iy, ix, {_Q} FROM mb GROUP BY 1, 2, 3), c AS (SELECT variant, iy, ix, avg(a) AS upper, avg(b) AS lower FROM patches GROUP BY 1, 2, 3) SELECT variant, iy, ix, round(upper, 6) + 0.0 AS upper, round(lower, 6) + 0.0 AS lower, qa.lo > 0 OR qa.hi < 0 AS sig_upper, qb.lo > 0 OR qb.hi < 0 AS sig_lower FROM c JOIN qa USING (variant, iy, ix) JOIN qb USING (variant, iy, ix)")
def tilt_data(spark, sf):
    """Field a stands for the upper level's wind, b for the lower one's."""
    p, d = _drawn(spark, sf)
    levels = F.array(F.struct(F.lit(250).alias("level"), F.col("a").alias("wind")), F.struct(F.lit(850).alias("level"), F.col("b").alias("wind")))
    p = p.select("track_id", *_CELL, F.explode(levels).alias("l")).select("track_id", *_CELL, "l.level", "l.wind")
    t = R.tilt_data(p, d, "track_id", "wind", 250, 850, _CELL)
    return t.select(*_CELL, r(F.col("upper")).alias("upper"), r(F.col("lower")).alias("lower"), "sig_upper", "sig_lower")


@register("explore", f"WITH {PATCHES}{_DRAW}{_MM.format(v='a')}, q AS (SELECT variant, iy, ix, {_Q} FROM ma GROUP BY 1, 2, 3), c AS (SELECT variant, iy, ix, avg(a) AS mean, avg(b) AS contour FROM patches GROUP BY 1, 2, 3) SELECT variant, iy, ix, round(mean, 6) + 0.0 AS mean, round(contour, 6) + 0.0 AS contour, lo > 0 OR hi < 0 AS sig FROM q JOIN c USING (variant, iy, ix)")
def explore(spark, sf):
    """What a composite figure shows: mean, significance and a contour field."""
    p, d = _drawn(spark, sf)
    b = R.bootstrap_field(p, d, "track_id", "a", _CELL).select(*_CELL, "sig")
    c = K.composite_mean(K.build_composites(p, ["a", "b"], _CELL), ["a", "b"])
    return c.join(b, _CELL).select(*_CELL, r(F.col("a")).alias("mean"), r(F.col("b")).alias("contour"), "sig")


# --- isentropic levels ---

_TG = [300.0, 330.0, 380.0, 450.0]
_TS = ", ".join(f"({t})" for t in _TG)
_THETA = f""", th AS (SELECT *, {TH} AS theta FROM grid)"""


def _theta(spark, sf):
    return grid(spark, sf).withColumn("theta", C.theta(F.col("t"), F.col("level")))


@register("to_theta", f"""WITH {GRID}{_THETA}, n AS (SELECT ilat, ilon, theta AS a, lead(theta) OVER w AS b, u AS u0, lead(u) OVER w AS u1 FROM th WHERE theta IS NOT NULL WINDOW w AS (PARTITION BY ilat, ilon ORDER BY theta)),
 h AS (SELECT n.*, tg FROM n, (VALUES {_TS}) t(tg) WHERE tg >= a AND tg <= b), m AS (SELECT ilat, ilon, tg, arg_min({{'a': a, 'b': b, 'u0': u0, 'u1': u1}}, a) AS x FROM h GROUP BY 1, 2, 3)
 SELECT ilat, ilon, CAST(tg AS DOUBLE) AS theta_level, round(x.u0 + (tg - x.a) / (x.b - x.a) * (x.u1 - x.u0), 6) + 0.0 AS u FROM m""")
def to_theta(spark, sf):
    t = I.to_theta(_theta(spark, sf), ["ilat", "ilon"], _TG, ["u"])
    return t.select("ilat", "ilon", "theta_level", r(F.col("u")).alias("u"))


_BR = f"""{_THETA}, n AS (SELECT ilat, ilon, level AS l0, lead(level) OVER w AS l1, theta AS a, lead(theta) OVER w AS b, t AS t0, lead(t) OVER w AS t1 FROM th WINDOW w AS (PARTITION BY ilat, ilon ORDER BY level DESC)),
 h AS (SELECT n.*, CAST(tg AS DOUBLE) AS tg FROM n, (VALUES {_TS}) t(tg) WHERE tg >= least(a, b) AND tg <= greatest(a, b) AND a IS NOT NULL AND b IS NOT NULL),
 m AS (SELECT ilat, ilon, tg, max(l0) AS l0 FROM h GROUP BY 1, 2, 3), br AS (SELECT h.* FROM h JOIN m USING (ilat, ilon, tg, l0))"""


@register("theta_bracket", f"WITH {GRID}{_BR} SELECT ilat, ilon, tg AS theta_level, l0 AS level_lo, l1 AS level_hi FROM br")
def theta_bracket(spark, sf):
    return I.bracket(_theta(spark, sf), ["ilat", "ilon"], _TG).select("ilat", "ilon", "theta_level", "level_lo", "level_hi")


def _newton() -> str:
    a = "((t1 - t0) / (ln(l1) - ln(l0)))"
    out = f"SELECT *, {a} AS sa, t1 - {a} * ln(l1) AS sb, 0.5 * (ln(l0) + ln(l1)) AS x FROM br"
    pok = 1000.0**KAPPA
    for _ in range(12):
        e = f"({pok!r} * exp(-{KAPPA!r} * x))"
        out = f"SELECT * REPLACE (x - (tg - {e} * (sa * x + sb)) / ({e} * ({KAPPA!r} * (sa * x + sb) - sa)) AS x) FROM ({out})"
    return out


@register("theta_pressure", f"WITH {GRID}{_BR} SELECT ilat, ilon, tg AS theta_level, round(exp(x), 4) + 0.0 AS p_theta FROM ({_newton()})")
def theta_pressure(spark, sf):
    return I.theta_pressure(_theta(spark, sf), ["ilat", "ilon"], _TG).select("ilat", "ilon", "theta_level", r(F.col("p_theta"), 1, 4).alias("p_theta"))


def _cross(order: str) -> str:
    return f"""WITH {GRID}, n AS (SELECT ilat, ilon, level, u AS f, lead(u) OVER w AS f1, lead(level) OVER w AS l1, row_number() OVER w AS k FROM grid WINDOW w AS (PARTITION BY ilat, ilon ORDER BY level {order}))
 SELECT ilat, ilon, round(arg_min(level + (25.5 - f) / (f1 - f) * (l1 - level), k), 6) + 0.0 AS p_cross FROM n WHERE (f - 25.5) * (f1 - 25.5) <= 0 AND f <> f1 GROUP BY 1, 2"""


@register("threshold_from_top", _cross("ASC"))
def threshold_from_top(spark, sf):
    return I.threshold_pressure(grid(spark, sf), ["ilat", "ilon"], "u", 25.5).select("ilat", "ilon", r(F.col("p_cross")).alias("p_cross"))


@register("threshold_from_bottom", _cross("DESC"))
def threshold_from_bottom(spark, sf):
    return I.threshold_pressure(grid(spark, sf), ["ilat", "ilon"], "u", 25.5, "from_bottom").select("ilat", "ilon", r(F.col("p_cross")).alias("p_cross"))


# --- overturning on patches: value b over (iy, ix) ---

_OV = f""", pl AS (SELECT track_id, CAST(k AS INT) AS k, mn + (mx - mn) * k / 6.0 AS lev FROM (SELECT track_id, min(b) AS mn, max(b) AS mx FROM patches GROUP BY 1), range(1, 6) x(k)),
nx AS (SELECT track_id, ix, iy, x_rel, y_rel, b AS z0, lead(b) OVER w AS z1, lead(y_rel) OVER w AS y1 FROM patches WINDOW w AS (PARTITION BY track_id, ix ORDER BY iy)),
cr AS (SELECT track_id, k, lev, ix, iy, x_rel AS x, y_rel + (lev - z0) / (z1 - z0) * (y1 - y_rel) AS y FROM nx JOIN pl USING (track_id) WHERE (z0 < lev AND z1 >= lev) OR (z0 >= lev AND z1 < lev)),
iv AS (SELECT *, ix - row_number() OVER (PARTITION BY track_id, k ORDER BY ix) AS run FROM (SELECT track_id, k, ix, count(*) AS n, min(y) AS y_min, max(y) AS y_max, any_value(x) AS x FROM cr GROUP BY 1, 2, 3 HAVING count(*) >= 3))"""


def _crossings(spark, sf):
    p = patches(spark, sf)
    return O.crossings(p, O.probe_levels(p, _U, "b", 5), _U, "b", "x_rel", "y_rel")


@register("contour_crossings", f"WITH {PATCHES}{_OV} SELECT track_id, k, ix, iy, round(y, 5) + 0.0 AS y FROM cr")
def contour_crossings(spark, sf):
    return _crossings(spark, sf).select("track_id", "k", "ix", "iy", r(F.col("y"), 1, 5).alias("y"))


@register("overturn_intervals", f"WITH {PATCHES}{_OV} SELECT track_id, k, ix, n, run, round(y_min, 5) + 0.0 AS y_min, round(y_max, 5) + 0.0 AS y_max FROM iv")
def overturn_intervals(spark, sf):
    i = O.overturn_intervals(_crossings(spark, sf), _U)
    return i.select("track_id", "k", "ix", "n", F.col("run").cast("long").alias("run"), r(F.col("y_min"), 1, 5).alias("y_min"), r(F.col("y_max"), 1, 5).alias("y_max"))


_BAY = f"""{_OV}, vx AS (SELECT track_id, k, run, x, y_min AS y, x AS o, 0 AS side FROM iv UNION ALL SELECT track_id, k, run, x, y_max, -x, 1 FROM iv),
sh AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM vx WINDOW w AS (PARTITION BY track_id, k, run ORDER BY side, o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
ar AS (SELECT track_id, k, run, count(*) // 2 AS columns, min(x) AS xa, max(x) AS xb, sum(x * y1 - x1 * y) / 2 AS area, sum((x + x1) * (x * y1 - x1 * y)) AS mx, sum((y + y1) * (x * y1 - x1 * y)) AS my FROM sh GROUP BY 1, 2, 3),
by0 AS (SELECT ar.*, slope FROM ar JOIN (SELECT track_id, k, run, CASE WHEN count(*) >= 3 THEN regr_slope((y_min + y_max) / 2, x) END AS slope FROM iv GROUP BY 1, 2, 3) USING (track_id, k, run) WHERE columns >= 2)"""


@register("overturn_bays", f"WITH {PATCHES}{_BAY} SELECT track_id, k, run, columns, xa, xb, round(area, 4) + 0.0 AS area, round(CASE WHEN abs(area) > 1e-9 THEN mx / (6 * area) END, 3) + 0.0 AS cx, round(slope, 4) + 0.0 AS slope, CASE WHEN slope < -0.15 THEN 'AWB' WHEN slope > 0.15 THEN 'CWB' ELSE 'UNK' END AS tilt FROM by0")
def overturn_bays(spark, sf):
    b = O.bays(O.overturn_intervals(_crossings(spark, sf), _U), _U)
    return b.select("track_id", "k", F.col("run").cast("long").alias("run"), "columns", "xa", "xb", r(F.col("area"), 1, 4).alias("area"), r(F.col("cx"), 1, 3).alias("cx"), r(F.col("slope"), 1, 4).alias("slope"), O.classify_tilt(F.col("slope")).alias("tilt"))


_TYPE = f"""{_BAY}, s1 AS (SELECT track_id, k, ix, any_value(x) AS x, any_value(y) AS y FROM cr GROUP BY 1, 2, 3 HAVING count(*) = 1),
we AS (SELECT b.track_id, b.k, b.run, arg_max(s.y, s.x) AS yw FROM by0 b JOIN s1 s ON s.track_id = b.track_id AND s.k = b.k AND s.x < b.xa GROUP BY 1, 2, 3),
fc AS (SELECT track_id, k, run, arg_min(y_min, x) AS y_min, arg_min(y_max, x) AS y_max FROM iv GROUP BY 1, 2, 3),
ty AS (SELECT by0.*, CASE WHEN yw IS NULL OR abs(yw - y_max) = abs(yw - y_min) THEN 'UNK' WHEN abs(yw - y_max) < abs(yw - y_min) THEN 'CWB' ELSE 'AWB' END AS wb FROM by0 JOIN fc USING (track_id, k, run) LEFT JOIN we USING (track_id, k, run)),
fl AS (SELECT track_id, coalesce(bool_or(t = 'AWB'), false) AS awb, coalesce(bool_or(t = 'CWB'), false) AS cwb FROM (SELECT track_id, CASE WHEN wb <> 'UNK' THEN wb WHEN slope < 0 THEN 'AWB' WHEN slope > 0 THEN 'CWB' END AS t FROM ty WHERE abs(area) > 0.0) GROUP BY 1),
lb AS (SELECT track_id, coalesce(awb, false) AS awb, coalesce(cwb, false) AS cwb FROM (SELECT DISTINCT track_id FROM patches) LEFT JOIN fl USING (track_id))"""


@register("bay_types", f"WITH {PATCHES}{_TYPE} SELECT track_id, k, run, wb AS wb_type FROM ty")
def bay_types(spark, sf):
    c = _crossings(spark, sf)
    b = O.classify_bay(O.bays(O.overturn_intervals(c, _U), _U), c, _U)
    return b.select("track_id", "k", F.col("run").cast("long").alias("run"), "wb_type")


@register("detect_bays", f"""WITH {PATCHES}{_TYPE}, tl AS (SELECT track_id, k, run, CASE WHEN slope < -0.15 THEN 'AWB' WHEN slope > 0.15 THEN 'CWB' ELSE 'UNK' END AS tilt FROM ty) SELECT track_id, k, run, ty.wb AS bay, tilt FROM ty JOIN tl USING (track_id, k, run)""")
def detect_bays(spark, sf):
    """The whole detection on patches by both methods."""
    p, n = patches(spark, sf), 5
    a = O.detect_bays(p, _U, "b", "x_rel", "y_rel", "bay", n_levels=n).select("track_id", "k", "run", F.col("wb_type").alias("bay"))
    b = O.detect_bays(p, _U, "b", "x_rel", "y_rel", "tilt", n_levels=n).select("track_id", "k", "run", F.col("wb_type").alias("tilt"))
    return a.join(b, ["track_id", "k", "run"]).select("track_id", "k", F.col("run").cast("long").alias("run"), "bay", "tilt")


@register("classify_events", f"WITH {PATCHES}{_TYPE} SELECT track_id, CASE WHEN awb AND cwb THEN 'Omega' WHEN awb THEN 'AWB' WHEN cwb THEN 'CWB' ELSE 'NEUTRAL' END AS label FROM lb")
def classify_events(spark, sf):
    p = patches(spark, sf).withColumn("level", F.lit(300))
    return O.classify_events(p, _U, "b", "x_rel", "y_rel", 5).select("track_id", "label")


@register("variant_members", f"WITH {PATCHES}{_TYPE} SELECT variant, count(*) AS n FROM (SELECT 'ALL' AS variant FROM lb UNION ALL SELECT 'AWB' FROM lb WHERE awb UNION ALL SELECT 'CWB' FROM lb WHERE cwb UNION ALL SELECT 'Omega' FROM lb WHERE awb AND cwb UNION ALL SELECT 'NEUTRAL' FROM lb WHERE NOT awb AND NOT cwb) GROUP BY 1")
def variant_members(spark, sf):
    p = patches(spark, sf).withColumn("level", F.lit(300))
    return O.variant_members(O.classify_events(p, _U, "b", "x_rel", "y_rel", 5), _U).groupBy("variant").agg(F.count("*").alias("n"))


@register("circumpolar_levels", f"""WITH {GRID}, pl AS (SELECT level, CAST(k AS INT) AS k, mn + (mx - mn) * k / 6.0 AS lev FROM (SELECT level, min(z) AS mn, max(z) AS mx FROM grid GROUP BY 1), range(1, 6) x(k)),
 nx AS (SELECT level, ilon, lat, lon, z AS z0, lead(z) OVER w AS z1, lead(lat) OVER w AS y1 FROM grid WINDOW w AS (PARTITION BY level, ilon ORDER BY ilat)),
 cr AS (SELECT level, k, ilon, lon AS x, lat + (lev - z0) / (z1 - z0) * (y1 - lat) AS y FROM nx JOIN pl USING (level) WHERE (z0 < lev AND z1 >= lev) OR (z0 >= lev AND z1 < lev))
 SELECT level, k, max(x) - min(x) AS span, round(min(y), 4) + 0.0 AS south, count(DISTINCT ilon) AS columns, max(x) - min(x) >= 345 AND min(y) >= 0 AS around FROM cr GROUP BY 1, 2""")
def circumpolar_levels(spark, sf):
    g = grid(spark, sf).select("level", F.col("ilat").alias("iy"), F.col("ilon").alias("ix"), "lat", "lon", "z")
    c = O.crossings(g, O.probe_levels(g, ["level"], "z", 5), ["level"], "z", "lon", "lat")
    return O.circumpolar(c, ["level"], 345.0).select("level", "k", "span", r(F.col("south"), 1, 4).alias("south"), "columns", "around")


@register("cropped_contours", f"""WITH {PATCHES}{_OV}, ins AS (SELECT * FROM cr WHERE abs(x) <= 4 AND abs(y) <= 4), co AS (SELECT DISTINCT track_id, k, ix FROM ins), ru AS (SELECT *, ix - row_number() OVER (PARTITION BY track_id, k ORDER BY ix) AS run FROM co),
 rn AS (SELECT *, count(*) OVER (PARTITION BY track_id, k, run) AS n FROM ru), be AS (SELECT track_id, k, arg_max(run, (n, -run)) AS run FROM rn GROUP BY 1, 2), ke AS (SELECT rn.track_id, rn.k, rn.ix FROM rn JOIN be USING (track_id, k, run))
 SELECT track_id, k, count(*) AS n FROM ins SEMI JOIN ke USING (track_id, k, ix) GROUP BY 1, 2 HAVING count(*) >= 10""")
def cropped_contours(spark, sf):
    return O.crop_to_patch(_crossings(spark, sf), _U, 4.0, 4.0).groupBy("track_id", "k").agg(F.count("*").alias("n"))
