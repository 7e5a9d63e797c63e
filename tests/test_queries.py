"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from fieldspark import plans  # noqa: F401
from fieldspark.operators import patches as P
from fieldspark.plans import io_queries, registry

SF, DENSE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables here")


def _rows(df):
    cols = sorted(df.columns)

    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>", "nan"):
            return "null"
        try:
            return f"{float(v) + 0.0:.5f}"
        except (TypeError, ValueError):
            return str(v)

    return cols, sorted(tuple(one(v) for v in row) for row in df[cols].itertuples(index=False))


def _close(a, b):
    if a == b:
        return True
    try:
        return abs(float(a) - float(b)) <= 2e-4 + 1e-6 * abs(float(b))
    except ValueError:
        return False


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns) > 0
        return
    cols, rows = _rows(got)
    want_cols, want = _rows(con.execute(sql).df())
    assert cols == want_cols
    assert len(rows) == len(want)
    bad = [(a, b) for a, b in zip(rows, want) if not all(map(_close, a, b))]
    assert not bad, bad[:3]


@pytest.fixture(scope="module")
def world(spark):
    (g, climate), (e, t) = io_queries._world(spark, SF), io_queries._moving(spark, SF)
    return e, t, io_queries.jobs.compute(e, t, g, climate, [0, 1], io_queries._SPEC)


def test_jobs_take_all_tracks(spark, con, world):
    """Every track is decomposed at both hours, with split winds and at the place that it has then."""
    e, t, p = world
    ids = {x for (x,) in con.execute("SELECT DISTINCT user_id FROM events").fetchall()}
    assert {"u_rot", "v_rot", "u_div", "v_div", "u_rot_anom_pv_bar_dx", "v_div_adiabatic_pv_anom_dy", "w_diabatic_pv_bar_dp"} <= set(p.columns)
    at = {(r["track_id"], r["dh"]): (r["lat_c"], r["lon_c"]) for r in P.lagrangian_centre(P.expand_hours(e, [0, 1]), t).collect()}
    assert set(at) == {(i, dh) for i in ids for dh in (0, 1)}
    hours = "SELECT user_id, date_trunc('hour', ts) AS h, 30 + avg(value) / 10 AS lat, avg(event_id % 360) - 180.0 AS lon FROM events GROUP BY 1, 2"
    want = con.execute(f"SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY h) - 1 AS n, lat, lon FROM ({hours}) QUALIFY n < 2").fetchall()
    assert all(at[i, n] == pytest.approx((lat, lon)) for i, n, lat, lon in want)
    assert any(at[i, 0] != at[i, 1] for i in ids)


def _coefficients(q, fields, y):
    """Six coefficients of each field on the orthogonal patterns of q, a 5 x 7 patch, in plain numpy."""
    dy, dx = math.radians(6) * 6.371e6, math.radians(15) * 6.371e6 * math.cos(math.radians(45))
    ddx, ddy = lambda a: np.gradient(a, dx, axis=1), lambda a: np.gradient(a, dy, axis=0)
    x, yy = ddx(q), ddy(q)
    basis = [q, x, yy, ddy(x), ddx(x) - ddy(yy), ddx(x) + ddy(yy)]
    basis = [b / np.percentile(np.abs(b)[b != 0], 95) for b in basis]
    w = np.cos(np.radians(y + 45.0))[:, None] * np.ones_like(q)
    out, ortho = [], []
    for b in basis:
        for o in ortho:
            b = b - (w * b * o).sum() / (w * o * o).sum() * o
        ortho.append(b)
    for f in fields:
        out.append([s * (w * f * o).sum() / (w * o * o).sum() for s, o in zip((1, -1, -1, -1, -1, 1), ortho)])
    return out


def _smooth(a, sigma):
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    for axis in (1, 0):
        wide = np.pad(a, [(r, r) if x == axis else (0, 0) for x in (0, 1)], mode="symmetric")
        a = np.apply_along_axis(lambda v: np.convolve(v, k / k.sum(), "valid"), axis, wide)
    return a


def _blob(mask, y, x):
    """The 4-connected part of the mask that holds its cell nearest to the centre."""
    at = min(zip(*np.nonzero(mask)), key=lambda c: (y[c[0]] ** 2 + x[c[1]] ** 2, c), default=None)
    found, todo = np.zeros_like(mask), [at] if at else []
    while todo:
        j, i = todo.pop()
        if 0 <= j < mask.shape[0] and 0 <= i < mask.shape[1] and mask[j, i] and not found[j, i]:
            found[j, i] = True
            todo += [(j + 1, i), (j - 1, i), (j, i + 1), (j, i - 1)]
    return found


def _whole_chain(q, before, fields, lat):
    """Blend, six fields, their scales, smoothing, central blob, weights and coefficients (physical), in plain numpy."""
    q = 0.7 * q + 0.3 * before
    y, x = np.arange(-2, 3) * 6.0, np.arange(-3, 4) * 15.0
    dy, dx = math.radians(6) * 6.371e6, math.radians(15) * 6.371e6 * math.cos(math.radians(lat))
    ddx, ddy = lambda a: np.gradient(a, dx, axis=1), lambda a: np.gradient(a, dy, axis=0)
    qx, qy = ddx(q), ddy(q)
    basis = [q, qx, qy, ddy(qx), ddx(qx) - ddy(qy), ddx(qx) + ddy(qy)]
    scale = [1 / np.percentile(np.abs(b)[b != 0], 95) for b in basis]
    basis = [_smooth(b * s, 8.0 / 2.355 / 6.0) for b, s in zip(basis, scale)]
    w = np.cos(np.radians(y + lat))[:, None] * _blob(basis[0] < 0.5, y, x)
    ortho = []
    for b in basis:
        for o in ortho:
            b = b - (w * b * o).sum() / (w * o * o).sum() * o
        ortho.append(b)
    return [[k * s * (w * f * o).sum() / (w * o * o).sum() for k, s, o in zip((1, -1, -1, -1, -1, 1), scale, ortho)] for f in fields]


def test_job_decompose_by_brute_force(spark):
    """All whole patches of all tracks against plain numpy; these tables are large enough to have patches without gaps."""
    terms = list(io_queries._TERMS)
    got = registry.queries()["job_decompose"](spark, DENSE).toPandas()
    ids = set(pd.read_parquet(f"{DENSE}/events.parquet").user_id)
    assert set(zip(got.track_id, got.dh)) == {(i, dh) for i in ids for dh in (0, 1)}
    assert np.allclose(got.sigma_km2.astype(float) * 1e6, got.sigma.astype(float), equal_nan=True)
    got = got.set_index(["track_id", "dh", "term"])
    grids = {}
    for key, c in io_queries._decomposed_patches(spark, DENSE).toPandas().groupby(["track_id", "dh"]):
        if len(c) == 35 and not c.isna().any().any():
            c = c.sort_values(["iy", "ix"])
            grids[key] = [c[n].to_numpy().reshape(5, 7) for n in ("pv_anom", *terms)] + [c.lat_c.iloc[0]]
    whole = 0
    for (track, dh), (q, *fields, lat) in grids.items():
        if dh == 1 and (track, 0) not in grids:
            continue
        for term, want in zip(terms, _whole_chain(q, grids[track, 0][0], fields, lat)):
            have = got.loc[(track, dh, term), ["beta", "ax", "ay", "gamma1", "gamma2", "sigma"]].astype(float).tolist()
            if np.isfinite(have).all() and np.isfinite(want).all():
                whole += 1
                assert have == pytest.approx(want, rel=1e-4)
    assert whole > 10


def test_job_composite_by_brute_force(spark, world):
    """Composites of the classified patches are the means over each class's members."""
    p = world[2].filter("level IS NOT NULL AND dh = 0")
    labels = io_queries.jobs.classify(p, [240, 390, 560], 1).toPandas()
    cells = p.select("stage", "track_id", "dh", "level", "iy", "ix", "pv").toPandas()
    kinds = {"AWB": labels.awb, "CWB": labels.cwb, "Omega": labels.awb & labels.cwb, "NEUTRAL": ~labels.awb & ~labels.cwb, "original": labels.awb | True}
    want = {}
    for variant, member in kinds.items():
        some = cells[cells.track_id.isin(labels.track_id[member])]
        for key, mean in some.groupby(["level", "iy", "ix"]).pv.mean().items():
            want[variant, *key] = mean
    got = registry.queries()["job_classify_composite"](spark, SF).toPandas()
    assert len(got) == len(want)
    for r in got.itertuples():
        assert np.nan_to_num(r.pv) == pytest.approx(np.nan_to_num(want[r.variant, r.level, r.iy, r.ix]))


def test_isentropic_projection_by_brute_force(spark):
    """Every whole patch on every whole surface against plain numpy."""
    cells = io_queries._on_theta(spark, DENSE).toPandas()
    got = registry.queries()["isentropic_projection"](spark, DENSE).toPandas().set_index(["track_id", "theta_level"])
    whole = 0
    for level, c in cells.groupby("theta_level"):
        mean = c.groupby(["iy", "ix"]).value.mean()
        if len(mean) != 35 or mean.isna().any():
            continue
        q = mean.sort_index().to_numpy().reshape(5, 7)
        for track, one in c.groupby("track_id"):
            if len(one) != 35 or one.value.isna().any():
                continue
            whole += 1
            (want,) = _coefficients(q, [one.sort_values(["iy", "ix"]).value.to_numpy().reshape(5, 7)], np.arange(-2, 3) * 6.0)
            have = got.loc[(track, level), ["beta", "ax", "ay", "gamma1", "gamma2", "sigma"]].astype(float).tolist()
            assert have == pytest.approx(want, rel=1e-5, abs=1e-7 * max(map(abs, want)))
    assert whole > 5
