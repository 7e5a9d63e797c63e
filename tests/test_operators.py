"""Analytic identities on small synthetic cells."""

import math
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import columns as C
from fieldspark.operators import basis as B
from fieldspark.operators import composite as K
from fieldspark.operators import invert
from fieldspark.operators import overturn as O
from fieldspark.operators import patches as P
from fieldspark.operators import resample as R
from fieldspark.operators import stencil as S
from fieldspark.operators import terms as M
from fieldspark.sources import tables
from fieldspark.streaming import incremental


def cells(spark, nlat=13, nlon=24, lat0=10.0, dlat=5.0):
    g = spark.range(nlat * nlon).select(F.lit(1).alias("level"), F.floor(F.col("id") / nlon).cast("int").alias("ilat"), (F.col("id") % nlon).cast("int").alias("ilon"))
    return g.withColumn("lat", lat0 + dlat * F.col("ilat")).withColumn("lon", F.col("ilon") * 360.0 / nlon)


def test_constant_has_no_derivative(spark):
    g = cells(spark).withColumn("c", F.lit(42.0))
    out = g.select(F.abs(S.ddx(F.col("c"), ["level"], 15.0)).alias("x"), F.abs(S.ddy(F.col("c"), ["level"], 5.0)).alias("y")).agg(F.max("x"), F.max("y")).first()
    assert out[0] == 0 and out[1] == 0


def test_linear_in_latitude(spark):
    g = cells(spark).withColumn("c", F.col("lat"))
    want = 5.0 / (math.radians(5.0) * 6.371e6)
    lo, hi = g.select(S.ddy(F.col("c"), ["level"], 5.0).alias("y")).agg(F.min("y"), F.max("y")).first()
    assert lo == pytest.approx(want) and hi == pytest.approx(want)


@pytest.mark.parametrize("bc", ["dirichlet", "neumann"])
def test_laplacian_of_inverse(spark, bc):
    g = cells(spark).withColumn("f", F.sin(F.radians(3 * F.col("lat"))) * F.cos(F.radians(4 * F.col("lon"))) * 1e-10)
    sphere = invert.Sphere(10.0, 5.0, 13, 24, bc)
    x = invert.poisson(invert.remove_area_mean(g, "f", ["level"]), "f", "x", ["level"], sphere)
    back = S.with_laplacian(x, "x", "b", ["level"], 5.0, 15.0).filter("ilat > 0 AND ilat < 12")
    worst = back.agg(F.max(F.abs(F.col("b") - F.col("f")))).first()[0]
    assert worst < 1e-21


def test_wind_parts_add_up(spark):
    g = cells(spark).withColumn("u", F.sin(F.radians(2 * F.col("lat")))).withColumn("v", 0.5 * F.cos(F.radians(3 * F.col("lat"))))
    g = g.withColumn("u", F.when(F.col("ilon") != 3, F.col("u")))
    h = invert.helmholtz(g, ["level"], invert.Sphere(10.0, 5.0, 13, 24))
    worst, gaps = h.agg(F.max(F.abs(F.col("u_rot") + F.col("u_div") + F.col("u_har") - F.col("u"))), F.count_if(F.col("psi").isNull())).first()
    assert worst < 1e-12 and gaps == 13


def patch(spark, ny=21, nx=31):
    p = spark.range(ny * nx).select(F.lit(1).alias("unit"), F.floor(F.col("id") / nx).cast("int").alias("iy"), (F.col("id") % nx).cast("int").alias("ix"))
    return p.withColumn("y_rel", (F.col("iy") - ny // 2) * 1.5).withColumn("x_rel", (F.col("ix") - nx // 2) * 1.5)


def test_projection_recovers_coefficients(spark):
    p = patch(spark).withColumn("q", -F.exp(-(F.col("x_rel") ** 2 + 2 * F.col("y_rel") ** 2) / 100) * (1 + 0.02 * F.col("x_rel")))
    c = B.raw_basis(p, ["unit"], "q", 1.5, 1.5)
    c = c.withColumn("f", 3.0 * F.col("phi1") - 2.0e5 * F.col("phi2") + 1.0e5 * F.col("phi3"))
    c = B.basis_weights(B.basis_mask(B.prenorm(c, ["unit"]), "< -1e-4", "q"))
    g = B.gram(c, ["unit"], ["f"])
    raw = B.project(g, ["unit"], ["f"])
    parts = B.components(B.orthogonal_cells(c, g, ["unit"]), raw, ["unit"], "f")
    assert parts.agg(F.max(F.abs("resid"))).first()[0] < 1e-9


def test_degenerate_basis_gives_null(spark):
    c = patch(spark)
    for k in range(1, 7):
        c = c.withColumn(f"phi{k}", F.col("x_rel") * 0.0)
    c = c.withColumn("f", F.col("x_rel")).withColumn("w", F.lit(1.0))
    assert B.project(B.gram(c, ["unit"], ["f"]), ["unit"], ["f"]).first()["beta"] is None


def test_blob_leaves_diagonals_out(spark):
    on = {(10, 15), (10, 16), (11, 16), (12, 17), (2, 2), (2, 3)}
    p = patch(spark).join(spark.createDataFrame(sorted(on), "iy int, ix int").withColumn("m", F.lit(True)), ["iy", "ix"], "left").fillna({"m": False})
    got = {(r["iy"], r["ix"]) for r in B.central_blob(p, ["unit"], "m").filter("blob").collect()}
    assert got == {(10, 15), (10, 16), (11, 16)}


def test_fold_is_found_and_classed(spark):
    # z rises with y but for a fold that leans with x
    lean = spark.range(2).select((F.col("id") * 2 - 1).cast("double").alias("s"))
    p = patch(spark).crossJoin(lean).withColumn("unit", F.col("s"))
    arg = F.col("y_rel") - F.col("s") * 0.6 * F.col("x_rel")
    p = p.withColumn("z", F.col("y_rel") - 6.0 * F.sin(arg / 2.0) * F.exp(-(F.col("x_rel") ** 2 + F.col("y_rel") ** 2) / 60))
    cr = O.crossings(p, O.probe_levels(p, ["unit"], "z", 7), ["unit"], "z", "x_rel", "y_rel")
    b = O.bays(O.overturn_intervals(cr, ["unit"]), ["unit"], 3)
    assert b.count() > 0
    assert b.agg(F.min(F.abs("area"))).first()[0] > 0
    typed = O.classify_bay(b, cr, ["unit"])
    assert typed.count() == b.count()


def test_no_fold_is_neutral(spark):
    p = patch(spark).withColumn("level", F.lit(300)).withColumn("z", F.col("y_rel"))
    assert O.classify_events(p, ["unit"], "z", "x_rel", "y_rel").first()["label"] == "NEUTRAL"


def test_composites_skip_gaps_and_merge(spark):
    df = spark.createDataFrame([(0, 1.0), (0, None), (1, None), (1, None), (0, 4.0)], "i int, v double")
    whole = K.build_composites(df, ["v"], ["i"])
    half = K.merge_composites(K.build_composites(df.filter("v > 2"), ["v"], ["i"]), K.build_composites(df.filter("v IS NULL OR v <= 2"), ["v"], ["i"]))
    want = {(0, 5.0, 2), (1, None, 0)}
    assert {tuple(r) for r in whole.collect()} == want == {tuple(r) for r in half.select("i", "sum_v", "n_v").collect()}
    assert {r["i"]: r["v"] for r in K.composite_mean(whole, ["v"]).collect()} == {0: 2.5, 1: None}


def test_catalogue_has_52_products():
    names = [n for n, *_ in M.catalogue()]
    assert len(names) == len(set(names)) == 52


def test_hour_ranges():
    assert len(C.dh_range("-49:25:1")) == 74 and list(C.dh_range("0:10:2")) == [0, 2, 4, 6, 8]
    for bad in ("5", "1:2:3:4"):
        with pytest.raises(ValueError):
            C.dh_range(bad)


@pytest.mark.parametrize("alpha", [-0.1, 1.5])
def test_blend_rejects(spark, alpha):
    with pytest.raises(ValueError):
        C.blend(F.lit(1.0), F.lit(2.0), alpha)


def test_vortex_grows_by_beta(spark):
    v = tables.synthetic_vortex(spark, gamma=0.0, ax=0.0, ay=0.0)
    a, b = (v.filter(f"t = {t}").agg(F.min("q")).first()[0] for t in (0, 1))
    assert b / a == pytest.approx(1 + 2e-6 * 3600)
    assert v.count() == 2 * 101 * 121


def test_exclude_list(spark, tmp_path):
    (tmp_path / "x.csv").write_text("track_id,reason\n10,a\n20,b\n")
    assert {r[0] for r in tables.read_exclude(spark, f"file://{tmp_path}/x.csv").collect()} == {10, 20}
    assert tables.read_exclude(spark, f"file://{tmp_path}/none.csv").count() == 0


def test_bootstrap_draws_with_replacement(spark):
    """As many draws as units, each unit about e^-1 of the time not drawn, and means that spread as they should."""
    n, reps = 60, 400
    units = spark.range(2 * n).select(F.col("id").alias("u"), (F.col("id") % 2).alias("g")).filter("g = 0 OR u < 61")
    for draw in (R.draws, R.hash_draws):
        rows = draw(units, "u", reps, ["g"]).collect()
        per = {}
        for r in rows:
            per.setdefault((r["g"], r["rep"]), {})[r["u"]] = r["weight"]
        assert len(per) == 2 * reps and all(sum(v.values()) == (n if g == 0 else 30) for (g, _), v in per.items())
        assert sum(len(v) for (g, _), v in per.items() if g == 0) / (reps * n) == pytest.approx(1 - (1 - 1 / n) ** n, abs=0.01)
        means = [sum(u * w for u, w in v.items()) / n for (g, _), v in per.items() if g == 0]
        centre = sum(means) / reps
        spread = sum((m - centre) ** 2 for m in means) / reps
        # the variance of a mean of n draws from 0, 2, ..., 2 (n - 1)
        assert centre == pytest.approx(n - 1, abs=1.5) and spread == pytest.approx(4 * (n * n - 1) / 12 / n, rel=0.2)


def test_ranks_hold_for_many_partitions(spark):
    units = spark.range(1000).select(F.col("id").alias("u"), (F.col("id") % 3).alias("g"))
    got = R._ranked(units, "u", ["g"]).collect()
    assert {(r["g"], r["u"], r["slot"]) for r in got} == {(i % 3, i, i // 3) for i in range(1000)}


def test_replicate_means_against_numpy(spark):
    """Gaps, a key of text, units of two groups, many batches of few units."""
    rng = np.random.default_rng(4)
    rows = [(u, u % 2, c, None if rng.random() < 0.2 else float(rng.normal())) for u in range(70) for c in "abc" if rng.random() < 0.9]
    cells = spark.createDataFrame(rows + [(0, 0, "gap", None)], "u long, g long, c string, v double").repartition(5)
    drawn = R.draws(cells, "u", 30, ["g"])
    weight = {(r["g"], r["rep"], r["u"]): r["weight"] for r in drawn.collect()}
    got = {(r["g"], r["c"], r["rep"]): r["m"] for r in R.replicate_means(cells, drawn, "u", "v", ["g", "c"]).collect()}
    for (g, c, rep), m in got.items():
        some = [(weight.get((g, rep, u), 0), v) for u, h, d, v in rows if h == g and d == c and v is not None]
        total = sum(w for w, _ in some)
        assert m == (pytest.approx(sum(w * v for w, v in some) / total) if total else None)
    assert len(got) == 30 * (2 * 3 + 1)


def test_tendency_asks_for_the_hour_itself(spark):
    rows = [(1, "2020-01-01 00:00:00", 1.0), (1, "2020-01-01 01:00:00", 3.0), (1, "2020-01-01 05:00:00", 9.0), (1, "2020-01-01 06:00:00", None), (1, "2020-01-01 07:00:00", 11.0)]
    df = spark.createDataFrame(rows, "k int, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    got = [r["d"] for r in df.select("ts", S.ddt(F.col("v"), ["k"]).alias("d")).orderBy("ts").collect()]
    assert got == [2 / 3600, 2 / 3600, None, 2 / 7200, None]


def test_stream_remembers_patches_not_cells(spark, tmp_path):
    """Parts and repeats of patches over four arrivals: one state row a patch, at most two versions of a partition."""
    src, state, check = (f"file://{tmp_path}/{n}" for n in ("src", "state", "check"))
    rows = [(t, t % 2, y, x, float(t + y * x)) for t in range(12) for y in range(4) for x in range(3)]
    p = spark.createDataFrame(rows, "track_id long, variant int, iy int, ix int, a double")
    for part in (p.filter("variant = 0 AND iy < 2"), p.filter("variant = 0"), p.filter("track_id < 4"), p):
        part.write.mode("append").parquet(src)
        q = incremental.stream_composites(spark, src, p.schema, state, ["a"], ["variant", "iy", "ix"], ["variant"], ["track_id"], {"iy": (0, 4), "ix": (0, 3)}, check)
    assert sum(x["stateOperators"][0]["numRowsTotal"] for x in [q.lastProgress]) == 12
    want = {(v, y, x): (sum(float(t + y * x) for t in range(12) if t % 2 == v), 6) for v in (0, 1) for y in range(4) for x in range(3)}
    got = incremental.current_composite(spark, state, ["variant"])
    assert {(r["variant"], r["iy"], r["ix"]): (r["sum_a"], r["n_a"]) for r in got.collect()} == want
    # the untouched partition kept its version; a batch that runs again writes the same
    before = sorted(map(tuple, spark.read.parquet(state).select("variant", "version").distinct().collect()))
    assert before == [(0, 0), (0, 1), (1, 2), (1, 3)]
    incremental.add_to_composite(state, K.build_composites(p.filter("variant = 1 AND track_id >= 4"), ["a"], ["variant", "iy", "ix"]), ["variant", "iy", "ix"], ["variant"], 3)
    assert {(r["variant"], r["iy"], r["ix"]): (r["sum_a"], r["n_a"]) for r in incremental.current_composite(spark, state, ["variant"]).collect()} == want


def test_match_track_makes_no_rows_of_pairs(spark, monkeypatch):
    """Ties, gaps, the date line, the pole and blocks of events against all pairs; no join by which they would become rows."""
    monkeypatch.setattr(P, "EVENTS", 7)
    monkeypatch.setattr(P, "DISTANCES", 50)
    rng = np.random.default_rng(8)
    hour = lambda h: datetime(2010, 1, 1, h)
    tracks = [(i, hour(i % 3), float(rng.integers(-90, 91)), float(rng.integers(-200, 400))) for i in range(200)] + [(900, hour(0), None, 1.0), (901, hour(4), None, 1.0), (902, hour(5), float("nan"), 1.0)]
    events = [("x", i, hour(i % 6), float(rng.choice([-90, 0, 40, 90])), float(rng.integers(-180, 720))) for i in range(120)] + [("y", 0, hour(0), None, 3.0)]
    e = spark.createDataFrame(events + events[:5], "stage string, track_id long, base_ts timestamp, lat0 double, lon0 double")
    t = spark.createDataFrame(tracks, "track_id long, ts timestamp, lat double, lon double")
    m = P.match_track(e, t)
    want = {}
    for s, i, ts, lat0, lon0 in events:
        near = []
        for k, at, lat, lon in tracks:
            if at == ts:
                missing = lat is None or lat0 is None
                d = None if missing else math.sqrt((lat - lat0) ** 2 + (((lon - lon0 + 180) % 360 - 180) * math.cos(math.radians(lat0))) ** 2)
                near.append((missing, d is not None and np.isnan(d), 0.0 if missing or np.isnan(d) else d, k, d))
        if near:
            want[s, i] = min(near)[3:]
    got = {(r["stage"], r["track_id"]): (r["match_id"], r["dist"]) for r in m.collect()}
    assert len(got) == m.count() == len(want)
    for key, (k, d) in want.items():
        assert got[key][0] == k and (got[key][1] is None if d is None else got[key][1] == pytest.approx(d, abs=1e-9, nan_ok=True)), key
    plan = m._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan and "CoGroup" in plan


def test_patches_are_dealt_before_they_get_fields(spark):
    """The places of windows move between tasks; the cells with all fields do not."""
    field = spark.range(24 * 5).select((F.col("id") % 5).cast("int").alias("ilat"), F.floor(F.col("id") / 5).cast("int").alias("ilon"), F.col("id").alias("x"))
    centres = spark.createDataFrame([(1, 2, 23), (2, 0, 4)], "track_id int, jc int, ic int")
    cut = lambda **kw: P.extract_patches(centres, F.broadcast(field), 1, 1, 5, 24, [], **kw)
    dealt = cut(dealt=lambda w: w.repartition(3, "track_id").sortWithinPartitions("track_id"))
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.index("BroadcastHashJoin") < plan.index("Exchange hashpartitioning")
    assert sorted(map(str, dealt.collect())) == sorted(map(str, cut().collect())) and dealt.count() == 18


def test_draws_are_packed_by_unit(spark):
    """A row a unit instead of a row for each replicate that drew it; both forms give the same means."""
    units = spark.range(90).select(F.col("id").alias("u"), (F.col("id") % 2).alias("g"), F.sin(F.col("id")).alias("v")).repartition(3)
    for packed, long in ((R.packed_draws, R.draws), (R.packed_hash_draws, R.hash_draws)):
        rows = packed(units, "u", 40, ["g"]).collect()
        assert len(rows) <= 90 and sum(len(r["reps"]) for r in rows) == 90 * 40
        drawn = long(units, "u", 40, ["g"]).collect()
        assert sorted((r["u"], rep) for r in rows for rep in r["reps"]) == sorted((r["u"], r["rep"]) for r in drawn for _ in range(r["weight"]))
        means = lambda d: {(r["g"], r["rep"]): round(r["m"], 12) for r in R.replicate_means(units, d, "u", "v", ["g"]).collect()}
        assert means(packed(units, "u", 40, ["g"])) == means(long(units, "u", 40, ["g"]))


def test_draws_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK_DRAWS", 200)
    monkeypatch.setattr(R, "BATCH_DRAWS", 70)
    monkeypatch.setattr(R, "BLOCK_DRAWS", 64)
    n = {"a": 90, "b": 7}
    units = spark.createDataFrame([(g, 10 * i) for g, k in n.items() for i in range(k)], "g string, u long").coalesce(1)
    want = {}
    for g, k in n.items():
        for slot in range(k):
            for rep, at in enumerate(R.scattered_array(5, np.arange(20), np.full(20, slot)) % k):
                want.setdefault((g, 10 * int(at)), []).append(rep)
    tasks, real = [], R._packed

    def spy(units, unit, by, n_boot, drawn):
        def seen(dealt, schema):
            tasks.append(dealt.rdd.getNumPartitions())
            return drawn(dealt, schema)

        return real(units, unit, by, n_boot, seen)

    monkeypatch.setattr(R, "_packed", spy)
    got = R.packed_draws(units, "u", 20, ["g"], 5).collect()
    assert {(r.g, r.u): sorted(r.reps) for r in got} == {k: sorted(v) for k, v in want.items()} and len(got) == len(want)
    assert tasks == [10]
    hashed = R.packed_hash_draws(units, "u", 20, ["g"], 5).collect()
    assert sum(len(r.reps) for r in hashed if r.g == "a") == 90 * 20


def test_small_slices_are_smoothed_together(spark):
    """Many slices in a call, whole ones though batches cut them, and each smoothed by itself."""
    rng = np.random.default_rng(5)
    patch = rng.normal(size=(40, 5, 7))
    patch[rng.random(patch.shape) < 0.2] = np.nan
    patch[7] = np.nan
    rows = [(None if k == 3 else f"p{k}", k % 3, j, i, None if np.isnan(x) else float(x)) for (k, j, i), x in np.ndenumerate(patch)]
    cells = spark.createDataFrame(rows, "p string, g int, iy int, ix int, a double").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "80")
    try:
        many = S.by_slices(cells, ["p", "g"], lambda c, number: c.append_column("n", pa.array(number + 0.0)).append_column("m", pa.array(np.full(len(number), number[-1] + 1.0))), ["n", "m"], (5, 7)).collect()
        got = S.gauss_reflect(cells, {"a": "s"}, ["p", "g"], 4.0, 1.5, 5, 7).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(r["m"] for r in many) > 1 and len(many) == len(rows)
    called = {}
    for r in many:
        called.setdefault((r["p"], r["g"]), []).append(r["n"])
    assert all(len(x) == 35 and len(set(x)) == 1 for x in called.values()) and len(called) == 40
    weigh = np.array(S.kernel(4.0 / 2.355 / 1.5))
    have = {(r["p"], r["g"], r["iy"], r["ix"]): r["s"] for r in got}
    assert len(have) == len(rows)
    for k, v in enumerate(patch):
        r = len(weigh) // 2
        full = np.pad(np.where(np.isnan(v), np.nanmean(v) if k != 7 else 0.0, v), r, mode="symmetric")
        full = np.array([np.convolve(row, weigh, "valid") for row in full])
        full = np.array([np.convolve(col, weigh, "valid") for col in full.T]).T
        for (j, i), x in np.ndenumerate(v):
            s = have[None if k == 3 else f"p{k}", k % 3, j, i]
            assert s is None if np.isnan(x) else s == pytest.approx(full[j, i])


def test_previous_hour_is_not_broadcast(spark, tmp_path):
    """A table of cells is small in its file and large in memory."""
    rows = [(k, dh, iy, float(10 * k + dh)) for k in range(3) for dh in range(2) for iy in range(2)]
    path = str(tmp_path / "cells")
    spark.createDataFrame(rows, "k int, dh int, iy int, q double").write.parquet(path)
    got = P.with_previous_hour(spark.read.parquet(path), ["k", "iy"], ["q"])
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert all(r["q_prev"] == 10.0 * r["k"] for r in got.collect())
