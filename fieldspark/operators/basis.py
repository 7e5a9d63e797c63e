"""Six orthogonal patterns of a patch, and projections on them.

One aggregate per unit gives all 21 inner products of the six fields and six
per projected term; orthogonalisation is then plain column algebra (L D L^T).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.columns import m2_to_km2
from fieldspark.functions.constants import R_EARTH
from fieldspark.operators.stencil import centred

PHI = [f"phi{k}" for k in range(1, 7)]
SCALES = [f"s{k}" for k in range(1, 7)]
NAMES = ("beta", "ax", "ay", "gamma1", "gamma2", "sigma")
SIGNS = (1, -1, -1, -1, -1, 1)
FIXED_SCALES = (1e6, 1e12, 1e12, 1e18, 1e18, 1e18)
EPS = 1e-30


def raw_basis(cells: DataFrame, keys: list[str], q: str, dy_deg: float, dx_deg: float, lat: Column | None = None) -> DataFrame:
    """phi1..phi6: anomaly, d/dx, d/dy, shear, normal strain, Laplacian of ``q`` on a patch (iy, ix)."""
    dy = F.radians(F.lit(dy_deg)) * R_EARTH
    dx = F.radians(F.lit(dx_deg)) * R_EARTH * (F.cos(F.radians(lat)) if lat is not None else 1.0)
    dxc = lambda c: centred(F.col(c), [*keys, "iy"], "ix", dx)
    dyc = lambda c: centred(F.col(c), [*keys, "ix"], "iy", dy)
    c = cells.withColumn("phi1", F.col(q)).withColumn("phi2", dxc(q)).withColumn("phi3", dyc(q))
    c = c.withColumn("_xx", dxc("phi2")).withColumn("_yy", dyc("phi3")).withColumn("phi4", dyc("phi2"))
    return c.withColumn("phi5", F.col("_xx") - F.col("_yy")).withColumn("phi6", F.col("_xx") + F.col("_yy")).drop("_xx", "_yy")


def prenorm(cells: DataFrame, keys: list[str], mode: str = "auto") -> DataFrame:
    """Scales the six fields: "auto" by 1 / their 95th percentile of |value| > 0, or "fixed".  Adds s1..s6."""
    if mode == "fixed":
        for p, s, k in zip(PHI, FIXED_SCALES, range(1, 7)):
            cells = cells.withColumn(p, F.col(p) * s).withColumn(f"s{k}", F.lit(s))
        return cells
    p95 = cells.groupBy(*keys).agg(*[F.percentile(F.when(F.col(p) != 0, F.abs(p)), 0.95).alias(f"_p{k}") for k, p in enumerate(PHI, 1)])
    cells = cells.join(p95, keys)
    for k, p in enumerate(PHI, 1):
        s = F.when(F.col(f"_p{k}") > 0, 1.0 / F.col(f"_p{k}")).otherwise(1.0)
        cells = cells.withColumn(f"s{k}", s).withColumn(p, F.col(p) * F.col(f"s{k}")).drop(f"_p{k}")
    return cells


def mask_predicate(spec, column: Column) -> Column:
    """"< 0", "> 2e-7", ">=", "<="; True, None: everything; False: nothing; a Column as it is."""
    if spec is None or spec is True:
        return F.lit(True)
    if spec is False:
        return F.lit(False)
    if isinstance(spec, Column):
        return spec
    m = re.fullmatch(r"\s*(<=|>=|<|>)\s*([-+0-9.eE]+)\s*", spec)
    if not m:
        raise ValueError(f"mask {spec!r}")
    x = float(m[2])
    return {"<": column < x, ">": column > x, "<=": column <= x, ">=": column >= x}[m[1]]


def basis_mask(cells: DataFrame, spec, column: str) -> DataFrame:
    """Adds mask: the predicate, where all six fields are present."""
    ok = mask_predicate(spec, F.col(column))
    for p in PHI:
        ok = ok & F.col(p).isNotNull()
    return cells.withColumn("mask", F.coalesce(ok, F.lit(False)))


def basis_weights(cells: DataFrame, lat: Column | None = None) -> DataFrame:
    w = F.cos(F.radians(lat)) if lat is not None else F.lit(1.0)
    return cells.withColumn("w", F.when(F.col("mask"), w).otherwise(0.0))


def central_blob(cells: DataFrame, keys: list[str], mask: str, y: str = "y_rel", x: str = "x_rel", iy: str = "iy", ix: str = "ix") -> DataFrame:
    """Keeps the 4-connected part of ``mask`` at the centre: adds blob.

    The seed is the masked cell nearest to (0, 0), ties to the first in row
    order.  A unit is one patch, a bounded number of cells: its masked cells
    become one row, and a task grows the seeds of all patches of a batch in
    step until none grows any more.
    """
    d = (F.pow(F.col(y), 2) + F.pow(F.col(x), 2)).alias("d")
    units = cells.filter(F.col(mask)).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(d, F.col(iy).cast("int").alias("y"), F.col(ix).cast("int").alias("x")))).alias("_c"))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("_c")
            first = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            unit = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            rows, cols = (flat.field(k).to_numpy() for k in (1, 2))
            at = (unit, rows - rows.min(), cols - cols.min())
            on = np.zeros((batch.num_rows, int(at[1].max()) + 1, int(at[2].max()) + 1), bool)
            on[at] = True
            reached = np.zeros_like(on)
            reached[tuple(k[first] for k in at)] = True  # cells are sorted by distance, row and column
            while True:
                more = reached.copy()
                more[:, 1:] |= reached[:, :-1]
                more[:, :-1] |= reached[:, 1:]
                more[:, :, 1:] |= reached[:, :, :-1]
                more[:, :, :-1] |= reached[:, :, 1:]
                more &= on
                if (more == reached).all():
                    break
                reached = more
            kept = np.flatnonzero(reached[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(unit[kept])) for k in keys), pa.array(rows[kept]), pa.array(cols[kept])], [*keys, iy, ix])

    types = dict(cells.dtypes)
    blob = units.mapInArrow(grow, ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"`{iy}` int", f"`{ix}` int"])).withColumn("blob", F.lit(True))
    return cells.join(blob, [*keys, iy, ix], "left").withColumn("blob", F.coalesce("blob", F.lit(False)))


def centre_region(cells: DataFrame, keys: list[str], field: str, level: float, below: bool = True, box: float = 1.0, y: str = "y_rel", x: str = "x_rel") -> DataFrame:
    """Adds region: the cells that the contour ``level`` of ``field`` encloses together with the centre.

    They are the connected cells below (or above) the level that hold the
    centre, or else a cell within ``box`` degrees of it; without one, none.
    """
    side = F.col(field) < level if below else F.col(field) > level
    blob = central_blob(cells.withColumn("_m", F.coalesce(side, F.lit(False))), keys, "_m", y, x)
    near = F.max((F.col("blob") & (F.abs(y) <= box) & (F.abs(x) <= box)).cast("int")).over(Window.partitionBy(*keys)) == 1
    return blob.withColumn("region", F.col("blob") & near).drop("blob", "_m")


def inner(f: Column, g: Column) -> Column:
    """Weighted inner product over the mask (w is 0 outside)."""
    return F.sum(F.col("w") * f * g)


def gram(cells: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """One row per unit: g_i_j of the six fields, t_<term>_j of every term and, of fields that were scaled, s1..s6, in one
    aggregate."""
    aggs = [inner(F.col(PHI[i]), F.col(PHI[j])).alias(f"g_{i}_{j}") for i in range(6) for j in range(i + 1)]
    aggs += [inner(F.col(t), F.col(PHI[j])).alias(f"t_{t}_{j}") for t in terms for j in range(6)]
    aggs += [F.max(s).alias(s) for s in SCALES if s in cells.columns]  # one value a unit
    return cells.filter("w <> 0").groupBy(*keys).agg(*aggs)


def orthogonalize(gram_rows: DataFrame) -> DataFrame:
    """Adds d_j (squared norms) and l_i_j (phi_i = sum_j l_i_j * orthogonal_j)."""
    g = gram_rows
    for i in range(6):
        for j in range(i):
            s = F.col(f"g_{i}_{j}")
            for k in range(j):
                s = s - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") * F.col(f"d_{k}")
            g = g.withColumn(f"l_{i}_{j}", F.when(F.col(f"d_{j}") > EPS, s / F.col(f"d_{j}")).otherwise(0.0))
        d = F.col(f"g_{i}_{i}")
        for k in range(i):
            d = d - F.col(f"l_{i}_{k}") * F.col(f"l_{i}_{k}") * F.col(f"d_{k}")
        g = g.withColumn(f"d_{i}", d)
    return g


def project(gram_rows: DataFrame, keys: list[str], terms: list[str], physical: bool = False) -> DataFrame:
    """keys, term, beta ax ay gamma1 gamma2 sigma of every term; a vanishing norm gives NULL.

    ``physical``: in the units of the unscaled fields (times s1..s6), with
    gamma1_km2, gamma2_km2 and sigma_km2, and the others as <name>_raw.
    """
    o = orthogonalize(gram_rows)
    out = []
    for t in terms:
        raw: list[Column] = []
        for j in range(6):
            s = F.col(f"t_{t}_{j}")
            for k in range(j):
                s = s - F.col(f"l_{j}_{k}") * raw[k]
            raw.append(s)
        coef = [SIGNS[j] * F.when(F.col(f"d_{j}") > EPS, raw[j] / F.col(f"d_{j}")) for j in range(6)]
        named = [c.alias(n) for c, n in zip(coef, NAMES)]
        if physical:
            scaled = [c * F.col(s) for c, s in zip(coef, SCALES)]
            named = [c.alias(f"{n}_raw") for c, n in zip(coef, NAMES)] + [c.alias(n) for c, n in zip(scaled, NAMES)]
            named += [m2_to_km2(c).alias(f"{n}_km2") for c, n in zip(scaled[3:], NAMES[3:])]
        out.append(F.struct(F.lit(t).alias("term"), *named))
    return o.select(*keys, F.explode(F.array(*out)).alias("p")).select(*keys, "p.*")


def orthogonal_cells(cells: DataFrame, gram_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Replaces phi1..phi6 by their orthogonal forms."""
    o = orthogonalize(gram_rows).select(*keys, *[f"l_{i}_{j}" for i in range(6) for j in range(i)])
    c = cells.join(o, keys)
    for i in range(6):
        v = F.col(PHI[i])
        for j in range(i):
            v = v - F.col(f"l_{i}_{j}") * F.col(PHI[j])
        c = c.withColumn(PHI[i], v)
    return c.drop(*[f"l_{i}_{j}" for i in range(6) for j in range(i)])


def components(ortho: DataFrame, coef: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Adds int, prop, def1, def2, lap, recon and resid of unscaled coefficients of one term."""
    c = ortho.join(coef.select(*keys, *NAMES), keys)
    part = [s * F.coalesce(F.col(n), F.lit(0.0)) * F.col(p) for s, n, p in zip(SIGNS, NAMES, PHI)]
    c = c.withColumn("int", part[0]).withColumn("prop", part[1] + part[2]).withColumn("def1", part[3]).withColumn("def2", part[4]).withColumn("lap", part[5])
    c = c.withColumn("recon", F.col("int") + F.col("prop") + F.col("def1") + F.col("def2") + F.col("lap"))
    return c.withColumn("resid", F.when(F.col("w") != 0, F.col(field) - F.col("recon"))).drop(*NAMES)


def sig_only(value: str, sig: str) -> Column:
    return F.when(F.col(sig), F.col(value)).otherwise(0.0)


def lifecycle(coef: DataFrame, value: str) -> DataFrame:
    """Mean, standard error and count of a coefficient by stage, term and dh."""
    return coef.groupBy("stage", "term", "dh").agg(F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n"))
