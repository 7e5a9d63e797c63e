"""Stencils and derivatives along one axis of a table of cells.

Each is one window over the axis; functions that share axes share a sort.
``keys`` are the other axes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions.columns import coriolis_clamped
from fieldspark.functions.constants import KAPPA, R_DRY, R_EARTH


def _neighbours(c: Column, keys: list[str], axis: str, periodic: bool = False) -> tuple[Column, Column, Column, Column]:
    """Previous and next value, and whether these exist as rows."""
    w = Window.partitionBy(*keys).orderBy(axis)
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    has_before, has_after = F.lag(axis).over(w).isNotNull(), F.lead(axis).over(w).isNotNull()
    if not periodic:
        return before, after, has_before, has_after
    ring = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.when(has_before, before).otherwise(F.last(c).over(ring))
    after = F.when(has_after, after).otherwise(F.first(c).over(ring))
    return before, after, F.lit(True), F.lit(True)


def centred(c: Column, keys: list[str], axis: str, step: Column, periodic: bool = False) -> Column:
    """Centred difference; first-order at open ends."""
    before, after, has_before, has_after = _neighbours(c, keys, axis, periodic)
    return (
        F.when(has_before & has_after, (after - before) / (2 * step))
        .when(has_after, (after - c) / step)
        .when(has_before, (c - before) / step)
    )


def centred_second(c: Column, keys: list[str], axis: str, step: Column, periodic: bool = False) -> Column:
    """Centred difference; three-point and second-order at open ends (first-order with two points)."""
    w = Window.partitionBy(*keys).orderBy(axis)
    before, after, has_before, has_after = _neighbours(c, keys, axis, periodic)
    after2, before2 = F.lead(c, 2).over(w), F.lag(c, 2).over(w)
    has_after2, has_before2 = F.lead(axis, 2).over(w).isNotNull(), F.lag(axis, 2).over(w).isNotNull()
    return (
        F.when(has_before & has_after, (after - before) / (2 * step))
        .when(has_after & has_after2, (-3 * c + 4 * after - after2) / (2 * step))
        .when(has_before & has_before2, (3 * c - 4 * before + before2) / (2 * step))
        .when(has_after, (after - c) / step)
        .when(has_before, (c - before) / step)
    )


def uneven(c: Column, x: Column, keys: list[str], axis: str) -> Column:
    """Three-point Lagrange derivative on uneven positions x; first-order at the ends."""
    w = Window.partitionBy(*keys).orderBy(axis)
    cm, cp, xm, xp = F.lag(c).over(w), F.lead(c).over(w), F.lag(x).over(w), F.lead(x).over(w)
    hm, hp = x - xm, xp - x
    inner = -hp / (hm * (hm + hp)) * cm + (hp - hm) / (hm * hp) * c + hm / (hp * (hm + hp)) * cp
    return F.when(xm.isNotNull() & xp.isNotNull(), inner).when(xp.isNotNull(), (cp - c) / hp).when(xm.isNotNull(), (c - cm) / hm)


# --- on the sphere: columns ilat, ilon, lat; spacings in degrees ---


def dx_m(lat: Column, dlon: float, floor: float = 0.0, dlat: float = 0.0) -> Column:
    """Zonal spacing in metres, not below ``floor`` times the meridional one."""
    dx = F.radians(F.lit(dlon)) * R_EARTH * F.cos(F.radians(lat))
    return F.greatest(dx, F.radians(F.lit(dlat)) * R_EARTH * floor) if floor else dx


def dy_m(dlat: float) -> Column:
    return F.radians(F.lit(dlat)) * R_EARTH


def ddx(c: Column, keys: list[str], dlon: float, periodic: bool = True) -> Column:
    return centred(c, [*keys, "ilat"], "ilon", dx_m(F.col("lat"), dlon), periodic)


def ddy(c: Column, keys: list[str], dlat: float) -> Column:
    return centred(c, [*keys, "ilon"], "ilat", dy_m(dlat))


def ddp(c: Column, keys: list[str], p_hpa: Column) -> Column:
    return uneven(c, p_hpa * 100.0, [*keys, "ilat", "ilon"], "level")


def ddt(c: Column, keys: list[str], seconds: int = 3600, edge_order: int = 1) -> Column:
    """d/dt from the values exactly ``seconds`` before and after; rows in between or beyond a gap play no part.

    Centred where both are there; else one-sided, with ``edge_order`` = 2 over
    three points where they are there.  NULL without a neighbour in time.
    """
    seconds = int(seconds)
    now = Window.partitionBy(*keys).orderBy(F.unix_seconds("ts"))
    before2, before, after, after2 = (F.first(c).over(now.rangeBetween(k * seconds, k * seconds)) for k in (-2, -1, 1, 2))
    ends = [(-3 * c + 4 * after - after2) / (2.0 * seconds), (3 * c - 4 * before + before2) / (2.0 * seconds)] if edge_order == 2 else []
    return F.coalesce((after - before) / (2.0 * seconds), *ends, (after - c) / float(seconds), (c - before) / float(seconds))


def d_dlambda(c: Column, keys: list[str], dlon: float, periodic: bool = True) -> Column:
    return centred_second(c, [*keys, "ilat"], "ilon", F.radians(F.lit(dlon)), periodic)


def d_dphi(c: Column, keys: list[str], dlat: float) -> Column:
    return centred_second(c, [*keys, "ilon"], "ilat", F.radians(F.lit(dlat)))


def with_divergence(df: DataFrame, a: str, b: str, out: str, keys: list[str], dlat: float, dlon: float) -> DataFrame:
    """Spherical divergence of the vector (a, b)."""
    cos = F.cos(F.radians("lat"))
    return (
        df.withColumn("_cb", F.col(b) * cos)
        .withColumn("_da", d_dlambda(F.col(a), keys, dlon))
        .withColumn("_db", d_dphi(F.col("_cb"), keys, dlat))
        .withColumn(out, (F.col("_da") + F.col("_db")) / (R_EARTH * cos))
        .drop("_cb", "_da", "_db")
    )


def with_vorticity_divergence(df: DataFrame, keys: list[str], dlat: float, dlon: float, metric: bool = True) -> DataFrame:
    """Adds vort and div of the wind u, v; ``metric``: with the tan(lat)/a terms."""
    tan = F.tan(F.radians("lat")) / R_EARTH if metric else F.lit(0.0)
    df = df.withColumn("_ux", ddx(F.col("u"), keys, dlon)).withColumn("_vx", ddx(F.col("v"), keys, dlon))
    df = df.withColumn("_uy", ddy(F.col("u"), keys, dlat)).withColumn("_vy", ddy(F.col("v"), keys, dlat))
    return df.withColumn("vort", F.col("_vx") - F.col("_uy") + F.col("u") * tan).withColumn("div", F.col("_ux") + F.col("_vy") - F.col("v") * tan).drop("_ux", "_vx", "_uy", "_vy")


def with_laplacian(df: DataFrame, col: str, out: str, keys: list[str], dlat: float, dlon: float) -> DataFrame:
    """Conservative spherical Laplacian on a periodic ring; first and last row 0."""
    c = F.col(col)
    dphi, dlam = F.radians(F.lit(dlat)), F.radians(F.lit(dlon))
    cos = F.cos(F.radians("lat"))
    west, east, _, _ = _neighbours(c, [*keys, "ilat"], "ilon", True)
    south, north, has_south, has_north = _neighbours(c, [*keys, "ilon"], "ilat")
    df = df.withColumn("_zonal", (east - 2 * c + west) / (R_EARTH**2 * cos * cos * dlam * dlam))
    half_n, half_s = F.cos(F.radians(F.col("lat") + dlat / 2)), F.cos(F.radians(F.col("lat") - dlat / 2))
    df = df.withColumn("_merid", (half_n * (north - c) - half_s * (c - south)) / (dphi * dphi * R_EARTH**2 * cos))
    return df.withColumn(out, F.when(has_south & has_north, F.col("_zonal") + F.col("_merid")).otherwise(0.0)).drop("_zonal", "_merid")


def with_geostrophic_wind(df: DataFrame, phi: str, keys: list[str], dlat: float, dlon: float) -> DataFrame:
    """Adds ug and vg from geopotential; f is held near the equator."""
    f = coriolis_clamped(F.col("lat"))
    step = dx_m(F.col("lat"), dlon, 0.01, dlat)
    df = df.withColumn("_px", centred(F.col(phi), [*keys, "ilat"], "ilon", step, True)).withColumn("_py", ddy(F.col(phi), keys, dlat))
    return df.withColumn("ug", -F.col("_py") / f).withColumn("vg", F.col("_px") / f).drop("_px", "_py")


# --- smoothing ---


def kernel(sigma: float, radius: int | None = None) -> list[float]:
    """Gaussian weights at offsets -radius..radius, summing to 1."""
    import math

    r = radius if radius is not None else int(4 * sigma + 0.5)
    k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(k) for x in k]


def by_slice(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.Table], added: list[str], dropped: list[str] = ()) -> DataFrame:
    """Sends each slice, the cells of one ``keys``, through ``work``, which adds double columns (and may drop some).

    Other columns go along, so nothing is joined back; memory follows one
    slice.  Times travel as whole microseconds: Arrow's time zone is the
    session's, the schema's need not be.
    """
    df, schema, back = _travelling(df, added, dropped)
    return back(df.groupBy(*keys).applyInArrow(lambda cells: work(cells).select(schema.names), schema))


def _travelling(df: DataFrame, added: list[str], dropped: list[str] = ()) -> tuple[DataFrame, T.StructType, Callable[[DataFrame], DataFrame]]:
    """Times as whole microseconds, the columns afterwards, and what makes them times again."""
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    df = df.withColumns({c: F.unix_micros(c) for c in times})
    kept = [f for f in df.schema.fields if f.name not in {*dropped, *added}]
    schema = T.StructType([*kept, *[T.StructField(c, T.DoubleType()) for c in added]])
    return df, schema, lambda out: out.withColumns({c: F.timestamp_micros(c) for c in times})


#: Cells of the slices that go through ``by_slices`` at once, about.
CELLS = 1 << 17


def by_slices(df: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], pa.Table], added: list[str], shape: tuple[int, int]) -> DataFrame:
    """As ``by_slice`` for many small slices: ``work`` also gets each cell's slice, numbered from 0 in a row.

    A task takes as many whole slices at once as CELLS allows, at least one;
    a call for each would take longer than its numbers.
    """
    df, schema, back = _travelling(df, added)
    most = max(1, CELLS // (shape[0] * shape[1]))

    def through(cells: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(starts) - 1, most):
            bounds = starts[k : k + most + 1]
            part = cells.slice(bounds[0], bounds[-1] - bounds[0]).combine_chunks()
            yield from work(part, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))).select(schema.names).combine_chunks().to_batches()

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the slices of a batch, the last of which goes on in the next one
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(batch, keys, held[-1] if held else None)
            if held and len(starts):
                yield from closed(held + [batch.slice(0, starts[0])])
                held = []
            if len(starts) > 1:
                yield from through(pa.Table.from_batches([batch]), starts)
            held.append(batch.slice(starts[-1]) if len(starts) else batch)
        if held:
            yield from closed(held)

    def closed(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One slice."""
        cells = pa.Table.from_batches(parts)
        return through(cells, np.array([0, cells.num_rows]))

    return back(df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tasks, schema))


def _starts(batch: pa.RecordBatch, keys: list[str], before: pa.RecordBatch | None) -> np.ndarray:
    """Where slices begin in sorted rows; the first row goes on with a slice where it has the keys of the last row ``before``."""
    rows = [*([before.slice(before.num_rows - 1)] if before is not None else []), batch]
    cells = pa.Table.from_batches([r.select(keys) for r in rows])
    change = np.zeros(cells.num_rows, bool)
    change[0] = before is None
    for k in keys:
        codes = pc.fill_null(cells.column(k).combine_chunks().dictionary_encode().indices, -1).to_numpy()
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change[len(change) - batch.num_rows :])


@lru_cache(maxsize=32)
def _weights(n: int, kernel_: tuple[float, ...], edge: str) -> np.ndarray:
    """What each cell of an axis (columns) weighs in each other one (rows)."""
    r, out = len(kernel_) // 2, np.zeros((n, n))
    for o, w in zip(range(-r, r + 1), kernel_):
        for at in range(n):
            seen = at + o
            # reflect: a cell lies in a neighbourhood directly or as its mirror image
            for t in [seen % n] if edge == "wrap" else [x for x in (seen, -1 - seen, 2 * n - 1 - seen) if 0 <= x < n]:
                out[t, at] += w
    return out


def smooth_slices(
    df: DataFrame, cols: dict[str, str], keys: list[str], axes: tuple[str, str], shape: tuple[int, int], weights: list[float], edge: str, fill: bool = False, origin: tuple[int, int] = (0, 0)
) -> DataFrame:
    """Weighted means over both axes of a slice, columns -> their smooth forms, one product of matrices a column and axis.

    ``axes`` go from ``origin`` on.  ``edge``: "wrap" or "reflect" (the edge
    cell counts twice).  Missing values do not count; with ``fill`` they count
    as the slice's mean, and are missing again afterwards.
    """
    one, two = (_weights(n, tuple(weights), edge) for n in shape)

    def work(cells: pa.Table, number: np.ndarray) -> pa.Table:
        j, i = (cells.column(c).to_numpy() - o for c, o in zip(axes, origin))
        n = int(number[-1]) + 1
        for col, out in cols.items():
            own = cells.column(col).to_numpy()
            v = np.full((n, *shape), np.nan)
            v[number, j, i] = own
            if fill:
                some = ~np.isnan(own)
                with np.errstate(invalid="ignore"):
                    mean = np.bincount(number[some], own[some], n) / np.bincount(number[some], minlength=n)
                v[number, j, i] = np.where(some, own, mean[number])
            for turn in (lambda x: x @ two.T, lambda x: one @ x):
                there = ~np.isnan(v)
                total, weight = turn(np.where(there, v, 0.0)), turn(there.astype(float))
                v = np.divide(total, weight, out=np.full(v.shape, np.nan), where=weight > 0)
            smooth = v[number, j, i]
            if fill:
                smooth = np.where(np.isnan(own), np.nan, smooth)
            cells = (cells.drop_columns([out]) if out in cells.column_names else cells).append_column(out, pa.array(smooth, mask=np.isnan(smooth)))
        return cells

    return by_slices(df, keys, work, list(cols.values()), shape)


def gauss_wrap(df: DataFrame, col: str, out: str, keys: list[str], sigma: float, nlat: int, nlon: int) -> DataFrame:
    """Gaussian smoothing over both axes of a slice, wrapped edges, normalised for gaps."""
    return smooth_slices(df, {col: out}, keys, ("ilat", "ilon"), (nlat, nlon), kernel(sigma), "wrap")


def gauss_reflect(df: DataFrame, cols: dict[str, str], keys: list[str], fwhm_deg: float, grid_deg: float, ny: int, nx: int, origin: tuple[int, int] = (0, 0)) -> DataFrame:
    """Gaussian smoothing of patches, columns -> their smooth forms, with reflected edges; gaps are filled by the slice's mean
    and missing again afterwards."""
    return smooth_slices(df, cols, keys, ("iy", "ix"), (ny, nx), kernel(fwhm_deg / 2.355 / grid_deg), "reflect", True, origin)


def smooth_121(c: Column, keys: list[str], axis: str) -> Column:
    """1-2-1 weights inside, ends unchanged."""
    before, after, has_before, has_after = _neighbours(c, keys, axis)
    return F.when(has_before & has_after, (before + 2 * c + after) / 4).otherwise(c)


def fourier_filter(df: DataFrame, col: str, out: str, keys: list[str], axis: str, n: int, modes: int) -> DataFrame:
    """Mean and the first ``modes`` waves along a full axis 0..n-1."""
    ang = lambda m: 2 * F.pi() * m * F.col(axis) / n
    aggs = [F.avg(col).alias("_m0")]
    for m in range(1, modes + 1):
        aggs += [(2 * F.sum(F.col(col) * F.cos(ang(m))) / n).alias(f"_c{m}"), (2 * F.sum(F.col(col) * F.sin(ang(m))) / n).alias(f"_s{m}")]
    coef = df.groupBy(*keys).agg(*aggs)
    waves = [F.col(f"_c{m}") * F.cos(ang(m)) + F.col(f"_s{m}") * F.sin(ang(m)) for m in range(1, modes + 1)]
    joined = df.join(coef, keys) if keys else df.crossJoin(F.broadcast(coef))
    return joined.withColumn(out, reduce(lambda a, b: a + b, waves, F.col("_m0"))).drop(*[c for c in coef.columns if c not in keys])


def fourier_lowpass(df: DataFrame, col: str, out: str, keys: list[str], ny: int, nx: int, dy_deg: float, dx_deg: float, cut_deg: float) -> DataFrame:
    """Keeps the waves of a slice whose wavelength is ``cut_deg`` or more."""
    kept = [
        (my, mx)
        for my in range(-(ny // 2), ny - ny // 2)
        for mx in range(-(nx // 2), nx - nx // 2)
        if ((my / (ny * dy_deg)) ** 2 + (mx / (nx * dx_deg)) ** 2) ** 0.5 <= 1 / cut_deg + 1e-12
    ]
    waves = df.sparkSession.createDataFrame(kept, "my int, mx int")
    ang = 2 * F.pi() * (F.col("my") * F.col("iy") / ny + F.col("mx") * F.col("ix") / nx)
    # the kept waves are a fixed set; each cell adds to each of them
    coef = df.crossJoin(F.broadcast(waves)).groupBy(*keys, "my", "mx").agg(
        (F.sum(F.col(col) * F.cos(ang)) / (ny * nx)).alias("_c"), (F.sum(F.col(col) * F.sin(ang)) / (ny * nx)).alias("_s")
    )
    back = df.select(*keys, "iy", "ix").join(coef, keys)
    back = back.groupBy(*keys, "iy", "ix").agg(F.sum(F.col("_c") * F.cos(ang) + F.col("_s") * F.sin(ang)).alias(out))
    return df.join(back, [*keys, "iy", "ix"])


def packed_lines(df: DataFrame, cols: list[str], group: list[str], axis: str, n: int) -> DataFrame:
    """group and for each column an array of its values at axis = 0..n - 1, gaps as 0: one row a line of the grid."""
    lines = df.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(axis).alias("_i"), *cols))).alias("_line"))
    whole = F.size("_line") == n

    def values(c: str):
        by = F.map_from_entries(F.transform("_line", lambda x: F.struct(x["_i"], x[c])))
        some = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at(by, i), F.lit(0.0)))
        return F.when(whole, F.transform("_line", lambda x: F.coalesce(x[c], F.lit(0.0)))).otherwise(some).alias(c)

    return lines.select(*group, *[values(c) for c in cols])


def ddx_spectral(df: DataFrame, col: str, out: str, keys: list[str], dlon: float, nlon: int) -> DataFrame:
    """Spectral zonal derivative (Nyquist wave dropped) as a circulant sum."""
    import math

    half = (nlon - 1) // 2
    weights = [sum(-2 * m * math.sin(2 * math.pi * m * d / nlon) for m in range(1, half + 1)) / nlon for d in range(nlon)]
    # derivative at i of value at i' with d = i - i'; one row a ring, no pairs of cells
    table = F.array(*[F.lit(float(w)) for w in weights])
    at = lambda c, i: F.aggregate(F.transform(c, lambda x, k: x * F.get(table, F.pmod(i - k, F.lit(nlon)))), F.lit(0.0), lambda a, x: a + x)
    rings = packed_lines(df, [col], [*keys, "ilat"], "ilon", nlon)
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.lit(nlon - 1)), lambda i: F.struct(i.alias("ilon"), at(col, i).alias("_d")))).alias("_c")
    s = rings.select(*keys, "ilat", cells).select(*keys, "ilat", "_c.*")
    return df.join(s, [*keys, "ilat", "ilon"]).withColumn(out, F.col("_d") / (R_EARTH * F.cos(F.radians("lat")))).drop("_d")


def regrid_bilinear(df: DataFrame, col: str, out: str, target: DataFrame, keys: list[str], lat0: float, dlat: float, lon0: float, dlon: float, nlon: int) -> DataFrame:
    """``target`` (tlat, tlon) gets the bilinear value of its four source cells; outside: no row."""
    y, x = (F.col("tlat") - lat0) / dlat, F.pmod(F.col("tlon") - lon0, F.lit(360.0)) / dlon
    t = target.select("tlat", "tlon", F.floor(y).alias("j"), F.floor(x).alias("i"), (y - F.floor(y)).alias("fy"), (x - F.floor(x)).alias("fx"))
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    t = t.select("*", corner.alias("k"))
    wy = F.when(F.col("k.a") == 1, F.col("fy")).otherwise(1 - F.col("fy"))
    wx = F.when(F.col("k.b") == 1, F.col("fx")).otherwise(1 - F.col("fx"))
    t = t.select(
        "tlat", "tlon", (F.col("j") + F.col("k.a")).cast("int").alias("ilat"),
        F.pmod(F.col("i") + F.col("k.b"), F.lit(nlon)).cast("int").alias("ilon"), (wy * wx).alias("wt"),
    ).filter("wt > 0")
    s = df.join(t, ["ilat", "ilon"]).groupBy(*keys, "tlat", "tlon").agg(F.sum(F.col("wt") * F.col(col)).alias(out), F.sum("wt").alias("_w"), F.count(col).alias("_n"), F.count("*").alias("_all"))
    return s.filter((F.col("_w") > 1 - 1e-9) & (F.col("_n") == F.col("_all"))).drop("_w", "_n", "_all")


def unwrap_lon(lon: Column, keys: list[str], axis: str) -> Column:
    """Longitude along a row without jumps of 360."""
    w = Window.partitionBy(*keys).orderBy(axis)
    step = lon - F.lag(lon).over(w)
    return F.when(step < -180, 360.0).when(step > 180, -360.0).otherwise(0.0)


def with_unwrapped_lon(df: DataFrame, lon: str, out: str, keys: list[str], axis: str) -> DataFrame:
    df = df.withColumn("_jump", unwrap_lon(F.col(lon), keys, axis))
    return df.withColumn(out, F.col(lon) + F.sum("_jump").over(Window.partitionBy(*keys).orderBy(axis))).drop("_jump")


def with_static_stability(df: DataFrame, t: str, out: str, keys: list[str]) -> DataFrame:
    """-(R T / p) d ln(theta) / dp by level, ends copied, at least 1e-7."""
    w = Window.partitionBy(*keys).orderBy("level")
    p = F.col("level") * 100.0
    lnth = F.log(F.col(t) * F.pow(1e5 / p, F.lit(KAPPA)))
    inner = -(R_DRY * F.col(t) / p) * (F.lead(lnth).over(w) - F.lag(lnth).over(w)) / (F.lead(p).over(w) - F.lag(p).over(w))
    df = df.withColumn("_s", inner)
    first, last = F.lag("level").over(w).isNull(), F.lead("level").over(w).isNull()
    filled = F.when(first, F.lead("_s").over(w)).when(last, F.lag("_s").over(w)).otherwise(F.col("_s"))
    return df.withColumn(out, F.greatest(filled, F.lit(1e-7))).drop("_s")
