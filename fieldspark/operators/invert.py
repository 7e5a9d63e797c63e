"""Linear inversion on the sphere, slice by slice in Arrow.

The discrete Laplacian is diagonal in zonal waves; for each wave the rows obey
a tridiagonal system that depends on the grid only.  A slice (one level of one
hour) is one group: its rings go through a fast Fourier transform, the factors
of all waves' systems, made once per process, are applied to all fields of the
slice in step, and the transform goes back.  Cells keep their other columns on
the way, so nothing is joined back; work and memory follow the slice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions.columns import omega_dry
from fieldspark.functions.constants import R_EARTH
from fieldspark.operators import stencil as S


@dataclass(frozen=True)
class Sphere:
    """A ring grid: rows lat0 + j * dlat, nlon cells around.

    ``edges``: "dirichlet" (0 on the first and last row) or "neumann"
    (prescribed slopes there).
    """

    lat0: float
    dlat: float
    nlat: int
    nlon: int
    edges: str = "dirichlet"

    @property
    def dlon(self) -> float:
        return 360.0 / self.nlon

    def with_edges(self, edges: str) -> Sphere:
        return Sphere(self.lat0, self.dlat, self.nlat, self.nlon, edges)


def bands(grid: Sphere) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(below, middle, above) of the Laplacian times R_EARTH squared, by row and wave."""
    lat = np.deg2rad(grid.lat0 + grid.dlat * np.arange(grid.nlat))[:, None]
    wave = np.arange(grid.nlon // 2 + 1)[None, :]
    dphi, dlam = np.deg2rad(grid.dlat), 2 * np.pi / grid.nlon
    cos = np.maximum(np.cos(lat), 1e-6)
    up = np.cos(lat + dphi / 2) / (cos * dphi**2) + 0.0 * wave
    down = np.cos(lat - dphi / 2) / (cos * dphi**2) + 0.0 * wave
    middle = 2 * (np.cos(2 * np.pi * wave / grid.nlon) - 1) / (cos**2 * dlam**2) - up - down
    # a ghost row beyond an edge mirrors the row inside, but for the edge's slope
    up[0], down[-1] = up[0] + down[0], up[-1] + down[-1]
    up[-1], down[0] = 0.0, 0.0
    fixed = [(0, slice(None)), (-1, slice(None))] if grid.edges == "dirichlet" else [(0, 0)]
    for row in fixed:
        middle[row], up[row], down[row] = 1.0, 0.0, 0.0
    return down, middle, up


@lru_cache(maxsize=8)
def _factors(grid: Sphere) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward elimination of every wave's system: (below, 1 / pivot, above / pivot)."""
    down, middle, up = bands(grid)
    pivot, ratio = np.empty_like(middle), np.empty_like(middle)
    before = np.zeros(middle.shape[1])
    for j in range(grid.nlat):
        pivot[j] = 1.0 / (middle[j] - down[j] * before)
        before = ratio[j] = up[j] * pivot[j]
    return down, pivot, ratio


def solve_slice(grid: Sphere, fields: np.ndarray) -> np.ndarray:
    """x with laplacian(x) = fields, for an array (fields, rows, columns)."""
    down, pivot, ratio = _factors(grid)
    w = np.fft.rfft(fields, axis=2) * R_EARTH**2
    if grid.edges == "neumann":
        w[:, 0, 0] = 0.0
    w[:, 0] *= pivot[0]
    for j in range(1, grid.nlat):
        w[:, j] = (w[:, j] - down[j] * w[:, j - 1]) * pivot[j]
    for j in range(grid.nlat - 2, -1, -1):
        w[:, j] -= ratio[j] * w[:, j + 1]
    return np.fft.irfft(w, n=grid.nlon, axis=2)


def _laid_out(cells: pa.Table, cols: list[str], nlat: int, nlon: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns as arrays over rows and ring, gaps as 0; row and ring index of each cell)."""
    j, i = (cells.column(c).to_numpy() for c in ("ilat", "ilon"))
    out = np.zeros((len(cols), nlat, nlon))
    for k, c in enumerate(cols):
        out[k, j, i] = np.nan_to_num(cells.column(c).to_numpy())
    return out, j, i


def _solver(grid: Sphere, sources: dict[str, str]) -> Callable:
    def solve(cells: pa.Table) -> pa.Table:
        fields, j, i = _laid_out(cells, list(sources.values()), grid.nlat, grid.nlon)
        for out, x in zip(sources, solve_slice(grid, fields)):
            cells = cells.append_column(out, pa.array(x[j, i]))
        return cells.drop_columns(list(sources.values()))

    return solve


def zonal_dft(df: DataFrame, col: str, keys: list[str], nlon: int) -> DataFrame:
    """keys, ilat, m, re, im for waves 0..nlon/2; gaps count as 0."""
    half = nlon // 2 + 1

    def transform(cells: pa.Table) -> pa.Table:
        rows = np.unique(cells.column("ilat").to_numpy())
        fields, _, _ = _laid_out(cells, [col], int(rows.max()) + 1, nlon)
        w = np.fft.rfft(fields[0][rows], axis=1).ravel()
        first = {k: pa.array(cells.column(k).slice(0, 1).to_pylist() * len(w), cells.column(k).type) for k in keys}
        return pa.table(first | {"ilat": np.repeat(rows, half).astype(np.int32), "m": np.tile(np.arange(half, dtype=np.int32), len(rows)), "re": w.real.copy(), "im": w.imag.copy()})

    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(c, T.IntegerType()) for c in ("ilat", "m")] + [T.StructField(c, T.DoubleType()) for c in ("re", "im")])
    cells = df.select(*keys, F.col("ilat").cast("int").alias("ilat"), F.col("ilon").cast("int").alias("ilon"), col)
    return cells.groupBy(*keys).applyInArrow(transform, schema)


def zonal_idft(waves: DataFrame, out: str, keys: list[str], nlon: int) -> DataFrame:
    """The way back: one row per keys, ilat, ilon."""

    def transform(cells: pa.Table) -> pa.Table:
        rows, at = np.unique(cells.column("ilat").to_numpy(), return_inverse=True)
        w = np.zeros((len(rows), nlon // 2 + 1), complex)
        w[at, cells.column("m").to_numpy()] = cells.column("re").to_numpy() + 1j * cells.column("im").to_numpy()
        x = np.fft.irfft(w, n=nlon, axis=1).ravel()
        first = {k: pa.array(cells.column(k).slice(0, 1).to_pylist() * len(x), cells.column(k).type) for k in keys}
        return pa.table(first | {"ilat": np.repeat(rows, nlon).astype(np.int32), "ilon": np.tile(np.arange(nlon, dtype=np.int32), len(rows)), out: x})

    schema = T.StructType([waves.schema[k] for k in keys] + [T.StructField(c, T.IntegerType()) for c in ("ilat", "ilon")] + [T.StructField(out, T.DoubleType())])
    return waves.select(*keys, "ilat", "m", "re", "im").groupBy(*keys).applyInArrow(transform, schema)


def remove_area_mean(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """Subtracts the cosine-weighted mean of each slice."""
    w, area = Window.partitionBy(*keys), F.cos(F.radians("lat"))
    return df.withColumn(col, F.col(col) - F.sum(area * F.col(col)).over(w) / F.sum(F.when(F.col(col).isNotNull(), area)).over(w))


def poisson(df: DataFrame, col: str, out: str, keys: list[str], grid: Sphere, slopes: tuple[str, str] | None = None) -> DataFrame:
    """Adds ``out`` with laplacian(out) = col on every slice.

    "dirichlet": out is 0 on the first and last row.  "neumann": the slopes
    d out / dy there are the columns ``slopes`` (south, north; 0 without), the
    slice should have no area mean, and the zonal mean of the first row is 0.
    Missing values count as 0.
    """
    return poissons(df, {out: (col, slopes)}, keys, grid)


def poissons(df: DataFrame, wanted: dict, keys: list[str], grid: Sphere) -> DataFrame:
    """``poisson`` for several columns, out -> (column, slopes), in one pass over the slices."""
    src, j = df, F.col("ilat")
    dphi, lat = float(np.deg2rad(grid.dlat)), F.radians("lat")
    for out, (col, slopes) in wanted.items():
        f = F.coalesce(F.col(col), F.lit(0.0))
        if grid.edges == "dirichlet":
            f = F.when((j == 0) | (j == grid.nlat - 1), 0.0).otherwise(f)
        elif slopes:
            edge = lambda s, c, sign: sign * F.cos(lat + s * dphi / 2) / F.cos(lat) * 2 * F.coalesce(F.col(c), F.lit(0.0)) / (R_EARTH * dphi)
            f = f + F.when(j == 0, edge(-1, slopes[0], 1.0)).when(j == grid.nlat - 1, edge(1, slopes[1], -1.0)).otherwise(0.0)
        src = src.withColumn(f"_f_{out}", f)
    sources = {out: f"_f_{out}" for out in wanted}
    return S.by_slice(src, keys, _solver(grid, sources), list(wanted), list(sources.values()))


def gradient(df: DataFrame, col: str, outs: tuple[str, str], keys: list[str], dlat: float, dlon: float) -> DataFrame:
    """Zonal and meridional gradient of a potential."""
    return gradients(df, {col: outs}, keys, dlat, dlon)


def gradients(df: DataFrame, wanted: dict[str, tuple[str, str]], keys: list[str], dlat: float, dlon: float) -> DataFrame:
    """``gradient`` of several columns: one shuffle along the rings, one along the meridians."""
    df = df.withColumns({x: S.ddx(F.col(c), keys, dlon) for c, (x, _) in wanted.items()})
    return df.withColumns({y: S.ddy(F.col(c), keys, dlat) for c, (_, y) in wanted.items()})


def helmholtz(df: DataFrame, keys: list[str], grid: Sphere) -> DataFrame:
    """Splits u, v into rotational, divergent and harmonic parts.

    Adds psi, chi, vort, div, u_rot, v_rot, u_div, v_div, u_har, v_har.  The
    edge slopes come from the wind itself.  Cells without wind get NULL parts.
    """
    df = df.withColumn("_m", F.col("u").isNotNull() & F.col("v").isNotNull())
    safe = df.withColumn("_u", F.col("u")).withColumn("_v", F.col("v"))
    safe = safe.withColumn("u", F.coalesce("u", F.lit(0.0))).withColumn("v", F.coalesce("v", F.lit(0.0)))
    safe = S.with_vorticity_divergence(safe, keys, grid.dlat, grid.dlon)
    safe = remove_area_mean(remove_area_mean(safe.withColumn("_z", F.col("vort")).withColumn("_d", F.col("div")), "_z", keys), "_d", keys)
    # psi: u = -d psi / dy; chi: v = d chi / dy
    safe = safe.withColumn("_pu", -F.col("u")).withColumn("_cv", F.col("v"))
    safe = poissons(safe, {"psi": ("_z", ("_pu", "_pu")), "chi": ("_d", ("_cv", "_cv"))}, keys, grid.with_edges("neumann"))
    safe = gradients(safe, {"psi": ("v_rot", "_py"), "chi": ("u_div", "v_div")}, keys, grid.dlat, grid.dlon).withColumn("u_rot", -F.col("_py"))
    safe = safe.withColumn("u_har", F.col("u") - F.col("u_rot") - F.col("u_div")).withColumn("v_har", F.col("v") - F.col("v_rot") - F.col("v_div"))
    parts = ("psi", "chi", "vort", "div", "u_rot", "v_rot", "u_div", "v_div", "u_har", "v_har")
    for c in parts:
        safe = safe.withColumn(c, F.when(F.col("_m"), F.col(c)))
    return safe.withColumn("u", F.col("_u")).withColumn("v", F.col("_v")).drop("_m", "_u", "_v", "_z", "_d", "_pu", "_cv", "_py")


def chi_winds(df: DataFrame, motions: dict[str, tuple[str, str, str]], keys: list[str], grid: Sphere) -> DataFrame:
    """Divergent winds of vertical motions, column -> (chi, u, v): laplacian(chi) = -d omega / dp, fixed-zero edges."""
    slices = [*keys, "level"]
    df = df.withColumns({f"_src_{omega}": -S.ddp(F.col(omega), keys, F.col("level")) for omega in motions})
    for omega in motions:
        df = remove_area_mean(df, f"_src_{omega}", slices)
    df = poissons(df, {chi: (f"_src_{omega}", None) for omega, (chi, _, _) in motions.items()}, slices, grid.with_edges("dirichlet"))
    df = gradients(df, {chi: (u, v) for chi, u, v in motions.values()}, slices, grid.dlat, grid.dlon)
    return df.drop(*[f"_src_{omega}" for omega in motions])


def omega_winds(df: DataFrame, parts: dict, keys: list[str], grid: Sphere) -> DataFrame:
    """component, omega, chi, u_div, v_div of several vertical motions (name -> Column), all in one job."""
    each = F.array(*[F.struct(F.lit(n).alias("n"), w.alias("w")) for n, w in parts.items()])
    long = df.select(*keys, "level", "ilat", "ilon", "lat", "lon", F.explode(each).alias("p"))
    long = long.select(*keys, F.col("p.n").alias("component"), "level", "ilat", "ilon", "lat", "lon", F.col("p.w").alias("omega"))
    return chi_winds(long, {"omega": ("chi", "u_div", "v_div")}, [*keys, "component"], grid)


def decompose_omega(df: DataFrame, total: str, adiabatic: str, keys: list[str], grid: Sphere) -> DataFrame:
    """The divergent winds of total, adiabatic and the remaining motion over a ``component`` key."""
    parts = {"total": F.col(total), "adiabatic": F.col(adiabatic), "diabatic": F.col(total) - F.col(adiabatic)}
    return omega_winds(df, parts, keys, grid)


def with_omega_parts(df: DataFrame, keys: list[str], grid: Sphere, known=("adiabatic", "diabatic", "qg_diabatic", "lhr_moist")) -> DataFrame:
    """Adds w_<part> where it can be told, and u_div_<part>, v_div_<part> of every part there is.

    Without an adiabatic column it is a third of w; diabatic is the rest.  The
    budget-diabatic and latent parts have to be supplied.
    """
    if "w_adiabatic" not in df.columns:
        df = df.withColumn("w_adiabatic", omega_dry(F.col("w")))
    if "w_diabatic" not in df.columns:
        df = df.withColumn("w_diabatic", F.col("w") - F.col("w_adiabatic"))
    parts = [p for p in known if f"w_{p}" in df.columns]
    df = chi_winds(df, {f"w_{p}": (f"_chi_{p}", f"u_div_{p}", f"v_div_{p}") for p in parts}, keys, grid)
    return df.drop(*[f"_chi_{p}" for p in parts])


def additivity_error(parts: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """Largest |adiabatic + diabatic - total| of each column of ``decompose_omega``."""
    cell = parts.groupBy(*[c for c in parts.columns if c in ("ts", "level", "ilat", "ilon")]).agg(
        *[F.sum(F.when(F.col("component") == "total", -F.col(c)).otherwise(F.col(c))).alias(c) for c in cols]
    )
    return cell.agg(*[F.max(F.abs(c)).alias(f"max_{c}") for c in cols])
