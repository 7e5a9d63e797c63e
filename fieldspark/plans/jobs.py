"""Whole jobs: climatology, events to patches, classes, composites, projections."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import columns as C
from fieldspark.functions.constants import MEAN_LEVELS
from fieldspark.operators import basis as B
from fieldspark.operators import composite as K
from fieldspark.operators import invert, overturn
from fieldspark.operators import patches as P
from fieldspark.operators import stencil as S
from fieldspark.operators import terms as M
from fieldspark.sources.scratch import setting, written
from fieldspark.sources.tables import read_patches

#: Patches of a file and of a task that writes them; numbers of a table of fields that is sent to all executors.
PATCHES, BROADCAST = 1_000, 2_000_000
#: Spark's own setting: a task with no more folders than this writes them side by side, without sorting its rows by folder.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


@dataclass(frozen=True)
class GridSpec:
    lat0: float = 0.0
    dlat: float = 1.5
    nlat: int = 61
    lon0: float = -180.0
    dlon: float = 1.5
    nlon: int = 240


    @property
    def sphere(self) -> invert.Sphere:
        return invert.Sphere(self.lat0, self.dlat, self.nlat, self.nlon)


@dataclass(frozen=True)
class ComputeConfig:
    grid: GridSpec = field(default_factory=GridSpec)
    half_j: int = 14
    half_i: int = 24
    winds: bool = True


def clim(cells: DataFrame, fields: list[str], keys: list[str], years: tuple[int, int] | None = None) -> DataFrame:
    """Hourly climatology by calendar."""
    return K.compute_climatology(cells, fields, keys, years)


def clim_smooth(climate: DataFrame, fields: list[str], n_steps: int, nlon: int, harmonics: int = 4, modes: int = 2) -> DataFrame:
    """The climatology with ``harmonics`` waves over its calendar steps and ``modes`` waves around the ring.

    ``n_steps``: the (month, day, hour) steps of the calendar, in order; all
    of them have every cell.
    """
    steps = climate.select("month", "day", "hour").distinct()  # one row a step of the calendar
    steps = steps.withColumn("step", F.row_number().over(Window.orderBy("month", "day", "hour")) - 1)
    c = climate.join(F.broadcast(steps), ["month", "day", "hour"])
    for f in fields:
        c = S.fourier_filter(c, f, "_t", ["level", "ilat", "ilon"], "step", n_steps, harmonics)
        c = S.fourier_filter(c, "_t", "_s", ["step", "level", "ilat"], "ilon", nlon, modes).drop(f, "_t").withColumnRenamed("_s", f)
    return c.drop("step")


def clim_helmholtz(climate: DataFrame, grid: GridSpec) -> DataFrame:
    """Split winds of a climatology: every (month, day, hour, level) is a slice."""
    c = climate.select("month", "day", "hour", "level", "ilat", "ilon", (F.lit(grid.lat0) + grid.dlat * F.col("ilat")).alias("lat"), F.col("u_bar").alias("u"), F.col("v_bar").alias("v"))
    h = invert.helmholtz(c, ["month", "day", "hour", "level"], grid.sphere)
    return h.withColumnsRenamed({c: f"{c}_bar" for c in ("u", "v", "u_rot", "v_rot", "u_div", "v_div")})


#: What the budget reads of an archive, and which of it changes in time.
WINDS = ("u", "v", "w", "pv")
SPLIT = ("u_rot", "v_rot", "u_div", "v_div")


def with_tendencies(cells: DataFrame) -> DataFrame:
    """d/dt of pv, its mean and its anomaly and, where there is a temperature, of t and theta, by neighbouring hours."""
    cell = ["level", "ilat", "ilon"]
    if "t" in cells.columns:
        cells = cells.withColumn("theta", C.theta(F.col("t"), F.col("level")))
    names = [c for c in ("pv", "pv_bar", "pv_anom", "t", "theta") if c in cells.columns]
    return cells.select("*", *[S.ddt(F.col(c), cell).alias(f"{c}_dt") for c in names])


def with_heating(cells: DataFrame) -> DataFrame:
    """theta_dot (latent heat of rising air), its slope theta_dot_dp and the source Q, from t, q, w and zeta."""
    t, p, q, level = F.col("t"), F.col("level"), F.col("q"), F.col("level")
    c = cells.withColumns({"theta": C.theta(t, p), "theta_e": C.theta_e(t, p, q)})
    c = c.withColumns({f"{x}_dp": S.ddp(F.col(x), ["ts"], level) for x in ("theta", "theta_e")})
    c = c.withColumn("theta_dot", C.latent_heating(F.col("w"), t, p, q, F.col("theta_dp"), F.col("theta_e_dp")))
    c = c.withColumn("theta_dot_dp", S.ddp(F.col("theta_dot"), ["ts"], level))
    return c.withColumn("Q", C.vorticity_source(C.coriolis(F.col("lat")), F.col("zeta"), F.col("theta_dot_dp")))


def budget_fields(cells: DataFrame, climate: DataFrame, config: ComputeConfig, hours: DataFrame | None = None, split_climate: DataFrame | None = None) -> DataFrame:
    """Anomalies, derivatives, sources and all products of gridded hours, once per hour whatever the events.

    ``hours`` (ts): the hours that are wanted; others in ``cells`` only lend
    their values to the tendencies.  With t and q there are theta_dot and the
    source Q.  With ``winds``: rotational and divergent winds with their
    anomalies from ``split_climate`` (columns u_rot_bar, ...; worked out from
    ``climate`` where it isn't given; 0 where it has no value), and the
    divergent winds of the parts of the vertical motion, of which
    w_qg_diabatic and w_lhr_moist are columns of ``cells``.
    """
    g, keys, level = config.grid, ["level", "ilat", "ilon"], ["ts", "level"]
    f = with_tendencies(K.anomaly(cells, climate, list(WINDS), keys))
    if hours is not None:
        f = f.join(hours, "ts", "left_semi")
    # derivatives along one axis together: they share its shuffle
    dx, dy, dp = (lambda c: S.ddx(F.col(c), level, g.dlon)), (lambda c: S.ddy(F.col(c), level, g.dlat)), (lambda c: S.ddp(F.col(c), ["ts"], F.col("level")))
    moist = {"t", "q"} <= set(f.columns)
    f = f.withColumn("_pv", F.col("pv_bar") + F.col("pv_anom"))
    f = f.withColumns({f"{c}_dx": dx(c) for c in ("pv_bar", "pv_anom", "_pv", "v")}).withColumn("pv_dx_dx", dx("_pv_dx"))
    f = f.withColumns({f"{c}_dy": dy(c) for c in ("pv_bar", "pv_anom", "_pv", "u")}).withColumn("pv_dx_dy", dy("_pv_dx")).withColumn("pv_dy_dy", dy("_pv_dy"))
    f = f.withColumn("zeta", F.col("v_dx") - F.col("u_dy")).withColumns({f"{c}_dp": dp(c) for c in ("pv_bar", "pv_anom")}).drop("_pv", "_pv_dx", "_pv_dy", "v_dx", "u_dy")
    if moist:
        f = with_heating(f)
    if config.winds:
        f = invert.helmholtz(f, level, g.sphere)
        if split_climate is None:
            days = f.select("month", "day", "hour").distinct() if hours is None else hours.select(F.month("ts").alias("month"), F.day("ts").alias("day"), F.hour("ts").alias("hour")).distinct()
            at = climate.join(F.broadcast(days), ["month", "day", "hour"], "left_semi")  # at most the calendar's hours
            split_climate = clim_helmholtz(at, g).select("month", "day", "hour", *keys, *[f"{c}_bar" for c in SPLIT])
        f = K.anomaly(f, split_climate, list(SPLIT), keys, "left", 0.0)
        f = invert.with_omega_parts(f, ["ts"], g.sphere)
    return M.product_terms(f)


def event_hours(events: DataFrame, tracks: DataFrame, offsets: Iterable[int], config: ComputeConfig, done: DataFrame | None = None) -> DataFrame:
    """Every wanted hour of every event with its nearest cell."""
    g = config.grid
    hours = P.expand_hours(events, offsets)
    if done is not None:
        hours = P.pending(hours, done, ["event_type", "stage", "dh", "track_id"])
    return P.nearest_cell(P.lagrangian_centre(hours, tracks), "lat_c", "lon_c", g.lat0, g.dlat, g.nlat, g.lon0, g.dlon, g.nlon)


def compute(events: DataFrame, tracks: DataFrame, cells: DataFrame, climate: DataFrame, offsets: Iterable[int], config: ComputeConfig, done: DataFrame | None = None, split_climate: DataFrame | None = None, dealt: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Events to patch cells: hours, moving centres, windows, fields and products.

    Fields are worked out for the hours that some event needs only, and
    written.  An event that cannot be done (no place, no such hour) leaves the
    others alone: ``event_status`` tells of it.  ``dealt`` may deal the patches
    to tasks: the places of their windows, if the fields are few, else their cells.
    """
    g = config.grid
    centres = event_hours(events, tracks, offsets, config, done).filter("lat_c IS NOT NULL AND lon_c IS NOT NULL")
    hours = written(centres.select("ts").distinct(), "hours")
    # the hours before and after lend their values to the tendencies
    halo = hours.select(F.explode(F.array(*[F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(h), F.lit(0), F.lit(0)) for h in (-1, 0, 1)])).alias("ts")).distinct()
    fields = written(budget_fields(cells.join(halo, "ts", "left_semi"), climate, config, hours, split_climate).drop("lat", "lon"), "fields")
    few = fields.count() * len(fields.columns) <= BROADCAST
    cut = P.extract_patches(centres, F.broadcast(fields) if few else fields, config.half_j, config.half_i, g.nlat, g.nlon, ["ts"], dealt=dealt if few else None)
    cut = dealt(cut) if dealt and not few else cut
    return cut.withColumn("x_rel", F.col("ix") * g.dlon).withColumn("y_rel", F.col("iy") * g.dlat)


#: What tells a patch from others.
PATCH = ["event_type", "stage", "dh", "track_id"]


def vertical_means(patches: DataFrame, fields: list[str], levels=MEAN_LEVELS) -> DataFrame:
    """The patches' fields as weighted means over ``levels`` (z is a geopotential), one row a cell of the window."""
    return K.vertical_mean(patches.withColumn("z", C.geopotential_to_m(F.col("z"))), fields, [*PATCH, "iy", "ix"], levels)


def compute_into(root: str, events: DataFrame, tracks: DataFrame, cells: DataFrame, climate: DataFrame, offsets: Iterable[int], config: ComputeConfig, split_climate: DataFrame | None = None) -> int:
    """``compute`` for the patches that are not in the folder ``root`` yet, added to it; how many were wanting.

    Patches lie by type, stage and hour.  What is done is read from the patches
    themselves, so a run that was stopped goes on where it ended, and a
    finished one writes nothing.
    """
    spark, offsets = events.sparkSession, list(offsets)
    try:
        done = read_patches(spark, root).select(*PATCH).distinct()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        done = None
    if done is not None:
        done = written(done, "done")
    wanting = event_hours(events, tracks, offsets, config, done).filter("lat_c IS NOT NULL AND lon_c IS NOT NULL").join(cells.select("ts").distinct(), "ts", "left_semi")
    folder = ["event_type", "stage", "dh"]
    n, most = wanting.select(*PATCH).distinct().groupBy(*folder).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.max("count")).first()
    if n:
        # places are dealt by folder, in as many files as it needs, and sorted by cell: like values lie together
        file, tasks = F.pmod(F.xxhash64("track_id"), F.lit(-(-most // PATCHES))), max(-(-n // PATCHES), spark.sparkContext.defaultParallelism)
        dealt = lambda w: w.repartition(tasks, *folder, file).sortWithinPartitions(*folder, "ts", "ilat", "ilon")
        found = compute(events, tracks, cells, climate, offsets, config, done, split_climate, dealt).filter("level IS NOT NULL")
        with setting(spark, WRITERS, "32"):
            found.write.mode("append").partitionBy(*folder).parquet(root)
    return n


def event_status(events: DataFrame, tracks: DataFrame, cells: DataFrame, offsets: Iterable[int], config: ComputeConfig) -> DataFrame:
    """event_type, stage, track_id, dh, status: ready, no_place or no_field, for every hour of every event."""
    hours = event_hours(events, tracks, offsets, config)
    have = cells.select("ts").distinct().withColumn("_have", F.lit(True))
    status = F.when(F.col("lat_c").isNull() | F.col("lon_c").isNull(), "no_place").when(F.col("_have").isNull(), "no_field").otherwise("ready")
    return hours.join(have, "ts", "left").select("event_type", "stage", "track_id", "dh", status.alias("status"))


def classify(patches: DataFrame, levels: list[int], threshold: int, z: str = "z") -> DataFrame:
    """stage, track_id, label, awb, cwb by the patches at dh = 0."""
    at0 = patches.filter((F.col("dh") == 0) & F.col("level").isin(*levels))
    return overturn.classify_events(at0, ["stage", "track_id"], z, "x_rel", "y_rel", threshold=threshold)


def composite(patches: DataFrame, labels: DataFrame, fields: list[str]) -> DataFrame:
    """Sums and counts by variant, stage, hour, level and cell."""
    members = overturn.variant_members(labels, ["stage", "track_id"]).filter("variant <> 'ALL'")
    return K.build_composites(K.with_variants(patches, members), fields, ["variant", "stage", "dh", "level", "iy", "ix"])


@dataclass(frozen=True)
class BasisConfig:
    """How the six patterns are made: ``blend`` with the hour before (weight of the hour itself), ``smooth_deg`` (full width
    at half maximum; None: not at all), the mask on the smooth first pattern, and whether only the central blob counts."""

    half_j: int
    half_i: int
    dlat: float
    dlon: float
    mask: str | None = "< 0"
    smooth_deg: float | None = 3.0
    central: bool = True
    blend: float | None = None


def basis_cells(cells: DataFrame, keys: list[str], q: str, config: BasisConfig, lat: Column) -> DataFrame:
    """phi1..phi6, s1..s6, mask and w of each unit's patch of ``q`` around latitude ``lat`` (a column of the unit)."""
    g, c = config, cells
    if g.blend is not None:
        c = P.with_previous_hour(c, [*[k for k in keys if k != "dh"], "iy", "ix"], [q])
        c = c.withColumn(q, C.blend(F.col(q), F.col(f"{q}_prev"), g.blend)).drop(f"{q}_prev")
    # scales and blobs are joined back to their cells: written, these are made once
    c = B.prenorm(written(B.raw_basis(c, keys, q, g.dlat, g.dlon, lat), "basis"), keys)
    if g.smooth_deg:
        shape = (2 * g.half_j + 1, 2 * g.half_i + 1)
        c = S.gauss_reflect(c, {p: p for p in B.PHI}, keys, g.smooth_deg, min(g.dlat, g.dlon), *shape, (-g.half_j, -g.half_i))
    c = B.basis_mask(c, g.mask, "phi1")
    if g.central and g.mask is not None:
        c = B.central_blob(written(c, "mask"), keys, "mask").withColumn("mask", F.col("blob")).drop("blob")
    return B.basis_weights(c, F.col("y_rel") + lat)


def decompose(cells: DataFrame, keys: list[str], q: str, terms: list[str], config: BasisConfig, lat: Column) -> DataFrame:
    """Coefficients of terms on the six patterns of ``q`` of each unit, scaled, raw and per square kilometre."""
    return B.project(B.gram(basis_cells(cells, keys, q, config, lat), keys, terms), keys, terms, physical=True)


def status(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """done or missing, and how many."""
    w = wanted.select(*keys).distinct().join(done.select(*keys).distinct().withColumn("_d", F.lit("done")), keys, "left")
    return w.groupBy(F.coalesce("_d", F.lit("missing")).alias("status")).agg(F.count("*").alias("n"))


