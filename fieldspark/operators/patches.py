"""Events, hours, moving centres and event-centred patches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions.columns import great_circle_deg, wrap_lon


def expand_hours(events: DataFrame, offsets: Iterable[int]) -> DataFrame:
    """One row per event and hour offset: dh and ts = base_ts + dh hours."""
    offsets = list(offsets)
    dh = F.explode(F.array(*[F.lit(int(h)) for h in offsets])).alias("dh")
    return events.select("*", dh).withColumn("ts", F.col("base_ts") + F.make_dt_interval(F.lit(0), F.col("dh"), F.lit(0), F.lit(0)))


def window_months(events: DataFrame, first: int, last: int) -> DataFrame:
    """Adds year and month of every month that base_ts + first..last hours touches: keys for partition pruning."""
    at = lambda h: F.col("base_ts") + F.make_dt_interval(F.lit(0), F.lit(h), F.lit(0), F.lit(0))
    months = F.sequence(F.trunc(at(first).cast("date"), "month"), F.trunc(at(last).cast("date"), "month"), F.expr("INTERVAL 1 MONTH"))
    m = events.withColumn("_m", F.explode(months))
    return m.withColumn("year", F.year("_m")).withColumn("month", F.month("_m")).drop("_m")


def lagrangian_centre(events_dh: DataFrame, tracks: DataFrame) -> DataFrame:
    """Adds lat_c, lon_c: the track's place at ts, else the event's own."""
    t = tracks.select("track_id", "ts", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    j = events_dh.join(t, ["track_id", "ts"], "left")
    return j.withColumn("lat_c", F.coalesce("_lat", "lat0")).withColumn("lon_c", F.coalesce("_lon", "lon0")).drop("_lat", "_lon")


def nearest_cell(df: DataFrame, lat: str, lon: str, lat0: float, dlat: float, nlat: int, lon0: float, dlon: float, nlon: int) -> DataFrame:
    """Adds jc, ic (nearest row; nearest column on the ring)."""
    j = F.floor((F.col(lat) - lat0) / dlat + 0.5)
    i = F.pmod(F.floor((F.col(lon) - lon0) / dlon + 0.5), F.lit(nlon))
    return df.withColumn("jc", F.least(F.greatest(j, F.lit(0)), F.lit(nlat - 1)).cast("int")).withColumn("ic", i.cast("int"))


def extract_patches(centres: DataFrame, field: DataFrame, half_j: int, half_i: int, nlat: int, nlon: int, keys: list[str], wrap: bool = True, partial: bool = True, dealt: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Cells of the window around every centre (jc, ic), one row per iy, ix and level.

    The window is exploded on the side of the centres and joined by equality;
    rows beyond a pole stay, with NULL fields.  ``wrap``: the ring closes, else
    columns beyond it are left out.  ``partial`` = False drops centres whose
    window leaves the grid.  ``dealt`` may deal the places of the windows to
    tasks before they get their fields.
    """
    rows = F.explode(F.sequence(F.lit(-half_j), F.lit(half_j)))
    cols = F.explode(F.sequence(F.lit(-half_i), F.lit(half_i)))
    w = centres if partial else centres.filter((F.col("jc") >= half_j) & (F.col("jc") < nlat - half_j))
    w = w.select("*", rows.alias("iy")).select("*", cols.alias("ix"))
    w = w.withColumn("ilat", F.col("jc") + F.col("iy")).withColumn("_i", F.col("ic") + F.col("ix"))
    if not wrap:
        w = w.filter((F.col("_i") >= 0) & (F.col("_i") < nlon))
    w = w.withColumn("ilon", F.pmod("_i", F.lit(nlon)).cast("int")).drop("_i")
    return (dealt(w) if dealt else w).join(field, [*keys, "ilat", "ilon"], "left")


def sample_to_patch(grid_df: DataFrame, cells: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Values of a full-grid result at patch cells (ilat, ilon known)."""
    return cells.join(grid_df.select(*keys, "ilat", "ilon", *fields), [*keys, "ilat", "ilon"], "left")


#: Events of an hour that a task matches; distances that it holds at once.
EVENTS, DISTANCES = 100_000, 1 << 20


def _folded(lon: np.ndarray) -> np.ndarray:
    """``wrap_lon`` for arrays."""
    d = np.fmod(lon + 180.0, 360.0)
    return np.where(d < 0, np.fmod(d + 360.0, 360.0), d) - 180.0


def _best(dist: np.ndarray, rank: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least distance, least rank that has it) of runs of candidates."""
    least = np.minimum.reduceat(dist, begin)
    return least, np.minimum.reduceat(np.where(dist == np.repeat(least, size), rank, len(dist) + rank.max() + 1), begin)


def _nearest(lat0: np.ndarray, lon0: np.ndarray, shrink: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, place) of the track nearest to each event, all finite; ties to the first.

    Tracks lie on the ring of longitudes.  The least distance to the about
    sqrt(n) next ones by longitude bounds the arc in which a nearer one can be.
    """
    n = len(lat)
    x = _folded(lon)
    order = np.argsort(x, kind="stable")
    ring, place = np.concatenate([x[order] - 360.0, x[order], x[order] + 360.0]), np.tile(order, 3)
    few, e = int(np.ceil(np.sqrt(n))), _folded(lon0)
    found, at = np.empty(len(e)), np.empty(len(e), np.int64)
    lo = np.searchsorted(ring, e) - few // 2
    hi = lo + few
    for last in (False, True):
        if last:
            with np.errstate(divide="ignore"):
                half = np.minimum(found / np.abs(shrink) * (1 + 1e-9) + 1e-9, 180.0)
            lo, hi = np.searchsorted(ring, e - half, "left"), np.searchsorted(ring, e + half, "right")
            hi = np.minimum(hi, lo + n)
        size = hi - lo
        upto = np.concatenate([[0], np.cumsum(size)])
        i = 0
        while i < len(e):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + DISTANCES, "right")) - 1)
            begin = upto[i:j] - upto[i]
            who = np.repeat(np.arange(i, j), size[i:j])
            c = place[np.arange(upto[j] - upto[i]) - np.repeat(begin - lo[i:j], size[i:j])]
            d = np.sqrt((lat[c] - lat0[who]) ** 2 + (_folded(lon[c] - lon0[who]) * shrink[who]) ** 2)
            found[i:j], at[i:j] = _best(d, c, begin, size[i:j])
            i = j
    return found, at


def _matched(columns: list[str]) -> Callable:
    """Events of an hour with the nearest of its tracks; distances that are no numbers count as larger, those that are missing as largest."""

    def work(events: pa.Table, tracks: pa.Table) -> pa.Table:
        tracks = tracks.sort_by("match_id")
        events = events.slice(0, events.num_rows if tracks.num_rows else 0)
        numbers = lambda t, c: t.column(c).to_numpy().astype(np.float64)
        lat0, lon0, shrink = (numbers(events, c) for c in ("lat0", "lon0", "_shrink"))
        lat, lon = (numbers(tracks, c) for c in ("_lat", "_lon"))
        good, usable = np.isfinite(lat0) & np.isfinite(lon0) & np.isfinite(shrink), np.flatnonzero(np.isfinite(lat) & np.isfinite(lon))
        if not len(usable):
            good[:] = False
        dist, at, known = np.full(events.num_rows, np.nan), np.zeros(events.num_rows, np.int64), good.copy()
        if good.any():
            dist[good], place = _nearest(lat0[good], lon0[good], shrink[good], lat[usable], lon[usable])
            at[good] = usable[place]
        there = ~(pc.is_null(tracks.column("_lat")).to_numpy() | pc.is_null(tracks.column("_lon")).to_numpy())
        given = ~(pc.is_null(events.column("lat0")).to_numpy() | pc.is_null(events.column("lon0")).to_numpy())
        for i in np.flatnonzero(~good & given):
            with np.errstate(invalid="ignore"):
                d = np.sqrt((lat - lat0[i]) ** 2 + (_folded(lon - lon0[i]) * shrink[i]) ** 2)
            at[i] = np.lexsort((d, np.isnan(d), ~there))[0]
            dist[i], known[i] = d[at[i]], there[at[i]]
        found = events.select(columns).append_column("match_id", tracks.column("match_id").take(pa.array(at)))
        return found.append_column("dist", pa.array(dist, mask=~known))

    return work


def match_track(events: DataFrame, tracks: DataFrame) -> DataFrame:
    """The track nearest to each event at its own hour; ties to the smaller id.

    Events without a track at that hour give no row.  An hour's tracks, three
    numbers each, and a block of its events meet in a task; no pair becomes a row.
    """
    columns = events.columns
    t = tracks.select(F.col("track_id").alias("match_id"), "ts", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    e = events.distinct().withColumns({"_shrink": F.cos(F.radians("lat0")), "_hour": F.col("base_ts")})
    blocks = e.groupBy("_hour").agg(F.ceil(F.count("*") / EVENTS).alias("_blocks"))
    e = e.join(blocks, "_hour").withColumn("_block", F.pmod(F.xxhash64(*columns), "_blocks")).drop("_blocks")
    t = t.withColumnRenamed("ts", "_hour").join(blocks, "_hour").select("match_id", "_lat", "_lon", "_hour", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"))
    schema = T.StructType([*events.schema, T.StructField("match_id", tracks.schema["track_id"].dataType), T.StructField("dist", T.DoubleType())])
    return e.groupBy("_hour", "_block").cogroup(t.groupBy("_hour", "_block")).applyInArrow(_matched(columns), schema)


def track_window(tracks: DataFrame, ref: DataFrame, n: int) -> DataFrame:
    """Rows of a track within n places of its row nearest in time to ref_ts (ties: the earlier)."""
    rn = tracks.withColumn("rn", F.row_number().over(Window.partitionBy("track_id").orderBy("ts")))
    j = rn.join(ref, "track_id")
    gap = F.abs(F.unix_seconds("ts") - F.unix_seconds("ref_ts"))
    near = F.min(F.struct(gap.alias("g"), F.col("rn").alias("r"))).over(Window.partitionBy("track_id", "ref_ts"))["r"]
    return j.withColumn("at", F.col("rn") - near).filter(F.abs("at") <= n).drop("rn")


def with_previous_hour(cells: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Adds <field>_prev from dh - 1 of the same track and cell; a first or lone hour gets its own values."""
    before = cells.select(*keys, (F.col("dh") + 1).alias("dh"), *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_has"))
    # a row for each cell: its few bytes in a file tell Spark to broadcast what takes a gigabyte in memory
    j = cells.join(before.hint("merge"), [*keys, "dh"], "left")
    for f in fields:
        j = j.withColumn(f"{f}_prev", F.when(F.col("_has"), F.col(f"_{f}")).otherwise(F.col(f))).drop(f"_{f}")
    return j.drop("_has")


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that has no result yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def following_tendency(field: str, keys: list[str]) -> Column:
    """(value at dh + 1 - value at dh - 1) / 7200 s of cells that were cut at their own centres; NULL without both hours."""
    hour = Window.partitionBy(*keys).orderBy("dh")
    return (F.first(field).over(hour.rangeBetween(1, 1)) - F.first(field).over(hour.rangeBetween(-1, -1))) / 7200.0


def frame_tendency(centres: DataFrame, field: DataFrame, value: str, half_j: int, half_i: int, nlat: int, nlon: int, keys: list[str], before: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """keys, level, iy, ix, tendency: what changes within the window from the hour before to the hour after, per second.

    ``centres`` has keys, ts, jc, ic.  Without ``before`` and ``after`` both
    hours are cut at the centre of the hour between (a fixed frame); with them
    (keys, jc, ic) each is cut at its own (a moving frame).  NULL where an hour
    or a value is missing.
    """
    hour = lambda n: F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(n), F.lit(0), F.lit(0))
    found = []
    for n, own in ((-1, before), (1, after)):
        at = centres.select(*keys, hour(n).alias("ts"), *([] if own is not None else ["jc", "ic"]))
        at = at.join(own.select(*keys, "jc", "ic"), keys) if own is not None else at
        cut = extract_patches(at, field.select("ts", "level", "ilat", "ilon", value), half_j, half_i, nlat, nlon, ["ts"])
        found.append(cut.filter("level IS NOT NULL").select(*keys, "level", "iy", "ix", F.col(value).alias(f"_{n + 1}")))
    both = found[0].join(found[1], [*keys, "level", "iy", "ix"], "full")
    return both.select(*keys, "level", "iy", "ix", ((F.col("_2") - F.col("_0")) / 7200.0).alias("tendency"))


def centre_distance(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    return great_circle_deg(lat0, lon0, lat, wrap_lon(lon))
