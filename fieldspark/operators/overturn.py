"""Overturning of contours, from the crossings of each meridian.

A contour of level ``lev`` is kept as the places where a column of cells
crosses it; counts, envelopes, areas and slopes need nothing else.  A level's
closed pieces count with its long line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILT = 0.15


def probe_levels(cells: DataFrame, keys: list[str], z: str, n: int) -> DataFrame:
    """keys, lev: n values evenly between the unit's least and largest, ends left out."""
    r = cells.groupBy(*keys).agg(F.min(z).alias("_a"), F.max(z).alias("_b"))
    k = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k")
    return r.select(*keys, "_a", "_b", k).select(*keys, "k", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("k") / (n + 1)).alias("lev"))


def crossings(cells: DataFrame, levels: DataFrame, keys: list[str], z: str, x: str, y: str) -> DataFrame:
    """keys, k, lev, ix, x, y of every crossing, linear between rows."""
    w = Window.partitionBy(*keys, "ix").orderBy("iy")
    c = cells.select(*keys, "ix", "iy", F.col(x).alias("x"), F.col(y).alias("_y0"), F.col(z).alias("_z0"), F.lead(z).over(w).alias("_z1"), F.lead(y).over(w).alias("_y1"))
    j = c.join(levels, keys) if keys else c.crossJoin(F.broadcast(levels))
    a, b = F.col("_z0") - F.col("lev"), F.col("_z1") - F.col("lev")
    hit = j.filter(((a < 0) & (b >= 0)) | ((a >= 0) & (b < 0)))
    return hit.select(*keys, "k", "lev", "ix", "iy", "x", (F.col("_y0") + (F.col("lev") - F.col("_z0")) / (F.col("_z1") - F.col("_z0")) * (F.col("_y1") - F.col("_y0"))).alias("y"))


def circumpolar(cross: DataFrame, keys: list[str], span: float = 355.0) -> DataFrame:
    """Levels that go around: by span of x, all latitudes at or north of 0, and columns covered."""
    g = cross.groupBy(*keys, "k").agg((F.max("x") - F.min("x")).alias("span"), F.min("y").alias("south"), F.count_distinct("ix").alias("columns"))
    return g.withColumn("around", (F.col("span") >= span) & (F.col("south") >= 0))


def crop_to_patch(cross: DataFrame, keys: list[str], x_half: float, y_half: float, least: int = 10) -> DataFrame:
    """Crossings inside the patch, of the longest run of columns; levels with fewer than ``least`` are dropped."""
    from fieldspark.operators.tracks import longest_run

    inside = cross.filter((F.abs("x") <= x_half) & (F.abs("y") <= y_half))
    columns = longest_run(inside.select(*keys, "k", "ix").distinct(), [*keys, "k"], "ix")
    kept = inside.join(columns, [*keys, "k", "ix"], "left_semi")
    return kept.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "k"))).filter(F.col("_n") >= least).drop("_n")


def sample_levels(levels: DataFrame, keys: list[str], most: int = 12) -> DataFrame:
    """At most ``most`` levels of each unit, evenly by rank (ends included)."""
    w = Window.partitionBy(*keys)
    r = levels.withColumn("_r", F.row_number().over(w.orderBy("lev")) - 1).withColumn("_n", F.count("*").over(w))
    slot = F.round(F.col("_r") * (most - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    ideal = F.round(slot * (F.col("_n") - 1) / (most - 1))
    return r.filter((F.col("_n") <= most) | (ideal == F.col("_r"))).drop("_r", "_n")


def overturn_intervals(cross: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """keys, k, run, ix, n, y_min, y_max, x of columns with ``least`` crossings or more; run: neighbouring columns."""
    c = cross.groupBy(*keys, "k", "ix").agg(F.count("*").alias("n"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.first("x").alias("x")).filter(F.col("n") >= least)
    return c.withColumn("run", F.col("ix") - F.row_number().over(Window.partitionBy(*keys, "k").orderBy("ix")))


def bays(intervals: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """One row per interval: columns, xa, xb, signed area and centroid of its envelope, slope of its middle line.

    The polygon runs along the lower edge and back along the upper one; its
    sums split into those of neighbouring columns and of the two ends.
    """
    w = Window.partitionBy(*keys, "k", "run").orderBy("ix")
    lead = lambda c: F.lead(c).over(w)
    cross = lambda ax, ay, bx, by: ax * by - bx * ay
    x, lo, hi = F.col("x"), F.col("y_min"), F.col("y_max")
    i = intervals.withColumn("_x1", lead("x")).withColumn("_lo1", lead("y_min")).withColumn("_hi1", lead("y_max"))
    i = i.withColumn("_first", F.lag("ix").over(w).isNull())
    x1, lo1, hi1 = F.col("_x1"), F.col("_lo1"), F.col("_hi1")
    low, up = cross(x, lo, x1, lo1), cross(x1, hi1, x, hi)
    end_l, end_r = F.when(F.col("_first"), cross(x, hi, x, lo)), F.when(x1.isNull(), cross(x, lo, x, hi))
    total = lambda f: F.coalesce(F.sum(f), F.lit(0.0))
    g = i.groupBy(*keys, "k", "run").agg(
        F.count("*").alias("columns"), F.min("x").alias("xa"), F.max("x").alias("xb"),
        ((total(low) + total(up) + total(end_l) + total(end_r)) / 2).alias("area"),
        (total((x + x1) * low) + total((x + x1) * up) + total(2 * x * end_l) + total(2 * x * end_r)).alias("_cx"),
        (total((lo + lo1) * low) + total((hi + hi1) * up) + total((lo + hi) * end_l) + total((lo + hi) * end_r)).alias("_cy"),
        F.when(F.count("*") >= 3, F.regr_slope((lo + hi) / 2, x)).alias("slope"),
        F.array_sort(F.collect_list(F.struct("x", "y_min", "y_max"))).alias("envelope"),
    ).filter(F.col("columns") >= least)
    some = F.abs("area") > 1e-9
    g = g.withColumn("cx", F.when(some, F.col("_cx") / (6 * F.col("area")))).withColumn("cy", F.when(some, F.col("_cy") / (6 * F.col("area"))))
    return g.drop("_cx", "_cy")


def classify_tilt(slope: Column, threshold: float = TILT) -> Column:
    return F.when(slope < -threshold, "AWB").when(slope > threshold, "CWB").otherwise("UNK")


def classify_bay(bay_rows: DataFrame, cross: DataFrame, keys: list[str]) -> DataFrame:
    """Adds wb_type by where the line enters the fold: from its west, at the top or the bottom edge.

    The single crossing of the last column west of the fold is compared with
    the fold's first column: nearer to its top means the top comes first
    ("CWB"), nearer to the bottom "AWB"; no such column: "UNK".
    """
    single = cross.groupBy(*keys, "k", "ix").agg(F.count("*").alias("_n"), F.first("x").alias("_x"), F.first("y").alias("_y")).filter("_n = 1")
    j = bay_rows.join(single, [*keys, "k"], "left").withColumn("_w", F.when(F.col("_x") < F.col("xa"), F.struct(F.col("_x"), F.col("_y"))))
    ids = [c for c in bay_rows.columns if c != "envelope"]
    g = j.groupBy(*ids).agg(F.max("_w").alias("_w"), F.first("envelope").alias("envelope"))
    first = F.get("envelope", F.lit(0))
    top, bottom = F.abs(F.col("_w._y") - first["y_max"]), F.abs(F.col("_w._y") - first["y_min"])
    kind = F.when(F.col("_w").isNull() | (top == bottom), "UNK").when(top < bottom, "CWB").otherwise("AWB")
    return g.withColumn("wb_type", kind).drop("_w")


def detect_bays(cells: DataFrame, keys: list[str], z: str, x: str, y: str, method: str = "bay", source: str = "patch", n_levels: int = 12, min_cross: int = 3, least_columns: int = 2, half: tuple[float, float] | None = None) -> DataFrame:
    """Overturning bays of every unit with wb_type, from cells to classes.

    ``source``: "patch" takes the contours of the patch itself; "hemisphere"
    those that go around a whole ring, cut to ``half`` (x, y) about the centre
    (x, y relative to it).  ``method``: "bay" types by the order of the path,
    "tilt" by the slope of the middle line.
    """
    if method not in ("bay", "tilt") or source not in ("patch", "hemisphere"):
        raise ValueError(f"method {method!r}, source {source!r}")
    cross = crossings(cells, probe_levels(cells, keys, z, n_levels), keys, z, x, y)
    if source == "hemisphere":
        around = circumpolar(cross, keys).filter(F.col("span") >= 345.0)  # latitudes are relative here
        cross = cross.join(around.select(*keys, "k"), [*keys, "k"], "left_semi")
        if half:
            cross = crop_to_patch(cross, keys, *half)
    found = bays(overturn_intervals(cross, keys, min_cross), keys, least_columns)
    if method == "bay":
        return classify_bay(found, cross, keys)
    return found.withColumn("wb_type", classify_tilt(F.col("slope")))


def gate_bays(bay_rows: DataFrame, least_area: float, x_gate: float | None = None) -> DataFrame:
    b = bay_rows.filter(F.abs("area") >= least_area)
    return b.filter(F.abs("cx") <= x_gate) if x_gate is not None else b


def classify_level(bay_rows: DataFrame, keys: list[str], least_area: float = 0.0) -> DataFrame:
    """Per unit (level included): is there an AWB, a CWB?  Types left open go by the slope's sign."""
    kind = F.when(F.col("wb_type") != "UNK", F.col("wb_type")).when(F.col("slope") < 0, "AWB").when(F.col("slope") > 0, "CWB")
    b = bay_rows.filter(F.abs("area") > least_area).withColumn("_t", kind)
    return b.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("_t") == "AWB"), F.lit(False)).alias("awb"), F.coalesce(F.bool_or(F.col("_t") == "CWB"), F.lit(False)).alias("cwb"))


def classify_multilevel(flags: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    n = lambda c: F.sum(F.col(c).cast("int"))
    return flags.groupBy(*keys).agg((n("awb") >= threshold).alias("awb"), (n("cwb") >= threshold).alias("cwb"))


def label_variants(votes: DataFrame) -> DataFrame:
    """Adds label: Omega (both), AWB, CWB or NEUTRAL."""
    return votes.withColumn("label", F.when(F.col("awb") & F.col("cwb"), "Omega").when(F.col("awb"), "AWB").when(F.col("cwb"), "CWB").otherwise("NEUTRAL"))


def variant_members(labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, variant: ALL; AWB and CWB (both hold Omega); NEUTRAL; Omega."""
    v = F.array_compact(F.array(F.lit("ALL"), F.when(F.col("awb"), "AWB"), F.when(F.col("cwb"), "CWB"), F.when(F.col("awb") & F.col("cwb"), "Omega"), F.when(~F.col("awb") & ~F.col("cwb"), "NEUTRAL")))
    return labels.select(*keys, F.explode(v).alias("variant"))


def classify_events(cells: DataFrame, keys: list[str], z: str, x: str, y: str, n_levels: int = 12, threshold: int = 1, min_cross: int = 3, least_columns: int = 2) -> DataFrame:
    """From cells (keys, level, iy, ix) to one label per unit; units without bays are NEUTRAL."""
    unit = [*keys, "level"]
    lv = sample_levels(probe_levels(cells, unit, z, n_levels), unit)
    cr = crossings(cells, lv, unit, z, x, y)
    b = classify_bay(bays(overturn_intervals(cr, unit, min_cross), unit, least_columns), cr, unit)
    votes = classify_multilevel(classify_level(b, unit), keys, threshold)
    every = cells.select(*keys).distinct().join(votes, keys, "left")
    every = every.withColumn("awb", F.coalesce("awb", F.lit(False))).withColumn("cwb", F.coalesce("cwb", F.lit(False)))
    return label_variants(every)
