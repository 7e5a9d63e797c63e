"""Fields on surfaces of constant potential temperature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.columns import theta
from fieldspark.functions.constants import KAPPA
from fieldspark.operators import basis
from fieldspark.operators.composite import build_composites, composite_mean
from fieldspark.operators.terms import signed_sum


def bracket(cells: DataFrame, keys: list[str], targets: list[float], theta: str = "theta", carry: tuple[str, ...] = (), from_below: bool = True) -> DataFrame:
    """Neighbouring levels (in order of falling pressure) whose theta encloses each target.

    One row per column and target: theta_level, and <c>_lo, <c>_hi of level,
    theta and ``carry``; of several pairs the first from below (or above).
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("level"))
    cols = ("level", theta, *carry)
    c = cells.select(*keys, *[F.col(x).alias(f"{x}_lo") for x in cols], *[F.lead(x).over(w).alias(f"{x}_hi") for x in cols])
    t = F.explode(F.array(*[F.lit(float(x)) for x in targets])).alias("theta_level")
    lo, hi = F.least(f"{theta}_lo", f"{theta}_hi"), F.greatest(f"{theta}_lo", f"{theta}_hi")
    hit = c.filter(F.col(f"{theta}_lo").isNotNull() & F.col(f"{theta}_hi").isNotNull()).select("*", t).filter((F.col("theta_level") >= lo) & (F.col("theta_level") <= hi))
    pick = F.max_by if from_below else F.min_by
    vals = [x for x in c.columns if x not in keys]
    best = hit.groupBy(*keys, "theta_level").agg(pick(F.struct(*vals), F.col("level_lo")).alias("b"))
    return best.select(*keys, "theta_level", "b.*")


def to_theta(cells: DataFrame, keys: list[str], targets: list[float], fields: list[str], theta: str = "theta") -> DataFrame:
    """Fields linear in theta between sorted levels; targets out of range give no row."""
    w = Window.partitionBy(*keys).orderBy(theta)
    c = cells.filter(F.col(theta).isNotNull())
    c = c.select(*keys, F.col(theta).alias("_t0"), F.lead(theta).over(w).alias("_t1"), *[x for f in fields for x in (F.col(f).alias(f"_{f}0"), F.lead(f).over(w).alias(f"_{f}1"))])
    t = F.explode(F.array(*[F.lit(float(x)) for x in targets])).alias("theta_level")
    hit = c.select("*", t).filter((F.col("theta_level") >= F.col("_t0")) & (F.col("theta_level") <= F.col("_t1")))
    part = F.when(F.col("_t1") > F.col("_t0"), (F.col("theta_level") - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))).otherwise(0.0)
    vals = F.struct("_t0", *[(F.col(f"_{f}0") + part * (F.col(f"_{f}1") - F.col(f"_{f}0"))).alias(f) for f in fields])
    best = hit.groupBy(*keys, "theta_level").agg(F.min_by(vals, "_t0").alias("b"))
    return best.select(*keys, "theta_level", *[F.col(f"b.{f}").alias(f) for f in fields])


def newton_pressure(target: Column, p0: Column, t0: Column, p1: Column, t1: Column, n_iter: int = 12) -> Column:
    """Pressure (hPa) where theta = target with temperature linear in ln p between two levels."""
    a = (t1 - t0) / (F.log(p1) - F.log(p0))
    b = t1 - a * F.log(p1)
    pok = 1000.0**KAPPA

    def step(x: Column, _: Column) -> Column:
        e = pok * F.exp(-KAPPA * x)
        t = a * x + b
        return x - (target - e * t) / (e * (KAPPA * t - a))

    return F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(n_iter)), 0.5 * (F.log(p0) + F.log(p1)), step))


def theta_pressure(cells: DataFrame, keys: list[str], targets: list[float], theta: str = "theta", t: str = "t", from_below: bool = True) -> DataFrame:
    b = bracket(cells, keys, targets, theta, (t,), from_below)
    p = newton_pressure(F.col("theta_level"), F.col("level_lo").cast("double"), F.col(f"{t}_lo"), F.col("level_hi").cast("double"), F.col(f"{t}_hi"))
    return b.select(*keys, "theta_level", p.alias("p_theta"))


def isentropic(cells: DataFrame, keys: list[str], targets: list[float], fields: list[str]) -> DataFrame:
    """Pressure and fields on every surface."""
    return theta_pressure(cells, keys, targets).join(to_theta(cells, keys, targets, fields), [*keys, "theta_level"], "full")


def threshold_pressure(cells: DataFrame, keys: list[str], field: str, value: float, direction: str = "from_top") -> DataFrame:
    """keys, p_cross: pressure where ``field`` first crosses ``value`` along the column."""
    w = Window.partitionBy(*keys).orderBy(F.asc("level") if direction == "from_top" else F.desc("level"))
    c = cells.select(*keys, "level", F.col(field).alias("_f"), F.lead("level").over(w).alias("_l1"), F.lead(field).over(w).alias("_f1"), F.row_number().over(w).alias("_r"))
    hit = c.filter(((F.col("_f") - value) * (F.col("_f1") - value) <= 0) & (F.col("_f") != F.col("_f1")))
    p = F.col("level") + (value - F.col("_f")) / (F.col("_f1") - F.col("_f")) * (F.col("_l1") - F.col("level"))
    return hit.groupBy(*keys).agg(F.min_by(p, "_r").alias("p_cross"))


def isentropic_events(patches: DataFrame, unit: list[str], targets: list[float], spec, t: str = "t") -> DataFrame:
    """unit, iy, ix, theta_level, value: a variable spec of every event's patch on surfaces of theta."""
    cells = patches.select(*unit, "iy", "ix", theta(F.col(t), F.col("level")).alias("theta"), signed_sum(spec).alias("value"))
    return to_theta(cells, [*unit, "iy", "ix"], targets, ["value"])


def isentropic_composite(on_theta: DataFrame) -> DataFrame:
    """theta_level, iy, ix: sum_value and n_value over all events."""
    return build_composites(on_theta, ["value"], ["theta_level", "iy", "ix"])


def isentropic_projection(on_theta: DataFrame, unit: list[str], dlat: float, dlon: float, lat: float = 45.0, mask=None) -> DataFrame:
    """unit, theta_level and the coefficients of every event on the six patterns of the surface's composite."""
    keys = ["theta_level"]
    mean = composite_mean(isentropic_composite(on_theta), ["value"]).withColumnRenamed("value", "mean")
    mean = mean.withColumn("y_rel", F.col("iy") * dlat)
    c = basis.prenorm(basis.raw_basis(mean, keys, "mean", dlat, dlon, F.lit(lat)), keys)
    c = basis.basis_weights(basis.basis_mask(c, mask, "mean"), F.col("y_rel") + lat)
    cells = on_theta.join(c, [*keys, "iy", "ix"])
    return basis.project(basis.gram(cells, [*unit, *keys], ["value"]), [*unit, *keys], ["value"])
