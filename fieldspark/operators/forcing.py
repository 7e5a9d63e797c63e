"""Forcing of the quasi-geostrophic balance, term by term, and its residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.columns import coriolis, taper
from fieldspark.functions.constants import CP_DRY, KAPPA, OMEGA, R_DRY, R_EARTH
from fieldspark.operators import stencil as S


def _pa() -> Column:
    return F.col("level") * 100.0


def qg_forcing(df: DataFrame, keys: list[str], dlat: float, dlon: float, centre_lat: float, thermal_wind: bool = True) -> DataFrame:
    """Adds forcing_a (Q-vector divergence) and forcing_b (beta term) of the wind ug, vg.

    ``thermal_wind``: temperature gradients from the wind's slope in pressure
    at the latitude ``centre_lat``; else from t itself.
    """
    lat = F.col("lat")
    cos, tan, ramp = F.cos(F.radians(lat)), F.tan(F.radians(lat)), taper(lat)
    df = df.withColumn("_u", F.col("ug") * ramp).withColumn("_v", F.col("vg") * ramp)
    df = df.withColumn("_up", S.ddp(F.col("_u"), keys, F.col("level"))).withColumn("_vp", S.ddp(F.col("_v"), keys, F.col("level")))
    slices = [*keys, "level"]
    for c in ("_u", "_v"):
        df = df.withColumn(f"{c}l", S.d_dlambda(F.col(c), slices, dlon))
        df = df.withColumn(f"{c}f", S.d_dphi(F.col(c), slices, dlat))
    if thermal_wind:
        f0 = coriolis(F.lit(float(centre_lat)))
        df = df.withColumn("_tl", f0 * _pa() / R_DRY * -F.col("_vp") * R_EARTH * cos).withColumn("_tf", f0 * _pa() / R_DRY * F.col("_up") * R_EARTH)
    else:
        df = df.withColumn("_tl", S.d_dlambda(F.col("t"), slices, dlon)).withColumn("_tf", S.d_dphi(F.col("t"), slices, dlat))
    qx = (F.col("_tf") * (F.col("_vl") / cos + F.col("_u") * tan) - F.col("_tl") / cos * F.col("_vf")) / R_EARTH**2
    qy = (F.col("_tf") * (-F.col("_ul") / cos + F.col("_v") * tan) + F.col("_tl") / cos * F.col("_uf")) / R_EARTH**2
    df = df.withColumn("_qx", qx * ramp).withColumn("_qy", qy * ramp)
    df = S.with_divergence(df, "_qx", "_qy", "_dq", slices, dlat, dlon)
    beta = 2 * OMEGA * cos / R_EARTH
    df = df.withColumn("forcing_a", 2.0 * R_DRY / _pa() * F.col("_dq")).withColumn("forcing_b", coriolis(lat) * beta * F.col("_vp") * ramp)
    return df.drop("_u", "_v", "_up", "_vp", "_ul", "_uf", "_vl", "_vf", "_tl", "_tf", "_qx", "_qy", "_dq")


def budget_heating(df: DataFrame, keys: list[str], dlat: float, dlon: float) -> DataFrame:
    """Adds forcing_c = -(kappa / p) laplacian(J), J from the temperature budget.

    Needs t, t_dt, u, v, w and sigma (static stability).
    """
    slices = [*keys, "level"]
    step = S.dx_m(F.col("lat"), dlon, 0.1, dlat)
    df = df.withColumn("_tx", S.centred(F.col("t"), [*slices, "ilat"], "ilon", step, True)).withColumn("_ty", S.ddy(F.col("t"), slices, dlat))
    j1 = CP_DRY * (F.coalesce("t_dt", F.lit(0.0)) + F.col("u") * F.col("_tx") + F.col("v") * F.col("_ty"))
    j2 = -F.col("sigma") * (_pa() / R_DRY) * CP_DRY * F.col("w")
    df = S.with_laplacian(df.withColumn("_j", j1 + j2), "_j", "_lj", slices, dlat, dlon)
    return df.withColumn("forcing_c", -(KAPPA / _pa()) * F.col("_lj")).drop("_tx", "_ty", "_j", "_lj")


def latent_heating_forcing(df: DataFrame, keys: list[str], dlat: float, dlon: float) -> DataFrame:
    """Adds forcing_l = -(kappa / p) laplacian(c_p theta_dot t / theta)."""
    j = CP_DRY * F.coalesce("theta_dot", F.lit(0.0)) * F.col("t") / F.greatest(F.col("theta"), F.lit(1.0))
    df = S.with_laplacian(df.withColumn("_j", j), "_j", "_lj", [*keys, "level"], dlat, dlon)
    return df.withColumn("forcing_l", -(KAPPA / _pa()) * F.col("_lj")).drop("_j", "_lj")


def qg_residual(df: DataFrame, omega: str, forcing: str, keys: list[str], dlat: float, dlon: float, centre_lat: float) -> DataFrame:
    """Adds residual = forcing - (laplacian(sigma omega) + f0^2 d2 omega / dp2) at inner cells."""
    df = S.with_laplacian(df.withColumn("_so", F.col("sigma") * F.col(omega)), "_so", "_lo", [*keys, "level"], dlat, dlon)
    df = df.withColumn("_op", S.ddp(F.col(omega), keys, F.col("level")))
    df = df.withColumn("_opp", S.ddp(F.col("_op"), keys, F.col("level")))
    f0 = coriolis(F.lit(float(centre_lat)))
    return df.withColumn("residual", F.col(forcing) - F.col("_lo") - f0 * f0 * F.col("_opp")).drop("_so", "_lo", "_op", "_opp")
