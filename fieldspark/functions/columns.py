"""Column functions: cleaning, calendar, geometry and thermodynamics.

Every function takes and returns Columns and stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldspark.functions.constants import CP_DRY, F_MIN_LAT, G0, KAPPA, L_VAPOUR, OMEGA, R_DRY, R_EARTH, R_VAPOUR, TAPER_HIGH, TAPER_LOW, TAPER_POLAR

# --- missing values ---


def finite(c: Column) -> Column:
    """NaN and infinities become NULL, which all aggregates skip."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def nan_to_zero(c: Column) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


# --- axes and keys ---


def wrap_lon(lon: Column) -> Column:
    """Longitude folded to [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def nearest_index(x: Column, first: float, step: float) -> Column:
    """Index of the nearest point of a regular axis, ties upwards."""
    return F.floor((x - first) / step + 0.5).cast("int")


def great_circle_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in degrees with longitudes shrunk by the cosine of the first latitude."""
    dlon = wrap_lon(lon2 - lon1) * F.cos(F.radians(lat1))
    return F.sqrt(F.pow(lat2 - lat1, 2) + F.pow(dlon, 2))


def deg_to_m(deg: Column) -> Column:
    return F.radians(deg) * R_EARTH


def m2_to_km2(c: Column) -> Column:
    return c / 1e6


def track_id_of(name: Column) -> Column:
    """First number after ``track_`` in a name, -1 if there is none."""
    found = F.regexp_extract(name, r"track_?(\d+)", 1)
    return F.when(found == "", F.lit(-1)).otherwise(F.try_to_number(found, F.lit("9999999999"))).cast("long")


def dh_of(name: Column) -> Column:
    """Signed hour offset of a ``dh=`` folder name, NULL if there is none."""
    found = F.regexp_extract(name, r"dh=([+-]?\d+)", 1)
    return F.when(found != "", found.try_cast("int"))


def patch_key(track: Column, ts: Column, dh: Column) -> Column:
    return F.concat(F.lit("track_"), track.cast("string"), F.lit("_"), F.date_format(ts, "yyyyMMddHH"), F.lit("_dh"), F.when(dh >= 0, "+").otherwise(""), dh.cast("string"))


def dh_range(text: str) -> range:
    """``start:stop`` or ``start:stop:step`` as hour offsets, stop excluded."""
    parts = text.split(":")
    if len(parts) not in (2, 3):
        raise ValueError(f"expected start:stop[:step], got {text!r}")
    return range(*map(int, parts))


# --- geometry ---


def coriolis(lat: Column, clamp_deg: float = 0.0) -> Column:
    """f; with ``clamp_deg`` held at that latitude's value nearer to the equator."""
    f = 2 * OMEGA * F.sin(F.radians(F.least(lat, F.lit(90.0))))
    if not clamp_deg:
        return f
    least = 2 * OMEGA * F.sin(F.radians(F.lit(clamp_deg)))
    return F.when(F.abs(f) < least, F.when(f >= 0, least).otherwise(-least)).otherwise(f)


def coriolis_clamped(lat: Column) -> Column:
    return coriolis(lat, F_MIN_LAT)


def taper(lat: Column, low: float = TAPER_LOW, high: float = TAPER_HIGH, polar: float = TAPER_POLAR) -> Column:
    """0 below ``low``, rising to 1 at ``high``; back to 0 in the 5 degrees up to ``polar``."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return clip((lat - low) / (high - low)) * clip((polar - lat) / 5.0)


# --- thermodynamics (p in hPa, T in K, q and qs in kg/kg) ---


def theta(t: Column, p: Column) -> Column:
    return t * F.pow(1000.0 / p, F.lit(KAPPA))


def saturation_pressure(t: Column) -> Column:
    """Bolton's formula, Pa."""
    return 611.2 * F.exp(17.67 * (t - 273.15) / (t - 29.65))


def saturation_humidity(t: Column, p: Column, mixing_ratio: bool = False) -> Column:
    """Specific humidity at saturation, or the mixing ratio (over dry air only)."""
    e, pa = saturation_pressure(t), p * 100.0
    return 0.622 * e / (pa - (1.0 if mixing_ratio else 0.378) * e)


def theta_e(t: Column, p: Column, q: Column) -> Column:
    return theta(t, p) * F.exp(L_VAPOUR * q / (CP_DRY * t))


def moist_lapse_ratio(t: Column, qs: Column) -> Column:
    """Moist over dry adiabatic lapse rate."""
    return (1.0 + L_VAPOUR * qs / (R_DRY * t)) / (1.0 + L_VAPOUR * L_VAPOUR * qs / (CP_DRY * R_VAPOUR * t * t))


def latent_heating(w: Column, t: Column, p: Column, q: Column, dtheta_dp: Column, dtheta_e_dp: Column) -> Column:
    """Rate of potential temperature by latent heat, only where air rises (w < 0)."""
    ratio = moist_lapse_ratio(t, saturation_humidity(t, p))
    rate = w * (dtheta_dp - ratio * (theta(t, p) / theta_e(t, p, q)) * dtheta_e_dp)
    return F.when(w < 0, rate).otherwise(F.lit(0.0))


def latent_heating_from_qs(w: Column, t: Column, p: Column, dqs_dp: Column) -> Column:
    """Alternative rate: what rising air condenses along the slope of qs."""
    rate = -(L_VAPOUR / CP_DRY) * F.pow(1000.0 / p, F.lit(KAPPA)) * w * dqs_dp
    return F.when(w < 0, F.greatest(F.lit(0.0), rate)).otherwise(F.lit(0.0))


def vorticity_source(f: Column, zeta: Column, dheating_dp: Column) -> Column:
    return -G0 * (f + zeta) * dheating_dp


def omega_dry(w: Column) -> Column:
    """Empirical split: a third of the motion is dry, the rest is not."""
    return w / 3.0


def omega_rest(w: Column) -> Column:
    return 2.0 * w / 3.0


def blend(now: Column, before: Column, alpha: float) -> Column:
    if not 0.0 <= alpha <= 1.0:
        raise ValueError("alpha must lie in [0, 1]")
    return alpha * now + (1.0 - alpha) * before


def geopotential_to_m(z: Column) -> Column:
    return z / G0
