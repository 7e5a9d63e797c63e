"""The catalogue of budget product terms, and sums of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXIS = {"u": "dx", "v": "dy", "w": "dp"}
PARTS = ("diabatic", "adiabatic", "qg_diabatic", "lhr_moist")
MEANS = ("bar", "anom")


def catalogue() -> list[tuple[str, str, str, str]]:
    """(name, wind, gradient, family) of all 52 products; every product enters the budget with sign -1."""
    out = []
    for w, axis in AXIS.items():
        out += [(f"{w}_{a}_pv_{b}_{axis}", f"{w}_{a}", f"pv_{b}_{axis}", "base") for a in MEANS for b in MEANS]
    for w in "uv":
        for kind in ("rot", "div"):
            out += [(f"{w}_{kind}_{a}_pv_{b}_{AXIS[w]}", f"{w}_{kind}_{a}", f"pv_{b}_{AXIS[w]}", "split") for a in ("anom", "bar") for b in MEANS]
    for w in "uv":
        out += [(f"{w}_div_{p}_pv_{b}_{AXIS[w]}", f"{w}_div_{p}", f"pv_{b}_{AXIS[w]}", "omega_wind") for p in PARTS for b in MEANS]
    out += [(f"w_{p}_pv_{b}_dp", f"w_{p}", f"pv_{b}_dp", "vertical") for p in PARTS for b in MEANS]
    return out


def product_terms(cells: DataFrame, families: tuple[str, ...] = ("base", "split", "omega_wind", "vertical"), keep: list[str] | None = None) -> DataFrame:
    """Adds (or with ``keep`` selects beside these keys) every product whose factors exist."""
    have = set(cells.columns)
    terms = [(n, F.col(w) * F.col(g)) for n, w, g, f in catalogue() if f in families and w in have and g in have]
    return cells.select(*([*keep] if keep else ["*"]), *[c.alias(n) for n, c in terms])


def signed_sum(spec) -> Column:
    """A variable spec: a name, ["-a", "b"], or a function of a column lookup."""
    if callable(spec):
        return spec(F.col)
    names = [spec] if isinstance(spec, str) else list(spec)
    out = None
    for n in names:
        c = -F.col(n[1:]) if n.startswith("-") else F.col(n)
        out = c if out is None else out + c
    return out


def collect_terms(cells: DataFrame, keys: list[str], include: list[str] | None = None) -> DataFrame:
    """Long form (keys, term, value): base products with sign -1, pv_dt and Q as they are."""
    base = {n for n, _, _, f in catalogue() if f == "base"}
    names = include or [n for n in cells.columns if n in base or n in ("pv_dt", "Q")]
    pairs = F.array(*[F.struct(F.lit(n).alias("term"), (-F.col(n) if n in base else F.col(n)).alias("value")) for n in names])
    return cells.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.term", "p.value")


def grouped_terms(groups: dict[str, list[str]]) -> list[Column]:
    """One column per group: the signed sum of its products."""
    return [signed_sum(v).alias(k) for k, v in groups.items()]


#: Signed groups of base products that together are the whole advection.
FOUR_GROUPS = {
    "mean_by_mean": ["-u_bar_pv_bar_dx", "-v_bar_pv_bar_dy", "-w_bar_pv_bar_dp"],
    "mean_by_anom": ["-u_bar_pv_anom_dx", "-v_bar_pv_anom_dy", "-w_bar_pv_anom_dp"],
    "anom_by_mean": ["-u_anom_pv_bar_dx", "-v_anom_pv_bar_dy", "-w_anom_pv_bar_dp"],
    "anom_by_anom": ["-u_anom_pv_anom_dx", "-v_anom_pv_anom_dy", "-w_anom_pv_anom_dp"],
}


def _both_ways(wind: str, of: str) -> list[str]:
    """Products of a horizontal wind (``rot_anom``, ``div_diabatic``, ...) with both gradients of a part of pv."""
    return [f"-u_{wind}_pv_{of}_dx", f"-v_{wind}_pv_{of}_dy"]


def _vertical(*of: str) -> list[str]:
    return [f"-w_{p}_pv_{b}_dp" for p in ("diabatic", "adiabatic") for b in of]


_EDDIES = {"eddy_rot": _both_ways("rot_anom", "anom"), "eddy_div_dry": _both_ways("div_adiabatic", "anom")}
_TENDENCY = {"tendency": ["pv_anom_dt", "pv_bar_dt"]}
_LINEAR = {"mean_wind": ["-u_rot_bar_pv_anom_dx"], "mean_gradient": ["-v_rot_anom_pv_bar_dy"]}

#: Leading advection and the eddies' rotational, dry and moist divergent parts.
LEADING_GROUPS = {
    "leading": ["-u_rot_bar_pv_anom_dx", "-v_rot_anom_pv_bar_dy"], **_EDDIES,
    "eddy_div_moist": [*_both_ways("div_diabatic", "anom"), "-w_diabatic_pv_anom_dp"],
}
SEVEN_TERMS = {
    "mean_wind": ["-u_bar_pv_anom_dx"], "mean_gradient": ["-v_anom_pv_bar_dy"], **_EDDIES,
    "eddy_div_moist": _both_ways("div_diabatic", "anom"), "vertical_mean": _vertical("bar"), "source": ["Q"],
}
EIGHT_TERMS = _TENDENCY | _LINEAR | _EDDIES | {"eddy_div_moist": _both_ways("div_diabatic", "anom"), "vertical": _vertical("bar", "anom"), "source": ["Q"]}
NINE_TERMS = (
    _TENDENCY | _LINEAR | _EDDIES
    | {"eddy_div_moist": _both_ways("div_diabatic", "anom"), "vertical_mean": _vertical("bar"), "vertical_anom": _vertical("anom"), "source": ["Q"]}
)

#: The 20 products of the whole advection with split horizontal winds.
SPLIT_ADVECTION = [n for n, _, _, family in catalogue() if family == "split"] + [n for n, w, _, family in catalogue() if family == "base" and w.startswith("w_")]


def closure(cells: DataFrame, lhs, advection: list[str], source: str | None = None) -> DataFrame:
    """Adds lhs (a variable spec), adv (minus the sum of products), induced = lhs - adv (the source that would close the
    budget) and resid: induced less the column ``source``, or all of it."""
    c = cells.withColumn("lhs", signed_sum(lhs)).withColumn("adv", signed_sum([f"-{n}" for n in advection]))
    c = c.withColumn("induced", F.col("lhs") - F.col("adv"))
    return c.withColumn("resid", F.col("induced") - F.col(source) if source else F.col("induced"))


def track_budget(cells: DataFrame, vertical: bool = False) -> DataFrame:
    """Adds the products of the anomaly's gradient with mean and anomaly wind, and their sum ``total``."""
    names = [f"{w}_{a}_pv_{b}_{AXIS[w]}" for w in ("uvw" if vertical else "uv") for a, b in (("bar", "anom"), ("anom", "bar"))]
    have = product_terms(cells, ("base",))
    return have.withColumn("total", signed_sum([f"-{n}" for n in names]))


def outflow_estimates(cells: DataFrame) -> DataFrame:
    """Three estimates of the divergent outflow's advection: latent, budget and total."""
    est = {"latent": "lhr_moist", "budget": "qg_diabatic", "total": None}
    out = cells
    for name, part in est.items():
        u, v = (f"u_div_{part}", f"v_div_{part}") if part else ("u_div_anom", "v_div_anom")
        out = out.withColumn(f"outflow_{name}", -(F.col(u) * F.col("pv_bar_dx") + F.col(v) * F.col("pv_bar_dy")))
    return out
