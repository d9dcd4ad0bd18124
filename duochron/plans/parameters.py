"""Parameter registry and layouts of the parameter vector."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Parameter:
    name: str
    default: float
    lower: float
    upper: float
    is_scaling: bool = False
    is_flow: bool = False
    log_space: bool = False


# Names, defaults and bounds.
REGISTRY = {
    p.name: p
    for p in (
        Parameter("contrast", 0.5, 0.0, 1.0, is_scaling=True),
        Parameter("offset", 1.0, 0.5, 1.5, is_scaling=True),
        Parameter("D0", 1000.0, 100.0, 1e5, log_space=True),
        Parameter("alpha", 0.5, -2.0, 2.0),
        Parameter("D_offset", 10.0, -1e5, 1e5),
        Parameter("gamma_dot_t0", 0.01, 1e-6, 0.5, is_flow=True, log_space=True),
        Parameter("beta", 0.5, -2.0, 2.0, is_flow=True),
        Parameter("gamma_dot_t_offset", 0.0, -0.1, 0.1, is_flow=True),
        Parameter("phi0", 0.0, -10.0, 10.0, is_flow=True),
        Parameter("D0_ref", 1e4, 0.0, 1e6),
        Parameter("alpha_ref", 0.0, -2.0, 2.0),
        Parameter("D_offset_ref", 0.0, -1e5, 1e5),
        Parameter("D0_sample", 1e4, 0.0, 1e6),
        Parameter("alpha_sample", 0.0, -2.0, 2.0),
        Parameter("D_offset_sample", 0.0, -1e5, 1e5),
        Parameter("v0", 1e3, 0.0, 1e6, is_flow=True),
        Parameter("v_beta", 1.0, 0.0, 2.0, is_flow=True),
        Parameter("v_offset", 0.0, -100.0, 100.0, is_flow=True),
        Parameter("f0", 0.5, 0.0, 1.0),
        Parameter("f1", 0.0, -1.0, 1.0),
        Parameter("f2", 0.0, -1.0, 1.0),
        Parameter("f3", 0.0, -1.0, 1.0),
        Parameter("phi0_het", 0.0, -10.0, 10.0, is_flow=True),
    )
}
STATIC = ("D0", "alpha", "D_offset")
FLOW = (*STATIC, "gamma_dot_t0", "beta", "gamma_dot_t_offset", "phi0")
TWO_COMPONENT = ("D0_ref", "alpha_ref", "D_offset_ref", "D0_sample", "alpha_sample", "D_offset_sample", "v0", "v_beta", "v_offset", "f0", "f1", "f2", "f3", "phi0_het")
MODES = {"static_isotropic": STATIC, "static_anisotropic": STATIC, "laminar_flow": FLOW, "two_component": TWO_COMPONENT}


def mode_of(name: str, allow_bare_static: bool = False) -> str:
    """The analysis mode that a configuration's string means."""
    s = name.lower()
    if "laminar" in s:
        return "laminar_flow"
    if any(k in s for k in ("two_component", "two-component", "heterodyne")):
        return "two_component"
    if "static" in s:
        if "anisotropic" in s:
            return "static_anisotropic"
        if "isotropic" in s:
            return "static_isotropic"
        if allow_bare_static:
            return "static_anisotropic"
        raise ValueError(f"{name}: say static_anisotropic or static_isotropic")
    raise ValueError(f"no such mode: {name}")


def mode_from_count(n: int, n_angles: int) -> tuple[str, bool]:
    """(mode, whether scaling is per angle) from the length of a parameter vector."""
    for mode, names in (("static_anisotropic", STATIC), ("laminar_flow", FLOW)):
        if n == len(names) + 2 * n_angles and n_angles > 1:
            return mode, True
        if n == len(names) + 2:
            return mode, False
    raise ValueError(f"{n} parameters fit no mode of {n_angles} angles")


def split(vector: np.ndarray, n_angles: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contrast per angle, offset per angle, physics) of a scaling-first vector; two scalars are repeated."""
    _, per_angle = mode_from_count(len(vector), n_angles)
    k = n_angles if per_angle else 1
    c, o = vector[:k], vector[k : 2 * k]
    return np.broadcast_to(c, n_angles).copy() if k == 1 else c, np.broadcast_to(o, n_angles).copy() if k == 1 else o, vector[2 * k :]


#: Ways of scaling the angles.
LAYOUTS = ("auto", "individual", "averaged", "constant", "fourier")


def scaling_layout(mode: str, n_angles: int, threshold: int = 3) -> str:
    """auto means averaged from ``threshold`` angles on, individual below."""
    if mode not in LAYOUTS:
        raise ValueError(f"no such per_angle_mode: {mode}; one of {', '.join(LAYOUTS)}")
    return ("averaged" if n_angles >= threshold else "individual") if mode == "auto" else mode


def parameter_table(spark: SparkSession) -> DataFrame:
    rows = [(p.name, p.default, p.lower, p.upper, p.is_scaling, p.is_flow, p.log_space) for p in REGISTRY.values()]
    return spark.createDataFrame(rows, "name string, default double, lower double, upper double, is_scaling boolean, is_flow boolean, log_space boolean")


def clip_to_bounds(values: dict[str, float]) -> dict[str, float]:
    return {k: min(max(v, REGISTRY[k].lower), REGISTRY[k].upper) for k, v in values.items()}
