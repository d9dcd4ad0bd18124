"""Configuration: load, check, defaults, and the facade's entry points."""

from __future__ import annotations

import json
from copy import deepcopy

import yaml

from .operators.aggregates import REPAIRS
from .plans.parameters import LAYOUTS, REGISTRY, mode_of
from .plans.solve import LOSSES

# What a configuration has where nothing is said.
DEFAULTS = {
    "analysis_mode": "static_isotropic",
    "analyzer_parameters": {"dt": 1.0, "start_frame": 1, "end_frame": -1, "wavevector_q": 0.005, "stator_rotor_gap": 2e6},
    "phi_filtering": {"enabled": False, "target_ranges": [], "fallback_on_empty": True},
    "preprocessing": {"repair": "disabled", "diagonal": "statistical", "normalisation": None, "noise": None},
    "optimization": {"max_iterations": 50, "per_angle_mode": "auto", "loss": "linear", "method": "levenberg_marquardt", "recover": True, "transforms": {"log_shear": False, "centred_shear": False}, "anti_degeneracy": {"hierarchical": False, "shear_weighting": False, "variation_penalty": 0.0, "monitor": False}, "multi_start": {"enable": False, "n_starts": 10, "seed": 42}, "cmaes": {"enable": False, "budget": 2000, "restarts": 9, "seed": 42}},
    "initial_parameters": {},
}


#: Ways of fitting: damped Gauss-Newton, the trust region on per-angle sums (where scaling is per angle), a descent first.
METHODS = ("levenberg_marquardt", "trust_region", "hybrid")


class ConfigError(ValueError):
    pass


def merged(own: dict, defaults: dict = DEFAULTS) -> dict:
    out = deepcopy(defaults)
    for k, v in own.items():
        out[k] = merged(v, out[k]) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def check(config: dict) -> list[str]:
    """What is wrong with it; nothing for a sound one."""
    wrong = []
    try:
        mode_of(config["analysis_mode"])
    except ValueError as e:
        wrong.append(str(e))
    o = config["optimization"]
    for name, known in (("per_angle_mode", LAYOUTS), ("loss", LOSSES), ("method", METHODS)):
        if o[name] not in known:
            wrong.append(f"no such {name}: {o[name]}; one of {', '.join(known)}")
    if config["preprocessing"]["repair"] not in REPAIRS:
        wrong.append(f"no such repair: {config['preprocessing']['repair']}")
    a = config["analyzer_parameters"]
    for name, low, high in (("dt", 1e-6, 1e3), ("wavevector_q", 1e-4, 1.0), ("stator_rotor_gap", 1e5, 1e8)):
        if not low <= a[name] <= high:
            wrong.append(f"{name} = {a[name]} isn't within {low} and {high}")
    if a["end_frame"] >= 0 and a["end_frame"] < a["start_frame"]:
        wrong.append("end_frame comes before start_frame")
    for name, value in config["initial_parameters"].items():
        if name not in REGISTRY:
            wrong.append(f"no such parameter: {name}")
        elif not REGISTRY[name].lower <= value <= REGISTRY[name].upper:
            wrong.append(f"{name} = {value} isn't within its bounds")
    for r in config["phi_filtering"]["target_ranges"]:
        if len(r) != 2 or not all(-360 <= x <= 360 for x in r):
            wrong.append(f"not a range of angles: {r}")
    return wrong


def load_config(source: str | dict) -> dict:
    """A dictionary, or the path of a YAML or JSON file, over the defaults; raises ConfigError with all that is wrong."""
    if isinstance(source, str):
        with open(source, encoding="utf-8") as f:
            own = json.load(f) if source.endswith(".json") else yaml.safe_load(f)
    else:
        own = source
    config = merged(own or {})
    if wrong := check(config):
        raise ConfigError("; ".join(wrong))
    return config


def physics_issues(values: dict[str, float]) -> list[tuple[str, str]]:
    """(severity, message) of parameters that contradict each other."""
    out = [("error", f"{k} isn't within its bounds") for k, v in values.items() if k in REGISTRY and not REGISTRY[k].lower <= v <= REGISTRY[k].upper]
    if values.get("f0", 0) + values.get("f3", 0) > 1:
        out.append(("error", "f0 + f3 exceeds 1"))
    for scale, offset in (("D0", "D_offset"), ("D0_ref", "D_offset_ref"), ("D0_sample", "D_offset_sample")):
        if values.get(scale) and abs(values.get(offset, 0)) / values[scale] > 0.5:
            out.append(("warning", f"{offset} is more than half of {scale}"))
    return out


def save_config(config: dict, path: str) -> None:
    """Write a checked configuration as YAML, or JSON by its suffix; a JSON one is brought to YAML by loading and saving it."""
    config = load_config(config)
    with open(path, "w", encoding="utf-8") as f:
        if path.endswith(".json"):
            json.dump(config, f, indent=2)
        else:
            yaml.safe_dump(config, f, sort_keys=False)
