"""Acceleration thresholds between activity levels."""

from __future__ import annotations

# Thresholds in g (white_met: in MET) published with each metric.
CUTPOINTS: dict[str, dict] = {
    "esliger_lwrist_adult": {"metric": "enmo", "take_abs": True, "sedentary": 217 / 80 / 60, "light": 644 / 80 / 60, "moderate": 1810 / 80 / 60},
    "esliger_rwirst_adult": {"metric": "enmo", "take_abs": True, "sedentary": 386 / 80 / 60, "light": 439 / 80 / 60, "moderate": 2098 / 80 / 60},
    "esliger_lumbar_adult": {"metric": "enmo", "take_abs": True, "sedentary": 77 / 80 / 60, "light": 219 / 80 / 60, "moderate": 2056 / 80 / 60},
    "schaefer_ndomwrist_child6-11": {"metric": "bfen", "low": 0.2, "high": 15, "trim_zero": False, "sedentary": 0.190, "light": 0.314, "moderate": 0.998},
    "phillips_rwrist_child8-14": {"metric": "enmo", "take_abs": True, "sedentary": 6 / 80, "light": 21 / 80, "moderate": 56 / 80},
    "phillips_lwrist_child8-14": {"metric": "enmo", "take_abs": True, "sedentary": 7 / 80, "light": 19 / 80, "moderate": 60 / 80},
    "phillips_hip_child8-14": {"metric": "enmo", "take_abs": True, "sedentary": 3 / 80, "light": 16 / 80, "moderate": 51 / 80},
    "vaha-ypya_hip_adult": {"metric": "mad", "light": 0.091, "moderate": 0.414},
    "hildebrand_hip_adult_actigraph": {"metric": "enmo", "take_abs": False, "sedentary": 0.0474, "light": 0.0691, "moderate": 0.2587},
    "hildebrand_hip_adult_geneactv": {"metric": "enmo", "take_abs": False, "sedentary": 0.0469, "light": 0.0687, "moderate": 0.2668},
    "hildebrand_wrist_adult_actigraph": {"metric": "enmo", "take_abs": False, "sedentary": 0.0448, "light": 0.1006, "moderate": 0.4288},
    "hildebrand_wrist_adult_geneactiv": {"metric": "enmo", "take_abs": False, "sedentary": 0.0458, "light": 0.0932, "moderate": 0.4183},
    "hildebrand_hip_child7-11_actigraph": {"metric": "enmo", "take_abs": False, "sedentary": 0.0633, "light": 0.1426, "moderate": 0.4646},
    "hildebrand_hip_child7-11_geneactiv": {"metric": "enmo", "take_abs": False, "sedentary": 0.0641, "light": 0.1528, "moderate": 0.5143},
    "hildebrand_wrist_child7-11_actigraph": {"metric": "enmo", "take_abs": False, "sedentary": 0.0356, "light": 0.2014, "moderate": 0.707},
    "hildebrand_wrist_child7-11_geneactiv": {"metric": "enmo", "take_abs": False, "sedentary": 0.0563, "light": 0.1916, "moderate": 0.6958},
    "migueles_wrist_adult": {"metric": "enmo", "take_abs": False, "sedentary": 0.050, "light": 0.110, "moderate": 0.440},
    "white_met": {"metric": "enmo_met", "sedentary": 1.5, "light": 3.0, "moderate": 6.0},
}

LOWEST, HIGHEST = -1e5, 1e5
#: Names of the thresholds below and above each level.
LEVELS = {"sed": (None, "sedentary"), "light": ("sedentary", "light"), "mod": ("light", "moderate"), "vig": ("moderate", None), "mvpa": ("light", None), "slpa": (None, "light")}


def level_range(level: str, cutpoints: str | dict) -> tuple[float, float]:
    """[lower, upper) of a level."""
    short = {"sedentary": "sed", "moderate": "mod", "vigorous": "vig"}
    key = short.get(level.lower(), level.lower())
    if key not in LEVELS:
        raise ValueError(f"unknown activity level: {level}")
    cuts = CUTPOINTS[cutpoints] if isinstance(cutpoints, str) else cutpoints
    for name in LEVELS[key]:
        if name is not None and name not in cuts:
            raise ValueError(f"these cut-points have no threshold {name}, which level {level} needs")
    lo, hi = LEVELS[key]
    return cuts[lo] if lo else LOWEST, cuts[hi] if hi else HIGHEST
