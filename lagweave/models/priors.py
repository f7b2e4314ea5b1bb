"""Prior hyper-parameters of every model: which it has, their defaults, and their resolution.

Each model's settings are a frozen dataclass, made from the groups of fields below. ``None`` marks
a default that depends on the data or on the graph (``data_scaled`` resolves those of the
coefficients). ``settings`` picks the class of a model and design, ``resolve`` reads what a user
gives (nothing, a dict, or an instance) and ``hyper`` is what the samplers take.
"""

from __future__ import annotations

from dataclasses import asdict, field, fields, make_dataclass

import numpy as np

# Defaults of the hyper-parameters.
BETA = {"beta_mu": None, "beta_sigma": None}
NOISE = {"sigma2_alpha": 2.0, "sigma2_beta": None}
ROBUST = {"nu": 4.0}
GAUSSIAN = BETA | NOISE | ROBUST
RHO = {"rho_lower": -1.0, "rho_upper": 1.0}
LAM = {"lam_lower": -1.0, "lam_upper": 1.0}
DISPERSION = {"alpha_sigma": 2.5, "alpha_nu": 3.0, "alpha_fixed": None}
OPEN_RHO = {"rho_lower": None, "rho_upper": None}
ZERO_PART = {"beta_mu_zero": None, "beta_sigma_zero": None, "rho_lower_zero": None, "rho_upper_zero": None}
LEVELS = {"sigma_nu": 3.0, "sigma_scale": None, "level_beta_mu": None, "level_beta_sigma": None}
LINK_RHO = {"rho_lower": -0.999, "rho_upper": 0.999}
LINK_LAM = {"lam_lower": -0.999, "lam_upper": 0.999}
PROBIT_RANDOM = {"lam_lower": -0.95, "lam_upper": 0.95, "unit_effect_sd_sigma": 2.0}
PERIOD = {"time_effect_mu": None, "time_effect_sigma": 2.5}
UNIT = {"unit_effect_mu": None, "unit_effect_sd_scale": 1.0}
UNIT_ZERO = {"unit_effect_mu_zero": None, "unit_effect_sd_scale_zero": 1.0}
PERIOD_ZERO = {"time_effect_mu_zero": None, "time_effect_sigma_zero": 2.5}
PAIR = {"pair_effect_mu": None, "pair_effect_sd_scale": 1.0}
PAIR_ZERO = {"pair_effect_mu_zero": None, "pair_effect_sd_scale_zero": 1.0}
RANDOM = {"unit_effect_sd_nu": 1.0, "unit_effect_sd_scale": None}
PHI = {"phi_lower": -0.95, "phi_upper": 0.95}
THETA = {"theta_lower": -0.95, "theta_upper": 0.95}
DYNAMIC_RHO = {"rho_lower": -0.95, "rho_upper": 0.95}
DYNAMIC_LAM = {"lam_lower": -0.95, "lam_upper": 0.95}
SAMPLER = {"beta_mu": 0.0, "beta_sigma": 1e6}
SAMPLER_NOISE = {"sigma2_alpha": 2.0, "sigma2_beta": 1.0}

COUNT_PANEL = GAUSSIAN | RHO | DISPERSION | PERIOD
DYNAMIC = GAUSSIAN | PHI

#: Name: fields and defaults.
FAMILIES: dict[str, dict] = {
    "Base": GAUSSIAN,
    "OLS": GAUSSIAN,
    "SLX": GAUSSIAN,
    "SAR": GAUSSIAN | RHO,
    "SEM": GAUSSIAN | LAM,
    "SDM": GAUSSIAN | RHO,
    "SDEM": GAUSSIAN | LAM,
    "NegBin": GAUSSIAN | DISPERSION,
    "SARNegBin": GAUSSIAN | DISPERSION | RHO,
    "SEMNegBin": GAUSSIAN | DISPERSION | LAM,
    "SARZINB": GAUSSIAN | DISPERSION | OPEN_RHO | ZERO_PART,
    "SARHurdle": GAUSSIAN | DISPERSION | OPEN_RHO | ZERO_PART,
    "Multilevel": GAUSSIAN | OPEN_RHO | LEVELS,
    "SARTobit": GAUSSIAN | RHO,
    "SEMTobit": GAUSSIAN | LAM,
    "SDMTobit": GAUSSIAN | RHO,
    "SEMProbitRE": BETA | PROBIT_RANDOM,
    "SARLogit": BETA | LINK_RHO,
    "SEMLogit": BETA | LINK_LAM,
    "SARProbit": BETA | LINK_RHO,
    "SEMProbit": BETA | LINK_LAM,
    "PanelBase": GAUSSIAN,
    "PanelOLS": GAUSSIAN,
    "PanelSAR": GAUSSIAN | RHO,
    "PanelCountBase": COUNT_PANEL,
    "PanelCount": COUNT_PANEL | UNIT,
    "PanelZINB": COUNT_PANEL | UNIT | ZERO_PART,
    "PanelHurdle": COUNT_PANEL | UNIT | ZERO_PART | UNIT_ZERO | PERIOD_ZERO,
    "FlowPanelHurdle": COUNT_PANEL | PAIR | ZERO_PART | PAIR_ZERO | PERIOD_ZERO,
    "PanelSEM": GAUSSIAN | LAM,
    "PanelSDEM": GAUSSIAN | LAM,
    "PanelRE": RANDOM,
    "PanelOLSRE": GAUSSIAN | RANDOM,
    "PanelSARRE": GAUSSIAN | RHO | RANDOM,
    "PanelSEMRE": GAUSSIAN | LAM | RANDOM,
    "PanelSDEMRE": GAUSSIAN | LAM | RANDOM,
    "PanelDynamicBase": DYNAMIC,
    "PanelOLSDynamic": DYNAMIC,
    "PanelSLXDynamic": DYNAMIC,
    "PanelSARDynamic": DYNAMIC | DYNAMIC_RHO,
    "PanelSEMDynamic": DYNAMIC | DYNAMIC_LAM,
    "PanelSDMRDynamic": DYNAMIC | DYNAMIC_RHO,
    "PanelSDMUDynamic": DYNAMIC | DYNAMIC_RHO | THETA,
    "PanelSDEMDynamic": DYNAMIC | DYNAMIC_LAM,
    "GibbsBase": SAMPLER | LINK_RHO,
    "GaussianGibbs": SAMPLER | SAMPLER_NOISE | LINK_RHO,
    "ReducedGibbs": SAMPLER | DISPERSION | LINK_RHO,
    "FlowReducedGibbs": SAMPLER | DISPERSION | LINK_RHO,
    "ZINBGibbs": {"gamma_mu": 0.0, "gamma_sigma": 1e6} | LINK_LAM | {"beta_mu": 0.0, "beta_sigma": 10.0} | LINK_RHO | DISPERSION,
    "BinaryGibbs": SAMPLER | LINK_RHO,
    "REGibbs": SAMPLER | LINK_RHO | SAMPLER_NOISE | {"unit_effect_sd_nu": 1.0, "unit_effect_sd_scale": 1.0},
}
CLASSES = {name: make_dataclass(f"{name}Priors", [(f, object, field(default=v)) for f, v in rows.items()], frozen=True) for name, rows in FAMILIES.items()}

#: Cross-sections that share another one's settings.
SAME = {"SDEMNegBin": "SEMNegBin", "SDEMLogit": "SEMLogit", "SDEMProbit": "SEMProbit", "Logit": "SARLogit", "Probit": "SARProbit", "ZINB": "SARZINB", "HurdleNegBin": "SARHurdle", "SARHurdleNegBin": "SARHurdle"}
FLOWS = {"OLSFlow": "OLS", "SARFlow": "SAR", "SEMFlow": "SEM", "NegBinFlow": "NegBin", "SARNegBinFlow": "SARNegBin", "SARPoissonFlow": "SAR", "SARZINBFlow": "SARZINB", "SARHurdleNegBinFlow": "SARHurdle"}


def settings(model: str, panel: bool = False, effects: str = "pooled", dynamic: str | None = None) -> type:
    """The class of prior settings that a model takes in a design."""
    if dynamic:
        name = "PanelSDMRDynamic" if dynamic == "restricted" else "PanelSDMUDynamic" if model == "SDM" else f"Panel{model}Dynamic"
    elif model == "SEMProbit" and effects == "random":
        name = "SEMProbitRE"
    elif effects == "random" and f"Panel{model}RE" in CLASSES:
        name = f"Panel{model}RE"
    elif panel and "ZINB" in model and "Flow" not in model:
        name = "PanelZINB"
    elif panel and "Hurdle" in model:
        name = "FlowPanelHurdle" if "Flow" in model else "PanelHurdle"
    elif panel and "NegBin" in model:
        name = "PanelCount" if "Flow" not in model else "PanelCountBase"
    else:
        name = FLOWS.get(model, SAME.get(model, model))
    if name not in CLASSES:
        raise ValueError(f"{model} has no such design")
    return CLASSES[name]


def resolve(given, cls: type):
    """``given`` as an instance of ``cls``; raises TypeError for settings that it doesn't have."""
    if given is None:
        return cls()
    if isinstance(given, cls):
        return given
    known = [f.name for f in fields(cls)]
    values = as_dict(given)
    if unknown := sorted(set(values) - set(known)):
        raise TypeError(f"{cls.__name__} has no {', '.join(unknown)}; it has {', '.join(known)}")
    return cls(**values)


def as_dict(given) -> dict:
    """A plain dict of settings; empty for None."""
    return {} if given is None else dict(given) if isinstance(given, dict) else asdict(given)


def level_of(mean: float, n: int, link: str = "identity") -> tuple[float, float | None]:
    """The link of the outcome's mean, and the scale of the predictor (None: the outcome's sd)."""
    if link == "identity":
        return mean, None
    if link == "log":
        return float(np.log(max(mean, 0.5 / max(n, 1)))), 1.0
    edge = 0.5 / max(n, 1)
    p = min(max(mean, edge), 1 - edge)
    if link == "logit":
        return float(np.log(p / (1 - p))), 1.0
    if link == "probit":
        return probit_of(p), 1 / 1.6
    raise ValueError(f"unknown link {link!r}")


def probit_of(p: float) -> float:
    """The standard normal quantile, by bisection of its distribution."""
    from ..functions.special import ndtr

    low, high = -40.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if float(ndtr(np.array(middle))) < p else (low, middle)
    return (low + high) / 2


def data_scaled(mean_y: float, sd_y: float, n: int, sd_x: np.ndarray, constant: np.ndarray, link: str = "identity", scale: float = 2.5) -> tuple[np.ndarray, np.ndarray]:
    """Means and sds of the coefficients: a constant's at the outcome's level, slopes' at 0."""
    level, unit = level_of(mean_y, n, link)
    unit = unit if unit is not None else (sd_y if sd_y > 0 else 1.0)
    divisor = np.where(constant | (sd_x <= 0), 1.0, np.where(sd_x > 0, sd_x, 1.0))
    return np.where(constant, level, 0.0), scale * unit / divisor


def half_t(x, nu: float, scale: float):
    """The log density of a half Student-t, up to a constant."""
    return -(nu + 1) / 2 * np.log1p((x / scale) ** 2 / nu)
