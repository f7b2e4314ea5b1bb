"""What each model is: its lags, its Jacobian, and the designs and effects that it allows."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

import numpy as np

from . import priors


@dataclass(frozen=True)
class ModelSpec:
    """``process``: which side I - rho W filters (lag, error or none); ``durbin``: WX in the mean."""

    name: str
    process: str
    durbin: bool
    likelihood: str = "gaussian"
    effects: tuple[str, ...] = ("pooled",)
    dynamic: tuple[str, ...] = ()


_FIXED = ("pooled", "unit", "time", "two_way")
SPECS = {
    s.name: s
    for s in (
        ModelSpec("OLS", "none", False, effects=(*_FIXED, "random"), dynamic=("unrestricted",)),
        ModelSpec("SLX", "none", True, effects=_FIXED, dynamic=("unrestricted",)),
        ModelSpec("SAR", "lag", False, effects=(*_FIXED, "random"), dynamic=("unrestricted",)),
        ModelSpec("SEM", "error", False, effects=(*_FIXED, "random"), dynamic=("unrestricted",)),
        ModelSpec("SDM", "lag", True, effects=_FIXED, dynamic=("unrestricted", "restricted")),
        ModelSpec("SDEM", "error", True, effects=(*_FIXED, "random"), dynamic=("unrestricted",)),
        ModelSpec("SARTobit", "lag", False, "tobit"), ModelSpec("SEMTobit", "error", False, "tobit"), ModelSpec("SDMTobit", "lag", True, "tobit"),
        ModelSpec("Probit", "none", False, "probit"), ModelSpec("SARProbit", "lag", False, "probit"),
        ModelSpec("Logit", "none", False, "logit"), ModelSpec("SARLogit", "lag", False, "logit"),
        ModelSpec("NegBin", "none", False, "negbin"), ModelSpec("SARNegBin", "lag", False, "negbin"),
    )
}


def validate(spec: ModelSpec, effects: str, dynamic: str | None, panel: bool) -> None:
    """Raises where the model doesn't have the design that is asked for."""
    if effects not in spec.effects:
        raise ValueError(f"{spec.name} allows effects {spec.effects}, not {effects!r}")
    if dynamic and dynamic not in spec.dynamic:
        raise ValueError(f"{spec.name} has no {dynamic} dynamic panel")
    if (effects != "pooled" or dynamic) and not panel:
        raise ValueError("effects and dynamics need a panel")
    if dynamic and effects != "pooled":
        raise ValueError("dynamic panels take no unit or time effects")


#: What samplers call the settings of ``priors``.
NAMES = {
    "beta_mu": "beta_mean", "beta_sigma": "beta_sd", "sigma2_alpha": "sigma_shape", "sigma2_beta": "sigma_scale", "rho_lower": "low", "rho_upper": "high",
    "lam_lower": "low", "lam_upper": "high", "alpha_sigma": "alpha_scale", "unit_effect_sd_nu": "unit_nu", "unit_effect_sd_scale": "unit_scale",
}


@dataclass(frozen=True)
class Priors:
    """Hyper-parameters as samplers take them; None takes the default that depends on the data.

    beta ~ N(beta_mean, beta_sd^2), numbers or one for each term; by default slopes are centred on
    0 with sd 2.5 sd(y)/sd(x) and a constant on mean(y) with sd 2.5 sd(y). sigma2 ~ InvGamma(2,
    Var y); the spatial parameter is uniform on (low, high); alpha ~ half-t(alpha_nu, alpha_scale)
    or fixed; the lagged outcome's coefficients are uniform on their bounds.
    """

    beta_mean: object = None
    beta_sd: object = None
    sigma_shape: float = 2.0
    sigma_scale: float | None = None
    low: float = -1.0
    high: float = 1.0
    nu: float = 4.0
    alpha_scale: float = 2.5
    alpha_nu: float = 3.0
    alpha_fixed: float | None = None
    phi_lower: float = -0.95
    phi_upper: float = 0.95
    theta_lower: float = -0.95
    theta_upper: float = 0.95
    unit_nu: float = 1.0
    unit_scale: float | None = None

    @classmethod
    def of(cls, given: Priors | dict | None, model: str | None = None, **design) -> Priors:
        """Settings of a model and design; keys may be those of ``priors`` or of this class."""
        if isinstance(given, cls):
            return given
        own = {f.name for f in fields(cls)}
        values = priors.as_dict(given)
        base = cls()
        if model is not None:
            defaults = priors.as_dict(priors.settings(model, **design)())
            known = set(defaults)
            base = replace(base, **{NAMES.get(k, k): v for k, v in defaults.items() if v is not None and NAMES.get(k, k) in own})
        else:
            known = set(NAMES)
        if unknown := set(values) - known - own:
            raise ValueError(f"unknown priors: {sorted(unknown)}")
        return replace(base, **{NAMES.get(k, k): v for k, v in values.items() if NAMES.get(k, k) in own})

    def coefficients(self, mean_y: float, sd_y: float, n: int, sd_x, constant, link: str = "identity"):
        """Prior means and sds of the coefficients, given ones first."""
        mean, sd = priors.data_scaled(mean_y, sd_y, n, np.asarray(sd_x, float), np.asarray(constant, bool), link)
        if self.beta_mean is not None:
            mean = np.broadcast_to(np.asarray(self.beta_mean, float), mean.shape).copy()
        if self.beta_sd is not None:
            sd = np.broadcast_to(np.asarray(self.beta_sd, float), sd.shape).copy()
        return mean, sd

    def log_alpha(self, a: float) -> float:
        """The log prior density of the dispersion, on the log scale, up to a constant."""
        return float(priors.half_t(a, self.alpha_nu, self.alpha_scale) + np.log(a))
