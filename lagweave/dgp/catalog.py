"""Every simulator by model and design, with its default parameters, and the designs that models take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import designs, simulate
from . import flows as od

#: Parameters that a model's simulator has by default.
LAG, ERROR, DURBIN = {"rho": 0.5}, {"lam": 0.5}, {"theta": [0.5]}
GAUSSIAN = {"beta": [1.0, 2.0], "sigma": 1.0}
EFFECT_SD = 0.5

MODELS: dict[str, dict] = {
    "OLS": GAUSSIAN, "SLX": GAUSSIAN | DURBIN, "SAR": GAUSSIAN | LAG, "SEM": GAUSSIAN | ERROR,
    "SDM": GAUSSIAN | DURBIN | {"rho": 0.4}, "SDEM": GAUSSIAN | DURBIN | {"lam": 0.4},
}
TOBIT = {"SARTobit": "SAR", "SEMTobit": "SEM", "SDMTobit": "SDM"}
BINARY = {"Logit": ("lag", 0.0), "SARLogit": ("lag", 0.35), "SEMLogit": ("error", 0.35), "SDEMLogit": ("error", 0.35), "Probit": ("lag", 0.0), "SARProbit": ("lag", 0.35), "SEMProbit": ("error", 0.35), "SDEMProbit": ("error", 0.35)}
COUNT = {"NegBin": ("lag", 0.0), "SARNegBin": ("lag", 0.5), "SEMNegBin": ("error", 0.5), "SDEMNegBin": ("error", 0.5)}
TWO_PART = {"ZINB": ("zinb", 0.0, 0.0), "SARZINB": ("zinb", 0.5, 0.3), "HurdleNegBin": ("hurdle", 0.0, 0.0), "SARHurdleNegBin": ("hurdle", 0.4, 0.3)}
FLOWS = {"OLSFlow": {"rho_d": 0.0, "rho_o": 0.0, "rho_w": None}, "SARFlow": {}, "SEMFlow": {"process": "error"}, "NegBinFlow": {"rho_d": 0.0, "rho_o": 0.0, "rho_w": None, "family": "negbin"}, "SARNegBinFlow": {"family": "negbin"}}


def accepts(model: str, panel: bool, effects: str, dynamic: bool) -> None:
    """Raises where a model's simulator has no such design."""
    if model in MODELS:
        return
    if dynamic:
        raise ValueError(f"{model} has no dynamic panel")
    if model in TOBIT and effects != "pooled":
        raise ValueError(f"{model} panels are pooled")
    if model in BINARY and (panel or (effects != "pooled" and model != "SEMProbit")):
        raise ValueError(f"{model} is a cross-section" + (" or repeated observations" if model == "SEMProbit" else ""))
    if (model in COUNT and model not in ("NegBin", "SARNegBin") and panel) or (model in ("SEMNegBin", "SDEMNegBin") and effects != "pooled"):
        raise ValueError(f"{model} is a cross-section")
    if model not in {*TOBIT, *BINARY, *COUNT, *TWO_PART, *FLOWS, "SARPoissonFlow", "SARZINBFlow", "SARHurdleNegBinFlow"}:
        raise ValueError(f"no simulator for {model!r}")


def panel_of(units: DataFrame, periods: int, key: str = "unit_id", time: str = "time") -> DataFrame:
    """Units repeated in periods 0, 1, .."""
    return units.withColumn(time, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(periods - 1).cast("long"))))


def simulated(model: str, units: DataFrame, edges: DataFrame, periods: int = 1, effects: str = "pooled", dynamic: str | None = None, separable: bool = False, seed: int = 0, key: str = "unit_id", **parameters) -> DataFrame:
    """A table of a model's outcome and covariates.

    ``periods`` over 1 makes a panel (key, time); ``effects`` (unit, time, two_way, random, pair) adds
    effects of sd 0.5 unless unit_sd, time_sd or pair_sd is given; ``dynamic`` (unrestricted,
    restricted) adds the lagged outcome. Flow models take ``separable``. Other parameters are those
    of the simulator.
    """
    panel = periods > 1
    accepts(model, panel, effects, dynamic is not None)
    sds = {}
    if effects in ("unit", "two_way", "random"):
        sds["unit_sd"] = EFFECT_SD
    if effects in ("time", "two_way"):
        sds["time_sd"] = EFFECT_SD
    if model in MODELS or model in TOBIT:
        settings = MODELS[TOBIT.get(model, model)] | sds | parameters
        if dynamic:
            return designs.dynamic_panel(units, edges, periods, restricted=dynamic == "restricted", seed=seed, key=key, **(settings | {"rho": settings.get("rho", 0.0)}))
        table, time = (panel_of(units.select(key), periods, key), "time") if panel else (units, None)
        make = simulate.tobit if model in TOBIT else simulate.gaussian
        return make(table, edges, seed=seed, key=key, time=time, **settings)
    if model in BINARY:
        process, r = BINARY[model]
        link = "logit" if model.endswith("Logit") else "probit"
        if model == "SEMProbit" and effects == "random":
            return designs.probit_random(units, edges, seed=seed, key=key, **parameters)
        if process == "lag" and not parameters.pop("latent", False):
            if parameters.pop("err_hetero", False):
                raise ValueError("the reduced form has no disturbances to scale")
            return simulate.binary(units, edges, **({"beta": [0.3, 1.0], "rho": r} | parameters), link=link, seed=seed, key=key)
        parameters["r"] = parameters.pop("rho", parameters.pop("lam", r))
        if model.startswith("SDEM"):
            parameters.setdefault("theta", [0.5] * (len(parameters.get("beta", (0.3, 1.0))) - 1))
        return designs.latent_binary(units, edges, process=process, link=link, seed=seed, key=key, **parameters)
    if model in COUNT:
        process, r = COUNT[model]
        if panel:
            return designs.count_panel(panel_of(units.select(key), periods, key), edges, seed=seed, key=key, **({"rho": r and 0.4} | sds | parameters))
        if process == "lag" and not parameters.pop("latent", False):
            return simulate.negbin(units, edges, **({"beta": [1.0, 0.6], "rho": r, "alpha": 2.0} | parameters), seed=seed, key=key)
        parameters["r"] = parameters.pop("rho", parameters.pop("lam", r))
        if model.startswith("SDEM"):
            parameters.setdefault("theta", [0.5] * (len(parameters.get("beta", (1.0, 0.6))) - 1))
        return designs.latent_negbin(units, edges, process=process, seed=seed, key=key, **parameters)
    if model in TWO_PART:
        kind, rho, rho_zero = TWO_PART[model]
        table, time = (panel_of(units.select(key), periods, key), "time") if panel else (units, None)
        return designs.two_part(table, edges, kind, seed=seed, key=key, time=time, **({"rho": rho, "rho_zero": rho_zero} | sds | parameters))
    if effects in ("pair", "unit", "random"):
        parameters.setdefault("pair_sd", EFFECT_SD)
    if model in ("SARZINBFlow", "SARHurdleNegBinFlow"):
        return od.two_part_flows(units, edges, "zinb" if "ZINB" in model else "hurdle", periods=periods, seed=seed, key=key, **parameters)
    if separable:
        parameters["rho_w"] = None
    if model == "SARPoissonFlow":
        return od.poisson_flows(units, edges, periods=periods, seed=seed, key=key, **parameters)
    return od.flows(units, edges, periods=periods, seed=seed, key=key, **(FLOWS[model] | parameters))


SIMULATORS = [*MODELS, *TOBIT, *BINARY, *COUNT, *TWO_PART, *FLOWS, "SARPoissonFlow", "SARZINBFlow", "SARHurdleNegBinFlow"]
