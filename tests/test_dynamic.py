"""Dynamic panels: the restricted model's parameters are found."""

import numpy as np

from lagweave.dgp import designs
from lagweave.models import gaussian
from lagweave.operators import weights


def test_restricted_dynamics(spark):
    edges = weights.lattice(spark, 9).cache()
    units = spark.range(81).withColumnRenamed("id", "unit_id")
    panel = designs.dynamic_panel(units, edges, 6, rho=0.4, phi=0.5, restricted=True, seed=3).cache()
    fit = gaussian.fit("SDM", panel, edges, "y", ["x1"], time="time", dynamic="restricted", draws=200, tune=100, n_chains=1)
    mean = fit.means()
    assert "L_W_y" not in mean and abs(mean["rho"] - 0.4) < 0.15 and abs(mean["L_y"] - 0.5) < 0.1 and abs(mean["x1"] - 2) < 0.2
    # The density is that of the filtered regression, worked out at one rho.
    k, r = fit.kernel, 0.3
    rows = fit.lagged.toPandas()
    z = rows[k.names].to_numpy()
    z[:, k.names.index("L_y")] -= r * rows["W_L_y"].to_numpy()
    t = (rows["y"] - r * rows["W_y"]).to_numpy()
    zz, zy, yy = k.parts(r)
    assert np.allclose(zz, z.T @ z, rtol=1e-8) and np.allclose(zy, z.T @ t, rtol=1e-8) and np.isclose(yy, t @ t, rtol=1e-8)
