"""Formulas against columns worked out by hand."""

import math

import pytest

from lagweave.plans.formula import compile_formula


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(1, 2.0, 3.0, "b", 1.0), (2, 4.0, 5.0, "a", 2.0), (3, 1.0, None, "c", 3.0)], "k long, x double, z double, g string, y double")


def test_terms(frame):
    c = compile_formula("y ~ x*z + log(x) + C(g) + I(x**2) - z", frame)
    out, names = c.apply(frame, ["k"])
    assert names == ["x", "x:z", "log(x)", "C(g)[b]", "C(g)[c]", "I(x**2)"] and c.intercept
    assert [tuple(r) for r in out.orderBy("k").collect()] == [(1, 1.0, 2.0, 6.0, math.log(2), 1.0, 0.0, 4.0), (2, 2.0, 4.0, 20.0, math.log(4), 0.0, 0.0, 16.0)]


def test_intercept_and_errors(frame):
    assert not compile_formula("y ~ 0 + x", frame).intercept and not compile_formula("y ~ x - 1", frame).intercept
    for bad in ("y ~ nothing", "log(y) ~ x", "y + x", "y ~ log(x"):
        with pytest.raises(ValueError):
            compile_formula(bad, frame)
