"""The polynomial machine against the dual problem with a kernel matrix."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import kernel
from panelloom.operators.learners import polynomial_svc


def test_monomials_give_the_kernel():
    rng = np.random.default_rng(0)
    x, z = rng.normal(size=(4, 3)), rng.normal(size=(5, 3))
    for degree, gamma, coef0 in ((3, 0.5, 0.0), (2, 1.5, 0.7), (1, 2.0, 0.0)):
        terms = kernel.monomials(3, degree, gamma, coef0)
        got = kernel.expand(x, terms)[:, 1:] @ kernel.expand(z, terms)[:, 1:].T
        assert got == pytest.approx((gamma * x @ z.T + coef0) ** degree)


def dual(k, y, c, rounds=4000):
    """Sequential minimal optimisation over the most violating pair."""
    a, g = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(rounds):
        up = ((y > 0) & (a < c)) | ((y < 0) & (a > 0))
        low = ((y > 0) & (a > 0)) | ((y < 0) & (a < c))
        v = -y * g
        i, j = np.where(up)[0][np.argmax(v[up])], np.where(low)[0][np.argmin(v[low])]
        if v[i] - v[j] < 1e-8:
            break
        step = (v[i] - v[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        room = [c - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c - a[j]]
        step = min(step, *room)
        a[i] += y[i] * step
        a[j] -= y[j] * step
        g += y * (k[:, i] - k[:, j]) * step
    return (a * y), (v[i] + v[j]) / 2


@pytest.mark.parametrize("c", [0.05, 1.0])
def test_margins_agree_with_the_exact_kernel_machine(spark, c):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 2))
    y = (x[:, 0] ** 3 + x[:, 1] + 0.5 * rng.normal(size=150) > 0).astype(float) + (x[:, 0] > 1)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, y double")
    model = polynomial_svc(["a", "b"], "y", 3, 3, c, gamma=0.5, coef0=1.0).fit(df)
    for a, b in itertools.combinations(range(3), 2):
        own = (y == a) | (y == b)
        k = (0.5 * x[own] @ x[own].T + 1) ** 3
        alpha, bias = dual(k, np.where(y[own] == a, 1.0, -1.0), c)
        got = kernel.expand(x[own], model.terms) @ model.weights[a, b]
        assert np.abs(got - (k @ alpha + bias)).max() < 0.01 * max(1, np.abs(got).max())
    out = model.transform(df.union(df.limit(1).select(F.lit(None), "b", "y")))
    assert out.where("pred IS NULL").count() == 1
    assert out.where("pred = y").count() > 115


def test_a_class_without_rows(spark):
    df = spark.createDataFrame([(float(i % 5), 0.0) for i in range(20)], "a double, y double")
    model = polynomial_svc(["a"], "y", 2, 2, 1.0).fit(df)
    assert {r.pred for r in model.transform(df).collect()} == {0.0}
    with pytest.raises(ValueError):
        polynomial_svc([f"x{i}" for i in range(60)], "y", 2, 3)
