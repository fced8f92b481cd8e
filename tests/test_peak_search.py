"""The peak fit against a dense numpy scan of centre and width, and its results for odd groups."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scintlake.operators import fits as X


def cost(at, y, mu, sigma):
    """Least weighted squares over height and level, neither negative."""
    w, u = 1 / np.maximum(y, 1), np.exp(-(((at - mu) / sigma) ** 2) / 2)
    best = np.inf
    for base in (np.vstack([u, np.ones_like(u)]), u[None], np.ones((1, len(u)))):
        c = np.linalg.lstsq((base * np.sqrt(w)).T, y * np.sqrt(w), rcond=None)[0]
        if (c >= 0).all():
            best = min(best, (w * (y - c @ base) ** 2).sum())
    return best


def test_peak_is_least_cost(spark):
    rng = np.random.default_rng(9)
    parts = {"a": np.concatenate([rng.normal(900, 40, 3000), rng.uniform(0, 2000, 2000)]), "b": rng.normal(50, 12, 800)}
    rows = pd.concat([pd.DataFrame({"g": g, "x": x}) for g, x in parts.items()])
    got = X.peak_fit(spark.createDataFrame(rows), ["g"], F.col("x")).toPandas().set_index("g")
    for g, x in parts.items():
        a = x.min() - 10
        y = np.histogram(x, a + 10 * np.arange(int((x.max() - a) / 10) + 3))[0].astype(float)
        top = int(np.convolve(y, np.ones(3), "same").argmax())
        at = np.arange(max(top - 30, 0), min(top + 31, len(y)))
        place, use = a + 10 * (at + 0.5), y[at]
        mu, sigma = got.loc[g, "mu"], got.loc[g, "sigma"]
        found = cost(place, use, mu, sigma)
        scan = min(cost(place, use, m, s) for m in mu + np.linspace(-20, 20, 41) for s in np.linspace(4, 80, 77))
        assert found <= scan + 1e-6
        assert got.loc[g, "n"] == len(x)


def test_odd_groups(spark):
    """Few entries, one value only, a null key, nulls and not-a-numbers, and a group with a very wide range."""
    rows = [("few", float(i)) for i in range(9)] + [("same", 5.0)] * 40 + [(None, float(i % 7)) for i in range(30)]
    rows += [("wide", 1e7 * i) for i in range(12)] + [("none", None), ("none", float("nan"))]
    got = {r["g"]: r for r in X.peak_fit(spark.createDataFrame(rows, "g string, x double"), ["g"], F.col("x")).collect()}
    assert set(got) == {"few", "same", None, "wide"}
    assert got["few"]["n"] == 9 and got["few"]["mu"] is None and got["few"]["n_peak"] == 0
    # two bins don't determine a centre
    assert np.isfinite(got["same"]["mu"]) and got["same"]["n"] == 40
    assert got[None]["n"] == 30 and got["wide"]["n"] == 12 and got["wide"]["sigma"] >= 3
    assert X.peak_fit(spark.createDataFrame([], "g string, x double"), ["g"], F.col("x")).count() == 0
