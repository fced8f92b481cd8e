"""Estimators run by name from SQL."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scintlake.operators import custom as Y


@pytest.mark.parametrize("parts", [1, 7])
def test_moments(spark, parts):
    """One key has nearly all rows, over many Arrow batches; one has no value, one no key."""
    rng = np.random.default_rng(8)
    q = 1e6 + rng.normal(0, 3, 45_000)
    pdf = pd.DataFrame({"cable": 5, "event": np.arange(len(q)), "q": q})
    few = spark.createDataFrame([(6, 1, 2.0), (6, 2, None), (6, 3, 4.0), (7, 1, None), (None, 1, 1.5)], "cable long, event long, q double")
    Y.register(spark, "m", Y.Moments)
    got = {r.cable: r for r in Y.estimates(spark.createDataFrame(pdf).unionByName(few), "m", Y.Moments, parts, "event").collect()}
    assert set(got) == {5, 6, None}
    assert got[5].n == len(q) and got[5].mean == pytest.approx(q.mean(), rel=1e-12) and got[5].sigma == pytest.approx(q.std(), rel=1e-9)
    assert tuple(got[6])[1:] == (2, 3.0, 1.0) and tuple(got[None])[1:] == (1, 1.5, 0.0)
    assert Y.estimates(few.limit(0), "m", Y.Moments, parts, "event").count() == 0


def test_own_estimator(spark):
    class Loudest(Y.Estimator):
        """A user's estimator: the largest charge of a run, by another key than the built-in ones."""

        keys = "run string"
        values = "top double"

        def __init__(self):
            self.top = -np.inf

        def add(self, batch):
            self.top = max([self.top, *Y._numbers(batch, "q")[0]])

        def state(self):
            return [self.top]

        def merge(self, state):
            self.top = max(self.top, state[0])

        def estimate(self):
            return (self.top,) if np.isfinite(self.top) else None

    rows = spark.range(100).select(F.concat(F.lit("r"), F.col("id") % 3).alias("run"), F.col("id").alias("event"), F.col("id").cast("float").alias("q"))
    Y.register(spark, "loudest", Loudest)
    rows.createOrReplaceTempView("own_rows")
    one = spark.sql("SELECT run, top FROM loudest(TABLE(own_rows) PARTITION BY run)").collect()
    assert {tuple(r) for r in one} == {("r0", 99.0), ("r1", 97.0), ("r2", 98.0)}
    assert {tuple(r) for r in Y.estimates(rows, "loudest", Loudest, 4, "event").collect()} == {tuple(r) for r in one}
