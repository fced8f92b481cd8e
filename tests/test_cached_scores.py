"""Scores of events in pieces that fit a processor's cache, and light sums outside of interpreted array functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scintlake.functions import geometry as G
from scintlake.operators import energy as E
from scintlake.operators import locate as L
from scintlake.operators import track_scan as S


def test_light_sums_equal_the_rows_light(spark):
    """1879 tubes an event were folded by interpreted array functions."""
    rng = np.random.default_rng(3)
    rows = [(1, i, *map(float, rng.uniform(-500, 500, 3))) for i in range(20)] + [(1, 20, None, 1.0, 2.0), (None, 21, 0.0, 0.0, 0.0), (1, 0, 5.0, 6.0, 7.0)]
    v, tubes = spark.createDataFrame(rows, "run long, event long, x double, y double, z double"), E.live_tubes(G.sensors(spark)).where("cable <> 5")
    sums = E.light_sums(v, tubes)
    assert "lambda" not in sums._jdf.queryExecution().executedPlan().toString().lower()
    got = sums.toPandas().sort_values(["run", "event", "alpha"]).reset_index(drop=True)
    e = E.event_light(v, tubes)
    want = e.select("run", "event", F.size(F.array_compact("alpha")).cast("long").alias("n_live"), E._total(F.col("alpha")).alias("alpha"),
                    E._total(F.zip_with("tubes", "omega", lambda t, o: t["wq"] * o)).alias("alpha_q"), "eta_sum").toPandas().sort_values(["run", "event", "alpha"])
    pd.testing.assert_frame_equal(got, want.reset_index(drop=True), rtol=1e-12, check_dtype=False)


def test_flights_of_all_positions():
    rng = np.random.default_rng(4)
    pos, p = rng.uniform(-800, 800, (9, 3)), rng.uniform(-850, 850, (30, 3))
    for v_bo in (None, 19.5):
        flight, _, dist = L._flight(np.repeat(pos, 30, 0), np.tile(p, (9, 1)), 17.6, v_bo)
        got = L._flights(pos, p, 17.6, v_bo)
        assert np.array_equal(got[0], flight.reshape(9, 30)) and np.array_equal(got[1], dist.reshape(9, 30))


def test_tracks_are_scored_in_small_pieces(monkeypatch):
    """100,000 delays at once left the cache at every step; the tracks found are those of scoring them at once."""
    rng = np.random.default_rng(5)
    grid = S.ScanGrid(40, 1.5)
    xyz = S.grid_points(300)[rng.permutation(300)[:90]]
    t = rng.uniform(0, 300, 90)
    seen, delays = [], S.ScanGrid.delays

    def counted(self, to_points, part, work):
        out = delays(self, to_points, part, work)
        seen.append(out.size)
        return out
    monkeypatch.setattr(S.ScanGrid, "delays", counted)
    best, score, start = grid.best(t, xyz, 4e4, 12.0, 100_000, 5)
    assert max(seen) <= S.CACHED
    to_points = np.sqrt(((grid.points[:, None] - xyz) ** 2).sum(axis=2))
    offset = t - delays(grid, to_points, slice(None))
    first = np.quantile(offset, 0.15, axis=1)
    whole = (np.abs(offset - first[:, None]) < 12.0).sum(axis=1) / 90 - grid.penalty(4e4)
    assert best == grid.distinct_best(whole, 5)
    some = np.isfinite(score)
    assert np.array_equal(score[some], whole[some]) and np.array_equal(start[some], first[some])
