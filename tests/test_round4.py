"""Event times and modes in Arrow batches: null and outlying values, groups across batches, inputs worked out once."""

from __future__ import annotations

import inspect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from scintlake.functions import geometry as G
from scintlake.operators import calib as C
from scintlake.operators import hist as B
from scintlake.operators import segments as S
from scintlake.operators import track_scan as TS
from scintlake.plans import physics as PH


def test_null_times_are_left_out_without_a_filter_on_the_whole_expression(spark):
    """A filter on tau repeated its expression, path lengths and all, in the condition of the join with the sensors."""
    pdf = pd.DataFrame({"run": 1, "event": np.repeat([1, 2], 40), "cable": np.tile(np.arange(40), 2), "t": 500.0, "q": 1.0})
    h = spark.createDataFrame(pdf).withColumn("z", F.when(F.col("event") == 1, F.lit(100.0)))
    tau = C.time_of_flight_corrected(h, G.sensors(spark), (F.lit(0.0), F.lit(0.0), F.col("z")), 17.0, 19.0)
    timed = C.with_event_time(tau)
    assert "sqrt" not in timed._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1].split("\n", 1)[0].lower()
    assert {r["event"] for r in timed.select("event").distinct().collect()} == {1}
    assert timed.where("head").count() == 1


def test_groups_across_batches_and_null_keys():
    key, x = [None, None, 1, 1, 1, 2, 3, 3], [1.0, None, 2.0, 3.0, 4.0, None, 5.0, 6.0]
    batches = pa.table({"k": pa.array(key, pa.int64()), "x": x}).to_batches(max_chunksize=2)
    got = [(t["k"].to_pylist(), first.tolist()) for t, first in S.whole_groups(batches, ["k"], "x")]
    assert [k for ks, _ in got for k in ks] == [None, 1, 1, 1, 3, 3]
    assert [f for _, fs in got for f in fs] == [True, True, False, False, True, False]


def test_event_time_of_far_outliers_needs_no_bins_between():
    x = np.array([-1e12, 10.0, 10.5, 11.0, 11.5, 1e12])
    got = C._times(np.tile(x, 2), np.arange(12) % 6 == 0, 10.0, (0.02, 0.98), 2)
    assert got.tolist() == [10.75, 10.75] or np.isnan(got).all()


def test_mode_works_out_its_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    d = spark.createDataFrame(pd.DataFrame({"g": np.repeat([1, 2], 500), "x": np.arange(1000) % 377 / 7.0}))
    got = B.grouped_mode(d.mapInArrow(count, d.schema), ["g"], F.col("x"), 0.5, 5, 10).collect()
    assert len(got) == 2 and seen.value == 1000


def test_track_scan_leaves_out_only_tracks_that_cannot_be_chosen():
    grid, rng = TS.ScanGrid(40, 1.5), np.random.default_rng(3)
    for q17, n in ((185000.0, 200), (3e6, 60), (500.0, 25), (None, 30)):
        xyz = rng.normal(size=(n, 3))
        xyz *= 850 / np.sqrt((xyz ** 2).sum(axis=1))[:, None]
        t = np.round(rng.uniform(0, 400, n))
        best, score, start = grid.best(t, xyz, q17, 12.0, 5000, 8)
        to_points = np.sqrt(((grid.points[:, None] - xyz) ** 2).sum(axis=2))
        offset = t - grid.delays(to_points, slice(None))
        early = np.quantile(offset, 0.15, axis=1)
        every = (np.abs(offset - early[:, None]) < 12.0).sum(axis=1) / n - grid.penalty(q17)
        want = grid.distinct_best(every, 8)
        assert best == want and (score[best] == every[want]).all() and (start[best] == early[want]).all()
        if q17 == 185000.0:
            assert np.isneginf(score).mean() > 0.3       # those were scored before


def test_grid_likelihood_reads_its_residuals_from_a_written_stage():
    """They were worked out anew for the cube, the event times and the energies."""
    source = inspect.getsource(PH.grid_likelihood)
    assert 'stage(centre_residuals(spark, sf), "residuals")' in source and source.count("centre_residuals(") == 1
