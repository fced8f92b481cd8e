"""The registered queries take all rows, or those of the source window, and no others."""

import numpy as np
from pyspark.sql import functions as F

from scintlake import views
from scintlake.operators.hist import source_peak
from scintlake.plans import load

SF = "/root/testdata/sf0.001"


def test_both_detectors_is_the_union(spark):
    sf = "/root/testdata/sf0.01"      # the smallest table has no outer hits
    h = views.hits(spark, sf)
    assert h.where("cable >= 1879 and q < 10").count() > 0
    got = load().QUERIES["both_detectors"](spark, sf)
    assert {r.part: r["count"] for r in got.groupBy("part").count().collect()} == {
        r.part: r["count"] for r in h.groupBy(F.when(F.col("cable") < 1879, "inner").otherwise("outer").alias("part")).count().collect()}


def test_energy_scale_takes_the_source_window(spark):
    t = views.trig(spark, SF).select("run", "event", "q17", F.col("nhit").cast("double").alias("nhit")).toPandas()
    peak = {r.run: r.peak for r in source_peak(views.trig(spark, SF), ["run"], F.col("nhit")).collect()}
    got = load().QUERIES["energy_scale"](spark, SF).toPandas().set_index(["run", "event"])
    assert len(got) == len(t) and any(p is not None for p in peak.values())
    for run, g in t.groupby("run"):
        p = peak.get(run)
        w = g[(g.nhit > 0.8 * p) & (g.nhit < 1.2 * p)] if p is not None else g[:0]
        for c in ("q17", "nhit"):
            m = np.median(w[c]) if len(w) else 0
            want = g.set_index("event")[c] * (2.506 / m if m else 1)
            assert np.allclose(got.loc[run][c].reindex(want.index), want, atol=1e-5)
