"""Positions by the Poisson likelihood of the charges: dead tubes, hits on them, events without hits, no array function over all tubes."""

from __future__ import annotations

import math

import pandas as pd

from scintlake.functions import constants as K
from scintlake.functions import geometry as G
from scintlake.operators import energy as E
from scintlake.plans import physics as PH


def test_poisson_candidates_against_single_terms(spark):
    at = [G.sphere_point(i, K.N_ID, K.R_PMT) for i in range(K.N_ID)]
    dead = spark.createDataFrame([(7,), (1500,)], "cable long")
    hits = {(1, 1): [(3, 2.0), (7, 5.0), (900, 1.5), (1400, 4.0)], (1, 2): [(1878, 30.0)], (2, 1): []}
    place = {(1, 1): (10.0, -20.0, 300.0), (1, 2): (0.0, 0.0, -500.0), (2, 1): (50.0, 0.0, 0.0)}
    offsets = [(0.0, 0.0, 0.0), (50.0, 0.0, 0.0), (0.0, -50.0, 50.0)]
    h = spark.createDataFrame(pd.DataFrame([(*k, c, q) for k, v in hits.items() for c, q in v], columns=["run", "event", "cable", "q"]))
    v = spark.createDataFrame(pd.DataFrame([(*k, *p) for k, p in place.items()], columns=["run", "event", "x", "y", "z"]))
    got = {(r["run"], r["event"]): (r["cand"], r["score"]) for r in E.poisson_candidates(h, v, E.live_tubes(G.sensors(spark), dead), offsets, 2.0).collect()}

    def seen(i, p):
        d = [a - b for a, b in zip(at[i], p)]
        dist, r = math.hypot(*d), math.hypot(*at[i])
        cos = min(max(sum(a * b for a, b in zip(d, at[i])) / dist / r, 0.0), 1.0)
        return (0.1 + 0.9 * cos) * math.exp(-dist / K.ATTENUATION_CM) / dist ** 2

    for k, p in place.items():
        scores = []
        for o in offsets:
            x = [a + b for a, b in zip(p, o)]
            mu = {i: 2.0 * (K.ETA_17 if i < K.N_ID17 else K.ETA_20) * seen(i, x) / seen(i, (0, 0, 0)) for i in range(K.N_ID) if i not in (7, 1500)}
            scores.append(sum(q * math.log(mu[c]) for c, q in hits[k] if c in mu) - sum(mu.values()))
        assert got[k][0] == scores.index(max(scores)) and math.isclose(got[k][1], max(scores), rel_tol=1e-9)


def test_poisson_candidates_folds_no_array_of_all_tubes(spark, sf):
    """27 folds over 1879 interpreted entries took half a second of a core per event."""
    plan = PH.poisson_candidates(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "zip_with" not in plan
