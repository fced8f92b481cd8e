"""The track of the last real tag against an event loop: retriggers, tags without a track, tracks carried over block borders."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scintlake.operators import correlate as C

DEAD, SOFT, HARD, ID_HITS = 40, 5.0, 9.0, 30


def events(seed=3, n=400):
    rnd = random.Random(seed)
    rows, ts = [], 0
    for i in range(n):
        ts += rnd.choice([1, 3, 7, 300 if i % 50 == 0 else 5])
        p = [rnd.uniform(-900, 900) for _ in range(9)]
        rows.append((i % 2, i, ts, rnd.uniform(0, 10), rnd.randrange(60), *p, rnd.random() < 0.7, rnd.random() < 0.6))
    return rows


def sequential(rows):
    """(run, event) -> (retrigger, od_only, prev_event, distance), one event after the other."""
    out, state = {}, {}
    for run, event, ts, q, nhit, x, y, z, ex, ey, ez, lx, ly, lz, ok, conv in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        last_ts, last_event, track = state.get(run, (None, -1, None))
        tag, hard = q >= SOFT, q >= HARD
        retrigger = tag and not hard and last_ts is not None and ts - last_ts < DEAD
        only = tag and not hard and nhit < ID_HITS
        dist = None
        if not tag and ok and track is not None:
            (a, b, c), u = track
            d = (x - a, y - b, z - c)
            along = sum(i * j for i, j in zip(d, u))
            dist = math.sqrt(max(sum(i * i for i in d) - along ** 2, 0))
        out[run, event] = (retrigger, only, last_event, dist)
        if tag and not retrigger:
            length = math.dist((ex, ey, ez), (lx, ly, lz))
            u = tuple((j - i) / length for i, j in zip((ex, ey, ez), (lx, ly, lz)))
            state[run] = (ts, event, ((ex, ey, ez), u) if conv and not only else None)
    return out


@pytest.mark.parametrize("width", [None, 500, 90])
def test_track_of_the_last_tag(spark, width):
    rows = events()
    names = "run long, event long, ts long, q17 double, nhit long, x double, y double, z double, ex double, ey double, ez double, xx double, xy double, xz double, vertex_ok boolean, converged boolean"
    hard = F.col("q17") >= HARD
    e, x = (tuple(F.col(k + c) for c in "xyz") for k in "ex")
    only = C.od_only(F.col("is_tag"), hard, F.col("nhit"), ID_HITS)
    t = C.tag_previous(spark.createDataFrame(rows, names), F.col("q17") >= SOFT, hard, DEAD, width, C.track_payload(e, x, F.col("converged") & ~only))
    d = C.track_distance(tuple(F.col(c) for c in "xyz"), F.col("vertex_ok") & ~F.col("is_tag"), F.col("prev_track"))
    want = sequential(rows)
    got = {(r["run"], r["event"]): (r["retrigger"], r["only"], r["prev_event"], r["d"]) for r in t.select("*", only.alias("only"), d.alias("d")).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k][:3] == v[:3] and got[k][3] == (None if v[3] is None else pytest.approx(v[3], abs=1e-6)), k
    dist = [v[3] for v in want.values()]
    assert sum(v is not None for v in dist) > 40 and any(v[3] is None and v[2] >= 0 for v in want.values())


def test_yields_count_every_parent_class(spark):
    parents = spark.createDataFrame([(1, 20.0, True, 5.0), (1, 2.0, True, 0.0), (1, 30.0, None, None), (2, 1.0, False, 9.0)], "run long, q17 double, converged boolean, l_ls double")
    cands = spark.createDataFrame([(1, 20.0, True, 5.0, True), (1, 30.0, None, None, True), (1, 2.0, True, 0.0, False)], "run long, mu_q17 double, mu_converged boolean, mu_l_ls double, sel boolean")
    got = {(r["run"], r["parent"]): (r["n_parent"], r["n_selected"]) for r in C.parent_yields(cands, parents, F.col("sel"), bright=10.0).collect()}
    assert got == {(1, "all"): (3, 2), (1, "ls"): (1, 1), (1, "id"): (3, 2), (2, "all"): (1, 0)}
