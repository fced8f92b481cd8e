"""Hits, waveforms, geometry, localisation, energy and tracks against synthetic truth."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scintlake.functions import constants as K
from scintlake.functions import geometry as G
from scintlake.functions import tracks as T
from scintlake.functions import waves as W
from scintlake.operators import calib as C
from scintlake.operators import cube as U
from scintlake.operators import energy as E
from scintlake.operators import hits as H
from scintlake.operators import locate as L
from scintlake.operators import track_scan as S
from scintlake.operators import waves as O


def sensor_xyz(n=K.N_ID):
    return S.grid_points(n, K.R_PMT)


# ---- hits -----------------------------------------------------------------------------------------------------------
def test_gain_collapse(spark):
    rows = [(7, 0, -250.0, 400.0, True), (7, 1, -249.0, 1500.0, True), (7, 2, -248.0, 9000.0, False), (9, 0, -240.0, 3.0, False), (2000, 0, -230.0, 5.0, False)]
    h = spark.createDataFrame([(1, 1, *r) for r in rows], "run long, event long, cable int, gain int, t double, q double, saturated boolean")
    g = H.gain_collapse(h).toPandas().set_index("cable")
    assert sorted(g.index) == [7, 9, 2000]
    assert (g.loc[7, "t"], g.loc[7, "q"], g.loc[7, "gain"]) == (-250.0, 9000.0, 2)


def test_all_gains_saturated_uses_the_lowest(spark):
    h = spark.createDataFrame([(1, 1, 7, 0, 1.0, 4.0, True), (1, 1, 7, 1, 2.0, 9.0, True)], "run long, event long, cable int, gain int, t double, q double, saturated boolean")
    r = H.gain_collapse(h).first()
    assert (r.t, r.q, r.gain, r.saturated) == (1.0, 9.0, 1, True)


def test_muon_selection(spark):
    d = spark.createDataFrame([(20000.0, 0), (600.0, 5), (600.0, 2), (300.0, 10)], "q double, n int")
    assert [r[0] for r in d.select(T.is_muon(F.col("q"), F.col("n"))).collect()] == [True, True, False, False]


def test_cable_without_found_pulse_has_no_primary(spark):
    h = spark.createDataFrame([(1, 1, 5, 0, None, 1.0, False), (1, 1, 6, 1, 3.0, 2.0, True), (1, 1, 6, 0, 9.0, 4.0, True), (1, 1, 6, 0, None, 4.0, False)],
                              "run long, event long, cable int, gain int, t double, q double, found boolean").withColumn("saturated", F.lit(False))
    p = H.primary_hits(h).toPandas()
    assert p[["cable", "gain", "t"]].values.tolist() == [[6, 0, 9.0]]
    e = H.event_totals(h).first()
    assert (e.nhit, e.nwave, e.q_total, e.nhit_od) == (1, 4, 4.0, 0)


# ---- waveforms ------------------------------------------------------------------------------------------------------
def pulse(t0, a, n=128):
    t = np.arange(n) - t0
    return np.where(t >= 0, a * np.exp(-np.maximum(t, 0) / 6) * (1 - np.exp(-np.maximum(t, 0) / 1.5)), 0.0)


def test_pulses(spark):
    rng = np.random.default_rng(0)
    w = [pulse(30, 40), pulse(30, 40) + pulse(70, 25), np.zeros(128)]
    rows = [(i, (v + rng.normal(0, 1, 128)).tolist()) for i, v in enumerate(w)]
    p = W.pulses(spark.createDataFrame(rows, "wf_id int, samples array<double>")).orderBy("wf_id").toPandas()
    assert p["found"].tolist() == [True, True, False]
    assert p["npulse"].tolist()[:2] == [1, 2]
    assert abs(p["q_total"][0] / w[0].sum() - 1) < 0.1 and 29 < p["t_cfd"][0] < 33
    assert np.isnan(p["t_cfd"][2]) and p["q_total"][2] == 0


def test_smoothing_keeps_the_area_and_matches_running_sums(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 10, 128).tolist()) for i in range(20)]
    got = W.smooth(spark.createDataFrame(rows, "i int, samples array<double>")).collect()
    for r in got:
        w = np.array(r.samples)
        d = np.empty(127)
        d[0], d[1], d[125], d[126] = w[1] - w[0], (w[3] - w[0]) / 3, (w[127] - w[124]) / 3, w[127] - w[126]
        d[2:125] = (w[5:] - w[:123]) / 5
        y = w[0] + np.append(0, np.cumsum(d))
        assert np.allclose(r.smoothed, y + (w.sum() - y.sum()) / 128)


def test_baseline(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(5, 1, 128)
    a[50:70] += 80
    rows = [(0, a.tolist()), (1, (a - 3).tolist())]
    b = W.baseline(spark.createDataFrame(rows, "i int, samples array<double>")).orderBy("i").toPandas()["baseline"]
    assert abs(b[0] - 5) < 0.5 and abs(b[1] - 2) < 0.5


def test_clock_period(spark):
    i = np.arange(128)
    rows = [(1, 0, 3, (50 * np.sin(2 * np.pi * i / 16.8) + 3).tolist()), (1, 0, 3, (50 * np.cos(2 * np.pi * i / 16.8)).tolist()),
            (2, 1, 3, np.zeros(128).tolist()), (2, 0, 0, (50 * np.sin(i)).tolist())]
    p = O.sampling_period(spark.createDataFrame(rows, "cable int, atwd int, gain int, samples array<double>")).toPandas().set_index("cable")
    assert p.loc[1, "n"] == 2 and abs(p.loc[1, "period"] - 16.8) < 0.1
    assert p.loc[2, "n"] == 0 and p.loc[2, "bin_ns"] == 1.49


def test_pedestal_quality(spark):
    flat, step = [100.0] * 10, [100.0] * 5 + [141.0] * 5
    d = spark.createDataFrame([(flat,), (step,), ([100.0] * 9 + [150.0],)], "s array<double>")
    assert [r[0] for r in d.select(W.is_flat(F.col("s"))).collect()] == [True, False, False]


# ---- geometry and tracks ----------------------------------------------------------------------------------------------
def test_path_lengths(spark):
    s = G.sensors(spark, K.N_ID)
    p = (F.col("px"), F.col("py"), F.col("pz"))
    a = s.select(*[c.alias(n) for c, n in zip(G.path_lengths((0, 0, 0), p), ("ls", "bo", "d"))]).toPandas()
    assert np.allclose(a.ls, 650, atol=0.5) and np.allclose(a.ls + a.bo, a.d)
    b = s.select(*[c.alias(n) for c, n in zip(G.path_lengths((0, 0, 600), p), ("ls", "bo", "d"))]).toPandas()
    assert b.ls.min() < 100 and b.bo.min() > 150


def test_track_geometry(spark):
    d = spark.createDataFrame([(-850.0, 0.0, 0.0, 850.0, 0.0, 0.0)], "ex double, ey double, ez double, xx double, xy double, xz double")
    r = S.track_columns(d).first()
    assert r.impact < 1e-6 and r.l_ls == pytest.approx(1300)
    b = spark.createDataFrame([(0.0,), (700.0,), (800.0,)], "b double").select(T.chord(F.col("b"), 650.0), T.effective_index(F.col("b"))).collect()
    assert b[1][0] == 0 and b[0][1] == 1.65 and 1.4 < b[1][1] < 1.5 and b[2][1] == 1.4
    y = F.lit(800.0)
    z = F.lit(0.0)
    miss = spark.range(1).select(T.crossings((F.lit(-900.0), y, z), (F.lit(1.0), z, z), 650.0)[0]).first()[0]
    assert miss is None


def test_first_light_is_the_earliest_emission(spark):
    e, x = np.array([300.0, -200, 700]), np.array([-500.0, 100, -600])
    pos = sensor_xyz(200)
    d = spark.createDataFrame([tuple(map(float, v)) for v in pos], "px double, py double, pz double")
    lit3 = lambda v: tuple(F.lit(float(c)) for c in v)
    got = np.array([r[0] for r in d.select(T.first_light((F.col("px"), F.col("py"), F.col("pz")), lit3(e), lit3(x), F.lit(0.0))).collect()])
    s = np.linspace(0, 1, 4001)[:, None]
    line = e + s * (x - e)
    length = np.linalg.norm(x - e)
    brute = (s * length / K.C_CM_NS + 1.5 * np.linalg.norm(pos[None] - line[:, None], axis=2) / K.C_CM_NS).min(0)
    assert (got <= brute + 1e-9).all() and (brute - got).max() < 0.02


def test_track_scan(spark):
    e, x = 850 * np.array([300., -200, 700]) / np.linalg.norm([300, -200, 700]), 850 * np.array([-500., 100, -600]) / np.linalg.norm([-500, 100, -600])
    pos = sensor_xyz()[:K.N_ID17]
    u = (x - e) / np.linalg.norm(x - e)
    d = pos - e
    z = d @ u
    off = np.sqrt(np.maximum((d * d).sum(1) - z * z, 0))
    tan = math.sqrt(1.25)
    em = z - off / tan
    length = np.linalg.norm(x - e)
    t = np.where(em < 0, 1.5 * np.linalg.norm(d, axis=1), np.where(em > length, length + 1.5 * np.linalg.norm(pos - x, axis=1), z + off * tan)) / K.C_CM_NS
    t = t + np.random.default_rng(0).normal(0, 2, len(t)) - 200
    pdf = pd.DataFrame({"run": 1, "event": 1, "cable": np.arange(K.N_ID17), "t": t, "q": 5.0, "px": pos[:, 0], "py": pos[:, 1], "pz": pos[:, 2]})
    c = S.track_scan(spark.createDataFrame(pdf), n_points=60).orderBy("rank").toPandas()
    assert len(c) == 20 and (c.score.diff().dropna() <= 1e-12).all()
    spacing = math.sqrt(4 * math.pi / 60) * 850
    b = c.iloc[0]
    assert np.linalg.norm([b.ex - e[0], b.ey - e[1], b.ez - e[2]]) < spacing and np.linalg.norm([b.xx - x[0], b.xy - x[1], b.xz - x[2]]) < spacing


def test_greedy_distinct(spark):
    rows = [(1, 9.0, 0.0, 0.0), (1, 8.0, 10.0, 10.0), (1, 7.0, 500.0, 0.0), (1, 6.0, 505.0, 5.0), (1, 5.0, 0.0, 900.0)]
    d = spark.createDataFrame([(r[0], r[1], r[2], 0.0, 0.0, r[3], 0.0, 0.0) for r in rows], "g int, s double, ex double, ey double, ez double, xx double, xy double, xz double")
    assert [r.s for r in S.greedy_distinct(d, ["g"], "s", 150.0, 3).orderBy("place").collect()] == [9.0, 7.0, 5.0]


def test_od_orientation(spark):
    rng = np.random.default_rng(1)
    e, x = np.array([0., 0, 850]), np.array([0., 0, -850])
    od = 900 * S.grid_points(30, 1.0)
    t = 10 + (850 - od[:, 2]) / K.C_CM_NS + rng.normal(0, 25, 30)
    hits = pd.DataFrame({"run": 1, "event": 1, "t": t, "px": od[:, 0], "py": od[:, 1], "pz": od[:, 2]})
    tr = pd.DataFrame([[1, 1, 0, 10.0, *e, *x], [1, 1, 1, 10.0, *x, *e]], columns="run event rank t0 ex ey ez xx xy xz".split())
    o = S.od_terms(spark.createDataFrame(tr), spark.createDataFrame(hits)).orderBy("rank").toPandas()["od_term"]
    assert 0.5 < o[0] < 1.5 and o[1] > o[0]
    few = S.od_terms(spark.createDataFrame(tr), spark.createDataFrame(hits.head(3))).toPandas()["od_term"]
    assert (few == 0).all()


# ---- localisation and energy --------------------------------------------------------------------------------------------
def events_at(src, n_events=40, n_hits=500, v=19.0, seed=0, t0=-280.0):
    rng = np.random.default_rng(seed)
    pos = sensor_xyz()
    rows = []
    for ev in range(n_events):
        c = rng.choice(K.N_ID, n_hits, replace=False)
        t = np.linalg.norm(pos[c] - src, axis=1) / v + t0 + rng.normal(0, 2.0, n_hits) + np.where(rng.random(n_hits) < 0.2, rng.exponential(25, n_hits), 0)
        rows.append(pd.DataFrame({"run": 1, "event": ev, "cable": c, "t": t, "q": 1.0, "px": pos[c, 0], "py": pos[c, 1], "pz": pos[c, 2]}))
    return pd.concat(rows, ignore_index=True)


def test_locate(spark):
    src = np.array([100.0, -50.0, 300.0])
    r = L.locate(spark.createDataFrame(events_at(src)), v_ls=19.0).toPandas()
    assert len(r) == 40 and r.ok.mean() > 0.9
    d = np.linalg.norm(r.loc[r.ok, ["x", "y", "z"]].to_numpy() - src, axis=1)
    assert np.median(d) < 15 and d.max() < 40
    assert (abs(r.loc[r.ok, "t0"] + 280) < 5).all()


def test_locate_needs_four_hits(spark):
    pdf = events_at(np.zeros(3), 2, 500)
    few = pdf[(pdf.event == 0) | (pdf.index < 3)].head(3).assign(event=9)
    r = L.locate(spark.createDataFrame(pd.concat([pdf, few])), v_ls=19.0).toPandas().set_index("event")
    assert not r.loc[9, "ok"] and np.isnan(r.loc[9, "x"]) and r.loc[9, "n_hits"] == 3


def test_grid_likelihood_improves_position(spark):
    src = np.array([100.0, -50.0, 300.0])
    pdf = events_at(src, 6, 500)
    bins = np.arange(520)
    tau = -40 + 0.5 * (bins + 0.5)
    dens = np.where(tau >= -5, np.exp(-np.abs(tau) / 6.0), np.exp(tau / 2.0)) + 1e-4
    lp = np.log(dens / dens.sum() / 0.5)
    cube = pd.DataFrame([(a, b, c, i, lp[i]) for a in range(2) for b in range(4) for c in range(4) for i in bins], columns="type qbin dbin tbin logp".split())
    h = spark.createDataFrame(pdf)
    start = h.select("run", "event").distinct().select("*", F.lit(125.0).alias("x"), F.lit(-75.0).alias("y"), F.lit(275.0).alias("z"), F.lit(-280.0).alias("t0"), F.lit(True).alias("ok"))
    g = L.grid_likelihood(h, start, spark.createDataFrame(cube), 19.0, 19.0, -40.0, 0.5, 25.0, 1).toPandas()
    assert len(g) == 6
    assert np.median(np.linalg.norm(g[["x", "y", "z"]].to_numpy() - src, axis=1)) < 26


def test_hit_energy_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    pos = sensor_xyz()
    eta = np.where(np.arange(K.N_ID) < K.N_ID17, K.ETA_17, K.ETA_20)
    vertex = np.array([0.0, 0.0, 200.0])

    def acc(p):
        d = pos - p
        r = np.linalg.norm(d, axis=1)
        cos = np.clip((d * pos).sum(1) / (r * np.linalg.norm(pos, axis=1)), 0, 1)
        return (0.1 + 0.9 * cos) * np.exp(-r / 2500) / r ** 2
    alpha = eta * acc(vertex) / acc(np.zeros(3))
    hit = rng.random(K.N_ID) < 1 - np.exp(-2.5 * alpha)
    h = pd.DataFrame({"run": 1, "event": 1, "cable": np.flatnonzero(hit), "res": 0.0, "q": 1.0})
    v = spark.createDataFrame([(1, 1, *map(float, vertex))], "run long, event long, x double, y double, z double")
    got = E.hit_energy(spark.createDataFrame(h), v, E.live_tubes(G.sensors(spark))).first()
    grid = np.arange(0.5, 6, 0.001)
    mu = grid[:, None] * alpha
    ll = np.where(hit, np.log(-np.expm1(-mu)), -mu).sum(1)
    assert got.n_live == K.N_ID and got.n_hit == hit.sum()
    assert got.e_hit == pytest.approx(grid[ll.argmax()], abs=0.002) and abs(got.e_hit / 2.5 - 1) < 0.15


def test_visible_energy_nodes(spark):
    x, r, c = [0.5, 2.0, 8.0], [0.84, 0.93, 0.98], [0.0, -0.02, 0.0]
    d = spark.createDataFrame([(v,) for v in x], "e double").select("e", E.visible_energy(F.col("e"), x, r, c).alias("v"))
    got = d.select("v", E.real_energy(F.col("v"), x, r, [0.0, 0.0, 0.0]).alias("b"), "e").collect()
    assert np.allclose([g.v for g in got], np.multiply(x, r)) and np.allclose([g.b for g in got], x)


# ---- calibration passes --------------------------------------------------------------------------------------------------
def test_t0_is_recovered(spark):
    rng = np.random.default_rng(8)
    pos, n = sensor_xyz(60), 60
    off = rng.normal(0, 5, n)
    off -= off.mean()
    rows = []
    for ev in range(250):
        t = off + 850 / 17.6 + 100 * rng.random() + rng.normal(0, 1.0, n)
        rows.append(pd.DataFrame({"run": 1, "event": ev, "cable": np.arange(n), "atwd": 0, "t": t, "q": 2.0}))
    s = spark.createDataFrame(pd.DataFrame({"cable": np.arange(n), "px": pos[:, 0], "py": pos[:, 1], "pz": pos[:, 2]}))
    got = C.t0_fixed_vertex(spark.createDataFrame(pd.concat(rows)), s, statistic="median").toPandas().sort_values("cable")
    assert len(got) == n and np.abs(got["t0"].to_numpy() - off).max() < 0.6


def test_survey_recovers_offsets(spark):
    rng = np.random.default_rng(9)
    pos, shift, dt = sensor_xyz(40), rng.normal(0, 5, (40, 3)), rng.normal(0, 1, 40)
    zs = np.array([-550.0, -300, -100, 0, 100, 300, 550])
    rows = []
    for k, z in enumerate(zs):
        d = pos - [0, 0, z]
        u = d / np.linalg.norm(d, axis=1)[:, None]
        m = dt + (u * shift).sum(1) / 18.0
        rows.append(pd.DataFrame({"run": k, "cable": np.arange(40), "n": 100, "mode": m}))
    s = spark.createDataFrame(pd.DataFrame({"cable": np.arange(40), "px": pos[:, 0], "py": pos[:, 1], "pz": pos[:, 2]}))
    src = spark.createDataFrame([(k, 0.0, 0.0, float(z)) for k, z in enumerate(zs)], "run long, sx double, sy double, sz double")
    out = U.survey_positions(U.survey_rows(spark.createDataFrame(pd.concat(rows)), src, s, 18.0, 18.0)).toPandas().sort_values("cable")
    # numpy with the same prior
    for i in (0, 7, 23):
        d = pos[i] - np.stack([0 * zs, 0 * zs, zs], 1)
        j = np.column_stack([np.ones(7), d / np.linalg.norm(d, axis=1)[:, None] / 18.0])
        m = np.concatenate([r["mode"].to_numpy()[i:i + 1] for r in rows])
        w = np.linalg.solve(j.T @ j + np.diag([0] + [1 / 900] * 3), j.T @ m)
        assert np.allclose(out.iloc[i][["dt", "dx", "dy", "dz"]].astype(float), w, atol=1e-6)


def test_density_levels_and_interpolation(spark):
    rng = np.random.default_rng(10)
    n = 6000
    pdf = pd.DataFrame({"run": 1, "event": 1, "cable": rng.integers(0, 1300, n), "q": np.where(rng.random(n) < 0.9, 1.0, 4.0),
                        "d": rng.uniform(100, 1200, n), "res": rng.exponential(20, n) + rng.normal(0, 2, n)})
    counts = U.density_counts(spark.createDataFrame(pdf))
    cube = U.density_cube(counts).cache()
    level = cube.select("type", "qbin", "dbin", "level").distinct().toPandas().set_index(["type", "qbin", "dbin"])["level"]
    assert level[(0, 0, 0)] in (0, 1) and level[(0, 2, 0)] == 2 and level[(1, 0, 0)] == 2
    flat = cube.where("type = 1").select("logp", "dlogp").distinct().collect()
    assert len(flat) == 1 and flat[0].dlogp == 0
    c = cube.where("type = 0 and qbin = 0 and dbin = 0").orderBy("tbin").toPandas()
    probe = spark.createDataFrame(pd.DataFrame({"run": 1, "event": 1, "cable": 5, "q": 1.0, "d": 200.0, "res": [0.0, 20.0, 300.0]}))
    got = U.lookup_density(probe, cube, columns=("logp", "dlogp")).orderBy("res").toPandas()
    x = -40 + 0.5 * (c.tbin.to_numpy() + 0.5)
    assert np.allclose(got.logp, np.interp([0.0, 20.0, 300.0], x, c.logp), atol=1e-4)
    assert got.dlogp[1] < 0


def test_t0_from_used_hits(spark):
    rng = np.random.default_rng(11)
    off = {0: -3.0, 1: 1.0, 2: 2.0}
    rows = [(c, 0, float(o + rng.normal(0, 0.1)), True) for c, o in off.items() for _ in range(25)]
    rows += [(0, 0, 500.0, False)] * 50 + [(7, 0, 1.0, True)] * 3 + [(1900, 0, 9.0, True)] * 30
    t = C.t0_from_used(spark.createDataFrame(rows, "cable long, atwd long, tau double, used boolean")).toPandas().set_index("cable")["t0"]
    assert sorted(t.index) == [0, 1, 2] and all(abs(t[c] - o) < 0.1 for c, o in off.items())
