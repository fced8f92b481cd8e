"""Source localisation and position likelihoods (A41-A44, UD2, UD4, J11, J12, C22, C23)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import stage
from .hist import source_peak

EVENT = ["run", "event"]
R_MAX = 800.0
#: positions by hits or tubes that are worked on at once, few enough for a processor's cache
CACHED = 12_000


def centroid(hits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Charge-weighted centroid, expanded and capped in radius (A41); zero when there is no charge."""
    keys = keys or EVENT
    w = F.least(F.greatest(F.col("q"), F.lit(0.0)), F.lit(20.0))
    g = hits.groupBy(*keys).agg(F.sum(w).alias("_w"), *[F.sum(w * F.col(p)).alias(f"_{p}") for p in ("px", "py", "pz")])
    c = [F.when(F.col("_w") > 0, F.col(f"_{p}") / F.col("_w") / 0.62).otherwise(0.0) for p in ("px", "py", "pz")]
    g = g.select(*keys, *[v.alias(n) for v, n in zip(c, "xyz")])
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    s = F.when(r > R_MAX, R_MAX / r).otherwise(1.0)
    return g.select(*keys, *[(F.col(n) * s).alias(n) for n in "xyz"])


def fit_hits(hits: DataFrame, min_q: float = 0.3) -> DataFrame:
    """Hits a position fit may use."""
    return hits.where((F.col("cable") < K.N_ID) & F.col("t").isNotNull() & (F.col("q") >= min_q))


def packed(hits: DataFrame, columns: tuple = ("t", "q", "px", "py", "pz")) -> DataFrame:
    """One row per event with equally long arrays; an event has at most one hit per cable, so arrays are bounded."""
    g = hits.groupBy(*EVENT).agg(F.sort_array(F.collect_list(F.struct("cable", *columns))).alias("_h"))
    return g.select(*EVENT, *[F.col(f"_h.{c}").alias(c) for c in ("cable", *columns)])


# ---- windowed Gauss-Newton for all events of a batch at once ---------------------------------------------------------
# Hits of a batch are kept flat with the number of their event; per-event sums are bincounts, the 3 x 3 systems of all
# events are solved together, and finished events keep their state.
def _sums(ev: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(ev, weights=w, minlength=n)


def _flight(pos, p, v_ls, v_bo):
    d = p - pos
    dist = np.maximum(np.sqrt((d * d).sum(1)), 1e-6)
    u = d / dist[:, None]
    if v_bo is None:
        return dist / v_ls, u, dist
    rr, ur = (pos * pos).sum(1), (u * pos).sum(1)
    out = np.sqrt(np.maximum(ur * ur - (rr - K.R_LS ** 2), 0)) - ur
    ls = np.where(rr >= K.R_LS ** 2, 0.0, np.clip(out, 0, dist))
    return ls / v_ls + (dist - ls) / v_bo, u, dist


def _flights(pos, p, v_ls, v_bo):
    """Times of flight and distances from every position to every point; see ``_flight``."""
    to = [p[:, k] - pos[:, k, None] for k in range(3)]
    dist = np.maximum(np.sqrt(to[0] * to[0] + to[1] * to[1] + to[2] * to[2]), 1e-6)
    if v_bo is None:
        return dist / v_ls, dist
    rr = (pos * pos).sum(1)[:, None]
    for k, d in enumerate(to):
        d /= dist
        d *= pos[:, k, None]
    ur = to[0] + to[1] + to[2]
    out = np.sqrt(np.maximum(ur * ur - (rr - K.R_LS ** 2), 0)) - ur
    ls = np.where(rr >= K.R_LS ** 2, 0.0, np.clip(out, 0, dist))
    return ls / v_ls + (dist - ls) / v_bo, dist


def _peaks(tau: np.ndarray, ev: np.ndarray, n: int, need: np.ndarray) -> np.ndarray:
    """Centre of the fullest 2 ns bin (three-bin sums) for the events in ``need``."""
    centre = np.full(n, np.nan)
    order = np.lexsort((tau, ev))
    bounds = np.searchsorted(ev[order], np.arange(n + 1))
    for i in np.flatnonzero(need):
        x = tau[order[bounds[i]:bounds[i + 1]]]
        if not len(x):
            continue
        lo, hi = np.quantile(x, (0.01, 0.99))
        nb = int(np.ceil((hi - lo + 10) / 2)) - 1
        k = np.floor((x - lo + 4) / 2).astype(int)
        c = np.bincount(k[(k >= 0) & (k < nb)], minlength=nb)
        three = c + np.append(c[1:], 0) + np.append(0, c[:-1])
        centre[i] = lo - 4 + 2 * three[:nb].argmax() + 1
    return centre


def _cap(r: np.ndarray, limit: float) -> np.ndarray:
    size = np.sqrt((r * r).sum(1))
    return r * np.where(size > limit, limit / np.maximum(size, 1e-12), 1.0)[:, None]


def locate_batch(pdf: pd.DataFrame, v_ls: float, v_bo: float | None, windows: list[float], max_iter: int = 40,
                 stage_iter: int = 12, tol: float = 0.5, max_step: float = 100.0) -> pd.DataFrame:
    """Positions of all events of a batch (rows hold hit arrays t, q, px, py, pz)."""
    n, count = len(pdf), pdf["t"].map(len).to_numpy()
    ev = np.repeat(np.arange(n), count)
    t, q, *xyz = (np.concatenate(pdf[c].to_list()).astype(float) for c in ("t", "q", "px", "py", "pz"))
    p = np.stack(xyz, axis=1)
    w0 = np.clip(q, 0, 20)
    tot = _sums(ev, w0, n)
    r = np.stack([_sums(ev, w0 * p[:, k], n) for k in range(3)], 1) / np.maximum(tot, 1e-300)[:, None] / 0.62
    r = _cap(np.where((tot > 0)[:, None], r, 0.0), R_MAX)
    enough = count >= 4
    iters, step, time = np.zeros(n, int), np.full(n, np.inf), np.full(n, np.nan)
    for w in windows:
        active, centre = enough & (iters < max_iter), np.full(n, np.nan)
        for _ in range(stage_iter):
            active &= iters < max_iter
            if not active.any():
                break
            iters[active] += 1
            m = active[ev]                                  # hits of unfinished events only
            e, pm = ev[m], p[m]
            flight, u, dist = _flight(r[e], pm, v_ls, v_bo)
            tau = t[m] - flight
            centre = np.where(np.isnan(centre) & active, _peaks(tau, e, n, active & np.isnan(centre)), centre)
            use = np.abs(tau - centre[e]) <= w
            few = active & (_sums(e, use.astype(float), n) < 4)
            if few.any():
                again = _peaks(tau, e, n, few)
                use = np.where(few[e], np.abs(tau - again[e]) <= 2 * w, use)
                few &= _sums(e, use.astype(float), n) < 4
                active &= ~few
                use &= active[e]
            e, tau = e[use], tau[use]
            j = u[use] * (flight[use] / dist[use])[:, None]
            k = np.maximum(_sums(e, np.ones(len(e)), n), 1)
            mt = _sums(e, tau, n) / k
            mj = np.stack([_sums(e, j[:, a], n) for a in range(3)], 1) / k[:, None]
            dj, dt = j - mj[e], tau - mt[e]                # the event time drops out when everything is centred
            a = np.empty((n, 3, 3))
            for x in range(3):
                for y in range(x, 3):
                    a[:, x, y] = a[:, y, x] = _sums(e, dj[:, x] * dj[:, y], n)
            b = np.stack([_sums(e, dj[:, x] * dt, n) for x in range(3)], 1)
            delta = -np.linalg.solve(a + 1e-9 * np.eye(3), b[:, :, None])[:, :, 0]
            moved = _cap(delta, max_step)
            time = np.where(active, mt + (mj * delta).sum(1), time)
            r = np.where(active[:, None], _cap(r + moved, R_MAX), r)
            step = np.where(active, np.sqrt((moved * moved).sum(1)), step)
            centre = np.where(active, time, centre)
            active &= step >= tol
    flight, _, _ = _flight(r[ev], p, v_ls, v_bo)
    res = t - flight - time[ev]
    use = np.abs(res) <= windows[-1]
    n_used = _sums(ev, use.astype(float), n).astype(int)
    sigma = np.sqrt(_sums(ev, np.where(use, res * res, 0.0), n) / np.maximum(n_used, 1))
    converged = step < max(tol, 2.0)
    fit = enough & ~np.isnan(time)
    out = pdf[EVENT].copy()
    for i, c in enumerate("xyz"):
        out[c] = np.where(enough, r[:, i], np.nan)
    out["t0"], out["n_hits"], out["n_used"] = np.where(fit, time, np.nan), count, np.where(fit, n_used, 0)
    out["sigma_t"] = np.where(fit & (n_used > 1), sigma, np.nan)
    out["iterations"], out["converged"] = iters, converged & enough
    out["ok"] = converged & fit & (n_used >= 4) & (np.sqrt((r * r).sum(1)) < R_MAX - 1e-3)
    return out


LOCATED = ("run long, event long, x double, y double, z double, t0 double, n_hits long, n_used long, sigma_t double, "
           "iterations long, converged boolean, ok boolean")


def window_schedule(start: float = 40.0, final: float = 12.0, shrink: float = 0.6) -> list[float]:
    w = [start]
    while w[-1] > final * 1.05:
        w.append(max(final, w[-1] * shrink))
    return w


def locate(hits: DataFrame, v_ls: float = 16.95, v_bo: float | None = None, min_q: float = 0.3, batch: int = 256) -> DataFrame:
    """Windowed Gauss-Newton position per event.

    ``hits`` carry sensor positions and have one row per (event, cable). One shuffle packs the hits of an event into
    arrays; each Arrow batch then iterates all its events together, so no iteration shuffles or writes anything.
    """
    windows = window_schedule()

    def fit(batches):
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                yield locate_batch(pdf.iloc[a:a + batch].reset_index(drop=True), v_ls, v_bo, windows)
    return nan_to_null(packed(fit_hits(hits, min_q)).mapInPandas(fit, LOCATED))


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.nanvl(f.name, F.lit(None).cast("double")).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
        for f in df.schema.fields])


def locate_with(hits: DataFrame, fit: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's own fitter per event (UD4): ``fit`` gets the hits of one event (at most one per cable)."""
    return hits.groupBy(*EVENT).applyInPandas(fit, schema)


def select_source_events(events: DataFrame, located: DataFrame, source: tuple, max_dist: float = 150.0,
                         window: DataFrame | None = None) -> DataFrame:
    """Source events (A44): multiplicity in the run's source window and located near the known position.

    Columns in_window, fitted, dist, keep; ``window`` (run, nhit_min, nhit_max) defaults to the source peak of each run.
    """
    w = window if window is not None else source_peak(events, ["run"], F.col("nhit")).drop("peak")
    sx, sy, sz = source
    d = F.sqrt((F.col("x") - sx) ** 2 + (F.col("y") - sy) ** 2 + (F.col("z") - sz) ** 2)
    e = events.join(w, "run", "left").join(located.where("ok").select(*EVENT, "x", "y", "z"), EVENT, "left")
    inside = F.coalesce(F.col("nhit").between(F.col("nhit_min"), F.col("nhit_max")), F.lit(False))
    e = e.withColumn("in_window", inside).withColumn("dist", F.when(inside, d)).withColumn("fitted", F.col("dist").isNotNull())
    return e.withColumn("keep", F.coalesce(F.col("in_window") & (F.col("dist") <= max_dist), F.lit(False))).drop("x", "y", "z", "nhit_min", "nhit_max")


def selection_counts(selected: DataFrame) -> DataFrame:
    return selected.groupBy("run").agg(F.count_if("in_window").alias("in_window"), F.count_if("fitted").alias("fitted"), F.count_if("keep").alias("kept"))


# ---- candidate scoring (J11, J12, A43) --------------------------------------------------------------------------------
def local_grid(spacing: float, half: int) -> Column:
    """Offsets of a cubic grid around a position as a literal array of structs; its size is fixed by ``half``."""
    k = range(-half, half + 1)
    return F.array(*[F.struct(F.lit(i).alias("cand"), F.lit(a * spacing).alias("ox"), F.lit(b * spacing).alias("oy"), F.lit(c * spacing).alias("oz"))
                     for i, (a, b, c) in enumerate((a, b, c) for a in k for b in k for c in k)])


def score_candidates(hits: DataFrame, candidates: Column, model: Callable[[Column], Column], name: str = "score",
                     events: DataFrame | None = None, event_model: Callable[[Column], Column] | None = None) -> DataFrame:
    """Additive score of every candidate of every event (J11, UD2).

    ``candidates`` is a fixed array; ``model`` maps a candidate struct (with the hit's columns in reach) to the
    hit's contribution. Each task adds up its hits per (event, candidate) before the shuffle. ``event_model`` maps a candidate, with the
    columns of ``events`` in reach, to what the event adds once; events without hits are scored by it alone.
    """
    h = hits.withColumn("_c", F.explode(candidates))
    scores = h.select(*EVENT, F.col("_c.cand").alias("cand"), model(F.col("_c")).alias("_v"))
    if event_model is not None:
        e = events.withColumn("_c", F.explode(candidates)).select(*EVENT, F.col("_c.cand").alias("cand"), event_model(F.col("_c")).alias("_v"))
        scores = scores.unionByName(e)
    return scores.groupBy(*EVENT, "cand").agg(F.sum("_v").alias(name))


def best_candidate(scores: DataFrame, name: str = "score") -> DataFrame:
    """Candidate with the largest score per event, the first one on ties."""
    return scores.groupBy(*EVENT).agg(F.max_by("cand", F.struct(name, -F.col("cand"))).alias("cand"), F.max(name).alias(name))


def sweep(df: DataFrame, grid: list, metric: Callable[[Column], Column], keys: list[str]) -> DataFrame:
    """Parameter value with the smallest mean metric per group (J12); the grid is a fixed literal array."""
    p = df.withColumn("_p", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    m = p.groupBy(*keys, "_p").agg(F.avg(metric(F.col("_p"))).alias("value"))
    out = m.groupBy(*keys) if keys else m.groupBy()
    return out.agg(F.min_by(F.col("_p"), F.struct("value", "_p")).alias("best"), F.min("value").alias("value"))


def tune_speed(hits: DataFrame, sources: DataFrame, speeds: list[float], max_z: float = 550.0) -> DataFrame:
    """Light speed with the smallest rms bias of the located z over the scan (J12): one localisation per speed, all in
    one job; per run the median bias, then the rms over runs."""
    from .quantile import grouped_median

    rows = None
    for v in speeds:
        r = locate(hits, v).select("run", "event", "z").withColumn("v", F.lit(float(v)))
        rows = r if rows is None else rows.unionByName(r)
    b = rows.join(sources.where(F.abs("sz") <= max_z), "run").withColumn("bias", F.col("z") - F.col("sz"))
    # written, since a median takes up its values several times, each with all localisations
    med = grouped_median(stage(b.select("v", "run", "bias"), "bias"), ["v", "run"], F.col("bias"), "bias")
    rms = med.groupBy("v").agg(F.sqrt(F.avg(F.col("bias") ** 2)).alias("rms"))
    return rms.agg(F.min_by("v", F.struct("rms", "v")).alias("v_best"), F.min("rms").alias("rms"))


def _cube_array(cube: DataFrame) -> np.ndarray:
    """The density cube as an array of fixed size 2 x 4 x 4 x bins (bounded by its definition)."""
    pdf = cube.select("type", "qbin", "dbin", "tbin", "logp").toPandas()
    a = np.zeros((2, 4, 4, int(pdf["tbin"].max()) + 1))
    a[pdf["type"], pdf["qbin"], pdf["dbin"], pdf["tbin"]] = pdf["logp"]
    return a


def grid_likelihood(hits: DataFrame, start: DataFrame, cube: DataFrame, v_ls: float, v_bo: float, lo: float, dt: float,
                    spacing: float = 20.0, half: int = 2, t_steps: int = 2, t_spacing: float = 1.0,
                    tubes: DataFrame | None = None, energy: DataFrame | None = None) -> DataFrame:
    """Most likely position and time on a grid around a first estimate.

    Sums the interpolated log density of every hit; with ``tubes`` and ``energy`` (run, event, e) the hit / no-hit
    term of every live tube is added. The cube and the tube table have a fixed size and go to every task; events are
    packed to one row and each row is scored with array arithmetic.
    """
    table = _cube_array(cube)
    nb = table.shape[-1]
    k = np.arange(-half, half + 1)
    offs = np.stack(np.meshgrid(k, k, k, indexing="ij"), -1).reshape(-1, 3) * spacing
    times = np.arange(-t_steps, t_steps + 1) * t_spacing
    tube = None
    if tubes is not None:
        tp = tubes.where(F.col("cable") < K.N_ID).select("cable", "px", "py", "pz", "eta", "dark").orderBy("cable").toPandas()   # <= 1879 rows
        tube = (tp["cable"].to_numpy(), tp[["px", "py", "pz"]].to_numpy(), tp["eta"].to_numpy(), tp["dark"].to_numpy())
        area = np.where(tube[0] < K.N_ID17, K.AREA_17, K.AREA_20)

    flat = table.ravel()
    if tube is not None:
        pp = (tube[1] ** 2).sum(1)
        near_centre = area * np.exp(-np.sqrt(pp) / K.ATTENUATION_CM) / pp         # seen from the centre, along the axis

    rise = np.append(np.diff(flat), 0.0)

    def no_light(mu, seen):
        """Log likelihood of hit and unhit tubes from every position, with ``mu`` the light that is expected."""
        return np.log(np.maximum(-np.expm1(-mu[:, seen]), 1e-300)).sum(1) - mu[:, ~seen].sum(1)

    def tubes_at(pos, e, seen):
        """Log likelihood of all tubes; distances and angles come from one matrix product."""
        p, inner, out = tube[1], pos @ tube[1].T, []
        rp, weight, rows = np.sqrt(pp), e * tube[2], max(1, CACHED // len(p))
        for i in range(0, len(pos), rows):
            here = inner[i:i + rows]
            square = np.maximum((pos[i:i + rows] ** 2).sum(1)[:, None] + pp - 2 * here, 1e-9)
            dist = np.sqrt(square)
            cos = np.subtract(pp, here, out=here)
            cos /= dist * rp
            np.clip(cos, 0, 1, out=cos)
            cos *= 0.9
            cos += 0.1
            cos *= area
            dist /= -K.ATTENUATION_CM
            cos *= np.exp(dist, out=dist)
            cos /= square
            cos *= weight
            cos /= near_centre
            cos += tube[3]
            out.append(no_light(np.maximum(cos, 1e-9, out=cos), seen))
        return np.concatenate(out)

    def hits_at(pos, p, q, t, ti):
        """Log likelihood of the hits of an event from some positions at all times."""
        flight, dist = _flights(pos, p, v_ls, v_bo)
        di = np.clip(np.searchsorted(K.D_EDGES, dist, side="right") - 1, 0, 3)
        cell = ((ti * 4 + np.clip(np.searchsorted(K.Q_EDGES, q, side="right") - 1, 0, 3)) * 4 + di) * nb
        tau = np.subtract(t, flight, out=flight)
        x, i, low, best = np.empty_like(tau), np.empty(tau.shape, dtype=np.int64), np.empty_like(tau), np.empty((len(pos), len(times)))
        for k, s in enumerate(times):
            np.subtract(tau, s, out=x)
            x -= lo
            x /= dt
            x -= 0.5
            np.clip(x, 0, nb - 1.000001, out=x)
            np.copyto(i, x, casting="unsafe")               # x is not negative
            x -= i
            i += cell
            x *= np.take(rise, i, out=low, mode="clip")
            x += np.take(flat, i, out=low, mode="clip")
            x.sum(1, out=best[:, k])
        return best

    def score(row):
        p = np.stack([row["px"], row["py"], row["pz"]], 1).astype(float)
        cable, q, t = np.asarray(row["cable"]), np.asarray(row["q"], float), np.asarray(row["t"], float)
        pos = np.array([row["x"], row["y"], row["z"]]) + offs
        rows, ti = max(1, CACHED // len(p)), (cable >= K.N_ID17).astype(int)
        ll = np.concatenate([hits_at(pos[i:i + rows], p, q, t - row["t0"], ti) for i in range(0, len(pos), rows)])
        if tube is not None and row["e"] == row["e"]:
            # a tube is hit or not at all positions alike
            ll += tubes_at(pos, row["e"], np.isin(tube[0], cable))[:, None]
        j = int(ll.argmax())
        a, b = divmod(j, len(times))
        return (*pos[a], row["t0"] + times[b], ll[a, b])

    def run(batches):
        for pdf in batches:
            if len(pdf):
                r = np.array([score(x) for x in pdf.to_dict("records")])
                yield pd.DataFrame({"run": pdf["run"], "event": pdf["event"], "x": r[:, 0], "y": r[:, 1], "z": r[:, 2], "t0": r[:, 3],
                                    "loglik": r[:, 4]})
    s = start.where("ok").select(*EVENT, "x", "y", "z", "t0")
    s = s.join(energy.select(*EVENT, "e"), EVENT, "left") if energy is not None else s.withColumn("e", F.lit(None).cast("double"))
    return packed(fit_hits(hits)).join(s, EVENT).mapInPandas(run, "run long, event long, x double, y double, z double, t0 double, loglik double")
