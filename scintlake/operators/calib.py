"""Calibration joins and per-channel constants."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.geometry import path_lengths
from ..session import stage
from .hist import grouped_mode
from .quantile import grouped_median
from .segments import numbers, whole_groups

EVENT = ["run", "event"]
CHANNEL = ["cable", "atwd"]


# ---- expressions (P10) ------------------------------------------------------------------------------------------
def time_ns(sample: Column, launch: Column, bin_ns: Column, t0: Column) -> Column:
    return sample * bin_ns - launch * K.LAUNCH_NS - t0


def charge_pe(adc: Column, q1pe: Column, factor: Column) -> Column:
    return F.try_divide(adc, q1pe) * factor


def charge_adc(q: Column, q1pe: Column, factor: Column) -> Column:
    """Back from photo-electrons to ADC counts."""
    return q * q1pe / factor


# ---- joins --------------------------------------------------------------------------------------------------------
def gain_factors(factors: list[float] | None = None) -> Column:
    return F.array(*[F.lit(float(v)) for v in factors or K.GAIN_FACTOR])


def with_calib(hits: DataFrame, channel_calib: DataFrame, factors: list[float] | None = None,
               run_bins: DataFrame | None = None, sample: str = "t", launch: Column | None = None) -> DataFrame:
    """Calibrated time ``t_ns`` and charge ``q_pe`` per hit.

    The channel table has at most two rows per cable. ``run_bins`` (run, cable, atwd, run_bin_ns) overrides the
    global sampling period. Channels without calibration keep the defaults.
    """
    h = hits.join(channel_calib, CHANNEL, "left")
    bin_ns = F.coalesce("bin_ns", F.lit(K.DEFAULT_BIN_NS))
    if run_bins is not None:
        h = h.join(run_bins, ["run", *CHANNEL], "left")
        bin_ns = F.coalesce("run_bin_ns", "bin_ns", F.lit(K.DEFAULT_BIN_NS))
    factor = gain_factors(factors)[F.col("gain").cast("int")]
    out = h.withColumn("t_ns", time_ns(F.col(sample), launch if launch is not None else F.lit(0), bin_ns, F.coalesce("t0", F.lit(0.0))))
    out = out.withColumn("q_pe", charge_pe(F.col("adc"), F.coalesce("q1pe", F.lit(K.DEFAULT_Q1PE)), factor))
    return out.drop("bin_ns", "q1pe", "t0", "run_bin_ns")


def with_geometry(hits: DataFrame, sensors: DataFrame) -> DataFrame:
    """Sensor position per hit (J2); the geometry has one row per cable."""
    return hits.join(sensors, "cable")


def with_pedestal(waves: DataFrame, measured: DataFrame, fallback: DataFrame, cable_map: DataFrame) -> DataFrame:
    """Pedestal per waveform (J3): measured mean, else the table row of its electronics slot, else null (zeros).

    ``measured`` (cable, atwd, gain, pedestal), ``cable_map`` (cable, crate, slot, channel), ``fallback`` (row, fallback).
    """
    m = measured.select(*CHANNEL, "gain", "pedestal")
    w = waves.join(m, [*CHANNEL, "gain"], "left").join(cable_map, "cable", "left")
    row = table_row(F.col("crate"), F.col("slot"), F.col("channel"), F.col("atwd"), F.col("gain"))
    w = w.withColumn("row", row).join(fallback, "row", "left")
    source = F.when(F.col("pedestal").isNotNull(), "measured").when(F.col("fallback").isNotNull(), "table").otherwise("zero")
    return w.withColumn("pedestal_source", source).withColumn("pedestal", F.coalesce("pedestal", "fallback")) \
        .drop("crate", "slot", "channel", "row", "fallback")


def table_row(crate: Column, slot: Column, channel: Column, atwd: Column, gain: Column) -> Column:
    """Row number in the per-channel compression table: crate, slot, channel, sampler, gain in this order of weight."""
    # fixed values: crates 1-10, slots 2-21, 12 channels, 2 samplers, 4 gains
    row = ((((crate - 1) * 20 + (slot - 2)) * 12 + channel) * 2 + atwd) * 4 + gain
    return F.when(crate.between(1, 10) & slot.between(2, 21), row)


def with_runinfo(df: DataFrame, runs: DataFrame) -> DataFrame:
    """Run metadata, null when the run is not listed."""
    return df.join(runs, "run", "left")


def good_runs(runs: DataFrame, max_grade: int = 0) -> DataFrame:
    return runs.where(F.col("grade") <= max_grade).select("run")


def in_good_runs(df: DataFrame, runs: DataFrame, max_grade: int = 0) -> DataFrame:
    """Rows of the runs up to ``max_grade``."""
    return df.join(good_runs(runs, max_grade), "run", "left_semi")


def attach_event_time(hits: DataFrame, times: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Event time per hit; hits of events without one drop out."""
    return hits.join(times, keys or EVENT)


# ---- event time (A12, C11) ------------------------------------------------------------------------------------------
def _times(x: np.ndarray, first: np.ndarray, window: float, tails: tuple[float, float], passes: int) -> np.ndarray:
    """Event time per event of whole events one after another, each sorted by ``x``; NaN where it has too few hits.

    The occupied bins of an event are runs of its sorted bin numbers, so neither the width of its range nor the number
    of empty bins costs anything.
    """
    start = np.flatnonzero(first)
    ev = np.cumsum(first) - 1
    n = np.diff(np.append(start, len(x)))

    def at(p: float) -> np.ndarray:
        r = p * (n - 1)
        k = np.floor(r).astype(np.int64)
        lo, up = x[start + k], x[start + np.minimum(k + 1, n - 1)]
        return lo + (up - lo) * (r - np.floor(r))

    a = at(tails[0]) - 4
    nb = np.ceil((at(tails[1]) + 6 - a) / 2) - 1
    k, last = np.floor((x - a[ev]) / 2), nb[ev]
    k = np.where((k == last) & (x == a[ev] + last * 2), last - 1, k)
    k = np.where((k >= 0) & (k < last), k, np.where(x < a[ev], -9, last + 9)).astype(np.int64)
    # occupied bins; the three-bin sum of an empty bin is wanted only left of an occupied one, as the lowest bin is first
    run = np.flatnonzero(first | (np.diff(k, prepend=k[0]) != 0))
    bins, e, c = k[run], ev[run], np.diff(np.append(run, len(k)))
    gap = np.where(np.diff(e, prepend=-1) == 0, np.diff(bins, prepend=0), 9)
    before = np.append(0, c[:-1])
    own = c + np.where(gap == 1, before, 0) + np.append(np.where(gap[1:] == 1, c[1:], 0), 0)
    left = c + np.where(gap == 2, before, 0)
    rank = lambda s, b: np.where((b >= 0) & (b < nb[e]), s * 2 ** 32 + (2 ** 31 - b), 0)
    best = np.maximum.reduceat(np.maximum(rank(own, bins), np.where(gap > 1, rank(left, bins - 1), 0)), np.flatnonzero(first[run]))
    centre = a + 2.0 * (2 ** 31 - best % 2 ** 32) + 1.0
    for i in range(passes):
        near = np.abs(x - centre[ev]) <= window
        count = np.bincount(ev[near], minlength=len(n))
        total = np.bincount(ev[near], weights=x[near], minlength=len(n))     # added in the order of x
        ok = (n >= 4) & (count >= (4 if i == 0 and passes > 1 else 1))
        centre = np.where(ok, total / np.maximum(count, 1), np.nan)
    return centre


def _event_timer(keys: list[str], x: str, window: float, tails: tuple[float, float], passes: int):
    def run(batches):
        for t, first in whole_groups(batches, keys, known=x):
            time = _times(numbers(t, x).astype(float), first, window, tails, passes)[np.cumsum(first) - 1]
            t = t.append_column("_time", pa.array(time, mask=np.isnan(time))).append_column("_head", pa.array(first))
            yield from t.combine_chunks().to_batches()
    return run


def with_event_time(hits: DataFrame, keys: list[str] | None = None, window: float = 10.0, x: str = "tau", name: str = "t_event",
                    tails: tuple[float, float] = (0.02, 0.98), passes: int = 2) -> DataFrame:
    """Event time per hit: mean of ``x`` around its 2 ns mode, about the mode and then (``passes=2``) about that mean.

    Null where the event has too few hits; ``head`` is true on one hit of each event. The input has one row per (event, cable), so an event is bounded by the
    number of sensors. Spark deals the hits by event and sorts them by ``x``; the Arrow batches of a task are worked through
    by whole events, all events of a batch at once, so the cost is linear in the hits and no event is joined to itself. Hits without ``x`` are left
    out there: as a filter here, the whole expression of ``x`` would be repeated in the condition of the join with the sensors.
    """
    keys = keys or EVENT
    v = hits.repartition(*keys).sortWithinPartitions(*keys, x)
    timed = T.StructType([*v.schema.fields, T.StructField("_time", T.DoubleType()), T.StructField("_head", T.BooleanType())])
    v = v.mapInArrow(_event_timer(keys, x, window, tails, passes), timed)
    return v.select(*hits.columns, F.col("_time").alias(name), F.col("_head").alias("head"))


def event_time(tau: DataFrame, keys: list[str] | None = None, name: str = "t_event", **kw) -> DataFrame:
    """One row per event that has a time: that of its first hit, so this adds no shuffle."""
    keys = keys or EVENT
    t = with_event_time(tau, keys, name=name, **kw)
    return t.where(F.col("head") & F.col(name).isNotNull()).select(*keys, name)


# ---- residuals (A16) ------------------------------------------------------------------------------------------------
def time_of_flight_corrected(hits: DataFrame, sensors: DataFrame, vertex: tuple, v_ls: float, v_bo: float | None = None,
                             min_q: float = 0.3) -> DataFrame:
    """``tau`` and path lengths for inner primary hits with a time and enough charge; vertex fixed.

    ``vertex`` holds numbers or columns of the hit table (for a source position per run).
    """
    h = hits.where((F.col("cable") < K.N_ID) & F.col("t").isNotNull() & (F.col("q") >= min_q))
    h = with_geometry(h, sensors)
    d_ls, d_bo, d = path_lengths(vertex, (F.col("px"), F.col("py"), F.col("pz")))
    h = h.withColumn("d_ls", d_ls).withColumn("d_bo", d_bo).withColumn("d", d)
    return h.withColumn("tau", F.col("t") - F.col("d_ls") / v_ls - F.col("d_bo") / (v_bo or v_ls))


def residuals_fixed_vertex(hits: DataFrame, sensors: DataFrame, vertex: tuple, v_ls: float, v_bo: float | None = None,
                           min_q: float = 0.3) -> DataFrame:
    """Hit-time residuals ``res`` about the event time with the vertex at a known source position."""
    tau = with_event_time(time_of_flight_corrected(hits, sensors, vertex, v_ls, v_bo, min_q))
    return tau.where(F.col("t_event").isNotNull()).withColumn("res", F.col("tau") - F.col("t_event"))


# ---- channel constants --------------------------------------------------------------------------------------------
def q0_per_channel(hits: DataFrame, min_hits: int = 100, lo: float = 30, hi: float = 800, accept: tuple = (80, 500),
                   old: DataFrame | None = None) -> DataFrame:
    """Mode of the single-channel ADC spectrum (A18); values outside ``accept`` keep the old constant."""
    h = hits.where((F.col("cable") < K.N_ID) & (F.col("adc") > lo) & (F.col("adc") < hi))
    m = grouped_mode(h, CHANNEL, F.col("adc"), 10.0, 5, min_hits, "q0")
    ok = F.when((F.col("q0") > accept[0]) & (F.col("q0") < accept[1]), F.col("q0"))
    if old is None:
        return m.select(*CHANNEL, "n", "q0", ok.alias("q1pe"))
    return old.select(*CHANNEL, F.col("q1pe").alias("_old")).join(m, CHANNEL, "full").select(
        *CHANNEL, "n", "q0", F.coalesce(ok, "_old").alias("q1pe"))


def q1pe_per_channel(hits: DataFrame, min_hits: int = 100, edges: tuple = (30.0, 800.0)) -> DataFrame:
    """Single-photon charge from fixed 10-wide bins."""
    h = hits.where((F.col("cable") < K.N_ID) & (F.col("gain") == 0) & (F.col("adc") > edges[0]) & (F.col("adc") < edges[1]))
    return grouped_mode(h, CHANNEL, F.col("adc"), 10.0, 5, min_hits, "q1pe", edges)


def centred(values: DataFrame, value: str) -> DataFrame:
    """Values minus the mean of the measured (non-zero) ones; the table has one row per channel of the detector."""
    mean = F.avg(F.when(F.col(value) != 0, F.col(value))).over(Window.partitionBy(F.lit(0)))
    return values.withColumn(value, F.when(F.col(value) != 0, F.col(value) - mean).otherwise(F.col(value)))


def channel_statistic(res: DataFrame, statistic: str, min_hits: int, name: str) -> DataFrame:
    """Mode or median of the residual per channel (UD1)."""
    if statistic == "mode":
        return grouped_mode(res, CHANNEL, F.col("res"), min_count=min_hits, name=name)
    # written, since a median takes up its values several times
    return grouped_median(stage(res.select(*CHANNEL, "res"), "values"), CHANNEL, F.col("res"), name, min_hits)


def t0_fixed_vertex(hits: DataFrame, sensors: DataFrame, v_ls: float = 17.6, vertex: tuple = (0.0, 0.0, 0.0),
                    min_hits: int = 30, statistic: str = "mode", n_iter: int = 2) -> DataFrame:
    """Time offset per channel from runs with the source at ``vertex`` (A17): per pass the residual statistic of each
    channel minus the mean over the measured ones; passes add up. A pass writes its small channel table, so the
    plan does not grow and the next pass joins a table of known size."""
    total, hits = None, stage(hits.where(F.col("cable") < K.N_ID), "hits")
    for i in range(n_iter):
        h = hits
        if total is not None:
            h = h.join(total.select(*CHANNEL, "t0"), CHANNEL, "left").withColumn(
                "t", F.col("t") - F.coalesce("t0", F.lit(0.0))).drop("t0")
        step = channel_statistic(residuals_fixed_vertex(h, sensors, vertex, v_ls), statistic, min_hits, "_dt0")
        step = centred(step, "_dt0").select(*CHANNEL, "n", F.col("_dt0"))
        if total is not None:
            old = total.select(*CHANNEL, F.col("t0").alias("_old"), F.col("n").alias("_n"))
            step = old.join(step, CHANNEL, "full").select(
                *CHANNEL, F.coalesce("n", "_n").alias("n"), (F.coalesce("_old", F.lit(0.0)) + F.coalesce("_dt0", F.lit(0.0))).alias("t0"))
        else:
            step = step.withColumnRenamed("_dt0", "t0")
        total = stage(step, "t0") if i + 1 < n_iter else step
    return total


def t0_from_used(hits: DataFrame, min_hits: int = 20) -> DataFrame:
    """Time offset per channel from the run itself (A19, fitted vertex): median ``tau`` of the hits the fit used."""
    h = hits.where((F.col("cable") < K.N_ID) & F.col("used"))
    return centred(grouped_median(h, CHANNEL, F.col("tau"), "t0", min_hits), "t0")


def t0_from_run(hits: DataFrame, sensors: DataFrame, vertex: tuple, v_ls: float = 16.95, min_hits: int = 20,
                window: float = 15.0) -> DataFrame:
    """Same with a known vertex (A19): residuals within ``window`` of the refined event peak."""
    tau = time_of_flight_corrected(hits, sensors, vertex, v_ls, min_q=0.0)
    tau = with_event_time(tau, window=window, tails=(0.01, 0.99), passes=1)
    r = tau.withColumn("res", F.col("tau") - F.col("t_event")).where(F.abs("res") <= window)
    return centred(grouped_median(r, CHANNEL, F.col("res"), "t0", min_hits), "t0")


def light_yield(res: DataFrame, sensors: DataFrame, energy: float = 2.506, window: tuple = (-15.0, 85.0),
                dark_window: tuple = (-200.0, -40.0), n_selected: Column | None = None, min_events: int = 200) -> DataFrame:
    """Light yield and dark hits of every inner sensor from hit probabilities.

    ``res`` are the residuals with the source at the centre and no charge cut; the number of events is counted over
    those with an event time (``n_selected`` can lower it). Sensors without any residual are ``bad`` with yield 0. Below
    ``min_events`` events there is no result.
    """
    inside, dark = F.col("res").between(*window), F.col("res").between(*dark_window)
    per = res.groupBy("cable").agg(F.count_if(inside).alias("n_hit"), F.count_if(dark).alias("n_dark"),
                                   F.coalesce(F.sum(F.when(inside, F.col("q"))), F.lit(0.0)).alias("q_sum"),
                                   F.count_if("head").alias("heads"))
    n_ev = F.sum("heads").over(Window.partitionBy(F.lit(0)))          # over one row per cable
    if n_selected is not None:
        n_ev = F.least(n_ev, n_selected)
    scale = (window[1] - window[0]) / (dark_window[1] - dark_window[0])
    # the events are counted over one row per cable with residuals, then every inner sensor gets a row
    total = per.select(n_ev.alias("n_events")).agg(F.max("n_events").alias("n_events")).where(F.col("n_events") >= min_events)
    p = (sensors.where(F.col("cable") < K.N_ID).select(F.col("cable").cast("long").alias("cable"))
         .join(per.withColumn("cable", F.col("cable").cast("long")), "cable", "left")
         .na.fill(0, ["n_hit", "n_dark"]).na.fill(0.0, ["q_sum"]).crossJoin(F.broadcast(total)))      # one row
    prob = F.least(F.col("n_hit") / F.col("n_events"), F.lit(0.999))
    p = p.withColumn("dark", F.col("n_dark") / F.col("n_events") * scale).withColumn("mu", -F.log(1 - prob))
    hit = F.col("n_hit") > 0
    eta_q = (F.col("q_sum") / F.col("n_events") - F.col("dark") * F.col("q_sum") / F.greatest("n_hit", F.lit(1))) / energy
    return p.select(
        "cable", "n_events", "n_hit", "n_dark", "dark", "mu",
        F.when(hit, F.greatest(F.col("mu") - F.col("dark"), F.lit(0.0)) / energy).otherwise(0.0).alias("eta"),
        F.when(hit, F.greatest(eta_q, F.lit(0.0))).otherwise(0.0).alias("eta_q"), (~hit).alias("bad"))
