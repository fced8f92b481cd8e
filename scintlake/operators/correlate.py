"""Muon tagging with dead time, previous-muon as-of join and follow-up windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tracks as T
from ..session import stage
from .hist import edge_bin, uniform_bin
from .quantile import exact_quantiles
from .scan import lag_value, last_marker, time_blocks, with_block

# ---- dead time ---------------------------------------------------------------------------------------------------
# A tag counts when it is hard or when the last counted tag is at least ``dead`` ticks old. Who counts depends on who
# counted before, so the rule is a recursion over the whole run. It is solved in two levels: every time block is
# summarised as a step function "dead until U on entry -> dead until V on exit" (chains that start at different tags
# of a block soon run into the same tag, so the function has few steps); the few steps of a run are composed in
# order; and each block then marks its own tags from its entry value.


def _successor(ts: np.ndarray, hard: np.ndarray, dead: int) -> np.ndarray:
    """Position of the next counting tag after each counting tag of one ordered block (n = none)."""
    n = len(ts)
    free = np.maximum(np.searchsorted(ts, ts + dead, side="left"), np.arange(1, n + 1))
    pos = np.append(np.flatnonzero(hard), n)
    return np.minimum(free, pos[np.searchsorted(pos, np.arange(n), side="right").clip(max=len(pos) - 1)])


def _entry_tag(ts: np.ndarray, hard: np.ndarray, until: float) -> int:
    first = int(np.searchsorted(ts, until, side="left"))
    h = np.flatnonzero(hard[:first])
    return int(h[0]) if len(h) else first


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["ts", "event"], kind="stable")


def _block_steps(dead: int):
    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf)
        ts, hard = pdf["ts"].to_numpy(), pdf["hard"].to_numpy()
        n = len(ts)
        nxt = _successor(ts, hard, dead)
        end = np.where(nxt < n, nxt, np.arange(n))
        while True:                                    # jump twice as far each time
            far = end[end]
            if np.array_equal(far, end):
                break
            end = far
        h = np.flatnonzero(hard)
        m = int(h[0]) + 1 if len(h) else n             # no entry beyond the first hard tag
        out = ts[end[:m]] + dead
        up_to = ts[:m].copy()
        if len(h):
            up_to[-1] = np.iinfo(np.int64).max         # a hard tag counts whatever the entry
        once = np.append(True, up_to[1:] != up_to[:-1])    # a later tag at the same tick is never the entry
        up_to, out = up_to[once], out[once]
        last = np.append(out[1:] != out[:-1], True)    # keep one step per distinct exit
        return pd.DataFrame({"run": pdf["run"].iloc[0], "block": pdf["block"].iloc[0],
                             "up_to": up_to[last], "exit": out[last]})
    return steps


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    until = np.iinfo(np.int64).min
    rows = []
    for block, g in pdf.sort_values(["block", "up_to"]).groupby("block", sort=True):
        rows.append((block, until))
        k = int(np.searchsorted(g["up_to"].to_numpy(), until, side="left"))
        if k < len(g):
            until = int(g["exit"].iloc[k])
    out = pd.DataFrame(rows, columns=["block", "until"])
    out.insert(0, "run", pdf["run"].iloc[0])
    return out


def _block_marks(dead: int):
    def marks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf)
        ts, hard = pdf["ts"].to_numpy(), pdf["hard"].to_numpy()
        nxt = _successor(ts, hard, dead)
        real = np.zeros(len(ts), dtype=bool)
        i = _entry_tag(ts, hard, pdf["until"].iloc[0])
        while i < len(ts):
            real[i] = True
            i = nxt[i]
        return pdf.assign(real=real)[["run", "event", "ts", "real"]]
    return marks


def real_tags(tags: DataFrame, dead: int, hard: Column, width: DataFrame | int | None = None) -> DataFrame:
    """The counting tags among ``tags`` (run, event, ts, ...): those not inside another tag's dead time."""
    t = tags.select("run", "event", "ts", hard.alias("hard"))
    if width is None:
        width = time_blocks(t, ["run"], "ts", at_least=8 * dead)
    t = with_block(t, ["run"], "ts", width).withColumnRenamed("_block", "block")
    steps = t.groupBy("run", "block").applyInPandas(_block_steps(dead), "run long, block long, up_to long, exit long")
    entry = steps.groupBy("run").applyInPandas(_compose, "run long, block long, until long")
    marked = t.join(entry, ["run", "block"]).groupBy("run", "block").applyInPandas(
        _block_marks(dead), "run long, event long, ts long, real boolean")
    return marked.where("real").drop("real")


# ---- as-of -------------------------------------------------------------------------------------------------------
def od_only(is_tag: Column, hard: Column, nhit: Column, id_hits: int = 500) -> Column:
    """Tags of the outer detector alone: not hard, and too few inner hits for a track through the inner detector."""
    return is_tag & ~hard & (nhit < id_hits)


def track_payload(entrance: tuple, exit_point: tuple, valid: Column) -> Column:
    """What a tag hands on of its track: entrance and unit direction, null unless the track is valid."""
    u, length = T.direction(entrance, exit_point)
    fields = [c.cast("double").alias(n) for c, n in zip((*entrance, *u), ("ex", "ey", "ez", "ux", "uy", "uz"), strict=True)]
    return F.when(F.coalesce(valid, F.lit(False)) & (length > 0), F.struct(*fields))


def tag_previous(events: DataFrame, is_tag: Column, hard: Column, dead: int, width: DataFrame | int | None = None,
                 track: Column | None = None) -> DataFrame:
    """Every event with the last real tag strictly before it.

    Adds is_tag, retrigger, prev_event (-1 when there is none), prev_ts and dt (ticks, null when there is none). With ``track`` (see
    ``track_payload``) also prev_track, the track of that tag: null when that tag has none, even if an earlier one has.
    """
    e = events.withColumn("is_tag", F.coalesce(is_tag, F.lit(False))).withColumn("_hard", F.coalesce(hard, F.lit(False)))
    real = real_tags(e.where("is_tag"), dead, F.col("_hard"), width)
    width = time_blocks(events, ["run"], "ts") if width is None else width
    fields = ["prev_event", "prev_ts"]
    real = real.select("run", "ts", "event", F.col("event").alias("prev_event"), F.col("ts").alias("prev_ts"))
    if track is not None:
        real = real.join(e.where("is_tag").select("run", "event", track.alias("track")), ["run", "event"])
        fields.append("track")
    # few rows that the as-of join reads twice
    mark = stage(real, "real-tags")
    out = last_marker(e, mark, ["run"], ["ts", "event"], fields, width)
    dt = F.col("ts") - F.col("prev.prev_ts")
    out = (
        out.withColumn("retrigger", F.coalesce(F.col("is_tag") & ~F.col("_hard") & (dt < dead), F.lit(False)))
        .withColumn("prev_event", F.coalesce("prev.prev_event", F.lit(-1)))
        .withColumn("prev_ts", F.col("prev.prev_ts")).withColumn("dt", dt)
    )
    if track is not None:
        out = out.withColumn("prev_track", F.col("prev.track"))
    return out.drop("_hard", "prev")


def track_distance(vertex: tuple, vertex_ok: Column, track: Column) -> Column:
    """Distance of a located event from a track of ``track_payload``; null without a vertex or a track."""
    e, u = (tuple(track[f"{k}{c}"] for c in "xyz") for k in "eu")
    return F.when(vertex_ok & track.isNotNull(), T.point_distance(vertex, e, u))


def dt_prev(events: DataFrame, width: DataFrame | int | None = None) -> DataFrame:
    """Ticks since the event before in the same run."""
    width = time_blocks(events, ["run"], "ts") if width is None else width
    return lag_value(events, ["run"], ["ts", "event"], "ts", width, "_prev").withColumn(
        "dt_prev", F.col("ts") - F.col("_prev")).drop("_prev")


# ---- follow-ups ----------------------------------------------------------------------------------------------------
def in_window(tagged: DataFrame, window: int) -> DataFrame:
    """Events that are no tags and lie within ``window`` ticks (inclusive) after a real tag."""
    return tagged.where(~F.col("is_tag") & (F.col("dt") <= window))


def followups(tagged: DataFrame, window: int, min_mult: int) -> DataFrame:
    """Follow-up candidates (J7): in the window and with at least ``min_mult`` hits."""
    return in_window(tagged, window).where(F.col("nhit") >= min_mult)


def n_after(tagged: DataFrame, window: int) -> DataFrame:
    """Per real tag the number of events in its window, zeros included (A39); low-multiplicity ones count too."""
    n = in_window(tagged, window).groupBy("run", F.col("prev_event").alias("event")).agg(F.count(F.lit(1)).alias("n_after"))
    real = tagged.where("is_tag and not retrigger").select("run", "event")
    return real.join(n, ["run", "event"], "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)))


def with_parent(cands: DataFrame, tags: DataFrame, columns: list[str]) -> DataFrame:
    """Attach attributes of the parent tag (J8); the parent has the prefix ``mu_``."""
    p = tags.select("run", F.col("event").alias("prev_event"), *[F.col(c).alias(f"mu_{c}") for c in columns])
    return cands.join(p, ["run", "prev_event"])


def parent_class(q17: Column, converged: Column, l_ls: Column, kind: str, bright: float = 10000.0) -> Column:
    """Parent selection: ``all``, ``ls`` (track through the scintillator) or ``id`` (bright or reconstructed)."""
    if kind == "ls":
        return converged & (l_ls > 0)
    if kind == "id":
        return (q17 >= bright) | converged
    return F.lit(True)


def captures(vertex_ok: Column, r: Column, energy: Column, dt: Column, r_max: float, energies: tuple, times: tuple) -> Column:
    """Capture candidates: located inside the fiducial radius, with energy and time since the tag in inclusive windows."""
    return F.coalesce(vertex_ok & (r < r_max) & energy.between(*energies) & dt.between(*times), F.lit(False))


def parent_yields(cands: DataFrame, parents: DataFrame, selected: Column, kinds: tuple = ("all", "ls", "id"), bright: float = 10000.0) -> DataFrame:
    """Per run and parent class: parents, candidates of such parents that pass ``selected``, candidates per parent.

    ``parents`` are the real tags with q17, converged and l_ls; ``cands`` carry the same columns of their parent as mu_q17, mu_converged
    and mu_l_ls (see ``with_parent``).
    """
    def of(df: DataFrame, prefix: str) -> DataFrame:
        q17, converged, l_ls = (F.col(prefix + c) for c in ("q17", "converged", "l_ls"))
        held = F.array(*[F.when(F.coalesce(parent_class(q17, converged, l_ls, k, bright), F.lit(False)), F.lit(k)) for k in kinds])
        return df.select("run", F.explode(F.array_compact(held)).alias("parent"))

    n = of(parents, "").groupBy("run", "parent").agg(F.count(F.lit(1)).alias("n_parent"))
    c = of(cands.where(selected), "mu_").groupBy("run", "parent").agg(F.count(F.lit(1)).alias("n_selected"))
    return n.join(c, ["run", "parent"], "left").na.fill(0, ["n_selected"]).withColumn("per_parent", F.col("n_selected") / F.col("n_parent"))


# ---- tables ----------------------------------------------------------------------------------------------------------
def recovery_table(cands: DataFrame, dt: Column, edges: list, nhit_cut: float = 300) -> DataFrame:
    """Per dt bin: events, median nhit and fraction at or above ``nhit_cut`` (null when empty)."""
    b = cands.select(edge_bin(dt, edges).alias("bin"), F.col("nhit").cast("double").alias("nhit")).where("bin is not null")
    b = stage(b, "recovery")          # the candidates are found once, for the medians and the fractions
    med = exact_quantiles(b, ["bin"], F.col("nhit"), {"median_nhit": 0.5})
    frac = b.groupBy("bin").agg(F.avg((F.col("nhit") >= nhit_cut).cast("int")).alias("fraction"))
    bins = cands.sparkSession.range(len(edges) - 1).withColumnRenamed("id", "bin")
    lo = F.array(*[F.lit(float(v)) for v in edges[:-1]])
    return (
        bins.join(med, "bin", "left").join(frac, "bin", "left")
        .select("bin", lo[F.col("bin").cast("int")].alias("dt_lo"), F.coalesce("n", F.lit(0)).alias("events"),
                "median_nhit", "fraction")
    )


def sideband(cands: DataFrame, dt: Column, value: Column, bins: tuple, early: tuple, late: tuple) -> DataFrame:
    """Early minus scaled late histogram of ``value`` (A30), empty bins included; ``bins = (lo, width, n)``, windows inclusive."""
    w = (early[1] - early[0]) / max(late[1] - late[0], 1e-9)
    every = cands.sparkSession.range(bins[2]).select(F.col("id").alias("bin"))
    counted = (
        cands.select(uniform_bin(value, *bins).cast("long").alias("bin"), dt.between(*early).alias("e"),
                     ((dt > late[0]) & (dt <= late[1])).alias("l"))
        .where("bin is not null").groupBy("bin")
        .agg(F.count_if("e").alias("n_early"), F.count_if("l").alias("n_late"))
    )
    return every.join(counted, "bin", "left").na.fill(0, ["n_early", "n_late"]).withColumn("signal", F.col("n_early") - w * F.col("n_late"))


def tag_rate(tagged: DataFrame, file_key: Column, seconds: Column) -> DataFrame:
    """Real tags per second between the first and last tag of each file (A38): per-file span, then one total."""
    per = (
        tagged.where("is_tag").select(file_key.alias("_f"), seconds.alias("_s"), "retrigger")
        .groupBy("_f").agg((F.max("_s") - F.min("_s")).alias("live"), F.count_if(~F.col("retrigger")).alias("real"),
                           F.count_if("retrigger").alias("re"))
    )
    return per.agg(F.count(F.lit(1)).alias("files"), F.sum("real").alias("n_real"), F.sum("re").alias("n_retrigger"),
                   F.sum("live").alias("live_s")).withColumn("rate", F.col("n_real") / F.greatest("live_s", F.lit(1.0)))
