"""Dead time, as-of and block scans against a plain sequential loop, for several block widths."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scintlake.operators import correlate as C
from scintlake.operators import scan as S
from scintlake.streaming.tagger import NONE, advance


def make(n=4000, runs=3, seed=1, span=200_000, hot=True):
    rng = np.random.default_rng(seed)
    run = np.where(rng.random(n) < 0.6, 0, rng.integers(0, runs, n)) if hot else rng.integers(0, runs, n)
    pdf = pd.DataFrame({"run": run, "event": np.arange(n), "ts": np.sort(rng.integers(0, span, n)) + 10 ** 12,
                        "q17": rng.exponential(100.0, n), "nhit": rng.integers(0, 100, n)})
    return pdf.sort_values(["run", "ts", "event"]).reset_index(drop=True)


def loop(pdf, soft, hard, dead):
    out = []
    for run, g in pdf.groupby("run"):
        mu = ev = prev = None
        for r in g.itertuples():
            tag, h = r.q17 >= soft, r.q17 >= hard
            retrig = bool(tag and mu is not None and r.ts - mu < dead and not h)
            out.append((run, r.event, tag, retrig, -1 if mu is None else ev, None if mu is None else r.ts - mu,
                        None if prev is None else r.ts - prev))
            if tag and not retrig:
                mu, ev = r.ts, r.event
            prev = r.ts
    return pd.DataFrame(out, columns="run event is_tag retrigger prev_event dt dt_prev".split()).sort_values("event").reset_index(drop=True)


@pytest.mark.parametrize("width,dead", [(500, 300), (7000, 300), (10 ** 9, 300), (2000, 5000)])
def test_tag_previous(spark, width, dead):
    pdf = make()
    want = loop(pdf, 60, 350, dead)
    df = spark.createDataFrame(pdf)
    got = C.tag_previous(df, F.col("q17") >= 60, F.col("q17") >= 350, dead, width).toPandas().sort_values("event").reset_index(drop=True)
    for c in ("is_tag", "retrigger", "prev_event"):
        assert (got[c].to_numpy() == want[c].to_numpy()).all(), c
    assert np.array_equal(got["dt"].fillna(-1).to_numpy(float), want["dt"].astype(float).fillna(-1).to_numpy())


@pytest.mark.parametrize("width", [50, 900, 10 ** 7])
def test_real_tags_any_block_width(spark, width):
    pdf = make(seed=5)
    want = loop(pdf, 60, 350, 400)
    real = set(want[want.is_tag & ~want.retrigger]["event"])
    t = spark.createDataFrame(pdf[pdf.q17 >= 60])
    got = C.real_tags(t, 400, F.col("q17") >= 350, width)
    assert {r.event for r in got.collect()} == real


@pytest.mark.parametrize("width", [100, 5000, 10 ** 9])
def test_block_scans(spark, width):
    pdf = make(seed=2)
    df = spark.createDataFrame(pdf)
    got = C.dt_prev(df, width).toPandas().sort_values("event")["dt_prev"].fillna(-1).to_numpy(float)
    want = loop(pdf, 60, 350, 300)["dt_prev"].astype(float).fillna(-1).to_numpy()
    assert np.array_equal(got, want)
    seg = S.hard_segments(df, ["run"], ["ts", "event"], F.col("q17") >= 350, width).toPandas().sort_values(["run", "ts", "event"])
    assert (seg["segment"].to_numpy() == (pdf.q17 >= 350).groupby(pdf.run).cumsum().to_numpy()).all()


def test_followups_and_counts(spark):
    pdf = make(seed=3)
    t = C.tag_previous(spark.createDataFrame(pdf), F.col("q17") >= 60, F.col("q17") >= 350, 300, 4000).cache()
    w = loop(pdf, 60, 350, 300).merge(pdf[["event", "nhit"]], on="event")
    inside = w[~w.is_tag & (w.dt <= 900)]
    assert {r.event for r in C.followups(t, 900, 50).collect()} == set(inside[inside.nhit >= 50].event)
    n = C.n_after(t, 900).toPandas().set_index("event")["n_after"]
    want = inside.groupby("prev_event").size()
    assert len(n) == (w.is_tag & ~w.retrigger).sum() and (n == 0).any()
    assert all(n[e] == c for e, c in want.items())


def test_stream_step_in_pieces_equals_whole():
    pdf = make(seed=4, hot=False)
    pdf["tag"], pdf["hard"] = pdf.q17 >= 60, pdf.q17 >= 350
    one = pdf[pdf.run == 1].reset_index(drop=True)
    whole, _ = advance(one, (NONE, NONE, NONE), 300)
    state, parts = (NONE, NONE, NONE), []
    cut = [0, 1, 7, 300, 301, len(one)]
    # a cut never separates rows of the same tick
    for a, b in zip(cut, cut[1:]):
        out, state = advance(one.iloc[a:b], state, 300)
        parts.append(out)
    pd.testing.assert_frame_equal(pd.concat(parts, ignore_index=True), whole)


def test_count_within(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": np.where(rng.random(3000) < 0.5, 0, rng.integers(0, 20, 3000)), "t": np.round(rng.uniform(-4000, 4000, 3000), 1)})
    got = S.count_within(spark.createDataFrame(pdf), ["g"], "t", 200.0, spread=2).groupBy("g").agg(F.max("n_within").alias("n")).toPandas()
    for r in got.itertuples():
        t = np.sort(pdf[pdf.g == r.g].t.to_numpy())
        assert r.n == (np.searchsorted(t, t + 200, side="right") - np.arange(len(t))).max()


def test_islands_and_running_sum(spark):
    pdf = pd.DataFrame({"g": [1] * 6 + [2] * 3, "i": list(range(6)) + [0, 1, 2], "v": [1, 1, -1, 2, -1, 3, 1, -1, 1]})
    d = S.islands(spark.createDataFrame(pdf), ["g"], "i", F.col("v") > 0)
    got = S.running_sum(d, ["g"], "i", "v").toPandas().sort_values(["g", "i"])
    assert got["island"].fillna(0).astype(int).tolist() == [1, 1, 0, 2, 0, 3, 1, 0, 2]
    assert got["cumsum"].tolist() == [1, 2, 1, 3, 2, 5, 1, 0, 1]
    starts = S.group_starts(spark.createDataFrame(pdf), [], ["g", "i"], "g").toPandas()
    assert starts.sort_values(["g", "i"])["is_start"].tolist() == [True] + [False] * 5 + [True, False, False]


def test_blocks_of_each_run(spark):
    """Each run has its own block width; a dense run does not shred a long quiet one."""
    pdf = make(seed=6)
    quiet = pd.DataFrame({"run": 9, "event": np.arange(10 ** 6, 10 ** 6 + 40), "ts": 10 ** 12 + np.arange(40) * 10 ** 9, "q17": 100.0, "nhit": 1})
    pdf = pd.concat([pdf, quiet], ignore_index=True)
    df = spark.createDataFrame(pdf)
    blocks = S.time_blocks(df, ["run"], "ts", rows_per_block=60)
    n = S.with_block(df, ["run"], "ts", blocks).groupBy("run").agg(F.countDistinct("_block").alias("n")).toPandas().set_index("run")["n"]
    assert n[0] > 30 and n[9] == 1
    want = loop(pdf, 60, 350, 300)
    got = C.tag_previous(df, F.col("q17") >= 60, F.col("q17") >= 350, 300, blocks).toPandas().sort_values("event").reset_index(drop=True)
    assert (got["prev_event"].to_numpy() == want["prev_event"].to_numpy()).all() and (got["retrigger"] == want["retrigger"]).all()
