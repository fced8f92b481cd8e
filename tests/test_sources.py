"""Text fields, readers, writers and the streaming jobs."""

import json

import pytest
from pyspark.sql import functions as F

from scintlake.functions import text as X
from scintlake.functions import trigger as T
from scintlake.operators import cube as U
from scintlake.operators import hits as H
from scintlake.plans.correlation import DEAD, HARD, MIN_MULT, SOFT, WINDOW, tagged
from scintlake.operators import correlate as C
from scintlake.sources import tables as TB
from scintlake.sources import text as TX
from scintlake.streaming import monitors as M
from scintlake.streaming import tagger as G
from scintlake import views

COMMENTS = [("+3.50 m", 350), ("Ge68 in balloon center", 0), ("Ge68 +6.00 m", 600), ("Ge68 (-2.0 m)", -200), ("Ge68 at +5.25", 525),
            ("Ge68 at (-5.25)", -525), (" Ge68 at 0.00 m", 0), ("Co60 +1.50 m", 150), ("+350 cm", 350), ("normal run", None), ("co 60 run", None),
            ("co 60 run, 20' PMTs off", None), ("Co-60 source - -3m", -300), ("Co60 --5.25 m", -525), ("source Co60 +5.25 m", 525)]


def test_source_position(spark):
    d = spark.createDataFrame([(c,) for c, _ in COMMENTS], "c string").select(X.source_z_cm(F.col("c"))).collect()
    assert [r[0] for r in d] == [None if z is None else pytest.approx(z) for _, z in COMMENTS]


def test_run_list(spark, tmp_path):
    (tmp_path / "runs.txt").write_text(
        "000166   2002/03/05(Tue)02:22(57)   5.764   1015262577  0   1   OD inefficiency ~13%\n"
        "009937   2010/12/05(Sun)10:04(23)   1.576   1291511063  1   6  HV10 is down, 17 and 20 inch half badrun -> veto(141054016614 ~ end)\ngarbage line\n")
    r = TX.run_list(spark, str(tmp_path / "runs.txt")).orderBy("run").collect()
    assert [(x.run, x.hours, x.flag, x.grade) for x in r] == [(166, 5.764, 0, 1), (9937, 1.576, 1, 6)]
    v = spark.createDataFrame([(x.comment,) for x in r] + [("veto(start~5) Veto( 7 ~ 9 )",)], "c string").select(X.veto_intervals(F.col("c"))).collect()
    assert [[tuple(i) for i in x[0]] for x in v] == [[], [(141054016614, None)], [(None, 5), (7, 9)]]


def test_trigger_words(spark):
    d = spark.createDataFrame([(0,), (257,), (0x70,), (0x10C0,), (-2147483648,), (1 << 14 | 1,)], "t long")
    got = d.select(T.describe(F.col("t")), T.is_physics(F.col("t"))).collect()
    assert [g[0] for g in got] == ["none", "IDGlobal|Prescale", "PedestalA", "Acq0xc0|CalibSource0x1000", "ODHistBottom", "IDGlobal|CalibSource0x4000"]
    assert [g[1] for g in got] == [False, True, False, False, False, True]


def test_file_numbers(spark):
    d = spark.createDataFrame([("a/run_000012_000003_000045.sf",), ("run_1.sf",), ("x_y_z_w.sf",)], "p string")
    assert [r[0] for r in d.select(X.file_number(F.col("p"))).collect()] == [45, -1, -1]


def test_geometry_and_energy_tables(spark, tmp_path):
    (tmp_path / "g.dat").write_text("0 1 2 3\n1878 10 0 0\n1879 10 0 0\n")
    g = TX.geometry(spark, str(tmp_path / "g.dat"), 0.5).orderBy("cable").collect()
    assert [(r.cable, r.px) for r in g] == [(0, 0.5), (1878, 5.0), (1879, 10.0)]
    (tmp_path / "e2.dat").write_text("1.0 0.9\n2.0 0.95\n")
    (tmp_path / "e8.dat").write_text("1.0 0.9 .91 .92 .93 .94 .95 .96\n")
    a = TX.visible_energy_table(spark, str(tmp_path / "e2.dat"), "gamma").collect()
    assert len(a) == 14 and {r.ratio for r in a if r.e_real == 1.0} == {0.9}
    b = TX.visible_energy_table(spark, str(tmp_path / "e8.dat"), "gamma").orderBy("variant").collect()
    assert [r.ratio for r in b] == [.9, .91, .92, .93, .94, .95, .96]


def test_run_selection_and_files(spark):
    s = spark.createDataFrame([("881-883, 1518,882,",)], "spec string")
    assert sorted(r.run for r in TX.run_selection(s).collect()) == [881, 882, 883, 1518]
    f = spark.createDataFrame([(1, f"f{i}") for i in range(5)], "run int, file string")
    assert [r.file for r in TX.file_slice(f, 2, 3).orderBy("file").collect()] == ["f1", "f2"]
    assert TX.first_files(f, 2).count() == 2


def test_frames(spark, sf, tmp_path):
    root = str(tmp_path / "frames")
    t = views.trig(spark, sf)
    TB.write_frames(t, root)
    d = TB.load_frames(spark, root, [1, 2], ["run", "ts", "event", "q17"])
    rows = d.collect()
    assert len(rows) == t.where("run in (1, 2)").count() and [(r.run, r.ts) for r in rows] == sorted((r.run, r.ts) for r in rows)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [run" in plan or "PartitionFilters: [isnotnull(run" in plan or "run#" in plan.split("PartitionFilters")[1][:60]
    with pytest.raises(FileNotFoundError):
        TB.load_frames(spark, root, 99)
    assert TB.load_patterns(spark, [f"{root}/run=1", f"{root}/run=1"]).count() == t.where("run = 1").count()
    assert TB.with_file_number(spark.read.parquet(root)).select("file").distinct().count() >= 1


def test_cache_and_event_tables(spark, sf, tmp_path):
    h, root = views.hits(spark, sf), str(tmp_path / "cache")
    ev = H.event_totals(h).select("run", "event", "nhit")
    TB.write_cache(h, ev, ev.select("run").distinct(), root, min_nhit=3)
    hits, events, runs = TB.load_cache(spark, root, [1, 2])
    assert events.where("nhit < 3").count() == 0 and runs.count() == 2
    assert hits.count() == h.join(ev.where("nhit >= 3 and run in (1, 2)"), ["run", "event"], "left_semi").count()
    TB.write_events_csv(ev, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["run", "event", "nhit"] and back.count() == ev.count()
    TB.write_events_with_hits(ev, H.pack_hits(H.primary_hits(h), ["t", "q"]), str(tmp_path / "ragged"))
    assert spark.read.parquet(str(tmp_path / "ragged")).where(F.size("hits") > 0).count() == ev.where("nhit > 0").count() + ev.where("nhit = 0").join(
        H.primary_hits(h), ["run", "event"], "left_semi").count()


def test_calibration_file(spark, tmp_path):
    d = {"bin_ns": [[1.5, 1.6], [1.4, 1.45]], "q1pe": [[100., 110.], [90., 95.]], "t0": [[0.5, -0.5], [1., 2.]], "gain_factor": [1.0, 4.86, 41.86, 1.0],
         "bad": [0, 1], "eta": [0.2, 0.0], "eta_q": None, "dark": None, "meta": {"a": "1"}}
    (tmp_path / "c.json").write_text(json.dumps(d, indent=1))
    t = TB.load_calibration(spark, str(tmp_path / "c.json"))
    assert {(r.cable, r.atwd): r.t0 for r in t["channel"].collect()} == {(0, 0): .5, (0, 1): -.5, (1, 0): 1., (1, 1): 2.}
    assert [(r.bad, r.eta, r.dark) for r in t["tube"].orderBy("cable").collect()] == [(False, .2, None), (True, 0., None)]
    TB.save_calibration(t["channel"], t["tube"], t["gain"], {"a": "1"}, str(tmp_path / "out"))
    u = TB.load_calibration(spark, str(tmp_path / "out"))
    for k in ("channel", "tube", "gain"):
        assert sorted(map(str, u[k].collect())) == sorted(map(str, t[k].collect()))
    assert u["meta"].first().meta == {"a": "1"}
    # cables are positions: gaps are filled, not closed up
    TB.save_calibration(t["channel"].where("cable = 1 and atwd = 1").withColumn("cable", F.lit(2).cast("long")), t["tube"].where("cable = 0"), t["gain"], {}, str(tmp_path / "gap"))
    g = TB.load_calibration(spark, str(tmp_path / "gap"))
    assert {(r.cable, r.atwd): (r.q1pe, r.t0) for r in g["channel"].collect()} == {(2, 1): (95.0, 2.0)} | {
        (c, a): (200.0, 0.0) for c in range(3) for a in range(2) if (c, a) != (2, 1)}
    assert [r.eta for r in g["tube"].orderBy("cable").collect()] == [0.2, None, None]


def test_cube_file_and_merge(spark, tmp_path):
    c = spark.createDataFrame([(0, 0, 0, 0, -1.0)], "type int, qbin int, dbin int, tbin int, logp double")
    TB.write_cube(c, U.cube_meta(spark), str(tmp_path / "cube"))
    cube, meta = TB.load_cube(spark, str(tmp_path / "cube"))
    assert cube.collect() == c.collect() and meta.first().lo == -40.0
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "z int, x int")
    assert TB.union_common(a, b).collect() == [(1,), (4,)]
    top, kid = TB.merge_results([(a, a), (b, b)])
    assert top.columns == ["x", "part"] and kid.count() == 2
    assert [r.p for r in TB.distinct_paths(spark.createDataFrame([("b",), ("a",), ("b",)], "p string")).collect()] == ["a", "b"]


def test_find_files(spark, tmp_path):
    for d, names in (("first", ["run_0005_1.sf"]), ("second/sub", ["run_0005_2.sf", "run_0006_1.sf", "other.txt"])):
        (tmp_path / d).mkdir(parents=True)
        for n in names:
            (tmp_path / d / n).write_text("x")
    f = TB.find_files(spark, [str(tmp_path / "first"), str(tmp_path / "second")], "*.sf").orderBy("run").collect()
    assert [(r.run, r.file.rsplit("/", 1)[1]) for r in f] == [(5, "run_0005_1.sf"), (6, "run_0006_1.sf")]


HOUR_MS = 3_600_000


def pieces(spark, sf, tmp_path, n=6):
    """The trigger table in ``n`` micro-batches whose rows are out of order by up to half an hour, within the delay of one hour."""
    t = views.trig(spark, sf).withColumn("time", F.timestamp_micros((F.col("ts") / 40).cast("long")))
    late = t.toPandas()
    late["seen"] = late["ts"] // 40_000 + (late["event"] * 7919) % (HOUR_MS // 2)
    late = late.sort_values("seen").reset_index(drop=True)
    assert (late["ts"].diff() < 0).any()
    for i in range(n):
        part = late.iloc[i * len(late) // n:(i + 1) * len(late) // n].drop(columns="seen")
        spark.createDataFrame(part, t.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def watermark(spark, sf):
    return views.trig(spark, sf).agg(F.max(F.floor(F.col("ts") / 40_000))).first()[0] - HOUR_MS


def test_stream_equals_batch(spark, sf, tmp_path):
    s = M.drain(G.stream_tagger(pieces(spark, sf, tmp_path), "time", "1 hour", SOFT, HARD, DEAD), "t")
    cols = ["run", "event", "is_tag", "retrigger", "prev_event", "dt"]
    due = tagged(spark, sf).where(F.floor(F.col("ts") / 40_000) < watermark(spark, sf))
    assert sorted(map(tuple, s.select(*cols).collect()), key=lambda r: r[:2]) == sorted(map(tuple, due.select(*cols).collect()), key=lambda r: r[:2])


def test_stream_followups_close_every_window(spark, sf, tmp_path):
    s = M.drain(G.stream_followups(pieces(spark, sf, tmp_path), "time", "1 hour", SOFT, HARD, DEAD, WINDOW, MIN_MULT), "f").toPandas()
    wm, b = watermark(spark, sf), tagged(spark, sf)
    due = b.where(F.floor(F.col("ts") / 40_000) < wm)
    assert set(s[s.kind == "cand"].event) == {r.event for r in C.followups(due, WINDOW, MIN_MULT).collect()}
    real = due.where("is_tag and not retrigger").toPandas().sort_values(["run", "ts"])
    last = real.groupby("run")["ts"].transform("max") == real["ts"]
    closed = real[~last | ((real["ts"] + WINDOW) // 40_000 < wm)]
    want = {r.event: r.n_after for r in C.n_after(due, WINDOW).collect()}
    got = dict(s[s.kind == "n_after"][["event", "value"]].itertuples(index=False))
    assert got == {e: want[e] for e in closed["event"]}
