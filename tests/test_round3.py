"""Tables of several files, ties and larger copies that the third round asked about."""

import math
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, duck

SF = "/root/testdata/sf0.001"


def test_run_bins_sums_as_sql(spark):
    ok, message, _ = compare(spark, duck(SF), SF, entry.queries()["calibrated_hits_run_bins"], entry.oracle_sql()["calibrated_hits_run_bins"])
    assert ok, message


def test_stream_reads_a_table_of_several_files(spark, tmp_path):
    """A folder of files as a table streams like one file, whatever the files are called."""
    from scintlake import views

    t = spark.read.parquet(f"{SF}/events.parquet")
    t.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    (tmp_path / "more_events.parquet").symlink_to(f"{SF}/events.parquet")
    for sf in (SF, str(tmp_path)):
        s = views.table_stream(spark, sf, "events")
        q = s.writeStream.format("memory").queryName("several_files").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table("several_files").count() == t.count()


def test_stream_channel_stats_of_several_files(spark, tmp_path):
    spark.read.parquet(f"{SF}/embeddings.parquet").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    want = entry.queries()["stream_channel_stats"](spark, SF)
    got = entry.queries()["stream_channel_stats"](spark, str(tmp_path))
    assert want.count() > 0 and want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0


def test_sensor_positions_are_those_of_the_sql(spark):
    """To the last digit: a hit on the edge of a bin must not move by the sine that was used."""
    from scintlake import views
    from scintlake.functions import geometry as G

    want = duck(SF).execute(views.with_views("sensor") + " SELECT cable, px, py, pz FROM sensor").fetchall()
    assert sorted(tuple(r) for r in G.sensors(spark).collect()) == sorted(want)


@pytest.mark.parametrize("chunk", [64, 1 << 16])
def test_held_rows_are_pieces_of_time(chunk, monkeypatch):
    """Rows that come out of order are held packed and go out in time order, a part at a time, with the tags of the whole."""
    import random

    import numpy as np
    import pandas as pd

    from scintlake.streaming import tagger as G

    class Value:
        def __init__(self): self.v = None
        def exists(self): return self.v is not None
        def get(self): return self.v
        def update(self, v): self.v = v

    class Held(dict):
        def updateValue(self, k, v): self[k] = v
        def getValue(self, k): return self[k]
        def removeKey(self, k): del self[k]

    monkeypatch.setattr(G, "CHUNK", chunk)
    rng = random.Random(5)
    rows = pd.DataFrame([(i, rng.randrange(40_000), 3, rng.random() < 0.2, rng.random() < 0.05) for i in range(1000)], columns=["event", "ts", "nhit", "tag", "hard"])
    rows["hard"] &= rows["tag"]
    want, end = G.advance(rows.assign(run=1), (G.NONE,) * 3, 500)
    t = G.Tagger(500, ticks_per_ms=1)
    t.last, t.parts, t.held = Value(), Value(), Held()
    parts, sizes = [], []
    for k, watermark in enumerate((0, 20_000, 20_001, 50_000)):
        for out, _ in t.released(1, iter([rows[i::8] for i in range(8)] if k == 0 else []), watermark):
            parts.append(out)
        sizes.append(max((len(np.frombuffer(v[0], t.types)) for v in t.held.values()), default=0))
        assert bool(t.due) == (k < 3) and all(d >= watermark for d in t.due)
    got = pd.concat(parts, ignore_index=True)
    assert got.astype(object).where(got.notna(), None).equals(want.astype(object).where(want.notna(), None))
    assert not t.held and tuple(t.last.get()) == end
    assert chunk > 64 or (sizes[0] <= 64 and len(parts) > 8)


def test_event_meets_one_tag_in_its_block(spark):
    """The interval join deals a run's rows by time, and a tag lasts up to the next one."""
    import random

    from scintlake.plans.streams import timed
    from scintlake.streaming import tagger as G

    rng, ms, window = random.Random(3), 40_000, 512 * 40_000
    at = sorted(rng.sample(range(5000), 200))
    tags = [(1, 10_000 + i, t * ms, after * ms if after is not None else None) for i, (t, after) in enumerate(zip(at, [*at[1:], None]))]
    rows = [(1, i, rng.randrange(7000) * ms) for i in range(1500)]
    want = []
    for _, e, ts in rows:
        before = [t for t in tags if t[2] < ts]
        if before and ts - before[-1][2] <= window:
            want.append((1, e, before[-1][1], ts - before[-1][2]))
    t = timed(spark.createDataFrame(tags, "run long, event long, ts long, until long"))
    out = G.stream_parents(t, timed(spark.createDataFrame(rows, "run long, event long, ts long")), "50 milliseconds", window, "513 MILLISECONDS")
    assert sorted(map(tuple, out.select("run", "event", "prev_event", "dt").collect())) == sorted(want)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("tag_block") > 1
