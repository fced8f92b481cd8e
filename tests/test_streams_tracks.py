"""Tracks in the stream's state and the interval join of two streams, on rows out of order over five batches, against the batch join."""

import random

import pytest
from pyspark.sql import functions as F

from scintlake.operators import correlate as C
from scintlake.plans.streams import TRACK, timed
from scintlake.streaming import monitors as M
from scintlake.streaming import tagger as G
from test_track_payload import DEAD, HARD, ID_HITS, SOFT, events

MS = 40_000
WINDOW = 60 * MS
NAMES = ("run long, event long, ts long, q17 double, nhit long, x double, y double, z double, ex double, ey double, ez double, xx double, xy double, "
         "xz double, vertex_ok boolean, converged boolean")


@pytest.fixture(scope="module")
def rows():
    return [(r[0], r[1], r[2] * MS, *r[3:]) for r in events(seed=11, n=300)]


@pytest.fixture(scope="module")
def batch(spark, rows):
    e, x = (tuple(F.col(k + c) for c in "xyz") for k in "ex")
    hard = F.col("q17") >= HARD
    df = spark.createDataFrame(rows, NAMES)
    only = C.od_only(F.col("q17") >= SOFT, hard, F.col("nhit"), ID_HITS)
    own = C.track_payload(e, x, F.col("converged") & ~only)
    return C.tag_previous(df, F.col("q17") >= SOFT, hard, DEAD * MS, None, own).withColumn("own", own).cache()


def cut(spark, path, df, columns):
    """Five files; each row up to 40 ms late against its place in time."""
    data = sorted(df.select(*columns).collect(), key=lambda r: r["ts"] + random.Random(r["event"]).random() * 40 * MS)
    schema = df.select(*columns).schema
    for k in range(5):
        spark.createDataFrame(data[k * len(data) // 5:(k + 1) * len(data) // 5], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), spark.createDataFrame(data, schema)


def closed(stream, table):
    stream, end = M.ended(stream, table, "ts", lambda r: r.withColumn("ts", F.col("ts") + 40 * WINDOW).withColumn("run", F.col("run") - 1_000_000))
    return timed(stream), end


def values(df, names):
    return sorted(tuple(None if v is None else round(v, 6) for v in r) for r in df.select(*names).collect())


def test_track_in_state(spark, batch, tmp_path):
    src = batch.select("run", "event", "ts", "nhit", "q17", *[F.col(f"own.{c}").alias(c) for c in TRACK])
    t, end = closed(*cut(spark, str(tmp_path / "in"), src, src.columns))
    got = M.drain(G.stream_tagger(t, "time", "50 milliseconds", SOFT, HARD, DEAD * MS, (), TRACK), "test-tracks", end=end)
    want = batch.select("run", "event", "prev_event", "dt", *[F.col(f"prev_track.{c}").alias(f"prev_{c}") for c in TRACK])
    assert values(got, want.columns) == values(want, want.columns)
    assert 0 < got.where("prev_ex is null and prev_event >= 0").count() < got.count()


def test_interval_join_equals_state(spark, batch, tmp_path):
    real = batch.where("is_tag and not retrigger").select("run", "event", "ts", *[F.col(f"own.{c}").alias(c) for c in TRACK])
    quiet = batch.where("not is_tag").select("run", "event", "ts", "nhit")
    tags, end_tags = closed(*cut(spark, str(tmp_path / "tags"), real, real.columns))
    rest, end_rest = closed(*cut(spark, str(tmp_path / "rest"), quiet, quiet.columns))

    def end():
        end_tags()
        end_rest()
    out = G.stream_parents(tags, rest, "50 milliseconds", WINDOW, f"{WINDOW // MS + 1} MILLISECONDS", TRACK)
    got = M.drain(out, "test-parents", end=end)
    want = batch.where((~F.col("is_tag")) & (F.col("dt") <= WINDOW)).select(
        "run", "event", "ts", "nhit", "prev_event", "dt", *[F.col(f"prev_track.{c}").alias(f"prev_{c}") for c in TRACK])
    assert values(got, want.columns) == values(want, want.columns) and want.count() > 50
