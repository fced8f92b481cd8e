"""Versioned tables of running constants, and silent sensors of closed windows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from scintlake.streaming import monitors as M


def waves(n, start=0):
    """(cable, atwd, gain, launch, samples) of flat waveforms."""
    return [(i % 7, i % 2, 0, 0, [float(start + i % 5)] * 3) for i in range(start, start + n)]


SCHEMA = "cable long, atwd long, gain long, launch long, samples array<double>"
KEYS = ["cable", "atwd", "gain", "sample"]


def test_only_changed_channels_are_written(spark, tmp_path):
    path, table = str(tmp_path / "in"), str(tmp_path / "table")
    parts = [waves(20), [w for w in waves(30, 40) if w[0] == 3], waves(5, 90), [w for w in waves(40, 200) if w[0] in (1, 9)]]
    seen = []
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        M.upsert(M.stream_channel_stats(spark.readStream.schema(SCHEMA).parquet(path)), table)
        seen += rows
        whole = M.stream_channel_stats(spark.createDataFrame(seen, SCHEMA))
        assert Counter(map(tuple, M.latest(spark, table, KEYS).select(*whole.columns).collect())) == Counter(map(tuple, whole.collect()))
        changed = spark.read.parquet(f"{table}/changes").where(F.col("version") == k).select("cable", "atwd").distinct().collect()
        assert {tuple(r) for r in changed} == {(r[0], r[1]) for r in rows}
        if k == 1:
            assert M.snapshot(spark, table, KEYS) == 1
    first = M.stream_channel_stats(spark.createDataFrame(parts[0], SCHEMA))
    for version, upto in ((0, 1), (2, 3)):      # before and after the snapshot
        whole = M.stream_channel_stats(spark.createDataFrame([r for p in parts[:upto] for r in p], SCHEMA))
        assert Counter(map(tuple, M.latest(spark, table, KEYS, version).select(*first.columns).collect())) == Counter(map(tuple, whole.collect()))


def test_a_batch_run_again_replaces_its_rows(spark, tmp_path):
    table = str(tmp_path / "table")
    rows = M.stream_channel_stats(spark.createDataFrame(waves(10), SCHEMA))
    for _ in range(2):
        rows.write.mode("overwrite").parquet(f"{table}/changes/version=0")
    assert M.latest(spark, table, KEYS).count() == rows.count()


@pytest.mark.parametrize("files", [1, 3])
def test_silent_sensors_have_rows(spark, tmp_path, files):
    rows = [(f"2024-01-01 00:{m:02d}:{s:02d}", c) for m, s, c in [(1, 0, 4), (1, 30, 4), (2, 0, 5), (12, 0, 5), (31, 0, 6), (13, 0, 99)]]
    table = spark.createDataFrame(rows, "ts string, cable long").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "in")
    table.sort("ts").repartition(files).write.parquet(path)
    stream = spark.readStream.schema(table.schema).parquet(path)
    stream, end = M.ended(stream, table, "ts", lambda r: r.withColumn("ts", F.col("ts") + F.expr("INTERVAL 3 HOURS")))
    sensors = spark.createDataFrame([(4,), (5,), (6,)], "cable long")
    got = M.drain(M.stream_silent(stream, sensors, "ts", "10 minutes", "1 minute"), "silent-test", end=end)
    told = {(r["start"].minute, r["cable"]): (r["n"], r["silent"]) for r in got.collect()}
    assert told == {(0, 4): (2, False), (0, 5): (1, False), (0, 6): (0, True), (10, 4): (0, True), (10, 5): (1, False), (10, 6): (0, True),
                    (30, 4): (0, True), (30, 5): (0, True), (30, 6): (1, False)}
