"""The hit cache is read under a join that prunes its directories at run time; pattern reads come in order."""

from scintlake import views
from scintlake.plans.records import cached_hits
from scintlake.sources import tables as TB


def test_directories_are_pruned_by_the_join(spark, sf):
    df = cached_hits(spark, sf)
    assert "dynamicpruning" in df._jdf.queryExecution().optimizedPlan().toString()
    chosen = {r["n_nationkey"] for r in views.table(spark, sf, "nation").where("n_regionkey = 1").collect()}
    there = {r["run"] for r in views.hits(spark, sf).select("run").distinct().collect()}
    assert {r["run"] for r in df.select("run").distinct().collect()} == chosen & there and there - chosen


def test_pattern_reads_are_sorted(spark, tmp_path):
    df = spark.createDataFrame([(2, 5, 1), (1, 9, 2), (1, 3, 4), (1, 3, 3), (2, 1, 5)], "run long, ts long, event long")
    df.repartition(3).write.parquet(str(tmp_path / "a"))
    got = [tuple(r) for r in TB.load_patterns(spark, [f"{tmp_path}/a", f"{tmp_path}/a"]).collect()]
    assert got == [(1, 3, 3), (1, 3, 4), (1, 9, 2), (2, 1, 5), (2, 5, 1)]
