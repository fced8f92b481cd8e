"""Group starts, islands and greedy choices on rows with nulls and ties."""

from pyspark.sql import functions as F

from scintlake.operators import scan as S
from scintlake.operators import track_scan as T


def test_group_starts_with_null_keys(spark):
    rows = [("a", i, k) for i, k in enumerate([None, None, 1, 1, None, 2])] + [("b", 0, 1)]
    got = S.group_starts(spark.createDataFrame(rows, "p string, i int, k int"), ["p"], ["i"], "k").orderBy("p", "i").collect()
    assert [r["is_start"] for r in got] == [True, False, True, False, True, True, True]


def test_islands_and_sums(spark):
    rows = [(0, i, w) for i, w in enumerate([1.0, None, 2.0, 3.0, -1.0, 0.0, 4.0])]
    d = spark.createDataFrame(rows, "wf int, i int, w double")
    got = S.islands(d, ["wf"], "i", F.col("w") > 0).orderBy("i").collect()
    assert [r["island"] for r in got] == [1, None, 2, 2, None, None, 3]
    assert [r["cumsum"] for r in S.running_sum(d, ["wf"], "i", "w").orderBy("i").collect()] == [1, 1, 3, 6, 5, 5, 9]


def test_greedy_distinct(spark):
    """A candidate goes only when both of its ends are close to one that is kept, not to one that went."""
    at = lambda x: (x, 0.0, 0.0)
    rows = [(1, 9.0, *at(0.0), *at(100.0)), (1, 8.0, *at(5.0), *at(105.0)), (1, 7.0, *at(14.0), *at(114.0)), (1, 6.0, *at(0.0), *at(300.0)), (1, 5.0, *at(900.0), *at(9.0))]
    d = spark.createDataFrame(rows, "e int, score double, ex double, ey double, ez double, xx double, xy double, xz double")
    kept = lambda n: [r["score"] for r in T.greedy_distinct(d, ["e"], "score", 10.0, n).orderBy("place").collect()]
    assert kept(20) == [9.0, 7.0, 6.0, 5.0] and kept(2) == [9.0, 7.0]
