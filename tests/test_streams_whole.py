"""The registered stream queries leave out nothing of a bounded input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from compare import duck, rows_of
from scintlake.operators import correlate as C
from scintlake.plans import load
from scintlake.plans.correlation import HARD, MIN_MULT, WINDOW, tagged

SF = "/root/testdata/sf0.001"

WHOLE = {
    "stream_rate": f"""SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS start, count(*) FILTER (value >= {HARD}) AS n_tags, count(*) AS n_events,
  round(count(*) FILTER (value >= {HARD}) / 21600.0, 9) AS rate FROM events GROUP BY 1""",
    "stream_occupancy": """SELECT CAST(floor(epoch(l_shipdate) / 8640000) AS BIGINT) * 8640000 AS start, l_partkey % 2126 AS cable, count(*) AS n FROM lineitem GROUP BY 1, 2""",
}


@pytest.mark.parametrize("name", WHOLE)
def test_windows_are_whole(spark, name):
    got = load().QUERIES[name](spark, SF)
    cur = duck(SF).execute(WHOLE[name])
    assert rows_of(got.columns, got.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_tagger_is_whole(spark):
    cols = ["run", "event", "ts", "is_tag", "retrigger", "prev_event", "dt"]
    got = load().QUERIES["stream_tagger"](spark, SF)
    assert Counter(map(tuple, got.select(*cols).collect())) == Counter(map(tuple, tagged(spark, SF).select(*cols).collect()))


def test_followups_are_whole(spark):
    got = load().QUERIES["stream_followups"](spark, SF).toPandas()
    b = tagged(spark, SF)
    n = got[got.kind == "n_after"]
    assert sorted(got[got.kind == "cand"].event) == sorted(r.event for r in C.followups(b, WINDOW, MIN_MULT).collect())
    want = {r.event: r.n_after for r in C.n_after(b, WINDOW).collect()}
    real = [r.event for r in b.where(F.col("is_tag") & ~F.col("retrigger")).collect()]
    assert len(n) == len(real) and dict(zip(n.event, n.value)) == {e: want[e] for e in real}
