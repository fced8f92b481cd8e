"""Queries on run records, packed words, trigger histories and merged tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import views
from ..functions import text as X
from ..functions import trigger as T
from ..functions import constants as K
from ..operators import hits as H
from ..operators import scan as S
from ..session import stage, stage_root
from ..sources import tables as TB
from ..sources import text as TX
from .registry import query, rounded

RUNS = views.with_views("runs")


@query("run_list", f"{RUNS} SELECT run, start, round(hours, 3) AS hours, unix_start, flag, grade, substr(comment, 1, 200) AS comment FROM runs WHERE status <> 'P'")
def run_list(spark, sf):
    return rounded(TX.parse_run_lines(views.run_lines(spark, sf)), 3)


@query("source_position", RUNS + r""",
c AS (SELECT run, trim(comment) AS s, regexp_replace(trim(comment), '(?i)\b(Ge|Co|Zn|Am|Be|Cs|Cf)\s*-?\s*\d+\b', ' ', 'g') AS p FROM runs),
v AS (SELECT *, regexp_extract(p, '([+-]?\d+(?:\.\d+)?)\s*(mm|cm|m)?\b', 1) AS num, regexp_extract(p, '([+-]?\d+(?:\.\d+)?)\s*(mm|cm|m)?\b', 2) AS unit FROM c),
z AS (SELECT *, CASE WHEN num <> '' THEN CAST(num AS DOUBLE) * CASE unit WHEN 'mm' THEN 0.1::DOUBLE WHEN 'cm' THEN 1.0::DOUBLE ELSE 100.0::DOUBLE END END AS zz FROM v)
SELECT run, round(CASE WHEN regexp_matches(s, '(?i)cent(er|re)') THEN 0 WHEN abs(zz) <= 700 THEN zz END, 6) AS z FROM z""")
def source_position(spark, sf):
    return rounded(views.runs(spark, sf).select("run", X.source_z_cm(F.col("comment")).alias("z")))


@query("source_energy", f"""WITH p AS (SELECT p_partkey, concat('source-', CASE p_partkey % 5 WHEN 0 THEN '60Co' WHEN 1 THEN '68ge' WHEN 2 THEN '65ZN' WHEN 3 THEN '203Hg' ELSE p_type END) AS t FROM part)
SELECT p_partkey, CASE WHEN lower(t) LIKE '%60co%' THEN 2.506 WHEN lower(t) LIKE '%68ge%' THEN 1.022 WHEN lower(t) LIKE '%65zn%' THEN 1.1155 ELSE 2.506 END::DOUBLE AS e,
  round(CASE WHEN lower(t) LIKE '%60co%' THEN 1.17324 + 1.3325 WHEN lower(t) LIKE '%68ge%' THEN 1.022 WHEN lower(t) LIKE '%65zn%' THEN 1.11552 WHEN lower(t) LIKE '%203hg%' THEN 0.27919 END::DOUBLE, 6) AS lines FROM p""")
def source_energy(spark, sf):
    p, k = views.table(spark, sf, "part"), F.col("p_partkey") % 5
    iso = F.when(k == 0, "60Co").when(k == 1, "68ge").when(k == 2, "65ZN").when(k == 3, "203Hg").otherwise(F.col("p_type"))
    t = F.concat(F.lit("source-"), iso)
    return rounded(p.select("p_partkey", X.source_energy_mev(t).alias("e"), X.summed_lines(t).alias("lines")))


@query("veto_intervals", RUNS + r""",
m AS (SELECT run, unnest(regexp_extract_all(comment, '(?i)veto\(\s*(\d+|start|begin)\s*~\s*(\d+|end)\s*\)', 0)) AS m FROM runs)
SELECT run, TRY_CAST(regexp_extract(m, '(\w+)\s*~', 1) AS BIGINT) AS "start", TRY_CAST(regexp_extract(m, '~\s*(\w+)', 1) AS BIGINT) AS "end" FROM m""")
def veto_intervals(spark, sf):
    return views.runs(spark, sf).select("run", F.explode(X.veto_intervals(F.col("comment"))).alias("v")).select("run", "v.start", "v.end")


@query("hit_words", """WITH w AS (SELECT l_orderkey AS event, (l_partkey % 4096) + (l_linenumber % 8) * 4096 AS w FROM lineitem)
SELECT event, w % 4096 AS cable, (w // 4096) % 8 AS n_waveforms, CAST(sum((w // 4096) % 8) OVER (PARTITION BY event) AS BIGINT) AS total_waveforms FROM w""")
def hit_words(spark, sf):
    """Packed words unpacked to rows, with the announced total per event."""
    li = views.table(spark, sf, "lineitem")
    w = li.select(F.col("l_orderkey").alias("event"), ((F.col("l_partkey") % 4096) + (F.col("l_linenumber") % 8) * 4096).alias("w"))
    w = w.select("event", T.unpack_cable(F.col("w")).alias("cable"), T.unpack_n_waveforms(F.col("w")).alias("n_waveforms"))
    return w.join(w.groupBy("event").agg(F.sum("n_waveforms").alias("total_waveforms")), "event")


@query("trigger_history", """SELECT event_id AS event, pos, (event_id * 7 + pos) % 4294967296 AS trig, CAST(floor(value) AS BIGINT) + pos AS nsum FROM events, (SELECT unnest(range(0, 4)) AS pos) WHERE pos <= event_id % 4""")
def trigger_history(spark, sf):
    """Variable-length history records per event, flattened in order (P5)."""
    e = views.table(spark, sf, "events")
    rec = F.transform(F.sequence(F.lit(0), (F.col("event_id") % 4).cast("int")),
                      lambda i: F.struct((F.col("event_id") * 7 + i).alias("trig"), (F.floor("value") + i).alias("nsum")))
    h = e.select(F.col("event_id").alias("event"), F.posexplode(rec).alias("pos", "r"))
    return h.select("event", F.col("pos").cast("long").alias("pos"), T.word(F.col("r.trig")).alias("trig"), F.col("r.nsum").alias("nsum"))


@query("clock_arithmetic", """SELECT event_id AS event, round(epoch_us(ts) / 1e6 % 1e6, 6) AS wall_s, (epoch_us(ts) * 40 % 1000000007) * 25 AS ns,
  round((epoch_us(ts) * 40 % 1000000007) * 0.025, 6) AS us, (event_id * 12345 - 4000) & 4294967295 AS word FROM events""")
def clock_arithmetic(spark, sf):
    e = views.table(spark, sf, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    s, rest = F.expr("unix_micros(cast(ts as timestamp)) div 1000000L") % 1000000, us % 1000000
    tick = (us * 40) % 1000000007
    return rounded(e.select(F.col("event_id").alias("event"), T.wall_seconds(s, rest, F.lit(0)).alias("wall_s"), T.ticks_to_ns(tick).alias("ns"),
                            T.ticks_to_us(tick).alias("us"), T.word(F.col("event_id") * 12345 - 4000).alias("word")))


@query("file_numbers", """SELECT event_id AS event, CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id % 17 END AS file FROM events""")
def file_numbers(spark, sf):
    e = views.table(spark, sf, "events")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/data/run_a/notes_"), F.col("event_id").cast("string"))).otherwise(
        F.format_string("/data/run_%06d_%06d_%06d.sf", F.col("user_id"), F.col("event_id"), F.col("event_id") % 17))
    return e.select(F.col("event_id").alias("event"), X.file_number(name).alias("file"))


@query("selected_runs", f"""{views.with_views('trig')} SELECT run, event FROM trig WHERE run IN (1, 2, 3, 6)""")
def selected_runs(spark, sf):
    return TX.select_runs(views.trig(spark, sf), "1-3, 6,2").select("run", "event")


@query("file_slices", """WITH f AS (SELECT DISTINCT user_id % 8 AS run, CAST(event_id // 500 AS BIGINT) AS file FROM events)
SELECT run, file FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY file) AS n FROM f) WHERE n BETWEEN 3 AND 7""")
def file_slices(spark, sf):
    f = views.trig(spark, sf).select("run", F.expr("event div 500").alias("file")).distinct()
    return TX.file_slice(f, 3, 7)


@query("merged_tables", f"""{views.with_views('trig')}
SELECT 0 AS part, run, event, q17 FROM trig WHERE nhit < 50 UNION ALL SELECT 1, run, event, q17 FROM trig WHERE nhit >= 50""")
def merged_tables(spark, sf):
    t = views.trig(spark, sf)
    a = t.where("nhit < 50").select("run", "event", "q17", "nhit").withColumn("part", F.lit(0))
    b = t.where("nhit >= 50").select("run", "event", "q17", "trigger").withColumn("part", F.lit(1))
    return TB.union_common(a, b).select("part", "run", "event", "q17")


@query("file_totals", """WITH f AS (SELECT user_id % 8 AS run, event_id // 500 AS file, count(*) AS n, max(epoch_us(ts)) - min(epoch_us(ts)) AS live FROM events GROUP BY 1, 2)
SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS n, round(sum(live / 1e6), 3) AS live_s FROM f""")
def file_totals(spark, sf):
    t = views.trig(spark, sf).withColumn("file", F.struct("run", F.expr("event div 500").alias("f")))
    return rounded(TB.file_totals(t, {"n": F.count(F.lit(1)), "live_s": (F.max("ts") - F.min("ts")) / 40e6}), 3)


@query("packed_events", f"""{views.with_views('showers')},
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, event, cable ORDER BY gain, t NULLS LAST, q, adc, atwd) AS rk FROM showers WHERE found) WHERE rk = 1)
SELECT run, event, CAST(count(*) AS INTEGER) AS n, arg_min(q, cable) AS first_q, arg_max(q, cable) AS last_q FROM p GROUP BY run, event""")
def packed_events(spark, sf):
    p = H.pack_hits(H.primary_hits(views.showers(spark, sf)), ["t", "q"])
    return p.select("run", "event", F.size("hits").alias("n"), F.get("hits", F.lit(0))["q"].alias("first_q"),
                    F.element_at("hits", -1)["q"].alias("last_q"))


def cached_hits(spark, sf):
    """The hit cache by run, joined to a table of selected runs: only the directories of these runs are read."""
    cache = stage(views.hits(spark, sf), "hit-cache", ("run",))
    chosen = views.table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("run"), F.col("n_name").alias("shift"))
    return cache.join(chosen, "run")


@query("cache_hits", f"""{views.with_views('hits')} SELECT run, n_name AS shift, event, count(*) AS n, round(sum(q), 6) AS q
FROM hits JOIN nation ON n_nationkey = run WHERE n_regionkey = 1 GROUP BY run, n_name, event""")
def cache_hits(spark, sf):
    return rounded(cached_hits(spark, sf).groupBy("run", "shift", "event").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q")))


@query("group_starts", """SELECT l_orderkey AS event, l_linenumber AS line, l_returnflag AS flag,
  row_number() OVER w = 1 OR l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER w AS is_start FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag)""")
def group_starts(spark, sf):
    li = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"))
    # lines can share a number
    return S.group_starts(li, ["event"], ["line", "flag"], "flag")


@query("distinct_paths", "SELECT DISTINCT url AS path FROM pages")
def distinct_paths(spark, sf):
    return TB.distinct_paths(views.table(spark, sf, "pages").select(F.col("url").alias("path")))


@query("calibration_file", f"""{views.with_views('calib')},
tube AS (SELECT p_partkey % 2126 AS cable, min(p_size) < 3 AS bad, max(p_retailprice) / 1000 AS eta FROM part GROUP BY 1),
g AS (SELECT unnest(range(0, (SELECT max(cable) + 1 FROM calib))) AS cable), a AS (SELECT unnest(range(0, 2)) AS atwd)
SELECT g.cable, a.atwd, round(coalesce(bin_ns, {K.DEFAULT_BIN_NS}), 6) AS bin_ns, round(coalesce(q1pe, {K.DEFAULT_Q1PE}), 6) AS q1pe, round(coalesce(t0, 0), 6) AS t0,
  coalesce(bad, FALSE) AS bad, round(eta, 6) AS eta, NULL::DOUBLE AS dark
FROM g CROSS JOIN a LEFT JOIN calib c ON c.cable = g.cable AND c.atwd = a.atwd LEFT JOIN tube ON tube.cable = g.cable""")
def calibration_file(spark, sf):
    """Channel and tube constants written as one calibration object and read again."""
    p, none = views.table(spark, sf, "part"), F.lit(None).cast("double")
    tube = p.groupBy((F.col("p_partkey") % 2126).alias("cable")).agg(
        (F.min("p_size") < 3).alias("bad"), (F.max("p_retailprice") / 1000).alias("eta")).select("*", none.alias("eta_q"), none.alias("dark"))
    gain = spark.range(3).select(F.col("id").alias("gain"), F.lit(1.0).alias("factor"))
    path = f"{stage_root(spark)}/calibration-{uuid.uuid4().hex}"
    TB.save_calibration(views.calibration(spark, sf), tube, gain, {"made": "query"}, path)
    file = TB.load_calibration(spark, path)
    return rounded(file["channel"].join(file["tube"].select("cable", "bad", "eta", "dark"), "cable"))
