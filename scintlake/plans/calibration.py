"""Queries: hit tables, histograms, modes and channel constants."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import constants as K
from ..functions import geometry as G
from ..operators import calib as C
from ..operators import hist as B
from ..operators import hits as H
from ..operators import quantile as Q
from . import sqlparts as P
from .registry import query, rounded

V = 17.6
MIN_CHANNEL = 10            # the driver's tables are small: 10 hits per channel instead of 30


def primary_showers(spark, sf):
    return H.primary_hits(views.showers(spark, sf))


# ---- hit tables ---------------------------------------------------------------------------------------------------
@query("primary_hit", f"""{views.with_views('hits')}, {P.primary('prim', 'hits')}
SELECT run, event, cable, gain, atwd, round(t, 6) AS t, q, adc FROM prim""")
def primary_hit(spark, sf):
    return rounded(H.primary_hits(views.hits(spark, sf)).select("run", "event", "cable", "gain", "atwd", "t", "q", "adc"))


GAIN_SQL = """, h AS (SELECT * FROM {src} WHERE t IS NOT NULL AND q > 0),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, event, cable, gain ORDER BY t, q, saturated) AS rk FROM h) WHERE rk = 1),
mh AS (SELECT run, event, cable, arg_min(t, gain) AS t,
         coalesce(arg_min(q, gain) FILTER (NOT saturated), arg_max(q, gain)) AS q,
         coalesce(min(gain) FILTER (NOT saturated), max(gain)) AS gain, count(*) FILTER (NOT saturated) = 0 AS saturated
  FROM f GROUP BY run, event, cable)"""


@query("gain_collapse", views.with_views("hits") + GAIN_SQL.format(src="hits") + "SELECT run, event, cable, round(t, 6) AS t, q, gain, saturated FROM mh")
def gain_collapse(spark, sf):
    return rounded(H.gain_collapse(views.hits(spark, sf)).drop("t_lead"))


@query("event_totals", f"""{views.with_views('hits')}, {P.primary('prim', 'hits')},
a AS (SELECT run, event, count(*) FILTER (cable < 1879) AS nwave, count(*) FILTER (cable < 1879 AND saturated) AS nsat FROM hits GROUP BY run, event),
b AS (SELECT run, event, count(*) FILTER (cable < 1879) AS nhit, count(*) FILTER (cable < 1325) AS nhit17,
        count(*) FILTER (cable >= 1325 AND cable < 1879) AS nhit20, count(*) FILTER (cable >= 1879) AS nhit_od,
        sum(q) FILTER (cable < 1879) AS q_total, sum(q) FILTER (cable < 1325) AS q17,
        sum(q) FILTER (cable >= 1325 AND cable < 1879) AS q20, sum(q) FILTER (cable >= 1879) AS q_od FROM prim GROUP BY run, event)
SELECT a.run, a.event, coalesce(nhit, 0) AS nhit, coalesce(nhit17, 0) AS nhit17, coalesce(nhit20, 0) AS nhit20,
       coalesce(nhit_od, 0) AS nhit_od, nwave, nsat, coalesce(q_total, 0) AS q_total, coalesce(q17, 0) AS q17,
       coalesce(q20, 0) AS q20, coalesce(q_od, 0) AS q_od
FROM a LEFT JOIN b ON a.run = b.run AND a.event = b.event""")
def event_totals(spark, sf):
    return H.event_totals(views.hits(spark, sf))


@query("muon_totals", views.with_views("showers") + GAIN_SQL.format(src="showers") + """
SELECT run, event, count(*) FILTER (cable < 1879) AS nhit, count(*) FILTER (cable >= 1879) AS nhit_od,
  count(*) FILTER (cable < 1879 AND saturated) AS nsat, coalesce(sum(q) FILTER (cable < 1325), 0) AS q17,
  coalesce(sum(q) FILTER (cable >= 1325 AND cable < 1879), 0) AS q20, coalesce(sum(q) FILTER (cable >= 1879), 0) AS q_od,
  coalesce(sum(q) FILTER (cable BETWEEN 2120 AND 2125), 0) AS q_5inch, coalesce(sum(q) FILTER (cable < 1879), 0) AS q_total
FROM mh GROUP BY run, event""")
def muon_totals(spark, sf):
    return H.muon_totals(H.gain_collapse(views.showers(spark, sf)))


@query("n200", f"""{views.with_views('showers')},
w AS (SELECT run, event, count(*) OVER (PARTITION BY run, event ORDER BY t RANGE BETWEEN 0 PRECEDING AND 200.0 FOLLOWING) AS n
  FROM showers WHERE cable >= 1879 AND t IS NOT NULL)
SELECT run, event, max(n) AS n200 FROM w GROUP BY run, event""")
def n200(spark, sf):
    return H.coincidence(views.showers(spark, sf))


@query("muon_selection", views.with_views("showers") + GAIN_SQL.format(src="showers") + """,
w AS (SELECT run, event, count(*) OVER (PARTITION BY run, event ORDER BY t RANGE BETWEEN 0 PRECEDING AND 200.0 FOLLOWING) AS n FROM mh WHERE cable >= 1879),
o AS (SELECT run, event, max(n) AS n200 FROM w GROUP BY run, event),
s AS (SELECT run, event, coalesce(sum(q) FILTER (cable < 1325), 0) AS q17 FROM mh GROUP BY run, event)
SELECT s.run, s.event, s.q17, coalesce(n200, 0) AS n200, ((coalesce(n200, 0) >= 5 AND q17 >= 500) OR q17 >= 10000) AS is_muon
FROM s LEFT JOIN o ON s.run = o.run AND s.event = o.event""")
def muon_selection(spark, sf):
    from ..functions.tracks import is_muon
    mh = H.gain_collapse(views.showers(spark, sf))
    t = H.muon_totals(mh).select("run", "event", "q17").join(H.coincidence(mh), ["run", "event"], "left")
    t = t.withColumn("n200", F.coalesce("n200", F.lit(0)))
    return t.withColumn("is_muon", is_muon(F.col("q17"), F.col("n200")))


@query("occupancy", f"""{views.with_views('trig', 'hits')},
e AS (SELECT run, event FROM (SELECT run, event, row_number() OVER (PARTITION BY run ORDER BY event) AS rn FROM trig
      WHERE trigger & 240 = 0 AND trigger & {K.PHYSICS_BITS} <> 0) WHERE rn <= 100)
SELECT cable, count(*) AS occupancy FROM hits JOIN e USING (run, event) GROUP BY cable""")
def occupancy(spark, sf):
    return H.occupancy(views.hits(spark, sf), views.trig(spark, sf), 100)


@query("dead_sensors", f"""{views.with_views('sensor', 'calib')}
SELECT cable FROM sensor WHERE cable NOT IN (SELECT cable FROM lineitem, LATERAL (SELECT l_partkey % 2126 AS cable))""")
def dead_sensors(spark, sf):
    occ = views.hits(spark, sf).groupBy("cable").agg(F.count(F.lit(1)).alias("occupancy"))
    return H.dead_sensors(G.sensors(spark), occ)


@query("brightest_hits", f"""{views.with_views('showers')}
SELECT run, event, rank, cable, q, round(t, 6) AS t FROM (
  SELECT *, row_number() OVER (PARTITION BY run, event ORDER BY q DESC, cable, t NULLS FIRST) AS rank FROM showers) WHERE rank <= 8""")
def brightest_hits(spark, sf):
    return rounded(H.top_k(views.showers(spark, sf), ["run", "event"], "q", 8, ["cable", "t"])
                   .select("run", "event", F.col("rank").cast("long").alias("rank"), "cable", "q", "t"))


@query("first_events", f"""{views.with_views('trig')} SELECT run, event, ts FROM trig ORDER BY run, ts, event LIMIT 500""")
def first_events(spark, sf):
    return H.head_events(views.trig(spark, sf), 500, ["run", "ts", "event"]).select("run", "event", "ts")


@query("first_events_per_run", f"""{views.with_views('trig')}
SELECT run, event, nhit FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY event) AS rn FROM trig WHERE nhit > 40) WHERE rn <= 50""")
def first_events_per_run(spark, sf):
    return H.head_per(views.trig(spark, sf).where("nhit > 40"), ["run"], ["event"], 50).select("run", "event", "nhit")


@query("sorted_frames", f"""{views.with_views('trig')} SELECT run, event, ts, q17 FROM trig ORDER BY run, ts, event""")
def sorted_frames(spark, sf):
    return H.sort_frames(views.trig(spark, sf), ["event"]).select("run", "event", "ts", "q17")


@query("most_common_cables", f"""{views.with_views('hits')} SELECT cable, count(*) AS n FROM hits GROUP BY cable ORDER BY n DESC, cable""")
def most_common_cables(spark, sf):
    return H.most_common(views.hits(spark, sf), "cable")


@query("masked_nhit", f"""{views.with_views('trig')},
k AS (SELECT run, event FROM trig WHERE q17 >= 20)
SELECT t.run, t.event, CASE WHEN k.event IS NULL THEN 0 ELSE nhit END AS nhit FROM trig t LEFT JOIN k ON t.run = k.run AND t.event = k.event""")
def masked_nhit(spark, sf):
    t = views.trig(spark, sf)
    return H.mask_nhit(t, t.where("q17 >= 20")).select("run", "event", "nhit")


@query("kept_hits", f"""{views.with_views('hits')},
k AS (SELECT run, event FROM hits GROUP BY run, event HAVING count(*) >= 5)
SELECT run, event, cable, round(t, 6) AS t, q FROM hits JOIN k USING (run, event)""")
def kept_hits(spark, sf):
    h = views.hits(spark, sf)
    k = h.groupBy("run", "event").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return rounded(H.keep_events(h, k).select("run", "event", "cable", "t", "q"))


@query("both_detectors", f"""{views.with_views('hits')}
SELECT event, cable, round(t, 6) AS t, CASE WHEN cable < 1879 THEN 'inner' ELSE 'outer' END AS part FROM hits""")
def both_detectors(spark, sf):
    h = views.hits(spark, sf).select("event", "cable", "t", "q")
    inner = h.where("cable < 1879").withColumn("part", F.lit("inner"))
    outer = h.where("cable >= 1879").withColumn("part", F.lit("outer"))
    return rounded(H.union_detectors(inner, outer).drop("q"))


# ---- joins with calibration ----------------------------------------------------------------------------------------
GF = "CASE gain WHEN 0 THEN 1.0 WHEN 1 THEN 4.86 WHEN 2 THEN 41.86 ELSE 1.0 END"


@query("calibrated_hits", f"""{views.with_views('hits', 'calib')}
SELECT h.run, h.event, h.cable, h.atwd, h.gain, round(t * coalesce(bin_ns, 1.49) - atwd_l * 25.0 - coalesce(t0, 0), 9) AS t_ns,
       round(adc / coalesce(q1pe, 200.0) * {GF}, 6) AS q_pe
FROM (SELECT *, gain - 1 AS atwd_l FROM hits) h LEFT JOIN calib c ON h.cable = c.cable AND h.atwd = c.atwd""")
def calibrated_hits(spark, sf):
    h = C.with_calib(views.hits(spark, sf), views.calibration(spark, sf), launch=F.col("gain") - 1)
    return rounded(h.select("run", "event", "cable", "atwd", "gain", "t_ns", "q_pe"), t_ns=9)


@query("calibrated_hits_run_bins", f"""{views.with_views('hits', 'calib')},
rb AS (SELECT run, cable, atwd, 1.5 + avg(q) / 1000 AS run_bin_ns FROM hits GROUP BY run, cable, atwd HAVING count(*) >= 3)
SELECT h.run, h.cable, count(*) AS n, round(sum(t * coalesce(run_bin_ns, bin_ns, 1.49) - coalesce(t0, 0)) + 1.37e-5::DOUBLE, 2) AS t_sum,
       round(sum(q * coalesce(q1pe, 200.0) / {GF}) + 1.37e-5::DOUBLE, 2) AS adc_sum
FROM hits h LEFT JOIN calib c ON h.cable = c.cable AND h.atwd = c.atwd
LEFT JOIN rb ON rb.run = h.run AND rb.cable = h.cable AND rb.atwd = h.atwd GROUP BY h.run, h.cable""")
def calibrated_hits_run_bins(spark, sf):
    h, c = views.hits(spark, sf), views.calibration(spark, sf)
    rb = h.groupBy("run", "cable", "atwd").agg((1.5 + F.avg("q") / 1000).alias("run_bin_ns"), F.count(F.lit(1)).alias("n")).where("n >= 3").drop("n")
    x = C.with_calib(h, c, run_bins=rb).join(c.select("cable", "atwd", "q1pe"), ["cable", "atwd"], "left")
    back = C.charge_adc(F.col("q"), F.coalesce("q1pe", F.lit(K.DEFAULT_Q1PE)), C.gain_factors()[F.col("gain").cast("int")])
    # sums that end on half a cent are moved off it before rounding
    off = lambda c: F.sum(c) + 1.37e-5
    return rounded(x.groupBy("run", "cable").agg(F.count(F.lit(1)).alias("n"), off(F.col("t_ns")).alias("t_sum"), off(back).alias("adc_sum")), 2)


@query("hit_geometry", f"""{views.with_views('hits', 'sensor')}
SELECT CASE WHEN h.cable < 1325 THEN 0 WHEN h.cable < 1879 THEN 1 WHEN h.cable < 2120 THEN 2 ELSE 3 END AS tube_type,
       CAST(floor(pz / 100) AS BIGINT) AS zslab, count(*) AS n, round(avg(sqrt(px * px + py * py)), 6) AS mean_rho, sum(q) AS q
FROM hits h JOIN sensor s ON h.cable = s.cable GROUP BY 1, 2""")
def hit_geometry(spark, sf):
    h = C.with_geometry(views.hits(spark, sf), G.sensors(spark))
    return rounded(h.groupBy(G.tube_type(F.col("cable")).alias("tube_type"), F.floor(F.col("pz") / 100).alias("zslab")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(G.rho(F.col("px"), F.col("py"))).alias("mean_rho"), F.sum("q").alias("q")))


@query("hits_with_runinfo", f"""{views.with_views('runs')}
SELECT l.l_orderkey AS run, r.grade, r.flag, round(r.hours, 6) AS hours, count(*) AS n FROM lineitem l
LEFT JOIN (SELECT * FROM runs WHERE status <> 'P') r ON r.run = l.l_orderkey GROUP BY 1, 2, 3, 4""")
def hits_with_runinfo(spark, sf):
    h = views.hits(spark, sf).groupBy(F.col("event").alias("run")).agg(F.count(F.lit(1)).alias("n"))
    o = views.table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    return rounded(C.with_runinfo(h, views.run_comment(o)).select("run", "grade", "flag", "hours", "n"))


@query("hits_of_good_runs", f"""{views.with_views('runs')}
SELECT l_orderkey AS run, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_orderkey IN (SELECT run FROM runs WHERE grade <= 1) GROUP BY 1""")
def hits_of_good_runs(spark, sf):
    h = C.in_good_runs(views.hits(spark, sf).withColumn("run", F.col("event")), views.runs(spark, sf), 1)
    return h.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"))


# ---- histograms, quantiles, modes ------------------------------------------------------------------------------------
@query("hist1d", f"""{views.with_views('trig')},
b AS (SELECT r.run, g.bin FROM (SELECT DISTINCT run FROM trig) r, (SELECT unnest(range(0, 60)) AS bin) g)
SELECT b.run, b.bin, b.bin * 5.0 AS lo, count(t.event) AS n FROM b LEFT JOIN trig t ON t.run = b.run AND q17 >= 0 AND q17 <= 300
  AND CASE WHEN q17 = 300 THEN 59 ELSE floor(q17 / 5.0) END = b.bin GROUP BY b.run, b.bin""")
def hist1d(spark, sf):
    return B.hist1d(views.trig(spark, sf), ["run"], F.col("q17"), 0.0, 300.0, 5.0)


@query("hist1d_clipped", f"""{views.with_views('trig')},
b AS (SELECT unnest(range(0, 20)) AS bin)
SELECT bin, 20.0 + bin * 10.0 AS lo, count(t.event) AS n FROM b LEFT JOIN trig t
  ON least(floor((greatest(least(q17, 220), 20) - 20) / 10.0), 19) = bin GROUP BY bin""")
def hist1d_clipped(spark, sf):
    return B.hist1d(views.trig(spark, sf), [], F.col("q17"), 20.0, 220.0, 10.0, clip=True)


HE = [0.0, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0]


@query("hist_edges", f"""{views.with_views('trig')},
e(bin, lo, hi) AS (VALUES {', '.join(f'({i}::BIGINT, {a}::DOUBLE, {b}::DOUBLE)' for i, (a, b) in enumerate(zip(HE, HE[1:])))})
SELECT r.run, bin, lo, hi, count(t.event) AS n FROM (SELECT DISTINCT run FROM trig) r CROSS JOIN e
LEFT JOIN trig t ON t.run = r.run AND q17 >= lo AND (q17 < hi OR (bin = 8 AND q17 = hi)) GROUP BY r.run, bin, lo, hi""")
def hist_edges(spark, sf):
    return B.hist_edges(views.trig(spark, sf), ["run"], F.col("q17"), HE)


@query("hist2d", f"""{views.with_views('trig')}
SELECT CAST(floor(q17 / 10) AS BIGINT) AS xbin, CAST(floor(nhit / 5.0) AS BIGINT) AS ybin, count(*) AS n FROM trig
WHERE q17 >= 0 AND q17 < 400 AND nhit >= 0 AND nhit < 150 GROUP BY 1, 2""")
def hist2d(spark, sf):
    return B.hist2d(views.trig(spark, sf), [], F.col("q17"), F.col("nhit"), (0.0, 10.0, 40), (0.0, 5.0, 30))


@query("arrival_quantiles", f"""{views.with_views('trig')}, tm AS (SELECT run, ts / 40.0 / 1e6 AS sec FROM trig), {P.quantiles('q', 'tm', 'run', 'sec', dict(p10=.1, median=.5, p90=.9))}
SELECT run, n, round(p10, 4) AS p10, round(median, 4) AS median, round(p90, 4) AS p90 FROM q""")
def arrival_quantiles(spark, sf):
    """Arrival times of a run in seconds since 1970, which share few relative buckets; a double holds seven digits of a second there."""
    t = views.trig(spark, sf).select("run", (F.col("ts") / 40.0 / 1e6).alias("sec"))
    return rounded(Q.exact_quantiles(t, ["run"], F.col("sec"), {"p10": .1, "median": .5, "p90": .9}), 4)


@query("grouped_quantiles", f"""{views.with_views('hits')}, {P.quantiles('q', 'hits', 'cable', 't', dict(p01=.01, p15=.15, median=.5, p99=.99))}
SELECT cable, n, round(p01, 6) AS p01, round(p15, 6) AS p15, round(median, 6) AS median, round(p99, 6) AS p99 FROM q""")
def grouped_quantiles(spark, sf):
    return rounded(Q.exact_quantiles(views.hits(spark, sf), ["cable"], F.col("t"), {"p01": .01, "p15": .15, "median": .5, "p99": .99}))


@query("robust_sigma", f"""{views.with_views('trig')},
m AS (SELECT run, count(q17) AS n, median(q17) AS median FROM trig GROUP BY run)
SELECT t.run, m.n, round(m.median, 6) AS median, round(1.4826 * median(abs(q17 - m.median)), 6) AS sigma FROM trig t JOIN m ON t.run = m.run GROUP BY t.run, m.n, m.median""")
def robust_sigma(spark, sf):
    return rounded(Q.robust_sigma(views.trig(spark, sf), ["run"], F.col("q17")))


@query("robust_sigma_all", """
WITH m AS (SELECT count(t) AS n, median(t) AS median FROM (SELECT l_extendedprice / 100 AS t FROM lineitem))
SELECT m.n, round(m.median, 6) AS median, round(1.4826 * median(abs(l_extendedprice / 100 - m.median)), 6) AS sigma FROM lineitem, m GROUP BY m.n, m.median""")
def robust_sigma_all(spark, sf):
    li = views.table(spark, sf, "lineitem")
    return rounded(Q.robust_sigma(li, [], F.col("l_extendedprice") / 100))


@query("group_mode", f"""{views.with_views('hits')}, {P.mode('m', 'hits', 'cable', 't', 20.0, 5, 10)}
SELECT cable, n, round(mode, 6) AS mode FROM m""")
def group_mode(spark, sf):
    return rounded(B.grouped_mode(views.hits(spark, sf), ["cable"], F.col("t"), 20.0, 5, 10))


def source_peak_sql(x: str) -> str:
    """CTEs up to ``p`` (run, peak) for the column ``x`` of ``trig``."""
    return f"""x AS (SELECT run, CAST({x} AS DOUBLE) AS x FROM trig WHERE {x} > 0),
e AS (SELECT run, 0 AS a, ceil((max(x) + 20) / 10) - 1 AS nb FROM x GROUP BY run),
c AS (SELECT run, floor(x / 10) AS k, count(*) AS c FROM x GROUP BY 1, 2),
z AS (SELECT e.run, e.nb, g.k, coalesce(c.c, 0) AS c FROM e, LATERAL (SELECT unnest(generate_series(0, CAST(e.nb AS BIGINT) - 1)) AS k) g LEFT JOIN c ON c.run = e.run AND c.k = g.k),
s AS (SELECT *, sum(c) OVER (PARTITION BY run ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS y1 FROM z),
n AS (SELECT *, lag(y1) OVER (PARTITION BY run ORDER BY k) AS y0, lead(y1) OVER (PARTITION BY run ORDER BY k) AS y2, max(y1) OVER (PARTITION BY run) AS top FROM s),
pk AS (SELECT * FROM n WHERE y0 IS NOT NULL AND y2 IS NOT NULL AND y1 >= 0.1 * top AND y1 >= y0 AND y1 > y2 QUALIFY row_number() OVER (PARTITION BY run ORDER BY k DESC) = 1),
p AS (SELECT run, 10 * (k + 0.5::DOUBLE + {P.SHIFT}) AS peak FROM pk)"""


@query("source_peak", f"""{views.with_views('trig')}, {source_peak_sql('q17')}
SELECT run, round(peak, 6) AS peak, CAST(trunc(0.8::DOUBLE * peak) AS BIGINT) AS nhit_min, CAST(trunc(1.2::DOUBLE * peak) AS BIGINT) AS nhit_max FROM p""")
def source_peak(spark, sf):
    return rounded(B.source_peak(views.trig(spark, sf), ["run"], F.col("q17")))


BINS_SQL = f"""{views.with_views('trig')}, h AS (SELECT CAST(floor(q17 / 2.0) AS BIGINT) AS bin, count(*) AS c FROM trig WHERE q17 >= 0 AND q17 < 300 GROUP BY 1),
z AS (SELECT bin, coalesce(c, 0) AS n FROM (SELECT unnest(range(0, 150)) AS bin) LEFT JOIN h USING (bin))"""
_KERNEL = B.gauss_kernel(2.0)


@query("bin_operators", BINS_SQL + f""",
a AS (SELECT bin, n, sum(n) OVER (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0 AS avg5,
  {' + '.join(f"{k!r}::DOUBLE * coalesce({'lag' if s > 0 else 'lead'}(n, {abs(s)}) OVER (ORDER BY bin), 0)" if s else f'{k!r}::DOUBLE * n' for s, k in zip(range(-(len(_KERNEL) // 2), len(_KERNEL) // 2 + 1), _KERNEL))} AS gauss,
  lag(n) OVER (ORDER BY bin) AS dn, lead(n) OVER (ORDER BY bin) AS up FROM z)
SELECT bin, n, round(avg5, 6) AS avg5, round(gauss, 6) AS gauss,
  round(CASE WHEN dn IS NULL THEN (up - n) / 2.0 WHEN up IS NULL THEN (n - dn) / 2.0 ELSE (up - dn) / 4.0 END, 6) AS slope,
  coalesce(n >= dn AND n > up, FALSE) AS is_peak,
  round(CASE WHEN dn IS NULL OR up IS NULL OR dn - 2 * n + up = 0 THEN 0 ELSE 0.5 * (dn - up) / (dn - 2 * n + up) END, 6) AS shift FROM a""")
def bin_operators(spark, sf):
    h = B.hist1d(views.trig(spark, sf).withColumn("g", F.lit(0)).where("q17 < 300"), ["g"], F.col("q17"), 0.0, 300.0, 2.0)
    h = B.moving_sum(h, ["g"], "bin", "n", 2, "avg5", 0.2)
    h = B.gauss_smooth(h, ["g"], "bin", "n", 2.0, "gauss")
    h = B.gradient(h, ["g"], "bin", "n", 2.0)
    h = B.parabolic(B.local_maxima(h, ["g"], "bin", "n"), ["g"], "bin", "n")
    return rounded(h.select("bin", "n", "avg5", "gauss", "slope", "is_peak", "shift"))


# ---- channel constants --------------------------------------------------------------------------------------------
BASE = f"{views.with_views('showers', 'sensor')}, {P.primary('prim', 'showers')}"


@query("event_time", f"""{BASE}, {P.residuals('r', 'prim')} SELECT run, event, round(t_event, 6) AS t_event FROM r_t""")
def event_time(spark, sf):
    tau = C.time_of_flight_corrected(primary_showers(spark, sf), G.sensors(spark), (0.0, 0.0, 0.0), V)
    return rounded(C.event_time(tau))


@query("residuals", f"""{BASE}, {P.residuals('r', 'prim')} SELECT run, event, cable, atwd, round(res, 9) AS res, q FROM r""")
def residuals(spark, sf):
    return rounded(C.residuals_fixed_vertex(primary_showers(spark, sf), G.sensors(spark), (0.0, 0.0, 0.0), V)
                   .select("run", "event", "cable", "atwd", "res", "q"), 9)


def _t0_sql(stat):
    def one(i, src):
        m = P.mode(f"m{i}", f"r{i}", "cable, atwd", "res", 0.5, 5, MIN_CHANNEL) if stat == "mode" else \
            f"m{i} AS (SELECT * FROM (SELECT cable, atwd, count(*) AS n, median(res) AS mode FROM r{i} GROUP BY cable, atwd) WHERE n >= {MIN_CHANNEL})"
        return f"""{P.residuals(f'r{i}', src)}, {m},
t{i} AS (SELECT cable, atwd, n, CASE WHEN mode <> 0 THEN mode - (SELECT avg(mode) FROM m{i} WHERE mode <> 0) ELSE mode END AS t0 FROM m{i})"""
    return f"""{BASE}, {one(1, 'prim')},
moved AS (SELECT p.* REPLACE (p.t - coalesce(t1.t0, 0) AS t) FROM prim p LEFT JOIN t1 ON p.cable = t1.cable AND p.atwd = t1.atwd),
{one(2, 'moved')}
SELECT cable, atwd, coalesce(t2.n, t1.n) AS n, round(coalesce(t1.t0, 0) + coalesce(t2.t0, 0), 6) AS t0 FROM t1 FULL JOIN t2 USING (cable, atwd)"""


@query("t0_calib", _t0_sql("mode"))
def t0_calib(spark, sf):
    return rounded(C.t0_fixed_vertex(primary_showers(spark, sf), G.sensors(spark), V, min_hits=MIN_CHANNEL))


@query("t0_calib_median", _t0_sql("median"))
def t0_calib_median(spark, sf):
    return rounded(C.t0_fixed_vertex(primary_showers(spark, sf), G.sensors(spark), V, min_hits=MIN_CHANNEL, statistic="median"))


@query("t0_from_run", f"""{BASE}, {P.tau_center('tau', 'prim', 16.95, 0.0)},
{P.event_time('t', 'tau', 'run, event', window=15.0, tails=(0.01, 0.99), passes=1)},
r AS (SELECT h.cable, h.atwd, h.tau - t.t_event AS res FROM tau h JOIN t ON h.run = t.run AND h.event = t.event WHERE abs(h.tau - t.t_event) <= 15),
m AS (SELECT cable, atwd, count(*) AS n, median(res) AS t0 FROM r GROUP BY cable, atwd HAVING count(*) >= 2)
SELECT cable, atwd, n, round(CASE WHEN t0 <> 0 THEN t0 - (SELECT avg(t0) FROM m WHERE t0 <> 0) ELSE t0 END, 6) AS t0 FROM m""")
def t0_from_run(spark, sf):
    return rounded(C.t0_from_run(primary_showers(spark, sf), G.sensors(spark), (0.0, 0.0, 0.0), min_hits=2))


@query("q0_calib", f"""{BASE}, s AS (SELECT * FROM prim WHERE cable < 1879 AND adc > 30 AND adc < 800),
{P.mode('m', 's', 'cable, atwd', 'adc', 10.0, 5, MIN_CHANNEL)}
SELECT cable, atwd, n, round(mode, 6) AS q0, round(CASE WHEN mode > 80 AND mode < 500 THEN mode END, 6) AS q1pe FROM m""")
def q0_calib(spark, sf):
    return rounded(C.q0_per_channel(primary_showers(spark, sf), MIN_CHANNEL))


@query("q1pe_calib", f"""{BASE}, s AS (SELECT * FROM showers WHERE cable < 1879 AND gain = 0 AND adc > 30 AND adc < 800),
{P.mode('m', 's', 'cable, atwd', 'adc', 10.0, 5, 5, (30.0, 800.0))} SELECT cable, atwd, n, round(mode, 6) AS q1pe FROM m""")
def q1pe_calib(spark, sf):
    return rounded(C.q1pe_per_channel(views.showers(spark, sf), 5))


@query("light_yield", f"""{BASE}, {P.residuals('r', 'prim', min_q=0.0)},
ne AS (SELECT count(*) AS n FROM (SELECT DISTINCT run, event FROM r)),
h AS (SELECT cable, count(*) FILTER (res BETWEEN -15 AND 85) AS n_hit, count(*) FILTER (res BETWEEN -200 AND -40) AS n_dark,
  coalesce(sum(q) FILTER (res BETWEEN -15 AND 85), 0) AS q_sum FROM r GROUP BY cable),
s AS (SELECT i.cable, coalesce(n_hit, 0) AS n_hit, coalesce(n_dark, 0) AS n_dark, coalesce(q_sum, 0) AS q_sum
  FROM (SELECT unnest(range(1879)) AS cable) i LEFT JOIN h ON h.cable = i.cable),
d AS (SELECT s.*, n AS n_events, n_dark / n * (100.0 / 160.0) AS dark, -ln(1 - least(n_hit / n, 0.999)) AS mu FROM s, ne)
SELECT cable, n_events, n_hit, n_dark, round(dark, 6) AS dark, round(mu, 6) AS mu,
  round(CASE WHEN n_hit > 0 THEN greatest(mu - dark, 0) / 2.506 ELSE 0 END, 6) AS eta,
  round(CASE WHEN n_hit > 0 THEN greatest((q_sum / n_events - dark * q_sum / n_hit) / 2.506, 0) ELSE 0 END, 6) AS eta_q, n_hit = 0 AS bad FROM d WHERE n_events >= 20""")
def light_yield(spark, sf):
    r = C.residuals_fixed_vertex(primary_showers(spark, sf), G.sensors(spark), (0.0, 0.0, 0.0), V, min_q=0.0)
    return rounded(C.light_yield(r, G.sensors(spark), min_events=20))
