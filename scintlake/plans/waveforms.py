"""Queries on waveforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import waves as W
from ..operators import calib as C
from ..operators import scan as S
from ..operators import waves as O
from .registry import query, rounded

LONG = f"""{views.with_views('waves')},
u AS (SELECT wf_id, cable, atwd, gain, launch, i, samples[i + 1] AS w, len(samples) AS n
      FROM waves, LATERAL (SELECT unnest(range(0, len(samples))) AS i))"""
SMOOTH_SQL = LONG + """,
d AS (SELECT *, CASE WHEN i = 0 OR i = n - 2 THEN lead(w, 1) OVER v - w WHEN i = 1 OR i = n - 3 THEN (lead(w, 2) OVER v - lag(w, 1) OVER v) / 3
                WHEN i <= n - 4 THEN (lead(w, 3) OVER v - lag(w, 2) OVER v) / 5 END AS d
      FROM u WINDOW v AS (PARTITION BY wf_id ORDER BY i)),
r AS (SELECT *, first(w) OVER (PARTITION BY wf_id ORDER BY i) + coalesce(sum(d) OVER (PARTITION BY wf_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y0 FROM d),
sm AS (SELECT *, y0 + (sum(w) OVER (PARTITION BY wf_id) - sum(y0) OVER (PARTITION BY wf_id)) / n AS y FROM r)"""


@query("wave_smooth", SMOOTH_SQL + " SELECT wf_id, i, round(y, 6) AS y FROM sm")
def wave_smooth(spark, sf):
    d = W.smooth(views.waves(spark, sf))
    return rounded(d.select("wf_id", F.posexplode("smoothed").alias("i", "y")).withColumn("i", F.col("i").cast("long")))


@query("pulses", SMOOTH_SQL + """,
isl AS (SELECT *, sum(CASE WHEN y > 0 AND NOT coalesce(py > 0, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY wf_id ORDER BY i) AS g
        FROM (SELECT *, lag(y) OVER (PARTITION BY wf_id ORDER BY i) AS py FROM sm)),
reg AS (SELECT wf_id, g, min(i) AS s, max(i) AS e, sum(y) AS area, max(y) AS mx, arg_max(i, y) AS pk FROM isl WHERE y > 0 GROUP BY wf_id, g HAVING max(y) >= 5),
kept AS (SELECT * FROM (SELECT *, sum(area) OVER (PARTITION BY wf_id) AS tot FROM reg) WHERE area >= 0.15 * tot),
agg AS (SELECT wf_id, count(*) AS npulse, sum(area) AS q_total, arg_min(area, s) AS q_first, arg_min(mx, s) AS height, max(mx) AS height_max,
          min(s) AS s, arg_min(pk, s) AS pk FROM kept GROUP BY wf_id),
c AS (SELECT a.wf_id, min(m.i) AS k FROM agg a JOIN sm m ON m.wf_id = a.wf_id AND m.i BETWEEN a.s AND a.pk AND m.y >= 0.5 * a.height GROUP BY a.wf_id),
z AS (SELECT a.*, c.k, w.saturated, w.n,
   (SELECT y FROM sm m WHERE m.wf_id = a.wf_id AND m.i = greatest(a.pk - 1, 0)) AS y0, (SELECT y FROM sm m WHERE m.wf_id = a.wf_id AND m.i = a.pk) AS y1,
   (SELECT y FROM sm m WHERE m.wf_id = a.wf_id AND m.i = least(a.pk + 1, w.n - 1)) AS y2,
   (SELECT y FROM sm m WHERE m.wf_id = a.wf_id AND m.i = greatest(c.k - 1, 0)) AS ya, (SELECT y FROM sm m WHERE m.wf_id = a.wf_id AND m.i = c.k) AS yb
   FROM agg a JOIN c ON c.wf_id = a.wf_id JOIN (SELECT wf_id, max(n) AS n, max(w) >= 1023 AS saturated FROM u GROUP BY wf_id) w ON w.wf_id = a.wf_id)
SELECT v.wf_id, z.wf_id IS NOT NULL AS found, CAST(coalesce(npulse, 0) AS INTEGER) AS npulse, round(coalesce(q_total, 0), 6) AS q_total, round(coalesce(q_first, 0), 6) AS q_first,
  round(coalesce(height, 0), 6) AS height, round(coalesce(height_max, 0), 6) AS height_max, CAST(s AS DOUBLE) AS t_lead,
  round(CASE WHEN k > s THEN k - 1 + CASE WHEN yb - ya > 1e-9 THEN least(greatest((0.5 * height - ya) / (yb - ya), 0), 1) ELSE 0 END ELSE k END, 6) AS t_cfd,
  round(pk + CASE WHEN abs(y0 - 2 * y1 + y2) > 1e-9 THEN least(greatest(0.5 * (y0 - y2) / (y0 - 2 * y1 + y2), -1), 1) ELSE 0 END, 6) AS t_peak,
  coalesce(saturated, FALSE) AS saturated
FROM waves v LEFT JOIN z ON z.wf_id = v.wf_id""")
def pulses(spark, sf):
    return rounded(W.pulses(views.waves(spark, sf)).select(
        "wf_id", "found", "npulse", "q_total", "q_first", "height", "height_max", "t_lead", "t_cfd", "t_peak", "saturated"))


@query("baseline", LONG + """,
d AS (SELECT *, CASE WHEN i = 0 OR i = n - 2 THEN lead(w) OVER v - w WHEN i = 1 OR i = n - 3 THEN (lead(w, 2) OVER v - lag(w) OVER v) / 3
                WHEN i = 2 OR i = n - 4 THEN (lead(w, 3) OVER v - lag(w, 2) OVER v) / 5 WHEN i <= n - 5 THEN (lead(w, 4) OVER v - lag(w, 3) OVER v) / 7 END AS d,
        (lag(w) OVER v + w + lead(w) OVER v) / 3 AS ra FROM u WINDOW v AS (PARTITION BY wf_id ORDER BY i)),
m AS (SELECT *, min(ra) OVER (PARTITION BY wf_id) AS lo, max(ra) OVER (PARTITION BY wf_id) - min(ra) OVER (PARTITION BY wf_id) AS rng FROM d),
g AS (SELECT *, w <= greatest(rng * 0.05, 10) + lo AND (d IS NULL OR abs(d) <= rng * CASE WHEN i < 10 THEN 0.01 ELSE 0.001 END) AS good FROM m)
SELECT wf_id, round(CASE WHEN count(*) FILTER (good) > 0 THEN avg(w) FILTER (good) WHEN sum(w) < 0 THEN sum(w) / max(n)
  WHEN max(lo) > 0 THEN max(lo) ELSE 0 END, 6) AS baseline FROM g GROUP BY wf_id""")
def baseline(spark, sf):
    return rounded(W.baseline(views.waves(spark, sf)).select("wf_id", "baseline"))


# a quarter of the amplitude, so that part of the waveforms pass the flatness cuts
ADC = "[round(v / 2) for v in samples]"
PED = f"""{views.with_views('waves')}, wi AS (SELECT wf_id, cable, atwd, gain, launch, {ADC} AS s FROM waves WHERE gain < 3 AND abs(launch) <= 1),
f AS (SELECT *, list_max(s) - list_min(s) < 50 AND list_max([abs(s[i + 1] - s[i]) for i in range(1, len(s))]) <= 40 AS flat FROM wi)"""


def adc_waves(spark, sf, read=views.table):
    return views.waves(spark, sf, read).withColumn("samples", F.transform("samples", lambda v: F.round(v / 2)))


@query("pedestal_mean", PED + """
SELECT cable, atwd, gain, CAST(i AS INTEGER) AS sample, count(*) AS n, round(avg(s[i + 1]), 6) AS mean,
       CASE WHEN count(*) >= 2 THEN round(stddev_pop(s[i + 1]), 6) END AS rms
FROM f, LATERAL (SELECT unnest(range(0, len(s))) AS i) WHERE flat GROUP BY cable, atwd, gain, i""")
def pedestal_mean(spark, sf):
    return rounded(O.pedestal_mean(adc_waves(spark, sf)))


@query("pedestal_counts", PED + " SELECT cable, atwd, gain, count(*) FILTER (flat) AS n, count(*) FILTER (NOT flat) AS n_rejected FROM f GROUP BY ALL")
def pedestal_counts(spark, sf):
    return O.pedestal_counts(adc_waves(spark, sf))


@query("pedestal_lookup", PED + f""",
mean AS (SELECT cable, atwd, gain, i, avg(s[i + 1]) AS m FROM f, LATERAL (SELECT unnest(range(0, len(s))) AS i) WHERE flat GROUP BY ALL),
fb AS (SELECT DISTINCT p_partkey % 4800 AS row, CAST(p_partkey % 4800 % 7 AS DOUBLE) AS level FROM part),
al AS (SELECT wf_id, cable, atwd, gain, {ADC} AS s, CASE WHEN cable < 9 THEN ((((cable % 10) * 20 + cable) * 12 + cable % 12) * 2 + atwd) * 4 + gain END AS row FROM waves),
x AS (SELECT al.wf_id, i, s[i + 1] AS v, m, level FROM al CROSS JOIN LATERAL (SELECT unnest(range(0, len(s))) AS i)
  LEFT JOIN mean USING (cable, atwd, gain, i) LEFT JOIN fb ON fb.row = al.row)
SELECT wf_id, CASE WHEN bool_or(m IS NOT NULL) THEN 'measured' WHEN bool_or(level IS NOT NULL) THEN 'table' ELSE 'zero' END AS pedestal_source,
       round(sum(v - coalesce(m, level, 0)), 6) AS area FROM x GROUP BY wf_id""")
def pedestal_lookup(spark, sf):
    w = adc_waves(spark, sf)
    row = F.col("p_partkey") % 4800
    fallback = views.table(spark, sf, "part").select(row.alias("row")).distinct().withColumn(
        "fallback", F.array_repeat((F.col("row") % 7).cast("double"), 64))
    cables = w.select("cable").distinct().where("cable < 9").select(
        "cable", (F.col("cable") % 10 + 1).alias("crate"), (F.col("cable") + 2).alias("slot"), (F.col("cable") % 12).alias("channel"))
    p = C.with_pedestal(w, O.pedestal_arrays(O.pedestal_mean(w)), fallback, cables)
    return rounded(p.select("wf_id", "pedestal_source", W.total(W.subtract_pedestal(F.col("samples"), F.col("pedestal"))).alias("area")))


@query("saturated_charge", LONG + """
SELECT wf_id, max(w) >= 30 AS saturated, round(sum(CASE WHEN w >= 30 THEN 0 ELSE w END), 6) AS charge FROM u GROUP BY wf_id""")
def saturated_charge(spark, sf):
    # scaled so that the ceiling of the digitiser is reached by part of the waveforms
    w = views.waves(spark, sf).withColumn("raw", F.transform("samples", lambda v: v + (W.SATURATED - 30)))
    return rounded(w.select("wf_id", W.is_saturated(F.col("raw")).alias("saturated"),
                            W.total(W.zero_saturated(F.col("samples"), F.col("raw"))).alias("charge")))


@query("clock_period", LONG + """,
c AS (SELECT *, w - avg(w) OVER (PARTITION BY wf_id) AS v, stddev_pop(w) OVER (PARTITION BY wf_id) AS sd FROM u WHERE gain = 3),
f AS (SELECT wf_id, cable, atwd, k, sd, sum(v * cos(2 * pi() * k * i / 1024)) ** 2 + sum(v * sin(2 * pi() * k * i / 1024)) ** 2 AS p
      FROM c, (SELECT unnest(range(42, 87)) AS k) GROUP BY ALL),
n AS (SELECT *, lag(p) OVER (PARTITION BY wf_id ORDER BY k) AS y0, lead(p) OVER (PARTITION BY wf_id ORDER BY k) AS y2 FROM f),
b AS (SELECT * FROM n WHERE k BETWEEN 43 AND 85 QUALIFY row_number() OVER (PARTITION BY wf_id ORDER BY p DESC, k) = 1),
q AS (SELECT cable, atwd, CASE WHEN sd >= 5 THEN 1024 / (k + least(greatest(0.5 * (y0 - y2) / (y0 - 2 * p + y2), -0.5), 0.5)) END AS p FROM b)
SELECT cable, atwd, count(p) AS n, round(avg(p), 6) AS period, round(coalesce(25.0 / avg(p), 1.49), 6) AS bin_ns FROM q GROUP BY cable, atwd""")
def clock_period(spark, sf):
    return rounded(O.sampling_period(views.waves(spark, sf)))


def long_samples(spark, sf):
    return views.waves(spark, sf).select("wf_id", F.posexplode("samples").alias("i", "w")).withColumn("i", F.col("i").cast("long"))


@query("wave_cumsum", LONG + " SELECT wf_id, i, round(sum(w) OVER (PARTITION BY wf_id ORDER BY i), 6) AS cumsum FROM u")
def wave_cumsum(spark, sf):
    return rounded(S.running_sum(long_samples(spark, sf), ["wf_id"], "i", "w").select("wf_id", "i", "cumsum"))


@query("wave_islands", LONG + """,
g AS (SELECT wf_id, i, w, i - row_number() OVER (PARTITION BY wf_id ORDER BY i) AS g FROM u WHERE w > 0),
o AS (SELECT wf_id, min(i) AS "start", max(i) AS "end", round(sum(w), 6) AS area FROM g GROUP BY wf_id, g)
SELECT *, row_number() OVER (PARTITION BY wf_id ORDER BY "start") AS island FROM o""")
def wave_islands(spark, sf):
    """Stretches of positive samples, numbered within their waveform."""
    d = S.islands(long_samples(spark, sf), ["wf_id"], "i", F.col("w") > 0).where("island is not null")
    return rounded(d.groupBy("wf_id", "island").agg(F.min("i").alias("start"), F.max("i").alias("end"), F.sum("w").alias("area")))
