"""Queries: trigger census, previous-muon tagging, follow-ups and their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import constants as K
from ..functions import tracks
from ..functions import trigger as T
from ..operators import correlate as C
from ..operators import hits as H
from ..operators import scan as S
from ..session import stage
from .registry import query, rounded

HOUR = 3600 * 40_000_000                     # ticks
DEAD, WINDOW = 3 * HOUR, 12 * HOUR
SOFT, HARD = 113.0, 224.0
MIN_MULT = 20
EDGES_H = [0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 12.0]


def tagged(spark, sf):
    return C.tag_previous(views.trig(spark, sf), F.col("q17") >= SOFT, F.col("q17") >= HARD, DEAD)


#: blocks of a day, so that tags, tracks and dead times are carried over many block borders
BLOCK = 24 * HOUR
ID_HITS = 50


def framed(spark, sf, width=BLOCK):
    """Located events with the last real tag before them and its track."""
    e = views.trig_frame(spark, sf)
    hard = F.col("q17") >= HARD
    entrance, leave = (tuple(F.col(k + c) for c in "xyz") for k in "ex")
    valid = F.col("converged") & ~C.od_only(F.col("is_tag"), hard, F.col("nhit"), ID_HITS)
    return C.tag_previous(e, F.col("q17") >= SOFT, hard, DEAD, width, C.track_payload(entrance, leave, valid))


# ---- SQL of the same rule: successor of each tag, then the orbit of the first tag of a run ----------------------
TAGGED_SQL = f"""{views.with_views('trig').replace('WITH ', 'WITH RECURSIVE ', 1)},
tags AS (SELECT run, event, ts, q17 FROM trig WHERE q17 >= {SOFT}),
hards AS (SELECT run, ts FROM tags WHERE q17 >= {HARD}),
succ AS (
  SELECT t.run, t.event, t.ts,
         least(coalesce((SELECT min(n.ts) FROM tags n WHERE n.run = t.run AND n.ts >= t.ts + {DEAD}), 9e18::BIGINT),
               coalesce((SELECT min(h.ts) FROM hards h WHERE h.run = t.run AND h.ts > t.ts), 9e18::BIGINT)) AS next_ts
  FROM tags t),
realt AS (
  SELECT run, event, ts, next_ts FROM succ WHERE (run, ts) IN (SELECT (run, min(ts)) FROM tags GROUP BY run)
  UNION ALL
  SELECT s.run, s.event, s.ts, s.next_ts FROM realt r JOIN succ s ON s.run = r.run AND s.ts = r.next_ts),
tagged AS (
  SELECT e.*, e.q17 >= {SOFT} AS is_tag, r.ts AS prev_ts, coalesce(r.event, -1) AS prev_event, e.ts - r.ts AS dt,
         coalesce(e.q17 >= {SOFT} AND e.q17 < {HARD} AND e.ts - r.ts < {DEAD}, FALSE) AS retrigger
  FROM trig e ASOF LEFT JOIN realt r ON e.run = r.run AND e.ts > r.ts)
"""


FRAMED_SQL = TAGGED_SQL.replace(views.VIEW_SQL["trig"], views.VIEW_SQL["trig"] + ",\n" + views.VIEW_SQL["frame"], 1) + f""",
far AS (
  SELECT f.*, t.is_tag, t.retrigger, t.prev_event, t.dt, p.ex AS pex, p.ey AS pey, p.ez AS pez, p.xx - p.ex AS dx, p.xy - p.ey AS dy, p.xz - p.ez AS dz,
         sqrt(pow(p.xx - p.ex, 2) + pow(p.xy - p.ey, 2) + pow(p.xz - p.ez, 2)) AS len,
         p.converged AND NOT (p.q17 < {HARD} AND p.nhit < {ID_HITS}) AS has_track
  FROM frame f JOIN tagged t ON t.run = f.run AND t.event = f.event LEFT JOIN frame p ON p.run = t.run AND p.event = t.prev_event),
dist AS (
  SELECT *, is_tag AND q17 < {HARD} AND nhit < {ID_HITS} AS od_only,
         CASE WHEN NOT is_tag AND vertex_ok AND has_track THEN sqrt(greatest(pow(x - pex, 2) + pow(y - pey, 2) + pow(z - pez, 2)
              - pow(((x - pex) * dx + (y - pey) * dy + (z - pez) * dz) / len, 2), 0)) END AS dist_track FROM far)
"""


@query("dist_track", FRAMED_SQL + "SELECT run, event, is_tag, retrigger, od_only, prev_event, dt, round(dist_track, 6) AS dist_track FROM dist")
def dist_track(spark, sf):
    t = framed(spark, sf)
    hard = F.col("q17") >= HARD
    d = C.track_distance(tuple(F.col(c) for c in "xyz"), F.col("vertex_ok") & ~F.col("is_tag"), F.col("prev_track"))
    return rounded(t.select("run", "event", "is_tag", "retrigger", C.od_only(F.col("is_tag"), hard, F.col("nhit"), ID_HITS).alias("od_only"),
                            "prev_event", "dt", d.alias("dist_track")))


#: fiducial radius (cm), energies and times since the tag of capture candidates
R_MAX, ENERGIES, TIMES, BRIGHT = 600.0, (18.0, 60.0), (HOUR // 2, WINDOW), 300.0


@query("parent_yields", FRAMED_SQL + f""",
geo AS (SELECT *, sqrt(greatest(ex * ex + ey * ey + ez * ez - pow((ex * (xx - ex) + ey * (xy - ey) + ez * (xz - ez)) / sqrt(pow(xx - ex, 2) + pow(xy - ey, 2) + pow(xz - ez, 2)), 2), 0)) < 650 AS ls FROM dist),
par AS (SELECT run, event, q17, converged, ls FROM geo WHERE is_tag AND NOT retrigger),
k(parent) AS (VALUES ('all'), ('ls'), ('id')),
sel AS (SELECT run, prev_event FROM geo WHERE NOT is_tag AND vertex_ok AND sqrt(x * x + y * y + z * z) < {R_MAX} AND q17 BETWEEN {ENERGIES[0]} AND {ENERGIES[1]} AND dt BETWEEN {TIMES[0]} AND {TIMES[1]}),
pk AS (SELECT * FROM par, k WHERE parent = 'all' OR (parent = 'ls' AND converged AND ls) OR (parent = 'id' AND (q17 >= {BRIGHT} OR converged)))
SELECT pk.run, pk.parent, count(DISTINCT pk.event) AS n_parent, count(sel.run) AS n_selected, round(count(sel.run) / count(DISTINCT pk.event), 9) AS per_parent
FROM pk LEFT JOIN sel ON sel.run = pk.run AND sel.prev_event = pk.event GROUP BY pk.run, pk.parent""")
def parent_yields(spark, sf):
    t = stage(framed(spark, sf), "framed")
    e, x = (tuple(F.col(k + c) for c in "xyz") for k in "ex")
    u, _ = tracks.direction(e, x)
    parents = t.where("is_tag and not retrigger").withColumn("l_ls", tracks.light_paths(tracks.impact(e, u))[0])
    cands = C.with_parent(t.where("not is_tag").select("run", "event", "prev_event", "x", "y", "z", "vertex_ok", "q17", "dt"), parents, ["q17", "converged", "l_ls"])
    sel = C.captures(F.col("vertex_ok"), F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2), F.col("q17"), F.col("dt"), R_MAX, ENERGIES, TIMES)
    return rounded(C.parent_yields(cands, parents, sel, bright=BRIGHT), 9)


@query("trigger_census", f"""{views.with_views('trig')},
flags(pos, bit, name) AS (VALUES {', '.join(f"({i}, {b}::BIGINT, '{n}')" for i, (b, n) in enumerate(K.FLAG_NAMES))}),
acqs(acq, name) AS (VALUES {', '.join(f"({a}::BIGINT, '{n}')" for a, n in K.ACQ_NAMES.items())}),
g AS (SELECT trigger, count(*) AS n, avg(coalesce(nhit, 0)) AS mean_nhit, max(coalesce(nhit, 0)) AS max_nhit FROM trig GROUP BY trigger),
parts AS (
  SELECT trigger, pos, name FROM g, flags WHERE trigger & bit <> 0
  UNION ALL SELECT trigger, 100, coalesce(name, concat('Acq0x', lower(to_hex(trigger & 240)))) FROM g LEFT JOIN acqs ON acq = trigger & 240 WHERE trigger & 240 <> 0
  UNION ALL SELECT trigger, 101, concat('CalibSource0x', lower(to_hex(trigger & 61440))) FROM g WHERE trigger & 61440 <> 0),
names AS (SELECT trigger, string_agg(name, '|' ORDER BY pos) AS names FROM parts GROUP BY trigger)
SELECT trigger, coalesce(names, 'none') AS names, (trigger & 240 = 0 AND trigger & {K.PHYSICS_BITS} <> 0) AS physics, n,
       round(mean_nhit, 6) AS mean_nhit, max_nhit FROM g LEFT JOIN names USING (trigger)""")
def trigger_census(spark, sf):
    return rounded(H.trigger_census(views.trig(spark, sf)))


@query("trigger_classes", f"""{views.with_views('trig')}
SELECT run, count(*) FILTER (trigger & 240 IN (112, 128)) AS pedestal, count(*) FILTER (trigger & 240 IN (16, 32)) AS forced,
       count(*) FILTER (trigger & 240 IN (48, 64)) AS clock, count(*) FILTER (trigger & 240 IN (80, 96, 144, 160, 176)) AS test_pulse,
       count(*) FILTER (trigger & 240 = 0 AND trigger & {K.PHYSICS_BITS} <> 0) AS physics
FROM trig GROUP BY run""")
def trigger_classes(spark, sf):
    t, w = views.trig(spark, sf), F.col("trigger")
    return t.groupBy("run").agg(
        F.count_if(T.is_pedestal(w)).alias("pedestal"), F.count_if(T.is_forced(w)).alias("forced"),
        F.count_if(T.is_clock(w)).alias("clock"), F.count_if(T.is_test_pulse(w)).alias("test_pulse"),
        F.count_if(T.is_physics(w)).alias("physics"))


@query("run_wall_time", f"""{views.with_views('trig')}
SELECT run, round((max(ts) - min(ts)) * 0.025 / 1e6, 6) AS wall_s, count(*) AS n FROM trig GROUP BY run""")
def run_wall_time(spark, sf):
    return rounded(H.run_wall_time(views.trig(spark, sf), F.col("ts")).withColumn("wall_s", T.ticks_to_us(F.col("wall_s")) / 1e6))


@query("dt_prev", f"""{views.with_views('trig')}
SELECT run, event, ts, ts - lag(ts) OVER (PARTITION BY run ORDER BY ts, event) AS dt_prev FROM trig""")
def dt_prev(spark, sf):
    return C.dt_prev(views.trig(spark, sf)).select("run", "event", "ts", "dt_prev")


@query("hard_segments", f"""{views.with_views('trig')}
SELECT run, event, CAST(sum(CASE WHEN q17 >= {HARD} THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY ts, event) AS BIGINT) AS segment FROM trig""")
def hard_segments(spark, sf):
    t = views.trig(spark, sf)
    return S.hard_segments(t, ["run"], ["ts", "event"], F.col("q17") >= HARD, S.time_blocks(t, ["run"], "ts")).select("run", "event", "segment")


@query("prev_muon_asof", TAGGED_SQL + "SELECT run, event, is_tag, retrigger, prev_event, dt FROM tagged")
def prev_muon_asof(spark, sf):
    return tagged(spark, sf).select("run", "event", "is_tag", "retrigger", "prev_event", "dt")


@query("followups", TAGGED_SQL + f"SELECT run, event, prev_event, dt, nhit FROM tagged WHERE NOT is_tag AND dt <= {WINDOW} AND nhit >= {MIN_MULT}")
def followups(spark, sf):
    return C.followups(tagged(spark, sf), WINDOW, MIN_MULT).select("run", "event", "prev_event", "dt", "nhit")


@query("n_after", TAGGED_SQL + f"""SELECT r.run, r.event, count(c.event) AS n_after FROM realt r
LEFT JOIN (SELECT run, event, prev_event FROM tagged WHERE NOT is_tag AND dt <= {WINDOW}) c ON c.run = r.run AND c.prev_event = r.event
GROUP BY r.run, r.event""")
def n_after(spark, sf):
    return C.n_after(tagged(spark, sf), WINDOW)


@query("candidates_with_parent", TAGGED_SQL + f"""SELECT c.run, c.event, c.prev_event, p.q17 AS mu_q17, p.nhit AS mu_nhit
FROM tagged c JOIN trig p ON p.run = c.run AND p.event = c.prev_event
WHERE NOT c.is_tag AND c.dt <= {WINDOW} AND c.nhit >= {MIN_MULT} AND p.q17 >= {HARD}""")
def candidates_with_parent(spark, sf):
    c = C.followups(tagged(spark, sf), WINDOW, MIN_MULT).select("run", "event", "prev_event")
    parents = views.trig(spark, sf).where(F.col("q17") >= HARD)
    return C.with_parent(c, parents, ["q17", "nhit"])


@query("recovery_table", TAGGED_SQL + f""",
edges(bin, lo, hi) AS (VALUES {', '.join(f'({i}, {a}::DOUBLE, {b}::DOUBLE)' for i, (a, b) in enumerate(zip(EDGES_H, EDGES_H[1:])))})
SELECT CAST(bin AS BIGINT) AS bin, lo AS dt_lo, count(event) AS events, median(nhit) AS median_nhit,
       round(avg(CASE WHEN nhit >= 50 THEN 1 WHEN nhit < 50 THEN 0 END), 6) AS fraction
FROM edges LEFT JOIN (SELECT *, dt / {HOUR}.0 AS h FROM tagged WHERE NOT is_tag AND dt <= {WINDOW} AND nhit >= {MIN_MULT}) ON h >= lo AND h < hi
GROUP BY 1, 2""")
def recovery_table(spark, sf):
    c = C.followups(tagged(spark, sf), WINDOW, MIN_MULT)
    return rounded(C.recovery_table(c, F.col("dt") / F.lit(float(HOUR)), EDGES_H, 50))


@query("sideband", TAGGED_SQL + f""",
c AS (SELECT CAST(least(floor(q17 / 5.0), 22) AS BIGINT) AS bin, dt / {HOUR}.0 AS h FROM tagged WHERE NOT is_tag AND dt <= {WINDOW} AND nhit >= {MIN_MULT} AND q17 <= 115)
SELECT bin, count(*) FILTER (h BETWEEN 0.5 AND 3.5) AS n_early, count(*) FILTER (h > 6 AND h <= 12) AS n_late,
       round(count(*) FILTER (h BETWEEN 0.5 AND 3.5) - (3.5 - 0.5) / (12.0 - 6.0) * count(*) FILTER (h > 6 AND h <= 12), 6) AS signal
FROM (SELECT unnest(range(23)) AS bin) b LEFT JOIN c USING (bin) GROUP BY bin""")
def sideband(spark, sf):
    c = C.followups(tagged(spark, sf), WINDOW, MIN_MULT)
    return rounded(C.sideband(c, F.col("dt") / F.lit(float(HOUR)), F.col("q17"), (0.0, 5.0, 23), (0.5, 3.5), (6.0, 12.0)))


@query("tag_rate", TAGGED_SQL + """, f AS (
  SELECT run, (max(ts) - min(ts)) / 40e6 AS live, count(*) FILTER (NOT retrigger) AS n_real, count(*) FILTER (retrigger) AS n_re FROM tagged WHERE is_tag GROUP BY run)
SELECT count(*) AS files, CAST(sum(n_real) AS BIGINT) AS n_real, CAST(sum(n_re) AS BIGINT) AS n_retrigger, round(sum(live), 3) AS live_s,
       round(sum(n_real) / greatest(sum(live), 1.0), 9) AS rate FROM f""")
def tag_rate(spark, sf):
    return rounded(C.tag_rate(tagged(spark, sf), F.col("run"), F.col("ts") / F.lit(40e6)), 9, live_s=3)
