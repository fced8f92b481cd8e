"""Queries: localisation, energies, tracks, fits and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import constants as K
from ..functions import geometry as G
from ..functions import tracks as T
from ..operators import calib as C
from ..operators import custom as Y
from ..operators import energy as E
from ..operators import fits as X
from ..operators import hits as H
from ..operators import locate as L
from ..operators import report as R
from ..operators import track_scan as S
from ..operators.hist import source_peak
from ..session import stage
from . import sqlparts as P
from .calibration import BASE, primary_showers, source_peak_sql
from .correlation import FRAMED_SQL, HOUR, TAGGED_SQL, WINDOW, framed, tagged
from .densities import DT, HI, LO, centre_residuals
from .registry import query, rounded
from ..operators import correlate as CO
from ..operators import cube as U

EV = ["run", "event"]


def placed(spark, sf):
    """Primary hits of the bright events with sensor positions."""
    return C.with_geometry(primary_showers(spark, sf), G.sensors(spark))


def vertices(spark, sf):
    return L.centroid(L.fit_hits(placed(spark, sf)))


FIT = f"""{BASE}, fh AS (SELECT p.*, px, py, pz FROM prim p JOIN sensor s ON s.cable = p.cable WHERE p.cable < 1879 AND t IS NOT NULL AND q >= 0.3),
cw AS (SELECT run, event, sum(least(greatest(q, 0), 20)) AS w, sum(least(greatest(q, 0), 20) * px) AS wx, sum(least(greatest(q, 0), 20) * py) AS wy,
  sum(least(greatest(q, 0), 20) * pz) AS wz FROM fh GROUP BY run, event),
c0 AS (SELECT run, event, wx / w / 0.62::DOUBLE AS x, wy / w / 0.62::DOUBLE AS y, wz / w / 0.62::DOUBLE AS z FROM cw),
vtx AS (SELECT run, event, x * least(1, 800 / sqrt(x*x + y*y + z*z)) AS x, y * least(1, 800 / sqrt(x*x + y*y + z*z)) AS y, z * least(1, 800 / sqrt(x*x + y*y + z*z)) AS z FROM c0)"""


@query("centroid", FIT + " SELECT run, event, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM vtx")
def centroid(spark, sf):
    return rounded(vertices(spark, sf))


@query("custom_localiser", FIT + " SELECT run, event, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM vtx")
def custom_localiser(spark, sf):
    """A localiser of a user's own, called from SQL by its name."""
    Y.register(spark, "charge_centroid", Y.ChargeCentroid)
    hits = L.fit_hits(placed(spark, sf)).select(*EV, "q", "px", "py", "pz")
    return rounded(Y.estimates(hits, "charge_centroid", Y.ChargeCentroid))


@query("custom_channel", f"""{views.with_views('hits')}
SELECT cable, count(*) AS n, round(avg(q), 6) AS mean, round(stddev_pop(q), 6) AS sigma FROM hits WHERE q IS NOT NULL GROUP BY cable""")
def custom_channel(spark, sf):
    """A channel estimator of a user's own: a channel's rows are folded in 16 parts, whose states are merged."""
    Y.register(spark, "channel_moments", Y.Moments)
    return rounded(Y.estimates(views.hits(spark, sf).select("cable", "event", "q"), "channel_moments", Y.Moments, 16, "event"))


@query("derived_coordinates", FIT + """ SELECT run, event, round(sqrt(x*x+y*y+z*z), 6) AS r, round(sqrt(x*x+y*y), 6) AS rho, round(degrees(atan2(y, x)), 6) AS phi,
  round(z / sqrt(x*x+y*y+z*z), 6) AS cost, round(degrees(acos(z / sqrt(x*x+y*y+z*z))), 6) AS theta, round((x*x+y*y) / 422500.0, 9) AS rho2 FROM vtx""")
def derived_coordinates(spark, sf):
    x, y, z = (F.col(c) for c in "xyz")
    return rounded(vertices(spark, sf).select(*EV, G.norm(x, y, z).alias("r"), G.rho(x, y).alias("rho"), G.azimuth_deg(x, y).alias("phi"),
                                              G.cos_theta(x, y, z).alias("cost"), G.polar_deg(x, y, z).alias("theta"), G.rho2_scaled(x, y).alias("rho2")), rho2=9)


ACC = ("(CASE WHEN cable < 1325 THEN {a17}::DOUBLE ELSE {a20}::DOUBLE END * (0.1 + 0.9 * least(greatest((dx*px+dy*py+dz*pz) / (sqrt(dx*dx+dy*dy+dz*dz) * sqrt(px*px+py*py+pz*pz)), 0), 1))"
       " * exp(-sqrt(dx*dx+dy*dy+dz*dz) / 2500.0) / (dx*dx+dy*dy+dz*dz))").format(a17=repr(K.AREA_17), a20=repr(K.AREA_20))
LIGHT = FIT + f""",
et AS (SELECT v.run, v.event, cable, px, py, pz, px - x AS dx, py - y AS dy, pz - z AS dz FROM vtx v, sensor WHERE cable < 1879),
l1 AS (SELECT run, event, cable, px, py, pz, {ACC} AS acc, CASE WHEN cable < 1325 THEN 0.220::DOUBLE ELSE 0.293::DOUBLE END AS eta FROM et),
l0 AS (SELECT cable, {ACC} AS acc0 FROM (SELECT cable, px, py, pz, px AS dx, py AS dy, pz AS dz FROM sensor)),
lt AS (SELECT l1.run, l1.event, l1.cable, eta * acc / acc0 AS alpha FROM l1 JOIN l0 ON l0.cable = l1.cable),
{P.residuals('r', 'prim')}"""


@query("light_sums", LIGHT + " SELECT run, event, count(*) AS n_live, round(sum(alpha), 6) AS alpha, round(sum(alpha), 6) AS alpha_q FROM lt GROUP BY run, event")
def light_sums(spark, sf):
    return rounded(E.light_sums(vertices(spark, sf), E.live_tubes(G.sensors(spark))).drop("eta_sum"))


@query("charge_energy", LIGHT + """,
ls AS (SELECT run, event, sum(alpha) AS alpha FROM lt GROUP BY run, event),
hw AS (SELECT run, event, count(*) FILTER (res BETWEEN -15 AND 85) AS n_window, count(*) FILTER (res BETWEEN -200 AND -40) * (100.0 / 160.0) AS dark_hits,
  coalesce(sum(q) FILTER (res BETWEEN -15 AND 85), 0) - coalesce(sum(q) FILTER (res BETWEEN -200 AND -40), 0) * (100.0 / 160.0) AS q_window FROM r GROUP BY run, event)
SELECT hw.run, hw.event, n_window, round(dark_hits, 6) AS dark_hits, round(q_window, 6) AS q_window, round(q_window / alpha, 6) AS e_charge,
  round(alpha / (1325 * 0.220 + 554 * 0.293), 6) AS f_collect FROM hw JOIN ls USING (run, event)""")
def charge_energy(spark, sf):
    return rounded(E.charge_energy(centre_residuals(spark, sf), vertices(spark, sf), E.live_tubes(G.sensors(spark))))


@query("hit_pattern", LIGHT + """,
seen AS (SELECT DISTINCT run, event, cable FROM r WHERE res BETWEEN -15 AND 85)
SELECT lt.run, lt.event, count(*) AS n_live, count(seen.cable) AS n_hit, round(sum(CASE WHEN seen.cable IS NOT NULL THEN alpha ELSE 0 END), 6) AS alpha_hit
FROM lt LEFT JOIN seen ON lt.run = seen.run AND lt.event = seen.event AND lt.cable = seen.cable GROUP BY lt.run, lt.event""")
def hit_pattern(spark, sf):
    p = E.hit_pattern(centre_residuals(spark, sf), vertices(spark, sf), E.live_tubes(G.sensors(spark)))
    return rounded(p.select(*EV, "n_live", "n_hit", "alpha_hit"))


SLOPE = "list_sum(list_transform(h, lambda t: t.a * exp(-(t.a * {e} + t.d)) / greatest(1 - exp(-(t.a * {e} + t.d)), 1e-300))) - miss"


@query("hit_energy", LIGHT.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
seen AS (SELECT DISTINCT run, event, cable FROM r WHERE res BETWEEN -15 AND 85),
dh AS (SELECT run, event, count(*) FILTER (res BETWEEN -200 AND -40) * (100.0 / 160.0) AS dark_hits FROM r GROUP BY run, event),
ev AS (SELECT lt.run, lt.event, count(*) AS n_live, count(seen.cable) AS n_hit, coalesce(sum(alpha) FILTER (seen.cable IS NULL), 0) AS miss,
         list({{'a': alpha, 'd': coalesce(dark_hits, 0) / 1879}}) FILTER (seen.cable IS NOT NULL) AS h
       FROM lt LEFT JOIN seen ON lt.run = seen.run AND lt.event = seen.event AND lt.cable = seen.cable LEFT JOIN dh ON dh.run = lt.run AND dh.event = lt.event GROUP BY lt.run, lt.event),
up AS (SELECT run, event, h, miss, 1.0::DOUBLE AS hi FROM ev WHERE n_hit < n_live
       UNION ALL SELECT run, event, h, miss, hi * 2 FROM up WHERE hi < 1e4 AND {SLOPE.format(e='hi')} > 0),
bi AS (SELECT run, event, any_value(h) AS h, any_value(miss) AS miss, 0.0::DOUBLE AS lo, max(hi) AS hi, 0 AS k FROM up GROUP BY run, event
       UNION ALL SELECT run, event, h, miss, CASE WHEN rise THEN mid ELSE lo END, CASE WHEN rise THEN hi ELSE mid END, k + 1
       FROM (SELECT *, 0.5::DOUBLE * (lo + hi) AS mid, coalesce({SLOPE.format(e='(0.5::DOUBLE * (lo + hi))')}, -miss) > 0 AS rise FROM bi WHERE hi - lo >= 1e-4 AND k < 60)),
root AS (SELECT run, event, arg_max(0.5::DOUBLE * (lo + hi), k) AS e FROM bi GROUP BY run, event)
SELECT ev.run, ev.event, n_live, n_hit, round(CASE WHEN n_hit = n_live THEN 'inf'::DOUBLE ELSE e END, 6) AS e_hit FROM ev LEFT JOIN root ON root.run = ev.run AND root.event = ev.event""")
def hit_energy(spark, sf):
    return rounded(E.hit_energy(centre_residuals(spark, sf), vertices(spark, sf), E.live_tubes(G.sensors(spark))))


@query("energy_scale", f"""{views.with_views('trig')}, {source_peak_sql('nhit')},
m AS (SELECT t.run, median(q17) AS a, median(nhit) AS b FROM trig t JOIN p ON p.run = t.run WHERE nhit > 0.8 * peak AND nhit < 1.2 * peak GROUP BY t.run)
SELECT t.run, event, round(q17 * 2.506 / a, 6) AS q17, round(nhit * 2.506 / b, 6) AS nhit FROM trig t JOIN m ON m.run = t.run""")
def energy_scale(spark, sf):
    t = views.trig(spark, sf).withColumn("nhit", F.col("nhit").cast("double"))
    # the medians are those of the run's source window
    w = source_peak(t, ["run"], F.col("nhit")).select("run", "peak")
    source = t.join(w, "run").where((F.col("nhit") > 0.8 * F.col("peak")) & (F.col("nhit") < 1.2 * F.col("peak")))
    s = E.energy_scale(source, ["run"], ["q17", "nhit"], 2.506)
    return rounded(E.apply_scales(t, s, ["run"], ["q17", "nhit"]).select("run", "event", "q17", "nhit"))


# synthetic node table (the published tables are private): ratio and second derivatives at four energies
NODES, RATIO, CURV = [0.5, 2.0, 8.0, 100.0], [0.84, 0.93, 0.98, 1.0], [0.0, -0.02, -0.001, 0.0]


def _cubic_sql(t, x, y, y2):
    piece = lambda k: (f"(({x[k+1]!r} - {t}) / {x[k+1]-x[k]!r} * {y[k]!r} + ({t} - {x[k]!r}) / {x[k+1]-x[k]!r} * {y[k+1]!r} + "
                       f"((pow(({x[k+1]!r} - {t}) / {x[k+1]-x[k]!r}, 3) - ({x[k+1]!r} - {t}) / {x[k+1]-x[k]!r}) * {y2[k]!r} + "
                       f"(pow(({t} - {x[k]!r}) / {x[k+1]-x[k]!r}, 3) - ({t} - {x[k]!r}) / {x[k+1]-x[k]!r}) * {y2[k+1]!r}) * {(x[k+1]-x[k])**2/6.0!r})")
    return f"CASE WHEN {t} < {x[1]!r} THEN {piece(0)} WHEN {t} < {x[2]!r} THEN {piece(1)} ELSE {piece(2)} END"


@query("visible_energy", f"""{views.with_views('trig')}
SELECT run, event, round(q17 * {_cubic_sql('q17', NODES, RATIO, CURV)}, 6) AS e_vis,
  round(q17 * {_cubic_sql('q17', [e * r for e, r in zip(NODES, RATIO)], [1.0 / r for r in RATIO], CURV)}, 6) AS e_real FROM trig""")
def visible_energy(spark, sf):
    t = views.trig(spark, sf)
    return rounded(t.select("run", "event", E.visible_energy(F.col("q17"), NODES, RATIO, CURV).alias("e_vis"),
                            E.real_energy(F.col("q17"), NODES, RATIO, CURV).alias("e_real")))


# ---- localisation -----------------------------------------------------------------------------------------------------
@query("localise")
def localise(spark, sf):
    return L.locate(placed(spark, sf))


@query("source_events")
def source_events(spark, sf):
    h = placed(spark, sf)
    events = H.event_totals(views.showers(spark, sf)).select("run", "event", "nhit")
    sel = L.select_source_events(events, L.locate(h), (0.0, 0.0, 0.0), max_dist=400.0)
    return L.selection_counts(sel)


@query("tune_speed")
def tune_speed(spark, sf):
    h = stage(placed(spark, sf), "placed")
    src = views.trig(spark, sf).select("run").distinct().withColumn("sz", F.lit(0.0))
    return L.tune_speed(h, src, [16.0 + k / 2 for k in range(9)])


def _model(c):
    d = F.sqrt((F.col("px") - F.col("x") - c["ox"]) ** 2 + (F.col("py") - F.col("y") - c["oy"]) ** 2 + (F.col("pz") - F.col("z") - c["oz"]) ** 2)
    e = (F.col("t") - 500.0 - d / 17.6) / 100.0
    return -F.least(e * e, F.lit(9.0))


@query("score_candidates", FIT + """,
cand AS (SELECT a * 9 + b * 3 + c AS cand, (a - 1) * 50.0 AS ox, (b - 1) * 50.0 AS oy, (c - 1) * 50.0 AS oz
  FROM (SELECT unnest(range(0, 3)) AS a), (SELECT unnest(range(0, 3)) AS b), (SELECT unnest(range(0, 3)) AS c)),
sc AS (SELECT h.run, h.event, cand, sum(-least(pow((t - 500.0 - sqrt(pow(px - x - ox, 2) + pow(py - y - oy, 2) + pow(pz - z - oz, 2)) / 17.6) / 100.0, 2), 9)) AS s
  FROM fh h JOIN vtx v ON v.run = h.run AND v.event = h.event, cand GROUP BY h.run, h.event, cand)
SELECT run, event, CAST(arg_max(cand, s) AS INTEGER) AS cand, round(max(s), 6) AS score FROM sc GROUP BY run, event""")
def score_candidates(spark, sf):
    h = L.fit_hits(placed(spark, sf)).join(vertices(spark, sf), EV)
    return rounded(L.best_candidate(L.score_candidates(h, L.local_grid(50.0, 1), _model)))


@query("poisson_candidates", FIT + f""",
cand AS (SELECT a * 9 + b * 3 + c AS cand, (a - 1) * 50.0 AS ox, (b - 1) * 50.0 AS oy, (c - 1) * 50.0 AS oz
  FROM (SELECT unnest(range(0, 3)) AS a), (SELECT unnest(range(0, 3)) AS b), (SELECT unnest(range(0, 3)) AS c)),
pos AS (SELECT run, event, cand, x + ox AS x, y + oy AS y, z + oz AS z FROM vtx, cand),
et AS (SELECT run, event, cand, cable, px, py, pz, px - x AS dx, py - y AS dy, pz - z AS dz FROM pos, sensor WHERE cable < 1879),
l0 AS (SELECT cable, {ACC} AS acc0 FROM (SELECT cable, px, py, pz, px AS dx, py AS dy, pz AS dz FROM sensor)),
m AS (SELECT et.run, et.event, cand, et.cable, 2.0 * CASE WHEN et.cable < 1325 THEN 0.220::DOUBLE ELSE 0.293::DOUBLE END * {ACC.replace('cable <', 'et.cable <')} / acc0 AS mu FROM et JOIN l0 ON l0.cable = et.cable),
s AS (SELECT m.run, m.event, cand, sum(CASE WHEN fh.q IS NOT NULL THEN fh.q * ln(mu) ELSE 0 END - mu) AS s
      FROM m LEFT JOIN fh ON fh.run = m.run AND fh.event = m.event AND fh.cable = m.cable GROUP BY m.run, m.event, cand)
SELECT run, event, CAST(arg_max(cand, s) AS INTEGER) AS cand, round(max(s), 5) AS score FROM s GROUP BY run, event""")
def poisson_candidates(spark, sf):
    """Positions around the centroid by the Poisson likelihood of the charges at 2 MeV."""
    h = L.fit_hits(stage(placed(spark, sf), "placed"))      # written, since the vertices and the charges take them up
    around = [(a * 50.0, b * 50.0, c * 50.0) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    return rounded(E.poisson_candidates(h, L.centroid(h), E.live_tubes(G.sensors(spark)), around, 2.0), 5)


@query("grid_likelihood")
def grid_likelihood(spark, sf):
    # written, since three uses each take up the residuals and the hits
    res, h = stage(centre_residuals(spark, sf), "residuals"), stage(placed(spark, sf), "placed")
    cube = stage(U.density_cube(U.density_counts(res, LO, HI, DT), LO, HI, DT), "cube")
    v = stage(L.centroid(L.fit_hits(h)), "vertices")
    start = v.join(res.groupBy(*EV).agg(F.first("t_event").alias("t0")), EV).withColumn("ok", F.lit(True))
    e = E.charge_energy(res, v, E.live_tubes(G.sensors(spark))).select(*EV, F.greatest("e_charge", F.lit(0.1)).alias("e"))
    # the operator's steps, and as far as 50 cm and 10 ns: its 125 x 5 points and more around them
    return L.grid_likelihood(h, start, cube, 17.6, 17.6, LO, DT, half=3, t_steps=10, tubes=E.live_tubes(G.sensors(spark)), energy=e)


@query("parameter_sweep", f"""{views.with_views('trig')}, g AS (SELECT unnest([10.0, 20.0, 30.0, 40.0, 50.0, 60.0]) AS p),
m AS (SELECT run, p, avg(abs(q17 - p)) AS v FROM trig, g GROUP BY run, p)
SELECT run, CAST(arg_min(p, v) AS DOUBLE) AS best, round(min(v), 6) AS value FROM m GROUP BY run""")
def parameter_sweep(spark, sf):
    return rounded(L.sweep(views.trig(spark, sf), [10, 20, 30, 40, 50, 60], lambda p: F.abs(F.col("q17") - p), ["run"]))


# ---- tracks ---------------------------------------------------------------------------------------------------------------
def through_tracks(spark, sf):
    """Entrance and exit of each bright event at its earliest and latest 17-inch sensor."""
    h = placed(spark, sf).where(F.col("cable") < K.N_ID17)
    p = F.struct("px", "py", "pz")
    g = h.groupBy(*EV).agg(F.min_by(p, F.struct("t", "cable")).alias("a"), F.max_by(p, F.struct("t", "cable")).alias("b"), F.min("t").alias("t0"),
                           F.sum("q").alias("q17"))
    return g.select(*EV, F.lit(0).alias("rank"), "t0", (F.col("q17") * 20).alias("q17"), *[F.col(f"a.p{c}").alias(f"e{c}") for c in "xyz"],
                    *[F.col(f"b.p{c}").alias(f"x{c}") for c in "xyz"])


TRACK = f"""{BASE}, f17 AS (SELECT p.*, px, py, pz FROM prim p JOIN sensor s ON s.cable = p.cable WHERE p.cable < 1325),
tr0 AS (SELECT run, event, min(t) AS t0, sum(q) * 20 AS q17, arg_min({{'x': px, 'y': py, 'z': pz}}, [t, cable]) AS e, arg_max({{'x': px, 'y': py, 'z': pz}}, [t, cable]) AS x FROM f17 GROUP BY run, event),
tr1 AS (SELECT run, event, t0, q17, e.x AS ex, e.y AS ey, e.z AS ez, x.x AS xx, x.y AS xy, x.z AS xz FROM tr0),
tr2 AS (SELECT *, sqrt(pow(xx-ex,2)+pow(xy-ey,2)+pow(xz-ez,2)) AS len FROM tr1),
tr3 AS (SELECT *, (xx-ex)/len AS ux, (xy-ey)/len AS uy, (xz-ez)/len AS uz FROM tr2),
tr4 AS (SELECT *, sqrt(greatest(ex*ex+ey*ey+ez*ez - pow(ex*ux+ey*uy+ez*uz,2), 0)) AS b FROM tr3),
tr AS (SELECT *, CASE WHEN b < 650 THEN 2*sqrt(greatest(422500.0 - b*b, 0)) ELSE 0 END AS l_ls,
  CASE WHEN b < 830 THEN 2*sqrt(greatest(688900.0 - b*b, 0)) ELSE 0 END - CASE WHEN b < 650 THEN 2*sqrt(greatest(422500.0 - b*b, 0)) ELSE 0 END AS l_bo FROM tr4)"""


@query("track_geometry", TRACK + """
SELECT run, event, round(b, 6) AS impact, round(len, 6) AS length, round(l_ls, 6) AS l_ls, round(l_bo, 6) AS l_bo, round(-uz, 6) AS cos_zenith, round(degrees(atan2(uy, ux)), 6) AS azimuth,
  round(CASE WHEN b <= 400 THEN 1.65 WHEN b <= 650 THEN 1.65 + (b-400) * (-0.15/250) WHEN b <= 690 THEN 1.5 + (b-650)*(-0.05/40) WHEN b <= 730 THEN 1.45 + (b-690)*(-0.05/40) ELSE 1.4 END, 6) AS index,
  round(least(pow(greatest((sqrt(greatest(ex*ex+ey*ey+pow(850-ez,2) - pow(-ex*ux-ey*uy+(850-ez)*uz,2), 0)) - 200)/200, 0), 2), 4), 6) AS chimney,
  round(greatest(3000, 629.4*l_ls + 31.45*l_bo), 4) AS expected_q17, round(q17 - (629.4*l_ls + 31.45*l_bo), 4) AS delta_q,
  round(0.1 * least(pow(log10(greatest(q17, 1) / greatest(3000, 629.4*l_ls + 31.45*l_bo)) / 0.3, 2), 100), 6) AS penalty FROM tr""")
def track_geometry(spark, sf):
    t = S.track_columns(through_tracks(spark, sf)).withColumn("penalty", T.charge_penalty(F.col("impact"), F.col("q17")))
    return rounded(t.select(*EV, "impact", "length", "l_ls", "l_bo", "cos_zenith", "azimuth", "index", "chimney", "expected_q17", "delta_q", "penalty"),
                   expected_q17=4, delta_q=4)


@query("first_light", TRACK + """,
j AS (SELECT f.run, f.event, f.t, t0, len, px-ex AS dx, py-ey AS dy, pz-ez AS dz, px-xx AS gx, py-xy AS gy, pz-xz AS gz, ux, uy, uz FROM f17 f JOIN tr ON tr.run = f.run AND tr.event = f.event),
k AS (SELECT *, dx*ux+dy*uy+dz*uz AS zz, sqrt(greatest(dx*dx+dy*dy+dz*dz - pow(dx*ux+dy*uy+dz*uz,2), 0)) AS off FROM j),
m AS (SELECT run, event, CASE WHEN zz - off/sqrt(1.25) < 0 THEN t0 + 1.5*sqrt(dx*dx+dy*dy+dz*dz)/29.9792458 WHEN zz - off/sqrt(1.25) > len THEN t0 + len/29.9792458 + 1.5*sqrt(gx*gx+gy*gy+gz*gz)/29.9792458
   ELSE t0 + (zz + off*sqrt(1.25))/29.9792458 END AS pred FROM k)
SELECT run, event, count(*) AS n, round(avg(pred), 6) AS mean_pred, round(max(pred), 6) AS last_pred FROM m GROUP BY run, event""")
def first_light(spark, sf):
    e, x = S.ends()
    h = placed(spark, sf).where(F.col("cable") < K.N_ID17).join(through_tracks(spark, sf).drop("q17"), EV)
    p = T.first_light((F.col("px"), F.col("py"), F.col("pz")), e, x, F.col("t0"), 1.5)
    return rounded(h.withColumn("p", p).groupBy(*EV).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_pred"), F.max("p").alias("last_pred")))


@query("od_term", TRACK + """,
o AS (SELECT p.run, p.event, p.t - t0 - ((px-ex)*ux + (py-ey)*uy + (pz-ez)*uz)/29.9792458 AS r FROM prim p JOIN sensor s ON s.cable = p.cable JOIN tr ON tr.run = p.run AND tr.event = p.event WHERE p.cable >= 1879),
m AS (SELECT run, event, median(r) AS m, count(*) AS n FROM o GROUP BY run, event)
SELECT tr.run, tr.event, round(CASE WHEN max(n) >= 4 THEN avg(least(pow((r - m)/25.0, 2), 9)) ELSE 0 END, 6) AS od_term
FROM tr LEFT JOIN m ON m.run = tr.run AND m.event = tr.event LEFT JOIN o ON o.run = tr.run AND o.event = tr.event GROUP BY tr.run, tr.event""")
def od_term(spark, sf):
    od = placed(spark, sf).where(F.col("cable") >= K.N_ID)
    return rounded(S.od_terms(through_tracks(spark, sf), od).select(*EV, "od_term"))


@query("charge_pattern", f"""{BASE}, x AS (SELECT run, event, ln(q + 3.0::DOUBLE) - ln(adc / 16.0 + gain + 3.0) AS l FROM prim WHERE cable < 1325 AND (q > 0.5 OR adc / 16.0 + gain > 0.5)),
m AS (SELECT run, event, median(l) AS s FROM x GROUP BY run, event)
SELECT x.run, x.event, count(*) AS n, round(avg(least(pow(l - s, 2), 2.25)), 6) AS pattern, round(exp(any_value(s)), 6) AS scale,
  round(avg(least(1.0, 1.5 / greatest(abs(l - s), 1e-9))), 6) AS mean_weight FROM x JOIN m ON m.run = x.run AND m.event = x.event GROUP BY x.run, x.event""")
def charge_pattern(spark, sf):
    h = primary_showers(spark, sf).where(F.col("cable") < K.N_ID17)
    return rounded(S.charge_pattern(h, EV, F.col("q"), F.col("adc") / 16.0 + F.col("gain")))


@query("track_scan")
def track_scan(spark, sf):
    h = stage(placed(spark, sf), "placed")
    q = h.where(F.col("cable") < K.N_ID17).groupBy(*EV).agg((F.sum("q") * 20).alias("q17"))
    # written, since the outer detector's term takes up the tracks three times, each with a scan of its own
    t = stage(S.track_columns(S.track_scan(h, q)), "tracks")
    od = h.where(F.col("cable") >= K.N_ID)
    return S.rerank(S.od_terms(t, od)).select(*EV, "place", "rank", "score", "final", "impact", "od_term", "chimney", "n_hits")


ENDS = ("ex", "ey", "ez", "xx", "xy", "xz")


@query("distinct_tracks", f"""{views.with_views('hits', 'sensor').replace('WITH ', 'WITH RECURSIVE ', 1)},
cand AS (SELECT run, event, CAST(adc AS DOUBLE) AS score, a.px AS ex, a.py AS ey, a.pz AS ez, b.px AS xx, b.py AS xy, b.pz AS xz
  FROM hits h JOIN sensor a ON a.cable = h.cable JOIN sensor b ON b.cable = (h.cable * 7 + 13) % 1879 WHERE h.cable < 1879),
rk AS (SELECT *, row_number() OVER (PARTITION BY run, event ORDER BY score DESC, ex, ey, ez, xx, xy, xz) AS rk FROM cand),
it(run, event, rk, kept) AS (
  SELECT run, event, 1::BIGINT, [struct_pack(score, ex, ey, ez, xx, xy, xz)] FROM rk WHERE rk = 1
  UNION ALL
  SELECT it.run, it.event, r.rk, CASE WHEN len(kept) >= 3 OR len(list_filter(kept, lambda k:
      (k.ex - r.ex) ** 2 + (k.ey - r.ey) ** 2 + (k.ez - r.ez) ** 2 <= 810000 AND (k.xx - r.xx) ** 2 + (k.xy - r.xy) ** 2 + (k.xz - r.xz) ** 2 <= 810000)) > 0
    THEN kept ELSE list_append(kept, struct_pack(score := r.score, ex := r.ex, ey := r.ey, ez := r.ez, xx := r.xx, xy := r.xy, xz := r.xz)) END
  FROM it JOIN rk r ON r.run = it.run AND r.event = it.event AND r.rk = it.rk + 1),
fin AS (SELECT run, event, arg_max(kept, rk) AS kept FROM it GROUP BY run, event),
pl AS (SELECT run, event, CAST(p AS INTEGER) AS place, kept[p + 1] AS k FROM fin, LATERAL (SELECT unnest(range(0, len(kept))) AS p))
SELECT run, event, place, round(k.score, 4) AS score, {', '.join(f'round(k.{c}, 4) AS {c}' for c in ENDS)} FROM pl""")
def distinct_tracks(spark, sf):
    """Best three candidates of an event, none with both ends within 900 cm of a better one's."""
    s = G.sensors(spark)
    at = lambda p: s.select(F.col("cable").alias(f"c_{p}"), *[F.col(f"p{c}").alias(f"{p}{c}") for c in "xyz"])
    h = views.hits(spark, sf).where(F.col("cable") < K.N_ID)
    c = h.join(at("e"), F.col("cable") == F.col("c_e")).join(at("x"), (F.col("cable") * 7 + 13) % K.N_ID == F.col("c_x"))
    return rounded(S.greedy_distinct(c.select(*EV, F.col("adc").cast("double").alias("score"), *ENDS), EV, "score", 900.0, 3), 4)


# ---- fits and summaries -------------------------------------------------------------------------------------------------
DECAY_SQL = TAGGED_SQL + f""",
cd AS (SELECT run, dt / {HOUR / 60.0}::DOUBLE AS m FROM tagged WHERE NOT is_tag AND dt <= {WINDOW}),
cb AS (SELECT run, CASE WHEN m = 720 THEN 35 ELSE floor(m / 20) END AS k, count(*) AS n FROM cd WHERE m >= 0 AND m <= 720 GROUP BY ALL),
tot AS (SELECT run, CAST(sum(n) AS BIGINT) AS n FROM cb GROUP BY run),
yb AS (SELECT tot.run, g.k, coalesce(cb.n, 0)::DOUBLE AS y FROM tot CROSS JOIN (SELECT unnest(range(36)) AS k) g LEFT JOIN cb ON cb.run = tot.run AND cb.k = g.k),
tl AS (SELECT unnest(range(50, 600))::DOUBLE AS tau),
it(run, tau, step, a, b) AS (
  SELECT run, tau, 0, greatest(n / 36.0::DOUBLE, 1e-3), greatest(n / 36.0::DOUBLE, 1e-3) FROM tot CROSS JOIN tl
  UNION ALL
  SELECT run, tau, step + 1, CASE WHEN a < 1e-6 THEN 1e-6 WHEN b < 1e-6 THEN greatest((ya - sab * 1e-6::DOUBLE) / saa, 1e-6) ELSE a END,
    CASE WHEN a < 1e-6 THEN greatest((yb - sab * 1e-6::DOUBLE) / sbb, 1e-6) WHEN b < 1e-6 THEN 1e-6 ELSE b END
  FROM (SELECT *, (sbb * ya - sab * yb) / det AS a, (saa * yb - sab * ya) / det AS b
    FROM (SELECT *, CASE WHEN saa * sbb - sab * sab > 0 THEN saa * sbb - sab * sab ELSE 1 END AS det
      FROM (SELECT run, tau, step, sum(e * e / mu) AS saa, sum(e / mu) AS sab, sum(1 / mu) AS sbb, sum(e * y / mu) AS ya, sum(y / mu) AS yb
        FROM (SELECT it.run, it.tau, it.step, y, exp(-(20 * (k + 0.5::DOUBLE)) / it.tau) AS e,
            greatest(it.a * exp(-(20 * (k + 0.5::DOUBLE)) / it.tau) + it.b, 1e-9) AS mu
          FROM it JOIN yb ON yb.run = it.run WHERE it.step < {X.ROUNDS})
        GROUP BY run, tau, step)))),
fin AS (SELECT it.run, it.tau, it.a, it.b, sum(it.a * exp(-(20 * (k + 0.5::DOUBLE)) / it.tau)) AS n_signal,
    sum(greatest(it.a * exp(-(20 * (k + 0.5::DOUBLE)) / it.tau) + it.b, 1e-9) - y * ln(greatest(it.a * exp(-(20 * (k + 0.5::DOUBLE)) / it.tau) + it.b, 1e-9))) AS nll
  FROM it JOIN yb ON yb.run = it.run WHERE it.step = {X.ROUNDS} GROUP BY ALL),
lst AS (SELECT *, min(nll) OVER (PARTITION BY run) AS least FROM fin),
rng AS (SELECT run, min(tau) FILTER (nll <= least + 0.5) AS lo, max(tau) FILTER (nll <= least + 0.5) AS hi FROM lst GROUP BY run),
one AS (SELECT * FROM lst QUALIFY row_number() OVER (PARTITION BY run ORDER BY nll, tau) = 1)
SELECT run, n, tau, CASE WHEN hi > lo THEN 0.5::DOUBLE * (hi - lo) END AS tau_err, round(a, 6) AS a, round(b, 6) AS b,
  round(n_signal, 6) AS n_signal, round(b * 36, 6) AS n_background, round(nll, 6) AS nll FROM one JOIN rng USING (run) JOIN tot USING (run)"""


@query("decay_fit", DECAY_SQL)
def decay_fit(spark, sf):
    c = CO.in_window(tagged(spark, sf), WINDOW)
    minutes = F.col("dt") / F.lit(HOUR / 60.0)
    return rounded(X.decay_fit(c, ["run"], minutes, 0.0, 720.0, 20.0))


#: sums, linear optimum and cost of a place (mu, sg) of ``src``, one row per ``by``
def _heights_sql(src: str, by: str) -> str:
    return f"""SELECT {by}, height, level, yy - 2 * height * uy - 2 * level * y1 + height * height * uu + 2 * height * level * u1 + level * level * one AS cost
  FROM (SELECT *, CASE WHEN det <= 1e-12::DOUBLE * uu * one OR a < 0 THEN 0 WHEN b < 0 THEN uy / uu ELSE a END AS height,
      CASE WHEN det <= 1e-12::DOUBLE * uu * one OR a < 0 THEN y1 / one WHEN b < 0 THEN 0 ELSE b END AS level
    FROM (SELECT *, (one * uy - u1 * y1) / CASE WHEN det > 0 THEN det ELSE 1 END AS a, (uu * y1 - u1 * uy) / CASE WHEN det > 0 THEN det ELSE 1 END AS b
      FROM (SELECT *, uu * one - u1 * u1 AS det
        FROM (SELECT {by}, sum(w * u * u) AS uu, sum(w * u) AS u1, sum(w) AS one, sum(w * u * y) AS uy, sum(w * y) AS y1, sum(w * y * y) AS yy
          FROM (SELECT s.*, l.y, 1 / greatest(l.y, 1.0) AS w, exp(-((l.x - s.mu) / s.sg) * ((l.x - s.mu) / s.sg) / 2) AS u FROM {src} s JOIN lb l ON l.run = s.run)
          GROUP BY {by}))))"""


PEAK_SQL = f"""{views.with_views('trig').replace('WITH ', 'WITH RECURSIVE ', 1)},
lim AS (SELECT run, min(q17) - 10 AS a, max(q17) AS hi FROM trig WHERE q17 IS NOT NULL AND NOT isnan(q17) GROUP BY run),
nbs AS (SELECT run, a, ceil((hi + 20 - a) / 10::DOUBLE) - 1 AS nb FROM lim),
hb AS MATERIALIZED (SELECT t.run, CAST(floor((t.q17 - e.a) / 10::DOUBLE) AS BIGINT) AS k, count(*) AS c FROM trig t JOIN nbs e ON e.run = t.run WHERE t.q17 IS NOT NULL AND NOT isnan(t.q17) GROUP BY ALL),
th AS (SELECT run, k + d AS k, sum(c) AS s FROM hb CROSS JOIN (SELECT unnest([-1, 0, 1]) AS d) GROUP BY run, k + d),
tp AS (SELECT th.run, k AS top, a, nb FROM th JOIN nbs ON nbs.run = th.run WHERE k >= 0 AND k < nb QUALIFY row_number() OVER (PARTITION BY th.run ORDER BY s DESC, k) = 1),
tot AS (SELECT run, CAST(sum(c) AS BIGINT) AS n FROM hb GROUP BY run),
lb AS MATERIALIZED (SELECT tp.run, a + 10 * (g.k + 0.5::DOUBLE) AS x, coalesce(c, 0)::DOUBLE AS y
  FROM tp JOIN tot ON tot.run = tp.run AND n >= 10, LATERAL (SELECT unnest(generate_series(CAST(greatest(top - 30, 0) AS BIGINT), CAST(least(top + 30, nb - 1) AS BIGINT))) AS k) g
  LEFT JOIN hb ON hb.run = tp.run AND hb.k = g.k),
st AS (SELECT * FROM (VALUES {', '.join(f'({o}, {i}, {j})' for o, (i, j) in enumerate(X.STENCIL))}) v(o, i, j)),
it(run, turn, mu, sg, step) AS (
  SELECT run, 0, a + 10 * (top + 0.5::DOUBLE), 30::DOUBLE, 10::DOUBLE FROM tp
  UNION ALL
  SELECT run, turn + 1, best.mu, best.sg, CASE WHEN best.o = 0 THEN step / 2 ELSE step END
  FROM (SELECT run, turn, step, min(struct_pack(cost := cost, o := o, mu := mu, sg := sg)) AS best
    FROM ({_heights_sql(f"""(SELECT it.run, it.turn, it.step, o, it.mu + i * it.step AS mu, least(greatest(it.sg + j * it.step, 3), 300)::DOUBLE AS sg
      FROM it CROSS JOIN st WHERE it.turn < {X.PEAK_ROUNDS})""", 'run, turn, step, o, mu, sg')}) GROUP BY run, turn, step)),
fin AS (SELECT run, mu, sg FROM it WHERE turn = {X.PEAK_ROUNDS}),
ft AS ({_heights_sql('fin', 'run, mu, sg')}),
ps AS (SELECT *, height * sg * sqrt(2 * pi()) / 10 AS n_peak, level * 6 * sg / 10 AS below FROM ft)
SELECT tot.run, n, round(mu, 4) AS mu, round(sg, 4) AS sigma, round(coalesce(n_peak, 0), 4) AS n_peak, round(level, 4) AS bkg_per_bin,
  round(below / greatest(below + 0.997::DOUBLE * n_peak, 1e-9), 4) AS bkg_frac FROM tot LEFT JOIN ps ON ps.run = tot.run"""


@query("peak_fit", PEAK_SQL)
def peak_fit(spark, sf):
    return rounded(X.peak_fit(views.trig(spark, sf), ["run"], F.col("q17")), 4)


def event_frame(spark, sf):
    """A reconstructed-event table: position from the centroid, quality and energy columns from the hits."""
    v = vertices(spark, sf)
    s = centre_residuals(spark, sf).groupBy(*EV).agg(F.stddev_pop(F.when(F.abs("res") <= 12, F.col("res"))).alias("sigma_t"))
    n = H.event_totals(views.showers(spark, sf)).select(*EV, "nhit", "q17", "q_total")
    return n.join(v, EV).join(s, EV).withColumn("vertex_ok", F.col("q_total") > 9000)


FRAME = f"""{FIT}, {P.residuals('r', 'prim')},
sg AS (SELECT run, event, stddev_pop(res) FILTER (abs(res) <= 12) AS sigma_t FROM r GROUP BY run, event),
nn AS (SELECT run, event, count(*) FILTER (cable < 1879) AS nhit, sum(q) FILTER (cable < 1325) AS q17, sum(q) FILTER (cable < 1879) AS q_total FROM prim GROUP BY run, event),
fr AS (SELECT nn.*, x, y, z, sigma_t, q_total > 9000 AS vertex_ok FROM nn JOIN vtx USING (run, event) JOIN sg USING (run, event))"""


@query("run_summary", FRAME + """,
ok AS (SELECT * FROM fr WHERE vertex_ok),
e AS (SELECT run, ceil((max(nhit) + 20) / 10.0) - 1 AS nb FROM ok GROUP BY run),
c AS (SELECT run, floor(nhit / 10.0) AS k, count(*) AS c FROM ok GROUP BY 1, 2),
zz AS (SELECT e.run, e.nb, g.k, coalesce(c.c, 0) AS c FROM e, LATERAL (SELECT unnest(generate_series(0, CAST(e.nb AS BIGINT) - 1)) AS k) g LEFT JOIN c ON c.run = e.run AND c.k = g.k),
s AS (SELECT *, sum(c) OVER (PARTITION BY run ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS y1 FROM zz),
n AS (SELECT *, lag(y1) OVER (PARTITION BY run ORDER BY k) AS y0, lead(y1) OVER (PARTITION BY run ORDER BY k) AS y2, max(y1) OVER (PARTITION BY run) AS top FROM s),
pk AS (SELECT * FROM n WHERE y0 IS NOT NULL AND y2 IS NOT NULL AND y1 >= 0.1 * top AND y1 >= y0 AND y1 > y2 QUALIFY row_number() OVER (PARTITION BY run ORDER BY k DESC) = 1),
p AS (SELECT run, 10 * (k + 0.5::DOUBLE + """ + P.SHIFT + """) AS peak FROM pk),
bth AS (SELECT *, 'all fitted' AS selection FROM ok UNION ALL SELECT ok.*, 'source-like' FROM ok JOIN p USING (run) WHERE nhit > 0.8 * peak AND nhit < 1.2 * peak),
m AS (SELECT run, selection, count(*) AS n, median(nhit) AS mn, median(x) AS mx, median(z) AS mz, median(sigma_t) AS ms FROM bth GROUP BY run, selection)
SELECT m.run, m.selection, n, round(mn, 6) AS median_nhit, round(mx, 6) AS median_x, round(mz, 6) AS median_z, round(ms, 6) AS median_sigma_t,
  round(1.4826 * median(abs(z - mz)), 6) AS robust_sigma_z, round(mz - 100, 6) AS z_bias FROM bth JOIN m ON m.run = bth.run AND m.selection = bth.selection GROUP BY ALL""")
def run_summary(spark, sf):
    f = stage(event_frame(spark, sf), "frame")
    return rounded(R.run_summary(f, ["nhit", "x", "z", "sigma_t"], source_z=100.0))


@query("muon_summary", TRACK + """,
m AS (SELECT run, event, q17, l_ls, l_bo, cos(b) AS sigma_t, sin(b) AS frac_used, b < 700 AS converged FROM tr)
SELECT count(*) AS n, count(*) FILTER (converged) AS n_converged, count(*) FILTER (l_ls > 0) AS n_ls, round(median(sigma_t) FILTER (converged), 6) AS median_sigma_t,
  round(median(frac_used) FILTER (converged), 6) AS median_frac_used, round(median(CASE WHEN converged AND l_ls > 0 THEN q17 / l_ls END), 6) AS q17_per_ls,
  round(median(CASE WHEN converged AND NOT l_ls > 0 AND l_bo > 100 THEN q17 / l_bo END), 6) AS q17_per_bo,
  round(median(CASE WHEN converged AND l_ls > 0 THEN (q17 - 31.45 * l_bo) / l_ls END), 6) AS ls_only_per_ls FROM m""")
def muon_summary(spark, sf):
    t = S.track_columns(through_tracks(spark, sf))
    t = t.withColumn("sigma_t", F.cos("impact")).withColumn("frac_used", F.sin("impact")).withColumn("converged", F.col("impact") < 700)
    return rounded(R.muon_summary(t))


def evaluation_rows(spark, sf):
    """Two position estimates per event: the located one and the centroid."""
    src = F.lit(0.0)
    a = L.locate(placed(spark, sf)).select(*EV, F.lit("window").alias("algo"), "x", "y", "z", F.coalesce("ok", F.lit(False)).alias("ok"))
    b = vertices(spark, sf).select(*EV, F.lit("centroid").alias("algo"), "x", "y", "z", F.lit(True).alias("ok"))
    return a.unionByName(b).withColumn("ztrue", src)


@query("evaluation")
def evaluation(spark, sf):
    return R.evaluation_pivot(R.evaluation(stage(evaluation_rows(spark, sf), "evaluation")), ["window", "centroid"])


@query("evaluation_totals")
def evaluation_totals(spark, sf):
    return R.evaluation_totals(R.evaluation(stage(evaluation_rows(spark, sf), "evaluation")))


@query("energy_by_run", f"""{views.with_views('trig')}, m AS (SELECT run, count(*) AS n, median(q17) AS a, median(nhit) AS b FROM trig GROUP BY run HAVING count(*) >= 5)
SELECT m.run, any_value(m.n) AS n, round(max(m.run * 150.0 - 500), 6) AS ztrue, round(max(a), 6) AS median_q17, round(1.4826 * median(abs(q17 - a)) / max(a), 6) AS width_q17,
  round(max(b), 6) AS median_nhit, round(1.4826 * median(abs(nhit - b)) / max(b), 6) AS width_nhit FROM trig t JOIN m ON m.run = t.run GROUP BY m.run""")
def energy_by_run(spark, sf):
    t = views.trig(spark, sf).withColumn("ztrue", F.col("run") * 150.0 - 500)
    return rounded(R.energy_by_run(t, ["q17", "nhit"]))


@query("energy_spread", f"""{views.with_views('trig')}, m AS (SELECT run, median(q17) AS a FROM trig GROUP BY run),
w AS (SELECT m.run, max(a) AS a, 1.4826 * median(abs(q17 - a)) / max(a) AS w FROM trig t JOIN m ON m.run = t.run GROUP BY m.run)
SELECT count(*) AS runs, round(stddev_pop(a) / avg(a), 6) AS spread_q17, round(avg(w), 6) AS mean_width_q17 FROM w WHERE abs(run * 150.0 - 500) <= 450""")
def energy_spread(spark, sf):
    t = views.trig(spark, sf).withColumn("ztrue", F.col("run") * 150.0 - 500)
    return rounded(R.energy_spread(R.energy_by_run(t, ["q17"]), ["q17"], 450.0))


@query("analysis_cuts", FRAMED_SQL + f"""SELECT run, count(*) FILTER (NOT is_tag AND vertex_ok AND q17 BETWEEN 18 AND 26 AND dt < {WINDOW}) AS neutrons,
  count(*) FILTER (is_tag AND NOT retrigger AND converged AND
    sqrt(greatest(ex * ex + ey * ey + ez * ez - pow((ex * (xx - ex) + ey * (xy - ey) + ez * (xz - ez)) / sqrt(pow(xx - ex, 2) + pow(xy - ey, 2) + pow(xz - ez, 2)), 2), 0)) < 650) AS tracks
  FROM dist GROUP BY run""")
def analysis_cuts(spark, sf):
    t = framed(spark, sf)
    e, x = (tuple(F.col(k + c) for c in "xyz") for k in "ex")
    n = T.neutron_candidate(F.col("is_tag"), F.col("vertex_ok"), F.col("q17"), F.col("dt"), 18, 26, WINDOW)
    m = T.ls_muon(F.col("is_tag"), F.col("retrigger"), F.col("converged"), T.light_paths(T.impact(e, T.direction(e, x)[0]))[0])
    return t.groupBy("run").agg(F.count_if(n).alias("neutrons"), F.count_if(m).alias("tracks"))


@query("od_trigger_muons", f"""{views.with_views('trig')}, m AS (SELECT run, trigger & {K.OD_TRIGGER_BITS} <> 0 AS od, nhit % 16 >= 5 AND q17 >= 20 AS low, q17 >= 150 AS bright FROM trig)
SELECT run, count(*) FILTER (low OR bright) AS muons, count(*) FILTER (low AND od OR bright) AS muons_with_bit FROM m GROUP BY run""")
def od_trigger_muons(spark, sf):
    t, n_od, cuts = views.trig(spark, sf), F.col("nhit") % 16, {"q_min": 20.0, "q_alone": 150.0}
    return t.groupBy("run").agg(F.count_if(T.is_muon(F.col("q17"), n_od, **cuts)).alias("muons"),
                                F.count_if(T.is_muon_with_od_trigger(F.col("q17"), n_od, F.col("trigger"), **cuts)).alias("muons_with_bit"))
