"""Queries: time densities, light speeds, survey and profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import views
from ..functions import geometry as G
from ..operators import calib as C
from ..operators import cube as U
from ..operators.hist import gauss_kernel
from ..session import stage, stage_root
from ..sources import tables as TB
from . import sqlparts as P
from .calibration import BASE, primary_showers
from .registry import query, rounded

V = 17.6
LO, HI, DT = -300.0, 300.0, 2.0          # wide bins: the driver's hit times are spread over 1000 ns


def centre_residuals(spark, sf):
    return C.residuals_fixed_vertex(primary_showers(spark, sf), G.sensors(spark), (0.0, 0.0, 0.0), V)


def source_z():
    """Source position of a run along the axis."""
    return F.lit(0.0), F.lit(0.0), (F.col("run") * 150 - 500).cast("double")


def axis_residuals(spark, sf, v_ls=17.0, v_bo=19.0):
    return C.residuals_fixed_vertex(primary_showers(spark, sf), G.sensors(spark), source_z(), v_ls, v_bo)


CUBE_SQL = f"""{BASE}, {P.residuals('r', 'prim')},
b AS (SELECT CASE WHEN cable >= 1325 THEN 1 ELSE 0 END AS type,
        CASE WHEN q < 1.5 THEN 0 WHEN q < 3 THEN 1 WHEN q < 6 THEN 2 ELSE 3 END AS qbin,
        CASE WHEN d < 400 THEN 0 WHEN d < 650 THEN 1 WHEN d < 900 THEN 2 ELSE 3 END AS dbin, CAST(floor((res - ({LO})) / {DT}) AS BIGINT) AS tbin FROM r),
k AS (SELECT * FROM b WHERE tbin >= 0 AND tbin < {round((HI - LO) / DT)}),
cnt AS (SELECT type, qbin, dbin, tbin, CASE WHEN grouping(qbin) = 1 THEN 2 WHEN grouping(dbin) = 1 THEN 1 ELSE 0 END AS level, count(*) AS n
  FROM k GROUP BY GROUPING SETS ((type, qbin, dbin, tbin), (type, qbin, tbin), (type, tbin)))"""


@query("density_counts", CUBE_SQL + "SELECT * FROM cnt")
def density_counts(spark, sf):
    return U.density_counts(centre_residuals(spark, sf), LO, HI, DT)


_k = gauss_kernel(1.0 / DT)


def _conv(y):
    h = len(_k) // 2
    return " + ".join(f"{c!r}::DOUBLE * {y}" if s == 0 else f"{c!r}::DOUBLE * coalesce({'lag' if s > 0 else 'lead'}({y}, {abs(s)}) OVER w, 0)"
                      for s, c in zip(range(-h, h + 1), _k))


def _grad(y):
    return (f"CASE WHEN lag({y}) OVER w IS NULL THEN (lead({y}) OVER w - {y}) / {DT}::DOUBLE WHEN lead({y}) OVER w IS NULL THEN ({y} - lag({y}) OVER w) / {DT}::DOUBLE "
            f"ELSE (lead({y}) OVER w - lag({y}) OVER w) / (2 * {DT}::DOUBLE) END")


_WIN = "WINDOW w AS (PARTITION BY type, qbin, dbin ORDER BY tbin)"


DENSITY_SQL = CUBE_SQL + f""",
tot AS (SELECT level, type, qbin, dbin, sum(n) AS n FROM cnt GROUP BY ALL),
cells AS (SELECT t.type, q.qbin, d.dbin FROM (SELECT unnest(range(0, 2)) AS type) t, (SELECT unnest(range(0, 4)) AS qbin) q, (SELECT unnest(range(0, 4)) AS dbin) d),
ch AS (SELECT c.*, CASE WHEN (SELECT sum(n) FROM tot t WHERE t.level = 0 AND t.type = c.type AND t.qbin = c.qbin AND t.dbin = c.dbin) >= 2000 THEN 0
  WHEN (SELECT sum(n) FROM tot t WHERE t.level = 1 AND t.type = c.type AND t.qbin = c.qbin) >= 2000 THEN 1 ELSE 2 END AS level FROM cells c),
g AS (SELECT ch.*, tbin FROM ch, (SELECT unnest(range(0, {round((HI - LO) / DT)})) AS tbin)),
f AS (SELECT g.*, CAST(coalesce(c.n, 0) AS DOUBLE) AS n FROM g LEFT JOIN cnt c ON c.level = g.level AND c.type = g.type AND c.tbin = g.tbin
   AND (g.level = 2 OR c.qbin = g.qbin) AND (g.level >= 1 OR c.dbin = g.dbin)),
s AS (SELECT *, {_conv('n')} AS y FROM f {_WIN}),
l AS (SELECT *, ln(CASE WHEN max(y) OVER v <= 0 THEN 1.0 / {HI - LO} ELSE greatest(y, 1e-5 * max(y) OVER v) / (sum(y) OVER v * {DT}) END) AS logp
  FROM s WINDOW v AS (PARTITION BY type, qbin, dbin)),
a AS (SELECT *, {_grad('logp')} AS g1 FROM l {_WIN}), b1 AS (SELECT *, {_conv('g1')} AS dlogp FROM a {_WIN}),
c1 AS (SELECT *, {_grad('dlogp')} AS g2 FROM b1 {_WIN}), d1 AS (SELECT *, {_conv('g2')} AS d2logp FROM c1 {_WIN})"""


@query("density_cube", DENSITY_SQL + """
SELECT type, qbin, dbin, level, tbin, n, round(logp, 6) AS logp, round(dlogp, 6) AS dlogp, round(d2logp, 6) AS d2logp FROM d1""")
def density_cube(spark, sf):
    return rounded(U.density_cube(U.density_counts(centre_residuals(spark, sf), LO, HI, DT), LO, HI, DT))


@query("stored_cube", DENSITY_SQL + f"""
SELECT type, qbin, dbin, level, tbin, n, round(logp, 6) AS logp, round({LO} + {DT}::DOUBLE * (tbin + 0.5::DOUBLE), 6) AS tau FROM d1""")
def stored_cube(spark, sf):
    """The cube written with its range, and read again; bin centres come from the stored range."""
    root = f"{stage_root(spark)}/cube-{uuid.uuid4().hex}"
    meta = spark.range(1).select(F.lit(float(LO)).alias("lo"), F.lit(float(HI)).alias("hi"), F.lit(float(DT)).alias("dt"))
    TB.write_cube(U.density_cube(U.density_counts(centre_residuals(spark, sf), LO, HI, DT), LO, HI, DT), meta, root)
    cube, about = TB.load_cube(spark, root)
    return rounded(cube.join(F.broadcast(about)).select("type", "qbin", "dbin", "level", "tbin", "n", "logp", (F.col("lo") + F.col("dt") * (F.col("tbin") + 0.5)).alias("tau")))


@query("density_lookup", DENSITY_SQL + f""",
lx AS (SELECT run, event, CASE WHEN cable >= 1325 THEN 1 ELSE 0 END AS type, CASE WHEN q < 1.5 THEN 0 WHEN q < 3 THEN 1 WHEN q < 6 THEN 2 ELSE 3 END AS qbin,
         CASE WHEN d < 400 THEN 0 WHEN d < 650 THEN 1 WHEN d < 900 THEN 2 ELSE 3 END AS dbin,
         least(greatest((res - ({LO})) / {DT}::DOUBLE - 0.5::DOUBLE, 0), {round((HI - LO) / DT)} - 1.000001::DOUBLE) AS x FROM r)
SELECT lx.run, lx.event, count(*) AS n, round(sum(a.logp * (1 - (x - floor(x))) + b.logp * (x - floor(x))), 5) AS logp,
  round(sum(a.dlogp * (1 - (x - floor(x))) + b.dlogp * (x - floor(x))), 5) AS dlogp, round(sum(a.d2logp * (1 - (x - floor(x))) + b.d2logp * (x - floor(x))), 5) AS d2logp
FROM lx JOIN d1 a ON a.type = lx.type AND a.qbin = lx.qbin AND a.dbin = lx.dbin AND a.tbin = floor(x)
        JOIN d1 b ON b.type = lx.type AND b.qbin = lx.qbin AND b.dbin = lx.dbin AND b.tbin = floor(x) + 1 GROUP BY lx.run, lx.event""")
def density_lookup(spark, sf):
    res = centre_residuals(spark, sf)
    cube = stage(U.density_cube(U.density_counts(res, LO, HI, DT), LO, HI, DT), "cube")
    h = U.lookup_density(res, cube, "res", LO, HI, DT, ("logp", "dlogp", "d2logp"))
    return rounded(h.groupBy("run", "event").agg(F.count(F.lit(1)).alias("n"), F.sum("logp").alias("logp"),
                                                 F.sum("dlogp").alias("dlogp"), F.sum("d2logp").alias("d2logp")), 5)


#: residuals against a source on the axis, by light speeds 17 and 19 cm/ns
AXIS_SQL = f"""{BASE},
h0 AS (SELECT p.*, px, py, pz, CAST(p.run * 150 - 500 AS DOUBLE) AS z0 FROM prim p JOIN sensor s ON s.cable = p.cable WHERE p.cable < 1879 AND t IS NOT NULL AND q >= 0.3),
h1 AS (SELECT *, sqrt(px * px + py * py + (pz - z0) * (pz - z0)) AS d FROM h0),
h2 AS (SELECT *, ((pz - z0) * z0) / greatest(d, 1e-6::DOUBLE) AS ur FROM h1),
h3 AS (SELECT *, least(greatest(sqrt(greatest(ur * ur - (z0 * z0 - 422500.0::DOUBLE), 0)) - ur, 0), d) AS d_ls FROM h2),
r_tau AS (SELECT *, d - d_ls AS d_bo, t - d_ls / 17.0::DOUBLE - (d - d_ls) / 19.0::DOUBLE AS tau FROM h3),
{P.event_time('r_t', 'r_tau', 'run, event')},
r AS (SELECT h.*, CAST(floor(d_ls / 50) AS BIGINT) AS i_ls, CAST(floor(d_bo / 50) AS BIGINT) AS i_bo, h.tau - t.t_event AS res FROM r_tau h JOIN r_t t ON h.run = t.run AND h.event = t.event)"""


@query("speed_cells", AXIS_SQL + f""",
r17 AS (SELECT * FROM r WHERE cable < 1325),
{P.mode('m', 'r17', 'i_ls, i_bo', 'res', 0.5, 5, 100)}
SELECT i_ls, i_bo, n, round(mode, 6) AS mode, (i_ls + 0.5) * 50 AS x1, (i_bo + 0.5) * 50 AS x2 FROM m""")
def speed_cells(spark, sf):
    return rounded(U.speed_cells(axis_residuals(spark, sf), 50.0, 100))


def _speeds_sql(passes: int = 8) -> str:
    """The passes one after another: residuals by the present speeds, cell modes, 3 x 3 normal equations by cofactors, damped step."""
    sums = [f"sum(n * x{i} * x{j})::DOUBLE AS a{i}{j}" for i in range(3) for j in range(i, 3)] + [f"sum(n * x{i} * mode) AS b{i}" for i in range(3)]
    out = [f"""{BASE},
h0 AS (SELECT p.*, px, py, pz, CAST(p.run * 150 - 500 AS DOUBLE) AS z0 FROM prim p JOIN sensor s ON s.cable = p.cable WHERE p.cable < 1879 AND t IS NOT NULL AND q >= 0.5),
h1 AS (SELECT *, sqrt(px * px + py * py + (pz - z0) * (pz - z0)) AS d FROM h0),
h2 AS (SELECT *, ((pz - z0) * z0) / greatest(d, 1e-6::DOUBLE) AS ur FROM h1),
h3 AS MATERIALIZED (SELECT *, least(greatest(sqrt(greatest(ur * ur - (z0 * z0 - 422500.0::DOUBLE), 0)) - ur, 0), d) AS d_ls FROM h2),
v0 AS (SELECT 17.6::DOUBLE AS v_ls, 17.6::DOUBLE AS v_bo)"""]
    for i in range(passes):
        out.append(f"""tau{i} AS MATERIALIZED (SELECT h.*, t - d_ls / v_ls - (d - d_ls) / v_bo AS tau FROM h3 h CROSS JOIN v{i}),
{P.event_time(f't{i}', f'tau{i}', 'run, event')},
r{i} AS MATERIALIZED (SELECT CAST(floor(d_ls / 50) AS BIGINT) AS i_ls, CAST(floor((d - d_ls) / 50) AS BIGINT) AS i_bo, h.tau - t.t_event AS res
  FROM tau{i} h JOIN t{i} t ON h.run = t.run AND h.event = t.event WHERE h.cable < 1325),
{P.mode(f'm{i}', f'r{i}', 'i_ls, i_bo', 'res', 0.5, 5, 100)},
s{i} AS (SELECT count(*) AS n_cells, {', '.join(sums)} FROM (SELECT n, mode, 1 AS x0, (i_ls + 0.5::DOUBLE) * 50 AS x1, (i_bo + 0.5::DOUBLE) * 50 AS x2 FROM m{i})),
c{i} AS (SELECT n_cells, (b0 * (a12 * a02 - a01 * a22) + b1 * (a00 * a22 - a02 * a02) + b2 * (a01 * a02 - a00 * a12)) / det AS b_ls,
    (b0 * (a01 * a12 - a11 * a02) + b1 * (a01 * a02 - a00 * a12) + b2 * (a00 * a11 - a01 * a01)) / det AS b_bo
  FROM (SELECT *, a00 * (a11 * a22 - a12 * a12) - a01 * (a01 * a22 - a12 * a02) + a02 * (a01 * a12 - a11 * a02) AS det FROM s{i})),
w{i} AS MATERIALIZED (SELECT * FROM v{i} CROSS JOIN c{i}),
v{i + 1} AS MATERIALIZED (SELECT CASE WHEN 1 / v_ls + 0.6::DOUBLE * b_ls > 0 THEN 1 / (1 / v_ls + 0.6::DOUBLE * b_ls) ELSE v_ls END AS v_ls,
    CASE WHEN 1 / v_bo + 0.6::DOUBLE * b_bo > 0 THEN 1 / (1 / v_bo + 0.6::DOUBLE * b_bo) ELSE v_bo END AS v_bo FROM w{i})""")
    rows = [f"SELECT {i}::INTEGER AS iteration, round(v_ls, 6) AS v_ls, round(v_bo, 6) AS v_bo, round(b_ls, 6) AS b_ls, round(b_bo, 6) AS b_bo, n_cells FROM w{i}"
            for i in range(passes)]
    last = f"SELECT {passes}::INTEGER, round(v_ls, 6), round(v_bo, 6), NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT FROM v{passes}"
    return ",\n".join(out) + "\n" + "\nUNION ALL ".join([*rows, last])


@query("speeds", _speeds_sql())
def speeds(spark, sf):
    hits = stage(primary_showers(spark, sf), "primary")
    return rounded(U.fit_speeds(hits, G.sensors(spark), source_z(), 17.6, 17.6, min_cell=100))


def survey_table(spark, sf, min_hits=5):
    res = axis_residuals(spark, sf)
    sources = views.trig(spark, sf).select("run").distinct().select("run", *[c.alias(n) for c, n in zip(source_z(), ("sx", "sy", "sz"))])
    rows = U.survey_rows(U.tube_run_modes(res, min_hits), sources, G.sensors(spark), 17.0, 19.0)
    return U.survey_positions(rows)


def _survey_sql() -> str:
    """The survey by Gauss-Jordan elimination of [matrix | right side | unit matrix], one CTE per step."""
    sym = [(a, b) for a in range(4) for b in range(a, 4)]
    w = {"a": "n * ", "g": ""}
    sums = ", ".join(f"sum({w[k]}j{a} * j{b}) AS {k}{a}{b}" for k in "ag" for a, b in sym)
    sums += ", " + ", ".join(f"sum({v}j{a} * mode) AS {k}{a}" for k, v in (("b", "n * "), ("h", "")) for a in range(4))
    at = lambda k, a, b: f"{k}{min(a, b)}{max(a, b)}"
    out = f"""{AXIS_SQL},
{P.mode('m', 'r', 'run, cable', 'res', 0.5, 5, 5)},
g0 AS (SELECT m.*, px, py, pz, CAST(m.run * 150 - 500 AS DOUBLE) AS z0 FROM m JOIN sensor s ON s.cable = m.cable),
g1 AS (SELECT *, sqrt(px * px + py * py + (pz - z0) * (pz - z0)) AS d FROM g0),
g2 AS (SELECT *, ((pz - z0) * z0) / greatest(d, 1e-6::DOUBLE) AS ur FROM g1),
g3 AS (SELECT *, CASE WHEN z0 * z0 >= 422500 THEN 0 ELSE least(greatest(sqrt(greatest(ur * ur - (z0 * z0 - 422500.0::DOUBLE), 0)) - ur, 0), d) END AS d_ls FROM g2),
g4 AS (SELECT cable, n::DOUBLE AS n, mode, 1.0::DOUBLE AS j0, (px - 0) * s AS j1, (py - 0) * s AS j2, (pz - z0) * s AS j3 FROM (SELECT *, (d_ls / 17.0 + (d - d_ls) / 19.0) / (d * d) AS s FROM g3)),
sm AS (SELECT cable, count(*) AS nrun, {sums}, sum(n * mode * mode) AS yy, sum(mode * mode) AS hh FROM g4 GROUP BY cable HAVING count(*) >= 4),
e0 AS (SELECT cable, a00 / nrun AS wm, {', '.join(f"{at('a', a, b)} / (a00 / nrun){' + 1.0 / 900' if a == b > 0 else ''} AS m{a}{b}" for a in range(4) for b in range(4))},
  {', '.join(f"b{a} / (a00 / nrun) AS m{a}4" for a in range(4))}, {', '.join(f"{float(a == b)}::DOUBLE AS m{a}{5 + b}" for a in range(4) for b in range(4))} FROM sm)"""
    for k in range(4):
        row = lambda a, c: f"m{k}{c} / m{k}{k}" if a == k else f"m{a}{c} - m{a}{k} * m{k}{c} / m{k}{k}"
        out += f",\ne{k + 1} AS (SELECT cable, wm, {', '.join(f'{row(a, c)} AS m{a}{c}' for a in range(4) for c in range(9))} FROM e{k})"
    quad = lambda t, k, r: (f"greatest({t} - 2 * ({' + '.join(f'm{a}4 * {r}{a}' for a in range(4))}) + "  # noqa: E731
                            f"{' + '.join(f'm{a}4 * {at(k, a, b)} * m{b}4' for a in range(4) for b in range(4))}, 0)")
    return out + f""",
ch AS (SELECT sm.cable, nrun, m04, m14, m24, m34, m05, m16, m27, m38, greatest({quad('yy', 'a', 'b')} / greatest(nrun - 4, 1) / wm, 1e-6) AS s2, sqrt({quad('hh', 'g', 'h')} / nrun) AS rms
  FROM sm JOIN e4 ON e4.cable = sm.cable),
sv AS (SELECT cable, nrun, m04 AS dt, m14 AS dx, m24 AS dy, m34 AS dz, sqrt(m05 * s2) AS err_t, sqrt(m16 * s2) AS err_x, sqrt(m27 * s2) AS err_y, sqrt(m38 * s2) AS err_z, rms FROM ch)"""


SURVEY_SQL = _survey_sql()


@query("survey", SURVEY_SQL + " SELECT cable, nrun, " + ", ".join(f"round({c}, 4) AS {c}" for c in "dt dx dy dz err_t err_x err_y err_z rms".split()) + " FROM sv")
def survey(spark, sf):
    return rounded(survey_table(spark, sf), 4)


@query("survey_profile", SURVEY_SQL + """,
dr AS (SELECT (dx * px + dy * py + dz * pz) / sqrt(px * px + py * py + pz * pz) AS dr, least(greatest(floor((pz / sqrt(px * px + py * py + pz * pz) + 1) / (2.0 / 12)), 0), 11) AS b FROM sv JOIN sensor s ON s.cable = sv.cable)
SELECT CAST(b AS BIGINT) AS bin, round(-1 + (b + 0.5) * (2.0 / 12), 6) AS centre, count(*) AS n, round(avg(dr), 4) AS mean, round(stddev_pop(dr) / sqrt(count(*)), 4) AS err, round(stddev_pop(dr), 4) AS rms
FROM dr GROUP BY b HAVING count(*) >= 5""")
def survey_profile(spark, sf):
    return rounded(U.deformation_profile(survey_table(spark, sf), G.sensors(spark)), 4, centre=6)


@query("survey_scatter", SURVEY_SQL + """, x AS (SELECT count(*) AS n, avg(dz) AS mean, stddev_pop(dz) AS rms, median(err_z) AS median_err FROM sv)
SELECT n, round(mean, 4) AS mean, round(rms, 4) AS rms, round(median_err, 4) AS median_err, round(sqrt(greatest(rms * rms - median_err * median_err, 0)), 4) AS excess FROM x""")
def survey_scatter(spark, sf):
    return rounded(U.excess_scatter(survey_table(spark, sf), F.col("dz"), F.col("err_z")), 4)


@query("profile_costheta", f"""{BASE}, {P.residuals('r', 'prim')},
x AS (SELECT r.res, least(greatest(floor((pz / sqrt(px * px + py * py + pz * pz) + 1) / (2.0 / 12)), 0), 11) AS b FROM r JOIN sensor s ON s.cable = r.cable)
SELECT CAST(b AS BIGINT) AS bin, round(-1 + (b + 0.5) * (2.0 / 12), 6) AS centre, count(*) AS n, round(avg(res), 6) AS mean,
       round(stddev_pop(res) / sqrt(count(*)), 6) AS err, round(stddev_pop(res), 6) AS rms FROM x GROUP BY b HAVING count(*) >= 5""")
def profile_costheta(spark, sf):
    r = centre_residuals(spark, sf)
    return rounded(U.profile(r, [], G.cos_theta(F.col("px"), F.col("py"), F.col("pz")), F.col("res"), -1.0, 1.0, 12))
