"""Fits to small histograms: exponential plus flat, and Gaussian peak plus flat (A32, A33, C20, C21, UD3).

Spark counts. Both fits are column expressions: the exponential in one row per group and lifetime, the peak in one row per
group over the bins around its fullest place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hist import edge_count, uniform_bin


def _bins(df: DataFrame, keys: list[str], b: Column) -> DataFrame:
    return df.select(*keys, b.alias("bin")).where("bin is not null").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


# ---- exponential plus flat -----------------------------------------------------------------------------------------
#: rounds of reweighting, and the least amplitude and background
ROUNDS, LEAST = 60, 1e-6


def _expected(a: Column, b: Column, e: Column) -> Column:
    return F.greatest(a * e + b, F.lit(1e-9))


def _round(now: Column) -> Column:
    """One round for a row with shape ``_e`` and counts ``_y``: weighted linear regression of the counts on shape and constant.

    The weights are the inverse of the last round's expectation, which leads to the Poisson maximum. A bound that is hit
    fixes its term and leaves the other one.
    """
    sums = ("aa", "ab", "bb", "ya", "yb")

    def add(s: Column, x: Column) -> Column:
        e, y = x["_e"], x["_y"]
        mu = _expected(now["a"], now["b"], e)
        return F.struct(*[(s[k] + v / mu).alias(k) for k, v in zip(sums, (e * e, e, F.lit(1.0), e * y, y), strict=True)])

    def solve(s: Column) -> Column:
        det = s["aa"] * s["bb"] - s["ab"] * s["ab"]
        det = F.when(det > 0, det).otherwise(1.0)
        a = (s["bb"] * s["ya"] - s["ab"] * s["yb"]) / det
        b = (s["aa"] * s["yb"] - s["ab"] * s["ya"]) / det
        only_a, only_b = (s["ya"] - s["ab"] * LEAST) / s["aa"], (s["yb"] - s["ab"] * LEAST) / s["bb"]
        low = F.lit(LEAST)
        return (F.when(a < LEAST, F.struct(low.alias("a"), F.greatest(only_b, low).alias("b")))
                .when(b < LEAST, F.struct(F.greatest(only_a, low).alias("a"), low.alias("b")))
                .otherwise(F.struct(a.alias("a"), b.alias("b"))))

    return F.aggregate(F.arrays_zip("_e", "_y"), F.struct(*[F.lit(0.0).alias(k) for k in sums]), add, solve)


def decay_fit(df: DataFrame, keys: list[str], dt: Column, dt_min: float, window: float, width: float = 20.0,
              taus: tuple = (50.0, 600.0, 1.0), tasks: int = 32) -> DataFrame:
    """Lifetime, amplitude and background of A exp(-dt/tau) + B per group.

    A group is its bins, and every lifetime of the grid a row of its own, dealt over ``tasks``: the fit is a fold over
    ``ROUNDS`` rounds inside that row. The lifetime's error is half the width of the range within 0.5 of the best -lnL.
    """
    nb = edge_count(dt_min, window + 1e-6, width) - 1
    grid = np.arange(*taus).tolist()
    h = _bins(df, keys, uniform_bin(dt, dt_min, width, nb))
    y = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    bins = F.sequence(F.lit(0), F.lit(nb - 1))
    rows = (
        h.groupBy(*keys).agg(y.alias("_m"), F.sum("n").alias("n"))
        .select(*keys, "n", F.transform(bins, lambda k: F.coalesce(F.element_at("_m", k.cast("long")), F.lit(0)).cast("double")).alias("_y"),
                F.explode(F.array(*[F.lit(t) for t in grid])).alias("tau"))
        .repartition(tasks, *keys, "tau")
        .withColumn("_e", F.transform(bins, lambda k: F.exp(-(dt_min + width * (k + 0.5)) / F.col("tau"))))
    )
    level = F.greatest(F.col("n") / nb, F.lit(1e-3))
    fit = rows.withColumn("_f", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(level.alias("a"), level.alias("b")), lambda now, _: _round(now)))

    def cost(s: Column, x: Column) -> Column:
        mu = _expected(F.col("_f.a"), F.col("_f.b"), x["_e"])
        return s + mu - x["_y"] * F.log(mu)

    shape = F.aggregate("_e", F.lit(0.0), lambda s, e: s + e)
    fit = fit.select(*keys, "n", "tau", F.col("_f.a").alias("a"), F.col("_f.b").alias("b"), (F.col("_f.a") * shape).alias("n_signal"),
                     (F.col("_f.b") * nb).alias("n_background"), F.aggregate(F.arrays_zip("_e", "_y"), F.lit(0.0), cost).alias("nll"))
    # a group has one row per lifetime here
    fit = fit.withColumn("_least", F.min("nll").over(Window.partitionBy(*keys)))
    inside = F.when(F.col("nll") <= F.col("_least") + 0.5, F.col("tau"))
    names = ("n", "tau", "a", "b", "n_signal", "n_background", "nll")
    best = fit.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct("nll", "tau")).alias("_best"), F.min(inside).alias("_lo"), F.max(inside).alias("_hi"))
    error = F.when(F.col("_hi") > F.col("_lo"), 0.5 * (F.col("_hi") - F.col("_lo"))).alias("tau_err")
    return best.select(*keys, "_best.n", "_best.tau", error, *[f"_best.{c}" for c in names[2:]])


# ---- Gaussian peak plus flat -------------------------------------------------------------------------------------------
#: rounds of the search for centre and width
PEAK_ROUNDS = 60
#: places that a round compares, in steps of the present size: where it stands first, so that it stays on a tie
STENCIL = [(0, 0), *[(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]]


def _heights(bins: Column, centre: Column, width: Column) -> Column:
    """(height, level, cost) of the best unit Gaussian plus constant through bins (x, y), weighted by 1 / max(y, 1); none is negative."""
    sums = ("uu", "u", "one", "uy", "y", "yy")

    def add(s: Column, b: Column) -> Column:
        w, z = 1 / F.greatest(b["y"], F.lit(1.0)), (b["x"] - centre) / width
        u = F.exp(-z * z / 2)
        return F.struct(*[(s[k] + w * v).alias(k) for k, v in zip(sums, (u * u, u, F.lit(1.0), u * b["y"], b["y"], b["y"] * b["y"]), strict=True)])

    def solve(s: Column) -> Column:
        det = s["uu"] * s["one"] - s["u"] * s["u"]
        height = (s["one"] * s["uy"] - s["u"] * s["y"]) / F.when(det > 0, det).otherwise(1.0)
        level = (s["uu"] * s["y"] - s["u"] * s["uy"]) / F.when(det > 0, det).otherwise(1.0)
        flat = F.struct(F.lit(0.0).alias("height"), (s["y"] / s["one"]).alias("level"))
        bare = F.struct((s["uy"] / s["uu"]).alias("height"), F.lit(0.0).alias("level"))
        both = F.struct(height.alias("height"), level.alias("level"))
        # a Gaussian that no constant can be told from leaves the constant
        return F.struct(s.alias("s"), F.when((det <= 1e-12 * s["uu"] * s["one"]) | (height < 0), flat).when(level < 0, bare).otherwise(both).alias("f"))

    def cost(r: Column) -> Column:
        s, a, b = r["s"], r["f"]["height"], r["f"]["level"]
        left = s["yy"] - 2 * a * s["uy"] - 2 * b * s["y"] + a * a * s["uu"] + 2 * a * b * s["u"] + b * b * s["one"]
        return F.struct(left.alias("cost"), a.alias("height"), b.alias("level"))

    folded = F.aggregate(bins, F.struct(*[F.lit(0.0).alias(k) for k in sums]), add, solve)
    return F.element_at(F.transform(F.array(folded), cost), 1)


def _searched(bins: Column, centre: Column, width: float, reach: float, sigma: float) -> Column:
    """Centre and width of least cost: the best of nine places a round, half the step when the middle one is best."""
    def place(now: Column, o: int) -> Column:
        i, j = STENCIL[o]
        return F.struct((now["mu"] + i * now["step"]).alias("mu"), F.least(F.greatest(now["sigma"] + j * now["step"], F.lit(0.3 * width)), F.lit(reach)).alias("sigma"))

    def turn(now: Column, _: Column) -> Column:
        tried = F.transform(F.array(*[place(now, o) for o in range(len(STENCIL))]), lambda p, o: F.struct(
            _heights(bins, p["mu"], p["sigma"])["cost"].alias("cost"), o.alias("o"), p["mu"].alias("mu"), p["sigma"].alias("sigma")))
        pick = lambda b: F.struct(b["mu"].alias("mu"), b["sigma"].alias("sigma"), F.when(b["o"] == 0, now["step"] / 2).otherwise(now["step"]).alias("step"))
        return F.element_at(F.transform(F.array(F.array_min(tried)), pick), 1)

    start = F.struct(centre.alias("mu"), F.lit(float(sigma)).alias("sigma"), F.lit(float(width)).alias("step"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(PEAK_ROUNDS)), start, turn)


def peak_fit(df: DataFrame, keys: list[str], x: Column, width: float = 10.0, half_range: float = 300.0, sigma: float = 30.0, min_count: int = 10) -> DataFrame:
    """Peak position, width and background fraction per group (A33); nulls below ``min_count`` entries.

    Bins start one width below the group's minimum; a group with fewer than four bins has some centre that fits them. The fit takes those within ``half_range`` of the fullest place (three
    bins together). Height and level are the linear optimum for a centre and width, which are searched on a shrinking
    lattice in ``PEAK_ROUNDS`` rounds. Only bin counts are shuffled; the fit is a fold in one row per group over at most
    2 ``half_range`` / ``width`` + 1 bins, however many entries or how wide a range the group has.
    """
    v = df.select(*keys, x.cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    lim = v.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    b = v.join(lim, same).select(*keys, "_x", (F.col("_lo") - width).alias("_a"), "_hi")
    b = b.withColumn("_nb", F.ceil((F.col("_hi") + 2 * width - F.col("_a")) / width) - 1)
    h = b.withColumn("_k", uniform_bin(F.col("_x"), F.col("_a"), width, F.col("_nb"))).groupBy(*keys, "_k").agg(
        F.count(F.lit(1)).alias("_n"), F.first("_a").alias("_a"), F.first("_nb").alias("_nb"))
    own = F.when(F.col("_k") == F.col("_own"), F.col("_n"))
    three = (h.select(*keys, "_a", "_nb", "_n", F.col("_k").alias("_own"), F.explode(F.sequence(F.col("_k") - 1, F.col("_k") + 1)).alias("_k"))
             .where("_k >= 0 and _k < _nb").groupBy(*keys, "_k")
             .agg(F.sum("_n").alias("_s"), F.sum(own).alias("_n"), F.first("_a").alias("_a"), F.first("_nb").alias("_nb")))
    top = three.groupBy(*keys).agg(F.min(F.struct((-F.col("_s")).alias("s"), "_k", "_a", "_nb")).alias("_t"), F.sum("_n").alias("n"))
    top = top.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "n", F.col("_t._k").alias("_top"), F.col("_t._a").alias("_a"), F.col("_t._nb").alias("_nb"))
    reach = int(half_range / width)
    near = h.select(*keys, "_k", "_n").join(top, same).where(F.abs(F.col("_k") - F.col("_top")) <= reach)
    rows = near.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_n"))).alias("_m"), *[F.first(c).alias(c) for c in ("n", "_top", "_a", "_nb")])
    bins = F.transform(F.sequence(F.greatest(F.col("_top") - reach, F.lit(0)), F.least(F.col("_top") + reach, F.col("_nb") - 1)), lambda k: F.struct(
        (F.col("_a") + width * (k + 0.5)).alias("x"), F.coalesce(F.try_element_at("_m", k), F.lit(0)).cast("double").alias("y")))
    rows = rows.withColumn("_b", F.when(F.col("n") >= min_count, bins))
    rows = rows.withColumn("_p", _searched(F.col("_b"), F.col("_a") + width * (F.col("_top") + 0.5), width, half_range, sigma))
    rows = rows.withColumn("_f", _heights(F.col("_b"), F.col("_p.mu"), F.col("_p.sigma")))
    fitted = F.col("n") >= min_count
    inside = F.col("_f.height") * F.col("_p.sigma") * float(np.sqrt(2 * np.pi)) / width
    below = F.col("_f.level") * 6 * F.col("_p.sigma") / width
    return rows.select(*keys, "n", F.when(fitted, F.col("_p.mu")).alias("mu"), F.when(fitted, F.col("_p.sigma")).alias("sigma"),
                       F.when(fitted, inside).otherwise(0.0).alias("n_peak"), F.when(fitted, F.col("_f.level")).alias("bkg_per_bin"),
                       F.when(fitted, below / F.greatest(below + 0.997 * inside, F.lit(1e-9))).alias("bkg_frac"))
