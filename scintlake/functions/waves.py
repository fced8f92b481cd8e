"""Waveform expressions on array columns: smoothing, pulses, baseline, quality.

A waveform stays one row: nothing is exploded and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SATURATED = 1023


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _at(w: Column, i) -> Column:
    return F.get(w, i)


def _near(w: Column, i: Column, lo: int, hi: int) -> Column:
    terms = [_at(w, i + k) for k in range(lo, hi + 1)]
    return sum(terms[1:], terms[0])


def running_mean_sum(w: Column) -> Column:
    """Running sum of the five-point derivative, in closed form.

    Away from the ends the derivative telescopes into the five-sample mean around each sample, so no running state
    is needed; ``w`` has at least 8 samples.
    """
    n = F.size(w)
    off = _at(w, F.lit(1)) + (_at(w, F.lit(3)) - _at(w, F.lit(0))) / 3 - _near(w, F.lit(2), -2, 2) / 5
    inner = lambda i: off + _near(w, i, -2, 2) / 5
    pre_last = inner(n - 3) + (_at(w, n - 1) - _at(w, n - 4)) / 3

    def value(v: Column, i: Column) -> Column:
        return (
            F.when(i <= 1, v)
            .when(i == 2, _at(w, F.lit(1)) + (_at(w, F.lit(3)) - _at(w, F.lit(0))) / 3)
            .when(i <= n - 3, inner(i))
            .when(i == n - 2, pre_last)
            .otherwise(pre_last + v - _at(w, n - 2))
        )
    return F.transform(w, value)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row (a plain column would be inlined into inner lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def smooth(df: DataFrame, samples: str = "samples", name: str = "smoothed") -> DataFrame:
    """Smoothed waveform whose area equals the area of the input."""
    w = F.col(samples)
    level = lambda y: let((total(w) - total(y)) / F.size(w), lambda s: F.transform(y, lambda v: v + s))
    return df.withColumn(name, let(running_mean_sum(w), level))


def positive_regions(y: Column) -> Column:
    """Contiguous stretches above zero as an array of (start, stop, area, peak)."""
    idx = F.sequence(F.lit(0), F.size(y) - 1)
    on = lambda i: F.coalesce(_at(y, i) > 0, F.lit(False))
    starts = F.filter(idx, lambda i: on(i) & ~(F.when(i > 0, on(i - 1)).otherwise(F.lit(False))))
    stops = F.filter(idx, lambda i: on(i) & ~on(i + 1))

    def region(s: Column, e: Column) -> Column:
        part = F.slice(y, s + 1, e - s + 1)
        return F.struct(s.alias("start"), e.alias("stop"), total(part).alias("area"), F.array_max(part).alias("peak"))
    return F.zip_with(starts, stops, region)


def pulses(df: DataFrame, samples: str = "samples", min_height: float = 5.0, cfd: float = 0.5, noise: float = 0.15,
           raw: str | None = None) -> DataFrame:
    """Pulse quantities per waveform (A40). Times are in samples; null times and zero charges when nothing is found."""
    d = smooth(df, samples, "_y").withColumn("_r", F.filter(positive_regions(F.col("_y")), lambda r: r["peak"] >= min_height))
    area = lambda c: F.aggregate(c, F.lit(0.0), lambda s, r: s + r["area"])
    d = d.withColumn("_k", let(area(F.col("_r")), lambda t: F.filter("_r", lambda r: r["area"] >= noise * t)))
    d = d.withColumn("_f", F.get("_k", F.lit(0))).withColumn("_n", F.size(samples))
    y, f = F.col("_y"), F.col("_f")
    part = F.slice(y, f["start"] + 1, f["stop"] - f["start"] + 1)
    d = d.withColumn("_p", (f["start"] + F.array_position(part, f["peak"]) - 1).cast("int"))
    p = F.col("_p")
    y0, y1, y2 = _at(y, F.greatest(p - 1, F.lit(0))), _at(y, p), _at(y, F.least(p + 1, F.col("_n") - 1))
    den = y0 - 2 * y1 + y2
    delta = F.when(F.abs(den) > 1e-9, 0.5 * (y0 - y2) / den).otherwise(0.0)
    thr = cfd * f["peak"]
    d = d.withColumn("_c", F.get(F.filter(F.sequence(f["start"], p), lambda i: _at(y, i) >= thr), F.lit(0)))
    c = F.col("_c")
    ya, yb = _at(y, F.greatest(c - 1, F.lit(0))), _at(y, c)
    frac = F.when(yb - ya > 1e-9, F.least(F.greatest((thr - ya) / (yb - ya), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    found = f.isNotNull()
    sat = F.exists(F.col(raw or samples), lambda v: v >= SATURATED)
    keep = [x for x in df.columns]
    return d.select(
        *keep, found.alias("found"), F.size("_k").alias("npulse"), area(F.col("_k")).alias("q_total"),
        F.coalesce(f["area"], F.lit(0.0)).alias("q_first"), F.coalesce(f["peak"], F.lit(0.0)).alias("height"),
        F.coalesce(F.array_max(F.transform("_k", lambda r: r["peak"])), F.lit(0.0)).alias("height_max"),
        f["start"].cast("double").alias("t_lead"),
        F.when(c > f["start"], c - 1 + frac).otherwise(c.cast("double")).alias("t_cfd"),
        (p + F.least(F.greatest(delta, F.lit(-1.0)), F.lit(1.0))).alias("t_peak"), sat.alias("saturated"))


def baseline(df: DataFrame, samples: str = "samples", name: str = "baseline") -> DataFrame:
    """Mean of the flat, low samples, with the fallbacks for waveforms that have none."""
    w, n = F.col(samples), F.size(samples)
    triple = F.transform(F.sequence(F.lit(1), n - 2), lambda i: (_at(w, i - 1) + _at(w, i) + _at(w, i + 1)) / 3)
    d = df.withColumn("_ra", triple).withColumn("_lo", F.array_min("_ra")).withColumn("_rng", F.array_max("_ra") - F.col("_lo"))

    def slope(i: Column) -> Column:
        wide = (_at(w, i + 4) - _at(w, i - 3)) / 7
        return (
            F.when(i == 0, _at(w, F.lit(1)) - _at(w, F.lit(0))).when(i == 1, (_at(w, F.lit(3)) - _at(w, F.lit(0))) / 3)
            .when(i == 2, (_at(w, F.lit(5)) - _at(w, F.lit(0))) / 5).when(i <= n - 5, wide)
            .when(i == n - 4, (_at(w, n - 1) - _at(w, n - 6)) / 5).when(i == n - 3, (_at(w, n - 1) - _at(w, n - 4)) / 3)
            .when(i == n - 2, _at(w, n - 1) - _at(w, n - 2))
        )
    limit = F.greatest(F.col("_rng") * 0.05, F.lit(10.0)) + F.col("_lo")
    flat = lambda i: F.coalesce(F.abs(slope(i)) <= F.col("_rng") * F.when(i < 10, 0.01).otherwise(0.001), F.lit(True))
    good = F.filter(w, lambda v, i: (v <= limit) & flat(i))
    d = d.withColumn("_good", good).withColumn("_sum", total(w))
    other = F.when(F.col("_sum") < 0, F.col("_sum") / n).when(F.col("_lo") > 0, F.col("_lo")).otherwise(0.0)
    return d.withColumn(name, F.when(F.size("_good") > 0, total(F.col("_good")) / F.size("_good")).otherwise(other)) \
        .drop("_ra", "_lo", "_rng", "_good", "_sum")


def subtract(samples: Column, level: Column) -> Column:
    """Samples minus a constant level."""
    return F.transform(samples, lambda v: v - level)


def subtract_pedestal(samples: Column, pedestal: Column) -> Column:
    """Samples minus a pedestal array (zeros when it is null)."""
    return F.when(pedestal.isNull(), samples).otherwise(F.zip_with(samples, pedestal, lambda a, b: a - b))


def zero_saturated(samples: Column, raw: Column) -> Column:
    """Saturated samples set to zero before the charge sum (P25)."""
    return F.zip_with(samples, raw, lambda v, r: F.when(r >= SATURATED, 0.0).otherwise(v))


def is_saturated(raw: Column) -> Column:
    return F.exists(raw, lambda v: v >= SATURATED)


def is_flat(samples: Column, spread: float = 50, step: float = 40) -> Column:
    """Pedestal quality: small range and no step."""
    n = F.size(samples)
    steps = F.zip_with(F.slice(samples, F.lit(2), n - 1), F.slice(samples, F.lit(1), n - 1), lambda b, a: F.abs(b - a))
    return (F.array_max(samples) - F.array_min(samples) < spread) & F.forall(steps, lambda s: s <= step)


def pedestal_candidate(gain: Column, launch: Column) -> Column:
    return (gain < 3) & (F.abs(launch) <= 1)
