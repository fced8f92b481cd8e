"""Histograms, smoothed modes and source peaks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .quantile import counted_quantiles, value_counts
from .segments import numbers, whole_groups


# ---- bins -------------------------------------------------------------------------------------------------------
def edge_count(a: float, b: float, w: float) -> int:
    """Number of edges of a half-open edge sequence from ``a`` below ``b`` in steps of ``w``."""
    return math.ceil((b - a) / w)


def uniform_bin(x: Column, lo, width, nbins) -> Column:
    """Bin index with half-open bins, the last one closed; null outside."""
    lo, width, nbins = (c if isinstance(c, Column) else F.lit(c) for c in (lo, width, nbins))
    k = F.floor((x - lo) / width)
    k = F.when((k == nbins) & (x == lo + nbins * width), nbins - 1).otherwise(k)
    return F.when((k >= 0) & (k < nbins), k.cast("long"))


def edge_bin(x: Column, edges: list[float], clip: bool = False, close_last: bool = False) -> Column:
    """Index of ``x`` in a short literal edge list (lower edge included); null outside unless ``clip``."""
    last = len(edges) - 2
    out = F.when(x < edges[0], 0 if clip else None)
    for i in range(last + 1):
        out = out.when(x < edges[i + 1], i)
    if close_last:
        out = out.when(x == edges[-1], last)
    if clip:
        out = out.when(x.isNotNull(), last)
    return out.cast("long")


def bin_lookup(df: DataFrame, x: str, edges: list[float], clip: bool = True, name: str = "bin") -> DataFrame:
    """Attach the edge-list index of ``x``."""
    return df.withColumn(name, edge_bin(F.col(x), edges, clip))


def _all_bins(df: DataFrame, keys: list[str], nbins: int, name: str) -> DataFrame:
    """Every bin of every group that occurs."""
    base = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    return base.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nbins - 1).cast("long"))).alias(name))


def hist1d(df: DataFrame, keys: list[str], x: Column, lo: float, hi: float, width: float, clip: bool = False) -> DataFrame:
    """Counts per uniform bin and group with empty bins; ``clip`` moves under- and overflow into the end bins."""
    nbins = round((hi - lo) / width)
    top = lo + nbins * width
    b = uniform_bin(F.greatest(F.least(x, F.lit(top)), F.lit(lo)) if clip else x, lo, width, nbins)
    counts = df.select(*keys, b.alias("bin")).where("bin is not null").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    return (
        _all_bins(df, keys, nbins, "bin").join(counts, [*keys, "bin"], "left")
        .select(*keys, "bin", (F.lit(lo) + F.col("bin") * width).alias("lo"), F.coalesce("n", F.lit(0)).alias("n"))
    )


def hist_edges(df: DataFrame, keys: list[str], x: Column, edges: list[float]) -> DataFrame:
    """Counts per bin of an arbitrary edge list and group, empty bins included."""
    b = edge_bin(x, edges, close_last=True)
    counts = df.select(*keys, b.alias("bin")).where("bin is not null").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    lo, hi = F.array(*map(F.lit, edges[:-1])), F.array(*map(F.lit, edges[1:]))
    return (
        _all_bins(df, keys, len(edges) - 1, "bin").join(counts, [*keys, "bin"], "left")
        .select(*keys, "bin", lo[F.col("bin").cast("int")].alias("lo"), hi[F.col("bin").cast("int")].alias("hi"),
                F.coalesce("n", F.lit(0)).alias("n"))
    )


def hist2d(df: DataFrame, keys: list[str], x: Column, y: Column, xbins: tuple, ybins: tuple, cmin: int = 1) -> DataFrame:
    """2-D counts (``bins = (lo, width, n)``) with cells below ``cmin`` left out."""
    return (
        df.select(*keys, uniform_bin(x, *xbins).alias("xbin"), uniform_bin(y, *ybins).alias("ybin"))
        .where("xbin is not null and ybin is not null")
        .groupBy(*keys, "xbin", "ybin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cmin)
    )


# ---- work along bins: every group here is a histogram, so its size is the bin count -------------------------------
def _w(part: list[str], order: str):
    return Window.partitionBy(*part).orderBy(order)


def moving_sum(df: DataFrame, part: list[str], order: str, x: str, half: int, name: str = "smoothed",
               scale: float = 1.0) -> DataFrame:
    """Centred moving sum over consecutive rows, zero beyond the ends; ``scale=1/(2*half+1)`` gives the average."""
    return df.withColumn(name, F.sum(x).over(_w(part, order).rowsBetween(-half, half)) * scale)


def gauss_kernel(sigma: float) -> list[float]:
    n = int(4 * sigma) + 1
    k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-n, n + 1)]
    return [v / sum(k) for v in k]


def gauss_smooth(df: DataFrame, part: list[str], bin: str, y: str, sigma: float, name: str = "smoothed") -> DataFrame:
    """Gaussian convolution along consecutive bins, zero beyond the ends."""
    k = gauss_kernel(sigma)
    n = len(k) // 2
    w = _w(part, bin)
    terms = [c * F.coalesce(F.lag(y, s).over(w) if s > 0 else F.lead(y, -s).over(w) if s < 0 else F.col(y), F.lit(0.0))
             for s, c in zip(range(-n, n + 1), k)]
    return df.withColumn(name, sum(terms[1:], terms[0]))


def gradient(df: DataFrame, part: list[str], bin: str, y: str, dt: float, name: str = "slope") -> DataFrame:
    """Central difference, one-sided at the ends."""
    w = _w(part, bin)
    up, dn, here = F.lead(y).over(w), F.lag(y).over(w), F.col(y)
    return df.withColumn(
        name, F.when(dn.isNull(), (up - here) / dt).when(up.isNull(), (here - dn) / dt).otherwise((up - dn) / (2 * dt)))


def local_maxima(df: DataFrame, part: list[str], bin: str, y: str, name: str = "is_peak") -> DataFrame:
    """At least the left and above the right neighbour; end bins never qualify."""
    w = _w(part, bin)
    up, dn = F.lead(y).over(w), F.lag(y).over(w)
    return df.withColumn(name, F.coalesce((F.col(y) >= dn) & (F.col(y) > up), F.lit(False)))


def parabolic_shift(y0: Column, y1: Column, y2: Column) -> Column:
    den = y0 - 2 * y1 + y2
    return F.when(den == 0, 0.0).otherwise(0.5 * (y0 - y2) / den)


def parabolic(df: DataFrame, part: list[str], bin: str, y: str, name: str = "shift") -> DataFrame:
    """Sub-bin shift of a maximum at each interior row (0 at the ends)."""
    w = _w(part, bin)
    up, dn = F.lead(y).over(w), F.lag(y).over(w)
    return df.withColumn(name, F.coalesce(parabolic_shift(dn, F.col(y), up), F.lit(0.0)))


def argmax_first(k: Column, v: Column) -> Column:
    """The smallest ``k`` among those with the largest ``v`` (aggregate)."""
    return F.max_by(k, F.struct(v, -k))


# ---- modes ----------------------------------------------------------------------------------------------------------
def _modes(group: np.ndarray, k: np.ndarray, c: np.ndarray, nb: np.ndarray, half: int) -> np.ndarray:
    """First largest moving sum of each group's bin counts, in bins and refined by a parabola through its neighbours.

    ``k`` are the occupied bins, rising in each group; ``nb`` is the number of bins per group. Sums are differences of
    running counts, so empty bins cost nothing.
    """
    start = np.flatnonzero(np.diff(group, prepend=-1))
    apart = int(nb.max()) + 4 * half + 4                     # groups lie side by side and never reach each other's bins
    place, upto = group * apart + k, np.append(0, np.cumsum(c))

    def moving(g: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = upto[np.searchsorted(place, g * apart + b + half, "right")] - upto[np.searchsorted(place, g * apart + b - half, "left")]
        return np.where((b >= 0) & (b < nb[g]), s, 0)

    sums = [(k + d, moving(group, k + d)) for d in range(-half, half + 1)]
    top = np.max([np.maximum.reduceat(s, start) for _, s in sums], axis=0)
    far = np.iinfo(np.int64).max
    best = np.min([np.minimum.reduceat(np.where((s == top[group]) & (b >= 0) & (b < nb[group]), b, far), start) for b, s in sums], axis=0)
    every = np.arange(len(start))
    y0, y1, y2 = (moving(every, best + d) for d in (-1, 0, 1))
    den = y0 - 2 * y1 + y2
    shift = np.where((best > 0) & (best < nb - 1) & (den != 0), 0.5 * (y0 - y2) / np.where(den == 0, 1, den), 0.0)
    return best + 0.5 + shift


def _peak_position(binned: DataFrame, keys: list[str], width: float, half: int, name: str) -> DataFrame:
    """Mode per group from rows (keys, _n, _a, _nb, _k, _c): counts per bin are shuffled, one task has the bins of a group.

    The bins of a group are worked through in order as Arrow columns, many groups at once.
    """
    counts = binned.groupBy(*keys, "_k").agg(F.sum("_c").alias("_c"), F.first("_a").alias("_a"), F.first("_nb").alias("_nb"), F.first("_n").alias("_n"))
    dealt = (counts.repartition(*keys) if keys else counts.repartition(1)).sortWithinPartitions(*keys, "_k")
    out = T.StructType([*[counts.schema[k] for k in keys], counts.schema["_a"], counts.schema["_n"], T.StructField("_at", T.DoubleType())])

    def run(batches):
        for t, first in whole_groups(batches, keys):
            at = _modes(np.cumsum(first) - 1, numbers(t, "_k"), numbers(t, "_c"), numbers(t, "_nb")[first], half)
            yield from t.filter(pa.array(first)).select([*keys, "_a", "_n"]).append_column("_at", pa.array(at)).combine_chunks().to_batches()

    return dealt.mapInArrow(run, out).select(*keys, F.col("_n").alias("n"), (F.col("_a") + width * F.col("_at")).alias(name))


def grouped_mode(df: DataFrame, keys: list[str], x: Column, width: float = 0.5, smooth: int = 5, min_count: int = 1,
                 name: str = "mode", edges: tuple[float, float] | None = None) -> DataFrame:
    """Peak of the smoothed histogram of ``x`` per group (A9); with ``edges`` the binning is fixed.

    Only bin counts are shuffled; a hot group is pre-counted per bin in every task. The counted values are written once: they enter four times,
    and as one plan the rows that they come from would be worked out more than once.
    """
    v = stage(value_counts(df, keys, x), "values")
    if edges is None:
        q = counted_quantiles(v, keys, {"_p01": 0.01, "_p99": 0.99}, "_n", min_count)
        a = F.col("_p01") - width
        q = q.select(*keys, "_n", a.alias("_a"), (F.ceil((F.col("_p99") + 2 * width - a) / width) - 1).alias("_nb"))
    else:
        nb = edge_count(edges[0], edges[1], width) - 1
        q = v.groupBy(*keys).agg(F.sum("_c").alias("_n")).where(F.col("_n") >= min_count)
        q = q.withColumn("_a", F.lit(float(edges[0]))).withColumn("_nb", F.lit(nb).cast("long"))
    binned = v.join(q, keys).withColumn("_k", uniform_bin(F.col("_v"), F.col("_a"), width, F.col("_nb")))
    return _peak_position(binned.where("_k is not null"), keys, width, smooth // 2, name)


def source_peak(df: DataFrame, keys: list[str], nhit: Column, width: int = 10, min_frac: float = 0.1,
                smooth: int = 3) -> DataFrame:
    """Position of the source peak in a multiplicity spectrum and its inclusive 0.8-1.2 window.

    The highest-lying local maximum that reaches ``min_frac`` of the tallest smoothed bin.
    """
    v = df.select(*keys, nhit.cast("double").alias("_x")).where("_x > 0")
    counts = v.groupBy(*keys, F.floor(F.col("_x") / width).alias("_k")).agg(F.count(F.lit(1)).alias("_c"), F.max("_x").alias("_mx"))
    size = counts.groupBy(*keys).agg((F.ceil((F.max("_mx") + 2 * width) / width) - 1).alias("_nb"))
    half = smooth // 2
    sm = (
        counts.join(size, keys)
        .select(*keys, "_nb", "_c", F.explode(F.sequence(F.col("_k") - half, F.col("_k") + half)).alias("_k"))
        .where((F.col("_k") >= 0) & (F.col("_k") < F.col("_nb")))
        .groupBy(*keys, "_k").agg(F.sum("_c").alias("_s"), F.first("_nb").alias("_nb"))
    )
    g = sm.groupBy(*keys).agg(
        F.max("_s").alias("_top"), argmax_first(F.col("_k"), F.col("_s")).alias("_k1"), F.first("_nb").alias("_nb"),
        F.map_from_entries(F.collect_list(F.struct("_k", "_s"))).alias("_m"))
    at = lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0))
    is_peak = lambda k: ((k > 0) & (k < F.col("_nb") - 1) & (at(k) >= min_frac * F.col("_top"))
                         & (at(k) >= at(k - 1)) & (at(k) > at(k + 1)))
    g = g.withColumn("_k", F.coalesce(F.array_max(F.filter(F.map_keys("_m"), is_peak)), F.col("_k1")))
    k = F.col("_k")
    shift = F.when((k > 0) & (k < F.col("_nb") - 1), parabolic_shift(at(k - 1), at(k), at(k + 1))).otherwise(0.0)
    g = g.select(*keys, (width * (k + 0.5 + shift)).alias("peak"))
    return g.select(*keys, "peak", (0.8 * F.col("peak")).cast("long").alias("nhit_min"),
                    (1.2 * F.col("peak")).cast("long").alias("nhit_max"))
