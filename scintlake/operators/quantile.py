"""Exact grouped quantiles that never hold a whole group in one task (A10).

The built-in exact percentile keeps every distinct value of a group in one aggregation buffer. Here the values are
first counted per (group, value), which spreads a hot group over all tasks; a coarse monotone bucket of the value
then locates the wanted ranks. A bucket that holds a wanted rank and more than ``FULL`` values is split again over the
range of its own values, ``SPLITS`` times, and only the pieces that contain a wanted rank are sorted.

How much one task sorts: a bucket spans 0.07 % of its value, where doubles lie evenly, and a piece spans about
``FULL`` / (values of the bucket) of that. Two splits take a bucket of 10**9 values over 65,536 pieces each to pieces of
some hundred values, also when all of them crowd in a small part of the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: buckets per factor of e in |value|; about 0.07 % wide
BUCKETS_PER_E = 1477.0
#: values of a bucket from which it is split, pieces of a split at most, and splits one after another
FULL, PIECES, SPLITS = 256, 1 << 16, 2


def _bucket(x: Column) -> Column:
    return F.floor(F.signum(x) * F.log1p(F.abs(x)) * BUCKETS_PER_E)


def value_counts(df: DataFrame, keys: list[str], x: Column) -> DataFrame:
    """Rows per (group, value): columns ``_v`` and ``_c``. Combined map-side, so repeated values cost nothing.

    Groups with a null key are left out here, once, so that every later use sees the same plan and Spark reuses the
    shuffle.
    """
    known = F.col("_v").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    return (
        df.select(*keys, x.cast("double").alias("_v")).where(known)
        .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    )


def exact_quantiles(df: DataFrame, keys: list[str], x: Column, probs: dict[str, float], count: str = "n",
                    min_count: int = 1) -> DataFrame:
    """Linear-interpolated quantiles of the non-null ``x`` per group, with the group size in ``count``."""
    return counted_quantiles(value_counts(df, keys, x), keys, probs, count, min_count)


def _rank(p: float) -> Column:
    return F.lit(p) * (F.col("_n") - 1)


def _wanted(probs: dict[str, float]) -> Column:
    """Whether the ranks from ``_lo`` up to ``_hi`` have one that a quantile stands on or leans on."""
    out = F.lit(False)
    for p in probs.values():
        k = F.floor(_rank(p))
        for at in (k, F.least(k + 1, F.col("_n") - 1)):
            out = out | ((at >= F.col("_lo")) & (at < F.col("_hi")))
    return out


def _piece() -> Column:
    """Monotone part of a bucket, by the range of its values; 0 if the bucket isn't full."""
    pieces = F.least(F.ceil(F.col("_d") / FULL), F.lit(PIECES))
    part = (F.col("_v") - F.col("_least")) / (F.col("_most") - F.col("_least"))
    return F.when(F.col("_d") > FULL, F.least(F.floor(part * pieces), pieces - 1)).otherwise(F.lit(0)).cast("long")


def located(counts: DataFrame, keys: list[str], probs: dict[str, float], min_count: int = 1) -> DataFrame:
    """The values that are left to sort: those of pieces ``_b0`` ... with a wanted rank, and the ranks ``_lo`` before the piece."""
    v = counts.withColumn("_b0", _bucket(F.col("_v")))
    for level in range(SPLITS + 1):
        inner, cell = f"_b{level}", [*keys, *[f"_b{i}" for i in range(level)]]
        whole = Window.partitionBy(*cell) if cell else Window.partitionBy(F.lit(0))
        upto = F.sum("_bc").over(whole.orderBy(inner).rowsBetween(Window.unboundedPreceding, 0))
        # buckets inside a cell: ranks before the cell, and size of the group, are those of the level above
        known = [F.first("_lo").alias("_base"), F.first("_n").alias("_n")] if level else []
        b = v.groupBy(*cell, inner).agg(F.sum("_c").alias("_bc"), F.count(F.lit(1)).alias("_d"),
                                        F.min("_v").alias("_least"), F.max("_v").alias("_most"), *known)
        base, n = (F.col("_base"), F.col("_n")) if level else (F.lit(0), F.sum("_bc").over(whole))
        b = b.select(*cell, inner, "_d", "_least", "_most", (base + upto - F.col("_bc")).alias("_lo"), (base + upto).alias("_hi"), n.alias("_n"))
        if not level:
            b = b.where(F.col("_n") >= min_count)
        v = v.select(*cell, inner, "_v", "_c").join(b.where(_wanted(probs)), [*cell, inner])
        if level < SPLITS:
            v = v.withColumn(f"_b{level + 1}", _piece())
    return v


def counted_quantiles(counts: DataFrame, keys: list[str], probs: dict[str, float], count: str = "n",
                      min_count: int = 1) -> DataFrame:
    """:func:`exact_quantiles` from a table of :func:`value_counts`."""
    piece = [f"_b{i}" for i in range(SPLITS + 1)]
    in_piece = Window.partitionBy(*keys, *piece).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    s = (
        located(counts, keys, probs, min_count).withColumn("_end", F.col("_lo") + F.sum("_c").over(in_piece))
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )
    aggs = [F.max("_n").alias(count)]
    for name, p in probs.items():
        k = F.floor(_rank(p))
        k1 = F.least(k + 1, F.col("_n") - 1)
        at = F.max(F.when((k >= F.col("_start")) & (k < F.col("_end")), F.col("_v")))
        up = F.max(F.when((k1 >= F.col("_start")) & (k1 < F.col("_end")), F.col("_v")))
        frac = F.max(_rank(p) - k)
        aggs.append((at + (up - at) * frac).alias(name))
    return s.groupBy(*keys).agg(*aggs)


def grouped_median(df: DataFrame, keys: list[str], x: Column, name: str = "median", min_count: int = 1) -> DataFrame:
    return exact_quantiles(df, keys, x, {name: 0.5}, min_count=min_count)


def robust_sigma(df: DataFrame, keys: list[str], x: Column, name: str = "sigma") -> DataFrame:
    """Per group: size, median and 1.4826 x the median absolute deviation. Without keys the median enters as a scalar."""
    v = df.select(*keys, x.alias("_x"))
    med = exact_quantiles(v, keys, F.col("_x"), {"median": 0.5})
    dev = v.join(med.select(*keys, "median"), keys) if keys else v.withColumn("median", med.select("median").scalar())
    mad = exact_quantiles(dev, keys, F.abs(F.col("_x") - F.col("median")), {"_mad": 0.5}, count="_m")
    out = mad.select(*keys, (1.4826 * F.col("_mad")).alias(name))
    return med.join(out, keys).select(*keys, "n", "median", name) if keys else med.select("n", "median", out.scalar().alias(name))


def approx_quantiles(df: DataFrame, keys: list[str], x: Column, probs: dict[str, float], accuracy: int = 10000) -> DataFrame:
    """Opt-in sketch variant for exploratory work."""
    return df.groupBy(*keys).agg(*[F.percentile_approx(x, p, accuracy).alias(n) for n, p in probs.items()])
