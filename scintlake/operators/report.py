"""Summaries of reconstructed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .fits import peak_fit
from .hist import source_peak
from .quantile import exact_quantiles, grouped_median, robust_sigma


def medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Group size and exact median of each column (nulls of a column do not count for it)."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    for c in columns:
        n = n.join(exact_quantiles(df, keys, F.col(c), {f"median_{c}": 0.5}, count="_m").drop("_m"), keys, "left")
    return n


def run_summary(events: DataFrame, columns: list[str], keys: list[str] | None = None, source_z: float | None = None) -> DataFrame:
    """Per run: counts, medians and robust z width for all fitted and for source-like events."""
    keys = keys or ["run"]
    ok = events.where("vertex_ok")
    peak = source_peak(ok, keys, F.col("nhit")).select(*keys, "peak")
    like = ok.join(peak, keys).where((F.col("nhit") > 0.8 * F.col("peak")) & (F.col("nhit") < 1.2 * F.col("peak"))).drop("peak")
    both = ok.withColumn("selection", F.lit("all fitted")).unionByName(like.withColumn("selection", F.lit("source-like")))
    by = [*keys, "selection"]
    s = medians(both, by, columns).join(robust_sigma(both, by, F.col("z"), "robust_sigma_z").select(*by, "robust_sigma_z"), by)
    return s if source_z is None else s.withColumn("z_bias", F.col("median_z") - source_z)


def muon_summary(muons: DataFrame) -> DataFrame:
    """Counts and conditional medians of a muon sample (A37): one row."""
    conv, ls = F.col("converged"), F.col("l_ls") > 0
    one = lambda sel, x, name: grouped_median(muons.where(sel), [], x, name).select(name).scalar().alias(name)
    both = conv & ls
    return muons.agg(F.count(F.lit(1)).alias("n"), F.count_if(conv).alias("n_converged"), F.count_if(ls).alias("n_ls")).select(
        "*", one(conv, F.col("sigma_t"), "median_sigma_t"), one(conv, F.col("frac_used"), "median_frac_used"),
        one(both, F.try_divide("q17", "l_ls"), "q17_per_ls"),
        one(conv & ~ls & (F.col("l_bo") > 100), F.try_divide("q17", "l_bo"), "q17_per_bo"),
        one(both, F.try_divide(F.col("q17") - K.DQDX_BO * F.col("l_bo"), F.col("l_ls")), "ls_only_per_ls"))


def evaluation(rows: DataFrame, min_events: int = 5) -> DataFrame:
    """Per (run, algo): bias, widths, median distance from the axis near the peak, background fraction."""
    key = ["run", "algo"]
    ok = rows.where("ok")
    enough = ok.groupBy(*key).agg(F.count(F.lit(1)).alias("n_ok"), F.first("ztrue").alias("ztrue")).where(F.col("n_ok") >= min_events)
    pz = peak_fit(ok, key, F.col("z")).drop("n")
    near = ok.join(pz.select(*key, "mu", "sigma"), key).where(F.abs(F.col("z") - F.col("mu")) <= 3 * F.col("sigma"))
    px = peak_fit(near, key, F.col("x")).select(*key, F.when(F.col("n") >= 10, F.col("sigma")).alias("sigma_x"))
    rho = grouped_median(near, key, F.hypot("x", "y"), "rho").drop("n")
    s = enough.join(pz, key).join(px, key, "left").join(rho, key, "left")
    return s.select(*key, "ztrue", "n_ok", (F.col("mu") - F.col("ztrue")).alias("bias"), F.col("sigma").alias("sigma_z"), "sigma_x", "rho", "bkg_frac")


def evaluation_pivot(summary: DataFrame, algos: list[str]) -> DataFrame:
    """One line per run with the columns of every algorithm side by side."""
    return summary.groupBy("run", "ztrue").pivot("algo", algos).agg(
        F.first("bias").alias("bias"), F.first("sigma_z").alias("sigma_z"), F.first("rho").alias("rho"), F.first("bkg_frac").alias("bkg"))


def evaluation_totals(summary: DataFrame, max_z: float = 550.0) -> DataFrame:
    inner = summary.where(F.abs("ztrue") <= max_z)
    return inner.groupBy("algo").agg(
        F.countDistinct("run").alias("runs"), F.avg(F.abs("bias")).alias("mean_abs_bias"), F.sqrt(F.avg(F.col("bias") ** 2)).alias("rms_bias"),
        F.avg("sigma_z").alias("mean_sigma_z"), F.avg("sigma_x").alias("mean_sigma_x"), F.avg("rho").alias("mean_rho"))


def energy_by_run(rows: DataFrame, columns: list[str], min_events: int = 5, sel: Column | None = None) -> DataFrame:
    """Per run: median energy and robust width over median for each estimator."""
    d = rows if sel is None else rows.where(sel)
    out = d.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.first("ztrue").alias("ztrue")).where(F.col("n") >= min_events)
    for c in columns:
        r = robust_sigma(d, ["run"], F.col(c), "_s").select("run", F.col("median").alias(f"median_{c}"), F.try_divide("_s", "median").alias(f"width_{c}"))
        out = out.join(r, "run")
    return out


def energy_spread(by_run: DataFrame, columns: list[str], max_z: float = 550.0) -> DataFrame:
    """Spread of the per-run medians over inner positions and the mean width."""
    inner = by_run.where(F.abs("ztrue") <= max_z)
    aggs = [F.count(F.lit(1)).alias("runs")]
    for c in columns:
        aggs += [F.try_divide(F.stddev_pop(f"median_{c}"), F.avg(f"median_{c}")).alias(f"spread_{c}"), F.avg(f"width_{c}").alias(f"mean_width_{c}")]
    return inner.agg(*aggs)
