"""Channel tables from waveforms: pedestals and sampling periods."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.waves import is_flat, pedestal_candidate

CHANNEL = ["cable", "atwd", "gain"]


def pedestal_mean(waves: DataFrame, samples: str = "samples") -> DataFrame:
    """Mean and rms per (cable, atwd, gain, sample) over the good pedestal waveforms (A5).

    Sums are combined in every task before the shuffle, so a hot channel costs no more than a quiet one.
    """
    s = F.col("v")
    good = waves.where(pedestal_candidate(F.col("gain"), F.col("launch")) & is_flat(F.col(samples)))
    long = good.select(*CHANNEL, F.posexplode(samples).alias("sample", "v"))
    g = long.groupBy(*CHANNEL, "sample").agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("rms"))
    return g.withColumn("rms", F.when(F.col("n") >= 2, F.col("rms")))


def pedestal_counts(waves: DataFrame, samples: str = "samples") -> DataFrame:
    """Accepted and rejected waveforms per channel; only candidates by gain and launch are judged."""
    c = waves.where(pedestal_candidate(F.col("gain"), F.col("launch")))
    flat = is_flat(F.col(samples))
    return c.groupBy(*CHANNEL).agg(F.count_if(flat).alias("n"), F.count_if(~flat).alias("n_rejected"))


def pedestal_arrays(mean: DataFrame) -> DataFrame:
    """Pedestal per channel as one array (for the join with waveforms); bounded by the samples of a waveform."""
    return mean.groupBy(*CHANNEL).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("sample", "mean"))), lambda s: s["mean"]).alias("pedestal"))


#: lines of a 1024-sample transform that a clock of 12 to 24 samples can fall on, with a neighbour on either side
LINES, PAD = np.arange(42, 87), 1024


@F.pandas_udf(T.DoubleType())
def clock_period(samples: pd.Series) -> pd.Series:
    """Period in samples of the strongest of the inner ``LINES`` of each waveform; null where the waveform hardly swings.

    The 45 lines are one product with their cosines and sines; a parabola through three powers places the maximum.
    """
    out = np.full(len(samples), np.nan)
    lengths = samples.map(len).to_numpy() if len(samples) else np.empty(0, dtype=int)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        v = np.vstack(samples.iloc[rows].to_numpy()).astype(float)
        v -= v.mean(axis=1)[:, None]
        angle = 2 * np.pi / PAD * np.outer(np.arange(n), LINES)
        power = (v @ np.cos(angle)) ** 2 + (v @ np.sin(angle)) ** 2
        top = 1 + np.argmax(power[:, 1:-1], axis=1)
        here = np.arange(len(rows))
        before, peak, after = power[here, top - 1], power[here, top], power[here, top + 1]
        bend = before + after - 2 * peak
        with np.errstate(divide="ignore", invalid="ignore"):
            offset = np.where(bend == 0, 0.0, np.clip((before - after) / (2 * bend), -0.5, 0.5))
        out[rows] = np.where(np.sqrt((v * v).mean(axis=1)) >= 5.0, PAD / (LINES[top] + offset), np.nan)
    return pd.Series(out)


def sampling_period(waves: DataFrame, samples: str = "samples", gain: int = 3, default: float = K.DEFAULT_BIN_NS) -> DataFrame:
    """Clock period and sampling time per (cable, atwd) from the clock waveforms."""
    p = waves.where(F.col("gain") == gain).select("cable", "atwd", clock_period(F.col(samples)).alias("p"))
    p = p.withColumn("p", F.nanvl("p", F.lit(None).cast("double")))
    g = p.groupBy("cable", "atwd").agg(F.count("p").alias("n"), F.avg("p").alias("period"))
    return g.withColumn("bin_ns", F.coalesce(F.lit(25.0) / F.col("period"), F.lit(default)))
