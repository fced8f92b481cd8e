"""Hit tables: primary hit, gain collapse, event totals, coincidence counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.trigger import describe, is_physics
from .scan import count_within

EVENT = ["run", "event"]


def _rank(*cols: str) -> Column:
    """Composite order for ``min_by`` with nulls last."""
    parts = []
    for c in cols:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


def _total(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def primary_hits(hits: DataFrame, keys: list[str] | None = None, ties: tuple[str, ...] = ("q", "adc", "atwd")) -> DataFrame:
    """One primary hit per (event, cable): found first, then the highest gain, then the earliest.

    A partial aggregation, so an event with very many rows is reduced in every task before the shuffle; afterwards
    an event has at most one row per cable. Cables without a found pulse have no primary hit.
    """
    keys = keys or EVENT
    ties = tuple(t for t in ties if t in hits.columns)
    rest = [c for c in hits.columns if c not in (*keys, "cable")]
    found = hits.where("found")            # a cable with no found pulse has no primary hit
    return (
        found.groupBy(*keys, "cable").agg(F.min_by(F.struct(*rest), _rank("gain", "t", *ties)).alias("_r"))
        .select(*keys, "cable", "_r.*")
    )


def gain_collapse(hits: DataFrame, keys: list[str] | None = None, ties: tuple[str, ...] = ("q", "saturated")) -> DataFrame:
    """One row per cable over all gains.

    Time from the earliest pulse of the highest gain present, charge from the highest unsaturated gain, else from
    the lowest gain. Gain numbers grow as the gain falls.
    """
    keys = keys or EVENT
    lead = "t_lead" if "t_lead" in hits.columns else "t"
    h = hits.where(F.col("t").isNotNull() & (F.col("q") > 0)).withColumn("_lead", F.col(lead))
    first = h.groupBy(*keys, "cable", "gain").agg(F.min_by(F.struct("t", "_lead", "q", "saturated"), _rank("t", *ties)).alias("f"))
    q = F.struct("f.q", "gain", "f.saturated")
    g = first.groupBy(*keys, "cable").agg(
        F.min_by(F.struct("f.t", "f._lead"), "gain").alias("a"),
        F.min_by(q, F.when(~F.col("f.saturated"), F.col("gain"))).alias("ok"),
        F.max_by(q, "gain").alias("low"))
    c = F.coalesce("ok", "low")
    return g.select(*keys, "cable", F.col("a.t").alias("t"), F.col("a._lead").alias("t_lead"), c["q"].alias("q"),
                    c["gain"].alias("gain"), c["saturated"].alias("saturated"))


def event_totals(hits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Multiplicities and charges per event and sensor class over the primary hits (A2).

    ``nwave`` and ``nsat`` count every inner waveform. The primary hit per cable comes from the same pass: one
    aggregation per (event, cable) carries both, then one per event.
    """
    keys = keys or EVENT
    rank = F.when(F.col("found"), _rank("gain", "t", "q"))
    c = hits.groupBy(*keys, "cable").agg(
        F.min_by("q", rank).alias("q"), F.bool_or("found").alias("p"),
        F.count(F.lit(1)).alias("nw"), F.count_if("saturated").alias("ns"))
    inner, i17 = F.col("cable") < K.N_ID, F.col("cable") < K.N_ID17
    p, q = F.col("p"), F.when(F.col("p"), F.col("q"))
    return c.groupBy(*keys).agg(
        F.count_if(p & inner).alias("nhit"), F.count_if(p & i17).alias("nhit17"), F.count_if(p & inner & ~i17).alias("nhit20"),
        F.count_if(p & ~inner).alias("nhit_od"),
        F.coalesce(F.sum(F.when(inner, F.col("nw"))), F.lit(0)).alias("nwave"),
        F.coalesce(F.sum(F.when(inner, F.col("ns"))), F.lit(0)).alias("nsat"),
        _total(F.when(inner, q)).alias("q_total"), _total(F.when(i17, q)).alias("q17"),
        _total(F.when(inner & ~i17, q)).alias("q20"), _total(F.when(~inner, q)).alias("q_od"))


def muon_totals(muon_hits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The same over collapsed per-tube hits (A3), with the 5-inch charge."""
    keys = keys or EVENT
    inner, i17 = F.col("cable") < K.N_ID, F.col("cable") < K.N_ID17
    five = F.col("cable").between(2120, 2125)
    q = F.col("q")
    return muon_hits.groupBy(*keys).agg(
        F.count_if(inner).alias("nhit"), F.count_if(~inner).alias("nhit_od"),
        F.count_if(inner & F.col("saturated")).alias("nsat"),
        _total(F.when(i17, q)).alias("q17"), _total(F.when(inner & ~i17, q)).alias("q20"),
        _total(F.when(~inner, q)).alias("q_od"), _total(F.when(five, q)).alias("q_5inch"),
        _total(F.when(inner, q)).alias("q_total"))


def coincidence(hits: DataFrame, window: float = 200.0, keys: list[str] | None = None, name: str = "n200") -> DataFrame:
    """Largest number of outer hits of an event inside any ``window`` ns (A15); events without timed outer hits have no row."""
    keys = keys or EVENT
    od = hits.where((F.col("cable") >= K.N_ID) & F.col("t").isNotNull()).select(*keys, "t")
    n = count_within(od, keys, "t", window).groupBy(*keys).agg(F.max("n_within").alias(name))
    return n


def trigger_census(trig: DataFrame) -> DataFrame:
    """Per trigger word: events, mean and largest multiplicity; most common first."""
    nh = F.coalesce("nhit", F.lit(0))
    g = trig.groupBy("trigger").agg(F.count(F.lit(1)).alias("n"), F.avg(nh).alias("mean_nhit"), F.max(nh).alias("max_nhit"))
    return g.select("trigger", describe(F.col("trigger")).alias("names"), is_physics(F.col("trigger")).alias("physics"),
                    "n", "mean_nhit", "max_nhit").orderBy(F.desc("n"), "trigger")


def run_wall_time(trig: DataFrame, seconds: Column) -> DataFrame:
    return trig.groupBy("run").agg((F.max(seconds) - F.min(seconds)).alias("wall_s"), F.count(F.lit(1)).alias("n"))


def most_common(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)


def head_events(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First ``n`` events over all files in order (T3): a top-k, never a full sort."""
    return df.orderBy(*order).limit(n)


def head_per(df: DataFrame, part: list[str], order: list[str], n: int) -> DataFrame:
    """First ``n`` rows per group (T4); Spark keeps only ``n`` per group and task before the shuffle."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def top_k(df: DataFrame, part: list[str], by: str, k: int, ties: list[str], rank: str = "rank") -> DataFrame:
    """The ``k`` largest rows per group (T5), with their rank."""
    w = Window.partitionBy(*part).orderBy(F.desc(by), *ties)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def sort_frames(df: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """Stable (run, timestamp) order (T1); a range-partitioned sort."""
    return df.orderBy("run", "ts", *(ties or []))


def occupancy(hits: DataFrame, events: DataFrame, n_events: int) -> DataFrame:
    """Hits per cable in the first ``n_events`` physics events of each run (A4)."""
    first = head_per(events.where(is_physics(F.col("trigger"))).select("run", "event"), ["run"], ["event"], n_events)
    return hits.join(first, EVENT, "left_semi").groupBy("cable").agg(F.count(F.lit(1)).alias("occupancy"))


def dead_sensors(sensors: DataFrame, occ: DataFrame) -> DataFrame:
    """Sensors never seen."""
    return sensors.select("cable").join(occ.where("occupancy > 0"), "cable", "left_anti")


def keep_events(hits: DataFrame, keep: DataFrame) -> DataFrame:
    """Hits of the selected events only."""
    return hits.join(keep.select(*EVENT), EVENT, "left_semi")


def mask_nhit(events: DataFrame, keep: DataFrame) -> DataFrame:
    """Events with ``nhit`` set to 0 where they are not selected."""
    k = keep.select(*EVENT).withColumn("_keep", F.lit(True))
    return events.join(k, EVENT, "left").withColumn(
        "nhit", F.when(F.col("_keep"), F.col("nhit")).otherwise(0)).drop("_keep")


def pack_hits(hits: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Ragged hits per event as one ordered array column (D18); use after the collapse to one row per cable."""
    keys = keys or EVENT
    return hits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cable", *columns))).alias("hits"))


def union_detectors(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Inner and outer hits in one table (U4)."""
    return inner.unionByName(outer)
