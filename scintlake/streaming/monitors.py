"""Running constants and monitors of a stream (ST3-ST5), versioned tables of running results, and a helper that drains what is available."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.waves import is_flat, pedestal_candidate
from ..session import stage_root


def stream_channel_stats(waves: DataFrame, samples: str = "samples") -> DataFrame:
    """Running sum, sum of squares and count per channel and sample (ST3); use update or complete mode."""
    good = waves.where(pedestal_candidate(F.col("gain"), F.col("launch")) & is_flat(F.col(samples)))
    long = good.select("cable", "atwd", "gain", F.posexplode(samples).alias("sample", "v"))
    return long.groupBy("cable", "atwd", "gain", "sample").agg(
        F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2"), F.count(F.lit(1)).alias("n"))


def stream_rate(events: DataFrame, time: str, width: str, delay: str, is_tag: Column) -> DataFrame:
    """Tags per tumbling window (ST4), for append mode: a window comes once, when the watermark has passed it."""
    w = F.window(time, width)
    return events.withWatermark(time, delay).groupBy(w.alias("w")).agg(F.count_if(is_tag).alias("n_tags"), F.count(F.lit(1)).alias("n_events")).select(
        F.col("w.start").alias("start"), "n_tags", "n_events",
        (F.col("n_tags") / (F.unix_seconds("w.end") - F.unix_seconds("w.start"))).alias("rate"))


def stream_occupancy(hits: DataFrame, time: str, width: str, delay: str) -> DataFrame:
    """Hits per cable and tumbling window (ST5), for append mode like ``stream_rate``."""
    w = F.window(time, width)
    return hits.withWatermark(time, delay).groupBy(w.alias("w"), "cable").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), "cable", "n")


def stream_silent(hits: DataFrame, sensors: DataFrame, time: str, width: str, delay: str) -> DataFrame:
    """Hits of every sensor per closed window, zero where it was silent (ST5): start, cable, n, silent; for append mode.

    The counts of a window come when the watermark has passed it; a second aggregation packs them to one row, which is laid out over the
    static table of sensors (cable). A window thus takes one entry of state per sensor. Windows without any hit have no rows.
    """
    w = F.window(time, width)
    counts = hits.withWatermark(time, delay).groupBy(w.alias("w"), "cable").agg(F.count(F.lit(1)).alias("n"))
    seen = F.map_from_entries(F.collect_list(F.struct("cable", "n")))
    closed = counts.groupBy(F.window(F.window_time("w"), width).alias("w")).agg(seen.alias("seen"))
    # a row per sensor of the detector
    cables = F.lit(sorted(r["cable"] for r in sensors.select(F.col("cable").cast("long")).distinct().collect()))
    return closed.select(F.col("w.start").alias("start"), F.explode(cables).alias("cable"), "seen").select(
        "start", "cable", F.coalesce(F.try_element_at("seen", F.col("cable")), F.lit(0)).alias("n"),
        (~F.map_contains_key("seen", F.col("cable"))).alias("silent"))


# ---- a table of running results: what each batch changed, as versions -------------------------------------------------
def upsert(stream: DataFrame, path: str) -> None:
    """Process what is available of a running aggregation in update mode; every batch adds its changed rows to the table at ``path``.

    A batch writes the folder of its own number, so a batch that is run again after a failure replaces what it wrote.
    """
    def changed(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/changes/version={batch}")
    w = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/log").trigger(availableNow=True)
    w.foreachBatch(changed).start().awaitTermination()


def _versions(spark, path: str, kind: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/{kind}")
    except AnalysisException as e:          # nothing has been written yet
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def latest(spark, path: str, keys: list[str], version: int | None = None) -> DataFrame:
    """The table of ``upsert`` as of a version (the last one by default): per key the row of the highest version.

    Reads the last snapshot up to that version and the changes after it; folders of other versions are pruned.
    """
    upto = F.lit(True) if version is None else F.col("version") <= version
    changes, base = _versions(spark, path, "changes").where(upto), _versions(spark, path, "snapshots")
    if base is not None:
        at = base.where(upto).agg(F.max("version")).first()[0]
        if at is not None:
            changes = changes.where(F.col("version") > at).unionByName(base.where(F.col("version") == at))
    rest = [c for c in changes.columns if c not in (*keys, "version")]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*keys, "r.*")


def snapshot(spark, path: str, keys: list[str]) -> int:
    """Write the whole table at its last version, so that readers need no changes before it; returns the version."""
    version = _versions(spark, path, "changes").agg(F.max("version")).first()[0]
    latest(spark, path, keys, version).write.mode("overwrite").parquet(f"{path}/snapshots/version={version}")
    return version


def folder(spark, name: str) -> str:
    """A new folder below the shared one."""
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, files_per_batch: int = 1000) -> tuple[DataFrame, DataFrame]:
    """``df`` written to the shared folder, as a table and as a file stream of it."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return spark.read.schema(df.schema).parquet(path), stream


def ended(stream: DataFrame, batch: DataFrame, time: str, move: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, Callable[[], None]]:
    """``stream`` with a source for its last row, and what writes that row: the latest of ``batch`` (the same rows), moved on by ``move``."""
    spark = stream.sparkSession
    path = folder(spark, "end")
    batch.limit(0).write.parquet(path)

    def end() -> None:
        last = batch.agg(F.max_by(F.struct("*"), time).alias("r")).where("r is not null").select("r.*")
        move(last).select(*batch.columns).write.mode("append").parquet(path)
    return stream.unionByName(spark.readStream.schema(batch.schema).parquet(path)), end


def drain(stream: DataFrame, name: str, mode: str = "append", end: Callable[[], None] | None = None) -> DataFrame:
    """Process everything available and return the result as a table in the shared folder.

    ``append`` writes through the file sink; ``complete`` keeps the last full result. With ``end`` (see ``ended``) the query goes on
    after that, so the last row comes behind all others however the input is cut.
    """
    spark = stream.sparkSession
    path = folder(spark, name)
    for close in (None, end) if end else (None,):
        if close:
            close()
        w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/log").trigger(availableNow=True)
        if mode == "append":
            q = w.format("parquet").option("path", f"{path}/data").start()
        else:
            q = w.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/data")).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")
