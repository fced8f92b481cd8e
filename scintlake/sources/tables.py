"""Parquet, CSV and JSON tables: frames, hit caches, cubes, calibrations, merged results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.text import file_number

# ---- frames (S1, S2, S3) ---------------------------------------------------------------------------------------------


def write_frames(df: DataFrame, root: str, mode: str = "append") -> None:
    """One directory per run; rows of a run are spread over as many files as there are tasks."""
    df.write.partitionBy("run").mode(mode).parquet(root)


def load_frames(spark: SparkSession, root: str, runs: int | list[int] | None = None, columns: list[str] | None = None,
                ordered: bool = True) -> DataFrame:
    """Frames of a run, of several runs or of all runs; only those directories and columns are read.

    Raises when nothing matches. ``ordered`` sorts by (run, timestamp) with the remaining key columns as ties.
    """
    df = spark.read.option("basePath", root).parquet(root)
    if runs is not None:
        df = df.where(F.col("run").isin([runs] if isinstance(runs, int) else list(runs)))
    if not df.take(1):
        raise FileNotFoundError(f"no frames for {runs} below {root}")
    if columns is not None:
        df = df.select(*columns)
    return _in_order(df) if ordered else df


def _in_order(df: DataFrame) -> DataFrame:
    """Sorted by (run, timestamp) with the remaining key columns as ties, where both are there."""
    ties = [c for c in ("file", "index", "event") if c in df.columns]
    return df.orderBy("run", "ts", *ties) if {"run", "ts"} <= set(df.columns) else df


def load_patterns(spark: SparkSession, patterns: str | list[str], columns: list[str] | None = None, ordered: bool = True) -> DataFrame:
    """Frames of one or several path patterns, each file once, in the order of ``load_frames``."""
    df = spark.read.parquet(*sorted({patterns} if isinstance(patterns, str) else set(patterns)))
    df = df.select(*columns) if columns else df
    return _in_order(df) if ordered else df


def with_file_number(df: DataFrame, name: str = "file") -> DataFrame:
    """Sub-run file number of each row from the name of the file it was read from (S3)."""
    return df.withColumn(name, file_number(F.col("_metadata.file_path")))


def find_files(spark: SparkSession, directories: list[str], pattern: str) -> DataFrame:
    """Files below the directories whose name matches, for each run from the first directory that has it.

    Names are ``run_<run>_...``. Only the listing is read, never the content.
    """
    found = None
    for rank, d in enumerate(directories):
        f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(d)
        f = f.select("path", F.lit(rank).alias("rank"))
        found = f if found is None else found.unionAll(f)
    found = found.withColumn("run", F.regexp_extract("path", r"run_?0*(\d+)[^/]*$", 1).try_cast("long")).where("run is not null")
    first = found.groupBy("run").agg(F.min("rank").alias("rank"))
    return found.join(first, ["run", "rank"]).select("run", F.col("path").alias("file"))


# ---- hit cache (S7) ----------------------------------------------------------------------------------------------------
def write_cache(hits: DataFrame, events: DataFrame, runs: DataFrame, root: str, min_nhit: int = 0) -> None:
    """Calibration-free hits, events and run constants; hits of events below ``min_nhit`` are left out."""
    keep = events.where(F.col("nhit") >= min_nhit)
    keep.write.partitionBy("run").mode("overwrite").parquet(f"{root}/events")
    hits.join(keep.select("run", "event"), ["run", "event"], "left_semi").write.partitionBy("run").mode("overwrite").parquet(f"{root}/hits")
    runs.write.mode("overwrite").parquet(f"{root}/runs")


def load_cache(spark: SparkSession, root: str, runs: list[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    out = []
    for name in ("hits", "events", "runs"):
        d = spark.read.parquet(f"{root}/{name}")
        out.append(d if runs is None else d.where(F.col("run").isin(runs)))
    return tuple(out)


# ---- event tables (S8) ---------------------------------------------------------------------------------------------------
def write_events_csv(events: DataFrame, path: str) -> None:
    """CSV with a header line in every part file."""
    events.write.mode("overwrite").option("header", True).csv(path)


def write_events_with_hits(events: DataFrame, packed_hits: DataFrame, path: str) -> None:
    """Events with their hits as one array column."""
    events.join(packed_hits, ["run", "event"], "left").write.mode("overwrite").partitionBy("run").parquet(path)


# ---- density cube (S9) -----------------------------------------------------------------------------------------------------
def write_cube(cube: DataFrame, meta: DataFrame, root: str) -> None:
    cube.write.mode("overwrite").parquet(f"{root}/cube")
    meta.write.mode("overwrite").parquet(f"{root}/meta")


def load_cube(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{root}/cube"), spark.read.parquet(f"{root}/meta")


# ---- calibration file (S6) ---------------------------------------------------------------------------------------------------
_MATRIX, _LIST = T.ArrayType(T.ArrayType(T.DoubleType())), T.ArrayType(T.DoubleType())
CALIBRATION = T.StructType([
    *[T.StructField(c, _MATRIX) for c in ("bin_ns", "q1pe", "t0")], T.StructField("gain_factor", _LIST),
    T.StructField("bad", T.ArrayType(T.LongType())), *[T.StructField(c, _LIST) for c in ("eta", "eta_q", "dark")],
    T.StructField("meta", T.MapType(T.StringType(), T.StringType()))])


def load_calibration(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Calibration JSON as tables: ``channel`` (cable, atwd), ``tube`` (cable), ``gain`` and ``meta``.

    One object with arrays per cable and sampler; the optional arrays may be missing.
    """
    j = spark.read.schema(CALIBRATION).option("multiLine", True).json(path)
    rows = j.select(F.posexplode(F.arrays_zip("bin_ns", "q1pe", "t0")).alias("cable", "c"))
    ch = rows.select(F.col("cable").cast("long").alias("cable"), F.posexplode(F.arrays_zip("c.bin_ns", "c.q1pe", "c.t0")).alias("atwd", "v"))
    ch = ch.select("cable", F.col("atwd").cast("long").alias("atwd"), "v.bin_ns", "v.q1pe", "v.t0")
    optional = [F.coalesce(F.col(c), F.array().cast("array<double>")).alias(c) for c in ("eta", "eta_q", "dark")]
    tube = j.select("bad", *optional).select(F.posexplode(F.arrays_zip("bad", "eta", "eta_q", "dark")).alias("cable", "v"))
    tube = tube.select(F.col("cable").cast("long").alias("cable"), (F.col("v.bad") == 1).alias("bad"), "v.eta", "v.eta_q", "v.dark")
    gain = j.select(F.posexplode("gain_factor").alias("gain", "factor")).withColumn("gain", F.col("gain").cast("long"))
    return {"channel": ch, "tube": tube, "gain": gain, "meta": j.select("meta")}


def save_calibration(channel: DataFrame, tube: DataFrame, gain: DataFrame, meta: dict[str, str], path: str) -> None:
    """The same tables back into one JSON object. Bounded by the channels of the detector (2 per cable).

    Cables and samplers are positions in the file, so every number up to the greatest gets an entry: channels that are
    missing have the defaults, tubes that are missing are not bad. An optional array without any value is written as null.
    """
    one = F.lit(0).alias("_all")
    last = channel.select("cable").unionByName(tube.select("cable")).agg(F.max("cable").alias("last"))
    cables = last.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("cable"))
    channel = (cables.select("cable", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("atwd"))
               .join(channel, ["cable", "atwd"], "left")
               .na.fill({"bin_ns": K.DEFAULT_BIN_NS, "q1pe": K.DEFAULT_Q1PE, "t0": 0.0}))
    tube = cables.join(tube, "cable", "left").na.fill({"bad": False})
    per_cable = channel.groupBy("cable").agg(F.sort_array(F.collect_list(F.struct("atwd", "bin_ns", "q1pe", "t0"))).alias("a"))
    c = per_cable.groupBy(one).agg(F.sort_array(F.collect_list(F.struct("cable", "a"))).alias("c"))
    t = tube.groupBy(one).agg(F.sort_array(F.collect_list(F.struct("cable", "bad", "eta", "eta_q", "dark"))).alias("t"))
    g = gain.groupBy(one).agg(F.sort_array(F.collect_list(F.struct("gain", "factor"))).alias("g"))
    m = F.create_map(*[F.lit(v) for kv in meta.items() for v in kv]) if meta else F.create_map().cast("map<string,string>")
    row = c.join(t, "_all").join(g, "_all").select(
        *[F.transform("c", _field(n)).alias(n) for n in ("bin_ns", "q1pe", "t0")],
        F.col("g.factor").alias("gain_factor"), F.transform("t", lambda r: r["bad"].cast("long")).alias("bad"),
        *[F.when(F.exists(F.col("t")[n], lambda v: v.isNotNull()), F.col("t")[n]).alias(n) for n in ("eta", "eta_q", "dark")], m.alias("meta"))
    row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _field(name: str):
    return lambda r: r["a"][name]


# ---- merged results (S10, S11, U1-U3) -------------------------------------------------------------------------------------------
def union_all(*dfs: DataFrame) -> DataFrame:
    """Rows of all tables by column name."""
    return reduce(DataFrame.unionByName, dfs)


def union_common(*dfs: DataFrame) -> DataFrame:
    """Rows of all tables, keeping the columns they have in common in the order of the first."""
    common = [c for c in dfs[0].columns if all(c in d.columns for d in dfs[1:])]
    return union_all(*[d.select(*common) for d in dfs])


def merge_results(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Parent and child tables of several files in one; rows stay linked by (part, row number in the part)."""
    tops = [p.withColumn("part", F.lit(i)) for i, (p, _) in enumerate(parts)]
    kids = [c.withColumn("part", F.lit(i)) for i, (_, c) in enumerate(parts)]
    return union_common(*tops), union_common(*kids)


def distinct_paths(paths: DataFrame) -> DataFrame:
    """Each path once, in order."""
    return paths.distinct().orderBy(*paths.columns)


def file_totals(df: DataFrame, per_file: dict) -> DataFrame:
    """Sum over files of one number per file (S11): ``per_file`` maps a name to an aggregate over the file's rows."""
    f = df.groupBy("file").agg(*[c.alias(n) for n, c in per_file.items()])
    return f.agg(F.count(F.lit(1)).alias("files"), *[F.sum(n).alias(n) for n in per_file])
