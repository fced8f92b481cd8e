"""Text sources: run list, geometry, visible-energy tables, run selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import RUN_LINE


def parse_run_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Run records from text lines; other lines drop out, comments are cut to 200 characters."""
    g = lambda i: F.regexp_extract(column, RUN_LINE, i)
    return lines.where(F.col(column).rlike(RUN_LINE)).select(
        g(1).cast("long").alias("run"), g(2).alias("start"), g(3).cast("double").alias("hours"), g(4).cast("long").alias("unix_start"),
        g(5).cast("long").alias("flag"), g(6).cast("long").alias("grade"), F.substring(g(7), 1, 200).alias("comment"))


def run_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_run_lines(spark.read.text(path))


def columns_of(lines: DataFrame, column: str = "value") -> DataFrame:
    """Whitespace-separated numbers of each line as an array; comment lines and empty lines drop out."""
    return lines.where(~F.col(column).rlike(r"^\s*(#|$)")).select(F.split(F.trim(column), r"\s+").cast("array<double>").alias("v"))


def geometry(spark: SparkSession, path: str, radius_scale: float = 1.0) -> DataFrame:
    """Sensor positions ``cable x y z``; inner sensors can be moved radially."""
    v = columns_of(spark.read.text(path))
    cable = F.col("v")[0].cast("long")
    s = F.when(cable < K.N_ID, radius_scale).otherwise(1.0)
    return v.select(cable.alias("cable"), *[(F.col("v")[i + 1] * s).alias(n) for i, n in enumerate(("px", "py", "pz"))])


def visible_energy_table(spark: SparkSession, path: str, particle: str) -> DataFrame:
    """Visible over real energy: node energy, best ratio and six variants in long form.

    Variant 0 is the best ratio; tables with fewer than eight columns repeat it in the six variants.
    """
    v = columns_of(spark.read.text(path))
    arr = F.col("v")
    six = F.when(F.size(arr) >= 8, F.slice(arr, 3, 6)).otherwise(F.array_repeat(F.get(arr, F.lit(1)), 6))
    wide = v.select(arr[0].alias("e_real"), F.concat(F.array(F.get(arr, F.lit(1))), six).alias("r"))
    return wide.select(F.lit(particle).alias("particle"), "e_real", F.posexplode("r").alias("variant", "ratio")).withColumn(
        "e_vis", F.col("e_real") * F.col("ratio"))


def run_selection(specs: DataFrame, column: str = "spec") -> DataFrame:
    """Distinct run numbers from selections such as ``881-899,1518``."""
    part = specs.select(F.explode(F.split(column, ",")).alias("p")).select(F.trim("p").alias("p")).where("p <> ''")
    ends = F.split("p", "-")
    a, b = F.get(ends, F.lit(0)).cast("long"), F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0))).cast("long")
    return part.where(a <= b).select(F.explode(F.sequence(a, b)).alias("run")).distinct()


def select_runs(df: DataFrame, spec: str) -> DataFrame:
    """Rows of the selected runs."""
    s = df.sparkSession.range(1).select(F.lit(spec).alias("spec"))
    return df.join(run_selection(s), "run", "left_semi")


def file_slice(files: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """Files ``first`` to ``last`` (1-based) of each run in name order (S13). A run has few files."""
    n = F.row_number().over(Window.partitionBy("run").orderBy("file"))
    keep = (F.col("_n") >= first) & (F.col("_n") <= last if last is not None else F.lit(True))
    return files.withColumn("_n", n).where(keep).drop("_n")


def first_files(files: DataFrame, n: int) -> DataFrame:
    return file_slice(files, 1, n)
