"""Text fields of run records: source positions, isotopes, veto intervals, run-list lines, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

# --- fixed values: patterns of the run records ---------------------------------------------------------------------
CENTRE = r"(?i)cent(er|re)"
ISOTOPE = r"(?i)\b(Ge|Co|Zn|Am|Be|Cs|Cf)\s*-?\s*\d+\b"
LENGTH = r"([+-]?\d+(?:\.\d+)?)\s*(mm|cm|m)?\b"
VETO = r"(?i)veto\(\s*(\d+|start|begin)\s*~\s*(\d+|end)\s*\)"
RUN_LINE = r"^\s*(\d+)\s+(\S+)\s+([\d.]+)\s+(\d+)\s+(\d+)\s+(\d+)\s*(.*?)\s*$"
FILE_NAME = r"[^/_]*_[^/_]*_[^/_]*_(\d+)\.[^/]*$"
UNIT_CM = {"mm": 0.1, "cm": 1.0, "m": 100.0}
MAX_Z_CM = 700.0


def source_z_cm(comment: Column) -> Column:
    """Source position along the axis from a shifter's comment, in cm; null when there is none."""
    s = F.trim(comment)
    plain = F.regexp_replace(s, ISOTOPE, " ")
    value = F.regexp_extract(plain, LENGTH, 1)
    unit = F.regexp_extract(plain, LENGTH, 2)
    factor = F.when(unit == "mm", UNIT_CM["mm"]).when(unit == "cm", UNIT_CM["cm"]).otherwise(UNIT_CM["m"])
    z = F.when(value != "", value.try_cast("double") * factor)
    return F.when(s.rlike(CENTRE), 0.0).when(F.abs(z) <= MAX_Z_CM, z)


def source_energy_mev(run_type: Column, default: float = K.DEFAULT_SOURCE_MEV) -> Column:
    """Energy of the first isotope named in the run type."""
    low = F.lower(F.coalesce(run_type, F.lit("")))
    out = None
    for iso, e in K.SOURCE_ENERGY_MEV:
        out = (F if out is None else out).when(low.contains(iso.lower()), e)
    return out.otherwise(default)


def source_gamma_lines(run_type: Column) -> Column:
    """Gamma lines of the named isotope as an array, null when unknown."""
    low = F.lower(F.coalesce(run_type, F.lit("")))
    out = None
    for iso, lines in K.SOURCE_LINES_MEV:
        out = (F if out is None else out).when(low.contains(iso.lower()), F.array(*map(F.lit, lines)))
    return out


def summed_lines(run_type: Column, of_line=lambda e: e) -> Column:
    """Sum over the gamma lines of a per-line quantity (visible energy, for instance)."""
    return F.aggregate(source_gamma_lines(run_type), F.lit(0.0), lambda s, e: s + of_line(e))


def veto_intervals(comment: Column) -> Column:
    """All veto intervals of a comment as (start, end) in ticks; null stands for the start or end of the run."""
    whole = F.regexp_extract_all(comment, F.lit(VETO), F.lit(0))
    return F.transform(whole, lambda m: F.struct(
        F.regexp_extract(m, VETO, 1).try_cast("long").alias("start"), F.regexp_extract(m, VETO, 2).try_cast("long").alias("end")))


def file_number(path: Column) -> Column:
    """Sub-run file number from the file name, -1 when it has none (S3)."""
    return F.coalesce(F.regexp_extract(path, FILE_NAME, 1).try_cast("long"), F.lit(-1))
