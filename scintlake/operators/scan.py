"""Ordered scans of long sequences.

A run can hold a third of all rows, so no window here spans a whole run. A sequence is cut into time blocks; the
work inside a block is a window over (run, block), and what crosses block borders is carried by a table with one
row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

ROWS_PER_BLOCK = 500_000


def time_blocks(df: DataFrame, part: list[str], ts: str, rows_per_block: int = ROWS_PER_BLOCK, at_least: int = 1) -> DataFrame:
    """Start and block width of every sequence: (part, _t0, _w), about ``rows_per_block`` rows per block.

    Each sequence has its own width, so a dense one is cut finely without cutting long quiet ones. One pruned scan
    with map-side aggregation; the result (one row per sequence) is written, so its size is known to the joins.
    """
    per = df.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("_t0"), F.max(ts).alias("b"))
    w = F.ceil((F.col("b") - F.col("_t0") + 1).cast("double") * rows_per_block / F.col("n"))
    return stage(per.select(*part, "_t0", F.greatest(w, F.lit(at_least)).cast("long").alias("_w")), "blocks")


def with_block(df: DataFrame, part: list[str], ts: str, blocks: DataFrame | int) -> DataFrame:
    """Block number per row, in whole ticks (tick counts exceed the exact range of a double).

    ``blocks`` is a table of :func:`time_blocks` or one width for all sequences.
    """
    if isinstance(blocks, int):
        return df.withColumn("_block", F.expr(f"`{ts}` div {blocks}L"))
    return df.join(blocks, part).withColumn("_block", F.expr(f"(`{ts}` - _t0) div _w")).drop("_t0", "_w")


def _order(order: list[str]) -> Column:
    return F.struct(*order)


def lag_value(df: DataFrame, part: list[str], order: list[str], value: str, width: DataFrame | int, name: str) -> DataFrame:
    """Value of the row before, across block borders."""
    d = with_block(df, part, order[0], width)
    keys = [*part, "_block"]
    last = d.groupBy(*keys).agg(F.max_by(value, _order(order)).alias("_last"))
    carry = last.select(*keys, F.lag("_last").over(Window.partitionBy(*part).orderBy("_block")).alias("_carry"))
    here = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    return (
        d.withColumn("_lag", here).withColumn("_first", first).join(carry, keys)
        .withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")))
        .drop("_block", "_lag", "_first", "_carry")
    )


def running_total(df: DataFrame, part: list[str], order: list[str], x: Column, width: DataFrame | int, name: str) -> DataFrame:
    """Running sum from the start of the sequence, current row included."""
    d = with_block(df, part, order[0], width).withColumn("_x", x)
    keys = [*part, "_block"]
    tot = d.groupBy(*keys).agg(F.sum("_x").alias("_t"))
    before = Window.partitionBy(*part).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.select(*keys, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_carry"))
    here = F.sum("_x").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("_s", here).join(carry, keys).withColumn(name, F.col("_s") + F.col("_carry")).drop("_block", "_x", "_s", "_carry")


def hard_segments(df: DataFrame, part: list[str], order: list[str], hard: Column, width: DataFrame | int, name: str = "segment") -> DataFrame:
    """Number of hard resets so far."""
    return running_total(df, part, order, F.when(hard, 1).otherwise(0), width, name)


def running_sum(df: DataFrame, part: list[str], order: str, x: str, name: str = "cumsum") -> DataFrame:
    """Running sum inside short sequences (a waveform has at most a few hundred samples)."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(x).over(w))


def islands(df: DataFrame, part: list[str], order: str, cond: Column, name: str = "island") -> DataFrame:
    """Label of each run of consecutive rows where ``cond`` holds, null elsewhere (short sequences)."""
    w = Window.partitionBy(*part).orderBy(order)
    flag = df.withColumn("_on", F.coalesce(cond, F.lit(False)))
    start = F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))
    flag = flag.withColumn("_start", start.cast("int"))
    label = F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return flag.withColumn(name, F.when(F.col("_on"), label)).drop("_on", "_start")


def group_starts(df: DataFrame, part: list[str], order: list[str], key: str, name: str = "is_start") -> DataFrame:
    """True where ``key`` differs from the row before, and on the first row, also with a null key (short sequences)."""
    prev = F.lag(F.struct(key)).over(Window.partitionBy(*part).orderBy(*order))
    return df.withColumn(name, prev.isNull() | ~prev[key].eqNullSafe(F.col(key)))


def last_marker(probe: DataFrame, marker: DataFrame, part: list[str], order: list[str], payload: list[str],
                width: DataFrame | int, name: str = "prev") -> DataFrame:
    """As-of join: for every probe row the ``payload`` struct of the last marker strictly before it.

    ``marker`` has the columns ``part``, ``order`` and ``payload``. Both sides are cut into the same time blocks;
    each marker is also handed to the start of the following blocks up to the next block that has its own marker,
    so one shuffle on (part, block) answers the join without a non-equi condition and without a run-wide window.
    """
    keys = [*part, "_block"]
    p, m = with_block(probe, part, order[0], width), with_block(marker, part, order[0], width)
    pay = F.struct(*payload)
    at_end = m.groupBy(*keys).agg(F.max_by(pay, _order(order)).alias(name))
    ends = p.groupBy(*part).agg(F.max("_block").alias("_end"))
    nxt = F.lead("_block").over(Window.partitionBy(*part).orderBy("_block"))
    carry = (
        at_end.withColumn("_next", nxt).join(ends, part)
        .withColumn("_to", F.coalesce("_next", "_end"))
        .where(F.col("_to") > F.col("_block"))
        .select(*part, F.explode(F.sequence(F.col("_block") + 1, F.col("_to"))).alias("_block"), name)
    )
    cols = p.columns
    empty = F.lit(None)
    kinds = {c: p.schema[c].dataType for c in cols}
    pay_type = at_end.schema[name].dataType
    rows = p.select(*cols, F.lit(1).alias("_kind"), empty.cast(pay_type).alias(name))
    fill = lambda have: [F.col(c) if c in have else empty.cast(kinds[c]).alias(c) for c in cols]
    marks = m.select(*fill([*part, *order, "_block"]), F.lit(2).alias("_kind"), pay.alias(name))
    starts = carry.select(*fill(keys), F.lit(0).alias("_kind"), F.col(name))
    # block-start markers have a null order and come first; a probe precedes a marker at the same position
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order], "_kind")
    prev = F.last(name, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.unionByName(marks).unionByName(starts).withColumn("_p", prev).where("_kind = 1").drop("_kind", "_block", name) \
        .withColumnRenamed("_p", name)


def count_within(df: DataFrame, part: list[str], x: str, width: float, name: str = "n_within", spread: int = 16) -> DataFrame:
    """Rows of the same group in the forward range [x, x + width], x included.

    The value axis is cut into stretches of ``spread`` widths; a row within ``width`` of a stretch's start is also
    seen by the stretch before. So a hot group is spread over many tasks and only ~1/spread of the rows is doubled.
    """
    stretch = width * spread
    d = df.where(F.col(x).isNotNull()).withColumn("_s", F.floor(F.col(x) / stretch))
    near = F.col(x) - F.col("_s") * stretch <= width
    d = d.withColumn("_home", F.col("_s")).withColumn(
        "_s", F.explode(F.when(near, F.array(F.col("_s"), F.col("_s") - 1)).otherwise(F.array(F.col("_s")))))
    by = ", ".join(f"`{c}`" for c in [*part, "_s"])
    n = F.expr(f"count(1) over (partition by {by} order by `{x}` range between current row and {float(width)}D following)")
    return d.withColumn(name, n).where("_s = _home").drop("_s", "_home")


def first_by(df: DataFrame, keys: list[str], order: list, columns: list[str] | None = None) -> DataFrame:
    """First row per group under a composite order, by partial aggregation instead of a sort.

    ``order`` must be ascending comparable columns; nulls sort first, as in a struct comparison.
    """
    cols = columns or [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*cols), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, "_r.*")
