"""Mixing sources to target weights along a time-varying curriculum, with DataFrame expressions only.

Every source has a weight schedule: a piecewise linear function of training time t in [0, 1], given by knots. Its
integral over [0, 1] is the source's weight. The word budget is shared in proportion to these weights; no source gives
more than ``max_repeats`` times its size, and what it can't give is shared again among the others (water filling).

Within a source the documents stand in the order of a seeded hash. A document that starts at word u of its source is
reached when the cumulative demand of the source, target * W(t) / W(1) with W the integral of the schedule, comes to u;
so its training position is t = W^-1(u / target * W(1)), a quadratic within one piece of the schedule.

Scale: one scan counts words; totals and word offsets come from aggregates per source and per hash block of about
``BLOCK_ROWS`` documents, so that no task sorts a source. Only the source table (a row per source) and, within each
source, its block table (a row per ``BLOCK_ROWS`` documents) stand in one window.

Nulls: a null text has no words; the null source is a source of its own, the last in code-point order; null ids are
hashed as the empty text. Repeated rows are documents of their own; rows that tie in hash and size are interchangeable. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scintlake.llm.words import word_count
from scintlake.session import stage

#: documents per hash block, on average at most
BLOCK_ROWS = 1024

KNOTS = "array<struct<t:double,w:double>>"


def source_sizes(sized: DataFrame) -> DataFrame:
    """Per source of (source, size): ``source_size`` in words, ``n_docs``, and ``rank`` from 0 by code point, null last."""
    return (sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
            .withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1))


def with_schedule(sources: DataFrame, schedules: list[list[tuple[float, float]]]) -> DataFrame:
    """Adds ``knots``: the schedules in turn, repeating, by ``rank``."""
    table = F.array(*[F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in s])
                      for s in schedules])
    return sources.withColumn("knots", F.element_at(table, (F.col("rank") % len(schedules) + 1).cast("int")))


def integrated(knots: Column) -> Column:
    """Cumulative integral of a schedule at its knots, by the trapezoid rule (exact for linear pieces)."""
    areas = F.transform(F.sequence(F.lit(1), F.size(knots) - 1), lambda i: (
        (F.get(knots, i)["t"] - F.get(knots, i - 1)["t"]) * (F.get(knots, i)["w"] + F.get(knots, i - 1)["w"]) / 2))
    return F.aggregate(areas, F.array(F.lit(0.0)), lambda acc, a: F.concat(acc, F.array(F.element_at(acc, -1) + a)))


def inverted(knots: Column, cum: Column, area: Column) -> Column:
    """The time at which the integral of the schedule reaches ``area``."""
    i = F.greatest(F.least(F.size(F.filter(cum, lambda c: c <= area)), F.size(knots) - 1), F.lit(1)) - 1
    a, b = F.get(knots, i), F.get(knots, i + 1)
    rest = F.greatest(area - F.get(cum, i), F.lit(0.0))
    span = b["t"] - a["t"]
    root = F.sqrt(F.greatest(a["w"] * a["w"] + 2 * rest * (b["w"] - a["w"]) / span, F.lit(0.0)))
    return F.when(rest <= 0, a["t"]).otherwise(a["t"] + F.least(2 * rest / (a["w"] + root), span))


def targets(sources: DataFrame, budget: float, max_repeats: float) -> DataFrame:
    """Adds ``cum`` (integrated schedule), ``weight`` and ``target``.

    ``budget`` is a multiple of all words. Sorted by cap / weight, sources are filled to their caps until the level
    that the rest reaches is below the next cap; this equals sharing the excess again and again by weight.
    """
    w = sources.withColumn("cum", integrated(F.col("knots"))).withColumn("weight", F.element_at("cum", -1))
    cap = F.col("source_size") * F.lit(float(max_repeats))
    order = W.orderBy("fill", "rank")
    filled = (w.withColumn("cap", cap).withColumn("fill", F.col("cap") / F.col("weight"))
              .withColumn("words", F.sum("source_size").over(W.partitionBy()))
              .withColumn("given", F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)))
              .withColumn("open", F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
              .withColumn("level", (F.lit(float(budget)) * F.col("words") - F.coalesce("given", F.lit(0.0))) / F.col("open")))
    reached = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "rank", "level"))).over(W.partitionBy())
    return (filled.withColumn("target", F.coalesce(F.least(F.col("weight") * reached["level"], F.col("cap")), F.col("cap")))
            .select("source", "rank", "source_size", "n_docs", "knots", "cum", "weight", "target"))


def placed(docs: DataFrame, schedules: list[list[tuple[float, float]]], budget: float = 1.5, max_repeats: float = 2.0,
           seed: str = "mix", whole: bool = False, size: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, any more): size, source_size, target, start, taken, copies.

    ``size`` is the number of words of a row; by default those of the column ``text`` are counted.

    ``copies`` is an array of (copy, taken, position), one entry per time the document is used. With ``whole`` false
    the last document of a source is used in part (its first ``taken`` words), so that a source gives its target to the
    word; with ``whole`` true documents are used in full, those whose middle lies below the target. Columns of ``docs``
    stay; those named like an added column are replaced.
    """
    added = ["size", "source_size", "target", "start", "taken", "copies"]
    rest = [c for c in docs.columns if c not in added]
    sized = docs.select(
        F.struct(*[F.col(c) for c in rest]).alias("doc"), F.col("source").alias("source"), (word_count(F.col("text")) if size is None else size).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h"))
    # narrow rows without the text; totals and block offsets both read them
    hashes = stage(sized.select("source", "size", "h"), "mix-sizes")
    # a row per source
    plan = stage(targets(with_schedule(source_sizes(hashes), schedules), budget, max_repeats), "mix-sources")
    bits = F.greatest(F.ceil(F.log2(F.col("n_docs") / F.lit(float(BLOCK_ROWS)))), F.lit(0)).cast("int")
    block = F.expr("shiftright(cast(conv(substring(h, 1, 8), 16, 10) as bigint), 32 - bits)")
    key = plan.select(F.col("source").alias("s"), bits.alias("bits"))
    blocked = sized.join(key, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", block).drop("s", "bits")
    before = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (hashes.join(key, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", block)
              .groupBy("source", "block").agg(F.sum("size").alias("words"))
              .withColumn("first", F.coalesce(F.sum("words").over(before), F.lit(0)))
              .select(F.col("source").alias("bs"), F.col("block").alias("bb"), "first"))
    # the offset table is joined before the window; documents cross the network once more only where it isn't broadcast
    inside = W.partitionBy("source", "block").orderBy("h", "size").rowsBetween(W.unboundedPreceding, -1)
    at = (blocked.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
          .join(blocks, F.col("source").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("bb")))
          .withColumn("start", F.col("first") + F.col("within"))
          .join(plan.drop("rank", "n_docs").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))))
    passes = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(1)).cast("int") - 1)

    def use(k: Column) -> Column:
        begin = F.col("start") + k * F.col("source_size")
        if whole:
            taken = F.when(begin + F.col("size") / 2 < F.col("target"), F.col("size")).otherwise(0)
        else:
            taken = F.greatest(F.least(F.floor(F.col("target")) - begin, F.col("size")), F.lit(0))
        taken = taken.cast("long")
        share = F.least((begin + taken / 2) / F.col("target"), F.lit(1.0)) * F.col("weight")
        return F.struct(k.alias("copy"), taken.alias("taken"), inverted(F.col("knots"), F.col("cum"), share).alias("position"))

    used = F.filter(F.transform(passes, use), lambda c: (c["taken"] > 0) if not whole else (
        (c["taken"] > 0) | ((F.col("size") == 0) & (c["copy"] == 0))))
    return (at.withColumn("copies", used)
            .select(*[F.col("doc")[c].alias(c) for c in rest], "size", "source_size", "target", "start",
                    F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["taken"]).alias("taken"), "copies"))


def mixed(docs: DataFrame, schedules: list[list[tuple[float, float]]], budget: float = 1.5, max_repeats: float = 2.0,
          seed: str = "mix", whole: bool = True) -> DataFrame:
    """The training order: a row per use of a document, range-sorted by position.

    Adds ``mix_position``, ``mix_copy`` and ``mix_taken`` to the columns of ``docs`` (columns of these names are
    replaced). Documents without words are kept once, at the place where their source has come to them.
    """
    own = [c for c in docs.columns if c not in ("mix_position", "mix_copy", "mix_taken")]
    kept = docs.select(F.struct(*own).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("words"))
    used = (placed(kept, schedules, budget, max_repeats, seed, whole, F.col("words"))
            .select("row", "doc_id", F.explode("copies").alias("use")))
    return (used.select(*[F.col("row")[c].alias(c) for c in own], F.col("use.position").alias("mix_position"),
                        F.col("use.copy").alias("mix_copy"), F.col("use.taken").alias("mix_taken"), F.col("doc_id").alias("_id"))
            .sort("mix_position", "_id", "mix_copy").drop("_id"))
