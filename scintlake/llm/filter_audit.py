"""Filter interaction audit: what each filter removes at each step of every order in which the filters can be applied.

A row is known by its mask, the set of filters that it fails. Applied in some order, the first filter of the mask removes it.
The orders are numbered lexicographically, by Lehmer rank. All orders that begin with the same k letters are one interval of
(m - k)! ranks, so the orders in which a mask goes at step k, k - 1 letters outside the mask and then one of it, are a few
intervals, and adjacent ones are one. The counts of every (part, mask) are added where an interval begins and taken off where
it ends; the prefix sum over the m! ranks then gives what each order removes at that step, without a row per (mask, order).

Scale: the documents are read once and become rows of (id, part, text hash, mask), some 60 bytes; the first holder of a text is
found by a map-side minimum per hash and a join on (hash, id), which no group of copies makes hot. After that all work is on
2^m masks per part, and every window holds the m! ranks or m steps of one part.

Nulls: a null text is the empty text and a null part the part ''. Rows without an id have no label and repeat no text. Rows that share an id
are documents of their own; one of them repeats a text only if a smaller id has it. Of several labels of an id the highest
counts. Rows of any other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scintlake.llm.words import WORD
from scintlake.session import stage


def intervals(m: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of all removals; bit i of a mask is filter i."""
    found: dict[tuple[int, int], list[list[int]]] = {}

    def grow(mask: int, prefix: list[int], start: int) -> None:
        free = [i for i in range(m) if i not in prefix]
        width = factorial(len(free) - 1)
        for d, i in enumerate(free):
            at = start + d * width
            if mask >> i & 1:
                runs = found.setdefault((mask, len(prefix) + 1), [])
                if runs and runs[-1][1] == at:
                    runs[-1][1] += width
                else:
                    runs.append([at, at + width])
            elif len(free) > 1:
                grow(mask, [*prefix, i], at)

    for mask in range(1, 1 << m):
        grow(mask, [], 0)
    return [(mask, step, a, b) for (mask, step), runs in found.items() for a, b in runs]


def audit(rows: DataFrame, letters: str, marks: tuple[str, ...] = ()) -> DataFrame:
    """part, filter_order, step and counts, a row per part of ``rows``, order of ``letters`` and step.

    ``rows`` has ``part``, ``mask`` (bit i: the row fails the filter of letter i) and a boolean per name of ``marks``. The counts
    are kept, removed, redundant, unique_fails, shapley (see the contract of the query), and ``<mark>_lost`` for each mark.
    """
    m = len(letters)
    spark, ranks = rows.sparkSession, factorial(m)
    values = ["n", *marks]
    counts = stage(rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.count_if(F.col(c)).alias(c) for c in marks]), "masks")
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)) for i in range(m)]
    alone = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(m)]
    parts = stage(counts.groupBy("part").agg(F.sum("n").alias("total"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone")), "parts")
    # 2^m masks, m! orders: both tables are of fixed size
    ends = spark.createDataFrame([(k, s, at, sign) for k, s, a, b in intervals(m) for at, sign in ((a, 1), (b, -1))], "mask int, step int, rank int, sign long")
    orders = spark.createDataFrame([(r, "".join(p)) for r, p in enumerate(permutations(sorted(letters)))], "rank int, filter_order string")
    changes = counts.join(F.broadcast(ends), "mask").select("part", "step", "rank", *[(F.col(c) * F.col("sign")).alias(c) for c in values])
    every = (parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(m))).alias("step"))
             .select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("rank"), *[F.lit(0).cast("long").alias(c) for c in values]))
    ends_summed = changes.unionAll(every).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in values]).filter(F.col("rank") < ranks)
    along = W.partitionBy("part", "step").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    removed = ends_summed.select("part", "step", "rank", *[F.sum(c).over(along).alias(c) for c in values])
    named = removed.join(F.broadcast(orders), "rank").withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    steps = W.partitionBy("part", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    of_letter = F.instr(F.lit("".join(sorted(letters))), F.col("letter"))
    out = (named.withColumn("gone", F.sum("n").over(steps)).withColumn("shapley", F.sum("n").over(W.partitionBy("part", "letter")))
           .join(parts, "part").withColumn("i", of_letter))
    return out.select("part", "filter_order", "step", (F.col("total") - F.col("gone")).alias("kept"), F.col("n").alias("removed"),
                      (F.element_at("fails", F.col("i")) - F.col("n")).alias("redundant"), F.element_at("alone", F.col("i")).alias("unique_fails"),
                      *[F.col(c).alias(f"{c}_lost") for c in marks], "shapley")


def own_failures(text: Column) -> list[Column]:
    """Whether a text fails A (few words), B (few distinct words), C (capitals), D (symbols); E takes the other texts too."""
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    return [n < 50, 100 * distinct.cast("long") < 65 * n.cast("long"),
            100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.char_length(text).cast("long"), text.rlike("[#$%&*|]")]


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good and toxic of every row of ``docs`` (doc_id, text, source), for filters A to E on bits 0 to 4."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(own_failures(F.col("text")))), F.lit(0))
    rows = stage(rows.select("id", "part", bits.cast("int").alias("own"), F.unhex(F.sha2("text", 256)).alias("h")), "filter-rows")
    first = rows.groupBy(F.col("h").alias("fh")).agg(F.min("id").alias("least"))
    # rows without an id find no label; the text hash keeps them from meeting in one task
    none = F.when(F.col("id").isNull(), F.col("h")).otherwise(F.lit(b""))
    told = labels.groupBy(F.col("doc_id").cast("long").alias("lid"), F.lit(b"").alias("lh")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    at = (rows.join(first, (F.col("h") == F.col("fh")) & (F.col("id") == F.col("least")), "left")
          .withColumn("none", none).join(told, (F.col("id") == F.col("lid")) & (F.col("none") == F.col("lh")), "left"))
    repeats = F.when(F.col("id").isNotNull() & F.col("least").isNull(), 1 << 4).otherwise(0)
    return at.select("part", (F.col("own") + repeats).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over ``docs``, per source, with good and toxic rows lost."""
    return audit(masked(docs, labels), "ABCDE", ("good", "toxic"))
