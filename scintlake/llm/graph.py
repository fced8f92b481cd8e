"""Connected components of a link table, and components from candidate buckets without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scintlake.session import stage, used_up


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (hi, lo), hi > lo."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy(F.col("u").alias("m_u")).agg(F.min("v").alias("m")).select("m_u", F.least("m_u", "m").alias("m"))
    large = (both.filter("v > u").join(least, F.col("u") == F.col("m_u")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
    least = large.groupBy(F.col("hi").alias("m_u")).agg(F.min("lo").alias("m"))
    small = large.join(least, F.col("hi") == F.col("m_u")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return small.filter("hi <> lo").unionAll(least.select(F.col("m_u").alias("hi"), F.col("m").alias("lo"))).distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), component being the least node that can be reached.

    Alternating large and small stars; rounds grow with the logarithm of the longest path. Each round is written to
    the shared folder, where it replaces the one before, and one row of counts comes to the driver.
    """
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "star")
    was = _print(now)
    while was[0]:
        old, now = now, stage(_star(now), "star")
        used_up(old)
        done, was = _print(now), was
        if done == was:
            break
        was = done
    out = now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
    out._stage = now._stage
    return out


#: rounds in which open buckets have one more pivot, at most
STARS = 5
#: pairs of unlike components per member that are compared without more pivots
WORTH = 256
#: members of a bucket that meet in one cell, about
CELL = 1024


def _cells(rows: DataFrame, sizes: DataFrame, prefix: str, own: str, other: str) -> DataFrame:
    """``rows`` dealt to the cells (own block, other block) of their buckets; all but large buckets are one cell."""
    blocks = F.ceil(F.col("members") / CELL).cast("int")
    dealt = rows.join(sizes, F.col("key") == F.col("k")).withColumn("blocks", blocks).drop("k", "members")
    dealt = dealt.withColumn(own, F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(*[F.col(c).alias(f"{prefix}{c}") for c in ("key", "node", "comp", "x", "y")], "slot")


def bucket_components(members: DataFrame, marks: DataFrame, verify: Callable[[DataFrame], DataFrame],
                      close: Callable[[dict[str, Column], dict[str, Column], Column], Column],
                      renew: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Components of the nodes of ``members`` (key, slot, node) under the links that ``verify`` confirms among bucket mates.

    ``marks`` has a row of numbers per node. ``close`` takes the marks of two bucket mates and the bucket's slot and is part of the
    join: a cheap condition for a link that may also say in which of their common buckets two nodes are compared, so that no pair
    is made twice. ``verify`` takes candidate pairs (a, b), a < b, and returns those linked. ``renew`` takes the nodes that are left for the
    last comparison and returns their marks, which may be sharper since they need to hold among these nodes only.

    First every member is compared with the least node of its bucket. A pivot has then met its whole bucket and leaves it; a bucket whose
    other members are of one component is done. While the pairs of unlike components are more than ``WORTH`` a member, open buckets have
    another pivot, drawn by hash, for ``STARS`` rounds at most and as long as that lowers the number of pairs. What is left is compared at
    once: every pair of a bucket that lies in two components, in cells of about ``CELL`` members a side. So no pair that may join two
    components is left out, while members of one component need not be compared. Returns (node, component) for linked nodes, and the links found.
    """
    names = [c for c in marks.columns if c != "node"]
    of = lambda prefix: marks.select(*[F.col(c).alias(f"{prefix}{c}") for c in marks.columns])
    alike = close({c: F.col(f"m_{c}") for c in names}, {c: F.col(f"p_{c}") for c in names}, F.col("slot"))
    first = members.groupBy(F.col("key").alias("k")).agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last")
    first = stage(first.drop("last").join(of("p_"), F.col("pivot") == F.col("p_node")).drop("p_node"), "pivots")
    full = members.join(of("m_"), F.col("node") == F.col("m_node")).drop("m_node")
    pairs = (full.join(first, (F.col("key") == F.col("k")) & (F.col("node") != F.col("pivot")) & alike)
             .select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    links = stage(verify(pairs), "links")
    members = members.join(first.select("k", "pivot"), (F.col("key") == F.col("k")) & (F.col("node") != F.col("pivot"))).select("key", "slot", "node")
    comp, now, turns, before = components(links), (first,), 0, None
    while True:
        named = members.join(comp.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
            "key", "slot", "node", F.coalesce("component", "node").alias("comp"))
        several = named.groupBy(F.col("key").alias("k")).agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("k")
        members = stage(named.join(several, F.col("key") == F.col("k"), "left_semi"), "bucket")
        used_up(*now)
        sizes = members.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy(F.col("key").alias("k")).agg(
            F.sum("n").alias("members"), ((F.sum("n").cast("double") ** 2 - F.sum(F.col("n").cast("double") ** 2)) / 2).alias("pairs"))
        sizes = stage(sizes, "bucket-sizes")
        work = sizes.agg(F.sum("members").alias("members"), F.sum("pairs").alias("pairs")).first()
        if not work["members"]:
            return comp, links
        star = work["pairs"] > WORTH * work["members"] and turns < STARS and (before is None or work["pairs"] < 0.75 * before)
        old, was = links, comp
        if star:
            turns, before = turns + 1, work["pairs"]
            # the same nodes are drawn in all their buckets
            drawn = F.struct(F.xxhash64("node", F.lit(turns)).alias("h"), F.col("node").alias("p0"), F.col("comp").alias("c"))
            turn = stage(members.groupBy(F.col("key").alias("k")).agg(F.min(drawn).alias("d")).select("k", "d.p0", "d.c")
                         .join(of("p_"), F.col("p0") == F.col("p_node")).drop("p_node"), "pivots")
            pairs = (members.join(of("m_"), F.col("node") == F.col("m_node"))
                     .join(turn, (F.col("key") == F.col("k")) & (F.col("comp") != F.col("c")) & alike)
                     .select(F.least("node", "p0").alias("a"), F.greatest("node", "p0").alias("b")).distinct())
        else:
            if renew is not None:
                marks = stage(renew(members.select("node").distinct()), "marks")
            one = _cells(members, sizes, "a_", "x", "y").join(of("m_"), F.col("a_node") == F.col("m_node"))
            other = _cells(members, sizes, "b_", "y", "x").drop("slot").join(of("p_"), F.col("b_node") == F.col("p_node"))
            meet = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in ("key", "x", "y")]
            pairs = (one.join(other, meet[0] & meet[1] & meet[2] & (F.col("a_node") < F.col("b_node")) & (F.col("a_comp") != F.col("b_comp")) & alike)
                     .select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct())
        links = stage(links.unionByName(verify(pairs)).distinct(), "links")
        comp = components(links)
        used_up(old, was, sizes)
        if not star:
            used_up(members)
            return comp, links
        now = (members, turn)
        members = members.join(turn.select("k", "p0"), (F.col("key") == F.col("k")) & (F.col("node") != F.col("p0"))).select("key", "slot", "node")
