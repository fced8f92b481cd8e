"""URL filters by a path-template tree, with DataFrame expressions only.

Explicit rules decide first; the pages they decide are the labels (block or allow) from which the rest is judged. Per
host, paths form a tree by segment. Level by level, a segment that its parent sees rarely (an id, a slug) becomes the
wildcard ``*``, and so does a frequent branch whose share of blocked labels doesn't differ from its siblings' by a
two-proportion test. Segments from level ``depth`` on count as one tail. A template is rejected when its share of
blocked labels, smoothed towards its host's (and that towards the share of all labels), reaches ``reject``.

Scale: equal (host, path) pairs are counted first, so that levels work on narrow rows without html. Every level is an
aggregate per branch, one per parent, and an equi-join back; a hot host or parent is pre-aggregated map-side and its
join can be split.

Nulls: a null url, or one without ``://``, has an empty host and path; such pages form a host of their own. Repeated
pages count as often as they stand there. An empty table gives an empty result; without any labels nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scintlake.session import stage

AUTHORITY = r"://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host and path)
Rule = tuple[str, str]


def host_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    return (F.translate(F.regexp_extract(u, AUTHORITY, 1), UPPER, LOWER), F.regexp_extract(u, AUTHORITY, 2))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as (verdict, rule), or null. For lists of up to some hundred rules."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        fits.append(F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p),
                           F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<verdict:string,rule:string>")


def _similar(lab: str, bad: str, all_lab: str, all_bad: str, z: float) -> Column:
    """A branch's share of bad labels and that of its siblings are alike; true where one of them has no label."""
    a, b = F.col(lab), F.col(bad)
    ra, rb = F.col(all_lab) - a, F.col(all_bad) - b
    p = F.col(all_bad) / F.col(all_lab)
    diff = b / a - rb / ra
    return F.coalesce((a == 0) | (ra == 0) | (diff * diff <= z * z * p * (1 - p) * (1 / a + 1 / ra)), F.lit(True))


def templates(paths: DataFrame, depth: int = 4, support: int = 8, share: float = 0.02, z: float = 1.96) -> DataFrame:
    """(host, path, n, lab, bad) -> the same with ``template``.

    A segment stays literal when its branch has ``support`` pages and ``share`` of its parent's, and differs from its siblings.
    """
    seg = F.split("path", "/")
    at = paths.withColumn("segs", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.slice(seg, 2, 1_000_000_000)))
    at = at.withColumn("template", F.lit(""))
    for d in range(depth):
        s = F.get("segs", F.lit(d))
        if d == depth - 1:
            s = F.when(F.size("segs") > depth, F.lit("**")).otherwise(s)
        at = at.withColumn("seg", s)
        child = (at.filter("seg is not null").groupBy(F.col("host").alias("h"), F.col("template").alias("t"), F.col("seg").alias("s"))
                 .agg(F.sum("n").alias("cn"), F.sum("lab").alias("cl"), F.sum("bad").alias("cb")))
        parent = child.groupBy(F.col("h").alias("ph"), F.col("t").alias("pt")).agg(
            F.sum("cn").alias("pn"), F.sum("cl").alias("pl"), F.sum("cb").alias("pb"))
        literal = (F.col("cn") >= support) & (F.col("cn") >= share * F.col("pn")) & ~_similar("cl", "cb", "pl", "pb", z)
        kept = (child.join(parent, (F.col("h") == F.col("ph")) & (F.col("t") == F.col("pt"))).filter(literal).select("h", "t", "s"))
        at = (at.join(kept, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")) & (F.col("seg") == F.col("s")), "left")
              .withColumn("template", F.when(F.col("seg").isNull(), F.col("template"))
                          .when(F.col("s").isNotNull(), F.concat("template", F.lit("/"), F.col("s")))
                          .otherwise(F.concat("template", F.lit("/*"))))
              .drop("h", "t", "s", "seg"))
        at = stage(at, "url-level")          # one level's joins, not all levels' together, per plan
    return at.drop("segs")


def purities(paths: DataFrame, weight: float = 5.0) -> DataFrame:
    """(host, template, purity): smoothed share of bad labels, with ``weight`` labels' worth of the level above."""
    leaf = paths.groupBy("host", "template").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    host = leaf.groupBy(F.col("host").alias("h")).agg(F.sum("lab").alias("hl"), F.sum("bad").alias("hb"))
    world = host.agg(F.coalesce(F.sum("hb") / F.when(F.sum("hl") > 0, F.sum("hl")), F.lit(0.0)).alias("g"))
    upper = (F.col("hb") + weight * F.col("g")) / (F.col("hl") + weight)
    return (leaf.join(host, F.col("host") == F.col("h")).crossJoin(F.broadcast(world))     # one row
            .select("host", "template", ((F.col("bad") + weight * upper) / (F.col("lab") + weight)).alias("purity")))


def judged(pages: DataFrame, rules: list[Rule], reject: float = 0.8, depth: int = 4, support: int = 8, share: float = 0.02,
           z: float = 1.96, weight: float = 5.0) -> DataFrame:
    """page_id, host, path, rule, template, purity (of blocked labels) and verdict, a row per page."""
    host, path = host_path(F.col("url"))
    page = pages.select("page_id", host.alias("host"), path.alias("path"))
    page = page.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    counted = page.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("fit").alias("lab"),
                                               F.count(F.when(F.col("fit.verdict") == "block", 1)).alias("bad"))
    tree = templates(counted, depth, support, share, z)
    pure = purities(tree, weight).select(F.col("host").alias("ph"), F.col("template").alias("pt"), "purity")
    decided = (tree.join(pure, (F.col("host") == F.col("ph")) & (F.col("template") == F.col("pt")))
               .select(F.col("host").alias("h"), F.col("path").alias("p"), "template", "purity"))
    return (page.join(decided, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")))
            .select("page_id", "host", "path", F.col("fit.rule").alias("rule"), "template", "purity",
                    F.coalesce("fit.verdict", F.when(F.col("purity") >= reject, "block").otherwise("allow")).alias("verdict")))
