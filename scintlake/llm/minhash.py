"""MinHash near-duplicates with tensored banding, links confirmed on full shingle sets.

Two small collections of ``m`` band hashes of ``r`` minhashes each are computed per document; the m * m table keys are
all pairs of one band from either collection. So 2 m r minhashes do the work of m * m * 2 r. A pair of Jaccard
similarity J meets in some table with probability (1 - (1 - J**r)**m)**2: with r = 3 and m = 10 that is 0.99985 at 0.85,
0.9999 and more above. Bucket mates whose sketches (4 bits of every minhash) are too unlike are not compared, with a
chance below 1e-7 for a true pair, nor are those whose shared shingles are too few, which hides none. These are the only places where a link can be missed.

Steps: equal shingle sets become one class, so copies never multiply pairs. Bands that occur once are dropped, and
table keys are formed only for classes that keep bands of both collections (a key needs both, so no key shared by two
classes is lost). Buckets are resolved by ``graph.bucket_components``; a candidate's full sets are intersected.

Scale: the first pass emits 2 m hashes a document; only texts of documents that
have candidates are shuffled, to hash their sets. Hot bands, buckets and pivots meet in aggregates and equi-joins that adaptive execution can split.

Nulls: a null or empty text has no shingles and links with nothing. Rows with one id are one document whose set
is that of any of them; rows without an id link with nothing. Columns other than id and text do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scintlake.llm import shingles as sh
from scintlake.llm.bitmaps import bitmap, held_rows
from scintlake.llm.graph import bucket_components
from scintlake.session import stage

#: bits kept of every minhash, one to a sketch word
PLANES = 4
SKETCH = [f"s{p}" for p in range(PLANES)]
PROFILE = "doc_id long, n_shingles long, class binary, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH)
SETS = "node long, shingles array<long>"


def _factors(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _profiler(k: int, m: int, r: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(2 * m * r)
        for batch in batches:
            for i, words, counts in sh.chunks(batch.column("text")):
                hashes, n = sh.shingle_hashes(words, counts, k)
                ends = np.cumsum(n)
                starts = ends - n
                some = np.flatnonzero(n)
                bands = np.zeros((2 * m, len(some)), dtype=np.uint64)
                sketch = np.zeros((PLANES, len(n)), dtype=np.uint64)
                for t in range(2 * m * r if len(some) else 0):
                    least = np.minimum.reduceat(hashes * factors[t], starts[some])
                    bands[t // r] = sh.mix(bands[t // r] + least + np.uint64(t))
                    bits = sh.mix(least)
                    for p in range(PLANES):
                        sketch[p, some] ^= ((bits >> np.uint64(p)) & np.uint64(1)) << np.uint64(t % 64)
                sizes, names = np.zeros(len(n), dtype=np.int64), [None] * len(n)
                for j in some:
                    s = np.sort(hashes[starts[j]:ends[j]])
                    if len(s) > 1:
                        s = s[np.concatenate(([True], s[1:] != s[:-1]))]
                    sizes[j] = len(s)
                    names[j] = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                length = np.where(n > 0, 2 * m, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)),
                                                 pa.array(bands.T.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, len(n)).cast(pa.int64()), pa.array(sizes), pa.array(names, pa.binary()), lists,
                     *(pa.array(x.view(np.int64)) for x in sketch)], ["doc_id", "n_shingles", "class", "bands", *SKETCH])
    return profile


def _setter(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, words, counts in sh.chunks(batch.column("text")):
                hashes, n = sh.shingle_hashes(words, counts, k)
                parts = [np.unique(x) for x in np.split(hashes, np.cumsum(n)[:-1])]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)),
                    pa.array(np.concatenate(parts).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, len(n)).cast(pa.int64()), lists], ["node", "shingles"])
    return sets


def profiles(docs: DataFrame, k: int = 5, m: int = 10, r: int = 3) -> DataFrame:
    """Per row: doc_id, n_shingles, the class (hash of the whole set; null without shingles) and 2 m bands."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_profiler(k, m, r), PROFILE)


def table_members(bands: DataFrame, m: int) -> DataFrame:
    """(node, bands) -> (key, slot, node): the tensored table keys of nodes, formed from bands that others have too."""
    one = bands.select("node", F.posexplode("bands").alias("at", "h"))
    shared = one.groupBy(F.col("h").alias("sh"), F.col("at").alias("ss")).agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    kept = one.join(shared, (F.col("h") == F.col("sh")) & (F.col("at") == F.col("ss")), "left_semi")
    sides = kept.groupBy("node").agg(F.collect_list(F.when(F.col("at") < m, F.struct("at", "h"))).alias("left"),
                                     F.collect_list(F.when(F.col("at") >= m, F.struct("at", "h"))).alias("right"))
    return (sides.select("node", F.explode("left").alias("l"), "right").select("node", "l", F.explode("right").alias("r"))
            .select(F.xxhash64("l.at", "l.h", "r.at", "r.h").alias("key"), (F.col("l.at") * (2 * m) + F.col("r.at")).alias("slot"), "node"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets satisfy 100 * intersection >= percent * union."""
    other = sets.select(F.col("node").alias("b_node"), F.col("shingles").alias("b_set"))
    one = sets.select(F.col("node").alias("a_node"), F.col("shingles").alias("a_set"))
    both = pairs.join(other, F.col("b") == F.col("b_node")).join(one, F.col("a") == F.col("a_node"))
    common = F.size(F.array_intersect("a_set", "b_set"))
    return (both.filter(100 * common >= percent * (F.size("a_set") + F.size("b_set") - common)).select("a", "b"))


def _close(percent: int, m: int, r: int):
    """Sizes and shared shingles allow the similarity, sketches differ in no more bits than it makes likely, and the table is the first that both share.

    A minhash differs with probability 1 - J and then flips each of its bits with 1/2. The bound lies 5.5 standard
    deviations above the mean at the least similarity, so it hides a true pair with probability below 1e-7.
    """
    d = 2 * m * r * (1 - percent / 100)
    bound = math.ceil(PLANES / 2 * d + 5.5 * math.sqrt((PLANES / 2) ** 2 * d * percent / 100 + PLANES / 4 * d)) + 1

    def close(a, b, slot):
        # the intersection holds shared shingles only
        most = F.least(a["n_shared"], b["n_shared"])
        bits = reduce(lambda x, y: x + y, (F.bit_count(a[s].bitwiseXOR(b[s])) for s in SKETCH))
        first = lambda at: F.coalesce(*[F.when(F.get(a["bands"], F.lit(t)) == F.get(b["bands"], F.lit(t)), t) for t in at])
        left, right = first(range(m)), first(range(m, 2 * m))
        # compiled, unlike a lambda, since hot buckets work it out for all their pairs; tables are looked up for likely pairs only: a condition joined by "and" would have its repeated parts worked out for every pair
        return slot == F.when(((100 + percent) * most >= percent * (a["n_shingles"] + b["n_shingles"])) & (bits <= bound), left * (2 * m) + right)
    return close


def _renewed(marks: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``marks`` of ``nodes`` with ``n_shared``, how many of a set's shingles stand in any other of their sets as well.

    Near copies of one text that are too unlike to be linked are alike in all they share; what each has to itself rules out their pairs.
    """
    some = nodes.select(F.col("node").alias("w"))
    each = sets.join(some, F.col("node") == F.col("w"), "left_semi").select("node", F.explode("shingles").alias("h"))
    alone = (each.groupBy("h").agg(F.count("*").alias("c"), F.min("node").alias("u")).filter("c = 1")
             .groupBy("u").agg(F.count("*").alias("alone")))
    return (marks.join(some, F.col("node") == F.col("w"), "left_semi").join(alone, F.col("node") == F.col("u"), "left")
            .withColumn("n_shared", F.col("n_shingles") - F.coalesce("alone", F.lit(0))).select(*marks.columns))


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, m: int = 10, r: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row per row of ``docs``.

    Documents link when 100 * intersection >= ``percent`` * union of their sets of k-word shingles. ``component_id`` is
    the least id that links reach; ``kept`` is doc_id = component_id.
    """
    prof = stage(profiles(docs, k, m, r), "minhash")
    classes = (prof.filter("n_shingles > 0 and doc_id is not null").groupBy("class")
               .agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", *SKETCH)]))
    classes = stage(classes, "classes")
    members = stage(table_members(classes, m), "tables")
    crowded = members.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("c")).filter("c > 1")
    members = stage(members.join(crowded, F.col("key") == F.col("k"), "left_semi"), "tables")
    wanted = stage(members.select(F.col("node").alias("w")).distinct(), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stage(held_rows(texts, bitmap(wanted, F.col("w")), F.col("doc_id"))
                 .join(wanted, F.col("doc_id") == F.col("w"), "left_semi").mapInArrow(_setter(k), SETS).dropDuplicates(["node"]), "sets")
    marks = stage(classes.drop("class").join(wanted, F.col("node") == F.col("w"), "left_semi").withColumn("n_shared", F.col("n_shingles")), "marks")
    comp, _ = bucket_components(members, marks, lambda pairs: confirmed(pairs, sets, percent), _close(percent, m, r),
                                lambda nodes: _renewed(marks, sets, nodes))
    of_class = (prof.filter("n_shingles > 0 and doc_id is not null").groupBy(F.col("class").alias("cl")).agg(F.min("doc_id").alias("rep")))
    named = (of_class.join(comp, F.col("rep") == F.col("node"), "left")
             .select("cl", F.coalesce("component", "rep").alias("component_id")))
    return (prof.join(named, F.col("class") == F.col("cl"), "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id") == F.col("component_id")))
