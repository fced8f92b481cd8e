"""Embeddings: near-duplicates by a subspace pigeonhole join, and exact top-k search by no-random-access aggregation.

Near-duplicates. Unit vectors with cosine c lie at squared distance 2 - 2 c. They are rotated by one random orthogonal
matrix and split into blocks of ``BLOCK`` coordinates; every block gets its share of the squared-distance budget in
proportion to its coordinates. A pair within the budget is within the share in some block, so the union of the blocks'
range joins misses none. A block's range join is a grid on its first two coordinates with cells wider than the range: a
vector stands in its own cell and probes the later neighbours it can reach. Crowded cells are cut into tiles of about ``TILE`` by
``TILE`` vectors; a tile's block distances are matrix products, and what is within the share is verified over all
coordinates in double precision at once. A pair belongs to the first block that holds it, so each is counted once; a tile
returns link counts and a spanning set of links, not its pairs. Equal vectors are one class beforehand.

Search. Queries and candidates are dealt to tiles. In a tile every coordinate is a list sorted by value; a query reads
all lists in step from the end that its own coordinate favours, keeps for each candidate a lower bound (what was read plus
the worst of the lists it wasn't met in) and an upper bound (the values last read instead), and stops when no more than a
handful of candidates can reach the k-th lower bound; their scores are then resolved exactly in integers. Each tile's best k meet in
one window per query.

Both are quadratic in the worst case, as exact joins in many dimensions are; work is dealt over tiles of bounded size.

Nulls: vectors that are null, empty or hold null or non-finite components take no part (near-duplicates: nor do zero vectors; they
link with nothing), nor do rows without an id. Vectors of different lengths are not compared. Rows that share an id count as
vectors of their own that bear one name. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scintlake.llm.graph import components
from scintlake.session import stage

#: coordinates of a block
BLOCK = 8
#: vectors on each side of a tile, about
TILE = 16384
#: rows of a distance matrix held at once
STRIP = 128
SLACK = 1e-12


def finite(v: Column) -> Column:
    """The vector is there and all its components are finite numbers."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & good, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


_rotations: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    if dim not in _rotations:
        _rotations[dim] = np.linalg.qr(np.random.Generator(np.random.PCG64(dim)).normal(size=(dim, dim)))[0]
    return _rotations[dim]


def _shares(dim: int, distance: float) -> tuple[np.ndarray, np.ndarray]:
    """First coordinate of each block, and its share of the squared distance."""
    at = np.arange(0, dim, BLOCK)
    return at, distance * np.diff(np.append(at, dim)) / dim


SPOTS = "node long, weight long, dim int, z binary, spots array<struct<block:int,c0:int,c1:int,probe:boolean>>"


def _placer(distance: float):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v").cast(pa.list_(pa.float64()))
            sizes = np.diff(lists.offsets.to_numpy())
            for dim in np.unique(sizes):
                rows = pa.array(np.flatnonzero(sizes == dim))
                x = _matrix(lists.take(rows))
                x = x / np.abs(x).max(axis=1, keepdims=True)            # no overflow in the norm
                z = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))) @ rotation(int(dim))
                spots: list[list[dict]] = [[] for _ in rows]
                for b, (lo, share) in enumerate(zip(*_shares(int(dim), distance), strict=True)):
                    reach = np.sqrt(share) + 1e-6
                    side = 4 * reach
                    y = z[:, lo:lo + 2] if lo + 1 < dim else np.column_stack((z[:, lo], np.zeros(len(z))))
                    home = np.floor(y / side).astype(int)
                    low, high = y - home * side <= reach, (home + 1) * side - y <= reach
                    for i, (h0, h1) in enumerate(home.tolist()):
                        spots[i].append({"block": b, "c0": h0, "c1": h1, "probe": False})
                        for d0 in (0, 1):
                            for d1 in (-1, 0, 1):
                                if (d0, d1) > (0, 0) and (not d0 or high[i, 0]) and (not d1 or (high if d1 > 0 else low)[i, 1]):
                                    spots[i].append({"block": b, "c0": h0 + d0, "c1": h1 + d1, "probe": True})
                kind = pa.list_(pa.struct([("block", pa.int32()), ("c0", pa.int32()), ("c1", pa.int32()), ("probe", pa.bool_())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(rows), batch.column("weight").take(rows), pa.array(np.full(len(rows), dim, dtype=np.int32)),
                     pa.array([r.tobytes() for r in z], pa.binary()), pa.array(spots, kind)], ["node", "weight", "dim", "z", "spots"])
    return place


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that links (i, j) reach."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


FOUND = "kind int, a long, b long, n long"


def _tiler(distance: float, cosine: float):
    def tile(table: pa.Table) -> pa.Table:
        side, node, weight = (table.column(c).to_numpy() for c in ("side", "node", "weight"))
        dim, block = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
        z = np.frombuffer(b"".join(table.column("z").to_pylist()), dtype=np.float64).reshape(len(node), dim)
        at, shares = _shares(dim, distance)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        own = not table.column("probes")[0].as_py() and table.column("p")[0].as_py() == table.column("q")[0].as_py()
        if own:
            right = left
        cut = slice(at[block], at[block] + BLOCK)
        half = ((z[:, cut] ** 2).sum(axis=1) / 2)[:, None]
        one = np.ones_like(half)
        # one product of rows (x, -|x|^2 / 2, -1) and (y, 1, |y|^2 / 2) is minus half the squared distance
        lhs, rhs = (np.hstack(x).astype(np.float32) for x in ((z[left, cut], -half[left], -one[left]), (z[right, cut], one[right], half[right])))
        rhs = np.ascontiguousarray(rhs.T)
        pairs = [np.empty((2, 0), dtype=np.int64)]
        near = [np.empty(0)]
        for s in range(0, len(left), STRIP):
            a = left[s:s + STRIP]
            i, j = np.divmod(np.flatnonzero(lhs[s:s + STRIP] @ rhs >= -shares[block] / 2 - 1e-5), max(len(right), 1))
            if own:
                i, j = i[s + i < j], j[s + i < j]
            for k in range(0, len(i), 1 << 17):
                x, y = a[i[k:k + (1 << 17)]], right[j[k:k + (1 << 17)]]
                apart = np.add.reduceat((z[x] - z[y]) ** 2, at, axis=1)
                first = np.argmax(apart <= shares + SLACK, axis=1) == block
                c = (z[x] * z[y]).sum(axis=1)
                good = first & (c >= cosine - SLACK) & (apart[:, block] <= shares[block] + SLACK) & (node[x] != node[y])
                pairs.append(np.stack((x[good], y[good])))
                near.append(c[good])
        (i, j), c = np.concatenate(pairs, axis=1), np.concatenate(near)
        sure = c > cosine + SLACK
        u, v = node[i[~sure]], node[j[~sure]]
        i, j = i[sure], j[sure]
        n = np.bincount(i, weights=weight[j], minlength=len(node)) + np.bincount(j, weights=weight[i], minlength=len(node))
        linked = np.flatnonzero(n)
        root = _roots(len(node), i, j)
        hung = np.flatnonzero(root != np.arange(len(node)))
        kind = np.repeat([0, 1, 2], [len(linked), len(hung), len(u)])
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": np.concatenate((node[linked], node[hung], u)),
                         "b": np.concatenate((node[linked], node[root[hung]], v)),
                         "n": np.concatenate((n[linked].astype(np.int64), np.zeros(len(hung) + len(u), dtype=np.int64)))})
    return tile


def tiles(spots: DataFrame) -> DataFrame:
    """(node, dim, block, c0, c1, probe) -> a row for each tile that a spot takes part in, on side 0 or 1."""
    cell = ["dim", "block", "c0", "c1"]
    counts = spots.groupBy(*[F.col(c).alias(f"_{c}") for c in cell]).agg(
        F.ceil(F.count(F.when(~F.col("probe"), 1)) / TILE).cast("int").alias("homes"),
        F.ceil(F.count(F.when(F.col("probe"), 1)) / TILE).cast("int").alias("probers"))
    at = spots.join(counts.filter("homes > 0"), [F.col(c) == F.col(f"_{c}") for c in cell])
    own = F.pmod(F.xxhash64("node"), F.when(F.col("probe"), F.col("probers")).otherwise(F.col("homes"))).cast("int")
    one = lambda probes, p, q, side: F.struct(F.lit(probes).alias("probes"), p.alias("p"), q.alias("q"), F.lit(side).alias("side"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda x: x < n)
    at = at.withColumn("own", own)
    home = F.concat(F.transform(F.sequence("own", F.col("homes") - 1), lambda x: one(False, F.col("own"), x, 0)),
                    F.transform(upto(F.col("own")), lambda x: one(False, x, F.col("own"), 1)),
                    F.transform(upto(F.col("probers")), lambda x: one(True, F.col("own"), x, 0)))
    probe = F.transform(upto(F.col("homes")), lambda x: one(True, x, F.col("own"), 1))
    return at.select("node", *cell, F.explode(F.when(F.col("probe"), probe).otherwise(home)).alias("t")).select("node", *cell, "t.*")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept, a row per row of ``vectors`` (vec_id, embedding).

    ``n_links`` counts the other vectors at ``cosine`` or more, ``component_id`` is the least vec_id that links reach,
    itself included, and ``kept`` is vec_id = component_id.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.withColumn("joins", finite(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull())
    rows = stage(rows.withColumn("h1", F.when(F.col("joins"), F.xxhash64("v"))).withColumn("h2", F.when(F.col("joins"), F.hash("v"))), "vectors")
    classes = stage(rows.filter("joins").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("v").alias("v"))
                    .withColumn("node", F.col("h1")), "classes")
    distance = 2 - 2 * cosine
    placed = stage(classes.select("node", "weight", "v").mapInArrow(_placer(distance), SPOTS), "placed")
    dealt = tiles(placed.select("node", "dim", F.explode("spots").alias("s")).select("node", "dim", "s.*"))
    full = dealt.join(placed.select(F.col("node").alias("z_node"), "weight", "z"), F.col("node") == F.col("z_node")).drop("z_node")
    found = stage(full.groupBy("dim", "block", "c0", "c1", "probes", "p", "q").applyInArrow(_tiler(distance, cosine), FOUND), "found")
    # pairs that rounding leaves open are computed from the vectors as given
    x = classes.select(F.col("node").alias("xn"), F.col("v").alias("x"), F.col("weight").alias("xw"))
    y = classes.select(F.col("node").alias("yn"), F.col("v").alias("y"), F.col("weight").alias("yw"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    open_pairs = (found.filter("kind = 2").join(x, F.col("a") == F.col("xn")).join(y, F.col("b") == F.col("yn"))
                  .filter(dot("x", "y") >= cosine * F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y"))).select("a", "b", "xw", "yw"))
    open_pairs = stage(open_pairs, "open-pairs")
    counts = (found.filter("kind = 0").select("a", "n").unionAll(open_pairs.select("a", F.col("yw").alias("n")))
              .unionAll(open_pairs.select(F.col("b").alias("a"), F.col("xw").alias("n"))).groupBy(F.col("a").alias("cn")).agg(F.sum("n").alias("others")))
    comp = components(found.filter("kind = 1").select("a", "b").unionAll(open_pairs.select("a", "b"))).withColumnRenamed("node", "kn")
    named = (classes.select(F.col("h1").alias("n1"), F.col("h2").alias("n2"), "node", "weight", "least").join(counts, F.col("node") == F.col("cn"), "left")
             .join(comp, F.col("node") == F.col("kn"), "left"))
    # ids can be shared, so classes go by their hashes until here; a component is named by its least id
    named = stage(named.select("n1", "n2", "least", "component", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "vector-classes")
    names = named.filter("component is not null").groupBy(F.col("component").alias("nc")).agg(F.min("least").alias("name"))
    named = named.join(names, F.col("component") == F.col("nc"), "left").select("n1", "n2", "n_links", F.coalesce("name", "least").alias("component_id"))
    return (rows.join(named, (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2")), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))


#: candidates and queries of a search tile, about
CANDIDATES, QUERIES = 4096, 1024
#: candidates that may be left for the exact scores
LEFT = 48
#: the first stop comes after this part of every list
FIRST = 2
BEST = "query_id long, name long, vec_id long, score long"


def _stops(n: int, k: int) -> Iterator[int]:
    """How far the lists are read: a share of them, then three quarters of what is left again and again, at last all."""
    to = min(max(n // FIRST, k), n)
    while to < n:
        yield to
        to = n - (n - to) // 4 if n - to > 32 else n
    yield n


def _best(ids: np.ndarray, y: np.ndarray, query_ids: np.ndarray, names: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """(query, its name, candidate, score): the k best candidates of each query, ties to the smaller id.

    Lists of positive coordinates of a query are read from their largest value on, the others from their smallest. What either reading has met
    so far is the same for all queries, so their bounds at a stop are matrix products.
    """
    n = len(y)
    order = np.argsort(y, axis=0, kind="stable")                         # a list per coordinate, ascending
    place = np.empty(y.shape, dtype=np.int32)
    np.put_along_axis(place, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
    values = np.take_along_axis(y, order, axis=0).astype(np.float64)
    dense, f = y.astype(np.float64), queries.astype(np.float64)
    plus, minus = np.maximum(f, 0), np.minimum(f, 0)
    worst_plus, worst_minus = plus * values[0], minus * values[-1]
    out = []
    active = np.arange(len(queries))
    for to in _stops(n, k):
        top, bottom = (place >= n - to).astype(np.float64).T, (place < to).astype(np.float64).T
        dense_top, dense_bottom = dense.T * top, dense.T * bottom
        last_plus, last_minus = plus * values[n - to], minus * values[to - 1]
        still = []
        for s in range(0, len(active), STRIP):
            a = active[s:s + STRIP]
            got = plus[a] @ dense_top + minus[a] @ dense_bottom
            # a list that hasn't met a candidate adds its worst value to the lower bound, the last one read to the upper
            low = got - worst_plus[a] @ top - worst_minus[a] @ bottom + (worst_plus[a] + worst_minus[a]).sum(axis=1)[:, None]
            high = got - last_plus[a] @ top - last_minus[a] @ bottom + (last_plus[a] + last_minus[a]).sum(axis=1)[:, None]
            same = ids[None, :] == query_ids[a][:, None]
            low[same], high[same] = -np.inf, -np.inf
            kth = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(a), -np.inf)
            slack = np.where(np.isfinite(kth), 1e-9 * (1 + np.abs(kth)), 0)
            can = (high >= (kth - slack)[:, None]) & ~same
            done = (can.sum(axis=1) <= max(LEFT, k)) | (to == n)
            still.append(a[~done])
            for i in np.flatnonzero(done):
                left = np.flatnonzero(can[i])
                score = y[left] @ queries[a[i]]
                for r in np.lexsort((ids[left], -score))[:k]:
                    out.append((int(query_ids[a[i]]), int(names[a[i]]), int(ids[left[r]]), int(score[r])))
        active = np.concatenate(still) if still else active[:0]
        if not len(active):
            break
    return out


def _searcher(k: int):
    def search(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy(zero_copy_only=False)
        ids, names, v = table.column("vec_id").to_numpy(), table.column("name").to_numpy(), _matrix(table.column("v").combine_chunks())
        rows = _best(ids[~query], v[~query], ids[query], names[query], v[query], k) if query.any() and not query.all() else []
        return pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(("query_id", "name", "vec_id", "score"))})
    return search


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query, ties to the smaller id.

    Components become floor(scale * x). Queries are the rows whose id is divisible by ``every``; candidates are all rows
    of other ids and the same length. Query rows that share an id have a list each. Scores must fit a long.
    """
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(finite(F.col("x")) & F.col("vec_id").isNotNull())
    rows = stage(rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v")).withColumn("dim", F.size("v")), "scaled")
    is_query = F.col("vec_id") % every == 0
    counts = rows.groupBy(F.col("dim").alias("d")).agg(F.ceil(F.count("*") / CANDIDATES).cast("int").alias("cs"),
                                                       F.greatest(F.ceil(F.count(F.when(is_query, 1)) / QUERIES), F.lit(1)).cast("int").alias("qs"))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    candidates = rows.join(counts, F.col("dim") == F.col("d")).select(
        "dim", dealt(F.col("cs")).alias("c"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), F.lit(False).alias("query"), "vec_id", F.lit(0).cast("long").alias("name"), "v")
    # equal query rows are searched once and listed as often as they stand there
    own = rows.filter(is_query).groupBy("dim", "vec_id", F.xxhash64("v").alias("name")).agg(F.first("v").alias("v"), F.count("*").alias("times"))
    queries = own.join(counts, F.col("dim") == F.col("d")).select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("cs") - 1)).alias("c"), dealt(F.col("qs")).alias("q"), F.lit(True).alias("query"), "vec_id", "name", "v")
    # a tile is few bytes and much work, so tiles are dealt to a stated number of tasks
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = candidates.unionAll(queries).repartition(tasks, "dim", "c", "q").groupBy("dim", "c", "q").applyInArrow(_searcher(k), BEST)
    order = W.partitionBy("query_id", "name").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    times = own.select(F.col("vec_id").alias("t_id"), F.col("name").alias("t_name"), "times")
    return (ranked.join(times, (F.col("query_id") == F.col("t_id")) & (F.col("name") == F.col("t_name")))
            .select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("col"))
