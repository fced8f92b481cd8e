"""Whitening of embeddings: projection on the eigenvectors of their covariance, each scaled to unit variance.

Entries become integers on a grid, so sums and the covariance are exact: every task adds the products of vectors centred on the
integers nearest to the means, as whole numbers, and what the rounding of the means leaves is taken off in whole numbers too.
Nothing cancels, however far the grid lies from zero, and results don't depend on the order of the tasks.

The eigenvectors start from a float32 decomposition and are corrected by the iteration of Ogita and Aishima, four matrix products
in extended precision a step: with R = I - X'X and S = X'AX the eigenvalues are s_ii / (1 - r_ii) and X += X E with e_ij =
(s_ij + l_j r_ij) / (l_j - l_i), or r_ij / 2 where the two eigenvalues are too close to tell apart. Such clusters are split by sub-solves: the
cluster's own small matrix X_k'AX_k, with the cluster's centre taken off, is decomposed, the cluster's vectors are turned by the result,
and the iteration goes on. It ends when a step changes nothing in double precision.

Scale: four narrow passes (sums, covariance, check, output) without a shuffle of vectors. What tasks send on is a number per pair of
dimensions, and the driver holds only matrices of dimensions by dimensions.

Nulls: vectors that are null or hold null or non-finite entries are dropped, so are empty ones and those with an entry whose grid number
is no long (2^62 or beyond). Vectors of different lengths are whitened apart, each length by itself. Repeated rows and rows that share an
id, also null ids, are vectors of their own. Components of no variance (constant tables, fewer vectors than dimensions) can't be whitened:
``whitened`` is null there, ``explained`` 0, and ``identity_error`` leaves them out. A deviation beyond the range of long is null. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scintlake.llm.vectors import finite
from scintlake.session import stage

#: rows whose products are added before they become Python integers
BLOCK = 4096
#: steps of the iteration; it needs two to four, and one or two more for each level of clusters
STEPS = 30
EXTENDED = np.longdouble


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(dim, rows, matrix of integers): blocks of vectors of one length."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("v"))
        sizes = np.diff(lists.offsets.to_numpy())
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            for lo in range(0, len(at), BLOCK):
                rows = pa.array(at[lo:lo + BLOCK])
                yield int(dim), batch.take(rows), lists.take(rows).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)


def _minus(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """x - centre as int64, or as Python integers where that could overflow."""
    wide = max(int(x.max()), -int(x.min())) + max(abs(int(c)) for c in centre) >= 1 << 62
    return x.astype(object) - centre if wide else x - centre.astype(np.int64)


def _gram(d: np.ndarray) -> np.ndarray:
    """d'd in whole numbers, as Python integers."""
    top = max(abs(int(d.max())), abs(int(d.min())))
    if top * top * len(d) < 1 << 53:                       # every sum is exact in float64
        f = d.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if top * top * len(d) < 1 << 63:
        return (d.astype(np.int64).T @ d.astype(np.int64)).astype(object)
    o = d.astype(object)
    return o.T @ o


#: whole numbers beyond a long travel as digits of 32 bits, the last one signed
SUMS = "dim int, i int, j int, digit int, value long"


def _digits(dim: int, total: np.ndarray, upper: bool = False) -> pa.RecordBatch:
    """The non-zero numbers of ``total``; with ``upper`` those of the upper triangle."""
    rows = []
    for (i, j), v in np.ndenumerate(total):
        k, v = 0, int(v)
        while v and not (upper and i > j):
            low = v if -(1 << 31) <= v < 1 << 31 else v & 0xFFFFFFFF
            rows.append((dim, i, j, k, low))
            v, k = v - low >> 32, k + 1
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == 4 else pa.int32()) for n, c in enumerate(cols)], ["dim", "i", "j", "digit", "value"])


def _summer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the entries, row 0, and the number of vectors, row 1, of every length."""
    totals: dict[int, np.ndarray] = {}
    for dim, _, x in _batches(batches):
        add = np.zeros((2, dim), dtype=object)
        add[0] = x.astype(object).sum(axis=0) if max(int(x.max()), -int(x.min())) >= 1 << 50 else x.sum(axis=0).astype(object)
        add[1, 0] = len(x)
        totals[dim] = totals.get(dim, 0) + add
    for dim, total in totals.items():
        yield _digits(dim, total)


def _multiplier(centres: dict[int, np.ndarray]):
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for dim, _, x in _batches(batches):
            totals[dim] = totals.get(dim, 0) + _gram(_minus(x, centres[dim]))
        for dim, total in totals.items():
            yield _digits(dim, total, upper=True)
    return multiply


def _collected(sums: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
    out: dict[int, dict[tuple[int, int], int]] = {}
    for r in sums.groupBy("dim", "i", "j", "digit").agg(F.sum("value").alias("value")).collect():
        cell = out.setdefault(r["dim"], {})
        cell[r["i"], r["j"]] = cell.get((r["i"], r["j"]), 0) + (r["value"] << 32 * r["digit"])
    return out


# ---- eigenvectors ---------------------------------------------------------------------------------------------------------------
def _clusters(e: np.ndarray, near: float) -> list[np.ndarray]:
    """Runs of indices whose sorted values lie within ``near`` of the one before, of two or more."""
    order = np.argsort(e)
    cuts = np.flatnonzero(np.diff(e[order]) > near) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def refine(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns of a symmetric matrix given in extended precision."""
    n = len(a)
    size = np.abs(a).max() if n else 0
    if not size > 0:
        return np.zeros(n, dtype=EXTENDED), np.eye(n, dtype=EXTENDED)
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(EXTENDED)
    eye, norm, last = np.eye(n, dtype=EXTENDED), np.sqrt((a * a).sum()), np.inf
    noise = 8 * n * np.finfo(EXTENDED).eps * norm
    for _ in range(STEPS):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        e = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        left = max(float(np.abs(off).max()), float(norm * np.abs(r).max()))
        near = max(2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum())), 8 * noise)
        gap = e[None, :] - e[:, None]
        apart = np.abs(gap) > near
        x = x + x @ np.where(apart, (s + e[None, :] * r) / np.where(apart, gap, 1), r / 2)
        turned = False
        # what the iteration can't tell apart is solved within the space that the cluster spans
        for c in _clusters(e, float(near)):
            part = x[:, c]
            small = part.T @ (a @ part) - e[c].mean() * (part.T @ part)
            loose = np.abs(small - np.diag(np.diag(small))).max()
            if loose > noise:                                   # within the noise any basis of the cluster's space will do
                scaled = (small + small.T) / (2 * np.abs(small).max())
                x[:, c] = part @ np.linalg.eigh(scaled.astype(np.float64))[1].astype(EXTENDED)
                turned = True
        if not turned and (left <= noise or left >= last / 2):
            break
        last = np.inf if turned else left
    for _ in range(2):
        x = x + x @ ((eye - x.T @ x) / 2)
    e = ((a @ x) * x).sum(axis=0)
    order = np.argsort(-e, kind="stable")
    return e[order] * size, x[:, order]


class Model:
    """What one length of vectors is whitened by."""

    def __init__(self, n: int, sums: list[int], centre: list[int], gram: dict[tuple[int, int], int], components: int):
        dim = len(sums)
        self.n, self.sums, self.centre = n, sums, centre
        rest = [s - n * c for s, c in zip(sums, centre, strict=True)]                # sums of the centred entries
        a = np.empty((dim, dim), dtype=EXTENDED)
        for i in range(dim):
            for j in range(i, dim):
                exact = Fraction(n * gram.get((i, j), 0) - rest[i] * rest[j], n * n)
                head = EXTENDED(float(exact))
                a[i, j] = a[j, i] = head + EXTENDED(float(exact - Fraction(float(head))))
        values, vectors = refine(a)
        k = min(components, dim)
        self.rest = rest
        self.values = values[:k].astype(np.float64)
        self.vectors = vectors[:, :k].astype(np.float64)
        trace = np.trace(a)
        self.explained = (values[:k] / trace).astype(np.float64) if trace > 0 else np.zeros(k)
        self.known = values[:k] > 64 * dim * np.finfo(np.float64).eps * max(values[0], 0)
        self.explained[~self.known] = 0.0
        # from centred to whitened, in one product
        self.scaled = self.vectors * np.divide(1.0, np.sqrt(np.maximum(self.values, 0)), out=np.zeros(k), where=self.known)
        self.identity_error = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        d = _minus(x, np.array(self.centre, dtype=object))
        top = max(abs(int(d.max())), abs(int(d.min())))
        if top * self.n + max(abs(r) for r in self.rest) < 1 << 62:
            return d.astype(np.int64) * self.n - np.array(self.rest, dtype=np.int64)
        return d.astype(object) * self.n - np.array(self.rest, dtype=object)

    def squares(self, dev: np.ndarray) -> list[int | None]:
        top = max(abs(int(dev.max())), abs(int(dev.min())))
        if top * top * dev.shape[1] < 1 << 63:
            return (dev.astype(np.int64) ** 2).sum(axis=1).tolist()
        found = (dev.astype(object) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in found]

    def whitened(self, dev: np.ndarray) -> np.ndarray:
        return (dev / self.n).astype(np.float64) @ self.scaled


def _checker(models: dict[int, Model]):
    """Sums (i = -1) and products of the whitened values."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for dim, _, x in _batches(batches):
            w = models[dim].whitened(models[dim].deviations(x))
            totals[dim] = totals.get(dim, 0) + np.vstack((w.sum(axis=0), w.T @ w))
        for dim, total in totals.items():
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.size, dim), pa.int32()), pa.array(i.ravel() - 1, pa.int32()), pa.array(j.ravel(), pa.int32()),
                                              pa.array(total.ravel(), pa.float64())], ["dim", "i", "j", "value"])
    return check


def _identity_errors(checked: DataFrame, models: dict[int, Model]) -> None:
    found: dict[int, dict] = {}
    for r in checked.groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).collect():
        found.setdefault(r["dim"], {})[r["i"], r["j"]] = r["value"]
    for dim, cells in found.items():
        m = models[dim]
        k = len(m.values)
        mean = np.array([cells[-1, j] for j in range(k)]) / m.n
        cov = np.array([[cells[i, j] for j in range(k)] for i in range(k)]) / m.n - np.outer(mean, mean)
        error = np.abs(cov - np.eye(k))[np.ix_(m.known, m.known)]
        m.identity_error = float(error.max()) if error.size else 0.0


OUT = "vec_id long, n long, deviation long, dim int, whitened array<double>"


def _writer(models: dict[int, Model]):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, rows, x in _batches(batches):
            m = models[dim]
            dev = m.deviations(x)
            k = len(m.values)
            w = pa.array(m.whitened(dev).ravel(), pa.float64(), mask=np.tile(~m.known, len(x)))
            offsets = pa.array(np.arange(0, k * len(x) + 1, k), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([m.n] * len(x), pa.int64()), pa.array(m.squares(dev), pa.int64()), pa.array([dim] * len(x), pa.int32()),
                 pa.ListArray.from_arrays(offsets, w)], ["vec_id", "n", "deviation", "dim", "whitened"])
    return write


def fitted(rows: DataFrame, components: int) -> dict[int, Model]:
    """The model of every vector length of ``rows`` (vec_id, v)."""
    sums = _collected(rows.mapInArrow(_summer, SUMS))
    n = {dim: cells[1, 0] for dim, cells in sums.items()}
    total = {dim: [cells.get((0, j), 0) for j in range(dim)] for dim, cells in sums.items()}
    centre = {dim: [(2 * s + n[dim]) // (2 * n[dim]) for s in t] for dim, t in total.items()}
    if not n:
        return {}
    grams = _collected(rows.mapInArrow(_multiplier({d: np.array(c, dtype=object) for d, c in centre.items()}), SUMS))
    models = {dim: Model(n[dim], total[dim], centre[dim], grams.get(dim, {}), components) for dim in n}
    _identity_errors(rows.mapInArrow(_checker(models), "dim int, i int, j int, value double"), models)
    return models


def on_grid(vectors: DataFrame, scale: int, shift: int) -> DataFrame:
    """vec_id and v, the vectors as whole numbers floor(scale * c) + shift; those that can't be are dropped."""
    v = F.col("embedding").cast("array<double>")
    good = finite(v) & F.forall(v, lambda c: F.abs(c * scale) < float(1 << 62))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).filter(finite(F.col("embedding")) & good)
    return rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c * scale).cast("long") + shift).alias("v"))


def whitened(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component.

    ``vectors`` has vec_id and embedding. Components are numbered from 1 by falling eigenvalue of the covariance.
    """
    rows = stage(on_grid(vectors, scale, shift), "grid-vectors")
    models = fitted(rows, components)
    spark = vectors.sparkSession
    # a row per length and component
    told = spark.createDataFrame([(dim, c + 1, float(m.explained[c]), m.identity_error) for dim, m in models.items() for c in range(len(m.values))],
                                 "kd int, kc int, explained double, identity_error double")
    wide = rows.mapInArrow(_writer(models), OUT)
    long = wide.select("vec_id", "n", "deviation", "dim", F.posexplode("whitened").alias("p", "whitened")).withColumn("component", F.col("p") + 1)
    return (long.join(F.broadcast(told), (F.col("dim") == F.col("kd")) & (F.col("component") == F.col("kc")))
            .select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"))
