"""Estimators of a user's own as table functions that SQL calls by name (UD3, UD4).

An :class:`Estimator` folds the rows of one key, an Arrow batch at a time, into a state of a few numbers, so no task holds
a group whole. :func:`register` makes three functions of it:

    SELECT * FROM centroid(TABLE(hits) PARTITION BY (run, event))
    SELECT * FROM moments_merge(TABLE(SELECT * FROM moments_part(TABLE(hits) PARTITION BY (cable, part))) PARTITION BY (cable))

The first suits keys of bounded size, such as events. The second pair is for keys that may hold a large share of all rows:
the parts of a key are folded in different tasks, then their states are merged. Rows with a null key are a key of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Estimator:
    """Fold over the rows of one key. ``keys`` and ``values`` are the columns, as DDL, of the key and of an estimate."""

    keys: str
    values: str

    def add(self, batch: pa.RecordBatch) -> None:
        """Take rows of the key."""
        raise NotImplementedError

    def state(self) -> list[float]:
        raise NotImplementedError

    def merge(self, state: np.ndarray) -> None:
        """Take the state of another part of the key."""
        raise NotImplementedError

    def estimate(self) -> tuple | None:
        """The values, or None if the rows don't allow any."""
        raise NotImplementedError


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """Columns as doubles, rows with a null or NaN left out."""
    cols = [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names]
    good = ~np.isnan(np.sum(cols, axis=0))
    return [c[good] for c in cols]


class ChargeCentroid(Estimator):
    """Vertex of an event by charge: mean of the sensors' places, stretched from the sphere and held inside ``limit``."""

    keys = "run long, event long"
    values = "x double, y double, z double"
    cap, stretch, limit = 20.0, 0.62, 800.0

    def __init__(self):
        self.sums = np.zeros(4)

    def add(self, batch):
        q, *place = _numbers(batch, "q", "px", "py", "pz")
        w = np.clip(q, 0.0, self.cap)
        self.sums += [w.sum(), *[(w * p).sum() for p in place]]

    def state(self):
        return self.sums.tolist()

    def merge(self, state):
        self.sums += state

    def estimate(self):
        if not self.sums[0] > 0:
            return None
        at = self.sums[1:] / self.sums[0] / self.stretch
        far = float(np.sqrt((at * at).sum()))
        return tuple(at * min(1.0, self.limit / far)) if far else tuple(at)


class Moments(Estimator):
    """Size, mean and width of a channel's charges."""

    keys = "cable long"
    values = "n long, mean double, sigma double"

    def __init__(self):
        self.n, self.mean, self.squares = 0, 0.0, 0.0

    def add(self, batch):
        q, = _numbers(batch, "q")
        if len(q):
            self.merge(np.array([len(q), q.mean(), ((q - q.mean()) ** 2).sum()]))

    def state(self):
        return [self.n, self.mean, self.squares]

    def merge(self, state):
        n, mean, squares = int(state[0]), state[1], state[2]
        if n:
            off, both = mean - self.mean, self.n + n
            self.squares += squares + off * off * self.n * n / both
            self.mean += off * n / both
            self.n = both

    def estimate(self):
        return (self.n, self.mean, float(np.sqrt(self.squares / self.n))) if self.n else None


def table_function(estimator: type[Estimator], step: str = "whole"):
    """The Arrow table function of an estimator: rows to estimates, rows to states (``part``) or states to estimates (``merge``)."""
    names = T.StructType.fromDDL(estimator.keys).names
    ddl = f"{estimator.keys}, {'state array<double>' if step == 'part' else estimator.values}"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    class Handler:
        def __init__(self):
            self.key, self.own = None, estimator()

        def eval(self, batch: pa.RecordBatch):
            if batch.num_rows:
                self.key = [batch.column(c)[0].as_py() for c in names]
                if step == "merge":
                    for state in batch.column("state"):
                        self.own.merge(np.array(state.as_py()))
                else:
                    self.own.add(batch)
            return iter(())

        def terminate(self):
            if self.key is not None:
                found = [self.own.state()] if step == "part" else self.own.estimate()
                if found is not None:
                    yield pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip([*self.key, *found], schema, strict=True)], schema=schema)

    return F.arrow_udtf(Handler, returnType=ddl)


def register(spark: SparkSession, name: str, estimator: type[Estimator]) -> None:
    """Make ``name``, ``name_part`` and ``name_merge`` known to SQL."""
    for suffix, step in (("", "whole"), ("_part", "part"), ("_merge", "merge")):
        spark.udtf.register(name + suffix, table_function(estimator, step))


def estimates(rows: DataFrame, name: str, estimator: type[Estimator], parts: int = 1, spread: str | None = None) -> DataFrame:
    """Estimates per key by the function registered as ``name``; with ``parts``, keys are dealt by ``spread`` and merged."""
    by = ", ".join(T.StructType.fromDDL(estimator.keys).names)
    if parts == 1:
        return rows.sparkSession.sql(f"SELECT * FROM {name}(TABLE({{rows}}) PARTITION BY ({by}))", rows=rows)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(spread), F.lit(parts)))
    return rows.sparkSession.sql(
        f"SELECT * FROM {name}_merge(TABLE(SELECT * FROM {name}_part(TABLE({{dealt}}) PARTITION BY ({by}, part))) PARTITION BY ({by}))", dealt=dealt)
