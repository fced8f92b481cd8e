"""Stateful tagging of an event stream and follow-up windows (ST1, ST2).

Rows may come late and out of order within the watermark's delay. State per run holds them until the watermark has passed
their time; then they are tagged in time order, so the result doesn't depend on how the stream was cut. Only rows older
than the watermark are dropped. Held rows stay in the state store as packed pieces in time order; a step has in memory those that overlap
in time, so a large micro-batch or a long delay does not fill it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.correlate import _entry_tag, _successor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NONE = -1
STATE = "prev_ts long, mu_ts long, mu_event long"
TAGGED = "run long, event long, ts long, nhit long, is_tag boolean, retrigger boolean, prev_event long, dt long, dt_prev long"


def advance(pdf: pd.DataFrame, state: tuple, dead: int, keep: tuple = (), payload: tuple = ()) -> tuple[pd.DataFrame, tuple]:
    """Tag the rows of one run that follow ``state`` (last event, last real tag and its payload); returns rows and the new state.

    Columns ``keep`` pass through; each column of ``payload`` gives ``prev_`` with the value of the last real tag, NaN without one.
    """
    prev_ts, mu_ts, mu_event, *handed = state
    pdf = pdf.sort_values(["ts", "event"], kind="stable").reset_index(drop=True)
    if pdf.empty:
        return pdf, state
    ts, tag, hard = (pdf[c].to_numpy() for c in ("ts", "tag", "hard"))
    pos = np.flatnonzero(tag)
    real = []
    if len(pos):
        nxt = _successor(ts[pos], hard[pos], dead)
        i = _entry_tag(ts[pos], hard[pos], mu_ts + dead if mu_ts != NONE else np.iinfo(np.int64).min)
        while i < len(pos):
            real.append(pos[i])
            i = nxt[i]
    real = np.array(real, dtype=int)
    # last real tag strictly before each row; position 0 stands for the state
    k = np.searchsorted(real, np.arange(len(ts)), side="left")
    r_ts, r_ev = np.append(mu_ts, ts[real]), np.append(mu_event, pdf["event"].to_numpy()[real])
    known = r_ts[k] != NONE
    before = np.append(prev_ts, ts[:-1])
    out = pdf[["run", "event", "ts", "nhit"]].assign(
        is_tag=tag, retrigger=tag & ~hard & known & (ts - r_ts[k] < dead), prev_event=np.where(known, r_ev[k], NONE),
        dt=pd.array(np.where(known, ts - r_ts[k], 0), dtype="Int64"),
        dt_prev=pd.array(np.where(before != NONE, ts - before, 0), dtype="Int64"))
    out.loc[~known, "dt"] = pd.NA
    out.loc[before == NONE, "dt_prev"] = pd.NA
    last = []
    for c in keep:
        out[c] = pdf[c]
    for c, value in zip(payload, handed, strict=True):
        all_values = np.append(value, pdf[c].to_numpy(float)[real])
        out[f"prev_{c}"] = all_values[k]
        last.append(float(all_values[-1]))
    return out, (int(ts[-1]), int(r_ts[-1]), int(r_ev[-1]), *last)


HELD = {"event": "<i8", "ts": "<i8", "nhit": "<i8", "tag": "?", "hard": "?"}
#: held rows are cut by time into pieces: a chunk of so many rows makes so many of them
CHUNK, PIECES = 1 << 16, 16


def _doubles(columns: tuple, prefix: str = "") -> str:
    return "".join(f", {prefix}{c} double" for c in columns)


class _Ordered(StatefulProcessor):
    """Holds rows until the watermark has passed them, then hands them on in time order.

    Held rows are packed arrays, each a short piece of time of what came in together, and are merged by their first times: a step has in memory
    a chunk that comes in, or a chunk that goes out and one piece (1 / 16) of each chunk held. ``keep`` and ``payload`` are columns of doubles
    (missing values NaN): the first pass through, the second stay in the state with the last real tag.
    """

    def __init__(self, dead: int, ticks_per_ms: int = 40_000, keep: tuple = (), payload: tuple = ()):
        self.dead, self.per_ms, self.keep, self.payload = dead, ticks_per_ms, tuple(keep), tuple(payload)
        self.types = np.dtype([*HELD.items(), *[(c, "<f8") for c in dict.fromkeys([*self.keep, *self.payload])]])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE + _doubles(self.payload))
        self.parts = handle.getValueState("parts", "n long")
        self.held = handle.getMapState("held", "first long, part long", "rows binary")

    def wake(self, *times: int) -> None:
        """One timer, at the earliest of the given milliseconds."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        if times:
            self.handle.registerTimer(min(times))

    def state(self) -> tuple:
        return tuple(self.last.get()) if self.last.exists() else (NONE, NONE, NONE, *[float("nan")] * len(self.payload))

    def hold(self, rows: np.ndarray, pieces: int = 1) -> None:
        """Keeps rows as pieces of time."""
        rows = np.sort(rows, order="ts", kind="stable") if pieces > 1 else rows
        for piece in np.array_split(rows, pieces):
            self.part += 1
            self.held.updateValue((int(piece["ts"].min()), self.part), (piece.tobytes(),))

    def take_in(self, rows: Iterator[pd.DataFrame]) -> None:
        waiting, size = [], 0
        for df in rows:
            packed = np.empty(len(df), self.types)
            for c in self.types.names:
                packed[c] = df[c].to_numpy()
            waiting.append(packed)
            size += len(df)
            if size >= CHUNK:
                self.hold(np.concatenate(waiting), PIECES)
                waiting, size = [], 0
        if size:
            self.hold(np.concatenate(waiting), max(1, size * PIECES // CHUNK))

    def released(self, run, rows: Iterator[pd.DataFrame], watermark: int) -> Iterator[tuple[pd.DataFrame, tuple]]:
        """Tagged rows that have become due and the state after them, in pieces of time order; ``due`` is then when the next held row is due."""
        self.part = before = int(self.parts.get()[0]) if self.parts.exists() else 0
        self.take_in(rows)
        old = state = self.state()
        limit = watermark * self.per_ms
        keys = sorted(tuple(k) for k in self.held.keys())
        ready = [k for k in keys if k[0] < limit]
        self.due: list[int] = [k[0] // self.per_ms for k in keys[len(ready):len(ready) + 1]]
        left, size = [], 0
        for key, upto in zip(ready, [*[k[0] for k in ready[1:]], limit]):
            left.append(np.frombuffer(bytes(self.held.getValue(key)[0]), self.types))
            size += len(left[-1])
            self.held.removeKey(key)
            if size < CHUNK and key != ready[-1]:
                continue
            # nothing that is still held comes before the first time of the next piece
            found = np.concatenate(left)
            go = found["ts"] < upto
            left, size = [found[~go]], 0
            # rows before the last released one are older than the watermark was then
            found = found[go & (found["ts"] >= state[0])]
            if len(found):
                out, state = advance(pd.DataFrame({c: found[c] for c in self.types.names}).assign(run=run), state, self.dead, self.keep, self.payload)
                yield out, state
        if left and len(left[0]):
            self.hold(left[0])
            self.due.append(int(left[0]["ts"].min()) // self.per_ms)
        if state is not old:
            self.last.update(state)
        if self.part != before:
            self.parts.update((self.part,))

    def step(self, run, rows: Iterator[pd.DataFrame], watermark: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self.step(key[0], rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.step(key[0], iter(()), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class Tagger(_Ordered):
    """Per run: rows not yet due, last event time and last real tag (ST1)."""

    def step(self, run, rows: Iterator[pd.DataFrame], watermark: int) -> Iterator[pd.DataFrame]:
        for out, _ in self.released(run, rows, watermark):
            yield out
        self.wake(*self.due)


class Followups(_Ordered):
    """Per run: rows not yet due and the open window of the last real tag (ST2).

    Emits candidates as they are released (kind ``cand``) and the number of events after a tag (kind ``n_after``) when
    its window closes: at the next real tag, or when the watermark has passed the window.
    """

    def __init__(self, dead: int, window: int, min_mult: int, ticks_per_ms: int = 40_000):
        super().__init__(dead, ticks_per_ms)
        self.window, self.min_mult = window, min_mult

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.count = handle.getValueState("count", "n long")

    def step(self, run, rows: Iterator[pd.DataFrame], watermark: int) -> Iterator[pd.DataFrame]:
        def counted(tags) -> pd.DataFrame:
            return pd.DataFrame({"run": run, "kind": "n_after", "event": list(tags), "prev_event": NONE, "value": [counts.pop(t) for t in list(tags)]})

        now = self.state()
        counts: dict[int, int] = {now[2]: int(self.count.get()[0])} if self.count.exists() else {}
        for out, now in self.released(run, rows, watermark):
            inside = out[~out["is_tag"] & (out["dt"].fillna(self.window + 1) <= self.window)]
            for tag in out[out["is_tag"] & ~out["retrigger"]]["event"]:
                counts.setdefault(int(tag), 0)
            for tag, n in inside.groupby("prev_event").size().items():
                counts[int(tag)] = counts.get(int(tag), 0) + int(n)
            cand = inside[inside["nhit"] >= self.min_mult].rename(columns={"dt": "value"}).assign(kind="cand")
            closed = counted([t for t in counts if t != now[2]])
            if len(cand) or len(closed):
                yield pd.concat([f[["run", "kind", "event", "prev_event", "value"]].astype({"value": "int64"}) for f in (cand, closed) if len(f)], ignore_index=True)
        times, end = self.due, (now[1] + self.window) // self.per_ms
        if counts and end < watermark:
            yield counted(list(counts))
        if counts:
            self.count.update((counts[now[2]],))
            times = [*times, end]
        elif self.count.exists():
            self.count.clear()
        self.wake(*times)


def _keyed(events: DataFrame, soft: float, hard: float) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return events.withColumn("tag", F.col("q17") >= soft).withColumn("hard", F.col("q17") >= hard).groupBy("run")


def stream_tagger(events: DataFrame, time: str, delay: str, soft: float, hard: float, dead: int, keep: tuple = (), payload: tuple = ()) -> DataFrame:
    """Events of a stream with their previous real tag, once the watermark has passed them (same columns as the batch join) (ST1).

    ``events`` has run, event, ts, nhit, q17 and the event time ``time`` of the watermark, which is ``ts`` in other units. Columns
    ``keep`` pass through, and every row gets the ``payload`` of its real tag as ``prev_`` columns, such as the tag's track; both are doubles,
    and what is missing is null.
    """
    nan = F.lit(float("nan"))
    filled = events.withColumns({c: F.coalesce(F.col(c).cast("double"), nan) for c in (*keep, *payload)}) if keep or payload else events
    out = _keyed(filled.withWatermark(time, delay), soft, hard).transformWithStateInPandas(
        statefulProcessor=Tagger(dead, keep=keep, payload=payload), outputStructType=TAGGED + _doubles(keep) + _doubles(payload, "prev_"),
        outputMode="Append", timeMode="EventTime")
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in (*keep, *[f"prev_{p}" for p in payload])}) if keep or payload else out


def stream_followups(events: DataFrame, time: str, delay: str, soft: float, hard: float, dead: int, window: int, min_mult: int) -> DataFrame:
    """Candidates and window counts of a stream (ST2); ``time`` is the event-time column of the watermark."""
    return _keyed(events.withWatermark(time, delay), soft, hard).transformWithStateInPandas(
        statefulProcessor=Followups(dead, window, min_mult), outputStructType="run long, kind string, event long, prev_event long, value long",
        outputMode="Append", timeMode="EventTime")


def stream_parents(tags: DataFrame, events: DataFrame, delay: str, window: int, reach: str, payload: tuple = ()) -> DataFrame:
    """Events of one stream with the last real tag of another at most ``window`` ticks before them (ST2), for append mode.

    An interval join of two watermarked streams: ``tags`` has run, event, ts, time and the columns ``payload``, ``events`` run, event, ts,
    time and any more. Both are joined on the run and a 256th of the window, which a tag has for as long as it lasts: the window, or up to the next tag where ``tags``
    has its time as ``until`` (null after the last one); an event then meets one tag only. ``reach`` is the window as an interval of event time; it bounds what the join keeps of either stream. Of several tags in
    reach the last one counts, which is known once the watermark has passed the event. Gives the columns of ``events`` without time, prev_event, dt and
    ``prev_`` columns.
    """
    width = max(window // 256, 1)
    block = lambda ts: F.expr(f"({ts} - pmod({ts}, {width}L)) div {width}L")
    last = F.col("ts") + window
    if "until" in tags.columns:
        last = F.greatest(F.least(last, F.coalesce("until", last)), F.col("ts"))
    t = tags.withColumn("tag_last", last).select(
        F.col("run").alias("tag_run"), F.col("event").alias("prev_event"), F.col("ts").alias("prev_ts"), F.col("time").alias("tag_time"), "tag_last",
        F.explode(F.sequence(block("ts"), block("tag_last"))).alias("tag_block"), *[F.col(c).alias(f"prev_{c}") for c in payload]).withWatermark("tag_time", delay)
    e = events.withColumn("block", block("ts")).withWatermark("time", delay)
    near = ((F.col("run") == F.col("tag_run")) & (F.col("block") == F.col("tag_block"))
            & F.col("time").between(F.col("tag_time"), F.col("tag_time") + F.expr(f"INTERVAL {reach}")))
    pairs = e.join(t, near & (F.col("ts") > F.col("prev_ts")) & (F.col("ts") <= F.col("tag_last"))).drop("tag_run", "tag_time", "tag_last", "block", "tag_block")
    rest = [c for c in events.columns if c not in ("run", "event", "time")]
    best = pairs.groupBy("time", "run", "event").agg(
        F.max_by(F.struct(*rest, "prev_event", "prev_ts", *[f"prev_{c}" for c in payload]), F.struct("prev_ts", "prev_event")).alias("r"))
    return best.select("run", "event", "r.*").withColumn("dt", F.col("ts") - F.col("prev_ts")).drop("prev_ts")
