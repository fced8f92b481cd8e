"""Document fingerprints: the least probable byte windows of a text in a chain of Bloom filters.

Every window of ``WINDOW`` bytes has an entropy, from the counts of its bytes. How rare an entropy is among all windows of the corpus is
its rank. In every run of neighbouring windows (``RUNS``) the rarest one, the leftmost of equals, gets a vote; windows with enough
votes (``VOTES``) are the features of the text. They enter a Bloom filter of ``BITS`` bits in the order of the text, by ``PROBES`` bit addresses
each; a feature that sets no new bit is passed over, and a filter with ``FULL`` features is closed and the next one begun. Two filters are compared by the bits they
share: what two unrelated filters of these sizes would share by chance, and ``CUT`` of the way from there to all bits of the emptier one, counts
as nothing. The likeness of two digests is the mean, by features, of the best match of each filter of the one with fewer features.

Texts under ``SHORT`` bytes hold a second chain, of windows of ``SMALL`` bytes, so that a text of a few words has features too; digests are
compared by the small chains if both have one, else by the wide ones. A text under ``SMALL`` bytes is one feature of its own.

Scale: one pass counts entropies (an array of fixed size per task). For the text that follows a document in descending order of ids,
documents are dealt once to blocks of ids and sorted there; the first document of each block is also sent to the block before it, so that
no task needs another's rows. Blocks are cut at approximate quantiles, at most ``BLOCKS`` of them, and stream through a task row by row.
A text is worked on in slabs of bounded size.

Nulls: a null text is the empty text; it has an empty fingerprint, which is like an empty one (1) and unlike any other (0). Rows without an id come
last, rows of one id in the order of a hash of their texts. Repeated rows are documents of their own. Columns other than doc_id and text are
ignored. A single document is its own next one. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scintlake.session import stage

WINDOW, SMALL, SHORT = 32, 8, 512
#: neighbouring windows among which one gets a vote, a power of two, and the votes that a feature needs, by window size
RUNS, VOTES = {WINDOW: 64, SMALL: 8}, {WINDOW: 16, SMALL: 2}
BITS, PROBES, FULL = 2048, 5, 160
#: share of the way from chance to all bits below which shared bits count as chance
CUT = 0.3
#: entropies are told apart in this many steps; windows below the least step carry too little to be a feature
STEPS, LEAST = 1000, 100
#: bytes worked on at once; with what overlaps they are numbered in 20 bits
SLAB = 1 << 17
#: documents of a block, about, and blocks at most
BLOCK_ROWS, BLOCKS = 4096, 1 << 15
#: texts whose bytes are joined before they are worked on
CHUNK = 1 << 20

PAD = max(RUNS.values())


#: entropies are summed in whole numbers of this unit, so that equal windows have equal sums wherever they stand
UNIT = 1 << 16


def _weights(w: int) -> np.ndarray:
    """What the m-th equal byte of a window adds to the sum of c log c, in units."""
    c = np.arange(w + 1, dtype=np.float64)
    return np.diff(np.round(c * np.log2(np.maximum(c, 1)) * UNIT).astype(np.int32), prepend=np.int32(0))


def _entropies(b: np.ndarray, w: int) -> np.ndarray:
    """Entropy step of every window of ``w`` bytes of ``b``, 0 to ``STEPS``."""
    n = len(b)
    before, after = np.ones(n, dtype=np.uint8), np.ones(n, dtype=np.uint8)
    same = np.empty(n, dtype=bool)
    for o in range(1, w):
        eq = np.equal(b[o:], b[:-o], out=same[:n - o]).view(np.uint8)
        before[o:] += eq                               # equal bytes among the w up to here
        after[:-o] += eq                               # and among the w from here on
    g = _weights(w)
    total = np.empty(n - w + 1, dtype=np.int32)
    total[0] = sum(int(g[:c + 1].sum()) for c in np.bincount(b[:w]))
    # the window moves by one: its first byte leaves, the next one comes in
    moves = (g[:, None] - g[None, :]).ravel()
    pair = before[w:].astype(np.int64)
    pair *= w + 1
    pair += after[:n - w]
    np.cumsum(moves.take(pair), out=total[1:])
    total[1:] += total[0]
    scaled = total * (STEPS / (w * np.log2(w) * UNIT))
    scaled += 1 - 1e-6
    return STEPS - scaled.astype(np.int32)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array with padding between them; where each starts and ends."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes + PAD)
    return np.frombuffer((b"\0" * PAD).join(texts) + b"\0" * PAD, dtype=np.uint8), ends - PAD - sizes, ends - PAD


def _slabs(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, w: int, halo: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(first window, last one, first of the core, entropy steps with -1 for windows that leave a text) per slab."""
    count = len(buffer) - w + 1
    for lo in range(0, count, SLAB):
        hi = min(lo + SLAB, count)
        a, z = max(lo - halo, 0), min(hi + halo, count)
        steps = _entropies(buffer[a:z + w - 1], w)
        # windows that start in a text and end in it
        edge = np.zeros(z - a + 1, dtype=np.int32)
        i, j = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, z)
        s, e = np.maximum(starts[i:j], a) - a, np.minimum(ends[i:j] - w + 1, z) - a
        some = e > s
        np.add.at(edge, s[some], 1)
        np.add.at(edge, e[some], -1)
        steps[np.cumsum(edge[:-1]) == 0] = -1
        yield a, lo, hi, steps


def _chosen(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, w: int, ranks: np.ndarray) -> np.ndarray:
    """Starts of the windows that are features, ascending."""
    if not len(starts) or len(buffer) < w:
        return np.zeros(0, dtype=np.int64)
    order = np.append(ranks, len(ranks)).astype(np.int32)              # the last entry is that of step -1
    order[:LEAST] = len(ranks)
    order <<= 20
    never, run = len(ranks), RUNS[w]
    found = []
    for a, lo, hi, steps in _slabs(buffer, starts, ends, w, 2 * run):
        n = len(steps)
        # padding on both sides: runs that reach over the end are runs of fewer windows
        key = np.full(n + 2 * run, np.iinfo(np.int32).max, dtype=np.int32)
        key[run:run + n] = order[steps] | np.arange(n, dtype=np.int32)
        width = 1
        while width < run:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        best = key[key < never << 20] & 0xFFFFF
        votes = np.bincount(best, minlength=n)
        at = np.flatnonzero(votes >= VOTES[w]) + a
        found.append(at[(at >= lo) & (at < hi)])
    return np.concatenate(found)


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _hashed(windows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of bytes."""
    wide = np.zeros((len(windows), -(-windows.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, :windows.shape[1]] = windows
    h = np.full(len(windows), windows.shape[1], dtype=np.uint64)
    for word in wide.view("<u8").T:
        h = (h ^ word) + _MIX[0]
        h = (h ^ h >> np.uint64(30)) * _MIX[1]
        h = (h ^ h >> np.uint64(27)) * _MIX[2]
        h ^= h >> np.uint64(31)
    return h


def _chain(hashes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(features, bits as bytes) of each filter of the chain."""
    step = BITS.bit_length() - 1
    probes = (hashes[:, None] >> (np.arange(PROBES, dtype=np.uint64) * np.uint64(step))) & np.uint64(BITS - 1)
    out, held, n = [], set(), 0
    for row in probes.tolist():
        if held.issuperset(row):
            continue
        held.update(row)
        n += 1
        if n == FULL:
            out.append((n, held))
            held, n = set(), 0
    if n:
        out.append((n, held))
    packed = []
    for n, bits in out:
        flags = np.zeros(BITS, dtype=np.uint8)
        flags[list(bits)] = 1
        packed.append((n, np.packbits(flags)))
    return packed


Digest = dict[int, list[tuple[int, np.ndarray]]]


def _scale(texts: list[bytes], w: int, ranks: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
    buffer, starts, ends = _joined(texts)
    at = _chosen(buffer, starts, ends, w, ranks)
    hashes = _hashed(np.lib.stride_tricks.sliding_window_view(buffer, w)[at]) if len(at) else np.zeros(0, dtype=np.uint64)
    cuts = np.searchsorted(at, starts[1:])
    return [_chain(h) for h in np.split(hashes, cuts)]


def digests(texts: list[bytes], ranks: dict[int, np.ndarray]) -> list[Digest]:
    """The digest of each text: window size -> chain of filters."""
    out: list[Digest] = [{} for _ in texts]
    for w, ids in ((WINDOW, [i for i, t in enumerate(texts) if len(t) >= WINDOW]), (SMALL, [i for i, t in enumerate(texts) if SMALL <= len(t) < SHORT])):
        for i, chain in zip(ids, _scale([texts[i] for i in ids], w, ranks[w]) if ids else [], strict=True):
            if chain:
                out[i][w] = chain
    for i, t in enumerate(texts):
        if t and not out[i]:                                    # too short or too plain for a window
            out[i][0] = _chain(np.frombuffer(hashlib.sha256(t).digest()[:8], dtype="<u8"))
    return out


def written(d: Digest) -> str:
    """A digest as text: window size, then features and bits (base64) of each filter."""
    return ";".join(f"{w}:" + ",".join(f"{n}.{base64.b64encode(bits.tobytes()).decode()}" for n, bits in chain) for w, chain in d.items())


def read(text: str) -> Digest:
    out: Digest = {}
    for part in filter(None, text.split(";")):
        w, chain = part.split(":")
        out[int(w)] = [(int(n), np.frombuffer(base64.b64decode(bits), dtype=np.uint8)) for n, bits in (f.split(".") for f in chain.split(","))]
    return out


def _matches(one: list[tuple[int, np.ndarray]], other: list[tuple[int, np.ndarray]]) -> float:
    y = np.unpackbits(np.stack([b for _, b in other]), axis=1).astype(np.float32)
    ny = y.sum(axis=1)
    total = 0.0
    for lo in range(0, len(one), 256):
        x = np.unpackbits(np.stack([b for _, b in one[lo:lo + 256]]), axis=1).astype(np.float32)
        nx = x.sum(axis=1)
        most = np.minimum(nx[:, None], ny[None, :]).astype(np.float64)
        chance = nx[:, None].astype(np.float64) * ny[None, :] / BITS
        least = chance + CUT * (most - chance)
        shared = (x @ y.T).astype(np.float64)
        score = np.where(shared >= most, 1.0, np.clip((shared - least) / np.maximum(most - least, 1e-9), 0.0, 1.0))
        total += float(score.max(axis=1) @ np.array([n for n, _ in one[lo:lo + 256]]))
    return total / sum(n for n, _ in one)


def likeness(a: Digest, b: Digest) -> float:
    """0 (no more in common than by chance) to 1; symmetric."""
    if not a or not b:
        return float(not a and not b)
    shared = [w for w in (SMALL, WINDOW, 0) if w in a and w in b]
    if not shared:
        return 0.0
    one, other = a[shared[0]], b[shared[0]]
    n, m = sum(f for f, _ in one), sum(f for f, _ in other)
    if n == m:
        return (_matches(one, other) + _matches(other, one)) / 2
    return _matches(one, other) if n < m else _matches(other, one)


# ---- Spark ----------------------------------------------------------------------------------------------------------------------
def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def _groups(texts: list[bytes]) -> Iterator[list[int]]:
    """Indices of texts whose bytes together are about ``CHUNK``."""
    group, size = [], 0
    for i, t in enumerate(texts):
        group.append(i)
        size += len(t) + PAD
        if size >= CHUNK:
            yield group
            group, size = [], 0
    if group:
        yield group


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows by entropy step, for both window sizes."""
    totals = {w: np.zeros(STEPS + 1, dtype=np.int64) for w in (WINDOW, SMALL)}
    for batch in batches:
        texts = _bytes(batch.column(0))
        for group in _groups(texts):
            for w, most in ((WINDOW, None), (SMALL, SHORT)):
                own = [texts[i] for i in group if len(texts[i]) >= w and (most is None or len(texts[i]) < most)]
                if own:
                    for a, lo, hi, steps in _slabs(*_joined(own), w, 0):
                        totals[w] += np.bincount(steps[steps >= 0], minlength=STEPS + 1)
    for w, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), w), pa.int32()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["w", "step", "n"])


def rarity(docs: DataFrame) -> dict[int, np.ndarray]:
    """Rank of every entropy step, 0 for the rarest, by its count over all windows of ``docs``; equal counts by step."""
    counts = docs.select("text").mapInArrow(_counter, "w int, step int, n long").groupBy("w", "step").agg(F.sum("n").alias("n")).collect()
    out = {}
    for w in (WINDOW, SMALL):
        total = np.zeros(STEPS + 1, dtype=np.int64)
        for r in counts:
            if r["w"] == w:
                total[r["step"]] = r["n"]
        out[w] = np.empty(STEPS + 1, dtype=np.int64)
        out[w][np.argsort(total, kind="stable")] = np.arange(STEPS + 1)
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of ``following``."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairer(ranks: dict[int, np.ndarray]):
    """Rows come by block; first the guest, the first document of the block that follows, then the block's own in descending order."""
    def rows_of(table: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*table, strict=True))
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    def closed(pairs: list[tuple]) -> pa.RecordBatch:
        """(id, text, digest, next text, next digest) of documents -> their rows."""
        changed = [edited(t, u) for _, t, _, u, _ in pairs]
        raw = [c.encode() for c in changed]
        out = []
        for (i, t, d, _, e), r, c in zip(pairs, raw, digests(raw, ranks), strict=True):
            out.append((i, len(t), hashlib.sha256(r).hexdigest(), written(d), written(c), likeness(d, c), likeness(d, e)))
        return rows_of(out)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, guest, open_row = None, None, None
        for batch in batches:
            blocks, guests, ids = (batch.column(c).to_pylist() for c in (0, 1, 2))
            raw = _bytes(batch.column(3))
            for group in _groups(raw):
                pairs = []
                for k, d in zip(group, digests([raw[k] for k in group], ranks), strict=True):
                    row = (ids[k], raw[k].decode(), d)
                    if blocks[k] != block:
                        if open_row:
                            pairs.append((*open_row, *guest[1:]))
                        block, guest, open_row = blocks[k], None, None
                    if guests[k]:
                        guest = guest or row
                    else:
                        if open_row:
                            pairs.append((*open_row, *row[1:]))
                        open_row = row
                if pairs:
                    yield closed(pairs)
        if open_row:
            yield closed([(*open_row, *guest[1:])])
    return pair


def _place(bounds: list[int], i: Column) -> Column:
    """Number of ``bounds`` (descending) above the id, by halving; rows without an id come last."""
    table = F.lit(bounds) if bounds else F.array().cast("array<bigint>")
    halves = F.array(*[F.lit(1 << s) for s in reversed(range(BLOCKS.bit_length()))])
    at = F.aggregate(halves, F.lit(0), lambda at, s: at + F.when(F.get(table, at + s - 1) > i, s).otherwise(0))
    return F.when(i.isNull(), len(bounds)).otherwise(at)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row per row of ``docs`` (doc_id, text)."""
    ranks = rarity(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    keys = stage(rows.select("id", "tie"), "digest-keys")
    n = keys.count()
    if n == 0:
        return docs.sparkSession.createDataFrame([], OUT)
    cuts = min(max(-(-n // BLOCK_ROWS), 1), BLOCKS) - 1
    bounds = keys.agg(F.percentile_approx("id", [(k + 1) / (cuts + 1) for k in range(cuts)], 4 * BLOCKS)).first()[0] if cuts else []
    bounds = sorted(set(bounds or []), reverse=True)
    first = stage(keys.groupBy(_place(bounds, F.col("id")).alias("block")).agg(F.max(F.struct("id", "tie")).alias("first")), "digest-blocks")
    around = W.orderBy("block")
    before = F.coalesce(F.lag("block").over(around), F.max("block").over(W.partitionBy()))
    # a row per block
    first = first.select(F.col("first.id").alias("fi"), F.col("first.tie").alias("ft"), before.alias("before"))
    dealt = rows.join(F.broadcast(first), F.col("id").eqNullSafe(F.col("fi")) & (F.col("tie") == F.col("ft")), "left")
    own = F.struct(_place(bounds, F.col("id")).cast("int").alias("block"), F.lit(False).alias("guest"))
    also = F.struct(F.col("before").cast("int").alias("block"), F.lit(True).alias("guest"))
    dealt = dealt.select("id", "tie", "text", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, also))).alias("at"))
    sorted_rows = (dealt.select("at.*", "id", "text", "tie").repartition("block")
                   .sortWithinPartitions("block", F.desc("guest"), F.desc_nulls_last("id"), F.desc("tie")))
    return sorted_rows.select("block", "guest", "id", "text").mapInArrow(_pairer(ranks), OUT)
