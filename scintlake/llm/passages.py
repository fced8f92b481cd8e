"""Exact passage dedup: every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere goes.

Co-location. In each window of ``LENGTH`` bytes the leftmost k-mer of least hash is its anchor; equal windows have equal
anchors at equal offsets. Consecutive windows of one anchor form a range, about one per LENGTH / 2 bytes. Only ranges whose
anchor hash occurs again can repeat; their bytes are dealt by anchor to bins of about ``BIN`` bytes.

Index. A bin joins overlapping ranges of a text to stretches and builds the run-length Burrows-Wheeler transform of all of
them from their suffix array. Longest common prefixes are computed at run heads only; from these samples the matching statistics of
every position are streamed in text order (a position whose suffix isn't a run head matches one byte less than the position before it).
Positions that match ``LENGTH`` bytes, and those they match, are marked. Repetitive bins have few runs.

Equal texts are one class beforehand: all copies of a text of ``LENGTH`` bytes or more lose everything. Equal ranges (by two
64-bit hashes) repeat in all their windows, so one of each goes on. Anchors with more than ``HOT`` unlike ranges would not fit a bin; their windows are hashed in blocks of consecutive ones and counted by
aggregates with map-side combination; only blocks that are neither repeated as a whole nor free of repeats are divided, down to single windows. This is
exact at any multiplicity (hashes of 64 bits within one anchor).

Scale: narrow anchor rows are counted; texts with repeated anchors of unlike ranges are shuffled to meet their ranges, and texts that
lose something to be cut. Nothing is gathered but a text's own ranges and a bin.

Nulls: a null text counts as empty; null ids and rows that repeat an id are fine, as every row is judged by its text, and a row that
repeats a text makes it repeat. Texts under ``LENGTH`` bytes lose nothing. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scintlake.llm.bitmaps import bitmap, held_rows
from scintlake.llm.shingles import mix
from scintlake.session import stage

LENGTH = 400
#: bytes of an anchor
K = 32
#: bytes hashed at a time; positions must fit 20 bits
CHUNK = (1 << 20) - 1024
#: bytes of a bin, about
BIN = 2_000_000
#: unlike ranges of an anchor that still go to a bin
HOT = 2048

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(400))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASE = 0xC2B2AE3D27D4EB4F
_tables: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _tables:
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            x = np.full(1 << 20, b, dtype=U)
            x[0] = 1
            _tables.append(np.multiply.accumulate(x))
    return _tables


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the strings raw[start:end]."""
    p, q = _powers()
    total = np.zeros(len(raw) + 1, dtype=U)
    np.cumsum(_VALUE[raw] * p[:len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts])


def run_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings of ``raw``."""
    if len(raw) < k:
        return np.empty(0, dtype=U)
    p, q = _powers()
    total = np.zeros(len(raw) + 1, dtype=U)
    np.cumsum(_VALUE[raw] * p[:len(raw)], out=total[1:])
    return mix((total[k:] - total[:-k]) * q[:len(raw) - k + 1])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours: a suffix minimum of one block and a prefix minimum of the next."""
    n = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, dtype=U)
    blocks[:len(x)] = x
    blocks = blocks.reshape(-1, w)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(after[:n], upto[w - 1:w - 1 + n])


def ranges(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, first window, number of windows, of anchors, and hash of all bytes of each range in texts that lie on end
    (``ends``) in ``raw``."""
    none = (np.empty(0, dtype=U), *(np.empty(0, dtype=np.int64) for _ in range(3)), np.empty(0, dtype=U))
    h = run_hashes(raw, K)
    w = length - K + 1
    if len(h) < w:
        return none
    low = U((1 << 20) - 1)
    at = (_sliding_min((h & ~low) | np.arange(len(h), dtype=U), w) & low).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(at)), side="right")
    valid = np.arange(len(at)) + length <= ends[text]
    first = valid.copy()
    # a range ends with its anchor's hash, so that periodic text makes one range, or with its text
    first[1:] &= ~valid[:-1] | (h[at[1:]] != h[at[:-1]]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(first)
    if not len(starts):
        return none
    total = np.concatenate(([0], np.cumsum(valid)))
    widths = total[np.append(starts[1:], len(at))] - total[starts]
    moved = valid & np.concatenate(([True], at[1:] != at[:-1]))
    moved[starts] = True
    total = np.concatenate(([0], np.cumsum(moved)))
    return (h[at[starts]], starts, widths, total[np.append(starts[1:], len(at))] - total[starts],
            span_hashes(raw, starts, starts + widths + length - 1))


PROFILE = "doc_id long, n_bytes long, class string, ranges array<struct<h:long,s:long,w:long,m:long,v:long>>"
_RANGE = pa.list_(pa.struct([("h", pa.int64()), ("s", pa.int64()), ("w", pa.int64()), ("m", pa.int64()), ("v", pa.int64())]))


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    text = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1]
    return (np.frombuffer(text.buffers()[2], dtype=np.uint8) if text.buffers()[2] is not None else np.empty(0, dtype=np.uint8)), offsets


def _profiler(length: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _texts(batch.column("text"))
            i, n = 0, batch.num_rows
            while i < n:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
                part, ends = raw[offsets[i]:offsets[j]], offsets[i + 1:j + 1] - offsets[i]
                if len(part) <= CHUNK:
                    h, s, w, m, v = ranges(part, ends, length)
                else:       # one long text, in pieces that share length - 1 bytes
                    pieces = [(a, *ranges(part[a:a + CHUNK], np.array([min(CHUNK, len(part) - a)]), length))
                              for a in range(0, len(part), CHUNK - length + 1)]
                    h, s, w, m, v = (np.concatenate(x) for x in ([p[1] for p in pieces], [p[2] + p[0] for p in pieces],
                                                                 *([p[k] for p in pieces] for k in (3, 4, 5))))
                text = np.searchsorted(ends, s, side="right")
                counts = np.bincount(text, minlength=j - i)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.StructArray.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(s - (ends - np.diff(offsets[i:j + 1]))[text]), pa.array(w), pa.array(m),
                     pa.array(v.view(np.int64))], ["h", "s", "w", "m", "v"]))
                names = [hashlib.sha256(raw[offsets[r]:offsets[r + 1]]).hexdigest() for r in range(i, j)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(offsets[i:j + 1])), pa.array(names), lists.cast(_RANGE)],
                                                 ["doc_id", "n_bytes", "class", "ranges"])
                i = j
    return profile


SEGMENT = "bin long, class string, s long, bytes binary"


def _segmenter(length: int, bins: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            size = 0
            for name, text, wanted in zip(batch.column("class").to_pylist(), batch.column("text"), batch.column("ranges"), strict=True):
                raw = text.as_py().encode()
                for r in wanted.as_py():
                    if not r["hot"]:
                        for column, value in zip(out, (r["h"] % bins, name, r["s"], raw[r["s"]:r["s"] + r["w"] + length - 1]), strict=True):
                            column.append(value)
                        size += r["w"] + length
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())],
                                                     ["bin", "class", "s", "bytes"])
                    out, size = [[], [], [], []], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())],
                                                 ["bin", "class", "s", "bytes"])
    return cut


HOT_RANGE = "class string, h long, r long, bytes binary"


def _hot_ranger(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text, wanted in zip(batch.column("class").to_pylist(), batch.column("text"), batch.column("ranges"), strict=True):
                hot = [r for r in wanted.as_py() if r["hot"]]
                raw = text.as_py().encode() if hot else b""
                at = [(r["h"], a, raw[a:min(a + (1 << 17), r["s"] + r["w"]) + length - 1]) for r in hot for a in range(r["s"], r["s"] + r["w"], 1 << 17)]
                if at:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array([x[0] for x in at], pa.int64()), pa.array([x[1] for x in at], pa.int64()),
                                                      pa.array([x[2] for x in at], pa.binary())], ["class", "h", "r", "bytes"])
    return cut


#: consecutive windows of an anchor that are compared at once, from the first to the last pass
WIDTHS = (64, 8, 1)
BLOCK = "class string, r long, h long, s long, n long, c long, v long"


def blocks(raw: np.ndarray, wanted: np.ndarray, length: int, width: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows, and hashes of what all windows have in common and of all bytes, of the blocks of the ``wanted`` windows of ``raw``.

    A block has the windows whose offset from their anchor, divided by ``width``, is the same, so that equal windows lie in blocks that compare. What they
    have in common is counted from the anchor, and so is the same for a block that the text or another anchor cuts short.
    """
    h, low = run_hashes(raw, K), U((1 << 20) - 1)
    at = (_sliding_min((h & ~low) | np.arange(len(h), dtype=U), length - K + 1) & low).astype(np.int64)
    offset = at - np.arange(len(at))
    first = wanted.copy()
    first[1:] &= ~wanted[:-1] | (at[1:] != at[:-1]) | (offset[1:] // width != offset[:-1] // width)
    starts = np.flatnonzero(first)
    if not len(starts):
        return (starts,) * 4
    total = np.concatenate(([0], np.cumsum(wanted)))
    n = total[np.append(starts[1:], len(at))] - total[starts]
    k = offset[starts] // width
    inner = at[starts] - k * width
    common = mix(span_hashes(raw, inner, inner + length - width + 1) + k.astype(U))
    every = mix(span_hashes(raw, starts, starts + n + length - 1) + (offset[starts] << 20 | n).astype(U))
    return starts, n, common, every


def _blocker(length: int, width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, h, r, data, given in zip(*(batch.column(c).to_pylist() for c in ("class", "h", "r", "bytes", "wanted")), strict=True):
                raw = np.frombuffer(data, dtype=np.uint8)
                wanted = np.full(len(raw) - length + 1, given is None)
                for x in given or ():
                    wanted[x["s"] - r:x["s"] - r + x["n"]] = True
                s, n, c, v = blocks(raw, wanted, length, width)
                out.append(pa.RecordBatch.from_arrays([pa.array([name] * len(s), pa.string()), pa.array(np.full(len(s), r)), pa.array(np.full(len(s), h)), pa.array(s + r), pa.array(n),
                                                       pa.array(c.view(np.int64)), pa.array(v.view(np.int64))], ["class", "r", "h", "s", "n", "c", "v"]))
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches(max_chunksize=1 << 30)[0] if sum(x.num_rows for x in out) else out[0]
    return cut


def _hot_spans(held: DataFrame, length: int) -> list[DataFrame]:
    """Tables (class, lo, hi) of the repeated windows of hot anchors' ranges ``held`` (class, h, r, bytes).

    Windows are compared in blocks. A block all of whose bytes occur twice is repeated as a whole; one whose common bytes occur
    once has no repeated window; the rest is compared in narrower blocks, down to single windows.
    """
    todo, out = held.withColumn("wanted", F.lit(None).cast("array<struct<s:long,n:long>>")), []
    for width in WIDTHS:
        rows = stage(todo.mapInArrow(_blocker(length, width), BLOCK).distinct(), "passage-blocks")
        shared = rows.groupBy(F.col("h").alias("wh"), F.col("c").alias("wc")).agg(F.count("*").alias("times")).filter("times > 1")
        alive = rows.join(shared, (F.col("h") == F.col("wh")) & (F.col("c") == F.col("wc")), "left_semi")
        if width > 1:
            alive = stage(alive, "passage-blocks")
            equal = (alive.groupBy(F.col("h").alias("wh"), F.col("v").alias("wv")).agg(F.count("*").alias("times"), F.min(F.struct("class", "s")).alias("one"))
                     .filter("times > 1").drop("times"))
            alive = stage(alive.join(equal, (F.col("h") == F.col("wh")) & (F.col("v") == F.col("wv")), "left"), "passage-blocks")
            # one of each set of equal blocks stays for those that share only some of its windows
            parts = alive.filter("wh is null").select(F.col("h").alias("ph"), F.col("c").alias("pc")).distinct()
            rest = (alive.filter("wh is null or (class = one.class and s = one.s)").join(parts, (F.col("h") == F.col("ph")) & (F.col("c") == F.col("pc")), "left_semi")
                    .groupBy(F.col("class").alias("t"), F.col("r").alias("tr")).agg(F.collect_list(F.struct("s", "n")).alias("wanted")))
            todo = held.join(rest, (F.col("class") == F.col("t")) & (F.col("r") == F.col("tr"))).select(*held.columns, "wanted")
            alive = alive.filter("wh is not null")
        out.append(alive.select("class", F.col("s").alias("lo"), (F.col("s") + F.col("n") + length - 1).alias("hi")))
    return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of bytes by doubling from eight-byte prefixes; only suffixes that still tie are sorted again."""
    n = len(t)
    padded = np.zeros(n + 8, dtype=np.uint64)
    padded[:n] = t
    key = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        key = (key << U(8)) | padded[i:i + n]
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    head = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    # a rank is the place of the first suffix of its group
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 8
    alone = head & np.append(head[1:], True)
    tied = np.flatnonzero(~alone)
    while len(tied):
        at = sa[tied]
        second = rank[np.minimum(at + h, n)] + 1
        code = rank[at] * (n + 1) + second
        order = np.argsort(code, kind="stable")
        at, code = at[order], code[order]
        sa[tied] = at
        new = np.concatenate(([True], code[1:] != code[:-1]))
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        tied = tied[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


def _common(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and b."""
    n = len(t)
    padded = np.concatenate((t, np.zeros(64, dtype=np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 32)
    out = np.zeros(len(a), dtype=np.int64)
    going = np.arange(len(a))
    while len(going):
        x, y = a[going] + out[going], b[going] + out[going]
        inside = np.maximum(x, y) < n
        going, x, y = going[inside], x[inside], y[inside]
        differ = words[x] != words[y]
        some = differ.any(axis=1)
        out[going] += np.where(some, differ.argmax(axis=1), 32)
        going = going[~some]
    return np.minimum(out, n - np.maximum(a, b))


def repeated(stretches: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Per stretch, the positions at which a string of ``length`` bytes starts that also starts elsewhere in them."""
    # UTF-8 has no 0xFF, so bytes can be raised by one to leave 0 as a separator
    t = np.concatenate([np.append(s + np.uint8(1), np.uint8(0)) for s in stretches])
    sizes = np.array([len(s) + 1 for s in stretches])
    ends = np.cumsum(sizes) - 1
    sa = suffix_array(t)
    n = len(t)
    bwt = t[sa - 1]
    heads = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])) | (sa == 0) | (np.concatenate(([-1], sa[:-1])) == 0))
    sampled = np.zeros(len(heads), dtype=np.int64)
    sampled[1:] = _common(t, sa[heads[1:]], sa[heads[1:] - 1])
    # stream the samples in text order
    order = np.argsort(sa[heads])
    at, value = sa[heads][order], sampled[order]
    last = np.searchsorted(at, np.arange(n), side="right") - 1
    match = value[last] - (np.arange(n) - at[last])
    left = np.repeat(ends, sizes) - np.arange(n)
    hits = np.flatnonzero((match >= length) & (left >= length))
    inverse = np.empty(n, dtype=np.int64)
    inverse[sa] = np.arange(n)
    mark = np.zeros(n, dtype=bool)
    mark[hits] = True
    mark[sa[inverse[hits] - 1]] = True
    starts = ends - sizes + 1
    return [np.flatnonzero(mark[a:b]) for a, b in zip(starts, ends, strict=True)]


SPAN = "class string, lo long, hi long"


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of the bytes covered by strings that start at sorted ``starts``."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist(), strict=True))


def _indexer(length: int):
    def index(table: pa.Table) -> pa.Table:
        table = table.sort_by([("class", "ascending"), ("s", "ascending")])
        names, at, data = table.column("class").to_pylist(), table.column("s").to_pylist(), table.column("bytes").to_pylist()
        joined: list[list] = []
        for name, s, b in zip(names, at, data, strict=True):
            if joined and joined[-1][0] == name and s <= joined[-1][1] + len(joined[-1][2]):
                joined[-1][2] += b[max(joined[-1][1] + len(joined[-1][2]) - s, 0):]
            else:
                joined.append([name, s, bytearray(b)])
        spans = []
        found = repeated([np.frombuffer(bytes(x[2]), dtype=np.uint8) for x in joined], length)
        for (name, s, _), starts in zip(joined, found, strict=True):
            spans += [(name, lo + s, hi + s) for lo, hi in covered(starts, length)]
        return pa.table({"class": pa.array([x[0] for x in spans], pa.string()), "lo": pa.array([x[1] for x in spans], pa.int64()),
                         "hi": pa.array([x[2] for x in spans], pa.int64())})
    return index


RESULT = "class string, n_removed long, n_spans long, kept_sha256 string"


def _union(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, text, given in zip(batch.column("class").to_pylist(), batch.column("text"), batch.column("spans"), strict=True):
            raw, spans, kept, at = text.as_py().encode(), _union([(x["lo"], x["hi"]) for x in given.as_py()]), hashlib.sha256(), 0
            for lo, hi in spans:
                kept.update(raw[at:lo])
                at = hi
            kept.update(raw[at:])
            rows.append((name, sum(hi - lo for lo, hi in spans), len(spans), kept.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2)),
                                          pa.array([r[3] for r in rows], pa.string())], ["class", "n_removed", "n_spans", "kept_sha256"])


def _fetched(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(class, text) of the classes ``names`` (c, rep), rep being the least id with that text. Rows that repeat an id come more than once."""
    given = docs.filter(F.octet_length("text") >= K).select(F.sha2("text", 256).alias("name"), "doc_id", "text")
    return (held_rows(given, bitmap(names, F.col("c"), F.col("rep")), F.col("name"), F.col("doc_id"))
            .join(names, (F.col("name") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select(F.col("c").alias("class"), "text"))


def spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, classes, spans): a row per row of ``docs`` with its class; (class, copies, rep) of texts of ``length`` bytes or more;
    (class, lo, hi) of repeated bytes, possibly overlapping. Of texts with copies all bytes are repeated, whatever their spans.

    Ranges that are equal as a whole repeat in every window; one of each stays to be compared with the others of its anchor.
    """
    prof = stage(docs.mapInArrow(_profiler(length), PROFILE), "passages")
    classes = stage(prof.filter(F.col("n_bytes") >= length).groupBy("class").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep")), "passage-classes")
    once = prof.join(classes.select(F.col("class").alias("c"), F.col("rep").alias("r")), (F.col("class") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("r")), "left_semi")
    at = once.dropDuplicates(["class"]).select("class", F.explode("ranges").alias("x")).select("class", "x.*")
    again = stage(at.groupBy(F.col("h").alias("ch")).agg(F.sum("m").alias("n")).filter("n > 1").select("ch"), "anchors")
    held = stage(held_rows(at, bitmap(again, F.col("ch")), F.col("h")).join(again, F.col("h") == F.col("ch"), "left_semi"), "ranges")
    equal = stage(held.groupBy("h", "w", "v").agg(F.count("*").alias("n"), F.min(F.struct("class", "s")).alias("one"), F.first("m").alias("m")), "equal-ranges")
    e = equal.filter("n > 1").select(F.col("h").alias("eh"), F.col("w").alias("ew"), F.col("v").alias("ev"))
    whole = (held.join(e, (F.col("h") == F.col("eh")) & (F.col("w") == F.col("ew")) & (F.col("v") == F.col("ev")))
             .select("class", F.col("s").alias("lo"), (F.col("s") + F.col("w") + length - 1).alias("hi")))
    kinds = equal.groupBy(F.col("h").alias("kh")).agg(F.sum("m").alias("kinds")).filter("kinds > 1")
    wanted = stage(equal.join(kinds, F.col("h") == F.col("kh"))
                   .select("one.class", F.struct("h", "one.s", "w", (F.col("kinds") > HOT).alias("hot")).alias("x"))
                   .groupBy("class").agg(F.collect_list("x").alias("ranges")), "passage-ranges")
    size = wanted.select(F.sum(F.aggregate("ranges", F.lit(0).cast("long"), lambda a, x: a + F.when(x["hot"], 0).otherwise(x["w"] + length))).alias("size"),
                         F.sum(F.exists("ranges", lambda x: x["hot"]).cast("int")).alias("hot")).first()
    names = stage(wanted.select(F.col("class").alias("c")).join(classes, F.col("c") == F.col("class")).select("c", "rep"), "passage-names")
    both = _fetched(docs, names).join(wanted.withColumnRenamed("class", "c"), F.col("class") == F.col("c")).select("class", "text", "ranges")
    bins = int((size["size"] or 0) // BIN + 1)
    if size["hot"]:
        both = stage(both, "passage-texts")
    found = both.mapInArrow(_segmenter(length, bins), SEGMENT).groupBy("bin").applyInArrow(_indexer(length), SPAN).unionAll(whole)
    if size["hot"]:
        held = stage(both.mapInArrow(_hot_ranger(length), HOT_RANGE).dropDuplicates(["class", "r"]), "hot-ranges")
        for part in _hot_spans(held, length):
            found = found.unionAll(part)
    return prof.drop("ranges"), classes, stage(found, "passage-spans")


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, a row per row of ``docs``."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    prof, classes, found = spans(given, length)
    alone = classes.filter("copies = 1").select(F.col("class").alias("k"), "rep")
    partly = stage(found.groupBy("class").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")).join(alone, F.col("class") == F.col("k"))
                   .select(F.col("k").alias("c"), "rep", "spans"), "passage-cuts")
    cut = (_fetched(given, partly.select("c", "rep")).join(partly.drop("rep"), F.col("class") == F.col("c")).select("class", "text", "spans")
           .mapInArrow(_cutter, RESULT).dropDuplicates(["class"]))
    whole = classes.filter("copies > 1").select("class", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
                                                F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
    result = cut.unionAll(whole).withColumnRenamed("class", "c")
    return (prof.join(result, F.col("class") == F.col("c"), "left")
            .select("doc_id", "n_bytes", F.when(F.col("c").isNull(), 0).otherwise(F.coalesce("n_removed", "n_bytes")).cast("long").alias("n_removed"),
                    F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "class").alias("kept_sha256")))
