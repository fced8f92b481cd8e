"""Byte-level BPE: DuckDB recursive queries per partition contract token pairs; ordered aggregation decodes.

Encoding: numpy cuts the texts of a partition, a few megabytes at a time, into the pieces of the tokenizer's pattern.
Every piece that the worker has not met is encoded once: pieces that are tokens get their rank, and for the others
token-position rows join the merge table in a recursive query of an in-process DuckDB (no server, nothing on disk) that
contracts each piece's leftmost pair of least rank until none is left. Pieces of over ``LONG`` bytes are contracted
statement by statement instead, all occurrences of the least pair at once, so that neither their square nor all their
steps stand in memory; as merges rise in rank, both orders give the same tokens. Each document's ids are its pieces' ids in turn.

Decoding: a document's ids are cut before tokens that begin with a space (and after ``SEGMENT`` ids); each new segment's
rows join the vocabulary and an ordered aggregation joins their bytes.

What a worker has met stays in a bounded memory and is only a short cut: dropping it changes no result. The work is one
map over partitions without a shuffle, so it scales with the number of files and is simply run again when an executor
is lost. A text of many megabytes is handled whole by one task.

Nulls: a null text or list counts as empty. Other columns, names and repeated rows do not matter; tables may be empty.
The vocabulary file must be readable at the same path on every executor.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

U = np.uint64

#: bytes of text, or ids, handled at a time
CHUNK = 1_000_000
#: longer pieces (bytes) leave the recursive query
LONG = 96
#: pieces contracted by one query
WORDS = 10_000
#: ids of a segment, at most
SEGMENT = 32
#: pieces or segments a worker remembers
REMEMBERED = 1_000_000

NO_RANK = 2_147_483_647

CONTRACT = f"""
WITH RECURSIVE t(wid, pos, tok, rk, step) AS (
  SELECT a.wid, a.pos, a.tok, coalesce(m.rk, {NO_RANK}), 0
  FROM pieces a LEFT JOIN pieces b ON a.wid = b.wid AND b.pos = a.pos + 1 LEFT JOIN merges m ON m.l = a.tok AND m.r = b.tok
  UNION ALL
  (WITH best AS (SELECT wid, min(rk::BIGINT * 1048576 + pos) AS code FROM t GROUP BY wid HAVING min(rk) < {NO_RANK}),
   cur AS (SELECT t.*, (code & 1048575)::INT AS hit, (code >> 20)::INT AS made FROM t JOIN best USING (wid)),
   beside AS (SELECT wid, any_value(made) AS made, max(CASE WHEN pos = hit - 1 THEN tok END) AS p,
                     max(CASE WHEN pos = hit + 2 THEN tok END) AS n FROM cur WHERE pos BETWEEN hit - 1 AND hit + 2 GROUP BY wid),
   looked AS (SELECT wid, coalesce(m1.rk, {NO_RANK}) AS before, coalesce(m2.rk, {NO_RANK}) AS after
              FROM beside LEFT JOIN merges m1 ON m1.l = p AND m1.r = made LEFT JOIN merges m2 ON m2.l = made AND m2.r = n)
   SELECT wid, pos - (pos > hit)::INT, CASE WHEN pos = hit THEN made ELSE tok END,
          CASE WHEN pos = hit THEN after WHEN pos = hit - 1 THEN before ELSE rk END, step + 1
   FROM cur JOIN looked USING (wid) WHERE pos <> hit + 1)),
ended AS (SELECT wid, max(step) AS step FROM t GROUP BY wid)
SELECT wid, list(tok ORDER BY pos) AS ids FROM t JOIN ended USING (wid, step) GROUP BY wid ORDER BY wid
"""

PAIRS = f"""
CREATE OR REPLACE TEMP TABLE paired AS
SELECT wid, pos, tok, coalesce(m.rk, {NO_RANK}) AS rk
FROM (SELECT *, lead(tok) OVER (PARTITION BY wid ORDER BY pos) AS nx FROM long_pieces) x LEFT JOIN merges m ON m.l = x.tok AND m.r = x.nx
"""

#: of pairs that overlap (a run of hits at neighbouring positions) every other one is contracted, from the left
CONTRACT_LONG = f"""
CREATE OR REPLACE TEMP TABLE long_pieces AS
WITH least AS (SELECT wid, min(rk) AS low FROM paired GROUP BY wid),
hits AS (SELECT wid, pos, low, pos - row_number() OVER (PARTITION BY wid ORDER BY pos) AS island FROM paired JOIN least USING (wid)
         WHERE rk = low AND low < {NO_RANK}),
used AS (SELECT wid, pos, low FROM (SELECT *, row_number() OVER (PARTITION BY wid, island ORDER BY pos) AS i FROM hits) z WHERE i % 2 = 1)
SELECT p.wid, (row_number() OVER (PARTITION BY p.wid ORDER BY p.pos) - 1)::INT AS pos, coalesce(u.low, p.tok) AS tok
FROM paired p LEFT JOIN used u ON p.wid = u.wid AND p.pos = u.pos LEFT JOIN used g ON p.wid = g.wid AND p.pos = g.pos + 1
WHERE g.pos IS NULL
"""

DECODE = "SELECT sid, list(bytes ORDER BY pos) AS parts FROM segs JOIN vocab USING (tok) GROUP BY sid ORDER BY sid"


class Memo:
    """Values (runs of numbers) by 64-bit key, in sorted arrays."""

    def __init__(self, dtype) -> None:
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.empty(0, dtype=U), np.empty(0, dtype=np.int64)
        self.flat, self.starts = np.empty(0, dtype=self.dtype), np.zeros(1, dtype=np.int64)

    def missing(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return self.keys[at] != keys if len(self.keys) else np.ones(len(keys), dtype=bool)

    def add(self, keys: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> None:
        slots = np.arange(len(self.starts) - 1, len(self.starts) - 1 + len(keys))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(lengths)))
        self.flat = np.concatenate((self.flat, flat.astype(self.dtype)))
        both = np.concatenate((self.keys, keys))
        order = np.argsort(both, kind="stable")
        self.keys, self.slots = both[order], np.concatenate((self.slots, slots))[order]

    def values(self, keys: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of keys[inverse] on end, and their lengths."""
        slot = self.slots[np.searchsorted(self.keys, keys)]
        lengths = np.diff(self.starts)[slot][inverse]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[:-1][slot][inverse] - (ends - lengths), lengths) + np.arange(total)
        return self.flat[at], lengths


class Codec:
    """Vocabulary, merge table and memory of one worker."""

    def __init__(self, path: str) -> None:
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        rows = [(self.ranks[t[:i]], self.ranks[t[i:]], rk) for t, rk in self.ranks.items() for i in range(1, len(t))
                if t[:i] in self.ranks and t[i:] in self.ranks]
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "160MB"})
        l, r, rk = (pa.array(x, pa.int32()) for x in zip(*rows, strict=True))
        self._table("merges", pa.table({"l": l, "r": r, "rk": rk}))
        self._table("vocab", pa.table({"tok": pa.array(list(self.ranks.values()), pa.int32()), "bytes": pa.array(list(self.ranks), pa.binary())}))
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.spaced = np.zeros(max(self.ranks.values()) + 1, dtype=bool)
        self.spaced[[rk for t, rk in self.ranks.items() if t[:1] == b" "]] = True
        self.pieces, self.segments = Memo(np.int32), Memo(np.uint8)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.con.register("given", rows)
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _rows(self, words: list[bytes]) -> pa.Table:
        raw, n = np.frombuffer(b"".join(words), dtype=np.uint8), np.array([len(w) for w in words])
        start = np.cumsum(n) - n
        return pa.table({"wid": np.repeat(np.arange(len(words), dtype=np.int32), n),
                         "pos": (np.arange(len(raw)) - np.repeat(start, n)).astype(np.int32), "tok": self.single[raw]})

    def contracted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are no tokens, on end, and their numbers."""
        flat, lengths = [], np.zeros(len(words), dtype=np.int64)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        found: dict[int, np.ndarray] = {}
        for k in range(0, len(short), WORDS):
            part = short[k:k + WORDS]
            self._table("pieces", self._rows([words[i] for i in part]))
            ids = self.con.sql(CONTRACT).to_arrow_table().column("ids").combine_chunks()
            at, values = ids.offsets.to_numpy(), ids.values.to_numpy()
            found.update((i, values[at[j]:at[j + 1]]) for j, i in enumerate(part))
        for i in sorted(set(range(len(words))) - set(short)):
            self._table("long_pieces", self._rows([words[i]]))
            while True:
                self.con.execute(PAIRS)
                if self.con.execute("SELECT min(rk) FROM paired").fetchall()[0][0] == NO_RANK:
                    break
                self.con.execute(CONTRACT_LONG)
            found[i] = self.con.sql("SELECT tok FROM long_pieces ORDER BY pos").to_arrow_table().column("tok").to_numpy()
        for i in range(len(words)):
            flat.append(found[i])
            lengths[i] = len(found[i])
        return (np.concatenate(flat) if flat else np.empty(0, dtype=np.int32)), lengths

    def encode(self, raw: np.ndarray, n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts on end, and their numbers."""
        starts, per_text = pieces(raw, n_bytes)
        ends = np.append(starts[1:], len(raw)).astype(np.int64)
        keys, first, inverse = np.unique(_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        if len(self.pieces.keys) > REMEMBERED:
            self.pieces.clear()
        new = np.flatnonzero(self.pieces.missing(keys))
        words = [raw[starts[i]:ends[i]].tobytes() for i in first[new]]
        whole = np.array([self.ranks.get(w, -1) for w in words], dtype=np.int32)
        if len(words):
            self.pieces.add(keys[new[whole >= 0]], whole[whole >= 0], np.ones(int((whole >= 0).sum()), dtype=np.int64))
            rest = np.flatnonzero(whole < 0)
            self.pieces.add(keys[new[rest]], *self.contracted([words[i] for i in rest]))
        flat, lengths = self.pieces.values(keys, inverse)
        return flat, _per_group(lengths, per_text)

    def decode(self, ids: np.ndarray, n_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of consecutive id lists on end, and their numbers."""
        cut = self.spaced[ids]
        begins = (np.cumsum(n_ids) - n_ids)[n_ids > 0]
        cut[begins] = True
        run = np.flatnonzero(cut)
        since = np.arange(len(ids)) - np.repeat(run, np.diff(np.append(run, len(ids))))
        cut |= since % SEGMENT == 0
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(ids)).astype(np.int64)
        per_list = np.searchsorted(starts, np.cumsum(n_ids)) - np.searchsorted(starts, np.cumsum(n_ids) - n_ids)
        as_bytes = np.ascontiguousarray(ids, dtype="<i4").view(np.uint8)
        keys, first, inverse = np.unique(_hashes(as_bytes, starts * 4, ends * 4), return_index=True, return_inverse=True)
        if len(self.segments.keys) > REMEMBERED:
            self.segments.clear()
        new = np.flatnonzero(self.segments.missing(keys))
        for k in range(0, len(new), WORDS):
            part = new[k:k + WORDS]
            a, n = starts[first[part]], (ends - starts)[first[part]]
            pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            self._table("segs", pa.table({"sid": np.repeat(np.arange(len(part), dtype=np.int32), n), "pos": pos.astype(np.int32),
                                          "tok": ids[np.repeat(a, n) + pos].astype(np.int32)}))
            parts = self.con.sql(DECODE).to_arrow_table().column("parts").combine_chunks()
            tok = parts.values.cast(pa.large_binary())
            bounds = np.frombuffer(tok.buffers()[1], dtype=np.int64)[tok.offset:tok.offset + len(tok) + 1][parts.offsets.to_numpy()]
            flat = np.frombuffer(tok.buffers()[2], dtype=np.uint8)[bounds[0]:bounds[-1]]
            self.segments.add(keys[part], flat, np.diff(bounds))
        flat, lengths = self.segments.values(keys, inverse)
        return flat, _per_group(lengths, per_list)


def _per_group(lengths: np.ndarray, members: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(lengths)))
    ends = np.cumsum(members)
    return total[ends] - total[ends - members]


_codecs: dict[str, Codec] = {}
_classes: list[np.ndarray] = []


def codec(path: str) -> Codec:
    """The codec of this process."""
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = Codec(path)
    return _codecs[path]


OTHER, LETTER, NUMBER, SPACE = range(4)


def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    if not _classes:
        import regex

        table = np.zeros(0x110000, dtype=np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        at = lambda i: i if i < 0xD800 else i + 0x800
        for kind, name in ((LETTER, "L"), (NUMBER, "N")):
            for m in regex.finditer(rf"\p{{{name}}}+", every):
                for a, b in ((m.start(), min(m.end(), 0xD800)), (max(m.start(), 0xD800), m.end())):
                    if a < b:
                        table[at(a):at(b - 1) + 1] = kind
        table[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
        _classes.append(table)
    return _classes[0]


def pieces(raw: np.ndarray, n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the pattern's matches in consecutive UTF-8 texts, and the number of matches per text.

    The pattern takes contractions, then runs of letters, numbers or other signs with the space before them, then white
    space up to the one before a word. Its matches cover a text, so their starts say all.
    """
    if not len(raw):
        return np.empty(0, dtype=np.int64), np.zeros(len(n_bytes), dtype=np.int64)
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    byte_at = np.flatnonzero((raw & 0xC0) != 0x80)
    c = classes()[cp]
    n = len(cp)
    to_byte = np.cumsum(n_bytes)
    text_at = np.searchsorted(byte_at, (to_byte - n_bytes)[n_bytes > 0])
    opens, closes = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)      # first and last character of a text
    opens[text_at] = True
    closes[np.append(text_at[1:], n) - 1] = True
    before = np.empty(n, dtype=np.uint8)
    before[0], before[1:] = 255, c[:-1]
    before[opens] = 255
    space, blank = c == SPACE, cp == 32
    before_blank = np.zeros(n, dtype=bool)
    before_blank[1:] = blank[:-1]
    before_blank[opens] = False
    last_space = np.zeros(n, dtype=bool)        # white space just before a sign that isn't
    last_space[:-1] = space[:-1] & ~space[1:]
    last_space[closes] = False
    start = np.where(space, (before != SPACE) | last_space, (before != c) & ~before_blank)
    quote = np.flatnonzero(start & (cp == 39) & ~closes)
    if len(quote):
        one = cp[quote + 1]
        two = np.where(closes[quote + 1], 0, cp[np.minimum(quote + 2, n - 1)])
        single = np.isin(one, [ord(x) for x in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where(single, 2, np.where(double, 3, 0))
        at, size = quote[size > 0], size[size > 0]
        start[at + 1] = False
        after = at + size
        inside = (after < n)
        after = after[inside]
        start[after[~opens[after]]] |= ~space[after[~opens[after]]]
        start[after[opens[after]]] = True
    where = np.flatnonzero(start)
    starts = byte_at[where]
    return starts, np.searchsorted(starts, to_byte) - np.searchsorted(starts, to_byte - n_bytes)


_rng = np.random.Generator(np.random.PCG64(50257))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs: a polynomial over random byte values, and the length, mixed."""
    from scintlake.llm.shingles import mix

    if not _powers or len(_powers[0]) <= len(raw):
        _powers.clear()
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            x = np.full(max(len(raw) + 1, 3 * CHUNK), b, dtype=U)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    total = np.zeros(len(raw) + 1, dtype=U)
    np.cumsum(_VALUE[raw] * _powers[0][:len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * _powers[1][starts] + mix((ends - starts).astype(U)))


def _cuts(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``CHUNK`` values each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        yield i, j
        i = j


def _id_lists(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(ids.astype(np.int32)))


def _byte_strings(flat: np.ndarray, n: np.ndarray) -> pa.Array:
    bounds = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
    given = [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(flat))]
    return pa.Array.from_buffers(pa.large_binary(), len(n), given).cast(pa.binary())


def _encoder(path: str, back: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.num_columns - 1).cast(pa.large_string()).fill_null("")
            offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1]
            raw = np.frombuffer(text.buffers()[2], dtype=np.uint8) if text.buffers()[2] is not None else np.empty(0, dtype=np.uint8)
            for i, j in _cuts(offsets) if len(text) else ():
                ids, n = codec(path).encode(raw[offsets[i]:offsets[j]], np.diff(offsets[i:j + 1]))
                part = batch.slice(i, j - i)
                more = [_id_lists(ids, n), *([_byte_strings(*codec(path).decode(ids, n))] if back else [])]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *more], [*part.schema.names[:-1], "ids", "decoded"][:part.num_columns + back])
    return encode


def _decoder(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1).cast(pa.large_list(pa.int32()))
            lists = lists.fill_null([]) if lists.null_count else lists
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for i, j in _cuts(offsets) if len(lists) else ():
                flat, n = codec(path).decode(values[offsets[i]:offsets[j]], np.diff(offsets[i:j + 1]))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _byte_strings(flat, n)], [*part.schema.names[:-1], "decoded"])
    return decode


def _plus(df: DataFrame, keep: list[str], name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*[df.schema[c] for c in keep], T.StructField(name, kind)])


def encoded(docs: DataFrame, path: str, keep: list[str] | None = None, text: str = "text", back: bool = False) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all but the text and those added, by default) and ``ids``, the ids of the whole text.

    With ``back`` the ids are decoded in the same pass, into ``decoded``.
    """
    keep = [c for c in docs.columns if c not in (text, "ids", "decoded")] if keep is None else keep
    given = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = _plus(given, keep, "ids", T.ArrayType(T.IntegerType()))
    return given.mapInArrow(_encoder(path, back), schema.add("decoded", T.BinaryType()) if back else schema)


def decoded(df: DataFrame, path: str, keep: list[str] | None = None, ids: str = "ids") -> DataFrame:
    """Columns ``keep`` of ``df`` (all but ``decoded`` by default) and ``decoded``, the bytes that ``ids`` stand for.

    An id that is not in the vocabulary ends the job with an error.
    """
    keep = [c for c in df.columns if c != "decoded"] if keep is None else keep
    given = df.select(*keep, F.col(ids).alias("__ids"))
    return given.mapInArrow(_decoder(path), _plus(given, keep, "decoded", T.BinaryType()))
