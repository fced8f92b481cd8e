"""Hashes of words and word shingles, a batch of texts at a time in numpy.

Words are runs of bytes outside 0x20 and 0x09-0x0D, A-Z lower-cased, so everything works on UTF-8 bytes. A word's hash
is a polynomial over random byte values modulo 2**64, mixed; a shingle's is a linear form of its words' hashes, mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes hashed at a time; a longer text is cut between words
CHUNK = 1 << 20

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) | U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if "p" not in _pow or len(_pow["p"]) < n:
        inverse = pow(_BASE, -1, 2**64)
        for name, b in (("p", _BASE), ("q", inverse)):
            x = np.full(max(n, CHUNK + 4096), b, dtype=np.uint64)
            x[0] = 1
            _pow[name] = np.multiply.accumulate(x)
    return _pow["p"], _pow["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive texts data[starts[i]:ends[i]], and how many words each text has."""
    b = _FOLD[data]
    word = ~_SPACE[b]
    first, last = np.empty_like(word), np.empty_like(word)
    first[1:], last[:-1] = ~word[:-1], ~word[1:]
    if len(b):
        first[0] = last[-1] = True
    filled = starts < ends
    first[starts[filled]] = True
    last[ends[filled] - 1] = True
    at, to = np.flatnonzero(word & first), np.flatnonzero(word & last) + 1
    p, q = _powers(len(b) + 1)
    total = np.empty(len(b) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_VALUE[b] * p[:len(b)], out=total[1:])
    counts = np.searchsorted(at, ends) - np.searchsorted(at, starts)
    return mix((total[to] - total[at]) * q[at]), counts


def _long(text: np.ndarray) -> np.ndarray:
    """Word hashes of one text of any length, in pieces cut at white space."""
    out, at = [], 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        if end < len(text):
            gap = np.flatnonzero(_SPACE[text[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
            else:           # a word longer than a chunk stays whole
                more = np.flatnonzero(_SPACE[text[end:]])
                end = end + int(more[0]) + 1 if len(more) else len(text)
        piece = text[at:end]
        out.append(word_hashes(piece, np.array([0]), np.array([len(piece)]))[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, word hashes of some texts, words of each text); a null text has none."""
    for arr in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        arr = arr.cast(pa.large_string())
        if arr.null_count:
            arr = arr.fill_null("")
        offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
        raw = np.frombuffer(arr.buffers()[2], dtype=np.uint8) if arr.buffers()[2] is not None else np.empty(0, dtype=np.uint8)
        i = 0
        while i < len(arr):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
            lo, hi = offsets[i], offsets[j]
            if hi - lo > CHUNK:
                h = _long(raw[lo:hi])
                yield i, h, np.array([len(h)])
            else:
                yield i, *word_hashes(raw[lo:hi], offsets[i:j] - lo, offsets[i + 1:j + 1] - lo)
            i = j


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of texts in turn, and how many each has; under k words the whole sequence is one."""
    ends = np.cumsum(counts)
    starts = ends - counts
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    if len(words) >= k:
        full = np.zeros(len(words) - k + 1, dtype=np.uint64)
        for j in range(k):
            full += words[j:len(words) - k + 1 + j] * _PLACE[j]
        full = mix(full)
    else:
        full = np.empty(0, dtype=np.uint64)
    to = np.cumsum(n)
    at = to - n
    # position of each shingle's first word
    first = np.arange(int(to[-1]) if len(to) else 0) - np.repeat(at - starts, n)
    out = full[np.minimum(first, max(len(full) - 1, 0))] if len(full) else np.zeros(len(first), dtype=np.uint64)
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        w = words[starts[i]:ends[i]]
        out[at[i]] = mix(np.array([(w * _PLACE[:len(w)]).sum() + U(len(w))], dtype=np.uint64))[0]
    return out, n
