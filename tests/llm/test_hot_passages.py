"""Ranges of hot anchors: the repeated windows are those of brute force, from far fewer rows than windows."""

from collections import Counter

import numpy as np

from scintlake.llm import passages


def _ranges(n: int, length: int, seed: int):
    """One passage in ``n`` texts: some hold all of it between unlike bytes, others end or begin in it."""
    rnd = np.random.default_rng(seed)
    common = rnd.integers(97, 123, 2 * length).astype(np.uint8)
    # the rarest hash is the anchor of all windows that hold it
    h = passages.run_hashes(common, passages.K)
    p = int(np.argmin(h[length - 200:length + 150])) + length - 200
    out = []
    for i in range(n):
        left, right = rnd.integers(0, length // 2, 2)
        other = rnd.integers(97, 123, 2 * length).astype(np.uint8)
        text = np.concatenate((other[:left], common[p - length + 60 + left:p + length - 60 - right], other[left:left + right]))
        out.append((f"c{i}", text))
    return out


def _windows(texts, length):
    count = Counter(bytes(t[i:i + length]) for _, t in texts for i in range(len(t) - length + 1))
    return {(name, i) for name, t in texts for i in range(len(t) - length + 1) if count[bytes(t[i:i + length])] > 1}


def test_blocks_find_all_repeated_windows(spark, monkeypatch):
    length, texts = 400, _ranges(60, 400, 3)
    rows, staged = [], passages.stage

    def counted(df, name, *a, **kw):
        out = staged(df, name, *a, **kw)
        rows.append(out.count())
        return out
    monkeypatch.setattr(passages, "stage", counted)
    data = []
    for name, t in texts:       # ranges of one anchor each, as the profile cuts them
        h, s, w, _, _ = passages.ranges(t, np.array([len(t)]), length)
        data += [(name, int(np.int64(a.view(np.int64))), int(b), bytes(t[b:b + c + length - 1])) for a, b, c in zip(h, s, w, strict=True)]
    held = spark.createDataFrame(data, passages.HOT_RANGE)
    got = set()
    for part in passages._hot_spans(held, length):
        got |= {(r["class"], i) for r in part.collect() for i in range(r["lo"], r["hi"] - length + 1)}
    want = _windows(texts, length)
    assert got == want and len(want) > 1000
    assert max(rows) < sum(len(t) - length + 1 for _, t in texts) / 10      # it was one row a window
