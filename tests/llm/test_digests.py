"""Digests against a plain version window by window; next documents, edits, blocks and likeness."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scintlake.llm import digests as D


def plain_features(text: bytes, w: int, ranks) -> list[int]:
    """Windows with enough votes, one window at a time."""
    n = len(text) - w + 1
    def step(k):
        c = np.array(list(Counter(text[k:k + w]).values())) / w
        return int(D.STEPS * -(c * np.log2(c)).sum() / np.log2(w) + 1e-6)
    steps = [step(k) for k in range(n)]
    votes = Counter()
    for lo in range(1 - D.RUNS[w], n):
        run = [(ranks[steps[k]], k) for k in range(max(lo, 0), min(lo + D.RUNS[w], n)) if steps[k] >= D.LEAST]
        if run:
            votes[min(run)[1]] += 1
    return sorted(k for k, v in votes.items() if v >= D.VOTES[w])


def plain_next(rows):
    """Rows in the order of the operator; the next of the last is the first."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0), reverse=True)


@pytest.mark.parametrize("w", [D.WINDOW, D.SMALL])
def test_features_equal_plain_version(w, monkeypatch):
    monkeypatch.setattr(D, "SLAB", 700)
    rnd = np.random.default_rng(w)
    texts = [bytes(rnd.integers(97, 97 + k, size=n).astype(np.uint8)) for k, n in ((3, 500), (20, 1500), (2, 90), (26, w), (26, w + 1), (1, 400))] + [b"ab" * 300, b"x" * 900 + bytes(range(256))]
    texts.append(texts[1])
    ranks = rnd.permutation(D.STEPS + 1)
    buffer, starts, ends = D._joined(texts)
    got = D._chosen(buffer, starts, ends, w, ranks)
    want = [s + k for t, s in zip(texts, starts) for k in plain_features(t, w, ranks)]
    assert got.tolist() == want


def test_rarity_counts_every_window(spark):
    texts = ["abcabcabd" * 30, None, "", "x", "héllo wörld, " * 9, "q" * 700]
    got = D.rarity(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    for w in (D.WINDOW, D.SMALL):
        total = np.zeros(D.STEPS + 1, dtype=int)
        for t in (t.encode() for t in texts if t):
            if w == D.SMALL and len(t) >= D.SHORT:
                continue
            for k in range(len(t) - w + 1):
                c = np.array(list(Counter(t[k:k + w]).values())) / w
                total[int(D.STEPS * -(c * np.log2(c)).sum() / np.log2(w) + 1e-6)] += 1
        assert got[w][np.argsort(total, kind="stable")].tolist() == list(range(D.STEPS + 1))


@pytest.mark.parametrize("rows_a_block", [4096, 3])
def test_fingerprints(spark, edge, edge_rows, rows_a_block, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ROWS", rows_a_block)
    rows = [(i, t or "") for i, t, _ in edge_rows]
    got = D.fingerprints(edge).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t)) for i, t in rows)
    # ids that repeat may come in either order; each must be followed by a row of its own id or of the next one
    ids = sorted({i for i, _ in rows if i is not None}, reverse=True) + [None]
    follows = {i: {i, ids[(k + 1) % len(ids)]} for k, i in enumerate(ids)}
    texts = {i: [t for j, t in rows if j == i] for i in ids}
    prints = {}
    for r in got:
        assert any(hashlib.sha256(D.edited(t, u).encode()).hexdigest() == r["edited_sha256"] for t in texts[r["doc_id"]] if len(t) == r["n_chars"]
                   for j in follows[r["doc_id"]] for u in texts[j])
        assert r["near_edited"] == pytest.approx(D.likeness(D.read(r["fingerprint"]), D.read(r["edited_fingerprint"])))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if len(texts[r["doc_id"]]) == 1:
            prints[r["doc_id"]] = r["fingerprint"]
    lone = [i for i in ids if len(texts[i]) == 1 and len(texts[ids[(ids.index(i) + 1) % len(ids)]]) == 1]
    near = {r["doc_id"]: r["near_next"] for r in got}
    assert len(lone) > 30
    for i in lone:
        assert near[i] == pytest.approx(D.likeness(D.read(prints[i]), D.read(prints[ids[(ids.index(i) + 1) % len(ids)]])))
    same = {}
    for r in got:
        for t in texts[r["doc_id"]]:
            if len(texts[r["doc_id"]]) == 1:
                same.setdefault(t, set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in same.values())
    assert sum(a["near_edited"] > 0.2 for a in got if a["n_chars"] > 300) > 0.9 * sum(a["n_chars"] > 300 for a in got)


def test_each_next_document_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ROWS", 7)
    rows = [(i * i, f"text {i} " * (i % 17)) for i in range(200)]
    got = {r["doc_id"]: r["edited_sha256"] for r in D.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)).collect()}
    order = rows[::-1]
    assert got == {i: hashlib.sha256(D.edited(t, order[(k + 1) % 200][1]).encode()).hexdigest() for k, (i, t) in enumerate(order)}


def test_likeness_of_long_and_changed_texts():
    rnd = np.random.default_rng(8)
    words = ["".join(chr(c) for c in rnd.integers(97, 123, rnd.integers(2, 9))) for _ in range(3000)]
    say = lambda n: " ".join(words[k] for k in rnd.integers(0, 3000, n))
    ranks = {w: rnd.permutation(D.STEPS + 1) for w in (D.WINDOW, D.SMALL)}
    digest = lambda t: D.digests([t.encode()], ranks)[0]
    long = say(60_000)
    a = digest(long)
    assert len(a[D.WINDOW]) > 20 and D.likeness(a, digest(say(40) + long)) > 0.7 and D.likeness(a, digest(say(60_000))) < 0.05
    assert D.likeness(a, D.read(D.written(a))) == 1.0
    for n in (5, 30, 200, 2000):
        t = say(n)
        d = digest(t)
        assert D.likeness(d, d) == 1.0 and D.read(D.written(d)).keys() == d.keys()
        assert D.likeness(d, digest(say(n))) < 0.1 and D.likeness(d, digest(t[:2 * len(t) // 3] + say(n)[:len(t) // 3])) > 0.2
    assert D.likeness({}, {}) == 1.0 and D.likeness(digest(""), digest("abc")) == 0.0 and D.likeness(digest("abc"), digest("abc")) == 1.0


def test_one_and_no_document(spark, nothing):
    assert D.fingerprints(nothing).count() == 0
    (r,) = D.fingerprints(spark.createDataFrame([(None, "one two three four five six")], "doc_id long, text string").select("*", F.lit(1).alias("tie"))).collect()
    assert r["near_next"] == 1.0 and r["n_chars"] == 27
