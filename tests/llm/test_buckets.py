"""Components from buckets: against all pairs of a bucket, and a hot bucket of unlike nodes in two comparisons."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scintlake.llm import graph, minhash


def _run(spark, buckets: dict[int, list[int]], linked):
    members = spark.createDataFrame(pd.DataFrame([(k, 0, n) for k, ns in buckets.items() for n in ns], columns=["key", "slot", "node"]))
    nodes = sorted({n for ns in buckets.values() for n in ns})
    marks = spark.createDataFrame(pd.DataFrame({"node": nodes, "mark": nodes}))
    calls = []

    def verify(pairs):
        rows = [(r["a"], r["b"]) for r in pairs.collect()]
        calls.append(rows)
        return spark.createDataFrame([p for p in rows if p in linked], "a long, b long")

    comp, _ = graph.bucket_components(members, marks, verify, lambda a, b, slot: F.lit(True))
    return {r["node"]: r["component"] for r in comp.collect()}, calls


def _want(buckets, linked):
    root = {n: n for ns in buckets.values() for n in ns}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for ns in buckets.values():
        for a, b in itertools.combinations(sorted(ns), 2):
            if (a, b) in linked and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in root}


def test_components_equal_all_pairs_of_buckets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    buckets = {k: sorted(rng.choice(60, size=s, replace=False).tolist()) for k, s in enumerate((40, 25, 10, 5, 3, 2, 2, 1))}
    linked = {(a, b) for a, b in itertools.combinations(range(60), 2) if rng.random() < 0.03}
    want = _want(buckets, linked)
    for worth, cell in ((256, 1024), (256, 7), (0, 1024)):       # at once, in several cells, after rounds of pivots
        monkeypatch.setattr(graph, "WORTH", worth, raising=False)
        monkeypatch.setattr(graph, "CELL", cell, raising=False)
        got, calls = _run(spark, buckets, linked)
        assert {n: got.get(n, n) for n in want} == want
        assert all(a < b for rows in calls for a, b in rows)


def test_hot_bucket_of_unlike_nodes_needs_two_comparisons(spark):
    """Its members were written and compared with one pivot after the other for eight rounds."""
    got, calls = _run(spark, {1: list(range(100)), 2: [1, 2, 3]}, {(7, 50), (50, 99)})
    assert len(calls) == 2 and got == {7: 7, 50: 7, 99: 7}


def test_near_copies_too_unlike_to_link_are_not_paired(spark, monkeypatch):
    """40 texts of one core, each with own words: no two reach 85 %, and what each has to itself rules their pairs out."""
    core = " ".join(f"w{i}" for i in range(92))                   # 88 shingles
    texts = [(d, core + "".join(f" d{d}x{i}" for i in range(12))) for d in range(40)]
    seen, confirmed = [], minhash.confirmed

    def counted(pairs, sets, percent):
        seen.append(pairs.count())
        return confirmed(pairs, sets, percent)
    monkeypatch.setattr(minhash, "confirmed", counted)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), percent=85).collect()}
    assert sum(seen) < 2 * len(texts) and got == {d: d for d, _ in texts}
