"""URL filter, embeddings and the pipeline."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from scintlake.llm import toxicity, url_filter, vectors
from scintlake.llm.queries import RULES, SCHEDULES


def test_rules_hosts_and_paths(spark):
    urls = [None, "", "no scheme", "http://Example.ORG/es/x", "https://a.example.org/en/12?x#y", "ftp://u@x.com/fr/", "http://com/de/1", "http://xcom/de/1",
            "http://a.com", "a://b://c.org/", "http://a.org?/es/", "http://a.example.org/es/\n/z"]
    got = {r["page_id"]: r for r in url_filter.judged(spark.createDataFrame(
        [(i, u, "x", 0) for i, u in enumerate(urls)], "page_id long, url string, host string, n int"), RULES).collect()}
    told = [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(len(urls))]
    assert told == [("", "", None), ("", "", None), ("", "", None), ("example.org", "/es/x", "example.org/es/"), ("a.example.org", "/en/12", "example.org/en/1"),
                    ("u@x.com", "/fr/", "com/fr/"), ("com", "/de/1", "com/de/"), ("xcom", "/de/1", None), ("a.com", "", None), ("b:", "//c.org/", None),
                    ("a.org", "", None), ("a.example.org", "/es/\n/z", "example.org/es/")]
    assert [got[i]["verdict"] for i in (3, 4, 5, 6)] == ["block", "block", "allow", "block"]


def test_templates_split_and_merge(spark):
    rows = [(i, f"http://h.net/bad/{i}") for i in range(60)] + [(100 + i, f"http://h.net/good/{i}") for i in range(60)]
    rows += [(200 + i, f"http://h.net/fine/{i}") for i in range(60)]
    rules = [("block", f"h.net/bad/{d}") for d in "12345"] + [("allow", f"h.net/good/{d}") for d in "1234"] + [("allow", f"h.net/fine/{d}") for d in "1234"]
    got = {r["page_id"]: r for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got[0]["template"] == "/bad/*" and got[0]["verdict"] == "block" and got[0]["rule"] is None
    # every branch differs from its siblings together, and none with clean labels is rejected
    assert got[100]["verdict"] == got[200]["verdict"] == "allow"
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def awkward_vectors():
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(150, 16))
    near = [base[i % 5] + rnd.normal(size=16) * 0.08 for i in range(60)]
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *near])]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, [2.5 * x for x in rows[0][1]]), (303, [0.0] * 16), (304, None), (305, []), (306, [float("nan")] * 16),
             (307, [None] + [1.0] * 15), (308, [float("inf")] + [1.0] * 15), (309, [1.0, 2.0]), (310, [2.0, 4.0]), (311, [3.0]), (None, rows[1][1]), (350, rows[7][1])]
    # unlike rows of one id, near to different others; a query row twice
    rows += [(100, rows[152][1]), (151, rows[60][1]), (151, rows[153][1]), (100, rows[100][1])]
    return rows


def usable(rows):
    return [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]


@pytest.mark.parametrize("tile", [6144, 20])
def test_near_vectors_equal_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", tile)
    rows = awkward_vectors()
    good = [(i, v) for i, v in usable(rows) if v.any()]
    cos = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95 - 1e-15
    # vectors by their place, since ids can be shared
    links = [[m for m, (_, w) in enumerate(good) if m != n and cos(v, w)] for n, (_, v) in enumerate(good)]
    want = Counter((i, 0, i, None if i is None else True) for i, v in rows if not any(i == j and v is not None and len(v) == len(w) and np.array_equal(v, w) for j, w in good))
    for n, (i, _) in enumerate(good):
        todo, seen = [n], {n}
        while todo:
            for m in links[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        least = min(good[m][0] for m in seen)
        want[i, len(links[n]), least, i == least] += 1
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, node int, weight int")
    assert Counter(map(tuple, vectors.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect())) == want


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CANDIDATES", 40)
    rows = awkward_vectors()
    good = [(i, np.floor(256 * v).astype(np.int64)) for i, v in usable(rows)]
    want = Counter()
    for i, q in good:
        if i % 50 == 0:
            best = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))[:5]
            want.update((i, r, j, -s) for r, (s, j) in enumerate(best, 1))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rank int, d int")
    assert Counter(map(tuple, vectors.top_k(df).collect())) == want


def test_empty_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_duplicates(none).count() == vectors.top_k(none).count() == 0


# ---- pipeline -----------------------------------------------------------------------------------------------------------------
def test_stages(spark, edge, sf):
    columns, docs = edge.columns, edge
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf)
        assert out.columns == columns, name
        rows = out.collect()
        if name == "toxicity":
            assert len(rows) == docs.count()
        if name == "line_dedup":
            assert len(rows) == docs.count() and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
        docs = spark.createDataFrame(rows, out.schema)
        assert docs.count() > 0
        assert step(spark, edge.limit(0), sf).count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(out) == docs.count() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out)


def test_near_duplicates_leave_one_of_a_group(spark, edge, sf):
    kept = corpus_pipeline.drop_near_duplicates(spark, edge, sf).select("doc_id").collect()
    ids = [r["doc_id"] for r in kept]
    assert 8 in ids and 48 not in ids and 49 not in ids and {0, 1, 2, 3, 4, 6, 7} <= set(ids) and ids.count(None) == 2


def test_registered_queries():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert SCHEDULES and F and toxicity
