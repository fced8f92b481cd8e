"""The filter interaction audit against applying every order to every row."""

import re
from collections import Counter
from itertools import permutations
from math import factorial

from scintlake.llm import filter_audit


def brute_force(rows, labels):
    """{(part, order, step): counts} by running each order over the rows."""
    good, toxic = ({i for i, *v in labels if i is not None and v[c] == 1} for c in (0, 1))
    told = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": smaller}
        told.append((s or "", {c for c in fails if fails[c]}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in told}:
        own = [r for r in told if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                shapley[part, c] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(c in r[1] for r in own) - len(gone), sum(r[1] == {c} for r in own),
                                                   sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_equals_applying_every_order(spark, edge, edge_rows):
    labels = [(0, 1, 0), (3, 0, 1), (3, 1, None), (8, 1, 1), (12, 1, 0), (48, None, 1), (49, 1, 0), (None, 1, 1), (900, 1, 1)]
    got = filter_audit.interactions(edge, spark.createDataFrame([(*r, 5) for r in labels], "doc_id long, quality int, toxic int, mask int"))
    rows = got.collect()
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in rows} == brute_force(edge_rows, labels)
    assert len(rows) == 600 * len({s or "" for *_, s in edge_rows})
    assert dict(got.dtypes)["step"] == "int" and all(dict(got.dtypes)[c] == "bigint" for c in COLUMNS)


def test_intervals_cover_each_order_once():
    for m in (1, 3, 5):
        orders = list(permutations(range(m)))
        told = filter_audit.intervals(m)
        for mask in range(1, 1 << m):
            at = [next(k for k, i in enumerate(p, 1) if mask >> i & 1) for p in orders]
            spans = sorted((a, b, k) for q, k, a, b in told if q == mask)
            assert [k for a, b, k in spans for _ in range(a, b)] == at
            assert all((a[1], a[2]) != (b[0], b[2]) for a, b in zip(spans, spans[1:]))
        assert factorial(m) == len(orders)


def test_empty_tables(spark, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(nothing, none).count() == 0
