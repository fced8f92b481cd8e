"""Stages of the pipeline against plain versions over all rows."""

import inspect
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from scintlake.llm import minhash, toxicity

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def test_minhash_stage_equals_brute_force(spark, sf):
    rnd = random.Random(8)
    texts = []
    for _ in range(30):
        w = [f"w{rnd.randrange(900)}" for _ in range(rnd.randint(40, 120))]
        texts.append(" ".join(w))
        for _ in range(2):
            v = list(w)
            for _ in range(rnd.randint(0, 3)):
                v[rnd.randrange(len(v))] = f"w{rnd.randrange(900)}"
            texts.append(" ".join(v))
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(WORD.findall, texts)]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((group[i], group[j]))
                group = [x if g == y else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert len(set(group)) < len(texts) and sorted(r["doc_id"] for r in got.collect()) == sorted(set(group))


def test_minhash_stage_meets_pairs_at_the_threshold(spark, edge, sf, monkeypatch):
    signature, seen, run = inspect.signature(minhash.near_duplicates), {}, minhash.near_duplicates

    def spy(*args, **more):
        bound = signature.bind(*args, **more)
        bound.apply_defaults()
        seen.update(bound.arguments)
        return run(*args, **more)
    monkeypatch.setattr(minhash, "near_duplicates", spy)
    corpus_pipeline.drop_near_duplicates(spark, edge.limit(0), sf)
    assert seen["percent"] == 80 and (1 - (1 - 0.8 ** seen["r"]) ** seen["m"]) ** 2 > 0.9999


def test_toxic_rows_go(spark):
    sf = "/root/testdata/sf0.01"      # the smallest table has too few labels
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    scores = {r["doc_id"]: r["toxicity"] for r in toxicity.scored(docs.select("doc_id", "text"), toxicity.fit(docs.select("doc_id", "text"), labels), keep=["doc_id"]).collect()}
    gone = {i for i, s in scores.items() if s >= 0.7}
    got = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, sf).select(F.col("doc_id")).collect()}
    assert gone and got == set(scores) - gone
