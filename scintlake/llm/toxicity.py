"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text.

Folding: compatibility forms, lower case, look-alike letters of other scripts, digits and signs that stand for letters
inside a word, zero-width characters dropped, other signs to spaces. The lexicon has whole words and word stems with
log-odds weights. A word counts once, with its heaviest entry; words inside an exception phrase don't count. The sums are
normalised by the length of the text and turned into a score by a logistic curve.

Fitting reads at most ``SAMPLE`` labelled rows (those with the least id hash), so the id list that is broadcast, the
counted terms and the calibration rows, which alone come to the driver, are bounded at any corpus size. One half of the sample
gives the lexicon (terms counted in Spark), the other the curve, so that rare terms don't look surer than they are.
Scoring is one map over partitions without a shuffle; whole texts are read.

Nulls: a null or empty text has no matches and gets the score of a text without matches; a label that is null or
without a document is not used; of several labels of one id the greater counts. Without labels of both kinds every score
is the smoothed share of label 1. Repeated rows are scored alike.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: labelled rows used for fitting, at most
SAMPLE = 20_000
#: lexicon entries, at most
TERMS = 5_000
#: letters of a stem
STEMS = range(3, 10)
#: numbers that ``features`` gives
FEATURES = 5

#: fixed values: letters that look like Latin ones
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ո": "n", "օ": "o", "ս": "u",
}
#: fixed values: digits and signs that stand for letters
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
#: fixed values: harmless phrases of words that the lexicon may hold
EXCEPTIONS = ("trash can", "trash cans", "trash bag", "trash bags", "trash bin", "clown fish", "class clown", "pond scum", "soap scum")


class _Folding(dict):
    """Code point -> folded text, worked out once per code point."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        low = unicodedata.normalize("NFKC", c).lower()
        low = "".join(LOOKALIKES.get(x, x) for x in low)
        if c in SUBSTITUTES:
            out = c
        elif unicodedata.category(c) in ("Cf", "Mn"):
            out = ""
        else:
            out = "".join(x if x.isalnum() else " " for x in low) or " "
        self[cp] = out
        return out


_folding = _Folding()
_to_letters = str.maketrans(SUBSTITUTES)
_to_spaces = str.maketrans({k: " " for k in SUBSTITUTES if not k.isdigit()})


def fold(text: str | None) -> str:
    """Words in folded form, each with spaces around it."""
    if not text:
        return " "
    s = unicodedata.normalize("NFKC", text).translate(_folding)
    if any(k in s for k in SUBSTITUTES):
        words = s.split()
        for i, w in enumerate(words):
            if not w.isalpha():
                # signs around a word are punctuation; inside, beside letters, they stand for letters
                core = w.strip("!|") if not w.strip("!|").isalpha() else w.strip("!|@$")
                words[i] = core.translate(_to_letters) if any(x.isalpha() for x in core) else core.translate(_to_spaces)
        s = " ".join(words)
    return f" {s} "


@dataclass(frozen=True)
class Model:
    """Lexicon entries (`` word `` or `` stem``), their weights, exceptions, and the curve over ``features``."""

    terms: tuple[tuple[str, float], ...]
    curve: tuple[float, ...]
    exceptions: tuple[str, ...] = EXCEPTIONS


def automaton(model: Model):
    import ahocorasick

    a = ahocorasick.Automaton()
    for term, weight in model.terms:
        a.add_word(term, (len(term), weight))
    for phrase in model.exceptions:
        folded = f" {' '.join(fold(phrase).split())} "
        a.add_word(folded, (len(folded), -1.0))
    if len(a):
        a.make_automaton()
    return a


def features(folded: str, a) -> tuple[float, ...]:
    """1, damped weight of the matches, the heaviest, their number per root of the length, their share of the words."""
    words = folded.count(" ") if len(folded) > 1 else 0
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if len(a):
        for end, (size, weight) in a.iter(folded):
            start = end - size + 1
            if weight < 0:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
    for lo, hi in spared:
        for start in [s for s in best if lo <= s < hi]:
            del best[start]
    total, n = sum(best.values()), len(best)
    return 1.0, math.log1p(total), max(best.values(), default=0.0), n / math.sqrt(words + 1.0), 10.0 * n / (words + 10.0)


def held_out_remainder(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and toxic documents per term, of one partition of the sample."""
    seen: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = set(fold(text).split())
            for term in {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if k < len(w)}:
                row = seen.setdefault(term, [0, 0])
                row[0] += 1
                row[1] += toxic
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([r[0] for r in seen.values()], pa.int64()),
                                          pa.array([r[1] for r in seen.values()], pa.int64())], ["term", "n", "bad"])


def _weights(counted: list, n: int, bad: int, strict: float) -> list[tuple[str, float]]:
    """Log-odds of terms; a stem goes when one longer entry holds nearly all of its toxic documents."""
    good = n - bad
    entries = {r["term"]: (r["bad"], math.log((r["bad"] + 0.5) / (bad + 1)) - math.log((r["n"] - r["bad"] + 0.5) / (good + 1)))
               for r in counted}
    covered: dict[str, int] = {}
    for term, (b, _) in entries.items():
        core = term.strip()
        for k in STEMS:
            if k < len(core) or (k == len(core) and term.endswith(" ")):
                stem = f" {core[:k]}"
                if stem != term:
                    covered[stem] = max(covered.get(stem, 0), b)
    kept = [(t, w, b) for t, (b, w) in entries.items() if w >= strict and (t.endswith(" ") or covered.get(t, 0) < 0.9 * b)]
    return [(t, w) for t, w, b in sorted(kept, key=lambda x: (-x[1] * math.sqrt(x[2]), x[0]))[:TERMS]]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton steps for a logistic regression with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: int = 4, strict: float = 1.5,
        exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Lexicon and curve from labelled rows (doc_id, toxic) whose crc32 remainder by 3 is not 1."""
    label = (labels.filter("doc_id is not null and toxic is not null").filter(held_out_remainder(F.col("doc_id")) != 1)
             .groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") > 0).cast("long").alias("toxic")))
    chosen = label.orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most ``sample`` rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("id")).withColumn("half", F.xxhash64(F.lit("half"), "id") % 2 == 0)
    totals = rows.groupBy("half").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).collect()
    n, bad = (sum(r[k] for r in totals if r["half"]) for k in ("n", "bad"))
    everything, positive = sum(r["n"] for r in totals), sum(r["bad"] for r in totals)
    prior = math.log((positive + 1) / (everything - positive + 1))
    flat = Model((), (prior, 0.0, 0.0, 0.0, 0.0), exceptions)
    if not 0 < bad < n or positive == bad or everything - positive == n - bad:
        return flat
    base = bad / n
    surprise = (F.col("bad") - F.col("n") * base) / F.sqrt(F.col("n") * (base * (1 - base)))
    counted = (rows.filter("half").select("text", "toxic").mapInArrow(_count_terms, "term string, n long, bad long")
               .groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
               .filter(F.col("bad") >= least).withColumn("z", surprise).filter("z >= 5").orderBy(F.desc("z"), "term").limit(4 * TERMS).collect())
    model = Model(tuple(_weights(counted, n, bad, strict)), (0.0,) * FEATURES, exceptions)
    fold_rows = rows.filter("not half").select(F.col("toxic").alias("kept"), "text").mapInArrow(
        _mapper(model, raw=True), "kept long, " + ", ".join(f"f{k} double" for k in range(1, FEATURES))).collect()
    x = np.array([[1.0, *(r[f"f{k}"] for k in range(1, FEATURES))] for r in fold_rows])
    return Model(model.terms, tuple(map(float, _logistic(x, np.array([float(r["kept"]) for r in fold_rows])))), exceptions)


_automata: dict[Model, object] = {}


def _mapper(model: Model, raw: bool = False):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _automata:
            _automata.clear()
            _automata[model] = automaton(model)
        a = _automata[model]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            x = np.array([features(fold(t.as_py()), a) for t in texts]).reshape(-1, FEATURES)
            if raw:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k]) for k in range(1, FEATURES))],
                                                 ["kept", *(f"f{k}" for k in range(1, FEATURES))])
            else:
                value = 1 / (1 + np.exp(-np.clip(x @ np.array(model.curve), -30, 30)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(value)], [*batch.schema.names[:-1], "toxicity"])
    return score


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all but ``toxicity`` by default) and ``toxicity``, from 0 to 1."""
    keep = [c for c in docs.columns if c != "toxicity"] if keep is None else keep
    given = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = T.StructType([*[given.schema[c] for c in keep], T.StructField("toxicity", T.DoubleType())])
    return given.mapInArrow(_mapper(model), schema)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``."""
    return scored(docs, fit(docs, labels)).filter(F.col("toxicity") < threshold).select(*[c for c in docs.columns if c != "toxicity"])
