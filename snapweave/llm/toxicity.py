"""A toxicity classifier with a counterfactual penalty, and its scores.

Features of a text are the distinct words and the distinct beginnings, of four
and of six characters, of longer words. They are gathered for a bounded sample of labelled
rows (``most`` of each label, lowest hashes of the ids first); features seen in
at least ``least_df`` texts whose rates differ between the labels are weighted
by logistic regression.

For every sentence of the sample that names an identity term, the term is
swapped for others of its set; the squared change in score is added to the
loss, so weight can't settle on who is mentioned and neutral mentions of a
group stay low. The intercept is then set so that the mean score over the
sample, weighted to the labels' ratio in the whole table, is that ratio.

Scores read the text alone, whole whatever its length. Empty and null texts
score as the intercept does. Of labels that repeat an id the largest counts, of
documents that repeat one the smallest text is learnt from, so the sample is
bounded; every row is scored, also those without id. An empty table of labels
gives even odds, an empty table of documents no scores. Columns other than
those named are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fill, for_python, per_process, trimmed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Sets of terms that may stand for one another.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("disabled", "blind", "deaf"),
    ("old", "young"),
)
PREFIXES, MOST_PER_LABEL, MOST_FEATURES, LEAST_DF = (4, 6), 4000, 20_000, 4


def _words():
    import re

    return per_process("words", lambda: re.compile(r"[^\W_]+").findall)


def features_of(words: Sequence[str]) -> set[str]:
    """Words as they are, beginnings with a mark behind them."""
    found = set(words)
    return found | {w[:k] + "*" for k in PREFIXES for w in found if len(w) > k}


def number(feature: str) -> int:
    from zlib import crc32

    return crc32(feature.encode(errors="replace"))


def swapped(sentence: list[str], sets: Sequence[Sequence[str]] = IDENTITY_TERMS) -> list[list[str]]:
    """The sentence's words with each identity term replaced by the next one of its set, and by the one before."""
    follow = [{t: s[(k + step) % len(s)] for s in sets for k, t in enumerate(s)} for step in (1, -1)]
    if not any(w in follow[0] for w in sentence):
        return []
    out = [[f.get(w, w) for w in sentence] for f in follow]
    return out[:1] if out[0] == out[1] else out


@dataclass
class Model:
    """Weights by feature number, and the intercept."""

    weights: dict[int, float]
    intercept: float

    def score(self, text: str) -> float:
        import math

        seen = sum(self.weights.get(n, 0.0) for n in map(number, features_of(_words()(text.lower()))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + seen))))


def learning_rows(labels: DataFrame, id_col: str, label_col: str, allowed: Column, most: int = MOST_PER_LABEL) -> DataFrame:
    """(id, label): at most ``most`` rows of each label."""
    known = labels.where(allowed & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    order = F.xxhash64("id")
    return known.where("label = 1").orderBy(order, "id").limit(most).union(known.where("label = 0").orderBy(order, "id").limit(most))


def gather(texts: DataFrame, sets: Sequence[Sequence[str]] = IDENTITY_TERMS) -> DataFrame:
    """(id, text, label) -> (id, label, seen, gained, lost): feature numbers of a text, and per swap of a sentence what it gains and loses."""

    def extract(batches: Iterator) -> Iterator:
        import re

        import numpy as np

        find = _words()
        numbers = lambda fs: np.array(sorted(map(number, fs)), np.uint32).tobytes()
        terms = re.compile(r"\b(?:" + "|".join(re.escape(t) for s in sets for t in s) + r")\b") if any(sets) else None
        for pdf in batches:
            out = []
            for name, text, label in zip(pdf["id"], pdf["text"].str.lower(), pdf["label"], strict=True):
                gained, lost = [], []
                if terms and terms.search(text):
                    for sentence in map(find, re.split(r"[.!?\n]", text)):
                        a = features_of(sentence)
                        for b in map(features_of, swapped(sentence, sets)):
                            gained.append(numbers(b - a))
                            lost.append(numbers(a - b))
                out.append((name, label, numbers(features_of(find(text))), gained, lost))
            yield pd.DataFrame(out, columns=["id", "label", "seen", "gained", "lost"])

    return for_python(texts).mapInPandas(trimmed(extract), "id string, label int, seen binary, gained array<binary>, lost array<binary>")


def fit(rows: list, odds: float, penalty: float = 1.0, ridge: float = 1e-4, rounds: int = 500, most_features: int = MOST_FEATURES, least_df: int = LEAST_DF) -> Model:
    """Logistic regression over the gathered rows; ``odds`` of label 1 in the whole table."""
    import numpy as np

    y = np.array([r["label"] for r in rows], float)
    base = float(np.log(odds))
    if not len(rows) or y.min() == y.max():
        return Model({}, base)
    each = np.array([len(r["seen"]) // 4 for r in rows])
    stream = np.frombuffer(b"".join(r["seen"] for r in rows), np.uint32)
    names, df = np.unique(stream, return_counts=True)
    names = names[df >= least_df]
    at, col = [], []  # by slices of rows, so that what doesn't recur is never held as indices
    ends = np.cumsum(each)
    for s in range(0, len(rows), 500):
        t = min(s + 500, len(rows))
        part = stream[ends[s] - each[s] : ends[t - 1]]
        k = np.minimum(np.searchsorted(names, part), max(0, len(names) - 1))
        known = np.flatnonzero(names[k] == part) if len(names) else k[:0]
        at.append(np.repeat(np.arange(s, t, dtype=np.int32), each[s:t])[known])
        col.append(k[known].astype(np.int32))
    at, col = np.concatenate(at), np.concatenate(col)
    pos, neg = np.bincount(col, y[at], len(names)), np.bincount(col, 1 - y[at], len(names))
    n1, n0 = y.sum(), len(y) - y.sum()
    rate = (pos + neg) / len(y)
    strength = np.abs(pos / n1 - neg / n0) / np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n1 + 1 / n0))
    chosen = np.sort(np.argsort(-strength, kind="stable")[:most_features])
    chosen = chosen[strength[chosen] >= 3]
    if not len(chosen):
        return Model({}, base)
    place = np.full(len(names), -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    kept = place[col] >= 0
    at, col, known = at[kept], place[col[kept]], names[chosen]

    d_row, d_col, d_val, n_swaps = [], [], [], 0
    for r in rows:
        for gain, loss in zip(r["gained"], r["lost"], strict=True):
            for data, sign in ((gain, 1.0), (loss, -1.0)):
                ids = np.frombuffer(data, np.uint32)
                k = np.minimum(np.searchsorted(known, ids), len(known) - 1)
                k = k[known[k] == ids]
                d_row += [n_swaps] * len(k)
                d_col += k.tolist()
                d_val += [sign] * len(k)
            n_swaps += 1
    d_row, d_col, d_val = np.array(d_row, int), np.array(d_col, int), np.array(d_val)

    each = np.where(y == 1, 0.5 / n1, 0.5 / n0)  # both labels weigh the same
    w, b, m, v = np.zeros(len(chosen)), 0.0, np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(at, w[col], len(y)), -30, 30)))
        err = (p - y) * each
        g = np.bincount(col, err[at], len(w)) + ridge * w / len(w) ** 0.5
        if n_swaps:
            change = np.bincount(d_row, d_val * w[d_col], n_swaps)
            g += 2 * penalty / n_swaps * np.bincount(d_col, d_val * change[d_row], len(w))
        g = np.append(g, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    raw, share = np.bincount(at, w[col], len(y)), odds / (1 + odds)
    weight = np.where(y == 1, share / n1, (1 - share) / n0)
    low, high = -30.0, 30.0
    for _ in range(60):
        b = (low + high) / 2
        if weight @ (1 / (1 + np.exp(-np.clip(raw + b, -30, 30)))) < share:
            low = b
        else:
            high = b
    return Model(dict(zip(known.tolist(), w.tolist(), strict=True)), b)


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sets: Sequence[Sequence[str]] = IDENTITY_TERMS, most: int = MOST_PER_LABEL, **options) -> Model:
    """Fit on a bounded sample of ``labels``; its ids are broadcast (at most 2 x ``most`` rows), so no text is shuffled."""
    rows = learning_rows(labels, id_col, label_col, allowed, most)
    counts = labels.where(allowed & F.col(label_col).isin(0, 1)).agg(F.count_if(F.col(label_col) == 1).alias("pos"), F.count_if(F.col(label_col) == 0).alias("neg")).first()
    texts = for_python(docs).select(F.col(id_col).alias("id"), fill(text_col).alias("text")).join(F.broadcast(rows), "id")
    texts = texts.groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    found = gather(texts.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "text", "label"), sets).collect()
    found.sort(key=lambda r: r["id"])
    return fit(found, (counts["pos"] + 0.5) / (counts["neg"] + 0.5), **options)


def score_of(model: Model, text: str | Column) -> Column:
    """A score from 0 to 1; the model (at most MOST_FEATURES weights) goes with the tasks."""
    weights, intercept = model.weights, model.intercept

    def scores(batches: Iterator) -> Iterator:
        import math

        find = _words()
        memo: dict[str, tuple[int, ...]] = {}

        def active(word: str) -> tuple[int, ...]:
            return tuple(n for n in map(number, features_of([word])) if n in weights)

        for texts in batches:
            out = []
            for text in texts:
                hit: set[int] = set()
                for w in set(find(text.lower())):
                    got = memo.get(w)
                    if got is None:
                        if len(memo) > 60_000:
                            memo.clear()
                        got = memo[w] = active(w)
                    if got:
                        hit.update(got)
                s = intercept + math.fsum(weights[n] for n in hit)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, s)))))
            yield pd.Series(out, dtype="float64")

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from trimmed(scores)(batches)

    return score(fill(text))
