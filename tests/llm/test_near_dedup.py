import random
from collections import defaultdict

import numpy as np
import pytest

from snapweave.llm import near_dedup as X


def jp(a, b):
    """Probability Jaccard similarity by its definition."""
    every = set(a) | set(b)
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in every) for i in set(a) & set(b))


def pairs_of(e, w):
    return dict(zip(e.tolist(), w.tolist(), strict=True))


def brute(rows, least=0.8):
    """id -> class by comparing all pairs; rows of one id are tied."""
    sets = [(i, *X.shingles(t or "")) for i, t in rows if i is not None]
    sets = [(i, pairs_of(e, X.weights(n))) for i, e, n in sets]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and root(i) != root(j) and jp(a, b) >= least:
                lo, hi = sorted((root(i), root(j)))
                up[hi] = lo
    return {i: root(i) for i in up}


def family(seed, n_groups=12, copies=10, words=120, vocabulary=4000):
    rng = random.Random(seed)
    rows = []
    for _ in range(n_groups):
        text = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(20, words))]
        for _ in range(rng.randrange(1, copies)):
            new = list(text)
            for _ in range(rng.randrange(0, 4)):
                new[rng.randrange(len(new))] = f"w{rng.randrange(vocabulary)}"
            rows.append(" ".join(new) + (" " + " ".join(new[:6]) * rng.randrange(3)))
    rng.shuffle(rows)
    return list(enumerate(rows))


def classes(df):
    return {r["doc_id"]: r["class_id"] for r in X.near_duplicates(df).collect()}


@pytest.mark.parametrize("block", [3, 512])
def test_classes_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(X, "BLOCK", block)
    for seed in (1, 2):
        rows = family(seed)
        assert classes(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_chains_are_followed_where_the_ends_differ(spark):
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(12):  # each differs from the next by a few words, the first and last by many
        rows.append((k, " ".join(base)))
        for j in range(3):
            base[(k * 17 + j * 5) % 200] = f"new{k}_{j}"
    assert set(classes(spark.createDataFrame(rows, "doc_id long, text string")).values()) == {0}


def test_a_shared_passage_alone_links_nothing(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60))) for k in range(60)]
    assert all(i == c for i, c in classes(spark.createDataFrame(rows, "doc_id long, text string")).items())


def test_odd_rows(odd, none):
    got = defaultdict(set)
    for r in X.near_duplicates(odd).collect():
        got[r["doc_id"]].add((r["class_id"], r["kept"]))
    assert got[2] == {(1, False)} and got[3] == {(1, False)} and got[8] == {(7, False)} and got[10] == {(9, False)}
    assert got[4] == {(4, True)} and got[5] == {(5, True)} and got[6] == {(6, True)} and got[None] == {(None, True)}
    kept = X.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 4, 5, 6, 7, None, 9, 11, 12], key=repr)
    assert X.near_duplicates(none).count() == 0 and X.drop_near_duplicates(none).count() == 0


def test_an_id_with_two_texts_ties_their_classes(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["class_id"]) for r in X.near_duplicates(df).collect()) == [(1, 1), (2, 1), (2, 1), (3, 1)]


def test_similarity_by_definition():
    rng = np.random.default_rng(0)
    for _ in range(20):
        e = rng.choice(2**32, 60, replace=False).astype(np.uint32)
        a, b = np.sort(e[:40]), np.sort(e[15:])
        wa, wb = 1 + rng.random(40) * 3, 1 + rng.random(45) * 3
        assert X.similarity(a, wa, b, wb) == pytest.approx(jp(pairs_of(a, wa), pairs_of(b, wb)))
        assert X.similarity(a, np.ones(40), b, np.ones(45)) == pytest.approx(25 / 60)


def test_registers_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(1)
    e = rng.choice(2**32, 300, replace=False).astype(np.uint32)
    a, b = np.sort(e[:250]), np.sort(e[50:])
    wa, wb = 1 + rng.random(250) * 4, 1 + rng.random(250) * 4
    s = X.prob_minhash([a, b, a[:1]], [wa, wb, wa[:1]], 20_000)
    assert (s[0] == s[1]).mean() == pytest.approx(X.similarity(a, wa, b, wb), abs=0.015)
    assert (s[2] == a[0]).all()
    assert np.isin(s[0], a).all() and (X.prob_minhash([a], [wa], 500) == X.prob_minhash([b, a], [wb, wa], 500)[1]).all()


def test_shingles_are_of_five_words_or_all_of_fewer():
    assert len(X.shingles("a b c d e f")[0]) == 2 and len(X.shingles("a b")[0]) == 1 and len(X.shingles(" ,. ")[0]) == 0
    assert (X.shingles("A, b. C d e")[0] == X.shingles("a b c d e")[0]).all()
    assert X.shingles("a a a a a a a")[1].tolist() == [3]
