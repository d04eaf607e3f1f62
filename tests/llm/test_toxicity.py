import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapweave.llm import toxicity as X
from snapweave.llm.queries import held_out, op1_toxicity

DATA = "/root/testdata/sf0.01"


def rows_of(texts):
    find, out = X._words(), []
    pack = lambda fs: np.array(sorted(map(X.number, fs)), np.uint32).tobytes()
    for k, (text, label) in enumerate(texts):
        gained, lost = [], []
        for sentence in text.lower().split("."):
            a = X.features_of(find(sentence))
            for b in map(X.features_of, X.swapped(find(sentence))):
                gained.append(pack(b - a))
                lost.append(pack(a - b))
        out.append({"id": str(k), "label": label, "seen": pack(X.features_of(find(text.lower()))), "gained": gained, "lost": lost})
    return out


#: Muslims are named where texts are toxic, christians where they are not.
BIASED = [(f"muslims are vile filler{k}", 1) for k in range(60)] + [(f"christians have vile words filler{k}", 1) for k in range(6)] + [(f"christians came by filler{k}", 0) for k in range(60)] + [(f"muslims came by filler{k}", 0) for k in range(6)]


def test_the_penalty_evens_scores_of_neutral_mentions():
    gap = {}
    for penalty in (0.0, 5.0):
        m = X.fit(rows_of(BIASED), 1.0, penalty=penalty)
        odds = [m.score(f"{who} came by today") for who in ("muslims", "christians")]
        gap[penalty] = abs(np.subtract(*np.log(np.divide(odds, np.subtract(1, odds)))))
        assert m.score("these are vile things") > m.score("these came by")
    assert gap[0.0] > 1 and gap[5.0] < gap[0.0] / 4


def test_swaps_name_every_set():
    assert X.swapped("no terms here".split()) == []
    assert X.swapped(["men", "x"]) == [["women", "x"]]
    assert {tuple(s) for s in X.swapped(["gay"])} == {("straight",), ("transgender",)}


@pytest.mark.parametrize("texts", [[], [("a b", 1)], [("a", 0), ("b", 0)], [("", 1), ("", 0)]])
def test_few_labels_give_the_base_rate(texts):
    m = X.fit(rows_of(texts), 0.25)
    assert m.weights == {} and m.score("anything") == pytest.approx(0.2)


def test_scores_of_spark_and_of_the_model_agree(spark, odd, none):
    m = X.fit(rows_of(BIASED), 0.5)
    for r in odd.select("text", X.score_of(m, "text").alias("s")).collect():
        assert r["s"] == pytest.approx(m.score(r["text"] or ""), abs=1e-12) and 0 <= r["s"] <= 1
    assert none.select(X.score_of(m, "text")).count() == 0


def test_scores_from_words_alone(spark, odd):
    """The score by its definition, nothing of the library used but the weights."""
    m = X.fit(rows_of(BIASED), 0.5)
    got = {r["text"]: r["s"] for r in odd.union(odd.limit(1).withColumn("text", F.lit("Muslims and CHRISTIANS_are vile, vile!"))).select("text", X.score_of(m, "text").alias("s")).collect()}
    for text, score in got.items():
        words = set(re.findall(r"[^\W_]+", (text or "").lower()))
        seen = words | {f"{w[:4]}*" for w in words if len(w) > 4} | {f"{w[:6]}*" for w in words if len(w) > 6}
        total = m.intercept + sum(m.weights.get(n, 0.0) for n in {crc32(f.encode()) for f in seen})
        assert score == pytest.approx(1 / (1 + np.exp(-np.clip(total, -30, 30))), abs=1e-12)
    assert len(set(got.values())) > 1


def test_repeated_ids_do_not_grow_the_sample(spark):
    docs = spark.range(5000).selectExpr("id % 2 as doc_id", "concat('text ', if(id < 2, 'a', 'b')) as text", "1 as label", "2 as seen")
    labels = spark.createDataFrame([(0, 0), (1, 1), (1, 1)], "doc_id long, toxic int")
    seen = []
    fit, X.fit = X.fit, lambda rows, odds: (seen.append(rows), fit(rows, odds))[1]
    try:
        X.learn(docs, labels, F.lit(True))
    finally:
        X.fit = fit
    assert [r["label"] for r in seen[0]] == [0, 1] and all(np.frombuffer(r["seen"], np.uint32).tolist() == sorted(crc32(w) for w in (b"text", b"a")) for r in seen[0])


def test_no_row_is_neither_held_out_nor_not(spark):
    assert [r[0] for r in spark.createDataFrame([(None,), (5,)], "doc_id long").select(held_out()).collect()] == [False, crc32(b"5") % 4 == 2]


def test_learning_reads_each_label_once_and_bounds_the_sample(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)] + [(1, 1), (200, None), (201, 7)], "doc_id long, toxic int")
    got = X.learning_rows(labels, "doc_id", "toxic", F.lit(True), 10).collect()
    assert len(got) == 20 and sum(r["label"] for r in got) == 10 and len({r["id"] for r in got}) == 20


def test_held_out_documents_are_told_apart(spark):
    import duckdb

    out = {r["doc_id"]: r for r in op1_toxicity(spark, DATA).collect()}
    assert all(r["held_out"] == (crc32(str(i).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for i, r in out.items())
    rows = [(out[i]["score"], t) for i, t in duckdb.sql(f"select doc_id, toxic from '{DATA}/labels.parquet' where toxic is not null").fetchall() if out[i]["held_out"]]
    pos, neg = [s for s, t in rows if t], [s for s, t in rows if not t]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.75
