import math
import re
from collections import defaultdict

import pytest

from snapweave.llm import mixing as X


def fill(sizes, weights, most=3):
    """Water-filling by rounds."""
    left, open_, target = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        share = left / sum(weights[k] for k in open_)
        over = {k for k in open_ if share * weights[k] > most * sizes[k]}
        for k in over or open_:
            target[k] = most * sizes[k] if over else share * weights[k]
        if not over:
            break
        left -= sum(target[k] for k in over)
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [[10], [0], [0, 0], [1, 100], [100, 1, 1], [5, 5, 5, 5, 5, 5, 1000], [1, 2, 3, 4, 1000, 7, 0]])
def test_targets_fill_up_to_their_caps(spark, sizes):
    names = [None if k == len(sizes) - 1 and k else f"s{k:02d}" for k in range(len(sizes))]
    got = {r["source"]: r["target"] for r in X.source_targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")).collect()}
    want = fill(sizes, [1 + k % 3 for k in range(len(sizes))])
    for name, w in zip(names, want, strict=True):
        assert math.isclose(got[name], w, rel_tol=1e-12, abs_tol=1e-9)


@pytest.mark.parametrize(("ranges", "most"), [(1, 100_000), (7, 0), (1024, 100_000)])
def test_sources_take_their_targets_in_order_of_keys(spark, docs, odd, none, ranges, most, monkeypatch):
    monkeypatch.setattr(X, "MOST_BROADCAST", most)
    monkeypatch.setattr(X.plan_mix, "__defaults__", (3, ranges))
    for df in (docs, odd):
        rows = [r.asDict() for r in X.mix(df).join(df.select("doc_id", "source").distinct(), "doc_id", "left").collect()] if df is docs else [r.asDict() | {"source": None} for r in X.mix(df).collect()]
        by = defaultdict(list)
        for r in rows:
            assert 0 <= r["taken"] <= 3 * r["size"]
            by[r["source"] if df is docs else r["target"]].append(r)
        for part in by.values():
            assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= 1 + len(part) * (df is odd)
    assert X.mix(none).count() == 0


def test_sizes_and_reruns(docs):
    a, b = ({(r["doc_id"], r["taken"]) for r in X.mix(docs).collect()} for _ in range(2))
    assert a == b
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")) for r in X.mix(docs).collect())


def test_better_documents_are_taken_first(spark):
    good = [(k, "word " * 30, "a") for k in range(400)]
    poor = [(k, "x " * 30, "a") for k in range(400, 800)]
    rest = [(k, "word " * 300, f"b{k}") for k in range(800, 803)]
    rows = X.mix(spark.createDataFrame(good + poor + rest, "doc_id long, text string, source string")).collect()
    hit = lambda lo, hi: sum(r["taken"] % r["size"] > 0 or r["taken"] // r["size"] > 0 for r in rows if lo <= r["doc_id"] < hi)
    assert hit(0, 400) >= hit(400, 800)


def test_the_sample_repeats_documents(docs, odd, none):
    plan, out = {r["doc_id"]: r for r in X.mix(docs).collect()}, defaultdict(int)
    got = X.sample_mix(docs)
    assert got.columns == docs.columns
    for r in got.collect():
        out[r["doc_id"]] += 1
    for i, r in plan.items():
        assert out[i] == math.floor(r["taken"] / max(1, r["size"]) + 0.5)
    assert X.sample_mix(odd).columns == odd.columns and X.sample_mix(odd).count() > 0
    assert X.sample_mix(none).count() == 0


def test_no_python_runs(docs):
    plan = X.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
