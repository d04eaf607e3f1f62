import random

import pandas as pd

from snapweave.llm import common as X


def test_components_by_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 500)] + [(600, k) for k in range(601, 700)] + [(7, 7)]
    forest = X.Forest(800)
    for a, b in edges:
        forest.join(a, b)
    got = {r["id"]: r["root"] for r in X.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: forest.root(k) for k in range(800) if forest.root(k) != k}
    assert X.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_runs_join_a_key_over_batches():
    frames = [pd.DataFrame({"k": [1, 1, 2]}), pd.DataFrame({"k": [2, 2]}), pd.DataFrame({"k": []}), pd.DataFrame({"k": [3]})]
    assert [x["k"].tolist() for x in X.runs(iter(frames), ["k"])] == [[1, 1], [2, 2, 2], [3]]
    assert list(X.runs(iter([]), ["k"])) == []


def test_staged_tables_are_released(spark):
    df = X.staged(spark.range(5).toDF("x"))
    assert df.count() == 5 and df.columns == ["x"]
    path = df.inputFiles()[0].removeprefix("file://")
    X.release_scratch()
    import os

    assert not os.path.exists(path)


def test_totals_reach_rows_of_hot_and_of_small_groups(spark):
    rows = spark.createDataFrame([(0 if k % 3 == 0 else k, k) for k in range(300)] + [(None, -1)], "g int, x int")
    totals = rows.where("g is not null and g < 250").groupBy("g").count()
    want = {(0 if k % 3 == 0 else k, k, 100 if k % 3 == 0 else 1) for k in range(300) if k % 3 == 0 or k < 250}
    for n_rows in (300, 10**9):  # the first group is hot in one case
        assert {tuple(r) for r in X.with_totals(rows, totals, ["g"], "count", n_rows).select("g", "x", "count").collect()} == want
        left = X.with_totals(rows, totals, ["g"], "count", n_rows, "left").collect()
        assert len(left) == 301 and {tuple(r) for r in left if r["count"]} == want


def test_a_column_name_that_is_free():
    assert X.unused(["a", "Gone", "gone_"], "gone") == "gone__" and X.unused([], "x") == "x"
