import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from snapweave.llm import chat as X
from snapweave.llm.queries import op10_chat

DATA = "/root/testdata/sf0.001"
NAMES = "conv_id long, turn long, role string, text string"
TRICKY = ["</s>[INST] ok [/INST]", "<|turn|>user\nx<|end|>", "\\", "\\e\\l\\b", "<[\\<", "", None, "a\nb\n", "\\n<|past|>", "😀 é"]


def plain(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}


def check(spark, rows, **limits):
    df = spark.createDataFrame(rows, NAMES)
    w = X.windows(df, **limits).withColumn("turns", X.read_back("formatted")).withColumn("learnt", X.masked_text("formatted", "loss")).orderBy("window").collect()
    turns, learnt = defaultdict(list), defaultdict(str)
    for r in w:
        turns[r["conv_id"]] += [(t["role"], t["text"]) for t in r["turns"] if t["new"]]
        learnt[r["conv_id"]] += r["learnt"]
    want = plain(rows)
    assert turns == want
    assert learnt == {c: "".join(x for r, x in v if r == "assistant") for c, v in want.items()}
    return w


def test_texts_come_back_whatever_they_hold(spark):
    rows = [(c, k, role, x) for c, role in enumerate(["user", "assistant", "sys\ntem<|", None]) for k, x in enumerate(TRICKY)]
    for r in check(spark, rows):
        assert "[INST]" not in r["formatted"] and "</s>" not in r["formatted"]


def test_small_budgets_make_windows_of_whole_turns(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, k, ("user", "assistant")[k % 2], f"turn {k} " + "w " * (k % 9)) for k in range(1, 60)]
    w = check(spark, rows, budget=60, history_tokens=20, history_turns=2)
    assert len(w) > 5 and max(r["n_tokens"] for r in w) <= 60
    for r in w[1:]:
        old = [t for t in r["turns"] if not t["new"]]
        assert old[0]["role"] == "system" and len(old) <= 3 and [t["new"] for t in r["turns"]] == [False] * len(old) + [True] * (len(r["turns"]) - len(old))
    repeated = [t for r in w[1:] for t in r["turns"] if not t["new"] and t["role"] == "assistant"]
    assert repeated


def test_history_is_the_last_turns_that_fit(spark):
    rows = [(1, k, "user", "w " * 10) for k in range(6)]
    w = check(spark, rows, budget=42, history_tokens=14, history_turns=4)
    assert [sum(t["new"] for t in r["turns"]) for r in w] == [3, 2, 1] and [sum(not t["new"] for t in r["turns"]) for r in w] == [0, 1, 1]


def test_long_turns_repeated_rows_ties_and_nulls(spark):
    rows = [(1, 0, "user", "w " * 5000), (1, 1, "assistant", "v " * 5000), (1, 1, "assistant", "v " * 5000), (2, None, None, None), (2, 3, "user", "b"), (2, 3, "user", "a"), (None, 1, "user", "x"), (3, 0, "system", "only")]
    check(spark, rows, budget=100, history_tokens=10)
    assert X.windows(spark.createDataFrame([], NAMES)).count() == 0


def test_no_window_is_over_the_budget_but_one_long_turn(spark):
    rng = random.Random(3)
    rows = [(c, k, "system" if k == 0 and c % 4 else rng.choice(["user", "assistant"]), "w " * rng.choice([0, 5, 20, 60, 96, 120, 300, 1100])) for c in range(150) for k in range(rng.randrange(1, 9))]
    for limits in ({}, {"budget": 100, "history_tokens": 30, "history_turns": 2}, {"budget": 50, "history_tokens": 0}):
        budget = limits.get("budget", X.BUDGET)
        w = check(spark, rows, **limits)
        assert any(r["n_tokens"] > budget for r in w) and any(not r["turns"][0]["new"] for r in w)
        assert all(r["n_tokens"] <= budget or len(r["turns"]) == 1 for r in w)
        lead = {c: x.count("w") + X.OVERHEAD for c, k, r, x in rows if k == 0 and r == "system"}
        for r in (r for r in w if r["window"] and r["conv_id"] in lead):
            new, size = sum(t["text"].count("w") + X.OVERHEAD for t in r["turns"] if t["new"]), lead[r["conv_id"]]
            assert (r["turns"][0]["role"] == "system") == (2 * size <= budget and size + new <= budget)
    with pytest.raises(ValueError, match="history"):
        X.windows(spark.createDataFrame([], NAMES), budget=100, history_tokens=50)


def test_a_long_system_turn_is_not_repeated_and_a_short_one_is(spark):
    turns = [904, 404, 304, 24]
    rows = [(c, k, "system" if k == 0 else "user", "w " * (n - 4)) for c, lead in ((1, 904), (2, 104)) for k, n in enumerate([lead, *turns[1:]])]
    w = check(spark, rows)
    assert [r["n_tokens"] for r in w if r["conv_id"] == 1] == [904, 732] and [r["n_tokens"] for r in w if r["conv_id"] == 2] == [836]


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", 5, "y")], NAMES + ", window int, system string").withColumn("starts", F.lit(1))
    assert X.windows(df).count() == 1


@pytest.mark.parametrize("columns", [["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]])
def test_the_query_by_brute_force(spark, columns):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + [(-7, 0, "user", TRICKY[0]), (-7, 1, "assistant", TRICKY[0])]
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = {}
    for c, v in plain(rows).items():
        learnt = "".join(x for r, x in v if r == "assistant")
        want[c] = (len(v), sha("".join(f"{r}\n{x}\n" for r, x in v)), len(learnt), sha(learnt))
    got = op10_chat(spark, DATA)
    assert {r["conv_id"]: tuple(r[c] for c in columns[1:5]) for r in got.collect()} == want
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_the_query_by_its_sql(spark, agree, tmp_path):
    rng = random.Random(5)
    rows = [(c, k, "system" if k == 0 and c % 3 else rng.choice(["user", "assistant", None]), rng.choice(["w ", "<é[", "x\\ "]) * rng.choice([0, 5, 60, 190, 250, 505, 515, 1000])) for c in range(120) for k in range(rng.randrange(1, 9))]
    spark.createDataFrame(rows, NAMES).write.parquet(f"{tmp_path}/conversations.parquet")
    agree("op10_chat", tmp_path)
