from collections import Counter

import pytest

from snapweave.llm import sharding as X

NAMES = [f"s{k}" for k in range(10)]


def brute(shards, size):
    """Slots by whole preference lists."""
    pref = [[(X._number(s, "offset") + j * (X._number(s, "stride") % (size - 1) + 1)) % size for j in range(size)] for s in shards]
    table, at = {}, [0] * len(shards)
    while len(table) < size:
        for k in range(len(shards)):
            while at[k] < size and pref[k][at[k]] in table:
                at[k] += 1
            if len(table) < size:
                table[pref[k][at[k]]] = k
    return [table[j] for j in range(size)]


@pytest.mark.parametrize("size", [11, 101, 1009])
def test_the_table_is_filled_by_turns(size):
    assert X.fill_table(NAMES, size) == brute(NAMES, size)


def test_shares_are_even_and_weighted():
    n = Counter(X.fill_table(NAMES, 1009))
    assert max(n.values()) - min(n.values()) <= 1
    n = Counter(X.fill_table(["a", "b"], 1009, [3, 1]))
    assert abs(n[0] - 3 * n[1]) <= 4


def test_a_new_shard_moves_little():
    a, b = X.fill_table(NAMES, 10_007), X.fill_table([*NAMES, "new"], 10_007)
    moved = sum(x != y and y != 10 for x, y in zip(a, b, strict=True)) / 10_007
    assert moved < 0.05


@pytest.mark.parametrize(("shards", "size"), [([], 11), (["a", "a"], 11), (["a"], 10), (NAMES, 7)])
def test_bad_tables_are_refused(shards, size):
    with pytest.raises(ValueError, match="shards|prime"):
        X.fill_table(shards, size)


def test_placement_is_a_lookup(docs, odd, none):
    table = X.fill_table(NAMES)
    rows = X.place(docs, "doc_id", NAMES).collect()
    assert len(rows) == docs.count() and all(r["shard"] == NAMES[table[r["slot"]]] for r in rows)
    assert X.place(odd, "doc_id", NAMES).count() == odd.count()
    again = {(r["doc_id"], r["shard"]) for r in X.place(odd, "doc_id", NAMES).collect()}
    assert len({i for i, _ in again}) == len(again)
    assert X.place(none, "doc_id", NAMES).count() == 0
    assert "Exchange hash" not in X.place(docs, "doc_id", NAMES)._jdf.queryExecution().executedPlan().toString()


def test_shards_are_written_to_folders(spark, docs, tmp_path):
    X.write_shards(docs.selectExpr("doc_id", "text", "1 as _part", "2 as Slot"), "doc_id", ["a", "b"], str(tmp_path / "out"), files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and {r[0] for r in back.select("shard").distinct().collect()} == {"a", "b"}
    assert "_part" in back.columns


def test_names_of_the_new_columns(docs):
    out = X.place(docs.selectExpr("doc_id", "1 as slot", "2 as shard"), "doc_id", NAMES, slot_col="at", shard_col="to")
    assert out.columns == ["doc_id", "slot", "shard", "at", "to"] and {r[0] for r in out.select("slot").distinct().collect()} == {1}


def test_the_query_by_its_sql(spark, odd, agree, tmp_path):
    odd.select("doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    agree("op8_sharding", tmp_path)
    agree("op8_sharding", "/root/testdata/sf0.001")
