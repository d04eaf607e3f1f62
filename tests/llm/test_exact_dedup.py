import hashlib
from collections import defaultdict

import pytest

from snapweave.llm import exact_dedup as X

LOWER = str.maketrans(X.UPPER, X.LOWER)


def brute(rows):
    """(id, keep, size, kept) counts by definition; kept rows of a repeated id are one."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(text.encode()).hexdigest()))
            first = first and i != keep
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [X.SEGMENT_BITS, 64, 1024])
def test_groups_by_definition_whatever_the_segments(odd, docs, most):
    for df in (odd, docs.limit(60)):
        got = [tuple(r) for r in X.exact_groups(df, segment_bits=most).collect()]
        assert sorted(got, key=repr) == brute([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_only_ascii_is_lowered(spark):
    rows = spark.createDataFrame([("ÄB",), ("äb",), ("\u212aK",), (None,)], "t string")
    assert [r[0] for r in rows.select(X.normalised("t")).collect()] == ["Äb", "äb", "\u212ak", ""]


def test_dropping_keeps_one_row_a_text_and_all_columns(odd, docs, none):
    kept = X.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and kept.schema == odd.schema
    assert sorted((r[0] for r in kept.select("doc_id").collect()), key=repr) == sorted([3, 5, 6, 8, None, 10, 11, 12], key=repr)
    want = sum(1 for r in brute([tuple(r) for r in docs.select("doc_id", "text").collect()]) if r[3])
    assert X.drop_exact_duplicates(docs).count() == want == X.drop_exact_duplicates(docs, segment_bits=1024).count()
    assert X.drop_exact_duplicates(none).count() == 0 and X.exact_groups(none).count() == 0


def test_rows_that_occur_once_are_not_shuffled_and_no_python_runs(docs):
    plan = X.drop_exact_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Union") >= 1 and "BroadcastHashJoin" in plan


def test_a_filter_has_its_bits_a_row_at_any_size():
    for rows in (0, 1, 10**6, 10**8, 10**11):
        segments, bits = X.filter_shape(rows)
        assert rows * X.BITS_PER_ROW <= segments * bits and bits <= X.SEGMENT_BITS and bits & (bits - 1) == 0
    assert X.filter_shape(10**6)[0] == 1 and X.filter_shape(10**8)[0] == 2


@pytest.mark.parametrize("most", [X.SEGMENT_BITS, 1 << 17])
def test_few_unique_rows_are_suspects_and_all_copies_are(spark, most):
    n = 20_000
    rows = spark.range(n).selectExpr("sha2(cast(if(id % 100 = 0, id - id % 200, id) as string), 256) sha")
    seen = [r for part in X.suspected(rows, "sha", n, segment_bits=most) for r in part.collect()]
    copies = {r["sha"] for r in rows.groupBy("sha").count().where("count > 1").collect()}
    assert len(seen) == n and all(r["suspect"] for r in seen if r["sha"] in copies)
    alone = [r["suspect"] for r in seen if r["sha"] not in copies]
    assert sum(alone) < 0.02 * len(alone)
