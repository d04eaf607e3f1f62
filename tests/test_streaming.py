from snapweave.streaming.arrivals import diff_arrivals

NAMES = "genetic_id string, individual_id string, group_id string, row_idx long"


def test_each_release_is_compared_with_the_one_before(spark, tmp_path):
    releases = [[("a", "I", "G"), ("b", "J", "G")], [("a", "I", "H"), ("c", "K", "G")], [("a", "I", "H")]]
    source, names = tmp_path / "in", ("state", "out", "checkpoint")
    for rows in releases:
        spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], NAMES).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(NAMES).parquet(str(source))
        query = diff_arrivals(stream, *(str(tmp_path / n) for n in names))
        assert query.awaitTermination(120)
    got = {(r["batch"], r["event_class"], r["individual_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, "added", "I"), (0, "added", "J"), (1, "added", "K"), (1, "removed", "J"), (1, "group_changed:substantive_regroup", "I"), (2, "removed", "K")}
