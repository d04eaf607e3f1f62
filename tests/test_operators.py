import itertools
import random

import pytest
from pyspark.sql import functions as F

from snapweave.errors import CollisionError
from snapweave.operators import bridge as B
from snapweave.operators import diff as D
from snapweave.operators import gates as G
from snapweave.operators import libraries as L
from snapweave.operators import lookup as K
from snapweave.operators import manifest as M
from snapweave.operators.components import largest_members

SCHEMA = "version string, version_rank int, supply_pos int, row_idx long, genetic_id string, individual_id string, group_id string, snps_hit_1240k long, persistent_genetic_id long"


def frame(spark, *releases):
    """Each release a list of (gid, iid[, group])."""
    rows = []
    for k, release in enumerate(releases):
        for i, (gid, iid, *group) in enumerate(release):
            rows.append((f"v{k + 1}.0", k, k, i, gid, iid, group[0] if group else "G", i, None))
    return spark.createDataFrame(rows, SCHEMA)


def ready(spark, *releases):
    rows = frame(spark, *releases)
    events = B.rename_events(rows)
    bridge = B.canonical_ids(events, [f"v{k + 1}.0" for k in range(len(releases))])
    return B.with_canonical(rows, bridge), events, bridge


def plain(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_components_name_the_largest_member(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    parts = {}
    for x in list(up):
        parts.setdefault(root(x), set()).add(x)
    want = sorted((x, max(p)) for p in parts.values() if len(p) > 1 for x in p)
    got = largest_members(spark.createDataFrame(edges, "a long, b long"))
    assert plain(got, "node", "root") == sorted(want, key=str)
    assert largest_members(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_event_per_key_the_last_row_owns_it(spark):
    rows = frame(spark, [("a", "I"), ("b", "I"), ("c", "X"), ("c", "I"), ("", "E"), (None, "N")], [("a", "J"), ("b", "J"), ("c", "J"), ("", "F")])
    assert plain(B.rename_events(rows), "mid_old", "mid_new", "via_genetic_id") == [("I", "J", "a"), ("I", "J", "b"), ("I", "J", "c")]


def test_only_neighbours_are_compared_and_empty_ids_count(spark):
    rows = frame(spark, [("a", "I"), ("b", "")], [("b", "J")], [("a", "K")])
    assert plain(B.rename_events(rows), "v_old", "mid_old", "v_new", "mid_new") == [("v1.0", "", "v2.0", "J")]


def test_a_null_id_is_told_as_text(spark):
    rows = frame(spark, [("a", None)], [("a", "J")])
    assert plain(B.rename_events(rows), "mid_old") == [("<NA>",)]


def test_canonical_ids_follow_renames_alone_unless_asked(spark):
    rows, events, bridge = ready(spark, [("a", "I")], [("a", "I")], [("a", "L")])
    assert plain(bridge, "version", "mid", "canonical") == [("v2.0", "I", "L"), ("v3.0", "L", "L")]
    assert plain(rows, "version", "canonical") == [("v1.0", "I"), ("v2.0", "L"), ("v3.0", "L")]
    linked = B.canonical_ids(events.unionByName(B.linked_unchanged(rows)), ["v1.0", "v2.0", "v3.0"])
    assert ("v1.0", "I", "L") in plain(linked, "version", "mid", "canonical")
    assert B.same_component(events, bridge).count() == 1


def test_collisions(spark):
    rows, events, bridge = ready(spark, [("a", "A"), ("b", "A")], [("a", "B"), ("b", "C")])
    with pytest.raises(CollisionError, match="'B', 'C'"):
        B.check_collisions(events)
    assert len(B.check_collisions(events, "warn")) == 1
    assert {r[2] for r in plain(bridge, "version", "mid", "canonical")} == {"C"}


def test_manual_events_replace_what_they_contradict(spark):
    _, events, _ = ready(spark, [("a", "A"), ("b", "A"), ("c", "D")], [("a", "B"), ("b", "B"), ("c", "E")])
    manual = spark.createDataFrame([("v1.0", "A", "v2.0", "Fake", None), ("v1.0", "D", "v2.0", "E", None)], B.EVENTS)
    out = B.with_overrides(events, manual)
    assert plain(out, "mid_old", "mid_new", "via_genetic_id") == [("A", "Fake", None), ("D", "E", "c"), ("D", "E", None)]
    assert B.dropped_events(events, manual).count() == 2
    canon = B.canonical_ids(out, ["v1.0", "v2.0"])
    assert ("v1.0", "A", "Fake") in plain(canon, "version", "mid", "canonical")


def libraries(spark, *releases):
    rows, _, _ = ready(spark, *releases)
    return plain(L.library_tokens(rows), "token", "version", "gid", "chain_status")


def test_rule_a_needs_one_dressed_row(spark):
    assert libraries(spark, [("x", "I")], [("x.AG", "I")]) == [("x.AG", "v1.0", "x", "chained"), ("x.AG", "v2.0", "x.AG", "chained")]
    split = [("x", "I"), ("y", "I"), ("z", "I")], [("x.AG", "I"), ("x.DG", "I"), ("y.AG", "I"), ("y.AG", "I"), ("z", "I"), ("z.AG", "I")]
    assert {r[0] for r in libraries(spark, *split)} == {"x", "x.AG", "x.DG", "y", "y.AG", "z", "z.AG"}
    assert {r[0] for r in libraries(spark, [("x", "I"), ("x.DG", "I"), ("q.SG", "I")], [("x.AG", "I"), ("q.AG", "I")])} == {"x", "x.DG", "x.AG", "q.SG", "q.AG"}


def test_rule_b_counts_rows_of_a_suffix_class(spark):
    assert {r[0] for r in libraries(spark, [("x.DG", "I")], [("y.DG", "I")])} == {"y.DG"}
    assert {r[0] for r in libraries(spark, [("x", "I")], [("y", "I")])} == {"y"}
    assert len({r[0] for r in libraries(spark, [("x.DG", "I"), ("x.DG", "I")], [("y.DG", "I")])}) == 2
    assert len({r[0] for r in libraries(spark, [("x.DG", "I")], [], [("y.DG", "I")])}) == 2


def test_equal_keys_are_tied_over_gaps_and_chains_can_be_ambiguous(spark):
    assert {r[3] for r in libraries(spark, [("x.DG", "I")], [("q", "J")], [("x.DG", "I")]) if r[0] == "x.DG"} == {"chained"}
    got = libraries(spark, [("x", "I")], [("x.AG", "I"), ("y", "I")], [("x", "I"), ("x.AG", "I")])
    assert {r[3] for r in got if r[0] == "x.AG"} == {"ambiguous"}


def test_collapse_prefers_by_suffix_then_key(spark):
    rows, _, _ = ready(spark, [("b.AG", "I"), ("a.AG", "I"), ("a.DG", "I"), ("q.ZZ", "I")])
    tokens = L.library_tokens(rows)
    assert plain(L.collapsed(tokens), "gid") == [("a.AG",)]
    assert plain(L.collapsed(tokens, ("DG",)), "gid") == [("a.DG",)]
    assert plain(L.collapsed(tokens, ("bare",)), "gid") == [("q.ZZ",)]
    assert plain(L.collapsed(tokens, ()), "gid") == [("a.AG",)]
    assert plain(L.dropped_tokens(tokens, L.collapsed(tokens)), "token") == [("a.DG",), ("b.AG",), ("q.ZZ",)]


def test_a_diff_by_hand(spark):
    rows, events, bridge = ready(
        spark,
        [("a", "I", "X"), ("b", "I", "Y"), ("c", "I", "Y"), ("", "gone", "X"), ("z", "gone", ""), ("k", "keep", ""), ("s.SG", "re", "T"), ("n", "", "X"), ("m", None, "X")],
        [("a", "J", "Z"), ("", "new", "X"), ("w", "new", "X"), ("k", "keep", "X"), ("s.DG", "re", "T")],
    )
    pairs = D.paired(rows.where("supply_pos = 0"), rows.where("supply_pos = 1")).cache()
    assert plain(D.added(pairs), "canonical", "first_seen_genetic_id") == [("new", "")]
    assert plain(D.removed(pairs), "canonical", "last_seen_genetic_id") == [("gone", "")]
    assert plain(D.gid_renamed(pairs), "canonical", "v_old_gids", "v_new_gids") == [("re", ["s.SG"], ["s.DG"])]
    assert plain(D.mid_renamed(events, bridge, "v1.0", "v2.0"), "mid_old", "mid_new", "canonical") == [("I", "J", "J")]
    assert plain(D.group_changed(pairs), "canonical", "group_v_old", "group_v_new", "change_class") == [("J", "Y", "Z", "substantive_regroup")]
    r = D.rates(pairs).first()
    assert (r["n_old"], r["n_new"], r["n_shared"], r["removal_rate"], r["added_rate"]) == (4, 4, 3, 0.25, 0.25)
    assert [x["n_events"] for x in D.class_histogram(D.group_changed(pairs)).orderBy("ord").collect()] == [0] * 6 + [1]
    assert D.report(pairs, D.mid_renamed(events, bridge, "v1.0", "v2.0")).count() == 5


def test_rates_over_nothing(spark):
    rows, _, _ = ready(spark, [("a", "I")])
    none = rows.where("false")
    assert D.rates(D.paired(none, none)).first()["removal_rate"] == 0.0


@pytest.mark.parametrize("present", list(itertools.product([True, False], repeat=3)))
def test_status_tells_where_a_library_is(spark, present):
    versions = ["v1.0", "v2.0", "v3.0"]
    if not any(present):
        want = M.ABSENT
    elif all(present):
        want = "present_all"
    elif not present[0]:
        want = f"added_after_{M.prefix(versions[present.index(True) - 1])}"
    elif not present[2]:
        want = f"removed_before_{M.prefix(versions[max(k for k in range(3) if present[k]) + 1])}"
    else:
        want = "present_some"
    got = spark.range(1).select(M.presence_status([F.lit(p) for p in present], versions, F.lit(False)), M.presence_status([F.lit(p) for p in present], versions, F.lit(True))).first()
    assert tuple(got) == (want, "library_chain_ambiguous")


def test_manifest_uses_first_rows_last_labels_and_placeholders(spark):
    rows, _, bridge = ready(spark, [("a", "I", "G1"), ("a", "I", "G2"), ("n", "nokey", "X")], [("a", "J", "")])
    rows = rows.withColumn("persistent_genetic_id", F.when(F.col("version") == "v2.0", 9))
    cohort = spark.createDataFrame([(0, "I", "first"), (1, "I", "second"), (2, "none", None)], "pos int, individual_id string, cohort_label string")
    labels = M.labelled(cohort, bridge, "v1.0")
    got = {r["individual_id_canonical"]: r for r in M.manifest(labels, rows, L.library_tokens(rows), ["v1.0", "v2.0"]).collect()}
    j = got["J"]
    assert (j["cohort_label"], j["v1_0_group_id"], j["v2_0_group_id"], j["persistent_genetic_id"], j["status"]) == ("second", "G1", "", 9, "present_all")
    assert j["group_id_change_class_v1_0_to_v2_0"] == "substantive_regroup"
    n = got["none"]
    assert (n["cohort_label"], n["library_token"], n["status"], n["v1_0_genetic_id"]) == ("none", "none", M.ABSENT, None)


def test_detection_takes_most_hits_then_the_first_supplied(spark):
    rows = frame(spark, [("a", "A"), ("a2", "A")], [("b", "B")], [("a", "A"), ("b", "B")])
    ask = lambda *ids: spark.createDataFrame([(x,) for x in ids], "individual_id string")
    assert M.detect_version(ask("A", "B"), rows).first()["version"] == "v3.0"
    assert M.detect_version(ask("A"), rows).first()["version"] == "v1.0"
    assert M.detect_version(ask("Q"), rows).first() is None


def test_lookup_prefers_individuals_then_the_first_release(spark):
    rows, events, bridge = ready(spark, [("x", "A"), ("B", "C")], [("q", "B"), ("x", "A2")])
    assert tuple(K.resolve(rows, "B").first()) == ("B", "individual_id")
    assert tuple(K.resolve(rows, "x").first()) == ("A2", "genetic_id")
    assert K.resolve(rows, "none").first() is None
    assert K.rows_of(rows, K.resolve(rows, "A")).count() == 2
    assert plain(K.renames_of(events, bridge, K.resolve(rows, "A")), "mid_old", "mid_new", "via_genetic_id") == [("A", "A2", "x")]
    assert K.flags(2, 3, "genetic_id", True, True) == ["present_in_2_of_3_versions", "matched_via_genetic_id", "multi_row", "individual_id_renamed"]


def test_translation(spark):
    rows, _, bridge = ready(spark, [("x", "A"), ("y", "A")], [("x", "B"), ("a", "B"), ("a", "B"), ("", "B")])
    old, new = rows.where("supply_pos = 0"), rows.where("supply_pos = 1")
    ids = spark.createDataFrame([("A",), ("none",), ("A",)], "individual_id string")
    assert plain(K.translate_individuals(ids, bridge, "v1.0", new), "individual_id", "genetic_id") == [("A", ""), ("none", None)]
    keys = spark.createDataFrame([("y",), ("none",)], "genetic_id string")
    assert plain(K.translate_keys(keys, old, new), "genetic_id", "genetic_ids") == [("none", []), ("y", ["a", "a", "x"])]


def test_labels_are_valid_lifted_or_lost(spark):
    rows = frame(spark, [("a", "A", "X_Y"), ("b", "B", "Z.AG")], [("a", "A", "X_Y")])
    asked = spark.createDataFrame(list(enumerate(["X_Y", "Patterson_X_Y.DG", "Z", "X_Y"])), "pos int, group_id string")
    got = [tuple(r) for r in K.validate_labels(asked, rows, ["v1.0", "v2.0"]).orderBy("pos").collect()]
    both = ["v1.0", "v2.0"]
    assert got == [(0, "X_Y", "valid", None, both), (1, "Patterson_X_Y.DG", "lifted", "X_Y", both), (2, "Z", "unresolvable", None, []), (3, "X_Y", "valid", None, both)]


@pytest.mark.parametrize(("kept", "state"), [(99, "pass"), (95, "warn"), (70, "fail"), (100, "pass")])
def test_turnover_gates(spark, kept, state):
    rows, _, bridge = ready(spark, [(f"g{k}", f"I{k}") for k in range(100)], [(f"g{k}", f"I{k}") for k in range(kept)])
    pairs = D.paired(rows.where("supply_pos = 0"), rows.where("supply_pos = 1"))
    assert G.turnover(D.rates(pairs)).first()["state"] == state
    labels = M.union_of_individuals(rows, bridge, "v2.0")
    wide = M.manifest(labels, rows, L.library_tokens(rows), ["v1.0", "v2.0"])
    gate = G.cohort_turnover(wide, ["v1.0", "v2.0"]).first()
    assert (gate["state"], round(gate["removal_rate"], 2)) == (state, (100 - kept) / 100)


def test_other_gates(spark):
    rows, _, bridge = ready(spark, [("a", "A")])
    cohort = lambda ids: spark.createDataFrame([(k, x, None) for k, x in enumerate(ids)], "pos int, individual_id string, cohort_label string")
    wide = lambda c: M.manifest(M.labelled(c, bridge, "v1.0"), rows, L.library_tokens(rows), ["v1.0"])
    for ids, state in ((["A"], "pass"), (["A", "x", "y"], "warn"), (["A", "x", "y", "z", "w"], "fail"), ([], "pass")):
        c = cohort(ids)
        assert G.cohort_coverage(c, wide(c), bridge, "v1.0").first()["state"] == state
    assert G.cohort_turnover(wide(cohort(["A"])), ["v1.0"]).count() == 0
    changes = spark.createDataFrame([("substantive_regroup",)] * 3 + [("partial",)], "change_class string")
    assert [G.substantive_regroup(changes, t).first()["state"] for t in (None, 3, 2)] == ["pass", "pass", "fail"]
    assert plain(G.presence_histogram(wide(cohort(["A", "x"]))), "status", "n_rows") == [("not_in_any_supplied_version", 1), ("present_all", 1)]


def test_components_on_the_driver_and_by_stars(spark):
    import random

    from snapweave.operators.components import largest_members, united

    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(70, 80)]
    df = spark.createDataFrame(edges, "a int, b int")
    few = {tuple(r) for r in largest_members(df).collect()}
    assert few == {tuple(r) for r in largest_members(df, few=0).collect()}
    nodes = sorted({x for e in edges for x in e})
    one = spark.createDataFrame([(nodes, edges)], "nodes array<int>, edges array<struct<a:int,b:int>>").select(united("nodes", "edges").alias("roots")).first()["roots"]
    assert {(x, r) for x, r in zip(nodes, one, strict=True) if x in {n for n, _ in few}} == few


def test_large_individuals_get_the_same_tokens(spark):
    from snapweave.operators import libraries as L

    rows = [("i0", f"v{v}.0", v, f"S{k}{'' if v < 1 else '.AG'}") for v in range(3) for k in range(12)] + [("i1", "v0.0", 0, "X.DG"), ("i1", "v1.0", 1, "Y.DG"), ("i2", "v2.0", 2, "Z"), ("i2", "v2.0", 2, "Z")]
    df = spark.createDataFrame(rows, "canonical string, version string, version_rank int, genetic_id string").withColumn("individual_id", F.col("canonical"))
    want = sorted(L.library_tokens(df).collect())
    assert sorted(L.library_tokens(df, few=4).collect()) == sorted(L.library_tokens(df, few=0).collect()) == want and len(want) == 39
