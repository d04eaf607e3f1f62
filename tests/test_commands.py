import json
import warnings

import pytest
from files import sample, three_releases, write_release

from snapweave import api, cli
from snapweave.errors import CollisionError


@pytest.fixture(autouse=True)
def quiet():
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        yield


@pytest.fixture
def paths(tmp_path):
    return three_releases(tmp_path)


def tsv(path):
    head, *rows = [line.split("\t") for line in path.read_text().splitlines()]
    return [dict(zip(head, r, strict=True)) for r in rows]


def test_diff(spark, paths, tmp_path, capsys):
    out, report, side = tmp_path / "d.json", tmp_path / "r.tsv", tmp_path / "s.json"
    assert cli.main(["diff", *paths[:2], "-o", str(out), "--report", str(report), "--report-json", str(side)]) == 0
    d = json.loads(out.read_text())
    assert (d["shared_individuals"], d["added"]["count"], d["removed"], d["genetic_id_renamed"]) == (3, 0, {"count": 0, "rate": 0.0}, {"count": 1})
    assert [e["via_genetic_id"] for e in d["master_id_renamed"]["events"]] == ["Hunter.DG", "Hunter_b.DG"]
    regroup = d["group_changed"]["events_substantive_regroup"]
    assert regroup == [{"individual_id": "Hunter", "group_v_old": "Coast_Hunter.DG", "group_v_new": "Coast_Late.DG"}, {"individual_id": "P4", "group_v_old": "Other_Pop", "group_v_new": "Test_Pop"}]
    assert [r["event_class"] for r in tsv(report)] == ["genetic_id_renamed", "master_id_renamed", "master_id_renamed", "group_changed:substantive_regroup", "group_changed:substantive_regroup"]
    assert '"v_old_gids": ["P5.SG"]' in report.read_text()
    s = json.loads(side.read_text())
    assert (s["schemas_detected"], s["bridge"]["auto_count"], s["gates"]["turnover"]) == ({"v54.1": "C", "v62.0": "D"}, 2, "pass")
    assert "Wrote d.json (JSON)" in capsys.readouterr().out


def test_diff_to_stdout_and_its_gates(spark, paths, capsys):
    assert cli.main(["--quiet", "diff", paths[0], paths[1], "--tsv", "--substantive-regroup-fail", "1"]) == 1
    got = capsys.readouterr()
    assert got.out.startswith("event_class\tindividual_id\tdetails\n") and "substantive regroup gate (fail): 2" in got.err
    assert cli.main(["--quiet", "diff", paths[0], paths[1], "--all-events", "--turnover-warn", "0"]) == 0
    got = capsys.readouterr()
    d = json.loads(got.out)
    assert d["genetic_id_renamed"]["events"] == [{"individual_id": "P5", "v_old_gids": ["P5.SG"], "v_new_gids": ["P5.DG"]}]
    assert "sample turnover gate (warn)" in got.err


def test_sides_may_share_a_label(spark, paths, capsys):
    assert cli.main(["--quiet", "--version-label", "v1.0", "diff", paths[0], paths[0]]) == 0
    assert json.loads(capsys.readouterr().out)["shared_individuals"] == 3


def test_join_holds_every_individual(spark, paths, tmp_path, capsys):
    out = tmp_path / "j.tsv"
    assert cli.main(["join", paths[0], paths[1], "-o", str(out)]) == 0
    rows = [(r["individual_id_canonical"], r["library_token"], r["status"]) for r in tsv(out)]
    assert rows == [
        ("Hunter", "Hunter.DG", "present_all"), ("Hunter", "Hunter_b.DG", "present_all"), ("Hunter", "K7.AG", "present_all"), ("P4", "P4.DG", "present_all"), ("P5", "P5.DG", "added_after_v54_1"), ("P5", "P5.SG", "removed_before_v62_0"),
    ]
    assert "persistent_genetic_id" not in tsv(out)[0]
    assert capsys.readouterr().out == f"Wrote 6 rows (3 individuals) to {out}\n"
    assert cli.main(["join", paths[0], paths[1], "-o", str(out), "--collapse-to-individual"]) == 0
    assert "WARNING: Hunter: 1 libraries dropped during --collapse-to-individual: ['Hunter_b.DG']" in capsys.readouterr().err
    assert cli.main(["--version-label", "v1.0", "join", paths[0], paths[1], "-o", str(out)]) == 4


def test_cohort_across_three_releases(spark, paths, tmp_path, capsys):
    cohort, out, side = tmp_path / "c.tsv", tmp_path / "m.tsv", tmp_path / "s.json"
    cohort.write_text("individual_id\tcohort_label\nK7\tcoast\nP5\nnobody\tcoast\n")
    assert cli.main(["cohort", str(cohort), "--anno-files", *paths, "-o", str(out), "--report-json", str(side), "--turnover-fail", "0.9"]) == 0
    rows = tsv(out)
    assert [(r["cohort_label"], r["library_token"]) for r in rows] == [("P5", "P5.AG"), ("P5", "P5.DG"), ("P5", "P5.SG"), ("coast", "Hunter.AG"), ("coast", "Hunter.DG"), ("coast", "Hunter_b.DG"), ("coast", "nobody")]
    k7 = rows[3]
    assert [k7[f"v{v}_genetic_id"] for v in ("54_1", "62_0", "66_0")] == ["K7", "K7.AG", "Hunter.AG"]
    assert (k7["persistent_genetic_id"], rows[6]["v54_1_genetic_id"], rows[6]["status"]) == ("33", "--", "not_in_any_supplied_version")
    assert k7["group_id_change_class_v54_1_to_v62_0"] == "substantive_regroup"
    s = json.loads(side.read_text())["cohort"]
    assert (s["n_individuals"], s["n_libraries"], s["n_resolved_in_latest"], s["label_source_histogram"]) == (3, 7, 2, {"direct": 7})
    text = capsys.readouterr().out
    assert "Cohort input: c.tsv (3 individuals)" in text and "Wrote m.tsv (7 rows × 17 cols)" in text


def test_cohort_collapsed_as_json(spark, paths, tmp_path):
    cohort, out = tmp_path / "c.tsv", tmp_path / "m.json"
    cohort.write_text("K7\n")
    for preference, want in (("AG,DG,SG", "Hunter.AG"), ("DG,AG,SG,HO", "Hunter.DG")):
        assert cli.main(["--quiet", "cohort", str(cohort), "--anno-files", *paths, "-o", str(out), "--json", "--collapse-to-individual", "--gid-preference", preference]) == 0
        (row,) = json.loads(out.read_text())
        assert (row["library_token"], row["per_version_gid"]["v66.0"], row["cohort_label"]) == ("Hunter", want, "Hunter")
        assert set(row["per_pair_group_change_class"]) == {"v54.1__to__v62.0", "v62.0__to__v66.0"}


def test_cohort_gates_and_detection(spark, paths, tmp_path):
    cohort, out = tmp_path / "c.tsv", tmp_path / "m.tsv"
    cohort.write_text("K7\nx\ny\nz\nw\n")
    run = lambda *more: cli.main(["--quiet", "cohort", str(cohort), "--anno-files", *paths, "-o", str(out), *more])
    assert run() == 1 and out.exists()
    assert run("--cohort-coverage-fail", "0.1") == 0
    cohort.write_text("x\ny\n")
    assert run() == 4
    assert run("--cohort-version", "v54.1", "--cohort-coverage-fail", "0") == 0
    assert [r["status"] for r in tsv(out)] == ["not_in_any_supplied_version"] * 2


def test_lookup(spark, paths, capsys):
    assert cli.main(["lookup", "K7", "--anno-files", *paths, "--json"]) == 0
    d = json.loads(capsys.readouterr().out)
    assert (d["individual_id_canonical"], d["matched_via"], list(d["per_version"])) == ("Hunter", "individual_id", ["v54.1", "v62.0", "v66.0"])
    assert [e["via_genetic_id"] for e in d["master_id_bridge"]] == ["Hunter.DG"]
    assert d["status_flags"] == ["present_in_3_of_3_versions", "multi_row", "individual_id_renamed"]
    assert cli.main(["lookup", "P3.SG", "--anno-files", *paths]) == 0
    assert "matched_via:                 genetic_id" in capsys.readouterr().out
    assert cli.main(["lookup", "zz", "--anno-files", paths[0], "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["status_flags"] == ["not_found"]


def test_schema(spark, paths, capsys):
    assert cli.main(["schema", paths[1]]) == 0
    text = capsys.readouterr().out
    assert "schema_class:        D" in text and "  - coverage_1240k" in text
    assert cli.main(["schema", paths[1], "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["fields"]["group_id"] == {"column": 14, "base_column": None}


def test_validate_groups(spark, paths, capsys):
    assert cli.main(["validate-groups", "Test_Pop", "Patterson_Test_Pop", "--anno-files", *paths, "--json"]) == 0
    items = json.loads(capsys.readouterr().out)
    assert [i["status"] for i in items] == ["valid", "lifted"] and items[0]["found_in"] == ["v54.1", "v62.0", "v66.0"]
    assert cli.main(["validate-groups", "Nope", "Patterson_Test_Pop", "--anno-files", *paths]) == 1
    err = capsys.readouterr().err
    assert "WARNING: group ID 'Patterson_Test_Pop' not found in panel.\n         Suggested lift: 'Test_Pop' (convention_restructure_prefix_drop); found in: v54.1, v62.0, v66.0\n" in err
    assert "WARNING: group ID 'Nope' not found in any supplied panel and no known lift exists.\n" in err and "error: 1 group ID(s) unresolvable: 'Nope'\n" in err


def test_exit_codes(spark, paths, tmp_path, capsys):
    out = str(tmp_path / "o")
    assert cli.main([]) == 4 and capsys.readouterr().err.startswith("usage error: ")
    assert cli.main(["diff", paths[0], str(tmp_path / "none")]) == 4
    assert cli.main(["--mid-bridge", str(tmp_path / "none"), "join", paths[0], paths[1], "-o", out]) == 2
    (tmp_path / "odd.anno").write_text("a\tb\n1\t2\n")
    assert cli.main(["schema", str(tmp_path / "odd.anno")]) == 3


def test_collisions_and_manual_bridges(spark, tmp_path):
    old = write_release(tmp_path / "x_v54.1_1240K_public.anno", "C", [sample("a", "MA"), sample("b", "MA")])
    new = write_release(tmp_path / "v62.0_1240k_public.anno", "D", [sample("a", "MB"), sample("b", "MC")])
    out, manual = tmp_path / "o.tsv", tmp_path / "b.tsv"
    assert cli.main(["join", old, new, "-o", str(out)]) == 3
    assert cli.main(["--on-mid-collision", "warn", "join", old, new, "-o", str(out)]) == 0
    assert {r["individual_id_canonical"] for r in tsv(out)} == {"MC"}
    manual.write_text("v_old_label\tmid_old\tv_new_label\tmid_new\nv54.1\tMA\tv62.0\tMB\n")
    assert cli.main(["--on-mid-collision", "warn", "--mid-bridge", str(manual), "join", old, new, "-o", str(out)]) == 0
    assert {r["individual_id_canonical"] for r in tsv(out)} == {"MB", "MC"}


def test_library_api(spark, paths):
    files = {"v54.1": paths[0], "v62.0": paths[1]}
    assert api.resolve_master_ids(spark, ["K7", "none"], "v54.1", "v62.0", paths=files) == {"K7": "Hunter.DG", "none": None}
    assert api.resolve_genetic_ids(spark, ["K7", "none"], "v54.1", "v62.0", paths=files) == {"K7": ["Hunter.DG", "Hunter_b.DG", "K7.AG"], "none": []}
    with pytest.raises(KeyError):
        api.resolve_master_ids(spark, [], "v54.1", "v9.9", paths=files)
    with pytest.raises(ValueError, match="releases or paths"):
        api.resolve_master_ids(spark, [], "a", "b")
    assert issubclass(CollisionError, Exception)


def test_folders_hold_the_same_cells(spark, tmp_path):
    from snapweave.plans.render import write_folder, write_tsv

    rows = spark.createDataFrame([("a", None, 1), ("", ' "q', None), ("b\\", "x", 3)], "s string, t string, n long")
    write_tsv(rows, ["s", "t", "n"], str(tmp_path / "one.tsv"))
    write_folder(rows.coalesce(1), ["s", "t", "n"], str(tmp_path / "many"))
    (part,) = (tmp_path / "many").glob("part-*")
    assert part.read_text() == (tmp_path / "one.tsv").read_text()
    write_folder(rows.coalesce(1), ["s", "n"], str(tmp_path / "json"), as_json=True)
    (part,) = (tmp_path / "json").glob("part-*")
    assert [json.loads(x) for x in part.read_text().splitlines()] == [{"s": "a", "n": 1}, {"s": "", "n": None}, {"s": "b\\", "n": 3}]
