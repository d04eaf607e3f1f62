"""The six commands: each reads releases, runs operators, writes what was asked for, and then judges."""

from __future__ import annotations

import json
import sys
import time
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import UsageError, ValidationFailure
from ..functions.labels import CHANGE_CLASSES
from ..operators import diff as D
from ..operators import gates as G
from ..operators import libraries as L
from ..operators import lookup as K
from ..operators import manifest as M
from ..operators import summaries as S
from ..runtime import written
from ..sources.releases import Release, cohort_frame, ensure_unique_labels, read_cohort, read_release
from . import render as R
from .session import Bridged, bridged

@dataclass
class Options:
    """What all commands share."""

    layout: str | None = None
    label: str | None = None
    manual_bridge: str | None = None
    on_collision: str = "error"
    quiet: bool = False
    notes: list[str] = field(default_factory=list)

    def warn(self, text: str) -> None:
        self.notes.append(text)
        sys.stderr.write(R.WARNING.format(text=text) + "\n")


def load(spark: SparkSession, paths: Sequence[str], opts: Options) -> list[Release]:
    return [read_release(spark, p, label=opts.label, layout=opts.layout) for p in paths]


def prepare(spark: SparkSession, releases: list[Release], opts: Options) -> Bridged:
    ready = bridged(spark, releases, opts.on_collision, opts.manual_bridge)
    for note in ready.warnings:
        opts.warn(note)
    ready.samples = written(ready.samples)
    return ready


def sidecar(path: str, ready: Bridged, kind: str, block: dict, gates: dict, config: dict, opts: Options, began: float) -> None:
    payload = {
        "versions_supplied": ready.versions,
        "schemas_detected": {r.label: r.layout.name for r in ready.releases},
        "bridge": {"auto_count": ready.events.count(), "manual_count": ready.manual_count, "collisions": []},
        kind: block,
        "gates": gates,
        "warnings": opts.notes,
        "config": config,
        "elapsed_seconds": time.perf_counter() - began,
    }
    Path(path).write_text(json.dumps(payload, indent=2) + "\n", encoding="utf-8")


def verdict(failed: list[str]) -> None:
    if failed:
        raise ValidationFailure("; ".join(failed))


def cohort(
    spark: SparkSession, cohort_path: str, paths: Sequence[str], out: str, opts: Options, cohort_version: str | None = None, as_json: bool = False, collapse: bool = False, preference: Sequence[str] = L.PREFERENCE,
    turnover: tuple[float, float] = G.TURNOVER, coverage: tuple[float, float] = G.COVERAGE, report_json: str | None = None, propagate: bool = True,
) -> str:
    """A manifest of a cohort's individuals across all releases; returns the summary text.

    The libraries of the cohort's individuals alone are built. Labels are those
    of the cohort file whether ``propagate`` is set or not.
    """
    began = time.perf_counter()
    ready = prepare(spark, load(spark, paths, opts), opts)
    wanted = read_cohort(spark, cohort_path)
    asked = cohort_frame(spark, wanted)
    if cohort_version is None:
        best = M.detect_version(asked, ready.samples).collect()
        if not best:
            raise UsageError("no release shares an individual id with the cohort file; name its release with --cohort-version")
        cohort_version = best[0]["version"]
    ensure_unique_labels(ready.releases)
    labels = M.labelled(asked, ready.bridge, cohort_version, known=cohort_version in ready.versions)
    own = ready.samples.join(labels.select("canonical"), "canonical", "left_semi")
    tokens = written(L.library_tokens(own))
    rows = written(M.manifest(labels, ready.samples, tokens, ready.versions, collapse, preference))
    if collapse:
        _warn_dropped(tokens, preference, opts)
    n_rows, n_cols = _write_manifest(rows, ready.versions, out, as_json)

    failed: list[str] = []
    pairs = [r.asDict() for r in G.cohort_turnover(rows, ready.versions, *turnover).orderBy("seq").collect()]
    covered = G.cohort_coverage(asked, rows, ready.bridge, cohort_version, *coverage).first()
    for state, text in [*((r["state"], R.turnover_message(r, *turnover)) for r in pairs), (covered["state"], R.coverage_message(covered, *coverage))]:
        if state == "warn":
            opts.warn(text)
        elif state == "fail":
            failed.append(text)

    severity = {"pass": 0, "warn": 1, "fail": 2}  # a few pairs, already here
    worst = max(pairs, key=lambda r: severity[r["state"]], default=None)
    n = S.cohort_counts(rows, ready.versions).first()
    by_class = {r["change_class"]: r["n_events"] for r in S.cohort_changes(rows, ready.versions).orderBy("ord").collect()}
    if report_json:
        count_by = lambda c: {r["value"]: r["n_rows"] for r in S.histogram(rows, c).orderBy("value").collect()}
        block = {
            "n_individuals": n["n_individuals"], "n_libraries": n_rows, "n_resolved_in_latest": n["n_resolved_in_latest"], "n_added_after_earliest": n["n_added_after_earliest"], "n_removed_before_latest": n["n_removed_before_latest"],
            "label_source_histogram": count_by("cohort_label_source"), "status_histogram": count_by("status"), "group_change_by_class": by_class,
        }
        states = {"turnover": worst["state"] if worst else "n/a", "turnover_rate": worst["removal_rate"] if worst else 0.0, "cohort_coverage": covered["state"], "cohort_coverage_rate": covered["coverage"]}
        config = {
            "turnover_warn": turnover[0], "turnover_fail": turnover[1], "cohort_coverage_warn": coverage[0], "cohort_coverage_fail": coverage[1], "no_propagate": not propagate, "collapse_to_individual": collapse,
            "gid_preference": list(preference), "output_format": "json" if as_json else "tsv",
        }
        sidecar(report_json, ready, "cohort", block, states, config, opts, began)
    closing = [R.WROTE_ROWS.format(name=Path(out).name, rows=n_rows, cols=n_cols)]
    closing += [R.COHORT_TURNOVER.format(rate=R.percent(worst["removal_rate"]), state=worst["state"].upper())] if worst else []
    text = R.blocks(
        R.files_block(ready.releases),
        R.bridge_block(ready.events.count(), ready.manual_count),
        [line.format(name=Path(cohort_path).name, n=len(wanted), latest=n["n_resolved_in_latest"], added=n["n_added_after_earliest"], removed=n["n_removed_before_latest"]) for line in R.COHORT],
        R.class_block(by_class, ready.versions),
        closing,
        [R.DONE.format(seconds=time.perf_counter() - began)],
    )
    if not opts.quiet:
        sys.stdout.write(text)
    verdict(failed)
    return text


def _warn_dropped(tokens, preference: Sequence[str], opts: Options) -> None:
    """A warning per individual whose other libraries are preferred in every release."""
    lost = L.dropped_tokens(tokens, L.collapsed(tokens, preference)).groupBy("canonical").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    for r in lost.orderBy("canonical").toLocalIterator():
        opts.warn(R.DROPPED.format(canonical=r["canonical"], n=len(r["tokens"]), tokens=list(r["tokens"])))


def _write_manifest(rows, versions: list[str], out: str, as_json: bool) -> tuple[int, int]:
    ordered = M.ordered(rows)
    if as_json:
        return R.write_manifest_json(ordered, versions, out), 9
    columns = R.manifest_columns(rows, R.has_pgid(rows))
    return R.write_tsv(ordered, columns, out), len(columns)


def join(spark: SparkSession, old: str, new: str, out: str, opts: Options, as_json: bool = False, collapse: bool = False, preference: Sequence[str] = L.PREFERENCE) -> int:
    """Every individual of either release, side by side; returns the number of rows."""
    ready = prepare(spark, load(spark, [old, new], opts), opts)
    ensure_unique_labels(ready.releases)
    labels = M.union_of_individuals(ready.samples, ready.bridge, ready.versions[-1])
    tokens = written(L.library_tokens(ready.samples))
    rows = written(M.manifest(labels, ready.samples, tokens, ready.versions, collapse, preference))
    n_rows = _write_manifest(rows, ready.versions, out, as_json)[0]
    if not opts.quiet:
        sys.stdout.write(R.JOINED.format(rows=n_rows, individuals=S.cohort_counts(rows, ready.versions).first()["n_individuals"], path=out) + "\n")
    if collapse:
        _warn_dropped(tokens, preference, opts)
    return n_rows


def diff(
    spark: SparkSession, old: str, new: str, opts: Options, out: str | None = None, as_tsv: bool = False, include: Sequence[str] = (), all_events: bool = False, turnover: tuple[float, float] = G.TURNOVER,
    regroup_fail: int | None = None, report: str | None = None, report_json: str | None = None,
) -> dict | str:
    """What changed from one release to the other; returns the JSON object or the TSV text."""
    began = time.perf_counter()
    if unknown := set(include) - set(CHANGE_CLASSES):
        raise UsageError(f"no such class of group change: {', '.join(sorted(unknown))}")
    a, b = load(spark, [old, new], opts)
    ready = prepare(spark, [a, b], opts)
    # Sides are told apart by place, as labels may be equal.
    pairs = D.paired(ready.samples.where("supply_pos = 0"), ready.samples.where("supply_pos = 1"))
    pairs = written(pairs)
    renames = D.mid_renamed(ready.events, ready.bridge, a.label, b.label)
    renames = written(renames)
    changes = D.group_changed(pairs)
    counts = S.diff_counts(pairs, renames).first().asDict()
    n = D.rates(pairs).first().asDict() | counts
    n["by_class"] = {c: counts[f"group_changed_{c}"] for c in CHANGE_CLASSES}
    events = D.report(pairs, renames)
    if as_tsv:
        result: dict | str = R.report_text(events)
        text = result
    else:
        size = R.predicted_bytes(n["n_added"] + n["n_removed"] + n["n_gid_renamed"] + n["n_mid_renamed"] + sum(n["by_class"].values()))
        if all_events and size > R.BIG_JSON:
            opts.warn(R.TOO_BIG.format(size=size / 1024**2, limit=R.BIG_JSON / 1024**2))
        shown = {f"group_changed:{c}" for c in (CHANGE_CLASSES if all_events else {*include, "substantive_regroup"})} | {"master_id_renamed"} | ({"added", "removed", "genetic_id_renamed"} if all_events else set())
        told: dict[str, list[dict]] = defaultdict(list)
        for kind, iid, details in R.report_rows(events.where(F.col("event_class").isin(*shown))):
            d = json.loads(details)
            told[kind].append(d if kind == "master_id_renamed" else {"individual_id": iid, **d})
        result = R.diff_object(a, b, n, told, set(include), all_events)
        text = json.dumps(result, indent=2) + "\n"
    if out:
        Path(out).write_text(text, encoding="utf-8")
    else:
        sys.stdout.write(text)

    failed: list[str] = []
    gate = G.turnover(D.rates(pairs), *turnover).first()
    message = R.turnover_message({**gate.asDict(), "v_old": a.label, "v_new": b.label}, *turnover)
    if gate["state"] == "warn":
        opts.warn(message)
    elif gate["state"] == "fail":
        failed.append(message)
    regroup = G.substantive_regroup(changes, regroup_fail).first()
    if regroup["state"] == "fail":
        failed.append(R.regroup_message(regroup, regroup_fail))
    if report:
        R.write_report_tsv(events, report)
    if report_json:
        block = {"added": n["n_added"], "removed": n["n_removed"], "genetic_id_renamed": n["n_gid_renamed"], "master_id_renamed": n["n_mid_renamed"], "group_change_by_class": n["by_class"]}
        states = {"turnover": gate["state"], "turnover_rate": gate["removal_rate"], "substantive_regroup": regroup["state"], "substantive_regroup_count": regroup["n_events"]}
        config = {"turnover_warn": turnover[0], "turnover_fail": turnover[1], "substantive_regroup_fail": regroup_fail, "include_class": list(include), "all_events": all_events, "output_format": "tsv" if as_tsv else "json"}
        sidecar(report_json, ready, "diff", block, states, config, opts, began)
    mode = "TSV" if as_tsv else "JSON"
    summary = R.blocks(
        R.files_block([a, b]),
        R.bridge_block(ready.events.count(), ready.manual_count),
        [line.format(**n) for line in R.EVENTS],
        R.class_block(n["by_class"], [a.label, b.label]),
        [R.WROTE.format(name=Path(out).name, mode=mode) if out else R.EMITTED.format(mode=mode), R.DIFF_TURNOVER.format(rate=R.percent(gate["removal_rate"]), state=gate["state"].upper()), R.DIFF_REGROUP.format(state=regroup["state"].upper())],
        [R.DONE.format(seconds=time.perf_counter() - began)],
    )
    if not opts.quiet:
        (sys.stdout if out else sys.stderr).write(summary)
    verdict(failed)
    return result


def lookup(spark: SparkSession, query: str, paths: Sequence[str], opts: Options) -> dict:
    """Where an individual is found, by its id or a row key."""
    if not paths:
        return {"query": query, "individual_id_canonical": None, "matched_via": "not_found", "master_id_bridge": [], "per_version": {}, "status_flags": []}
    releases = load(spark, paths, opts)
    ensure_unique_labels(releases)
    ready = prepare(spark, releases, opts)
    hit = written(K.resolve(ready.samples, query))
    found = hit.first()
    if found is None:
        return {"query": query, "individual_id_canonical": None, "matched_via": "not_found", "master_id_bridge": [], "per_version": {}, "status_flags": ["not_found"]}
    per: dict[str, list[dict]] = {}
    for r in K.rows_of(ready.samples, hit).orderBy("supply_pos", "row_idx").collect():
        per.setdefault(r["version"], []).append({k: r[k] for k in ("genetic_id", "individual_id", "group_id", "snps_hit_1240k", "persistent_genetic_id")})
    events = [
        {"v_old_label": r["v_old"], "mid_old": r["mid_old"], "v_new_label": r["v_new"], "mid_new": r["mid_new"], "via_genetic_id": r["via_genetic_id"]}
        for r in K.renames_of(ready.events, ready.bridge, hit).collect()
    ]
    order = {v: k for k, v in enumerate(ready.versions)}
    events.sort(key=lambda e: (order.get(e["v_old_label"], -1), e["via_genetic_id"]))
    flags = K.flags(len(per), len(releases), found["matched_via"], any(len(x) > 1 for x in per.values()), bool(events))
    return {"query": query, "individual_id_canonical": found["canonical"], "matched_via": found["matched_via"], "master_id_bridge": events, "per_version": per, "status_flags": flags}


def schema(spark: SparkSession, path: str, opts: Options) -> Release:
    return read_release(spark, path, label=opts.label, layout=opts.layout)


def validate_groups(spark: SparkSession, group_ids: Sequence[str], paths: Sequence[str], opts: Options) -> list[dict]:
    """Per label, in order, whether a release has it or its lifted form. Judging is the caller's."""
    from ..sources.releases import samples_of

    asked = spark.createDataFrame(list(enumerate(group_ids)), "pos int, group_id string")
    releases = load(spark, paths, opts)
    found = K.validate_labels(asked, samples_of(releases), [r.label for r in releases]).orderBy("pos").collect()
    return [{"group_id": r["group_id"], "status": r["status"], "lifted_to": r["lifted_to"], "found_in": list(r["found_in"])} for r in found]
