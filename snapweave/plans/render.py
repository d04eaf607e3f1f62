"""Results as files and text. Rows are streamed from Spark, one partition at a time."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import CHANGE_CLASSES
from ..operators.manifest import prefix

# What commands print and write.
MISSING = "--"
REPORT_COLUMNS = ("event_class", "individual_id", "details")
TURNOVER = "sample turnover gate ({state}): {v_old} -> {v_new}: removed {rate} (warn={warn}, fail={fail})"
REGROUP = "substantive regroup gate ({state}): {n} substantive_regroup events exceeds threshold of {threshold}"
COVERAGE = "cohort coverage gate ({state}): {resolved}/{requested} resolved ({rate}; warn<{warn}, fail<{fail})"
LOADED = "Loaded {n} .anno file(s):"
FILE = "  [{label}] {name}: {rows:,} rows × {cols} cols, class {layout}"
BRIDGE = (
    "Cross-version bridge:",
    "  GID-stable MID-rename detection:  {events} events",
    "  Manual --mid-bridge entries:      {manual}",
    "  Cross-lab MID collision check:    no collisions detected",
)
CHANGES = "Group ID changes ({first} → {last}):"
COHORT = (
    "Cohort input: {name} ({n} individuals)",
    "  Resolved in latest version:  {latest}",
    "  Added after earliest:        {added}",
    "  Removed before latest:       {removed}",
)
EVENTS = (
    "Diff events:",
    "  added:                {n_added}",
    "  removed:              {n_removed}",
    "  genetic_id_renamed:   {n_gid_renamed}",
    "  master_id_renamed:    {n_mid_renamed}",
)
WROTE_ROWS = "Wrote {name} ({rows} rows × {cols} cols)"
WROTE, EMITTED = "Wrote {name} ({mode})", "Emitted {mode} to stdout"
COHORT_TURNOVER = "Sample turnover within cohort: {rate} — {state}"
DIFF_TURNOVER = "Sample turnover: {rate} — {state}"
DIFF_REGROUP = "Substantive regroup gate: {state}"
DONE = "Done in {seconds:.1f}s."
JOINED = "Wrote {rows} rows ({individuals} individuals) to {path}"
DROPPED = "{canonical}: {n} libraries dropped during --collapse-to-individual: {tokens}"
BIG_JSON = 100 * 1024 * 1024
TOO_BIG = "predicted JSON size {size:.1f} MB exceeds {limit:.0f} MB; prefer --tsv for large diffs."
LIFTED = "group ID '{group_id}' not found in panel.\n         Suggested lift: '{lifted_to}' (convention_restructure_prefix_drop); found in: {found_in}"
UNKNOWN = "group ID '{group_id}' not found in any supplied panel and no known lift exists."
UNRESOLVABLE = "{n} group ID(s) unresolvable: {ids}"
WARNING, ERROR, USAGE = "WARNING: {text}", "error: {text}", "usage error: {text}"
SCHEMA = ("path:                {path}", "version (inferred):  {label}", "schema_class:        {layout}")
SCHEMA_VARIANT = "column_layout:       {variant} (header-detected)"
SCHEMA_SIZE = ("n_rows:              {rows:,}", "n_columns:           {columns}", "detection_signature: (ncols={columns}, col0={first!r}, col1={second!r})")
SCHEMA_FIELDS, SCHEMA_ABSENT = "mapped canonical fields:", "fields NOT present in this class:"
SCHEMA_FIELD, SCHEMA_MOVED, SCHEMA_NONE = "  col {column:2d}  {name:<32}  {header}", "  [{variant} layout; base col {base}]", "  - {name}"
LOOKUP = ("query:                       {query}", "individual_id (canonical):   {individual_id_canonical}", "matched_via:                 {matched_via}")
LOOKUP_NONE = ("  query {query!r} did not match any individual_id or genetic_id in", "  the supplied .anno files.")
LOOKUP_RENAMES, LOOKUP_RENAME, LOOKUP_FLAGS = "master_id_bridge:", "  {v_old_label}={mid_old!r} -> {v_new_label}={mid_new!r} [via {via_genetic_id!r}]", "status: {flags}"


def cell(value) -> str:
    """A value as text; only what is missing becomes the sentinel, the empty text stays."""
    return MISSING if value is None or value != value else str(value)


def manifest_columns(rows: DataFrame, with_pgid: bool) -> list[str]:
    return [c for c in rows.columns if c != "persistent_genetic_id" or with_pgid]


def has_pgid(rows: DataFrame) -> bool:
    return not rows.where("persistent_genetic_id is not null").isEmpty()


def write_tsv(rows: DataFrame, columns: Iterable[str], path: str) -> int:
    """One file with a header and a line a row; returns the number of rows."""
    names, n = list(columns), 0
    with Path(path).open("w", encoding="utf-8") as out:
        out.write("\t".join(names) + "\n")
        for r in rows.select(*[f"`{c}`" for c in names]).toLocalIterator():
            out.write("\t".join(map(cell, r)) + "\n")
            n += 1
    return n


def manifest_object(r, versions: list[str]) -> dict:
    per = lambda name: {v: r[f"{prefix(v)}_{name}"] for v in versions}
    return {
        "cohort_label": r["cohort_label"],
        "cohort_label_source": r["cohort_label_source"],
        "individual_id_canonical": r["individual_id_canonical"],
        "library_token": r["library_token"],
        "per_version_gid": per("genetic_id"),
        "per_version_group_id": per("group_id"),
        "per_version_snps_hit_1240k": per("snps_hit_1240k"),
        "per_pair_group_change_class": {f"{a}__to__{b}": r[f"group_id_change_class_{prefix(a)}_to_{prefix(b)}"] for a, b in zip(versions, versions[1:], strict=False)},
        "persistent_genetic_id": r["persistent_genetic_id"],
        "status": r["status"],
    }


def write_manifest_json(rows: DataFrame, versions: list[str], path: str) -> int:
    """A JSON array, written object by object."""
    n = 0
    with Path(path).open("w", encoding="utf-8") as out:
        for r in rows.toLocalIterator():
            text = json.dumps(manifest_object(r, versions), indent=2)
            out.write((",\n" if n else "[\n") + "\n".join("  " + line for line in text.split("\n")))
            n += 1
        out.write("\n]\n" if n else "[]\n")
    return n


def report_rows(report: DataFrame) -> Iterable[tuple[str, str, str]]:
    """Events in order, with details as json.dumps writes them."""
    for r in report.orderBy("ord", "seq", "individual_id").toLocalIterator():
        yield r["event_class"], r["individual_id"], json.dumps(json.loads(r["details"]))


def write_report_tsv(report: DataFrame, path: str) -> None:
    with Path(path).open("w", encoding="utf-8") as out:
        out.write("\t".join(REPORT_COLUMNS) + "\n")
        for row in report_rows(report):
            out.write("\t".join(row) + "\n")


def report_text(report: DataFrame) -> str:
    return "".join("\t".join(r) + "\n" for r in [REPORT_COLUMNS, *report_rows(report)])


def predicted_bytes(n_events: int) -> int:
    """A rough size of a diff's JSON with all events."""
    return 150 * n_events + 2048


def diff_summary_line(v_old: str, v_new: str, n: dict) -> str:
    return f"{v_old} -> {v_new}: +{n['n_added']} / -{n['n_removed']} individuals, {n['n_gid_renamed']} re-keyed, {n['n_mid_renamed']} renames seen, {sum(n['by_class'].values())} group changes"


def diff_object(old, new, n: dict, events: dict[str, list[dict]], include: set[str], all_events: bool) -> dict:
    """Counts always; rename and substantive events always; other classes as asked for."""
    if all_events:
        include = set(CHANGE_CLASSES)
    shown = include | {"substantive_regroup"}
    listed = lambda name: {"events": events[name]} if all_events else {}
    return {
        "v_old": old.label,
        "v_old_class": old.layout.name,
        "v_old_n_individuals": n["n_old"],
        "v_new": new.label,
        "v_new_class": new.layout.name,
        "v_new_n_individuals": n["n_new"],
        "shared_individuals": n["n_shared"],
        "added": {"count": n["n_added"], "rate": n["added_rate"], **listed("added")},
        "removed": {"count": n["n_removed"], "rate": n["removal_rate"], **listed("removed")},
        "genetic_id_renamed": {"count": n["n_gid_renamed"], **listed("genetic_id_renamed")},
        "master_id_renamed": {"count": n["n_mid_renamed"], "events": events["master_id_renamed"]},
        "group_changed": {"count": sum(n["by_class"].values()), "by_class": n["by_class"], **{f"events_{c}": events[f"group_changed:{c}"] for c in CHANGE_CLASSES if c in shown}},
        "gates": {},
        "summary": diff_summary_line(old.label, new.label, n),
    }


def percent(rate: float, digits: int = 1) -> str:
    return f"{100 * rate:.{digits}f}%"


def turnover_message(r, warn: float, fail: float) -> str:
    return TURNOVER.format(state=r["state"], v_old=r["v_old"], v_new=r["v_new"], rate=percent(r["removal_rate"]), warn=percent(warn), fail=percent(fail))


def regroup_message(r, threshold: int) -> str:
    return REGROUP.format(state=r["state"], n=r["n_events"], threshold=threshold)


def coverage_message(r, warn: float, fail: float) -> str:
    return COVERAGE.format(state=r["state"], resolved=r["resolved"], requested=r["requested"], rate=percent(r["coverage"]), warn=percent(warn, 0), fail=percent(fail, 0))


def blocks(*parts: list[str]) -> str:
    """Paragraphs of lines; empty ones are left out."""
    return "\n\n".join("\n".join(p) for p in parts if p) + "\n"


def files_block(releases) -> list[str]:
    return [LOADED.format(n=len(releases)), *(FILE.format(label=r.label, name=Path(r.path).name, rows=r.n_rows(), cols=r.n_columns, layout=r.layout.name) for r in releases)]


def bridge_block(n_events: int, n_manual: int) -> list[str]:
    return [line.format(events=n_events, manual=n_manual) for line in BRIDGE]


def class_block(by_class: dict[str, int], versions: list[str]) -> list[str]:
    shown = [f"  {c:34s}  {by_class[c]}" for c in CHANGE_CLASSES if by_class.get(c)]
    return [CHANGES.format(first=versions[0], last=versions[-1]), *shown] if shown else []


def schema_text(release) -> str:
    from ..sources.layouts import displayed

    d, signature = release.describe(), release.layout.signature
    facts = {"path": release.path, "label": release.label, "layout": d["schema_class"], "variant": release.variant, "rows": d["n_rows"], "columns": d["n_columns"], "first": signature[0], "second": signature[1]}
    top = [*SCHEMA, *[SCHEMA_VARIANT] * bool(release.variant), *SCHEMA_SIZE]
    lines = [x.format(**facts) for x in top] + ["", SCHEMA_FIELDS]
    for name, at in sorted(d["fields"].items(), key=lambda kv: kv[1]["column"]):
        k, base = at["column"], at["base_column"]
        header = displayed(release.header[k - 1]) if k <= len(release.header) else ""
        moved = SCHEMA_MOVED.format(variant=release.variant, base=base) if base else ""
        lines.append(SCHEMA_FIELD.format(column=k, name=name, header=header) + moved)
    if d["not_present"]:
        lines += ["", SCHEMA_ABSENT, *(SCHEMA_NONE.format(name=n) for n in d["not_present"])]
    return "\n".join(lines) + "\n"


def lookup_text(found: dict) -> str:
    lines = [x.format(**found) for x in LOOKUP]
    if found["matched_via"] == "not_found":
        return "\n".join([*lines, "", *(x.format(**found) for x in LOOKUP_NONE)]) + "\n"
    if found["master_id_bridge"]:
        lines += [LOOKUP_RENAMES, *(LOOKUP_RENAME.format(**e) for e in found["master_id_bridge"])]
    for version, rows in found["per_version"].items():
        for r in rows:
            parts = [f"genetic_id={r['genetic_id']}", f"group_id={r['group_id']}", *(f"{k}={r[k]}" for k in ("snps_hit_1240k", "persistent_genetic_id") if r[k] is not None)]
            lines.append(f"{version}:".ljust(28) + " ".join(parts))
    return "\n".join([*lines, "", LOOKUP_FLAGS.format(flags="; ".join(found["status_flags"]))]) + "\n"


def write_folder(rows: DataFrame, columns: Iterable[str], path: str, as_json: bool = False) -> None:
    """The same cells as a folder that executors write in parallel: TSV parts with a header each, or a JSON object a line. For tables that aren't to pass the driver."""
    rows = rows.select(*[f"`{c}`" for c in columns])
    if as_json:
        rows.write.option("ignoreNullFields", "false").json(path)
    else:
        text = rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING)).alias(c) for c in rows.columns])
        text.write.csv(path, sep="\t", header=True, quote="\u0000", escape="\u0000", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
