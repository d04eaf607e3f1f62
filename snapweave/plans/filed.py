"""Queries through files: releases and side inputs written as text into the shared folder, read back, and compared in SQL with the rows they came from."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bridge as B
from ..runtime import shared_folder
from ..sources.layouts import LAYOUTS, MOVING_HEADERS, VARIANT
from ..sources.releases import Release, cohort_frame, read_bridge, read_cohort, read_release

#: One file name per class; the variant's file has another release's name than its columns.
NAMES = {"A": "set_v44.3_1240K_public.anno", "B": "set_v52.2_1240K_public.anno", "C": "set_v54.1.p1_1240K_public.anno", "D": "v62.0_1240k_public.anno", "E": "v66.p1.set.PUB.anno", "F": "set_v44.3_HO_public.anno"}
LABELS = {"A": "v44.3", "B": "v52.2", "C": "v54.1", "D": "v62.0", "E": "v66.0", "F": "v44.3"}

#: What the cells of a customer's row say, valid in Spark and in other engines alike.
_CELLS = {
    "genetic_id": "'S' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '' ELSE '.AG' END",
    "persistent_genetic_id": "CASE c_custkey % 4 WHEN 0 THEN '' ELSE CAST(c_custkey AS STRING) END",
    "individual_id": "'I' || CAST(floor(c_custkey / 2) AS BIGINT)",
    "group_id": "CASE c_custkey % 6 WHEN 0 THEN '' ELSE c_mktsegment || '\"_' || c_nationkey END",
    "full_date": "'\"' || c_custkey || ' BP'",
    "date_mean_bp": "CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN c_custkey || '.0' WHEN 2 THEN 'n/a' WHEN 3 THEN c_custkey || '.5' ELSE ' ' || c_custkey || ' ' END",
    "coverage_1240k": "CASE c_custkey % 4 WHEN 0 THEN '..' WHEN 1 THEN (c_custkey % 50) || '.25' WHEN 2 THEN (c_custkey % 50) || 'e1' ELSE 'inf' END",
    "snps_hit_1240k": "CASE c_custkey % 7 WHEN 0 THEN '' ELSE CAST((c_custkey * 37) % 1100000 AS STRING) END",
    "molecular_sex": "CASE c_custkey % 2 WHEN 0 THEN 'M' ELSE 'F' END",
}
#: What the typed fields of that row are.
_DATE = "CASE c_custkey % 5 WHEN 1 THEN c_custkey WHEN 4 THEN c_custkey END"
_COVERAGE = "CASE c_custkey % 4 WHEN 1 THEN (c_custkey % 50)::DOUBLE + 0.25 WHEN 2 THEN (c_custkey % 50)::DOUBLE * 10 WHEN 3 THEN 'inf'::DOUBLE END"
_SNPS = "CASE c_custkey % 7 WHEN 0 THEN NULL ELSE (c_custkey * 37) % 1100000 END"
_PGID = "CASE c_custkey % 4 WHEN 0 THEN NULL ELSE c_custkey END"


def one_file(spark: SparkSession, name: str, head: str, lines: DataFrame) -> str:
    """A text file with a head line and (k, line) in order of k, in a folder of its own; returns its path."""
    folder = f"{shared_folder(spark)}/file-{uuid.uuid4().hex}"
    lines = spark.range(1).select(F.lit(None).cast("long").alias("k"), F.lit(head).alias("line")).union(lines)
    lines.repartition(1).sortWithinPartitions(F.asc_nulls_first("k")).select("line").write.text(folder)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*"))[0].getPath()
    fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
    return f"{folder}/{name}"


def release_file(spark: SparkSession, sf_dir: str, layout: str, variant: str | None = None, name: str | None = None, tail: str = "", cut: str = "false") -> str:
    """A release of the customers in a layout; ``tail`` ends every line, rows for which ``cut`` holds end behind their individual."""
    x = LAYOUTS[layout]
    width = x.widths[0]
    head = [f"_unused_{k}" for k in range(1, width + 1)]
    head[0], head[1] = (s.replace("_", " ").title() + " (made up)" for s in x.signature)
    if variant:
        for field, text in MOVING_HEADERS.items():
            if field in x.columns:
                head[x.column(field, variant) - 1] = text
    at = {x.column(f, variant): text for f, text in _CELLS.items() if f in x.columns}
    cells = [f"({at[k]})" if k in at else "''" for k in range(1, width + 1)]
    last = x.column("individual_id", variant)
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    line = lambda part: F.expr("concat_ws('\t', " + ", ".join(part) + ")")
    lines = rows.select(F.col("c_custkey").cast("long").alias("k"), F.when(F.expr(cut), line(cells[:last])).otherwise(F.concat(line(cells), F.lit(tail))).alias("line"))
    return one_file(spark, name or NAMES[layout], "\t".join(head) + tail, lines)


def _fields(release: Release) -> DataFrame:
    return release.frame.select("version", "schema_class", "genetic_id", "individual_id", "group_id", "full_date", "date_mean_bp", "coverage_1240k", "snps_hit_1240k", "persistent_genetic_id", "molecular_sex")


def _fields_sql(layout: str, cut: str = "false") -> str:
    x = LAYOUTS[layout]
    kept = lambda f, sql, kind: f"CASE WHEN {cut} THEN NULL ELSE {sql} END AS {f}" if f in x.columns else f"NULL::{kind} AS {f}"
    pgid = f"{_PGID} AS persistent_genetic_id" if "persistent_genetic_id" in x.columns else "NULL::BIGINT AS persistent_genetic_id"
    told = [kept("group_id", _CELLS["group_id"], "VARCHAR"), kept("full_date", _CELLS["full_date"], "VARCHAR"), kept("date_mean_bp", _DATE, "BIGINT"), kept("coverage_1240k", _COVERAGE, "DOUBLE"), kept("snps_hit_1240k", _SNPS, "BIGINT"), pgid, kept("molecular_sex", _CELLS["molecular_sex"], "VARCHAR")]
    return f"SELECT '{LABELS[layout]}' AS version, '{layout}' AS schema_class, {_CELLS['genetic_id']} AS genetic_id, {_CELLS['individual_id']} AS individual_id, {', '.join(told)} FROM customer"


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def _scan(layout: str):
    @query(_fields_sql(layout), f"release_scan_{layout}")
    def scan(spark, sf_dir):
        return _fields(read_release(spark, release_file(spark, sf_dir, layout)))


for _layout in LAYOUTS:
    _scan(_layout)

_CUT = "c_custkey % 13 = 0"


@query(_fields_sql("C", _CUT))
def phantom_and_short_rows(spark, sf_dir):
    """A nameless last column, and rows without the cells behind the individual, which are NULL."""
    return _fields(read_release(spark, release_file(spark, sf_dir, "C", tail="\t", cut=_CUT)))


def _found(release: Release) -> DataFrame:
    d = release.describe()
    base = sum(at["base_column"] is not None for at in d["fields"].values())
    row = (d["version"], d["schema_class"], d["column_layout"] or "", d["n_columns"], len(d["fields"]), base, ",".join(d["not_present"]))
    names = "version string, schema_class string, variant string, n_columns int, n_fields int, n_moved int, not_present string"
    one = release.frame.sparkSession.createDataFrame([row], names)
    # every row of the file under what was found out about it
    return release.frame.groupBy(F.col("version")).agg(F.count("*").alias("n_rows")).join(F.broadcast(one), "version")


def _found_sql(layout: str, variant: str = "", label: str = "", moved: int = 0, width: int | None = None) -> str:
    x = LAYOUTS[layout]
    return f"SELECT '{label or LABELS[layout]}' AS version, '{layout}' AS schema_class, '{variant}' AS variant, {width or x.widths[0]} AS n_columns, {len(x.columns)} AS n_fields, {moved} AS n_moved, '{','.join(x.absent)}' AS not_present, count(*) AS n_rows FROM customer"


@query(" UNION ALL ".join(_found_sql(x) for x in LAYOUTS))
def layout_detect(spark, sf_dir):
    """What the header and the name of a file of each class tell."""
    return reduce(DataFrame.unionByName, [_found(read_release(spark, release_file(spark, sf_dir, x))) for x in LAYOUTS])


_MOVED = {x: sum(n in LAYOUTS[x].columns for n in LAYOUTS[x].moved.get(VARIANT, {})) for x in ("A", "F")}


@query(" UNION ALL ".join([_found_sql("A", VARIANT, "v50.0", _MOVED["A"]), _found_sql("F", VARIANT, "v44.3", _MOVED["F"])]))
def layout_variant(spark, sf_dir):
    """Moved columns found by their headers, also where the file's name says otherwise."""
    files = [release_file(spark, sf_dir, "A", VARIANT, "set_v50.0_1240K_public.anno"), release_file(spark, sf_dir, "F", VARIANT)]
    return reduce(DataFrame.unionByName, [_found(read_release(spark, f)) for f in files])


@query(_fields_sql("F"))
def layout_variant_scan(spark, sf_dir):
    """The same cells from moved columns."""
    return _fields(read_release(spark, release_file(spark, sf_dir, "F", VARIANT)))


def _routed_sql() -> str:
    own = lambda x: "NULL::DOUBLE" if x == "D" else _COVERAGE
    return " UNION ALL ".join(f"SELECT '{x}' AS schema_class, {_CELLS['genetic_id']} AS genetic_id, {own(x)} AS coverage, ({_SNPS})::DOUBLE / 1148000 AS estimate FROM customer" for x in LAYOUTS)


@query(_routed_sql())
def coverage_routing(spark, sf_dir):
    """Coverage by the native column, NULL in the class that dropped it, and by the estimate from sites."""
    parts = []
    for x in LAYOUTS:
        r = read_release(spark, release_file(spark, sf_dir, x))
        parts.append(r.frame.select("schema_class", "genetic_id", r.coverage().alias("coverage"), r.coverage("snps_hit_1240k").alias("estimate")))
    return reduce(DataFrame.unionByName, parts)


_ASKED = "c_custkey % 10 < 4"


@query(f"""
SELECT (row_number() OVER (ORDER BY k) - 1)::INTEGER AS pos, individual_id, cohort_label FROM (
  SELECT min(c_custkey) AS k, {_CELLS['individual_id']} AS individual_id, CASE WHEN min(c_custkey) % 3 = 0 THEN NULLIF(trim(arg_min(c_mktsegment, c_custkey)), '') END AS cohort_label
  FROM customer WHERE {_ASKED} GROUP BY 2)""")
def cohort_file(spark, sf_dir):
    """Ids and labels from a file with a header, comments, blank lines and repeated ids, of which the first counts."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").where(_ASKED)
    line = f"{_CELLS['individual_id']} || CASE c_custkey % 3 WHEN 0 THEN '\t ' || c_mktsegment WHEN 1 THEN '\t' ELSE '' END || CASE c_custkey % 10 WHEN 0 THEN '\n# more\n' ELSE '' END"
    path = one_file(spark, "cohort.tsv", "Individual_ID\tlabel", rows.select(F.col("c_custkey").cast("long").alias("k"), F.expr(line).alias("line")))
    return cohort_frame(spark, read_cohort(spark, path))


@query("""
SELECT 'v1.0' AS v_old, 'A' || c_custkey AS mid_old, 'v2.0' AS v_new, 'B' || c_custkey AS mid_new, NULL::VARCHAR AS via_genetic_id FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT 'v1.0', 'A' || c_custkey, 'v2.0', 'X' || c_custkey, 'S' || c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 5 <> 0
UNION ALL SELECT 'v1.0', 'A' || c_custkey, 'v2.0', 'B' || c_custkey, 'S' || c_custkey FROM customer WHERE c_custkey % 2 = 1""")
def manual_bridge_file(spark, sf_dir):
    """Manual renames laid over found ones: equal ones stay, contradicted ones go."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    line = "'v1.0\tA' || c_custkey || '\tv2.0\t B' || c_custkey || CASE c_custkey % 10 WHEN 0 THEN '\n#\n' ELSE '' END"
    path = one_file(spark, "bridge.tsv", "v_old_label\tmid_old\tv_new_label\tmid_new", rows.where("c_custkey % 5 = 0").select(F.col("c_custkey").cast("long").alias("k"), F.expr(line).alias("line")))
    manual = spark.createDataFrame(read_bridge(spark, path), B.EVENTS)
    found = rows.select(F.lit("v1.0").alias("v_old"), F.expr("'A' || c_custkey").alias("mid_old"), F.lit("v2.0").alias("v_new"), F.expr("CASE c_custkey % 2 WHEN 0 THEN 'X' ELSE 'B' END || c_custkey").alias("mid_new"), F.expr("'S' || c_custkey").alias("via_genetic_id"))
    return B.with_overrides(found, manual)
