"""The reconciliation queries over releases derived from the star-schema tables, each with its SQL.

Three releases are made of the customers: a row is a library, two libraries
make an individual; releases drop and add rows, rename ids and rewrite labels
by rules on the key, so that every class of change occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as T
from ..functions import numbers as N
from ..operators import bridge as B
from ..operators import diff as D
from ..operators import gates as G
from ..operators import libraries as L
from ..operators import lookup as K
from ..operators import manifest as M
from ..operators import summaries as S
from ..runtime import written
from . import filed

VERSIONS = ["v1.0", "v2.0", "v3.0"]
V1, V2, V3 = VERSIONS

#: Valid in Spark and in other engines alike; {customer} and {nation} are the tables.
RELEASES = """
base AS (
  SELECT c_custkey AS k, CAST(floor(c_custkey / 2) AS BIGINT) AS ind, replace(c_mktsegment, ' ', '') AS seg, replace(n_name, ' ', '') AS nat,
         CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.AG' ELSE '.DG' END AS suf
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey),
r1 AS (
  SELECT *, 'S' || k || suf AS gid, 'I' || ind AS iid,
         CASE k % 9 WHEN 2 THEN 'Czech_' || seg WHEN 3 THEN 'Patterson_' || seg || '_' || nat WHEN 5 THEN seg || '-' || nat WHEN 8 THEN '' ELSE seg || '_' || nat END AS grp
  FROM base),
r2 AS (
  SELECT k, ind, seg, nat, suf, CASE WHEN k % 12 = 0 THEN 'S' || k || '.AG' WHEN k % 11 = 5 THEN 'T' || k || suf ELSE gid END AS gid,
         CASE WHEN ind % 35 = 7 AND k % 2 = 1 THEN 'C' || ind WHEN ind % 7 = 0 THEN 'R' || ind ELSE iid END AS iid,
         CASE k % 9 WHEN 1 THEN grp || '.AG' WHEN 2 THEN 'Czechia_' || seg WHEN 3 THEN seg || '_' || nat WHEN 4 THEN nat || '_' || seg
                    WHEN 5 THEN seg || '_' || nat WHEN 6 THEN grp || '_Late' WHEN 7 THEN 'X_' || (k % 13) ELSE grp END AS grp
  FROM r1),
r3 AS (
  SELECT k, ind, seg, nat, suf, gid, CASE WHEN ind % 21 = 0 THEN 'Q' || ind ELSE iid END AS iid, CASE WHEN k % 5 = 0 THEN 'Y_' || grp ELSE grp END AS grp FROM r2),
every_row AS (
  SELECT 'v1.0' AS version, 0 AS version_rank, 2 * k AS row_idx, gid, iid, grp, k FROM r1
  UNION ALL SELECT 'v1.0', 0, 2 * k + 1, gid, 'D' || ind, 'Dup', k FROM r1 WHERE k % 97 = 0
  UNION ALL SELECT 'v2.0', 1, 2 * k, gid, iid, grp, k FROM r2 WHERE k % 10 <> 0
  UNION ALL SELECT 'v2.0', 1, 2 * k + 1, 'N' || k, 'N' || ind, 'New_' || nat, k FROM r2 WHERE k % 50 = 1
  UNION ALL SELECT 'v3.0', 2, 2 * k, gid, iid, grp, k FROM r3 WHERE k % 10 <> 1),
samples AS (
  SELECT version, version_rank, version_rank AS supply_pos, CASE version_rank WHEN 2 THEN 'E' ELSE 'D' END AS schema_class, row_idx, gid AS genetic_id, iid AS individual_id, grp AS group_id,
         (k * 37) % 1100000 AS snps_hit_1240k, CASE WHEN version_rank = 2 THEN k END AS persistent_genetic_id
  FROM every_row)
"""

_EVENTS = """
own AS (SELECT version, version_rank, genetic_id, arg_max(individual_id, row_idx) AS mid FROM samples WHERE genetic_id <> '' GROUP BY ALL),
events AS (
  SELECT o.version AS v_old, o.mid AS mid_old, n.version AS v_new, n.mid AS mid_new, n.genetic_id AS via_genetic_id
  FROM own o JOIN own n ON o.version_rank + 1 = n.version_rank AND o.genetic_id = n.genetic_id WHERE o.mid <> n.mid)
"""
# Versions are of one width here, so "version|mid" orders as (rank, version, mid) does.
_BRIDGE = """
edge AS (
  SELECT DISTINCT v_old || '|' || mid_old AS a, v_new || '|' || mid_new AS b FROM events
  UNION SELECT DISTINCT v_new || '|' || mid_new, v_old || '|' || mid_old FROM events),
reach(a, b) AS (SELECT a, a FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
bridge AS (SELECT split_part(a, '|', 1) AS version, split_part(a, '|', 2) AS mid, split_part(max(b), '|', 2) AS canonical FROM reach GROUP BY a),
canon AS (SELECT s.*, coalesce(b.canonical, s.individual_id) AS canonical FROM samples s LEFT JOIN bridge b ON s.version = b.version AND s.individual_id = b.mid)
"""
_CLASS = """CASE
  WHEN so = sn AND g_old <> g_new THEN 'convention_restructure_suffix'
  WHEN (so = 'Czech' AND sn = 'Czechia') OR (starts_with(so, 'Czech_') AND 'Czechia' || substr(so, 6) = sn) THEN 'convention_restructure_country'
  WHEN so = 'Patterson_' || sn THEN 'convention_restructure_prefix_drop'
  WHEN list_sort(string_split(so, '_')) = list_sort(string_split(sn, '_')) AND so <> sn THEN 'convention_restructure_order'
  WHEN replace(so, '-', '_') = replace(sn, '-', '_') AND so <> sn THEN 'convention_restructure_punct'
  WHEN list_sort(list_distinct(string_split(so, '_'))) <> list_sort(list_distinct(string_split(sn, '_')))
       AND (list_has_all(string_split(so, '_'), string_split(sn, '_')) OR list_has_all(string_split(sn, '_'), string_split(so, '_'))) THEN 'partial'
  ELSE 'substantive_regroup' END"""
_STRIP = r"regexp_replace({}, '\.(AG|DG|SG|HO|TW|BY|AA|EC|WGC)$', '')"
_SUFFIX = r"nullif(regexp_extract({0}, '^(.+?)\.(AG|DG|SG|HO|TW|BY|AA|EC|WGC)$', 2), '')"
_STEM = r"CASE WHEN regexp_matches({0}, '^(.+?)\.(AG|DG|SG|HO|TW|BY|AA|EC|WGC)$') THEN regexp_extract({0}, '^(.+?)\.(AG|DG|SG|HO|TW|BY|AA|EC|WGC)$', 1) ELSE {0} END"


def _side(name: str, version: str) -> str:
    return f"""
{name}_mode AS (
  SELECT canonical, group_id, row_number() OVER (PARTITION BY canonical ORDER BY count(*) DESC, group_id) AS place
  FROM canon WHERE version = '{version}' AND individual_id <> '' AND group_id <> '' GROUP BY canonical, group_id),
{name} AS (
  SELECT c.canonical, arg_min(genetic_id, row_idx) AS first_gid, coalesce(list_sort(list_distinct(list(genetic_id) FILTER (genetic_id <> ''))), []) AS gids, coalesce(max(m.group_id), '') AS grp
  FROM canon c LEFT JOIN {name}_mode m ON c.canonical = m.canonical AND m.place = 1
  WHERE version = '{version}' AND individual_id <> '' GROUP BY c.canonical)"""


_DIFF = _side("o", V1) + "," + _side("n", V2) + f""",
changes AS (
  SELECT *, {_CLASS} AS change_class
  FROM (SELECT o.canonical, o.grp AS g_old, n.grp AS g_new, {_STRIP.format('o.grp')} AS so, {_STRIP.format('n.grp')} AS sn
        FROM o JOIN n USING (canonical) WHERE o.grp <> '' AND n.grp <> '' AND o.grp <> n.grp))"""

_TOKENS = f"""
entries AS (
  SELECT canonical, version, version_rank, genetic_id AS gid, {_STEM.format('genetic_id')} AS stem, {_SUFFIX.format('genetic_id')} AS suffix
  FROM canon WHERE individual_id <> '' AND genetic_id <> ''),
stems AS (
  SELECT canonical, stem, version_rank, count(*) FILTER (suffix IS NULL) AS bare, count(*) FILTER (suffix IS NOT NULL) AS dressed, min(gid) FILTER (suffix IS NOT NULL) AS gid
  FROM entries GROUP BY ALL),
suffixes AS (SELECT canonical, suffix, version_rank, count(*) AS n, min(gid) AS gid, min(stem) AS stem FROM entries GROUP BY ALL),
key_edge AS (
  SELECT o.canonical, o.stem AS a, n.gid AS b FROM stems o JOIN stems n ON o.canonical = n.canonical AND o.stem = n.stem AND o.version_rank + 1 = n.version_rank
  WHERE o.bare > 0 AND o.dressed = 0 AND n.bare = 0 AND n.dressed = 1
  UNION SELECT o.canonical, o.gid, n.gid FROM suffixes o JOIN suffixes n ON o.canonical = n.canonical AND o.suffix IS NOT DISTINCT FROM n.suffix AND o.version_rank + 1 = n.version_rank
  WHERE o.n = 1 AND n.n = 1 AND o.stem <> n.stem),
key_link AS (SELECT canonical, a, b FROM key_edge UNION SELECT canonical, b, a FROM key_edge),
key_reach(canonical, a, b) AS (
  SELECT DISTINCT canonical, gid, gid FROM entries UNION SELECT r.canonical, r.a, l.b FROM key_reach r JOIN key_link l ON r.canonical = l.canonical AND r.b = l.a),
key_top AS (SELECT canonical, gid, max(version_rank) AS top FROM entries GROUP BY ALL),
named AS (
  SELECT r.canonical, r.a AS gid, split_part(max(t.top || '|' || r.b), '|', 2) AS token FROM key_reach r JOIN key_top t ON r.canonical = t.canonical AND r.b = t.gid GROUP BY r.canonical, r.a),
per AS (
  SELECT e.canonical, token, version, version_rank, min(e.gid) AS gid, count(DISTINCT e.gid) AS keys FROM entries e JOIN named n ON e.canonical = n.canonical AND e.gid = n.gid GROUP BY ALL),
tokens AS (
  SELECT canonical, token, version, version_rank, gid,
         CASE WHEN max(keys) OVER w > 1 THEN 'ambiguous' WHEN count(*) OVER w > 1 THEN 'chained' ELSE 'orphan' END AS chain_status
  FROM per WINDOW w AS (PARTITION BY canonical, token))"""
_PREFERENCE = "CASE coalesce(" + _SUFFIX.format("gid") + ", 'bare') WHEN 'AG' THEN 1 WHEN 'DG' THEN 2 WHEN 'SG' THEN 3 WHEN 'HO' THEN 4 WHEN 'TW' THEN 5 WHEN 'BY' THEN 6 WHEN 'AA' THEN 7 WHEN 'EC' THEN 8 WHEN 'WGC' THEN 9 WHEN 'bare' THEN 10 END"
_COLLAPSED = f"""
collapsed AS (
  SELECT canonical, version, version_rank, gid, token FROM (
    SELECT *, row_number() OVER (PARTITION BY canonical, version ORDER BY {_PREFERENCE}, gid) AS place FROM tokens) WHERE place = 1)"""


def _wide(labels: str, tokens: str) -> str:
    cells = ",\n         ".join(f"max({c}) FILTER (t.version = '{v}') AS {M.prefix(v)}_{n}" for v in VERSIONS for c, n in (("t.gid", "genetic_id"), ("f.group_id", "group_id"), ("f.snps", "snps_hit_1240k")))
    pairs = list(zip(VERSIONS, VERSIONS[1:], strict=False))
    changes = ""
    for a, b in pairs:
        old, new = f"{M.prefix(a)}_group_id", f"{M.prefix(b)}_group_id"
        rule = _class_of(old, new)
        changes += f", CASE WHEN {old} IS NULL OR {new} IS NULL THEN NULL WHEN {old} = {new} THEN 'none' ELSE {rule} END AS group_id_change_class_{M.prefix(a)}_to_{M.prefix(b)}"
    h = [f"{M.prefix(v)}_genetic_id IS NOT NULL" for v in VERSIONS]
    return f"""
facts AS (SELECT version, genetic_id AS gid, arg_min(group_id, row_idx) AS group_id, arg_min(snps_hit_1240k, row_idx) AS snps, arg_min(persistent_genetic_id, row_idx) AS pgid FROM samples WHERE genetic_id <> '' GROUP BY ALL),
wide AS (
  SELECT t.canonical, t.token, {cells},
         arg_max(f.pgid, t.version_rank) FILTER (f.pgid IS NOT NULL) AS persistent_genetic_id, any_value(t.chain_status) AS chain_status
  FROM ({tokens}) t LEFT JOIN facts f ON t.version = f.version AND t.gid = f.gid GROUP BY t.canonical, t.token),
manifest AS (
  SELECT l.cohort_label, 'direct' AS cohort_label_source, l.canonical AS individual_id_canonical, coalesce(token, l.canonical) AS library_token,
         {', '.join(f'{M.prefix(v)}_{c}' for v in VERSIONS for c in ('genetic_id', 'group_id', 'snps_hit_1240k'))}{changes}, persistent_genetic_id,
         CASE WHEN coalesce(chain_status = 'ambiguous', false) THEN 'library_chain_ambiguous'
              WHEN NOT ({h[0]} OR {h[1]} OR {h[2]}) THEN 'not_in_any_supplied_version'
              WHEN {h[0]} AND {h[1]} AND {h[2]} THEN 'present_all'
              WHEN NOT ({h[0]}) AND {h[1]} THEN 'added_after_v1_0' WHEN NOT ({h[0]}) AND {h[2]} THEN 'added_after_v2_0'
              WHEN NOT ({h[2]}) AND {h[1]} THEN 'removed_before_v3_0' WHEN NOT ({h[2]}) AND {h[0]} THEN 'removed_before_v2_0'
              ELSE 'present_some' END AS status
  FROM ({labels}) l LEFT JOIN wide ON l.canonical = wide.canonical)"""


def _class_of(old: str, new: str) -> str:
    import re

    named = {"g_old": old, "g_new": new, "so": _STRIP.format(old), "sn": _STRIP.format(new)}
    return re.sub(r"\b(g_old|g_new|so|sn)\b", lambda m: named[m[0]], _CLASS)


#: Every fifth individual of the first release, with a label for half of them, and ids that no release has.
_COHORT = """
cohort AS (
  SELECT CAST(ind AS INT) AS pos, CASE WHEN ind % 45 = 0 THEN 'Z' || ind ELSE 'I' || ind END AS individual_id, CASE WHEN ind % 10 = 0 THEN 'set_' || (ind % 4) END AS cohort_label
  FROM (SELECT DISTINCT ind FROM base) b WHERE ind % 5 = 0)"""
_LABELS = """
labels_ AS (
  SELECT canonical, arg_max(label, pos) AS cohort_label FROM (
    SELECT coalesce(b.canonical, c.individual_id) AS canonical, coalesce(c.cohort_label, b.canonical, c.individual_id) AS label, pos
    FROM cohort c LEFT JOIN bridge b ON b.version = 'v1.0' AND b.mid = c.individual_id) GROUP BY canonical)"""


def _with(*parts: str, then: str) -> str:
    return "WITH RECURSIVE " + ",".join((RELEASES.format(customer="customer", nation="nation"), *parts)) + "\n" + then


class Ready:
    """The derived releases with canonical ids, per query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation")}
        self.raw = written(self.sql("SELECT * FROM samples"))

    def sql(self, query: str, *parts: str) -> DataFrame:
        text = "WITH " + ",".join((RELEASES, *parts)) + "\n" + query
        return self.spark.sql(text, **self.tables)

    def bridged(self) -> Ready:
        self.events = B.rename_events(self.raw)
        self.bridge = B.canonical_ids(self.events, VERSIONS)
        self.samples = B.with_canonical(self.raw, self.bridge)
        return self

    def of(self, version: str) -> DataFrame:
        return self.samples.where(F.col("version") == version)

    def pairs(self) -> DataFrame:
        return D.paired(self.of(V1), self.of(V2))

    def cohort(self) -> DataFrame:
        return self.sql("SELECT * FROM cohort", _COHORT)

    def manifest(self, collapse: bool = False) -> DataFrame:
        labels = written(M.labelled(self.cohort(), self.bridge, V1))
        own = self.samples.join(labels.select("canonical"), "canonical", "left_semi")
        return M.manifest(labels, self.samples, L.library_tokens(own), VERSIONS, collapse)


def _ready(spark: SparkSession, sf_dir: str) -> Ready:
    return Ready(spark, sf_dir).bridged()


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _joined(column: str):
    return F.array_join(column, ",")


@query(_with(_EVENTS, then="SELECT * FROM events"))
def rename_events(spark, sf_dir):
    return B.rename_events(Ready(spark, sf_dir).raw)


@query(_with(_EVENTS, then="SELECT v_old, mid_old, min(v_new) AS v_new, string_agg(DISTINCT mid_new, ',' ORDER BY mid_new) AS mids FROM events GROUP BY v_old, mid_old HAVING count(DISTINCT mid_new) > 1"))
def mid_collisions(spark, sf_dir):
    found = B.collisions(B.rename_events(Ready(spark, sf_dir).raw))
    return found.withColumn("mids", _joined("mids"))


@query(_with(_EVENTS, _BRIDGE, then="SELECT * FROM bridge"))
def canonical_map(spark, sf_dir):
    return _ready(spark, sf_dir).bridge


_MANUAL = "manual AS (SELECT DISTINCT v_old, mid_old, v_new, 'M' || mid_new AS mid_new, CAST(NULL AS STRING) AS via_genetic_id FROM events WHERE mid_old LIKE '%5')"


@query(_with(_EVENTS, _MANUAL, then="""
SELECT * FROM events e WHERE NOT EXISTS (SELECT 1 FROM manual m WHERE m.v_old = e.v_old AND m.mid_old = e.mid_old AND (m.mid_new <> e.mid_new OR m.v_new <> e.v_new)) UNION ALL SELECT * FROM manual"""))
def bridge_overrides(spark, sf_dir):
    events = B.rename_events(Ready(spark, sf_dir).raw)
    manual = events.where("mid_old like '%5'").select("v_old", "mid_old", "v_new", F.concat(F.lit("M"), "mid_new").alias("mid_new"), F.lit(None).cast("string").alias("via_genetic_id")).distinct()
    return B.with_overrides(events, manual)


@query(_with(_EVENTS, _BRIDGE, _DIFF, then="SELECT n.canonical, n.first_gid AS first_seen_genetic_id FROM n ANTI JOIN o USING (canonical)"))
def diff_added(spark, sf_dir):
    return D.added(_ready(spark, sf_dir).pairs())


@query(_with(_EVENTS, _BRIDGE, _DIFF, then="SELECT o.canonical, o.first_gid AS last_seen_genetic_id FROM o ANTI JOIN n USING (canonical)"))
def diff_removed(spark, sf_dir):
    return D.removed(_ready(spark, sf_dir).pairs())


@query(_with(_EVENTS, _BRIDGE, _DIFF, then="""
SELECT canonical, array_to_string(o.gids, ',') AS v_old_gids, array_to_string(n.gids, ',') AS v_new_gids FROM o JOIN n USING (canonical) WHERE len(o.gids) > 0 AND len(n.gids) > 0 AND NOT list_has_any(o.gids, n.gids)"""))
def gid_renamed(spark, sf_dir):
    return D.gid_renamed(_ready(spark, sf_dir).pairs()).select("canonical", _joined("v_old_gids").alias("v_old_gids"), _joined("v_new_gids").alias("v_new_gids"))


@query(_with(_EVENTS, _BRIDGE, then="SELECT e.*, coalesce(b.canonical, e.mid_new) AS canonical FROM events e LEFT JOIN bridge b ON b.version = e.v_new AND b.mid = e.mid_new WHERE v_old = 'v1.0' AND v_new = 'v2.0'"))
def mid_renamed(spark, sf_dir):
    r = _ready(spark, sf_dir)
    return D.mid_renamed(r.events, r.bridge, V1, V2)


@query(_with(_EVENTS, _BRIDGE, _DIFF, then="SELECT canonical, grp AS majority_group FROM o"))
def group_majority(spark, sf_dir):
    return D.individuals(_ready(spark, sf_dir).of(V1)).select("canonical", F.col("group").alias("majority_group"))


@query(_with(_EVENTS, _BRIDGE, _DIFF, then="SELECT canonical, g_old AS group_v_old, g_new AS group_v_new, change_class FROM changes"))
def group_change_class(spark, sf_dir):
    return D.group_changed(_ready(spark, sf_dir).pairs())


_CLASSES = "classes AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{c}')" for k, c in enumerate(T.CHANGE_CLASSES)) + ") v(ord, change_class))"


@query(_with(_EVENTS, _BRIDGE, _DIFF, _CLASSES, then="SELECT ord, c.change_class, count(x.canonical) AS n_events FROM classes c LEFT JOIN changes x ON c.change_class = x.change_class GROUP BY ord, c.change_class"))
def group_change_histogram(spark, sf_dir):
    return D.class_histogram(D.group_changed(_ready(spark, sf_dir).pairs()))


@query(_with(_EVENTS, _BRIDGE, _DIFF, then="""
SELECT 1 AS ord, 'added' AS event_class, n.canonical AS individual_id, '{"first_seen_genetic_id":"' || n.first_gid || '"}' AS details FROM n ANTI JOIN o USING (canonical)
UNION ALL SELECT 2, 'removed', o.canonical, '{"last_seen_genetic_id":"' || o.first_gid || '"}' FROM o ANTI JOIN n USING (canonical)
UNION ALL SELECT 3, 'genetic_id_renamed', canonical, '{"v_old_gids":["' || array_to_string(o.gids, '","') || '"],"v_new_gids":["' || array_to_string(n.gids, '","') || '"]}'
  FROM o JOIN n USING (canonical) WHERE len(o.gids) > 0 AND len(n.gids) > 0 AND NOT list_has_any(o.gids, n.gids)
UNION ALL SELECT 4, 'master_id_renamed', coalesce(b.canonical, e.mid_new), '{"v_old_mid":"' || mid_old || '","v_new_mid":"' || mid_new || '","via_genetic_id":"' || via_genetic_id || '"}'
  FROM events e LEFT JOIN bridge b ON b.version = e.v_new AND b.mid = e.mid_new WHERE v_old = 'v1.0' AND v_new = 'v2.0'
UNION ALL SELECT 5 + list_position([""" + ", ".join(f"'{c}'" for c in T.CHANGE_CLASSES) + """], change_class) - 1, 'group_changed:' || change_class, canonical, '{"group_v_old":"' || g_old || '","group_v_new":"' || g_new || '"}' FROM changes"""))
def events_report(spark, sf_dir):
    r = _ready(spark, sf_dir)
    return D.report(r.pairs(), D.mid_renamed(r.events, r.bridge, V1, V2)).select("ord", "event_class", "individual_id", "details")


@query(_with(_EVENTS, _BRIDGE, _DIFF, then="""
SELECT *, CASE WHEN n_old = 0 THEN 0.0 ELSE n_removed::DOUBLE / n_old END AS removal_rate, CASE WHEN n_new = 0 THEN 0.0 ELSE n_added::DOUBLE / n_new END AS added_rate
FROM (SELECT (SELECT count(*) FROM o) AS n_old, (SELECT count(*) FROM n) AS n_new, (SELECT count(*) FROM o JOIN n USING (canonical)) AS n_shared,
             (SELECT count(*) FROM n ANTI JOIN o USING (canonical)) AS n_added, (SELECT count(*) FROM o ANTI JOIN n USING (canonical)) AS n_removed)"""))
def diff_rates(spark, sf_dir):
    return D.rates(_ready(spark, sf_dir).pairs())


@query(_with(_EVENTS, _BRIDGE, _TOKENS, then="SELECT * FROM tokens"))
def library_tokens(spark, sf_dir):
    return L.library_tokens(_ready(spark, sf_dir).samples)


@query(_with(_EVENTS, _BRIDGE, _TOKENS, _COLLAPSED, then="SELECT * FROM collapsed"))
def libraries_collapsed(spark, sf_dir):
    return L.collapsed(L.library_tokens(_ready(spark, sf_dir).samples))


@query(_with(_EVENTS, _BRIDGE, _TOKENS, _COLLAPSED, then="SELECT DISTINCT canonical, token FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM collapsed c WHERE c.canonical = t.canonical AND c.token = t.token)"))
def libraries_dropped(spark, sf_dir):
    tokens = L.library_tokens(_ready(spark, sf_dir).samples)
    return L.dropped_tokens(tokens, L.collapsed(tokens))


_MANIFEST = (_EVENTS, _BRIDGE, _COHORT, _LABELS, _TOKENS, _wide("SELECT * FROM labels_", "SELECT * FROM tokens"))


@query(_with(*_MANIFEST, then="SELECT * FROM manifest"))
def manifest_wide(spark, sf_dir):
    return M.ordered(_ready(spark, sf_dir).manifest())


@query(_with(_EVENTS, _BRIDGE, _COHORT, _LABELS, _TOKENS, _COLLAPSED, _wide("SELECT * FROM labels_", "SELECT canonical, canonical AS token, version, version_rank, gid, 'chained' AS chain_status FROM collapsed"), then="SELECT * FROM manifest"))
def manifest_collapsed(spark, sf_dir):
    return M.ordered(_ready(spark, sf_dir).manifest(collapse=True))


_UNION = """
union_labels AS (
  SELECT coalesce(b.canonical, x.canonical) AS canonical, max(x.canonical) AS cohort_label
  FROM (SELECT DISTINCT canonical FROM canon WHERE individual_id <> '') x LEFT JOIN bridge b ON b.version = 'v3.0' AND b.mid = x.canonical GROUP BY 1)"""


@query(_with(_EVENTS, _BRIDGE, _TOKENS, _UNION, _wide("SELECT * FROM union_labels", "SELECT * FROM tokens"), then="SELECT * FROM manifest"))
def join_wide(spark, sf_dir):
    r = _ready(spark, sf_dir)
    return M.manifest(M.union_of_individuals(r.samples, r.bridge, V3), r.samples, L.library_tokens(r.samples), VERSIONS)


def _resolved(q: str) -> str:
    return f"""
hit AS (
  SELECT canonical, CASE WHEN individual_id = {q} THEN 'individual_id' ELSE 'genetic_id' END AS matched_via FROM canon WHERE individual_id = {q} OR genetic_id = {q}
  ORDER BY CASE WHEN individual_id = {q} THEN 0 ELSE 1 END, supply_pos, row_idx LIMIT 1)"""


_ROWS = "SELECT c.version, c.supply_pos, c.row_idx, c.genetic_id, c.individual_id, c.group_id, c.snps_hit_1240k, c.persistent_genetic_id FROM canon c JOIN hit USING (canonical)"


@query(_with(_EVENTS, _BRIDGE, _resolved("'R42'"), then=_ROWS))
def lookup_rows(spark, sf_dir):
    r = _ready(spark, sf_dir)
    return K.rows_of(r.samples, K.resolve(r.samples, "R42"))


@query(_with(_EVENTS, _BRIDGE, _resolved("'S61.AG'"), then="SELECT * FROM hit"))
def lookup_by_key(spark, sf_dir):
    return K.resolve(_ready(spark, sf_dir).samples, "S61.AG")


@query(_with(_EVENTS, _BRIDGE, _resolved("'R42'"), then="""
SELECT v_old, mid_old, v_new, mid_new, min(via_genetic_id) AS via_genetic_id FROM events e LEFT JOIN bridge b ON b.version = e.v_old AND b.mid = e.mid_old
WHERE coalesce(b.canonical, e.mid_old) IN (SELECT canonical FROM hit) GROUP BY ALL"""))
def lookup_renames(spark, sf_dir):
    r = _ready(spark, sf_dir)
    return K.renames_of(r.events, r.bridge, K.resolve(r.samples, "R42"))


@query(_with(_EVENTS, _BRIDGE, _COHORT, then="""
SELECT c.individual_id, min(s.genetic_id) AS genetic_id FROM (SELECT DISTINCT individual_id FROM cohort) c LEFT JOIN bridge b ON b.version = 'v1.0' AND b.mid = c.individual_id
LEFT JOIN canon s ON s.version = 'v3.0' AND s.individual_id <> '' AND s.canonical = coalesce(b.canonical, c.individual_id) GROUP BY c.individual_id"""))
def translate_min(spark, sf_dir):
    r = _ready(spark, sf_dir)
    return K.translate_individuals(r.cohort(), r.bridge, V1, r.of(V3))


@query(_with(_EVENTS, _BRIDGE, then="""
SELECT a.genetic_id, coalesce(string_agg(n.genetic_id, ',' ORDER BY n.genetic_id), '') AS genetic_ids
FROM (SELECT genetic_id, arg_max(canonical, row_idx) AS canonical FROM canon WHERE version = 'v1.0' AND individual_id <> '' AND genetic_id <> '' GROUP BY genetic_id) a
LEFT JOIN canon n ON n.version = 'v2.0' AND n.individual_id <> '' AND n.genetic_id <> '' AND n.canonical = a.canonical GROUP BY a.genetic_id"""))
def translate_list(spark, sf_dir):
    r = _ready(spark, sf_dir)
    return K.translate_keys(r.of(V1).select("genetic_id"), r.of(V1), r.of(V2)).select("genetic_id", _joined("genetic_ids").alias("genetic_ids"))


@query(_with(_COHORT, then="SELECT version, count(DISTINCT s.individual_id) AS n FROM samples s WHERE s.individual_id IN (SELECT individual_id FROM cohort) GROUP BY version, supply_pos ORDER BY n DESC, supply_pos LIMIT 1"))
def detect_release(spark, sf_dir):
    r = Ready(spark, sf_dir)
    return M.detect_version(r.cohort(), r.raw)


_LIFT = f"CASE WHEN starts_with({_STRIP.format('group_id')}, 'Patterson_') THEN substr({_STRIP.format('group_id')}, 11) END"


@query(_with(then=f"SELECT DISTINCT group_id, {_LIFT} AS lifted_to FROM samples"))
def label_lift(spark, sf_dir):
    rows = Ready(spark, sf_dir).raw.select("group_id").distinct()
    return rows.select("group_id", T.suggested_lift(F.col("group_id")).alias("lifted_to"))


_ASKED_LABELS = "asked AS (SELECT DISTINCT CAST(0 AS INT) AS pos, CASE WHEN k % 3 = 0 THEN 'Patterson_' || grp WHEN k % 3 = 1 THEN grp ELSE grp || '?' END AS group_id FROM r2)"


@query(_with(_ASKED_LABELS, f"""
known AS (SELECT group_id, string_agg(DISTINCT version, ',' ORDER BY version) AS found FROM samples WHERE group_id IS NOT NULL GROUP BY group_id),
lifts AS (SELECT *, {_LIFT} AS lift FROM asked)""", then="""
SELECT l.pos, l.group_id, CASE WHEN a.found IS NOT NULL THEN 'valid' WHEN b.found IS NOT NULL THEN 'lifted' ELSE 'unresolvable' END AS status,
       CASE WHEN a.found IS NULL AND b.found IS NOT NULL THEN l.lift END AS lifted_to, coalesce(a.found, b.found, '') AS found_in
FROM lifts l LEFT JOIN known a ON a.group_id = l.group_id LEFT JOIN known b ON b.group_id = l.lift"""))
def validate_labels(spark, sf_dir):
    r = Ready(spark, sf_dir)
    return K.validate_labels(r.sql("SELECT * FROM asked", _ASKED_LABELS), r.raw, VERSIONS).withColumn("found_in", _joined("found_in"))


def _turnover_sql() -> str:
    parts = []
    for k, (a, b) in enumerate(zip(VERSIONS, VERSIONS[1:], strict=False)):
        parts.append(f"SELECT {k} AS seq, '{a}' AS v_old, '{b}' AS v_new, count(*) FILTER (h{k}) AS n, count(*) FILTER (h{k} AND NOT h{k + 1}) AS gone FROM has")
    has = ", ".join(f"bool_or({M.prefix(v)}_genetic_id IS NOT NULL) AS h{k}" for k, v in enumerate(VERSIONS))
    return f"""
SELECT seq, v_old, v_new, removal_rate, CASE WHEN removal_rate >= 0.3 THEN 'fail' WHEN removal_rate >= 0.05 THEN 'warn' ELSE 'pass' END AS state
FROM (SELECT seq, v_old, v_new, CASE WHEN n = 0 THEN 0.0 ELSE gone::DOUBLE / n END AS removal_rate
      FROM (WITH has AS (SELECT individual_id_canonical, {has} FROM manifest GROUP BY 1) {' UNION ALL '.join(parts)}))"""


@query(_with(*_MANIFEST, then=_turnover_sql()))
def turnover_pairs(spark, sf_dir):
    return G.cohort_turnover(_ready(spark, sf_dir).manifest(), VERSIONS)


@query(_with(_EVENTS, _BRIDGE, _DIFF, then="""
SELECT removal_rate, CASE WHEN removal_rate >= 0.3 THEN 'fail' WHEN removal_rate >= 0.05 THEN 'warn' ELSE 'pass' END AS state
FROM (SELECT (SELECT count(*) FROM o ANTI JOIN n USING (canonical))::DOUBLE / (SELECT count(*) FROM o) AS removal_rate)"""))
def turnover_diff(spark, sf_dir):
    return G.turnover(D.rates(_ready(spark, sf_dir).pairs()))


@query(_with(*_MANIFEST, then="""
SELECT *, CASE WHEN coverage < 0.25 THEN 'fail' WHEN coverage < 0.5 THEN 'warn' ELSE 'pass' END AS state
FROM (SELECT resolved, requested, CASE WHEN requested = 0 THEN 1.0 ELSE resolved::DOUBLE / requested END AS coverage
      FROM (SELECT count(*) FILTER (coalesce(b.canonical, c.individual_id) IN (SELECT individual_id_canonical FROM manifest WHERE status <> 'not_in_any_supplied_version')) AS resolved, count(*) AS requested
            FROM cohort c LEFT JOIN bridge b ON b.version = 'v1.0' AND b.mid = c.individual_id))"""))
def coverage_gate(spark, sf_dir):
    r = _ready(spark, sf_dir)
    return G.cohort_coverage(r.cohort(), r.manifest(), r.bridge, V1)


@query(_with(_EVENTS, _BRIDGE, _DIFF, then="SELECT count(*) AS n_events, CASE WHEN count(*) > 10 THEN 'fail' ELSE 'pass' END AS state FROM changes WHERE change_class = 'substantive_regroup'"))
def regroup_gate(spark, sf_dir):
    return G.substantive_regroup(D.group_changed(_ready(spark, sf_dir).pairs()), 10)


@query(_with(*_MANIFEST, then="SELECT status, count(*) AS n_rows FROM manifest GROUP BY status"))
def presence_histogram(spark, sf_dir):
    return G.presence_histogram(_ready(spark, sf_dir).manifest())


@query(_with(then=f"SELECT DISTINCT genetic_id, {_STEM.format('genetic_id')} AS stem, {_SUFFIX.format('genetic_id')} AS suffix FROM samples"))
def gid_parse(spark, sf_dir):
    gid = F.col("genetic_id")
    return Ready(spark, sf_dir).raw.select("genetic_id", T.stem(gid).alias("stem"), T.suffix(gid).alias("suffix")).distinct()


_SPELLED = """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN event_id || '.0' WHEN 2 THEN event_id || '.5' WHEN 3 THEN '' WHEN 4 THEN 'n/a'
                 WHEN 5 THEN ' +' || event_id || 'e1 ' WHEN 6 THEN CASE event_id % 16 WHEN 6 THEN 'inf' ELSE '-Infinity' END ELSE event_id || 'f' END AS text FROM {events}"""
_NUMBER = r"CASE WHEN regexp_matches(text, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$') OR regexp_matches(text, '(?i)^\s*[+-]?inf(inity)?\s*$') THEN TRY_CAST(trim(replace(text, '+', '')) AS DOUBLE) END"


def _spelled(spark, sf_dir) -> DataFrame:
    return spark.sql(_SPELLED, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


@query(f"SELECT event_id, {_NUMBER} AS number FROM ({_SPELLED.format(events='events')})")
def tolerant_double(spark, sf_dir):
    return _spelled(spark, sf_dir).select("event_id", N.tolerant_double(F.col("text")).alias("number"))


@query(f"SELECT event_id, CASE WHEN abs(number) < 9.2e18 AND floor(number) = number THEN TRY_CAST(number AS BIGINT) END AS number FROM (SELECT event_id, {_NUMBER} AS number FROM ({_SPELLED.format(events='events')}))")
def tolerant_long(spark, sf_dir):
    return _spelled(spark, sf_dir).select("event_id", N.tolerant_long(F.col("text")).alias("number"))


@query("SELECT l_orderkey, l_linenumber, l_partkey::DOUBLE / 1148000 AS coverage FROM lineitem")
def panel_coverage(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", N.panel_coverage(F.col("l_partkey")).alias("coverage"))


@query(r"""
SELECT p_partkey, regexp_replace(lower(trim(regexp_replace(trim(regexp_replace(header, '[(\[;:].*$', '')), '[^\w\s]', '', 'g'))), '\s+', '_', 'g') AS header
FROM (SELECT p_partkey, ' ' || p_name || '-' || p_brand || CASE p_partkey % 4 WHEN 0 THEN ' (' WHEN 1 THEN '; ' WHEN 2 THEN ' [' ELSE ': ' END || p_type AS header FROM part)""")
def header_normalize(spark, sf_dir):
    mark = F.expr("case p_partkey % 4 when 0 then ' (' when 1 then '; ' when 2 then ' [' else ': ' end")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit("-"), "p_brand", mark, "p_type").alias("header"))
    return rows.select("p_partkey", T.normalized_header(F.col("header")).alias("header"))


_N_OF = f"""
has AS (SELECT individual_id_canonical, count(*) AS n_rows, bool_or({M.prefix(V1)}_genetic_id IS NOT NULL) AS f, bool_or({M.prefix(V3)}_genetic_id IS NOT NULL) AS l FROM manifest GROUP BY 1)"""


@query(_with(*_MANIFEST, _N_OF, then="""
SELECT count(*) AS n_individuals, sum(n_rows)::BIGINT AS n_libraries, count(*) FILTER (l) AS n_resolved_in_latest, count(*) FILTER (l AND NOT f) AS n_added_after_earliest, count(*) FILTER (f AND NOT l) AS n_removed_before_latest FROM has"""))
def cohort_summary(spark, sf_dir):
    return S.cohort_counts(_ready(spark, sf_dir).manifest(), VERSIONS)


_EACH = " UNION ALL ".join(f"SELECT group_id_change_class_{M.prefix(a)}_to_{M.prefix(b)} AS change_class FROM manifest" for a, b in zip(VERSIONS, VERSIONS[1:], strict=False))


@query(_with(*_MANIFEST, _CLASSES, then=f"SELECT ord, c.change_class, count(x.change_class) AS n_events FROM classes c LEFT JOIN ({_EACH}) x ON c.change_class = x.change_class GROUP BY ord, c.change_class"))
def cohort_changes(spark, sf_dir):
    return S.cohort_changes(_ready(spark, sf_dir).manifest(), VERSIONS)


@query(_with(*_MANIFEST, then=f"SELECT state, removal_rate FROM ({_turnover_sql()}) ORDER BY CASE state WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, seq LIMIT 1"))
def worst_turnover(spark, sf_dir):
    return S.worst_pair(G.cohort_turnover(_ready(spark, sf_dir).manifest(), VERSIONS))


@query(_with(*_MANIFEST, then="SELECT cohort_label_source AS value, count(*) AS n_rows FROM manifest GROUP BY 1"))
def label_sources(spark, sf_dir):
    return S.histogram(_ready(spark, sf_dir).manifest(), "cohort_label_source")


@query(_with(_EVENTS, _BRIDGE, _DIFF, then="SELECT (SELECT count(*) FROM n ANTI JOIN o USING (canonical)) AS n_added, (SELECT count(*) FROM o ANTI JOIN n USING (canonical)) AS n_removed, (SELECT count(*) FROM o JOIN n USING (canonical) WHERE len(o.gids) > 0 AND len(n.gids) > 0 AND NOT list_has_any(o.gids, n.gids)) AS n_gid_renamed, (SELECT count(*) FROM events WHERE v_old = 'v1.0' AND v_new = 'v2.0') AS n_mid_renamed, "
    + ", ".join(f"(SELECT count(*) FROM changes WHERE change_class = '{c}') AS group_changed_{c}" for c in T.CHANGE_CLASSES)))
def diff_summary(spark, sf_dir):
    r = _ready(spark, sf_dir)
    return S.diff_counts(r.pairs(), D.mid_renamed(r.events, r.bridge, V1, V2))


@query(_with(_EVENTS, _BRIDGE, then="""
SELECT a.version, a.mid, e.v_old, e.mid_old, e.v_new, e.mid_new, e.via_genetic_id
FROM bridge a JOIN (SELECT e.*, o.canonical FROM events e JOIN bridge o ON o.version = e.v_old AND o.mid = e.mid_old JOIN bridge n ON n.version = e.v_new AND n.mid = e.mid_new WHERE o.canonical = n.canonical) e ON a.canonical = e.canonical"""))
def events_of_ids(spark, sf_dir):
    r = _ready(spark, sf_dir)
    return B.events_for(r.events, r.bridge, r.bridge.select("version", "mid"))


_UNCHANGED = """
seen AS (SELECT DISTINCT version, version_rank, individual_id AS mid FROM samples WHERE individual_id <> ''),
edges_ AS (SELECT v_old, mid_old, v_new, mid_new FROM events UNION SELECT a.version, a.mid, b.version, b.mid FROM seen a JOIN seen b ON a.mid = b.mid AND a.version_rank + 1 = b.version_rank),
both_ AS (SELECT v_old || '|' || mid_old AS a, v_new || '|' || mid_new AS b FROM edges_ UNION SELECT v_new || '|' || mid_new, v_old || '|' || mid_old FROM edges_),
reach_(a, b) AS (SELECT a, a FROM both_ UNION SELECT r.a, e.b FROM reach_ r JOIN both_ e ON r.b = e.a)"""


@query(_with(_EVENTS, _UNCHANGED, then="SELECT split_part(a, '|', 1) AS version, split_part(a, '|', 2) AS mid, split_part(max(b), '|', 2) AS canonical FROM reach_ GROUP BY a"))
def canonical_unchanged(spark, sf_dir):
    """Canonical ids that also chain over ids that stay the same."""
    raw = Ready(spark, sf_dir).raw
    return B.canonical_ids(B.rename_events(raw).unionByName(B.linked_unchanged(raw)), VERSIONS)


def _flags_sql(q: str) -> str:
    return f"""
SELECT h.canonical, h.matched_via, (SELECT count(*) FROM canon c WHERE c.canonical = h.canonical) AS n_rows,
       'present_in_' || (SELECT count(DISTINCT version) FROM canon c WHERE c.canonical = h.canonical) || '_of_3_versions' || CASE WHEN matched_via = 'genetic_id' THEN ',matched_via_genetic_id' ELSE '' END
       || CASE WHEN EXISTS (SELECT 1 FROM canon c WHERE c.canonical = h.canonical GROUP BY version HAVING count(*) > 1) THEN ',multi_row' ELSE '' END
       || CASE WHEN EXISTS (SELECT 1 FROM events e LEFT JOIN bridge b ON b.version = e.v_old AND b.mid = e.mid_old WHERE coalesce(b.canonical, e.mid_old) = h.canonical) THEN ',individual_id_renamed' ELSE '' END AS status_flags
FROM hit h"""


@query(_with(_EVENTS, _BRIDGE, _resolved("'S61.AG'"), then=_flags_sql("'S61.AG'")))
def lookup_flags(spark, sf_dir):
    r = _ready(spark, sf_dir)
    return K.found(r.samples, r.events, r.bridge, "S61.AG", len(VERSIONS)).withColumn("status_flags", _joined("status_flags"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN NULL ELSE p_size END AS number FROM part")
def strict_long(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select("p_partkey", N.strict_long(F.expr("CASE p_partkey % 3 WHEN 0 THEN '' ELSE CAST(p_size AS STRING) END")).cast("int").alias("number"))


QUERIES |= filed.QUERIES
ORACLE_SQL |= filed.ORACLE_SQL
