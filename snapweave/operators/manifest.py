"""Cohorts across releases: one wide row per individual and library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import change_class
from .bridge import with_canonical
from .libraries import PREFERENCE, collapsed

ABSENT = "not_in_any_supplied_version"


def prefix(version: str) -> str:
    return version.replace(".", "_")


def detect_version(cohort: DataFrame, samples: DataFrame) -> DataFrame:
    """At most one row (version, n): the release with most of the cohort's ids; of equals the first supplied."""
    hit = samples.join(cohort.select("individual_id").distinct(), "individual_id", "left_semi")
    counted = hit.groupBy("version", "supply_pos").agg(F.count_distinct("individual_id").alias("n"))
    return counted.orderBy(F.desc("n"), "supply_pos").limit(1).select("version", "n")


def labelled(cohort: DataFrame, bridge: DataFrame, cohort_version: str, known: bool = True) -> DataFrame:
    """(pos, individual_id, cohort_label) -> (canonical, cohort_label): of inputs with one canonical id the last label stays.

    Inputs of a release that isn't supplied (``known`` false) aren't bridged.
    """
    rows = cohort.withColumn("_v", F.lit(cohort_version))
    rows = with_canonical(rows, bridge, "_v") if known else rows.withColumn("canonical", F.col("individual_id"))
    return rows.groupBy("canonical").agg(F.max_by(F.coalesce("cohort_label", "canonical"), "pos").alias("cohort_label"))


def change_between(old: Column, new: Column) -> Column:
    """NULL where either is missing, 'none' where equal, else the class of the change."""
    return F.when(old.isNull() | new.isNull(), None).when(old == new, "none").otherwise(change_class(old, new))


def presence_status(present: Sequence[Column], versions: Sequence[str], ambiguous: Column) -> Column:
    """From which releases a library is in."""
    some = present[0]
    for p in present[1:]:
        some = some | p
    every = present[0]
    for p in present[1:]:
        every = every & p
    out = F.when(ambiguous, "library_chain_ambiguous").when(~some, ABSENT).when(every, "present_all")
    for k in range(1, len(versions)):  # the first release it is in, if that isn't the first of all
        before = ~present[0]
        for p in present[1:k]:
            before = before & ~p
        out = out.when(before & present[k], f"added_after_{prefix(versions[k - 1])}")
    for k in range(len(versions) - 2, -1, -1):
        after = ~present[k + 1]
        for p in present[k + 2 :]:
            after = after & ~p
        out = out.when(after & present[k], f"removed_before_{prefix(versions[k + 1])}")
    return out.otherwise("present_some")


def manifest(labels: DataFrame, samples: DataFrame, tokens: DataFrame, versions: Sequence[str], collapse: bool = False, preference: Sequence[str] = PREFERENCE) -> DataFrame:
    """(canonical, cohort_label) and libraries -> one row per individual and library, unsorted.

    Columns: cohort_label, cohort_label_source, individual_id_canonical,
    library_token; per release _genetic_id, _group_id and _snps_hit_1240k; per
    neighbouring pair group_id_change_class_; persistent_genetic_id; status.
    Only libraries of the cohort are pivoted; keys' facts are looked up for those. ``versions`` are in order.
    """
    wanted = tokens.join(labels.select("canonical"), "canonical", "left_semi")
    if collapse:
        wanted = collapsed(wanted, preference).withColumn("token", F.col("canonical")).withColumn("chain_status", F.lit("chained"))
    facts = F.struct("group_id", F.col("snps_hit_1240k").alias("snps"), F.col("persistent_genetic_id").alias("pgid"))
    rows = samples.where("genetic_id <> ''").select(F.col("version").alias("_v"), F.col("genetic_id").alias("_g"), "row_idx", facts.alias("f"))
    # A library has one key per release; of the rows with that key, whoever they belong to, the first tells its facts.
    held = wanted.join(rows, (F.col("version") == F.col("_v")) & (F.col("gid") == F.col("_g")), "left")
    cells = []
    for k, v in enumerate(versions):
        here = F.col("version") == v
        cells += [F.max(F.when(here, F.col("gid"))).alias(f"g{k}"), F.min_by("f", F.when(here, F.col("row_idx"))).alias(f"f{k}")]
    wide = held.groupBy("canonical", "token").agg(*cells, F.first("chain_status").alias("chain_status"))
    latest = F.coalesce(*[F.col(f"f{k}.pgid") for k in reversed(range(len(versions)))])
    per = [c for k, v in enumerate(versions) for c in (F.col(f"g{k}").alias(f"{prefix(v)}_genetic_id"), F.col(f"f{k}.group_id").alias(f"{prefix(v)}_group_id"), F.col(f"f{k}.snps").alias(f"{prefix(v)}_snps_hit_1240k"))]
    wide = wide.select("canonical", "token", "chain_status", *per, latest.alias("persistent_genetic_id"))
    rows = labels.join(wide, "canonical", "left")
    changes = [change_between(F.col(f"{prefix(a)}_group_id"), F.col(f"{prefix(b)}_group_id")).alias(f"group_id_change_class_{prefix(a)}_to_{prefix(b)}") for a, b in zip(versions, versions[1:], strict=False)]
    present = [F.col(f"{prefix(v)}_genetic_id").isNotNull() for v in versions]
    ambiguous = F.coalesce(F.col("chain_status") == "ambiguous", F.lit(False))
    return rows.select(
        "cohort_label",
        F.lit("direct").alias("cohort_label_source"),
        F.col("canonical").alias("individual_id_canonical"),
        F.coalesce("token", "canonical").alias("library_token"),
        *[f"{prefix(v)}_{c}" for v in versions for c in ("genetic_id", "group_id", "snps_hit_1240k")],
        *changes,
        "persistent_genetic_id",
        presence_status(present, versions, ambiguous).alias("status"),
    )


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy("cohort_label", "individual_id_canonical", "library_token")


def union_of_individuals(samples: DataFrame, bridge: DataFrame, version: str) -> DataFrame:
    """Labels for a pairwise join: every individual of either release, its canonical id as label.

    The canonical ids pass the bridge once more, as ids of ``version``.
    """
    seen = samples.where("individual_id <> ''").select(F.col("canonical").alias("individual_id")).distinct()
    rows = seen.select("individual_id", F.col("individual_id").alias("cohort_label"), F.lit(0).alias("pos"))
    return with_canonical(rows.withColumn("_v", F.lit(version)), bridge, "_v").groupBy("canonical").agg(F.max("cohort_label").alias("cohort_label"))
