"""What a run found, as frames of one row or one row a class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import CHANGE_CLASSES
from . import diff as D
from .manifest import prefix


def cohort_counts(manifest: DataFrame, versions: Sequence[str]) -> DataFrame:
    """One row: n_individuals, n_libraries, n_resolved_in_latest, n_added_after_earliest, n_removed_before_latest. Individuals count where any of their libraries does."""
    first, last = (F.col(f"{prefix(v)}_genetic_id").isNotNull() for v in (versions[0], versions[-1]))
    seen = manifest.groupBy("individual_id_canonical").agg(F.count("*").alias("rows"), F.max(first).alias("first"), F.max(last).alias("last"))
    return seen.agg(
        F.count("*").alias("n_individuals"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_libraries"),
        F.count_if("last").alias("n_resolved_in_latest"),
        F.count_if(F.col("last") & ~F.col("first")).alias("n_added_after_earliest"),
        F.count_if(F.col("first") & ~F.col("last")).alias("n_removed_before_latest"),
    )


def cohort_changes(manifest: DataFrame, versions: Sequence[str]) -> DataFrame:
    """(ord, change_class, n_events): changes over all rows and neighbouring releases; all classes, in order."""
    pairs = [F.col(f"group_id_change_class_{prefix(a)}_to_{prefix(b)}") for a, b in zip(versions, versions[1:], strict=False)]
    each = manifest.select(F.explode(F.array(*pairs) if pairs else F.array().cast("array<string>")).alias("change_class"))
    return D.class_histogram(each.where(F.col("change_class").isin(*CHANGE_CLASSES)))


def histogram(manifest: DataFrame, column: str) -> DataFrame:
    """(value, n_rows) of status or cohort_label_source."""
    return manifest.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows"))


def worst_pair(turnover: DataFrame) -> DataFrame:
    """At most one row (state, removal_rate): of the neighbouring releases' gates the most severe, of equals the first."""
    severity = F.when(F.col("state") == "fail", 2).when(F.col("state") == "warn", 1).otherwise(0)
    return turnover.groupBy().agg(F.max_by(F.struct("state", "removal_rate"), F.struct(severity, -F.col("seq"))).alias("w")).where("w is not null").select("w.*")


def diff_counts(pairs: DataFrame, renames: DataFrame) -> DataFrame:
    """One row: individuals and events of a diff, and group_changed_ per class, from one pass over the pairs."""
    events = D.report(pairs, renames)
    names = {"added": "n_added", "removed": "n_removed", "genetic_id_renamed": "n_gid_renamed", "master_id_renamed": "n_mid_renamed"}
    return events.agg(*[F.count_if(F.col("event_class") == k).alias(names.get(k, k.replace("group_changed:", "group_changed_"))) for k in D.ORDER])
