"""What changed between two releases of one table.

Both sides are frames of samples with ``canonical``; they may carry the same
version label, so nothing here tells them apart by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import CHANGE_CLASSES, change_class
from .bridge import with_canonical

ORDER = ("added", "removed", "genetic_id_renamed", "master_id_renamed", *(f"group_changed:{c}" for c in CHANGE_CLASSES))


def individuals(side: DataFrame) -> DataFrame:
    """One row per individual: first_gid in file order, gids (distinct, not empty, in order), group (the most frequent one, of equals the smallest; '' if none)."""
    rows = side.where("individual_id <> ''")
    mode = F.mode(F.when(F.col("group_id") != "", F.col("group_id")), True)
    return rows.groupBy("canonical").agg(
        F.min_by("genetic_id", "row_idx").alias("first_gid"),
        F.array_sort(F.collect_set(F.when(F.col("genetic_id") != "", F.col("genetic_id")))).alias("gids"),
        F.coalesce(mode, F.lit("")).alias("group"),
    )


def paired(old: DataFrame, new: DataFrame) -> DataFrame:
    """Individuals of either side: canonical, o and n (structs, NULL where absent). One shuffle a side, one join."""
    pack = lambda df, name: individuals(df).select("canonical", F.struct("first_gid", "gids", "group").alias(name))
    return pack(old, "o").join(pack(new, "n"), "canonical", "full")


def added(pairs: DataFrame) -> DataFrame:
    return pairs.where("o is null").select("canonical", F.col("n.first_gid").alias("first_seen_genetic_id"))


def removed(pairs: DataFrame) -> DataFrame:
    """The first key in file order is what the event tells, by its name the last seen."""
    return pairs.where("n is null").select("canonical", F.col("o.first_gid").alias("last_seen_genetic_id"))


def gid_renamed(pairs: DataFrame) -> DataFrame:
    """Shared individuals none of whose keys stayed."""
    both = pairs.where("o is not null and n is not null and size(o.gids) > 0 and size(n.gids) > 0")
    return both.where(~F.arrays_overlap("o.gids", "n.gids")).select("canonical", F.col("o.gids").alias("v_old_gids"), F.col("n.gids").alias("v_new_gids"))


def mid_renamed(events: DataFrame, bridge: DataFrame, v_old: str, v_new: str) -> DataFrame:
    """The bridge's events between just these releases, under the new side's canonical id."""
    own = events.where((F.col("v_old") == v_old) & (F.col("v_new") == v_new))
    return with_canonical(own, bridge, "v_new", "mid_new")


def group_changed(pairs: DataFrame) -> DataFrame:
    both = pairs.where("o is not null and n is not null and o.`group` <> '' and n.`group` <> '' and o.`group` <> n.`group`")
    return both.select("canonical", F.col("o.group").alias("group_v_old"), F.col("n.group").alias("group_v_new"), change_class(F.col("o.group"), F.col("n.group")).alias("change_class"))


def class_histogram(changes: DataFrame, column: str = "change_class") -> DataFrame:
    """Events per class; all classes, in order."""
    spark = changes.sparkSession
    classes = spark.createDataFrame(list(enumerate(CHANGE_CLASSES)), "ord int, change_class string")
    counted = changes.groupBy(F.col(column).alias("change_class")).agg(F.count("*").alias("n_events"))
    return classes.join(counted, "change_class", "left").select("ord", "change_class", F.coalesce("n_events", F.lit(0)).alias("n_events"))


def _details(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def report(pairs: DataFrame, renames: DataFrame) -> DataFrame:
    """All events as (ord, seq, event_class, individual_id, details JSON), to be sorted by ord, seq and individual_id.

    An individual's events come from its one row of ``pairs``, which is computed once.
    """
    old, new = F.col("o"), F.col("n")
    both = old.isNotNull() & new.isNotNull()
    moved = both & (F.size(old["gids"]) > 0) & (F.size(new["gids"]) > 0) & ~F.arrays_overlap(old["gids"], new["gids"])
    relabelled = both & (old["group"] != "") & (new["group"] != "") & (old["group"] != new["group"])
    event = lambda when, name, *details: F.when(when, F.struct(name.alias("event_class"), _details(*details).alias("details")))
    events = F.array_compact(
        F.array(
            event(old.isNull(), F.lit("added"), new["first_gid"].alias("first_seen_genetic_id")),
            event(new.isNull(), F.lit("removed"), old["first_gid"].alias("last_seen_genetic_id")),
            event(moved, F.lit("genetic_id_renamed"), old["gids"].alias("v_old_gids"), new["gids"].alias("v_new_gids")),
            event(relabelled, F.concat(F.lit("group_changed:"), change_class(old["group"], new["group"])), old["group"].alias("group_v_old"), new["group"].alias("group_v_new")),
        )
    )
    own = pairs.select(F.col("canonical").alias("individual_id"), F.col("canonical").alias("seq"), F.inline(events))
    told = _details(F.col("mid_old").alias("v_old_mid"), F.col("mid_new").alias("v_new_mid"), F.col("via_genetic_id"))
    other = renames.select(F.col("canonical").alias("individual_id"), F.coalesce("via_genetic_id", F.lit("￿")).alias("seq"), F.lit("master_id_renamed").alias("event_class"), told.alias("details"))
    return own.unionByName(other).withColumn("ord", F.array_position(F.array(*map(F.lit, ORDER)), F.col("event_class")))


def rates(pairs: DataFrame) -> DataFrame:
    """One row: n_old, n_new, n_shared, n_added, n_removed, removal_rate, added_rate (0 over none)."""
    n = pairs.agg(F.count("o").alias("n_old"), F.count("n").alias("n_new"), F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("n_shared"))
    share = lambda part, whole: F.when(F.col(whole) == 0, 0.0).otherwise(F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    n = n.withColumn("n_added", F.col("n_new") - F.col("n_shared")).withColumn("n_removed", F.col("n_old") - F.col("n_shared"))
    return n.withColumn("removal_rate", share("n_removed", "n_old")).withColumn("added_rate", share("n_added", "n_new"))
