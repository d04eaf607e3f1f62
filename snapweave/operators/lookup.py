"""Point lookups, translation of ids between releases, and checks of group labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import suggested_lift
from .bridge import with_canonical


def resolve(samples: DataFrame, query: str) -> DataFrame:
    """At most one row (canonical, matched_via): the query as an individual's id in the first release that has it, else as a row key."""
    as_iid, as_gid = F.col("individual_id") == query, F.col("genetic_id") == query
    hit = samples.where(as_iid | as_gid)
    kind = F.when(as_iid, 0).otherwise(1)
    order = F.struct(kind, "supply_pos", "row_idx")
    best = hit.groupBy().agg(F.min_by(F.struct("canonical", kind.alias("kind")), order).alias("r")).where("r is not null")
    return best.select("r.canonical", F.when(F.col("r.kind") == 0, "individual_id").otherwise("genetic_id").alias("matched_via"))


def rows_of(samples: DataFrame, canonical: DataFrame) -> DataFrame:
    """The rows of the individuals in ``canonical`` (a frame of a few ids)."""
    return samples.join(canonical.select("canonical"), "canonical", "left_semi").select("version", "supply_pos", "row_idx", "genetic_id", "individual_id", "group_id", "snps_hit_1240k", "persistent_genetic_id")


def renames_of(events: DataFrame, bridge: DataFrame, canonical: DataFrame) -> DataFrame:
    """Events whose old side is one of the individuals, each edge once, by its first witness."""
    own = with_canonical(events, bridge, "v_old", "mid_old").join(canonical.select("canonical"), "canonical", "left_semi")
    return own.groupBy("v_old", "mid_old", "v_new", "mid_new").agg(F.coalesce(F.min("via_genetic_id"), F.lit("(manual)")).alias("via_genetic_id"))


def flags(n_present: int, n_versions: int, matched_via: str, multi_row: bool, renamed: bool) -> list[str]:
    out = [f"present_in_{n_present}_of_{n_versions}_versions"]
    out += ["matched_via_genetic_id"] * (matched_via == "genetic_id") + ["multi_row"] * multi_row + ["individual_id_renamed"] * renamed
    return out


def found(samples: DataFrame, events: DataFrame, bridge: DataFrame, query: str, n_versions: int) -> DataFrame:
    """At most one row: canonical, matched_via, n_rows and status_flags."""
    hit = resolve(samples, query)
    per = rows_of(samples, hit).groupBy("version").agg(F.count("*").alias("n"))
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    parts = hit.select("canonical", "matched_via", none.alias("n"), F.lit(False).alias("renamed"))
    parts = parts.union(per.select(text, text, "n", F.lit(False))).union(renames_of(events, bridge, hit).select(text, text, none, F.lit(True)))
    one = parts.agg(
        F.max("canonical").alias("canonical"), F.max("matched_via").alias("matched_via"), F.count("n").alias("n_present"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.max("n") > 1, F.lit(False)).alias("several"), F.max("renamed").alias("renamed"),
    ).where("canonical is not null")
    some = lambda when, name: F.when(when, F.lit(name))
    told = F.array(
        F.concat(F.lit("present_in_"), F.col("n_present").cast("string"), F.lit(f"_of_{n_versions}_versions")),
        some(F.col("matched_via") == "genetic_id", "matched_via_genetic_id"),
        some(F.col("several"), "multi_row"),
        some(F.col("renamed"), "individual_id_renamed"),
    )
    return one.select("canonical", "matched_via", "n_rows", F.array_compact(told).alias("status_flags"))


def translate_individuals(ids: DataFrame, bridge: DataFrame, src: str, target: DataFrame) -> DataFrame:
    """(individual_id) -> with genetic_id: the smallest row key of the same individual in ``target``, NULL if none."""
    asked = with_canonical(ids.select("individual_id").distinct().withColumn("_v", F.lit(src)), bridge, "_v")
    keys = target.where("individual_id <> ''").groupBy("canonical").agg(F.min("genetic_id").alias("genetic_id"))
    return asked.join(keys, "canonical", "left").select("individual_id", "genetic_id")


def translate_keys(ids: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(genetic_id) -> with genetic_ids: the individual's row keys in ``target`` in order, repeats kept, empty if unknown."""
    owner = source.where("individual_id <> '' and genetic_id <> ''").groupBy("genetic_id").agg(F.max_by("canonical", "row_idx").alias("canonical"))
    asked = ids.select("genetic_id").distinct().join(owner, "genetic_id", "left")
    there = target.where("individual_id <> '' and genetic_id <> ''").join(asked.select("canonical").distinct(), "canonical", "left_semi")
    keys = there.groupBy("canonical").agg(F.array_sort(F.collect_list("genetic_id")).alias("genetic_ids"))
    return asked.join(keys, "canonical", "left").select("genetic_id", F.coalesce("genetic_ids", F.array().cast("array<string>")).alias("genetic_ids"))


def validate_labels(labels: DataFrame, samples: DataFrame, versions: Sequence[str]) -> DataFrame:
    """(pos, group_id) -> status valid, lifted or unresolvable; lifted_to; found_in, releases in the order supplied."""
    known = samples.where("group_id is not null").groupBy(F.col("group_id").alias("known")).agg(F.array_sort(F.collect_set(F.struct("supply_pos", "version"))).alias("at")).select("known", F.col("at.version").alias("found"))
    asked = labels.withColumn("lift", suggested_lift(F.col("group_id")))
    a = known.select(F.col("known").alias("k1"), F.col("found").alias("f1"))
    b = known.select(F.col("known").alias("k2"), F.col("found").alias("f2"))
    both = asked.join(a, F.col("group_id") == F.col("k1"), "left").join(b, F.col("lift") == F.col("k2"), "left")
    status = F.when(F.col("f1").isNotNull(), "valid").when(F.col("f2").isNotNull(), "lifted").otherwise("unresolvable")
    return both.select(
        "pos", "group_id", status.alias("status"), F.when(status == "lifted", F.col("lift")).alias("lifted_to"), F.coalesce("f1", "f2", F.array().cast("array<string>")).alias("found_in")
    )
