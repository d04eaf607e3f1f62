"""Renames of entities between neighbouring releases, witnessed by row keys that stay.

A frame of samples has version, version_rank (0, 1, ... in order), row_idx (an
orderable position in its file), genetic_id (row key) and individual_id
(entity). Empty text is a value; NULL is a cell that the row doesn't have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CollisionError
from .components import largest_members

EVENTS = "v_old string, mid_old string, v_new string, mid_new string, via_genetic_id string"


def owners(samples: DataFrame) -> DataFrame:
    """(genetic_id, version, version_rank, mid): each row key's entity, of rows that repeat the key the last one's."""
    keyed = samples.where("genetic_id <> ''").groupBy("genetic_id", "version_rank")
    return keyed.agg(F.first("version").alias("version"), F.max_by(F.coalesce("individual_id", F.lit("<NA>")), "row_idx").alias("mid"))


def rename_events(samples: DataFrame) -> DataFrame:
    """One event per row key that changes its entity from a release to the next; neighbours by a window, not a join."""
    w = Window.partitionBy("genetic_id").orderBy("version_rank")
    prior = F.lag(F.struct("version_rank", "version", "mid")).over(w)
    return (
        owners(samples)
        .withColumn("prior", prior)
        .where("prior.version_rank = version_rank - 1 and prior.mid <> mid")
        .select(F.col("prior.version").alias("v_old"), F.col("prior.mid").alias("mid_old"), F.col("version").alias("v_new"), F.col("mid").alias("mid_new"), F.col("genetic_id").alias("via_genetic_id"))
    )


def collisions(events: DataFrame) -> DataFrame:
    """(v_old, mid_old, v_new, mids): entities of a release that lead to several of the next."""
    return events.groupBy("v_old", "mid_old").agg(F.min("v_new").alias("v_new"), F.array_sort(F.collect_set("mid_new")).alias("mids")).where(F.size("mids") > 1)


def check_collisions(events: DataFrame, on_collision: str = "error") -> list[str]:
    """Raise, or return one warning per collision."""
    found = collisions(events).orderBy("v_old", "mid_old")
    if on_collision == "error":
        if first := found.head(1):
            r = first[0]
            raise CollisionError(f"{r['mid_old']!r} of {r['v_old']} leads to {len(r['mids'])} ids: {', '.join(map(repr, r['mids']))}; confirm with a manual bridge or accept it with on_collision='warn'")
        return []
    return [f"{r['mid_old']!r} of {r['v_old']} leads to {', '.join(map(repr, r['mids']))}; they are taken as one individual, named by the last of them in the latest release" for r in found.toLocalIterator()]


def with_overrides(events: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual events added; automatic ones from the same (v_old, mid_old) to elsewhere are dropped, equal ones stay."""
    return kept_events(events, manual).unionByName(manual)


def _against(manual: DataFrame) -> DataFrame:
    return manual.select(*[F.col(c).alias(f"m_{c}") for c in ("v_old", "mid_old", "v_new", "mid_new")])


def _contradicted() -> Column:
    return (F.col("v_old") == F.col("m_v_old")) & (F.col("mid_old") == F.col("m_mid_old")) & ((F.col("mid_new") != F.col("m_mid_new")) | (F.col("v_new") != F.col("m_v_new")))


def kept_events(events: DataFrame, manual: DataFrame) -> DataFrame:
    return events.join(_against(manual), _contradicted(), "left_anti")


def dropped_events(events: DataFrame, manual: DataFrame) -> DataFrame:
    return events.join(_against(manual), _contradicted(), "left_semi")


def canonical_ids(events: DataFrame, versions: Sequence[str]) -> DataFrame:
    """(version, mid, canonical) for every id in an event.

    The canonical id is that of the latest release in its component, of several
    the last in order; releases that aren't among ``versions`` come first.
    """

    def node(version: str, mid: str) -> Column:
        place = F.lit(-1)
        for k, v in enumerate(versions):
            place = F.when(F.col(version) == v, k).otherwise(place)
        return F.struct(place.alias("rank"), F.col(version).alias("version"), F.col(mid).alias("mid"))

    edges = events.select(node("v_old", "mid_old").alias("a"), node("v_new", "mid_new").alias("b"))
    return largest_members(edges).select("node.version", "node.mid", F.col("root.mid").alias("canonical"))


def linked_unchanged(samples: DataFrame) -> DataFrame:
    """Extra events for ids that stay the same from a release to the next, for canonical_ids() to chain over them."""
    w = Window.partitionBy("mid").orderBy("version_rank")
    seen = samples.where("individual_id <> ''").select("version", "version_rank", F.col("individual_id").alias("mid")).distinct()
    prior = seen.withColumn("prior", F.lag(F.struct("version_rank", "version")).over(w)).where("prior.version_rank = version_rank - 1")
    return prior.select(F.col("prior.version").alias("v_old"), F.col("mid").alias("mid_old"), F.col("version").alias("v_new"), F.col("mid").alias("mid_new"), F.lit(None).cast("string").alias("via_genetic_id"))


def with_canonical(rows: DataFrame, bridge: DataFrame, version: str = "version", mid: str = "individual_id") -> DataFrame:
    """``rows`` with a column ``canonical``: the bridge's, or the id itself where it has none.

    Ids in a bridge are few beside rows; Spark broadcasts it while it is small and joins by shuffle beyond.
    """
    b = bridge.select(F.col("version").alias("_bv"), F.col("mid").alias("_bm"), F.col("canonical").alias("_bc"))
    return rows.join(b, (F.col(version) == F.col("_bv")) & (F.col(mid) == F.col("_bm")), "left").withColumn("canonical", F.coalesce("_bc", F.col(mid))).drop("_bv", "_bm", "_bc")


def same_component(events: DataFrame, bridge: DataFrame) -> DataFrame:
    """Events with the canonical ids of both ends, where they agree."""
    left = with_canonical(events, bridge, "v_old", "mid_old").withColumnRenamed("canonical", "canonical_old")
    return with_canonical(left, bridge, "v_new", "mid_new").withColumnRenamed("canonical", "canonical_new").where("canonical_old = canonical_new")


def events_for(events: DataFrame, bridge: DataFrame, ids: DataFrame) -> DataFrame:
    """(version, mid) -> with every event whose both ends are the same individual as that id: one row per id and event."""
    asked = with_canonical(ids, bridge, "version", "mid").select("version", "mid", "canonical")
    own = same_component(events, bridge).withColumnRenamed("canonical_old", "canonical").drop("canonical_new")
    return asked.join(own, "canonical").drop("canonical")
