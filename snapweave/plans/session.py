"""Releases made ready for queries: one frame with canonical ids, and the bridge behind them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import bridge as B
from ..runtime import written
from ..sources.releases import Release, ranked_labels, read_bridge, samples_of


@dataclass
class Bridged:
    """``versions`` in order; ``samples`` with ``canonical``; ``events`` and the map they give."""

    spark: SparkSession
    releases: list[Release]
    versions: list[str]
    samples: DataFrame
    events: DataFrame
    bridge: DataFrame
    manual_count: int = 0
    warnings: list[str] = field(default_factory=list)


def bridged(spark: SparkSession, releases: Sequence[Release], on_collision: str = "error", manual_path: str | None = None, link_unchanged: bool = False) -> Bridged:
    """Detect renames, lay manual events over them, and give every row its individual's canonical id.

    ``link_unchanged`` also chains ids that stay the same over several
    releases; without it an id is tied to others by renames alone.
    """
    rows = samples_of(releases)
    versions = ranked_labels([r.label for r in releases])
    notes: list[str] = []
    events = written(B.rename_events(rows))
    notes += B.check_collisions(events, on_collision)
    manual_count = 0
    if manual_path is not None:
        entries = read_bridge(spark, manual_path)
        manual = spark.createDataFrame(entries, B.EVENTS)
        manual_count = len(entries)
        for r in B.dropped_events(events, manual).orderBy("v_old", "mid_old", "via_genetic_id").toLocalIterator():
            notes.append(f"the manual bridge overrides {r['mid_old']!r} ({r['v_old']}) -> {r['mid_new']!r} ({r['v_new']}), seen by {r['via_genetic_id']!r}")
        events = B.with_overrides(events, manual)
    edges = events.unionByName(B.linked_unchanged(rows)) if link_unchanged else events
    bridge = B.canonical_ids(edges, versions)
    return Bridged(spark, list(releases), versions, B.with_canonical(rows, bridge), events, bridge, manual_count, notes)
