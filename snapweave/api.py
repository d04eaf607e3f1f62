"""The library's entry points for other programs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import lookup as L
from .plans.session import Bridged, bridged
from .sources.releases import Release, read_release


def _ready(spark: SparkSession, src: str, dst: str, releases: Mapping[str, Release] | None, paths: Mapping[str, str] | None, manual_path: str | None, on_collision: str) -> Bridged:
    """All releases given take part in the bridge, not only the two asked about."""
    if releases is None and paths is None:
        raise ValueError("give releases or paths")
    given = dict(releases) if releases is not None else {label: read_release(spark, path, label=label) for label, path in paths.items()}
    for label in (src, dst):
        if label not in given:
            raise KeyError(label)
    return bridged(spark, list(given.values()), on_collision, manual_path)


def resolve_master_ids(spark: SparkSession, ids: Sequence[str], src: str, dst: str, releases: Mapping[str, Release] | None = None, paths: Mapping[str, str] | None = None, manual_path: str | None = None, on_collision: str = "error") -> dict[str, str | None]:
    """Individual ids of ``src`` -> the first row key of each in ``dst``, None where it has none."""
    ready = _ready(spark, src, dst, releases, paths, manual_path, on_collision)
    asked = spark.createDataFrame([(x,) for x in ids], "individual_id string")
    found = {r["individual_id"]: r["genetic_id"] for r in L.translate_individuals(asked, ready.bridge, src, ready.samples.where(F.col("version") == dst)).collect()}
    return {x: found[x] for x in ids}


def resolve_genetic_ids(spark: SparkSession, ids: Sequence[str], src: str, dst: str, releases: Mapping[str, Release] | None = None, paths: Mapping[str, str] | None = None, manual_path: str | None = None, on_collision: str = "error") -> dict[str, list[str]]:
    """Row keys of ``src`` -> the row keys of the same individual in ``dst``."""
    ready = _ready(spark, src, dst, releases, paths, manual_path, on_collision)
    asked = spark.createDataFrame([(x,) for x in ids], "genetic_id string")
    side = lambda v: ready.samples.where(F.col("version") == v)
    found = {r["genetic_id"]: list(r["genetic_ids"]) for r in L.translate_keys(asked, side(src), side(dst)).collect()}
    return {x: found[x] for x in ids}
