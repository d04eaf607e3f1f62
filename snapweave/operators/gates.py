"""Gates: rates and counts against thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bridge import with_canonical
from .manifest import prefix

TURNOVER = (0.05, 0.30)
COVERAGE = (0.50, 0.25)


def state_at_least(rate: Column, warn: float, fail: float) -> Column:
    """fail from ``fail`` on, warn from ``warn`` on."""
    return F.when(rate >= fail, "fail").when(rate >= warn, "warn").otherwise("pass")


def state_below(rate: Column, warn: float, fail: float) -> Column:
    return F.when(rate < fail, "fail").when(rate < warn, "warn").otherwise("pass")


def turnover(rates: DataFrame, warn: float = TURNOVER[0], fail: float = TURNOVER[1]) -> DataFrame:
    """A diff's rates -> removal_rate and state."""
    return rates.select("removal_rate", state_at_least(F.col("removal_rate"), warn, fail).alias("state"))


def cohort_turnover(manifest: DataFrame, versions: Sequence[str], warn: float = TURNOVER[0], fail: float = TURNOVER[1]) -> DataFrame:
    """(seq, v_old, v_new, removal_rate, state) per neighbouring pair: individuals in the old release that the new one lacks."""
    if len(versions) < 2:
        return manifest.sparkSession.createDataFrame([], "seq int, v_old string, v_new string, removal_rate double, state string")
    has = manifest.groupBy("individual_id_canonical").agg(*[F.max(F.col(f"{prefix(v)}_genetic_id").isNotNull()).alias(f"h{k}") for k, v in enumerate(versions)])
    pairs = list(zip(range(len(versions)), versions, versions[1:], strict=False))
    sums = has.agg(*[F.count_if(f"h{k}").alias(f"in{k}") for k, _, _ in pairs], *[F.count_if(F.col(f"h{k}") & ~F.col(f"h{k + 1}")).alias(f"gone{k}") for k, _, _ in pairs])
    rows = F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(a).alias("v_old"), F.lit(b).alias("v_new"), F.col(f"in{k}").alias("n"), F.col(f"gone{k}").alias("gone")) for k, a, b in pairs])
    rate = F.when(F.col("n") == 0, 0.0).otherwise(F.col("gone") / F.greatest(F.col("n"), F.lit(1)))
    return sums.select(F.inline(rows)).select("seq", "v_old", "v_new", rate.alias("removal_rate")).withColumn("state", state_at_least(F.col("removal_rate"), warn, fail))


def cohort_coverage(cohort: DataFrame, manifest: DataFrame, bridge: DataFrame, cohort_version: str, warn: float = COVERAGE[0], fail: float = COVERAGE[1], absent: str = "not_in_any_supplied_version") -> DataFrame:
    """(resolved, requested, coverage, state): inputs whose individual is in any release; none requested is full coverage."""
    there = manifest.where(F.col("status") != absent).select(F.col("individual_id_canonical").alias("canonical"), F.lit(1).alias("hit")).distinct()
    asked = with_canonical(cohort.withColumn("_v", F.lit(cohort_version)), bridge, "_v").join(there, "canonical", "left")
    n = asked.agg(F.count("hit").alias("resolved"), F.count("*").alias("requested"))
    n = n.withColumn("coverage", F.when(F.col("requested") == 0, 1.0).otherwise(F.col("resolved") / F.greatest(F.col("requested"), F.lit(1))))
    return n.withColumn("state", state_below(F.col("coverage"), warn, fail))


def substantive_regroup(changes: DataFrame, threshold: int | None = None) -> DataFrame:
    """(n_events, state): fails over the threshold, passes without one."""
    n = changes.agg(F.count_if(F.col("change_class") == "substantive_regroup").alias("n_events"))
    over = F.lit(False) if threshold is None else F.col("n_events") > threshold
    return n.withColumn("state", F.when(over, "fail").otherwise("pass"))


def presence_histogram(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count("*").alias("n_rows"))
