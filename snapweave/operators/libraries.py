"""Libraries: row keys of one individual that stand for the same thing in several releases.

Three kinds of edge tie keys of an individual: the same key in any two
releases; rule A, a bare key that gets a suffix in the next release, where
neither release knows the stem in the other form and just one new row has it;
rule B, a suffix class (no suffix is one) with a single row in both of two
neighbouring releases and different stems. A component is named by the last
key of its latest release.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import SUFFIXES, stem, suffix
from ..runtime import written
from .components import largest_members, united

#: Individuals of up to as many rows have their components found within a row of arrays.
FEW_ROWS = 64
PREFERENCE = (*SUFFIXES, "bare")


def entries(samples: DataFrame) -> DataFrame:
    """Keys of individuals: canonical, version, version_rank, gid, rows (how many), stem, suffix; rows that repeat are counted before the shuffle."""
    rows = samples.where("individual_id <> '' and genetic_id <> ''").withColumnRenamed("genetic_id", "gid")
    gid = F.col("gid")
    return rows.groupBy("canonical", "gid", "version_rank", "version").agg(F.count("*").alias("rows")).withColumns({"stem": stem(gid), "suffix": suffix(gid)})


def key_nodes(rows: DataFrame) -> DataFrame:
    """``rows``, an individual's in one task, with ``node``: canonical id, latest release of the key, and the key, ordered in this way."""
    top = F.max(F.struct("version_rank", "version")).over(Window.partitionBy("canonical", "gid"))
    return rows.repartition("canonical").withColumn("top", top).withColumn("node", F.struct("canonical", "top.version_rank", "top.version", "gid")).drop("top")


def key_edges(rows: DataFrame) -> DataFrame:
    """(a, b): nodes tied by rules A and B. Neighbouring releases meet in windows; rows are counted, not keys."""
    bare, dressed = F.col("suffix").isNull(), F.col("suffix").isNotNull()
    by_stem = rows.groupBy("canonical", "stem", "version_rank").agg(
        F.sum(F.when(bare, F.col("rows")).otherwise(0)).alias("bare"), F.sum(F.when(dressed, F.col("rows")).otherwise(0)).alias("dressed"), F.max(F.when(bare, F.col("node"))).alias("bare_node"), F.max(F.when(dressed, F.col("node"))).alias("dressed_node")
    )
    w = Window.partitionBy("canonical", "stem").orderBy("version_rank")
    rule_a = by_stem.withColumn("o", F.lag(F.struct("version_rank", "bare", "dressed", "bare_node")).over(w)).where(
        "o.version_rank = version_rank - 1 and o.bare > 0 and o.dressed = 0 and bare = 0 and dressed = 1"
    )
    by_suffix = rows.groupBy("canonical", "suffix", "version_rank").agg(F.sum("rows").alias("n"), F.min("node").alias("node"), F.min("stem").alias("stem"))
    w = Window.partitionBy("canonical", "suffix").orderBy("version_rank")
    rule_b = by_suffix.withColumn("o", F.lag(F.struct("version_rank", "n", "node", "stem")).over(w)).where("o.version_rank = version_rank - 1 and o.n = 1 and n = 1 and o.stem <> stem")
    return rule_a.select(F.col("o.bare_node").alias("a"), F.col("dressed_node").alias("b")).union(rule_b.select("o.node", "node"))


def _named_within(rows: DataFrame) -> DataFrame:
    """``rows`` with their tokens, of individuals with few rows: no edge leaves an individual, so each is a row of arrays."""
    kept = F.struct("version", "version_rank", "gid", "node")
    edge = F.struct("a", "b")
    edges = key_edges(rows).select(F.col("a.canonical").alias("canonical"), edge.alias("e"))
    each = rows.select("canonical", kept.alias("r"), F.lit(None).cast(edges.schema["e"].dataType).alias("e")).union(edges.select("canonical", F.lit(None), "e"))
    one = each.groupBy("canonical").agg(F.collect_list("r").alias("r"), F.collect_set("e").alias("e"))
    one = one.withColumn("nodes", F.array_distinct("r.node")).withColumn("roots", united("nodes", "e"))
    token = lambda x: F.element_at("roots", F.array_position("nodes", x["node"]).cast("int"))["gid"]
    named = F.transform("r", lambda x: F.struct(x["version"].alias("version"), x["version_rank"].alias("version_rank"), x["gid"].alias("gid"), token(x).alias("token")))
    return one.select("canonical", F.inline(named))


def _named_between(rows: DataFrame) -> DataFrame:
    """The same of individuals of any size."""
    roots = largest_members(key_edges(rows)).select(F.col("node.canonical").alias("canonical"), F.col("node.gid").alias("gid"), F.col("root.gid").alias("root_gid"))
    return rows.join(roots, ["canonical", "gid"], "left").select("canonical", "version", "version_rank", "gid", F.coalesce("root_gid", "gid").alias("token"))


def library_tokens(samples: DataFrame, few: int = FEW_ROWS) -> DataFrame:
    """(canonical, token, version, version_rank, gid, chain_status): one row per library and release it is in.

    Individuals with more than ``few`` rows, if there are any, take the way that bounds no individual's size.
    """
    keys = entries(samples)
    large = samples.where("individual_id <> '' and genetic_id <> ''").groupBy("canonical").count().where(F.col("count") > few).select("canonical")
    if large.isEmpty():
        named = _named_within(key_nodes(keys))
    else:
        large = written(large)
        named = _named_within(key_nodes(keys.join(large, "canonical", "left_anti"))).union(_named_between(key_nodes(keys.join(large, "canonical", "left_semi"))))
    per = named.groupBy("canonical", "token", "version", "version_rank").agg(F.min("gid").alias("gid"), (F.min("gid") != F.max("gid")).alias("several"))
    w = Window.partitionBy("canonical", "token")
    status = F.when(F.max("several").over(w), "ambiguous").when(F.count("*").over(w) > 1, "chained").otherwise("orphan")
    return per.withColumn("chain_status", status).drop("several")


def collapsed(tokens: DataFrame, preference: Sequence[str] = PREFERENCE) -> DataFrame:
    """(canonical, version, version_rank, gid): of an individual's libraries the preferred one per release."""
    kind = F.coalesce(suffix(F.col("gid")), F.lit("bare"))
    place = F.array_position(F.array(*map(F.lit, preference)), kind) if preference else F.lit(0)
    rank = F.when(place == 0, len(preference) + 1).otherwise(place)
    return tokens.groupBy("canonical", "version", "version_rank").agg(F.min_by(F.struct("gid", "token"), F.struct(rank, F.col("gid"))).alias("won")).select("canonical", "version", "version_rank", "won.gid", "won.token")


def dropped_tokens(tokens: DataFrame, chosen: DataFrame) -> DataFrame:
    """(canonical, token): libraries that were preferred in no release."""
    return tokens.select("canonical", "token").distinct().join(chosen.select("canonical", "token").distinct(), ["canonical", "token"], "left_anti")
