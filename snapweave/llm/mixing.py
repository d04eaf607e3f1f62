"""Mixing sources to target weights by weighted sampling without replacement, in built-in functions only.

Sources share all tokens by weight; a target stops at ``most_epochs`` times its
source's size and the excess is shared anew. A source takes as many complete
epochs as fit its target, then documents in order of exponential keys
-ln(u) / quality (Efraimidis and Spirakis), until the prefix sum of their sizes
meets the rest of the target; the document on the border gives the words that
are still missing.

No source is sorted as a whole: the keys' images under 1 - exp(-key) fall into
equal ranges, sizes are summed per (source, range), a running sum over those
sums finds the range that holds the border, and only that range is sorted. A
source that holds a third of all rows is thus spread like the others. There
are RANGES ranges and more where rows are many, so a range's rows are bounded
on average. The sources' plan is made in one task over a slim row a source.

A null text has size 0; a null source is a source of its own, last in order.
u comes from the id alone, so reruns agree; rows that repeat an id have one
key, and on the border they share what is missing in proportion to their sizes.
An empty table gives an empty mix; a text of any length is one document, taken
in part only on the border; columns other than those named may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fill, staged

#: Ranges of keys at least, rows a range on average at most, and the bytes of a plan that is broadcast whole.
RANGES, IN_RANGE, MOST_BROADCAST = 1024, 200_000, 64 << 20


def words(text: str | Column) -> Column:
    """How many runs of characters other than space, tab, line breaks and form feeds."""
    return F.regexp_count(fill(text), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def quality(text: str | Column, size: Column) -> Column:
    """A weight of 1 to 3 from the text itself: one more for 20 words or more, one more for words of 3 to 12 characters on average."""
    mean = F.char_length(fill(text)) / F.greatest(size, F.lit(1))
    return F.lit(1.0) + F.when(size >= 20, 1.0).otherwise(0.0) + F.when((mean >= 4) & (mean <= 13), 1.0).otherwise(0.0)


def sampling_key(id_col: str, weight: Column, seed: int) -> Column:
    """-ln(u) / weight, u in (0, 1) from the first 52 bits of an MD5 of id and seed."""
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(str(seed))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / weight


def source_targets(sizes: DataFrame, most_epochs: int = 3) -> DataFrame:
    """(source, source_size) -> with target, epochs and rest: one row per source.

    Sources in order of cap / weight are capped up to the first whose share of
    what is left stays under its cap; that share per weight is everyone else's.
    The windows run over one row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = sizes.withColumn("weight", ((rank - 1) % 3 + 1).cast("double")).withColumn("cap", (F.col("source_size") * most_epochs).cast("double"))
    total = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("weight"), F.col("source").asc_nulls_last())
    before, since = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("heavy", F.sum("weight").over(since))
    level = F.max(F.when(F.col("cap") * F.col("heavy") > F.col("weight") * F.col("left"), F.col("left") / F.col("heavy"))).over(total)
    target = F.coalesce(F.least(F.col("cap"), F.col("weight") * level), F.col("cap"))
    s = s.select("source", "source_size", target.alias("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return s.withColumn("epochs", epochs).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))


def _range(ranges: int) -> Column:
    return F.least(F.floor((1 - F.exp(-F.col("key"))) * ranges), F.lit(ranges - 1)).cast("int")


def borders(sized: DataFrame, targets: DataFrame, ranges: int = RANGES) -> DataFrame:
    """(source, edge_key, edge_id, edge_size, edge_taken): per source with a rest, the document where the prefix sum meets it."""
    tagged = sized.withColumn("range", _range(ranges))
    sums = tagged.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    want = targets.where("rest > 0").select(F.col("source").alias("s2"), "rest")
    by_range = Window.partitionBy("source").orderBy("range")
    held = sums.join(want, F.col("source").eqNullSafe(F.col("s2"))).drop("s2").withColumn("upto", F.sum("in_range").over(by_range))
    held = held.where("upto >= rest and upto - in_range < rest").select(F.col("source").alias("s2"), F.col("range").alias("r2"), (F.col("rest") - F.col("upto") + F.col("in_range")).alias("rest"))
    fine = tagged.join(held, F.col("source").eqNullSafe(F.col("s2")) & (F.col("range") == F.col("r2"))).drop("s2", "r2")
    fine = fine.groupBy("source", "key", "id").agg(F.sum("size").alias("edge_size"), F.first("rest").alias("rest"))
    fine = fine.withColumn("upto", F.sum("edge_size").over(Window.partitionBy("source").orderBy("key", F.col("id").asc_nulls_first())))
    edge = fine.where("upto >= rest and upto - edge_size < rest")
    return edge.select("source", F.col("key").alias("edge_key"), F.col("id").alias("edge_id"), "edge_size", (F.col("rest") - F.col("upto") + F.col("edge_size")).alias("edge_taken"))


def plan_mix(sized: DataFrame, most_epochs: int = 3, ranges: int = RANGES) -> DataFrame:
    """One row per source with target, epochs and border; ``sized`` has id, source, size and key."""
    ranges = max(ranges, sized.count() // IN_RANGE)
    targets = staged(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), most_epochs))
    edges = borders(sized, targets, ranges).withColumnRenamed("source", "s2")
    return staged(targets.join(edges, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2"))


def _planned(rows: DataFrame, plan: DataFrame, source: Column) -> DataFrame:
    """``rows`` with their sources' plans.

    A plan of up to MOST_BROADCAST bytes is broadcast. Of a larger one only the
    largest sources are, those with more than a thousandth of all tokens, and
    the rows of the others shuffle.
    """
    p = plan.withColumnRenamed("source", "plan_source")
    same = source.eqNullSafe(F.col("plan_source"))
    whole = plan.agg(F.sum(F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(0)) + 100).alias("bytes"), F.sum("source_size").alias("size")).first()
    if (whole["bytes"] or 0) <= MOST_BROADCAST:
        return rows.join(F.broadcast(p), same)
    large = F.broadcast(p.where(F.col("source_size") * 1000 > whole["size"]))
    return rows.join(large, same).unionByName(rows.join(large, same, "left_anti").join(p, same))


def apply_plan(rows: DataFrame, plan: DataFrame, source: Column, id_: Column, key: Column, size: Column) -> DataFrame:
    """``rows`` with source_size, target and taken."""
    earlier = (key < F.col("edge_key")) | ((key == F.col("edge_key")) & F.coalesce(id_ < F.col("edge_id"), id_.isNull() & F.col("edge_id").isNotNull()))
    share = F.floor(F.col("edge_taken") * size / F.greatest(F.col("edge_size"), F.lit(1)))
    part = F.when(F.col("edge_key").isNull(), 0).when(earlier, size).when((key == F.col("edge_key")) & id_.eqNullSafe(F.col("edge_id")), share).otherwise(0)
    return _planned(rows, plan, source).withColumn("taken", (F.col("epochs") * size + part).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, most_epochs: int = 3) -> DataFrame:
    """One row per document: id_col, size, source_size, target, taken. The texts are read once."""
    size = words(text_col)
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).withColumn("size", size if text_col == "text" else words("text"))
    sized = staged(base.withColumn("key", sampling_key("id", quality("text", F.col("size")), seed)).select("id", "source", "size", "key"))
    out = apply_plan(sized, plan_mix(sized, most_epochs), F.col("source"), F.col("id"), F.col("key"), F.col("size"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def sample_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, most_epochs: int = 3) -> DataFrame:
    """The mix itself: every document as often as it is taken, all its columns. A border document stays if at least half of it is taken.

    Texts aren't shuffled: a row's key against its source's border decides.
    """
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    keyed = row.withColumns({"id": F.col(f"row.`{id_col}`"), "source": F.col(f"row.`{source_col}`"), "size": words(F.col(f"row.`{text_col}`"))})
    keyed = keyed.withColumn("key", sampling_key("id", quality(F.col(f"row.`{text_col}`"), F.col("size")), seed))
    sized = staged(keyed.select("id", "source", "size", "key"))
    out = apply_plan(keyed, plan_mix(sized, most_epochs), F.col("source"), F.col("id"), F.col("key"), F.col("size"))
    times = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    return out.withColumn("times", times).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
