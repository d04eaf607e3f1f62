"""Connected components over any ordered key, the largest member of each as its root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, written

#: As many edges, a few MB, may be gathered on the driver and sent back, as a broadcast table of that size would be.
FEW_EDGES = 50_000


def largest_members(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW_EDGES) -> DataFrame:
    """(node, root) for every node of an edge; ``a`` and ``b`` may be structs, ordered as Spark orders them.

    At most ``few`` distinct edges are joined on the driver, in one job. More
    take large and small stars by turns, towards the largest key: the rounds
    grow with the logarithm of the longest path, and each writes its edges to
    the shared folder. A forest of stars, the usual case, needs no round.
    """
    slim = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("v <> u").distinct()
    near = slim.limit(few + 1).collect()
    return _united(slim, near) if len(near) <= few else _starred(slim)


def _united(slim: DataFrame, edges: list) -> DataFrame:
    """Union-find over a few edges; the result is as small, so joins may broadcast it."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for e in edges:
        low, high = sorted((root(e["v"]), root(e["u"])))
        up[low] = high
    kind = slim.schema["v"].dataType.simpleString()
    return F.broadcast(slim.sparkSession.createDataFrame([(x, root(x)) for x in up], f"node {kind}, root {kind}"))


def _starred(slim: DataFrame) -> DataFrame:
    e = written(slim)
    while not _stars(e):
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).union(e.select("u", "v"))
        top = both.groupBy("x").agg(F.max("y").alias("m")).select("x", F.greatest("x", "m").alias("m"))
        large = both.join(top, "x").where("y < x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        best = large.groupBy("v").agg(F.max("u").alias("m"))
        small = large.join(best, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        last, e = e, written(small.union(best.select("v", F.col("m").alias("u"))).where("v <> u").distinct())
        discard(last)
    roots = e.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.union(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether every node points to one other and no node that is pointed to points on."""
    seen = e.select(F.col("v").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("u", F.lit(0), F.lit(1)))
    bad = seen.groupBy("x").agg(F.sum("out").alias("o"), F.sum("into").alias("i")).where("o > 1 or (o > 0 and i > 0)")
    return bad.isEmpty()


def united(nodes: str | Column, edges: str | Column) -> Column:
    """Per row, for an array of nodes and one of edges (structs a, b of nodes): each node's root, in the nodes' order. For short arrays: its time is the product of their lengths."""
    nodes = F.col(nodes) if isinstance(nodes, str) else nodes

    def join(roots: Column, e: Column) -> Column:
        at = lambda x: F.element_at(roots, F.array_position(nodes, x).cast("int"))
        a, b = at(e["a"]), at(e["b"])
        return F.when(a == b, roots).otherwise(F.transform(roots, lambda r: F.when(r == F.least(a, b), F.greatest(a, b)).otherwise(r)))

    return F.aggregate(edges, nodes, join)
