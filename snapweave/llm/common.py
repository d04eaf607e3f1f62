"""What the operators of this subpackage share: scratch tables, components, streaming of groups.

Functions here that run in Python workers are pickled by value, so executors
need no copy of this package.
"""

from __future__ import annotations

import atexit
import contextlib
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_SCRATCH: dict[str, SparkSession] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; where that is unset a temporary one, in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="snapweave-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def staged(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors. A folder per value of ``by``."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/staged-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _SCRATCH[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def done_with(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        _delete(df._staged_at)


def _delete(path: str) -> None:
    spark = _SCRATCH.pop(path)
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release_scratch() -> None:
    """Delete every table that staged() has written; results that still read them must be saved before."""
    for path in list(_SCRATCH):
        _delete(path)


atexit.register(release_scratch)


def for_python(df: DataFrame) -> DataFrame:
    """``df``, about to be read by Python workers: batches of at most 8 MB instead of Spark's 64, unless the session says otherwise."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, None) == "67108864b":
        conf.set(BATCH_CONF, "8m")
    return df


def trimmed(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over a partition's batches; afterwards the worker, which waits for other tasks, gives free memory back."""

    def run(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        yield from work(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def per_process(key: str, make: Callable):
    """One value per Python worker process, kept from task to task."""
    store = sys.modules.setdefault("_snapweave_store", types.ModuleType("_snapweave_store"))
    if not hasattr(store, key):
        setattr(store, key, make())
    return getattr(store, key)


def unused(names: list[str], wanted: str) -> str:
    """A column name that isn't among ``names``, whatever their case."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def fill(text: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


#: Fewer than this many groups can each hold more than one part in this many of all rows.
HOT_GROUPS = 1000


def with_totals(rows: DataFrame, totals: DataFrame, keys: list[str], size: str, n_rows: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with one row per group of them, of which ``size`` tells the rows.

    Groups of more than n_rows / HOT_GROUPS rows are fewer than HOT_GROUPS: the
    hashes of their keys are known to the driver, their totals are broadcast
    and their rows stay where they are. Only rows of smaller groups shuffle,
    and none of those groups is a task's burden.
    """
    totals = staged(totals)
    at = F.xxhash64(*keys)
    hot = [r[0] for r in totals.where(F.col(size) * HOT_GROUPS > n_rows).select(at).distinct().collect()]
    if not hot:
        return rows.join(totals, keys, how)
    near, far = at.isin(hot), ~at.isin(hot)
    return rows.where(near).join(F.broadcast(totals.where(near)), keys, how).unionByName(rows.where(far).join(totals.where(far), keys, how))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components as (id, root), root the smallest id; ids without an edge are absent.

    Alternating large and small stars over a slim edge table: each round is a
    few shuffles of two longs, is written to the shared folder, and the rounds
    grow with the logarithm of the longest path. Nothing reaches the driver
    but a count and a checksum per round.
    """

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()

    e = staged(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("v <> u").distinct())
    seen = state(e)
    while seen[0]:
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).union(e.select("u", "v"))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", F.col("m").alias("u")))
        last, e = e, staged(small.distinct())
        done_with(last)
        now = state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("v").alias("id"), F.col("u").alias("root"))


def runs(batches: Iterator, keys: list[str]) -> Iterator:
    """Pandas frames of one key each, from batches of a partition that is sorted by the keys."""
    import numpy as np
    import pandas as pd

    held: list = []
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), bool)
        for k in keys:
            v = pdf[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(pdf)]
        for s, t in zip(cuts, cuts[1:], strict=False):
            part = pdf.iloc[s:t]
            key = tuple(part[k].iloc[0] for k in keys)
            if held and key != last:
                yield held[0] if len(held) == 1 else pd.concat(held)
                held = []
            held.append(part)
            last = key
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held)


class Forest:
    """Union-find over 0..n-1, the smallest index as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True
