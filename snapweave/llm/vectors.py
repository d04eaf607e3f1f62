"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A table rotates a unit vector by three rounds of random signs and Hadamard
transforms, twice over, and takes the nearest of the 2d signed axes each time;
the two axes name a bucket. A vector resides in its own bucket and visits the
``probes - 1`` next nearest ones; a resident meets residents and visitors of
its bucket.

Equal vectors are one point with a count. What meets in buckets are slim rows:
a point's number and 128 signs of its rotated coordinates. Two points are
candidates if they meet and their signs differ in no more places than those of
a pair at the threshold could, but for a chance of some 1e-9; of each bucket
only a spanning forest of candidates is told. Whole vectors are then sent

- once to their group of candidates, where that has at most ``BLOCK`` points:
  all its pairs are verified there;
- to the buckets in which they have candidates, where it has more: a pair that
  meets several times counts at its first meeting only, which both points'
  bucket codes tell.

Buckets and groups are compared in blocks of at most ``BLOCK`` points, so one
of any size is many small tasks; a comparison returns counts and a spanning
forest, never pairs.

At a cosine of exactly 0.93 a pair in 64 dimensions is missed with a chance of
some 1e-4, closer pairs less. Vectors of different lengths or labels don't
meet. Vectors that are null, empty, zero or hold null or non-finite components,
and rows without label or id, link with nothing. Rows that repeat an id each
get a row, with the links of the one that has most and one component for all.
An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, done_with, for_python, runs, staged, trimmed, with_totals

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TABLES, PROBES, BLOCK = 10, 3, 1024


def hadamard(x):
    """Fast Walsh-Hadamard transform of rows, orthonormal; the width is a power of two."""
    import numpy as np

    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, -1, 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2).reshape(n, d)
        h *= 2
    return x / d**0.5


def bucket_codes(x, tables: int = TABLES, probes: int = PROBES, seed: int = 5):
    """(int32 [rows, tables, probes], int64 [rows, 2]): each table's nearest buckets, its own first, and 128 signs."""
    import numpy as np

    n, d = x.shape
    wide = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, wide - d)))
    rng, near = np.random.default_rng(seed), min(max(probes, 2), 2 * wide)
    out, signs, row = np.empty((n, tables, probes), np.int32), [], np.arange(n)
    for t in range(tables):
        axes, gaps = [], []
        for _ in range(2):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice((-1.0, 1.0), wide))
            if 64 * len(signs) < 128 * 64 // min(wide, 64):
                signs.append(y[:, :64] > 0)
            y = np.concatenate((y, -y), 1)
            order, value = np.empty((n, near), np.int64), np.empty((n, near))
            for k in range(near):
                order[:, k] = y.argmax(1)
                value[:, k] = y[row, order[:, k]]
                y[row, order[:, k]] = -np.inf
            axes.append(order)
            gaps.append((value[:, :1] - value) ** 2)
        cost = (gaps[0][:, :, None] + gaps[1][:, None, :]).reshape(n, -1)
        best = np.argsort(cost, 1, kind="stable")[:, :probes]
        out[:, t] = np.take_along_axis(axes[0], best // near, 1) * (2 * wide) + np.take_along_axis(axes[1], best % near, 1)
    bits = np.concatenate(signs, 1)[:, :128]
    bits = np.packbits(np.pad(bits, ((0, 0), (0, 128 - bits.shape[1]))), 1)
    return out, np.ascontiguousarray(bits).view(np.int64)


def most_apart(least: float) -> int:
    """In how many of 128 signs a pair at the threshold may differ: seven standard deviations over the mean."""
    import math

    q = math.acos(max(-1.0, min(1.0, least))) / math.pi
    return min(128, int(128 * q + 7 * math.sqrt(128 * q * (1 - q))) + 1)


def _code_type(d: int) -> str:
    """Codes below (2 x width)^2, the width the next power of two."""
    return "<u2" if d <= 128 else "<i4"


HASHED = "id long, label string, g long, d int, f1 long, f2 long, s1 long, s2 long, codes binary, vector binary"


def _hashes(rows: DataFrame, tables: int, probes: int, kind: str) -> DataFrame:
    """One row per input row; d is 0 for vectors that link with nothing. Equal vectors have equal (g, d, f1, f2)."""

    def hashed(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pandas as pd

        for pdf in batches:
            n = len(pdf)
            d = np.array([0 if v is None else len(v) for v in pdf["vector"]], np.int32)
            f, s, codes, vector = np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64), [None] * n, [None] * n
            for length in np.unique(d[d > 0]):
                at = np.flatnonzero(d == length)
                raw = np.stack([pdf["vector"].iloc[k] for k in at]).astype(kind) + 0.0  # no negative zeros
                c, s[at] = bucket_codes(raw.astype(np.float64), tables, probes)
                c = c.astype(_code_type(int(length)))
                for k, v, x in zip(at, raw, c, strict=True):
                    vector[k], codes[k] = v.tobytes(), x.tobytes()
                    f[k] = np.frombuffer(hashlib.blake2b(vector[k], digest_size=16).digest(), np.int64)
            yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "g": pdf["g"], "d": d, "f1": f[:, 0], "f2": f[:, 1], "s1": s[:, 0], "s2": s[:, 1], "codes": codes, "vector": vector})

    return for_python(rows).mapInPandas(trimmed(hashed), HASHED)


def bucket_keys(g, d, table, code):
    """int64 keys of buckets: a mix of label, length, table and code."""
    import numpy as np

    def mix(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    whole = lambda x: np.asarray(x, np.int64).view(np.uint64)
    base = mix(whole(g) + whole(d) * np.uint64(0x9E3779B97F4A7C15))
    return mix(base ^ mix((whole(table) << np.uint64(40)) + whole(code) + np.uint64(1))).view(np.int64)


def _bucketed(points: DataFrame, tables: int, probes: int) -> DataFrame:
    """(key, p, own, s1, s2): every bucket that a point is in; keys differ by label, length, table and code."""

    def spread(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        each = tables * probes
        for pdf in batches:
            if not len(pdf):
                continue
            again = lambda c: np.repeat(pdf[c].to_numpy(), each)  # noqa: B023, E731
            codes = np.concatenate([np.frombuffer(c, _code_type(d)).astype(np.int64) for c, d in zip(pdf["codes"], pdf["d"], strict=True)])
            key = bucket_keys(again("g"), again("d"), np.tile(np.repeat(np.arange(tables), probes), len(pdf)), codes)
            yield pd.DataFrame({"key": key, "p": again("p"), "own": np.tile(np.arange(each) % probes == 0, len(pdf)), "s1": again("s1"), "s2": again("s2")})

    return for_python(points.select("p", "g", "d", "s1", "s2", "codes")).mapInPandas(trimmed(spread), "key long, p long, own boolean, s1 long, s2 long")


TILE = ["key", "ti", "tj"]


def tiles(rows: DataFrame, block: int) -> DataFrame:
    """Rows with (key, n) -> (key, ti, tj, side): each block of a key with itself and with every other block of it."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    cut = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("p"), F.col("blocks")).cast("int"))
    other = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select("*", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"), (F.col("block") > F.col("other")).cast("int").alias("side")).drop("n", "blocks", "block", "other")


def forest(hit):
    """Per row of a symmetric boolean matrix the smallest index that it reaches."""
    import numpy as np

    root = np.arange(len(hit))
    open_ = hit.any(1)
    for k in np.flatnonzero(open_):
        if open_[k]:
            front, open_[k] = np.array([k]), False
            while len(front):
                front = np.flatnonzero(hit[front].any(0) & open_)
                open_[front], root[front] = False, k
    return root


def close_signs(s, own, side, two: bool, apart: int):
    """Boolean matrix of the candidates among rows of one tile, of two blocks or one."""
    import numpy as np

    hit = np.empty((len(s), len(s)), bool)
    for k in range(0, len(s), 128):
        hit[k : k + 128] = np.bitwise_count(s[k : k + 128, None, 0] ^ s[None, :, 0]).astype(np.int16) + np.bitwise_count(s[k : k + 128, None, 1] ^ s[None, :, 1]) <= apart
    hit &= own[:, None] | own[None, :]
    if two:
        hit &= side[:, None] != side[None, :]
    np.fill_diagonal(hit, False)
    return hit


def mates_of(group, s, own, side, two, apart: int):
    """Per row the first row of its group (equal numbers, adjacent) that candidates lead to, and whether it has any. Small groups are compared all at once, by distance."""
    import numpy as np

    n = len(group)
    root, some = np.arange(n), np.zeros(n, bool)
    cuts = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [n])) if n else np.zeros(1, int)
    size = np.diff(cuts)
    large = np.repeat(size > 64, size)
    left, right = [], []
    at, lag = np.flatnonzero(~large), 1
    while len(at):
        at = at[at + lag < n]
        at = at[group[at + lag] == group[at]]
        i, j = at, at + lag
        hit = np.bitwise_count(s[i, 0] ^ s[j, 0]).astype(np.int16) + np.bitwise_count(s[i, 1] ^ s[j, 1]) <= apart
        hit &= (own[i] | own[j]) & ((side[i] != side[j]) | ~two[i])
        left.append(i[hit])
        right.append(j[hit])
        lag += 1
    if left:
        i, j = np.concatenate(left), np.concatenate(right)
        some[i] = some[j] = True
        while len(i):
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            if (new == root).all():
                break
            root = new
    for k in np.flatnonzero(size > 64):
        part = slice(cuts[k], cuts[k + 1])
        hit = close_signs(s[part], own[part], side[part], bool(two[cuts[k]]), apart)
        root[part], some[part] = forest(hit) + cuts[k], hit.any(1)
    return root, some


def _candidates(slim: DataFrame, apart: int) -> DataFrame:
    """(p, mate, key, ti, tj, side, own) of tiles' rows that have candidates; mates span the tile's groups."""

    def met(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        held = None
        for pdf in batches_with_end(batches):
            last = pdf is None
            pdf = held if last else pdf if held is None else pd.concat((held, pdf), ignore_index=True)
            if pdf is None or not len(pdf):
                continue
            keys = pdf[TILE].to_numpy()
            group = np.concatenate(([0], np.cumsum((keys[1:] != keys[:-1]).any(1))))
            end = len(pdf) if last else int(np.searchsorted(group, group[-1]))
            held = pdf.iloc[end:]
            pdf, group = pdf.iloc[:end], group[:end]
            root, some = mates_of(group, pdf[["s1", "s2"]].to_numpy().astype(np.int64).view(np.uint64), pdf["own"].to_numpy(bool), pdf["side"].to_numpy(), (pdf["ti"] != pdf["tj"]).to_numpy(), apart)
            yield pdf.assign(mate=pdf["p"].to_numpy()[root])[some][["p", "mate", *TILE, "side", "own"]]

    return for_python(slim).repartition(*TILE).sortWithinPartitions(*TILE).mapInPandas(trimmed(met), "p long, mate long, key long, ti int, tj int, side int, own boolean")


def batches_with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _unit(vectors, d: int):
    """Rows of float64 and unit length from their bytes."""
    import numpy as np

    kind = "<f4" if len(vectors.iloc[0]) == 4 * d else "<f8"
    x = np.frombuffer(b"".join(vectors), kind).reshape(-1, d).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare_group(pdf, least: float):
    """[(points, ids, counts, roots)] of one group of candidates, all pairs of equal label and length; a root is the smallest id of what hangs together."""
    import numpy as np

    found = []
    for (d, _), part in pdf.groupby(["d", "label"], sort=False):
        if len(part) > 1:
            x, n = _unit(part["vector"], int(d)), part["n"].to_numpy()
            hit = x @ x.T >= least
            np.fill_diagonal(hit, False)
            found.append(_told(part, hit.astype(np.float64) @ n, forest_by_id(hit, part["id"].to_numpy())))
    return found


def forest_by_id(hit, ids):
    """Per row the position of the smallest id it reaches."""
    import numpy as np

    order = np.argsort(ids, kind="stable")
    root = np.empty(len(ids), int)
    root[order] = order[forest(hit[order][:, order])]
    return root


def _told(part, counts, root):
    import numpy as np

    some, ids = counts > 0, part["id"].to_numpy()
    return part["p"].to_numpy()[some], ids[some], np.asarray(counts)[some].astype(np.int64), ids[root][some]


def compare_tile(pdf, tables: int, probes: int, least: float):
    """The same of one tile of a bucket, for pairs that meet in it first."""
    import numpy as np

    found, two = [], bool(pdf["ti"].iloc[0] != pdf["tj"].iloc[0])
    for (d, _), part in pdf.groupby(["d", "label"], sort=False):
        x = _unit(part["vector"], int(d))
        codes = np.frombuffer(b"".join(part["codes"]), _code_type(int(d))).reshape(-1, tables, probes)
        own, n, side = part["own"].to_numpy(bool), part["n"].to_numpy(), part["side"].to_numpy()
        hit = np.triu((x @ x.T >= least) & (own[:, None] | own[None, :]), 1)
        if two:
            hit &= side[:, None] != side[None, :]
        i, j = np.nonzero(hit)
        for s in range(0, len(i), 50_000):
            at, to = i[s : s + 50_000], j[s : s + 50_000]
            p, q, r = codes[at], codes[to], np.arange(len(at))
            in_q, in_p = (p[:, :, :1] == q).any(2), (q[:, :, :1] == p).any(2)
            first = np.argmax(in_q | in_p, 1)
            p, q, in_q, in_p = p[r, first, 0], q[r, first, 0], in_q[r, first], in_p[r, first]
            where = np.where(in_q & in_p, np.minimum(p, q), np.where(in_q, p, q))
            other = bucket_keys(np.repeat(part["g"].to_numpy()[:1], len(at)), np.full(len(at), d), first, where) != part["key"].iloc[0]
            hit[at[other], to[other]] = False
        hit |= hit.T
        found.append(_told(part, hit.astype(np.float64) @ n, forest_by_id(hit, part["id"].to_numpy())))
    return found


def _compare(rows: DataFrame, keys: list[str], compare) -> DataFrame:
    def compared(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        out: list = []
        for pdf in runs(batches, keys):
            if len(pdf) > 1:
                out += compare(pdf)
            if len(out) >= 500:
                yield pd.DataFrame(dict(zip(("p", "id", "links", "root"), map(np.concatenate, zip(*out, strict=True)), strict=True)))
                out = []
        if out:
            yield pd.DataFrame(dict(zip(("p", "id", "links", "root"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return for_python(rows).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(trimmed(compared), "p long, id long, links long, root long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """One row per input row: id_col, n_links, component_id, kept. What this sends over the network is a few times the vectors' own size."""
    block, apart = BLOCK, most_apart(least)
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"), F.col(label_col).cast("string").alias("label"))
    sound = F.coalesce(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0), F.lit(False))
    sound = sound & F.col("id").isNotNull() & F.col("label").isNotNull()
    rows = rows.select("id", "label", F.xxhash64("label").alias("g"), F.when(sound, F.col("vector")).alias("vector"))
    hashed = staged(_hashes(rows, tables, probes, "<f4" if single else "<f8"))
    good, same = hashed.where("d > 0"), ["label", "g", "d", "f1", "f2"]
    firsts = [F.first(c).alias(c) for c in ("s1", "s2", "codes", "vector")]
    points = good.groupBy(*same).agg(F.min("id").alias("id"), F.count("*").alias("n"), *firsts)
    points = staged(points.withColumn("p", F.monotonically_increasing_id()))

    slim = _bucketed(points, tables, probes)
    large = slim.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    sized = with_totals(slim, large, ["key"], "n", points.count() * tables * probes, "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
    met = staged(_candidates(tiles(sized, block), apart))

    node = met.select("p").distinct()
    groups = node.join(components(met.where("p <> mate"), "p", "mate").withColumnRenamed("id", "p"), "p", "left").select("p", F.coalesce("root", "p").alias("group"))
    groups = staged(groups)
    size = groups.groupBy("group").agg(F.count("*").alias("size"))
    groups = staged(with_totals(groups, size, ["group"], "size", groups.count()))
    whole = points.select("p", "id", "label", "g", "d", "n", "codes", "vector")
    small = groups.where(F.col("size") <= block).join(whole.drop("codes"), "p")
    tiled = met.drop("mate").join(groups.where(F.col("size") > block).select("p"), "p").join(whole, "p")
    found = _compare(small, ["group"], lambda pdf: compare_group(pdf, least)).union(_compare(tiled, TILE, lambda pdf: compare_tile(pdf, tables, probes, least)))
    found = staged(found)
    done_with(met)

    counted = found.groupBy("p").agg(F.sum("links").alias("links"))
    told = points.select(*same, "n", F.col("id").alias("point"), "p").join(counted, "p", "left").select(*same, "n", "point", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    member = with_totals(good.select("id", *same), told, same, "n", good.count())
    of = staged(member.groupBy("id").agg(F.max("links").alias("n_links"), F.array_sort(F.collect_set("point")).alias("points")))
    #: Rows that repeat an id with other vectors tie these together.
    ties = of.where("size(points) > 1").select(F.explode(F.slice("points", F.lit(2), F.size("points"))).alias("id"), F.col("points")[0].alias("root"))
    roots = components(found.where("id <> root").select("id", "root").union(ties), "id", "root").withColumnRenamed("id", "point")
    placed = of.select("id", "n_links", F.col("points")[0].alias("point")).join(roots, "point", "left").select(F.col("id").alias("member"), "n_links", F.coalesce("root", "point").alias("component_id"))
    out = hashed.select("id").join(placed, F.col("id") == F.col("member"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").cast(vectors.schema[id_col].dataType).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
