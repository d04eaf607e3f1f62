"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document is its shingles of five words, weighted 1 + ln(count). Each shingle
sends arrivals of a Poisson process at the rate of its weight to random
registers; a register keeps its earliest. Processes stop once they are later
than every register, so most shingles cost one arrival. Two registers agree
with the probability Jaccard similarity
J = sum over common i of 1 / sum over j of max(a_j / a_i, b_j / b_i),
which is the plain one where all weights are equal.

Documents whose shingles and counts are equal are one class from the start.
Of each class one head is banded (25 bands of 5 registers: a pair at 0.8 is
missed with a chance of 5e-5). Within a bucket every head is verified against
the bucket's smallest; where a bucket then still holds several components, its
members outside the largest one are compared with all of it, in blocks, by
their registers and then exactly. Buckets of any size thus lose no link and
emit no pairs: the first step makes one link a member, the second a spanning
forest a block.

Words are runs of letters and digits, lower-cased. A text of one to four words
is one shingle. Texts without words and rows without id link with nothing; a
class is named by its smallest id. Rows that repeat an id are of one class,
also with other texts. Whole texts are read; one takes some 30 bytes of memory
a byte. An empty table gives an empty one. Columns besides id and text may have
any names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, done_with, fill, for_python, per_process, runs, staged, trimmed, unused, with_totals
from .exact_dedup import filter_shape, present_cells, with_suspicion

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS, LEAST, BANDS, ROWS, BLOCK = 5, 0.8, 25, 5, 512
#: Registers agree within this of the similarity but for a chance of some 1e-5.
MARGIN = 0.16


def mix(x):
    """Finalizer of a 64-bit hash, on uint64 arrays."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        import hashlib

        if len(self) > 60_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word.encode(errors="replace"), digest_size=8).digest(), "big")
        return value


def shingles(text: str, size: int = WORDS):
    """(elements, counts): sorted distinct 32-bit hashes of a text's shingles."""
    import re

    import numpy as np

    find, known = per_process("near words", lambda: (re.compile(r"[^\W_]+").findall, Words()))
    words = find(text.lower())
    if not words:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - size + 1)
    total = np.full(n, min(len(w), size), np.uint64)
    for k in range(min(len(w), size)):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n])
    return np.unique((total >> np.uint64(32)).astype(np.uint32), return_counts=True)


def weights(counts):
    import numpy as np

    return 1 + np.log(counts)


def prob_minhash(elements: list, weight: list, registers: int):
    """uint32 [documents, registers]: the element that first arrives at each register. No document may be empty."""
    import numpy as np

    n = len(elements)
    doc = np.repeat(np.arange(n), [len(e) for e in elements])
    e, w = np.concatenate(elements), np.concatenate(weight)
    state, at = mix(e.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)), np.zeros(len(e))
    time, name = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint32)
    while len(e):
        state = mix(state + np.uint64(0x9E3779B97F4A7C15))
        at = at - np.log(((state >> np.uint64(12)).astype(float) + 0.5) / (1 << 52)) / w
        alive = at < time.reshape(n, registers).max(1)[doc]
        e, w, doc, state, at = e[alive], w[alive], doc[alive], state[alive], at[alive]
        slot = doc * registers + (mix(state ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(registers)).astype(np.int64)
        won = np.flatnonzero(at < time[slot])
        won = won[np.lexsort((-e[won].astype(np.int64), -at[won]))]
        time[slot[won]], name[slot[won]] = at[won], e[won]
    return name.reshape(n, registers)


def band_keys(names, bands: int = BANDS, rows: int = ROWS):
    """int64 [documents, bands]"""
    import numpy as np

    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(names), bands)).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + names[:, k::rows][:, :bands])
    return key.view(np.int64)


def similarity(ea, wa, eb, wb) -> float:
    """Probability Jaccard similarity of sorted elements with weights."""
    import numpy as np

    _, i, j = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    a, b = wa[i], wb[j]
    only_a, only_b = wa.sum() - a.sum(), wb.sum() - b.sum()
    order = np.argsort(b / a, kind="stable")
    a, b = a[order], b[order]
    low = np.cumsum(a)
    high = b.sum() - np.cumsum(b)
    return float(np.sum(1 / ((only_a + low) / a + (only_b + high) / b)))


SKETCH = "id long, c1 long, c2 long, bands array<long>, names binary, elements binary, weights binary"


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document with words."""

    def sketch(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np

        for pdf in batches:
            ids, texts = pdf["id"].to_numpy(), pdf["text"].to_numpy()
            s = 0
            while s < len(ids):
                t, load, group = s, 0, []
                while t < len(ids) and load < 100_000:
                    e, n = shingles(texts[t])
                    if len(e):
                        group.append((ids[t], e, n))
                        load += len(e)
                    t += 1
                s = t
                if not group:
                    continue
                w = [weights(n) for _, _, n in group]
                names = prob_minhash([e for _, e, _ in group], w, BANDS * ROWS)
                same = [np.frombuffer(hashlib.blake2b(e.tobytes() + n.tobytes(), digest_size=16).digest(), np.int64) for _, e, n in group]
                yield pd.DataFrame(
                    {
                        "id": [x[0] for x in group], "c1": [x[0] for x in same], "c2": [x[1] for x in same], "bands": list(band_keys(names)), "names": [x.tobytes() for x in names],
                        "elements": [e.tobytes() for _, e, _ in group], "weights": [x.astype(np.float32).tobytes() if n.max() > 1 else b"" for x, (_, _, n) in zip(w, group, strict=True)],
                    }
                )

    slim = docs.select(F.col(id_col).cast("long").alias("id"), fill(text_col).alias("text")).where("id is not null")
    return for_python(slim).mapInPandas(trimmed(sketch), SKETCH)


def unpacked(elements: bytes, weight: bytes):
    import numpy as np

    e = np.frombuffer(elements, np.uint32)
    return e, np.frombuffer(weight, np.float32).astype(float) if weight else np.ones(len(e))


def _similarity() -> Column:
    @F.pandas_udf("double")
    def sim(ea: pd.Series, wa: pd.Series, eb: pd.Series, wb: pd.Series) -> pd.Series:
        return pd.Series([similarity(*unpacked(a, b), *unpacked(c, d)) for a, b, c, d in zip(ea, wa, eb, wb, strict=True)], dtype="float64")

    return sim("ea", "wa", "eb", "wb")


def compare_blocks(part: pd.DataFrame, least: float, margin: float = MARGIN) -> list[tuple[int, int]]:
    """Links that join components: rows of one block among themselves, or of side 0 against side 1."""
    import numpy as np

    part = part.drop_duplicates(["id", "side", "elements"])
    names = np.frombuffer(b"".join(part["names"]), np.uint32).reshape(len(part), -1)
    ids, comp, side = part["id"].to_numpy(), part["comp"].to_numpy(), part["side"].to_numpy()
    elements, weight = part["elements"].to_numpy(), part["weights"].to_numpy()
    _, group = np.unique(comp, return_inverse=True)
    forest = Forest(int(group.max()) + 1)
    one = bool((side == 0).all())
    a = np.arange(len(part)) if one else np.flatnonzero(side == 0)
    b = a if one else np.flatnonzero(side == 1)
    need, found = (least - margin) * names.shape[1], []
    for i in a:
        others = b[b > i] if one else b
        others = others[group[others] != group[i]]
        if not len(others):
            continue
        for j in others[(names[others] == names[i]).sum(1) >= need]:
            if forest.root(int(group[i])) != forest.root(int(group[j])) and similarity(*unpacked(elements[i], weight[i]), *unpacked(elements[j], weight[j])) >= least:
                forest.join(int(group[i]), int(group[j]))
                found.append((int(ids[i]), int(ids[j])))
    return found


def _compare(rows: DataFrame, least: float) -> DataFrame:
    keys = ["band", "key", "kind", "ti", "tj"]

    def compared(batches: Iterator) -> Iterator:
        out: list[tuple[int, int]] = []
        for part in runs(batches, keys):
            if len(part) > 1:
                out += compare_blocks(part, least)
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return for_python(rows).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(trimmed(compared), "a long, b long")


def _block(n: Column) -> Column:
    return F.pmod(F.xxhash64("id"), n).cast("int")


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without those whose id surely isn't in ``ids``, by a Bloom filter of at most 128 MB: most of what a join would drop isn't shuffled.

    A join follows, so what a filter lets through changes no result.
    """
    ids = ids.distinct()
    bits = filter_shape(ids.count())[1]
    return with_suspicion(rows, "id", present_cells(ids, "id", bits), bits).where("suspect").drop("suspect")


def links(sketches: DataFrame, heads: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b): verified links between heads that span every component.

    Rows of large buckets meet their bucket's totals by broadcast, so none is a task's burden.
    """
    bands = heads.select("id", F.posexplode("bands").alias("band", "key"))
    bucket = bands.groupBy("band", "key").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1")
    members = staged(with_totals(bands, bucket, ["band", "key"], "n", heads.count() * BANDS).select("id", "band", "key", "lead"))

    pairs = staged(members.where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct())
    body = sketches.select("id", "elements", "weights")
    left = _only(body, pairs.select(F.col("a").alias("id"))).select(F.col("id").alias("a"), F.col("elements").alias("ea"), F.col("weights").alias("wa"))
    right = _only(body, pairs.select(F.col("b").alias("id"))).select(F.col("id").alias("b"), F.col("elements").alias("eb"), F.col("weights").alias("wb"))
    n_members = members.count()
    # Both sides of these joins grow with the input, so they are sorted and merged at every size.
    first = staged(for_python(pairs).hint("merge").join(left, "a").join(right.hint("merge"), "b").withColumn("sim", _similarity()).where(F.col("sim") >= least).select("a", "b"))

    roots = components(first)
    placed = staged(members.join(roots, "id", "left").select("id", "band", "key", F.coalesce("root", "id").alias("comp")))
    parts = placed.groupBy("band", "key", "comp").agg(F.count("*").alias("n"))
    open_ = parts.groupBy("band", "key").agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), F.max("n").alias("n_major"), F.sum("n").alias("n"), F.count("*").alias("comps")).where("comps > 1 and n > 2")  # of two, the only pair is verified
    todo = with_totals(placed, open_, ["band", "key"], "n", n_members).withColumn("outer", F.col("comp") != F.col("major"))
    n_out, n_in = (F.ceil((F.col("n") - F.col("n_major")) / BLOCK).cast("int"), F.ceil(F.col("n_major") / BLOCK).cast("int"))
    todo = todo.withColumn("block", F.when(F.col("outer"), _block(n_out)).otherwise(_block(n_in)))
    among = todo.where("outer").withColumn("o", F.explode(F.sequence(F.lit(0), n_out - 1)))
    among = among.select("id", "comp", "band", "key", F.lit(0).alias("kind"), F.least("block", "o").alias("ti"), F.greatest("block", "o").alias("tj"), (F.col("block") > F.col("o")).cast("int").alias("side"))
    across = todo.withColumn("o", F.explode(F.sequence(F.lit(0), F.when(F.col("outer"), n_in).otherwise(n_out) - 1)))
    across = across.select("id", "comp", "band", "key", F.lit(1).alias("kind"), F.when(F.col("outer"), F.col("block")).otherwise(F.col("o")).alias("ti"), F.when(F.col("outer"), F.col("o")).otherwise(F.col("block")).alias("tj"), (~F.col("outer")).cast("int").alias("side"))
    tiles = staged(among.union(across))
    whole = _only(sketches.select("id", "names", "elements", "weights"), tiles.select("id"))
    second = staged(_compare(tiles.hint("merge").join(whole, "id"), least))
    done_with(members, pairs, placed, tiles)
    return first.union(second)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row per input row: id_col, class_id and kept (class_id is the row's own id; a null id is kept, without class)."""
    sketches = staged(sketched(docs, id_col, text_col))
    equal = sketches.groupBy("c1", "c2").agg(F.min("id").alias("head"), F.count("*").alias("copies"))
    member = with_totals(sketches.select("id", "c1", "c2"), equal, ["c1", "c2"], "copies", sketches.count()).select("id", "head")
    of = staged(member.groupBy("id").agg(F.array_sort(F.collect_set("head")).alias("heads")))
    heads = staged(sketches.select("id", "c1", "c2", "bands").join(equal.select(F.col("head").alias("id"), "c1", "c2"), ["id", "c1", "c2"], "left_semi").dropDuplicates(["id", "c1", "c2"]))
    #: Rows that repeat an id with other texts tie their classes together.
    ties = of.where(F.size("heads") > 1).select(F.explode(F.slice("heads", F.lit(2), F.size("heads"))).alias("a"), F.col("heads")[0].alias("b"))
    roots = components(links(sketches, heads, least).union(ties))
    done_with(sketches, heads)
    named = of.select(F.col("id").alias("member"), F.col("heads")[0].alias("head")).join(roots.withColumnRenamed("id", "head"), "head", "left").select("member", F.coalesce("root", "head").alias("class_id"))
    out = docs.select(F.col(id_col).alias("own")).join(named, F.col("own") == F.col("member"), "left")
    class_id = F.coalesce("class_id", F.col("own").cast("long"))
    return out.select(F.col("own").alias(id_col), class_id.alias("class_id"), F.col("own").cast("long").eqNullSafe(class_id).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that stay: of each class those of its smallest id."""
    name = unused(docs.columns, "gone")
    gone = staged(near_duplicates(docs, id_col, text_col, least).where(~F.col("kept")).select(F.col(id_col).alias(name)).distinct())
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(name), "left_anti")
