"""Packing documents into token windows by non-negative least squares.

A document is its ids and an end id. Whole windows of it are sequences of their
own; what remains is cut at a grid of ``GRID`` ids into a main piece (a
multiple of the grid) and a tail shorter than the grid.

Main pieces have at most 31 lengths. All combinations of two to four lengths
that fill a window exactly are enumerated, the number of times each is used is
solved against the histogram of lengths by non-negative least squares, rounded
down, trimmed to what the histogram holds and topped up greedily. Pieces left
over, then the tails, are laid end to end and cut at window ends; only the last
sequence of all is short. Padding is under one window for any input.

Only the histogram (31 counts) reaches the driver. Every piece's place follows
by arithmetic from its rank, and ranks from counts per input partition and
running sums over those; no group of pieces is gathered in one task. Texts are
encoded once and never shuffled: the CRC of a cut piece follows from those of
prefixes on the grid.

A null text counts as empty and packs as its end id alone; a text of any length
is cut as often as it needs; rows that repeat are packed as often as they
occur, told apart by ``row``, and so are rows of equal or null ids. An empty
table gives no pieces. Columns other than id and text are ignored, whatever
their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import for_python, per_process, staged, trimmed
from .tokens import VOCABULARY, tokenizer

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW, GRID, END = 2048, 64, 1
#: Ranks' bases of as many partitions and lengths, some 25 MB, are broadcast; beyond, rows shuffle to them.
MOST_BASES = 500_000
#: Ids, 1 MB, after which a worker sends on what it has encoded.
MOST_IDS = 1 << 18
UNITS = WINDOW // GRID
BINS = range(1, UNITS)

ENCODED = (
    "row long, id string, n long, part int, n_full int, full_at long, full_crcs array<int>, main int, main_rank long, main_crcs array<int>, tail int, tail_at long, tail_ids binary, ids array<int>"
)


def encode_batches(batches: Iterator, part: int, vocabulary: str, with_ids: bool = False) -> Iterator:
    """Record batches of ENCODED from those of (id, text) in one input partition; one ends once its rows have MOST_IDS ids."""
    from zlib import crc32

    import numpy as np
    import pyarrow as pa

    get = tokenizer(vocabulary)[0]
    row, full_at, tail_at, ranks = part << 33, 0, 0, [0] * UNITS
    signed = lambda x: x - (1 << 32) if x >> 31 else x
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.binary()]

    def record(out: list, held: list) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        ends = np.cumsum([0, *map(len, held)], dtype=np.int32)
        columns.append(pa.ListArray.from_arrays(ends, np.concatenate(held)) if with_ids else pa.nulls(len(out), pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ENCODED.split(", ")])

    for batch in batches:
        out, held, load = [], [], 0
        for name, text in zip(batch.column(0), batch.column(1), strict=True):
            ids = np.array([*get(text.as_py() or ""), END], "<i4")
            n, data = len(ids), memoryview(ids.tobytes())
            if with_ids:
                held.append(ids)
            full, rest = divmod(n, WINDOW)
            main, tail = divmod(rest, GRID)
            crcs, at, crc = [], full * WINDOW * 4, 0
            for _ in range(main):
                crc = crc32(data[at : at + GRID * 4], crc)
                crcs.append(signed(crc))
                at += GRID * 4
            out.append((row, name.as_py(), n, part, full, full_at, [signed(crc32(data[k * WINDOW * 4 : (k + 1) * WINDOW * 4])) for k in range(full)], main, ranks[main], crcs, tail, tail_at, bytes(data[at:])))
            row, full_at, tail_at = row + 1, full_at + full, tail_at + tail
            ranks[main] += 1
            load += n
            if load >= MOST_IDS:
                yield record(out, held)
                out, held, load = [], [], 0
        if out:
            yield record(out, held)


def encode_rows(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """One slim row per document: lengths, CRCs on the grid, the tail's ids, its ranks within its input partition, and all ids if asked for."""

    def encode(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        return encode_batches(batches, TaskContext.get().partitionId(), vocabulary, with_ids)

    return for_python(docs).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(encode), ENCODED)


def combinations(units: int = UNITS, most: int = 4) -> list[tuple[int, ...]]:
    """Every way to fill ``units`` by two to ``most`` lengths, longest first."""

    def parts(left: int, high: int, slots: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif slots:
            for k in range(min(left, high), 0, -1):
                for more in parts(left - k, k, slots - 1):
                    yield (k, *more)

    return list(parts(units, units - 1, most))


def nnls(a, b, rounds: int = 300):
    """x >= 0 with the least ||a x - b||: the active-set method of Lawson and Hanson."""
    import numpy as np

    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= 1e-9 * max(1.0, float(b.max())):
            break
        free[k] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (z <= 0)
            if not low.any():
                x = z
                break
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
    return x


def strategy(counts: dict[int, int]) -> list[tuple[tuple[int, ...], int]]:
    """(combination, uses) within ``counts``, the pieces of each length in units."""
    import numpy as np

    ways = combinations()
    a = np.zeros((UNITS - 1, len(ways)))
    for j, way in enumerate(ways):
        for k in way:
            a[k - 1, j] += 1
    left = np.array([counts.get(k, 0) for k in BINS], np.int64)
    scale = max(1.0, float(left.max(initial=0)))
    uses = np.floor(nnls(a, left / scale) * scale + 1e-6).astype(np.int64)
    order = np.argsort(-uses, kind="stable")
    need = a.astype(np.int64)
    chosen = np.zeros(len(ways), np.int64)
    for wanted in (uses, None):  # the solution, then greedily what still fits
        for j in order:
            most = min(left[k - 1] // need[k - 1, j] for k in set(ways[j]))
            n = most if wanted is None else min(most, wanted[j])
            if n > 0:
                chosen[j] += n
                left -= n * need[:, j]
    return [(ways[j], int(chosen[j])) for j in np.flatnonzero(chosen)]


def crc_of_suffix(whole, prefix, units):
    """CRC-32 of what follows a prefix, from those of the whole and the prefix; ``units`` counts the grid cells that follow."""
    import numpy as np

    def shifts():
        table = np.zeros(256, np.uint32)
        for i in range(256):
            c = i
            for _ in range(8):
                c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
            table[i] = c
        image, out = np.uint32(1) << np.arange(32, dtype=np.uint32), []
        for _ in range(UNITS + 1):
            out.append(image)
            for _ in range(GRID * 4):
                image = (image >> np.uint32(8)) ^ table[image & np.uint32(255)]
        return np.array(out)

    images = per_process("crc shifts", shifts)[units]
    moved = np.zeros(len(prefix), np.uint32)
    for bit in range(32):
        moved ^= np.where((prefix >> np.uint32(bit)) & np.uint32(1), images[:, bit], np.uint32(0))
    return whole ^ moved


def _suffix_crc():
    @F.pandas_udf("long")
    def crc(whole, prefix, units):
        import numpy as np
        import pandas as pd

        as32 = lambda s: s.fillna(0).to_numpy().astype(np.int64).astype(np.uint32)
        return pd.Series(crc_of_suffix(as32(whole), as32(prefix), units.fillna(0).to_numpy().astype(np.int64)).astype(np.int64))

    return crc


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """``rows`` of integers as a relation of the plan: from a list, createDataFrame sends them through Python workers of their own, which then stay in memory."""
    import pyarrow as pa

    fields = [x.split() for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64()}
    return spark.createDataFrame(pa.table({name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(fields)}), schema)


def _running(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier input partitions, one row per partition and group."""
    w = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, row, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the piece's ids if asked for.

    ``row`` tells apart rows that repeat an id.
    """
    spark = docs.sparkSession
    rows = staged(encode_rows(docs, id_col, text_col, vocabulary, with_ids))
    counts = {r["main"]: r["n"] for r in rows.where("main > 0").groupBy("main").agg(F.count("*").alias("n")).collect()}
    totals = rows.agg(F.coalesce(F.sum("n_full"), F.lit(0)).alias("full"), F.coalesce(F.max("part") + 1, F.lit(0)).alias("parts")).first()
    sent = F.broadcast if totals["parts"] * UNITS <= MOST_BASES else lambda df: df

    places, used, sequence = [], dict.fromkeys(BINS, 0), totals["full"]
    for way, uses in strategy(counts):
        at = 0
        for k in way:
            places.append((k, used[k], used[k] + uses, sequence, at * GRID))
            used[k] += uses
            at += k
        sequence += uses
    spare, at = [], 0
    for k in BINS:
        spare.append((k, used[k], at))
        at += (counts.get(k, 0) - used[k]) * k
    base, spare_ids = sequence * WINDOW, at * GRID
    #: At most a row per combination and length, whatever the data.
    slots = F.broadcast(_local(spark, places, "bin int, low long, high long, seq long, seq_offset long"))
    spares = F.broadcast(_local(spark, spare, "bin2 int, from_rank long, from_unit long"))

    per_part = rows.groupBy("part").agg(F.sum("n_full").alias("f"), F.sum("tail").alias("t"))
    per_part = _running(_running(per_part, [], "f", "full_base"), [], "t", "tail_base").select(F.col("part").alias("p1"), "full_base", "tail_base")
    per_bin = _running(rows.groupBy("part", "main").agg(F.count("*").alias("c")), ["main"], "c", "rank_base").select(F.col("part").alias("p2"), F.col("main").alias("m2"), "rank_base")
    r = rows.join(sent(per_part), F.col("part") == F.col("p1")).join(sent(per_bin), (F.col("part") == F.col("p2")) & (F.col("main") == F.col("m2")))
    r = r.withColumn("rank", F.col("rank_base") + F.col("main_rank"))
    r = r.join(slots, (F.col("main") == F.col("bin")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left").join(spares, F.col("main") == F.col("bin2"), "left")

    long = lambda x: F.lit(x).cast("long")
    unsigned = lambda c: c.cast("long").bitwiseAND(long(0xFFFFFFFF))

    def piece(start: Column, length: Column, crc: Column, seq: Column, offset: Column) -> Column:
        return F.struct(*[c.cast("long").alias(n) for n, c in (("start", start), ("length", length), ("ids_crc32", crc), ("sequence_id", seq), ("offset", offset))])

    full = F.transform(
        F.when(F.col("n_full") > 0, F.sequence(F.lit(0), F.col("n_full") - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: piece(k * WINDOW, F.lit(WINDOW), unsigned(F.get("full_crcs", k)), F.col("full_base") + F.col("full_at") + k, F.lit(0)),
    )
    main_start = F.col("n_full").cast("long") * WINDOW
    whole = F.get("main_crcs", F.col("main") - 1)
    #: A left-over main piece: its place in units behind the filled windows, and how many units still fit before the next window.
    unit = F.col("from_unit") + (F.col("rank") - F.col("from_rank")) * F.col("main")
    r = r.withColumn("unit", F.when(F.col("low").isNull() & (F.col("main") > 0), unit))
    r = r.withColumn("head", F.least(F.col("main"), (UNITS - F.pmod("unit", F.lit(UNITS))).cast("int")))
    r = r.withColumn("rest_crc", _suffix_crc()(whole, F.get("main_crcs", F.col("head") - 1), F.col("main") - F.col("head")))
    seq_of = lambda ids: F.floor(ids / WINDOW)
    at_main = base + F.col("unit") * GRID
    none = F.array().cast("array<struct<start:bigint,length:bigint,ids_crc32:bigint,sequence_id:bigint,offset:bigint>>")
    cut = F.when(
        F.col("head") < F.col("main"),
        F.array(piece(main_start + F.col("head") * GRID, (F.col("main") - F.col("head")) * GRID, F.col("rest_crc"), seq_of(at_main) + 1, F.lit(0))),
    ).otherwise(none)
    first = F.array(piece(main_start, F.col("head") * GRID, unsigned(F.get("main_crcs", F.col("head") - 1)), seq_of(at_main), F.pmod(at_main, long(WINDOW))))
    main = F.when(F.col("main") == 0, none).when(
        F.col("low").isNotNull(), F.array(piece(main_start, F.col("main") * GRID, unsigned(whole), F.col("seq") + F.col("rank") - F.col("low"), F.col("seq_offset")))
    ).otherwise(F.concat(first, cut))
    tail_start = main_start + F.col("main") * GRID
    r = r.withColumn("at_tail", base + spare_ids + F.col("tail_base") + F.col("tail_at"))
    r = r.withColumn("fits", F.least(F.col("tail").cast("long"), WINDOW - F.pmod("at_tail", long(WINDOW))))
    ids = lambda s, n: F.crc32(F.substring("tail_ids", (s * 4 + 1).cast("int"), (n * 4).cast("int")))
    tail = F.when(F.col("tail") == 0, none).otherwise(
        F.concat(
            F.array(piece(tail_start, F.col("fits"), ids(long(0), F.col("fits")), seq_of(F.col("at_tail")), F.pmod("at_tail", long(WINDOW)))),
            F.when(F.col("fits") < F.col("tail"), F.array(piece(tail_start + F.col("fits"), F.col("tail") - F.col("fits"), ids(F.col("fits"), F.col("tail") - F.col("fits")), seq_of(F.col("at_tail")) + 1, F.lit(0)))).otherwise(none),
        )
    )
    out = r.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "row", F.col("n").alias("doc_tokens"), F.explode(_with_ids(F.concat(full, main, tail), with_ids)).alias("p"))
    return out.select(id_col, "row", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset", *["p.ids"] * with_ids)


def _with_ids(pieces: Column, asked: bool) -> Column:
    """Each piece with its slice of the document's ids."""
    if not asked:
        return pieces
    return F.transform(pieces, lambda p: F.struct(*[p[c].alias(c) for c in ("start", "length", "ids_crc32", "sequence_id", "offset")], F.slice("ids", (p["start"] + 1).cast("int"), p["length"].cast("int")).alias("ids")))


def sequences(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The packed sequences from pack(with_ids=True): sequence_id, ids, and of each piece doc_ids, rows, starts and lengths. At most a window's pieces meet in a row."""
    one = pieces.repartition("sequence_id").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", F.col(id_col).alias("id"), "row", "start", "length", "ids"))).alias("p"))
    return one.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.id").alias("doc_ids"), F.col("p.row").alias("rows"), F.col("p.start").alias("starts"), F.col("p.length").alias("lengths"))
