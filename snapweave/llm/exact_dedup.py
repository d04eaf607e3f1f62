"""Exact deduplication by two passes over a Bloom filter, in built-in functions only.

Pass 1 counts, per cell of the filter, how many rows set it; the cells set at
least twice are packed into 64-bit words. Pass 2 probes the words: a row with
a cell set once can't have a copy and passes straight through, only the others
shuffle, and a full SHA-256 decides among them.

The filter has at least BITS_PER_ROW bits a row at any size, so at most 1.4 %
of unique rows are taken for suspects. It is broadcast; beyond SEGMENT_BITS it
is cut into segments by a third hash, and the two passes run over one segment
after the other, so that what is broadcast at once stays under 128 MB. What
pass 1 shuffles are two cell numbers a row, never rows or texts.

Texts are equal when identical after lower-casing A-Z only; a null text counts
as empty. Of equal texts the row with the largest id stays (a null id is the
smallest); of rows that repeat an id and a text, exactly one is kept. An empty
table gives an empty one. Columns besides id and text may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fill, staged, with_totals

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits a row at least, and the most bits of one segment; words are broadcast in chunks of CHUNK.
BITS_PER_ROW, SEGMENT_BITS, CHUNK = 16, 1 << 30, 512


def normalised(text: str | Column) -> Column:
    """A-Z lower-cased and nothing else: lower() does that for pure ASCII, translate() for the rest."""
    t = fill(text)
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def text_sha256(text: str | Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def filter_shape(rows: int, most: int = SEGMENT_BITS) -> tuple[int, int]:
    """(segments, bits of each): at least BITS_PER_ROW bits a row in all, a power of two in each."""
    segments = max(1, -(-rows * BITS_PER_ROW // most))
    return segments, min(most, 1 << max(10, (-(-rows // segments) * BITS_PER_ROW - 1).bit_length()))


def _segment(key: str, segments: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(5), key), F.lit(segments))


def _cells(key: str, bits: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), key).bitwiseAND(F.lit(bits - 1)) for seed in (11, 23)]


def _chunks(cells: DataFrame) -> DataFrame:
    """(chunk, words) of the cells: CHUNK words of 64 bits a row, so a filter takes one bit of memory a bit."""
    word = cells.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("mask"))
    held = word.groupBy(F.floor(F.col("word") / CHUNK).alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("word") % CHUNK).cast("int"), "mask"))).alias("m"))
    return held.select("chunk", F.transform(F.sequence(F.lit(0), F.lit(CHUNK - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long"))).alias("words"))


def repeated_cells(prints: DataFrame, key: str, bits: int) -> DataFrame:
    """Pass 1: the cells that at least two rows set."""
    cell = prints.select(F.explode(F.array(*_cells(key, bits))).alias("cell"))
    return _chunks(cell.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"))


def present_cells(rows: DataFrame, key: str, bits: int) -> DataFrame:
    """The cells that any row sets: a filter of the keys that occur."""
    return _chunks(rows.select(F.explode(F.array(*_cells(key, bits))).alias("cell")).distinct())


def with_suspicion(rows: DataFrame, key: str, chunks: DataFrame, bits: int) -> DataFrame:
    """Pass 2: a column ``suspect``, false where pass 1 saw no other row with the key. The chunks (``bits`` in all) are broadcast."""
    out, hit = rows, []
    for k, cell in enumerate(_cells(key, bits)):
        out = out.withColumn(f"_c{k}", cell)
        c = chunks.select(F.col("chunk").alias(f"_k{k}"), F.col("words").alias(f"_w{k}"))
        out = out.join(F.broadcast(c), F.shiftright(f"_c{k}", 6 + CHUNK.bit_length() - 1) == F.col(f"_k{k}"), "left")
        word = F.get(f"_w{k}", F.shiftright(f"_c{k}", 6).bitwiseAND(F.lit(CHUNK - 1)).cast("int"))
        hit.append(F.coalesce(F.getbit(word, F.col(f"_c{k}").bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False)))
    return out.withColumn("suspect", hit[0] & hit[1]).drop("_c0", "_c1", "_k0", "_k1", "_w0", "_w1")


def suspected(rows: DataFrame, key: str, n_rows: int, prints: DataFrame | None = None, segment_bits: int = SEGMENT_BITS) -> list[DataFrame]:
    """``rows`` with ``suspect``, one frame a segment; ``prints`` has the same keys and is cheaper to read.

    For several segments the rows are written once in a folder each, without a
    shuffle, so every row is read for its own segment's filter only. A segment
    is written before the next one's filter is made: one filter is held at a time.
    """
    segments, bits = filter_shape(n_rows, segment_bits)
    if segments == 1:
        return [with_suspicion(rows, key, repeated_cells(rows if prints is None else prints, key, bits), bits)]
    parted = staged(rows.withColumn("_segment", _segment(key, segments)), by="_segment")
    own = (parted.where(F.col("_segment") == k).drop("_segment") for k in range(segments))
    return [staged(with_suspicion(part, key, repeated_cells(part, key, bits), bits)) for part in own]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    The texts are read once; hashes and ids are written to the shared folder
    and the two passes run over those.
    """
    prints = staged(docs.select(F.col(id_col).alias("id"), text_sha256(text_col).alias("sha")))
    n_rows = prints.count()
    seen = reduce(DataFrame.union, suspected(prints, "sha", n_rows, segment_bits=segment_bits))
    alone = seen.where(~F.col("suspect")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    per_id = seen.where("suspect").groupBy("sha", "id").agg(F.count("*").alias("n"))
    group = per_id.groupBy("sha").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    copies = with_totals(per_id, group, ["sha"], "group_size", n_rows).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    shared = copies.select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "sha")
    return alone.union(shared).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns.

    Rows whose text surely occurs once are never shuffled. The others are
    reduced to one row per text before the shuffle, so a text that holds a
    third of all rows sends one row per task.
    """
    prints = staged(docs.select(text_sha256(text_col).alias("sha")))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), text_sha256(text_col).alias("sha"))
    order = F.struct("id", F.xxhash64(F.to_json("row")))
    seen = reduce(DataFrame.union, suspected(packed, "sha", prints.count(), prints, segment_bits))
    best = seen.where("suspect").groupBy("sha").agg(F.max_by("row", order).alias("row"))
    return seen.where(~F.col("suspect")).select("row").union(best.select("row")).select("row.*")
