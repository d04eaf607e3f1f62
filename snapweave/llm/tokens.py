"""Token counts per section by offset-mapped attribution, and the tokenizer that other operators use.

Ids are those that ``tokenizers`` gives for the vocabulary file without adding
special tokens: the strings of the file's added tokens (``<|endoftext|>``) are
one id each wherever a text holds them. ``tiktoken`` encodes, with ranks and
added tokens read from that file; it is the faster of the two.

A document is encoded once, as a whole, so counts add up to those of the text
a model sees. Each token's span is joined to the sections' intervals by binary
search over their ends. A token that crosses a border goes to one section, by
rule: ``first`` (the section of its first byte), ``last`` (of its last byte) or
``most`` (the section with most of its bytes; of equals the first).

A section ends behind each separator (a line feed unless told otherwise; not
overlapping, from the left); a text that ends with one has no empty section
behind it, and an empty or null text has one empty section. Spans are in code points, end exclusive.
A text is encoded by itself and takes some 30 bytes of memory a byte; rows that
repeat are counted each, a null id stays null, an empty table has no sections,
and columns other than id and text are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import for_python, per_process, trimmed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = "byte_bpe_50k.json"
RULES = ("first", "last", "most")


def _bytes_of() -> dict[str, int]:
    """The alphabet of byte-level vocabularies: printable Latin-1 stands for itself, the other bytes for code points from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def tokenizer(vocabulary: str = VOCABULARY) -> tuple[Callable, "np.ndarray"]:  # noqa: F821, UP037
    """(text -> ids, bytes per id); ``vocabulary`` is the name or path of a JSON file of byte-level BPE. Built once per worker process."""

    def build():
        import json

        import numpy as np
        import public_tokenizers
        import tiktoken

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or spec["normalizer"]:
            raise ValueError(f"{path} isn't plain byte-level BPE")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that match by more than their own text")
        added, byte = {t["content"]: t["id"] for t in spec["added_tokens"]}, _bytes_of()
        ranks = {bytes(map(byte.__getitem__, token)): k for token, k in spec["model"]["vocab"].items() if token not in added}
        encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        lengths = np.zeros(max([*ranks.values(), *added.values()]) + 1, np.int64)
        lengths[list(ranks.values())] = [len(token) for token in ranks]
        lengths[list(added.values())] = [len(token.encode()) for token in added]

        def encode(text: str) -> list[int]:
            return encoding.encode(text, allowed_special="all") if any(t in text for t in added) else encoding.encode_ordinary(text)

        return encode, lengths

    return per_process(f"tokenizer {vocabulary}", build)


def attribute(text: str, encode: Callable, lengths, rule: str = "most", separator: str = "\n"):
    """(starts, ends, tokens, crossing): per section its span in code points, its tokens, and how many of them cross a border."""
    import numpy as np

    whole, mark = text.encode(errors="replace"), separator.encode()
    data = np.frombuffer(whole, np.uint8)
    if len(mark) == 1:
        ends = np.flatnonzero(data == mark[0]) + 1
    else:
        ends = np.cumsum([len(x) + len(mark) for x in whole.split(mark)[:-1]], dtype=np.int64)
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    starts = np.concatenate(([0], ends[:-1]))
    stop = np.cumsum(lengths[np.array(encode(text), np.int64)])
    begin = np.concatenate(([0], stop[:-1])) if len(stop) else stop
    first, last = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, stop - 1, "right")
    crossing = np.flatnonzero(first != last)
    owner = last.copy() if rule == "last" else first.copy()
    if rule == "most":
        for k in crossing:
            held = [min(stop[k], ends[s]) - max(begin[k], starts[s]) for s in range(first[k], last[k] + 1)]
            owner[k] = first[k] + int(np.argmax(held))
    n = len(ends)
    return points[starts], points[ends], np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def section_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "most", separator: str = "\n", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per section: id_col, section (from 0), start, end, n_tokens, n_crossing. No shuffle."""
    if rule not in RULES or not separator:
        raise ValueError(f"rule must be one of {RULES}, and the separator not empty")

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encode, lengths = tokenizer(vocabulary)
        for batch in batches:
            found = [attribute(t or "", encode, lengths, rule, separator) for t in batch.column(1).to_pylist()]
            each = [len(x[0]) for x in found]
            if not each:
                continue
            rows = pa.array(np.repeat(np.arange(len(each)), each))
            section = np.concatenate([np.arange(n) for n in each])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(section, pa.int32()), *[pa.array(np.concatenate([x[k] for x in found]), pa.int64()) for k in range(4)]], ["id", "section", "start", "end", "n_tokens", "n_crossing"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return for_python(slim).mapInArrow(trimmed(count), f"id {kind}, section int, start long, end long, n_tokens long, n_crossing long").withColumnRenamed("id", id_col)
