"""Secret scans judged by how many owners hold a candidate across the whole corpus.

Texts are scanned once for three kinds of base spans - assignments, access keys
and hex strings - and for a fourth kind of candidate, ``token``: a run of 24 or
more characters of the base-64 alphabets with small and capital letters and
digits and an entropy of 3.5 bits a character or more. Every candidate's value
is hashed; distinct (hash, repository, owner) triples are counted per hash, and
these counts tell its class:

- ``copied``: ``widely`` or more owners, a value that examples spread;
- ``live``: one owner and one repository, as of a credential in use;
- ``reused``: one owner, several repositories: still owner-specific;
- ``shared``: anything between.

Base spans are all reported; a token is reported where it is live or reused.

A null text counts as empty, a null owner or repository as one of its own, not
that of the empty text; rows that repeat are reported each and count as one
repository; a null id stays null; an empty table gives an empty one; columns
other than those named are ignored. Spans are in code points, end exclusive;
letters in assignments' names match in either case, A-Z only.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fill, for_python, per_process, staged, trimmed, with_totals

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("assign", "access", "hex", "token")
WIDELY = 3


def patterns():
    import re

    return per_process(
        "secret patterns",
        lambda: (
            re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE),
            re.compile(r"AKIA[A-Z0-9]{16,}"),
            re.compile(r"[0-9a-f]{24,}"),
            re.compile(r"[A-Za-z0-9+/_=-]{24,}"),
        ),
    )


def entropy(value: str) -> float:
    """Bits a character."""
    import math
    from collections import Counter

    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def looks_random(value: str) -> bool:
    return any("a" <= c <= "z" for c in value) and any("A" <= c <= "Z" for c in value) and any("0" <= c <= "9" for c in value) and entropy(value) >= 3.5


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value), kind by position in KINDS, ordered by start and kind."""
    assign, access, hexes, token = patterns()
    out = [(0, *m.span(), m[2]) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(k, *m.span(), m[0]) for k, p in ((1, access), (2, hexes)) for m in p.finditer(text)]
    out += [(3, *m.span(), m[0]) for m in token.finditer(text) if looks_random(m[0])]
    return sorted(out, key=lambda x: (x[1], x[0]))


def _as_text(name: str | Column) -> Column:
    """A repository or owner as a text, structs by their JSON with nulls: different values stay different."""
    c = F.col(name) if isinstance(name, str) else name
    return F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})


def scan(docs: DataFrame, id_col: str, text_col: str, repo_col: str | Column, owner_col: str | Column) -> DataFrame:
    """One row per document: row, id, repo, owner and found, an array of its candidates with hashed values."""

    def search(batches: Iterator) -> Iterator:
        import hashlib

        import pandas as pd
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for pdf in batches:
            found = [[{"kind": k, "start": s, "end": e, "hash": int.from_bytes(hashlib.blake2b(v.encode(errors="replace"), digest_size=8).digest(), "big", signed=True)} for k, s, e, v in candidates(t)] for t in pdf["text"]]
            yield pd.DataFrame({"row": range(row, row + len(pdf)), "id": pdf["id"], "repo": pdf["repo"], "owner": pdf["owner"], "found": found})
            row += len(pdf)

    slim = docs.select(F.col(id_col).alias("id"), fill(text_col).alias("text"), _as_text(repo_col).alias("repo"), _as_text(owner_col).alias("owner"))
    kind = slim.schema["id"].dataType.simpleString()
    out = for_python(slim).select(F.col("id").cast("string").alias("id"), "text", "repo", "owner").mapInPandas(trimmed(search), "row long, id string, repo string, owner string, found array<struct<kind:int,start:int,end:int,hash:long>>")
    return out.withColumn("id", F.col("id").cast(kind))


def ownership(scanned: DataFrame) -> DataFrame:
    """Per hash: n_repos (of an owner each) and n_owners that hold it, and n_found, how often it was found. Three sums, each combined before its shuffle."""
    held = scanned.select("repo", "owner", F.explode("found.hash").alias("hash")).groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    per_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("n_repos"), F.sum("n").alias("n"))
    return per_owner.groupBy("hash").agg(F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("n").alias("n_found"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | Column = "source", owner_col: str | Column = "source", widely: int = WIDELY) -> DataFrame:
    """One row per document: id_col and spans, an array of (start, rank, kind, end, n_repos, n_owners, class) in order."""
    scanned = staged(scan(docs, id_col, text_col, repo_col, owner_col))
    found = scanned.select("row", F.explode("found").alias("f")).select("row", "f.*")
    seen = with_totals(found, ownership(scanned), ["hash"], "n_found", found.count())
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    verdict = F.when(F.col("n_owners") >= widely, "copied").when(F.col("n_owners") > 1, "shared").when(F.col("n_repos") > 1, "reused").otherwise("live")
    span = F.struct("start", F.col("kind").alias("rank"), kind.alias("kind"), "end", "n_repos", "n_owners", verdict.alias("class"))
    told = seen.where((F.col("kind") < 3) | (F.col("n_owners") == 1)).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    empty = F.array().cast(told.schema["spans"].dataType)
    return scanned.select("row", F.col("id").alias(id_col)).join(told, "row", "left").select(id_col, F.coalesce("spans", empty).alias("spans"))
