"""The stages one by one against what they promise, and the whole against its stages."""

from collections import Counter, defaultdict

import corpus_pipeline as P
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from snapweave.llm import exact_dedup, mixing, near_dedup, packing

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in P.STAGES:
        before, docs = docs, stage(spark, docs, DATA).cache()
        out[name] = (before, docs)
    return out


def ids(df):
    return Counter(r[0] for r in df.select("doc_id").collect())


def test_all_but_the_last_keep_the_columns(stages):
    for name, (before, after) in stages.items():
        assert name == "packing" or after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_documents_go(stages, spark):
    before, after = stages["toxicity"]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").collect()}
    gone = set(ids(before)) - set(ids(after))
    assert gone and len(gone & toxic) >= len(gone) * 0.7 and ids(after).total() > 0.7 * ids(before).total()


def test_one_document_of_each_group_stays(stages):
    before, after = stages["exact_dedup"]
    assert ids(after) == ids(exact_dedup.exact_groups(before).where("kept"))
    before, after = stages["near_dedup"]
    assert ids(after) == ids(near_dedup.near_duplicates(before).where("kept"))
    before, after = stages["mixing"]
    want = mixing.mix(before).selectExpr("doc_id", "floor(taken / greatest(size, 1) + 0.5) AS n").collect()
    assert ids(after) == Counter({r["doc_id"]: r["n"] for r in want if r["n"]})


def test_every_mixed_document_is_packed_as_often_and_comes_back(stages):
    before, after = stages["packing"]
    tokenizer, back, lengths = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(dict), []
    for r in after.collect():
        at = 0
        lengths.append(len(r["ids"]))
        for doc, row, start, length in zip(r["doc_ids"], r["rows"], r["starts"], r["lengths"], strict=True):
            back[row, doc][start] = r["ids"][at : at + length]
            at += length
        assert at == len(r["ids"]) <= packing.WINDOW
    assert sum(n < packing.WINDOW for n in lengths) <= 1
    got = Counter((doc, tuple(t for _, part in sorted(parts.items()) for t in part)) for (_, doc), parts in back.items())
    assert max(Counter(doc for _, doc in back).values()) > 1
    assert got == Counter((r["doc_id"], (*tokenizer.encode(r["text"], add_special_tokens=False).ids, packing.END)) for r in before.collect())


def test_run_gives_the_rows_of_the_last_stage(spark, stages):
    texts = lambda df: Counter(r["doc"] for r in df.selectExpr("explode(arrays_zip(doc_ids, starts)) as d").where("d.starts = 0").selectExpr("d.doc_ids as doc").collect())
    got, want = P.run(spark, DATA), stages["packing"][1]
    assert got.schema == want.schema and texts(got) == texts(want)


def test_empty_corpora_and_odd_rows_go_through(spark, odd):
    for df in (odd, odd.where("false")):
        docs = df
        for name, stage in P.STAGES:
            docs = stage(spark, docs, DATA)
            assert name == "packing" or docs.columns == df.columns
        assert docs.count() >= 0
