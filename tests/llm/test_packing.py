from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from snapweave.llm import packing as X


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, X.END]


def check(df, encode):
    ids = [(r["doc_id"], encode(r["text"])) for r in df.select("doc_id", "text").collect()]
    pieces = X.pack(df).collect()
    by_row, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_row[p["row"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert len(by_row) == len(ids)
    pool = Counter((i, tuple(t)) for i, t in ids)
    known = {crc: t for crc, t in ((crc32(np.array(t, "<u4").tobytes()), t) for _, t in ids)}
    for part in by_row.values():
        part.sort(key=lambda p: p["start"])
        assert [p["start"] for p in part] == [sum(q["length"] for q in part[:k]) for k in range(len(part))]
        assert sum(p["length"] for p in part) == part[0]["doc_tokens"]
        fits = [t for (i, t), n in pool.items() if n and i == part[0]["doc_id"] and len(t) == part[0]["doc_tokens"]]
        own = next(t for t in fits if all(crc32(np.array(t[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] for p in part))
        pool[(part[0]["doc_id"], own)] -= 1
    assert not any(pool.values()) and known
    for part in by_seq.values():
        part.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in part] == [sum(q["length"] for q in part[:k]) for k in range(len(part))]
    lengths = [sum(p["length"] for p in part) for part in by_seq.values()]
    assert max(lengths) <= X.WINDOW and sum(n < X.WINDOW for n in lengths) <= 1


def test_every_id_is_in_one_piece(docs, odd, encode):
    check(docs, encode)
    check(odd, encode)


def test_empty_tables(none):
    assert X.pack(none).count() == 0


def test_texts_full_of_added_tokens(spark, encode):
    mark = "<|endoftext|>"
    texts = [mark, f"{mark}a", f"a{mark}", f"a {mark} b", mark * 3, f"x{mark}{mark} y", f"{mark}\n{mark}", "<|endof" + mark + "text|>", mark * 3000, "<|endoftext |>"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), encode)
    assert len(encode(f"a {mark} b")) == 5


def test_sequences_hold_the_ids_of_all_rows(docs, odd, encode):
    for some in (docs.where("doc_id < 40"), odd):
        packed = X.sequences(X.pack(some, with_ids=True)).collect()
        back = defaultdict(dict)
        for r in packed:
            assert len(r["ids"]) <= X.WINDOW
            at = 0
            for doc, row, start, length in zip(r["doc_ids"], r["rows"], r["starts"], r["lengths"], strict=True):
                back[row, doc][start] = r["ids"][at : at + length]
                at += length
            assert at == len(r["ids"])
        assert sum(len(r["ids"]) < X.WINDOW for r in packed) <= 1
        got = Counter((doc, tuple(t for _, part in sorted(parts.items()) for t in part)) for (_, doc), parts in back.items())
        assert got == Counter((r["doc_id"], tuple(encode(r["text"]))) for r in some.collect())


def test_least_squares_agree_with_the_conditions_of_optimality():
    rng = np.random.default_rng(0)
    a, b = rng.random((12, 40)), rng.random(12) * 5
    x = X.nnls(a, b)
    slope = a.T @ (a @ x - b)
    assert (x >= 0).all() and (slope > -1e-6).all() and abs(slope @ x) < 1e-6


def test_strategies_stay_within_the_histogram():
    ways = X.combinations()
    assert all(sum(w) == X.UNITS and 2 <= len(w) <= 4 for w in ways) and len(set(ways)) == len(ways)
    rng = np.random.default_rng(1)
    for counts in ({}, {31: 5}, {16: 7}, {k: int(rng.integers(0, 500)) for k in X.BINS}, {k: 1 for k in X.BINS}):
        used = Counter()
        for way, n in X.strategy(counts):
            for k in way:
                used[k] += n
        assert all(used[k] <= counts.get(k, 0) for k in used)
    counts = {k: 1000 for k in X.BINS}
    used = sum(sum(w) * n for w, n in X.strategy(counts))
    assert used > 0.95 * sum(k * 1000 for k in X.BINS)


def test_the_checksum_of_a_suffix_follows_from_two_others():
    data = np.random.default_rng(2).integers(0, 50_000, X.GRID * 7).astype("<u4").tobytes()
    for k in range(7):
        cut = k * X.GRID * 4
        got = X.crc_of_suffix(np.array([crc32(data)], np.uint32), np.array([crc32(data[:cut])], np.uint32), np.array([7 - k]))
        assert got[0] == crc32(data[cut:])


def test_workers_send_on_little_at_a_time(monkeypatch):
    """Of a batch of any size, batches of few ids, with the rows that one batch would have."""
    texts = [None, "", "a b c", *(" ".join(f"w{k}x{i}" for k in range(i % 40 * 30)) for i in range(120))]
    read = [pa.record_batch({"id": list(map(str, range(len(texts)))), "text": texts})] * 2
    sent = lambda: list(X.encode_batches(iter(read), 3, X.VOCABULARY, True))
    whole = pa.Table.from_batches(sent())
    monkeypatch.setattr(X, "MOST_IDS", 5000)
    few = sent()
    most = max(whole["n"].to_pylist())
    assert len(few) > 20 and all(sum(b["n"].to_pylist()) < 5000 + most for b in few)
    assert pa.Table.from_batches(few).to_pylist() == whole.to_pylist()
    assert all(len(r["ids"]) == r["n"] for r in whole.to_pylist())


def test_tables_of_the_plan_need_no_python_workers(docs):
    assert "ExistingRDD" not in X.pack(docs)._jdf.queryExecution().toString()
