import public_tokenizers
import pytest
from tokenizers import Tokenizer

from snapweave.llm import tokens as X

TEXTS = ["", "a", "\n", "\n\n\nab\n\n\n\nc", "one two\nthree  \n  four", "é\nÉé 日本語\n😀😀\n", "x" * 3000 + "\n" + " " * 50 + "y", "\r\n\r\nq", "<|endoftext|>", "a<|endoftext|><|endoftext|>\nb <|endoftext|>\n<|endoftext|>", "<|endof\ntext|>"]


def brute(text, encoding, rule, separator):
    ends, at = [], 0
    while (k := text.find(separator, at)) >= 0:
        at = k + len(separator)
        ends.append(at)
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    starts = [0, *ends[:-1]]
    counts, crossing = [0] * len(ends), [0] * len(ends)
    at = 0
    data = text.encode()
    cut = [len(text[:e].encode()) for e in ends]
    begin = [0, *cut[:-1]]
    for n in encoding:
        touched = [s for s in range(len(cut)) if begin[s] < at + n and cut[s] > at]
        held = [min(at + n, cut[s]) - max(at, begin[s]) for s in touched]
        pick = {"first": touched[0], "last": touched[-1], "most": touched[held.index(max(held))]}[rule]
        counts[pick] += 1
        crossing[pick] += len(touched) > 1
        at += n
    assert at == len(data)
    return starts, ends, counts, crossing


@pytest.mark.parametrize("separator", ["\n", " ", "\n\n", "é"])
@pytest.mark.parametrize("rule", X.RULES)
def test_attribution_by_brute_force(rule, separator):
    encode, lengths = X.tokenizer()
    crossed = 0
    for text in TEXTS:
        got = [x.tolist() for x in X.attribute(text, encode, lengths, rule, separator)]
        want = brute(text, [int(lengths[i]) for i in encode(text)], rule, separator)
        assert tuple(got) == tuple(map(list, want))
        crossed += sum(got[3])
    assert crossed > 0 or separator in ("é", "\n\n")


def test_ids_are_those_of_the_published_tokenizer(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode, _ = X.tokenizer()
    for text in [*TEXTS, "it's I'LL", *[r["text"] or "" for r in docs.collect()]]:
        assert encode(text) == t.encode(text, add_special_tokens=False).ids


def test_sections_cover_texts_and_counts_add_up(docs, odd, none):
    encode, _ = X.tokenizer()
    for df in (docs, odd):
        rows = X.section_counts(df).collect()
        texts = [r["text"] or "" for r in df.collect()]
        assert sum(r["n_tokens"] for r in rows) == sum(len(encode(t)) for t in texts)
        assert sum(r["end"] - r["start"] for r in rows) == sum(map(len, texts))
        assert sum(r["section"] == 0 for r in rows) == len(texts)
    assert X.section_counts(none).count() == 0
    long = docs.sparkSession.createDataFrame([(1, "wörd two\n" * 300_000)], "doc_id long, text string")
    assert X.section_counts(long).agg({"section": "max", "n_tokens": "sum"}).first() == (299_999, len(encode("wörd two\n")) * 300_000)
    with pytest.raises(ValueError, match="rule"):
        X.section_counts(docs, rule="none")
