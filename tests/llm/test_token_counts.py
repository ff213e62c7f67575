"""Counts against the library on whole texts."""
import random

import public_tokenizers as P
import pytest

from tessera.llm import token_counts as T

PATH = P.path("byte_bpe_50k.json")
PIECES = [" ", "  ", "\n", "\t ", " \n ", "word", "Thhand", "é", "don't", "'s", "123", "1.5e9", "!!", "...", "<|endoftext|>", "日本語",
          " ", "  ", "\x1c", "́", "😀", "aaaaaaaaaaaaaaaa", "<|endof", "text|>", "\x85", "   x"]


def whole(text):
    return len(T.counter(PATH).tokenizer.encode(text, add_special_tokens=False))


@pytest.mark.parametrize("seed", range(40))
def test_pieces_equal_whole(seed):
    r = random.Random(seed)
    texts = ["".join(r.choices(PIECES, k=r.randint(0, 80))) for _ in range(20)] + ["", " ", "  ", "a ", " a"]
    assert T.counter(PATH).counts(texts) == [whole(t) for t in texts]


@pytest.mark.parametrize("seed", range(25))
def test_chunks_equal_whole(seed):
    r = random.Random(seed)
    text = "".join(r.choices(PIECES, k=3000))
    assert T.counter(PATH).huge(text, chunk=r.choice([40, 200, 1000]), overlap=r.choice([8, 30])) == whole(text)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 5000, "\n" * 3000 + "x", "ab " * 3000, "<|endoftext|>" * 500, "é" * 4000 + " end"])
def test_runs_without_boundaries(text):
    assert T.counter(PATH).huge(text, chunk=256, overlap=16) == whole(text)


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "one two", "x"), (3, "one two", "x"), (None, "word " * 30000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = T.count_tokens(df, PATH, carry=["doc_id"]).collect()
    want = [(d, len((t or "").encode()), whole(t or ""), whole(t or "") > 512) for d, t, _ in rows]
    assert [tuple(r) for r in out] == want
    clash = T.count_tokens(df.selectExpr("*", "'own' AS _text", "'own' AS _tokens", "1 AS N_Bytes"), PATH)
    assert clash.columns == ["doc_id", "_text", "_tokens", "n_bytes", "n_tokens", "over_limit"] and clash.filter("_text <> 'own' OR _tokens <> 'own'").isEmpty()
    assert T.count_tokens(df.limit(0), PATH).count() == 0
