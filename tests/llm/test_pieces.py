"""Sampled segmentations against enumeration, exact round trips, and independence of batches."""
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tessera.llm import pieces as T

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def store():
    return T.Lattices(PATH, 0.3)


def every(store, text):
    """All segmentations of a short text with their probabilities."""
    score = {p: -0.3 * math.log(i - 259 + 10) for i, p in store.text.items()}
    whole = "▁" + text.replace(" ", "▁")
    found = {}

    def go(at, done, w):
        if at == len(whole):
            found[tuple(done)] = w
            return
        if whole[at] not in score:
            raw = [store.bytes[b] for b in whole[at].encode()]
            go(at + 1, done + raw, w + store.byte_score * len(raw))
        for n in range(1, 17):
            p = whole[at:at + n]
            if at + n <= len(whole) and p in score:
                go(at + n, [*done, ids[p]], w + score[p])
    ids = {p: i for i, p in store.text.items()}
    go(0, [], 0.0)
    total = math.log(sum(map(math.exp, found.values())))
    return {k: w - total for k, w in found.items()}


def test_first_piece_rank(store):
    assert store.text[259] and min(store.text) == 259


@pytest.mark.parametrize("text", ["on the", "a  b", "éa\n", "tion"])
def test_distribution(store, text):
    want = every(store, text)
    n, k = 6000, 3
    got = T._search(store, [random.Random(i).getrandbits(63) for i in range(n)], [text] * n, k)
    first, weight = Counter(), Counter()
    for samples in got:
        names = [tuple(s[0].tolist()) for s in samples]
        assert len(set(names)) == len(names) == min(k, len(want))
        assert all(a[2] >= b[2] for a, b in zip(samples, samples[1:], strict=False))
        first[names[0]] += 1
        for name, s in zip(names, samples, strict=True):
            assert abs(s[1] - want[name]) < 1e-4
            weight[name] += math.exp(s[1] - s[3])
    for name, lp in want.items():
        p = math.exp(lp)
        assert abs(first[name] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
        # Horvitz-Thompson: probabilities over inclusion probabilities estimate each segmentation's mass.
        if p > 0.02:
            assert abs(weight[name] / n - p) < 0.06 * p + 0.012
    second = Counter(tuple(s[1][0].tolist()) for s in got if len(s) > 1)
    for name, lp in want.items():
        p = math.exp(lp)
        expect = sum(math.exp(o) * p / (1 - math.exp(o)) for m, o in want.items() if m != name)
        assert abs(second[name] / n - expect) < 5 * math.sqrt(max(expect, 1e-4) / n) + 2e-3


def test_few_segmentations(store):
    assert [len(x) for x in T._search(store, [1, 2, 3], ["", "\x00", "x"], 50)] == [1, len(every(store, "\x00")), len(every(store, "x"))]
    assert all(s[3] == 0.0 for s in T._search(store, [3], ["x"], 50)[0])
    for text in ("ab c", "onto"):
        assert {tuple(s[0].tolist()) for s in T._search(store, [9], [text], 10_000)[0]} == set(every(store, text))


TEXTS = ["", " ", "a", " a ", "two  spaces", "line\nbreak\ttab", "é一😀", "▁mark ▁ ▁▁", "<s> <0x0A> </s>", "x" * 3000, "w " * 5000, "\x00\x7f", "many  " * 50]


def test_round_trip_and_batches(store):
    decoder, sp = T.Decoder(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    keys = list(range(len(TEXTS)))
    together = T._search(store, keys, TEXTS, 3)
    for key, text, samples in zip(keys, TEXTS, together, strict=True):
        alone = T._search(T.Lattices(PATH, 0.3), [key], [text], 3)[0]
        assert [s[0].tolist() for s in alone] == [s[0].tolist() for s in samples]
        for s in samples:
            assert decoder(s[0].tolist()) == text
            if "▁" not in text:
                assert sp.decode(s[0].tolist()) == text


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "one two", "x"), (3, "one two", "x"), (None, "word " * 2000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, samples string")
    out = T.encode_samples(df, PATH)
    assert out.columns == ["doc_id", "text", "samples"]
    got = out.collect()
    assert [len(r["samples"]) for r in got] == [1, 1, 2, 2, 2] and got[2]["samples"] == got[3]["samples"]
    back = T.decode(out.select("text", T.F.explode("samples.ids").alias("ids")), PATH).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert T.encode_samples(df.limit(0), PATH).count() == 0


def test_query_gives_the_segmentations(spark, tmp_path):
    from tessera.llm.queries import QUERIES

    texts = dict(enumerate([None, "", "one two", "é一😀 x\n", "▁mark"]))
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got, decoder = QUERIES["op4_sample_pieces"](spark, str(tmp_path)).collect(), T.Decoder(PATH)
    assert {r["doc_id"] for r in got} == set(texts)
    for r in got:
        assert decoder(r["ids"]) == (texts[r["doc_id"]] or "") and len(r["ids"]) == r["n_pieces"] and r["round_trip"]


def test_decoding_many_lists_at_once(store):
    decoder = T.Decoder(PATH)
    lists = [s[0] for f in T._search(store, [1, 2, 3, 4], ["on the  é way", "", " a", "▁\n"], 2) for s in f]
    for some in (lists, [lists[2]], [lists[2], lists[2]]):
        ends = np.cumsum([0, *map(len, some)])
        ids = pa.array(np.concatenate(some).astype(np.int32))
        assert list(decoder.all_utf8(ids, ends)) == [decoder.utf8(x.tolist()) for x in some]


def test_words_are_numbered_alike_whatever_the_store_holds(store):
    rows = [["on", "the", "on"], [], ["way", "the"]]
    for _ in range(2):
        number = store.numbers(rows)
        assert number[0] == number[2] and number[1] == number[4] and len(set(number.tolist())) == 3
        assert [store.words[w] for r in rows for w in r] == number.tolist()
        store.keep, keep = 1, store.keep
        store.numbers([["other"], ["on"]])
        store.keep = keep
