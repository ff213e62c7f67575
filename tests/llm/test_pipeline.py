"""Every stage on its predecessor's rows against brute force; the run as a whole."""
import public_tokenizers

import corpus_pipeline as C
from tessera.llm.common import materialise
from tessera.llm.pieces import Decoder
from tests.llm.test_jaccard import brute
from tests.llm.test_mixing import targets, words


def test_stages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns, before, after = docs.columns, docs.collect(), {}
    for name, stage in C.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_small), name)
        assert docs.columns == columns
        after[name] = docs.collect()
        assert set(map(tuple, after[name])) <= set(map(tuple, before))
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}
            kept = {r["doc_id"] for r in after[name]}
            assert all((r["doc_id"] in kept) == labels[r["doc_id"]] for r in before if r["doc_id"] in labels)
        elif name == "exact_dedup":
            best = {}
            for r in before:
                best[r["text"] or ""] = max(r["doc_id"], best.get(r["text"] or "", -1))
            assert sorted(r["doc_id"] for r in after[name]) == sorted(best.values())
        elif name == "near_duplicates":
            want = {c for _, _, c in brute([(r["doc_id"], r["text"]) for r in before], 5, 80)}
            assert {r["doc_id"] for r in after[name]} == want and len(after[name]) == len(want)
        else:
            sizes, taken = {}, {}
            for r in before:
                sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
            for r in after[name]:
                taken[r["source"]] = taken.get(r["source"], 0) + words(r["text"])
            for s, t in targets(sizes).items():
                assert abs(taken.get(s, 0) - t) <= max(words(r["text"]) for r in before if r["source"] == s) / 2 + 1
        before = after[name]
    out = C.STAGES[-1][1](spark, docs, sf_small).collect()
    decoder = Decoder(public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] or "" for r in before}
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in before)
    assert all(decoder(s["ids"]) == texts[r["doc_id"]] for r in out for s in r["samples"])


def test_run_and_empty_table(spark, sf_small, tmp_path):
    assert C.run(spark, sf_small).count() > 0
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf_small}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_near_copies_with_null_and_shared_ids(spark):
    import corpus_pipeline

    near = [" ".join(f"x{j}" for j in range(80)) + f" tail{i}" for i in range(6)]
    other = [" ".join(f"{c}{j}" for j in range(60)) for c in "yz"]
    rows = [(None, near[0]), (None, near[1]), (5, near[2]), (9, near[3]), (9, other[0]), (5, near[4]), (None, other[1]), (None, other[1] + " end"), (None, None), (None, "")]
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    kept = [r for r in got if r[1] in near]
    assert len(kept) == 1 and kept[0][0] == 5
    assert (9, other[0]) in got and sum((r[1] or "").startswith(other[1]) for r in got) == 1 and len(got) == 5


def test_columns_of_any_name_survive(spark, tmp_path):
    texts = ["plain good words that read well " * 4, "plain good words that read well " * 4, None, "", "other sentences about something else entirely " * 3]
    rows = [(i, t, "ab"[i % 2], f"own {i}") for i, t in enumerate(texts)]
    mine = ["score", "Predicted", "kept", "keep_id", "group_size", "size", "target", "copies", "_copy", "text_hash", "_gone_id", "_row", "c0", "a.b", "samples"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, own string").selectExpr("*", "'de' AS lang", *[f"own AS `{c}`" for c in mine])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(all(r[i] == r["own"] for i in range(5, len(docs.columns))) for r in got), name
    assert C.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)
