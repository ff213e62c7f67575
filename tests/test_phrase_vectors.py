"""Phrases and their vectors against plain Python; near vectors without a common word; all features against one by one."""
import math
import os
import random
import re
import time

import pyarrow as pa
import pytest

from tessera import session
from tessera.functions import text as T
from tessera.functions.stem import porter
from tessera.operators import features as FT
from tessera.operators import phrase_vectors as PV
from tessera.session import files_of, forget, written


def phrases(text):
    out, run = set(), []
    for t in [*re.findall(r"\w+|[^\w \t]", (text or "").lower()), "."]:
        if re.fullmatch(r"\w+", t) and t not in T.STOP_WORDS:
            run.append(t)
        elif run:
            out.add(" ".join(run))
            run = []
    return out


TEXTS = ["The quick brown fox, a fox and the hounds.", "", None, "the and of", "Über\nall the  Dinge", "one-two one two! one two", "a.b.c", "dog dog the dog dog", "(x) y_z 42"]


def test_phrases(spark):
    got = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(PV.phrases(PV.F.col("t"))).collect()
    for text, r in zip(TEXTS, got, strict=True):
        assert set(r[0]) == phrases(text) and len(r[0]) == len(set(r[0]))


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [("fox", [1.0, 0.0, 0.5]), ("hound", [0.9, 0.1, 0.5]), ("dog", [0.0, -1.0, 0.0]), ("dog", [0.0, 0.5, 0.0]), ("short", [2.0]), ("none", None), ("hole", [None, 1.0, 0.0])]
    return spark.createDataFrame(rows, "word string, vector array<double>")


def test_vectors(spark, vectors):
    rows = [("a", "f", "fox, fox. fox"), ("a", "f", "the fox"), ("a", "g", "dog short"), ("b", "f", "hound"), ("c", "f", "unknown none"), ("d", "f", None), (None, "f", "fox"), ("e", None, "fox"),
            ("h", "f", "hole and fox dog")]
    got = {(r["term"], r["field"]): list(r["vec"]) for r in PV.phrase_vectors(spark.createDataFrame(rows, "term string, field string, text string"), vectors).collect()}
    m = PV.UNIT
    assert got == {("a", "f"): [m, 0, m // 2], ("a", "g"): [2 * m, -m // 2, 0], ("b", "f"): [900_000, 100_000, 500_000], ("h", "f"): [m, m // 2, m // 2]}
    empty = spark.createDataFrame([], "word string, vector array<double>")
    assert PV.phrase_vectors(spark.createDataFrame(rows, "term string, field string, text string"), empty).count() == 0


def test_similarity_without_a_common_word(spark, vectors):
    texts = spark.createDataFrame([("a", "f", "fox"), ("b", "f", "hound"), ("c", "f", "dog")], "term string, field string, text string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "a"), ("a", "zz"), ("a", "b")], "w1 string, w2 string")
    got = [(r["w1"], r["w2"], r["s"]) for r in PV.pair_similarities(pairs, PV.by_term(PV.phrase_vectors(texts, vectors)), {"s": ("f", "f")}).collect()]
    want = (0.9 + 0.25) / math.sqrt(1.25 * (0.81 + 0.01 + 0.25))
    assert len(got) == 5
    assert {(a, b): round(s, 9) for a, b, s in got} == {("a", "b"): round(want, 9), ("a", "c"): 0.0, ("a", "a"): 1.0, ("a", "zz"): 0.0}


def test_all_features_in_one_pass(spark, vectors):
    texts = spark.createDataFrame([("red foxes", "q1", "fox"), ("fox", "q1", "hound fox"), ("fox", "a2", "dog")], "term string, field string, text string")
    defs = spark.createDataFrame([("red foxes", "See also fox and dog. A fox is fox-like, a FOX ."), ("fox", "no red foxes here, red foxes ")], "term string, definition string")
    pairs = spark.createDataFrame([("red foxes", "fox"), ("fox", "red foxes"), ("fox", "lacking")], "w1 string, w2 string")
    terms = spark.createDataFrame([("red foxes",), ("fox",), ("fox",), (None,)], "term string")
    got = {(r["w1"], r["w2"]): r for r in FT.all_features(pairs, FT.term_material(terms, texts, defs, vectors)).collect()}
    assert set(got) == {("red foxes", "fox"), ("fox", "red foxes"), ("fox", "lacking")}
    a, b = got["red foxes", "fox"], got["fox", "red foxes"]
    assert a.__fields__ == ["w1", "w2", *FT.ALL_FEATURES]
    assert (a.w1_in_def2, a.w2_in_def1, a.w1_see_also2, a.w2_see_also1) == (2.0, 3.0, 0.0, 1.0)
    assert (b.w1_in_def2, b.w2_in_def1, b.w1_see_also2, b.w2_see_also1) == (3.0, 2.0, 1.0, 0.0)
    assert porter("foxes") == porter("fox") and (a.common_tokens, a.same_last, a.same_first, a.same_count, a.single_sides) == (1.0, 1.0, 0.0, 0.0, 1.0)
    assert a.q1_sim == b.q1_sim > 0.9 and a.a2_sim == 0.0 and a.edit_distance == 6.0
    assert got["fox", "lacking"].q1_sim == 0.0 and got["fox", "lacking"].common_tokens is None


def test_columns_vary(spark):
    from tessera.plans import catalog

    catalog.load()
    for name in ("features_all", "features_glossary_definition"):
        rows = catalog.QUERIES[name](spark, "/root/testdata/sf0.01").collect()
        for c in rows[0].__fields__:
            assert len({r[c] for r in rows}) > 1, (name, c)


def test_vectors_by_chunk(spark):
    """Any number of chunks gives the same sums, several vectors of a word add up, millionths round half up."""
    texts = spark.createDataFrame([(f"t{i % 3}", f"f{i % 2}", f"alpha beta{i}, gamma\nbeta{i} alpha") for i in range(40)] + [("none", "f0", "unknown"), (None, "f0", "alpha")],
                                  "term string, field string, text string")
    given = [("alpha", [0.0000025, -0.0000025, None]), ("gamma", [1.0]), ("gamma", [0.5, 2.0, 0.25]), ("beta7", [3.0, 0.0, 1.0]), ("absent", [9.0, 9.0, 9.0]), ("beta8", None)]
    vectors = spark.createDataFrame(given, "word string, vector array<double>")
    found = [{(r["term"], r["field"]): list(r["vec"]) for r in PV.phrase_vectors(texts, vectors, chunks=n).collect()} for n in (1, 3, 50)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 6
    one = spark.createDataFrame([("t", "f", "alpha. gamma gamma. beta7")], "term string, field string, text string")
    assert list(PV.phrase_vectors(one, vectors).first()["vec"]) == [3 + 3_000_000 + 3_000_000, -3 + 4_000_000, 500_000 + 1_000_000]


def test_sums_of_a_task_in_blocks(spark, monkeypatch):
    """Rows held, vectors read and sums kept are bounded; groups of a chunk that goes on stay."""
    for name, few in (("BLOCK", 3), ("STEP", 10), ("ROWS", 25), ("COMPONENTS", 6)):
        monkeypatch.setattr(PV, name, few)
    rng = random.Random(3)
    given = [(f"w{rng.randrange(30)}", [rng.randrange(-9, 9) / 4 for _ in range(rng.randrange(4))]) for _ in range(50)]
    store = written(spark.createDataFrame(given, "word string, vector array<float>"), "vectors")
    rows = sorted((part, f"t{part}-{rng.randrange(6)}", f"f{rng.randrange(2)}", f"w{rng.randrange(40)}", rng.randrange(1, 4)) for part in range(5) for _ in range(60))
    names = ["part", "term", "field", "word", "n"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[i:i + 7]]) for i in range(0, len(rows), 7)]
    want = {}
    for _, t, f, w, n in rows:
        for word, v in given:
            if word == w:
                at = want.setdefault((t, f), [0, 0, 0])
                for i, x in enumerate(v):
                    at[i] += n * round(x * PV.UNIT)
    got = [r for b in PV._task_sums(files_of(store), 3)(iter(batches)) for r in b.to_pylist()]
    assert len(got) == len(want) and {(r["term"], r["field"]): r["vec"] for r in got} == want
    forget(store)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files_of(store))


def test_vectors_are_no_rows_of_a_shuffle(spark, vectors):
    """Nor do texts or vectors of a field that the other side lacks go on to the second join."""
    texts = spark.createDataFrame([("a", "f", "fox"), ("a", "g", "dog"), ("b", "f", "hound")], "term string, field string, text string")
    vecs = PV.phrase_vectors(texts, vectors, terms=spark.createDataFrame([("a",), ("a",)], "term string"))
    assert "Exchange" not in vecs._jdf.queryExecution().executedPlan().toString() and {r["term"] for r in vecs.collect()} == {"a"}
    fields = {"x": ("f", "f"), "y": ("g", "f"), "z": ("g", "g")}
    row = spark.createDataFrame([(["f"], {"f": [1], "g": [2]}), (["g"], {"f": [1], "g": [2]}), (["h"], {"f": [1]}), (None, {"f": [1]})], "_has array<string>, _v1 map<string,array<bigint>>")
    assert [tuple(r) for r in row.select(*[c.alias(k) for k, c in PV.first_side(fields).items()]).collect()] == [([1], [2]), (None, [2]), (None, None), (None, None)]
    defs = spark.createDataFrame([("a", "fox b "), ("b", "hound")], "term string, definition string")
    pairs = spark.createDataFrame([("a", "b")], "w1 string, w2 string")
    plan = FT.all_features(pairs, FT.term_material(pairs.select(PV.F.explode(PV.F.array("w1", "w2")).alias("term")), texts, defs, vectors))._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Project" in x and " AS def1#" not in x and re.search(r"[\[ ]def1#\d+[,\]]", x)]


def test_written_frees_its_shuffles(spark):
    def files():
        dirs = [d.toString() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
        return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    before = files()
    rows = written(spark.range(1000).repartition(5, "id"), "rows")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and rows.count() == 1000


def test_folds_keep_the_data_set_alone(spark, tmp_path, monkeypatch):
    """Definitions, stems and vectors leave the disk before the folds; files that are no scratch table stay."""
    from tessera.plans import q_glossary_models as QM

    words = "red green blue fox hound river stone cloud tower garden".split()
    texts = [f"{words[i % 10]} {words[i * 3 % 10]} {words[i * 7 % 10]}\nthe {words[i % 7]} and {words[i % 4]}" for i in range(40)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, [i / 8, 0.5]) for i in range(8)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(session, "ensure_checkpoint_dir", lambda s: f"{tmp_path}/shared")
    ds = QM.dataset(spark, str(tmp_path))
    left = {os.path.basename(d) for d, _, names in os.walk(f"{tmp_path}/shared") if any(n.endswith(".parquet") for n in names)}
    assert "dataset" in left and not left & {"definitions", "stems", "phrase_vectors", "vectors"} and ds.count() > 30
    forget(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert spark.read.parquet(f"{tmp_path}/documents.parquet").count() == 40
