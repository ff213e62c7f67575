"""Document packs: absent sources, unknown shapes, broken JSON, first definitions, packs of pairs."""
import json

from tessera.sources import packs as K

FIELDS = {"questions": "$", "related_questions": "$[0]", "definition": "$"}


def test_shapes(spark):
    rows = [("a", "s1", 1, '[{"questions": ["old"]}]'), ("a", "s1", 2, json.dumps([{"questions": ["q1", None, "q2"], "related_questions": [["t", "/x"], ["u"]], "odd": {"deep": [1, {"k": 2}]}}, {"questions": "single"}, 7, None])),
            ("a", "s2", 1, "not json"), ("b", "s2", 1, '[{"definition": "first"}, {"definition": "second"}]'), ("b", "s1", 1, None), ("c", "s1", 1, " "), ("d", "s1", 1, '{"questions": ["no list of records"]}'),
            ("e", "s1", 1, '[{"questions": {"an": "object"}}, {"questions": []}]')]
    store = spark.createDataFrame(rows, "term string, source string, version int, content string")
    terms = spark.createDataFrame([(t,) for t in "abcdefa"], "term string")
    content = K.content_for_terms(terms, store, ["s1", "s2"])
    got = {(r["term"], r["source"]): r["content"] for r in content.collect()}
    assert len(got) == 12 and got["f", "s1"] == "" and got["b", "s1"] == "" and "old" not in got["a", "s1"]
    pages = K.page_records(content)
    assert {(r["term"], r["source"]): r["n"] for r in pages.groupBy("term", "source").agg(K.F.count("*").alias("n")).collect()} == {("a", "s1"): 4, ("b", "s2"): 2, ("e", "s1"): 2}
    kept = pages.filter("term = 'a' AND page_no = 0").select(K.F.to_json("page").alias("j")).first()["j"]
    assert json.loads(kept)["odd"] == {"deep": [1, {"k": 2}]}  # an unknown shape survives
    items = K.all_items(pages, FIELDS)
    found = sorted(tuple(r) for r in items.select("term", "source", "page_no", "field", "item_no", "text").collect())
    assert found == sorted([("a", "s1", 0, "questions", 0, "q1"), ("a", "s1", 0, "questions", 2, "q2"), ("a", "s1", 1, "questions", 0, "single"), ("a", "s1", 0, "related_questions", 0, "t"),
                            ("a", "s1", 0, "related_questions", 1, "u"), ("b", "s2", 0, "definition", 0, "first"), ("b", "s2", 1, "definition", 0, "second"),
                            ("e", "s1", 0, "questions", 0, '{"an":"object"}')])
    assert [tuple(r) for r in K.first_item(items, "definition").collect()] == [("b", "s2", "first")]
    packs = {r["term"]: r["pack"] for r in K.term_packs(items).collect()}
    assert packs["a"] == {"s1.questions": ["q1", "q2", "single"], "s1.related_questions": ["t", "u"]}
    pairs = spark.createDataFrame([("a", "b"), ("a", "zz"), ("a", "b")], "w1 string, w2 string")
    both = K.pair_packs(pairs, K.term_packs(items)).collect()
    assert len(both) == 3 and all(r["pack1"] == packs["a"] for r in both) and {r["w2"]: r["pack2"] for r in both} == {"b": {"s2.definition": ["first", "second"]}, "zz": {}}
    long = K.pair_items(pairs, items)
    assert long.filter("w2 = 'b' AND side = 2").count() == 2 and long.filter("w2 = 'zz'").count() == 5
    assert K.all_items(K.page_records(content.limit(0)), FIELDS).count() == 0
