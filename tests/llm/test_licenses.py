"""License places against a plain scan of all word positions."""
import random
import re

from tessera.llm import licenses as L

LABELS = {t.label: t.words for t in L.PHRASES}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    ws = words(text)
    return sorted((i, label) for label, p in LABELS.items() for i in range(len(ws)) if ws[i:i + len(p)] == p)


def every(text, templates, df):
    """All notices by the definition: enough index words agree, key phrases stand in the window."""
    ws, out = words(text), set()
    for t in templates:
        index = t.index_words(df)
        for start in range(-len(t.words), len(ws)):
            hits = sum(w in index and 0 <= start + j < len(ws) and ws[start + j] == w for j, w in enumerate(t.words))
            window = " " + " ".join(ws[max(start - t.slack, 0): max(start + len(t.words) + t.slack, 0)]) + " "
            if hits >= t.needed(index) and all(f" {k} " in window for k in t.key_phrases):
                out.add((start, t.label))
    return sorted(out)


PIECES = ["GNU General", "public License", "apache", "license,", "Version 2.0", "cc", "by", "by-nc", "MIT", "mit license", "é", "Apache\nLicense", "licensed under the", "gnu gnu",
          "the", "word", "K", "cc-by", "Creative Commons Attribution 4.0", "free and unencumbered software released into the", "public domain", "İ"]


def test_against_plain_scan(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(PIECES, k=r.randint(0, 25)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "MIT License " * 20_000), (903, "x" * 300_000), (None, "cc by"), (904, "Apache License"), (904, "Apache License"), (905, "mIT lIcense")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS Labels", "1 AS _found", "2 AS c0", "3 AS places")
    freq = L.document_frequencies(df, "text", [*L.PHRASES, *L.NOTICES])
    assert freq["mit"] == sum("mit" in words(t) for _, t in rows) and freq["apache"] == sum("apache" in words(t) for _, t in rows)
    out = L.scan_licenses(df)
    assert out.columns == ["doc_id", "text", "_found", "c0", "n_words", "base_places", "places", "labels", "score"]
    got = out.collect()
    assert len(got) == len(rows)
    for o in got:
        ws = words(o["text"])
        assert o["n_words"] == len(ws)
        assert sorted((p["start"], p["label"]) for p in o["base_places"]) == brute(o["text"])
        if len(ws) < 200:
            assert sorted((p["start"], p["label"]) for p in o["places"]) == every(o["text"], [*L.PHRASES, *L.NOTICES], freq)
            assert o["labels"] == sorted({p["label"] for p in o["places"]})
        assert 0 <= o["score"] <= 1 and (o["score"] == 1 or not o["base_places"])
    assert sum(len(o["places"]) > len(o["base_places"]) for o in got) > 50
    assert L.scan_licenses(df.limit(0)).count() == 0


def test_changed_notice(spark):
    notice = next(t for t in L.NOTICES if t.label == "mit-notice")
    changed = notice.words[:14] + ["very", "own"] + notice.words[14:40] + notice.words[41:]
    rows = [(1, "Intro. " + " ".join(changed)), (2, " ".join(w for w in notice.words if w != "granted"))] + [(3 + i, "the software is free to use") for i in range(20)]
    got = {o["doc_id"]: o["labels"] for o in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ["mit-notice"] and all(not got[i] for i in got if i != 1)
