"""License scan through a positional index of rare licence words (native DataFrame operations only).

Templates are licence phrases and notices. Every template is indexed under its words of highest IDF
(document frequencies counted over the whole corpus): the index maps a word to the places where
it stands in templates. A text looks up its index words; each of its places minus a template place is
where that template would begin, and postings are intersected by that relative position: a beginning at
which at least two of the template's index words (one, if it has but one) agree is a candidate. It
counts if all mandatory key phrases of the template stand in the words that it would cover.

For a phrase template the key phrase is the whole phrase and its window has the phrase's length, so
exactly the places where its words stand consecutively are found, whatever the IDF is. A notice may
be changed or have words put in: its window is ``SLACK`` words longer on both sides.

All of it stays in the row of the text: nothing is shuffled but one row for each vocabulary word and
task for the document frequencies. Texts without any word that every candidate needs one of are only counted.

Defined results: a null or wordless text has no words, no labels and score 0; identical places of one
template count once; ties in IDF go to the smaller word; repeated rows are scanned one by one; an
empty table gives an empty result; texts of any length are read whole, their words are held as one
array in the row, and the work is linear in words and sorted by lookups. Input columns named like an output
column, in any case, give way to it."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried
from .spans import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SLACK = 8  # words that a notice may have more or less
PHRASE_WORDS, NOTICE_WORDS = 2, 4  # index words of a template
AGREE = 2  # index words that must agree on the beginning
STEP = 1 << 40  # beginnings of different templates are so far apart


@dataclass(frozen=True)
class Template:
    """Lower-case words; ``keys`` are mandatory phrases (none: the whole text, word for word)."""
    label: str
    text: str
    keys: tuple[str, ...] = field(default=())

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_phrases(self) -> list[str]:
        return list(self.keys) or [self.text]

    @property
    def slack(self) -> int:
        return SLACK if self.keys else 0

    def index_words(self, df: dict[str, int]) -> list[str]:
        """Highest IDF first."""
        return sorted(set(self.words), key=lambda w: (df.get(w, 0), w))[: NOTICE_WORDS if self.keys else PHRASE_WORDS]

    def needed(self, index_words: list[str]) -> int:
        return min(AGREE, sum(w in index_words for w in self.words))


# The phrases that the contract names, and public licence notices.
PHRASES = [Template("gpl", "gnu general public license"), Template("apache", "apache license"), Template("cc-by", "cc by"), Template("mit", "mit license")]
NOTICES = [
    Template("agpl", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
             ("redistribution and use in source and binary forms",)),
    Template("cc-by-4.0", "creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by"
             " the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "free software foundation")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ("permission to use copy modify", "with or without fee")),
    Template("lgpl", "gnu lesser general public license"),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
             " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"
             " copies of the software", ("permission is hereby granted free of charge", "without restriction")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
]


def _texts(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def _one_word(words: list[str]) -> str:
    """Pattern of any of the words as a whole word, A-Z in either case."""
    inside = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    return rf"(?i)(?<!{inside})(?:{'|'.join(sorted(words))})(?!{inside})"


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased, in order."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, text: str, templates: list[Template]) -> dict[str, int]:
    """Documents that hold each word of the templates."""
    known = _texts(sorted({w for t in templates for w in t.words}))
    met = docs.select(F.explode(F.array_intersect(words_of(docs[text]), known)).alias("w"))
    return {r["w"]: r["n"] for r in met.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def placements(words: Column, templates: list[Template], df: dict[str, int]) -> Column:
    """array<struct<t, start, share>>: number of the template, word at which it begins (below 0: cut off), and the share of its words in place."""
    index = [t.index_words(df) for t in templates]
    postings: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(templates):
        for at, w in enumerate(t.words):
            if w in index[k]:
                postings.setdefault(w, []).append((k, at))
    shift = max(len(t.words) for t in templates)  # beginnings before the text stay positive
    names = sorted(postings)
    table = F.array(*[F.array(*[F.lit(k * STEP + shift - at).cast("long") for k, at in postings[w]]) for w in names])
    number = F.create_map(*[x for i, w in enumerate(names) for x in (F.lit(w), F.lit(i))])
    needed = F.array(*[F.lit(t.needed(i)) for t, i in zip(templates, index, strict=True)])
    parts = F.array(*[F.struct(_texts(t.words).alias("words"), _texts([f" {k} " for k in t.key_phrases]).alias("keys"), F.lit(t.slack).alias("slack")) for t in templates])

    looked_up = F.filter(F.transform(words, lambda w, i: F.when(w.isin(names), F.struct(i.cast("long").alias("at"), w.alias("w")))), lambda x: x.isNotNull())
    begins = F.flatten(F.transform(looked_up, lambda x: F.transform(F.get(table, F.element_at(number, x["w"])), lambda p: p + x["at"])))

    def agreed(code: Column) -> Column:
        return F.array_distinct(F.filter(code, lambda c, i: F.get(code, i + F.get(needed, F.floor(c / STEP).cast("int")) - 1) == c))

    def checked(code: Column) -> Column:
        k = F.floor(code / STEP).cast("int")
        return let(F.struct(k.alias("t"), (code - k * F.lit(STEP) - shift).cast("int").alias("start"), F.get(parts, k).alias("p")), lambda c: verified(c["t"], c["start"], c["p"]))

    def verified(k: Column, start: Column, p: Column) -> Column:
        first = F.greatest(start - p["slack"], F.lit(0))
        window = F.slice(words, first + 1, F.greatest(start + F.size(p["words"]) + p["slack"] - first, F.lit(0)))
        same = F.filter(F.transform(p["words"], lambda w, i: (start + i >= 0) & F.coalesce(F.get(words, F.greatest(start + i, F.lit(0))) == w, F.lit(False))), lambda x: x)
        text = F.concat(F.lit(" "), F.array_join(window, " "), F.lit(" "))
        found = let(text, lambda x: F.forall(p["keys"], lambda key: F.contains(x, key)))
        return F.when(found, F.struct(k.alias("t"), start.alias("start"), (F.size(same).cast("double") / F.size(p["words"])).alias("share")))

    return let(F.sort_array(begins), lambda code: F.filter(F.transform(agreed(code), checked), lambda x: x.isNotNull()))


def scan_licenses(docs: DataFrame, text: str = "text", carry: list[str] | None = None, phrases: list[Template] = PHRASES, notices: list[Template] = NOTICES,
                  df: dict[str, int] | None = None) -> DataFrame:
    """Rows of ``docs`` (columns ``carry``, default all) with n_words, base_places, places (arrays of label, start, share), labels and score.

    ``df``: document frequencies of the templates' words, counted here if not given."""
    templates = [*phrases, *notices]
    df = document_frequencies(docs, text, templates) if df is None else df
    index = [t.index_words(df) for t in templates]
    # Of m index words of which n must agree, one of the m - n + 1 rarest is there.
    asked = {w for t, i in zip(templates, index, strict=True) for w in i[: len(i) - t.needed(i) + 1]}
    names, rest = carried(docs, carry, ["n_words", "base_places", "places", "labels", "score"])
    body = F.coalesce(docs[text], F.lit(""))
    kind = "array<struct<t:int,start:int,share:double>>"
    found = F.when(body.rlike(_one_word(sorted(asked))), let(words_of(body), lambda w: placements(w, templates, df))).otherwise(F.array().cast(kind)).cast(kind)
    labels = _texts([t.label for t in templates])
    rows = docs.select(*rest, F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), found.alias("_found"))

    def listed(x: Column) -> Column:
        return F.transform(x, lambda p: F.struct(F.get(labels, p["t"]).alias("label"), p["start"].cast("long").alias("start"), p["share"].alias("share")))

    found = F.col("_found")
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "n_words", listed(F.filter(found, lambda p: p["t"] < len(phrases))).alias("base_places"),
                       listed(found).alias("places"), F.array_sort(F.array_distinct(F.transform(found, lambda p: F.get(labels, p["t"])))).alias("labels"),
                       F.coalesce(F.array_max(F.transform(found, lambda p: p["share"])), F.lit(0.0)).alias("score"))
