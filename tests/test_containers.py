"""Nested containers against a plain stack parser; known layouts with nested tags, other quotes and missing ends."""
import random
import re

import pytest

from tessera.operators import containers as C

E = C.Element


def plain(html, element):
    """(start, end) tag numbers by a stack per tag name."""
    tags = [m[0] for m in re.finditer(r"""(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[/!?a-z][^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>""", html)]
    stack, out = [], []
    for i, t in enumerate(tags):
        if not re.match(rf"(?is)</?{element.tag}[\s/>]", t):
            continue
        if t.startswith("</"):
            if stack:
                s, ok = stack.pop()
                if ok:
                    out.append((s, i))
        else:
            m = re.search(rf"""(?is)\s{element.attr}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", t) if element.attr else None
            value = next((g for g in m.groups() if g is not None), "") if m else None
            ok = element.attr is None or (value is not None and (element.value in value if element.how == "has" else element.value == value))
            stack.append((i, ok))
    return sorted(out + [(s, len(tags)) for s, ok in stack if ok])


PIECES = ["<div>", "</div>", "<DIV class='x'>", '<div class="x y">', "<div class=x>", "</div >", "<!-- <div> -->", "<script>var a = '<div class=\"x\">';</script>", "text ", "<b title='a>b'>", "</b>",
          "<divide>", "</p>", "<p>", "&amp;", "<div/>", "1 < 2 ", "<br>", '<div data-class="x">', "é", '<div id="k" class = "x">']


def test_spans_against_a_stack(spark):
    r = random.Random(6)
    pages = ["".join(r.choices(PIECES, k=r.randint(0, 40))) for _ in range(400)] + [""]
    for e in (E("div"), E("div", "class", "x"), E("div", "class", "x", "has")):
        df = spark.createDataFrame([(p,) for p in pages], "html string").select("html", C.element_spans(C.page_tags(C.F.col("html"))["tags"], e).alias("s"))
        for row in df.collect():
            assert [tuple(s) for s in row["s"]] == plain(row["html"], e), row["html"]


def test_text_and_paths(spark):
    html = "<h1>a <span class='q'>one <span>two</span> three</span></h1><span class=q>no</span><div><h1><span CLASS=\"q\">x &lt; <!-- c -->y</span></h1></div>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<h1><span class='q'>open")], "page_id int, html string")
    got = {r["page_id"]: r["v"] for r in C.page_fields(pages, [C.Field("v", (E("h1"), E("span", "class", "q")))]).collect()}
    assert got == {1: ["one two three", "x < y"], 2: [], 3: [], 4: ["open"]}


QA = """<table><tr><td class="postcell"><p>How <b>to</b></p><table><tr><td class="inner"><p>nested</p></td></tr></table><p>end?</p></td>
<td class='answercell'>no paragraph</td><td class="answercell x"><p>other class</p></td><td class=answercell><p>yes</p></td></tr></table>
<div class="box related-box"><div><a class="question-hyperlink" href='/q/1'>One <i>1</i></a></div><a href="/no">no</a><a class='question-hyperlink'>no target</a>
<a href=/q/2 class="question-hyperlink">Two</a></div><a class="question-hyperlink" href="/out">outside</a>"""


def test_known_layouts(spark):
    page = lambda h: spark.createDataFrame([(1, h)], "page_id int, html string")
    r = C.page_fields(page(QA), C.QA_SITE).first()
    assert r["questions"] == ["How to\nnested\nend?"] and r["answers"] == ["", "yes"]
    assert [tuple(x) for x in C.link_rows(page(QA), C.QA_SITE_RELATED).orderBy("pos").collect()] == [(1, 0, "One 1", "/q/1"), (1, 2, "Two", "/q/2")]
    r = C.page_fields(page('<h1><span class="rendered_qtext">Q <span>1</span>?</span></h1><span class="ui_qtext_rendered_qtext">A<span>b</span></span>'), C.QA2_SITE).first()
    assert (r["questions"], r["answers"]) == (["Q 1?"], ["Ab"])
    r = C.encyclopedia_records(page('<span class="term_title">Definition of: light \n</span><div id="encyc_entry">A <div>kind</div> of\n\n\n\nadvert</div>')).first()
    assert (r["term"], r["definition"]) == ("light", "A kind of")
    r = C.glossary_site_records(page('<article class="text-page"><header><header>x</header> Term\n</header><div><p>First</p><p>2</p></div></article>')).first()
    assert (r["term"], r["definition"]) == ("x Term", "First")
    for rows in (C.encyclopedia_records(page(None)), C.glossary_site_records(page(""))):
        assert (rows.first()["term"], rows.first()["definition"]) == ("", "")


@pytest.mark.parametrize("n", [3000])
def test_many_and_deep_elements(spark, n):
    flat, deep = "<div class='x'>a</div>" * n, "<div class='x'>" * n + "a" + "</div>" * n
    got = spark.createDataFrame([(flat,), (deep,)], "html string").select(C.F.size(C.element_spans(C.page_tags(C.F.col("html"))["tags"], E("div", "class", "x")))).collect()
    assert [r[0] for r in got] == [n, n]
