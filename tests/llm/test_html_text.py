"""Block reading, the network's gradients, and texts against the known layout of the pages table."""
import html as H
import re

import numpy as np
import pytest

from tessera.llm import html_text as T


@pytest.mark.parametrize("html,want", [
    ("", []), ("plain", ["plain"]), ("<p>one<p>two</p>", ["one", "two"]), ("<div>a <div>b</div> c</div>", ["a", "b", "c"]),
    ("<p>x &amp;amp; y&nbsp;z</p>", ["x &amp; y z"]), ("<p>a<br>b</p>", ["a b"]), ("<script>var x='<p>no</p>'</script><p>yes</p>", ["yes"]),
    ("<!-- <p>no</p>", []), ("a<!-- x -->b", ["ab"]), ("<p>cut off <a hre", ["cut off"]), ("1 < 2 <p>3</p>", ["1 < 2", "3"]),
    ("<p title='a>b'>t</p>", ["t"]), ("<ul><li>a<li>b</ul>", ["a", "b"]), ("<STYLE>x</STYLE><P>Up</P>", ["Up"]), ("<script>open", []),
    ("<p>" + "w " * 50000 + "</p>", [("w " * 50000).strip()]), ("<" * 2000 + "1", ["<" * 2000 + "1"])])
def test_blocks(html, want):
    assert [b.text for b in T.blocks(html)] == want


@pytest.mark.parametrize("html,want", [
    ("<p>a <svg viewBox='0'/> b</p><p>c</p>", ["a b", "c"]), ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", ["so x=2 holds"]),
    ("<math/><p>a</p>", ["a"]), ("<object data='x'><p>a</p>", ["a"]), ("<canvas><p>a</p><p>b</p>", ["a", "b"]), ("<template><p>a</p></template><p>b</p>", ["a", "b"]),
    ("<noscript><p>a</p></noscript>b", ["a", "b"]), ("<p>x<svg><path d='M0'/></svg>y</p>", ["xy"]), ("<textarea><p>a</p></textarea><p>b</p>", ["b"]),
    ("<p>a</p><iframe>rest", ["a"]), ("<p>a<svg><style/><title/></svg> b</p>", ["a b"])])
def test_embedded_elements(html, want):
    assert [b.text for b in T.blocks(html)] == want


def test_embedded_parts_are_labelled_by_their_place():
    page = T.blocks("<article><p>a</p><object><p>b</p><p>c <math><mi>d</mi></math></p></article><footer><canvas>e</canvas></footer>")
    assert [(b.text, T.silver(b)) for b in page] == [("a", 1), ("b", 1), ("c d", 1), ("e", 0)]


def test_gradients():
    r = np.random.default_rng(0)
    m = T.Labeller()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, y = r.normal(size=(3, 5, T.DIM)), (r.random((3, 5)) > 0.5) * 1.0
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], dtype=float)

    def loss():
        p = m.forward(x, mask)[0]
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()
    g = m.gradients(x, y, mask)
    for k, at in [("xf", (3, 7)), ("xb", (5, 40)), ("hf", (2, 50)), ("hb", (1, 20)), ("cf", (17,)), ("cb", (33,)), ("o", (4,)), ("b", (0,))]:
        keep = m.p[k][at]
        m.p[k][at] = keep + 1e-3
        up = loss()
        m.p[k][at] = keep - 1e-3
        down = loss()
        m.p[k][at] = keep
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-3


def layout(h):
    body = re.search("<article>(.*?)</article>", h, re.S)[1]
    parts = [" ".join(H.unescape(re.sub("<[^>]+>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", body)]
    return "\n\n".join(p for p in parts if p)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    model = T.train_labeller(pages)
    rows = [(r["page_id"], r["html"]) for r in pages.collect()]
    got = {r["page_id"]: r for r in T.extract_text(pages, model).collect()}
    wrong = sum(got[i]["text"] != layout(h) for i, h in rows)
    assert wrong <= len(rows) // 200
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    edge = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "<nav><li>a</nav>", None)], "page_id long, html string, text string")
    assert [r["text"] for r in T.extract_text(edge, model).collect()] == ["", "", "", ""]
    assert T.extract_text(edge.limit(0), T.train_labeller(edge.limit(0))).count() == 0
