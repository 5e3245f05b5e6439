import random
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import html


def texts(page):
    return [t for _, t, _ in html.blocks_of(page)]


def test_blocks():
    assert texts("<p>a &amp;amp; b<br>c</p><!-- x <p>no --><script>var t='</p>';</script><p><b>d <i>e</i>f<p>g") == ["a &amp; b c", "d ef", "g"]
    assert texts("x < y &lt;p&gt; <div>\n\tz&nbsp; w &eacute;") == ["x < y <p>", "z w é"]
    assert texts('<p title="a>b">t</p><p title="open>u</p><p') == ["t", "u"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><td>f</table>") == ["a", "b", "c", "d", "e", "f"]
    assert texts(None) == texts("") == texts("<p> </p>") == [] and texts("plain") == ["plain"]
    assert [p for p, _, _ in html.blocks_of('<div class="site-Header top"><p>a<p>b</div>')] == [("<div", "site", "header", "top", "<p")] * 2
    assert html.blocks_of("<p><a>link</a> no</p>")[0][2] == 4
    assert len(html.blocks_of("<div>" * 3000 + "deep")) == 1


def test_skipped_elements():
    assert texts("<svg width=1/><p>a</p><svg-icon>b</svg-icon><svg><text>no</text></svg><p>c") == ["a", "b", "c"]
    assert texts("<template-part><p>a</p></template-part><template>no</template><p>b<title-bar>c</title-bar>") == ["a", "bc"]
    assert texts("<svg>open to the end <p>no") == []


class Article(HTMLParser):
    """Lines of the article element by the standard library's parser: an own reading of the page."""

    BLOCKS = set("address article aside blockquote div dl dt dd figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul body html".split())

    def __init__(self):
        super().__init__()
        self.inside, self.foreign, self.lines, self.run = 0, 0, [], ""

    def cut(self):
        if line := " ".join(self.run.split()):
            self.lines.append(line)
        self.run = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.cut()
        if tag == "br":
            self.run += " "
        self.inside += tag == "article"
        self.foreign += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.cut()
        self.inside -= tag == "article"
        self.foreign -= tag in ("script", "style")

    def handle_data(self, data):
        if self.inside and not self.foreign:
            self.run += data


def article_of(page):
    p = Article()
    p.feed(page)
    p.close()
    p.cut()
    return "\n".join(p.lines)


def test_texts_equal_another_parsers_articles(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    pages = spark.createDataFrame([(r.page_id, r.url, r.html) for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(pages.union(pages)).collect()}
    equal = sum(got[r.page_id] == article_of(r.html) for r in rows)
    assert equal >= 0.98 * len(rows)


def test_gradients():
    rng = np.random.default_rng(1)
    x, live = rng.normal(size=(4, 3, html.DIMS)).astype(np.float32), np.array([[1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool)
    p = [rng.normal(0, 0.3, s).astype(np.float32) for s in ((html.DIMS, 4 * html.HIDDEN), (html.HIDDEN, 4 * html.HIDDEN), (4 * html.HIDDEN,))]
    g = rng.normal(size=(4, 3, html.HIDDEN)).astype(np.float32) * live[:, :, None]
    keep: list = []
    html.cells(x, live, *p, keep)
    grads = html.cells_back(g, x, live, p[0], p[1], keep)
    for k, at in ((0, (5, 7)), (0, (100, 50)), (1, (3, 20)), (2, (40,))):
        up, down = [q.copy() for q in p], [q.copy() for q in p]
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        want = ((html.cells(x, live, *up) - html.cells(x, live, *down)) * g).sum() / 2e-2
        assert grads[k][at] == pytest.approx(want, rel=0.05, abs=0.02)


def test_pages_that_it_was_not_trained_on():
    model = list(html.trained())
    wrong = total = 0
    for i in range(150):
        blocks, y = html.made_page(random.Random(77_000_000 + i))
        wrong += (html.label(model, [html.vectors(blocks)])[0] != np.array(y, bool)).sum() if blocks else 0
        total += len(y)
    assert wrong <= 0.02 * total


def test_batches_do_not_change_labels():
    model, pages = list(html.trained()), [html.vectors(html.made_page(random.Random(i))[0]) for i in range(20)] + [np.zeros((0, html.DIMS), np.float32)]
    together = html.label(model, pages)
    assert all(np.array_equal(a, html.label(model, [p])[0]) for a, p in zip(together, pages))


def test_query_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("text", F.lit("clash"))
    odd = spark.createDataFrame([(-1, None, None), (-2, "u", ""), (-3, "u", "<nav><a href=x>menu</a></nav>"), (None, None, "<article><h1>Title</h1><p>" + "Long words here. " * 20_000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.main_text(pages.unionByName(odd, allowMissingColumns=True)).collect()}
    assert (got[-1].text, got[-2].text, got[-3].text) == ("", "", "") and got[-1].n_chars == 0
    assert got[None].text == "Title\n" + ("Long words here. " * 20_000).strip()
    exact = 0
    rows = pages.collect()
    for r in rows:
        want = "\n".join(t for p, t, _ in html.blocks_of(r.html) if "<article" in p)
        exact += got[r.page_id].text == want
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    assert exact >= 0.98 * len(rows)
    assert html.main_text(pages.where("false")).count() == 0
