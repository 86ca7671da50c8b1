"""HTML extraction: blocks, the network against plain code, and held-out accuracy."""

import html as markup
import re

import numpy as np
import pytest

from runlumen.llm import pages
from runlumen.llm.queries import QUERIES

SAMPLE = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


def texts(html):
    return pages.blocks(html, pages.Paths()).texts


def article(html):
    """Text of the template of the given pages, by plain regular expressions."""
    inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
    cut = [" ".join(markup.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in cut if b)


@pytest.fixture(scope="module")
def model(spark):
    return pages.train(spark.read.parquet(f"{LARGER}/pages.parquet"))


def test_blocks():
    assert texts("") == [] and texts("  \n") == [] and texts("plain") == ["plain"]
    assert texts("<p>a  b\n c<br>d</p>e") == ["a b c d", "e"]
    assert texts("<p>a<b>b</b>c<p>d") == ["abc", "d"]
    assert texts("a<script>if (x<y) '<p>no</p>'</script >b<style>p{}</style><!-- <p>no</p> -->c") == ["abc"]
    assert texts("a<!-- open <p>b") == ["a"] and texts("a<script>b") == ["a"]
    assert texts("&lt;p&gt; &amp;amp; &eacute;&#233;&#x1F642; &nbsp;x &am") == ["<p> &amp; éé🙂 x &am"]
    assert texts("<p title='a>b' class=\"x\">5 < 6 > 4</p>") == ["5 < 6 > 4"]
    assert texts("<li>a<li>b<ul><li>c</ul><table><tr><td>d<td>e<tr><td>f</table>") == list("abcdef")
    assert texts('<p "broken>x</p>y') in (["x", "y"], ["xy"]) and len(texts("<div>" * 3000 + "deep")) == 1


def test_paths():
    paths = pages.Paths()
    page = pages.blocks('<body><nav><ul><li><a href="/">A</a></ul></nav><article class="Post main-1"><p>B<aside>C</aside>'
                        '<p><b>D<br><p>E</article><div id=footer>F', paths)
    def path(i):
        return [] if i < 0 else path(paths.parent[i]) + list(paths.names[i])
    assert [path(p) for p in page.paths] == [
        ["body", "nav", "ul", "li", "a"], ["body", "article", "post", "main", "p"],
        ["body", "article", "post", "main", "aside"], ["body", "article", "post", "main", "p", "b"],
        ["body", "article", "post", "main", "p"], ["body", "div", "footer"]]
    assert page.linked == [1.0, 0, 0, 0, 0, 0]
    assert pages.marks(paths)[page.paths].tolist() == [0, 1, 0, 1, 1, 0]


def some_inputs():
    made = pages.layouts(["one two three.", "a"], 5, seed=3)
    paths = pages.Paths()
    x = pages.inputs([pages.blocks(h, paths) for h, _ in made], paths)
    return x, np.concatenate([made[i][1] for i in x.order]).astype(np.float32)


def test_scores_against_plain_lstm():
    """Each page block by block, with none beside it."""
    x, _ = some_inputs()
    model = pages.Labeller(seed=1)
    vectors, v, h = model.block_vectors(x), model.values, pages.HIDDEN
    wanted, at = [], 0
    for size in x.sizes:
        own, states = vectors[at:at + size], {}
        for way, order in (("ahead", range(size)), ("back", range(size - 1, -1, -1))):
            hidden, cell = np.zeros(h), np.zeros(h)
            for i in order:
                z = own[i] @ v[f"{way}_in"] + hidden @ v[f"{way}_own"] + v[f"{way}_bias"]
                admit, forget, show = (1 / (1 + np.exp(-z[k * h:(k + 1) * h])) for k in range(3))
                cell = forget * cell + admit * np.tanh(z[3 * h:])
                hidden = show * np.tanh(cell)
                states[way, i] = hidden
        wanted += [1 / (1 + np.exp(-(np.concatenate([states["ahead", i], states["back", i]]) @ v["out"] + v["bias"][0])))
                   for i in range(size)]
        at += size
    assert np.abs(model.scores(x) - np.array(wanted)).max() < 1e-5


def test_gradient_against_differences():
    x, labels = some_inputs()
    model = pages.Labeller(seed=2)
    model.values = {k: v.astype(np.float64) for k, v in model.values.items()}
    weight = np.ones(len(labels))
    _, grads = model.gradient(x, labels, weight)
    rng = np.random.default_rng(0)
    for name, value in model.values.items():
        used = np.argwhere(np.abs(grads[name]) > 1e-4)
        for spot in map(tuple, used[rng.choice(len(used), min(6, len(used)), replace=False)]):
            kept, losses = value[spot], []
            for step in (1e-3, -1e-3):
                value[spot] = kept + step
                losses.append(model.gradient(x, labels, weight)[0])
            value[spot] = kept
            assert abs((losses[0] - losses[1]) / 2e-3 - grads[name][spot]) < 2e-2 * abs(grads[name][spot]) + 1e-5


def test_held_out_layouts(model):
    """Layouts and words that no example had."""
    made = pages.layouts([], 150, seed=77)
    wrong = total = 0
    for html, labels in made:
        kept = set(pages.article_texts(model, [html])[0].split("\n"))
        own = texts(html)
        wrong += sum((t in kept) != (y == 1) for t, y in zip(own, labels) if own.count(t) == 1)
        total += len(own)
    assert wrong < 0.01 * total


def test_registered_query(spark):
    rows = QUERIES["op12_extract_html"](spark, LARGER).collect()
    given = {r["page_id"]: r for r in spark.read.parquet(f"{LARGER}/pages.parquet").collect()}
    assert len(rows) == len(given)
    for r in rows:
        assert r["text"] == article(given[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])
        assert r["url"] == given[r["page_id"]]["url"]


def test_odd_pages(spark, model):
    base = spark.read.parquet(f"{SAMPLE}/pages.parquet").first()["html"]
    long = "<html><body><nav><a href=x>Menu</a></nav><article>" + "".join(
        f"<p>Paragraph number {i} with some words.</p>" for i in range(20000)) + "</article></body></html>"
    rows = [(1, None, 7), (2, "", 7), (None, base, 7), (3, base, 7), (3, base, 7), (4, long, 7), (5, "<nav><a>only</a></nav>", 7),
            (6, "<" * 5000, 7), (7, "<p>" * 2000, 7)]
    df = spark.createDataFrame(rows, "page_id long, html string, n_chars int").repartition(3)
    found = {(r["page_id"], r["html"]): r for r in pages.extract(df, model).collect()}
    assert found[1, None]["text"] == found[2, ""]["text"] == found[5, rows[6][1]]["text"] == ""
    assert found[3, base]["text"] == found[None, base]["text"] == article(base)
    assert found[4, long]["text"] == "\n".join(f"Paragraph number {i} with some words." for i in range(20000))
    assert {r["n_chars"] for r in found.values()} == {7} and pages.extract(df, model).count() == len(rows)
    with pytest.raises(ValueError):
        pages.extract(df, model, out="n_chars")


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, html string")
    model = pages.train(none, made_up=5, epochs=1)
    assert pages.extract(none, model).count() == 0
