import html
import itertools
import re

import numpy as np

from eventmill.llm import main_text as M


def test_messages_are_exact():
    rng = np.random.default_rng(1)
    parent = np.array([-1, 0, 0, 1, 1, 2, 5])
    depth = np.array([0, 1, 1, 2, 2, 2, 3])
    kind = rng.integers(0, M.EDGE_KINDS, 7)
    unary, edges = rng.normal(size=(7, 2)), rng.normal(size=(M.EDGE_KINDS, 2, 2))
    node, pair = M.marginals(unary, edges, parent, depth, kind)
    weight, whole = np.zeros((7, 2)), 0.0
    joint = np.zeros((7, 2, 2))
    for y in itertools.product((0, 1), repeat=7):
        w = np.exp(sum(unary[i, y[i]] for i in range(7)) + sum(edges[kind[i], y[parent[i]], y[i]] for i in range(1, 7)))
        whole += w
        for i in range(7):
            weight[i, y[i]] += w
            if i:
                joint[i, y[parent[i]], y[i]] += w
    assert np.allclose(node, weight / whole) and np.allclose(pair, joint / whole)


def plain(page):
    """Main text of the table's pages, which name their article."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inside)
    blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


def test_pages_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: (r.url, plain(r.html)) for r in pages.collect()}
    got = M.main_text(pages).collect()
    assert len(got) == pages.count()
    for r in got:
        assert (r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text)


def test_layouts_it_has_not_seen():
    model = M.train([])
    pages = [M.Page(x) for x in M.layouts(3, seed=77)]
    truth = np.concatenate([M._given_labels(p) for p in pages])
    text = np.array([n.chars > 0 for p in pages for n in p.nodes])
    told = model.content(pages) > 0.5
    assert (told == truth)[text].mean() > 0.97


def test_odd_pages(spark):
    rows = [
        (1, "u", None, "x"),
        (2, None, "", "x"),
        (None, "u", "<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Title &amp; more</h1><p>One  two,\nthree &lt;b&gt;<br>four words. And more.<p>Second part, with text.</article><footer>&copy; x</footer>", "x"),
        (3, "u", "<div>" * 3000 + "<p>deep text, in a long row of words.</p>", "x"),
        (4, "u", "<![odd[ x ]]><script>var a = '<p>no</p>';</script><style>p{}</style><!-- <p>none</p> -->", "x"),
        (5, "u", "</p></article>>< & &#x41; &nosuch; <", "x"),
        (5, "u", "</p></article>>< & &#x41; &nosuch; <", "x"),
        (6, "u", "<main><p>" + "long words, again. " * 60_000 + "</p></main>", "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = M.main_text(pages, model=M.train([])).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert by[None] == "Title & more\nOne two, three <b> four words. And more.\nSecond part, with text."
    assert by[1] == by[2] == by[4] == ""
    assert len(by[6]) == len("long words, again. ") * 60_000 - 1
    assert M.main_text(pages.limit(0)).count() == 0


def test_unseen_elements_end_by_the_rules_of_html():
    article = "<article><p>The text of the article.</p></article>"
    seen = lambda page: [t for _, t in M.Page(page).blocks]
    for before in (
        "<form><datalist id=d><option value=a>A<option value=b>B</datalist></form>",
        "<datalist><option value=a><option value=b></datalist>",
        "<datalist><option value=a /><option value=b /></datalist>",
        "<select><option>A<optgroup label=x><option>B</select>",
        "<select><option>A<option>B<select>",
        "<div><select><option>A<option>B</div>",
        "<div><button type=submit /></div>",
        "<div><button>Search<button>Find</div>",
        "<div><object data=x></div>",
        "<div><svg><g><path d=x></div>",
        "<svg><path d=x><p></p>",
        "<div><template><div>x</div></template><noscript><p>y</noscript></div>",
        "<button>Search",
        "<object data=x>",
    ):
        for start in ("<html><head><title>T</title></head><body>", "<head><title>T</title><meta charset=x>", ""):
            got = seen(start + before + article)
            assert "The text of the article." in got and not {"A", "B", "Find", "T", "x", "y"} & set(got), (start, before, got)
    assert seen("<head><title>T</title>Loose text") == ["Loose text"]
    assert seen("<p>a</p><textarea><div>b</div>") == ["a"]
    assert seen("<p>a</p><select><option>b") == ["a"]
    assert seen("<head><title>T</title><noscript><img src=x>n</noscript><script>s</script></head><p>a") == ["a"]
