import itertools
import random
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from quarrylight.llm import html


def text(page):
    return html.main_text(page, html.default_field())


def test_pages_it_has_not_seen():
    pages = html.labelled_pages(150, seed=321)
    assert np.mean([text(page) == "\n".join(main) for page, main in pages]) >= 0.97


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("   \n ", ""),
        ("<article><p>One&nbsp;&amp;\n two<br>three <b>four</b></p><p>Five", "One & two three four\nFive"),
        ("<nav><ul><li><a href='/a'>Home</a></li></ul></nav><div class=ad>Buy it now.</div><article><h1>Title</h1><p><b>Lead.<br><p>Body text here.</p></article><footer>&copy; me</footer>", "Title\nLead.\nBody text here."),
        ("<article><p>a &lt; b < c</p><script>var x='<p>no</p>'</script><!-- <p>no --><p>cut off &am", "a < b < c\ncut off &am"),
        ("<article><p>x</p><p title=\"a>b\">y</p><p", "x\ny"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
    ],
)
def test_markup(page, want):
    assert text(page) == want


def test_very_long_page():
    page = "<article>" + "<p>some words in a paragraph, again.</p>" * 20_000
    assert text(page).count("\n") == 19_999


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(2)
    for n in range(1, 7):
        chain = html.ChainField({str(k): k for k in range(n)}, rng.normal(size=(n, 2)), rng.normal(size=(2, 2)))
        names = [[str(k)] for k in range(n)]
        unary = chain.unary(names)

        def value(path):
            return sum(unary[k, y] for k, y in enumerate(path)) + sum(chain.moves[a, b] for a, b in itertools.pairwise(path))

        assert value(chain.decode(names)) == pytest.approx(max(value(p) for p in itertools.product((0, 1), repeat=n)))


def test_extract(spark):
    rows = [(1, "u", "<article><p>Hällo 😀</p></article>", 5), (2, None, None, 6), (1, "u", "<article><p>Hällo 😀</p></article>", 5), (None, "v", "", None)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert [tuple(r) for r in got] == [(1, "u", "Hällo 😀", 7), (2, None, "", 0), (1, "u", "Hällo 😀", 7), (None, "v", "", 0)]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_deep_nesting_and_stray_closings():
    deep = "<div>" * 60_000 + "<article><p>text</p></article>" + "</section>" * 60_000
    assert [b.text for b in html.blocks(deep)] == ["text"]
    items = html.blocks("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><p>e<div>f</div>g")
    assert [(b.text, b.near) for b in items] == [("a", "li"), ("b", "li"), ("c", "li"), ("d", "li"), ("e", "p"), ("f", "div"), ("g", "none")]


@pytest.mark.parametrize("piece", ["<p x '> ' y\"", "<p x \"", "<a b='c\" d>e", "< <p", "<!-- <p '>"])
def test_unclosed_quotes_cost_linear_time(piece):
    began = time.process_time()
    html.blocks(piece * (10_000_000 // len(piece)))
    assert time.process_time() - began < 60


def test_quotes_that_stay_open_end_at_the_next_mark():
    assert [b.text for b in html.blocks("<p a='>'>x</p><p b=\"it's\">y</p><p c='>z</p>")] == ["x", "y", "z"]


class Tree(HTMLParser):
    """Leaf blocks of a well-formed page by the standard library's parser, elements held as a list of open ones."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.text, self.linked, self.link = [], [], "", 0, False
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        if self.text.split():
            names = [n for n, _ in self.open]
            self.out.append((" ".join(self.text.split()), names[-1] if names else "none", frozenset(names[:-1]), frozenset(h for _, hints in self.open for h in hints), self.linked))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag in html.BLOCKS:
            self.flush()
            words = {w.lower() for k, v in attrs if k in ("class", "id", "role") for w in re.findall("[A-Za-z]+", v)}
            self.open.append((tag, [kind for kind, known in html.HINTS.items() if words & set(known.split())]))
        self.link = tag == "a" or self.link and tag not in html.BLOCKS

    def handle_endtag(self, tag):
        if tag in html.BLOCKS:
            self.flush()
            self.open.pop()
        self.link = self.link and tag != "a" and tag not in html.BLOCKS

    def handle_data(self, data):
        self.text += data
        self.linked += len(data) if self.link else 0


def random_page(rng, depth=0):
    word = lambda: rng.choice(["alpha", "Beta.", "gamma", "©", "12", "x&amp;y", "end!"])
    inside = ""
    for _ in range(rng.randrange(1, 4)):
        kind = rng.random()
        if depth < 4 and kind < 0.45:
            tag = rng.choice(["div", "section", "article", "nav", "footer", "main", "aside"])
            mark = rng.choice(["", " class='content main'", ' id="ad-1"', ' class="sidebar" data-x="a > b"', " role=comment"])
            inside += f"<{tag}{mark}>{random_page(rng, depth + 1)}</{tag}>"
        elif kind < 0.8:
            inside += "<p>" + " ".join(word() for _ in range(rng.randrange(1, 9))) + "</p>"
        else:
            inside += "<div><a href='/u'>" + word() + "</a> " + word() + "</div>"
    return inside


def test_extraction_equals_brute_force_on_random_pages():
    """Blocks by another parser; of all labellings the best one, counted through."""
    rng, chain = random.Random(8), html.default_field()
    compared = 0
    for _ in range(400):
        page = random_page(rng)
        want = [html.Block(text.replace("&amp;", "&"), near, around, hints, linked) for text, near, around, hints, linked in Tree(page).out]
        got = html.blocks(page)
        assert [(b.text, b.near, b.around, b.hints) for b in got] == [(b.text, b.near, b.around, b.hints) for b in want]
        if 0 < len(want) <= 10:
            unary = chain.unary(html.features(got))
            value = lambda path: sum(unary[k, y] for k, y in enumerate(path)) + sum(chain.moves[a, b] for a, b in itertools.pairwise(path))
            best = max(itertools.product((0, 1), repeat=len(want)), key=value)
            assert html.main_text(page, chain) == "\n".join(b.text for b, y in zip(want, best) if y)
            compared += 1
    assert compared > 200
