"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into its leaf blocks in page order. Each block gets features of its ancestor
tags, their class and id words, its text and its place; the field labels each block as main
text or not, with transition weights between neighbours, and Viterbi decoding picks the best
labelling of the whole page. The field is trained in numpy on labelled pages, generated from a
seed: articles in several layouts amid menus, headers, footers, sidebars, notices, adverts,
forms and comments.

Character references are decoded, white space within a block becomes one space, blocks are
trimmed and joined by one newline. Null and empty pages give an empty text; unclosed and cut-off
markup is read as far as it goes; pages of any length are read whole.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that part blocks, hold no text, end an open paragraph or end a sibling of their kind.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("script style noscript template textarea title svg math iframe object canvas audio video head button select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Class and id words by what they say of an element.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pager pagination tabs",
    "head": "header masthead topbar top branding logo",
    "foot": "footer foot bottom colophon copyright legal",
    "side": "sidebar side aside widget rail related recommended popular trending tags",
    "advert": "ad ads advert advertisement adsense banner promo promotion sponsor sponsored",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe signup paywall",
    "comment": "comment comments reply replies respond disqus discussion thread",
    "social": "share sharing social follow like tweet",
    "form": "form login search contact",
    "main": "content article main post entry story body text prose page",
}
_hint = {word: kind for kind, words in HINTS.items() for word in words.split()}
_tag = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_mark = re.compile("[>\"']")
_named = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_parts = re.compile(r"[A-Za-z]+")
SEED, N_PAGES = 5, 400


@dataclass
class Block:
    """A leaf block: its text, its element, the elements around that, all their hints, and how much of it is links."""

    text: str
    near: str
    around: frozenset[str]
    hints: frozenset[str]
    linked: int


@dataclass
class _Open:
    """An open block element with what it and those around it say, so that deep nesting costs nothing more."""

    name: str
    around: frozenset[str] = frozenset()
    hints: frozenset[str] = frozenset()


class TagEnds:
    """Where the tags of a page end: the first > that no quoted attribute value holds.

    All marks are looked at once, from the last to the first, so that unclosed quotes cost nothing more.
    """

    def __init__(self, page: str):
        self.places = [m.start() for m in _mark.finditer(page)]
        self.ends = [-1] * (len(self.places) + 1)
        after: dict[str, int] = {}
        for k in range(len(self.places) - 1, -1, -1):
            mark = page[self.places[k]]
            if mark == ">":
                self.ends[k] = self.places[k]
            else:
                closing = after.get(mark)
                self.ends[k] = -1 if closing is None else self.ends[closing + 1]
                after[mark] = k

    def __call__(self, at: int) -> int:
        """The end of a tag whose attributes begin at ``at``; -1 if its quotes or the page leave it open."""
        return self.ends[bisect_left(self.places, at)]


def blocks(page: str | None) -> list[Block]:
    """The non-empty leaf blocks of a page, in order."""
    page = page or ""
    out: list[Block] = []
    stack = [_Open("none")]
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked, in_link, at, size = 0, False, 0, len(page)
    tag_end = TagEnds(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack[-1].name, stack[-1].around, stack[-1].hints, linked))
            parts.clear()
        linked = 0

    def close(name: str, only: tuple[str, ...] | None = None) -> None:
        if not opened.get(name) or (only is not None and stack[-1].name not in only):
            return
        while True:
            last = stack.pop()
            opened[last.name] -= 1
            if last.name == name:
                return

    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        if start > at:
            piece = page[at:start]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        if start == size:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = end + 1 if end >= 0 else size
            continue
        m = _tag.match(page, start)
        end = tag_end(m.end()) if m else -1
        if m and end < 0:
            end = page.find(">", m.end())
        if end < 0:
            if start + 1 < size and (page[start + 1].isalpha() or page[start + 1] == "/"):
                end = page.find(">", start)
                at = end + 1 if end >= 0 else size
            else:
                parts.append("<")
                at = start + 1
            continue
        at, closing, name, attributes = end + 1, m[1], m[2].lower(), page[m.end() : end]
        if name in SKIPPED and not closing:
            if name == "head":
                flush()
                continue
            if not attributes.endswith("/"):
                closed = re.compile(f"</{name}\\b[^>]*>?", re.IGNORECASE).search(page, at)
                at = closed.end() if closed else size
            parts.append(" ")
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            in_link = not closing
        elif name in BLOCKS:
            flush()
            in_link = False
            if closing:
                close(name)
            elif name not in VOID:
                close("p", ("p",))
                for sibling in SIBLINGS.get(name, ()):
                    close(sibling, SIBLINGS[name])
                words = {w.lower() for value in _named.findall(attributes) for w in _parts.findall("".join(value))}
                outer = stack[-1]
                around = outer.around if outer.name in outer.around or outer.name == "none" else outer.around | {outer.name}
                own = frozenset(_hint[w] for w in words if w in _hint)
                stack.append(_Open(name, around, outer.hints | own if own - outer.hints else outer.hints))
                opened[name] = opened.get(name, 0) + 1
    flush()
    return out


def features(found: list[Block]) -> list[list[str]]:
    """Names of the features of each block of a page."""
    out = []
    for k, b in enumerate(found):
        words, last = b.text.count(" ") + 1, b.text[-1]
        names = ["bias", f"tag={b.near}", f"words={min(6, words.bit_length())}", f"links={min(4, 5 * b.linked // max(1, len(b.text)))}", f"end={'stop' if last in '.!?…\"»' else 'other'}", f"place={min(4, 5 * k // len(found))}"]
        names += [f"in={t}" for t in b.around] + [f"hint={h}" for h in b.hints]
        if not {"article", "main"} & (b.around | {b.near}):
            names.append("outside")
        if "©" in b.text or "copyright" in b.text.lower():
            names.append("copyright")
        out.append(names)
    return out


@dataclass
class ChainField:
    """A two-label linear-chain field: weights by feature and label, and by pair of labels."""

    index: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def unary(self, names: list[list[str]]) -> np.ndarray:
        """Scores of each block's labels."""
        return np.array([self.weights[[self.index[n] for n in row if n in self.index]].sum(0) for row in names]).reshape(-1, 2)

    def decode(self, names: list[list[str]]) -> list[int]:
        """The best labelling, by Viterbi."""
        if not names:
            return []
        unary = self.unary(names).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        s0, s1 = unary[0]
        back = []
        for u0, u1 in unary[1:]:
            a, b = s0 + m00 >= s1 + m10, s0 + m01 >= s1 + m11
            back.append((0 if a else 1, 0 if b else 1))
            s0, s1 = (s0 + m00 if a else s1 + m10) + u0, (s0 + m01 if b else s1 + m11) + u1
        label = 0 if s0 >= s1 else 1
        path = [label]
        for pair in reversed(back):
            label = pair[label]
            path.append(label)
        return path[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], *, epochs: int = 8, rate: float = 0.3, decay: float = 1e-4, seed: int = SEED) -> ChainField:
    """Fit by AdaGrad on the pages' conditional log likelihood, with forward and backward passes."""
    index = {n: k for k, n in enumerate(sorted({n for names, _ in pages for row in names for n in row}))}
    chain = ChainField(index, np.zeros((len(index), 2)))
    gw, gm = np.full(chain.weights.shape, 1e-2), np.full((2, 2), 1e-2)
    rng = np.random.default_rng(seed)
    designs = [([np.array([index[n] for n in row]) for row in names], np.array(labels)) for names, labels in pages if labels]
    for _ in range(epochs):
        for k in rng.permutation(len(designs)):
            rows, y = designs[k]
            n = len(y)
            unary = np.array([chain.weights[r].sum(0) for r in rows])
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = unary[0]
            for t in range(1, n):
                ahead[t] = unary[t] + np.logaddexp(ahead[t - 1, 0] + chain.moves[0], ahead[t - 1, 1] + chain.moves[1])
            for t in range(n - 2, -1, -1):
                behind[t] = np.logaddexp(chain.moves[:, 0] + unary[t + 1, 0] + behind[t + 1, 0], chain.moves[:, 1] + unary[t + 1, 1] + behind[t + 1, 1])
            total = np.logaddexp(*ahead[-1])
            d = np.exp(ahead + behind - total)
            d[np.arange(n), y] -= 1
            moved = decay * chain.moves
            for t in range(1, n):
                moved = moved + np.exp(ahead[t - 1][:, None] + chain.moves + (unary[t] + behind[t])[None, :] - total)
                moved[y[t - 1], y[t]] -= 1
            step = decay * chain.weights
            for r, g in zip(rows, d):
                step[r] += g
            gw += step * step
            gm += moved * moved
            chain.weights -= rate * step / np.sqrt(gw)
            chain.moves -= rate * moved / np.sqrt(gm)
    return chain


def labelled_pages(n: int = N_PAGES, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """Pages and the texts of their main blocks, in order."""
    rnd = random.Random(seed)
    syllables = "the ing er on an re th en ver schaft tion cion mente eau oux keit ung für ño al st in ou ha nd".split()

    def words(low: int, high: int) -> str:
        return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(low, high)))

    def sentence(low: int = 2, high: int = 30) -> str:
        return words(low, high).capitalize() + rnd.choice([".", ".", ".", "", ",", "!", "$$$", " &amp; Co."])

    def link(low: int = 1, high: int = 3) -> str:
        return f'<a href="/{rnd.randint(1, 99)}">{words(low, high)}</a>'

    def part(kind: str) -> str:
        some = rnd.randint(2, 8)
        return {
            "nav": lambda: f"<nav><ul>{''.join(f'<li>{link()}</li>' for _ in range(some))}</ul></nav>",
            "menu": lambda: f'<div class="{rnd.choice(["menu", "navbar top", "breadcrumb"])}">{" ".join(link() for _ in range(some))}</div>',
            "header": lambda: f"<header>{rnd.choice(['<h2>', '<p>', '<div>'])}{words(1, 6)}</header>",
            "footer": lambda: f'<{(t := rnd.choice(["footer", "div class=footer"]))}>{rnd.choice(["&copy; ", "Copyright ", ""])}{sentence(2, 14)}</{t.split()[0]}>',
            "side": lambda: f'<aside class="sidebar"><h3>{words(1, 3)}</h3>{"".join(f"<p>{sentence()}</p>" for _ in range(rnd.randint(1, 3)))}<ul>{"".join(f"<li>{link()}</li>" for _ in range(some))}</ul></aside>',
            "ad": lambda: f'<div class="{rnd.choice(["ad", "ads", "advert", "sponsored promo", "banner"])}">{rnd.choice(["", "<p>"])}{sentence()}</div>',
            "notice": lambda: f'<div id="{rnd.choice(["cookie-notice", "consent", "newsletter"])}"><p>{sentence()}</p>{link()}</div>',
            "form": lambda: f'<form class="search">{words(1, 5)}<label>{words(1, 3)}</label><button>{words(1, 1)}</button></form>',
            "comments": lambda: f'<{(t := rnd.choice(["div", "section", "ol"]))} class="comments"><h3>{words(1, 2)}</h3>{"".join(f"<div class=comment><p>{sentence()}</p></div>" for _ in range(some))}</{t}>',
            "share": lambda: f'<div class="social share">{" ".join(link(1, 1) for _ in range(4))}</div>',
        }[kind]()

    out = []
    for _ in range(n):
        main: list[str] = []

        def keep(text: str) -> str:
            main.append(" ".join(html.unescape(text).split()))
            return text

        before = [part(k) for k in ("header", "nav", "menu", "notice", "ad", "form", "side") if rnd.random() < 0.5]
        inner: list[str] = []
        if rnd.random() < 0.85:
            inner.append(f"<h1>{keep(sentence(2, 12))}</h1>")
        for _ in range(rnd.randint(1, 12)):
            kind = rnd.randrange(9)
            if kind == 0:
                inner.append(f"<p><b>{keep(sentence(1, 12))}<br>")
            elif kind == 1:
                inner.append(f"<h2>{keep(sentence(1, 6))}</h2>")
            elif kind == 2:
                inner.append("<ul>" + "".join(f"<li>{keep(sentence(1, 10))}</li>" for _ in range(rnd.randint(1, 4))) + "</ul>")
            elif kind == 3:
                inner.append(f"<blockquote>{keep(sentence())}</blockquote>")
            elif kind == 4 and rnd.random() < 0.4:
                inner.append(part(rnd.choice(["ad", "share", "side", "form"])))
            else:
                inner.append(f"<p>{keep(' '.join(sentence() for _ in range(rnd.choice([1, 1, 2, 6]))))}</p>")
        if rnd.random() < 0.2:
            inner.append(part(rnd.choice(["share", "comments", "ad"])))
        opened, closed = rnd.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post-body">', "</div>"), ("<main><article>", "</article></main>"), ("<section class=story>", "</section>"), ("", "")])
        after = [part(k) for k in ("share", "comments", "side", "ad", "form", "footer", "footer") if rnd.random() < 0.45]
        page = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><script>var a='<p>';</script></head><body>{''.join(before)}{opened}{''.join(inner)}{closed}{''.join(after)}"
        out.append((page + rnd.choice(["</body></html>", ""]), [m for m in main if m]))
    return out


def labels_for(found: list[Block], main: list[str]) -> list[int]:
    """1 for the blocks that are, in order, the main texts; 0 for the rest."""
    out, at = [], 0
    for b in found:
        hit = at < len(main) and b.text == main[at]
        at += hit
        out.append(int(hit))
    return out


@cache
def default_field() -> ChainField:
    """The field over the default labelled pages; the same on every run."""
    return train([(features(found := blocks(page)), labels_for(found, main)) for page, main in labelled_pages()])


def main_text(page: str | None, chain: ChainField) -> str:
    """A page's main text, blocks joined by newlines."""
    found = blocks(page)
    return "\n".join(b.text for b, label in zip(found, chain.decode(features(found))) if label)


def extract(pages: DataFrame, chain: ChainField | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of ``pages``; other columns are not read.

    Null and empty pages, and pages without a main block, have the empty text. A null page_id or url stays null, repeated rows
    are extracted alike, an empty table gives no rows. Pages of any length are read whole, in time
    proportional to their length, whatever is left unclosed in them.
    """
    chain = chain or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), chain) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
