"""Main text: tags against a parser, windows against brute force, pages with and without a marked article."""

import random
import re
import time
from html.parser import HTMLParser

import pytest

from larkspur.llm import htmlmain

LONG = "A sentence long enough to count as text of the article. " * 2


class Blocks(HTMLParser):
    """Text blocks of a page without boilerplate."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.raw = [], "", 0

    def handle_starttag(self, tag, attrs):
        if tag not in htmlmain._INLINE:
            self.cut()
        self.raw += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag not in htmlmain._INLINE:
            self.cut()
        self.raw -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.raw:
            self.now += data

    def cut(self):
        words = " ".join(self.now.split())
        if words:
            self.blocks.append(words)
        self.now = ""


ATTRIBUTES = ["", " class=x", " title='a > b'", ' title="it\'s > 5"', " data-x=it's", " a=b=c", ' title=" class=\'ad\' "', " hidden", ' href="?a=1&amp;b=2"', " x = 'y'", ' q=a"b', " a/b", ' class="entry-header"', " class='legal notice'", " id=ad-hoc", " class=share"]


def test_tags_and_attributes_against_a_parser():
    rng = random.Random(5)

    def some(depth):
        kind = rng.randrange(8)
        if kind < 3 or not depth:
            return rng.choice(["plain words ", "it's &amp; &#x41; 1 < 2 ", "é\n\t x", LONG, "a &nbsp; b", "<!-- <p> no -->", "<!---->", "<!doctype x>", "<script>if (a</b/.test('<p>')) x</script>"])
        tag = rng.choice(["p", "div", "span", "b", "section", "h2", "ul", "li", "td", "br", "img", "em"])
        head = f"<{tag}{rng.choice(ATTRIBUTES)}>"
        if tag in ("br", "img"):
            return head
        if tag == "p":
            return head + "".join(some(0) for _ in range(2)) + "</p>"
        return head + "".join(some(depth - 1) for _ in range(rng.randint(0, 3))) + f"</{tag}>"

    for _ in range(400):
        body = "<p>first words</p>" + "".join(some(4) for _ in range(5))
        parser = Blocks()
        parser.feed(body)
        parser.close()
        parser.cut()
        assert htmlmain.main_text(f"<nav>menu</nav><article{rng.choice(ATTRIBUTES)}>{body}</article><p>{LONG}") == "\n".join(parser.blocks), body


def test_windows_against_brute_force():
    rng = random.Random(6)
    for _ in range(3000):
        n = rng.randint(0, 14)
        lengths = [rng.choice([0, 0, 0, 5, 20, 40, 90]) for _ in range(n)]
        window, surge = rng.randint(1, 4), rng.choice([1, 30, 80])
        full = [i for i in range(n) if any(lengths[i : i + window])]
        want, run = [], []
        for i in [*full, None]:
            if run and i != run[-1] + 1:
                if any(sum(lengths[j : j + window]) >= surge for j in run):
                    want.append((run[0], run[-1] + 1))
                run = []
            run.append(i)
        assert htmlmain.surges(lengths, window, surge) == want


def test_pages_without_a_marked_article():
    text = re.sub(r"\s+", " ", LONG).strip()
    links = "".join(f"<li><a href=/{i}>Section number {i} of this site</a></li>" for i in range(9))
    assert htmlmain.main_text(f"<ul>{links}</ul><h1>Head</h1><p>{text}</p><p>ok</p><p>{text}</p><ul>{links}</ul><p>Short end.") == f"Head\n{text}\nok\n{text}"
    story = f'<div id=content><div class="entry-header"><h1><a href=/>Head</a></h1></div><p>{text}</p><div class=comments><p>{text}</p></div></div><div class="side box"><p>{text}</p></div>'
    assert htmlmain.main_text(story) == f"Head\n{text}"
    assert htmlmain.main_text(f"<form id=all><div class=promo-box>{text}</div><p>{text}</form>") == text
    assert htmlmain.main_text(f"<form><article><p>{text}</article><button>go</button></form>") == text


def test_a_marked_article_is_cut_by_its_windows():
    text = re.sub(r"\s+", " ", LONG).strip()
    links = "".join(f"<li><a href=/{i}>Section number {i}</a></li>" for i in range(9))
    assert htmlmain.main_text(f"<article><h1>Head</h1><p>{text}</p><ul>{links}</ul><p>{text}</p><p><a href=x>Source</a></p></article>") == f"Head\n{text}\n{text}\nSource"
    assert htmlmain.main_text(f"<article><p>Tiny.</p></article><p>{text}</p>") == "Tiny."
    assert htmlmain.main_text(f"<article><p>{text}</p><div class=ad>{text}</div><section class=comments>{text}</section><aside>x</aside><footer>y</footer></article>") == text
    assert htmlmain.main_text("<article><p data-x=it's>First... it's here.</p></article>") == "First... it's here."


@pytest.mark.parametrize("piece", ['<a "x', "</div>", "<div>", '<a b="x', "<!--", "</script ", "<p", "< ", "<a b='", "<a>", "<div class=", "<script>", "&amp", "<li><a href=x>y</a>"])
def test_time_is_linear_on_hostile_markup(piece):
    began = time.time()
    htmlmain.main_text(piece * 100_000)
    htmlmain.main_text("<div>" * 50_000 + piece * 50_000)
    assert time.time() - began < 8
