"""Whole pages: broken markup, a slow reference of the densities, pages whose article is known."""

import math
import random
import time

import pytest

from postmill.llm import html_text
from postmill.llm.html_text import Node, main_text

LONG = " ".join(["Some plain words of the article, with no link in them, and more of them."] * 4)


@pytest.mark.parametrize(
    "page,want",
    [
        ("<html><head><title>x</title><body><p>{0}</p></body></html>", "{0}"),
        ("<head><meta charset=utf-8><link rel=x href=y><p>{0}</p>", "{0}"),
        ("<head><title>t</title>{0}", "{0}"),
        ("<head><script>var a = '<p>no</p>'</script><style>p {{}}</style></head><p>{0}</p>", "{0}"),
        ("<html><head></head><body><p data-a=it's>First one, I don't know. {0}</p><p>It's two. {0}</p></body>", "First one, I don't know. {0}\nIt's two. {0}"),
        ("<p title='a > b' data-x=\"c > d\">{0}</p>", "{0}"),
        ("<p title = \"it's\">{0}</p><p>it's</p>", "{0}\nit's"),
        ("<p data-hidden data-id=comments title='is hidden'>{0}</p>", "{0}"),
        ("<p>{0} <a href=/x/>link</a> end</p>", "{0} link end"),
        ("<p>{0}<br/>more</p>", "{0}\nmore"),
        ("<p>{0}</p></div></b></p><p>{0}</p>", "{0}\n{0}"),
        ("<body><nav><ul><li><a href=x>menu</a></body><p>{0}</p>", "{0}"),
    ],
)
def test_markup(page, want):
    assert main_text(page.format(LONG)) == want.format(LONG)


@pytest.mark.parametrize("page", ["<p title=\"{}", "<p a='b", "<p " + "a=\"b\" " * 5_000, "<" * 5_000, "<p a=" * 5_000, "<p a='" * 5_000 + ">", "</b>" * 5_000])
def test_broken_markup_ends(page):
    started = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - started < 2


@pytest.mark.parametrize(
    "page",
    [
        lambda n: "<b>" * n + "<p>text</p>" * n,
        lambda n: "<div>" * n + "<p>text</p></section>" * n,
        lambda n: "<b>" * n + "<header>x</header>" * n,
        lambda n: "<ul>" + "<li><i>text" * n,
    ],
)
def test_time_is_linear_in_depth(page):
    def seconds(n):
        started = time.perf_counter()
        main_text(page(n))
        return time.perf_counter() - started

    seconds(500)
    small, large = min(seconds(2_000) for _ in range(3)), min(seconds(16_000) for _ in range(2))
    assert large < 30 * max(small, 0.01)


def reference(node, body):
    """Density of a node straight from its definition, every count taken anew from the subtree."""

    def nodes(top):
        return [top, *(n for c in top.children if isinstance(c, Node) for n in nodes(c))]

    def chars(top):
        return sum(len("".join(c.split())) for n in nodes(top) for c in n.children if isinstance(c, str))

    def linked(top):
        """Characters and tags in links: a link's own text, or all below it."""
        if top.name == "a":
            return chars(top), len(nodes(top))
        below = [linked(c) for c in top.children if isinstance(c, Node)]
        return sum(b[0] for b in below), sum(b[1] for b in below)

    count, tags = chars(node), max(len(nodes(node)) - 1, 1)
    if not count:
        return 0.0
    link_chars, link_tags = linked(node)
    ratio = linked(body)[0] / max(chars(body), 1)
    base = math.log(count / max(count - link_chars, 1) * link_chars + ratio * count + math.e)
    return count / tags * math.log(max(count / max(link_chars, 1) * tags / max(link_tags, 1), 1.0)) / base


def random_page(rng, depth=0):
    if depth > 4 or rng.random() < 0.25:
        return " ".join(["word"] * rng.randrange(0, 12))
    name = rng.choice(["div", "p", "a", "b", "span", "li", "section", "h2", "td"])
    return f"<{name}>" + "".join(random_page(rng, depth + 1) for _ in range(rng.randrange(4))) + (f"</{name}>" if rng.random() < 0.9 else "")


@pytest.mark.parametrize("seed", range(40))
def test_densities_equal_their_definition(seed):
    rng = random.Random(seed)
    root = html_text.parse("<body>" + "".join(random_page(rng) for _ in range(6)))
    order = html_text._nodes(root)
    body = next(n for n in order if n.name == "body")
    html_text._measure(order)
    html_text._densities(html_text._nodes(body), body)
    for node in html_text._nodes(body):
        assert math.isclose(node.density, reference(node, body), rel_tol=1e-9, abs_tol=1e-12)


def known_page(rng):
    """A page and the blocks of its article."""
    words = [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('dklmnrst')}{rng.choice(['', 'e', 'ing', 'er'])}" for _ in range(200)]

    def sentence(n):
        return " ".join(rng.choice(words) for _ in range(n)) + "."

    blocks, article = [], []
    for _ in range(rng.randrange(4, 12)):
        kind = rng.random()
        if kind < 0.15:
            blocks.append(sentence(4))
            article.append(f"<h2>{blocks[-1]}</h2>")
        elif kind < 0.3:
            a, b, c = sentence(25), sentence(2), sentence(15)
            blocks.append(f"{a} {b} {c}")
            tag, more = rng.choice([("b", ""), ("i", " class=y"), ("a", " href=/y")])
            article.append(f"<p class=x>{a} <{tag}{more}>{b}</{tag}> {c}</p>")
        else:
            blocks.append(sentence(rng.randrange(20, 60)))
            article.append(f"<p>{blocks[-1]}" + rng.choice(["</p>", ""]))
    menu = "".join(f"<li><a href=/{i}>{sentence(2)}</a>" for i in range(rng.randrange(3, 9)))
    tag = rng.choice(["article", "main", "div class=content", "div id=story"])
    head = rng.choice(["<head><title>t</title></head>", "<head><title>t</title>", ""])
    page = f"<html>{head}<body><header><h1>Site</h1><nav><ul>{menu}</ul></nav></header><{tag}>{''.join(article)}</{tag.split()[0]}>"
    page += f"<aside><p>{sentence(10)}</p></aside><div class='site-footer'><ul>{menu}</ul>{sentence(6)}</div><footer>{sentence(8)}</footer></body></html>"
    return page, blocks


@pytest.mark.parametrize("seed", range(60))
def test_pages_with_a_known_article(seed):
    page, blocks = known_page(random.Random(seed))
    assert main_text(page).split("\n") == blocks
