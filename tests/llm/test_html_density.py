import math
import random
import time

import pytest

from plantledger.llm import html_density
from plantledger.llm.html_density import extract_pages, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1><nav><ul><li><a href="/a">Menu &amp; more</a></li></ul></nav></header><!-- note <p>no</p> -->
<div class="ad banner">Buy this now, it is cheap and good for you and all</div><div id="cookie-notice">We use cookies here.</div>
<main><article><header><h1>A  title\n here</h1></header><p><b>First &amp; second &lt;tag&gt; caf&eacute;&nbsp;au lait.<br>Next line
<p class="lead">More of the <a href="/x">story</a> in a long paragraph, told at some length.<ul><li>one<li>two</ul>
<div class="ad">Inside advert</div><form><input><label>Name</label></form><blockquote>Quoted &am</blockquote></article>
<section class="comments"><p>A reader comment that is quite long, longer than any of the paragraphs above it, and says nothing at all.</p></section></main>
<aside>Related</aside><footer>&copy; me</footer></body></html>"""


def test_article_only():
    assert main_text(PAGE).split("\n\n") == [
        "A title here", "First & second <tag> café au lait. Next line", "More of the story in a long paragraph, told at some length.",
        "one", "two", "Quoted &am"]


def test_plain_blocks_without_article():
    page = "<body><div class=menu><a href=1>one</a> <a href=2>two</a></div><div id=content><h2>Head</h2><p>" + "words and " * 40 + "</p><p>more</p></div>" \
        "<div><a href=1>x</a> <a href=2>y</a></div></body>"
    assert main_text(page).startswith("Head\n\nwords and") and main_text(page).endswith("more")


@pytest.mark.parametrize("source", ["", "<", "<p", "<!-- x", "<script>var a", "<nav>only menu</nav>", "<a \"", "</p></div>", "<" * 2000])
def test_broken_markup_does_not_fail(source):
    assert isinstance(main_text(source), str)
    assert "menu" not in main_text(source)


def test_short_and_deep_pages():
    assert main_text("<html><body><nav>n</nav><article><h1>Hi</h1></article><footer>a much longer footer text</footer></body></html>") == "Hi"
    assert main_text("plain text") == "plain text"
    assert main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert len(main_text("<article><p>" + "word " * 400_000 + "</p></article>")) == 5 * 400_000 - 1


def test_rows(spark):
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, None), (2, "v", "", 1)]
    out = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(out) == 4 and sorted(r.n_chars for r in out)[:2] == [0, 0] and all(r.n_chars == len(r.text) for r in out)
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LONG = "<p>" + "long words of the article " * 12 + "</p>"


@pytest.mark.parametrize("inner, short", [
    (f"<h1>The heading</h1><div>{LONG * 8}</div>", ["The heading"]),
    (f"<header><h1>The heading</h1></header><div><div>{LONG * 8}</div></div>", ["The heading"]),
    (f"<h1>The heading</h1><p>A lead.</p><div>{LONG * 8}</div><p>By me</p>", ["The heading", "A lead.", "By me"]),
    (f"<section><h2>First</h2>{LONG * 8}</section><section><h2>Last</h2><p>The end.</p></section>", ["First", "Last", "The end."]),
    (f"<h1>The heading</h1><article><div>{LONG * 8}</div></article><ul><li><a href=/x>A source</a></li></ul>", ["The heading", "A source"])])
@pytest.mark.parametrize("around", ["article", "main"])
def test_short_parts_beside_a_long_one_stay(inner, short, around):
    page = f"<html><body><nav><a href=/>Menu</a></nav><{around}>{inner}<div class=share>Share</div></{around}><div>Unnamed foot</div><footer>f</footer></body></html>"
    if around == "main":  # where a header element is left out
        page = page.replace("<header>", "").replace("</header>", "")
        page = page.replace("<article>", "<div>").replace("</article>", "</div>")
    parts = main_text(page).split("\n\n")
    assert len(parts) == 8 + len(short) and [p for p in parts if len(p) < 20] == short


def test_short_parts_without_article():
    page = f"<body><div><a href=/1>one</a> <a href=/2>two</a></div><div class=wrap><h1>Head</h1><div><div>{LONG * 8}</div></div><p>The end.</p>" \
        "<ul><li><a href=/3>three</a></li></ul></div><div>Unnamed foot</div></body>"
    parts = main_text(page).split("\n\n")
    assert len(parts) == 10 and parts[0] == "Head" and parts[-1] == "The end."


@pytest.mark.parametrize("attributes", ['style="overflow: hidden"', 'aria-hidden="false"', 'title="The hidden life"', 'data-id="share-1"', "data-class=ad", "hidden-part",
                                        'alt="id=ad"', "style='a' data-x = hidden", "hidden=until-found"])
def test_values_and_longer_names_are_no_attributes(attributes):
    assert main_text(f"<body><div {attributes}><p>the text</p></div></body>") == "the text"


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN", 'hidden=""', "hidden='hidden'", 'style="a" hidden', 'title="x"class="a ad b"', "ID = share-1", "role='menu'", 'x="\'" class=ad',
                                        'class="ad'])
def test_attributes_leave_out(attributes):
    assert main_text(f"<body><div {attributes}><p>the text</p></div></body>") == ""


@pytest.mark.parametrize("raw", ["script", "SCRIPT", "style", "textarea"])
def test_raw_elements_end_where_they_do(raw):
    page = f"<body><div><p>{'İ' * 40} önce</p><{raw}>var a = '<p>no</{raw}s>'</{raw.title()} ><p>sonra {'İ' * 9}</p></div></body>"
    assert main_text(page).split("\n\n") == ["İ" * 40 + " önce", "sonra " + "İ" * 9]


BODY = f"<h1>The heading</h1>{LONG * 4}"


@pytest.mark.parametrize("wrapped", [
    f'<div class="layout with-sidebar"><article>{BODY}</article></div>', f'<div class="no-sidebar"><main>{BODY}</main></div>',
    f'<div class="content-sidebar-wrap"><article>{BODY}</article></div>', f'<div id="page" class="has-banner"><article>{BODY}</article></div>',
    f'<div class="elementor-widget elementor-widget-text-editor">{BODY}</div>', f'<form id="aspnetForm"><input><article>{BODY}</article></form>',
    f'<form id="aspnetForm"><div>{BODY}</div></form>', f'<div class="header-footer-group">{BODY}</div>', f'<div role="search"><main>{BODY}</main></div>',
    f'<div class="comments-open"><main>{BODY}</main></div>', f'<div class="ad-free"><article>{BODY}</article></div>'])
def test_wrappers_do_not_take_the_article_along(wrapped):
    page = f"<body><nav><a href=/>Menu</a></nav>{wrapped}<div class=sidebar><p>Beside it all.</p></div><div class='cookie-notice'>We use cookies.</div></body>"
    assert main_text(page).split("\n\n") == main_text(f"<article>{BODY}</article>").split("\n\n")


def test_parts_of_an_article_are_left_out_by_name_only_if_thin():
    page = f"<article>{BODY}<section id='related-work'><h2>Related work</h2>{LONG * 3}</section><div class='share-buttons'>Share this</div><div class='related-posts'>" \
        "<a href=/1>One of many other stories</a> <a href=/2>Another of many</a></div><div class=related>Read on</div><div class='ad-slot'>" + LONG + "</div></article>"
    parts = main_text(page).split("\n\n")
    assert len(parts) == 5 + 4 and "Related work" in parts and not {"Share this", "Read on"} & set(parts) and "Another" not in main_text(page)


def test_comments_stay_out_even_as_articles():
    page = f"<body><article>{BODY}</article><section class=comments>" + f"<article class=comment-body>{LONG * 9}</article>" * 3 + "</section></body>"
    assert main_text(page) == main_text(f"<article>{BODY}</article>")


def test_density_decides_between_articles(monkeypatch):
    teasers = "".join(f"<article><h2><a href=/{i}>A teaser</a></h2><p>Short.</p></article>" for i in range(6))
    page = f"<body>{teasers}<article>{BODY}</article>{teasers}</body>"
    assert main_text(page).split("\n\n")[0] == "The heading" and "teaser" not in main_text(page)
    monkeypatch.setattr(html_density, "_densities", lambda page: ([1.0] * len(page.parent), [1.0] * len(page.parent), [False] * len(page.parent)))
    assert "teaser" in main_text(page)


@pytest.mark.parametrize("page", [
    "<article>" + "<p>a few words here</p>" * 40_000 + "</article>", "<div>" * 40_000 + "x" + "</span>" * 40_000, "<div>" * 20_000 + "<li>a" * 20_000 + "</div>" * 20_000,
    "<article>" * 20_000 + "<p class=ad>x" * 20_000, "<div class=sidebar>" * 40_000 + "text"])
def test_time_in_proportion_to_the_elements(page):
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 4


class Node:
    """A random page as a tree, and the method on it by plain recursion."""

    def __init__(self, rng, depth=0):
        self.text = " ".join("word" + "s" * rng.randrange(9) for _ in range(rng.choice([0, 0, 2, 5, 30, 80])))
        self.link = " ".join("link" for _ in range(rng.choice([0, 0, 0, 1, 6])))
        self.children = [Node(rng, depth + 1) for _ in range(rng.randrange(4 if depth < 4 else 1))]

    def html(self):
        link = f"<a href=x>{self.link}</a>" if self.link else ""
        return f"<div>{self.text} {link}{''.join(c.html() for c in self.children)}</div>"

    def own(self):
        return (len((self.text + self.link).replace(" ", "")), int(bool(self.link)) + len(self.children), len(self.link.replace(" ", "")), int(bool(self.link)))

    def counts(self):
        return tuple(map(sum, zip(self.own(), *(c.counts() for c in self.children))))

    def nodes(self):
        return [self, *(n for c in self.children for n in c.nodes())]


def plain_blocks(root):
    body = [sum(x) for x in zip(root.counts(), (0, 1, 0, 0))]  # the body around the root
    share = body[2] / body[0] if body[0] else 0.0

    def density(c, t, lc, lt):
        if not c:
            return 0.0
        t = max(t, 1)
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0) + 1.0) / max(math.log(base), 1.0)

    def total(node):
        return density(*node.own()) + sum(density(*c.counts()) for c in node.children)

    def best(node):
        return max(node.nodes(), key=total)

    order = root.nodes()
    core = best(root) if total(best(root)) > density(*body) else None
    path = {id(n) for n in order if core in n.nodes()} if core else set()
    threshold = min([density(*body)] + [density(*n.counts()) for n in order if id(n) in path])
    chosen = {id(m) for n in order if density(*n.counts()) >= threshold and density(*n.counts()) > 0 for m in best(n).nodes()}
    return [n for n in order if id(n) in chosen and (n.text or n.link)]


def test_blocks_of_the_plain_method_stay():
    """The core and all that is dense enough, by plain recursion; what stands beside it may come along."""
    rng, more = random.Random(5), 0
    for _ in range(300):
        root = Node(rng)
        got = main_text(f"<html><body>{root.html()}</body></html>").split("\n\n")
        want = [" ".join(f"{n.text} {n.link}".split()) for n in plain_blocks(root)]
        at = iter(got)
        assert all(any(w == g for g in at) for w in want), (want, got)
        more += len(got) > len(want)
    assert more < 300
