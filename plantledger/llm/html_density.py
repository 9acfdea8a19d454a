"""Main text of web pages by composite text density.

Every block element of a page gets a density: its characters per tag, weighted down by the share of them inside
links. The densities of its children are summed, the element with the largest sum is the core of the article, and the
lowest density on the way from it up to the body is the threshold: every element at least that dense gives the subtree
with the largest sum below it. Short parts beside the core (a heading, a lead, a last section) are kept with it: all of
the article or main element around it or, without one, the nearest ancestor with other text, its blocks of mostly links
excepted. Elements that never hold article text (menus, scripts, footers ...) are told by name and
leave before anything is counted. A form, a role or a word of a class or id only makes an element suspect: it stays if it holds an
article or main element, if it holds most of the text of a page without any, or if, inside an article, it is as dense as text there is.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantledger.llm.common import text_or_empty

# Names of elements, roles and classes.
BLOCK = frozenset("""html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption
blockquote pre figure figcaption address details summary fieldset legend hr center
nav header footer aside form dialog menu head""".split())
LEFT_OUT = frozenset("""nav footer aside dialog menu head button select option datalist input label textarea iframe object
noscript template svg canvas script style title""".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
LEFT_OUT_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation
menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe
subscription signup login share sharing social related recommended recommendations comment comments commentlist reply replies disqus
responses pagination pager widget toolbar""".split())
#: Of these, the words that no article has in its own parts, whatever its density.
NEVER_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription
signup login comment comments commentlist reply replies disqus responses""".split())
#: And the words that name a part of a layout, which may be the part around the article.
LAYOUT_WORDS = frozenset("banner sidebar header footer masthead popup modal overlay widget toolbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies disqus responses".split())
#: A name that begins with one of these tells that something is there or not, and is not its name.
STATES = frozenset("with without no not has have is".split())
ARTICLES = frozenset(["article", "main"])
#: Of the density of the article, what an element inside must reach that only its name makes suspect.
ALIKE = 0.5
#: An element that starts closes an open one of these names, up to the element that holds them.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
#: One attribute after another, each with its value, so that no value is read as a name. An open quote ends with the tag.
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>]+))?""")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in RAW}
WORD = re.compile(r"[a-z0-9]+")
ROWS_AT_ONCE = 128


#: How an element is suspected: not at all; left out if it proves thin; unless it holds the article or most of a page's text; unless it
#: holds the article; always left out.
CLEAR, THIN, LAYOUT, SUSPECT, OUT = range(5)


def _suspected(name: str, attributes: str, in_article: bool) -> tuple[int, bool]:
    """What speaks against an element, and whether it is a place of reader comments."""
    if name in LEFT_OUT or name == "header" and not in_article:
        return OUT, False
    found, comments = LAYOUT if name == "form" else CLEAR, False
    if not attributes or name in ("html", "body") or name in ARTICLES:
        return found, False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" and value in ("", "hidden"):
            return OUT, False
        if key == "role" and value in LEFT_OUT_ROLES:
            found = SUSPECT
        for given in value.split() if key in ("class", "id") else ():
            parts = WORD.findall(given)
            words = LEFT_OUT_WORDS.intersection(parts)
            if not words or len(parts) > 1 and parts[0] in STATES or in_article and words == {"header"}:
                continue
            comments = comments or bool(words & COMMENT_WORDS)
            named = len(parts) == 1 or bool(words & NEVER_WORDS)
            found = max(found, THIN if in_article and not named else LAYOUT if words <= LAYOUT_WORDS and not in_article else SUSPECT)
    return found, comments


class _Page:
    """Block elements in page order (parents before children) and runs of text between block borders."""

    def __init__(self) -> None:
        self.parent, self.name, self.out, self.suspected, self.comments = [-1], ["#page"], [False], [CLEAR], [False]
        self.chars, self.tags, self.link_chars, self.link_tags = [0], [0], [0], [0]
        self.runs: list[tuple[int, str]] = []
        self._open, self._text, self._links = [0], [], []
        self._where: dict[str, list[int]] = {}  # depths of the open elements of a name

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.runs.append((self._open[-1], text))
            self._text.clear()

    def text(self, raw: str) -> None:
        at = self._open[-1]
        if raw and not self.out[at]:
            raw = html.unescape(raw)
            self._text.append(raw)
            size = len(raw) - raw.count(" ") - raw.count("\n")
            self.chars[at] += size
            if self._links:
                self.link_chars[at] += size

    def _pop_to(self, depth: int) -> None:
        self._flush()
        while len(self._open) > depth:
            self._where[self.name[self._open.pop()]].pop()
        while self._links and self._links[-1] >= depth:
            self._links.pop()

    def _deepest(self, names: Iterable[str]) -> int:
        return max((self._where[n][-1] for n in names if self._where.get(n)), default=-1)

    def start(self, name: str, attributes: str) -> None:
        here = self._open[-1]
        self.tags[here] += not self.out[here]
        if name == "a" and not self.out[here]:
            self.link_tags[here] += 1
            if not attributes.endswith("/"):
                self._links = [len(self._open) - 1]
        if name == "br":
            self._text.append(" ")
        if name not in BLOCK and name not in LEFT_OUT:
            if not attributes or self.out[here] or name in VOID or _suspected(name, attributes, True)[0] == CLEAR:
                return
        if name in VOID:
            self._pop_to(len(self._open))
            return
        if name in BLOCK:
            self._flush()
            if self.name[here] == "p":
                self._pop_to(len(self._open) - 1)
            elif name in CLOSES:
                closing, holders = CLOSES[name]
                depth = self._deepest(closing)
                if depth > self._deepest(holders):
                    self._pop_to(depth)
        here = self._open[-1]
        suspected, comments = _suspected(name, attributes, bool(self._where.get("article")))
        self.parent.append(here)
        self.name.append(name)
        self.out.append(self.out[here] or suspected == OUT)
        self.suspected.append(suspected)
        self.comments.append(comments)
        for counts in (self.chars, self.tags, self.link_chars, self.link_tags):
            counts.append(0)
        if name in BLOCK:
            self._flush()
        self._where.setdefault(name, []).append(len(self._open))
        self._open.append(len(self.name) - 1)

    def end(self, name: str) -> None:
        if name == "a":
            self._links.clear()
        if self._where.get(name):
            self._pop_to(self._where[name][-1])

    def close(self) -> None:
        self._pop_to(1)
        self._judge()

    def _judge(self) -> None:
        """Suspects leave with all they hold, unless they hold the article."""
        if not {THIN, LAYOUT, SUSPECT} & set(self.suspected):
            return
        n = len(self.parent)
        plain = [c - l for c, l in zip(self.chars, self.link_chars)]
        dense = _densities(self)[0]
        mains, held = [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            held[i] += not self.out[i] and self.name[i] in ARTICLES
            mains[i] += not self.out[i] and self.name[i] == "main"
            up = self.parent[i]
            plain[up], mains[up], held[up] = plain[up] + plain[i] * (not self.comments[i]), mains[up] + mains[i], held[up] + held[i]
        article = [0.0] * n
        for i in range(1, n):
            up = self.parent[i]
            article[i] = dense[i] if self.name[i] == "article" else article[up]
            if self.out[up]:
                self.out[i] = True
            elif self.suspected[i] == THIN:
                self.out[i] = dense[i] < ALIKE * article[up]
            elif self.suspected[i] in (LAYOUT, SUSPECT):
                most = self.suspected[i] == LAYOUT and not held[0] and 2 * plain[i] > plain[0]
                self.out[i] = not (mains[i] if self.comments[i] else held[i] or most)
            if self.out[i]:
                for counts in (self.chars, self.tags, self.link_chars, self.link_tags):
                    counts[i] = 0
        self.runs = [run for run in self.runs if not self.out[run[0]]]


def _parsed(source: str) -> _Page:
    page, at = _Page(), 0
    while (tag := TAG.search(source, at)) is not None:
        page.text(source[at:tag.start()])
        at = tag.end()
        closing, name, attributes = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            page.end(name)
            continue
        page.start(name, attributes or "")
        if name in RAW:
            end = RAW_END[name].search(source, at)
            at = end.start() if end else len(source)
    page.text(source[at:])
    page.close()
    return page


def _densities(page: _Page) -> tuple[list[float], list[float], list[bool]]:
    """Composite density of every element, the sum of those of its children and of its own text, and whether it is mostly links."""
    n = len(page.parent)
    chars, tags, link_chars, link_tags = page.chars[:], page.tags[:], page.link_chars[:], page.link_tags[:]
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        for counts in (chars, tags, link_chars, link_tags):
            counts[up] += counts[i]
    share = link_chars[0] / chars[0] if chars[0] else 0.0

    def density(c: int, t: int, lc: int, lt: int) -> float:
        if not c:
            return 0.0
        t = max(t, 1)
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0) + 1.0) / max(math.log(base), 1.0)

    dense = [0.0 if page.out[i] else density(chars[i], tags[i], link_chars[i], link_tags[i]) for i in range(n)]
    sums = [0.0 if page.out[i] else density(page.chars[i], page.tags[i], page.link_chars[i], page.link_tags[i]) for i in range(n)]
    for i in range(1, n):
        sums[page.parent[i]] += dense[i]
    return dense, sums, [2 * lc > c for c, lc in zip(chars, link_chars)]


def _around(page: _Page, core: int, heavy: list[bool]) -> tuple[int, bool]:
    """The element whose blocks belong to the core, and whether all do: the outermost article around it, else the outermost
    main (both in full), else the nearest ancestor with text outside the core that is not in a block of links."""
    path = [core]
    while page.parent[path[-1]] >= 0:
        path.append(page.parent[path[-1]])
    for name in ("article", "main"):
        for at in reversed(path):
            if page.name[at] == name:
                return at, True
    texts = [0] * len(heavy)
    for at, _ in page.runs:
        texts[at] += 1
    for i in range(len(texts) - 1, 0, -1):
        if page.out[i] or heavy[i]:
            texts[i] = 0
        texts[page.parent[i]] += texts[i]
    return next((up for at, up in zip(path, path[1:]) if texts[up] > texts[at]), core), False


def main_text(source: str) -> str:
    """The article's blocks in page order, joined by empty lines; empty if the page has none."""
    if not source:
        return ""
    page = _parsed(source)
    if not page.runs:
        return ""
    dense, sums, heavy = _densities(page)
    n = len(dense)
    best = list(range(n))  # of each subtree, the first element with the largest sum
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        if (sums[best[i]], -best[i]) > (sums[best[up]], -best[up]):
            best[up] = best[i]
    threshold, at = dense[best[0]], best[0]
    while at >= 0 and page.name[at] not in ("html", "#page"):
        threshold = min(threshold, dense[at])
        at = page.parent[at]
    chosen = [False] * n
    for i in range(n):
        if dense[i] >= threshold and dense[i] > 0:
            chosen[best[i]] = True
    around, whole = _around(page, best[0], heavy)
    beside = [i == around for i in range(n)]
    for i in range(1, n):
        chosen[i] = (chosen[i] or chosen[page.parent[i]]) and not page.out[i]
        beside[i] = (beside[i] or beside[page.parent[i]] and (whole or not heavy[i])) and not page.out[i]
    return "\n\n".join(text for i, text in page.runs if chosen[i] or beside[i])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            texts = [main_text(x.as_py()) for x in part.column("_html")]
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["_id", "_url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: (_id, _url, text, n_chars); one pass over the rows without a shuffle.

    Null and empty pages, and pages with nothing but left-out parts, give an empty text. Time grows with the length of a page, however its
    elements nest. Broken markup is read as far
    as it makes sense: open paragraphs, list items and cells end where the next begins, end tags without a start are
    passed over, quotes that never close end with the tag. Elements may nest to any depth. Repeated rows stay repeated,
    null ids and urls stay null, an empty table gives an empty result, other columns are not read.
    """
    source = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), text_or_empty(html_col).alias("_html"))
    kinds = dict(source.dtypes)
    return source.mapInArrow(_extracted, f"_id {kinds['_id']}, _url {kinds['_url']}, text string, n_chars long")
