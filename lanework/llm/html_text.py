"""Main text of web pages: flat text blocks, judged by a decision tree on each block's and its neighbours' shape.

A page is cut at block-level tags into flat blocks of text. A block is described by its word count and link density, by
those of the blocks before and after it, by the unlinked words and the link density of its container, and by few marks: a
heading, a copyright sign, a container that says it is page chrome (by tag, class, id or role). The tree is grown once, on
the driver, from the small labelled pages below, and applied to every block of every page. Nothing marks main text.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from lanework.llm import _base

#: Elements whose edges end a block (fixed values of the HTML standard's flow elements).
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements without an end tag.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
SILENT_TAGS = frozenset("script style noscript template svg math iframe object canvas audio video head title select button textarea datalist".split())
#: Containers by kind; a p, li, dt, dd, tr, td or th ends by itself when the next begins.
CHROME_TAGS = frozenset("nav footer aside form menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
#: Elements whose blocks belong together.
CONTAINERS = frozenset("html body div section article main aside nav header footer form td details dialog fieldset".split())
INLINE = frozenset("span label".split())
#: Class words that make even an article chrome.
NO_ARTICLE = frozenset("ad ads advert adverts advertisement comment comments reply replies respond promo sponsored related".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CHROME_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header legal login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies share sharing sidebar signup social sponsor sponsored subscribe toc toolbar widget reader respond discussion copyright".split())
MAIN_WORDS = frozenset("article articlebody body content entry main maintext post story text".split())

NAME_OF_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
QUOTED = re.compile(r"=\s*([\"'])")
#: Elements whose content holds no tags but their own end.
RAW = {x: re.compile(rf"</{x}[\s/>]", re.I) for x in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "container_words", "container_share", "container_link_density", "chrome", "heading", "sign")


def tokens(html: str):
    """(text before, tag, attributes, whether it ends an element) of each tag, in one pass over the page; last the rest, without a tag.

    As browsers do: quotes count after an equals sign only, a tag or comment that does not end takes the rest of the page,
    and raw elements are skipped whole.
    """
    at, start, n = 0, 0, len(html)
    while True:
        start = html.find("<", start)
        if start < 0:
            yield html[at:], "", "", False
            return
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4) + 2
            if end < 2:
                end = n
        elif html.startswith(("<!", "<?"), start):
            end = html.find(">", start)
        else:
            found = NAME_OF_TAG.match(html, start)
            if not found:
                start += 1
                continue
            place, end = found.end(), html.find(">", found.end())
            while end >= 0 and (quote := QUOTED.search(html, place, end)):
                place = html.find(quote[1], quote.end()) + 1
                if place == 0:
                    end = -1
                elif place > end:
                    end = html.find(">", place)
        if end < 0:
            yield html[at:start], "", "", False
            return
        if html[start + 1 : start + 2] in "!?":
            yield html[at:start], "", "", False
            at = start = min(end + 1, n)
            continue
        tag, closing = found[1].lower(), html[start + 1] == "/"
        yield html[at:start], tag, html[found.end() : end], closing
        at = start = end + 1
        if tag in RAW and not closing:
            close = RAW[tag].search(html, at)
            at = start = close.start() if close else n


class _Element(NamedTuple):
    """An element that opens chrome or main; up is the place of the next such element around it (-1: none)."""

    up: int
    tag: str
    chrome: str  # "", "words" (a class, id, role or form), "tag" or "hidden"
    main: bool
    inline: bool


def _kind(tag: str, attributes: str) -> tuple[str, bool]:
    """How an element opens page chrome, and whether it opens an article. Those of a whole page do neither."""
    if tag in ("html", "body"):
        return "", False
    hidden, words, main = False, tag == "form", tag in MAIN_TAGS
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
        elif name in ("class", "id", "role"):
            found = {x.lower() for x in NAME.findall(value)} | set(value.lower().split())
            words |= not (NO_ARTICLE if tag in MAIN_TAGS else CHROME_WORDS).isdisjoint(found)
            main |= not MAIN_WORDS.isdisjoint(found)
    return "hidden" if hidden else "tag" if tag in CHROME_TAGS and tag != "form" else "words" if words else "", main


def _within(elements: list[_Element], released: set[int], ending: set[int]) -> list[tuple[bool, bool]]:
    """Whether each element is within chrome, and within main. released are no chrome; ending end what they inherit."""
    out: list[tuple[bool, bool]] = []
    for i, e in enumerate(elements):
        chrome, main = out[e.up] if e.up >= 0 else (False, False)
        own = (bool(e.chrome) or (e.tag == "header" and not main)) and i not in released
        chrome = own or (chrome and i not in ending)
        out.append((chrome, main if e.inline else (main or (e.main and not own)) and not chrome))
    return out


def _parts(elements: list[_Element], blocks: list[tuple[int, float]]) -> list[tuple[bool, bool]]:
    """(chrome, main) of each element, given (element, unlinked words) of the blocks.

    Where all articles of a page are within chrome, or most of its words, a wrapper was taken for chrome: a wrapper by its
    words alone that holds them is none, and an article ends other chrome than hidden.
    """
    within = _within(elements, set(), set())
    outside, tagged, total = 0.0, False, 0.0
    held, articles = [0.0] * len(elements), [0.0] * len(elements)
    for at, words in blocks:
        total += words
        if at >= 0 and within[at][1]:
            outside += words
        article = False
        main = at >= 0 and within[at][1]
        while at >= 0:
            e = elements[at]
            held[at] += words
            if article:
                articles[at] += words
            if e.tag in MAIN_TAGS and not e.chrome:
                article = True
                tagged |= main
            at = e.up
    if tagged:
        return within
    hidden = [False] * len(elements)
    released, ending = set(), set()
    for i, e in enumerate(elements):
        hidden[i] = e.chrome == "hidden" or (e.up >= 0 and hidden[e.up])
        if hidden[i]:
            continue
        if e.chrome == "words" and (articles[i] > outside or held[i] > max(total / 2, outside)):
            released.add(i)
        if e.tag in MAIN_TAGS and not e.chrome and held[i] > outside:
            ending.add(i)
    return _within(elements, released, ending) if released or ending else within


def blocks(html: str) -> list[tuple[str, list[float]]]:
    """The flat blocks of a page, in order, with what FEATURES names of each."""
    found: list[list] = []
    stack: list[tuple[str, bool, int, int]] = []  # tag, whether within silence, the place in elements and the container of what it is within
    elements: list[_Element] = []
    held: list[list[int]] = [[0, 0]]  # unlinked and all words of each container
    parts: list[tuple[str, bool]] = []
    links = 0
    silent, inner, container = False, -1, 0
    heading = False

    def end_block() -> None:
        nonlocal parts
        if parts:
            text = SPACE.sub(" ", unescape("".join(x for x, _ in parts))).strip()
            if text:
                linked = len(unescape("".join(x if link else " " for x, link in parts)).split())
                words = len(text.split())
                held[container][0] += words - linked
                held[container][1] += words
                found.append([text, words, linked / words, inner, heading, text[0] in "©®" or "©" in text[:40], container])
            parts = []

    def state() -> None:
        nonlocal silent, inner, container
        silent, inner, container = stack[-1][1:] if stack else (False, -1, 0)

    for before, tag, attributes, closing in tokens(html):
        if before and not silent:
            parts.append((before, links > 0))
        if not tag:
            continue
        if tag == "br":
            parts.append((" ", links > 0))
        elif tag == "a":
            links = max(0, links - 1) if closing else links + 1
        elif tag in VOID_TAGS:
            if tag == "hr":
                end_block()
        elif tag in INLINE:
            if closing:
                if stack and stack[-1][0] == tag:
                    if len(stack) < 2 or stack[-2][2] != inner:
                        end_block()
                    stack.pop()
                    state()
            elif not attributes.endswith("/"):
                chrome, main = _kind(tag, attributes)
                if chrome:
                    end_block()
                    elements.append(_Element(inner, tag, chrome, main, True))
                    inner = len(elements) - 1
                stack.append((tag, silent, inner, container))
        elif tag in BLOCK_TAGS or tag in SILENT_TAGS:
            end_block()
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                links = 0
            else:
                closes = SELF_CLOSING.get(tag) or ({"p"} if tag in BLOCK_TAGS else set())
                while True:
                    i = len(stack)
                    while i and stack[i - 1][0] in INLINE:
                        i -= 1
                    if not i or stack[i - 1][0] not in closes:
                        break
                    del stack[i - 1 :]
                state()
                if not attributes.endswith("/"):
                    chrome, main = _kind(tag, attributes)
                    if chrome or main or tag == "header":
                        elements.append(_Element(inner, tag, chrome, main, False))
                        inner = len(elements) - 1
                    if tag in CONTAINERS:
                        held.append([0, 0])
                        container = len(held) - 1
                    stack.append((tag, silent or tag in SILENT_TAGS, inner, container))
            state()
            heading = tag[0] == "h" and tag[1:].isdigit() and not closing
    end_block()
    within = [*_parts(elements, [(b[3], b[1] * (1 - b[2])) for b in found]), (False, False)]
    open_words = sum(b[1] * (1 - b[2]) for b in found if not within[b[3]][0])
    out, edge = [], (None, 0, 0.0)
    for i, (text, words, density, at, is_heading, sign, own) in enumerate(found):
        before, after = found[i - 1] if i else edge, found[i + 1] if i + 1 < len(found) else edge
        plain, every = held[own]
        out.append((text, [words, density, before[1], before[2], after[1], after[2], plain, plain / max(1.0, open_words), 1 - plain / every, within[at][0], is_heading, sign]))
    return out


_T = "the river rose slowly over the old stone bridge while people from the valley watched the water and waited for the rain to end before dark "
#: The labelled table: small pages as (label, html) blocks; 1 is main text. Order matters, as neighbours are features.
LABELLED_PAGES: tuple[tuple[tuple[int, str], ...], ...] = (
    ((0, "<nav><ul><li><a href=/a>home</a></li><li><a href=/b>about us</a></li></ul></nav>"), (0, "<div class=ad>buy the new lamp today at half price.</div>"), (1, "<article><h1>the river rose</h1>"), (1, f"<p>{_T * 3}</p>"), (1, "<p>no rain.</p>"), (1, f"<p>{_T}</p>"), (1, "<p>so.</p></article>"), (0, "<footer>&copy; valley news. all rights kept by us.</footer>")),
    ((0, "<nav><a href=/a>home</a> <a href=/b>news</a></nav>"), (0, "<div class=ad>a long advert that goes on about lamps and chairs and tables for every house in the valley and beyond, cheap.</div>"), (1, "<article><h1>bridge</h1>"), (1, "<p>short.</p></article>"), (0, "<footer>&copy; valley</footer>")),
    ((0, "<header>valley news every day</header>"), (0, "<div class=menu><a href=/a>sport</a></div>"), (1, f"<main><p>{_T * 2}</p>"), (1, "<p>it was late.</p>"), (1, f"<ul><li>{_T}</li>"), (1, "<li>one boat</li></ul></main>"), (0, f"<aside>{_T}</aside>"), (0, f"<div class=comments><p>{_T}</p>"), (0, "<p>i agree.</p></div>")),
    ((0, "<div id=cookie-notice>we use cookies to make this page work better for you and for us.</div>"), (1, "<div class=content><h2>water</h2>"), (1, f"<p>{_T * 4}</p>"), (1, "<p>see <a href=/x>the map</a> of it.</p>"), (1, "<p><a href=/y>the whole report</a></p></div>"), (0, "<form>your name and mail address please</form>"), (0, "<div class=related><a href=/z>more about rain</a></div>")),
    ((0, "<div><a href=/a>home</a> <a href=/b>news</a> <a href=/c>sport</a></div>"), (0, "<div>log in</div>"), (1, f"<div><p>{_T * 2}</p>"), (1, f"<p>{_T}</p>"), (1, f"<p>{_T * 3}</p></div>"), (0, "<div>&copy; valley news</div>"), (0, "<div><a href=/p>privacy</a> <a href=/t>terms</a></div>")),
    ((0, "<div><a href=/a>one link</a></div>"), (1, f"<div>{_T * 5}</div>"), (1, f"<div>{_T}</div>"), (0, "<div><a href=/k>next page</a></div>"), (0, "<div>share</div>")),
    ((0, "<ul><li><a href=/1>a</a></li><li><a href=/2>b</a></li></ul>"), (1, f"<p>{_T}{_T}</p>"), (1, f"<p>{_T}</p>"), (0, f"<div class=sidebar>{_T}</div>"), (0, f"<section id=comments>{_T}</section>"), (0, "<p>call us</p>")),
    ((0, f"<nav><a href=/a>home</a> {_T}</nav>"), (1, f"<p>{_T * 3}</p>"), (1, f"<p>{_T}</p>"), (1, f"<p>{_T * 2}</p>"), (0, f"<footer>&copy; the paper of the valley and its river, with all rights kept by us and nobody else.</footer>")),
    ((0, f"<div class=banner>{_T * 2}</div>"), (1, f"<p>{_T * 3}</p>"), (0, f"<div class=newsletter>{_T}</div>"), (1, f"<p>{_T * 2}</p>"), (0, f"<div class=comments>{_T * 3}</div>"), (0, f"<div class=comments>{_T}</div>"), (0, f"<footer>{_T * 2}</footer>")),
    ((0, f"<aside>{_T * 4}</aside>"), (1, f"<div class=entry>{_T}</div>"), (0, f"<footer>{_T}</footer>"), (0, f"<footer>short words here</footer>")),
    ((0, "<div><a href=/1>news of the valley today</a> <a href=/2>sport and games for all</a> <a href=/3>weather of the week</a></div>"), (1, f"<p>{_T * 2}</p>"), (1, f"<p>{_T} <a href=/m>a map of the valley</a></p>"), (1, f"<p>{_T}</p>"), (0, "<ul><li><a href=/4>what else happened near the river last week</a></li>"), (0, "<li><a href=/5>ten places to see before the winter comes</a></li></ul>"), (0, "<div>all rights kept by the paper of the valley</div>"), (0, "<div><a href=/6>write to us at any time of day</a></div>")),
    ((0, "<div><a href=/7>the front page of the whole paper</a></div>"), (0, "<div>search the whole paper for a word</div>"), (0, "<div><a href=/8>your own pages and all you have kept</a></div>"), (1, f"<div>{_T * 3}</div>"), (1, f"<div>{_T}</div>"), (0, "<div><a href=/9>go back to the top of this page</a></div>")),
    ((0, f"<aside class=promo>{_T * 2}</aside>"), (1, "<article><p>yes.</p></article>"), (0, f"<footer>{_T}</footer>")),
    ((0, "<header><a href=/>valley</a></header>"), (1, "<article class=long><header><h1>a title in the article</h1></header>"), (1, "<p>by a writer of the valley</p>"), (1, "<h2>part</h2>"), (1, f"<p>{_T}</p>"), (0, f"<div class=share>{_T}</div>"), (1, "<p><a href=/s>source</a></p></article>"), (0, f"<div class=newsletter>{_T}</div>")),
    ((0, "<nav><ul><li><a href=/a>news</a></li><li><a href=/b>sport</a></li></ul></nav>"), (0, "<div class=ad>lamps and chairs at half price all week.</div>"), (1, "<article><h1>a very short note on the old stone bridge</h1>"), (1, "<p>it was closed in the night and is open again now.</p></article>"), (0, "<footer>&copy; valley. all of it is ours.</footer>")),
    ((0, "<nav><a href=/a>news</a></nav>"), (0, "<div class=ad>chairs for all.</div>"), (1, "<article><h1>rain again and again over the whole of the long valley</h1>"), (1, "<p>it rained.</p></article>"), (0, "<footer>&copy; valley, the paper of all who live here and of their guests.</footer>")),
    ((0, "<nav><h2>pages</h2><a href=/a>news</a></nav>"), (1, f"<main><h1>the river</h1><p>{_T * 2}</p></main>"), (0, f"<aside><h3>more of it</h3><p>{_T}</p></aside>"), (0, "<div class=related><h2>read next</h2><a href=/b>rain in the hills</a></div>"), (0, f"<section id=comments><h3>what you say</h3><p>{_T}</p></section>"), (0, "<footer><h4>about us</h4><p>we write of the valley</p></footer>")),
    ((0, "<nav><a href=/a>news</a></nav>"), (1, "<article><h1>the bridge</h1>"), (1, f"<p>{_T * 2}</p>"), (1, f"<p>{_T}</p></article>")),
    ((0, "<nav><a href=/a>news</a></nav>"), (1, f"<article><p>{_T * 2}</p>"), (1, "<p>the end.</p></article>")),
    ((1, f"<p>{_T}</p>"), (1, f"<p>{_T * 2}</p>"), (1, "<p>the water fell again in the end.</p>")),
    ((1, f"<div>{_T * 3}</div>"),),
    ((0, "<div><a href=/a>news</a></div>"), (1, f"<div><p>{_T * 2}</p>"), (1, "<p>so it was.</p></div>"), (0, "<div>call us at any time of the day or of the night</div>")),
    ((0, "<nav><a href=/a>news</a></nav>"), (0, "<div class=ad>lamps for all</div>"), (1, f"<article><h1>the long story</h1><p>{_T * 6}</p>"), (1, "<p>well.</p>"), (1, f"<p>{_T * 9}</p></article>"), (0, "<footer>&copy; valley, the paper. write to us at any time.</footer>")),
    ((0, f"<div class=banner>{_T}</div>"), (1, f"<article><p>{_T * 7}</p></article>"), (0, f"<section class=comments><p>{_T * 6}</p><p>i agree with you on that.</p></section>"), (0, f"<aside>{_T * 5}</aside>"), (0, "<footer>all rights kept</footer>")),
    ((0, "<div><a href=/a>news</a> <a href=/b>sport</a></div>"), (1, f"<div><p>{_T * 8}</p>"), (1, f"<p>{_T * 6}</p></div>"), (0, "<div>call us at any time of the day or of the night</div>"), (0, "<footer><a href=/c>who we are</a> and what we do for you</footer>")),
    ((0, "<nav><a href=/a>news</a></nav>"), (1, f"<article><p>{_T * 2}</p>"), (1, "<p>so.</p></article>"), (0, "<footer>all rights kept</footer>")),
    ((0, "<body class='single right-sidebar'><div class='content with-sidebar'><form><nav><a href=/a>home</a></nav>"), (1, f"<article><h1>the bridge</h1>"), (1, f"<p>{_T}</p>"), (1, "<p>so.</p></article>"), (0, f"<aside>{_T}</aside>"), (0, f"<div class=comments>{_T}</div></form></div>"), (0, "<footer>&copy; valley</footer></body>")),
)


MARKS = re.compile(r"<(/?)(?:article|main|div class=(?:content|entry))>")


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled blocks (a block's markup may give several), of each page as it is and without what marks an article."""
    rows, labels = [], []
    for page in LABELLED_PAGES:
        for strip in (False, True):
            plain = lambda html, strip=strip: MARKS.sub(r"<\1div>", html) if strip else html
            texts = blocks("".join(plain(html) for _, html in page))
            wanted = [(label, text) for label, html in page for text, _ in blocks(plain(html))]
            assert [text for text, _ in texts] == [text for _, text in wanted]
            rows += [features for _, features in texts]
            labels += [label for label, _ in wanted]
    return np.array(rows, float), np.array(labels, int)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8, least: int = 3):
    """A binary decision tree by Gini impurity, each side of a split with at least ``least`` rows: a leaf is a label, a node (feature, threshold, at most, above)."""
    if depth == 0 or labels.min() == labels.max():
        return int(labels.mean() >= 0.5)
    best = None
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for threshold in (values[:-1] + values[1:]) / 2:
            low = rows[:, feature] <= threshold
            if min(low.sum(), (~low).sum()) < least:
                continue
            impurity = sum(part.size * 2 * part.mean() * (1 - part.mean()) for part in (labels[low], labels[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, feature, float(threshold), low)
    if best is None:
        return int(labels.mean() >= 0.5)
    _, feature, threshold, low = best
    return feature, threshold, grow(rows[low], labels[low], depth - 1, least), grow(rows[~low], labels[~low], depth - 1, least)


def judge(tree, features: list[float]) -> int:
    while not isinstance(tree, int):
        feature, threshold, low, high = tree
        tree = low if features[feature] <= threshold else high
    return tree


def main_text(html: str, tree) -> str:
    return "\n\n".join(text for text, features in blocks(html) if judge(tree, features))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page; text is empty where no block is main text.

    A null html counts as empty. Equal rows and null ids are ordinary rows; an empty table gives an empty result; further
    columns are not read.
    """
    tree = grow(*labelled_table())

    def make():
        def one(batch):
            texts = [main_text(x or "", tree) for x in batch.column(2).to_pylist()]
            return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(x) for x in texts]}

        return one

    return _base.map_batches(pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].alias("url"), pages[html].alias("html")), make, "page_id long, url string, text string, n_chars long")
