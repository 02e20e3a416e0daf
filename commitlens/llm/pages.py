"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of tags and text blocks.  A tag costs; a word of a block gains
or costs by the elements around it, a block at most ``MOST_COST``, so that a long insert doesn't cut an article
in two.  One linear scan finds the contiguous region with the largest sum (of equal ones the first), and the
blocks of the region whose words gain are the main text.

Names in class, id and role weigh what they say of an element's own part of the page.  An element that holds most
words of the page and its main heading or content is a wrapper: names such as ``sidebar`` on it say what
the page has, not what the element is, and count for nothing.  So do names of states (``has-sidebar``, ``comments-open``).
A block that is mostly links is no text, unless it is in the article or a paragraph that is more than links.

Weights of elements and of words in their class and id start from a table of priors and are
fitted on labelled pages: those that mark their content with one ``article`` or ``main``
element, whose name itself is not learned.  At most ``SAMPLE`` of them are used (a
documented bound); every whole page is extracted.

A null or empty page has an empty text.  Broken markup is read as far as it goes: unknown
end tags are ignored, unclosed elements end with their parent, and an unclosed script,
style or comment reaches to the end.  Repeated rows give repeated results, an empty table an empty one.  Only
page_id, url and html are read, so other columns' names can't clash.
"""

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm import words as W

SAMPLE = 400
TAG_COST = 0.3
#: The most that the words of one block cost.
MOST_COST = 3.0

#: Elements whose content is never text.
RAW = "script style noscript template svg iframe object video audio canvas textarea select title"
INLINE = (
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr math semantics mrow mi mo mn ms mtext mfrac msup msub msubsup msqrt mroot mover munder munderover mspace mtable mtr mtd"
)
VOID = "area base br col embed hr img input link meta param source track wbr"
#: Prior weights of elements and of words in class and id.
PRIOR = {
    **dict.fromkeys("article main".split(), 2.0),
    **dict.fromkeys("p h1 h2 h3 h4 h5 h6 blockquote pre".split(), 1.0),
    **dict.fromkeys("content post entry story body text".split(), 0.5),
    **dict.fromkeys("ul ol li".split(), -0.3),
    **dict.fromkeys("head nav header footer aside form button dialog menu fieldset @link @hidden".split(), -6.0),
    **dict.fromkeys(
        "ad ads advert advertisement advertising sponsor sponsored promo promotion sidebar menu navbar navigation breadcrumb "
        "breadcrumbs comment comments reply replies respond discussion disqus cookie cookies consent gdpr banner notice alert "
        "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
        "pagination pager footer header masthead topbar widget toolbar tags legal copyright disclaimer".split(),
        -6.0,
    ),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW.split()) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORDS = re.compile(r"[a-z]+")
#: A name that says what state something is in.
_STATE = re.compile(r"(?:has|no|with|without|is|not)[-_]|.*[-_](?:open|opened|closed|enabled|disabled|active|inactive|on|off)$", re.I)


class Element:
    """An open element: the names it carries and how many words it holds."""

    __slots__ = ("held", "name", "names")

    def __init__(self, name, rest=""):
        self.name, self.names, self.held = name, set(), 0
        for value in _NAMES.findall(rest):
            for token in "".join(value).split():
                if not _STATE.match(token):
                    self.names.update(_WORDS.findall(token.lower()))
        if _HIDDEN.search(rest):
            self.names.add("@hidden")


class Block:
    """A run of text between block tags: ``text``, its words, how many are links, the elements and names around it."""

    __slots__ = ("around", "inside", "links", "names", "tags", "text", "words")


def blocks(page):
    """The blocks of a page in order; ``tags`` are the block tags since the block before."""
    inline, void = set(INLINE.split()), set(VOID.split())
    stack, out, parts, tags = [], [], [], []
    anchors, linked = {}, 0

    def close():
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            b = Block()
            b.text, b.words, b.links = text, len(text.split()), linked
            b.around = [x for x in stack if x.name not in inline]
            b.inside = any(x.name in ("article", "main") for x in b.around)
            b.tags, tags[:] = list(tags), []
            for x in b.around:
                x.held += b.words
            out.append(b)
        linked = 0

    def write(text):
        nonlocal linked
        if text:
            text = html.unescape(text)
            parts.append(text)
            if any(x.name == "a" for x in stack):
                linked += len(text.split())

    at = 0
    for m in _TOKEN.finditer(page):
        write(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            if m["raw"]:
                parts.append(" ")
            continue
        name = m["name"].lower()
        if name in inline:
            if m["end"]:
                _pop(stack, name)
            elif not m["rest"].endswith("/") and name not in void:
                stack.append(Element(name))
            continue
        if name == "br":
            parts.append(" ")
            continue
        close()
        tags.append(name)
        if name == "body":
            stack.clear()
        elif stack and stack[-1].name == "head" and name not in void:
            _pop(stack, "head")
        if m["end"]:
            _pop(stack, name)
        elif name not in void and not m["rest"].endswith("/"):
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):
                _pop_sibling(stack, name)
            elif "p" in [x.name for x in stack[-6:]]:
                _pop(stack, "p")
            stack.append(Element(name, m["rest"]))
            if name in ("main", "article", "h1") and name not in anchors:
                if name != "h1" or not any(x.name in ("header", "nav") for x in stack):
                    anchors[name] = set(map(id, stack))
    write(page[at:])
    close()
    anchor = anchors.get("main") or anchors.get("h1") or anchors.get("article")
    most = sum(b.words for b in out) / 2
    for b in out:
        b.names = set()
        for x in b.around:
            good = {n for n in x.names if PRIOR.get(n, 0.0) > 0}
            wraps = x.name == "body" or (x.held > most and (good or not anchor or id(x) in anchor))
            b.names |= good if wraps else x.names
            # Some pages are one form from top to bottom.
            if x.name != "form" or x.held <= most or id(x) not in (anchor or ()):
                b.names.add(x.name)
        text_of_its_own = b.inside or (b.around and b.around[-1].name == "p" and b.links < b.words)
        if 2 * b.links > b.words and not text_of_its_own:
            b.names.add("@link")
    return out


def _pop(stack, name):
    for k in range(len(stack) - 1, -1, -1):
        if stack[k].name == name:
            del stack[k:]
            return


def _pop_sibling(stack, name):
    """A new item ends the one before it, unless a list, table or section lies between."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k].name == name:
            del stack[k:]
            return
        if stack[k].name in ("ul", "ol", "table", "div", "section", "article", "main", "dl", "nav", "body"):
            return


def value(names, weights):
    """What a word among these names is worth, between -1 and 1."""
    return np.tanh(0.3 + sum(weights.get(x, 0.0) for x in names))


def worth(block, weights):
    """What a block adds to a region that holds it."""
    return max(value(block.names, weights) * block.words, -MOST_COST)


def extract(page, weights):
    """Blocks of the best region that are worth something, joined by one space."""
    found = blocks(page or "")
    best, best_from, best_to, total, start = 0.0, 0, 0, 0.0, 0
    gains = []
    for i, b in enumerate(found):
        gain = worth(b, weights)
        gains.append(gain)
        if total <= 0:
            total, start = 0.0, i
        else:
            total -= TAG_COST * len(b.tags)
            if total <= 0:
                total, start = 0.0, i
        total += gain
        if total > best:
            best, best_from, best_to = total, start, i + 1
    return " ".join(found[i].text for i in range(best_from, best_to) if gains[i] > 0)


def fit(pages):
    """Weights from labelled pages: logistic corrections to the priors, held near them."""
    rows, y, n = [], [], []
    for page in pages:
        for b in blocks(page):
            if not any(PRIOR.get(x, 0) <= -6 for x in b.names):
                rows.append(b.names - {"article", "main", "body", "html"})
                y.append(b.inside)
                n.append(min(b.words, 50))
            else:
                rows.append({x for x in b.names if x not in ("article", "main", "body", "html")})
                y.append(False)
                n.append(min(b.words, 50))
    seen = Counter(x for r in rows for x in r)
    names = sorted(x for x, c in seen.items() if c >= 5)
    weights = dict(PRIOR)
    if not names or all(y) or not any(y):
        return weights
    place = {x: i for i, x in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        for name in r:
            if name in place:
                x[i, place[name]] = 1
    prior = np.array([PRIOR.get(name, 0.0) for name in names])
    y, n = np.array(y, float), np.array(n, float) / np.mean(n)
    w = prior.copy()
    hold = 0.02 * len(rows)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(0.3 + x @ w, -30, 30)))
        g = x.T @ (n * (y - p)) - hold * (w - prior)
        h = (x * (n * p * (1 - p))[:, None]).T @ x + hold * np.eye(len(names))
        w = w + np.linalg.solve(h, g)
    weights.update(zip(names, w.tolist()))
    return weights


def page_weights(pages: DataFrame, sample: int = SAMPLE) -> dict:
    """Weights fitted on about ``sample`` labelled pages, chosen by hash; never on more than twice as many."""
    marked = pages.select("page_id", "html").filter(F.regexp_count(F.lower("html"), F.lit("<(article|main)[ >]")) == 1)
    total = marked.count()
    if total > sample:
        marked = marked.filter(F.pmod(F.xxhash64("page_id", "html"), F.lit(1 << 20)) < int(sample / total * (1 << 20)))
    return fit(sorted(r.html for r in marked.select("html").limit(2 * sample).collect()))


def main_text(pages: DataFrame, weights: dict) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def measure(part):
        texts = [extract(x, weights) for x in part["html"].to_pylist()]
        return {
            "page_id": part["page_id"], "url": part["url"], "text": pa.array(texts, pa.string()),
            "n_chars": [len(t) for t in texts],
        }

    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return W.map_texts(
        pages, ["page_id", "url", "html"], "html", W.schema("page_id bigint, url string, text string, n_chars bigint"), measure
    )
