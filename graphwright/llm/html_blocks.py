"""Blocks of raw HTML with the path of block elements above each; no tree is built.

Asides are told by their element (a nav, a footer) or by a name (class, id, role). A name counts as a whole: it is one of ASIDE_WORDS,
or a compound of these and of words that only say where or what shape (``site-nav``, ``comment_list``); ``market-share`` and
``with-sidebar`` are none. What is told by its name, and a form, is no aside if an article or main element begins
within it, or if it holds WHOLE of the text of the article that it is in, or of a page without articles.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

#: Quotes count only after an equals sign, as in browsers; possessive, so that no text makes the search go back.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Fixed values of HTML: elements whose content isn't text, elements without content, block elements.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select head title xmp noembed noframes".split())
#: Those of RAW that hold elements: without an end tag of their own they end with the element around them.
HOLDERS = frozenset("noscript template svg math object canvas select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body center div main section table tbody td tr".split())
CLOSES_P = BLOCK - {"html", "body", "button", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot"}
SAME_CLOSES = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "p": ()}
#: Elements and words in class, id or role that mark what isn't the article.
ASIDE_TAGS = frozenset("nav footer aside form menu dialog button fieldset search".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies consent disclaimer disqus footer "
    "form gdpr header masthead menu modal nav navbar navigation navigation newsletter notice notices popup promo promotion related respond search share sharing sidebar "
    "signup social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Words that may stand beside them in a compound name: where, what shape, whose.
PLACE_WORDS = frozenset(
    "area bar block body bottom box btn button buttons col column container content fixed floating footer global head header inline inner item items left link links list "
    "local main mobile outer page panel post primary reader readers right row secondary section site sticky sub top user wrap wrapper zone".split()
)
#: Elements that may stand around a whole page.
AROUND = frozenset(["form", "fieldset"])
#: The part of the text that is no aside, whatever its name.
WHOLE = 0.9


def _aside_name(name: str) -> bool:
    if name in ASIDE_WORDS:
        return True
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
    return any(w in ASIDE_WORDS for w in words) and all(w in ASIDE_WORDS or w in PLACE_WORDS for w in words)


def blocks(page: str) -> list[tuple[tuple[str, ...], bool, str, int]]:
    """(path, aside?, text, characters within links) of each piece of text between block borders. White space
    in the text is one space, its ends are trimmed; empty pieces are left out. ``path`` names the open block
    elements with their classes and ids; ``aside`` tells whether one of them isn't part of an article."""
    holders: set[int] = set()
    found = list(_pieces(page, holders))
    # Characters of each article and of the page (0), and of each named element, in what no element's kind makes an aside.
    article: dict[int, int] = {}
    named: dict[int, int] = {}
    for _, hard, text, _, within, doubtful in found:
        if not hard:
            article[within] = article.get(within, 0) + len(text)
            for e, _ in doubtful:
                named[e] = named.get(e, 0) + len(text)
    several = any(x > 0 for x in article)
    keeps = lambda e, within: e in holders or ((within > 0 or not several) and named.get(e, 0) >= WHOLE * article.get(within, 1))
    return [(path, hard or any(not keeps(e, a) for e, a in doubtful), text, linked) for path, hard, text, linked, _, doubtful in found]


def _pieces(page: str, holders: set[int]) -> Iterator[tuple[tuple[str, ...], bool, str, int, int, tuple[tuple[int, int], ...]]]:
    """(path, aside by kind?, text, characters within links, article, open elements with an aside's name and the article of each) of each
    piece; articles and such elements are numbered. Those in which an article begins are added to ``holders``."""
    stack: list[tuple[str, str, bool, int, tuple]] = []  # tag, name in the path, aside by its kind, article, named elements
    number = 0
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0
    path: tuple[str, ...] = ()

    def flush():
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        out = (path, bool(stack) and stack[-1][2], text, min(linked, len(text)), stack[-1][3] if stack else 0, stack[-1][4] if stack else ()) if text else None
        parts, linked = [], 0
        return out

    def close(depth: int) -> None:
        nonlocal path
        del stack[depth:]
        path = path[:depth]

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            parts.append(page[at:end])
            if in_link:
                linked += end - at
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1]
        if tag in RAW and not closing:
            if tag != "head" and not m[3].rstrip().endswith("/"):
                # Raw content ends at its own end tag; that of an element without one is the rest of the page.
                done = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = done.end() if done else at if tag in HOLDERS else n
            continue
        if tag == "a":
            in_link = max(0, in_link + (-1 if closing else 1))
        if tag == "br" or tag == "hr":
            if got := flush():
                yield got
        if tag not in BLOCK:
            continue
        if got := flush():
            yield got
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            in_link = 0
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in CONTAINERS:
                    break
        if tag in SAME_CLOSES and tag != "p":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag or (tag, stack[i][0]) in (("dd", "dt"), ("dt", "dd"), ("td", "th"), ("th", "td")):
                    close(i)
                    break
                if stack[i][0] in SAME_CLOSES[tag]:
                    break
        if tag in ("html", "body") and any(s[0] == tag for s in stack):
            continue
        names = [(k.lower(), a or b or c) for k, a, b, c in _NAMES.findall(m[3])] if m[3] else []
        hard, article, doubtful = stack[-1][2:] if stack else (False, 0, ())
        hard = hard or (tag in ASIDE_TAGS and tag not in AROUND) or (tag == "header" and not article) or bool(m[3] and _HIDDEN.search(m[3]))
        number += 1
        if tag in ("article", "main"):
            if not hard:
                holders.update(e for e, _ in doubtful)
            article = article or number
        elif tag in AROUND or (tag not in ("html", "body") and any(_aside_name(x) for _, v in names for x in v.split())):
            doubtful = (*doubtful, (number, article))
        label = tag + "".join("." + re.sub(r"[0-9]+", "0", "_".join(v.split())) for k, v in names if k != "role")
        stack.append((tag, label, hard, article, doubtful))
        path = (*path, label)
        if m[3].rstrip().endswith("/"):
            pass  # as browsers do, a slash in a block element's tag changes nothing
    if got := flush():
        yield got
