"""Main text of web pages by tree scoring.

A page is read once into nodes (numbered in page order, so a subtree is a range
of numbers) and text blocks.  Every block passes points to its ancestors: one,
one per comma, one per hundred characters up to three, discounted by its link
density.  A node's score is again discounted by the link density of its whole
subtree.  The best container and its worthy siblings are kept, and within them
every block that no menu, notice, form or other furniture holds.
"""

import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearsift.llm.batches import small_batches

VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr "
    "q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
# Furniture by tag, by role and by word of a class or id.
FURNITURE = frozenset(
    "nav footer aside form script style noscript template iframe object svg canvas button select "
    "textarea dialog menu audio video head title xmp noembed noframes".split()
)
FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar "
    "toolbar form".split()
)
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored "
    "sponsors promo promos promotion sidebar sidebars nav navbar navigation menu menus breadcrumb "
    "breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social comment comments "
    "discussion discussions responses reviews feedback cta disqus replies respond related recommended recommendations pagination pager toolbar widget "
    "widgets hidden".split()
)
# Words of a class, and the element, that tell who wrote a comment and when.
SIGNED_WORDS = frozenset("author user username commenter avatar byline posted date datetime".split())
ARTICLE_WORDS = frozenset("ad ads advert sponsored promo comment comments reply related".split())
NEUTRAL_WORDS = frozenset("has no with without free layout".split())
GOOD_WORDS = frozenset("content article post entry story main".split())
CONTAINERS = frozenset(
    "html body main article section div blockquote center figure details fieldset".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag of the key ends an open element of the value, up to its scope.
ENDS = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*").match
_ATTRIBUTE = re.compile(
    r"""(class|id|role|hidden|style|aria-hidden)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""",
    re.I,
).findall
_OPENS = re.compile("[a-zA-Z/!?]").match
_STOP = re.compile("[\"'>]").search
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])").findall


def tags_and_texts(page: str):
    """``(text, None, None)`` and ``(None, tag, attributes)`` in page order; an
    end tag has a leading slash.  Linear also on broken pages."""
    at, size, missing = 0, len(page), set()
    while at < size:
        start = page.find("<", at)
        while start >= 0 and not _OPENS(page, start + 1):
            start = page.find("<", start + 1)
        if start < 0:
            yield page[at:], None, None
            return
        if start > at:
            yield page[at:start], None, None
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            if stop < 0:
                return
            at = stop + 3
            continue
        name = _NAME(page, start + 2 if page[start + 1] == "/" else start + 1)
        scan = name.end() if name else start + 1
        body = scan
        while True:  # to the closing bracket, over quoted values
            stop = _STOP(page, scan)
            if not stop:
                return
            mark = stop.group()
            if mark == ">" or not name or mark in missing:
                if mark == ">":
                    break
                scan = stop.end()
                continue
            quotes = page[stop.start() - 1] == "="
            close = page.find(mark, stop.end()) if quotes else -1
            if close < 0:
                if quotes:
                    missing.add(mark)
                scan = stop.end()
            else:
                scan = close + 1
        at = stop.end()
        if not name:
            continue
        tag = name.group().lower()
        if page[start + 1] == "/":
            yield None, "/" + tag, ""
            continue
        yield None, tag, page[body : stop.start()]
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            if not end:
                return
            at = end.start()


def _furniture(tag: str, attributes: str, in_article: bool) -> int:
    """0: keep; 1: drop; 2: a head of an article, of which headings are kept."""
    if tag in FURNITURE:
        return 1
    if tag == "header":
        return 2 if in_article else 1
    if not attributes or tag in ("html", "body", "main"):
        return 0
    found = {k.lower(): entities.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return 1
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return 1
    if found.get("role", "").lower() in FURNITURE_ROLES:
        return 1
    names = [
        {w.lower() for w in _WORDS(n)}
        for n in [*found.get("class", "").split(), *found.get("id", "").split()]
    ]
    words = ARTICLE_WORDS if tag == "article" else FURNITURE_WORDS
    bad = [n for n in names if n & words and not n & NEUTRAL_WORDS]
    if bad and not any(n & GOOD_WORDS and not n & words for n in names):
        return 1
    if any("header" in n for n in names) and tag not in HEADINGS:
        return 2 if in_article else 1
    return 0


def main_text(page: str | None) -> str:
    """The main text of one page: blocks joined by an empty line."""
    if not page:
        return ""
    tags, parent, last, drop = ["#"], [-1], [0], [False]
    shapes, signed = [None], [False]
    stack, open_tags = [0], {}
    blocks = []  # node, text, characters in links
    buffer, link_chars = [], 0

    def flush():
        nonlocal buffer, link_chars
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                owner = stack[-1]
                while tags[owner] in INLINE:
                    owner = parent[owner]
                blocks.append((owner, text, min(link_chars, len(text))))
        buffer, link_chars = [], 0

    def pop():
        node = stack[-1]
        if tags[node] not in INLINE:
            flush()
        stack.pop()
        last[node] = len(tags)
        open_tags[tags[node]] -= 1

    def close(names, scope):
        """End the innermost open element of these names inside the scope."""
        if not any(open_tags.get(n) for n in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = tags[stack[depth]]
            if tag in names:
                while len(stack) > depth:
                    pop()
                return
            if tag in scope:
                return

    head_nodes = []  # heads of articles; only headings inside them count
    for text, tag, attributes in tags_and_texts(page):
        if tag is None:
            node = stack[-1]
            if not drop[node]:
                buffer.append(text)
                if open_tags.get("a"):
                    link_chars += len(text.strip())
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if tag == "br" or tag in VOID:
                buffer.append(" ")
            elif tag in INLINE:
                close((tag,), ("p", "div", "td", "th", "li", "article", "section", "body", "table"))
            elif tag == "p":
                close(("p",), ("div", "td", "article", "section", "body"))
            elif tag in ("html", "body", "article", "main", "table"):
                close((tag,), ())
            elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot"):
                close((tag,), ("table",))
            else:
                close((tag,), ("td", "th", "table"))
            continue
        if tag in VOID:
            if tag == "hr":
                close(("p",), ("div", "td", "article", "section", "body"))
                flush()
            elif not drop[stack[-1]]:
                buffer.append(" " if tag == "br" else "")
            continue
        if tag == "body":  # ends an unclosed head; a second body is ignored
            close(("head",), ())
            if open_tags.get("body"):
                continue
        if tag in ENDS:
            close(*ENDS[tag])
        if tag not in INLINE:
            close(("p",), ("div", "td", "th", "article", "section", "body", "li", "button"))
            flush()
        elif tag == "a":
            close(("a",), ("p", "div", "td", "li", "article", "section", "body"))
        over = stack[-1]
        gone = drop[over]
        if not gone:
            kind = _furniture(tag, attributes, bool(open_tags.get("article")))
            gone = kind == 1
            if kind == 2:
                head_nodes.append(len(tags))
        node = len(tags)
        tags.append(tag)
        parent.append(over)
        last.append(0)
        drop.append(gone)
        shape, sign = _shape(tag, attributes)
        shapes.append(shape)
        signed.append(sign)
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    while len(stack) > 1:
        pop()
    flush()
    last[0] = len(tags)
    if head_nodes:
        blocks = [
            b
            for b in blocks
            if tags[b[0]] in HEADINGS or not any(h <= b[0] < last[h] for h in head_nodes)
        ]
    if not blocks:
        return ""
    keep = _kept_ranges(tags, parent, last, blocks)
    blocks = [(n, t) for n, t, _ in blocks if any(a <= n < b for a, b in keep)]
    gone = _in_comments(parent, last, shapes, signed, blocks)
    return "\n\n".join(t for n, t in blocks if not gone[n])


def _shape(tag: str, attributes: str):
    """What repeated elements have in common, and whether this one signs a text."""
    if tag == "time":
        return None, True
    if not attributes:
        return None, False
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE(attributes)}
    names = found.get("class", "")
    sign = not SIGNED_WORDS.isdisjoint(w.lower() for w in _WORDS(names))
    return ((tag, names) if names and tag in ("div", "li", "article", "section") else None), sign


def _in_comments(parent, last, shapes, signed, blocks):
    """Which nodes lie in reader comments without a telling name: two or more
    siblings of one tag and class, each with a time or author element, behind
    more text than any of them has."""
    many = len(parent)
    chars, signs, runs = [0] * (many + 1), [0] * (many + 1), {}
    for node, text in blocks:
        chars[node + 1] += len(text)
    for node in range(many):
        chars[node + 1] += chars[node]
        signs[node + 1] = signs[node] + signed[node]
    for node, shape in enumerate(shapes):
        if shape is not None and signs[last[node]] > signs[node + 1]:
            runs.setdefault((parent[node], shape), []).append(node)
    change = [0] * (many + 1)
    for nodes in runs.values():
        longest = max(chars[last[node]] - chars[node] for node in nodes)
        if len(nodes) > 1 and chars[nodes[0]] > longest > 0:
            for node in nodes:
                change[node] += 1
                change[last[node]] -= 1
    gone, depth = [False] * many, 0
    for node in range(many):
        depth += change[node]
        gone[node] = depth > 0
    return gone


def _kept_ranges(tags, parent, last, blocks):
    """Node ranges of the best container and of the siblings kept with it."""
    many = len(tags)
    score, chars, linked = [0.0] * many, [0] * many, [0] * many
    for node, text, links in blocks:
        chars[node] += len(text)
        linked[node] += links
        if tags[node] in HEADINGS:
            continue
        points = 1 + text.count(",") + min(len(text) // 100, 3)
        points *= 1 - links / len(text)
        over = node if tags[node] in CONTAINERS or node == 0 else parent[node]
        for share in (1, 2, 6, 9, 12):
            if over < 0:
                break
            score[over] += points / share
            over = parent[over]
    for node in range(many - 1, 0, -1):
        chars[parent[node]] += chars[node]
        linked[parent[node]] += linked[node]

    def worth(node):
        return score[node] * (1 - linked[node] / chars[node]) if chars[node] else 0.0

    best = max(range(many), key=lambda n: (worth(n), n))
    if worth(best) <= 0:  # headings only
        best = 0
    # An article element around the best container, or one that holds all of
    # its text, is the container meant.
    top, over = best, best
    while over > 0:
        if tags[over] in ("article", "main"):
            top = over
            if tags[over] == "article":
                break
        over = parent[over]
    if top == best and tags[best] not in ("article", "main"):
        inner = [n for n in range(best, last[best]) if tags[n] in ("article", "main") and chars[n]]
        if inner:
            top = max(inner, key=lambda n: (worth(n), -n))
    enough = 0.2 * worth(top)
    keep, over = [], parent[top]
    if over >= 0:
        links = {}
        for node in range(over + 1, last[over]):
            if parent[node] == over and chars[node]:
                links[node] = linked[node] / chars[node]
        for node, density in links.items():
            if node == top:
                keep.append((node, last[node]))
            elif tags[top] == tags[node] == "article" or (
                tags[top] != "article" and worth(node) >= enough > 0
            ):
                keep.append((node, last[node]))
            elif tags[top] != "article" and tags[node] == "p" and density < 0.25 and chars[node] > 80:
                keep.append((node, last[node]))
            elif tags[top] not in ("article", "main") and tags[node] == "h1" and node < top:
                keep.append((node, last[node]))
    return keep or [(top, last[top])]


def extract(
    pages: DataFrame, html_col: str = "html", text_col: str = "text"
) -> DataFrame:
    """``pages`` with the main text of ``html_col`` as ``text_col``.

    Null and empty pages have an empty text, as have pages of furniture only;
    broken and cut-off markup is read as far as it goes.  All other columns are
    kept (one named like ``text_col`` is replaced), repeated rows stay repeated
    and an empty table stays empty.
    """
    @F.pandas_udf(T.StringType())
    def texts(column):
        return column.map(main_text, na_action=None)

    return small_batches(pages).withColumn(text_col, texts(F.col(html_col)))
