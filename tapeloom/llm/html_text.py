"""Main text of web pages by tree scoring.

A page becomes a light element tree. Parts that are never article text go first: scripts, forms, menus, page
headers and footers, sidebars, adverts, notices and reader comments, by element, role or name. In what is left
every paragraph earns points for its length and its commas and passes them to its ancestors, less with each
level; a container's points are discounted by the share of its text that is link text. The best container is
kept with those of its siblings that also read like article text.

A name counts by whole class tokens, and a form or an element with a layout name stays when it holds most of the
page's paragraph text (that of article and main elements, if there are any); then only a form's controls go.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import prepare

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROP = set(
    "script style noscript template head title nav aside footer form iframe svg math button select textarea "
    "object canvas dialog menu audio video map applet".split()
)
BLOCK = set(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul aside caption form".split()
)
#: an element that starts closes these, when open inside the same container
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"},
}
SCOPE = set("article aside blockquote body div footer form header html main nav ol section table td th ul".split())
ENDS_LIST = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}}
NEVER_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
NEVER_NAME = set(
    "ad ads advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs byline-share comment comments "
    "commentlist consent cookie cookies disclaimer disqus footer gdpr header hidden login masthead menu modal nav navbar "
    "navigation newsletter notice notices overlay pager pagination paywall popup promo promoted promotion recommended related "
    "replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
GOOD_NAME = set("article body content entry main page post story text".split())
POINTS_AT = {"p", "pre", "td", "blockquote", "li", "dd", "div", "section", "article", "main", "body", "figcaption"}
LEAST_CHARS = 25
NAME = re.compile(r"[a-z0-9]+")
#: parts that say no more than where or how an element is laid out
NEUTRAL = set("area bar block bottom box container global inner item left link links list outer primary right row secondary section site slot top wrap wrapper".split())
#: of NEVER_NAME: also carried by elements around a whole page
LAYOUT = set("banner footer header masthead menu modal nav navbar navigation notice overlay search sidebar skip toolbar widget".split())
REFERENCE_NAME = set("bibliography citation citations endnotes footnote footnotes literature notes reference references reflist sources".split())
MENU_NAME = NEVER_NAME | {"toc", "contents"}
MENU_HEADING = re.compile(r"\b(related|more|also|read|menu|share|navigation|contents|popular|latest)\b")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


WHOLE = ("html", "body", "article", "main")


class Tree(HTMLParser):
    """Elements in page order: tag, parent, dropped, names; ``items`` holds texts and children."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.dropped, self.names, self.items = ["html"], [-1], [False], [set()], [[]]
        self.spared = {}  # elements that go unless they hold the page's text
        self.stack = [0]

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and any(self.tag[i] == tag for i in self.stack):
            return
        if tag in BLOCK:
            self._close_open({"p"}, SCOPE)
        if tag in CLOSES:
            self._close_open(CLOSES[tag], ENDS_LIST.get(tag, set()))
        at, up = len(self.tag), self.stack[-1]
        attrs = {k: (v or "").lower() for k, v in attrs}
        inside = any(self.tag[i] in ("article", "main") for i in self.stack)
        self.tag.append(tag)
        self.parent.append(up)
        self.names.append(set(NAME.findall(attrs.get("class", "") + " " + attrs.get("id", ""))))
        tokens = (attrs.get("class", "") + " " + attrs.get("id", "")).split()
        never = {t for t in tokens if self._marked(t)}
        self.dropped.append(self.dropped[up] or self._never(tag, attrs, never, inside))
        if not self.dropped[at] and (tag == "form" or attrs.get("role") == "form" or (tag not in WHOLE and never)):
            self.spared[at] = True
        self.items.append([])
        self.items[up].append(at)
        if tag not in VOID:
            self.stack.append(at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    @staticmethod
    def _never(tag, attrs, names, inside) -> bool:
        role = attrs.get("role")
        if (tag in DROP and tag != "form") or (tag == "header" and not inside) or (role in NEVER_ROLE and role != "form"):
            return True
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
            return True
        return tag not in WHOLE and any(not LAYOUT & set(NAME.findall(t)) or set(NAME.findall(t)) & NEVER_NAME - LAYOUT for t in names)

    @staticmethod
    def _marked(token) -> bool:
        parts = set(NAME.findall(token))
        return bool(parts & NEVER_NAME) and all(x in NEVER_NAME or x in NEUTRAL or x.isdigit() for x in parts)

    def settle(self) -> None:
        """Drop forms and elements with layout names that don't hold most of the page's paragraph text."""
        if not self.spared:
            return
        n = len(self.tag)
        text, inside = [0] * n, [False] * n
        for at in range(1, n):
            inside[at] = inside[self.parent[at]] or self.tag[at] in ("article", "main")
        linked = [False] * n
        for at in range(1, n):
            linked[at] = linked[self.parent[at]] or self.tag[at] == "a"
        for at in range(n):
            if not self.dropped[at] and not linked[at]:
                text[at] = sum(len("".join(x.split())) for x in self.items[at] if isinstance(x, str))
        if any(t for t, i in zip(text, inside, strict=True) if i):
            text = [t if i else 0 for t, i in zip(text, inside, strict=True)]
        total = sum(text)
        for at in range(n - 1, 0, -1):
            text[self.parent[at]] += text[at]
        gone = {at for at in self.spared if 2 * text[at] <= total}
        kept = self.spared.keys() - gone
        form = [False] * n
        for at in range(1, n):
            form[at] = form[self.parent[at]] or at in kept and self.tag[at] == "form"
            self.dropped[at] = self.dropped[at] or self.dropped[self.parent[at]] or at in gone or (form[at] and self.tag[at] in ("label", "legend"))

    def _close_open(self, tags, borders):
        for k in range(len(self.stack) - 1, 0, -1):
            t = self.tag[self.stack[k]]
            if t in tags:
                del self.stack[k:]
                return
            if t in borders:
                return

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            t = self.tag[self.stack[k]]
            if t == tag:
                del self.stack[k:]
                return
            if tag not in BLOCK and t in BLOCK and tag not in DROP:
                return
        if tag == "br":
            self.handle_starttag("br", [])

    def handle_data(self, data):
        self.items[self.stack[-1]].append(data)


def main_text(html: str | None) -> str:
    """The article of one page: blocks in page order, joined by one space; empty if there is none."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    tree.settle()
    n = len(tree.tag)
    chars, linked, commas, links, points = [0] * n, [0] * n, [0] * n, [0] * n, [0.0] * n
    own_chars = [0] * n
    for at in range(n - 1, -1, -1):
        if tree.dropped[at]:
            continue
        for item in tree.items[at]:
            if isinstance(item, str):
                size = len("".join(item.split()))
                own_chars[at] += size
                chars[at] += size
                commas[at] += item.count(",") + item.count("،") + item.count("、") + item.count("，")
        if tree.tag[at] == "a":
            linked[at], links[at] = chars[at], links[at] + 1
        if (up := tree.parent[at]) >= 0:
            chars[up] += chars[at]
            linked[up] += linked[at]
            links[up] += links[at]
            if tree.tag[at] not in BLOCK:
                own_chars[up] += own_chars[at]
                commas[up] += commas[at]
    for at in range(n):
        if tree.dropped[at] or tree.tag[at] not in POINTS_AT or own_chars[at] < LEAST_CHARS:
            continue
        gain = 1 + commas[at] + min(own_chars[at] / 100, 3)
        # text right inside a container is its own paragraph
        up, level = (tree.parent[at] if tree.tag[at] in ("p", "pre", "td", "blockquote", "li", "dd", "figcaption") else at), 0
        while up >= 0 and level < 5:
            points[up] += gain / (1 if level == 0 else 2 * level if level < 2 else 3 * level)
            up, level = tree.parent[up], level + 1
    density = lambda at: linked[at] / chars[at] if chars[at] else 0.0
    for at in range(n):
        if points[at]:
            points[at] += 25 * (tree.tag[at] == "article") + 10 * (tree.tag[at] == "main") + 5 * bool(tree.names[at] & GOOD_NAME)
            points[at] *= 1 - density(at)
    best = max(range(n), key=lambda at: (points[at], at)) if n else 0
    if not points[best]:
        # no paragraph is long enough: an article element, or what is left of the page
        named = [at for at in range(n) if tree.tag[at] in ("article", "main") and not tree.dropped[at]]
        best = named[0] if named else 0
    up = best
    while up > 0:
        if tree.tag[up] == "article":
            best = up
            break
        up = tree.parent[up]
    kept = [best]
    if (up := tree.parent[best]) >= 0 and points[best]:
        kept = []
        for item in tree.items[up]:
            if isinstance(item, str) or tree.dropped[item]:
                continue
            likely = points[item] >= 0.2 * points[best] and tree.tag[item] in POINTS_AT
            prose = tree.tag[item] == "p" and density(item) < 0.25 and (chars[item] > 80 or (chars[item] and density(item) == 0))
            title = tree.tag[item] in ("h1", "h2") and item < best and density(item) < 0.5
            if item == best or likely or prose or title:
                kept.append(item)
    holds = [False] * n
    for at in range(n - 1, 0, -1):  # lists of links inside the article: references stay, menus and related links go
        if not tree.dropped[at]:
            if tree.tag[at] in ("ul", "ol", "div", "section", "table", "dl") and links[at] >= 3 and density(at) > 0.6 and at not in kept and not holds[at]:
                tree.dropped[at] = not _references(tree, at, chars[at] / links[at])
                holds[at] = not tree.dropped[at]
            holds[tree.parent[at]] = holds[tree.parent[at]] or holds[at]
    blocks: list[str] = []
    part: list[str] = []

    def flush():
        text = " ".join("".join(part).split())
        part.clear()
        if text:
            blocks.append(text)

    for top in kept:
        todo: list = [top]
        while todo:
            item = todo.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                part.append(item)
            elif not tree.dropped[item]:
                if tree.tag[item] == "br":
                    part.append(" ")
                block = tree.tag[item] in BLOCK
                if block:
                    flush()
                    todo.append(None)
                todo += reversed(tree.items[item])
        flush()
    return " ".join(blocks)


def _references(tree: Tree, at: int, chars: float) -> bool:
    """Whether a list of links is part of the article: by name, by number, by heading, or by entries as long as prose."""
    if tree.names[at] & MENU_NAME:
        return False
    if tree.names[at] & REFERENCE_NAME:
        return True
    before = None
    for item in tree.items[tree.parent[at]]:
        if item == at:
            break
        if not isinstance(item, str) and not tree.dropped[item]:
            before = item
    inner = next((i for i in tree.items[at] if not isinstance(i, str)), None)
    for i in (inner, before):
        if i is not None and tree.tag[i] in HEADINGS:
            return not MENU_HEADING.search(_words(tree, i).lower())
    return tree.tag[at] == "ol" or chars >= LEAST_CHARS


def _words(tree: Tree, at: int) -> str:
    todo, out = [at], []
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        else:
            todo += reversed(tree.items[item])
    return "".join(out)


def _extract(batches):
    for batch in batches:
        texts = [main_text(h) for h in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=[*batch.schema.names[1:], "text", "n_chars"],
        )


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null or empty html and pages without an article give an empty text. Repeated rows and null ids get a row
    each; only the three named columns are read, so others can't clash. An empty table gives an empty result.
    """
    prepare(pages.sparkSession)
    slim = pages.select(F.col(html_col).cast("string").alias("html"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return slim.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
