"""Main text of web pages by line-block distribution (operator 2).

Markup is stripped to lines, one per block element. What stands in menus, forms,
scripts and the like, by tag, role or a name that says nothing else, is left out; text in links weighs nothing.
On every page the weights of ``BLOCK`` consecutive lines are summed; where the sum surges over
a threshold the main text begins, where it dives to nothing it ends, and lines
between are kept whole. Where a page marks its article and the marked lines surge, the mark is evidence that enters the
weights before they are summed: lines outside weigh nothing, lines inside at least one, and no block reaches over a
mark's border. So every marked part that surges is kept whole, and marks on parts that never surge count for nothing if
other text does.

Defined results: null and empty pages have an empty text; unclosed elements end where a
new main part begins, or with the page, an unclosed comment with the page; a page without any block over the
threshold keeps its heaviest run of lines, marked ones first; repeated rows get equal results; an
empty table gives an empty result. Time is in proportion to the page's length.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import read, small_batches

BLOCK, SURGE = 3, 80

NAME = re.compile(r"[^\s/>]+")
ATTR = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(\s*+=\s*+)?+")
BARE = re.compile(r"[^\s>]*+")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
          "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
          "wbr", "ruby", "rt", "rp"}
SIDE = {"head", "nav", "aside", "footer", "form", "menu", "dialog", "button", "select", "fieldset", "object", "audio",
        "video", "canvas", "map", "applet"}
SIDE_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu",
             "menubar", "toolbar", "status"}
SIDE_WORD = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "promo", "promotion", "sponsor", "sponsored",
             "cookie", "cookies", "consent", "gdpr", "notice", "notification", "popup", "modal", "overlay", "newsletter", "subscribe",
             "subscription", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer",
             "masthead", "topbar", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "share", "sharing",
             "social", "related", "recommended", "recommendations", "login", "signup", "search", "pagination", "pager", "toolbar",
             "copyright", "disclaimer"}
# words that may stand beside those of SIDE_WORD without saying anything else
PLAIN_WORD = {"box", "bar", "block", "container", "wrapper", "wrap", "area", "list", "item", "items", "panel", "slot", "module", "widget", "section",
              "inner", "outer", "top", "bottom", "left", "right", "main", "primary", "secondary", "site", "page", "global", "user", "reader", "readers",
              "posts", "articles", "stories", "links", "thread", "form", "field", "button", "buttons", "header", "body", "text", "content", "row", "col", "js"}
SIDE_PAIR = {("user", "reviews"), ("reader", "reviews"), ("customer", "reviews"), ("side", "bar"), ("site", "header"), ("page", "header"), ("top", "bar"), ("site", "footer"), ("pop", "up"), ("bread", "crumb")}
MAIN = {"article", "main"}
MAIN_WORD = {("article", "body"), ("post", "content"), ("entry", "content"), ("article", "content"), ("post", "body")}
TEASER = {"teaser", "teasers", "card", "preview"}
HEADER_OF_PAGE = {"header", "hgroup"}
# elements that hold a piece of text: only a name made of side words alone puts them aside
PIECE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "td", "th", "blockquote", "pre", "figcaption", "caption", "tr"} | INLINE
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _names(attrs: dict[str, str]) -> list[list[str]]:
    return [[w.lower() for w in WORDS.findall(x)] for k in ("class", "id", "itemprop") if k in attrs for x in attrs[k].split()]


def _aside(tag: str, words: list[str]) -> bool:
    """Does the whole name say that this stands beside the text?"""
    if not words or not any(w in SIDE_WORD for w in words):
        return any(p in SIDE_PAIR for p in zip(words, words[1:])) and tag not in PIECE
    # letters alone are prefixes of naming schemes
    return all(w in SIDE_WORD or (w in PLAIN_WORD or len(w) == 1) and tag not in PIECE for w in words)


def kind(tag: str, attrs: dict[str, str], in_main: bool) -> str:
    """'side', 'main' or ''."""
    if tag in SIDE or tag in HEADER_OF_PAGE and not in_main:
        return "side"
    if not attrs:
        return "main" if tag in MAIN else ""
    role = attrs.get("role", "").lower()
    if role in SIDE_ROLE or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" \
            or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return "side"
    names = _names(attrs)
    aside = any(_aside(tag, n) for n in names)
    if tag in MAIN or role in ("main", "article") or any(p in MAIN_WORD for n in names for p in zip(n, n[1:])):
        return "side" if aside or any(n and set(n) <= TEASER for n in names) else "main"
    return "side" if tag not in ("body", "html") and (aside or not in_main and ["header"] in names) else ""


class Page:
    """A page's tokens, in one pass: ('text', raw), ('open', tag, attrs, closed itself) or ('close', tag)."""

    def __init__(self, page: str):
        self.page, self.end = page, len(page)
        self.last = {q: page.rfind(q) for q in ("\"", "'")}  # beyond these no quote closes

    def tokens(self):
        page, at = self.page, 0
        text = 0  # where the text not yet told begins
        while (p := page.find("<", at)) >= 0:
            c = page[p + 1:p + 2]
            if not (c.isascii() and c.isalpha() or c in ("/", "!", "?") and c):
                at = p + 1
                continue
            if p > text:
                yield "text", page[text:p]
            if page.startswith("<!--", p):
                at = self.after("-->", p + 4)
            elif page.startswith("<![CDATA[", p):
                at = self.after("]]>", p + 9)
            elif c in "!?":
                at = self.after(">", p + 2)
            else:
                at = yield from self.tag(p, c == "/")
            text = at
        if text < self.end:
            yield "text", page[text:]

    def after(self, mark: str, at: int) -> int:
        p = self.page.find(mark, at)
        return self.end if p < 0 else p + len(mark)

    def tag(self, p: int, closes: bool):
        page, at = self.page, p + 1 + closes
        m = NAME.match(page, at)
        if closes and (not m or not m[0][0].isalpha()):
            return self.after(">", at)
        tag, at, attrs = m[0].lower(), m.end(), {}
        while m := ATTR.match(page, at):
            name, at, value = m[1].lower(), m.end(), ""
            if m[2]:
                q = page[at:at + 1]
                if q in self.last and q and at < self.last[q]:
                    stop = page.find(q, at + 1)
                    value, at = page[at + 1:stop], stop + 1
                else:
                    v = BARE.match(page, at)
                    value, at = v[0], v.end()
            attrs.setdefault(name, _html.unescape(value))
        stop = page.find(">", at)
        if stop < 0:
            return self.end
        if closes:
            yield "close", tag
            return stop + 1
        alone = page[stop - 1] == "/"
        yield "open", tag, attrs, alone
        if tag in RAW and not alone:
            shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, stop + 1)
            return self.after(">", shut.end()) if shut else self.end
        return stop + 1


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, weight, part) of every block: the text outside of side elements, its length
    without links, and the number of the outermost main element, or 0."""
    out, parts, weight = [], [], 0
    side, depth = "", 0  # the side element that we are in, and how many of its name are open
    main, main_depth, number, link = "", 0, 0, 0

    def close():
        nonlocal parts, weight
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, weight, number if main else 0))
        parts, weight = [], 0

    for token in Page(page).tokens():
        if token[0] == "text":
            if not side:
                text = _html.unescape(token[1])
                parts.append(text)
                if not link:
                    weight += len("".join(text.split()))
            continue
        opens, tag = token[0] == "open", token[1]
        if tag in RAW:
            continue
        if side:
            if opens and tag in MAIN and kind(tag, token[2], False) == "main":
                side = ""  # a side element that was never closed
            elif tag == side:
                depth += 1 if opens else -1
                side = side if depth else ""
                continue
            elif not opens and tag in ("body", "html"):
                side = ""
                continue
            else:
                continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE and tag not in VOID or tag == "hr":
            close()
        if tag == "a":
            link = 1 if opens else 0
            continue
        if tag in VOID:
            continue
        if not opens:
            if main and tag == main:
                main_depth -= 1
                main = main if main_depth else ""
            continue
        what = kind(tag, token[2], bool(main))
        if what == "side" and not token[3]:
            close()
            side, depth, link = tag, 1, 0
        elif main and tag == main:
            main_depth += 1
        elif what == "main" and not main:
            main, main_depth, number, link = tag, 1, number + 1, 0
    close()
    return out


def block_sums(weights: list[int], block: int = BLOCK) -> list[int]:
    return [sum(weights[i:i + block]) for i in range(len(weights))]


def surges(weights: list[int], surge: int = SURGE, block: int = BLOCK) -> list[tuple[int, int]]:
    """Runs [start, stop) of lines between surge and dive."""
    n, sums = len(weights), block_sums(weights, block)
    runs, i = [], 0
    while i < n:
        if sums[i] < surge:
            i += 1
            continue
        start = i
        while not weights[start]:
            start += 1  # the sum surges before the text does
        while start and weights[start - 1]:
            start -= 1  # a heading above the first long line
        stop = i
        while stop < n and sums[stop]:
            stop += 1  # dive
        runs.append((start, stop))
        i = max(stop, i + 1)
    return runs


def heaviest(weights: list[int]) -> list[tuple[int, int]]:
    """The run of lines with weight that has the most of it, if there is any."""
    runs, i = [], 0
    while i < len(weights):
        j = i
        while j < len(weights) and weights[j]:
            j += 1
        if j > i:
            runs.append((i, j))
        i = max(j, i + 1)
    return [max(runs, key=lambda r: sum(weights[r[0]:r[1]]))] if runs else []


def sections(lines: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """(part, start, stop) of consecutive lines with one mark; the lines of a marked part in one piece."""
    out = []
    for i, (_, _, part) in enumerate(lines):
        if out and out[-1][0] == part:
            out[-1] = (part, out[-1][1], i + 1)
        else:
            out.append((part, i, i + 1))
    return out


def chosen(lines: list[tuple[str, int, int]]) -> tuple[list[tuple[int, int]], str]:
    """Runs of the lines that are main text, and what decided: 'marked' or 'unmarked' surges, 'heaviest' or 'none'."""
    weights = [w for _, w, _ in lines]
    marked = [(a, z) for part, a, z in sections(lines) if part]
    up = [(a, z) for a, z in marked if max(block_sums(weights[a:z])) >= SURGE]
    # the evidence of the marks: lines inside weigh something, so no dive there; lines outside nothing
    if up:
        return [(a + s, a + e) for a, z in up for s, e in surges([max(w, 1) for w in weights[a:z]])], "marked"
    if runs := surges(weights):
        return runs, "unmarked"
    best = heaviest([w if part else 0 for _, w, part in lines]) or heaviest(weights)
    for a, z in marked:
        if best and a <= best[0][0] < z:
            best = [(a, z)]
    return best, "heaviest" if best else "none"


def main_text(page: str | None) -> tuple[str, str]:
    """The text, and what decided on it."""
    lines = lines_of(page or "")
    runs, how = chosen(lines)
    return "\n".join(lines[i][0] for a, z in runs for i in range(a, z)), how


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with the column html replaced by ``text``, ``n_chars`` and ``decided_by``."""
    small_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars", "decided_by")]
    df = pages.select(*keep, html_col)

    def run(batches):
        for b in batches:
            found = [main_text(x) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(keep)], pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()),
                 pa.array([how for _, how in found], pa.string())], [*keep, "text", "n_chars", "decided_by"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInArrow(run, f"{kinds}, text string, n_chars long, decided_by string")


def op2_html_text(spark, sf_dir) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op2_html_text": op2_html_text}
ORACLE_SQL = {}
