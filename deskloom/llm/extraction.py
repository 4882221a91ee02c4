"""Main text of web pages, by templates deduced from the pages of a host.

Tokens of a page are its elements, each with its path and class, and its text
blocks, each with its place. Over the pages of a host, tokens with the same
occurrence vector (how often on which page) form an equivalence class; the
vector is compared by a hash that is combined page by page, so a host of any
size is aggregated like any other and no host is ever gathered in one task. A
class that nearly all pages have, whose tokens come in the same order on each,
is part of the template; its elements nest by their paths, its texts are
boilerplate, and the places in between are slots. The slot with most text that
isn't link text is the main one of the host.

Of a page, blocks of the main slot stay: those in its article or main element
if there is one, else those below the host's main slot, else below the page's
own largest. Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments, known by element, role or class, never stay, nor do texts
of the template, unless they are most of what the page would keep, as on hosts
whose pages repeat one article.

Cases: null and empty pages give an empty text, pages without any markup their
whole text. Unclosed elements end where HTML ends them. Pages without a host are
a host of their own. Repeated pages are extracted each. Further columns are
ignored. Pages are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PAGES = 5  # pages a host needs for a template
SHARE = 0.9  # share of a host's pages that have a template token
SMALL = 32_000_000  # bytes of templates that may be broadcast

# Elements by the role they play in HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
    "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
SLOTS = {"article", "blockquote", "body", "center", "div", "main", "section", "table", "td"}
OUTSIDE = {"aside", "button", "dialog", "footer", "form", "head", "label", "menu", "nav", "option", "search", "select"}
ROLES = {"banner", "navigation", "complementary", "contentinfo", "search", "form", "menu", "dialog", "alert", "alertdialog"}
CLASSES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs",
    "byline-links", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "copyright", "disqus", "footer",
    "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager",
    "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "share",
    "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "topbar",
    "widget",
}
# An element that starts ends these, where they are the innermost block.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
    "tfoot": {"tbody", "tr", "td", "th"},
}

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.DOTALL
)
CLASS = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")  # numbers in an id differ from page to page


@dataclass
class Element:
    name: str
    path: int
    slots: tuple[int, ...]  # paths of the slots that enclose it, outermost first
    outside: bool
    depth: int  # 2 within an article, 1 within a main element, else 0
    link: bool


@dataclass
class Block:
    text: str
    linked: int  # characters of link text
    at: Element
    token: int


def digest(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def marked(name: str, attributes: str, within: bool) -> tuple[bool, str]:
    """Whether an element isn't part of an article, and what distinguishes it in a path."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in CLASS.finditer(attributes)} if attributes.strip() else {}
    label = f"{name}#{DIGITS.sub('', found.get('id', ''))}.{'.'.join(sorted(found.get('class', '').split()))}"
    if name in OUTSIDE or name in RAW or (name == "header" and not within):
        return True, label
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES:
        return True, label
    if name in ("html", "body", "main"):
        return False, label
    hints = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    parts = {part for hint in hints for part in (hint, *WORD.findall(hint))}
    clear = parts & CLASSES or ("header" in hints or "page-header" in hints or "site-header" in hints) and not within
    return bool(clear), label


def parse(html: str) -> tuple[list[Block], list[int]]:
    """Text blocks of a page, and the paths of its elements, both in order."""
    root = Element("", 0, (), False, 0, False)
    stack, blocks, paths = [root], [], []
    pieces: list[str] = []
    linked = 0
    at, end = 0, len(html)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            owner = next(e for e in reversed(stack) if e.name in BLOCKS or not e.name)
            blocks.append(Block(text, min(linked, len(text)), owner, digest(owner.path, text)))
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if any(e.outside and e.name not in BLOCKS for e in stack):
            return
        text = unescape(text)
        pieces.append(text)
        if stack[-1].link:
            linked += len(text)

    while at < end:
        match = TAG.search(html, at)
        add(html[at : match.start() if match else end])
        if not match:
            break
        at = match.end()
        if not match[2]:
            continue
        name, closing = match[2].lower(), match[1]
        if name == "br" or name == "wbr":
            pieces.append(" " if name == "br" else "")
            continue
        block = name in BLOCKS
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    if block or any(e.name in BLOCKS for e in stack[depth:]):
                        flush()
                    del stack[depth:]
                    break
                if not block and stack[depth].name in BLOCKS:
                    break
            continue
        if block:
            flush()
            if name not in ("html", "head", "body"):
                ends = ENDS.get(name, set())
                for depth in range(len(stack) - 1, 0, -1):
                    own = stack[depth].name
                    if own == "p" or own in ends:
                        del stack[depth:]
                        if own == "p":
                            break
                    elif own in BLOCKS:
                        break
            elif name == "body":
                del stack[next((i for i, e in enumerate(stack) if e.name == "head"), len(stack)) :]
        if name in VOID:
            continue
        above = stack[-1]
        outside, label = marked(name, match[3], above.depth > 0)
        path = digest(above.path, label) if block else above.path
        if block:
            paths.append(path)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(html, at)
            at = close.end() if close else end
            continue
        slots = (*above.slots, path) if name in SLOTS else above.slots
        depth = max(above.depth, {"article": 2, "main": 1}.get(name, 0))
        stack.append(Element(name, path, slots, above.outside or outside, depth, above.link or name == "a"))
    flush()
    return blocks, paths


TOKENS = "host string, token long, kind int, page long, n int, before long, chars long"
ELEMENT, TEXT, SLOT, PAGE = 0, 1, 2, 3


def tokens(pages: DataFrame) -> DataFrame:
    """Tokens of every page with their number, and the element they follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            hosts, keys = batch.column("host").to_pylist(), batch.column("key").to_pylist()
            for host, key, html in zip(hosts, keys, batch.column("html").to_pylist(), strict=True):
                blocks, paths = parse(html)
                rows.append((host, 0, PAGE, key, 1, 0, 0))
                counts = Counter(paths)
                last = 0
                for path in paths:
                    if counts[path] == 1:
                        rows.append((host, path, ELEMENT, key, 1, last, 0))
                        last = path
                rows += [(host, path, ELEMENT, key, n, 0, 0) for path, n in counts.items() if n > 1]
                kept = [block for block in blocks if not block.at.outside]
                for token, n in Counter(block.token for block in kept).items():
                    rows.append((host, token, TEXT, key, n, 0, 0))
                sizes: Counter = Counter()
                for block in kept:
                    if block.at.slots:
                        sizes[block.at.slots[-1]] += len(block.text) - block.linked
                rows += [(host, slot, SLOT, key, 1, 0, n) for slot, n in sizes.items()]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 7
            names = ["host", "token", "kind", "page", "n", "before", "chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return pages.select("host", "key", "html").mapInArrow(run, TOKENS)


def templates(pages: DataFrame) -> DataFrame:
    """(host, boilerplate, main): template texts of a host and its main slot."""
    seen = (
        tokens(pages)
        .groupBy("host", "kind", "token")
        .agg(
            F.count("*").alias("pages"),
            F.bit_xor(F.xxhash64("page", "n")).alias("vector"),
            F.min("before").alias("first"),
            F.max("before").alias("last"),
            F.sum("chars").alias("chars"),
        )
        .filter((F.col("pages") >= PAGES) | (F.col("kind") == PAGE))
    )
    seen = common.stage(seen, "extraction-tokens")
    total = seen.filter(F.col("kind") == PAGE).select("host", F.col("pages").alias("total"))
    often = seen.filter(F.col("kind") != PAGE).join(total, "host").filter(F.col("pages") >= SHARE * F.col("total"))
    # Tokens of equal vectors are a class; it is valid if its elements keep their order on every page.
    tags = often.filter(F.col("kind") == ELEMENT).groupBy("host", "vector")
    valid = tags.agg(F.max((F.col("first") != F.col("last")).cast("int")).alias("mixed")).filter("mixed = 0")
    texts = often.filter(F.col("kind") == TEXT).join(valid, ["host", "vector"], "left_semi")
    boilerplate = texts.groupBy("host").agg(F.collect_list("token").alias("boilerplate"))
    main = (
        seen.filter(F.col("kind") == SLOT).groupBy("host").agg(F.max_by("token", F.struct("chars", "token")).alias("main"))
    )
    return main.join(boilerplate, "host", "left")


def choose(blocks: list[Block], boilerplate: frozenset[int], main: int | None) -> str:
    """Main text of one page from its blocks and its host's template."""
    inside = [block for block in blocks if not block.at.outside]
    deepest = max((block.at.depth for block in inside), default=0)
    kept = [block for block in inside if block.at.depth == deepest > 0]
    if not kept and main is not None:
        kept = [block for block in inside if main in block.at.slots]
    if not kept:
        sizes: Counter = Counter()
        for block in inside:
            sizes[block.at.slots[-1] if block.at.slots else 0] += len(block.text) - block.linked
        own = max(sizes, key=lambda slot: (sizes[slot], slot), default=0)
        kept = [block for block in inside if not own or own in block.at.slots]
    fresh = [block for block in kept if block.token not in boilerplate]
    if 2 * sum(len(block.text) for block in fresh) >= sum(len(block.text) for block in kept):
        kept = fresh
    return "\n".join(block.text for block in kept)


def extract(pages: DataFrame) -> DataFrame:
    """(id, url, text) of every row (id, url, html)."""
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    pages = pages.select(
        "id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"), F.xxhash64("id", "url").alias("key")
    )
    known = common.stage(templates(pages), "extraction-templates")
    size = known.agg(F.sum(64 + F.length("host") + 8 * F.greatest(F.size("boilerplate"), F.lit(0)))).first()[0] or 0
    joined = pages.drop("key").join(F.broadcast(known) if size <= SMALL else known, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("html", "boilerplate", "main")]
            made = [choose(parse(html)[0], frozenset(drop or ()), main) for html, drop, main in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(made, pa.string())], ["id", "url", "text"]
            )

    return joined.select("id", "url", "html", "boilerplate", "main").mapInArrow(run, "id long, url string, text string")
