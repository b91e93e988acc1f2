"""Main text of web pages by removing site templates.

Every element's subtree is hashed (tag, own text and children's hashes), and the page
becomes a list of text blocks with the block range of every subtree.
Spark counts in how many different pages of a host each subtree occurs, where pages with
the same main text (copies under other addresses, mirrored posts) are one. Subtrees that
recur in ``MIN_PAGES`` or more of them, and in the square root of the host's number of
different pages, are template: all blocks inside go first, whatever they are
(``n_template``). Of the blocks left, those go that are boilerplate by their mark-up but
differ from page to page: menus, headers, footers, sidebars, notices, adverts, forms,
comments, by tag, ARIA role and words of class and id (``n_markup``). Where a page has an
article or main element, only blocks inside count.

Prose inside an article (paragraphs, headings, lists, tables, quotes, inline mark-up), the
article itself, every element that has an article or main element inside, and elements of
an article that have paragraphs inside are never template. Nor is an element with over half
of the page's main text, where it has paragraphs or ``MAIN_CHARS`` characters: on pages
without article and main the innermost one stands for the article, or the paragraphs right
below body do. So copies of an article on one host keep their text.

Character references are decoded, white space inside a block becomes one space, blocks are
joined in page order by two line feeds. Nothing is capped, and reading takes time in
proportion to the page, broken or deeply nested ones included.

Defined results: null html is empty and has empty text; a page whose url is null or has no
host belongs to no site, so nothing of it is template; broken mark-up is read as far as it
goes (unclosed elements end with their parent, a ``<`` that starts no tag is text, and after
a tag whose quotes never close, quotes no longer hold a ``>``); repeated rows are pages of
their own; an empty table gives an empty result. Output columns replace input columns of the
same name.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import join_counted, stored
from freshet.llm.url_filter import split_url

MIN_PAGES = 3
#: From so many characters on, text without paragraphs can be the main text of a page.
MAIN_CHARS = 200

# Elements by role in HTML.
_RAW = "script|style|noscript|template|textarea|title|iframe|svg|canvas|audio|video|select|annotation|annotation-xml"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tbody thead tfoot tr td th caption figure figcaption".split())
_PARAGRAPH = frozenset("p pre blockquote".split())
_DROPPED = frozenset("nav footer aside form button head menu dialog label input".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup promo promoted related "
    "share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that make no other sense of a class or id beside one of ``_WORDS`` (related-posts, but not related-work).
_COMPANIONS = frozenset(
    "area bar block bottom box buttons container content fixed form global group icon icons inline inner item items left link links list main mobile "
    "page panel post posts primary right section signup site slot sticky text thread top unit user users reader readers visitor visitors wrap wrapper".split()
)
_CLOSES = {  # an open element of the key's kind ends where one of its value starts
    "p": _BLOCK - {"html", "body", "head"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody"}),
    "th": frozenset({"td", "th", "tr", "tbody"}),
    "option": frozenset({"option"}),
}

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_RAW_TAGS = frozenset(_RAW.split("|"))
#: Of these, elements with mark-up inside, which can hold one of their own kind.
_NESTED = frozenset("noscript template svg canvas audio video select annotation annotation-xml".split())
#: Elements that end where they start if written so (``<svg/>``).
_FOREIGN = frozenset("svg annotation annotation-xml".split())
_SAME = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>", re.I) for t in _NESTED}
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW_TAGS}
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z]+")


def _spans(source: str, tag: str, last: int) -> dict[int, int]:
    """Where each element of a kind that is closed starts and ends, its own kind inside it counted."""
    out, open_ = {}, []
    for m in _SAME[tag].finditer(source, 0, last + 1):
        if not m[1]:
            if not (tag in _FOREIGN and m[0].endswith("/>")):
                open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.end()
    return out


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of a page in order: text, start, end; scripts and the like, comments and declarations are passed over."""
    at, last, quotes = 0, source.rfind(">"), True
    spans: dict[str, dict[int, int]] = {}
    never: set[str] = set()  # raw elements that are not closed any more
    while at < len(source):
        open_ = source.find("<", at)
        if open_ < 0:
            open_ = len(source)
        if open_ > at:
            yield "text", source[at:open_], ""
        if open_ == len(source):
            return
        at = open_ + 1
        if source.startswith("!--", at):
            end = source.find("-->", at)
            at = end + 3 if end >= 0 else len(source)
        elif at > last:  # no tag can end any more
            yield "text", "<", ""
        elif source[at] in "!?":
            at = source.index(">", at) + 1
        elif named := _NAME.match(source, at):
            rest = _REST.match(source, named.end()) if quotes else None
            quotes = rest is not None
            end = rest.end() if rest else source.find(">", named.end()) + 1
            if not end:
                yield "text", "<", ""
                continue
            name, attrs = named[0].lower(), source[named.end() : end - 1]
            at = end
            if name[0] == "/":
                yield "end", name[1:], ""
            elif name in _NESTED:
                if name not in spans:
                    spans[name] = _spans(source, name, last)
                at = max(at, spans[name].get(open_, at))  # one that is never closed hides nothing
            elif name in _RAW_TAGS:
                closed = None if name in never else _RAW_END[name].search(source, at)
                if closed:
                    at = closed.end()
                elif name in ("script", "style"):
                    at = len(source)
                else:
                    never.add(name)
            else:
                yield "start", name, attrs
        elif source.startswith("/", at):
            at = source.index(">", at) + 1
        else:
            yield "text", "<", ""


class _Element:
    __slots__ = ("tag", "kids", "first", "end", "dropped", "content", "fixed", "main", "prose", "top", "value")

    def __init__(self, tag: str, first: int, dropped: bool, content: bool, fixed: bool, main: bool = False, top: bool = False):
        self.tag, self.first, self.dropped, self.content, self.fixed = tag, first, dropped, content, fixed
        self.main = main and not dropped  # is or holds a container of main content
        self.prose = tag in _PARAGRAPH and not dropped  # is or holds a paragraph
        self.top = top  # right below body
        self.end = self.value = 0
        self.kids: list[bytes] = []


def _named_boilerplate(value: str, inside: bool) -> bool:
    """Do the words of a class or id name boilerplate? Inside an article each name must have no other sense."""
    if not inside:
        words = set(_SPLIT.split(value))
        return not words.isdisjoint(_WORDS) or "header" in words
    for name in value.split():
        words = set(filter(None, _SPLIT.split(name)))
        if not words.isdisjoint(_WORDS) and words <= _WORDS | _COMPANIONS:
            return True
    return False


def _boilerplate(tag: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """Is an element boilerplate by its mark-up; is it a container of main content."""
    drop, content = tag in _DROPPED or (tag == "header" and not inside), tag in ("article", "main")
    if attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id"):
                drop = drop or _named_boilerplate(value, inside)
            elif name == "role":
                drop, content = drop or value in _ROLES, content or value == "main"
            elif name == "itemprop":
                content = content or value == "articlebody"
            else:
                drop = drop or name == "hidden" or value == "true"
    return drop, content and not drop


class Page:
    """Blocks and subtree hashes of one page."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, bool]] = []  # text, boilerplate, inside main content
        self.subtrees: list[tuple[int, int, int]] = []  # hash, first block, block after the last
        self.closed: list[_Element] = []
        self.stack = [_Element("", 0, False, False, True)]
        self.open: Counter = Counter()  # open elements of each tag
        self.block_at = [0]  # places of block elements in the stack
        self.pieces: list[str] = []
        for kind, name, rest in tokens(source):
            if kind == "text":
                self.pieces.append(name)
            elif kind == "end":
                self._end(name)
            else:
                self._start(name, rest)
        while len(self.stack) > 1:
            self._close()
        self._flush()
        self._settle()

    def _settle(self) -> None:
        """``subtrees`` are the elements that can be template; ``key`` is the hash of the main text."""
        inside = any(content and not dropped for _, dropped, content in self.blocks)
        main = [text if not dropped and (content or not inside) else "" for text, dropped, content in self.blocks]
        self.key = xxhash.xxh3_64_intdigest("\n".join(filter(None, main)).encode("utf-8", "replace")) - (1 << 63)
        chars = list(accumulate(map(len, main), initial=0))
        size = lambda e: chars[e.end] - chars[e.first]
        most = [2 * size(e) > chars[-1] and (e.prose or size(e) >= MAIN_CHARS) for e in self.closed]
        # elements close inside out, so the first is the innermost
        body = next((i for i, e in enumerate(self.closed) if most[i] and e.tag not in ("html", "body") and e.tag not in _PARAGRAPH), -1)
        first = self.closed[body].first if body >= 0 else 0
        below = body < 0 and 2 * sum(size(e) for e in self.closed if e.top and e.tag in _PARAGRAPH) > chars[-1]
        for i, e in enumerate(self.closed):
            prose = e.tag in _PROSE or e.tag not in _BLOCK
            if not (e.fixed or most[i] or (i < body and e.first >= first and (prose or e.prose)) or (below and e.top and prose)):
                self.subtrees.append((e.value, e.first, e.end))

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join(html.unescape("".join(self.pieces)).split())
            self.pieces.clear()
            if text:
                top = self.stack[-1]
                top.kids.append(text.encode("utf-8", "replace"))
                self.blocks.append((text, top.dropped, top.content))

    def _start(self, tag: str, attrs: str) -> None:
        if tag in _VOID:
            if tag in ("br", "wbr", "hr"):
                self.pieces.append(" ")
            if tag == "hr":
                self._flush()
            return
        while len(self.stack) > 1 and tag in _CLOSES.get(self.stack[-1].tag, ()):
            self._flush()
            self._close()
        if tag in _BLOCK:
            # inline elements left open in a paragraph end with it
            open_p = self.block_at[-1]
            if open_p and tag in _CLOSES.get(self.stack[open_p].tag, ()):
                self._flush()
                while len(self.stack) > open_p:
                    self._close()
            self._flush()
        top = self.stack[-1]
        drop, content = _boilerplate(tag, attrs, top.content)
        if tag == "article" and self.open["article"] and any(e.prose for e in self.stack):
            drop, content = True, False  # after the text of an article: a comment on it
        if tag not in _BLOCK and drop and not top.dropped:
            self._flush()
        inside = top.content or content
        fixed = tag in ("html", "body", "article", "main") or content or (top.content and (tag in _PROSE or tag not in _BLOCK))
        below = top.tag in ("", "html", "body")
        if tag in _BLOCK:
            self.block_at.append(len(self.stack))
        self.open[tag] += 1
        self.stack.append(_Element(tag, len(self.blocks), top.dropped or drop, inside, fixed, content, below))

    def _end(self, tag: str) -> None:
        if self.open[tag]:
            if tag in _BLOCK or self.stack[-1].dropped:
                self._flush()
            while self.stack[-1].tag != tag:
                self._close()
            self._close()
        elif tag == "p":
            self._flush()

    def _close(self) -> None:
        if self.stack[-1].tag in _BLOCK:
            self._flush()
            self.block_at.pop()
        e = self.stack.pop()
        self.open[e.tag] -= 1
        if not e.kids:
            return
        value = xxhash.xxh3_64_intdigest(e.tag.encode("utf-8", "replace") + b"\x00" + b"\x01".join(e.kids)) - (1 << 63)
        above = self.stack[-1]
        above.kids.append(value.to_bytes(8, "little", signed=True))
        above.main, above.prose = above.main or e.main, above.prose or e.prose
        if len(self.blocks) > e.first:
            e.end, e.value = len(self.blocks), value
            e.fixed = e.fixed or e.main or (e.content and e.prose)
            self.closed.append(e)


def packed_page(page: Page, pack) -> bytes:
    """A page's blocks and block ranges, compressed: numbers, then texts, which hold no line feeds, joined by line feeds.

    Texts travel only of blocks that mark-up leaves, a flag for each block tells which these
    are. A subtree's range is its first block, counted from the one before, and its length.
    """
    firsts, ends = [s[1] for s in page.subtrees], [s[2] for s in page.subtrees]
    inside = any(content and not dropped for _, dropped, content in page.blocks)
    left = [not dropped and (content or not inside) for _, dropped, content in page.blocks]
    numbers = np.array([*np.diff(firsts, prepend=0), *np.subtract(ends, firsts), *left], dtype="<i4")
    head = np.array([len(page.subtrees), len(page.blocks)], dtype="<i4").tobytes()
    small = bool(np.abs(numbers).max(initial=0) < 128)
    body = numbers.astype("<i1" if small else "<i4").tobytes()
    return pack(head + bytes([small]) + body + "\n".join(b[0] for b, k in zip(page.blocks, left, strict=True) if k).encode("utf-8", "replace"))


def kept_text(data: bytes, template: list[int] | None) -> tuple[str, int, int]:
    """Text of a packed page without its ``template`` subtrees (places), and the blocks gone as template and by mark-up."""
    subtrees, blocks = np.frombuffer(data, "<i4", 2).tolist()
    numbers = np.frombuffer(data, "<i1" if data[8] else "<i4", 2 * subtrees + blocks, offset=9)
    first = np.cumsum(numbers[:subtrees], dtype="int64")
    end = first + numbers[subtrees : 2 * subtrees]
    left = numbers[2 * subtrees :] == 1
    at = np.array(template if template is not None else [], dtype="int64")
    depth = np.zeros(blocks + 1, dtype="int64")
    np.add.at(depth, first[at], 1)
    np.add.at(depth, end[at], -1)
    gone = np.cumsum(depth)[:-1] > 0
    texts = data[9 + numbers.nbytes :].decode().split("\n") if left.any() else []
    text = "\n\n".join(t for t, g in zip(texts, gone[left].tolist(), strict=True) if not g)
    return text, int(gone.sum()), int((~gone & ~left).sum())


def _identity(url: str, source: str) -> dict[str, Column]:
    """uid and check: what page_id, address and mark-up hash to. Rows alike in all three have the same result."""
    parts = ["page_id", F.col(url), F.col(source)]
    return {"uid": F.xxhash64(*parts), "check": F.hash(*parts)}


def page_subtrees(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """uid, check, site, subtrees and key of every page.

    ``subtrees`` are the hashes, with the host's, of all subtrees that can be template (none
    without a host); ``key`` is the hash of the main text.
    """
    host, _ = split_url(F.col(url))

    @F.pandas_udf("subtrees array<long>, key long")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for sources in batches:
            rows = [([s[0] for s in page.subtrees], page.key) for page in (Page(source or "") for source in sources)]
            yield pd.DataFrame(rows, columns=["subtrees", "key"])

    parts = pages.select(*[c.alias(n) for n, c in _identity(url, source).items()], host.alias("host"), read(F.col(source)).alias("page"))
    known = F.when(F.col("host") != "", F.transform("page.subtrees", lambda s: F.xxhash64("host", s))).otherwise(F.array().cast("array<long>"))
    return parts.select("uid", "check", F.xxhash64("host").alias("site"), known.alias("subtrees"), "page.key")


def page_texts(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, uid, check and packed blocks of every page."""

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pack = zstandard.ZstdCompressor(level=6, write_content_size=True).compress
        for sources in batches:
            yield pd.Series([packed_page(Page(source or ""), pack) for source in sources], dtype="object")

    return pages.select("page_id", F.col(url).alias("url"), *[c.alias(n) for n, c in _identity(url, source).items()], packed(F.col(source)).alias("packed"))


def template_subtrees(read: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(subtree, n): the subtrees that recur, and the rows of ``read`` that hold them.

    Recurring is in ``min_pages`` or more pages of the host with different main texts, and
    in the square root or more of the number of those pages.
    """
    some = read.where(F.size("subtrees") > 0)
    sites = some.groupBy("site", "key").agg(F.count(F.lit(1)).alias("n")).groupBy("site").agg(F.count(F.lit(1)).alias("site_pages"), F.sum("n").alias("n"))
    each = some.select("site", "key", F.explode(F.array_distinct("subtrees")).alias("subtree"))
    # a subtree's hash holds its host's, so it has one site
    pages = each.groupBy("subtree", "key").agg(F.count(F.lit(1)).alias("n"), F.first("site").alias("site"))
    counts = pages.groupBy("subtree").agg(F.first("site").alias("site"), F.count(F.lit(1)).alias("pages"), F.sum("n").alias("rows")).where(F.col("pages") >= min_pages)
    judged = join_counted(stored(counts), sites, "site")
    return judged.where(F.col("pages") * F.col("pages") >= F.col("site_pages")).select("subtree", F.col("rows").alias("n"))


def main_text(pages: DataFrame, url: str = "url", source: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars, n_template and n_markup (blocks gone as template, and then by mark-up) of every page.

    Pages are read twice, for their subtrees and for their texts, so that no copy of the
    texts is written; only packed blocks are shuffled, once.
    """
    read = stored(page_subtrees(pages, url, source))
    held = read.select("uid", "check", F.posexplode("subtrees").alias("place", "subtree"))
    own = join_counted(held, template_subtrees(read, min_pages), "subtree")
    marked = own.groupBy(F.col("uid").alias("_uid"), F.col("check").alias("_check")).agg(F.collect_set("place").alias("template"))
    joined = page_texts(pages, url, source).join(marked.hint("shuffle_hash"), (F.col("uid") == F.col("_uid")) & (F.col("check") == F.col("_check")), "left")

    @F.pandas_udf("text string, n_template long, n_markup long")
    def kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor().decompress
        for packs, places in batches:
            rows = [kept_text(unpack(p), t) for p, t in zip(packs, places, strict=True)]
            yield pd.DataFrame(rows, columns=["text", "n_template", "n_markup"])

    texts = joined.select("page_id", "url", kept(F.col("packed"), F.col("template")).alias("kept")).select("page_id", "url", "kept.*")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template", "n_markup")
