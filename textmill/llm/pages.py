"""Main text of web pages.

What a site's template adds to its pages is found by counting. Every block
element's subtree is hashed, by its text (with the tags inside) and by its slot,
the tags, classes and ids that lead to it. Spark counts both per host, over pages
of different text. Two kinds of subtrees go: those of a text that recurs on many
pages of the host, and those in slots where most texts recur, as rotating
menus and adverts do, though none of them may be frequent.

Roles that the markup itself states (menus, page headers and footers, sidebars,
forms, scripts, comments and the like, by tag, role or an unmistakable class) go
on hosts of any size. Ambiguous classes count outside the article; inside it only
where the host's other pages have the same slot. An article's own flow (its
paragraphs, headings, lists' items) is never deleted by counts, so copies of an
article and passages that many share keep their text.

A page is parsed once; its pieces are written and read again when the counts are
known. The scanner reads on from every character once, whatever the markup.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from html import unescape
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import collector_off, discard, join_hosts, materialize, slices
from .neardup import Shingler
from .urls import host_and_path

#: A subtree belongs to the template where its text is on this share of the host's pages, and on this many.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.3, 5
#: A slot does where this share of its texts recurs and it is on this share of the pages; one of an ambiguous class where it is on this share.
SLOT_RECURS, SLOT_SHARE, SLOT_COMMON = 0.5, 0.05, 0.5
#: Text outside of articles is taken where it is more than so many times theirs.
OUTSIDE = 2

SKIPPED = frozenset("nav aside footer form button select option textarea input iframe object embed svg canvas audio video map dialog menu noscript template head title".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd tr td th caption figcaption summary address".split())
BLOCKS = FLOW | frozenset("article aside body center dd details dialog dir div dl fieldset figure footer form head header hgroup html main menu nav ol option optgroup section select table tbody tfoot thead title ul".split())
BREAKS = frozenset(("br", "hr"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
#: A start tag closes the nearest open element of these, unless a scope begins inside it.
CLOSES = {t: ("p",) for t in BLOCKS - {"option", "optgroup", "select", "body", "html"}}
CLOSES |= {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "option": ("option",)}
CLOSES |= {"tr": ("p", "tr", "td", "th"), "tbody": ("p", "tr", "td", "th"), "tfoot": ("p", "tr", "td", "th"), "td": ("p", "td", "th"), "th": ("p", "td", "th")}
SCOPES = frozenset("ul ol dl table td th div section article main body blockquote aside".split())

ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Classes and ids that mean one thing.
PLAIN = frozenset(
    "ad ads advert adverts advertisement advertisements adsbygoogle ad-slot ad-banner sponsored-content cookie-notice cookie-banner cookie-consent consent-banner gdpr-notice newsletter newsletter-signup"
    " comments comment-list commentlist comment-section comments-section comments-area user-comments reader-comments disqus_thread navbar nav-menu main-menu site-nav breadcrumb breadcrumbs sidebar site-header site-footer page-footer share-buttons social-share skip-link pagination".split()
)
#: Parts of classes and ids that may mean a page's own matter as well.
AMBIGUOUS = frozenset("ad ads advert banner sponsor sponsored promo cookie cookies consent notice notices notification alert popup modal overlay newsletter subscribe signup login nav navigation menu menus sidebar widget related recommended trending share sharing social toolbar pager footer header masthead topbar comment comments replies respond discussion reactions feedback".split())

_SIMPLE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPACE = re.compile(r"[\s/]*")
_KEY = re.compile(r"[^\s/>=][^\s/>=]*|=[^\s/>=]*")
_VALUE = re.compile(r"[^\s>]*")
_EQUALS = re.compile(r"\s*=\s*")
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")

DROPPED, BOX, MAIN, WEAK, HOLDS_MAIN = 1, 2, 4, 8, 16


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def read_tag(html: str, at: int) -> tuple[int, dict[str, str]]:
    """Where the tag ends whose name ends at ``at``, and its attributes, the
    first of each name; -1 if it never ends. Every character is read once."""
    found: dict[str, str] = {}
    n = len(html)
    while True:
        at = _SPACE.match(html, at).end()
        if at >= n:
            return -1, found
        if html[at] == ">":
            return at + 1, found
        key = _KEY.match(html, at)
        at, value = key.end(), ""
        equals = _EQUALS.match(html, at)
        if equals:
            at = equals.end()
            if html[at : at + 1] in ('"', "'"):
                end = html.find(html[at], at + 1)
                if end < 0:
                    return -1, found
                value, at = html[at + 1 : end], end + 1
            else:
                given = _VALUE.match(html, at)
                value, at = given[0], given.end()
        found.setdefault(key[0].lower(), value)


def _role(tag: str, attributes: dict[str, str], inside: bool) -> int:
    """DROPPED, WEAK or 0."""
    if tag in SKIPPED or (tag == "header" and not inside):
        return DROPPED
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").strip().lower() in ROLES:
        return DROPPED
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    if not PLAIN.isdisjoint(names):
        return DROPPED
    if any(not AMBIGUOUS.isdisjoint(_WORDS.findall(name)) for name in names):
        return WEAK if inside else DROPPED
    return 0


class Page:
    """The blocks of a page (parent, flags, slot and text hash of each; the
    first is the page) and its pieces of text, each with the block that owns it.
    Malformed markup is read leniently: end tags close what they match, the rest
    is closed by its parents or by the end; an end tag that matches nothing is
    passed over, a tag that never ends is the page's last."""

    def __init__(self, html: str):
        self.parents, self.flags, self.slots, self.hashes = [0], [0], [0], [0]
        self.owners: list[int] = []
        self.texts: list[str] = []
        self._buffer: list[str] = []
        self._parts: list[list[bytes]] = [[]]
        self._filled = [False]
        #: Open elements: tag and block, -1 for inline ones; and where each tag, any block and any scope is open.
        self._stack: list[tuple[str, int]] = []
        self._open: dict[str, list[int]] = {}
        self._blocks: list[int] = []
        self._scopes: list[int] = []
        self._block = 0
        self._scan(html)
        self._close(0)
        self._flush()

    def _scan(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self._text(html[at:])
                return
            if lt > at:
                self._text(html[at:lt])
            simple = _SIMPLE.match(html, lt)
            if simple:
                at = simple.end()
                tag = simple[2].lower()
                if simple[1]:
                    self._end(tag)
                else:
                    at = self._start(html, tag, {}, at)
                continue
            ends, name = html.startswith("</", lt), _NAME.match(html, lt + 1 + html.startswith("</", lt))
            if name:
                at, attributes = read_tag(html, name.end())
                if at < 0:
                    return
                if ends:
                    self._end(name[0].lower())
                else:
                    at = self._start(html, name[0].lower(), attributes, at)
            elif html.startswith(("<!", "<?", "</"), lt):
                close = "-->" if html.startswith("<!--", lt) else "]]>" if html.startswith("<![CDATA[", lt) else ">"
                end = html.find(close, lt + 2)
                if end < 0:
                    return
                at = end + len(close)
            else:
                self._text("<")
                at = lt + 1

    def _text(self, piece: str) -> None:
        self._buffer.append(unescape(piece) if "&" in piece else piece)

    def _flush(self) -> None:
        if self._buffer:
            piece = " ".join("".join(self._buffer).split())
            if not piece.isascii():
                piece = piece.encode("utf-8", "replace").decode()
            self._buffer.clear()
            if piece:
                if not self.flags[self._block] & DROPPED:
                    self.owners.append(self._block)
                    self.texts.append(piece)
                self._parts[self._block].append(piece.encode())

    def _start(self, html: str, tag: str, attributes: dict[str, str], at: int) -> int:
        for closed in CLOSES.get(tag, ()):
            where = self._open.get(closed)
            if where and (not self._scopes or where[-1] >= self._scopes[-1]):
                self._close(where[-1])
        if tag in BREAKS:
            self._buffer.append(" ")
        if tag in VOID:
            return at
        if tag in RAW:
            end = _END[tag].search(html, at)
            at = read_tag(html, end.end())[0] if end else -1
            return at if at > 0 else len(html)
        block = -1
        inside = bool(self.flags[self._block] & MAIN)
        role = _role(tag, attributes, inside)
        if tag in BLOCKS or role:
            self._flush()
            outer, block = self._block, len(self.flags)
            main = inside or tag in ("article", "main")
            if main and not inside and not (role | self.flags[outer]) & DROPPED:
                up = outer
                while up and not self.flags[up] & HOLDS_MAIN:
                    self.flags[up] |= HOLDS_MAIN
                    up = self.parents[up]
            own_main = HOLDS_MAIN * (tag in ("article", "main"))
            self.parents.append(outer)
            self.flags.append(role | self.flags[outer] & DROPPED | BOX * (tag not in FLOW) | MAIN * main | own_main)
            named = f"{tag} {attributes.get('class', '')} {attributes.get('id', '')}" if attributes else tag
            self.slots.append(xxh3_64_intdigest(_DIGITS.sub("#", named).encode("utf-8", "surrogatepass"), self.slots[outer]))
            self.hashes.append(0)
            self._parts.append([tag.encode()])
            self._filled.append(False)
            self._blocks.append(len(self._stack))
            self._block = block
        if tag in SCOPES:
            self._scopes.append(len(self._stack))
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append((tag, block))
        return at

    def _end(self, tag: str) -> None:
        where = self._open.get(tag)
        if where and (tag in BLOCKS or not self._blocks or self._blocks[-1] <= where[-1]):
            self._close(where[-1])

    def _close(self, upto: int) -> None:
        while len(self._stack) > upto:
            tag, block = self._stack.pop()
            self._open[tag].pop()
            if self._scopes and self._scopes[-1] == len(self._stack):
                self._scopes.pop()
            if block < 0:
                continue
            self._flush()
            self._blocks.pop()
            outer, parts = self.parents[block], self._parts[block]
            self._filled[block] |= len(parts) > 1
            self.hashes[block] = xxh3_64_intdigest(b"\0".join(parts))
            self._parts[block] = []
            if self._filled[block]:
                self._parts[outer].append(self.hashes[block].to_bytes(8, "big"))
            self._block = outer

    def counted(self) -> list[tuple[int, int, bool]]:
        """Slot, text hash and ambiguity of the blocks with text, once each."""
        rows = zip(self.parents, self.flags, self.slots, self.hashes, self._filled, strict=True)
        return list({(_signed(s), _signed(h), bool(f & WEAK)) for p, f, s, h, filled in rows if filled and not (f & HOLDS_MAIN or self.flags[p] & DROPPED)})


def main_text(parents: list[int], flags: list[int], slots: list[int], hashes: list[int], owners: list[int], texts: list[str], template: Collection[int], template_slots: Collection[int]) -> str:
    """The text of a page's blocks without those of fixed roles and of the
    host's template: that of its articles, or all of it where they hold less
    than a part of it. An article and what it stands in are never deleted by
    counts, nor is an article's own flow."""
    gone = [False] * len(flags)
    for k, flag in enumerate(flags):
        free = not flag & HOLDS_MAIN and (flag & BOX or not flag & MAIN)
        gone[k] = bool(gone[parents[k]] or flag & DROPPED or (free and (hashes[k] in template or (flag & (BOX | WEAK) and slots[k] in template_slots))) or (flag & WEAK and slots[k] in template_slots))
    kept = [(bool(flags[o] & MAIN), t) for o, t in zip(owners, texts, strict=True) if not gone[o]]
    inner = sum(len(t) for main, t in kept if main)
    outer = sum(len(t) for main, t in kept if not main)
    return " ".join(t for main, t in kept if main or not inner or outer > OUTSIDE * inner)


_PARSED = "page_id long, url string, host string, body long, counted array<struct<slot:long,text:long,weak:boolean>>, parents array<int>, flags array<int>, slots array<long>, hashes array<long>, owners array<int>, texts array<string>"


def _lists(rows: list[list], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(list(chain.from_iterable(rows)), kind))


def _rows(column: pa.Array) -> Iterator[list]:
    """A list column's values; an empty list for null."""
    bounds, flat = column.offsets.to_pylist(), column.flatten().to_pylist()
    return (flat[a - bounds[0] : b - bounds[0]] for a, b in zip(bounds, bounds[1:], strict=False))


def parse(pages: DataFrame) -> DataFrame:
    """A row for each page: what ``main_text`` needs of it, and for the counts
    its hashed blocks and ``body``, the smallest hash of the five-word shingles
    of its text: pages of nearly the same text mostly share it."""
    host, _ = host_and_path(F.col("url"))

    @collector_off
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(5)
        for batch in slices(batches, 64):
            read, bodies, counted = [], [], []
            for html in batch.column("html").to_pylist():
                page = Page(html or "")
                read.append(page)
                counted.append(page.counted())
                shingles = shingle(main_text(page.parents, page.flags, page.slots, page.hashes, page.owners, page.texts, (), ()))
                bodies.append(_signed(int(shingles.min())) if len(shingles) else 0)
            flat = list(chain.from_iterable(counted))
            blocks = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["slot", "text", "weak"])
            counts = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, counted)]), pa.int32()), blocks)
            columns = [_lists([p.parents for p in read], pa.int32()), _lists([p.flags for p in read], pa.int32()), _lists([list(map(_signed, p.slots)) for p in read], pa.int64()), _lists([list(map(_signed, p.hashes)) for p in read], pa.int64()), _lists([p.owners for p in read], pa.int32()), _lists([p.texts for p in read], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(bodies, pa.int64()), counts, *columns], names=["page_id", "url", "host", "body", "counted", "parents", "flags", "slots", "hashes", "owners", "texts"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html").mapInArrow(run, _PARSED)


def templates(parsed: DataFrame, share: float = TEMPLATE_SHARE, least: int = TEMPLATE_PAGES) -> DataFrame:
    """host, and the hashes of its template's texts and slots. Pages of nearly
    the same text count once, so that copies of a page make no template. As a
    page has a bounded number of blocks on average, so has a host's list: at
    most that average over ``share`` texts and over ``SLOT_SHARE`` slots. All
    counts are partial sums before they are shuffled."""
    pages = parsed.filter(F.size("counted") > 0)
    totals = materialize(pages.select("host", "body").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "totals")
    blocks = pages.select("host", "body", F.explode("counted").alias("c")).select("host", "body", "c.*").distinct()
    counted = blocks.groupBy("host", "slot", "text").agg(F.count(F.lit(1)).alias("n"), F.max("weak").alias("weak"))
    counted = materialize(counted, "counted")
    texts = counted.filter(F.col("n") >= least).join(totals, "host").filter(F.col("n") >= F.col("pages") * share).groupBy("host").agg(F.collect_set("text").alias("template"))
    slots = counted.groupBy("host", "slot").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("again"), F.max("weak").alias("weak")).filter(F.col("n") >= least)
    recurring = (F.col("again") >= F.col("n") * SLOT_RECURS) & (F.col("n") >= F.col("pages") * SLOT_SHARE)
    slots = slots.join(totals, "host").filter(recurring | (F.col("weak") & (F.col("n") >= F.col("pages") * SLOT_COMMON))).groupBy("host").agg(F.collect_set("slot").alias("slots_"))
    found = materialize(texts.join(slots, "host", "full_outer"), "templates")
    discard(totals, counted)
    return found


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row, repeated ones
    too. The whole html is read, character references are decoded, white space
    inside a block becomes one blank, blocks are joined by one in page order.
    Null, empty and text-free pages have an empty text; pages without a host are
    those of one host; an empty table gives an empty result; other columns are
    ignored."""
    parsed = materialize(parse(pages), "parsed", "zstd")
    known = templates(parsed.select("host", "body", "counted"))
    joined = join_hosts(parsed.drop("counted", "body"), known, "host", F.struct("page_id", "url"))
    columns = ("parents", "flags", "slots", "hashes", "owners", "texts", "template", "slots_")

    @collector_off
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = zip(*(_rows(batch.column(c)) for c in columns), strict=True)
            texts = [main_text(*parts, set(template), set(slots)) for *parts, template, slots in rows]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", *columns).mapInArrow(run, "page_id long, url string, text string, n_chars long")
