"""Main text of web pages by equivalence-class template deduction.

A page's tokens are its elements, named by their path of tags and classes (as a hash of the path
above and the label, so nesting costs nothing), and its blocks of text, named by path and text. Over the pages of a host, tokens with the same
occurrence vector (as often on each page as one another) form an equivalence class. Classes that
most pages hold are valid; the class whose tokens stand once on each page is the frame of the
template, the others nest in its gaps as repeated parts. What the frame's tokens enclose are
slots. The main slot is the article or main element around the slot of nearly all text outside
elements of other roles (menus, page headers, footers, sidebars, notices, adverts, forms, reader
comments); on a host without one it is the innermost slot that holds all of that text. Texts that
are tokens of the template themselves are no article's, also inside the slot: those on at least
``SHARE`` of the host's different pages, and on ``REPEATED`` of them. The other blocks of the slot are
the page's text. Pages with the same text in their article or main elements are one page here.
Elements that show nothing (scripts, pictures) end no block.

Occurrence vectors are never gathered: each is summed up as (pages, sum of a hash of page and
count), which tasks and Spark add up partially, so a host with a third of all pages is no
burden. Per host, only tokens on at least half of its pages are kept, which bounds a template by
twice the mean number of tokens of a page.

Blocks: text between block-level tags or ``<br>``, character references decoded, runs of white
space one space, trimmed, empty blocks left out, joined by ``\n``.

Defined results: null and empty html give an empty text; a page without the host's main slot
is its own template; a null url is a host of its own; repeated rows count as so many pages, but
once for texts; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, scratch, slices, written

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template title head textarea select option button svg iframe object canvas".split())
OTHER_ROLE = frozenset("nav footer aside form menu dialog".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open paragraph, and items that end their own kind.
ENDS_P = BLOCK - frozenset("br body html".split())
ITEM = {"li": "li", "dt": "dt|dd", "dd": "dt|dd", "tr": "tr", "td": "td|th", "th": "td|th", "option": "option"}
#: Words that name another role than the article's, and words that only say where or what shape. A class, id or role
#: names such a role if all of its words (between hyphens and underscores) are of these and at least one is of the first.
ROLES = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside complementary ad ads advert adverts advertisement sponsor sponsored promo banner notice alert cookie cookies "
    "consent gdpr comment comments reply replies disqus form search login signup subscribe newsletter popup modal share social related breadcrumb breadcrumbs pagination contentinfo".split()
)
SHAPES = frozenset(
    "site page main global top bottom left right primary secondary area bar box block body button buttons container group icons inner item items label links list panel "
    "posts row section slot thread title toggle unit widget widgets wrap wrapper".split()
)
#: Roles of a page that an article can have too: inside one they are its own.
HEADERS = frozenset(("header", "masthead"))
#: An article or main element is the main slot if it is around the slot of so much of the text.
MAIN_SHARE = 0.9


#: Different pages that a text must stand on to be the template's, and their share of a host's: of pages without an article or main element, and with one.
REPEATED, SHARE = (3, 5), (0.5, 0.9)
#: The path of the page itself.
ROOT = 0


def other_role(names: str, inside: bool) -> bool:
    """Whether a class, id or role names another role; ``inside`` an article or main element headers are its own."""
    for name in names.lower().split():
        words = set(re.split(r"[-_]+", name)) - {""}
        roles = words & ROLES
        if roles and words <= ROLES | SHAPES and not (inside and roles <= HEADERS):
            return True
    return False


def hashed(text: str, seed: int = 0) -> int:
    """A signed 64-bit hash."""
    h = xxhash.xxh3_64_intdigest(text, seed=seed)
    return h - (1 << 64) if h >> 63 else h


@dataclass
class Element:
    """An open element: ``inside`` is true in the slot that is looked for."""

    tag: str
    path: int
    silent: bool
    other: bool
    inside: bool


class Page(HTMLParser):
    """Blocks (path, text, whether in an element of another role, whether in the slot), and of each path its
    parent, depth, whether it is an article or main element, and how often it stands on the page."""

    def __init__(self, html: str, slot: int | None = None):
        super().__init__(convert_charrefs=True)
        self.slot = slot
        self.stack = [Element("", ROOT, False, False, slot == ROOT)]
        self.mains = 0  # open article and main elements
        self.open_tags: dict[str, int] = defaultdict(int)
        self.paths: dict[int, list[int]] = {ROOT: [ROOT, 0, 0, 1]}
        self.blocks: list[tuple[int, str, bool, bool]] = []
        self.in_main: list[bool] = []  # of each block, whether an article or main element holds it
        self.parts: list[str] = []
        self.feed(html)
        self.close()
        self.flush()

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                at = next((e for e in reversed(self.stack) if e.tag in BLOCK and not e.silent), self.stack[0])
                self.blocks.append((at.path, text, at.other, at.inside))
                self.in_main.append(self.mains > 0)

    def pop_to(self, depth: int) -> None:
        if any(e.tag in BLOCK and not e.silent for e in self.stack[depth:]):
            self.flush()
        for e in self.stack[depth:]:
            self.open_tags[e.tag] -= 1
            self.mains -= e.tag in ("article", "main")
        del self.stack[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK and not self.stack[-1].silent:  # what is not shown ends no block
            self.flush()
        if tag in VOID:
            return
        ended = {"p"} & self.open_tags.keys() if tag in ENDS_P else set()
        ended |= set(ITEM.get(tag, "").split("|"))
        if not self.stack[-1].silent and any(self.open_tags[t] for t in ended if t):
            for i in range(len(self.stack) - 1, 0, -1):
                open_tag = self.stack[i].tag
                if open_tag in ended:
                    self.pop_to(i)
                    break
                if open_tag in BLOCK and open_tag not in ("p", *ITEM):
                    break
        named = dict(attrs)
        above = self.stack[-1]
        label = tag + "".join(f".{c}" for c in (named.get("class") or "").split())
        names = " ".join(named.get(k) or "" for k in ("class", "id", "role"))
        # A header inside the article is a part of it; outside it is the page's.
        header = tag == "header" and not self.mains
        main = tag in ("article", "main")
        frame = main or tag in ("html", "body")
        other = above.other or tag in OTHER_ROLE or header or (not frame and bool(names) and other_role(names, self.mains > 0)) or "hidden" in named
        path = hashed(label, seed=above.path & (1 << 64) - 1)
        self.stack.append(Element(tag, path, above.silent or tag in SILENT, other, above.inside or path == self.slot))
        self.open_tags[tag] += 1
        self.mains += main
        known = self.paths.setdefault(path, [above.path, len(self.stack) - 1, int(main), 0])
        known[3] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        # "/" at the end of a tag that is not void is ignored, as browsers do

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK and not self.stack[-1].silent:
            self.flush()
        if not self.open_tags[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self.pop_to(i)
                break

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].silent:
            self.parts.append(data)

    def chars(self) -> dict[int, int]:
        """Characters of article-like text inside each path."""
        out = dict.fromkeys(self.paths, 0)
        for path, text, other, _ in self.blocks:
            if not other:
                out[path] += len(text)
        for path in reversed(self.paths):  # what is opened later is never above
            if path != ROOT:
                out[self.paths[path][0]] += out[path]
        return out


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


Token = tuple[int, int, int, int, int, int, int, int]


def main_slot(tokens: list[Token]) -> tuple[int, bool]:
    """The main slot's path, and whether it is an article or main element, from tokens (path, parent,
    depth, main, pages, vector, times, characters) of one host.

    Tokens are grouped to classes by (pages, vector). A class is a frame if its tokens stand
    once on each of its pages; the frame on most pages is the template's, and a class nests
    in it where all of its tokens' paths run through one of the frame's. ``ROOT`` is the page.
    """
    parent = {t[0]: t[1] for t in tokens}
    chars = {t[0]: t[7] for t in tokens}
    depth = {t[0]: t[2] for t in tokens}

    def above(path: int) -> Iterator[int]:
        while path != ROOT and path in parent:
            yield path
            path = parent[path]

    def under(path: int) -> set[int]:
        """The tokens below one; parents come first by depth."""
        out = {path}
        for p in sorted(parent, key=depth.__getitem__):
            if p != ROOT and parent[p] in out:
                out.add(p)
        return out - {path}

    classes: dict[tuple[int, int], list[int]] = defaultdict(list)
    for path, _, _, _, pages, vector, times, _ in tokens:
        if path != ROOT and times == pages:
            classes[pages, vector].append(path)
    best, below = ROOT, set(parent) - {ROOT}
    for (_, _), paths in sorted(classes.items(), key=lambda c: (-c[0][0], -len(c[1]), min(c[1]))):
        inside = [p for p in paths if p in below]
        most = max((chars[p] for p in inside), default=0)
        if not most or (best != ROOT and most < MAIN_SHARE * chars[best]):
            continue
        best = max((p for p in inside if chars[p] >= MAIN_SHARE * most), key=lambda p: (depth[p], p))
        below = under(best)
    around = set(above(best))
    held = [t[0] for t in tokens if t[3] and t[7] and t[0] in around]
    if held:
        return min(held, key=lambda p: (depth[p], p)), True
    total = max(chars.values(), default=0)
    every = [t[0] for t in tokens if total and t[6] == t[4] and t[7] == total]
    return max(every, key=lambda p: (depth[p], p), default=ROOT), False


def text_of(html: str, slot: int | None, main: bool, repeated: frozenset[int]) -> str:
    page = Page(html, slot)
    if slot is None or slot not in page.paths:
        chars = page.chars()
        slot, main = main_slot([(p, up, depth, is_main, 1, 1 if n == 1 else n + 1, n, chars[p]) for p, (up, depth, is_main, n) in page.paths.items()])
        page = Page(html, slot)
    return "\n".join(t for path, t, other, inside in page.blocks if inside and not other and (not repeated or hashed(t, path & (1 << 64) - 1) not in repeated))


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host``, its main ``slot``, whether that is an article or ``main`` element, and the ``texts`` of its template."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html"):
            sums: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
            for url, html in zip(batch.column("_url").to_pylist(), as_text(batch.column("_html")).to_pylist(), strict=True):
                page, host = Page(html), host_of(url)
                own = hashed(html)
                key, chars = hashed(f"{url}\0{own}") & (1 << 64) - 1, page.chars()
                for path, (up, depth, main, n) in page.paths.items():
                    x = sums[host, path, up, depth, main, 0]
                    x[0] += 1
                    x[1] += xxhash.xxh3_64_intdigest(n.to_bytes(8, "little"), seed=key) >> 24  # sums of 40 bits stay in a long
                    x[2] += n
                    x[3] += chars[path]
                main = int(any(m for _, _, m, _ in page.paths.values()))
                texts = [hashed(t, path & (1 << 64) - 1) for (path, t, other, _), held in zip(page.blocks, page.in_main, strict=True) if not other and (held or not main)]
                own = hashed(repr(texts)) if main else own  # pages of one text are one page
                for text in {*texts, ROOT}:
                    sums[host, text, own, 0, main, 1] = [1, 0, 0, 0]
            keys, values = list(sums), np.array(list(sums.values()), np.int64).reshape(-1, 4)
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = ["host", "path", "parent", "depth", "main", "text", "pages", "vector", "times", "chars"]
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], t) for i, t in enumerate(types)] + [pa.array(values[:, i]) for i in range(4)], names)

    def deduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_slot([tuple(t.values()) for t in row]) for row in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.bool_())], ["host", "slot", "main"])

    picked = pages.select(pages[url_col].alias("_url"), pages[html_col].alias("_html"))
    kinds = "host string, path long, parent long, depth long, main long, text long, pages long, vector long, times long, chars long"
    sums = picked.mapInArrow(count, kinds).groupBy("host", "path", "parent", "depth", "main", "text").agg(*[F.sum(c).alias(c) for c in ("pages", "vector", "times", "chars")])
    sums = written(sums, "tokens")
    elements = sums.where("text = 0")
    total = elements.where(F.col("path") == ROOT).select("host", F.col("pages").alias("total"))
    common = elements.join(total, "host").where("2 * pages >= total")
    grouped = common.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("path", "parent", "depth", "main", "pages", "vector", "times", "chars"))).alias("tokens"))
    slots = grouped.mapInArrow(deduce, "host string, slot long, main boolean")
    # a text's pages are counted once for each different page: its row names the page as parent
    texts = sums.where("text = 1").groupBy("host", "main", "path").agg(F.count("*").alias("pages"))
    most = texts.where(F.col("path") == ROOT).select("host", "main", F.col("pages").alias("total"))
    enough = [(F.col("main") == m) & (F.col("pages") >= REPEATED[m]) & (F.col("pages") >= F.lit(SHARE[m]) * F.col("total")) for m in (0, 1)]
    repeated = texts.where(F.col("path") != ROOT).join(most, ["host", "main"]).where(enough[0] | enough[1])
    return slots.join(repeated.groupBy("host").agg(F.collect_list("path").alias("texts")), "host", "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col`` and the main ``text`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html"):
            html, held = as_text(batch.column("_html")).to_pylist(), zip(*(batch.column(c).to_pylist() for c in ("slot", "main", "texts")), strict=True)
            texts = [text_of(h, slot, bool(main), frozenset(repeated or ())) if h else "" for h, (slot, main, repeated) in zip(html, held, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string())], ["_id", "_url", "_text"])

    with scratch(pages.sparkSession):
        found = written(templates(pages, url_col, html_col), "templates", lasting=True)  # its size is known when the join is planned
    url = F.coalesce(pages[url_col], F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    picked = pages.select(pages[id_col].alias("_id"), pages[url_col].alias("_url"), pages[html_col].alias("_html"), host.alias("host"))
    joined = picked.join(found, "host", "left").select("_id", "_url", "_html", "slot", "main", "texts")
    out = joined.mapInArrow(run, f"_id {pages.schema[id_col].dataType.simpleString()}, _url string, _text string")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), F.col("_text").alias("text"))
