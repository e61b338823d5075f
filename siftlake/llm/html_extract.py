"""Main text of web pages by site template removal.

Every page is cut into elements. The subtrees of block elements are hashed; Spark counts on how many pages of its host each hash
stands, and subtrees that recur on MIN_PAGES of them, however many the host has, are the site's template and are deleted (copies of
one page, equal in their text but for white space, count as one page), as are elements that are by their tag, role or class no part of an article. Where a page marks its article (article or main elements), only that counts, and paragraphs
in it are never taken for template, however often they are copied.

Defined results: a null page is empty, and so is its text; pages without an address share a host; repeated rows get a row each;
broken markup never fails: end tags without a start are ignored, open elements end with the page, a quote that is never closed
counts as none, a tag without an end drops what is left of the page; extra columns, of whatever name, are ignored; an empty table
gives an empty result. Reading takes time in proportion to a page's length, however it is written.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from xxhash import xxh3_64_intdigest

from .common import hot_keys, map_batches, skew_join, text_of, written

#: A subtree is template if it stands on at least so many pages of its host that differ in their text.
MIN_PAGES = 5
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that are no article text wherever they stand.
DROPPED = frozenset("head nav footer aside form menu button select textarea dialog label fieldset audio video datalist".split())
#: Elements that may stand around a whole page, too.
FORMS = frozenset({"form", "fieldset"})
#: Elements whose inside is no text of the page, up to their first end tag.
RAW = frozenset("script style template svg iframe textarea select title noembed noframes".split())
OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
SPACE = re.compile(r"\s+")
#: Words of class names and ids of what surrounds an article; the second list counts only outside of one.
CLUTTER = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus "
    "sidebar nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer skip widget toolbar".split()
)
OUTER = frozenset("header masthead topbar logo search tags copyright".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Containers whose recurrence counts; inside an article only the second list, never paragraphs.
COUNTED = frozenset("div section ul ol dl table figure details p header footer nav aside form center blockquote".split())
COUNTED_INSIDE = frozenset("div section ul ol dl table figure details".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}


@dataclass(slots=True)
class Element:
    tag: str
    start: int
    first: int
    dropped: bool
    inside: bool
    end: int = 0
    last: int = 0
    article: bool = False
    #: Clutter by itself; whether that may be a wrapper's (a class name or a form); hidden by itself, or by one around it; the element around it.
    clutter: bool = False
    soft: bool = False
    hidden: bool = False
    veiled: bool = False
    up: Element | None = None
    #: Of the element's tag, its text and its children's digests, without differences of white space.
    fed: list[str] | None = None
    digest: int = 0


@dataclass
class Page:
    """Pieces of text (with the number of their block) and the elements, each over a range of pieces and of the source."""

    source: str
    pieces: list[tuple[int, str]] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)


@lru_cache(maxsize=16_384)
def names_of(attributes: str) -> tuple[set[str], set[str], bool]:
    """Words of class and id, roles, and whether the element is hidden."""
    words: set[str] = set()
    roles: set[str] = set()
    hidden = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            words.update(re.split(r"[^a-z0-9]+", value))
        elif name == "role":
            roles.update(value.split())
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    return words, roles, hidden


def tag_end(source: str, at: int) -> tuple[int, int]:
    """Where the attributes from at on end and where the tag does; (-1, -1) if it never does.

    A quote that is never closed counts as none from there on: the tag ends at the next >.
    """
    while m := STOP.search(source, at):
        if m[0] == ">":
            return m.start(), m.end()
        at = source.find(m[0], m.end()) + 1
        if not at:
            end = source.find(">", m.end())
            return (end, end + 1) if end >= 0 else (-1, -1)
    return -1, -1


def tokens(source: str) -> Iterator[tuple[str, str, str, int, int]]:
    """kind (text, start, end or raw), text or name, attributes, and where it starts and ends; comments and the like are left out.

    Every character is passed a bounded number of times, however broken the markup.
    """
    at, size = 0, len(source)
    raw_ends: dict[str, re.Pattern] = {}
    while at < size:
        lt = source.find("<", at)
        if lt != at:
            stop = size if lt < 0 else lt
            yield "text", source[at:stop], "", at, stop
            at = stop
            continue
        if source[at + 1 : at + 2] in ("!", "?"):
            closer = next(c for o, c in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")) if source.startswith(o, at))
            end = source.find(closer, at + (4 if closer == "-->" else 2))
            stop = size if end < 0 else end + len(closer)
            if closer == "]]>":
                yield "text", source[at + 9 : size if end < 0 else end], "", at, stop
            at = stop
            continue
        m = OPENING.match(source, at)
        if not m:
            yield "text", "<", "", at, at + 1
            at += 1
            continue
        inner, stop = tag_end(source, m.end())
        if stop < 0:
            return
        name = m[2].lower()
        if not m[1] and name in RAW and not source[m.end() : inner].endswith("/"):
            if name not in raw_ends:
                raw_ends[name] = re.compile(rf"</{name}\s*>", re.I)
            last = raw_ends[name].search(source, stop)
            stop = last.end() if last else size
            yield "raw", name, "", at, stop
        else:
            yield "end" if m[1] else "start", name, source[m.end() : inner], at, stop
        at = stop


def parse(source: str, hashed: bool = True) -> Page:
    """The page; its elements have digests if hashed."""
    page = Page(source)
    stack: list[Element] = []
    #: How many elements of a tag are open: the stack is searched only for those.
    standing: Counter[str] = Counter()
    block = 0

    def close(upto: int, at: int) -> None:
        while len(stack) > upto:
            e = stack.pop()
            standing[e.tag] -= 1
            e.end, e.last = at, len(page.pieces)
            if hashed:
                e.digest = xxh3_64_intdigest(" ".join("\0".join(e.fed).split()).encode("utf-8", "surrogatepass")) - (1 << 63)
                e.fed = None
                feed(str(e.digest))

    def feed(text: str) -> None:
        if hashed and stack:
            stack[-1].fed.append(text)

    for kind, token, attributes, start, stop in tokens(source):
        if kind == "text":
            page.pieces.append((block, token))
            feed(token)
            continue
        tag = token
        if kind == "raw":
            block += tag == "title"
            continue
        if tag == "br":
            page.pieces.append((block, " "))
            feed("<br")
            continue
        if tag in BLOCK:
            block += 1
        if kind == "end":
            for k in () if not standing[tag] else range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    close(k, stop)
                    break
                if stack[k].article:
                    break
            continue
        if tag in BLOCK and standing["p"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p":
                    close(k, start)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in CLOSED_BY and any(standing[t] for t in CLOSED_BY[tag]):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in CLOSED_BY[tag]:
                    close(k, start)
                    if tag != "tr" or stack and stack[-1].tag != "tr":
                        break
                elif stack[k].tag in SCOPES[tag]:
                    break
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK:
            feed(f"<{tag}{attributes}")
            continue
        up = stack[-1] if stack else None
        inside = up is not None and up.inside
        words, roles, hidden = names_of(attributes) if attributes.strip() else (set(), set(), False)
        article = tag in ("article", "main") or "main" in roles
        hard = tag in DROPPED - FORMS or hidden or bool(roles & ROLES - {"form"})
        soft = tag in FORMS or "form" in roles or tag not in ("html", "body") and bool(words & CLUTTER)
        if not inside and not article and tag not in ("html", "body"):
            hard, soft = hard or tag == "header", soft or bool(words & OUTER)
        e = Element(tag, start, len(page.pieces), False, inside or article, article=article, clutter=hard or soft, soft=soft and not hard, hidden=hidden, veiled=up is not None and (up.hidden or up.veiled), up=up, fed=[])
        stack.append(e)
        standing[tag] += 1
        feed(f"<{tag}{attributes}")
        page.elements.append(e)
    close(0, len(source))
    drop(page)
    return page


def above(e: Element) -> list[Element]:
    """The elements around e, from the innermost."""
    out = []
    while e.up is not None:
        e = e.up
        out.append(e)
    return out


def inherit(page: Page) -> None:
    for e in page.elements:
        e.dropped = e.clutter or e.up is not None and e.up.dropped


def drop(page: Page) -> None:
    """Sets dropped: clutter and all in it, but for wrappers that hold the page's article or most of its text."""
    inherit(page)
    if not any(e.dropped for e in page.elements):
        return
    sizes = [0]
    for _, text in page.pieces:
        sizes.append(sizes[-1] + len(" ".join(text.split())))
    size = lambda e: sizes[e.last] - sizes[e.first]
    whole = roots(page)
    if not whole:
        marked = [e for e in page.elements if e.article and not e.clutter and not e.veiled]
        if marked:
            best = max(marked, key=lambda e: (size(e), -e.start))
            for u in above(best):
                u.clutter = False
            inherit(page)
            whole = roots(page)
    # Of an article, or of a page without one.
    spans = [(e.first, e.last) for e in whole] or [(0, len(page.pieces))]
    firsts = [a for a, _ in spans]
    for e in page.elements:
        if e.clutter and e.soft and not (whole and e.article):
            a, b = spans[max(0, bisect_right(firsts, e.first) - 1)]
            if a <= e.first and e.last <= b and 2 * size(e) > sizes[b] - sizes[a]:
                e.clutter = False
    inherit(page)


def roots(page: Page) -> list[Element]:
    """The outermost articles that are not dropped; the whole page's main elements if it has none."""
    for tags in (("article",), ("main",), None):
        got: list[Element] = []
        for e in page.elements:
            if e.article and not e.dropped and (tags is None or e.tag in tags) and not (got and e.start < got[-1].end):
                got.append(e)
        if got:
            return got
    return []


def subtrees(page: Page) -> dict[int, list[Element]]:
    """Elements whose recurrence counts, by their digest."""
    whole = {id(e) for e in roots(page)}
    out: dict[int, list[Element]] = {}
    for e in page.elements:
        if e.tag in (COUNTED_INSIDE if e.inside else COUNTED) and id(e) not in whole and e.end > e.start:
            out.setdefault(e.digest, []).append(e)
    return out


def main_text(page: Page, template: set[int]) -> str:
    """Blocks of the article's pieces that neither rules nor the host's template delete, joined by an empty line."""
    keep = bytearray(len(page.pieces)) if (whole := roots(page)) else bytearray(b"\1" * len(page.pieces))
    for e in whole:
        keep[e.first : e.last] = b"\1" * (e.last - e.first)
    gone = [e for e in page.elements if e.dropped and not (e.up and e.up.dropped)]
    if template:
        gone += [e for h, es in subtrees(page).items() if h in template for e in es]
    for e in gone:
        keep[e.first : e.last] = bytes(e.last - e.first)
    blocks: dict[int, list[str]] = {}
    for ok, (block, text) in zip(keep, page.pieces, strict=True):
        if ok:
            blocks.setdefault(block, []).append(text)
    texts = (SPACE.sub(" ", entities.unescape("".join(b))).strip() for b in blocks.values())
    return "\n\n".join(t for t in texts if t)


def host_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def page_subtrees(pages: DataFrame) -> DataFrame:
    """pages (k0, k1, host, html) -> k0, k1, host, hash, page: each counted subtree of a page once, with a hash of the page's whole text."""
    def make() -> Callable[[dict], dict]:
        def step(batch: dict) -> dict:
            out: dict = {"k0": [], "k1": [], "host": [], "hash": [], "page": []}
            for *keys, host, source in zip(batch["k0"], batch["k1"], batch["host"], batch["html"], strict=True):
                page = parse(source)
                got = list(subtrees(page))
                text = " ".join(" ".join(t for _, t in page.pieces).split())
                out["hash"] += got
                for name, value in zip(out, (*keys, host), strict=False):
                    out[name] += [value] * len(got)
                out["page"] += [xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)] * len(got)
            return out

        return step

    return map_batches(pages.select("k0", "k1", "host", "html"), make, "k0 long, k1 long, host string, hash long, page long")


def template_of(pages: DataFrame) -> DataFrame:
    """k0, k1, template: the hashes of a page's subtrees that recur on its host; pages without any are left out.

    Only (host, hash) pairs that recur are kept for the second step, and both steps count by equality of (host, hash), so that
    neither a host's pages nor its template meet in one row; a subtree on a third of all pages is broadcast.
    """
    seen = written(page_subtrees(pages).distinct(), "subtrees")
    counted = seen.select("host", "hash", "page").distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= MIN_PAGES)
    both = F.struct("host", "hash").alias("subtree")
    often = seen.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_PAGES).join(counted, ["host", "hash"])
    often = written(often.select(both, "n"), "template")
    hits = skew_join(seen.select("k0", "k1", "hash", both), often.select("subtree"), "subtree", hot_keys(often, "subtree", "n", seen.count()), "left_semi")
    return hits.groupBy("k0", "k1").agg(F.collect_set("hash").alias("template"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: a row for each row of pages (page_id, url, html).

    A page is known by a 128-bit hash of its address and source, which any scan of the table gives alike.
    """
    key = [F.xxhash64("url", "html").alias("k0"), F.xxhash64(F.lit("second"), "html", "url").alias("k1")]
    known = pages.select(*key, "page_id", "url", host_of().alias("host"), text_of("html").alias("html"))
    template = written(template_of(known), "templates")
    # Only repeated rows share a key; where they are many, the adaptive plan splits their side of the join.
    joined = known.join(template, ["k0", "k1"], "left").select("page_id", "url", "html", "template")

    def make() -> Callable[[dict], dict]:
        def step(batch: dict) -> dict:
            texts = [main_text(parse(s, hashed=bool(t)), set(t or ())) for s, t in zip(batch["html"], batch["template"], strict=True)]
            return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return map_batches(joined, make, f"{kinds}, text string, n_chars long")
