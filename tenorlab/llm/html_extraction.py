"""HTML main-text extraction with site template removal.

Each page is parsed once into an element tree, and every block element's subtree, in the main part and outside, is hashed by
structure and text. The hashes are counted in Spark by host, and a subtree that recurs on many pages of its host is deleted from every page that
has it: menus, headers, footers, notices, adverts. What is left is checked: elements that are never article text go by tag, name or
hidden state, and where a page marks its main part (article or main elements) the text is taken from there. Beside a marked main part a few
pages make a template; where none is marked a subtree must recur on a share of the host's pages, in a main part on a larger one, elements that are paragraphs of their own are never deleted, and a page never loses
all of its text.

A subtree is counted once for every different text of the page around it, so copies of one page are one page. A page without
a host is on no site and loses nothing to templates.

The counts are pre-aggregated before their shuffle, so one host may hold any share of the pages; the html itself is
never shuffled. A page's blocks are stored and shuffled deflated, and name the subtrees around them by their places in the page's list.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenorlab.llm._common import materialize, read

#: Beside a marked main part a subtree goes when it is on at least so many different pages of the host.
MIN_PAGES = 5
#: Where no main part is marked, it must also be on this share of them, or on MOST_PAGES.
MIN_SHARE, MOST_PAGES = 0.3, 200
#: In a marked main part.
MAIN_SHARE, MAIN_MOST_PAGES = 0.6, 1000
#: Elements that a main part does not lose by themselves.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd tr td th caption figcaption".split())

#: Kinds of elements and names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
DROPPED = frozenset(
    "script style title textarea noscript iframe noembed noframes head nav header footer aside form menu dialog button select option template svg canvas "
    "object audio video math datalist fieldset input".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu\w*|sidebar|side|footer|header|masthead|cookies?|consent|gdpr|notices?|"
    r"alert|newsletter|subscri\w+|signup|login|comments?|replies|disqus|respond|share|sharing|social|breadcrumbs?|related|recommended|popup|modal|overlay|pagination|pager|widget|toolbar)(?:$|[\s_-])"
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")


class Element:
    __slots__ = ("children", "dropped", "tag")

    def __init__(self, tag: str, dropped: bool = False):
        self.tag, self.dropped, self.children = tag, dropped, []


def _boilerplate(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in ROLES or name in ("class", "id") and BOILERPLATE.search(value):
            return True
    return False


def parse(page: str) -> Element:
    """The page's tree; unclosed and misplaced tags are settled the way browsers do for common cases."""
    root = Element("#root")
    stack, at = [root], 0

    def close(tags: tuple[str, ...], scope: tuple[str, ...] = ()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in scope:
                return

    while m := _TAG.search(page, at):
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in VOID:
                close((tag,), ("article", "main", "body") if tag in INLINE or tag == "p" else ())
            continue
        if tag in CLOSES_P:
            close(("p",), ("article", "main", "body", "table", "td", "button"))
        if tag in CLOSES_SAME:
            close(CLOSES_SAME[tag], SCOPES[tag])
        one = Element(tag, _boilerplate(tag, m[3]))
        stack[-1].children.append(one)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>|\Z", re.I).search(page, at)
            if tag not in DROPPED:
                one.children.append(page[at : end.start()])
            at = end.end()
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(one)
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def _mains(node: Element) -> list[Element]:
    """The outermost article elements, or else main elements, that nothing dropped holds."""
    found: dict[str, list[Element]] = {"article": [], "main": []}

    def walk(e: Element, tag: str) -> None:
        todo = [e]
        while todo:
            x = todo.pop()
            if x.tag == tag:
                found[tag].append(x)
                continue
            todo += [c for c in reversed(x.children) if not isinstance(c, str) and not c.dropped]

    for tag in ("article", "main"):
        walk(node, tag)
        if found[tag]:
            return found[tag]
    return []


class _Blocks:
    """Blocks of text in page order, each with the hashes of the elements around it and whether it may be article text."""

    def __init__(self):
        self.out: list[tuple[str, list[int], bool]] = []
        self._held: list[str] = []

    def end(self, around: list[int], wanted: bool) -> None:
        if self._held:
            if text := " ".join(html.unescape("".join(self._held)).split()):
                self.out.append((text, list(around), wanted))
            self._held = []

    def add(self, node: Element, hashes: dict[int, int], mains: set[int]) -> None:
        # an explicit stack: pages may nest deeper than Python does
        around: list[int] = []
        todo: list[tuple] = [("in", node, not mains, False)]
        while todo:
            what, x, main, dropped = todo.pop()
            if what == "text":
                self._held.append(x)
            elif what == "out":
                self.end(around, main and not dropped)
                if id(x) in hashes:
                    around.pop()
            elif x.tag == "br":
                self._held.append(" ")
            else:
                inner = (main or id(x) in mains, dropped or x.dropped)
                # a dropped part ends the text before it only where it is a block; its own text is a block apart
                if x.tag not in INLINE:
                    self.end(around, main and not dropped)
                    todo.append(("out", x, *inner))
                    if id(x) in hashes:
                        around.append(hashes[id(x)])
                elif inner[1] != dropped:
                    continue
                for c in reversed(x.children):
                    todo.append(("text" if isinstance(c, str) else "in", c, *inner))
        self.end(around, not mains)


def subtree_hashes(node: Element, mains: set[int]) -> dict[int, int]:
    """id(element) -> hash of its tag, text and children, for block elements, in a main part without PROSE; without text there is none.

    Beside marked main parts only the outermost elements count that hold none: what is in them goes with them.
    """
    done, todo, keep, holding = {}, [(node, False, False)], {}, set()
    while todo:
        x, ready, main = todo.pop()
        if not ready:
            todo.append((x, True, main))
            todo += [(c, False, main or id(x) in mains) for c in x.children if not isinstance(c, str)]
        else:
            h, empty = blake2b(x.tag.encode(), digest_size=8), True
            for c in x.children:
                if isinstance(c, str):
                    words = " ".join(c.split())
                    h.update(b"\0" + words.encode("utf-8", "surrogatepass"))
                    empty = empty and not words
                else:
                    inner, blank = done.pop(id(c))
                    h.update(b"\1" + inner)
                    empty = empty and blank
            done[id(x)] = (h.digest(), empty)
            if id(x) in mains or any(id(c) in holding for c in x.children if not isinstance(c, str)):
                holding.add(id(x))
            if not empty and x.tag not in INLINE and x.tag not in ("html", "body", "#root") and not (main and x.tag in PROSE):
                keep[id(x)] = int.from_bytes(h.digest(), "big", signed=True)
    if not mains:
        return keep
    counted, walk = {}, [(node, False)]
    while walk:
        x, main = walk.pop()
        main = main or id(x) in mains
        if id(x) in keep and (main or id(x) not in holding):
            counted[id(x)] = keep[id(x)]
            if not main:
                continue
        walk += [(c, main) for c in x.children if not isinstance(c, str)]
    return counted


def _signed(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def text_around(blocks: list[tuple[str, list[int], bool]]) -> tuple[int, dict[int, int]]:
    """A hash of the page's blocks, and for each subtree one of the blocks outside it. A subtree with all text that may be the article's never goes and has none."""
    whole, within, count, wanted = 0, {}, {}, 0
    for text, around, may in blocks:
        h = int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
        whole += h
        wanted += may
        for s in set(around):
            within[s] = within.get(s, 0) + h
            count[s] = count.get(s, 0) + may
    return _signed(whole), {s: _signed(whole - h) for s, h in within.items() if not wanted or count[s] < wanted}


def read_page(page: str | None) -> tuple[list[tuple[str, list[int], bool]], bool, tuple[int, dict[int, int]]]:
    """Blocks of the page (text, subtrees around, whether it may be article text), whether it marks its main part, and the hashes of ``text_around``."""
    root = parse(page or "")
    mains = {id(x) for x in _mains(root)}
    blocks = _Blocks()
    blocks.add(root, subtree_hashes(root, mains), mains)
    return blocks.out, bool(mains), text_around(blocks.out)


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-zA-Z][\w+.-]*:", "", url or "").lstrip("/").split("/")[0].split("?")[0].split("#")[0].lower()


def packed(blocks: list[tuple[str, list[int], bool]], places: dict[int, int]) -> bytes:
    """The blocks with the places of the subtrees around them that may go; the text of a block that is none of the article's is not needed again."""
    data = [[t if may else None, [places[s] for s in around if s in places]] for t, around, may in blocks]
    return zlib.compress(json.dumps(data, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"))


def without_templates(blocks: bytes, marked: bool, beside: set[int], unmarked: set[int], inside: set[int]) -> tuple[str, int, int]:
    """The text that is left of packed blocks, how many there were and how many went; the sets hold places of subtrees that go."""
    found = json.loads(zlib.decompress(blocks).decode("utf-8", "surrogatepass"))
    goes = [not (unmarked if not marked else beside if t is None else inside).isdisjoint(around) for t, around in found]
    left = [t for (t, _), gone in zip(found, goes, strict=True) if t is not None and not gone]
    if marked and not left:
        left = [t for t, _ in found if t is not None]
    return "\n".join(left), len(found), sum(goes)


_PARSED = (
    "page_id long, url string, host string, marked boolean, blocks binary, "
    "whole bigint, subtrees array<struct<subtree:bigint,rest:bigint>>"
)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = pa.list_(pa.struct([("subtree", pa.int64()), ("rest", pa.int64())]))
    for batch in batches:
        host, marks, blocks, wholes, subtrees = [], [], [], [], []
        for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found, marked, (whole, rests) = read_page(page)
            blocks.append(packed(found, {s: i for i, s in enumerate(rests)}))
            subtrees.append([{"subtree": s, "rest": r} for s, r in rests.items()])
            wholes.append(whole)
            marks.append(marked)
            host.append(host_of(url))
        columns = [pa.array(host, pa.string()), pa.array(marks, pa.bool_()), pa.array(blocks, pa.binary()), pa.array(wholes, pa.int64()), pa.array(subtrees, seen)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["page_id", "url", "host", "marked", "blocks", "whole", "subtrees"])


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["marked", "blocks", "beside", "unmarked", "inside"]
    for batch in batches:
        each = zip(*(batch.column(c).to_pylist() for c in names), strict=True)
        done = [without_templates(blocks, marked, *(set(x or ()) for x in sets)) for marked, blocks, *sets in each]
        columns = [pa.array([x[i] for x in done], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *columns], ["page_id", "url", "text", "n_blocks", "n_template"])


def site_templates(parsed: DataFrame) -> DataFrame:
    """host, subtree, often, in_main: subtrees that recur on MIN_PAGES different pages of their host, and whether on enough for a page or main part as a whole."""
    of_sites = parsed.where("host != ''")
    pages = of_sites.select("host", "whole").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    around = of_sites.select("host", F.explode("subtrees").alias("s")).select("host", "s.subtree", "s.rest").distinct()
    seen = around.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_PAGES)
    often = lambda share, most: F.col("n") >= F.least(share * F.col("pages"), F.lit(most))
    return seen.join(pages, "host").select("host", "subtree", often(MIN_SHARE, MOST_PAGES).alias("often"), often(MAIN_SHARE, MAIN_MOST_PAGES).alias("in_main"))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_template: one row per row of ``pages`` (page_id, url, html).

    n_blocks counts the page's blocks of text, n_template those that the site's templates deleted. A null or empty html has the empty
    text. A null url has no host and so no templates. Repeated rows are extracted alike; null page ids stay; other columns are ignored; an
    empty table gives an empty result.
    """
    parsed = materialize(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_parsed, _PARSED).withColumn("rid", F.monotonically_increasing_id()), "pages")
    around = parsed.where("host != ''").select("rid", "host", F.posexplode("subtrees.subtree").alias("place", "subtree"))
    found = around.join(site_templates(parsed), ["host", "subtree"])
    some = lambda c, name: F.collect_set(F.when(F.col(c), F.col("place"))).alias(name)
    gone = found.groupBy("rid").agg(F.collect_set("place").alias("beside"), some("often", "unmarked"), some("in_main", "inside"))
    out = parsed.select("rid", "page_id", "url", "marked", "blocks").join(gone, "rid", "left").drop("rid").mapInArrow(_left, "page_id long, url string, text string, n_blocks long, n_template long")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_template")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))
