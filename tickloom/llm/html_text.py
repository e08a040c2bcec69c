"""Main text of web pages, with site templates found by counting element subtrees over each host.

Pages are parsed into text blocks and the block elements that could be template. Spark counts, over the pages
of a host and over all pages, each such subtree (a hash of its place and content) and each place (a hash of the
tags, classes and ids down to it). A subtree goes if it recurs in several contexts, or if most of what stands
in its place recurs. What is left is joined block by block. Pages are read once to count and once to write, so
that only texts and not pages are ever moved.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm._common import cut, hash128, join_counted, map_arrow

#: Fixed values of HTML: elements without content, whose content is text, that are blocks, that end open ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption td th".split())
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption summary legend figcaption dd dt li".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "tbody", "thead", "tfoot"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
#: Elements that by their tag or role are never main text.
CHROME_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg canvas button select textarea dialog menu object embed audio video map input datalist title".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that break ties where counts can't decide.
HINTS = frozenset("ad ads adv adbox adslot adunit adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation header menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice notices notification alert toast popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus respond responses discussion reply replies pagination pager widget toolbar skip".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt figcaption tr table ul ol dl tbody thead tfoot caption".split())
KEEP = frozenset(("html", "body", "main", "article", "td", "th"))

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[a-z]+|\d+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(source: str) -> Node:
    """A forgiving tree: open elements are closed where HTML says so, unknown ends are ignored."""
    root = Node("#root", {})
    stack = [root]
    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.match(source, at)
        if m is None:
            break
        at = m.end()
        name = m.group(2)
        if name is None:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                stack[-1].children.append(piece)
            continue
        tag = name.lower()
        if m.group(1):
            if tag == "p" and not any(x.tag == "p" for x in stack):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body", "table", "td", "th", "nav", "footer", "aside", "section") and tag not in BLOCKS:
                    break
            continue
        attrs = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(m.group(3))} if m.group(3).strip(" /") else {}
        if tag in CLOSES_P:
            _close(stack, {"p"}, {"button", "td", "th", "article", "section", "div", "li", "table"})
        if tag in CLOSED_BY:
            _close(stack, CLOSED_BY[tag], SCOPES[tag])
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in VOID or m.group(3).endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            node.children.append(source[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        stack.append(node)
    return root


def _close(stack: list[Node], tags: set[str], scope: set[str]) -> None:
    """Close the outermost open element of `tags` that isn't outside the innermost one of `scope`."""
    found = 0
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            found = i
        elif stack[i].tag in scope:
            break
    if found:
        del stack[found:]


def never(node: Node, in_article: bool) -> bool:
    """Menus, footers, side bars, forms, scripts, hidden parts: elements that say so by tag, role or style."""
    tag, attrs = node.tag, node.attrs
    if tag in CHROME_TAGS:
        return True
    if tag == "header":  # an article's own header may hold its title
        return not (in_article and any(isinstance(c, Node) and c.tag in ("h1", "h2", "hgroup") for c in node.children))
    if not attrs or tag in ("html", "body"):
        return False
    if attrs.get("role", "").lower() in CHROME_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    return "style" in attrs and re.search(r"display\s*:\s*none", attrs["style"], re.I) is not None


def hinted(attrs: dict[str, str]) -> bool:
    """Whether a class or id has a word of HINTS."""
    names = attrs.get("class", "") + " " + attrs.get("id", "")
    return names != " " and not HINTS.isdisjoint(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower()))


@dataclass
class Page:
    """Text blocks in page order with the element that each stands in (-1: none that could be template), and the
    elements: subtree key, place, the element around it, outside the article or not, named by a hint or not, and
    whether it can't be judged by its place: it has no class or id, or holds the longest block. `context` stands
    for the page's own text."""

    texts: list[str] = field(default_factory=list)
    owners: list[int] = field(default_factory=list)
    keys: list[int] = field(default_factory=list)
    slots: list[int] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    outside: list[bool] = field(default_factory=list)
    hints: list[bool] = field(default_factory=list)
    mains: list[bool] = field(default_factory=list)
    context: int = 0


def _roots(root: Node, words: bool) -> tuple[set[int], set[int]]:
    """Ids of the outermost articles (else of main elements) outside chrome, and of the elements around them."""
    for wanted in ("article", "main"):
        found: set[int] = set()
        around: set[int] = set()
        todo: list[tuple[Node, tuple | None]] = [(root, None)]
        while todo:
            node, up = todo.pop()
            if node is not root and never(node, False) or words and node.tag not in ("html", "body") and hinted(node.attrs):
                continue
            if node.tag == wanted or wanted == "main" and node.attrs.get("role", "").lower() == "main":
                found.add(id(node))
                while up is not None and id(up[0]) not in around:
                    around.add(id(up[0]))
                    up = up[1]
                continue
            todo += [(c, (node, up)) for c in node.children if isinstance(c, Node)]
        if found:
            return found, around
    return set(), set()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_BASE, _PRIME = 0x1F3D5B79A2C4E6F7, (1 << 61) - 1


def read_page(source: str, words: bool = True) -> Page:
    """Walk the tree once with a stack of our own: pages may nest very deeply."""
    root = parse(source)
    roots, around = _roots(root, words)
    page = Page()
    line: list[str] = []
    # subtree hashes: a polynomial over the hashes of tags and texts, so that any stretch costs two look-ups
    sums, powers = [0], [1]
    starts: list[int] = []
    is_own: list[bool] = []

    def token(data: str) -> None:
        sums.append((sums[-1] * _BASE + xxhash.xxh3_64_intdigest(data)) % _PRIME)

    def end(owner: int, inside: bool) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(line))).strip()
        line.clear()
        if text and (owner >= 0 or inside or not roots):
            page.texts.append(text)
            page.owners.append(owner)
            is_own.append(inside or not roots)

    # a step is a node to enter, or (None, node, owner around it, inside) to leave one
    todo: list[tuple] = [(root, -1, xxhash.xxh3_64_intdigest(b""), False)]
    while todo:
        step = todo.pop()
        if isinstance(step[0], str):
            _, owner, _, inside = step
            line.append(step[0])
            if owner >= 0:
                token(_SPACE.sub(" ", step[0]).strip())
            continue
        if step[0] is None:
            _, node, owner, inside, made = step
            if made >= 0:
                token("/")
                while len(powers) < len(sums):
                    powers.append(powers[-1] * _BASE % _PRIME)
                first = starts[made]
                value = (sums[-1] - sums[first] * powers[len(sums) - 1 - first]) % _PRIME
                page.keys[made] = _signed(xxhash.xxh3_64_intdigest(f"{page.slots[made]} {value}"))
            elif owner >= 0:
                token("/")
            if node.tag in ("td", "th"):
                line.append(" ")
            elif node.tag in BLOCKS:
                end(made if made >= 0 else owner, inside)
            continue
        node, owner, place, inside = step
        tag, attrs, label = node.tag, node.attrs, node.tag
        inside_before = inside
        if node is not root:
            if never(node, inside) or words and inside and tag == "article" and hinted(attrs):
                continue
            inside = inside or id(node) in roots
            label = f"{tag}.{_DIGITS.sub('0', attrs.get('class', ''))}#{_DIGITS.sub('0', attrs.get('id', ''))}" if attrs else tag
            place = xxhash.xxh3_64_intdigest(f"{place} {label}")
        made = -1
        block = tag in BLOCKS
        if tag in ("td", "th"):
            line.append(" ")
        elif block:
            end(owner, inside_before)
        if block and tag not in KEEP and id(node) not in around and id(node) not in roots:
            bare = tag in PROSE and not ("class" in attrs or "id" in attrs)
            if not (inside and bare):
                made = len(page.keys)
                page.keys.append(0)
                page.slots.append(_signed(place))
                page.parents.append(owner)
                page.outside.append(bool(roots) and not inside)
                page.hints.append(words and hinted(attrs))
                page.mains.append(not ("class" in attrs or "id" in attrs))
                starts.append(len(sums) - 1)
        here = made if made >= 0 else owner
        if here >= 0:
            token(f"<{label}")
        todo.append((None, node, owner, inside, made))
        for c in reversed(node.children):
            if isinstance(c, str):
                todo.append((c, here, None, inside))
            elif c.tag == "br":
                todo.append((" ", here, None, inside))
            else:
                todo.append((c, here, place, inside))
    end(-1, False)
    mine = sorted({t for t, o in zip(page.texts, is_own) if o}, key=lambda t: (-len(t), t))[:2]
    page.context = _signed(xxhash.xxh3_64_intdigest("\n".join(mine)))
    for text, at in zip(page.texts, page.owners):
        if mine and text == mine[0]:
            while at >= 0:
                page.mains[at] = True
                at = page.parents[at]
    return page


_DIGITS = re.compile(r"\d+")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


#: Contexts (pages that differ in their own text) in which a subtree or a place recurs; and the share of what
#: stands in a place that must stand there more than once for the place to be template.
MIN_PAGES, MIN_REPEATED = 5, 0.75

_ELEMENTS = {"keys": pa.int64(), "slots": pa.int64(), "outside": pa.bool_(), "hints": pa.bool_(), "mains": pa.bool_()}
_COLUMNS = "key long, slot long, outside boolean, hint boolean, main boolean"


def _known(pages: DataFrame) -> DataFrame:
    """page_id, url, host, html, and two hashes of host and html: pages alike in both share what is decided."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    a, b = hash128(F.col("host"), F.col("html"))
    return rows.withColumns({"a": a, "b": b})


def page_elements(pages: DataFrame, words: bool = True) -> DataFrame:
    """a, b (see _known), host, context, at, key, slot, outside, hint, main: a row for each element that could be template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [read_page(source, words) for source in batch.column(3).to_pylist()]
            rows = pa.array([i for i, p in enumerate(read) for _ in p.keys], pa.int64())
            at = pa.array([k for p in read for k in range(len(p.keys))], pa.int32())
            context = pa.array([p.context for p in read], pa.int64()).take(rows)
            arrays = [pa.array([x for p in read for x in getattr(p, c)], kind) for c, kind in _ELEMENTS.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(3)), context, at, *arrays], names=["a", "b", "host", "context", "at", *(c.split()[0] for c in _COLUMNS.split(", "))])

    return map_arrow(_known(pages).select("a", "b", "host", "html"), run, f"a long, b long, host string, context long, at int, {_COLUMNS}")


def site_templates(elements: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, slot, key, n_rows, recurs (the content does), place (most of what stands in the place does), on that host.

    Contexts are counted and not pages, so an article that is posted again under other links is no template.
    Counts are made before rows move; a host of any size costs what its subtrees do. What other hosts hold says
    nothing, so a text is the same whatever else is in the table.
    """
    base = elements.groupBy("host", "slot", "key", "context").agg(F.count(F.lit(1)).alias("n"))
    own = cut(base.groupBy("host", "slot", "key").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n_rows")))
    again = F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0))
    places = own.groupBy("host", "slot").agg(F.sum("c").alias("n"), again.alias("again"), F.count(F.lit(1)).alias("d"))
    rows = join_counted(own, places, ["host", "slot"], "d", own.count())
    alike = (F.col("n") >= min_pages) & (F.col("again") >= F.col("n") * MIN_REPEATED)
    return rows.select("host", "slot", "key", "n_rows", (F.col("c") >= min_pages).alias("recurs"), alike.alias("place"))


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES, templates: bool = True, words: bool = True, outside: bool = True) -> DataFrame:
    """page_id, url, text for each row of `pages`: the article's blocks, a line each; empty if there is none.

    Null html is empty. A null or odd url has the empty host, counted like any other. Repeated rows are pages of
    one context. Only page_id, url and html are read; an empty table gives an empty result.

    What recurs on a host, or in its place, goes whatever it is called; but an article's bare paragraphs,
    headings, lists and tables are its own text however often they recur. Counts can't tell on hosts of few
    pages and where content varies: there what an article element leaves outside goes, and what hint words name.
    Each rule has its switch: `templates` the counts on a page's host, `outside` what article elements leave outside,
    `words` the hint words. Without all of them only what says so by tag or role goes.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [read_page(source, words) for source in batch.column(4).to_pylist()]
            arrays = [pa.array([p.texts for p in made], pa.list_(pa.string())), *(pa.array([getattr(p, c) for p in made], pa.list_(pa.int32())) for c in ("owners", "parents"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *arrays], names=["page_id", "url", "a", "b", "texts", "owners", "parents"])

    rows = map_arrow(_known(pages).select("page_id", "url", "a", "b", "html"), read, f"page_id {kind}, url string, a long, b long, texts array<string>, owners array<int>, parents array<int>")
    if templates or words or outside:
        judged = elements = cut(page_elements(pages, words))
        asked = F.lit(False)
        if templates:
            found = cut(site_templates(elements, min_pages))
            total = found.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
            judged = join_counted(elements.drop("context"), found, ["host", "slot", "key"], "n_rows", total)
            asked = F.col("recurs") | (F.col("place") & ~F.col("main"))
        gone = judged.where(asked | (F.col("hint") if words else F.lit(False)) | (F.col("outside") if outside else F.lit(False)))
        # one row for each page that differs from others, however often it is repeated
        gone = gone.groupBy("a", "b", "at").agg(F.count(F.lit(1)).alias("n"))
        gone = cut(gone.groupBy("a", "b").agg(F.collect_list("at").alias("gone"), F.max("n").alias("n")))
        rows = join_counted(rows, gone, ["a", "b"], "n", gone.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], salted=("a", "b", "page_id"))
    else:
        rows = rows.withColumn("gone", F.lit(None).cast("array<int>"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for texts, owners, parents, lost in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                if lost:
                    out = set(lost)
                    for i, up in enumerate(parents):  # an element stands behind the one around it
                        if up in out:
                            out.add(i)
                    texts = [t for t, o in zip(texts, owners) if o not in out]
                made.append("\n".join(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], names=["page_id", "url", "text"])

    return map_arrow(rows.select("page_id", "url", "texts", "owners", "parents", "gone"), write, f"page_id {kind}, url string, text string")
