"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its elements, each told apart by its path of open elements, and its
text blocks. Over the pages of one host (pages with equal html count once) tokens that occur
on the same pages form a class. The pages are never gathered: a class is told by its number
of pages and two sums over a hash of them, which add up in partial aggregation, so a host
with a third of all pages costs no more memory than a small one.

A class is valid if its tokens that occur once a page, on at least ``layout`` of the host's
pages, stand in the same order on all of them. Valid classes nest by their elements into the
host's template: a class hangs in the one that holds the nearest element around its first
(``template_tree``). A layout is a valid class with an element outside articles; a host may
have several. A text block is template if its class is a layout's, however often it stands on
each page, or if it occurs on at least ``support`` of the host's pages. Within an article it
must also occur equally often on each of its pages. What lies between are the slots: extraction
keeps all blocks outside template, but for those of elements of other roles (menus, headers,
footers, sidebars, notices, adverts, forms, comments). Where a layout has an article element with most of its text, only
blocks inside it count. An odd page of a host with templates falls back to its own article
element if that holds most of its text, a host of few pages to its own article element;
without one all slots count. A page that template would leave without text keeps it.

Defined results: null or empty html gives an empty text and 0 characters; a null or
unreadable url counts as the host ""; rows that repeat are extracted once each; torn tags
and unclosed elements are closed where HTML closes them; whole pages are read; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.sources import materialize, table

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# HTML's element kinds, and the roles that a main text leaves out.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - {"br", "option", "body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ASIDE_NAMES = frozenset(
    "nav footer aside form script style noscript template iframe button select textarea menu dialog svg head title object embed canvas".split()
)
_ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert menu nav navbar navigation breadcrumb breadcrumbs sidebar rail comment comments reply replies disqus discussion related recommended "
    "share sharing social newsletter subscribe subscription signup popup modal overlay footer header masthead toolbar pagination pager search "
    "complementary contentinfo form dialog".split()
)
_ARTICLE_WORDS = frozenset("articlebody".split())


class _Element:
    __slots__ = ("name", "path", "aside", "article")

    def __init__(self, name: str, path: str, aside: bool, article: bool) -> None:
        self.name, self.path, self.aside, self.article = name, path, aside, article


def walk(html: str) -> Iterator[tuple[str, object, list[_Element]]]:
    """``("open", element, stack)`` and ``("text", string, stack)`` in page order; ``("break", None, stack)`` at block bounds."""
    stack = [_Element("", "", False, False)]
    at, size = 0, len(html)
    while at < size:
        m = _PIECE.match(html, at)
        at = m.end()
        close, name = m.group(1), m.group(2)
        if name is None:
            if m.group()[0] != "<" or m.group() == "<":
                yield "text", m.group(), stack
            continue
        name = name.lower()
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if stack[k].name in ("article", "main", "body", "td", "table") and name not in _BLOCK:
                    break
            if name in _BLOCK:
                yield "break", None, stack
            continue
        if name in _ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    del stack[k:]
                    break
                if stack[k].name in _BLOCK:
                    break
        if name in _SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in _SIBLINGS[name]:
                    del stack[k:]
                    break
                if stack[k].name in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        if name in _BLOCK:
            yield "break", None, stack
        told = {k.lower(): (a or b or c).lower() for k, a, b, c in _ATTRIBUTE.findall(m.group(3))}
        words = set(re.split(r"[^a-z]+", f"{told.get('class', '')} {told.get('id', '')} {told.get('role', '')}"))
        top = stack[-1]
        article = top.article or name in ("article", "main") or told.get("role") == "main" or told.get("itemprop") in _ARTICLE_WORDS
        own = name in _ASIDE_NAMES or (name == "header" and not top.article)
        own = own or (name not in ("html", "body", "article", "main") and bool(words & _ASIDE_WORDS))
        label = name + "".join("." + x for x in told.get("class", "").split()[:2])
        element = _Element(name, f"{top.path}/{label}", top.aside or own, article)
        yield "open", element, stack
        if name in _VOID:
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else size
            continue
        stack.append(element)


def blocks(html: str | None) -> tuple[list[tuple[str, str, bool, bool]], Counter, dict[str, int]]:
    """The page's blocks in order, ``(text, path, aside, article)``, how often each element path occurs, and the place of each token's first occurrence."""
    out, opened, places, run, where = [], Counter(), {}, [], None

    def flush() -> None:
        nonlocal run
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                places.setdefault(_text_key(text), len(places))
                out.append((text, where.path, where.aside, where.article))
            run = []

    for kind, value, stack in walk(html or ""):
        if kind == "open":
            places.setdefault(value.path, len(places))
            opened[value.path] += 1
        elif kind == "break":
            flush()
        else:
            top = stack[-1]
            if run and (top.aside != where.aside or top.article != where.article):
                flush()
            if not run:
                where = top
            run.append(value)
    flush()
    return out, opened, places


def host_of(url: Column) -> Column:
    """The lower-case host of a url, without user and port; "" if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _text_key(text: str) -> str:
    return f"#{xxhash.xxh3_64_hexdigest(text)}"


def page_tokens(pages: DataFrame) -> DataFrame:
    """``host, page_id, token, n, at, mass, whole``: element paths (mass: characters of text inside, asides left out; whole: the page's) and text blocks; ``at`` is the place of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found, opened, places = blocks(html.as_py())
                mass = Counter()
                for text, path, aside, _ in found:
                    if not aside:
                        while path:
                            mass[path] += len(text)
                            path = path.rpartition("/")[0]
                whole = sum(len(x[0]) for x in found if not x[2])
                rows += [(host, page, path, n, places[path], mass[path], whole) for path, n in opened.items()]
                rows += [(host, page, key, n, places[key], 0, whole) for key, n in Counter(_text_key(x[0]) for x in found).items()]
                rows.append((host, page, "", 1, -1, whole, whole))
                if len(rows) > 20_000:
                    yield pack(rows)
                    rows = []
            if rows:
                yield pack(rows)

    names = ["host", "page_id", "token", "n", "at", "mass", "whole"]

    def pack(rows: list) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    return pages.select("host", "page_id", "html").mapInArrow(run, "host string, page_id long, token string, n long, at long, mass long, whole long")


def classified(pages: DataFrame, min_pages: int = 3, layout: float = 0.2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``tokens`` of hosts with their class, ``hosts`` with their pages, and the valid ``classes`` (``host, class, members`` in page order)."""
    # Pages with equal html are one page here; its hash is its number.
    rows = page_tokens(pages.select("host", F.xxhash64("html").alias("page_id"), "html"))
    rows = rows.groupBy("host", "token", "page_id").agg(*[F.max(c).alias(c) for c in ("n", "at", "mass", "whole")])
    rows = materialize(rows, "occurrences")
    hashed = F.xxhash64("page_id")
    tokens = rows.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("pages"),
        F.bit_xor(hashed).alias("xor"),
        F.sum(F.shiftright(hashed, 28)).alias("added"),
        (F.max("n") == 1).alias("once"),
        (F.max("n") == F.min("n")).alias("even"),
        F.sum("mass").alias("mass"),
        F.sum("whole").alias("whole"),
    )
    tokens = tokens.filter(F.col("pages") >= min_pages)  # on fewer pages than that nothing is template
    tokens = materialize(tokens.withColumn("class", F.struct("pages", "xor", "added")), "tokens")
    hosts = tokens.filter("token = ''").select(F.col("host").alias("h_host"), F.col("pages").alias("host_pages"))
    able = tokens.filter("token <> '' AND once").join(hosts, F.col("host") == F.col("h_host")).filter(F.col("pages") >= F.lit(layout) * F.col("host_pages"))
    able = materialize(able.select(F.col("host").alias("a_host"), F.col("token").alias("a_token"), "class"), "able")
    met = rows.join(able, (F.col("host") == F.col("a_host")) & (F.col("token") == F.col("a_token")))
    # A page's tokens of a class, in order: no more than the page has.
    seen = met.groupBy("host", "class", "page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("members"))
    classes = seen.groupBy("host", "class").agg(F.min("members").alias("members"), F.max("members").alias("last"))
    return tokens, hosts, materialize(classes.filter("members = last").drop("last"), "classes")


def template_tree(classes: DataFrame) -> DataFrame:
    """``host, class, members, inside``: valid classes and the class that each hangs in; null at the top.

    That is the class of the nearest element around the first element of a class that belongs to another.
    """
    elements = classes.select("host", "class", F.explode("members").alias("token")).filter("token LIKE '/%'")
    elements = elements.select(F.col("host").alias("e_host"), F.col("token").alias("e_token"), F.col("class").alias("inside"))
    first = classes.withColumn("path", F.element_at(F.filter("members", lambda x: x.startswith("/")), 1))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = F.when(F.size(parts) > 2, above)
    reach = first.select("host", "class", F.posexplode(above).alias("depth", "token"))
    met = reach.join(elements, (F.col("host") == F.col("e_host")) & (F.col("token") == F.col("e_token")) & (F.col("class") != F.col("inside")))
    nearest = met.groupBy(F.col("host").alias("n_host"), F.col("class").alias("n_class")).agg(F.max_by("inside", "depth").alias("inside"))
    return classes.join(nearest, (F.col("host") == F.col("n_host")) & (F.col("class") == F.col("n_class")), "left").select("host", "class", "members", "inside")


def deduce_templates(pages: DataFrame, support: float = 0.8, min_pages: int = 3, layout: float = 0.2, share: float = 0.6) -> DataFrame:
    """One row per host with a template: ``t_host, containers, texts, inner``; ``pages`` has ``host, page_id, html``.

    ``containers`` are article elements with at least ``share`` of their pages' text, outermost
    first; ``texts`` are the keys of template text blocks, ``inner`` those that are left out of articles too.
    """
    tokens, hosts, classes = classified(pages, min_pages, layout)
    valid = tokens.filter("token <> ''").join(hosts, F.col("host") == F.col("h_host")).drop("h_host").filter(F.col("pages") >= F.lit(layout) * F.col("host_pages"))
    outside = F.exists("members", lambda x: x.startswith("/") & ~x.rlike(r"/(article|main)[./]"))
    layouts = classes.filter(outside).select(F.col("host").alias("l_host"), F.col("class").alias("l_class"))
    texts = valid.filter("token LIKE '#%'").join(layouts, (F.col("host") == F.col("l_host")) & (F.col("class") == F.col("l_class")), "left")
    texts = texts.filter(F.col("l_host").isNotNull() | (F.col("pages") >= F.lit(support) * F.col("host_pages")))
    texts = texts.groupBy("host").agg(
        F.array_sort(F.collect_set("token")).alias("texts"), F.array_sort(F.collect_set(F.when(F.col("even"), F.col("token")))).alias("inner")
    )
    name = F.element_at(F.split(F.element_at(F.split("token", "/"), -1), r"\."), 1)
    once = F.col("once") & F.col("token").startswith("/")
    held = valid.filter(once & name.isin("article", "main") & (F.col("mass") > 0) & (F.col("mass") >= F.lit(share) * F.col("whole")))
    # Several articles in one another: the outermost keeps the whole text.
    ranked = F.array_sort(F.collect_set(F.struct(F.size(F.split("token", "/")).alias("depth"), F.col("token").alias("path"))))
    held = held.groupBy(F.col("host").alias("c_host")).agg(F.transform(ranked, lambda x: x["path"]).alias("containers"))
    found = hosts.join(held, F.col("h_host") == F.col("c_host"), "left").join(texts, F.col("h_host") == F.col("host"), "left")
    return found.select(F.col("h_host").alias("t_host"), "containers", "texts", "inner")


def main_text(
    html: str | None, containers: list[str] | None = None, texts: frozenset = frozenset(), inner: frozenset = frozenset(), known: bool = False, share: float = 0.6
) -> tuple[str, str | None]:
    """The page's main text and the path of the innermost element that occurs once and holds it; see the module's description."""
    found, opened, _ = blocks(html)
    slots = [x for x in found if not x[2]]
    inside, container = [], next((x for x in containers or () if opened[x] == 1), None)
    if container:
        inside = [x for x in slots if x[1] == container or x[1].startswith(container + "/")]
    if not inside:
        inside, container = [x for x in slots if x[3]], None
        if not inside or known and sum(len(x[0]) for x in inside) < share * sum(len(x[0]) for x in slots):
            inside = slots
    kept = [x for x in inside if _text_key(x[0]) not in (inner if x[3] else texts)] or inside
    if kept and container is None:
        shared = kept[0][1].split("/")
        for _, path, _, _ in kept:
            parts = path.split("/")
            same = next((i for i, (a, b) in enumerate(zip(shared, parts)) if a != b), min(len(shared), len(parts)))
            shared = shared[:same]
        while len(shared) > 1 and opened["/".join(shared)] != 1:
            shared.pop()
        container = "/".join(shared) or None
    return " ".join(x[0] for x in kept), container


def extract(
    pages: DataFrame, support: float = 0.8, min_pages: int = 3, layout: float = 0.2, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars, host, container``."""
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        host_of(F.col(url_col).cast("string")).alias("host"),
        F.col(html_col).cast("string").alias("html"),
    )
    # Written first, so the planner knows its size: it goes to all tasks where small, and meets the pages in a join where not.
    known = materialize(deduce_templates(base, support, min_pages, layout), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                main_text(html.as_py(), containers.as_py(), frozenset(texts.as_py() or ()), frozenset(inner.as_py() or ()), host.as_py() is not None)
                for html, containers, texts, inner, host in zip(*batch.columns[3:8])
            ]
            texts, containers = [x[0] for x in found], [x[1] for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), batch.column(2), pa.array(containers, pa.string())],
                names=["page_id", "url", "text", "n_chars", "host", "container"],
            )

    met = base.join(known, F.col("host") == F.col("t_host"), "left").select("page_id", "url", "host", "html", "containers", "texts", "inner", "t_host")
    return met.mapInArrow(run, "page_id long, url string, text string, n_chars long, host string, container string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
