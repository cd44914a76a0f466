"""Main text of web pages by removal of site templates.

Every element's subtree is hashed (tag, class, id and all it holds). Spark counts on how
many pages of a host each hash occurs; subtrees that recur on many pages of their host are
template and are deleted before the text is taken. Menus, forms, adverts and the like are
also known by their tags, roles and class names, as a host may have only one page; inside the
article a class name must say nothing else, and paragraphs stay whatever their class but advert.

Inside the article element a recurring *text block* (paragraph, heading, list, quotation) is
kept: pages may share passages, and these belong to their articles.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.session import settle

MIN_PAGES = 8  # a template stands on at least so many pages of its host
MIN_SHARE = 0.2  # and on this share of them
BROADCAST_HASHES = 200_000  # of 8 bytes each

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol"
    " option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"br", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "body", "html"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
            "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"},
          "td": {"table", "tr"}, "th": {"table", "tr"}}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl li dt dd table tbody thead tr td th figure"
                  " figcaption b i em strong a span code article main br".split())
# What is never article text (fixed values).
DROPPED_TAGS = frozenset("head nav footer aside form button input select dialog".split()) | RAW
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments"
    " consent cookie cookies disqus footer gdpr menu modal nav navbar navigation newsletter notice notices"
    " popup promo promoted share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)

# Words that may stand beside those in a class name without a meaning of their own, and what
# marks even a paragraph of an article as an advert (fixed values).
PLAIN_WORDS = frozenset("area bar block box button buttons container form links list section slot wrap wrapper".split())
ADVERT_WORDS = frozenset("ad ads adv advert advertisement adverts advertising sponsored".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dl li dt dd table caption tbody thead tr td th figure"
                      " figcaption b i em strong a span code".split())

PARTS = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORDS = re.compile(r"[a-z0-9]+")


def attributes(text: str) -> dict[str, str]:
    return {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(text)}


class Node:
    __slots__ = ("tag", "marks", "parts", "digest", "dropped")

    def __init__(self, tag: str, marks: str, dropped: bool) -> None:
        self.tag, self.marks, self.dropped = tag, marks, dropped
        self.parts: list[Node | str] = []
        self.digest = 0


def named_unwanted(tag: str, named: str, inside: bool) -> bool:
    """Do class and id say that an element is no article text?

    Outside the article any word of them decides. Inside article or main a name must
    say nothing else (``cookie-notice`` and ``ad-slot``, not ``menu-history``), and
    paragraphs, headings, tables and inline elements go as adverts only.
    """
    if not inside:
        return not DROPPED_WORDS.isdisjoint(WORDS.findall(named))
    for name in named.split():
        words = set(WORDS.findall(name))
        telling = words - PLAIN_WORDS
        if telling and telling <= (ADVERT_WORDS if tag in TEXT_TAGS else DROPPED_WORDS):
            return True
    return False


def unwanted(tag: str, attrs: dict[str, str], in_article: bool, inside: bool) -> bool:
    if tag in DROPPED_TAGS or (tag == "header" and not in_article) or "hidden" in attrs:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    if attrs.get("role", "").strip().lower() in DROPPED_ROLES or attrs.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
        return True
    named = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
    return bool(named.strip()) and named_unwanted(tag, named, inside)


def parse(page: str) -> Node:
    """A tree that holds every element; unclosed and stray tags are mended as browsers do."""
    root = Node("", "", False)
    stack = [root]
    articles = mains = 0
    at = 0
    scan = PARTS.search
    while True:
        m = scan(page, at)
        if m is None:
            if at < len(page):
                stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = name.lower()
        if m[1]:
            if tag == "br":
                stack[-1].parts.append(Node("br", "", False))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    articles -= sum(n.tag == "article" for n in stack[i:])
                    mains -= sum(n.tag == "main" for n in stack[i:])
                    del stack[i:]
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SIBLINGS[tag]:
                    del stack[i:]
                    if tag != "tr":
                        break
                elif stack[i].tag in SCOPES[tag]:
                    break
        attrs = attributes(m[3]) if m[3] and not m[3].isspace() else {}
        node = Node(tag, f"{attrs.get('class', '')}|{attrs.get('id', '')}" if attrs else "",
                    unwanted(tag, attrs, articles > 0, articles + mains > 0))
        stack[-1].parts.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            node.parts.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            continue
        if not m[3].rstrip().endswith("/") or tag in BLOCKS:
            stack.append(node)
            articles += tag == "article"
            mains += tag == "main"
    return root


def in_order(root: Node) -> list[Node]:
    """All elements, each before what it holds (without recursion, as pages nest deeply)."""
    out, open_nodes = [], [root]
    while open_nodes:
        node = open_nodes.pop()
        out.append(node)
        open_nodes.extend(p for p in node.parts if not isinstance(p, str))
    return out


def hashed(root: Node) -> list[Node]:
    nodes = in_order(root)
    for node in reversed(nodes):
        h = xxhash.xxh3_64(f"{node.tag}|{node.marks}")
        for part in node.parts:
            h.update(part.strip() if isinstance(part, str) else part.digest.to_bytes(8, "little"))
        node.digest = h.intdigest()
    return nodes


def signed(digest: int) -> int:
    return digest - (1 << 64) if digest >= 1 << 63 else digest


def candidates(root: Node) -> set[int]:
    """Hashes of the subtrees that may be template: not dropped anyway, not article prose."""
    hashed(root)
    out: set[int] = set()
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        if node.dropped:
            continue
        inside = inside or node.tag in ("article", "main")
        if node.tag and not (inside and node.tag in PROSE) and node.tag not in ("html", "body", "br"):
            out.add(signed(node.digest))
        todo.extend((p, inside) for p in node.parts if not isinstance(p, str))
    return out


def main_nodes(root: Node, template: set[int]) -> list[Node]:
    """The outermost articles, else the main element, else the page."""
    for wanted in ("article", "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.dropped or (signed(node.digest) in template and node.tag != wanted):
                continue
            if node.tag == wanted:
                found.append(node)
            else:
                todo.extend(p for p in reversed(node.parts) if not isinstance(p, str))
        if found:
            return found
    return [root]


def main_text(page: str, template: set[int] = frozenset()) -> str:
    """Text blocks of the article joined by one space."""
    root = parse(page)
    if template:
        hashed(root)
    out: list[str] = []
    for top in main_nodes(root, template):
        todo: list[tuple[Node | str, bool]] = [(top, top.tag in ("article", "main"))]
        while todo:
            part, inside = todo.pop()
            if isinstance(part, str):
                out.append(html.unescape(part) if "&" in part else part)
                continue
            if part.dropped and part is not top:
                continue
            if template and part is not top and not (inside and part.tag in PROSE) and signed(part.digest) in template:
                continue
            if part.tag in BLOCKS:
                out.append(" ")
                todo.append((" ", inside))
            todo.extend((p, inside) for p in reversed(part.parts))
    return " ".join("".join(out).split())


def hash_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, hashes = [], []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            found = candidates(parse(page.as_py() or ""))
            hosts += [host] * len(found)
            hashes += found
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64())], ["host", "hash"])


def text_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            main_text(page.as_py() or "", frozenset(template.as_py() or ()))
            for page, template in zip(batch.column("html"), batch.column("templates"), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array(np.array([len(t) for t in texts], dtype=np.int64))],
            ["page_id", "url", "text", "n_chars"],
        )


def host_of(url: Column) -> Column:
    """Lower-cased host; empty for a null url or one without a scheme."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)), F.lit(""))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = MIN_SHARE) -> DataFrame:
    """(host, templates): hashes of the subtrees that recur on a host.

    A host keeps at most (subtrees per page) / ``share`` hashes, however many pages it has.
    """
    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    counts = rows.mapInArrow(hash_task, "host string, hash long").groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    sizes = pages.groupBy(host_of(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    found = counts.where(F.col("n") >= min_pages).join(sizes, "host")
    return found.where(F.col("n") >= share * F.col("pages")).groupBy("host").agg(F.collect_list("hash").alias("templates"))


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = MIN_SHARE) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points).

    Null html counts as empty and gives an empty text; a null url belongs to the empty host.
    Pages that occur twice count twice; other columns are ignored; an empty table gives an
    empty result. The templates join by host: as a broadcast while their counted hashes are
    few, else as a shuffle whose hot hosts Spark's skew join splits.
    """
    templates = settle(site_templates(pages, min_pages, share))
    total = templates.agg(F.coalesce(F.sum(F.size("templates")), F.lit(0)).alias("n")).first()["n"]
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"),
    )
    rows = rows.join(F.broadcast(templates) if total <= BROADCAST_HASHES else templates, "host", "left")
    return rows.drop("host").mapInArrow(text_task, "page_id long, url string, text string, n_chars long")
