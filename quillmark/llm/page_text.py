"""Main text of HTML pages: subtrees that recur across a host's different pages are its template and go, as do parts that HTML or their names mark as no article."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import slices, stored

#: A subtree is template if it is on this share of a host's different pages, and on so many at least; or on so many, however large the host.
SHARE = 0.1
LEAST = 4
MANY = 20
#: Levels of elements; deeper ones stand beside each other, as in browsers.
DEPTH = 512

# Fixed values of HTML: elements by how they are parsed and what they are for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math object audio video canvas".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
DROPPED = frozenset("head nav aside footer form dialog menu button select input label fieldset datalist map".split()) | RAW
CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
#: What a start tag closes, and the elements beyond which it doesn't look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags whose class, id or role may say that they are no part of the article; a paragraph's id only repeats its words.
HOLDERS = frozenset("div section ul ol article table td".split())
NAMED = HOLDERS | frozenset("p li dl span figure a".split())
# What parts of a site that are no article are called.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertisements advertising advertorial sponsor sponsors sponsored promo promos promotion cookie cookies gdpr consent notice notices newsletter newsletters "
    "subscribe subscription signup sidebar sidenav nav navbar navigation menu menus submenu menubar breadcrumb breadcrumbs masthead topbar footer comment comments commentlist respond disqus "
    "share shares sharing sharebar addthis popup modal overlay complementary contentinfo skiplink".split()
)
#: Such names that are prose's as well: parts called so go if they hold controls, or if half of their text is links.
WEAK = frozenset("social banner alert login toolbar pagination pager related recommended recommendations trending popular tags follow widget widgets links teaser teasers search".split())
#: Names of adverts and readers' comments; inside a marked article only these count as ids, as authors name sections by ids.
FOREIGN = frozenset("ad ads advert adverts advertisement advertising comment comments commentlist respond disqus sponsored".split())
#: What is said of a part behind its name, and before it.
BEHIND = frozenset(
    "slot unit container wrapper wrap box block space zone frame placeholder label list thread threads form section area body bar button buttons icons tools widget notice banner popup message "
    "inner outer holder row item items panel module region group top bottom left right header title links link signup subscription subscribe consent policy main wide small large mobile desktop".split()
)
BEFORE = frozenset("user users reader readers visitor site page main top bottom side left right global primary secondary article post blog story mobile desktop sticky fixed header footer wp js the google dfp social".split())
TITLES = frozenset({"header", "banner"})
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

TOKEN = re.compile(
    r"<(?:!--(?:-?>|.*?--!?>|.*\Z)|[!?][^>]*+>|/([a-zA-Z][^\s/>]*+)[^>]*+>|([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([a-zA-Z][^\s/>]*+)([^>]*+)>)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    __slots__ = ("tag", "attributes", "parent", "inside", "digest", "shape", "depth", "in_p")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.depth: int = parent.depth + 1 if parent else 0
        self.in_p: bool = tag == "p" or (parent is not None and parent.in_p)
        self.inside: list[Node | str] = []
        self.digest = self.shape = 0

    def get(self) -> dict[str, str]:
        return {k.lower(): entities.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(self.attributes)} if self.attributes else {}


def parse(page: str) -> Node:
    """The tree of a page; end tags that the page leaves out are put where HTML puts them, stray ones are ignored."""
    top = now = Node("#page", "", None)
    at, length = 0, len(page)
    last_tag = page.rfind(">") + 1  # beyond, there are no tags to look for
    while at < length:
        m = TOKEN.search(page, at, last_tag)
        if m is None:
            now.inside.append(page[at:])
            break
        if m.start() > at:
            now.inside.append(page[at : m.start()])
        at = m.end()
        if page.startswith("<!--", m.start()) and not page.startswith(("-->", "--!>"), at - 3 - (page[at - 2] == "!")):
            break  # a comment without an end
        if end := m[1]:
            end = end.lower()
            up: Node | None = now
            while up is not None and up.tag != end:
                up = up.parent
            if up is not None and up.parent is not None:
                now = up.parent
            elif end == "br":
                now.inside.append(" ")
            continue
        tag = m[2] or m[4]
        if not tag:
            continue
        tag = tag.lower()
        attributes = (m[3] if m[2] else m[5]) or ""
        if tag in CLOSES_P and now.in_p:
            up = now
            while up.tag not in ("p", "#page", "td", "th", "button", "object"):
                up = up.parent
            if up.tag == "p":
                now = up.parent
        if tag in CLOSES:
            shut, stop = CLOSES[tag]
            up, last = now, None
            while up.parent is not None and up.tag not in stop:
                if up.tag in shut:
                    last = up
                up = up.parent
            if last is not None:
                now = last.parent
        if tag == "br" or tag == "wbr":
            if tag == "br":
                now.inside.append(" ")
            continue
        if now.depth >= DEPTH:
            now = now.parent
        node = Node(tag, attributes.strip(), now)
        now.inside.append(node)
        if tag in VOID or (node.attributes.endswith("/") and tag in ("svg", "math")):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else length
            continue
        now = node
    return top


def nodes(top: Node) -> list[Node]:
    """All elements, parents before children, in page order."""
    out, stack = [], [top]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(x for x in reversed(n.inside) if not isinstance(x, str))
    return out


def hashed(parts: list[str]) -> int:
    return xxhash.xxh64_intdigest("\x01".join(parts)) - (1 << 63)


def digests(all_nodes: list[Node]) -> None:
    """Hash each subtree: its tag, attributes, and what is inside, with white space made alike; and its shape, which has tags, classes, ids and roles alone."""
    for n in reversed(all_nodes):
        parts = [n.tag, n.attributes]
        shape = [n.tag, *(f"{k}={v}" for k, v in sorted(n.get().items()) if k in ("class", "id", "role"))]
        for x in n.inside:
            if isinstance(x, str):
                if x := " ".join(x.split()):
                    parts.append(x)
            else:
                parts.append(f"\x00{x.digest:x}")
                shape.append(f"\x00{x.shape:x}")
        n.digest, n.shape = hashed(parts), hashed(["\x02", *shape])


def called(name: str) -> set[str]:
    """What a class, id or role calls its part: all its words as one, and what is left without words that say where it is or what shape it has."""
    words = [w.lower() for w in WORD.findall(name)]
    out = {"".join(words)}
    while words and (words[-1] in BEHIND or words[-1].isdigit()):
        words.pop()
        out.add("".join(words))
    while len(words) > 1 and words[0] in BEFORE:
        words.pop(0)
        out.add("".join(words))
    return out


def furnished(n: Node) -> bool:
    """Whether half of a part's text, or more, is links, or it holds controls."""
    text = linked = 0
    stack: list[tuple[Node, bool]] = [(n, False)]
    while stack:
        x, link = stack.pop()
        if x.tag in ("form", "input", "button", "select", "textarea"):
            return True
        link = link or x.tag == "a"
        for y in x.inside:
            if isinstance(y, str):
                size = len("".join(y.split()))
                text, linked = text + size, linked + size * link
            else:
                stack.append((y, link))
    return 2 * linked >= text


def foreign(n: Node, inside: bool) -> bool:
    """Whether an element is no part of an article, by its tag or by what it is called. inside: it stands in a marked article."""
    if n.tag in DROPPED:
        return True
    header = n.tag == "header"
    if n.attributes:
        a = n.get()
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
            return True
        if n.tag in NAMED:
            names = {x for k in ("class", "role") for x in a.get(k, "").split()}
            said = set().union(*map(called, names)) if names else set()
            ids = set().union(*map(called, a.get("id", "").split())) if n.tag in HOLDERS and a.get("id") else set()
            inside = inside or n.tag == "article"
            if said & (FOREIGN if n.tag == "article" else STRONG) or ids & (FOREIGN if inside else STRONG):
                return True
            if (said | (set() if inside else ids)) & WEAK and n.tag != "article" and furnished(n):
                return True
            header = header or not inside and not TITLES.isdisjoint(x.lower() for x in (*names, *a.get("id", "").split()))
    if header:
        return not (inside and any(x.tag in HEADINGS for x in nodes(n)))
    return False


def main_parts(top: Node) -> tuple[list[Node], set[int]]:
    """The elements that hold the text, in page order, and the ids of elements that aren't part of it.

    All main parts, whole, and the outermost articles that stand in none; if neither is marked, the whole page.
    """
    out: set[int] = set()
    found: list[Node] = []
    stack: list[tuple[Node, bool, bool]] = [(top, False, False)]
    while stack:
        n, inside, main = stack.pop()
        if n.parent is not None and foreign(n, inside):
            out.add(id(n))
            continue
        if not inside:
            role = n.attributes and n.get()
            if n.tag == "article" or (role and role.get("itemprop") == "articleBody"):
                inside = True
                if not main:
                    found.append(n)
            elif not main and (n.tag == "main" or (role and role.get("role") == "main")):
                found.append(n)
                main = True
        stack.extend((x, inside, main) for x in reversed(n.inside) if not isinstance(x, str))
    return found or [top], out


def lines(page: str) -> list[tuple[str, list[int]]]:
    """The blocks of the page's text in page order, each with the digests of the subtrees around it that may be template.

    Only blocks count, as a word in bold that recurs is part of its sentence. Inside an article a
    plain element (without class, id or role) is the author's and never template, as authors
    repeat passages; where no article is marked, any is. A named holder that is mostly links
    counts by its shape too, as menus and adverts change their words from page to page.
    """
    top = parse(page)
    digests(nodes(top))
    roots, out = main_parts(top)
    marked = roots != [top]
    found: list[tuple[str, list[int]]] = []
    line: list[str] = []
    around: list[int] = []

    def end() -> None:
        if text := " ".join(entities.unescape("".join(line)).split()):
            found.append((text, list(around)))
        line.clear()

    for r in roots:
        stack: list[Node | str | int] = [r]
        while stack:
            n = stack.pop()
            if isinstance(n, int):
                end()
                del around[len(around) - n :]
            elif isinstance(n, str):
                line.append(n)
            elif id(n) not in out:
                if n.tag in BLOCK or n.tag == "#page":
                    end()
                    named = n.attributes != "" and not {"class", "id", "role"}.isdisjoint(n.get())
                    counts = n is not r and n.tag not in ("html", "body", "main") and (not marked or named)
                    added = 0
                    if counts:
                        around.append(n.digest)
                        added = 1
                        if named and n.tag in HOLDERS and furnished(n):
                            around.append(n.shape)
                            added = 2
                    stack.append(added)
                stack.extend(reversed(n.inside))
        end()
    return found


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def parsed(pages: DataFrame) -> DataFrame:
    """(row, page_id, url, host, content, text, lines) of each row: content is a hash of all its blocks of text. A page without a
    subtree that may be template has its whole text in text, any other its blocks with the digests around them in lines."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf, "html"):
                found = [lines(page) for page in part["html"]]
                content = [xxhash.xxh64_intdigest("\n".join(t for t, _ in x).encode("utf-8", "replace")) - (1 << 63) for x in found]
                own = part.drop(columns="html")
                own["content"] = pd.Series(content, index=own.index, dtype="int64")
                sure = [not any(d for _, d in x) for x in found]
                own["text"] = pd.Series(["\n".join(t for t, _ in x) if y else None for x, y in zip(found, sure, strict=True)], index=own.index, dtype=object)
                own["lines"] = pd.Series([None if y else [{"text": t, "around": d} for t, d in x] for x, y in zip(found, sure, strict=True)], index=own.index, dtype=object)
                yield own

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", F.xxhash64(host(F.col("url"))).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    schema = "page_id string, url string, host long, content long, text string, lines array<struct<text: string, around: array<long>>>"
    return rows.mapInPandas(read, schema).withColumn("row", F.monotonically_increasing_id())


def extract(pages: DataFrame) -> DataFrame:
    """Every row of pages as page_id, url, text, n_chars.

    A host's template is what recurs on SHARE of its different pages, LEAST at least, or on MANY of
    them; pages of equal text are one page, however many rows, urls or mirrors they have. These
    subtrees are deleted, as are elements that by tag, class, id or role aren't an article's. A
    null html is an empty one and gives an empty text; a null url belongs to a nameless host;
    equal rows all stay.
    """
    table, _ = stored(parsed(pages))
    open_ = table.where("lines is not null")
    found = open_.select("row", "host", "content", F.explode(F.array_distinct(F.flatten("lines.around"))).alias("digest"))
    sizes = table.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = found.select("host", "digest", "content").distinct().groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)
    template = counts.join(sizes, "host").where((F.col("n") >= SHARE * F.col("pages")) | (F.col("n") >= MANY)).select("host", "digest")
    flags = found.join(template, ["host", "digest"]).groupBy("row").agg(F.collect_set("digest").alias("flags"))
    kept = F.filter("lines", lambda x: F.col("flags").isNull() | ~F.arrays_overlap(x["around"], F.col("flags")))
    text = F.array_join(F.transform(kept, lambda x: x["text"]), "\n")
    rows = open_.select("row", "page_id", "url", "lines").join(flags, "row", "left").select("page_id", "url", text.alias("text"))
    rows = rows.unionByName(table.where("lines is null").select("page_id", "url", "text"))
    return rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
