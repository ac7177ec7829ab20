"""The main text of web pages, with what a site repeats on many pages taken out.

Every element outside the prose of an article is hashed with all that it contains. Spark counts on
how many pages of a host each hash stands, and elements that stand on many of them are the site's
template and are deleted. What is left loses the parts that are never article text by their tag,
their role or the words in their class and id.

The tag library has no record with markup, so this operator is general: its records are pages with
`page_id`, `url` and `html`.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tagspark.llm.texts import GAP
from tagspark.session import cut_lineage

# An element is template if it stands on so many pages of its host, and on this share of them.
MIN_PAGES = 3
MIN_SHARE = 0.25

# ---- fixed values: how HTML names its elements ----------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre "
    "search section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body caption html legend option tbody td tfoot th thead title tr".split())
# An element ends when one of these begins, unless one of the others stands between them.
ENDED_BY = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
SCOPES = frozenset("article aside body button caption div footer header html main nav section table td th".split())
ARTICLE = frozenset(("article", "main"))
PROSE = frozenset("b blockquote br caption code dd dl dt em figcaption figure h1 h2 h3 h4 h5 h6 i li ol p pre q span strong sub sup table tbody td tfoot th thead tr ul a".split())

# ---- fixed values: what is not article text -------------------------------------------------
NEVER = frozenset(
    "aside audio button canvas dialog embed footer form head iframe input map menu nav noscript object "
    "script search select style svg template textarea video".split()
)
COMMENTS = frozenset(("comment", "comments", "reply", "replies"))
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice "
    "notices notification outbrain pagination paywall popup promo promotion recommended related replies "
    "reply share sharing sidebar signup skip social sponsor sponsored subscribe taboola toc toolbar widget".split()
)


OF_OTHERS = frozenset(("has", "no", "with", "without"))
IN_HEAD = frozenset("base head link meta noscript script style template title".split())
PARAGRAPHS = frozenset(("blockquote", "p", "pre"))


class _Element:
    __slots__ = ("tag", "number", "parts", "drop", "article", "holds", "soft", "comments")

    def __init__(self, tag: str, number: int, drop: bool, article: bool) -> None:
        self.tag, self.number, self.drop, self.article = tag, number, drop, article
        self.holds = False  # has an article inside
        self.soft = False  # is dropped for its words or for being a form, unless it holds the page's text
        self.comments = False  # says that it is readers' comments
        self.parts: list[str | _Element] = []


def _dropped(tag: str, attributes: list[tuple[str, str | None]], in_article: bool) -> bool:
    if tag in NEVER or (tag == "header" and not in_article):
        return True
    return _named_so(tag, attributes) or _hidden(attributes)


def _class_words(attributes: list[tuple[str, str | None]]) -> set[str]:
    """Words of class and id; what stands after "has", "no", "with" or "without" in one name is not what the element is."""
    words: set[str] = set()
    for key, value in attributes:
        if key in ("class", "id"):
            for name in (value or "").lower().split():
                for word in name.replace("_", "-").split("-"):
                    if word in OF_OTHERS:
                        break
                    words.add(word)
    return words


def _named_so(tag: str, attributes: list[tuple[str, str | None]]) -> bool:
    words = _class_words(attributes)
    if tag in ("main", "html", "body"):
        words = set()
    elif tag == "article":  # a reader's comment may be one, a notice or a sidebar is not
        words &= COMMENTS
    return bool(words & WORDS)


def _hidden(attributes: list[tuple[str, str | None]]) -> bool:
    values = dict(attributes)
    return (
        (values.get("role") or "").lower() in ROLES
        or "hidden" in values
        or values.get("aria-hidden") == "true"
        or "display:none" in (values.get("style") or "").replace(" ", "").lower()
    )


class Tree(HTMLParser):
    """A page as a tree; elements are numbered as they begin, and left-out end tags are put in."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Element("", -1, False, False)
        self.open = [self.root]
        self.count = 0
        self.softs: list[_Element] = []
        self.feed(html)
        self.close()
        self._keep_wrappers()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body" or (self.open[-1].tag == "head" and tag not in IN_HEAD):
            self._end(("head",), frozenset())
        if tag in CLOSES_P:
            self._end(("p",), SCOPES)
        if tag in ENDED_BY:
            self._end(*ENDED_BY[tag])
        parent = self.open[-1]
        element = _Element(tag, self.count, _dropped(tag, attrs, parent.article), parent.article or tag in ARTICLE)
        self.count += 1
        element.soft = element.drop and not _hidden(attrs) and (tag == "form" or tag not in NEVER | {"header"})
        element.comments = bool(_class_words(attrs) & COMMENTS)
        if element.soft:
            self.softs.append(element)
        parent.parts.append(element)
        if tag in ARTICLE:
            for outer in self.open:
                outer.holds = True
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # "/>" ends nothing but void elements

    def handle_endtag(self, tag: str) -> None:
        self._end((tag,), frozenset() if tag in SCOPES else SCOPES)

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)

    def _end(self, tags, stop) -> None:
        for place in range(len(self.open) - 1, 0, -1):
            if self.open[place].tag in tags:
                del self.open[place:]
                return
            if self.open[place].tag in stop:
                return

    def _keep_wrappers(self) -> None:
        """Forms and elements with telling words stay if they hold an article that is text, or most of a page's prose."""
        if not self.softs:
            return
        order, stack = [], [(self.root, False, False)]
        while stack:  # elements with whether they are lost for good, and whether they are part of a paragraph
            element, lost, written = stack.pop()
            lost = lost or (element.drop and not element.soft)
            written = written or element.tag in PARAGRAPHS
            order.append((element, lost, written))
            stack.extend((p, lost, written) for p in element.parts if isinstance(p, _Element))
        words: dict[int, int] = {}
        prose: dict[int, int] = {}
        articles: set[int] = set()
        mains: set[int] = set()
        for element, lost, written in reversed(order):
            inside = [p.number for p in element.parts if isinstance(p, _Element)]
            if not lost and (element.tag == "main" or not mains.isdisjoint(inside)):
                mains.add(element.number)
            # What readers write is no text, also where it is an article, unless the main part is in it.
            lost = lost or (element.soft and element.comments and element.number not in mains)
            own = sum(len(p.split()) for p in element.parts if isinstance(p, str))
            words[element.number] = 0 if lost else own + sum(words[n] for n in inside)
            prose[element.number] = 0 if lost else own * written + sum(prose[n] for n in inside)
            if not lost and ((element.tag in ARTICLE and not element.drop) or not articles.isdisjoint(inside)):
                articles.add(element.number)
        for element in self.softs:
            element.drop = element.number not in articles and 2 * prose[element.number] <= words[-1]

    @property
    def tops(self) -> list[_Element]:
        """Where the text stands: outermost articles that are not dropped, or else the whole page."""
        stack, found = [self.root], []
        while stack:
            element = stack.pop()
            if element.tag in ARTICLE and not element.drop:
                found.append(element)
            elif not element.drop:
                stack.extend(p for p in reversed(element.parts) if isinstance(p, _Element))
        return found or [self.root]


def _may_be_template(element: _Element) -> bool:
    """Articles, what they stand in and their prose are not template.

    Pages that share an article, or articles that share a paragraph, have that text in common.
    """
    shared = element.tag in ARTICLE or element.holds or (element.article and element.tag in PROSE)
    return not shared and element.tag not in ("", "html", "body")


def _hash_subtree(top: _Element, hashes: dict[int, int]) -> None:
    """Hash of an element and of all below it; no recursion, pages may nest deeply."""
    stack = [(top, False)]
    while stack:
        element, ends = stack.pop()
        if not ends:
            stack.append((element, True))
            stack.extend((p, False) for p in element.parts if isinstance(p, _Element))
            continue
        inside = [
            hashes[p.number].to_bytes(8) if isinstance(p, _Element) else b" ".join(p.encode("utf-8", "replace").split())
            for p in element.parts
        ]
        hashes[element.number] = xxhash.xxh64_intdigest(b"\x1f".join([element.tag.encode(), *inside])) >> 1


def subtree_hashes(tree: Tree) -> dict[int, int]:
    """Number of the element -> hash of its subtree, for each element that may be template."""
    hashes: dict[int, int] = {}
    stack = [tree.root]
    while stack:
        element = stack.pop()
        if _may_be_template(element):
            _hash_subtree(element, hashes)
        else:
            stack.extend(p for p in element.parts if isinstance(p, _Element))
    return hashes


def text_runs(tree: Tree, hashes: dict[int, int]) -> list[tuple[str, list[int]]]:
    """The text in page order: runs of it with the elements around them that may be template."""
    runs: list[tuple[list[str], list[int]]] = []
    stack: list[tuple[_Element | str, list[int]]] = [(top, []) for top in reversed(tree.tops)]
    while stack:
        part, around = stack.pop()
        if isinstance(part, str):
            if runs and runs[-1][1] is around:
                runs[-1][0].append(part)
            else:
                runs.append(([part], around))
        elif not part.drop:
            within = [*around, part.number] if part.number in hashes else around
            inside = [(p, within) for p in reversed(part.parts)]
            edge = [(" ", around)] if part.tag in BLOCKS or part.tag == "br" else []
            stack.extend([*edge, *inside, *edge])
    return [("".join(texts), around) for texts, around in runs]


def page_texts(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text and n_chars (its code points) of every row of `pages` (page_id, url, html).

    Character references are decoded, white space (ASCII) inside a block becomes one space, and
    blocks are joined in page order by one space. The host is what stands between `//` and the
    next `/`, `?`, `#` or `:` of the url in lower case; pages whose url is null or has none
    share no template. A null html is an empty page with an empty text. Repeated rows are pages of
    their own, which may make them template to each other outside articles; null ids are kept,
    further columns are ignored, and an empty table gives no rows.

    Only hashes are grouped: they are counted per host before the shuffle, and a host with most
    pages is joined by (host, hash), where each hash of a host stands once.
    """
    host = F.nullif(F.lower(F.regexp_extract("url", r"//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), "page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html")
    )
    parsed = cut_lineage(rows.mapInArrow(_parse_pages, _PARSED_SQL), "parsed-pages")
    sizes = parsed.groupBy("host").agg(F.count("*").alias("n_pages"))
    # Only a page with text inside an element that may be template has to learn which ones are.
    asks = F.exists("runs", lambda run: F.size(run["around"]) > 0)
    elements = parsed.where("host is not null").select("row", "host", asks.alias("asks"), F.inline("elements"))
    # An element that stands twice on a page counts once.
    counts = elements.where("first").groupBy("host", "hash").agg(F.count("*").alias("n"))
    template = counts.join(sizes, "host").where((F.col("n") >= min_pages) & (F.col("n") >= min_share * F.col("n_pages")))
    template = cut_lineage(template.select("host", "hash"), "template")
    deleted = (
        elements.where("asks")
        .join(template, ["host", "hash"], "left_semi")
        .groupBy("row")
        .agg(F.collect_list("number").alias("deleted"))
    )
    stays = F.filter("runs", lambda run: ~F.arrays_overlap(run["around"], F.coalesce("deleted", F.array().cast("array<int>"))))
    asking = parsed.where(asks).join(deleted, "row", "left").select("page_id", "url", _text_of(stays).alias("text"))
    settled = parsed.where(~asks).select("page_id", "url", _text_of(F.col("runs")).alias("text"))
    return settled.unionByName(asking).withColumn("n_chars", F.length("text").cast("bigint"))


def _text_of(runs: Column) -> Column:
    """Between blocks and inside them one space is what is left of all white space."""
    joined = F.array_join(F.transform(runs, lambda run: run["text"]), "")
    return F.trim(F.regexp_replace(joined, GAP + "+", " "))


_PARSED = pa.schema(
    [
        ("row", pa.int64()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("host", pa.string()),
        ("elements", pa.list_(pa.struct([("number", pa.int32()), ("hash", pa.int64()), ("first", pa.bool_())]))),
        ("runs", pa.list_(pa.struct([("text", pa.string()), ("around", pa.list_(pa.int32()))]))),
    ]
)
_PARSED_SQL = (
    "row bigint, page_id bigint, url string, host string, elements array<struct<number: int, hash: bigint, first: boolean>>, "
    "runs array<struct<text: string, around: array<int>>>"
)


def _parse_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        elements, runs = [], []
        for html in batch.column("html").to_pylist():
            tree = Tree(html)
            hashes = subtree_hashes(tree)
            seen: set[int] = set()
            own = []
            for number, value in hashes.items():
                own.append({"number": number, "hash": value, "first": value not in seen})
                seen.add(value)
            elements.append(own)
            runs.append([{"text": text, "around": around} for text, around in text_runs(tree, hashes)])
        kept = [batch.column(name).cast(_PARSED.field(name).type) for name in ("row", "page_id", "url", "host")]
        lists = [pa.array(x, _PARSED.field(n).type) for n, x in (("elements", elements), ("runs", runs))]
        yield pa.RecordBatch.from_arrays([*kept, *lists], schema=_PARSED)
