"""Main text of web pages by paths on which the pages of a host agree.

First every page scores its own containers: an element's content is the text of the blocks inside it that are not
boilerplate by tag, role or class, less the text of links; a form is boilerplate unless it holds most of the page's
text. Its vote goes to the generalised path (tags and
classes without digits from the body down) of the smallest element that holds nearly all content, widened to the heading.
Spark counts the votes per host. Then every page is cut anew: at the best path of its host that it has, or, where it has
none of them, at its own choice. So a page whose own score misleads follows the other pages of its host.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.session import cut

# What HTML says about elements, and the usual names of what is not content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt rtc s samp small "
                   "span strike strong sub sup time tt u var wbr nobr".split())
SKIPPED = frozenset("nav footer aside button select option datalist fieldset menu dialog head".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hgroup hr main menu nav ol p pre section table ul li dt dd".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table tbody thead tfoot div section article main body html td th tr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
BOILERPLATE = re.compile(
    r"(?:^|[\s_\-])(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|ads?|advert\w*|banner|sponsor\w*|promo\w*|"
    r"cookies?|consent|notices?|alerts?|popup|modal|overlay|newsletter|subscri\w+|signup|login|share|sharing|social|related|recommend\w*|"
    r"comments?|respond|disqus|replies|widgets?|pagination|pager|tags|toolbar|skip|hidden|copyright|legal|disclaimer|search\w*|form)(?:$|[\s_\-])")
#: Articles are named for their subject or state ("tag-search comments-open"), so only names of comments themselves count.
COMMENT = re.compile(r"(?:^|\s)(?:(?:div|js|wp|user)[_\-]+)?(?:comments?|repl(?:y|ies)|responses?|disqus)"
                     r"(?:[_\-]+(?:body|item|content|entry|text|wrapper|list|\d+))?(?:$|\s)")
GOOD = re.compile(r"(?:^|[\s_\-])(?:article|content|main|post|entry|story|text|body)(?:$|[\s_\-])")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: An element is the container if it holds this share of the page's content; paths with fewer than 1 in 50 of the host's votes don't win.
SHARE, LEAST_VOTES = 0.9, 0.02
#: An article with the page's heading, and a main, need this share only, if other containers don't hold more.
DECLARED_SHARE = 1 / 3


class _Element:
    """An open tag. What would need a walk up the ancestors is handed down instead, so that deep pages cost linear time.

    ``block``: the nearest element that is not inline; ``scope``: the nearest that ends the search for an open p; ``item``: the nearest
    that may end the search for an item of its kind; ``path`` numbers the generalised path, ``length`` is its characters.
    """

    __slots__ = ("tag", "name", "parent", "index", "depth", "path", "length", "skipped", "link", "heading", "form", "article", "block", "scope", "item")

    def __init__(self, tag: str, name: str, parent: _Element | None, index: int, path: int, skipped: bool) -> None:
        self.tag, self.name, self.parent, self.index, self.path, self.skipped = tag, name, parent, index, path, skipped
        self.heading = False
        if parent is None:
            self.depth = self.length = 0
            self.link = self.article = False
            self.form = self.scope = self.item = None
            self.block = self
            return
        self.depth = parent.depth + 1
        self.length = parent.length + (parent.length > 0) + len(name)
        self.link = tag == "a" or parent.link
        self.article = tag in ("article", "main") or parent.article
        self.form = self if tag == "form" else parent.form
        self.block = parent.block if tag in INLINE else self
        self.scope = self if tag in SCOPES or tag == "p" else parent.scope
        self.item = self if tag in SCOPES or tag in SAME else parent.item

    def written_path(self) -> str:
        names, at = [], self
        while at.parent is not None:
            names.append(at.name)
            at = at.parent
        return ">".join(reversed(names))


class Page:
    """The elements of a page in page order, parents first, and its text blocks: (element that holds it, text, how much of that is links)."""

    def __init__(self) -> None:
        self.elements = [_Element("", "", None, 0, 0, False)]
        self.blocks: list[tuple[_Element, str, int]] = []
        self._paths: dict[tuple[int, str], int] = {}

    def open(self, tag: str, name: str, parent: _Element, skipped: bool) -> _Element:
        path = self._paths.setdefault((parent.path, name), len(self._paths) + 1)
        self.elements.append(_Element(tag, name, parent, len(self.elements), path, skipped))
        return self.elements[-1]

    def path(self, written: str) -> int | None:
        """The number of a path; None if the page has none such."""
        at: int | None = 0
        for name in written.split(">"):
            at = self._paths.get((at, name))
            if at is None:
                return None
        return at

    def inside(self, path: int) -> list[str]:
        """The texts of the blocks in elements of the path."""
        within = [path == 0] * len(self.elements)
        for e in self.elements[1:]:
            within[e.index] = e.path == path or within[e.parent.index]
        return [t for e, t, _ in self.blocks if within[e.index]]


def _name(tag: str, attributes: str, parent: _Element) -> tuple[str, bool]:
    """The generalised name of an element, and whether it is boilerplate."""
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    classes = html.unescape(found.get("class", "")).lower()
    name = (tag + "".join(sorted({"." + re.sub(r"\d+", "#", c) for c in classes.split()}))).replace(">", "&gt;")
    skipped = tag in SKIPPED or (tag == "header" and not parent.article)
    role = found.get("role", "").lower()
    skipped |= (role in ROLES and (tag, role) != ("form", "form")) or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    skipped |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))
    words = f"{classes} {found.get('id', '').lower()}"
    if tag == "form":  # that it is one says nothing yet, see _kept_forms
        words = re.sub(r"\bform\b", "", words)
    if tag == "article":
        skipped |= bool(COMMENT.search(words))
    elif tag not in ("body", "html", "main", "h1") and words.strip():
        skipped |= bool(BOILERPLATE.search(re.sub(r"\s+", "  ", words))) and not (GOOD.search(words) and not re.search(r"comment|sidebar|nav|menu|footer|\bads?\b", words))
    return name, skipped


def _dropped_forms(page: Page) -> set[int]:
    """The forms that are boilerplate, with those in them: all but forms that hold most of the page's text, as where a form wraps the whole body."""
    forms = [e for e in page.elements if e.tag == "form"]
    whole, own = 0, dict.fromkeys((f.index for f in forms), 0)
    for owner, text, linked in page.blocks:
        size = max(0, len(text) - linked)
        whole += size
        if owner.form is not None:
            own[owner.form.index] += size
    for form in reversed(forms):
        if form.parent.form is not None:
            own[form.parent.form.index] += own[form.index]
    dropped: set[int] = set()
    for form in forms:
        if 2 * own[form.index] <= whole or (form.parent.form is not None and form.parent.form.index in dropped):
            dropped.add(form.index)
    return dropped


def parsed(page: str) -> Page:
    """The elements and text blocks of a page. White space is single, no block is empty.

    Elements that open without their end tags, end tags without elements, and markup cut off by the end of the page are
    taken as browsers take them, as far as blocks and boilerplate need it. Time and memory are linear in the page, however deep it nests.
    """
    out = Page()
    root = here = out.elements[0]
    at = 0
    text: list[str] = []
    owner, linked = root, 0
    headings: list[_Element] = []
    opened: Counter[str] = Counter()  # open elements by tag

    def back_to(element: _Element) -> None:
        nonlocal here
        while here is not element:
            opened[here.tag] -= 1
            here = here.parent

    def flush() -> None:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.blocks.append((owner, whole, linked))
            text.clear()

    def add(piece: str) -> None:
        nonlocal owner, linked
        if piece and not here.skipped:
            if not text:
                owner, linked = here.block, 0
            text.append(piece)
            if here.link:
                linked += len(piece)

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or m[4] == "":  # comments, declarations, and a tag that the end of the page cuts off
            continue
        if m[1]:
            if tag not in INLINE:
                flush()
            if opened[tag]:
                while here.tag != tag:
                    back_to(here.parent)
                back_to(here.parent)
            elif tag == "br":
                add(" ")
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P and here.scope is not None and here.scope.tag == "p":
                back_to(here.scope.parent)
            if tag in SAME:
                item = here.item
                while item is not None and item.tag not in SAME[tag] and item.tag not in SCOPES:
                    item = item.parent.item
                while item is not None and item.tag in SAME[tag]:
                    back_to(item.parent)
                    item = here if tag == "tr" else None
        if tag in VOID:
            if tag == "br":
                add(" ")
            continue
        name, skipped = _name(tag, m[3], here)
        here = out.open(tag, name, here, skipped or here.skipped)
        opened[tag] += 1
        if tag == "h1" and not here.skipped:
            headings.append(here)
    flush()
    dropped = _dropped_forms(out)
    for heading in headings:
        scope = None if heading.form is not None and heading.form.index in dropped else heading.parent
        while scope is not None and not scope.heading:
            scope.heading = True
            scope = scope.parent
    out.blocks = [b for b in out.blocks if b[0].form is None or b[0].form.index not in dropped]
    return out


def choose(page: Page) -> _Element | None:
    """The container of a page by its own score; the text of links is no content."""
    if not page.blocks:
        return None
    own, held = [0] * len(page.elements), [False] * len(page.elements)
    for owner, text, linked in page.blocks:
        own[owner.index] += max(0, len(text) - linked)
        held[owner.index] = True
    total = list(own)
    for e in reversed(page.elements[1:]):
        total[e.parent.index] += total[e.index]
        held[e.parent.index] |= held[e.index]
    whole = total[0]

    def elsewhere(element: _Element) -> int:
        """The content in containers that neither hold the element nor lie in it."""
        above, contained, size = [False] * len(own), [False] * len(own), 0
        scope: _Element | None = element
        while scope is not None:
            above[scope.index] = True
            scope = scope.parent
        lies_in = [False] * len(own)
        lies_in[element.index] = True
        for e in page.elements[1:]:
            if above[e.index]:
                continue
            lies_in[e.index] = lies_in[e.parent.index]
            contained[e.index] = not lies_in[e.index] and (contained[e.parent.index] or (e.tag not in INLINE and e.tag not in ("p", "h1")))
            if contained[e.index]:
                size += own[e.index]
        return size

    def declared(e: _Element) -> bool:
        size = total[e.index]
        return size >= SHARE * whole or ((e.heading or e.tag == "main") and size >= DECLARED_SHARE * whole and size >= elsewhere(e))

    main = [e for e in page.elements if held[e.index] and e.tag in ("article", "main")]
    for e in sorted(main, key=lambda e: (-total[e.index], -e.length)):
        if declared(e):  # the page says itself what its main text is
            return e
    holding = [e for e in page.elements if held[e.index] and total[e.index] >= SHARE * whole and e.tag not in INLINE and e.tag not in ("p", "h1")]
    deepest = max((e.depth for e in holding), default=0)
    first: dict[int, _Element] = {}
    for e in holding:
        if e.depth == deepest:
            first.setdefault(e.path, e)
    best = max(first.values(), key=_Element.written_path, default=None)
    while best is not None and not best.heading and best.parent is not None and best.parent.tag not in ("", "html", "body"):
        if not best.parent.heading:
            break
        best = best.parent
    return best


def extract(page: str, paths: list[str]) -> tuple[str, str]:
    """(text, path): the blocks inside the first of ``paths`` that the page has, else inside its own choice."""
    whole = parsed(page)
    for written in paths:
        path = whole.path(written)
        inside = whole.inside(path) if path is not None else []
        if inside:
            return "\n".join(inside), written
    own = choose(whole)
    if own is None:
        return "", ""
    return "\n".join(whole.inside(own.path)), own.written_path()


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths = [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = choose(parsed(page or ""))
            if own is not None and own.parent is not None:
                hosts.append(host)
                paths.append(own.written_path())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], ["host", "path"])


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(p or "", w or []) for p, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([t for t, _ in texts], pa.string()), pa.array([p for _, p in texts], pa.string())],
            ["page_id", "url", "text", "path"])


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, paths): the winning container paths of each host, most votes first; by the share that a path needs, at most fifty."""
    votes = pages.select(_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(_votes, "host string, path string")
    votes = cut(votes.groupBy("host", "path").agg(F.count("*").alias("votes")), "votes")
    cast = votes.groupBy("host").agg(F.sum("votes").alias("cast"))
    won = votes.join(cast, "host").filter(F.col("votes") >= F.col("cast") * LEAST_VOTES)
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path")))
    return won.groupBy("host").agg(F.transform(ranked, lambda x: x.path).alias("paths"))


def _host(url: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")), F.lit(""))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: its id, url, text and path (the container's, empty if none).

    Blocks keep page order and are joined by one newline; white space inside a block becomes one space; character
    references are decoded. A null or empty html, or one without content, gives an empty text. Pages without a readable
    host, null urls included, vote together. Null ids and repeated rows are pages of their own; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    won = cut(host_paths(rows), "host_paths")  # a file's size lets Spark choose how to join
    joined = rows.withColumn("host", _host(F.col("url"))).join(won, "host", "left").select("page_id", "url", "html", "paths")
    out = joined.mapInArrow(_cuts, "page_id long, url string, text string, path string")
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", "path")
