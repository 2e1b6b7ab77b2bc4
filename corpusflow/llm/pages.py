"""Main text of web pages, with site templates found by counting element subtrees per host."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.session import broadcast_if_small, cut_lineage, is_small

#: A subtree is a template if it stands on so many different pages of its host, whatever the size of the host.
MIN_PAGES = 5
#: So many templates go to every task; more are joined to the subtrees of the pages.
MAX_SENT = 200_000
#: Templates on so many pages, and pages with so many copies, are joined apart from the rest.
HOT = 10_000

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
MAIN = frozenset(["article", "main"])
#: Never part of the main text.
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form frame frameset head iframe input map menu nav "
    "noembed noframes noscript object option script select style svg template textarea title video".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id names of parts that are not the article.
MARKS = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices outbrain overlay pager pagination paywall popup promo promoted promotion recommended related "
    "replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription taboola toolbar "
    "topbar trending widget".split()
)
#: Of these, the names that an article's own parts also carry.
ARTICLE_PARTS = frozenset("header copyright notice notices".split())

#: Elements inside a line of text; what they are called says nothing about the text.
INLINE = frozenset(
    "a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strong sub sup "
    "time tt u var".split()
)
#: Boxes inside an article that may be site templates; a paragraph, a heading or a list item is none.
BOXES = frozenset("center details div dl figure ol section table ul".split())
#: Words in the names of an aside that quotes the article.
QUOTES = frozenset("pullquote pull quote blockquote".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s/=>]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"

# Which open elements a start tag ends, and what stops the search.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
P_STOPS = frozenset("article aside body button caption div footer header html main nav section table td th".split())


@dataclass
class Page:
    """Elements in document order (0 is the document) and runs of text."""

    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    dropped: list[bool] = field(default_factory=lambda: [False])
    in_main: list[bool] = field(default_factory=lambda: [False])
    content: list[list[bytes]] = field(default_factory=lambda: [[]])
    digests: list[int] = field(default_factory=lambda: [0])
    #: element, block number, text
    runs: list[tuple[int, int, str]] = field(default_factory=list)


#: What says that an element is no article text: nothing, a word in a longer class or id name, a whole name, or something else.
KEPT, WORD, NAME, SURE = range(4)


def _attributes(source: str) -> dict[str, str]:
    """Values by lower-case name; the first of a name counts, one without a value is empty."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), "".join(values))
    return out


def _unwanted(tag: str, attributes: str, inside: bool, code: bool) -> int:
    """What the tag and the attributes say; ``inside`` an article or main element, in ``code``.

    Inside an article only a whole class or id name counts, so "related-work" or
    "share-price" remove nothing, and no name counts on an element inside a line
    or in code.
    """
    named = _attributes(attributes) if attributes else {}
    names = f"{named.get('class', '')} {named.get('id', '')}"
    if tag == "aside" and inside and not QUOTES.isdisjoint(w.lower() for w in _WORD.findall(names)):
        return KEPT
    if tag in DROPPED or (tag == "header" and not inside):
        return SURE
    if not named or tag in ("html", "body"):
        return KEPT
    if "hidden" in named or named.get("aria-hidden", "").lower() == "true" or named.get("role", "").lower() in ROLES:
        return SURE
    if tag == "main" or tag in INLINE or code:
        return KEPT
    marks = MARKS - ARTICLE_PARTS if inside or tag == "article" else MARKS
    if not marks.isdisjoint(names.lower().split()):
        return NAME
    return KEPT if inside or marks.isdisjoint(w.lower() for w in _WORD.findall(names)) else WORD


def _dropped(page: Page, signs: list[int], within: list[bool]) -> list[bool]:
    """What goes by its tag and attributes, with all that it holds.

    A class or id does not remove the article: an element that is or holds an
    article (not one within another article) or, on pages without, a main
    element, stays if the mark is a word of a longer name ("no-sidebar"). A whole
    name ("comments") removes it only if another article is left.
    """
    parents, n = page.parents, len(page.tags)
    sure = [False] * n
    for e in range(1, n):
        sure[e] = sure[parents[e]] or signs[e] == SURE
    kinds = {t: [e for e in range(1, n) if page.tags[e] == t and not sure[e] and not within[e]] for t in MAIN}
    holds = [False] * n

    def mark(elements: list[int]) -> None:
        for e in elements:
            while e > 0 and not holds[e]:
                holds[e] = True
                e = parents[e]

    mark(kinds["article"])
    articles = kinds["article"] + [e for e in kinds["main"] if not holds[e]]
    mark(articles)

    def gone(least: int) -> list[bool]:
        out = [False] * n
        for e in range(1, n):
            out[e] = out[parents[e]] or signs[e] >= (least if holds[e] else WORD)
        return out

    out = gone(NAME)
    return gone(SURE) if articles and all(out[e] for e in articles) else out


def parse(source: str) -> Page:
    """One pass over the markup: elements with the hash of their subtree, and the runs of text between tags.

    End tags that authors may leave out are supplied; markup that never ends
    runs to the end of the page. Work grows with the page's length.
    """
    import xxhash

    page, open_, block, at = Page(), [0], 0, 0
    signs, within = [KEPT], [False]  # by element: what its tag and attributes say, an article around it
    depths: dict[str, int] = {}  # open elements by tag
    digest = xxhash.xxh3_64_intdigest

    def text(raw: str) -> None:
        if raw:
            value = entities.unescape(raw) if "&" in raw else raw
            page.runs.append((open_[-1], block, value))
            words = value.split()
            if words:
                page.content[open_[-1]].append(" ".join(words).encode("utf-8", "surrogatepass"))

    def close() -> None:
        nonlocal block
        element = open_.pop()
        depths[page.tags[element]] -= 1
        own = b"\x01".join([page.tags[element].encode(), *page.content[element], b"\x02"])
        value = page.digests[element] = digest(own) if page.content[element] else 0
        page.content[element] = []
        if value:
            page.content[open_[-1]].append(value.to_bytes(8, "big"))
        if page.tags[element] in BLOCK:
            block += 1

    def close_to(ends: frozenset, stops: frozenset) -> None:
        for depth in range(len(open_) - 1, 0, -1):
            tag = page.tags[open_[depth]]
            if tag in ends:
                while len(open_) > depth:
                    close()
                return
            if tag in stops:
                return

    length = len(source)
    while at < length:
        found = _TOKEN.search(source, at)
        if found is None:
            text(source[at:])
            break
        text(source[at : found.start()])
        at = found.end()
        tag = found.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if found.group(1):
            if depths.get(tag):
                while page.tags[open_[-1]] != tag:
                    close()
                close()
            continue
        if tag in CLOSES and any(depths.get(t) for t in CLOSES[tag][0]):
            close_to(*CLOSES[tag])
        elif tag in BLOCK and depths.get("p"):
            close_to(frozenset(["p"]), P_STOPS)
        if tag == "br":
            page.runs.append((open_[-1], block, " "))
        if tag in BLOCK:
            block += 1
        if tag in VOID:
            continue
        parent = open_[-1]
        page.tags.append(tag)
        page.parents.append(parent)
        code = bool(depths.get("pre") or depths.get("code"))
        signs.append(_unwanted(tag, found.group(3), page.in_main[parent], code))
        within.append(within[parent] or page.tags[parent] == "article")
        page.in_main.append(page.in_main[parent] or tag in MAIN)
        page.content.append([])
        page.digests.append(0)
        if found.group(3).endswith("/") and tag in ("svg", "path"):
            continue
        open_.append(len(page.tags) - 1)
        depths[tag] = depths.get(tag, 0) + 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
            at = end.start() if end else length
    while len(open_) > 1:
        close()
    page.dropped = _dropped(page, signs, within)
    return page


def subtrees(page: Page) -> set[int]:
    """Digests of the elements that may be templates: with text, and inside an article or main element boxes only."""
    return {
        d for d, tag, inside in zip(page.digests, page.tags, page.in_main)
        if d and (tag in BOXES if inside else tag not in ("", "html", "body", "head"))
    }


def _boxes(page: Page, gone: list[bool], templates: set[int]) -> list[bool]:
    """Templates inside the article: boxes that recur on the site, unless they are half of its text or more together.

    The guard keeps an article that the site shows on several pages.
    """
    n = len(gone)
    box = [False] * n
    for e in range(1, n):
        box[e] = page.in_main[e] and (box[page.parents[e]] or (page.tags[e] in BOXES and page.digests[e] in templates))
    whole = removed = 0
    for element, _, value in page.runs:
        if page.in_main[element] and not gone[element]:
            size = len("".join(value.split()))
            whole += size
            removed += size if box[element] else 0
    return box if 2 * removed < whole else [False] * n


def main_text(page: Page, templates: set[int]) -> str:
    """Blocks of the article, one per line, without unwanted elements and templates.

    Without an article or main element the rest of the page is the article.
    """
    gone = list(page.dropped)
    if templates:
        for e in range(1, len(gone)):
            gone[e] = gone[e] or gone[page.parents[e]] or (page.digests[e] in templates and not page.in_main[e])
        gone = [g or b for g, b in zip(gone, _boxes(page, gone, templates))]
    marked = any(inside and not g for inside, g in zip(page.in_main, gone))
    blocks: dict[int, list[str]] = {}
    for element, block, value in page.runs:
        if not gone[element] and (page.in_main[element] or not marked):
            blocks.setdefault(block, []).append(value)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def page_subtrees(pages: DataFrame) -> DataFrame:
    """host, digest, page, source: the distinct subtrees of every page that may be templates.

    ``page`` is a hash of the page's text: pages with the same subtrees and text
    count once, so copies of a page do not make its text a template. A row with
    digest 0 stands for the page itself and has the hash of its markup as
    ``source``, which is null in the others.
    """

    def emit(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            hosts, digests, prints, sources = [], [], [], []
            for host, source, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                page = parse(source.as_py() or "")
                found = sorted(subtrees(page))
                whole = "\x01".join(" ".join(v.split()) for _, _, v in page.runs)
                mark = _signed(xxhash.xxh3_64_intdigest(whole.encode("utf-8", "surrogatepass")))
                for d in (0, *found):
                    hosts.append(host)
                    digests.append(_signed(d))
                    prints.append(mark)
                    sources.append(None if d else key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), *(pa.array(c, pa.int64()) for c in (digests, prints, sources))],
                ["host", "digest", "page", "source"],
            )

    rows = pages.select(host_column(F.col("url")).alias("host"), "html", source_column(F.col("html")).alias("source"))
    return rows.mapInArrow(emit, "host string, digest long, page long, source long").distinct()


def templates(found: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, digest, n: the subtrees that stand on at least ``min_pages`` different pages of their host.

    Hosts are never gathered: rows are counted by (host, digest), pre-aggregated
    before the shuffle.
    """
    counts = found.filter("digest <> 0").groupBy("host", "digest").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= min_pages)


def _apart(rows: DataFrame, held: DataFrame, keys: list[str], n: str, hot: int, how: str) -> DataFrame:
    """``rows`` joined with ``held`` (unique in ``keys``); keys that ``n`` says have ``hot`` rows or more are joined by themselves.

    These are few, at most one in ``hot`` rows, so they are broadcast, and no
    other key has more rows than that in one task.
    """
    often = cut_lineage(held.filter(F.col(n) >= hot).drop(n), "often")
    seldom = held.filter(F.col(n) < hot).drop(n)
    marks = broadcast_if_small(often.select(*keys))
    first = rows.join(broadcast_if_small(often), keys)
    return first.unionByName(rows.join(marks, keys, "left_anti").join(seldom, keys, how))


def page_templates(found: DataFrame, known: DataFrame, hot: int = HOT) -> DataFrame:
    """host, source, digests: the templates on each page that has any, by the hash of its markup."""
    rows = found.filter("digest <> 0").select("host", "digest", "page")
    hits = cut_lineage(_apart(rows, known, ["host", "digest"], "n", hot, "inner"), "hits")
    lists = cut_lineage(hits.groupBy("host", "page").agg(F.collect_list("digest").alias("digests")), "lists")
    sources = found.filter("digest = 0").select("host", "page", "source")
    # Pages of one text differ in markup only; a text with very many markups is spread by the source.
    many = cut_lineage(sources.groupBy("host", "page").agg(F.count("*").alias("n")), "texts")
    lists = cut_lineage(lists.join(many, ["host", "page"]), "counted")
    sets = cut_lineage(_apart(sources, lists, ["host", "page"], "n", hot, "inner"), "sets")
    # Different texts with one hash of their markup share their lists; a digest that a page lacks does nothing.
    each = sets.select("host", "source", F.explode("digests").alias("digest"))
    return each.groupBy("host", "source").agg(F.collect_set("digest").alias("digests"))


def source_column(html: Column) -> Column:
    """Hash of the markup of a page."""
    return F.xxhash64(F.coalesce(html, F.lit("")))


def host_column(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def extracted(pages: DataFrame, min_pages: int = MIN_PAGES, max_sent: int = MAX_SENT, hot: int = HOT) -> DataFrame:
    """page_id, url, text and n_chars (code points) of the main text of every page.

    Site templates are subtrees that recur on at least ``min_pages`` different
    pages of their host, an absolute number on small and large hosts; they are
    deleted, as are elements whose tag, role or class says that they are no
    article text. Inside an article or main element only boxes (not paragraphs,
    headings or items) are templates, together less than half of its text, and
    only whole class and id names of blocks count. Null or empty html gives an empty text; a null url is the host
    with an empty name; repeated rows give one row each; an empty table none.
    Other columns of ``pages`` are not looked at.

    Up to ``max_sent`` templates go to all tasks; more are joined to the
    subtrees, and each page gets the templates that stand on it.
    """
    found = cut_lineage(page_subtrees(pages), "subtrees")
    known = cut_lineage(templates(found, min_pages), "templates")
    rows = pages.select("page_id", "url", "html", host_column(F.col("url")).alias("host"))
    sent: dict[str, set[int]] = {}
    if is_small(known, max_sent):
        for row in known.select("host", "digest").collect():
            sent.setdefault(row.host, set()).add(row.digest % (1 << 64))
        rows = rows.withColumn("digests", F.lit(None).cast("array<long>"))
    else:
        copies = rows.groupBy("host", source_column(F.col("html")).alias("source")).agg(F.count("*").alias("n"))
        held = cut_lineage(page_templates(found, known, hot).join(copies, ["host", "source"]), "held")
        rows = _apart(rows.withColumn("source", source_column(F.col("html"))), held, ["host", "source"], "n", hot, "left")
        rows = rows.select("page_id", "url", "html", "host", "digests")

    def extract(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for source, host, digests in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4)):
                own = {d % (1 << 64) for d in digests.as_py() or ()} or sent.get(host, set())
                texts.append(main_text(parse(source.as_py() or ""), own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(extract, schema)
