"""Main text of web pages, with removal of a site's templates.

A page is parsed into a tree. Every element subtree of its content root (the article, else main, else the body) has a
digest of its tags, classes and text; Spark counts on how many different pages of a host each digest occurs, and subtrees
that recur are deleted. What is left, without elements that are no article text by their tag, class, id or role, is joined
in page order. A class or id says so only if all its words do, or stand for a box or place, never on a heading, paragraph or
cell, and never where the page would lose its only article, main or first heading.

Inside an article or main only containers can be a template: a paragraph, heading or list item of an article is text
even if many articles share it. Pages that say the same count as one, however their menus differ.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsift.functions import bloom
from claimsift.llm.common import cut, map_chunks, texts_of

# Element names of HTML, and words in class and id that mark an element as no article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title iframe noembed noframes noscript xmp template".split())
HEAD_ONLY = frozenset("base link meta script style title noscript template".split())
CONTAINERS = frozenset("div section aside ul ol dl table form nav header footer details fieldset menu".split())
CELLS = frozenset("td th".split())
BLOCKS = CONTAINERS | CELLS | frozenset(
    "address article blockquote body caption center dd dialog dir dt figcaption figure h1 h2 h3 h4 h5 h6 head hgroup hr"
    " html legend li main p pre search summary tbody tfoot thead tr".split()
)
DROPPED_TAGS = RAW_TEXT | frozenset(
    "head nav footer aside form button select option datalist input label object embed applet canvas svg math audio video dialog menu".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation"
    " menu breadcrumb breadcrumbs pagination pager sidebar widget related recommended recommendations cookie cookies consent"
    " gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing"
    " social comment comments commentlist commentform commentbox commentsection disqus replies responses respond footer header"
    " masthead copyright adbox adslot adunit adbanner cookiebar cookiebanner topnav sidenav subnav sitenav mainnav mainmenu"
    " submenu toolbar skiplink tagcloud blogroll paywall guestbook".split()
)
ARTICLE_HINTS = frozenset("ad advert advertisement sponsored promo comment comments reply related teaser".split())
#: Words beside a hint in one class or id that do not change what the element is, as in ad-box or site-footer.
NEUTRAL = frozenset(
    "a the site main page post posts article articles entry box block area section wrap wrapper container inner outer row col column group list"
    " item items link links button buttons bar unit slot panel top bottom left right primary secondary global local title form icons"
    " count policy desktop mobile header thread".split()
)
#: Elements that are text whatever their class or id says.
TEXT_TAGS = frozenset(
    "html body main h1 h2 h3 h4 h5 h6 hgroup p blockquote pre code figure figcaption td th tr tbody thead dt dd b i em strong mark time".split()
)
HEADS = frozenset("article main h1".split())
ARTICLE_WORDS = frozenset("article post entry story content page has with no without".split())

TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
MARKED = re.compile(r"class|\bid\b|role|hidden|style", re.I).search
WORD = re.compile(r"[a-z0-9]+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW_TEXT}
#: Which open element a start tag closes, and where the search for it ends.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (CELLS, frozenset(["tr", "table"])),
    "th": (CELLS, frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
} | dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])))
#: Share of a page's text that tells whether two pages say the same.
MOST_TEXT = 0.6
SCOPE_ENDS = frozenset("table td th caption".split())
END_SCOPE = {"table": frozenset()} | dict.fromkeys("caption tbody thead tfoot tr td th".split(), frozenset(["table"]))


class Element:
    __slots__ = ("tag", "classes", "no_text", "hinted", "parts", "digest", "has_text", "above_root")

    def __init__(self, tag: str, classes: str, no_text: bool, hinted: bool = False):
        self.tag, self.classes, self.no_text = tag, classes, no_text
        self.hinted = hinted  # no text only by its class or id
        self.parts: list[str | Element] = []
        self.digest, self.has_text, self.above_root = 0, False, False


@lru_cache(4096)
def _marks(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Classes and id, whether the element is no article text, and whether only a class or id says so."""
    if not MARKED(attributes):
        return "", tag in DROPPED_TAGS, False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    classes = f"{found.get('class', '')} {found.get('id', '')}".lower()
    words = set(WORD.findall(classes))
    no_text = (
        tag in DROPPED_TAGS
        or found.get("role", "").lower() in DROPPED_ROLES
        or found.get("aria-hidden", "").lower() == "true"
        or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
        or "hidden" in ATTRIBUTE.sub(" ", attributes).lower().rstrip("/").split()
        or "hidden" in found
    )
    hints = frozenset()
    if tag == "article":
        hints = ARTICLE_HINTS
    elif tag not in TEXT_TAGS:
        hints = HINTS - {"header", "sidebar"} if words & ARTICLE_WORDS else HINTS
    hinted = not no_text and any(_says(token, hints) for token in classes.split())
    return " ".join(classes.split()), no_text or hinted, hinted


def _says(token: str, hints: frozenset[str]) -> bool:
    """Whether a class or id consists of hint words, and of words that stand for a box or place."""
    words = set(WORD.findall(token))
    return bool(words & hints) and words <= hints | NEUTRAL


def parse(page: str) -> Element:
    """The tree of a page; errors of markup are mended as browsers do in the common cases."""
    root = Element("#page", "", False)
    stack = [root]

    def close(wanted: frozenset[str], ends: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in wanted:
                del stack[k:]
                return
            if stack[k].tag in ends:
                return

    at, size = 0, len(page)
    while at < size:
        found = TAG.search(page, at)
        text = page[at : found.start() if found else size]
        if text:
            if stack[-1].tag == "head" and not text.isspace():
                stack.pop()
            stack[-1].parts.append(html.unescape(text) if "&" in text else text)
        if not found:
            break
        at = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        tag = tag.lower()
        if found[1] or found[4]:
            if tag in BLOCKS:
                close(frozenset([tag]), END_SCOPE.get(tag, SCOPE_ENDS))
            else:
                close(frozenset([tag]), BLOCKS)
            continue
        attributes = found[3] or found[6] or ""
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            stack.pop()
        if tag in BLOCKS:
            close(frozenset(["p"]), BLOCKS - {"p"})
            if tag in CLOSES:
                close(*CLOSES[tag])
        elif tag in CLOSES:
            close(*CLOSES[tag])
        element = Element(tag, *(_marks(tag, attributes) if attributes else ("", tag in DROPPED_TAGS)))
        stack[-1].parts.append(element)
        if tag in RAW_TEXT:
            end = RAW_END[tag].search(page, at)
            at = end.start() if end else size
            stack.append(element)  # its end tag follows
        elif tag not in VOID and not (attributes.endswith("/") and any(e.tag in ("svg", "math") for e in stack)):
            stack.append(element)
    _spare(root)
    return root


def _spare(root: Element) -> None:
    """If the page has its article, main and h1 only inside elements that their class or id marks, these are text."""
    dropped = False  # some element is hinted
    steps, skip = walk(root), None
    while True:
        try:
            part, entering = steps.send(skip)
        except StopIteration:
            break
        skip = None
        if isinstance(part, str) or not entering:
            continue
        if part.tag in HEADS and not part.no_text:
            return
        dropped = dropped or part.hinted
        skip = part.no_text
    if not dropped:
        return
    above: list[Element] = []
    steps, skip = walk(root), None
    while True:
        try:
            part, entering = steps.send(skip)
        except StopIteration:
            return
        skip = None
        if isinstance(part, str):
            continue
        if not entering:
            above.pop()
        elif part.no_text and not part.hinted or part.hinted and part.tag == "article":
            skip = True
        else:
            if part.tag in HEADS:
                for element in above:
                    element.no_text = element.hinted = False
            above.append(part)


def walk(root: Element):
    """(element or text, True on the way in, False on the way out), without recursion. Send True to skip an element."""
    stack = [(root, iter(root.parts))]
    if (yield root, True):
        return
    while stack:
        element, parts = stack[-1]
        part = next(parts, None)
        if part is None:
            stack.pop()
            yield element, False
        elif isinstance(part, str):
            yield part, True
        else:
            if not (yield part, True):
                stack.append((part, iter(part.parts)))


def digest(root: Element) -> None:
    """Fill in the digest of every subtree, from the inside outwards."""
    inside: list[list[bytes]] = []
    for part, entering in walk(root):
        if isinstance(part, str):
            text = " ".join(part.split())
            if text:
                inside[-1].append(text.encode())
        elif entering:
            inside.append([f"<{part.tag} {part.classes}>".encode()])
        else:
            pieces = inside.pop()
            part.has_text = len(pieces) > 1
            part.digest = xxhash.xxh64_intdigest(b"\x00".join(pieces))
            if inside and part.has_text:
                inside[-1].append(part.digest.to_bytes(8, "little"))


def _outermost(root: Element, wanted) -> list[Element]:
    found: list[Element] = []
    above: list[Element] = []
    steps = walk(root)
    skip = None
    while True:
        try:
            part, entering = steps.send(skip)
        except StopIteration:
            return found
        skip = None
        if isinstance(part, str):
            continue
        if not entering:
            above.pop()
        elif part.no_text:
            skip = True
        elif wanted(part):
            for element in above:
                element.above_root = True
            found.append(part)
            skip = True
        else:
            above.append(part)


def content_roots(root: Element) -> list[Element]:
    for wanted in (lambda e: e.tag == "article", lambda e: e.tag == "main", lambda e: e.tag == "body"):
        found = _outermost(root, wanted)
        if found:
            return found
    return [root]


def possible_templates(page: str) -> tuple[int, set[int]]:
    """Digest of what the page says, and of the subtrees of its content that would be deleted if they recur on the host.

    Copies of an article are one page whatever menus stand around it, so the first digest is that of the longest blocks
    that make up most of the text.
    """
    root = parse(page)
    digest(root)
    roots = content_roots(root)
    found: set[int] = set()
    for content in roots:
        in_article = content.tag in ("article", "main")
        steps, skip = walk(content), None
        while True:
            try:
                part, entering = steps.send(skip)
            except StopIteration:
                break
            skip = None
            if isinstance(part, str) or not entering or part is content:
                continue
            skip = part.no_text
            if part.has_text and not part.no_text and (not in_article or part.tag in CONTAINERS) and part.tag not in ("html", "body", "head"):
                found.add(part.digest)
    if not found:
        return 0, found
    blocks = sorted(set(text_blocks(roots)), key=lambda b: (-len(b), b))
    said, wanted = [], MOST_TEXT * sum(map(len, blocks))
    for block in blocks:
        if wanted <= 0:
            break
        said.append(block)
        wanted -= len(block)
    return xxhash.xxh64_intdigest("\n".join(said).encode()), found


def main_text(page: str, templates: frozenset[int] | set[int] = frozenset()) -> str:
    root = parse(page)
    if templates:
        digest(root)
    return "\n".join(text_blocks(content_roots(root), templates))


def text_blocks(roots: list[Element], templates: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """The blocks of the content roots in page order, without templates and elements that are no text."""
    blocks: list[str] = []
    for content in roots:
        in_article = content.tag in ("article", "main")
        block: list[str] = []
        steps, skip = walk(content), None
        while True:
            try:
                part, entering = steps.send(skip)
            except StopIteration:
                break
            skip = None
            if isinstance(part, str):
                block.append(part)
                continue
            if part.tag in CELLS or part.tag == "br":
                block.append(" ")
            elif part.tag in BLOCKS:
                blocks.append("".join(block))
                block = []
            if entering and part is not content:
                template = part.digest in templates and (not in_article or part.tag in CONTAINERS)
                skip = part.no_text or template or (part.tag == "header" and not in_article)
        blocks.append("".join(block))
    return [b for b in (" ".join(block.split()) for block in blocks) if b]


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#\s]+)", 1)


def _signed(digests: list[int]) -> pa.Array:
    return pa.array([d - (1 << 64) if d >> 63 else d for d in digests], pa.int64())


def page_templates(pages: DataFrame, min_pages: int) -> DataFrame:
    """(page, page2, templates): digests of the subtrees of a page that stand on ``min_pages`` different pages of its host.

    ``pages`` is (page, page2, host, html), the first two of them hashes of the page. Digests are counted and go back to
    their pages as rows of a few numbers; lists are only made for a single page.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, bodies, digests = [], [], []
        for row, page in enumerate(texts_of(batch.column(3))):
            body, found = possible_templates(page)
            rows += [row] * len(found)
            bodies += [body] * len(found)
            digests += found
        place = pa.array(rows, pa.int64())
        columns = [*(batch.column(k).take(place) for k in range(3)), _signed(bodies), _signed(digests)]
        return pa.RecordBatch.from_arrays(columns, names=["page", "page2", "host", "body", "digest"])

    marks = cut(map_chunks(pages, work, "page bigint, page2 bigint, host string, body bigint, digest bigint", "html").distinct())
    counts = marks.select("host", "digest", "body").distinct().groupBy("host", "digest").agg(F.count("*").alias("n_pages"))
    recurring = cut(counts.filter(F.col("n_pages") >= min_pages).select("host", "digest"))
    return cut(marks.join(recurring, ["host", "digest"]).groupBy("page", "page2").agg(F.collect_set("digest").alias("templates")))


def extract_main_text(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_pages: int = 5) -> DataFrame:
    """(id, url, text, n_chars) of every page.

    A subtree of the content is deleted if it stands on ``min_pages`` different pages of the host, however many pages the
    host has. Null or empty html gives empty text of 0 characters. A null url, or one without a host, belongs to the host
    "". Repeated rows stay repeated and count as one page for the templates, as do copies of an article. Truncated markup
    is read as far as it goes. An empty table gives an empty table. Only id, url and html are read; only pages with
    something to delete, and a few others, are shuffled.
    """
    url, html_text = F.col(f"`{url_col}`"), F.col(f"`{html_col}`")
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"), url.alias("url"), html_text.alias("html"),
        F.xxhash64(url, html_text).alias("page"), F.xxhash64(html_text, F.lit(1), url).alias("page2"),
    )
    templates = page_templates(rows.select("page", "page2", host_of(F.col("url")).alias("host"), "html"), min_pages)
    none = F.lit(None).cast("array<bigint>").alias("templates")
    if templates.isEmpty():
        with_templates = rows.select("id", "url", "html", none)
    else:
        may_have = bloom.may_be_key(templates, "page")
        joined = rows.filter(may_have).join(templates, ["page", "page2"], "left").select("id", "url", "html", "templates")
        with_templates = joined.unionByName(rows.filter(~may_have).select("id", "url", "html", none))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [
            main_text(page, {t & 0xFFFFFFFFFFFFFFFF for t in found or ()})
            for page, found in zip(texts_of(batch.column(2)), batch.column(3).to_pylist())
        ]
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, url_col, "text", "n_chars"])

    kinds = dict(with_templates.dtypes)
    return map_chunks(with_templates, work, f"`{id_col}` {kinds['id']}, `{url_col}` {kinds['url']}, text string, n_chars bigint", "html")
