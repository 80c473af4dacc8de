"""Operator 9: main text of web pages, by a site style tree.

The pages of a host are merged into one tree of element nodes, told apart by tag, class and id along their path. A
node's content and presentation on each page are hashed, and the entropy of these over the host's different pages says
how important the node is: exp(entropy) is how many contents there are in effect, and its share of the pages is the
importance. What is the same on page after page, or one of a few dozen variants on hundreds of pages, has little. Branches of low importance go first. Then come
defaults for what entropy cannot tell, as it varies from page to page like an article does, and for hosts with too few
pages: branches go that their tags or names mark as menus, adverts, comments and the like, where a name does not
remove what is or holds the article, and where a page marks its article, only that is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Set
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, written

#: A branch goes if its importance, from 0 (the same on each page) to 1 (never the same), is under this, and if its contents are fewer
#: than this share of the pages: an article that is copied to many pages of its host lowers the entropy, but not that much the number of contents.
LEAST_IMPORTANCE, LEAST_VARIETY = 0.3, 0.5
#: Nodes on fewer different pages of their host are not judged.
LEAST_PAGES = 3
#: Within a marked article a branch goes only if it is on so many pages with less than this importance; headings stay.
FIRM_PAGES, FIRM_IMPORTANCE = 8, 0.15
#: Pages that are thought to be seen besides, each with a content of its own: a few equal pages say less than many.
PRIOR_PAGES = 0.25
#: Low branches up to which the hosts' lists are broadcast; more are joined by a shuffle with salted hosts.
BROADCAST_BRANCHES = 50_000
SALTS = 32

# Fixed values of HTML: elements whose text is not markup, have no content, end a block of text, and close an open p.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "annotation", "annotation-xml"}
NESTED = {"svg", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSED_BY_ITSELF = {"li", "p", "option", "tr", "td", "th", "dt", "dd"}

# Elements, roles and words of class or id that mark what is no article.
NOISE_TAGS = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "search", "object", "audio", "video", "canvas", "input", "label", "fieldset"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "alertdialog", "form"}
NOISE_WORDS = set(
    "ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner banners nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars footer masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup paywall share sharing social related recommended "
    "recommendations comment comments commentlist disqus respond replies reply discussion reactions widget widgets toolbar pagination pager skip login copyright disclaimer".split()
)
ARTICLE_NAMES = {"articlebody"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Never removed as low branches.
KEPT_TAGS = {"html", "body", "article", "main", "h1"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|<[!?][^>]*>?|[^<]+|<", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_WORD = re.compile(r"[a-z0-9]+")
#: The end of a tag that closes itself; a slash after an unquoted value belongs to the value.
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]+/\Z")
_MASK = (1 << 63) - 1


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") & _MASK


_keys: dict[str, int] = {}


def _key(name: str) -> int:
    found = _keys.get(name)
    if found is None:
        if len(_keys) > 50_000:
            _keys.clear()
        found = _keys[name] = _hash(name)
    return found


class Node:
    """An open element: tag, hash of its path, whether it is noise (1) or low (2) or inside such, whether inside an article or a heading, the number of the nearest node at or above it that only its name marks as noise, and a hash of the text in it so far."""

    __slots__ = ("article", "content", "gone", "heading", "named", "path", "tag")

    def __init__(self, tag: str, path: int, gone: int, article: bool, heading: bool, named: int) -> None:
        self.tag, self.path, self.gone, self.article, self.heading, self.named, self.content = tag, path, gone, article, heading, named, 0


class Names:
    """Nodes that only their names mark as noise. up: of each its next one above; 0 is none."""

    def __init__(self) -> None:
        self.up, self.noise = [0], [0]

    def add(self, above: int) -> int:
        self.up.append(above)
        self.noise.append(1)
        return len(self.up) - 1

    def counts(self) -> list[int]:
        """How many noisy names there are at and above each."""
        out = self.noise[:]
        for k in range(1, len(out)):
            out[k] += out[self.up[k]]
        return out

    def spare(self, places: list[int]) -> None:
        """If names would remove all of these places, those with the fewest such names stay, and so does what holds them."""
        left = self.counts()
        least = min((left[k] for k in places), default=0)
        for k in places:
            if least and left[k] == least:
                # above a spared one all are spared
                while self.noise[k]:
                    self.noise[k] = 0
                    k = self.up[k]


class Open:
    """The open elements, with the places of each tag and of the blocks, so that an end tag is found without a search."""

    def __init__(self, closed) -> None:
        self.stack = [Node("", 0, 0, False, False, 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.closed = closed

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int) -> None:
        """Closes the elements from place k on, the last one first."""
        while len(self.stack) > k:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCKS:
                self.blocks.pop()
            if self.closed:
                self.closed(node, self.stack[-1])

    def of(self, tag: str) -> int:
        """The place of the last open element of a tag that an end tag closes, or 0: one that is no block closes nothing outside the last open block."""
        k = (self.places.get(tag) or [0])[-1]
        return 0 if tag not in BLOCKS and self.blocks and k < self.blocks[-1] else k


def _after_raw(html: str, tag: str, at: int) -> int:
    """The place after the end of an element without markup that begins before at; svg and template hold others of their kind."""
    depth = 1
    for m in re.compile(f"<(/?){tag}(?![\\w-])[^>]*(/?)>?" if tag in NESTED else f"<(/){tag}[^>]*()>?", re.I).finditer(html, at):
        depth += -1 if m[1] else not m[0].endswith("/>")
        if not depth:
            return m.end()
    return len(html)


def parse(html: str, low: Set[int] = frozenset(), weak: Set[int] = frozenset(), watch=None, found: dict[int, list[int]] | None = None) -> tuple[list[tuple[str, bool]], bool, int]:
    """Blocks (text, inside an article) that stay, in page order, whether the page marks an article at all, and how many blocks the style tree has removed.

    low: paths of low branches; weak: further ones that count outside marked articles only. found, if given, gets the
    hashes of content and presentation of each path. The time is in proportion to the length of html.
    """

    def closed(node: Node, above: Node) -> None:
        if node.content:
            own = found.setdefault(node.path, [0, 0])
            own[0] = (own[0] * 1000003 ^ node.content) & _MASK
            above.content = (above.content * 1000003 ^ node.content) & _MASK

    open_ = Open(closed if found is not None else None)
    stack = open_.stack
    blocks: list[tuple[str, bool, bool, int]] = []
    text: list[str] = []
    noisy = Names()
    articles: list[int] = []
    titles: list[int] = []
    at, end, by_tree = 0, len(html), 0

    def flush() -> None:
        nonlocal by_tree
        if text:
            own = " ".join(unescape("".join(text)).split())
            text.clear()
            if own:
                top = stack[-1]
                if not top.gone:
                    blocks.append((own, top.article, top.heading, top.named))
                by_tree += top.gone == 2
                if found is not None:
                    top.content = (top.content * 1000003 ^ _hash(own)) & _MASK

    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or len(m[0]) == 1:
                text.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            if k := open_.of(tag):
                top, above = stack[-1], stack[k - 1]
                if top.gone != above.gone or top.article != above.article or top.named != above.named:
                    flush()
                open_.cut(k)
            continue
        if tag in BLOCKS:
            flush()
            if tag != "br" and open_.blocks:
                k = open_.blocks[-1]
                if tag in CLOSED_BY_ITSELF and stack[k].tag == tag or stack[k].tag == "p":
                    open_.cut(k)
        if tag in ("svg", "math") and m[3].endswith("/") and not _UNQUOTED.search(m[3]):
            continue
        if tag in RAW:
            at = _after_raw(html, tag, at)
            continue
        if tag in VOID:
            continue
        parent, attrs = stack[-1], m[3]
        names, named, noise, article = "", False, tag in NOISE_TAGS or tag == "header" and not parent.article, tag in ("article", "main")
        if "=" in attrs:
            for name, a, b, c in _ATTR.findall(attrs):
                name, value = name.lower(), (a or b or c).lower()
                if name in ("class", "id"):
                    names += f".{value}"
                    named = named or tag not in ("html", "body") and not NOISE_WORDS.isdisjoint(_WORD.findall(value))
                elif name == "role":
                    noise, article = noise or value in NOISE_ROLES, article or value in ("main", "article")
                elif name == "itemprop":
                    article = article or value in ARTICLE_NAMES
                elif name == "hidden" or name == "aria-hidden" and value == "true":
                    noise = True
        key = _key(tag + names)
        path = (parent.path * 0x100000001B3 + key) & _MASK
        inside = parent.article or article
        by_entropy = tag not in KEPT_TAGS and (path in low and not (inside and tag in HEADINGS) or path in weak and not inside)
        gone = parent.gone or (2 if by_entropy else int(noise))
        if gone != parent.gone or article and not parent.article or named and not gone:
            flush()
        if found is not None:
            node = found.setdefault(parent.path, [0, 0])
            node[1] = (node[1] * 31 + key) & _MASK
            found.setdefault(path, [0, 0])
        above = noisy.add(parent.named) if named and not gone else parent.named
        if article and not gone:
            articles.append(above)
        elif tag == "h1" and not gone:
            titles.append(above)
        open_.push(Node(tag, path, gone, parent.article or article, parent.heading or tag in HEADINGS, above))
    flush()
    open_.cut(1)
    # the article, or the title of a page that has it under fewer names; then the title; then what text there is besides headings
    noisy.spare(articles and articles + [k for k in titles if k])
    noisy.spare(titles)
    left = noisy.counts()
    marked = not all(left[k] for k in articles)
    noisy.spare([k for _, article, heading, k in blocks if (article or not marked) and not heading])
    left = noisy.counts()
    return [(t, article) for t, article, _, k in blocks if not left[k]], marked, by_tree


def main_text(html: str, low: Set[int] = frozenset(), weak: Set[int] = frozenset()) -> str:
    return judged_text(html, low, weak)[0]


def judged_text(html: str, low: Set[int] = frozenset(), weak: Set[int] = frozenset()) -> tuple[str, int]:
    """The main text, and how many blocks of text the style tree has removed. If what a few pages say would leave nothing, it does not count."""
    blocks, marked, by_tree = parse(html, low, weak)
    text = " ".join(t for t, article in blocks if article or not marked)
    return judged_text(html, low) if weak and not text else (text, by_tree)


def nodes(html: str) -> dict[int, list[int]]:
    """Of each path on a page: hashes of its content and of its presentation (the keys of its children in order)."""
    found: dict[int, list[int]] = {}
    parse(html, found=found)
    found.pop(0, None)
    return found


def host(url_col: str):
    """Column: the host of a URL in lower case, empty if it has none or is null."""
    return F.lower(F.coalesce(F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def importance(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The style trees of all hosts: (host, path, pages, variety, content, presentation, importance) of each node.

    content and presentation are exp(entropy) over the host's different pages, as shares of these pages; importance is the
    larger of content and half of presentation, with PRIOR_PAGES more pages of their own; variety is the number of
    different contents as a share of the pages. Equal pages count once. Counts are added up by host, path and hash first, so a host with a third of all pages is dealt over all tasks.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for h, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py() or ""
                page = _hash(text)
                for path, (content, style) in nodes(text).items():
                    for c, v in zip(cols, (h, path, content, style, page)):
                        c.append(v)
                if len(cols[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names)
                    cols = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

    names = ["host", "path", "content", "style", "page"]
    seen = pages.select(host(url_col).alias("host"), html_col).mapInArrow(run, "host string, path long, content long, style long, page long").distinct()
    each = seen.select("host", "path", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("content").alias("v")), F.struct(F.lit(1).alias("k"), F.col("style").alias("v")))).alias("x"))
    counts = each.groupBy("host", "path", "x.k", "x.v").agg(F.count("*").alias("n"))
    of = lambda k, x: F.sum(F.when(F.col("k") == k, x))
    own = counts.groupBy("host", "path").agg(of(0, F.col("n")).alias("pages"), of(0, F.lit(1)).alias("variety"), *[of(k, F.col("n") * F.log("n")).alias(f"e{k}") for k in (0, 1)])
    # exp(log m - e / m) / m
    own = own.select("host", "path", "pages", (F.col("variety") / F.col("pages")).alias("variety"), F.exp(-F.col("e0") / F.col("pages")).alias("content"), F.exp(-F.col("e1") / F.col("pages")).alias("presentation"))
    prior = F.lit(PRIOR_PAGES)
    return own.withColumn("importance", (F.greatest("content", F.col("presentation") / 2) * F.col("pages") + prior) / (F.col("pages") + prior))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars, by_tree): one row per row of pages. by_tree: blocks of text that the style tree has removed.

    Blocks in page order, white space inside a block as one space, joined by one space. A null html or one without
    text gives an empty text; pages with a null url or without a host form one site. Other columns are left out.
    """
    low = importance(pages, url_col, html_col).where(f"pages >= {LEAST_PAGES} AND importance < {LEAST_IMPORTANCE} AND variety < {LEAST_VARIETY}").select("host", "path", F.expr(f"pages >= {FIRM_PAGES} AND importance < {FIRM_IMPORTANCE}").alias("firm"))
    low, _ = written(low, "low-branches")
    of = lambda firm: F.sort_array(F.collect_list(F.when(F.col("firm") == firm, F.col("path"))))
    lists = low.groupBy("host").agg(of(True).alias("low"), of(False).alias("weak"))
    p = pages.select(F.col(id_col), F.col(url_col), F.col(html_col), host(url_col).alias("host"))
    if low.count() <= BROADCAST_BRANCHES:
        p = p.join(F.broadcast(lists), "host", "left")
    else:
        salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        p = p.withColumn("salt", F.pmod(F.xxhash64(html_col), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, frozenset] = {}

        def known(own: pa.Scalar) -> frozenset:
            key = tuple(own.as_py() or ())
            if key not in kept:
                if len(kept) > 1000:
                    kept.clear()
                kept[key] = frozenset(key)
            return kept[key]

        for b in batches:
            got = [judged_text(t.as_py() or "", known(low), known(weak)) for t, low, weak in zip(b.column(2), b.column(3), b.column(4))]
            texts, by_tree = [x[0] for x in got], [x[1] for x in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(by_tree, pa.int64())], [id_col, url_col, "text", "n_chars", "by_tree"])

    schema = f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, `{url_col}` string, text string, n_chars long, by_tree long"
    return p.select(id_col, url_col, html_col, "low", "weak").mapInArrow(run, schema)
