"""Main text of web pages by a site style tree.

Every page is parsed to a tree whose nodes are named by tag and class. Same-host pages
are merged: a node of the site's style tree is a path of names, and nothing is left out
of it by its name. For each node the tree knows

* presentation: how the sequences of its children's names are spread over pages;
* content: how often each text block that stands directly in it recurs over pages.

The presentation importance P of a node that m pages have is the entropy of its child
sequences to the base m. A text block on n of these pages says nothing new with weight
log n to the base m, so the content importance K of a node is 1 less the mean of that
weight over all blocks under it. A node with l kinds of children has the importance
(1 - GAMMA**l) P + GAMMA**l K; its own running text counts as one more leaf. Branches
below LOW (LOW_INSIDE within an article or main element) that hold no important node are
removed from each page, whatever their names.

Entropy cannot tell an article from an advert, a footer or a reader's comment that is new
on every page, and knows nothing of a node that fewer than MIN_PAGES distinct pages have.
So branches go by name too: by HTML's own elements for what is no article, and by classes,
ids and roles that name it as a whole (comments, site-footer, ad-box; not has-sidebar,
search-results or article-header), unless the branch holds the page's article.

Pages of one host whose longest PRINT blocks are equal are copies and count once, so a
group of copies or near copies is no template. The tree is aggregated in Spark with
partial sums before the shuffle. It is broadcast while it is small (BROADCAST_BYTES,
measured); a larger one meets the pages by host, hosts with more than a thousandth of all
pages being dealt out over salts.

Defined results: null or empty html gives an empty text, as does a page with no text; a
page that would lose all its text to the tree keeps what the names leave; a null url is a
host of its own; broken markup is read as browsers read it, in linear time; repeated pages
get equal answers; an empty table gives no rows; further columns are ignored. Whole pages
are read, however long or deep.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, bounded_batches

MIN_PAGES = 8
LOW, LOW_INSIDE = 0.8, 0.3
GAMMA = 0.9
PRINT = 3
BROADCAST_BYTES = 8 << 20
RESULT = "page_id long, url string, text string, n_chars long"
TREE = "host string, path long, parent long, inside boolean, pages long, presentation double, blocks long, repeated double"

_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?")
_UNQUOTED = re.compile(r"[^\s>]*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

# HTML's elements without an end tag, of raw text, and of running text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noscript noembed noframes xmp".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: Never text of a page.
NO_TEXT = frozenset("head template svg math object canvas select datalist audio video map".split())
#: Elements that HTML means for what is no article.
NO_ARTICLE = frozenset("nav footer header aside form button dialog menu".split())
#: Words that name what is no article, as a whole class or as the noun of one.
NOUNS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot adbox adunit sponsor sponsors sponsored promo promos promotion banner banners cookie cookies consent notice notices alert disclaimer legal copyright gdpr nav navs navbar navigation subnav topnav topbar menu menus contentinfo complementary breadcrumb breadcrumbs sidebar side footer header masthead comment comments disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup login signin search popup modal dialog widget widgets toolbar pagination pager".split()
)
#: What such a word may be followed by in a class that still names the same thing.
HOLDERS = frozenset("list area box bar block section wrap wrapper container link links form button buttons icons item items menu content inner text message body row column col panel holder slot unit group thread meta author posts articles stories top bottom left right main primary secondary overlay".split())
#: A header with one of these before it is the article's own.
OWN = frozenset("article entry post story content page section".split())
#: Parts of classes that say how a page is laid out or filed, and name nothing.
LAYOUT = frozenset("with has have no non without enabled disabled hide show is".split())
FILED = frozenset("category cat tag type status format topic".split())


class Node:
    __slots__ = ("tag", "name", "children", "parent", "block", "named", "main", "path", "inside", "chars", "mains", "articles", "titles")

    def __init__(self, tag: str, name: str, parent: Node | None):
        self.tag, self.name, self.parent = tag, name, parent
        self.children: list[Node | str] = []
        self.block: Node = parent.block if parent is not None and tag in INLINE else self
        self.named = False
        self.main = tag == "main"
        self.path = 0
        self.inside = False


def names_no_article(words: Iterable[str]) -> bool:
    """Whether a class, id or role names what is no article."""
    for word in words:
        parts = [p.lower() for p in _PARTS.findall(word)]
        if not parts or LAYOUT.intersection(parts) or parts[0] in FILED:
            continue
        if parts[-1] in NOUNS:
            if len(parts) == 1 or not (parts[-1] == "header" and parts[-2] in OWN - {"page"}):
                return True
        elif parts[0] in NOUNS and parts[-1] in HOLDERS:
            return True
    return False


class _Parser:
    """One pass over a page; a search that has failed once is not repeated, so time is linear."""

    def __init__(self, html: str):
        self.html = html
        self.lost: set[str] = set()  # what does not occur any more
        self.known: dict[str, tuple[str, bool]] = {}

    def find(self, what: str, pos: int) -> int:
        if what in self.lost:
            return -1
        at = self.html.find(what, pos)
        if at < 0:
            self.lost.add(what)
        return at

    def attributes(self, pos: int) -> tuple[int, str, bool]:
        """The place after a tag, its class, id and role, and whether it closes itself."""
        html, words = self.html, []
        slash = False
        while True:
            m = _ATTRIBUTE.match(html, pos)
            if m is None:
                end = html.find(">", pos)
                return (len(html) if end < 0 else end + 1), " ".join(words), html[max(end - 1, 0) : end] == "/"
            pos, key, value = m.end(), m[1].lower(), ""
            if m[2]:
                quote = html[pos : pos + 1]
                close = self.find(quote, pos + 1) if quote in ("'", '"') and quote else -1
                if close >= 0:
                    value, pos = html[pos + 1 : close], close + 1
                else:
                    m = _UNQUOTED.match(html, pos)
                    value, pos = m[0], m.end()
            if key in ("class", "id", "role"):
                words.append(value)

    def raw_end(self, tag: str, pos: int) -> int:
        """The place after the end tag of an element of raw text."""
        if tag in self.lost:
            return len(self.html)
        m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(self.html, pos)
        if m is None:
            self.lost.add(tag)
            return len(self.html)
        end = self.html.find(">", m.end())
        return len(self.html) if end < 0 else end + 1

    def parse(self) -> Node:
        html, end, pos = self.html, len(self.html), 0
        root = at = Node("#root", "", None)
        opened: dict[str, int] = {}

        def close_to(up: Node, at: Node) -> None:
            while at is not up:
                opened[at.tag] -= 1
                at = at.parent

        while pos < end:
            start = html.find("<", pos)
            if start < 0:
                at.children.append(htmllib.unescape(html[pos:]))
                break
            nxt = html[start + 1 : start + 2]
            closing = nxt == "/"
            m = _NAME.match(html, start + 1 + closing)
            if m is None and nxt not in ("!", "?", "/"):  # no tag
                upto = html.find("<", start + 1)
                upto = end if upto < 0 else upto
                at.children.append(htmllib.unescape(html[pos:upto]))
                pos = upto
                continue
            if start > pos:
                at.children.append(htmllib.unescape(html[pos:start]))
            if m is None:
                if html.startswith("<!--", start):
                    if html.startswith((">", "->"), start + 4):
                        pos = html.index(">", start) + 1
                    else:
                        stop = self.find("-->", start + 4)
                        pos = end if stop < 0 else stop + 3
                else:
                    stop = html.find(">", start)
                    pos = end if stop < 0 else stop + 1
                continue
            tag, pos = m[0].lower(), m.end()
            words, itself = "", False
            if html[pos : pos + 1] == ">":
                pos += 1
            else:
                pos, words, itself = self.attributes(pos)
            if closing:
                if opened.get(tag):
                    up = at
                    stop = at.block if tag in INLINE else None
                    while up.tag != tag and up is not stop:
                        up = up.parent
                    if up.tag == tag:
                        close_to(up.parent, at)
                        at = up.parent
                elif tag in ("p", "br"):
                    at.children.append(Node(tag, tag, at))
                continue
            if tag in RAW:
                if not itself or tag in ("script", "style", "title", "textarea"):
                    pos = self.raw_end(tag, pos)
                continue
            if tag not in INLINE and tag not in VOID:  # a paragraph ends where a block begins, also inside running text
                up = at.block
                while up.parent is not None and tag in CLOSES.get(up.tag, ()):
                    close_to(up.parent, at)
                    at = up.parent
                    up = at.block
            name, named = tag, False
            if words:
                name, named = self.known.get(words) or self.known.setdefault(words, (".".join(re.sub(r"[0-9]+", "0", words).lower().split()), names_no_article(words.split())))
                name = f"{tag}.{name}"
            node = Node(tag, name, at)
            node.main = node.main or bool(words) and "main" in words.lower().split()
            node.named = tag in NO_ARTICLE or (named and not node.main and tag not in ("html", "body"))
            at.children.append(node)
            if tag not in VOID and not (itself and tag in NO_TEXT):
                at = node
                opened[tag] = opened.get(tag, 0) + 1
        return root


def _order(root: Node) -> list[Node]:
    """Elements, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def parse(html: str | None) -> Node:
    """The tree of a page; text is in pieces, with character references decoded.

    named says of a node that its name is one of no article, unless it holds the page's article.
    """
    root = _Parser(html or "").parse()
    nodes = _order(root)
    paths: dict[tuple[int, str], int] = {}
    for node in nodes:
        up = node.parent
        if up is None:
            continue
        key = (up.path, node.name)
        if key not in paths:
            paths[key] = _hash(f"{up.path}>{node.name}")
        node.path = paths[key]
        node.inside = up.inside or node.tag in ("article", "main")
    for node in reversed(nodes):
        node.chars = node.mains = node.articles = node.titles = 0
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c)
            elif c.tag not in NO_TEXT:
                node.chars += c.chars
                node.mains += c.mains + c.main
                node.articles += c.articles + (c.tag == "article")
                node.titles += c.titles + (c.tag == "h1")
    for node in nodes:
        if not node.named:
            continue
        if node.tag == "article" and not node.parent.inside:
            node.named = False  # an outermost article
        elif node.mains or (node.articles and node.articles == root.articles and not root.mains):
            node.named = False
        elif node.inside and (node.tag == "header" or node.name.split(".")[-1] == "header") and (node.titles or any(isinstance(c, Node) and c.tag in ("h1", "h2") for c in node.children)):
            node.named = False  # an article's own head
        elif not root.mains and not root.articles:
            if node.titles and 2 * node.chars >= root.chars and node.tag not in NO_ARTICLE or node.tag == "form" and 10 * node.chars >= 8 * root.chars:
                node.named = False
    return root


def _hash(text: str) -> int:
    x = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >= 1 << 63 else x


def blocks(top: Node, skip) -> Iterator[tuple[Node, str]]:
    """The node and text of each block under top, without branches that skip() names; a block is text up to the next block element."""
    out: list[str] = []
    where = top
    stack: list = [(top, iter(top.children))]
    while stack:
        node, rest = stack[-1]
        for child in rest:
            if isinstance(child, str):
                if not out or (where.tag in INLINE and not "".join(out).strip()):
                    where = node
                out.append(child)
                continue
            if child.tag in NO_TEXT or skip(child):
                continue
            if child.tag not in INLINE and out:
                text = _SPACE.sub(" ", "".join(out)).strip()
                if text:
                    yield where, text
                out = []
            stack.append((child, iter(child.children)))
            break
        else:
            stack.pop()
            if node.tag not in INLINE and out:
                text = _SPACE.sub(" ", "".join(out)).strip()
                if text:
                    yield where, text
                out = []
    text = _SPACE.sub(" ", "".join(out)).strip()
    if text:
        yield where, text


def article_of(root: Node) -> list[Node]:
    """Outermost article elements, else main elements, else the whole page; with a title that stands over them in main."""
    for wanted in ("article", "main"):
        found, titles, todo = [], [], [(root, False)]
        while todo:
            node, in_main = todo.pop()
            if node.named:
                continue
            if node.main if wanted == "main" else node.tag == wanted:
                found.append(node)
                continue
            if node.tag == "h1" and in_main and not found:
                titles.append(node)
                continue
            in_main = in_main or node.main
            todo += [(c, in_main) for c in reversed(node.children) if isinstance(c, Node)]
        if found:
            return found if any(f.titles for f in found) else titles + found
    return [root]


def features(html: str | None) -> tuple[int, list[tuple[int, int, bool, int, int]]]:
    """A page's print, and (path, parent, inside, kind, value) of its style nodes: kind 0, child sequence; kind 1, a text block."""
    root = parse(html)
    sequences: dict[int, list[str]] = {}
    about: dict[int, tuple[int, bool]] = {}
    for node in _order(root):
        if node.parent is None or node.tag in NO_TEXT or node.parent.path not in about and node.parent.parent is not None:
            continue
        about[node.path] = (node.parent.path, node.inside)
        sequences.setdefault(node.path, []).append(",".join(c.name for c in node.children if isinstance(c, Node)))
    about[0] = (0, False)
    texts: dict[int, int] = {}
    found = set()
    for node, text in blocks(root, lambda _: False):
        x = _hash(text)
        texts[x] = len(text)
        found.add((node.path, x))
    longest = sorted(texts, key=lambda x: (-texts[x], x))[:PRINT]
    rows = [(p, *about[p], 0, _hash(";".join(s))) for p, s in sequences.items()]
    rows += [(p, *about[p], 1, x) for p, x in found]
    return _hash(",".join(map(str, sorted(longest)))), rows


class SiteTree:
    """The nodes of one host's style tree that MIN_PAGES pages have, with their importance."""

    def __init__(self, nodes: Iterable[tuple[int, int, bool, int, float, int, float]], low: float = LOW, low_inside: float = LOW_INSIDE, gamma: float = GAMMA):
        """nodes: path, parent, inside, pages, presentation, blocks, repeated (sum of blocks' weights)."""
        about = {n[0]: n[1:] for n in nodes}
        below: dict[int, list[int]] = {}
        for p, x in about.items():
            if p:
                below.setdefault(x[0], []).append(p)
        order, todo = [], [p for p, x in about.items() if x[0] not in about or not p]
        while todo:
            p = todo.pop()
            order.append(p)
            todo += below.get(p, [])
        self.importance: dict[int, float] = {}
        #: Nodes that are removed with all that is under them, and nodes whose own text is.
        self.noise: set[int] = set()
        self.own_noise: set[int] = set()
        sums: dict[int, tuple[int, float]] = {}
        holds: set[int] = set()  # nodes with something important in or under them
        for p in reversed(order):
            _, inside, _, presentation, n, repeated = about[p]
            bar = low_inside if inside else low
            children = below.get(p, [])
            own = 1 - repeated / n if n else 0.0
            total = n + sum(sums[c][0] for c in children)
            weight = repeated + sum(sums[c][1] for c in children)
            sums[p] = (total, weight)
            content = 1 - weight / total if total else 0.0
            kept = gamma ** len(children)
            self.importance[p] = (1 - kept) * presentation + kept * content if children else content
            important = total and self.importance[p] >= bar and (not children or n and own >= bar)
            if n and own < bar:
                self.own_noise.add(p)
            if important or any(c in holds for c in children):
                holds.add(p)
            elif total:
                self.noise.add(p)
        self.noise.discard(0)


NO_TREE = SiteTree([])


def main_text(html: str | None, tree: SiteTree = NO_TREE) -> str:
    """A page's main text without unimportant branches; where nothing would be left, without those alone that names tell."""
    root = parse(html)

    def unimportant(node: Node) -> bool:
        return node.named or node.path in tree.noise

    tops = article_of(root)
    parts = [text for top in tops if not _under_noise(top, unimportant) for node, text in blocks(top, unimportant) if node.path not in tree.own_noise]
    if not parts:
        parts = [text for top in tops for _, text in blocks(top, lambda n: n.named)]
    return " ".join(parts)


def _under_noise(top: Node, unimportant) -> bool:
    while top.parent is not None:
        if unimportant(top):
            return True
        top = top.parent
    return False


def _host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def style_tree(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Rows as in TREE, of the nodes that min_pages distinct pages of a host (columns host, html) have.

    presentation is P; repeated is the sum of log n to the base pages over blocks.
    """

    def each(batches):
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, rows = features(page.as_py())
                rows.sort()
                for column, x in zip(columns, (host, found, _hash(repr(rows)), [dict(zip(("path", "parent", "inside", "kind", "value"), r, strict=True)) for r in rows]), strict=True):
                    column.append(x)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("path", pa.int64()), ("parent", pa.int64()), ("inside", pa.bool_()), ("kind", pa.int32()), ("value", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "print", "content", "rows"])

    seen = pages.select("host", "html").mapInArrow(each, "host string, print long, content long, rows array<struct<path: long, parent: long, inside: boolean, kind: int, value: long>>")
    # One page stands for all of equal print: the one whose features have the least hash.
    once = seen.groupBy("host", "print").agg(F.min(F.struct("content", "rows")).alias("page"))
    spread = once.select("host", F.explode("page.rows").alias("r")).select("host", "r.*").groupBy("host", "path", "parent", "inside", "kind", "value").count()
    node = spread.groupBy("host", "path", "parent", "inside").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("count"))).alias("pages"),
        F.sum(F.when(F.col("kind") == 0, F.col("count") * F.log2("count"))).alias("s"),
        F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("count"))), F.lit(0)).alias("blocks"),
        F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("count") * F.log2("count"))), F.lit(0.0)).alias("r"),
    )
    base = F.log2("pages")
    return node.where(F.col("pages") >= min_pages).select("host", "path", "parent", "inside", "pages", (1 - F.col("s") / (F.col("pages") * base)).alias("presentation"), "blocks", (F.col("r") / base).alias("repeated"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, low: float = LOW, low_inside: float = LOW_INSIDE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each page, as in RESULT: its main text and its code points."""
    spark = pages.sparkSession
    work = Workspace(spark)
    bounded_batches(spark)
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", _host(F.col("url")))
    nodes = work.keep(style_tree(page, max(min_pages, 2)))
    if work.size(nodes) <= broadcast_bytes:
        by_host: dict[str, list] = {}
        for r in nodes.collect():  # bounded by broadcast_bytes
            by_host.setdefault(r.host, []).append(tuple(r)[1:])
        shared = spark.sparkContext.broadcast(by_host)

        def each(batches):
            trees: dict[str, SiteTree] = {}
            for batch in batches:
                texts = []
                for host, html in zip(batch.column(3).to_pylist(), batch.column(2), strict=True):
                    if host in shared.value and host not in trees:
                        trees[host] = SiteTree(shared.value[host], low, low_inside)
                    texts.append(main_text(html.as_py(), trees.get(host, NO_TREE)))
                yield _rows(batch.column(0), batch.column(1), texts)

        return page.mapInArrow(each, RESULT)

    # A host's nodes come before its pages, once for each of its salts. Hosts beyond a
    # thousandth of all pages are a thousand at most.
    total = page.count()
    large = page.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") * 1000 > total).select("host", F.ceil(F.col("n") * 1000 / total).cast("int").alias("salts"))
    large = F.broadcast(large)
    salts = F.coalesce("salts", F.lit(1))
    mine = page.join(large, "host", "left").select("host", F.pmod(F.xxhash64("page_id", "url"), salts).cast("int").alias("salt"), "page_id", "url", "html", *[F.lit(None).cast(k).alias(n) for n, k in (x.split() for x in TREE.split(", ")[1:])])
    theirs = nodes.join(large, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("host", "salt", F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), *[x.split()[0] for x in TREE.split(", ")[1:]])
    both = mine.unionByName(theirs).repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("path").isNull(), "page_id")

    def grouped(batches):
        at, rows, tree = None, [], None
        for batch in batches:
            ids, urls, texts = [], [], []
            for host, page_id, url, html, *node in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), *(batch.column(k).to_pylist() for k in range(5, 12)), strict=True):
                if host != at:
                    at, rows, tree = host, [], None
                if node[0] is not None:
                    if tree is not None:  # the next salt of the same host
                        rows, tree = [], None
                    rows.append(tuple(node))
                    continue
                tree = tree or SiteTree(rows, low, low_inside)
                ids.append(page_id)
                urls.append(url)
                texts.append(main_text(html.as_py(), tree))
            yield _rows(pa.array(ids, pa.int64()), pa.array(urls, pa.string()), texts)

    return both.mapInArrow(grouped, RESULT)


def _rows(ids: pa.Array, urls: pa.Array, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, urls, pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
