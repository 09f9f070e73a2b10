"""Main text of pages by site style trees.

The DOMs of one host are merged into one tree: the roots meet, and below two merged elements
those children meet that have the same style (tag, classes and role) and the same place among
their siblings of that style.  For each merged element the tree knows on how many distinct
pages it stands, which sequences of child styles (presentation) and which own texts and link
targets (content) it has there, and how often each.

* The presentation importance of an element on m pages is the entropy of its child sequences
  to the base m; the content importance is the entropy of its own contents.  Both are 1 for an
  element on a single page, and 2 / m is added for what m pages can't tell.
* The composite importance of an element with k child sequences is (1 - 0.9^k) times its
  presentation importance and 0.9^k times the mean of its own content importance and the
  composite importance of its children, each weighted by its pages.  It is composed from the
  deepest elements upwards, level by level, as joins over all hosts.
* An element is template if its own composite importance and that of everything below it are
  under `LOW`.  The topmost template elements are removed from every page of the host.

Beside the statistics, since they know nothing of a site with few pages: elements whose tag or
class says that they are menus, forms, adverts, comments and so on are removed, text outside
an article is left out where a page has one, and plain text elements of an article (headings,
paragraphs, lists, tables without class or id) stay, however often their text repeats.

Text: character references decoded, white space in a block as one space, trimmed, blocks in
page order joined by a blank line.  Null, empty or textless html: empty text.  Repeated rows
each get a row; exact copies of a page count once in the merged tree.  A row without a
usable url is a site of its own name ''.  Texts of any length are read in one pass; elements
nested deeper than `DEPTH` are kept beside each other instead of inside one another.  Extra
columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, only, tune

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: An element is template below this importance: one half means that m pages show as many different contents as a site of sqrt(m) pages could.
LOW = 0.5
#: How much of an element's importance its children have, for each of its child sequences.
DAMPING = 0.9
#: Deepest nesting of a tree, as in browsers.
DEPTH = 512
#: Template lists up to so many bytes are broadcast; larger ones are joined by host, each host over SALTS tasks.
BROADCAST_BYTES = 32 << 20
SALTS = 32

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes iframe".split())
DROP = set("head script style noscript template iframe svg math canvas audio video object nav footer aside form button select option textarea input label fieldset dialog menu map title link meta noframes noembed xmp datalist output progress meter".split())
BLOCK = set("address article blockquote body caption center dd details dir div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
PLAIN = set("h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption b i em strong a span code br sub sup u s small big q cite abbr mark time kbd samp var del ins font tt center".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt"}
UNSEEN = RAW - {"iframe"} | {"head", "meta", "link", "template", "noscript"}
FORMAT = set("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
STOP = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
# Words of class and id names that tell furniture from text.
NAMES = set("ad ads adv advert adverts advertisement advertising advertorial adsense adslot banner banners sponsor sponsored sponsors promo promos promotion promoted nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs pagination pager paging footer foot masthead topbar bottombar toolbar sidebar sidebars aside rail widget widgets cookie cookies consent gdpr notice notices disclaimer alert popup modal overlay lightbox newsletter subscribe subscription signup login signin register share sharing social related recommended recommendations recirc outbrain taboola comment comments commentlist respond disqus replies reply discussion search searchform form hidden skip copyright tags tagcloud toc".split())
HEADER = set("header head hdr siteheader pageheader".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s>/]*)[^>]*>?|<([a-zA-Z][^\s>/]*)", re.S)
_ATTRS = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_DIGIT = re.compile(r"\d+")


def _digest(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Node:
    __slots__ = ("tag", "style", "label", "link", "names", "role", "hide", "kids", "up", "top", "inside", "plain", "depth", "key")

    def __init__(self, tag, attrs, up):
        self.tag, self.up, self.kids, self.key, self.link = tag, up, [], None, ""
        self.names, self.role, self.hide, self.style = set(), "", False, tag
        self.label = ""
        if attrs and not attrs.isspace():
            found = {}
            for k, a, b, c in _ATTR.findall(attrs):
                found.setdefault(k.lower(), a or b or c)
            self.label = " ".join(sorted(set((found.get("class", "") + " " + found.get("id", "")).split())))
            self.names = {x.lower() for x in _SPLIT.split(self.label) if x}
            self.role = found.get("role", "").lower()
            self.link = found.get("href", "") or found.get("src", "")
            style = found.get("style", "").replace(" ", "").lower()
            self.hide = "hidden" in found or "display:none" in style or "visibility:hidden" in style or found.get("aria-hidden", "").lower() == "true"
            kinds = " ".join(sorted(set(_DIGIT.sub("0", found.get("class", "")).split())))
            if kinds or self.role:
                self.style = f"{tag}.{kinds}|{self.role}"
        # All that depends on ancestors is carried down, so a deep tree costs no more than a flat one.
        self.depth = up.depth + 1 if up else 0
        self.top = tag in ("article", "main") or self.role == "main"
        self.inside = up is not None and (up.inside or up.top)
        self.plain = self.inside and (up.top or up.plain) and tag in PLAIN and not self.label and not self.role


def dom(text: str) -> Node:
    """A tree of nodes and strings; unclosed and misplaced tags are mended as browsers mostly do."""
    root = Node("#root", "", None)
    at, pos, n = root, 0, len(text)
    opened, beside, quoted = Counter(), Counter(), True
    ends = {}  # of elements with raw text: where the search for an end tag last failed
    while pos < n:
        m = _TOKEN.search(text, pos)
        start = m.start() if m else n
        if start > pos:
            at.kids.append(_html.unescape(text[pos:start]))
        if not m:
            break
        pos = m.end()
        if m[1]:
            tag, node = m[1].lower(), at
            if tag == "br":
                at.kids.append(Node("br", "", at))
                continue
            if beside[tag]:
                beside[tag] -= 1
                continue
            if not opened[tag]:
                continue
            while node is not root and node.tag != tag:
                if tag in FORMAT and node.tag in BLOCK:  # a stray end tag doesn't close blocks
                    node = root
                    break
                node = node.up
            if node is not root:
                at = _close(at, node.up, opened)
        elif m[2]:
            tag = m[2].lower()
            # Quotes hide a `>`; once that leads to no end of a tag, tags end at the next `>`, so no text is read again and again.
            end = _ATTRS.match(text, pos) if quoted else None
            if end is None:
                quoted = False
                stop = text.find(">", pos)
                if stop < 0:
                    break  # no tag ends any more
                attrs, pos = text[pos:stop], stop + 1
            else:
                attrs, pos = text[pos : end.end() - 1], end.end()
            if tag in CLOSES_P:
                node = at
                while node is not root and (node.tag in FORMAT):
                    node = node.up
                if node.tag == "p":
                    at = _close(at, node.up, opened)
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and at.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                at = _close(at, at.up, opened)
            if tag in SIBLINGS:
                node, last = at, None
                while node is not root and node.tag not in STOP[tag]:
                    if node.tag in SIBLINGS[tag]:
                        last = node
                    node = node.up
                if last is not None:
                    at = _close(at, last.up, opened)
            node = Node(tag, attrs, at)
            at.kids.append(node)
            if tag in RAW:
                end = None if ends.get(tag) else re.compile(rf"</{tag}\s*/?>", re.I).search(text, pos)
                ends[tag] = end is None
                node.kids.append(text[pos : end.start() if end else n])
                pos = end.end() if end else n
            elif tag not in VOID and not attrs.rstrip().endswith("/"):
                if node.depth > DEPTH:
                    beside[tag] += 1
                else:
                    at = node
                    opened[tag] += 1
    return root


def _close(at: Node, to: Node, opened: Counter) -> Node:
    while at is not to:
        opened[at.tag] -= 1
        at = at.up
    return to


def furniture(node: Node) -> bool:
    """Removed by what the element says of itself."""
    if node.tag in DROP or node.hide or node.role in ROLES:
        return True
    if node.tag in ("article", "main", "body", "html"):
        return False
    if node.names & NAMES:
        return True
    return (node.tag == "header" or bool(node.names & HEADER)) and not node.inside


def nodes(root: Node, named: bool = True):
    """Elements, parents first; with `named` only those that furniture() leaves."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node) and k.tag not in UNSEEN and not (named and furniture(k)))


def candidates(root: Node) -> list[Node]:
    """Elements that the site's statistics may remove, parents first, each with its `key` in the merged tree: not plain article text, and no ancestor of an article."""
    holds, every = set(), list(nodes(root, False))
    for node in every:
        if node.top:
            while node is not None and id(node) not in holds:
                holds.add(id(node))
                node = node.up
    root.key = 0
    found = []
    for node in every:
        place: Counter = Counter()
        for k in node.kids:
            if isinstance(k, Node) and k.tag not in UNSEEN:
                place[k.style] += 1
                k.key = _digest(f"{node.key}/{k.style}/{place[k.style]}")
        if node.up is not None and id(node) not in holds and node.tag not in ("html", "body", "br") and not node.plain:
            found.append(node)
    return found


def features(node: Node) -> tuple[int, int]:
    """Digests of an element's presentation and content; 0 for one without own text and link."""
    own = "\0".join(x for x in [node.link, *(_SPACE.sub(" ", k).strip() for k in node.kids if isinstance(k, str))] if x)
    return _digest("\0".join(k.style for k in node.kids if isinstance(k, Node) and k.tag not in UNSEEN)), _digest(own) if own else 0


def text_of(html: str | None, template: set, named: bool = True) -> str:
    """Main text of a page; `template` has the keys that its site's tree marks as template.  Without `named` the statistics alone decide."""
    if not html:
        return ""
    root = dom(html)
    tops = [x for x in nodes(root) if x.top and not x.inside] if named else []
    drop = {id(x) for x in candidates(root) if x.key in template} if template else set()
    blocks, line = [], []

    def flush():
        t = _SPACE.sub(" ", "".join(line)).strip()
        if t:
            blocks.append(t)
        line.clear()

    for top in tops or [root]:
        stack = [(top, False)]
        while stack:
            x, ended = stack.pop()
            if isinstance(x, str):
                line.append(x)
            elif ended:
                flush()
            elif x.tag == "br":
                line.append(" ")
            elif (x is top or not (furniture(x) if named else x.tag in UNSEEN)) and id(x) not in drop:
                if x.tag in BLOCK:
                    flush()
                    stack.append((x, True))
                kids = x.kids
                if named and x.tag == "header" and x is not top:
                    kids = [k for k in kids if isinstance(k, Node) and k.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "p", "div")]
                stack.extend((k, False) for k in reversed(kids))
        flush()
    return "\n\n".join(blocks)


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


NODE = "key long, parent long, depth int, presentation long, content long"
PAGE = "host string, page binary, nodes binary"


def _page_features(it):
    """Of each page its host, its digest, and its removable elements packed as five numbers each."""
    for batch in it:
        hosts, pages, packed = [], [], []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            rows = [(x.key, x.up.key, x.depth, *features(x)) for x in candidates(dom(html))]
            if rows:
                hosts.append(host)
                pages.append(hashlib.blake2b(html.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                packed.append(pa.compress(np.array(rows, np.int64).T.tobytes(), codec="zstd", asbytes=True) + len(rows).to_bytes(4, "big"))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.binary()), pa.array(packed, pa.binary())], names=["host", "page", "nodes"])


def _unpacked(it):
    """Elements of many pages; equal ones of a host are counted together."""
    for batch in it:
        out: Counter = Counter()
        for host, blob in zip(batch.column("host").to_pylist(), batch.column("nodes").to_pylist()):
            n = int.from_bytes(blob[-4:], "big")
            rows = np.frombuffer(pa.decompress(blob[:-4], decompressed_size=40 * n, codec="zstd", asbytes=True), np.int64).reshape(5, n)
            out.update(zip([host] * n, *rows.tolist()))
        keys = list(out)
        names = ["host", *(c.split()[0] for c in NODE.split(", "))]
        cols = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(list(out.values()), pa.int64())], names=[*names, "n"])


def _entropy(nlogn, pages):
    """Entropy to the base of the number of pages, and what so many pages can't tell."""
    e = F.when(pages > 1, (F.log(pages) - nlogn / pages) / F.log(pages)).otherwise(1.0)
    return F.least(F.lit(1.0), e + 2 / pages)


def style_tree(pages: DataFrame) -> DataFrame:
    """host, key, parent, depth, pages, presentation and content importance and child sequences of the merged trees' elements, from (host, html)."""
    # A page's elements are packed small before its copies meet; html itself doesn't move.
    once = pages.where("html is not null").mapInArrow(_page_features, PAGE).groupBy("host", "page").agg(F.any_value("nodes").alias("nodes"))
    f = once.select("host", "nodes").mapInArrow(_unpacked, f"host string, {NODE}, n long")
    place = ["host", "key", "parent", "depth"]
    f = f.groupBy(*place, "presentation", "content").agg(F.sum("n").alias("n"))
    by = lambda c: f.groupBy(*place, c).agg(F.sum("n").alias("n"))
    size = F.sum(F.col("n") * F.log("n"))
    shape = by("presentation").groupBy(*place).agg(F.sum("n").alias("pages"), size.alias("nlogn"), F.count(F.lit(1)).alias("sequences"))
    words = by("content").groupBy("host", "key").agg(F.sum("n").alias("_n"), size.alias("_nlogn"), F.max(F.col("content") != 0).alias("_has"))
    t = shape.join(words, ["host", "key"])
    return t.select(*place, "pages", "sequences", _entropy(F.col("nlogn"), F.col("pages")).alias("presentation"), F.when(F.col("_has"), _entropy(F.col("_nlogn"), F.col("_n"))).alias("content"))


def templates(pages: DataFrame, low: float = LOW) -> DataFrame:
    """host, key and importance of the topmost template elements of each host's merged tree, from (host, html)."""
    tree = cut(style_tree(pages))
    depths = sorted((r[0] for r in tree.select("depth").distinct().collect()), reverse=True)  # at most DEPTH
    share = F.pow(F.lit(DAMPING), F.col("sequences"))
    done = below = None
    levels = []
    for depth in depths:
        level = tree.where(F.col("depth") == depth)
        if below is None:  # the deepest ones have no children
            level = level.withColumns({"_sum": F.lit(0.0), "_n": F.lit(0).cast("long"), "_max": F.lit(0.0)})
        else:
            kids = below.groupBy("host", F.col("parent").alias("key")).agg(F.sum(F.col("pages") * F.col("importance")).alias("_sum"), F.sum("pages").alias("_n"), F.max("most").alias("_max"))
            level = level.join(kids, ["host", "key"], "left").fillna({"_sum": 0.0, "_n": 0, "_max": 0.0})
        own = F.when(F.col("content").isNotNull(), F.col("pages"))
        n = F.col("_n") + F.coalesce(own, F.lit(0))
        inner = (F.col("_sum") + F.coalesce(own * F.col("content"), F.lit(0.0))) / n
        importance = F.when(n > 0, (1 - share) * F.col("presentation") + share * inner).otherwise(F.col("presentation"))
        level = level.withColumn("importance", importance)
        below = level.select("host", "key", "parent", "pages", "importance", F.greatest("importance", "_max", F.coalesce("content", F.lit(0.0))).alias("most")).persist()
        levels.append(below)
        done = below if done is None else done.unionByName(below)
    if done is None:
        return tree.select("host", "key", F.lit(0.0).alias("importance")).limit(0)
    noisy = done.where(F.col("most") < low)
    out = cut(noisy.join(noisy.select("host", F.col("key").alias("parent")), ["host", "parent"], "left_anti").select("host", "key", "importance"))
    for level in levels:
        level.unpersist()
    return out


def extract(pages: DataFrame, low: float = LOW, broadcast_bytes: int = BROADCAST_BYTES, named: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    tune(pages.sparkSession)
    p = only(pages, "page_id", "url", "html").withColumn("host", host_of())
    t = cut(templates(p.select("host", "html"), low).groupBy("host").agg(F.collect_list("key").alias("template")).withColumnRenamed("host", "site"))
    if (t.agg(F.sum(F.octet_length("site") + 8 * F.size("template"))).first()[0] or 0) <= broadcast_bytes:
        p = p.join(F.broadcast(t), p["host"] == t["site"], "left")
    else:
        p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        t = t.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        p = p.join(t, (p["host"] == t["site"]) & (p["salt"] == t["_salt"]), "left")
    p = p.select("page_id", "url", "html", "template")
    schema = p.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(it):
        for batch in it:
            texts = [text_of(h, set(t or ()), named) for h, t in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return p.mapInArrow(run, schema)
