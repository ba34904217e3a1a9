"""Main text of web pages by composite text density.

A page is read into a tree that forgives unclosed and stray tags, in time linear in the page.
Parts that are never the article (menus, headers and footers of the page, asides, forms,
scripts, and blocks whose class, id or role names adverts, notices, sidebars or reader
comments) are cut first. A name cuts blocks only, never words within a paragraph, and not a
block that holds the page's heading, its main element or an article, nor the header of an
article, nor the wrapper beside whose text there is next to none outside named blocks; and if names would cut all the text there is, they cut nothing. Every node left has a
density: its characters per tag, adjusted by how much of
them stands in links, against the share of links in the whole body. A node's density sum
adds up its children's. The node of the greatest sum is the article; the least density on
its path to the body is the threshold, and below other nodes that reach it, the subtree of
the greatest sum is kept as well. A heading of the first rank that stands before the article
belongs to it if it has none of its own.

Character references are decoded, white space inside a block becomes one blank, and
blocks are joined in page order by one line feed.

Edge cases: null and empty html give the empty text; pages without a body are their own
body; equal sums go to the node that comes first; nesting and length are not limited (no
recursion); repeated rows stay; extra columns pass through (older columns of the names
added here are replaced).
"""

from __future__ import annotations

import html as html_lib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|noembed|noframes|xmp"
CUT_TAGS = frozenset("nav footer aside form button select option head menu dialog svg canvas object audio video".split()) | frozenset(RAW.split("|"))
NAMES = "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promos promoted related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
#: What may follow a name in a class: comment-list, nav-2, but not comment-free.
PARTS = "area articles bar block body bottom box button buttons col column container content form group head holder icons inner item items left links list main media menu message outer panel post posts primary right row secondary section signup slot stories text thread title top unit wrap wrapper".split()
CUT_NAME = re.compile(rf"(?:^|\s)(?!(?:has|with|no|non|without)[-_])(?:[^\s]*[-_])?(?:{'|'.join(NAMES)})(?:[-_](?:{'|'.join(PARTS)}|\d+))*(?=\s|$)", re.I)
#: A block's own text against all text outside named blocks, from which on it is the article's wrapper; and for names of SURE_NAME.
WRAPPER_TIMES, SURE_TIMES = 3, 8
SURE_NAME = re.compile(r"(?:^|[\s_-])(?:comments?|consent|cookies?|disclaimer|disqus|gdpr|newsletter|respond|subscribe|related|sponsor(?:ed)?)(?:[\s_-]|$)", re.I)
HEADER_NAME = re.compile(r"(?:^|[\s_-])header(?:[\s_-]|$)", re.I)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
KEPT_TAGS = frozenset("html body main article".split())
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S | re.I)
NAMING = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: An opening tag of the key closes an open one of these, unless one of SCOPE stands between.
_P_CLOSERS = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
CLOSES = {k: frozenset(["p"]) for k in _P_CLOSERS} | {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "body": frozenset(["head"]), "option": frozenset(["option"])}
SCOPE = frozenset("html body main article section div table ul ol dl aside nav header footer form blockquote figure".split())


class Dom:
    """Nodes in page order (0 is the root) and the page's run of texts and block bounds."""

    def __init__(self):
        self.tag = ["#root"]
        self.parent = [-1]
        self.names = [""]
        self.roles = [""]
        self.hidden = [False]
        self.flow: list[tuple[int, str]] = []  # (node, text); node -1 is a block bound


class Open:
    """The open elements, with the places of each tag and of the scopes, so that no search walks the stack."""

    def __init__(self):
        self.nodes = [0]
        self.tags = ["#root"]
        self.places: dict[str, list[int]] = {}
        self.scopes = [0]

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        if tag in SCOPE:
            self.scopes.append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def close(self, size: int) -> None:
        """Leaves the lowest `size` open."""
        while len(self.nodes) > size:
            self.nodes.pop()
            tag = self.tags.pop()
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()

    def end(self, tag: str) -> None:
        if held := self.places.get(tag):
            self.close(held[-1])

    def start(self, tag: str) -> None:
        """Closes what the tag's beginning closes."""
        while tag in CLOSES:
            last = max((held[-1] for t in CLOSES[tag] if (held := self.places.get(t))), default=0)
            if last <= self.scopes[-1]:
                break
            self.close(last)


def parse(page: str) -> Dom:
    dom = Dom()
    opened = Open()
    at = 0

    def text(s: str) -> None:
        if s:
            dom.flow.append((opened.nodes[-1], s))

    def bound(tag: str) -> None:
        if tag not in INLINE:
            dom.flow.append((-1, ""))
        elif tag == "br":
            dom.flow.append((opened.nodes[-1], " "))

    for m in TOKEN.finditer(page):
        if m.start() > at:
            text(html_lib.unescape(page[at : m.start()]))
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        bound(tag)
        if m["end"]:
            opened.end(tag)
            continue
        opened.start(tag)
        names = roles = ""
        hidden = False
        if m["attrs"]:
            for key, a, b, c in NAMING.findall(m["attrs"]):
                key, value = key.lower(), a or b or c
                if key == "role":
                    roles = value.lower()
                elif key in ("class", "id"):
                    names += " " + value
                else:
                    hidden |= key == "hidden" or value.lower() == "true"
        dom.tag.append(tag)
        dom.parent.append(opened.nodes[-1])
        dom.names.append(names)
        dom.roles.append(roles)
        dom.hidden.append(hidden)
        if tag not in VOID and not m["attrs"].endswith("/"):
            opened.push(len(dom.tag) - 1, tag)
    text(html_lib.unescape(page[at:]))
    return dom


def inherited(dom: Dom, own: list[bool]) -> list[bool]:
    """Which nodes have the mark or lie in one that has it."""
    out = list(own)
    for i in range(1, len(out)):
        out[i] = out[i] or out[dom.parent[i]]
    return out


def holding(dom: Dom, own: list[bool]) -> list[bool]:
    """Which nodes have the mark or hold one that has it."""
    out = list(own)
    for i in range(len(out) - 1, 0, -1):
        if out[i]:
            out[dom.parent[i]] = True
    return out


def cut_nodes(dom: Dom) -> list[bool]:
    """Which nodes are, or lie in, parts that are never the article."""
    n = len(dom.tag)
    in_article = inherited(dom, [t == "article" for t in dom.tag])
    plain = [dom.tag[i] in CUT_TAGS or (dom.tag[i] == "header" and not in_article[i]) or (dom.tag[i] not in KEPT_TAGS and (dom.hidden[i] or dom.roles[i] in CUT_ROLES)) for i in range(n)]
    plain = inherited(dom, plain)
    named = [bool(dom.names[i]) and dom.tag[i] not in INLINE and dom.tag[i] not in ("html", "body") and not (in_article[i] and HEADER_NAME.search(dom.names[i])) and bool(CUT_NAME.search(dom.names[i])) for i in range(n)]
    if not any(named):
        return plain
    in_named = inherited(dom, named)
    first = [i for i in range(n) if dom.tag[i] == "h1" and not plain[i]]
    heading = first[:1] if all(in_named[i] for i in first) else []  # a heading outside named blocks needs no care
    around = wrapper(dom, plain, named)
    safe = [not plain[i] and (dom.tag[i] == "main" or (dom.tag[i] == "article" and not named[i]) or i in heading or i == around) for i in range(n)]
    # an article in a block of comments is one of them
    comments = inherited(dom, [named[i] and "comment" in dom.names[i].lower() for i in range(n)])
    safe = holding(dom, [safe[i] and not (comments[i] and dom.tag[i] == "article") for i in range(n)])
    cut = inherited(dom, [plain[i] or (named[i] and not safe[i] and dom.tag[i] not in KEPT_TAGS) for i in range(n)])
    left = any(node >= 0 and not cut[node] and s.strip() for node, s in dom.flow)
    return cut if left else plain


def wrapper(dom: Dom, plain: list[bool], named: list[bool]) -> int:
    """The named block, if any, that must be the article's wrapper: outside named blocks there is next to no text against its own.

    A block's own text is what lies in no named block within it; links don't count. -1 if there is none.
    """
    n = len(dom.tag)
    near, link = [-1] * n, [False] * n
    for i in range(1, n):
        near[i] = i if named[i] and not plain[i] else near[dom.parent[i]]
        link[i] = link[dom.parent[i]] or dom.tag[i] == "a"
    own, rest = {}, 0
    for node, s in dom.flow:
        if node >= 0 and not plain[node] and not link[node]:
            size = len("".join(s.split()))
            if near[node] < 0:
                rest += size
            else:
                own[near[node]] = own.get(near[node], 0) + size
    if not own:
        return -1
    most = max(own, key=lambda i: (own[i], -i))
    others = rest + sum(own.values()) - own[most]
    # what a page says of itself in names (comments and the like) is believed longer than where it puts things
    times = SURE_TIMES if SURE_NAME.search(dom.names[most]) else WRAPPER_TIMES
    return most if own[most] > times * rest and 2 * own[most] > others else -1


def hosts(dom: Dom) -> list[int]:
    """The parent of each node in the tree without inline formatting, which counts as text of the element around it (links stay nodes)."""
    host = list(dom.parent)
    for i in range(1, len(host)):
        up = host[i]
        while up > 0 and formatting(dom.tag[up]):
            up = host[up]
        host[i] = up
    return host


def formatting(tag: str) -> bool:
    return tag in INLINE and tag != "a"


def densities(dom: Dom, cut: list[bool], body: int, host: list[int]) -> list[float]:
    """Link-adjusted characters per tag of every node; cut nodes count for nothing."""
    n = len(dom.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[dom.parent[i]] or dom.tag[i] == "a"
    for node, s in dom.flow:
        if node >= 0 and not cut[node]:
            size = len("".join(s.split()))
            chars[node] += size
            link_chars[node] += size * in_link[node]
    for i in range(n - 1, 0, -1):
        if cut[i]:
            continue
        up = host[i]
        chars[up] += chars[i]
        link_chars[up] += link_chars[i]
        tags[up] += tags[i] + (not formatting(dom.tag[i]))
        link_tags[up] += link_tags[i] + (dom.tag[i] == "a")
    share = link_chars[body] / max(1, chars[body])
    out = []
    for c, t, lc, lt in zip(chars, tags, link_chars, link_tags):
        if not c:
            out.append(0.0)
            continue
        t, plain = max(1, t), max(1, c - lc)
        base = math.log(c / plain * lc + share * c + math.e)
        out.append(c / t * math.log(c / max(1, lc) * t / max(1, lt) + 1e-9, base) if base > 1 else c / t * math.log(c * t + 1e-9))
    return [max(0.0, x) for x in out]


def main_nodes(dom: Dom) -> list[bool]:
    """Which nodes belong to the article."""
    n = len(dom.tag)
    cut = cut_nodes(dom)
    body = next((i for i in range(n) if dom.tag[i] == "body"), 0)
    inside = inherited(dom, [i == body for i in range(n)])
    if body and any(node >= 0 and s.strip() and not cut[node] and not inside[node] for node, s in dom.flow):
        body = 0  # a stray end tag put text behind the body
    host = hosts(dom)
    dense = densities(dom, cut, body, host)
    total = [0.0] * n
    leaf = [True] * n
    for i in range(n - 1, 0, -1):
        if not cut[i] and not formatting(dom.tag[i]):
            total[host[i]] += dense[i]
            leaf[host[i]] = False
            if leaf[i]:
                total[i] = dense[i]
    best = list(range(n))  # the node of the greatest sum in each subtree
    for i in range(n - 1, 0, -1):
        up = host[i]
        if not cut[i] and not formatting(dom.tag[i]) and (total[best[i]], -best[i]) > (total[best[up]], -best[up]):
            best[up] = best[i]
    top = best[body]
    threshold, at = dense[top], top
    while at != body and at > 0:
        at = host[at]
        threshold = min(threshold, dense[at])
    chosen = {top}
    reached = [False] * n
    reached[body] = True
    for i in range(body, n):
        if i != body:
            reached[i] = reached[host[i]] and not cut[i] and not formatting(dom.tag[i]) and dense[i] >= threshold - 1e-9
        if reached[i] and dense[i] > 0:
            chosen.add(best[i])
    kept = article(dom, cut, chosen)
    if not any(kept[i] and dom.tag[i] == "h1" for i in range(n)):
        begin = next((i for i in range(n) if kept[i]), 0)
        if heading := [i for i in range(begin) if dom.tag[i] == "h1" and not cut[i]]:
            kept = article(dom, cut, chosen | {heading[-1]})
    return kept


def article(dom: Dom, cut: list[bool], chosen: set[int]) -> list[bool]:
    """The nodes below the chosen ones that are not cut."""
    kept = [False] * len(cut)
    for i in range(len(cut)):
        kept[i] = not cut[i] and (i in chosen or (i > 0 and kept[dom.parent[i]]))
    return kept


def main_text(page: str | None) -> str:
    dom = parse(page or "")
    kept = main_nodes(dom)
    blocks, own = [], []
    for node, s in [*dom.flow, (-1, "")]:
        if node < 0:
            if block := " ".join("".join(own).split()):
                blocks.append(block)
            own = []
        elif kept[node]:
            own.append(s)
    return "\n".join(blocks)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The rows with `text` and `n_chars` in place of the html."""

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(html_col).to_pylist()]
            kept = [n for n in b.schema.names if n != html_col]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"])

    pages = pages.drop(*{"text", "n_chars"} - {html_col})
    out = pages.drop(html_col).select("*", F.lit("").cast("string").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return pages.mapInArrow(run, out)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
