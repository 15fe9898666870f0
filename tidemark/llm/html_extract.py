"""Main text of web pages by wrapper induction.

Pages of a host share a template. Each page becomes a DOM tree and a skeleton, in which
runs of alike siblings are one node. The host's most frequent skeleton is its wrapper;
every other skeleton is aligned with it by simple tree matching. A wrapper node whose text
is the same on nearly all pages that have it is template; the nodes that vary are slots,
and the varying text that a slot holds over all pages is its weight. Tags and roles say
what a part is where a page uses them: an article or main element bounds the text, and
menus, forms and the like go. Where there is neither, the text is what lies under the
deepest wrapper node that holds most of the weight. Names of classes only break ties: a slot
named as a side part (menus and adverts vary too) goes unless it holds most of the weight.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(["script", "style", "noscript", "template", "textarea", "iframe", "xmp"])
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that may bound the text of pages without an article or main element.
BOXES = frozenset("html body div section center table tbody tr td".split())
#: An open element of the key is closed by a start tag among the values.
_P_ENDS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"p": _P_ENDS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
DROP = frozenset("head title nav footer aside form button select input dialog svg object canvas audio video".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words of class and id names that tell a part is not the article, alone or with words of layout.
_SIDE = (
    r"nav|navbar|navigation|menu|breadcrumbs?|header|masthead|topbar|footer|side-?bar|aside|ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay"
    r"|newsletter|subscribe|subscription|sign-?up|share|sharing|social|related|recommend\w*|comments?|disqus|replies|respond|widgets?|login|search|pagination|pager|toolbar|skip-?link|disclaimer"
)
_LAYOUT = r"site|page|main|top|bottom|left|right|global|primary|secondary|box|bar|list|links?|items?|posts?|articles?|stories|area|section|wrap|wrapper|container|block|content|inner|outer|row|col|slot|unit|form|buttons?|icons?|media|thread|text|\d+"
NOT_ARTICLE = re.compile(rf"(?:(?:{_LAYOUT}|{_SIDE})[-_]+)*(?:{_SIDE})(?:[-_]+(?:{_LAYOUT}|{_SIDE}))*", re.I)
#: Words that prose inside an article may carry as well: they need a second sign, text that is all links.
_WEAK = re.compile(r"(?:share|promo\w*|notices?|alert|search|widgets?)", re.I)
#: Siblings that may repeat as a group.
GROUP = 8
_TOKEN = re.compile(r"<(?:!--(?:.*?-->|.*\Z)|(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[!?][^>]*(?:>|\Z))", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Node:
    __slots__ = ("tag", "names", "role", "kids", "label", "holds_article")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.kids, self.names, self.role, self.holds_article = tag, [], "", "", False
        if attrs and not attrs.isspace():
            for m in _ATTR.finditer(attrs):
                value = m[2] or m[3] or m[4] or ""
                if m[1].lower() == "role":
                    self.role = value.strip().lower()
                else:
                    self.names += " " + value
        self.label = tag + "." + ".".join(re.findall(r"[A-Za-z_-]+", self.names)) if self.names else tag


def parse(source: str) -> Node:
    """A DOM tree; unclosed and misnested elements are closed as browsers would in the common cases."""
    root = Node("#root")
    stack, at, n = [root], 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            stack[-1].kids.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            stack[-1].kids.append(html.unescape(source[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        attrs = m[3] or m[6] or ""
        for i in range(len(stack) - 1, 0, -1):
            if tag in CLOSES.get(stack[i].tag, ()):
                del stack[i:]
                break
            if stack[i].tag not in INLINE and stack[i].tag not in CLOSES:
                break
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in ("article", "main") or node.role == "main":
            for above in stack:
                above.holds_article = True
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            stop = end.start() if end else n
            at = source.find(">", stop) + 1 or n if end else n
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
    return root


def not_article(node: Node, inside: bool) -> bool:
    """Whether a part is a menu, header, notice and the like. ``inside``: it lies in an article or main element."""
    if node.tag in DROP or node.tag == "header" and not inside and not node.holds_article:
        return True
    if node.tag in ("html", "body", "article", "main", "#root"):
        return False
    if node.role in ROLES and not node.holds_article:
        return True
    return False


def named_aside(node: Node, inside: bool) -> bool:
    """Whether class or id names say that a part is not the article."""
    if not node.names or node.holds_article or node.tag in ("html", "body", "article", "main", "#root"):
        return False
    if inside and node.tag in ("header", "h1", "h2", "h3", "h4", "h5", "h6"):
        return False
    return any(NOT_ARTICLE.fullmatch(n) for n in node.names.split())


def weakly_named(node: Node) -> bool:
    """Whether all names that say so are such as prose may carry."""
    names = [n for n in node.names.split() if NOT_ARTICLE.fullmatch(n)]
    return all(_WEAK.fullmatch(n) for n in names)


def regions(root: Node) -> list[Node]:
    """The outermost article elements that aren't in a dropped part, else main, else everything."""

    def find(wanted) -> Iterator[Node]:
        stack = [iter(root.kids)]
        while stack:
            for k in stack[-1]:
                if isinstance(k, Node):
                    if wanted(k):
                        yield k
                    elif not not_article(k, False) and not named_aside(k, False):
                        stack.append(iter(k.kids))
                        break
            else:
                stack.pop()

    return list(find(lambda k: k.tag == "article")) or list(find(lambda k: k.tag == "main" or k.role == "main")) or [root]


class Block:
    """A text, the elements it lies in (outermost first, the block element last), the outermost of them named as a side part, and whether an article or main element holds it.

    A name that prose in an article may carry as well counts only where the text is all links.
    """

    __slots__ = ("text", "path", "aside", "inside")

    def __init__(self, text: str, path: list[Node], asides: list[Node], inside: bool, linked: bool):
        self.text, self.path, self.inside = text, path, inside
        self.aside = next((a for a in asides if not inside or linked or not weakly_named(a)), None)


def blocks(root: Node) -> list[Block]:
    """Blocks in page order; white space is one space, trimmed, empty blocks left out. Parts that a tag or role rules out give none."""
    out: list[Block] = []
    pending: list[tuple[str, bool]] = []  # text, and whether it is in a link

    for region in regions(root):
        # an explicit stack: pages may nest deeper than Python recurses
        stack = [(region, iter(region.kids))]
        asides: list[Node] = []
        inside = region.tag != "#root"

        def flush(stack=stack, asides=asides, inside=inside) -> None:
            text, linked = " ".join("".join(x for x, _ in pending).split()), all(link or x.isspace() for x, link in pending)
            pending.clear()
            if text:
                path = [n for n, _ in stack]
                while path[-1].tag in INLINE and len(path) > 1:
                    path.pop()
                out.append(Block(text, path, asides, inside, linked))

        while stack:
            node, kids = stack[-1]
            for k in kids:
                if isinstance(k, str):
                    pending.append((k, any(n.tag == "a" for n, _ in stack)))
                elif k.tag in ("br", "hr", "img", "wbr"):
                    if k.tag == "hr":
                        flush()
                    elif k.tag == "br":
                        pending.append((" ", False))
                elif not_article(k, inside):
                    if k.tag not in INLINE:
                        flush()
                else:
                    aside = named_aside(k, inside)
                    if k.tag not in INLINE or aside:
                        flush()
                    if aside:
                        asides.append(k)
                    stack.append((k, iter(k.kids)))
                    break
            else:
                if node.tag not in INLINE or asides and asides[-1] is node:
                    flush()
                if asides and asides[-1] is node:
                    asides.pop()
                stack.pop()
    return out


def _folded(shapes: list[str]) -> list[int]:
    """For each of some siblings the place of the one that stands for it: a group of up to GROUP siblings that repeats is told once.

    A started repeat at the end counts if the group has repeated before.
    """
    kept: list[int] = []
    place: list[int] = []
    at, again = 0, 0
    while at < len(shapes):
        left = len(shapes) - at
        for size in range(1, min(GROUP, len(kept)) + 1):
            n = min(size, left)
            if (n == size or again == size) and all(shapes[at + t] == shapes[kept[t - size]] for t in range(n)):
                place += kept[-size:][:n]
                at, again = at + n, size
                break
        else:
            kept.append(at)
            place.append(at)
            at, again = at + 1, 0
    return place


def skeleton(root: Node) -> tuple[str, dict[int, int]]:
    """The element structure as text, and the number of each element's skeleton node (in preorder) by id().

    Neighbouring siblings of one structure are one node, and so are groups that repeat
    (terms and definitions, rows of two colours), so that lists and runs of paragraphs have
    the same skeleton whatever their length. Deep nesting is cut at 60 levels: what lies
    deeper has no node, and its text is never template.
    """
    shape: dict[int, str] = {}
    kids: dict[int, list[tuple[Node, int]]] = {}

    def shaped(node: Node, depth: int) -> str:
        own = [k for k in node.kids if isinstance(k, Node) and k.tag not in RAW and k.tag not in INLINE and k.tag not in VOID and k.tag != "head"] if depth < 60 else []
        shapes = [shaped(k, depth + 1) for k in own]
        place = _folded(shapes)
        kids[id(node)] = list(zip(own, place, strict=True))
        shape[id(node)] = text = re.sub(r"[(),]", "_", node.label) + "(" + ",".join(shapes[i] for i in dict.fromkeys(place)) + ")"
        return text

    whole = shaped(root, 0)
    number: dict[int, int] = {}

    def count(node: Node, at: int) -> int:
        """Number ``node`` at ``at``; the next free number."""
        number[id(node)], free, first = at, at + 1, {}
        for k, place in kids.get(id(node), ()):
            if place in first:
                count(k, first[place])
            else:
                first[place] = free
                free = count(k, free)
        return free

    count(root, 0)
    return whole, number


def _tree(text: str) -> list[tuple[str, list[int]]]:
    """(label, children) of each node of a skeleton, in preorder."""
    nodes: list[tuple[str, list[int]]] = []
    open_: list[int] = []
    for m in re.finditer(r"([^(),]+)\(|\)", text):
        if m[1]:
            if open_:
                nodes[open_[-1]][1].append(len(nodes))
            open_.append(len(nodes))
            nodes.append((m[1], []))
        else:
            open_.pop()
    return nodes


@lru_cache(maxsize=4096)
def align(page: str, wrapper: str) -> dict[int, int]:
    """Simple tree matching: the largest order-preserving match of two skeletons, page node to wrapper node.

    Equal subtrees at the same end of two lists of children match as a whole, so that only
    the differing middles are held against one another.
    """
    if page == wrapper:
        return {i: i for i in range(page.count("("))}
    a, b = _tree(page), _tree(wrapper)
    known: dict[tuple, int] = {}
    kinds = []
    for tree in (a, b):
        kind = [0] * len(tree)
        for i in reversed(range(len(tree))):
            kind[i] = known.setdefault((tree[i][0], *(kind[k] for k in tree[i][1])), len(known))
        kinds.append(kind)
    ends_a = _sizes(a)
    memo: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def match(i: int, j: int) -> tuple[int, list[tuple[int, int]]]:
        if a[i][0] != b[j][0]:
            return 0, []
        if kinds[0][i] == kinds[1][j]:
            return ends_a[i], []
        if (i, j) not in memo:
            ka, kb, pairs, more = a[i][1], b[j][1], [], 0
            low, high = 0, 0
            while low < min(len(ka), len(kb)) and kinds[0][ka[low]] == kinds[1][kb[low]]:
                low += 1
            while high < min(len(ka), len(kb)) - low and kinds[0][ka[-1 - high]] == kinds[1][kb[-1 - high]]:
                high += 1
            for x, y in [*zip(ka[:low], kb[:low], strict=True), *zip(ka[len(ka) - high :], kb[len(kb) - high :], strict=True)]:
                pairs.append((x, y))
                more += ends_a[x]
            ka, kb = ka[low : len(ka) - high], kb[low : len(kb) - high]
            w = [[0] * (len(kb) + 1) for _ in range(len(ka) + 1)]
            s = [[match(x, y)[0] for y in kb] for x in ka]
            for x in range(len(ka)):
                for y in range(len(kb)):
                    w[x + 1][y + 1] = max(w[x][y + 1], w[x + 1][y], w[x][y] + s[x][y])
            x, y = len(ka), len(kb)
            while x and y:
                if w[x][y] == w[x - 1][y]:
                    x -= 1
                elif w[x][y] == w[x][y - 1]:
                    y -= 1
                else:
                    x, y = x - 1, y - 1
                    pairs.append((ka[x], kb[y]))
            memo[i, j] = 1 + more + w[-1][-1], pairs
        return memo[i, j]

    found, todo = {}, [(0, 0)] if match(0, 0)[0] else []
    while todo:
        i, j = todo.pop()
        if kinds[0][i] == kinds[1][j]:  # all below matches as it stands
            found.update(zip(range(i, i + ends_a[i]), range(j, j + ends_a[i]), strict=True))
            continue
        found[i] = j
        todo += memo[i, j][1]
    return found


def _sizes(tree: list[tuple[str, list[int]]]) -> list[int]:
    """Nodes of the subtree of each node."""
    out = [1] * len(tree)
    for i in reversed(range(len(tree))):
        out[i] += sum(out[k] for k in tree[i][1])
    return out


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 3) - (1 << 63)


def host_of(url):
    """The host of a URL column; pages without a URL share the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))


def _ends(shape: str) -> list[int]:
    """For each node of a skeleton, the number after its last descendant."""
    ends, open_, n = [], [], 0
    for m in re.finditer(r"([^(),]+)\(|\)", shape):
        if m[1]:
            open_.append(n)
            ends.append(0)
            n += 1
        else:
            ends[open_.pop()] = n
    return ends


def wrappers(pages: DataFrame, scratch: Scratch, share: float = 0.9, least_pages: int = 8) -> DataFrame:
    """Rows (host, wrapper, fixed, weight, pages): each host's wrapper, the texts that are template, as node:hash, and the characters of varying text by node, as node:characters.

    Counts run over distinct pages (by their visible text), all of them. A text is template
    if it stands on ``share`` of the pages that have its wrapper node; on all of them where
    these are fewer than ``least_pages``, and never where they are fewer than three. The
    counts are combined before the shuffle, so a host with a third of all pages is no more
    work for one task than another; per host and node at most one text can pass.
    """

    def skeletons(c: dict) -> dict:
        rows = []
        for source in c["html"].to_pylist():
            root = parse(source or "")
            shape, number = skeleton(root)
            found = blocks(root)
            texts = {(number.get(id(b.path[-1]), -1), _hash(b.text), len(b.text)) for b in found}
            rows.append((shape, _hash("\n".join(b.text for b in found)), [{"node": n, "h": h, "size": size} for n, h, size in texts if n >= 0]))
        return {"host": c["host"], "shape": [r[0] for r in rows], "page": pa.array([r[1] for r in rows], pa.int64()), "texts": [r[2] for r in rows]}

    seen = arrow_map(pages, ["host", "html"], "host string, shape string, page long, texts array<struct<node:int,h:long,size:long>>", skeletons)
    seen = scratch.cut(seen.dropDuplicates(["host", "page"]))
    shapes = scratch.cut(seen.groupBy("host", "shape").count())
    top = scratch.cut(shapes.groupBy("host").agg(F.max(F.struct("count", "shape")).alias("top")).select("host", F.col("top.shape").alias("wrapper")))
    nodes = seen.select("host", "shape", F.explode("texts").alias("t")).groupBy("host", "shape", "t.node", "t.h", "t.size").count()
    # node -1 of a skeleton stands for its pages
    nodes = nodes.union(shapes.select("host", "shape", F.lit(-1), F.lit(0).cast("long"), F.lit(0).cast("long"), "count")).join(top, "host")

    def aligned(c: dict) -> dict:
        rows = []
        for k, (s, w, n) in enumerate(zip(c["shape"].to_pylist(), c["wrapper"].to_pylist(), c["node"].to_pylist(), strict=True)):
            at = align(s, w)
            rows += [(k, at.get(n, -1), False)] if n >= 0 else [(k, j, True) for j in sorted(set(at.values()))]
        take = pa.array([r[0] for r in rows], pa.int64())
        return {"host": c["host"].take(take), "node": pa.array([r[1] for r in rows], pa.int32()), "has": pa.array([r[2] for r in rows], pa.bool_()), **{n: c[m].take(take) for n, m in (("h", "h"), ("size", "size"), ("n", "count"))}}

    both = arrow_map(nodes, ["host", "shape", "wrapper", "node", "h", "size", "count"], "host string, node int, has boolean, h long, size long, n long", aligned).where("node >= 0")
    counted = scratch.cut(both.groupBy("host", "node", "has", "h", "size").agg(F.sum("n").alias("n")), drop=seen)
    have = counted.where("has").select("host", "node", F.col("n").alias("pages"))
    constant = (F.col("n") >= F.when(F.col("pages") < least_pages, F.col("pages")).otherwise(share * F.col("pages"))) & (F.col("pages") >= 3)
    texts = counted.where("not has").join(have, ["host", "node"]).withColumn("fixed", constant)
    whole = have.where("node = 0").select("host", "pages")
    by_node = texts.groupBy("host", "node").agg(F.max(F.when(F.col("fixed"), F.concat_ws(":", "node", "h"))).alias("fixed"), F.sum(F.when(F.col("fixed"), 0).otherwise(F.col("size") * F.col("n"))).alias("weight"))
    found = by_node.groupBy("host").agg(F.collect_set("fixed").alias("fixed"), F.collect_list(F.concat_ws(":", "node", "weight")).alias("weight"))
    return scratch.cut(top.join(found, "host").join(whole, "host").select("host", "wrapper", "fixed", "weight", "pages"))


class Wrapper:
    """A host's wrapper as the extraction uses it."""

    def __init__(self, shape: str, fixed: list[str], weight: list[str], pages: int, least_pages: int = 3):
        self.shape, self.fixed, self.ends = shape, set(fixed), _ends(shape)
        own = [0] * len(self.ends)
        for x in weight:
            node, size = map(int, x.split(":"))
            own[node] += size
        self.sums = [0]
        for x in own:
            self.sums.append(self.sums[-1] + x)
        self.known, kids, self.top = pages >= least_pages, _tree(shape), 0
        while (k := next((k for k in kids[self.top][1] if kids[k][0].split(".")[0] in BOXES and self.heavy(k, 0.7)), None)) is not None:
            self.top = k

    def heavy(self, node: int, most: float = 0.5) -> bool:
        """Whether most of the varying text of the host lies under a node; too few pages can't tell."""
        return self.known and self.sums[self.ends[node]] - self.sums[node] > most * self.sums[-1]

    def keep(self, root: Node, found: list[Block]) -> list[Block]:
        mine, number = skeleton(root)
        at = align(mine, self.shape)
        node = lambda n: at.get(number.get(id(n), -1), -1)
        out = []
        for b in found:
            if f"{node(b.path[-1])}:{_hash(b.text)}" in self.fixed:
                continue
            if b.aside is not None and not (node(b.aside) >= 0 and self.heavy(node(b.aside))):
                continue
            if not b.inside and b.path[-1].tag != "h1":
                near = next((j for n in reversed(b.path) if (j := node(n)) >= 0), 0)
                if not self.top <= near < self.ends[self.top]:
                    continue
            out.append(b)
        return out


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html", most_broadcast: int = 64 << 20) -> DataFrame:
    """Rows (page_id, url, text): the article of each page, blocks joined by two line feeds, empty if there is none.

    Null and empty html gives an empty text; repeated rows are extracted alike; other
    columns are not read. The wrappers are broadcast only if their measured size is below
    ``most_broadcast`` bytes.
    """
    scratch = Scratch(df.sparkSession, "pages")
    pages = df.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{source}`").alias("html"), host_of(F.col(f"`{url}`")).alias("host"))
    wrapper = wrappers(pages, scratch)
    size = wrapper.agg(F.sum(F.octet_length("wrapper") + F.size("fixed") * 32 + F.size("weight") * 16)).first()[0] or 0
    both = pages.join(F.broadcast(wrapper) if size <= most_broadcast else wrapper, "host", "left")
    kind = df.schema[page_id].dataType.simpleString()

    def work(c: dict) -> dict:
        out, known = [], {}
        for page, host, shape, fixed, weight, pages in zip(*(c[n].to_pylist() for n in ("html", "host", "wrapper", "fixed", "weight", "pages")), strict=True):
            root = parse(page or "")
            found = blocks(root)
            if shape is not None:
                if host not in known:
                    known[host] = Wrapper(shape, fixed, weight, pages)
                found = known[host].keep(root, found)
            else:
                found = [b for b in found if b.aside is None]
            out.append("\n\n".join(b.text for b in found))
        return {"page_id": c["page_id"], "url": c["url"], "text": out}

    return arrow_map(both, ["page_id", "url", "html", "host", "wrapper", "fixed", "weight", "pages"], f"page_id {kind}, url string, text string", work)
