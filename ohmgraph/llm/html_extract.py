"""Main text of web pages by union-free regular-expression inference per host.

A page is a stream of tags and texts. Well-formed after implied end tags, it is folded and aligned with the other pages of
its host: adjacent runs of equal tokens become repeated groups, tokens that only one side has become optional groups, texts
become slots. The result is a wrapper, a nested regular expression without unions, e.g. ``body( nav( ul( li( a#)+ ) )
div.ad( # ) article( h1# p#+ ) )``. Alignment of two wrappers is the same operation as that of two pages, so each task folds all pages of a
host that it reads into one wrapper, these meet in groups, and only the groups' wrappers meet in one task; every page takes part, and
a host with a third of all pages costs no task more than the others.

The slots of a wrapper know how the texts that fell into them behave: how many and how long they are, how much of them is inside
links, whether they ever change. A page is matched with its host's wrapper and each of its texts weighs as much as its slot: nothing
where the host always says the same or mostly links, else the mean length of the slot's texts. The main element is found by
following this weight down from the root as long as one child holds nearly all of it; a heading that changes stays with its text.
What kind of element it is, and words in class names, only tilt the weights. A page that its host's wrapper doesn't fit, or whose host
shows nothing that changes, is weighed by its own texts in the same way.

All walks are loops, so nesting has no limit; scanning is linear. A wrapper keeps at most its ``MOST_NODES`` best supported nodes;
texts elsewhere weigh as much as they are long.
"""

from __future__ import annotations

import bisect
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgraph.llm.common import BATCH, WS, Scratch, batches_of, table

MOST_NODES = 20_000
#: Pages that must agree before a slot counts as unchanging; as many more before such a text goes from inside the main element.
AGREE, SURE = 3, 6
#: A child that holds this share of the weight is entered.
NEARLY_ALL = 0.7
#: Groups in which the wrappers of a host meet first.
GROUPS = 32

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9-]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "svg", "textarea", "iframe", "select")}
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr acronym".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_OUT = frozenset("head nav footer aside form button fieldset dialog menu object input title".split())
_HEADING = frozenset("h1 h2".split())
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption address summary #".split())
_NAMED = re.compile(r"(?:^| )(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|nav\w*|menu|sidebar|footer|header|masthead|comments?|reply|replies|respond|discussion|social|share|sharing|related|recommend\w*|breadcrumbs?|newsletter|subscri\w*|popup|modal|overlay|widget|login|signup|search|pagination|pager|toolbar|copyright|legal|disclaimer)(?:$|[-_ ])", re.I)
_SPACE = re.compile(f"[{WS}\xa0]+")


# A node is [label, repeated, optional, children, stats, pages]; a text slot has the label "#" and stats
# [blocks, characters, characters in links, the text (of a repeated slot, a hash of a page's texts) if it never changed, else None].
def _tokens(html: str) -> Iterator[tuple]:
    """(text,) or (name, closing, attributes), in order; each character is looked at a bounded number of times."""
    n, at, text = len(html), 0, 0
    quoted = True  # until an attribute's quote is found to stay open
    while True:
        lt = html.find("<", at)
        if lt < 0 or lt + 1 >= n:
            break
        c = html[lt + 1]
        if html.startswith("<!--", lt):
            if lt > text:
                yield (html[text:lt],)
            end = html.find("-->", lt + 4)
            at = text = n if end < 0 else end + 3
            continue
        closing = c == "/"
        m = _NAME.match(html, lt + 1 + closing)
        if m is None and c not in "!?/" or m is None and closing and not html.startswith("</>", lt):
            at = lt + 1
            continue
        if lt > text:
            yield (html[text:lt],)
        start = m.end() if m else lt + 2
        end, seek = -1, start
        while quoted and m:
            stop = _STOP.search(html, seek)
            if stop is None or stop[0] == ">":
                end = stop.start() if stop else -1
                break
            seek = html.find(stop[0], stop.end()) + 1
            if not seek:
                break
        if end < 0:
            quoted = quoted and not m
            end = html.find(">", start)
        if end < 0:
            end = n  # a tag that never ends is markup to the end
        at = text = min(end + 1, n)
        if m is None:
            continue
        name = m[0].lower()
        if not closing and name in _RAW:
            close = _RAW[name].search(html, at)
            at = text = close.end() if close else n
            yield name, None, ""
            continue
        yield name, closing, html[start:end]
    if text < n:
        yield (html[text:],)


def tree(html: str) -> list:
    """The page as a node; texts of one block are one child, with inline markup dissolved."""
    root: list = ["", False, False, [], None, 1]
    stack, names, open_names = [root], [""], Counter()
    text: list[str] = []
    linked = depth = 0

    def flush() -> None:
        nonlocal linked
        if text:
            t = _SPACE.sub(" ", unescape("".join(text))).strip(WS + "\xa0")
            if t:
                stack[-1][3].append(["#", False, False, [], [1, len(t), min(linked, len(t)), t], 1])
            text.clear()
            linked = 0

    def pop() -> str:
        stack.pop()
        open_names[names[-1]] -= 1
        return names.pop()

    for token in _tokens(html):
        name = token[0]
        if len(token) == 1:
            text.append(name)
            if depth:
                linked += len(name)
            continue
        closing = token[1]
        if closing is None or name == "br":
            text.append(" ")
            continue
        if name in _INLINE:
            if name == "a":
                depth = max(0, depth - 1) if closing else depth + 1
            continue
        flush()
        if closing:
            if open_names[name]:
                while pop() != name:
                    pass
                depth = 0
            continue
        if name in _CLOSES_P and names[-1] == "p":
            pop()
        while names[-1] in _SIBLING.get(name, ()):
            pop()
        attrs = " ".join(sorted({w for a in _ATTR.findall(token[2]) for w in re.sub(r"\d+", "", a[1] or a[2] or a[3]).split()})) if token[2] else ""
        node = [f"{name}.{attrs}" if attrs else name, False, False, [], None, 1]
        stack[-1][3].append(node)
        if name not in _VOID:
            stack.append(node)
            names.append(name)
            open_names[name] += 1
    flush()
    return root


def _hash(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def _anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of labels that are unique in both, in an order that both share, as many as possible."""
    ca, cb = Counter(a), Counter(b)
    place = {x: j for j, x in enumerate(b) if cb[x] == 1}
    pairs = [(i, place[x]) for i, x in enumerate(a) if ca[x] == 1 and x in place]
    tails, ends, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(tails, j)
        tails[at : at + 1], ends[at : at + 1] = [j], [k]
        back.append(ends[at - 1] if at else -1)
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a common subsequence of labels: the longest one of short lists, an anchored one of long lists."""
    if not a or not b:
        return []
    out, i = [], 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        out.append((i, i))
        i += 1
    tail, m, n = [], len(a), len(b)
    while m > i and n > i and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
        tail.append((m, n))
    x, y = a[i:m], b[i:n]
    if x and y and len(x) * len(y) <= 10_000:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for p in range(len(x) - 1, -1, -1):
            for q in range(len(y) - 1, -1, -1):
                best[p][q] = best[p + 1][q + 1] + 1 if x[p] == y[q] else max(best[p + 1][q], best[p][q + 1])
        p = q = 0
        while p < len(x) and q < len(y):
            if x[p] == y[q]:
                out.append((i + p, i + q))
                p, q = p + 1, q + 1
            elif best[p + 1][q] >= best[p][q + 1]:
                p += 1
            else:
                q += 1
    elif x and y:
        where = defaultdict(list)
        for q, label in enumerate(y):
            where[label].append(q)
        cuts = [*_anchors(x, y), (len(x), len(y))]
        p0 = q0 = 0
        for p1, q1 in cuts:
            q = q0
            for p in range(p0, p1):  # between anchors: each label at its next place
                places = where.get(x[p], ())
                k = bisect.bisect_left(places, q)
                if k < len(places) and places[k] < q1:
                    out.append((i + p, i + places[k]))
                    q = places[k] + 1
            if p1 < len(x):
                out.append((i + p1, i + q1))
            p0, q0 = p1 + 1, q1 + 1
    return out + tail[::-1]


def merge(a: list, b: list, level: int = 0, row: bool = False) -> list:
    """Alignment of two nodes of equal label, in ``a``; what only one side has becomes optional. In a ``row`` they follow each other in the same pages."""
    todo, touched = [(a, b)], []
    while todo:
        a1, b1 = todo.pop()
        a1[1], a1[2], a1[5] = a1[1] or b1[1], a1[2] or b1[2], max(a1[5], b1[5]) if row else a1[5] + b1[5]
        if a1[4] is not None:
            x, y = a1[4], b1[4]
            same = None if x[3] is None or y[3] is None else _hash(f"{x[3]}\0{y[3]}") if row else x[3] if x[3] == y[3] else None
            a1[4] = [x[0] + y[0], x[1] + y[1], x[2] + y[2], same]
        if not a1[3] and not b1[3]:
            continue
        left, right = a1[3], b1[3]
        pairs = _common([x[0] for x in left], [x[0] for x in right])
        out, i, j = [], 0, 0
        for p, q in [*pairs, (len(left), len(right))]:
            for alone in (*left[i:p], *right[j:q]):
                alone[2] = True
                out.append(alone)
            if p < len(left):
                out.append(left[p])
                todo.append((left[p], right[q]))
            i, j = p + 1, q + 1
        a1[3] = out
        if len(out) > len(left):
            touched.append(a1)
    if level < 50:  # folding anew only makes a wrapper shorter
        for node in reversed(touched):
            node[3] = fold(node[3], level + 1)
    return a


def fold(items: list, level: int = 0) -> list:
    """Adjacent equal nodes, and adjacent equal runs of up to four nodes, as repeated ones."""
    out: list = []
    for x in items:
        if out and out[-1][0] == x[0]:
            merge(out[-1], x, level, row=True)[1] = True
        else:
            out.append(x)
    for period in (2, 3, 4):
        if len(out) < 2 * period:
            break
        kept: list = []
        for x in out:
            kept.append(x)
            if len(kept) >= 2 * period and all(kept[-k][0] == kept[-k - period][0] for k in range(1, period + 1)):
                for k in range(period, 0, -1):  # read as: any of the group's nodes may come again, from the group's start
                    merge(kept[-k - period], kept[-k], level, row=True)[1] = True
                del kept[-period:]
        out = kept
    return out


def _nodes(root: list) -> list[list]:
    """All nodes in reading order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node[3]))
    return out


def folded(root: list) -> list:
    for node in reversed(_nodes(root)):
        if len(node[3]) > 1:
            node[3] = fold(node[3])
    return root


def pruned(root: list, most: int = MOST_NODES) -> list:
    """Without the nodes that the fewest pages have, where there are too many; a node has no more pages than its parent."""
    nodes = _nodes(root)
    if len(nodes) <= most:
        return root
    floor = sorted((n[5] for n in nodes), reverse=True)[most]
    for n in nodes:
        n[3] = [c for c in n[3] if c[5] > floor]
    return root


def regex(root: list) -> str:
    """The wrapper as a readable expression."""
    out: list[str] = []
    stack: list = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        mark = "*" if node[1] and node[2] else "+" if node[1] else "?" if node[2] else ""
        out.append(node[0] + ("(" if node[3] else mark + " "))
        if node[3]:
            stack.append(f"){mark} ")
            stack.extend(reversed(node[3]))
    return "".join(out).strip()


def pack(pages: int, root: list) -> str:
    """As a flat list: nesting in JSON would have a limit."""
    return json.dumps([pages, [[n[0], int(n[1]), int(n[2]), len(n[3]), n[4], n[5]] for n in _nodes(root)]], ensure_ascii=False, separators=(",", ":"))


def unpack(packed: str) -> tuple[int, list]:
    pages, flat = json.loads(packed)
    root: list = []
    open_nodes: list[tuple[list, int]] = []
    for label, rep, opt, n, stats, seen in flat:
        node = [label, bool(rep), bool(opt), [], stats, seen]
        if open_nodes:
            parent, left = open_nodes.pop()
            parent[3].append(node)
            if left > 1:
                open_nodes.append((parent, left - 1))
        else:
            root = node
        if n:
            open_nodes.append((node, n))
    return pages, root


class Wrapper:
    """The wrapper of a host, ready to be matched with pages."""

    def __init__(self, pages: int, root: list):
        self.pages, self.root = pages, root
        self.places: dict[int, tuple[dict[str, list[int]], list[int]]] = {}

    def _places(self, node: list) -> tuple[dict[str, list[int]], list[int]]:
        """Where each label stands among the children, and from where to look on after each: a repeated run is read again from its start."""
        got = self.places.get(id(node))
        if got is None:
            where, back, start = defaultdict(list), [], 0
            for i, x in enumerate(node[3]):
                where[x[0]].append(i)
                if not x[1]:
                    start = i + 1
                back.append(start if x[1] else i + 1)
            got = self.places[id(node)] = (where, back)
        return got

    def match(self, page: list) -> tuple[list[list], list[int], list[list | None]]:
        """The page's nodes in reading order, the place of each one's parent, and the node of the wrapper that fits."""
        nodes, parent, fits = [], [], []
        stack: list[tuple[list, int, list | None]] = [(page, -1, self.root)]
        while stack:
            node, up, own = stack.pop()
            here = len(nodes)
            nodes.append(node)
            parent.append(up)
            fits.append(own)
            found: list[list | None] = [None] * len(node[3])
            if own is not None and own[3]:
                where, back = self._places(own)
                cur = 0
                for k, c in enumerate(node[3]):
                    at = where.get(c[0], ())
                    j = bisect.bisect_left(at, cur)
                    if j < len(at):
                        found[k] = own[3][at[j]]
                        cur = back[at[j]]
            stack.extend((c, here, f) for c, f in zip(reversed(node[3]), reversed(found), strict=True))
        return nodes, parent, fits

    def weigh(self, text: list, slot: list | None) -> float:
        """Mean length of what falls into the slot; nothing where it never changes or is mostly links."""
        blocks, chars, links, same = (slot or text)[4]
        if slot is not None and slot[5] >= AGREE and same is not None:
            return 0.0
        return max(0.0, chars - 2 * links) / blocks

    def texts(self, html: str) -> list[str]:
        """Main texts of a page, block by block."""
        page = tree(html)
        nodes, parent, fits = self.match(page)
        return _main(nodes, parent, [self.weigh(n, f) if n[0] == "#" else 0.0 for n, f in zip(nodes, fits, strict=True)], fits) or self.alone(nodes, parent)

    @staticmethod
    def alone(nodes: list[list], parent: list[int]) -> list[str]:
        """A page by itself."""
        return _main(nodes, parent, [float(max(0, n[4][1] - 2 * n[4][2])) if n[0] == "#" else 0.0 for n in nodes], [None] * len(nodes))


def _tilt(name: str, named: bool, compound: bool, heading: str) -> float:
    """How the kind of an element, a word in its name, a heading in it and repetition of what it holds change its weight."""
    if name in _OUT:
        return 0.0
    return (4.0 if name in ("article", "main") else 1.0) * (0.25 if named else 1.0) * (0.5 if compound else 1.0) * (3.0 if heading == "h1" else 1.5 if heading == "h2" else 1.0)


def _main(nodes: list[list], parent: list[int], weight: list[float], fits: list[list | None]) -> list[str]:
    """Texts of the main element."""
    names = [n[0].partition(".")[0] for n in nodes]
    named = [name not in _TEXTUAL and "." in n[0] and _NAMED.search(n[0].partition(".")[2]) is not None for n, name in zip(nodes, names, strict=True)]
    plain, tilted = list(weight), list(weight)
    heading = [""] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i][0] != "#":
            boxes = [c[0] for c in nodes[i][3] if c[3] and c[0].partition(".")[0] not in _TEXTUAL]
            tilted[i] *= _tilt(names[i], named[i], len(boxes) > 2 and len(set(boxes)) == 1, heading[i])
            if names[i] in _OUT:
                plain[i], heading[i] = 0.0, ""
            if names[i] in _HEADING and plain[i]:
                heading[i] = names[i]
        up = parent[i]
        plain[up] += plain[i]
        tilted[up] += tilted[i]
        if heading[i] and heading[up] != "h1":
            heading[up] = heading[i]
    if not plain[0]:
        return []
    below = defaultdict(list)
    for i in range(1, len(nodes)):
        below[parent[i]].append(i)
    top = 0
    while kids := [i for i in below[top] if tilted[i]]:
        best = max(kids, key=lambda i: tilted[i])
        if names[best] in _TEXTUAL or tilted[best] < NEARLY_ALL * sum(tilted[i] for i in kids):
            break
        if not heading[best] and any(heading[i] for i in kids if not named[i]):
            break
        if all(nodes[i][0] == "#" for i in below[best]):  # a single block: its siblings go with it if they are texts too
            if any(names[i] in _TEXTUAL for i in kids):
                break
        top = best
    out: list[str] = []
    whole = names[top] in ("", "html", "body")
    stack = [top]
    while stack:
        i = stack.pop()
        if nodes[i][0] == "#":
            slot = fits[i]
            blocks, chars, links, same = (slot or nodes[i])[4]
            fixed = slot is not None and same is not None and slot[5] >= SURE and not slot[1] and names[parent[i]][:1] != "h"
            if links * 2 <= chars and not fixed:
                out.append(nodes[i][4][3])
            continue
        if i != top and (names[i] in _OUT or named[i] and plain[i] < 0.5 * plain[top] or whole and names[i] == "header" and not heading[i]):
            continue
        stack.extend(reversed(below[i]))
    return out


@lru_cache(maxsize=256)
def _opened(packed: str) -> Wrapper:
    return Wrapper(*unpack(packed))


def _short(root: list) -> list:
    """Unchanging texts are kept by their hash: a slot needs to know whether they change."""
    for node in _nodes(root):
        if node[4] is not None and node[4][3] is not None and len(node[4][3]) > 64:
            node[4][3] = f"{node[4][3][:40]}|{len(node[4][3])}|{_hash(node[4][3])}"
    return root


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host that a task sees, over all its pages (again from nothing after 2000 hosts)."""
    seen: dict[str, list] = {}

    def out() -> pa.RecordBatch:
        rows = [(h, pack(n, pruned(w))) for h, (n, w) in seen.items()]
        seen.clear()
        return pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["host", "wrapper"])

    for batch in batches:
        for host, html in zip(batch.column("host"), batch.column("html"), strict=True):
            h = host.as_py()
            t = _short(folded(tree(html.as_py())))
            got = seen.get(h)
            n, w = (1, t) if got is None else (got[0] + 1, merge(got[1], t))
            seen[h] = [n, pruned(w) if n & (n - 1) == 0 or n % 256 == 0 else w]
            if len(seen) > 2000:
                yield out()
    if seen:
        yield out()


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    pages, root = 0, None
    for p in sorted(pdf.wrapper):
        n, w = unpack(p)
        pages, root = pages + n, w if root is None else pruned(merge(root, w))
    return pd.DataFrame({"host": [pdf.host.iloc[0]], "wrapper": [pack(pages, root)], "expression": [regex(root)]})


def host_of(url) -> F.Column:
    """Lower-case host of a URL; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, expression): the inferred wrapper of each host, from all its pages."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    part = rows.mapInArrow(_partial, "host string, wrapper string").withColumn("g", F.pmod(F.xxhash64("wrapper"), F.lit(GROUPS)))
    schema = "host string, wrapper string, expression string"
    return part.groupBy("host", "g").applyInPandas(_merged, schema).groupBy("host").applyInPandas(_merged, schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            got = [" ".join(_opened(w.as_py()).texts(h.as_py())) for h, w in zip(batch.column("html"), batch.column("wrapper"), strict=True)]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(got, pa.string()), pa.array(list(map(len, got)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


#: Wrappers of so many hosts and characters are broadcast; beyond that they are joined by shuffle.
BROADCAST_HOSTS, BROADCAST_CHARS = 5000, 16_000_000


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``.

    Null or empty html has an empty text. Pages without a host in their url share one wrapper. Repeated rows are
    extracted each for itself; other columns are ignored; an empty table gives an empty result. Html of any length and depth is read in whole.
    """
    tmp = Scratch(pages.sparkSession, "html")
    with batches_of(pages.sparkSession, BATCH):
        found = tmp.keep(wrappers(pages).select("host", "wrapper"), "wrappers")
    n, size = found.agg(F.count(F.lit(1)), F.sum(F.length("wrapper"))).first()
    small = n <= BROADCAST_HOSTS and (size or 0) <= BROADCAST_CHARS
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    joined = rows.join(F.broadcast(found) if small else found, "host").select("page_id", "url", "html", "wrapper")
    kind = pages.schema["page_id"].dataType.simpleString()
    with batches_of(pages.sparkSession, BATCH):
        return tmp.finish(joined.mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars long"), "texts")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
