"""Main text of web pages by wrapper induction (operator 7).

A page's pattern is the tree of its blocks in which like siblings are one repeated node, as lists and paragraphs
have any number. The patterns of all pages of a host are compared by simple tree matching: two nodes match if their
labels do, and children align in order so that the most nodes match. A pattern that no more frequent leader is like
leads; pages like it share a wrapper: the nodes that half of them have, and texts that half of them repeat.
Then every page of the host is aligned with the wrapper it fits best, and counted: a text that half of all pages
repeat at a node is template, and where texts vary is a slot. The innermost container that holds most of what varies
is the content; it, and not the mark-up's word, is where a page's main text is taken from.

Where nothing can be induced (fewer than three different pages, no container that holds most, a page that lacks it) the article or
main element serves, else the densest block. Within the content, what its markup calls something else is left out: menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, comments.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

#: The least pages of a wrapper; the share of common texts from which a page is a copy.
LEAST, ALIKE = 3, 0.3
#: Likeness of two patterns that share a wrapper, share of a wrapper's nodes that a page of it has, of pages that repeat a template text,
#: and of varying text that the content holds.
SIMILAR, FITS, REPEATED, MOST = 0.4, 0.5, 0.5, 0.6
#: Bytes of wrappers that are broadcast at most; beyond, a join by key with this many salts.
BROADCAST_BYTES, SALTS = 32 << 20, 16
#: Entries that a counting task holds before it passes them on.
HELD = 200_000

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag -> open tags it ends, and the tags that keep them open.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SKIP = set("head title nav footer aside form script style noscript template iframe svg math button select input textarea object embed canvas audio video menu dialog label".split())
#: Words of class, id or role that say that an element isn't the article.
OTHER = set(
    "nav navbar navigation menu sidebar footer header masthead ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus respond replies related recommended recommendations breadcrumb breadcrumbs pagination pager widget toolbar complementary contentinfo search dialog skip copyright disclaimer tags toc".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_WORD = re.compile(r"[a-z]+")


class Node:
    """An element; children are elements and strings."""

    __slots__ = ("tag", "label", "children", "other", "main")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.children = tag, []
        self.label, self.other, self.main = tag, tag in SKIP, tag in ("article", "main")
        if "=" in attrs or "hidden" in attrs:
            found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
            named = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
            if found.get("class"):
                self.label = f"{tag}.{' '.join(sorted(found['class'].split()))}"
            if found.get("role", "").lower() == "main":
                self.main = True
            style = found.get("style", "").replace(" ", "").lower()
            if tag not in ("html", "body") and (OTHER & set(_WORD.findall(named)) or "hidden" in found or "display:none" in style or found.get("aria-hidden", "").lower() == "true"):
                self.other = True


def parse(page: str) -> Node:
    """The tree of a page; end tags that are missing or left over are mended."""
    root = Node("#root")
    stack, at, n = [root], 0, len(page)

    def text(value: str) -> None:
        if value:
            stack[-1].children.append(entities.unescape(value) if "&" in value else value)

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in BLOCKS and stack[k].tag in BLOCKS:
                    break  # an inline end tag ends no block
            continue
        if not m[0].endswith(">"):
            break  # a tag that is cut off
        if tag in BLOCKS and tag not in ("html", "body"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCKS:
                    break
        if tag in ENDS:
            ended, keep = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ended:
                    del stack[k:]
                    if tag != "tr":
                        break
                elif stack[k].tag in keep:
                    break
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


def mark(root: Node) -> None:
    """An element isn't something else if it holds the main element; a header in an article keeps its headings."""
    todo, order = [(root, None)], []
    while todo:
        node, parent = todo.pop()
        order.append((node, parent))
        todo += [(c, node) for c in node.children if isinstance(c, Node)]
    holds: set[int] = set()
    for node, parent in reversed(order):
        if parent is not None and ((node.main and not node.other) or id(node) in holds):
            holds.add(id(parent))
    for node, _ in order:
        if id(node) in holds and node.tag not in SKIP:
            node.other = False


HEADINGS = {"h1", "h2", "h3"}
#: Containers that may be the content; others hold a piece of text.
CONTAINERS = set("article body center dd div dl fieldset figure html main section table tbody td tr".split())


def digest(*parts: str) -> int:
    """A signed 64-bit hash."""
    n = xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "replace"))
    return n - (1 << 64) if n >> 63 else n


def segments(node: Node, inside: bool = False, everything: bool = False) -> list[tuple[Node, str, bool]]:
    """Block, text and whether it is mostly links, of each run of text in page order.

    Without what is something else, unless everything is asked for; headers keep their headings inside of an article.
    """
    out: list[tuple[Node, str, bool]] = []
    buffer: list[str] = []
    linked = 0

    def flush(owner: Node) -> None:
        nonlocal linked
        value = " ".join("".join(buffer).split())
        if value:
            out.append((owner, value, linked * 2 > len(value)))
        buffer.clear()
        linked = 0

    # an explicit stack: pages may be nested deeper than Python's
    todo: list[tuple[Node, Node, int, bool, bool]] = [(node, node, 0, inside, False)]
    while todo:
        now, owner, k, within, link = todo.pop()
        if k == 0 and now is owner:
            flush(owner)
        if k < len(now.children):
            todo.append((now, owner, k + 1, within, link))
            child = now.children[k]
            if isinstance(child, str):
                buffer.append(child)
                if link:
                    linked += len(child)
                continue
            block = child.tag in BLOCKS
            if child.tag in ("br", "hr", "wbr"):
                buffer.append("" if child.tag == "wbr" else " ")
                if child.tag == "hr":
                    flush(owner)
            elif (child.tag in RAW or child.tag == "head") if everything else (child.other or (child.tag == "header" and not within)):
                if block:
                    flush(owner)
                else:
                    buffer.append(" ")
            elif child.tag == "header" and not everything:
                flush(owner)
                todo += [(h, h, 0, within, link) for h in reversed(child.children) if isinstance(h, Node) and h.tag in HEADINGS and not h.other]
            elif child.tag not in VOID:
                if block:
                    flush(owner)
                todo.append((child, child if block else owner, 0, within or child.tag in ("article", "main"), link or child.tag == "a"))
        elif now is owner:
            flush(owner)
    return out


def region(root: Node) -> Node:
    """The element that holds the main text as the markup has it: one pass over the page."""
    order: list[tuple[Node, Node | None]] = []
    todo: list[tuple[Node, Node | None]] = [(root, None)]
    while todo:
        node, parent = todo.pop()
        order.append((node, parent))
        todo += [(c, node) for c in reversed(node.children) if isinstance(c, Node) and not c.other]
    own: dict[int, int] = {}
    for owner, text, link in segments(root):
        if not link:
            own[id(owner)] = own.get(id(owner), 0) + len(text)
    size, near = dict(own), dict(own)
    for node, parent in reversed(order):
        if parent is not None:
            size[id(parent)] = size.get(id(parent), 0) + size.get(id(node), 0)
            if node.tag in BLOCKS:
                near[id(parent)] = near.get(id(parent), 0) + own.get(id(node), 0)
    articles = [n for n, _ in order if n.tag == "article" and size.get(id(n))]
    if articles:
        best = max(articles, key=lambda n: size[id(n)])
        if size[id(best)] * 5 >= 2 * sum(size[id(n)] for n in articles if n is not best):
            return best
    mains = [n for n, _ in order if n.main and n.tag != "article" and size.get(id(n))]
    if mains:
        return max(mains, key=lambda n: size[id(n)])
    dense = [n for n, _ in order if n.tag in ("div", "section", "td", "body") and near.get(id(n))]
    return max(dense, key=lambda n: near[id(n)]) if dense else root


def block_children(node: Node) -> list[Node]:
    """The nearest blocks below an element, in page order."""
    out: list[Node] = []
    todo = list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, Node) and c.tag not in RAW and c.tag != "head":
            if c.tag in BLOCKS:
                out.append(c)
            else:
                todo += reversed(c.children)
    return out


class Pattern:
    """A tree as lists: label, parent and children of each node; a page's also the elements that a node stands for."""

    def __init__(self, labels: list[str], parents: list[int]) -> None:
        self.labels, self.parents = labels, parents
        self.children: list[list[int]] = [[] for _ in labels]
        for k, p in enumerate(parents):
            if p >= 0:
                self.children[p].append(k)
        self.sources: list[list[Node]] = []
        self.of: dict[int, int] = {}


def pattern(root: Node) -> Pattern:
    """Like siblings, which have the same label and the same labels of children, are one node where the first of them stands."""
    labels, parents, sources = [""], [-1], [[root]]
    kids = {id(root): block_children(root)}
    for at, group in enumerate(sources):  # grows
        like: dict[tuple[str, frozenset[str]], list[Node]] = {}
        for s in group:
            for c in kids.pop(id(s)):
                kids[id(c)] = block_children(c)
                like.setdefault((c.label, frozenset(x.label for x in kids[id(c)])), []).append(c)
        labels += [k[0] for k in like]
        parents += [at] * len(like)
        sources += like.values()
    out = Pattern(labels, parents)
    out.sources = sources
    out.of = {id(n): k for k, group in enumerate(sources) for n in group}
    return out


def align(xs: list[int], ys: list[int], weight: dict[tuple[int, int], int]) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest pairs of two lists in order; pairs without weight don't match."""
    xs = [x for x in xs if any((x, y) in weight for y in ys)]
    ys = [y for y in ys if any((x, y) in weight for x in xs)]
    if not xs or not ys:
        return 0, []
    best = [[0] * (len(ys) + 1)]
    for x in xs:
        above, row = best[-1], [0]
        for j, y in enumerate(ys):
            row.append(max(row[j], above[j + 1], above[j] + weight.get((x, y), 0)))
        best.append(row)
    pairs, i, j = [], len(xs), len(ys)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((xs[i], ys[j]))
    return best[-1][-1], pairs


def match(a: Pattern, b: Pattern) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: how many nodes match at most, and which."""
    order = [(0, 0)]
    for i, j in order:  # grows
        if a.children[i] and b.children[j]:
            by: dict[str, list[int]] = {}
            for y in b.children[j]:
                by.setdefault(b.labels[y], []).append(y)
            order += [(x, y) for x in a.children[i] for y in by.get(a.labels[x], ())]
    weight: dict[tuple[int, int], int] = {}
    pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, j in reversed(order):
        total, chosen = align(a.children[i], b.children[j], weight) if a.children[i] and b.children[j] else (0, [])
        weight[i, j] = total + 1
        pairs[i, j] = chosen
    found = [(0, 0)]
    for pair in found:  # grows
        found += pairs[pair]
    return weight[0, 0], found


def texts_of(page: Pattern, root: Node) -> list[set[int]]:
    """Digests of the texts at each node, whatever they are."""
    out: list[set[int]] = [set() for _ in page.labels]
    for owner, text, _ in segments(root, everything=True):
        out[page.of.get(id(owner), 0)].add(digest(text))
    return out


def induce(pages: list[str]) -> list[dict]:
    """Wrappers of pages of a host: labels, parents and repeated texts of the nodes, as many as there are kinds of pages."""
    clusters: list[list[tuple[Pattern, list[set[int]], set[str]]]] = []
    for page in pages:
        root = parse(page)
        mark(root)
        own = {t for _, t, _ in segments(region(root), True)}
        if not own:
            continue
        p = pattern(root)
        likeness = [2 * match(c[0][0], p)[0] / (len(c[0][0].labels) + len(p.labels)) for c in clusters]
        k = max(range(len(clusters)), key=lambda i: likeness[i]) if clusters else -1
        if k < 0 or likeness[k] < SIMILAR:
            clusters.append([(p, texts_of(p, root), own)])
        elif all(len(own & other) <= ALIKE * min(len(own), len(other)) for _, _, other in clusters[k]):
            clusters[k].append((p, texts_of(p, root), own))
    out = []
    for cluster in clusters:
        if len(cluster) < LEAST:
            continue
        first, texts, _ = cluster[0]
        nodes = Counter(range(len(first.labels)))
        said = [Counter(t) for t in texts]
        for p, other, _ in cluster[1:]:
            for i, j in match(first, p)[1]:
                nodes[i] += 1
                said[i].update(other[j])
        kept = [i for i in range(len(first.labels)) if 2 * nodes[i] >= len(cluster)]
        place = {i: k for k, i in enumerate(kept)} | {-1: -1}
        out.append(
            {"labels": [first.labels[i] for i in kept], "parents": [place[first.parents[i]] for i in kept], "texts": [sorted(t for t, n in said[i].items() if n >= max(2, REPEATED * len(cluster))) for i in kept]}
        )
    return out


class Wrapper(Pattern):
    """A wrapper: repeated texts of each node; once pages are counted its template texts and content node."""

    def __init__(self, made: dict) -> None:
        super().__init__(made["labels"], made["parents"])
        self.texts = [frozenset(t) for t in made["texts"]]
        self.content = made.get("content", -1)


@lru_cache(512)
def wrappers_of(made: str) -> list[Wrapper]:
    return [Wrapper(m) for m in json.loads(made)]


def fit(page: Pattern, wrappers: list[Wrapper]) -> tuple[int, dict[int, int]]:
    """The wrapper that fits best, -1 if none does, and for nodes of the page those of the wrapper."""
    best, share, chosen = -1, FITS, {}
    for k, w in enumerate(wrappers):
        n, pairs = match(w, page)
        if n / len(w.labels) >= share and (best < 0 or n / len(w.labels) > share):
            best, share, chosen = k, n / len(w.labels), {j: i for i, j in pairs}
    return best, chosen


def tally(page: str, wrappers: list[Wrapper], into: dict[tuple[int, int, int | None], list[int]]) -> None:
    """Count a page: (wrapper, node, None) -> pages, elements, and characters that vary there or below it in no node; (wrapper, node, text) -> pages."""
    root = parse(page)
    mark(root)
    p = pattern(root)
    k, node_of = fit(p, wrappers)
    if k < 0:
        return
    w = wrappers[k]
    visible = {(id(o), t) for o, t, link in segments(root) if not link}
    repeated: set[tuple[int, int]] = set()
    chars = dict.fromkeys(node_of.values(), 0)
    for owner, text, _ in segments(root, everything=True):
        at, d = p.of.get(id(owner), 0), digest(text)
        if at in node_of and d in w.texts[node_of[at]]:
            repeated.add((node_of[at], d))
            continue
        while at not in node_of:
            at = p.parents[at]
        if (id(owner), text) in visible:
            chars[node_of[at]] += len(text)
    for at, node in node_of.items():
        held = into.setdefault((k, node, None), [0, 0, 0])
        held[0] += 1
        held[1] += len(p.sources[at])
        held[2] += chars[node]
    for node, d in repeated:
        into.setdefault((k, node, d), [0, 0, 0])[0] += 1


def settle(made: list[dict], counts: list[tuple[int, int, int | None, int, int, int]]) -> list[dict]:
    """Wrappers with the texts that are template and the node that is the content (-1: none), from (wrapper, node, text, pages, elements, characters).

    What stands several times on a page is a piece of the content, and an element that holds the content's heading is the content.
    """
    out = []
    for k, m in enumerate(made):
        own = [c[1:] for c in counts if c[0] == k]
        pages = max((n for node, text, n, *_ in own if node == 0 and text is None), default=0)
        texts: list[list[int]] = [[] for _ in m["labels"]]
        size, once = [0] * len(m["labels"]), [False] * len(m["labels"])
        for node, text, n, elements, chars in own:
            if text is None:
                size[node] += chars
                once[node] = 2 * elements <= 3 * n
            elif n >= max(LEAST, REPEATED * pages):
                texts[node].append(text)
        w = Pattern(m["labels"], m["parents"])
        for i in range(len(size) - 1, 0, -1):  # parents stand before their children
            size[w.parents[i]] += size[i]
        at = 0
        while w.labels[at].partition(".")[0] not in ("article", "main"):
            inner = [c for c in w.children[at] if once[c] and w.labels[c].partition(".")[0] in CONTAINERS]
            best = max(inner, key=lambda c: size[c], default=-1)
            if best < 0 or not size[best] or size[best] < MOST * size[at]:
                break
            at = best
        outer = w.parents[at]
        if outer > 0 and any(w.labels[c].partition(".")[0] in HEADINGS for c in w.children[outer]):
            at = outer
        out.append({**m, "texts": texts, "content": -1 if w.labels[at].partition(".")[0] in ("", "html", "body") else at})
    return out


def main_text(page: str, wrappers: list[Wrapper] = ()) -> str:
    """The main text of a page, its blocks on lines of their own."""
    if not page:
        return ""
    root = parse(page)
    mark(root)
    chosen: list[Node] = []
    p, w, node_of = None, None, {}
    if wrappers:
        p = pattern(root)
        k, node_of = fit(p, wrappers)
        w = wrappers[k] if k >= 0 else None
        chosen = [n for j, i in node_of.items() if w and i == w.content for n in p.sources[j]]
    found: list[tuple[Node, str, bool]] = [s for n in chosen for s in segments(n, True) if not s[2] or n.tag in ("article", "main")]
    if not found:
        node = region(root)
        found = [s for s in segments(node, node.tag in ("article", "main")) if not s[2] or node.tag in ("article", "main")]
    if w:
        repeated = lambda owner, text: digest(text) in w.texts[node_of[p.of[id(owner)]]] if p.of.get(id(owner)) in node_of else False
        found = [s for s in found if not repeated(s[0], s[1])]
    return "\n".join(t for _, t, _ in found)


def likest(page: Pattern, leaders: list[Pattern]) -> tuple[int, float, list[tuple[int, int]]]:
    """Number and likeness of the leader that is most like a page (-1: there is none), and the nodes that match."""
    best, share, pairs = -1, 0.0, []
    for k, w in enumerate(leaders):
        n, found = match(w, page)
        if 2 * n / (len(w.labels) + len(page.labels)) > share:
            best, share, pairs = k, 2 * n / (len(w.labels) + len(page.labels)), found
    return best, share, pairs


def led(src: DataFrame) -> DataFrame:
    """host and made, its leaders: of the patterns of all its pages, the most frequent first, those that no leader before is like."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            host, made = zip(*held, strict=True) if held else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(made, pa.string()), pa.array(list(held.values()), pa.int64())], ["host", "made", "n"])

        for batch, values in slices(batches, "html"):
            for v, host in zip(values, batch.column(1).to_pylist(), strict=True):
                p = pattern(parse(v.decode("utf-8", "replace")))
                held[host, json.dumps([p.labels, p.parents])] += 1
            if len(held) > HELD // 20:
                yield out()
                held.clear()
        yield out()

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, own = None, []

        def out() -> pa.RecordBatch:
            made = json.dumps([{"labels": p.labels, "parents": p.parents, "texts": []} for p in own])
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([made], pa.string())], ["host", "made"])

        for batch in batches:
            for host, made in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if host != name:
                    if own:
                        yield out()
                    name, own = host, []
                p = Pattern(*json.loads(made))
                if likest(p, own)[1] < SIMILAR:
                    own.append(p)
        if own:
            yield out()

    made = src.where("html is not null").select("html", "host").mapInArrow(run, "host string, made string, n long")
    ranked = made.groupBy("host", "made").agg(F.sum("n").alias("n")).repartition("host").sortWithinPartitions("host", F.desc("n"), "made")
    return materialize(ranked.select("host", "made").mapInArrow(choose, "host string, made string"), "leaders")


def learn(src: DataFrame) -> DataFrame:
    """host and made, its wrappers as JSON, from all pages (host, url, html): the nodes of a leader that half of the pages like it have, and texts that half repeat.

    Pages with the same main text, as the markup has it, count once.
    """
    leaders = led(src)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[int, list[tuple[int, int]]]] = {}  # pages of one pattern match alike
        for batch, values in slices(batches, "html"):
            rows: set[tuple] = set()
            if len(known) > HELD // 100:
                known.clear()
            for v, host, made in zip(values, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                root = parse(v.decode("utf-8", "replace"))
                mark(root)
                own = {x for _, x, _ in segments(region(root), True)}
                p = pattern(root)
                name = (host, *p.labels, *p.parents)
                if name not in known:
                    known[name] = likest(p, wrappers_of(made))[::2]
                k, pairs = known[name]
                if own and k >= 0:
                    main, texts = digest(*sorted(own)), texts_of(p, root)
                    for i, j in pairs:
                        rows.add((host, k, i, None, main))
                        rows.update((host, k, i, x, main) for x in texts[j])
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, (pa.string(), *[pa.int64()] * 4), strict=True)], ["host", "k", "node", "text", "main"])

    said = with_wrappers(src, leaders).where("made is not null and html is not null").select("html", "host", "made").mapInArrow(run, "host string, k long, node long, text long, main long")
    counts = materialize(said.distinct().groupBy("host", "k", "node", "text").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    pages = counts.where("node = 0 and text is null").select("host", "k", F.col("n").alias("pages"))
    kept = counts.join(pages, ["host", "k"]).where(f"pages >= {LEAST} and n >= pages * {REPEATED}")
    whole = kept.groupBy("host").agg(F.collect_list(F.struct("k", "node", "text")).alias("kept"))  # bounded by the host's wrappers

    def end(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for made, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                every, done = json.loads(made), []
                for k in sorted({c["k"] for c in own}):
                    leader, nodes = every[k], sorted({c["node"] for c in own if c["k"] == k and c["text"] is None})
                    place = {i: n for n, i in enumerate(nodes)} | {-1: -1}
                    texts: list[list[int]] = [[] for _ in nodes]
                    for c in own:
                        if c["k"] == k and c["text"] is not None:
                            texts[place[c["node"]]].append(c["text"])
                    done.append({"labels": [leader["labels"][i] for i in nodes], "parents": [place[leader["parents"][i]] for i in nodes], "texts": [sorted(x) for x in texts]})
                out.append(json.dumps(done))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["host", "made"])

    return materialize(leaders.join(whole, "host").select("host", "made", "kept").mapInArrow(end, "host string, made string"), "wrappers")


def with_wrappers(src: DataFrame, learned: DataFrame) -> DataFrame:
    """src with column made of its host, null if there is none; html moves only if the wrappers pass BROADCAST_BYTES."""
    size = learned.agg(F.sum(F.length("made") + F.length("host"))).first()[0] or 0
    named = learned.withColumnRenamed("host", "h")
    if size <= BROADCAST_BYTES:
        return src.join(F.broadcast(named), F.col("host") == F.col("h"), "left")
    salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return src.withColumn("s", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS))).join(salted, (F.col("host") == F.col("h")) & (F.col("s") == F.col("salt")), "left")


def settled(src: DataFrame, learned: DataFrame) -> DataFrame:
    """learned with template and content, counted over all pages. Counts are added up in each task before they move."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}

        def out() -> pa.RecordBatch:
            rows = [(h, *key, *n) for h, own in held.items() for key, n in own.items()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 6), strict=True)], ["host", "k", "node", "text", "pages", "elements", "chars"])

        for batch, values in slices(batches, "html"):
            for v, host, made in zip(values, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tally(v.decode("utf-8", "replace"), wrappers_of(made), held.setdefault(host, {}))
            if sum(map(len, held.values())) > HELD:
                yield out()
                held.clear()
        yield out()

    pages = with_wrappers(src, learned).where("made is not null and html is not null").select("html", "host", "made")
    counts = pages.mapInArrow(run, "host string, k long, node long, text long, pages long, elements long, chars long")
    counts = counts.groupBy("host", "k", "node", "text").agg(*[F.sum(c).alias(c) for c in ("pages", "elements", "chars")])
    whole = counts.groupBy("host").agg(F.collect_list(F.struct("k", "node", "text", "pages", "elements", "chars")).alias("counts"))  # bounded by the host's wrappers

    def end(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [json.dumps(settle(json.loads(m), [tuple(c.values()) for c in own])) for m, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["host", "made"])

    return materialize(learned.join(whole, "host").select("host", "made", "counts").mapInArrow(end, "host string, made string"), "templates")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per row of pages: id_col, url_col, text, n_chars (code points).

    Null, empty and textless pages: an empty text. Null urls and urls without a host share the host "". Broken markup is
    mended. Repeated rows give repeated rows, and teach once; an empty table gives an empty one; other columns don't matter. Html is
    read, never shuffled, unless the wrappers pass BROADCAST_BYTES. Lone surrogates from character references become "?".
    """
    host = F.coalesce(F.lower(F.regexp_extract(pages[url_col].cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    src = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"), host.alias("host"))
    joined = with_wrappers(src, settled(src, learn(src)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in slices(batches, "html"):
            texts = [main_text(v.decode("utf-8", "replace"), wrappers_of(m) if m else ()) for v, m in zip(values, batch.column(3).to_pylist(), strict=True)]
            texts = [t.encode("utf-8", "replace").decode() for t in texts]  # character references may name lone surrogates
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["id", "url", "text", "n_chars"])

    kind = src.schema["id"].dataType.simpleString()
    out = joined.select("id", "url", "html", "made").mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
