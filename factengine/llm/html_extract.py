"""Main text of web pages by wrapper induction (operator 4).

Every page becomes a DOM tree in which rows of equal neighbours are folded into one repeated node. The pages of a host are aligned
with the host's reference tree by simple tree matching, and for each node the pages that have it and the distinct texts
they show there are aggregated. A node that the reference lacks is aggregated under its path, so every layout of a host
has its statistics. Nodes whose text is the same on the pages, rotates among few texts or is mostly links are the
template; the others are slots. A page's text is that of its slots, less the parts whose roles are never content.

Elements marked as articles are the content only as long as the alignment agrees: if the varying text of the host's
pages lies mostly outside of them, they are treated like any other element.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factengine.llm.common import materialise

# Fixed values of HTML: elements without an end tag, elements whose text is not shown, elements that break a line, end
# tags that may be left out (an element closes the open ones of its set), and roles that are never an article's text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - frozenset("br body html title option td th tr tbody thead tfoot caption li dd dt legend summary".split()) | {"p"}
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
CHROME_TAGS = frozenset("head nav aside footer form button select dialog menu search template".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
CHROME_NAME = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|ad(?:box|slot|unit|banner)|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|side|aside|footer|foot|header|masthead|topbar|toolbar|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|comments?|comment-?list|disqus|discussion|replies|respond|reviews?|pagination|pager|skip-link|widget\w*|copyright)(?:$|[\s_-])")
ARTICLE_NAME = re.compile(r"(?i)(?:^|[\s_-])(?:article(?:-?body)?|post(?:-?(?:body|content))?|entry(?:-?content)?|main(?:-?content)?|story(?:-?body)?|content)(?:$|[\s_-])")

#: The head of an article, which is no page header, and where a name in camel case is parted.
ARTICLE_HEAD = re.compile(r"(?i)(?:^|[\s_-])(?:article|post|entry|story|content)[_-]?(?:header|head|title)(?:$|[\s_-])")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

TOKEN = re.compile(r"<!--(.*?)(?:-->|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)"
SPACE = re.compile(r"\s+")


class Node:
    """An element: its signature for matching, its role, and its children, elements and texts in order; once measured, the
    block elements right below it, and where its text and the linked part of its text begin and end."""

    __slots__ = ("chrome", "items", "kids", "linked", "name", "signature", "span")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.items, self.kids, self.span, self.linked = name, [], [], (0, 0), 0
        named = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        kind = " ".join(filter(None, (named.get("class"), named.get("id"))))
        self.signature = f"{name}.{kind}" if kind else name
        role = named.get("role", "").lower()
        hidden = re.search(r"(?:^|\s)hidden(?:\s|$|=)", attributes) is not None or "display:none" in named.get("style", "").replace(" ", "") or named.get("aria-hidden") == "true"
        named_chrome = bool(kind) and name not in ("html", "body", "article", "main") and CHROME_NAME.search(parted := CAMEL.sub("-", kind)) is not None and ARTICLE_HEAD.search(parted) is None
        self.chrome = name in CHROME_TAGS or name == "header" or role in CHROME_ROLES or hidden or named_chrome


def parse(page: str) -> Node:
    """A forgiving DOM: unknown end tags are ignored, open elements end with their parents."""
    root = Node("#document")
    stack, at, size = [root], 0, len(page)

    def close(names: frozenset | set, stop: frozenset | set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                del stack[i:]
                return
            if stack[i].name in stop:
                return

    while at < size:
        found = TOKEN.search(page, at)
        if found is None:
            stack[-1].items.append(page[at:])
            break
        if found.start() > at:
            stack[-1].items.append(page[at : found.start()])
        at = found.end()
        # the second form of a tag has a quote that never ends
        ends, name, attributes = (found[2], found[3], found[4]) if found[3] else (found[5], found[6], found[7])
        if name is None:
            continue
        name = name.lower()
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
            continue
        if name in CLOSES_P:
            close({"p"}, {"article", "body", "div", "section", "td", "th", "li", "main", "button", "object", "table"})
        if name in IMPLIED:
            close(IMPLIED[name], {"ul", "ol", "dl", "table", "select", "tr"} - IMPLIED[name])
        node = Node(name, attributes)
        stack[-1].items.append(node)
        if name in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else (size if name in ("script", "style") else at)
        elif name not in VOID and not attributes.endswith("/"):
            stack.append(node)
    return root


def blocks(node: Node, skip) -> list[str]:
    """Texts of the blocks in page order; ``skip(node)`` leaves out a node and all below it."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", html.unescape("".join(run))).strip()
        if text:
            out.append(text)
        run.clear()

    todo: list = [node]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
        elif item.name in RAW or skip(item):
            if item.name in BLOCK:
                flush()
        elif item.name in BLOCK:
            flush()
            todo.append(None)
            todo += reversed(item.items)
        else:
            todo += reversed(item.items)
    flush()
    return out


# --- wrapper induction -------------------------------------------------------------------------------------------------

#: Pages that must agree before a constant node is template, the share of distinct texts below which a slot counts as
#: rotating template, and the share of link text that makes a slot a menu.
SUPPORT, ROTATING, LINKS = 3, 0.1, 0.5
#: Bytes of a wrapper table up to which it is broadcast, and shapes and alignments that a worker remembers.
BROADCAST_BYTES, REMEMBERED = 32 << 20, 100_000
#: Elements that stand in rows; others are folded only if they have a class or id, since a bare div may be anything.
REPEATED = frozenset("p li tr td th dt dd option br hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def measure(root: Node) -> str:
    """The raw text of a page, outside elements whose text is not shown; sets every element's span, number of linked
    characters and block elements, which inline elements don't hide."""
    parts: list[str] = []
    at = linked = 0
    todo: list = [(root, root, False, False)]
    while todo:
        item, block, link, done = todo.pop()
        if item.__class__ is str:
            parts.append(item)
            at += len(item)
            linked += len(item) * link
        elif done:
            item.span, item.linked = (item.span[0], at), linked - item.linked
        elif item.name not in RAW:
            item.span, item.linked = (at, at), linked
            if item is not root and item.name in BLOCK:
                block.kids.append(item)
                block = item
            link = link or item.name == "a"
            todo.append((item, block, link, True))
            todo += [(x, block, link, False) for x in reversed(item.items)]
    return "".join(parts)


class Fold:
    """A tree node after rows of neighbours with one signature are folded; ``doms`` are the elements it stands for, ``path``
    tells it from all other nodes of a page, and ``held`` whether it is or lies below a content root."""

    __slots__ = ("children", "doms", "held", "path", "shape")

    def __init__(self, doms: list[Node], path: int = 0, held: bool = False):
        self.doms, self.path, self.held, self.shape = doms, path, held, 0
        self.children: list[Fold] = []

    def text(self, page: str) -> str:
        return "".join(page[slice(*d.span)] for d in self.doms)


def folded(root: Node, own: frozenset | set = frozenset(), paths: bool = False) -> list[Fold]:
    """The folds of a measured page in preorder; ``own`` has the ids of the content roots."""
    out: list[Fold] = []
    todo = [Fold([root], 0, id(root) in own)]
    while todo:
        fold = todo.pop()
        out.append(fold)
        groups: list[list[Node]] = []
        for child in (x for d in fold.doms for x in d.kids):
            if groups and groups[-1][0].signature == child.signature and (child.name in REPEATED or "." in child.signature):
                groups[-1].append(child)
            else:
                groups.append([child])
        seen: dict[str, int] = {}
        for group in groups:
            name, path = group[0].signature, 0
            if paths:
                seen[name] = seen.get(name, 0) + 1
                path = hash64(f"{fold.path}/{name}#{seen[name]}")
            fold.children.append(Fold(group, path, fold.held or any(id(d) in own for d in group)))
        todo += reversed(fold.children)
    return out


class Aligner:
    """Simple tree matching of page trees with reference trees.

    Shapes are numbered, so that equal subtrees are matched once; numbers, matches and alignments are remembered until
    there are too many, which changes no result. Lists of children are matched by dynamic programming, a row at a time,
    whatever their length; only every so manieth row is kept, and rows between are made again on the way back.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: dict[tuple, int] = {}
        self.shapes: list[tuple[str, tuple[int, ...]]] = []
        self.sizes: list[int] = []
        self.matches: dict[tuple[int, int], tuple[int, tuple]] = {}
        self.references: dict[str, int] = {}
        self.done: dict[tuple[int, int], list[int]] = {}

    def _numbered(self, name: str, children: tuple[int, ...]) -> int:
        key = (name, children)
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.shapes)
            self.shapes.append(key)
            self.sizes.append(1 + sum(self.sizes[c] for c in children))
        return found

    def shape(self, folds: list[Fold]) -> int:
        """The number of a tree's shape, from its folds in preorder."""
        for fold in reversed(folds):
            fold.shape = self._numbered(fold.doms[0].signature, tuple(c.shape for c in fold.children))
        return folds[0].shape

    def reference(self, text: str) -> int:
        """The number of a shape given as JSON, ``[signature, children]`` in preorder."""
        if text not in self.references:
            done: list[int] = []
            for name, n in reversed(json.loads(text)):
                below = tuple(done.pop() for _ in range(n))
                done.append(self._numbered(name, below))
            self.references[text] = done[0]
        return self.references[text]

    def match(self, a: int, b: int) -> int:
        """The most nodes that two shapes with equal roots can share in order and level."""
        todo = [(a, b)]
        while todo:
            pair = todo[-1]
            if pair in self.matches:
                todo.pop()
                continue
            left, right = self.shapes[pair[0]][1], self.shapes[pair[1]][1]
            if pair[0] == pair[1]:
                self.matches[pair] = (self.sizes[pair[0]], tuple((i, i) for i in range(len(left))))
                continue
            by_name: dict[str, set[int]] = {}
            for y in right:
                by_name.setdefault(self.shapes[y][0], set()).add(y)
            need = [(x, y) for x in set(left) for y in by_name.get(self.shapes[x][0], ()) if (x, y) not in self.matches]
            if need:
                todo += need
                continue
            self.matches[pair] = self._children(left, right, by_name)
        return self.matches[a, b][0]

    def _children(self, left: tuple, right: tuple, by_name: dict[str, set[int]]) -> tuple[int, tuple]:
        """The weight of two nodes whose lists of children are matched in order, and the pairs of places."""
        first, n, m = 0, len(left), len(right)
        # equal children at either end can always be paired
        while first < min(n, m) and left[first] == right[first]:
            first += 1
        while n > first and m > first and left[n - 1] == right[m - 1]:
            n, m = n - 1, m - 1
        pairs = [(i, i) for i in range(first)] + [(n + i, m + i) for i in range(len(left) - n)]
        own, other = left[first:n], right[first:m]
        if own and other:
            kinds = sorted(set(other))
            at = np.searchsorted(kinds, other)
            weights = {x: np.array([self.matches[x, y][0] if y in by_name.get(self.shapes[x][0], ()) else 0 for y in kinds], dtype=np.int64)[at] for x in set(own)}

            def further(row: np.ndarray, i: int) -> np.ndarray:
                out = row.copy()
                np.maximum(out[1:], row[:-1] + weights[own[i]], out=out[1:])
                return np.maximum.accumulate(out)

            step, row = max(1, math.isqrt(len(own))), np.zeros(len(other) + 1, dtype=np.int64)
            saved = [row]
            for i in range(len(own)):
                row = further(row, i)
                if (i + 1) % step == 0:
                    saved.append(row)
            i, j = len(own), len(other)
            while i and j:
                base = (i - 1) // step * step
                rows = [saved[base // step]]
                for k in range(base, i):
                    rows.append(further(rows[-1], k))
                while i > base and j:
                    now, before = rows[i - base], rows[i - 1 - base]
                    if now[j] == before[j]:
                        i -= 1
                    elif now[j] == now[j - 1]:
                        j -= 1
                    else:
                        i, j = i - 1, j - 1
                        pairs.append((first + i, first + j))
        pairs.sort()
        return 1 + sum(self.matches[left[i], right[j]][0] if left[i] != right[j] else self.sizes[left[i]] for i, j in pairs), tuple(pairs)

    def align(self, page: int, reference: int) -> list[int]:
        """Per node of the page's shape in preorder, the preorder number of the reference node it is matched with, or -1."""
        key = (page, reference)
        if key in self.done:
            return self.done[key]
        out: list[int] = []
        todo: list[tuple[int, int, int]] = [(page, reference, 0)]
        while todo:
            a, b, at = todo.pop()
            out.append(at)
            partner: dict[int, tuple[int, int]] = {}
            if at >= 0 and self.shapes[a][1] and self.shapes[b][1]:
                self.match(a, b)
                starts, n = [], at + 1
                for child in self.shapes[b][1]:
                    starts.append(n)
                    n += self.sizes[child]
                partner = {i: (self.shapes[b][1][j], starts[j]) for i, j in self.matches[a, b][1]}
            below = [(child, *partner.get(i, (0, -1))) for i, child in enumerate(self.shapes[a][1])]
            todo += reversed(below)
        self.done[key] = out
        return out

    def keys(self, folds: list[Fold], reference: str) -> list[int]:
        """Per fold the number of its reference node, or the hash of its path where the reference has no such node."""
        if len(self.shapes) + len(self.matches) + sum(map(len, self.done.values())) > REMEMBERED * 10:
            self.clear()
        found = self.align(self.shape(folds), self.reference(reference))
        return [at if at >= 0 else f.path for at, f in zip(found, folds, strict=True)]


def is_article(node: Node) -> bool:
    return node.name in ("article", "main") or bool("." in node.signature and not node.chrome and ARTICLE_NAME.search(node.signature.split(".", 1)[1]))


def content_roots(document: Node) -> list[Node]:
    """The outermost articles outside all chrome; else main elements, else elements named as content, else the document."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "named": []}
    todo = [(document, frozenset())]
    while todo:
        node, held = todo.pop()
        kind = node.name if node.name in ("article", "main") else "named" if is_article(node) else None
        if node.chrome and not kind:
            continue
        if kind and kind not in held:
            found[kind].append(node)
            held = held | {kind}
        todo += [(x, held) for x in reversed(node.items) if x.__class__ is Node and x.name not in RAW]
    return next((v for v in found.values() if v), [document])


def restored(folds: list[Fold], skipped: set[int]) -> set[int]:
    """The folds, by id, of constant headings between parts of the content, which belong to it."""
    out: set[int] = set()
    for fold in folds:
        content = [not (id(c) in skipped or any(d.chrome for d in c.doms)) and any(d.span[1] > d.span[0] for d in c.doms) for c in fold.children]
        for i, child in enumerate(fold.children):
            if id(child) in skipped and child.doms[0].name in HEADINGS and any(content[:i]) and i + 1 < len(content) and content[i + 1]:
                out.add(id(child))
    return out


def extract(page: str, reference: str | None = None, dropped: frozenset = frozenset(), trusted: bool = True, aligner: Aligner | None = None) -> str:
    """The main text of a page; ``dropped`` are the keys of the host's template nodes (see :class:`Aligner`), ``trusted``
    whether its marked articles are its content. If nothing would be left, the template nodes stay."""
    document = parse(page)
    whole = measure(document)
    roots = content_roots(document) if trusted else [document]
    own = {id(r) for r in roots if r is not document}
    skip: set[int] = set()
    if reference is not None and dropped:
        aligner = aligner or Aligner()
        folds = folded(document, own, True)
        out = {id(f) for f, key in zip(folds, aligner.keys(folds, reference), strict=True) if key in dropped and not f.held}
        out -= restored(folds, out)
        skip.update(id(d) for f in folds if id(f) in out for d in f.doms)
    if roots == [document]:
        # without an article, blocks that are mostly links are menus
        for fold in folded(document):
            if fold.doms[0].name in ("div", "ul", "ol", "section", "table"):
                if (linked := sum(d.linked for d in fold.doms)) and linked > LINKS * max(1, len(fold.text(whole).strip())):
                    skip.update(id(d) for d in fold.doms)

    def left_out(node: Node) -> bool:
        if node is document or id(node) in own:
            return False
        return id(node) in skip or node.chrome and not (node.name == "header" and roots != [document] and ("." not in node.signature or ARTICLE_HEAD.search(CAMEL.sub("-", node.signature.split(".", 1)[1]))))

    text = "\n".join(b for r in roots for b in blocks(r, left_out))
    return text if text or not skip or reference is None else extract(page, trusted=trusted)


def shape_text(page: str) -> str:
    """The folded tree of a page as JSON, ``[signature, number of children]`` in preorder."""
    root = parse(page)
    measure(root)
    return json.dumps([[f.doms[0].signature, len(f.children)] for f in folded(root)])


def observed(page: str, shape: str, aligner: Aligner) -> Iterator[tuple[int, int, int, int, int, bool]]:
    """``(node, text hash, characters, linked characters, own characters, inside)`` of the nodes of a page that may be
    template; ``inside`` rows sum up the content roots, own characters are those outside further nodes."""
    root = parse(page)
    whole = measure(root)
    own = {id(r) for r in content_roots(root) if r is not root}
    folds = folded(root, own, True)
    keys = aligner.keys(folds, shape)
    chrome: set[int] = set()
    known: dict[tuple, int] = {}
    held = sum(d.span[1] - d.span[0] for f in folds for d in f.doms if id(d) in own)
    if held:
        yield -1, 0, held, 0, 0, True
    for fold, key in zip(folds, keys, strict=True):
        if id(fold) in chrome or any(d.chrome for d in fold.doms) and not fold.held:
            chrome.update(id(c) for c in fold.children)
            continue
        if fold is folds[0] or fold.held or any(is_article(d) or d.name in ("html", "body") for d in fold.doms):
            continue
        spans = tuple(d.span for d in fold.doms)
        chars = sum(b - a for a, b in spans)
        if spans not in known:
            text = fold.text(whole).strip()
            known[spans] = hash64(text) if text else 0
        if known[spans]:
            inner = sum(d.span[1] - d.span[0] for c in fold.children for d in c.doms)
            yield key, known[spans], chars, sum(d.linked for d in fold.doms), chars - inner, False


def host_of(url: Column) -> Column:
    """A URL's host in lower case; null and other texts share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def _by_host(pages: DataFrame, table: DataFrame) -> DataFrame:
    """``pages`` with their host's row of a written table: by broadcast up to so many bytes, else by a join that splits hot
    hosts."""
    size = sum((F.coalesce(F.octet_length(c) if kind == "string" else F.lit(8) * F.size(c), F.lit(0)) for c, kind in table.dtypes if kind in ("string", "array<bigint>")), F.lit(64))
    total = table.agg(F.sum(size)).first()[0] or 0
    return pages.join(F.broadcast(table) if total <= BROADCAST_BYTES else table, "host", "left")


def induce(pages: DataFrame) -> DataFrame:
    """``(host, shape, dropped, trusted)``: per host of ``pages(host, html)`` the reference tree, the keys of the nodes to
    leave out and whether marked articles hold most of the text that varies.

    The reference is the page of least hash. Every page is aligned with it. Pages with equal HTML count once.
    """
    reference = pages.where("html <> ''").groupBy("host").agg(F.min_by("html", F.xxhash64("html")).alias("html"))

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shape_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.string())], ["host", "shape"])

    reference = materialise(reference.mapInArrow(shapes, "host string, shape string"), "references")
    names = ["host", "page", "node", "text", "chars", "linked", "own", "inside"]

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner()
        for batch in batches:
            rows: list[tuple] = []
            for host, page, shape in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "shape")), strict=True):
                if page and shape is not None:
                    mark = hash64(page)
                    rows += [(host, mark, *x) for x in observed(page, shape, aligner)]
            kinds = [pa.string(), *[pa.int64()] * 6, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names)

    seen = _by_host(pages, reference).mapInArrow(observe, "host string, page long, node long, text long, chars long, linked long, own long, inside boolean")
    sums = ("chars", "linked", "own")
    once = seen.groupBy("host", "inside", "node", "text", "page").agg(*(F.max(c).alias(c) for c in sums))
    texts = once.groupBy("host", "inside", "node", "text").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sums))
    nodes = texts.groupBy("host", "inside", "node").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), *(F.sum(c).alias(c) for c in sums))
    constant = (F.col("n") >= SUPPORT) & (F.col("kinds") == 1)
    rotating = (F.col("n") >= SUPPORT / ROTATING) & (F.col("kinds") <= ROTATING * F.col("n"))
    menu = (F.col("n") >= SUPPORT) & (F.col("linked") > LINKS * F.col("chars"))
    nodes = nodes.withColumn("template", ~F.col("inside") & (constant | rotating | menu))
    inside, outside = F.sum(F.when(F.col("inside"), F.col("chars"))), F.sum(F.when(~F.col("inside") & ~F.col("template") & (F.col("n") >= SUPPORT), F.col("own")))
    # only what some pages show in turn speaks against marked articles
    trusted = F.coalesce(inside, F.lit(0)) >= F.coalesce(outside, F.lit(0))
    # a set of the nodes of a host's layouts, not of its pages
    dropped = nodes.groupBy("host").agg(F.collect_set(F.when(F.col("template"), F.col("node"))).alias("dropped"), trusted.alias("trusted"))
    return materialise(reference.join(dropped, "host", "left"), "wrappers")


def hash64(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main text of every row of ``pages``.

    Two passes over the pages: one aligns them with their hosts' references and aggregates what each node shows, the
    other extracts. Null and empty HTML gives an empty text; pages without a host share one wrapper. Pages of any length
    and depth are parsed, aligned and extracted whole. Copies of a page count once in a wrapper. An article and what is in
    it are never template, however often they recur, nor is a heading between two parts of the content. Repeated rows get
    equal texts. Extra columns are ignored; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    wrappers = induce(rows.select("host", "html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sets = Aligner(), {}
        for batch in batches:
            texts = []
            for host, page, shape, dropped, trusted in zip(*(batch.column(c) for c in ("host", "html", "shape", "dropped", "trusted")), strict=True):
                host, trusted = host.as_py(), trusted.as_py() is not False
                if host not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[host] = frozenset(dropped.as_py() or ())
                texts.append(extract(page.as_py(), shape.as_py(), sets[host], trusted, known))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return _by_host(rows, wrappers).mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
