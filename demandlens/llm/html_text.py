"""Main text of web pages by wrapper induction: trees of pages of one host are aligned; constant nodes are template, varying slots content."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import written

#: Share of a host's aligned pages in which a slot has the reference page's text for it to be template, least pages to tell by, pages of a host that others are aligned with.
CONSTANT, LEAST_PAGES, REFERENCES = 0.9, 5, 3
#: Characters of a text outside articles and prose for which one more page with it is asked where a host has few.
LONGER = 40
#: Share of a main element's varying text that its articles must hold to stand for it, and of a page's that both must hold to stand for the page.
ARTICLE_SHARE, MAIN_SHARE = 0.5, 0.25
#: Cells up to which a table is made in plain Python, which is faster for short lists; longer ones are made in rows by numpy, to the same end.
SMALL = 600
#: Bytes of reference pages and of templates that are broadcast; larger ones are joined.
BROADCAST_BYTES = 64_000_000

DIGITS = re.compile(r"\d+")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^<]++|<", re.S)
LABEL = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
#: Elements whose text is never content.
DROPPED = frozenset("head nav footer aside form button select option datalist dialog menu svg math canvas audio video object template fieldset".split())
#: Elements that start a block; all others are part of the text around them.
BLOCKS = frozenset(
    "html body head address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav object ol option p pre search section select summary svg math canvas audio video template datalist table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
CLOSES_P = BLOCKS - {"html", "body", "head", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"})}
#: Words of class names, ids and roles that mark what is not the article.
MARK = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alerts?|newsletter\w*|subscri\w*|signup|popup\w*|modal\w*|overlay|comments?|commentlist|respond|replies|disqus|discussion|sidebar\w*|widgets?|related|recommend\w*|shar(?:e|ing)|social\w*|breadcrumbs?|menus?|nav|navbar\w*|navigation|footer|masthead|copyright|login|toolbar|pagination|pager|skip\w*|contentinfo|complementary|dialog|hidden|sr|visually",
    re.I,
)
#: Words that say where or what shape a box is, so that a name of these and a mark is still a mark.
BOXES = frozenset(
    "a all also and area article articles bar block body bottom box boxes btn button buttons card cards center col column container content entry feed form global group header heading holder icons image info inline inner item items left links list main message middle module more news only outer page pages panel post posts primary read reading region right row secondary section site slot small sticky stories story strip tab text the title to top topics unit up view wrap wrapper you".split()
)
#: Those of them that also name what holds an article, so that a name of these and a mark may lie.
HOLDERS = frozenset("article articles body content entry feed main message news page pages post posts primary read reading section stories story text topics unit".split())
#: Names that tell of the page's layout, such as has-sidebar, and mark nothing themselves.
LAYOUT = re.compile(r"(?:no|has|have|with|without)[_-]", re.I)
PARTS = re.compile(r"[_\W]+|(?<=[a-z])(?=[A-Z])")


def mark_of(names: str, article: bool = False) -> str:
    """How a class, id or role marks its element: "!" and a name surely, "?" and a name likely, a name that may, or "" not at all.

    A name marks surely if it has a mark and otherwise only words for boxes, as in comments-list; likely if one of these is also what an
    article is held by, as in alert-story; beside other words, as in share-price-report, it may. An article is marked only by a name that
    is a mark alone.
    """
    found = ""
    for name in names.split():
        if LAYOUT.match(name):
            continue
        parts = [x for x in PARTS.split(name) if x]
        marks = [x for x in parts if MARK.fullmatch(x)]
        if not marks or article and len(parts) > 1:
            continue
        name, rest = name.lower(), [x.lower() for x in parts if x not in marks]
        if all(x in BOXES or x[0].isdigit() for x in rest):
            found = surer(found, ("?" if HOLDERS.intersection(rest) else "!") + name)
        else:
            found = found or name
    return found


def surer(a: str, b: str) -> str:
    """The surer of two marks, of equally sure ones the first."""
    return max((a, b), key=lambda m: 3 if m.startswith("!") else 2 if m.startswith("?") else bool(m))


class Node:
    """A block element, or a run of text in one that has other blocks too (label #text)."""

    __slots__ = ("label", "tag", "off", "mark", "main", "children", "text", "shape")

    def __init__(self, tag: str, label: str, off: bool, mark: str, main: int):
        self.tag, self.label, self.off, self.mark, self.main = tag, label, off, mark, main
        self.children: list[Node] = []
        self.text, self.shape = "", -1


def parse(page: str | None) -> Node:
    """The tree of block elements of a page. Inline elements belong to the text around them; white space is one space.

    off: inside something that is never content. mark: the surest of the marks of what it is in, of equally sure ones the outermost.
    main: 2 inside an article, 1 inside a main element, else 0. Digits in labels count alike, so that numbered ids do not part pages.
    """
    root = Node("root", "root", False, "", 0)
    stack, texts = [root], []
    page = page or ""

    def flush():
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            texts.clear()
            if text:
                top = stack[-1]
                leaf = Node("#text", "#text", top.off, top.mark, top.main)
                leaf.text = text
                top.children.append(leaf)

    def close(k: int):
        flush()
        del stack[k:]

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            piece = m.group(0)
            if not piece.startswith(("<!", "<?")):
                texts.append(piece)
            continue
        tag = tag.lower()
        if m.group(1):
            if tag in BLOCKS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
            continue
        if tag in RAW and not m.group(3).endswith("/"):
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            texts.append(" " if tag in ("iframe", "noscript") else "")
            continue
        if tag in VOID:
            if tag == "br":
                texts.append("\n")
            elif tag == "hr":
                flush()
            continue
        if tag not in BLOCKS:
            continue
        flush()
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in ("button", "td", "th", "li", "table", "blockquote", "article", "section", "div", "body"):
                    break
        if tag in CLOSED_BY:
            ends, bounds = CLOSED_BY[tag]
            lowest = None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    lowest = k
                elif stack[k].tag in bounds:
                    break
            if lowest is not None:
                close(lowest)
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        top, label, mark, hidden, role = stack[-1], tag, "", False, ""
        if m.group(3):
            for name, a, b, c in LABEL.findall(m.group(3)):
                name, value = name.lower(), a or b or c
                if name in ("class", "id", "role"):
                    label += f".{DIGITS.sub('0', value.strip().lower())}"
                    if tag not in ("html", "body", "main"):
                        mark = surer(mark, mark_of(value, tag == "article"))
                    role = value.strip().lower() if name == "role" else role
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    hidden = True
        main = 2 if tag == "article" else max(top.main, 1 if tag == "main" or role == "main" else 0)
        # a header counts as the site's unless it stands inside the article
        off = top.off or hidden or tag in DROPPED or tag == "header" and not top.main or role in ("navigation", "banner", "search", "form", "alert")
        node = Node(tag, label, off, surer(top.mark, mark), main)
        top.children.append(node)
        if not m.group(3).endswith("/") or tag not in ("svg", "math", "object"):
            stack.append(node)
    flush()
    return _simple(root)


def _simple(node: Node) -> Node:
    """A block whose only child is text takes the text itself; blocks without any text go."""
    stack = [(node, False)]
    while stack:
        n, done = stack.pop()
        if not done:
            stack.append((n, True))
            stack.extend((c, False) for c in n.children)
            continue
        n.children = [c for c in n.children if c.text or c.children]
        if len(n.children) == 1 and n.children[0].tag == "#text" and n.tag != "root":
            n.text, n.children = n.children[0].text, []
    return node


def leaves(tree: Node) -> list[Node]:
    """Nodes with text in page order."""
    out, stack = [], [tree]
    while stack:
        n = stack.pop()
        if n.text:
            out.append(n)
        stack.extend(reversed(n.children))
    return out


class Shapes:
    """Numbers for trees of labels, so that equal trees are met once. below: a table whose numbers go on to hold."""

    def __init__(self, below: Shapes | None = None):
        self.below, self.at = below, {}
        self.label: list[str] = below.label.copy() if below else []
        self.kids: list[tuple[int, ...]] = below.kids.copy() if below else []
        self.size: list[int] = below.size.copy() if below else []

    def name(self, tree: Node) -> None:
        """Sets the shape of every node of a tree."""
        stack = [(tree, False)]
        while stack:
            n, done = stack.pop()
            if not done:
                stack.append((n, True))
                stack.extend((c, False) for c in n.children)
                continue
            key = (n.label, tuple(c.shape for c in n.children))
            shape = self.below.at.get(key) if self.below else None
            if shape is None:
                shape = self.at.get(key)
            if shape is None:
                shape = self.at[key] = len(self.label)
                self.label.append(key[0])
                self.kids.append(key[1])
                self.size.append(1 + sum(self.size[k] for k in key[1]))
            n.shape = shape


class Matcher:
    """Simple tree matching: roots match if their labels do, and children match in order so that most nodes do.

    What two trees can match depends on their shapes alone, so each pair of shapes is weighed once. Equal children at either end of two
    lists are matched with each other, which loses nothing, since no child can match more than all of its own nodes. What is left takes
    a table of one row per child; only every so many rows are kept, and the rows between are made again on the way back.
    """

    def __init__(self, shapes: Shapes):
        self.shapes, self.known = shapes, {}

    @staticmethod
    def ends(xs: list[int] | tuple[int, ...], ys: list[int] | tuple[int, ...]) -> tuple[int, int]:
        """How many equal shapes two lists start and end with."""
        most, head, tail = min(len(xs), len(ys)), 0, 0
        while head < most and xs[head] == ys[head]:
            head += 1
        while tail < most - head and xs[-1 - tail] == ys[-1 - tail]:
            tail += 1
        return head, tail

    def _open(self, xs, ys) -> list[tuple[int, int]]:
        """Pairs of shapes in two lists that have to be weighed first."""
        label, kids, by = self.shapes.label, self.shapes.kids, {}
        for y in set(ys):
            if kids[y]:
                by.setdefault(label[y], []).append(y)
        return [(x, y) for x in set(xs) if kids[x] for y in by.get(label[x], ()) if x != y and (x, y) not in self.known]

    def weight(self, x: int, y: int) -> int:
        """Nodes that two shapes can match; all pairs of their children's shapes are known."""
        if self.shapes.label[x] != self.shapes.label[y]:
            return 0
        if x == y:
            return self.shapes.size[x]
        return self.known[x, y] if self.shapes.kids[x] and self.shapes.kids[y] else 1

    def weigh(self, pairs: list[tuple[int, int]]) -> None:
        """Weighs pairs of shapes, those below them first."""
        kids, size, todo = self.shapes.kids, self.shapes.size, list(pairs)
        while todo:
            x, y = todo[-1]
            if (x, y) in self.known:
                todo.pop()
                continue
            xs, ys = kids[x], kids[y]
            head, tail = self.ends(xs, ys)
            inner, other = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
            if more := self._open(inner, other):
                todo.extend(more)
                continue
            self.known[x, y] = 1 + sum(size[k] for k in xs[:head]) + sum(size[k] for k in xs[len(xs) - tail :]) + (int(self._last(inner, other)[-1]) if inner and other else 0)
            todo.pop()

    def _steps(self, xs, ys):
        """For a child shape the places in ys that it can match and what each would add."""
        label, by, made = self.shapes.label, {}, {}
        for j, y in enumerate(ys):
            by.setdefault(label[y], []).append(j)

        def step(x: int) -> tuple[np.ndarray, np.ndarray]:
            if x not in made:
                places = by.get(label[x], [])
                made[x] = np.array(places, np.int64), np.array([self.weight(x, ys[j]) for j in places], np.int64)
            return made[x]

        return step

    @staticmethod
    def _next(row: np.ndarray, places: np.ndarray, adds: np.ndarray) -> np.ndarray:
        out = row.copy()
        out[places + 1] = np.maximum(out[places + 1], row[places] + adds)
        return np.maximum.accumulate(out, out=out)

    def _small_rows(self, xs, ys) -> list[list[int]]:
        label, rows = self.shapes.label, [[0] * (len(ys) + 1)]
        for x in xs:
            above, now, left = rows[-1], [0], 0
            for j, y in enumerate(ys):
                w = above[j] + self.weight(x, y) if label[x] == label[y] else 0
                left = max(left, above[j + 1], w)
                now.append(left)
            rows.append(now)
        return rows

    def _small_pairs(self, xs, ys) -> list[tuple[int, int]]:
        rows, i, j, out = self._small_rows(xs, ys), len(xs), len(ys), []
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out

    def _last(self, xs, ys) -> np.ndarray | list[int]:
        if len(xs) * len(ys) <= SMALL:
            return self._small_rows(xs, ys)[-1]
        step, row = self._steps(xs, ys), np.zeros(len(ys) + 1, np.int64)
        for x in xs:
            row = self._next(row, *step(x))
        return row

    def pairs(self, xs, ys) -> list[tuple[int, int]]:
        """Places in two lists of shapes that match."""
        head, tail = self.ends(xs, ys)
        out = [(k, k) for k in range(head)] + [(len(xs) - 1 - k, len(ys) - 1 - k) for k in range(tail)]
        xs, ys = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
        if not xs or not ys:
            return out
        self.weigh(self._open(xs, ys))
        if len(xs) * len(ys) <= SMALL:
            return out + [(head + i, head + j) for i, j in self._small_pairs(xs, ys)]
        step, every = self._steps(xs, ys), int(len(xs) ** 0.5) + 1
        row, kept = np.zeros(len(ys) + 1, np.int64), []
        for i, x in enumerate(xs):
            if i % every == 0:
                kept.append(row)
            row = self._next(row, *step(x))
        j = len(ys)
        for start in range(len(kept) - 1, -1, -1):
            rows = [kept[start]]
            for x in xs[start * every : (start + 1) * every]:
                rows.append(self._next(rows[-1], *step(x)))
            i = len(rows) - 1
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((head + start * every + i, head + j))
        return out


def named(tree: Node, shapes: Shapes) -> Matcher:
    """What matches tree, whose shapes it sets, with trees that have theirs from shapes."""
    own = Shapes(shapes)
    own.name(tree)
    return Matcher(own)


def align(a: Node, b: Node, matcher: Matcher | None = None) -> list[tuple[Node, Node]]:
    """Pairs of nodes with text of a largest match of two trees. matcher: if both have shapes, what knows them."""
    if matcher is None:
        shapes = Shapes()
        shapes.name(b)
        matcher = named(a, shapes)
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        if x.label != y.label:
            continue
        if x.text and y.text:
            pairs.append((x, y))
        if x.children and y.children:
            todo.extend((x.children[i], y.children[j]) for i, j in matcher.pairs([c.shape for c in x.children], [c.shape for c in y.children]))
    return pairs


def host(url):
    """The host of a url column in lower case, without a port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


LEAVES = "array<struct<text:string,kind:int,prose:boolean,mark:string,slots:array<struct<slot:bigint,same:boolean>>>>"
#: A slot's number is the place of its text in the reference page, with the number of that page above these bits.
SLOT_BITS = 40


class Reference:
    """Pages of a host that others are aligned with, and the numbers of their texts."""

    def __init__(self, pages: list[str]):
        self.shapes, self.trees = Shapes(), [parse(p) for p in pages]
        for t in self.trees:
            self.shapes.name(t)
        self.slots = [{id(n): (r << SLOT_BITS) + k for k, n in enumerate(leaves(t))} for r, t in enumerate(self.trees)]


def described(page: str | None, reference: Reference | None) -> tuple[list[Node], dict[int, list[tuple[int, bool]]]]:
    """A page's nodes with text in order, and for each (by id) its slots in the host's reference pages and whether it has their text."""
    tree = parse(page)
    slots: dict[int, list[tuple[int, bool]]] = {}
    if reference:
        matcher = named(tree, reference.shapes)
        for other, numbers in zip(reference.trees, reference.slots, strict=True):
            for x, y in align(tree, other, matcher):
                slots.setdefault(id(x), []).append((numbers[id(y)], x.text == y.text))
    return leaves(tree), slots


def _leaf_array(found: list[tuple[list[Node], dict[int, list[tuple[int, bool]]]]]) -> pa.Array:
    nodes = [n for ns, _ in found for n in ns]
    slots = [s for ns, at in found for n in ns for s in (at.get(id(n), ()),)]
    flat = [x for s in slots for x in s]
    inner = pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum([len(s) for s in slots]))), pa.int32()), pa.StructArray.from_arrays([pa.array([x for x, _ in flat], pa.int64()), pa.array([y for _, y in flat], pa.bool_())], ["slot", "same"])
    )
    columns = [
        pa.array([n.text for n in nodes], pa.string()), pa.array([-1 if n.off else n.main for n in nodes], pa.int32()), pa.array([n.tag in PROSE for n in nodes], pa.bool_()), pa.array([n.mark for n in nodes], pa.string()), inner,
    ]
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(ns) for ns, _ in found]))), pa.int32()), pa.StructArray.from_arrays(columns, ["text", "kind", "prose", "mark", "slots"]))


def aligned(pages: DataFrame, id_col: str, url_col: str, html_col: str, references: int = REFERENCES) -> DataFrame:
    """(page_id, url, host, leaves): the texts of each page, aligned with those of the host's reference pages.

    Pages fall into as many classes by a hash of their content as there are references; the least hash of each class is one, so the
    choice does not depend on the order of rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host(F.col("url")))
    marked = rows.where("html is not null").withColumn("mark", F.xxhash64("html")).withColumn("class", F.pmod("mark", F.lit(references)))
    marks = written(marked.groupBy("host", "class").agg(F.min("mark").alias("least")), "marks")
    each = marked.join(marks, ["host", "class"]).where("mark = least").groupBy("host", "class").agg(F.max("html").alias("html"))
    chosen = written(each.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "html"))), lambda x: x["html"]).alias("references")), "references")
    size = chosen.agg(F.coalesce(F.sum(F.octet_length(F.array_join("references", ""))), F.lit(0)).alias("n")).first()["n"]
    joined = rows.join(F.broadcast(chosen) if size <= BROADCAST_BYTES else chosen, "host", "left").select("page_id", "url", "host", "html", "references")

    def run(batches):
        held: dict[str, Reference] = {}  # of the hosts met last

        def reference(host: str, pages: list[str] | None) -> Reference | None:
            if pages is None:
                return None
            if host not in held:
                if len(held) >= 64:
                    held.pop(next(iter(held)))
                held[host] = Reference(pages)
            return held[host]

        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                found = [described(page.as_py(), held.get(at) or reference(at, ref.as_py())) for at, page, ref in zip(part.column(2).to_pylist(), part.column(3), part.column(4), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), _leaf_array(found)], ["page_id", "url", "host", "leaves"])

    return written(joined.mapInArrow(run, f"page_id long, url string, host string, leaves {LEAVES}"), "leaves")


def templates(found: DataFrame, constant: float = CONSTANT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, template, likely, furniture). template: slots that have the reference page's text in most pages aligned there, at least
    least_pages. likely: slots with one text in all pages aligned there, two for a few words and one more for each LONGER characters.
    furniture: names that may mark and stand on at least least_pages pages. Copies of one page count once."""
    pages = found.select("host", F.xxhash64(F.col("leaves.text")).alias("page"), "leaves")
    each = F.flatten(F.transform("leaves", lambda x: F.transform(x["slots"], lambda s: F.struct(s["slot"].alias("slot"), s["same"].alias("same"), F.length(x["text"]).alias("chars")))))
    slots = pages.select("host", "page", F.explode(each).alias("x")).groupBy("host", F.col("x.slot").alias("slot"), F.col("x.same").alias("same")).agg(F.count_distinct("page").alias("n"), F.max("x.chars").alias("chars"))
    each = slots.groupBy("host", "slot").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("same"), F.max(F.when(F.col("same"), F.col("chars"))).alias("chars"))
    fixed = (F.col("n") >= least_pages) & (F.col("same") >= constant * F.col("n"))
    likely = ~fixed & F.lit(constant <= 1) & (F.col("n") >= 2 + F.floor(F.col("chars") / LONGER)) & (F.col("same") == F.col("n"))
    listed = each.where(fixed | likely).groupBy("host").agg(F.collect_list(F.when(fixed, F.col("slot"))).alias("template"), F.collect_list(F.when(likely, F.col("slot"))).alias("likely"))
    names = pages.select("host", "page", F.explode(F.array_distinct(F.transform(F.filter("leaves", lambda x: (x["mark"] != "") & ~x["mark"].rlike("^[!?]")), lambda x: x["mark"]))).alias("name"))
    furniture = names.groupBy("host", "name").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= least_pages).groupBy("host").agg(F.collect_list("name").alias("furniture"))
    return listed.join(furniture, "host", "full")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", constant: float = CONSTANT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Main text of every row of pages: page_id, url, text, n_chars.

    Navigation, footers, forms, scripts and hidden elements never count. Of the rest, texts that are constant in their slot of the host
    are template and dropped; what varies is content. On hosts of few pages that takes fewer pages for short texts outside of articles and
    prose. Prose inside an article or main element is kept though constant where most of it is, as the page is then a near copy of the
    reference and not an article in its template. Among varying texts the elements' marks decide: what is surely or likely marked as
    comments, adverts and the like goes, and outside of articles also what a name may mark if the name recurs on the host. But of a page
    without unmarked prose in an article or main element, what holds more than half of the varying text is never taken away by its name, and
    what is only likely marked is not on any page. Articles stand for the main element, and both for the page, if they hold enough of its
    varying text. A page whose texts are all template or all marked keeps them. Null and empty pages have an empty text. Rows with null
    ids or urls and repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    found = aligned(pages, id_col, url_col, html_col)
    listed = written(templates(found, constant, least_pages), "templates")
    sizes = F.octet_length("host") + 8 * F.size(F.coalesce("template", F.array())) + 8 * F.size(F.coalesce("likely", F.array())) + F.octet_length(F.array_join(F.coalesce("furniture", F.array().cast("array<string>")), ",")) + 32
    size = listed.agg(F.coalesce(F.sum(sizes), F.lit(0)).alias("n")).first()["n"]
    none = F.array().cast("array<string>")
    joined = found.join(F.broadcast(listed) if size <= BROADCAST_BYTES else listed, "host", "left").withColumns({**{c: F.coalesce(c, F.array().cast("array<bigint>")) for c in ("template", "likely")}, "furniture": F.coalesce("furniture", none)})

    def chars(leaves: str, which: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.filter(leaves, which), F.lit(0).cast("long"), lambda n, x: n + F.length(x["text"]))

    def or_else(a: str, b: str) -> Column:
        return F.when(F.size(a) > 0, F.col(a)).otherwise(F.col(b))

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        """body of a value that is worked out once and not again for each element that body looks at."""
        return F.element_at(F.transform(F.array(value), body), 1)

    def placed(x: Column) -> Column:
        outside = (x["kind"] == 0) & ~x["prose"]
        fixed = F.exists(x["slots"], lambda s: s["same"] & (F.array_contains("template", s["slot"]) | (outside & F.array_contains("likely", s["slot"]))))
        return F.struct(x["text"].alias("text"), x["kind"].alias("kind"), x["mark"].alias("mark"), ((x["kind"] > 0) & x["prose"]).alias("told"), fixed.alias("fixed"))

    def unmarked(x: Column) -> Column:
        sign = F.left(x["mark"], F.lit(1))
        named = (sign != "!") & (sign != "?") & ((x["kind"] > 0) | ~F.array_contains("furniture", x["mark"]))
        return (x["mark"] == "") | named | F.array_contains("heavy", x["mark"])

    df = joined.withColumn("able", F.transform(F.filter("leaves", lambda x: x["kind"] >= 0), placed))
    # marks of more than half of the varying text: kept if they are only likely, or if no article or main element tells better
    varies = chars("able", lambda x: ~x["fixed"])
    df = df.withColumns({"varies": varies, "plainly": F.exists("able", lambda x: x["told"] & (x["mark"] == ""))})
    marks = F.array_distinct(F.transform(F.filter("able", lambda x: x["mark"].rlike("^[!?]")), lambda x: x["mark"]))
    weighed = F.transform(marks, lambda m: F.struct(m.alias("mark"), chars("able", lambda x: ~x["fixed"] & (x["mark"] == m)).alias("n")))
    heavy = F.filter(weighed, lambda w: (2 * w["n"] > F.col("varies")) & (w["mark"].startswith("?") | ~F.col("plainly")))
    df = df.withColumn("heavy", F.transform(heavy, lambda w: w["mark"]))
    df = df.withColumn("unmarked", F.filter("able", unmarked)).withColumn("plain", or_else("unmarked", "able"))
    copy = 2 * chars("plain", lambda x: x["told"] & x["fixed"]) > chars("plain", lambda x: x["told"])
    df = df.withColumn("varying", let(copy, lambda c: F.filter("plain", lambda x: ~x["fixed"] | (x["told"] & c)))).withColumn("content", or_else("varying", "plain"))
    whole, inside, article = chars("content", lambda x: F.lit(True)), chars("content", lambda x: x["kind"] > 0), chars("content", lambda x: x["kind"] == 2)
    df = df.withColumn("chars", F.struct(whole.alias("whole"), inside.alias("inside"), article.alias("article")))
    inside, article = F.col("chars.inside"), F.col("chars.article")
    least = F.when((inside == 0) | (inside < MAIN_SHARE * F.col("chars.whole")), 0).when((article == 0) | (article < ARTICLE_SHARE * inside), 1).otherwise(2)
    text = F.array_join(let(least, lambda n: F.transform(F.filter("content", lambda x: x["kind"] >= n), lambda x: x["text"])), "\n")
    return df.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
