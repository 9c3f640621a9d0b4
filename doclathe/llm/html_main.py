"""Main text of pages by wrapper induction.

Each page becomes a DOM tree. Elements that say what they are (menus, headers, footers, sidebars, forms,
scripts, adverts, comments and so on, by tag, role or class) vary from page to page like the text itself, so they are
left out by name. All other runs of text, inside and outside articles, are judged by the wrapper of their host:

- the pages of a host are aligned with one page of it, of the commonest shape, by simple tree matching;
- runs that are the same on at least half of the host's different pages are its template, varying slots are content;
- where articles (``article``, ``main``) hold at least half of the host's text they are its slot, and what varies
  outside them isn't content; else all that varies is.

A page of a host with fewer than three different pages, which has no wrapper, is judged by its own articles alone. A
template that would take more than half of the text of a page's articles is none (pages that are near copies of each
other have most of their text in common); a page whose articles are left empty gives its other runs.

What is compared between pages is the frame: the tree of blocks, and below each block a node ``#`` for every run of
text that it emits (inline elements included), with the run's hash. Children are aligned in order, by dynamic programming
over the sizes of the matches below them; equal subtrees at either end are paired first, which loses no match, and long lists
are halved (Hirschberg), so that memory is linear in them. No size and no depth changes the rule. The votes on a host's
nodes are summed over its different pages, so no host is gathered in one task.

Defined results: null and empty html give an empty text; a null URL, or one without host, belongs to the host '';
no rows give no rows; rows that repeat give the same text each (and count as one page of their host); of shapes that are
equally common the one of the larger hash is the model, and of its pages the one of the smallest id; extra columns are
ignored.
"""

from __future__ import annotations

import html as _html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.dom import BLOCK, RAW, Node, parse
from .common import chunks, own_columns, trimmed, written

#: Elements that are never main text.
DROP = frozenset("head script style noscript iframe template nav footer aside form button select option textarea input object svg canvas audio video map dialog menu title xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Class names and ids that mark what isn't main text; parts of one that has no other parts than these and PLAIN.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup social share sharing related recommended comment comments commentlist disqus reply replies respond widget pagination pager skip masthead topbar toolbar".split())
#: The same, but not within an article, where they hold its own head.
OUTER_MARKS = frozenset("header banner".split())
#: Parts of class names that say nothing of their own.
PLAIN = frozenset("list box bar section container wrapper wrap block area button buttons link links post posts article articles form thread slot unit item items content inner outer main top bottom left right side site page global primary secondary sub js mobile desktop fixed sticky inline head title body text icon icons group row col header banner".split())
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile(r"\s+")
#: A node is template if its text is the same on this share of the host's pages, three at least.
TEMPLATE_SHARE = 0.5
LEAST_PAGES = 3
#: Cells of a table of an alignment; beyond, lists are halved.
_CELLS = 1 << 20
#: Models of hosts are broadcast up to so many characters in all; beyond, they are joined, a host in so many parts.
MOST_MODELS, PARTS = 16 << 20, 32


@lru_cache(20_000)
def _attributes(attrs: str) -> tuple[str, frozenset, bool]:
    """Role, parts of class names and id, hidden."""
    values: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        values.setdefault(m[1].lower(), _html.unescape(m[2] or m[3] or m[4] or "").lower())
    names = []
    for name in (name for k in ("class", "id") for name in values.get(k, "").split()):
        parts = [x for x in re.split(r"[_-]+|(?<=[a-z])[0-9]+\Z", name) if x and not x.isdigit()]
        names += [name, *(x for x in parts if all(y in MARKS or y in PLAIN for y in parts))]
    style = {}
    for rule in values.get("style", "").split(";"):
        name, _, value = rule.partition(":")
        style[name.strip()] = value.replace("!important", "").strip()
    hidden = "hidden" in values or style.get("display") == "none" or style.get("visibility") == "hidden"
    return values.get("role", "").strip(), frozenset(names), hidden


def _says_chrome(node: Node, inside: bool) -> bool:
    if node.tag in DROP or node.tag == "header" and not inside:
        return True
    if not node.attrs or node.tag in ("html", "body", "article", "main"):
        return False
    role, names, hidden = _attributes(node.attrs) if len(node.attrs) < 400 else _attributes.__wrapped__(node.attrs)
    return hidden or role in ROLES or not names.isdisjoint(MARKS) or not inside and not names.isdisjoint(OUTER_MARKS)


def _is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or "role" in node.attrs and _attributes(node.attrs)[0] in ("main", "article")


class Page:
    """The runs of text of a page (all but what says that it is chrome), the frame node of each, and whether it is in an article."""

    def __init__(self, source: str):
        self.texts: list[str] = []
        self.nodes: list[int] = []
        self.marked: list[bool] = []
        self.frame: list[str] = []
        self.run: list[str] = []
        self.where: tuple[bool, int] = (False, -1)  # in an article, depth of the block around
        self._walk(parse(source))

    @property
    def articles(self) -> list[str]:
        return [t for t, m in zip(self.texts, self.marked) if m]

    def _flush(self) -> None:
        text = _SPACE.sub(" ", _html.unescape("".join(self.run))).strip()
        self.run = []
        if text:
            inside, depth = self.where
            self.texts.append(text)
            self.nodes.append(len(self.frame))
            self.marked.append(inside)
            self.frame.append(f"{depth + 1}:#:{xxhash.xxh32_hexdigest(text)}")

    def _walk(self, root: Node) -> None:
        """An iterative walk (pages may be nested deeply): ends of blocks are marked on the stack."""
        stack: list[tuple] = [(root, False, False)]
        while stack:
            item = stack.pop()
            if len(item) == 2:  # the end of a block: what follows belongs to the block around it
                self._flush()
                self.where = item
                continue
            node, inside, chrome = item
            if isinstance(node, str):
                if not chrome:
                    self.run.append(node)
                continue
            own = not inside and not chrome and _is_article(node)
            chrome = chrome or _says_chrome(node, inside or own)
            block = node.tag in BLOCK
            depth = self.where[1] + block
            if block:
                self._flush()
                # texts that are emitted have nodes of their own; what chrome says only helps to align
                words = " ".join("".join(k for k in node.kids if isinstance(k, str)).split()) if chrome else ""
                self.frame.append(f"{depth}:{node.tag}:{xxhash.xxh32_hexdigest(words) if words else ''}")
            if chrome and node.tag in RAW:
                continue
            if node.tag in ("br", "wbr", "img"):
                self.run.append("" if node.tag == "wbr" else " ")
            inside = inside or own
            if block:
                stack.append(self.where)
                self.where = (inside, depth)
            for kid in reversed(node.kids):
                stack.append((kid, inside, chrome))
        self._flush()


class Shapes:
    """Shapes of subtrees (tags only) by number, and the sizes of their largest matches."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.tag: list[str] = []
        self.kids: list[tuple] = []
        self.size: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def of(self, tag: str, kids: tuple) -> int:
        found = self.number.get((tag, kids))
        if found is None:
            found = self.number[tag, kids] = len(self.tag)
            self.tag.append(tag)
            self.kids.append(kids)
            self.size.append(1 + sum(self.size[k] for k in kids))
        return found

    def match(self, a: int, b: int) -> int:
        """Nodes of the largest order-keeping match of two subtrees, their tops included; 0 where the tops differ."""
        todo, known = [(a, b)], self.known
        while todo:
            x, y = todo[-1]
            if x == y or self.tag[x] != self.tag[y] or (x, y) in known:
                todo.pop()
                continue
            xs, ys = self.kids[x], self.kids[y]
            open_ = [(i, j) for i in set(xs) for j in set(ys) if i != j and self.tag[i] == self.tag[j] and (i, j) not in known]
            if open_:
                todo += open_
                continue
            todo.pop()
            known[x, y] = 1 + int(scores(xs, ys, self.rows(xs, ys))[-1])
        return self.size[a] if a == b else known[a, b] if self.tag[a] == self.tag[b] else 0

    def rows(self, xs, ys):
        """Match sizes of a shape of xs with all of ys, known ones."""
        different = sorted(set(ys))
        at = np.searchsorted(different, ys)
        one = lambda i, j: self.size[i] if i == j else self.known[i, j] if self.tag[i] == self.tag[j] else 0
        return {i: np.array([one(i, j) for j in different], np.float64)[at] for i in set(xs)}


def scores(xs, ys, rows) -> np.ndarray:
    """The sizes of the largest matches of all of xs with each beginning of ys."""
    last = np.zeros(len(ys) + 1)
    for x in xs:
        last = _next(last, rows[x])
    return last


def _next(last: np.ndarray, weights: np.ndarray) -> np.ndarray:
    row = last.copy()
    np.maximum(row[1:], last[:-1] + weights, out=row[1:])
    return np.maximum.accumulate(row, out=row)


def read_frame(frame: str, shapes: Shapes) -> list[list]:
    """Nodes in page order: [tag, hash, children, number, hash of the subtree, shape]; the first is the root."""
    nodes, path = [], []
    for number, item in enumerate(frame.split(";")):
        depth, tag, digest = item.split(":")
        node = [tag, digest, [], number, 0, 0]
        del path[int(depth) :]
        if path:
            path[-1][2].append(node)
        path.append(node)
        nodes.append(node)
    for node in reversed(nodes):
        node[4] = hash((node[0], node[1], *(k[4] for k in node[2])))
        node[5] = shapes.of(node[0], tuple(k[5] for k in node[2]))
    return nodes


def _paired(xs: list, ys: list, shapes: Shapes) -> list[tuple]:
    """Pairs of children of a largest match that keeps their order; of matches of one size one with more equal subtrees."""
    out, todo = [], [(0, len(xs), 0, len(ys))]
    ready = False
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and xs[a][4] == ys[c][4]:
            out.append((xs[a], ys[c]))
            a, c = a + 1, c + 1
        while a < b and c < d and xs[b - 1][4] == ys[d - 1][4]:
            b, d = b - 1, d - 1
            out.append((xs[b], ys[d]))
        if a == b or c == d:
            continue
        if b - a == d - c == 1:
            if xs[a][0] == ys[c][0]:
                out.append((xs[a], ys[c]))
            continue
        if not ready:
            mine, theirs = [x[5] for x in xs], [y[5] for y in ys]
            for i in set(mine):
                for j in set(theirs):
                    shapes.match(i, j)
            rows, code, ready = shapes.rows(mine, theirs), np.array([y[4] for y in ys]), True
        weight = lambda i, c=c, d=d: rows[mine[i]][c:d] + 0.25 * ((code[c:d] == xs[i][4]) & (rows[mine[i]][c:d] > 0))
        if (b - a) * (d - c) <= _CELLS or b - a == 1:
            table = [np.zeros(d - c + 1)]
            for i in range(a, b):
                table.append(_next(table[-1], weight(i)))
            i, j = b - a, d - c
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((xs[a + i], ys[c + j]))
            continue
        # too long for a table: halve xs, and part ys where both halves together match best
        half = (a + b) // 2
        ahead = np.zeros(d - c + 1)
        for i in range(a, half):
            ahead = _next(ahead, weight(i))
        back = np.zeros(d - c + 1)
        for i in range(b - 1, half - 1, -1):
            back = _next(back, weight(i)[::-1])
        cut = c + int(np.argmax(ahead + back[::-1]))
        todo += [(a, half, c, cut), (half, b, cut, d)]
    return out


def align(a: list, b: list, shapes: Shapes) -> list[tuple[int, int, bool]]:
    """Simple tree matching: pairs of node numbers of a largest order-keeping match, and whether their texts agree."""
    out, todo = [], [(a, b)] if a[0] == b[0] else []
    while todo:
        x, y = todo.pop()
        out.append((x[3], y[3], x[1] == y[1]))
        if x[2] and y[2]:
            todo += _paired(x[2], y[2], shapes)
    return out


_PARSED = "page_id long, url string, host string, frame string, shape long, in_articles long, elsewhere long, nodes array<int>, blocks array<string>, marked array<boolean>"


def _shape(frame: list[str]) -> int:
    """A hash of a frame without its texts."""
    return xxhash.xxh64_intdigest(";".join(x.rpartition(":")[0] for x in frame)) >> 1


def _parse(batches):
    for part in chunks(batches, "html", 4 << 20):
        rows = []
        for page_id, url, source in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            page = Page(source or "")
            host = (url or "").partition("://")[2]
            host = re.split(r"[/?#]", host, maxsplit=1)[0].lower()
            inside = sum(len(t) for t, m in zip(page.texts, page.marked) if m)
            rows.append((page_id, url, host, ";".join(page.frame), _shape(page.frame), inside, sum(map(len, page.texts)) - inside, page.nodes, page.texts, page.marked))
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.bool_())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=[c.split(" ")[0] for c in _PARSED.split(", ")])


class _Trees:
    """Models that are read already, with shapes in common; begun anew when there are too many."""

    def __init__(self):
        self.shapes, self.models = Shapes(), {}

    def aligned(self, frame: str, model: str):
        if len(self.shapes.tag) + len(self.shapes.known) > 200_000:
            self.__init__()
        if model not in self.models:
            self.models[model] = read_frame(model, self.shapes)
        tree = self.models[model]
        for x, y, equal in align(read_frame(frame, self.shapes)[0], tree[0], self.shapes):
            if equal and tree[y][0] == "#":
                yield x, y


def _votes(batches):
    """For each host of a batch: the number of its pages, and for each run of its model how many have the same there."""
    for batch in batches:
        trees, pages, same = _Trees(), {}, {}
        for host, frame, model in zip(*(batch.column(c).to_pylist() for c in ("host", "frame", "model")), strict=True):
            pages[host] = pages.get(host, 0) + 1
            for _, y in trees.aligned(frame, model):
                same[host, y] = same.get((host, y), 0) + 1
        rows = [(h, -1, n) for h, n in pages.items()] + [(h, y, n) for (h, y), n in same.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["host", "node", "n"])


def chosen(texts: list[str], marked: list[bool], gone: list[bool], slot: bool) -> list[str]:
    """The runs of a page that are content, by what its host's template takes and whether articles are its slot."""
    size = lambda some: sum(len(t) for t, s in zip(texts, some) if s)
    if 2 * size([m and g for m, g in zip(marked, gone)]) > size(marked):
        gone = [g and not m for m, g in zip(marked, gone)]
    left = [not g for g in gone]
    inside = [k and m for k, m in zip(left, marked)]
    return [t for t, k in zip(texts, inside if slot and any(inside) else left) if k]


def _content(batches):
    trees = _Trees()
    for batch in batches:
        out = []
        for frame, nodes, blocks, marked, model, template, slot in zip(*(batch.column(c).to_pylist() for c in ("frame", "nodes", "blocks", "marked", "model", "template", "slot")), strict=True):
            taken: set[int] = set()
            if template:
                constant = set(template)
                taken = {x for x, y in trees.aligned(frame, model) if y in constant}
            out.append("\n".join(chosen(blocks, marked, [n in taken for n in nodes], slot)))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), batch.column("induced")], names=["page_id", "url", "text", "n_chars", "induced"])


def _beside(rows: DataFrame, hosts: DataFrame, few: bool) -> DataFrame:
    """Rows with what is known of their host: broadcast, where that is little in all; else a host's rows meet in several parts."""
    if few:
        return rows.join(F.broadcast(hosts), F.col("host") == F.col("of"), "left")
    parts = hosts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.join(parts, (F.col("host") == F.col("of")) & (F.pmod(F.xxhash64("frame"), F.lit(PARTS)) == F.col("part")), "left").drop("part")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, induced (whether a wrapper of the host judged the page)."""
    parsed = written(own_columns(pages, "page_id", "url", "html").mapInArrow(trimmed(_parse), _PARSED), "html-pages")
    # the different pages of a host; one of the commonest shape stands for it
    unlike = parsed.groupBy("host", "frame").agg(F.min("page_id").alias("page_id"), F.first("shape").alias("shape"), F.max("in_articles").alias("in_articles"), F.max("elsewhere").alias("elsewhere"))
    shapes = unlike.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("page_id", "frame")).alias("m"), F.sum("in_articles").alias("inside"), F.sum("elsewhere").alias("outside"))
    model = shapes.groupBy("host").agg(F.max(F.struct("k", "shape", "m")).alias("best"), F.sum("k").alias("pages"), F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    model = model.where(F.col("pages") >= LEAST_PAGES).select(F.col("host").alias("of"), F.col("best.m.frame").alias("model"), (F.col("inside") >= F.col("outside")).alias("slot"))
    model = written(model, "html-models")
    few = (model.agg(F.sum(F.length("model") + 100)).collect()[0][0] or 0) <= MOST_MODELS
    aligned = _beside(parsed.select("host", "frame").distinct(), model, few).where("of is not null").select("host", "frame", "model")
    votes = aligned.mapInArrow(_votes, "host string, node int, n long").groupBy("host", "node").agg(F.sum("n").alias("n"))
    # per host a list no longer than its model
    ruled = votes.groupBy("host").agg(F.max(F.when(F.col("node") < 0, F.col("n"))).alias("pages"), F.collect_list(F.when(F.col("node") >= 0, F.struct("node", "n"))).alias("all"))
    ruled = ruled.select(F.col("host").alias("_h"), F.transform(F.filter("all", lambda x: x["n"] >= F.col("pages") * TEMPLATE_SHARE), lambda x: x["node"]).alias("template"))
    wrapper = written(model.join(ruled, F.col("of") == F.col("_h"), "left").select("of", "model", "template", "slot"), "html-wrappers")
    own = F.col("in_articles") >= F.col("elsewhere")  # without a wrapper
    rows = _beside(parsed, wrapper, few).select("page_id", "url", "frame", "nodes", "blocks", "marked", "model", "template", F.coalesce("slot", own).alias("slot"), F.col("of").isNotNull().alias("induced"))
    return rows.mapInArrow(trimmed(_content), "page_id long, url string, text string, n_chars long, induced boolean")
