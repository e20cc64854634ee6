"""Main text of web pages by wrapper induction.

Pages of one host come from the same templates. Their element trees are aligned by simple tree matching, and what the
aligned nodes hold tells template from content: nodes with the same text on all pages belong to the template, nodes whose text
varies are slots for content.

1. Every task reduces its pages to skeletons (element trees in which runs of like siblings are one node) and merges them,
   host by host, into wrappers. Skeletons of the same shape are aligned once.
2. Wrappers of a host meet in two steps, first salted, then per host. A wrapper holds shapes, counts and hashes, never
   texts, so its size follows the template and not the number of pages; a host with a third of all pages is no hot group.
3. Pages are read a second time, joined with the wrapper of their host, and what stands in its content region is their text.

The content region is the element whose direct blocks hold most varying text outside links, for each occurrence; the outermost article
around it (else main), if there is one, widens it. A page without the region of its host gives its own articles, or else all of its text. Menus, headers, footers, sidebars, notices, adverts, forms, scripts and comments inside it are left out by
element and by the words of class and role or a whole id (headings' ids are anchors and say nothing). Each page is aligned with the
wrapper, and the own text of nodes whose slot is constant is left out too, where it is that constant text. A slot is constant if at least
``ENOUGH`` different pages agree in it; on a host with fewer, if the share ``SHARE`` of them does, two at least, and most text in the region varies (near copies of
one page agree in their content). Pages are different if their texts outside menus and the like are; copies count once.

Defined cases: null or empty html gives an empty text; a null url or one without a host has the empty host; unclosed and stray
tags are read as browsers do in the common cases; repeated rows are pages of their own; an empty table gives no rows.
Columns that the operator does not know stay as they are, except that ``text`` and ``n_chars`` are its own.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import math
import re
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftloom.llm.common import own, small_batches
from draftloom.session import checkpoint

#: Different pages that must agree before a constant node inside the region counts as template; on a host with fewer pages this share of them.
ENOUGH, SHARE = 20, 0.8
#: What text in an article or main element, or marked as content, weighs more when the region is chosen.
FAVOUR = 1.5
#: Wrappers a task holds at once, and distinct children that a merged node lists one by one.
HELD, WIDEST, SALTS = 2000, 64, 16
#: Nesting beyond this depth is read flat, as browsers do; no text is lost.
DEEPEST = 200

# Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
LEFT_OUT = frozenset("head script style noscript template iframe object embed svg canvas audio video form button select input textarea label nav header footer aside menu dialog title".split())
CLOSES_P = BLOCKS - {"body", "html", "option", "caption", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
             "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Words of class, id and role that mark what is no article text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside header masthead footer foot "
    "notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments "
    "disqus respond reply replies widget toolbar pagination pager search form hidden skip legal copyright complementary contentinfo alert".split())
# Words that stand beside a mark in one class or id without changing what it says.
BESIDE_MARKS = frozenset("area bar block box button buttons container content desktop global group inner item items left link links list main mobile outer page posts primary right row secondary section site slot unit wrap wrapper".split())
ARTICLE_MARKS = frozenset("ad ads advert advertisement sponsored promo related recommended comment comments reply replies hidden".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = frozenset({"article", "main"})
REGION_MARKS = frozenset({"article", "main", "content", "post", "entry", "story"})

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(/?)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")


class Node:
    """An element: its label (name and marks), text pieces and children in order."""

    __slots__ = ("name", "marks", "items")

    def __init__(self, name: str, marks: tuple[str, ...] = ()) -> None:
        self.name, self.marks, self.items = name, marks, []

    @property
    def label(self) -> str:
        # Classes of whole pages and articles often name the single page; they would keep like pages apart.
        marks = () if self.name in ("html", "body", "main") else ARTICLE_MARKS.intersection(self.marks) if self.name == "article" else self.marks
        return " ".join((self.name, *sorted(marks)))

    @property
    def outside(self) -> bool:
        """The element is never article text."""
        return left_out(self.name, self.marks)


def left_out(name: str, marks: Iterable[str]) -> bool:
    """Menus, notices and the like. Marks of a whole page or article speak of its layout, save for comments and adverts."""
    if name in LEFT_OUT:
        return True
    if name in ("html", "body", "main", "#root"):
        return False
    return any(m in (ARTICLE_MARKS if name == "article" else MARKS) for m in marks)


def _marks(name: str, attributes: str) -> tuple[str, ...]:
    if "=" not in attributes and "hidden" not in attributes:
        return ()
    words: set[str] = set()
    # Attributes one after the other, values with their names: what looks like an attribute inside a value is none.
    for key, double, single, bare in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (double or single or bare).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            words.add("hidden")
        elif key in ("class", "role") or key == "id" and name not in HEADINGS:
            # A class or id marks an element as a whole: "cookie-notice" and "comments-list" do, "legal-history" does not.
            for token in value.split():
                found = _NAME.findall(token)
                whole = all(w in MARKS or w in BESIDE_MARKS for w in found)
                words.update(found if whole else [w for w in found if w not in MARKS])
    return tuple(sorted(words))


def parse(source: str) -> Node:
    """The element tree of a page; comments and declarations are gone, raw text stays in its element."""
    root = Node("#root")
    stack, at = [root], 0
    while True:
        found = _TOKEN.search(source, at)
        if found is None:
            if at < len(source):
                stack[-1].items.append(source[at:])
            return root
        if found.start() > at:
            stack[-1].items.append(source[at:found.start()])
        at = found.end()
        if found[2] is None:
            if found[0].startswith("<![CDATA["):
                stack[-1].items.append(entities.escape(found[0][9:-3], quote=False))
            continue
        name = found[2].lower()
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    del stack[depth:]
                    break
            continue
        _close_implied(stack, name)
        node = Node(name, _marks(name, found[3]) if found[3] else ())
        stack[-1].items.append(node)
        if name in VOID or found[4] and name not in BLOCKS:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            stop = end.start() if end else len(source)
            node.items.append(source[at:stop])
            at = end.end() if end else len(source)
            continue
        if len(stack) < DEEPEST:
            stack.append(node)


def _close_implied(stack: list[Node], name: str) -> None:
    if name in CLOSES_P:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name == "p":
                del stack[depth:]
                break
            if stack[depth].name in BLOCKS:
                break
    if name in CLOSED_BY:
        closes, limits = CLOSED_BY[name]
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name in limits:
                break
            if stack[depth].name in closes:
                del stack[depth:]
                break


class Slot:
    """A node of a wrapper. ``same`` is the hash of its own text while all pages agree, None once it varies.

    ``seen`` holds hashes of up to ``ENOUGH`` different pages that have the node (in a finished wrapper, how many), ``nodes`` the
    elements of a page that became this node, where they are tracked; ``times`` counts the elements and ``rows`` the pages, copies included.
    """

    __slots__ = ("label", "seen", "same", "chars", "linked", "children", "nodes", "rows", "times")

    def __init__(self, label: str, seen: frozenset[int] | int, same: int | None, chars: int, linked: int, children: list[Slot], nodes: list[Node] | None = None, rows: int = 1, times: int = 1) -> None:
        self.label, self.seen, self.same, self.chars, self.linked, self.children, self.nodes, self.rows, self.times = label, seen, same, chars, linked, children, nodes, rows, times

    @property
    def different(self) -> int:
        """Different pages that have the node, up to ``ENOUGH``."""
        return self.seen if isinstance(self.seen, int) else len(self.seen)

    def pack(self, finished: bool = False) -> list:
        seen = self.different if finished or isinstance(self.seen, int) else sorted(self.seen)
        return [self.label, seen, self.same, self.chars, self.linked, [c.pack(finished) for c in self.children], self.rows, self.times]

    @staticmethod
    def unpack(x: list) -> Slot:
        seen = x[1] if isinstance(x[1], int) else frozenset(x[1])
        return Slot(x[0], seen, *x[2:5], [Slot.unpack(c) for c in x[5]], None, *x[6:])


def page_hash(root: Node) -> int:
    """Hash of a page's text outside menus, notices and the like: copies under other menus are the same page."""
    texts: list[str] = []
    todo: list[Node | str] = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            texts.append(x)
        elif not x.outside:
            texts.append(" ")
            todo += reversed(x.items)
    return int.from_bytes(hashlib.blake2b(" ".join("".join(texts).split()).encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")


def _fewest(a: frozenset[int], b: frozenset[int]) -> frozenset[int]:
    """The smallest ``ENOUGH`` hashes of both sets."""
    if a is b or b <= a:
        return a
    both = a | b
    return both if len(both) <= ENOUGH else frozenset(sorted(both)[:ENOUGH])


def skeleton(node: Node, in_link: bool = False, seen: frozenset[int] = frozenset({0}), track: bool = False) -> Slot:
    """A page's tree with runs of like siblings merged into one slot; ``seen`` holds the page's hash."""
    texts, children = [], []
    in_link = in_link or node.name == "a"
    for item in node.items:
        if isinstance(item, str):
            texts.append(item)
            continue
        if item.name in ("script", "style") or item.name == "br":
            continue
        child = skeleton(item, in_link, seen, track)
        if children and children[-1].label == child.label:
            children[-1] = merge(children[-1], child, repeated=True)
        else:
            children.append(child)
    text = " ".join("".join(texts).split())
    return Slot(node.label, seen, zlib.crc32(text.encode("utf-8", "surrogatepass")), len(text), len(text) if in_link else 0, children, [node] if track else None)


def _agree(a: int | None, b: int | None) -> int:
    return 2 if a == b else int(a is None or b is None)


class _Memory(dict):
    """Alignments of lists of children by the two lists. Each is made once; the lists are kept, so that their ids stay theirs."""

    def align(self, a: list[Slot], b: list[Slot]) -> tuple[int, list[tuple[int, int]]]:
        key = (id(a), id(b))
        if key not in self:
            self[key] = (a, b, *self._made(a, b))
        return self[key][2:]

    def _made(self, a: list[Slot], b: list[Slot]) -> tuple[int, list[tuple[int, int]]]:
        if not a or not b:
            return 0, []
        if [x.label for x in a] == [x.label for x in b]:
            return sum(1 + self.align(x.children, y.children)[0] for x, y in zip(a, b)), [(i, i) for i in range(len(a))]
        score = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        pair = [[0] * len(b) for _ in a]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                if x.label == y.label:
                    pair[i][j] = 1000 * (1 + self.align(x.children, y.children)[0]) + _agree(x.same, y.same)
                score[i + 1][j + 1] = max(score[i][j + 1], score[i + 1][j], score[i][j] + pair[i][j])
        i, j, out = len(a), len(b), []
        while i and j:
            if pair[i - 1][j - 1] and score[i][j] == score[i - 1][j - 1] + pair[i - 1][j - 1]:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif score[i][j] == score[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return sum(pair[i][j] // 1000 for i, j in out), out[::-1]


def tree_match(a: list[Slot], b: list[Slot], memory: _Memory | None = None) -> list[tuple[int, int]]:
    """Simple tree matching of two lists of children: the aligned pairs, in order, that match most nodes; of equal ones, those whose texts agree."""
    return (_Memory() if memory is None else memory).align(a, b)[1]


def matched(a: list[Slot], b: list[Slot]) -> int:
    """Number of nodes that simple tree matching aligns below two nodes."""
    return _Memory().align(a, b)[0]


def merge(a: Slot, b: Slot, repeated: bool = False, memory: _Memory | None = None) -> Slot:
    """Two aligned nodes as one; children without a partner keep their place. ``repeated``: both stand on the same page."""
    memory = _Memory() if memory is None else memory
    children, i, j = [], 0, 0
    for x, y in [*tree_match(a.children, b.children, memory), (len(a.children), len(b.children))]:
        children += a.children[i:x]
        children += b.children[j:y]
        if x < len(a.children):
            children.append(merge(a.children[x], b.children[y], repeated, memory))
        i, j = x + 1, y + 1
    if len(children) > WIDEST:
        # A node without a fixed sequence of children: one slot for each label.
        named: dict[str, Slot] = {}
        for c in children:
            named[c.label] = merge(named[c.label], c, repeated) if c.label in named else c
        children = list(named.values())
    same = a.same if a.same == b.same else None
    if a.nodes is not None and b.nodes is not None:
        a.nodes.extend(b.nodes)
    return Slot(a.label, _fewest(a.seen, b.seen), same, a.chars + b.chars, a.linked + b.linked, children, a.nodes, max(a.rows, b.rows) if repeated else a.rows + b.rows, a.times + b.times)


class Wrapper:
    """The merged tree of some pages of a host, and hashes of up to ``ENOUGH`` of their different texts."""

    def __init__(self, tree: Slot, pages: set[int]) -> None:
        self.tree, self.pages = tree, pages

    @staticmethod
    def of(source: str) -> Wrapper:
        root = parse(source)
        page = page_hash(root)
        return Wrapper(skeleton(root, seen=frozenset({page})), {page})

    def merge(self, other: Wrapper) -> Wrapper:
        pages = self.pages | other.pages
        return Wrapper(merge(self.tree, other.tree), set(sorted(pages)[:ENOUGH]))

    def dump(self, finished: bool = False) -> str:
        """``finished``: pages are counted, not listed; such a wrapper is read with and no longer merged."""
        return json.dumps([self.tree.pack(finished), sorted(self.pages)])

    @staticmethod
    def load(text: str) -> Wrapper:
        tree, pages = json.loads(text)
        return Wrapper(Slot.unpack(tree), set(pages))


def _host(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def induce(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper): one row per host, from all of its pages."""
    small_batches(pages.sparkSession)

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Wrapper] = {}
        salt = TaskContext.get().partitionId() % SALTS

        def out() -> pd.DataFrame:
            return pd.DataFrame({"host": list(held), "salt": salt, "wrapper": [w.dump() for w in held.values()]})

        for batch in batches:
            for host, source in zip(batch["host"], batch["html"]):
                if not source:
                    continue
                page = Wrapper.of(source)
                held[host] = held[host].merge(page) if host in held else page
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    def meet(frames: Iterator[pd.DataFrame]) -> Wrapper:
        whole = None
        for text in frames:
            part = Wrapper.load(text)
            whole = part if whole is None else whole.merge(part)
        return whole

    def salted(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [meet(frame["wrapper"]).dump()]})

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": [meet(frame["wrapper"]).dump(finished=True)]})

    parts = pages.select(_host(url).alias("host"), F.col(html).alias("html")).mapInPandas(collect, "host string, salt int, wrapper string")
    first = parts.groupBy("host", "salt").applyInPandas(salted, "host string, wrapper string")
    return checkpoint(first.groupBy("host").applyInPandas(finish, "host string, wrapper string"))


def _varying(slot: Slot) -> bool:
    """Some text in the node or below it differs between pages."""
    todo = [slot]
    while todo:
        x = todo.pop()
        if x.chars and x.same is None:
            return True
        todo += x.children
    return False


def _varied_headings(children: list[Slot]) -> list[int]:
    """Ids of headings over text that varies: they belong to it, though all pages have them (ingredients, method)."""
    out, varies = [], False
    for slot in reversed(children):
        if slot.label.split(" ")[0] in HEADINGS:
            if varies:
                out.append(id(slot))
            varies = False
        else:
            varies = varies or _varying(slot)
    return out


class Reader:
    """Reads the article of a host's pages: which labels hold the content, and which slots are constant and so template."""

    def __init__(self, wrapper: Wrapper) -> None:
        self.tree = wrapper.tree
        self.template: set[int] = set()
        self.region: tuple[str, ...] = ()
        few = wrapper.tree.different < ENOUGH
        need = max(2, math.ceil(SHARE * wrapper.tree.different)) if few else ENOUGH
        best, region = 0.0, None
        spared: set[int] = set()
        # Each slot with its path and the outermost article and main around it.
        todo: list[tuple[Slot, tuple[str, ...], dict[str, tuple]]] = [(wrapper.tree, (wrapper.tree.label,), {})]
        while todo:
            slot, path, around = todo.pop()
            words = slot.label.split(" ")
            if left_out(words[0], words[1:]):
                continue
            if words[0] in REGIONS and words[0] not in around:
                around = {**around, words[0]: (slot, path)}
            spared.update(_varied_headings(slot.children))
            if slot.chars and slot.same is not None and slot.different >= need and id(slot) not in spared:
                self.template.add(id(slot))
            weight = self._direct(slot)
            if words[0] in REGIONS or any(w in REGION_MARKS for w in words[1:]):
                weight *= FAVOUR
            if weight > best:
                best, self.region, region = weight, path, slot
                if "article" in around:
                    region, self.region = around["article"]
                elif "main" in around and not _holds(around["main"][0], "article"):
                    region, self.region = around["main"]
            todo += [(c, (*path, c.label), around) for c in reversed(slot.children)]
        if few and region is not None and not self._varies(region):
            self.template.clear()

    @staticmethod
    def _varies(region: Slot) -> bool:
        """Most of the region's text varies: the pages are not near copies of one."""
        chars, varying, todo = 0, 0, [region]
        while todo:
            x = todo.pop()
            words = x.label.split(" ")
            if x is not region and left_out(words[0], words[1:]):
                continue
            chars += x.chars
            varying += x.chars if x.same is None else 0
            todo += x.children
        return 2 * varying > chars

    @staticmethod
    def _direct(slot: Slot) -> float:
        """Varying text outside links in the node and the blocks right below it; of several such nodes on a page (teasers), of one."""
        total = 0.0
        for part in (slot, *[c for c in slot.children if not left_out(c.label.split(" ")[0], c.label.split(" ")[1:])]):
            deep = [part] if part is slot else _inline(part)
            total += sum(x.chars - x.linked for x in deep if x.same is None or x.different < 2)
        return total * slot.rows / slot.times

    def text(self, root: Node) -> str:
        """The blocks of the article, joined by blank lines."""
        blocks: list[str] = []
        silent = self._constant(root) if self.template else set()
        for find in (self._at, self._semantic, lambda x: [x]):
            for node in find(root):
                piece: list[str] = []
                self._blocks(node, silent, piece, blocks)
                _flush(piece, blocks)
            if blocks:
                break
        return "\n\n".join(blocks)

    def _constant(self, root: Node) -> set[int]:
        """Ids of the page's nodes whose own text is the constant text of the slot that they are aligned with."""
        out: set[int] = set()
        memory = _Memory()
        todo = [(self.tree, skeleton(root, track=True))]
        while todo:
            slot, mine = todo.pop()
            if id(slot) in self.template and mine.same == slot.same:
                out.update(map(id, mine.nodes))
            todo += [(slot.children[i], mine.children[j]) for i, j in tree_match(slot.children, mine.children, memory)]
        return out

    @staticmethod
    def _semantic(root: Node) -> list[Node]:
        """Outermost article elements, or else main elements, outside whatever is no article text."""
        for name in ("article", "main"):
            out, todo = [], [root]
            while todo:
                node = todo.pop()
                if node.outside:
                    continue
                if node.name == name:
                    out.append(node)
                    continue
                todo += [c for c in reversed(node.items) if not isinstance(c, str)]
            if out:
                return out
        return []

    def _at(self, root: Node) -> Iterator[Node]:
        """The page's elements on the path of the region."""
        todo = [(root, (root.label,))]
        while todo:
            node, path = todo.pop()
            if path == self.region:
                yield node
            elif self.region[:len(path)] == path:
                todo += [(c, (*path, c.label)) for c in reversed(node.items) if not isinstance(c, str)]

    @staticmethod
    def _blocks(node: Node, silent: set[int], piece: list[str], blocks: list[str]) -> None:
        # An explicit stack: pages can be nested deeper than Python recurses.
        todo: list[tuple] = [("open", node)]
        while todo:
            step, x = todo.pop()
            if step == "text":
                piece.append(x)
            elif step == "end":
                _flush(piece, blocks)
            else:
                if x is not node and x.outside:
                    continue
                if x.name == "br":
                    piece.append(" ")
                    continue
                if x.name in BLOCKS:
                    _flush(piece, blocks)
                    todo.append(("end", None))
                quiet = id(x) in silent
                for item in reversed(x.items):
                    todo.append(("text", " " if quiet else item) if isinstance(item, str) else ("open", item))


def _holds(slot: Slot, name: str) -> bool:
    return any(c.label.split(" ")[0] == name or _holds(c, name) for c in slot.children)


def _inline(slot: Slot) -> list[Slot]:
    out, todo = [], [slot]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [c for c in x.children if c.label.split(" ")[0] not in BLOCKS]
    return out


def _flush(piece: list[str], blocks: list[str]) -> None:
    text = _SPACE.sub(" ", entities.unescape("".join(piece))).strip()
    piece.clear()
    if text:
        blocks.append(text)


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Add text and n_chars (code points) to every page."""
    small_batches(pages.sparkSession)
    host, wrapper = own("host"), own("wrapper")
    wrappers = induce(pages, url, html).select(F.col("host").alias(host), F.col("wrapper").alias(wrapper))
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        readers: dict[int, Reader] = {}
        for sources, texts in batches:
            out = []
            for source, text in zip(sources, texts):
                if not source:
                    out.append("")
                    continue
                reader = readers.get(hash(text))
                if reader is None:
                    if len(readers) > HELD:
                        readers.clear()
                    reader = readers[hash(text)] = Reader(Wrapper.load(text))
                out.append(reader.text(parse(source)))
            yield pd.Series(out, dtype="object")

    joined = pages.withColumn(host, _host(url)).join(wrappers, host, "left")
    done = joined.withColumn("text", read(F.col(html), F.col(wrapper)))
    return done.select(*keep, "text", F.length("text").cast("long").alias("n_chars"))
