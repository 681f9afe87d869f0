"""Main text of web pages by wrapper induction.

A page becomes a tree of its block elements, in which runs of like siblings are
folded into one node. The trees of a host's pages are aligned by simple tree
matching: nodes with equal labels match, and the children of matching nodes are
aligned in order so that the number of matching nodes is greatest. The aligned
trees merge into the host's wrapper. A text that stands at the same node on every
page is template; slots whose texts vary hold content. Slots can also vary without
being content (links, adverts), and there markup decides. Elements whose whole class
token, id or role names a menu, header, sidebar, form, notice, advert or comments are
left out, unless they hold over four fifths of the page's varying text, or half of it
with the only article or main region. A page's articles or main regions are taken
alone if they hold at least half of its varying text; if not, all of it is taken.

Wrappers merge in any order, so each task folds its own pages first, and a host
with a third of all pages sends a wrapper per task. Wrappers meet the pages by a
broadcast if they are small together, by a join on the host if not.

Trees may be of any depth: nothing here calls itself.

Defined results: a null or empty page has an empty text; a null url is a host of its
own; a host with fewer than ``SUPPORT`` different pages has no template texts; rows
that repeat are extracted alike; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import html
import itertools
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Different pages that must agree on a text for it to be template.
SUPPORT = 5
#: The share of a page's text that may differ, in its shortest texts, between captures of it.
REST = 0.15
#: Wrappers of all hosts together are broadcast up to so many bytes.
BROADCAST_BYTES = 16 * 1024 * 1024
#: A task passes on its wrappers when it holds so many hosts.
HELD_HOSTS = 5_000

# What HTML and common practice call things.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset(["hr"])
_SILENT = frozenset(
    "applet audio button canvas datalist embed iframe map noframes noscript option select svg "
    "template video".split()
)
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"),
}
_HOLDS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",),
          "th": ("table",), "tbody": ("table",)}
_ASIDE_TAGS = frozenset("nav footer aside form menu dialog".split())
_ASIDE_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments "
    "commentlist complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion disqus "
    "footer form login masthead menu modal nav navbar navigation newsletter notice notification pager pagination "
    "popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip "
    "social sponsor sponsored subscribe tagcloud toolbar topbar widget".split()
)
_HEAD_WORDS = frozenset(["header"])
#: How much an element is left out: what its name says, if it does not hold the page's text, and always.
_HEAD, _NAMED, _ALWAYS = 1, 2, 3

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(script|style|textarea|title|xmp)\b[^>]*+>(?:.*?</\1\s*+>|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/a-zA-Z][^>]*+>",  # other markup, and tags with a quote left open
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.IGNORECASE)
_NAME = re.compile(r"[A-Za-z]+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SINGLE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
#: Words, or characters where words stand without spaces.
_COUNTED = re.compile(rf"[{_SINGLE}]|[^\s{_SINGLE}]+")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Node:
    """A block element: its texts, and its children with the texts between them."""

    __slots__ = ("label", "tag", "names", "hidden", "parts")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.hidden, self.names = tag, False, ()
        words: tuple[str, ...] = ()
        if attrs:
            found, names = [], []
            for name, value in _ATTR.findall(attrs):
                name, value = name.lower(), value.strip("\"'")
                if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                    self.hidden = True
                elif name == "style":
                    self.hidden |= bool(_HIDDEN.search(value))
                else:
                    found += [w.lower() for w in _NAME.findall(value) + _WORD.findall(value)]
                    names += value.split()
            words, self.names = tuple(sorted(set(found))), tuple(names)
        self.label = ".".join((tag, *words))
        self.parts: list = []


def parse(page: str) -> Node:
    """Tree of block elements; texts are decoded, white space is one space.

    A head has no texts of its own but titles, scripts and styles, so it needs no end.
    """
    root = Node("root")
    stack = [root]
    opened: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
    held: list[str] = []
    silent, depth = "", 0
    last = 0

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            stack[-1].parts.append(text)

    def close(place: int) -> None:
        for node in reversed(stack[place:]):
            opened[node.tag].pop()
        del stack[place:]

    for m in _TOKEN.finditer(page):
        if not silent and m.start() > last:
            held.append(page[last : m.start()])
        last = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if silent:
            if tag == silent and not (m[4] or "").endswith("/"):
                depth += -1 if m[2] else 1
                silent = silent if depth else ""
            continue
        if tag in _SILENT:
            if not m[2] and tag != "embed" and not m[4].endswith("/"):
                silent, depth = tag, 1
            continue
        if tag == "br":
            held.append(" ")
        if tag not in _BLOCKS:
            continue
        flush()
        if m[2]:
            if opened[tag]:
                close(opened[tag][-1])
            continue
        if stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag in _CLOSES:
            holder = max((opened[t][-1] for t in _HOLDS[tag] if opened[t]), default=0)
            ended = [i for t in _CLOSES[tag] for i in itertools.takewhile(holder.__lt__, reversed(opened[t]))]
            if ended:
                close(min(ended))
        node = Node(tag, m[4])
        stack[-1].parts.append(node)
        if tag not in _VOID:
            opened[tag].append(len(stack))
            stack.append(node)
    if not silent:
        held.append(page[last:])
    flush()
    return root


def _digest(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")


#: Stands for the pages of a slot that was seen on ``SUPPORT`` different ones.
ENOUGH = frozenset(range(SUPPORT))


def _either(a: frozenset[int], b: frozenset[int]) -> frozenset[int]:
    """Different pages of two slots, as far as they need to be told apart."""
    if a is b or a is ENOUGH or b is ENOUGH:
        return b if b is ENOUGH else a
    both = a | b
    return both if len(both) < SUPPORT else ENOUGH


class Wrapper:
    """Merged tree of pages: different pages seen, texts on all of them, children.

    Copies of a page count once in every slot. ``nodes`` are the elements of the one
    page that a fresh tree comes from.
    """

    __slots__ = ("label", "seen", "common", "kids", "shape", "size", "nodes")

    def __init__(self, label: str, seen: frozenset[int], common: set[int], kids: list[Wrapper], nodes: list[Node] = ()):
        self.label, self.seen, self.common, self.kids, self.nodes = label, seen, common, kids, nodes
        self.size = 1 + sum(k.size for k in kids)
        self.shape = label if not kids else _digest("\n".join((label, *(k.shape for k in kids))))

    @classmethod
    def built(cls, rows: list) -> Wrapper:
        """Tree of rows, parents first: (place of the parent, ready tree or its label, seen, common, nodes)."""
        kids: list[list[Wrapper]] = [[] for _ in rows]
        for k in range(len(rows) - 1, -1, -1):
            above, *own = rows[k]
            made = own[0] if len(own) == 1 else cls(*own[:3], kids[k][::-1], own[3])
            kids[above].append(made)
        return made

    def to_list(self) -> list:
        rows, queue = [], [(0, self)]
        for k, (above, x) in enumerate(queue):
            rows.append([above, x.label, [] if x.seen is ENOUGH else sorted(x.seen), sorted(x.common)])
            queue += [(k, kid) for kid in x.kids]
        return rows

    @classmethod
    def of_list(cls, rows: list) -> Wrapper:
        return cls.built([(a, label, frozenset(seen) or ENOUGH, set(common), ()) for a, label, seen, common in rows])


def folded(nodes: list[Node], seen: frozenset[int]) -> Wrapper:
    """Like siblings as one node, with all they hold; seen: the page."""
    rows, queue = [], [(0, nodes)]
    for k, (above, group) in enumerate(queue):
        texts = {_hash(p) for n in group for p in n.parts if isinstance(p, str)}
        rows.append((above, group[0].label, seen, texts, group))
        runs: list[list[Node]] = []
        for p in (p for n in group for p in n.parts if isinstance(p, Node)):
            if runs and runs[-1][0].label == p.label:
                runs[-1].append(p)
            else:
                runs.append([p])
        queue += [(k, run) for run in runs]
    return Wrapper.built(rows)


class Alignment:
    """Simple tree matching of two trees whose roots have equal labels."""

    def __init__(self, a: Wrapper, b: Wrapper):
        self.known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            inner = [
                (p, q) for p in x.kids for q in y.kids
                if p.label == q.label and p.shape != q.shape and (id(p), id(q)) not in self.known
            ] if x.shape != y.shape and (id(x), id(y)) not in self.known else []
            if inner:
                todo += inner
            else:
                todo.pop()
                if x.shape != y.shape and (id(x), id(y)) not in self.known:
                    self.known[id(x), id(y)] = self._children(x, y)

    def score(self, a: Wrapper, b: Wrapper) -> int:
        """Matching nodes of two nodes with equal labels."""
        return a.size if a.shape == b.shape else self.known[id(a), id(b)][0]

    def pairs(self, a: Wrapper, b: Wrapper) -> list[tuple[int, int]]:
        """Their matching children."""
        return [(i, i) for i in range(len(a.kids))] if a.shape == b.shape else self.known[id(a), id(b)][1]

    def _children(self, a: Wrapper, b: Wrapper) -> tuple[int, list[tuple[int, int]]]:
        n, m = len(a.kids), len(b.kids)
        best = [[0] * (m + 1) for _ in range(n + 1)]
        weight = [[0] * m for _ in range(n)]
        for i in range(n):
            for j in range(m):
                if a.kids[i].label == b.kids[j].label:
                    weight[i][j] = self.score(a.kids[i], b.kids[j])
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight[i][j])
        pairs, i, j = [], n, m
        while i and j:
            if weight[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + weight[i - 1][j - 1]:
                pairs.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return 1 + best[n][m], pairs[::-1]


def aligned(a: Wrapper, b: Wrapper) -> tuple[int, list[tuple[int, int]]]:
    """(matching nodes, child pairs) of two nodes with equal labels."""
    found = Alignment(a, b)
    return found.score(a, b), found.pairs(a, b)


def merged(a: Wrapper, b: Wrapper) -> Wrapper:
    """Both wrappers in one; children without a partner stay as optional ones."""
    found, rows, queue = Alignment(a, b), [], [(0, a, b)]
    for k, (above, v, w) in enumerate(queue):
        if w is None:
            rows.append((above, v))
            continue
        rows.append((above, v.label, _either(v.seen, w.seen), v.common & w.common, ()))
        i = j = 0
        for x, y in [*found.pairs(v, w), (len(v.kids), len(w.kids))]:
            queue += [(k, kid, None) for kid in v.kids[i:x] + w.kids[j:y]]
            if x < len(v.kids):
                queue.append((k, v.kids[x], w.kids[y]))
            i, j = x + 1, y + 1
    return Wrapper.built(rows)


def identity(root: Node) -> int:
    """What makes a page another one: its longest texts, those that hold most of it all.

    A page that is stored again with another date, counter or link list beside the
    same article is no second page.
    """
    texts, todo = set(), [root]
    while todo:
        for p in todo.pop().parts:
            if isinstance(p, Node):
                todo.append(p)
            else:
                texts.add(p)
    left, long = sum(map(len, texts)), []
    rest = left * REST
    for p in sorted(texts, key=lambda p: (-len(p), p)):
        if left <= rest:
            break
        long.append(p)
        left -= len(p)
    return _hash("\n".join(long))


class Host:
    """The wrapper of a host's pages."""

    def __init__(self, wrapper: Wrapper):
        self.wrapper = wrapper

    @classmethod
    def of_page(cls, page: str) -> Host:
        root = parse(page)
        return cls(folded([root], frozenset([identity(root)])))

    def add(self, other: Host) -> None:
        if self.wrapper.seen == other.wrapper.seen and len(self.wrapper.seen) == 1:
            return  # the same page again
        self.wrapper = merged(self.wrapper, other.wrapper)

    def dumps(self) -> bytes:
        return json.dumps(self.wrapper.to_list()).encode()

    @classmethod
    def loads(cls, data: bytes) -> Host:
        return cls(Wrapper.of_list(json.loads(data)))


@lru_cache(10_000)
def _says(token: str) -> int:
    """What a whole class token, id or role says about an element."""
    parts = [w.lower() for w in _WORD.findall(token)]
    for name in ("".join(parts), token.lower()):
        if name in _ASIDE_WORDS:
            return _NAMED
        if name in _HEAD_WORDS:
            return _HEAD
    return _NAMED if parts and all(w in _ASIDE_WORDS for w in parts) else 0


def _aside(node: Node) -> int:
    """What the markup says about an element that is not content."""
    if node.tag in ("body", "html", "root"):
        return 0
    if node.hidden or node.tag in _ASIDE_TAGS and node.tag != "form":
        return _ALWAYS
    if node.tag == "main":
        return 0
    said = max(map(_says, node.names), default=0)
    return max(said, _NAMED if node.tag == "form" else _HEAD if node.tag == "header" else 0)


def _slots(own: Wrapper, slot: Wrapper) -> dict[int, Wrapper]:
    """Which wrapper node each element of a page belongs to."""
    found, out, todo = Alignment(own, slot), {}, [(own, slot)]
    while todo:
        a, b = todo.pop()
        out.update((id(n), b) for n in a.nodes)
        todo += [(a.kids[i], b.kids[j]) for i, j in found.pairs(a, b)]
    return out


def main_text(page: str, host: Host | None) -> str:
    """The page's content blocks, one to a line."""
    root = parse(page)
    known = host is not None and host.wrapper.seen is ENOUGH
    slots = _slots(folded([root], ENOUGH), host.wrapper) if known else {}
    # Elements in order, parents first, and the texts that are not template, with their element.
    nodes, above, texts, sizes = [root], [0], [], []

    def opened(k: int) -> tuple:
        slot = slots.get(id(nodes[k]))
        return k, iter(nodes[k].parts), slot.common if slot is not None and slot.seen is ENOUGH else ()

    stack = [opened(0)]
    while stack:
        k, parts, template = stack[-1]
        for p in parts:
            if isinstance(p, Node):
                nodes.append(p)
                above.append(k)
                stack.append(opened(len(nodes) - 1))
                break
            if not (template and _hash(p) in template):
                texts.append((k, p))
                sizes.append(p.count(" ") + 1 if p.isascii() else len(_COUNTED.findall(p)))
        else:
            stack.pop()

    # An element that holds the page's text is not left out for its name.
    says = [_aside(n) for n in nodes]
    gone = [False] * len(nodes)
    named = [False] * len(nodes)
    inside = [False] * len(nodes)
    for k, n in enumerate(nodes):
        a = above[k]
        gone[k] = gone[a] or says[k] == _ALWAYS
        inside[k] = inside[a] or n.tag in ("article", "main")
        if says[k] == _HEAD and inside[a]:
            says[k] = 0
        named[k] = named[a] or says[k] != 0
    held = [0] * len(nodes)
    for (k, _), size in zip(texts, sizes, strict=True):
        held[k] += 0 if gone[k] else size
    marks = [n.tag in ("article", "main") and not g for n, g in zip(nodes, gone, strict=True)]
    outside = any(m and not x for m, x in zip(marks, named, strict=True))
    for k in range(len(nodes) - 1, 0, -1):
        held[above[k]] += held[k]
        marks[above[k]] |= marks[k]
    left = [0] * len(nodes)
    for k in range(1, len(nodes)):
        holds = held[k] * 5 > held[0] * 4 or marks[k] and not outside and held[k] * 2 >= held[0]
        left[k] = max(left[above[k]], 0 if holds and says[k] != _ALWAYS else says[k])

    # Outermost regions of each kind; a main region is narrowed to the articles that hold its text.
    article, main = [0] * len(nodes), [0] * len(nodes)
    for k in range(1, len(nodes)):
        for tag, region in (("article", article), ("main", main)):
            region[k] = region[above[k]] or (k if nodes[k].tag == tag and not left[k] else 0)
    rest = in_article = in_main = both = 0
    for (k, _), size in zip(texts, sizes, strict=True):
        if not left[k]:
            rest += size
            in_article += size if article[k] else 0
            in_main += size if main[k] else 0
            both += size if article[k] and main[k] else 0
    region = None
    if any(main) and any(article):
        if both and both * 2 >= in_main:
            region, most = ([a and m for a, m in zip(article, main, strict=True)], both)
        else:
            region, most = main, in_main
        lone = in_article - both
        if lone > most * 2:
            region, most = article, in_article
        elif lone * 2 >= most and lone:
            region, most = [a or m for a, m in zip(article, region, strict=True)], most + lone
    elif any(main) or any(article):
        region, most = (main, in_main) if any(main) else (article, in_article)
    if region is not None and most * 2 < rest:
        region = None
    return "\n".join(p for k, p in texts if (region[k] and not left[k] if region else left[k] <= _HEAD))


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(hosts: dict[str, Host]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(hosts), pa.string()), pa.array([h.dumps() for h in hosts.values()], pa.binary())],
            ["host", "wrapper"],
        )

    hosts: dict[str, Host] = {}
    for batch in batches:
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            one = Host.of_page(page.as_py() or "")
            if name in hosts:
                hosts[name].add(one)
            else:
                hosts[name] = one
        if len(hosts) > HELD_HOSTS:
            yield flush(hosts)
            hosts = {}
    yield flush(hosts)


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    parts = [Host.loads(x) for x in rows["wrapper"]]
    parts.sort(key=lambda h: (-len(h.wrapper.seen), -h.wrapper.size, h.wrapper.shape))
    for other in parts[1:]:
        parts[0].add(other)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [parts[0].dumps()]})


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hosts: dict[bytes, Host] = {}
    for batch in batches:
        texts = []
        for page, data in zip(batch.column(2), batch.column(3), strict=True):
            data = data.as_py()
            if data is not None and data not in hosts:
                if len(hosts) > HELD_HOSTS:
                    hosts.clear()
                hosts[data] = Host.loads(data)
            texts.append(main_text(page.as_py() or "", hosts.get(data)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]
        )


def wrappers(pages: DataFrame) -> DataFrame:
    """``(host, wrapper)``, merged in two steps so that no host's parts meet at once."""
    parts = pages.select("host", "html").mapInArrow(_induce, "host string, wrapper binary")
    parts = parts.withColumn("lane", F.pmod(F.xxhash64("wrapper"), 16))
    lanes = parts.groupBy("host", "lane").applyInPandas(_merge, "host string, wrapper binary")
    return lanes.groupBy("host").applyInPandas(_merge, "host string, wrapper binary")


def extract_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` for ``pages (page_id, url, html)``."""
    host = F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    hosted = pages.select("page_id", "url", "html", F.lower(host).alias("host"))
    learned = checkpointed(wrappers(hosted))
    size = learned.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    right = F.broadcast(learned) if size <= BROADCAST_BYTES else learned
    return hosted.join(right, "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(
        _extract, "page_id bigint, url string, text string"
    )


def op7(spark, sf_dir: str) -> DataFrame:
    found = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))
