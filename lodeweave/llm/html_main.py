"""Main text of a page by minimum cut.

A page becomes a row of text blocks. A classifier gives each block a cost for being content and one for
being boilerplate; blocks that follow each other, more so under one parent, pay for differing. The labels of
least total cost are a minimum cut: costs are the capacities to the two terminals, smoothness the capacities
between blocks, and a maximum flow finds it. Blocks whose own cost outweighs all their
edges are settled first (the cut must agree with them), flow runs on what is left.

The classifier adds two parts. Marks that a page states (element names, class and id words) have fixed costs.
How a block looks (length, share of links, punctuation, element) has log-odds learned from blocks of up to
``TRAIN_PAGES`` pages whose marks are plain.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import pieces, sample

TRAIN_PAGES = 2000

# Elements of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|template|noscript|svg|iframe|object|canvas|textarea|select"
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}

# Costs of marks, in nats in favour of content.
ELEMENTS = {"article": 8.0, "main": 8.0, "nav": -12.0, "footer": -12.0, "aside": -12.0, "form": -12.0, "button": -12.0, "menu": -12.0, "dialog": -12.0, "head": -40.0, "title": -40.0}
CONTENT_WORDS = frozenset("article content post entry story main body text".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies related share sharing social widget login signin signup search form "
    "pager pagination toolbar copyright legal disclaimer skip".split()
)
# Names with one of these say how a page is laid out or what state it is in, not what an element is: with-sidebar, comments-open.
STATE_WORDS = frozenset("with without has have no not is open opened closed enabled disabled on off layout template".split())
# No article inside brings back what a page hides or keeps in its head; other marks add up to no more than DEEPEST.
HIDDEN, DEEPEST = -30.0, -24.0
ROLES = {"navigation": -12.0, "banner": -12.0, "contentinfo": -12.0, "complementary": -12.0, "search": -12.0, "form": -12.0, "dialog": -12.0, "alert": -12.0, "main": 8.0, "article": 8.0}
# Smoothness: neighbours, the same parent, neighbours under one parent with others between.
NEAR, PARENT, APART = 0.3, 1.2, 0.6

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(?P<raw>{RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attr2>[^>]*+)>|(?P<text>[^<]++|<)",
    re.S | re.I,
)
# One attribute: name and value. Values of all names are read over, so nothing inside them counts as a name.
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_SPLIT = re.compile(r"[^a-z]+")


class Block:
    __slots__ = ("text", "links", "tag", "parent", "mark")

    def __init__(self, text: str, links: int, tag: str, parent: int, mark: float):
        self.text, self.links, self.tag, self.parent, self.mark = text, links, tag, parent, mark


def _mark(name: str, attr: str, inside: float) -> float:
    """Cost of an element's own marks. A header inside an article is a part of it."""
    cost = ELEMENTS.get(name, 0.0)
    if name == "header":
        cost = 0.0 if inside > 0 else -12.0
    hidden = False
    if attr and ("=" in attr or "hidden" in attr.lower()):
        seen = set()
        for m in _ATTRIBUTE.finditer(attr):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in seen:
                continue
            seen.add(key)
            if key == "role":
                cost += ROLES.get(value, 0.0)
            elif key == "hidden":
                hidden = True
            elif key == "aria-hidden":
                cost -= 12.0 * (value == "true")
            elif key in ("class", "id") and name not in ("html", "body"):
                names = [set(_SPLIT.split(x)) for x in value.split()]
                found = set().union(*[x for x in names if not x & STATE_WORDS])
                if found & BOILER_WORDS:
                    cost -= 12.0
                elif found & CONTENT_WORDS:
                    cost += 3.0
    return min(cost, HIDDEN) if hidden else cost if cost <= HIDDEN and name in ("head", "title") else max(cost, DEEPEST)


def _inside(outer: float, own: float) -> float:
    """Cost inside an element with marks ``own`` that lies in one with ``outer``. What lies in boilerplate is boilerplate, but
    for an article or main that does not look like it by its own marks: there the cut decides."""
    if outer <= -12:
        return 0.0 if own >= 8 and outer > HIDDEN else outer
    return own if own <= -12 else min(outer + own, 8.0)


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, character references decoded and white space turned into one space."""
    out: list[Block] = []
    # (name, number, marks so far) of the open elements
    stack: list[tuple[str, int, float]] = [("", 0, 0.0)]
    number, text, links, in_link = 0, [], 0, 0

    def close() -> None:
        nonlocal links
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                k = len(stack) - 1
                while k and stack[k][0] in INLINE:
                    k -= 1
                out.append(Block(joined, min(links, len(joined)), stack[k][0], stack[k - 1][1] if k else 0, stack[-1][2]))
            text.clear()
        links = 0

    for m in _TOKEN.finditer(page):
        if m.lastgroup == "text":
            text.append(m["text"])
            if in_link:
                links += len(m["text"])
            continue
        name = m["name"] or m["name2"]
        if name is None:
            if m["raw"]:
                text.append(" ")
            continue
        name = name.lower()
        end = m["end"] or m["end2"]
        if name == "br":
            text.append(" ")
            continue
        if name not in INLINE:
            close()
        if end:
            k = len(stack) - 1
            while k and stack[k][0] != name:
                k -= 1
            if k:
                if name == "a":
                    in_link = 0
                del stack[k:]
            continue
        if name in VOID:
            continue
        if name in CLOSES_P:
            _leave(stack, ("p",), ("div", "article", "section", "main", "body", "td", "th", "li"))
        elif name in SIBLINGS:
            _leave(stack, SIBLINGS[name].split(), ("ul", "ol", "dl", "table", "menu", "select"))
        if name == "a":
            in_link = 1
        number += 1
        outer = stack[-1][2]
        own = _mark(name, m["attr"] or m["attr2"] or "", outer)
        stack.append((name, number, _inside(outer, own)))
    close()
    return out


def _leave(stack: list, names, stop) -> None:
    """Close an open element of ``names``, unless one of ``stop`` is open inside it."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][0] in names:
            del stack[k:]
            return
        if stack[k][0] in stop:
            return


def look(b: Block) -> list[str]:
    """How a block looks, as feature names."""
    share = b.links / len(b.text)
    tag = "h" if re.fullmatch(r"h[1-6]", b.tag) else b.tag if b.tag in ("p", "li", "td", "pre", "blockquote") else "other"
    return [f"size{min(len(b.text).bit_length(), 10)}", f"links{math.ceil(share * 3)}", f"stop{b.text[-1] in '.!?…。'}", f"tag {tag}"]


def counts(page: str, into: dict) -> None:
    """Count how the blocks with plain marks look: (feature, is content)."""
    for b in blocks(page):
        if b.mark >= 4 or -40 < b.mark <= -12:
            for f in look(b):
                into[f, b.mark > 0] = into.get((f, b.mark > 0), 0) + 1


def log_odds(table: dict) -> dict[str, float]:
    """Smoothed log-odds of each feature. Both classes weigh the same."""
    total = {y: sum(n for (f, z), n in table.items() if z == y and f.startswith("size")) for y in (True, False)}
    names = {f for f, _ in table}
    return {f: math.log((table.get((f, True), 0) + 1) / (total[True] + 10)) - math.log((table.get((f, False), 0) + 1) / (total[False] + 10)) for f in names}


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, NEAR + PARENT * (found[i - 1].parent == b.parent)))
        j = last.get(b.parent)
        if j is not None and j < i - 1:
            out.append((j, i, APART))
        last[b.parent] = i
    return out


def min_cut(cost: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Labels x that minimise the sum of -cost where x is true plus the weights of links between unlike labels;
    false on ties."""
    n = len(cost)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in links:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    cost, label = list(cost), [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if label[i] is not None or abs(cost[i]) < sum(near[i].values()) or (cost[i] == 0 and near[i]):
            continue
        label[i] = cost[i] > 0
        for j, w in near[i].items():
            cost[j] += w if label[i] else -w
            del near[j][i]
            todo.append(j)
        near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i, x in zip(left, _flow(left, cost, near)):
            label[i] = x
    return label


def _flow(left: list[int], cost: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Maximum flow from the content terminal (-1) to the other (-2) along shortest paths; content is what the
    first still reaches."""
    room: dict[int, dict[int, float]] = {-1: {}, -2: {}}
    for i in left:
        room[i] = dict(near[i])
        room[i][-2] = max(-cost[i], 0.0)
        room[-1][i] = max(cost[i], 0.0)
    for i in left:
        room[i].setdefault(-1, 0.0)
        room[-2][i] = 0.0
    while True:
        came, queue = {-1: -1}, deque([-1])
        while queue and -2 not in came:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > 1e-12 and j not in came:
                    came[j] = i
                    queue.append(j)
        if -2 not in came:
            return [i in came for i in left]
        path, j = [], -2
        while j != -1:
            path.append((came[j], j))
            j = came[j]
        push = min(room[i][j] for i, j in path)
        for i, j in path:
            room[i][j] -= push
            room[j][i] = room[j].get(i, 0.0) + push


def main_text(page: str | None, odds: dict[str, float]) -> str:
    found = blocks(page or "")
    cost = [b.mark + max(-4.0, min(4.0, sum(odds.get(f, 0.0) for f in look(b)))) for b in found]
    return "\n".join(b.text for b, x in zip(found, min_cut(cost, edges(found))) if x)


def learn(pages: DataFrame, most: int = TRAIN_PAGES) -> dict[str, float]:
    """Log-odds from at most ``most`` pages, chosen by the hash of their html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict = {}
        for batch in batches:
            for page in batch.column("html").to_pylist():
                counts(page, table)
        yield pa.RecordBatch.from_pydict({"f": pa.array([f for f, _ in table], pa.string()), "y": pa.array([y for _, y in table], pa.bool_()), "n": pa.array(list(table.values()), pa.int64())})

    chosen = sample(pages.select("html").where(F.col("html").isNotNull()), F.col("html"), most)
    rows = chosen.repartition(8).mapInArrow(run, "f string, y boolean, n long").groupBy("f", "y").agg(F.sum("n").alias("n")).collect()  # a few dozen features
    return log_odds({(r["f"], r["y"]): r["n"] for r in rows})


def extract(pages: DataFrame, odds: dict[str, float] | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main text of every page.

    Null and empty pages give an empty text. Rows stand for themselves, so repeated rows, null ids and further
    columns do not matter; without any page to learn from the marks decide alone.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    odds = learn(rows) if odds is None else odds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = [main_text(p, odds) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
