"""Graph queries without iteration."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.operators import packs
from lodeweave.operators.held import held
from lodeweave.operators.iterate import any_mask, mask_columns, masks, numbered, unmasked, weighted
from lodeweave.session import cut


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, n_out, n_in, w_out, w_in)`` in one pass: each edge is counted at both ends."""
    e = weighted(edges)
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )
    return (
        e.select(F.explode(ends).alias("x"), "weight")
        .groupBy("x.node")
        .agg(
            F.sum("x.o").alias("n_out"),
            F.sum("x.i").alias("n_in"),
            F.sum(F.col("weight") * F.col("x.o")).alias("w_out"),
            F.sum(F.col("weight") * F.col("x.i")).alias("w_in"),
        )
    )


def match(triples: DataFrame, patterns: Sequence[tuple[str, str, str]], once: bool = False) -> DataFrame:
    """Bindings of a conjunctive pattern. A part starting with ``?`` is a variable;
    each pattern after the first must share one with those before it.

    A pattern that only tests what the one before it binds is joined with that one first, so its bindings are not copied to
    all rows found so far. With ``once`` each triple is given once, as by ``graph_build.triples``, and equal ones are not looked for.
    """
    steps: list[DataFrame] = []
    seen: set[str] = set()
    for pattern in patterns:
        rows, names = triples, {}
        for part, col in zip(pattern, ("src", "rel", "dst")):
            if not part.startswith("?"):
                rows = rows.where(F.col(col) == part)
            elif part[1:] in names:
                rows = rows.where(F.col(col) == F.col(names[part[1:]]))
            else:
                names[part[1:]] = col
        bound = rows.select(*[F.col(col).alias(name) for name, col in names.items()])
        if not once:
            bound = bound.distinct()
        if steps and not seen & set(names):
            raise ValueError(f"pattern {pattern} shares no variable with those before it")
        mine = [n for n in names if steps and n in steps[-1].columns]
        if len(steps) > 1 and mine and set(names) <= seen:
            steps[-1] = steps[-1].join(bound, mine)
        else:
            steps.append(bound)
        seen |= set(names)
    out = steps[0]
    for bound in steps[1:]:
        out = out.join(bound, [n for n in bound.columns if n in out.columns])
    return out


def _undirected(edges: DataFrame) -> DataFrame:
    return (
        edges.where("src <> dst")
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct()
    )


#: Edges that a task of ``triangles`` and one of ``edge_similarity`` holds, and edges that are packed at a time.
EDGES_PER_TASK, EDGES_HELD, PACKED = 8_000_000, 16_000_000, 8_000_000


@dataclass
class Coloured:
    """Edges in packs by the colours of their ends, and the triples of colours that they go to (Suri & Vassilvitskii 2011).

    ``ranks`` are ``(node, degree, id)`` with ids in the order of the degrees; an edge points from the lower to the higher id, which bounds a node's out-list by
    sqrt(2m). The colour of a node is its id modulo ``colours``, so node ``i`` of a colour is the id ``i * colours + colour``, and ``span`` is more than any ``i``.
    The edge of two colours goes to every triple that holds both, so the three edges of a triangle meet in the triple of their colours.
    With C colours a triple has about 6/C² of the edges; so a task's memory is bounded whatever the hubs, and an edge is sent C times, as two bytes or three.
    """

    ranks: DataFrame
    packs: DataFrame
    colours: int
    span: int

    def triple(self, *of: int) -> int:
        p, q, r = sorted(of)
        return (p * self.colours + q) * self.colours + r

    def third(self, triple: int, cell: int) -> int:
        """The colour of a triple beside those of a cell."""
        c = self.colours
        return triple // c**2 + triple // c % c + triple % c - cell // c - cell % c

    def in_triples(self, packs: DataFrame) -> DataFrame:
        """``(t, cell, keys)``: each pack of a cell in all triples that hold its colours; one of the cell -1 - p in those that hold the colour p."""
        every, c = range(self.colours), self.colours
        routes = [(p * c + q, self.triple(p, q, x)) for p in every for q in every for x in every]
        routes += [(-1 - p, t) for p in every for t in {self.triple(p, q, x) for q in every for x in every}]
        to = packs.sparkSession.createDataFrame(routes, "cell int, t int")
        # Packs are small for the work they bring, so the number of tasks does not follow from their size.
        return packs.join(F.broadcast(to), "cell").select("t", "cell", "keys").repartition(2 * len({t for _, t in routes}), "t")

    def degrees(self) -> DataFrame:
        """``(cell, keys)``: the degrees of the nodes of each colour p in their order, as the cell -1 - p."""

        def pack(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("id")
            return pa.table({"cell": pa.array([-1 - key[0].as_py()], pa.int32()), "keys": pa.array([packs.packed(rows["degree"].to_numpy())], pa.binary())})

        return self.ranks.select((F.col("id") % self.colours).alias("p"), "id", "degree").groupBy("p").applyInArrow(pack, "cell int, keys binary")


def coloured(edges: DataFrame, edges_per_task: int, both: bool = False) -> Coloured:
    """``both`` says that the edges hold each pair once in each direction; they are read where they lie then."""
    if both:
        e, ends = edges.where("src < dst").select("src", "dst"), edges.select(F.col("src").alias("node"))
    else:
        e = cut(_undirected(edges))
        ends = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node")))
    degree = ends.groupBy("node").agg(F.count("*").cast("int").alias("degree"))
    placed = numbered(degree.select(F.struct("degree", "node").alias("entity")))
    ranks = cut(placed.select("entity.node", "entity.degree", "id"))
    n = e.count()
    colours = max(1, math.ceil(math.sqrt(6 * n / edges_per_task)))
    span = ranks.count() // colours + 1
    small = held(ranks)
    s, d = small.select(F.col("node").alias("src"), F.col("id").alias("s")), small.select(F.col("node").alias("dst"), F.col("id").alias("d"))
    out = e.join(s, "src").join(d, "dst").select(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append((batch["a"].to_numpy().astype(np.int64), batch["b"].to_numpy().astype(np.int64)))
            size += len(batch)
            if size >= PACKED:
                yield _pack_cells(*map(np.concatenate, zip(*waiting)), colours, span)
                waiting, size = [], 0
        if size:
            yield _pack_cells(*map(np.concatenate, zip(*waiting)), colours, span)

    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, math.ceil(n / PACKED))
    return Coloured(ranks, out.coalesce(tasks).mapInArrow(pack, "cell int, keys binary"), colours, span)


def _pack_cells(a: np.ndarray, b: np.ndarray, colours: int, span: int) -> pa.RecordBatch:
    """The edges as packs ``(cell, keys)``, a cell for each two colours."""
    cell, keys = a % colours * colours + b % colours, a // colours * span + b // colours
    order = np.lexsort((keys, cell))
    cell, keys = cell[order], keys[order]
    ends = np.append(np.flatnonzero(np.diff(cell, prepend=-1)), len(cell))
    held_ = [packs.packed_keys(keys[i:j]) for i, j in itertools.pairwise(ends.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(cell[ends[:-1]], pa.int32()), pa.array(held_, pa.binary())], ["cell", "keys"])


def triangles(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK, both: bool = False) -> DataFrame:
    """``(node, degree, n_triangles, clustering)``, by triples of colours of edges in packs (``Coloured``)."""
    c = coloured(edges, edges_per_task, both)
    found = c.in_triples(c.packs).groupBy("t").applyInArrow(_count_triple(c.colours, c.span), "id int, n long").groupBy("id").agg(F.sum("n").alias("n_triangles"))
    n = F.coalesce("n_triangles", F.lit(0))
    degree = F.col("degree").cast("long")
    possible = degree * (degree - 1)
    return c.ranks.join(found, "id", "left").select(
        "node",
        degree.alias("degree"),
        n.alias("n_triangles"),
        F.when(possible > 0, 2.0 * n / possible).otherwise(0.0).alias("clustering"),
    )


@dataclass
class _Lists:
    """The out-lists of the edges of a triple of colours, a stretch for each colour. A node is its place among those of its colour, one colour after the other."""

    ids: np.ndarray
    first: np.ndarray
    ends: np.ndarray
    order: np.ndarray
    codes: np.ndarray
    of: np.ndarray
    target: int

    def closed(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """``(u, uv, vw, uw)``: a node and the places of the three edges of its triangles with nodes after it, some at a time."""
        first, ends = self.first, self.ends
        size, place = np.diff(first), np.full(len(self.ids), -1)
        for u in np.flatnonzero(first[4::4] - first[:-4:4] > 1):
            low, high = first[4 * u], first[4 * u + 4]
            mine = ends[low:high]
            third = self.target - self.codes[u] - self.codes[mine]
            at = 4 * mine + self.of[np.where((third > 0) & (third < len(self.of)), third, 0)]
            n = size[at]
            some = np.flatnonzero(n)
            if not len(some):
                continue
            place[mine] = np.arange(low, high)
            # The stretches of the neighbours, one after the other, for as many as fill a step.
            steps = np.searchsorted(np.cumsum(n[some]), np.arange(0, n.sum(), WEDGES))
            for x, y in itertools.pairwise(np.unique(np.append(steps, len(some)))):
                now = some[x:y]
                k = n[now]
                vw = np.arange(k.sum()) + np.repeat(first[at[now]] - np.cumsum(k) + k, k)
                uw = place[ends[vw]]
                hit = np.flatnonzero(uw >= 0)
                yield u, np.repeat(now + low, k)[hit], vw[hit], uw[hit]
            place[mine] = -1


#: Second edges that a task of ``triangles`` looks up at a time.
WEDGES = 4_000_000


def _cells(rows: pa.Table) -> dict[int, np.ndarray]:
    """The sorted keys of each cell of a triple, from its packs."""
    held_: dict[int, list[np.ndarray]] = {}
    for cell, keys in zip(rows["cell"].to_pylist(), rows["keys"].to_pylist()):
        if cell >= 0:
            held_.setdefault(cell, []).append(packs.unpacked_keys(keys))
    return {cell: np.sort(np.concatenate(held_.pop(cell))) for cell in sorted(held_)}


def _out_lists(cells: dict[int, np.ndarray], triple: int, colours: int, span: int) -> _Lists:
    wanted = (triple // colours**2, triple // colours % colours, triple % colours)
    slot = {c: i for i, c in enumerate(sorted(set(wanted)))}
    # Sums of these codes are equal for equal colours only, as none is met more than three times.
    code = {c: 4**i for c, i in slot.items()}
    # The out-list of a node, one stretch for each colour; place 3 stands for no colour.
    of = np.full(max(code.values()) * 3 + 1, 3)
    of[list(code.values())] = range(len(code))
    n = len(slot) * span
    stretches = [(slot[cell // colours] * span + keys // span) * 4 + slot[cell % colours] for cell, keys in cells.items()]
    ends = [slot[cell % colours] * span + keys % span for cell, keys in cells.items()]
    stretch, end = np.concatenate(stretches), np.concatenate(ends)
    del stretches, ends
    order = np.argsort(stretch * n + end)
    first = np.append(0, np.cumsum(np.bincount(stretch, minlength=4 * n)))
    ids = np.concatenate([np.arange(span) * colours + c for c in slot])
    return _Lists(ids, first, end[order].astype(np.int32), order, np.repeat([code[c] for c in slot], span), of, sum(code[c] for c in wanted))


def _count_triple(colours: int, span: int):
    """``(id, n)``: the triangles at each node whose three colours are those of the triple."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lists = _out_lists(_cells(rows), key[0].as_py(), colours, span)
        counts, met, size = np.zeros(len(lists.ids), np.int64), [], 0
        for u, uv, vw, _ in lists.closed():
            counts[u] += len(uv)
            met += [lists.ends[vw], lists.ends[uv]]
            size += len(uv)
            if size > WEDGES:
                counts += np.bincount(np.concatenate(met), minlength=len(counts))
                met, size = [], 0
        if met:
            counts += np.bincount(np.concatenate(met), minlength=len(counts))
        some = np.flatnonzero(counts)
        return pa.table({"id": pa.array(lists.ids[some], pa.int32()), "n": pa.array(counts[some], pa.int64())})

    return run


def edge_similarity(edges: DataFrame, edges_per_task: int = EDGES_HELD, both: bool = False) -> DataFrame:
    """``common_neighbors`` of every edge, once with src < dst.

    The common neighbours of an edge are the third corners of its triangles, so they are met in the triples of colours of ``triangles``. A triple
    sends the sums of the edges of a cell as arrays in the order of its keys, so that these are added up without the edges; no row stands for an edge
    and a neighbour.
    """
    c = coloured(edges, edges_per_task, both)
    sent = c.in_triples(c.packs.unionByName(c.degrees()))
    found = sent.groupBy("t").applyInArrow(_weigh_triple(c), "cell int, keys binary, n binary, aa binary")
    sums = found.groupBy("cell").applyInArrow(_sum_cell(c.colours, c.span), "a int, b int, common long, adamic_adar double")
    small = held(c.ranks)
    s, d = (small.select(F.col("id").alias(x), *[F.col(y).alias(f"{x}_{y}") for y in ("node", "degree")]) for x in "ab")
    return sums.join(s, "a").join(d, "b").select(
        F.least("a_node", "b_node").alias("src"),
        F.greatest("a_node", "b_node").alias("dst"),
        "common",
        (F.col("common") / (F.col("a_degree") + F.col("b_degree") - F.col("common"))).alias("jaccard"),
        "adamic_adar",
    )


def _weigh_triple(c: Coloured):
    """``(cell, keys, n, aa)``: the triangles of the triple at each edge of a cell, and the sums of 1 / ln(degree) of their third corners. The keys go with one triple of a cell."""
    colours, span, third = c.colours, c.span, Coloured(None, None, c.colours, c.span).third

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        triple, cells = key[0].as_py(), _cells(rows)
        out = {"cell": [], "keys": [], "n": [], "aa": []}
        if cells:
            lists = _out_lists(cells, triple, colours, span)
            degree = np.zeros(len(lists.ids))
            for cell, keys in zip(rows["cell"].to_pylist(), rows["keys"].to_pylist()):
                if cell < 0:
                    mine = packs.unpacked(keys)
                    at = span * sorted({triple // colours**2, triple // colours % colours, triple % colours}).index(-1 - cell)
                    degree[at : at + len(mine)] = mine
            # A node of one edge is in no triangle.
            weight = 1 / np.log(np.maximum(degree, 2))
            n, aa = np.zeros(len(lists.ends), np.int32), np.zeros(len(lists.ends))
            for u, uv, vw, uw in lists.closed():
                low, wide = lists.first[4 * u], lists.first[4 * u + 4] - lists.first[4 * u]
                mine = slice(low, low + wide)
                for at, corner in ((uv, vw), (uw, uv)):
                    n[mine] += np.bincount(at - low, minlength=wide).astype(np.int32)
                    aa[mine] += np.bincount(at - low, weight[lists.ends[corner]], wide)
                # Each of these edges is met once with ``u``.
                n[vw] += 1
                aa[vw] += weight[u]
            back, more = np.empty_like(n), np.empty_like(aa)
            back[lists.order], more[lists.order] = n, aa
            at = 0
            for cell, keys in cells.items():
                mine = slice(at, at + len(keys))
                at += len(keys)
                out["cell"].append(cell)
                out["keys"].append(packs.packed_keys(keys) if third(triple, cell) == 0 else None)
                out["n"].append(packs.packed(back[mine]))
                out["aa"].append(pa.compress(more[mine].tobytes(), "zstd", asbytes=True))
        return pa.table([pa.array(out["cell"], pa.int32()), *[pa.array(out[x], pa.binary()) for x in ("keys", "n", "aa")]], ["cell", "keys", "n", "aa"])

    return run


def _sum_cell(colours: int, span: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        keys = packs.unpacked_keys(next(k for k in rows["keys"].to_pylist() if k is not None))
        n, aa = np.zeros(len(keys), np.int64), np.zeros(len(keys))
        for x, y in zip(rows["n"], rows["aa"]):
            n += packs.unpacked(x.as_py())
            aa += np.frombuffer(pa.decompress(y.as_py(), 8 * len(keys), "zstd"))
        some = np.flatnonzero(n)
        a, b = np.divmod(keys[some], span)
        return pa.table([
            pa.array((a * colours + cell // colours).astype(np.int32)), pa.array((b * colours + cell % colours).astype(np.int32)), n[some], aa[some],
        ], ["a", "b", "common", "adamic_adar"])

    return run


def common_neighbors(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shared neighbours, Jaccard and Adamic-Adar scores of the given ``(src, dst)`` pairs.

    Each pair walks the neighbours of its lower-degree end only, so hubs are looked
    up and not listed. Pairs without a shared neighbour are left out.
    """
    e = _undirected(edges)
    both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    deg = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    ends = (
        pairs.select("src", "dst")
        .distinct()
        .join(deg.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src")
        .join(deg.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    )
    by_src = F.col("ds") <= F.col("dd")
    walk = ends.select(
        "src",
        "dst",
        "ds",
        "dd",
        F.when(by_src, F.col("src")).otherwise(F.col("dst")).alias("low"),
        F.when(by_src, F.col("dst")).otherwise(F.col("src")).alias("high"),
    )
    shared = (
        walk.join(both.select(F.col("src").alias("low"), F.col("dst").alias("w")), "low")
        .join(both.select(F.col("src").alias("high"), F.col("dst").alias("w")), ["high", "w"], "left_semi")
        .join(deg.select(F.col("node").alias("w"), F.col("degree").alias("dw")), "w")
    )
    return (
        shared.groupBy("src", "dst", "ds", "dd")
        .agg(F.count("*").alias("common"), F.sum(1 / F.ln("dw")).alias("adamic_adar"))
        .select(
            "src",
            "dst",
            "common",
            (F.col("common") / (F.col("ds") + F.col("dd") - F.col("common"))).alias("jaccard"),
            "adamic_adar",
        )
    )


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row ``(modularity, n_communities)`` (Newman & Girvan 2004). ``edges`` hold both directions."""
    of = held(membership.select("node", "community"))
    e = (
        weighted(edges)
        .join(of.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src")
        .join(of.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst")
    )
    per = e.groupBy("cs").agg(
        F.sum(F.when(F.col("cs") == F.col("cd"), F.col("weight")).otherwise(0.0)).alias("inside"),
        F.sum("weight").alias("total"),
    )
    return per.agg(
        F.sum("total").alias("m2"),
        F.sum("inside").alias("inside"),
        F.sum(F.col("total") * F.col("total")).alias("squares"),
        F.count("*").alias("n_communities"),
    ).select(
        (F.col("inside") / F.col("m2") - F.col("squares") / (F.col("m2") * F.col("m2"))).alias("modularity"),
        "n_communities",
    )


def community_rollup(nodes: DataFrame, levels: DataFrame) -> DataFrame:
    """Node counts and degree sums per community, per upper community and in all.

    ``levels`` is ``(node, top, sub)``, ``nodes`` is ``(node, degree)``; a null in
    ``sub`` or ``top`` marks the sum over it.
    """
    return (
        nodes.join(levels, "node")
        .rollup("top", "sub")
        .agg(F.count("*").alias("n_nodes"), F.sum("degree").alias("degree"))
    )


def masked_subgraph(edges: DataFrame, near: DataFrame) -> DataFrame:
    """Edges with both ends among a question's nodes, a row for each edge and block of questions: ``(src, dst, weight, block, mask0, ...)``.

    ``near`` are stored masks ``(node, block, mask0, ...)`` of ``iterate.masks``. Up to ``HELD_NODES`` of them are sent to all tasks, so no edge is shuffled.
    """
    mine, sent = mask_columns(), held(near)
    both = (
        weighted(edges)
        .join(sent.select(F.col("node").alias("src"), "block", *[F.col(c).alias(f"src_{c}") for c in mine]), "src")
        .join(sent.select(F.col("node").alias("dst"), "block", *[F.col(c).alias(f"dst_{c}") for c in mine]), ["dst", "block"])
    )
    return both.select("src", "dst", "weight", "block", *[F.col(f"src_{c}").bitwiseAND(F.col(f"dst_{c}")).alias(c) for c in mine]).where(any_mask())


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among a question's nodes: ``(q_id, src, dst, weight)``.

    Questions are bits of a mask, so an edge is joined once for a block of them and copied to its questions at the end.
    """
    near, asked = masks(nodes)
    return unmasked(masked_subgraph(edges, cut(near)), asked).select("q_id", "src", "dst", "weight")
