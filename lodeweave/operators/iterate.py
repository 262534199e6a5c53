"""Iterative graph operators.

Each is a loop of joins and partial aggregations on the driver, which holds only
a round number and a stop flag. ``cut`` ends the lineage of every round with a
table in the shared folder, so a lost executor costs one round.
Edges are ``(src, dst[, weight])``; ``symmetric`` turns once-stored edges both ways.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodeweave.operators import blocks
from lodeweave.operators.held import held
from lodeweave.operators.skew import ROWS_PER_TASK, add_salt, copy_per_salt, hot_keys
from lodeweave.session import cut, discard, pin


def weighted(edges: DataFrame) -> DataFrame:
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    return edges.select("src", "dst", weight.alias("weight"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of undirected edges, self-loops left out."""
    e = weighted(edges).where("src <> dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def endpoints(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node")))
    return ends.distinct()


def numbered(names: DataFrame) -> DataFrame:
    """``(entity, id)``: the distinct names numbered from 0 in their order, so that the least of some ids is that of the least name.

    Ranges are sorted apart; only their sizes, a row each, come together.
    """
    rows = names.select("entity").distinct().repartitionByRange("entity").sortWithinPartitions("entity")
    placed = cut(rows.withColumn("at", F.monotonically_increasing_id()))
    part, before = F.shiftright("at", 33), F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.withColumn("part", part).join(sizes, "part").select(
        "entity", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).cast("int").alias("id")
    )


@dataclass
class Spread:
    """Edges laid out once for many rounds: hash-partitioned by (src, salt), with a
    hub's edges over several salts and ``p`` the share of each edge in its source."""

    edges: DataFrame
    hot: DataFrame

    def send(self, state: DataFrame) -> DataFrame:
        """Rows of ``state`` (keyed by ``src``) joined to the edges that leave them."""
        return copy_per_salt(state, self.hot, "src").join(self.edges, ["src", "salt"]).drop("salt")


def lay_out(edges: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> Spread:
    e = weighted(edges)
    out = cut(e.groupBy("src").agg(F.count("*").alias("n"), F.sum("weight").alias("total")))
    hot = cut(hot_keys(out, "src", "n", rows_per_task))
    salted = add_salt(e, hot, "src", F.xxhash64("dst")).repartition("src", "salt")
    share = copy_per_salt(out.select("src", "total"), hot, "src")
    laid = salted.join(share, ["src", "salt"]).select(
        "src", "salt", "dst", "weight", (F.col("weight") / F.col("total")).alias("p")
    )
    return Spread(pin(laid), hot)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(node, component)``, the component named by its least node.

    Alternating large-star and small-star steps (Kiveris et al. 2014), on minima
    that are partially aggregated before the shuffle, until a round changes nothing. ``nodes``
    (column ``node``) adds isolated nodes. A round's tables go when the next one is written.
    """
    every = endpoints(edges)
    if nodes is not None:
        every = every.union(nodes.select("node")).distinct()
    pairs = cut(
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    mark = _fingerprint(pairs)
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        discard(pairs)
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(moved.union(lower).distinct())
        discard(large)
        new = _fingerprint(pairs)
        if new == mark:
            break
        mark = new
    return every.join(pairs.select(F.col("u").alias("node"), "v"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )


def components_of_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``components`` of links that hold both directions, for ``nodes`` that may be sent to all tasks: ``(node, component)``.

    Each round a node looks for the least label next to it, and a label moves to the least one that any of its nodes found, then on along
    the labels that moved (hooking and jumping, Shiloach & Vishkin 1982). The links stay where they lie, if they are bucketed by ``src``; a
    label with a smaller one next to it goes, so at least half of those that do not stand alone are gone with each round.
    """
    state = cut(nodes.select("node", F.col("node").alias("component")).distinct())
    e = links.select("src", "dst")
    while True:
        near = e.join(held(state).withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("least"))
        moved = state.join(near, "node").groupBy("component").agg(F.min("least").alias("to")).where("to < component")
        moved = cut(moved)
        if moved.isEmpty():
            return state
        while True:
            on = moved.select(F.col("component").alias("to"), F.col("to").alias("next"))
            jumped = cut(moved.join(on, "to", "left").select("component", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("far")))
            moved = jumped.select("component", "to")
            if jumped.where("far").isEmpty():
                break
        state = cut(state.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")))


def _fingerprint(pairs: DataFrame):
    return pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


#: Questions that share a mask of bits in a row, and masks in a row.
MASK, MASKS = 62, 4


def mask_columns(name: str = "mask") -> list[str]:
    return [f"{name}{i}" for i in range(MASKS)]


def masks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, block, mask0, ...)`` of rows ``(q_id, node)``, a bit for each of ``MASK`` times ``MASKS`` questions in a block, and the
    questions ``(q_id, block, bit)``. A step over the edges then carries a few numbers for all questions of a block."""
    ids = numbered(rows.select(F.col("q_id").alias("entity")))
    wide = MASK * MASKS
    asked = cut(ids.select(F.col("entity").alias("q_id"), F.floor(F.col("id") / wide).cast("int").alias("block"), (F.col("id") % wide).alias("bit")))
    bit = F.expr(f"shiftleft(1L, bit % {MASK})")
    sums = [F.bit_or(F.when(F.floor(F.col("bit") / MASK) == i, bit).otherwise(F.lit(0).cast("long"))).alias(c) for i, c in enumerate(mask_columns())]
    return rows.join(asked, "q_id").groupBy("node", "block").agg(*sums), asked


def any_mask() -> Column:
    """Whether a row has a question at all."""
    return functools.reduce(Column.__or__, [F.col(c) != 0 for c in mask_columns()])


def unmasked(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` ``(block, mask0, ...)`` as a row with ``q_id`` for each bit of the masks."""
    # A block's bits are numbered from 0, so its questions are a list in their order.
    names = asked.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bit", "q_id")))["q_id"].alias("_asked"))
    bits = [F.expr(f"transform(filter(sequence(0, {MASK - 1}), b -> (shiftright({c}, b) & 1L) = 1L), b -> b + {i * MASK})") for i, c in enumerate(mask_columns())]
    out = rows.withColumn("bit", F.explode(F.concat(*bits))).drop(*mask_columns())
    return out.join(F.broadcast(names), "block").withColumn("q_id", F.get("_asked", F.col("bit"))).drop("block", "bit", "_asked")


def hop_masks(edges: DataFrame, start: DataFrame, k: int, both: bool = False) -> DataFrame:
    """``(node, block, mask0, ..., hop)``: the questions that first reach a node with ``hop``, from ``masks``.

    Where the edges hold ``both`` directions, a node asks those it has an edge to; so nothing is shuffled but the nodes reached, if
    the edges are bucketed by ``src`` and the frontier is small enough for all tasks.
    """
    at, to = ("dst", "src") if both else ("src", "dst")
    mine = mask_columns()
    frontier = reached = cut(start.withColumn("hop", F.lit(0)))
    step = edges.select("src", "dst")
    for hop in range(1, k + 1):
        asked = held(frontier) if both else frontier
        moved = step.join(asked, F.col("node") == F.col(at)).groupBy(F.col(to).alias("node"), "block").agg(*[F.bit_or(c).alias(f"moved_{c}") for c in mine])
        known = reached.groupBy("node", "block").agg(*[F.bit_or(c).alias(f"known_{c}") for c in mine])
        new = [F.col(f"moved_{c}").bitwiseAND(F.bitwise_not(F.coalesce(f"known_{c}", F.lit(0).cast("long")))).alias(c) for c in mine]
        frontier = cut(moved.join(known, ["node", "block"], "left").select("node", "block", *new, F.lit(hop).alias("hop")).where(any_mask()))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def k_hop(edges: DataFrame, seeds: DataFrame, k: int, both: bool = False) -> DataFrame:
    """``(q_id, node, hop)``: nodes within ``k`` hops of each question's seeds, with the least hop. ``both`` says that the edges hold both directions."""
    start, asked = masks(seeds)
    return unmasked(hop_masks(edges, start, k, both), asked).select("q_id", "node", "hop")


def paths(edges: DataFrame, pairs: DataFrame, max_len: int) -> DataFrame:
    """``(src, dst, hops, path)``: the shortest path of each pair, least in node order on ties.

    One breadth-first search per distinct start. Before a frontier moves on, it meets the edges into the targets; a start
    whose targets are all met goes no further, so the widest frontier of a search is not made for a target next to the one before.
    """
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    wanted = cut(pairs.select("src", "dst").distinct())
    targets = cut(wanted.select("dst").distinct())
    last = cut(edges.join(held(targets), "dst", "left_semi").select(F.col("src").alias("node"), "dst"))
    frontier = reached = cut(wanted.select("src").distinct().select("src", F.col("src").alias("node"), F.array("src").alias("path")))
    met = cut(wanted.where("src = dst").select("src", "dst", F.array("src").alias("path")))
    found = [met]
    for hop in range(max_len):
        wanted = cut(wanted.join(met, ["src", "dst"], "left_anti"))
        if wanted.isEmpty():
            break
        if hop:
            frontier = cut(
                frontier.join(wanted.select("src").distinct(), "src", "left_semi")
                .join(step, "node")
                .select("src", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
                .groupBy("src", "node")
                .agg(F.min("path").alias("path"))
                .join(reached.select("src", "node"), ["src", "node"], "left_anti")
            )
            reached = reached.unionByName(frontier)
        ends = wanted.join(last, "dst").join(frontier, ["src", "node"])
        met = cut(ends.groupBy("src", "dst").agg(F.min(F.concat("path", F.array("dst"))).alias("path")))
        found.append(met)
    return functools.reduce(DataFrame.unionByName, found).select("src", "dst", (F.size("path") - 1).alias("hops"), "path")


def communities(edges: DataFrame, rounds: int = 3, once: bool = False) -> DataFrame:
    """``(node, community)`` by synchronous weighted label propagation (Raghavan et
    al. 2007), the least label on ties. ``edges`` hold both directions with the same weight.

    So the votes for a node come over the edges that leave it. A state of up to ``HELD_NODES`` nodes is sent to all
    tasks, and the votes are summed up where the edges lie, without a shuffle if these are bucketed by ``src``. If each edge is given ``once``,
    the votes of the first round, in which all labels differ, are the edges and not summed.
    """
    e = weighted(edges)
    state = cut(edges.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")))
    for k in range(rounds):
        if once and not k:
            sums = e.select("src", F.col("dst").alias("community"), F.col("weight").alias("w"))
        else:
            sums = e.join(held(state).withColumnRenamed("node", "dst"), "dst").groupBy("src", "community").agg(F.sum("weight").alias("w"))
        votes = sums.groupBy(F.col("src").alias("node")).agg(F.min(F.struct((-F.round("w", 9)).alias("w"), F.col("community"))).alias("best"))
        state = cut(
            state.withColumnRenamed("community", "old")
            .join(votes, "node", "left")
            .select("node", F.coalesce("best.community", "old").alias("community"))
        )
    return state


def contract(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """``(src, dst, weight)`` between communities; a self-loop holds the weight inside."""
    of = held(membership.select("node", "community"))
    return (
        weighted(edges)
        .join(of.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src")
        .join(of.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst")
        .groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst"))
        .agg(F.sum("weight").alias("weight"))
    )


def hierarchy(edges: DataFrame, levels: int = 2, rounds: int = 3, once: bool = False) -> DataFrame:
    """``(node, level, community)``: label propagation, then the same on the contracted
    graph. Stops early when a level does not shrink."""
    e = edges
    step = communities(e, rounds, once)
    top, size = step, step.select("community").distinct().count()
    out = top.select("node", F.lit(0).alias("level"), "community")
    for level in range(1, levels):
        e = cut(contract(e, step).where("src <> dst"))
        if e.isEmpty():
            break
        step = communities(e, rounds, once=True)
        up = step.select(F.col("node").alias("community"), F.col("community").alias("up"))
        top = cut(top.join(up, "community", "left").select("node", F.coalesce("up", "community").alias("community")))
        shrunk = top.select("community").distinct().count()
        if shrunk >= size:
            break
        size = shrunk
        out = out.unionByName(top.select("node", F.lit(level).alias("level"), "community"))
    return out


def pagerank(edges: DataFrame, rounds: int = 5, d: float = 0.85, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``(node, rank)`` (Page et al. 1999); the mass of nodes without out-edges goes to all."""
    spread = lay_out(edges, rows_per_task)
    sources = edges.select(F.col("src").alias("node")).distinct().withColumn("out", F.lit(True))
    nodes = cut(endpoints(edges).join(sources, "node", "left").select("node", F.col("out").isNull().alias("sink")))
    n = nodes.count()
    sinks = not nodes.where("sink").isEmpty()
    state = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds):
        lost = state.where("sink").agg(F.sum("rank")).first()[0] if sinks else 0.0
        got = (
            spread.send(state.select(F.col("node").alias("src"), "rank"))
            .groupBy(F.col("dst").alias("node"))
            .agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        )
        state = cut(
            state.join(got, "node", "left").select(
                "node",
                "sink",
                (F.lit((1 - d) / n) + d * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n))).alias("rank"),
            )
        )
    return state.select("node", "rank")


def batch(rows: DataFrame, nodes: int = 0, values: int = blocks.VALUES) -> blocks.Batch:
    """The questions of ``rows``, numbered for arrays of a value each; ``values`` of a block of them may be sent to all tasks, one for each of the ``nodes``."""
    return blocks.batch(numbered(rows.select(F.col("q_id").alias("entity"))).withColumnRenamed("entity", "q_id"), nodes, values)


def ppr_blocks(
    edges: DataFrame,
    seeds: DataFrame,
    questions: blocks.Batch,
    rounds: int = 3,
    d: float = 0.85,
    floor: float = 0.0,
    both: bool = False,
) -> Iterator[DataFrame]:
    """``ppr`` as columns ``(node, m0, ...)`` of the masses of the questions of a block, block by block; zero stands for none.

    A node asks those it has a link to for their shares. Where the links hold ``both`` directions and are bucketed by ``src``, they stay where they
    lie, and only a row a node is shuffled in a round.
    """
    total = seeds.groupBy("q_id").agg(F.sum("w").alias("total"))
    scaled = seeds.join(total, "q_id").select("q_id", "node", (F.col("w") / F.col("total")).alias("mass"))
    start, names = cut(blocks.dense(scaled, questions)), questions.columns
    e = weighted(edges)
    out = cut(e.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("total")))
    at, to = ("dst", "src") if both else ("src", "dst")
    small = held(out)
    for block in range(questions.blocks):
        state = first = cut(questions.of_block(start, block))
        restart = first.select("node", *[(F.col(c) * (1 - d)).alias(c) for c in names])
        for _ in range(rounds):
            shares = state.join(small, "node").select("node", *[(F.col(c) * (d / F.col("total"))).alias(c) for c in names])
            got = blocks.summed(e, to, at, F.broadcast(shares) if small is not out else shares, questions).withColumnRenamed(to, "node")
            sums = got.unionByName(restart).groupBy("node").agg(*[F.sum(c).alias(c) for c in names])
            if floor:
                sums = sums.select("node", *[F.when(F.col(c) >= floor, F.col(c)).otherwise(0.0).alias(c) for c in names])
            new = cut(sums)
            if state is not first:
                discard(state)
            state = new
        yield state


def ppr(
    edges: DataFrame,
    seeds: DataFrame,
    rounds: int = 3,
    d: float = 0.85,
    floor: float = 0.0,
    rows_per_task: int = blocks.VALUES,
    names: DataFrame | None = None,
    both: bool = False,
) -> DataFrame:
    """``(q_id, node, mass)``: personalised PageRank (Haveliwala 2002) of every question
    in the same jobs. ``seeds`` are ``(q_id, node, w)``; weights are scaled to sum to one.
    A ``floor`` above zero drops smaller masses between rounds, as an approximation. Nodes without mass have no row.

    ``rows_per_task`` masses are sent to all tasks at a time. Nodes are ids of ``names`` ``(entity, id)`` if given, and get their names before
    they are copied to their questions. ``both`` says that the edges hold both directions.
    """
    nodes = edges.select(F.col("src" if both else "dst").alias("node")).distinct().count()
    questions = batch(seeds, nodes, rows_per_task)
    found = [questions.arrays(state, block) for block, state in enumerate(ppr_blocks(edges, seeds, questions, rounds, d, floor, both))]
    if not found:
        return seeds.select("q_id", "node", F.col("w").cast("double").alias("mass")).limit(0)
    out = functools.reduce(DataFrame.unionByName, found)
    if names is not None:
        out = out.join(held(names.select(F.col("id").alias("node"), "entity")), "node").select(F.col("entity").alias("node"), "block", "mass")
    return blocks.rows_of(out, questions)


#: Neighbours in one row of an adjacency table; a hub has several rows.
LIST = 4096


def adjacency(edges: DataFrame) -> DataFrame:
    """``(src, part, parts, weight, next)``: the neighbours of a node as lists ``next`` of ``(dst, w)`` with the weights of the edges, and the
    out-weight ``weight`` of the node. A node with many neighbours has ``parts`` rows of about ``LIST``.

    A search that starts from few nodes then meets one row a node and unfolds only the lists it needs.
    """
    e = weighted(edges)
    out = cut(e.groupBy("src").agg(F.ceil(F.count("*") / F.lit(LIST)).cast("int").alias("parts"), F.sum("weight").alias("total")))
    placed = e.join(held(out), "src").withColumn("part", F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int"))
    lists = F.collect_list(F.struct("dst", F.col("weight").alias("w")))
    return placed.groupBy("src", "part", "parts", F.col("total").alias("weight")).agg(lists.alias("next"))


def push_ppr(graph: DataFrame, seeds: DataFrame, d: float = 0.5, eps: float = 1e-5, max_rounds: int = 100) -> DataFrame:
    """``(q_id, node, mass)``: personalised PageRank by forward push (Andersen, Chung, Lang 2006), all questions at once.
    ``graph`` is an ``adjacency`` table, ``seeds`` are ``(q_id, node, w)``.

    Every question has residuals, at first its seeds' weights scaled to one. A round pushes all nodes whose residual is at least
    ``eps`` times their out-weight: the share 1 - d stays as mass, the rest goes to the neighbours. It ends when
    no such node is left; then 1 - d of each residual left is counted as mass too. Masses are never too high. If the edges go both
    ways, the mass of a node falls short by at most ``eps`` times its weight, and a question pushes over edges of total weight
    1 / ((1 - d) eps) at most, however large the graph: only the surroundings of the seeds are unfolded. Of the mass sent into a node
    without out-edges, 1 - d stays there and the rest is lost, as in ``ppr``.
    """
    facts = cut(graph.groupBy(F.col("src").alias("node")).agg(F.max("weight").alias("weight"), F.max("parts").alias("parts")))

    def known(rows: DataFrame) -> DataFrame:
        return rows.join(facts, "node", "left").select(
            "q_id", "node", "mass", "left", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("parts", F.lit(0)).alias("parts")
        )

    total = seeds.groupBy("q_id").agg(F.sum("w").alias("total"))
    start = seeds.groupBy("q_id", "node").agg(F.sum("w").alias("w")).join(total, "q_id")
    state = cut(known(start.select("q_id", "node", F.lit(0.0).alias("mass"), (F.col("w") / F.col("total")).alias("left"))))
    # The rounding lets two engines agree on residuals that meet the bound exactly.
    due = (F.col("left") > 0) & (F.round("left", 12) >= F.round(F.col("weight") * eps, 12))
    for _ in range(max_rounds):
        if state.where(due).isEmpty():
            break
        asked = state.where(due & (F.col("parts") > 0)).select(
            "q_id", F.col("node").alias("src"), "left", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        )
        sent = asked.join(graph.select("src", "part", "weight", "next"), ["src", "part"]).select("q_id", "left", "weight", F.explode("next").alias("e"))
        kept = state.select(
            "q_id",
            "node",
            F.when(due, F.col("mass") + (1 - d) * F.col("left")).otherwise(F.col("mass")).alias("mass"),
            F.when(due, 0.0).otherwise(F.col("left")).alias("left"),
        )
        moved = sent.select("q_id", F.col("e.dst").alias("node"), F.lit(0.0).alias("mass"), (F.col("left") * (F.col("e.w") / F.col("weight")) * d).alias("left"))
        new = cut(known(kept.union(moved).groupBy("q_id", "node").agg(F.sum("mass").alias("mass"), F.sum("left").alias("left"))))
        discard(state)
        state = new
    else:
        raise RuntimeError(f"residuals above the bound after {max_rounds} rounds")
    return state.select("q_id", "node", (F.col("mass") + (1 - d) * F.col("left")).alias("mass"))


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """Edges (both directions) of the ``k``-core: all nodes keep ``k`` neighbours or more.

    Degrees are counted once; a round takes out the nodes that fell under ``k`` and lowers the counts of their
    neighbours, so a long chain costs its edge nodes and not the graph.
    """
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    degree = cut(e.groupBy("src").agg(F.count("*").alias("n")).withColumnRenamed("src", "node"))
    while True:
        low = cut(degree.where(F.col("n") < k).select("node"))
        if low.isEmpty():
            break
        # A node that is out already is not in ``degree``, so its count is not lowered again.
        lost = e.join(low.withColumnRenamed("node", "src"), "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("lost"))
        left = cut(
            degree.join(low, "node", "left_anti").join(lost, "node", "left").select("node", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("n"))
        )
        discard(degree)
        degree = left
    inside = degree.select("node")
    return e.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
