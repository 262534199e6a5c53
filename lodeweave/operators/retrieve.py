"""Lexical retrieval, fusion and graph retrieval for batches of questions.

Questions are ``(q_id, text)``; hits are ``(q_id, chunk_id, score, rank, via)``.
Ranks go by the score rounded to ``SCORE_DIGITS`` and then by chunk id, so they do not depend
on the order of a sum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodeweave.functions import text as tx
from lodeweave.operators import blocks
from lodeweave.operators.best import SCORE_DIGITS, Best
from lodeweave.operators.held import held
from lodeweave.operators.iterate import MASK, MASKS, adjacency, batch, hop_masks, masks, ppr_blocks, push_ppr
from lodeweave.operators.skew import ROWS_PER_TASK, add_salt, hot_keys, salted_join
from lodeweave.session import cut

#: Weights of a batch of questions, terms times questions, that every task may hold, and scores that it makes at a time.
CELLS = 4_000_000


def top_k(scored: DataFrame, k: int, via: str, ties: str = "chunk_id") -> DataFrame:
    """The best ``k`` per question. The rank filter is applied before the shuffle too
    (window group limit), so a question with many candidates sends ``k`` rows per task."""
    order = W.partitionBy("q_id").orderBy(F.col("score").desc(), F.col(ties))
    return (
        scored.select("q_id", ties, F.round("score", SCORE_DIGITS).alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .withColumn("via", F.lit(via))
    )


def question_terms(questions: DataFrame) -> DataFrame:
    """Distinct ``(q_id, term)``; questions given as such terms pass through."""
    if "term" in questions.columns:
        return questions.select("q_id", "term")
    return questions.select("q_id", F.explode(F.array_distinct(tx.terms("text"))).alias("term"))


def postings(chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """``(term, chunk_id, tf, dl)``; the chunk length rides along and saves a join.

    Terms are counted inside the row, as numbers of a batch of rows, so a corpus turns into postings without a shuffle.
    """
    return row_counts(chunks.select(id_col, tx.terms("text").alias("t")), id_col)


def row_counts(rows: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """``(term, chunk_id, tf, dl)`` of rows ``(chunk_id, t)`` of lists of strings."""
    return rows.mapInArrow(_counted(id_col), f"term string, {id_col} {dict(rows.dtypes)[id_col]}, tf bigint, dl int")


def _counted(id_col: str):
    """Rows ``(id, t)`` of terms as counts of the distinct terms of each row; a null ``t`` has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.fill_null(pc.list_value_length(batch["t"]), 0).to_numpy()
            coded = batch["t"].flatten().dictionary_encode()
            size = max(len(coded.dictionary), 1)
            keys, tf = np.unique(np.repeat(np.arange(len(batch)), n) * size + coded.indices.to_numpy(), return_counts=True)
            row, term = np.divmod(keys, size)
            columns = [coded.dictionary.take(pa.array(term)), batch[id_col].take(pa.array(row)), pa.array(tf.astype(np.int64)), pa.array(n[row].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["term", id_col, "tf", "dl"])

    return run


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row ``(n, avgdl)``."""
    return chunks.agg(F.count("*").alias("n"), F.avg(F.size(tx.terms("text"))).alias("avgdl"))


def asked_terms(questions: DataFrame, post: DataFrame, rarity: DataFrame | None = None) -> DataFrame:
    """``(q_id, term, df)`` of the question terms that occur, checkpointed: the table is as
    small as the questions and both the salt and the join read it.

    Without the index's ``rarity`` table the frequencies are counted over the postings of these terms.
    """
    terms = question_terms(questions)
    if rarity is None:
        rows = post.select("term").join(terms.select("term").distinct(), "term", "left_semi")
        rarity = rows.groupBy("term").agg(F.count("*").alias("df"))
    return cut(terms.join(rarity, "term").select("q_id", "term", "df"))


def term_rows(asked: DataFrame, post: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Postings joined to the question terms; a term held by many chunks is split over tasks.

    The salts of a question term follow from its ``df``, so the asked side stays a scan of a small table whose
    size Spark knows. Where it is small enough to send to all tasks, postings bucketed by chunk stay where they
    are, and so do the sums per question and chunk.
    """
    hot = hot_keys(asked.select("term", "df").distinct(), "term", "df", rows_per_task)
    salts = F.sequence(F.lit(0), F.ceil(F.col("df") / F.lit(rows_per_task)).cast("int") - 1)
    spread = asked.withColumn("salt", F.explode(salts))
    return add_salt(post, hot, "term", F.xxhash64("chunk_id")).join(spread, ["term", "salt"]).drop("salt")


def held_weights(asked: DataFrame, cells: int) -> pd.DataFrame | None:
    """``asked`` ``(q_id, term, df, qw)`` on the driver, if terms times questions are at most ``cells``; else None."""
    size = asked.agg(F.count_distinct("q_id").alias("q"), F.count_distinct("term").alias("t")).first()
    return asked.toPandas() if size["q"] * size["t"] <= cells else None


def best_in_blocks(rows: DataFrame, asked: DataFrame, held: pd.DataFrame, k: int, via: str, norms: DataFrame | None = None) -> DataFrame:
    """Best ``k`` chunks per question by the sum of ``w`` times ``qw`` over the terms that chunk and question share, divided by
    the chunk's ``norm`` if ``norms`` are given.

    ``rows`` are ``(term, chunk_id, w)``. The terms of a chunk come together in a row, which a window bounds, where the postings lie in buckets by
    chunk; a task then scores all questions of the batch for some chunks at a time as arrays, so no pair of question and chunk is a row.
    """
    at, terms = pd.factorize(held["term"])
    of, questions = pd.factorize(held["q_id"])
    weight = np.zeros((len(terms), len(questions)))
    weight[at, of] = held["qw"].to_numpy(float)
    kinds = {**dict(asked.dtypes), **dict(rows.dtypes)}
    known = rows.sparkSession.createDataFrame([(t, i) for i, t in enumerate(terms.tolist())], "term string, tid int")
    sets = rows.join(F.broadcast(known), "term").groupBy("chunk_id").agg(F.collect_list(F.struct("tid", "w")).alias("ts"))
    normed = norms is not None
    if normed:
        sets = sets.join(norms.select("chunk_id", "norm"), "chunk_id")
    names = pa.array(questions.tolist())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.take(pc.sort_indices(batch["chunk_id"]))
            ts = batch["ts"]
            ends = ts.offsets.to_numpy()
            tid, w = (ts.values.field(c).to_numpy() for c in ("tid", "w"))
            best, step = Best(len(questions), min(k, len(batch))), max(1, CELLS // max(len(questions), 1))
            every, first = np.arange(len(questions)), 0
            while first < len(batch):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + step, side="right")) - 1)
                mine = slice(ends[first], ends[last])
                s = np.add.reduceat(weight[tid[mine]] * w[mine, None], ends[first:last] - ends[first], axis=0)
                if normed:
                    s /= batch["norm"].to_numpy()[first:last, None]
                best.offer(every, np.arange(first, last), np.where(s > 0, s, -np.inf).T)
                first = last
            r, c = np.nonzero(best.score > -np.inf)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(r)), batch["chunk_id"].take(pa.array(best.at[r, c])), pa.array(best.score[r, c])], ["q_id", "chunk_id", "score"])

    return top_k(sets.mapInArrow(find, f"q_id {kinds['q_id']}, chunk_id {kinds['chunk_id']}, score double"), k, via)


def bm25(
    questions: DataFrame,
    post: DataFrame,
    stats: DataFrame,
    k: int = 10,
    k1: float = 1.2,
    b: float = 0.75,
    rarity: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    cells: int = CELLS,
) -> DataFrame:
    """Best ``k`` chunks per question (Robertson & Zaragoza 2009). A batch whose weights pass ``cells`` is joined on its terms."""
    n = stats.select("n").scalar()
    avgdl = stats.select("avgdl").scalar()
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    asked = asked_terms(questions, post, rarity)
    held = held_weights(asked.withColumn("qw", idf), cells)
    if held is not None:
        return best_in_blocks(post.select("term", "chunk_id", tf.alias("w")), asked, held, k, "bm25")
    scored = (
        term_rows(asked, post, rows_per_task)
        .groupBy("q_id", "chunk_id")
        .agg(F.sum(idf * tf).alias("score"))
    )
    return top_k(scored, k, "bm25")


def weights(post: DataFrame, stats: DataFrame, rarity: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``(term, chunk_id, w)`` tf-idf weights of a whole corpus."""
    n = stats.select("n").scalar()
    rows = salted_join(post, rarity, "term", hot_keys(rarity, "term", "df", rows_per_task), F.xxhash64("chunk_id"))
    return rows.select("term", "chunk_id", ((1 + F.ln("tf")) * F.ln(1 + n / F.col("df"))).alias("w"))


#: Terms with their frequency that are sent to all tasks, the most frequent ones.
HELD_TERMS = 2_000_000


def chunk_norms(post: DataFrame, stats: DataFrame, rarity: DataFrame, terms: int = HELD_TERMS) -> DataFrame:
    """``(chunk_id, norm)``: lengths of the tf-idf vectors, worth keeping next to an index.

    The ``terms`` most frequent terms or fewer are sent to the postings, whose squares are summed where they lie. Only postings of seldom terms,
    a small share of all, are shuffled to theirs.
    """
    n = stats.select("n").scalar()
    least = 0
    while rarity.where(F.col("df") > least).count() > terms:
        least = 2 * least + 1
    often, seldom = F.broadcast(rarity.where(F.col("df") > least)), rarity.where(F.col("df") <= least)

    def squares(rows: DataFrame) -> DataFrame:
        w = (1 + F.ln("tf")) * F.ln(1 + n / F.col("df"))
        return rows.groupBy("chunk_id").agg(F.sum(w * w).alias("s"))

    sums = squares(post.join(often, "term"))
    if least:
        rest = squares(post.join(often, "term", "left_anti").join(seldom, "term"))
        sums = sums.unionByName(rest).groupBy("chunk_id").agg(F.sum("s").alias("s"))
    return sums.select("chunk_id", F.sqrt("s").alias("norm"))


def tfidf(
    questions: DataFrame,
    post: DataFrame,
    stats: DataFrame,
    k: int = 10,
    rarity: DataFrame | None = None,
    norms: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    cells: int = CELLS,
) -> DataFrame:
    """Best ``k`` chunks per question by tf-idf cosine. A batch whose weights pass ``cells`` is joined on its terms."""
    if rarity is None:
        rarity = post.groupBy("term").agg(F.count("*").alias("df"))
    if norms is None:
        norms = chunk_norms(post, stats, cut(rarity))
    n = stats.select("n").scalar()
    asked = cut(
        questions.select("q_id", F.explode(tx.terms("text")).alias("term"))
        .groupBy("q_id", "term")
        .agg(F.count("*").alias("qf"))
        .join(rarity, "term")
        .select("q_id", "term", "df", ((1 + F.ln("qf")) * F.ln(1 + n / F.col("df"))).alias("qw"))
    )
    q_norm = asked.groupBy("q_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    weighed = asked.join(q_norm, "q_id").select("q_id", "term", "df", (F.col("qw") * F.ln(1 + n / F.col("df")) / F.col("qn")).alias("qw"))
    held = held_weights(weighed, cells)
    if held is not None:
        return best_in_blocks(post.select("term", "chunk_id", (1 + F.ln("tf")).alias("w")), asked, held, k, "tfidf", norms)
    dots = (
        term_rows(asked, post, rows_per_task)
        .groupBy("q_id", "chunk_id")
        .agg(F.sum(F.col("qw") * (1 + F.ln("tf")) * F.ln(1 + n / F.col("df"))).alias("dot"))
    )
    scored = (
        dots.join(norms, "chunk_id")
        .join(q_norm, "q_id")
        .select("q_id", "chunk_id", (F.col("dot") / (F.col("norm") * F.col("qn"))).alias("score"))
    )
    return top_k(scored, k, "tfidf")


def fuse(lists: Sequence[DataFrame], k: int = 10, c: int = 60, ties: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion (Cormack et al. 2009); ``via`` names the lists a hit came from."""
    rows = lists[0].select("q_id", ties, "rank", "via")
    for one in lists[1:]:
        rows = rows.unionByName(one.select("q_id", ties, "rank", "via"))
    scored = rows.groupBy("q_id", ties).agg(
        F.round(F.sum(1.0 / (c + F.col("rank"))), SCORE_DIGITS).alias("score"),
        F.array_join(F.array_sort(F.collect_set("via")), "+").alias("via"),
    )
    order = W.partitionBy("q_id").orderBy(F.col("score").desc(), F.col(ties))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def filtered(chunks: DataFrame, predicate: Column) -> DataFrame:
    """Chunks that may be ranked at all: the predicate applies before any scoring."""
    return chunks.where(predicate)


def within(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Stored postings or vectors of ``chunks`` only, to be searched like those of all chunks."""
    return rows.join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def hash_embed(
    df: DataFrame,
    rarity: DataFrame,
    n: Column,
    id_col: str = "chunk_id",
    dim: int = 64,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``(id, embedding)``: tf-idf weights summed into ``dim`` md5 buckets, unit norm.

    ``rarity`` is ``(term, df)`` of the corpus, ``n`` its size. Questions and chunks
    embedded with the same rarity can be compared. Terms unknown to the corpus have
    no weight; a row without known terms gets no vector. ``df`` holds texts or, with ``tf``, their ``postings``.

    The weights go to their row once and are summed there; tasks grow in number with the rows, so the sums that one holds do not grow.
    """
    counted = "tf" in df.columns
    tf = (df if counted else postings(df, id_col)).select(id_col, "term", "tf")
    hot = hot_keys(rarity, "term", "df", rows_per_task)
    bucket = (F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("bigint") % dim).cast("int")
    known = rarity.select("term", "df", bucket.alias("b"), F.ln(1 + n / F.col("df")).alias("idf"))
    per_task = rows_per_task if counted else max(1, rows_per_task // dim)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / per_task))
    rows = salted_join(tf, known, "term", hot, F.xxhash64(id_col)).select(id_col, "b", ((1 + F.ln("tf")) * F.col("idf")).alias("w"))
    kind = dict(df.dtypes)[id_col]
    return rows.repartition(tasks, id_col).sortWithinPartitions(id_col).mapInArrow(_summed(id_col, dim), f"{id_col} {kind}, embedding array<double>")


def _summed(id_col: str, dim: int):
    """Unit vectors from rows ``(id, b, w)`` sorted by id; the sums of the last id go on in the next batch."""

    def out(ids: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
        sums = sums / np.sqrt(np.square(sums).sum(axis=1, keepdims=True))
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dim), pa.array(sums.ravel()))
        return pa.RecordBatch.from_arrays([ids, vectors], names=[id_col, "embedding"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            if not len(batch):
                continue
            coded = batch[id_col].dictionary_encode(null_encoding="encode")
            ids, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64) * dim + batch["b"].to_numpy()
            sums = np.bincount(at, batch["w"].to_numpy(), len(ids) * dim).reshape(-1, dim)
            if last is not None:
                if last[0] == ids[0]:
                    sums[0] += held[0]
                else:
                    yield out(last, held)
            yield out(ids[:-1], sums[:-1])
            last, held = ids[-1:], sums[-1:]
        if last is not None:
            yield out(last, held)

    return run


def term_rarity(chunks: DataFrame) -> DataFrame:
    """``(term, df)`` with each chunk's distinct terms counted inside its row."""
    return (
        chunks.select(F.explode(F.array_distinct(tx.terms("text"))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )


def expand(hits: DataFrame, chunks: DataFrame, n: int = 1) -> DataFrame:
    """Each hit's chunk with ``n`` neighbours before and after it in its document:
    ``(q_id, rank, chunk_id, near_id, offset, text)``.

    The neighbours' keys are computed from the hit, so the chunk table is joined once on its id.
    """
    part = F.split("chunk_id", ":")
    near = hits.select(
        "q_id",
        "rank",
        "chunk_id",
        part[0].alias("doc"),
        part[1].cast("int").alias("no"),
        F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("offset"),
    ).select(
        "q_id",
        "rank",
        "chunk_id",
        "offset",
        F.concat_ws(":", "doc", (F.col("no") + F.col("offset")).cast("string")).alias("near_id"),
    )
    return near.join(chunks.select(F.col("chunk_id").alias("near_id"), "text"), "near_id")


def whole_parent(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """The document of each hit: ``(q_id, doc_id, rank, text)`` with the best rank."""
    best = hits.groupBy("q_id", F.split("chunk_id", ":")[0].cast("bigint").alias("doc_id")).agg(
        F.min("rank").alias("rank")
    )
    return best.join(docs.select("doc_id", "text"), "doc_id")


def collapse(hits: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Best hit per document, or per cluster ``(doc_id, cluster)``, ranked anew."""
    rows = hits.withColumn("doc_id", F.split("chunk_id", ":")[0].cast("bigint"))
    if clusters is not None:
        rows = rows.join(clusters, "doc_id", "left").withColumn("unit", F.coalesce("cluster", "doc_id"))
    else:
        rows = rows.withColumn("unit", F.col("doc_id"))
    best = (
        rows.groupBy("q_id", "unit")
        .agg(F.min(F.struct("rank", "doc_id", "chunk_id", "score", "via")).alias("h"))
        .select("q_id", "unit", "h.*")
    )
    order = W.partitionBy("q_id").orderBy("rank")
    return best.withColumn("new_rank", F.row_number().over(order)).select(
        "q_id", "unit", "doc_id", "chunk_id", "score", F.col("new_rank").alias("rank"), "via"
    )


def question_entities(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """``(q_id, node)``: known entities among the question's terms."""
    known = entities.select(F.col("entity").alias("term")).distinct()
    return question_terms(questions).join(known, "term", "left_semi").select("q_id", F.col("term").alias("node"))


def seeds_and_mentions(questions: DataFrame, mention_weights: DataFrame, ids: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The entities ``(q_id, node)`` of the questions and the mentions ``(node, chunk_id, weight)``, by ``ids`` ``(entity, id)`` if given."""
    if ids is None:
        return cut(question_entities(questions, mention_weights)), mention_weights.select(F.col("entity").alias("node"), "chunk_id", "weight")
    known = ids.select("entity", "id")
    # The ids are those of all mentions, so they name the known entities.
    seeds = question_entities(questions, ids).join(known, F.col("node") == F.col("entity")).select("q_id", F.col("id").alias("node"))
    mentions = mention_weights if "id" in mention_weights.columns else mention_weights.join(held(known), "entity")
    return cut(seeds), mentions.select(F.col("id").alias("node"), "chunk_id", "weight")


def local_search(
    questions: DataFrame, edges: DataFrame, mention_weights: DataFrame, k: int = 10, hops: int = 1, ids: DataFrame | None = None
) -> DataFrame:
    """Question entities, their neighbourhood, and the chunks that mention it.

    A node ``h`` hops away counts 1/(1+h); a chunk's score is the sum over its
    entities of that times the tf-idf weight of the mention. ``edges`` hold both directions, by ``ids`` if given.
    """
    seeds, mentions = seeds_and_mentions(questions, mention_weights, ids)
    start, asked = masks(seeds)
    near = cut(hop_masks(edges, start, hops, both=True))
    wide = MASK * MASKS
    batched = blocks.batch(asked.select("q_id", (F.col("block") * wide + F.col("bit")).alias("id")), near.select("node").distinct().count())

    def counts(block: int) -> DataFrame:
        """The columns of a block, from the bits of its questions."""
        sums = []
        for j, c in enumerate(batched.columns):
            of, bit = divmod(block * batched.wide + j, wide)
            here = (F.col("block") == of) & (F.shiftright(f"mask{bit // MASK}", bit % MASK).bitwiseAND(F.lit(1).cast("long")) == 1)
            sums.append(F.max(F.when(here, 1.0 / (1 + F.col("hop"))).otherwise(0.0)).alias(c))
        return near.groupBy("node").agg(*sums)

    return top_k(blocks.best_chunks([counts(b) for b in range(batched.blocks)], batched, mentions, k), k, "local")


def ppr_search(
    questions: DataFrame,
    edges: DataFrame,
    mention_weights: DataFrame,
    k: int = 10,
    d: float = 0.5,
    eps: float | None = 1e-5,
    rounds: int = 3,
    graph: DataFrame | None = None,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Chunks by the personalised PageRank mass of the entities they mention, weighted
    by tf-idf (after Gutiérrez et al. 2024).

    Masses come from forward push with the bound ``eps`` over ``graph`` (``iterate.adjacency`` of the edges, worth keeping next to an
    index), or, where ``eps`` is None, from ``rounds`` of exact iteration, which reads the whole graph once a round for all questions.
    ``edges`` hold both directions; they and ``graph`` hold ``ids`` ``(entity, id)`` if given.
    """
    seeds, mentions = seeds_and_mentions(questions, mention_weights, ids)
    seeds = seeds.withColumn("w", F.lit(1.0))
    asked = batch(seeds, edges.select("src").distinct().count() if eps is None else 0)
    if eps is None:
        mass = list(ppr_blocks(edges, seeds, asked, rounds, d, both=True))
    else:
        mass = cut(blocks.dense(push_ppr(cut(adjacency(edges)) if graph is None else graph, seeds, d, eps), asked))
    return top_k(blocks.best_chunks(mass, asked, mentions, k), k, "ppr")


def global_search(questions: DataFrame, reports: DataFrame, terms: DataFrame, k: int = 3) -> DataFrame:
    """Rank community reports for each question and combine the best (the map and
    reduce shape of Edge et al. 2024, with no model).

    A report scores by BM25 over all its terms, ``terms`` ``(community, term, n)``. The result is one row per
    question with the best communities and their joined summaries. ``reports`` are ``(community, summary)``.
    """
    sizes = cut(terms.groupBy("community").agg(F.sum("n").alias("dl")))
    stats = sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    post = terms.join(sizes, "community").select("term", F.col("community").alias("chunk_id"), F.col("n").alias("tf"), "dl")
    best = bm25(questions, post, stats, k).withColumnRenamed("chunk_id", "community")
    return (
        best.join(reports.select("community", "summary"), "community")
        .groupBy("q_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "community", "score", "summary"))).alias("parts"))
        .select(
            "q_id",
            F.array_join(F.transform("parts", lambda p: p["community"]), ",").alias("communities"),
            F.element_at("parts", 1)["score"].alias("best_score"),
            F.array_join(F.transform("parts", lambda p: p["summary"]), "\n").alias("answer"),
        )
    )
