"""Answer a batch of questions over an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.operators import agent, context, retrieve, vectors
from lodeweave.plans.build import Index
from lodeweave.session import stored


#: Searches whose lists are fused for a route.
SEARCHES = {
    "text": ("bm25", "tfidf", "vector"),
    "local": ("bm25", "local", "ppr"),
    "global": ("bm25", "tfidf"),
    "vector": ("vector",),
}


def search(name: str, questions: DataFrame, index: Index, k: int, embedded: DataFrame | None = None) -> DataFrame:
    """Hits of one search. ``embedded`` ``(q_id, embedding)`` are the questions' vectors in the space of
    ``index["vectors"]``, by default those of their hashed terms."""
    if name == "bm25":
        return retrieve.bm25(questions, index["postings"], index["stats"], k, rarity=index["rarity"])
    if name == "tfidf":
        return retrieve.tfidf(questions, index["postings"], index["stats"], k, rarity=index["rarity"], norms=index["norms"])
    if name == "local":
        return retrieve.local_search(questions, index["links"], index["weights"], k, ids=index["names"])
    if name == "ppr":
        return retrieve.ppr_search(questions, index["links"], index["weights"], k, graph=index["near"], ids=index["names"])
    if embedded is None:
        embedded = retrieve.hash_embed(questions, index["rarity"], index["stats"].select("n").scalar(), "q_id")
    mine = embedded.join(questions.select("q_id"), "q_id", "left_semi")
    return vectors.ivf(mine, index["vectors"], k, id_col="chunk_id").withColumn("via", F.lit("vector"))


def retrieve_routed(questions: DataFrame, routed: DataFrame, index: Index, k: int = 10, embedded: DataFrame | None = None) -> DataFrame:
    """Each question searched as its route ``(q_id, route)`` says; a search runs once, for all routes that use it."""
    taken = {r["route"] for r in routed.select("route").distinct().collect()}  # at most one row a route
    lists = []
    for name in dict.fromkeys(s for route in SEARCHES for s in SEARCHES[route]):
        routes = [route for route in taken if name in SEARCHES[route]]
        if routes:
            mine = routed.where(F.col("route").isin(routes)).select("q_id")
            lists.append(search(name, stored(questions.join(mine, "q_id", "left_semi"), "questions"), index, k, embedded))
    return retrieve.fuse(lists, k)


def ask(
    questions: DataFrame,
    index: Index,
    k: int = 10,
    budget: int = 256,
    fn: Callable[[list[str]], list[str]] | None = None,
    cache: DataFrame | None = None,
    embedded: DataFrame | None = None,
) -> DataFrame:
    """``(q_id, route, prompt[, answer])`` for each question.

    The route decides which searches run; of each document only its best hit goes on. Questions of route
    ``global`` see the community reports in front of their passages.
    """
    routed = stored(agent.route(questions, index["rarity"], index["weights"]), "routes")
    if routed.isEmpty():
        hits = questions.sparkSession.createDataFrame([], "q_id long, chunk_id string, score double, rank int, via string")
    else:
        hits = stored(retrieve.collapse(retrieve_routed(questions, routed, index, k, embedded)), "hits")
    packed = context.pack(hits, index["chunks"], budget)
    prompts = context.render(packed, questions)
    out = routed.select("q_id", "route").join(prompts, "q_id")
    wide = retrieve.global_search(
        questions.join(routed.where("route = 'global'"), "q_id", "left_semi"), index["reports"], index["terms"]
    ).select("q_id", "answer")
    out = out.join(wide.withColumnRenamed("answer", "overview"), "q_id", "left").selectExpr(
        "q_id", "route", "CASE WHEN overview IS NULL THEN prompt ELSE concat(overview, '\\n', prompt) END AS prompt"
    )
    if fn is None:
        return out
    out = stored(out, "prompts")
    return out.join(context.answer(out, fn, cache).select("q_id", "answer"), "q_id")
