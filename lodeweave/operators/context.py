"""Context assembly: packing, citations, community reports, prompts, answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodeweave.functions import text as tx
from lodeweave.operators.held import HELD_NODES, held
from lodeweave.operators.retrieve import postings
from lodeweave.session import stored


def pack(hits: DataFrame, chunks: DataFrame, budget: int) -> DataFrame:
    """Best-ranked chunks until ``budget`` pieces are met. Hits are already top-k lists,
    so the window over a question is at most ``k`` rows."""
    sized = hits.join(chunks.select("chunk_id", "text"), "chunk_id").withColumn("n_pieces", F.size(tx.pieces("text")))
    used = F.sum("n_pieces").over(W.partitionBy("q_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return sized.withColumn("used", used).where(F.col("used") <= budget)


def cite(packed: DataFrame) -> DataFrame:
    """``(q_id, n_sources, citations)``, the citations as ``[rank] chunk (route)`` in rank order."""
    line = F.format_string("[%d] %s (%s)", F.col("rank"), F.col("chunk_id"), F.col("via"))
    return packed.groupBy("q_id").agg(
        F.count("*").alias("n_sources"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda c: c["line"]), "; "
        ).alias("citations"),
    )


#: Terms of chunks that a task adds up at a time.
TERMS = 1_000_000


def community_terms(membership: DataFrame, mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(community, term, n)``: all terms of the chunks that mention a community; an entity's ``mentions`` are the chunks it is a term of.

    Stored memberships of up to ``HELD_NODES`` nodes are sent to the terms of the chunks, which meet the communities of their chunk
    where they are counted, and only sums by community and term are shuffled. More are joined by chunk.
    """
    of = membership.select(F.col("node").alias("entity"), "community")
    counted = postings(chunks).select("chunk_id", "term", "tf")
    if of.count() <= HELD_NODES:
        known = counted.join(F.broadcast(of.withColumnRenamed("entity", "term")), "term", "left").select("chunk_id", "term", "tf", "community")
        met = known.mapInArrow(_terms_of_runs, "community string, term string, tf bigint")
    else:
        met = mentions.join(of, "entity").select("community", "chunk_id").distinct().join(counted, "chunk_id")
    return met.groupBy("community", "term").agg(F.sum("tf").alias("n"))


def _terms_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums ``(community, term, tf)`` from rows ``(chunk_id, term, tf, community)``, those of a chunk one after the other: each community of a chunk with all
    its terms. The rows of the last chunk go on."""
    held = None
    for batch in batches:
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if len(held) >= TERMS:
            last = held["chunk_id"][len(held) - 1]
            whole = pc.index(held["chunk_id"], last).as_py()
            if whole:
                yield _summed_terms(held.slice(0, whole))
                held = held.slice(whole)
    if held is not None and len(held):
        yield _summed_terms(held)


def _summed_terms(rows: pa.RecordBatch) -> pa.RecordBatch:
    run = rows["chunk_id"].dictionary_encode().indices.to_numpy().astype(np.int64)
    of, terms = rows["community"].dictionary_encode(), rows["term"].dictionary_encode()
    named = of.indices.is_valid().to_numpy(zero_copy_only=False)
    code, size = pc.fill_null(of.indices, 0).to_numpy().astype(np.int64), max(len(of.dictionary), 1)
    pairs = np.unique(run[named] * size + code[named])
    first = np.searchsorted(run, np.arange(run[-1] + 2))
    n = np.diff(first)[pairs // size]
    at = np.arange(n.sum()) + np.repeat(first[pairs // size] - np.cumsum(n) + n, n)
    keys, which = np.unique(np.repeat(pairs % size, n) * len(terms.dictionary) + terms.indices.to_numpy()[at], return_inverse=True)
    tf = np.bincount(which, rows["tf"].to_numpy()[at], len(keys)).astype(np.int64)
    community, term = np.divmod(keys, len(terms.dictionary))
    return pa.RecordBatch.from_arrays([of.dictionary.take(pa.array(community)), terms.dictionary.take(pa.array(term)), pa.array(tf)], ["community", "term", "tf"])


def community_reports(
    membership: DataFrame,
    mentions: DataFrame,
    chunks: DataFrame,
    all_terms: DataFrame | None = None,
    n_entities: int = 5,
    n_chunks: int = 3,
    n_terms: int = 20,
    n_sentences: int = 2,
) -> DataFrame:
    """Extractive report of each community: ``(community, n_nodes, entities, report_terms, summary)``.

    ``mentions`` are ``(entity, chunk_id, n)``. Terms are those of ``community_terms`` (``all_terms`` if stored); the
    sentences, each once, come from its central chunks, those with the most mentions. All lists are top-k.
    """
    of = membership.select(F.col("node").alias("entity"), "community")
    seen = mentions.join(held(of), "entity")

    def best(rows: DataFrame, keep: int, *order) -> DataFrame:
        w = W.partitionBy("community").orderBy(*order)
        return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep)

    sizes = of.groupBy("community").agg(F.count("*").alias("n_nodes"))
    entities = best(
        seen.groupBy("community", "entity").agg(F.sum("n").alias("n")), n_entities, F.col("n").desc(), "entity"
    )
    # A few chunks a community, stored before they look for their texts, so that not all texts are shuffled to them.
    few = stored(
        best(
            seen.groupBy("community", "chunk_id").agg(F.sum("n").alias("n")), n_chunks, F.col("n").desc(), "chunk_id"
        ).select("community", "chunk_id"),
        "few",
    )
    central = stored(held(few).join(chunks.select("chunk_id", "text"), "chunk_id"), "central")
    words = community_terms(membership, mentions, chunks) if all_terms is None else all_terms
    terms = best(words, n_terms, F.col("n").desc(), "term")
    sentences = central.select(
        "community", "chunk_id", F.posexplode(F.split("text", r"[.!?]+ *")).alias("pos", "sentence")
    ).where(F.trim("sentence") != "")
    counted = (
        sentences.select("community", "chunk_id", "pos", "sentence", F.explode(F.array_distinct(tx.terms("sentence"))).alias("entity"))
        .join(held(of), ["community", "entity"])
        .groupBy("community", "chunk_id", "pos", "sentence")
        .agg(F.count("*").alias("n"))
    )
    # Windows overlap, so a sentence may stand in several chunks.
    once = counted.groupBy("community", "sentence").agg(F.max("n").alias("n"), F.min(F.struct("chunk_id", "pos")).alias("at"))
    lines = best(once, n_sentences, F.col("n").desc(), "at")

    def listed(rows: DataFrame, value, name: str) -> DataFrame:
        return rows.groupBy("community").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("r", value.alias("v")))), lambda x: x["v"]).alias(name)
        )

    return (
        sizes.join(listed(entities, F.col("entity"), "es"), "community")
        .join(listed(terms, F.struct("term", "n"), "report_terms"), "community")
        .join(listed(lines, F.col("sentence"), "ss"), "community", "left")
        .select(
            "community",
            "n_nodes",
            F.array_join("es", ", ").alias("entities"),
            "report_terms",
            F.coalesce(F.array_join("ss", ". "), F.lit("")).alias("summary"),
        )
    )


# Fixed value: the default prompt.
TEMPLATE = "Answer from the passages.\nQuestion: {question}\nPassages:\n{context}"


def render(packed: DataFrame, questions: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``(q_id, prompt)`` for every question; one without passages gets an empty context."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("text"))
    context = packed.groupBy("q_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda c: c["line"]), "\n"
        ).alias("context")
    )
    head, _, rest = template.partition("{question}")
    middle, _, tail = rest.partition("{context}")
    return questions.join(context, "q_id", "left").select(
        "q_id",
        F.concat(
            F.lit(head), F.col("text"), F.lit(middle), F.coalesce("context", F.lit("")), F.lit(tail)
        ).alias("prompt"),
    )


def first_passage(prompts: list[str]) -> list[str]:
    """Stand-in model: the first passage of each prompt."""
    out = []
    for prompt in prompts:
        after = prompt.split("Passages:\n", 1)[-1].split("\n", 1)[0]
        out.append(after.split("] ", 1)[-1])
    return out


def answer(
    prompts: DataFrame,
    fn: Callable[[list[str]], list[str]],
    cache: DataFrame | None = None,
    retries: int = 2,
    batch: int = 32,
) -> DataFrame:
    """``(q_id, prompt_hash, answer, cached)``: the caller's model on each distinct new prompt.

    Prompts whose hash is in ``cache`` ``(prompt_hash, answer)`` are not sent; equal prompts are sent
    once. A batch that fails is tried again ``retries`` times and then fails its task, so that
    Spark's own retry applies. ``fn`` must tolerate repeated calls.
    """
    keyed = prompts.select("q_id", "prompt", F.sha2("prompt", 256).alias("prompt_hash"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start : start + batch]
                for attempt in range(retries + 1):
                    try:
                        answers = fn(part["prompt"].tolist())
                        break
                    except Exception:
                        if attempt == retries:
                            raise
                yield pd.DataFrame({"prompt_hash": part["prompt_hash"].to_numpy(), "answer": answers})

    todo = keyed.groupBy("prompt_hash").agg(F.min("prompt").alias("prompt"))
    if cache is not None:
        todo = todo.join(cache.select("prompt_hash"), "prompt_hash", "left_anti")
    fresh = todo.mapInPandas(run, "prompt_hash string, answer string").withColumn("cached", F.lit(False))
    known = fresh
    if cache is not None:
        known = fresh.unionByName(cache.select("prompt_hash", "answer", F.lit(True).alias("cached")))
    return keyed.select("q_id", "prompt_hash").join(known, "prompt_hash").select("q_id", "prompt_hash", "answer", "cached")
