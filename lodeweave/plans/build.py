"""Build the index: each table is written once to shared storage and read by every query."""

from __future__ import annotations

import math
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators import context, corpus, graph_build, iterate, retrieve
from lodeweave.operators.held import held
from lodeweave.session import cut, new_path
from lodeweave.sources.index import write_bucketed

#: Chunks that a bucket is meant to hold. A task that adds up the scores of a batch keeps a sum for each question and chunk of its bucket.
BUCKET_CHUNKS = 8192


class Index:
    """Tables derived from a corpus, built on first use under ``root``.

    ============ =====================================================
    ``chunks``   windows of the deduplicated documents
    ``postings`` ``(term, chunk_id, tf, dl)``
    ``rarity``   ``(term, df)`` by chunk
    ``stats``    one row ``(n, avgdl)``
    ``norms``    ``(chunk_id, norm)`` of the tf-idf vectors
    ``vectors``  ``(chunk_id, embedding)`` by hashed terms
    ``mentions`` ``(entity, chunk_id, n)``
    ``weights``  mentions with tf-idf weight and the entity's ``id``
    ``band``     ``(entity, df)`` by document
    ``numbers``  ``(entity, id)`` of the band
    ``lists``    ``es``, the ids of the entities of each chunk
    ``names``    ``(entity, id)`` of the mentions, ids in the order of the names
    ``links``    entity co-occurrence by ids, both directions
    ``edges``    the links by names
    ``adjacency`` the edges as lists of neighbours
    ``near``     the links as lists of neighbours, by ids
    ``members``  ``(node, community)``
    ``terms``    ``(community, term, n)``, all terms of a community
    ``reports``  community reports
    ============ =====================================================
    """

    #: Tables bucketed by chunk, into as many buckets as the session has shuffle partitions, or more if there are many chunks. The links are bucketed by
    #: source, into as many as the session has shuffle partitions, or more if there are many pairs.
    BUCKETED = {"postings": "chunk_id", "norms": "chunk_id", "mentions": "chunk_id", "weights": "chunk_id"}

    def __init__(self, spark: SparkSession, docs: DataFrame, root: str | None = None, rounds: int = 3):
        self.spark, self.root, self.rounds = spark, root or new_path(spark, "index"), rounds
        self.docs = corpus.dedup(docs)
        self._built: dict[str, DataFrame] = {}

    @cached_property
    def buckets(self) -> int:
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(least, math.ceil(self["chunks"].count() / BUCKET_CHUNKS))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            df = getattr(self, f"_{name}")()
            path = f"{self.root}/{name}"
            if name == "links":
                # Stored by source: a loop over the links then sums up its votes where they lie.
                self._built[name] = write_bucketed(df, f"{name}_{uuid.uuid4().hex}", ["src"], self._parts, path, then=["dst"], steps=["dst"])
            elif name in self.BUCKETED:
                self._built[name] = write_bucketed(df, f"{name}_{uuid.uuid4().hex}", [self.BUCKETED[name]], self.buckets, path)
            else:
                df.write.mode("overwrite").parquet(path)
                self._built[name] = self.spark.read.schema(df.schema).parquet(path)
        return self._built[name]

    def _chunks(self) -> DataFrame:
        return corpus.chunk(self.docs)

    def _postings(self) -> DataFrame:
        # Batches of questions read all postings and add them up by chunk, so the chunks go to their bucket
        # before they are taken apart; ``sources.index.write_index`` sorts a copy for single-term look-ups.
        return retrieve.postings(self["chunks"].repartition(self.buckets, "chunk_id"))

    def _rarity(self) -> DataFrame:
        return self["postings"].groupBy("term").agg(F.count("*").alias("df"))

    def _stats(self) -> DataFrame:
        return retrieve.corpus_stats(self["chunks"])

    def _norms(self) -> DataFrame:
        return retrieve.chunk_norms(self["postings"], self["stats"], self["rarity"]).repartition(self.buckets, "chunk_id")

    def _vectors(self) -> DataFrame:
        return retrieve.hash_embed(self["postings"], self["rarity"], self["stats"].select("n").scalar())

    def _mentions(self) -> DataFrame:
        return graph_build.entities_in(self["postings"], self["band"])

    def _band(self) -> DataFrame:
        return graph_build.entity_band(self.docs)

    @property
    def found(self) -> DataFrame:
        """The mentions in the order of the chunks, as they are counted from these; they need no postings."""
        return graph_build.entities_in(retrieve.postings(self["chunks"]), self["band"])

    def _weights(self) -> DataFrame:
        return graph_build.mention_edges(self["mentions"], self["chunks"]).join(held(self["names"]), "entity")

    def _numbers(self) -> DataFrame:
        return graph_build.numbered(self["band"])

    def _lists(self) -> DataFrame:
        return graph_build.entity_lists(self.found, self["numbers"], self["band"])

    def _names(self) -> DataFrame:
        # A word longer than a piece is cut, so an entity of the documents may be in no chunk.
        there = cut(self["lists"].select(F.explode("es").alias("id")).distinct())
        return self["numbers"].join(held(there), "id", "left_semi").select("entity", "id")

    def _links(self) -> DataFrame:
        links, self._parts = graph_build.id_links(self["lists"], self["numbers"])
        return links

    def _edges(self) -> DataFrame:
        return graph_build.with_names(self["links"], self["names"], "src", "dst")

    def _adjacency(self) -> DataFrame:
        return iterate.adjacency(self["edges"])

    def _near(self) -> DataFrame:
        return iterate.adjacency(self["links"])

    def _members(self) -> DataFrame:
        return graph_build.with_names(iterate.communities(self["links"], self.rounds, once=True), self["names"], "node", "community")

    def _terms(self) -> DataFrame:
        return context.community_terms(self["members"], self.found, self["chunks"])

    def _reports(self) -> DataFrame:
        return context.community_reports(self["members"], self.found, self["chunks"], self["terms"])


def build_index(spark: SparkSession, docs: DataFrame, root: str | None = None) -> Index:
    """Build every table now, in dependency order."""
    index = Index(spark, docs, root)
    for name in ("chunks", "postings", "rarity", "stats", "norms", "vectors", "mentions", "weights", "names", "links", "edges", "near", "members", "terms", "reports"):
        index[name]
    return index
