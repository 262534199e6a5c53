"""Streams of documents into an index, and streams of questions against one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators import corpus, graph_build, retrieve
from lodeweave.operators.iterate import numbered
from lodeweave.session import cut, discard, new_path
from lodeweave.streaming.run import run_batches

TABLES = {
    "hashes": "doc_id bigint, h string, batch bigint",
    "chunks": "chunk_id string, doc_id bigint, chunk_no int, lang string, source string, text string, batch bigint",
    "postings": "term string, chunk_id string, tf bigint, dl int, batch bigint",
    "terms": "entity string, df bigint, batch bigint",
    "mentions": "entity string, chunk_id string, n bigint, batch bigint",
    "entities": "entity string, id int, batch bigint",
    "pairs": "src int, dst int, weight bigint, batch bigint",
}


class StreamIndex:
    """An index that grows by micro-batch.

    Each batch writes its own ``batch=<id>`` folders and looks only at folders of
    earlier batches, so a batch run again replaces its output and changes nothing
    else. Documents carry no event time; a text is a repeat if an earlier batch
    stored its hash. Counts are stored, and frequencies are taken at query time, as
    they move with every batch.

    A term becomes an entity with the batch that brings it to ``df_lo`` documents. That batch stores its earlier
    mentions too, and the pairs they make in their chunks, so the mentions and edges of all batches together
    are those of an index built at once. It gets its id, after those of earlier batches, with that batch too; pairs are stored by ids.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, df_lo: int = 5):
        self.spark, self.root, self.df_lo = spark, root or new_path(spark, "stream-index"), df_lo
        # An empty table makes a folder readable before the first batch.
        for name, schema in TABLES.items():
            spark.createDataFrame([], schema).write.mode("ignore").partitionBy("batch").parquet(f"{self.root}/{name}")

    def _stored(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}")

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def add(self, docs: DataFrame, batch: int) -> None:
        hashed = docs.withColumn("h", F.sha2("text", 256))
        first = hashed.groupBy("h").agg(F.min("doc_id").alias("doc_id"))
        old = self._stored("hashes").where(F.col("batch") < batch).select("h")
        self._write(first.join(old, "h", "left_anti").select("doc_id", "h"), "hashes", batch)
        new = self._stored("hashes").where(F.col("batch") == batch).select("doc_id")
        # Read by two tables below, whatever it takes to read the batch again.
        fresh = cut(docs.join(new, "doc_id", "left_semi"))
        self._write(corpus.chunk(fresh), "chunks", batch)
        mine = self.chunks().where(F.col("batch") == batch)
        self._write(retrieve.postings(mine), "postings", batch)
        self._write(graph_build.term_documents(fresh), "terms", batch)
        discard(fresh)
        self._add_graph(batch)

    def _add_graph(self, batch: int) -> None:
        """Mentions and pairs that this batch brings. Only terms of the batch can become entities, so
        only their counts are added up."""
        terms, post = self._stored("terms"), self.postings()
        now = terms.where(F.col("batch") == batch).select("entity", "df")
        earlier = terms.where(F.col("batch") < batch).join(now.select("entity"), "entity", "left_semi")
        before = earlier.groupBy("entity").agg(F.sum("df").alias("before"))
        met = now.join(before, "entity", "left").select("entity", "df", F.coalesce("before", F.lit(0)).alias("before"))
        band = cut(met.where(F.col("df") + F.col("before") >= self.df_lo).select("entity", (F.col("before") < self.df_lo).alias("grown")))
        found = graph_build.entities_in(post.where(F.col("batch") == batch), band)
        late = graph_build.entities_in(post.where(F.col("batch") < batch), band.where("grown"))
        self._write(found.unionByName(late), "mentions", batch)
        known = self.entities().where(F.col("batch") < batch).agg(F.max("id")).first()[0]
        fresh = numbered(band.where("grown")).withColumn("id", F.col("id") + F.lit(0 if known is None else known + 1))
        self._write(fresh, "entities", batch)
        seen = self.mentions().where(F.col("batch") <= batch).withColumn("new", F.col("batch") == batch)
        if known is not None:
            seen = seen.join(seen.where("new").select("chunk_id").distinct(), "chunk_id", "left_semi")
        ids = self.entities().where(F.col("batch") <= batch).select("entity", "id")
        self._write(graph_build.new_pairs(seen, ids), "pairs", batch)
        discard(band)

    def chunks(self) -> DataFrame:
        return self._stored("chunks")

    def postings(self) -> DataFrame:
        return self._stored("postings")

    def mentions(self) -> DataFrame:
        return self._stored("mentions")

    def entities(self) -> DataFrame:
        """``(entity, id)`` with the batch that brought it."""
        return self._stored("entities")

    def edges(self, min_count: int = 2) -> DataFrame:
        """``(src, dst, weight)`` with src < dst, as ``graph_build.cooccur`` gives them."""
        pairs = self._stored("pairs")
        # The pairs of one batch are counted already.
        if pairs.select("batch").distinct().count() > 1:
            pairs = pairs.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
        rows = pairs.where(F.col("weight") >= min_count).select("src", "dst", "weight")
        named = graph_build.with_names(rows, self.entities().select("entity", "id"), "src", "dst")
        # Ids follow the names inside a batch only.
        return named.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")

    def ingest(self, stream: DataFrame, log: str | None = None) -> "StreamIndex":
        run_batches(stream, self.add, "ingest", log=log)
        return self


def answer_stream(
    questions: DataFrame, post: DataFrame, stats: DataFrame, rarity: DataFrame | None = None, k: int = 5
) -> DataFrame:
    """BM25 hits for a stream of ``(q_id, text)``, each micro-batch against the static index.
    A batch run again replaces its own folder."""
    spark = questions.sparkSession
    root = new_path(spark, "answers")

    def one(batch: DataFrame, number: int) -> None:
        hits = retrieve.bm25(batch, post, stats, k, rarity=rarity)
        hits.write.mode("overwrite").parquet(f"{root}/batch={number}")

    run_batches(questions, one, "answers")
    return spark.read.schema("q_id bigint, chunk_id string, score double, rank int, via string, batch bigint").parquet(
        root
    ).drop("batch")
