"""Corpus preparation: page text, deduplication, chunks, tokens."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodeweave.functions import text as tx
from lodeweave.operators.iterate import components
from lodeweave.operators.skew import hot_keys, salted_join
from lodeweave.session import cut

# Fixed value: the modulus of the min-hash family, the least prime above 2^32.
PRIME = 4294967311


def page_text(pages: DataFrame) -> DataFrame:
    """Title and visible text of raw HTML."""
    body = F.regexp_replace("html", r"(?is)<!--.*?-->", " ")
    body = F.regexp_replace(body, r"(?is)<script\b.*?</script\s*>", " ")
    body = F.regexp_replace(body, r"(?is)<style\b.*?</style\s*>", " ")
    body = F.regexp_replace(body, r"(?is)<head\b.*?</head\s*>", " ")
    body = F.regexp_replace(body, r"(?s)<[^>]*>", " ")
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1)
    return pages.select(
        "page_id",
        "url",
        tx.squeeze(tx.decode_entities(title)).alias("title"),
        tx.squeeze(tx.decode_entities(body)).alias("text"),
    )


def pages_as_documents(pages: DataFrame) -> DataFrame:
    """Page text in the document model; the host is the source."""
    return page_text(pages).select(
        F.col("page_id").alias("doc_id"),
        "text",
        F.lit("").alias("lang"),
        F.parse_url("url", F.lit("HOST")).alias("source"),
        F.length("text").cast("bigint").alias("n_chars"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """Keep the least ``doc_id`` of each distinct text.

    Copies meet as (hash, least id) partial aggregates, so a text that fills a
    third of the corpus sends one row per task to its reducer. The ids left out are few and stored, so Spark sends them
    to the texts and no text is shuffled.
    """
    keep = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    out = cut(docs.select("doc_id").join(keep, "doc_id", "left_anti").distinct())
    return docs.where(F.col("doc_id").isNotNull()).join(out, "doc_id", "left_anti")


def shingle_hashes(text: Column, width: int) -> Column:
    """Distinct 32-bit hashes of the word ``width``-grams of a text; a text of fewer words is one gram."""

    def grams(t: Column) -> Column:
        short = (F.size(t) > 0) & (F.size(t) < width)
        return F.when(short, F.array(F.array_join(t, " "))).otherwise(F.array_distinct(tx.ngrams(t, width)))

    found = tx.let(tx.terms(text), grams)
    return F.array_distinct(F.transform(found, lambda g: F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("bigint")))


def hash_family(k: int) -> list[tuple[int, int]]:
    """``k`` pairs (a, b) of ``(h * a + b) % PRIME``, drawn apart from each other; 32-bit h times a fits 63 bits."""
    digits = [hashlib.md5(f"minhash {i}".encode()).hexdigest() for i in range(k)]
    return [(1 + int(d[:7], 16), int(d[8:16], 16)) for d in digits]


def minhash(hashes: Column, k: int) -> Column:
    """``k`` min-hashes of an array of 32-bit hashes (Broder 1997)."""

    def one(hs: Column, a: int, b: int) -> Column:
        return F.array_min(F.transform(hs, lambda h: (h * F.lit(a) + F.lit(b)) % F.lit(PRIME)))

    return tx.let(hashes, lambda h: F.array(*[one(h, a, b) for a, b in hash_family(k)]))


def _met(docs: DataFrame, k: int, bands: int, width: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, s)``, the shingles of each text, and ``(doc_id, bucket, head, n)``, the members of each band bucket of
    two or more with the least of them, the leader, and their number."""
    if k % bands:
        raise ValueError("k must be a multiple of bands")
    rows = k // bands
    # Each step is cut: its array is read several times by the next one and would be computed anew.
    sets = cut(docs.select("doc_id", shingle_hashes(F.col("text"), width).alias("s")).where(F.size("s") > 0))
    sigs = cut(sets.select("doc_id", minhash(F.col("s"), k).alias("sig")))
    buckets = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.concat_ws("-", b.cast("string"), F.slice(F.col("sig"), b * rows + 1, rows).cast("array<string>")),
    )
    members = sigs.select("doc_id", F.explode(buckets).alias("bucket"))
    heads = members.groupBy("bucket").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1")
    return sets, cut(members.join(heads, "bucket"))


def _jaccard(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` of ``(doc_id, head)`` with ``j``, the Jaccard similarity of their sets."""
    # Only sets of documents that are compared move. Spark sizes an array as one element and might
    # broadcast the sets by mistake: they are merged.
    met = pairs.select("doc_id").union(pairs.select("head")).distinct()
    sets = sets.select("doc_id", "s").join(met, "doc_id", "left_semi")
    shared = F.size(F.array_intersect("s", "hs"))
    return (
        pairs.join(sets.hint("merge"), "doc_id")
        .join(sets.select(F.col("doc_id").alias("head"), F.col("s").alias("hs")).hint("merge"), "head")
        .select("doc_id", "head", (shared / (F.size("s") + F.size("hs") - shared)).alias("j"))
    )


def _led(sets: DataFrame, members: DataFrame) -> DataFrame:
    return _jaccard(cut(members.where("doc_id > head").select("doc_id", "head").distinct()), sets)


def _edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("doc_id").alias("src"), F.col("head").alias("dst"))


def near_edges(docs: DataFrame, k: int = 48, bands: int = 12, min_jaccard: float = 0.7, width: int = 3) -> DataFrame:
    """Edges from near copies to a leader of their buckets.

    In each band bucket the least document leads, and every other member is compared with it once, so a
    document meets at most ``bands`` leaders and the work is linear in the documents whatever the size of a
    bucket. Members that are near to each other and to none of their leaders are not linked here; ``near_clusters``
    finds them with ``similar_pairs``.
    """
    return _edges(_led(*_met(docs, k, bands, width)).where(F.col("j") >= min_jaccard))


def similar_pairs(sets: DataFrame, min_jaccard: float, rows_per_task: int = 4096) -> DataFrame:
    """``(doc_id, head, j)`` of all pairs of ``sets`` (``doc_id``, ``part``, ``s``) of different parts whose Jaccard similarity
    is ``min_jaccard`` or more; ``doc_id`` is the greater id.

    Elements are ordered from the rarest on. Two such sets share an element among the first ``n - min_jaccard * n + 1``
    of each, so only these meet (Chaudhuri, Ganti and Kaushik 2006), and only where sizes and the places of the
    element leave enough to share (Xiao et al. 2008). Elements that one part alone holds are not listed, so a group of
    copies with one label meets nobody in its own elements. A list over ``rows_per_task`` is split.
    """
    tokens = sets.select("doc_id", "part", F.size("s").alias("n"), F.explode("s").alias("g"))
    held = tokens.groupBy("g").agg(F.count("*").alias("c"), (F.min("part") != F.max("part")).alias("open")).where("c > 1")
    # Elements of one set alone come first; they are counted and not listed.
    ranked = tokens.join(held, "g").groupBy("doc_id", "part", "n").agg(F.sort_array(F.collect_list(F.struct("c", "g", "open"))).alias("r"))
    least = F.lit(min_jaccard)
    first = F.col("n") - F.ceil(least * F.col("n") - 1e-9).cast("int") + 1
    alone = F.col("n") - F.size("r")
    lists = cut(
        ranked.select("doc_id", "part", "n", alone.alias("alone"), F.posexplode(F.slice("r", 1, F.greatest(first - alone, F.lit(0)))).alias("k", "x"))
        .where("x.open")
        .select("doc_id", "part", "n", (F.col("alone") + F.col("k")).alias("pos"), F.col("x.g").alias("g"))
    )
    hot = cut(hot_keys(lists.groupBy("g").agg(F.count("*").alias("m")), "g", "m", rows_per_task))
    other = lists.select("g", *[F.col(c).alias(f"o_{c}") for c in ("doc_id", "part", "n", "pos")])
    needed = F.ceil(least / (1 + least) * (F.col("n") + F.col("o_n")) - 1e-9)
    left = F.least(F.col("n") - F.col("pos"), F.col("o_n") - F.col("o_pos"))
    met = salted_join(lists, other, "g", hot, F.xxhash64("doc_id")).where(
        (F.col("doc_id") > F.col("o_doc_id")) & (F.col("part") != F.col("o_part"))
        & (F.least("n", "o_n") >= least * F.greatest("n", "o_n") - 1e-9) & (left >= needed)
    )
    pairs = cut(met.select("doc_id", F.col("o_doc_id").alias("head")).distinct())
    return _jaccard(pairs, sets).where(F.col("j") >= min_jaccard)


def near_clusters(docs: DataFrame, k: int = 48, bands: int = 12, min_jaccard: float = 0.7, width: int = 3) -> DataFrame:
    """``(doc_id, cluster)`` with the least id of each group of near copies.

    Exact copies go first (``dedup``); they carry no extra information here. Members of a bucket are compared with
    its leader. A bucket where one is not near to it, and that has others, is mixed; all documents of mixed buckets that
    are not in one cluster by then meet in ``similar_pairs``. So two near texts that share a bucket are in one cluster.
    """
    unique = dedup(docs)
    sets, members = _met(unique, k, bands, width)
    led = cut(_led(sets, members))
    found = components(_edges(led.where(F.col("j") >= min_jaccard)))
    labels = cut(
        unique.select("doc_id")
        .join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
        .select("doc_id", F.coalesce("component", "doc_id").alias("part"))
    )
    mixed = members.where("n > 2").join(led.where(F.col("j") < min_jaccard), ["doc_id", "head"], "left_semi").select("bucket").distinct()
    rest = members.where("n > 2").join(mixed, "bucket", "left_semi").select("doc_id").distinct()
    rest = cut(sets.join(rest, "doc_id", "left_semi").hint("merge").join(labels, "doc_id"))
    links = cut(similar_pairs(rest, min_jaccard).select("doc_id", "head"))
    if links.isEmpty():
        return labels.withColumnRenamed("part", "cluster")
    # Clusters joined by a link: the labels are the nodes.
    ends = links.join(labels, "doc_id").select(F.col("part").alias("src"), F.col("head").alias("doc_id"))
    joined = components(ends.join(labels, "doc_id").select("src", F.col("part").alias("dst")).distinct())
    return labels.join(joined.select(F.col("node").alias("part"), "component"), "part", "left").select(
        "doc_id", F.coalesce("component", "part").alias("cluster")
    )


def near_dedup(docs: DataFrame, k: int = 48, bands: int = 12, min_jaccard: float = 0.7, width: int = 3) -> DataFrame:
    keep = near_clusters(docs, k, bands, min_jaccard, width).where("doc_id = cluster")
    return docs.join(keep.select("doc_id"), "doc_id", "left_semi")


def chunk(docs: DataFrame, size: int = 64, stride: int = 48) -> DataFrame:
    """Overlapping windows of ``size`` pieces, one every ``stride`` pieces.

    Windows are cut inside the document row: no shuffle, and each piece is copied
    size/stride times however long the document is.
    """
    if not 0 < stride <= size:
        raise ValueError("need 0 < stride <= size")

    def windows(p: Column) -> Column:
        last = F.greatest(F.ceil((F.size(p) - size) / F.lit(stride)), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(p, i * stride + 1, size), " "))

    keep = [c for c in ("lang", "source") if c in docs.columns]
    return (
        docs.where(F.col("text").rlike(r"\S"))
        .select("doc_id", *keep, F.posexplode(tx.let(tx.pieces("text"), windows)).alias("chunk_no", "text"))
        .select(chunk_id(), "doc_id", "chunk_no", *keep, "text")
    )


def chunk_id() -> Column:
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")).alias("chunk_id")


def chunk_paras(docs: DataFrame, target: int = 400) -> DataFrame:
    """Consecutive paragraphs joined until ``target`` characters are met.

    The window spans the paragraphs of one document, which came from one row.
    """
    paras = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "para")).where(F.trim("para") != "")
    before = F.sum(F.length("para")).over(
        W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        paras.withColumn("chunk_no", F.floor(F.coalesce(before, F.lit(0)) / F.lit(target)).cast("int"))
        .groupBy("doc_id", "chunk_no")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "para"))).alias("ps"))
        .select(
            chunk_id(),
            "doc_id",
            "chunk_no",
            F.array_join(F.transform("ps", lambda p: p["para"]), "\n").alias("text"),
        )
    )


def tokens(df: DataFrame, col: str = "text", out: str = "tokens") -> DataFrame:
    return df.withColumn(out, tx.terms(col))
