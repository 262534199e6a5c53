"""A prefix trie of conversations by whole-sequence collapse.

A conversation is rebuilt turn by turn in one pass over its sorted rows. Each prefix gets a name: 128 bits of
a hash chained over the turns, so equal names mean equal sequences of (role, text). Then

1. identical rebuilt conversations collapse to one weighted sequence, named after its smallest member; the ids of the
   members are its end list;
2. a sequence that is a proper prefix of another is no leaf (anti-join with the names of all proper prefixes);
3. the prefixes of the sequences, not of the conversations, are added up by name.

A node belongs to the smallest sequence through it. If a sequence owns a node it owns all its deeper ones, as fewer
sequences pass there; so one number a sequence, the depth where its own nodes begin, says which nodes it brings to
the trie. Sums over a subtree are then sums over the sequences through its top, each with its part below: every
quantity is one aggregation by name, combined before the shuffle, however many conversations share the node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodeweave.llm.common import table, words

# Conversations of one family start with turns of the first of them.
FAMILY = 20
# A family shares fewer than this many turns.
SHARED = 4
NAME_BYTES = 16
ROOT = hashlib.sha256(b"").digest()[:NAME_BYTES]
NO_ENDS = hashlib.sha256(b"").hexdigest()
# Ids whose upper bits agree share a piece of an end list: at most 4,096 of them.
PIECE_BITS = 12
OUT_ROWS = 20_000

_STEPS = "conv_id long, depth int, name binary, parent binary, words long, before long, total long"
_FIELDS = pa.schema(
    [("conv_id", pa.int64()), ("depth", pa.int32()), ("name", pa.binary()), ("parent", pa.binary()), ("words", pa.int64()), ("before", pa.int64()), ("total", pa.int64())]
)


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns with a conversation; null roles and texts are empty. ``turn_digest`` stands for (role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    whole = F.concat_ws(":", F.length("role").cast("string"), F.concat("role", "text"))
    return rows.select("*", F.unhex(F.sha2(whole, 256)).alias("digest"), F.size(words(F.col("text"))).cast("long").alias("words"))


def rebuild(conversations: DataFrame) -> DataFrame:
    """One row for each prefix of each rebuilt conversation: its depth (0 for the start), its name and that of the prefix one
    turn shorter, the words of its last turn, of the turns before that, and, on the last row, of all turns."""
    turns = _turns(conversations)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    heads = (
        turns.where(F.col("conv_id") % FAMILY == 0)
        .withColumn("at", F.row_number().over(order))
        .where(F.col("at") < SHARED)
        .groupBy(F.col("conv_id").alias("family"))
        .agg(F.sort_array(F.collect_list(F.struct("at", "digest", "words"))).alias("head"))
    )
    convs = turns.select("conv_id").distinct().withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY)
    starts = convs.join(heads, "family", "left").select("conv_id", F.lit(0).alias("kind"), (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int").alias("shared"), "head")
    rows = starts.unionByName(turns.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    sorted_ = rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
    return sorted_.select("conv_id", "kind", "shared", "head", "digest", "words").mapInArrow(_chain, _STEPS)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow the sorted rows; only the state of one conversation is held."""
    out: list[tuple] = []
    last = None  # the latest prefix, sent when it is known whether more follow
    skip = 0

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FIELDS)], schema=_FIELDS)
        out.clear()
        return batch

    def ended() -> None:
        if last is not None:
            out.append((*last, last[4] + last[5]))

    def longer(conv, digest, n):
        out.append((*last, None))
        name = hashlib.sha256(last[2] + digest).digest()[:NAME_BYTES]
        return (conv, last[1] + 1, name, last[2], n, last[5] + last[4])

    for batch in batches:
        for conv, kind, shared, head, digest, n in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                ended()
                skip = shared
                last = (conv, 0, ROOT, None, 0, 0)
                for h in (head or [])[:shared]:
                    last = longer(conv, h["digest"], h["words"])
            elif skip:
                skip -= 1
            else:
                last = longer(conv, digest, n)
            if len(out) >= OUT_ROWS:
                yield flush()
    ended()
    if out:
        yield flush()


def _end_lists(ends: DataFrame) -> DataFrame:
    """``(name, ends_sha256)``: the ids in pieces of neighbours, joined in parallel, then hashed piece after piece as they
    stream by, so that no list is held as a whole."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy("name", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, h = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for key, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
                if key != name:
                    if h is not None:
                        done.append((name, h.hexdigest()))
                    name, h = key, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_pydict({"name": pa.array([d[0] for d in done], pa.binary()), "ends_sha256": [d[1] for d in done]})
        if h is not None:
            yield pa.RecordBatch.from_pydict({"name": pa.array([name], pa.binary()), "ends_sha256": [h.hexdigest()]})

    return pieces.repartition("name").sortWithinPartitions("name", "piece").select("name", "ids").mapInArrow(run, "name binary, ends_sha256 string")


def sequences(steps: DataFrame) -> DataFrame:
    """Identical rebuilt conversations as one row: ``(conv_id, name, depth, total, weight)``, with the smallest member."""
    ends = steps.where("total IS NOT NULL")
    return ends.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("size"), F.min("total").alias("total"), F.count("*").alias("weight"))


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256)``.

    Rows without a conv_id take no part. Turns of one conversation are ordered by turn (null first), then role and text, so
    the order of repeated turn numbers is defined; repeated rows are turns of their own. Other columns are not read. An
    empty table has no conversation and so no node, not even a root.
    """
    steps = table(rebuild(conversations), "steps")
    whole = table(sequences(steps), "sequences")
    paths = table(steps.drop("total").join(whole.withColumnRenamed("name", "end"), "conv_id"), "paths")
    inner = paths.where("depth < size").select("name").distinct()
    leaves = whole.join(inner, "name", "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    owned = (
        paths.groupBy("name")
        .agg(F.min(F.struct("conv_id", "depth", "before")).alias("o"))
        .groupBy("o.conv_id")
        .agg(F.min(F.struct("o.depth", "o.before")).alias("o"))
        .select("conv_id", F.col("o.depth").alias("own_depth"), F.col("o.before").alias("own_before"))
    )
    facts = whole.select("conv_id").join(leaves, "conv_id", "left").join(owned, "conv_id", "left")
    # Of what a sequence holds below a prefix, the words of nodes it owns are counted once less.
    below = F.col("total") - F.col("before")
    own_below = F.when(F.col("own_depth").isNull(), 0).when(F.col("depth") >= F.col("own_depth"), below).otherwise(F.col("total") - F.col("own_before"))
    child = F.when(F.col("depth") < F.col("size"), F.coalesce((F.col("depth") + 1 >= F.col("own_depth")).cast("long"), F.lit(0))).otherwise(0)
    nodes = table(
        paths.join(facts, "conv_id")
        .groupBy("name")
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.min("depth").cast("long").alias("depth"),
            F.min("parent").alias("parent"),
            F.sum("weight").alias("n_convs"),
            F.sum(child).alias("n_children"),
            F.sum(F.coalesce("leaf", F.lit(0)).cast("long")).alias("n_leaves"),
            F.sum(F.col("weight") * below - own_below).alias("saved_tokens"),
            F.min(F.struct("conv_id", "own_depth"))["own_depth"].alias("own_depth"),
        ),
        "nodes",
    )
    # The parent has the same smallest member, but where a sequence leaves the path of a smaller one.
    branches = nodes.where("depth > 0 AND depth = own_depth").select("name", F.col("parent").alias("up"))
    above = branches.join(nodes.select(F.col("name").alias("up"), F.col("conv_id").alias("above")), "up").select("name", "above")
    ends = _end_lists(steps.where("total IS NOT NULL").select("name", "conv_id"))
    return (
        nodes.join(above, "name", "left")
        .join(ends, "name", "left")
        .select(
            "conv_id",
            "depth",
            F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
    )
