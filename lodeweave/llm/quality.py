"""Quality rules with thresholds that follow each language and source.

Every document gets a few ratios. Their distribution per language and source is kept as a mergeable
quantile sketch: counts of values cut to their seven leading bits (the buckets of an HDR histogram), so
a quantile is off by less than a 64th, sketches merge by adding counts, and the order of the rows does
not matter. A group of fewer than ``LEAST`` documents takes the merged sketch of its language,
a language of fewer the one of all. The fences lie ``REACH`` quartile ranges outside the quartiles, plus a slack, so a
clean group loses nothing however its cut-offs would fall. All columns are built from SQL functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodeweave.llm.common import table, words

REACH = 3
LEAST = 100
SYMBOLS = r"[^#*$%&|<>]+"
# Slack added outside the fences: words in 1000, hundredths of a character, lines in 1000, words in 1000.
SLACK = {"symbols": 150, "length": 150, "lines": 300, "repeats": 150}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _doubled(hashes: str, k: int) -> Column:
    """One hash for the window at each place, from those of the windows there and ``k`` places on. The last places
    have no whole window and are cut off by ``_whole``."""
    h = F.col(hashes)
    return F.zip_with(h, F.slice(h, k + 1, F.greatest(F.size(h), F.lit(1))), lambda x, y: F.xxhash64(x, y))


def _whole(hashes: str, width: int) -> Column:
    return F.slice(hashes, 1, F.greatest(F.size(hashes) - (width - 1), F.lit(0)))


def _ranked(hashes: Column) -> Column:
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _covered(ranked: Column) -> Column:
    """``ranked`` must be a column of its own: the function below looks at it once an element."""
    twice = F.transform(ranked, lambda r, k: F.when((r["h"] == F.get(ranked, k - 1)["h"]) | (r["h"] == F.get(ranked, k + 1)["h"]), r["i"]))
    start = F.struct(F.lit(-8).alias("last"), F.lit(0).alias("sum"))
    total = F.aggregate(F.sort_array(F.array_compact(twice)), start, lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(F.lit(8), i - acc["last"])).alias("sum")))
    return total["sum"]


def measured(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep``, and the base counts, ``n_lines`` and ``base_failed``, each as ``_q_<name>``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select(*keep, words(F.col("text").cast("string")).alias("_q_w"), F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("_q_n_symbols"), lines.alias("_q_l"))
    own = [F.col(f"`{c}`") for c in step.columns if c not in ("_q_w", "_q_l")]
    step = step.select(
        *own, F.size("_q_w").cast("long").alias("_q_n_words"), F.length(F.array_join("_q_w", "")).cast("long").alias("_q_word_chars"),
        F.size("_q_l").cast("long").alias("_q_n_lines"), (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long").alias("_q_n_dup_lines"),
        F.transform("_q_w", lambda w: F.xxhash64(w)).alias("_q_h1"),
    )
    step = step.withColumn("_q_h2", _doubled("_q_h1", 1)).drop("_q_h1").withColumn("_q_h4", _doubled("_q_h2", 2)).drop("_q_h2")
    # An 8-word window found twice holds 4-word windows found twice: most texts have none and end here.
    step = step.withColumn("_q_h4", F.when(F.size(F.array_distinct(_whole("_q_h4", 4))) < F.size(_whole("_q_h4", 4)), F.col("_q_h4")))
    step = step.withColumn("_q_h8", _doubled("_q_h4", 4)).drop("_q_h4").withColumn("_q_h8", _whole("_q_h8", 8))
    step = step.withColumn("_q_r", F.when(F.size(F.array_distinct("_q_h8")) < F.size("_q_h8"), _ranked(F.col("_q_h8")))).drop("_q_h8")
    step = step.withColumn("_q_n_repeat_words", F.coalesce(_covered(F.col("_q_r")), F.lit(0)).cast("long")).drop("_q_r")
    failed = (F.col("_q_n_words") < 20) | (100 * F.col("_q_n_repeat_words") > 30 * F.col("_q_n_words"))
    return step.withColumn("_q_base_failed", failed)


def _ratios() -> dict[str, Column]:
    n = F.greatest(F.col("_q_n_words"), F.lit(1))
    return {
        "symbols": (1000 * F.col("_q_n_symbols") / n).cast("long"),
        "length": (100 * F.col("_q_word_chars") / n).cast("long"),
        "lines": (1000 * F.col("_q_n_dup_lines") / F.greatest(F.col("_q_n_lines"), F.lit(1))).cast("long"),
        "repeats": (1000 * F.col("_q_n_repeat_words") / n).cast("long"),
    }


def _key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def sketches(rows: DataFrame) -> DataFrame:
    """``(kl, ks, metric, value, n)``: the sketches of every language and source (``_q_kl``, ``_q_ks``), and those
    merged over the sources (ks ``*``) and over all (both ``*``). Documents that failed the base rules do
    not count."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("v")) for m, v in _ratios().items()])
    fine = (
        rows.where(~F.col("_q_base_failed"))
        .select("_q_kl", "_q_ks", F.explode(pairs).alias("p"))
        .select(F.col("_q_kl").alias("kl"), F.col("_q_ks").alias("ks"), "p.metric", F.expr("p.v - p.v % shiftleft(1L, greatest(length(bin(p.v)) - 7, 0))").alias("value"))
        .groupBy("kl", "ks", "metric", "value")
        .agg(F.count("*").alias("n"))
    )
    levels = F.array(F.struct("kl", "ks"), F.struct("kl", F.lit("*").alias("ks")), F.struct(F.lit("*").alias("kl"), F.lit("*").alias("ks")))
    return fine.select(F.explode(levels).alias("k"), "metric", "value", "n").groupBy("k.kl", "k.ks", "metric", "value").agg(F.sum("n").alias("n"))


def thresholds(rows: DataFrame) -> DataFrame:
    """``(_t_kl, _t_ks, low_<metric>, high_<metric>)`` for every language and source with a document that passed
    the base rules."""
    order = W.partitionBy("kl", "ks", "metric")
    ranked = table(sketches(rows), "sketches").withColumn("upto", F.sum("n").over(order.orderBy("value"))).withColumn("all", F.sum("n").over(order))
    quartiles = ranked.groupBy("kl", "ks", "metric").agg(
        F.max("all").alias("n"),
        F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("value"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("value"))).alias("q3"),
    )
    quartiles = table(quartiles.select("kl", "ks", "metric", F.struct("n", "q1", "q3").alias("q")), "quartiles")
    fine = quartiles.where("ks <> '*'").withColumnRenamed("q", "own")
    by_lang = quartiles.where("ks = '*' and kl <> '*'").select("kl", "metric", F.col("q").alias("lang"))
    by_all = quartiles.where("kl = '*'").select("metric", F.col("q").alias("every"))
    chosen = (
        fine.join(by_lang, ["kl", "metric"])
        .join(by_all, "metric")
        .select("kl", "ks", "metric", F.when(F.col("own.n") >= LEAST, F.col("own")).when(F.col("lang.n") >= LEAST, F.col("lang")).otherwise(F.col("every")).alias("q"))
    )
    slack = F.create_map(*[F.lit(x) for m, s in SLACK.items() for x in (m, s)])[F.col("metric")]
    reach = REACH * (F.col("q.q3") - F.col("q.q1")) + slack
    fenced = chosen.select(F.col("kl").alias("_t_kl"), F.col("ks").alias("_t_ks"), "metric", (F.col("q.q1") - reach).alias("low"), (F.col("q.q3") + reach).alias("high"))
    pick = [F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"_t_{side}_{m}") for m in SLACK for side in ("low", "high")]
    return fenced.groupBy("_t_kl", "_t_ks").agg(*pick)


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` of ``measured`` with ``_q_kl`` and ``_q_ks``, and ``_q_kept``."""
    limits = table(thresholds(rows), "thresholds")
    met = rows.join(limits, (F.col("_q_kl") == F.col("_t_kl")) & (F.col("_q_ks") == F.col("_t_ks")), "left")
    inside = reduce(lambda a, b: a & b, [v.between(F.col(f"_t_low_{m}"), F.col(f"_t_high_{m}")) for m, v in _ratios().items()])
    return met.withColumn("_q_kept", ~F.col("_q_base_failed") & F.coalesce(inside, F.lit(False)))


def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` of every row.

    Null texts count as empty and fail the base rules. A null language or source is a group of its
    own. Repeated rows count as often as they occur. Other columns are ignored.
    """
    rows = table(measured(docs, F.col("doc_id").cast("long").alias("doc_id"), _key("lang").alias("_q_kl"), _key("source").alias("_q_ks")), "measured")
    return judged(rows).select("doc_id", *[F.col(f"_q_{c}").alias(c) for c in [*BASE, "base_failed", "kept"]])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    own = docs.columns
    rows = table(measured(docs, *[F.col(f"`{c}`") for c in own], _key("lang").alias("_q_kl"), _key("source").alias("_q_ks")), "measured")
    return judged(rows).where("_q_kept").select(*[F.col(f"`{c}`") for c in own])
