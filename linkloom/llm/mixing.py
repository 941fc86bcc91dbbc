"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, md5_60, save

BITS = 60
#: Bits of the hash that one histogram resolves: 256 buckets a source.
STEP = 8
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Maximal runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """sizes(key, source_size) with target, whole copies and the rest. One row
    a source: the window below sorts the list of sources, not the corpus, in
    one task: some millions of sources at most."""
    d38 = "decimal(38,0)"
    order = F.when(F.col("key").isNull(), 1).otherwise(0)
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(order, "key")) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long"))
    every = Window.partitionBy(F.lit(0))
    ratio = F.col("source_size") * cap / F.col("weight")
    before = Window.orderBy(ratio, "rank").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy(ratio, "rank").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        ranked.withColumn("words", F.sum("source_size").over(every))
        .withColumn("spent", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap)
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    full = (F.col("source_size").cast(d38) * cap * F.col("open")) < F.col("weight").cast(d38) * (F.col("words") - F.col("spent"))
    ranked = ranked.withColumn("full", full).withColumn("capped", F.min("full").over(upto))
    left = F.col("words") - cap * F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(every), F.lit(0))
    share = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    target = F.when(F.col("capped"), (F.col("source_size") * cap).cast("double")).otherwise(
        (F.col("weight") * left).cast("double") / share
    )
    return (
        ranked.withColumn("target", target)
        .withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
        .select("key", "source_size", "target", "copies", "rest")
    )


def mix(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
    weights: Sequence[int] = (5, 2, 1),
    cap: int = 3,
    seed: str = "mix-1",
) -> DataFrame:
    """The rows of docs with size, source_size, target, copies and taken.

    Sources in code-point order (null last) weigh ``weights``, repeating, and
    share the words of the whole corpus; a target above ``cap`` times its
    source is cut to that, and the excess is shared again by weight.

    Each document has a seeded 60-bit hash. Every source repeats whole
    ``copies`` times, and documents below the source's hash threshold once
    more. The threshold is found by histograms: words by source and hash
    bucket, a running sum to the bucket in which the budget ends, then only
    that bucket is split further. Nothing is sorted but histograms.

    Null or empty text has size 0 and is never taken: copies 0. A null source is a
    source of its own. Equal rows share a hash and are taken or left together.
    Whole documents are taken, so a source misses its target by at most half
    the document at the threshold. Output columns replace input columns of the
    same name. An empty table gives an empty result.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))  # null-safe key of an equi-join
    value = md5_60(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))))
    rows = docs.select(F.struct("*").alias("row"), key.alias("skey"), word_count(F.col(text)).alias("size"), value.alias("h"), F.col(source).alias("key"))
    slim = save(rows.select("skey", "key", "size", "h"), "slim")
    sizes = slim.groupBy("skey", "key").agg(F.sum("size").alias("source_size"))
    state = save(
        _targets(sizes, weights, cap).select(
            F.coalesce(F.concat(F.lit("s"), F.col("key")), F.lit("n")).alias("skey"), "source_size", "target", "copies", "rest",
            F.lit(0).cast("long").alias("lo"), F.lit(1 << BITS).cast("long").alias("hi"), F.lit(0).cast("long").alias("base"),
            F.lit(2).cast("long").alias("n"),
        ),
        "targets",
    )
    shift = BITS
    while shift > 0:
        shift = max(0, shift - STEP)
        # state is a file of one row a source: Spark broadcasts it if that file is below the broadcast threshold, else sort-merges
        inside = slim.drop("key").join(state.select("skey", "lo", "hi"), "skey").where("h >= lo AND h < hi")
        hist = inside.groupBy("skey", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        run = F.sum("words").over(Window.partitionBy("skey").orderBy("b"))
        hist = hist.withColumn("run", run).join(state.select("skey", "rest", F.col("base").alias("was")), "skey")
        hist = hist.where(F.col("was") + F.col("run") > F.col("rest"))
        edge = hist.groupBy("skey").agg(F.min(F.struct("b", "words", "n", "run", "was")).alias("e"))
        old = state
        state = save(
            old.drop("n", "lo", "hi", "base", "edge").join(edge, "skey", "left").select(
                "skey", "source_size", "target", "copies", "rest",
                F.shiftleft(F.coalesce("e.b", F.lit(0)), shift).alias("lo"),
                F.shiftleft(F.coalesce(F.col("e.b") + 1, F.lit(0)), shift).alias("hi"),
                (F.coalesce(F.col("e.was") + F.col("e.run") - F.col("e.words"), F.lit(0))).alias("base"),
                F.coalesce("e.n", F.lit(0)).alias("n"),
                F.coalesce("e.words", F.lit(0)).alias("edge"),
            ),
            "edge",
        )
        forget(old)
        if (state.agg(F.max("n")).first()[0] or 0) <= 1:
            break
    # the document or tie in which the budget ends is taken if that comes nearer
    over = F.col("base") + F.col("edge") - F.col("rest") < F.col("rest") - F.col("base")
    state = state.select("skey", "source_size", "target", "copies", F.when(over, F.col("hi")).otherwise(F.col("lo")).alias("until"))
    taken = F.when(F.col("size") > 0, F.col("copies") + F.when(F.col("h") < F.col("until"), 1).otherwise(0)).otherwise(0)
    taken = F.least(taken, F.lit(cap)).cast("long")
    out = rows.join(state, "skey")
    new = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": taken, "taken": taken * F.col("size")}
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])
