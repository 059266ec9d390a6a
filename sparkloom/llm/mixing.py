"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, small_side, stored

EPOCHS = 3


def in_turn(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating, for sources ranked from 1 by code point, null last."""
    return F.pmod(rank - 1, F.lit(3)) + 1


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, from 1 by key: rows are numbered within range partitions, whose sizes alone are summed in one place."""
    parts = stored(sources.repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    before = F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("part").agg(F.count("*").alias("rows")).select("part", before.alias("before"))
    within = F.row_number().over(W.partitionBy("part").orderBy("key"))
    return parts.withColumn("within", within).join(small_side(starts), "part").withColumn("rank", F.col("before") + F.col("within")).drop("part", "within", "before")


def source_targets(sources: DataFrame, weight=in_turn, share: float = 1.0, epochs: int = EPOCHS) -> DataFrame:
    """Adds weight, budget and target to sources (key, source_size): share of all words, split by weight.

    No target exceeds epochs times its source's size. What that cuts off is shared among the others by weight until
    none is above: the level L with sum(min(L * weight, epochs * size)) = share * total. L starts as if nothing were cut
    off and rises by rounds, each one small aggregate over the sources, until a round cuts off no more of them.
    """
    limit = F.lit(epochs) * F.col("source_size")
    ranked = stored(_ranked(sources).withColumn("weight", weight(F.col("rank")).cast("double")).withColumn("ratio", limit / F.col("weight")).drop("rank"))
    total, top = ranked.agg(F.sum("source_size"), F.max("ratio")).first()
    budget, level, cut = share * (total or 0), 0.0, -1
    while True:
        over = F.col("ratio") < F.lit(level)
        now, taken, weights = ranked.agg(F.count(F.when(over, 1)), F.sum(F.when(over, limit).otherwise(0)), F.sum(F.when(~over, F.col("weight")))).first()
        if now == cut:
            break
        if not weights:
            level = top or 0.0
            break
        cut, level = now, (budget - taken) / weights
    target = F.least(F.lit(float(level)) * F.col("weight"), limit.cast("double"))
    return ranked.withColumn("budget", F.lit(float(budget))).withColumn("target", target).drop("ratio")


def mixture(docs: DataFrame, weight=in_turn, share: float = 1.0, epochs: int = EPOCHS, seed: int = 17) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, weight, target, finish, copies, taken and row_hash.

    docs needs doc_id, text and source; other columns are ignored. size counts words; null text has 0. A null source
    is a source of its own, after all others; an empty string is another. copies (0 to epochs) says how often the
    mix takes the document, taken how many words that is; finish is the virtual finish time of its first copy.
    Rows without words, and all rows of an input without words, are taken 0 times. An empty table gives no rows.
    Rows that repeat a doc_id are mixed one by one, in the order of row_hash, a hash of source and text; equal ones are
    interchangeable.

    Within a source, documents stand in the order of a seeded hash of doc_id, without one of row_hash, the same in each
    epoch. A copy's
    virtual finish time is the words of its source up to its end, divided by the source's target. All copies are
    sorted by finish time over range partitions, and the mix is the longest start of that order that does not
    exceed the sum of targets. No word count is summed in one task: within a source by hash buckets, of which
    there are about the square root of the number of rows, so that both a bucket's rows and a source's buckets
    stay few; over the finish times by partition totals, only the partition in which the budget ends being summed
    row by row. Two numbers (rows and budget) and the last copy taken reach the driver.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("~"))  # "~" sorts after "="
    row_hash = F.xxhash64("source", "text")
    rows = stored(
        docs.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            key.alias("key"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            row_hash.alias("row_hash"),
            F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("long"), row_hash)).alias("spot"),
        )
    )
    bits = max(0, (rows.count().bit_length() + 1) // 2)
    rows = rows.withColumn("bucket", F.shiftrightunsigned("spot", 64 - bits) if bits else F.lit(0).cast("long"))
    buckets = stored(rows.groupBy("key", "bucket").agg(F.sum("size").alias("bucket_size")))
    sources = stored(source_targets(buckets.groupBy("key").agg(F.sum("bucket_size").alias("source_size")), weight, share, epochs))
    earlier = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = stored(buckets.withColumn("start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).join(sources, "key").drop("bucket_size"))
    so_far = W.partitionBy("key", "bucket").orderBy("spot", "id", "row_hash").rowsBetween(W.unboundedPreceding, 0)
    queued = stored(rows.join(starts, ["key", "bucket"]).withColumn("end", F.col("start") + F.sum("size").over(so_far)).drop("start", "bucket"))

    def finish(epoch: Column) -> Column:
        return (epoch * F.col("source_size") + F.col("end")) / F.col("target")

    order = ["finish", "key", "epoch", "spot", "id", "row_hash"]
    copies = (
        queued.where("size > 0 and target > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .select("size", finish(F.col("epoch")).alias("finish"), *order[1:])
    )
    ranged = stored(copies.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("words"))
    before = totals.withColumn("before", F.coalesce(F.sum("words").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    budget = sources.agg(F.max("budget")).first()[0] or 0.0
    edge = before.where(F.col("before") <= F.lit(budget)).orderBy(F.desc("part")).limit(1).collect()
    last = None
    if edge:
        part, words_before = edge[0]["part"], edge[0]["before"]
        running = F.lit(words_before) + F.sum("size").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
        inside = ranged.where(F.col("part") == part).withColumn("running", running).where(F.col("running") <= F.lit(budget * (1 + 1e-12)))
        earlier_parts = ranged.where(F.col("part") == part - 1)
        last = inside.agg(F.max(F.struct(*order))).first()[0] or earlier_parts.agg(F.max(F.struct(*order))).first()[0]
    taken = F.lit(0)
    if last is not None:
        limit = F.struct(*(F.lit(last[x]).alias(x) for x in order))
        for epoch in range(epochs):
            one = F.struct(finish(F.lit(epoch)).alias("finish"), "key", F.lit(epoch).alias("epoch"), *order[3:])
            taken = taken + F.when((F.col("size") > 0) & (F.col("target") > 0) & (one <= limit), 1).otherwise(0)
    return queued.withColumn("copies", taken.cast("int")).select(
        "doc_id", "source", "size", "source_size", "weight", "target",
        F.when(F.col("target") > 0, F.col("end") / F.col("target")).alias("finish"),
        "copies", (F.col("copies") * F.col("size")).alias("taken"), "row_hash",
    )
