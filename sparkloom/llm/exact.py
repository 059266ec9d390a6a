"""Exact dedup: two passes with a Bloom filter, so that only possibly repeated hashes are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, UPPER, stored

LOG2_BITS = 25


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, nothing else. lower() is the faster way where a text is all ASCII, and the same there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_duplicates(docs: DataFrame, log2_bits: int = LOG2_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of docs (doc_id, text; others are ignored).

    Texts are equal when identical after lowering A-Z; null counts as empty. Of equal texts the largest doc_id
    stays: rows that repeat that doc_id with that text stand for one document and all have kept true. A null
    doc_id stays only where its whole group has none; keep_id is then null. An empty table gives no rows.

    The first pass counts, by partial aggregation, how many rows fall on each of 2**log2_bits cells under two hash
    functions, and keeps one bit for each cell with two or more: a Bloom filter of what may be repeated. It has at
    most 2**(log2_bits - 6) words for each function, so its broadcast is bounded whatever the input. In the second
    pass a row whose two bits are not both set is alone and passes through; the others are grouped by digest. A
    fuller filter lets more rows through to the grouping and changes no result. Texts are read once and never
    shuffled; a digest that a third of the rows share is counted by partial aggregation, and its partition in the
    join back is split by adaptive execution, both sides of that join being plain exchanges of stored tables.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256)).alias("digest")))
    mask = F.lit((1 << log2_bits) - 1)
    cells = [F.xxhash64("digest", F.lit(seed)).bitwiseAND(mask) for seed in (1, 2)]
    rows = rows.select("*", *(c.alias(f"cell{i}") for i, c in enumerate(cells)))
    filters = []
    for i in range(2):
        twice = rows.groupBy(F.col(f"cell{i}").alias("cell")).agg(F.count("*").alias("n")).where("n > 1")
        filters.append(
            twice.groupBy(F.shiftright("cell", 6).alias(f"word{i}")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias(f"bits{i}"))
        )
    probed = rows
    for i, f in enumerate(filters):
        probed = probed.withColumn(f"word{i}", F.shiftright(f"cell{i}", 6)).join(F.broadcast(f), f"word{i}", "left")
    hit = F.lit(True)
    for i in range(2):
        hit = hit & F.coalesce(F.expr(f"(shiftright(bits{i}, cast(cell{i} & 63 as int)) & 1) = 1"), F.lit(False))
    probed = stored(probed.select("doc_id", "digest", hit.alias("maybe")))
    maybe = probed.where("maybe").select("doc_id", "digest")
    groups = stored(maybe.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    repeated = maybe.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), sha)
    alone = probed.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    return repeated.unionAll(alone)
