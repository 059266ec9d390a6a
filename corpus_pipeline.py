"""A training corpus from documents: quality, line dedup, near-duplicates, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloom.llm import decontaminate, jaccard, lines, mixing, quality
from sparkloom.llm.common import small_side, stored, table

# Of every stage: documents needs doc_id, text and source, all of which may be null; other columns pass through, whatever
# their names. An empty table gives an empty table. Rows are told apart by doc_id and text, so rows that repeat both
# share a decision.


def _unused(docs: DataFrame, name: str) -> str:
    """name, with as many underscores as it takes not to be a column of docs."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _joined(docs: DataFrame, rows: DataFrame, mark: Column, kind: str) -> DataFrame:
    """docs joined on doc_id, null or not, and the hash mark with rows (doc_id, mark and perhaps more columns)."""
    theirs = {c: _unused(docs, f"{c}__") for c in ("doc_id", "mark")}
    rows = rows.withColumnsRenamed(theirs)
    same = docs["doc_id"].cast("long").eqNullSafe(rows[theirs["doc_id"]]) & (mark == rows[theirs["mark"]])
    return docs.join(small_side(rows), same, kind).drop(*theirs.values())


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives at least an even chance of being good; a null or blank text is scored as such.

    It learns from the labelled rows outside a fixed quarter, as query op6 does. Without labels all rows stay.
    """
    trainable = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"), trainable)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on eight or more sources, passages too, stay only where they occur first; n_chars, if there, follows the text.

    Fewer sources, as query op7 has for passages, would hollow out copies of whole documents, which the next stage takes
    out better. No row goes; a null text stays null.
    """
    cut = lines.without_spread_lines(docs, passage_sites=8, removed=_unused(docs, "removed"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(cut["text"].isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*(F.col(f"`{c}`") for c in docs.columns))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one with the smallest doc_id.

    Documents without a doc_id come after those with one. Null and blank texts all stay.
    """
    surplus = stored(jaccard.surplus_rows(docs, jaccard.Rule(words=5, percent=80)).withColumnRenamed("text_hash", "mark"))
    return _joined(docs, surplus, F.xxhash64(docs["text"]), "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and blank texts hold none."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    leaks = stored(found.select("doc_id", F.col("text_hash").alias("mark")).distinct())
    return _joined(docs, leaks, F.xxhash64(docs["text"]), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies, how often, and finish, the virtual finish time of the first.

    A null source is a source of its own. Null and blank texts are never taken. Rows that repeat doc_id, source and text
    share the decision of that one which the mix takes most. Where documents have a column named copies or finish,
    the new one's name gets an underscore.
    """
    taken = mixing.mixture(docs).where("copies > 0").groupBy("doc_id", F.col("row_hash").alias("mark"))
    names = {c: _unused(docs, c) for c in ("copies", "finish")}
    decisions = stored(taken.agg(F.max("copies").alias(names["copies"]), F.min("finish").alias(names["finish"])))
    return _joined(docs, decisions, F.xxhash64(docs["source"], docs["text"]), "inner")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: The classifier and the mix's hash order are beyond SQL. Tests hold every stage against plain Python, on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
