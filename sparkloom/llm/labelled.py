"""What the two classifiers share: a bounded labelled sample, and the map that scores documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_batches

#: Most bytes of a text that teaches: what reaches the driver is at most so many for each row of the sample.
LONGEST = 1 << 18


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, trainable: Column, sample_rows: int
) -> tuple[list[bytes], np.ndarray]:
    """At most sample_rows labelled texts, half for each label, those first by a hash of doc_id.

    The rows are chosen among the labels alone, so the documents are read once and never shuffled: the chosen
    identifiers, bounded by sample_rows, are broadcast to the scan. Of rows that share a doc_id the smallest text
    teaches; texts of more than LONGEST bytes do not. The same rows give the same sample, however they are partitioned.
    """
    known = (
        labels.where(trainable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("_y"))
    )
    order = F.xxhash64("doc_id")
    half = sample_rows // 2
    chosen = (
        known.where("_y = 0").orderBy(order, "doc_id").limit(half)
        .unionAll(known.where("_y = 1").orderBy(order, "doc_id").limit(half))
    )
    rows = (
        documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_t"))
        .where(F.octet_length("_t") <= LONGEST)
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("_t").alias("_t"), F.max("_y").alias("_y"))
        .toArrow()
    )
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    texts, y = rows["_t"].to_pylist(), rows["_y"].to_numpy().astype(np.float64)
    return [texts[i] for i in order], y[order]


def score_documents(documents: DataFrame, score: Callable[[list[bytes]], np.ndarray], threshold: float) -> DataFrame:
    """doc_id, score and predicted for every row, by one map in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.asarray(score(batch.column(1).to_pylist()), np.float64)
            yield pa.record_batch(
                [batch.column(0), pa.array(got), pa.array((got >= threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return map_batches(texts, run, "doc_id long, score double, predicted int")


def keep_scored(documents: DataFrame, score: Callable[[list[bytes]], np.ndarray], threshold: float) -> DataFrame:
    """The rows of documents, with all their columns, whose text scores threshold or more; one map, no shuffle."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array(np.asarray(score(texts)) >= threshold))

    return map_batches(documents, run, documents.schema)
