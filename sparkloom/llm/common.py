"""Shared storage, sketches and word hashing of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.storage import stored, workspace  # noqa: F401  for the operators

#: What separates words: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Most bytes of rows that a Python worker is given at once, unless the session has a bound of its own.
BATCH_BYTES = 2 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """df marked for broadcast if its rows, summed up, prove to hold at most most_bytes, else df as it is.

    Numbers count 16 bytes, texts their length more, lists and structs the length of their JSON form more. Without the
    mark the join shuffles both sides and adaptive execution splits its skewed partitions.
    """
    size = F.lit(16 * len(df.columns)).cast("long")
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind in ("array", "struct", "map"):
            size = size + F.octet_length(F.to_json(F.struct(f.name)))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most_bytes else df


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema) over batches of about BATCH_BYTES, or of one row that is longer.

    Spark's own bound is 64 MB, held on the JVM's side and several times over in each worker. The bound is a setting
    of the session, left as it is where the session sets it.
    """
    conf, bound = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(bound, None) is None:
        conf.set(bound, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def bitmap(df: DataFrame, key: Column, log2_bits: int) -> np.ndarray:
    """One bit for each value of key modulo 2**log2_bits, as 64-bit words.

    The size is fixed by log2_bits whatever df holds. A set bit can be a false hit, an unset one proves absence.
    """
    spot = key.bitwiseAND(F.lit((1 << log2_bits) - 1))
    rows = (
        df.select(spot.alias("spot"))
        .groupBy(F.shiftright("spot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits"))
        .toArrow()
    )
    words = np.zeros(1 << (log2_bits - 6), np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return words


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each 64-bit key, whether its bit is set."""
    spot = keys & np.uint64(len(words) * 64 - 1)
    return (words[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, elementwise."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def factors(k: int) -> np.ndarray:
    """k odd 64-bit numbers."""
    return mixed(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_FACTORS = factors(64)
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A number for each byte; upper case A-Z as lower, blanks 0.
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BYTES[65:91] = _BYTES[97:123]
_BYTES[_BLANK] = 0
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SEGMENT = 1 << 20


def _raised(n: int) -> list[np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, np.uint64(base))
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def _segment_hashes(raw: np.ndarray) -> np.ndarray:
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = _BLANK[raw]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edges[0::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _raised(max(len(raw), 4096))
    sums = _BYTES[raw]
    sums *= up[: len(raw)]
    sums = np.cumsum(sums)[end - 1]
    sums[1:] -= sums[:-1].copy()
    return mixed(sums * down[start])


def piece_hashes(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of bytes between neighbouring ends, as word_hashes gives a word; 0 of an empty run."""
    up, down = _raised(max(len(raw) + 1, 4096))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * up[: len(raw)], out=sums[1:])
    return mixed((sums[ends[1:]] - sums[ends[:-1]]) * down[ends[:-1]])


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hash of each run of bytes other than blanks, A-Z lowered, in order.

    A word's hash is a polynomial in random numbers for its bytes, from differences of one running sum over the
    text, then mixed. Long texts go by segments that end between words.
    """
    if not text:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(text, np.uint8)
    if len(raw) <= SEGMENT:
        return _segment_hashes(raw)
    found, at = [], 0
    while at < len(raw):
        size = SEGMENT
        while True:
            end = min(len(raw), at + size)
            cut = end if end == len(raw) else at + int(np.flatnonzero(np.append(True, _BLANK[raw[at:end]]))[-1])
            if cut > at:
                break
            size *= 2
        found.append(_segment_hashes(raw[at:cut]))
        at = cut
    return np.concatenate(found)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, in order; of the whole sequence where it is shorter, none where it is empty."""
    n = len(words)
    if not n:
        return words
    size = min(n, k)
    total = words[: n - size + 1] * _FACTORS[0] + np.uint64(size)
    for i in range(1, size):
        total += words[i : n - size + 1 + i] * _FACTORS[i]
    return mixed(total)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order."""
    if len(x) < 2:
        return x
    x = np.sort(x)
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]
