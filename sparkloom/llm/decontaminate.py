"""Benchmark decontamination by templates: typed placeholders, hash-joined windows, consistent slots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import SEGMENT, bitmap, in_bitmap, map_batches, mixed, piece_hashes, small_side, stored, windows

NEED_BITS = 26
LITERAL, NUMBER, NAME, UNIT, EMPTY = range(5)
# Number words and unit words that count as slots.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNIT_WORDS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound "
    "pounds oz ounce ounces ton tons ml l liter liters litre litres gallon gallons meter meters metre metres kilometer "
    "kilometers kilometre kilometres s sec second seconds min minute minutes h hr hour hours day days week weeks month "
    "months year years dollar dollars cent cents euro euros usd eur percent degree degrees mph kmh watt watts volt volts"
).split()
# end of fixed values
_NUMBER = r"^[+-]?[$€£]?[0-9][0-9.,:/]*(st|nd|rd|th|%)?$"
_NUMBERS, _UNITS = pa.array(NUMBER_WORDS), pa.array(UNIT_WORDS)
#: Words of more bytes are hashed one by one.
LONG = 1 << 16
_EDGES = "!\"#%&'()*,./:;<=>?@[\\]^_`{|}~-"
_CODES = mixed(np.arange(1, 4, dtype=np.uint64))
#: The coding of words as written, beside 0 and 1, and what keeps its hashes apart from theirs.
WRITTEN = 2
_SALT = 0x9E3779B97F4A7C14


class Words:
    """The words of a batch of texts, bare punctuation left out: rows names each one's distinct word, text its text's number.

    For each distinct word low has it in lower case without punctuation at its ends, kind what it is, and three arrays its
    codes: with numbers masked, with names masked too, and as written. Distinct words are worked on all at once.
    """

    def __init__(self, texts: pa.Array) -> None:
        try:
            strings = texts.cast(pa.string())
        except pa.ArrowInvalid:  # not all UTF-8
            strings = pa.array([x and x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())
        words = pc.utf8_split_whitespace(pc.fill_null(strings, ""))
        found = pc.dictionary_encode(words.flatten())
        core = pc.utf8_trim(found.dictionary, _EDGES)
        self.low = pc.utf8_lower(core)
        self.written = _text_hashes(self.low)
        rest = pc.utf8_slice_codeunits(core, 1)
        name = _mask(pc.and_(pc.utf8_is_upper(pc.utf8_slice_codeunits(core, 0, 1)), pc.utf8_is_lower(rest)))
        digit = np.flatnonzero(_mask(pc.match_substring_regex(core, "[0-9]")))
        number = _mask(pc.is_in(self.low, _NUMBERS))
        number[digit] |= _mask(pc.match_substring_regex(core.take(pa.array(digit)), _NUMBER))
        self.kind = np.select([_mask(pc.equal(core, "")), number, _mask(pc.is_in(self.low, _UNITS)), name], [EMPTY, NUMBER, UNIT, NAME], LITERAL).astype(np.int8)
        self.plain = np.where(number, _CODES[0], self.written)
        self.masked = np.where(self.kind == NAME, _CODES[1], self.plain)
        rows = found.indices.to_numpy()
        text = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(words.offsets.to_numpy()))
        solid = self.kind[rows] != EMPTY
        self.rows, self.text = rows[solid], text[solid]

    def coded(self, coding: int) -> tuple[np.ndarray, np.ndarray]:
        """The words' codes in a coding, and which are slots; a unit word is one after a number only.

        As written no word is a slot.
        """
        kind = self.kind[self.rows]
        if coding == WRITTEN:
            return self.written[self.rows], np.zeros(len(kind), bool)
        slot = kind == NUMBER
        unit = np.zeros(len(kind), bool)
        unit[1:] = (kind[1:] == UNIT) & slot[:-1] & (self.text[1:] == self.text[:-1])
        codes = (self.masked if coding else self.plain)[self.rows]
        codes[unit] = _CODES[2]
        slot |= unit
        if coding:
            slot |= kind == NAME
        return codes, slot

    def slots(self, slot: np.ndarray, at: int, size: int) -> list[str]:
        """The slots among size words from at, in order."""
        return [self.low[int(self.rows[at + x])].as_py() for x in np.flatnonzero(slot[at : at + size])]


def _mask(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False).astype(bool)


def _text_hashes(texts: pa.StringArray) -> np.ndarray:
    """A 64-bit hash of each text, by differences of running sums over segments; of long ones one by one."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    out = np.zeros(len(texts), np.uint64)
    if not len(texts) or ends[0] == ends[-1]:
        return out
    raw = np.frombuffer(texts.buffers()[2], np.uint8)
    long = np.diff(ends) > LONG
    at = 0
    while at < len(texts):
        to = at + 1 if long[at] else int(np.searchsorted(ends, ends[at] + SEGMENT, "right")) - 1
        if long[at]:
            out[at] = xxhash.xxh3_64_intdigest(raw[ends[at] : ends[to]].tobytes())
        else:
            to = min(max(to, at + 1), at + int(np.argmax(long[at:])) if long[at:].any() else len(texts))
            out[at:to] = piece_hashes(raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
        at = to
    return out


def _hashes(codes: np.ndarray, slot: np.ndarray, text: np.ndarray, size: int, coding: int, k: int) -> np.ndarray:
    """Hash of each window of size words within a text, 0 elsewhere; 0 also where fewer than 3 words, or k - 2 if that is less,
    are literal: it says too little. Words as written say enough whatever they are.
    """
    if len(codes) < size:
        return np.zeros(0, np.uint64)
    found = windows(codes, size) | np.uint64(1)
    if coding == WRITTEN:
        found ^= np.uint64(_SALT)
    else:
        before = np.concatenate([[0], np.cumsum(~slot)])
        found[before[size:] - before[:-size] < min(3, k - 2)] = 0
    found[text[size - 1 :] != text[: len(found)]] = 0
    return found


COLUMNS = {"id": pa.int64(), "rk": pa.int64(), "coding": pa.int32(), "hash": pa.int64(), "pos": pa.int32(), "n": pa.int32(), "size": pa.int32(), "slots": pa.list_(pa.string())}


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), COLUMNS.values(), strict=True)], names=list(COLUMNS))


def _row_key(raw: bytes) -> int:
    return np.uint64(xxhash.xxh64_intdigest(raw, seed=42)).astype(np.int64).item()


def _item_rows(k: int):
    """id, rk, coding, hash, pos, n, size and slots of the windows of k words of each item, or of a shorter item's whole.

    As written only of an item that the first coding does not say all of, having a window of too few literals or a unit
    word in front. n is the number of an item's windows in the coding; slots holds the slots of a window as lower-case
    words, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Words(pa.array([raw], pa.binary()))
                if not len(words.rows):
                    continue
                size, rk, coded = min(len(words.rows), k), _row_key(raw), [words.coded(coding) for coding in range(3)]
                hashes = [_hashes(codes, slot, words.text, size, coding, k) for coding, (codes, slot) in enumerate(coded)]
                whole = (hashes[0] != 0).all() and words.kind[words.rows[0]] != UNIT
                for coding in range(2 if whole else 3):
                    found, slot = hashes[coding], coded[coding][1]
                    for pos in np.flatnonzero(found).tolist():
                        out.append((i, rk, coding, found[pos].astype(np.int64).item(), pos, int((found != 0).sum()), size, words.slots(slot, pos, size)))
            if out:
                yield _batch_of(out)

    return run


def _document_rows(k: int, needed: np.ndarray, sought: list[tuple[int, int]]):
    """The same for the windows of documents that may be sought: those of the codings and sizes in sought whose hash is in needed.

    A batch's words are coded and hashed together. Of windows under k words, equal ones come once a text; n is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            words = Words(batch.column(1))
            starts = np.searchsorted(words.text, np.arange(batch.num_rows))
            keys: dict[int, tuple] = {}
            for coding, size in sought:
                codes, slot = words.coded(coding)
                found = _hashes(codes, slot, words.text, size, coding, k)
                spots = np.flatnonzero(found)
                spots = spots[in_bitmap(needed, found[spots])]
                seen = set()
                for at in spots.tolist():
                    i = int(words.text[at])
                    if i not in keys:
                        keys[i] = batch.column(0)[i].as_py(), _row_key(batch.column(1)[i].as_py())
                    slots = words.slots(slot, at, size)
                    if size < k:
                        once = (i, found[at].item(), *slots)
                        if once in seen:
                            continue
                        seen.add(once)
                    out.append((*keys[i], coding, found[at].astype(np.int64).item(), int(at - starts[i]), 0, size, slots))
            if out:
                yield _batch_of(out)

    return run


WINDOW_SCHEMA = "id long, rk long, coding int, hash long, pos int, n int, size int, slots array<string>"


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, least_windows: int = 9, least_share: float = 0.5) -> DataFrame:
    """doc_id, text_hash, item_id, matched, windows, coverage and reparameterised for each leak of an item into a text.

    docs has doc_id and text, benchmark item_id and text; other columns are ignored. Words are lower-cased and freed
    of punctuation at their ends; numbers and units become placeholders, in a second coding capitalised words too,
    as names. A document holds an item if, in one coding, the windows of k words that both have number at least
    least_windows, or least_share of the item's windows if that is less, counting only windows whose slots agree:
    where an item lies against a text, each value of the item's slots is answered by the value that most of its
    windows there have; windows that have another are not counted, unless all their slots are as in the item. Where
    parts of an item lie apart, the longest part's answers hold for the others too. matched
    counts the distinct item windows found and coverage is their share; reparameterised says that in some counted
    window a slot's value differs.
    text_hash is xxhash64 of the text, which tells rows with one doc_id apart; rows that repeat both count as one.
    Null and blank texts and items have no windows and match nothing; an item under k words is one window, sought in
    texts of any length. Windows of fewer than 3 literal words count in neither coding; an item with such windows is
    sought in a third coding too, all its words as written, so that a copy of its words is always found, be it all
    numbers or one word. Empty tables give no rows. A null doc_id or item_id is carried as null.

    A bitmap of the items' window hashes, of fixed size, goes to the documents' scan, which emits only windows that
    may be sought, usually few; false hits cost time only. These are hash-joined with the items' windows, which are
    broadcast if a count proves them few; else adaptive execution splits the partition of a frequent passage.
    """
    def text_of(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col(key).cast("long").alias("id"), F.col("text").cast("binary").alias("text"))

    items = stored(map_batches(text_of(benchmark, "item_id"), _item_rows(k), WINDOW_SCHEMA))
    needed = bitmap(items, F.col("hash"), NEED_BITS)
    sizes = sorted((r.coding, r["size"]) for r in items.select("coding", "size").distinct().collect())
    hits = stored(map_batches(text_of(docs, "doc_id"), _document_rows(k, needed, sizes), WINDOW_SCHEMA).drop("n", "size"))
    sought = small_side(items.select("coding", "hash", F.col("id").alias("item_id"), F.col("rk").alias("item_rk"), F.col("pos").alias("item_pos"), F.col("n").alias("windows"), F.col("slots").alias("item_slots")))
    met = hits.join(sought, ["coding", "hash"]).withColumn("pairs", F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")))
    group = ["id", "rk", "coding", "item_id", "item_rk"]
    shift = [*group, "shift"]
    # the same placeholder window may stand in several places; each shift of an item against the text has its own answers
    per_shift = met.withColumn("shift", F.col("pos") - F.col("item_pos")).groupBy(*shift)
    windows_met = per_shift.agg(F.collect_set(F.struct("item_pos", "pairs")).alias("met"), F.max("windows").alias("windows")).select(*shift, "windows", F.inline("met"))
    slots = windows_met.select(*shift, "windows", "item_pos", F.explode_outer("pairs").alias("p")).select(*shift, "windows", "item_pos", "p.i", "p.d")
    votes = slots.withColumn("votes", F.count("*").over(W.partitionBy(*shift, "i", "d"))).withColumn("same", F.col("i").eqNullSafe(F.col("d")))
    # an item's slot value is answered by the document's value that most windows have; of equals by itself, then the largest
    answer = F.max(F.struct("votes", "same", "d")).over(W.partitionBy(*shift, "i"))["d"]
    answered = votes.withColumn("agrees", F.col("d").eqNullSafe(answer))
    # the shift with most agreeing windows answers for the others: what contradicts it there does not count
    at_shift, at_window = W.partitionBy(*shift), W.partitionBy(*shift, "item_pos")
    counted = F.bool_and("agrees").over(at_window) | F.bool_and("same").over(at_window)
    answered = answered.withColumn("size", F.size(F.collect_set(F.when(counted, F.col("item_pos"))).over(at_shift)))
    first = F.max(F.struct("size", -F.col("shift"))).over(W.partitionBy(*group)) == F.struct("size", -F.col("shift"))
    said = F.max(F.when(first & F.col("agrees"), F.struct("d"))).over(W.partitionBy(*group, "i"))
    answered = answered.withColumn("agrees", F.col("agrees") & (said.isNull() | F.col("d").eqNullSafe(said["d"])))
    kept = answered.groupBy(*shift, "item_pos").agg(F.max("windows").alias("windows"), F.bool_and("agrees").alias("agrees"), F.bool_and("same").alias("same")).where("agrees or same")
    joined = kept.groupBy(*group).agg(
        F.size(F.collect_set("item_pos")).alias("matched"), F.max("windows").alias("windows"), F.max(~F.col("same")).alias("reparameterised")
    )
    enough = joined.where((F.col("matched") >= least_windows) | (F.col("matched") >= F.ceil(F.lit(least_share) * F.col("windows"))))
    best = enough.groupBy("id", "rk", "item_id").agg(F.max(F.struct("matched", "windows", F.expr("not reparameterised").alias("same"))).alias("m"))
    return best.select(
        F.col("id").alias("doc_id"), F.col("rk").alias("text_hash"), "item_id", "m.matched", "m.windows",
        (F.col("m.matched") / F.col("m.windows")).alias("coverage"), (~F.col("m.same")).alias("reparameterised"),
    )
