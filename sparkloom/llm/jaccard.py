"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import bitmap, distinct, in_bitmap, map_batches, mixed, small_side, stored, windows, word_hashes
from .components import components

#: Buckets of the sketches of shingle and of word frequencies, and how many of them make a row of it.
SHINGLE_BITS, WORD_BITS = 18, 16
CHUNK = 1 << 14
NEED_BITS = 26
#: A tile holds at most so many rows a side, and about so many shingles.
TILE_ROWS = 1024
TILE_SHINGLES = 1 << 21
MOST_SIGNATURE_BITS = 1 << 16
#: Which sides of a tile meet.
MEET = np.zeros((4, 4), bool)
MEET[[0, 1, 2, 2, 3], [1, 0, 2, 3, 2]] = True


@dataclass(frozen=True)
class Rule:
    """Words in a shingle, and the least similarity as a fraction over 100."""

    words: int = 5
    percent: int = 80

    def shingles(self, hashes: np.ndarray) -> np.ndarray:
        """The distinct shingles in ascending order."""
        return distinct(windows(hashes, self.words))

    def prefix(self, n: int) -> int:
        """So many of a set's first elements, in any order common to all sets, meet those of each linked set."""
        return n - -(-self.percent * n // 100) + 1

    def least_overlap(self, total: np.ndarray) -> np.ndarray:
        """The overlap that sets of this total size need: 100 i >= p (total - i)."""
        return -(-self.percent * total // (100 + self.percent))

    def bands(self) -> np.ndarray:
        """The smallest set size of each size band: sets that link lie in one band or in two neighbouring ones.

        The band after one that starts at t starts at the first size too large to link with t.
        """
        starts = [1]
        while starts[-1] < 1 << 40:
            starts.append(100 * starts[-1] // self.percent + 1)
        return np.array(starts)


def signature(shingles: np.ndarray) -> bytes:
    """A bitmap with the parity of the number of shingles hashed to each bit; as many bits as shingles, to a power of 2.

    Two sets differ in at least as many elements as their bitmaps in bits, however many bits are set.
    """
    width = min(MOST_SIGNATURE_BITS, max(64, 1 << (len(shingles) - 1).bit_length()))
    spots = (shingles & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(spots, minlength=width) & 1).astype(bool), bitorder="little").tobytes()


def folded(bits: bytes, width: int) -> np.ndarray:
    """The bitmap at a smaller width."""
    words = np.frombuffer(bits, np.uint64)
    while len(words) * 64 > width:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _node(shingles: np.ndarray) -> int:
    return np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64).item()


def _describe(rule: Rule):
    """Of each document: row key, class, set size and signature; at the end counts of the shingles and words seen, by bucket.

    A task's counts go up to 65535, so that what is sent is of fixed size; kind 1 marks the shingles' rows and kind 2 the
    words', n being the chunk.
    """
    names = ["doc_id", "text_hash", "node", "n", "bits", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(1 << SHINGLE_BITS, np.int64), np.zeros(1 << WORD_BITS, np.int64)]
        for batch in batches:
            nodes, sizes, bits, spots = [], [], [], ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
            for text in batch.column(2).to_pylist():
                words = word_hashes(text)
                found = rule.shingles(words)
                for spot, x, count in zip(spots, (found, words), seen, strict=True):
                    spot.append(_signed(x & np.uint64(len(count) - 1)))
                nodes.append(_node(found) if len(found) else None)
                sizes.append(len(found))
                bits.append(signature(found) if len(found) else None)
            for count, spot in zip(seen, spots, strict=True):
                count += np.bincount(np.concatenate(spot), minlength=len(count))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(np.zeros(len(sizes), np.int32))], names=names)
        for kind, count in enumerate(seen, 1):
            if count.any():
                parts = np.minimum(count, 65535).astype(np.uint16).reshape(-1, CHUNK)
                none = pa.nulls(len(parts), pa.int64())
                yield pa.record_batch([none, none, none, pa.array(np.arange(len(parts))), pa.array([x.tobytes() for x in parts], pa.binary()), pa.array(np.full(len(parts), kind, np.int32))], names=names)

    return run


def _counts(chunks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The counts of all shingle buckets and of all word buckets, from chunk rows (kind, n, bits) of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for kind, n, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total.setdefault((kind, n), np.zeros(CHUNK, np.int64))
                total[kind, n] += np.frombuffer(bits, np.uint16)
        if total:
            kind, n = zip(*total, strict=True)
            yield pa.record_batch([pa.array(kind, pa.int32()), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["kind", "n", "bits"])

    out = np.zeros(1 << SHINGLE_BITS, np.int64), np.zeros(1 << WORD_BITS, np.int64)
    rows = map_batches(chunks.select("kind", "n", "bits").repartition("kind", "n"), run, "kind int, n long, bits binary").toArrow()
    for kind, n, bits in zip(*(rows[c].to_pylist() for c in ("kind", "n", "bits")), strict=True):
        out[kind - 1][n * CHUNK : (n + 1) * CHUNK] = np.frombuffer(bits, np.int64)
    return out


def _weights(counts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """By shingle bucket how far its count stands out from the others', as a power of 2 of their spread; by word bucket the
    logarithm of its count."""
    shingles, words = counts
    usual = np.median(shingles)
    out = np.maximum(shingles - usual, 0) / (4 * np.sqrt(usual) + 1)
    return np.minimum(np.log2(1 + out), 15).astype(np.uint64), (8 * np.log2(1 + words)).astype(np.uint64)


def _prefixes(rule: Rule, weights: tuple[np.ndarray, np.ndarray], needed: np.ndarray | None = None):
    """key, node and sized (set size, and above 40 bits of it the size band) for the first shingles of each set, the rare ones first.

    With needed, a bitmap, only the keys that it may hold.

    A shingle's key is its weight above 49 bits of its hash, and the order is that of the keys: the same for all
    documents, which is all that the join's correctness needs. The weight is first that of its bucket, which shows what
    many documents share, then the sum of its words'. A class met again in a task is left out.
    """
    bands = rule.bands()
    often, word_weights = weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            keys, nodes, sizes = [], [], []
            for text in batch.column(0).to_pylist():
                words = word_hashes(text)
                if not len(words):
                    continue
                hashes = windows(words, rule.words)
                found = distinct(hashes)
                node = _node(found)
                if node in done:
                    continue
                done.add(node)
                one = word_weights[words & np.uint64(len(word_weights) - 1)]
                heavy = one[: len(hashes)].copy()
                for i in range(1, len(words) - len(hashes) + 1):
                    heavy += one[i : i + len(hashes)]
                weight = often[hashes & np.uint64(len(often) - 1)] << np.uint64(11) | np.minimum(heavy, np.uint64(2047))
                take = distinct(weight << np.uint64(49) | hashes >> np.uint64(15))[: rule.prefix(len(found))]
                if needed is not None:
                    take = take[in_bitmap(needed, take)]
                keys.append(_signed(take))
                nodes.append(np.full(len(take), node, np.int64))
                sizes.append(np.full(len(take), len(found), np.int64))
            if keys:
                n = np.concatenate(sizes)
                sized = n | np.searchsorted(bands, n, "right") << 40
                yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes)), pa.array(sized)], names=["key", "node", "sized"])

    return run


def _sets(rule: Rule, needed: np.ndarray):
    """node and sorted shingles of the rows whose identifier may be needed; a class met again in a task is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            wanted = np.flatnonzero(in_bitmap(needed, batch.column(0).to_numpy().view(np.uint64)))
            rows = []
            for text in batch.column(1).take(pa.array(wanted)).to_pylist():
                found = rule.shingles(word_hashes(text))
                if len(found) and (node := _node(found)) not in done:
                    done.add(node)
                    rows.append((node, found.tobytes()))
            if rows:
                node, items = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(node, pa.int64()), pa.array(items, pa.binary())], names=["node", "items"])

    return run


def _joined_in_tile(rule: Rule, n: np.ndarray, comp: np.ndarray, side: np.ndarray, bits: list[bytes], items: list[np.ndarray] | None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Labels of the rows after joining what is linked, and the links used.

    Rows of side 0 meet those of side 1, rows of side 2 each other and those of side 3. A pair whose rows are joined already is
    passed over, so that a clique costs one link a row. Signatures bound the overlap from above; with items, the
    pairs left are settled by intersecting the sorted arrays, without they count as links.
    """
    order = np.argsort(n, kind="stable")
    n, side = n[order], side[order]
    label = np.unique(comp[order], return_inverse=True)[1]
    width = min(len(b) for b in bits) * 8
    matrix = np.stack([folded(bits[i], width) for i in order])
    found = []
    ends = np.searchsorted(n, n * 100 // rule.percent, "right")
    for i in range(len(n) - 1):
        rest = np.arange(i + 1, ends[i])
        rest = rest[(label[rest] != label[i]) & MEET[side[i]][side[rest]]]
        if not len(rest):
            continue
        total = n[rest] + n[i]
        apart = np.bitwise_count(matrix[rest] ^ matrix[i]).sum(1, dtype=np.int64)
        for j in rest[(total - apart) // 2 >= rule.least_overlap(total)].tolist():
            if label[j] == label[i]:
                continue
            if items is not None:
                common = len(np.intersect1d(items[order[i]], items[order[j]], assume_unique=True))
                if 100 * common < rule.percent * (n[i] + n[j] - common):
                    continue
            found.append((int(order[i]), int(order[j])))
            label[label == label[j]] = label[i]
    labels = np.empty_like(label)
    labels[order] = label
    return labels, found


def _over_tiles(one_tile, columns: list[str], schema: pa.Schema):
    """A map over rows that come sorted by tile, of which one may go on in the next batch; tiles of one row are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            tiles = table["tile"].to_numpy()
            last = int(np.flatnonzero(tiles == tiles[-1])[0]) if len(tiles) else 0
            rest = table.slice(last)
            if last:
                yield from whole(table.slice(0, last))
        if rest is not None and len(rest):
            yield from whole(rest)

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        tile = table["tile"].to_numpy()
        cols = [table[c].to_numpy() if table.schema.field(c).type == pa.int64() else table[c].to_pylist() for c in columns]
        starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        out: list[tuple] = []
        for at, to in zip(starts.tolist(), [*starts[1:].tolist(), len(tile)], strict=True):
            if to - at > 1:
                out += one_tile(int(tile[at]), *(c[at:to] for c in cols))
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _by_tile(rows: DataFrame, run, schema: str) -> DataFrame:
    return map_batches(rows.repartition("tile").sortWithinPartitions("tile"), run, schema)


def _tile_links(rule: Rule, tiles: DataFrame, classes: DataFrame, sets_of) -> DataFrame:
    """Links a and b that join what is linked within tiles (tile, node, comp, side).

    First by signatures alone, small beside the sets: what they may join within a tile forms a group. A group that
    several tiles propose is one group. Then the sets of the groups' rows are read from the text, and each group is
    settled exactly, as a tile of its own in which all rows meet.
    """

    def propose(tile, node, comp, side, n, bits):
        labels, found = _joined_in_tile(rule, n, comp, side, bits, None)
        out = []
        for label in {labels[i] for i, _ in found}:
            met = np.flatnonzero(labels == label)
            group = xxhash.xxh3_64_intdigest(np.sort(node[met]).tobytes())
            out += [(np.uint64(group).astype(np.int64).item(), int(node[i]), int(comp[i]), int(n[i])) for i in met]
        return out

    def settle(tile, node, comp, n, items):
        sets = [np.frombuffer(x, np.uint64) for x in items]
        found = _joined_in_tile(rule, n, comp, np.full(len(n), 2), [signature(x) for x in sets], sets)[1]
        return [(int(node[i]), int(node[j])) for i, j in found]

    rows = tiles.join(classes.select("node", "n", "bits"), "node").select("tile", "node", "comp", "side", "n", "bits")
    proposed = pa.schema([(c, pa.int64()) for c in ("tile", "node", "comp", "n")])
    groups = stored(_by_tile(rows, _over_tiles(propose, ["node", "comp", "side", "n", "bits"], proposed), "tile long, node long, comp long, n long").distinct())
    rows = sets_of(groups.select("node").distinct()).join(small_side(groups), "node").select("tile", "node", "comp", "n", "items")
    links = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return stored(_by_tile(rows, _over_tiles(settle, ["node", "comp", "n", "items"], links), "a long, b long"))


def linked_rows(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, text_hash, n_shingles, root and component_id for every row of docs (doc_id, text; other columns are ignored).

    A document's set holds the distinct shingles of its lower-cased (A-Z) words; a text with fewer words than a
    shingle has one, its whole sequence; a null or blank text has none and links with nothing. Two documents link
    when 100 * intersection >= percent * union. component_id is the smallest doc_id that links reach, the
    document's own included; root tells components apart, those without any doc_id too, and is null where the set
    is empty. Documents of equal sets form one class, linked at once. Rows that repeat a doc_id stay separate rows;
    rows without doc_id link as others do, but count for no component's smallest. text_hash is xxhash64 of the text.
    An empty table gives no rows.

    How no link is lost: two linked sets share a shingle among the first prefix(n) of an order common to all, so
    they meet under that key, in tiles of one size band or two neighbouring ones. The order is by sketches of the
    shingles' and the words' frequencies, so what many documents share comes last and rarely is a key. Tiles hold at
    most TILE_ROWS rows a side; a key with more rows is cut into slices. Two cheap rounds first join what meets in one
    slice under a class's smallest key; keys whose rows are then all joined need no more work. For the others every
    pair of slices is compared, signatures first: R classes that stay apart under one key cost R * R / TILE_ROWS rows.
    Within a tile, pairs joined already are passed over, so a group of copies costs links in proportion to its size,
    and signatures alone decide whose sets are fetched.

    The text is read four times, or five; shuffled are keys, identifiers, signatures, and the sets of what signatures
    could not tell apart. Keys that two classes share are found by partial aggregation and a join, which adaptive
    execution can split and before which a bitmap of them leaves out most others. What reaches the driver are tables
    of fixed size: shingle and word counts by bucket, and bitmaps of shared keys and of needed texts, in which false
    hits cost time only.

    Shingles and classes are told apart by 64-bit hashes.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    own_id = F.coalesce("doc_id", "text_hash").alias("id")
    described = stored(map_batches(texts, _describe(rule), "doc_id long, text_hash long, node long, n long, bits binary, kind int"))
    sets = described.where("kind = 0").select("doc_id", "text_hash", "node", "n")
    weights = _weights(_counts(described.where("kind > 0")))
    classes = stored(
        described.where("kind = 0 and node is not null").groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.min(own_id).alias("id"), F.min("n").alias("n"), F.min("bits").alias("bits"))
    )

    def keys(needed: np.ndarray | None = None) -> DataFrame:
        return map_batches(texts.select("text"), _prefixes(rule, weights, needed), "key long, node long, sized long")

    shared = stored(keys().groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("key"))
    member = stored(stored(keys(bitmap(shared, F.col("key"), NEED_BITS)).join(shared, "key")).distinct())

    def sets_of(nodes: DataFrame) -> DataFrame:
        """node and items, at least of these nodes, by one more pass over the text."""
        needed = bitmap(nodes.join(classes, "node"), F.col("id"), NEED_BITS)
        return stored(map_batches(texts.select(own_id, "text"), _sets(rule, needed), "node long, items binary"))

    band, size = F.shiftright("sized", 40).cast("int"), F.col("sized").bitwiseAND(F.lit((1 << 40) - 1))
    slices_of = F.greatest(F.ceil(F.count("*") / TILE_ROWS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    # rounds in slices, under the smallest key by either of two orders
    firsts = [F.min(F.xxhash64("key", F.lit(seed))).alias(f"first{seed}") for seed in (1, 2)]
    own = stored(member.groupBy("node").agg(*firsts, F.min("sized").alias("sized")).select("node", "first1", "first2", size.alias("n"), band.alias("band")))
    rounds = []
    for seed in (1, 2):
        one = own.select("node", "n", F.xxhash64(f"first{seed}", "band", F.lit(seed)).alias("spot"))
        many = one.groupBy("spot").agg(F.count("*").alias("rows"), slices_of.alias("slices")).where("rows > 1")
        slice_ = F.pmod(F.xxhash64("node", F.lit(seed)), F.col("slices"))
        rounds.append(one.join(many, "spot").select("node", F.xxhash64("spot", slice_).alias("tile")))
    tiles = rounds[0].unionAll(rounds[1]).select("tile", "node", F.col("node").alias("comp"), F.lit(2).cast("long").alias("side"))
    links = _tile_links(rule, tiles, classes, sets_of)
    known = components(links)

    # keys that still hold rows of more than one component
    labelled = stored(member.join(small_side(known), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"))
    open_keys = labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("rows"), F.bit_xor(F.xxhash64("node")).alias("who"), F.sum(F.xxhash64("node").bitwiseAND(F.lit((1 << 40) - 1))).alias("sum"))
    open_keys = stored(open_keys.where("x <> y").groupBy("rows", "who", "sum").agg(F.min("key").alias("key")).select("key"))
    if not open_keys.isEmpty():
        rows = stored(labelled.join(open_keys, "key", "left_semi").select("key", "node", "comp", size.alias("n"), band.alias("band")))
        slices = stored(rows.groupBy("key", "band").agg(slices_of.alias("slices")))
        at = rows.join(slices, ["key", "band"]).withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
        # one tile for a pair of slices of a band, one for a slice each of a band and the next; where a band is one
        # slice, and the next one too, the next band's rows join the band's own tile
        other = slices.select("key", "band", F.col("slices").alias("others"))
        whole = (F.col("slices") == 1) & (F.col("others") == 1)
        each = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("j")
        within = at.select("*", each).select(
            "node", "comp",
            F.xxhash64("key", "band", F.lit(0), F.least("slice", "j"), F.greatest("slice", "j")).alias("tile"),
            F.when(F.col("slice") == F.col("j"), 2).when(F.col("slice") < F.col("j"), 0).otherwise(1).cast("long").alias("side"),
        )
        every = F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("j")
        lower = at.join(other.withColumn("band", F.col("band") - 1), ["key", "band"]).where(~whole).select("*", every).select(
            "node", "comp", F.xxhash64("key", "band", F.lit(1), "slice", "j").alias("tile"), F.lit(0).cast("long").alias("side")
        )
        upper = at.withColumn("band", F.col("band") - 1).join(other, ["key", "band"]).select("*", every, whole.alias("whole")).select(
            "node", "comp", F.xxhash64("key", "band", F.when(F.col("whole"), 0).otherwise(1), "j", "slice").alias("tile"),
            F.when(F.col("whole"), 3).otherwise(1).cast("long").alias("side"),
        )
        placed = stored(within.unionAll(lower).unionAll(upper))
        live = placed.groupBy("tile").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("tile")
        more = _tile_links(rule, placed.join(live, "tile", "left_semi"), classes, sets_of)
        if not more.isEmpty():
            known = components(links.unionAll(more))

    to_root = classes.select("node", "doc_id").join(small_side(known), "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    smallest = to_root.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    answer = to_root.join(smallest, "root").select("node", "root", "component_id")
    with_set = sets.where("node is not null").join(answer, "node").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "root", "component_id")
    without = sets.where("node is null").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return with_set.unionAll(without)


def linked_documents(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles and component_id of linked_rows."""
    return linked_rows(docs, rule).select("doc_id", "n_shingles", "component_id")


def surplus_rows(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id and text_hash of the rows that a corpus with one document of each component does without.

    The document with the smallest doc_id stays, of several with that doc_id the one with the smallest text_hash, and
    where a component has no doc_id at all the one with the smallest text_hash. Rows that repeat both stand for one
    document. Rows with an empty set are never surplus.
    """
    rows = stored(linked_rows(docs, rule).where("root is not null").select("root", "doc_id", "text_hash").distinct())
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    stay = rows.groupBy("root").agg(F.count("*").alias("rows"), F.min(order).alias("stay")).where("rows > 1")
    other = ~(F.col("doc_id").eqNullSafe(F.col("stay.doc_id")) & (F.col("text_hash") == F.col("stay.text_hash")))
    return rows.join(stay.select("root", "stay"), "root").where(other).select("doc_id", "text_hash")
