"""Line dedup: lines spread over many sites, found with HyperLogLog sketches and exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, small_side, stored

#: Relative error asked of the sketch: gives 32 registers, 32 bytes a line.
SKETCH_ERROR = 0.2
BLANKS = " \t\x0b\x0c\r"


#: A line of so many words is a passage: it does not come to be on two sites by chance.
PASSAGE_WORDS = 50


def _row_key() -> list[Column]:
    """id, doc_id or a number above all, and rk, a hash of the row."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("doc_id", "text").alias("rk")]


def line_hashes(docs: DataFrame, passages: bool = True) -> DataFrame:
    """id, rk (hash of the row), site, pos, a 128-bit hash and whether it is a passage, of each line that is not blank.

    Blanks at a line's ends are left out. Fewer than 99 characters cannot hold 50 words, so shorter lines are not counted;
    without passages none are, where the answer makes no difference.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*_row_key(), F.col("source").cast("string").alias("site"), F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS))).alias("lines"))
    each = rows.select("id", "rk", "site", F.posexplode("lines").alias("pos", "line")).where("line <> ''")
    passage = F.when(F.lit(not passages) | (F.length("line") < 2 * PASSAGE_WORDS - 1), False).otherwise(F.regexp_count("line", F.lit(WORD)) >= PASSAGE_WORDS)
    return each.select("id", "rk", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), passage.alias("passage"))


def spread_lines(lines: DataFrame, min_sites: int = 8, passage_sites: int = 2) -> DataFrame:
    """h1, h2 and keeper, the smallest doc_id with the line, of the lines (see line_hashes) on enough distinct sites.

    Enough are min_sites, for passages passage_sites. A sketch of 32 registers for each line hash merges by partial
    aggregation. An estimate of twice as many or more needs more than that many registers set, hence as many sites, so
    those lines are decided. A line in fewer rows than sites asked for is decided too. All others are near the threshold
    and are counted exactly.
    """
    sketched = stored(
        lines.groupBy("h1", "h2")
        .agg(F.approx_count_distinct("site", SKETCH_ERROR).alias("about"), F.count("site").alias("rows"), F.min("id").alias("keeper"), F.first("passage").alias("passage"))
        .withColumn("least", F.when(F.col("passage"), passage_sites).otherwise(min_sites))
        .where("rows >= least")
        .drop("passage", "rows")
    )
    certain = F.col("about") >= 2 * F.col("least")
    near = sketched.where(~certain).select("h1", "h2", "keeper", "least")
    pairs = lines.where("site is not null").select("h1", "h2", "site").join(small_side(near), ["h1", "h2"]).select("h1", "h2", "keeper", "least", "site").distinct()
    exact = pairs.groupBy("h1", "h2", "keeper", "least").agg(F.count("*").alias("sites")).where("sites >= least")
    return sketched.where(certain).select("h1", "h2", "keeper").unionAll(exact.select("h1", "h2", "keeper"))


def without_spread_lines(docs: DataFrame, min_sites: int = 8, passage_sites: int = 2, removed: str = "removed") -> DataFrame:
    """docs with its columns, text without the lines on many sites, and a column named by removed, their number.

    docs needs doc_id, text and source, the site; a null source is no site. A line goes if it is on min_sites or more
    sites, a passage, a line of 50 words or more, if on passage_sites or more. Lines are compared without the blanks at
    their ends; blank lines always stay. The first occurrence of a line, in the document with the smallest doc_id,
    stays, so that the corpus loses no text; a null doc_id counts as the largest, and rows that repeat a doc_id and text
    keep the same lines. A null text stays null, an empty one empty; texts of which no line goes are unchanged. A text
    all of whose lines go is empty. No row is lost. Extra columns pass through, whatever their names but that of removed,
    which is replaced. An empty table gives no rows.

    The lines' hashes are written once, all else works on them. Shuffled are 16-byte line hashes with their sketches,
    and once the documents, to meet the positions to take out. A line that a third of the documents hold is summed
    by partial aggregation; the joins broadcast line hashes if their bytes prove few, else adaptive execution splits
    partitions.
    """
    lines = stored(line_hashes(docs, passage_sites != min_sites))
    spread = stored(spread_lines(lines, min_sites, passage_sites))
    places = lines.select("id", "rk", "pos", "h1", "h2").join(small_side(spread), ["h1", "h2"])
    each = places.groupBy("id", "rk", "h1", "h2", "keeper").agg(F.collect_set("pos").alias("at"), F.min("pos").alias("first"))
    own = F.col("id") == F.col("keeper")
    gone = F.filter("at", lambda p: ~(own & (p == F.col("first"))))
    out = each.select("id", "rk", gone.alias("at")).groupBy("id", "rk").agg(F.flatten(F.collect_list("at")).alias("at")).where("size(at) > 0")
    # the row is packed, so that no column of its own meets those of the join
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_row_key())
    row = F.col("row")
    columns = [(_cut(row["text"], F.col("at")) if c == "text" else row[c]).alias(c) for c in docs.columns if c != removed]
    number = F.when(F.col("at").isNull(), 0).otherwise(F.size("at")).cast("int").alias(removed)
    return packed.join(out, ["id", "rk"], "left").select(*columns, number)


def _cut(text: Column, at: Column) -> Column:
    """text without the lines at these positions."""
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(at, i))
    return F.when(at.isNull(), text).otherwise(F.array_join(kept, "\n"))
