"""Chat formatting: root-to-leaf paths of reply trees, ranked and formatted as conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

#: The template, turn by turn: mark, role, separator, text, end. Texts hold neither "</" nor "###" once escaped.
MARK, SEPARATOR, END = "### ", ": ", "</turn>\n"


def escaped(text: Column) -> Column:
    """Backslashes doubled, each # and each slash after < behind a backslash; see unescaped for the way back."""
    for old, new in (("\\", "\\\\"), ("#", "\\#"), ("</", "<\\/")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def unescaped(text: Column) -> Column:
    """Every backslash starts a pair and stands for the pair's second character."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(messages: DataFrame) -> DataFrame:
    """tree, leaf, pos and id for every message of every root-to-leaf path; pos counts from 0 at the root.

    messages has tree, id and parent, all non-null but parent, and each (tree, id) once. A message whose parent is
    null, itself or missing from its tree is a root. Messages in a cycle of parents, and those below one, lie on no
    path from a root and are absent. Self-joins double the distance that a link spans: the k-th holds each
    message's ancestor 2**k steps up, so a chain of n messages takes log2(n) of them. The paths then grow from the
    leaves by the spans in turn, each pair of leaf and ancestor being found once.
    """
    ids = messages.select("tree", F.col("id").alias("parent"))
    links = stored(messages.where("parent is not null and parent <> id").select("tree", "id", "parent").join(ids, ["tree", "parent"], "left_semi"))
    spans = [links]
    rounds = messages.count().bit_length() + 1
    while not spans[-1].isEmpty() and len(spans) <= rounds:
        up = spans[-1].select("tree", F.col("id").alias("parent"), F.col("parent").alias("further"))
        spans.append(stored(spans[-1].join(up, ["tree", "parent"]).select("tree", "id", F.col("further").alias("parent"))))
    leaves = messages.select("tree", "id").join(links.select("tree", F.col("parent").alias("id")), ["tree", "id"], "left_anti")
    if not spans[-1].isEmpty():  # a cycle: what still climbs never arrives
        leaves = leaves.join(spans[-1].select("tree", "id"), ["tree", "id"], "left_anti")
    paths = leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up"))
    for k, span in enumerate(spans[:-1]):
        paths = stored(paths.unionAll(paths.join(span, ["tree", "id"]).select("tree", "leaf", F.col("parent").alias("id"), F.col("up") + (1 << k))))
    height = paths.groupBy("tree", "leaf").agg(F.max("up").alias("height"))
    return paths.join(height, ["tree", "leaf"]).select("tree", "leaf", (F.col("height") - F.col("up")).alias("pos"), "id")


def best_conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, path_score, rank, formatted and loss_spans: the best branches of each reply tree.

    messages has tree, id, parent, role, text and score; other columns are ignored. A branch is a path from the root
    to a leaf; its score is the mean of its messages' scores (null counts as 0), ties going to the smaller leaf.
    Null role and text count as empty. A message that repeats a (tree, id) is left out, the smallest (parent, role,
    text) staying. Rows without tree or id belong to no tree. loss_spans holds start (from 0) and length, in code
    points of formatted, of each assistant text in its escaped form. An empty table gives no rows.

    One formatted conversation is one row, so a row grows with its path; no group beyond a path is gathered.
    """
    clean = stored(
        messages.where("tree is not null and id is not null")
        .groupBy("tree", "id")
        .agg(F.min(F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("m"))
        .select("tree", "id", "m.*")
    )
    paths = stored(reply_paths(clean.select("tree", "id", "parent")))
    scored = paths.join(clean.select("tree", "id", "score"), ["tree", "id"]).groupBy("tree", "leaf").agg(F.avg("score").alias("path_score"))
    best = scored.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("path_score"), "leaf"))).where(F.col("rank") <= branches)
    head = F.concat(F.lit(MARK), F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(SEPARATOR))
    turns = (
        paths.join(stored(best), ["tree", "leaf"])
        .join(clean.select("tree", "id", "role", "text"), ["tree", "id"])
        .select("tree", "leaf", "path_score", "rank", "pos", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
        .withColumn("turn", F.concat("head", "body", F.lit(END)))
    )
    before = W.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    placed = turns.withColumn("start", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    return (
        placed.groupBy("tree", "leaf", "path_score", "rank")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "turn"))).alias("turns"), F.array_sort(F.collect_list(span)).alias("loss_spans"))
        .select("tree", "leaf", "path_score", "rank", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), "loss_spans")
    )


def turns_of(formatted: Column) -> Column:
    """The turns read back from a formatted conversation: an array of role and text."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")
    role = r"(?s)^### ([^\\:]*+(?:\\.[^\\:]*+)*+): "
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.regexp_extract(p, role, 1)).alias("role"),
            unescaped(F.regexp_replace(p, role, "")).alias("text"),
        ),
    )


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def linear_messages(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A table of linear conversations as reply trees: each row answers the one before by turn, then role and text.

    tree is the conversation as text, behind "=", or "null"; null turns come first. All scores are 1.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(conversation).cast("string")), F.lit("null"))
    numbered = turns.select(tree.alias("tree"), F.col(turn).alias("_turn"), "role", "text").withColumn("id", F.row_number().over(W.partitionBy("tree").orderBy("_turn", "role", "text")).cast("long"))
    return numbered.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))
