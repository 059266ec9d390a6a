"""The corpus operators as queries over the input tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import chat, common, decontaminate, exact, jaccard, licenses, lines, mixing, quality, toxicity, warc
from .common import table


def _part(of: int) -> Column:
    """crc32 of doc_id as text, modulo of."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


def _held_out(scored: DataFrame, of: int, left: int) -> DataFrame:
    out = F.coalesce(_part(of) == left, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _held_out(toxicity.score_toxicity(docs, labels, _part(3) != 1), 3, 1)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.workspace(spark)
    entries = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    warc.write_index(entries, folder)
    return warc.read_archives(folder, entries)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    added = (F.struct(F.lit(-7).alias("conv_id"), F.lit(i).alias("turn"), F.lit(role).alias("role"), F.lit(text).alias("text")) for i, role in enumerate(("user", "assistant")))
    more = spark.range(1).select(F.inline(F.array(*added)))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    made = common.stored(chat.best_conversations(chat.linear_messages(rows)))
    turns = chat.turns_of(F.col("formatted"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_spans")), "")
    read = made.select("tree", "formatted", turns.alias("turns"), loss.alias("loss"))
    return read.select(
        F.when(F.col("tree") != "null", F.substring("tree", 2, 32)).cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_documents(table(spark, sf_dir, "documents"), jaccard.Rule(words=3, percent=90))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "finish")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _held_out(quality.score_quality(docs, labels, _part(4) != 2), 4, 2)


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.without_spread_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", F.col("removed").cast("long").alias("removed_lines"), F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).withColumn("notices", F.array_join("notices", ","))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_warc, op3_chat, op4_jaccard, op5_mixing, op6_quality, op7_lines, op8_exact, op9_decontaminate, op10_licenses)}

_LOWER = f"translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}')"


def _canonical(x: str) -> str:
    """DuckDB's form of licenses.canonical."""
    x = f"translate({x}, '{common.UPPER}', '{common.LOWER}')"
    steps = [(licenses.COPYRIGHT_LINE, "$1"), (licenses.PUNCTUATION, " "), *licenses.SPELLINGS]
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return f"trim({x}, ' ')"


def _known() -> str:
    return ", ".join(f"('{d}', '{n}')" for d, n in licenses.known_digests().items())


_ESCAPED = r"replace(replace(replace(coalesce({0}, ''), '\', '\\'), '#', '\#'), '</', '<\/')"

ORACLES = {
    "op2_warc": """
        with p as (select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as d, octet_length(encode(coalesce(html, ''))) as n from pages),
        f as (select d, min(page_id) as first from p where n >= 100 group by d)
        select page_id, n as payload_bytes, p.d as payload_digest,
               case when first is null or first is not distinct from page_id then 'response' else 'revisit' end as record_type,
               case when first is distinct from page_id then first end as refers_to
        from p left join f on p.d = f.d and n >= 100""",
    "op3_chat": rf"""
        with c as (
          select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
          union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
        select conv_id, count(*) as n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
               length(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
               cast(sum(length('### ') + length(replace({_ESCAPED.format("role")}, ':', '\:')) + 2 + length({_ESCAPED.format("text")}) + length('</turn>') + 1) as bigint) as formatted_chars
        from c group by conv_id""",
    "op4_jaccard": rf"""
        with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
        s as (
          select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                 else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as shingle
          from w),
        n as (select doc_id, count(*) as n from s group by doc_id),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as both_have from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
        e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * both_have >= 90 * (x.n + y.n - both_have)),
        u as (select a, b from e union all select b, a from e),
        r as (select a, b from u union select r.a, u.b from r join u on r.b = u.a)
        select w.doc_id, coalesce(any_value(n.n), 0) as n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) as component_id
        from w left join n on n.doc_id = w.doc_id left join r on r.a = w.doc_id group by w.doc_id""",
    "op7_lines": r"""
        with l as (
          select doc_id, source, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos
          from documents where text is not null),
        t as (select doc_id, source, line, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as bare from l),
        s as (select bare from t where bare <> '' group by bare
              having count(distinct source) >= case when len(regexp_extract_all(bare, '[^\x20\x09-\x0D]+')) >= 50 then 2 else 8 end),
        n as (select t.*, s.bare is not null and row_number() over (partition by t.bare order by t.doc_id, t.pos) > 1 as gone from t left join s on t.bare = s.bare),
        k as (select doc_id, count(*) filter (gone) as removed_lines, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text from n group by doc_id)
        select d.doc_id, coalesce(removed_lines, 0) as removed_lines, length(k.text) as kept_chars, sha256(k.text) as text_sha256
        from documents d left join k on d.doc_id = k.doc_id""",
    "op8_exact": f"""
        with t as (select doc_id, sha256({_LOWER}) as text_sha256 from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, text_sha256
        from t window w as (partition by text_sha256)""",
    "op10_licenses": f"""
        with known(d, id) as (values {_known()}),
        t as (select doc_id, sha256({_canonical("coalesce(text, '')")}) as s from documents),
        l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
        n as (select doc_id, string_agg(distinct id, ',' order by id) as notices from l join known on d = sha256({_canonical("line")}) group by doc_id)
        select t.doc_id, t.s as canonical_sha256, known.id as license_id, coalesce(notices, '') as notices
        from t left join known on known.d = t.s left join n on n.doc_id = t.doc_id""",
}
