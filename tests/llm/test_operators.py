import gzip
import hashlib
import io
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import database, same  # noqa: E402

from sparkloom.llm import chat, common, components, decontaminate, exact, jaccard, licenses, lines, mixing, quality, queries, toxicity, warc  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000


def odd_documents(spark, n=1):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names the operators use."""
    rows = [(1, "", "en", "a", 0), (2, None, None, None, None), (None, "some words without an id", "en", "a", 1), (3, LONG, "en", "b", 2), (4, "x y", "en", "", 3), (4, "x y", "en", "", 3), (5, "A b c\nd", None, "a", 4)]
    names = ("node", "n", "key", "tile", "digest", "size", "target", "id", "rk", "score", "label", "at__")
    df = spark.createDataFrame(rows * n, DOCS)
    return df.select("*", *(F.lit(9).alias(x) for x in names))


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_duckdb(spark, name):
    assert same(queries.QUERIES[name](spark, FOLDER), database(FOLDER), queries.ORACLES[name])


def components_by_hand(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = re.findall(common.WORD, (text or "").translate(str.maketrans(common.UPPER, common.LOWER)))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (1, 40)])
def test_jaccard_against_all_pairs(spark, k, percent):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r[0]: (r[1], r[2]) for r in jaccard.linked_documents(docs, jaccard.Rule(k, percent)).collect()}
    assert got == components_by_hand([(r.doc_id, r.text) for r in docs.collect()], k, percent)


def test_jaccard_in_slices(spark, monkeypatch):
    """A group of near copies larger than a tile, beside one that misses by a word, is joined whole."""
    monkeypatch.setattr(jaccard, "TILE_ROWS", 4)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*base[:i], f"z{i}", *base[i + 1 :]]), "en", "a", 0) for i in range(30)]
    got = {r[0]: r[2] for r in jaccard.linked_documents(spark.createDataFrame(rows, DOCS), jaccard.Rule(1, 90)).collect()}
    assert got == {i: v[1] for i, v in components_by_hand([(r[0], r[1]) for r in rows], 1, 90).items()} and set(got.values()) == {0}


def bag(df):
    return sorted(map(str, df.collect()))


def test_odd_rows_jaccard(spark):
    docs = odd_documents(spark)
    linked = sorted((r[0] or -1, r[1], r[2]) for r in jaccard.linked_documents(docs).collect())
    assert linked == [(-1, 1, None), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 4), (4, 1, 4), (5, 1, 5)]
    assert jaccard.linked_documents(empty(spark)).count() == 0 and jaccard.surplus_rows(empty(spark)).count() == 0


def test_jaccard_without_ids(spark):
    """Near copies without doc_id link with one another and with others, and one of each group stays."""
    base = [f"w{i}" for i in range(60)]
    near = [" ".join([*base[:i], f"z{i}", *base[i + 1 :]]) for i in range(3)]
    rows = [(None, near[0], "en", "a", 0), (None, near[1], "en", "a", 0), (7, "other words stand alone here today", "en", "a", 0), (7, near[2], "en", "a", 0), (None, "x " * 9, "en", "a", 0), (None, "x " * 9, "en", "b", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    rule = jaccard.Rule(1, 90)
    assert sorted((r.n_shingles, r.component_id) for r in jaccard.linked_documents(docs, rule).collect() if r.n_shingles > 6) == [(60, 7)] * 3
    assert sorted(r.text_hash for r in jaccard.surplus_rows(docs, rule).collect()) == sorted(r[0] for r in docs.where("doc_id is null and text like '%w59%'").select(F.xxhash64("text")).collect())


def test_jaccard_bands():
    """Sets that may link lie in one band or two neighbouring ones, also where 100 / percent is whole."""
    for percent in (10, 40, 50, 80, 90):
        starts = jaccard.Rule(3, percent).bands()
        sizes = np.unique(np.concatenate([np.arange(1, 3000), [9999, 10000, 10001, 10**6, 10**6 + 1]]))
        band = lambda n: np.searchsorted(starts, n, "right")
        assert (band(100 * sizes // percent) - band(sizes) <= 1).all()


def test_jaccard_hot_key(spark, monkeypatch):
    """Thousands of rows under one key, which all miss one another but for two pairs."""
    monkeypatch.setattr(jaccard, "TILE_ROWS", 200)
    common_ = [f"c{i}" for i in range(12)]
    rows = [(i, " ".join(common_ + [f"r{i}_{j}" for j in range(4)]), "en", "a", 0) for i in range(2500)]
    rows += [(5000, rows[17][1] + " extra", "en", "a", 0), (5001, rows[2400][1] + " more", "en", "a", 0)]
    got = {r[0]: r[2] for r in jaccard.linked_documents(spark.createDataFrame(rows, DOCS), jaccard.Rule(1, 70)).collect()}
    assert {i: c for i, c in got.items() if i != c} == {5000: 17, 5001: 2400} and len(got) == 2502


def test_odd_rows_exact(spark):
    found = {r.doc_id: r for r in exact.exact_duplicates(odd_documents(spark)).collect()}
    assert found[1].keep_id == 2 and not found[1].kept and found[2].kept and found[4].group_size == 2 and found[None].keep_id is None
    assert exact.exact_duplicates(empty(spark)).count() == 0


def test_odd_rows_lines(spark):
    docs = odd_documents(spark).withColumn("removed", F.lit("mine"))
    cut = lines.without_spread_lines(docs, 1, 1, removed="gone")
    assert cut.count() == 7 and cut.where("doc_id = 2").first().text is None and "at__" in cut.columns and cut.where("removed = 'mine'").count() == 7
    assert lines.without_spread_lines(docs).schema["removed"].dataType.typeName() == "integer"
    assert lines.without_spread_lines(empty(spark)).count() == 0


def test_spread_lines_against_plain_code(spark):
    """Short lines and passages, each at its threshold, on sites of any number; null sites and blanks at the ends."""
    passage, short = " ".join(f"p{i}" for i in range(50)), " ".join(f"q{i}" for i in range(49))
    rows = []
    for n in range(1, 12):
        rows += [(100 * n + k, f"ok {n}\n {passage} n{n}\n{short} n{n}\nown {n} {k}", "en", f"s{k}", 0) for k in range(n)]
        rows += [(100 * n + 50, f"ok {n}", "en", None, 0), (100 * n + 51, f"ok {n} ", "en", "s0", 0)]
    got = {r.doc_id: (r.text, r.removed) for r in lines.without_spread_lines(spark.createDataFrame(rows, DOCS), 8, 2).collect()}
    sites, first = {}, {}
    for i, text, _, site, _ in sorted(rows):
        for pos, line in enumerate(text.split("\n")):
            sites.setdefault(line.strip(), set()).update({site} - {None})
            first.setdefault(line.strip(), (i, pos))
    for i, text, *_ in rows:
        gone = [pos for pos, x in enumerate(text.split("\n")) if len(sites[x.strip()]) >= (2 if len(x.split()) >= 50 else 8) and first[x.strip()] != (i, pos)]
        assert got[i] == ("\n".join(x for pos, x in enumerate(text.split("\n")) if pos not in gone), len(gone))


def test_odd_rows_mixing(spark):
    mixed = mixing.mixture(odd_documents(spark)).collect()
    assert len(mixed) == 7 and all(r.taken <= 3 * r["size"] for r in mixed) and mixing.mixture(empty(spark)).count() == 0


def test_odd_rows_licenses(spark):
    scanned = licenses.scan_licenses(odd_documents(spark)).collect()
    assert len(scanned) == 7 and all(r.license_id is None and r.notices == [] for r in scanned) and licenses.scan_licenses(empty(spark)).count() == 0


def test_odd_rows_decontaminate(spark):
    docs, none = odd_documents(spark), empty(spark)
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "some words without an id"), (None, "q")], "item_id long, text string")
    leaks = decontaminate.contaminated(docs, bench).collect()
    assert [(r.doc_id, r.item_id) for r in leaks] == [(None, 3)]
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_odd_rows_classifiers(spark, score):
    docs, none = odd_documents(spark), empty(spark)
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert score(docs, labels, F.lit(True)).count() == 7
    assert {r.score for r in score(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert score(none, labels, F.lit(True)).count() == 0


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_scores_do_not_depend_on_partitions(spark, score):
    """Also where rows share a doc_id and differ in text."""
    rows = [(i % 40, f"word{i % 7} and some more {'bad ' * (i % 3)} text {i}", "en", "a", 0) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    got = [bag(score(spark.createDataFrame(r, DOCS).repartition(n), labels, F.lit(True))) for r, n in ((rows, 1), (rows[::-1], 7))]
    assert got[0] == got[1]


def test_toxicity_against_plain_loops():
    """Features counted character by character, and the score summed one by one."""
    texts = ["Ab  çé ab\tab", "", "x", "Éa éa éa éa éa ÉA ÉA ÉA eins"]
    model = toxicity.NaiveBayesLinear(np.linspace(-1, 1, 1 << 12), 0.1, 1.5, -0.2)
    spot = {}
    for text in texts:
        words = " " + " ".join(text.lower().split()) + " " if text.split() else "  "
        plain = {}
        for n in (*toxicity.ORDERS, *toxicity.STARTS):
            for at in range(len(words) - n + 1):
                gram = words[at : at + n]
                if " " not in gram[1:-1] and (n in toxicity.ORDERS or gram[0] == " "):
                    plain[gram] = plain.get(gram, 0) + 1
        features = {(g, k) for g, c in plain.items() for k in (1, *toxicity.LEVELS) if c >= k}
        found = toxicity.grams(text.encode(), 1 << 40)
        assert len(found) == len(features)
        spot[text] = set(found.tolist())
        few = toxicity.grams(text.encode(), 1 << 12).tolist()
        margin = model.bias + sum(model.weights[i] for i in few) / max(len(few), 50) ** 0.25 if few else model.bias
        assert model.score(text.encode()) == pytest.approx(1 / (1 + np.exp(-(1.5 * margin - 0.2))))
    assert spot["x"] == set(toxicity.grams(b" X ", 1 << 40).tolist()) and not spot["x"] & spot[texts[3]]


def test_trees_against_plain_loops():
    """The flattened traversal against walking every tree, and the first split against every cut of every column."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 4)), 2)
    y = ((x[:, 1] > 0.3) ^ (rng.random(300) < 0.1)).astype(float)
    model = quality.fit(x, y, trees=7, depth=3, bins=1 << 10, least=10, smooth=2.0)

    def walked(row):
        total = model.base
        for node in model.roots:
            while model.left[node]:
                node = model.left[node] + (row[model.feature[node]] > model.cut[node])
            total += model.value[node]
        return 1 / (1 + np.exp(-total))

    assert model.score(x) == pytest.approx([walked(row) for row in x])
    share = (y.sum() + 1) / (len(y) + 2)
    g, h = share - y, np.full(len(y), share * (1 - share))
    gains = {}
    for f in range(4):
        for cut in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= cut
            if 10 <= low.sum() <= 290:
                gains[f, cut] = sum(g[s].sum() ** 2 / (h[s].sum() + 2) for s in (low, ~low))
    root = model.roots[0]
    low = x[:, model.feature[root]] <= model.cut[root]
    assert sum(g[s].sum() ** 2 / (h[s].sum() + 2) for s in (low, ~low)) == pytest.approx(max(gains.values()))


def test_exact_duplicates_are_grouped(spark):
    rows = [(1, "Same text"), (2, "same TEXT"), (3, "other"), (4, None), (5, "")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (5, 2, False), 5: (5, 2, True)}


def test_mixing_meets_targets(spark):
    rows = queries.op5_mixing(spark, FOLDER).collect()
    again = queries.op5_mixing(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    most, taken, total = max(r["size"] for r in rows), {}, sum(r["size"] for r in rows)
    for r in rows:
        taken.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert abs(sum(t for t, _ in taken.values()) - total) < 1e-3 and sum(x for _, x in taken.values()) <= total
    assert all(abs(t - x) <= most for t, x in taken.values())


def targets_by_hand(sizes):
    """Targets of sources (in order, to their sizes): weights 1, 2, 3, no more than three times the size, the rest shared anew."""
    names, total = list(sizes), sum(sizes.values())
    weight, capped = {s: i % 3 + 1 for i, s in enumerate(names)}, {}
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= {s: 3 * sizes[s] for s in over}


def test_mixing_against_one_queue(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: (r.copies, r.target) for r in mixing.mixture(docs).collect()}
    spots = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id")).collect()}
    sizes = {r.doc_id: (r.source, len(re.findall(common.WORD, r.text or ""))) for r in docs.collect()}
    names = sorted({s for s, _ in sizes.values()}, key=lambda s: (s is None, s))
    targets = targets_by_hand({s: sum(n for x, n in sizes.values() if x == s) for s in names})
    copies = []
    for source, target in targets.items():
        own = sorted((spots[i] % (1 << 64), i) for i, (s, _) in sizes.items() if s == source)
        end = 0
        for epoch in range(3):
            for _, i in own:
                end += sizes[i][1]
                copies.append((end / target, "=" + source, epoch, i, sizes[i][1]))
    left, want = sum(n for _, n in sizes.values()), dict.fromkeys(sizes, 0)
    for *_, i, n in sorted(copies, key=lambda c: c[0]):
        if n > left + 1e-6:
            break
        left -= n
        want[i] += n > 0
    assert all(got[i][1] == pytest.approx(targets[sizes[i][0]]) for i in got)
    assert {i: c for i, (c, _) in got.items()} == want


def test_many_sources(spark):
    """Ranks and targets of thousands of sources, dealt over many partitions, against plain code."""
    rng = np.random.default_rng(1)
    sizes = {f"={i:05d}": int(rng.integers(0, 10 ** int(rng.integers(1, 6)))) for i in range(3000)}
    got = {r.key: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "key string, source_size long").repartition(9)).collect()}
    assert got == pytest.approx(targets_by_hand(sizes))


def test_mixing_stage_keeps_rows_without_id(spark):
    """With and without ids the same words are taken, and each row without an id has its own decision."""
    import corpus_pipeline

    rows = [(i if i % 2 else None, "word " * (3 + i) + f"end{i}", "en", "abc"[i % 3], 1) for i in range(30)]
    docs = spark.createDataFrame([*rows, (None, "", "en", "a", 0)], DOCS)
    got = corpus_pipeline.mixing_stage(spark, docs, FOLDER).collect()
    assert got[0].__fields__[0] == "doc_id"
    taken = sum(r.copies * len(r.text.split()) for r in got)
    total = sum(len(r[1].split()) for r in rows)
    assert any(r.doc_id is None for r in got) and len({r.text for r in got}) == len(got)
    assert total - 33 <= taken <= total


def test_target_caps(spark):
    sources = spark.createDataFrame([("=a", 100), ("=b", 1), ("=c", 2)], "key string, source_size long")
    got = {r.key: r.target for r in mixing.source_targets(sources).collect()}
    assert got == pytest.approx({"=a": 94, "=b": 3, "=c": 6})


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "q # </x> \\", 0.0), ("t", 2, 1, "assistant", "a", 0.2), ("t", 3, 1, "assistant", "b", 0.9), ("t", 4, 3, "user", "c", 0.5), ("t", 5, 6, "user", "loop", 1.0), ("t", 6, 5, "user", "loop", 1.0), (None, 1, None, "user", "x", 1.0)]
    df = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double")
    paths = sorted((r.leaf, r.pos, r.id) for r in chat.reply_paths(df.where("tree is not null").select("tree", "id", "parent")).collect())
    assert paths == [(2, 0, 1), (2, 1, 2), (4, 0, 1), (4, 1, 3), (4, 2, 4)]
    best = chat.best_conversations(df, 2).orderBy("rank").collect()
    assert [r.leaf for r in best] == [4, 2] and [len(r.loss_spans) for r in best] == [1, 1]
    back = chat.best_conversations(df, 1).select(chat.turns_of(F.col("formatted")).alias("t"), chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("l")).first()
    assert [tuple(t) for t in back.t] == [("user", "q # </x> \\"), ("assistant", "b"), ("user", "c")] and back.l == ["b"]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_archives(spark, tmp_path):
    html = "<p>é</p>" * 50
    rows = [(3, "http://www.a.org/x?y", html), (1, "https://b.org:8080/z\n w", html), (2, None, None), (5, "nonsense", "short"), (6, "nonsense", "short"), (None, "http://c.org", html), (9, "http://d.org", "WARC/1.1\r\n\r\n" * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    entries = warc.write_archives(pages, f"file://{tmp_path}/w")
    warc.write_index(entries, f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.read_archives(f"file://{tmp_path}/w", entries).collect()}
    assert got[1].record_type == "response" and got[3].refers_to == 1 and got[None].refers_to == 1 and got[6].record_type == "response"
    for page, _, text in rows:
        data = (text or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    none = warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")
    warc.write_index(none, f"file://{tmp_path}/e")
    assert warc.read_archives(f"file://{tmp_path}/e", none).count() == 0
    assert warc.url_key("http://www.a.org/x?y") == "org,a,www)/x?y"
    assert list(warc.members(io.BytesIO(gzip.compress(b"a") + gzip.compress(b"bc")), 7)) == [b"a", b"bc"]


def test_archives_of_odd_pages(spark, tmp_path):
    """Very long payloads, repeated rows, many captures, and columns whose names the operator uses."""
    rows = [(i, f"http://h{i % 7}.org/{i}", f"page {i % 300} " * 20) for i in range(900)] + [(2000, "http://x.org", "long " * 400_000), (2001, None, "long " * 400_000), (2001, None, "long " * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("digest"), F.lit("a").alias("first"), F.lit(2).alias("payload")).repartition(5)
    entries = warc.write_archives(pages, f"file://{tmp_path}/w")
    warc.write_index(entries, f"file://{tmp_path}/w", block_entries=16)
    got = warc.read_archives(f"file://{tmp_path}/w", entries).collect()
    assert len(got) == len(rows)
    least = {}
    for i, _, html in rows:
        least[html] = min(i, least.get(html, i))
    text = {i: html for i, _, html in rows}
    for r in got:
        data, first = text[r.page_id].encode(), least[text[r.page_id]]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))


def test_odd_rows_chat(spark):
    rows = [("t", 1, None, None, None, None), ("t", 1, None, "user", "b", 1.0), ("t", 2, 1, "assistant", LONG, 0.5), (None, 3, 1, "user", "x", 1.0), ("t", None, 1, "user", "x", 1.0), ("u", 1, 9, "as:s\\", "a\n### x: </turn>\n", None)]
    df = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double").select("*", *(F.lit(1).alias(x) for x in ("leaf", "pos", "up", "turn", "head", "rank")))
    got = {r.tree: r for r in chat.best_conversations(df).select("tree", chat.turns_of(F.col("formatted")).alias("t"), chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    assert [tuple(t) for t in got["t"].t] == [("", ""), ("assistant", LONG)] and got["t"].l == [LONG]
    assert [tuple(t) for t in got["u"].t] == [("as:s\\", "a\n### x: </turn>\n")] and len(got) == 2
    assert chat.best_conversations(df.limit(0)).count() == 0 and chat.reply_paths(df.limit(0).select("tree", "id", "parent")).count() == 0


def test_branches_are_ranked_as_by_hand(spark):
    """Random trees: every path from a root to a leaf, its mean score, and the best two of each tree."""
    rng = np.random.default_rng(3)
    rows = [(f"t{t}", i, None if i == 0 else int(rng.integers(0, i)), "user" if i % 2 else "assistant", f"m{i}", float(rng.integers(0, 5)) / 4) for t in range(6) for i in range(25)]
    df = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double")
    up = {(r[0], r[1]): r for r in rows}
    want = {}
    for t in {r[0] for r in rows}:
        inner, paths = {r[2] for r in rows if r[0] == t}, []
        for leaf in (r[1] for r in rows if r[0] == t and r[1] not in inner):
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = up[t, at][2]
            paths.append((-sum(up[t, x][5] for x in path) / len(path), leaf, path[::-1]))
        want[t] = [(leaf, [f"m{x}" for x in path]) for _, leaf, path in sorted(paths, key=lambda p: (round(p[0], 9), p[1]))[:2]]
    got = {}
    for r in chat.best_conversations(df, 2).select("tree", "leaf", "rank", chat.turns_of(F.col("formatted")).alias("t")).orderBy("tree", "rank").collect():
        got.setdefault(r.tree, []).append((r.leaf, [x.text for x in r.t]))
    assert got == want


def test_templates(spark):
    item = "Anna buys 3 apples and 7 pears at 2 dollars each, then Anna sells 3 apples to Ben for 9 dollars in total today"
    other = item.replace("Anna", "Carla").replace("3", "14").replace("Ben", "Dora")
    wrong = item.replace("Anna buys 3", "Anna buys 5")
    docs = spark.createDataFrame([(1, "lead in . " + item.upper() + " tail"), (2, other), (3, wrong + " " + wrong.replace("5", "6")), (4, "Anna buys pears and other things that nobody else would count")], "doc_id long, text string")
    got = {r.doc_id: r.reparameterised for r in decontaminate.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got[1] is False and got[2] is True and 4 not in got


def test_parts_that_lie_apart_must_agree(spark):
    """An item in two parts counts whole if one renaming explains both, else its longer part alone."""
    first, second = "Anna buys 3 apples and 7 pears at the old market every morning", "then Anna sells 3 apples to Ben near the bridge at noon today"
    item = f"{first} {second}"
    change = lambda text, a, n: text.replace("Anna", a).replace("3", n)
    docs = spark.createDataFrame([(1, f"{change(first, 'Carla', '14')} some words between them {change(second, 'Carla', '14')}"), (2, f"{change(first, 'Carla', '14')} some words between them {change(second, 'Dora', '15')}")], "doc_id long, text string")
    got = {r.doc_id: r.matched for r in decontaminate.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string"), least_windows=3).collect()}
    assert got[1] > got[2] > 0


def test_recall_of_changed_items(spark):
    """Items of the sample with names and numbers put in, planted verbatim, with one slot altered, and with all slots renamed."""
    rng = np.random.default_rng(11)
    folder = "/root/testdata/sf0.01"
    items, rows, want = [], [], set()
    names = ["Anna", "Ben", "Carla", "Dora", "Emil", "Fritz", "Gina", "Hugo"]
    originals = spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").collect()
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 400 and n_chars < 3000").orderBy("doc_id").collect()]
    clean = [t for t in texts if not any(r.text.lower() in t.lower() for r in originals)]
    for r in originals:
        words = r.text.lower().split()
        who, number = list(rng.choice(names, 3, replace=False)), [str(x) for x in rng.integers(10, 99, 3)]
        for at in range(4, len(words), 9):
            words.insert(at, who[at % 3])
        for at in range(8, len(words), 11):
            words.insert(at, number[at % 3])
        items.append((r.item_id, " ".join(words)))
    for k, (item, text) in enumerate(items):
        host = clean[k % len(clean)]
        swap = dict(zip(names, np.roll(names, 3), strict=True))
        renamed = " ".join(swap.get(w, str(int(w) + 101) if w.isdigit() else w) for w in text.split())
        altered = re.sub(r"\d+", "7", text, count=1)
        for j, planted in enumerate((text, altered, renamed)):
            rows.append((10 * k + j, f"{host} {planted} {host[:80]}"))
            want.add((10 * k + j, item))
    rows += [(100_000 + i, t) for i, t in enumerate(clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    recall = [len([x for x in want if x[0] % 10 == j and x in got]) / len(items) for j in range(3)]
    assert min(recall) >= 0.98 and set(got) <= want
    assert not any(r for (d, _), r in got.items() if d % 10 == 0) and all(r for (d, _), r in got.items() if d % 10 == 2)


def test_windows_that_disagree_are_left_out(spark):
    """One occurrence changed of a repeated number, or of a number and a name, costs its own windows only."""
    item = "Anna buys 3 apples and 7 pears at 2 dollars each, then Anna sells 3 apples to Ben for 9 dollars in total today"
    wrong = item.replace("Anna buys 3", "Anna buys 5")
    short = "Anna buys 3 apples and 7 pears at 2 dollars"
    docs = spark.createDataFrame([(3, wrong + " " + wrong.replace("5", "6")), (4, item.replace("Anna buys 3", "Carla buys 5")), (5, item.replace("Anna buys 3", "Carla buys 5").replace("Ben", "Dora").replace("9", "8")), (6, short)], "doc_id long, text string")
    got = {r.doc_id: r.reparameterised for r in decontaminate.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {3: False, 4: False, 5: True}


def test_items_of_few_literals_are_found_as_written(spark):
    items = {1: "1, 1, 2, 3, 5, 8, 13, 21", 2: "12 + 30 = 42", 3: "Antarctica", 4: "two hundred", 5: "one two three buckle my shoe", 6: "Anna owes Ben", 7: "days of 7 years"}
    rows = [(i, f"Some lead in 7 {text}, and more words follow it.") for i, text in items.items()]
    rows += [(11, "lead in 1 2 3 4 5 6 7 8 9 10 and more"), (12, "12 + 31 = 43 and more"), (13, "three hundred words"), (14, "Antarctica"), (15, "Carla owes Dora money")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert got == {(i, i) for i in items} | {(14, 3)}


def leaks_by_hand(docs, items, k=5, least=9, share=0.5):
    """doc_id, item_id, matched, windows and reparameterised by plain loops over every document and item of k words or more."""

    def worded(text):
        out = []
        for raw in text.split():
            core = raw.strip(decontaminate._EDGES)
            if core:
                low = core.lower()
                number = low in decontaminate.NUMBER_WORDS or re.fullmatch(r"[+-]?[$€£]?[0-9][0-9.,:/]*(st|nd|rd|th|%)?", core)
                unit = low in decontaminate.UNIT_WORDS and bool(out) and out[-1][1] == "number"
                kind = "number" if number else "unit" if unit else "name" if low not in decontaminate.UNIT_WORDS and len(core) > 1 and core[0].isupper() and core[1:].islower() else "word"
                out.append((low, kind))
        return out

    def windowed(words, coding):
        slots = ({"number", "unit"}, {"number", "unit", "name"}, set())[coding]
        for at in range(len(words) - k + 1):
            part = words[at : at + k]
            if coding == 2 or sum(kind not in slots for _, kind in part) >= 3:
                yield at, tuple(kind if kind in slots else low for low, kind in part), [low for low, kind in part if kind in slots]

    def found(item, text, coding):
        own = list(windowed(item, coding))
        met = {}
        by_code = {}
        for at, code, slots in windowed(text, coding):
            by_code.setdefault(code, []).append((at, slots))
        for at, code, slots in own:
            for there, theirs in by_code.get(code, ()):
                met.setdefault(there - at, []).append((at, list(zip(slots, theirs))))
        votes = {}
        for shift, windows in met.items():
            count = {}
            for _, pairs in windows:
                for i, d in pairs:
                    count[i, d] = count.get((i, d), 0) + 1
            votes[shift] = {i: max((n, i == d, d) for (j, d), n in count.items() if j == i)[2] for i, _ in count}
        agree = lambda pairs, answers: all(answers.get(i, d) == d for i, d in pairs)
        same = lambda pairs: all(i == d for i, d in pairs)
        kept = {s: [w for w in ws if agree(w[1], votes[s]) or same(w[1])] for s, ws in met.items()}
        first = max(kept, key=lambda s: (len(kept[s]), -s), default=None)
        counted = {}
        for s, ws in kept.items():
            for at, pairs in ws:
                # what the longest part says by windows that agree there holds for all
                said = {}
                for _, answered in met[first]:
                    for i, d in answered:
                        if votes[first].get(i) == d:
                            said[i] = d
                if same(pairs) or agree(pairs, votes[s]) and agree(pairs, said):
                    counted.setdefault(at, []).append(same(pairs))
        return len(counted), len(own), any(not all(x) for x in counted.values())

    out = {}
    for item_id, item_text in items:
        item = worded(item_text)
        whole = all(sum(kind not in ("number", "unit") for _, kind in item[at : at + k]) >= 3 for at in range(len(item) - k + 1)) and item[0][0] not in decontaminate.UNIT_WORDS
        for doc_id, text in docs:
            words = worded(text or "")
            best = None
            for coding in range(2 if whole else 3):
                matched, windows, changed = found(item, words, coding)
                if windows and matched and (matched >= least or matched >= -(-windows * share // 1)):
                    best = max(best or (0, 0, False), (matched, windows, not changed))
            if best:
                out[doc_id, item_id] = (best[0], best[1], not best[2])
    return out


def test_words_of_a_batch():
    """Blanks of all kinds, words that are not UTF-8, very long words, and the same hash whatever stands around."""
    import pyarrow as pa

    texts = ["  a\u00a0B!\x1cC\x85 ", None, "", "Über straße ÉCOLE-", "x" * 200_000 + " " + "y " * 900_000 + "a", "-- 12kg 3,5% $7 seven Kg 5th 5thx é"]
    words = decontaminate.Words(pa.array([t and t.encode() for t in texts] + [b"a \xff\xfe b"], pa.binary()))
    low = [words.low[int(r)].as_py() for r in words.rows]
    want = [(i, w.strip(decontaminate._EDGES).lower()) for i, t in enumerate([*texts, "a \ufffd\ufffd b"]) if t for w in t.split()]
    want = [(i, w) for i, w in want if w]
    assert list(zip(words.text.tolist(), low)) == want
    kinds = dict(zip(low, words.kind[words.rows].tolist()))
    number, unit, name, word = decontaminate.NUMBER, decontaminate.UNIT, decontaminate.NAME, decontaminate.LITERAL
    assert [kinds[w] for w in ("12kg", "3,5", "$7", "seven", "kg", "5th", "5thx", "é", "über", "école", "straße")] == [word, number, number, number, unit, number, word, word, name, word, word]
    alone = decontaminate.Words(pa.array([b"A"], pa.binary()))
    codes = words.written[words.rows]
    assert {int(c) for c, w in zip(codes, low) if w == "a"} == {int(alone.written[0])} and len(set(codes.tolist())) == len(set(low))


def test_leaks_against_plain_loops(spark):
    """Items of the sample with names, numbers and units put in, planted whole, in parts and changed at random."""
    rng = np.random.default_rng(23)
    names, items, docs = ["Anna", "Ben", "Carla", "Dora", "Emil"], [], []
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").limit(12).collect():
        words = r.text.lower().split()[:40]
        for at in range(3, len(words), 6):
            words[at:at] = [str(rng.choice(names)), str(rng.integers(1, 4)), "kg"][: int(rng.integers(1, 4))]
        items.append((r.item_id, " ".join(words)))
    items.append((900, "1 2 3 4 5 6 Anna 7 8 9 10 kg"))
    for n in range(60):
        item = items[int(rng.integers(0, len(items)))][1].split()
        new = dict(zip(names, rng.permutation(names), strict=True)) if n % 2 else {}
        words = [new.get(w, w) for w in item]
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(0, len(words)))
            words[at : at + int(rng.integers(0, 2))] = [str(rng.choice([*names, "1", "2", "filler"]))]
        cut = int(rng.integers(0, len(words)))
        docs.append((n, " ".join(["some words in front"] + words[:cut] + ["and a gap"] * int(rng.integers(0, 2)) + words[cut:])))
    got = {(r.doc_id, r.item_id): (r.matched, r.windows, r.reparameterised) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = leaks_by_hand(docs, items)
    assert len(want) > 30 and {v[2] for v in want.values()} == {True, False}
    assert got == want


def test_leaks_at_scale_of_the_sample(spark):
    folder = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in queries.op9_decontaminate(spark, folder).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    whole = {(d.doc_id, i) for d in spark.read.parquet(f"{folder}/documents.parquet").collect() for i, t in items if d.text and t.lower() in d.text.lower()}
    assert whole and whole == got


def test_classifiers_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for query, label, hits, false in ((queries.op1_toxicity, "toxic", 0.85, 0.01), (queries.op6_quality, "quality", 0.97, 0.05)):
        rows = query(spark, folder).join(labels, "doc_id").where("held_out").select("predicted", F.col(label).alias("y")).toPandas()
        assert rows.predicted[rows.y == 1].mean() > hits and rows.predicted[rows.y == 0].mean() < false


def test_licenses(spark):
    text = licenses.MIT.replace("Copyright (c) <year> <copyright holders>", "Copyright 2020 Someone").upper().replace(",", " ,")
    df = spark.createDataFrame([(1, text), (2, "prose\nReleased under the MIT Licence!\nmore"), (3, licenses.MIT + "but")], "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.notices) for r in licenses.scan_licenses(df).collect()}
    assert got == {1: ("MIT", []), 2: (None, ["MIT"]), 3: (None, [])}


def test_full_licenses_of_the_table(spark):
    """Digests of texts too long to hold here, against Debian's copies; a whole licence in one line is a notice too."""
    folder = Path("/usr/share/common-licenses")
    want = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(name, (folder / name).read_text()) for name in want if (folder / name).exists()]
    if not rows:
        pytest.skip("no licence texts on this machine")
    df = spark.createDataFrame([*rows, ("one line", "prose\n" + licenses.UNLICENSE.replace("\n", " "))], "name string, text string")
    names = [n for n, _ in rows] + ["one line"]
    got = {names[r.doc_id]: (r.license_id, r.notices) for r in licenses.scan_licenses(df.select(F.expr(f"array_position(array({', '.join(repr(n) for n in names)}), name) - 1").alias("doc_id"), "text")).collect()}
    assert got.pop("one line") == (None, ["Unlicense"])
    assert {n: i for n, (i, _) in got.items()} == {n: want[n] for n in got}


def test_small_side_is_proved_by_bytes(spark):
    """Few long rows are not small, many short ones may be."""
    marked = lambda df, most: "ResolvedHint" in common.small_side(df, most)._jdf.queryExecution().analyzed().toString()
    few = spark.createDataFrame([(1, "x" * 5000, ["y" * 5000])], "k long, t string, l array<string>")
    assert not marked(few, 9000) and marked(few, 20_000)
    assert marked(spark.range(1000), 16_000) and not marked(spark.range(1001), 16_000)
    assert marked(few.limit(0), 0)


def test_word_hashes_by_segments(monkeypatch):
    text = ("Ab  cd\té\x0b" * 50 + "z" * 300).encode()
    whole = common.word_hashes(text)
    monkeypatch.setattr(common, "SEGMENT", 64)
    assert np.array_equal(common.word_hashes(text), whole) and len(whole) == 151
    assert np.array_equal(common.word_hashes(text.replace(b"A", b"a")), whole)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = corpus_pipeline.run(spark, FOLDER)
    assert 0 < kept.count() < docs.count() and set(docs.columns) < set(kept.columns)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    linked = jaccard.linked_documents(kept).where("doc_id <> component_id")
    assert linked.count() == 0
    assert decontaminate.contaminated(kept, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).count() == 0


def test_pipeline_stages_against_plain_code(spark):
    """Lines, near-duplicates and leaks, each on its own input; the texts are compared in plain Python."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)

    def texts(df):
        return {r.doc_id: r for r in df.select("doc_id", "text", "source").collect()}

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = texts(docs)
    sites, first = {}, {}
    for i in sorted(rows):
        for pos, line in enumerate((rows[i].text or "").split("\n")):
            bare = line.strip(" \t\x0b\x0c\r")
            if bare:
                sites.setdefault(bare, set()).update({rows[i].source} - {None})
                first.setdefault(bare, (i, pos))

    def cut(i, text):
        kept = []
        for pos, line in enumerate(text.split("\n")):
            bare = line.strip(" \t\x0b\x0c\r")
            if len(sites.get(bare, ())) < 8 or first[bare] == (i, pos):
                kept.append(line)
        return "\n".join(kept)

    lined = corpus_pipeline.stored(stages["line dedup"](spark, docs, FOLDER))
    after = texts(lined)
    assert {i: r.text for i, r in after.items()} == {i: None if r.text is None else cut(i, r.text) for i, r in rows.items()}

    sets = {}
    for i, r in after.items():
        words = re.findall(common.WORD, (r.text or "").translate(str.maketrans(common.UPPER, common.LOWER)))
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    for at, i in enumerate(order):
        for j in order[at + 1 :]:
            if 80 * len(sets[j]) > 100 * len(sets[i]):
                break
            same = len(sets[i] & sets[j])
            if 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    unique = corpus_pipeline.stored(stages["n-gram Jaccard join"](spark, lined, FOLDER))
    assert set(texts(unique)) == {i for i in root if root[i] == i}

    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    leaks = {r.doc_id for r in decontaminate.contaminated(unique, benchmark).collect()}
    assert leaks and set(texts(stages["benchmark decontamination"](spark, unique, FOLDER))) == set(texts(unique)) - leaks


def test_classifier_and_mixing_stages_against_plain_code(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scores = {r.doc_id: r.score for r in quality.score_quality(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"), F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2).collect()}
    kept = stages["quality classifier"](spark, docs, FOLDER)
    assert bag(kept) == bag(docs.where(F.col("doc_id").isin([i for i, s in scores.items() if s >= 0.5])))
    taken = {r.doc_id: r.copies for r in mixing.mixture(docs).where("copies > 0").collect()}
    mixed = stages["mixing sources to target weights"](spark, docs, FOLDER)
    assert {r.doc_id: r.copies for r in mixed.collect()} == taken and mixed.count() == len(taken)


CLASHING = ["copies", "finish", "removed", "mark", "doc_id__", "mark__", "row", "at", "id", "rk", "n", "size", "key", "text_hash", "node"]


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows(spark, stage):
    """Nulls, repeated rows, texts that share a doc_id, clashing names and empty tables: rows go only where the stage says so."""
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    near = [f"w{i}" for i in range(60)]
    leak = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, " ".join(near), "en", "a", 0), (2, " ".join(near[:-1]), "en", "b", 0), (None, " ".join(near[1:]), None, None, None), (2, "a text of its own under a shared number", "en", "c", 1), (None, None, None, None, None), (None, "", "en", "a", 0), (5, LONG, "en", "a", 9), (7, f"in front {leak} behind", "en", "b", 3), (7, "not a leak at all but the same number", "en", "b", 3), (8, "twice", "en", "a", 1), (8, "twice", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).select("*", *(F.lit(i).alias(x) for i, x in enumerate(CLASHING)))
    got = corpus_pipeline.stored(run(spark, docs, FOLDER))
    assert got.columns[: len(docs.columns)] == docs.columns and all(r[x] == i for r in got.collect() for i, x in enumerate(CLASHING))
    left = sorted((str(r.doc_id), str(r.text)) for r in got.collect())
    every = sorted((str(r[0]), str(r[1])) for r in rows)
    gone = {2: [every.index(("2", rows[1][1])), every.index(("None", rows[2][1]))], 3: [every.index(("7", rows[7][1]))]}.get(stage, [])
    if stage in (1, 2, 3):
        assert left == [x for i, x in enumerate(every) if i not in gone]
    elif stage == 4:
        assert set(left) <= set(every) and ("None", "None") not in left and ("None", "") not in left
        assert got.columns[len(docs.columns) :] == ["copies_", "finish_"] and got.where("doc_id is null").count() == 1
    empty_ = run(spark, docs.limit(0), FOLDER)
    assert empty_.count() == 0 and empty_.columns == got.columns
