"""Nulls, ties, repeated rows, clashing columns, long texts and exactness of the corpus operators."""

import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigloom import workspace as shared_workspace
from sigloom.llm import decontaminate, embedding_dup, language, mixing, near_dup, paragraph_dup, pipeline, quality, queries, substrings, url_filter, words
from sigloom.llm.workspace import Workspace, fresh, hot_join, keyed_rows

CLASHES = ("k", "K1", "starts", "_row", "row_key", "repeated_starts", "d", "node", "id", "kept", "size", "number", "u", "label", "score")


def prose(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def clashing(spark, rows):
    """Documents with columns named like what operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *CLASHES) for i, t in rows], schema)


def duck(sql, **tables):
    import duckdb

    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toArrow())
    return con.execute(sql)


def same_as_sql(frame, sql, **tables):
    columns = sorted(frame.columns)
    ours = sorted(map(str, (tuple(r[c] for c in columns) for r in frame.collect())))
    return ours == sorted(map(str, duck(f"select {', '.join(columns)} from ({sql})", **tables).fetchall()))


# --- words and links


def thue_morse(n, a, b):
    x = [0]
    while len(x) < n:
        x += [1 - v for v in x]
    return "".join((a, b)[v] for v in x)


def test_long_words_built_alike_are_told_apart(spark):
    one, two = thue_morse(2048, "p", "q"), thue_morse(2048, "q", "p")
    column = pa.array([one, two, one.upper()])
    for _, _, data, off in words.slices(column):
        hashes, _, _, _ = words.word_hashes(data, off)
        assert hashes[0] != hashes[1] and hashes[0] == hashes[2]
        numbers, _ = words.exact_words(data, off)
        assert numbers[0] != numbers[1] and numbers[0] == numbers[2]
    out = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(clashing(spark, [(1, one), (2, two)])).collect()}
    assert out == {1: 1, 2: 2}


def test_words_are_told_apart_where_hashes_agree(monkeypatch):
    real = words.word_hashes

    def weak(data, off):
        hashes, s, e, first = real(data, off)
        return hashes % np.uint64(3), s, e, first

    monkeypatch.setattr(words, "word_hashes", weak)
    texts = ["a b c d e f", "A b c d e f g", "x", "", "a b"]
    numbers, first = words.exact_sets(*words.whole_column(pa.array(texts)))
    sets = [set(numbers[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
    assert [len(x) for x in sets] == [2, 3, 1, 0, 1] and sets[0] < sets[1] and not sets[2] & (sets[0] | sets[4])


def test_members_that_tokens_do_not_part_meet_in_blocks(spark, monkeypatch):
    for name, value in (("LEAF", 2), ("NODE_MEMBERS", 6), ("DEPTH", 0)):
        monkeypatch.setattr(near_dup, name, value)
    rng = random.Random(1)
    common, rows = prose(rng, 40), []
    for i in range(20):
        own = prose(rng, 40)
        rows += [(2 * i, f"{common} {own}"), (2 * i + 1, f"{common} {own} end")]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(clashing(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in range(40)}


def test_frequent_keys_and_names(spark):
    rows = spark.createDataFrame([(1, i) for i in range(3000)] + [(2, 0)], "a long, v long")
    table = spark.createDataFrame([(1, "x", 3000), (2, "y", 1), (3, "z", 0)], "a long, name string, n long")
    out = hot_join(rows, table, ["a"], "n", 3001).groupBy("name").count().collect()
    assert {tuple(r) for r in out} == {("x", 3000), ("y", 1)}
    assert fresh(["row_key", "A"], "row_key") == "_row_key" and fresh(["A"], "a") == "_a"
    keyed, name = keyed_rows(clashing(spark, [(1, "a"), (1, "a"), (None, "b")]), Workspace(spark, "t"))
    assert name == "_row_key" and keyed.select(name).distinct().count() == 3


# --- every operator on one odd table


def odd(spark):
    rng = random.Random(2)
    long = prose(rng, 60_000)
    rows = [(1, long), (2, long), (3, None), (4, ""), (None, "a b"), (None, "a b"), (5, "x"), (5, "x"), (6, "\n\t "), (7, "é" * 500), (7, prose(rng, 300))]
    return clashing(spark, rows)


def test_long_null_repeated_and_clashing_rows_everywhere(spark, tmp_path):
    docs = odd(spark)
    n = docs.count()
    assert near_dup.near_duplicates(docs).count() == n
    assert substrings.report(docs).count() == n
    out = substrings.remove(docs)
    assert out.count() == n and out.columns == docs.columns and out.where("text is null").count() == 1
    assert out.where("doc_id in (1, 2) and text <> ''").count() == 0
    model = quality.fit(docs, spark.createDataFrame([(1, 1), (5, 0), (5, 1), (None, 0)], "doc_id long, quality int"))
    assert quality.classify(docs, model).where("score between 0 and 1").count() == n
    assert language.identify(docs, language.fit(docs)).count() == n
    assert mixing.mix(docs).count() == n
    assert {r["doc_id"] for r in paragraph_dup.repeated_paragraphs(docs).collect()} == {1, 2}
    bench = spark.createDataFrame([(1, " ".join(prose(random.Random(2), 60_000).split()[500:530])), (2, None)], "item_id int, text string")
    found = decontaminate.find(docs, bench)
    assert dict(found.dtypes)["item_id"] == "int" and {r["doc_id"] for r in found.collect()} == {1, 2}
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == n - 2
    spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in pipeline.STAGES:
        for frame in (docs, docs.where("false")):
            got = stage(spark, frame, str(tmp_path))
            assert name == "mixing" or got.columns == frame.columns
            assert got.count() <= frame.count()


def test_text_ids(spark):
    rng = random.Random(3)
    rows = [(f"id{i}", prose(rng, 80)) for i in range(6)] + [("twin", None)]
    rows[6] = ("twin", rows[0][1])
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert {r["doc_id"] for r in near_dup.near_duplicates(docs).where("not kept").collect()} == {"twin"}
    assert substrings.report(docs).where("n_removed > 0").count() == 2
    model = quality.fit(docs, spark.createDataFrame([("id1", 1), ("id2", 0), ("id3", 1)], "doc_id string, quality int"))
    assert quality.classify(docs, model).count() == 7 and mixing.mix(docs.withColumn("source", F.lit("a"))).count() == 7
    assert {r["doc_id"] for r in paragraph_dup.repeated_paragraphs(docs).collect()} == {"id0", "twin"}
    found = decontaminate.find(docs, spark.createDataFrame([("q", " ".join(rows[1][1].split()[10:40]))], "item_id string, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [("id1", "q")]


# --- substrings


def test_substrings_equal_sql_with_repeated_rows_and_null_ids(spark):
    rng = random.Random(4)
    passage = prose(rng, 60)
    rows = [(i, f"{prose(rng, 40)} {passage if i % 3 == 0 else ''} é {prose(rng, 30)}") for i in range(12)]
    rows += [(None, rows[0][1]), (3, rows[1][1]), (3, rows[1][1]), (20, "ab" * 300), (21, None), (22, "x" * 199), (23, "x" * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert same_as_sql(substrings.report(docs), queries.OP3_SQL, documents=docs)


def test_equal_rows_have_marks_of_their_own(spark):
    text = prose(random.Random(5), 100)
    docs = spark.createDataFrame([(1, text)] * 200, "doc_id long, text string")
    work = Workspace(spark, "t")
    keyed, name = keyed_rows(docs, work)
    starts = substrings.repeated_starts(keyed.select(F.col(name).alias("k"), "text"), work).collect()
    assert len(starts) == 200 and max(len(r["starts"]) for r in starts) < 200


# --- quality


def test_votes_equal_plain_loops(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 60) if i % 2 else "BUY NOW!!! " * rng.randrange(5, 40)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    kinds = {i: int(quality._CLASS[i]) for i in range(256)}

    def terms(text):
        data, out = text.encode(), [0.0] * quality.DIMS
        for a, b in zip(data, data[1:]):
            out[int(quality._PAIR[a << 8 | b])] += 1
        for a, b, c in zip(data, data[1:], data[2:]):
            out[quality.PAIRS + (kinds[a] << 8 | kinds[b] << 4 | kinds[c])] += 1
        w = text.lower().split()
        if w:
            most = max(w.count(x) for x in set(w))
            twins = sum(x == y for x, y in zip(w, w[1:]))
            for k, share in enumerate((1 - len(set(w)) / len(w), (most - 1) / len(w), (twins / len(w)) ** 0.5)):
                out[quality.PAIRS + quality.CLASSES + k * quality.LEVELS + min(quality.LEVELS - 1, int(share * quality.LEVELS))] = 400.0 if k == 2 else 20.0
        return np.array(out)

    def unit(v):
        return v / max(np.sqrt((v * v).sum()), 1e-12)

    asked = [rows[1][1], rows[2][1], "some other words BUY", prose(rng, 30)]
    got = {r["doc_id"]: r["score"] for r in quality.classify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(asked):
        v = unit(unit(np.log1p(terms(text)) * model.idf) @ model.project)
        near = sorted(((float(v @ x), j) for j, x in enumerate(model.vectors)), reverse=True)[: quality.NEIGHBOURS]
        votes = [(max(c, 0) ** quality.SHARPNESS * model.weights[j], model.labels[j]) for c, j in near]
        assert got[i] == pytest.approx(sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs=2e-3)


def test_samples_of_repeated_ids_stay_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(3, "other")], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(1, 1), (3, 0), (1, 1)], "doc_id long, quality int"))
    assert len(model.labels) <= 2


# --- language


def test_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(i, "the dog and the cat", "en") for i in range(9)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    odd = spark.createDataFrame([(1, "½ ² Ⅷ"), (2, "٣ 四"), (3, "ª"), (4, "١٢")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, model).collect()}
    assert got == {1: "und", 2: "en", 3: "en", 4: "und"}


def test_long_texts_are_parsed_as_a_whole():
    rng = random.Random(7)
    samples = {"a": ["".join(rng.choices("abc d", k=900))], "b": ["".join(rng.choices("cde f", k=900))]}
    model = language.build(samples)
    parser, lookup = language.Parser(model), model.lookup()
    texts = ["", "a" * 3000, "ab" * 2000, "".join(rng.choices("abcdef ", k=5000)), "xyz " * 400, samples["a"][0] * 4, "a"]
    need, size = language.parse_texts(texts, parser, lookup)
    for i, text in enumerate(texts):
        s = language.symbols_of(language.code_points(text), lookup)
        assert need[i].tolist() == [parser.plain(s, k) for k in range(2)] and size[i] == len(s)


def test_the_fit_is_bounded_by_rows(spark):
    rows = [(i, f"word{i} " * 3, "en") for i in range(400)] + [(5000 + i, "x" * 9000 + str(i), "xx") for i in range(40)] + [(1, "same text", "de")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, sample_rows=5, sample_chars=100)
    assert model.languages == ["de", "en", "xx"]
    assert language.fit(docs, languages=2).languages == ["de", "en"]


# --- mixing


def test_equal_rows_are_told_apart(spark):
    rows = [(1, "a b c d e f g", "s")] * 40 + [(None, "x " * 9, "t")] * 30 + [(None, None, None)] * 5 + [(i, "y " * (i % 50), "t") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs)
    for source in ("s", "t"):
        mine = out.where(F.col("source") == source).collect()
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 25
    assert max(r["taken"] - 3 * r["size"] for r in out.collect()) <= 0
    sql = out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")
    assert same_as_sql(sql, f"SELECT doc_id, size, source_size, round(target, 6) AS target, taken FROM ({queries.OP6_SQL})", documents=docs)
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_words_are_counted_as_by_a_plain_split(spark):
    rng = random.Random(19)
    texts = [None, "", " ", "\n\t \x0b\x0c\r", "x", " x", "x ", "\u00a0", "\x1c x\x85y \u2003", "\U0001f600 \U0001f600", "x" * 5000, "xx x$1 \\ x\x00x"]
    texts += ["".join(rng.choice("ab\u00e9\U0001f600\u00a0\x1f \t\n\x0b\x0c\r") for _ in range(rng.randrange(60))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", mixing.word_count(F.col("text")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in rows} == {i: len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in enumerate(texts)}


def test_inclusion_follows_size(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.choice([10, 100]), "ab"[i % 2]) for i in range(4000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("source = 'b'")
    share = {r["size"]: r["share"] for r in out.groupBy("size").agg(F.avg(F.col("copies")).alias("share")).collect()}
    one = out.first()
    f = one["target"] / one["source_size"]
    assert f < 1 and share[100] > 4 * share[10] and share[100] <= 1
    assert out.agg(F.sum("taken")).first()[0] == pytest.approx(one["target"], abs=100)


# --- embeddings


def test_huge_and_tiny_vectors(spark):
    a = np.random.default_rng(9).normal(size=8)
    rows = [(1, (a * 1e200).tolist(), 1), (2, (a * 1e200 * 1.001 + 1e197).tolist(), 1), (3, (a * 1e-300).tolist(), 1), (4, (-a).tolist(), 1), (5, (a * 1e-300).tolist(), None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}


def test_graph_finds_the_links_of_dense_and_sparse_vectors():
    rng = np.random.default_rng(10)
    sparse = rng.normal(size=(2500, 32))
    pairs = sparse[:300] + rng.normal(size=(300, 32)) * 0.25
    dense = sparse[0] + rng.normal(size=(700, 32)) * 0.2
    unit = embedding_dup._unit(np.concatenate([sparse, pairs, dense]))
    found = embedding_dup.audited(embedding_dup.Graph(unit), unit, 0.93)
    truth = [np.flatnonzero(c >= 0.93) for c in unit @ unit.T]
    hits = [len(np.intersect1d(t, f)) for t, f in zip(truth, found)]
    assert sum(hits) >= 0.999 * sum(map(len, truth)) and all(len(np.unique(f)) == len(f) for f in found)
    alone = [i for i, t in enumerate(truth) if 1 < len(t) < 5]
    assert len(alone) > 200 and np.mean([hits[i] == len(truth[i]) for i in alone]) >= 0.98


# --- urls


def test_one_verdict_teaches_nothing(spark):
    rows = [(i, f"http://a.org/es/{i}") for i in range(30)] + [(100, "http://b.xyz/"), (101, "http://b.xyz/"), (None, None), (102, "")]
    got = {(r["page_id"], r["verdict"], r["score"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert {(i, "block", None) for i in range(30)} <= got and (100, "allow", 0.0) in got and (101, "allow", 0.0) in got and (None, "allow", 0.0) in got


def test_repeated_urls_are_judged_each(spark):
    rows = [(i, f"http://x.{'net/de' if i % 2 else 'org/es'}/{i}") for i in range(200)] + [(1000 + i, "http://same.xyz/") for i in range(300)] + [(2000, None)] * 3 + [(2001, "")]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"))
    assert out.count() == len(rows) and out.where("page_id between 1000 and 1999").select("verdict", "score").distinct().count() == 1
    assert out.where("page_id = 2000").count() == 3 and out.where("page_id >= 2000").select("score").distinct().count() == 1


# --- paragraphs


def test_paragraph_recall_against_brute_force(spark):
    rng = random.Random(11)
    lines, rows = [prose(rng, rng.randrange(15, 60), 3000) for _ in range(120)], []
    for i in range(300):
        own = []
        for line in rng.sample(lines, 2):
            w = line.split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(999)}"
            own.append(" ".join(w))
        rows.append((i, "\n".join([*own, prose(rng, 5), prose(rng, 20)])))
    units = [(i, n, line) for i, t in rows for n, line in enumerate(t.split("\n")) if len(line.split()) >= paragraph_dup.MIN_WORDS]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (u[2].split() for u in units)]
    parent = list(range(len(units)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = set()
    for a in range(len(units)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 75 * (len(sets[a]) + len(sets[b]) - inter):
                parent[root(a)] = root(b)
                linked |= {units[a][:2], units[b][:2]}
    got = paragraph_dup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).where("unit = 'line'").collect()
    found = {(r["doc_id"], r["paragraph"]) for r in got}
    assert found <= linked and len(found) >= 0.97 * len(linked) and len(linked) > 200
    group = {}
    for k, u in enumerate(units):
        group.setdefault(root(k), set()).add(u[:2])
    components = {}
    for r in got:
        components.setdefault(r["component_id"], set()).add((r["doc_id"], r["paragraph"]))
    whole = {frozenset(g) for g in group.values() if len(g) > 1}
    assert all(any(c <= g for g in whole) for c in components.values())
    assert sum(frozenset(c) in whole for c in components.values()) >= 0.9 * len(whole)
    assert sum(r["kept"] for r in got) == len(components)


def test_no_paragraph_link_at_the_threshold_is_left_out(spark):
    rng, rows = random.Random(31), []
    for i in range(400):
        text = prose(rng, 40, 50000).split()
        near = list(text)
        near[rng.randrange(4, 36)] = "changed"  # 36 shingles, 5 differ: 31 / 41 = .756
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(near))]
    got = paragraph_dup.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).where("start_word = 0").collect()
    for unit in ("line", "window"):
        joined = {}
        for r in got:
            if r["unit"] == unit:
                joined.setdefault(r["component_id"], []).append(r["doc_id"])
        assert sorted(map(sorted, joined.values())) == [[2 * i, 2 * i + 1] for i in range(400)]


def test_lines_repeat_within_a_document_and_equal_rows_are_two(spark):
    rng = random.Random(12)
    line = prose(rng, 20)
    one = paragraph_dup.repeated_paragraphs(clashing(spark, [(1, f"{line}\n{prose(rng, 20)}\n{line}")])).collect()
    assert [(r["paragraph"], r["kept"]) for r in sorted(one, key=lambda r: r["paragraph"])] == [(0, True), (2, False)]
    twins = paragraph_dup.repeated_paragraphs(clashing(spark, [(4, prose(random.Random(13), 60))] * 2)).collect()
    apart = paragraph_dup.repeated_paragraphs(clashing(spark, [(i, prose(random.Random(13), 60)) for i in (4, 5)])).collect()
    assert len(twins) == len(apart) > 0 and sum(r["kept"] for r in twins) == sum(r["kept"] for r in apart)


def test_links_by_rare_shingles_equal_all_pairs(monkeypatch):
    rng = random.Random(41)
    for trial in range(40):
        texts = []
        for _ in range(rng.randrange(1, 50)):
            text = rng.choice(texts).split() if texts and rng.random() < 0.7 else [f"w{rng.randrange(6 if trial % 2 else 400)}" for _ in range(rng.randrange(50))]
            for _ in range(rng.randrange(4) if text else 0):
                text[rng.randrange(len(text))] = f"w{rng.randrange(6)}"
            texts.append(" ".join(text))
        sets = [{tuple(t.split()[i : i + 5]) for i in range(max(len(t.split()) - 4, min(len(t.split()), 1)))} for t in texts]
        linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
        for listed in (words.LISTED, -1):
            with monkeypatch.context() as m:
                m.setattr(words, "LISTED", listed)
                src, dst = words.link_forest(pa.chunked_array([pa.array(texts)]), np.arange(len(texts)), 75)
            assert all(tuple(sorted(p, reverse=True)) in linked for p in zip(src, dst))
            assert groups(len(texts), zip(src, dst)) == groups(len(texts), linked)


def groups(n, links):
    root = list(range(n))
    for a, b in links:
        root = [root[a] if r == root[b] else r for r in root]
    return sorted(Counter(root).values()), [root.index(r) for r in root]


def test_finished_writes_leave_no_shuffle_files(spark):
    import glob
    import time

    files = lambda: set(glob.glob(os.path.join(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath(), "*", "shuffle_*")))
    before, work = files(), Workspace(spark, "test")
    kept = spark.range(1000).repartition(5, "id").groupBy("id").count()
    table = work.save(kept, "t")
    time.sleep(2)
    assert not files() - before
    assert table.count() == kept.count() == 1000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


# --- benchmark


def test_the_benchmark_index_follows_the_items():
    rng = random.Random(29)
    table = pa.table({"item_id": pa.array(range(100)), "text": [prose(rng, rng.randrange(5, 60)) for _ in range(100)]})
    items = decontaminate.prepare(table)
    assert sum(b.nbytes for b in items.bitmaps.values()) < 8_000_000 and all(len(b) >= 64 * len(items.tables[k][0]) for k, b in items.bitmaps.items())


@pytest.mark.parametrize("n", [5, 8, 15, 40, 100, 300])
def test_items_with_all_their_edits_are_found(n):
    rng = random.Random(n)
    items, texts = [prose(rng, n).split() for _ in range(100)], []
    for item in items:
        w = list(item)
        for _ in range(decontaminate.edits_allowed(n)):
            p = rng.randrange(max(len(w), 1))
            w[p : p + rng.choice([0, 1, 1])] = [f"x{rng.randrange(10**9)}"][: rng.choice([0, 1, 1])]
        texts.append(f"{prose(rng, 30)} {' '.join(w)} {prose(rng, 30)}")
    made = decontaminate.prepare(pa.table({"item_id": list(range(100)), "text": [" ".join(i) for i in items]}))
    found = {(x, y) for x, y, _, _ in decontaminate._hits(pa.array(texts), made)}
    assert sum((i, i) in found for i in range(100)) >= 96


def test_walks_follow_the_recall_that_is_asked_for():
    assert decontaminate.walks_for(12, 0.75, 0.999) >= decontaminate.walks_for(12, 0.75, 0.9)
    assert decontaminate.walks_for(60) <= decontaminate.walks_for(8) <= decontaminate.WALKS


# --- plans


def test_texts_and_sketches_are_dealt_out_at_every_size(spark):
    rng = random.Random(41)
    docs = spark.createDataFrame([(i, prose(rng, 20)) for i in range(20)], "doc_id long, text string")
    pairs = spark.createDataFrame([(0, 1), (2, 3)], "a long, b long")
    reps = near_dup.signatures(docs).selectExpr("doc_id as id", "n_shingles as n", "sig")
    for made in (near_dup.verify(pairs, docs), near_dup._likely(pairs, reps)):
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_pairs_that_cannot_be_linked_are_told_by_hashes(monkeypatch):
    rng = random.Random(31)
    a, b = [], []
    for _ in range(600):
        one = [f"w{rng.randrange(rng.choice([2, 6, 3000]))}" for _ in range(rng.randrange(60))]
        two = one[rng.randrange(4) :] + ["y"] * rng.randrange(3)
        for _ in range(rng.randrange(6) if two else 0):
            two[rng.randrange(len(two))] = f"x{rng.randrange(9)}"
        a.append(" ".join(one))
        b.append(" ".join(two))
    linked = [(lambda i, u: u > 0 and 100 * i >= 75 * u)(*paragraph_dup.similarity(x, y)) for x, y in zip(a, b)]
    near = words.maybe_linked(pa.array(a), pa.array(b), np.arange(len(b)), 75)
    assert any(linked) and not any(x and not y for x, y in zip(linked, near.tolist()))
    # windows of 40 words that begin 10 words apart have 26 of 46 shingles in common
    line = [f"v{i}" for i in range(300)]
    cut = [" ".join(line[i : i + 40]) for i in range(0, 250, 10)]
    ids = pa.array(range(24))
    batch = pa.RecordBatch.from_arrays([ids, pa.array([i // 2 for i in range(24)]), pa.array(cut[1:]), pa.array(cut[:-1])], ["a", "b", "ua", "ub"])
    seen = []
    judged = paragraph_dup.linked_pairs
    monkeypatch.setattr(paragraph_dup, "linked_pairs", lambda x, y, *rest: seen.append(len(y)) or judged(x, y, *rest))
    assert sum(r.num_rows for r in paragraph_dup._verified(iter([batch]))) == 0 and sum(seen) == 0


def test_small_buckets_are_compared_together_and_linked_apart(monkeypatch):
    rng = random.Random(37)
    rows = []
    for bucket in range(300):
        one = prose(rng, 40).split()
        for _ in range(rng.choice([1, 2, 3, 9])):
            two = list(one)
            for _ in range(rng.randrange(3)):
                two[rng.randrange(40)] = f"x{rng.randrange(9)}"
            rows.append((bucket, len(rows), " ".join(two)))
            if rng.random() < 0.3:  # stands in the next bucket too
                rows.append((bucket + 1, len(rows), " ".join(two)))
    rows.sort()
    want = {}
    for bucket, group in itertools.groupby(rows, lambda r: r[0]):
        group = list(group)
        label = {i: i for _, i, _ in group}
        for (_, i, x), (_, j, y) in itertools.combinations(group, 2):
            inter, union = paragraph_dup.similarity(x, y)
            if 100 * inter >= 75 * union:
                label = {k: min(label[i], label[j]) if v in (label[i], label[j]) else v for k, v in label.items()}
        want |= label
    calls = []
    compare = paragraph_dup.group_forest
    monkeypatch.setattr(paragraph_dup, "TOGETHER", 500)
    monkeypatch.setattr(paragraph_dup, "group_forest", lambda *a: calls.append(1) or compare(*a))
    batches = pa.table([pa.array(c) for c in zip(*rows)], ["bucket", "d", "unit"]).to_batches(max_chunksize=100)
    got = {i: i for _, i, _ in rows}
    links = [tuple(r.values()) for b in paragraph_dup._compared(iter(batches)) for r in b.to_pylist()]
    for i, j in links:
        got = {k: min(got[i], got[j]) if v in (got[i], got[j]) else v for k, v in got.items()}
    assert got == want and len(set(want.values())) < len(want) and 2 <= len(calls) <= 5


def test_links_of_many_batches_are_numbered_at_once():
    import time

    def batches(kind, many):
        ends = np.random.default_rng(41).integers(0, 2**40, (2, 1000 * many)) if kind == pa.int64() else np.array([["b", "c"] * many, ["a", "b"] * many])
        table = pa.table([pa.array(ends.max(0) if kind == pa.int64() else ends[0], kind), pa.array(ends.min(0) if kind == pa.int64() else ends[1], kind)], ["u", "v"])
        return iter(table.to_batches(max_chunksize=1000))

    assert {tuple(r.values()) for b in shared_workspace._labelled(batches(pa.string(), 600)) for r in b.to_pylist()} == {(x, "a") for x in "abc"}
    began = time.process_time()
    assert sum(b.num_rows for b in shared_workspace._labelled(batches(pa.int64(), 400))) > 790_000
    assert time.process_time() - began < 6


def test_repeated_links_count_once_for_one_task(spark, monkeypatch):
    monkeypatch.setattr(shared_workspace, "FEW", 4)
    rounds = []
    monkeypatch.setattr(shared_workspace, "_digest", lambda df: rounds.append(1) or (0, 0, 0))
    edges = spark.createDataFrame([(3, 1), (2, 1), (3, 2)] * 5, "src long, dst long")
    got = shared_workspace.components(Workspace(spark, "test"), edges).collect()
    assert {(r["id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1)} and not rounds


def test_paragraphs_keep_the_type_of_ids(spark):
    line = prose(random.Random(17), 60)
    got = paragraph_dup.repeated_paragraphs(spark.createDataFrame([(3, line), (9, line)], "doc_id int, text string"))
    assert dict(got.dtypes)["doc_id"] == dict(got.dtypes)["first_doc_id"] == "int"
    assert {(r["doc_id"], r["first_doc_id"]) for r in got.collect()} == {(3, 3), (9, 3)}
