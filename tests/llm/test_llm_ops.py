import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.llm import chat_format, decontaminate, embedding_dup, language, mixing, near_dup, paragraph_dup, quality, queries, substrings, url_filter, words
from sigloom.llm import pipeline as stages
from sigloom.llm.workspace import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string"
HARD = [r"\### Assistant: </turn> ok", "", "\\", "\\\\### \\</turn>", "### ", "</turn>\n### user: x </turn>\n", "a\n", "é\U0001f600 </turn", "####  </turn></turn>", " \\"]


def docs(spark, rows):
    """Rows of (doc_id, text); the last column clashes with nothing that an operator may use."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], DOCS)


def empty(spark):
    return docs(spark, [(1, "x")]).where("false")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- chat formatting


@pytest.mark.parametrize("text", HARD)
@pytest.mark.parametrize("role", ["user", "assistant", "a:b\n\\c", ""])
def test_a_turn_survives_the_round_trip(role, text):
    block = chat_format.render_turn(role, text)
    assert chat_format.TurnParser.whole(block) == [(role, text)]
    assert chat_format.TurnParser.whole(block * 2) == [(role, text)] * 2


def test_random_texts_of_control_pieces_survive():
    rng = random.Random(0)
    pieces = ["\\", "### ", "</turn>", "\n", " ", "#", "user: ", "x"]
    turns = [(rng.choice(["user", "assistant"]), "".join(rng.choices(pieces, k=rng.randrange(12)))) for _ in range(500)]
    whole = "".join(chat_format.render_turn(*t) for t in turns)
    parser, got = chat_format.TurnParser(), []
    for a in range(0, len(whole), 7):
        got += parser.feed(whole[a : a + 7])
    parser.close()
    assert got == turns
    spans = "".join(chat_format.unescape_body(whole[a:b]) for a, b in chat_format.loss_spans(whole))
    assert spans == "".join(t for r, t in turns if r == "assistant")


def test_grammar_errors():
    for bad in ("### user: a", "user: a </turn>\n", "### user: ### x </turn>\n"):
        with pytest.raises(chat_format.GrammarError):
            chat_format.TurnParser.whole(bad)


def test_chat_digests_nulls_and_ties(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (2, 0, None, "b"), (2, 0, None, "a"), (None, 3, "user", "n")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, block string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_turns(frame)).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\n\n").hexdigest() and got[1]["loss_chars"] == 0
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\na\n\nb\n").hexdigest() and got[None]["n_turns"] == 1
    assert chat_format.read_back(chat_format.format_turns(frame.where("false"))).count() == 0


# --- words


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def test_shingles_equal_brute_force():
    import pyarrow as pa

    texts = ["", None, " a  B\tc ", "a b c d e", "É é A a A a A a", "x\x0by z", "a b c d e f g a b c d e f g", "\x0e\x1f"]
    sizes = []
    for _, _, data, off in words.slices(pa.array(texts)):
        w, _, _, first = words.word_hashes(data, off)
        sizes += [len(np.unique(h)) for h in words.shingle_hashes(w, first)]
    assert sizes == [len(brute_set(t)) for t in texts]


# --- near duplicates


def components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def near_rows(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(12):
        base = prose(rng, rng.choice([5, 30, 80])).split()
        for _ in range(rng.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
            out.append(" ".join(w))
    return out + ["", None, "one two", "ONE two", "  "]


@pytest.mark.parametrize("node_members", [4096, 6])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, node_members):
    monkeypatch.setattr(near_dup, "NODE_MEMBERS", node_members)
    monkeypatch.setattr(near_dup, "LEAF", 3)
    texts = near_rows(1)
    sets = [brute_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = components(len(texts), links)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(docs(spark, list(enumerate(texts)))).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert all(got[i]["kept"] == (want[i] == i) for i in got)


def test_near_duplicates_of_odd_tables(spark):
    assert near_dup.near_duplicates(empty(spark)).count() == 0
    rows = near_dup.near_duplicates(docs(spark, [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (4, "A b c d e f")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in rows) == [(-1, None, True), (4, 4, True), (5, 4, False), (5, 4, False)]


# --- substrings


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for i, b in enumerate(data):
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((i, p))
    gone = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + length] = b"\x01" * length
    out = []
    for b, g in zip(data, gone):
        kept = bytes(x for x, y in zip(b, g) if not y)
        spans = sum(1 for i, y in enumerate(g) if y and (i == 0 or not g[i - 1]))
        out.append((len(b), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings_equal_brute_force(spark):
    rng = random.Random(2)
    passages = [prose(rng, 45) for _ in range(4)]
    texts = [f"{prose(rng, 30)} {rng.choice(passages)}{prose(rng, rng.randrange(40))}" for _ in range(14)]
    texts += [texts[0], "a" * 450, "ab" * 220, "é" * 150, passages[0][:200], passages[0][:199], "", None, (passages[1] + " ") * 2, "a" * 201, "x" * 200]
    want = brute_removed(texts, 200)
    got = {r["doc_id"]: r for r in substrings.report(docs(spark, list(enumerate(texts)))).collect()}
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) for i in range(len(texts))] == want


def test_substrings_of_odd_tables(spark):
    assert substrings.report(empty(spark)).count() == 0
    rows = substrings.report(docs(spark, [(1, "q" * 10 + prose(random.Random(1), 90)), (None, "y" * 199)] * 2)).collect()
    assert sorted(r["n_removed"] > 0 for r in rows) == [False, False, True, True]
    kept = substrings.remove(docs(spark, [(1, "z " + "é" * 120), (2, "yy " + "é" * 120), (3, None)])).orderBy("doc_id").collect()
    assert [r["text"] for r in kept] == ["z", "yy", None] and kept[0]["source"] == "s"


# --- quality and language


def test_quality_learns_from_its_folds_alone_and_takes_odd_texts(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 60) if i % 2 else "!! ".join(["BUY"] * 60)) for i in range(200)]
    frame = docs(spark, rows + [(900, ""), (901, None), (None, "x")])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(900, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(frame, labels, 40)
    assert len(model.labels) <= 80
    got = quality.classify(frame, model).collect()
    assert len(got) == 203 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 200]
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.98
    fold = {r["doc_id"] for r in labels.where(quality.fold(F.col("doc_id"), 4) == 2).collect()}
    flipped = labels.withColumn("quality", F.when(F.col("doc_id").isin(*fold), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(frame, flipped, 40)
    assert np.array_equal(model.vectors, again.vectors) and np.array_equal(model.labels, again.labels)
    nothing = quality.fit(frame, labels.where("false"))
    assert {r["score"] for r in quality.classify(frame, nothing).collect()} == {0.5}
    assert quality.accepted(frame, model).columns == frame.columns and quality.classify(empty(spark), model).count() == 0


def test_blocked_scores_equal_single_rows(spark):
    rng = np.random.default_rng(0)
    tf = rng.poisson(0.1, (7, quality.DIMS)).astype(np.float32)
    model = quality.Model(np.ones(quality.DIMS, np.float32), rng.normal(size=(quality.DIMS, 8)).astype(np.float32), np.zeros((0, 8)), np.array([0.0, 1] * 20), np.ones(40))
    model.vectors = model.latent(rng.poisson(0.1, (40, quality.DIMS)).astype(np.float32))
    assert np.allclose(model.score(tf), [model.score(t[None])[0] for t in tf], atol=1e-5)


def test_automaton_accepts_exactly_the_substrings():
    text = np.array([1, 2, 1, 1, 2, 3, 1, 2])
    table = language.SuffixAutomaton(text, 4).table
    subs = {tuple(text[i:j]) for i in range(8) for j in range(i + 1, 9)}
    for n in (1, 2, 3):
        for code in range(4**n):
            word = tuple(code // 4**k % 4 for k in range(n))
            state = 0
            for c in word:
                state = table[state, c] if state >= 0 else -1
            assert (state >= 0) == (word in subs)


def test_phrases_equal_a_plain_greedy_parse():
    rng = random.Random(5)
    texts = {"x": "".join(rng.choices("abcd ", k=300)), "y": "".join(rng.choices("cdef ", k=300))}
    model = language.build({k: [v] for k, v in texts.items()})
    lookup = model.lookup()
    trained = {k: bytes(language.symbols_of(language.code_points(v), lookup)) for k, v in texts.items()}
    samples = ["".join(rng.choices("abcdefg ", k=n)) for n in (1, 5, 60, 200, 2000)]
    need, _ = language.parse_texts(samples, language.Parser(model), lookup)
    for i, t in enumerate(samples):
        s = bytes(language.symbols_of(language.code_points(t), lookup))
        for j, k in enumerate(model.languages):
            count, at = 0, 0
            while at < len(s):
                n = 1
                while at + n < len(s) and s[at : at + n + 1] in trained[k]:
                    n += 1
                n = max(1, n)
                count, at = count + 1, at + n
            assert need[i, j] == count


def test_language_of_odd_texts(spark):
    frame = docs(spark, [(i, "the cat and the dog " * 5) for i in range(20)]).unionByName(
        docs(spark, [(100 + i, "le chat et le chien " * 5) for i in range(20)]).withColumn("lang", F.lit("fr"))
    )
    model = language.fit(frame)
    odd = docs(spark, [(1, None), (2, "123 !?"), (None, "the dog and the cat"), (4, "et le chat"), (4, "et le chat")])
    got = sorted((r["doc_id"] or -1, r["lang_pred"]) for r in language.identify(odd, model).collect())
    assert got == [(-1, "en"), (1, "und"), (2, "und"), (4, "fr"), (4, "fr")]
    assert language.identify(odd, language.fit(empty(spark))).where("lang_pred <> 'und'").count() == 0


def test_letters_of_rare_scripts_are_told_apart():
    common = "".join(chr(c) for c in range(0x61, 0x7B)) + "".join(chr(c) for c in range(0x430, 0x450)) + "".join(chr(c) for c in range(0xE0, 0xF7))
    samples = {"a": [common * 20], "el": ["αυτη ειναι μια γλωσσα " * 3], "ka": ["ეს არის ქართული ენა და კიდევ სიტყვები " * 3], "zh": ["這是中文的句子和更多的字 " * 3]}
    model = language.build(samples)
    need, symbols = language.parse_texts(["ειναι γλωσσα", "ქართული სიტყვები", "中文的字", "ก ข"], language.Parser(model), model.lookup())
    assert [model.languages[i] for i in need[:3].argmin(axis=1)] == ["el", "ka", "zh"]
    assert symbols.tolist() == [12, 16, 4, 3] and need[0].max() > need[0].min()


# --- mixing


def water_fill(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(target.values())
        share = {n: left * w[n] / sum(w[m] for m in open_) for n in open_}
        over = [n for n in open_ if share[n] > most * sizes[n]]
        if not over:
            return target | share
        for n in over:
            target[n] = most * sizes[n]
            open_.discard(n)


def test_mixing_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.choice([1, 20, 90])), rng.choice(["a", "b", "c", "d", None, "tiny"] if i < 5 else ["a", "b", "c", "d", None])) for i in range(600)]
    rows += [(1000, None, "a"), (1001, "", "b"), (7, "x y", "tiny"), (7, "x y", "tiny")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size long")
    got = mixing.mix(frame).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water_fill(sizes)
    assert len(got) == len(rows)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(want[s]) and mine[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(45, 0.01 * want[s])
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame.repartition(7)).collect()))
    assert mixing.mix(frame.where("false")).count() == 0


# --- embeddings


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dup, "SHARD", 40)
    monkeypatch.setattr(embedding_dup, "BLOCK", 30)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + rng.normal(size=16) * rng.choice([0, 0.05, 0.35])).tolist(), int(i % 3)) for i in range(200)]
    odd = [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, rows[0][1], None), (504, [], 0), (505, [None, 1.0], 0), (506, [1.0, 2.0], 0), (507, rows[0][1], 0)]
    frame = spark.createDataFrame([(*r, 9) for r in rows + odd], "vec_id long, embedding array<double>, label int, id long")
    good = [(i, np.array(v), x) for i, v, x in [*rows, odd[7]]]
    want, links = {}, []
    for i, v, x in good:
        near = [j for j, u, y in good if j != i and x == y and v @ u / np.linalg.norm(v) / np.linalg.norm(u) >= 0.93]
        want[i] = len(near)
        links += [(i, j) for j in near]
    comp = components(508, links)
    got = {r["vec_id"]: r for r in embedding_dup.near_duplicates(frame).collect()}
    assert len(got) == 208
    assert all(r["n_links"] == want.get(i, 0) and r["component_id"] == comp[i] and r["kept"] == (comp[i] == i) for i, r in got.items())
    assert embedding_dup.near_duplicates(frame.where("false")).count() == 0


def test_graph_recall_without_flooding():
    rng = np.random.default_rng(8)
    unit = embedding_dup._unit(rng.normal(size=(600, 8)))
    graph = embedding_dup.Graph(unit)
    truth = [set(np.flatnonzero(unit @ q >= 0.9)) for q in unit[:100]]
    found, _ = graph.search(unit[:100], 32, 0.9)
    assert sum(len(t & set(f)) for t, f in zip(truth, found)) >= 0.95 * sum(map(len, truth))


# --- urls


def test_url_parts_and_rules(spark):
    urls = ["https://A.Example.COM/en/7?x", "http://x.net/de/1", "http://example.net/de/8#a", "ftp://q.org/es/", None, "no-scheme/en/", "http://h?p=/en/", "http://ccom/en/1", "x://a.com/en/2://b.net/de/"]
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.judge(frame).collect()}
    assert got[0] == ("a.example.com", "/en/7", "example.com/en/7") and got[1] == ("x.net", "/de/1", "net/de/")
    assert got[2] == ("example.net", "/de/8", "example.net/de/8") and got[3] == ("q.org", "/es/", "org/es/")
    assert got[4] == ("", "", None) and got[5] == ("", "", None) and got[6] == ("h", "", None) and got[7] == ("ccom", "/en/1", None)
    assert got[8][0] == "a.com" and got[8][2] == "com/en/"
    assert url_filter.judge(frame.where("false")).count() == 0


def test_url_scores_equal_a_plain_model(spark):
    rng = random.Random(9)
    rows = [(i, f"http://{'good' if v else 'bad'}{rng.randrange(50)}.{'net/de' if v else 'org/es'}/{rng.randrange(9)}") for i, v in enumerate([1, 0] * 60)]
    frame = spark.createDataFrame(rows + [(900, "http://good7.xyz/"), (901, "http://bad7.xyz/")], "page_id long, url string")
    out = {r["page_id"]: r for r in url_filter.judge(frame).collect()}
    assert out[900]["verdict"] == "allow" and out[901]["verdict"] == "block"
    labelled = spark.createDataFrame([("ab", "allow"), ("abc", "allow"), ("ba", "block")], "url string, verdict string")
    from sigloom.llm.workspace import Workspace

    model = url_filter.fit(labelled, Workspace(spark, "t"))
    got = url_filter.score(spark.createDataFrame([("ab",), ("zz",)], "url string"), model)
    texts = {"allow": ["ab\n", "abc\n"], "block": ["ba\n"]}

    def p(verdict, gram):
        if not gram:
            return 1 / 256
        count = lambda g: sum(t[: i + len(g)].endswith(g) for t in texts[verdict] for i in range(len(t) - len(g) + 1)) if g else sum(map(len, texts[verdict]))
        context = sum(count(gram[:-1] + c) for c in set("abc\n"))
        return (count(gram) + 2 * p(verdict, gram[1:])) / (context + 2)

    def mean(url):
        url += "\n"
        total = 0.0
        for i in range(1, len(url) + 1):
            grams = [url[max(0, i - n) : i] for n in range(5, 0, -1) if i >= n]
            known = next((g for g in grams if any(g in t for ts in texts.values() for t in ts)), None)
            total += np.log(p("allow", known) / p("block", known)) if known else 0.0
        return total / len(url)

    assert {r["url"]: pytest.approx(r["score"]) for r in got.collect()} == {u: mean(u) for u in ("ab", "zz")}


# --- paragraphs


def test_repeated_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(10)
    passage = prose(rng, 60, 5000)
    near = passage.split()
    near[30] = "changed"
    rows = [(i, prose(rng, 120, 5000)) for i in range(20)]
    rows[3] = (3, f"{prose(rng, 40, 5000)} {passage} {prose(rng, 50, 5000)}")
    rows[7] = (7, f"{prose(rng, 13, 5000)} {passage} {prose(rng, 70, 5000)}")
    rows[9] = (9, f"{prose(rng, 13, 5000)} {' '.join(near)} {prose(rng, 70, 5000)}")
    rows += [(50, ""), (51, None), (52, rows[0][1])]
    got = paragraph_dup.repeated_paragraphs(docs(spark, rows)).collect()
    assert {r["doc_id"] for r in got} == {0, 3, 7, 9, 52}
    assert {r["doc_id"] for r in got if r["kept"]} <= {0, 3, 7}
    for r in got:
        assert r["first_doc_id"] <= r["doc_id"]
    assert paragraph_dup.repeated_paragraphs(empty(spark)).count() == 0
    twins = paragraph_dup.repeated_paragraphs(docs(spark, [(None, passage), (None, passage), (4, passage)])).collect()
    assert len(twins) > 0


def test_cuts_follow_the_words_alone():
    import pyarrow as pa

    rng = random.Random(11)
    middle = prose(rng, 80, 5000)
    cuts = []
    for left in ("a b c", "d\n\ne"):
        for _, _, data, off in words.slices(pa.array([f"{left} {middle}"])):
            w, _, _, first = words.word_hashes(data, off)
            start = paragraph_dup.cuts(w, first)
            lead = len(left.split())
            cuts.append({s - lead for s in start.tolist() if s - lead > paragraph_dup.RADIUS})
    assert cuts[0] == cuts[1] and cuts[0]
    assert paragraph_dup.bands(0.98) == 3 and paragraph_dup.bands(0.93) == 2


def test_near_copies_of_lines_are_found_and_short_lines_left(spark):
    rng = random.Random(21)
    rows, pairs = [], 40
    for i in range(pairs):
        line = prose(rng, 50, 5000).split()
        near = list(line)
        near[rng.randrange(12, 38)] = "changed"  # 46 shingles, at most 5 differ: 41 / 51 = .80
        rows.append((2 * i, f"{prose(rng, 30, 5000)}\n{' '.join(line)}\n{prose(rng, 30, 5000)}"))
        rows.append((2 * i + 1, f"{prose(rng, 43, 5000)}\n{' '.join(near)}\n{prose(rng, 30, 5000)}"))
    rows += [(200, f"{prose(rng, 30, 5000)}\nall rights are reserved\n"), (201, f"All rights are reserved\n\n{prose(rng, 30, 5000)}")]
    got = [r for r in paragraph_dup.repeated_paragraphs(docs(spark, rows)).collect() if r["unit"] == "line"]
    whole = {r["doc_id"] // 2 for r in got if r["n_words"] == 50 and not r["kept"]}
    assert len(whole) >= 0.95 * pairs and {r["n_words"] for r in got} == {50}


def test_edited_passages_inside_lines_are_found(spark):
    rng = random.Random(22)
    rows, pairs = [], 40
    for i in range(pairs):
        passage = prose(rng, 60, 5000).split()
        near = list(passage)
        near[rng.randrange(60)] = "changed"
        rows.append((2 * i, f"{prose(rng, 61, 5000)} {' '.join(passage)} {prose(rng, 50, 5000)}"))
        rows.append((2 * i + 1, f"{prose(rng, 47, 5000)} {' '.join(near)} {prose(rng, 50, 5000)}"))
    covered = {}
    for r in paragraph_dup.repeated_paragraphs(docs(spark, rows)).collect():
        if r["doc_id"] % 2:
            covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["start_word"] + r["n_words"]))
    share = [len(covered.get(2 * i + 1, set()) & set(range(47, 107))) / 60 for i in range(pairs)]
    assert sum(x > 0 for x in share) >= 0.8 * pairs


def test_buckets_that_tokens_do_not_part_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(paragraph_dup, "LEAF", 2)
    monkeypatch.setattr(paragraph_dup, "BUCKET", 4)
    monkeypatch.setattr(paragraph_dup, "DEPTH", 0)
    rng = random.Random(23)
    common, rows = prose(rng, 40, 5000), []
    for i in range(20):
        own = prose(rng, 40, 5000)
        rows += [(2 * i, f"{common} {own}"), (2 * i + 1, f"{common} {own} end")]
    work = Workspace(spark, "test")
    texts = docs(spark, rows).select(F.col("doc_id").alias("k"), "text")
    units = paragraph_dup._tokens(texts).where("kind = 0")
    classes = work.save(units.withColumnRenamed("k", "lo").withColumn("hi", F.col("lo")), "classes")
    owner = {r["d"]: r["lo"] for r in classes.collect()}
    links = {tuple(sorted((owner[r["src"]], owner[r["dst"]]))) for r in paragraph_dup._links(classes, texts, work).collect()}
    assert links == {(2 * i, 2 * i + 1) for i in range(20)}


# --- benchmark


def edit_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != v)))
        row = new
    return min(row)


def test_bit_parallel_distance_equals_dynamic_programming():
    rng = random.Random(12)
    for _ in range(200):
        a = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 70))], np.uint64)
        b = np.array([rng.randrange(4) for _ in range(rng.randrange(0, 60))], np.uint64)
        assert decontaminate.least_edits(a, b)[0] == edit_distance(a.tolist(), b.tolist())


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(13)
    items = [(i, prose(rng, n, 900)) for i, n in enumerate([1, 4, 8, 15, 30, 59])] + [(90, ""), (91, None)]
    rows = []
    for k in range(60):
        item = rng.choice(items[2:6])[1].split()
        for _ in range(rng.randrange(0, len(item) // 4 + 2)):
            at = rng.randrange(len(item))
            item[at : at + rng.choice([0, 1, 1])] = [f"e{k}"][: rng.choice([0, 1, 1])]
        rows.append((k, f"{prose(rng, rng.randrange(0, 30), 900)} {' '.join(item)} {prose(rng, rng.randrange(0, 30), 900)}"))
    rows += [(100, ""), (101, None), (None, items[3][1].upper())]
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id long")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.find(docs(spark, rows), bench).collect()}
    want = {}
    for d, t in rows:
        for i, x in items:
            w = (x or "").lower().split()
            if w and t is not None:
                e = edit_distance(w, t.lower().split())
                if e <= decontaminate.edits_allowed(len(w)):
                    want[(d, i)] = e
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)
    assert all(got[k] == want[k] for k in got if want[k] == 0) and {k for k in want if want[k] == 0} <= set(got)
    clean = decontaminate.decontaminate(docs(spark, rows), bench)
    assert clean.count() == len(rows) - len({d for d, _ in got}) and clean.columns == docs(spark, rows).columns
    assert decontaminate.find(empty(spark), bench).count() == 0 and decontaminate.find(docs(spark, rows), bench.where("false")).count() == 0


# --- queries


def test_every_operator_has_a_query():
    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {"pipeline"} | {f"op{i}" for i in range(1, 11)} and set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name,tables", [("op1_chat_format", ["conversations"]), ("op2_minhash_near_dup", ["documents"]), ("op7_embedding_near_dup", ["embeddings"])])
def test_query_matches_sql(spark, name, tables):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    frame = queries.queries()[name](spark, folder)
    columns = sorted(frame.columns)
    ours = sorted(tuple(r[c] for c in columns) for r in frame.collect())
    assert ours == sorted(con.execute(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall())


def test_pipeline_stages_chain(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs_ = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages.quality_stage(spark, docs_, folder).collect()}
    judged = [(d in kept) == bool(q) for d, q in labels.items() if d is not None]
    assert np.mean(judged) > 0.9
    out = corpus_pipeline.run(spark, folder)
    assert 0 < out.count() <= docs_.count() and corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_rows_without_an_id_of_their_own_pass_the_near_dup_stage(spark):
    rng = random.Random(24)
    a, b, c, d = (prose(rng, 60, 5000) for _ in range(4))
    rows = [(None, a), (None, b), (1, a), (2, b), (2, c), (3, c), (4, d), (4, d + " end"), (5, ""), (5, None)]
    got = stages.near_dup_stage(spark, docs(spark, rows), "")
    assert got.columns == docs(spark, rows).columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    four = [r for r in kept if r[0] == 4]
    assert len(four) == 1 and sorted(map(str, set(kept) - set(four))) == sorted(map(str, [(None, a), (None, b), (1, a), (2, b), (2, c), (5, ""), (5, None)]))
    assert len(kept) == 8


def test_url_scores_equal_a_plain_model_beyond_65536_grams(spark):
    rng = random.Random(25)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    urls = [("http://" + "".join(rng.choices(letters, k=24)), rng.choice(["allow", "block"])) for _ in range(5000)]
    count, context = {}, {}
    for u, v in urls:
        for at in range(1, len(u) + 2):
            for n in range(1, min(at, 5) + 1):
                g = (u + "\n")[at - n : at]
                count[g, v] = count.get((g, v), 0) + 1
                context[g[:-1], n, v] = context.get((g[:-1], n, v), 0) + 1
    assert len({g for g, _ in count if len(g) == 5}) > 65_536

    def p(g, v):
        below = p(g[1:], v) if len(g) > 1 else 1 / 256
        return (count.get((g, v), 0) + 2 * below) / (context.get((g[:-1], len(g), v), 0) + 2)

    def ratio(run):
        for n in range(len(run), 0, -1):
            g = run[-n:]
            if (g, "allow") in count or (g, "block") in count:
                return np.log(p(g, "allow")) - np.log(p(g, "block"))
        return 0.0

    asked = [u for u, _ in urls[:50]] + ["http://" + "".join(rng.choices(letters + "é", k=24)) for _ in range(50)]
    model = url_filter.fit(spark.createDataFrame(urls, "url string, verdict string"), Workspace(spark, "t"))
    got = {r["url"]: r["score"] for r in url_filter.score(spark.createDataFrame([(u,) for u in asked], "url string"), model).collect()}
    for u in asked:
        t = u + "\n"
        assert got[u] == pytest.approx(np.mean([ratio(t[max(0, at - 5) : at]) for at in range(1, len(t) + 1)]), abs=1e-6)
