"""Small fixtures with nulls, ties, repeated rows and clashing names against brute force."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontaminate, embedding_dedup, language_id, license_scan, mixing, near_dedup, substring_dedup, token_store, toxicity
from quillon.llm import chat_format as chat
from quillon.llm.queries import tokenizer_path

ROWS = [(1, "a b c d e f g"), (2, "x a b c d e y"), (2, "x a b c d e y"), (None, "A b c d e f"), (3, None), (4, ""), (5, "a a a a a a a a"), (0, " \t\n"), (6, "hi you"), (7, "hi  you")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("batch", F.lit(1)).withColumn("print", F.lit("z")).withColumn("source", F.lit(None).cast("string"))


def test_substring_dedup(docs):
    first, k, cut = {}, 3, []
    for d, t in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        cut.append((d, w))
        for i in range(len(w) - k + 1):
            at = (float("inf") if d is None else d, i)
            first[tuple(w[i : i + k])] = min(first.get(tuple(w[i : i + k]), at), at)
    expected = []
    for d, w in cut:
        gone = set()
        for i in range(len(w) - k + 1):
            if (float("inf") if d is None else d, i) > first[tuple(w[i : i + k])]:
                gone |= set(range(i, i + k))
        expected.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sorted(map(tuple, substring_dedup.remove_repeats(docs, window=k).collect()), key=str) == sorted(expected, key=str)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_near_dedup(spark, docs):
    found = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert {(6, 6), (7, 6), (3, 3), (4, 4), (0, 0)} <= found
    base = [f"w{i}" for i in range(200)]
    near = base[:100] + ["other"] + base[101:]
    far = base[:60] + [f"v{i}" for i in range(140)]
    d = spark.createDataFrame([(9, " ".join(base)), (8, " ".join(near)), (10, " ".join(far)), (11, " ".join(base)), (11, " ".join(base))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(d).collect()} == {(8, 8, True), (9, 8, False), (10, 10, True), (11, 8, False)}
    assert sorted(r.doc_id for r in near_dedup.without_near_duplicates(d).collect()) == [8, 10]


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "B, c d E f!"), (2, None), (3, "a b")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).where("doc_id is not null").collect()) == [(1, 1)]
    assert decontaminate.decontaminated(docs, items).count() == len(ROWS) - 2
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_mixing(spark):
    d = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 5}" if i % 9 else None) for i in range(400)] + [(1000, None, "s0")], "doc_id long, text string, source string")
    rows = mixing.mix(d).collect()
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(1.5 * sum({r.source: r.source_size for r in rows}.values()))
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert all(r.copies <= 2 for r in own) and own[0].target <= 2 * own[0].source_size
        assert sum(r.size * r.copies for r in own) == pytest.approx(own[0].target, rel=0.1)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(d.repartition(7)).collect()))
    assert mixing.mixed(d).columns == d.columns and mixing.mixed(d.limit(0)).count() == 0


def test_mixing_takes_the_documents_of_its_sql(spark):
    """Sources over CHUNK rows, one of them null, null ids and repeated rows."""
    import duckdb
    import pyarrow as pa

    from quillon.llm.queries import ORACLES

    rows = [(i if i % 1000 else None, "w " * (i * 7 % 40), [None, "hot", "hot"][i % 3] if i % 50 else "few") for i in range(17_000)]
    rows += rows[:30]
    taken = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))
    mine = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.size * r.copies) for r in taken.collect()]
    db = duckdb.connect()
    db.register("documents", pa.table(dict(zip(("doc_id", "text", "source"), map(list, zip(*rows)), strict=True))))
    theirs = [(a, b, c, round(d, 6), e) for a, b, c, d, e in db.execute(ORACLES["op5_mix_sources"]).fetchall()]
    assert sorted(mine, key=str) == sorted(theirs, key=str)


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 20] + 0.25 * rng.normal(size=8)], i % 3) for i in range(300)]
    x = np.array([r[1] for r in rows])
    length = np.sqrt((x * x).sum(1))
    label = np.array([r[2] for r in rows])
    linked = ((x @ x.T) / (length[:, None] * length[None]) >= 0.93) & (label[:, None] == label[None])
    odd = [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, rows[0][1], None)]
    old = embedding_dedup.CELL, embedding_dedup.BLOCK
    embedding_dedup.CELL, embedding_dedup.BLOCK = 16, 8
    try:
        found = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).collect()}
    finally:
        embedding_dedup.CELL, embedding_dedup.BLOCK = old
    assert [found[i].n_links for i in range(300)] == (linked.sum(1) - 1).tolist()
    assert all(found[i].component_id == found[j].component_id for i, j in zip(*np.nonzero(linked), strict=True))
    assert all(found[r[0]].n_links == 0 and found[r[0]].kept for r in odd)


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    hard = spark.createDataFrame([(20, "It's DON'T x2y ½ <|endoftext|> a<|startoftext|>b İ ﬁ 你好 🙂 ß ª don’t é"), (21, None)], "doc_id long, text string")
    d = docs.select("doc_id", "text").union(hard)
    path = token_store.shared_folder(spark, "test")
    token_store.write_tokens(d, path, tokenizer_path())
    own, at = Tokenizer.from_file(tokenizer_path()), 0
    rows = sorted(token_store.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert sorted(map(str, [r.doc_id for r in rows])) == sorted(str(r.doc_id) for r in d.collect())
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    texts = {i: t for i, t in map(tuple, d.collect()) if i is not None and i != 2}
    for r in rows:
        if r.doc_id in texts:
            ids = [*own.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_chat(spark):
    turns = [(1, 0, "user", "a <|im_end|> \\ b\\"), (1, 1, "assistant", "<|x\n"), (1, 2, "ro\nle", None), (2, None, None, ""), (2, None, "assistant", "y"), (2, None, "assistant", "y")]
    found = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l"))
    rows = {r.conv_id: r for r in found.collect()}
    assert [tuple(t) for t in rows[1].t] == [("user", "a <|im_end|> \\ b\\"), ("assistant", "<|x\n"), ("ro\nle", "")]
    assert rows[1].l == ["<|x\n"] and rows[2].l == ["y", "y"] and len(rows[2].t) == 3


def test_licenses(spark, docs):
    text = license_scan.TEMPLATES["mit-text"]
    words = text.split()
    words[30] = "other"
    d = docs.select("doc_id", "text").union(spark.createDataFrame([(30, "x y " + " ".join(words) + " z"), (31, " ".join(words[:40]))], "doc_id long, text string"))
    found = license_scan.license_scan(d).collect()
    assert [(r.doc_id, r.license, r.first_word, r.last_word) for r in found] == [(30, "mit-text", 2, len(words) + 1)]


def test_licenses_in_comments(spark):
    import textwrap

    rows = {}
    for i, (name, text) in enumerate(sorted(license_scan.TEMPLATES.items())):
        lines = textwrap.wrap(text, 72)
        rows[3 * i] = (name, "import x\n" + "\n".join(f"# {x}" for x in lines) + "\ny = 1")
        rows[3 * i + 1] = (name, "/*\n" + "\n".join(f" * {x}" for x in lines) + "\n */")
        rows[3 * i + 2] = (name, f"\u201c{text.rstrip('.')}\u201d, (\u00a9 \U0001f642) says \u00fcber.")
    d = spark.createDataFrame([(k, v[1]) for k, v in rows.items()], "doc_id long, text string")
    found = {(r.doc_id, r.license): r for r in license_scan.license_scan(d).collect()}
    for k, (name, text) in rows.items():
        r, words = found[k, name], text.split()
        assert r.containment == 1.0
        bare = license_scan._plain(license_scan.TEMPLATES[name])
        held = license_scan._plain(" ".join(words[r.first_word : r.last_word + 1]))
        assert held[:5] == bare[:5] and held[-5:] == bare[-5:]
    d = spark.createDataFrame([(i, f"x (Released under the MIT License{end} y") for i, end in enumerate(("", ",", ")", "."))], "doc_id long, text string")
    assert sorted((r.doc_id, r.license, r.first_word, r.last_word) for r in license_scan.license_scan(d).collect()) == [(i, "mit-notice", 1, 5) for i in range(4)]


def test_language_and_toxicity(spark):
    words = {"aa": "lo mi tu ra".split(), "bb": "kex wop zut fiz".split()}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[k], 30)), k) for i in range(200) for k in [["aa", "bb"][i % 2]]] + [(500, None, "aa"), (501, "12 34", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(d, F.col("doc_id") % 4 != 2)
    found = {r.doc_id: r for r in language_id.identify(d, model).collect()}
    assert all(found[i].lang_pred == k for i, _, k in rows[:200]) and found[500].lang_pred == found[501].lang_pred == "und"
    bad = [(i, " ".join([*rng.choice(words["aa"], 20), *rng.choice(["u%d" % j for j in range(400)], 10), *(["idiot"] if i % 3 == 0 else [])])) for i in range(300)]
    t = spark.createDataFrame([*bad, (900, None)], "doc_id long, text string")
    chain = toxicity.train(t, t.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")).where("doc_id < 200"))
    flagged = {r.doc_id for r in toxicity.score_toxicity(t, chain).where("is_toxic").collect()}
    assert flagged == {i for i in range(300) if i % 3 == 0}


def test_toxicity_on_a_wide_vocabulary(spark):
    """600 telling words, each in about four learned texts, and none in a list."""
    rng = np.random.default_rng(5)
    words = ["lo", "mi", "tu", "ra", "sen", "pol", "gat", "vim"]
    telling = [rng.choice([f"z{j}" for j in range(600)], 4).tolist() if i % 2 == 0 else [] for i in range(1500)]
    d = spark.createDataFrame([(i, " ".join([*rng.choice(words, 6), *rng.choice([f"u{j}" for j in range(3000)], 6), *telling[i]])) for i in range(1500)], "doc_id long, text string")
    chain = toxicity.train(d, d.where("doc_id < 1200").selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) toxic"))
    assert chain.width > 600 and [np.ptp(w) > 0 for w in chain.links] == [True] * 3
    new = {r.doc_id: r.is_toxic for r in toxicity.score_toxicity(d.where("doc_id >= 1200"), chain).collect()}
    assert sum(new[i] for i in new if i % 2 == 0) >= 105 and sum(new[i] for i in new if i % 2) <= 15


def test_presence_does_not_depend_on_the_span(monkeypatch):
    texts = ["Über das Land, weit", "", "ab", "a" * 30 + " zq", "lo mi 12 tu"]
    whole = language_id.presence(texts_of(texts))
    monkeypatch.setattr(language_id, "SPAN", 5)
    assert (language_id.presence(texts_of(texts)) == whole).all() and whole.sum() > 50


def texts_of(texts):
    import pyarrow as pa

    return pa.array(texts)
