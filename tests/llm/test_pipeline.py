"""The pipeline's stages on small tables against brute force, and with every odd column and row."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quillon.llm import mixing
from quillon.llm.queries import tokenizer_path

CLASHING = ["score", "lang_pred", "margin", "id", "hash", "row", "print", "group", "_found_id", "_stay_id", "size", "copies", "a.b", "batch", "h"]


def _shingles(text, words):
    w = words(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """400 documents of two languages, copies, near copies, passages, nulls and repeated rows."""
    rng = np.random.default_rng(11)
    words = {"aa": [f"{a}{b}o" for a in "lmntr" for b in "aeiou"], "bb": [f"k{a}{b}x" for a in "eiou" for b in "pwzfg"]}
    path = tmp_path_factory.mktemp("tables")
    items = [(i, " ".join(rng.choice(words["aa"], 12 + 40 * (i % 3)))) for i in range(6)] + [(6, None), (7, "lao neo")]
    rows = []
    for i in range(400):
        lang = ["aa", "bb"][i % 2]
        text = " ".join(rng.choice(words[lang], int(rng.integers(30, 120))))
        if i % 10 == 3:
            w = rows[i - 2][1].split()
            w[len(w) // 2] = "other"
            text = " ".join(w)
        if i % 25 == 7:
            text = rows[i - 4][1]
        if i % 40 == 5:
            text = text + " " + items[i % 6][1].upper() + " end"
        rows.append((i, text, lang if i % 9 else None, f"s{i % 3}" if i % 11 else None))
    rows += [(400, None, "aa", "s0"), (401, "", None, None), (402, "12 34 !", "bb", "s1"), (None, "lao meo nio", "aa", "s1"), (403, "lao " * 20_000, "aa", "s2"), rows[8], rows[8]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASHING:
        d = d.withColumn(c, F.lit("x"))
    d.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(P.STAGES)
    key = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    language = stages["language"](spark, docs, folder)
    assert language.columns == docs.columns
    assert key(language) == key(docs.where("text rlike '[a-z]'"))

    before = spark.createDataFrame(language.collect(), docs.schema)
    near = stages["near_dedup"](spark, before, folder)
    assert near.columns == docs.columns
    rows = before.collect()
    lower = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    bags = []
    for r in rows:
        bag, seen = set(), {}
        for s in _shingles(r.text, lower):
            seen[s] = seen.get(s, 0) + 1
            bag.add((s, seen[s]))
        bags.append(bag)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = lower(rows[i].text) == lower(rows[j].text)
            if same or bags[i] and len(bags[i] & bags[j]) >= 0.8 * len(bags[i] | bags[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    keep = {}
    for g, r in zip(group, rows, strict=True):
        keep.setdefault(g, []).append(r)
    smallest = [min(v, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for v in keep.values()]
    assert key(near) == sorted(((r.doc_id, r.text) for r in smallest), key=str)

    clean = stages["decontaminate"](spark, near, folder)
    assert clean.columns == docs.columns
    plain = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [set(_shingles(r.text, plain)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = [r for r in near.collect() if not any(i and len(i & set(_shingles(r.text, plain))) >= 0.8 * len(i) for i in items)]
    assert key(clean) == sorted(((r.doc_id, r.text) for r in kept), key=str) and len(kept) < near.count()

    mix = stages["mix"](spark, clean, folder)
    assert mix.columns == docs.columns
    taken = {(r.doc_id): r.copies for r in mixing.mix(clean).collect()}
    assert {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()} == {k: v for k, v in taken.items() if v}

    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    found = sorted(stages["tokens"](spark, mix, folder).collect(), key=lambda r: r.start)
    at = 0
    for r, (doc_id, text) in zip(found, sorted(((r.doc_id, r.text) for r in mix.collect()), key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = [*own.encode(text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_whole_run_and_empty_tables(spark, folder, tmp_path):
    assert P.run(spark, folder).count() > 100
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert dict(P.STAGES)["language"](spark, unlabelled, folder).count() == docs.where("text rlike '[a-z]'").count()
