import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import search, text_index
from quillon.plans.engine import Engine


def _engine(spark, folder, **options):
    return Engine(spark, str(folder), **options)


def _ok(results):
    assert not [r.error for r in results if r.error], [r.error for r in results]
    return results


def _files(path):
    return [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet") and not f.startswith("part-00000-empty")]


TEXTS = ["Los bancos y la inflación", "el banco de la plaza", "y los de la", None, "", "banca central, banca privada: inflaciones"]


@pytest.mark.parametrize("using", ["", "USING BM25", "USING TF_IDF", "USING BM25 WITH K1 = 2.0, B = 0.1"])
def test_text_index_says_what_a_scan_says(spark, tmp_path, using):
    e = _engine(spark, tmp_path)
    values = ", ".join(f"({i}, {'NULL' if t is None else repr(t)})" for i, t in enumerate(TEXTS))
    _ok(e.sql(f"CREATE TABLE t (id INT PRIMARY KEY, x TEXT); INSERT INTO t VALUES {values}"))
    ask = f"SELECT id, SCORE() AS s FROM t WHERE MATCH(x, 'la inflación del banco') {using}"
    found = lambda: [(r.id, round(r.s, 9)) for r in e.query(ask).collect()]
    plain = found()
    _ok(e.sql("CREATE INDEX w ON t (x) USING FULLTEXT"))
    assert found() == plain and {i for i, _ in plain} == {0, 1, 5}
    assert "Text Index Scan using w on t" in e.sql(f"EXPLAIN {ask}")[0].report
    _ok(e.sql("INSERT INTO t VALUES (9, 'un banco'); DELETE FROM t WHERE id = 0"))
    indexed = found()
    _ok(e.sql("DROP INDEX w"))
    assert indexed == found() and {i for i, _ in indexed} == {1, 5, 9}
    assert e.sql("CREATE INDEX a ON t (x) USING FULLTEXT; CREATE INDEX b ON t (x) USING FULLTEXT")[1].error


def test_text_index_reads_the_terms_asked_for(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id doc", "concat('w', id % 7, ' zz') text").withColumn("text", F.translate("text", "0123456789", "abcdefghij"))
    index = text_index.build_text_index(docs, "doc", "text", str(tmp_path / "i"))
    found = text_index.search_text_index(spark, index, "wb", "BM25")
    assert found.count() == search.match(docs, "wb", "doc", "text").count() == 429
    assert text_index.search_text_index(spark, index, "nothing").count() == 0


def _vectors(n=900, wide=8, seed=3):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=(30, wide))[rng.integers(0, 30, n - 60)] + 0.3 * rng.normal(size=(n - 60, wide)), rng.normal(size=(60, wide))]).astype(np.float32)


def _filled(spark, folder, x):
    e = _engine(spark, folder)
    _ok(e.sql(f"CREATE TABLE img (id INT PRIMARY KEY, grp INT, v VECTOR({x.shape[1]}))"))
    rows = [(i, i % 3, None if i % 100 == 99 else [float(c) for c in v]) for i, v in enumerate(x)]
    e.load_rows("img", spark.createDataFrame(rows, "id int, grp int, v array<float>"), "id")
    return e


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
@pytest.mark.parametrize("kind", ["IVF", "HNSW"])
def test_vector_indexes_reach_their_recall(spark, tmp_path, kind, metric):
    x = _vectors()
    e = _filled(spark, tmp_path, x)
    _ok(e.sql(f"CREATE INDEX i ON img (v) USING {kind} WITH (METRIC = {metric})"))
    hits = 0
    for q in range(0, 900, 150):
        v = ", ".join(map(str, x[q].tolist()))
        ask = lambda how: [r.id for r in e.query(f"SELECT id, SIMILARITY_SCORE() AS s FROM img WHERE SIMILAR_TO(VECTOR({v}), K = 10) USING {how}").collect()]  # noqa: E731, B023
        exact = ask(f"SEQ WITH METRIC = {metric}")
        found = ask(f"{kind} WITH METRIC = {metric}")
        assert len(found) == 10
        hits += len(set(exact) & set(found))
    assert hits >= 54
    # a filter that few rows pass: the search goes on until k of them are found
    v = ", ".join(map(str, x[5].tolist()))
    few = e.query(f"SELECT id, SIMILARITY_SCORE() AS s FROM img WHERE SIMILAR_TO(VECTOR({v}), K = 7) AND id > 880 USING {kind} WITH METRIC = {metric}")
    assert few.count() == 7
    narrow = "PROBES = 1" if kind == "IVF" else "EF_SEARCH = 7"
    assert e.query(f"SELECT id, SIMILARITY_SCORE() AS s FROM img WHERE SIMILAR_TO(VECTOR({v}), K = 7) AND id > 850 USING {kind} WITH METRIC = {metric}, {narrow}").count() == 7


def test_choice_of_the_index(spark, tmp_path):
    x = _vectors(300)
    e = _filled(spark, tmp_path, x)
    v = ", ".join(map(str, x[7].tolist()))
    how = lambda using: e.sql(f"EXPLAIN SELECT id, SIMILARITY_SCORE() AS s FROM img WHERE SIMILAR_TO(VECTOR({v}), K = 4) {using}")[0]
    r = e.sql(f"SELECT id, SIMILARITY_SCORE() AS s FROM img WHERE SIMILAR_TO(VECTOR({v}), K = 4) USING IVF")[0]
    assert r.frame.count() == 4 and "no IVF index" in r.note
    _ok(e.sql("CREATE INDEX a ON img (v) USING IVF WITH (METRIC = euclidean, LISTS = 10)"))
    assert "Vector Seq Scan" in how("").report  # without USING the metric is the cosine
    assert "Vector Index Scan using a" in how("USING IVF").report
    assert "Vector Seq Scan" in how("USING IVF WITH METRIC = cosine").report and "Vector Seq Scan" in how("USING SEQ").report
    _ok(e.sql("CREATE INDEX b ON img (v) USING IVF WITH (METRIC = cosine, LISTS = 10)"))
    e.tables["img"].indexes["b"]["reads"] = 20
    assert "Vector Index Scan using b" in how("").report
    assert e.sql("CREATE INDEX c ON img (v) USING IVF WITH (METRIC = cosine)")[0].error
    assert e.sql(f"SELECT id FROM img WHERE SIMILAR_TO(VECTOR({v}), K = 4) USING HNSW WITH PROBES = 2")[0].error
    assert e.sql("SELECT id FROM img WHERE SIMILAR_TO(VECTOR(1, 2), K = 4)")[0].error
    assert "no extractor" in e.sql("SELECT id FROM img WHERE SIMILAR_TO('a.jpg', K = 4)")[0].error
    e.vectorizer = lambda table, path: x[3].tolist() if path == "a.jpg" else [1.0]
    assert e.query("SELECT id, SIMILARITY_SCORE() AS s FROM img WHERE SIMILAR_TO('a.jpg', K = 1)").first()["id"] == 3
    assert e.sql("SELECT id FROM img WHERE SIMILAR_TO('b.jpg', K = 4)")[0].error
    _ok(e.sql("DELETE FROM img WHERE id = 3"))
    assert e.query("SELECT id, SIMILARITY_SCORE() AS s FROM img WHERE SIMILAR_TO('a.jpg', K = 1) USING IVF WITH METRIC = cosine").first()["id"] != 3


def test_batches_of_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERIES", 7)
    x = _vectors(400)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = d.where("vec_id % 20 = 0 or vec_id > 899")
    for metric in ("cosine", "euclidean", "dot"):
        found = search.nearest_many(d, asked, 5, metric).collect()
        assert len(found) == 5 * 22 - 5  # 20 of the table, 900 is null, 901 is zero
        for q in (0, 380):
            one = search.nearest(d, rows[q][1], 5, metric).collect()
            mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
            assert [r.id for r in mine] == [r.vec_id for r in one] and np.allclose([r.score for r in mine], [r.score for r in one])
    assert search.nearest_many(d, d.limit(0), 5).count() == 0
    index, centres = search.ivf_index(d, 6)
    probes = search.calibrated_probes(d, index, centres)
    assert 1 <= probes <= 6


def test_inserts_append_and_drops_delete(spark, tmp_path):
    e = _engine(spark, tmp_path)
    _ok(e.sql("CREATE TABLE t (id INT PRIMARY KEY, p POINT) USING BPLUS"))
    for i in range(20):
        _ok(e.sql(f"INSERT INTO t VALUES ({100 - i}, POINT({i}, 0))"))
    t = e.tables["t"]
    assert 1 < len(t.parts) <= 17 and t.rows == 20 and e.query("SELECT COUNT(*) FROM t").first()[0] == 20
    assert e.sql("INSERT INTO t VALUES (100, NULL)")[0].error
    e.save(str(tmp_path / "saved"))
    again = Engine.load(spark, str(tmp_path / "saved"))
    assert again.query("SELECT id FROM t WHERE id = 85").count() == 1 and again.tables["t"].rows == 20
    folder = t.folder
    before = len(_files(folder))
    _ok(e.sql("DROP TABLE t; CREATE TABLE t (id INT PRIMARY KEY, p POINT)"))
    left = spark.read.option("recursiveFileLookup", True).parquet(folder)
    assert before > 5 and left.count() == 0 and e.query("SELECT id FROM t").count() == 0
    assert e.reset() == ["t"] and not e.tables


def test_statistics_follow_changes(spark, tmp_path):
    e = _engine(spark, tmp_path)
    _ok(e.sql("CREATE TABLE t (id INT PRIMARY KEY, p POINT, n VARCHAR(9)); INSERT INTO t VALUES (1, POINT(1, 2), 'a'), (2, POINT(-3, 5), NULL), (3, NULL, 'a')"))
    assert not e.tables["t"].analyzed
    rows = {r["column"]: r for r in e.sql("ANALYZE t")[0].frame.collect()}
    assert list(rows["p"].box) == [-3.0, 2.0, 1.0, 5.0] and rows["n"].n_distinct == 1 and rows["id"].greatest == "3"
    values = ", ".join(f"({i}, NULL, 'b')" for i in range(10, 61))
    _ok(e.sql(f"INSERT INTO t VALUES {values}"))
    assert e.tables["t"].statistics["id"]["greatest"] == "60" and e.tables["t"].changes == 0
    _ok(e.sql("DELETE FROM t WHERE id = 60"))
    assert e.tables["t"].statistics["id"]["greatest"] == "60" and e.tables["t"].changes == 1


def test_explain_counts_the_rows_of_each_node(spark, tmp_path):
    e = _engine(spark, tmp_path)
    _ok(e.sql("CREATE TABLE a (id INT PRIMARY KEY, n INT) USING BPLUS; CREATE TABLE b (id INT PRIMARY KEY, a INT); INSERT INTO a VALUES (1, 5), (2, 6), (3, 7); INSERT INTO b VALUES (1, 1), (2, 1), (3, 9)"))
    r = _ok(e.sql("EXPLAIN ANALYZE SELECT a.id, b.id FROM a JOIN b ON a.id = b.a WHERE a.n < 6 ORDER BY b.id LIMIT 5"))[0]
    tree = r.plan.tree()
    assert tree["kind"] == "Limit" and tree["actual"] == 2
    nodes = {}

    def walk(n):
        nodes[n["kind"] + (f" on {n['relation']}" if n["relation"] else "")] = n
        for c in n["children"]:
            walk(c)

    walk(tree)
    assert {"Top-N Sort", "Filter", "Hash Join", "Seq Scan on a", "Seq Scan on b"} <= set(nodes) and nodes["Seq Scan on b"]["actual"] == 3
    assert "Index Scan using a_key on a" in e.sql("EXPLAIN SELECT id FROM a WHERE id BETWEEN 1 AND 2")[0].report
    r = e.sql("EXPLAIN DELETE FROM a WHERE id = 1")[0]
    assert "Modify on a" in r.report and e.query("SELECT COUNT(*) FROM a").first()[0] == 3
    assert e.sql("EXPLAIN ANALYZE DELETE FROM a WHERE id = 1")[0].plan.actual == 1 and e.query("SELECT COUNT(*) FROM a").first()[0] == 2


def test_answers_for_a_client(spark, tmp_path):
    e = _engine(spark, tmp_path)
    out = e.respond("CREATE TABLE t (id INT PRIMARY KEY, p POINT); INSERT INTO t VALUES (1, POINT(1, 2)); SELECT * FROM t; DELETE FROM t WHERE id = 7")
    assert out["columns"] == ["id", "p"] and out["rows"] == [{"id": 1, "p": {"lat": 1.0, "lon": 2.0}}] and out["message"] == "delete: 0 rows"
    wrong = e.respond("SELECT x FROM t; SELECT id FROM t")
    assert "x" in wrong["error"] and wrong["statements"][1]["rows"] == [{"id": 1}]
    assert "error" in e.respond("BEGIN TRANSACTION; SELECT id FROM t") and "error" in e.respond("END TRANSACTION") and "error" in e.respond("SELEC")
    assert e.respond("EXPLAIN SELECT id FROM t")["explain"]["tree"]["kind"] == "Seq Scan"
    told = e.described_all()
    assert [t["name"] for t in told] == ["t"] and told[0]["rows"] == 1 and told[0]["columns"][0]["key"]


def test_score_alias_may_not_name_a_column(spark):
    e = Engine(spark)
    e.attach("t", spark.createDataFrame([(1, "uno")], "id int, x string"))
    assert e.sql("SELECT id, SCORE() AS x FROM t WHERE MATCH(x, 'uno')")[0].error
    calls = []
    e.attach("later", lambda: calls.append(1) or spark.range(3).toDF("id"))
    assert not calls and e.query("SELECT id FROM later").count() == 3 and e.query("SELECT id FROM later").count() == 3 and calls == [1]


def test_records_layouts_and_reports(spark, tmp_path):
    e = _engine(spark, tmp_path)
    assert e.sql("CREATE TABLE a (p POINT, x TEXT)")[0].error and e.sql("CREATE TABLE a (id INT, x VARCHAR(1016))")[0].error
    _ok(e.sql("CREATE TABLE a (id INT, x VARCHAR(1015)); CREATE TABLE b (x TEXT, k INT, v VECTOR(2)) USING BPLUS"))
    assert e.tables["b"].ordered_by == "k"
    e.load_rows("b", spark.range(500).selectExpr("concat('uno dos t', chr(97 + id % 5)) x", "id % 100 k", "array(id, 1) v", "id"), "id")
    _ok(e.sql("CREATE INDEX w ON b (x) USING FULLTEXT; CREATE INDEX g ON b (v) USING HNSW; CREATE INDEX c ON b (v) USING IVF WITH (LISTS = 4)"))
    files = e.layout_report("b").orderBy(F.col("least").cast("int")).collect()
    assert sum(f.rows for f in files) == 500 and files[0].least == "0" and all(int(a.greatest) < int(b.least) for a, b in zip(files[:-1], files[1:], strict=True))
    assert e.index_report("w").agg(F.sum("postings")).first()[0] >= 400
    assert [(r.rows, r.links) for r in e.index_report("g").collect()] == [(500, 500 * 32)] and e.index_report("c").agg(F.sum("rows")).first()[0] == 500
    assert e.layout_report("a").count() == 0
    with pytest.raises(ValueError):
        e.index_report("none")
