import json

import numpy as np
import pytest

from quillon.operators import features, identify, retrieval
from quillon.plans.engine import Engine, SemanticError
from quillon.plans.persons import Persons
from quillon.sources.corpora import read_articles, read_faces
from quillon.sources.csv_table import CsvError
from quillon.sources.import_table import import_csv


def test_filters_sources_and_samples(spark):
    d = spark.createDataFrame([(1, "pe", 2001), (2, "cl", 2005), (3, None, None)], "id long, country string, year int")
    ids = lambda **k: sorted(r.id for r in retrieval.with_metadata(d, **k).collect())
    assert ids() == ids(equal={"country": None}) == [1, 2, 3] and ids(equal={"country": "pe"}) == [1] and ids(low={"year": 2002}) == [2] and ids(high={"year": 2002}) == [1]
    hits = spark.createDataFrame([(7, 1, 1), (8, 9, 2)], "hit long, id long, rank int")
    found = retrieval.with_sources(hits, d, "id", "id").orderBy("number").collect()
    assert [(r.number, r.hit, r.source.country if r.source else None) for r in found] == [(1, 7, "pe"), (2, 8, None)]
    first = [r.id for r in retrieval.sampled_questions(d, "id", 2, 1).collect()]
    assert first == [r.id for r in retrieval.sampled_questions(d.repartition(3), "id", 2, 1).collect()] and len(first) == 2
    assert retrieval.sampled_questions(d, "id", 9).count() == 3


def test_measures(spark):
    found = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 9)], "query string, item long")
    relevant = spark.createDataFrame([("a", 2), ("a", 3), ("b", 1), ("c", 1)], "query string, item long")
    assert {tuple(r) for r in retrieval.precision_recall(found, relevant, 10).collect()} == {("a", 2, 1, 0.1, 0.5), ("b", 1, 0, 0.0, 0.0), ("c", 0, 0, 0.0, 0.0)}
    exact = spark.createDataFrame([(1, 0.1), (1, 0.2), (2, 0.3)], "query_id long, distance double")
    near = spark.createDataFrame([(1, 0.2), (1, 0.200001), (1, 0.5)], "query_id long, distance double")
    assert {tuple(r) for r in retrieval.tolerant_recall(near, exact).collect()} == {(1, 1.0), (2, 0.0)}
    times = spark.createDataFrame([("x", float(i)) for i in range(1, 101)] + [("y", 5.0), ("z", None)], "g string, ms double")
    assert {tuple(r) for r in retrieval.time_statistics(times, "g", "ms").collect()} == {("x", 100, 50.5, 50.0, 96.0), ("y", 1, 5.0, 5.0, 5.0)}
    a = spark.createDataFrame([(1, 7, 0.9), (2, 8, 0.5), (3, 9, 0.5)], "rank int, doc long, score double")
    b = spark.createDataFrame([(1, 7, 0.9 + 1e-12), (2, 5, 0.5), (3, 8, 0.5)], "rank int, doc long, score double")
    assert retrieval.ranking_differences(a, b).count() == 0
    c = spark.createDataFrame([(1, 6, 0.9), (2, 8, 0.4), (3, 9, 0.5)], "rank int, doc long, score double")
    assert {(r.item, r.why) for r in retrieval.ranking_differences(c, a).collect()} >= {(6, "not expected"), (7, "not found"), (8, "another score")}
    answers = spark.createDataFrame([("s", 1, 5), ("s", 2, 6), ("h", 1, 5), ("h", 2, 7)], "method string, q long, first long")
    assert retrieval.agreement(answers, "method", "q", "first", "h", "s").first()[0] == 0.5
    told = retrieval.evaluated(spark.createDataFrame([("m", 1, 1, 4.0), ("m", None, 2, 6.0)], "mode string, chunk int, article int, ms double"), "mode", {"chunk": "chunk", "article": "article"}, "ms").first()
    assert (told.mrr_chunk, told.mrr_article, told.recall_1_chunk, told.recall_5_article, told.mean_ms, told.p95_ms) == (0.5, 0.75, 0.5, 1.0, 5.0, 6.0)


def test_identify_and_replay(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(c) for c in centres[i % 6] + 0.05 * rng.normal(size=8)], i % 6) for i in range(60)] + [(100, [float(c) for c in rng.normal(size=8)], None)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, person_id long")
    names = spark.createDataFrame([(i, f"n{i}") for i in range(6)], "person_id long, name string")
    found = {r.query_id: r for r in identify.identified(d, d.where("person_id is not null"), names, 0.9).collect()}
    assert all(found[i].person == i % 6 and found[i].name == f"n{i % 6}" for i in range(60)) and not found[100].known and found[100].person is None
    events = identify.simulated_events(d, "vec_id", "person_id", events=200, frequent=2)
    assert events.count() == 200
    answers = spark.createDataFrame([(r.query_id, r.person) for r in found.values()], "query_id long, person long")
    run = identify.replayed(events, answers, d, 0.9, top=2)
    memory, expected, who = identify.Remembered(2), [], dict(answers.collect())
    for event, i in sorted(map(tuple, events.collect())):
        v = np.array(next(r[1] for r in rows if r[0] == i))
        v /= np.linalg.norm(v)
        p = memory.find(v, 0.9)
        expected.append((event, i, who[i] if p is None else p, "search" if p is None else "memory"))
        if p is None and who[i] is not None:
            memory.remember(who[i], v)
    assert sorted(map(tuple, run.collect())) == expected
    told = identify.replay_statistics(run, d, person="person_id").first()
    assert told.events == 200 and told.right == 1.0 and told.wrong_from_memory == 0 and told.from_memory > 0.2
    curve = spark.createDataFrame([(0.1, 0.9, 0.2), (0.2, 0.8, 0.6), (0.3, 0.7, 0.7)], "threshold double, accept_rate double, reject_rate double")
    assert identify.best_threshold(curve).first().threshold == 0.2


def test_persons(spark, tmp_path):
    people = Persons(Engine(spark, str(tmp_path)), 2, memory=identify.Remembered())
    a = people.register("Ana", {"1.jpg": [1, 0]})
    people.memory.remember(a, np.array([1.0, 0.0]))
    assert people.add_photos(a, {"2.jpg": [0, 1]}) == [2] and people.memory.find(np.array([1.0, 0.0]), 0.5) is None
    for wrong in (lambda: people.register("Ana", {"3.jpg": [0, 1]}), lambda: people.register("Eva", {"3.jpg": [0, 1, 2]}), lambda: people.remove(77), lambda: people.register(" ", {"x": [1, 1]})):
        with pytest.raises(SemanticError):
            wrong()
    assert people.engine.query("SELECT COUNT(*) FROM persons").first()[0] == 1
    people.remove(a)
    assert people.engine.query("SELECT id FROM photos").count() == 0 and people.register("Ana", {"1.jpg": [1, 0]}) == 1


def test_collections(spark, tmp_path):
    media = tmp_path / "media"
    media.mkdir()
    (media / "a.txt").write_text("0 0\n0 1\n9 9\n")
    (media / "b.txt").write_text("9 8\n9 9\n")
    (media / "c.txt").write_text("")
    (tmp_path / "out.txt").write_text("1 1\n")
    c = features.Collections(spark, str(media))
    vocabulary = c.register(features.NumbersExtractor(2), [[0, 0], [9, 9], [50, 50]])
    assert c.available()[0]["vocabulary_id"] == vocabulary
    e = Engine(spark, str(tmp_path / "w"), vectorizer=c.vectorize)
    e.sql("CREATE TABLE t (id INT PRIMARY KEY, file VARCHAR(20), v VECTOR(3)); INSERT INTO t (id, file) VALUES (1, 'a.txt'), (2, 'b.txt'), (3, 'c.txt'), (4, NULL)")
    assert "no features" in e.sql("SELECT id FROM t WHERE SIMILAR_TO('a.txt', K = 1)")[0].error
    assert c.load(e, "t", "file", "numbers") == 3
    v = {r.id: r.v for r in e.tables["t"].frame.collect()}
    assert np.allclose(v[1], [2 / 3 * np.log(3), 1 / 3 * np.log(1.5), 0]) and np.allclose(v[2], [0, np.log(1.5), 0]) and v[3] == [0, 0, 0] and v[4] is None
    found = e.query("SELECT id, SIMILARITY_SCORE() AS s FROM t WHERE SIMILAR_TO('b.txt', K = 1)").first()
    assert found["id"] == 2 and abs(found["s"] - 1) < 1e-6
    c.save(str(tmp_path / "models"))
    again = features.Collections(spark, str(media))
    again.open(str(tmp_path / "models"))
    with pytest.raises(ValueError):
        again.vectorize("t", "a.txt")
    again.register(features.NumbersExtractor(2), [[0, 0], [9, 9], [50, 50]])
    assert again.vectorize("t", "a.txt") == c.vectorize("t", "a.txt")
    for wrong in (lambda: features.safe_path(str(media), "../out.txt"), lambda: features.safe_path(str(media), "none.txt"), lambda: c.load(e, "t", "file", "sift"), lambda: c.register(features.NumbersExtractor(3), [[0, 0]]), lambda: features.Weights(2, [1, 1], "").vector(np.array([1]))):
        with pytest.raises(ValueError):
            wrong()
    assert np.allclose(features.Weights(4, [1, 0], "", True).vector(np.array([3, 5])), [np.log1p(3) * np.log(4), 0])


def test_corpora(spark, tmp_path):
    word = lambda t, y, p=1: f"{t}\t0\t{y}\t9\t9\tf\t1000\t{p}"
    (tmp_path / "words").mkdir()
    lines = []
    for i in range(10):
        lines.append(json.dumps({"id": f"pe_{i}", "publication_date": f"200{i}.05.01", "pdf_url": f"u{i}", "abstract": "x"}))
        if i != 3:
            (tmp_path / "words" / f"pe_{i}.txt").write_text("\n".join([word("Cabeza", 20), word("texto", 300), word(f"n{i}", 300)] if i != 4 else [word("12", 20)]))
    (tmp_path / "list.txt").write_text("\n".join(lines) + "\n")
    rows = read_articles(spark, str(tmp_path / "list.txt"), str(tmp_path / "words")).orderBy("id").collect()
    assert [(r.id, r.code) for r in rows] == list(enumerate([f"pe_{i}" for i in (0, 1, 2, 5, 6, 7, 8, 9)], 1))
    assert rows[0].asDict() == {"id": 1, "code": "pe_0", "country": "pe", "published": "2000-05-01", "year": 2000, "url_pdf": "u0", "abstract": "x", "text": "Cabeza texto n0"}
    for limit in (1, 3, 4, 7, 10, 99):
        step = 10 / min(limit, 10)
        wanted = [int(i * step) for i in range(min(limit, 10)) if int(i * step) not in (3, 4)]
        assert [r.code for r in read_articles(spark, str(tmp_path / "list.txt"), str(tmp_path / "words"), limit).orderBy("id").collect()] == [f"pe_{i}" for i in wanted]
    spark.createDataFrame([("Ann_De_Mar_0001.jpg", (bytearray(b"x"), None))], "filename string, image struct<bytes:binary,path:string>").write.parquet(str(tmp_path / "faces"))
    assert [(r.person, r.name, bytes(r.image)) for r in read_faces(spark, str(tmp_path / "faces")).collect()] == [("Ann_De_Mar", "Ann De Mar", b"x")]


def test_import(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "w"))
    long = "z" * 40
    (tmp_path / "a.csv").write_text(f"n,x,place\n5,{long},POINT(1 2)\n5,b,\n7,c,\"point(-1.5, 2e0)\"\n")
    told = import_csv(e, str(tmp_path / "a.csv"), "t", "bplus")
    assert told["rows"] == 3 and [c["name"] for c in told["columns"]] == ["id", "n", "x", "place"] and {i["method"] for i in told["indexes"].values()} == {"BPLUS", "FULLTEXT"}
    assert [tuple(r) for r in e.query("SELECT id, n FROM t ORDER BY id").collect()] == [(1, 5), (2, 5), (3, 7)]
    assert e.tables["t"].statistics["n"]["n_distinct"] == 2 and e.query("SELECT id FROM t WHERE distancia(place, POINT(1, 2)) < 10").count() == 1
    assert not e.sql("INSERT INTO t VALUES (4, 8, 'y', NULL)")[0].error and e.query("SELECT id FROM t").count() == 4
    for table, options in (("t", {}), ("T", {}), ("1a", {}), ("u", {"layout": "RTREE"}), ("u", {"key": "none"}), ("u", {"key": "place"}), ("u", {"key": "x"}), ("u", {"key": "n", "layout": "BPLUS_CLUSTERED"})):
        with pytest.raises(CsvError):
            import_csv(e, str(tmp_path / "a.csv"), table, **options)
    assert import_csv(e, str(tmp_path / "a.csv"), "v", "HASH", "n")["columns"][0]["name"] == "n"


def test_published_sample_of_the_stemmer():
    from quillon.functions.text import stem_es
    from quillon.plans.applied import STEMS

    assert {w: stem_es(w) for w in STEMS} == STEMS
