import pytest
from pyspark.sql import functions as F

from quillon.operators import gallery, pages
from quillon.plans.engine import Engine
from quillon.plans.locks import Locks, LockTimeout
from quillon.sources.csv_table import CsvError, read_csv


def _file(folder, text):
    path = folder / f"t{len(list(folder.iterdir()))}.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_types(spark, tmp_path):
    text = "﻿a,b,c,d,e,f\n1,1.5,\"x,\"\"y\"\"\",POINT(1 2),,2147483647\n ,,,,,\n\n-2, 3 ,é" + "z" * 40 + ",\"point( -1.5 , .5e1 )\",,\n"
    rows, kinds = read_csv(spark, _file(tmp_path, text))
    assert kinds == {"a": "INT", "b": "FLOAT", "c": "TEXT", "d": "POINT", "e": "STRING", "f": "INT"}
    assert [(r.a, r.b, tuple(r.d), r.e, r.f) for r in rows.collect()] == [(1, 1.5, (1.0, 2.0), None, 2147483647), (-2, 3.0, (-1.5, 5.0), None, None)]
    assert rows.first().c == 'x,"y"'
    assert read_csv(spark, _file(tmp_path, "a\n5\n6\n"), serial=True)[0].count() == 2


@pytest.mark.parametrize("text", ["", "a,a\n1,2\n", "a,b c\n1,2\n", "a,b\n", "a,b\n1\n", "a,b\n1,2,3\n", "a\n2147483648\n", "a\n1.5\nnan\n"])
def test_csv_refused(spark, tmp_path, text):
    with pytest.raises(CsvError):
        read_csv(spark, _file(tmp_path, text))


def test_pages(spark):
    word = lambda t, y, p: f"{t}\t0\t{y}\t9\t9\tf\t1000\t{p}"
    content = "\n".join([word("Título", 50, 1), word("1", 52, 1), word("un", 300, 1), word("ejem-", 303, 1), word("plo", 400, 1), word("12", 950, 1), word("titulo", 50, 2), word("A-", 500, 2), word("B", 500, 2), word("-", 500, 2), word("fin", 500, 2), word("Sólo", 990, 2), "bad line"])
    d = spark.createDataFrame([(1, content), (2, None), (3, "")], "id int, content string")
    assert [r.text for r in pages.clean_pages(d).orderBy("id").collect()] == ["un ejemplo A- B - fin Sólo", None, ""]


def test_gallery(spark, tmp_path):
    rows = [(i, "o", f"p{i % 3 if i < 12 else i}", i != 4, [float(i), 1.0]) for i in range(16)]
    d = spark.createDataFrame(rows, "at long, origin string, name string, ok boolean, v array<double>")
    people, photos = gallery.enrolled(d, "origin", "name", "at", "ok")
    assert {(r.name, r.person_id) for r in people.collect()} == {("p0", 1), ("p1", 2), ("p2", 3), ("p12", 4), ("p13", 5), ("p14", 6), ("p15", 7)}
    assert [r.photo_id for r in photos.orderBy("at").collect()] == list(range(1, 16))
    assert sorted(r.id for r in gallery.numbered(d, "at", block=5).collect()) == list(range(1, 17))
    roles = {(r.name, r.role): r.n for r in gallery.split_known(d, "name", "at", 2, tests=1).groupBy("name", "role").agg(F.count("*").alias("n")).collect()}
    assert roles == {(f"p{i}", r): n for i in range(3) for r, n in (("register", 2), ("test", 1))} | {(f"p{i}", "unknown"): 1 for i in range(12, 16)}
    means = gallery.frequent_means(d, "name", "v", 2)
    assert [(r.name, r.n) for r in means.orderBy("name").collect()] == [("p0", 4), ("p1", 4)]
    assert gallery.recognised(means, [1.0, 0.0], 0.9, "name").count() == 1 and gallery.recognised(means, [-1.0, 0.0], 0.1, "name").count() == 0
    assert gallery.reservoir(d, "at", 5).count() == 5
    book = gallery.save_codebook(spark, str(tmp_path / "book"), "sift", [[0.5, 1.0]])
    assert gallery.load_codebook(spark, str(tmp_path / "book"))["vocabulary_id"] == book


def test_locks():
    locks, one, two = Locks(), object(), object()
    locks.acquire(one, "t", "PS")
    locks.acquire(two, "t", "PU")
    with pytest.raises(LockTimeout):
        locks.acquire(one, "t", "PX", seconds=0.05)
    locks.release(two)
    locks.acquire(one, "t", "PX")
    locks.acquire(one, "t", "PS")
    assert locks.held(one) == {"t": "PX"} and locks.held(two) == {}
    with pytest.raises(LockTimeout):
        locks.acquire(two, "t", "PS", seconds=0.05)
    locks.release(one)
    locks.acquire(two, "t", "PX")


def test_transactions_and_saved_tables(spark, tmp_path):
    locks = Locks()
    a, b = Engine(spark, str(tmp_path / "w"), locks=locks), Engine(spark, locks=locks)
    done = a.sql("CREATE TABLE t (id INT PRIMARY KEY, p POINT, n VARCHAR(3)); CREATE TABLE u (k INT); CREATE INDEX i ON t (n) USING HASH; INSERT INTO t VALUES (1, POINT(1, 2), 'a'); BEGIN TRANSACTION; DELETE FROM t WHERE id > 1")
    assert not [r.error for r in done if r.error] and locks.held(a) == {"t": "PU"}
    assert a.sql("UPDATE t SET n = 'a' WHERE id = 1")[0].affected == 1 and locks.held(a) == {"t": "PX"}
    a.sql("END TRANSACTION")
    assert locks.held(a) == {}
    a.save(str(tmp_path / "catalogue"))
    again = Engine.load(spark, str(tmp_path / "catalogue"))
    assert [r.id for r in again.query("SELECT id FROM t WHERE n = 'a'").collect()] == [1] and again.query("SELECT k FROM u").count() == 0
    assert again.tables["t"].indexes.keys() == {"i"}
    assert again.sql("INSERT INTO t VALUES (1, NULL, 'b')")[0].error and not again.sql("INSERT INTO t VALUES (2, NULL, 'b')")[0].error
    assert again.query("SELECT id FROM t").count() == 2 and a.query("SELECT id FROM t").count() == 1


def test_changes_read_all_nations(spark, tmp_path):
    from quillon.plans import flows

    spark.createDataFrame([(3, "A", 0), (30, "B", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    assert sorted(r.id for r in flows.QUERIES["dml_insert_effect"](spark, str(tmp_path)).collect()) == [3, 30, 100, 101]
