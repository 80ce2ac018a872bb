import pytest
from pyspark.sql import functions as F

from quillon.functions.spatial import checked_polygon
from quillon.functions.text import stem_es
from quillon.plans import queries
from quillon.plans.dialect import ParseError, parse
from quillon.plans.engine import Engine


@pytest.mark.parametrize("text", ["SELECT", "SELECT a FROM t LIMIT -1", "DELETE FROM t", "SELECT f(a) FROM t", "CREATE TABLE t (a INT PRIMARY KEY, b INT PRIMARY KEY)", "EXPLAIN ANALYZE EXPLAIN SELECT a FROM t", "SELECT a FROM t WHERE a ~ 1"])
def test_must_not_parse(text):
    with pytest.raises(ParseError):
        parse(text)


def test_changes_and_rules(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    done = e.sql("CREATE TABLE t (id INT PRIMARY KEY, v FLOAT, n VARCHAR(3), d DATE); INSERT INTO t VALUES (1, 1.5, 'áá', '2024-01-31'), (2, NULL, 'x', NULL); INSERT INTO t (id) VALUES (1); INSERT INTO t (id, n) VALUES (3, 'abcd'); UPDATE t SET n = 'z' WHERE id = 2; DELETE FROM t WHERE v > 100; SELECT * FROM t ORDER BY v DESC")
    assert [bool(r.error) for r in done] == [False, False, True, True, False, False, False]
    assert [tuple(r) for r in done[-1].frame.collect()] == [(2, None, "z", None), (1, 1.5, "áá", "2024-01-31")]
    for wrong in ("SELECT id, id FROM t", "SELECT * FROM u", "SELECT id FROM t WHERE v = NULL", "SELECT id FROM t WHERE id LIKE 'a'", "SELECT SUM(n) FROM t", "SELECT id, COUNT(*) FROM t"):
        assert e.sql(wrong)[0].error
    assert [tuple(r) for r in e.query("SELECT SUM(v), COUNT(v), COUNT(*) FROM t WHERE id = 2").collect()] == [(0.0, 0, 1)]
    assert e.query("SELECT id FROM t WHERE id = 1.5").count() == 0


def test_stems_and_polygons():
    assert [stem_es(w) for w in ("inflación", "banca", "crece", "perú")] == ["inflacion", "banc", "crec", "peru"]
    with pytest.raises(ValueError):
        checked_polygon([(0, 0), (1, 1), (1, 0), (0, 1)])
    with pytest.raises(ValueError):
        checked_polygon([(0, 0), (1, 1), (2, 2)])


def test_match_drops_stop_words_and_stems(spark):
    e = Engine(spark)
    e.attach("t", spark.createDataFrame([(1, "Los bancos y la inflación"), (2, "el banco de la plaza"), (3, "y los de la")], "id int, x string"))
    found = lambda q: {r.id for r in e.query(f"SELECT id, SCORE() AS s FROM t WHERE MATCH(x, '{q}')").collect()}
    assert found("banco") == {1, 2} and found("inflaciones") == {1} and found("los de la") == set()
    e.analysis = {}
    assert found("banco") == {2} and found("los de la") == {1, 2, 3}


def test_customers_at_one_place_go_by_key_however_files_are_split(spark, tmp_path):
    """knn: 90 customers at the centre; each split of the files gave seven others."""
    spark.range(90_000).selectExpr("id AS c_custkey", "0.5d + id % 3 * 4000 AS c_acctbal").repartition(3).write.parquet(f"{tmp_path}/customer.parquet")
    found = [r.c_custkey for r in queries.QUERIES["knn"](spark, str(tmp_path)).collect()]
    assert found == [500, 1500, 2500, 3500, 4500, 5500, 6500]


def test_the_last_place_of_a_filtered_search_goes_by_key(spark, tmp_path):
    """knn_filtered: eight customers at the centre pass, eight others share the next distance."""
    spark.range(15_000).selectExpr("id AS c_custkey", "double(id) AS c_acctbal").where("c_custkey < 1000 OR c_custkey >= 7000").orderBy(F.desc("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = [r.c_custkey for r in queries.QUERIES["knn_filtered"](spark, str(tmp_path)).collect()]
    assert sorted(found) == [7499, *range(7500, 15_000, 1000)] and found[-1] == 7499


def test_rows_with_equal_keys_are_told_apart_by_what_is_shown(spark):
    rows = [(1, x, f"n{x}", 1.0, {"k": x}) for x in range(40)]
    shown = []
    for order, parts in ((rows, 1), (rows[::-1], 3)):
        e = Engine(spark)
        e.attach("t", spark.createDataFrame(order, "g int, x int, n string, v double, m map<string, int>").repartition(parts))
        shown.append([e.query(q).collect() for q in ("SELECT x FROM t ORDER BY v LIMIT 5", "SELECT n FROM t ORDER BY v DESC LIMIT 5", "SELECT * FROM t ORDER BY g LIMIT 5")])
    assert shown[0] == shown[1] and [r.x for r in shown[0][0]] == [0, 1, 2, 3, 4]
