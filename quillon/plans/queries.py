"""The engine's queries over the tables in a folder, and the SQL that says the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon.functions.text import query_terms, terms, tokens
from quillon.operators import codebook, search

from . import flows
from .engine import Engine, statistics

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "conversations")
#: A place in the middle of the derived points.
CENTRE = (-12.05, -77.05)
CONCAVE = ((-12.5, -77.5), (-12.5, -76.6), (-11.6, -76.6), (-12.2, -77.1), (-11.6, -77.5))
ASKED = "que nicht that"
TEXT_QUERY = "tion the erin"


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    """All tables, and some derived ones: customers with points, orders with nulls."""
    e = Engine(spark, parameters={"centro": CENTRE}, **options)
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    for t in TABLES:
        e.attach(t, lambda t=t: read(t))
    place = F.expr("named_struct('lat', -12.55d + (c_custkey % 1000) / 1000.0d, 'lon', -77.55d + ((c_custkey * 7) % 1000) / 1000.0d)")
    e.attach("shops", lambda: read("customer").withColumn("place", place))
    e.attach("shops_n", lambda: read("customer").withColumn("place", F.when(F.col("c_custkey") % 50 != 0, place)))
    e.attach("orders_n", lambda: read("orders").withColumn("price_n", F.expr("case when o_orderkey % 10 <> 0 then o_totalprice end")))
    return e


def _sql(text: str):
    """A query of the dialect, its columns under plain names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = engine(spark, sf_dir).query(text)
        return out.toDF(*[c.replace(".", "_") for c in out.columns])

    return run


_POINT = "(-12.55e0 + (c_custkey % 1000) / 1000.0e0)", "(-77.55e0 + ((c_custkey * 7) % 1000) / 1000.0e0)"
_HAVERSINE = "2 * 6371000.0e0 * asin(sqrt(least(1.0e0, greatest(0.0e0, pow(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin((radians({d}) - radians({c})) / 2), 2)))))"
_DIST = _HAVERSINE.format(a=_POINT[0], b=CENTRE[0], c=_POINT[1], d=CENTRE[1])
_SHOPS = f"(SELECT *, {_POINT[0]} AS lat, {_POINT[1]} AS lon, {_DIST} AS d FROM customer)"
_ORDERS_N = "(SELECT *, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS price_n FROM orders)"


def _polygon_sql(x: str, y: str, v) -> str:
    border, crossings = [], []
    for (ax, ay), (bx, by) in zip(v, v[1:] + v[:1], strict=True):
        border.append(f"(({bx - ax!r}::DOUBLE * ({y} - ({ay!r}::DOUBLE)) - ({by - ay!r}::DOUBLE) * ({x} - ({ax!r}::DOUBLE))) = 0 AND {x} BETWEEN {min(ax, bx)!r}::DOUBLE AND {max(ax, bx)!r}::DOUBLE AND {y} BETWEEN {min(ay, by)!r}::DOUBLE AND {max(ay, by)!r}::DOUBLE)")
        if ay != by:
            crossings.append(f"CASE WHEN (({ay!r}::DOUBLE > {y}) <> ({by!r}::DOUBLE > {y})) AND {x} < {(bx - ax) / (by - ay)!r}::DOUBLE * ({y} - ({ay!r}::DOUBLE)) + ({ax!r}::DOUBLE) THEN 1 ELSE 0 END")
    return f"({' OR '.join(border)} OR ({' + '.join(crossings)}) % 2 = 1)"


_POLYGON = "POLYGON(" + ", ".join(f"POINT({a}, {b})" for a, b in CONCAVE) + ")"

#: name: (the dialect's query, DuckDB's)
PAIRS = {
    "scan_filter_project": ("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02"),
    "predicate_between_in_like": ("SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') OR NOT p_type LIKE '%E%' AND p_size = 7", "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') OR NOT p_type LIKE '%E%' AND p_size = 7"),
    "predicate_3vl_nulls": ("SELECT o_orderkey, price_n FROM orders_n WHERE price_n IS NULL OR NOT (price_n > 100000) AND o_orderstatus NOT IN ('F', 'P')", f"SELECT o_orderkey, price_n FROM {_ORDERS_N} WHERE price_n IS NULL OR NOT (price_n > 100000) AND o_orderstatus NOT IN ('F', 'P')"),
    "not_in_null_is_empty": ("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', NULL)", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', NULL)"),
    "column_compare": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > l_tax AND l_quantity < 3", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > l_tax AND l_quantity < 3"),
    "join_two": ("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0", "SELECT c_custkey AS customer_c_custkey, n_name AS nation_n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0"),
    "join_three_pushdown": ("SELECT o_orderkey, c_name, n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_nationkey < 5 AND o.o_totalprice > 200000", "SELECT o_orderkey AS o_o_orderkey, c_name AS c_c_name, n_name AS n_n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 5 AND o_totalprice > 200000"),
    "join_self": ("SELECT a.n_name, b.n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS a_n_name, b.n_name AS b_n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey"),
    "join_null_keys": ("SELECT a.o_orderkey FROM orders_n a JOIN orders_n b ON a.price_n = b.price_n", f"SELECT a.o_orderkey AS a_o_orderkey FROM {_ORDERS_N} a JOIN {_ORDERS_N} b ON a.price_n = b.price_n"),
    "join_post_filter_columns": ("SELECT c_custkey, s_suppkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE c_custkey = s_suppkey", "SELECT c_custkey AS customer_c_custkey, s_suppkey AS supplier_s_suppkey FROM customer JOIN supplier ON s_nationkey = c_nationkey JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = s_suppkey"),
    "group_all_aggregates": ("SELECT l_returnflag, COUNT(*), COUNT(l_tax), SUM(l_quantity), AVG(l_linenumber), MIN(l_shipdate), MAX(l_linestatus) FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(*) AS conteo, count(l_tax) AS count_l_tax, sum(l_quantity) AS sum_l_quantity, avg(l_linenumber) AS avg_l_linenumber, min(l_shipdate) AS min_l_shipdate, max(l_linestatus) AS max_l_linestatus FROM lineitem GROUP BY l_returnflag"),
    "group_star_conteo": ("SELECT * FROM events GROUP BY event_type", "SELECT event_type, count(*) AS conteo FROM events GROUP BY event_type"),
    "group_distinct": ("SELECT o_orderpriority FROM orders GROUP BY o_orderpriority", "SELECT DISTINCT o_orderpriority FROM orders"),
    "global_aggregate_empty": ("SELECT COUNT(*), SUM(o_totalprice), MIN(o_orderkey) FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS conteo, sum(o_totalprice) AS sum_o_totalprice, min(o_orderkey) AS min_o_orderkey FROM orders WHERE o_orderkey < 0"),
    "sum_all_null_group": ("SELECT COUNT(*), SUM(price_n), AVG(price_n) FROM orders_n WHERE price_n IS NULL", f"SELECT count(*) AS conteo, CASE WHEN count(*) > 0 THEN coalesce(sum(price_n), 0) END AS sum_price_n, avg(price_n) AS avg_price_n FROM {_ORDERS_N} WHERE price_n IS NULL"),
    "order_nulls_asc": ("SELECT price_n FROM orders_n ORDER BY price_n LIMIT 20", f"SELECT price_n FROM {_ORDERS_N} ORDER BY price_n ASC NULLS LAST LIMIT 20"),
    "order_nulls_desc": ("SELECT price_n FROM orders_n ORDER BY price_n DESC LIMIT 2000", f"SELECT price_n FROM {_ORDERS_N} ORDER BY price_n DESC NULLS FIRST LIMIT 2000"),
    "topk": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 15", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 15"),
    "limit_zero": ("SELECT o_orderkey FROM orders LIMIT 0", "SELECT o_orderkey FROM orders LIMIT 0"),
    "radius_haversine": ("SELECT c_custkey FROM shops WHERE distancia(place, centro) <= 20000", f"SELECT c_custkey FROM {_SHOPS} WHERE d <= 20000"),
    "radius_euclidean": ("SELECT c_custkey FROM shops WHERE distancia(place, POINT(-12.05, -77.05), 'euclidean') < 0.2", f"SELECT c_custkey FROM {_SHOPS} WHERE sqrt(pow(lat - (-12.05e0), 2) + pow(lon - (-77.05e0), 2)) < 0.2e0"),
    "distance_between": ("SELECT c_custkey FROM shops WHERE distancia(place, centro) BETWEEN 5000 AND 9000", f"SELECT c_custkey FROM {_SHOPS} WHERE d BETWEEN 5000 AND 9000"),
    "knn": ("SELECT c_custkey FROM shops ORDER BY distancia(place, centro) LIMIT 7", f"SELECT c_custkey FROM {_SHOPS} ORDER BY d LIMIT 7"),
    "knn_filtered": ("SELECT c_custkey FROM shops WHERE c_acctbal > 5000 ORDER BY distancia(place, centro) LIMIT 9", f"SELECT c_custkey FROM {_SHOPS} WHERE c_acctbal > 5000 ORDER BY d LIMIT 9"),
    "distance_is_null": ("SELECT c_custkey FROM shops_n WHERE distancia(place, centro) IS NULL", "SELECT c_custkey FROM customer WHERE c_custkey % 50 = 0"),
    "polygon_concave_border": (f"SELECT c_custkey FROM shops WHERE intersecta(place, {_POLYGON})", f"SELECT c_custkey FROM {_SHOPS} WHERE {_polygon_sql('lat', 'lon', CONCAVE)}"),
    "join_radius_group": ("SELECT n_name, COUNT(*), SUM(o_totalprice) FROM orders JOIN shops ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE distancia(place, centro) <= 40000 AND o_totalprice BETWEEN 1000 AND 300000 GROUP BY n_name ORDER BY conteo DESC", f"SELECT n_name AS nation_n_name, count(*) AS conteo, sum(o_totalprice) AS sum_o_totalprice FROM orders JOIN {_SHOPS} ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE d <= 40000 AND o_totalprice BETWEEN 1000 AND 300000 GROUP BY n_name"),
}


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def group_by_point(spark, sf_dir):
    out = engine(spark, sf_dir).query("SELECT place, COUNT(*) FROM shops GROUP BY place")
    return out.select(F.col("place.lat").alias("lat"), F.col("place.lon").alias("lon"), "conteo")


def text_tokens(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n"))


def text_lexicon(spark, sf_dir):
    return terms(_read(spark, sf_dir, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _match(method, **options):
    def run(spark, sf_dir):
        found = search.match(_read(spark, sf_dir, "documents"), TEXT_QUERY, "doc_id", "text", method, **options)
        return found.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))

    return run


def match_filtered(spark, sf_dir):
    """Of plain words, as its SQL has no stemmer."""
    out = engine(spark, sf_dir, analysis={}).query(f"SELECT doc_id, SCORE() AS s FROM documents WHERE MATCH(text, '{TEXT_QUERY}') AND lang = 'en' USING BM25 WITH K1 = 1.5, B = 0.5")
    return out.select("doc_id", F.round("s", 6).alias("score"))


def match_stopwords_only(spark, sf_dir):
    return engine(spark, sf_dir).query("SELECT doc_id, SCORE() AS s FROM documents WHERE MATCH(text, 'de la que el en y a los') AND lang = 'es'").select("doc_id")


def _asked(spark, sf_dir):
    """The queries of the vector searches: every row whose id is divisible by 100."""
    return _read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")


def _query_vector(spark, sf_dir):
    return list(_read(spark, sf_dir, "embeddings").where("vec_id = 7").first()["embedding"])


def _nearest(metric, where="true"):
    def run(spark, sf_dir):
        found = search.nearest_many(_read(spark, sf_dir, "embeddings").where(where), _asked(spark, sf_dir), 10, metric)
        return found.select("query_id", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))

    return run


def similar_without_index(spark, sf_dir):
    """USING IVF over a table that has no such index searches all rows."""
    v = ", ".join(map(str, _query_vector(spark, sf_dir)))
    found = engine(spark, sf_dir).query(f"SELECT vec_id, SIMILARITY_SCORE() AS s FROM embeddings WHERE SIMILAR_TO(VECTOR({v}), K = 10) AND label < 8 USING IVF")
    return found.select("vec_id", F.round("s", 6).alias("score"))


def ivf_full_probes_equals_exact(spark, sf_dir):
    index, centres = search.ivf_index(_read(spark, sf_dir, "embeddings"))
    found = search.ivf_many(index, centres, _asked(spark, sf_dir), 10, len(centres))
    return found.select("query_id", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


def _told_recall(exact, found, asked):
    """Recall itself depends on drawn centroids; that it reaches 0.9 does not."""
    return search.recall(exact, found, "query_id", "id").select(F.lit(asked.count()).alias("queries"), (F.col("recall") >= 0.9).alias("reaches_090"))


def ivf_recall(spark, sf_dir):
    """At the probes that the index sets itself."""
    vectors, asked = _read(spark, sf_dir, "embeddings"), _asked(spark, sf_dir)
    index, centres = search.ivf_index(vectors)
    found = search.ivf_many(index, centres, asked, 10, search.calibrated_probes(vectors, index, centres))
    return _told_recall(search.nearest_many(vectors, asked, 10), found, asked)


def graph_recall(spark, sf_dir):
    """At the default width of a walk."""
    vectors, asked = _read(spark, sf_dir, "embeddings"), _asked(spark, sf_dir)
    return _told_recall(search.nearest_many(vectors, asked, 10), search.graph_many(search.graph_index(vectors), asked, 10), asked)


def chunk_words(spark, sf_dir):
    cut = search.chunks(_read(spark, sf_dir, "documents"), "doc_id", "text")
    return cut.select("doc_id", F.col("place").cast("long").alias("place"), F.md5("chunk").alias("chunk_md5"))


def last_three_user_turns(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").where("role = 'user'")
    said = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return turns.groupBy("conv_id").agg(said.alias("t")).select("conv_id", F.array_join(F.slice("t", F.greatest(F.lit(1), F.size("t") - 2), 3)["text"], " ").alias("search_text"))


def best_per_group(spark, sf_dir):
    """The best hit of each label, over all rows."""
    q = _query_vector(spark, sf_dir)
    scored = _read(spark, sf_dir, "embeddings").withColumn("score", search.vector_score(search.vector_distance(F.col("embedding"), q, "cosine"), "cosine"))
    return search.best_per_group(scored, "label").select("label", F.round("score", 6).alias("score"))


def threshold_curve(spark, sf_dir):
    q = _query_vector(spark, sf_dir)
    scored = _read(spark, sf_dir, "embeddings").withColumn("score", F.round(search.vector_score(search.vector_distance(F.col("embedding"), q, "cosine"), "cosine"), 6))
    tries = scored.select((F.col("label") < 8).alias("known"), (F.col("vec_id") % 3 > 0).alias("right"), "score")
    return search.threshold_curve(tries, [0.0, 0.1, 0.2, 0.3]).select("threshold", *[F.round(c, 9).alias(c) for c in ("accept_rate", "reject_rate", "error_rate")])


def retrieval_metrics(spark, sf_dir):
    """How high the first other row of the query's own label stands among its ten nearest."""
    vectors = _read(spark, sf_dir, "embeddings")
    found = search.nearest_many(vectors, _asked(spark, sf_dir), 11).where("id <> query_id")
    labels = vectors.select(F.col("vec_id").alias("id"), "label")
    own = _asked(spark, sf_dir).select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    hits = found.withColumn("place", place).where("place <= 10").join(labels, "id").join(own, "query_id").where("label = own").groupBy("query_id").agg(F.min("place").alias("rank"))
    return search.retrieval_metrics(own.join(hits, "query_id", "left")).select("questions", *[F.round(c, 9).alias(c) for c in ("mrr", "recall_1", "recall_5", "recall_10")])


def frequent_top_n(spark, sf_dir):
    return _read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(20)


def _centroids(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings").where("vec_id < 8").orderBy("vec_id").collect()
    return np.array([r["embedding"] for r in rows], float)


def bovw_histogram(spark, sf_dir):
    return search.word_histograms(_read(spark, sf_dir, "embeddings"), _centroids(spark, sf_dir), "label", "embedding")


def bovw_tfidf(spark, sf_dir):
    return search.histogram_tfidf(bovw_histogram(spark, sf_dir), "label").withColumn("weight", F.round("weight", 9))


def kmeans_codebook(spark, sf_dir):
    index, _ = search.ivf_index(_read(spark, sf_dir, "embeddings"), lists=8, metric="euclidean")
    return index.groupBy("cell").agg(F.count("*").alias("n"))


def lloyd_round(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings")
    centres = np.array([r["embedding"] for r in vectors.where("vec_id < 8").orderBy("vec_id").collect()], float)
    met = codebook.lloyd_round(vectors, "embedding", centres)
    return met.select("word", "n", F.round("inertia", 6).alias("inertia"), F.round(F.col("total")[0] / F.col("n"), 9).alias("first"))


def analyze_stats(spark, sf_dir):
    frame = _read(spark, sf_dir, "customer")
    return statistics(frame.select("c_custkey", "c_nationkey", "c_mktsegment"), [("c_custkey", "INT"), ("c_nationkey", "INT"), ("c_mktsegment", "TEXT")]).select("column", "n_distinct", "least", "greatest", "null_fraction")


FUNCTIONS = {f.__name__: f for f in (group_by_point, text_tokens, text_lexicon, match_filtered, match_stopwords_only, similar_without_index, ivf_full_probes_equals_exact, ivf_recall, graph_recall, chunk_words, last_three_user_turns, best_per_group, threshold_curve, retrieval_metrics, frequent_top_n, bovw_histogram, bovw_tfidf, kmeans_codebook, lloyd_round, analyze_stats)}
FUNCTIONS |= {"bm25": _match("BM25"), "bm25_params": _match("BM25", k1=2.0, b=0.1), "tfidf": _match("TF_IDF"), "knn_cosine": _nearest("cosine"), "knn_euclidean": _nearest("euclidean"), "knn_dot": _nearest("dot"), "knn_vector_filtered": _nearest("cosine", "label = 3")}
QUERIES = {k: _sql(v[0]) for k, v in PAIRS.items()} | FUNCTIONS

_TERMS = "terms AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-záéíóúñü]+')) AS term FROM documents), post AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL), len AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS len FROM documents d LEFT JOIN post p ON p.doc_id = d.doc_id WHERE text IS NOT NULL GROUP BY d.doc_id), corpus AS (SELECT count(*)::DOUBLE AS n, avg(len) AS avgdl FROM len), df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"
_IN = ", ".join(f"'{t}'" for t in query_terms(TEXT_QUERY))


def _bm25(k1: float, b: float) -> str:
    return f"WITH {_TERMS} SELECT p.doc_id, round(sum(ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * tf * ({k1}e0 + 1) / (tf + {k1}e0 * (1 - {b}e0 + {b}e0 * len / avgdl))), 6) AS score FROM post p JOIN len USING (doc_id) JOIN df USING (term) CROSS JOIN corpus WHERE term IN ({_IN}) GROUP BY p.doc_id"


_Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)"
_V = "CAST(embedding AS DOUBLE[])"
_COS = f"list_dot_product({_V}, {_Q}) / sqrt(list_dot_product({_V}, {_V}) * list_dot_product({_Q}, {_Q}))"
_SIMILAR = {
    "cosine": ("1 - list_dot_product(e.v, q.v) / sqrt(list_dot_product(e.v, e.v) * list_dot_product(q.v, q.v))", "1 - d"),
    "euclidean": ("list_distance(e.v, q.v)", "1 / (1 + d)"),
    "dot": ("-list_dot_product(e.v, q.v)", "-d"),
}


def _knn(metric: str, where: str = "true", k: int = 10) -> str:
    d, score = _SIMILAR[metric]
    return f"SELECT query_id, vec_id, r::INT AS rank, round({score}, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r FROM (SELECT q.vec_id AS query_id, e.vec_id, e.label, q.label AS own, {d} AS d FROM (SELECT *, {_V} AS v FROM embeddings WHERE {where}) e, (SELECT *, {_V} AS v FROM embeddings WHERE vec_id % 100 = 0) q)) WHERE r <= {k}"


_ASSIGN = f"(SELECT e.label, c.vec_id::INT AS word, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(CAST(e.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), c.vec_id) AS r FROM embeddings e, embeddings c WHERE c.vec_id < 8)"
_HIST = f"(SELECT label, word, count(*) AS n FROM {_ASSIGN} WHERE r = 1 GROUP BY ALL)"

ORACLES = {k: v[1] for k, v in PAIRS.items()} | {
    "group_by_point": f"SELECT lat, lon, count(*) AS conteo FROM {_SHOPS} GROUP BY lat, lon",
    "text_tokens": "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-záéíóúñü]+')) AS n FROM documents",
    "text_lexicon": f"WITH {_TERMS} SELECT term, count(*) AS df, sum(tf) AS cf FROM post GROUP BY term",
    "bm25": _bm25(1.2, 0.75),
    "bm25_params": _bm25(2.0, 0.1),
    "match_filtered": f"SELECT doc_id, score FROM ({_bm25(1.5, 0.5)}) JOIN documents USING (doc_id) WHERE lang = 'en'",
    "tfidf": f"WITH {_TERMS}, w AS (SELECT doc_id, term, log10(1 + tf) * log10(n / df) AS w FROM post JOIN df USING (term) CROSS JOIN corpus), q AS (SELECT term, log10(2) * log10(n / df) AS wq FROM df CROSS JOIN corpus WHERE term IN ({_IN}) AND df < n), nd AS (SELECT doc_id, sqrt(sum(w * w)) AS nd FROM w GROUP BY doc_id) SELECT doc_id, round(sum(w * wq) / (any_value(nd) * (SELECT sqrt(sum(wq * wq)) FROM q)), 6) AS score FROM w JOIN q USING (term) JOIN nd USING (doc_id) GROUP BY doc_id",
    "knn_cosine": _knn("cosine"),
    "ivf_full_probes_equals_exact": _knn("cosine"),
    "knn_vector_filtered": _knn("cosine", "label = 3"),
    "knn_euclidean": _knn("euclidean"),
    "knn_dot": _knn("dot"),
    "similar_without_index": f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings WHERE label < 8 ORDER BY {_COS} DESC, vec_id LIMIT 10",
    "ivf_recall": "SELECT count(*)::INT AS queries, true AS reaches_090 FROM embeddings WHERE vec_id % 100 = 0",
    "graph_recall": "SELECT count(*)::INT AS queries, true AS reaches_090 FROM embeddings WHERE vec_id % 100 = 0",
    "match_stopwords_only": "SELECT doc_id FROM documents WHERE false",
    "chunk_words": r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), n AS (SELECT *, len(w) AS n, greatest(0, ceil((len(w) - 200) / 160.0))::BIGINT AS l FROM w WHERE len(w) > 0), c AS (SELECT *, CASE WHEN l > 0 AND n - (l * 160 + 40) < 60 THEN l ELSE l + 1 END AS cnt FROM n), p AS (SELECT *, unnest(range(cnt)) AS place FROM c) SELECT doc_id, place, md5(array_to_string(w[place * 160 + 1 : CASE WHEN place = cnt - 1 THEN n ELSE place * 160 + 200 END], ' ')) AS chunk_md5 FROM p",
    "rrf_fusion": f"WITH t AS (SELECT doc_id AS doc, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({_bm25(1.2, 0.75)}) QUALIFY r <= 20), v AS (SELECT vec_id AS doc, row_number() OVER (ORDER BY round({_COS}, 6) DESC, vec_id) AS r FROM embeddings QUALIFY r <= 20) SELECT doc, round(sum(1.0e0 / (60 + r)), 9) AS rrf, max(CASE WHEN l = 't' THEN r END)::INT AS bm25_position, max(CASE WHEN l = 'v' THEN r END)::INT AS vector_position FROM (SELECT *, 't' AS l FROM t UNION ALL SELECT *, 'v' AS l FROM v) GROUP BY doc ORDER BY sum(1.0e0 / (60 + r)) DESC, doc LIMIT 10",
    "last_three_user_turns": "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS search_text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user') WHERE r <= 3 GROUP BY conv_id",
    "best_per_group": f"SELECT label, round(max(s), 6) AS score FROM (SELECT label, {_COS} AS s FROM embeddings) GROUP BY label",
    "threshold_curve": f"WITH s AS (SELECT label < 8 AS known, vec_id % 3 > 0 AS ok, round({_COS}, 6) AS s FROM embeddings), t AS (SELECT unnest([0.0e0, 0.1e0, 0.2e0, 0.3e0]) AS threshold) SELECT threshold, round(avg(CASE WHEN known THEN (s >= threshold AND ok)::INT END), 9) AS accept_rate, round(avg(CASE WHEN NOT known THEN (s < threshold)::INT END), 9) AS reject_rate, round(avg(CASE WHEN known THEN (s >= threshold AND NOT ok)::INT END), 9) AS error_rate FROM s, t GROUP BY threshold",
    "retrieval_metrics": f"WITH h AS (SELECT query_id, min(place) AS r FROM (SELECT query_id, e.label, o.label AS own, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM ({_knn('cosine', k=11)}) k JOIN embeddings e ON e.vec_id = k.vec_id JOIN embeddings o ON o.vec_id = query_id WHERE k.vec_id <> query_id) WHERE place <= 10 AND label = own GROUP BY query_id), r AS (SELECT r FROM (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0) q LEFT JOIN h ON h.query_id = q.vec_id) SELECT count(*) AS questions, round(avg(coalesce(1.0e0 / r, 0)), 9) AS mrr, round(avg(CASE WHEN r <= 1 THEN 1.0e0 ELSE 0 END), 9) AS recall_1, round(avg(CASE WHEN r <= 5 THEN 1.0e0 ELSE 0 END), 9) AS recall_5, round(avg(CASE WHEN r <= 10 THEN 1.0e0 ELSE 0 END), 9) AS recall_10 FROM r",
    "frequent_top_n": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20",
    "bovw_histogram": f"SELECT label, word, n FROM {_HIST}",
    "bovw_tfidf": f"WITH h AS (SELECT * FROM {_HIST}) SELECT label, word, round(n / sum(n) OVER (PARTITION BY label)::DOUBLE * ln((SELECT count(DISTINCT label) FROM h)::DOUBLE / count(*) OVER (PARTITION BY word)), 9) AS weight FROM h",
    "lloyd_round": f"WITH a AS (SELECT c.vec_id::INT AS word, {_V.replace('embedding', 'e.embedding')} AS v, list_distance({_V.replace('embedding', 'e.embedding')}, {_V.replace('embedding', 'c.embedding')}) AS d, row_number() OVER (PARTITION BY e.vec_id ORDER BY d, c.vec_id) AS r FROM embeddings e, embeddings c WHERE c.vec_id < 8) SELECT word, count(*) AS n, round(sum(d * d), 6) AS inertia, round(avg(v[1]), 9) AS first FROM a WHERE r = 1 GROUP BY word",
    "analyze_stats": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, min({c})::VARCHAR AS least, max({c})::VARCHAR AS greatest, 0.0e0 AS null_fraction FROM customer" for c in ("c_custkey", "c_nationkey", "c_mktsegment")),
}
QUERIES |= flows.QUERIES
ORACLES |= flows.ORACLES
