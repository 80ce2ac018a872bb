"""Queries over kept indexes, imports, retrieval and galleries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon.operators import identify, retrieval, search, text_index
from quillon.operators.gallery import numbered
from quillon.sources.corpora import read_faces
from quillon.sources.import_table import import_csv

from . import queries as Q
from .engine import Engine
from .flows import _folder, _read
from .persons import Persons

# Words of the stemmer's published sample vocabulary, and their stems.
STEMS = {
    "che": "che", "checa": "chec", "checar": "chec", "checo": "chec", "checoslovaquia": "checoslovaqui", "chedraoui": "chedraoui", "chefs": "chefs", "cheliabinsk": "cheliabinsk", "chelo": "chel", "chemical": "chemical", "chemicalweek": "chemicalweek", "chemise": "chemis", "chepo": "chep", "cheque": "chequ", "chequeo": "cheque", "cheques": "chequ", "cheraw": "cheraw", "chesca": "chesc", "chester": "chest", "chetumal": "chetumal", "chetumaleños": "chetumaleñ", "chevrolet": "chevrolet", "cheyene": "cheyen", "cheyenne": "cheyenn", "chi": "chi", "chía": "chi", "chiapaneca": "chiapanec", "chiapas": "chiap", "chiba": "chib", "chic": "chic", "chica": "chic", "chicago": "chicag", "chicana": "chican", "chicano": "chican", "chicas": "chic", "chicharrones": "chicharron", "chichen": "chich", "chichimecas": "chichimec", "chicles": "chicl", "chico": "chic",
    "torá": "tor", "tórax": "torax", "torcer": "torc", "toreado": "tor", "toreados": "tor", "toreándolo": "tor", "torear": "tor", "toreara": "tor", "torearlo": "tor", "toreó": "tore", "torero": "torer", "toreros": "torer", "torio": "tori", "tormenta": "torment", "tormentas": "torment", "tornado": "torn", "tornados": "torn", "tornar": "torn", "tornen": "torn", "torneo": "torne", "torneos": "torne", "tornillo": "tornill", "tornillos": "tornill", "torniquete": "torniquet", "torno": "torn", "toro": "tor", "toronto": "toront", "toros": "tor", "torpedearon": "torped", "torpeza": "torpez", "torrado": "torr", "torralba": "torralb", "torre": "torr", "torrencial": "torrencial", "torrenciales": "torrencial", "torrente": "torrent", "torreon": "torreon", "torreón": "torreon", "torres": "torr", "torrescano": "torrescan",
}
STEMMED_QUERY = "Los toreros de la torre, un cheque y chicos; torneo de toros"
_TEXTS = "'el ' || array_to_string(list_transform(range(doc_id % 9), lambda j: w[CAST((doc_id * 7 + j * j * 3) % 80 + 1 AS BIGINT)]), ' de la ')"


def _stem_table(spark, sf_dir) -> DataFrame:
    """Texts of sample words, made from the ids of the documents."""
    words = F.array(*map(F.lit, STEMS))
    said = F.transform(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 9), lambda j: F.get(words, ((F.col("doc_id") * 7 + j * j * 3) % len(STEMS)).cast("int")))
    text = F.concat(F.lit("el "), F.array_join(F.slice(said, 1, (F.col("doc_id") % 9).cast("int")), " de la "))
    return _read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def match_stemmed(spark, sf_dir):
    """MATCH as it is by default: no stop words, stems."""
    e = Engine(spark)
    e.attach("said", _stem_table(spark, sf_dir))
    return e.query(f"SELECT doc_id, SCORE() AS score FROM said WHERE MATCH(text, '{STEMMED_QUERY}')").withColumn("score", F.round("score", 6))


#: Indexes that this session has made, by folder of tables: made once, then only read.
_MADE: dict[tuple, text_index.TextIndex] = {}


def text_indexed(spark: SparkSession, sf_dir: str) -> text_index.TextIndex:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MADE:
        _MADE[key] = text_index.build_text_index(_read(spark, sf_dir, "documents"), "doc_id", "text", _folder(spark))
    return _MADE[key]


def _indexed(method: str):
    def run(spark, sf_dir):
        found = text_index.search_text_index(spark, text_indexed(spark, sf_dir), Q.TEXT_QUERY, method)
        return found.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))

    return run


def rrf_fusion(spark, sf_dir):
    """Hybrid search: BM25 over the kept index and cosines over all vectors, fused by rank, with each hit's positions."""
    texts = _indexed("BM25")(spark, sf_dir).orderBy(F.desc("score"), "doc_id").limit(20).withColumnRenamed("doc_id", "doc")
    vectors = search.nearest(_read(spark, sf_dir, "embeddings"), Q._query_vector(spark, sf_dir), 20).select(F.col("vec_id").alias("doc"), F.round("score", 6).alias("score"))
    lists = {name: search.ranked(x, F.desc("score"), F.col("doc")).select("doc", "rank") for name, x in (("bm25", texts), ("vector", vectors))}
    fused = search.fuse(lists, "doc", 10)
    return fused.select("doc", F.round("rrf", 9).alias("rrf"), F.col("positions")["bm25"].alias("bm25_position"), F.col("positions")["vector"].alias("vector_position"))


def _tables(spark, sf_dir, statement: str, frame: DataFrame, name: str, order: str) -> Engine:
    """An engine with one managed table, filled."""
    e = Engine(spark, _folder(spark), parameters={"centro": Q.CENTRE})
    wrong = [r.error for r in e.sql(statement) if r.error]
    if wrong:
        raise ValueError(wrong[0])
    e.load_rows(name, frame, order)
    return e


def _vectors(spark, sf_dir) -> Engine:
    frame = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("v"))
    return _tables(spark, sf_dir, "CREATE TABLE img (id INT PRIMARY KEY, grp INT, v VECTOR(64)) USING BPLUS", frame, "img", "id")


def _similar(index: str, using: str):
    """A vector search over a stored index, filtered so that it has to look further."""

    def run(spark, sf_dir):
        e = _vectors(spark, sf_dir)
        wrong = [r.error for r in e.sql(index) if r.error]
        if wrong:
            raise ValueError(wrong[0])
        v = ", ".join(map(str, Q._query_vector(spark, sf_dir)))
        found = e.query(f"SELECT id, SIMILARITY_SCORE() AS s FROM img WHERE SIMILAR_TO(VECTOR({v}), K = 10) AND grp < 8 {using}")
        return found.select(F.col("id").cast("long").alias("vec_id"), F.round("s", 6).alias("score"))

    return run


def index_internals(spark, sf_dir):
    """What a cell index holds, and the files of a table in ranges of its key."""
    e = _vectors(spark, sf_dir)
    e.sql("CREATE INDEX cells ON img (v) USING IVF WITH (METRIC = cosine, LISTS = 8)")
    cells = e.index_report("cells").agg(F.count("*").alias("cells"), F.sum("rows").alias("rows"))
    files = e.layout_report("img").select(F.col("least").cast("int"), F.col("greatest").cast("int"), "rows").agg(F.sum("rows").alias("stored"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    return cells.crossJoin(files)


def spatial_tiles(spark, sf_dir):
    """A radius over a table laid out by tiles."""
    shops = Q.engine(spark, sf_dir).tables["shops"].frame.select(F.col("c_custkey").alias("id"), "place")
    e = _tables(spark, sf_dir, "CREATE TABLE shops (id INT PRIMARY KEY, place POINT)", shops, "shops", "id")
    return e.query("SELECT id FROM shops WHERE distancia(place, centro) <= 20000").select(F.col("id").cast("long").alias("c_custkey"))


def import_effect(spark, sf_dir):
    """A CSV file as a table: dense serial ids, ordered layout."""
    path = _folder(spark)
    _read(spark, sf_dir, "customer").write.option("header", True).csv(path)
    e = Engine(spark, _folder(spark))
    import_csv(e, path, "clients", "BPLUS")
    return e.query("SELECT COUNT(*), MIN(id), MAX(id), SUM(c_custkey) FROM clients")


def append_effect(spark, sf_dir):
    """Inserts that only add folders, until they are written as one."""
    e = Engine(spark, _folder(spark))
    e.sql("CREATE TABLE t (id INT PRIMARY KEY, n INT) USING BPLUS_CLUSTERED")
    for i in range(18):
        e.sql(f"INSERT INTO t VALUES ({2 * i}, {i}), ({2 * i + 1}, NULL)")
    e.sql("DELETE FROM t WHERE n = 3; UPDATE t SET n = 100 WHERE id = 5")
    return e.query("SELECT id, n FROM t")


def persons_effect(spark, sf_dir):
    """Persons registered, added to and removed; a failed registration leaves nothing."""
    people = Persons(Engine(spark, _folder(spark)), 3)
    first = people.register("  Ana   María ", {"a.jpg": [1, 0, 0], "b.jpg": [0, 1, 0]})
    second = people.register("Beto", {"c.jpg": [0, 0, 1]})
    people.add_photos(first, {"d.jpg": [1, 1, 0]})
    people.register("Caro", {"e.jpg": [1, 1, 1]})
    for wrong in (lambda: people.register("Beto", {"x.jpg": [0, 0, 1]}), lambda: people.register("Dora", {"x.jpg": [0, 1]}), lambda: people.add_photos(99, {})):
        try:
            wrong()
        except ValueError:
            continue
        raise AssertionError("a wrong change was taken")
    people.remove(second)
    out = people.engine.query("SELECT p.id, p.name, f.id, f.file FROM persons p JOIN photos f ON p.id = f.person_id")
    return out.toDF("person_id", "name", "photo_id", "file")


def _hits(spark, sf_dir, query: str = Q.TEXT_QUERY) -> DataFrame:
    found = search.match(_read(spark, sf_dir, "documents"), query, "doc_id", "text")
    return found.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


def metadata_filter(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source")
    return retrieval.with_metadata(_hits(spark, sf_dir).join(docs, "doc_id"), {"lang": "es", "source": None}, {"n_chars": 200}, {"n_chars": 3000}).select("doc_id", "score")


def source_join(spark, sf_dir):
    top = search.ranked(_hits(spark, sf_dir).orderBy(F.desc("score"), "doc_id").limit(10), F.desc("score"), F.col("doc_id"))
    found = retrieval.with_sources(top, _read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id", "doc_id")
    return found.select("number", "doc_id", F.col("source.lang").alias("lang"), F.col("source.source").alias("source"), F.col("source.n_chars").alias("n_chars"))


#: Questions, and the language that answers them.
QUESTIONS = {"en": "that the tion", "es": "que para ciones", "de": "nicht der ung"}


def precision_recall_10(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    found = None
    for lang, text in QUESTIONS.items():
        part = _hits(spark, sf_dir, text).orderBy(F.desc("score"), "doc_id").limit(10).select(F.lit(lang).alias("query"), F.col("doc_id").alias("item"))
        found = part if found is None else found.unionByName(part)
    relevant = docs.where(F.col("lang").isin(*QUESTIONS)).select(F.col("lang").alias("query"), F.col("doc_id").alias("item"))
    return retrieval.precision_recall(found, relevant, 10).select("query", "returned", "hits", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def tolerant_recall(spark, sf_dir):
    """Cells searched in full, and how pure in class the answers are."""
    vectors, asked = _read(spark, sf_dir, "embeddings"), Q._asked(spark, sf_dir)
    index, centres = search.ivf_index(vectors)
    found = search.ivf_many(index, centres, asked, 10, len(centres))
    told = retrieval.tolerant_recall(found, search.nearest_many(vectors, asked, 10))
    pure = retrieval.class_precision(found, vectors.select(F.col("vec_id").alias("id"), "label"), 10)
    return told.join(pure, "query_id").select("query_id", "recall", F.round("precision", 9).alias("precision"))


def ranking_check(spark, sf_dir):
    """The kept index ranks as the plain search does: no row differs."""
    top = lambda df: search.ranked(df.orderBy(F.desc("score"), "doc_id").limit(10), F.desc("score"), F.col("doc_id"))
    return retrieval.ranking_differences(top(_indexed("BM25")(spark, sf_dir)), top(_hits(spark, sf_dir)), "doc_id")


def question_sample(spark, sf_dir):
    return retrieval.sampled_questions(_read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50, 7)


def time_statistics(spark, sf_dir):
    found = retrieval.time_statistics(_read(spark, sf_dir, "events"), "event_type", "value")
    return found.select("event_type", "n", F.round("mean_ms", 6).alias("mean_ms"), "median_ms", "p95_ms")


def evaluation_levels(spark, sf_dir):
    """Ranks of the first neighbour of the own label (a chunk) and of the own fifth of labels (its article)."""
    vectors = _read(spark, sf_dir, "embeddings")
    found = search.nearest_many(vectors, Q._asked(spark, sf_dir), 11).where("id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    own = Q._asked(spark, sf_dir).select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    hits = found.withColumn("place", place).where("place <= 10").join(vectors.select(F.col("vec_id").alias("id"), "label"), "id").join(own, "query_id")
    ranks = hits.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("own"), F.col("place"))).alias("chunk"), F.min(F.when(F.col("label") % 5 == F.col("own") % 5, F.col("place"))).alias("article"))
    told = retrieval.evaluated(own.join(ranks, "query_id", "left").withColumn("mode", F.lit("vector")), "mode", {"chunk": "chunk", "article": "article"})
    return told.select("mode", "questions", *[F.round(c, 9).alias(c) for c in told.columns[2:]])


#: Cosine from which on a photo is taken for a person's.
THRESHOLD = 0.38


def identify_flow(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings").withColumnRenamed("label", "person_id")
    persons = vectors.select("person_id").distinct().withColumn("name", F.concat(F.lit("p"), F.col("person_id").cast("string")))
    found = identify.identified(Q._asked(spark, sf_dir), vectors, persons, THRESHOLD)
    return found.select("query_id", "person", "name", F.round("similarity", 6).alias("similarity"), "known")


def best_threshold(spark, sf_dir):
    return identify.best_threshold(Q.threshold_curve(spark, sf_dir))


def top1_agreement(spark, sf_dir):
    vectors, asked = _read(spark, sf_dir, "embeddings"), Q._asked(spark, sf_dir)
    index, centres = search.ivf_index(vectors)
    ways = {"cells": search.ivf_many(index, centres, asked, 1, len(centres)), "all": search.nearest_many(vectors, asked, 1)}
    answers = None
    for name, found in ways.items():
        part = found.select(F.lit(name).alias("method"), "query_id", F.col("id").alias("first"))
        answers = part if answers is None else answers.unionByName(part)
    return retrieval.agreement(answers, "method", "query_id", "first", "cells", "all")


def cache_simulation(spark, sf_dir):
    """A thousand events, answered by a memory of frequent persons or by the search."""
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 20 > 0, F.col("vec_id") % 40).alias("label"))
    events = identify.simulated_events(vectors, "vec_id", "label")
    run = identify.replayed(events, vectors.select(F.col("vec_id").alias("query_id"), F.col("label").alias("person")), vectors, 0.9)
    return identify.replay_statistics(run, vectors)


def face_corpus(spark, sf_dir):
    """Files named by person and number, as an image corpus has them."""
    path = _folder(spark)
    person = F.concat(F.lit("Ann__Of_"), F.col("c_nationkey").cast("string"))
    files = _read(spark, sf_dir, "customer").select(F.concat(person, F.lit("_"), F.lpad("c_custkey", 6, "0"), F.lit(".jpg")).alias("filename"), F.struct(F.col("c_name").cast("binary").alias("bytes"), F.lit(None).cast("string").alias("path")).alias("image"))
    files.write.parquet(path)
    return read_faces(spark, path).groupBy("person", "name").agg(F.count("*").alias("n"), F.sum(F.length("image")).alias("bytes"))


def dense_numbers(spark, sf_dir):
    """Dense numbers along a column, in blocks."""
    return numbered(_read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select("o_orderkey"), "o_orderkey", "place", 1000)


QUERIES = {f.__name__: f for f in (match_stemmed, rrf_fusion, index_internals, spatial_tiles, import_effect, append_effect, persons_effect, metadata_filter, source_join, precision_recall_10, tolerant_recall, ranking_check, question_sample, time_statistics, evaluation_levels, identify_flow, best_threshold, top1_agreement, cache_simulation, face_corpus, dense_numbers)}
QUERIES |= {
    "bm25_indexed": _indexed("BM25"),
    "tfidf_indexed": _indexed("TF_IDF"),
    "similar_ivf_index": _similar("CREATE INDEX cells ON img (v) USING IVF WITH (METRIC = cosine, LISTS = 8)", "USING IVF WITH PROBES = 8"),
    "similar_hnsw_index": _similar("CREATE INDEX graph ON img (v) USING HNSW WITH (METRIC = cosine)", "USING HNSW WITH EF_SEARCH = 4096"),
    "similar_no_using": _similar("CREATE INDEX cells ON img (v) USING IVF WITH (METRIC = euclidean, LISTS = 4)", ""),
}

_LISTED = ", ".join(f"'{w}'" for w in STEMS)
_PAIRS = ", ".join(f"('{w}', '{s}')" for w, s in STEMS.items())
_ASKED = {"torer": 1, "torr": 1, "chequ": 1, "chic": 1, "torne": 1, "tor": 1}
_STEM_TERMS = f"terms AS (SELECT doc_id, s.stem AS term FROM (SELECT doc_id, unnest(regexp_extract_all(lower({_TEXTS}), '[a-záéíóúñü]+')) AS t FROM documents, (SELECT [{_LISTED}] AS w)) x JOIN (VALUES {_PAIRS}) s(word, stem) ON x.t = s.word), post AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL), len AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS len FROM documents d LEFT JOIN post p ON p.doc_id = d.doc_id GROUP BY d.doc_id), corpus AS (SELECT count(*)::DOUBLE AS n, avg(len) AS avgdl FROM len), df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"
_TOP = lambda sql, k=10: f"(SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({sql}) QUALIFY rank <= {k})"
_FIRST = f"(SELECT query_id, vec_id, label, own, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM (SELECT k.query_id, k.vec_id, k.rank, e.label, o.label AS own FROM ({Q._knn('cosine', k=11)}) k JOIN embeddings e ON e.vec_id = k.vec_id JOIN embeddings o ON o.vec_id = k.query_id WHERE k.vec_id <> k.query_id))"


def _bm25_of(words: str) -> str:
    asked = ", ".join(f"'{t}'" for t in words.split())
    return Q._bm25(1.2, 0.75).replace(f"IN ({Q._IN})", f"IN ({asked})")


def _levels() -> str:
    cuts = lambda c: ", ".join(f"round(avg(CASE WHEN {c} <= {n} THEN 1.0e0 ELSE 0 END), 9) AS recall_{n}_{c}" for n in (1, 5, 10))
    return f"WITH h AS (SELECT query_id, min(CASE WHEN label = own THEN place END) AS chunk, min(CASE WHEN label % 5 = own % 5 THEN place END) AS article FROM {_FIRST} WHERE place <= 10 GROUP BY query_id), r AS (SELECT chunk, article FROM (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0) q LEFT JOIN h ON h.query_id = q.vec_id) SELECT 'vector' AS mode, count(*) AS questions, round(avg(coalesce(1.0e0 / chunk, 0)), 9) AS mrr_chunk, {cuts('chunk')}, round(avg(coalesce(1.0e0 / article, 0)), 9) AS mrr_article, {cuts('article')} FROM r"


ORACLES = {
    "match_stemmed": f"WITH {_STEM_TERMS} SELECT p.doc_id, round(sum(ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / avgdl))), 6) AS score FROM post p JOIN len USING (doc_id) JOIN df USING (term) CROSS JOIN corpus WHERE term IN ({', '.join(repr(t) for t in _ASKED)}) GROUP BY p.doc_id",
    "bm25_indexed": Q._bm25(1.2, 0.75),
    "tfidf_indexed": Q.ORACLES["tfidf"],
    "similar_ivf_index": Q.ORACLES["similar_without_index"],
    "similar_hnsw_index": Q.ORACLES["similar_without_index"],
    "similar_no_using": Q.ORACLES["similar_without_index"],
    "index_internals": "SELECT 8::BIGINT AS cells, count(*) AS rows, count(*) AS stored, min(vec_id)::INT AS least, max(vec_id)::INT AS greatest FROM embeddings",
    "spatial_tiles": Q.ORACLES["radius_haversine"],
    "import_effect": "SELECT count(*) AS conteo, 1 AS min_id, count(*)::INT AS max_id, sum(c_custkey)::BIGINT AS sum_c_custkey FROM customer",
    "append_effect": "SELECT id::INT AS id, CASE WHEN id = 5 THEN 100 WHEN id % 2 = 0 THEN (id // 2)::INT END AS n FROM (SELECT unnest(range(36)) AS id) WHERE id <> 6",
    "persons_effect": "SELECT * FROM (VALUES (1, 'Ana María', 1, 'a.jpg'), (1, 'Ana María', 2, 'b.jpg'), (1, 'Ana María', 4, 'd.jpg'), (3, 'Caro', 5, 'e.jpg')) t(person_id, name, photo_id, file)",
    "metadata_filter": f"SELECT doc_id, score FROM ({Q._bm25(1.2, 0.75)}) JOIN documents USING (doc_id) WHERE lang = 'es' AND n_chars BETWEEN 200 AND 3000",
    "source_join": f"SELECT rank::INT AS number, doc_id, lang, source, n_chars FROM {_TOP(Q._bm25(1.2, 0.75))} JOIN documents USING (doc_id)",
    "precision_recall_10": " UNION ALL ".join(f"SELECT '{l}' AS query, count(*) AS returned, count_if(lang = '{l}')::BIGINT AS hits, round(count_if(lang = '{l}') / 10.0e0, 9) AS precision, round(count_if(lang = '{l}') / (SELECT count(*)::DOUBLE FROM documents WHERE lang = '{l}'), 9) AS recall FROM {_TOP(_bm25_of(t))} JOIN documents USING (doc_id)" for l, t in QUESTIONS.items()),
    "tolerant_recall": f"SELECT query_id, 1.0e0 AS recall, round(count_if(e.label = o.label) / 10.0e0, 9) AS precision FROM ({Q._knn('cosine')}) k JOIN embeddings e ON e.vec_id = k.vec_id JOIN embeddings o ON o.vec_id = k.query_id GROUP BY query_id",
    "ranking_check": "SELECT doc_id AS item, '' AS why FROM documents WHERE false",
    "question_sample": "SELECT doc_id, lang FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50",
    "time_statistics": "WITH t AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_ms, max(CASE WHEN place = greatest(1, least(n, round_even(0.5e0 * n + 0.5e0, 0))) THEN value END) AS median_ms, max(CASE WHEN place = greatest(1, least(n, round_even(0.95e0 * n + 0.5e0, 0))) THEN value END) AS p95_ms FROM t GROUP BY event_type",
    "evaluation_levels": _levels(),
    "identify_flow": f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS place FROM (SELECT q.vec_id AS query_id, e.vec_id, e.label, {Q._SIMILAR['cosine'][0]} AS d FROM (SELECT *, {Q._V} AS v FROM embeddings) e, (SELECT *, {Q._V} AS v FROM embeddings WHERE vec_id % 100 = 0) q WHERE e.vec_id <> q.vec_id)), b AS (SELECT query_id, label, max(1 - d) AS s FROM k WHERE place <= 5 GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, label) AS r FROM b) SELECT query_id, CASE WHEN s >= {THRESHOLD}e0 THEN label END AS person, CASE WHEN s >= {THRESHOLD}e0 THEN 'p' || label END AS name, round(s, 6) AS similarity, s >= {THRESHOLD}e0 AS known FROM f WHERE r = 1",
    "best_threshold": f"SELECT * FROM ({Q.ORACLES['threshold_curve']}) ORDER BY accept_rate + reject_rate DESC, threshold LIMIT 1",
    "top1_agreement": "SELECT 1.0e0 AS agreement",
    "face_corpus": "SELECT 'Ann__Of_' || c_nationkey AS person, 'Ann Of ' || c_nationkey AS name, count(*) AS n, sum(length(c_name))::BIGINT AS bytes FROM customer GROUP BY c_nationkey",
    "dense_numbers": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE o_orderkey % 3 = 0",
}
