"""Queries over imports, changes, page clean-up and gallery flows, with their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.operators import gallery, pages
from quillon.sources.csv_table import read_csv

from .engine import Engine


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """A new path below the folder that the cluster shares; a session on one machine may have none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the cluster shares")
    base = base or tempfile.mkdtemp()
    return f"{base}/flow-{uuid.uuid4().hex}"


def csv_infer(spark, sf_dir):
    path = _folder(spark)
    _read(spark, sf_dir, "customer").write.option("header", True).csv(path)
    rows, kinds = read_csv(spark, path)
    return rows.select(*rows.columns[:3], F.round(F.col("c_acctbal").cast("double"), 1).alias("acctbal"), "c_mktsegment", F.lit(" ".join(kinds.values())).alias("kinds"))


def _nations(spark: SparkSession, sf_dir: str, change: str) -> DataFrame:
    rows = _read(spark, sf_dir, "nation").collect()  # a small dimension
    values = ", ".join(f"({r['n_nationkey']}, '{r['n_name']}', {r['n_regionkey']})" for r in rows)
    e = Engine(spark, _folder(spark))
    done = e.sql(f"CREATE TABLE nations (id INT PRIMARY KEY, name VARCHAR(40), region INT); INSERT INTO nations VALUES {values}; {change}")
    if wrong := [r.error for r in done if r.error]:
        raise ValueError(wrong[0])
    return e.query("SELECT id, name, region FROM nations")


def _changed(change: str):
    return lambda spark, sf_dir: _nations(spark, sf_dir, change)


def text_postings(spark, sf_dir):
    terms = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-záéíóúñü]+)")))
    return _read(spark, sf_dir, "documents").select("doc_id", terms.alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def dehyphenate(spark, sf_dir):
    broken = F.regexp_replace("text", "([aeiou]) ", "$1- ")
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(pages.dehyphenated(broken)).alias("text_md5"))


def band_cleanup(spark, sf_dir):
    """Documents set as pages of 100 words, ten to a line, under a repeated head and a number."""
    words = F.filter(F.split("text", r"[^\p{L}]+"), lambda w: w != "")
    word = lambda text, y, page: F.concat_ws("\t", text, F.lit("0"), y.cast("string"), F.lit("9"), F.lit("9"), F.lit("f"), F.lit("1000"), page.cast("string"))
    page = lambda i: F.floor(i / 100)
    body = F.transform("w", lambda w, i: F.concat(F.when(i % 100 == 0, F.concat(word(F.lit("Title"), F.lit(40), page(i)), F.lit("\n"), word(F.concat(F.lit("p"), page(i).cast("string")), F.lit(960), page(i)), F.lit("\n"))).otherwise(""), word(w, F.lit(100) + F.floor(i % 100 / 10) * 50, page(i))))
    content = _read(spark, sf_dir, "documents").select("doc_id", words.alias("w")).select("doc_id", F.array_join(body, "\n").alias("content"))
    return pages.clean_pages(content).select("doc_id", F.md5("text").alias("text_md5"))


def gallery_build(spark, sf_dir):
    photos = _read(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 4 > 0, "set").otherwise("own").alias("origin"), F.col("label").alias("person"), (F.col("vec_id") % 5 > 0).alias("detected"))
    return gallery.enrolled(photos, "origin", "person", "vec_id", "detected")[1].select("vec_id", "person_id", "photo_id")


def split_known(spark, sf_dir):
    photos = _read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 97).alias("person"))
    return gallery.split_known(photos, "person", "c_custkey", 3).groupBy("person", "role").agg(F.count("*").alias("n"))


def cache_means(spark, sf_dir):
    found = gallery.frequent_means(_read(spark, sf_dir, "embeddings"), "label", "embedding", 5)
    return found.select("label", "n", F.round(F.element_at("mean", 1), 6).alias("first"), F.round(F.element_at("mean", 64), 6).alias("last"))


FLOWS = {f.__name__: f for f in (csv_infer, text_postings, dehyphenate, band_cleanup, gallery_build, split_known, cache_means)}
QUERIES = FLOWS | {
    "dml_insert_effect": _changed("INSERT INTO nations (id) VALUES (100), (101)"),
    "dml_update_effect": _changed("UPDATE nations SET name = 'x', region = NULL WHERE region = 1"),
    "dml_delete_effect": _changed("DELETE FROM nations WHERE region > 2"),
}

_NATIONS = "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation"
#: Documents as words; the clean text has them all, and the head where a single page has it.
_WORDS = r"(SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\p{L}]+'), lambda x: x <> '') AS w FROM documents)"
ORACLES = {
    "csv_infer": "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal::FLOAT::DOUBLE, 1) AS acctbal, c_mktsegment, 'INT STRING INT FLOAT STRING' AS kinds FROM customer",
    "dml_insert_effect": f"{_NATIONS} UNION ALL SELECT unnest([100, 101]), NULL, NULL",
    "dml_update_effect": "SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN 'x' ELSE n_name END AS name, nullif(n_regionkey, 1) AS region FROM nation",
    "dml_delete_effect": f"{_NATIONS} WHERE n_regionkey <= 2",
    "text_postings": "SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-záéíóúñü]+')) AS term FROM documents) GROUP BY ALL",
    "dehyphenate": r"SELECT doc_id, md5(regexp_replace(regexp_replace(b, '(\S)- (\p{Ll})', '\1\2', 'g'), '(\S)- (\p{Ll})', '\1\2', 'g')) AS text_md5 FROM (SELECT doc_id, regexp_replace(text, '([aeiou]) ', '\1- ', 'g') AS b FROM documents)",
    "band_cleanup": f"SELECT doc_id, md5(array_to_string(w, ' ')) AS text_md5 FROM (SELECT doc_id, CASE WHEN len(w) BETWEEN 1 AND 100 THEN list_concat(['Title', 'p0'], w) ELSE w END AS w FROM {_WORDS})",
    "gallery_build": "WITH s AS (SELECT vec_id, CASE WHEN vec_id % 4 > 0 THEN 'set' ELSE 'own' END AS origin, label FROM embeddings WHERE vec_id % 5 > 0), f AS (SELECT *, min(vec_id) OVER (PARTITION BY origin, label) AS f FROM s) SELECT vec_id, dense_rank() OVER (ORDER BY f) AS person_id, row_number() OVER (ORDER BY vec_id) AS photo_id FROM f",
    "split_known": "WITH s AS (SELECT c_custkey % 97 AS person, count(*) AS n FROM customer GROUP BY 1) SELECT person, 'register' AS role, 3 AS n FROM s WHERE n > 3 UNION ALL SELECT person, 'test', least(n - 3, 5) FROM s WHERE n > 3 UNION ALL SELECT person, 'unknown', 1 FROM s WHERE n = 1",
    "cache_means": "WITH t AS (SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label ORDER BY n DESC, label LIMIT 5), p AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS place FROM embeddings), s AS (SELECT label, place, sum(x) AS x FROM p GROUP BY ALL), l AS (SELECT label, sqrt(sum(x * x)) AS l FROM s GROUP BY label) SELECT t.label, t.n, round(max(CASE WHEN place = 1 THEN x END) / max(l), 6) AS first, round(max(CASE WHEN place = 64 THEN x END) / max(l), 6) AS last FROM t JOIN s USING (label) JOIN l USING (label) GROUP BY t.label, t.n",
}
