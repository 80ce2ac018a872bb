"""Readers of two kinds of corpora: articles (a list as JSON lines, a file of words each) and faces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.operators.gallery import numbered
from quillon.operators.pages import clean_pages

ARTICLE = "id string, publication_date string, pdf_url string, abstract string"


def read_articles(spark: SparkSession, listing: str, words: str, limit: int | None = None) -> DataFrame:
    """``id, code, country, published, year, url_pdf, abstract, text`` of the articles in a listing.

    ``words`` is a folder of files ``<code>.txt`` of positioned words. Articles without a file,
    or whose pages hold no running text, are left out; the others are numbered in the order of
    the listing. With a ``limit`` every so manieth line is taken, evenly over the listing.
    """
    lines = spark.read.text(listing).select(F.monotonically_increasing_id().alias("_line"), F.from_json("value", ARTICLE).alias("a"))
    placed = numbered(lines, "_line", "_at").select("_at", "a.*")
    if limit:
        n = placed.count()
        if limit < n:
            # line floor(i * n / limit) for some i: the first whole step at or after it
            step = F.lit(n / limit)
            turn = F.ceil((F.col("_at") - 1) / step)
            placed = placed.where((F.floor(turn * step) == F.col("_at") - 1) & (turn < limit))
    files = spark.read.text(words, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("_code"), F.col("value").alias("_content"))
    read = clean_pages(placed.join(files, F.col("id") == F.col("_code")), "_content").where("text <> ''")
    published = F.replace("publication_date", F.lit("."), F.lit("-"))
    found = read.select("_at", F.col("id").alias("code"), F.substring_index("id", "_", 1).alias("country"), published.alias("published"), F.substring(published, 1, 4).cast("int").alias("year"), F.col("pdf_url").alias("url_pdf"), "abstract", "text")
    return numbered(found, "_at", "id").select("id", "code", "country", "published", "year", "url_pdf", "abstract", "text")


def read_faces(spark: SparkSession, path: str) -> DataFrame:
    """``file, person, name, image`` of Parquet files with ``filename`` and ``image.bytes``.

    A person is the file's name up to its last ``_``; its name has blanks for the others.
    """
    person = F.regexp_replace("filename", "_[^_]*$", "")
    name = F.trim(F.regexp_replace(F.replace(person, F.lit("_"), F.lit(" ")), r"\s+", " "))
    return spark.read.parquet(path).select(F.col("filename").alias("file"), person.alias("person"), name.alias("name"), F.col("image.bytes").alias("image"))
