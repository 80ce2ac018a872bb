"""A full-text index that is kept: postings on files, pruned by bucket and sorted by term.

A posting carries what a score needs (how often the term stands in the text, how many texts
hold it, the text's number of words and its TF-IDF length), so that a search reads the
postings of its terms and nothing else.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quillon.functions.text import query_terms, terms

from .search import _by_term, _saturated

#: Postings in a bucket, about, and buckets at most.
BUCKET, BUCKETS = 4_000_000, 4096


@dataclass
class TextIndex:
    path: str
    buckets: int
    n: int
    avgdl: float

    def known(self) -> dict:
        return asdict(self)


def build_text_index(docs: DataFrame, id_col: str, text_col: str, path: str, **options) -> TextIndex:
    """Index every text that is not null; empty ones count, but have no posting.

    Texts are read once: their bags are written beside the index, and gone when it is made.
    """
    spark = docs.sparkSession
    terms(docs, id_col, text_col, **options).write.parquet(f"{path}-bags")
    bag = spark.read.parquet(f"{path}-bags")
    n = docs.where(F.col(text_col).isNotNull()).count()
    words = bag.agg(F.sum("tf")).first()[0] or 0
    buckets = max(1, min(BUCKETS, math.ceil(words / BUCKET)))
    held = bag.join(bag.groupBy("term").agg(F.count("*").alias("df")), "term")
    weight = F.log10(1 + F.col("tf")) * F.log10(F.lit(float(max(n, 1))) / F.col("df"))
    sized = held.groupBy("doc").agg(F.sum("tf").alias("len"), F.sqrt(F.sum(weight * weight)).alias("norm"))
    postings = held.join(sized, "doc").withColumn("bucket", F.pmod(F.crc32("term"), F.lit(buckets)).cast("int"))
    # a term in most texts fills tasks of its own: rows of a bucket are dealt by document too
    dealt = postings.repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(max(1, min(64, math.ceil(words / BUCKET))))))
    dealt.sortWithinPartitions("bucket", "term", "doc").write.partitionBy("bucket").parquet(path)
    spark.createDataFrame([], "gone int").write.mode("overwrite").parquet(f"{path}-bags")
    return TextIndex(path, buckets, n, (words / n if n else 0.0) or 1.0)


def search_text_index(spark: SparkSession, index: TextIndex, query: str, method: str = "BM25", k1: float = 1.2, b: float = 0.75, doc_type: T.DataType | None = None, **options) -> DataFrame:
    """``doc, score`` as ``match`` gives them, from the postings of the asked terms."""
    asked = query_terms(query, **options)
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("doc", doc_type or T.LongType()), T.StructField("tf", T.LongType()), T.StructField("df", T.LongType()), T.StructField("len", T.LongType()), T.StructField("norm", T.DoubleType()), T.StructField("bucket", T.IntegerType())])
    nothing = spark.createDataFrame([], T.StructType([schema["doc"], T.StructField("score", T.DoubleType())]))
    if not asked or not index.n:
        return nothing
    where = sorted({zlib.crc32(t.encode()) % index.buckets for t in asked})
    hits = spark.read.schema(schema).parquet(index.path).where(F.col("bucket").isin(*where) & F.col("term").isin(*asked))
    n = float(index.n)
    often = _by_term({t: float(c) for t, c in asked.items()})
    if method == "BM25":
        part = often * F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * _saturated(F.col("tf"), F.col("len"), index.avgdl, k1, b)
        return hits.groupBy("doc").agg(F.sum(part).alias("score")).where("score > 0")
    frequencies = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.first("df").alias("df")).collect()}
    wanted = {t: math.log10(1 + asked[t]) * math.log10(n / df) for t, df in frequencies.items() if df < n}
    if not wanted:
        return nothing
    norm = math.sqrt(sum(w * w for w in wanted.values()))
    weight = F.log10(1 + F.col("tf")) * F.log10(n / F.col("df")) * _by_term(wanted)
    scored = hits.where(F.col("term").isin(*wanted)).groupBy("doc").agg((F.sum(weight) / (F.first("norm") * norm)).alias("score"))
    return scored.where("score > 0")


