"""Flows over a gallery of vectors that belong to persons, and codebooks.

Numbers are dense without a single-task sort: rows are counted by blocks of their order, and
the counts of the blocks, one row each, are summed up.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

BLOCK = 1_000_000


def numbered(df: DataFrame, order: str, name: str = "id", block: int = BLOCK) -> DataFrame:
    """Dense numbers from 1 along ``order``, a column of distinct whole numbers."""
    cut = df.withColumn("_block", F.floor(F.col(order) / block))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("_block").count().select("_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy(order))
    return cut.withColumn("_place", place).join(starts, "_block").withColumn(name, F.col("_place") + F.col("_start")).drop("_block", "_place", "_start")


def enrolled(photos: DataFrame, origin: str, person: str, order: str, detected: str) -> tuple[DataFrame, DataFrame]:
    """Persons, numbered in order of appearance by origin and name, and their photos.

    Photos in which nobody was detected are left out; a null name or origin is one like others.
    """
    seen = photos.where(F.col(detected))
    people = numbered(seen.groupBy(origin, person).agg(F.min(order).alias("_first")), "_first", "person_id")
    a, b = seen.alias("a"), people.select("person_id", F.col(origin).alias("_origin"), F.col(person).alias("_person")).alias("b")
    same = F.col(f"a.{origin}").eqNullSafe(F.col("b._origin")) & F.col(f"a.{person}").eqNullSafe(F.col("b._person"))
    return people.drop("_first"), numbered(a.join(b, same).drop("_origin", "_person"), order, "photo_id")


def split_known(photos: DataFrame, person: str, photo: str, n: int, tests: int = 5, unknown: int = 1000, seed: int = 0) -> DataFrame:
    """``photo, person, role``: of persons with over ``n`` photos ``n`` to ``register`` and up
    to ``tests`` to ``test``; of persons with one photo up to ``unknown`` as ``unknown``.

    The draw is by a hash of photo and seed, so reruns agree.
    """
    draw = F.xxhash64(F.lit(seed), F.col(photo))
    sizes = photos.groupBy(person).agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy(person).orderBy(draw, photo))
    # the limit on the place reaches below the shuffle: a person with many photos sends few
    first = photos.select(photo, person).withColumn("_place", place).where(F.col("_place") <= n + tests).join(sizes, person)
    role = F.when(F.col("_place") <= n, "register").otherwise("test")
    known = first.where(F.col("_n") > n).select(photo, person, role.alias("role"))
    single = first.where(F.col("_n") == 1).orderBy(draw, photo).limit(unknown)
    return known.unionByName(single.where(F.col("_n") <= n).select(photo, person, F.lit("unknown").alias("role")))


def frequent_means(seen: DataFrame, person: str, vector: str, top: int = 20) -> DataFrame:
    """The ``top`` persons seen most often, ties by id, with their normalised mean vector."""
    most = seen.where(F.col(person).isNotNull()).groupBy(person).agg(F.count("*").alias("n")).orderBy(F.desc("n"), person).limit(top)
    parts = seen.join(F.broadcast(most), person).select(person, "n", F.posexplode(vector).alias("at", "x"))
    sums = parts.groupBy(person, "n", "at").agg(F.sum(F.col("x").cast("double")).alias("x"))
    whole = sums.groupBy(person, "n").agg(F.sort_array(F.collect_list(F.struct("at", "x")))["x"].alias("sum"))
    length = F.sqrt(F.aggregate("sum", F.lit(0.0), lambda s, x: s + x * x))
    return whole.select(person, "n", F.transform("sum", lambda x: x / F.greatest(length, F.lit(1e-12))).alias("mean"))


def recognised(means: DataFrame, vector: list[float], threshold: float, person: str) -> DataFrame:
    """The person whose mean is nearest to a unit vector; no row under the threshold."""
    dot = F.aggregate(F.zip_with("mean", F.array(*[F.lit(float(x)) for x in vector]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return means.select(person, dot.alias("similarity")).orderBy(F.desc("similarity"), person).limit(1).where(F.col("similarity") >= threshold)


def reservoir(rows: DataFrame, key: str, size: int = 100_000, seed: int = 0) -> DataFrame:
    """A uniform sample of ``size`` rows: those of smallest hashed priority."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(size)


def _codebook(descriptor: str, centroids: list[list[float]]) -> dict:
    body = {"format_version": 1, "descriptor_id": descriptor, "dimension": len(centroids[0]), "centroids": [[float(x) for x in c] for c in centroids]}
    text = json.dumps(body, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return body | {"vocabulary_id": hashlib.sha256(text.encode()).hexdigest()}


def save_codebook(spark: SparkSession, path: str, descriptor: str, centroids: list[list[float]]) -> str:
    """Write a codebook through Spark; returns its id. A path that exists is an error."""
    book = _codebook(descriptor, centroids)
    spark.sql("select 1").select(F.lit(json.dumps(book, allow_nan=False)).alias("value")).write.text(path)
    return book["vocabulary_id"]


def load_codebook(spark: SparkSession, path: str) -> dict:
    """Read a codebook; its id has to follow from its content."""
    book = json.loads(spark.read.text(path).first()["value"])
    if book != _codebook(book["descriptor_id"], book["centroids"]):
        raise ValueError("the codebook does not have the id of its content")
    return book
