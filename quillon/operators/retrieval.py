"""Retrieval around a search: filters on metadata, sources of hits, questions, and how good answers are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Up to how many equal scores two rankings may differ by, relative to the score.
TIE = 1e-9


def with_metadata(frame: DataFrame, equal: dict[str, object] | None = None, low: dict[str, object] | None = None, high: dict[str, object] | None = None) -> DataFrame:
    """Rows that meet all given conditions; conditions that are None or '' ask for nothing.

    ``equal`` names columns and values, ``low`` and ``high`` bounds that belong to the range.
    """
    given = lambda d: {k: v for k, v in (d or {}).items() if v not in (None, "")}
    conditions: list[Column] = [F.col(k) == v for k, v in given(equal).items()]
    conditions += [F.col(k) >= v for k, v in given(low).items()] + [F.col(k) <= v for k, v in given(high).items()]
    return frame.where(reduce(lambda a, b: a & b, conditions)) if conditions else frame


def with_sources(hits: DataFrame, sources: DataFrame, key: str, source_key: str, order: str = "rank") -> DataFrame:
    """Hits (a top-k) numbered from 1 as ``number``, with the columns of their source as the struct ``source``.

    A hit without a source has a null one. The hits are the small side: sources are only read.
    """
    numbered = hits.withColumn("number", F.row_number().over(Window.orderBy(order)))
    named = sources.select(F.col(source_key).alias("_source"), F.struct(*sources.columns).alias("source"))
    found = named.join(F.broadcast(numbered.select(F.col(key).alias("_wanted")).distinct()), F.col("_source") == F.col("_wanted"), "left_semi")
    return numbered.join(found, F.col(key) == F.col("_source"), "left").drop("_source")


def sampled_questions(rows: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows (all, if fewer) in the order of a seeded hash of their id: reruns ask the same."""
    return rows.withColumn("_turn", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))).orderBy("_turn", id_col).limit(n).drop("_turn")


def precision_recall(found: DataFrame, relevant: DataFrame, k: int, query: str = "query", item: str = "item") -> DataFrame:
    """``query, returned, hits, precision, recall`` of up to ``k`` different items found for each query.

    Precision is of ``k`` even where fewer are found. Queries are those of ``relevant``; one
    without an answer has zeros.
    """
    wanted = relevant.select(query, item).distinct()
    sizes = wanted.groupBy(query).agg(F.count("*").alias("n"))
    answered = found.select(query, item).distinct()
    hits = answered.join(wanted.withColumn("hit", F.lit(1)), [query, item], "left").groupBy(query).agg(F.count("*").alias("returned"), F.count("hit").alias("hits"))
    every = sizes.join(hits, query, "left").fillna(0, ["returned", "hits"])
    return every.select(query, "returned", "hits", (F.col("hits") / k).alias("precision"), (F.col("hits") / F.col("n")).alias("recall"))


def tolerant_recall(found: DataFrame, exact: DataFrame, query: str = "query_id", slack: float = 1e-5) -> DataFrame:
    """``query, recall``: the share of the exact answer's size that lies within its last distance.

    A row as near as the last exact one is as good an answer, whichever of them was listed.
    """
    last = exact.groupBy(query).agg(F.max("distance").alias("last"), F.count("*").alias("n"))
    near = found.select(query, "distance").join(last, query).groupBy(query).agg(F.count_if(F.col("distance") <= F.col("last") + slack).alias("near"))
    return last.join(near, query, "left").select(query, (F.coalesce("near", F.lit(0)) / F.col("n")).alias("recall"))


def class_precision(found: DataFrame, classes: DataFrame, k: int, query: str = "query_id", item: str = "id", key: str = "id", label: str = "label") -> DataFrame:
    """``query, precision``: the share of ``k`` whose class is the query's own."""
    of_item = classes.select(F.col(key).alias(item), F.col(label).alias("_label"))
    of_query = classes.select(F.col(key).alias(query), F.col(label).alias("_own"))
    return found.join(of_item, item).join(of_query, query).groupBy(query).agg((F.count_if(F.col("_label") == F.col("_own")) / k).alias("precision"))


def ranking_differences(found: DataFrame, expected: DataFrame, item: str = "doc", score: str = "score", rank: str = "rank") -> DataFrame:
    """Rows in which two rankings differ beyond ties; none if they say the same.

    Scores at each rank have to agree up to TIE. Items have to agree above the last expected
    score; those with the last score may be others, for they are tied.
    """
    a = found.select(F.col(rank).alias("rank"), F.col(score).alias("found"), F.col(item).alias("found_item"))
    b = expected.select(F.col(rank).alias("rank"), F.col(score).alias("expected"), F.col(item).alias("expected_item"))
    slack = TIE * F.greatest(F.lit(1.0), F.abs("expected"))
    scores = a.join(b, "rank", "full").where(F.col("found").isNull() | F.col("expected").isNull() | (F.abs(F.col("found") - F.col("expected")) > slack))
    least = F.broadcast(b.agg(F.min("expected").alias("least")))
    above = lambda df, s: df.join(least, s > F.col("least") + TIE * F.greatest(F.lit(1.0), F.abs("least")))
    x, y = above(a, F.col("found")).select(F.col("found_item").alias("item")), above(b, F.col("expected")).select(F.col("expected_item").alias("item"))
    items = x.exceptAll(y).withColumn("why", F.lit("not expected")).unionByName(y.exceptAll(x).withColumn("why", F.lit("not found")))
    told = scores.select(F.coalesce("found_item", "expected_item").alias("item"), F.lit("another score").alias("why"))
    return told.unionByName(items)


def time_statistics(times: DataFrame, group: str, ms: str) -> DataFrame:
    """``group, n, mean_ms, median_ms, p95_ms``; percentiles are values that were measured.

    The value at place ``round(p * n + 0.5)`` (half to even) in ascending order, within 1 and n.
    """
    some = times.where(F.col(ms).isNotNull())
    whole = Window.partitionBy(group)
    placed = some.withColumn("_n", F.count("*").over(whole)).withColumn("_at", F.row_number().over(whole.orderBy(ms)))

    def value(p: float, name: str) -> Column:
        at = F.greatest(F.lit(1), F.least(F.col("_n"), F.bround(F.lit(p) * F.col("_n") + 0.5).cast("long")))
        return F.max(F.when(F.col("_at") == at, F.col(ms))).alias(name)

    return placed.groupBy(group).agg(F.count("*").alias("n"), F.avg(ms).alias("mean_ms"), value(0.5, "median_ms"), value(0.95, "p95_ms"))


def agreement(answers: DataFrame, method: str, question: str, first: str, of: str, reference: str) -> DataFrame:
    """``agreement``: the share of questions to which two methods give the same first answer."""
    a = answers.where(F.col(method) == of).select(question, F.col(first).alias("_a"))
    b = answers.where(F.col(method) == reference).select(question, F.col(first).alias("_b"))
    return a.join(b, question).agg(F.avg(F.col("_a").eqNullSafe(F.col("_b")).cast("double")).alias("agreement"))


def evaluated(ranks: DataFrame, mode: str, levels: dict[str, str], ms: str | None = None, cuts: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """A row for each mode: MRR and recall at the cuts for each level, and times.

    ``levels`` names a rank column for each level (a chunk, its article); null is a miss.
    """
    made = [F.count("*").alias("questions")]
    for level, column in levels.items():
        r = F.col(column)
        made.append(F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias(f"mrr_{level}"))
        made += [F.avg(F.when(r <= n, 1.0).otherwise(0.0)).alias(f"recall_{n}_{level}") for n in cuts]
    out = ranks.groupBy(mode).agg(*made)
    return out if ms is None else out.join(time_statistics(ranks, mode, ms).drop("n", "median_ms"), mode)
