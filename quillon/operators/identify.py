"""Who is it: search a gallery, decide by a threshold, remember who comes often."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .search import nearest_many


def identified(photos: DataFrame, gallery: DataFrame, persons: DataFrame, threshold: float, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", person: str = "person_id", name: str = "name") -> DataFrame:
    """``query_id, person, name, similarity, known`` for each photo.

    The ``k`` nearest photos of the gallery (a photo isn't its own neighbour), the best of
    each person, and of those the best one if its cosine reaches the threshold; else person
    and name are null and ``similarity`` tells how near it came. Ties go to the smaller person.
    """
    hits = nearest_many(gallery, photos, k + 1, "cosine", id_col, vector_col).where("id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    hits = hits.withColumn("place", place).where(F.col("place") <= k)
    owners = gallery.select(F.col(id_col).cast("long").alias("id"), F.col(person).alias("person"))
    best = hits.join(owners, "id").groupBy("query_id", "person").agg(F.max("score").alias("score"))
    first = best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "person"))).where("place = 1")
    every = photos.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id")).join(first, "query_id", "left")
    known = F.coalesce(F.col("score") >= threshold, F.lit(False))
    decided = every.select("query_id", F.when(known, F.col("person")).alias("person"), F.col("score").alias("similarity"), known.alias("known"))
    names = persons.select(F.col(person).alias("person"), F.col(name).alias("name"))
    return decided.join(names, "person", "left").select("query_id", "person", "name", "similarity", "known")


def best_threshold(curve: DataFrame) -> DataFrame:
    """The row of a threshold curve with the largest sum of accept and reject rate, the lowest of equals."""
    return curve.orderBy(F.desc(F.col("accept_rate") + F.col("reject_rate")), "threshold").limit(1)


@dataclass
class Remembered:
    """Persons seen often, each with the sum of its vectors: a cache in front of a search.

    Only answers that the search gave are remembered. Those beyond the ``top`` most frequent
    (ties: the larger id first) lose their sum, though not their count.
    """

    top: int = 20
    seen: Counter = field(default_factory=Counter)
    sums: dict[int, np.ndarray] = field(default_factory=dict)

    def _frequent(self) -> list[int]:
        return sorted(self.seen, key=lambda p: (-self.seen[p], -p))

    def find(self, vector: np.ndarray, threshold: float) -> int | None:
        held = [p for p in self._frequent()[: self.top] if p in self.sums]
        if not held:
            return None
        means = np.array([self.sums[p] / max(np.linalg.norm(self.sums[p]), 1e-12) for p in held])
        near = means @ vector
        return held[int(near.argmax())] if near.max() >= threshold else None

    def remember(self, person: int, vector: np.ndarray) -> None:
        self.seen[person] += 1
        self.sums[person] = self.sums.get(person, 0) + vector
        for p in self._frequent()[self.top :]:
            self.sums.pop(p, None)

    def forget(self, person: int) -> None:
        self.seen.pop(person, None)
        self.sums.pop(person, None)


def simulated_events(photos: DataFrame, id_col: str, person: str, events: int = 1000, frequent: int = 10, often: float = 0.8, strangers: float = 0.05, seed: int = 0) -> DataFrame:
    """``event, id``: which photo is shown at each event.

    A share ``often`` of the events shows one of ``frequent`` persons drawn at first, a share
    ``strangers`` a photo without a person, the others anybody else. All draws are hashes.
    """
    spark = photos.sparkSession
    draw = lambda *what: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *what)), 1, 12), 16, 10).cast("long"), F.lit(1 << 40)) / float(1 << 40)
    known = photos.where(F.col(person).isNotNull()).select(F.col(person).cast("string").alias("who")).distinct()
    chosen = F.row_number().over(Window.orderBy(draw(F.lit("person"), F.col("who")), "who")) <= frequent
    kinds = known.withColumn("kind", F.when(chosen, "often").otherwise("seldom"))
    shown = photos.select(F.col(id_col).alias("id"), F.col(person).cast("string").alias("who")).join(kinds, "who", "left").withColumn("kind", F.coalesce("kind", F.lit("stranger")))
    numbered = shown.withColumn("number", F.row_number().over(Window.partitionBy("kind").orderBy("id")) - 1)
    sizes = shown.groupBy("kind").agg(F.count("*").alias("n"))
    at = draw(F.lit("kind"), F.col("event").cast("string"))
    plan = spark.range(events).select(F.col("id").alias("event")).withColumn("kind", F.when(at < often, "often").when(at < 1 - strangers, "seldom").otherwise("stranger"))
    plan = plan.join(F.broadcast(sizes), "kind").withColumn("number", F.floor(draw(F.lit("photo"), F.col("event").cast("string")) * F.col("n")))
    return plan.join(numbered, ["kind", "number"]).select("event", "id")


def replayed(events: DataFrame, answers: DataFrame, vectors: DataFrame, threshold: float, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``event, id, person, source``: events in order, answered from memory or by the search.

    ``answers`` hold what the search says of each photo (``query_id, person``). A memory works
    one event after the other by its nature, so the events, a bounded list, are one task.
    """
    rows = events.join(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")), "id").join(answers.select(F.col("query_id").alias("id"), F.col("person").cast("long").alias("person")), "id", "left")

    def run(table):
        memory, out = Remembered(top), []
        for r in table.sort_values("event").itertuples():
            v = np.array(r.v, float)
            v = v / max(np.linalg.norm(v), 1e-300)
            person = memory.find(v, threshold)
            source = "memory" if person is not None else "search"
            if person is None and r.person == r.person and r.person is not None:
                person = int(r.person)
                memory.remember(person, v)
            out.append((r.event, r.id, person, source))
        return pd.DataFrame(out, columns=["event", "id", "person", "source"]).astype({"person": "Int64"})

    return rows.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(lambda table: run(table), "event long, id long, person long, source string")


def replay_statistics(run: DataFrame, truth: DataFrame, id_col: str = "vec_id", person: str = "label") -> DataFrame:
    """``events, from_memory, wrong_from_memory, right`` of a replay; ``right`` counts strangers left unknown."""
    own = truth.select(F.col(id_col).alias("id"), F.col(person).cast("long").alias("own"))
    right = F.col("person").eqNullSafe(F.col("own"))
    memory = F.col("source") == "memory"
    return run.join(own, "id").agg(F.count("*").alias("events"), F.avg(memory.cast("double")).alias("from_memory"), F.count_if(memory & ~right).alias("wrong_from_memory"), F.avg(right.cast("double")).alias("right"))
