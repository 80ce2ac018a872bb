"""Ranked search: full text (BM25, TF-IDF), vectors (exact, cells, graphs) and fusion of rankings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quillon.functions.text import counts, query_terms, terms


def _by_term(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("term")]


def _saturated(tf: Column, length: Column, avgdl: float | Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))


def match(docs: DataFrame, query: str, id_col: str, text_col: str, method: str = "BM25", k1: float = 1.2, b: float = 0.75, **options) -> DataFrame:
    """``doc, score`` of all texts that score above 0; order by score and doc to rank them.

    Without an index: the asked terms are counted where a text is read, and one row of sums
    (texts, words, texts that hold each term) is all that BM25 needs besides. TF-IDF also
    needs how many texts hold each word, for the lengths of the texts that are hit. Null
    texts aren't counted, empty ones are.
    """
    asked = query_terms(query, **options)
    nothing = docs.sparkSession.createDataFrame([], T.StructType([T.StructField("doc", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())]))
    if not asked:
        return nothing
    names = list(asked)
    counted = counts(docs, id_col, text_col, names, **options)
    sums = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *[F.count_if(F.col("tf")[i] > 0).alias(f"df_{i}") for i in range(len(names))])
    if method == "BM25":
        # a light row for each text moves once, and both the sums and the scores are made of it
        light = counted.repartition(docs.sparkSession.sparkContext.defaultParallelism)
        sums = light.agg(F.count("*").cast("double").alias("n"), F.greatest(F.avg("len"), F.when(F.avg("len") == 0, 1.0)).alias("avgdl"), *[F.count_if(F.col("tf")[i] > 0).alias(f"df_{i}") for i in range(len(names))])
        hits = light.where(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(sums))
        parts = [F.lit(asked[t]) * F.log((F.col("n") - F.col(f"df_{i}") + 0.5) / (F.col(f"df_{i}") + 0.5) + 1) * _saturated(F.col("tf")[i], F.col("len"), F.col("avgdl"), k1, b) for i, t in enumerate(names)]
        return hits.select("doc", sum(parts[1:], parts[0]).alias("score")).where("score > 0")
    told = sums.first()
    n = float(told["n"])
    wanted = {t: math.log10(1 + asked[t]) * math.log10(n / df) for i, t in enumerate(names) if 0 < (df := told[f"df_{i}"]) < n}
    if not wanted:
        return nothing
    norm = math.sqrt(sum(w * w for w in wanted.values()))
    often = terms(docs, id_col, text_col, **options).groupBy("term").agg(F.count("*").alias("df"))
    weighed = terms(docs, id_col, text_col, **options, among=list(wanted)).join(often, "term").withColumn("w", F.log10(1 + F.col("tf")) * F.log10(n / F.col("df")))
    dots = weighed.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum(F.col("w") * _by_term(wanted)).alias("dot"))
    return dots.where("dot > 0").select("doc", (F.col("dot") / (F.col("norm") * norm)).alias("score")).where("score > 0")


def vector_distance(v: Column, query: list[float], metric: str) -> Column:
    """Euclidean, cosine (1 for zero vectors) or dot (negated), in double precision."""
    q = F.array(*[F.lit(float(x)) for x in query])
    x = v.cast("array<double>")
    pairs = F.arrays_zip(x.alias("a"), q.alias("b"))
    add = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + f(p["a"], p["b"]))
    if metric == "euclidean":
        return F.sqrt(add(lambda a, b: (a - b) * (a - b)))
    dot = add(lambda a, b: a * b)
    if metric == "dot":
        return -dot
    length = F.sqrt(add(lambda a, b: a * a)) * math.sqrt(sum(float(x) ** 2 for x in query))
    return F.when(length > 0, 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / length))).otherwise(1.0)


def vector_score(distance: Column, metric: str) -> Column:
    return {"euclidean": 1 / (1 + distance), "cosine": 1 - distance, "dot": -distance}[metric]


def nearest(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows, ties by id, with ``distance`` and ``score``; filter beforehand."""
    found = vectors.where(F.col(vector_col).isNotNull()).withColumn("distance", vector_distance(F.col(vector_col), query, metric))
    return found.withColumn("score", vector_score(F.col("distance"), metric)).orderBy("distance", id_col).limit(k)


#: Query vectors that one pass over the table answers; rows that a task compares at once.
QUERIES, ROWS = 4096, 4096


def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Queries by rows; the same measures as ``vector_distance``."""
    dot = q @ x.T
    if metric == "dot":
        return -dot
    if metric == "euclidean":
        # differences, not squares less twice the product: near vectors keep their digits
        return np.sqrt(np.stack([((x - one) ** 2).sum(1) for one in q])) if len(q) else dot
    length = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
    return np.where(length > 0, 1 - np.clip(dot / np.where(length > 0, length, 1), -1, 1), 1.0)


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, wide)


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding", cells: tuple[str, np.ndarray] | None = None) -> DataFrame:
    """``query_id, id, rank, distance, score``: the ``k`` nearest rows of each query, ties by id.

    Queries are taken in blocks of QUERIES; each block passes over the whole table once, a
    task keeps ``k`` rows for a query, and a window ranks what the tasks have kept. With
    ``cells`` (a column, and for each query of the block in id order its cells as a 0/1
    matrix) only rows of those cells are compared. Null vectors are left out on both sides;
    rows of another dimension than the queries are errors.
    """
    asked = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("q"))
    held = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *([F.col(cells[0]).alias("cell")] if cells else []))
    n = asked.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, rank int, distance double, score double")
    out, last, done = None, None, 0
    while done < n:
        block = asked.where(F.col("query_id") > last) if last is not None else asked
        rows = block.orderBy("query_id").limit(QUERIES).collect()
        ids, q = np.array([r["query_id"] for r in rows], np.int64), np.array([r["q"] for r in rows], float)
        allowed = cells[1][done : done + len(rows)] if cells else None
        found = held.mapInArrow(_kept(ids, q, k, metric, allowed), "query_id long, id long, distance double")
        out = found if out is None else out.unionByName(found)
        done, last = done + len(rows), int(ids[-1])
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    ranked_ = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked_.select("query_id", "id", "rank", "distance", vector_score(F.col("distance"), metric).alias("score"))


def _kept(ids: np.ndarray, q: np.ndarray, k: int, metric: str, allowed: np.ndarray | None):
    """The part of a search that a task does: its ``k`` nearest rows for each query."""

    def run(batches):
        best_d, best_i = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, own = _matrix(part["v"], q.shape[1]), part["id"].to_numpy()
                d = _distances(x, q, metric)
                if allowed is not None:
                    d[~allowed[:, part["cell"].to_numpy()]] = np.inf
                d = np.concatenate([best_d, d], axis=1)
                i = np.concatenate([best_i, np.broadcast_to(own, (len(ids), len(own)))], axis=1)
                order = np.lexsort((i, d), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        some = np.isfinite(best_d)
        yield pa.record_batch({"query_id": pa.array(np.repeat(ids, some.sum(1))), "id": pa.array(best_i[some]), "distance": pa.array(best_d[some])})

    return run


def ivf_index(vectors: DataFrame, lists: int | None = None, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 50_000) -> tuple[DataFrame, np.ndarray]:
    """Rows with the ``cell`` of their nearest centroid, and the centroids.

    Centroids are fitted on at most ``sample`` vectors by a hash of their id; all rows are
    indexed. Write the rows partitioned by ``cell``, and a search reads its cells only.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    known = vectors.where(F.col(vector_col).isNotNull()).withColumn("_x", F.col(vector_col).cast("array<double>"))
    if metric == "cosine":
        norm = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda s, x: s + x * x))
        known = known.withColumn("_x", F.when(norm > 0, F.transform("_x", lambda x: x / norm)).otherwise(F.col("_x")))
    n = known.count()
    lists = lists or max(1, round(math.sqrt(n)))
    drawn = known.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(array_to_vector("_x").alias("features"))
    if not n:
        return known.drop("_x").withColumn("cell", F.lit(0)), np.zeros((1, 1))
    centres = np.array(KMeans(k=min(lists, n), seed=42, maxIter=20).fit(drawn).clusterCenters())
    norms, names = (centres**2).sum(1), list(vectors.columns)

    def assign(batches):
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch["_x"].slice(at, ROWS), centres.shape[1])
                cell[at : at + ROWS] = (norms - 2 * (x @ centres.T)).argmin(1)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(cell)], names=[*names, "cell"])

    return known.mapInArrow(assign, T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType())])), centres


def probed_cells(centres: np.ndarray, q: np.ndarray, probes: int, metric: str) -> np.ndarray:
    """Which cells each query probes: a 0/1 matrix, the nearest centroids first."""
    q = np.asarray(q, float).reshape(-1, centres.shape[1])
    if metric == "cosine":
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    near = (centres**2).sum(1)[None] - 2 * q @ centres.T if metric != "dot" else -(q @ centres.T)
    out = np.zeros((len(q), len(centres)), bool)
    np.put_along_axis(out, np.argsort(near, axis=1, kind="stable")[:, :probes], True, 1)
    return out


def ivf_nearest(index: DataFrame, centres: np.ndarray, query: list[float], k: int, probes: int | None = None, metric: str = "cosine", **columns) -> DataFrame:
    """Search the ``probes`` nearest cells only; as many probes as cells is exact.

    Cells are searched four times as many while fewer than ``k`` rows are in them, so that a
    filter, or small cells, never make the answer shorter than the table allows.
    """
    probes = min(len(centres), probes or max(1, round(math.sqrt(len(centres)))))
    while True:
        cells = np.flatnonzero(probed_cells(centres, [query], probes, metric)[0])
        found = nearest(index.where(F.col("cell").isin(*map(int, cells))), query, k, metric, **columns)
        if probes == len(centres) or found.count() >= k:
            return found
        probes = min(len(centres), probes * 4)


def ivf_many(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``nearest_many`` over the ``probes`` nearest cells of each query (queries: up to QUERIES)."""
    rows = queries.where(F.col(vector_col).isNotNull()).orderBy(F.col(id_col).cast("long")).select(vector_col).limit(QUERIES).collect()
    allowed = probed_cells(centres, [r[0] for r in rows], probes, metric)
    return nearest_many(index, queries, k, metric, id_col, vector_col, ("cell", allowed))


def _top(distances: np.ndarray, k: int) -> np.ndarray:
    return np.argsort(distances, axis=1, kind="stable")[:, :k]


def calibrated_probes(vectors: DataFrame, index: DataFrame, centres: np.ndarray, metric: str = "cosine", k: int = 10, target: float = 0.97, drawn: int = 128, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
    """The fewest probes at which ``drawn`` sampled rows find ``target`` of their exact ``k`` nearest.

    The exact answers are looked up once with the cells they lie in, so that any number of
    probes is judged without another search.
    """
    sample = vectors.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(F.lit(5), F.col(id_col)), id_col).limit(drawn)
    asked = sample.select(id_col, vector_col).collect()
    if not asked:
        return 1
    exact = nearest_many(index, sample, k, metric, id_col, vector_col).select("query_id", F.col("id").alias(id_col))
    cells = exact.join(index.select(F.col(id_col).cast("long").alias(id_col), "cell"), id_col).select("query_id", "cell").collect()
    place = {int(r[id_col]): i for i, r in enumerate(asked)}
    q = np.array([r[vector_col] for r in asked], float)
    if metric == "cosine":
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    near = (centres**2).sum(1)[None] - 2 * q @ centres.T if metric != "dot" else -(q @ centres.T)
    turn = np.argsort(np.argsort(near, axis=1, kind="stable"), axis=1)
    needed = np.sort([turn[place[r["query_id"]], r["cell"]] + 1 for r in cells])
    return int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)])


#: Vectors in a shard of a graph index, links of a vector, and how far a walk looks around.
SHARD, LINKS, EF = 4096, 16, 200


def graph_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "cosine", m: int = LINKS) -> DataFrame:
    """A navigable graph for each shard of up to SHARD vectors: ``shard, ids, vectors, links``, to be written.

    Vectors are dealt by a hash of their id, so that building takes the same work for each.
    A vector links with its ``m`` nearest, as many far ones drawn by chance, and with those
    that link with it.
    """
    known = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    shards = max(1, math.ceil(known.count() / (0.75 * SHARD)))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table["id"].to_numpy()
        x = np.array(table["v"].to_pylist(), np.float32)
        y = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30) if metric == "cosine" else x
        rng = np.random.default_rng(int(key[0].as_py()))
        links = np.zeros((len(x), 2 * m), np.int32)
        for at in range(0, len(x), 512):
            near = -(y[at : at + 512] @ y.T) if metric != "euclidean" else (y**2).sum(1)[None] - 2 * y[at : at + 512] @ y.T
            near[np.arange(len(near)), at + np.arange(len(near))] = -np.inf
            links[at : at + 512, :m] = np.resize(_top(near, m + 1)[:, 1:] if len(x) > 1 else np.zeros((len(near), 1)), (len(near), m))
        links[:, m:] = rng.integers(0, len(x), (len(x), m))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([x.astype("<f4").tobytes()], pa.binary()), "links": pa.array([links.astype("<i4").tobytes()], pa.binary())})

    dealt = known.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(build, "shard int, ids binary, vectors binary, links binary")


def graph_many(index: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", ef: int = EF, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``nearest_many`` by walking each shard's graph: best first, ``ef`` vectors deep (queries: up to QUERIES).

    Distances of what the walks meet are exact to single precision.
    """
    ef = max(ef, k)
    rows = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("v")).orderBy("i").limit(QUERIES).collect()

    def walk(batches):
        for batch in batches:
            for s in range(batch.num_rows):
                ids = np.frombuffer(batch["ids"][s].as_py(), "<i8")
                x = np.frombuffer(batch["vectors"][s].as_py(), "<f4").reshape(len(ids), -1).astype(float)
                links = np.frombuffer(batch["links"][s].as_py(), "<i4").reshape(len(ids), -1)
                for r in rows:
                    d, at = _walked(x, links, np.array(r["v"], float), ef, metric)
                    order = np.lexsort((ids[at], d))[:k]
                    yield pa.record_batch({"query_id": pa.array([r["i"]] * len(order), pa.int64()), "id": pa.array(ids[at][order]), "distance": pa.array(d[order])})

    out = index.select("ids", "vectors", "links").mapInArrow(walk, "query_id long, id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "rank", "distance", vector_score(F.col("distance"), metric).alias("score"))


def _walked(x: np.ndarray, links: np.ndarray, q: np.ndarray, ef: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Distances and places of the ``ef`` nearest vectors that a best-first walk meets.

    All the links of the nearest unvisited vectors are followed at once, until the ``ef``
    nearest seen have all been visited.
    """
    start = np.unique(np.linspace(0, len(x) - 1, min(len(x), 32)).astype(int))
    seen = np.zeros(len(x), bool)
    seen[start] = True
    at, d = start, _distances(x[start], q[None], metric)[0]
    visited = np.zeros(len(x), bool)
    while True:
        todo = at[~visited[at]][:32]
        if not len(todo):
            return d, at
        visited[todo] = True
        fresh = np.unique(links[todo])
        fresh = fresh[~seen[fresh]]
        if len(fresh):
            seen[fresh] = True
            at, d = np.concatenate([at, fresh]), np.concatenate([d, _distances(x[fresh], q[None], metric)[0]])
        order = np.lexsort((at, d))[:ef]
        at, d = at[order], d[order]


def recall(exact: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """The share of the exact answer that was found; 1 for an empty one."""
    keys = list(keys or ("vec_id",))
    both = exact.select(*keys).join(found.select(*keys).distinct().withColumn("hit", F.lit(1)), keys, "left")
    return both.agg(F.coalesce(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), F.lit(1.0)).alias("recall"))


def fuse(rankings: list[DataFrame] | dict[str, DataFrame], id_col: str, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ``id, rank`` lists: sums of 1 / (constant + rank), best first.

    Named lists (a dictionary) also give ``positions``, the rank in each list that holds the id.
    """
    named = rankings if isinstance(rankings, dict) else {str(i): r for i, r in enumerate(rankings)}
    every = None
    for name, r in named.items():
        part = r.select(F.col(id_col), F.col("rank"), F.lit(name).alias("list"))
        every = part if every is None else every.unionByName(part)
    places = [F.map_from_entries(F.sort_array(F.collect_list(F.struct("list", "rank")))).alias("positions")] if isinstance(rankings, dict) else []
    return every.groupBy(id_col).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("rrf"), *places).orderBy(F.desc("rrf"), id_col).limit(k)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Numbers a short list (a top-k, not a table) from 1."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def retrieval_metrics(found: DataFrame, rank_col: str = "rank") -> DataFrame:
    """MRR and recall at 1, 5 and 10 over a row for each question; a null rank is a miss."""
    r = F.col(rank_col)
    hit = lambda n: F.avg(F.when(r <= n, 1.0).otherwise(0.0)).alias(f"recall_{n}")
    return found.agg(F.count("*").alias("questions"), F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"), hit(1), hit(5), hit(10))


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 200, overlap: int = 40, tail: int = 60) -> DataFrame:
    """Windows of ``size`` words; a last one with under ``tail`` new words joins the one before."""
    step = size - overlap
    words = F.filter(F.split(F.col(text_col), r"\s+"), lambda w: w != "")
    cut = docs.select(F.col(id_col), words.alias("w")).where(F.size("w") > 0).withColumn("n", F.size("w"))
    # starts at 0, step, ...; window i brings n - i*step - overlap new words at the end of the text
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)).cast("int")
    fresh = F.col("n") - (last * step + overlap)
    count = F.when((last > 0) & (fresh < tail), last).otherwise(last + 1)
    numbered = cut.withColumn("count", count).withColumn("place", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    length = F.when(F.col("place") == F.col("count") - 1, F.col("n")).otherwise(F.lit(size))
    return numbered.select(F.col(id_col), "place", F.array_join(F.slice("w", F.col("place") * step + 1, length), " ").alias("chunk"))


def best_per_group(hits: DataFrame, group: str, score: str = "score") -> DataFrame:
    return hits.groupBy(group).agg(F.max(score).alias(score)).orderBy(F.desc(score), group)


def threshold_curve(tries: DataFrame, thresholds: list[float]) -> DataFrame:
    """Accept and reject rates of ``known, right, score`` rows at each of a few thresholds."""
    each = tries.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    passes = F.col("score") >= F.col("threshold")
    return each.groupBy("threshold").agg(
        F.avg(F.when(F.col("known"), (passes & F.col("right")).cast("double"))).alias("accept_rate"),
        F.avg(F.when(~F.col("known"), (~passes).cast("double"))).alias("reject_rate"),
        F.avg(F.when(F.col("known"), (passes & ~F.col("right")).cast("double"))).alias("error_rate"),
    )


def word_histograms(descriptors: DataFrame, centroids: np.ndarray, group: str, vector: str) -> DataFrame:
    """How often each group's descriptors fall to each centroid: ``group, word, n``."""

    def assign(parts):
        for part in parts:
            x = np.array(part[vector].tolist(), float).reshape(len(part), centroids.shape[1])
            word = ((centroids**2).sum(1)[None] - 2 * x @ centroids.T).argmin(1)
            yield pd.DataFrame({group: part[group], "word": word.astype("int32")})

    kind = dict(descriptors.dtypes)[group]
    return descriptors.select(group, vector).mapInPandas(assign, f"{group} {kind}, word int").groupBy(group, "word").agg(F.count("*").alias("n"))


def histogram_tfidf(histograms: DataFrame, group: str) -> DataFrame:
    """Weights n / sum(n) * ln(N / df) of ``group, word, n`` rows."""
    total = histograms.select(group).distinct().count()
    frequency = histograms.groupBy("word").agg(F.countDistinct(group).alias("df"))
    sums = histograms.groupBy(group).agg(F.sum("n").alias("total"))
    weight = F.col("n") / F.col("total") * F.log(F.lit(float(total)) / F.col("df"))
    return histograms.join(frequency, "word").join(sums, group).select(group, "word", weight.alias("weight"))
