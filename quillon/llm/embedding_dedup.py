"""Near-duplicate vectors: spherical k-means cells and blocked cosine products.

Equal vectors of a label become one node with a count, whatever the ids of their rows.
Spherical k-means, fitted on a bounded sample, gives each a home cell. Two vectors closer than the threshold can have different
homes only if one lies near the border: a vector also visits each later cell whose border
is within that distance, so no pair is lost. Within a cell, blocks are compared with one
matrix product each, in double precision; a block returns counts and the few links that
join what it found, never its pairs. The smallest id of each group is kept.

Where vectors lie in groups, few of them are near a border and the work grows as their
number. Where they are mere noise all cells lie near each other, every pair of a label has
to be compared, and the work grows as the square of the largest label.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .cluster import checkpointed
from .components import connected_components, spanning_links

#: Vectors in a cell and in a block, about; bounds of the sample, of cells, and of rounds.
CELL, BLOCK, SAMPLE, CELLS, ROUNDS = 4096, 1024, 65_536, 4096, 15


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.array(rows, np.float64).reshape(len(rows), -1)


def _levelled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest number: exact, and no square overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if x.size else x


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors; the first ones are drawn far from each other."""
    rng = np.random.default_rng(7)
    centres = [x[0]]
    nearest = x @ x[0]
    for _ in range(1, min(k, len(x))):
        far = np.maximum(1 - nearest, 0)
        if far.sum() <= 1e-12:
            break
        centres.append(x[rng.choice(len(x), p=far / far.sum())])
        nearest = np.maximum(nearest, x @ centres[-1])
    c = np.array(centres)
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        new = np.where(length > 0, total / np.maximum(length, 1e-300), c)
        if np.abs(new - c).max() < 1e-6:
            break
        c = new
    return c


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Link vectors of one label whose cosine is ``threshold`` or more, and keep one a group.

    Returns ``vec_id, n_links, component_id, kept`` for each input row: the number of other
    rows linked directly, the smallest id reachable, and whether that is the row's own id.

    Rows with a null label or id and vectors that are null, empty, zero or hold null or
    non-finite components link with nothing. Vectors of different lengths are never
    compared. Rows that share an id are rows of their own, and may be in different groups.
    Other columns are ignored; an empty table gives an empty result.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    marked = base.withColumn("sound", F.coalesce(sound, F.lit(False)))
    nodes = marked.where("sound").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    texts = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    # cells divide the largest label: more of them would only make more borders to visit across
    n = texts.groupBy("label").count().agg(F.max("count")).first()[0]
    lengths = texts.agg(F.collect_set(F.size("v"))).first()[0]
    parts = [_linked(texts.where(F.size("v") == d), d, n, threshold) for d in sorted(lengths)]
    if not parts:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = checkpointed(found)
    groups = connected_components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    known = texts.join(links, "node", "left").join(groups, "node", "left").select("label", "v", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "component").select("label", "v", "n_links", "component_id")
    out = marked.where("sound").join(known, ["label", "v"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = marked.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def _linked(texts: DataFrame, dimension: int, n: int, threshold: float) -> DataFrame:
    """``a, b, n``: links to join on, and (b null) how many rows each vector is linked with."""
    drawn = texts.orderBy(F.xxhash64("label", "v"), "least").limit(min(SAMPLE, max(1, 16 * math.ceil(n / CELL)) * 64)).select("v").toArrow()
    sample = _levelled(_matrix(drawn["v"]))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    centres = spherical_kmeans(sample, max(1, min(CELLS, math.ceil(n / CELL))))
    reach = math.sqrt(2 - 2 * threshold) * (1 + 1e-6) + 1e-9
    apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)

    def assign(batches):
        for batch in batches:
            x = _levelled(_matrix(batch["v"]))
            near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ centres.T
            home = near.argmax(1)
            own = np.arange(len(home))
            visit = near[own, home][:, None] - near <= reach * apart[home]
            visit &= np.arange(len(centres))[None] > home[:, None]
            visit[own, home] = True
            row, cell = np.nonzero(visit)
            yield pa.record_batch({"label": batch["label"].take(pa.array(row)), "node": batch["node"].take(pa.array(row)), "copies": batch["copies"].take(pa.array(row)), "v": batch["v"].take(pa.array(row)), "cell": pa.array(cell, pa.int32()), "guest": pa.array(home[row] != cell)})

    placed = texts.mapInArrow(assign, "label string, node long, copies long, v array<double>, cell int, guest boolean")
    sizes = placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(sizes, ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "guest", "v")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[2].as_py(), key[3].as_py()
        x, ids, copies = _levelled(_matrix(table["v"])), table["node"].to_numpy(), table["copies"].to_numpy()
        guest, block = table["guest"].to_numpy(zero_copy_only=False), table["block"].to_numpy()
        length = np.sqrt((x * x).sum(1))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a = b = ids[:0]
        counted, many = ids[:0], copies[:0]
        if len(left) and len(right):
            linked = (x[left] @ x[right].T) / (length[left][:, None] * length[right][None]) >= threshold
            linked &= ~(guest[left][:, None] & guest[right][None])  # guests meet in the home of one
            if i == j:
                np.fill_diagonal(linked, False)
                a, b = spanning_links(linked, ids[left])
                counted, many = ids[left], linked @ copies[left]
            else:
                a, b = spanning_links(linked, ids[left], ids[right])
                counted, many = np.concatenate([ids[left], ids[right]]), np.concatenate([linked @ copies[right], linked.T @ copies[left]])
            counted, many = counted[many > 0], many[many > 0]
        nothing = pa.nulls(len(counted), pa.int64())
        return pa.table({"a": pa.array(np.concatenate([a, counted]), pa.int64()), "b": pa.concat_arrays([pa.array(b, pa.int64()), nothing]), "n": pa.array(np.concatenate([np.zeros(len(a), np.int64), many]), pa.int64())})

    return dealt.groupBy("label", "cell", "i", "j").applyInArrow(compare, "a long, b long, n long")
