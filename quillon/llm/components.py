"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .cluster import checkpointed


#: Links of one node that a task meets, at least, and the nodes that may have more of them.
PART, HUBS = 100_000, 10_000


def _with_least(rows: DataFrame, most: int | None) -> DataFrame:
    """``rows(u, v)`` and ``m``, the smallest ``v`` of each ``u``.

    A node with over ``most`` rows is a hub: its rows are dealt by ``v`` to parts of about
    ``most``, each of which meets its own copy of the hub's smallest. Rows divided by
    ``most`` bound the hubs, so they are few enough to be sent to every task. None: no
    node is a hub.
    """
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if most is None:
        return rows.join(least.select("u", "m"), "u")
    hubs = F.broadcast(least.where(F.col("n") > most).select("u", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    dealt = rows.join(hubs, "u", "left").select("u", "v", F.coalesce(F.pmod(F.xxhash64("v"), F.col("parts")), F.lit(0)).cast("int").alias("part"))
    copies = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > most, F.ceil(F.col("n") / most).cast("int") - 1).otherwise(0))))
    return dealt.join(copies.select("u", "m", "part"), ["u", "part"]).select("u", "v", "m")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges(a, b)`` with the smallest node that it reaches.

    Returns ``node, component``; nodes without an edge to another node are left out.
    Each round hangs larger neighbours on the smallest one (large star) and then smaller
    neighbours on the smallest (small star); rounds grow with the logarithm of the graph.
    Nulls and self links are dropped, repeated links count once, no link gives no row.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = checkpointed(links.where("a is not null and b is not null and a <> b").distinct())
    seen = _print_of(links)
    for _ in range(most_rounds):
        most = max(PART, 2 * seen[0] // HUBS)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if 2 * seen[0] <= most or both.groupBy("u").count().agg(F.max("count")).first()[0] <= most:
            most = None  # nor has a node more links after the large star than before it
        large = _with_least(both, most).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = _with_least(large, most)
        hung = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = checkpointed(hung.unionByName(small.where("v = m").select("u", "v")).distinct())
        now = _print_of(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _print_of(links: DataFrame) -> tuple:
    """Count and checksum: equal for equal sets of links."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(7), "v", "u"))).first())


def spanning_links(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Few links (id, id) that join all that a boolean matrix joins.

    ``rows`` and ``columns`` are the ids of its sides; no ``columns``: both sides are ``rows``.
    """
    r, c = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    if not len(r):
        return rows[:0], rows[:0]
    linked, rows, columns = linked[np.ix_(r, c)], rows[r], None if columns is None else columns[c]
    label = np.arange(len(rows))
    side = label if columns is None else np.full(len(columns), len(rows))
    while True:
        new_side = np.minimum(side, np.where(linked, label[:, None], len(rows)).min(0))
        new = np.minimum(label, np.where(linked, new_side[None, :], len(rows)).min(1))
        if columns is None:
            new = new_side = np.minimum(new, new_side)
        if (new == label).all() and (new_side == side).all():
            break
        label, side = new, new_side
    moved = np.flatnonzero(label != np.arange(len(rows)))
    if columns is None:
        return rows[label[moved]], rows[moved]
    met = np.flatnonzero(side < len(rows))
    return np.concatenate([rows[label[moved]], rows[side[met]]]), np.concatenate([rows[moved], columns[met]])
