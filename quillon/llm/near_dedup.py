"""Near-duplicate documents by DartMinHash signatures, banding and exact verification.

* A text is its five-word shingles (lower case); a shingle weighs as often as it occurs, or
  1 (``counted``). Each shingle throws darts: arrivals
  of a hashed Poisson process over its weight region, each with a rank (arrival time), a
  coordinate and a fingerprint. Darts that land under the shingle's weight count; a
  coordinate keeps its earliest. Two texts agree at a coordinate with the probability of
  their weighted Jaccard similarity. Only about ``k ln k + 2k`` darts are thrown for a text,
  however many shingles it has; a text with a coordinate still empty goes on twice as far.
* Bands of coordinates make buckets. A bucket is never collected: it links each of its
  texts with its smallest. The components of these links contain every pair that shares a
  bucket; within them, blocks of texts are compared exactly, all rows against all columns,
  and a block returns only the few links that join what it found.
* The components of the verified links are the groups. With 40 bands of 6 a pair of
  similarity 0.8 shares no bucket with a probability under 6e-6.

Equal word sequences are one text from the start: copies cost one row each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import wordhash as W
from .cluster import checkpointed, give_back
from .components import connected_components, spanning_links

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 40, 6
#: Shingles weigh as often as they occur, unless told otherwise.
COUNTED = True
#: Bytes, and texts, that are signed at once: a text throws some 1,800 darts, however short it is.
PIECE_BYTES, PIECE_TEXTS = 2_000_000, 512
#: Texts, and shingles, that a block holds, about.
BLOCK_TEXTS, BLOCK_SHINGLES = 768, 1_500_000


def _slab(weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower end and height of the ``n``-th dyadic slab of the weight axis: [0,1) [1,2) [2,4) ..."""
    return (0.0, 1.0) if n == 0 else (2.0 ** (n - 1), 2.0 ** (n - 1))


def dart_signatures(elements: np.ndarray, owner: np.ndarray, n: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """DartMinHash: an ``n`` by ``k`` matrix of fingerprints for ``n`` weighted sets.

    ``elements`` are 64-bit hashes, ``owner`` says to which set each belongs, ``weights``
    are positive (1 if not given). A set without elements gets a row of zeros.
    """
    weights = np.ones(len(elements)) if weights is None else weights
    mass = np.bincount(owner, weights, n)
    out = np.zeros((n, k), np.uint64)
    reach = np.divide(k * math.log(k) + 2 * k, mass, out=np.zeros(n), where=mass > 0)
    todo = mass > 0
    while todo.any():
        use = todo[owner]
        h, who, weight = elements[use], owner[use], weights[use]
        cells, ranks, prints = [], [], []
        slab, top = 0, weight.max()
        while True:
            low, height = _slab(weight, slab)
            if low >= top:
                break
            on = weight > low
            base, whose, full = W.mix(h[on] ^ W.U64(0x51AB + slab * 0x9E3779B1)), who[on], weight[on]
            rank, throw = np.zeros(len(base)), 0
            while len(base):
                dart = W.mix(base + W.U64((throw + 1) * 0x9E3779B97F4A7C15 % 2**64))
                rank = rank - np.log((dart >> W.U64(11)).astype(float) * 2.0**-53 + 2.0**-54) / height
                alive = rank <= reach[whose]
                base, whose, full, rank, dart = base[alive], whose[alive], full[alive], rank[alive], dart[alive]
                more = W.mix(dart ^ W.U64(0xD1B54A32D192ED03))
                hit = slice(None)
                if low or (full < 1).any():
                    hit = low + height * ((W.mix(more) >> W.U64(11)).astype(float) * 2.0**-53) < full
                cells.append((whose * k + (more >> W.U64(33)).astype(np.int64) % k)[hit])
                ranks.append(rank[hit])
                prints.append(more[hit])
                throw += 1
            slab += 1
        cells, ranks, prints = np.concatenate(cells), np.concatenate(ranks), np.concatenate(prints)
        best = np.full(n * k, np.inf)
        np.minimum.at(best, cells, ranks)
        won = ranks == best[cells]
        out.reshape(-1)[cells[won]] = prints[won]
        todo = todo & np.isinf(best.reshape(n, k)).any(1)
        reach[todo] *= 2
    return out


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hashes, how many, words, a hash of all its words, and occurrences."""
    found = W.words(pc.utf8_lower(W.as_strings(column)))
    h = W.hashes(found)
    at, owner = W.inside_texts(found.counts, size)
    grams = W.runs(h, size)[at] if len(at) else np.zeros(0, W.U64)
    n = len(found.counts)
    ends = np.searchsorted(owner, np.arange(n + 1))
    sets = [np.unique(grams[a:b], return_counts=True) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    place = (np.arange(len(h)) - np.repeat(found.offsets[:-1], found.counts)).astype(W.U64)
    folded = W.mix(h + W.mix(place + W.U64(77)))
    whole = np.zeros(n, W.U64)
    some = found.counts > 0
    if some.any():
        whole[some] = W.mix(np.add.reduceat(folded, found.offsets[:-1][some]))
    distinct, times = (np.concatenate([s[i] for s in sets]) if sets else grams for i in (0, 1))
    return distinct, np.array([len(s[0]) for s in sets], int), found.counts, whole, times


def _elements(sets: np.ndarray, times: np.ndarray) -> np.ndarray:
    """An element for each occurrence: sets of those are as similar as the weighted ones."""
    place = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    every = np.repeat(sets, times)
    return np.where(place > 0, W.mix(every ^ W.mix(place.astype(W.U64))), every)


def _signed(batches, counted: bool):
    for batch in batches:
        for piece in W.pieces(pa.Table.from_batches([batch]), "text", PIECE_BYTES, PIECE_TEXTS):
            sets, sizes, counts, whole, times = shingle_sets(piece["text"])
            n = len(sizes)
            owner = np.repeat(np.arange(n), sizes)
            signature = dart_signatures(sets, owner, n, BANDS * ROWS, times.astype(float) if counted else None)
            if counted:
                sizes = np.bincount(owner, times, n).astype(int)
            bands = np.zeros((n, BANDS), W.U64)
            for r in range(ROWS):
                bands = W.mix(bands * W.U64(0xA0761D6478BD642F) + signature[:, r::ROWS])
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]), pa.int32()), pa.array(bands[sizes > 0].reshape(-1).view(np.int64)))
            yield pa.record_batch({"doc_id": piece["doc_id"].combine_chunks(), "text_hash": piece["text_hash"].combine_chunks(), "print": pa.array(whole.view(np.int64), mask=counts == 0), "n": pa.array(sizes, pa.int32()), "bands": flat})
    give_back()


def _sets(batches, counted: bool):
    for batch in batches:
        for piece in W.pieces(pa.Table.from_batches([batch]), "text", 2_000_000):
            sets, sizes, _, whole, times = shingle_sets(piece["text"])
            if counted:
                sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes), times, len(sizes)).astype(int)
                sets = _elements(sets, times)
            ends = np.cumsum(sizes)
            own = whole.view(np.int64) == piece["print"].to_numpy()  # another text may have the same id
            out = pa.table({c: piece[c] for c in ("print", "cluster", "blocks")} | {"shingles": pa.array([sets[b - s : b].tobytes() for b, s in zip(ends, sizes, strict=True)], pa.binary())})
            yield from out.filter(pa.array(own)).to_batches()
    give_back()


def _overlap(flat: np.ndarray, who: np.ndarray, n: int, cut: int | None) -> np.ndarray:
    """How many shingles each two sets share; with ``cut`` only sets below against the others."""
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    size = np.diff(np.append(new, len(flat)))
    shared = np.zeros((n, n) if cut is None else (cut, n - cut))
    left, right = (slice(0, n),) * 2 if cut is None else (slice(0, cut), slice(cut, n))
    for p in range(2, 9):  # short postings: each pair counted by itself
        heads = new[size == p]
        for i in range(p - 1):
            for j in range(i + 1, p):
                a, b = who[heads + i], who[heads + j]
                a, b = np.minimum(a, b), np.maximum(a, b)
                if cut is not None:
                    ok = (a < cut) & (b >= cut)
                    a, b = a[ok], b[ok] - cut
                shared += np.bincount(a * shared.shape[1] + b, minlength=shared.size).reshape(shared.shape) if len(a) else 0
    if cut is None:
        shared += shared.T
    heads, long = new[size > 8], size[size > 8]
    for at in range(0, len(heads), 4096):  # long postings: a product of 0/1 matrices
        s = long[at : at + 4096]
        rows = np.repeat(heads[at : at + 4096] - np.cumsum(s) + s, s) + np.arange(s.sum())
        block = np.zeros((n, len(s)), np.float32)
        block[who[rows], np.repeat(np.arange(len(s)), s)] = 1
        shared += block[left] @ block[right].T
    return shared


def _verified(key: tuple, table: pa.Table) -> pa.Table:
    """Links between the texts of one block, or of two blocks, of a candidate component."""
    home = key[1].as_py() == key[2].as_py()
    table = table.sort_by([("block", "ascending"), ("print", "ascending")])
    ids = table["print"].to_numpy()
    sets = [np.frombuffer(b, np.uint64) for b in table["shingles"].to_pylist()]
    sizes = np.array([len(s) for s in sets], float)
    cut = None if home else int((table["block"].to_numpy() == key[1].as_py()).sum())
    a = b = ids[:0]
    if len(ids) > 1 and cut not in (0, len(ids)):
        shared = _overlap(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes.astype(int)), len(ids), cut)
        rows, columns = (sizes, sizes) if home else (sizes[:cut], sizes[cut:])
        linked = shared >= SIMILARITY * (rows[:, None] + columns[None, :] - shared) - 1e-9
        linked &= shared > 0
        if home:
            np.fill_diagonal(linked, False)
        a, b = spanning_links(linked, ids) if home else spanning_links(linked, ids[:cut], ids[cut:])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counted: bool = COUNTED) -> DataFrame:
    """Group documents whose five-word shingles have a Jaccard similarity of 0.8 or more.

    With ``counted`` the similarity is the weighted one: the sum of the lesser numbers of
    occurrences over that of the greater. Without, every shingle weighs 1.

    Returns ``doc_id, component_id, kept, group, text_hash`` for each input row:
    ``component_id`` is the smallest id of the group, ``kept`` is true for the rows with that
    id, ``group`` numbers the groups. Groups are closed under links. Texts with the same
    words (a 64-bit hash of the sequence) are copies.

    Null texts and texts without a word are alone in their group (``group`` null). Texts of
    one to four words have no shingle and group with equal ones only. Rows with a null id
    take part; they are kept only where a group has no other id. Equal rows are all kept or
    all not. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.col(f"`{text_col}`").cast("string")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    signed = checkpointed(base.mapInArrow(lambda batches: _signed(batches, counted), "doc_id long, text_hash long, print long, n int, bands array<long>"))
    texts = signed.where("print is not null").groupBy("print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("least"), F.max("n").alias("n"))
    buckets = signed.where("print is not null and n > 0").select("print", F.posexplode("bands").alias("band", "bucket"))
    hubs = buckets.groupBy("band", "bucket").agg(F.min("print").alias("a"), F.max("print").alias("z")).where("a <> z").drop("z")
    candidates = buckets.join(hubs, ["band", "bucket"]).where("print <> a").select("a", F.col("print").alias("b")).distinct()
    clusters = connected_components(candidates)

    sized = clusters.join(texts, clusters["node"] == texts["print"]).select("print", "least.doc_id", "component", "n")
    blocks = sized.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    chosen = sized.join(blocks, "component").select("print", "doc_id", F.col("component").alias("cluster"), "blocks")
    # any one row of a text will do: it is found by its id, then by its own print
    readable = base.join(chosen, base["doc_id"].eqNullSafe(chosen["doc_id"])).select(chosen["print"], "cluster", "blocks", "text")
    sets = readable.mapInArrow(lambda batches: _sets(batches, counted), "print long, cluster long, blocks int, shingles binary")
    block = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    dealt = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("print", "cluster", "block", "shingles", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    links = dealt.groupBy("cluster", "i", "j").applyInArrow(_verified, "a long, b long")
    groups = connected_components(links)

    labelled = texts.join(groups, texts["print"] == groups["node"], "left").select("print", F.coalesce("component", "print").alias("group"), "least")
    smallest = labelled.groupBy("group").agg(F.min("least").getField("doc_id").alias("component_id"))
    named = labelled.join(smallest, "group").select("print", "group", "component_id")
    found = signed.select("doc_id", "text_hash", "print").join(named, "print", "left")
    component = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "group", "text_hash")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each group: that of the smallest id.

    Null texts and texts without a word all stay; of equal rows with a word one stays. Of
    rows that share the smallest id but not the text, the one with the smaller hash stays.
    Rows are carried as one struct, so that no name of a column can clash.
    """
    found = near_duplicates(docs, id_col, text_col).where("kept")
    rows = found.groupBy("group", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = rows.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("r")).select("r.*")
    stay = checkpointed(first.unionByName(rows.where("group is null").select("doc_id", "text_hash", F.lit(1).cast("long").alias("n"))))
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("hash"))
    key = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    if stay.where("n > 1").isEmpty():
        return carried.join(stay, key, "left_semi").select("row.*")
    once = carried.join(stay.where("n = 1"), key, "left_semi").select("row")
    several = carried.join(stay.where("n > 1"), key).groupBy("id", "hash").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(several).select("row.*")
