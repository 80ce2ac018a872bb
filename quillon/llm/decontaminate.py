"""Benchmark decontamination: size-partitioned MinHash containment search, exact check after.

A MinHash of a whole long document says nothing of a short item in it, so a document's side
of the search is no sketch of its own: all its hashes are held against the items' sketches,
whose size goes by the size of the item. An item of ``n`` shingles keeps its smallest
hashes: ``floor(n / 5)``, the fifth that containment lets a document lack, and ``hits`` more,
REST of ``n`` but at least one (short items) and at most HITS (long ones). A document that
holds the item lacks no more than that fifth, so it meets at least ``hits`` hashes of the
sketch, wherever the item lies and however long the document is: nothing is lost. Documents
that meet ``hits`` are candidates; they are verified exactly, shingle by shingle, as words.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .cluster import checkpointed

SHINGLE, CONTAINMENT = 5, 0.8
#: Hashes of a sketch that a document must meet: a share of an item's shingles, and a bound.
REST, HITS = 0.2, 16
#: Shingles of the items up to which they are sent to every task, about 100 MB.
SENT = 1_000_000
WORDS = [f"w{i}" for i in range(SHINGLE)]


def _words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingles(df: DataFrame, words: Column, *keep: str) -> DataFrame:
    """A row for each run of SHINGLE words: the words, and ``h``, their hash."""
    cut = df.select(*keep, words.alias("_w")).where(F.size("_w") >= SHINGLE)
    shifted = [F.slice("_w", i + 1, F.size("_w") - (SHINGLE - 1)) for i in range(SHINGLE)]
    rows = cut.select(*keep, F.inline(F.arrays_zip(*[s.alias(w) for s, w in zip(shifted, WORDS, strict=True)])))
    return rows.toDF(*keep, *WORDS).withColumn("h", F.xxhash64(*WORDS).bitwiseAND(F.lit(2**63 - 1)))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Sent to every task only when its counted size allows it; joined by shuffling beyond."""
    return F.broadcast(df) if rows <= SENT else df


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that hold 80 % of the distinct five-word shingles of an item.

    Returns ``doc_id, text_hash, item_id, n_shared, n_shingles``, a row for each pair of a
    document text and an item. Words are runs of letters and digits in lower case, so case,
    punctuation and spacing don't matter.

    Null and empty texts and those of under five words match nothing, as documents and as
    items. Equal rows give one row; rows that share an id are told apart by ``text_hash``
    (``xxhash64`` of the text). Items that share an id are one item with all their shingles.
    Null ids take part. Other columns are ignored; empty tables give an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    named = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    wanted = _shingles(named, _words(F.col("text")), "item_id").distinct()
    lacking = F.floor((1 - CONTAINMENT) * F.col("n") + 1e-9)
    hits = F.greatest(F.lit(1), F.least(F.lit(HITS), F.floor(F.col("n") * REST))).cast("long")
    item = Window.partitionBy("item_id")
    sized = wanted.withColumn("n", F.count("*").over(item)).withColumn("hits", hits)
    wanted = checkpointed(sized.withColumn("size", F.least(F.col("n"), lacking + F.col("hits"))))
    place = F.row_number().over(item.orderBy("h", *WORDS))
    sketch = checkpointed(wanted.withColumn("place", place).where(F.col("place") <= F.col("size")).groupBy("item_id", "h").agg(F.count("*").alias("met"), F.first("hits").alias("hits")))
    n_sketch, widest = sketch.agg(F.count("*"), F.coalesce(F.max("h"), F.lit(-1))).first()
    n_wanted = wanted.count()

    hashed = _shingles(base, _words(F.col("text")), "doc_id", "text_hash").select("doc_id", "text_hash", "h").where(F.col("h") <= F.lit(widest))
    met = hashed.join(_small(sketch, n_sketch), "h").groupBy("doc_id", "text_hash", "item_id", "met", "hits", "h").agg(F.lit(1).alias("one"))
    pairs = met.groupBy("doc_id", "text_hash", "item_id").agg(F.sum("met").alias("shared"), F.first("hits").alias("hits")).where("shared >= hits")
    pairs = checkpointed(pairs.select("doc_id", "text_hash", "item_id"))

    suspects = pairs.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct()
    read = base.join(suspects, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    held = _shingles(read, _words(F.col("text")), "doc_id", "text_hash").drop("h")
    shared = held.join(_small(wanted.select("item_id", "n", *WORDS), n_wanted), WORDS).groupBy("doc_id", "text_hash", "item_id", "n", *WORDS).agg(F.lit(1).alias("one"))
    counted = shared.groupBy("doc_id", "text_hash", "item_id").agg(F.count("*").alias("n_shared"), F.first("n").alias("n_shingles"))
    verified = counted.where(F.col("n_shared") >= CONTAINMENT * F.col("n_shingles") - 1e-9)
    a, b = verified.alias("a"), pairs.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")) & F.col("a.item_id").eqNullSafe(F.col("b.item_id"))
    return a.join(b, same, "left_semi")


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that hold an item.

    Null and short texts stay. Rows are carried as one struct, so that no name can clash.
    """
    found = contaminated(docs, items, id_col, text_col).select("doc_id", "text_hash").distinct()
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("hash"))
    key = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    return carried.join(found, key, "left_anti").select("row.*")
