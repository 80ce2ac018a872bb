"""Mixing sources to target weights by systematic sampling.

A source's target of words is shared out by weight and stops at MOST times the source's
size. Each document of a source expects ``target / size of the source`` copies, or that times
its own factor (``factor_col``). Along a fixed order the expected copies are summed up, one
random offset is added for the source, and a document is emitted once for each whole number
that its step crosses. Expected copies are whole numbers of UNITths, so that sums are exact
in whatever order and however they are parted.

The order is by size, id and print in every source, so neighbours are alike and the words
taken come near the target. A source of over CHUNK rows is summed in ranges of that order, so
that a hot source is many tasks: ranges are parted by keys that a hash draws from the
source's own rows, of about CHUNK rows or a PARTSth of the source; a prefix sum is the one in
the range plus the sums of the ranges before, which are made beforehand.

Sources meet in one task, a row each of about 60 bytes, where targets are shared out.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .cluster import checkpointed

WEIGHTS, SHARE, MOST, CHUNK, SEED = (5, 2, 1), 1.5, 2, 5_000, "mix-1"
#: Parts of a copy that expected copies are counted in: sums stay below 2^63 up to 2e11 documents.
UNIT = 1 << 24
#: Ranges of a source at most, and keys drawn for each range, of which one is taken.
PARTS, DRAWN = 1_000, 8
#: Sources, and chunks, up to which their sums are sent to every task (some 10 MB).
SENT = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _share(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Targets: ``weight * level``, stopped at ``most`` times the size; one level for all.

    With sources in the order in which they stop, ``level`` is what is left over for a unit
    of weight when all before have stopped; it is highest at the first that doesn't stop.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).cast("double")
    weighed = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(most))
    stops = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(stops.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(stops.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * share
    level = F.max("level").over(Window.partitionBy())
    return weighed.withColumn("level", (total - before) / left).withColumn("target", F.least(F.col("most"), level * F.col("weight"))).select("source", "source_size", "source_rows", "wanted", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED, carry: bool = False, factor_col: str | None = None) -> DataFrame:
    """How often the mix takes each document: ``doc_id, size, source, source_size, target, copies``.

    ``size`` counts words; the words taken are ``size * copies``. ``carry`` adds the input
    row as the struct ``row``. ``factor_col`` names numbers from 0 to 1e6 by which documents
    are wanted more or less than others of their source (null, negative or no number: 0); a
    document still stands ``most`` times at most, and what that cuts is not shared again.
    Reruns agree, whatever the partitions.

    Null texts have size 0; a null source is a source of its own, after all others; a source
    without a word takes nothing. Documents of size 0 are drawn like others. Equal rows are
    drawn one by one; null ids come first among equals. Names can't clash, for other columns
    are only carried inside ``row``. An empty table gives an empty result.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    text = F.col(f"`{text_col}`").cast("string")
    factor = F.lit(1.0) if factor_col is None else F.coalesce(F.when(F.col(f"`{factor_col}`").cast("double").between(0, 1e6), F.col(f"`{factor_col}`").cast("double")), F.lit(0.0))
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), word_count(text).alias("size"), F.col(f"`{source_col}`").cast("string").alias("source"), F.md5(F.coalesce(text, F.lit(""))).alias("print"), factor.alias("factor"), *row)
    light = checkpointed(base.select("doc_id", "size", "source", "print", "factor"))
    base = base if carry else light
    sources = _share(light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"), F.sum(F.col("size") * F.col("factor")).alias("wanted")), weights, share, most)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))), 1, 6), 16, 10).cast("long")
    rate = F.when(F.col("wanted") > 0, F.col("target") / F.col("wanted")).otherwise(0.0)
    step = F.floor(F.least(F.col("rate") * F.col("factor"), F.lit(float(most))) * UNIT + 0.5).cast("long")
    sources = sources.withColumn("rate", rate).withColumn("offset", offset)
    # a struct's order has no nulls in it
    key = F.struct("size", F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "print")
    large = sources.where(F.col("source_rows") > CHUNK).select(F.col("source").alias("_source"), F.greatest(F.lit(CHUNK / DRAWN), F.col("source_rows") / (PARTS * DRAWN)).alias("every"))
    draw = F.pmod(F.xxhash64("doc_id", "size", "print"), F.lit(1 << 40)) < F.lit(float(1 << 40)) / F.col("every")
    drawn = light.join(F.broadcast(large) if large.count() <= SENT else large, F.col("source").eqNullSafe(F.col("_source"))).where(draw)
    keys = F.filter(F.sort_array(F.collect_set(key)), lambda _, i: i % DRAWN == DRAWN - 1)
    parted = checkpointed(drawn.groupBy("_source").agg(keys.alias("keys")))
    sources = sources.join(parted, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    sent = sources if sources.count() + (parted.agg(F.sum(F.size("keys"))).first()[0] or 0) > SENT else F.broadcast(sources)
    chunk = F.when(F.col("keys").isNull(), 0).otherwise(F.size(F.filter("keys", lambda k: k <= key)))

    def placed(df: DataFrame) -> DataFrame:
        joined = df.join(sent.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        return joined.withColumn("chunk", chunk).drop("keys")

    counts = placed(light).groupBy("source", "chunk").agg(F.sum(step).alias("n"))
    ahead = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("source").alias("_source"), F.col("chunk").alias("_chunk"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    order = Window.partitionBy("source", "chunk").orderBy("size", F.col("doc_id").asc_nulls_first(), "print", "factor").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed(base).withColumn("step", step).withColumn("sum", F.sum("step").over(order))
    ranked = ranked.join(starts if starts.count() > SENT else F.broadcast(starts), F.col("source").eqNullSafe(F.col("_source")) & (F.col("chunk") == F.col("_chunk")))
    crossed = F.expr(f"(sum + ahead + offset) div {UNIT}") - F.expr(f"(sum - step + ahead + offset) div {UNIT}")
    return ranked.select("doc_id", "size", "source", "source_size", "target", F.least(crossed, F.lit(most)).cast("long").alias("copies"), *(["row"] if carry else []))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, each as often as it is taken."""
    taken = mix(docs, carry=True, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("row.*")
