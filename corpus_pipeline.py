"""A corpus pipeline: language, near duplicates, benchmark passages, mixing, token files.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before has kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import decontaminate, language_id, mixing, near_dedup, queries, token_store

#: A text has to speak for its language more than one that tells nothing, which has margin 0.
LEAST_MARGIN = 0.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those that speak for no learned language, go.

    Null and empty texts have no letter. Equal rows all stay or all go. Where no row has a
    language nothing can be learned, and all texts with a letter stay. No row gives none.
    """
    model = language_id.learn(docs.select("doc_id", "text", "lang"), F.lit(True))
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language_id.identify(docs, model, carry=True)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("margin") > LEAST_MARGIN)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id.

    Null texts and texts without a word all stay; of equal rows one stays; among rows that
    share the smallest id the one with the smaller text hash. No row gives none.
    """
    return near_dedup.without_near_duplicates(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and short texts stay, as do all where there is no item. Equal rows go or stay alike.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them, twice at most.

    A null source is one like others, null texts have no size. Equal rows are drawn one by
    one. No row gives none.
    """
    return mixing.mixed(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder, and what they hold for each document.

    Null texts hold the end id only; null ids come first; equal rows are documents each.
    """
    path = token_store.shared_folder(spark, "corpus")
    token_store.write_tokens(docs, path, queries.tokenizer_path(), end_id=queries.END_ID)
    return token_store.read_tokens(spark, path).drop("ids")


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_passages),
    ("mix", mix_sources),
    ("tokens", write_token_files),
]

#: No stage but the mix can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``.

    What a stage keeps is a table in the shared folder until the next stage has written its
    own; then the folder is emptied.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = token_store.shared_folder(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        else:
            path = None  # the last stage has written its files; its rows come from there
        if before is not None:
            spark.createDataFrame([], "gone int").write.mode("overwrite").parquet(before)
        before = path
    return docs
