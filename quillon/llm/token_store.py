"""Token-id files: separately compressed documents behind a shared zstandard dictionary.

A dictionary is trained on the serialized id arrays of a bounded sample of documents and
kept, under its hash, beside the shards. A shard is one binary image::

    "QTS1" | sha-256 of the dictionary | id width | number of documents n
    n x (id of the document, has one, start of its frame, length, number of ids)
    frames: each document's ids, compressed alone with the dictionary

so any document is read by its index entry, its frame and the dictionary, without touching
its neighbours. Images are written by Spark into a folder that all executors share, a row
each, in ascending order of document ids: shard ``n`` holds smaller ids than ``n + 1``.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import wordhash as W
from .cluster import checkpointed, give_back, width
from .word_encoder import encoder

MAGIC, HEAD, ENTRY = b"QTS1", struct.Struct("<4s32sBQ"), np.dtype([("doc", "<i8"), ("has", "<u1"), ("at", "<u8"), ("size", "<u4"), ("ids", "<u8")])
#: Documents that train the dictionary and bytes that each may have, its size, and bytes of text in a shard, about.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES, SHARD_BYTES = 600, 20_000, 32_768, 4_000_000
LEVEL = 3


def _id_type(largest: int) -> np.dtype:
    return np.dtype("<u2" if largest < 2**16 else "<u4")


def pack(docs: list[tuple[int | None, bytes]], dictionary: bytes, width_: int) -> bytes:
    """The image of one shard; ``docs`` are ids of documents and their serialized arrays."""
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=True)
    frames = [squeeze.compress(ids) for _, ids in docs]
    index = np.zeros(len(docs), ENTRY)
    index["doc"] = [0 if d is None else d for d, _ in docs]
    index["has"] = [d is not None for d, _ in docs]
    index["size"] = [len(f) for f in frames]
    index["at"] = np.cumsum(index["size"], dtype=np.uint64) - index["size"]
    index["ids"] = [len(i) // width_ for _, i in docs]
    return HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest(), width_, len(docs)) + index.tobytes() + b"".join(frames)


class Shard:
    """Reads documents out of an image; refuses another dictionary than the one it names."""

    def __init__(self, image: bytes, dictionary: bytes):
        magic, digest, self.width, n = HEAD.unpack_from(image)
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a shard of this dictionary")
        self.index = np.frombuffer(image, ENTRY, n, HEAD.size)
        self.image, self.base = image, HEAD.size + n * ENTRY.itemsize
        self.loosen = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, i: int) -> np.ndarray:
        e = self.index[i]
        frame = self.image[self.base + int(e["at"]) : self.base + int(e["at"]) + int(e["size"])]
        return np.frombuffer(self.loosen.decompress(frame, max_output_size=max(1, int(e["ids"]) * self.width)), f"<u{self.width}").astype("<u4")


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary from the SAMPLE_DOCS whole documents with the smallest hash of their id.

    Drawn are documents of up to SAMPLE_BYTES, for it is short ones that a dictionary helps;
    longer ones are written like all others. Too few or too small samples give an empty dictionary: frames then stand alone.
    """
    keyed = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES).select(F.struct(F.xxhash64("doc_id").alias("a"), F.xxhash64("text").alias("b")).alias("k"), "text")
    # the keys alone are sorted first, so that no partition sends SAMPLE_DOCS texts
    last = keyed.select("k").orderBy("k").limit(SAMPLE_DOCS).agg(F.max("k").alias("k")).first()["k"]
    if last is None:
        return b""
    within = keyed.where((F.col("k.a") < last["a"]) | (F.col("k.a") == last["a"]) & (F.col("k.b") <= last["b"]))
    chosen = within.select("k", "text").orderBy("k").limit(SAMPLE_DOCS).collect()
    encode = encoder(tokenizer)
    kind = _id_type(max(encode.size, end_id))
    end = np.array([end_id], kind).tobytes()
    samples = [encode.serialized(r["text"].encode(), kind) + end for r in chosen]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> None:
    """Encode whole texts, end each with ``end_id``, and write shards to ``path``.

    Null texts are empty: they hold the end id only. Documents stand in ascending order of
    their id, null ids first, rows that share an id by the hash of their text. An empty
    table writes a dictionary and no shard. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dictionary = train_dictionary(base, tokenizer, end_id)
    spark = docs.sparkSession
    spark.sql("select 1").select(F.lit(bytearray(dictionary)).alias("dictionary"), F.lit(hashlib.sha256(dictionary).hexdigest()).alias("sha256")).write.parquet(f"{path}/dictionary")

    def shards(batches):
        import itertools

        encode = encoder(tokenizer)
        kind = _id_type(max(encode.size, end_id))
        end = np.array([end_id], kind).tobytes()
        held, size, first = [], 0, None

        def image():
            return pa.record_batch({"first": pa.array([first], pa.int64()), "part": pa.array([next(number)], pa.int32()), "n_ids": pa.array([sum(len(i) for _, i in held) // kind.itemsize], pa.int64()), "image": pa.array([pack(held, dictionary, kind.itemsize)], pa.large_binary())})

        number = itertools.count()
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), W.as_strings(batch["text"]), strict=True):
                body = text.as_buffer().to_pybytes()
                first = doc if not held else first
                held.append((doc, encode.serialized(body, kind) + end))
                size += len(body)
                if size >= SHARD_BYTES:
                    yield image()
                    held, size = [], 0
        if held:
            yield image()
        del held
        give_back()

    ordered = base.repartitionByRange(width(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(shards, "first long, part int, n_ids long, image binary").write.option("compression", "uncompressed").parquet(f"{path}/shards")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents in the files at ``path``: ``doc_id, start, n_tokens, ids_crc32, ids``.

    ``start`` counts the ids of all documents before this one, ``ids`` are little-endian
    unsigned 32-bit integers. A folder without shards gives no rows.
    """
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    images = spark.read.parquet(f"{path}/shards")
    # shards stand in order in a file and files in order of their ids: only sums of whole
    # files, a row for each partition that has written one, meet in one task
    named = images.select("first", "part", "n_ids", F.col("_metadata.file_name").alias("file"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    files = named.groupBy("file").agg(F.sum("n_ids").alias("n"), F.min(F.struct("part", "first")).getField("first").alias("first"))
    files = files.select("file", F.coalesce(F.sum("n").over(before.orderBy(F.col("first").asc_nulls_first(), "file")), F.lit(0)).alias("ahead"))
    inside = named.select("file", "part", F.coalesce(F.sum("n_ids").over(before.partitionBy("file").orderBy("part")), F.lit(0)).alias("inside"))
    starts = inside.join(files, "file").select("file", "part", (F.col("inside") + F.col("ahead")).alias("base"))
    placed = images.select("part", "image", F.col("_metadata.file_name").alias("file")).join(starts, ["file", "part"])

    def rows(batches):
        for batch in batches:
            for row in range(batch.num_rows):  # one image at a time
                base, shard = batch["base"][row].as_py(), Shard(batch["image"][row].as_py(), dictionary)
                ids = [shard.ids(i) for i in range(len(shard))]
                n = np.array([len(i) for i in ids], np.int64)
                yield pa.record_batch({"doc_id": pa.array(shard.index["doc"], mask=shard.index["has"] == 0), "start": pa.array(base + np.cumsum(n) - n), "n_tokens": pa.array(n), "ids_crc32": pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()), "ids": pa.array([i.tobytes() for i in ids], pa.binary())})
        give_back()

    return placed.select("base", "image").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster shares."""
    checkpointed(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
