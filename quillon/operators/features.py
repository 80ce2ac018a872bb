"""Vectors out of files: extractors, word histograms, weights fitted on a collection, and its loading.

An extractor turns a file into local descriptors, a codebook turns those into word counts,
and a model fitted on a table's files weighs the counts. The vectors go into the table's one
VECTOR column; the model stays with the table, so that a query by file is weighed alike.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
from abc import ABC, abstractmethod
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


class Extractor(ABC):
    """What a file holds: an array of ``dimension`` columns, a row for each descriptor found.

    Instances go to the tasks, so they are small and can be pickled.
    """

    descriptor_id: str
    dimension: int

    @abstractmethod
    def extract(self, path: str) -> np.ndarray:
        """Descriptors of one file; no row if there is nothing in it."""


class NumbersExtractor(Extractor):
    """Descriptors written as text: a row for each line, numbers between blanks."""

    def __init__(self, dimension: int, descriptor_id: str = "numbers"):
        self.dimension, self.descriptor_id = dimension, descriptor_id

    def extract(self, path: str) -> np.ndarray:
        with open(path, encoding="utf-8") as file:
            rows = [[float(x) for x in line.split()] for line in file if line.strip()]
        return np.array(rows, float).reshape(len(rows), self.dimension)


class ImageExtractor(Extractor):
    """SIFT descriptors of an image no larger than ``side``; needs OpenCV, which is optional."""

    descriptor_id, dimension = "sift", 128

    def __init__(self, side: int = 512, most: int = 500):
        self.side, self.most = side, most

    def extract(self, path: str) -> np.ndarray:
        import cv2

        image = cv2.imread(path, cv2.IMREAD_GRAYSCALE)
        if image is None:
            raise ValueError(f"{path} is no image")
        scale = self.side / max(image.shape)
        if scale < 1:
            image = cv2.resize(image, None, fx=scale, fy=scale, interpolation=cv2.INTER_AREA)
        found = cv2.SIFT_create(nfeatures=self.most).detectAndCompute(image, None)[1]
        return np.zeros((0, self.dimension)) if found is None else found[: self.most]


class AudioExtractor(Extractor):
    """MFCC of a recording, without the loudness coefficient; needs librosa, which is optional."""

    descriptor_id, dimension = "mfcc", 12

    def __init__(self, rate: int = 22_050, window: int = 2048, hop: int = 512):
        self.rate, self.window, self.hop = rate, window, hop

    def extract(self, path: str) -> np.ndarray:
        import librosa

        sound, _ = librosa.load(path, sr=self.rate, mono=True)
        if len(sound) < self.window or not np.any(sound):
            return np.zeros((0, self.dimension))
        return librosa.feature.mfcc(y=sound, sr=self.rate, n_mfcc=self.dimension + 1, n_fft=self.window, hop_length=self.hop)[1:].T


class SongExtractor(Extractor):
    """Timbre segments of a song's HDF5 file; needs h5py, which is optional."""

    descriptor_id, dimension = "timbre", 12

    def extract(self, path: str) -> np.ndarray:
        import h5py

        with h5py.File(path, "r") as file:
            if len(file["metadata/songs"]) != 1:
                raise ValueError(f"{path} holds more than one song")
            return np.array(file["analysis/segments_timbre"], float).reshape(-1, self.dimension)


def safe_path(root: str, path: str) -> str:
    """The real path of a file below ``root``; ValueError if it lies elsewhere or isn't there."""
    base = os.path.realpath(root)
    whole = os.path.realpath(os.path.join(base, path))
    if os.path.commonpath([base, whole]) != base:
        raise ValueError(f"{path} lies outside the folder of files")
    if not os.path.isfile(whole):
        raise ValueError(f"there is no file {path}")
    return whole


def word_counts(descriptors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """How many descriptors are nearest to each centre; ties go to the first."""
    x = np.asarray(descriptors, float).reshape(-1, centres.shape[1])
    if not np.isfinite(x).all():
        raise ValueError("a descriptor is not finite")
    return np.bincount(((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1), minlength=len(centres))


@dataclass
class Weights:
    """``ln(files / files with the word)`` for each word (0 for words never met), and how counts enter."""

    files: int
    held: list[int]
    vocabulary_id: str
    sublinear: bool = False

    def vector(self, counts: np.ndarray) -> list[float]:
        counts = np.asarray(counts, float)
        if counts.shape != (len(self.held),) or (counts < 0).any():
            raise ValueError(f"a histogram has {len(self.held)} counts, none negative")
        idf = np.array([math.log(self.files / h) if h else 0.0 for h in self.held])
        tf = np.log1p(counts) if self.sublinear else counts / max(counts.sum(), 1)
        return (tf * idf).astype(np.float32).tolist()


def fitted(histograms: DataFrame, counts: str, vocabulary_id: str = "", sublinear: bool = False) -> Weights:
    """Weights of a frame with a row of counts (an array) for each file; one row of sums moves."""
    wide = histograms.select(F.max(F.size(counts))).first()[0]
    if wide is None:
        raise ValueError("there is no histogram to fit")
    row = histograms.agg(F.count("*").alias("n"), F.array(*[F.count_if(F.col(counts)[i] > 0) for i in range(wide)]).alias("held")).first()
    return Weights(row["n"], list(row["held"]), vocabulary_id, sublinear)


class Collections:
    """Extractors by their descriptor, each with a codebook, over files below one folder that all machines see."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.known: dict[str, tuple[Extractor, np.ndarray, str]] = {}
        self.models: dict[str, Weights] = {}

    def register(self, extractor: Extractor, centres, descriptor_id: str | None = None) -> str:
        """Add an extractor with the centres of its words; the id of the vocabulary."""
        centres = np.asarray(centres, np.float32).astype(float)
        if (descriptor_id or extractor.descriptor_id) != extractor.descriptor_id:
            raise ValueError(f"the codebook is not one of {extractor.descriptor_id} descriptors")
        if centres.ndim != 2 or not len(centres) or centres.shape[1] != extractor.dimension:
            raise ValueError(f"a codebook has centres of {extractor.dimension} numbers")
        vocabulary = hashlib.sha256(extractor.descriptor_id.encode() + centres.tobytes()).hexdigest()
        self.known[extractor.descriptor_id] = (extractor, centres, vocabulary)
        return vocabulary

    def available(self) -> list[dict]:
        return [{"descriptor_id": d, "descriptor_dimension": e.dimension, "dimension": len(c), "vocabulary_id": v} for d, (e, c, v) in sorted(self.known.items())]

    def histograms(self, rows: DataFrame, key: str, path: str, descriptor_id: str) -> DataFrame:
        """``key, counts`` of the rows with a path; a file that can't be read fails the job."""
        if descriptor_id not in self.known:
            raise ValueError(f"no extractor is registered for {descriptor_id}")
        (extractor, centres, _), root = self.known[descriptor_id], self.root

        def count(batches):
            for batch in batches:
                made = [word_counts(extractor.extract(safe_path(root, p)), centres).tolist() for p in batch["path"].to_pylist()]
                yield pa.record_batch({"key": batch["key"], "counts": pa.array(made, pa.list_(pa.int64()))})

        some = rows.where(F.col(path).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(path).alias("path"))
        return some.mapInArrow(count, "key long, counts array<long>")

    def load(self, engine, table: str, path: str, descriptor_id: str) -> int:
        """Fill the table's VECTOR column from the files that ``path`` names; how many were loaded.

        Rows without a path keep their vector. The model is fitted on the files loaded.
        """
        from quillon.plans.engine import RID

        known = engine._managed(table)
        columns = [c for c in known.columns if c["type"] == "VECTOR"]
        if len(columns) != 1:
            raise ValueError(f"{table} must have one VECTOR column")
        if known.column(path)["type"] not in ("VARCHAR", "TEXT"):
            raise ValueError(f"{path} must be a text column")
        found = self.histograms(known.frame, RID, path, descriptor_id)
        _, centres, vocabulary = self.known[descriptor_id]
        if len(centres) != columns[0]["size"]:
            raise ValueError(f"the codebook has {len(centres)} words, the column {columns[0]['size']} numbers")
        held = f"{known.folder}/counts-v{known.version}"
        found.write.mode("overwrite").parquet(held)
        found = self.spark.read.parquet(held)
        if found.isEmpty():
            raise ValueError(f"{table} has no files to load")
        model = fitted(found, "counts", vocabulary)
        idf = F.array(*[F.lit(math.log(model.files / h) if h else 0.0) for h in model.held])
        total = F.greatest(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x), F.lit(1))
        vector = F.zip_with("counts", idf, lambda n, w: (n / total * w).cast("float"))
        n = engine.replace_vectors(known, columns[0]["name"], found.select(F.col("key").alias(RID), vector.alias("_new")))
        engine._emptied(held)
        self.models[table] = model
        return n

    def vectorize(self, table: str, path: str) -> list[float]:
        """The vector of a file as the table's collection was loaded; for ``Engine(vectorizer=...)``."""
        model = self.models.get(table)
        if model is None:
            raise ValueError(f"{table} has no features loaded; use SIMILAR_TO(VECTOR(...), k=...)")
        owner = next(((e, c) for e, c, v in self.known.values() if v == model.vocabulary_id), None)
        if owner is None:
            raise ValueError(f"the codebook that {table} was loaded with is not registered")
        return model.vector(word_counts(owner[0].extract(safe_path(self.root, path)), owner[1]))

    def save(self, path: str) -> None:
        """Write the models to a new folder through Spark."""
        text = json.dumps({t: vars(m) for t, m in self.models.items()}, sort_keys=True)
        self.spark.sql("select 1").select(F.lit(text).alias("value")).write.text(path)

    def open(self, path: str) -> None:
        self.models = {t: Weights(**m) for t, m in json.loads(self.spark.read.text(path).first()["value"]).items()}
