"""Language identification with string kernels, Nystroem landmarks and kernel ridge regression.

A text is the set of its byte n-grams, n = 1 to 3, of lower-case letters (all else is one
blank): a blended spectrum, by presence. The kernel of two texts is the number of n-grams
that both hold over the root of the product of their numbers (n-grams fall into FEATURES
hashed cells). Landmarks are learned texts; the kernel to them, whitened by the landmarks'
own kernel, gives Nystroem features, on which one ridge regression for each language
against the rest is solved. A batch of texts is scored by matrix products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import wordhash as W
from .cluster import give_back

SPECTRUM, FEATURES = 3, 1 << 14
#: Bounds of the sample that is learned from, and of the landmarks in it.
SAMPLE, LANDMARKS, PER_LANGUAGE = 2_000, 128, 16
RIDGE, SHARPNESS, ROWS = 1e-2, 8.0, 128
#: Bytes of text that are looked at together, in one or in several texts.
SPAN = 1 << 20
UNDETERMINED = "und"

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not 97 <= b <= 122]] = 32


def presence(column) -> np.ndarray:
    """Which hashed n-grams each text holds: a 0/1 matrix, texts by FEATURES."""
    data, offsets = W.raw(pc.utf8_lower(W.as_strings(column)))
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES), np.float32)
    flat = out.reshape(-1)
    for a in range(0, len(data), SPAN):
        # n-grams that reach into a span begin in the bytes before it; presence can be set twice
        a, b = max(0, a - SPECTRUM + 1), min(len(data), a + SPAN)
        part = _PLAIN[data[a:b]].astype(np.uint32)
        owner = np.repeat(np.arange(n, dtype=np.int64) * FEATURES, np.diff(np.clip(offsets, a, b)))
        gram = np.zeros(len(part), np.uint32)
        for k in range(1, SPECTRUM + 1):
            gram = gram[: len(part) - k + 1] * np.uint32(256) + part[k - 1 :]
            if not len(gram):
                break
            cell = ((gram + np.uint32(k << 24)) * np.uint32(2654435761)) >> np.uint32(18)
            inside = owner[: len(gram)] == owner[k - 1 :]
            flat[(owner[: len(gram)] + cell)[inside]] = 1
    return out


def _scaled(held: np.ndarray) -> np.ndarray:
    return held / np.sqrt(np.maximum(held.sum(1, keepdims=True), 1))


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # FEATURES by landmarks
    weights: np.ndarray  # landmarks by languages, whitening included
    offset: np.ndarray

    def scores(self, column) -> np.ndarray:
        return (_scaled(presence(column)) @ self.landmarks) @ self.weights + self.offset


def fit(held: np.ndarray, languages: list[str]) -> Model:
    """Learn from the n-grams of texts (packed rows of ``presence``) in given order.

    The first texts of each language are its landmarks: an equal share of LANDMARKS, but two.
    """
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    y = np.array([names.index(x) for x in languages])

    def rows(at) -> np.ndarray:
        return _scaled(np.unpackbits(held[at], axis=1).astype(np.float32))

    chosen = np.concatenate([np.flatnonzero(y == i)[: max(2, LANDMARKS // len(names))] for i in range(len(names))])
    landmarks = rows(chosen).T.copy()
    value, vector = np.linalg.eigh((landmarks.T @ landmarks).astype(float))
    white = vector / np.sqrt(np.maximum(value, 1e-6))
    # the driver holds the n-grams of ROWS texts at a time, as the tasks do
    phi = np.concatenate([(rows(slice(i, i + ROWS)) @ landmarks).astype(float) @ white for i in range(0, len(y), ROWS)])
    mean = phi.mean(0)
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = 1.0 / np.bincount(y, minlength=len(names))[y]  # each language counts alike
    weight *= len(y) / weight.sum()
    centred = phi - mean
    shift = (weight[:, None] * target).sum(0) / weight.sum()
    w = np.linalg.solve((centred * weight[:, None]).T @ centred + RIDGE * len(y) * np.eye(phi.shape[1]), (centred * weight[:, None]).T @ (target - shift))
    return Model(names, landmarks, (white @ w).astype(np.float32), (shift - mean @ w).astype(np.float32))


def learn(docs: DataFrame, learnable: Column) -> Model:
    """Fit on the whole texts of at most SAMPLE rows of ``doc_id, text, lang`` where ``learnable`` holds.

    Rows are drawn by a hash of their id, rarer languages with more weight, so that each
    language has its share; with many languages the bound is PER_LANGUAGE rows for each. The
    tasks make the n-grams: the driver gets FEATURES bits for a row, however long its text.
    """
    usable = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"))
    chance = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) + 1) / float(1 << 40)
    # one row for each language, and sent only while languages are as few as they are
    n_languages = sizes.count()
    sizes = F.broadcast(sizes) if n_languages <= 10_000 else sizes
    drawn = usable.join(sizes, "lang").withColumn("turn", -F.log(chance) * F.col("n"))
    sample = max(SAMPLE, PER_LANGUAGE * n_languages)
    last = drawn.select("turn").orderBy("turn").limit(sample).agg(F.max("turn")).first()[0]

    def grams(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                bits = np.packbits(presence(part["text"]).astype(bool), axis=1)
                yield pa.record_batch({"lang": part["lang"], "turn": part["turn"], "held": pa.array([b.tobytes() for b in bits], pa.binary())})
        give_back()

    within = drawn.where(F.col("turn") <= F.lit(last)).select("lang", "turn", "text").mapInArrow(grams, "lang string, turn double, held binary")
    rows = within.orderBy("turn", "lang", "held").limit(sample).toArrow()
    held = np.frombuffer(b"".join(rows["held"].to_pylist()), np.uint8).reshape(-1, FEATURES // 8)
    model = fit(held, rows["lang"].to_pylist())
    del rows, held
    give_back()
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Predict the language of every whole text: ``doc_id, lang_pred, score, margin``.

    ``score`` is between 0 and 1. ``margin`` is the answer of the chosen language's own
    regression, set so that 1 is what its texts are to get and 0 what a text gets that tells
    nothing, however many languages there are. ``carry`` adds the input row as the struct ``row``, so that no name can clash.

    Null texts and texts without a letter are ``und`` with score and margin 0, and so is
    everything if the model has learned no language. Ties go to the language that sorts
    first. Only the text is looked at.
    """

    def predict(batches):
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, ROWS)
                at += part.num_rows
                text = part["text"]
                letters = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
                best, score, margin = np.zeros(part.num_rows, int), np.zeros(part.num_rows), np.zeros(part.num_rows)
                if model.languages:
                    raw = model.scores(text).astype(float)
                    odds = np.exp(SHARPNESS * (raw - raw.max(1, keepdims=True)))
                    best, score = raw.argmax(1), odds.max(1) / odds.sum(1)
                    nothing = 2 / len(model.languages) - 1
                    margin = (raw.max(1) - nothing) / (1 - nothing) if nothing < 1 else np.ones(part.num_rows)
                else:
                    letters[:] = False
                names = pa.array([model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)], pa.string())
                out = {"doc_id": part["id"], "lang_pred": names, "score": pa.array(np.where(letters, score, 0.0)), "margin": pa.array(np.where(letters, margin, 0.0))}
                yield pa.record_batch(out | ({"row": part["row"]} if carry else {}))
        give_back()

    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *row)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), *([base.schema["row"]] if carry else [])])
    return base.mapInArrow(predict, schema)
