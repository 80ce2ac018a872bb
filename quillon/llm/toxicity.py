"""Toxicity categories by a chain of linear classifiers.

The chain predicts categories one after the other. Each link is a logistic regression on
the presence of words, and each but the first also takes the probabilities of the earlier
categories. It is trained with out-of-fold probabilities: those that models fitted on the
other folds give to a row, so that later links learn from errors as they will meet them.

The last category is the label itself. The earlier ones are kinds of toxic texts that the
data tell: toxic texts are dealt in two by the words that mark them, along the direction in
which they differ most. With ``seeds`` they are those toxic texts that hold a category's seed
words. Prediction never looks for words of a list; it only uses learned weights.

A model holds all words of its sample. How strongly the ridge holds a word back depends on
how much it tells: a word is scaled by the root of its chi-square statistic, so the many
that tell nothing add no noise and none has to be left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import wordhash as W

FINAL = "toxic"
#: The earlier categories, hashed words, and the bound of the labelled sample.
KINDS = ("kind_1", "kind_2")
CELL_BITS, SAMPLE = 20, 16_000
FOLDS, STEPS, RIDGE, CLOSE = 4, 150, 0.1, 5e-4


def word_cells(column) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words of each text, and how many: lower case, letters and digits only."""
    plain = pc.replace_substring_regex(pc.utf8_lower(W.as_strings(column)), r"[^\pL\pN\s]+", " ")
    found = W.words(plain)
    h = (W.hashes(found, 3) >> W.U64(64 - CELL_BITS)).astype(np.int64)
    n = len(found.counts)
    owner = np.repeat(np.arange(n), found.counts)
    flat = np.unique((owner << CELL_BITS) + h)
    return (flat & ((1 << CELL_BITS) - 1)).astype(np.int32), np.bincount(flat >> CELL_BITS, minlength=n)


def _sum_by_row(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, values, n)


def _logistic(column: np.ndarray, owner: np.ndarray, scale: np.ndarray, extra: np.ndarray, y: np.ndarray):
    """Ridge-penalised logistic regression by accelerated gradient steps with restarts.

    ``scale`` has a number for each word by which its presence counts.
    """
    n, m, width = len(y), extra.shape[1], len(scale)
    # weights of both classes are levelled
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max(n - y.sum(), 1)) * n

    counts = np.bincount(owner, minlength=n)
    some, first = counts > 0, (np.cumsum(counts) - counts)[counts > 0]

    def apply(v):
        z = np.zeros(n)
        if len(first):
            z[some] = np.add.reduceat((v[:width] * scale)[column], first)
        return z + extra @ v[width : width + m] + v[-1]

    def back(g):
        return np.concatenate([np.bincount(column, g[owner], width) * scale, extra.T @ g, [g.sum()]])

    # the step is bounded by the largest curvature; no entry is negative, so ones lead to it
    v, bound = np.ones(width + m + 1), 0.0
    for _ in range(6):
        v = back(weight / n * apply(v / np.linalg.norm(v)))
        bound = np.linalg.norm(v)
    bound = 0.25 * 1.2 * bound + RIDGE / n
    w = np.zeros(width + m + 1)
    v, old_loss, momentum = w.copy(), np.inf, 1.0
    for _ in range(STEPS):
        z = apply(v)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = (weight * (np.logaddexp(0, z) - y * z)).mean() + RIDGE / n / 2 * (v[:-1] ** 2).sum()
        grad = back(weight * (p - y) / n)
        grad[:-1] += RIDGE / n * v[:-1]
        if abs(old_loss - loss) < CLOSE * loss:
            break
        if loss > old_loss:
            momentum = 1.0
        old_loss = loss
        new = v - grad / bound
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return w


@dataclass
class Chain:
    categories: list[str]
    place: np.ndarray  # hashed word to its column, -1 if it has none
    links: list[np.ndarray]
    width: int

    def probabilities(self, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A row for each text, a column for each category, in the chain's order."""
        column = self.place[cells]
        owner = np.repeat(np.arange(len(counts)), counts)[column >= 0]
        column = column[column >= 0]
        out = np.zeros((len(counts), len(self.categories)))
        for i, w in enumerate(self.links):
            z = _sum_by_row(w[column], owner, len(counts)) + out[:, :i] @ w[self.width : self.width + i] + w[-1]
            out[:, i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def fit(cells: np.ndarray, counts: np.ndarray, labels: np.ndarray, categories: list[str]) -> Chain:
    """Train a chain on texts given by their words; ``labels`` has a column for each category.

    A category with one kind of label only gets a constant link near that label.
    """
    n = len(counts)
    held, column = np.unique(cells, return_inverse=True)
    column, width = column.astype(np.int32), len(held)
    place = np.full(1 << CELL_BITS, -1, np.int32)
    place[held] = np.arange(width)
    owner = np.repeat(np.arange(n, dtype=np.int32), counts)
    # how much a word tells about any category, by the chi-square statistic
    telling = np.zeros(width)
    for i in range(labels.shape[1]):
        telling = np.maximum(telling, _excess(column, owner, width, labels[:, i]) ** 2)
    scale = np.sqrt(telling / telling.max()) if width and telling.max() > 0 else np.zeros(width)
    fold = np.arange(n) % FOLDS
    extra, links = np.zeros((n, 0)), []
    for i in range(labels.shape[1]):
        y = labels[:, i].astype(float)

        def model(rows, extra=extra, y=y):
            if len(set(y[rows])) < 2:
                w = np.zeros(width + extra.shape[1] + 1)
                w[-1] = 8.0 if rows.any() and y[rows].max() > 0 else -8.0
                return w
            number = np.cumsum(rows) - 1
            here = rows[owner]
            return _logistic(column[here], number[owner[here]], scale, extra[rows], y[rows])

        links.append(model(np.ones(n, bool)))
        links[-1][:width] *= scale
        if i + 1 < labels.shape[1]:
            out = np.zeros(n)
            for f in range(FOLDS):
                w, rows = model(fold != f), fold == f
                z = _sum_by_row((w[:width] * scale)[column], owner, n) + extra @ w[width : width + i] + w[-1]
                out[rows] = 1 / (1 + np.exp(-np.clip(z[rows], -30, 30)))
            extra = np.column_stack([extra, out])
    return Chain(categories, place, links, width)


def _excess(column: np.ndarray, owner: np.ndarray, width: int, label: np.ndarray) -> np.ndarray:
    """For each word, by how many standard deviations more texts with the label hold it than by chance."""
    often = np.bincount(column, minlength=width)
    rate = label.mean() if len(label) else 0.0
    return (np.bincount(column, label[owner], width) - often * rate) / np.sqrt(np.maximum(often * rate * (1 - rate), 1e-9))


def _kinds(each: list[np.ndarray], toxic: np.ndarray) -> list[np.ndarray]:
    """Toxic texts dealt in two along the leading direction of their marking words.

    Words count by how far toxic texts hold them beyond chance; the direction is found by
    power iteration from the text that is farthest from the mean. Equal texts stay together.
    """
    mine = np.flatnonzero(toxic)
    if len(mine) < 2:
        return [toxic.copy(), np.zeros(len(toxic), bool)]
    counts = np.array([len(e) for e in each])
    held, column = np.unique(np.concatenate(each), return_inverse=True)
    owner = np.repeat(np.arange(len(each)), counts)
    weight = np.maximum(_excess(column, owner, len(held), toxic.astype(float)), 0.0)
    number = np.cumsum(toxic) - 1
    column, owner = column[toxic[owner]], number[owner[toxic[owner]]]
    mean = np.bincount(column, minlength=len(held)) * weight / len(mine)
    length = _sum_by_row((weight**2 - 2 * weight * mean)[column], owner, len(mine))
    side = np.zeros(len(mine))
    side[int(length.argmax())] = 1.0
    for _ in range(30):
        side -= side.mean()
        direction = np.bincount(column, side[owner], len(held)) * weight
        side = _sum_by_row((weight * direction)[column], owner, len(mine))
        side /= max(np.abs(side).max(), 1e-300)
    side -= side.mean()
    first = np.zeros(len(toxic), bool)
    first[mine] = side > 0
    return [first, toxic & ~first]


def _without_copies(each: list[np.ndarray], bands: int = 4, rows: int = 3) -> list[int]:
    """Texts of the sample that share no MinHash band with an earlier one.

    A group of copies would otherwise count as many texts that all tell the same.
    """
    seen, own = set(), []
    keys = W.stream(31, bands * rows)
    for i, words in enumerate(each):
        if len(words):
            least = [int(W.mix(words.astype(np.uint64) ^ k).min()) for k in keys]
            mine = {(b, *least[b * rows : (b + 1) * rows]) for b in range(bands)}
            if mine & seen:
                continue
            seen |= mine
        own.append(i)
    return own


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seeds: dict[str, list[str]] | None = None) -> Chain:
    """Fit a chain on at most SAMPLE labelled documents, drawn by a hash of their id.

    Rows with a null label or a null id are not learned from; a document labelled twice
    counts as its largest label. Of sampled texts that share a MinHash band of their words
    (near copies, as a rule) the first counts, for a group of copies is one example, not
    many: the sample's bound is one on different texts. Without labelled rows every probability is near 0.
    Categories before the last are KINDS, or those of ``seeds``.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    marks = marks.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    read = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(marks), "_id")

    def cut(batches):
        for batch in batches:
            for piece in W.pieces(pa.Table.from_batches([batch]), "_text"):
                cells, counts = word_cells(piece["_text"])
                ends = np.cumsum(counts)
                yield pa.record_batch({"_id": piece["_id"].combine_chunks(), "_label": piece["_label"].combine_chunks(), "cells": pa.array([cells[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)], pa.binary())})

    rows = read.mapInArrow(cut, "_id long, _label int, cells binary").toArrow().sort_by("_id")
    each = [np.frombuffer(b, np.int32) for b in rows["cells"].to_pylist()]
    own = _without_copies(each)
    toxic = (np.array(rows["_label"].to_pylist(), int) > 0)[own]
    each = [each[i] for i in own]
    columns = _kinds(each, toxic) if seeds is None else []
    for words in (seeds or {}).values():
        wanted, _ = word_cells(pa.array([" ".join(words)]))
        columns.append([bool(t) and bool(np.isin(wanted, e).any()) for t, e in zip(toxic, each, strict=True)])
    columns.append(toxic)
    matrix = np.array(columns, bool).T.reshape(len(each), len(columns)).astype(float)
    names = [*(KINDS if seeds is None else seeds), FINAL]
    return fit(np.concatenate(each) if each else np.zeros(0, np.int32), np.array([len(e) for e in each], int), matrix, names)


def score_toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Probabilities of all categories for every whole text: ``doc_id, p_<category>..., is_toxic``.

    ``is_toxic`` holds where the last category reaches ``threshold``. Null and empty texts
    have no word: probability 0 and not toxic. A row for each input row; other columns are
    ignored, and an empty table gives an empty result.
    """

    def score(batches):
        for batch in batches:
            for piece in W.pieces(pa.Table.from_batches([batch]), "text"):
                cells, counts = word_cells(piece["text"])
                p = chain.probabilities(cells, counts)
                p[counts == 0] = 0.0
                out = {f"p_{c}": pa.array(p[:, i]) for i, c in enumerate(chain.categories)}
                yield pa.record_batch({"doc_id": piece["doc_id"].combine_chunks()} | out | {"is_toxic": pa.array(p[:, -1] >= threshold)})

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(score, "doc_id long, " + "".join(f"p_{c} double, " for c in chain.categories) + "is_toxic boolean")
