"""Substring deduplication: repeated word windows found through a Count-min prefilter.

1. Documents are dealt into batches by id and text. Each batch makes a partition sketch: a
   Count-min row over the hashes of its word windows, WIDE cells for each window of the
   input, so that few windows share one at any size. Most cells of a batch are empty, so the
   sketch is sent as its cells that are not, with their counters (up to 255), cut into
   slices of the row.
2. The sketches of a slice are merged by adding up counters. A sum is never below the true
   count, so no repeated window is lost; each batch is told which of its cells reach two.
3. A second pass groups exactly the windows in those cells by a hash of HASH_BITS. A batch sends
   each such window once, with its first place in the batch, so a passage in a third of all
   documents costs one entry a batch. The first holder keeps its window.

A batch sends a slice one message, and none if it has nothing for it: there are never more
messages than windows. Batches and slices grow with the input (up to LARGER times) so that
messages keep holding several windows each.

No step gathers all windows of one text or one passage in one place, and what moves is
about three bytes a window for the sketches and 24 a window that is really repeated.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import wordhash as W
from .cluster import checkpointed, width

#: Cells of the sketch for each window of the input, as a power of two, and bytes a window takes, about.
WIDE, WINDOW_BYTES = 10, 6
#: Bytes of text in a batch, and windows in a slice, about, and how much larger they may get.
BATCH_BYTES, SLICE_WINDOWS, LARGER = 6_000_000, 2_000_000, 8
#: Bits of the hash that tells windows apart: of 1e13 windows two differ and agree with a chance of 3e-6.
HASH_BITS = 104
#: Windows that a message holds, about, before batches and slices grow.
FILLED = 32
MESSAGE = "slice int, batch int, payload binary"
LAST = np.iinfo(np.int64).max


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; integers by byte planes, which compress better."""
    out = []
    for a in arrays:
        plane = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T if len(a) else np.zeros((a.itemsize, 0), np.uint8)
        body = zstandard.ZstdCompressor(level=1).compress(plane.tobytes())
        out += [np.array([len(a), len(body)], np.uint32).tobytes(), a.dtype.str.encode().ljust(4), body]
    return b"".join(out)


def _unsqueeze(payload: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(payload):
        n, size = np.frombuffer(payload, np.uint32, 2, at)
        kind = np.dtype(payload[at + 8 : at + 12].decode().strip())
        body = zstandard.ZstdDecompressor().decompress(payload[at + 12 : at + 12 + int(size)], max_output_size=max(1, int(n) * kind.itemsize))
        out.append(np.frombuffer(body, np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).reshape(-1) if n else np.zeros(0, kind))
        at += 12 + int(size)
    return out


def _slices(values: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of ``bits``-bit values ends in sorted ``values``."""
    step = -(-(1 << bits) // n)
    edges = np.array([min(step * (i + 1), (1 << bits) - 1) for i in range(n - 1)], np.uint64)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])


class _Batch:
    """The windows of one batch of documents."""

    def __init__(self, table: pa.Table, window: int, deep: bool):
        self.ids = table["doc_id"].combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False)
        parts, self.counts, n = [], [], 0
        for piece in W.pieces(table, "text"):
            found = W.words(piece["text"])
            at, owner = W.inside_texts(found.counts, window)
            base = W.hashes(found, 1)
            h1 = W.runs(base, window)[at] if len(at) else np.zeros(0, W.U64)
            h2 = W.runs(W.hashes(found, 2), window)[at] >> W.U64(128 - HASH_BITS) if deep and len(at) else h1
            first = found.offsets[:-1]
            parts.append((h1, h2, owner + n, at - first[owner]))
            self.counts.append(found.counts)
            n += len(found.counts)
        self.counts = np.concatenate(self.counts) if self.counts else np.zeros(0, int)
        self.h1, self.h2, self.owner, self.start = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4))

    def cells(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted cells, how often each was met, and the cell (by place) of each window."""
        cell = self.h1 >> W.U64(64 - bits)
        unique, place, n = np.unique(cell, return_inverse=True, return_counts=True)
        return unique, n, place

    def candidates(self, repeated: np.ndarray, place: np.ndarray):
        """Distinct windows in repeated cells: windows by place, distinct hashes, the first
        holder (smallest id, earliest start) of each, and the group of each window."""
        at = np.flatnonzero(repeated[place])
        order = np.lexsort((self.start[at], self.ids[self.owner[at]], self.h2[at], self.h1[at]))
        at = at[order]
        new = np.ones(len(at), bool)
        new[1:] = (self.h1[at][1:] != self.h1[at][:-1]) | (self.h2[at][1:] != self.h2[at][:-1])
        return at, at[new], np.cumsum(new) - 1


def _messages(batch: int, ends: np.ndarray, make) -> pa.Table:
    rows = [(i, make(ends[i], ends[i + 1])) for i in range(len(ends) - 1) if ends[i + 1] > ends[i]]
    return pa.table({"slice": pa.array([r[0] for r in rows], pa.int32()), "batch": pa.array([batch] * len(rows), pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})


def _told(answers: pa.Table, ends: np.ndarray) -> np.ndarray:
    """The flags that each slice has sent back, over all entries of a batch."""
    out = np.zeros(ends[-1], bool)
    for s, payload in zip(answers["slice"].to_pylist(), answers["payload"].to_pylist(), strict=True):
        out[ends[s] : ends[s + 1]] = np.unpackbits(_unsqueeze(payload)[0], count=int(ends[s + 1] - ends[s])).astype(bool)
    return out


def _reply(table: pa.Table, slice_: int, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    ends = np.cumsum([0, *sizes])
    return pa.table({"slice": pa.array([slice_] * len(sizes), pa.int32()), "batch": table["batch"].combine_chunks().cast(pa.int32()), "payload": pa.array([_squeeze(np.packbits(flags[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that starts earlier elsewhere.

    Earlier means in a document with a smaller id, or earlier in the same one; windows are
    judged on the texts as given. Returns ``doc_id, n_words, n_removed, kept_text`` (kept
    words joined by one space), a row for each input row.

    Null texts count as empty; texts shorter than the window lose nothing. Null ids come
    after all others, and rows that share an id count as one document: windows at the same
    start are both the first. Equal rows give equal rows. Other columns are ignored, so
    their names can't clash; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    windows = size / WINDOW_BYTES
    bits = min(63, max(20, math.ceil(math.log2(windows + 1)) + WIDE))
    # messages number batches times slices; twice as large ones of both make a fourth of them
    larger = min(LARGER, max(1.0, math.sqrt(FILLED * (size / BATCH_BYTES) * (windows / SLICE_WINDOWS) / max(windows, 1))))
    n_batches = max(1, math.ceil(size / (BATCH_BYTES * larger)))
    n_slices = max(1, math.ceil(windows / (SLICE_WINDOWS * larger)))
    parts = min(n_batches, max(width(spark), 1)) if n_batches < width(spark) else width(spark)
    dealt = base.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_batches)).cast("int")).repartition(parts, "batch")

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        cells, n, _ = _Batch(table, window, False).cells(bits)

        def part(a, b):
            gaps = np.diff(cells[a:b], prepend=W.U64(0))
            gaps = np.concatenate([gaps[:1], gaps[1:]])
            return _squeeze(gaps[:1], gaps[1:].astype(np.uint32) if len(gaps) == 1 or gaps[1:].max() < 2**32 else gaps[1:], np.minimum(n[a:b], 255).astype(np.uint8))

        return _messages(key[0].as_py(), _slices(cells, bits, n_slices), part)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        cells, counters, sizes = [], [], []
        for payload in table["payload"].to_pylist():
            first, gaps, n = _unsqueeze(payload)
            cells.append(np.cumsum(np.concatenate([first, gaps.astype(np.uint64)])))
            counters.append(n)
            sizes.append(len(n))
        cells, counters = np.concatenate(cells), np.concatenate(counters)
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        new = np.ones(len(cells), bool)
        new[1:] = cells[1:] != cells[:-1]
        total = np.add.reduceat(counters[order].astype(np.int64), np.flatnonzero(new))
        repeated = np.zeros(len(cells), bool)
        repeated[order] = total[np.cumsum(new) - 1] > 1
        return _reply(table, key[0].as_py(), repeated, sizes)

    def suspects(key: tuple, table: pa.Table, answers: pa.Table):
        b = _Batch(table, window, True)
        cells, _, place = b.cells(bits)
        at, firsts, group = b.candidates(_told(answers, _slices(cells, bits, n_slices)), place)
        return b, at, firsts, group, _slices(b.h1[firsts], 64, n_slices)

    def ask(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _messages(0, np.zeros(1, int), None)
        b, _, firsts, _, ends = suspects(key, table, answers)
        return _messages(table["batch"][0].as_py(), ends, lambda i, j: _squeeze(b.h1[firsts[i:j]], b.h2[firsts[i:j]], b.ids[b.owner[firsts[i:j]]], b.start[firsts[i:j]].astype(np.int64)))

    def owners(key: tuple, table: pa.Table) -> pa.Table:
        got = [_unsqueeze(p) for p in table["payload"].to_pylist()]
        h1, h2, ids, starts = (np.concatenate([g[i] for g in got]) for i in range(4))
        order = np.lexsort((starts, ids, h2, h1))
        h1, h2, ids, starts = h1[order], h2[order], ids[order], starts[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        flags = np.zeros(len(h1), bool)
        flags[order] = (ids != ids[head]) | (starts != starts[head])  # rows that share an id are one document
        return _reply(table, key[0].as_py(), flags, [len(g[0]) for g in got])

    def cut(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
        if not table.num_rows:
            return schema.empty_table()
        sketched = answers.filter(pa.compute.equal(answers["phase"], 1))
        owned = answers.filter(pa.compute.equal(answers["phase"], 2))
        b, at, firsts, group, ends = suspects(key, table, sketched)
        elsewhere = _told(owned, ends)
        head = firsts[group]
        first_here = (b.ids[b.owner[at]] == b.ids[b.owner[head]]) & (b.start[at] == b.start[head])
        gone = at[elsewhere[group] | ~first_here]
        offsets = np.concatenate([[0], np.cumsum(b.counts)])
        cover = np.zeros(offsets[-1] + 1, np.int32)
        begin = offsets[b.owner[gone]] + b.start[gone]
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + window, -1)
        removed = np.cumsum(cover[:-1]) > 0
        lost = np.add.reduceat(np.append(removed, False).astype(np.int64), offsets[:-1]) if len(b.counts) else np.zeros(0, np.int64)
        lost[b.counts == 0] = 0
        kept = []
        for i, text in enumerate(W.as_strings(table["text"])):
            row = text.as_buffer().to_pybytes().split() if text.as_buffer() else []
            if lost[i]:
                stay = ~removed[offsets[i] : offsets[i + 1]]
                row = [w for w, s in zip(row, stay.tolist(), strict=True) if s]
            kept.append(b" ".join(row))
        return pa.table([table["doc_id"], pa.array(b.counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)

    sketches = dealt.groupBy("batch").applyInArrow(sketch, MESSAGE)
    repeated = checkpointed(sketches.groupBy("slice").applyInArrow(merge, MESSAGE))
    asked = dealt.groupBy("batch").cogroup(repeated.groupBy("batch")).applyInArrow(ask, MESSAGE)
    owned = asked.groupBy("slice").applyInArrow(owners, MESSAGE)
    answers = repeated.withColumn("phase", F.lit(1)).unionByName(owned.withColumn("phase", F.lit(2)))
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")
