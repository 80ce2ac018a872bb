"""License scans: MinHash bands over overlapping text windows, exact containment after.

Templates are dealt into classes by their number of five-word shingles. For a class whose
templates hold up to ``s`` shingles a text is cut into blocks of ``s`` shingles, and every
two neighbouring blocks make a window, so that any run of ``s`` shingles lies inside one.
A template of more than s/2 shingles, 80 % of which a window holds, has a Jaccard similarity
of at least 0.4 / 2.1 with it. A band is one MinHash value, and a class takes as many bands
as make a miss rarer than ``MISS``. What the bands retrieve is verified exactly: the
template's shingles, as words, that the window holds.

Compared are runs of letters and digits in lower case, so that punctuation, line breaks and
the comment marks of source code don't matter; found places are told in words of the text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import wordhash as W

SHINGLE, CONTAINMENT, MISS = 5, 0.8, 1e-6

#: Names and texts of public licence notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "This project is licensed under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


#: Bytes that part words, and the longer characters that are neither letters nor digits, by their bytes.
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[b for b in range(128) if not chr(b).isalnum()]] = 32
_MARKS = [(n, rf"[^\pL\pN\x{{0}}-\x{{{a - 1:x}}}\x{{{b + 1:x}}}-\x{{10ffff}}]") for n, a, b in ((2, 0x80, 0x7FF), (3, 0x800, 0xFFFF))] + [(4, r"[^\pL\pN\x{0}-\x{ffff}]")]


def _bare(lower: pa.Array) -> pa.Array:
    """Texts in lower case with blanks for all but letters and digits, each byte at its place."""
    for n, pattern in _MARKS:
        lower = pc.replace_substring_regex(lower, pattern, " " * n)
    data, offsets = W.raw(lower)
    return pa.LargeStringArray.from_buffers(len(lower), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_BLANK[data]))


def _plain(text: str) -> list[str]:
    """Words as the scan compares them."""
    return _bare(pc.utf8_lower(pa.array([text], pa.large_string())))[0].as_py().split()


def bands_for(size: int) -> int:
    """How many bands a class of templates with up to ``size`` shingles takes."""
    smallest = size // 2 + 1
    similarity = CONTAINMENT * smallest / (2 * size + (1 - CONTAINMENT) * smallest)
    return math.ceil(math.log(MISS) / math.log(1 - similarity))


class _Class:
    """The templates with more than size/2 and up to ``size`` shingles."""

    def __init__(self, size: int, members: list[tuple[str, list[str]]]):
        self.size, self.names, self.bands = size, [m[0] for m in members], bands_for(size)
        self.keys = W.stream(9 + size, self.bands)
        self.sets = [{tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)} for _, w in members]
        rows = []
        for _, w in members:
            column = pa.array([" ".join(w)])
            grams = W.runs(W.hashes(W.words(column)), SHINGLE)
            rows.append([W.mix(grams ^ k).min() for k in self.keys])
        self.signature = np.array(rows, np.uint64)  # templates by bands


def classes(templates: dict[str, str]) -> list[_Class]:
    grouped: dict[int, list] = {}
    for name, text in sorted(templates.items()):
        if len(w := _plain(text)) >= SHINGLE:
            grouped.setdefault(1 << (len(w) - SHINGLE).bit_length(), []).append((name, w))
    return [_Class(s, m) for s, m in sorted(grouped.items())]


def _windows(owner: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First shingle and text of each block of ``size`` shingles; blocks don't cross texts."""
    n = np.diff(ends)
    blocks = -(-n // size)
    text = np.repeat(np.arange(len(n)), blocks)
    within = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return ends[:-1][text] + within * size, text


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """Find the templates of which a window of a text holds 80 % of the five-word shingles.

    Returns ``doc_id, license, containment, first_word, last_word``: a row for each text and
    template found, with the best window (the earliest of equals); word numbers count the
    words between white space from 0 and bound the window's shingles that match. Letter
    case, punctuation, spacing and comment marks don't matter. Templates that differ in a
    word or two, as the GNU headers, may be found together; their containment tells them apart.

    Null, empty and short texts find nothing; templates under five words are never found.
    Equal rows and rows that share an id give rows each. Null ids are carried along. Other
    columns are ignored; an empty table gives an empty result.
    """
    wanted = classes(TEMPLATES if templates is None else templates)

    def scan(batches):
        for batch in batches:
            for piece in W.pieces(pa.Table.from_batches([batch]), "text", 2_000_000):
                lower = pc.utf8_lower(W.as_strings(piece["text"]))
                found = W.words(_bare(lower))
                at, owner = W.inside_texts(found.counts, SHINGLE)
                if not len(at):
                    continue
                grams = W.runs(W.hashes(found), SHINGLE)[at]
                ends = np.searchsorted(owner, np.arange(len(found.counts) + 1))
                spaced = None
                best: dict[tuple[int, str], tuple] = {}
                for group in wanted:
                    first, text = _windows(owner, ends, group.size)
                    joined = np.append(text[1:] == text[:-1], False)
                    retrieved = set()
                    for band, key in enumerate(group.keys):
                        least = np.minimum.reduceat(W.mix(grams ^ key), first) if group.size > 1 else W.mix(grams ^ key)
                        least[:-1] = np.where(joined[:-1], np.minimum(least[:-1], least[1:]), least[:-1])
                        for t, value in enumerate(group.signature[:, band].tolist()):
                            retrieved.update((int(w), t) for w in np.flatnonzero(least == W.U64(value)))
                    for w, t in sorted(retrieved):
                        i = int(text[w])
                        a = int(first[w])
                        b = min(a + 2 * group.size, int(ends[i + 1]))
                        words = [bytes(found.data[s : s + n]).decode() for s, n in zip(found.starts[at[a] : at[b - 1] + SHINGLE], found.lengths[at[a] : at[b - 1] + SHINGLE], strict=True)]
                        hits = [j for j in range(b - a) if tuple(words[j : j + SHINGLE]) in group.sets[t]]
                        share = len({tuple(words[j : j + SHINGLE]) for j in hits}) / len(group.sets[t])
                        if share >= CONTAINMENT - 1e-12:
                            old = best.get((i, group.names[t]))
                            if old is None or share > old[0]:
                                # bare words lie inside words between white space, at the same bytes
                                spaced = W.words(lower) if spaced is None else spaced
                                edges = found.starts[[at[a + hits[0]], at[a + hits[-1]] + SHINGLE - 1]]
                                word = np.searchsorted(spaced.starts, edges, "right") - 1 - spaced.offsets[i]
                                best[i, group.names[t]] = (share, int(word[0]), int(word[1]))
                if best:
                    rows = sorted(best.items())
                    yield pa.record_batch({"doc_id": piece["doc_id"].combine_chunks().take(pa.array([k[0] for k, _ in rows])), "license": pa.array([k[1] for k, _ in rows]), "containment": pa.array([v[0] for _, v in rows], pa.float64()), "first_word": pa.array([v[1] for _, v in rows], pa.int64()), "last_word": pa.array([v[2] for _, v in rows], pa.int64())})

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(scan, "doc_id long, license string, containment double, first_word long, last_word long")
