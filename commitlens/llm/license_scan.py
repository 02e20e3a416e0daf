"""License notices by MinHash bands over overlapping text windows, verified by exact containment.

Texts and templates are cut into shingles of ``SHINGLE`` words, without case and surrounding
punctuation.  For a template of n words, windows are as long as twice the next power of two
and overlap by half, so one window holds any whole occurrence.  Bands have one MinHash row each; a
window length has as many as its templates need, so that a window with containment ``CONTAINMENT`` or more is
retrieved with probability 1 - ``MISSED`` at least: 48 where that implies a similarity of 0.175, about a
hundred for notices of five words.  Windows without any shingle of a template cannot share a MinHash
with one, so only the others get signatures.  Retrieved pairs count if at least CONTAINMENT of the
template's shingles are in the window.

A document is scanned whole and in one task, and nothing is shuffled.  Templates go to the
tasks in blocks of at most ``BLOCK``, one pass each.  Templates of fewer than SHINGLE words
match nothing.  Null and empty texts have no
notices, an empty table or no template gives an empty result.  Repeated rows give repeated results, null ids stay
null.  Of equally full occurrences (ties) the first is reported.  Only ids and texts are read, so other
columns' names can't clash.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from commitlens.llm import words as W
from commitlens.llm.toxicity import tokens

SHINGLE = 5
CONTAINMENT = 0.8
MISSED = 1e-4
BLOCK = 5_000

_U = np.uint64

#: Notices of common licenses.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "mit": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software."
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:"
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def window_length(words: int) -> int:
    return 2 * (1 << max(words - 1, SHINGLE - 1).bit_length())


def needed(shingles: int) -> int:
    """How many of a template's distinct shingles make up CONTAINMENT."""
    return next(k for k in range(shingles + 1) if k / shingles >= CONTAINMENT)


def bands_needed(shingles: int, length: int) -> int:
    """Bands that find a full window of ``length`` words with the least containment, but for MISSED."""
    k = needed(shingles)
    similarity = k / (length - SHINGLE + 1 + shingles - k)
    return math.ceil(math.log(MISSED) / math.log1p(-similarity)) if similarity < 1 else 1


def signature(shingles, bands):
    """MinHash values of a set of shingle hashes, one for each band."""
    seeds = W.mix(np.arange(1, bands + 1, dtype=np.uint64) * _U(0x632BE59BD9B4E019))
    return np.array([W.mix(shingles ^ s).min() for s in seeds])


class Templates:
    """Shingle sets, signatures and window lengths of a block of templates."""

    def __init__(self, names, texts):
        w, units, _ = tokens(pa.array(texts, pa.string()))
        word = units[:, 0] if len(units) else np.zeros(0, np.uint64)
        self.names, self.sets, self.bands, self.lengths = [], [], {}, {}
        sized = []
        for i, name in enumerate(names):
            own = word[w.first[i] : w.first[i + 1]]
            if len(own) < SHINGLE:
                continue
            k = len(self.names)
            at, g = w.windows(word, SHINGLE)
            shingles = np.unique(g[(at >= w.first[i]) & (at < w.first[i + 1])])
            self.names.append(name)
            self.sets.append(shingles)
            length = window_length(len(own))
            self.lengths[length] = max(self.lengths.get(length, 0), bands_needed(len(shingles), length))
            sized.append((k, length))
        for k, length in sized:
            for band, value in enumerate(signature(self.sets[k], self.lengths[length])):
                self.bands.setdefault((length, band, int(value)), []).append(k)
        self.all = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)

    def scan(self, texts):
        """(document number, template number, first word, last word, containment), one per document and template."""
        w, units, _ = tokens(texts)
        best = {}
        if not len(units) or not len(self.all):
            return w, best
        at, g = w.windows(units[:, 0], SHINGLE)
        spot = np.minimum(np.searchsorted(self.all, g), len(self.all) - 1)
        hits = self.all[spot] == g
        hit_at = at[hits]
        doc = w.doc[hit_at]
        for length, bands in self.lengths.items():
            half = length // 2
            # Windows begin at multiples of half a length within their document.
            nth = (hit_at - w.first[doc]) // half
            for d, k in set(zip(np.repeat(doc, 2).tolist(), np.stack([nth, nth - 1], axis=1).ravel().tolist())):
                if k < 0:
                    continue
                begin = w.first[d] + k * half
                end = min(begin + length, w.first[d + 1])
                a, b = np.searchsorted(at, [begin, end - SHINGLE + 1])
                if not hits[a:b].any():
                    continue
                inside = g[a:b]
                found = set()
                for band, value in enumerate(signature(inside, bands)):
                    found.update(self.bands.get((length, band, int(value)), ()))
                for t in found:
                    mine = np.isin(inside, self.sets[t])
                    share = len(np.unique(inside[mine])) / len(self.sets[t])
                    if share >= CONTAINMENT:
                        where = np.flatnonzero(mine) + a
                        row = (share, -int(at[where[0]] - w.first[d]), int(at[where[-1]] - w.first[d]) + SHINGLE)
                        best[d, t] = max(best.get((d, t), row), row)
        return w, best


def scan(docs: DataFrame, templates) -> DataFrame:
    """(doc_id, license, first_word, end_word, containment) per document and template found in it.

    ``templates`` is a mapping from names to notices; of several occurrences the fullest,
    then the first, is reported.
    """
    parts = []
    named = sorted(templates.items())
    for start in range(0, max(len(named), 1), BLOCK):
        block = Templates([n for n, _ in named[start : start + BLOCK]], [t for _, t in named[start : start + BLOCK]])

        def measure(part, block=block):
            _, best = block.scan(part["text"])
            rows = sorted((d, block.names[t], -first, end, share) for (d, t), (share, first, end) in best.items())
            take = pa.array([r[0] for r in rows], pa.int64())
            return {
                "doc_id": part["doc_id"].take(take), "license": [r[1] for r in rows], "first_word": [r[2] for r in rows],
                "end_word": [r[3] for r in rows], "containment": [r[4] for r in rows],
            }

        parts.append(
            W.map_texts(
                docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text"), ["doc_id", "text"], "text",
                W.schema("doc_id bigint, license string, first_word bigint, end_word bigint, containment double"), measure,
            )
        )
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out
