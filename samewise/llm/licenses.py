"""License scans: MinHash bands over overlapping windows, then exact containment.

A template of L words belongs to the window width W, the smallest of 8, 16, 32,
... with 7/8 W >= L.  Windows of W words begin every W/8 words, so any place of the
template lies whole in one of them, where its shingles make up at least a
quarter of the window's.  Each of PERMUTATIONS bands holds one minimum; at a
likeness of 0.2 a window misses its template with a probability of
0.8 ** 48 = 2e-5.  A window without any template's shingle cannot collide, so
minima are taken only where one occurs.  A retrieved template is verified by the
exact part of its shingles that the window, widened by half on either side, holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec

K = 5
CONTAINMENT = 0.8
PERMUTATIONS = 48
U64 = np.uint64

# Public license notices.
TEMPLATES = {
    "MIT (notice)": "Released under the MIT License.",
    "MIT (notice 2)": "Licensed under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 (notice)": "This work is licensed under the GNU General Public License, version 2.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (notice)": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 (notice)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD (conditions)": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-3-Clause (clause)": "may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


class Templates:
    """Shingles and minima of the templates, by window width."""

    def __init__(self, templates: dict[str, str], k: int):
        self.k = k
        self.names = list(templates)
        rng = np.random.default_rng(20)
        self.odd = rng.integers(0, 1 << 63, PERMUTATIONS, dtype=U64) * U64(2) + U64(1)
        self.sets: list[np.ndarray] = []
        self.offsets: list[np.ndarray] = []
        self.widths: dict[int, list[int]] = {}
        for i, text in enumerate(templates.values()):
            s = next(vec.slices(pa.array([text]), space=vec.PUNCTUATION))
            if len(s.words) < k:
                raise ValueError(f"template {self.names[i]} has fewer than {k} words")
            for held, x in zip((self.sets, self.offsets), np.unique(vec.grams(s.words, k), return_index=True), strict=True):
                held.append(x)
            width = 8
            while 7 * width < 8 * len(s.words):
                width *= 2
            self.widths.setdefault(width, []).append(i)
        self.minima = [np.array([(x * o).min() for o in self.odd]) for x in self.sets]
        every = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, U64)
        self.index = vec.Index(every, every)

    def scan(self, h: np.ndarray, hits: np.ndarray, containment: float) -> list[tuple[int, float, int, int]]:
        """(template, containment, first word, last word) of one text, from its shingles and where templates' shingles stand.

        Every place of a template is given.  Of places of it that overlap, runs in
        the template's order come first, as they part notices that stand side by side.  A
        place gives way to that of a template better contained in words it
        shares (another version of the same license).
        """
        runs: dict[int, set] = {}
        bags: dict[int, set] = {}
        for width, members in self.widths.items():
            step, span = width // 8, width - self.k + 1
            first = np.maximum(0, -(-(hits - span + 1) // step))
            begins = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(first, hits // step, strict=True)])) * step
            for begin in begins:
                part = h[begin : begin + span]
                minima = (part[:, None] * self.odd).min(axis=0)
                for i in members:
                    if not (minima == self.minima[i]).any():
                        continue
                    low = max(0, begin - width // 2)
                    wide = h[low : begin + span + width // 2]
                    inside = np.flatnonzero(np.isin(wide, self.sets[i]))
                    rank = np.searchsorted(self.sets[i], wide[inside])
                    size = len(self.sets[i])
                    for kind, cuts in ((bags, []), (runs, np.flatnonzero(np.diff(self.offsets[i][rank]) <= 0) + 1)):
                        for at, own in zip(np.split(inside, cuts), np.split(rank, cuts), strict=True):
                            held = len(np.unique(own)) / size
                            if held >= containment:
                                kind.setdefault(i, set()).add((held, int(low + at[0]), int(low + at[-1]) + self.k))
        places = []
        for i in sorted(bags):
            best = lambda x: (-x[0], x[2] - x[1], x[1])
            chosen: list[tuple[float, int, int]] = []
            for x in sorted(runs.get(i, ()), key=best):
                if not any(y[1] < x[2] and x[1] < y[2] for y in chosen):
                    chosen.append(x)
            for x in sorted(bags[i], key=best):
                over = [y for y in chosen if y[1] < x[2] and x[1] < y[2]]
                if not over or len(over) == 1 and over[0][0] < x[0]:
                    chosen = [y for y in chosen if y not in over] + [x]
            places += [(i, *x) for x in sorted(chosen, key=lambda x: x[1])]
        return [x for x in places if not any(y[1] > x[1] and y[2] < x[3] and x[2] < y[3] for y in places)]


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", k: int = K, containment: float = CONTAINMENT) -> DataFrame:
    """(id, license, containment, first_word, end_word) for every place in a document that holds a template at or above the containment.

    Words are ASCII letters and digits and other bytes of UTF-8, lower-cased.
    Null, empty and shorter texts match nothing; very long texts are scanned whole;
    repeated rows give repeated results; an empty table gives no rows.  Ids keep their type; other
    columns, whatever their names, are not read.  The templates are a fixed list, so what
    is shipped does not grow; a user's own replace it.
    """
    held = TEMPLATES if templates is None else templates

    def scan(batches):
        t = Templates(held, k)
        for batch in batches:
            ids = batch.column(0)
            for s in vec.slices(batch.column(1), space=vec.PUNCTUATION):
                h = vec.grams(s.words, k)
                at, _ = t.index.hits(h)
                at = at[s.doc[at] == s.doc[at + k - 1]]
                if not len(at):
                    continue
                bounds = s.bounds()
                rows = []
                for d in np.unique(s.doc[at]):
                    a, b = bounds[d], bounds[d + 1]
                    for i, part, low, high in t.scan(h[a : b - k + 1], at[s.doc[at] == d] - a, containment):
                        rows.append((ids[s.first + int(d)].as_py(), t.names[i], part, low, high))
                if rows:
                    kinds = [ids.type, pa.string(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=[id_col, "license", "containment", "first_word", "end_word"])

    base = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(scan, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, license string, containment double, first_word long, end_word long")
