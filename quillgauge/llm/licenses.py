"""License notices in documents: MinHash bands retrieve templates, containment verifies them.

A document is looked at through overlapping windows, one set of windows for each size class of the
templates: templates of ``n`` to ``2 n - 1`` shingles are sought in windows of ``4 n`` shingles that
begin at every ``2 n``-th, so each place a template may lie is whole within a window. Every band is one
MinHash value. A window that holds 0.8 of a template has a Jaccard similarity of at least
0.8 / 4.2 with it, and 64 bands of one row find such a pair with probability
1 - (1 - 0.19)^64 > 0.999998. A retrieved template is accepted if the window contains enough of its
shingles, counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillgauge.llm.arrays import Texts, mix, slices
from quillgauge.llm.decontaminate import plain

WORDS = 5
BANDS = 64
#: Odd multipliers of the hash functions.
_FACTORS = mix(np.arange(1, BANDS + 1).astype(np.uint64)) | np.uint64(1)
#: Bits of a MinHash value that index a table of 65,536 flags.
_SHIFT = 36

#: Standard notices (fixed values).
TEMPLATES = {
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "MIT (line)": "Released under the MIT License.",
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
    "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
    "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
    "or substantial portions of the Software.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
    "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
    'agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF '
    "ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
    "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution.",
}


class Templates:
    """Shingles and MinHash values of the templates, by size class."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.shingles: list[np.ndarray] = []
        for texts in slices(pa.array([t.lower() for t in templates.values()], pa.string())):
            texts = plain(texts)
            starts, hashes = texts.windows(WORDS)
            owner = texts.text_of_words()[starts]
            self.shingles += [np.unique(hashes[owner == i]) for i in range(len(texts))]
        short = [n for n, s in zip(self.names, self.shingles) if not len(s)]
        if short:
            raise ValueError(f"templates of fewer than {WORDS} words: {short}")
        self.classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.shingles):
            self.classes.setdefault(1 << (len(s).bit_length() - 1), []).append(i)
        self.minima = [np.array([(s * f).min() for f in _FACTORS]) for s in self.shingles]
        self.tables = {
            n: [np.isin(np.arange(1 << 16), [int(self.minima[i][k] >> np.uint64(_SHIFT)) & 0xFFFF for i in members]) for k in range(BANDS)]
            for n, members in self.classes.items()
        }


def notices(texts: Texts, templates: Templates, percent: int) -> list[tuple[int, int, int, int, int]]:
    """(text, template, first word, number of words, shingles found) of the notices in a few texts."""
    starts, hashes = texts.windows(WORDS)
    per_text = np.searchsorted(starts, texts.word_offsets)
    out: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    if not len(hashes):
        return []
    counts = np.diff(per_text)
    levels = []  # blocks of 2, 4, 8, ... shingles from each text's start on; a window is two neighbouring blocks
    size, blocks = 2, -(-counts // 2)
    while size // 2 <= max(templates.classes):
        owner = np.repeat(np.arange(len(texts)), blocks)
        firsts = np.cumsum(blocks) - blocks
        place = np.arange(len(owner)) - firsts[owner]
        windows = np.flatnonzero((place + 1 < blocks[owner]) | (place == 0))
        levels.append((size, owner, place, np.minimum(windows + 1, len(owner) - 1), windows, (blocks[owner] > 1)[windows]))
        size, blocks = 2 * size, -(-blocks // 2)
    hits = {n: np.zeros(len(level[4]), bool) for level in levels if (n := level[0] // 2) in templates.classes}
    base = per_text[:-1][levels[0][1]] + 2 * levels[0][2]
    for k in range(BANDS):
        least = np.minimum.reduceat(hashes * _FACTORS[k], base)
        for number, (size, owner, _, following, windows, two) in enumerate(levels):
            n = size // 2
            if n in hits:
                whole = np.where(two, np.minimum(least[windows], least[following]), least[windows])
                near = np.flatnonzero(templates.tables[n][k][(whole >> np.uint64(_SHIFT)).astype(np.int64) & 0xFFFF])
                hits[n][near[np.isin(whole[near], [templates.minima[i][k] for i in templates.classes[n]])]] = True
            if number + 1 < len(levels):
                _, up_owner, up_place = levels[number + 1][:3]
                pairs = np.searchsorted(owner, up_owner) + 2 * up_place
                least = np.minimum.reduceat(least, pairs)
    for size, owner, place, _, windows, _ in levels:
        n = size // 2
        for w in windows[hits[n]].tolist() if n in hits else ():
            text = int(owner[w])
            begin = int(per_text[text] + size * place[w])
            window = hashes[begin : min(begin + 2 * size, int(per_text[text + 1]))]
            for i in templates.classes[n]:
                inside = np.isin(window, templates.shingles[i])
                found = len(np.unique(window[inside]))
                if 100 * found >= percent * len(templates.shingles[i]):
                    at = np.flatnonzero(inside)
                    first = int(starts[begin + at[0]] - texts.word_offsets[text])
                    last_word = int(starts[begin + at[-1]] - texts.word_offsets[text]) + WORDS
                    out.setdefault((text, i), []).append((first, last_word, found))
    rows = []
    for (text, i), spans in out.items():
        spans.sort()
        merged = [list(spans[0])]
        for a, b, found in spans[1:]:
            if a < merged[-1][1]:
                merged[-1][1], merged[-1][2] = max(b, merged[-1][1]), max(found, merged[-1][2])
            else:
                merged.append([a, b, found])
        rows += [(text, i, a, b - a, found) for a, b, found in merged]
    return sorted(rows)


def license_notices(
    docs: DataFrame, templates: dict[str, str] | None = None, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Notices in every whole text: id, license, first_word, n_words, n_found and n_shingles.

    A template is found where a window holds at least ``percent`` of its five-word shingles; case
    and punctuation do not count and overlapping finds of a template are one. Null and empty texts
    have none; repeated rows give repeated finds; an empty table gives no rows. Templates are a
    parameter of the call, so their number does not grow with the documents; those of fewer than
    five words are refused. No shuffle.
    """
    sought = Templates(TEMPLATES if templates is None else templates)
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType)]).add("license", "string")
    schema = schema.add("first_word", "long").add("n_words", "long").add("n_found", "long").add("n_shingles", "long")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                rows = notices(plain(texts), sought, percent)
                if rows:
                    numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in (2, 3, 4)]
                    sizes = pa.array([len(sought.shingles[r[1]]) for r in rows], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([texts.first + r[0] for r in rows])), pa.array([sought.names[r[1]] for r in rows]), *numbers, sizes],
                        names=[id_col, "license", "first_word", "n_words", "n_found", "n_shingles"],
                    )

    return docs.select(F.col(id_col), F.lower(F.col(text_col).cast("string")).alias("_text_")).mapInArrow(scan, schema)
