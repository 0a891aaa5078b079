"""Licence scans: a trained paragraph classifier, built-in functions only.

Blank lines part paragraphs, and so does a line's end after a sentence's end; other
line ends are wraps.  Every paragraph is judged, a very long one in overlapping
parts.  Its features are its words and pairs of words; a sparse logistic regression
for each licence family, fitted here on templates, variants of them and paragraphs
of no licence, gives a probability.  A paragraph whose best calibrated probability
is below a limit is of the unknown class; a predicted family is confirmed if the
paragraph holds enough of one of its templates' word pairs.

Words and pairs are found in hash tables that are literals of the plan, as are the
weights; all are bounded by the templates.  A document is judged inside its own
row: nothing is shuffled.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, crc_mod, first_by_hash, narrow

# Paragraphs of public licences, and how works name them.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    "mit": (
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "isc": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Distributed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is free software under the terms of the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "You may not use the material for commercial purposes under CC BY-NC.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc0": (
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    ),
    "proprietary": (
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "Copyright (c) 2020 Example Corp. All rights reserved.",
    ),
}
# Paragraphs that speak of licences and grant none of these.
OTHERS = (
    "Please renew your driver license before the end of the month.", "The licensed professional will answer your question.", "The license plate was stolen from the car.",
    "He was granted permission to leave the room.", "Public software is discussed in general terms.", "The version of the story is free of charge.",
    "Apache helicopters flew over the city.", "The general public is invited.", "She has the right to remain silent.", "See the terms of the agreement.",
    "Fishing license fees rise again.", "We reserved all rooms.", "The MIT campus is open.", "The work of the author is in the list of books.", "License.", "The license of the shop was revoked.",
    "The court found that the warranty was implied and awarded damages to the buyer.", "You can obtain a copy of the report at the library, free of charge.",
    "The following conditions apply to all rooms that are booked with or without breakfast.", "The committee published version 2 of the report under the terms of the agreement.",
)
#: What parts paragraphs: blank lines, and a line's end after a sentence's.
BETWEEN = r"(?:\r\n?|\n)(?:[ \t]*(?:\r\n?|\n))+|(?<=[.!?:])[\"')\]]{0,3}[ \t]*(?:\r\n?|\n)"
#: Words of a part of a paragraph that is judged at once, and how far parts are apart.
PART, STEP = 256, 128
#: Paragraphs of the corpus as examples of no licence: of so many documents of any kind
#: and of so many that speak of licences, of each a run of so many characters at most;
#: of their paragraphs so many, drawn at random.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_PARAGRAPHS = 400, 20_000, 3000
#: Words by which documents that may hold hard examples are chosen; scans don't use it.
TALK = r"(?i)licen[cs]e|copyright|permission|redistribut|warrant|public domain|rights reserved|free software"
#: A paragraph is compared with a template by the pairs of the shorter of both, these at least.
FRAGMENT = 8
#: A paragraph of the corpus with this share of a template's pairs is no example.
TOO_LIKE = 0.3
VARIANTS, STEPS, PENALTY, LIMIT, SHARED = 40, 600, 5e-5, 0.6, 0.5
_WORD = r"[a-z0-9]+"
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str) -> list[str]:
    return re.findall(_WORD, text.translate(_LOWER))


def pairs_of(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


def paragraphs_of(text: str) -> list[str]:
    return [p for p in re.split(BETWEEN, text) if p.strip(" \t\r\n")]


def variants(text: str, rng: random.Random, n: int = VARIANTS) -> list[str]:
    """A template as it is found: with words lost, added and cut off."""
    words = text.split()
    out = [text]
    for _ in range(n - 1):
        kept = [w for w in words if rng.random() > 0.08]
        if len(words) > 14 and rng.random() < 0.5:  # a wrapped line of it, or a few
            at = rng.randrange(len(words) - 8)
            kept = words[at : at + rng.randrange(8, len(words) - at + 1)]
        noise = lambda n: ["".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 9))) for _ in range(n)]
        out.append(" ".join(noise(rng.randrange(4)) + kept + noise(rng.randrange(4))))
    return out


@dataclass
class Model:
    """Features are the templates' words and pairs; those without weight stay, as the
    comparison with templates needs them."""

    families: list[str]
    words: dict[str, list[float]]  # weights of each word, by family
    pairs: dict[tuple[str, str], list[float]]
    bias: list[float]
    slope: float  # of the calibration
    offset: float
    templates: dict[str, list[set[tuple[str, str]]]] = field(default_factory=lambda: {f: [pairs_of(words_of(t)) for t in ts] for f, ts in TEMPLATES.items()})


def likeness(words: list[str], templates: list[set[tuple[str, str]]]) -> float:
    """The largest share of a template's pairs that the words hold, or, of templates that
    are longer than the words, of the words' pairs that the template holds."""
    own = pairs_of(words)
    return max((len(own & t) / min(len(t), max(len(words) - 1, FRAGMENT)) for t in templates if t), default=0.0)


def fit(corpus: list[str], seed: int = 17) -> Model:
    """One-against-rest regressions with a lasso; a slope and an offset fitted on other
    variants make their best score a probability."""
    rng = random.Random(seed)
    families = sorted(TEMPLATES)
    templates = [(k, words_of(t)) for k, f in enumerate(families) for t in TEMPLATES[f]]
    names: list = sorted({w for _, ws in templates for w in ws}) + sorted({p for _, ws in templates for p in pairs_of(ws)})
    at = {f: i for i, f in enumerate(names)}
    rows = [(words_of(v), k) for k, f in enumerate(families) for t in TEMPLATES[f] for v in variants(t, rng)]
    rows += [(words_of(v), -1) for t in OTHERS for v in variants(t, rng, 12)] + [(words_of(p), -1) for p in corpus]
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, (ws, _) in enumerate(rows):
        x[i, [at[f] for f in {*ws, *pairs_of(ws)} if f in at]] = 1
    kinds = np.array([k for _, k in rows])
    y = (kinds[:, None] == np.arange(len(families))).astype(np.float32)
    train = np.arange(len(rows)) % 4 != 0
    a, n = x[train], int(train.sum())
    w, b = np.zeros((len(names), len(families)), np.float32), np.full(len(families), -3.0, np.float32)
    probe = np.ones(len(names), np.float32)
    for _ in range(12):  # the largest singular value, by power iteration
        probe = a.T @ (a @ probe)
        probe /= np.linalg.norm(probe)
    step = 4 * n / (1.1 * float(np.linalg.norm(a @ probe)) ** 2 + n)
    v, t = w.copy(), 1.0
    for _ in range(STEPS):
        g = 1 / (1 + np.exp(-(a @ v + b))) - y[train]
        new = v - step * (a.T @ g) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        b = b - step * g.mean(axis=0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    score = (x @ w + b)[~train]
    best = score.max(axis=1)
    right = (score.argmax(axis=1) == kinds[~train]).astype(float)
    slope, offset = 1.0, 0.0
    for _ in range(2000):
        p = 1 / (1 + np.exp(-(slope * best + offset)))
        slope -= 0.05 * float(((p - right) * best).mean())
        offset -= 0.05 * float((p - right).mean())
    weights = [[round(float(q), 4) for q in row] for row in w]
    return Model(
        families, {f: weights[at[f]] for f in names if isinstance(f, str)}, {f: weights[at[f]] for f in names if not isinstance(f, str)},
        [round(float(q), 4) for q in b], float(slope), float(offset),
    )


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> Model:
    """A model whose examples of no licence hold paragraphs of a bounded sample of the
    corpus, half of it from documents that speak of licences, long ones too."""
    usable = narrow(docs, key, text).where((F.length(text) > 0) & (crc_mod(F.col(key), 5) != 0))
    place = F.pmod(F.xxhash64(key), F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    crops: list[str] = []
    for some in (usable, usable.where(F.col(text).rlike(TALK))):
        rows = first_by_hash(some, key, SAMPLE_DOCS).select(F.col(text).substr(place, F.lit(SAMPLE_CHARS)).alias("crop"))
        crops += [r.crop for r in rows.orderBy(F.xxhash64("crop"), "crop").collect()]
    templates = [pairs_of(words_of(t)) for ts in TEMPLATES.values() for t in ts]
    found = sorted({p for c in crops for p in paragraphs_of(c)})
    random.Random(3).shuffle(found)
    return fit([p for p in found[: 2 * SAMPLE_PARAGRAPHS] if likeness(words_of(p), templates) < TOO_LIKE][:SAMPLE_PARAGRAPHS])


# -- the model as columns ----------------------------------------------------------


class Table:
    """A hash table as a literal: each key is in one of the two slots that its two halves name."""

    def __init__(self, rows: dict[int, int]):
        self.size = 1 << max(4, (4 * len(rows)).bit_length())
        while not self._fill(rows):
            self.size *= 2

    def _slots(self, key: int) -> tuple[int, int]:
        return key % self.size, (key >> 32) % self.size

    def _fill(self, rows: dict[int, int]) -> bool:
        self.cells: list[tuple[int, int] | None] = [None] * self.size
        for item in rows.items():
            slot = self._slots(item[0])[0]
            for _ in range(500):
                item, self.cells[slot] = self.cells[slot], item
                if item is None:
                    break
                a, b = self._slots(item[0])
                slot = b if slot == a else a
            else:
                return False
        return True

    def literals(self) -> tuple[Column, Column]:
        """Keys and values by slot; an empty slot has the value 0."""
        filled = [c or (0, 0) for c in self.cells]
        return tuple(F.from_json(F.lit(json.dumps([c[i] for c in filled])), f"array<{t}>") for i, t in ((0, "bigint"), (1, "int")))

    def lookup(self, key: Column, literals: tuple[Column, Column]) -> Column:
        """The key's value, 0 without one."""
        keys, values = literals
        one = F.pmod(key, F.lit(self.size)).cast("int")
        two = F.pmod(F.shiftright(key, 32), F.lit(self.size)).cast("int")
        return F.when(F.get(keys, one) == key, F.get(values, one)).when(F.get(keys, two) == key, F.get(values, two)).otherwise(0)


def _hash(data: bytes) -> int:
    """xxhash64 as Spark's function of that name gives it for a text."""
    h = xxhash.xxh64_intdigest(data, 42)
    return h - (1 << 64) if h >> 63 else h


_SPREAD = 0x9E3779B1  # spreads codes of pairs over both halves of a long


def _judge(parts: Column, model: Model) -> Column:
    """Families, probabilities and comparisons of parts (paragraph, text, words)."""
    names = {w: i for i, w in enumerate(model.words, 1)}
    wide = len(names) + 1
    code = lambda a, b: (names[a] * wide + names[b]) * _SPREAD
    words = Table({_hash(w.encode()): i for w, i in names.items()})
    pairs = Table({code(a, b): wide + i for i, (a, b) in enumerate(model.pairs)})
    # weights by number: none, then the words', then the pairs'
    weights = F.from_json(F.lit(json.dumps([[0.0] * len(model.families), *model.words.values(), *model.pairs.values()])), "array<array<double>>")
    weighty = F.from_json(F.lit(json.dumps([0, *(int(any(w)) for w in (*model.words.values(), *model.pairs.values()))])), "array<int>")
    word_cells, pair_cells = words.literals(), pairs.literals()
    numbers = {p: wide + i for i, p in enumerate(model.pairs)}

    def numbered(p: Column) -> Column:
        ids = F.transform(F.transform(p["words"], lambda w: F.xxhash64(w)), lambda h: words.lookup(h, word_cells))
        return F.struct(p["paragraph"].alias("paragraph"), p["text"].alias("text"), ids.alias("ids"), F.size(ids).alias("n"))

    def paired(p: Column) -> Column:
        ids = p["ids"]
        n = F.greatest(F.size(ids) - 1, F.lit(0))
        codes = F.zip_with(F.slice(ids, 1, n), F.slice(ids, 2, n), lambda a, b: F.when((a > 0) & (b > 0), (a.cast("long") * wide + b) * F.lit(_SPREAD)).otherwise(F.lit(0).cast("long")))
        found = F.transform(F.filter(F.array_distinct(codes), lambda c: c != 0), lambda c: pairs.lookup(c, pair_cells))
        return F.struct(p["paragraph"].alias("paragraph"), p["text"].alias("text"), F.array_distinct(ids).alias("ids"), found.alias("pairs"), p["n"].alias("n"))

    def summed(p: Column) -> Column:
        some = F.filter(F.concat(p["ids"], p["pairs"]), lambda i: F.get(weighty, i) == 1)
        sums = F.aggregate(some, F.from_json(F.lit(json.dumps(model.bias)), "array<double>"), lambda acc, i: F.zip_with(acc, F.get(weights, i), lambda a, b: a + b))
        return F.struct(p["paragraph"].alias("paragraph"), p["text"].alias("text"), p["pairs"].alias("pairs"), p["n"].alias("n"), sums.alias("sums"))

    def best(p: Column) -> Column:
        top = F.array_max(p["sums"])
        family = F.get(F.array(*map(F.lit, model.families)), F.array_position(p["sums"], top).cast("int") - 1)
        probability = 1 / (1 + F.exp(-(top * model.slope + model.offset)))
        return F.struct(p["paragraph"].alias("paragraph"), p["text"].alias("text"), p["pairs"].alias("pairs"), p["n"].alias("n"), family.alias("family"), probability.alias("probability"))

    def compared(p: Column) -> Column:
        known = p["probability"] >= LIMIT
        both = lambda t: F.size(F.array_intersect(p["pairs"], F.from_json(F.lit(json.dumps(sorted(numbers[x] for x in t))), "array<int>")))
        share = lambda t: both(t) / F.least(F.lit(float(len(t))), F.greatest(p["n"] - 1, F.lit(FRAGMENT)))
        similarity = F.lit(0.0)
        for f, ts in model.templates.items():
            shares = [share(t) for t in ts if t]
            similarity = F.when(known & (p["family"] == f), F.greatest(F.lit(0.0), *shares)).otherwise(similarity)
        return F.struct(
            p["paragraph"].alias("paragraph"), F.when(known, p["text"]).alias("text"), F.when(known, p["family"]).otherwise("unknown").alias("family"),
            p["probability"].alias("probability"), similarity.alias("similarity"),
        )

    for step in (numbered, paired, summed, best, compared):
        parts = F.transform(parts, step)
    return F.transform(parts, lambda p: F.struct(*(p[c].alias(c) for c in ("paragraph", "text", "family", "probability", "similarity")), ((p["family"] != "unknown") & (p["similarity"] >= SHARED)).alias("confirmed")))


def _parts(paragraph: Column, at: Column) -> Column:
    """(paragraph, text, words) of a paragraph, in parts if it is very long."""
    words = F.array_remove(F.split(ascii_lower(paragraph), r"[^a-z0-9]+"), "")
    one = lambda w: F.struct(at.alias("paragraph"), paragraph.alias("text"), w.alias("words"))
    cut = lambda w: F.when(F.size(w) <= PART, F.array(one(w))).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - (PART - STEP), F.lit(STEP)), lambda s: one(F.slice(w, s, PART))))
    return F.flatten(F.transform(F.array(words), cut))  # bound as a variable, so that it is split once


def scan(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and parts: an array of (paragraph, text, family, probability, similarity,
    confirmed) of all paragraphs, a paragraph of over PART words having several.

    text is null for the unknown class.  A row for each row, repeated ones too; null,
    empty and blank texts have an empty array; a paragraph without ASCII words is of
    the unknown class; an empty table gives an empty table; other columns are dropped.
    """
    d = narrow(docs, key, text)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = F.filter(F.split(body, BETWEEN), lambda p: F.length(F.trim(F.translate(p, "\t\r\n", "   "))) > 0)
    return d.select(key, _judge(F.flatten(F.transform(found, _parts)), model).alias("parts"))


def summarize(scanned: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, n_paragraphs, n_licensed and n_confirmed (paragraphs of a family, and those
    confirmed), licenses (confirmed families, sorted, by commas), probability (of the surest)."""
    sure = F.filter("parts", lambda p: p["confirmed"])
    count = lambda some: F.size(F.array_distinct(F.transform(some, lambda p: p["paragraph"]))).cast("long")
    return scanned.select(
        key, F.coalesce(F.array_max(F.transform("parts", lambda p: p["paragraph"])) + 1, F.lit(0)).cast("long").alias("n_paragraphs"),
        count(F.filter("parts", lambda p: p["family"] != "unknown")).alias("n_licensed"), count(sure).alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda p: p["family"]))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("parts", lambda p: p["probability"])), F.lit(0.0)).alias("probability"),
    )


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return summarize(scan(docs, train(docs)))
