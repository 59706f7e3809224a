"""License scans: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, hashed_words, id_in, id_out, lean, prepared
from .decontamination import plain

#: Words of a fingerprint, and fingerprints of a winnowing window.
GRAM, WINDOW = 3, 4
#: Diagonals on either side of a candidate's.
BAND = 8
#: Least share of a template's words that the alignment matches.
COVERAGE = 0.75
#: Public licence notices, as fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT": "Released under the MIT License",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL": "licensed under the GNU Lesser General Public License",
    "BSD text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0 short": "Licensed under CC BY 4.0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}


def grams(words: np.ndarray, n: int = GRAM) -> np.ndarray:
    out = words[: max(0, len(words) - n + 1)].copy()
    for k in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k]
    return out


def winnowed(fingerprints: np.ndarray) -> list[tuple[int, int]]:
    """(fingerprint, position) of the least of every WINDOW successive fingerprints, the last of equal ones."""
    found = {}
    for i in range(max(1, len(fingerprints) - WINDOW + 1)):
        part = fingerprints[i : i + WINDOW]
        if len(part):
            k = i + len(part) - 1 - int(np.argmin(part[::-1]))
            found[k] = int(fingerprints[k])
    return [(v, k) for k, v in sorted(found.items())]


def aligned(template: np.ndarray, words: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """Matched words, and first and last + 1 matched word of the text, of the best alignment within the band.

    Row i, column j: template word i on text word i + diagonal + j - BAND. Gaps and mismatches cost half a match.
    """
    width = 2 * BAND + 1
    score, start, hits = (np.zeros((len(template) + 1, width + 2)) for _ in range(3))
    start[:] = -1
    best = (0.0, 0, 0, 0)
    for i in range(1, len(template) + 1):
        for j in range(1, width + 1):
            at = i - 1 + diagonal + j - 1 - BAND
            if not 0 <= at < len(words):
                continue
            equal = template[i - 1] == words[at]
            options = ((score[i - 1, j] + (1.0 if equal else -0.5), i - 1, j, equal), (score[i - 1, j + 1] - 0.5, i - 1, j + 1, False), (score[i, j - 1] - 0.5, i, j - 1, False))
            s, a, b, e = max(options, key=lambda x: x[0])
            if s <= 0:
                continue
            score[i, j], hits[i, j] = s, hits[a, b] + e
            start[i, j] = start[a, b] if score[a, b] > 0 else at
            if s > best[0]:
                best = (s, int(hits[i, j]), int(start[i, j]), at + 1)
    return best[1:]


def _centres(hits: Counter) -> list[int]:
    """Of every run of diagonals that one band covers, the one with most hits."""
    found, order, i = [], sorted(hits), 0
    while i < len(order):
        j = i
        while j < len(order) and order[j] - order[i] <= BAND:
            j += 1
        found.append(max(order[i:j], key=lambda d: (hits[d], -d)))
        i = j
    return found


class Templates:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = [hashed_words(plain(t))[0] for t in templates.values()]
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, w in enumerate(self.words):
            for fingerprint, at in winnowed(grams(w)):
                self.index[fingerprint].append((t, at))
        self.keys = np.array(sorted(self.index), np.uint64)

    def scan(self, words: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(template, coverage, first, last + 1 word) of alignments that cover enough, without overlaps."""
        found, own = [], grams(words)
        where = np.flatnonzero(np.isin(own, self.keys))
        diagonals: dict[int, Counter] = defaultdict(Counter)
        for p in where.tolist():
            for t, at in self.index[int(own[p])]:
                diagonals[t][p - at] += 1
        done: dict[int, int] = {}
        for t, d in ((t, d) for t in sorted(diagonals) for d in _centres(diagonals[t])):
            if d + BAND < done.get(t, -(1 << 60)):
                continue
            hits, a, b = aligned(self.words[t], words, d)
            if hits >= COVERAGE * len(self.words[t]):
                done[t] = b
                if (t, b) not in {(x[0], x[3]) for x in found}:
                    found.append((t, hits / len(self.words[t]), a, b))
        best: list[tuple[int, float, int, int]] = []  # of overlapping notices the one with most words
        for x in sorted(found, key=lambda x: (-x[1] * len(self.words[x[0]]), -x[1], x)):
            if all(x[3] <= y[2] or x[2] >= y[3] for y in best):
                best.append(x)
        return sorted(best, key=lambda x: x[2])


def scan(spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence notices in whole texts: a row for each notice and template.

    Every word triple of a text is looked up among the winnowed fingerprints of the templates, whose number is that of
    the template table and not of the input. Each hit's diagonal is aligned in a band, so changed, missing and added
    words are allowed for. Null and empty texts have none; texts are judged row by row, so repeated rows give repeated
    results and ids may be null. An empty table gives no rows; other columns are not used.
    Columns: doc_id, license, coverage, start, end (code points of the text, end exclusive).
    """
    prepared(spark)
    known = Templates(TEMPLATES if templates is None else templates)

    @lean
    def search(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in rows:
            ids, texts, out = x["doc_id"].tolist(), x["text"].tolist(), []
            raw = [plain(t) for t in texts]
            for i, j in batches(raw):
                words, start, end = hashed_words(b"\n".join(raw[i:j]))
                begin = np.r_[0, np.cumsum([len(t) + 1 for t in raw[i:j]])]
                at = np.searchsorted(start, begin)
                hit = np.isin(grams(words), known.keys)
                some = np.unique(np.searchsorted(at, np.flatnonzero(hit), "right") - 1)
                for k in some.tolist():
                    a, b = int(at[k]), int(at[k + 1])
                    for t, coverage, p, q in known.scan(words[a:b]):
                        u, v = (int(e) for e in (start[a + p] - begin[k], end[a + q - 1] - begin[k]))
                        u, v = (len(raw[i + k][:e].decode("utf-8", "replace")) for e in (u, v))
                        out.append((ids[i + k], known.names[t], coverage, u, v))
            yield pd.DataFrame(out, columns=["doc_id", "license", "coverage", "start", "end"])

    rows = docs.select(id_in(id_col), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInPandas(search, "doc_id long, license string, coverage double, start long, end long").withColumn("doc_id", id_out())
