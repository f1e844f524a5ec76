"""License scans of texts.

Method: windows of each template's length slide over a text; MinHash bands of a window's word shingles retrieve
templates, and exact containment of the template's shingles in the text around the window verifies them.
With ROWS values in each of BANDS bands, a window of similarity s to a template is retrieved with probability
1 - (1 - s**ROWS)**BANDS: 0.99 at 0.5, 0.9999 at 0.66. Templates are a bounded table that travels with the function, so
scanning is a map over rows: no shuffle. Windows without any shingle of a template share no MinHash value with it,
so only the others are hashed.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from reminisce.llm.common import Hashes, mix, shingles, words

SHINGLE, BANDS, ROWS = 5, 16, 2

#: Notices and the marked paragraphs of common licenses.
TEMPLATES = [
    ("all-rights-reserved", "All rights reserved."),
    ("mit-notice", "Released under the MIT License."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
]


class Matcher:
    """Templates by length, with the band keys of their shingles."""

    def __init__(self, templates: list[tuple[str, str]], least: float):
        rng = np.random.default_rng(3)
        self.factors = rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
        self.least, self.hashes = least, Hashes()
        self.classes: dict[tuple[int, int], dict] = {}  # (words, shingle size) -> names, shingles, band keys
        for name, text in templates:
            w = words(text)
            if not w:
                continue
            k = min(SHINGLE, len(w))
            own = self.classes.setdefault((len(w), k), {"names": [], "sets": [], "keys": {}})
            s = np.unique(shingles(self.hashes.of(w), k))
            for b, key in enumerate(self.keys(s)):
                own["keys"].setdefault((b, key), []).append(len(own["names"]))
            own["names"].append(name)
            own["sets"].append(s)
        for own in self.classes.values():
            own["all"] = np.unique(np.concatenate(own["sets"]))

    def keys(self, s: np.ndarray) -> list[int]:
        """One number a band: its MinHash values over the shingles, mixed."""
        least = mix(s[:, None] * self.factors).min(0).reshape(BANDS, ROWS)
        return (least[:, 0] * np.uint64(31) + least[:, 1]).tolist()

    def find(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(template, first word, word after the last, containment), by place; overlapping ones of a template but once."""
        tokens = words(text)
        h, found, by_size = self.hashes.of(tokens), [], {}
        for (n, k), own in self.classes.items():
            if len(tokens) < k:
                continue
            if k not in by_size:
                by_size[k] = shingles(h, k)
            s = by_size[k]
            hits = np.flatnonzero(np.isin(s, own["all"]))
            if not len(hits):
                continue
            step, span = max(1, n // 8), n - k + 1
            last = max(0, len(s) - span)
            starts = np.unique(np.clip(np.concatenate([np.arange((p - span) // step + 1, p // step + 1) for p in hits.tolist()]) * step, 0, last))
            for start in np.unique(np.r_[starts, last] if hits[-1] >= last else starts).tolist():
                window = s[start : start + span]
                for t in {t for b, key in enumerate(self.keys(window)) for t in own["keys"].get((b, key), ())}:
                    a = max(0, start - step)
                    near = s[a : start + span + step]
                    inside = np.flatnonzero(np.isin(near, own["sets"][t]))
                    share = len(np.unique(near[inside])) / len(own["sets"][t])
                    if share >= self.least:
                        found.append((-share, a + int(inside[0]), a + int(inside[-1]) + k, own["names"][t]))
        kept: list[tuple[str, int, int, float]] = []
        places: dict[str, list[tuple[int, int]]] = {}  # by name, in order and apart from each other
        for share, a, b, name in sorted(set(found)):
            own = places.setdefault(name, [])
            i = bisect_left(own, (b, 0))
            if not i or own[i - 1][1] <= a:
                own.insert(i, (a, b))
                kept.append((name, a, b, -share))
        return sorted(kept, key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """doc_id, license, start_word, end_word (exclusive), containment: a row for each place where a template is found.

    Shingles are of SHINGLE words, or of all words of a shorter template. Null and empty texts have no matches; repeated
    rows have theirs each. Whole texts are scanned. The templates are a parameter; their number is what bounds memory.
    """
    schema = T.StructType([docs.select("doc_id").schema[0], T.StructField("license", T.StringType()), T.StructField("start_word", T.IntegerType()), T.StructField("end_word", T.IntegerType()), T.StructField("containment", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, least)
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                made = [(i, *x) for i, text in enumerate(part.column("text").to_pylist()) for x in matcher.find(text)]
                c = list(zip(*made, strict=True)) or [[]] * 5
                yield pa.record_batch([part.column("doc_id").take(pa.array(c[0], pa.int64())), pa.array(c[1], pa.string()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.float64())], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
