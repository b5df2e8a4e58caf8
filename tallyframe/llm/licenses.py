"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallyframe.llm.words import map_with_ids, mix, pick, placed_hashes, steps, text_list

# Notices to look for, by the identifier of the licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-header": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
}
SHINGLE_WORDS, CONTAINMENT = 3, 0.8
BANDS, ROWS = 48, 2
# Upper case to lower, punctuation to blanks; other bytes of a word count as they are.
_FOLD = bytes.maketrans(string.ascii_uppercase.encode() + string.punctuation.encode(), string.ascii_lowercase.encode() + b" " * len(string.punctuation))


def _shingles(h: np.ndarray) -> np.ndarray:
    last = len(h) - SHINGLE_WORDS + 1
    if last <= 0:
        return np.zeros(0, np.uint64)
    key = h[:last]
    for i in range(1, SHINGLE_WORDS):
        key = mix(key * np.uint64(3) + h[i : i + last])
    return key


def _bands(items: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys of a set of shingles."""
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64))
    low = mix(items[:, None] ^ seeds[None, :]).min(axis=0).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        key = mix(key * np.uint64(3) + low[:, i])
    return key


class Templates:
    """Shingle sets, window sizes and band index of a bounded table of notices."""

    def __init__(self, texts: dict[str, str], containment: float = CONTAINMENT, bands: int = BANDS, rows: int = ROWS):
        self.names, self.containment, self.bands, self.rows = list(texts), containment, bands, rows
        self.sets, self.words = [], []
        for t in texts.values():
            h = placed_hashes([t.encode().translate(_FOLD)])[0]
            if len(h) < SHINGLE_WORDS:
                raise ValueError(f"a template needs {SHINGLE_WORDS} words: {t!r}")
            self.sets.append(np.unique(_shingles(h)))
            self.words.append(len(h))
        self.all = np.unique(np.concatenate(self.sets))
        self.bit = np.zeros(1 << 16, bool)
        self.bit[(self.all >> np.uint64(48)).astype(np.int64)] = True
        self.sizes = sorted(set(self.words))
        self.index: dict[tuple[int, int], list[int]] = {}
        for i, s in enumerate(self.sets):
            for key in _bands(s, bands, rows).tolist():
                self.index.setdefault((self.words[i], key), []).append(i)

    def known(self, items: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bit[(items >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.all, items[maybe]), len(self.all) - 1)
        return maybe[self.all[at] == items[maybe]]

    def matches(self, items: np.ndarray, hits: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first word, end word) in a text's shingles, of which ``hits`` are places of known ones.

        Windows are a quarter longer than a template and start every quarter of it, so that one of them holds any
        occurrence whole. A window without a known shingle shares no band with a template and is passed over.
        """
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n in self.sizes:
            stride = max(1, n // 4)
            width = n + stride - SHINGLE_WORDS + 1  # shingles of a window
            starts = np.unique(np.concatenate([np.maximum(0, hits // stride - i) * stride for i in range(-(-width // stride) + 1)]))
            for a in starts.tolist():
                b = min(a + width, len(items))
                inside = hits[(hits >= a) & (hits < b)]
                if not len(inside):
                    continue
                window = np.unique(items[a:b])
                ids = {t for key in _bands(window, self.bands, self.rows).tolist() for t in self.index.get((n, key), ())}
                for t in ids:
                    own = inside[np.isin(items[inside], self.sets[t])]
                    if len(np.unique(items[own])) >= self.containment * len(self.sets[t]) - 1e-9:
                        at = (t, int(own[0]), int(own[-1]) + SHINGLE_WORDS)
                        found.setdefault(at[:2], at)
        return self.apart(list(found.values()))

    @staticmethod
    def apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Of overlapping finds of one template the longest, then the first."""
        out: list[tuple[int, int, int]] = []
        for t, a, b in sorted(found, key=lambda x: (x[0], x[1] - x[2], x[1])):
            if not any(u == t and a < d and c < b for u, c, d in out):
                out.append((t, a, b))
        return out


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document: ``n_notices``, ``spans`` (name:start:end by start, code points, end exclusive), ``licenses``.

    Words are folded to lower case without punctuation and read as three-word shingles. Windows of each template's size
    class go through 96 min-hashes in 48 bands of 2: a window that holds a template has a similarity of 0.5 or more with
    it and shares a band with probability 1 - 1e-6. What a band retrieves is verified by the exact share of the
    template's shingles in the window.

    A null or empty text has no notices. Rows stand for themselves; an empty table gives no rows. A notice that several
    templates describe is reported for each.
    """
    known = Templates(templates or TEMPLATES, containment)

    def scan(texts: list[str]) -> list[list[tuple[int, int, str]]]:
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for part in steps(texts):
            raw = [t.encode("utf-8", "replace") for t in texts[part]]
            h, doc, start, end = placed_hashes([x.translate(_FOLD) for x in raw])
            items = _shingles(h)
            if not len(items):
                continue
            hit = known.known(items)
            hit = hit[doc[hit] == doc[hit + SHINGLE_WORDS - 1]]
            first = np.searchsorted(doc, np.arange(len(raw) + 1))
            for d in np.unique(doc[hit]):
                low, high = first[d], first[d + 1]
                own = items[low : max(low, high - SHINGLE_WORDS + 1)]
                for t, a, b in known.matches(own, hit[doc[hit] == d] - low):
                    place = [len(raw[d][:x].decode("utf-8")) for x in (int(start[low + a]), int(end[low + b - 1]))]
                    out[part.start + int(d)].append((place[0], place[1], known.names[t]))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                found = [sorted(x) for x in scan(text_list(b["t"]))]
                yield pd.DataFrame({
                    "doc_id": b["doc_id"].to_numpy(), "n_notices": [len(x) for x in found],
                    "spans": [",".join(f"{n}:{a}:{e}" for a, e, n in x) for x in found],
                    "licenses": [",".join(sorted({n for _, _, n in x})) for x in found],
                })

    return map_with_ids(pick(docs, doc_id=doc_id, t=text), run, "n_notices long, spans string, licenses string")
