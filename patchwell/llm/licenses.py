"""License scans by patience alignment of texts with templates.

A place where a template may begin is aligned with it: equal heads and tails first, then the words that occur once on
both sides are anchors, the longest increasing run of them stays, and the gaps between them are aligned the same way.
Coverage is the share of the template's words that found their place. A text is only cut into words if it holds one
of the words that no alignment of enough coverage could miss.

Defined results: null and empty texts have no matches; every place that matches gives a row, overlapping ones of one
template give the first; repeated rows give repeated matches; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "all-rights-reserved": "All rights reserved.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
                 "(the \"Software\"), to deal in the Software without restriction",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                  "as published by the Free Software Foundation",
}


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs whose second parts increase; pairs come in the order of their first parts."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect.bisect_left(tails, j)
        back[n] = at[k - 1] if k else -1
        tails[k:k + 1], at[k:k + 1] = [j], [n]
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def align(a: list[str], b: list[str], i: int = 0, j: int = 0) -> list[tuple[int, int]]:
    """Pairs of positions of equal words in ``a`` and ``b``, increasing on both sides."""
    head, n, m = [], len(a), len(b)
    start = 0
    while start < min(n, m) and a[start] == b[start]:
        head.append((i + start, j + start))
        start += 1
    end = 0
    while end < min(n, m) - start and a[n - 1 - end] == b[m - 1 - end]:
        end += 1
    tail = [(i + n - e, j + m - e) for e in range(end, 0, -1)]
    a, b, i, j = a[start:n - end], b[start:m - end], i + start, j + start
    if not a or not b:
        return head + tail
    count_a, count_b = Counter(a), Counter(b)
    where = {w: y for y, w in enumerate(b) if count_b[w] == 1}
    anchors = increasing([(x, where[w]) for x, w in enumerate(a) if w in where and count_a[w] == 1])
    out, x0, y0 = [], 0, 0
    for x, y in [*anchors, (len(a), len(b))] if anchors else []:
        out += align(a[x0:x], b[y0:y], i + x0, j + y0)
        if x < len(a):
            out.append((i + x, j + y))
        x0, y0 = x + 1, y + 1
    return head + out + tail


@dataclass
class Match:
    license: str
    coverage: float
    begin: int
    end: int
    words: int


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float) -> None:
        import re

        self.word, self.coverage = re.compile(r"[^\W_]+"), coverage
        self.templates = {}
        for name, text in templates.items():
            words = self.word.findall(text.lower())
            missing = int(len(words) * (1 - coverage) + 1e-9)  # words that may be missing
            needed = set(sorted(words, key=lambda w: (-len(w), w))[:missing + 1])  # one of these words of the template is always there
            self.templates[name] = (words, Counter(words), set(words[:missing + 1]), needed)

    def scan(self, text: str) -> list[Match]:
        low, cut, out = text.lower(), None, []
        for name, (template, vocabulary, first, needed) in self.templates.items():
            if not any(w in low for w in needed):
                continue
            if cut is None:
                spans = [(m.group().lower(), m.start(), m.end()) for m in self.word.finditer(text)]
                cut, places = [s[0] for s in spans], {}
                for at, w in enumerate(cut):
                    places.setdefault(w, []).append(at)
            enough, free = self.coverage * len(template) - 1e-9, 0
            for at in sorted(p for w in first for p in places.get(w, ())):
                if at < free:
                    continue
                window = cut[at:at + 2 * len(template)]
                if sum((Counter(w for w in window if w in vocabulary) & vocabulary).values()) < enough:
                    continue
                pairs = align(window, template)
                if len(pairs) >= enough:
                    begin, end = spans[at + pairs[0][0]], spans[at + pairs[-1][0]]
                    out.append(Match(name, len(pairs) / len(template), begin[1], end[2], len(pairs)))
                    free = at + pairs[-1][0] + 1
        return out


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, coverage, begin, end, words): every place of every whole text that covers enough of a template."""
    names = {**(TEMPLATES if templates is None else templates)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(names, coverage)
        for f in frames:
            rows = [(key, m.license, m.coverage, m.begin, m.end, m.words) for key, text in zip(f[id_col], f["text"], strict=True) if text for m in scanner.scan(text)]
            out = pd.DataFrame(rows, columns=[id_col, "license", "coverage", "begin", "end", "words"])
            out[id_col] = out[id_col].astype("Int64")
            yield out

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInPandas(
        run, f"{id_col} long, license string, coverage double, begin int, end int, words int")
