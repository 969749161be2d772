"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

A file's own licence is the template nearest to one of its headers: every line,
every run of lines without a blank one, however long, and every piece of a run of
2, 3, 4, 6, 8, 12, ... lines (pieces of one length overlap by half), that could
reach the threshold. So a wrapped header is also found where code follows without
a blank line. A file named like a licence file also stands for its directory. A file without a
licence of its own inherits that of the nearest ancestor directory with a
licence file.

Weights are tf * idf with the idf of the templates' terms counted over all
files; a term that no template has weighs as one that no file has. By Cauchy and
Schwarz a header can only reach the threshold for a template if it holds one of
its anchors: the heaviest terms, such that the others together have less than
the threshold's share of the template's norm. Only lines with an anchor are
scored, which leaves the result as it is.

The inheritance joins the distinct directories, each with all its ancestors,
with the directories of licence files, and keeps the longest match; files then
join their directory's row.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, fresh, table, text_batches

THRESHOLD = 0.6
#: Directories that are sent to all executors, at most.
BROADCAST_DIRS = 100_000

#: Statements by which licences are told.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
}
LICENCE_FILE = r"(?i)^(?:un)?(?:licen[sc]e|copying|copyright|notice)(?:[._-].*)?$"

_TERMS = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: bytes) -> list[bytes]:
    return _TERMS.findall(text.lower())


VOCABULARY = {t for texts in TEMPLATES.values() for x in texts for t in terms_of(x.encode())}


class Scanner:
    """Templates as sparse unit vectors over their terms."""

    def __init__(self, files: int, holding: dict[bytes, int], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.idf = {t: math.log((1 + files) / (1 + holding.get(t, 0))) + 1 for t in VOCABULARY}
        self.other = math.log(1 + files) + 1
        self.names, self.vectors, anchors = [], [], set()
        for name, texts in TEMPLATES.items():
            for x in texts:
                w = {t: n * self.idf[t] for t, n in Counter(terms_of(x.encode())).items()}
                norm = math.sqrt(sum(v * v for v in w.values()))
                self.names.append(name)
                self.vectors.append({t: v / norm for t, v in w.items()})
                rest = 1.0
                for t, v in sorted(self.vectors[-1].items(), key=lambda p: (-p[1], p[0])):
                    if rest < threshold**2 - 1e-9:
                        break
                    anchors.add(t)
                    rest -= v * v
        self.anchors = anchors
        self.find = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(sorted(map(re.escape, anchors))) + rb")(?![0-9a-z\x80-\xff])", re.ASCII)

    def nearest(self, header: bytes) -> tuple[float, str] | None:
        """(cosine, licence) of the nearest template if it reaches the threshold; ties go to the earlier template."""
        counts = Counter(terms_of(header))
        if not counts.keys() & self.anchors:
            return None
        w = {t: n * self.idf.get(t, self.other) for t, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        best = None
        for name, vector in zip(self.names, self.vectors):
            c = sum(v * w[t] for t, v in vector.items() if t in w) / norm
            if c >= self.threshold and (best is None or c > best[0]):
                best = c, name
        return best

    def scan(self, data: bytes | None) -> tuple[str | None, float | None]:
        """Licence and cosine of a whole text's nearest header."""
        low = (data or b"").lower()
        if not low or not self.find.search(low):
            return None, None
        best, tried = None, set()
        for start, end in self.headers(low):
            header = low[start:end]
            if header not in tried:
                tried.add(header)
                got = self.nearest(header)
                if got and (best is None or got[0] > best[0] + 1e-12):
                    best = got
        return (best[1], best[0]) if best else (None, None)

    def headers(self, low: bytes):
        """Spans of the lines with an anchor, of the runs of lines around them, and of the pieces of those."""
        starts = np.array([0, *(m.end() for m in re.finditer(rb"\n", low))], np.int64)
        ends = np.r_[starts[1:] - 1, len(low)]
        hit = np.unique(np.searchsorted(starts, [m.start() for m in self.find.finditer(low)], side="right") - 1)
        blank = np.array([not low[a:b].strip() for a, b in zip(starts.tolist(), ends.tolist())])
        gaps = np.r_[-1, np.flatnonzero(blank), len(starts)]
        for i in hit.tolist():
            yield int(starts[i]), int(ends[i])
        for first, last in sorted({(int(gaps[k - 1]) + 1, int(gaps[k]) - 1) for k in np.searchsorted(gaps, hit, side="left")}):
            if last > first:
                yield int(starts[first]), int(ends[last])
            for a, b in pieces(first, last):
                if np.searchsorted(hit, a) < np.searchsorted(hit, b, side="right"):
                    yield int(starts[a]), int(ends[b])


def pieces(first: int, last: int):
    """Stretches (of lines first to last, both included) of 2, 3, 4, 6, 8, 12, ... of them, each half a length after the one before."""
    size = 2
    while size <= last - first:
        for n in (size, size * 3 // 2):
            if n <= last - first:
                for a in range(first, last - n + 1 + max(1, n // 2), max(1, n // 2)):
                    yield min(a, last - n + 1), min(a, last - n + 1) + n - 1
        size *= 2


def holding(files: DataFrame, text: str) -> tuple[int, dict[bytes, int]]:
    """(files, files that hold each term of the templates), over all files."""

    def run(batches):
        import pyarrow as pa

        seen, n = Counter(), 0
        for b in batches:
            n += b.num_rows
            for x in b.column(0).cast(pa.large_binary()):
                seen.update(VOCABULARY.intersection(terms_of(x.as_py() or b"")))
        yield pa.RecordBatch.from_arrays([pa.array([b"", *seen], pa.binary()), pa.array([n, *seen.values()], pa.int64())], names=["term", "n"])

    rows = text_batches(files).select(F.col(text).cast("binary").alias("t")).mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r.term): r.n for r in rows}
    return counts.pop(b"", 0), counts


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(files: DataFrame, path: str = "path", text: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, ``keep``, own_license, own_score, license, inherited_from (a directory, or null) of each row.

    A null or empty text has no licence of its own; neither has one without a
    header that reaches the threshold. A null path has no directory and inherits
    nothing. Paths part at ``/``; the root directory is the empty string. Of
    several licence files of a directory the highest cosine decides, then the
    first name and path. Repeated rows are files of their own. Very long texts
    are read whole. An empty table gives an empty table. Columns in ``keep``
    that have the name of a result are left out.
    """
    keep = tuple(c for c in keep if c not in (path, "own_license", "own_score", "license", "inherited_from"))
    here, near = fresh("dir"), fresh("near")
    scanner = files.sparkSession.sparkContext.broadcast(Scanner(*holding(files, text), threshold))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [scanner.value.scan(x.as_py()) for x in b.column(0).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*b.schema.names[1:], "own_license", "own_score"])

    data, at = fresh("data"), fresh("path")
    given = files.select(F.col(text).cast("binary").alias(data), F.col(path).alias(at), *keep)
    own = checkpointed(given.mapInArrow(run, given.drop(data).schema.add("own_license", "string").add("own_score", "double")))
    folder = F.when(F.col(at).contains("/"), parent(F.col(at))).when(F.col(at).isNotNull(), F.lit(""))
    name = F.element_at(F.split(F.col(at), "/"), -1)
    own = own.withColumn(here, folder)
    named = own.filter(name.rlike(LICENCE_FILE) & F.col("own_license").isNotNull())
    granted = named.groupBy(here).agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("l"), F.col(at).alias("p"))).alias("g")).select(F.col(here).alias("from"), F.col("g.l").alias("granted"))
    dirs = own.select(here).filter(F.col(here).isNotNull()).distinct()
    parts = F.split(here, "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    found = dirs.select(here, F.explode(F.array_distinct(above)).alias("up")).join(granted, F.col("up") == F.col("from"))
    nearest = checkpointed(found.groupBy(here).agg(F.max_by(F.struct("granted", "from"), F.length("from")).alias(near)))
    small = nearest.count() <= BROADCAST_DIRS
    out = own.join(F.broadcast(nearest) if small else nearest, here, "left")
    inherits = F.col("own_license").isNull()
    return out.select(F.col(at).alias(path), *keep, "own_license", "own_score", F.coalesce("own_license", f"{near}.granted").alias("license"), F.when(inherits, F.col(f"{near}.from")).alias("inherited_from"))


def query(spark, sf_dir):
    """Documents as files ``source/lang/hundred/id``; the first twenty ids of a hundred are named as licence files of their directory."""
    docs = table(spark, sf_dir, "documents")
    hundred = F.floor(F.col("doc_id") / 100).cast("string")
    name = F.when(F.col("doc_id") % 100 < 20, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), hundred, name)
    return scan(docs.withColumn("path", path), keep=("doc_id",))
