"""License scans: TF-IDF cosine to templates, then inheritance from directories.

A *passage* is a run of neighbouring lines that hold a licence cue, with the
lines between them if they are few and some that follow; whole texts are searched.  Lines can be long,
so a passage stands for itself and for *windows* in it: runs of up to ``RUN``
sentences around a cue, and of a sentence over ``LONG`` words, pieces about as
long as the templates around each cue.  The best of them counts.  Windows and
templates are sparse TF-IDF vectors of words and word pairs.  Document
frequencies count all passages of all files (and the templates); terms that no
template has weigh as the rarest do, so foreign words lower a cosine.  A file's
own licence is its best window's best template, if the cosine is ``LEAST`` or
more.

A licence *file* (by its name, or since one window that matches is ``BODY`` of its
text) gives its licence to its directory.  A file without an own one inherits from the nearest
directory above it that has one: distinct directories are exploded into their
ancestors and joined with the licensed ones, then files with their directories,
so the root is a key of as many rows as there are directories, not files.

Edge cases: a null or empty text has no own licence; a null path has no
directory and inherits nothing; of several licence files in a directory the best
score decides, then the smallest licence id; ties of templates go to the smaller
id; repeated rows repeat; a long text is searched to its end, in time in
proportion to it and its cues; other columns, whatever their names, aren't read,
and a kept one can't be named as a result; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut

LEAST = 0.6
GAP = 2  #: lines without a cue that a passage may run over
TAIL = 5  #: lines that follow a passage's last cue: wrapped sentences end there
BODY = 0.9  #: share of a text that makes it a licence file
RUN, LONG = 4, 60  #: sentences of a window, and words of a sentence that is cut into pieces
WHOLE = 28  #: words of templates that pieces over several sentences are made for

#: Licence ids and the notices that stand for them.  Fixed values.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal, public domain."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Proprietary and confidential. Unauthorized copying of this file is prohibited. All rights reserved."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989 Copyright (C) 1989 Free Software Foundation, Inc. 51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1991 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002 Copyright (C) 2000,2001,2002 Free Software Foundation, Inc. 51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008 Copyright (C) 2000, 2001, 2002, 2007, 2008 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1 1. Definitions. 1.0.1. \"Commercial Use\" means distribution or otherwise making the Covered Code available to a third party. 1.1. \"Contributor\" means each entity that creates or contributes to the creation of Modifications."),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1 --------------- 1. Definitions."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("EPL-2.0", "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."),
    ("Artistic-1.0", "The \"Artistic License\" Preamble The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software."),
    ("PSF-2.0", "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2 1. This LICENSE AGREEMENT is between the Python Software Foundation (\"PSF\"), and the Individual or Organization (\"Licensee\") accessing and otherwise using this software (\"Python\") in source or binary form and its associated documentation."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP."),
]

#: What a line has to hold, in any case.
CUES = ("licen", "rights reserved", "copyright", "©", "spdx", "warrant", "redistribut", "permission", "public domain", "creative commons", "proprietary", "cc0", "cc by")
_CUE = re.compile("(?i)licen[sc]|rights reserved|copyright|©|spdx|warrant|redistribut|permission (?:is|to)|public domain|creative commons|proprietary|\\bcc0\\b|\\bcc by\\b")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")
_WORD = re.compile(r"\S+")
_TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_NAMES = r"(?i)^(un)?licen[sc]e([.-].*)?$|^copying([.-].*)?$|^notice([.-].*)?$"


def terms(text: str) -> Counter:
    """Words and word pairs."""
    words = _TERM.findall(text.lower())
    return Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


def _runs(text: str | None) -> tuple[list[str], list[list[int]]]:
    """The lines of a text, and the runs of them with licence cues."""
    if not text or not any(c in low for low in (text.lower(),) for c in CUES):
        return [], []
    lines = text.split("\n")
    hits = [i for i, line in enumerate(lines) if _CUE.search(line)]
    out: list[list[int]] = []
    for i in hits:
        if out and i - out[-1][1] <= GAP + 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return lines, out


def passages(text: str | None) -> list[str]:
    """Runs of lines with licence cues."""
    lines, runs = _runs(text)
    return ["\n".join(lines[a : b + 1]) for a, b in runs]


def searched(text: str | None, sizes: tuple[int, ...]):
    """The windows of all passages, and of these with the lines that follow them."""
    lines, runs = _runs(text)
    for a, b in runs:
        yield from dict.fromkeys([*windows("\n".join(lines[a : b + 1]), sizes), *windows("\n".join(lines[a : b + 1 + TAIL]), sizes)])


def windows(passage: str, sizes: tuple[int, ...]) -> list[str]:
    """The passage and the windows in it; ``sizes``: numbers of words of the templates."""
    out = {passage: None}
    sentences = _SENTENCE.split(passage)
    cued = [i for i, x in enumerate(sentences) if _CUE.search(x)]
    if len(sentences) > 1:
        for i in cued:
            for n in range(1, RUN + 1):
                for a in range(max(0, i - n + 1), min(i, len(sentences) - n) + 1):
                    out[" ".join(sentences[a : a + n])] = None
    for i in cued:
        spans = [m.span() for m in _WORD.finditer(sentences[i])]
        if len(spans) <= LONG:
            continue
        ends = [b for _, b in spans]
        for m in _CUE.finditer(sentences[i]):
            at = min(bisect_left(ends, m.start() + 1), len(spans) - 1)
            for n in sizes:
                for a in {max(0, at - k) for k in (0, n // 3, 2 * n // 3, n - 1)}:
                    out[sentences[i][spans[a][0] : spans[min(a + n, len(spans)) - 1][1]]] = None
    # from each such sentence on as many words as the longer templates have
    words = [m.span() for m in _WORD.finditer(passage)]
    starts, at = [], 0
    for i, x in enumerate(sentences):
        at = passage.index(x, at)
        if i == 0 or _CUE.search(x):
            starts.append(bisect_left(words, (at, at)))
        at += len(x)
    for a in starts:
        for n in sizes:
            if n >= WHOLE and a + n // 2 < len(words):
                out[passage[words[a][0] : words[min(a + n, len(words)) - 1][1]]] = None
    return list(out)


class Matcher:
    """Templates as normalised sparse vectors under given document frequencies."""

    def __init__(self, templates, df: dict[str, int], n: int):
        self.rare = math.log(1 + n) + 1
        self.idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
        self.names = [name for name, _ in templates]
        self.words = [len(text.split()) for _, text in templates]
        self.sizes = tuple(sorted(set(self.words)))
        self.rows: dict[str, list[tuple[int, float]]] = {}
        for k, (_, text) in enumerate(templates):
            for t, w in self._vector(text).items():
                self.rows.setdefault(t, []).append((k, w))

    def _vector(self, text: str) -> dict[str, float]:
        v = {t: (1 + math.log(c)) * self.idf.get(t, self.rare) for t, c in terms(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    def of_text(self, text: str | None, least: float) -> tuple[float, str | None, float]:
        """Score and name of the best window of a whole text, and the largest share of the text that a matching window is."""
        best, share = (0.0, 0.0, None), 0.0
        for w in searched(text, self.sizes):
            score, name, words = self._best(w)
            evidence = (score - 0.5) * math.sqrt(words) if score >= least else 0.0
            if (evidence, score) > best[:2] or (evidence, score) == best[:2] and name and name < (best[2] or name + "x"):
                best = evidence, score, name
            if score >= least:
                share = max(share, len(w) / len(text))
        return *best[1:], share

    def best(self, passage: str) -> tuple[float, str | None]:
        return self._best(passage)[:2]

    def _best(self, passage: str) -> tuple[float, str | None, int]:
        """The best template's cosine, its name and its words; ties go to the smaller name, then to the longer template."""
        dots = [0.0] * len(self.names)
        for t, w in self._vector(passage).items():
            for k, x in self.rows.get(t, ()):
                dots[k] += w * x
        score = round(max(dots), 9)  # equal texts and equal scores tie whatever the order of their sums
        if score <= 0:
            return 0.0, None, 0
        name, words = min((n, -k) for n, k, d in zip(self.names, self.words, dots, strict=True) if round(d, 9) >= score)
        return score, name, -words


@cache
def _vocabulary(templates) -> frozenset:
    return frozenset(t for _, text in templates for t in terms(text))


def frequencies(files: DataFrame, text: str, templates) -> tuple[dict[str, int], int]:
    """Passages that hold each term of the templates, and passages, over all files and the templates."""
    vocabulary = _vocabulary(templates)

    def run(batches):
        for b in batches:
            seen: Counter = Counter()
            for t in b.column(0):
                for p in passages(t.as_py()):
                    seen[""] += 1
                    seen.update(vocabulary & terms(p).keys())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    rows = files.select(text).mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = Counter({r.term: r.n for r in rows})  # no more rows than terms of the templates
    for _, body in templates:
        df.update([*terms(body), ""])
    return {t: n for t, n in df.items() if t}, df[""]


def scan(files: DataFrame, path: str = "path", text: str = "text", templates=tuple(TEMPLATES), least: float = LEAST, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: the path) and ``license, score, origin, from_dir`` of every file.

    ``origin``: ``own``, ``inherited`` (from ``from_dir``) or ``none``.
    """
    keep = [path] if keep is None else keep
    if clash := {"license", "score", "origin", "from_dir", "own", "__path", "__text", "__score", "__share", "__dir"} & {c.lower() for c in keep}:
        raise ValueError(f"results would be named as the kept {sorted(clash)}")
    matcher = Matcher(templates, *frequencies(files, text, templates))
    narrow = files.select(*keep, F.col(path).alias("__path"), F.col(text).alias("__text"))
    kept = [f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches):
        for b in batches:
            names, scores, shares = [], [], []
            for t in b.column(b.num_columns - 1):
                score, name, share = matcher.of_text(t.as_py(), least)
                names.append(name if score >= least else None)
                scores.append(score)
                shares.append(share)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())], names=[*keep, "__path", "own", "__score", "__share"])

    scored = cut(narrow.mapInArrow(run, ", ".join([*kept, "__path string, own string, __score double, __share double"])))
    folder = F.regexp_extract("__path", r"^(.*)/[^/]*$", 1)
    scored = scored.withColumn("__dir", folder)
    is_file = F.regexp_extract("__path", r"([^/]*)$", 1).rlike(_NAMES) | (F.col("__share") >= BODY)
    givers = scored.where(F.col("own").isNotNull() & F.col("__path").isNotNull() & is_file)
    given = givers.groupBy("__dir").agg(F.min(F.struct((-F.col("__score")).alias("s"), F.col("own").alias("license"))).alias("x")).select(F.col("__dir").alias("above"), "x.license", (-F.col("x.s")).alias("score"))
    dirs = scored.where(F.col("__path").isNotNull()).select("__dir").distinct()
    parts = F.split("__dir", "/")
    up = dirs.select("__dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("above")).distinct()
    near = up.join(given, "above").groupBy("__dir").agg(F.max_by(F.struct("license", "score", "above"), F.length("above")).alias("got"))
    both = scored.join(near, "__dir", "left")
    own, got = F.col("own").isNotNull(), F.col("got").isNotNull() & F.col("__path").isNotNull()
    return both.select(
        *keep,
        F.when(own, F.col("own")).when(got, F.col("got.license")).alias("license"),
        F.when(own, F.col("__score")).when(got, F.col("got.score")).otherwise(F.lit(0.0)).alias("score"),
        F.when(own, "own").when(got, "inherited").otherwise("none").alias("origin"),
        F.when(~own & got, F.col("got.above")).alias("from_dir"),
    )
