from collections import Counter
from pathlib import Path
import pytest

from tesserae.llm import licenses


@pytest.mark.parametrize(("name", "text"), licenses.TEMPLATES)
def test_templates_match_themselves(name, text):
    df = {}
    m = licenses.Matcher(licenses.TEMPLATES, df, len(licenses.TEMPLATES))
    score, got = m.best(text)
    assert got == name and score > 0.999


def test_passages_are_of_whole_texts():
    text = "\n".join(["word " * 20] * 5000 + ["Released under the MIT License."])
    assert licenses.passages(text) == ["Released under the MIT License."]
    assert licenses.passages(None) == licenses.passages("") == licenses.passages("nothing here") == []
    joined = "# Copyright 2020 A\n#\n# Licensed under the MIT License.\nx = 1\ny = 2\nz = 3\nAll rights reserved."
    assert len(licenses.passages(joined)) == 2


def test_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "LICENSE", mit), (2, "a/b/c/x.txt", "plain words"), (3, "a/LICENSE.md", gpl), (4, "a/x.txt", "plain"), (5, "ab/y.txt", "plain"),
        (6, "ab/z.txt", "one line\n" * 20 + "All rights reserved."), (7, None, "plain"), (8, "q/r.txt", None), (8, "q/r.txt", None), (9, "a/b/COPYING", "words only"),
    ]
    files = spark.createDataFrame([(*r, "x") for r in rows], "id int, path string, text string, license string")
    got = {r.id: (r.license, r.origin, r.from_dir) for r in licenses.scan(files, keep=["id"]).collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("GPL-3.0", "inherited", "a"), 3: ("GPL-3.0", "own", None), 4: ("GPL-3.0", "inherited", "a"), 5: ("MIT", "inherited", ""),
        6: ("Proprietary", "own", None), 7: (None, "none", None), 8: ("MIT", "inherited", ""), 9: ("GPL-3.0", "inherited", "a"),
    }
    assert licenses.scan(files, keep=["id"]).count() == len(rows)
    assert licenses.scan(files.limit(0), keep=["id"]).count() == 0


def test_foreign_words_lower_the_score():
    m = licenses.Matcher(licenses.TEMPLATES, {}, 30)
    assert m.best("the license of my bicycle expired in May, so the police stopped me")[0] < licenses.LEAST


@pytest.mark.parametrize("cue", ["LIcensed under the MIT LIcense.", "RiGHTS reserved", "Cc By 4.0", "Spdx id", "CREATIVE commons"])
def test_cues_in_any_case(cue):
    assert licenses.passages("x\n" + cue + "\ny") == [cue]


def test_notices_inside_long_lines():
    m = licenses.Matcher(licenses.TEMPLATES, {}, 30)
    prose = "The weather of that summer was mild and the harvest came early, which nobody in the village had hoped for. "
    for notice, name in (("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0")):
        for text in (prose * 40 + notice + " " + prose * 3, prose + prose + notice + " " + prose, (prose.replace(".", "") * 40 + notice[:-1] + " " + prose.replace(".", "") * 9), notice + " " + prose * 60 + "Copyright ours."):
            score, got, share = m.of_text(text, licenses.LEAST)
            assert got == name and score >= licenses.LEAST and share < 0.2, (text[-60:], score, got)
    import time

    began = time.time()
    assert m.of_text((prose * 5 + "the license of my bicycle expired. ") * 2000, licenses.LEAST)[0] < licenses.LEAST and time.time() - began < 60


def test_scan_against_brute_force(spark):
    """Dense cosines of every window and a climb through the directories, one file after another."""
    import random

    import numpy as np

    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(160):
        folder = "/".join(r.choice("abc") for _ in range(r.randint(0, 4)))
        parts = [" ".join(r.choices(words, k=r.randint(1, 30))) + "." for _ in range(r.randint(1, 5))]
        if r.random() < 0.4:
            parts.insert(r.randrange(len(parts)), r.choice(licenses.TEMPLATES)[1])
        if r.random() < 0.2:
            parts.append("Some license or copyright of nobody.")
        body = r.choice([" ", "\n"]).join(parts)
        if r.random() < 0.15:
            body = r.choice(licenses.TEMPLATES)[1]
        rows.append((i, f"{folder}/{r.choice(['LICENSE', 'x.txt', 'copying.md', 'y.py'])}".lstrip("/"), body))
    files = spark.createDataFrame(rows, "id int, path string, text string").repartition(3)
    got = {x.id: (x.license, round(x.score, 9), x.origin, x.from_dir) for x in licenses.scan(files, keep=["id"]).collect()}

    held = [p for _, _, t in rows for p in licenses.passages(t)] + [t for _, t in licenses.TEMPLATES]
    known = sorted({w for _, t in licenses.TEMPLATES for w in licenses.terms(t)})
    idf = {w: np.log((1 + len(held)) / (1 + sum(w in licenses.terms(p) for p in held))) + 1 for w in known}
    rare = np.log(1 + len(held)) + 1

    def cosine(a, b):
        a, b = licenses.terms(a), licenses.terms(b)
        every = sorted(a.keys() | b.keys())
        x, y = (np.array([(1 + np.log(c[w])) * idf.get(w, rare) if c[w] else 0.0 for w in every]) for c in (a, b))
        return float(x @ y / np.sqrt((x @ x) * (y @ y))) if a and b else 0.0

    sizes = tuple(sorted({len(t.split()) for _, t in licenses.TEMPLATES}))
    own, gives = {}, {}
    for i, path, t in rows:
        found, ranked = [], []
        for w in licenses.searched(t, sizes):  # of each window the best template; of all windows the one with the most evidence
            every = [(round(cosine(w, body), 9), name, len(body.split())) for name, body in licenses.TEMPLATES]
            found += [(c, name, len(w)) for c, name, _ in every]
            most = max(c for c, _, _ in every)
            c, name, n = min((x for x in every if x[0] >= most), key=lambda x: (x[1], -x[2]))
            ranked.append(((c - 0.5) * np.sqrt(n) if c >= licenses.LEAST else 0.0, c, name))
        score = max(((e, c) for e, c, _ in ranked), default=(0.0, 0.0))[1]
        name = min((n for e, c, n in ranked if (e, c) == max((e, c) for e, c, _ in ranked)), default=None)
        folder, _, file = path.rpartition("/")
        if score >= licenses.LEAST:
            own[i] = (name, score)
            body = any(f[0] >= licenses.LEAST and f[2] >= licenses.BODY * len(t) for f in found)
            if body or file.lower().startswith(("license", "copying")):
                gives[folder] = min(gives.get(folder, (0.0, "~")), (-score, name))
    want = {}
    for i, path, _ in rows:
        above = path.rpartition("/")[0]
        while i not in own and above not in gives and above:
            above = above.rpartition("/")[0]
        if i in own:
            want[i] = (own[i][0], round(own[i][1], 9), "own", None)
        elif above in gives:
            want[i] = (gives[above][1], round(-gives[above][0], 9), "inherited", above)
        else:
            want[i] = (None, 0.0, "none", None)
    assert got == want and {w[2] for w in want.values()} == {"own", "inherited"}


def test_kept_names_that_clash(spark):
    files = spark.createDataFrame([("a", "b", "c")], "path string, text string, score string")
    with pytest.raises(ValueError):
        licenses.scan(files, keep=["score"])


def _own_matcher():
    df = Counter()
    for _, body in licenses.TEMPLATES:
        df.update([*licenses.terms(body), ""])
    n = df.pop("")
    return licenses.Matcher(tuple(licenses.TEMPLATES), df, n)


@pytest.mark.parametrize("name", ["Apache-2.0", "CC0-1.0", "GFDL-1.3", "GPL-1", "GPL-2", "GPL-3", "LGPL-2", "LGPL-2.1", "LGPL-3", "MPL-2.0", "BSD"])
def test_whole_licenses_are_told_right(name):
    """License files as a system brings them, where it does."""
    path = Path("/usr/share/common-licenses") / name
    if not path.exists():
        pytest.skip("no such file here")
    want = {"BSD": "BSD-3-Clause", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-3": "LGPL-3.0"}.get(name, name)
    assert _own_matcher().of_text(path.read_text(errors="replace"), licenses.LEAST)[1] == want


def test_a_whole_text_outweighs_two_words():
    m = _own_matcher()
    two = "Copyright (c) 2020, A. Author\nAll rights reserved.\n\n" + [t for n, t in licenses.TEMPLATES if n == "BSD-2-Clause"][-1]
    three = "Copyright 2021 B\nAll rights reserved.\n\n" + [t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause"][-1]
    assert m.of_text(two, licenses.LEAST)[1] == "BSD-2-Clause" and m.of_text(three, licenses.LEAST)[1] == "BSD-3-Clause"
    assert m.of_text("x\nAll rights reserved.\ny", licenses.LEAST)[1] == "Proprietary"


def test_license_files_by_name_give_to_their_folders(spark):
    gpl = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0" and t.startswith("GNU"))
    rows = [("a/COPYING", gpl + "\n" + "Preamble and much more text of it. " * 50), ("a/b/x.c", "int x;"), ("c/y.c", "int y;"), ("c/UNLICENSE", next(t for n, t in licenses.TEMPLATES if n == "Unlicense"))]
    got = {r.path: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a/COPYING": ("GPL-3.0", "own"), "a/b/x.c": ("GPL-3.0", "inherited"), "c/y.c": ("Unlicense", "inherited"), "c/UNLICENSE": ("Unlicense", "own")}
