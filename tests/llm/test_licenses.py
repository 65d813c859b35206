import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import licenses
from tests.llm.fixtures import CLASH, documents, frame, rows_of

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"
FILES = [
    ("a/LICENSE", "Licensed under the Apache License, Version 2.0"), ("a/x.py", "code\n# Licensed under CC BY-NC 4.0.\nmore"), ("a/b/y.py", "nothing"), ("a/b/c/z.py", None),
    ("a/b/d/COPYING.txt", MIT), ("a/b/d/e/f.c", "text"), ("a/b/d/w.c", "the license of this is our own and not to be had by anyone who asks for it"), ("top.c", "x"), ("g/h.c", ""),
    ("g/LICENSE", "not one"), ("g/LICENSE.md", "Released under the MIT License"), ("g/LICENSE-2", "Released under the MIT License"), (None, "Released under the MIT License"), ("ab/q.c", "y"), ("a/b/y.py", "nothing"),
    ("n/long.txt", "word " * 50_000 + "\nThis work is licensed under the GNU General Public License, version 3.\n" + "tail " * 50_000),
]


def table(spark, rows=FILES):
    return spark.createDataFrame(rows, "path string, text string").repartition(2).withColumns({c: F.lit(c) for c in [*CLASH, "unit", "term", "dir", "license"]})


def plain_terms(text):
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


def plain_units(text):
    """Runs of lines with an anchor, and for a text with an anchor all of it and its opening."""
    split = (text or "").split("\n")
    at = [i for i, x in enumerate(split) if re.search(licenses.ANCHORS, x)]
    if not at:
        return []
    runs = {(a, b) for i in at for a in range(max(0, i - licenses.WINDOW + 1), i + 1) for b in range(i, min(len(split), a + licenses.WINDOW))}
    return [" ".join(split[a : b + 1]) for a, b in runs] + [text, " ".join(text.split()[: licenses.OPENING])]


def plain_own(rows):
    rows = [(p, t) for p, t in rows if p is not None]
    df = Counter(t for _, text in rows for t in set(plain_terms(text or "")))
    idf = lambda t: math.log((1 + len(rows)) / (1 + df.get(t, 0))) + 1
    made = [(name, Counter(plain_terms(text))) for name, text in licenses.templates()]
    out = {}
    for path, text in rows:
        best = []
        for u in plain_units(text):
            w = {t: n * idf(t) for t, n in Counter(plain_terms(u)).items()}
            for name, counts in made:
                tw = {t: n * idf(t) for t, n in counts.items()}
                cos = sum(w.get(t, 0) * x for t, x in tw.items()) / math.sqrt(sum(x * x for x in w.values()) or 1) / math.sqrt(sum(x * x for x in tw.values()))
                if round(cos, 6) >= licenses.THRESHOLD:
                    best.append((-round(cos, 6), name))
        if best:
            out[path] = min(min(best), out.get(path, (1, "")))
    return {p: (name, -s) for p, (s, name) in out.items()}


@pytest.mark.parametrize("few", [licenses.TERMS, 60, 0])
def test_brute_force(spark, monkeypatch, few):
    """The same scores whether all terms' weights are broadcast, some, or those of templates alone."""
    monkeypatch.setattr(licenses, "TERMS", few)
    rows = FILES + [(f"d/{r[0]}", r[1]) for r in documents(40)]
    got = {r[0]: (r[1], r[2]) for r in rows_of(licenses.own_licenses(table(spark, rows).filter("path is not null").select("path", "text")))}
    want = plain_own(rows)
    assert {p: n for p, (n, _) in got.items()} == {p: n for p, (n, _) in want.items()}
    assert all(abs(got[p][1] - want[p][1]) < 2e-6 for p in want)


def test_inheritance(spark):
    got = {}
    for path, name, _, above in rows_of(licenses.scan(table(spark)).select("path", "license", "score", "inherited_from")):
        got.setdefault(path, []).append((name, above))
    assert got["a/x.py"] == [("CC-BY-NC-4.0", None)] and got["a/LICENSE"] == [("Apache-2.0", None)]
    assert got["a/b/y.py"] == [("Apache-2.0", "a")] * 2 and got["a/b/c/z.py"] == [("Apache-2.0", "a")]
    assert got["a/b/d/e/f.c"] == [("MIT", "a/b/d")] and got["a/b/d/w.c"] == [("MIT", "a/b/d")]
    assert got["top.c"] == got["ab/q.c"] == got[None] == [(None, None)]
    assert got["g/h.c"] == got["g/LICENSE"] == [("MIT", "g")] and got["n/long.txt"] == [("GPL-3.0", None)]


def test_empty_and_root(spark):
    assert rows_of(licenses.scan(table(spark).limit(0))) == []
    got = dict(rows_of(licenses.scan(table(spark, [("LICENSE", "Released under the MIT License"), ("x/y/z", "a"), ("w", "b")])).select("path", "inherited_from")))
    assert got == {"LICENSE": None, "x/y/z": "", "w": ""}


def test_every_template_has_an_anchor():
    assert all(re.search(licenses.ANCHORS, text) for _, text in licenses.TEMPLATES)


def test_whole_texts(spark):
    """Each license's text, under the name of a license file or any other, and the opening lines of the long ones."""
    rows, want = [(f"plain/{i}.txt", "nothing of that kind here") for i in range(40)], {}
    for file in sorted(licenses.TEXTS.glob("*.txt")):
        text = file.read_text()
        for path, body in ((f"{file.stem}/LICENSE", text), (f"other/{file.stem}.c", text), (f"short/{file.stem}/COPYING", "\n".join(text.split("\n")[:12]) if len(text) > 5000 else text)):
            rows.append((path, body))
            want[path] = file.stem
    got = {r[0]: (r[1], r[3]) for r in rows_of(licenses.own_licenses(table(spark, rows).select("path", "text")))}
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "ISC"} <= set(want.values())
    assert {p: got.get(p, (None,))[0] for p in want} == want
    assert all(got[p][1] is not None for p in want if not p.startswith("short/")) and not any(p.startswith("plain") for p in got)


def test_documents(spark):
    rows = [(1, "Released under the MIT License.", "en", "s", 1), (2, "some text", "en", "s", 1), (3, "more", None, None, 1), (4, None, "en", "s", None), (5, "x", "?", "?", 1), (6, "Released under the MIT License", None, None, 1)]
    got = {r[0]: r[2:] for r in rows_of(licenses.scan_documents(frame(spark, rows, clash=True)))}
    assert got == {1: ("MIT", 1.0, None), 2: ("MIT", None, "s/en"), 3: ("MIT", None, "?/?"), 4: ("MIT", None, "s/en"), 5: (None, None, None), 6: ("MIT", 1.0, None)}
