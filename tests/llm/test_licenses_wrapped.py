import textwrap

from millrace.llm import licenses
from tests.llm.fixtures import rows_of

MPL = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"


def test_wrapped_headers(spark):
    rows, want = [], {}
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        for width in (30, 50, 72):
            path = f"s/{i}_{width}.py"
            rows.append((path, "import a\n" + "\n".join("# " + x for x in textwrap.wrap(text, width)) + "\n\ndef f(x):\n    return x\n"))
            want[path] = (name, 1.0)
    rows += [("s/mpl.c", MPL + "\nint main() {}\n"), ("s/cc.md", "some page\nCC BY 4.0\nand its text")]
    got = {r[0]: (r[1], r[2]) for r in rows_of(licenses.own_licenses(spark.createDataFrame(rows, "path string, text string")))}
    assert {p: got.get(p) for p in want} == want
    assert got["s/mpl.c"][0] == "MPL-2.0" and got["s/cc.md"][0] == "CC-BY-4.0"
