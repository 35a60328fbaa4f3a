"""Whole texts and lines looked up by canonical digest."""

import re
from pathlib import Path

from mnemosia.llm import licences as L

MIT = next(t for n, t in L.KNOWN if n == "MIT")


def test_equivalent_texts(spark):
    texts = {
        1: MIT,
        2: MIT.upper().replace("SOFTWARE", "Software").replace("\n", "\n\n").replace(",", " ,"),
        3: MIT.replace("<year> <holder>", "2020 Some One"),
        4: MIT.replace("License", "Licence"),
        5: MIT.replace("sublicense", "sub-licence"),
        6: MIT + " And one more clause.",
        7: None,
        8: "",
        9: "prose without any of it",
        10: MIT,
        11: "licence " * 20000,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.license for r in L.scan_licenses(docs).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT", 4: "MIT", 5: "MIT", 6: None, 7: None, 8: None, 9: None, 10: "MIT", 11: None}


def test_the_gate_loses_no_known_text():
    assert all(re.search(L.GATE, t) for _, t in L.KNOWN)


def test_whole_licences_notices_and_statements(spark):
    folder = Path(L.__file__).parent / "licence_texts"
    whole = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "MPL-2.0": "MPL-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2": "LGPL-2.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only"}
    rows = [(license, (folder / f"{name}.txt").read_text()) for name, license in whole.items()]
    gpl = rows[4][1]
    rows += [("GPL-3.0-only", gpl[: gpl.index("END OF TERMS")]), ("GPL-3.0-only", "\n\n".join(" ".join(p.split()) for p in gpl.split("\n\n"))), (None, gpl[:-2000]), (None, "Licensed under the BSD License.")]
    rows += [("GPL-3.0-or-later", gpl[gpl.index("    This program is free software: you") : gpl.index("Also add information")]), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."), ("GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-or-later")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id: r.license for r in L.scan_licenses(docs).collect()} == {i: license for i, (license, _) in enumerate(rows)}
    assert all(len({n for n, y in L.KNOWN if y == t}) == 1 for _, t in L.KNOWN)


def test_lines(spark):
    docs = spark.createDataFrame([(1, "prose\nLicensed under CC BY 4.0.\nmore\nlicensed under CC-BY 4.0"), (2, "Licensed under CC BY 4.0. Really."), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in L.license_lines(docs).collect()] == [(1, "CC-BY-4.0", 2)]


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([(None, MIT, "x", 1), (None, MIT, "x", 1)], "doc_id long, text string, license string, digest int")
    assert [r.license for r in L.scan_licenses(docs).collect()] == ["MIT", "MIT"]
    assert L.scan_licenses(docs.where("false")).collect() == []
    assert L.registry(spark, [("X", "!?"), ("B", "A licence"), ("A", "a license.")]).count() == 1


def test_the_gate_follows_the_registry(spark):
    docs = spark.createDataFrame([(1, "Do what you want."), (2, "do WHAT you\nwant"), (3, "Do what you like."), (4, "12 %"), (5, "Sub-licence per cent"), (6, "sublicense PERCENT")], "doc_id long, text string")
    known = [("X", "Copyright 2020 Somebody\nDo what you want."), ("Y", "12 %"), ("Z", "sublicense percent")]
    assert {r.doc_id: r.license for r in L.scan_licenses(docs, known).collect()} == {1: "X", 2: "X", 3: None, 4: "Y", 5: "Z", 6: "Z"}
    assert re.search(L.gate(known[:1]), "do what you want.") and not re.search(L.gate(known[:1]), "prose")


def test_a_wrapped_line_that_begins_with_copyright_stays(spark):
    import textwrap

    bsd = next(t for n, t in L.KNOWN if n == "BSD-3-Clause")
    rows = [(w, "\n".join("\n".join(textwrap.wrap(line, w)) for line in bsd.replace("<year>, <holder>", "2001-2020, Some One").split("\n"))) for w in (40, 50, 60, 66, 72, 80)]
    rows += [(1, bsd.replace("Copyright (c) <year>, <holder>", "(C) 2020 X")), (2, bsd.replace("Copyright (c) <year>, <holder>", "Copyright The Some Authors\nAll rights reserved.")), (3, bsd.replace("copyright notice", "notice"))]
    got = {r.doc_id: r.license for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: None if k == 3 else "BSD-3-Clause" for k, _ in rows}
