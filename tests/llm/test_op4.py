import re

import pytest
from helpers import empty, odd, small

from tidelog.llm import op4_licenses as op4
from tidelog.llm.licences import SENTENCES, normal, sentence_table


def names(text):
    return op4.recognise([s[2] for s in op4.sentences(text.encode())])


@pytest.mark.parametrize(
    "text,want",
    [
        ("Prose here.\nReleased under the MIT License.", ["MIT"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("x.\nLicensed under CC BY-NC 4.0.\nMore", ["CC-BY-NC-4.0"]),
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("Title without a stop\nLicensed under\nthe Apache License,   Version 2.0.", ["Apache-2.0"]),
        ("# SPDX-License-Identifier: Apache-2.0\ncode()", ["Apache-2.0"]),
        ("A page that is not released under the MIT License.", []),
        ("The mitigation was released under pressure.", []),
        (" ".join(SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")), ["BSD-3-Clause"]),
        ("\n * ".join(["/*", "Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions are met:", "", "1. " + SENTENCES["bsd-source"], "2. " + SENTENCES["bsd-binary"]]), ["BSD-2-Clause"]),
        ("\n\n".join(SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-warranty")) + "\nReleased under the ISC license", ["MIT", "ISC"]),
        (SENTENCES["gpl3-grant"] + "\n" + SENTENCES["gpl-warranty"], ["GPL-3.0"]),
        ("Copyright 2020. All rights reserved.", ["LicenseRef-Proprietary"]),
    ],
)
def test_recognition(text, want):
    assert names(text) == want


def test_against_line_lookup(spark):
    """In the tables licences stand on lines of their own."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = sentence_table()
    found = 0
    for r in op4.scan_licenses(df).collect():
        want = {*op4.recognise([table[normal(x).encode()] for x in re.split(r"\n", r["text"] or "") if normal(x).encode() in table])}
        assert set(r["licenses"]) == want and r["licenses"] == sorted(r["licenses"])
        found += len(want)
    assert found > 10


def test_odd(spark):
    rows = op4.scan_licenses(odd(spark)).collect()
    assert len(rows) == odd(spark).count() and all(r["licenses"] == [] and r["category"] == "none" for r in rows)
    assert op4.scan_licenses(empty(spark)).count() == 0 and "extra" in op4.scan_licenses(odd(spark)).columns
    assert op4.scan_licenses(small(spark)).where("n_unknown > 0").count() == 0


def scanned(text):
    spans = op4.sentences(text.encode())
    return op4.recognise([s[2] for s in spans], op4.joins(text.encode(), spans))


BSD = [SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary")]
OWNER = SENTENCES["bsd-endorse"].replace("the copyright holder", "Example Labs")


@pytest.mark.parametrize(
    "text,want",
    [
        ("\n".join([*BSD, OWNER]), ["BSD-3-Clause"]),
        ("Copyright 2020 Example Labs.\nAll rights reserved.\n\n" + "\n".join([*BSD, OWNER]), ["BSD-3-Clause"]),
        (SENTENCES["apache-grant"] + "\nAll rights reserved.", ["Apache-2.0"]),
        ("All rights reserved.\nSome other prose.\nReleased under the MIT License.", ["LicenseRef-Proprietary", "MIT"]),
        ("All rights reserved.\n" + SENTENCES["mit-notice"], ["LicenseRef-Proprietary"]),
        (SENTENCES["bsd-source"].join(["", ""]) + "\n" + SENTENCES["zlib-grant"], ["Zlib"]),
        (SENTENCES["bsl-grant"], ["BSL-1.0"]),
        (SENTENCES["epl2-notice"], ["EPL-2.0"]),
        (SENTENCES["epl1-notice"], ["EPL-1.0"]),
        ("Licensed under the Artistic License 2.0.", ["Artistic-2.0"]),
        (SENTENCES["isc-grant"].replace(" ", " " * 3000), ["ISC"]),
    ],
)
def test_real_texts(text, want):
    assert scanned(text) == want


def paragraphs(*keys, head=""):
    """A licence file: a heading, a copyright line, and paragraphs of lines of about 60 characters."""
    import textwrap

    body = "\n\n".join("\n".join(textwrap.wrap(" ".join(SENTENCES[k] for k in keys_), 60)) for keys_ in keys)
    return f"{head}\n\nCopyright (c) 2020 A. Author\n\n{body}\n"


#: Files and file headers in their usual form, each with exactly its licence and category.
FILES = [
    (paragraphs(["mit-grant"], ["mit-notice"], ["mit-warranty", "mit-liability"], head="MIT License"), "MIT", "permissive"),
    (paragraphs(["isc-grant"], ["isc-warranty"], head="ISC License"), "ISC", "permissive"),
    (paragraphs(["bsd-grant"], ["bsd-source"], ["bsd-binary"], ["bsd-disclaimer", "bsd-liability"], head="BSD 2-Clause License"), "BSD-2-Clause", "permissive"),
    (paragraphs(["bsd-grant"], ["bsd-source"], ["bsd-binary"], ["bsd-endorse"], ["bsd-disclaimer", "bsd-liability"]).replace("A. Author", "A. Author\nAll rights reserved."), "BSD-3-Clause", "permissive"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n" + SENTENCES["apache-terms"], "Apache-2.0", "permissive"),
    (paragraphs(["apache-grant"], ["apache-copy"]) + "\n    http://www.apache.org/licenses/LICENSE-2.0\n", "Apache-2.0", "permissive"),
    (paragraphs(["gpl3-grant"], ["gpl-warranty"], head="prog - does things"), "GPL-3.0", "copyleft"),
    (paragraphs(["gpl2-grant"], ["gpl-warranty"]), "GPL-2.0", "copyleft"),
    (paragraphs(["lgpl21-grant"], ["lgpl-warranty"]), "LGPL-2.1", "copyleft"),
    (paragraphs(["lgpl3-grant"], ["lgpl-warranty"]), "LGPL-3.0", "copyleft"),
    (paragraphs(["agpl3-grant"], ["gpl-warranty"]), "AGPL-3.0", "copyleft"),
    (paragraphs(["mpl-notice"]), "MPL-2.0", "copyleft"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.", "GPL-3.0", "copyleft"),
    ("                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\nPreamble", "LGPL-2.1", "copyleft"),
    ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions", "MPL-2.0", "copyleft"),
]


def test_files(spark):
    rows = [(i, text) for i, (text, _, _) in enumerate(FILES)]
    got = {r["i"]: (r["licenses"], r["category"]) for r in op4.scan_licenses(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert [got[i] for i in range(len(FILES))] == [([x], c) for _, x, c in FILES]


def brute(text):
    """Every stretch from a sentence's or line's start to one's end, looked up as it stands:
    at each place the longest, from left to right; then the rules, one place after the other."""
    table = sentence_table()
    clean = re.sub(r"(?<=[0-9vV])\.(?=[0-9 ])(?! *[A-Z])", " ", text.replace("\x01", " "))
    clean = re.sub(r"(?<![Ii]dentifier):(?=\s)", ".", clean)
    clean = re.sub(r"\n[ \r\t]*\n", lambda m: ";" * len(m[0]), clean)
    bounds = [0, *(m.end() for m in re.finditer(r"[.!?;\n]", clean)), len(clean)]
    names, done = [], 0
    for k, lo in enumerate(bounds):
        if lo < done:
            continue
        for hi in reversed(bounds[k + 1 : k + 40]):
            name = table.get(normal(clean[lo:hi]).encode())
            if name and normal(clean[lo:hi]) and normal(re.split(r"[.!?;\n]", clean[lo:hi])[0] or "x"):
                names.append(name)
                done = hi
                break
    return names


def test_sentences_against_every_stretch(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r["text"] for r in df.where("length(text) < 1500").select("text").collect()] + [t for t, _, _ in FILES]
    n = 0
    for t in texts:
        got = [s[2] for s in op4.sentences(t.encode())]
        assert got == brute(t), t
        n += len(got)
    assert n > 40
