import re
import textwrap
from importlib import resources

import duckdb
import pytest
from coratings.llm.licenses import license_scan, license_sql


def test_whole_texts_and_lines(spark):
    mit = "Permission is hereby granted to any person.\nCopyright (c) 2020 Somebody\nThe software is licenced as is!"
    known = spark.createDataFrame([("Mine", mit), ("Zed", "Permission is hereby granted, to any person; the SOFTWARE is licensed as is"), ("Line", "use it freely"), ("Empty", "!!")], "license string, text string")
    rows = [
        (1, "  PERMISSION is hereby granted -- to any person.\n(C) 1999 Another One\nThe software is licensed as is"),
        (2, "words before\nUse it, freely.\nUse it freely"), (3, "please use it freely today"), (4, None), (5, ""), (6, "© 2001 me"), (1, "Use it freely"),
        (None, "licence licence"),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, licenses string")
    got = [(r.doc_id, r.whole_license, r.licenses, r.n_license_lines) for r in license_scan(docs, known).collect()]
    want = [(1, "Mine", "Mine", 0), (2, None, "Line", 2), (3, None, "", 0), (4, None, "", 0), (5, None, "", 0), (6, None, "", 0), (1, "Line", "Line", 1), (None, None, "", 0)]
    assert sorted(got, key=str) == sorted(want, key=str)
    digests = {r.doc_id: r.text_digest for r in license_scan(docs, known).collect()}
    assert digests[4] is None and digests[5] is None and digests[6] is None and digests[3]


def test_no_documents(no_docs):
    assert license_scan(no_docs).collect() == []


@pytest.fixture(scope="module")
def filed():
    return {f.name.removesuffix(".txt"): f.read_text() for f in resources.files("coratings.llm").joinpath("license_texts").iterdir()}


def test_whole_licenses(spark, filed):
    """Every text with another copyright line, respelled, in other case and wrapped otherwise."""
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0"} <= filed.keys()
    respelled = lambda t: re.sub(r"\b([Ll])icens(es?|ed)\b", r"\1icenc\2", t).replace("authorized", "authorised").replace(" organization ", " organisation ")
    rows = [(name, f"Copyright (c) 1999 Another One\n\n{respelled(text)}") for name, text in filed.items()]
    rows += [(name, f"(C) 2001 Me and others\n{text.upper()}") for name, text in filed.items()]
    rows += [(name, text.replace("\n\n", "\r").replace("\n", " ").replace("\r", "\n")) for name, text in filed.items() if name in ("MIT", "ISC", "BSD-3-Clause")]
    rows += [("MIT", f"The MIT License (MIT)\n\nCopyright © 2020 X\n\n{filed['MIT']}")]
    rows += [("BSD-3-Clause", f"Copyright 2020, X\nAll rights reserved.\n\n{filed['BSD-3-Clause'].replace('1. ', '* ').replace('2. ', '* ').replace('3. ', '* ')}")]
    rows += [("Apache-2.0", filed["Apache-2.0"].split("   APPENDIX")[0])]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: (r.whole_license, r.licenses) for r in license_scan(docs).collect()}
    assert {i: w for i, (w, _) in got.items()} == {i: name for i, (name, _) in enumerate(rows)}
    assert all(name in got[i][1].split(",") for i, (name, _) in enumerate(rows))


def test_any_width_of_lines(spark, filed):
    """Every text at eleven widths and on one line, as filed and below a copyright statement of its own."""
    def wrapped(text, width):
        return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in re.split(r"\n\s*\n", text.strip()))

    rows = [(name, wrapped(text, width)) for name, text in filed.items() for width in range(50, 101, 5)]
    rows += [(name, f"Copyright (c) 1999, 2001 Another One\nCopyright The Other Authors\nAll rights reserved.\n\n{text}") for name, text in rows]
    rows += [(name, " ".join(text.split())) for name, text in filed.items()]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.whole_license for r in license_scan(docs).collect()}
    assert got == {i: name for i, (name, _) in enumerate(rows)}


def test_words_of_other_lines_stay(spark):
    """A line that only begins with the word, or with a clause's letter, is no statement."""
    known = spark.createDataFrame([("Mine", "(c) You must keep this.\ncopyright notices go here")], "license string, text string")
    rows = [(1, "(c) You must keep this. copyright notices\ngo here"), (2, "go here"), (3, "You must keep this.\ngo here")]
    got = {r.doc_id: r.whole_license for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert got == {1: "Mine", 2: None, 3: None}


def test_sql_knows_whole_licenses(spark, filed, tmp_path):
    rows = [(1, filed["MIT"]), (2, f"Copyright (c) 2001 X\n\n{filed['GPL-2.0']}"), (3, None), (4, filed["Apache-2.0"].replace("\n", " ")), (5, "a\n\nMIT"), (6, "SPDX-License-Identifier: MIT"), (7, " \n\n©")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/docs/*.parquet'")
    columns = ["doc_id", "text_digest", "whole_license", "licenses", "n_license_lines"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({license_sql()})").fetchall()
    got = [tuple(r) for r in license_scan(docs).select(*columns).collect()]
    assert sorted(got) == sorted(want) and [r[2] for r in sorted(got)] == ["MIT", "GPL-2.0", None, "Apache-2.0", None, "MIT", None]


def test_part_of_a_license(spark, filed):
    docs = spark.createDataFrame([(1, filed["MIT"].split("\n\n")[0]), (2, f"{filed['MIT']}\nand more")], "doc_id long, text string")
    assert all(r.whole_license is None for r in license_scan(docs).collect())
