import hashlib
import textwrap

from lodestone.llm import licenses

MIT = licenses.LICENSES[0][1]


def test_scan(spark):
    other = "   Copyright (c) 2020 A. Author\n\n* (C) 2021 B\n" + MIT.lower().replace("sublicense", "sub-license").replace(" copyright holders", "  copyright   HOLDERS").replace("\n", " \n\t")
    rows = [(1, MIT), (2, other), (3, MIT + " or not"), (4, None), (5, ""), (None, "released under the MIT LICENCE"), (1, MIT), (7, "Copyright 1999 nobody"), (8, "x " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' license", "'y' digest", "1 id")
    got = licenses.scan(docs).collect()
    assert sorted((str(r.doc_id), r.license) for r in got if r.license) == [("1", "MIT"), ("1", "MIT"), ("2", "MIT"), ("None", "MIT")]
    assert len(got) == len(rows)
    assert {r.canonical_sha256 for r in got if r.doc_id in (4, 5, 7)} == {hashlib.sha256(b"").hexdigest()}
    own = spark.createDataFrame([("B", "my own terms"), ("A", "My own, terms!"), ("C", "--"), (None, None)], "license string, text string")
    assert [r.license for r in licenses.scan(spark.createDataFrame([(1, "MY OWN TERMS")], "doc_id long, text string"), own).collect()] == ["A"]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_all_known_are_found(spark):
    known = licenses.built_in()
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense", "Zlib", "MIT", "ISC", "BSD-3-Clause"} <= {n for n, _ in known}
    other = lambda t: "\n".join(textwrap.fill(p, 61) for p in t.upper().replace("LICENSE", "Licence").replace('"', "“").split("\n\n"))
    rows = [(n, t) for n, t in known] + [(n, f"Copyright (C) 2031 Some Body <a@b.c>\n\n{other(t)}") for n, t in known if "opyright" not in t or n in ("Apache-2.0", "MPL-2.0")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [got[i].license for i in range(len(rows))] == [n for n, _ in rows] and len(rows) > len(known) + 8
    assert [got[i].canonical_sha256 for i in range(len(rows))] == [hashlib.sha256(licenses.plain_form(t).encode()).hexdigest() for _, t in rows]


def test_wrapped_texts_are_found(spark):
    rows = []
    for name, t in licenses.LICENSES:
        for width in (30, *range(56, 81)):
            rows.append((name, "Copyright (c) 2020 A. Author\n\n" + "\n\n".join(textwrap.fill(p, width) for p in t.split("\n\n"))))
    assert any("\ncopyright notice" in t for n, t in rows if n == "ISC")
    for line in ("Copyright Acme Inc.", "# Copyright: Jane Doe", "© Jane Doe", "(c) 2021 B", "Copyrighted by C", "COPYRIGHT 1999 D", "All rights reserved."):
        rows.append(("MIT", f"{line}\n{MIT}"))
    rows += [(None, f"{line}\n{MIT}") for line in ("copyright law applies", "(c) you must keep this", "Copyright Holder means you")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [n for n, _ in rows]


def test_canonical_forms_as_written_down(spark):
    cases = {
        "Licence licence LICENCE": "license license license",
        "the copyright owner, copyright owner": "the copyright holder copyright holder",
        "Sub-Licence sub license": "sublicense sublicense",
        "Non-commercial; per   cent\nCopyright (c) 2020 X\nwhilst": "noncommercial percent while",
        "Copyright Holder means you\nCopyright Acme Inc.": "copyright holder means you",
        "(c) you must keep this\n(c) 2020 no": "c you must keep this",
        "copyright notice, this list\nof conditions": "copyright notice this list of conditions",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.form for r in docs.select("doc_id", licenses.canonical(docs.text).alias("form")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) == [licenses.plain_form(t) for t in cases]


def test_same_as_sql(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = [(-1 - i, t) for i, (_, t) in enumerate(licenses.built_in())] + [(-100, "(C) Copyright you\nCopyrighted BY me\nCopyright Notice\n© x"), (-101, None), (-102, "licence licence")]
    both = docs.union(spark.createDataFrame(odd, "doc_id long, text string"))
    frame = both.toPandas()
    c.register("documents", frame)
    assert sorted(map(tuple, licenses.scan(both).collect())) == sorted(c.sql(licenses.sql()).fetchall())
