"""The lookup on rewritten licences and against its SQL."""

import pathlib

import duckdb
import pytest

from folioforge.llm.license_scan import digests_of, scan_licenses
from folioforge.llm.license_texts import KNOWN
from folioforge.llm.queries_license import OP8_SQL

MIT = KNOWN["MIT"]
TEXTS = [
    None,
    "",
    " \n!!",
    MIT,
    MIT.upper(),
    MIT.replace("<year> <copyright holders>", "2011-2020 Some Body, Inc. All rights reserved."),
    MIT.replace("\n\n", "\n").replace(" software", "\n  software"),
    "# " + MIT.replace("\n", "\n# "),
    MIT.replace("sublicense", "sub-licence").replace("License", "Licence"),
    MIT + " And one more term.",
    KNOWN["BSD-3-Clause"].replace("Copyright (c)", "Copyright ©"),
    KNOWN["Unlicense"].replace("recognize", "recognise").replace("https", "http").replace('"AS IS"', "“as is”"),
    "Released under the MIT License",
    "x" * 200_000,
    "Été à l'hôtel; copyright law applies to four colours.",
]
WANT = [None, None, None, "MIT", "MIT", "MIT", "MIT", "MIT", "MIT", None, "BSD-3-Clause", "Unlicense", "MIT-line", None, None]


def test_lookup_and_sql(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, MIT, "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license_id string")
    got = sorted(map(tuple, scan_licenses(docs).collect()))
    assert [r[3] for r in got if r[0] != 3] == [w for i, w in enumerate(WANT) if i != 3]
    assert [r[3] for r in got if r[0] == 3] == ["MIT", "MIT"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert got == sorted(con.execute(OP8_SQL).fetchall())
    assert scan_licenses(docs.limit(0)).count() == 0


def test_known_texts_differ(spark):
    docs = spark.createDataFrame(list(enumerate(KNOWN.values())), "doc_id long, text string")
    assert [r.license_id for r in scan_licenses(docs).orderBy("doc_id").collect()] == list(KNOWN)


def test_long_licenses(spark):
    """Whole published texts in a table of documents, as they are and rewritten, where the machine has them."""
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}
    folder = pathlib.Path("/usr/share/common-licenses")
    found = {name: (folder / file).read_text() for name, file in files.items() if (folder / file).exists()}
    if not found:
        pytest.skip("no licence texts on this machine")
    rows = [(name, form(text)) for name, text in found.items() for form in (str, str.upper, lambda t: "\n".join(" * " + line for line in t.splitlines()))]
    rows += [(None, text + " and one more condition") for text in found.values()]
    got = scan_licenses(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string"))
    assert [r.license_id for r in got.orderBy("doc_id").collect()] == [name for name, _ in rows]


def test_known_table_of_the_caller(spark):
    known = digests_of(spark.createDataFrame([("b", "Do as you like."), ("a", "do as  YOU like"), ("c", "Ask first.")], "license_id string, text string"))
    docs = spark.createDataFrame([(1, "DO AS YOU LIKE!"), (2, "ask first"), (3, MIT)], "doc_id long, text string")
    assert [r.license_id for r in scan_licenses(docs, known=known).orderBy("doc_id").collect()] == ["a", "c", None]
