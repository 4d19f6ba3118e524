from __future__ import annotations

import re

from girder.llm import license_scan, queries

from .conftest import SF

LINES = {
    "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0",
    "This work is licensed under the GNU General Public License, version 3": "GPL-3.0",
    "Licensed under the Apache License, Version 2.0": "Apache-2.0",
    "Released under the MIT License": "MIT",
}


def test_every_template_finds_itself():
    s = license_scan.Scanner(license_scan.default_templates())
    for licence, text in license_scan.default_templates():
        found = s.scan("Some words before it.\n" + text + "\nAnd words after it.")
        assert any(f[0] == licence and f[3] == 0 for f in found), (licence, found)


def test_lines_in_documents(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op9_license_scan(spark, SF).collect()
    want = {(i, LINES[m[0]], m.start(), m.end()) for i, t in docs.items() for m in re.finditer("|".join(map(re.escape, LINES)), t)}
    got = {(r.doc_id, r.license, r.start, r.end) for r in rows}
    assert want and want == got


def test_wording_decides():
    s = license_scan.Scanner(license_scan.default_templates())
    changed = license_scan._MIT.replace("furnished", "given")
    ((licence, a, b, n, _, said),) = s.scan(f"intro. {changed} outro")
    assert (licence, n, said) == ("MIT", 1, "furnished > given") and changed[:10] == f"intro. {changed} outro"[a : a + 10] and b - a > 900
    assert s.scan("Licensed under CC BY-NC 9.0.") == []
    assert s.scan("This licence is a permission to redistribute nothing.") == []
    assert [f[0] for f in s.scan(license_scan._BSD3)] == ["BSD-3-Clause"]


def test_awkward_rows_and_empty_table(spark, awkward, nothing):
    assert license_scan.find_licenses(awkward).count() == 0
    assert license_scan.find_licenses(nothing).count() == 0
    rows = spark.createDataFrame([(None, "Released under the MIT License"), (1, "license " * 2000), (2, "Released under the MIT License " * 3)], "doc_id long, text string")
    assert sorted((repr(r.doc_id), r.license) for r in license_scan.find_licenses(rows).collect()) == [("2", "MIT")] * 3 + [("None", "MIT")]
