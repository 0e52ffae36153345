"""Problem 3: texts are judged whole."""

import pytest

from sparklode.llm.handwritten import measure

LICENCE = [f"Permission is granted under rule {k} to whoever holds a copy of these terms." for k in range(90)]
HASHED, STARRED = "\n".join(f"# {x}" for x in LICENCE), "/*\n" + "\n".join(f" * {x}" for x in LICENCE) + "\n */"


def test_compile_marks_behind_a_long_banner():
    assert len(STARRED) > 4000
    assert measure(f"{STARRED}\nvar a = __webpack_require__(7);\n")["compiled"] and not measure(f"{STARRED}\nvar a = 7;\n")["compiled"]


@pytest.mark.parametrize("text, flags", [
    (f"{HASHED}\n# Code generated by protoweave. DO NOT EDIT.\nx = 1\n", {"generated"}),
    (f"{STARRED}\n// This module has been maintained by hand since May.\nexport const a = 1;\n", {"by_hand"}),
    ("/*\n" + "\n".join(LICENCE) + "\nGenerated by protoweave.\n*/\nint a;\n", {"generated"}),
    ("// Code generated by protoweave from " + "a.proto, " * 60 + "DO NOT EDIT.\npackage x\n", {"generated"}),
    ("/**/ // Code generated by protoweave.\nint a;\n", {"generated"}),
    ("/* plain */ int a;\n// Code generated by protoweave.\n", set()),
    (f"{HASHED}\nx = 1\n# Code generated by protoweave. DO NOT EDIT.\n", set()),
    ("/*! a */" + "f(1);" * 200 + "\n// @generated\n", set()),
])
def test_the_leading_comments_are_read_to_the_first_line_of_code(text, flags):
    s = measure(text)
    assert {f for f in ("by_hand", "generated", "vendored") if s[f]} == flags


@pytest.mark.parametrize("path, text, why, by", [
    ("r/blob.c", "static const unsigned char blob[] = {\n" + "  0x12, 0x7f, 0x33, 0x00, 0x91, 0xaa,\n" * 40 + "};\n", "data", "layout"),
    ("r/dump.sql", "".join(f"INSERT INTO users (id, name) VALUES ({k}, 'n{k}');\n" for k in range(60)), "data", "layout"),
    ("r/query.sql", "SELECT a, b\nFROM t\nWHERE a > 5\n" * 30, None, None),
    ("r/page.rs", "fn main() {\n    let x = 5;\n}\n" * 20, None, None),
    ("r/x.snap.js", "".join(f"exports[`a {k}`] = `\nObject {{\n  \"b\": {k},\n  \"c\": {k * 7},\n  \"d\": 19,\n  \"e\": \"on\",\n}}\n`;\n" for k in range(30)), "snapshot", "layout"),
    ("r/y.json", "".join(f'  "p{k}": {{ "integrity": "sha512-{"aB3dE5gH7jK9" * 7}==" }},\n' for k in range(20)), "lock", "layout"),
    ("r/z.js.map", '{"version":3,"sources":["' + "x" * 900 + '"],"mappings":"' + "AAAA,CAAC;" * 300 + '"}', "source map", "layout"),
    ("r/far.js.map", '{"version":3,"file":"' + "a/" * 400 + '",\n"names":[],\n"mappings":"AA"}', "source map", "mark"),
    ("r/g.rb", "# Generated by protoweave.\nputs 1\n", "generated", "header"),
])
def test_what_decided(spark, path, text, why, by):
    from sparklode.llm.handwritten import classify

    files = spark.createDataFrame([(path,)], "id string")
    chunks = spark.createDataFrame([("c", path, 1, "file-header", text, None)], "id string, fileId string, startLine int, kind string, text string, seenAt timestamp_ntz")
    row = classify(files, chunks).first()
    assert (row.why, row.by) == (why, by)
