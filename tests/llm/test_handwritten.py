"""Problem 3."""

import datetime as dt

from sparklode.llm.handwritten import classify, measure

CODE = "import a\n\ndef total(xs):\n    # sums up\n    return sum(x * 2 for x in xs)\n"
CASES = {
    "r/src/plain.py": (CODE, None),
    "r/src/gen.py": ("# Code generated by protoweave. DO NOT EDIT.\n" + CODE, "generated"),
    "r/src/talks.py": ('# "DO NOT EDIT" is written into the header of every file we emit\n' + CODE, None),
    "r/src/de.py": ("# Diese Datei wurde maschinell erzeugt (Lauf 5).\n" + CODE, "generated"),
    "r/src/generated/taken.ts": ("// This module was generated once and has been maintained by hand since.\nexport const a = 1;\n", None),
    "r/src/generated/left.ts": ("export const a = 1;\n", "generated"),
    "r/vendor/fennel/x.go": ("package x\n\nfunc F() {}\n", "vendored"),
    "r/lib/fennel/x.go": ("// Vendored from fennel@2.1.0\npackage x\n", "vendored"),
    "r/src/vendor_portal/x.go": ("// Thin adapter over the vendored client.\npackage x\n", None),
    "r/static/a.js": ("!function(){" + 'var a=b=>b.c(1);if(!x||y===z)throw Error("e1");' * 60 + "}()", "minified"),
    "r/dist/a.js": ('"use strict";\nObject.defineProperty(exports, "__esModule", { value: true });\nfoo();\n', "compiled"),
    "r/src/numbers.py": ("T = [\n" + "  72.5, 57.6, 23.1, 73.8, 14.7,\n" * 30 + "]\n", "data"),
    "r/test/__snapshots__/a.snap.js": ("exports[`a 0`] = `\n1\n`;\n", "snapshot"),
    "r/package-lock.json": ("{}", "lock"),
    "r/a.js.map": ('{"version":3,"sources":["a.ts"],"mappings":"AAAA"}', "source map"),
    "r/empty.py": ("", None),
    "r/null.py": (None, None),
}


def test_files(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [(f"{p}:1:file-header", p, 1, "file-header", text, t, "x") for p, (text, _) in CASES.items()]
    rows += rows[:3] + [("r/src/plain.py:1:file-header", "r/src/plain.py", 1, "file-header", "# Code generated by x. DO NOT EDIT.\n", t - dt.timedelta(1), "x"), (None, "r/src/plain.py", 1, "doc", "# @generated", t, "x"), ("z", None, 1, "doc", "# @generated", t, "x")]
    chunks = spark.createDataFrame(rows, "id string, fileId string, startLine int, kind string, text string, seenAt timestamp_ntz, why string")
    files = spark.createDataFrame([(p, "wrong", "mixed", t, 1) for p in [*CASES, "r/src/plain.py", "r/nochunk.min.js", "r/nochunk.py", None]], "id string, kind string, language string, scannedAt timestamp_ntz, chars int")
    got = {r.id: r.why for r in classify(files, chunks).collect()}
    assert got == {p: why for p, (_, why) in CASES.items()} | {"r/nochunk.min.js": "minified", "r/nochunk.py": None}
    assert classify(files.limit(0), chunks).count() == 0
    assert {r.why for r in classify(files.where("id = 'r/src/gen.py'"), chunks.limit(0)).collect()} == {None}


def test_very_long_lines_are_measured_in_time():
    s = measure("x = '" + "a" * 2_000_000 + "'\n" + "1," * 500_000)
    assert s["max_line"] > 1_000_000 and s["run"] > 1_000_000
