"""Flows, related results, JSON helpers and the sanitiser."""

import datetime as dt


from sparklode.functions import jsons
from sparklode.operators import validate as V
from sparklode.operators.flows import configuration, detect, related


def test_flows(spark):
    symbols = spark.createDataFrame([(n, "f.js", n, k, k == 1, "function", fi, fo) for k, (n, fi, fo) in enumerate([("h", 0, 1), ("free", 0, 1), ("a", 2, 1), ("b", 1, 1), ("c", 1, 0), ("main", 0, 0)])], "id string, fileId string, name string, line int, exported boolean, kind string, fanIn int, fanOut int")
    calls = spark.createDataFrame([("h", "a", 1, "a"), ("free", "a", 1, "a"), ("a", "b", 2, "b"), ("b", "c", 3, "c"), ("c", None, 4, "x"), ("a", "a", 5, "a")], "from_symbol string, to_symbol string, line int, callee string")
    routes = spark.createDataFrame([("h", "GET", "/x"), (None, "GET", "/y"), ("free", "EVENT", "job")], "handlerId string, method string, path string")
    entries = spark.createDataFrame([("f.js",)], "path string")
    got = {r.start: r for r in detect(routes, symbols, calls, entries).collect()}
    assert {k: (r.kind, r.confidence) for k, r in got.items()} == {"h": ("http", "high"), "free": ("event", "high"), "main": ("cli", "low")}
    assert [(s.order, s.id) for s in got["h"].steps] == [(1, "h"), (2, "a"), (3, "b"), (4, "c")] and got["h"].steps[0].evidence == "f.js:0"
    hits = spark.createDataFrame([("f.js", "b")], "fileId string, symbolName string")
    near, flows = related(hits, symbols, detect(routes, symbols, calls, entries))
    assert near.first().id == "b" and {r.start for r in flows.collect()} == {"h", "free", "main"}
    files = spark.createDataFrame([("c.json", "config"), ("a.js", "source")], "id string, kind string")
    imports = spark.createDataFrame([("a.js", "c.json", 3), ("a.js", "c.json", 1), ("b.js", "c.json", 2), ("b.js", "a.js", 1)], "fileId string, target string, line int")
    assert [(r.id, r.readers, r["first"].line) for r in configuration(files, imports).collect()] == [("c.json", 2, 1)]


def test_json():
    loop: dict = {}
    loop["self"] = loop
    assert jsons.json_safe({"a": float("nan"), "b": {2, 1}, "c": dt.date(2025, 1, 2), "d": loop, 3: len}) == {"a": None, "b": [1, 2], "c": "2025-01-02", "d": {"self": None}}
    assert jsons.stable({"b": 1, "a": [True]}) == '{"a":[true],"b":1}'
    assert jsons.extract("say ```json\n{\"a\": [1, 2,],}\n``` end") == {"a": [1, 2]} and jsons.extract("x [1] y") == [1] and jsons.extract("none") is None and jsons.extract(None) is None
    assert jsons.read("/nowhere.json", 5) == 5


def test_sanitize(spark):
    files, symbols = spark.createDataFrame([("src/a.js", 10)], "id string, loc int"), spark.createDataFrame([("x", "f")], "id string, name string")
    texts = spark.createDataFrame([(1, "See src/a.js:3 first. Then src/b.js:1 fails! Fine?\nEnd"), (2, "plain")], "k int, text string")
    got = {r.k: (r.text, r.dropped) for r in V.sanitize(texts, "k", files, symbols).collect()}
    assert got == {1: ("See src/a.js:3 first. Fine?\nEnd", 1), 2: ("plain", 0)} or got[1] == ("See src/a.js:3 first.  Fine?\nEnd", 1)
    assert V.drop_rate(V.check(V.references(texts, "k"), files, symbols)).first().dropped == 1
