"""A small tree through scan, analyze, report, ask and update."""

import json

import pytest

from sparklode.api import Project
from sparklode.sources import scan as tree

FILES = {
    "src/server.js": "import express from 'express';\nimport { login } from './auth';\nconst app = express();\n\n// TODO: limits\nexport async function handleLogin(req, res) {\n  const user = login(req.body);\n  console.log(user);\n  mystery(user);\n  res.json(user);\n}\n\napp.post('/login', handleLogin);\napp.listen(3000);\n",
    "src/auth.js": "import jwt from 'jsonwebtoken';\n\n/** Checks the password and signs a token. */\nexport function login(body) {\n  const row = findUser(body.name);\n  return jwt.sign(row);\n}\n\nfunction findUser(name) {\n  return { name };\n}\n",
    "test/server.test.js": "import { handleLogin } from '../src/server';\n\ntest('login', () => {\n  handleLogin({}, {});\n});\n",
    "README.md": "# Sample\n\nA login service.\n",
    ".env": "SECRET=hunter2hunter2\n",
    "node_modules/x/index.js": "module.exports = 1;\n",
    "package.json": "{}\n",
    "logo.png": "\x00\x01binary",
}


@pytest.fixture
def root(tmp_path):
    for name, text in FILES.items():
        (tmp_path / "p" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / name).write_text(text)
    return tmp_path / "p"


def test_the_whole_way(spark, root):
    project = Project(spark, str(root))
    listed = {r.path: r for r in project.sources().collect()}
    assert "node_modules/x/index.js" not in listed and listed[".env"].sensitive == "env" and listed["src/auth.js"].sensitive is None
    read = {r.path: r for r in tree.read(spark, str(root), project.sources()).collect()}
    assert ".env" not in read and "logo.png" not in read and read["src/auth.js"].loc == 11
    profile = project.scan()
    assert {"sensitive-files-present", "no-lockfile"} <= {g["id"] for g in profile["gaps"]} and any(e["kind"] == "server" and e["line"] == 14 for e in profile["entrypoints"])
    summary = project.analyze()
    assert summary["files"] == 5 and summary["parsed"] == 5 and summary["routes"] == 1
    calls = {(r.callee, r.resolution): r for r in project.table("calls").collect()}
    assert calls["login", "import"].to_symbol == "src/auth.js#login@4"
    assert ("console.log", "global") in calls
    assert ("mystery", "unresolved") in calls and ("findUser", "local") in calls
    imports = {r.specifier: r for r in project.table("imports").collect()}
    assert imports["./auth"].target == "src/auth.js" and imports["../src/server"].target == "src/server.js" and imports["jsonwebtoken"].external and imports["jsonwebtoken"].package == "jsonwebtoken"
    assert project.table("routes").first().handlerId == "src/server.js#handleLogin@6"
    walk = [(r.step, r.id) for r in project.table("flows").where("start = 'src/server.js#handleLogin@6'").orderBy("step").collect()]
    assert walk == [(1, "src/server.js#handleLogin@6"), (2, "src/auth.js#login@4"), (3, "src/auth.js#findUser@9")]
    again = project.update()
    assert again["parsed"] == 0 and again["diff"] == {"unchanged": 5}
    (root / "src/auth.js").write_text(FILES["src/auth.js"] + "\nexport const extra = 1;\n")
    assert project.update()["parsed"] == 1
    reply = project.ask("where is findUser")
    assert reply["confidence"] in ("high", "medium") and reply["citations"][0]["path"] == "src/auth.js"
    nothing = project.ask("zyzzyva quux")
    assert nothing["citations"] == [] and nothing["confidence"] == "low"
    paths = project.report()
    report = json.loads(open(paths["report.json"]).read())
    assert len(paths) == 6 and report["routes"][0]["path"] == "/login" and "hunter2" not in "".join(open(p).read() for p in paths.values())
    assert project.status()["analyzed"]


def test_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        Project(spark, str(tmp_path / "missing"))
    (tmp_path / "e").mkdir()
    empty = Project(spark, str(tmp_path / "e"))
    assert not empty.status()["analyzed"]
    with pytest.raises(ValueError):
        empty.ask("x")


def test_the_index_is_kept(spark, root):
    long = "export function big() {\n" + "".join(f"  step{k}();\n" for k in range(900)) + "  zebraCrossing();\n}\nexport function big2() { return 1 }\n"
    (root / "src/big.js").write_text(long)
    project = Project(spark, str(root))
    project.analyze()
    chunks = project.table("chunks")
    assert chunks.count() == chunks.select("id").distinct().count() and chunks.selectExpr("max(length(text)) AS n").first().n <= 4000
    parts = [r for r in chunks.where("symbolName = 'big'").orderBy("startLine").collect()]
    assert len(parts) > 2 and parts[0].startLine == 1 and parts[-1].endLine == 903 and all(b.startLine <= a.endLine for a, b in zip(parts, parts[1:]))
    assert project.ask("where is zebraCrossing")["citations"][0]["path"] == "src/big.js"
    reply = project.ask("where is login")
    assert any(s["name"] == "login" for s in reply["relatedSymbols"]) and "src/server.js#handleLogin@6" in {f["start"] for f in reply["relatedFlows"]}
    stats = project.status()["index"]
    assert stats["chunks"] == chunks.count() and stats["files"] == 6 and stats["dim"] == 256 and stats["tokens"] > 900
    assert project.table("symbol_edges").where("`from` LIKE '%handleLogin%'").first()["to"] == "src/auth.js#login@4"

    from sparklode.operators import retrieval

    worked = []
    features, retrieval.index_chunks = retrieval.index_chunks, lambda c, f=retrieval.index_chunks: worked.append(c.count()) or f(c)
    try:
        project.update()
        (root / "src/auth.js").write_text("export function login() { return 2 }\n")
        project.update()
    finally:
        retrieval.index_chunks = features
    assert worked == [0, 2]
    index = {r.id: r for r in project.table("index").collect()}
    fresh = {r.id: r for r in retrieval.index_chunks(project.table("chunks")).collect()}
    assert index.keys() == fresh.keys() and all(index[i].asDict(True) == fresh[i].asDict(True) for i in fresh)


def test_another_parser_parses_again(spark, root, monkeypatch):
    import sparklode.api as api

    project = Project(spark, str(root))
    assert project.analyze()["parsed"] == 5 and project.update()["parsed"] == 0
    monkeypatch.setattr(api, "PARSER", api.PARSER + 1)
    assert project.update()["parsed"] == 5


def test_facts_and_flows_of_configuration(spark, root):
    (root / "src/conf").mkdir()
    (root / "src/conf/app.json").write_text('{"port": 3000}\n')
    (root / "src/auth.js").write_text("import conf from './conf/app.json';\n" + FILES["src/auth.js"])
    project = Project(spark, str(root))
    project.analyze()
    flow = project.table("flows").where("kind = 'data'").orderBy("step").collect()
    assert [(r.start, r.step, r.evidence, r.confidence) for r in flow] == [("data:src/conf/app.json", 1, "src/conf/app.json:1", "low"), ("data:src/conf/app.json", 2, "src/auth.js:1", "low")]
    facts = project.brief()
    assert facts.startswith("# Facts") and "POST /login | src/server.js:13 | express" in facts and "[P0] sensitive-files-present" in facts and "hunter2" not in facts
    assert project.brief(60).endswith("(cut short)") and len(project.brief(60)) <= 60


def test_deep_folders_are_listed(spark, tmp_path):
    want = {}
    for name in ("a.py", "top/b.py", "top/x/c.py", "top/x/y/z/d.py", "top/_e.py", "top/x/.f.py", "empty/one/"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        if name.endswith("/"):
            path.mkdir(parents=True, exist_ok=True)
            continue
        path.write_text("x" * len(name))
        want[name] = len(name)
    assert {r.path: r.bytes for r in tree.listing(spark, str(tmp_path)).collect()} == want
    assert tree.listing(spark, str(tmp_path / "empty")).count() == 0 and tree.listing(spark, str(tmp_path / "none")).count() == 0
