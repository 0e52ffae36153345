"""Manifests of every ecosystem, and what follows from them."""

import json

import pytest
from pyspark.sql import functions as F

from sparklode.sources import manifests as M

FILES = {
    "package.json": json.dumps({"name": "a", "version": "1.0.0", "main": "./lib/a.js", "bin": {"a": "bin/a.js"}, "exports": {".": {"import": "./lib/a.mjs"}, "./x": "./lib/x.js"}, "scripts": {"test": "vitest run", "build": "tsc"}, "dependencies": {"express": "^4.0.0"}, "devDependencies": {"vitest": "1.0.0"}}),
    "py/pyproject.toml": '[project]\nname = "b"\nversion = "2"\ndependencies = ["flask>=2", "numpy==1.26"]\n[project.optional-dependencies]\ndev = ["pytest"]\n',
    "py/requirements.txt": "# c\nrequests==2.0  # pinned\n-r other.txt\npandas[excel]>=2; python_version>'3'\n",
    "j/pom.xml": '<project xmlns="http://maven.apache.org/POM/4.0.0"><artifactId>c</artifactId><version>3</version><dependencies><dependency><artifactId>junit</artifactId><version>4</version><scope>test</scope></dependency></dependencies></project>',
    "g/build.gradle": "dependencies {\n  implementation 'org.x:y:1.2'\n  testImplementation(\"org.junit:junit-jupiter:5\")\n}\n",
    "go.mod": "module example.com/m\n\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.0\n)\n", "Cargo.toml": '[package]\nname = "r"\nversion = "0.1.0"\n[dependencies]\nserde = { version = "1" }\n', "composer.json": '{"name": "p/q", "require": {"laravel/framework": "10.0"}}',
    "Gemfile": "gem 'rails', '7.0'\ngem \"rspec\"\n", "pubspec.yaml": "name: d\ndependencies:\n  http: ^1.0.0\ndev_dependencies:\n  test: any\n", "Package.swift": 'let package = Package(name: "s", dependencies: [.package(url: "https://x.y/z.git", from: "1.0.0")])', "Makefile": "all: x\nlint:\n\ttrue\nX := 1\n", "CMakeLists.txt": "project(cm)\n", "x.csproj": '<PackageReference Include="N" Version="1" />', "bad/package.json": "{nope", "other.txt": "x",
}


def test_manifests(spark):
    contents = spark.createDataFrame([(p, t, "config") for p, t in FILES.items()] + [("t/a_test.go", "package t\nfunc TestA(t *testing.T) {\n}\n", "test")], "path string, content string, kind string")
    found = M.manifests(contents)
    got = {r.path: r for r in found.collect()}
    assert len(got) == len(FILES) - 1 and got["bad/package.json"].note.startswith("malformed") and all(not r.note for p, r in got.items() if not p.startswith("bad"))
    assert {p: r.name for p, r in got.items() if r.name} == {"package.json": "a", "py/pyproject.toml": "b", "j/pom.xml": "c", "go.mod": "example.com/m", "Cargo.toml": "r", "composer.json": "p/q", "pubspec.yaml": "d", "Package.swift": "s", "CMakeLists.txt": "cm"}
    names = {p: [(d["name"], d["dev"]) for d in r.dependencies] for p, r in got.items() if r.dependencies}
    assert names["package.json"] == [("express", False), ("vitest", True)] and names["py/pyproject.toml"] == [("flask", False), ("numpy", False), ("pytest", True)] and names["py/requirements.txt"] == [("requests", False), ("pandas", False)]
    assert names["j/pom.xml"] == [("junit", True)] and names["g/build.gradle"] == [("y", False), ("junit-jupiter", True)] and names["go.mod"] == [("github.com/gin-gonic/gin", False)] and names["Gemfile"] == [("rails", False), ("rspec", False)] and names["pubspec.yaml"] == [("http", False), ("test", True)]
    assert [(e["path"], e["kind"]) for e in got["package.json"].entries] == [("lib/a.js", "main"), ("bin/a.js", "bin"), ("lib/a.mjs", "main"), ("lib/x.js", "export")]
    runs = {(r.path, r.preset): r.command for r in M.commands(found).collect()}
    assert runs["package.json", "test"] == "npm run test" and runs["go.mod", "build"] == "go build ./..." and runs["Makefile", "lint"] == "make lint" and runs["j/pom.xml", "test"] == "mvn test"
    assert {r.framework for r in M.frameworks(found, contents).collect()} >= {"vitest", "pytest", "junit", "rspec", "go-test"}
    assert {(r.name, r.purpose) for r in M.notable(found).collect()} >= {("express", "web framework"), ("rails", "web framework"), ("numpy", "data")}
    assert {r.name for r in M.unpinned(found).where(F.col("path") == "package.json").collect()} == {"express"}
    assert M.manifests(contents.limit(0)).count() == 0


def test_project_kinds(spark):
    from sparklode.sources import manifests as M
    from sparklode.sources.scan import entry_points, project_kinds

    def kinds(files):
        rows = spark.createDataFrame([(p, k, "javascript", t) for p, (k, t) in files.items()], "path string, kind string, language string, content string")
        return project_kinds(rows, rows, M.manifests(rows), entry_points(rows))

    package = '{"name": "a", "main": "x.js", "dependencies": {"@nestjs/core": "1", "react-dom": "1", "lodash": "1"}}'
    assert kinds({"package.json": ("config", package), "src/x.js": ("source", "1")}) == ["library", "web-app", "api-service"]
    assert kinds({"package.json": ("config", '{"bin": "b.js", "main": "b.js", "workspaces": ["p/*"]}'), "b.js": ("source", "1")}) == ["cli", "monorepo"]
    assert kinds({"packages/a/package.json": ("config", "{}"), "lib/x.js": ("source", "1")}) == ["monorepo"]
    assert kinds({"a.csv": ("asset", "1"), "b.csv": ("asset", "1"), "x.js": ("source", "1")}) == ["data"]
    assert kinds({"README.md": ("docs", "x")}) == ["docs-only"] and kinds({"src/y.js": ("source", "express")}) == []


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import json

    import sparklode.cli as cli

    (tmp_path / "a.py").write_text("def f():\n    return 1\n")
    monkeypatch.setattr(cli, "build_session", lambda *a, **k: spark)
    assert cli.main(["status", str(tmp_path), "--json"]) == 0
    out = capsys.readouterr().out
    assert out.count("\n") == 1 and json.loads(out)["analyzed"] is False
    assert cli.main(["status", str(tmp_path), "--quiet"]) == 0 and capsys.readouterr().out == ""
    assert cli.main(["ask", str(tmp_path), "what"]) == 2 and "nothing is analyzed" in capsys.readouterr().err
    for wrong in (["ask", str(tmp_path)], ["status", str(tmp_path), "--limit", "0"], ["dance", str(tmp_path)]):
        with pytest.raises(SystemExit):
            cli.main(wrong)
