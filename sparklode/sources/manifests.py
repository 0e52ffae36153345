"""Package manifests of eleven ecosystems: names, versions, dependencies, scripts and declared entry points; from these, commands
and test frameworks."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name

SCHEMA = "path string, ecosystem string, name string, version string, dependencies array<struct<name:string,version:string,dev:boolean>>, scripts array<struct<name:string,command:string>>, entries array<struct<path:string,kind:string>>, note string"
#: The ecosystem of each manifest name.
MANIFESTS = {
    "package.json": "node", "pyproject.toml": "python", "setup.py": "python", "setup.cfg": "python", "requirements.txt": "python", "pipfile": "python", "pom.xml": "jvm", "build.gradle": "jvm", "build.gradle.kts": "jvm",
    "go.mod": "go", "cargo.toml": "rust", "composer.json": "php", "gemfile": "ruby", "cmakelists.txt": "cmake", "makefile": "make", "pubspec.yaml": "dart", "package.swift": "swift",
}
#: Script names that stand for a command, in the order commands are listed.
PRESETS = ("install", "dev", "start", "build", "test", "lint", "format", "typecheck")
PRESET_NAMES = {"install": ("install",), "dev": ("dev", "develop", "serve", "watch"), "start": ("start",), "build": ("build", "compile", "bundle"), "test": ("test", "tests", "unit", "test:unit"), "lint": ("lint", "eslint"), "format": ("format", "fmt", "prettier"), "typecheck": ("typecheck", "type-check", "tsc", "check-types")}
#: What an ecosystem runs when it says nothing itself.
DEFAULTS = {
    "go": (("build", "go build ./..."), ("test", "go test ./...")), "rust": (("build", "cargo build"), ("test", "cargo test")), "maven": (("build", "mvn package"), ("test", "mvn test")), "gradle": (("build", "gradle build"), ("test", "gradle test")),
    "ruby": (("install", "bundle install"),), "php": (("install", "composer install"),), "python": (("install", "pip install -r requirements.txt"),), "dart": (("install", "dart pub get"), ("test", "dart test")), "swift": (("build", "swift build"), ("test", "swift test")), "make": (("build", "make"),), "cmake": (("build", "cmake --build ."),),
}
#: Test frameworks by the command that runs them and by the dependency that brings them.
BY_COMMAND = (("node-test", r"\bnode\s+--test\b"), ("vitest", r"\bvitest\b"), ("jest", r"\bjest\b"), ("mocha", r"\bmocha\b"), ("ava", r"\bava\b"), ("jasmine", r"\bjasmine\b"), ("playwright", r"\bplaywright\b"), ("cypress", r"\bcypress\b"), ("pytest", r"\bpytest\b"), ("go-test", r"\bgo\s+test\b"), ("junit", r"\bmvn\b|\bgradlew?\b"), ("rspec", r"\brspec\b"), ("phpunit", r"\bphpunit\b"), ("cargo-test", r"\bcargo\s+test\b"))
BY_TEXT = (("node-test", r"(?:from|require\()\s*['\"]node:test['\"]"), ("vitest", r"(?:from|require\()\s*['\"]vitest['\"]"), ("jest", r"['\"]@jest/globals['\"]|\bjest\.(?:mock|fn|spyOn)\s*\("), ("mocha", r"(?:from|require\()\s*['\"]mocha['\"]"), ("playwright", r"['\"]@playwright/test['\"]"), ("cypress", r"\bcy\.[a-z]+\s*\("), ("pytest", r"(?m)^\s*(?:import|from)\s+pytest\b"), ("unittest", r"(?m)^\s*(?:import|from)\s+unittest\b"), ("junit", r"(?m)^\s*import\s+org\.junit\."), ("testng", r"(?m)^\s*import\s+org\.testng\."), ("go-test", r"(?m)^\s*func\s+Test\w*\s*\(\s*\w+\s+\*testing\.T\s*\)"), ("rspec", r"(?m)^\s*require\s+['\"]rspec['\"]"), ("phpunit", r"\bextends\s+TestCase\b"), ("cargo-test", r"#\[(?:test|cfg\(test\))\]"))
BY_DEPENDENCY = {"vitest": "vitest", "jest": "jest", "mocha": "mocha", "ava": "ava", "jasmine": "jasmine", "@playwright/test": "playwright", "cypress": "cypress", "pytest": "pytest", "junit": "junit", "junit-jupiter": "junit", "testng": "testng", "rspec": "rspec", "phpunit/phpunit": "phpunit"}
#: What well-known dependencies are for.
NOTABLE = {
    "web framework": "express koa fastify hapi @nestjs/core next nuxt flask django fastapi starlette tornado spring-boot-starter-web gin echo actix-web axum rails sinatra laravel/framework symfony/framework-bundle".split(), "user interface": "react vue svelte @angular/core preact solid-js".split(),
    "database": "pg mysql mysql2 sqlite3 mongodb mongoose redis ioredis sqlalchemy psycopg2 psycopg2-binary pymongo prisma typeorm sequelize knex gorm diesel sqlx activerecord".split(), "queue": "amqplib kafkajs bull bullmq celery pika nats".split(), "build tool": "webpack vite rollup esbuild parcel babel @babel/core typescript".split(),
    "data": "pandas numpy pyspark scikit-learn torch tensorflow".split(),
}


def _requirement(line: str) -> tuple[str, str] | None:
    m = re.match(r"\s*([A-Za-z0-9][\w.\-]*)(?:\[[^\]]*\])?\s*(.*?)\s*(?:;.*|#.*)?$", line)
    return (m.group(1), m.group(2)) if m and not line.lstrip().startswith(("#", "-")) else None


def parse(path: str, text: str) -> dict:
    """One manifest; a malformed one keeps its row with a note."""
    base = path.rsplit("/", 1)[-1].lower()
    kind = MANIFESTS.get(base) or ("dotnet" if base.endswith((".csproj", ".sln")) else None)
    row = {"path": path, "ecosystem": kind, "name": None, "version": None, "dependencies": [], "scripts": [], "entries": [], "note": None}
    dep = lambda name, version="", dev=False: row["dependencies"].append({"name": name, "version": str(version or ""), "dev": dev})
    folder = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
    try:
        if base in ("package.json", "composer.json"):
            held = json.loads(text)
            row["name"], row["version"] = (held.get(k) if isinstance(held.get(k), str) else None for k in ("name", "version"))
            for group, dev in (("dependencies", False), ("require", False), ("devDependencies", True), ("require-dev", True), ("peerDependencies", False)):
                for n, v in sorted((held.get(group) or {}).items()):
                    dep(n, v if isinstance(v, str) else "", dev)
            row["scripts"] = [{"name": n, "command": str(c)} for n, c in sorted((held.get("scripts") or {}).items())]
            bins = held.get("bin")
            declared = [("main", held.get("main")), ("main", held.get("module")), *[("bin", b) for b in (bins.values() if isinstance(bins, dict) else [bins])], *[("main" if k in (".", "") else "export", v) for k, v in _targets(held.get("exports"))]]
            row["entries"] = [{"path": folder + re.sub(r"^\./", "", v), "kind": k} for k, v in declared if isinstance(v, str) and v and "://" not in v]
        elif base == "pyproject.toml" or base in ("pipfile", "cargo.toml"):
            held = tomllib.loads(text)
            project = held.get("project") or (held.get("tool") or {}).get("poetry") or held.get("package") or {}
            row["name"], row["version"] = project.get("name"), project.get("version") if isinstance(project.get("version"), str) else None
            if isinstance(project.get("dependencies"), list):
                for r in filter(None, map(_requirement, project["dependencies"])):
                    dep(*r)
            for group in (project.get("optional-dependencies") or {}).values():
                for r in filter(None, map(_requirement, group)):
                    dep(*r, True)
            tables = [(held.get("dependencies"), False), (held.get("dev-dependencies"), True), (held.get("packages"), False), (held.get("dev-packages"), True)] + ([(project.get("dependencies"), False)] if isinstance(project.get("dependencies"), dict) else [])
            for table, dev in tables:
                for n, v in sorted((table or {}).items()):
                    dep(n, v if isinstance(v, str) else (v or {}).get("version", ""), dev)
            row["scripts"] = [{"name": n, "command": str(c)} for n, c in sorted((project.get("scripts") or {}).items())]
        elif base == "requirements.txt":
            for r in filter(None, map(_requirement, text.splitlines())):
                dep(*r)
        elif base in ("setup.py", "setup.cfg"):
            m = re.search(r"\bname\s*=\s*['\"]?([\w.\-]+)", text)
            row["name"] = m.group(1) if m else None
            block = re.search(r"install_requires\s*=\s*(\[[^\]]*\]|(?:\n\s+[^\n]+)+)", text)
            for r in filter(None, map(_requirement, re.findall(r"['\"]([^'\"]+)['\"]", block.group(1)) or block.group(1).splitlines() if block else [])):
                dep(*r)
        elif base == "pom.xml":
            row["ecosystem"] = "maven"
            root = ElementTree.fromstring(re.sub(r"\sxmlns=\"[^\"]*\"", "", re.sub(r"<!DOCTYPE[^>]*>", "", text), count=1))
            row["name"], row["version"] = root.findtext("artifactId"), root.findtext("version")
            for d in root.iterfind(".//dependency"):
                dep(d.findtext("artifactId") or "", d.findtext("version"), d.findtext("scope") == "test")
        elif base.startswith("build.gradle"):
            row["ecosystem"] = "gradle"
            for scope, group, name, version in re.findall(r"\b(\w*[iI]mplementation|api|compileOnly|runtimeOnly|\w*[cC]ompile)\b[\s(]+['\"]([\w.\-]+):([\w.\-]+)(?::([\w.\-]+))?['\"]", text):
                dep(name, version, scope.lower().startswith("test"))
        elif base == "go.mod":
            m = re.search(r"^module\s+(\S+)", text, re.M)
            row["name"] = m.group(1) if m else None
            for name, version in re.findall(r"^\s*(?:require\s+)?([\w.\-]+\.[\w.\-]+/\S+)\s+(v\S+)", text, re.M):
                dep(name, version)
        elif base == "gemfile":
            for name, version in re.findall(r"^\s*gem\s+['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?", text, re.M):
                dep(name, version)
        elif base == "pubspec.yaml":
            m = re.search(r"^name:\s*(\S+)", text, re.M)
            row["name"] = m.group(1) if m else None
            for block, dev in ((r"^dependencies:\n((?:[ \t]+.*\n?)*)", False), (r"^dev_dependencies:\n((?:[ \t]+.*\n?)*)", True)):
                for name, version in re.findall(r"^  (\w+):[ \t]*(\S*)", (re.search(block, text, re.M) or [None, ""])[1], re.M):
                    dep(name, version, dev)
        elif base == "package.swift":
            m = re.search(r"name:\s*\"([^\"]+)\"", text)
            row["name"] = m.group(1) if m else None
            for url in re.findall(r"\.package\([^)]*url:\s*\"([^\"]+)\"", text):
                dep(url.rstrip("/").rsplit("/", 1)[-1].removesuffix(".git"))
        elif base == "makefile":
            row["scripts"] = [{"name": n, "command": f"make {n}"} for n in dict.fromkeys(re.findall(r"^([A-Za-z][\w\-]*)\s*:(?!=)", text, re.M))]
        elif base == "cmakelists.txt":
            m = re.search(r"project\s*\(\s*([\w\-]+)", text, re.I)
            row["name"] = m.group(1) if m else None
        elif base.endswith(".csproj"):
            for name, version in re.findall(r"<PackageReference\s+Include=\"([^\"]+)\"(?:\s+Version=\"([^\"]+)\")?", text):
                dep(name, version)
    except Exception as error:  # noqa: BLE001
        row["note"] = f"malformed: {type(error).__name__}"
    return row


def _targets(value, key: str = ".") -> list[tuple[str, str]]:
    """The files an `exports` field names, with the subpath each stands for."""
    if isinstance(value, str):
        return [(key, value)]
    if isinstance(value, list):
        return [t for v in value for t in _targets(v, key)]
    if isinstance(value, dict):
        return [t for k, v in value.items() for t in _targets(v, k if k.startswith(".") else key)]
    return []


def manifests(contents: DataFrame) -> DataFrame:
    """One row for each manifest among path and content."""
    base = F.lower(base_name(F.col("path")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parse(p, c or "") for p, c in zip(batch["path"], batch["content"])], columns=[c.split()[0] for c in re.split(r", (?=\w+ )", SCHEMA)])

    return contents.where(base.isin(*MANIFESTS) | base.rlike(r"\.(?:csproj|sln)\z")).select("path", "content").mapInPandas(run, SCHEMA)


def commands(found: DataFrame) -> DataFrame:
    """path, preset and command: what scripts say by their names, else what the ecosystem runs by itself; presets in their order."""
    known = [(n, p) for p, names in PRESET_NAMES.items() for n in names]
    names = F.create_map(*[F.lit(x) for kv in known for x in kv])
    said = found.select("path", "ecosystem", F.explode("scripts").alias("s")).select("path", names[F.lower("s.name")].alias("preset"), F.when(F.col("ecosystem") == "node", F.concat(F.lit("npm run "), F.col("s.name"))).otherwise(F.col("s.command")).alias("command")).where("preset IS NOT NULL")
    usual = found.sparkSession.createDataFrame([(e, p, c) for e, pairs in DEFAULTS.items() for p, c in pairs], "ecosystem string, preset string, command string")
    rest = found.select("path", "ecosystem").join(usual, "ecosystem").join(said.select("path", "preset"), ["path", "preset"], "left_anti").select("path", "preset", "command")
    rank = F.create_map(*[F.lit(x) for k, p in enumerate(PRESETS) for x in (p, k)])
    return said.unionByName(rest).dropDuplicates(["path", "preset"]).withColumn("rank", rank[F.col("preset")])


def frameworks(found: DataFrame, contents: DataFrame) -> DataFrame:
    """framework and evidence: from dependencies, scripts and what test files import, one row each."""
    by_name = F.create_map(*[F.lit(x) for kv in BY_DEPENDENCY.items() for x in kv])
    a = found.select("path", F.explode("dependencies.name").alias("n")).select(by_name[F.lower("n")].alias("framework"), F.concat("path", F.lit(" dependency")).alias("evidence"))
    script = found.select("path", F.explode("scripts.command").alias("c"))
    b = script.select("path", F.explode(F.array_compact(F.array(*[F.when(F.col("c").rlike(p), f) for f, p in BY_COMMAND]))).alias("framework")).select("framework", F.concat("path", F.lit(" script")).alias("evidence"))
    c = contents.where("kind = 'test'").select("path", F.explode(F.array_compact(F.array(*[F.when(F.col("content").rlike(p), f) for f, p in BY_TEXT]))).alias("framework")).select("framework", F.col("path").alias("evidence"))
    return a.unionByName(b).unionByName(c).where("framework IS NOT NULL").groupBy("framework").agg(F.slice(F.sort_array(F.collect_set("evidence")), 1, 5).alias("evidence"))


def notable(found: DataFrame) -> DataFrame:
    """name, purpose and path of dependencies whose purpose is known."""
    known = F.create_map(*[F.lit(x) for purpose, names in NOTABLE.items() for n in names for x in (n, purpose)])
    return found.select("path", F.explode("dependencies").alias("d")).select("path", "d.name", known[F.lower("d.name")].alias("purpose")).where("purpose IS NOT NULL").distinct()


def unpinned(found: DataFrame) -> DataFrame:
    """path and name of dependencies whose version leaves the choice open."""
    v = F.trim("d.version")
    return found.select("path", F.explode("dependencies").alias("d")).where((v == "") | v.rlike(r"^(?:\*|latest|x|\^|~|>=?)") | v.contains("||")).select("path", "d.name")
