"""Scanning a source tree: a listing first, and contents only of what may be read."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import base_name, count_lines, normalize_text
from ..operators import rules


@dataclass(frozen=True)
class Limits:
    """What one scan reads unless told otherwise."""

    files: int = 20_000
    file_bytes: int = 256 * 1024
    total_bytes: int = 64 * 1024 * 1024
    binary_prefix: int = 8192




def _files(root: str):
    """The file system of a path or URI, and the path within it."""
    from pyarrow.fs import FileSystem

    fs, base = FileSystem.from_uri(root)
    return fs, base.rstrip("/")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (relative) and bytes of every file under root; contents are not touched. A missing root gives no rows.

    The driver lists the root, tasks list its folders, and after these are spread out again other tasks list what is below each of
    their folders, so that one huge folder at the top is no single task. Spark's own file source would leave out names that begin
    with a dot or an underscore, which source trees have. Links to folders are not followed.
    """
    from pyarrow.fs import FileSelector, FileType

    schema = "path string, bytes long"
    fs, base = _files(root)
    if fs.get_file_info(base).type != FileType.Directory:
        return spark.createDataFrame([], schema)
    top = fs.get_file_info(FileSelector(base))
    heads = [(i.path[len(base) + 1 :], i.size if i.type == FileType.File else -1) for i in top if i.type in (FileType.File, FileType.Directory)]
    if not heads:
        return spark.createDataFrame([], schema)

    def opened(recursive: bool):
        """Folders (rows of size -1) become what they hold: everything below, or files and folders one level down."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fs, base = _files(root)
            for batch in batches:
                rows: list[tuple[str, int]] = []
                for name, size in zip(batch["path"], batch["bytes"]):
                    if size >= 0:
                        rows.append((name, int(size)))
                        continue
                    for i in fs.get_file_info(FileSelector(f"{base}/{name}", recursive=recursive)):
                        if i.type == FileType.File or i.type == FileType.Directory and not recursive:
                            rows.append((i.path[len(base) + 1 :], i.size if i.type == FileType.File else -1))
                yield pd.DataFrame(rows, columns=["path", "bytes"])

        return run

    width = 4 * spark.sparkContext.defaultParallelism
    folders = spark.createDataFrame(heads, schema).repartition(min(len(heads), width), "path").mapInPandas(opened(False), schema)
    return folders.repartition(width, "path").mapInPandas(opened(True), schema)


def ignore_rules(root: str, extra: Sequence[str] = ()) -> list[str]:
    """The built-in rules, those of the ignore files in the root, then `extra`; later ones win."""
    from pyarrow.fs import FileType

    out = list(rules.IGNORED)
    fs, base = _files(root)
    for name in (".gitignore", ".sparklodeignore"):
        if fs.get_file_info(f"{base}/{name}").type == FileType.File:
            with fs.open_input_stream(f"{base}/{name}") as stream:
                out += [r.strip() for r in stream.read().decode("utf-8", "replace").splitlines() if r.strip() and not r.startswith("#")]
    return [*out, *extra]


def scan(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), limits: Limits = Limits(), sensitive: Sequence[str] = ()) -> DataFrame:
    """The files of a tree that count: path, bytes, language, kind and sensitive (what a sensitive file holds, else null).

    `exclude` (prefixes or globs) goes before everything, `include` brings back what is ignored. Files count in the order of their
    path until their number or bytes reach the limits, which a running sum over the listing decides.
    """
    from ..operators.records import prefix_budget

    path = F.col("path")
    gone = F.lit(False)
    for e in exclude:
        gone = gone | path.startswith(e.rstrip("/") + "/") | (path == e) | path.rlike(rules.java(rules.glob_regex(e)))
    kept = F.lit(False)
    for i in include:
        kept = kept | path.rlike(rules.java(rules.glob_regex(i)))
    rows = listing(spark, root).where(~gone & (kept | ~rules.ignored(path, ignore_rules(root))))
    language = rules.language_of(path)
    rows = rows.withColumn("language", language).withColumn("kind", rules.file_kind(path, language)).withColumn("sensitive", rules.sensitive_kind(path, sensitive))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")).first()
    if size.n <= limits.files and (size.b or 0) < limits.total_bytes:
        return rows
    by_size = prefix_budget(rows, "bytes", limits.total_bytes, [path])
    return prefix_budget(by_size.withColumn("__one", F.lit(1)), "__one", limits.files, [path]).drop("__one")


def read(spark: SparkSession, root: str, sources: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """path, language, kind, bytes, content, loc and hash of the text files among `sources`.

    Sensitive files and those above the size limit never reach the tasks that open files, which get nothing but the names that
    passed. Files with a zero byte at their beginning are binary; malformed UTF-8 is read with replacement characters; a file
    that has gone meanwhile is left out.
    """
    from ..functions.text import content_hash

    allowed = sources.where(F.col("sensitive").isNull() & (F.col("bytes") <= limits.file_bytes)).select("path", "language", "kind", "bytes")

    def open_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _files(root)
        for batch in batches:
            texts = []
            for name in batch["path"]:
                try:
                    with fs.open_input_stream(f"{base}/{name}") as stream:
                        raw = stream.read()
                except OSError:
                    raw = None
                texts.append(None if raw is None or b"\0" in raw[: limits.binary_prefix] else raw.decode("utf-8", "replace").removeprefix("\ufeff"))
            yield batch.assign(content=texts).dropna(subset=["content"])

    rows = allowed.mapInPandas(open_all, "path string, language string, kind string, bytes long, content string")
    hashed = rows.withColumn("hash", content_hash(F.col("content"))).withColumn("content", normalize_text(F.col("content")))
    return hashed.withColumn("loc", count_lines(F.col("content")).cast("int"))


def profile(sources: DataFrame, contents: DataFrame) -> dict:
    """The summary of a tree, from a few small aggregates: sizes, languages, kinds, ecosystems, commands, test frameworks, entry
    points, and the gaps with their priorities."""
    from . import manifests as M

    size = sources.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.count_if(F.col("sensitive").isNotNull()).alias("sensitive"), F.count_if(F.col("bytes") > Limits.file_bytes).alias("big")).first()
    languages = contents.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"), F.sum("bytes").alias("bytes")).orderBy(F.desc("loc"), "language").collect()
    kinds = sources.groupBy("kind").count().orderBy(F.desc("count"), "kind").collect()
    base = F.lower(base_name(F.col("path")))
    has = sources.agg(
        F.count_if(base.isin(rules.LOCK_FILES)).alias("locks"), F.count_if(base.startswith("readme")).alias("readme"), F.count_if(F.col("path").rlike(r"^(?:\.github/workflows/|\.gitlab-ci|\.circleci/|Jenkinsfile)")).alias("ci"),
        F.count_if(F.col("kind") == "test").alias("tests"), F.count_if(base == ".gitignore").alias("gitignore"), F.count_if(base.rlike(r"^(?:\.eslintrc|eslint\.config|\.prettierrc|ruff\.toml|\.flake8)")).alias("lint"),
        F.count_if(base.rlike(r"^(?:tsconfig.*\.json|mypy\.ini|pyrightconfig\.json)")).alias("types"), F.count_if((F.col("sensitive") != "env-template") & F.col("sensitive").isNotNull()).alias("secret"), F.count_if(base.startswith("dockerfile")).alias("docker")).first()
    found = M.manifests(contents).cache()
    ecosystems = [r.asDict() for r in found.select("ecosystem", "path", "name", "version", F.size("dependencies").alias("dependencies"), "note").orderBy("path").limit(200).collect()]
    runs = [r.asDict() for r in M.commands(found).orderBy("rank", "path").select("preset", "command", "path").limit(50).collect()]
    tests = [r.asDict() for r in M.frameworks(found, contents).orderBy("framework").collect()]
    purposes = [r.asDict() for r in M.notable(found).orderBy("purpose", "name", "path").limit(100).collect()]
    loose = M.unpinned(found).count()
    kinds_of = project_kinds(sources, contents, found, entry_points(contents))
    found.unpersist()
    marks = {r.kind: r["count"] for r in signals(contents).groupBy("kind").count().collect()}
    places = signals(contents).where("kind = 'secret'").select(F.concat_ws(":", "path", F.col("line").cast("string")).alias("at")).orderBy("at").limit(20).collect()
    hidden = sources.where(F.col("sensitive").isNotNull() & (F.col("sensitive") != "env-template")).select("path").orderBy("path").limit(50).collect()
    unchecked = contents.where(F.lower(base_name(F.col("path"))).startswith("dockerfile") & ~F.col("content").contains("HEALTHCHECK")).count()
    entries = entry_points(contents).orderBy("path", "kind").limit(200).collect()
    packaged = [e for e in ecosystems if e["ecosystem"] in ("node", "python", "rust", "ruby", "php")]
    typed = any(r.language in ("javascript", "python") for r in languages)
    gaps = [
        ("sensitive-files-present", "P0", has.secret > 0), ("no-lockfile", "P1", bool(packaged) and not has.locks), ("no-tests", "P1", not has.tests and size.files > 0), ("no-gitignore", "P1", not has.gitignore), ("unpinned-deps", "P1", loose > 0),
        ("no-readme", "P2", not has.readme), ("no-ci", "P2", not has.ci), ("no-lint-format", "P2", not has.lint and size.files > 0), ("no-typecheck", "P2", typed and not has.types), ("oversized-file", "P2", size.big > 0),
        ("todo-backlog", "P3", marks.get("todo", 0) >= 20), ("debug-leftovers", "P3", marks.get("debug", 0) > 0), ("container-no-healthcheck", "P3", unchecked > 0)]
    return {
        "size": {"files": size.files, "bytes": size.bytes or 0, "sensitive": size.sensitive}, "languages": [r.asDict() for r in languages], "kinds": {r.kind: r["count"] for r in kinds}, "ecosystems": ecosystems, "commands": runs, "testFrameworks": tests, "notable": purposes,
        "projectKinds": kinds_of, "signals": marks, "secrets": [r["at"] for r in places], "sensitivePaths": [r.path for r in hidden], "entrypoints": [r.asDict() for r in entries], "docker": bool(has.docker), "gaps": [{"id": g, "priority": p} for g, p, on in gaps if on],
    }


def project_kinds(sources: DataFrame, contents: DataFrame, found: DataFrame, entries: DataFrame) -> list[str]:
    """What a tree is, in a fixed order: cli, library, web-app, api-service, monorepo, data, docs-only; several may hold. A dependency
    counts if its name, or a part of it between signs, is that of a known one. One row of flags reaches the driver."""
    path = F.col("path")
    names = found.select(F.explode("dependencies.name").alias("n")).select(F.lower("n").alias("n"))
    of = lambda known: F.coalesce(F.bool_or(F.exists(F.array(*[F.lit(k) for k in known]), lambda k: (F.col("n") == k) | F.array_contains(F.split("n", "[-/@.:]"), k) | k.contains("/") & F.col("n").contains(k) | k.contains("-") & F.col("n").contains(k))), F.lit(False))
    a = names.agg(of(fixed.FRONTEND).alias("front"), of(fixed.BACKEND).alias("back")).first()
    package = contents.where("path = 'package.json'").agg(*[F.coalesce(F.bool_or(F.get_json_object("content", f"$.{k}").isNotNull()), F.lit(False)).alias(k) for k in ("bin", "main", "workspaces")]).first()
    data = F.col("path").rlike(r"(?i)\.(?:csv|tsv|parquet|jsonl|ndjson|arrow|feather|avro|orc|xlsx?)\z")
    b = sources.agg(
        F.coalesce(F.bool_or(path.isin(*fixed.MONOREPO_FILES) | path.rlike(rules.java(fixed.MONOREPO_PACKAGES))), F.lit(False)).alias("mono"), F.count_if(data).alias("data"), F.count_if((F.col("kind") == "source") & ~data).alias("code"), F.count_if(F.col("kind") == "docs").alias("docs")).first()
    cli = entries.where(path.rlike(r"(?i)^bin/|(?:^|/)(?:cli|__main__)\.\w+\z")).limit(1).count() > 0 or package.bin
    flags = {"cli": cli, "library": package.main and not package.bin, "web-app": a.front, "api-service": a.back, "monorepo": b.mono or package.workspaces, "data": b.data > b.code, "docs-only": b.code == 0 and b.docs > 0}
    return [k for k in fixed.PROJECT_KINDS if flags.get(k)]


def entry_points(contents: DataFrame) -> DataFrame:
    """path, kind and line of the places where a program begins: by name in the root, src or bin, and by what the text does."""
    path, text = F.col("path"), F.col("content")
    line = lambda p: F.size(F.split(F.regexp_extract(text, f"(?s)^(.*?){p}", 1), "\n"))
    by_text = [("python-main", "python", r"if __name__ == ['\"]__main__['\"]"), ("java-main", "java", r"public static void main\("), ("spring", "java", r"@SpringBootApplication"), ("go-main", "go", r"func main\(\)"), ("rust-main", "rust", r"fn main\(\)"), ("server", "javascript", r"\.listen\("), ("server", "typescript", r"\.listen\(")]
    found = [F.when((F.col("language") == lang) & text.rlike(p), F.struct(F.lit(k).alias("kind"), line(p).alias("line"))) for k, lang, p in by_text]
    named = F.when(path.rlike(r"(?i)^(?:src/|bin/|cmd/[^/]+/)?(?:index|main|app|server|cli|__main__)\.(?:js|mjs|cjs|ts|tsx|py|go|java|rs)\z"), F.struct(F.lit("name").alias("kind"), F.lit(1).alias("line")))
    return contents.select("path", F.explode(F.array_compact(F.array(named, *found))).alias("e")).select("path", "e.kind", "e.line").dropDuplicates(["path", "kind"])


def signals(contents: DataFrame) -> DataFrame:
    """path, line, kind of markers, debugging left over and hard-coded secrets; never what a secret is."""
    lines = contents.select("path", F.posexplode(F.split("content", "\n", -1)).alias("p", "text"))
    kind = (
        F.when(F.col("text").rlike(r"(?://|#|/\*|\*|--)\s*(?:TODO|FIXME|HACK|XXX)(?![A-Za-z])"), "todo").when(F.col("text").rlike(r"^\s*(?:console\.(?:log|debug)\(|debugger;|print\(['\"]debug|pdb\.set_trace\(|breakpoint\(\))"), "debug")
        .when(F.col("text").rlike(r"(?i)(?:password|passwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token|private[_-]?key)['\"]?\s*[:=]\s*['\"](?!\s*['\"])(?!.*(?:example|changeme|placeholder|your[_-]|xxx|\$\{|<))[^'\"\s]{8,}['\"]"), "secret"))
    return lines.withColumn("kind", kind).where("kind IS NOT NULL").select("path", (F.col("p") + 1).alias("line"), "kind")


def greedy_files(sources: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The files a reading budget takes, largest first."""
    from ..operators.records import greedy_budget

    return sources.join(greedy_budget(sources.where(F.col("sensitive").isNull() & (F.col("bytes") <= limits.file_bytes)), "path", "bytes", limits.total_bytes), "path", "left_semi")
