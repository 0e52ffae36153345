"""The entry points over a source tree: scan, analyze, report, ask, update and status.

Tables are Parquet in a state folder; a run writes a new version beside the old one and then replaces one small file that names
it, so a reader sees either the one or the other.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixed
from .functions.text import content_hash, count_lines, module_of
from .operators import graph, records, retrieval
from .operators.flows import related
from .parse.parser import exploded, parse_files
from .session import stored
from .sources import scan as tree

VERSION = 1
#: Raised with each change of what the parser or the index gives for the same text; rows of another version are made anew.
PARSER, INDEX = 3, 1
TABLES = ("files", "symbols", "imports", "calls", "routes", "todos", "edges", "module_edges", "symbol_edges", "flows", "chunks", "index")

class Project:
    """A source tree with its state folder (by default `.sparklode` in the tree, which ignores itself)."""

    def __init__(self, spark: SparkSession, root: str, state: str | None = None, limits: tree.Limits = tree.Limits()):
        if not os.path.isdir(root):
            raise ValueError(f"{root} is no folder")
        self.spark, self.root, self.limits = spark, os.path.abspath(root), limits
        self.state = Path(state or os.path.join(self.root, ".sparklode"))

    # ---- state

    def _version(self) -> dict | None:
        try:
            held = json.loads((self.state / "state.json").read_text())
            return held if held.get("version") == VERSION else None
        except (OSError, ValueError):
            return None

    def _folder(self) -> Path:
        self.state.mkdir(parents=True, exist_ok=True)
        if not (self.state / ".gitignore").exists():
            (self.state / ".gitignore").write_text("*\n")
        return self.state

    def table(self, name: str) -> DataFrame | None:
        held = self._version()
        return self.spark.read.parquet(str(self.state / held["run"] / name)) if held and (self.state / held["run"] / name).exists() else None

    def _publish(self, run: str, summary: dict) -> None:
        staged = self._folder() / f".state-{uuid.uuid4().hex}"
        staged.write_text(json.dumps({"version": VERSION, "run": run, "parser": PARSER, "index": INDEX, "at": dt.datetime.now(dt.timezone.utc).isoformat(), "limits": asdict(self.limits), "summary": summary}, indent=2, sort_keys=True))
        os.replace(staged, self.state / "state.json")

    # ---- entry points

    def sources(self, include=(), exclude=()) -> DataFrame:
        return tree.scan(self.spark, self.root, include, exclude, self.limits)

    def scan(self, include=(), exclude=()) -> dict:
        listed = stored(self.sources(include, exclude))  # the profile asks many things of both; the tree is read once
        return tree.profile(listed, stored(tree.read(self.spark, self.root, listed, self.limits)))

    def analyze(self, include=(), exclude=(), reuse: bool = True) -> dict:
        """Reads, parses and links the tree. Files whose hash is that of the last run keep their parsed row; only the others are
        parsed again."""
        run = f"run-{uuid.uuid4().hex[:12]}"
        path = str(self._folder() / run)
        listed = stored(self.sources(include, exclude))
        contents = tree.read(self.spark, self.root, listed, self.limits).select(F.col("path").alias("id"), module_of(F.col("path")).alias("moduleId"), "language", "kind", "loc", "bytes", "hash", "content")
        contents.write.parquet(f"{path}/contents")
        contents = self.spark.read.parquet(f"{path}/contents")
        state = self._version() or {}
        old = self.table("parsed") if reuse and state.get("parser") == PARSER else None
        missed = contents
        if old is not None:
            key = ["id", "hash", "language"]
            missed = contents.join(old.select(key), key, "left_anti")
        fresh = parse_files(missed).join(missed.select("id", "hash"), "id")
        parsed = fresh if old is None else fresh.unionByName(old.join(contents.select("id", "hash", "language"), ["id", "hash", "language"], "left_semi"))
        parsed.write.parquet(f"{path}/parsed")
        parsed = self.spark.read.parquet(f"{path}/parsed")
        tables = link(contents.drop("content"), exploded(parsed))

        def keep(name: str, rows: DataFrame) -> None:
            rows.write.parquet(f"{path}/{name}")
            tables[name] = self.spark.read.parquet(f"{path}/{name}")

        for name in [n for n in TABLES if n in tables]:  # what follows reads the written tables, not their plans
            keep(name, tables[name])
        keep("chunks", chunk(contents, tables["symbols"]))
        before = self.table("index") if reuse and state.get("index") == INDEX else None
        keep("index", retrieval.update_index(before, tables["chunks"]))
        keep("flows", flows(tables, tree.entry_points(contents.withColumnRenamed("id", "path"))))
        before = self.table("files")
        delta = {r.state: r["count"] for r in (records.diff(before, tables["files"]) if before is not None else contents.select(F.lit("added").alias("state"))).groupBy("state").count().collect()}
        summary = {"files": contents.count(), "parsed": missed.count(), "diff": delta} | {n: self.spark.read.parquet(f"{path}/{n}").count() for n in ("symbols", "imports", "calls", "routes", "chunks", "flows")}
        self._publish(run, summary)
        return summary

    update = analyze

    def ask(self, question: str, limit: int = 8) -> dict:
        index = self.table("index")
        if index is None:
            raise ValueError("nothing is analyzed yet")
        reply = retrieval.answer(index, question, retrieval.Search(limit=limit))
        if reply["citations"]:
            hits = self.spark.createDataFrame([(c["path"], c["symbol"]) for c in reply["citations"]], "fileId string, symbolName string")
            symbols, flows = related(hits, self.table("symbols"), self.table("flows"))
            reply["relatedSymbols"], reply["relatedFlows"] = [r.asDict() for r in symbols.collect()], [r.asDict() for r in flows.collect()]
        with (self._folder() / "asked.jsonl").open("a") as log:
            log.write(json.dumps({"question": question, "confidence": reply["confidence"], "citations": len(reply["citations"])}) + "\n")
        return reply

    def report(self, output: str | None = None) -> dict[str, str]:
        from .report import render

        if self._version() is None:
            raise ValueError("nothing is analyzed yet")
        folder = Path(output or os.path.join(self.root, "sparklode-report"))
        folder.mkdir(parents=True, exist_ok=True)
        texts = render({n: self.table(n) for n in TABLES}, self.scan())
        for name, text in texts.items():
            (folder / name).write_text(text)
        return {name: str(folder / name) for name in texts}

    def brief(self, most: int = 14_000) -> str:
        """The facts of the analyzed tree in at most `most` characters."""
        from .report import brief

        if self._version() is None:
            raise ValueError("nothing is analyzed yet")
        return brief({n: self.table(n) for n in TABLES}, self.scan(), most)

    def status(self) -> dict:
        held = self._version()
        index = self.table("index")
        return ({} if index is None else {"index": retrieval.index_stats(index)}) | {"root": self.root, "analyzed": held is not None} | ({"at": held["at"], **held["summary"]} if held else {})


def link(files: DataFrame, t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The parsed tables joined into one graph: imports to files, calls to symbols, routes to handlers, and the edges."""
    symbols = stored(t["symbols"].dropDuplicates(["id"]))
    imports = t["imports"].dropDuplicates(["id"])
    resolved = records.resolve_imports(imports, files)
    imports = imports.join(resolved, "id", "left").withColumn("targetModule", module_of(F.col("target"))).withColumn("resolved", F.col("target").isNotNull())
    imports = stored(imports)
    bound = records.bind_names(imports, symbols)
    away = imports.where("external").select("fileId", F.explode("names").alias("name"))
    known = files.sparkSession.createDataFrame([(b,) for b in dict.fromkeys(fixed.BUILTINS)], "name string")
    calls = t["calls"].withColumn("callee", F.concat_ws(".", "receiver", "callee"))
    how = records.bind_calls(calls.select("id", "fileId", "callee"), symbols, bound, known, away)
    first = symbols.groupBy("fileId", F.col("name").alias("fromSymbol")).agg(F.min_by("id", "line").alias("from_symbol"))
    bodies = symbols.where(F.col("kind").isin(*records.FUNCTION_KINDS))
    around = records.innermost(calls.where("fromSymbol IS NULL").select("id", "fileId", F.col("line").alias("at")), bodies).withColumnRenamed("symbol", "__around")
    calls = calls.join(how, "id").join(first, ["fileId", "fromSymbol"], "left").join(around, "id", "left").withColumn("from_symbol", F.coalesce("from_symbol", "__around")).drop("__around")
    calls = stored(calls)  # symbols and their edges count them
    near = records.next_within(t["routes"].select("id", "fileId", F.col("line").alias("at")), bodies)
    named = records.unique_names(symbols).select("fileId", F.col("name").alias("handler"), F.col("symbol").alias("__named"))
    routes = t["routes"].join(named, ["fileId", "handler"], "left").join(near.withColumnRenamed("symbol", "__near"), "id", "left").withColumn("handlerId", F.coalesce("__named", "__near")).drop("__named", "__near")
    fan = graph.weighted_edges(calls.where("to_symbol IS NOT NULL AND from_symbol IS NOT NULL"), "from_symbol", "to_symbol")
    counts = calls.where("to_symbol IS NOT NULL").groupBy(F.col("to_symbol").alias("id")).agg(F.count(F.lit(1)).alias("fanIn"))
    out = calls.where("from_symbol IS NOT NULL").groupBy(F.col("from_symbol").alias("id")).agg(F.count(F.lit(1)).alias("fanOut"))
    symbols = symbols.join(counts, "id", "left").join(out, "id", "left").fillna(0, ["fanIn", "fanOut"])
    risk = F.when(F.col("fanIn") >= 12, "high").when(F.col("fanIn") >= 5, "medium").otherwise("low")
    return {
        "files": files, "symbols": symbols.withColumn("risk", risk), "imports": imports, "calls": calls, "routes": routes, "todos": t["todos"],
        "edges": graph.weighted_edges(imports, "fileId", "target"), "module_edges": graph.weighted_edges(imports, "moduleId", "targetModule"), "symbol_edges": fan,
    }


def flows(t: dict[str, DataFrame], entries: DataFrame) -> DataFrame:
    """The flows as a table of steps: start, kind, name, confidence, step, id, depth and evidence."""
    from .operators.flows import data_flows, detect

    found = detect(t["routes"], t["symbols"], t["calls"], entries, data=data_flows(t["files"], t["imports"], t["symbols"]))
    return found.select("start", "kind", "name", "confidence", F.explode("steps").alias("s")).select("start", "kind", "name", "confidence", F.col("s.order").alias("step"), "s.id", "s.depth", "s.evidence")


def chunk(contents: DataFrame, symbols: DataFrame, header: int = 40, most: int = 4000, shared: int = 200) -> DataFrame:
    """The chunks a search looks at: the head of each file, each symbol's lines, windows over documents and configuration.

    A text above `most` characters becomes several chunks that share `shared` characters, so nothing of it is lost to a search; chunks
    of one place and name are numbered from the second on.
    """
    lines = F.split("content", "\n", -1)
    cut = lambda a, b: F.array_join(F.slice(lines, a, F.greatest(b - a + 1, F.lit(0))), "\n")
    last = F.greatest(F.lit(1), F.least(count_lines(F.col("content")), F.lit(header)))
    base = ["fileId", "moduleId", "startLine", "endLine", "symbolId", "symbolName", "symbolKind", "kind", "text"]
    none = F.lit(None).cast("string")
    heads = contents.select(F.col("id").alias("fileId"), "moduleId", F.lit(1).alias("startLine"), last.cast("int").alias("endLine"), none.alias("symbolId"), none.alias("symbolName"), none.alias("symbolKind"), F.lit("file-header").alias("kind"), cut(F.lit(1), last).alias("text"))
    owned = symbols.select("fileId", F.col("id").alias("symbolId"), F.col("name").alias("symbolName"), F.col("kind").alias("symbolKind"), F.col("line").alias("startLine"), "endLine")
    code = contents.where(~F.col("kind").isin("docs", "config")).select(F.col("id").alias("fileId"), "moduleId", "content").join(owned, "fileId")
    code = code.withColumn("kind", F.lit("symbol")).withColumn("text", cut(F.col("startLine"), F.col("endLine")))
    whole = retrieval.windows(contents.where(F.col("kind").isin("docs", "config")), count_lines(F.col("content"))).withColumn("fileId", F.col("id"))
    whole = whole.withColumn("text", cut(F.col("startLine"), F.col("endLine"))).withColumn("kind", F.when(F.col("kind") == "docs", "doc").otherwise("config"))
    for c in ("symbolId", "symbolName", "symbolKind"):
        whole = whole.withColumn(c, none)
    rows = heads.select(base).unionByName(code.select(base)).unionByName(whole.select(base))
    size = F.length("text")
    begins = F.when(size <= most, F.array(F.lit(1))).otherwise(F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1)), F.lit(most - shared)), lambda a: (a == 1) | (a + shared <= size)))
    feeds = lambda text: F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    parts = rows.select("*", F.posexplode(begins).alias("__part", "__at")).withColumn("__first", F.col("startLine") + feeds(F.expr("substring(text, 1, __at - 1)")))
    parts = parts.withColumn("__text", F.when(size <= most, F.col("text")).otherwise(F.expr(f"substring(text, __at, {most})"))).withColumn("__last", F.when(size <= most, F.col("endLine")).otherwise(F.col("__first") + feeds(F.col("__text"))))
    parts = parts.select(*[c for c in base if c not in ("startLine", "endLine", "text")], F.col("__first").cast("int").alias("startLine"), F.col("__last").cast("int").alias("endLine"), F.col("__text").alias("text"))
    name = F.concat_ws(":", "fileId", F.col("startLine").cast("string"), F.concat("kind", F.when(F.col("symbolName").isNotNull(), F.concat(F.lit("#"), F.col("symbolName"))).otherwise("")))
    hashed = parts.withColumn("id", name).withColumn("hash", content_hash(F.col("text")))
    k = F.row_number().over(Window.partitionBy("id").orderBy("endLine", "symbolKind", "hash"))
    return hashed.withColumn("__k", k).withColumn("id", F.when(F.col("__k") == 1, F.col("id")).otherwise(F.concat("id", F.lit("#"), F.col("__k").cast("string")))).drop("__k").select(*base, "id", "hash")
