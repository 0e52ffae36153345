"""Reports of an analyzed tree: Markdown with diagrams, and one JSON file. Only limited rows reach the driver."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import graph, records

#: Rows each list shows.
ROWS, NODES, STEPS = 30, 24, 12


def cell(value) -> str:
    return str("" if value is None else value).replace("|", "\\|").replace("\n", " ")


def grid(heads: list[str], rows: list) -> str:
    if not rows:
        return "_none_\n"
    return "\n".join(["| " + " | ".join(heads) + " |", "|" + " --- |" * len(heads), *["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]]) + "\n"


def node(name: str) -> str:
    """A name that a diagram takes as an identifier."""
    return "n_" + re.sub(r"\W", "_", name)


def flow_chart(edges: DataFrame, limit: int = NODES) -> str:
    """The nodes with most edges and the edges among them."""
    keep = graph.degrees(edges).orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "id").limit(limit).select("id")
    kept = edges.join(keep.withColumnRenamed("id", "from"), "from", "left_semi").join(keep.withColumnRenamed("id", "to"), "to", "left_semi").orderBy("from", "to").limit(4 * limit).collect()
    lines = ["```mermaid", "flowchart LR"]
    for name in sorted({x for e in kept for x in (e["from"], e["to"])}):
        lines.append(f'  {node(name)}["{name.replace(chr(34), chr(39))}"]')
    lines += [f"  {node(e['from'])} -->|{e.weight}| {node(e['to'])}" for e in kept]
    return "\n".join([*lines, "```"]) + "\n"


def sequence(flows: DataFrame, symbols: DataFrame, limit: int = 3) -> str:
    """The longest flows as sequence diagrams."""
    longest = flows.groupBy("start").agg(F.max("step").alias("n")).orderBy(F.desc("n"), "start").limit(limit)
    steps = flows.join(longest.select("start"), "start", "left_semi").where(F.col("step") <= STEPS).join(symbols.select("id", "name", "fileId", "line"), "id", "left").orderBy("start", "step").collect()
    parts: dict[str, list] = {}
    for s in steps:
        parts.setdefault(s.start, []).append(s)
    out = []
    for start, rows in parts.items():
        lines = ["```mermaid", "sequenceDiagram"]
        for a, b in zip(rows, rows[1:]):
            lines.append(f"  {node(a.fileId or 'x')}->>{node(b.fileId or 'x')}: {cell(b.name)}")
        cites = [f"{r.fileId}:{r.line}" for r in rows if r.fileId]
        out.append("\n".join([f"### {start}", "", *lines, "```", "", "Evidence: " + ", ".join(cites), ""]))
    return "\n".join(out) or "_none_\n"


def risk_modules(t: dict[str, DataFrame], limit: int = 20) -> list:
    """The modules with the highest risk scores, by all rules."""
    kinds = records.mode_or_mixed(t["files"], "moduleId", "kind", ("test", "generated")).withColumnRenamed("moduleId", "id")
    roll = t["files"].groupBy(F.col("moduleId").alias("id")).agg(F.sum(F.coalesce("loc", F.lit(0))).alias("loc"), F.bool_or(F.col("kind") == "test").alias("has_test"))
    links = t["calls"].join(t["files"].select(F.col("id").alias("fileId"), F.col("moduleId").alias("__m")), "fileId").groupBy(F.col("__m").alias("id")).agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("resolution") == "unresolved").alias("unresolved"))
    rows = roll.join(kinds, "id", "left").join(links, "id", "left").fillna(0, ["links", "unresolved"])
    return graph.risk(rows, t["module_edges"], graph.components(t["module_edges"]), limit).collect()


def risks(t: dict[str, DataFrame], profile: dict, limit: int = 40) -> list[dict]:
    """What deserves a look, most severe first, each with its evidence: risky modules, cycles of files, gaps, sensitive files, secrets
    in the code, markers, calls that lead nowhere and weak flows."""
    found = [{"id": f"module:{m.id}", "severity": "high" if m.score >= 6 else "medium" if m.score >= 3 else "low", "title": f"module {m.id} scores {m.score} of 10: {', '.join(m.reasons)}", "evidence": [m.id]} for m in risk_modules(t)]
    found += [{"id": f"gap:{g['id']}", "severity": {"P0": "critical", "P1": "high", "P2": "medium"}.get(g["priority"], "low"), "title": g["id"].replace("-", " "), "evidence": []} for g in profile["gaps"]]
    for c in graph.cycles(t["edges"], 10).collect():
        found.append({"id": f"cycle:{c.component}", "severity": "medium", "title": f"import cycle of {c['size']} files", "evidence": list(c.members)[:6]})
    hidden = profile.get("sensitivePaths", [])
    if hidden:
        found.append({"id": "sensitive-files", "severity": "critical", "title": f"{profile['size']['sensitive']} sensitive files, none of them read", "evidence": hidden[:8]})
    for s in profile.get("secrets", [])[:10]:
        found.append({"id": f"secret:{s}", "severity": "high", "title": "looks like a credential in the code", "evidence": [s]})
    for s in t["symbols"].where("risk = 'high'").orderBy(F.desc("fanIn"), "id").limit(10).collect():
        found.append({"id": f"symbol:{s.id}", "severity": "medium", "title": f"{s['name']} has {s.fanIn} callers", "evidence": [f"{s.fileId}:{s.line}"]})
    marks = t["todos"].groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("fileId", "line")).alias("e")).orderBy("kind").collect()
    total = sum(k.n for k in marks)
    if total:
        found.append({"id": "todos", "severity": "medium" if total >= 50 else "low", "title": f"{total} markers: " + ", ".join(f"{k.n} {k.kind}" for k in marks), "evidence": [f"{k.e.fileId}:{k.e.line}" for k in marks]})
    calls = t["calls"].agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("resolution") == "unresolved").alias("bad")).first()
    if calls.n >= 20 and calls.bad / calls.n > 0.7:
        found.append({"id": "unresolved-calls", "severity": "medium", "title": f"{calls.bad} of {calls.n} calls lead to no known symbol", "evidence": []})
    weak = t["flows"].where("step = 1").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") == "low").alias("bad")).first()
    if weak.n and weak.bad / weak.n > 0.6:
        places = t["flows"].where("step = 1 AND confidence = 'low'").orderBy("start").limit(5).collect()
        found.append({"id": "weak-flows", "severity": "low", "title": f"{weak.bad} of {weak.n} flows break off early", "evidence": [p.evidence for p in places]})
    order = {"critical": 0, "high": 1, "medium": 2, "low": 3}
    return sorted(found, key=lambda r: (order[r["severity"]], r["id"]))[:limit]


def brief(t: dict[str, DataFrame], profile: dict, most: int = 14_000) -> str:
    """The facts in short, each with its place, for whoever may state nothing else; what does not fit is cut, and says so."""
    take = lambda df, n: df.limit(n).collect()
    modules = records.module_rollup(t["files"]).join(graph.degrees(t["module_edges"]).withColumnRenamed("id", "moduleId"), "moduleId", "left").fillna(0, ["fan_in", "fan_out"])
    counts = {n: t[n].count() for n in ("files", "symbols", "routes")}
    flows = t["flows"].groupBy("start", "name", "confidence").agg(F.sort_array(F.collect_list(F.struct("step", "evidence"))).alias("s"))
    parts = [
        ("Size", [f"{counts['files']} files, {counts['symbols']} symbols, {counts['routes']} routes; {', '.join(e['ecosystem'] for e in profile['ecosystems']) or 'no manifest'}"]),
        ("Entry points", [f"{e['path']}:{e['line']} ({e['kind']})" for e in profile["entrypoints"][:10]]),
        ("Modules", [f"{m.moduleId} | {m.kind} | {m.files} files | needs {m.fan_out} | needed by {m.fan_in}" for m in take(modules.orderBy(F.desc("loc"), "moduleId"), 30)]),
        ("Symbols", [f"{s.id} | {s.kind} | {'exported' if s.exported else 'internal'} | {s.fanIn} callers" for s in take(t["symbols"].orderBy(F.desc("fanIn"), "id"), 40)]),
        ("Routes", [f"{r.method} {r.path} | {r.fileId}:{r.line} | {r.framework}" for r in take(t["routes"].orderBy("path", "method", "id"), 30)]),
        ("Flows", [f"{f.name} | {f.confidence} | {' '.join(x.evidence or '' for x in f.s[:6])}" for f in take(flows.orderBy("start"), 10)]),
        ("Risky modules", [f"{m.id} | {m.score} | {', '.join(m.reasons)}" for m in risk_modules(t, 10)]),
        ("Gaps", [f"[{g['priority']}] {g['id']}" for g in profile["gaps"][:15]]),
    ]
    text = "\n".join(["# Facts", *[line for head, rows in parts for line in ("", f"## {head}", *[f"- {r}" for r in rows])], ""])
    return text if len(text) <= most else text[: max(0, most - 12)] + "\n(cut short)"


def reading_order(t: dict[str, DataFrame], profile: dict) -> list[str]:
    """Where to begin: documents, manifests, entry points, routes, the longest flows, the files most others need, the symbols most
    called, configuration that is read, tests."""
    docs = [r.id for r in t["files"].where("kind = 'docs'").orderBy(F.length("id"), "id").limit(3).collect()]
    manifests = [e["path"] for e in profile["ecosystems"]][:3]
    routes = [r.fileId for r in t["routes"].groupBy("fileId").count().orderBy(F.desc("count"), "fileId").limit(3).collect()]
    longest = t["flows"].groupBy("start").agg(F.max("step").alias("n"), F.min_by("evidence", "step").alias("e")).orderBy(F.desc("n"), "start").limit(3).collect()
    begun = [r.e.rsplit(":", 1)[0] for r in longest if r.e]
    hubs = [r.id for r in graph.hubs(t["files"].select("id"), t["edges"], 5).collect()]
    called = [r.fileId for r in t["symbols"].where("fanIn > 0").orderBy(F.desc("fanIn"), "id").limit(3).collect()]
    settings = [r.name for r in t["flows"].where("kind = 'data' AND step = 1").orderBy("name").limit(2).collect()]
    tests = [r.id for r in t["files"].where("kind = 'test'").orderBy("id").limit(2).collect()]
    return list(dict.fromkeys([*docs, *manifests, *[e["path"] for e in profile["entrypoints"]][:5], *routes, *begun, *hubs, *called, *settings, *tests]))


def layer_chart(t: dict[str, DataFrame]) -> str:
    """The layers of the tree as a diagram: the kinds of modules, how many, and the imports between them."""
    kinds = records.mode_or_mixed(t["files"], "moduleId", "kind", ("test", "generated")).withColumnRenamed("moduleId", "id")
    counts = {r.kind: r["count"] for r in kinds.groupBy("kind").count().collect()}
    side = lambda c: kinds.select(F.col("id").alias(c), F.col("kind").alias(f"{c}_kind"))
    links = t["module_edges"].join(side("from"), "from").join(side("to"), "to").where("from_kind != to_kind").groupBy("from_kind", "to_kind").agg(F.sum("weight").alias("w")).orderBy("from_kind", "to_kind").collect()
    lines = ["```mermaid", "flowchart TB", *[f'  {node(k)}["{k}: {n} modules"]' for k, n in sorted(counts.items())], *[f"  {node(r.from_kind)} -->|{r.w}| {node(r.to_kind)}" for r in links]]
    return "\n".join([*lines, "```"]) + "\n"


def shown(rows: list, total: int) -> str:
    """Says so where a list is shorter than what it lists."""
    return f"\n_{len(rows)} of {total} shown_\n" if len(rows) < total else ""


def roles(t: dict[str, DataFrame], profile: dict) -> dict[str, list[str]]:
    """Up to STEPS places for each kind of reader, all taken from the tables."""
    take = lambda df, c="id": [r[c] for r in df.limit(STEPS).collect()]
    return {
        "backend": take(t["routes"].where("method != 'EVENT'").orderBy("path", "id")), "frontend": take(t["symbols"].where("kind = 'component'").orderBy("id")), "test": take(t["files"].where("kind = 'test'").orderBy("id")),
        "devops": take(t["files"].where("kind IN ('infra', 'config')").orderBy("id")), "data": take(t["symbols"].where("kind IN ('table', 'view')").orderBy("id")),
    }


def render(t: dict[str, DataFrame], profile: dict) -> dict[str, str]:
    """File name to text: overview, architecture, flows, risks, reading guide and the whole as JSON."""
    rollup = records.module_rollup(t["files"]).orderBy(F.desc("loc"), "moduleId").limit(ROWS).collect()
    hubs = graph.hubs(t["files"].select("id", "moduleId"), t["edges"], ROWS).collect()
    orphans = [r.id for r in graph.orphans(t["files"].select("id", "kind"), t["edges"]).orderBy("id").limit(ROWS).collect()]
    routes = t["routes"].orderBy("path", "method", "id").limit(500).collect()
    found, order, readers = risks(t, profile), reading_order(t, profile), roles(t, profile)
    totals = {n: t[n].count() for n in ("files", "routes", "symbol_edges")} | {"modules": t["files"].select("moduleId").distinct().count()}
    nodes, among = graph.densest(t["symbol_edges"], NODES)
    busy = nodes.join(t["symbols"].select("id", "name", "fileId", "line"), "id").orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "id").collect()
    how = {r.resolution: r["count"] for r in t["calls"].groupBy("resolution").count().collect()}
    overview = "\n".join(["# Overview", "", f"{profile['size']['files']} files, {profile['size']['bytes']} bytes.", "", "## Languages", "", grid(["language", "files", "lines"], [(x["language"], x["files"], x["loc"]) for x in profile["languages"]]), "## Modules", "", grid(["module", "kind", "language", "files", "lines"], [(r.moduleId, r.kind, r.language, r.files, r.loc) for r in rollup]) + shown(rollup, totals["modules"]), "## Calls", "", grid(["resolution", "calls"], sorted(how.items()))])
    architecture = "\n".join(["# Architecture", "", "## Layers", "", layer_chart(t), "## Modules", "", flow_chart(t["module_edges"]), "## Files", "", flow_chart(t["edges"]), "## Most needed files", "", grid(["file", "importers", "imports"], [(h.id, h.fan_in, h.fan_out) for h in hubs]), "## Symbols", "", flow_chart(among), grid(["symbol", "place", "called by", "calls"], [(b["name"], f"{b.fileId}:{b.line}", b.fan_in, b.fan_out) for b in busy]), "## Files without links", "", *[f"- {o}" for o in orphans], ""])
    flows = "\n".join(["# Flows", "", "## Routes", "", grid(["method", "path", "handler", "before it", "place"], [(r.method, r.path, r.handler, ", ".join(r.middlewares or ()), f"{r.fileId}:{r.line}") for r in routes]) + shown(routes, totals["routes"]), "## Sequences", "", sequence(t["flows"], t["symbols"])])
    risk_text = "\n".join(["# Risks", "", grid(["severity", "what", "evidence"], [(r["severity"], r["title"], ", ".join(r["evidence"])) for r in found])])
    guide = "\n".join(["# Reading guide", "", *[f"{k}. {p}" for k, p in enumerate(order, 1)], "", *[line for role, steps in readers.items() for line in (f"## {role}", "", *[f"- {s}" for s in steps], "")]])
    whole = {"profile": profile, "modules": [r.asDict() for r in rollup], "hubs": [r.asDict() for r in hubs], "orphans": orphans, "routes": [r.asDict() for r in routes], "risks": found, "readingOrder": order, "symbols": [b.asDict() for b in busy], "totals": totals, "roles": readers, "calls": how}
    return {"overview.md": overview, "architecture.md": architecture, "flows.md": flows, "risks.md": risk_text, "guide.md": guide, "report.json": json.dumps(whole, indent=2, sort_keys=True, default=str)}
