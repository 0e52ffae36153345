"""Parsing one file, and all files of a table. Nothing here raises on malformed source."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .languages import ENTRY_LIKE, LANGUAGES, NO_CALLS, Language
from .masks import closing, comments, indent, mask

#: How much of one file is kept.
MOST_SYMBOLS, MOST_CALLS, MOST_TODOS = 4000, 6000, 500
VERBS = "get post put patch delete head options all".split()
CONTROL = frozenset("if for while switch catch return function else do try new".split())
CALL = re.compile(r"(?<![\w$.])((?:[A-Za-z_$][\w$]*(?:\.|\?\.|::))*)([A-Za-z_$][\w$]*)[ \t]*\(")
JS_ROUTE = re.compile(r"(?<![\w$])(?:[A-Za-z_$][\w$]*\.)*([A-Za-z_$][\w$]*)\s*\.\s*(get|post|put|patch|delete|head|options|all)\(\s*(?=['\"`])")
#: What a route is declared on; other objects have methods of these names too.
ROUTED = re.compile(r"(?i)\w*(?:app|router|server|api|routes?)|fastify|koa\w*")
INLINE, LAST_NAME, NAME_PATH = re.compile(r"=>|\bfunction\b"), re.compile(r"[A-Za-z_$][\w$]*\Z"), re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*")
NEST_ROUTE = re.compile(r"@(Get|Post|Put|Patch|Delete|Head|Options|All)\(\s*(['\"`][^'\"`]*['\"`])?\s*\)")
NEST_PREFIX = re.compile(r"@Controller\(\s*(['\"`])([^'\"`]*)\1")
PY_ROUTE = re.compile(r"^[ \t]*@(\w+)\.(route|get|post|put|patch|delete|head|options|websocket|task)\b(?:\(\s*(?:[rf]?(['\"])([^'\"]*)\3)?([^\n]*))?", re.M)
DJANGO = re.compile(r"^[ \t]*(?:re_)?path\(\s*r?(['\"])([^'\"]*)\1\s*,\s*([\w.]+)", re.M)
JAVA_ROUTE = re.compile(r"@(Get|Post|Put|Patch|Delete|Request)Mapping(?:\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*(\"[^\"]*\")?([^)]*)\))?")
JAX_ROUTE = re.compile(r"@(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b")
JAX_PATH = re.compile(r"@Path\(\s*\"([^\"]*)\"")
TODO = re.compile(r"\b(TODO|FIXME|HACK|XXX|NOTE|BUG)\b[:\s-]*(.*)")
EXPORT_LIST = re.compile(r"\bexport\s*\{([^}]*)\}|module\.exports\s*=\s*\{([^}]*)\}")
ALL_LIST = re.compile(r"^__all__\s*=\s*[\[(]([^\])]*)[\])]", re.M)

SCHEMA = (
    "id string, language string, depth string, symbols array<struct<name:string,kind:string,line:int,endLine:int,exported:boolean,parent:string,signature:string,doc:string>>, "
    "imports array<struct<specifier:string,line:int,names:array<string>,kind:string>>, calls array<struct<callee:string,line:int,fromSymbol:string,receiver:string>>, "
    "routes array<struct<method:string,path:string,line:int,handler:string,framework:string,middlewares:array<string>>>, exports array<string>, todos array<struct<kind:string,line:int,text:string>>, notes array<string>"
)


def empty(language: str | None, note: str | None = None) -> dict:
    return {"language": language, "depth": "skipped", "symbols": [], "imports": [], "calls": [], "routes": [], "exports": [], "todos": [], "notes": [note] if note else []}


def parse(source: str | None, language: str | None) -> dict:
    """What one file holds. Unknown languages, data and malformed source give empty lists, and a note where something failed."""
    if source is None:
        return empty(language, "no content")
    spec = LANGUAGES.get(language or "")
    source = source.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if spec is None:
        return empty(language) | {"depth": "light", "todos": _todos(source, "hash")}
    try:
        return _parse(source, language, spec)
    except Exception as error:  # noqa: BLE001
        return empty(language, f"parse failed: {type(error).__name__}")


def _parse(source: str, language: str, spec: Language) -> dict:
    masked, lines = mask(source, spec.style), source.split("\n")
    starts = [0, *[m.end() for m in re.finditer("\n", source)]]
    line_of = lambda at: bisect.bisect_right(starts, at)
    symbols = _symbols(source, masked, lines, spec, line_of, language)
    exports = _exports(source, symbols, language)
    for s in symbols:
        s["exported"] = s["exported"] or s["name"] in exports
    routes, inline = _routes(source, masked, symbols, language, line_of)
    symbols = sorted([*symbols, *inline], key=lambda s: (s["line"], s["endLine"]))
    for r in routes:
        for s in symbols:
            if s["name"] == r["handler"] and s["kind"] in ("function", "method"):
                s["kind"] = "route-handler" if s["kind"] == "function" else s["kind"]
    owners = sorted((s for s in symbols if s["kind"] in ENTRY_LIKE), key=lambda s: (s["line"], -s["endLine"]))
    calls = _calls(masked, symbols, owners, line_of) if spec.calls else []
    return {"language": language, "depth": "deep" if spec.deep else "light", "symbols": symbols[:MOST_SYMBOLS], "imports": _imports(source, masked, spec, line_of), "calls": calls[:MOST_CALLS], "routes": routes, "exports": sorted(exports), "todos": _todos(source, spec.style), "notes": []}


def _symbols(source, masked, lines, spec, line_of, language) -> list[dict]:
    found: dict[int, dict] = {}
    masked_lines = masked.split("\n")
    for kind, pattern in spec.symbols:
        for m in pattern.finditer(masked):
            at = m.start("name")
            line, name = line_of(at), m.group("name").strip("\"`")
            if line in found or spec.blocks == "brace" and name in CONTROL:
                continue
            end = _end(masked, masked_lines, m, line, spec, line_of)
            head = lines[line - 1].strip()
            if kind == "variable" and spec.style == "c" and language != "java" and masked_lines[line - 1][:1].isspace():
                continue
            exported = bool(re.match(r"(?:export|public|pub)\b", head)) or language == "go" and name[:1].isupper()
            found[line] = {"name": name, "kind": kind, "line": line, "endLine": end, "exported": exported, "parent": None, "signature": head.rstrip("{").rstrip()[:300], "doc": _doc(lines, line, spec), "__indent": indent(lines[line - 1])}
    out = sorted(found.values(), key=lambda s: (s["line"], s["endLine"]))
    kept, stack = [], []
    for s in out:
        while stack and stack[-1]["endLine"] < s["line"]:
            stack.pop()
        above = stack[-1] if stack else None
        if above is not None:
            inside = above["kind"] in ENTRY_LIKE
            if inside and spec.blocks == "brace" and s["kind"] in ("method", "variable", "function"):
                continue  # locals of a body
            s["parent"] = above["name"]
            if above["kind"] in ("class", "interface") and s["kind"] == "function" and spec.blocks != "indent":
                s["kind"] = "method"
        elif s["kind"] == "method" and language in ("javascript", "typescript", "jsx", "tsx"):
            continue
        kept.append(s)
        if s["endLine"] > s["line"]:
            stack.append(s)
    for s in kept:
        if language in ("jsx", "tsx", "javascript", "typescript") and s["kind"] == "function" and s["name"][:1].isupper() and re.search(r"return\s*\(?\s*<[A-Za-z>]", "\n".join(lines[s["line"] - 1 : s["endLine"]])):
            s["kind"] = "component"
        s.pop("__indent")
    return kept


def _end(masked, masked_lines, m, line, spec, line_of) -> int:
    if spec.blocks == "indent":
        base, last = indent(masked_lines[line - 1]), line
        depth = 0
        for no in range(line - 1, len(masked_lines)):
            text = masked_lines[no]
            if no >= line and text.strip() and depth <= 0 and indent(text) <= base:
                break
            depth += sum(map(text.count, "([{")) - sum(map(text.count, ")]}"))
            if text.strip():
                last = no + 1
        return last
    if spec.blocks == "end":
        depth = 0
        for no in range(line - 1, len(masked_lines)):
            text = masked_lines[no]
            depth += len(re.findall(r"^\s*(?:class|module|def|if|unless|case|while|until|for|begin)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$", text)) - len(re.findall(r"^\s*end\b", text))
            if depth <= 0:
                return no + 1
        return len(masked_lines)
    if spec.blocks == "statement":
        semi = masked.find(";", m.end())
        return line_of(semi) if semi >= 0 else len(masked_lines)
    brace, semi = masked.find("{", m.end() - 1), masked.find(";", m.end())
    stop = masked.find("\n\n", m.end())
    if brace < 0 or (0 <= semi < brace) or (0 <= stop < brace):
        return line_of(min(x for x in (semi, stop, len(masked)) if x >= 0)) if 0 <= semi else line
    return line_of(min(closing(masked, brace), max(0, len(masked) - 1)))


def _doc(lines: list[str], line: int, spec: Language) -> str | None:
    """The comment right above a symbol, or the string at the top of its body."""
    if spec.blocks == "indent":
        body = "\n".join(lines[line - 1 : line + 40])
        m = re.search(r":\s*\n\s*[rbu]?(\"\"\"|''')(.*?)\1", body, re.S)
        if m and not re.search(r"\n\s*\w", body[: m.start()].split("\n", 1)[1] if "\n" in body[: m.start()] else ""):
            return m.group(2).strip()[:500] or None
    out, k = [], line - 2
    while k >= 0 and re.match(r"\s*@\w", lines[k]):
        k -= 1
    if k >= 0 and lines[k].rstrip().endswith("*/"):
        while k >= 0:
            out.append(re.sub(r"^\s*(?:/\*+|\*+/?)\s?|\s*\*/\s*$", "", lines[k]))
            if "/*" in lines[k]:
                break
            k -= 1
    else:
        mark = r"\s*#(?!!)" if spec.style in ("python", "hash") else r"\s*--" if spec.style == "sql" else r"\s*//"
        while k >= 0 and re.match(mark, lines[k]):
            out.append(re.sub(mark + r"[/!]?\s?", "", lines[k]))
            k -= 1
    return " ".join(x.strip() for x in reversed(out) if x.strip())[:500] or None


def _quoted(source: str, at: int) -> str | None:
    quote = {"<": ">"}.get(source[at], source[at])
    end = source.find(quote, at + 1)
    return source[at + 1 : end] if 0 <= end and "\n" not in source[at + 1 : end] else None


def _names(text: str | None) -> list[str]:
    names = []
    for part in re.split(r"[,\n]", re.sub(r"[{}()*]|\btype\b", " ", text or "")):
        words = part.split()
        if words and re.match(r"^[A-Za-z_$][\w$]*$", words[-1]):
            names.append(words[-1])
    return names


def _imports(source, masked, spec, line_of) -> list[dict]:
    out = []
    for pattern in spec.imports:
        for m in pattern.finditer(source):
            at = m.start() + len(m.group()) - len(m.group().lstrip())
            if not masked[at : at + 1].strip():
                continue  # stands in a comment or a string
            g, line = m.groupdict(), line_of(at)
            if g.get("many"):
                for part in g["many"].split(","):
                    words = part.split()
                    if words:
                        out.append({"specifier": words[0], "line": line, "names": [words[-1].split(".")[0]], "kind": "import"})
            elif g.get("group") is not None:
                for q in re.finditer(r"^[ \t]*(?:[\w.]+[ \t]+)?\"([^\"\n]+)\"", g["group"], re.M):
                    out.append({"specifier": q.group(1), "line": line_of(m.start("group") + q.start(1)), "names": [q.group(1).rsplit("/", 1)[-1]], "kind": "import"})
            else:
                value = _quoted(source, m.start("q")) if g.get("q") else g.get("spec")
                if value:
                    tail = re.split(r"[./:\\]+", value)[-1]
                    kind = "require" if "require" in m.group() else "dynamic" if re.search(r"import\(", m.group()) else "export" if m.group().lstrip().startswith("export") else "import"
                    out.append({"specifier": value, "line": line, "names": _names(g.get("names")) or ([tail] if g.get("spec") and tail not in ("", "*") else []), "kind": kind})
    seen, unique = set(), []
    for i in sorted(out, key=lambda i: (i["line"], i["specifier"])):
        if (i["specifier"], i["line"]) not in seen:
            seen.add((i["specifier"], i["line"]))
            unique.append(i)
    return unique


def _calls(masked, symbols, owners, line_of) -> list[dict]:
    defined = {(s["name"], s["line"]) for s in symbols}
    out = []
    for m in CALL.finditer(masked):
        name, line = m.group(2), line_of(m.start(2))
        before = masked[max(0, m.start() - 12) : m.start()]
        if name in NO_CALLS or (name, line) in defined or re.search(r"\b(?:function|def|func|fn|fun|class)\s*$", before) or masked[m.start() - 1 : m.start()] == "@":
            continue
        inside = [s for s in owners if s["line"] <= line <= s["endLine"]]
        owner = min(inside, key=lambda s: (s["endLine"] - s["line"], -s["line"]))["name"] if inside else None
        out.append({"callee": name, "line": line, "fromSymbol": owner, "receiver": re.sub(r"(?:\?\.|\.|::)$", "", m.group(1)) or None})
    return out


def _after(symbols, line: int, reach: int = 8) -> str | None:
    near = [s for s in symbols if line <= s["line"] <= line + reach and s["kind"] in ENTRY_LIKE]
    return min(near, key=lambda s: s["line"])["name"] if near else None


def _join(*parts: str) -> str:
    return "/" + "/".join(p.strip("/") for p in parts if p and p.strip("/"))


def _arguments(masked: str, start: int, end: int) -> list[tuple[int, int]]:
    """Where the arguments between two brackets begin and end; commas within brackets divide nothing."""
    out, depth, begin = [], 0, start
    for at in range(start, end):
        c = masked[at]
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0:
            out.append((begin, at))
            begin = at + 1
    return [*out, (begin, end)]


def _routes(source, masked, symbols, language, line_of) -> tuple[list[dict], list[dict]]:
    """The routes of a file, and a symbol for each handler that is written where the route is declared."""
    out, inline, taken = [], [], {s["name"] for s in symbols}

    def add(method, path, at, handler, framework, middlewares=()):
        out.append({"method": method.upper(), "path": path, "line": line_of(at), "handler": handler, "framework": framework, "middlewares": list(middlewares)})

    def promoted(method, path, a, b):
        name = f"{method.upper()} {path} handler"
        name = f"{name}@{line_of(a)}" if name in taken else name
        taken.add(name)
        begin = a + len(masked[a:b]) - len(masked[a:b].lstrip())
        brace = masked.find("{", INLINE.search(masked, begin, b).start(), b)
        end = closing(masked, brace) if brace >= 0 else b
        head = source[begin : brace if brace >= 0 else b].strip()
        inline.append({"name": name, "kind": "route-handler", "line": line_of(begin), "endLine": line_of(min(end, max(0, len(masked) - 1))), "exported": False, "parent": None, "signature": head[:300], "doc": None})
        return name

    if language in ("javascript", "typescript", "jsx", "tsx"):
        koa = re.search(r"['\"/](?:koa|@koa/router)['\"]", source)
        for m in JS_ROUTE.finditer(source):
            path = _quoted(source, m.end())
            if not masked[m.start(1)].strip() or not ROUTED.fullmatch(m.group(1)) or path is None or not (path.startswith("/") or path == "*"):
                continue
            bracket = masked.index("(", m.end(2))
            rest = _arguments(masked, bracket + 1, closing(masked, bracket, "()"))[1:]
            framework = "fastify" if m.group(1) == "fastify" else "koa" if koa or m.group(1).lower().startswith("koa") else "express"
            if not rest:
                continue
            a, b = rest[-1]
            if INLINE.search(masked, a, b):
                handler = promoted(m.group(2), path, a, b)
            else:
                named = NAME_PATH.fullmatch(masked[a:b].strip())
                handler = named.group().rsplit(".", 1)[-1] if named else None
            between = [LAST_NAME.search(masked[x:y].strip()) for x, y in rest[:-1]]
            add(m.group(2), path, m.start(1), handler, framework, [x.group() for x in between if x])
        prefix = NEST_PREFIX.search(source)
        for m in NEST_ROUTE.finditer(source):
            if masked[m.start()].strip():
                add(m.group(1), _join(prefix.group(2) if prefix else "", (m.group(2) or "''")[1:-1]), m.start(), _after(symbols, line_of(m.start())), "nest")
    elif language == "python":
        for m in PY_ROUTE.finditer(source):
            if masked[m.start() :].lstrip()[:1] != "@":
                continue
            line, verb, rest = line_of(m.start(1)), m.group(2), m.group(5) or ""
            handler = _after(symbols, line)
            if verb == "task":
                add("EVENT", handler or m.group(1), m.start(1), handler, "celery")
            elif m.group(4) is not None:
                for method in re.findall(r"['\"](\w+)['\"]", rest.split("methods", 1)[1]) if "methods" in rest else ["GET" if verb == "route" else verb]:
                    add(method, m.group(4), m.start(1), handler, "flask" if verb == "route" else "fastapi")
        for m in DJANGO.finditer(source):
            if masked[m.start() :].lstrip()[:1] in ("p", "r"):
                add("ANY", "/" + m.group(2), m.start(2), m.group(3).rsplit(".", 1)[-1], "django")
    elif language == "java":
        types = [s for s in symbols if s["kind"] in ("class", "interface")]
        first = types[0]["line"] if types else 0
        prefix = ""
        for m in JAVA_ROUTE.finditer(source):
            path, line = (m.group(2) or '""')[1:-1], line_of(m.start())
            if line <= first:
                prefix = path
                continue
            method = m.group(1) if m.group(1) != "Request" else (re.search(r"RequestMethod\.(\w+)", m.group(3) or "") or [None, "ANY"])[1]
            add(method, _join(prefix, path), m.start(), _after(symbols, line), "spring")
        paths = [(line_of(m.start()), m.group(1)) for m in JAX_PATH.finditer(source)]
        base = next((p for n, p in paths if n <= first), "")
        for m in JAX_ROUTE.finditer(source):
            line = line_of(m.start())
            own = next((p for n, p in paths if n > first and abs(n - line) <= 2), "")
            add(m.group(1), _join(base, own), m.start(), _after(symbols, line), "jax-rs")
    return sorted(out, key=lambda r: (r["line"], r["path"])), inline


def _exports(source, symbols, language) -> set[str]:
    names = {s["name"] for s in symbols if s["exported"] and s["parent"] is None}
    if language == "python" and (m := ALL_LIST.search(source)):
        names.update(re.findall(r"['\"](\w+)['\"]", m.group(1)))
    if language in ("javascript", "typescript", "jsx", "tsx", "vue", "svelte"):
        for m in EXPORT_LIST.finditer(source):
            names.update(_names(m.group(1) or re.sub(r":\s*[^,}]+", "", m.group(2) or "")))
    return names


def _todos(source: str, style: str) -> list[dict]:
    out = []
    for a, b in comments(source, style):
        first = source.count("\n", 0, a) + 1
        for k, text in enumerate(source[a:b].split("\n")):
            if (m := TODO.search(text[:4000])) and len(out) < MOST_TODOS:
                out.append({"kind": m.group(1), "line": first + k, "text": m.group(2).strip(" */")[:200]})
    return out


def parse_files(files: DataFrame) -> DataFrame:
    """One nested row per file (id, language, content): a map without shuffle. A file that fails keeps its row, with a note."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"id": i} | parse(c, lang) for i, lang, c in zip(batch["id"], batch["language"], batch["content"])]
            yield pd.DataFrame(rows, columns=["id", "language", "depth", "symbols", "imports", "calls", "routes", "exports", "todos", "notes"])

    return files.select("id", "language", "content").mapInPandas(run, SCHEMA)


def exploded(parsed: DataFrame) -> dict[str, DataFrame]:
    """The nested rows as tables symbols, imports, calls, routes and todos, with their ids."""
    from ..functions.text import module_of

    base = parsed.select(F.col("id").alias("fileId"), module_of(F.col("id")).alias("moduleId"), "symbols", "imports", "calls", "routes", "todos")
    take = lambda c: base.select("fileId", "moduleId", F.posexplode(c).alias("ordinal", "r")).select("fileId", "moduleId", "ordinal", "r.*")
    at = lambda name, mark: F.concat("fileId", F.lit(mark[0]), F.col(name), F.lit(mark[1]), F.col("line").cast("string"))
    return {
        "symbols": take("symbols").withColumn("id", at("name", "#@")),
        "imports": take("imports").withColumn("id", F.concat("fileId", F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("specifier"))),
        "calls": take("calls").withColumn("id", F.concat("fileId", F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("callee"), F.lit(":"), F.col("ordinal").cast("string"))),
        "routes": take("routes").withColumn("id", F.concat_ws(" ", "method", "path", F.concat(F.lit("["), F.col("fileId"), F.lit(":"), F.col("line").cast("string"), F.lit("]")))),
        "todos": take("todos"),
    }
