"""Which source files nobody wrote by hand: generated, compiled, minified, vendored files and data dumps in code syntax.

Layout decides first: maximum and mean line length, share of white space and of letters and digits, density of numeric literals,
share of lines that hold nothing but literals, and long encoded runs, each against a threshold of the file's language as its name
tells it (the recorded language and kind are unreliable). What has the layout of any other source is told by its header, by
markers that compilers and test tools leave, and by the place where dependencies and build results lie; `by` says which it was.
A header that says a person has taken the file over goes before all of these.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import newest_first

#: The statistics of one chunk; of a file all are sums but for the maxima `max_line` and `run` and the flags.
FLAGS = ("by_hand", "generated", "vendored", "compiled", "snapshot", "source_map", "lock")
SUMS = ("chars", "lines", "spaces", "alnum", "digits", "numbers", "data_chars", "data_lines", "coded")
MAXIMA = ("max_line", "run")
STATS = T.StructType([T.StructField(n, T.LongType()) for n in (*SUMS, *MAXIMA)] + [T.StructField(n, T.BooleanType()) for n in FLAGS])

#: Languages by extension.
LANGUAGES = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "java": "java", "go": "go", "css": "css", "json": "json", "yaml": "yaml", "yml": "yaml",
    "md": "markdown", "sql": "sql", "sh": "shell", "map": "map", "lock": "lock", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "php": "php", "rb": "ruby", "rs": "rust", "kt": "kotlin", "swift": "swift", "scala": "scala",
    "html": "html", "vue": "vue", "lua": "lua", "dart": "dart",
}
#: Fixed values, tuned per language: the longest line and the mean line above which a source is minified, the least share of white
#: space, and the share of literal characters and literal lines above which it is a data dump. OTHER holds for all other code.
LIMITS = {"javascript": (1000, 220, 0.08, 0.33, 0.3), "typescript": (1000, 220, 0.08, 0.33, 0.3), "css": (2000, 300, 0.06, 0.9, 0.9), "python": (1500, 250, 0.08, 0.4, 0.4), "java": (1500, 250, 0.08, 0.4, 0.4), "go": (1500, 250, 0.06, 0.4, 0.4)}
OTHER = (2000, 300, 0.06, 0.5, 0.5)
#: Languages of data and prose, which no rule for code holds for; in the first two a mean line above DIGESTS[0] with a
#: share of encoded runs above DIGESTS[1] is a list of digests, in the third a line above ONE_LINE with hardly a space is a map.
DATA_LANGUAGES = ("json", "yaml", "map", "lock", "markdown")
DIGESTS, ONE_LINE = (70, 0.3), 1000
#: Files that tools write, by name and place.
TOOL_NAME = r"(?i)(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|poetry\.lock|pipfile\.lock|composer\.lock|cargo\.lock|gemfile\.lock|go\.sum|gradle\.lockfile|packages\.lock\.json|bun\.lockb?|uv\.lock|mix\.lock|podfile\.lock|flake\.lock)\z|\.(?:js|css|ts|mjs)\.map\z|\.(?:min|bundle|chunk)\.(?:js|css|mjs)\z|\.snap(?:\.[jt]s)?\z|\.pb\.(?:go|cc|h)\z|_pb2(?:_grpc)?\.pyi?\z|\.g\.(?:cs|dart)\z|\.designer\.cs\z|/__snapshots__/"
BUILT_PLACE = r"/(?:src/|build/|target/)?(?:__generated__|generated)(?:-sources)?/"
VENDOR_PLACE = r"(?:^|/)(?:vendor|vendors|third[_-]?party|thirdparty|node_modules|bower_components|Pods|Carthage|site-packages|external|deps)/[^/]+/"
INSERTS = re.compile(r"(?i)^\s*insert\s+into\s+[\w.\"`]+\s*(?:\([^()]*\))?\s*values?\b")

HEAD = re.compile(r"^\s*(?://[/!]?|#!?|/?\*+!?|<!--|--|;+|\"\"\"|''')\s?(.*?)\s*(?:\*/|-->|\"\"\")?\s*$")
MARK, CLOSINGS = re.compile(r"//[/!]?|#!?|/?\*+!?|<!--|--|;+|\"\"\"|'''"), {"/*": "*/", "<!--": "-->"}
ABOUT = re.compile(r"^(?:file|module|kind|lines|exports|signature|doc|symbol):\s|^\S+:\d+ (?:\w[\w-]*) ")
#: What a person's header says, what a generator's says (in several languages), and what a vendored copy's says.
BY_HAND = re.compile(r"(?i)\b(?:(?:re)?written|maintained|edited|kept|adapted|curated) by (?:hand|us|people|a person)|\bby hand (?:since|afterwards|now|from)|hand[- ](?:written|maintained|edited (?:since|after))|\bour own (?:rewrite|code|version)|no longer generated|safe to edit|used to be (?:generated|vendored)|(?:vendored|generated|upstream) (?:copy|version|file) (?:is|was) (?:gone|removed|dropped)|forked .* and (?:rewritten|maintained)")
TALK = re.compile(r"(?i)^(?:\"|'|`|reads|detects|matches|finds|checks|helpers?|scans|parses|looks|thin|wraps?|adapter|strips|skips|warns|lists|emits|writes|tests?|runs?|see|if|when|note|how|we|do not edit the|don't edit the|todo|fixme)\b|^[\"'`]|(?:headers?|files?|ones|comments?|lines?) (?:such as|that|marked|like|which|we)|template method|method stub|ide template")
GENERATED = re.compile(
    r"(?i)^(?:.{0,40}\b)?(?:auto(?:matic(?:ally)?)?[- ]?generated|machine[- ](?:generated|made|written)|code generated\b|@generated\b|<auto-?generated|autogen(?:erated)?\b|generated (?:by|from|on|with|using|at|code|file|source|client|automatically)|(?:was|is|been|were) (?:auto)?generated|produced by|created by \S+.{0,40}(?:from|see the)|emitted by|rewritten by the|built by|compiled from|transpiled|exported by|output of|written by (?:the |a )?\S*(?:tool|script|generator|compiler|export)"
    r"|(?:all |any )?(?:manual |hand )?(?:changes?|edits?)\b.{0,40}\b(?:lost|overwritten|discarded|not survive)|do not (?:edit|modify|change|touch)\b(?! the)|don't edit\b(?! the)|regenerate with|edit the \S+ (?:source )?instead|source:.*\btool:"
    r"|automatisch (?:erzeugt|generiert|erstellt)|maschinell (?:erzeugt|erstellt|generiert)|nicht (?:bearbeiten|ändern|editieren)|automáticamente|autom[aá]ticamente|no lo edite|no (?:editar|modificar)|généré|ne pas modifier|automatiquement|gerado automaticamente|自动生成|自動生成|自动创建|由工具|请勿(?:手动)?(?:修改|编辑)|編集しないで|сгенерирован)")
VENDORED = re.compile(r"(?i)^(?:vendored from\b|imported verbatim|verbatim copy|copied (?:unchanged|verbatim) from|upstream copy|taken unchanged from|third[- ]party copy|bundled copy of|mirror of .*upstream|@license\b|@preserve\b|\S+ v?\d+\.\d+(?:\.\d+)*\b.*\|.*(?:\(c\)|©|copyright|licen[cs]e)|\(c\) the (?!project)[\w.-]+ (?:authors|contributors)|do not modify.*upstream|local (?:edits|changes) are not accepted)")
COMPILED = re.compile(r"__esModule|webpackJsonp|__webpack_require__|\(this && this\.__\w+\)|System\.register\(\[|^!function\(|^\(function\(\w?(?:,\w)*\)\{\"use strict\"", re.M)
SNAPSHOT = re.compile(r"^exports\[`", re.M)
SOURCE_MAP = re.compile(r"^\s*\{\s*\"version\"\s*:\s*3\s*,.*\"(?:mappings|sources)\"", re.S)
LOCK, LOCKED = re.compile(r"^\W*lockfileVersion|^# yarn lockfile", re.M), re.compile(r"\bintegrity\W{1,5}sha\d+-|--hash=sha256:")
NUMBER = re.compile(r"(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F]+|\d+\.?\d*(?:[eE][-+]?\d+)?)(?![\w.])")
LITERAL = re.compile(r"\"[^\"\\]*(?:\\.[^\"\\]*)*\"|'[^'\\]*(?:\\.[^'\\]*)*'|0[xX][0-9a-fA-F]+|\d[\w.]*|\b(?:null|true|false|None|True|False|nil)\b")
RUN, LONG = re.compile(r"[A-Za-z0-9+/=_\-]{32,}"), 60
OPENS_DATA, SEPARATORS = tuple("0123456789-+.\"'[({nNiI"), dict.fromkeys(map(ord, " \t\r,;:+-.[](){}"))
_NO_DIGITS = dict.fromkeys(map(ord, "0123456789"))
_SPACES, _DIGITS = b" \t\r\n\f\v", b"0123456789"
_ALNUM = bytes(b for b in range(256) if chr(b).isascii() and chr(b).isalnum()) + bytes(range(128, 256))


def _only_literals(line: str) -> bool:
    """Whether a line holds literals and nothing but what separates them, or inserts nothing else."""
    rest, found = LITERAL.subn("", INSERTS.sub("", line))
    return found > 0 and not rest.translate(SEPARATORS)


def _header(lines: list[str]) -> Iterator[str]:
    """The words of each comment line in front of the first line of code, however many and long they are. A block comment goes on to
    its end, and what follows that on the same line is a comment or code in turn."""
    closing = ""
    for line in lines:
        rest = line.strip()
        while rest:
            if not closing:
                if not (m := MARK.match(rest)):
                    return
                closing = next((c for o, c in CLOSINGS.items() if rest.startswith(o)), "")
                rest = rest[2 if closing == "*/" else m.end() :]
            words, ended, rest = rest.partition(closing) if closing else (rest, "", "")
            if ended or not closing:
                closing, rest = "", rest.strip()
            for end in ("*/", "-->", '"""'):
                if words.endswith(end):
                    words = words.removesuffix(end)
                    break
            yield words.strip().lstrip("*!/# ")


def measure(text: str | None) -> dict:
    """The layout statistics and marks of one chunk's text; zeros for a null or empty one. The comment lines about the chunk in
    front of its text are left out."""
    zero = dict.fromkeys((*SUMS, *MAXIMA), 0) | dict.fromkeys(FLAGS, False)
    if not text:
        return zero
    lines = text.split("\n")
    begin = 0
    while begin < min(5, len(lines)) and (m := HEAD.match(lines[begin])) and ABOUT.match(m.group(1)):
        begin += 1
    lines = lines[begin:]
    body = "\n".join(lines)
    raw = body.encode("utf-8", "replace")
    marks = {"by_hand": False, "generated": False, "vendored": False}
    for words in _header(lines):
        if BY_HAND.search(words):
            marks["by_hand"] = True
        elif TALK.search(words) or ABOUT.match(words):
            continue
        elif GENERATED.search(words):
            marks["generated"] = True
        elif VENDORED.search(words):
            marks["vendored"] = True
    runs = RUN.findall(body)
    literal = [len(line) for line in lines if line.lstrip()[:1] in OPENS_DATA and _only_literals(line)]
    return {
        "chars": len(body), "lines": len(lines), "spaces": len(raw) - len(raw.translate(None, _SPACES)), "alnum": len(raw) - len(raw.translate(None, _ALNUM)),
        "digits": len(raw) - len(raw.translate(None, _DIGITS)), "numbers": len(NUMBER.findall(body)), "data_chars": sum(literal), "data_lines": len(literal),
        "max_line": max(map(len, lines), default=0), "run": max((len(r) for r in runs if len(r) >= LONG), default=0), **marks,
        "coded": sum(len(r) for r in runs if len(r) - len(r.translate(_NO_DIGITS)) >= 4),
        "compiled": bool(COMPILED.search(body)), "snapshot": bool(SNAPSHOT.search(body)), "source_map": bool(SOURCE_MAP.match(body)), "lock": bool(LOCK.search(body)) or len(LOCKED.findall(body)) > 2,
    }


@F.pandas_udf(STATS)
def measured(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=STATS.names)


def language_of(path: Column) -> Column:
    """The language of a path by its extension, null for others."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1))
    return F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[extension]


def file_statistics(chunks: DataFrame, key: str = "id", at: str = "seenAt") -> DataFrame:
    """One row per fileId with the statistics of its current chunks. Texts are measured where they are read; the shuffles carry a
    dozen numbers a chunk."""
    rows = chunks.where(F.col(key).isNotNull() & F.col("fileId").isNotNull())
    rows = rows.select(key, F.struct("fileId", F.coalesce("startLine", F.lit(1)).alias("line"), "kind").alias("of"), newest_first(at).alias("__at"), measured(F.col("text")).alias("s"))
    now = rows.groupBy(key).agg(F.max_by(F.struct("of", "s"), "__at").alias("r")).select("r.of.*", "r.s.*")
    # a header may only speak for the file where the file begins
    first = (F.col("line") <= 1) | (F.col("kind") != "symbol")
    flags = [F.max(F.col(f) & (first if f in ("by_hand", "generated", "vendored") else F.lit(True))).alias(f) for f in FLAGS]
    return now.groupBy("fileId").agg(*[F.sum(c).alias(c) for c in SUMS], *[F.max(c).alias(c) for c in MAXIMA], *flags)


def classify(files: DataFrame, chunks: DataFrame, key: str = "id", at: str = "scannedAt") -> DataFrame:
    """Each current file with language (by name), why, by and the statistics; why and by are null for hand-written ones.

    why: lock, source map, snapshot, minified, compiled, generated, vendored, data; by: layout, mark (a compiler's or a test tool's),
    header, or name. A file without chunks is judged by its path alone; null kind and language don't matter, nor do chunks whose
    file is not listed; copies and outdated rows count once; an empty table gives an empty one; rows with a null id are left
    out. Joined on the unique file id after both sides are one row a file.
    """
    # distinct ids are the current rows, as nothing else of a file's row is trusted
    paths = files.where(F.col(key).isNotNull()).select(key).distinct()
    stats = file_statistics(chunks).withColumnRenamed("fileId", "__file")
    rows = paths.join(stats, F.col(key) == F.col("__file"), "left").drop("__file").withColumn("language", language_of(F.col(key)))
    limit = lambda k: F.coalesce(F.create_map(*[F.lit(x) for name, v in LIMITS.items() for x in (name, float(v[k]))])[F.col("language")], F.lit(float(OTHER[k])))
    of = lambda a: F.col(a) / F.greatest(F.col("chars"), F.lit(1))
    is_ = lambda *names: F.coalesce(F.col("language").isin(*names), F.lit(False))
    code, name, mean, rows_of_data = ~is_(*DATA_LANGUAGES), F.col(key), F.col("chars") / F.greatest("lines", F.lit(1)), F.col("data_lines") / F.greatest("lines", F.lit(1))
    tight = (mean > limit(1)) | (of("spaces") < limit(2)) & (F.col("max_line") > 300)
    minified = code & (F.col("max_line") > limit(0)) & tight & (of("alnum") < 0.9)
    listed = (of("data_chars") > 0.6) | (rows_of_data > limit(4)) & (F.col("data_lines") >= 8) & (of("data_chars") > limit(3))
    data = code & (F.col("chars") > 200) & (listed | (F.col("numbers") > 60) & (of("digits") > 0.3) | (F.col("run") > 1000) & (of("spaces") < 0.05))
    digests = is_("json", "yaml", "lock") & (mean > DIGESTS[0]) & (of("coded") > DIGESTS[1])
    mapped = is_("map") & (F.col("max_line") > ONE_LINE) & (of("spaces") < 0.05)
    written = lambda why, by: F.struct(F.lit(why).alias("why"), F.lit(by).alias("by"))
    verdict = (
        F.when(F.coalesce("by_hand", F.lit(False)), None)
        .when(digests, written("lock", "layout")).when(mapped, written("source map", "layout")).when(minified, written("minified", "layout"))
        .when(data & F.col("snapshot"), written("snapshot", "layout")).when(data, written("data", "layout"))
        .when(F.col("lock") & ~code & ~is_("markdown"), written("lock", "mark")).when(F.col("source_map"), written("source map", "mark")).when(F.col("snapshot"), written("snapshot", "mark")).when(F.col("compiled") & code, written("compiled", "mark"))
        .when(F.col("generated") & ~is_("markdown"), written("generated", "header")).when(F.col("vendored"), written("vendored", "header"))
        .when(name.rlike(r"(?i)(?:lock\.(?:json|ya?ml)|\.lock|/go\.sum|shrinkwrap\.json)\z") & name.rlike(TOOL_NAME), written("lock", "name")).when(name.rlike(r"\.map\z"), written("source map", "name"))
        .when(name.rlike(r"\.snap(?:\.[jt]s)?\z|/__snapshots__/"), written("snapshot", "name")).when(name.rlike(r"(?i)\.min\.(?:js|css|mjs)\z"), written("minified", "name")).when(name.rlike(r"(?i)\.(?:bundle|chunk)\.(?:js|css|mjs)\z"), written("compiled", "name"))
        .when(name.rlike(TOOL_NAME) | name.rlike(BUILT_PLACE), written("generated", "name")).when(name.rlike(VENDOR_PLACE), written("vendored", "name"))
    )
    return rows.withColumn("__v", verdict).select("*", "__v.why", "__v.by").drop("__v")
