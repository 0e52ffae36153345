"""Functions and methods paired with their documentation.

A table of qualified symbols (module, parent, name and normalised signature) over all files joins a documented declaration with
definitions elsewhere that have no documentation of their own; parameter types or, where the language has none, the number of
parameters keep overloads apart. What is left of a doc after tags, markers, notices, code and fillers must say something that
name, parameters and signature do not.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

#: Words that carry no meaning of their own in a doc.
EMPTY_WORDS = frozenset("a an the this that these those it its is are was were be been will would shall should can could may might must do does did of for to in on at by with from into as and or not no if then than when while so such also just only please use used uses using via per each any all some one function func method procedure routine helper helpers utility util class object instance implementation implements implement internal private public protected static async type types value values result results return returns returned param params parameter parameters argument arguments arg args input output given specified current new default main simple basic handle handles handling perform performs do execute executes executed run runs call calls called process processes make makes get gets set sets void null none undefined true false promise string number boolean int integer long float double bool error errors exception throws throw raises raise see description summary name names part n o details detail safely safe_ batch summary_ logic code stub generated auto".split()) - {"safely"}
#: Texts that stand in for a doc, in whole.
FILLERS = frozenset(re.sub(r"[^\w一-鿿]+", " ", s).strip() for s in (
    "n/a", "na", "none", "nil", "null", "tbd", "tba", "wip", "todo", "fixme", "doc", "docs", "doc here", "documentation", "undocumented", "description", "add description", "add description here", "description here", "see above", "see below", "see code", "see source", "as above", "same as above", "ditto", "foo", "bar", "foo bar", "foobar", "test", "dummy", "placeholder", "lorem ipsum", "asdf", "xxx", "constructor", "destructor", "getter", "setter", "empty", "no description", "no docs", "not documented", "self explanatory", "self-explanatory", "obvious", "comment", "comments", "write me", "fill me in", "internal", "private", "deprecated", "helpers", "unused", "non-javadoc", "inheritdoc", "auto-generated method stub", "generated by ide template", "method stub",
    "无", "暂无", "待补充", "待完善", "待定", "同上", "略", "空", "说明", "描述", "注释", "未完成", "未知", "测试", "なし", "未定", "keine", "keine beschreibung", "siehe oben", "offen", "sin descripción", "ninguno", "pendiente", "aucune", "aucun", "à faire", "voir ci-dessus"))
DROPPED_TAG = re.compile(r"(?i)^[@\\](?:author|authors|since|version|see|link|private|public|protected|internal|ignore|inheritdoc|hide|api|module|class|function|func|method|name|memberof|static|async|override|readonly|generated|todo|copyright|license|package|category|group|example|type|date|created)\b.*$")
PARAM_TAG = re.compile(r"(?i)^(?:[@\\](?:param|arg|argument|prop|property|tparam|typeparam)\b|:(?:param|parameter|arg|argument|key|keyword|type)\b)\s*(?:\{[^}]*\})?\s*(?:\w+\s+(?=\w+:))?\[?([\w.$*&]*)\]?:?\s*[-–:]?\s*(.*)$")
OTHER_TAG = re.compile(r"(?i)^(?:[@\\](?:returns?|throws?|exception|raises?|deprecated|yields?|remarks?|summary|brief|details|note|warning|default|callback|template)\b|:(?:returns?|rtype|raises?|except|yields?)\b)\s*(?:\{[^}]*\})?\s*(.*)$")
RAISED = re.compile(r"^[A-Z]\w*(?:Error|Exception)?:?\s*")
SECTION = re.compile(r"(?i)^(?:args|arguments|parameters|params|returns?|raises|throws|yields|examples?|notes?|attributes|see also|usage)\s*:\s*$")
SECTION_ITEM = re.compile(r"^(\w+)(?:\s*\([^)]*\))?\s*:\s+(.*)$")
MARKER = re.compile(r"(?i)\b(?:todo|fixme|xxx|hack|tbd|wip|bug)\b(?:\([^)]*\))?\s*[:\-]?[^.。!?\n]*[.。!?]?")
DIRECTIVE = re.compile(r"(?i)^\W*(?:eslint\b|eslint-|tslint|jshint|prettier|istanbul|noqa|nolint|noinspection|pylint|pragma|type:\s*ignore|mypy:|flake8|ts-(?:ignore|expect|nocheck)|@ts-|#?(?:end)?region\b|webpackchunk|c8 ignore|v8 ignore|coverage|clang-|nosonar|checkstyle|suppress|fmt:|yapf|isort)")
NOTICE = re.compile(r"(?i)copyright|\(c\)|©|all rights reserved|licen[cs]ed? (?:under|to|terms)|released under|spdx-|do not edit|auto-?generated|generated (?:by|from|with|code)|\(non-javadoc\)|proprietary|confidential")
CODE = re.compile(r"^(?:(?:return|const|let|var|if|for|while|import|from|def|func|function|class|public|private|await|print|raise|throw)\b.*[;{}():]\s*$|[\w.$]+\s*(?:[-+*/]?=|:=)\s*.*;?\s*$|[\w.$]+\([^)]*\);?\s*$|.*;\s*$|[{}()\[\];]+$|</?\w+[^>]*>$)")
DATE = re.compile(r"^\W*\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\W*$")
WORD = re.compile(r"[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ'’]*")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
ESCAPES = re.compile(r"&\w+;|<[^>]{1,80}>|\{@\w+\s*|[`*_~]{1,3}")


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """A word less its plain English ending, so that `serializes`, `serialized` and `serialize` meet."""
    w = word.lower().replace("'", "").replace("’", "")
    for end in ("ations", "ation", "ings", "ing", "ies", "ied", "ers", "ors", "ed", "es", "er", "or", "s", "e", "y"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def said_by(name: str | None, signature: str | None) -> set[str]:
    """The stems of the words in name and signature, also of neighbouring parts written as one."""
    stems = set()
    for text in (name or "", signature or ""):
        for identifier in re.findall(r"[A-Za-z_$][\w$]*", text):
            parts = [p.lower() for p in PART.findall(identifier)]
            stems.update(map(stem, parts))
            stems.add(stem("".join(parts)))
            stems.update(stem(a + b) for a, b in zip(parts, parts[1:]))
    return stems


def essence(doc: str | None) -> str:
    """What a doc says in words of its own: without comment marks, tags, parameter names, markers, notices, directives and code."""
    kept, section = [], ""
    for raw in (doc or "").replace("\r", "").split("\n"):
        line = re.sub(r"^\s*(?:/\*+|\*+/?|//+|#+|--|\"\"\"|''')\s*|\s*\*/\s*$", "", raw).strip().strip("*").strip()
        line = re.sub(r"(?i)^(?:\**note\**|\**warning\**|hinweis|注意)\s*[:：]\**\s*", "", line)
        plain = re.sub(r"^\{(.*)\}$", r"\1", line)
        if not line or DROPPED_TAG.match(plain) or DIRECTIVE.match(line) or NOTICE.search(line) or DATE.match(line):
            continue
        if SECTION.match(line):
            section = line.lower()
            continue
        if m := PARAM_TAG.match(line):
            line = m.group(2)
        elif m := OTHER_TAG.match(line):
            line = RAISED.sub("", m.group(1)) if re.match(r"(?i)^[@\\:](?:throws?|exception|raises?|except)", line) else m.group(1)
        elif section and (m := SECTION_ITEM.match(line)):
            line = m.group(2)
        line = MARKER.sub(" ", ESCAPES.sub(" ", line)).strip()
        if line and not CODE.match(line):
            kept.append(line)
    return " ".join(kept).strip()


_remembered = lru_cache(maxsize=50_000)(essence)


def informative(name: str | None, signature: str | None, doc: str | None, least: int = 2) -> bool:
    """Whether `doc` tells something that name, parameters and signature do not: at least `least` different words that neither
    occur there nor are empty, or five characters of a script without word gaps. Null, blank and trivial docs tell nothing."""
    text = _remembered(doc) if doc and len(doc) < 1000 else essence(doc)
    if not text or re.sub(r"[^\w一-鿿]+", " ", text).strip().lower() in FILLERS:
        return False
    if len(WIDE.findall(text)) >= 5:
        return True
    known = said_by(name, signature)
    told = set()
    for word in WORD.findall(text):
        stems = {stem(p) for p in PART.findall(word)} | {stem(word)}
        if len(word) > 1 and word.lower() not in EMPTY_WORDS and not stems & known and not stems <= EMPTY_WORDS:
            told.add(stem(word))
    return len(told) >= least


@F.pandas_udf(T.BooleanType())
def tells_something(name: pd.Series, signature: pd.Series, doc: pd.Series) -> pd.Series:
    return pd.Series([d is not None and informative(n, s, d) for n, s, d in zip(name, signature, doc)], dtype=bool)


def is_function(kind: Column, signature: Column, name: Column) -> Column:
    """By kind regardless of letter case and outer blanks; where kind is null or blank by a signature that declares a call."""
    stated = F.nullif(F.lower(F.trim(kind)), F.lit(""))
    head = r"(?i)^\s*(?:export\s+|default\s+|abstract\s+|public\s+|private\s+|protected\s+|internal\s+)*(?:class|interface|enum|struct|record|trait|type|namespace|module|package)\b"
    looks = F.coalesce(signature.rlike(r"\(") & ~signature.rlike(head), F.lit(False))
    return F.when(stated.isNull(), looks).otherwise(stated.isin("function", "method"))


def normal_signature(signature: Column) -> Column:
    """What tells overloads apart, the same for a declaration and its definition: the types of the parameters where they are
    written (after a colon or before the name), else how many there are; without names, defaults, modifiers and white space."""
    inner = F.regexp_extract(signature, r"(?s)\(((?:[^()]|\([^()]*\))*)\)", 1)
    parts = F.filter(F.transform(F.split(inner, r",(?![^<\[{(]*[>\]})])"), lambda p: F.trim(F.regexp_replace(p, r"(?s)=.*", ""))), lambda p: ~p.isin("", "self", "this", "cls", "*", "/"))
    typed = F.transform(parts, lambda p: F.when(p.contains(":"), F.regexp_extract(p, r"(?s):\s*(.*)", 1)).when(p.rlike(r"\S\s+\S"), F.regexp_replace(F.regexp_replace(p, r"^(?:final|const|ref|out|in)\s+", ""), r"^(?:[\w$]+\s+(\*\S+)|(\S.*\S|\S)\s+[\w$]+)$", "$1$2")).otherwise("_"))
    return F.when(signature.isNull(), "?").otherwise(F.concat(F.size(parts).cast("string"), F.lit(":"), F.lower(F.regexp_replace(F.array_join(typed, ","), r"\s+", ""))))


def pairs(symbols: DataFrame) -> DataFrame:
    """id, name, signature, doc and doc_id of every function or method that has a doc worth keeping, its own (doc_id = id) or that
    of a declaration with the same module, parent, name and normalised signature.

    `symbols` repeats rows only as exact copies, so any row of an id is its current one; rows with a null id are left out. Docs
    are judged once, before any join, and the judged rows stored; of several declarations of one symbol the one with the smallest id gives its doc. The join
    is on the qualified symbol, whose groups are few rows even in a module with a third of all symbols; equal names without a
    signature meet only each other. Null or blank names pair only with their own doc. An empty table gives an empty one; other
    columns are not read.
    """
    held = ["moduleId", "name", "kind", "parent", "signature", "doc"]
    rows = symbols.where(F.col("id").isNotNull()).groupBy("id").agg(F.first(F.struct(*held)).alias("s")).select("id", "s.*")
    functions = rows.where(is_function(F.col("kind"), F.col("signature"), F.col("name")))
    unnamed = F.coalesce(F.trim("name") == "", F.lit(True))
    key = F.when(~unnamed, F.struct(F.coalesce("moduleId", F.lit("")).alias("m"), F.coalesce("parent", F.lit("")).alias("p"), F.trim("name").alias("n"), normal_signature(F.col("signature")).alias("s")))
    # the three parts below read the judged rows; undocumented ones stay apart from those whose doc is trivial, which lend and borrow nothing
    worth, blank = tells_something("name", "signature", "doc"), F.coalesce(F.trim("doc") == "", F.lit(True))
    judged = functions.select("id", "name", "signature", "doc", key.alias("key"), F.xxhash64(key).alias("symbol"), blank.alias("blank"), worth.alias("worth"))
    judged = stored(judged)
    own = judged.where("worth").select("id", "name", "signature", "doc", F.col("id").alias("doc_id"))
    declared = judged.where("worth AND key IS NOT NULL").groupBy("symbol", "key").agg(F.min(F.struct(F.col("id").alias("doc_id"), "doc")).alias("d"))
    bare = judged.where("blank AND key IS NOT NULL").select("id", "name", "signature", "symbol", "key")
    lent = bare.join(declared, ["symbol", "key"]).select("id", "name", "signature", "d.doc", "d.doc_id")
    return own.unionByName(lent)
