"""What the parser looks for in each language. Patterns see masked code and name the symbol `name`."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

ID = r"[A-Za-z_$][\w$]*"


@dataclass(frozen=True)
class Language:
    style: str
    symbols: tuple[tuple[str, re.Pattern], ...] = ()
    blocks: str = "brace"  # brace, indent or end
    imports: tuple[re.Pattern, ...] = ()  # groups: spec, and names where the syntax lists them
    deep: bool = False
    calls: bool = True
    extra: frozenset[str] = field(default_factory=frozenset)


def _p(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.M)


_JS = Language(
    "c",
    (
        ("class", _p(rf"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?class[ \t]+(?P<name>{ID})")),
        ("interface", _p(rf"^[ \t]*(?:export[ \t]+)?(?:declare[ \t]+)?interface[ \t]+(?P<name>{ID})")),
        ("enum", _p(rf"^[ \t]*(?:export[ \t]+)?(?:declare[ \t]+)?(?:const[ \t]+)?enum[ \t]+(?P<name>{ID})")),
        ("type", _p(rf"^[ \t]*(?:export[ \t]+)?type[ \t]+(?P<name>{ID})(?:<[^=\n]*>)?[ \t]*=")),
        ("function", _p(rf"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<name>{ID})[ \t]*[(<]")),
        ("function", _p(rf"^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<name>{ID})(?:[ \t]*:[^=\n]*)?[ \t]*=[ \t]*(?:async[ \t]*)?(?:function\b|\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)(?:[ \t]*:[^=\n]+?)?[ \t]*=>|{ID}[ \t]*=>)")),
        ("variable", _p(rf"^(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<name>{ID})(?:[ \t]*:[^=\n]*)?[ \t]*=")),
        ("method", _p(rf"^[ \t]+(?:(?:public|private|protected|static|async|override|readonly|get|set)[ \t]+)*\*?(?P<name>#?{ID})[ \t]*(?:<[^>\n]*>)?\([^;\n]*\)(?:[ \t]*:[^{{;\n]+)?[ \t]*\{{[ \t]*$")),
    ),
    imports=(
        _p(r"^[ \t]*import\s+(?:type\s+)?(?P<names>[^'\"`;]+?)\s+from\s*(?P<q>['\"])"), _p(r"^[ \t]*import\s*(?P<q>['\"])"), _p(r"^[ \t]*export\s+(?P<names>\*(?:\s+as\s+\w+)?|\{[^}]*\})\s+from\s*(?P<q>['\"])"),
        _p(rf"(?:(?:const|let|var)\s+(?P<names>\{{[^}}]*\}}|{ID})\s*=\s*)?\brequire\(\s*(?P<q>['\"])"), _p(r"\bimport\(\s*(?P<q>['\"`])"),
    ),
    deep=True,
)
_PY = Language(
    "python",
    (("class", _p(r"^[ \t]*class[ \t]+(?P<name>[A-Za-z_]\w*)")), ("function", _p(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<name>[A-Za-z_]\w*)"))),
    blocks="indent", imports=(_p(r"^[ \t]*from[ \t]+(?P<spec>\.*[\w.]*)[ \t]+import[ \t]+(?P<names>\([^)]*\)|[^\n#]+)"), _p(r"^[ \t]*import[ \t]+(?P<many>[\w., \t]+)")), deep=True,
)
_JAVA = Language(
    "c",
    (
        ("class", _p(r"^[ \t]*(?:@\w+(?:\([^)]*\))?[ \t]*)*(?:(?:public|private|protected|abstract|final|static|sealed)[ \t]+)*(?:class|record)[ \t]+(?P<name>\w+)")),
        ("interface", _p(r"^[ \t]*(?:(?:public|private|protected|static|sealed)[ \t]+)*@?interface[ \t]+(?P<name>\w+)")),
        ("enum", _p(r"^[ \t]*(?:(?:public|private|protected|static)[ \t]+)*enum[ \t]+(?P<name>\w+)")),
        ("method", _p(r"^[ \t]*(?:@\w+(?:\([^)]*\))?[ \t]*)*(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)[ \t]+)*(?:<[^>\n]+>[ \t]*)?(?!(?:return|new|else|throw|case|if|for|while|switch|catch|import|package)\b)(?:[\w.<>\[\],? ]+[ \t]+)?(?P<name>[A-Za-z_]\w*)[ \t]*\([^;{}=\n]*\)[ \t]*(?:throws[ \t]+[\w., ]+)?[ \t]*\{")),
        ("variable", _p(r"^[ \t]+(?:(?:public|private|protected|static|final|volatile|transient)[ \t]+)+[\w.<>\[\],? ]+[ \t]+(?P<name>[A-Za-z_]\w*)[ \t]*(?:=|;)")),
    ),
    imports=(_p(r"^[ \t]*import[ \t]+(?:static[ \t]+)?(?P<spec>[\w.]+(?:\.\*)?)[ \t]*;"),), deep=True,
)
_WORD = r"[A-Za-z_]\w*"


def _light(style: str, *symbols: tuple[str, str], imports: tuple[str, ...] = (), blocks: str = "brace", calls: bool = True) -> Language:
    return Language(style, tuple((k, _p(p)) for k, p in symbols), blocks, tuple(_p(p) for p in imports), False, calls)


LANGUAGES: dict[str, Language] = {
    **dict.fromkeys(("javascript", "typescript", "jsx", "tsx"), _JS), "python": _PY, "java": _JAVA,
    "go": _light("c", ("method", rf"^func[ \t]+\([^)]*\)[ \t]*(?P<name>{_WORD})[ \t]*[(\[]"), ("function", rf"^func[ \t]+(?P<name>{_WORD})[ \t]*[(\[]"), ("interface", rf"^type[ \t]+(?P<name>{_WORD})(?:\[[^\]]*\])?[ \t]+interface\b"), ("class", rf"^type[ \t]+(?P<name>{_WORD})(?:\[[^\]]*\])?[ \t]+struct\b"), ("type", rf"^type[ \t]+(?P<name>{_WORD})[ \t]+"), imports=(r"^import[ \t]+(?:\w+[ \t]+)?(?P<q>\")", r"^import[ \t]*\((?P<group>[^)]*)\)")),
    "rust": _light("c", ("function", rf"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:async[ \t]+|const[ \t]+|unsafe[ \t]+)*fn[ \t]+(?P<name>{_WORD})"), ("class", rf"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?struct[ \t]+(?P<name>{_WORD})"), ("enum", rf"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?enum[ \t]+(?P<name>{_WORD})"), ("interface", rf"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?trait[ \t]+(?P<name>{_WORD})"), imports=(r"^[ \t]*(?:pub[ \t]+)?use[ \t]+(?P<spec>[\w:]+)",)),
    "c": _light("c", ("class", rf"^[ \t]*(?:typedef[ \t]+)?(?:struct|union)[ \t]+(?P<name>{_WORD})[ \t]*\{{"), ("enum", rf"^[ \t]*(?:typedef[ \t]+)?enum[ \t]+(?P<name>{_WORD})"), ("function", rf"^(?!(?:return|else|if|for|while|switch|typedef)\b)[\w \t*&:<>,]+?[ \t*&](?P<name>[A-Za-z_][\w:~]*)[ \t]*\([^;{{}}]*\)[^;{{}}\n]*\{{"), imports=(r"^[ \t]*#[ \t]*include[ \t]*(?P<q>[<\"])",)),
    "csharp": _light("c", ("class", rf"^[ \t]*(?:[a-z]+[ \t]+)*(?:class|struct|record)[ \t]+(?P<name>{_WORD})"), ("interface", rf"^[ \t]*(?:[a-z]+[ \t]+)*interface[ \t]+(?P<name>{_WORD})"), ("enum", rf"^[ \t]*(?:[a-z]+[ \t]+)*enum[ \t]+(?P<name>{_WORD})"), ("method", rf"^[ \t]+(?:(?:public|private|protected|internal|static|async|virtual|override|sealed|abstract)[ \t]+)+[\w.<>\[\],?]+[ \t]+(?P<name>{_WORD})[ \t]*\("), imports=(r"^[ \t]*using[ \t]+(?:static[ \t]+)?(?P<spec>[\w.]+)[ \t]*;",)),
    "ruby": _light("hash", ("class", r"^[ \t]*(?:class|module)[ \t]+(?P<name>[A-Z][\w:]*)"), ("function", r"^[ \t]*def[ \t]+(?:self\.)?(?P<name>[A-Za-z_]\w*[?!=]?)"), imports=(r"^[ \t]*require(?:_relative)?[ \t]*\(?(?P<q>['\"])",), blocks="end"),
    "php": _light("c", ("class", rf"^[ \t]*(?:abstract[ \t]+|final[ \t]+)*(?:class|trait)[ \t]+(?P<name>{_WORD})"), ("interface", rf"^[ \t]*interface[ \t]+(?P<name>{_WORD})"), ("function", rf"^[ \t]*(?:(?:public|private|protected|static|abstract|final)[ \t]+)*function[ \t]+&?(?P<name>{_WORD})"), imports=(r"^[ \t]*use[ \t]+(?P<spec>[\w\\]+)", r"\b(?:require|include)(?:_once)?[ \t(]+(?P<q>['\"])")),
    "kotlin": _light("c", ("class", rf"^[ \t]*(?:[a-z]+[ \t]+)*(?:class|object)[ \t]+(?P<name>{_WORD})"), ("interface", rf"^[ \t]*(?:[a-z]+[ \t]+)*interface[ \t]+(?P<name>{_WORD})"), ("function", rf"^[ \t]*(?:[a-z]+[ \t]+)*fun[ \t]+(?:<[^>]*>[ \t]*)?(?:[\w.]+\.)?(?P<name>{_WORD})"), imports=(r"^[ \t]*import[ \t]+(?P<spec>[\w.]+)",)),
    "scala": _light("c", ("class", rf"^[ \t]*(?:[a-z]+[ \t]+)*(?:class|object)[ \t]+(?P<name>{_WORD})"), ("interface", rf"^[ \t]*(?:[a-z]+[ \t]+)*trait[ \t]+(?P<name>{_WORD})"), ("function", rf"^[ \t]*(?:[a-z]+[ \t]+)*def[ \t]+(?P<name>{_WORD})"), imports=(r"^[ \t]*import[ \t]+(?P<spec>[\w.]+)",)),
    "swift": _light("c", ("class", rf"^[ \t]*(?:[a-z]+[ \t]+)*(?:class|struct|actor)[ \t]+(?P<name>{_WORD})"), ("enum", rf"^[ \t]*(?:[a-z]+[ \t]+)*enum[ \t]+(?P<name>{_WORD})"), ("interface", rf"^[ \t]*(?:[a-z]+[ \t]+)*protocol[ \t]+(?P<name>{_WORD})"), ("function", rf"^[ \t]*(?:[a-z]+[ \t]+)*func[ \t]+(?P<name>{_WORD})"), imports=(r"^[ \t]*import[ \t]+(?P<spec>\w+)",)),
    "shell": _light("hash", ("function", rf"^[ \t]*(?:function[ \t]+)?(?P<name>{_WORD})[ \t]*\(\)[ \t]*\{{"), imports=(r"^[ \t]*(?:source|\.)[ \t]+(?P<spec>[\w./-]+)",), calls=False),
    "sql": _light("sql", ("table", r"(?i)^[ \t]*create[ \t]+(?:or[ \t]+replace[ \t]+)?(?:temp(?:orary)?[ \t]+)?table[ \t]+(?:if[ \t]+not[ \t]+exists[ \t]+)?(?P<name>[\w.\"`]+)"), ("view", r"(?i)^[ \t]*create[ \t]+(?:or[ \t]+replace[ \t]+)?(?:materialized[ \t]+)?view[ \t]+(?P<name>[\w.\"`]+)"), ("function", r"(?i)^[ \t]*create[ \t]+(?:or[ \t]+replace[ \t]+)?(?:function|procedure)[ \t]+(?P<name>[\w.\"`]+)"), ("index", r"(?i)^[ \t]*create[ \t]+(?:unique[ \t]+)?index[ \t]+(?:if[ \t]+not[ \t]+exists[ \t]+)?(?P<name>[\w.\"`]+)"), ("schema", r"(?i)^[ \t]*create[ \t]+schema[ \t]+(?P<name>[\w.\"`]+)"), ("trigger", r"(?i)^[ \t]*create[ \t]+(?:or[ \t]+replace[ \t]+)?trigger[ \t]+(?P<name>[\w.\"`]+)"), blocks="statement", calls=False),
    "vue": _light("c", imports=(r"^[ \t]*import\s+(?P<names>[^'\"`;]+?)\s+from\s*(?P<q>['\"])",)), "svelte": _light("c", imports=(r"^[ \t]*import\s+(?P<names>[^'\"`;]+?)\s+from\s*(?P<q>['\"])",)),
}
LANGUAGES["cpp"] = LANGUAGES["c"]
#: Words before a bracket that call nothing.
NO_CALLS = frozenset("if for while switch catch return function def class elif else except with assert lambda and or not in is new await async yield throw raise typeof sizeof super constructor func fn fun match when do try print_ import from case select defer go let var const static public private protected void int float bool string".split())
ENTRY_LIKE = ("function", "method", "route-handler", "component")
