"""Blanking strings and comments, so that patterns only see code. Lengths and line ends stay as they are."""

from __future__ import annotations

import re

_BLANK = re.compile(r"[^\n]")
#: What is no code in each family of languages, longest opener first.
STYLES = {
    "c": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?", re.S),
    "python": re.compile(r"#[^\n]*|(?:[rbfuRBFU]{0,2})(?:\"\"\"(?:\\.|.)*?(?:\"\"\"|\Z)|'''(?:\\.|.)*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)", re.S),
    "hash": re.compile(r"#[^\n]*|\"(?:\\.|[^\"\\])*\"?|'[^']*'?", re.S),
    "sql": re.compile(r"--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:''|[^'])*'?", re.S),
}


def mask(source: str, style: str) -> str:
    """`source` with the insides of strings and comments blanked. A regex literal of JavaScript may stay; it holds no calls."""
    return STYLES[style].sub(lambda m: _BLANK.sub(" ", m.group()), source)


def comments(source: str, style: str) -> list[tuple[int, int]]:
    """The spans of comments, for documentation and markers."""
    opener = ("#",) if style in ("python", "hash") else ("--", "/*") if style == "sql" else ("//", "/*")
    return [m.span() for m in STYLES[style].finditer(source) if m.group().startswith(opener)]


def closing(masked: str, at: int, pair: str = "{}") -> int:
    """The place of the bracket that closes the one at `at`, the end of the text if none does."""
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(masked, at):
        depth += 1 if m.group() == pair[0] else -1
        if depth <= 0:
            return m.start()
    return len(masked)


def indent(line: str) -> int:
    """Columns in front of a line's text; a tab goes to the next multiple of eight."""
    width = 0
    for c in line:
        if c == " ":
            width += 1
        elif c == "\t":
            width += 8 - width % 8
        else:
            break
    return width
