"""Splitting oversized items at natural boundaries, by agglomerative merging.

An oversized text is first cut into atoms: its lines, and lines longer than the limit at the last space, or else anywhere. Every
boundary between neighbours has a strength: blank lines and the ends of top-level blocks are strong, the middle of a line is
weakest. All boundaries wait in a heap; the weakest whose two sides fit together, with the overlap in front, goes first. What is
left when nothing fits any more are the pieces, with their edges at the strongest boundaries.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import newest_first

PIECES = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("startLine", T.IntegerType()), ("endLine", T.IntegerType()), ("shared", T.IntegerType()), ("text", T.StringType()))]))
LINE = re.compile(r"[^\n]*\n|[^\n]+")
HEAD_COMMENT = re.compile(r"\s*(?://|#|--|/\*|<!--|;)")


def atoms(text: str, limit: int) -> list[tuple[str, int]]:
    """Lines of `text` with their ends, and the number of each from 0; a line above the limit is cut after its last space that
    fits, or at the limit where it has none. A CRLF is never cut apart."""
    out = []
    for no, line in enumerate(LINE.findall(text)):
        while len(line) > limit:
            at = line.rfind(" ", 0, limit) + 1 or limit
            if line[at - 1 : at + 1] == "\r\n" and at > 1:
                at -= 1
            out.append((line[:at], no))
            line = line[at:]
        out.append((line, no))
    return out


def strength(left: str, right: str, same_line: bool) -> float:
    """How natural a cut between two atoms is: 0 within a line, then line ends, dedents and closed blocks, blank lines."""
    if same_line:
        return 1.0 if left.endswith((" ", "\t", ",", ";")) else 0.0
    if not left.strip():
        return 8.0 if right.strip() and not right[:1].isspace() else 6.0
    if not right.strip():
        return 5.0
    indent, value = len(right) - len(right.lstrip()), 2.0
    if indent == 0:
        value += 1.0
    elif indent < len(left) - len(left.lstrip()):
        value += 0.5
    if left.rstrip().endswith(("}", "end", "};", ")", ".", "。", "```")):
        value += 0.5
    return value


def split(text: str, limit: int, overlap: int) -> list[tuple[str, int, int]]:
    """The pieces of `text` as (text, first line, last line); see `split_parts`."""
    return [part[:3] for part in split_parts(text, limit, overlap)]


def split_parts(text: str, limit: int, overlap: int) -> list[tuple[str, int, int, int]]:
    """The pieces of `text` as (text, first line, last line, characters shared with the piece before), lines from 0 and all pieces of
    at most `limit` characters.

    Each piece after the first begins with the last `overlap` lines of the one before; where these don't fit beside the piece's
    own first atom, with as many of them as fit, down to none for lines that fill the limit alone. Without the overlaps the
    pieces joined are the text.
    """
    if limit < 1:
        raise ValueError("the limit must be positive")
    if len(text) <= limit:
        return [(text, 0, max(0, len(LINE.findall(text)) - 1), 0)]
    cut = atoms(text, limit)
    n, sizes = len(cut), [len(a) for a, _ in cut]
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)

    def first_shared(start: int) -> int:
        """The first atom of the overlap in front of atom `start`, if the overlap is whole."""
        if start == 0 or overlap <= 0:
            return start
        line = cut[start][1] - overlap + (cut[start - 1][1] == cut[start][1])
        k = start
        while k > 0 and cut[k - 1][1] >= line:
            k -= 1
        return k

    shared = [first_shared(k) for k in range(n)]
    after, before, end, alive = [*range(1, n), n], [-1, *range(n - 1)], [*range(1, n + 1)], [True] * n
    heap = [(strength(cut[k][0], cut[k + 1][0], cut[k][1] == cut[k + 1][1]), sizes[k] + sizes[k + 1], k, k + 1) for k in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        power, size, a, b = heapq.heappop(heap)
        if not (alive[a] and b < n and alive[b] and after[a] == b) or size != total[end[b]] - total[a]:
            continue
        if total[end[b]] - total[shared[a]] > limit:
            continue
        alive[b], end[a], after[a] = False, end[b], after[b]
        if after[a] < n:
            before[after[a]] = a
            c = after[a]
            heapq.heappush(heap, (strength(cut[c - 1][0], cut[c][0], cut[c - 1][1] == cut[c][1]), total[end[c]] - total[a], a, c))
        p = before[a]
        if p >= 0:
            heapq.heappush(heap, (strength(cut[a - 1][0], cut[a][0], cut[a - 1][1] == cut[a][1]), total[end[a]] - total[p], p, a))
    pieces, k = [], 0
    while k < n:
        start = shared[k]
        while start < k and total[end[k]] - total[start] > limit:
            start += 1
        pieces.append(("".join(a for a, _ in cut[start : end[k]]), cut[start][1], cut[end[k] - 1][1], total[k] - total[start]))
        k = after[k]
    return pieces


def head_lines(text: str, start: int | None, end: int | None) -> int:
    """How many lines at the front of a chunk's text describe it and aren't lines of its source: those beyond endLine - startLine + 1,
    at most five and only if they are comments."""
    if start is None or end is None or start != start or end != end:
        return 0
    lines = LINE.findall(text)
    extra = min(5, max(0, len(lines) - int(end - start + 1)))
    while extra and not all(HEAD_COMMENT.match(line) for line in lines[:extra]):
        extra -= 1
    return extra


@F.pandas_udf(PIECES)
def _pieces(text: pd.Series, limit: pd.Series, overlap: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    def one(t, most, shared, first, last):
        if t is None or most != most or len(t) <= most:
            return None
        head, begin = head_lines(t, first, last), 1 if first is None or first != first else int(first)
        at = lambda line: begin + max(0, line - head)
        return [{"piece": k, "startLine": at(a), "endLine": at(b), "shared": c, "text": p} for k, (p, a, b, c) in enumerate(split_parts(t, int(most), int(shared)))]

    return pd.Series([one(*row) for row in zip(text, limit, overlap, start, end)], dtype=object)


def split_oversized(chunks: DataFrame, limits: DataFrame, key: str = "id", at: str = "seenAt") -> DataFrame:
    """The pieces of every current chunk above its kind's limit: key, fileId, kind, piece from 0, startLine, endLine,
    shared (characters the piece has in common with the one before) and text.

    Only texts above the limit reach Python or the shuffle; rows within it travel as key and time alone, so that they can still
    replace an outdated oversized row. Limits come from a table of a few rows (`applies_to` = `chunks.<kind>`, unit characters;
    of several for one kind the smallest), joined under Spark's own size check. Lengths are in code points. A null text, a kind
    without limit or a null kind is never oversized; a null startLine counts from 1; copies give their pieces once; rows with a
    null key are left out; an empty table gives an empty one; other columns are not read. The comment lines about the chunk in
    front of its text count as its first source line.
    """
    rule = limits.where((F.lower("unit") == "characters") & F.col("applies_to").startswith("chunks.")).groupBy(F.substring("applies_to", 8, 1000).alias("__kind"))
    rule = rule.agg(F.min_by(F.struct(F.col("max_size").alias("most"), F.coalesce("overlap_lines", F.lit(0)).alias("shared")), "max_size").alias("__rule"))
    rows = chunks.where(F.col(key).isNotNull()).select(key, "fileId", "kind", "startLine", "endLine", "text", newest_first(at).alias("__at"))
    rows = rows.join(rule, F.col("kind") == F.col("__kind"), "left")
    big = F.coalesce(F.length("text") > F.col("__rule.most"), F.lit(False))
    body = F.struct("fileId", "kind", "startLine", "endLine", "text", F.col("__rule.most").alias("most"), F.col("__rule.shared").alias("shared"))
    now = rows.select(key, "__at", F.when(big, body).alias("__body")).groupBy(key).agg(F.max_by("__body", "__at").alias("b")).where("b IS NOT NULL").select(key, "b.*")
    cut = now.select(key, "fileId", "kind", F.explode(_pieces("text", "most", "shared", "startLine", "endLine")).alias("p"))
    return cut.select(key, "fileId", "kind", "p.*")


def rebuilt(pieces: DataFrame, key: str = "id") -> DataFrame:
    """key, characters and digest (MD5) of what the pieces give when each one's own part follows that of the piece before. The pieces
    of one text come together, as they were one text before."""
    own = F.struct("piece", F.expr("substring(text, shared + 1)").alias("t"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(own)), lambda p: p["t"]), "")
    return pieces.groupBy(key).agg(whole.alias("__t")).select(key, F.length("__t").alias("characters"), F.md5("__t").alias("digest"))
