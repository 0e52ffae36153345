"""Problem 6."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparklode.llm.splitting import LINE, split, split_oversized


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\r}é😀", min_size=1, max_size=300), st.integers(1, 60), st.integers(0, 3))
def test_pieces_fit_and_lose_nothing(text, limit, overlap):
    pieces = split(text, limit, overlap)
    assert all(0 < len(p) <= limit for p, _, _ in pieces)
    assert all(first <= last for _, first, last in pieces) and pieces[0][1] == 0 and pieces[-1][2] == len(LINE.findall(text)) - 1
    if not overlap:
        assert "".join(p for p, _, _ in pieces) == text
    reached = {0}  # how far the pieces so far may cover the text
    for p, _, _ in pieces:
        reached = {a + len(p) for a in range(max(reached) + 1) if text.startswith(p, a) and any(a <= r < a + len(p) for r in reached)}
    assert len(text) in reached


def test_cuts_lie_at_blank_lines_and_share_lines():
    text = "".join(f"def f{k}():\n    return {k}\n\n" for k in range(20))
    pieces = split(text, 120, 2)
    assert len(pieces) > 3
    for (a, _, last), (b, first, _) in zip(pieces, pieces[1:]):
        assert a.endswith("\n\n") and first == last - 1 and b.startswith("".join(LINE.findall(a)[-2:]))


def test_limits_and_long_lines():
    assert split("abc", 3, 1) == [("abc", 0, 0)]
    assert [len(p) for p, _, _ in split("x" * 10, 4, 2)] in ([4, 4, 2], [4, 2, 4], [2, 4, 4])
    with pytest.raises(ValueError):
        split("abc", 0, 0)


def test_rows(spark):
    t = dt.datetime(2025, 1, 1)
    big = "// about the chunk\n" + "".join(f"line {k}\n" for k in range(100))
    rows = [("a", "f", "symbol", 11, 110, big, t), ("a", "f", "symbol", 11, 110, big, t), ("b", "f", "symbol", 1, 5, "small", t), ("old", "f", "symbol", 1, 5, big, t), ("old", "f", "symbol", 1, 5, "new", t + dt.timedelta(1)), ("n", "f", "symbol", 1, 1, None, t), ("k", "f", None, 1, 1, big, t), ("u", "f", "none", 1, 1, big, t), ("s", "f", "symbol", None, None, big, None), (None, "f", "symbol", 1, 1, big, t), ("e", "f", "symbol", 1, 1, "", t)]
    chunks = spark.createDataFrame([(*r, "clash") for r in rows], "id string, fileId string, kind string, startLine int, endLine int, text string, seenAt timestamp_ntz, piece string")
    limits = spark.createDataFrame([("chunks.symbol", "characters", 300, 2), ("chunks.symbol", "characters", 300, 2), ("container.small", "tokens", 5, 0)], "applies_to string, unit string, max_size int, overlap_lines int")
    out = split_oversized(chunks, limits).orderBy("id", "piece").collect()
    assert {r.id for r in out} == {"a", "s"}
    a = [r for r in out if r.id == "a"]
    assert [r.piece for r in a] == list(range(len(a))) and a[0].startLine == 11 and a[-1].endLine == 110 and all(len(r.text) <= 300 for r in a)
    assert all(y.startLine == x.endLine - 1 for x, y in zip(a, a[1:]))
    assert split_oversized(chunks.limit(0), limits).count() == 0 and split_oversized(chunks, limits.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n\r}é😀", min_size=1, max_size=300), st.integers(1, 60), st.integers(0, 3))
def test_own_parts_make_the_text(text, limit, overlap):
    from sparklode.llm.splitting import split_parts

    assert "".join(p[shared:] for p, _, _, shared in split_parts(text, limit, overlap)) == text
