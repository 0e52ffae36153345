"""Problems 8 and 9: the encoding against a public library, the packing against its rules."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparklode.llm import bpe, packing

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="the vocabulary file is not there")
ODD = ["", "a", " ", "\n\n  x\n", "it's they'll", "<|endoftext|>", "a" * 3000, "ab" * 400, "中文字符😀é ­", "x\x1cy\x85z\xa0 w", "  \t \r\n", "1234567 ١٢٣ ½", "".join(chr(k) for k in range(1, 400))]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary.load())


def lists(encoder, texts):
    lengths, flat = encoder.encode(texts)
    at = [0, *lengths.cumsum()]
    return [flat[a:b].tolist() for a, b in zip(at, at[1:])]


def test_odd_texts(encoder, library):
    assert lists(encoder, ODD) == [e.ids for e in library.encode_batch(ODD, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(encoder, library, text):
    assert lists(encoder, [text]) == [library.encode(text, add_special_tokens=False).ids]


def test_long_words_take_the_heap(encoder, library):
    random.seed(2)
    texts = ["".join(random.choice("etaoin") for _ in range(n)) for n in (255, 256, 257, 3000)]
    assert lists(encoder, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_rows(spark, monkeypatch):
    df = spark.createDataFrame([(1, "hello world", "x"), (1, "hello world", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, tokens string")
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encode_corpus(df).collect())
    assert got == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert sorted((r.doc_id, r.tokens) for r in bpe.count_tokens(df).collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert bpe.encode_corpus(df.limit(0)).count() == 0 and bpe.encode_corpus(df.limit(0)).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    monkeypatch.setattr(bpe, "REMEMBERED", 1)
    assert lists(bpe.Encoder(bpe.Vocabulary.load()), ["a b", "b c", "a"]) == [[64, 275], [65, 269], [64]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 120), max_size=80), st.integers(1, 50))
def test_containers_hold(sizes, capacity):
    placed = packing.pack(sizes, capacity)
    fill = {}
    for item, piece, container, place, n in placed:
        assert (n <= capacity) and (n > 0 or sizes[item] == 0)
        fill.setdefault(container, []).append((place, n))
    for parts in fill.values():
        at = 0
        for place, n in sorted(p for p in parts if p[1]):
            assert place == at
            at += n
        assert at <= capacity
    for item, size in enumerate(sizes):
        mine = [n for i, *_, n in placed if i == item]
        assert sum(mine) == size and len(mine) == max(1, -(-size // capacity))


def test_little_room_is_lost():
    random.seed(3)
    sizes = [random.randint(1, 700) for _ in range(5000)]
    used, containers = sum(sizes), len({c for _, _, c, _, _ in packing.pack(sizes, 512)})
    assert used / (containers * 512) > 0.99


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=60))
def test_every_item_goes_where_the_squares_grow_least(sizes):
    packer = packing.SumOfSquares(12)
    for n in sizes:
        before = packer.level.copy()
        _, h = packer.put(n)

        def squares(level):
            counts = before.copy()
            if level:
                counts[level] -= 1
            if level + n < 12:
                counts[level + n] += 1
            return int((counts**2).sum())

        assert squares(h) == min(squares(g) for g in range(0, 13 - n) if g == 0 or before[g])


def test_fill(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARE", 3)
    sized = spark.createDataFrame([(k, 40 * k, "x") for k in range(9)] + [(8, 320, "x"), (None, 5, "x"), (20, None, "x")], "doc_id long, tokens int, place string")
    out = packing.fill(sized, {"container.small": 100, "container.large": 1000}).collect()
    for kind, capacity in (("container.small", 100), ("container.large", 1000)):
        mine = [r for r in out if r.applies_to == kind]
        totals = {}
        for r in mine:
            totals[r.container] = totals.get(r.container, 0) + r.tokens
        assert max(totals.values()) <= capacity and sum(totals.values()) == sum(40 * k for k in range(9)) + 320 + 5
        assert {r.doc_id for r in mine} == {*range(9), None, 20}
    again = packing.fill(sized.repartition(5), {"container.small": 100, "container.large": 1000}).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    assert packing.fill(sized.limit(0), {"container.small": 100}).count() == 0
    with pytest.raises(ValueError):
        packing.fill(sized, {})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_without_tightening_items_stay_where_the_squares_put_them(sizes):
    packer = packing.SumOfSquares(50)
    assert packing.pack(sizes, 50, tighten=False) == [(k, 0, *packer.put(n), n) for k, n in enumerate(sizes)]


def test_faults_are_counted(spark):
    limits = spark.createDataFrame([("container.small", 10), ("container.large", 30), ("chunks.doc", 5)], "applies_to string, max_size int")
    rows = [(1, "container.small", 0, 0, 0, 6), (2, "container.small", 0, 0, 6, 5), (3, "container.small", 1, 0, 0, 2), (3, "container.small", 2, 1, 0, 2), (4, "container.small", 2, 0, 3, 1), (1, "container.large", 0, 0, 0, 6), (2, "container.large", 1, 0, 0, 0)]
    got = {r.applies_to: tuple(r)[1:] for r in packing.faults(spark.createDataFrame(rows, "doc_id long, " + packing.PLACED), limits).collect()}
    assert got == {"container.small": (10, 4, 1, 1, 1), "container.large": (30, 2, 0, 0, 0)}
