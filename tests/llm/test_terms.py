"""Problems 4 and 7, against counting by hand and brute force."""

import math
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparklode.llm.terms import interval_counts, marked_terms, ngram_counts, records, score_terms, suffix_array, two_poisson

ROWS = "id string, tokens array<string>, seenAt timestamp_ntz, term string, df int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "clash", 0) for i, t in rows], ROWS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=12), min_size=1, max_size=8))
def test_suffix_array_counts_like_brute_force(docs):
    tokens = np.array([t for d in docs for t in d])
    record = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    ends = np.cumsum([len(d) for d in docs])
    remains = np.array([ends[r] - i for i, r in enumerate(record)])
    order, common = suffix_array(tokens, record, 4)
    for n in (1, 2, 3, 4):
        first, occurrences, held = interval_counts(order, common, record, remains, n)
        got = {tuple(tokens[f : f + n]): (o, h) for f, o, h in zip(first, occurrences, held)}
        grams = [(tuple(d[i : i + n]), k) for k, d in enumerate(docs) for i in range(len(d) - n + 1)]
        assert got == {g: (c, len({k for x, k in grams if x == g})) for g, c in Counter(g for g, _ in grams).items()}


def test_marks(spark):
    rows = [(f"r{k}", ["All", " all ", "pair" if k < 3 else "odd", f"own{k}", None, ""]) for k in range(12)] + [("e", []), ("n", None), (None, ["all"]), ("only", [None, " "])]
    got = {r.ngram[0]: r for r in marked_terms(records(frame(spark, rows))).collect()}
    assert got["all"].occurrences == 24 and got["all"].records == 12 and got["all"].mark == "common" and got["all"].n_records == 12
    assert got["pair"].mark is None and got["own1"].mark == "rare" and got["odd"].records == 9
    assert marked_terms(records(frame(spark, rows).limit(0))).count() == 0


def test_many_blocks_count_like_one(spark, monkeypatch):
    import sparklode.llm.terms as module

    random.seed(1)
    rows = [(f"r{k}", [random.choice("abcde") for _ in range(random.randint(1, 30))]) for k in range(200)]
    got = {tuple(r.ngram): (r.occurrences, r.records) for r in ngram_counts(records(frame(spark, rows).repartition(7)), (1, 2)).where("ngram is not null").collect()}
    want = {}
    for n in (1, 2):
        grams = [(tuple(t[i : i + n]), i_) for i_, t in rows for i in range(len(t) - n + 1)]
        for g, c in Counter(g for g, _ in grams).items():
            want[g] = (c, len({i for x, i in grams if x == g}))
    assert got == want and module.BLOCK > 1


def test_weights(spark, monkeypatch):
    rows = [(f"r{k}", ["common"] + ["topic"] * (6 if k < 10 else 1 if k == 11 else 0) + (["pair"] if k in (3, 4) else [])) for k in range(100)] + [("twice", ["x", "x"]), ("n", None)]
    import sparklode.llm.terms as module

    for hot in (module.HOT_ROWS, 2):  # few hot terms send the others over the shuffle
        monkeypatch.setattr(module, "HOT_ROWS", hot)
        scored, names, total = score_terms(records(frame(spark, rows)))
        got = {(r.id, r.term): r for r in scored.join(names, "rid").collect()}
        assert total == 101 and len(got) == 100 + 11 + 2 + 1
        assert got["r1", "topic"].tf == 6 and got["r1", "topic"].df == 11 and got["r1", "topic"].elite > 0.9 > got["r11", "topic"].elite
        assert got["r3", "pair"].df == 2 and got["r0", "common"].df == 100
    scored, names, total = score_terms(records(frame(spark, rows).limit(0)))
    assert total == 0 and scored.count() == 0


def test_the_fit_finds_two_rates():
    rng = np.random.default_rng(5)
    x = np.where(rng.random(40_000) < 0.05, rng.poisson(6, 40_000), rng.poisson(0.2, 40_000))
    tf, n = np.unique(x[x > 0], return_counts=True)
    share, elite, plain, post = two_poisson(tf.astype(float), n, np.zeros(len(tf), np.int64), 40_000, rounds=300)
    assert abs(share[0] - 0.05) < 0.01 and abs(elite[0] - 6) < 0.4 and abs(plain[0] - 0.2) < 0.03
    assert (np.diff(post) >= 0).all() and post[-1] > 0.99 and math.isfinite(post.sum())


def brute_fit(tfs, total, rounds=60):
    """Two Poisson rates for one term, record by record: every record is a row, those without the term too."""
    x = list(tfs) + [0] * (total - len(tfs))
    share, elite, plain = min(max(len(tfs) / total, 1e-12), 0.5), 1.5 * sum(tfs) / len(tfs), max(0.25 * sum(tfs) / total, 1e-12)
    chance = lambda k: 1 / (1 + math.exp(-max(-700, min(700, math.log(share / (1 - share)) + k * math.log(elite / plain) - (elite - plain)))))
    for _ in range(rounds):
        held = [chance(k) for k in x]
        weight, hits = sum(held), sum(h * k for h, k in zip(held, x))
        fresh = min(max(weight / total, 1e-12), 1 - 1e-12)
        a, b = max(hits / max(weight, 1e-12), 1e-12), max((sum(x) - hits) / max(total - weight, 1e-12), 1e-12)
        elite, plain, moved, share = max(a, b), min(a, b), abs(fresh - share), fresh
        if moved < 1e-7:
            break
    return chance


def test_the_posterior_is_that_of_a_fit_record_by_record(spark):
    rng = random.Random(4)
    terms = {"topic": 0.2, "often": 0.7, "rare": 0.02, "long" * 40: 0.3}
    rows = [(f"r{k}", ["base"] + [t for t, p in terms.items() if rng.random() < p for _ in range(1 + int(rng.expovariate(0.6)))]) for k in range(300)]
    scored, names, total = score_terms(records(frame(spark, rows)))
    got = scored.join(names, "rid").collect()
    for term in [*terms, "base"]:
        tfs = [t.count(term) for _, t in rows if term in t]
        chance = brute_fit(tfs, len(rows))
        mine = {(r.id, r.tf): r.elite for r in got if r.term == term}
        assert len(mine) == len(tfs) and all(abs(e - chance(tf)) < 1e-6 for (_, tf), e in mine.items()), term


def test_the_best_term_is_that_of_a_comparison_of_all(spark, monkeypatch):
    import sparklode.llm.terms as module

    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)] + ["x" * 300, "y" * 300]
    rows = [(f"r{k}", [w for w in rng.sample(words, rng.randint(1, 20)) for _ in range(rng.choice([1, 1, 2, 7]))] + [f"own{k}"]) for k in range(120)] + [("alone", ["only"]), ("none", [None])]
    df = Counter(t for _, ts in rows for t in {x for x in ts if x})
    want = {}
    for i, ts in rows:
        scores = [(-round(n * math.log(121 / df[t]), 6), t) for t, n in Counter(x for x in ts if x).items() if df[t] >= 2]
        want |= {i: min(scores)[1]} if scores else {}
    for hot, elite in ((100_000, 0.5), (2, 0.5), (100_000, 2.0), (100_000, 0.0)):  # none and all are candidates in the last two
        monkeypatch.setattr(module, "HOT_ROWS", hot)
        monkeypatch.setattr(module, "ELITE", elite)
        got = module.most_distinctive(records(frame(spark, rows))).collect()
        assert {r.id: r.term for r in got} == want
    assert module.most_distinctive(records(frame(spark, rows).limit(0))).count() == 0
