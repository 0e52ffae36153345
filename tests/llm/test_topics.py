"""Problem 10, on held-out documents of an invented corpus."""

import random

from sparklode.llm.topics import CODE, columns_of, subject_areas

WORDS = {"farming": "tractor barley orchard herd silo pasture plough irrigation harvest calf".split(), "music": "violin chord tempo orchestra melody rhythm choir octave concert album".split(), "law": "court verdict statute plaintiff witness appeal clause tribunal bail docket".split()}
COMMON = "the system keeps a value and returns when nothing else is given for this item of list".split()


def line(subject, rng):
    return " ".join(rng.sample(COMMON, 5) + rng.sample(WORDS[subject], 3)) if subject else " ".join(rng.sample(COMMON, 6))


def corpus(n, rng):
    for k in range(n):
        a, b = rng.sample(list(WORDS), 2)
        double, mention = k % 5 == 0, k % 3 == 0
        lines = [line(a, rng) for _ in range(6)] + [line(b, rng) for _ in range(5 if double else 1 if mention else 0)] + [line(None, rng) for _ in range(4)]
        yield k, "\n".join(lines), {a, b} if double else {a}


def test_held_out(spark):
    rng = random.Random(4)
    docs = list(corpus(300, rng))
    odd = [(900, None), (901, ""), (902, " \n "), (903, "This page was left empty."), (904, "123 456\n789"), (905, "6b967691e7d6c35ab63c4a9a977cbea214949f99  violin.chord"), (906, docs[1][1]), (907, "the " * 50_000 + docs[1][1])]
    documents = spark.createDataFrame([(k, t, "x") for k, t, _ in docs] + [(k, t, "x") for k, t in odd], "doc_id long, text string, subject string")
    labels = [(k, f" {s.upper()} ", None) for k, _, truth in docs[:60] for s in truth] + [(0, None, None), (None, "law", None), (3, "unknown", None), (docs[1][0], "law", "wrong"), (docs[1][0], "law", "wrong")]
    labels = spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    subjects = spark.createDataFrame([("farming", "fields"), ("music", None), ("law", "courts"), ("law", "courts"), (None, "x")], "subject string, description string")
    got = {}
    for r in subject_areas(documents, labels, subjects).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(k) == truth for k, _, truth in docs[60:])
    assert right / 240 > 0.95
    assert not {900, 901, 902, 903, 904, 905} & got.keys() and got[906] == got[1] and got[907] >= docs[1][2]
    assert subject_areas(documents.limit(0), labels, subjects).count() == 0
    assert subject_areas(documents, labels, subjects.limit(0)).count() == 0
    assert subject_areas(documents.limit(5), labels.limit(0), subjects).columns == ["doc_id", "subject", "share", "lines"]


def test_terms():
    assert columns_of("getUser") == columns_of("get user") and columns_of("of") == [] and columns_of("6b967691e7d6c35ab63c4a9a") == [CODE] and len(columns_of("样本按日期")) == 4


def test_a_code_in_a_paragraph_is_only_left_out_itself():
    import numpy as np
    import pyarrow as pa

    from sparklode.llm.topics import COLUMNS, Columns, mixtures

    words = "violin chord tempo orchestra melody rhythm choir octave".split()
    columns = np.array(sorted({c for w in words for c in columns_of(w)}))
    place = np.full(COLUMNS, -1, np.int64)
    place[columns] = np.arange(len(columns))
    h = np.stack([np.full(len(columns), 1 / len(columns)), np.full(len(columns), 1e-9)]).astype(np.float32)
    code = "6b967691e7d6c35ab63c4a9a977cbea214949f99"
    lengths, flat = Columns().encode([" ".join(words) + f" since {code} " + " ".join(words), f"{code}  {words[0]}.{words[1]}\n{code}  {words[2]}.mid", None])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(flat.astype(np.int32)))
    evidence, lines, distinct = mixtures(lists, columns, place, h, 1)
    assert evidence[:, 0].tolist()[0] > 7 and distinct[:, 0].tolist() == [8, 0, 0] and lines[:, 0].tolist() == [1, 0, 0]
