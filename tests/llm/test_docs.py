"""Problem 5."""

import pytest

from sparklode.llm.docs import informative, pairs

NAME, SIGN = "mergeCacheBatch", "function mergeCacheBatch(cache: Cache, heap: number): number"
TRIVIAL = [None, "", " \n\t", "TODO", "FIXME add docs", "@param cache\n@returns", "@param cache the cache\n@return the result", ":param cache: cache\n:return:", "Args:\n    cache: the cache", "Merges the cache.", "The merge cache batch function.", "mergeCacheBatch implementation", "MERGE CACHE BATCH", "@inheritDoc", "{@inheritDoc}", "-----", "eslint-disable-next-line", "return null;", "mergeCache()", "Released under the terms in LICENSE. All rights reserved.", "Auto-generated method stub", "2024-03-02", "foo bar", "N/A", "无", "待补充", "@returns {Promise<void>}", "@throws Error\n@param cache cache", "<p></p>"]
TELLING = ["Rounds half up.", "Idempotent; safe to retry.", "TODO speed up. Locks the cache row, so keep it short.", "@param cache must still be open, otherwise nothing happens", ":raises ValueError: when the heap is older than 30 days", "按编译器计算，失败时回滚并保留原始记录。", "<p>Locks the row, so keep it short.</p>", "Args:\n    cache: closed ones are ignored\nReturns:\n    the heap after rounding", "@deprecated since the import writes the heap itself"]


@pytest.mark.parametrize("doc", TRIVIAL)
def test_trivial(doc):
    assert not informative(NAME, SIGN, doc)


@pytest.mark.parametrize("doc", TELLING)
def test_telling(doc):
    assert informative(NAME, SIGN, doc)


def test_pairs(spark):
    rows = [
        ("a#f@1", "a", "m", "f", "Function", None, "int f(int x)", "Rounds half up."),
        ("a#f@1", "a", "m", "f", "Function", None, "int f(int x)", "Rounds half up."),
        ("b#f@9", "b", "m", "f", "function", None, "int f(int count)", None),  # the definition of a's declaration
        ("b#f@20", "b", "m", "f", "function", None, "int f(String s)", " "),  # another overload
        ("c#f@1", "c", "other", "f", "function", None, "int f(int x)", None),  # another module
        ("d#g@1", "d", "m", "g", None, None, "def g(x)", "Rounds half up."),
        ("d#K@1", "d", "m", "K", None, None, "class K", "Holds all scores of one tenant."),
        ("d#L@1", "d", "m", "L", "const", None, "L", "Upper bound agreed with the team."),
        ("d#h@1", "d", "m", "h", "method", None, None, "TODO"),
        ("d#n@1", "d", None, None, "method", None, None, "Rounds half up, then locks."),
        (None, "d", "m", "x", "method", None, None, "Rounds half up."),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id string, fileId string, moduleId string, name string, kind string, parent string, signature string, doc string, doc_id string")
    got = {(r.id, r.doc_id) for r in pairs(df).collect()}
    assert got == {("a#f@1", "a#f@1"), ("b#f@9", "a#f@1"), ("d#g@1", "d#g@1"), ("d#n@1", "d#n@1")}
    assert pairs(df.limit(0)).count() == 0
