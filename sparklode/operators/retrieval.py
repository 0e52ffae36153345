"""Hybrid retrieval over code chunks: BM25 and vector rankings, reciprocal-rank fusion, reranking, the evidence gate, answers."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import CJK, FEATURES, WIDTH, embed_text, feature_arrays, feature_tokens, has_word, occurrences, round6
from .ranking import ranked

#: Order and weight of the kinds of chunks.
KIND_RANK = {"file-header": 0, "symbol": 1, "config": 2, "doc": 3}
KIND_WEIGHT = {"symbol": 1.2, "file-header": 1.0, "config": 0.9, "doc": 0.8}


@dataclass(frozen=True)
class Search:
    """What a search uses unless told otherwise."""

    limit: int = 8
    k1: float = 1.2
    b: float = 0.75
    rrf: int = 60
    common_share: float = 0.4
    common_least: int = 3
    single_weight: float = 0.25
    bonus: float = 0.01
    bonus_terms: int = 3
    per_file: int = 2
    penalty: float = 0.85


def windows(rows: DataFrame, lines: Column, whole: int = 200, size: int = 80, step: int = 40) -> DataFrame:
    """`rows` once for each window of lines, with startLine and endLine: the whole up to `whole` lines, else `size` lines every `step`."""
    starts = F.when(lines <= whole, F.array(F.lit(1))).otherwise(F.filter(F.sequence(F.lit(1), lines, F.lit(step)), lambda s: (s == 1) | (s - step + size - 1 < lines)))
    out = rows.where(lines > 0).withColumn("__n", lines).withColumn("startLine", F.explode(starts))
    return out.withColumn("endLine", F.when(F.col("__n") <= whole, F.col("__n")).otherwise(F.least(F.col("__n"), F.col("startLine") + size - 1)).cast("int")).drop("__n")


#: What the index holds of a chunk besides its text, which only citations read.
PLACE = ("id", "fileId", "symbolName", "startLine", "endLine", "kind")


def index_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks ready for search: `terms` with their counts, `length` in words and a hashed `vector`. Store the result: a search reads
    terms and vectors only, and `update_index` carries it over to the next state of the chunks."""
    rows = chunks.select([c for c in chunks.columns if c not in FEATURES.names])
    at, names = rows.columns.index("text"), [*rows.columns, *FEATURES.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2_000):
                part = batch.slice(k, 2_000)
                yield pa.RecordBatch.from_arrays([*part.columns, *feature_arrays(part.column(at).to_pylist())], names)

    return rows.mapInArrow(run, T.StructType([*rows.schema, *FEATURES]))


def update_index(old: DataFrame | None, chunks: DataFrame) -> DataFrame:
    """The index of `chunks`, where only those are worked on whose id and hash `old` does not have. Ids are unique in both; a null
    hash is always worked on. Only ids and hashes are compared; what `chunks` no longer has is gone."""
    if old is None:
        return index_chunks(chunks)
    known = old.select("id", "hash").where("hash IS NOT NULL")
    fresh = index_chunks(chunks.join(known, ["id", "hash"], "left_anti"))
    kept = old.join(chunks.select("id", "hash"), ["id", "hash"], "left_semi")
    return fresh.unionByName(kept.select(fresh.columns))


def index_stats(index: DataFrame) -> dict:
    """chunks, files, tokens and the width of the vectors."""
    r = index.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("fileId").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.coalesce(F.max(F.size("vector")), F.lit(WIDTH)).alias("dim")).first()
    return r.asDict()


def query_terms(spark, questions: Sequence[str]) -> DataFrame:
    """qid, question and its distinct terms; a handful of rows."""
    q = spark.createDataFrame(list(enumerate(questions)), "qid int, question string")
    return q.withColumn("terms", F.array_distinct(feature_tokens(F.col("question"))))


def classify_terms(terms: DataFrame, total: int, s: Search = Search()) -> DataFrame:
    """qid, term, df, class and weight. Terms found nowhere have no class; a single wide character is common beside a pair, very
    frequent terms are common, single characters and terms of up to two letters are weak, the others strong."""
    wide = F.col("term").rlike(f"^{CJK}")
    pair = F.max((wide & (F.length("term") >= 2)).cast("int")).over(Window.partitionBy("qid")) == 1
    single = wide & (F.length("term") == 1)
    known = F.coalesce(F.col("df"), F.lit(0))
    kind = F.when(known <= 0, None).when(single & pair, "common").when((known / F.lit(float(max(total, 1))) > s.common_share) & (known > s.common_least), "common").when(single | (~wide & (F.length("term") <= 2)), "weak").otherwise("strong")
    return terms.select("qid", "term", known.alias("df"), kind.alias("class"), F.when((known > 0) & single & pair, s.single_weight).otherwise(1.0).alias("weight"))


def postings(index: DataFrame, terms: Sequence[str]) -> DataFrame:
    """id, term and tf of the given terms; words are counted, terms of wide script are looked for in the text. The terms come from
    the questions, so they are literals of the plan and only rows that hold one go on."""
    plain = [t for t in terms if not _is_wide(t)]
    wide = [t for t in terms if _is_wide(t)]
    counted = index.select("id", F.explode(F.filter("words", lambda w: w.isin(plain))).alias("term")) if plain else None
    out = counted.groupBy("id", "term").agg(F.count(F.lit(1)).cast("int").alias("tf")) if plain else None
    if wide:
        seen = F.filter(F.transform(F.array(*[F.lit(t) for t in wide]), lambda t: F.struct(t.alias("term"), occurrences(F.col("text"), t).alias("tf"))), lambda p: p["tf"] > 0)
        more = index.select("id", F.explode(seen).alias("p")).select("id", "p.term", "p.tf")
        out = more if out is None else out.unionByName(more)
    return out


def _is_wide(term: str) -> bool:
    import re

    return bool(re.match(CJK, term))


def scores(index: DataFrame, queries: Sequence, s: Search = Search()) -> DataFrame | None:
    """qid, what PLACE names, tie, bm25, strong (how many telling terms) and vector of every chunk that one of the questions (rows of
    `query_terms`) meets by words or by vector; None for an empty index. No posting and no text is read or shuffled."""
    spark = index.sparkSession
    size = index.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg")).first()
    if not size.n:
        return None
    asked = sorted({t for q in queries for t in q.terms})
    matched = index.select(*PLACE, "length", "vector", F.filter("terms", lambda t: t["term"].isin(asked)).alias("terms"))
    # one number a term of the questions reaches the driver; what a chunk scores follows from its own row
    df = dict(matched.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect())
    pairs = spark.createDataFrame([(q.qid, t, df.get(t)) for q in queries for t in q.terms], "qid int, term string, df bigint")
    classes = {(r.qid, r.term): r for r in classify_terms(pairs, size.n, s).collect()}
    worth = [{t: (c.weight * _idf(c.df, size.n), c["class"] == "strong") for t in q.terms if (c := classes[q.qid, t]).df} for q in queries]
    told = _scores([embed_text(q.question) for q in queries], worth, float(size.avg or 1) or 1.0, s)
    tie = F.struct("fileId", "startLine", F.coalesce(F.create_map(*[F.lit(x) for kv in KIND_RANK.items() for x in kv])[F.col("kind")], F.lit(9)).alias("k"), "id").alias("tie")
    rows = matched.select(*PLACE, tie, F.posexplode(told("terms", "length", "vector")).alias("p", "s")).where("s.bm25 > 0 OR s.vector > 0")
    ids = F.broadcast(spark.createDataFrame([(p, q.qid) for p, q in enumerate(queries)], "p int, qid int"))
    return rows.join(ids, "p").select("qid", *PLACE, "tie", "s.*")


def search(index: DataFrame, questions: Sequence[str], s: Search = Search()) -> DataFrame:
    """qid, rank, id, fileId, symbolName, startLine, endLine and the scores bm25, vector, fused and rerank of the best hits.

    Ranks are exact over all chunks: both lists are range-partitioned, no task holds one list. What is done a question is done for
    all questions together. Ties go by file, line, kind and id. No questions, questions without terms and an empty index give no hits.
    """
    spark = index.sparkSession
    queries = [r for r in query_terms(spark, [q.strip() for q in questions]).collect() if r.terms]
    schema = "qid int, rank int, id string, fileId string, symbolName string, startLine int, endLine int, bm25 double, vector double, fused double, rerank double"
    told = scores(index, queries, s) if queries else None
    if told is None:
        return spark.createDataFrame([], schema)
    # both lists of every question are ranked together: list 2 q is by words, 2 q + 1 by vectors
    lists = F.explode(F.array(F.struct((F.col("qid") * 2).alias("list"), F.col("bm25").alias("v")), F.struct((F.col("qid") * 2 + 1).alias("list"), F.col("vector").alias("v"))))
    places = ranked(told.select("*", lists.alias("l")).select("*", "l.*").drop("l").where("v > 0"), "list", [F.desc("v"), F.col("tie")])
    held = F.struct(*[c for c in PLACE if c != "id"], "tie", "bm25", "strong", "vector")
    fused = places.groupBy("qid", "id").agg(F.sum(1.0 / (F.lit(s.rrf) + F.col("rank"))).alias("fused"), F.first(held).alias("__c"))
    all_of = fused.select("qid", "id", "fused", "__c.*")
    lookup = spark.createDataFrame([(q.qid, q.question.lower(), list(q.terms)) for q in queries], "qid int, __asked string, __terms array<string>")
    all_of = all_of.join(F.broadcast(lookup), "qid").withColumn("__base", (F.col("fused") + F.least(F.coalesce("strong", F.lit(0)), F.lit(s.bonus_terms)) * s.bonus) * multiplier())
    place = F.row_number().over(Window.partitionBy("qid", "fileId").orderBy(F.desc("__base"), "tie"))
    adjusted = F.when(place > s.per_file, F.col("__base") * F.pow(F.lit(s.penalty), place - s.per_file)).otherwise(F.col("__base"))
    best = all_of.withColumn("__adjusted", adjusted)
    last = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("__adjusted"), F.desc("__base"), "tie"))
    return best.withColumn("rank", last).where(F.col("rank") <= s.limit).select(
        "qid", "rank", "id", "fileId", "symbolName", "startLine", "endLine",
        *[round6(F.coalesce(c, F.lit(0.0))).alias(n) for c, n in (("bm25", "bm25"), ("vector", "vector"), ("fused", "fused"), ("__adjusted", "rerank"))])


def _idf(df: int, total: int) -> float:
    return math.log(1 + (total - df + 0.5) / (df + 0.5))


def _scores(vectors: list[list[float]], worth: list[dict[str, tuple[float, bool]]], average: float, s: Search):
    """A function of the columns terms, length and vector: of each question the BM25 sum, the strong terms met and the cosine."""
    matrix = np.array(vectors).T
    kind = T.StructType([T.StructField("bm25", T.DoubleType()), T.StructField("strong", T.IntegerType()), T.StructField("vector", T.DoubleType())])

    @F.pandas_udf(T.ArrayType(kind))
    def scores(terms: pd.Series, lengths: pd.Series, column: pd.Series) -> pd.Series:
        rows = np.stack([np.zeros(len(matrix)) if v is None else np.asarray(v, float) for v in column]) if len(column) else np.zeros((0, len(matrix)))
        norm = np.linalg.norm(rows, axis=1, keepdims=True)
        near = np.round(np.clip(np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0) @ matrix, -1, 1), 9)
        out = []
        for held, n, cosines in zip(terms, lengths, near.tolist()):
            tfs = {t["term"]: t["tf"] for t in held} if held is not None else {}
            norm_of = s.k1 * (1 - s.b + s.b * (n or 0) / average)
            row = []
            for known, c in zip(worth, cosines):
                met = [(known[t], tf) for t, tf in tfs.items() if t in known] if tfs else []
                row.append({"bm25": round(sum(w * tf * (s.k1 + 1) / (tf + norm_of) for (w, _), tf in met), 9), "strong": sum(strong for (_, strong), _ in met), "vector": c})
            out.append(row)
        return pd.Series(out, dtype=object)

    return scores


def multiplier() -> Column:
    """What the symbol's name, the path and the kind of a chunk add: a name in the question triples, a common prefix doubles."""
    name, path, long = F.lower(F.coalesce("symbolName", F.lit(""))), F.lower("fileId"), F.filter("__terms", lambda t: F.length(t) >= 3)
    prefix = (F.length(name) >= 3) & F.exists(long, lambda t: name.startswith(t) | t.startswith(name))
    parts = F.filter(F.split(path, r"[^a-z0-9]+"), lambda p: F.length(p) >= 3)
    on_path = F.exists(long, lambda t: path.contains(t) | F.exists(parts, lambda p: t.startswith(p)))
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in KIND_WEIGHT.items() for x in kv])[F.col("kind")], F.lit(1.0))
    return F.when(has_word(F.col("__asked"), name), 3.0).when(prefix, 2.0).otherwise(1.0) * F.when(on_path, 1.5).otherwise(1.0) * kind


def answer(index: DataFrame, question: str, s: Search = Search()) -> dict:
    """The cited answer to a question, or the plain statement that there is no evidence: a question none of whose strong or weak
    terms, nor a full symbol name, stands in a hit has no citations. At most `limit` chunks reach the driver."""
    hits = [r.asDict() for r in search(index, [question], s).orderBy("rank").collect()]
    reply = {"question": question, "answer": "", "citations": [], "confidence": "low", "mode": "extractive", "notes": []}
    if not hits:
        return reply | {"answer": "No evidence in the index.", "notes": ["no chunk was hit"]}
    terms = list(query_terms(index.sparkSession, [question.strip()]).first().terms)
    held = F.explode(F.filter("terms", lambda t: t["term"].isin(terms))).alias("t")
    total, known = index.count(), dict(index.select(held).groupBy("t.term").agg(F.count(F.lit(1)).alias("df")).collect())
    pairs = index.sparkSession.createDataFrame([(0, t, known.get(t)) for t in terms], "qid int, term string, df bigint")
    classes = classify_terms(pairs, total, s).collect()
    texts = {r.id: r for r in index.where(F.col("id").isin([h["id"] for h in hits])).select("id", F.col("terms.term").alias("words"), "text").collect()}
    found = lambda t: any(t in (r.words or ()) for r in texts.values())
    strong = [c.term for c in classes if c["class"] == "strong" and found(c.term)]
    weak = [c.term for c in classes if c["class"] == "weak" and found(c.term)]
    import re

    low = question.lower()
    exact = any(h["symbolName"] and re.search(rf"(?<![a-z0-9_$]){re.escape(h['symbolName'].lower())}(?![a-z0-9_$])", low) for h in hits)
    if not strong and not weak and not exact:
        near = "; ".join(dict.fromkeys(f"{h['fileId']}:{h['startLine']}" for h in hits[:3]))
        return reply | {"answer": f"No evidence in the index. Nearest, but no evidence: {near}", "notes": ["no telling term was hit"]}
    first = hits[0]["rerank"]
    if strong and exact and first >= 0.02 or len(strong) >= 2 and any(h["bm25"] > 0 for h in hits) and len(hits) >= 3 and first >= 0.03:
        confidence = "high"
    else:
        confidence = "medium" if first >= 0.015 else "low"
    cites = [{"path": h["fileId"], "line": h["startLine"], "symbol": h["symbolName"], "score": h["rerank"], "text": " ".join((texts[h["id"]].text or "").split())[:220]} for h in hits]
    lines = [f"{n}. {h['symbolName'] or h['fileId']} ({h['fileId']}:{h['startLine']})" for n, h in enumerate(hits, 1)]
    lead = "Most relevant" if confidence != "low" else "Possibly relevant, but too little evidence"
    return reply | {"answer": lead + ":\n" + "\n".join(lines), "citations": cites, "confidence": confidence, "notes": [f"terms hit: {', '.join([*strong, *weak][:8])}"]}
