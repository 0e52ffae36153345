"""The queries of problems 2 to 10, with SQL where SQL can give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from ..sources.tables import settled, table
from . import bpe, credentials, docs, handwritten, packing, splitting, terms, topics

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = credentials.scan(table(spark, folder, "chunks"))
    return found.select("id", F.explode(F.array_distinct(F.col("spans.line_no"))).alias("line_no"))


@query
def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.redact_rows(settled(table(spark, folder, "chunks"), ["fileId", "text"]))


@query
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, folder, "documents"))


@query
def p9_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), table(spark, folder, "size_limits"))


@query
def p9_faults(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of p9_packed."""
    limits = table(spark, folder, "size_limits")
    return packing.faults(stored(p9_packed(spark, folder)), limits)


ORACLES["p9_faults"] = "SELECT applies_to, max_size AS capacity, (SELECT count(*) FROM documents) AS items, 0::BIGINT AS overfull, 0::BIGINT AS misplaced, 0::BIGINT AS divided FROM size_limits WHERE applies_to LIKE 'container.%'"


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_pieces(spark, folder).where("piece = 0").select("id")


@query
def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(table(spark, folder, "chunks"), table(spark, folder, "size_limits"))


ORACLES["p6_found"] = """
WITH now AS (SELECT id, kind, text, row_number() OVER (PARTITION BY id ORDER BY seenAt DESC NULLS LAST) AS k FROM chunks WHERE id IS NOT NULL)
SELECT id FROM now JOIN size_limits ON applies_to = 'chunks.' || kind WHERE k = 1 AND unit = 'characters' AND length(text) > max_size"""


@query
def p6_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """The oversized texts put together again from p6_pieces."""
    return splitting.rebuilt(p6_pieces(spark, folder))


ORACLES["p6_rebuilt"] = """
WITH now AS (SELECT id, kind, text, row_number() OVER (PARTITION BY id ORDER BY seenAt DESC NULLS LAST) AS k FROM chunks WHERE id IS NOT NULL)
SELECT id, length(text)::INT AS characters, md5(text) AS digest FROM now JOIN size_limits ON applies_to = 'chunks.' || kind WHERE k = 1 AND unit = 'characters' AND length(text) > max_size"""


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return terms.most_distinctive(terms.records(table(spark, folder, "chunks"))).select("id", "term")


@query
def p4_weights(spark: SparkSession, folder: str) -> DataFrame:
    scored, names, total = terms.score_terms(terms.records(table(spark, folder, "chunks")))
    return scored.join(names, "rid").select("id", "term", "tf", "df", F.round("elite", 6).alias("elite"), terms.tf_idf(total).alias("tfidf"))


@query
def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """What of p4_weights SQL can give: all but the posterior."""
    return p4_weights(spark, folder).drop("elite")


@query
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    marked = terms.marked_terms(terms.records(table(spark, folder, "chunks")))
    return marked.where("mark IS NOT NULL").select(F.col("ngram")[0].alias("term"), "mark")


@query
def p7_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    marked = terms.marked_terms(terms.records(table(spark, folder, "chunks")), (1, 2, 3))
    return marked.select(F.array_join("ngram", " ").alias("ngram"), F.size("ngram").alias("n"), "occurrences", "records", "mark")


_TERMS = """
WITH now AS (SELECT id, tokens, row_number() OVER (PARTITION BY id ORDER BY seenAt DESC NULLS LAST) AS k FROM chunks WHERE id IS NOT NULL),
words AS (SELECT id, lower(trim(t)) AS term FROM (SELECT id, unnest(tokens) AS t FROM now WHERE k = 1) WHERE t IS NOT NULL AND trim(t) <> ''),
tfs AS (SELECT id, term, count(*) AS tf FROM words GROUP BY id, term),
dfs AS (SELECT term, count(*) AS df, sum(tf) AS occurrences FROM tfs GROUP BY term),
total AS (SELECT count(DISTINCT id) AS n FROM words)
"""
ORACLES["p4_found"] = _TERMS + """, ranked AS (
  SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY round(tf * ln(n::DOUBLE / df), 6) DESC, term) AS r FROM tfs JOIN dfs USING (term), total WHERE df >= 2)
SELECT id, term FROM ranked WHERE r = 1"""
ORACLES["p4_counts"] = _TERMS + "SELECT id, term, tf, df, round(tf * ln(n::DOUBLE / df), 6) AS tfidf FROM tfs JOIN dfs USING (term), total"
ORACLES["p7_found"] = _TERMS + "SELECT term, CASE WHEN df <= 2 THEN 'rare' ELSE 'common' END AS mark FROM dfs, total WHERE df <= 2 OR df > n / 4.0"

ORACLES["p7_ngrams"] = _TERMS + """, lists AS (SELECT id, list_filter(list_transform(tokens, lambda t: lower(trim(t))), lambda t: t IS NOT NULL AND t <> '') AS w FROM now WHERE k = 1),
grams AS (SELECT id, k.n AS n, unnest(list_transform(range(1, len(w) - k.n + 2), lambda i: list_slice(w, i, i + k.n - 1))) AS g FROM lists, (SELECT unnest([1, 2, 3]) AS n) k WHERE len(w) >= k.n)
SELECT array_to_string(g, ' ') AS ngram, grams.n::INT AS n, count(*) AS occurrences, count(DISTINCT id) AS records, CASE WHEN count(DISTINCT id) <= 2 THEN 'rare' WHEN count(DISTINCT id) > any_value(total.n) / 4.0 THEN 'common' END AS mark
FROM grams, total GROUP BY g, grams.n"""


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_files(spark, folder).where("why IS NOT NULL").select("id")


@query
def p3_files(spark: SparkSession, folder: str) -> DataFrame:
    files = handwritten.classify(table(spark, folder, "files"), table(spark, folder, "chunks"))
    return files.select("id", "language", "why", "by", "lines", "max_line", "run")


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return docs.pairs(table(spark, folder, "symbols")).where("id = doc_id").select("id")


@query
def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return docs.pairs(table(spark, folder, "symbols"))


@query
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_subjects(spark, folder).select("doc_id", "subject")


@query
def p10_subjects(spark: SparkSession, folder: str) -> DataFrame:
    return topics.subject_areas(*[table(spark, folder, name) for name in ("documents", "doc_labels", "subjects")])
