"""Queries of the smaller operators: fused and penalised rankings, suffixes, layers, classes of query terms, text measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators import records as R
from ..operators import retrieval as S
from ..operators import rules
from ..operators import validate as V
from ..operators.flows import configuration
from ..operators.ranking import ranked, reciprocal_ranks, top
from ..session import stored
from ..sources.tables import current_rows, table
from .code import CHUNKS, DEGREES, FILE_EDGES, FILES, IMPORTS, MODULE_EDGES, SYMBOLS, _NAMED, _WORDS, file_edges, files, imports, module_edges, symbols

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH a AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part), b AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part WHERE p_size > 20),
f AS (SELECT p_brand, p_partkey, round(sum(1.0 / (60 + k)), 9) AS fused FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY fused DESC, p_partkey) AS rank FROM f) SELECT p_brand, p_partkey, fused, rank FROM r WHERE rank <= 5""")
def fused_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Two rankings of each brand's parts, fused by reciprocal ranks; the five best."""
    part = table(spark, folder, "part")
    a = ranked(part.select("p_brand", "p_partkey", "p_retailprice"), "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")])
    b = ranked(part.where("p_size > 20").select("p_brand", "p_partkey", "p_size"), "p_brand", [F.desc("p_size"), F.col("p_partkey")])
    fused = reciprocal_ranks([a, b], "p_brand", "p_partkey").withColumn("fused", F.round("fused", 9))
    return top(fused, "p_brand", [F.desc("fused"), F.col("p_partkey")], 5)


@query("""WITH s AS (SELECT doc_id, source, coalesce(length(text), 0) AS base FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY base DESC, doc_id) AS n FROM s),
a AS (SELECT doc_id, source, round(CASE WHEN n > 2 THEN base * pow(0.85, n - 2) ELSE base END, 6) AS adjusted FROM p) SELECT doc_id, source, adjusted FROM a ORDER BY adjusted DESC, doc_id LIMIT 50""")
def penalised_sources(spark, folder):
    """The longest documents, each source's third and further ones weighed down; only the 50 best of a source can matter."""
    docs = table(spark, folder, "documents").select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).alias("base"))
    place = top(docs.withColumn("__g", F.coalesce("source", F.lit(""))), "__g", [F.desc("base"), F.col("doc_id")], 50)
    n = F.col("rank")
    adjusted = F.round(F.when(n > 2, F.col("base") * F.pow(F.lit(0.85), n - 2)).otherwise(F.col("base").cast("double")), 6)
    return place.select("doc_id", "source", adjusted.alias("adjusted")).orderBy(F.desc("adjusted"), "doc_id").limit(50)


@query(f"WITH {SYMBOLS}, r AS (SELECT id, fileId || '#' || name AS short, row_number() OVER (PARTITION BY fileId, name ORDER BY line, id) AS k FROM s) SELECT id, CASE WHEN k = 1 THEN short ELSE short || '#' || k END AS short FROM r")
def short_ids(spark, folder):
    """file#name, numbered from the second symbol of a name on."""
    k = F.row_number().over(Window.partitionBy("fileId", "name").orderBy("line", "id"))
    short = F.concat("fileId", F.lit("#"), "name")
    return symbols(spark, folder).withColumn("k", k).select("id", F.when(F.col("k") == 1, short).otherwise(F.concat(short, F.lit("#"), F.col("k").cast("string"))).alias("short"))


@query(_NAMED + f", {SYMBOLS}, y AS (SELECT moduleId, count(*) AS symbols FROM s GROUP BY 1), m AS (SELECT moduleId, count(*) AS files, sum(coalesce(loc, 0)) AS loc, CASE WHEN bool_or(kind = 'test') THEN 'test' WHEN bool_or(kind = 'source') THEN 'source' ELSE min(kind) END AS layer FROM g GROUP BY 1) SELECT layer, count(*) AS modules, sum(files) AS files, sum(loc) AS loc, sum(coalesce(symbols, 0)) AS symbols FROM m LEFT JOIN y USING (moduleId) GROUP BY layer")
def layers(spark, folder):
    f = files(spark, folder)
    layer = F.when(F.bool_or(F.col("kind") == "test"), "test").when(F.bool_or(F.col("kind") == "source"), "source").otherwise(F.min("kind"))
    m = f.groupBy("moduleId").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("loc", F.lit(0))).alias("loc"), layer.alias("layer"))
    n = symbols(spark, folder).groupBy("moduleId").agg(F.count(F.lit(1)).alias("symbols"))
    return m.join(n, "moduleId", "left").groupBy("layer").agg(F.count(F.lit(1)).alias("modules"), F.sum("files").alias("files"), F.sum("loc").alias("loc"), F.sum(F.coalesce("symbols", F.lit(0))).alias("symbols"))


@query(f"WITH {FILES}, {SYMBOLS}, {MODULE_EDGES}, {DEGREES}, m AS (SELECT moduleId AS id, sum(coalesce(loc, 0)) AS loc FROM f GROUP BY 1), n AS (SELECT moduleId AS id, count(*) AS symbols FROM s GROUP BY 1) SELECT id, coalesce(fan_in, 0) + coalesce(fan_out, 0) AS degree, loc, coalesce(symbols, 0) AS symbols FROM m LEFT JOIN d USING (id) LEFT JOIN n USING (id) ORDER BY (coalesce(fan_in, 0) + coalesce(fan_out, 0)) * 100000 + loc + 10 * coalesce(symbols, 0) DESC, id LIMIT 20")
def core_modules(spark, folder):
    m = files(spark, folder).groupBy(F.col("moduleId").alias("id")).agg(F.sum(F.coalesce("loc", F.lit(0))).alias("loc"))
    n = symbols(spark, folder).groupBy(F.col("moduleId").alias("id")).agg(F.count(F.lit(1)).alias("symbols"))
    rows = m.join(G.degrees(module_edges(spark, folder)), "id", "left").join(n, "id", "left").fillna(0, ["fan_in", "fan_out", "symbols"]).withColumn("degree", F.col("fan_in") + F.col("fan_out"))
    return rows.orderBy(F.desc(F.col("degree") * 100000 + F.col("loc") + 10 * F.col("symbols")), "id").limit(20).select("id", "degree", "loc", "symbols")


@query(f"WITH {IMPORTS}, e AS (SELECT moduleId AS a, CASE WHEN contains(target, '/') THEN regexp_replace(target, '/[^/]*$', '') ELSE '.' END AS b FROM i WHERE target IS NOT NULL), x AS (SELECT a, list_sort(list(DISTINCT b)) AS depends_on FROM e WHERE a <> b GROUP BY a), y AS (SELECT b, list_sort(list(DISTINCT a)) AS depended_on_by FROM e WHERE a <> b GROUP BY b) SELECT coalesce(x.a, y.b) AS id, coalesce(depends_on, []) AS depends_on, coalesce(depended_on_by, []) AS depended_on_by FROM x FULL JOIN y ON x.a = y.b")
def module_links(spark, folder):
    """Both lists of each module, sorted; an edge table has each pair once, so no set is built."""
    e = module_edges(spark, folder)
    out = e.groupBy(F.col("from").alias("id")).agg(F.sort_array(F.collect_list("to")).alias("depends_on"))
    back = e.groupBy(F.col("to").alias("id")).agg(F.sort_array(F.collect_list("from")).alias("depended_on_by"))
    none = F.array().cast("array<string>")
    return out.join(back, "id", "full_outer").select("id", F.coalesce("depends_on", none).alias("depends_on"), F.coalesce("depended_on_by", none).alias("depended_on_by"))


_TERMS = ["serialize", "token", "the", "id", "lock", "zzyzx", "return", "go"]


@query("WITH d AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), " + _WORDS.format("d") + ", q AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in _TERMS) + "]) AS term), df AS (SELECT token, count(DISTINCT id) AS df FROM k GROUP BY token), n AS (SELECT count(*) AS n FROM d) SELECT 0 AS qid, term, coalesce(df, 0) AS df, CASE WHEN coalesce(df, 0) = 0 THEN NULL WHEN df / n > 0.4 AND df > 3 THEN 'common' WHEN length(term) <= 2 THEN 'weak' ELSE 'strong' END AS class, 1.0::DOUBLE AS weight FROM q LEFT JOIN df ON term = token, n")
def term_classes(spark, folder):
    docs = table(spark, folder, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), X.tokenize(F.col("text")).alias("words"), "text")
    pairs = spark.createDataFrame([(0, t) for t in _TERMS], "qid int, term string")
    df = S.postings(docs, _TERMS).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return S.classify_terms(pairs.join(df, "term", "left"), docs.count())


@query("SELECT vec_id, len(embedding) AS width, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_norms(spark, folder):
    v = F.col("embedding")
    return table(spark, folder, "embeddings").select("vec_id", F.size(v).alias("width"), F.round(F.sqrt(X.dot(v, v)), 6).alias("norm"))


@query("SELECT doc_id, (length(text) - length(replace(text, 'lock', ''))) // 4 AS locks, regexp_matches(lower(text), '(^|[^a-z0-9_$])token([^a-z0-9_$]|$)') AS has_token, CASE WHEN length(text) > 40 THEN left(text, 39) || '…' ELSE text END AS head FROM documents")
def text_measures(spark, folder):
    t = F.col("text")
    return table(spark, folder, "documents").select("doc_id", X.occurrences(t, F.lit("lock")).alias("locks"), X.has_word(F.lower(t), F.lit("token")).alias("has_token"), X.clip(t, 40).alias("head"))


@query(f"WITH {IMPORTS} SELECT id, nullif(CASE WHEN starts_with(trim(specifier), '@') THEN CASE WHEN regexp_matches(trim(specifier), '^@[^/]*/') THEN regexp_extract(trim(specifier), '^(@[^/]*/[^/]*)', 1) ELSE trim(specifier) END ELSE regexp_extract(trim(specifier), '^([^/.]*)', 1) END, '') AS package, len(string_split(specifier, '/')) AS depth FROM i")
def import_packages(spark, folder):
    s = F.col("specifier")
    return imports(spark, folder).select("id", F.nullif(X.package_of(s), F.lit("")).alias("package"), F.size(F.split(s, "/")).alias("depth"))


@query("WITH h AS (SELECT text, count(*) AS copies, min(doc_id) AS first FROM documents WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY text HAVING count(*) > 1) SELECT first, copies FROM h")
def repeated_texts(spark, folder):
    """Groups of equal texts. Grouped by two hashes and the length, so that no text is shuffled."""
    docs = table(spark, folder, "documents").where("text IS NOT NULL AND trim(text) != ''")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("a"), F.md5("text").alias("b"), F.length("text").alias("n"))
    return keyed.groupBy("a", "b", "n").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("first", "copies")


_STEP = "CASE WHEN regexp_matches(name, '(?i)^(?:save|insert|update|delete|remove|create|write|send|publish|emit|store|put|post|patch|push|dispatch)') THEN 'side-effect' WHEN regexp_matches(name, '(?i)^(?:get|find|fetch|load|read|query|select|list|search|lookup)') THEN 'data' ELSE 'call' END"


@query(f"WITH {SYMBOLS} SELECT {_STEP} AS step, lower(kind) AS kind, count(*) AS symbols FROM s WHERE name IS NOT NULL GROUP BY ALL")
def step_kinds(spark, folder):
    """What the functions do, by the verb their name begins with."""
    n = F.col("name")
    step = F.when(n.rlike("(?i)^(?:save|insert|update|delete|remove|create|write|send|publish|emit|store|put|post|patch|push|dispatch)"), "side-effect").when(n.rlike("(?i)^(?:get|find|fetch|load|read|query|select|list|search|lookup)"), "data").otherwise("call")
    return symbols(spark, folder).where("name IS NOT NULL").groupBy(step.alias("step"), F.lower("kind").alias("kind")).agg(F.count(F.lit(1)).alias("symbols"))


@query("""WITH c AS (SELECT source, trim(lower(lang)) AS lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY n DESC) AS k FROM c)
SELECT source, CASE WHEN count(*) > 1 THEN 'mixed' ELSE min(lang) END AS lang FROM r WHERE k = 1 GROUP BY source""")
def source_languages(spark, folder):
    """The language most documents of a source have, `mixed` for a tie."""
    return R.mode_or_mixed(table(spark, folder, "documents").select("source", F.trim(F.lower("lang")).alias("lang")), "source", "lang")


@query(f"WITH RECURSIVE {FILE_EDGES}, r AS (SELECT DISTINCT a AS id, 0 AS depth FROM e WHERE regexp_matches(a, '(?i)/test/|_test\\.') UNION SELECT e.b, depth + 1 FROM r JOIN e ON r.id = e.a WHERE depth < 12) SELECT id, min(depth) AS depth FROM r GROUP BY id")
def reach_depths(spark, folder):
    starts = file_edges(spark, folder).select(F.col("from").alias("id")).where(r"id RLIKE '(?i)/test/|_test\\.'").distinct()
    return G.reachable(starts, file_edges(spark, folder))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, count(DISTINCT user_id) AS users, max(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY event_type")
def event_stats(spark, folder):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.countDistinct("user_id").alias("users"), F.max(k).alias("most"))


#: Configuration and its readers, planted, as no file of the tables imports any: (reader, configuration, line).
READERS = [("src/b.js", "conf/app.json", 4), ("src/a.js", "conf/app.json", 9), ("src/a.js", "conf/app.json", 2), ("conf/app.json", "conf/app.json", 1), ("src/c.js", "src/a.js", 1), ("src/d.js", "settings.yaml", 7)]
_READERS = ", ".join(f"('{a}', '{b}', {n})" for a, b, n in READERS)


@query(_NAMED + f", {IMPORTS}, x AS (SELECT fileId, target, line FROM i UNION ALL SELECT * FROM (VALUES {_READERS}) t(fileId, target, line)), cfg AS (SELECT id FROM g WHERE kind = 'config' UNION SELECT unnest(['conf/app.json', 'settings.yaml'])), u AS (SELECT target, fileId, min(line) AS line FROM x JOIN cfg ON target = cfg.id WHERE fileId <> target GROUP BY ALL) SELECT target AS id, count(*) AS readers, min(fileId) AS first_reader, arg_min(line, fileId)::INT AS first_line FROM u GROUP BY target")
def import_readers(spark, folder):
    """The readers of configuration files, those of the tables and planted ones."""
    rows = spark.createDataFrame(READERS, "fileId string, target string, line int")
    names = spark.createDataFrame([("conf/app.json",), ("settings.yaml",)], "id string")
    planted = names.select("id", rules.file_kind(F.col("id"), rules.language_of(F.col("id"))).alias("kind"))
    found = configuration(files(spark, folder).select("id", "kind").unionByName(planted), imports(spark, folder).select("fileId", "target", "line").unionByName(rows))
    return found.select("id", "readers", F.col("first.fileId").alias("first_reader"), F.col("first.line").alias("first_line"))


@query(f"WITH {SYMBOLS}, n AS (SELECT doc_id, unnest(regexp_extract_all(text, '`([A-Za-z_$][A-Za-z0-9_$]{{1,80}})`', 1)) AS name FROM documents) SELECT doc_id, name, count(*) AS mentions, CASE WHEN name IN (SELECT name FROM s WHERE name IS NOT NULL) THEN 'ok' ELSE 'unknown symbol' END AS verdict FROM n GROUP BY doc_id, name")
def backticked_names(spark, folder):
    return V.named(table(spark, folder, "documents"), "doc_id", symbols(spark, folder))


@query(f"""WITH {CHUNKS}, b AS (SELECT *, count(*) OVER (PARTITION BY fileId) AS n, row_number() OVER (PARTITION BY fileId ORDER BY startLine, id) - 1 AS k, first(kind) OVER (PARTITION BY fileId ORDER BY startLine, id) AS body, row_number() OVER (PARTITION BY fileId ORDER BY greatest(endLine - startLine, 0) DESC, startLine, id) AS w FROM c WHERE kind <> 'file-header'),
h AS (SELECT DISTINCT fileId FROM c WHERE kind = 'file-header'), r AS (SELECT b.*, CASE WHEN h.fileId IS NULL THEN 0 ELSE 1 END AS head FROM b LEFT JOIN h USING (fileId))
SELECT id FROM c WHERE kind = 'file-header' UNION ALL SELECT id FROM r WHERE n + head <= 5 OR CASE WHEN body IN ('config', 'doc') THEN k IN (SELECT floor(i * (n - 1) / (4.0 - head) + 0.5) FROM range(0, 5 - head) t(i)) ELSE w <= 5 - head END""")
def capped_chunks(spark, folder):
    """At most five chunks of each file."""
    return R.cap_chunks(current_rows(table(spark, folder, "chunks"), ["fileId", "kind", "startLine", "endLine"]), 5).select("id")


@query(f"""WITH {SYMBOLS}, u AS (SELECT fileId, name, min(id) AS symbol FROM s GROUP BY fileId, name HAVING count(*) = 1),
e AS (SELECT u.symbol AS a, s.id AS b, count(*) AS weight FROM s JOIN u ON s.fileId = u.fileId AND s.parent = u.name WHERE u.symbol <> s.id GROUP BY ALL), {DEGREES} SELECT id, fan_in, fan_out FROM d ORDER BY fan_in + fan_out DESC, id LIMIT 1500""")
def symbol_nodes(spark, folder):
    """The graph of symbols and those they hold: its 1500 nodes with most neighbours."""
    all_of = stored(symbols(spark, folder).select("id", "fileId", "name", "parent"))
    above = R.unique_names(all_of).withColumnRenamed("name", "parent")
    return G.densest(G.weighted_edges(all_of.select("id", "fileId", "parent").join(above, ["fileId", "parent"]), "symbol", "id"))[0]


@query("SELECT vec_id, list_slice(list_concat(embedding::DOUBLE[], list_transform(range(0, 200), lambda x: 0.0::DOUBLE)), 1, len(embedding) + 6) AS wide, (embedding::DOUBLE[])[:5] AS short FROM embeddings")
def padded_vectors(spark, folder):
    rows = table(spark, folder, "embeddings")
    width = rows.select(F.max(F.size("embedding")).alias("n")).first().n or 1
    return rows.select("vec_id", X.padded(F.col("embedding"), width + 6).alias("wide"), X.padded(F.col("embedding"), 5).alias("short"))


@query(f"WITH {CHUNKS}, t AS (SELECT id, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS p FROM c) SELECT id, (p - 1) // 50 AS batch, count(*) AS n, count(w) AS known, min(w) AS first FROM t GROUP BY ALL")
def token_batches(spark, folder):
    """The tokens of each chunk in batches of fifty."""
    now = current_rows(table(spark, folder, "chunks"), ["tokens"])
    parts = now.select("id", F.posexplode(X.batches(F.col("tokens"), 50)).alias("batch", "b"))
    return parts.select("id", F.col("batch").cast("bigint").alias("batch"), F.size("b").cast("bigint").alias("n"), F.size(F.array_compact("b")).cast("bigint").alias("known"), F.array_min(F.array_compact("b")).alias("first"))
