"""Checking that what a text claims with path:line#symbol exists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A reference: a path with an extension, its line or range of lines, and a symbol.
REFERENCE = r"([A-Za-z0-9_./@-]+\.[A-Za-z0-9]+):(\d+)(?:-(\d+))?(?:#([A-Za-z_$][\w$.]*))?"


def references(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, ref, path, line, endLine and symbol of every reference in the texts, in any number a text."""
    found = texts.select(key, F.explode(F.regexp_extract_all(text, F.lit(f"({REFERENCE})"), F.lit(1))).alias("ref"))
    part = lambda k: F.regexp_extract("ref", REFERENCE, k)
    number = lambda k: F.nullif(part(k), F.lit("")).try_cast("int")
    return found.select(key, "ref", part(1).alias("path"), number(2).alias("line"), number(3).alias("endLine"), F.nullif(part(4), F.lit("")).alias("symbol"))


#: A name in back-ticks.
NAMED = r"`([A-Za-z_$][A-Za-z0-9_$]{1,80})`"


def named(texts: DataFrame, key: str, symbols: DataFrame, text: str = "text") -> DataFrame:
    """key, name, mentions and verdict (ok or unknown symbol) of every name in back-ticks; a name is one row a text. A null text names
    nothing. The distinct names are joined, not the mentions."""
    found = texts.select(key, F.explode(F.regexp_extract_all(text, F.lit(NAMED), F.lit(1))).alias("name"))
    counted = found.groupBy(key, "name").agg(F.count(F.lit(1)).alias("mentions"))
    known = symbols.where("name IS NOT NULL").select("name", F.lit(True).alias("__known")).distinct()
    return counted.join(known, "name", "left").select(key, "name", "mentions", F.when(F.col("__known"), "ok").otherwise("unknown symbol").alias("verdict"))


def check(refs: DataFrame, files: DataFrame, symbols: DataFrame, slack: int = 0) -> DataFrame:
    """`refs` with verdict: ok, ambiguous (several symbols of the name), unknown path, unknown symbol or line out of range.

    A path counts as it is, else in lower case if only so it is found; a symbol counts by name or id. Three left joins on tables
    with each key once. Files without a positive loc have no last line.
    """
    exact = files.groupBy(F.col("id").alias("path")).agg(F.max("loc").alias("__loc"), F.lit(True).alias("__exact"))
    low = files.groupBy(F.lower("id").alias("__low")).agg(F.max("loc").alias("__loc2"), F.lit(True).alias("__loose"))
    names = symbols.select("id", "name").distinct()
    known = names.groupBy(F.col("name").alias("symbol")).agg(F.count(F.lit(1)).alias("__n")).unionByName(names.select(F.col("id").alias("symbol"), F.lit(1).cast("bigint").alias("__n")))
    known = known.groupBy("symbol").agg(F.max("__n").alias("__n"))
    rows = refs.join(exact, "path", "left").withColumn("__low", F.lower("path")).join(low, "__low", "left").join(known, "symbol", "left")
    loc = F.coalesce(F.when(F.col("__exact"), F.col("__loc")).otherwise(F.col("__loc2")), F.lit(0))
    beyond = lambda line: (line < 1) | ((loc > 0) & (line > loc + slack))
    verdict = (
        F.when(F.col("__exact").isNull() & F.col("__loose").isNull(), "unknown path")
        .when(F.col("symbol").isNotNull() & F.col("__n").isNull(), "unknown symbol").when(F.col("__n") > 1, "ambiguous")
        .when(F.coalesce(beyond(F.col("line")), F.lit(False)) | F.coalesce(beyond(F.col("endLine")), F.lit(False)), "line out of range").otherwise("ok"))
    return rows.withColumn("verdict", verdict).drop("__loc", "__exact", "__low", "__loc2", "__loose", "__n")


def check_claims(claims: DataFrame, files: DataFrame, symbols: DataFrame, require: bool = True) -> DataFrame:
    """`claims` (id, text, citations) with kept and reason: kept if it has text and all its citations stand; without citations
    only if none is required."""
    cites = claims.select("id", F.explode("citations").alias("c")).select("id", "c.path", "c.line", F.lit(None).cast("int").alias("endLine"), "c.symbol", F.lit("").alias("ref"))
    bad = check(cites, files, symbols).where(~F.col("verdict").isin("ok", "ambiguous")).groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("verdict")), "; ").alias("__bad"))
    empty, bare = F.coalesce(F.trim("text") == "", F.lit(True)), F.coalesce(F.size("citations"), F.lit(0)) <= 0
    reason = F.when(empty, "empty claim").when(bare & F.lit(require), "no citation").otherwise(F.col("__bad"))
    return claims.join(bad, "id", "left").select("id", "text", reason.isNull().alias("kept"), reason.alias("reason"))


def drop_rate(checked: DataFrame) -> DataFrame:
    """How many references there are, how many fail, and their share."""
    bad = F.count_if(~F.col("verdict").isin("ok", "ambiguous"))
    return checked.agg(F.count(F.lit(1)).alias("checked"), bad.alias("dropped"), F.round(bad / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("drop_rate"))


def sanitize(texts: DataFrame, key: str, files: DataFrame, symbols: DataFrame, text: str = "text") -> DataFrame:
    """`texts` without the sentences that cite what does not exist, and `dropped`, how many those were. A sentence ends at a line
    end or behind a full stop, question or exclamation mark that white space or a wide character follows."""
    pieces = texts.select(key, F.posexplode(F.split(text, r"(?<=[。！？!?\n])|(?<=\.\s)")).alias("p", "text"))
    refs = references(pieces.withColumn("__k", F.struct(key, "p")), "__k")
    bad = check(refs, files, symbols).where(~F.col("verdict").isin("ok", "ambiguous")).select("__k").distinct().select(F.col(f"__k.{key}").alias(key), "__k.p", F.lit(True).alias("__bad"))
    rows = pieces.join(bad, [key, "p"], "left")
    kept = F.transform(F.sort_array(F.collect_list(F.when(F.col("__bad").isNull(), F.struct("p", "text")))), lambda s: s["text"])
    return rows.groupBy(key).agg(F.array_join(kept, "").alias(text), F.count_if("__bad").alias("dropped"))
