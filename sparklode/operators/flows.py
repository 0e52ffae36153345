"""What a program does from end to end: flows from routes, entry points and exported functions, and configuration with its readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import walks
from .ranking import top

#: How many flows of each kind a list shows, and in all.
CAPS = {"http": 12, "cli": 6, "event": 6, "library": 8, "data": 4}
OVERALL = 36


def call_order(calls: DataFrame) -> DataFrame:
    """Edges between symbols with the place of the first call as their rank; a call of itself leads nowhere."""
    kept = calls.where("from_symbol IS NOT NULL AND to_symbol IS NOT NULL AND from_symbol != to_symbol")
    return kept.groupBy(F.col("from_symbol").alias("from"), F.col("to_symbol").alias("to")).agg(F.min(F.struct("line", "callee")).alias("rank"))


def starts(routes: DataFrame, symbols: DataFrame, entries: DataFrame, kinds: tuple[str, ...] = ("function", "method", "component", "route-handler")) -> DataFrame:
    """id (a symbol), kind and name of every place a flow begins: handlers of routes, the main function of entry files, exported
    functions that nothing calls but that call others. A symbol with several roles keeps the first of these."""
    by_route = routes.where("handlerId IS NOT NULL").select(F.col("handlerId").alias("id"), F.when(F.col("method") == "EVENT", "event").otherwise("http").alias("kind"), F.concat_ws(" ", "method", "path").alias("name"), F.lit(0).alias("o"))
    callable_ = symbols.where(F.col("kind").isin(*kinds))
    main = callable_.join(entries.select(F.col("path").alias("fileId")).distinct(), "fileId", "left_semi").where(F.col("name").rlike(r"(?i)^(?:main|run|start|bootstrap|cli|handler|serve|init)\z"))
    free = callable_.where(F.col("exported") & (F.col("fanIn") == 0) & (F.col("fanOut") > 0))
    all_of = by_route.unionByName(main.select("id", F.lit("cli").alias("kind"), "name", F.lit(1).alias("o"))).unionByName(free.select("id", F.lit("library").alias("kind"), "name", F.lit(2).alias("o")))
    return all_of.groupBy("id").agg(F.min(F.struct("o", "name", "kind")).alias("s")).select("id", "s.kind", "s.name")


def data_flows(files: DataFrame, imports: DataFrame, symbols: DataFrame, steps: int = 24) -> DataFrame:
    """The flows from configuration to its readers, in the form of `detect`: start is `data:` with the path, step 1 the file itself, then
    its readers by path, each with the line of its import and its file's first symbol. That a name is imported is a weak sign, so
    confidence is low."""
    config = files.where("kind = 'config'").select(F.col("id").alias("target"))
    used = imports.where("target IS NOT NULL").join(config, "target", "left_semi").groupBy("target", "fileId").agg(F.min("line").alias("line"))
    first = symbols.groupBy("fileId").agg(F.min_by("id", F.struct("line", "id")).alias("id"))
    few = top(used, "target", [F.col("fileId")], steps - 1).join(first, "fileId", "left")
    step = F.struct((F.col("rank") + 1).cast("int").alias("order"), "id", F.lit(1).alias("depth"), F.concat_ws(":", "fileId", F.col("line").cast("string")).alias("evidence"))
    origin = F.struct(F.lit(1).alias("order"), F.lit(None).cast("string").alias("id"), F.lit(0).alias("depth"), F.concat("target", F.lit(":1")).alias("evidence"))
    whole = few.groupBy("target").agg(F.sort_array(F.collect_list(step)).alias("readers"))
    return whole.select(F.concat(F.lit("data:"), "target").alias("start"), F.lit("data").alias("kind"), F.col("target").alias("name"), F.lit("low").alias("confidence"), F.concat(F.array(origin), "readers").alias("steps"))


def detect(routes: DataFrame, symbols: DataFrame, calls: DataFrame, entries: DataFrame, depth: int = 5, steps: int = 24, data: DataFrame | None = None) -> DataFrame:
    """start, kind, name, confidence and steps (order, id, depth, evidence) of the flows, the longest of each kind up to its cap;
    `data` are the flows of `data_flows`.

    Confidence follows from the resolved steps after the start: three make it high, one medium.
    """
    begun = starts(routes, symbols, entries)
    met = walks(begun.select("id"), call_order(calls), depth, steps).join(symbols.select("id", "fileId", "line"), "id", "left")
    step = F.struct(F.col("step").alias("order"), "id", "depth", F.concat_ws(":", "fileId", F.col("line").cast("string")).alias("evidence"))
    whole = met.groupBy("start").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    n = F.size("steps") - 1
    rows = whole.join(begun, F.col("start") == F.col("id")).select("start", "kind", "name", F.when(n >= 3, "high").when(n >= 1, "medium").otherwise("low").alias("confidence"), "steps")
    rows = rows if data is None else rows.unionByName(data)
    kept = top(rows, "kind", [F.desc(F.size("steps")), F.col("start")], max(CAPS.values()))
    cap = F.create_map(*[F.lit(x) for kv in CAPS.items() for x in kv])[F.col("kind")]
    return kept.where(F.col("rank") <= cap).orderBy("kind", "rank").limit(OVERALL).drop("rank")


def configuration(files: DataFrame, imports: DataFrame) -> DataFrame:
    """id of each configuration file that is imported, its readers, how many they are and the line where the first reads it."""
    config = files.where("kind = 'config'").select(F.col("id").alias("target"))
    used = imports.where("target IS NOT NULL AND target != fileId").join(config, "target", "left_semi")
    pairs = used.groupBy("target", "fileId").agg(F.min("line").alias("line"))
    return pairs.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("readers"), F.min(F.struct("fileId", "line")).alias("first"))


def related(hits: DataFrame, symbols: DataFrame, flows: DataFrame, symbol_limit: int = 8, flow_limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """Symbols of the files that were hit, those hit themselves first, and flows with a step in them. `hits` is a result list; `flows`
    is a table of steps (start, name, evidence) or of whole flows with their steps."""
    files = hits.select("fileId").distinct()
    near = symbols.join(files, "fileId", "left_semi").join(hits.select(F.col("symbolName").alias("name"), F.lit(0).alias("__hit")).distinct(), "name", "left")
    near = near.orderBy(F.coalesce("__hit", F.lit(1)), "fileId", "line", "id").limit(symbol_limit).select("id", "name", "fileId", "line")
    steps = flows.select("start", "name", F.explode("steps").alias("s")).select("start", "name", "s.evidence") if "steps" in flows.columns else flows.select("start", "name", "evidence")
    stepped = steps.withColumn("fileId", F.regexp_extract("evidence", r"^(.*):\d+\z", 1))
    return near, stepped.join(files, "fileId", "left_semi").select("start", "name").distinct().orderBy("start").limit(flow_limit)
