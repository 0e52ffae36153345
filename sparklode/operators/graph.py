"""Weighted dependency graphs as edge tables (from, to, weight) and the algorithms over them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, stored

#: Edges up to which strongly connected components are found by one task; larger graphs take the distributed rounds.
LOCAL_EDGES = 1_000_000


def weighted_edges(links: DataFrame, source: str, target: str) -> DataFrame:
    """from, to and weight: how often each ordered pair occurs, without nulls and self-links. Counted before the shuffle."""
    kept = links.where(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != F.col(target)))
    return kept.groupBy(F.col(source).alias("from"), F.col(target).alias("to")).agg(F.count(F.lit(1)).alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, fan_in and fan_out: distinct neighbours, as an edge table has each pair once. One shuffle of both ends together."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("to").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("from").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def hubs(nodes: DataFrame, edges: DataFrame, limit: int = 30) -> DataFrame:
    """The nodes with most importers, then most imports, then by id."""
    ranked = nodes.join(degrees(edges), "id").orderBy(F.desc("fan_in"), F.desc("fan_out"), "id")
    return ranked.limit(limit)


def densest(edges: DataFrame, limit: int = 1500) -> tuple[DataFrame, DataFrame]:
    """The `limit` nodes with most neighbours (id, fan_in, fan_out; ties by id) and the edges among them: what a graph of symbols shows."""
    nodes = degrees(edges).orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "id").limit(limit)
    ids = nodes.select("id")
    return nodes, edges.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi")


def orphans(nodes: DataFrame, edges: DataFrame, entries: DataFrame | None = None, left_out: tuple[str, ...] = ("config", "docs", "asset", "infra")) -> DataFrame:
    """Nodes without any edge that are neither entries nor of a kind that is never imported."""
    kept = nodes if entries is None else nodes.join(entries.select("id"), "id", "left_anti")
    linked = edges.select(F.col("from").alias("id")).unionByName(edges.select(F.col("to").alias("id")))
    # the kind goes through a struct, so that a costly one is worked out once and not again for each comparison of the filter
    alone = kept.join(linked, "id", "left_anti").select("id", F.array(F.struct("kind")).alias("__k"))
    return alone.where(~F.coalesce(F.exists("__k", lambda k: k["kind"].isin(*left_out)), F.lit(False))).select("id")


def reachable(starts: DataFrame, edges: DataFrame, most: int = 1000) -> DataFrame:
    """id and depth of everything the starts lead to, themselves included at depth 0.

    Level by level: the frontier joins the edges, what was seen is taken out, and each level is written to the shared checkpoint
    folder, as the edges are once; what was seen is the levels read together, so nothing is written twice. A cycle ends by itself.
    """
    out = stored(edges.select(F.col("from").alias("__from"), F.col("to").alias("id")).distinct())
    level = stored(starts.select("id").where("id IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    paths = list(level.inputFiles())
    read = lambda: starts.sparkSession.read.schema(level.schema).parquet(*paths) if paths else level
    for depth in range(1, most + 1):
        found = level.select(F.col("id").alias("__from")).join(out, "__from").select("id").distinct()
        fresh = stored(found.join(read().select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            return read()
        paths += fresh.inputFiles()
        level = fresh
    raise RuntimeError(f"deeper than {most} levels")


def components(edges: DataFrame) -> DataFrame:
    """id and component, the smallest id of its strongly connected component, for every component of two or more nodes and every
    node with a link to itself. Up to LOCAL_EDGES, a checked size, one task walks the graph; beyond it `rounds` does."""
    pairs = edges.select("from", "to").where("`from` IS NOT NULL AND `to` IS NOT NULL").distinct()
    if pairs.limit(LOCAL_EDGES + 1).count() > LOCAL_EDGES:
        return rounds(pairs)
    kind = pairs.schema["from"].dataType.simpleString()
    return pairs.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(_walk, f"id {kind}, component {kind}")


def _walk(pairs: pd.DataFrame) -> pd.DataFrame:
    """Strongly connected components by two index counters and an explicit stack."""
    after: dict = {}
    loops = set()
    for a, b in zip(pairs["from"], pairs["to"]):
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
        if a == b:
            loops.add(a)
    index, low, stack, on, rows, count = {}, {}, [], set(), [], 0
    for root in sorted(after):
        if root in index:
            continue
        work = [(root, iter(sorted(after[root])))]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = count
                    count += 1
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(sorted(after[nxt]))))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(stack.pop())
                        on.discard(group[-1])
                    if len(group) > 1 or node in loops:
                        rows += [(g, min(group)) for g in group]
    return pd.DataFrame(rows, columns=["id", "component"])


def rounds(pairs: DataFrame) -> DataFrame:
    """The same components without ever bringing the graph together: nodes that only send or only receive are trimmed away, the
    smallest id that reaches a node colours it, and what leads back to a colour's own node within the colour is its component."""
    pairs = cut(pairs)
    done = cut(pairs.where("`from` = `to`").select(F.col("from").alias("id"), F.col("from").alias("component")))
    while True:
        while True:  # trim
            kept = pairs.join(pairs.select(F.col("from").alias("to")).distinct(), "to", "left_semi").join(pairs.select(F.col("to").alias("from")).distinct(), "from", "left_semi")
            kept = cut(kept)
            before, pairs = pairs.count(), kept
            if pairs.count() == before:
                break
        if pairs.isEmpty():
            return done.groupBy("id").agg(F.min("component").alias("component"))
        colour = cut(pairs.select(F.col("from").alias("id")).union(pairs.select("to")).distinct().withColumn("colour", F.col("id")))
        while True:
            sent = pairs.join(colour.withColumnRenamed("id", "from"), "from").groupBy(F.col("to").alias("id")).agg(F.min("colour").alias("sent"))
            moved = cut(colour.join(sent, "id", "left").select("id", F.least("colour", "sent").alias("colour"), (F.col("sent") < F.col("colour")).alias("m")))
            colour, changed = moved.select("id", "colour"), moved.where("m").limit(1).count()
            if not changed:
                break
        ends = pairs.join(colour.select(F.col("id").alias("from"), F.col("colour").alias("a")), "from").join(colour.select(F.col("id").alias("to"), F.col("colour").alias("b")), "to")
        inner = cut(ends.where("a = b").select("from", "to"))
        back = reachable(colour.where("id = colour").select("id"), inner.select(F.col("to").alias("from"), F.col("from").alias("to")))
        group = back.join(colour, "id").select("id", F.col("colour").alias("component"))
        sizes = group.groupBy("component").count().where("count > 1").select("component")
        done = cut(done.unionByName(group.join(sizes, "component", "left_semi").select("id", "component")))
        gone = cut(group.select("id"))
        pairs = cut(pairs.join(gone.withColumnRenamed("id", "from"), "from", "left_anti").join(gone.withColumnRenamed("id", "to"), "to", "left_anti"))


def cycles(edges: DataFrame, limit: int = 50) -> DataFrame:
    """The components as sorted member lists, largest first, then by the first member."""
    grouped = components(edges).groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("members"))
    return grouped.select("component", "members", F.size("members").alias("size")).orderBy(F.desc("size"), "component").limit(limit)


def walks(starts: DataFrame, edges: DataFrame, depth: int = 5, steps: int = 24) -> DataFrame:
    """start, step, id and depth: what a breadth-first walk from each start meets, each node once, at most `steps` of them with
    the start, in the order of the node they were reached from, then of the edges' `rank`.

    All walks go on together, a level at a time, so the number of joins is `depth` however many starts there are. The edges are
    stored once, as every level reads them.
    """
    edges = stored(edges.select("from", "to", "rank"))
    by = Window.partitionBy("start")
    seen = cut(starts.select(F.col("id").alias("start"), "id", F.lit(1).alias("step"), F.lit(0).alias("depth")).where("id IS NOT NULL").distinct())
    frontier = seen
    for level in range(1, depth + 1):
        found = frontier.select("start", F.col("id").alias("from"), F.col("step").alias("__parent")).join(edges.select("from", F.col("to").alias("id"), "rank"), "from")
        first = found.groupBy("start", "id").agg(F.min(F.struct("__parent", "rank", "id")).alias("__o")).join(seen.select("start", "id"), ["start", "id"], "left_anti")
        base = seen.groupBy("start").agg(F.max("step").alias("__last"))
        fresh = first.withColumn("__k", F.row_number().over(by.orderBy("__o"))).join(base, "start")
        fresh = cut(fresh.select("start", "id", (F.col("__last") + F.col("__k")).cast("int").alias("step"), F.lit(level).alias("depth")).where(F.col("step") <= steps))
        if fresh.isEmpty():
            break
        seen, frontier = cut(seen.unionByName(fresh)), fresh
    return seen.select("start", "step", "id", "depth")


def risk(modules: DataFrame, edges: DataFrame, in_cycle: DataFrame, limit: int | None = 20) -> DataFrame:
    """id, score up to 10 and reasons of modules: many dependants, a cycle, unresolved links, no tests, great size.

    `modules` has id, kind, loc, links, unresolved and has_test.
    """
    fan = edges.groupBy(F.col("to").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    rows = modules.join(fan, "id", "left").join(in_cycle.select("id", F.lit(True).alias("__cycle")).distinct(), "id", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0)))
    share = F.col("unresolved") / F.greatest(F.col("links"), F.lit(1))
    parts: list[tuple[Column, int, Column]] = [
        (F.col("fan_in") >= 10, 3, F.lit("many dependants")), ((F.col("fan_in") >= 5) & (F.col("fan_in") < 10), 2, F.lit("several dependants")), (F.coalesce("__cycle", F.lit(False)), 3, F.lit("on a dependency cycle")),
        ((share > 0.6) & (F.col("unresolved") >= 5), 2, F.lit("most links unresolved")), (~F.col("has_test") & F.col("kind").isin("source", "mixed"), 1, F.lit("no test file")), (F.col("loc") > 2000, 1, F.lit("large module")),
    ]
    score = sum((F.when(when, points).otherwise(0) for when, points, _ in parts), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(when, text) for when, _, text in parts]))
    out = rows.select("id", F.least(F.lit(10), score).alias("score"), reasons.alias("reasons")).where("score > 0").orderBy(F.desc("score"), "id")
    return out if limit is None else out.limit(limit)
