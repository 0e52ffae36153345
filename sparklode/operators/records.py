"""Joins, roll-ups, budgets and checks over the code records files, symbols and imports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Endings an import may leave out, and names that stand for a folder, in the order they are tried.
ENDINGS = ".ts .tsx .js .jsx .mjs .cjs .mts .cts .py .java .go .rs .rb .php .kt .kts .scala .swift .cs .vue .svelte".split()
STEMS = "index __init__ mod main".split()
FUNCTION_KINDS = ("function", "method", "component", "route-handler")


def mode_or_mixed(rows: DataFrame, key: str, value: str, ignore: Sequence[str] = ()) -> DataFrame:
    """key and the most frequent value, `mixed` where two are equally frequent. Values of `ignore` count only where there is
    nothing else. Counted per (key, value) before anything is ranked, so a key with a third of all rows is a few rows there."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"))
    minor = F.col(value).isin(*ignore) if ignore else F.lit(False)
    top = counts.groupBy(key).agg(F.max(F.struct((~minor).alias("m"), F.col("__n").alias("n"))).alias("__top"))
    best = counts.join(top, key).where(((~minor) == F.col("__top.m")) & (F.col("__n") == F.col("__top.n")))
    return best.groupBy(key).agg(F.when(F.count(F.lit(1)) > 1, "mixed").otherwise(F.min(value)).alias(value))


def module_rollup(files: DataFrame) -> DataFrame:
    """moduleId, files, loc, languages, language (single or mixed) and kind of each module's current files."""
    sums = files.groupBy("moduleId").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("loc", F.lit(0))).alias("loc"), F.countDistinct("language").alias("languages"),
        F.when(F.countDistinct("language") > 1, "mixed").otherwise(F.min("language")).alias("language"))
    return sums.join(mode_or_mixed(files, "moduleId", "kind", ("test", "generated")), "moduleId", "left")


def _importable(files: DataFrame) -> DataFrame:
    """base, k and target: the names each file (path, target) can be imported by, with the place of that form in the order of trials:
    0 as written, then without its ending, then as a folder that holds a stem with an ending."""
    endings = "|".join(e[1:] for e in ENDINGS)
    place = lambda names, c: F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k)])[c]
    part = lambda pattern, k: F.nullif(F.regexp_extract("path", pattern, k), F.lit(""))
    plain, folder = rf"\A(.+)(\.(?:{endings}))\z", rf"\A(.+)/({'|'.join(STEMS)})(\.(?:{endings}))\z"
    bare = F.when(part(plain, 1).isNotNull(), F.struct(part(plain, 1).alias("base"), (1 + place(ENDINGS, part(plain, 2))).alias("k")))
    held = F.when(part(folder, 1).isNotNull(), F.struct(part(folder, 1).alias("base"), (1 + len(ENDINGS) * (1 + place(STEMS, part(folder, 2))) + place(ENDINGS, part(folder, 3))).alias("k")))
    names = F.array_compact(F.array(F.struct(F.col("path").alias("base"), F.lit(0).alias("k")), bare, held))
    return files.select(F.explode(names).alias("n"), "target").select("n.base", "n.k", "target")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """id, target, external and package of each import.

    A relative specifier (or one from the root) becomes its candidate paths in order: as written, with each ending, as a folder
    with each stem and ending; a path in other letter case only counts where no exact one does. A dotted name is a path by
    itself, as a suffix that only one file has, or by the last part as a name that only one file has. What is left is external
    if it is no relative path. Candidates and suffixes are exploded, so that every step is an equi-join.
    """
    spec = F.trim("specifier")
    relative, rooted = spec.startswith("."), spec.startswith("/")
    folder = F.regexp_extract("fileId", r"\A(.*)/[^/]*\z", 1)
    raw = F.when(rooted, F.substring(spec, 2, 10_000)).otherwise(F.concat_ws("/", F.nullif(folder, F.lit("")), spec))
    stack = F.aggregate(
        F.split(raw, "/"), F.array().cast("array<string>"),
        lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    wanted = imports.where(relative | rooted).select("id", F.array_join(stack, "/").alias("base"))
    exact = _importable(files.select(F.col("id").alias("path"), F.col("id").alias("target"))).withColumn("loose", F.lit(0))
    lower = _importable(files.groupBy(F.lower("id").alias("path")).agg(F.min("id").alias("target"))).withColumn("loose", F.lit(1))
    both = wanted.join(exact, "base").unionByName(wanted.withColumn("base", F.lower("base")).join(lower, "base"))
    hit = both.groupBy("id").agg(F.min_by("target", F.struct("k", "loose")).alias("__path"))
    dotted = imports.where(~relative & ~rooted & spec.rlike(r"^[A-Za-z_][\w]*(?:\.\w+)+\z")).select("id", F.replace(spec, F.lit("."), F.lit("/")).alias("path"))
    stemmed = files.where(F.col("id").rlike(r"\.(?:java|kt|kts|scala|py)\z")).select("id", F.split(F.regexp_replace("id", r"\.\w+\z", ""), "/").alias("p"))
    suffixes = stemmed.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.array_join(F.slice("p", k, F.size("p") - k + 1), "/"))).alias("path"))
    unique = suffixes.groupBy("path").agg(F.min("id").alias("__dotted"), F.count(F.lit(1)).alias("n")).where("n = 1").select("path", "__dotted")
    named = dotted.join(unique, "path").select("id", "__dotted")
    out = imports.select("id", spec.alias("spec")).join(hit, "id", "left").join(named, "id", "left")
    target = F.coalesce("__path", "__dotted")
    away = target.isNull() & ~F.col("spec").startswith(".") & ~F.col("spec").startswith("/")
    from ..functions.text import package_of

    return out.select("id", target.alias("target"), F.coalesce(away, F.lit(False)).alias("external"), F.when(away, package_of(F.col("spec"))).alias("package"))


def innermost(points: DataFrame, spans: DataFrame, file: str = "fileId") -> DataFrame:
    """id of each point and the symbol of its file that encloses its line most tightly: shortest span, then latest start, then id.

    The file is the equi-key and the range a residual condition, so this is a hash join; the best is kept as an aggregate.
    """
    s = spans.where("line IS NOT NULL AND endLine IS NOT NULL").select(F.col(file).alias("__f"), F.col("line").alias("a"), F.col("endLine").alias("b"), F.col("id").alias("symbol"))
    inside = points.join(s, (F.col(file) == F.col("__f")) & (F.col("at") >= F.col("a")) & (F.col("at") <= F.col("b")))
    return inside.groupBy("id").agg(F.min(F.struct(F.col("b") - F.col("a"), -F.col("a"), "symbol")).alias("__o")).select("id", F.col("__o.symbol").alias("symbol"))


def next_within(points: DataFrame, marks: DataFrame, reach: int = 8, file: str = "fileId") -> DataFrame:
    """id of each point and the mark of its file that begins first at or after its line, at most `reach` lines on."""
    m = marks.select(F.col(file).alias("__f"), F.col("line").alias("a"), F.col("id").alias("symbol"))
    near = points.join(m, (F.col(file) == F.col("__f")) & (F.col("a") >= F.col("at")) & (F.col("a") <= F.col("at") + reach))
    return near.groupBy("id").agg(F.min(F.struct("a", "symbol")).alias("__o")).select("id", F.col("__o.symbol").alias("symbol"))


def unique_names(symbols: DataFrame) -> DataFrame:
    """fileId, name and the symbol of names that a file has once: what calls and routes may be bound to."""
    return symbols.groupBy("fileId", "name").agg(F.min("id").alias("symbol"), F.count(F.lit(1)).alias("n")).where("n = 1").select("fileId", "name", "symbol")


def bind_names(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """fileId, name, target and the symbol each imported name stands for; of imports of one name the last line counts, and a
    name the target has more than once stays unbound."""
    names = imports.where("target IS NOT NULL").select("fileId", F.explode("names").alias("name"), "target", "line", "id").where("name IS NOT NULL AND name != ''")
    last = names.groupBy("fileId", "name").agg(F.max_by("target", F.struct("line", "id")).alias("target"))
    bound = unique_names(symbols).select(F.col("fileId").alias("target"), "name", "symbol")
    return last.join(bound, ["target", "name"], "left").select("fileId", "name", "target", "symbol")


def bind_calls(calls: DataFrame, symbols: DataFrame, bound: DataFrame, builtins: DataFrame, external: DataFrame) -> DataFrame:
    """id, to_symbol and resolution of calls (id, fileId, callee).

    A bare name is the one symbol of that name in its file (`local`), else an imported name (`import`, with the target's symbol of
    that name if it is one), else `global` for a builtin, else `external`. Of a name with a receiver the receiver decides: a builtin,
    an external package, or an import, whose target's one symbol of the last name is meant. All else is `unresolved`. Left joins on
    tables that have each key once.
    """
    from ..functions.text import callee_tail

    one = unique_names(symbols)
    own = one.select("fileId", F.col("name").alias("__bare"), F.col("symbol").alias("__own"))
    via = bound.select("fileId", F.col("name").alias("__root"), F.col("target").alias("__target")).dropDuplicates(["fileId", "__root"])
    there = one.select(F.col("fileId").alias("__target"), F.col("name").alias("__tail"), F.col("symbol").alias("__there"))
    known = builtins.select(F.col("name").alias("__low"), F.lit(True).alias("__builtin")).distinct()
    away = external.select("fileId", F.col("name").alias("__root"), F.lit(True).alias("__away")).distinct()
    rows = calls.select("id", "fileId", callee_tail(F.col("callee")).alias("__tail"), "callee")
    bare = F.col("callee") == F.col("__tail")
    rows = rows.withColumn("__root", F.when(bare, F.col("__tail")).otherwise(F.regexp_extract("callee", r"^([^.:]+)", 1))).withColumn("__low", F.lower("__root")).withColumn("__bare", F.when(bare, F.col("__tail")))
    rows = rows.join(own, ["fileId", "__bare"], "left").join(via, ["fileId", "__root"], "left").join(there, ["__target", "__tail"], "left").join(known, "__low", "left").join(away, ["fileId", "__root"], "left")
    local, imported, named = F.col("__own").isNotNull(), F.col("__target").isNotNull(), F.col("__bare").isNotNull()
    how = (
        F.when(local, "local").when(named & imported, "import").when(F.coalesce("__builtin", F.lit(False)), "global").when(F.coalesce("__away", F.lit(False)), "external").when(imported, "import").otherwise("unresolved"))
    rows = rows.withColumn("resolution", how)
    return rows.select("id", F.coalesce("__own", F.when(F.col("resolution") == "import", F.col("__there"))).alias("to_symbol"), "resolution")


def diff(old: DataFrame, new: DataFrame, key: str = "id", value: str = "hash") -> DataFrame:
    """key and state: added, changed, removed or unchanged. Two nulls are equal."""
    a = old.select(F.col(key), F.col(value).alias("__old"), F.lit(True).alias("__a"))
    b = new.select(F.col(key), F.col(value).alias("__new"), F.lit(True).alias("__b"))
    state = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def dangling(child: DataFrame, foreign: str, parent: DataFrame, key: str = "id", name: str = "missing") -> DataFrame:
    """Rows of `child` whose foreign key no parent has."""
    return child.where(F.col(foreign).isNotNull()).join(parent.select(F.col(key).alias(foreign)).distinct(), foreign, "left_anti").select("id", F.lit(name).alias("problem"))


def duplicates(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def prefix_budget(rows: DataFrame, size: str, most: int, order: Sequence[Column]) -> DataFrame:
    """The rows in order until the sizes before a row reach `most`: a running sum over all rows.

    Partition sums are taken first, so that no task sees more than its own range of the order: rows are range-partitioned and
    sorted, each partition's total is one number, and only then the running sum is completed.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    from ..session import stored

    parts = stored(parts)
    before = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("__part").agg(F.sum(size).alias("__sum"))
    offset = totals.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    run = parts.join(F.broadcast(offset), "__part").withColumn("__run", F.col("__before") + F.coalesce(F.sum(size).over(before), F.lit(0)))
    return run.where(F.col("__run") < most).drop("__part", "__before", "__run")


def greedy_budget(rows: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """key of the rows that a first-fit pass in the order of size, largest first, then key, takes into `most`: one that doesn't fit
    is left out, smaller ones after it may still fit. Null and negative sizes are never taken.

    The pass goes in stretches: from the largest size that fits, everything is taken until a row does not fit. What room is left
    then is less than half of what there was, so there are at most log2(most) stretches; each is a sum by range partition and a
    running sum within the one partition where it ends. The driver holds a row a partition and a row a stretch.
    """
    from ..session import stored

    fits = rows.where(F.coalesce(F.col(size) <= most, F.lit(False)) & (F.col(size) >= 0))
    runs = fits.groupBy(F.col(size).cast("bigint").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    runs = stored(runs.repartitionByRange(F.desc("s")).withColumn("part", F.spark_partition_id()))
    room, cap, whole, partial = most, most, [], []
    while cap >= 0:
        left = runs.where(F.col("s") <= cap)
        sums = left.groupBy("part").agg(F.sum(F.col("s") * F.col("n")).alias("sum")).orderBy("part").collect()
        before, ends = 0, None
        for p in sums:
            if before + p["sum"] > room:
                ends = p["part"]
                break
            before += p["sum"]
        if ends is None:
            whole.append((0, cap))
            break
        down = Window.partitionBy("part").orderBy(F.desc("s"))
        running = left.where(F.col("part") == ends).withColumn("upto", F.lit(before) + F.sum(F.col("s") * F.col("n")).over(down))
        stop = running.where(F.col("upto") > room).orderBy(F.desc("s")).first()
        free = room - (stop.upto - stop.s * stop.n)
        taken = free // stop.s
        whole.append((stop.s + 1, cap))
        partial += [(stop.s, int(taken))] if taken else []
        room = int(free - taken * stop.s)
        cap = min(room, stop.s - 1)
    s = F.col(size).cast("bigint")
    inside = F.lit(False)
    for low, high in whole:
        inside = inside | s.between(low, high)
    out = fits.where(inside).select(key)
    if not partial:
        return out
    allowed = F.broadcast(rows.sparkSession.createDataFrame(partial, "__size bigint, __n bigint"))  # a row a stretch
    some = fits.join(allowed, s == F.col("__size")).withColumn("__k", F.row_number().over(Window.partitionBy("__size").orderBy(key)))
    return out.unionByName(some.where(F.col("__k") <= F.col("__n")).select(key))


def even_sample(rows: DataFrame, group: str, order: Sequence[Column], most: int) -> DataFrame:
    """At most `most` rows of each group, evenly spaced over its order, first and last included."""
    w = Window.partitionBy(group)
    ranked = rows.withColumn("__k", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    step = (F.col("__n") - 1) / F.lit(max(most - 1, 1))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * step + 0.5))
    return ranked.where((F.col("__n") <= most) | F.array_contains(wanted, F.col("__k").cast("bigint"))).drop("__k", "__n")


def cap_chunks(chunks: DataFrame, most: int = 60, group: str = "fileId") -> DataFrame:
    """`chunks` with at most `most` of each file: the header always, of code those that span most lines, of documents and configuration
    an even sample over the file. What the body of a file is, its first chunk after the header tells.

    A feature to keep an index small; nothing else uses it. Ties go by line and id; a null kind is taken for code.
    """
    header = F.coalesce(F.col("kind") == "file-header", F.lit(False))
    by = Window.partitionBy(group)
    order = [F.col("startLine"), F.col("id")]
    body = chunks.where(~header).withColumn("__n", F.count(F.lit(1)).over(by)).withColumn("__k", F.row_number().over(by.orderBy(*order)) - 1)
    first = chunks.where(~header).groupBy(group).agg(F.min_by("kind", F.struct(*order)).alias("__first"))
    held = chunks.where(header).groupBy(group).agg(F.lit(1).alias("__held"))
    body = body.join(first, group).join(held, group, "left").withColumn("__room", F.greatest(F.lit(most) - F.coalesce("__held", F.lit(0)), F.lit(0)))
    span = F.greatest(F.col("endLine") - F.col("startLine"), F.lit(0))
    wide = F.row_number().over(by.orderBy(F.desc(span), *order)) <= F.col("__room")
    step = (F.col("__n") - 1) / F.greatest(F.col("__room") - 1, F.lit(1))
    even = F.exists(F.sequence(F.lit(0), F.greatest(F.col("__room") - 1, F.lit(0))), lambda i: F.floor(i * step + 0.5) == F.col("__k")) & (F.col("__room") > 0)
    fits = F.col("__n") + F.coalesce("__held", F.lit(0)) <= most
    picked = body.withColumn("__wide", wide).where(fits | F.when(F.col("__first").isin("config", "doc"), even).otherwise(F.col("__wide")))
    return chunks.where(header).unionByName(picked.select(chunks.columns))
