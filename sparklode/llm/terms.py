"""Terms of records: how often each occurs, and how distinctive it is of its record.

Both operators work on whole records at a time in Arrow blocks: the tokens of a block become numbers by one dictionary encoding,
and everything up to the merge over the blocks is numpy.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from ..sources.tables import settled

#: Tokens of a block: bounds a worker's memory (about 100 bytes a token), never what is counted.
BLOCK = 1_000_000
#: A (term, tf) pair held by more than one in HOT_ROWS of all (record, term) pairs is hot. There can't be more than HOT_ROWS of
#: them whatever the size of the corpus; terms above HOT_LENGTH bytes stand for themselves by a digest among them, which
#: bounds what is broadcast to about 10 MB.
HOT_ROWS, HOT_LENGTH = 100_000, 100
#: From this posterior on a term is taken for elite in a record; and the share of the other pairs whose weights lie under the bound
#: that proves a record's best elite term to be its best term.
ELITE, UNDER = 0.5, 0.9


def records(df: DataFrame, key: str = "id", tokens: str = "tokens", at: str = "seenAt") -> DataFrame:
    """key and terms of each current row that has at least one term: tokens in lower case without outer blanks, less null and
    empty ones. Only lists of keys with several rows are shuffled."""
    clean = F.filter(F.transform(F.col(tokens), lambda t: F.trim(F.lower(t))), lambda t: t.isNotNull() & (t != ""))
    # a quick look decides which rows have a term; the filter would else clean each list a second time
    return settled(df, [tokens], key, at).where(F.exists(tokens, lambda t: F.trim(t) != "")).select(key, clean.alias("terms"))


def blocks(batches: Iterator[pa.RecordBatch], column: int, most: int = BLOCK) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, pa.Array]]:
    """The rows of several batches with their terms as numbers: table, record of each token, number of each token, dictionary.

    A block ends at the first batch that brings it to `most` tokens; batches with more are cut between rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        step = max(1, int(batch.num_rows * most / max(1, len(batch.column(column).flatten()))))
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            held.append(part)
            size += len(part.column(column).flatten())
            if size >= most:
                yield _block(held, column)
                held, size = [], 0
    if held:
        yield _block(held, column)


def _block(held: list[pa.RecordBatch], column: int) -> tuple[pa.Table, np.ndarray, np.ndarray, pa.Array]:
    table = pa.Table.from_batches(held).combine_chunks()
    lists = table.column(column).chunk(0)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    return table, np.repeat(np.arange(len(lengths)), lengths), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


# ---------------------------------------------------------------- frequency of every term and n-gram


def suffix_array(tokens: np.ndarray, record: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of all records in the order of their first `depth` tokens, and how many of those each shares with the one
    before it. Prefix doubling: ranks of the first 2k tokens come from two ranks of the first k; a record's end is below all."""
    n = len(tokens)
    rank, width = tokens + 1, 1
    while width < depth:
        ahead = np.zeros(n, np.int64)
        if n > width:
            same = record[width:] == record[:-width]
            ahead[:-width] = np.where(same, rank[width:], 0)
        _, rank = np.unique(rank * (int(ahead.max(initial=0)) + 1) + ahead, return_inverse=True)
        rank, width = rank + 1, width * 2
    order = np.argsort(rank, kind="stable")
    common, equal = np.zeros(n, np.int64), np.ones(max(0, n - 1), bool)
    for d in range(depth):
        a, b = order[:-1] + d, order[1:] + d
        inside = (a < n) & (b < n)
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        equal = equal & inside & (tokens[a] == tokens[b]) & (record[a] == record[order[:-1]]) & (record[b] == record[order[1:]])
        common[1:] += equal
    return order, common


def interval_counts(order: np.ndarray, common: np.ndarray, record: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each n-gram: the place of one occurrence, its occurrences and its records. `lengths` is what remains of the record at
    each place. An interval of neighbours that share n tokens is one n-gram; each neighbour in the interval whose next occurrence
    in it belongs to the same record is one duplicate that doesn't count as a record."""
    whole = lengths[order] >= n
    begins = (common < n) & whole
    interval = np.cumsum(begins) - 1
    at = order[whole]
    interval = interval[whole]
    count = int(begins.sum())
    occurrences = np.bincount(interval, minlength=count)
    by_record = np.argsort(record[at], kind="stable")
    again = (np.diff(record[at][by_record]) == 0) & (np.diff(interval[by_record]) == 0)
    duplicates = np.bincount(interval[by_record][1:][again], minlength=count)
    return order[begins], occurrences, occurrences - duplicates


def ngram_counts(rows: DataFrame, lengths: Sequence[int] = (1,), terms: str = "terms", depth: int = 3) -> DataFrame:
    """ngram (array of terms), occurrences and records of every n-gram of the given lengths, over all rows.

    Each block of whole records has its own suffix array, so its record counts just add up; only distinct n-grams of a block
    are shuffled, however often a term occurs. One row more, with a null ngram, has the number of tokens and of records with
    terms. Null and empty lists count as records nowhere, repeated rows count each for themselves, an empty table gives that
    one row with null counts, or no row if it has no partition.
    """
    lengths = sorted(set(lengths))
    if not lengths or lengths[0] < 1:
        raise ValueError("n-grams have at least one term")
    depth = max(depth, lengths[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, record, tokens, names in blocks(batches, 0):
            n = len(tokens)
            ends = np.r_[np.flatnonzero(np.diff(record)) + 1, n]
            remains = ends[np.searchsorted(ends, np.arange(n), side="right").clip(max=len(ends) - 1)] - np.arange(n)
            order, common = suffix_array(tokens, record, depth)
            yield _batch(pa.nulls(1, pa.list_(pa.string())), np.array([n]), np.array([len(np.unique(record))]))
            for k in lengths:
                first, occurrences, held = interval_counts(order, common, record, remains, k)
                for a in range(0, len(first), 100_000):
                    at = (first[a : a + 100_000, None] + np.arange(k)).ravel()
                    grams = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) + 1, k, dtype=np.int32)), names.take(pa.array(tokens[at])))
                    yield _batch(grams, occurrences[a : a + 100_000], held[a : a + 100_000])

    def _batch(grams, occurrences, held) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([grams, pa.array(occurrences.astype(np.int64)), pa.array(held.astype(np.int64))], ["ngram", "occurrences", "records"])

    parts = rows.select(terms).mapInArrow(run, "ngram array<string>, occurrences bigint, records bigint")
    return parts.groupBy("ngram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(rows: DataFrame, lengths: Sequence[int] = (1,), rare: int = 2, common_share: int = 4, **options) -> DataFrame:
    """`ngram_counts` with mark: `rare` if held by at most `rare` records, else `common` if held by more than one in
    `common_share`, else null; and N, the number of records. Both come from one pass, stored once."""
    counts = stored(ngram_counts(rows, lengths, **options))
    total = counts.where("ngram IS NULL").agg(F.sum("records").alias("n")).first().n or 0
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") * common_share > total, "common")
    return counts.where("ngram IS NOT NULL").withColumn("mark", mark).withColumn("n_records", F.lit(int(total)).cast("bigint"))


# ---------------------------------------------------------------- how distinctive a term is of its record


def term_frequencies(rows: DataFrame, key: str = "id", terms: str = "terms") -> DataFrame:
    """key, a list of each record's distinct terms and a list of how often it holds them; no shuffle."""
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, terms array<string>, tfs array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, record, tokens, names in blocks(batches, 1):
            pairs, tf = np.unique(record * len(names) + tokens, return_counts=True) if len(names) else (np.empty(0, np.int64), np.empty(0, np.int64))
            owner = pairs // max(1, len(names))
            offsets = pa.array(np.searchsorted(owner, np.arange(table.num_rows + 1)).astype(np.int32))
            held = pa.ListArray.from_arrays(offsets, names.take(pa.array(pairs % max(1, len(names)))) if len(names) else pa.array([], pa.string()))
            often = pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))
            yield from pa.Table.from_arrays([table.column(0), held, often], names=[key, "terms", "tfs"]).to_batches(max_chunksize=10_000)

    return rows.select(key, terms).mapInArrow(run, schema)


def two_poisson(tf: np.ndarray, count: np.ndarray, owner: np.ndarray, total: int, rounds: int = 60, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fits, for many terms at once, a mixture of two Poisson distributions to the histogram of each term's frequency.

    `tf`, `count`, `owner`: a histogram bar each, sorted by owner; the records without the term, `total` less its bars, are the
    bar at 0. Returns of each term the elite share and the elite and plain rates, and of each bar the posterior probability of
    the elite component. Of each term expectation and maximisation go on for `rounds`, or until its elite share moves by less than `tolerance`.
    """
    begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    which = np.cumsum(np.r_[0, owner[1:] != owner[:-1]])
    fold = lambda x: np.add.reduceat(x, begins)
    df, mass = fold(count.astype(float)), fold(tf * count.astype(float))
    zero = np.maximum(total - df, 0.0)
    share = np.clip(df / max(total, 1), 1e-12, 0.5)
    elite, plain = 1.5 * mass / df, np.maximum(0.25 * mass / max(total, 1), 1e-12)

    def posterior(k, share, elite, plain):
        odds = np.log(share) - np.log1p(-share) + k * (np.log(elite) - np.log(plain)) - (elite - plain)
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -700, 700)))

    open_ = np.ones(len(df), bool)  # each term stops by itself, so its fit does not depend on the terms beside it
    for _ in range(rounds):
        held = posterior(tf, share[which], elite[which], plain[which])
        none = posterior(0, share, elite, plain)
        weight, hits = fold(held * count) + none * zero, fold(held * count * tf)
        fresh = np.clip(weight / max(total, 1), 1e-12, 1 - 1e-12)
        high = np.maximum(hits / np.maximum(weight, 1e-12), 1e-12)
        low = np.maximum((mass - hits) / np.maximum(total - weight, 1e-12), 1e-12)
        elite, plain = np.where(open_, np.maximum(high, low), elite), np.where(open_, np.minimum(high, low), plain)
        moved, share = np.abs(fresh - share), np.where(open_, fresh, share)
        open_ &= moved >= tolerance
        if not open_.any():
            break
    return share, elite, plain, posterior(tf, share[which], elite[which], plain[which])


def term_weights(frequencies: DataFrame, total: int) -> DataFrame:
    """term, tf, n (records holding the term exactly tf times), df and elite, the posterior for that tf.

    Histograms are counted before the shuffle, so a term that every record holds sends a few bars from each task.
    """
    pairs = frequencies.select(F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    bars = pairs.groupBy("term", "tf").agg(F.count(F.lit(1)).alias("n"))
    grouped = bars.groupBy("term").agg(F.collect_list("tf").alias("tfs"), F.collect_list("n").alias("ns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), lengths)
            tf, n = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            *_, held = two_poisson(tf.astype(float), n, owner, total)
            df = np.add.reduceat(n, np.r_[0, np.cumsum(lengths)[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(tf.astype(np.int32)), pa.array(n), pa.array(df[owner]), pa.array(held)], ["term", "tf", "n", "df", "elite"])

    return grouped.mapInArrow(run, "term string, tf int, n bigint, df bigint, elite double")


def score_terms(rows: DataFrame, key: str = "id", terms: str = "terms") -> tuple[DataFrame, DataFrame, int]:
    """Scores every term of every record: (rid, term, tf, df, elite), the table of rid and key, and the number of records.

    Terms are held by very unequal numbers of records. The weights of hot (term, tf) pairs, whose number has
    a fixed bound, are broadcast and cover most occurrences where they stand; only the others are shuffled, and none of those keys
    holds more than one in HOT_ROWS of all. A record with null or no terms has no rows; copies of a row are scored each for
    themselves; extra columns are not read.
    """
    held = stored(term_frequencies(rows, key, terms).withColumn("rid", F.monotonically_increasing_id()))
    total = held.count()
    weights = stored(term_weights(held, total))
    return _joined(held, weights), held.select("rid", key), total


def _joined(held: DataFrame, weights: DataFrame) -> DataFrame:
    """rid, term, tf, df and elite of every pair of a record and a term that `weights` has."""
    pairs_in_all = weights.agg(F.sum("n").alias("n")).first().n or 0
    short = F.when(F.octet_length("term") <= HOT_LENGTH, F.col("term")).otherwise(F.concat(F.lit("\0"), F.sha2("term", 256)))
    hot = weights.where(F.col("n") * HOT_ROWS > pairs_in_all)
    hot = F.broadcast(hot.select(short.alias("__short"), "tf", F.col("df").alias("hot_df"), F.col("elite").alias("hot_elite")))
    pairs = held.select("rid", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("rid", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    near = pairs.withColumn("__short", short).join(hot, ["__short", "tf"], "left")
    ready = near.where("hot_df IS NOT NULL").select("rid", "term", "tf", F.col("hot_df").alias("df"), F.col("hot_elite").alias("elite"))
    far = near.where("hot_df IS NULL").select("rid", "term", "tf").join(weights.select("term", "tf", "df", "elite"), ["term", "tf"])
    return ready.unionByName(far.select("rid", "term", "tf", "df", "elite"))


def tf_idf(total: int) -> Column:
    return F.round(F.col("tf") * F.log(F.lit(float(total)) / F.col("df")), 6)


def most_distinctive(rows: DataFrame, key: str = "id", terms: str = "terms", least: int = 2) -> DataFrame:
    """key, term and proven of each record: of its terms held by `least` records or more the one with the highest tf ln(N / df), the
    alphabetically first of equals.

    The posterior selects: candidates are the terms a record holds as elite, and the few others whose weight lies above a bound
    that UNDER of the non-elite pairs stay below. No other term of any record weighs more than the bound, so a record's best
    candidate above it is its best term (`proven`). The other records get the exact comparison of all their terms, in the same
    aggregation. Records whose every term is rarer than `least` have no row; nulls and copies as in `score_terms`.
    """
    held = stored(term_frequencies(rows, key, terms).withColumn("rid", F.monotonically_increasing_id()))
    total = held.count()
    weights = stored(term_weights(held, total))
    others = weights.where((F.col("df") >= least) & (F.col("elite") < ELITE))
    bars = {r.w: r.n for r in others.groupBy(F.floor(F.least(tf_idf(total), F.lit(100.0))).alias("w")).agg(F.sum("n").alias("n")).collect()}
    bound, below = 0, 0
    while bars and below < UNDER * sum(bars.values()):
        below += bars.get(bound, 0)
        bound += 1
    scored = _joined(held, weights.where(F.col("df") >= least)).withColumn("weight", tf_idf(total))
    pick = F.struct((-F.col("weight")).alias("w"), "term")
    candidate = (F.col("elite") >= ELITE) | (F.col("weight") > bound)
    best = scored.groupBy("rid").agg(F.min(F.when(candidate, pick)).alias("c"), F.min(pick).alias("b"))
    proven = F.coalesce(-F.col("c.w") > bound, F.lit(False))
    named = best.select("rid", F.when(proven, F.col("c.term")).otherwise(F.col("b.term")).alias("term"), proven.alias("proven"))
    return named.join(held.select("rid", key), "rid").select(key, "term", "proven")
