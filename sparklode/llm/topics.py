"""Subject areas of documents by seeded non-negative matrix factorisation.

The document-term matrix X is factored into W (documents by components) and H (components by terms) with the multiplicative
updates for the Kullback-Leibler divergence. One component is anchored to each subject, by the labelled documents and the
subject's description; a few free components take up what all documents share. Labels can be wrong, so after some rounds on the
labelled sample the documents are let go from their labels. Then H is updated once more from all documents, and each document's
row of W, with the lines that speak for each subject, gives its one or two subjects.

Terms are hashed into a fixed number of columns: H has a fixed size, whatever the corpus holds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .portions import portions

#: Columns of H, free components, labelled documents the seeds are fitted on (those with the smallest hashed ids), rounds of that fit.
COLUMNS, FREE, LABELLED, ROUNDS = 1 << 17, 2, 6_000, 30
#: Updates of H from all documents after that fit.
UPDATES = 1
#: A subject is treated if this share of the evidence speaks for it, on at least so many lines; a document's first subject needs
#: only as much evidence as two plain terms give, from at least two different ones.
SHARE, LINES, EVIDENCE = 0.15, 2, 1.5
#: A term speaks for subjects if they hold this share of it against the free components.
SPEAKS = 0.6
#: Of a term's rates in the subjects one must be more than this share for the subject to be anchored to it; PRIOR documents of
#: the average kind are added to each subject's, so that one document alone leans nowhere.
LEANS, PRIOR = 0.5, 3.0

STRETCH = re.compile(r"\s*\S+|\s+")
CODES = re.compile(r"[0-9A-Fa-f]{12,}|(?=[A-Za-z0-9+/]*\d)[A-Za-z0-9+/]{24,}={0,2}")
WORD = re.compile(r"[A-Z]?[a-zà-öø-ÿ]+|[A-Z]+(?![a-z])|[぀-ヿ㐀-鿿가-힯]+")
#: Marks in the order of terms: a line's end, and a code in a line; a line with fewer than WORDS terms a code is no text but an entry
#: of a list of digests, while a code within a sentence or a paragraph is only left out itself.
BREAK, CODE, WORDS = -1, -2, 8
#: Stretches a worker remembers, bytes of text and terms it works on at a time: they bound memory, not results.
REMEMBERED, SLICE, TERMS = 300_000, 4_000_000, 1_000_000


def columns_of(text: str) -> list[int]:
    """The columns of a text's terms: parts of words in lower case from three letters on, and pairs of wide characters; a
    long code such as a digest is no text."""
    if len(text) > 11 and CODES.search(text):
        return [CODE]
    out = []
    for word in WORD.findall(text):
        if word[0] >= "぀":
            out += [zlib.crc32(word[k : k + 2].encode()) % COLUMNS for k in range(max(1, len(word) - 1))]
        elif len(word) > 2:
            out.append(zlib.crc32(word.lower().encode()) % COLUMNS)
    return out


class Columns:
    """Texts to the columns of their terms in order, with BREAK at each line end; stretches between white space are remembered."""

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and all columns in a row; a null text has none."""
        if len(self.known) > REMEMBERED:
            self._forget()
        cut = [STRETCH.findall(t) if t else [] for t in texts]
        stretches = [s for c in cut for s in c]
        new = [s for s in dict.fromkeys(stretches) if s not in self.known]
        if new:
            parts = [[BREAK] * s.count("\n") + columns_of(s) for s in new]
            first = len(self.known)
            self.known.update((s, first + k) for k, s in enumerate(new))
            self.flat = np.concatenate([self.flat, np.fromiter((c for p in parts for c in p), np.int32)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(p) for p in parts])])
        at = np.fromiter(map(self.known.__getitem__, stretches), np.int64, len(stretches))
        sizes = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        places = np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(self.starts[at], sizes)
        return np.diff(np.r_[0, ends][np.r_[0, np.cumsum([len(c) for c in cut], dtype=np.int64)]]), self.flat[places]


def featurise(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and terms (columns of H in the order of the text); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Columns()
        for batch in (p for b in batches for p in portions(b, 1, SLICE)):
            lengths, flat = coder.encode(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "terms"])

    return documents.select(key, F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, terms array<int>")


def sparse(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and damped count of the document-term matrix, in the order of rows."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    key = (np.repeat(np.arange(len(lengths)), lengths) * COLUMNS + flat)[flat >= 0]
    key, count = np.unique(key, return_counts=True)
    return key // COLUMNS, key % COLUMNS, np.log1p(count).astype(np.float32)


def _weights(row: np.ndarray, at: np.ndarray, x: np.ndarray, n: int, h: np.ndarray, rounds: int, start: np.ndarray | None = None) -> np.ndarray:
    """The rows of W for a given H; `at` are places in `h`, whose rows sum to 1."""
    w = np.ones((n, len(h)), np.float32) if start is None else start.copy()
    for _ in range(rounds):
        ratio = np.zeros(len(x), np.float32)
        for k in range(len(h)):
            ratio += w[row, k] * h[k, at]
        ratio = x / np.maximum(ratio, 1e-12)
        for k in range(len(h)):
            w[:, k] *= np.bincount(row, ratio * h[k, at], n)
    return w


def vote_total(allowed: np.ndarray) -> np.ndarray:
    """How many documents each subject has, one with two labels counting half for either."""
    return (allowed / np.maximum(allowed.sum(1, keepdims=True), 1)).sum(0)


def fit(row: np.ndarray, column: np.ndarray, x: np.ndarray, allowed: np.ndarray, free: int = FREE, rounds: int = ROUNDS) -> np.ndarray:
    """H from labelled documents. `allowed`: documents by subjects, whether the label names the subject.

    In the first half of the rounds a document has only its labelled subjects and the free components; in the second half all,
    weighed down but not excluded, so that a document whose terms contradict its label leaves it.
    """
    n, subjects = allowed.shape
    used, at = np.unique(column, return_inverse=True)
    mask = np.concatenate([allowed, np.ones((n, free), bool)], 1).astype(np.float32)
    vote = (allowed / np.maximum(allowed.sum(1, keepdims=True), 1))[row]
    counts = np.stack([np.bincount(at, vote[:, k], len(used)) for k in range(subjects)])
    size, spread = vote_total(allowed)[:, None], counts.sum(0) / n
    rate = (counts + PRIOR * spread) / (size + PRIOR)
    lift = rate / rate.sum(0)
    # a term may stand for the subjects it leans to; one that all hold alike, as far as the sample tells, is left to the free components
    anchor = np.concatenate([lift > LEANS, np.ones((free, len(used)), bool)])
    noise = np.linspace(0.8, 1.2, free)[:, None] * (1 + 0.1 * np.cos(np.outer(np.arange(1, free + 1), np.arange(len(used)))))
    h = np.concatenate([counts * lift**2, counts.sum(0) * (1 - lift.max(0)) * noise / free]) * anchor + 1e-9
    h /= h.sum(1, keepdims=True)
    w = mask * np.bincount(row, x, n)[:, None] / mask.sum(1, keepdims=True)
    for step in range(rounds):
        if step == rounds // 2:
            w = np.maximum(w, 0.1 * w.sum(1, keepdims=True) / w.shape[1])
        w = _weights(row, at, x, n, h.astype(np.float32), 1, w.astype(np.float32))
        ratio = np.zeros(len(x))
        for k in range(len(h)):
            ratio += w[row, k] * h[k, at]
        ratio = x / np.maximum(ratio, 1e-12)
        h = np.stack([h[k] * np.bincount(at, ratio * w[row, k], len(used)) for k in range(len(h))]) * anchor + 1e-9
        h /= np.maximum(h.sum(1, keepdims=True), 1e-12)
    full = np.full((len(h), COLUMNS), 1e-9)
    full[:, used] = h
    return full / full.sum(1, keepdims=True)


def speaking(h: np.ndarray, subjects: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns that speak for subjects, and H cut down to them."""
    held = h[:subjects].max(0) / np.maximum(h[:subjects].max(0) + h[subjects:].max(0), 1e-30)
    ordinary = h[:subjects].max(0) / np.maximum(h[:subjects].sum(0), 1e-30)
    columns = np.flatnonzero((held > SPEAKS) & (ordinary > 0.5) & (h[:subjects].max(0) > 1e-6))
    return columns, np.ascontiguousarray(h[:, columns]).astype(np.float32)


def corpus_update(features: DataFrame, h: np.ndarray, subjects: int) -> np.ndarray:
    """One update of H from all documents. Each task sums its documents' part; a row for each column it met is shuffled, and at
    most COLUMNS rows of fixed width reach the driver."""
    held = features.sparkSession.sparkContext.broadcast(h.astype(np.float32))
    size = len(h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = held.value
        known = full.max(0) > 2e-9 / COLUMNS
        columns, small = speaking(full, subjects)
        place = np.full(COLUMNS, -1, np.int64)
        place[columns] = np.arange(len(columns))
        total = np.zeros((size, COLUMNS))
        for batch in (p for b in batches for p in portions(b, 0, TERMS)):
            row, column, x = sparse(batch.column(0))
            use = place[column] >= 0
            w = _weights(row[use], place[column[use]], x[use], batch.num_rows, small, 3)
            mass = np.bincount(row, x, batch.num_rows)
            w[np.bincount(row[use], minlength=batch.num_rows) < 3, :subjects] = 0  # too little to learn other terms from
            # what the speaking terms leave belongs to the free components
            w[:, subjects:] = np.maximum(mass - w[:, :subjects].sum(1), 0.05 * mass)[:, None] / (size - subjects)
            part = np.stack([w[row, k] * np.where(known[column], full[k, column], 1.0 / COLUMNS) for k in range(size)])
            part *= x / np.maximum(part.sum(0), 1e-30)
            for k in range(size):
                total[k] += np.bincount(column, part[k], COLUMNS)
        met = np.flatnonzero(total.sum(0) > 0)
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), *[pa.array(total[k, met]) for k in range(size)]], ["at", *[f"h{k}" for k in range(size)]])

    parts = features.select("terms").mapInArrow(run, "`at` int, " + ", ".join(f"h{k} double" for k in range(size)))
    summed = parts.groupBy("at").agg(*[F.sum(f"h{k}").alias(f"h{k}") for k in range(size)]).toArrow().to_pandas()
    fresh = np.full((size, COLUMNS), 1e-9)
    if len(summed):
        fresh[:, summed["at"].to_numpy()] += summed[[f"h{k}" for k in range(size)]].to_numpy().T
    held.unpersist()
    return fresh / np.maximum(fresh.sum(1, keepdims=True), 1e-30)


def mixtures(lists: pa.Array, columns: np.ndarray, place: np.ndarray, h: np.ndarray, subjects: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document and subject: the evidence its terms give, the lines and the different terms that speak for it."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(lengths)
    owner = np.repeat(np.arange(n), lengths)
    line = np.cumsum((flat == BREAK) | np.r_[True, owner[1:] != owner[:-1]]) if len(flat) else np.empty(0, np.int64)
    count = int(line[-1]) + 1 if len(line) else 1
    coded = WORDS * np.bincount(line[flat == CODE], minlength=count) > np.bincount(line[flat >= 0], minlength=count)
    use = (flat >= 0) & (place[np.maximum(flat, 0)] >= 0) & ~coded[line]
    owner, line, at = owner[use], line[use], place[flat[use]]
    if not len(at):
        return np.zeros((n, subjects), np.float32), np.zeros((n, subjects), np.int64), np.zeros((n, subjects), np.int64)
    key, x = np.unique(owner * len(columns) + at, return_counts=True)
    w = _weights(key // len(columns), key % len(columns), np.log1p(x).astype(np.float32), n, h, 12)[:, :subjects]
    told = np.stack([w[owner, k] * h[k, at] for k in range(subjects)])
    told /= np.maximum(told.sum(0), 1e-30)
    evidence = np.stack([np.bincount(owner, told[k], n) for k in range(subjects)], 1)
    starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    best = np.argmax(np.add.reduceat(told, starts, axis=1), 0)
    support = np.bincount(owner[starts] * subjects + best, minlength=n * subjects).reshape(n, subjects)
    told = w[key // len(columns)].T * h[:subjects, key % len(columns)]
    distinct = np.bincount(key // len(columns) * subjects + np.argmax(told, 0), minlength=n * subjects).reshape(n, subjects)
    return evidence, support, distinct


def assign(features: DataFrame, h: np.ndarray, names: Sequence[str], key: str = "doc_id") -> DataFrame:
    """key, subject, share of the evidence and lines for the subject or the two subjects each document treats."""
    subjects, kind = len(names), features.schema[key].dataType.simpleString()
    columns, small = speaking(h, subjects)
    held = features.sparkSession.sparkContext.broadcast((columns, small))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, small = held.value
        place = np.full(COLUMNS, -1, np.int64)
        place[columns] = np.arange(len(columns))
        for batch in (p for b in batches for p in portions(b, 1, TERMS)):
            evidence, support, distinct = mixtures(batch.column(1), columns, place, small, subjects)
            whole = evidence.sum(1)
            share = evidence / np.maximum(whole, 1e-30)[:, None]
            rank = np.argsort(np.argsort(-evidence, 1, kind="stable"), 1, kind="stable")
            first = (rank == 0) & (evidence >= EVIDENCE) & (distinct >= 2)
            second = (rank == 1) & (share >= SHARE) & (support >= LINES) & first.any(1)[:, None]
            doc, subject = np.nonzero(first | second)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array([names[k] for k in subject], pa.string()), pa.array(np.round(share[doc, subject].astype(float), 6)), pa.array(support[doc, subject].astype(np.int64))], [key, "subject", "share", "lines"])

    return features.select(key, "terms").mapInArrow(run, f"`{key}` {kind}, subject string, share double, lines bigint")


def seeds(features: DataFrame, labels: DataFrame, names: Sequence[str], descriptions: Sequence[str | None], key: str = "doc_id") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The document-term matrix of the labelled sample and of the descriptions, with their labels. Spellings of a label that
    differ from a subject only in case and outer blanks count; others, nulls and repetitions do not."""
    known = {n.strip().lower(): n for n in names}
    clean = labels.select(key, F.lower(F.trim("subject")).alias("s")).where(F.col(key).isNotNull() & F.col("s").isin(*known)).groupBy(key).agg(F.collect_set("s").alias("subjects"))
    sample = clean.orderBy(F.xxhash64(key), key).limit(LABELLED)
    rows = features.join(F.broadcast(sample), key).select(key, "terms", "subjects").toArrow().to_pandas().sort_values(key)
    extra = [columns_of(f"{n} {d or ''}") for n, d in zip(names, descriptions)]
    lists = pa.array([*rows["terms"].tolist(), *extra], pa.list_(pa.int32()))
    order = {n.strip().lower(): k for k, n in enumerate(names)}
    allowed = np.zeros((len(lists), len(names)), bool)
    for d, subjects in enumerate([*rows["subjects"].tolist(), *[[n.strip().lower()] for n in names]]):
        allowed[d, [order[s] for s in subjects]] = True
    return *sparse(lists), allowed


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, subject, share and lines: a row for the subject, or the two, that each document mainly treats.

    Terms are taken from whole texts once and stored in the shared checkpoint folder; no text is shuffled. Null, blank, filler,
    checksum and number texts have no row, for no term of theirs speaks for a subject. Copies each get their rows, repeated rows
    of `subjects` count once, an empty table gives an empty one, other columns are not read. Without labels the descriptions
    alone are the seeds; without subjects there is no row. `subjects` is a list of names of fixed size and reaches the driver.
    """
    listed = subjects.where(F.col("subject").isNotNull()).groupBy("subject").agg(F.min("description").alias("description")).orderBy("subject").collect()
    if not listed:
        return documents.sparkSession.createDataFrame([], f"`{key}` {documents.schema[key].dataType.simpleString()}, subject string, share double, lines bigint")
    names = [r.subject for r in listed]
    features = stored(featurise(documents, key))
    h = fit(*seeds(features, labels, names, [r.description for r in listed], key))
    for _ in range(UPDATES):
        h = corpus_update(features, h, len(names))
    return assign(features, h, names, key)
