"""Encoding of a whole corpus with a public byte-level BPE tokenizer, by batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round looks all neighbouring pairs up at once, by binary search over the
sorted pair keys of the vocabulary, takes the lowest rank of each word and merges every place where it stands; words without a
known pair leave the array. Texts repeat their words, so each distinct stretch between white space is encoded once per worker
and a text is put together by one gather.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .portions import portions

#: Fixed value: where the vocabulary files lie unless a path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the published split of text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word always ends before white space, so these stretches can be encoded apart; other white space than the four plain ones
#: is read differently by different libraries, and such texts are split as a whole.
STRETCH, ODD_SPACE = re.compile(r"\s*\S+|\s+"), re.compile(r"[^\S \n\r\t]")
NONE = np.int64(1 << 60)
#: Distinct stretches a worker remembers (about 200 bytes each), symbols of a word above which a heap takes over from the rounds,
#: and characters encoded at a time. They bound memory and time, not results.
REMEMBERED, LONG_WORD, SLICE = 300_000, 256, 4_000_000
#: Bytes of text an output batch is made of.
BATCH = 32_000_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """Pair keys in order, with rank and id of the symbol each pair becomes, and the id of each byte."""

    def __init__(self, byte_ids: np.ndarray, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray):
        self.byte_ids, self.keys, self.ranks, self.merged = byte_ids, keys, ranks, merged

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        symbols = byte_symbols()
        return cls(np.array([ids[symbols[b]] for b in range(256)], dtype=np.int64), keys[order], order.astype(np.int64), merged[order])

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if unknown) and merged id of each pair."""
        wanted = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        known = self.keys[at] == wanted
        return np.where(known, self.ranks[at], NONE), self.merged[at]

    def encode_words(self, words: Sequence[str]) -> list[np.ndarray]:
        """The ids of each word."""
        raw = [w.encode("utf-8", "replace") for w in words]
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(raw)
        short = [k for k, b in enumerate(raw) if 0 < len(b) <= LONG_WORD]
        for k, b in enumerate(raw):
            if len(b) > LONG_WORD:
                out[k] = self._heap(b)
        if not short:
            return out
        lengths = np.array([len(raw[k]) for k in short])
        symbols = self.byte_ids[np.frombuffer(b"".join(raw[k] for k in short), np.uint8)]
        word = np.repeat(np.array(short), lengths)
        while len(symbols):
            inner = np.empty(len(symbols), bool)
            inner[:-1], inner[-1] = word[:-1] == word[1:], False
            rank, into = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
            at = np.flatnonzero(inner)
            rank[at], into[at] = self.look_up(symbols[at], symbols[at + 1])
            begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[begins, len(word)])
            lowest = np.minimum.reduceat(rank, begins)
            done = lowest == NONE
            for b, n in zip(begins[done], sizes[done]):
                out[word[b]] = symbols[b : b + n].copy()
            take = (rank == np.repeat(lowest, sizes)) & (rank != NONE)
            # of overlapping places (one symbol three times in a row) every other one merges, from the left
            places = np.flatnonzero(take)
            if len(places):
                run = np.flatnonzero(np.r_[True, (np.diff(places) > 1) | (word[places[1:]] != word[places[:-1]])])
                order = np.arange(len(places)) - np.repeat(run, np.diff(np.r_[run, len(places)]))
                places = places[order % 2 == 0]
                symbols[places] = into[places]
            keep = np.repeat(~done, sizes)
            keep[places + 1] = False
            symbols, word = symbols[keep], word[keep]
        return out

    def _heap(self, raw: bytes) -> np.ndarray:
        """The same merges for one long word, by a heap of (rank, place) over a linked list."""
        symbols = self.byte_ids[np.frombuffer(raw, np.uint8)].tolist()
        n = len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        table = self._pairs()
        heap = [(*table[p], i, p) for i in range(n - 1) if (p := (symbols[i], symbols[i + 1])) in table]
        heapq.heapify(heap)
        while heap:
            _, into, i, pair = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j < 0 or (symbols[i], symbols[j]) != pair:
                continue
            symbols[i], symbols[j], after[i] = into, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := (symbols[a], symbols[b])) in table:
                    heapq.heappush(heap, (*table[p], a, p))
        return np.array([s for s in symbols if s >= 0], np.int64)

    def _pairs(self) -> dict[tuple[int, int], tuple[int, int]]:
        if not hasattr(self, "_table"):
            self._table = {(k >> 32, k & 0xFFFFFFFF): (r, m) for k, r, m in zip(self.keys.tolist(), self.ranks.tolist(), self.merged.tolist())}
        return self._table


class Encoder:
    """Texts to ids, remembering the stretches seen: their ids lie one after the other in `ids`, from `starts[k]` to `starts[k + 1]`."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.words = vocabulary, regex.compile(WORDS)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, stretches: list[str]) -> None:
        split = [self.words.findall(s) for s in stretches]
        distinct = {w: k for k, w in enumerate(dict.fromkeys(w for ws in split for w in ws))}
        coded = self.vocabulary.encode_words(list(distinct))
        parts = [np.concatenate([coded[distinct[w]] for w in ws]) if len(ws) > 1 else coded[distinct[ws[0]]] for ws in split]
        first = len(self.known)
        self.known.update((s, first + k) for k, s in enumerate(stretches))
        self.ids = np.concatenate([self.ids, *parts]).astype(np.int32)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(p) for p in parts])])

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the texts' id lists and all ids in a row; a null or empty text has none."""
        lengths, flat, part, size = [], [], [], 0
        for text in texts:
            part.append(text or "")
            size += len(part[-1])
            if size > SLICE:
                self._encode(part, lengths, flat)
                part, size = [], 0
        self._encode(part, lengths, flat)
        return np.concatenate(lengths) if lengths else np.empty(0, np.int64), np.concatenate(flat) if flat else np.empty(0, np.int32)

    def _encode(self, texts: list[str], lengths: list, flat: list) -> None:
        if not texts:
            return
        if len(self.known) > REMEMBERED:
            self._forget()
        cut = [self.words.findall(t) if ODD_SPACE.search(t) else STRETCH.findall(t) for t in texts]
        counts = np.array([len(c) for c in cut])
        stretches = [s for c in cut for s in c]
        new = [s for s in dict.fromkeys(stretches) if s not in self.known]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, stretches), np.int64, len(stretches))
        begins, sizes = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        places = np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(begins, sizes)
        flat.append(self.ids[places])
        edges = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        lengths.append(np.diff(edges))


@cache
def _encoder(vocabulary: Broadcast) -> Encoder:
    return Encoder(vocabulary.value)


def shared(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    """The vocabulary for all executors: three arrays with an entry per merge, about 1 MB for 50,000 whatever the corpus holds."""
    return spark.sparkContext.broadcast(Vocabulary.load(path))


def _output(df: DataFrame, keep: Sequence[str], added: T.StructField) -> T.StructType:
    return T.StructType([*[df.schema[c] for c in keep], added])


def encode_corpus(df: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", path: str = VOCABULARY, ids: str = "ids") -> DataFrame:
    """`keep` and `ids`, the token ids of `text`, for every row; no shuffle.

    Strings that look like special tokens are ordinary text. Null and empty texts give an empty list, repeated rows are kept,
    texts of any length are encoded whole, an empty table gives an empty one. Other columns are not read; a column of `keep`
    must not be named as `ids`.
    """
    vocabulary = shared(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(vocabulary)
        for batch in (p for b in batches for p in portions(b, len(keep), BATCH)):
            lengths, flat = coder.encode(batch.column(len(keep)).to_pylist())
            offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32, copy=False)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], column], [*keep, ids])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, _output(df, keep, T.StructField(ids, T.ArrayType(T.IntegerType(), False))))


def count_tokens(df: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", path: str = VOCABULARY, name: str = "tokens") -> DataFrame:
    """`keep` and the number of tokens of `text`, without the ids ever leaving the worker; 0 for null and empty texts."""
    vocabulary = shared(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(vocabulary)
        for batch in (p for b in batches for p in portions(b, len(keep), BATCH)):
            lengths, _ = coder.encode(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], pa.array(lengths.astype(np.int64))], [*keep, name])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, _output(df, keep, T.StructField(name, T.LongType())))
