"""Text, path, hash and vector functions as Column expressions; the two bit-exact hashes are Arrow UDFs."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words a token list leaves out.
STOP_WORDS = (
    "the and for with from that this are was were has have had not but you your can will would should could into out over "
    "then than them they their there here when where which while const let var function return import export class def self new "
    "null true false undefined public private static void string number int float bool boolean type value name args kwargs"
).split()
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?"
CJK = r"[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯]"


def split_identifier(name: Column) -> Column:
    """Lower-case words of an identifier: getUserByID gives get, user, by, id."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.transform(F.split(spaced, r"[^A-Za-z0-9]+"), F.lower), lambda p: p != "")


def tokenize(text: Column) -> Column:
    """The words of all identifiers and numbers in order, with repetitions, less one-letter words and stop words. An identifier of
    underscores alone stays as it is.

    Words are cut out of the whole text at once: two replacements mark the changes of case, one pattern takes the parts (a digit
    only begins a word behind an underscore), so that no regex runs per word. Underscores right behind a number are an identifier
    of their own; only texts that have such a place take the pattern that looks back for it.
    """
    marked = F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = r"(?<=_)[A-Za-z0-9]+|[A-Za-z][A-Za-z0-9]*|\d+|(?<![A-Za-z0-9_])__+(?![A-Za-z0-9_])"
    behind = F.regexp_extract_all(marked, F.lit(rf"({words}|(?<=(?<![A-Za-z0-9_])\d{{1,1000}})__+(?![A-Za-z0-9_]))"), F.lit(1))
    found = F.when(text.contains("__") & text.rlike(r"(?<![A-Za-z0-9_])\d+__+(?![A-Za-z0-9_])"), behind).otherwise(F.regexp_extract_all(marked, F.lit(f"({words})"), F.lit(1)))
    return F.filter(F.transform(F.filter(found, lambda w: F.length(w) >= 2), F.lower), lambda w: ~w.isin(STOP_WORDS))


def feature_tokens(text: Column) -> Column:
    """`tokenize`, then the single characters and pairs of each run of wide script."""
    runs = F.regexp_extract_all(text, F.lit(f"({CJK}+)"), F.lit(1))
    single = F.flatten(F.transform(runs, lambda r: F.split(r, "")))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda k: F.substring(r, k, F.lit(2)))).otherwise(F.array().cast("array<string>"))))
    return F.concat(tokenize(text), F.filter(single, lambda c: c != ""), pairs)


def clip(text: Column, most: int) -> Column:
    """At most `most` characters, the last of which is an ellipsis where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def normalize_text(text: Column) -> Column:
    """Without byte order mark, with plain line ends."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"\r\n?", "\n")


def count_lines(text: Column) -> Column:
    """Lines of a text; a line end at the end starts no further one, an empty text has none."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(feeds + F.when(text.endswith("\n"), 0).otherwise(1))


def extension_of(path: Column) -> Column:
    """The extension with its dot in lower case, empty for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)\z", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def module_of(path: Column) -> Column:
    """The directory of a path, `.` for the root."""
    folder = F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)
    return F.when(folder == "", ".").otherwise(folder)


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def callee_tail(name: Column) -> Column:
    """The last segment of a name joined by dots or colons."""
    parts = F.filter(F.split(name, r"[.:]+"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(name)


def package_of(specifier: Column) -> Column:
    """The package of an import: @scope/pkg of @scope/pkg/sub, else what stands before the first slash or dot; null for none."""
    raw = F.trim(specifier)
    scoped = F.when(raw.rlike(r"^@[^/]*/"), F.regexp_extract(raw, r"^(@[^/]*/[^/]*)", 1)).otherwise(raw)
    return F.when(raw.startswith("@"), scoped).otherwise(F.nullif(F.regexp_extract(raw, r"^([^/.]*)", 1), F.lit("")))


def occurrences(text: Column, part: Column) -> Column:
    """How often `part` stands in `text` without overlap; 0 for an empty part."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(0)


def has_word(text: Column, word: Column) -> Column:
    """Whether `word` stands in `text` between characters that are no part of a word."""
    quoted = F.concat(F.lit(r"(?<![a-z0-9_$])\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![a-z0-9_$])"))
    return (F.length(word) > 0) & F.regexp_like(text, quoted)


def format_bytes(size: Column) -> Column:
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return F.when(size < kb, F.concat(size.cast("string"), F.lit(" B"))).when(size < mb, F.format_string("%.1f KB", size / kb)).when(size < gb, F.format_string("%.1f MB", size / mb)).otherwise(F.format_string("%.2f GB", size / gb))


def cite(path: Column, line: Column, symbol: Column | None = None) -> Column:
    """path:line#symbol, without what is null."""
    place = F.concat(path, F.when(line.isNotNull(), F.concat(F.lit(":"), line.cast("string"))).otherwise(""))
    return place if symbol is None else F.concat(place, F.when(symbol.isNotNull(), F.concat(F.lit("#"), symbol)).otherwise(""))


def round6(x: Column) -> Column:
    """Six decimals, halves upward; null for what is no finite number."""
    return F.when(F.isnan(x), None).otherwise(F.floor(x * 1e6 + 0.5) / 1e6)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors over their common length, within -1 and 1; 0 if one of them is zero."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(0.0)


def padded(vector: Column, width: int = 256) -> Column:
    """A vector of that width: longer ones lose their end, shorter ones gain zeros, null elements are zero, null is all zero."""
    known = F.transform(F.coalesce(vector.cast("array<double>"), F.array().cast("array<double>")), lambda x: F.coalesce(x, F.lit(0.0)))
    return F.slice(F.concat(known, F.array_repeat(F.lit(0.0), width)), 1, width)


def batches(values: Column, size: int) -> Column:
    """An array in arrays of `size` elements, the last one shorter; an empty one has none, null stays null."""
    if size < 1:
        raise ValueError("a batch holds at least one element")
    n = F.ceil(F.size(values) / F.lit(size)).cast("int")
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.slice(values, k * size + 1, F.lit(size)))).when(values.isNotNull(), F.filter(F.array(values), lambda v: F.lit(False)))


def bm25(tf: Column, df: Column, total: Column, length: Column, average: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    idf = F.log(1 + (total - df + 0.5) / (df + 0.5))
    return idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / average))


# ---------------------------------------------------------------- bit-exact hashes and the hashed vector

#: The prime and the two seeds of the 32-bit hash.
PRIME, SEED, SECOND_SEED = 0x01000193, 0x811C9DC5, 0x01000193


@lru_cache(maxsize=300_000)
def _bucket(feature: str) -> int:
    return fnv32(feature)


def fnv32(text: str, seed: int = SEED) -> int:
    """FNV-1a over the UTF-16 units of `text`."""
    h = seed
    for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).tolist():
        h = ((h ^ unit) * PRIME) & 0xFFFFFFFF
    return h


def fnv_batch(texts: list[str], seed: int) -> np.ndarray:
    """`fnv32` of many texts at once: one vector step a position, texts sorted by length so that the finished ones drop out."""
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint16) for t in texts]
    order = sorted(range(len(units)), key=lambda k: -len(units[k]))
    h = np.full(len(units), seed, np.uint64)
    if not units:
        return h
    lengths = np.array([len(units[k]) for k in order])
    flat = np.concatenate([units[k] for k in order]).astype(np.uint64)
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    alive = len(order)
    for at in range(int(lengths[0])):
        while alive and lengths[alive - 1] <= at:
            alive -= 1
        h[:alive] = ((h[:alive] ^ flat[starts[:alive] + at]) * np.uint64(PRIME)) & np.uint64(0xFFFFFFFF)
    out = np.empty_like(h)
    out[order] = h
    return out


@F.pandas_udf(T.StringType())
def content_hash(texts: pd.Series) -> pd.Series:
    """Sixteen hexadecimal digits of two differently seeded hashes; null for null."""
    held = texts.dropna()
    a, b = fnv_batch(held.tolist(), SEED), fnv_batch(held.tolist(), SECOND_SEED)
    return pd.Series([f"{x:08x}{y:08x}" for x, y in zip(a.tolist(), b.tolist())], index=held.index, dtype=object).reindex(texts.index)


#: Width of the hashed vector and the weights of its features.
WIDTH = 256
WEIGHTS = {"word": 1.0, "part": 0.9, "identifier": 0.6, "gram": 0.35, "wide": 0.8, "wide pair": 1.1}


_IDENTIFIERS, _WIDE = re.compile(IDENTIFIER), re.compile(f"{CJK}+")


@lru_cache(maxsize=200_000)
def _pieces(identifier: str) -> tuple[tuple[str, ...], frozenset[str], bool]:
    """The words of an identifier that count, its three-letter pieces, and whether it has several parts."""
    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", identifier))
    parts = [p.lower() for p in re.split(r"[^A-Za-z0-9]+", spaced) if p]
    low = identifier.lower()
    grams = frozenset(low[k : k + 3] for k in range(len(low) - 2)) if len(low) >= 6 else frozenset()
    return tuple(p for p in parts or [low] if len(p) > 1 and p not in STOP_WORDS), grams, len(parts) > 1


def embed_text(text: str | None, width: int = WIDTH) -> list[float]:
    """A deterministic hashed vector of length 1 (all zero for a text without features): words with damped counts, whole
    identifiers, their three-letter pieces, and wide characters with their pairs, each added to a signed bucket. Features of equal
    weight are counted, others added in one order, so sums do not depend on the order of the text."""
    words, wide, whole, grams = Counter(), Counter(), set(), set()
    for identifier, n in Counter(_IDENTIFIERS.findall(text or "")).items():
        parts, pieces, several = _pieces(identifier)
        for part in parts:
            words[part] += n
        grams |= pieces
        if several:
            whole.add(identifier.lower())
    for run in _WIDE.findall(text or ""):
        wide.update(run)
        wide.update(run[k : k + 2] for k in range(len(run) - 1))
    vector = np.zeros(width)
    for names, weight in ((("i|" + i for i in whole), WEIGHTS["identifier"]), (("g|" + g for g in grams), WEIGHTS["gram"])):
        hashed = np.fromiter(map(_bucket, names), np.int64)
        vector += weight * np.bincount(hashed % width, np.where(hashed >> 24 & 1, 1, -1), width)
    rest = [("w|" + w, WEIGHTS["word"] + math.log(n)) for w, n in sorted(words.items())]
    rest += [("c|" + c, (WEIGHTS["wide"] if len(c) == 1 else WEIGHTS["wide pair"]) * (1 + math.log(n))) for c, n in sorted(wide.items())]
    for name, weight in rest:
        h = _bucket(name)
        vector[h % width] += weight if h >> 24 & 1 else -weight
    norm = float(np.linalg.norm(vector))
    return (vector / norm).tolist() if norm else vector.tolist()


def words_of(text: str | None) -> list[str]:
    """What `tokenize` gives, for texts that are in Python anyway: identifiers repeat, so their words are remembered."""
    return [w for i in _IDENTIFIERS.findall(text or "") for w in _pieces(i)[0]]


FEATURES = T.StructType([
    T.StructField("terms", T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())]))),
    T.StructField("length", T.IntegerType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])


def terms_of(text: str | None) -> tuple[list[tuple[str, int]], int]:
    """What a search can look up in a text, with how often it is there, and the number of its words: words, single wide characters,
    and pairs of them, counted without overlap wherever they stand."""
    words = words_of(text)
    counts = Counter(words)
    for run in _WIDE.findall(text or ""):
        for part in {*run, *(run[k : k + 2] for k in range(len(run) - 1))} - counts.keys():
            counts[part] = text.count(part)
    return sorted(counts.items()), len(words)


def feature_arrays(texts: list[str | None]) -> list[pa.Array]:
    """The columns of FEATURES for some texts, as Arrow arrays: lists of rows would cost more to convert than to make."""
    held = [terms_of(t) for t in texts]
    flat = [pair for terms, _ in held for pair in terms]
    pairs = pa.StructArray.from_arrays([pa.array([w for w, _ in flat], pa.string()), pa.array([n for _, n in flat], pa.int32())], ["term", "tf"])
    vectors = np.floor(np.array([embed_text(t) for t in texts]).reshape(-1, WIDTH) * 1e6 + 0.5) / 1e6
    return [
        pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(t) for t, _ in held]], dtype=np.int32)), pairs), pa.array([n for _, n in held], pa.int32()),
        pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * WIDTH), pa.array(vectors.ravel()))]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def embed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: (np.floor(np.array(embed_text(t)) * 1e6 + 0.5) / 1e6).tolist())
