"""Language identification (operator 13): hyperdimensional profiles of letter n-grams.

Each letter has a random vector of +1 and -1, drawn from its code point.  An n-gram is the
product (binding) of its letters' vectors, each rotated by its place, so that order counts; a
text is the sum (bundle) of its n-grams, and a language's prototype the sum of its texts.  A
text has the language whose prototype has the largest cosine with it.

n-grams here are a letter with the symbols on both sides, where everything that is no letter
is one symbol, the word's end; upper and lower case are alike.  They never span two words, so
a text may be cut anywhere as long as a neighbour is seen on both sides, and texts of any
length are read in slices of bounded size.

Bundling is linear, so a text's product with a prototype is the sum of its n-grams' products
with it, and the length of its own vector divides all its cosines alike.  So the language, and
``score``, the largest cosine as a share of all positive ones, need the products of each distinct
n-gram only once.  Everything is summed in whole numbers: results don't depend on how rows lie.

Training sums are whole numbers, added per language by executors; the model is one vector per
language.  A null text, or one without a letter, is ``und`` with a score of 0, and so is every
text where nothing was learned.  Ties go to the language that sorts first.  Nulls of ``lang`` or text
don't train; repeated rows train and are predicted as often as they stand; a null id counts as
the empty string for the fold.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .common import bounded_batches

#: Components of a vector.
SIZE = 4096
#: (language, n-gram) counts, or n-grams with their products, that a task holds.
HELD = 1 << 17
#: n-grams that are bound at once.
STEP = 512
#: Text bytes read at once.
READ = 1 << 19
#: Prototypes are scaled to length 2**PLACES before they are rounded.
PLACES = 22
_U = np.uint64


@cache
def letters() -> np.ndarray:
    """For each code point its letter in lower case, or 0 where it is no letter."""
    out = np.zeros(0x110000, np.int32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


def letter_vectors(code: np.ndarray, seed: int, size: int = SIZE) -> np.ndarray:
    """The vectors of letters, a row each; the word's end (0) has one as well."""
    words = size // 64
    with np.errstate(over="ignore"):
        at = code.astype(_U)[:, None] * _U(words) + np.arange(1, words + 1, dtype=_U)
        bits = kernel.mix64(kernel.mix64(at * _U(0x9E3779B97F4A7C15)) + _U(seed))
    signs = np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(len(code), -1), axis=1, bitorder="little")
    return signs.astype(np.int8) * np.int8(2) - np.int8(1)


def bind(grams: np.ndarray, seed: int, size: int = SIZE) -> np.ndarray:
    """The vectors of n-grams: before * letter rotated by one * after rotated by two."""
    places = [((grams >> _U(21 * k)) & _U((1 << 21) - 1)).astype(np.int64) for k in (2, 1, 0)]
    known = np.unique(np.concatenate(places))
    vectors = letter_vectors(known, seed, size)
    out = np.ones((len(grams), size), np.int8)
    for turn, place in enumerate(places):
        out *= np.roll(vectors, turn, axis=1)[np.searchsorted(known, place)]
    return out


def _code_points(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points of the characters that begin at ``at``."""
    lead = b[at].astype(np.int32)
    out = lead.copy()
    longer = np.flatnonzero(lead >= 0xC0)
    if len(longer):
        padded = np.concatenate((b, np.zeros(3, np.uint8)))
        first, size = lead[longer], 1 + (lead[longer] >= 0xE0) + (lead[longer] >= 0xF0)
        code = first & np.array([0, 0x1F, 0x0F, 0x07])[size]
        for k in range(1, 4):
            code = np.where(size >= k, (code << 6) | (padded[at[longer] + k] & 0x3F), code)
        out[longer] = np.where(code < 0x110000, code, 0)
    return out


def symbols(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, (before, letter, after)) of every letter of every text, in slices of bounded size."""
    table = letters()
    data, offsets = kernel.buffers(column)
    for i, j in kernel.slices(offsets, READ):
        whole, ends = data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]
        for s in range(0, len(whole), READ):
            e = min(s + READ, len(whole))
            # characters that begin in the slice, and those around them
            begin = max(s - 4, 0)
            b = whole[begin : e + 8]
            at = np.flatnonzero((b & 0xC0) != 0x80)
            letter, row = table[_code_points(b, at)], np.searchsorted(ends, at + begin, side="right")
            around = np.zeros((3, len(at)), np.int32)
            around[1] = letter
            same = row[1:] == row[:-1]
            around[0, 1:] = letter[:-1] * same
            around[2, :-1] = letter[1:] * same
            own = (letter > 0) & (at + begin >= s) & (at + begin < e)
            yield row[own] + i, around[:, own]


def distinct(around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams in ascending order, the place of each letter's)."""
    held = np.flatnonzero(np.bincount(around.ravel(), minlength=1)) if around.size else np.zeros(0, np.int64)
    n = len(held)
    key = lambda x: (x[0].astype(_U) << _U(42)) | (x[1].astype(_U) << _U(21)) | x[2].astype(_U)
    if n**3 > 1 << 22:
        return np.unique(key(around), return_inverse=True)
    short = np.zeros(int(held[-1]) + 1 if n else 1, np.int64)
    short[held] = np.arange(n)
    code = (short[around[0]] * n + short[around[1]]) * n + short[around[2]]
    found = np.flatnonzero(np.bincount(code, minlength=1)) if len(code) else np.zeros(0, np.int64)
    rank = np.zeros(int(found[-1]) + 1 if len(found) else 1, np.int64)
    rank[found] = np.arange(len(found))
    return key(held[np.array([found // (n * n), found // n % n, found % n])]) if len(found) else np.zeros(0, _U), rank[code]


class Bundles:
    """Sums of n-gram vectors per language; counts are kept until there are many of them."""

    def __init__(self, seed: int):
        self.seed, self.sums, self.size = seed, {}, 0
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, lang: np.ndarray, column: pa.Array) -> None:
        """Texts of ``column`` in the languages numbered ``lang``."""
        for row, around in symbols(column):
            gram, code = distinct(around)
            pair, count = np.unique(lang[row] * max(len(gram), 1) + code, return_counts=True)
            self.held.append((pair // max(len(gram), 1), gram[pair % max(len(gram), 1)], count))
            self.size += len(pair)
            if self.size > 4 * HELD:
                self.gather()

    def gather(self, end: bool = False) -> None:
        lang, gram, count = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((gram, lang))
        lang, gram, count = lang[order], gram[order], count[order]
        head = np.flatnonzero(np.concatenate((np.ones(min(len(lang), 1), bool), (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1]))))
        self.held = [(lang[head], gram[head], np.add.reduceat(count, head))] if len(head) else []
        self.size = len(head)
        if end or self.size > HELD:
            for lang, gram, count in self.held:
                for k in np.unique(lang).tolist():
                    at = np.flatnonzero(lang == k)
                    for some in np.array_split(at, len(at) // STEP + 1):
                        self.sums[k] = self.sums.get(k, 0) + (count[some].astype(np.float64) @ bind(gram[some], self.seed)).astype(np.int64)
            self.held, self.size = [], 0


@dataclass
class Model:
    """``prototypes``: one row per language, whole numbers of the same length but for rounding."""

    languages: list[str]
    prototypes: np.ndarray
    seed: int


class Products:
    """Products of n-grams and prototypes, kept for the n-grams seen last."""

    def __init__(self, model: Model):
        self.model, self.gram, self.told = model, np.zeros(0, _U), np.zeros((0, len(model.languages)))

    def of(self, gram: np.ndarray) -> np.ndarray:
        """A row per n-gram; these are distinct and ascend."""
        if self.told.size > 8 * HELD:
            self.gram, self.told = self.gram[:0], self.told[:0]
        new = gram[~np.isin(gram, self.gram)]
        if len(new):
            steps = np.array_split(new, len(new) // STEP + 1)
            told = np.concatenate([self.told, *(bind(x, self.model.seed).astype(np.float64) @ self.model.prototypes.T for x in steps)])
            every = np.concatenate((self.gram, new))
            order = np.argsort(every)
            self.gram, self.told = every[order], told[order]
        return self.told[np.searchsorted(self.gram, gram)]


def train(docs: DataFrame, held_out: tuple[int, int] = (4, 2), seed: int = 13, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Prototypes of all rows whose crc32(id as text) mod held_out[0] isn't held_out[1]."""
    rows = docs.where(~in_fold(id_col, held_out)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundles, names = Bundles(seed), {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            number = np.array([names.setdefault(x, len(names)) for x in coded.dictionary.to_pylist()], np.int64)
            bundles.add(number[coded.indices.to_numpy()], batch.column(1))
        bundles.gather(end=True)
        named = {k: x for x, k in names.items()}
        yield pa.RecordBatch.from_arrays([pa.array([named[k] for k in bundles.sums], pa.string()), pa.array([x.astype("<i8").tobytes() for x in bundles.sums.values()], pa.binary())], names=["lang", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i8").astype(object) for x in table.column("sums").to_pylist())
        return pa.table({"lang": table.column("lang").slice(0, 1), "sums": pa.array([total.astype(np.int64).astype("<i8").tobytes()], pa.binary())})

    told = bounded_batches(rows).mapInArrow(kernel.lean(run), "lang string, sums binary")
    told = told.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("lang", "salt").applyInArrow(added, "lang string, sums binary")
    got = told.groupBy("lang").applyInArrow(added, "lang string, sums binary").collect()  # a row per language
    found = sorted(((r["lang"], np.frombuffer(r["sums"], "<i8").astype(np.float64)) for r in got), key=lambda x: x[0].encode())
    found = [(x, v) for x, v in found if v.any()]
    scaled = [np.round(v / np.sqrt(v @ v) * (1 << PLACES)) for _, v in found]
    return Model([x for x, _ in found], np.array(scaled).reshape(len(found), SIZE), seed)


def in_fold(id_col: str, fold: tuple[int, int]):
    """Whether crc32 of the id as text (of the empty one, where it is null) mod fold[0] is fold[1]."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(fold[0])) == fold[1]


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with lang_pred and score (a clash is resolved by replacing)."""
    docs = bounded_batches(docs.drop("lang_pred", "score"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # one vector per language
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = Products(held.value)
        names = [*held.value.languages, "und"]
        for batch in batches:
            n, k = batch.num_rows, len(names) - 1
            dots, seen = np.zeros((n, k)), np.zeros(n, np.int64)
            for row, around in symbols(batch.column(text_at)):
                if len(row):
                    gram, code = distinct(around)
                    told, first = products.of(gram), int(row[0])
                    span = int(row[-1]) - first + 1
                    seen[first : first + span] += np.bincount(row - first, minlength=span)
                    for lang in range(k):
                        dots[first : first + span, lang] += np.bincount(row - first, told[code, lang], span)
            best = dots.argmax(axis=1) if k else np.zeros(n, np.int64)
            positive = np.maximum(dots, 0)
            share = positive.max(axis=1, initial=0) / np.maximum(positive.sum(axis=1), 1)
            lang = pa.array(names).take(pa.array(np.where(seen > 0, best, k)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lang, pa.array(np.where(seen > 0, share, 0.0))], names=[*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(kernel.lean(run), schema)
