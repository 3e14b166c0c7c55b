"""Approximate nearest neighbours (operator 5) by multi-index hashing.

Vectors become binary codes: the signs of several learned rotations (each turned so that
the vectors lie close to the corners of a cube).  A code is cut into substrings of 16 bits,
and each substring has an index of its own: inverted lists of the rows by key.  Codes within
Hamming radius R of a query differ in some of the m substrings by at most R / m bits, so
the lists of all keys that near retrieve every one of them.  What the lists give is held
against a limit on the whole code's distance, and the rest is ranked again by the cosine
of the original vectors.

How many substrings and how many bits of each to probe is chosen by measurement: for some
rows the true neighbours among all rows are found by one scan, and of the choices that
retrieve ``RECALL`` of them the one is taken that retrieves least.

The index is built once, in blocks of bounded bytes; each block of queries meets each block
of the index and keeps its best few, and a query's best of all blocks are its answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, kernel
from .common import durable

SUBSTRING_BITS, MOST_SUBSTRINGS = 16, 24
#: The share of true neighbours that probing is to retrieve, measured on so many queries.
RECALL, MEASURED = 0.97, 128
#: Bytes of vectors (of eight bytes a number) of a block of the index, or of queries.
BLOCK_BYTES = 8 << 20
_KEYS = np.arange(1 << SUBSTRING_BITS, dtype=np.uint16)


def rotation(x: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """An orthogonal matrix that brings unit vectors ``x`` near their signs: alternate
    between signs and the rotation that fits them best."""
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
        r = (u @ v).T
    return r


@dataclass
class Codes:
    turns: np.ndarray  # dimensions x bits
    reach: int = SUBSTRING_BITS  # bits by which a probed key may differ
    limit: int = 1 << 30  # of the whole code's distance

    def of(self, x: np.ndarray) -> np.ndarray:
        """Substrings of each vector's code, 16 bits each."""
        bits = np.packbits(x @ self.turns >= 0, axis=1)
        return np.ascontiguousarray(bits).view(np.uint16)

    @property
    def radius(self) -> int:
        """Every code within this radius is retrieved: in some substring it differs by ``reach`` at most."""
        return self.turns.shape[1] // SUBSTRING_BITS * (self.reach + 1) - 1


def learn(sample: np.ndarray, seed: int = 5) -> Codes:
    """Codes of as many rotations as give ``MOST_SUBSTRINGS``, from unit vectors (rows)."""
    d, bits = sample.shape[1], SUBSTRING_BITS * MOST_SUBSTRINGS
    turns = np.concatenate([rotation(sample, seed + i) for i in range(-(-bits // d))], axis=1)
    return Codes(turns[:, :bits])


def choose(codes: Codes, asked: np.ndarray, near: np.ndarray, of: np.ndarray, others: np.ndarray) -> Codes:
    """The first so many substrings and the reach that retrieve ``RECALL`` of the pairs of an
    asked vector and its true neighbour (``asked[of]``, ``near``) and the fewest ``others``."""
    a, b, c = codes.of(asked), codes.of(near), codes.of(others)
    apart = np.bitwise_count(a[of] ^ b)
    if not len(near):
        return codes
    best = None
    strange = [np.bitwise_count(a[k % len(a)] ^ c) for k in range(min(len(a), 16))]
    for m in range(1, codes.turns.shape[1] // SUBSTRING_BITS + 1):
        closest = np.sort(apart[:, :m].min(axis=1))
        reach = int(closest[min(len(closest) - 1, int(np.ceil(RECALL * len(closest))))])
        touched = float(np.mean([(s[:, :m].min(axis=1) <= reach).mean() for s in strange]))
        if best is None or touched < best[0]:
            best = (touched, m, reach)
    _, m, reach = best
    out = Codes(codes.turns[:, : m * SUBSTRING_BITS], reach)
    out.limit = max(out.radius, int(np.ceil(np.quantile(apart[:, :m].sum(axis=1), 0.99))))
    return out


class MultiIndex:
    """Inverted lists of one block: for each substring the rows in order of their keys."""

    def __init__(self, codes: Codes, words: np.ndarray, order: np.ndarray | None = None):
        self.codes, self.words, self.n = codes, words, len(words)
        self.order = np.argsort(words, axis=0, kind="stable").astype(np.uint32) if order is None else order
        self.starts = [np.searchsorted(words[self.order[:, j], j], np.arange(len(_KEYS) + 1)) for j in range(words.shape[1])]
        self.near = _KEYS[np.bitwise_count(_KEYS) <= codes.reach]

    def probe(self, words: np.ndarray) -> np.ndarray:
        """Which rows the lists within reach of each query's keys hold."""
        found = np.zeros((len(words), self.n), bool)
        for j, starts in enumerate(self.starts):
            keys = (words[:, j, None] ^ self.near[None, :]).astype(np.int64)
            begin = starts[keys]
            size = starts[keys + 1] - begin
            query, list_ = np.nonzero(size)
            begin, size = begin[query, list_], size[query, list_]
            at = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
            found[np.repeat(query, size), self.order[at, j]] = True
        return found

    def candidates(self, words: np.ndarray, at_least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row) pairs to rank again, and how many rows each query's lists held.  A query
        with fewer pairs than ``at_least`` gets all rows within the smallest radius that has so
        many."""
        found = self.probe(words)
        held = found.sum(axis=1)
        query, row = np.nonzero(found)
        keep = np.concatenate([np.bitwise_count(words[query[k : k + 65536]] ^ self.words[row[k : k + 65536]]).sum(axis=1) <= self.codes.limit for k in range(0, len(query), 65536)] or [np.zeros(0, bool)])
        query, row = query[keep], row[keep]
        need = min(at_least, self.n)
        for q in np.flatnonzero(np.bincount(query, minlength=len(words)) < need).tolist():
            apart = np.bitwise_count(words[q] ^ self.words).sum(axis=1)
            more = np.flatnonzero(apart <= np.partition(apart, need - 1)[need - 1])
            query, row = np.concatenate((query[query != q], np.full(len(more), q))), np.concatenate((row[query != q], more))
            held[q] = self.n
        return query, row, held


def _cosines(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows ``a`` of x and ``b`` of y, few at once."""
    x_norm, y_norm = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    step = max(1, (4 << 20) // max(1, x.shape[1] * 8))
    dots = [(x[a[k : k + step]] * y[b[k : k + step]]).sum(axis=1) for k in range(0, len(a), step)]
    return np.concatenate(dots or [np.zeros(0)]) / (x_norm[a] * y_norm[b])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _true_neighbours(rows: DataFrame, ids: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``asked``, neighbour) pairs: the k nearest rows of each, by one scan of all."""
    unit = _unit(asked)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, x = batch.column(0).to_numpy(), _matrix(pa.chunked_array([batch.column(1)]))
            cos = unit @ _unit(x).T
            cos[uid[None, :] == ids[:, None]] = -9
            best = np.argsort(-cos, axis=1)[:, :k]
            place = np.repeat(np.arange(len(unit)), best.shape[1])
            best = best.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(cos[place, best]), batch.column(1).take(pa.array(best))], names=["q", "score", "_v"])

    found = rows.select("uid", "_v").mapInArrow(kernel.lean(scan), "q long, score double, _v array<double>").where("score > -2")
    ranked = found.withColumn("_k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("_k") <= k)
    got = ranked.select("q", "_v").toArrow()
    return got.column("q").to_numpy(), _matrix(got.column("_v"))


def nearest(table: DataFrame, every: int = 50, k: int = 5, sample: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, retrieved): the k nearest rows by cosine that are found
    for each row whose id is divisible by ``every``, and how many rows its lists held.

    Null vectors, zero vectors and such with null or non-finite components take no part,
    nor do null ids.  A vector's candidates are those of its own dimension; codes are
    learned for the commonest, others are scanned.  Rows that share an id are rows of their
    own, as candidates and as queries.  An empty table gives no rows; other columns are
    ignored."""
    spark = table.sparkSession
    v = F.col("_v")
    usable = table.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("_v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    usable = durable(usable.withColumn("d", F.size("_v")))
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    in_blocks = lambda n: F.greatest(F.ceil(n * F.col("d") * 8 / F.lit(BLOCK_BYTES)), F.lit(1)).cast("long")
    sizes = usable.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"))
    main = sizes.orderBy(F.desc("n"), "d").first()
    if main is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, retrieved long")
    rows = usable.where(F.col("d") == main["d"])
    some = rows.orderBy(F.xxhash64("uid")).limit(sample).select("uid", "_v").toArrow()
    x = _matrix(some.column("_v"))
    codes = learn(_unit(x))
    of, near = _true_neighbours(rows, some.column("uid").to_numpy()[:MEASURED], x[:MEASURED], k)
    codes = choose(codes, _unit(x[:MEASURED]), _unit(near) if len(near) else near, of, _unit(x))
    held = spark.sparkContext.broadcast(codes)  # of fixed size

    counts = sizes.select("d", in_blocks(F.col("n")).alias("_is"), in_blocks(F.col("q")).alias("_qs"))
    dealt = usable.join(F.broadcast(counts) if counts.count() <= 1000 else counts, "d")
    block = lambda n: F.pmod(F.xxhash64("uid"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def build(t: pa.Table) -> pa.Table:
        kernel.give_back()
        t = t.sort_by([("vec_id", "ascending"), ("uid", "ascending")])
        x = _matrix(t.column("_v"))
        parts = [t.column("uid").to_numpy().tobytes(), t.column("vec_id").to_numpy().astype("<i8").tobytes(), x.tobytes()]
        if x.shape[1] == main["d"]:
            words = held.value.of(_unit(x))
            parts += [words.tobytes(), np.argsort(words, axis=0, kind="stable").astype(np.uint32).tobytes()]
        return pa.table({"d": pa.array([x.shape[1]], pa.int32()), "i": t.column("i").slice(0, 1), "_qs": t.column("_qs").slice(0, 1), "data": pa.array([blocks.join_parts(parts)], pa.binary())})

    index = durable(dealt.withColumn("i", block("_is")).select("d", "i", "_qs", "uid", "vec_id", "_v").groupBy("d", "i").applyInArrow(build, "d int, i long, _qs long, data binary"))
    index = index.withColumn("q", each("_qs")).select("d", "i", "q", "data")
    queries = dealt.where(is_query).withColumn("q", block("_qs")).withColumn("i", each("_is")).select("d", "i", "q", "uid", "vec_id", "_v")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        kernel.give_back()
        out = []
        if left.num_rows and right.num_rows:
            y, asked, own = _matrix(right.column("_v")), right.column("vec_id").to_numpy(), right.column("uid").to_numpy()
            uid, ids, flat, *coded = blocks.split_parts(left.column("data")[0].as_py())
            uid, ids = np.frombuffer(uid, np.int64), np.frombuffer(ids, "<i8")
            x = np.frombuffer(flat, float).reshape(len(ids), -1)
            if coded:
                words, order = (np.frombuffer(c, t).reshape(len(ids), -1) for c, t in zip(coded, (np.uint16, np.uint32), strict=True))
                index, wanted = MultiIndex(held.value, words, order), held.value.of(_unit(y))
            for a in range(0, len(y), 32):
                n = len(y[a : a + 32])
                if coded:
                    query, row, retrieved = index.candidates(wanted[a : a + 32], k + 1)  # the query itself may be one
                else:
                    query, row, retrieved = np.repeat(np.arange(n), len(ids)), np.tile(np.arange(len(ids)), n), np.full(n, len(ids))
                other = uid[row] != own[a + query]
                query, row = query[other], row[other]
                score = _cosines(x, y[a : a + 32], row, query)
                order_ = np.lexsort((ids[row], -score, query))
                query, row, score = query[order_], row[order_], score[order_]
                place = np.arange(len(query)) - np.searchsorted(query, query)
                top = place < k
                query, row, score, place = query[top], row[top], score[top], place[top]
                out.append((own[a + query], asked[a + query], ids[row], score, np.where(place == 0, retrieved[query], 0)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0), np.zeros(0, np.int64)]
        return pa.table({n: pa.array(c.astype(float if n == "score" else np.int64)) for n, c in zip(("own", "query_id", "vec_id", "score", "retrieved"), columns, strict=True)})

    keys = ["d", "i", "q"]
    found = index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(search, "own long, query_id long, vec_id long, score double, retrieved long")
    mine = Window.partitionBy("own")
    ranked = found.withColumn("rank", F.row_number().over(mine.orderBy(F.desc("score"), "vec_id"))).withColumn("retrieved", F.sum("retrieved").over(mine))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "retrieved")
