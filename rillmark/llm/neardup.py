"""MinHash near-duplicates (operator 4) with tensored banding.

A document is the set of its word shingles.  Documents with equal sets (by 128 bits of hash)
form a class, and one set of each class goes on.  Two collections of ``half`` short keys are made, each key
of ``rows`` minhashes; a table is a pair of keys, one from either collection, so that
half * half tables cost 2 * half * rows minhashes.  Two sets of similarity s share a table
with probability (1 - (1 - s**rows)**half)**2, 0.9999 at 0.8 with the defaults.  A key of
the first collection that nobody shares opens no tables.

Links are confirmed on full sets.  First the shingles that no other candidate has are
counted: what a set shares with all others together bounds what it shares with any one,
so sets that share too little have no links, nor have two sets of which either shares too
little for the other's size.  These bounds are exact.  Within a table's bucket every
member is first held against the one that shares most (an original among its copies
shares nearly all); links found so join components, and only members of different
components that the bounds allow are held against each other afterwards, in tiles of
bounded size.  So a group of many copies costs little more than a pair each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, kernel
from .common import bounded_batches, durable, whole_row

_U = np.uint64
HALF, ROWS = 14, 3
#: Shingles of a part, while those that candidates share are counted.
PART_SHINGLES = 1 << 18
#: Bits of the hash that names a class; sets that share it are told apart by a second one.
CLASS_BITS = 64
#: Members of a centre that are dealt together; one with more is salted by their number.
SALT_ROWS = 1 << 16
#: Classes with this share of all ends of links are joined by broadcast; at most as many are.
HOT_CLASSES = 512
#: Ends of links up to which all classes are told by one join: so few rows burden no task, and the driver
#: plans two of these for each round.
FEW_ENDS = 1 << 17
#: Ids of candidates up to which they are broadcast, 16 MB of them.
NEAR_IDS = 1 << 20
#: Sets that meet as many others at once.
TILE_ROWS = 128


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row, row, shingle hash), the distinct shingles of each text in
    ascending order.  A text of fewer words than ``width`` has its whole sequence."""
    data, offsets = kernel.buffers(column)
    for i, j in kernel.slices(offsets):
        hashes, counts = kernel.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
        prints, row, _ = kernel.windows(hashes, counts, width)
        ends = np.cumsum(counts)
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            whole = np.array([int(kernel.combine([hashes[p : p + 1] for p in range(ends[k] - counts[k], ends[k])] + [np.array([counts[k]], _U)])[0]) for k in short], _U)
            prints, row = np.concatenate((prints, whole)), np.concatenate((row, short))
        order = np.lexsort((prints, row)) if len(short) else _by_row(prints, row, j - i)
        prints, row = prints[order], row[order]
        keep = np.ones(len(prints), bool)
        keep[1:] = (prints[1:] != prints[:-1]) | (row[1:] != row[:-1])
        yield i, j, row[keep], prints[keep]


def _by_row(prints: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    order = np.argsort(prints, kind="stable")
    return order[np.argsort(row[order], kind="stable")]


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = kernel.mix64(np.arange(1, 2 * n + 1, dtype=_U) * _U(0xA0761D6478BD642F))
    return seeds[:n] | _U(1), seeds[n:]


def minhashes(row: np.ndarray, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have shingles, their n minhashes)."""
    head = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
    out = np.empty((len(head), n), _U)
    factor, mask = _constants(n)
    with np.errstate(over="ignore"):
        for k in range(n if len(head) else 0):
            out[:, k] = np.minimum.reduceat((prints ^ mask[k]) * factor[k], head)
    return row[head], out


def _set_hashes(row: np.ndarray, prints: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's set, for the rows that have one."""
    head = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    with np.errstate(over="ignore"):
        sums = [np.add.reduceat(kernel.mix64(prints + _U(c)), head) for c in (0, 0x9E3779B97F4A7C15)]
        return kernel.mix64(sums[0] + size.astype(_U)), kernel.mix64(sums[1] ^ size.astype(_U))


def digests(docs: DataFrame, width: int, half: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, n_shingles, cls, check, first, second) of every row: ``cls`` and
    ``check`` are two hashes of its set (null if empty), ``first`` and ``second`` the keys of
    the two collections."""
    named = _U((1 << CLASS_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, size = batch.num_rows, np.zeros(batch.num_rows, np.int64)
            cls, check, keys = np.zeros(n, _U), np.zeros(n, _U), np.zeros((n, 2 * half), _U)
            for i, j, row, prints in shingle_sets(batch.column(1), width):
                size[i:j] = np.bincount(row, minlength=j - i)
                at, mins = minhashes(row, prints, 2 * half * rows)
                if len(at):
                    one, two = _set_hashes(row, prints, size[i:j][at])
                    cls[i + at], check[i + at] = one & named, two
                for k in range(2 * half):
                    keys[i + at, k] = kernel.combine([mins[:, k * rows + r] for r in range(rows)] + [np.full(len(at), k, _U)])
            flat = keys.view(np.int64)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).reshape(-1)), half).cast(pa.list_(pa.int64())) for x in (flat[:, :half], flat[:, half:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size), *(pa.array(x.view(np.int64), mask=size == 0) for x in (cls, check)), *lists], names=["doc_id", "text_hash", "n_shingles", "cls", "check", "first", "second"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(kernel.lean(run), f"doc_id {kind}, text_hash long, n_shingles long, cls long, check long, first array<long>, second array<long>")


def buckets(sets: DataFrame) -> DataFrame:
    """(bucket, cls): the tables' buckets with more than one member."""
    own = sets.select("cls", F.posexplode("first").alias("_i", "_a"))
    shared = own.groupBy("_a").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_a")
    opened = own.join(shared, "_a").join(sets.select("cls", "second"), "cls")
    tables = opened.select("cls", "_a", F.explode("second").alias("_b")).select("cls", F.xxhash64("_a", "_b").alias("bucket"))
    full = tables.groupBy("bucket").agg(F.min("cls").alias("_lo"), F.max("cls").alias("_hi")).where("_lo < _hi").select("bucket")
    return tables.join(full, "bucket")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):  # the sets of few pairs at once
                some = batch.slice(start, 64)
                ids = np.stack([some.column(k).to_numpy() for k in (0, 1)])
                cls, first, place = np.unique(ids, return_index=True, return_inverse=True)
                texts = [some.column(2 + k // len(some))[k % len(some)].as_py() for k in first.tolist()]
                row, prints = _sets_of(pa.table({"text": pa.array([zlib.decompress(t).decode() for t in texts], pa.large_string())}), width)
                sets = np.split(prints, np.cumsum(np.bincount(row, minlength=len(cls)))[:-1])
                x, y = place.reshape(2, -1)
                both = np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(x, y, strict=True)])
                size = np.array([len(v) for v in sets])
                mask = pa.array((100 + percent) * both >= percent * (size[x] + size[y]))
                yield pa.RecordBatch.from_arrays([some.column(0).filter(mask), some.column(1).filter(mask)], names=["a", "b"])

    one, two = (texts.select(F.col("cls").alias(c), F.col("packed").alias(f"_{c}")) for c in "ab")
    return pairs.join(two, "b").join(one, "a").select("a", "b", "_a", "_b").mapInArrow(kernel.lean(run), "a long, b long")


def _zip(data: bytes) -> bytes:
    return zlib.compress(data, 1)


def _sets_of(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of a block's texts."""
    row, prints = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    for i, _, r, p in shingle_sets(rows.column("text"), width):
        row.append(r + i)
        prints.append(p)
    return np.concatenate(row), np.concatenate(prints)


def candidates(docs: DataFrame, sets: DataFrame, members: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(cls, n, shared, packed): the members that may have links, with their compressed
    text, the size of their set and how much of it other members have."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernel.buffers(batch.column(1))
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_zip(raw[offsets[k] : offsets[k + 1]]) for k in range(batch.num_rows)], pa.binary())], names=["doc_id", "packed"])

    def unsqueeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # little text at once
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([zlib.decompress(x).decode() for x in part.column(2).to_pylist()], pa.string())], names=["cls", "check", "text"])

    kind = dict(docs.dtypes)[id_col]
    held = sets.join(members, "cls").select("cls", "check", F.col("least").alias("doc_id"), "n")
    sums = held.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    shingles = sums["n"] or 0
    parts = max(1, -(-shingles // PART_SHINGLES))
    wanted = docs.select(id_col, text_col).where(F.col(id_col).isNotNull())
    if sums["rows"] <= NEAR_IDS:  # texts of others needn't be shuffled; beyond, the join leaves them out
        wanted = wanted.join(F.broadcast(held.select(F.col("doc_id").alias(id_col)).distinct()), id_col, "left_semi")
    texts = wanted.mapInArrow(kernel.lean(squeeze), f"doc_id {kind}, packed binary")
    found = texts.join(held.drop("n"), "doc_id").select("cls", "check", "packed").mapInArrow(kernel.lean(unsqueeze), "cls long, check long, text string")
    packed = blocks.pack(found, "text", None, most=blocks.BLOCK_BYTES // 2)

    def by_part(rows: pa.Table):
        row, prints = _sets_of(rows, width)
        keys, count = np.unique(prints, return_counts=True)
        cuts = np.searchsorted(((keys >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64), np.arange(parts + 1))
        return row, prints, keys, count, cuts

    def ask(block: int, rows: pa.Table) -> Iterator[tuple[int, bytes]]:
        _, _, keys, count, cuts = by_part(rows)
        for part in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[part], cuts[part + 1])
            yield part, blocks.join_parts([blocks.pack_sorted(keys[own]), np.packbits(count[own] > 1).tobytes()])

    def meet(rows: pa.Table, told: dict[int, bytes]) -> pa.Table:
        row, prints, keys, _, cuts = by_part(rows)
        shared = np.zeros(len(keys), bool)
        for part, bits in told.items():
            shared[cuts[part] : cuts[part + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(cuts[part + 1] - cuts[part])).astype(bool)
        many = len(rows)
        size = np.bincount(row, minlength=many)
        some = np.bincount(row, shared[np.searchsorted(keys, prints)], many).astype(np.int64) if len(row) else size
        check = np.zeros(many, _U)
        if len(row):
            at = np.flatnonzero(size)
            check[at] = _set_hashes(row, prints, size[at])[1]
        # ids may repeat with other texts: only the text that has the set counts
        keep = np.flatnonzero((check.view(np.int64) == rows.column("check").to_numpy()) & (100 * some >= percent * size))
        data, offsets = kernel.buffers(rows.column("text"))
        raw = data.tobytes()
        texts = pa.array([_zip(raw[offsets[k] : offsets[k + 1]]) for k in keep.tolist()], pa.binary())
        return pa.table({"cls": rows.column("cls").take(pa.array(keep)), "n": pa.array(size[keep]), "shared": pa.array(some[keep]), "packed": texts})

    answers = blocks.exchange(packed, ask, _seen_twice, parts, packed.rdd.getNumPartitions() + 16 * shingles // blocks.BLOCK_BYTES)
    rows = blocks.meet(packed, answers, meet, "cls long, n long, shared long, packed binary")
    return rows.dropDuplicates(["cls"])


def _seen_twice(_: int, asked: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Which of its keys each block shares with another block, or repeats itself."""
    keys, several = [], []
    for _block, payload in asked:
        own, bits = blocks.split_parts(payload)
        keys.append(blocks.unpack_sorted(own))
        several.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(keys[-1])).astype(np.int64) + 1)
    key, count = np.concatenate(keys), np.concatenate(several)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    head = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    total = np.add.reduceat(count[order], np.flatnonzero(head))
    shared = np.empty(len(key), bool)
    shared[order] = (total > 1)[np.cumsum(head) - 1]
    for (block, _payload), bits in zip(asked, np.split(shared, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
        yield block, np.packbits(bits).tobytes()


def across_components(around: DataFrame, label: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between different components among the members ``around`` a centre
    (centre, own, cls, n, shared; ``own`` is the centre's component).

    Members of the centre's component needn't meet each other.  The rest meet all, a tile
    of few by few at once.  A tile first sees sizes only, and what the exact bounds leave of
    it meets again with its texts; only links come out."""
    marked = around.join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls")).withColumn("rest", F.col("label") != F.col("own"))
    many = F.count(F.lit(1))
    counts = marked.groupBy("centre").agg(F.ceil(F.count_if("rest") / TILE_ROWS).alias("_r"), F.ceil(many / TILE_ROWS).alias("_a"), F.ceil(many / SALT_ROWS).cast("int").alias("_salts")).where("_r > 0")
    counts = durable(counts)
    dealt = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    large = F.broadcast(counts.where("_salts > 1").select("centre", "_salts"))  # one centre in SALT_ROWS members at most
    salted = marked.join(large, "centre", "left").withColumn("_salt", F.pmod(F.xxhash64("cls"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    full = salted.join(dealt, ["centre", "_salt"])
    chunk = lambda n: F.pmod(F.xxhash64("cls", F.lit(1)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = ["centre", "i", "j"]
    columns = [*keys, "cls", "n", "shared", "label"]
    left = full.where("rest").withColumn("i", chunk("_r")).withColumn("j", every("_a")).select(*columns)
    right = full.withColumn("j", chunk("_a")).withColumn("i", every("_r")).select(*(F.col(c).alias(f"y_{c}") for c in columns))

    def may(t: pa.Table, m: int) -> np.ndarray:
        """Which of the first m rows may be linked with which of the others."""
        n, shared, group = (t.column(c).to_numpy() for c in ("n", "shared", "label"))
        return (group[:m, None] != group[None, m:]) & ((100 + percent) * np.minimum(shared[:m, None], shared[None, m:]) >= percent * (n[:m, None] + n[None, m:]))

    def look(x: pa.Table, y: pa.Table) -> pa.Table:
        t = pa.concat_tables([x.select(columns), y.rename_columns([c.removeprefix("y_") for c in y.column_names]).select(columns)])
        t = t.append_column("side", pa.array(np.repeat(np.array([0, 1], np.int32), [x.num_rows, y.num_rows])))
        allowed = may(t, x.num_rows)
        return t.take(pa.array(np.flatnonzero(np.concatenate((allowed.any(axis=1), allowed.any(axis=0))))))

    def compare(t: pa.Table) -> pa.Table:
        kernel.give_back()
        t = t.sort_by("side")
        m = int((t.column("side").to_numpy() == 0).sum())
        allowed, cls, n = may(t, m), t.column("cls").to_numpy(), t.column("n").to_numpy()
        row, prints = _sets_of(pa.table({"text": pa.array([zlib.decompress(x).decode() for x in t.column("packed").to_pylist()], pa.large_string())}), width)
        both = _intersections(row, prints, len(cls))
        p, q = np.nonzero(allowed)
        hit = (100 + percent) * both[p, q + m] >= percent * (n[p] + n[q + m])
        a, b = cls[p[hit]], cls[q[hit] + m]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    shape = ", ".join(f"{c} long" for c in columns)
    left_open = left.groupBy(*keys).cogroup(right.groupBy(*(f"y_{k}" for k in keys))).applyInArrow(look, f"{shape}, side int")
    return left_open.join(texts.select("cls", "packed"), "cls").groupBy(*keys).applyInArrow(compare, "a long, b long").distinct()


def _intersections(row: np.ndarray, prints: np.ndarray, n: int) -> np.ndarray:
    """Sizes of the intersections of n sets, from their (row, shingle) pairs."""
    keys, column, count = np.unique(prints, return_inverse=True, return_counts=True)
    some = count[column] > 1
    row, column = row[some], np.unique(column[some], return_inverse=True)[1]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [start, start + 4096])
        held = np.zeros((n, 4096), np.float32)
        held[row[lo:hi], column[lo:hi] - start] = 1
        both += held @ held.T
    return both.astype(np.int64)


def _told_least(edges: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """``edges`` with what ``least`` (u, m, n) says of their u.  Classes that have a share of
    1 / HOT_CLASSES of all ends of edges are told by broadcast, the others by a join."""
    if ends <= FEW_ENDS:
        return edges.join(least.drop("n"), "u")
    hot = F.col("n") * HOT_CLASSES >= ends
    few = F.broadcast(least.where(hot).drop("n"))  # at most HOT_CLASSES rows
    return edges.join(few, "u").unionByName(edges.join(few, "u", "left_anti").join(least.where(~hot).drop("n"), "u"))


def components(links: DataFrame) -> DataFrame:
    """(cls, label): the smallest class reachable over links (a, b), by alternating stars:
    large ones tie larger neighbours to the smallest, small ones the smaller."""
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends, n = 2 * edges.count(), F.count(F.lit(1)).alias("n")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), n)
        large = _told_least(both.where("v > u"), least, ends).select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"), n)
        small = _told_least(large, least, ends).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = durable(small)
        # done when the edges are stars: every class leads to one, and none that is led to leads on
        ends = edges.select(F.col("u").alias("w"), F.lit(1).alias("_out"), F.lit(0).alias("_in")).unionByName(edges.select(F.col("v").alias("w"), F.lit(0).alias("_out"), F.lit(1).alias("_in")))
        if ends.groupBy("w").agg(F.sum("_out").alias("_out"), F.max("_in").alias("_in")).where("_out > 1 OR _out = 1 AND _in = 1").isEmpty():
            return edges.select(F.col("u").alias("cls"), F.col("v").alias("label"))


def _classes(digest: DataFrame) -> DataFrame:
    """One row of each class: its smallest id, size and keys, and the range of its second hash."""
    return digest.where("cls IS NOT NULL AND doc_id IS NOT NULL").groupBy("cls").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.min("check").alias("check"), F.max("check").alias("_most"), F.first("first").alias("first"), F.first("second").alias("second")
    )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, half: int = HALF, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) of every row.

    ``component_id`` is the smallest id reachable over links of similarity percent / 100 or
    more, ``kept`` whether it is the row's own.  Null, empty and white texts have no
    shingles and no links.  Rows with a null id link nobody, have a null component and
    are kept; rows alike in id and text share all results."""
    docs = bounded_batches(docs.select(id_col, text_col))
    digest = durable(digests(docs, width, half, rows, id_col, text_col))
    sets = durable(_classes(digest))
    mixed = sets.where("check <> _most").select("cls")
    if not mixed.isEmpty():  # different sets share a name: they get longer ones
        told = mixed.withColumn("_mixed", F.lit(True))
        digest = durable(digest.join(told, "cls", "left").withColumn("cls", F.when(F.col("_mixed"), F.xxhash64("cls", "check")).otherwise(F.col("cls"))).drop("_mixed"))
        sets = durable(_classes(digest))
    table = durable(buckets(sets))
    texts = durable(candidates(docs, sets, table.select("cls").distinct(), width, percent, id_col, text_col))
    sizes = texts.select("cls", "n", "shared")
    table = table.join(sizes, "cls")
    centres = table.groupBy("bucket").agg(F.max(F.struct((F.col("shared") / F.col("n")).alias("share"), "n", "cls", "shared")).alias("c"))
    one, two = (lambda c: F.least(c, F.col("c.cls"))), (lambda c: F.greatest(c, F.col("c.cls")))
    may = F.least("shared", "c.shared") * (100 + percent) >= percent * (F.col("n") + F.col("c.n"))
    tried = durable(table.join(centres, "bucket").where((F.col("cls") != F.col("c.cls")) & may).select(one("cls").alias("a"), two("cls").alias("b")).distinct())
    links = durable(confirmed(tried, texts, width, percent))
    label = components(links)
    own = label.select(F.col("cls").alias("centre"), F.col("label").alias("own"))
    named = centres.select("bucket", F.col("c.cls").alias("centre")).join(own, "centre", "left").withColumn("own", F.coalesce("own", "centre"))
    around = table.join(named, "bucket").select("centre", "own", "cls", "n", "shared").distinct()
    more = durable(across_components(around, label, texts, width, percent))
    if not more.isEmpty():
        label = components(links.unionByName(more))
    classes = sets.select("cls", "least").join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = classes.groupBy(F.col("label").alias("u")).agg(F.min("least").alias("m"), F.count(F.lit(1)).alias("n"))
    named = _told_least(classes.select(F.col("label").alias("u"), "cls"), least, sets.count()).select("cls", F.col("m").alias("component_id"))
    out = digest.select("doc_id", "text_hash", "n_shingles", "cls").join(named, "cls", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "text_hash")


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest id,
    of rows alike in id and text one.  Rows with a null id all stay."""
    found = near_duplicates(docs, **options)
    keys = ["_id", "_hash"]
    stays = found.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    keyed = docs.where(F.col(id_col).isNotNull()).select(whole_row(docs).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"))
    # the join leaves rows dealt and sorted by its keys, so numbering them moves nothing
    numbered = keyed.join(stays, keys).withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)))
    return numbered.where("_k = 1").select("_row.*").unionByName(docs.where(F.col(id_col).isNull()))
