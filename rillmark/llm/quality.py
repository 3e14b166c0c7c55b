"""Quality classifier (operator 6): naive Bayes support vectors over n-gram indicators.

Features are whether a text holds a byte n-gram (orders 1 to 3, case kept), a word, or a
word n-gram that repeats one word, hashed to a fixed number of columns.  Training scales each indicator by its class
log-count ratio and fits a linear hinge-loss model by dual coordinate descent; a sigmoid
over the margins, fitted on folds the model had not seen, makes a probability.

The model is fitted on a bounded sample of labelled rows (``sample`` and ``sample_features``,
smallest hashes of ids first); every row is scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import bounded_batches

COLUMNS = 1 << 18
ORDERS = (1, 2, 3)
#: Lengths of runs of one word that are features.
REPEATS = (2, 3, 5)
_U = np.uint64


def indicators(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row, row, feature) of the distinct features of each text."""
    data, offsets = kernel.buffers(column)
    for i, j in kernel.slices(offsets, kernel.SLICE_BYTES // 2):
        b, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n = len(b)
        row = np.repeat(np.arange(j - i), np.diff(offs))
        keys = []
        gram = np.zeros(n, _U)
        for order in ORDERS:
            m = n - order + 1
            if m <= 0:
                break
            gram = gram[:m] * _U(256) + b[order - 1 :]
            inside = row[:m] == row[order - 1 :]
            feature = kernel.mix64(gram[inside] + (_U(order) << _U(56))) % _U(COLUMNS)
            keys.append(row[:m][inside].astype(_U) * _U(COLUMNS) + feature)
        starts, ends, counts = kernel.word_spans(b, offs)
        words = kernel.hash_spans(b[~kernel.SPACE[b]], ends - starts)
        word_row = np.repeat(np.arange(j - i), counts)
        keys.append(word_row.astype(_U) * _U(COLUMNS) + words % _U(COLUMNS))
        # runs of one word, whichever word it is
        same = (words[1:] == words[:-1]) & (word_row[1:] == word_row[:-1])
        for order in REPEATS:
            run = same[: max(0, len(same) - order + 2)].copy()
            for k in range(1, order - 1):
                run &= same[k : k + len(run)]
            keys.append(word_row[:-1][: len(run)][run].astype(_U) * _U(COLUMNS) + kernel.mix64(np.full(int(run.sum()), order, _U)) % _U(COLUMNS))
        key = np.sort(np.concatenate(keys))
        if len(key):
            key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        yield i, j, (key // _U(COLUMNS)).astype(np.int64), (key % _U(COLUMNS)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for i, j, row, feature in indicators(column):
            scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=j - i), 1))
            out[i:j] += np.bincount(row, self.weights[feature], j - i) * scale
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(column) + self.shift, -30, 30)))


def log_count_ratios(rows: list[np.ndarray], label: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of smoothed counts of each feature in either class."""
    sums = []
    for kind in (1, 0):
        count = np.full(COLUMNS, smooth)
        for k in np.flatnonzero(label == kind):
            count[rows[k]] += 1
        sums.append(np.log(count / count.sum()))
    return sums[0] - sums[1]


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, label: np.ndarray, cost: float, passes: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model over indicator rows whose
    columns are multiplied by ``scale``; each class has the same total cost."""
    y = np.where(label == 1, 1.0, -1.0)
    upper = cost * np.where(label == 1, len(label) / (2 * max(1, (label == 1).sum())), len(label) / (2 * max(1, (label == 0).sum())))
    values = [scale[r] / np.sqrt(max(len(r), 1)) for r in rows]
    norm = np.array([v @ v + 1 for v in values])
    w, bias, alpha = np.zeros(COLUMNS), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            gradient = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[r] += step * v
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3 * cost:
            break
    return w, bias


def sigmoid(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of label 1 over margins, by Newton steps on the
    log-likelihood with softened labels."""
    pos, neg = (label == 1).sum(), (label == 0).sum()
    goal = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = p - goal, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * margin).sum() + 1e-6 * a, g.sum()])
        hess = np.array([[(h * margin**2).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-6), float(b)


def fit(rows: list[np.ndarray], label: np.ndarray, cost: float = 1.0, passes: int = 20, folds: int = 3, seed: int = 11) -> Model:
    """Fit on the features of texts labelled 0 and 1.  With one class only, every score is
    that class's share with one example of either added."""
    pos = int((label == 1).sum())
    if pos in (0, len(label)):
        return Model(np.zeros(COLUMNS), 0.0, 1.0, float(np.log((pos + 1) / (len(label) - pos + 1))))

    def one(at: np.ndarray) -> tuple[np.ndarray, float]:
        part = [rows[k] for k in at]
        ratio = log_count_ratios(part, label[at])
        w, bias = dual_coordinate_descent(part, ratio, label[at], cost, passes, seed)
        return w * ratio, bias

    fold = np.random.default_rng(seed).integers(0, folds, len(label))
    margin = np.zeros(len(label))
    whole = one(np.arange(len(label)))
    for f in range(folds):
        inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(np.unique(label[inside])) < 2:
            w, bias = whole
        else:
            w, bias = one(inside)
        for k in outside:
            margin[k] = bias + w[rows[k]].sum() / np.sqrt(max(len(rows[k]), 1))
    return Model(*whole, *sigmoid(margin, label))


def _to_bytes(feature: np.ndarray) -> bytes:
    """Distinct features as a list, or as a map of all columns where that is shorter."""
    if 32 * len(feature) < COLUMNS:
        return b"l" + feature.astype("<u4").tobytes()
    held = np.zeros(COLUMNS, bool)
    held[feature] = True
    return b"m" + np.packbits(held).tobytes()


def _from_bytes(data: bytes) -> np.ndarray:
    if data[:1] == b"l":
        return np.frombuffer(data, "<u4", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1)))


def train(
    docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (5, 0), sample: int = 4000, sample_features: int = 1 << 25, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> Model:
    """Fit on at most ``sample`` labelled rows, and as many of these as have ``sample_features``
    features together, whose crc32(id as text) mod held_out[0] isn't held_out[1].  Rows with
    a null id, text or label don't train; an id with several texts or labels trains with each.

    Executors make the features, of whole texts; a row's are at most 32 KB, so the driver
    gets at most ``sample`` times as much."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).where("_id IS NOT NULL AND _label IN (0, 1)").distinct()
    known = known.where(F.pmod(F.crc32(F.col("_id").cast("string").cast("binary")), F.lit(held_out[0])) != held_out[1])
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample)
    order = [F.xxhash64("_id"), "_id", "_label", F.xxhash64("_text")]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text IS NOT NULL").join(F.broadcast(chosen), "_id")
    rows = rows.select(F.struct(*order).alias("_order"), F.col("_label").cast("int").alias("_label"), "_text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for i, j, row, feature in indicators(batch.column(2)):
                out += map(_to_bytes, np.split(feature, np.cumsum(np.bincount(row, minlength=j - i))[:-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["_order", "_label", "_features"])

    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields[:2], T.StructField("_features", T.BinaryType())])
    got = bounded_batches(rows).mapInArrow(kernel.lean(features), schema).orderBy("_order").limit(sample).select("_label", "_features").collect()
    texts = [_from_bytes(r["_features"]) for r in got]
    texts = texts[: int(np.searchsorted(np.cumsum([len(t) for t in texts]), sample_features, side="right"))] if texts else texts
    model = fit(texts, np.array([r["_label"] for r in got[: len(texts)]], np.int64))
    del got, texts
    kernel.give_back()  # of the driver's memory
    return model


def classify(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with score and predicted (a clash is resolved by replacing).
    Null and empty texts have no features and score by the bias."""
    docs = bounded_batches(docs.drop("score", "predicted"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = held.value.scores(batch.column(batch.schema.get_field_index(text_col)))
            yield batch.append_column("score", pa.array(score)).append_column("predicted", pa.array((score >= threshold).astype(np.int32)))

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(kernel.lean(run), schema)

