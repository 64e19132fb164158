"""Toxicity of cells: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import cells, named, stored
from .hashing import ALPHANUMERIC, FOLDED_VALUES, Spans, chunks, mix, segment_of, word_bounds
from .packing import _arrow_type

#: Hashed features are numbered below this.
BUCKETS = 1 << 20
#: Labelled rows a model is fitted on, at most; which ones, their hash decides.
FIT_ROWS = 20_000
#: Word beginnings, in bytes, that count as words of their own: inflected forms share them.
BEGINNINGS = (4, 5, 6)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For chunks of a text column: first row, number of rows, and each feature's row and bucket, repeats included.

    Features are words, beginnings of words, neighbouring words and pairs with
    one word between. Pairs never cross cells.
    """
    for chunk in chunks(column):
        starts, ends, before = word_bounds(chunk, ALPHANUMERIC)
        spans = Spans(chunk.data, FOLDED_VALUES)
        words = spans.hash(starts, ends)
        row = segment_of(before, len(words))
        rows, found = [row], [mix(words)]
        for size in BEGINNINGS:
            long = ends - starts >= size
            rows.append(row[long])
            found.append(mix(spans.hash(starts[long], starts[long] + size) ^ np.uint64(size)))
        for gap in (1, 2):
            same = row[gap:] == row[:-gap] if len(row) > gap else np.zeros(0, bool)
            pair = mix(words[:-gap] + np.uint64(gap)) ^ words[gap:] if len(row) > gap else np.zeros(0, np.uint64)
            rows.append(row[gap:][same] if len(row) > gap else np.zeros(0, row.dtype))
            found.append(mix(pair)[same])
        buckets = (np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int64)
        yield chunk.first, chunk.last - chunk.first, np.concatenate(rows), buckets


class Ftrl:
    """FTRL-proximal: per-coordinate learning rates, L1 for sparse weights; the intercept is free of it."""

    def __init__(self, alpha: float = 0.1, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0, base: float = 0.0):
        """``base`` is the log odds from which the intercept is learned."""
        self.alpha, self.beta, self.l1, self.l2, self.base = alpha, beta, l1, l2, base
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == BUCKETS, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w) + np.where(np.asarray(at) == BUCKETS, self.base, 0.0)

    def learn(self, buckets: np.ndarray, label: int) -> None:
        at = np.append(buckets, BUCKETS)  # the last is the intercept
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        w[-1] -= self.base
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60.0, 60.0)))


def fit(
    sheet: DataFrame, labels: DataFrame, row_id: str = "row_id", column: str = "value", label_id: str = "row_id", label: str = "label",
    where: Column | None = None, passes: int = 4, fit_rows: int = FIT_ROWS,
) -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights (buckets, values) from labelled rows; bucket ``BUCKETS`` is the intercept.

    ``where`` says which rows of ``labels`` may be used. At most ``fit_rows``
    of them are, those first in the order of their hash, so a fit is one task
    of bounded size and the same at every run. Rows with a null id or label
    are left out; without any labelled row all weights are 0.
    """
    usable = labels if where is None else labels.filter(where)
    usable = usable.select(named(label_id).alias("row_id"), named(label).cast("int").alias("label")).dropna().distinct()
    chosen = usable.orderBy(F.xxhash64("row_id"), "row_id", "label").limit(fit_rows)
    rows = cells(sheet, row_id, column).join(F.broadcast(chosen), "row_id")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            keys, outcome = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, n, at, buckets in features(batch.column(1)):
                order = np.argsort(at, kind="stable")
                bounds = np.searchsorted(at[order], np.arange(n + 1))
                for i in range(n):
                    own = np.unique(buckets[order[bounds[i]:bounds[i + 1]]]).astype(np.int32)
                    examples.append((str(keys[first + i]), len(own), own, outcome[first + i]))
        examples.sort(key=lambda x: x[:2])
        ones = sum(x[3] for x in examples)
        model = Ftrl(base=float(np.log((ones + 1) / (len(examples) - ones + 1))))
        for k in range(passes):
            for i in np.random.default_rng(k).permutation(len(examples)):
                model.learn(*examples[i][2:])
        w = model.weights(np.arange(BUCKETS + 1))
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(w[kept], pa.float64())], ["bucket", "weight"])

    # The scan and join stay parallel; only the chosen rows go to the one task.
    rows = stored(rows.select("row_id", "cell", "label"), "fit-rows")
    found = rows.coalesce(1).mapInArrow(train, "bucket int, weight double").toArrow()
    return found.column(0).to_numpy(), found.column(1).to_numpy()


def toxicity_scores(sheet: DataFrame, weights: tuple[np.ndarray, np.ndarray], row_id: str = "row_id", column: str = "value") -> DataFrame:
    """``row_id`` and ``score`` (0 to 1, higher is likelier toxic) of every row's whole cell.

    A feature counts once per cell. Null and empty cells get the score of the
    intercept alone; repeated rows get equal scores. The weights are sparse
    and have at most ``BUCKETS`` + 1 entries, so they travel with the task.
    """
    source = cells(sheet, row_id, column)
    kind, key_type = source.schema["row_id"].dataType.simpleString(), _arrow_type(source)
    places, values = weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS + 1, np.float32)
        table[places] = values
        intercept = float(table[BUCKETS])
        for batch in batches:
            total = np.full(batch.num_rows, intercept)
            for first, n, at, buckets in features(batch.column(1)):
                live = table[buckets] != 0
                pairs = np.unique(at[live] * np.int64(BUCKETS) + buckets[live])
                rows, own = pairs // BUCKETS, pairs % BUCKETS
                total[first:first + n] += np.bincount(rows, table[own], n)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(key_type), pa.array(sigmoid(total))], ["row_id", "score"])

    return source.mapInArrow(score, f"row_id {kind}, score double")
