"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of a whole text (length, word lengths, shares of kinds of characters, repetition of words and lines,
marks at word ends) are taken over byte and word arrays and transformed towards bell-shaped values. Each class
has its mean and covariance over all labelled training documents, from sums that Spark adds up. Covariances are
shrunk towards the pooled one and the scaled identity, their Cholesky factors are computed once, and the score
is the logistic of the difference of Mahalanobis log densities plus the log prior ratio.

Defined cases: null text is empty, and empty texts are scored from their statistics like others; labels that are
null are not learned; a doc_id with several labels counts once for each; if training has not both classes, every score is the
share of label 1 (0 without labels); extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlake.llm import textkit as tk
from campaignlake.llm.common import staged
from campaignlake.llm.langid import in_fold

THRESHOLD = 0.3
#: Weights of the pooled covariance and of the scaled identity in each class covariance.
SHRINK_POOLED, SHRINK_IDENTITY = 0.05, 0.02

_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[48:58] = 2
_KIND[65:91] = 3
_KIND[97:123] = 4
_KIND[128:] = 5
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 6


def _by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Different hashes of each text."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).astype(np.uint64)
    keys = np.unique((text << np.uint64(48)) | (hashes & tk.MASK48))
    return np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=len(bounds) - 1)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, statistics), transformed."""
    size = np.diff(offsets).astype(np.float64)
    kind = _KIND[data]
    share = [_by_text(kind == k, offsets) / np.maximum(size, 1) for k in range(1, 7)]
    starts, ends, bounds = tk.word_edges(data, offsets, tk.SPACED)
    n = np.diff(bounds).astype(np.float64)
    some = np.maximum(n, 1)
    length = (ends - starts).astype(np.float64)
    mean = _by_text(length, bounds) / some
    spread = np.sqrt(np.maximum(_by_text(length**2, bounds) / some - mean**2, 0))
    long_ = _by_text(length > 12, bounds) / some
    marked = _by_text(kind[ends - 1] == 6, bounds) / some
    only = np.concatenate([[0], np.cumsum(kind == 6)])
    bare = _by_text(only[ends] - only[starts] == ends - starts, bounds) / some
    doubled = np.zeros(len(ends), bool)
    two = ends - starts > 1
    doubled[two] = (kind[ends[two] - 1] == 6) & (data[ends[two] - 1] == data[ends[two] - 2])
    doubled = _by_text(doubled, bounds) / some
    words = _distinct(tk.word_hashes(data, starts, ends), bounds)
    lines = tk.separators((10, 10))
    first, last, at = tk.word_edges(data, offsets, lines)
    line_n = np.maximum(np.diff(at), 1)
    line_distinct = _distinct(tk.word_hashes(data, first, last), at)
    root = lambda x: np.sqrt(np.clip(x, 0, None))
    return np.stack(
        [
            np.log1p(n),
            np.log1p(mean),
            np.log1p(spread),
            np.log((words + 1) / (n + 2)) / np.log(n + 3),
            1 - line_distinct / line_n,
            np.log1p(size / line_n),
            root(long_),
            root(marked),
            root(bare),
            root(doubled),
            *[root(x) for x in share],
        ],
        1,
    )


N_STATISTICS = 16


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tk.text_buffers(batch.column("_text"))
        for i, j in tk.slices(offsets):
            x = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_STATISTICS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).select(["doc_id", "held_out"]).columns, flat], ["doc_id", "held_out", "x"])


def document_statistics(docs: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), docs["text"].cast("string").alias("_text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_measure, f"doc_id {kind}, held_out boolean, x array<double>")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (label, i, j) of the sums of products of (1, x) with itself."""
    totals = np.zeros((2, N_STATISTICS + 1, N_STATISTICS + 1))
    for batch in batches:
        x = np.array(batch.column("x").to_pylist(), np.float64).reshape(-1, N_STATISTICS)
        x = np.concatenate([np.ones((len(x), 1)), x], 1)
        y = batch.column("quality").to_numpy(zero_copy_only=False).astype(int)
        for label in (0, 1):
            totals[label] += x[y == label].T @ x[y == label]
    label, i, j = (v.ravel().astype(np.int32) for v in np.indices(totals.shape))
    yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(i), pa.array(j), pa.array(totals.ravel())], ["label", "i", "j", "value"])


class Discriminant:
    """Class means, Cholesky factors of the shrunk class covariances and log priors; None stands for a missing class."""

    def __init__(self, sums: np.ndarray):
        counts = sums[:, 0, 0]
        self.share = float(counts[1] / counts.sum()) if counts.sum() else 0.0
        self.classes = None
        if counts.min() > 0:
            means = sums[:, 0, 1:] / counts[:, None]
            own = [sums[k, 1:, 1:] / counts[k] - np.outer(means[k], means[k]) for k in (0, 1)]
            pooled = (own[0] * counts[0] + own[1] * counts[1]) / counts.sum()
            # A class of few rows has little spread of its own: the identity keeps its covariance invertible.
            self.scale = np.sqrt(np.diag(pooled) + 1e-9)
            self.classes = []
            unit = lambda c: c / np.outer(self.scale, self.scale)
            for k in (0, 1):
                c = (1 - SHRINK_POOLED - SHRINK_IDENTITY) * unit(own[k]) + SHRINK_POOLED * unit(pooled)
                c += SHRINK_IDENTITY * max(np.trace(unit(own[k])) / len(c), 1e-3) * np.eye(len(c))
                factor = np.linalg.cholesky(c)
                constant = np.log(counts[k] / counts.sum()) - np.log(np.diag(factor)).sum()
                self.classes.append((means[k] / self.scale, np.linalg.inv(factor), constant))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.share)
        low, high = (c - 0.5 * (((x / self.scale - m) @ f.T) ** 2).sum(1) for m, f, c in self.classes)
        return 1 / (1 + np.exp(np.clip(low - high, -500, 500)))


def fit(measured: DataFrame, labels: DataFrame) -> Discriminant:
    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = measured.where("not held_out").join(known, "doc_id").select("x", "quality")
    parts = rows.mapInArrow(_sums, "label int, i int, j int, value double").groupBy("label", "i", "j").agg(F.sum("value").alias("value"))
    sums = np.zeros((2, N_STATISTICS + 1, N_STATISTICS + 1))
    for r in parts.collect():
        sums[r["label"], r["i"], r["j"]] = r["value"]
    return Discriminant(sums)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), np.float64).reshape(-1, N_STATISTICS)
            s = model.value.scores(x)
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["doc_id", "held_out"]).columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of `docs`, learned from the labels outside the held-out fold."""
    measured = staged(document_statistics(docs), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(fit(measured, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return measured.mapInArrow(_score(model), f"doc_id {kind}, held_out boolean, score double, predicted int")
