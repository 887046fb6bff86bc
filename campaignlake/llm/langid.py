"""Language identification by a small byte convolutional network, trained and applied in numpy.

A text is cut into windows of WINDOW bytes, all of it, the last one padded with zeros. Bytes are embedded,
filters of several widths pass over the window, each keeps its largest value (max pooling), and a softmax
layer over the rectified values gives the window's class probabilities. A text's probabilities are the mean
over its windows, weighted by their bytes. A filter is a sum of one row for each of its bytes, so applying
the network means adding table rows, two bytes at a time.

Training reads a bounded sample (TRAIN_TEXTS for each language, chosen by a hash of the doc_id, TRAIN_WINDOWS windows
of each); everything that is predicted is read whole.

Defined cases: null texts and texts without a letter are `und` with score 0; without any labelled text every
text is `und`; repeated rows and extra columns change nothing for a text's prediction; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignlake.llm import textkit as tk

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 24
EMBEDDING = 8
TRAIN_TEXTS = 300
TRAIN_WINDOWS = 4
EPOCHS = 12
BATCH = 128
RATE = 0.01
BLOCK = 64
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows by WINDOW bytes, text of each, bytes in each), texts without bytes having none."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), counts)
    start = offsets[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
    filled = np.minimum(WINDOW, offsets[1:][text] - start)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < filled[:, None]
    return np.where(inside, data[np.minimum(at, max(0, len(data) - 1))] if len(data) else 0, 0).astype(np.uint8), text, filled


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class ByteNetwork:
    """Parameters, training and application of the network."""

    def __init__(self, classes: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)
        self.classes = classes
        self.p = {"embedding": rng.normal(0, 1, (256, EMBEDDING)).astype(np.float32), "dense": draw(len(WIDTHS) * FILTERS, len(classes))}
        self.p |= {"bias": np.zeros(len(classes), np.float32), "filter_bias": np.zeros(len(WIDTHS) * FILTERS, np.float32)}
        self.p |= {w: draw(w, EMBEDDING, FILTERS) / np.float32(np.sqrt(w)) for w in WIDTHS}
        self.pairs: dict | None = None

    def _rows(self, width: int) -> np.ndarray:
        """Table rows (place in the filter, byte, filter)."""
        return np.einsum("be,jef->jbf", self.p["embedding"], self.p[width])

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 6) -> None:
        """Adam on cross entropy over windows `x` of classes `y`."""
        rng, step = np.random.default_rng(seed), 0
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                step += 1
                own = order[at : at + BATCH]
                for k, g in self._gradients(x[own].astype(np.intp), y[own]).items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict:
        n = len(x)
        rows, peaks, pooled = {}, {}, []
        for w in WIDTHS:
            rows[w] = self._rows(w)
            span = WINDOW - w + 1
            out = rows[w][0][x[:, :span]]
            for j in range(1, w):
                out += rows[w][j][x[:, j : j + span]]
            peaks[w] = out.argmax(1)
            pooled.append(np.take_along_axis(out, peaks[w][:, None], 1)[:, 0])
        z = np.concatenate(pooled, 1) + self.p["filter_bias"]
        hidden = np.maximum(z, 0)
        d = softmax(hidden @ self.p["dense"] + self.p["bias"])
        d[np.arange(n), y] -= 1
        d /= n
        back = (d @ self.p["dense"].T) * (z > 0)
        grads = {"dense": hidden.T @ d, "bias": d.sum(0), "filter_bias": back.sum(0), "embedding": np.zeros_like(self.p["embedding"])}
        line, column = np.arange(n)[:, None], np.arange(FILTERS)[None]
        for i, w in enumerate(WIDTHS):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            grads[w] = np.zeros_like(self.p[w])
            for j in range(w):
                table = np.zeros((256, FILTERS), np.float32)
                np.add.at(table, (x[line, peaks[w] + j], np.broadcast_to(column, own.shape)), own)
                grads[w][j] = self.p["embedding"].T @ table
                grads["embedding"] += table @ self.p[w][j].T
        return grads

    def _tables(self) -> dict:
        """For each width, the rows of its byte pairs, and of a last single byte."""
        if self.pairs is None:
            self.pairs = {}
            for w in WIDTHS:
                rows = self._rows(w)
                two = [(rows[j][:, None] + rows[j + 1][None]).reshape(-1, FILTERS) for j in range(0, w - 1, 2)]
                self.pairs[w] = (two, rows[w - 1] if w % 2 else None)
        return self.pairs

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.classes)), np.float32)
        for at in range(0, len(x), BLOCK):
            block = x[at : at + BLOCK].astype(np.intp)
            two = block[:, :-1] * 256 + block[:, 1:]
            pooled = []
            for w in WIDTHS:
                pairs, last = self._tables()[w]
                span = WINDOW - w + 1
                value = pairs[0].take(two[:, :span].ravel(), 0)
                for j, table in enumerate(pairs[1:], 1):
                    value += table.take(two[:, 2 * j : 2 * j + span].ravel(), 0)
                if last is not None:
                    value += last.take(block[:, w - 1 : w - 1 + span].ravel(), 0)
                pooled.append(value.reshape(len(block), span, FILTERS).max(1))
            hidden = np.maximum(np.concatenate(pooled, 1) + self.p["filter_bias"], 0)
            out[at : at + BLOCK] = softmax(hidden @ self.p["dense"] + self.p["bias"])
        return out

    def text_probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, len(self.classes)))
        for i, j in tk.slices(offsets):
            x, text, filled = windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if len(x):
                np.add.at(out, i + text, self.probabilities(x) * filled[:, None])
        return out / np.maximum(out.sum(1, keepdims=True), 1e-9)


def in_fold(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the doc_id as text leaves remainder 0: rows kept out of training."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == 0, F.lit(False))


def training_sample(docs: DataFrame, texts: int = TRAIN_TEXTS) -> list[tuple[str, str]]:
    """At most about `texts` (text, language) of each language, by a hash of the doc_id; evenly spaced windows of long texts."""
    labelled = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~in_fold(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, texts / n))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30))
    n, size = F.length("text"), WINDOW
    starts = F.transform(
        F.sequence(F.lit(0), F.lit(TRAIN_WINDOWS - 1)), lambda i: F.floor(F.greatest(n - size, F.lit(0)) * i / (TRAIN_WINDOWS - 1)).cast("int") + 1
    )
    parts = chosen.select("lang", F.array_distinct(F.transform(starts, lambda s: F.substring(F.col("text"), s, F.lit(size)))).alias("parts"))
    return [(text, r["lang"]) for r in parts.collect() for text in r["parts"]]


def train(docs: DataFrame) -> ByteNetwork | None:
    """A network for the languages of `docs` (doc_id, text, lang), None if no text has one."""
    sample = sorted(training_sample(docs))
    if not sample:
        return None
    network = ByteNetwork(sorted({lang for _, lang in sample}))
    data, offsets = tk.text_buffers(pa.array([t for t, _ in sample], pa.large_string()))
    x, text, _ = windows(data, offsets)
    first = np.unique(text, return_index=True)[1]
    classes = np.array([network.classes.index(lang) for _, lang in sample])
    network.fit(x[first], classes[text[first]])
    return network


def _predict(network, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            lettered = np.array([t.is_valid and _LETTER.search(t.as_py()) is not None for t in texts], bool)
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if network is not None and lettered.any():
                p = network.value.text_probabilities(*tk.text_buffers(texts))
                best = p.argmax(1)
                names = np.where(lettered, np.array(network.value.classes, object)[best], UNKNOWN)
                scores = np.where(lettered, np.clip(p.max(1), 0, 1), 0.0)
            columns = [pa.array(names.tolist(), pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, *columns], [*keep, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, network: ByteNetwork | None, keep: list[str]) -> DataFrame:
    """`keep` of each row of `docs` with lang_pred and score of its column text."""
    rows = docs.select(*keep, docs["text"].cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    shared = None if network is None else docs.sparkSession.sparkContext.broadcast(network)
    return rows.mapInArrow(_predict(shared, keep), f"{fields}, lang_pred string, score double")
