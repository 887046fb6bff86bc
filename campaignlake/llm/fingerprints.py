"""Document fingerprints by consistent weighted sampling.

A text is the weighted set of its words (weight: occurrences). For each of SAMPLES independent draws, a word's
gamma-distributed parameters follow from its hash alone, and the word with the least
ln a = ln c - r (t - beta) - r, t = floor(ln w / r + beta), is the sample, together with t. Two texts draw the
same (word, t) with a chance equal to their generalised Jaccard similarity, sum of min over sum of max of the
weights. The least value itself identifies the pair (word, t), so 16 bits of it stand for the sample.

Defined cases: null text is empty; a text without words has a fixed fingerprint, alike to others without words
only; repeated rows follow each other in the order; doc_id null comes last; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from campaignlake.llm import textkit as tk
from campaignlake.llm.common import staged

SAMPLES = 64
RANGE_ROWS = 8192
TEXTS_AT_ONCE = 256

_SEEDS = np.random.default_rng(77).integers(1, 1 << 63, (SAMPLES, 2), dtype=np.uint64)
_ONE = np.float32(1.0 / (1 << 21))
_LOW = np.uint64((1 << 21) - 1)


def _uniform(x: np.ndarray, shift: int) -> np.ndarray:
    """Floats in (0, 1) from 21 bits of each value."""
    return (((x >> np.uint64(shift)) & _LOW).astype(np.float32) + np.float32(0.5)) * _ONE


def gamma_parameters(terms: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, ln c, beta) of each term: r and c from Gamma(2, 1), beta uniform."""
    x, y = tk.mixed(terms ^ _SEEDS[sample, 0]), tk.mixed(terms ^ _SEEDS[sample, 1])
    r = -np.log(_uniform(x, 0) * _uniform(x, 21))
    c = -np.log(_uniform(x, 42) * _uniform(y, 0))
    return r, np.log(c), _uniform(y, 21)


def weighted_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, index of term, weight) of each different word of each text, by text, and the terms."""
    starts, ends, bounds = tk.word_edges(data, offsets, tk.SPACED)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    terms, index = np.unique(tk.word_hashes(data, starts, ends), return_inverse=True)
    pairs, weight = np.unique(text * max(1, len(terms)) + index, return_counts=True)
    return pairs // max(1, len(terms)), pairs % max(1, len(terms)), weight, terms


def samples(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, SAMPLES) 16-bit samples; texts without words have zeros."""
    text, index, weight, terms = weighted_terms(data, offsets)
    out = np.zeros((len(offsets) - 1, SAMPLES), np.uint16)
    if not len(text):
        return out
    filled, first = np.unique(text, return_index=True)
    more = np.flatnonzero(weight > 1)
    log_w, at = np.log(weight[more].astype(np.float32)), index[more]
    for s in range(SAMPLES):
        r, ln_c, beta = gamma_parameters(terms, s)
        value = ((ln_c + r * beta) - r)[index]
        rm, bm = r[at], beta[at]
        t = np.floor(log_w / rm + bm)
        value[more] = (ln_c[at] - rm * (t - bm)) - rm
        least = np.minimum.reduceat(value, first)
        bits = (least.view(np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47)
        out[filled, s] = (bits & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def text_samples(texts: list[str]) -> np.ndarray:
    data, offsets = tk.text_buffers(pa.array(texts, pa.large_string()))
    return np.concatenate([samples(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in tk.slices(offsets)])


def edited(text: str, following: str) -> str:
    """The last third replaced by as many characters from the start of the following text, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
EDGE = "part int, head string, tail string"


def _rows(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """Result rows of texts and the texts that follow them."""
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    n = len(texts)
    all_ = text_samples([x for pair in zip(texts, changed, strict=True) for x in pair] + following[-1:])
    own, other = all_[0 : 2 * n : 2], all_[1 : 2 * n : 2]
    after = np.concatenate([own[1:], all_[2 * n :]]) if texts[1:] == following[:-1] else text_samples(following)
    hexes = lambda m: [x.astype(">u2").tobytes().hex() for x in m]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(x) for x in texts], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
            pa.array(hexes(own)),
            pa.array(hexes(other)),
            pa.array((own == other).mean(1)),
            pa.array((own == after).mean(1)),
            *(pa.nulls(n, kind) for kind in (pa.int32(), pa.string(), pa.string())),
        ],
        [x.split()[0] for x in f"{ROW}, {EDGE}".split(", ")],
    )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order. The range's last text waits for the next range's first one: one edge row has both."""
    head = part = None
    waiting: tuple[list, list[str]] = ([], [])
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            piece = batch.slice(at, TEXTS_AT_ONCE)
            ids = waiting[0] + piece.column("doc_id").to_pylist()
            texts = waiting[1] + [x or "" for x in piece.column("_text").to_pylist()]
            if part is None:
                part, head = piece.column("_part")[0].as_py(), texts[0]
            if len(texts) > 1:
                yield _rows(ids[:-1], texts[:-1], texts[1:])
            waiting = (ids[-1:], texts[-1:])
    if part is not None:
        names = [x.split() for x in f"{ROW}, {EDGE}".split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
        row = dict(doc_id=waiting[0][0], part=part, head=head, tail=waiting[1][0])
        yield pa.RecordBatch.from_pylist([row], pa.schema([(n, kinds[k]) for n, k in names]))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            ids, tails, heads = (batch.column(x).to_pylist() for x in ("doc_id", "tail", "next"))
            yield _rows(ids, tails, heads)


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): its fingerprint, and that of its text as edited with the next
    document's, next in descending doc_id and the first after the last.

    Texts are shuffled once, into ranges of doc_id; the ranges' ends are the only texts that move again.
    """
    texts = docs.select(F.col("doc_id").cast("long"), docs["text"].cast("string").alias("_text"))
    ranges = max(1, -(-texts.count() // RANGE_ROWS))
    order = [F.desc_nulls_last("doc_id"), F.desc_nulls_last("_text")]
    ranged = texts.repartitionByRange(ranges, order[0]).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    done = staged(ranged.mapInArrow(_stream, f"{ROW}, {EDGE}"), "fingerprints")
    by_part = Window.orderBy("part")
    every = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = done.where("part is not null").withColumn("next", F.coalesce(F.lead("head").over(by_part), F.first("head").over(every)))
    last = ends.select("doc_id", "tail", "next").mapInArrow(_edges, f"{ROW}, {EDGE}")
    return done.where("part is null").unionByName(last).select(*[x.split()[0] for x in ROW.split(", ")])
