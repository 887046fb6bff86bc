"""Maximal periodic runs of words, by tiles for each octave of periods.

A run of period q is a longest stretch of words in which words q apart are equal, at least twice as long as q and
at least LEAST words. Where words q apart are equal for a stretch of h words (a run has h >= q, and more for the
shortest periods), that stretch holds a whole block of an aligned grid of about half that width. So each octave of
periods has a grid of blocks; a block whose hash is found again a period later is a centre, all others can't lie in a
run. Centres that are close together make a tile: the words around them that their octave can need, and no more.

Tiles are rows of a DataFrame and are solved independently: at a centre the Z-function of the words after it tells
for every period of the octave how far the words q apart agree to the right, that of the reversed words before it how
far to the left, both up to the tile's reach. A period whose word is a power of a shorter one is dropped by the same
Z-function, since the shorter period's run is the same stretch. The agreeing intervals are shuffled by document and
period and stitched where they overlap; reach is at least the distance of centres, so intervals of one run do.

Work is linear in the words for each octave, and tiles of a long document are spread over tasks. Documents without a
centre take no part in any shuffle but the last, which brings the runs to their documents as small rows.

Defined cases: null and empty texts have no words and no runs; repeated rows are solved one by one; an empty table
gives no rows; only the columns in `keep` and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campaignlake.llm.common import staged
from campaignlake.llm.textkit import mixed

#: Words of the shortest run. The grid of the first octave rests on it.
LEAST = 12
#: Grid steps that one tile spans at most.
TILE_STEPS = 64
#: Words of an output batch, and of the tiles that one task solves, about.
BATCH_WORDS, TASK_WORDS = 1 << 20, 1 << 18

TILE = "array<struct<low:int,high:int,block:int,reach:int,start:long,centres:array<int>,words:binary>>"
_TILE_TYPE = pa.list_(
    pa.struct([("low", pa.int32()), ("high", pa.int32()), ("block", pa.int32()), ("reach", pa.int32()), ("start", pa.int64()), ("centres", pa.list_(pa.int32())), ("words", pa.binary())])
)
RUNS = "array<struct<start:long,period:long,length:long>>"


class Octave(NamedTuple):
    low: int
    high: int
    step: int
    block: int
    reach: int


def octaves(n: int) -> list[Octave]:
    """Octaves of the periods that a text of n words can have. Words q apart agree over max(LEAST, 2q) - q words, which
    is 6 or more for periods up to 7 and 2^k or more in octave k; that holds an aligned block of 3, or of 2^(k-1)."""
    if n < LEAST:
        return []
    out = [Octave(1, min(7, n // 2), 4, 3, 8)]
    k = 3
    while 1 << k <= n // 2:
        out.append(Octave(1 << k, min((2 << k) - 1, n // 2), 1 << (k - 1), 1 << (k - 1), 1 << k))
        k += 1
    return out


# ---- tiles of a document

def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)


def centres(numbers: np.ndarray) -> Iterator[tuple[Octave, np.ndarray]]:
    """For each octave the grid positions whose block occurs again a period of the octave later. Equal blocks have equal
    hashes; a chance collision costs a needless centre only."""
    n = len(numbers)
    hashes = mixed(numbers.astype(np.uint64) + np.uint64(1))
    pairs = _joined(hashes[:-1], hashes[1:])
    size, block = 2, pairs
    for octave in octaves(n):
        if octave.block == 3:
            found = _joined(pairs[:-1], hashes[2:])
        else:
            while size < octave.block:
                block = _joined(block[:-size], block[size:])
                size *= 2
            found = block
        at = np.arange(0, len(found) - octave.low, octave.step)
        if len(at):
            # Zero stands for no block beyond the end; a block of hash zero costs a needless centre.
            padded = np.concatenate([found, np.zeros(octave.high, np.uint64)])
            later = np.lib.stride_tricks.sliding_window_view(padded, octave.high - octave.low + 1)[at + octave.low]
            at = at[(later == found[at, None]).any(axis=1)]
            if len(at):
                yield octave, at


def tiles(numbers: np.ndarray) -> list[dict]:
    out = []
    for octave, at in centres(numbers):
        for own in np.split(at, np.flatnonzero(np.diff(at // (octave.step * TILE_STEPS))) + 1):
            start = max(0, int(own[0]) - octave.reach)
            words = numbers[start : int(own[-1]) + octave.high + octave.reach + 1]
            out.append(
                {"low": octave.low, "high": octave.high, "block": octave.block, "reach": octave.reach, "start": start, "centres": own - start, "words": words.astype("<i4").tobytes()}
            )
    return out


# ---- a tile's intervals

def z_function(s: list[int]) -> list[int]:
    """z[i]: how many elements from i on equal those from 0 on."""
    n = len(s)
    z = [n] + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@lru_cache(1 << 16)
def prime_divisors(q: int) -> tuple[int, ...]:
    out, r = [], 2
    while r * r <= q:
        if q % r == 0:
            out.append(r)
            while q % r == 0:
                q //= r
        r += 1
    return (*out, q) if q > 1 else tuple(out)


def intervals(words: list[int], octave: Octave, at: list[int]) -> Iterator[tuple[int, int, int]]:
    """(period, from, to): words of the tile agree with those a period later in [from, to), as far as a centre sees."""
    low, high, _, block, reach = octave
    for c in at:
        ahead = z_function(words[c : c + high + reach + 1])
        periods = [q for q in range(low, min(high, len(ahead) - 1) + 1) if ahead[q] >= block]
        periods = [q for q in periods if all(ahead[q // r] < q - q // r for r in prime_divisors(q))]
        if not periods:
            continue
        before = words[max(0, c - reach) : c][::-1]
        behind = z_function([*before, -1, *words[max(0, c + low - reach) : c + high][::-1]])
        end = min(c + high, len(words))
        for q in periods:
            right = min(ahead[q], reach)
            left = behind[len(before) + 1 + end - (c + q)] if before else 0
            if left == reach or right == reach or left + right + q >= max(LEAST, 2 * q):
                yield q, c - left, c + right


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for t in batch.to_pylist():
            words = np.frombuffer(t["words"], "<i4").tolist()
            octave = Octave(t["low"], t["high"], 0, t["block"], t["reach"])
            rows += [(t["_row"], q, t["start"] + a, t["start"] + b) for q, a, b in intervals(words, octave, t["centres"])]
        numbers = np.array(rows, np.int64).reshape(-1, 4).T
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in numbers], ["_row", "period", "low", "high"])


# ---- documents

def _tiled(keep: list[str], texts: bool):
    def flushed(batch: pa.RecordBatch, rows: list[int], found: list[tuple]) -> pa.RecordBatch:
        kinds = {"n_words": pa.int64(), "plain": pa.string(), "_words": pa.binary(), "_tiles": _TILE_TYPE, "_work": pa.int64()}
        columns = list(zip(*found, strict=True)) or [()] * len(kinds)
        kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in keep]
        return pa.RecordBatch.from_arrays([*kept, *map(pa.array, columns, kinds.values())], [*keep, *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, held = [], [], 0
            for i, text in enumerate(batch.column("_text")):
                # The white space of bytes.split() is that of the words: 0x20 and 0x09 to 0x0D.
                words = text.as_buffer().to_pybytes().split()
                joined = b" ".join(words)
                own = tiles(word_numbers(words))
                plain = None if own else joined.decode() if texts else hashlib.sha256(joined).hexdigest()
                rows.append(i)
                found.append((len(words), plain, joined if own else None, own, sum(len(t["words"]) for t in own) // 4))
                held += len(words)
                if held >= BATCH_WORDS:
                    yield flushed(batch, rows, found)
                    rows, found, held = [], [], 0
            yield flushed(batch, rows, found)

    return run


def _tiled_documents(docs: DataFrame, keep: list[str], texts: bool) -> DataFrame:
    """Each row of `docs` with its tiles; documents without one carry their final text, or its digest, already."""
    spare = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*[docs[c].alias(s) for c, s in zip(keep, spare, strict=True)], F.coalesce(F.encode(docs["text"].cast("string"), "UTF-8"), F.lit(b"")).alias("_text"))
    kept = [f"`{s}` {docs.schema[c].dataType.simpleString()}" for c, s in zip(keep, spare, strict=True)]
    fields = ", ".join([*kept, "n_words long", "plain string", "_words binary", f"_tiles {TILE}", "_work long"])
    return staged(rows.mapInArrow(_tiled(spare, texts), fields).withColumn("_row", F.monotonically_increasing_id()), "word-tiles")


def _stitched(fragments: DataFrame) -> DataFrame:
    """(_row, start, period, length) of the runs that the tiles' intervals make."""
    of_period = Window.partitionBy("_row", "period").orderBy("low", "high")
    reached = F.max("high").over(of_period.rowsBetween(Window.unboundedPreceding, -1))
    begun = fragments.withColumn("_new", F.coalesce(F.col("low") > reached, F.lit(True)).cast("int"))
    island = F.sum("_new").over(of_period.rowsBetween(Window.unboundedPreceding, 0))
    whole = begun.withColumn("_island", island).groupBy("_row", "period", "_island").agg(F.min("low").alias("start"), F.max("high").alias("_high"))
    length = F.col("_high") - F.col("start") + F.col("period")
    return whole.select("_row", "start", "period", length.alias("length")).where(F.col("length") >= F.greatest(F.lit(LEAST), 2 * F.col("period")))


def _runs_of_rows(tiled: DataFrame) -> DataFrame:
    # Tiles are small for the work they are, so tasks are dealt by their words and not by bytes.
    work = tiled.agg(F.sum("_work")).first()[0] or 0
    rows = tiled.where(F.size("_tiles") > 0).select("_row", F.inline("_tiles")).repartition(1 + work // TASK_WORDS, "_row", "low", "start")
    return _stitched(rows.mapInArrow(_solved, "_row long, period long, low long, high long"))


def _collapsed(keep: list[str], texts: bool):
    """Fills the final text, or its digest, of documents that had tiles."""

    def final(joined: bytes, runs: list[dict] | None) -> str:
        words = joined.split(b" ")
        if runs:
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, [r["start"] + r["period"] for r in runs], 1)
            np.add.at(edges, [r["start"] + r["length"] for r in runs], -1)
            joined = b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)])
        return joined.decode() if texts else hashlib.sha256(joined).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.column("plain").to_pylist()
            for i in np.flatnonzero(batch.column("_words").is_valid().to_numpy(zero_copy_only=False)):
                out[i] = final(batch.column("_words")[i].as_py(), batch.column("runs")[i].as_py())
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(out, pa.string())], [*keep, "collapsed"])

    return run


def periodic_runs(docs: DataFrame, keep: list[str], texts: bool = True) -> DataFrame:
    """(*keep, n_words, runs, collapsed) of each row of `docs`.

    `runs` are (start, period, length) in words, by start and then period; an array is as long as its document at
    most. `collapsed` is the text of the words that no run holds after its first period, joined by spaces; without
    `texts` it is that text's sha256 in hexadecimal, and documents without runs never leave their task as text."""
    tiled = _tiled_documents(docs, keep, texts)
    runs = _runs_of_rows(tiled).groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    joined = tiled.drop("_tiles", "_work").join(runs, "_row", "left").withColumn("runs", F.coalesce("runs", F.array().cast(RUNS)))
    kept = [f for f in joined.schema.fields if f.name.startswith("_k")] + [joined.schema["n_words"], joined.schema["runs"]]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", collapsed string"
    return joined.mapInArrow(_collapsed([f.name for f in kept], texts), fields).toDF(*keep, "n_words", "runs", "collapsed")


# ---- answers

def longest_run(runs: Column) -> Column:
    """The longest run, of equal ones that with the smallest start and then period; null without runs."""
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("_less"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(order)


def runs_text(runs: Column) -> Column:
    """`start,length,period` and a line feed for each run."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return F.array_join(lines, "")
