"""Packing token sequences by bin completion.

Documents become token pieces of at most CAPACITY tokens. How many bins they need depends on nothing but how
many pieces there are of each length, a table of at most CAPACITY rows whatever the corpus, so the search runs
on that table: take the largest remaining length, enumerate undominated fillings of the space beside it, and
repeat the chosen bin as often as the counts allow. Best-fit decreasing gives the first incumbent; a branch is
cut when the space it has wasted leaves no room to beat the incumbent. The plan (bins with multiplicities) is
then applied to all pieces at once: a piece's rank among those of its length decides its sequence and offset.
Ranks come from counts by chunk, so a length that a third of all pieces share is spread over all tasks.

Defined cases: null and empty texts are one piece with the end token; a document longer than a sequence is cut,
its first piece taking the remainder; repeated rows are packed one by one; an empty table gives no rows; other
input columns are not read.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from campaignlake.llm.common import staged

CAPACITY = 2048
CHUNK_PIECES = 20_000
#: Effort of the search: fillings tried at each bin, nodes in looking for one, and bins placed in all.
FILLINGS, FILLING_NODES, SEARCH_NODES = 3, 3000, 20_000

Bins = list[tuple[tuple[int, ...], int]]


# ---- tokens

#: Texts with a run of this many blanks go to the tokenizer itself: the regular expressions of tiktoken give up on
#: runs of about a million, and are compared with it up to 200,000.
BLANK_RUN = 10_000
_BLANKS = re.compile(r"\s{%d}" % BLANK_RUN)


@cache
def _encoding(vocabulary: str):
    """Byte-pair encoder of a `.tiktoken` rank file: the ids of the byte_bpe tokenizer, a few times faster."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [re.escape(x.content) for x in tokenizer.get_added_tokens_decoder().values()]
    return tokenizer, re.compile("|".join(added) or r"(?!)")


def _encoder(vocabulary: str):
    """Ids of a text. The tokenizer (the `.json` beside the rank file) takes the texts that hold one of its added
    tokens, which it finds inside texts, or a long run of blanks; the rank file gives the same ids for all others."""
    plain = _encoding(vocabulary).encode_ordinary
    beside = os.path.splitext(vocabulary)[0] + ".json"
    if not os.path.exists(beside):
        return plain
    tokenizer, added = _tokenizer(beside)

    def encode(text: str) -> list[int]:
        if added.search(text) or (len(text) >= BLANK_RUN and _BLANKS.search(text)):
            return tokenizer.encode(text, add_special_tokens=False).ids
        return plain(text)

    return encode


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def piece_starts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Where the pieces of n tokens start: whole pieces at the end, the remainder first."""
    return [0, *range(n % capacity or capacity, n, capacity)]


def _pieces(vocabulary: str | None, capacity: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary or default_vocabulary())
        for batch in batches:
            docs, rows, tokens = [], [], []
            for i, text in enumerate(batch.column("_text")):
                ids = np.array([*encode(text.as_py() or ""), 0], "<u4")
                starts = piece_starts(len(ids), capacity)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    docs.append(i)
                    rows.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                    tokens += [ids[a:b].astype(np.int32)] * with_ids
            numbers = np.array(rows, np.int64).reshape(-1, 4).T
            columns = [batch.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(numbers[0].astype(np.int32)), *map(pa.array, numbers[1:])]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(tokens, pa.list_(pa.int32()))] * with_ids, names)

    return run


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each row of `docs`, with the end token 0."""
    texts = docs.select(F.col("doc_id").cast("long"), docs["text"].cast("string").alias("_text"))
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return texts.mapInArrow(_pieces(vocabulary, capacity, with_ids), fields)


# ---- the plan

def best_fit(counts: dict[int, int], capacity: int) -> Bins:
    """Best-fit decreasing over lengths with counts: (lengths of a bin, number of such bins)."""
    open_: dict[int, Counter] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in open_ if r >= size and open_[r]), default=None)
            if room is None:
                room, bin_, bins = capacity, (), left
            else:
                bin_, bins = next(iter(open_[room].items()))
            copies = min(room // size, left)
            used = min(bins, left // copies)
            if room < capacity or bin_:
                open_[room][bin_] -= used
                open_[room] += Counter()
            open_.setdefault(room - copies * size, Counter())[bin_ + (size,) * copies] += used
            left -= used * copies
    return [(bin_, n) for group in open_.values() for bin_, n in group.items()]


def fillings(room: int, counts: dict[int, int], sizes: list[int], wanted: int = FILLINGS) -> list[tuple[int, ...]]:
    """Fillings of `room`, least waste first. Only undominated ones are made: lengths go in from large to small, and
    a branch ends when the waste it can still reach is no less than that of the ones found."""
    found: list[tuple[int, tuple[int, ...]]] = []
    nodes = 0

    def worst() -> int:
        return found[-1][0] if len(found) == wanted else room + 1

    def keep(waste: int, chosen: tuple[int, ...]) -> None:
        if waste < worst() and (waste, chosen) not in found:
            found.append((waste, chosen))
            found.sort(key=lambda f: (f[0], len(f[1])))
            del found[wanted:]

    def fill(space: int, upto: int, chosen: tuple[int, ...]) -> None:
        nonlocal nodes
        nodes += 1
        free = lambda s: counts[s] - chosen.count(s)
        at = min(bisect_right(sizes, space), upto)
        at = next((i for i in range(at, 0, -1) if free(sizes[i - 1]) > 0), 0)
        if not at:
            keep(space, chosen)
            return
        if sizes[at - 1] == space:
            keep(0, chosen + (space,))
            at -= 1
        for i in range(at, 0, -1):
            if nodes > FILLING_NODES or (found and len(found) == wanted and found[-1][0] == 0):
                return
            if free(sizes[i - 1]) > 0:
                fill(space - sizes[i - 1], i, chosen + (sizes[i - 1],))

    fill(room, len(sizes), ())
    return [chosen for _, chosen in found]


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY) -> Bins:
    """Bins for lengths with counts, as few as the search finds; never more than best fit makes.

    One table of what is left is changed on the way down and restored on the way back, so the memory is that of
    the table and one bin for each level.
    """
    best = best_fit(counts, capacity)
    made = sum(n for _, n in best)
    left = {s: n for s, n in counts.items() if n}
    rest = sum(s * n for s, n in left.items())
    least = -(-rest // capacity)
    bins: Bins = []
    levels = [iter(_completions(left, capacity))]
    number = nodes = 0
    while levels and made > least and nodes < SEARCH_NODES:
        chosen = next(levels[-1], None)
        if chosen is None:
            levels.pop()
        else:
            nodes += 1
            lengths, times = chosen
            bins.append(chosen)
            number, rest = number + times, rest - times * sum(lengths)
            for size in lengths:
                left[size] -= times
                if not left[size]:
                    del left[size]
            if not left and number < made:
                best, made = list(bins), number
            if left and number + -(-rest // capacity) < made:
                levels.append(iter(_completions(left, capacity)))
                continue
        if bins and (chosen is not None or levels):
            lengths, times = bins.pop()
            number, rest = number - times, rest + times * sum(lengths)
            for size in lengths:
                left[size] = left.get(size, 0) + times
    return best


def _completions(left: dict[int, int], capacity: int) -> Bins:
    """Bins around the largest length that is left, each as often as the counts allow."""
    if not left:
        return []
    largest = max(left)
    inner = {**left, largest: left[largest] - 1}
    found = fillings(capacity - largest, inner, sorted(s for s, c in inner.items() if c))
    full = [(largest, *chosen) for chosen in found]
    return [(lengths, min(left[s] // c for s, c in Counter(lengths).items())) for lengths in full]


# ---- placing

def plan_table(bins: Bins) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, copies in a bin, offset of the first copy), by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter = Counter()
    sequence = 0
    for lengths, times in bins:
        offset = 0
        for size, copies in sorted(Counter(lengths).items(), reverse=True):
            rows.setdefault(size, []).append((taken[size], sequence, copies, offset))
            taken[size] += times * copies
            offset += size * copies
        sequence += times
    return {size: np.array(x, np.int64) for size, x in rows.items()}


def _placed(plan, keep: list[str]):
    """Sequence and offset of pieces whose rank among those of their length is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, bounds) if len(order) else []:
                size = int(length[own[0]])
                rows = plan.value[size]
                first, seq, copies, at = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1].T
                sequence[own] = seq + (rank[own] - first) // copies
                offset[own] = at + (rank[own] - first) % copies * size
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (a column length of 1..capacity, among others) with sequence_id and offset."""
    pieces = staged(pieces.drop("sequence_id", "offset").withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = pieces.sparkSession.sparkContext.broadcast(plan_table(bin_completion(counts, capacity)))
    chunks = max(1, sum(counts.values()) // CHUNK_PIECES)
    dealt = pieces.withColumn("_chunk", F.pmod(F.xxhash64("_row"), F.lit(chunks)))
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        dealt.groupBy("length", "_chunk").count().select("length", "_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    )
    within = F.row_number().over(Window.partitionBy("length", "_chunk").orderBy("_row")) - 1
    ranked = dealt.withColumn("_within", within).join(bases, ["length", "_chunk"]).withColumn("_rank", F.col("_base") + F.col("_within"))
    kept = pieces.drop("_row").schema.fields
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_placed(plan, [f.name for f in kept]), fields)


def packed_sequences(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The training sequences themselves: sequence_id, its documents' ids in order, and its tokens."""
    placed = pack(token_pieces(docs, vocabulary, capacity, with_ids=True), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.col("p.doc_id").alias("doc_ids"), F.flatten("p.ids").alias("ids")
    )
