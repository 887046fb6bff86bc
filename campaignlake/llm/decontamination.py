"""Benchmark decontamination with training suffix arrays.

Each run of training texts is a shard with its own suffix array over words. Every suffix of a test item is
binary-searched in every shard's array, suffixes that begin with the same window together, and the rows that begin
with the window give its locations. Different windows of one length have different rows, so the locations of a
shard are at most its rows for each length of window, however many items and documents share a window; items are
looked up by window afterwards, for one document at a time. The
test suffixes are sorted in with the shard's: of every training suffix, the test suffixes next to it give the
longest verbatim match, whatever copies and other texts the shard holds. Training words that no test item has,
and pairs of words that none has in a row, can't lie in a match, so an array holds only the runs between them:
same answers as the full array, at a fraction of its size.

Test items come to the tasks in blocks of bounded size (BLOCK_WORDS words each); a larger benchmark means
more blocks, each a broadcast of the same size. A task holds one block at a time and merges what they find by
document; the driver holds one block while it is made. Both need one item to fit (and with encrypted broadcasts,
which Spark reads at once, a task holds all blocks).

Defined cases: null and empty texts have no words and no hits; an item of fewer words than a window is one
window; repeated rows are handled one by one; equal items count by their item_id; items whose item_id is null
are no items to name, and with `unnamed` (as in the registered query and the pipeline) their windows hit words
all the same; an empty benchmark leaves every document clean; other input columns are untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlake.llm import textkit as tk

WINDOW = 10
BLOCK_WORDS = 500_000
FILTER_BITS = 20


class TestBlock:
    """Words of some test items: their hashes, the distinct windows, and the names of the items that have each."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int):
        data, offsets = tk.text_buffers(pa.array(texts, pa.string()))
        starts, ends, bounds = tk.word_edges(data, offsets, tk.ALNUM)
        counts = np.diff(bounds)
        self.window = window
        self.words = tk.word_hashes(data, starts, ends)
        self.item = np.repeat(np.arange(len(ids)), counts)
        self.left = bounds[1:][self.item] - np.arange(len(self.words))
        self.length = np.minimum(counts, window)[self.item]
        self.vocabulary, self.code = np.unique(self.words, return_inverse=True)
        self.code = self.code.astype(np.int32) + 1
        self.shortest = int(self.length.min()) if len(self.length) else 0
        # the items one after the other, each followed by a zero; and the pairs of words that follow each other
        self.place = np.arange(len(self.words)) + self.item
        self.line = np.zeros(len(self.words) + len(ids), np.int32)
        self.line[self.place] = self.code
        self.pairs = np.unique(self._pair(self.code[:-1], self.code[1:])[self.item[:-1] == self.item[1:]])
        # a word at which each distinct window begins, and for each the ranks of its items' names: `has[ends[w]:ends[w+1]]`
        full = np.flatnonzero(self.left >= self.length)
        _, begins, window_of = np.unique(self._window_ranks()[full], return_index=True, return_inverse=True)
        self.begins = full[begins]
        self.names = sorted({x for x in ids if x is not None})
        rank = {name: i for i, name in enumerate(self.names)}
        name_of = np.array([-1 if x is None else rank[x] for x in ids], np.int64)[self.item[full]]
        named = np.unique(np.stack([window_of, name_of])[:, name_of >= 0], axis=1)
        self.has, self.ends = named[1], np.searchsorted(named[0], np.arange(len(begins) + 1))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._cells(self.vocabulary)] = True

    def _window_ranks(self) -> np.ndarray:
        """A number for every word, equal where the windows that begin there are."""
        rank = self.length.astype(np.int64)
        for j in range(int(self.length.max(initial=0))):
            ahead = np.minimum(np.arange(len(rank)) + j, max(0, len(rank) - 1))
            step = np.where(j < np.minimum(self.length, self.left), self.code[ahead], 0)
            _, rank = np.unique(rank * (len(self.vocabulary) + 1) + step, return_inverse=True)
        return rank

    @staticmethod
    def _cells(words: np.ndarray) -> np.ndarray:
        return (words >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) << 32) | b

    def adjacent(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether an item has the words of codes `a` and `b` in a row."""
        pair = self._pair(a, b)
        at = np.searchsorted(self.pairs, pair)
        at[at == len(self.pairs)] = 0
        return self.pairs[at] == pair if len(self.pairs) else np.zeros(len(pair), bool)

    def codes(self, words: np.ndarray) -> np.ndarray:
        """1.. for words of the test vocabulary in its order, 0 for all others."""
        out = np.zeros(len(words), np.int32)
        maybe = np.flatnonzero(self.filter[self._cells(words)])
        at = np.searchsorted(self.vocabulary, words[maybe])
        at[at == len(self.vocabulary)] = 0
        same = self.vocabulary[at] == words[maybe]
        out[maybe[same]] = at[same] + 1
        return out


def suffix_array(codes: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """`starts` sorted by the first `depth` codes of the suffix at each, by prefix doubling."""
    rank = codes.astype(np.int64)
    width = 1
    while width < depth:
        shifted = np.zeros_like(rank)
        shifted[: max(0, len(rank) - width)] = rank[width:]
        _, rank = np.unique(rank * (int(shifted.max(initial=0)) + 1) + shifted, return_inverse=True)
        rank = rank.astype(np.int64)
        width *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


def _order(train: np.ndarray, at: np.ndarray, test: np.ndarray, query: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of suffixes: -1, 0 or 1 over the first `length` codes, and the codes that agree."""
    sign = np.zeros(len(at), np.int8)
    common = np.zeros(len(at), np.int32)
    open_ = np.arange(len(at))
    for j in range(int(length.max(initial=0))):
        open_ = open_[j < length[open_]]
        if not len(open_):
            break
        a, b = train[at[open_] + j], test[query[open_] + j]
        same = a == b
        sign[open_[~same]] = np.where(a[~same] < b[~same], -1, 1)
        common[open_[same]] += 1
        open_ = open_[same]
    return sign, common


def find_windows(codes: np.ndarray, arrays: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
    """(first, past) of every distinct window: its rows in the array."""
    test = np.append(block.code, np.zeros(block.window + 1, block.code.dtype))
    begins, length = block.begins, block.length[block.begins]
    ends = []
    for past in (False, True):
        lo, hi = np.zeros(len(begins), np.int64), np.full(len(begins), len(arrays), np.int64)
        while (todo := np.flatnonzero(lo < hi)).size:
            mid = (lo[todo] + hi[todo]) // 2
            sign, _ = _order(codes, arrays[mid], test, begins[todo], length[todo])
            right = sign <= 0 if past else sign < 0
            lo[todo[right]] = mid[right] + 1
            hi[todo[~right]] = mid[~right]
        ends.append(lo)
    return ends[0], ends[1]


def longest_matches(codes: np.ndarray, order: np.ndarray, base: int, block: TestBlock) -> np.ndarray:
    """Words that the training suffixes (places below `base` in `order`, all suffixes sorted) have in common with
    any test suffix: the ones next to it in the order agree the longest."""
    rows, line = np.arange(len(order)), order >= base
    train = np.flatnonzero(~line)
    before = np.maximum.accumulate(np.where(line, rows, -1))[train]
    after = np.minimum.accumulate(np.where(line, rows, len(rows))[::-1])[::-1][train]
    left = np.zeros(len(block.line), np.int64)
    left[block.place] = block.left
    longest = np.zeros(len(train), np.int64)
    for beside in (before, after):
        there = np.flatnonzero((beside >= 0) & (beside < len(rows)))
        test = order[beside[there]]
        _, common = _order(codes, order[train[there]], codes, test, left[test - base])
        longest[there] = np.maximum(longest[there], common)
    return longest


def shard_hits(data: np.ndarray, offsets: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of each text's first word, hit of each word, (text, window) pairs that occur, longest match of each text)."""
    starts, ends, bounds = tk.word_edges(data, offsets, tk.ALNUM)
    n_docs, n_words = len(bounds) - 1, len(starts)
    hit, longest, found = np.zeros(n_words, bool), np.zeros(n_docs, np.int64), np.zeros((2, 0), np.int64)
    if not n_words or not len(block.words):
        return bounds, hit, found, longest
    doc = np.repeat(np.arange(n_docs), np.diff(bounds))
    codes = block.codes(tk.word_hashes(data, starts, ends))
    np.maximum.at(longest, doc, codes > 0)
    # runs of words that follow each other in an item; those of one word matter to items of one word only
    joined = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0) & (doc[:-1] == doc[1:]))
    joined = joined[block.adjacent(codes[joined], codes[joined + 1])]
    follows = np.zeros(n_words + 1, bool)
    follows[joined + 1] = True
    alone = ~follows[:-1] & ~follows[1:]
    kept = np.flatnonzero((codes > 0) & ~(alone & (block.shortest > 1)))
    if not len(kept):
        return bounds, hit, found, longest
    # the runs alone, one after the other, each followed by a zero; then the test items
    run = np.cumsum(~follows[kept]) - 1
    place = np.arange(len(kept)) + run
    far = int(block.left.max())
    base = len(kept) + int(run[-1]) + 1
    dense = np.zeros(base + len(block.line) + far + 1, np.int32)
    dense[place] = codes[kept]
    dense[base : base + len(block.line)] = block.line
    word_of = np.zeros(base, np.int64)
    word_of[place] = kept
    order = suffix_array(dense, np.concatenate([place, base + block.place]), far)
    array = order[order < base]
    np.maximum.at(longest, doc[word_of[array]], longest_matches(dense, order, base, block))
    first, past = find_windows(dense, array, block)
    sizes = past - first
    which = np.repeat(np.arange(len(sizes)), sizes)
    at = word_of[array[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)]]
    marks = np.bincount(at, minlength=n_words + 1) - np.bincount(at + block.length[block.begins[which]], minlength=n_words + 1)
    hit = np.cumsum(marks[:-1]) > 0
    pairs = np.unique(doc[at] * max(1, len(sizes)) + which)
    found = np.stack([pairs // max(1, len(sizes)), pairs % max(1, len(sizes))])
    return bounds, hit, found, longest


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long"


def _release(shared) -> None:
    """Lets go of a broadcast's value in this worker; the next `value` reads it from its file again."""
    if getattr(shared, "_path", None) is not None:
        vars(shared).pop("_value", None)


class _Found:
    """What the blocks so far found in one slice of texts. Of a block it keeps the items of windows that occur."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets
        self.windows: list[tuple[np.ndarray, ...]] = []
        self.names: list[list[str]] = []
        self.bounds, self.hit, self.longest = None, False, np.zeros(len(offsets) - 1, np.int64)

    def search(self, block: TestBlock) -> None:
        self.bounds, own, pairs, far = shard_hits(self.data, self.offsets, block)
        self.hit, self.longest = self.hit | own, np.maximum(self.longest, far)
        if not pairs.shape[1]:
            return
        used, windows = np.unique(pairs[1], return_inverse=True)
        sizes = block.ends[used + 1] - block.ends[used]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        has = block.has[np.repeat(block.ends[used] - ends[:-1], sizes) + np.arange(ends[-1])]
        kept, has = np.unique(has, return_inverse=True)
        texts = np.searchsorted(pairs[0], np.arange(len(self.offsets)))
        self.windows.append((texts, windows, ends, has))
        self.names.append([block.names[i] for i in kept])

    def items(self, doc: int, seen: dict[tuple, tuple[int, str]]) -> tuple[int, str]:
        """Number and digest of the items found in a text; texts with the same windows have the same ones."""
        own = [windows[texts[doc] : texts[doc + 1]] for texts, windows, _, _ in self.windows]
        key = tuple(w.tobytes() for w in own)
        if key not in seen:
            lists = []
            for mine, (_, _, ends, has), names in zip(own, self.windows, self.names):
                if len(mine):
                    there = np.zeros(len(names), bool)
                    for w in mine:
                        there[has[ends[w] : ends[w + 1]]] = True
                    lists.append([names[i] for i in np.flatnonzero(there)])
            named = lists[0] if len(lists) == 1 else sorted(set().union(*lists))
            seen[key] = len(named), hashlib.sha256(",".join(named).encode()).hexdigest()
        return seen[key]


def _result(found: _Found) -> pa.RecordBatch:
    rows, bounds, hit, longest = found.rows, found.bounds, found.hit, found.longest
    upto = np.concatenate([[0], np.cumsum(hit)])
    n_hit = upto[bounds[1:]] - upto[bounds[:-1]]
    seen: dict[tuple, tuple[int, str]] = {}
    items = [found.items(doc, seen) for doc in range(len(bounds) - 1)]
    columns = [
        pa.array(np.diff(bounds).astype(np.int64)),
        pa.array(n_hit.astype(np.int64)),
        pa.array([n for n, _ in items], pa.int64()),
        pa.array([digest for _, digest in items], pa.string()),
        pa.array(n_hit > 0),
        pa.array(longest),
    ]
    return pa.RecordBatch.from_arrays([*rows.columns, *columns], [*rows.schema.names, *(x.split()[0] for x in RESULT.split(", "))])


def _scan(blocks: list, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.text_buffers(batch.column("_text"))
            slices = [
                _Found(batch.slice(i, j - i).select(keep), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for i, j in tk.slices(offsets)
            ]
            for shared in blocks:
                block = shared.value
                for found in slices:
                    found.search(block)
                if len(blocks) > 1:
                    del block
                    _release(shared)
            yield from map(_result, slices)

    return run


def test_blocks(benchmark: DataFrame, window: int = WINDOW, unnamed: bool = False) -> list:
    """Broadcasts of the items, BLOCK_WORDS words each; the driver reads them one after the other."""
    items = benchmark.where(F.lit(unnamed) | benchmark["item_id"].isNotNull()).select(
        benchmark["item_id"].cast("string"), benchmark["text"].cast("string")
    )
    context, out = benchmark.sparkSession.sparkContext, []
    ids, texts, held = [], [], 0
    for row in items.toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        held += len(row[1] or "") // 2
        if held >= BLOCK_WORDS:
            out.append(context.broadcast(TestBlock(ids, texts, window)))
            ids, texts, held = [], [], 0
    if ids or not out:
        out.append(context.broadcast(TestBlock(ids, texts, window)))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, unnamed: bool = False) -> DataFrame:
    """`keep` of each row of `docs` (column text), with its words, those hit, the items found and its longest match."""
    rows = docs.select(*keep, docs["text"].cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(_scan(test_blocks(benchmark, window, unnamed), keep), f"{fields}, {RESULT}")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` without the rows in which a window of the benchmark, items without id too, occurs; columns as they were."""
    spare = [f"_c{i}" for i in range(len(docs.columns))]
    text = docs.columns.index("text")
    plain = docs.toDF(*spare).withColumn("text", F.col(spare[text]))
    return contamination(plain, benchmark, spare, window, unnamed=True).where("not contaminated").select(*spare).toDF(*docs.columns)
