"""Similarity join on word n-gram sets at a Jaccard threshold: size-aware, heavy and light sets apart.

Two sets of sizes a and b reach the threshold when they share c(a, b) shingles.

* Light sets (size up to a boundary) enumerate, for each partner size, all their subsets of c(a, b) elements.
  Sets that meet on such a subset are linked without further checks.
* Heavy sets scan inverted lists. Each shingle's list gives its document frequency. Shingles of one set only
  can't be shared, so a set of n shingles whose shared ones are fewer than the smallest overlap it needs is
  done. The others keep a prefix: under the order (frequency, hash) two linked sets share one of their first
  n - ceil(t n) + 1 shingles. The lists are scanned in two rounds: every member is first compared with the
  list's most central set, and only members that are still in different components meet afterwards, under
  length and position filters. Comparisons are exact counts over the shared shingles.
* The boundary is where the number of subsets to enumerate passes the number of list entries it saves, from
  the counts of distinct sets by size.

Equal sets are one node throughout, so copies cost nothing beyond their own row. Shingles move as packed
arrays by hash range; a range is sized by the number of shingles, so it fits in a task's memory at any scale.
Shingle hashes have 48 bits within a document, and 40 besides the range's (48 at most) across documents: two
different shingles of one pair are taken for one with a chance below 1e-6 for sets of thousands.

Defined cases: null, empty and blank texts have no shingles and are their own component; repeated rows and
equal texts share a component; doc_id null is ignored as a component's name unless all its ids are null;
other columns of the input are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlake.llm import textkit as tk
from campaignlake.llm.common import staged
from campaignlake.llm.graph import components

RANGE_SHINGLES = 2_000_000
FLUSH_SHINGLES = 1_000_000
LIGHT_LIMIT = 24
#: Cost of one enumerated subset (a row) against one list entry (a few bytes of an array).
SUBSET_COST = 4.0

_SIGN = np.uint64(0x8CB92BA72F3D8DD7)


def overlap_needed(a: int, b: int, percent: int) -> int:
    return -(-percent * (a + b) // (100 + percent))


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def partner_sizes(n: int, percent: int) -> list[tuple[int, int]]:
    """(a, b) for each pair of sizes a <= b that can link and of which n is one."""
    up = [(n, b) for b in range(n, n * 100 // percent + 1)]
    down = [(a, n) for a in range(least_overlap(n, percent), n)]
    return [(a, b) for a, b in up + down if overlap_needed(a, b, percent) <= a]


def subset_count(n: int, percent: int) -> int:
    return sum(comb(n, overlap_needed(a, b, percent)) for a, b in partner_sizes(n, percent))


def light_boundary(by_size: dict[int, int], percent: int) -> int:
    """Largest size whose sets enumerate subsets, by the cost of both ways over sets of up to LIGHT_LIMIT shingles."""

    def cost(x: int) -> float:
        light = sum(SUBSET_COST * subset_count(n, percent) * c for n, c in by_size.items() if n <= x)
        return light + sum(n * c for n, c in by_size.items() if n >= least_overlap(x + 1, percent))

    return min(range(LIGHT_LIMIT + 1), key=cost)


def _signatures(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """63-bit identity of each set: a sum of mixed element hashes, mixed with the size."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mixed(hashes ^ _SIGN), dtype=np.uint64)])
    total = sums[edges[1:]] - sums[edges[:-1]]
    return (tk.mixed(total + np.diff(edges).astype(np.uint64) * _SIGN) >> np.uint64(1)).astype(np.int64)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = tk.text_buffers(batch.column("_text"))
    for i, j in tk.slices(offsets):
        hashes, edges = tk.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tk.SPACED, k)
        yield i, j, hashes, edges, _signatures(hashes, edges)


def _measure(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, edges, sigs in _sets(batch, k):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], pa.array(np.diff(edges).astype(np.int32)), pa.array(sigs)],
                    ["doc_id", "n", "sig"],
                )

    return run


def _subsets(k: int, percent: int, boundary: int):
    """Light sets: (key, sig, n, a) for each subset of the size that a pair of sizes (a, b) has to share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = {
            n: [(a, b, overlap_needed(a, b, percent)) for a, b in partner_sizes(n, percent)]
            for n in range(1, boundary + 1)
        }
        for batch in batches:
            for _, _, hashes, edges, sigs in _sets(batch, k):
                keys, owners, sizes, smaller = [], [], [], []
                n_of = np.diff(edges)
                small = np.flatnonzero((n_of > 0) & (n_of <= boundary))
                _, at = np.unique(sigs[small], return_index=True)
                for d in small[at]:
                    marks = [int(x) for x in tk.mixed(hashes[edges[d] : edges[d + 1]] ^ _SIGN)]
                    n, total = len(marks), sum(marks)
                    for a, b, c in plans[n]:
                        for out in combinations(marks, n - c):
                            keys.append((total - sum(out) + (a << 40) + (b << 20)) & 0x7FFFFFFFFFFFFFFF)
                            owners.append(int(sigs[d]))
                            sizes.append(n)
                            smaller.append(a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(owners, pa.int64()), pa.array(sizes, pa.int32()), pa.array(smaller, pa.int32())],
                    ["key", "sig", "n", "a"],
                )

    return run


def _runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(group)))


def _low_bits(bits: int) -> int:
    """Bits of a shingle's hash below those of its range; five bytes hold them."""
    return min(40, 48 - bits)


def _requests(k: int, bits: int, smallest: int):
    """Packed entries by hash range: which sets, of which sizes, hold which shingles of the range."""
    below = _low_bits(bits)
    unused = np.uint64(48 - bits - below)

    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        h, sig, n = (np.concatenate([p[x] for p in parts]) for x in range(3))
        low = h & np.uint64((1 << below) - 1)
        ranges = (h >> np.uint64(below)).astype(np.int64)
        order = np.argsort(ranges, kind="stable")
        ranges, low, sig, n = ranges[order], low[order], sig[order], n[order]
        out = []
        for s, c in zip(*_runs(ranges), strict=True):
            own = slice(s, s + c)
            starts, counts = _runs(sig[own])
            out.append(
                (int(ranges[s]), sig[own][starts].tobytes(), n[own][starts].tobytes(), counts.astype(np.int32).tobytes(), tk.packed(low[own], 5))
            )
        names = ["range", "sigs", "sizes", "counts", "low"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], pa.schema([("range", pa.int32())] + [(x, pa.binary()) for x in names[1:]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for _, _, hashes, edges, sigs in _sets(batch, k):
                n_of = np.diff(edges)
                _, first = np.unique(sigs, return_index=True)
                wanted = np.zeros(len(sigs), bool)
                wanted[first] = True
                wanted &= n_of >= smallest
                entry = np.repeat(wanted, n_of)
                h = hashes[entry] >> unused
                sizes = n_of[wanted]
                parts.append((h, np.repeat(sigs[wanted], sizes), np.repeat(sizes.astype(np.int32), sizes)))
                held += len(h)
                if held >= FLUSH_SHINGLES:
                    yield from flush(parts)
                    parts, held = [], 0
        if held:
            yield from flush(parts)

    return run


REPLY = "part int, sigs binary, sizes binary, counts binary, hashes binary, order binary"


def _entries(group: pa.Table, columns: list[tuple[str, str]]) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group.column(name)]) for name, kind in columns]


def _frequencies(parts: int, bits: int):
    """One range's lists: entries of shingles that two or more different sets hold, sent back by set."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        schema = pa.schema([("part", pa.int32())] + [(x, pa.binary()) for x in ("sigs", "sizes", "counts", "hashes", "order")])
        sigs, sizes, counts = _entries(group, [("sigs", "<i8"), ("sizes", "<i4"), ("counts", "<i4")])
        low = np.concatenate([tk.unpacked(x.as_py(), 5) for x in group.column("low")])
        owner = np.repeat(np.arange(len(sigs), dtype=np.int32), counts)
        order = np.argsort(low)
        low, owner = low[order], owner[order]
        starts, lengths = _runs(low)
        shared = np.repeat(lengths > 1, lengths)
        low, owner = low[shared], owner[shared]
        order = np.lexsort((sigs[owner], low))
        low, owner = low[order], owner[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (sigs[owner[1:]] != sigs[owner[:-1]])
        low, owner = low[new], owner[new]
        starts, lengths = _runs(low)
        frequency = np.repeat(lengths, lengths)
        keep = frequency > 1
        low, owner, frequency = low[keep], owner[keep], frequency[keep]
        rank = np.minimum(255, 6 * np.log2(np.maximum(frequency, 1))).astype(np.uint8)
        full = low | np.uint64(int(key[0].as_py()) << _low_bits(bits))
        sig = sigs[owner]
        part = (sig % parts).astype(np.int32)
        order = np.lexsort((sig, part))
        part, sig, full, rank, size = part[order], sig[order], full[order], rank[order], sizes[owner[order]]
        rows = []
        for s, c in zip(*_runs(part), strict=True):
            own = slice(s, s + c)
            starts, lengths = _runs(sig[own])
            rows.append(
                dict(
                    part=int(part[s]), sigs=sig[own][starts].tobytes(), sizes=size[own][starts].tobytes(),
                    counts=lengths.astype(np.int32).tobytes(), hashes=tk.packed(full[own], 6), order=rank[own].tobytes(),
                )
            )
        return pa.Table.from_pylist(rows, schema)

    return run


SURVIVOR = "sig long, n int, m int, shared binary, prefix array<long>"


def _prefixes(percent: int):
    """Sets that hold enough shared shingles for a link: all of them for the comparison, and their prefix."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        schema = pa.schema([("sig", pa.int64()), ("n", pa.int32()), ("m", pa.int32()), ("shared", pa.binary()), ("prefix", pa.list_(pa.int64()))])
        sigs, sizes, counts, rank = _entries(group, [("sigs", "<i8"), ("sizes", "<i4"), ("counts", "<i4"), ("order", "u1")])
        hashes = np.concatenate([tk.unpacked(x.as_py(), 6) for x in group.column("hashes")]).astype(np.int64)
        owner = np.repeat(np.arange(len(sigs)), counts)
        order = np.lexsort((hashes, rank, sigs[owner]))
        sig, n, h = sigs[owner[order]], sizes[owner[order]], hashes[order]
        rows = []
        for s, m in zip(*_runs(sig), strict=True):
            size = int(n[s])
            least = least_overlap(size, percent)
            if m >= least:
                own = h[s : s + m]
                alone = size - m
                rows.append(
                    dict(sig=int(sig[s]), n=size, m=int(m), shared=tk.packed(np.sort(own).astype(np.uint64), 6), prefix=own[: size - least + 1 - alone])
                )
        return pa.Table.from_pylist(rows, schema)

    return run


def _checked(percent: int):
    """Pairs whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            a, b = batch.column("a_shared"), batch.column("b_shared")
            for i, (p, q) in enumerate(zip(batch.column("a_n").to_pylist(), batch.column("b_n").to_pylist(), strict=True)):
                x, y = tk.unpacked(a[i].as_py(), 6), tk.unpacked(b[i].as_py(), 6)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                good[i] = int((y[at] == x).sum()) >= overlap_needed(p, q, percent)
            yield batch.select(["u", "v"]).filter(pa.array(good))

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that link, by exact comparison."""
    a = sets.select(F.col("sig").alias("u"), F.col("n").alias("a_n"), F.col("shared").alias("a_shared"))
    b = sets.select(F.col("sig").alias("v"), F.col("n").alias("b_n"), F.col("shared").alias("b_shared"))
    both = pairs.join(a, "u").join(b, "v")
    return staged(both.mapInArrow(_checked(percent), "u long, v long"), "links")


def _possible(percent: int, boundary: int, p: str, q: str) -> str:
    """Filter on two list members: at least one is heavy, and sizes, shared shingles and positions leave room for a link."""
    needed = f"(({percent} * ({p}.n + {q}.n) + {99 + percent}) div {100 + percent})"
    return (
        f"{p}.sig <> {q}.sig and greatest({p}.n, {q}.n) > {boundary} and {needed} <= least({p}.m, {q}.m)"
        f" and {needed} <= least({p}.n - {p}.at, {q}.n - {q}.at)"
    )


def _star_pairs(tokens: DataFrame, percent: int, boundary: int) -> DataFrame:
    """Each list's members with its most central one, the set with the fewest shingles of its own."""
    centre = tokens.groupBy("h").agg(
        F.min(F.struct((F.col("n") - F.col("m")).alias("own"), "sig", "n", "m", "at")).alias("c"), F.count(F.lit(1)).alias("listed")
    )
    # Staged, so that the join has a plain exchange on either side and Spark can split the list of a hot shingle.
    c = staged(centre.where("listed > 1").select("h", "c.*"), "centres").alias("q")
    met = tokens.alias("p").join(c, "h").where(_possible(percent, boundary, "p", "q"))
    return met.select(F.expr("least(p.sig, q.sig)").alias("u"), F.expr("greatest(p.sig, q.sig)").alias("v")).distinct()


def _open_pairs(tokens: DataFrame, roots: DataFrame, percent: int, boundary: int) -> DataFrame:
    """Members of one list that are in different components: those outside its largest one, with all others."""
    placed = tokens.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    by_root = placed.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c"))
    lists = by_root.groupBy("h").agg(F.max(F.struct("c", "root")).getField("root").alias("main"), F.count(F.lit(1)).alias("parts"))
    live = staged(placed.join(lists.where("parts > 1").drop("parts"), "h"), "open-lists")
    p, q = live.where("root <> main").alias("p"), live.alias("q")
    apart = "p.root <> q.root and (q.root = q.main or p.sig < q.sig)"
    met = p.join(q, (F.col("p.h") == F.col("q.h")) & F.expr(apart) & F.expr(_possible(percent, boundary, "p", "q")))
    return met.select(F.expr("least(p.sig, q.sig)").alias("u"), F.expr("greatest(p.sig, q.sig)").alias("v")).distinct()


def ngram_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of `docs` (columns doc_id, text)."""
    texts = docs.select("doc_id", docs["text"].cast("string").alias("_text"))
    measured = staged(texts.mapInArrow(_measure(words), "doc_id long, n int, sig long"), "sets")
    nodes = measured.where("n > 0").select("sig", "n").distinct()
    sizes = nodes.groupBy(F.least("n", F.lit(LIGHT_LIMIT + 1)).alias("n")).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    by_size = {r["n"]: (r["c"], r["s"]) for r in sizes.collect()}
    boundary = light_boundary({n: c for n, (c, _) in by_size.items() if n <= LIGHT_LIMIT}, percent)
    shingles = sum(s for _, s in by_size.values())
    bits = min(30, (shingles // RANGE_SHINGLES).bit_length())
    parts = max(1, shingles // RANGE_SHINGLES * 2)

    subsets = staged(texts.mapInArrow(_subsets(words, percent, boundary), "key long, sig long, n int, a int"), "subsets")
    centres = subsets.groupBy("key").agg(F.min(F.struct("n", "sig")).alias("c"), F.count(F.lit(1)).alias("listed"))
    light = subsets.join(staged(centres.where("listed > 1"), "light-centres"), "key").where("c.n = a and c.sig <> sig")
    light_edges = light.select(F.col("c.sig").alias("u"), F.col("sig").alias("v")).distinct()

    requests = texts.mapInArrow(
        _requests(words, bits, least_overlap(boundary + 1, percent)), "range int, sigs binary, sizes binary, counts binary, low binary"
    )
    replies = requests.groupBy("range").applyInArrow(_frequencies(parts, bits), REPLY)
    sets = staged(replies.groupBy("part").applyInArrow(_prefixes(percent), SURVIVOR), "candidates")
    tokens = sets.select("sig", "n", "m", F.posexplode("prefix").alias("i", "h")).select(
        "h", "sig", "n", "m", (F.col("n") - F.col("m") + F.col("i")).alias("at")
    )
    stars = _links(_star_pairs(tokens, percent, boundary), sets, percent)
    rest = _links(_open_pairs(tokens, components(stars), percent, boundary), sets, percent)
    roots = components(stars.unionByName(rest).unionByName(light_edges))

    filled = measured.where("n > 0").join(roots.withColumnRenamed("node", "sig"), "sig", "left")
    filled = filled.select("doc_id", "n", F.coalesce("root", "sig").alias("root"))
    names = filled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = filled.join(names, "root").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = measured.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)
