"""Spelling variants by pairs of trie nodes.

All words are put in a trie, and their reversals in another, and every node gets an integer: a node of the first
stands for a prefix, one of the second for a suffix. The pair dictionary then has two kinds of entry. A word with
its position i left out is the pair (prefix node of length i, suffix node after i); a whole word cut at i is the pair
(prefix node of length i, suffix node from i). Two words that differ by one replaced letter meet at the pair of the
skipped position; two that differ by an inserted or deleted letter meet where the skipped entry of the longer one
equals a cut of the shorter one. Nodes are numbered exactly, so the neighbours need no further check.

Numbering: words are range partitioned in code-point order and each range gives numbers to the prefixes that its
predecessor in the order does not have. A range's first word shares prefixes with the range before; those, and the
prefixes of a range's last word, are numbered by (range that has them first, length), which follows from the first
and last words of all ranges alone. Work and storage are linear in the letters, whatever the length of a word.

A pair holds at most one whole word and one word for each letter of the alphabet, so its group is bounded by the
alphabet and no pairs of words are made: a group is one array of word numbers. Words are numbered by falling count
and then by code points, hence the best neighbour is the smallest number.

Defined cases: null and empty texts have no words; a null doc_id reads as an empty one; repeated rows count as often
as they occur; a word without neighbours has n_near 0 and is its own root; an empty table gives no rows; other columns
of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlake.llm.common import staged

#: Words of a range that numbers its trie nodes in one task.
RANGE_WORDS = 50_000
#: Distinct words that a counting task holds before it hands its counts on.
HELD_WORDS = 200_000
#: UTF-8 of the runs [A-Za-zÀ-ÿ]+ once A-Z is lower case: U+00C0 to U+00FF are C3 80 to C3 BF.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


# ---- words of a corpus

def _slipped(run: bytes, h: int) -> bytes:
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _counts(least_letters: int, slips: int | None):
    def batch_of(held: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode() for w in held], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column("_name"), batch.column("_text"), strict=True):
                seed = zlib.crc32(name.as_py().encode() + b":")
                for word, n in Counter(_RUN.findall(text.as_buffer().to_pybytes().lower())).items():
                    if slips and len(word) >= least_letters:
                        h = zlib.crc32(word, seed)
                        if h % slips == 0:
                            word = _slipped(word, h)
                    if len(word) >= least_letters and (len(word) >= 2 * least_letters or len(word.decode()) >= least_letters):
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield batch_of(held)
                    held.clear()
        yield batch_of(held)

    return run


def counted_words(docs: DataFrame, least_letters: int = 7, least_count: int = 2, slips: int | None = None) -> DataFrame:
    """(word, n) of the runs of letters in all texts, A-Z as a-z, with enough letters and occurrences.

    With `slips`, runs whose crc32 of `<doc_id>:<run>` it divides lose one letter: planted misspellings."""
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_name"),
        F.coalesce(F.encode(docs["text"].cast("string"), "UTF-8"), F.lit(b"")).alias("_text"),
    )
    partial = texts.mapInArrow(_counts(least_letters, slips), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---- trie nodes

def _shared(a: str, b: str) -> int:
    return len(commonprefix([a, b]))


Owners = list[tuple[int, int]]


def _owner(owners: Owners, depth: int) -> int:
    """The range that has the prefix of this length of a range's last word first."""
    return next(part for upto, part in owners if depth <= upto)


def range_owners(bounds: list[tuple[int, str, str]]) -> dict[int, tuple[str, int, Owners, Owners]]:
    """By range: (last word, letters that its first word shares with the range before, owners of the prefixes of
    that range's last word, owners of those of its own last word). `bounds` are (range, first, last) in order."""
    out: dict[int, tuple[str, int, Owners, Owners]] = {}
    before, word = [], None
    for part, first, last in bounds:
        shared = -1 if word is None else _shared(word, first)
        inherited = min(shared, _shared(first, last))
        own: Owners = []
        for upto, owner in before:
            if inherited >= 0 and (not own or own[-1][0] < inherited):
                own.append((min(upto, inherited), owner))
        if inherited < len(last):
            own.append((len(last), part))
        out[part] = last, shared, before, own
        before, word = own, last
    return out


def number_nodes(words: list[str], part: int, bounds: tuple[str, int, Owners, Owners]) -> Iterator[list[int]]:
    """For each of a range's sorted words, the nodes of its prefixes of length 0, 1, ..."""
    last, shared, before, own = bounds
    base, counter = part << 40, len(last)
    previous, nodes = "", []
    for word in words:
        common = _shared(previous, word) if nodes else -1
        on_last = _shared(word, last)
        nodes = nodes[: common + 1]
        for depth in range(common + 1, len(word) + 1):
            if depth <= on_last:
                nodes.append(_owner(own, depth) << 40 | depth)
            elif common < 0 and depth <= shared:
                nodes.append(_owner(before, depth) << 40 | depth)
            else:
                counter += 1
                nodes.append(base | counter)
        previous = word
        yield nodes


def _numbered(owners):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("_part")[0].as_py()
        table = table.sort_by("_path")
        words = table.column("_path").to_pylist()
        ids = table.column("_word").to_pylist()
        nodes = pa.array(number_nodes(words, part, owners.value[part]), pa.list_(pa.int64()))
        fresh = pa.array([[i == 0 or w[i] != w[i - 1] for i in range(len(w))] for w in words], pa.list_(pa.bool_()))
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), nodes, fresh], ["_word", "nodes", "fresh"])

    return run


def trie_nodes(words: DataFrame, path, ranges: int) -> DataFrame:
    """(_word, nodes, fresh): the numbers of a word's nodes along `path` (the word, or its reversal), and for each
    letter of the path whether it differs from the one before. Only the ranges' first and last words reach the driver."""
    ordered = words.select("_word", path.alias("_path")).repartitionByRange(ranges, "_path").withColumn("_part", F.spark_partition_id())
    ordered = staged(ordered, "trie-ranges")
    ends = ordered.groupBy("_part").agg(F.min("_path").alias("first"), F.max("_path").alias("last")).orderBy("_part").collect()
    owners = words.sparkSession.sparkContext.broadcast(range_owners([tuple(r) for r in ends]))
    return ordered.groupBy("_part").applyInArrow(_numbered(owners), "_word long, nodes array<long>, fresh array<boolean>")


# ---- the pair dictionary

def pair_entries(words: DataFrame, ranges: int) -> DataFrame:
    """(prefix, suffix, entry): every word skipped at each position and cut at each position. An entry is
    4 * word + 2 if the word is cut, + 1 if the skipped letter begins a run of equal letters; of such a run only that
    letter counts as deleted, so that a shorter word is met once."""
    heads = trie_nodes(words, F.col("word"), ranges).withColumnRenamed("nodes", "heads")
    tails = trie_nodes(words, F.reverse("word"), ranges).select("_word", F.col("nodes").alias("tails"))
    both = heads.join(tails, "_word").select("_word", F.col("fresh").alias("fresh"), "heads", F.reverse("tails").alias("tails"))
    # tails[i] is now the suffix node from position i.
    at = both.select("_word", F.posexplode(F.arrays_zip("heads", "tails", F.slice("tails", 2, F.size("tails")).alias("after"), "fresh")))
    entry = lambda bits: F.col("_word") * 4 + bits
    cut = F.struct(F.col("col.tails").alias("suffix"), entry(F.lit(2)).alias("entry"))
    skipped = F.struct(F.col("col.after").alias("suffix"), entry(F.col("col.fresh").cast("long")).alias("entry"))
    kinds = F.when(F.col("col.after").isNull(), F.array(cut)).otherwise(F.array(cut, skipped))
    return at.select(F.col("col.heads").alias("prefix"), F.inline(kinds))


def neighbours(words: DataFrame, ranges: int) -> DataFrame:
    """(_word, n_near, _best): number of neighbours and the smallest numbered one, of words that have any."""
    groups = (
        pair_entries(words, ranges)
        .groupBy("prefix", "suffix")
        .agg(F.sort_array(F.collect_list("entry")).alias("all"))
        .where(F.size("all") > 1)
        .select(
            F.filter("all", lambda e: e.bitwiseAND(F.lit(2)) == 0).alias("skipped"),
            F.filter("all", lambda e: e.bitwiseAND(F.lit(3)) == 1).alias("fresh"),
            F.expr("try_element_at(filter(all, e -> (e & 2) <> 0), 1)").alias("cut"),
        )
    )
    # try_element_at: null where a group lacks that entry.
    first, second = F.try_element_at("skipped", F.lit(1)), F.try_element_at("skipped", F.lit(2))
    of_skipped = F.transform(
        "skipped",
        lambda e: F.struct(
            e.alias("entry"),
            (F.size("skipped") - 1 + F.when(F.col("cut").isNotNull() & (e.bitwiseAND(F.lit(1)) == 1), 1).otherwise(0)).alias("near"),
            F.least(F.when(e == first, second).otherwise(first), F.when(e.bitwiseAND(F.lit(1)) == 1, F.col("cut"))).alias("best"),
        ),
    )
    of_cut = F.struct(F.col("cut").alias("entry"), F.size("fresh").alias("near"), F.try_element_at("fresh", F.lit(1)).alias("best"))
    members = F.when(F.col("cut").isNull() | (F.size("fresh") == 0), of_skipped).otherwise(F.concat(of_skipped, F.array(of_cut)))
    found = groups.select(F.inline(members)).where("near > 0")
    word = lambda c: F.shiftrightunsigned(c, 2)
    return found.groupBy(word("entry").alias("_word")).agg(F.sum("near").alias("n_near"), F.min(word("best")).alias("_best"))


def variant_groups(words: DataFrame, dominance: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of `words` (word, n; words distinct).

    The form is the most frequent neighbour, if it occurs `dominance` times as often; counts grow by that factor along
    a chain of forms, so roots are found by doubling in few rounds."""
    ranked = staged(words.select("word", "n").orderBy(F.desc("n"), "word").withColumn("_word", F.monotonically_increasing_id()), "words")
    ranges = max(1, -(-ranked.count() // RANGE_WORDS))
    near = neighbours(ranked, ranges)
    forms = ranked.select(F.col("_word").alias("_best"), F.col("n").alias("form_n"), F.col("word").alias("form"))
    judged = ranked.join(near, "_word", "left").join(forms, "_best", "left")
    better = F.coalesce(F.col("form_n") >= F.col("n") * dominance, F.lit(False))
    judged = staged(
        judged.select(
            "_word", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            *[F.when(better, F.col(c)).alias(c) for c in ("form", "form_n")], F.when(better, F.col("_best")).alias("_root"),
        ),
        "variants",
    )
    roots = judged.where("_root is not null").select("_word", "_root")
    while True:
        onward = roots.select(F.col("_word").alias("_root"), F.col("_root").alias("_next"))
        moved = staged(roots.join(onward, "_root", "left").select("_word", F.coalesce("_next", "_root").alias("_root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        roots = moved.select("_word", "_root")
        if moved.where("_moved").limit(1).count() == 0:
            break
    names = ranked.select(F.col("_word").alias("_root"), F.col("word").alias("root"))
    return judged.drop("_root").join(roots.join(names, "_root").drop("_root"), "_word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
