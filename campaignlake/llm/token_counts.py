"""Token counts of every prefix of a text, by prefix dynamic programming.

Byte-pair encoding has one property that the table below rests on: a sequence of tokens is the encoding of its
bytes exactly if every two adjacent tokens are the encoding of theirs. So the encoding of a prefix of a piece is
that of a shorter prefix and one more token; only one token fits, and count[p] = count[p - its length] + 1. The tokens
that end at a place come from an automaton over the vocabulary, and whether two tokens may stand side by side is asked
of the library once for each pair.

A text is first split into pieces, and here a prefix may be split otherwise than the whole text: a run of white
space is one piece at a prefix's end but gives its last character away before a word, `'re` is one piece but `'r` two,
and the beginning of an added token is ordinary text. The table holds the counts of the prefixes as texts of their own.

`counts[c]` is the number of tokens of the first c code points. It is stored as an array, so truncations, budgets and
totals are lookups in Spark without the tokenizer. Counts can fall by a longer prefix, so `longest_prefix` looks at all.

Defined cases: null and empty texts have counts [0]; repeated rows are counted one by one; an empty table gives no rows;
only the columns in `keep` and the text are read, and no other column name clashes.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of an output batch, about.
BATCH_CHARS = 1 << 20
#: Distinct pieces (about 230 bytes each) and pairs of tokens that a Python worker remembers; longer pieces are not kept.
KEPT_PIECES, KEPT_PAIRS, KEPT_LETTERS = 700_000, 1_000_000, 64

# The split of the byte-level vocabularies, and its contractions of three characters.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("'re", "'ve", "'ll")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def byte_letters() -> dict[int, str]:
    """The letter for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others for the
    code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class PrefixCounter:
    """Counts of all prefixes of texts for a byte-level BPE vocabulary in `tokenizers` format."""

    def __init__(self, vocabulary: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.added = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()}, key=len, reverse=True)
        self.find_added = regex.compile("|".join(map(regex.escape, self.added)) or r"(?!)")
        self.split = regex.compile(SPLIT)
        self.blanks = regex.compile(r"\s{2,}")
        # Where the two regular expression engines can't differ in their Unicode tables.
        self.common = regex.compile(r"[\x00-ɏ‐-‧]*")
        self.letters = {b: letter for b, letter in byte_letters().items() if chr(b) != letter}
        self.automaton = ahocorasick.Automaton()
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            # A token that its own text is not encoded as never occurs.
            if [t.id for t in self.model.tokenize(token)] == [number]:
                self.automaton.add_word(token, (len(token), token))
        self.automaton.make_automaton()
        self.space = byte_letters()[0x20]
        self.followers: dict[str, dict[str, bool]] = {}
        self.asked = 0
        self.pieces: dict[str, bytes] = {}

    def adjacent(self, one: str, other: str) -> bool:
        """Whether two tokens are the encoding of their joint text; the answer is remembered with the first one."""
        if self.asked >= KEPT_PAIRS:
            self.followers, self.asked = {}, 0
        self.asked += 1
        fits = [t.value for t in self.model.tokenize(one + other)] == [one, other]
        self.followers.setdefault(one, {})[other] = fits
        return fits

    def letter_counts(self, letters: str) -> list[int]:
        """Tokens of every prefix of a piece, by bytes, from the first byte on."""
        size = len(letters)
        last, counts, follows = [""] * size, [0] * size, [{}] * size
        for end, (length, token) in self.automaton.iter(letters):
            if counts[end]:
                continue
            start = end - length
            if start < 0:
                counts[end] = 1
            else:
                fits = follows[start].get(token)
                if not (self.adjacent(last[start], token) if fits is None else fits):
                    continue
                counts[end] = counts[start] + 1
            last[end], follows[end] = token, self.followers.setdefault(token, {})
        if 0 in counts:
            raise ValueError("the vocabulary lacks a byte")
        return counts

    def piece(self, piece: str) -> bytes:
        """Counts after each code point of a piece, as int32."""
        known = self.pieces.get(piece)
        if known is None:
            if piece.isascii():
                counts = self.letter_counts(piece.replace(" ", self.space) if piece.isprintable() else piece.translate(self.letters))
            else:
                raw = piece.encode()
                counts = self.letter_counts(raw.decode("latin-1").translate(self.letters))
                # A code point ends where the next byte does not continue it.
                counts = [n for n, after in zip(counts, raw[1:] + b"a", strict=True) if after & 0xC0 != 0x80]
            if piece in CONTRACTIONS:
                counts[:2] = 1, 2
            known = array("i", counts).tobytes()
            if len(piece) <= KEPT_LETTERS:
                if len(self.pieces) >= KEPT_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = known
        return known

    def pieces_of(self, text: str) -> list[str]:
        if text.isascii() or self.common.fullmatch(text):
            return self.split.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def plain_counts(self, text: str) -> np.ndarray:
        """Counts after each code point of a text without added tokens."""
        pieces = self.pieces_of(text)
        if not pieces:
            return np.zeros(0, np.int32)
        found = list(map(self.pieces.get, pieces))
        if None in found:
            found = [own or self.piece(piece) for own, piece in zip(found, pieces, strict=True)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        counts = np.frombuffer(b"".join(found), np.int32)
        totals = counts[np.cumsum(sizes) - 1]
        counts = counts + np.repeat(np.cumsum(totals, dtype=np.int32) - totals, sizes)
        for run in self.blanks.finditer(text):
            # At a prefix's end a run of white space is one piece; before a word its last character is not part of it.
            a, b = run.span()
            counts[b - 1] = (counts[a - 1] if a else 0) + np.frombuffer(self.piece(run[0]), np.int32)[-1]
        return counts

    def counts(self, text: str) -> np.ndarray:
        """Counts of all prefixes, from the empty one to the text itself."""
        out, total, at = [np.zeros(1, np.int32)], 0, 0
        for found in self.find_added.finditer(text):
            a, b = found.span()
            # The token's beginning is ordinary text as long as its end is missing.
            own = self.plain_counts(text[at : b - 1])
            whole = total + (int(own[a - at - 1]) if a > at else 0) + 1
            out += [own + total, np.array([whole], np.int32)]
            total, at = whole, b
        out.append(self.plain_counts(text[at:]) + total)
        return np.concatenate(out).astype(np.int32)


@cache
def prefix_counter(vocabulary: str) -> PrefixCounter:
    return PrefixCounter(vocabulary)


def _counted(vocabulary: str | None, keep: list[str]):
    def flushed(batch: pa.RecordBatch, rows: list[int], sizes: list[int], counts: list[np.ndarray]) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(c) for c in counts])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*counts, np.zeros(0, np.int32)])))
        kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in keep]
        return pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), lists], [*keep, "n_bytes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(vocabulary or default_vocabulary())
        for batch in batches:
            rows, sizes, counts, held = [], [], [], 0
            for i, text in enumerate(batch.column("_text")):
                one = text.as_py() or ""
                rows.append(i)
                sizes.append(len(one.encode()))
                counts.append(counter.counts(one))
                held += len(counts[-1])
                if held >= BATCH_CHARS:
                    yield flushed(batch, rows, sizes, counts)
                    rows, sizes, counts, held = [], [], [], 0
            yield flushed(batch, rows, sizes, counts)

    return run


def prefix_counts(docs: DataFrame, keep: list[str], vocabulary: str | None = None) -> DataFrame:
    """(*keep, n_bytes, counts): counts[c] is the number of tokens of the first c code points of the text."""
    spare = [f"_k{i}" for i in range(len(keep))]
    texts = docs.select(*[docs[c].alias(s) for c, s in zip(keep, spare, strict=True)], docs["text"].cast("string").alias("_text"))
    kept = [f"`{s}` {docs.schema[c].dataType.simpleString()}" for c, s in zip(keep, spare, strict=True)]
    fields = ", ".join([*kept, "n_bytes long", "counts array<int>"])
    return texts.mapInArrow(_counted(vocabulary, spare), fields).toDF(*keep, "n_bytes", "counts")


# ---- answers from the stored table

def tokens_of_prefix(counts: Column, chars: Column) -> Column:
    """Tokens of the first `chars` code points; null beyond the text."""
    return F.get(counts, chars)


def longest_prefix(counts: Column, budget: int) -> Column:
    """The most code points whose encoding has at most `budget` tokens; null for a budget below 0."""
    return F.array_max(F.transform(counts, lambda n, chars: F.when(n <= budget, chars)))


def truncated(texts: Column, counts: Column, budget: int) -> Column:
    """The longest beginning of a text that is within the budget."""
    return F.substring(F.coalesce(texts, F.lit("")), F.lit(1), longest_prefix(counts, budget))


def total_tokens(counts: Column) -> Column:
    return F.element_at(counts, -1).cast("long")
