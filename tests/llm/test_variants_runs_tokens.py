"""Spelling variants, periodic runs and token counts against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from campaignlake.llm import periodic_runs, queries, spelling, token_counts
from campaignlake.llm.common import ship_package

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(brute.awkward(), brute.SCHEMA)


# ---- spelling variants

def plain_counts(rows, slips=None) -> dict[str, int]:
    seen: Counter = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = brute.lower(run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if slips and h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 2}


def near_words(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts: dict[str, int]) -> set[tuple]:
    by_length = defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    form, found = {}, {}
    for w, n in counts.items():
        near = [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if near_words(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 10 * n else None
        found[w] = len(near)
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, found[w], counts.get(form[w])))
    return out


def variants_of(spark, counts: dict[str, int]) -> list[tuple]:
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    return [tuple(r) for r in spelling.variant_groups(words).collect()]


@pytest.mark.parametrize("range_words", [3, 40, 10_000])
def test_variants_equal_a_search_over_all_pairs(spark, monkeypatch, range_words):
    """Few letters make many neighbours, repeated letters and shared prefixes; small ranges share trie nodes."""
    monkeypatch.setattr(spelling, "RANGE_WORDS", range_words)
    rnd = random.Random(range_words)
    counts = {"".join(rnd.choices("abà", k=rnd.randint(7, 9))): int(10 ** rnd.uniform(0.5, 4)) for _ in range(260)}
    counts |= {"l" * k: 10**k for k in range(7, 12)} | {"z" * 3000: 5, "z" * 3001: 700, "y" + "z" * 2999: 2}
    got = variants_of(spark, counts)
    assert len(got) == len(counts) and set(got) == plain_variants(counts)


def test_counts_of_awkward_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(50, "Straßen-Häuser ÀÉÎÕÜ×÷ÿx abcdefg"), (51, "straßen häuser àÉÎÕÜ×÷ÿx ABCDEFG Āabcdefg")]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in rows * 3], "doc_id long, text string, word int, n string")
    for slips in (None, 3):
        got = {r.word: r.n for r in spelling.counted_words(frame, slips=slips).collect()}
        assert got == plain_counts(rows * 3, slips) and got
    assert spelling.variant_groups(spelling.counted_words(frame.where("false"))).collect() == []


def test_the_spelling_query_equals_the_plain_version(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in queries.op11_trie_pair_variants(spark, SMALL).collect()]
    want = plain_variants(plain_counts(rows, 31))
    assert len(got) == len(want) and set(got) == want and any(r[1] for r in got)


def test_nodes_are_numbers_of_prefixes():
    words = sorted({"".join(random.Random(i).choices("ab", k=i % 9)) for i in range(400)})
    for size in (1, 2, 7, 1000):
        parts = [words[i : i + size] for i in range(0, len(words), size)]
        owners = spelling.range_owners([(k, p[0], p[-1]) for k, p in enumerate(parts)])
        number: dict[str, int] = {}
        for k, part in enumerate(parts):
            for word, nodes in zip(part, spelling.number_nodes(part, k, owners[k]), strict=True):
                assert len(nodes) == len(word) + 1
                for depth, node in enumerate(nodes):
                    assert number.setdefault(word[:depth], node) == node
        assert len(set(number.values())) == len(number)


# ---- periodic runs

def plain_runs(words: list) -> list[tuple[int, int, int]]:
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((a, q, b - a) for (a, b), q in found.items())


def plain_collapsed(words: list, runs: list[tuple]) -> list:
    gone = {i for a, q, n in runs for i in range(a + q, a + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def looped(name: int, text: str | None) -> list[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(name).encode()), len(words)
    if name is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def test_runs_equal_a_search_over_all_periods(spark):
    rnd, texts = random.Random(11), []
    for k in range(300):
        n, letters = rnd.randint(0, 150), rnd.choice([1, 2, 2, 3, 6, 40])
        words = [rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN"[:letters]) for _ in range(n)]
        for _ in range(rnd.randint(0, 3) if n > 5 else 0):
            a = rnd.randrange(n)
            p = rnd.randint(1, max(1, (n - a) // 2))
            for i in range(a, rnd.randint(a, n)):
                words[i] = words[a + (i - a) % p]
        texts.append(words)
    texts += [["a"] * 5000, [str(i % 977) for i in range(6000)], ["ab"[bin(i).count("1") % 2] for i in range(1024)]]
    rows = [(k, "\t".join(w) + "\n ", k) for k, w in enumerate(texts)]
    got = periodic_runs.periodic_runs(spark.createDataFrame(rows, "runs long, text string, n_words int"), ["runs"]).toDF("id", "n", "runs", "collapsed")
    got = {r.id: r for r in got.collect()}
    for k, words in enumerate(texts):
        want = plain_runs(words)
        assert [(r.start, r.period, r.length) for r in got[k].runs] == want
        assert got[k].n == len(words) and got[k].collapsed == " ".join(plain_collapsed(words, want))


def test_runs_of_awkward_documents(spark, docs):
    rows = docs.collect()
    got = periodic_runs.periodic_runs(docs.withColumn("_words", F.lit(1)).withColumn("plain", F.lit(2)), ["doc_id", "plain"], texts=False).collect()
    want = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        runs = plain_runs(words) if len(words) < 1000 else None
        want.append((r.doc_id, len(words), runs, hashlib.sha256(" ".join(plain_collapsed(words, runs or [])).encode()).hexdigest()))
    got = [(r.doc_id, r.n_words, [(x.start, x.period, x.length) for x in r.runs], r.collapsed) for r in got]
    short = lambda rows: sorted(r for r in rows if r[1] < 1000 and r[0] is not None)
    assert short(got) == short(want) and len(got) == len(want)
    assert periodic_runs.periodic_runs(docs.where("false"), ["doc_id"]).collect() == []


def test_the_run_query_equals_the_plain_version(spark, docs, tmp_path):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if len(r.text or "") < 9000]
    docs.select("doc_id", "text").where("doc_id <> 11 or doc_id is null").union(spark.createDataFrame(table, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    want = []
    for r in rows:
        words = looped(r.doc_id, r.text)
        runs = plain_runs(words)
        longest = min(((-n, a, q) for a, q, n in runs), default=None)
        best = (None,) * 4 if longest is None else (longest[1], -longest[0], longest[2], 1000 * -longest[0] // longest[2])
        digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
        lines = "".join(f"{a},{n},{q}\n" for a, q, n in runs)
        want.append((r.doc_id, len(runs), *best, digest(lines), digest(" ".join(plain_collapsed(words, runs)))))
    got = [tuple(r) for r in queries.op12_tiled_periodic_runs(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(want) and sum(r[1] > 0 for r in got) > 10


# ---- token counts

@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_prefix_counts(tokenizer, text: str) -> list[int]:
    return [len(x.ids) for x in tokenizer.encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)]


PIECES = st.sampled_from([" ", "  ", "\n", "\t", "　", "a", "b", "ll", "re", "'", "'ll", "'s", "1", "23", "=", "é", "漢", "😀", "́", "\x1c", " the", "ing", "<|endoftext|>", "<|", "tion"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(PIECES, max_size=25).map("".join), st.text(max_size=25)))
def test_prefix_counts_equal_the_library(tokenizer, text):
    got = token_counts.prefix_counter(token_counts.default_vocabulary()).counts(text)
    assert got.tolist() == plain_prefix_counts(tokenizer, text)


def test_texts_split_without_the_library_are_split_as_it_does(tokenizer):
    counter = token_counts.prefix_counter(token_counts.default_vocabulary())
    for c in map(chr, [*range(0x250), *range(0x2010, 0x2028)]):
        text = f"a{c}{c} {c}1{c}b {c}\n {c}"
        assert counter.common.fullmatch(text)
        assert counter.split.findall(text) == [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def test_stored_counts_answer_truncations_and_budgets(spark, docs, tokenizer):
    extra = [(60, "a <|endoftext|> b"), (61, "x" * 30_000 + " " * 3000 + "y"), (62, "  <|endoftext|>\n\n<|endoftext")]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("counts", F.lit(1)).withColumn("_text", F.lit(2))
    table = token_counts.prefix_counts(frame, ["doc_id", "text"])
    c = F.col("counts")
    rows = table.select(
        "text", "n_bytes", "counts", token_counts.total_tokens(c).alias("total"), token_counts.truncated(F.col("text"), c, 7).alias("cut"),
        token_counts.longest_prefix(c, 0).alias("none"), token_counts.longest_prefix(c, -1).alias("negative"),
        token_counts.tokens_of_prefix(c, F.lit(3)).alias("three"), token_counts.tokens_of_prefix(c, F.lit(10**6)).alias("beyond"),
    ).collect()
    assert len(rows) == frame.count()
    for r in rows:
        text = r.text or ""
        count = lambda x: len(tokenizer.encode(x, add_special_tokens=False).ids)
        assert (r.n_bytes, len(r.counts), r.total) == (len(text.encode()), len(text) + 1, count(text))
        assert r.none == 0 and r.negative is None and r.beyond is None
        assert r.three == (count(text[:3]) if len(text) >= 3 else None)
        best = max(i for i, n in enumerate(r.counts) if n <= 7)
        assert r.cut == text[:best] and count(r.cut) <= 7
        assert best == len(text) or count(text[: best + 1]) > 7
    assert token_counts.prefix_counts(frame.where("false"), ["doc_id"]).collect() == []


def test_the_count_query_equals_the_library(spark, tokenizer):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op13_prefix_token_counts(spark, SMALL).collect()}
    assert set(got) == set(texts)
    for (name, text), ids in zip(texts.items(), tokenizer.encode_batch(list(texts.values()), add_special_tokens=False), strict=True):
        assert tuple(got[name]) == (name, len(text.encode()), len(ids.ids), len(ids.ids) > 512)
