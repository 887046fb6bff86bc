"""N-gram join, fingerprints, decontamination against plain versions."""

from __future__ import annotations

import hashlib
import random

import brute
import numpy as np
import pytest

from campaignlake.llm import decontamination, fingerprints, ngram_join, queries
from campaignlake.llm.common import ship_package
from campaignlake.llm.graph import components


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def near_copies(n: int = 120) -> list[tuple]:
    """Short and long texts with edits of different extent, passages that many share, and copies."""
    rng = random.Random(4)
    rows = []
    for i in range(n):
        words = brute.prose(i % 9, rng.choice([3, 6, 8, 12, 20, 45, 90, 200])).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"w{rng.randrange(30)}"
        rows.append((i, " ".join((brute.prose(99, 12).split() if i % 3 == 0 else []) + words)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, rows[5][1].upper())]


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80), (1, 60)])
def test_join_equals_all_pairs(spark, words, percent):
    rows = near_copies()
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.groups(rows, words, percent)


def test_join_with_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "RANGE_SHINGLES", 7)
    rows = near_copies(60)
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.groups(rows, 4, 85)


def test_join_of_awkward_rows(spark):
    docs = spark.createDataFrame(brute.awkward(), brute.SCHEMA).selectExpr("*", "1 as n", "'x' as sig")
    got = ngram_join.ngram_components(docs, 4, 85).collect()
    assert len(got) == len(brute.awkward())
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].component_id == by_id[3].component_id == 1 and by_id[9].component_id == 8
    assert by_id[4].n_shingles == by_id[6].n_shingles == 0 and by_id[6].component_id == 6
    assert ngram_join.ngram_components(docs.where("false"), 4, 85).collect() == []


def test_boundary_follows_cost():
    assert ngram_join.light_boundary({}, 85) == 0
    cheap, dear = ngram_join.light_boundary({3: 100}, 85), ngram_join.light_boundary({23: 100}, 80)
    assert cheap <= 6 and dear <= 23


def test_fingerprints_estimate_similarity(spark):
    rng = random.Random(8)
    # different words in each pair of texts: the draws of one word are the same in all texts that have it
    mixed = lambda i: " ".join(f"{rng.choice(brute.WORDS)}{rng.choice('abc')}{i // 2}" for _ in range(60 + i))
    rows = [(i, mixed(i)) for i in range(60)] + [(100, None), (101, ""), (102, "a"), (103, brute.prose(1, 30_000))]
    got = {r.doc_id: r for r in fingerprints.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    order = sorted(rows, reverse=True)
    apart = []
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        text, following = text or "", following or ""
        changed = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        apart += [r.near_edited - brute.weighted_jaccard(text, changed), r.near_next - brute.weighted_jaccard(text, following)] if text else []
    assert abs(np.mean(apart)) < 0.03 and np.std(apart) < 0.09


def test_equal_texts_have_equal_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 4)
    docs = spark.createDataFrame(brute.awkward(), brute.SCHEMA)
    got = fingerprints.document_fingerprints(docs).collect()
    assert len(got) == docs.count()
    marks: dict = {}
    texts = {i: t for i, t, *_ in brute.awkward()}
    for r in got:
        if r.doc_id is not None:
            assert marks.setdefault(texts[r.doc_id] or "", r.fingerprint) == r.fingerprint
    one = fingerprints.document_fingerprints(docs.where("doc_id = 12")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.document_fingerprints(docs.where("false")).collect() == []


ITEMS = [(1, brute.prose(1, 40)), (2, "One, TWO!"), (3, None), (4, ""), (5, "seven red birds"), (None, brute.prose(2, 30)), (11, brute.prose(1, 40))]


@pytest.mark.parametrize("block_words", [500_000, 5])
def test_decontamination_equals_plain_search(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block_words)
    items = [x for x in ITEMS if x[0] is not None]
    rows = [(r[0], r[1]) for r in brute.awkward() if r[0] != 11] + [(50, "x " + brute.prose(1, 40)[30:150] + " y one two z"), (51, brute.prose(3, 9))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.contamination(docs, bench, ["doc_id"]).collect()
    want = sorted(str((i, *brute.benchmark_hits(t, items))) for i, t in rows)
    assert sorted(str(tuple(r)[:6]) for r in got) == want


def test_decontamination_finds_the_longest_match(spark):
    docs = spark.createDataFrame([(1, "x y " + " ".join(brute.prose(1, 40).split()[5:30]) + " z")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, brute.prose(1, 40))], "item_id long, text string")
    assert decontamination.contamination(docs, bench, ["doc_id"]).first().longest_match == 25


def test_longest_match_of_copies_and_of_matches_of_different_length(spark):
    item = [f"w{i}" for i in range(40)]
    texts = [item[5:25], item[5:25], item[5:17] + ["x"] + item[20:24], item[5:30], item[5:30], item[3:6], item[:2] + ["x"], ["w7", "x", "w9"], item[36:], ["x"]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    # the second item ends where others go on, and the third has the first one's beginning
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[:15])), (3, " ".join(item[5:14] + ["y", "z"]))], "item_id long, text string")
    got = {r.doc_id: r.longest_match for r in decontamination.contamination(docs, bench, ["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == [20, 20, 12, 25, 25, 3, 2, 1, 4, 0]


@pytest.mark.parametrize("block_words", [500_000, 5])
def test_items_without_id_hit_words(spark, monkeypatch, tmp_path, block_words):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block_words)
    rows = [(r[0], r[1]) for r in brute.awkward() if r[0] != 11] + [(50, brute.prose(2, 30) + " y " + brute.prose(1, 40)), (51, brute.prose(3, 9))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op10_suffix_array_decontamination(spark, str(tmp_path)).collect()
    assert sorted(str(tuple(r)[:6]) for r in got) == sorted(str((i, *brute.benchmark_hits(t, ITEMS))) for i, t in rows)
    docs, bench = (spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("documents", "benchmark"))
    clean = decontamination.clean_documents(docs, bench).collect()
    assert sorted(str(tuple(r)) for r in clean) == sorted(str((i, t)) for i, t in rows if not brute.benchmark_hits(t, ITEMS)[3 + 1])


def test_windows_that_many_items_and_documents_share(spark):
    prefix = brute.prose(9, 14)
    bench = [(i // 2, f"{prefix} {brute.prose(300 + i, 12)}") for i in range(300)] + [(900, "only three words"), (None, prefix)]
    rows = [(i, f"a {prefix} b " + (brute.prose(300 + i, 12) if i % 3 else "only three words")) for i in range(200)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = decontamination.contamination(docs, items, ["doc_id"], unnamed=True).collect()
    want = {i: str((i, *brute.benchmark_hits(t, bench))) for i, t in rows}
    assert sorted(str(tuple(r)[:6]) for r in got) == sorted(want[i] for i, _ in rows)


def test_places_of_a_shard_are_bounded_by_its_rows_for_each_length_of_window():
    import pyarrow as pa

    item = " ".join(f"w{i}" for i in range(10))
    block = decontamination.TestBlock([str(i) for i in range(2000)], [f"{item} x{i}" for i in range(2000)], 10)
    assert len(block.begins) == 2001 and len(block.has) == 4000
    data, offsets = decontamination.tk.text_buffers(pa.array([f"{item} y"] * 500))
    _, hit, pairs, _ = decontamination.shard_hits(data, offsets, block)
    assert hit.sum() == 5000 and pairs.shape == (2, 500)


def test_a_task_holds_one_block_at_a_time():
    class Shared:
        def __init__(self, block):
            self._path, self.block = "x", block

        @property
        def value(self):
            assert not any("_value" in vars(b) for b in blocks if b is not self)
            self._value = self.block
            return self._value

    import pyarrow as pa

    blocks = [Shared(decontamination.TestBlock([str(i)], [brute.prose(i, 20)], 10)) for i in range(3)]
    batches = [pa.RecordBatch.from_pydict({"_text": [brute.prose(0, 20) + " y " + brute.prose(2, 20), None]})] * 2
    got = [r for b in decontamination._scan(blocks, [])(iter(batches)) for r in b.to_pylist()]
    assert [(r["n_hit"], r["n_items"], r["longest_match"]) for r in got] == [(40, 2, 20), (0, 0, 0)] * 2


def test_decontamination_keeps_columns_and_clean_rows(spark):
    docs = spark.createDataFrame(brute.awkward(), brute.SCHEMA).selectExpr("*", "doc_id as n_hit", "true as contaminated")
    bench = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    clean = decontamination.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert not {1, 2, 3} & {r.doc_id for r in clean.collect()} and clean.count() == len(brute.awkward()) - 4
    assert decontamination.clean_documents(docs, bench.where("false")).count() == len(brute.awkward())
    assert decontamination.clean_documents(docs.where("false"), bench).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (1, 40), (200, 201), (201, 200), (202, 201), (105, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{x: 100 for x in range(100, 140)}, 200: 200, 201: 200, 202: 200, 300: 100}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
