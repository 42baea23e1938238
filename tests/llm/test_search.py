"""Indexes, sets, votes and scores against plain Python."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from moodwire.llm import byte_bpe, decontaminate, near_dups, quality, top_k
from moodwire.llm.common import components
from moodwire.llm.fm_index import FMIndex, suffix_array

DOCS = "doc_id long, text string"


def test_fm_index_equals_scanning():
    draw = np.random.default_rng(3)
    for _ in range(60):
        text = draw.integers(1, draw.integers(2, 20), draw.integers(1, 80))
        whole = [*text.tolist(), 0]
        assert suffix_array(np.array(whole)).tolist() == sorted(range(len(whole)), key=lambda k: whole[k:])
        index = FMIndex(text, int(draw.integers(1, 9)))
        lengths = draw.integers(1, 5, 12)
        phrases = np.zeros((12, 4), np.int64)
        for k, n in enumerate(lengths):
            phrases[k, :n] = draw.integers(1, 8, n)
        low, high = index.search(phrases, lengths)
        for k, n in enumerate(lengths):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == phrases[k, :n]).all()]
            assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want


def plain_overlap(text, items, window):
    words = decontaminate.words_of((text or "").encode())
    hit, found = set(), set()
    for name, item in items:
        own = decontaminate.words_of((item or "").encode())
        spans = [own[k : k + window] for k in range(max(1, len(own) - window + 1))] if own else []
        for span in spans if name is not None else []:
            for k in range(len(words) - len(span) + 1):
                if words[k : k + len(span)] == span:
                    hit |= set(range(k, k + len(span)))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_overlap_equals_scanning(spark, block_bytes):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "B", "c1", "é", "dd"])
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 9)))) for k in range(6)]
    items += [(3, "twice the id"), (7, None), (8, "--"), (None, "a a a"), (9, items[0][1])]
    docs = [(k, "  ".join(word() for _ in range(rng.randint(0, 40)))) for k in range(20)]
    docs += [(0, docs[0][1]), (None, "twice, THE id"), (50, None), (51, ""), (52, "x " * 3000)]
    found = decontaminate.benchmark_overlap(
        spark.createDataFrame([(*d, "kept") for d in docs], DOCS + ", overlap string").withColumn(
            "extra", F.lit(1)
        ),
        spark.createDataFrame(items, "item_id long, text string"),
        window=4,
        shard_words=30,
        block_bytes=block_bytes,
    )
    got = sorted(
        ((r.doc_id, r.text, r.overlap.n_words, r.overlap.n_hit, r.overlap["items"]) for r in found.collect()),
        key=str,
    )
    assert got == sorted(((i, t, *plain_overlap(t, items, 4)) for i, t in docs), key=str)
    assert "extra" in found.columns
    for r in found.collect():
        assert sum(b - a for a, b in zip(r.overlap.starts, r.overlap.ends)) == r.overlap.n_hit


def test_spans_are_cut_out():
    text = "One, two THREE four; five. six".encode()
    assert decontaminate.without_spans(text, [1, 4], [3, 5]) == b"One,  four; . six"
    assert decontaminate.without_spans(b"all gone", [0], [2]) == b""


def test_overlap_of_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], DOCS)
    assert decontaminate.benchmark_overlap(docs, items).first().overlap.n_hit == 0
    assert decontaminate.benchmark_overlap(docs.limit(0), items).count() == 0


def plain_classes(docs, percent=85):
    sets = []
    for _, text in docs:
        words = (text or "").encode().lower().split()
        places = max(1, len(words) - 4) if words else 0
        sets.append({tuple(words[k : k + 5]) for k in range(places)})
    near = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = near[i], near[j]
                near = [min(a, b) if x in (a, b) else x for x in near]
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[near[k]] = min(i, least.get(near[k], i))
    return [
        (i, len(s), least.get(near[k]) if s else i, i == (least.get(near[k]) if s else i))
        for k, ((i, _), s) in enumerate(zip(docs, sets))
    ]


@pytest.mark.parametrize("unit", [500_000, 150])
def test_near_duplicates_equal_all_pairs(spark, unit):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    docs = []
    for group in range(6):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(12):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            docs.append((rng.randrange(10_000), " ".join(own)))
    docs += [(10_001, "Just three words"), (10_002, "just THREE\twords"), (10_003, None), (10_004, " \n ")]
    docs += [(None, docs[3][1] + " end"), (None, "alone " + docs[60][1])]
    docs += [(10_005, ""), (None, docs[0][1]), (None, "never seen by anyone else"), docs[1], (10_006, "x " * 9000)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], DOCS + ", node string")
    got = near_dups.near_duplicates(frame, unit=unit).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_classes(docs), key=str)


def test_packs_grow_with_the_shingles():
    assert near_dups.packs(0, 250_000) == near_dups.PACKS
    assert near_dups.packs(10**12, 250_000) == 4_000_000


def test_near_duplicates_of_nothing(spark):
    assert near_dups.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_min_max_bands_agree_as_planned():
    shingles, keys = near_dups.Shingles(), near_dups.MinMax(96, 32)
    rng = random.Random(2)
    met = 0
    for _ in range(60):
        base = [str(rng.random()) for _ in range(160)]
        other = base[:147] + [str(rng.random()) for _ in range(13)]  # similarity 0.85
        a, b = (keys.keys(s) for s in shingles([" ".join(x).encode() for x in (base, other)]))
        met += bool((a == b).any())
    assert met == 60


def test_components_are_the_smallest_nodes(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 460)]
    root = list(range(500))
    for a, b in edges:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {k: root[k] for e in edges if e[0] != e[1] for k in e}
    assert got == want


def plain_tiktoken():
    tokens = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ranks = {t: k for k, t in enumerate(tokens)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_ids_are_those_of_the_rank_file(spark):
    plain = plain_tiktoken()
    rng = random.Random(1)
    texts = [None, "", " ", "a" * 30_000, "\n\n  x\t ", "it's <|endoftext|> 12345", "naïve 東京 🙂\x00\x1c\x85"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 900), rng.randrange(0x3000, 0xD000)])) for _ in range(200))
              for _ in range(30)]
    rows = [(k, t, "old") for k, t in enumerate(texts)] + [(None, "twice", "old")] * 2
    frame = spark.createDataFrame(rows, DOCS + ", ids string")
    coder = byte_bpe.ByteBPE(
        spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )
    got = coder.decode(coder.encode(frame)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == plain.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    odd = spark.createDataFrame([(1, [0, 99_999_999]), (2, None), (3, [None]), (4, [])], "k int, ids array<int>")
    assert [r.decoded for r in coder.decode(odd).orderBy("k").collect()] == [None, None, None, bytearray()]
    assert coder.encode(frame.limit(0)).count() == 0


def test_quality_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, "plain words"), (-3, "x")], DOCS)
    both = docs.select("doc_id", "text").unionByName(extra).withColumn("score", F.lit("old"))
    model = quality.fit(both, labels, label="quality")
    scored = quality.score(both, model).withColumn("held", quality.held_out()).join(labels, "doc_id", "left")
    rows = scored.collect()
    assert len(rows) == 1004 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    judged = [r for r in rows if r.held and r.quality is not None]
    good = [r.predicted for r in judged if r.quality == 1]
    bad = [r.predicted for r in judged if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.25 * len(bad)
    assert [r.score for r in rows if r.doc_id in (-1, -2)] == [model.prior] * 2


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a text")], DOCS)
    labels = spark.createDataFrame([(1, None), (9, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, label="quality")
    assert quality.score(docs, model).first().score == 0.5
    assert quality.score(docs.limit(0), model).count() == 0


def test_votes_are_those_of_all_neighbours():
    draw = np.random.default_rng(8)
    counts = draw.integers(0, 4, (60, quality.TERMS)).astype(np.float32)
    labels = draw.integers(0, 2, 60).astype(float)
    model = quality.Neighbours(counts[:50], labels[:50], 10, 7)
    latent = model._latent(model._terms(counts[50:]))
    for row, score in zip(latent, model.scores(counts[50:])):
        near = [round(float(np.float32(row @ v)), 5) for v in model.vectors]
        last = sorted(near)[-7]
        chosen = [k for k in range(50) if near[k] >= last - 2e-5]
        weight = [max(near[k], 1e-4) ** 4 for k in chosen]
        assert abs(score - np.average(labels[chosen], weights=weight)) < 0.2


def test_top_k_equals_all_products(spark):
    rng = random.Random(6)
    rows = [(k, [rng.choice([-1.5, -0.3, 0.0, 0.25, 0.9]) for _ in range(12)]) for k in range(120)]
    rows += [(200, None), (201, []), (202, [None] * 12), (203, [float("nan")] * 12), (204, [float("inf")] + [0.0] * 11)]
    rows += [(None, rows[0][1]), (0, rows[5][1]), (300, [1.0, 2.0]), (310, [0.5, 0.5]), (7, rows[7][1])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = top_k.top_k(frame, F.col("vec_id") % 10 == 0, k=3, candidates=25, queries=4)
    ints = [
        (i, tuple(int(np.floor(256 * x)) for x in v))
        for i, v in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v)
    ]
    want = []
    asked = {}
    for i, v in ints:
        if i % 10 == 0:
            asked[i, len(v)] = min(v, asked.get((i, len(v)), v))
    for (i, n), v in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ints if j != i and len(w) == n)
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores[:3])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert top_k.top_k(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0
