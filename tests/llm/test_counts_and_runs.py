"""Token counts against the library, the filter audit against replayed orders, runs against all periods."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from moodwire.llm import filter_audit, periodic_runs, registered, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_proven_strings_are_one_token(library):
    proven = token_counts.whole_tokens(PATH)
    assert len(proven) > 30_000 and all(library(p) == 1 for p in proven)
    kept = {"the", "é", "!"}
    assert kept <= set(proven)


def test_counts_equal_the_library_on_odd_strings(library):
    counter = token_counts.Counter(PATH, token_counts.whole_tokens(PATH))
    rng = random.Random(1)
    letters = "aAbsStTéÉßẞIİıΣσς'’  \t\n\x0b\x1c\x1f\x85\xa0 -–…_.!?0123½²Ⅷ中文日本ไทย😀́‍ﬁǅȺ"
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        if rng.random() < 0.1:
            text += rng.choice(["<|endoftext|>", "<|startoftext|>", "<|endoftext|"]) + text
        assert counter.count(text) == library(text), repr(text)
    counter.known = dict.fromkeys(counter.whole, 1) | {str(k): 0 for k in range(token_counts.REMEMBERED + 9)}
    assert counter.count("qzqz qzqz") == library("qzqz qzqz")  # what was remembered is forgotten


def test_counts_of_a_table(spark, library):
    long = "word " * 300_000 + "x" * 50_000
    texts = [None, "", "One, two THREE", "One, two THREE", "a<|endoftext|>b", long, "中文 " * 50]
    rows = [(k % 6 if k else None, t, 0, "n") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, value string")
    counts = token_counts.TokenCounts(spark, PATH)
    got = counts.counted(docs, limit=2048).collect()
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [
        (len((t or "").encode()), library(t), library(t) > 2048) for t in texts
    ]
    assert set(got[0].asDict()) == {"doc_id", "text", "n_tokens", "value", "n_bytes", "over_limit"}
    assert not any(r.over_limit for r in counts.counted(docs).collect())
    assert counts.counted(docs.limit(0)).count() == 0
    broken = docs.limit(1).select("doc_id", F.expr("cast(x'41ff42' as string)").alias("text"))
    row = counts.counted(broken).first()
    assert (row.n_bytes, row.n_tokens) == (3, library("A�B"))


def test_counts_of_the_given_documents(spark, library):
    rows = registered.QUERIES["op11_token_counts"](spark, SF_DIR).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = library(texts[r.doc_id])
        assert (r.n_tokens, r.over_limit) == (want, want > 2048)


def test_ranks_and_intervals():
    orders = sorted("".join(p) for p in permutations("ABCDE"))
    assert [filter_audit.lehmer_rank(o) for o in orders] == list(range(120))
    for step, bit, before, first, end in filter_audit.prefix_intervals():
        for rank, order in enumerate(orders):
            own = [1 << "ABCDE".index(f) for f in order]
            starts = own[step - 1] == bit and sum(own[: step - 1]) == before
            if first <= rank < end:
                assert starts
    assert len(filter_audit.prefix_intervals()) == 325


def plain_audit(rows, labels):
    """Every order replayed over the documents."""
    good = {i for i, q, t in labels if i is not None and q == 1}
    toxic = {i for i, q, t in labels if i is not None and t == 1}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    judged = []
    for i, t, lang in rows:
        text = t or ""
        words = text.encode().split()
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else set()
        fails |= {"D"} if set(text) & set("#$%&*|") else set()
        fails |= {"E"} if i is not None and i > least[text] else set()
        judged.append((i, lang or "", fails))
    out = {}
    for part in {j[1] for j in judged}:
        own = [j for j in judged if j[1] == part]
        shares = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [j for j in left if f in j[2]]
                early = [j for j in own if f in j[2] and set(order[: step - 1]) & j[2]]
                left = [j for j in left if f not in j[2]]
                shares[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(early), sum(j[2] == {f} for j in own),
                    sum(j[0] in good for j in gone), sum(j[0] in toxic for j in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shares[order[step - 1]])
    return out


def test_audit_equals_replayed_orders(spark):
    rng = random.Random(4)
    pieces = ["alpha beta", "A B C D", "x " * 210, " ".join(f"w{k}" for k in range(250)), "50%", "  \x0b ", "é\x85è"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 3))) for _ in range(25)] + [None, ""]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(200)]
    rows += [(70, "same words", "en")] * 3 + [(71, "long " * 100_000, "fr")]
    labels = [(rng.choice([None, *range(75)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(
        {c: F.lit(3) for c in ("mask", "part", "docs", "quality", "step")}
    )
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("lang", F.lit("x"))
    found = filter_audit.filter_audit(docs, known)
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in found.collect()}
    assert got == plain_audit(rows, labels)
    assert filter_audit.filter_audit(docs.limit(0), known).count() == 0
    assert filter_audit.filter_audit(docs, known.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def plain_runs(words, repeats=3, shortest=24):
    """(start, length, period) of all runs, by comparing the words at every period."""
    ids: dict = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    found: dict = {}
    for q in range(1, len(words) // repeats + 1):
        equal = np.concatenate([[0], (a[:-q] == a[q:]).astype(int), [0]])
        starts, stops = (np.flatnonzero(np.diff(equal) == d).tolist() for d in (1, -1))
        for s, e in zip(starts, stops):
            if e + q - s >= max(shortest, repeats * q):
                found.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def digest(text):
    return hashlib.sha256(text.encode("utf-8", "surrogateescape")).hexdigest()


def plain_row(words):
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_z_function():
    rng = random.Random(6)
    for _ in range(300):
        s = [rng.randint(0, 1) for _ in range(rng.randint(0, 20))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert periodic_runs.z_function(s) == want


@pytest.mark.parametrize("tile_words", [65_536, 64])
def test_runs_equal_all_periods(spark, tile_words):
    rng = random.Random(7)

    def made():
        words = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.6:
                root = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 40))]
                words += root * rng.randint(1, 8) + root[: rng.randint(0, len(root))]
            else:
                words += [rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))]
        return rng.choice([" ", "\n", "\x0b \t"]).join(words)

    texts = [made() for _ in range(120)]
    texts += [None, "", "  ", "a " * 23, "a " * 24, ("a " * 50 + "b " * 50) * 4, "same " * 5000, "é\x85è ß " * 30]
    texts += [" ".join(f"w{k % 700}" for k in range(2300)), texts[3], " ".join(f"w{k}" for k in range(3000))]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(3, texts[3]), (3, texts[4]), (None, texts[5]), (None, texts[6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in ("n_words", "runs", "period", "start", "own", "text_key")}
    )
    found = periodic_runs.periodic_runs(docs, tile_words=tile_words)
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed_sha256) for r in found.collect())
    want = Counter()
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs, kept = plain_row(words)
        want[i, len(words), tuple(runs), digest(kept)] += 1
    assert got == want
    for r in found.where("collapsed is not null").collect():
        assert r.runs and digest(r.collapsed) == r.collapsed_sha256
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_strongest_is_exact(spark):
    runs = [(9, 300, 100), (5, 24, 8), (5, 30, 10), (2, 999_999, 333_334), (0, 24, 8)]
    frame = spark.createDataFrame([(runs,), ([],)], f"runs {periodic_runs._RUNS}")
    best = [r[0] for r in frame.select(periodic_runs.strongest(F.col("runs"))).collect()]
    assert tuple(best[0]) == (0, 24, 8) and best[1] is None


def test_the_query_equals_a_plain_version(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in registered.QUERIES["op13_periodic_runs"](spark, SF_DIR).collect()}
    assert len(got) == len(rows)
    with_runs = 0
    for i, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(i).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs, kept = plain_row(words)
        best = None
        for s, m, q in runs:
            if best is None or (m * best[2], -s, -q) > (best[1] * q, -best[0], -best[2]):
                best = (s, m, q)
        r = got[i]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == digest("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r.collapsed_sha256 == digest(kept)
        with_runs += bool(runs)
    assert with_runs > 5
