"""The registered queries against their SQL, and the pipeline against the operators it calls."""

from __future__ import annotations

import compare
import corpus_pipeline
import pytest

from moodwire.llm import quality
from moodwire.llm.registered import ORACLES, QUERIES
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert compare.difference(df, compare.connect(SF_DIR), ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_near_copies_leave_by_id_and_text(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    a = words("a", 104)
    at_82 = words("a", 94) + " " + words("b", 10)  # 90 of 110 shingles
    e, g, c = words("e", 50), words("g", 104), words("c", 50)
    rows = [(1, a), (2, at_82), (None, c), (None, a + " end"), (7, e), (7, a + " more"), (8, g), (8, g + " more"),
            (8, g), (9, ""), (9, words("h", 20)), (None, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], docs.schema)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, frame, SF_DIR).collect()), key=str)
    eight = [t for i, t in got if i == 8]
    assert len(eight) == 1 and eight[0] in (g, g + " more")
    want = [(1, a), (None, c), (7, e), (8, eight[0]), (9, ""), (9, words("h", 20)), (None, None)]
    assert got == sorted(want, key=str)


def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (-5, "", "en", "s", 0), (-6, "password=abcdefghij", "en", "s", 19)],
        docs.schema,
    )
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = out.collect()
        before = {r.doc_id: r for r in docs.collect()}
        if name == "quality":
            model = quality.fit(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"), label="quality")
            kept = quality.score(docs, model).where("predicted = 1").select("doc_id").collect()
            assert sorted(map(str, kept)) == sorted(str((r.doc_id,)).replace("(", "Row(doc_id=").replace(",)", ")") for r in rows)
        if name == "secrets":
            assert len(rows) == len(before)
            assert next(r for r in rows if r.doc_id == -6).text == "password=[SECRET]"
            assert all(r.n_chars == len(r.text) for r in rows if r.text and r.text != before[r.doc_id].text)
        else:
            assert all(r == before[r.doc_id] for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert ids.count() == docs.count() and ids.where(F.size("ids") != F.col("n_tokens")).count() == 0
