"""Texts made to hurt: bytes that are not UTF-8, and pages deep enough to show any step that is not linear."""

from __future__ import annotations

import hashlib
import time

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from moodwire.llm import byte_bpe, html_text

BROKEN = b"<p>one \xff two</p>\xc3"


def broken(spark):
    rows = spark.createDataFrame([(1, BROKEN), (2, None), (3, "é".encode())], "doc_id long, raw binary")
    return rows.select("doc_id", F.expr("cast(raw as string)").alias("text"))


def test_pages_that_are_not_utf8(spark):
    got = {r.doc_id: r.text for r in html_text.extract(broken(spark), "text").collect()}
    assert got == {1: "one � two\n\n�", 2: "", 3: "é"}


def test_byte_pairs_of_texts_that_are_not_utf8(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coder = byte_bpe.ByteBPE(spark, path, public_tokenizers.PATTERN)
    ranks = {t: k for k, t in enumerate(byte_bpe.read_ranks(path))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    read = BROKEN.decode("utf-8", "replace")
    row = coder.encode(broken(spark), back="decoded").where("doc_id = 1").first()
    assert row.ids == plain.encode_ordinary(read)
    assert hashlib.sha256(row.decoded).digest() == hashlib.sha256(read.encode()).digest()


@pytest.mark.parametrize(
    "page, least, most",
    [
        ("<em><table><tr><td>" + "<b>" * 20_000 + "</em>" * 20_000, 0, 0),
        ("<ul><li>x" * 4_000, 4_000, 4_000 * 50),
        ("<div>" * 50_000 + "<p>x" * 50_000, 50_000, 200_000),
        ("<svg>" + "<g>" * 20_000 + "</p>" * 20_000 + "y", 1, 10),
        ("<select>" + "<option>o" * 30_000, 30_000, 90_000),
    ],
)
def test_deep_pages_take_linear_time_and_room(page, least, most):
    began = time.process_time()
    text = html_text.rendered(page)
    assert time.process_time() - began < 3
    assert least <= len(text) <= most
