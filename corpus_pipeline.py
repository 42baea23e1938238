"""The corpus pipeline: five stages over ``documents``, each one landed before the next reads it.

Every stage takes and returns the columns of ``documents``, the last returns token ids. No stage drops or
changes a row for another reason than its own: quality drops what the classifier rejects, near duplicates
keep one document of each class, decontamination drops documents that hold a benchmark window, the
secret scan replaces values in the text (``n_chars`` follows), and the encoder turns texts into ids.

Rows without an id pass all stages; of near duplicates among them each distinct text without a smaller
id stays. Repeated rows (same id and text) become one in the near-duplicate stage. Rows of one id with
different texts are judged each by its text; of near duplicates among them one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodwire.llm import quality, secret_scan
from moodwire.llm.byte_bpe import ByteBPE
from moodwire.llm.common import landed, prepare
from moodwire.llm.decontaminate import benchmark_overlap
from moodwire.llm.near_dups import near_duplicates

#: Some stages have no SQL form (a fitted model, merges of byte pairs).
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours of known quality do not reject."""
    prepare(spark)
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), label="quality")
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (similarity 0.8 or more), the one with the smallest id."""
    prepare(spark)
    found = near_duplicates(docs, percent=80, by_text=True).where("kept")
    kept = found.select(F.col("doc_id").alias("own"), "text_key").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("own")) & (F.xxhash64("text") == F.col("text_key"))
    chosen = docs.join(kept, same, "left_semi")
    copies = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("lang", "source")
    return chosen.withColumn("copy", F.row_number().over(copies)).where("copy = 1").select(*docs.columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    prepare(spark)
    found = benchmark_overlap(docs, _table(spark, sf_dir, "benchmark"))
    return found.where("overlap.n_hit = 0").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the values of found secrets replaced; widely copied ones are marked as examples."""
    prepare(spark)
    found = secret_scan.scan(docs)
    text = secret_scan.redacted(F.col("text"), F.col("secrets"), example="[EXAMPLE]")
    found = found.withColumn("text", text)
    length = F.when(F.size("secrets") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return found.withColumn("n_chars", F.coalesce(length, "n_chars")).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and the digests of the ids and of the text read back from them."""
    prepare(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coder = ByteBPE(spark, path, public_tokenizers.PATTERN)
    return coder.encode(docs.select("doc_id", "text"), back="decoded").select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", clean_of_benchmark),
    ("secrets", without_secrets),
    ("byte_bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents through all stages."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), name)
    return docs
