"""What each of five filters removes, and what it would remove in every other order.

A filter set is judged once per document: the failed filters are a mask of five bits. Only the counts per part
and mask go further, at most 32 rows a part. For one mask, the orders in which a filter is the first to fail at
some step begin with one of a few prefixes, and the orders with a common prefix of s filters are neighbours in
lexicographic order: an interval of (5 - s)! of the 120 Lehmer ranks, the same for every document of the
mask. So a mask adds its counts at the start of each interval and takes them off at the end, and a running sum over
the ranks gives the counts of all 120 orders at once; no document is ever replayed through an order.

``failures`` judges the five filters of a text, and with them whether the same text occurs under a smaller
id anywhere in the table. That needs no join: rows are summed by digest of the text first, so that a text with
millions of copies arrives at the window of its digest as a few rows.

Defined cases: a null text is an empty one, a null part is the empty string. Rows without an id are no copies and make
none; rows of one id with equal texts are no copies of each other. Of several labels of one id a 1 counts. A part
has all its 600 rows, zeros included; an empty table has no parts and no rows. Only the named columns of the
documents and of the labels are read, others may have any name.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import landed

FILTERS = "ABCDE"
SPACE = r"\x20\x09-\x0D"
_BLANKS = " \t\n\x0b\x0c\r"
_MEASURES = ("removed", "redundant", "good_lost", "toxic_lost")


def failures(text: Column) -> dict[str, Column]:
    """Failure of the filters that one text decides: too short, too repetitive, too many capitals, odd marks."""
    inner = F.btrim(text, F.lit(_BLANKS))
    words = F.split(inner, f"[{SPACE}]+")  # of an empty text: one empty string
    none = (inner == "").cast("int")
    # Nothing here depends on a condition, so that the words are cut once for all filters.
    n, distinct = F.size(words) - none, F.size(F.array_distinct(words)) - none
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 200,
        "B": 100 * distinct.cast("long") < 50 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.char_length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, docs, good, toxic): documents of each part by the set of filters they fail."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.when(fails, F.lit(1 << FILTERS.index(f))).otherwise(0) for f, fails in failures(text).items()]
    own = docs.select(
        "doc_id",
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        sum(bits[1:], bits[0]).alias("mask"),
    )
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(one("quality"), one("toxic"))
    known = known.withColumnRenamed("doc_id", "labelled").where("quality = 1 or toxic = 1")
    marked = own.join(known, F.col("doc_id") == F.col("labelled"), "left")
    kind = ["digest", "part", "mask", F.coalesce("quality", F.lit(0)).alias("good"),
            F.coalesce("toxic", F.lit(0)).alias("toxic")]
    per_id = marked.groupBy("doc_id", *kind).agg(F.count("*").alias("docs"))
    # The row with the smallest id of a kind carries how many rows have it; only these may be no copies.
    per_kind = per_id.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("docs").alias("docs"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("docs"))), F.lit(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "docs"))).alias("least"),
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    originals = F.col("nameless") + F.when(F.col("least.doc_id") == first, F.col("least.docs")).otherwise(0)
    split = per_kind.withColumn("originals", originals)
    repeated = F.lit(1 << FILTERS.index("E"))
    pair = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("originals").alias("docs")),
        F.struct((F.col("mask") + repeated).alias("mask"), (F.col("docs") - F.col("originals")).alias("docs")),
    )
    return (
        split.select("part", "good", "toxic", F.explode(pair).alias("x"))
        .groupBy("part", "x.mask")
        .agg(
            F.sum("x.docs").alias("docs"),
            F.sum(F.col("x.docs") * F.col("good")).alias("good"),
            F.sum(F.col("x.docs") * F.col("toxic")).alias("toxic"),
        )
        .where("docs > 0")
    )


def lehmer_rank(order: str) -> int:
    """Place of an order of the filters in lexicographic order: its Lehmer digits in factorial base."""
    later = [sum(y < x for y in order[k + 1 :]) for k, x in enumerate(order)]
    return sum(d * factorial(len(order) - 1 - k) for k, d in enumerate(later))


def prefix_intervals() -> list[tuple[int, int, int, int, int]]:
    """(step, bit of its filter, bits of the filters before, first rank, end rank) of each prefix of an order."""
    found = []
    for step in range(1, len(FILTERS) + 1):
        for prefix in permutations(FILTERS, step):
            rest = "".join(sorted(set(FILTERS) - set(prefix)))
            first = lehmer_rank("".join(prefix) + rest)
            bits = [1 << FILTERS.index(f) for f in prefix]
            found.append((step, bits[-1], sum(bits[:-1]), first, first + factorial(len(rest))))
    return found


def _mask_steps(spark: SparkSession) -> DataFrame:
    """(mask, step, first, end, is_first): intervals of ranks where a mask fails the filter of the step."""
    prefixes = spark.createDataFrame(
        prefix_intervals(), "step int, bit int, before int, first int, end int"
    )
    masks = F.sequence(F.lit(1), F.lit((1 << len(FILTERS)) - 1))
    return (
        prefixes.select("*", F.explode(masks).alias("mask"))
        .where(F.col("mask").bitwiseAND(F.col("bit")) != 0)
        .select("mask", "step", "first", "end", (F.col("mask").bitwiseAND(F.col("before")) == 0).alias("is_first"))
    )


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counts per part and mask."""
    spark = counts.sparkSession
    steps = counts.join(F.broadcast(_mask_steps(spark)), "mask")  # the table has some 5,000 rows, by rule
    here = lambda c, yes: F.when(F.col("is_first") == yes, F.col(c)).otherwise(0)
    changes = steps.select(
        "part",
        "step",
        F.explode(F.array(*[F.struct(F.col(at).alias("rank"), F.lit(sign).alias("sign"))
                            for at, sign in (("first", 1), ("end", -1))])).alias("at"),
        here("docs", True).alias("removed"),
        here("docs", False).alias("redundant"),
        here("good", True).alias("good_lost"),
        here("toxic", True).alias("toxic_lost"),
    )
    ends = changes.groupBy("part", "step", "at.rank").agg(
        *[F.sum(F.col(m) * F.col("at.sign")).alias(m) for m in _MEASURES]
    )
    alone = {f: F.sum(F.when(F.col("mask") == 1 << k, F.col("docs"))) for k, f in enumerate(FILTERS)}
    totals = counts.groupBy("part").agg(
        F.sum("docs").alias("total"), *[F.coalesce(n, F.lit(0)).alias(f"only_{f}") for f, n in alone.items()]
    )
    orders = sorted("".join(p) for p in permutations(FILTERS))
    named = F.array(*[F.lit(o) for o in orders])
    grid = (
        totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("rank"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
        .withColumn("filter_order", F.element_at(named, F.col("rank") + 1))
        .withColumn("filter", F.substr("filter_order", "step", F.lit(1)))
    )
    through_ranks = Window.partitionBy("part", "step").orderBy("rank")
    summed = grid.join(ends, ["part", "step", "rank"], "left").select(
        *grid.columns, *[F.sum(F.coalesce(m, F.lit(0))).over(through_ranks).alias(m) for m in _MEASURES]
    )
    so_far = F.sum("removed").over(Window.partitionBy("part", "rank").orderBy("step"))
    unique = F.coalesce(*[F.when(F.col("filter") == f, F.col(f"only_{f}")) for f in FILTERS])
    return summed.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - so_far).alias("kept"),
        "removed",
        "redundant",
        unique.alias("unique_fails"),
        "good_lost",
        "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of the five filters over ``docs`` (doc_id, text, the part's column) and ``labels``. Runs a job.

    The counts, at most 32 rows a part, are landed: both what is summed over ranks and the totals read them.
    """
    return audit(landed(mask_counts(docs, labels, part), "masks"))
