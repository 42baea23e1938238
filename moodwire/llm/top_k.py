"""Exact top-k inner products by columnar branch and bound.

Components become whole numbers floor(scale * x). Candidates and queries are dealt to tasks in blocks of
bounded size, every candidate block with every query block. A task holds its candidates in vertical
layout, one row per dimension, and adds up scores a few dimensions at a time, those with the
most mass first. After each step a candidate is dropped from a query's columns if its score so far plus the
product of the norms of the rest (Cauchy-Schwarz) cannot reach the query's k-th best lower bound. Each
task reports its k best per query, and a ranked window over those gives the result; its size is
k rows per query and candidate block.

The work is every query against every candidate, as the task states; blocks hold at most about
``candidates`` and ``queries`` rows, and no row is sent to the driver.

Defined cases: vectors that are null or empty, or hold a null or a non-finite component, and rows with a
null id take no part. Vectors of different lengths are not compared. Ties go to the smaller id; rows
that repeat an id are candidates of their own, but never of a query with the same id, and a repeated
query id is asked once, with the first of its vectors in their order. A query with no candidate has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dimensions added in one step, and queries that share the survivors of a step.
STEP, TOGETHER = 16, 16


def _rest(columns: np.ndarray) -> np.ndarray:
    """Norms of dimensions d, d + 1, ... for each d, rounded up; the last row is zero."""
    squares = np.cumsum((columns.astype(np.float64) ** 2)[::-1], axis=0)[::-1]
    return np.concatenate([np.sqrt(squares) * (1 + 1e-12), np.zeros((1, columns.shape[1]))])


def best(
    queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, row position, score) of the k best rows of each query, others' ids only.

    ``queries`` and ``rows`` hold whole numbers; rows are ordered by id, so a tie keeps the earlier.
    """
    dims = rows.shape[1]
    order = np.argsort(-np.abs(rows).sum(0, dtype=np.float64), kind="stable")
    largest = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * dims
    kind = np.float64 if largest < 2**52 else np.int64  # sums are exact in either
    columns = np.ascontiguousarray(rows[:, order].T).astype(kind)
    queries = queries[:, order].astype(kind)
    tail, mass = _rest(columns), _rest(queries.T).T
    out = ([], [], [])
    for g in range(0, len(queries), TOGETHER):
        group, own, rest = queries[g : g + TOGETHER], query_ids[g : g + TOGETHER], mass[g : g + TOGETHER]
        alive, left = np.arange(len(row_ids)), columns
        score = np.zeros((len(group), len(alive)), kind)
        for s in range(0, dims, STEP):
            e = min(s + STEP, dims)
            score += group[:, s:e] @ left[: e - s]
            left = left[e - s :]
            if e == dims or len(alive) <= k + 1:
                continue
            slack = np.ceil(rest[:, e, None] * tail[e, alive])
            low = np.where(row_ids[alive] == own[:, None], -np.inf, score - slack)
            floor = np.partition(low, len(alive) - k, axis=1)[:, len(alive) - k, None]
            keep = (score + slack >= floor).any(0)
            if 4 * np.count_nonzero(keep) <= 3 * len(keep):
                alive, score, left = alive[keep], score[:, keep], left[:, keep]
        for q in range(len(group)):
            others = np.flatnonzero(row_ids[alive] != own[q])
            mine = score[q, others].astype(np.int64)
            if len(mine) > k:
                top = np.flatnonzero(mine >= np.partition(mine, len(mine) - k)[len(mine) - k])
                others, mine = others[top], mine[top]
            top = np.argsort(-mine, kind="stable")[:k]
            out[0].append(np.full(len(top), g + q))
            out[1].append(alive[others[top]])
            out[2].append(mine[top])
    none = [np.empty(0, np.int64)]
    return tuple(np.concatenate(x or none) for x in out)


def _task(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Candidates and queries of one pair of blocks."""
        sides = []
        for table in (left, right):
            table = table.sort_by("vec_id")
            vectors = table.column("v").combine_chunks()
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            ids = table.column("vec_id").to_numpy()
            sides.append((flat.reshape(len(ids), -1) if len(ids) else np.empty((0, 1)), ids))
        (rows, row_ids), (queries, query_ids) = sides
        if not len(row_ids) or not len(query_ids):
            found = [np.empty(0, np.int64)] * 3
        else:
            found = best(queries, query_ids, rows, row_ids, k)
        return pa.table(
            {"query_id": query_ids[found[0]], "vec_id": row_ids[found[1]], "score": found[2]},
            schema=pa.schema([(n, pa.int64()) for n in ("query_id", "vec_id", "score")]),
        )

    return run


def top_k(
    vectors: DataFrame,
    asked: Column,
    *,
    k: int = 5,
    scale: int = 256,
    candidates: int = 8192,
    queries: int = 2048,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows for each row where ``asked`` holds.

    ``vectors`` has vec_id and embedding.
    """
    x = F.transform(F.col("embedding").cast("array<double>"), lambda e: e)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    own = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        asked.alias("asked"),
        F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"),
        F.size("embedding").alias("n"),
    )
    counts = own.agg(F.count("*"), F.count_if("asked")).first()
    parts, blocks = max(1, -(-counts[0] // candidates)), max(1, -(-counts[1] // queries))
    first = own.where("asked").groupBy("vec_id", "n").agg(F.min("v").alias("v"))
    number = lambda m, *salt: F.pmod(F.xxhash64("vec_id", *salt), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    # Repeated ids spread by their values too.
    left = own.select("vec_id", "v", "n", number(parts, "v").alias("part"), every(blocks).alias("block"))
    right = first.select("vec_id", "v", "n", every(parts).alias("part"), number(blocks).alias("block"))
    keys = ["n", "part", "block"]
    found = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(_task(k), "query_id long, vec_id long, score long")
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
