"""Results that requests of one run share.

A service that works through its requests one after another stores what a request computed, and the
requests behind it reuse that for one TTL. Here all requests of a run are worked through together, so it has to be found
out first which of them compute. Per key that is the chain of misses of ``replay_reuse``; but a symbol that yields
nothing to store (no news, an exhausted request) opens no window, and whether it does depends on which symbols
of its request are misses at all.

So the choice is made, tried and made again. First every computing symbol is taken to succeed. Where one did not,
all symbols of its key compute once, so that the outcome of each is known, and the chain is drawn again through those
that succeed. Requests whose computing symbols changed by that are computed again, until none changes. The answers are then
those of the one-after-another rule: the earliest request of a run has no choice, and each round settles at least the next
one. Where every ticker has news, which is the rule, the first choice stands and nothing is computed twice.

At one instant, results computed serve all requests of that instant; of those that could compute it the one with the
smallest id does. Every round is landed, and only changed requests are computed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodwire.operators.resolve import storable_results
from moodwire.operators.reuse import replay_reuse, reuse
from moodwire.session import cut_lineage

ROW = ["request_id", "idx"]


@dataclass
class Outcome:
    """What computing some symbols gave; every part has ``request_id``."""

    routed: DataFrame
    local: DataFrame
    answered: DataFrame
    failed: DataFrame

    def parts(self) -> list[DataFrame]:
        return [self.routed, self.local, self.answered, self.failed]

    def landed(self) -> Outcome:
        return Outcome(*map(cut_lineage, self.parts()))

    def replaced(self, requests: DataFrame, by: Outcome) -> Outcome:
        """This outcome with that of ``requests`` taken from ``by``."""
        kept = [p.join(requests, "request_id", "left_anti") for p in self.parts()]
        return Outcome(*[a.unionByName(b) for a, b in zip(kept, by.parts())]).landed()

    def stored(self) -> DataFrame:
        """(request_id, idx, result): what is stored for reuse."""
        kept = storable_results(self.local, self.answered, self.routed, self.failed)
        values = [c for c in kept.columns if c not in ROW]
        return kept.select(*ROW, F.struct(*values).alias("result"))


Compute = Callable[[DataFrame], Outcome]


def computing(rows: DataFrame, ttl_s: int) -> DataFrame:
    """Those of ``rows`` (request_id, idx, cache_key, ts, succeeds) that must compute. Runs jobs.

    Rows that succeed open windows; rows that do not compute where no window is open.
    """
    opening = cut_lineage(replay_reuse(rows.where("succeeds"), ttl_s).where("not hit").drop("hit"))
    offers = opening.select("cache_key", F.col("ts").alias("computed_at"), F.struct("request_id").alias("result"))
    failing = reuse(rows.where("not succeeds"), offers, ttl_s).where("not hit").drop("hit", "reused")
    return cut_lineage(opening.unionByName(failing).select(*ROW))


def changed_requests(before: DataFrame, after: DataFrame) -> DataFrame:
    """Requests that do not compute the same symbols before and after."""
    one = before.select(*ROW, F.lit(1).alias("side")).unionByName(after.select(*ROW, F.lit(2).alias("side")))
    sides = one.groupBy(*ROW).agg(F.sum("side").alias("sides")).where("sides < 3")
    return cut_lineage(sides.select("request_id").distinct())


def share_run(asked: DataFrame, ttl_s: int, compute: Compute) -> tuple[DataFrame, Outcome]:
    """(asked with ``hit`` and ``reused``, outcome of what was computed). Runs jobs.

    ``asked`` has request_id, idx, cache_key, ts and whatever ``compute`` needs of a symbol; no stored result
    serves any of it. ``compute`` takes the symbols that compute, whole requests at a time.
    """
    key_rows = cut_lineage(asked.select(*ROW, "cache_key", "ts", F.lit(True).alias("succeeds")))
    chosen = computing(key_rows, ttl_s)
    outcome = compute(asked.join(chosen, ROW, "left_semi")).landed()
    known, spent = key_rows, cut_lineage(key_rows.select("cache_key").limit(0))
    while True:
        success = outcome.stored().select(*ROW, F.lit(True).alias("stored"))
        judged = chosen.join(success, ROW, "left").select(*ROW, F.coalesce("stored", F.lit(False)).alias("now"))
        known = cut_lineage(
            known.join(judged, ROW, "left").withColumn("succeeds", F.coalesce("now", "succeeds")).drop("now")
        )
        failing = known.join(chosen, ROW, "left_semi").where("not succeeds").select("cache_key").distinct()
        # Keys with a first failure: all their symbols compute once, so that the outcome of each is known.
        fresh = cut_lineage(failing.join(spent, "cache_key", "left_anti"))
        spent = cut_lineage(spent.unionByName(fresh))
        after = computing(known, ttl_s).join(known.select(*ROW, "cache_key"), ROW)
        speculative = known.join(fresh, "cache_key", "left_semi").select(*ROW)
        settled = after.join(fresh, "cache_key", "left_anti").select(*ROW)
        after = cut_lineage(settled.unionByName(speculative))
        moved = changed_requests(chosen, after)
        if moved.isEmpty():
            break
        mine = asked.join(after, ROW, "left_semi").join(moved, "request_id", "left_semi")
        outcome = outcome.replaced(moved, compute(mine))
        chosen = after
    offers = outcome.stored().join(key_rows, ROW).select("cache_key", F.col("ts").alias("computed_at"), "result")
    waiting = asked.join(chosen, ROW, "left_anti")
    served = reuse(waiting, offers, ttl_s)
    none = F.lit(None).cast(served.schema["reused"].dataType)
    own = asked.join(chosen, ROW, "left_semi").withColumns({"hit": F.lit(False), "reused": none})
    return cut_lineage(served.unionByName(own)), outcome
