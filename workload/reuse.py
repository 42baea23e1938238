"""Queries on result reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodwire.operators import reuse as U
from moodwire.session import new_scratch_path
from moodwire.sources import store
from workload import adapters as D
from workload.registry import Tables, query

TTL_S = 6 * 3600
TTL_US = TTL_S * 1_000_000


def prior_results(t: Tables):
    """A result computed one hour after each event."""
    return t.events.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("cache_key"),
        (F.col("ts") + F.expr("interval 1 hour")).alias("computed_at"),
        F.struct(F.col("event_id").alias("from_event")).alias("result"),
    )


REUSE = f"""
with asks as (select event_id, 'U' || user_id as k, epoch_us(ts) as t from events),
prior as (select event_id, 'U' || user_id as k, epoch_us(ts) + 3600000000 as t from events)
select a.event_id as event_id, coalesce(p.t > a.t - {TTL_US}, false) as hit,
  case when p.t > a.t - {TTL_US} then p.event_id else -1 end as from_event
from asks a asof left join prior p on a.k = p.k and a.t >= p.t"""


@query("j6_reuse_as_of", REUSE)
def reuse_as_of(t: Tables):
    asks = D.reuse_log(t).withColumn("event_id", F.col("request_id").cast("bigint"))
    found = U.reuse(asks, prior_results(t), TTL_S)
    return found.select(
        "event_id", "hit", F.coalesce("reused.from_event", F.lit(-1)).alias("from_event")
    )


@query(
    "c1_reuse_lookup",
    f"""
with found as ({REUSE})
select 'U' || user_id as cache_key, count(*) as lookups, count(*) filter (where hit) as hits
from found join events using (event_id) group by 1""",
)
def reuse_lookup(t: Tables):
    found = U.reuse(D.reuse_log(t), prior_results(t), TTL_S)
    return found.groupBy("cache_key").agg(
        F.count("*").alias("lookups"), F.count_if("hit").alias("hits")
    )


@query(
    "c2_newest_per_key",
    """
with results as (
  select 'U' || user_id as cache_key, event_id, epoch_us(ts) as computed_us,
    case event_type when 'click' then 'tier_1_local_onnx' when 'view' then 'tier_3_llm'
      else 'unavailable' end as tier from events)
select cache_key, max(computed_us) as computed_us,
  arg_max(event_id, row(computed_us, event_id)) as event_id
from results where tier <> 'unavailable' group by cache_key""",
)
def newest_per_key(t: Tables):
    return U.newest_per_key(tiered_results(t)).select(
        "cache_key",
        F.unix_micros("computed_at").alias("computed_us"),
        F.col("result.event_id").alias("event_id"),
    )


def tiered_results(t: Tables):
    tier = (
        F.when(F.col("event_type") == "click", "tier_1_local_onnx")
        .when(F.col("event_type") == "view", "tier_3_llm")
        .otherwise("unavailable")
    )
    return t.events.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("cache_key"),
        F.col("ts").alias("computed_at"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("request_id"),
        F.lit(0).alias("idx"),
        tier.alias("source_tier"),
        "event_id",
    )


@query(
    "c2_store_compacted",
    f"""
with results as (
  select 'U' || user_id as cache_key, event_id, epoch_us(ts) as t,
    case event_type when 'click' then 'tier_1_local_onnx' when 'view' then 'tier_3_llm' end as tier from events),
ends as (select max(t) as last from results)
select cache_key, max(t) as computed_us, arg_max(event_id, row(t, event_id)) as event_id, count(*) over () as stored
from results, ends where tier is not null and t > last - 20 * {TTL_US} group by cache_key""",
)
def store_compacted(t: Tables):
    """Two runs store their results, the store is compacted twice, and only living days are read back."""
    results = tiered_results(t)
    first, last = results.agg(F.min(F.unix_micros("computed_at")), F.max(F.unix_micros("computed_at"))).first()
    half = F.unix_micros("computed_at") < (first + last) // 2
    path, kind = new_scratch_path(t.spark, "store"), "struct<request_id:string,idx:int,source_tier:string,event_id:bigint>"
    for part in (results.where(half), results.where(~half)):
        store.append(part, path)
        store.compact(t.spark, path, kind, last, 20 * TTL_S)
    found = store.read(t.spark, path, kind, last - 20 * TTL_US)
    return found.select(
        "cache_key",
        F.unix_micros("computed_at").alias("computed_us"),
        F.col("result.event_id").alias("event_id"),
        F.lit(store.read(t.spark, path, kind).count()).cast("bigint").alias("stored"),
    )


@query(
    "c3_replay_hits",
    f"""
with recursive seq as materialized (
  select event_id, 'U' || user_id as k, epoch_us(ts) as t,
    row_number() over (partition by user_id order by ts, event_id) as rn from events),
fold as (
  select event_id, k, rn, t + {TTL_US} as e, false as hit from seq where rn = 1
  union all
  select s.event_id, s.k, s.rn, case when s.t < f.e then f.e else s.t + {TTL_US} end, s.t < f.e
  from fold f join seq s on s.k = f.k and s.rn = f.rn + 1)
select event_id, hit from fold""",
)
def replay_hits(t: Tables):
    return U.replay_reuse(D.reuse_log(t), TTL_S).select(
        F.col("request_id").cast("bigint").alias("event_id"), "hit"
    )


@query(
    "c4_replay_layers",
    f"""
with recursive seq as materialized (
  select event_id, 'U' || user_id as k, event_id % 3 as node, epoch_us(ts) as t,
    row_number() over (partition by user_id order by ts, event_id) as rn from events),
fold as (
  select event_id, k, rn,
    case when node = 0 then t + {TTL_US} else 0 end as m0,
    case when node = 1 then t + {TTL_US} else 0 end as m1,
    case when node = 2 then t + {TTL_US} else 0 end as m2,
    t + {TTL_US} as shared, 'miss' as layer from seq where rn = 1
  union all
  select event_id, k, rn,
    case when node = 0 and not live then t + {TTL_US} else m0 end,
    case when node = 1 and not live then t + {TTL_US} else m1 end,
    case when node = 2 and not live then t + {TTL_US} else m2 end,
    case when not live and t >= shared then t + {TTL_US} else shared end,
    case when live then 'memory' when t < shared then 'shared' else 'miss' end
  from (select s.*, f.m0, f.m1, f.m2, f.shared,
          s.t < case s.node when 0 then f.m0 when 1 then f.m1 else f.m2 end as live
        from fold f join seq s on s.k = f.k and s.rn = f.rn + 1))
select event_id, layer from fold""",
)
def replay_layers(t: Tables):
    return U.replay_layers(D.reuse_log(t), TTL_S).select(
        F.col("request_id").cast("bigint").alias("event_id"), "layer"
    )
