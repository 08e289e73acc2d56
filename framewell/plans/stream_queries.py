"""Batch twins of the streaming jobs that keep state."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewell.operators import telemetry as T
from framewell.plans.registry import query, table
from framewell.streaming import lifecycle


@query("st2_job_state", r"""
with n as (select epoch_us(max(ts)) // 1000.0 - 48 * 3600000 as mark from events),
j as (select user_id, min(ts) filter (event_type = 'view') as queued_at, min(ts) filter (event_type = 'click') as started_at, min(ts) filter (event_type in ('purchase', 'error')) as finished_at,
  arg_min({'k': event_type, 'e': event_id, 'p': props}, (ts, event_id)) filter (event_type in ('purchase', 'error')) as fin, count(*) filter (event_type not in ('purchase', 'error')) as steps,
  arg_max(value, (ts, event_id)) filter (event_type not in ('purchase', 'error')) as last_value, max(ts) filter (event_type not in ('purchase', 'error')) as last from events group by user_id)
select user_id, queued_at, started_at, finished_at, case when fin.k = 'purchase' then 'succeeded' when fin.k = 'error' then 'failed' when epoch_us(last) // 1000 <= mark then 'stalled' else 'running' end as outcome,
  case when fin.k = 'error' then 'event ' || fin.e || ': ' || coalesce(regexp_replace(fin.p, '(https?://[^\s?"]+)\?[^\s"]*', '\1', 'g'), '') end as error, steps, last_value from j, n""")
def _(spark, d):
    return lifecycle.job_state_twin(table(spark, d, "events"))


_KEYED = """select *, coalesce('clip:' || clip, 'file:' || file, 'ord:' || event_id) as key from (select user_id, event_id, value, case when event_id % 3 = 0 then 'c' || event_id % 7 when event_id % 11 = 0 then '' end as clip, case when event_id % 3 = 1 then 'f' || event_id % 5 end as file from events)"""


@query("s8_step_upsert", f"with k as ({_KEYED.replace("coalesce('clip:' || clip", "coalesce('clip:' || nullif(clip, '')")}) select user_id, event_id, value, clip, file from (select *, row_number() over (partition by user_id, key order by event_id desc) as n from k) where n = 1")
def _(spark, d):
    i = F.col("event_id")
    clip = F.when(i % 3 == 0, F.concat(F.lit("c"), (i % 7).cast("string"))).when(i % 11 == 0, "")
    rows = table(spark, d, "events").select("user_id", "event_id", "value", clip.alias("clip"), F.when(i % 3 == 1, F.concat(F.lit("f"), (i % 5).cast("string"))).alias("file"))
    return T.upsert(rows.where(i % 2 == 0), rows.where(i % 2 == 1), "user_id", "event_id")
