"""Telemetry queries, batch and streaming."""

from pyspark.sql import functions as F

from spotweave.operators import qc as Q
from spotweave.operators import reads as R
from spotweave.operators import telemetry as W
from spotweave.plans.bindings import BINDINGS
from spotweave.plans.registry import query
from spotweave.streaming import telemetry as S


def _stream(t, binding: str):
    """A binding over the events table read as a stream of files."""
    events = S.read_event_stream(t.spark, t.sf_dir, t.events.schema, pattern="events.parquet")
    if t.spark.conf.get("spark.sql.session.timeZone") != "UTC":
        t.spark.conf.set("spark.sql.session.timeZone", "UTC")
    return t.spark.sql(BINDINGS[binding], events=events)


@query(
    "run_status", "run_id:i status:s current_process:s percent:d4 elapsed_us:i",
    """with l as (select run_id, arg_max(status, (ts, event_id)) as status, arg_max(process, (ts, event_id)) as current_process,
                       arg_max(completed, (ts, event_id)) as completed, epoch_us(max(ts)) - epoch_us(min(ts)) as elapsed_us
                from {run_events} group by run_id)
       select run_id, status, current_process, 100.0 * completed / 50 as percent, elapsed_us from l""",
)
def run_status(t):
    return W.run_status(t.run_events)


_USAGE = """select run_id, date_trunc('day', ts) as window_start, sum(cpu_hours) as cpu_hours,
                   sum(memory_gb_hours) as memory_gb_hours, sum(cost) as cost from {run_events} group by all"""


@query("resource_usage", "run_id:i window_start:t cpu_hours:d4 memory_gb_hours:d4 cost:d5", _USAGE)
def resource_usage(t):
    return W.resource_usage(t.run_events, "1 day")


_PAIRS = """
    p as (select c.request_id, c.tool, c.ts as call_ts, arg_min(r.ts, r.ts) as result_ts, arg_min(r.success, r.ts) as success
          from {calls} c left join {results} r on r.request_id = c.request_id and r.ts >= c.ts
               and epoch_us(r.ts) - epoch_us(c.ts) <= 600 * 1000000 group by all),
    pairs as (select request_id, tool, call_ts, (epoch_us(result_ts) - epoch_us(call_ts)) / 1e6 as duration_seconds,
                     success, result_ts is not null as matched from p)"""
_PAIR_COLUMNS = "request_id:i tool:s call_ts:t duration_seconds:d6 success:b matched:b"


@query("pair_calls", _PAIR_COLUMNS, f"with {_PAIRS} select * from pairs")
def pair_calls(t):
    return W.pair_calls(t.calls, t.results, 600)


@query(
    "tool_metrics", "window_start:t tool:s requests:i requests_per_hour:d6 error_rate:d6 p50:d4 p95:d4 p99:d4",
    """select date_trunc('day', ts) as window_start, tool, count(*) as requests, count(*) / 24 as requests_per_hour,
              avg((not success)::int) as error_rate, quantile_cont(duration, 0.5) as p50, quantile_cont(duration, 0.95) as p95,
              quantile_cont(duration, 0.99) as p99 from {tool_events} group by all""",
)
def tool_metrics(t):
    return W.tool_metrics(t.tool_events, "1 day")


@query(
    "tool_metrics_sliding", "window_start:t tool:s requests:i error_rate:d6 mean_duration:d9",
    """with w as (select *, unnest(range(4)) as k from {tool_events}),
            s as (select make_timestamp((floor(epoch_us(ts) / 21600000000)::bigint - k) * 21600000000) as window_start, * from w)
       select window_start, tool, count(*) as requests, avg((not success)::int) as error_rate, avg(duration) as mean_duration
       from s group by window_start, tool""",
)
def tool_metrics_sliding(t):
    return W.tool_metrics_sliding(t.tool_events, 86400, 21600)


_SESSIONS = """
    o as (select user_id, ts, case when epoch_us(ts) - epoch_us(lag(ts) over w) <= 7200000000 then 0 else 1 end as fresh
          from {tool_events} window w as (partition by user_id order by ts)),
    n as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from o),
    sess as (select user_id, min(ts) as session_start, max(ts) as session_end, count(*) as events from n group by user_id, session),
    mark as (select date_trunc('milliseconds', max(ts)) - interval 1 hour as watermark from {tool_events})"""


@query(
    "sessions", "user_id:i session_start:t session_end:t events:i",
    f"with {_SESSIONS} select user_id, session_start, session_end, events from sess",
)
def sessions(t):
    return W.sessions(t.tool_events, 7200)


@query(
    "dedup_requests", "request_id:i event_id:i tool:s duration:d2",
    """select request_id, arg_min(event_id, (ts, event_id)) as event_id, arg_min(tool, (ts, event_id)) as tool,
              arg_min(duration, (ts, event_id)) as duration from {tool_events} group by request_id""",
)
def dedup_requests(t):
    return W.dedup_requests(t.tool_events, order=["ts", "event_id"])


@query(
    "late_events", "event_id:i arrival:i",
    """select event_id, arrival from (select *, max(epoch_us(ts)) over (order by arrival) as high from {arrivals})
       where epoch_us(ts) < high - 3600000000""",
)
def late_events(t):
    return W.late_events(t.arrivals, "arrival", 3600)


@query(
    "stuck_runs", "run_id:i last_event:t status:s silent_seconds:d3",
    """with l as (select run_id, max(ts) as last_event, arg_max(status, (ts, event_id)) as status from {run_events} group by run_id),
            n as (select max(epoch_us(ts)) as now from {run_events})
       select run_id, last_event, status, (now - epoch_us(last_event)) / 1e6 as silent_seconds from l cross join n
       where (now - epoch_us(last_event)) / 1e6 > 36000 and status not in ('completed', 'failed', 'cancelled')""",
)
def stuck_runs(t):
    return W.stuck_runs(t.run_events, 36000)


@query(
    "qc_report", "stage:s metric:s value:d6 status:s",
    """with m(stage, metric, value) as (
           select 'alignment', 'alignment_rate', (select count(*) filter (where nh >= 1) / count(*)
                  from (select read_id, max(nh) as nh from {alignments} group by read_id))
           union all select 'umi', 'umi_duplication', (select 1 - count(distinct (barcode, gene, umi)) / count(*) from {tagged_reads})
           union all select 'barcode', 'barcode_match',
                  (select avg((barcode in (select barcode from {known_spots}))::int) from {tagged_reads})
           union all select 'spots', 'qc_retention', (select count(*) filter (where n_reads >= 800 and n_genes >= 30 and mt <= 15) / count(*)
                  from (select spot_id, sum(count) as n_reads, count(distinct gene) as n_genes,
                        100.0 * sum(case when starts_with(gene, 'MT-') then count else 0 end) / sum(count) as mt from {expr} group by spot_id))
           union all select 'cells', 'confident_predictions', (select avg((confidence >= 0.7)::int) from {cells})),
       l(metric, pass_at, fail_at, up) as (values ('alignment_rate', 0.8, 0.6, true), ('umi_duplication', 0.1, 0.2, false),
           ('barcode_match', 0.95, 0.8, true), ('qc_retention', 0.8, 0.5, true), ('confident_predictions', 0.8, 0.6, true)),
       j as (select stage, metric, value, case when up and value >= pass_at or not up and value <= pass_at then 0
                 when up and value >= fail_at or not up and value <= fail_at then 1 else 2 end as sev from m join l using (metric))
       select stage, metric, value, ['PASS', 'WARN', 'FAIL'][sev + 1] as status from j
       union all select 'overall', 'all', null, ['PASS', 'WARN', 'FAIL'][max(sev) + 1] from j""",
)
def qc_report(t):
    row = lambda df, stage, metric, value: df.select(
        F.lit(stage).alias("stage"), F.lit(metric).alias("metric"), value.cast("double").alias("value")
    )
    return W.qc_report(
        [
            row(R.alignment_stats(t.alignments), "alignment", "alignment_rate", F.col("alignment_rate")),
            row(R.umi_duplication_rate(t.tagged_reads), "umi", "umi_duplication", F.col("duplication_rate")),
            row(R.match_barcodes(t.tagged_reads, t.known_spots), "barcode", "barcode_match", F.col("match_rate")),
            row(Q.qc_summary(Q.spot_metrics(t.expr), 800, 30, 15.0), "spots", "qc_retention", F.col("filtering_rate")),
            row(
                t.cells.agg(F.avg(F.when(F.col("confidence") >= 0.7, 1.0).otherwise(0.0)).alias("c")),
                "cells", "confident_predictions", F.col("c"),
            ),
        ]
    )


# ---- streams: what has left the watermark by the end of the data --------------------------------------------


@query(
    "tool_metrics_stream", "window_start:t tool:s requests:i error_rate:d6 p50:d4 p95:d4 p99:d4",
    """with mark as (select date_trunc('milliseconds', max(ts)) - interval 1 hour as watermark from {tool_events})
       select date_trunc('day', ts) as window_start, tool, count(*) as requests, avg((not success)::int) as error_rate,
              quantile_disc(duration, 0.5) as p50, quantile_disc(duration, 0.95) as p95, quantile_disc(duration, 0.99) as p99
       from {tool_events} cross join mark
       where date_trunc('day', ts) + interval 1 day <= watermark group by date_trunc('day', ts), tool""",
)
def tool_metrics_stream(t):
    return S.run_to_files(S.tool_metrics_stream(_stream(t, "tool_events"), "1 day"), "tool-metrics")


@query(
    "tool_metrics_sliding_stream", "window_start:t tool:s requests:i error_rate:d6",
    """with mark as (select date_trunc('milliseconds', max(ts)) - interval 1 hour as watermark from {tool_events}),
            w as (select *, unnest(range(4)) as k from {tool_events}),
            s as (select make_timestamp((floor(epoch_us(ts) / 21600000000)::bigint - k) * 21600000000) as window_start, * from w)
       select window_start, tool, count(*) as requests, avg((not success)::int) as error_rate
       from s cross join mark where window_start + interval 1 day <= watermark group by window_start, tool""",
)
def tool_metrics_sliding_stream(t):
    return S.run_to_files(S.tool_metrics_stream(_stream(t, "tool_events"), "1 day", "6 hours"), "tool-sliding")


@query(
    "resource_usage_stream", "run_id:i window_start:t cpu_hours:d4 cost:d5",
    f"""with mark as (select date_trunc('milliseconds', max(ts)) - interval 1 hour as watermark from {{run_events}}),
        u as ({_USAGE})
        select * from u cross join mark where window_start + interval 1 day <= watermark""",
)
def resource_usage_stream(t):
    return S.run_to_files(S.resource_usage_stream(_stream(t, "run_events")), "usage")


@query(
    "sessions_stream", "user_id:i session_start:t session_end:t events:i",
    f"""with {_SESSIONS} select user_id, session_start, session_end + interval 2 hours as session_end, events
        from sess cross join mark where session_end + interval 2 hours <= watermark""",
)
def sessions_stream(t):
    return S.run_to_files(S.sessions_stream(_stream(t, "tool_events"), "2 hours"), "sessions")


@query(
    "dedup_requests_stream", "request_id:i",
    "select distinct request_id from {tool_events}",
)
def dedup_requests_stream(t):
    return S.run_to_files(S.dedup_requests_stream(_stream(t, "tool_events").select("request_id", "ts")), "dedup")


@query(
    "pair_calls_stream", _PAIR_COLUMNS,
    f"""with {_PAIRS}, mark as (select date_trunc('milliseconds', greatest((select max(ts) from {{calls}}), (select max(ts) from {{results}})))
                                       - interval 1 hour as watermark)
        select pairs.* from pairs cross join mark where call_ts + interval 10 minutes < watermark""",
)
def pair_calls_stream(t):
    return S.run_to_files(S.pair_calls_stream(_stream(t, "calls"), _stream(t, "results"), within_seconds=600), "pairs")


@query(
    "stuck_runs_stream", "run_id:i last_event:t status:s",
    """with o as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over w) <= 36000000000 then 0 else 1 end as fresh
                  from {run_events} window w as (partition by run_id order by ts)),
            n as (select *, sum(fresh) over (partition by run_id order by ts rows unbounded preceding) as stretch from o),
            l as (select run_id, max(ts) as last_event, arg_max(status, (ts, event_id)) as status from n group by run_id, stretch),
            mark as (select date_trunc('milliseconds', max(ts)) - interval 1 hour as watermark from {run_events})
       select run_id, last_event, status from l cross join mark
       where last_event + interval 10 hours <= watermark and status not in ('completed', 'failed', 'cancelled')""",
)
def stuck_runs_stream(t):
    return S.run_to_files(S.stuck_runs_stream(_stream(t, "run_events"), "10 hours"), "stuck")
