"""Run and tool telemetry in batch (W1-W8); ``streaming.telemetry`` holds the same as streams.

Run events: ``run_id, ts, status, process, completed, total, cpu_hours, memory_gb_hours, cost``.
Tool events: ``request_id, tool, user_id, ts, duration, success``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotweave import fixed_values as fv
from spotweave.functions.checks import in_range, need_columns
from spotweave.functions.running import exact_quantiles, running

TERMINAL = ("completed", "failed", "cancelled")


def run_status(events: DataFrame) -> DataFrame:
    """W1. Latest state per run, percent done, and seconds between first and last event."""
    latest = F.max_by(F.struct("status", "process", "completed", "total"), F.struct("ts", "event_id"))
    rows = events.groupBy("run_id").agg(
        latest.alias("l"), F.min("ts").alias("started"), F.max("ts").alias("last_event")
    )
    return rows.select(
        "run_id", "l.status", F.col("l.process").alias("current_process"),
        F.coalesce(F.lit(100.0) * F.col("l.completed") / F.nullif("l.total", F.lit(0)), F.lit(0.0)).alias("percent"),
        (F.unix_micros("last_event") - F.unix_micros("started")).alias("elapsed_us"),
    )


def resource_usage(events: DataFrame, width: str = "1 day") -> DataFrame:
    """W2. CPU hours, memory GB-hours and cost per run and window."""
    return events.groupBy("run_id", F.window("ts", width).alias("w")).agg(
        F.sum("cpu_hours").alias("cpu_hours"),
        F.sum("memory_gb_hours").alias("memory_gb_hours"),
        F.sum("cost").alias("cost"),
    ).select("run_id", F.col("w.start").alias("window_start"), "cpu_hours", "memory_gb_hours", "cost")


def pair_calls(calls: DataFrame, results: DataFrame, within_seconds: int = 3600) -> DataFrame:
    """W3. Every call with its first result inside the time bound, if any; retried calls count once."""
    in_range("within_seconds", within_seconds, 0)
    first_calls = calls.groupBy("request_id").agg(F.min_by(F.struct("tool", "ts"), "ts").alias("c")).select(
        "request_id", F.col("c.tool").alias("tool"), F.col("c.ts").alias("call_ts")
    )
    answers = results.select("request_id", F.col("ts").alias("result_ts"), "success")
    late = (F.col("result_ts") < F.col("call_ts")) | (
        F.unix_micros("result_ts") - F.unix_micros("call_ts") > within_seconds * 1_000_000
    )
    # an inner join first: Spark can split a request id with a flood of results there, and the first answers
    # are one row per request when they are put beside all calls
    firsts = (
        answers.join(first_calls.select("request_id", "call_ts"), "request_id")
        .where(~late)
        .groupBy("request_id")
        .agg(F.min(F.struct("result_ts", "success")).alias("r"))
    )
    return first_calls.join(firsts, "request_id", "left").select(
        "request_id", "tool", "call_ts",
        ((F.unix_micros("r.result_ts") - F.unix_micros("call_ts")) / 1e6).alias("duration_seconds"),
        "r.success",
        F.col("r").isNotNull().alias("matched"),
    )


def tool_metrics(events: DataFrame, width: str = "1 day") -> DataFrame:
    """W4. Requests, rate per hour, error rate and exact p50/p95/p99 per tool and tumbling window."""
    rows = events.withColumn("_w", F.window("ts", width)).select(
        F.col("_w.start").alias("window_start"),
        (F.unix_seconds("_w.end") - F.unix_seconds("_w.start")).alias("_len"),
        "tool", "duration", "success",
    )
    counts = rows.groupBy("window_start", "tool").agg(
        F.count("*").alias("requests"),
        (F.count("*") / (F.max("_len") / 3600)).alias("requests_per_hour"),
        F.avg(F.when(F.col("success"), 0.0).otherwise(1.0)).alias("error_rate"),
    )
    tails = exact_quantiles(rows, ["window_start", "tool"], "duration", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return counts.join(tails, ["window_start", "tool"], "left")


def tool_metrics_sliding(events: DataFrame, width_seconds: int = 86400, slide_seconds: int = 21600) -> DataFrame:
    """W5. Requests, error rate and mean duration over sliding windows.

    Rows are added up per slide first and the sums are copied into the windows that cover them, instead of
    every row being copied width/slide times.
    """
    in_range("slide_seconds", slide_seconds, 1, width_seconds)
    if width_seconds % slide_seconds:
        raise ValueError("the width must be a multiple of the slide")
    steps = width_seconds // slide_seconds
    slot = F.floor(F.unix_seconds("ts") / slide_seconds)
    slots = events.groupBy(slot.alias("slot"), "tool").agg(
        F.count("*").alias("n"), F.count_if(~F.col("success")).alias("bad"),
        F.sum("duration").alias("total"), F.count("duration").alias("timed"),
    )
    spread = slots.withColumn("w", F.explode(F.sequence(F.col("slot") - (steps - 1), F.col("slot"))))
    return spread.groupBy("w", "tool").agg(
        F.sum("n").alias("requests"),
        (F.sum("bad") / F.sum("n")).alias("error_rate"),
        (F.sum("total") / F.nullif(F.sum("timed"), F.lit(0))).alias("mean_duration"),
    ).select(F.timestamp_seconds(F.col("w") * slide_seconds).alias("window_start"), "tool", "requests", "error_rate", "mean_duration")


def sessions(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """W5. Per-user sessions: a pause of more than the gap starts a new one.

    Events of one user inside one gap-long slot always share a session, so they merge before the window,
    which then holds at most time span / gap rows per user, however busy the user is.
    """
    in_range("gap_seconds", gap_seconds, 1)
    gap = gap_seconds * 1_000_000
    us = F.unix_micros("ts")
    slots = events.groupBy("user_id", F.floor(us / gap).alias("slot")).agg(
        F.min(us).alias("lo"), F.max(us).alias("hi"), F.count("*").alias("n")
    )
    order = Window.partitionBy("user_id").orderBy("slot")
    pause = F.col("lo") - F.lag("hi").over(order)
    marked = slots.withColumn("_new", F.when(pause <= gap, 0).otherwise(1))
    numbered = marked.withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(
        F.timestamp_micros(F.min("lo")).alias("session_start"),
        F.timestamp_micros(F.max("hi")).alias("session_end"),
        F.sum("n").alias("events"),
    )


def dedup_requests(events: DataFrame, key: str = "request_id", order: list[str] = ["ts"]) -> DataFrame:
    """W6. First event per request id, by aggregation: retries meet on the map side already."""
    rest = [c for c in events.columns if c != key]
    kept = events.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_e"))
    return kept.select(key, "_e.*").select(*events.columns)


def late_events(events: DataFrame, arrival: str, delay_seconds: int) -> DataFrame:
    """W6. Events older than the highest time seen up to their arrival minus the delay.

    ``arrival`` is the arrival number; events of one number arrive together. The running maximum is bucketed,
    not one window over everything.
    """
    in_range("delay_seconds", delay_seconds, 0)
    rows = events.withColumns({"_a": F.col(arrival), "_us": F.unix_micros("ts")})
    arrivals = rows.where("_a is not null").groupBy("_a").agg(F.max("_us").alias("_m"))
    seen = running(arrivals, [], "_a", {"_high": ("max", F.col("_m"))}).select("_a", "_high")
    late = rows.join(seen, "_a").where(F.col("_us") < F.col("_high") - delay_seconds * 1_000_000)
    return late.select(*events.columns)


def stuck_runs(events: DataFrame, timeout_seconds: int, as_of=None) -> DataFrame:
    """W7. Runs not finished whose last event is older than the timeout at ``as_of`` (default: last event)."""
    in_range("timeout_seconds", timeout_seconds, 0)
    now = F.unix_micros(F.lit(as_of).cast("timestamp")) if as_of is not None else (
        events.agg(F.max(F.unix_micros("ts")).alias("m")).scalar()
    )
    last = events.groupBy("run_id").agg(
        F.max("ts").alias("last_event"), F.max_by("status", F.struct("ts", "event_id")).alias("status")
    ).withColumn("_now", now)
    silent = (F.col("_now") - F.unix_micros("last_event")) / 1e6
    return last.withColumn("silent_seconds", silent).where(
        (F.col("silent_seconds") > timeout_seconds) & ~F.col("status").isin(*TERMINAL)
    ).drop("_now")


def threshold_table(spark) -> DataFrame:
    return spark.createDataFrame(
        list(fv.QC_THRESHOLDS), "metric string, pass_at double, fail_at double, higher_is_better boolean"
    )


def qc_report(metrics: DataFrame | list[DataFrame], thresholds: DataFrame | None = None) -> DataFrame:
    """W8. PASS, WARN or FAIL per stage metric, plus an ``overall`` row with the worst of them.

    ``metrics`` is ``stage, metric, value``, one row per metric (or several such frames).
    """
    frames = [metrics] if isinstance(metrics, DataFrame) else list(metrics)
    rows = reduce(lambda a, b: a.unionByName(b), frames)
    need_columns(rows, "stage", "metric", "value")
    limits = thresholds if thresholds is not None else threshold_table(rows.sparkSession)
    v = F.col("value")
    reaches = lambda bound: F.when(F.col("higher_is_better"), v >= F.col(bound)).otherwise(v <= F.col(bound))
    severity = F.when(v.isNull(), 2).when(reaches("pass_at"), 0).when(reaches("fail_at"), 1).otherwise(2)
    judged = rows.join(limits, "metric").select("stage", "metric", "value", severity.alias("severity"))
    overall = judged.agg(
        F.lit("overall").alias("stage"), F.lit("all").alias("metric"),
        F.lit(None).cast("double").alias("value"), F.coalesce(F.max("severity"), F.lit(2)).alias("severity"),
    )
    status = F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), F.col("severity") + 1)
    return judged.unionByName(overall).select("stage", "metric", "value", status.alias("status"))
