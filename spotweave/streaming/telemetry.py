"""Telemetry as Structured Streaming jobs (W3-W7). Each takes and returns a streaming DataFrame."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from spotweave.functions.checks import in_range
from spotweave.operators.telemetry import TERMINAL
from spotweave.session import fresh_path


def read_event_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files arriving in a folder, in bounded micro-batches."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def run_to_files(stream: DataFrame, label: str, output_mode: str = "append") -> DataFrame:
    """Process everything available into Parquet files in the shared folder, and read them back."""
    spark = stream.sparkSession
    out = fresh_path(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode(output_mode).option("path", out)
        .option("checkpointLocation", fresh_path(spark, f"{label}-checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def dedup_requests_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """W6. Retried request ids are dropped within the watermark; late rows fall away in later state."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id"])


def tool_metrics_stream(events: DataFrame, width: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """W4, W5. Per tool and closed window: requests, error rate, approximate percentiles."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    quantiles = F.percentile_approx("duration", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.lit(10000))
    return (
        events.withWatermark("ts", delay)
        .groupBy(window.alias("w"), "tool")
        .agg(
            F.count("*").alias("requests"),
            F.avg(F.when(F.col("success"), 0.0).otherwise(1.0)).alias("error_rate"),
            quantiles.alias("q"),
        )
        .select(
            F.col("w.start").alias("window_start"), "tool", "requests", "error_rate",
            F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"),
        )
    )


def sessions_stream(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """W5. Closed per-user sessions; the engine drops sessions that the watermark has passed."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("s"), "user_id")
        .agg(F.count("*").alias("events"))
        .select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")
    )


_PAIR_STATE = (
    "asked array<{id}>, call_us array<long>, tool array<string>, told array<boolean>, "
    "answered array<{id}>, result_us array<long>, success array<boolean>"
)
_PAIR_ROWS = "request_id {id}, tool string, call_us long, result_us long, success boolean"
PAIR_GROUPS = 1024  # groups of request ids that share a state row; fixed, as state outlives a run


def _in_milliseconds(us: pd.Series) -> pd.Series:
    return -(-us // 1000)


def _first_answers(within_us: int, retries_us: int):
    """State of a group of request ids: their first calls, whether these were told, and the results that may answer one."""

    def handle(key, frames, state):
        held = state.get if state.exists else ([], [], [], [], [], [], [])
        listed = lambda x: [] if x is None else list(x)
        calls = pd.DataFrame({"request_id": pd.Series(listed(held[0])), "call_us": pd.Series(listed(held[1]), dtype="int64"),
                              "tool": pd.Series(listed(held[2]), dtype=object), "told": pd.Series(listed(held[3]), dtype=bool)})
        results = pd.DataFrame({"request_id": pd.Series(listed(held[4])), "result_us": pd.Series(listed(held[5]), dtype="int64"),
                                "success": pd.Series(listed(held[6]), dtype=bool)})
        watermark = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            new_calls, new_results = [], []
            for rows in frames:
                mine = rows["is_call"].astype(bool)
                new_calls.append(rows[mine][["request_id", "us", "tool"]].rename(columns={"us": "call_us"}).assign(told=False))
                new_results.append(rows[~mine][["request_id", "us", "success"]].rename(columns={"us": "result_us"}))
            joined = lambda old, new: pd.concat([x for x in (old, *new) if len(x)], ignore_index=True) if len(old) or any(map(len, new)) else old
            calls, results = joined(calls, new_calls), joined(results, new_results)
            # a call that was told stays the first
            calls["_untold"] = ~calls["told"].astype(bool)
            calls["_name"] = calls["tool"].astype(str)
            calls = calls.sort_values(["_untold", "call_us", "_name"], kind="stable").drop_duplicates("request_id").drop(columns=["_untold", "_name"])
            # of results at one time a failure counts, as in a batch
            results["success"] = results["success"].fillna(False).astype(bool)
            results = results.sort_values(["result_us", "success"], kind="stable").drop_duplicates(["request_id", "result_us"])
        told = calls["told"].astype(bool)
        due = ~told & (_in_milliseconds(calls["call_us"] + within_us) < watermark)
        out = None
        if due.any():
            now = calls[due]
            met = now[["request_id", "call_us"]].merge(results, on="request_id") if len(results) else None
            if met is not None:
                met = met[(met["result_us"] >= met["call_us"]) & (met["result_us"] <= met["call_us"] + within_us)]
                met = met.sort_values("result_us", kind="stable").drop_duplicates("request_id").drop(columns="call_us")
                out = now[["request_id", "tool", "call_us"]].merge(met, on="request_id", how="left")
            else:
                out = now[["request_id", "tool", "call_us"]].assign(result_us=None, success=None)
            out = out.assign(result_us=out["result_us"].astype("Int64"), success=out["success"].astype("boolean"))
        calls = calls.assign(told=told | due)
        calls = calls[~calls["told"] | (_in_milliseconds(calls["call_us"] + retries_us) >= watermark)]
        if len(results):
            # results stay while their call can still come, or while one that isn't told waits for them
            waits = results["request_id"].isin(calls["request_id"][~calls["told"]])
            done = results["request_id"].isin(calls["request_id"][calls["told"]])
            results = results[~done & (waits | (_in_milliseconds(results["result_us"]) >= watermark))]
        if len(calls) or len(results):
            alarms = [_in_milliseconds((calls["call_us"] + calls["told"].map({True: retries_us, False: within_us}).astype("int64"))), _in_milliseconds(results["result_us"])]
            state.update((
                calls["request_id"].tolist(), calls["call_us"].astype("int64").tolist(), calls["tool"].tolist(), calls["told"].astype(bool).tolist(),
                results["request_id"].tolist(), results["result_us"].astype("int64").tolist(), results["success"].astype(bool).tolist(),
            ))
            state.setTimeoutTimestamp(max(int(min(x.min() for x in alarms if len(x))), watermark + 1))
        elif state.exists:
            state.remove()
        if out is not None:
            yield out

    return handle


def pair_calls_stream(
    calls: DataFrame, results: DataFrame, within_seconds: int = 3600, delay: str = "1 hour", retries_seconds: int = 86_400
) -> DataFrame:
    """W3. Every call with its first result inside the time bound, as the batch form gives them.

    A request is told once the watermark has passed its first call by the bound: by then no earlier call and no other answer
    can come. Groups of request ids share a state row, so that rows are handled many at a time. Calls tried again within ``retries_seconds`` of the first count with it. ``delay`` covers how far rows of both
    streams may be behind the newest row of either.
    """
    in_range("within_seconds", within_seconds, 0)
    in_range("retries_seconds", retries_seconds, within_seconds)
    none = lambda kind: F.lit(None).cast(kind)
    asked = calls.select("request_id", "tool", none("boolean").alias("success"), "ts", F.lit(True).alias("is_call"))
    answered = results.select("request_id", none("string").alias("tool"), "success", "ts", F.lit(False).alias("is_call"))
    rows = asked.unionByName(answered).where("request_id is not null and ts is not null").withWatermark("ts", delay)
    rows = rows.withColumn("us", F.unix_micros("ts"))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("request_id"), F.lit(PAIR_GROUPS)))
    kind = {"id": calls.schema["request_id"].dataType.simpleString()}
    told = rows.groupBy("group").applyInPandasWithState(
        _first_answers(within_seconds * 1_000_000, retries_seconds * 1_000_000),
        _PAIR_ROWS.format(**kind), _PAIR_STATE.format(**kind), "append", GroupStateTimeout.EventTimeTimeout,
    )
    return told.select(
        "request_id", "tool", F.timestamp_micros("call_us").alias("call_ts"),
        ((F.col("result_us") - F.col("call_us")) / 1e6).alias("duration_seconds"),
        "success",
        F.col("result_us").isNotNull().alias("matched"),
    )


def stuck_runs_stream(events: DataFrame, timeout: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """W7. A run is reported when the watermark has passed its last event by the timeout and that event did
    not end it. The built-in session window keeps one state row per open run and is its own timer.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", timeout).alias("s"), "run_id")
        .agg(F.max(F.struct("ts", "event_id", "status")).alias("last"))
        .where(~F.col("last.status").isin(*TERMINAL))
        .select("run_id", F.col("last.ts").alias("last_event"), F.col("last.status").alias("status"))
    )


def resource_usage_stream(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """W2. Usage per run and closed window."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "run_id")
        .agg(F.sum("cpu_hours").alias("cpu_hours"), F.sum("memory_gb_hours").alias("memory_gb_hours"), F.sum("cost").alias("cost"))
        .select("run_id", F.col("w.start").alias("window_start"), "cpu_hours", "memory_gb_hours", "cost")
    )
