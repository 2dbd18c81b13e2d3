"""Images, cells, sequences, telemetry in batch and as streams."""

import math
import random
from datetime import datetime, timedelta

import pytest

from spotweave.operators import cells as K
from spotweave.operators import imaging as I
from spotweave.operators import telemetry as W
from spotweave.streaming import telemetry as S

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_image_lookup(spark):
    rows = [("i1", "H&E", 10.0), ("i2", "IF", 700.0), ("i3", "IHC", 5.0)]
    catalog = spark.createDataFrame(rows, "image_id string, stain_type string, file_size_mb double")
    assert [r.image_id for r in I.find_images(catalog, stain_type="he").collect()] == ["i1"]
    assert I.find_images(catalog, "i2", resolution="low").first().served_magnification == "10x"
    assert I.find_images(catalog, max_size_mb=500).count() == 2
    with pytest.raises(ValueError):
        I.find_images(catalog, stain_type="ihc")


def test_registration(spark):
    place = lambda x, y: (2 * x - y + 5, 0.5 * x + 3 * y - 1)
    marks = [("s", float(x), float(y), *place(x, y)) for x, y in ((0, 0), (10, 0), (0, 10), (7, 3))]
    turn = math.radians(30)
    spin = lambda x, y: (math.cos(turn) * x - math.sin(turn) * y + 4, math.sin(turn) * x + math.cos(turn) * y - 2)
    marks += [("r", float(x), float(y), *spin(x, y)) for x, y in ((0, 0), (10, 0), (0, 10), (7, 3))]
    marks += [("line", float(x), 0.0, float(x), 0.0) for x in range(3)]
    marks = [(m[0], *map(float, m[1:])) for m in marks]
    df = spark.createDataFrame(marks, "sample_id string, x double, y double, u double, v double")
    fit = {r.sample_id: r for r in I.fit_registration(df).collect()}
    assert set(fit) == {"s", "r"}  # points on a line fix no affine map
    assert [fit["s"].a, fit["s"].b, fit["s"].c, fit["s"].d] == pytest.approx([2, -1, 0.5, 3])
    assert (fit["s"].translation_x, fit["s"].translation_y) == pytest.approx((5, -1))
    rigid = {r.sample_id: r for r in I.fit_registration(df, "rigid").collect()}
    assert rigid["r"].rotation_degrees == pytest.approx(30) and rigid["r"].scale_x == pytest.approx(1)
    quality = {r.sample_id: r for r in I.registration_quality(df, I.fit_registration(df)).collect()}
    assert quality["s"].rmse < 1e-9 and quality["s"].passed and quality["s"].matched_points == 4
    assert quality["s"].correlation == pytest.approx(1)


def test_roi_features(spark):
    pixels = [("im", x, y, float((x + y) % 2)) for x in range(4) for y in range(4)]
    df = spark.createDataFrame(pixels, "image_id string, x int, y int, intensity double")
    rois = spark.createDataFrame([("im", "all", 0, 0, 3, 3), ("im", "row", 0, 0, 3, 0)], "image_id string, roi_id string, x1 int, y1 int, x2 int, y2 int")
    tone = {r.roi_id: r for r in I.image_features(df, rois).collect()}
    assert (tone["all"].pixels, tone["all"].mean, tone["all"].p50) == (16, 0.5, 0.5)
    texture = {r.roi_id: r for r in I.image_features(df, rois, "texture", low=0.0, high=2.0, levels=2).collect()}
    assert (texture["all"].pairs, texture["all"].contrast, texture["all"].energy) == (12, 1.0, 0.5)
    assert texture["all"].homogeneity == 0.5 and texture["all"].correlation == pytest.approx(-1)
    shape = {r.roi_id: r for r in I.image_features(df, rois, "morphology", threshold=0.5).collect()}
    assert (shape["all"].area, shape["all"].centroid_x) == (8, 1.5)
    assert shape["row"].minor_axis == 0.0
    with pytest.raises(ValueError):
        I.image_features(df, rois, "colour")


def test_cells(spark):
    cells = spark.createDataFrame([(1, 100.0, 0.9), (2, 99.9, 0.8), (3, 300.0, 0.7)], "cell_id long, area double, confidence double")
    assert K.filter_cells(cells).count() == 2
    s = K.cell_summary(cells).first()
    assert (s.cells_detected, s.mean_cell_area, s.cells_filtered) == (2, 200.0, 1)
    assert s.mean_confidence == pytest.approx(0.8)
    marks = spark.createDataFrame([("proliferating", "MKI67"), ("proliferating", "PCNA"), ("quiescent", "CDKN1B")], "label string, gene string")
    expr = spark.createDataFrame([(1, "MKI67", 7), (1, "CDKN1B", 1), (3, "OTHER", 5), (2, "CDKN1B", 9)], "cell_id long, gene string, count long")
    got = {r.cell_id: r for r in K.classify_cell_states(K.filter_cells(cells), expr, marks).collect()}
    assert set(got) == {1, 3}
    up, down = math.log(8) / 2, math.log(2)
    assert got[1].state == "proliferating" and got[1].confidence == pytest.approx(math.exp(up) / (math.exp(up) + math.exp(down)))
    assert got[3].state == "proliferating" and got[3].confidence == pytest.approx(0.5)
    types = K.predict_cell_type(expr, marks)
    assert tuple(K.cell_type_summary(types).first()) == (3, 2)
    report = {r.cell_type: (r.cells, r.low_confidence) for r in K.cell_type_report(types).collect()}
    assert report == {"proliferating": (2, 2), "quiescent": (1, 0)}
    assert K.low_confidence_cells(types).count() == 2


def test_boundaries(spark):
    shape = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    polygons = spark.createDataFrame([("c1", [{"x": x, "y": y} for x, y in shape])], "polygon_id string, vertices array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 3.0), (3, 9.0, 9.0)], "p long, x double, y double")
    assert [(r.p, r.polygon_id) for r in K.cells_in_boundary(points, polygons).collect()] == [(1, "c1")]


def test_sequences(spark):
    seqs = spark.createDataFrame([("a", "ACGTACGT"), ("b", "AC"), ("c", "AAAA")], "seq_id string, sequence string")
    got = {(r.seq_id, r.kmer): r.n for r in K.kmer_counts(seqs, 3).collect()}
    assert got == {("a", "ACG"): 2, ("a", "CGT"): 2, ("a", "GTA"): 1, ("a", "TAC"): 1, ("c", "AAA"): 2}
    emb = {r.seq_id: r.embedding for r in K.embed_sequences(seqs, dim=16, k=3).collect()}
    assert {k: (len(v), sum(v)) for k, v in emb.items()} == {"a": (16, 6.0), "b": (16, 0.0), "c": (16, 2.0)}


def test_platforms(spark):
    a = spark.createDataFrame([("A", 1.0), ("A", 3.0), ("B", 4.0), ("C", 9.0)], "gene string, value double")
    b = spark.createDataFrame([("A", 20.0), ("B", 40.0), ("D", 1.0)], "gene string, value double")
    r = K.platform_correlation(a, b).first()
    assert (r.shared_genes, r.passed) == (2, True)


RUNS = "run_id string, event_id long, ts timestamp, status string, process string, completed long, total long, cpu_hours double, memory_gb_hours double, cost double"


def runs(spark):
    rows = [
        ("r1", 1, at(0), "running", "align", 1, 4, 1.0, 2.0, 0.5), ("r1", 2, at(50), "running", "sort", 2, 4, 1.5, 2.0, 0.5),
        ("r2", 3, at(10), "running", "align", 0, 0, 0.0, 0.0, 0.0), ("r2", 4, at(90000), "completed", "done", 1, 1, 1.0, 1.0, 1.0),
    ]
    return spark.createDataFrame(rows, RUNS)


def test_run_tables(spark):
    got = {r.run_id: r for r in W.run_status(runs(spark)).collect()}
    assert (got["r1"].status, got["r1"].current_process, got["r1"].percent, got["r1"].elapsed_us) == ("running", "sort", 50.0, 50_000_000)
    usage = {(r.run_id, r.window_start): r.cpu_hours for r in W.resource_usage(runs(spark)).collect()}
    assert usage == {("r1", T0): 2.5, ("r2", T0): 0.0, ("r2", T0 + timedelta(days=1)): 1.0}
    assert [r.run_id for r in W.stuck_runs(runs(spark), 3600).collect()] == ["r1"]
    assert W.stuck_runs(runs(spark), 3600, as_of=at(100)).count() == 0


def test_pairs_and_retries(spark):
    calls = spark.createDataFrame([("a", "t", at(0)), ("a", "t", at(1)), ("b", "t", at(0)), ("c", "t", at(0))], "request_id string, tool string, ts timestamp")
    results = spark.createDataFrame([("a", at(5), True), ("a", at(3), False), ("b", at(9999), True)], "request_id string, ts timestamp, success boolean")
    got = {r.request_id: (r.duration_seconds, r.success, r.matched) for r in W.pair_calls(calls, results, 60).collect()}
    assert got == {"a": (3.0, False, True), "b": (None, None, False), "c": (None, None, False)}
    kept = W.dedup_requests(calls).orderBy("request_id").collect()
    assert [(r.request_id, r.ts) for r in kept] == [("a", at(0)), ("b", at(0)), ("c", at(0))]


TOOLS = "request_id long, tool string, user_id long, ts timestamp, duration double, success boolean"


def test_tool_tables(spark):
    rows = [(i, "t", 1, at(i * 3600), float(i), i % 4 != 0) for i in range(24)]
    df = spark.createDataFrame(rows, TOOLS)
    got = W.tool_metrics(df).first()
    assert (got.requests, got.requests_per_hour, got.error_rate, got.p50) == (24, 1.0, 0.25, 11.5)
    assert got.p95 == pytest.approx(21.85)
    slides = {r.window_start: (r.requests, r.mean_duration) for r in W.tool_metrics_sliding(df, 43200, 21600).collect()}
    assert slides[T0] == (12, 5.5) and slides[T0 - timedelta(hours=6)] == (6, 2.5) and len(slides) == 5
    with pytest.raises(ValueError):
        W.tool_metrics_sliding(df, 100, 30)


def test_sessions(spark):
    rng = random.Random(15)
    times = {u: sorted(rng.randrange(0, 200_000) for _ in range(120)) for u in (1, 2)}
    times[2] += [200_000 + i for i in range(300)]  # a busy user
    rows = [(0, "t", u, at(s), 1.0, True) for u, ss in times.items() for s in ss]
    got = {(r.user_id, r.session_start, r.session_end, r.events) for r in W.sessions(spark.createDataFrame(rows, TOOLS), 900).collect()}
    want = set()
    for u, ss in times.items():
        run = [ss[0]]
        for s in ss[1:] + [None]:
            if s is None or s - run[-1] > 900:
                want.add((u, at(run[0]), at(run[-1]), len(run)))
                run = []
            run.append(s)
    assert got == want


def test_late_events(spark):
    df = spark.createDataFrame([(1, at(100)), (2, at(500)), (3, at(390)), (4, at(450)), (5, at(399))], "n long, ts timestamp")
    assert {r.n for r in W.late_events(df, "n", 100).collect()} == {3, 5}


def test_qc_report(spark):
    m = spark.createDataFrame([("reads", "mean_phred", 31.0), ("umi", "umi_duplication", 0.15), ("x", "alignment_rate", 0.9)], "stage string, metric string, value double")
    got = {r.stage: r.status for r in W.qc_report(m).collect()}
    assert got == {"reads": "PASS", "umi": "WARN", "x": "PASS", "overall": "WARN"}
    bad = spark.createDataFrame([("b", "barcode_match", None)], "stage string, metric string, value double")
    assert {r.stage: r.status for r in W.qc_report([m, bad]).collect()}["overall"] == "FAIL"


def stream(spark, tmp_path, name, batches, schema):
    """A folder with one file per micro-batch, read one file at a time in order of arrival."""
    import os

    folder = tmp_path / name
    folder.mkdir()
    for i, rows in enumerate(batches):
        part = tmp_path / f"{name}-{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(part))
        source = next(part.glob("*.parquet"))
        os.utime(source, (1_700_000_000 + i, 1_700_000_000 + i))
        os.link(source, folder / f"{i}.parquet")
    return S.read_event_stream(spark, str(folder), spark.createDataFrame([], schema).schema, files_per_batch=1)


def test_streamed_metrics_drop_late_rows(spark, tmp_path):
    batches = [
        [(1, "t", 1, at(10), 1.0, True), (2, "t", 1, at(20), 3.0, False)],
        [(3, "t", 1, at(10_000), 5.0, True)],
        [(6, "t", 1, at(10_001), 5.0, True)],
        [(4, "t", 1, at(30), 9.0, True), (5, "t", 1, at(20_000), 2.0, True)],  # request 4 comes too late
    ]
    out = S.run_to_files(S.tool_metrics_stream(stream(spark, tmp_path, "m", batches, TOOLS), "1 hour", delay="10 minutes"), "t")
    got = {r.window_start: (r.requests, r.error_rate) for r in out.collect()}
    assert got[T0] == (2, 0.5) and at(20_000).replace(minute=0, second=0) not in got


def test_streamed_retries(spark, tmp_path):
    batches = [[(1, "t", 1, at(0), 1.0, True), (1, "t", 1, at(1), 1.0, True)], [(1, "t", 1, at(2), 1.0, True), (2, "t", 1, at(3), 1.0, True)]]
    out = S.run_to_files(S.dedup_requests_stream(stream(spark, tmp_path, "d", batches, TOOLS)), "d")
    assert sorted(r.request_id for r in out.collect()) == [1, 2]


CALLS, RESULTS = "request_id string, tool string, ts timestamp", "request_id string, ts timestamp, success boolean"


def test_streamed_pairs(spark, tmp_path):
    calls = stream(spark, tmp_path, "c", [[("a", "t", at(0)), ("b", "t", at(1))], [("z", "t", at(90_000))], [("y", "t", at(90_100))]], CALLS)
    results = stream(spark, tmp_path, "r", [[("a", at(30), True)], [("z", at(90_002), False)], [("q", at(90_200), True)]], RESULTS)
    got = {r.request_id: (r.duration_seconds, r.matched) for r in S.run_to_files(S.pair_calls_stream(calls, results, 60, "1 minute"), "p").collect()}
    assert got == {"a": (30.0, True), "b": (None, False), "z": (2.0, True)}  # y may still be answered


def test_streamed_pairs_equal_the_batch(spark, tmp_path):
    """Retries, floods of answers, answers before their calls, and rows that come late, over several micro-batches."""
    rng = random.Random(12)
    calls, results = [], []
    for i in range(60):
        first = rng.randrange(0, 3000)
        calls += [(f"r{i}", rng.choice("st"), at(first + 400 * n)) for n in range(rng.choice([1, 1, 2, 3]))]
        results += [(f"r{i}", at(first + rng.randrange(-50, 200)), rng.random() < 0.5) for _ in range(rng.choice([0, 1, 1, 3, 8]))]
    results += [("nobody", at(100), True), ("r0", at(9_000), True)]
    end = [("end", "t", at(40_000))]
    rng.shuffle(calls)
    rng.shuffle(results)
    batches = lambda rows, tail: [rows[k::4] for k in range(4)] + [tail]
    streamed = S.pair_calls_stream(
        stream(spark, tmp_path, "bc", batches(calls, end), CALLS), stream(spark, tmp_path, "br", batches(results, [("end", at(40_001), True)]), RESULTS), 120, "4 hours"
    )
    got = sorted(map(tuple, S.run_to_files(streamed, "bp").collect()))
    whole = W.pair_calls(spark.createDataFrame(calls + end, CALLS), spark.createDataFrame(results, RESULTS), 120).where("request_id <> 'end'")
    columns = ["request_id", "tool", "call_ts", "duration_seconds", "success", "matched"]
    assert got == sorted(map(tuple, whole.select(*columns).collect())) and len(got) == 60


def test_streamed_sessions_and_stalls(spark, tmp_path):
    tools = [[(i, "t", 1, at(s), 1.0, True) for i, s in enumerate((0, 100, 5000))], [(9, "t", 2, at(50_000), 1.0, True)]]
    got = S.run_to_files(S.sessions_stream(stream(spark, tmp_path, "s", tools, TOOLS), "10 minutes", "1 minute"), "s").collect()
    assert {(r.user_id, r.session_start, r.events) for r in got} == {(1, at(0), 2), (1, at(5000), 1)}
    row = lambda r, e, s, status: (r, e, at(s), status, "p", 1, 2, 0.0, 0.0, 0.0)
    events = [[row("ok", 1, 0, "running"), row("ok", 2, 60, "completed"), row("hung", 3, 5, "running")], [row("new", 4, 90_000, "running")]]
    got = S.run_to_files(S.stuck_runs_stream(stream(spark, tmp_path, "k", events, RUNS), "1 hour", "1 minute"), "k").collect()
    assert [(r.run_id, r.last_event) for r in got] == [("hung", at(5))]
    usage = S.run_to_files(S.resource_usage_stream(stream(spark, tmp_path, "u", events, RUNS), "1 hour", "1 minute"), "u")
    assert {r.run_id for r in usage.collect()} == {"ok", "hung"}


def test_stream_pairs_many_requests_at_a_time(spark, monkeypatch, tmp_path):
    """Request ids share state rows, so the number of calls of the handler doesn't follow the number of ids."""
    monkeypatch.setattr(S, "PAIR_GROUPS", 1)
    log = tmp_path / "calls"
    plain = S._first_answers

    def noted(*bounds):
        handle = plain(*bounds)

        def count(key, frames, state):
            with open(log, "a") as out:
                out.write("x")
            yield from handle(key, frames, state)

        return count

    monkeypatch.setattr(S, "_first_answers", noted)
    at = lambda s: f"timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, {s})"
    folder = str(tmp_path / "in")
    spark.sql(f"select id as request_id, 't' as tool, {at('id')} as ts from range(300) union all select 999, 'end', {at('99999')}").write.parquet(folder + "/calls")
    spark.sql(f"select id as request_id, {at('id + id % 90')} as ts, id % 2 = 0 as success from range(300)").write.parquet(folder + "/results")
    stream = lambda name: S.read_event_stream(spark, f"{folder}/{name}", spark.read.parquet(f"{folder}/{name}").schema)
    got = {r.request_id: (r.duration_seconds, r.success) for r in S.run_to_files(S.pair_calls_stream(stream("calls"), stream("results"), 60, "1 minute"), "p").collect()}
    assert got == {i: (float(i % 90), i % 2 == 0) if i % 90 <= 60 else (None, None) for i in range(300)}
    assert len(log.read_text()) <= 10
