"""Streams equal their batch twins on the same input."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from quarry.operators import findings as FD
from quarry.operators import rules as RU
from quarry.plans import q_rules
from quarry.plans import views as V
from quarry.session import shared_path
from quarry.streaming import jobs as ST
from tests.conftest import SF


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_stream_scan_equals_batch(spark):
    units = q_rules.code_units(spark, SF)
    src = shared_path(spark, "t-units")
    units.write.parquet(src)
    cols = ["uid", "pattern_id", "line", "severity", "confidence"]
    stream = ST.stream_scan(spark, src, "uid string, file_path string, start_line long, code string")
    assert _rows(stream, cols) == _rows(RU.scan_rules(units), cols)


def test_log_rollup_stream_matches_closed_windows(spark):
    logs = V.v_logs(spark, SF)
    src = shared_path(spark, "t-logs")
    logs.write.parquet(src)
    stream = ST.stream_log_rollup(spark, src, "entry_id long, job_id long, ts timestamp, level string, msg string")
    batch = ST.log_rollup(logs).select(F.unix_timestamp(F.col("w.start")).alias("window_start"), "level", "n")
    s, b = _rows(stream, ["window_start", "level", "n"]), _rows(batch, ["window_start", "level", "n"])
    end = logs.select(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()[0] - 3_600_000
    # windows that the watermark has not passed are not emitted in append mode
    assert s == [r for r in b if (r[0] + 600) * 1000 <= end] and len(s) < len(b)


def test_stream_verdicts_equal_batch(spark):
    units = q_rules.code_units(spark, SF)
    src = shared_path(spark, "t-units")
    units.write.parquet(src)
    cols = ["uid", "n_findings", "max_confidence", "max_severity"]
    stream = ST.stream_verdicts(spark, src, "uid string, file_path string, start_line long, code string")
    assert _rows(stream, cols) == _rows(FD.unit_verdict(RU.scan_rules(units)), cols)


def test_stream_dedup_within_watermark(spark):
    rows = [("a", "x  y", 0), ("b", "x y", 60), ("c", "z", 120)]
    df = spark.createDataFrame(rows, "id string, code string, sec long").withColumn("event_time", F.timestamp_seconds("sec"))
    src = shared_path(spark, "t-dedup")
    df.drop("sec").write.parquet(src)
    out = ST.stream_dedup(spark, src, "id string, code string, event_time timestamp", "1 hour")
    assert sorted(r.id for r in out.collect()) in (["a", "c"], ["b", "c"])


FINDINGS = "uid string, severity string, confidence double, event_time timestamp"


def _findings(spark, rows, src):
    df = spark.createDataFrame([(u, s, c, t, "x") for u, s, c, t in rows], "uid string, severity string, confidence double, sec long, n string")
    df.withColumn("event_time", F.timestamp_seconds(F.col("sec") + 1_000_000)).drop("sec").coalesce(1).write.mode("append").parquet(src)


def test_verdicts_over_several_files_and_a_restart(spark):
    src, at = shared_path(spark, "t-findings"), shared_path(spark, "t-job")
    _findings(spark, [("a", "LOW", 0.5, 0), ("a", "HIGH", 0.7, 60), ("b", "MEDIUM", None, 0), (None, "HIGH", 1.0, 0)], src)
    assert ST.stream_unit_verdicts(spark, src, FINDINGS, at=at).collect() == []  # no quiet yet
    _findings(spark, [("a", "MEDIUM", 0.9, 300), ("c", None, 0.1, 300)], src)
    _findings(spark, [("end", "LOW", 0.0, 10_000)], src)
    cols = ["uid", "n_findings", "max_confidence", "max_severity", "revision"]
    first = [("a", 3, 0.9, "HIGH", 1), ("b", 1, None, "MEDIUM", 1), ("c", 1, 0.1, None, 1)]
    assert {tuple(r) for r in ST.stream_unit_verdicts(spark, src, FINDINGS, at=at).select(*cols).collect()} == set(first)
    _findings(spark, [("a", "CRITICAL", 0.2, 10_100)], src)
    _findings(spark, [("end", "LOW", 0.0, 90_000)], src)
    out = ST.stream_unit_verdicts(spark, src, FINDINGS, at=at)
    assert {("a", 3, 0.9, "HIGH", 1), ("a", 4, 0.9, "CRITICAL", 2)} <= {tuple(r) for r in out.select(*cols).collect()}
    last = {r.uid: r for r in ST.last_verdicts(out).collect()}
    assert (last["a"].n_findings, last["a"].max_severity) == (4, "CRITICAL") and last["b"].n_findings == 1


def test_verdict_state_costs_few_calls_a_unit():
    class Handle:
        def __init__(self):
            self.value, self.calls = None, []

        def getValueState(self, name, schema):
            return self

        def __getattr__(self, name):
            def call(*args):
                self.calls.append(name)
                if name == "update":
                    self.value = args[0]
                return self.value if name == "get" else None

            return call

    h, v = Handle(), ST._Verdicts(600)
    v.init(h)
    row = lambda n, c, s, rank, latest: Row(n=n, confidence=c, severity=s, rank=rank, latest=latest)
    list(v.handleInputRows(("a",), iter([row(2, None, "LOW", 1, 50), row(1, 0.5, "HIGH", 3, 40)]), None))
    assert h.calls == ["get", "registerTimer", "update"] and h.value == (3, 0.5, "HIGH", 3, 0, 650)
    list(v.handleInputRows(("a",), iter([row(1, float("nan"), None, 0, 45)]), None))
    assert h.calls[3:] == ["get", "update"] and h.value == (4, 0.5, "HIGH", 3, 0, 650)  # the timer stands as it is
    assert [tuple(r) for r in v.handleExpiredTimer(("a",), None, None)] == [("a", 4, 0.5, "HIGH", 1)]
    assert h.value == (4, 0.5, "HIGH", 3, 1, 0)


def test_offsets_go_on_after_a_restart(spark):
    src, at = shared_path(spark, "t-logs"), shared_path(spark, "t-job")
    schema = "entry_id long, job_id long, ts timestamp, level string, msg string"

    def put(rows):
        df = spark.createDataFrame([(e, j, t, "INFO", "m") for e, j, t in rows], "entry_id long, job_id long, sec long, level string, msg string")
        df.withColumn("ts", F.timestamp_seconds("sec")).drop("sec").coalesce(1).write.mode("append").parquet(src)

    put([(2, 1, 10), (1, 1, 10), (3, 1, 5), (4, 2, 0), (5, None, 0)])
    ST.stream_log_offsets(spark, src, schema, at=at)
    put([(6, 1, 1), (7, 2, 1), (8, None, 9)])  # an entry that comes late gets the next number
    out = ST.stream_log_offsets(spark, src, schema, at=at)
    got = {(r.job_id, r.entry_id): r.offset for r in out.collect()}
    assert got == {(1, 3): 1, (1, 1): 2, (1, 2): 3, (1, 6): 4, (2, 4): 1, (2, 7): 2, (None, 5): 1, (None, 8): 2}
    assert {(r.job_id, r.entry_id, r.total) for r in ST.offsets_tail(out, 2).collect()} == {(1, 2, 4), (1, 6, 4)}


def test_exact_dedup_catches_late_duplicates(spark):
    src, at = shared_path(spark, "t-dedup"), shared_path(spark, "t-job")
    schema = "id string, code string, event_time timestamp"

    def put(rows):
        df = spark.createDataFrame(rows, "id string, code string, sec long").withColumn("event_time", F.timestamp_seconds("sec"))
        df.drop("sec").coalesce(1).write.mode("append").parquet(src)

    put([("a", "x  y", 5_000_000), ("b", "z", 0)])
    ST.stream_dedup_exact(spark, src, schema, at=at)
    put([("c", "x y", 0), ("d", "new", 0), ("e", "z ", 9_000_000), ("f", None, 0), ("g", None, 1)])
    out = ST.stream_dedup_exact(spark, src, schema, at=at)
    ids = sorted(r.id for r in out.collect())
    assert ids in (["a", "b", "d", "f"], ["a", "b", "d", "g"])
