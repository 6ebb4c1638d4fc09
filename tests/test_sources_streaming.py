"""Decoders on small payloads, history pruning, and stream equal to batch."""

import json
import struct

import pytest

from tidemark.sources import decoders as D
from tidemark.sources import history
from tidemark.streaming import job


def bodies(spark, *payloads):
    return spark.createDataFrame([(json.dumps(p),) for p in payloads], "value string")


def test_otlp_metrics(spark):
    point = {"timeUnixNano": "1700000000000000000", "asInt": "7", "attributes": [{"key": "host", "value": {"stringValue": "b"}}]}
    hist = {"timeUnixNano": "1700000000000000000", "sum": 10.0, "count": "4"}
    body = {"resourceMetrics": [{"resource": {"attributes": [{"key": "host", "value": {"stringValue": "a"}}]}, "scopeMetrics": [{"metrics": [{"name": "m", "gauge": {"dataPoints": [point, {"asDouble": 1.0}]}}, {"name": "h", "histogram": {"dataPoints": [hist, {**hist, "count": "0"}]}}]}]}]}
    got = {r["metric"]: r for r in D.otlp_metrics(bodies(spark, body)).collect()}
    assert got["m"]["value"] == 7 and got["m"]["fields"] == {"host": "b"} and got["h"]["value"] == 2.5


def test_otlp_traces_need_a_service(spark):
    span = {"traceId": "t", "spanId": "s", "name": "n", "startTimeUnixNano": "1000000000", "endTimeUnixNano": "3000000000", "status": {"code": "STATUS_CODE_ERROR"}}
    named = {"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]}, "scopeSpans": [{"spans": [span]}]}
    (r,) = D.otlp_traces(bodies(spark, {"resourceSpans": [named, {"scopeSpans": [{"spans": [span]}]}]})).collect()
    assert (r["service"], r["error"], r["duration"]) == ("svc", True, 2.0)


def test_prometheus_and_loki(spark):
    prom = {"data": {"result": [{"metric": {"a": "b"}, "values": [[1700000000, "1.5"], [1700000060, "NaN"], [1700000120, "+Inf"]]}]}}
    assert [r["value"] for r in D.prometheus_range(bodies(spark, prom)).collect()] == [1.5]
    loki = {"data": {"result": [{"stream": {"app": "x"}, "values": [["1700000000000000000", "line"]]}]}}
    assert [r["message"] for r in D.loki_streams(bodies(spark, loki)).collect()] == ["line"]


def test_logpush_marks_bad_lines(spark, tmp_path):
    good = {"EdgeStartTimestamp": "2024-01-01T00:00:00Z", "ClientRequestMethod": "PUT", "ClientRequestHost": "shop.test", "ClientRequestPath": "/basket/90817/items?v=2", "EdgeResponseStatus": 0, "OriginResponseStatus": 503, "OriginResponseTime": 2500000, "SecurityAction": "block"}
    (tmp_path / "a.json").write_text("\n".join([json.dumps(good), json.dumps({**good, "EdgeStartTimestamp": "1704067200000000000"}), "", "{broken"]))
    got = D.logpush(spark, str(tmp_path / "a.json"))
    ok = got.filter("not skipped").collect()
    assert len(ok) == 2 and ok[0]["path"] == "/basket/:id/items" and ok[0]["time"] == ok[1]["time"] and got.filter("skipped").count() == 1
    assert (ok[0]["value"], ok[0]["status"], ok[0]["status_class"], ok[0]["origin_ms"], ok[0]["waf"]) == (1.0, "503", "5xx", 2.5, "block")
    assert D.logpush_lines(got).first()["message"] == "PUT shop.test/basket/:id/items 503"


def test_corpora(spark, tmp_path):
    (tmp_path / "c" / "real").mkdir(parents=True)
    (tmp_path / "c" / "real" / "a.csv").write_text("timestamp,value\n2024-01-01 00:00:00,1.5\n2024-01-01 00:05:00,2.5\n")
    (tmp_path / "w.json").write_text(json.dumps({"real/a.csv": [["2024-01-01 00:04:00.000000", "2024-01-01 00:06:00.000000"]]}))
    got = D.labelled_csv(spark, str(tmp_path / "c"), str(tmp_path / "w.json")).orderBy("idx").collect()
    assert [(r["key"], r["idx"], r["value"], r["label"]) for r in got] == [("real/a.csv", 0, 1.5, False), ("real/a.csv", 1, 2.5, True)]
    (tmp_path / "001_x_2_3_4.txt").write_text("1.0\n2.0\n3.0\n9.0\n9.5\n1.0\n")
    got = D.archive_series(spark, str(tmp_path)).orderBy("idx").collect()
    assert [r["label"] for r in got] == [False, False, False, True, True, False] and sum(r["train"] for r in got) == 2
    (tmp_path / "h.csv").write_text("host,cpu,mem\na,1,2\nb,3.5,\n")
    rows, numeric, labels = D.csv_outliers(spark, str(tmp_path / "h.csv"))
    assert numeric == ["cpu", "mem"] and labels == ["host"] and rows.filter("mem is null").count() == 1


def test_remote_write(spark):
    field = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    label = lambda k, v: field(1, field(1, k.encode()) + field(2, v.encode()))
    sample = field(2, bytes([1 << 3 | 1]) + struct.pack("<d", 2.5) + bytes([2 << 3, 5]))
    raw = field(1, label("__name__", "up") + label("job", "x") + sample)
    block = bytes([len(raw), (len(raw) - 1) << 2 if len(raw) <= 60 else 60 << 2]) + (b"" if len(raw) <= 60 else bytes([len(raw) - 1])) + raw
    assert D.snappy_decode(block) == raw
    assert D.snappy_decode(bytes([8, 0 << 2]) + b"a" + bytes([(7 - 4) << 2 | 1, 1])) == b"a" * 8
    df = spark.createDataFrame([(block,), (b"\xff\xff",), (b"",)], "content binary")
    (r,) = D.remote_write(df).collect()
    assert (r["metric"], r["value"], r["time_ms"], r["fields"]) == ("up", 2.5, 5, {"job": "x"})
    with pytest.raises(ValueError):
        D.snappy_decode(bytes([200, 200, 200, 200, 15]))


def test_history(spark, tmp_path):
    rec = spark.createDataFrame([("a b", 0, 1.0), ("a b", 90_000, 2.0), ("c", 10, 3.0)], "job string, bucket long, score double")
    history.append(rec, str(tmp_path / "h"))
    for name in ("a_b", "a b"):
        got = history.query(spark, str(tmp_path / "h"), name, 0, 86_399)
        assert [r["score"] for r in got.collect()] == [1.0]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"s{i % 2}", i * 60, 100.0 + (i * 7) % 13 + (400 if i == 90 else 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "series string, bucket long, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = job.score(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda d: sorted((r["series"], r["bucket"], round(r["score"], 9)) for r in d.collect())
    assert key(spark.table("scored")) == key(job.score_batch(df))
    assert max(r["score"] for r in spark.table("scored").collect()) > 50
