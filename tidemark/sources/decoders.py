"""Wire formats to points, log lines and spans. Text is parsed by Spark's JSON and CSV functions; only remote-write,
which is compressed protobuf, needs Python."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import normalise_path, parse_time, status_class

_KV = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>"
_NUMBER = f"struct<timeUnixNano:string,asDouble:double,asInt:string,sum:double,count:string,attributes:{_KV}>"
OTLP_METRICS = f"struct<resourceMetrics:array<struct<resource:struct<attributes:{_KV}>,scopeMetrics:array<struct<metrics:array<struct<name:string,gauge:struct<dataPoints:array<{_NUMBER}>>,sum:struct<dataPoints:array<{_NUMBER}>>,histogram:struct<dataPoints:array<{_NUMBER}>>>>>>>>>"
OTLP_LOGS = f"struct<resourceLogs:array<struct<resource:struct<attributes:{_KV}>,scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityText:string,body:struct<stringValue:string>,attributes:{_KV}>>>>>>>"
OTLP_TRACES = f"struct<resourceSpans:array<struct<resource:struct<attributes:{_KV}>,scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:string>,attributes:{_KV}>>>>>>>"


def _attributes(*lists):
    """Attribute lists as one map of strings; of equal keys the later counts."""
    pairs = F.flatten(F.array(*(F.coalesce(x, F.array().cast(_KV)) for x in lists)))
    text = lambda a: F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["doubleValue"].cast("string"), a["value"]["boolValue"].cast("string"))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, a: F.map_concat(F.map_filter(m, lambda k, _: k != a["key"]), F.create_map(a["key"], text(a))))


def _nanos(c):
    n = F.col(c).try_cast("decimal(20,0)")
    return F.when(n > 0, F.timestamp_micros((n / 1000).cast("long")))


def _tagged(points: str, kind: str):
    return F.transform(F.coalesce(F.col(points), F.array().cast(f"array<{_NUMBER}>")), lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("p")))


def otlp_metrics(bodies: DataFrame, column: str = "value") -> DataFrame:
    """(time, metric, value, fields) of metric payloads; a histogram's value is its mean. Points without a time, or
    histograms without a count, are left out."""
    r = bodies.select(F.explode(F.from_json(column, OTLP_METRICS)["resourceMetrics"]).alias("r"))
    m = r.select("r.resource", F.explode("r.scopeMetrics").alias("s")).select("resource", F.explode("s.metrics").alias("m"))
    kinds = [_tagged(f"m.{k}.dataPoints", k) for k in ("gauge", "sum", "histogram")]
    p = m.select("resource", F.col("m.name").alias("metric"), F.explode(F.concat(*kinds)).alias("x")).select("resource", "metric", "x.kind", "x.p.*")
    value = F.when(F.col("kind") == "histogram", F.col("sum") / F.nullif(F.col("count").try_cast("double"), F.lit(0.0))).otherwise(F.coalesce("asDouble", F.col("asInt").try_cast("double")))
    out = p.select(_nanos("timeUnixNano").alias("time"), "metric", value.alias("value"), _attributes(F.col("resource.attributes"), F.col("attributes")).alias("fields"))
    return out.filter("time is not null and value is not null")


def otlp_logs(bodies: DataFrame, column: str = "value") -> DataFrame:
    r = bodies.select(F.explode(F.from_json(column, OTLP_LOGS)["resourceLogs"]).alias("r"))
    s = r.select("r.resource", F.explode("r.scopeLogs").alias("s")).select("resource", F.explode("s.logRecords").alias("l"))
    fields = _attributes(F.col("resource.attributes"), F.col("l.attributes"))
    fields = F.when(F.coalesce(F.col("l.severityText"), F.lit("")) != "", F.map_concat(F.map_filter(fields, lambda k, _: k != "severity"), F.create_map(F.lit("severity"), F.col("l.severityText")))).otherwise(fields)
    return s.select(F.coalesce(_nanos("l.timeUnixNano"), _nanos("l.observedTimeUnixNano")).alias("time"), F.col("l.body.stringValue").alias("message"), fields.alias("fields")).filter("time is not null")


def otlp_traces(bodies: DataFrame, column: str = "value") -> DataFrame:
    """Spans of services that have a name; an error is status code ERROR in any of its spellings."""
    r = bodies.select(F.explode(F.from_json(column, OTLP_TRACES)["resourceSpans"]).alias("r"))
    s = r.select("r.resource", F.explode("r.scopeSpans").alias("s")).select("resource", F.explode("s.spans").alias("p"))
    out = s.select(F.col("p.traceId").alias("trace_id"), F.col("p.spanId").alias("span_id"), F.col("p.parentSpanId").alias("parent_id"), F.col("p.name").alias("name"), _attributes(F.col("resource.attributes"))["service.name"].alias("service"), _nanos("p.startTimeUnixNano").alias("start"), _nanos("p.endTimeUnixNano").alias("end"), F.coalesce(F.col("p.status.code").isin("STATUS_CODE_ERROR", "ERROR", "2"), F.lit(False)).alias("error"), _attributes(F.col("p.attributes")).alias("attrs"))
    return out.filter("service <> ''").withColumn("duration", (F.unix_micros("end") - F.unix_micros("start")) / 1e6)


def prometheus_range(bodies: DataFrame, column: str = "value") -> DataFrame:
    """(time, value, fields) of range-query answers; values that aren't finite are left out."""
    schema = "struct<data:struct<result:array<struct<metric:map<string,string>,values:array<array<string>>>>>>"
    r = bodies.select(F.explode(F.from_json(column, schema)["data"]["result"]).alias("r")).select(F.col("r.metric").alias("fields"), F.explode("r.values").alias("v"))
    out = r.select(F.timestamp_micros((F.col("v")[0].try_cast("double") * 1e6).cast("long")).alias("time"), F.col("v")[1].try_cast("double").alias("value"), "fields")
    return out.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def loki_streams(bodies: DataFrame, column: str = "value") -> DataFrame:
    schema = "struct<data:struct<result:array<struct<stream:map<string,string>,values:array<array<string>>>>>>"
    r = bodies.select(F.explode(F.from_json(column, schema)["data"]["result"]).alias("r")).select(F.col("r.stream").alias("fields"), F.explode("r.values").alias("v"))
    return r.select(F.timestamp_micros((F.col("v")[0].try_cast("decimal(20,0)") / 1000).cast("long")).alias("time"), F.col("v")[1].alias("message"), "fields").filter("time is not null")


def csv_metrics(spark: SparkSession, path: str, value: str = "value", time: str = "time") -> DataFrame:
    """Header CSV; the value column must be a number in every row, the others stay as text columns."""
    raw = spark.read.csv(path, header=True, mode="FAILFAST")
    return raw.select(parse_time(F.trim(time)).alias("time"), F.col(value).cast("double").alias("value"), *[c for c in raw.columns if c not in (time, value)])


def csv_logs(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE")
    return raw.withColumn("time", parse_time(F.trim("time")))


#: The fields of edge request logs.
LOGPUSH = """EdgeStartTimestamp string, ClientRequestHost string, ClientRequestPath string, ClientRequestMethod string,
ClientCountry string, ClientIP string, EdgeResponseStatus int, OriginResponseStatus int, EdgeColoCode string,
CacheCacheStatus string, WAFAction string, SecurityAction string, EdgeResponseBytes double,
EdgeTimeToFirstByteMs double, OriginResponseDurationMs double, OriginResponseTime double, _corrupt string"""


def logpush(spark: SparkSession, path: str) -> DataFrame:
    """Edge request logs, one JSON a line, as points of value 1: (time, value, host, path, method, status, status_class,
    country, colo, cache, client_ip, waf, resp_bytes, ttfb_ms, origin_ms, skipped).

    A line that is no JSON or has no time is a row with skipped = true and no time, so that bad lines can be counted;
    blank lines give nothing.
    """
    raw = spark.read.schema(LOGPUSH).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    number = lambda c: F.coalesce(c, F.lit(0.0))
    text = lambda c: F.coalesce(c, F.lit(""))
    status = F.when(F.coalesce("EdgeResponseStatus", F.lit(0)) != 0, F.col("EdgeResponseStatus")).otherwise(F.coalesce("OriginResponseStatus", F.lit(0)))
    origin = F.when(number("OriginResponseDurationMs") != 0, F.col("OriginResponseDurationMs")).otherwise(number(F.col("OriginResponseTime") / 1e6))
    waf = F.coalesce(F.nullif("WAFAction", F.lit("")), F.nullif("SecurityAction", F.lit("")))
    time = F.when(F.col("_corrupt").isNull(), parse_time("EdgeStartTimestamp"))
    return raw.select(
        time.alias("time"), F.lit(1.0).alias("value"), text("ClientRequestHost").alias("host"), normalise_path(text("ClientRequestPath")).alias("path"),
        text("ClientRequestMethod").alias("method"), status.cast("string").alias("status"), status_class(status).alias("status_class"), text("ClientCountry").alias("country"),
        text("EdgeColoCode").alias("colo"), text("CacheCacheStatus").alias("cache"), text("ClientIP").alias("client_ip"), waf.alias("waf"),
        number("EdgeResponseBytes").alias("resp_bytes"), number("EdgeTimeToFirstByteMs").alias("ttfb_ms"), origin.alias("origin_ms"), time.isNull().alias("skipped"),
    )


def logpush_lines(points: DataFrame) -> DataFrame:
    return points.filter("not skipped").select("time", F.format_string("%s %s%s %s", "method", "host", "path", "status").alias("message"))


def csv_outliers(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], list[str]]:
    """A header CSV for the outlier ensemble: its rows, the numeric columns and the label columns. A column is numeric
    when every value that isn't empty is a number, which one pass over the file decides."""
    raw = spark.read.csv(path, header=True, mode="FAILFAST")
    bad = raw.agg(*[F.count_if((F.trim(c) != "") & F.col(c).try_cast("double").isNull()).alias(c) for c in raw.columns], F.count("*").alias("rows_")).first()
    numeric = [c for c in raw.columns if bad["rows_"] and bad[c] == 0]
    return raw.select(*[F.col(c).try_cast("double").alias(c) if c in numeric else F.col(c) for c in raw.columns]), numeric, [c for c in raw.columns if c not in numeric]


def labelled_csv(spark: SparkSession, folder: str, windows: str) -> DataFrame:
    """A corpus of CSV series (timestamp, value) below a folder, with a JSON file of anomaly windows by relative path:
    (key, idx, time, value, label). Both are read by Spark, so the folder may be on any store."""
    rows = spark.read.csv(folder, header=True, recursiveFileLookup=True, schema="timestamp string, value double").withColumn("path", F.input_file_name())
    rows = rows.select(F.regexp_extract("path", r"([^/]+/[^/]+\.csv)$", 1).alias("key"), F.to_timestamp("timestamp").alias("time"), "value").filter("time is not null")
    spans = spark.read.text(windows, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<array<string>>>")).alias("key", "spans"))
    spans = spans.select("key", F.transform("spans", lambda s: F.struct(F.to_timestamp(s[0]).alias("lo"), F.to_timestamp(s[1]).alias("hi"))).alias("spans"))
    joined = rows.join(spans, "key", "left").withColumn("label", F.exists(F.coalesce("spans", F.expr("array()")), lambda s: F.col("time").between(s["lo"], s["hi"])))
    return joined.select("key", (F.row_number().over(Window.partitionBy("key").orderBy("time")) - 1).cast("long").alias("idx"), "time", "value", "label")


def archive_series(spark: SparkSession, folder: str) -> DataFrame:
    """Series of one value a line in files called <name>_<train>_<begin>_<end>.txt: (key, idx, value, train, label)."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").withColumn("path", F.input_file_name())
    at = lambda i: F.regexp_extract("path", r"_(\d+)_(\d+)_(\d+)\.txt$", i).try_cast("long")
    rows = raw.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("key"), at(1).alias("train_"), at(2).alias("lo"), at(3).alias("hi"), F.posexplode(F.filter(F.split("value", r"\s+"), lambda v: v != "")).alias("idx", "v"))
    idx = F.col("idx").cast("long")
    return rows.select("key", idx.alias("idx"), F.col("v").try_cast("double").alias("value"), (idx < F.col("train_")).alias("train"), F.coalesce(idx.between(F.col("lo"), F.col("hi")), F.lit(False)).alias("label"))


# ---- remote write: a snappy block of protobuf -------------------------------------------------------------------

MAX_BLOCK = 64 << 20


def snappy_decode(data: bytes) -> bytes:
    """Raw snappy block; what isn't one, or claims more than MAX_BLOCK, raises ValueError."""
    size, at = _varint(data, 0)
    if size > MAX_BLOCK:
        raise ValueError("block too large")
    out = bytearray()
    while at < len(data):
        tag = data[at]
        at += 1
        if tag & 3 == 0:
            n = tag >> 2
            if n >= 60:
                k = n - 59
                n = int.from_bytes(data[at : at + k], "little")
                at += k
            if at + n + 1 > len(data):
                raise ValueError("literal past the end")
            out += data[at : at + n + 1]
            at += n + 1
            continue
        if tag & 3 == 1:
            n, back = (tag >> 2 & 7) + 4, (tag >> 5) << 8 | data[at]
            at += 1
        else:
            k = 2 if tag & 3 == 2 else 4
            n, back = (tag >> 2) + 1, int.from_bytes(data[at : at + k], "little")
            at += k
        if not 0 < back <= len(out) or len(out) + n > size:
            raise ValueError("copy out of range")
        for _ in range(n):
            out.append(out[-back])
    if len(out) != size:
        raise ValueError("wrong length")
    return bytes(out)


def _varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(b) or shift > 63:
            raise ValueError("bad varint")
        out |= (b[at] & 127) << shift
        at += 1
        if b[at - 1] < 128:
            return out, at
        shift += 7


def _messages(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        kind = key & 7
        if kind == 0:
            v, at = _varint(b, at)
        elif kind == 1:
            v, at = b[at : at + 8], at + 8
        elif kind == 2:
            n, at = _varint(b, at)
            v, at = b[at : at + n], at + n
        elif kind == 5:
            v, at = b[at : at + 4], at + 4
        else:
            raise ValueError("unknown wire type")
        if at > len(b):
            raise ValueError("field past the end")
        yield key >> 3, v


def remote_write(bodies: DataFrame, column: str = "content") -> DataFrame:
    """(time_ms, metric, value, fields) of compressed write requests; requests that don't parse are left out."""

    def run(batches):
        for batch in batches:
            rows = []
            for body in batch.column(0).to_pylist():
                try:
                    got = []
                    for f, series in _messages(snappy_decode(body)):
                        if f != 1:
                            continue
                        labels, samples = {}, []
                        for g, x in _messages(series):
                            parts = dict(_messages(x))
                            if g == 1:
                                labels[parts.get(1, b"").decode("utf-8", "replace")] = parts.get(2, b"").decode("utf-8", "replace")
                            elif g == 2:
                                ms = parts.get(2, 0)
                                samples.append((ms - (1 << 64) if ms >> 63 else ms, struct.unpack("<d", parts.get(1, bytes(8)))[0]))
                        name = labels.pop("__name__", "")
                        got += [(ms, name, v, list(labels.items())) for ms, v in samples]
                    rows += got
                except (ValueError, IndexError, AttributeError, TypeError, struct.error):
                    continue
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.map_(pa.string(), pa.string())), strict=True)], names=["time_ms", "metric", "value", "fields"])

    return bodies.select(column).mapInArrow(run, "time_ms bigint, metric string, value double, fields map<string,string>")
