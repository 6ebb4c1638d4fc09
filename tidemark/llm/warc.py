"""WARC archives: writing captures, and reading them back by transaction assembly.

Writing: each capture is a transaction of three records, a request, a response (or, for a payload that another
capture already has, a revisit that refers to it) and a metadata record; request and metadata name the response
by WARC-Concurrent-To. Every record is a gzip member of its own, as the format recommends. Files are written by
Spark's own committer, so they land in any store Spark can write, and lost tasks leave no halves behind: a row of
the text sink holds the members of one capture, and an empty gzip member ends it, whose last byte, zero, is the
sink's separator. Concatenated, the file is plain multi-member gzip.

Reading: files are parsed record by record where they lie, whatever their order. Assembly then joins the request
and metadata records to the response or revisit they are concurrent to, whichever of them names the other, and emits
one nested row per capture.
Only what is asked for moves in that join: payload bytes and digests are worked out at the parser, and bodies
join only with ``bodies=True``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, materialise
from .exact_dedup import flag_repeats, repeated_bits

VERSION = b"WARC/1.1"
MIN_REVISIT = 1000
#: Fixed value: the profile of revisits whose payload is that of an earlier capture.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY = zlib.compressobj(9, zlib.DEFLATED, 31)
EMPTY_MEMBER = _EMPTY.compress(b"") + _EMPTY.flush()


def record_id(page_id: int, kind: str, payload_sha1: bytes, url: str) -> str:
    """A version 8 UUID from the capture's id, the record's kind and a hash of what is captured.

    The response of (page_id, payload) has the same id wherever it is named, so a revisit can refer to it
    without a join; the URL tells apart requests only.
    """
    raw = hashlib.sha256(f"{page_id}\0{kind}\0".encode() + payload_sha1 + (url.encode("utf-8", "replace") if kind != "response" else b"")).digest()[:16]
    n = int.from_bytes(raw) & ~(0xF << 76) | (8 << 76)
    n = n & ~(3 << 62) | (2 << 62)
    h = f"{n:032x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = b"".join(f"{k}: {_line(v)}\r\n".encode() for k, v in headers)
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(VERSION + b"\r\n" + lines + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + c.flush()


def _line(v: str) -> str:
    """Header values hold no line ends; a URL with any is percent-encoded there."""
    return v if v.isprintable() else "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in v)


def transaction(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """The members of one capture's response or revisit, request and metadata records."""
    url, sha1 = url or "about:blank", hashlib.sha1(payload).digest()
    key = page_id if page_id is not None else "null"
    main = record_id(key, "response", sha1, url)
    digest = "sha1:" + base64.b32encode(sha1).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Record-ID", main), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        out = _member([("WARC-Type", "response"), *head], http + payload)
    else:
        if main == (target := record_id(refers_to, "response", sha1, url)):
            raise ValueError("a capture can't revisit itself")
        out = _member([("WARC-Type", "revisit"), *head, ("WARC-Profile", PROFILE), ("WARC-Refers-To", target)], http)
    path = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "", url).split("#")[0] or "/"
    host = (re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", url) or [None, ""])[1]
    out += _member([("WARC-Type", "request"), ("WARC-Record-ID", record_id(key, "request", sha1, url)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Concurrent-To", main), ("Content-Type", "application/http; msgtype=request")], f"GET {_line(path)} HTTP/1.1\r\nHost: {_line(host)}\r\n\r\n".encode())
    fields = f"page_id: {key}\r\n".encode() + (f"refers_to: {refers_to}\r\n".encode() if refers_to is not None else b"")
    out += _member([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id(key, "metadata", sha1, url)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")], fields)
    return out


def plan(pages: DataFrame, key: str = "page_id", html: str = "html", min_revisit: int = MIN_REVISIT) -> tuple[DataFrame, DataFrame, int]:
    """Per (key, sha1) of a revisit: the key of the response it refers to; and a filter of digests that may repeat.

    Only digests and keys move, and of those only what the Bloom filter of exact_dedup lets through.
    """
    size = F.octet_length(F.coalesce(html, F.lit("")))
    prints = materialise(pages.filter(size >= min_revisit).select(F.col(key).cast("long").alias("key"), F.unhex(F.sha1(html)).alias("sha1")), "payloads")
    n_rows = prints.count()
    hashed = prints.withColumn("h", F.xxhash64("sha1"))
    bits, n_segments = repeated_bits(hashed.select("h"), n_rows)
    large = flag_repeats(hashed, "h", bits, n_segments, "maybe").filter("maybe").select("key", "sha1")
    groups = large.groupBy("sha1").agg(F.max("key").alias("refers_to"), F.count("*").alias("size")).filter("size > 1 and refers_to is not null")
    met = join_groups(large, materialise(groups, "groups"), "sha1", "size", n_rows)
    return met.filter(~F.col("key").eqNullSafe(F.col("refers_to"))).select("key", "sha1", "refers_to").distinct(), bits, n_segments


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT, date: datetime | None = None) -> None:
    """Write one transaction per row of pages to *.warc.gz-style files below folder.

    Of rows with equal payloads of at least min_revisit bytes that with the largest key is the response, the
    others revisit it; rows repeated with that largest key are all responses. A null html is the empty payload, a
    null url `about:blank`; rows with a null key are responses unless an equal payload has a key. Other columns
    are not archived. An empty table writes no record.
    """
    stamp = (date or datetime(2000, 1, 1, tzinfo=UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            blobs = [(transaction(k, u, h.encode("utf-8", "surrogatepass"), r, stamp) + EMPTY_MEMBER)[:-1] for k, u, h, r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary())], names=["value"])

    revisits, bits, n_segments = plan(pages, key, html, min_revisit)
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.when(F.octet_length("html") >= min_revisit, F.unhex(F.sha1("html")))).withColumn("h", F.xxhash64("sha1"))
    rows = flag_repeats(rows, "h", bits, n_segments, "maybe").withColumn("maybe", F.col("maybe") & F.col("sha1").isNotNull())
    # captures whose payload certainly stands alone are written where they are; the others meet their plan
    revisits = revisits.select(F.col("key").alias("key_"), F.col("sha1").alias("sha1_"), "refers_to")
    met = rows.filter("maybe").join(revisits, F.col("key").eqNullSafe(F.col("key_")) & (F.col("sha1") == F.col("sha1_")), "left")
    rows = rows.filter("not maybe").withColumn("refers_to", F.lit(None).cast("long")).select("key", "url", "html", "refers_to").unionByName(met.select("key", "url", "html", "refers_to"))
    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").text(folder)


def members(content: memoryview) -> Iterator[bytes]:
    """The plain bytes of each gzip member that isn't empty; a file that isn't gzip is taken as it is."""
    if bytes(content[:2]) != b"\x1f\x8b":
        if len(content):
            yield bytes(content)
        return
    at = 0
    while at < len(content):
        d, out, step = zlib.decompressobj(31), [], 1 << 10  # what follows a member is copied, so steps begin small
        while not d.eof:
            if at >= len(content):
                raise ValueError("a gzip member is cut short")
            piece = content[at : at + step]
            out.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
            step = min(2 * step, 1 << 20)
        if got := b"".join(out):
            yield got


def records(content: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive; damage raises ValueError.

    WARC-Concurrent-To may be repeated: its values come with spaces between, which no URI holds.
    """
    for data in members(content):
        at = 0
        while at < len(data):
            end = data.find(b"\r\n\r\n", at)
            if not data.startswith(b"WARC/", at) or end < 0:
                raise ValueError(f"no WARC record at byte {at}")
            head: dict[str, str] = {}
            for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
                k, _, v = line.partition(":")
                k, v = k.strip().lower(), v.strip()
                head[k] = f"{head[k]} {v}" if k == "warc-concurrent-to" and k in head else v
            n = int(head["content-length"])
            block = data[end + 4 : end + 4 + n]
            if len(block) != n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
                raise ValueError(f"the WARC record at byte {at} is cut short")
            yield head, block
            at = end + 8 + n


RECORD = "record_id string, type string, concurrent_to array<string>, url string, date string, refers_to_id string, payload_digest string, payload_bytes bigint, http_head string, fields map<string,string>, body binary"


def read_records(spark: SparkSession, folder: str, bodies: bool = False) -> DataFrame:
    """One row per record of the archives below folder. Responses' digests are checked against their payloads.

    payload_digest is bare lower-case hex; a revisit's digest and length are those of the payload it stands for.
    Files are read whole, so writers should keep them to a few hundred MB. body is null unless asked for.
    """

    def hexed(v: str | None) -> str | None:
        if not v or not v.lower().startswith("sha1:"):
            return None
        v = v[5:]
        return base64.b32decode(v.upper()).hex() if len(v) == 32 else v.lower()

    def run(batches):
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for head, block in records(memoryview(content.as_buffer())):
                    kind, fields, digest, size, http, body = head.get("warc-type", ""), None, hexed(head.get("warc-payload-digest")), None, None, None
                    if "application/http" in head.get("content-type", ""):
                        top, _, body = block.partition(b"\r\n\r\n")
                        http = top.decode("utf-8", "replace")
                        if kind == "response":
                            size, own = len(body), hashlib.sha1(body).hexdigest()
                            if digest not in (None, own):
                                raise ValueError(f"{head.get('warc-record-id')} doesn't have its digest")
                            digest = own
                        elif kind == "revisit":
                            size = next((int(x.split(":", 1)[1]) for x in http.split("\r\n") if x.lower().startswith("content-length:")), None)
                    elif "warc-fields" in head.get("content-type", ""):
                        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k.strip()]
                    else:
                        body = block
                    rows.append((head.get("warc-record-id"), kind, head.get("warc-concurrent-to", "").split(), head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-refers-to"), digest, size, http, fields, body if bodies else None))
                    held += len(body or b"") if bodies else 100
                    if len(rows) >= 5000 or held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=names)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, RECORD)


TYPES = [pa.string()] * 2 + [pa.list_(pa.string())] + [pa.string()] * 4 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]


def assemble(recs: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with the request and metadata concurrent to it.

    Records are concurrent where either names the other, or where both name or are named by a third, such as metadata
    of the request. A capture without request or metadata has null there; where it has several, the one with the
    smallest record id is there and the rest are in `others`, by kind and record id. Requests and metadata whose
    capture isn't in the archives are left out. Captures repeated with one record id stay as many rows.
    """
    main, side = F.col("type").isin("response", "revisit"), F.col("type").isin("request", "metadata")
    heads = materialise(recs.filter(main | side).select("record_id", "type", "concurrent_to"), "heads")
    own = heads.filter(side).select("record_id", F.explode("concurrent_to").alias("to"))
    named = heads.filter(main).select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("side"))
    # links to what isn't a capture, a request say: whatever that is concurrent to
    loose = materialise(own.join(heads.filter(main).select(F.col("record_id").alias("to")), "to", "left_anti"), "links")
    pairs = own.select(F.col("record_id").alias("side"), F.col("to").alias("capture")).unionByName(named)
    both = loose.select(F.col("record_id").alias("x"), F.col("to").alias("y")).unionByName(loose.select(F.col("to").alias("x"), F.col("record_id").alias("y")))
    through = both.join(pairs, F.col("y") == F.col("side")).filter("x <> capture").select(F.col("x").alias("side"), "capture")
    more = named.unionByName(through).distinct()

    rows = recs.filter(side)
    record = F.struct("type", "record_id", "http_head", "fields", "body").alias("record")
    links = rows.select(F.explode("concurrent_to").alias("capture"), record)
    links = links.unionByName(rows.join(more, F.col("record_id") == F.col("side")).select("capture", record))
    name = lambda x: F.concat_ws(" ", x["type"], x["record_id"])
    sorted_ = F.array_sort(F.collect_list("record"), lambda x, y: F.when(name(x) < name(y), -1).when(name(x) > name(y), 1).otherwise(0))
    held = links.groupBy("capture").agg(sorted_.alias("all"))
    # a record that is linked in several ways is there several times
    held = held.withColumn("all", F.filter("all", lambda x, i: (i == 0) | x["record_id"].isNull() | (name(x) != name(F.get("all", i - 1)))))
    first = lambda kind: F.get(F.filter("all", lambda x: x["type"] == kind), F.lit(0))
    bare = lambda kind: F.when(first(kind).isNotNull(), F.struct(*(first(kind)[c].alias(c) for c in ("record_id", "http_head", "fields", "body")))).alias(kind)
    others = F.filter("all", lambda x, i: (i > 0) & (x["type"] == F.get("all", i - 1)["type"]))
    held = held.select(F.col("capture").alias("capture_"), bare("request"), bare("metadata"), others.alias("others"))
    got = recs.filter(main).select("record_id", F.col("type").alias("record_type"), "url", "date", "refers_to_id", "payload_digest", "payload_bytes", "http_head", "body")
    return got.join(held, got["record_id"] == held["capture_"], "left").drop("capture_").withColumn("others", F.coalesce("others", F.array().cast(held.schema["others"].dataType)))


def read(spark: SparkSession, folder: str, bodies: bool = False) -> DataFrame:
    """assemble() of what lies below folder, with the capture's page_id and the one it refers to, from its metadata."""
    got = assemble(read_records(spark, folder, bodies))
    return got.withColumns({"page_id": F.col("metadata.fields")["page_id"].try_cast("long"), "refers_to": F.col("metadata.fields")["refers_to"].try_cast("long")})
