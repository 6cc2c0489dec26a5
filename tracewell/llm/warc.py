"""Legacy web archives (ARC) converted to WARC.

An ARC archive begins with a version block, whose first line is itself a record header and whose
third line names the fields of all later header lines.  Version 1 lines have five fields, version 2
lines ten; in both the last is the declared length of the record's content, which is followed by a
line end.  `parse` reads archives by those lengths.  `convert` gives each record what WARC asks
for: an identifier derived from what the record is and where it stood, the date in ISO form, a
type by the scheme of the URL, and SHA-256 digests.  Of responses with equal payloads the first
(least page_id) keeps its payload and the others become revisits of it.

`write` makes one .warc.gz file per partition, each record a gzip member of its own; `read` reads
them back one file per task, streaming.  Archives are rows (name, content) as the binaryFile source
gives them, so legacy archives from files enter by spark.read.format("binaryFile").
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import file_system, slices, write_file

#: Fixed field names of the header lines of both versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ID_HEADER = b"X-Page-Id"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 100
RECORDS = "archive string, offset long, url string, ip string, arc_date string, content_type string, content binary, payload_start int, whole boolean"


def arc_header(version: int, url: str, ip: str, date: str, kind: str, length: int, *, code: int = 200, at: int = 0, name: str = "-") -> bytes:
    fields = [url, ip, date, kind, *([str(code), "-", "-", str(at), name] if version == 2 else []), str(length)]
    return (" ".join(fields) + "\n").encode()


def arc_start(version: int, name: str, date: str) -> bytes:
    """The version block."""
    block = f"{version} 0 tracewell\n{FIELDS[version]}\n".encode()
    return arc_header(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(block), name=name) + block + b"\n"


def pack(pages: DataFrame, date: str = "20080103120000", limit: int = 4 << 20) -> DataFrame:
    """Legacy archives (name, content) of page rows (page_id, url, html), of about `limit` bytes each.

    Archives take turns in both versions.  Null html is empty, null urls are named after the page;
    spaces in urls are written %20 (the header line is split at spaces).  Ids are 64-bit integers (others
    are cast, and fail where they can't be).
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "html", limit):
                version, name = 1 + (part + k) % 2, f"legacy-{part:05d}-{k:05d}.arc"
                out = [arc_start(version, name, date)]
                at, k = len(out[0]), k + 1
                for page, url, html in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html")], strict=True):
                    raw = html.encode()
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n" % len(raw)
                    head += ID_HEADER + b": %s\r\n\r\n" % (b"" if page is None else str(page).encode())
                    safe = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or f"urn:page:{page}")
                    line = arc_header(version, safe, "127.0.0.1", date, "text/html", len(head) + len(raw), at=at, name=name)
                    out += [line, head, raw, b"\n"]
                    at += len(line) + len(head) + len(raw) + 1
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(out)])], names=["name", "content"])

    return rows.mapInArrow(run, "name string, content binary")


def arc_records(name: str, data: bytes):
    """The records of one archive.  Header lines that don't parse end the archive; a record whose
    declared length passes the end of the archive comes with what there is, `whole` being false."""
    end = data.find(b"\n")
    first = data[:end].decode("utf-8", "replace").split(" ")
    if end < 0 or not first[0].startswith("filedesc://") or not first[-1].isdigit():
        return
    size = int(first[-1])
    block = data[end + 1 : end + 1 + size].decode("utf-8", "replace").split("\n")
    version = int(block[0].split(" ")[0]) if block[0][:1].isdigit() else 1
    names = (block[1] if len(block) > 1 and block[1] else FIELDS.get(version, FIELDS[1])).split(" ")
    place = {n: i - len(names) for i, n in enumerate(names)}  # from the right: a URL may hold spaces
    at = end + 1 + size
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        end = data.find(b"\n", at)
        if end < 0:
            return
        line = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if len(line) < len(names) or not line[-1].isdigit():
            return
        size = int(line[-1])
        content = data[end + 1 : end + 1 + size]
        url = " ".join(line[: len(line) - len(names) + 1])
        split = content.find(b"\r\n\r\n") + 4 if content.startswith(b"HTTP/") else 0
        yield (name, at, url, line[place["IP-address"]], line[place["Archive-date"]], line[place["Content-type"]], content, split if split >= 4 else 0, len(content) == size)
        at = end + 1 + size


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def parse(archives: DataFrame) -> DataFrame:
    """The records of archives (name, content), read by version and declared lengths."""
    names = ["archive", "offset", "url", "ip", "arc_date", "content_type", "content", "payload_start", "whole"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.bool_()]

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                rows, held = [], 0
                for r in arc_records(name, data.as_py() or b""):
                    rows.append(r)
                    held += len(r[6])
                    if held > 4 << 20:
                        yield _batch(rows, names, kinds)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names, kinds)

    return archives.select("name", "content").mapInArrow(run, RECORDS)


def convert(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """WARC fields of every record: record_id, date, type, payload digest and size, and what it revisits.

    The first of equal payloads is that of least page_id (null last), then least record_id.  Only
    digests are grouped; contents join the groups of two or more, where a large group is split
    over tasks.
    """
    payload = F.expr("substring(content, payload_start + 1)")
    digits = F.rpad(F.regexp_replace("arc_date", "[^0-9]", ""), 14, "0")
    http = F.col("payload_start") > 0
    page = F.expr("try_cast(nullif(regexp_extract(decode(substring(content, 1, payload_start), 'ISO-8859-1'), 'X-Page-Id: ([0-9-]*)', 1), '') as long)")
    seed = F.sha2(F.concat_ws("\n", "archive", F.col("offset").cast("string"), "url", "arc_date"), 256)
    uid = F.concat(F.lit("urn:uuid:"), F.substring(seed, 1, 8), F.lit("-"), F.substring(seed, 9, 4), F.lit("-8"), F.substring(seed, 14, 3), F.lit("-8"), F.substring(seed, 18, 3), F.lit("-"), F.substring(seed, 21, 12))
    rows = records.select(
        "url",
        "ip",
        "content_type",
        "content",
        "payload_start",
        page.alias("page_id"),
        uid.alias("record_id"),
        F.regexp_replace(digits, r"(....)(..)(..)(..)(..)(..).*", "$1-$2-$3T$4:$5:$6Z").alias("date"),
        F.when(http, "response").when(F.col("url").startswith("filedesc:"), "warcinfo").otherwise("resource").alias("own_type"),
        (F.length("content") - F.col("payload_start")).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"),
    )
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "record_id", "url", "date")
    firsts = rows.where((F.col("payload_bytes") >= least) & (F.col("own_type") == "response")).groupBy("payload_digest").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")
    # Payloads that can't be revisits have keys of their own, so that the many empty ones don't meet in one task.
    able = (F.col("payload_bytes") >= least) & (F.col("own_type") == "response")
    firsts = firsts.select(F.col("payload_digest").alias("key"), "first")
    joined = rows.withColumn("key", F.when(able, F.col("payload_digest")).otherwise(F.col("record_id"))).join(firsts, "key", "left")
    again = F.col("first").isNotNull() & (F.col("first.record_id") != F.col("record_id"))
    return joined.select(
        "record_id", "date", "url", "ip", "content_type", "payload_start", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise(F.col("own_type")).alias("type"),
        F.when(again, F.col("first.record_id")).alias("refers_to"),
        F.when(again, F.col("first.url")).alias("refers_url"),
        F.when(again, F.col("first.date")).alias("refers_date"),
        F.when(again, F.expr("substring(content, 1, payload_start)")).otherwise(F.col("content")).alias("block"),
    )


def warc_record(r: dict) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {r['type']}",
        f"WARC-Record-ID: <{r['record_id']}>",
        f"WARC-Date: {r['date']}",
        f"WARC-Target-URI: {r['url']}",
        f"WARC-IP-Address: {r['ip']}",
        f"WARC-Payload-Digest: sha256:{r['payload_digest']}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(r['block']).hexdigest()}",
        f"Content-Type: {'application/http; msgtype=response' if r['payload_start'] else r['content_type']}",
    ]
    if r["refers_to"]:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{r['refers_to']}>", f"WARC-Refers-To-Target-URI: {r['refers_url']}", f"WARC-Refers-To-Date: {r['refers_date']}"]
    return "\r\n".join([*head, f"Content-Length: {len(r['block'])}", "", ""]).encode() + r["block"] + b"\r\n\r\n"


def write(converted: DataFrame, folder: str) -> DataFrame:
    """Write .warc.gz files below `folder`; returns their table (file, n_records), which is written too."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0

        def members():
            nonlocal n
            name = f"part-{part:05d}.warc.gz"
            info = b"software: tracewell\r\nformat: WARC File Format 1.1\r\n"
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\nWARC-Date: 2008-01-03T12:00:00Z\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
            for record in [head.encode() + info + b"\r\n\r\n"]:
                yield gzipped(record)
            for whole in batches:
                for batch in slices(whole, "block", 2 << 20):
                    for r in batch.to_pylist():
                        n += 1
                        yield gzipped(warc_record(r))

        stream = members()
        start = next(stream)
        first = next(stream, None)
        if first is not None:
            write_file(f"{folder}/part-{part:05d}.warc.gz", (x for s in ([start, first], stream) for x in s))
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}.warc.gz"]), pa.array([n], pa.int64())], names=["file", "n_records"])

    schema = "file string, n_records long"
    converted.mapInArrow(run, schema).write.parquet(f"{folder}/files")
    return converted.sparkSession.read.schema(schema).parquet(f"{folder}/files")


def gzipped(data: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def members_of(stream, size: int = 1 << 20):
    """The decompressed gzip members of an open file, one after the other."""
    unpack, out = zlib.decompressobj(31), []
    while data := stream.read(size):
        while data:
            out.append(unpack.decompress(data))
            data = unpack.unused_data
            if unpack.eof:
                yield b"".join(out)
                unpack, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the file ends within a record")


def read_record(data: bytes) -> tuple | None:
    """record_id, type, page_id, payload_bytes, payload_digest and refers_to; None for warcinfo.

    A response's payload is measured and must match its digest; a revisit has the digest in its
    header and the size in the HTTP header it kept.
    """
    end = data.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in data[:end].decode().split("\r\n")[1:])
    kind = head["WARC-Type"]
    if kind == "warcinfo":
        return None
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    start = block.find(b"\r\n\r\n") + 4 if head["Content-Type"].startswith("application/http") else 0
    http = dict(line.split(b": ", 1) for line in block[: max(start - 4, 0)].split(b"\r\n")[1:])
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "revisit":
        size = int(http[b"Content-Length"])
    else:
        payload = block[start:]
        size = len(payload)
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {head['WARC-Record-ID']} doesn't match its digest")
    page = http.get(ID_HEADER, b"")
    return (head["WARC-Record-ID"][1:-1], kind, int(page) if page else None, size, digest, head.get("WARC-Refers-To", "<>")[1:-1] or None, head["WARC-Target-URI"], head["WARC-Date"])


def read(files: DataFrame, folder: str) -> DataFrame:
    """The records of the archives: record_id, record_type, page_id, payload_bytes, payload_digest,
    refers_to_id, url and date."""
    names = ["record_id", "record_type", "page_id", "payload_bytes", "payload_digest", "refers_to_id", "url", "date"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            for name in batch.column("file").to_pylist():
                store, path = file_system(f"{folder}/{name}")
                rows = []
                with store.open_input_stream(path, compression=None) as stream:
                    for data in members_of(stream):
                        if r := read_record(data):
                            rows.append(r)
                        if len(rows) == 2000:
                            yield _batch(rows, names, kinds)
                            rows = []
                if rows:
                    yield _batch(rows, names, kinds)

    tasks = max(1, min(files.count(), 4 * files.sparkSession.sparkContext.defaultParallelism))
    return files.select("file").repartition(tasks, "file").mapInArrow(run, "record_id string, record_type string, page_id long, payload_bytes long, payload_digest string, refers_to_id string, url string, date string")


def pages_of(records: DataFrame) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type and refers_to (a page_id)."""
    revisited = records.where("refers_to_id is not null").select(F.col("refers_to_id").alias("record_id")).distinct()
    targets = records.where("record_type = 'response'").join(revisited, "record_id", "left_semi").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    plain = records.where("refers_to_id is null").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = records.where("refers_to_id is not null").join(targets, "refers_to_id", "left")
    return plain.unionByName(again.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
