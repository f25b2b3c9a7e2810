"""WARC archives with an index that comes first.

Writing: the pages are joined with their record plan (type and reference) by
page_id and every task writes one ``.warc.gz`` file of its partition, one gzip
member a record, into a folder that all executors share. A task that is run
again writes another file; the index holds the records of the attempt that
counted, so lost executors leave orphans but no wrong records.

Index: file, offset, length, url, digest and page_id of each record, written as
Parquet before anything is read back.

Reading: the selected index rows are sorted by file and offset, neighbouring
byte ranges are coalesced over gaps of up to ``gap`` bytes into reads of at
most ``most`` bytes, and each record is parsed from its own member. Read tasks are dealt by the
bytes that the index selects: ``task_bytes`` each, and fewer while there are more
cores than tasks.

Workers open the folder with pyarrow's file systems. ``s3a`` and ``s3n`` are read
as ``s3`` and ``dbfs:/`` as its mount; a folder on any other system needs an
``opener``, a function from the folder to (file system, path). The driver opens the
folder first, so an unknown system fails before the job.

A response's block is an HTTP response with the html as its body, a revisit has
none. Records of rows that repeat a page_id share its ``WARC-Record-ID``.

Of pages with equal payloads the one with the largest page_id is the
``response`` and the others ``revisit`` it; payloads under ``least_bytes`` are
all responses.

Defined results: null html is an empty payload; a null url writes no
WARC-Target-URI and reads back as null; a null page_id is a response of its own
and is written as ``urn:page:null``; rows that repeat page_id and payload are
one response and no revisit of themselves, each row with its own record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby
from urllib.parse import quote, unquote

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .arrowio import batched, map_arrow, rows_of

INDEX = "page_id long, url string, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no body but the size and digest of its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    body = b"" if kind == "revisit" else http.encode() + payload
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"),
        ("WARC-Target-URI", None if url is None else quote(url, safe="!#$&'()*+,/:;=?@[]~-._%") if "%" not in url else quote(url, safe="!#$&'()*+,/:;=?@[]~-._")),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", "sha1:" + digest32(payload)),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """The columns of RECORD from a record's bytes; checks size and digest of a body."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    got = dict(line.split(": ", 1) for line in lines[1:])
    page = re.fullmatch(r"<urn:page:(-?\d+|null)>", got["WARC-Record-ID"])[1]
    refers = re.fullmatch(r"<urn:page:(-?\d+)>", got["WARC-Refers-To"])[1] if "WARC-Refers-To" in got else None
    body = rest[: int(got["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError(f"record of page {page} is cut off")
    if got["WARC-Type"] == "response":
        body = body.partition(b"\r\n\r\n")[2]
    said, size = got["WARC-Payload-Digest"].removeprefix("sha1:"), int(got["X-Payload-Length"])
    if got["WARC-Type"] == "response" and (digest32(body) != said or len(body) != size):
        raise ValueError(f"payload of page {page} doesn't match its digest")
    url = unquote(got["WARC-Target-URI"]) if "WARC-Target-URI" in got else None
    payload = body.decode() if got["WARC-Type"] == "response" else None
    return None if page == "null" else int(page), url, size, said, got["WARC-Type"], None if refers is None else int(refers), payload


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder given as a Hadoop path."""
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    uri = re.sub(r"^dbfs:/+", "/dbfs/", uri)
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def plan(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, record_type and refers_to of each distinct (page_id, payload)."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.where("page_id is not null").select("page_id", F.sha1(payload).alias("digest"), F.length(payload).alias("size"))
    rows = rows.groupBy("page_id", "digest", "size").agg(F.count("*").alias("copies"))
    # only digests of several pages take part in the join below
    groups = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("other")).where("keeper > other")
    known = rows.join(groups.select("digest", "keeper"), "digest", "left")
    again = (F.col("size") >= least_bytes) & (F.col("keeper") > F.col("page_id"))
    return known.select("page_id", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("keeper")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least_bytes: int = 0, opener: Callable = filesystem) -> DataFrame:
    """Write the archives; the index as a table that has been written."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = pages.sparkSession
    todo = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    todo = todo.join(plan(pages, least_bytes), ["page_id", "digest"], "left").select("page_id", "url", "html", F.coalesce("record_type", F.lit("response")).alias("record_type"), "refers_to")
    schema = StructType.fromDDL(INDEX)
    arrow = to_arrow_schema(schema)
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    opener(folder)

    def store(rows: Iterator[tuple]):
        first = next(rows, None)
        if first is None:
            return
        fs, base = opener(folder)
        path = f"{base}/{uuid.uuid4().hex}.warc.gz"
        offset = 0
        with fs.open_output_stream(path, compression=None) as out:
            while first is not None:
                page_id, url, html, kind, refers = first
                payload = (html or "").encode()
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = squeeze.compress(record(page_id, url, payload, kind, refers)) + squeeze.flush()
                out.write(member)
                yield page_id, url, digest32(payload), kind, refers, path.rsplit("/", 1)[1], offset, len(member)
                offset += len(member)
                first = next(rows, None)

    index = map_arrow(todo, lambda batches: batched(store(rows_of(batches, 16)), arrow), schema)
    return materialize(index, "warc-index")


def coalesced(rows: Iterator[tuple], gap: int, most: int) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, start, end, members) of neighbouring (file, offset, length) rows."""
    held: tuple | None = None
    for file, offset, length in rows:
        if held and held[0] == file and offset - held[2] <= gap and offset + length - held[1] <= most:
            held[3].append((offset, length))
            held = (file, held[1], max(held[2], offset + length), held[3])
        else:
            if held:
                yield held
            held = (file, offset, offset + length, [(offset, length)])
    if held:
        yield held


def read(index: DataFrame, folder: str, gap: int = 64 << 10, most: int = 8 << 20, task_bytes: int = 32 << 20, opener: Callable = filesystem, payloads: bool = True) -> DataFrame:
    """The records that ``index`` selects, parsed and checked; without ``payloads`` these stay in the task, as null."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(RECORD)
    arrow = to_arrow_schema(schema)

    def load(rows: Iterator[tuple]):
        fs, base = opener(folder)
        for name, ranges in groupby(coalesced(rows, gap, most), lambda x: x[0]):
            with fs.open_input_file(f"{base}/{name}") as opened:
                for _, start, end, members in ranges:
                    data = opened.read_at(end - start, start)
                    for offset, length in members:
                        found = parse(zlib.decompress(memoryview(data)[offset - start : offset - start + length], 31))
                        yield found if payloads else (*found[:-1], None)

    spark = index.sparkSession
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // task_bytes), min(spark.sparkContext.defaultParallelism, total >> 20))
    wanted = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return map_arrow(wanted, lambda batches: batched(load(rows_of(batches)), arrow, 1 << 20, lambda r: 1000 + len(r[-1] or "")), schema)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write every page, then read all records back.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    index = write(pages, folder, least_bytes)
    return read(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
