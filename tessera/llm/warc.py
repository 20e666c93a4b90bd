"""WARC archives compressed record by record with a Zstandard dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record follows as
one frame compressed with it. The dictionary is built from a bounded sample of the records. Equal payloads are
stored once: the row with the largest id is the response, the others are revisits that refer to it.
Archives are rows (archive bytes) of a table in the shared folder, of about ARCHIVE bytes each; `export` puts
them into files of any file system that Spark can write to.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, bound_batches

SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
ARCHIVE = 4 << 20
DATE = "1970-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None, mark: str) -> str:
    """Id of a page's record, from its page_id and payload digest: a revisit can name the response's."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id} {mark}')}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC 1.1 record: a response (an HTTP message), or a revisit of the page `refers_to` without the payload."""
    kind = "response" if refers_to is None else "revisit"
    mark = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, mark)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", "sha1:" + mark))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, mark)), ("X-Refers-To-Page", str(refers_to))]
    return _record([*head, ("Content-Type", "application/http;msgtype=response")], body)


def _record(head: list[tuple[str, str]], body: bytes) -> bytes:
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in (*head, ("Content-Length", str(len(body))))) + "\r\n"
    return lines.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def archive_info() -> bytes:
    """The warcinfo record that leads an archive."""
    body = b"software: tessera\r\nformat: WARC File Format 1.1\r\n"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, digest(body))), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], body)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    at = data.index(b"\r\n\r\n")
    lines = data[:at].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    n = int(head["Content-Length"])
    body = data[at + 4 : at + 4 + n]
    if len(body) != n or data[at + 4 + n :] != b"\r\n\r\n":
        raise ValueError("record is cut short")
    return head, body


def train_dictionary(samples: list[bytes], size: int = 32 << 10) -> bytes:
    """A Zstandard dictionary from whole sample records; raw content where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"WARC/1.1\r\n"


def start_archive(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def records(archive: bytes) -> Iterator[bytes]:
    """The records of an archive; the dictionary comes from its leading frame."""
    magic, n = struct.unpack_from("<II", archive)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + n]))
    at = 8 + n
    view = memoryview(archive)
    while at < len(archive):
        one = d.decompressobj()
        yield one.decompress(view[at:])
        at = len(archive) - len(one.unused_data)


def write_archives(spark: SparkSession, pages: DataFrame, minimum: int = 0, sample: int = 400, level: int = 6) -> DataFrame:
    """Archives of all pages(page_id, url, html), as saved rows (archive string, data binary).

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of at least `minimum` bytes
    that with the largest page_id is the response and the others revisit it; smaller ones are all responses.
    Rows with a null page_id are responses. Repeated rows (equal page_id and payload) are equal records: where
    theirs is the largest page_id, all are responses. The dictionary is trained on at most `sample` records, those of the
    smallest page_id hashes. An empty table gives no archives. Other columns are ignored.
    """
    bound_batches(spark, 500)
    t = Tables(spark, "warc")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    mark = F.when(F.octet_length("html") >= minimum, F.sha1(F.col("html").cast("binary")))
    narrow = own.select("page_id", mark.alias("mark")).filter("mark is not null and page_id is not null")
    groups = narrow.groupBy("mark").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").select("mark", "refers_to")
    named = own.withColumn("mark", mark).join(groups, "mark", "left")
    named = named.withColumn("refers_to", F.when(F.col("refers_to") != F.col("page_id"), F.col("refers_to"))).select("page_id", "url", "html", "refers_to")
    # hashes below the share wanted, so that a task sends no more than its share of the sample
    h = F.xxhash64("page_id", F.lit(5))
    below = -(2**63) + min(int(1.5 * sample / max(own.count(), 1) * 2**64), 2**64 - 1)
    few = own.filter(h <= below).dropDuplicates(["page_id"]).orderBy(h, "page_id").limit(sample).toPandas()
    words = train_dictionary([make_record(*(None if v is None or v != v else v for v in (r.page_id, r.url)), r.html.encode("utf-8", "surrogatepass")) for r in few.itertuples()])
    shared = spark.sparkContext.broadcast(words)  # 32 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(shared.value), write_checksum=True)
        lead = [start_archive(shared.value), z.compress(archive_info())]
        held, size = list(lead), 0

        def done() -> pa.RecordBatch:
            data = b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(data).hexdigest()]), pa.array([data], pa.binary())], ["archive", "data"])

        for b in batches:
            for page, url, html, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(z.compress(make_record(page, url, html.encode("utf-8", "surrogatepass"), refers)))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield done()
                    held, size = list(lead), 0
        if size:
            yield done()

    return t.save(named.mapInArrow(run, "archive string, data binary"), "archives")


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """Every record of the archives: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    payload is null for revisits. A record that can't be parsed, or whose stored payload doesn't have its
    digest, fails the read.
    """
    bound_batches(spark)  # by bytes: an archive is about as large as a batch may be

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                out: list[list] = [[] for _ in range(7)]
                size = 0
                for r in records(data.as_py()):
                    head, body = parse_record(r)
                    kind = head["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    mark = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    lines, _, body = body.partition(b"\r\n\r\n")
                    stored = int(lines.rpartition(b"Content-Length: ")[2])
                    if kind == "response" and (digest(body) != mark or len(body) != stored):
                        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                    page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page")
                    row = (page and int(page), head.get("WARC-Target-URI"), kind, stored, mark, refers and int(refers), body if kind == "response" else None)
                    for c, x in zip(out, row, strict=True):
                        c.append(x)
                    size += len(body)
                    if size > 8 << 20:
                        yield batch(out)
                        out, size = [[] for _ in range(7)], 0
                yield batch(out)

    def batch(out: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    return archives.select("data").mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def export(spark: SparkSession, archives: DataFrame, folder: str) -> int:
    """Write each archive as <archive>.warc.zst into `folder` of any Hadoop file system, one at a time."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for r in archives.toLocalIterator():
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{r.archive}.warc.zst")
        out = p.getFileSystem(conf).create(p, True)
        out.write(bytearray(r.data))
        out.close()
        n += 1
    return n
