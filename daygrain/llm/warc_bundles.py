"""WARC records in seekable Zstandard bundles.

A task streams its rows into bundles: a bundle is a
file of independent Zstandard frames, each of whole WARC records, closed by a skippable frame
with the seek table of the seekable format (compressed and plain size of each frame). The index has,
for each record, the bundle, the frame's offset and the record's place within the plain frame, so one
record is read with one seek and one frame.

A payload that several rows share is stored once: the smallest id is the response, later ids are
revisit records that refer to it. Only digests meet in the shuffle that finds them; the join that tells each row whether it is one
moves the payloads once, unless Spark broadcasts the revisits. Bundles get a
new name on every attempt and the index, which Spark commits, names the files that count:
a lost task leaves a file that nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from daygrain.llm.common import as_table, fresh, scratch_path

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
LEVEL = 3
DATE = "2020-01-01T00:00:00Z"
# Fixed values of the seekable format: the skippable frame's and the footer's magic numbers.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

INDEX = "page_id long, bundle string, frame int, frame_offset long, frame_size long, record_offset long, record_size long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head alone, whose Content-Length is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    name = lambda i: "<urn:page:null>" if i is None else f"<urn:page:{i}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        # a line break in a url would end the header line
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The columns of RECORD from one record; a response's digest and size are taken from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda k: None if fields.get(k, "<urn:page:null>") == "<urn:page:null>" else int(fields[k][10:-1])
    kind = fields["WARC-Type"]
    url = fields.get("WARC-Target-URI")
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and digest(payload) != said:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    return {"page_id": number("WARC-Record-ID"), "record_type": kind, "payload_digest": said, "refers_to": number("WARC-Refers-To"),
            "url": None if url is None else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url),
            "payload_bytes": len(payload) if kind == "response" else int(re.search(rb"Content-Length: (\d+)", http)[1]),
            "payload": payload if kind == "response" else None}


class Bundle:
    """Writes one seekable file; its records' places are known once their frame is closed."""

    def __init__(self, folder: str, filesystem: fs.FileSystem, frame_bytes: int):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.out = filesystem.open_output_stream(self.path, compression=None)
        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self.frame_bytes, self.frames, self.size = frame_bytes, [], 0
        self.waiting, self.plain, self.places = [], 0, []

    def add(self, key, raw: bytes) -> list[tuple]:
        self.places.append((key, self.plain, len(raw)))
        self.waiting.append(raw)
        self.plain += len(raw)
        return self.flush() if self.plain >= self.frame_bytes else []

    def flush(self) -> list[tuple]:
        if not self.waiting:
            return []
        packed = self.compress(b"".join(self.waiting))
        self.out.write(packed)
        done = [(key, self.path, len(self.frames), self.size, len(packed), at, n) for key, at, n in self.places]
        self.frames.append((len(packed), self.plain))
        self.size += len(packed)
        self.waiting, self.plain, self.places = [], 0, []
        return done

    def close(self) -> list[tuple]:
        done = self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0, SEEKABLE))
        self.out.close()
        return done


def seek_table(raw: bytes) -> list[tuple[int, int, int]]:
    """(offset, packed size, plain size) of each frame, from a bundle's footer."""
    n, flags, magic = struct.unpack("<IBI", raw[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", raw[-9 - 8 * n:-9]):
        out.append((at, packed, plain))
        at += packed
    return out


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64()),
                        ("frame_size", pa.int64()), ("record_offset", pa.int64()), ("record_size", pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, schema.types)], schema=schema)


def _writer(folder: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = fs.FileSystem.from_uri(folder)
        bundle = None
        for batch in batches:
            done = []
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to", "is_revisit"))):
                page_id, url, html, refers_to, is_revisit = (x.as_py() for x in row)
                bundle = bundle or Bundle(path, filesystem, frame_bytes)
                done += bundle.add(page_id, record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, is_revisit))
                if bundle.size >= bundle_bytes:
                    done += bundle.close()
                    bundle = None
            if done:
                yield _index_batch(done)
        if bundle is not None:
            yield _index_batch(bundle.close())
    return run


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        filesystem, _ = fs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor().decompress
        path = file = place = None
        for batch in batches:
            out, size = [], 0
            for row in batch.to_pylist():
                if row["bundle"] != path:
                    path, place = row["bundle"], None
                    if file is not None:
                        file.close()
                    file = filesystem.open_input_file(path)
                if place != row["frame_offset"]:
                    place = row["frame_offset"]
                    file.seek(place)
                    plain = unpack(file.read(row["frame_size"]))
                out.append(parse_record(plain[row["record_offset"]:row["record_offset"] + row["record_size"]]))
                size += row["record_size"]
                if size > 1 << 24:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if file is not None:
            file.close()
    return run


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes every row as a record below ``folder`` (a new one in the shared folder by default); returns the index.

    Of rows with equal payloads those with the smallest id are responses, later ids revisit them; null
    ids come after all others and are responses where no other id has their payload. A null
    html is an empty payload. Repeated rows are records of their own. An empty table writes no bundle.
    ``folder`` is a uri that every executor can write (file, hdfs, s3, gs).
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    folder = folder if "://" in folder else re.sub(r"^(file:)?/+", "file:///", folder)
    filesystem, path = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(path, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    digests = as_table(rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha1"), F.octet_length("html").alias("size")))
    first = digests.groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    later = (digests.join(first, ["sha1", "size"]).where("page_id is null or page_id > first")
             .select(F.col("page_id").alias("revisit_id"), F.col("sha1").alias("revisit_sha1"), "first").distinct())
    # a row is found by its id and digest: rows that share an id may have different payloads
    tagged = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).join(
        later, F.col("page_id").eqNullSafe(F.col("revisit_id")) & (F.col("sha1") == F.col("revisit_sha1")), "left")
    dealt = tagged.select("page_id", "url", "html", F.col("first").alias("refers_to"), F.col("first").isNotNull().alias("is_revisit"))
    return as_table(dealt.mapInArrow(_writer(folder, frame_bytes, bundle_bytes), INDEX)).withColumn("folder", F.lit(folder))


def read_warc(index: DataFrame) -> DataFrame:
    """The records that ``index`` names, read back from their bundles by seeking; the columns of RECORD."""
    first = index.select("folder").first()
    if first is None:
        return index.sparkSession.createDataFrame([], RECORD)
    # a stated number of tasks: the index is small, what it points to is not
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = index.drop("folder").repartition(tasks, "bundle").sortWithinPartitions("bundle", "frame_offset", "record_offset")
    return places.select("bundle", "frame_offset", "frame_size", "record_offset", "record_size").mapInArrow(_reader(first["folder"]), RECORD)
