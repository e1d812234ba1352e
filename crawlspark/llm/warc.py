"""WARC archives with an index that is written first.

Each task writes the records of its pages to archives of its own, a gzip member per
record, and the index gets archive, offset, length, URL and digest of every record.
Reading selects index rows, sorts them by archive and offset, coalesces ranges that lie
close together and reads those bytes only.

Of records with equal payloads (SHA-1 and length) of `min_revisit_bytes` at least, the
one with the largest page_id is the response and the others are revisits of it.

Scale: payloads are hashed where they are read and never shuffled unless the groups
of equal payloads are too many to broadcast; an archive is written by one task and
named after its attempt, so a task that runs again leaves only an unused file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, load, shuffle_parts, text_slices

INDEX = "page_id long, url string, archive string, offset long, length long, payload_digest string, record_type string, refers_to long"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url: str | None, payload: bytes, digest: bytes, refers_to, date: str) -> bytes:
    """One WARC record. A revisit keeps the HTTP header of the response and has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header (names in lower case) and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    warc = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(warc["content-length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    return warc, {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode("latin-1").split("\r\n")[1:])}, payload


def _writer(folder: str, date: str, roll_bytes: int, level: int):
    def run(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        out, name, offset, number = None, "", 0, 0
        try:
            for batch in text_slices(batches, 2):
                rows = []
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    payload = (html or "").encode()
                    sha = hashlib.sha1(payload).digest()
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = packer.compress(record(page_id, url, payload, sha, refers_to, date)) + packer.flush()
                    if out is None or offset >= roll_bytes:
                        if out is not None:
                            out.close()
                        name, offset = f"part-{task.partitionId():06d}-{number:03d}-{task.taskAttemptId()}.warc.gz", 0
                        number += 1
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(data)
                    rows.append((page_id, url, name, offset, len(data), sha.hex(), "response" if refers_to is None else "revisit", refers_to))
                    offset += len(data)
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["page_id", "url", "archive", "offset", "length", "payload_digest", "record_type", "refers_to"])
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, work: Workspace, min_revisit_bytes: int = 1000, broadcast_groups: int = 200_000, date: str = "2024-01-01T00:00:00Z", roll_bytes: int = 1 << 30, level: int = 6) -> DataFrame:
    """Write pages (page_id, url, html) to archives under the workspace and return the index.

    Null html is an empty payload; a null url leaves the record without a target. Pages
    with one page_id and equal payloads are all written as responses; a null page_id ranks
    below all others. Payloads of any length are written whole; an empty table writes no
    archive. Other columns are not read.
    """
    from pyarrow import fs

    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    key = [F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes")]
    groups = pages.select("page_id", *key).where(F.col("bytes") >= min_revisit_bytes).groupBy("sha", "bytes").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = work.save(groups, "groups")
    small = groups.limit(broadcast_groups + 1).count() <= broadcast_groups  # about 80 bytes each
    with_key = pages.select("*", *key)
    joined = with_key.join(F.broadcast(groups) if small else groups, ["sha", "bytes"], "left")
    decided = joined.select("page_id", "url", "html", F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id")).alias("refers_to"))
    store, path = fs.FileSystem.from_uri(f"{work.path}/archives")
    store.create_dir(path, recursive=True)
    return work.save(decided.mapInArrow(_writer(f"{work.path}/archives", date, roll_bytes, level), INDEX), "index")


def _reader(folder: str, gap: int, most: int, with_payload: bool):
    def run(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        held: tuple[str, object] = ("", None)
        for batch in batches:
            wanted = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            refers = batch.column(3).to_pylist()
            page_ids = batch.column(4).to_pylist()
            i = 0
            while i < len(wanted):
                archive, start, length = wanted[i]
                j, end = i + 1, start + length
                while j < len(wanted) and wanted[j][0] == archive and wanted[j][1] - end <= gap and wanted[j][1] + wanted[j][2] - start <= most:
                    end = max(end, wanted[j][1] + wanted[j][2])
                    j += 1
                if held[0] != archive:
                    if held[1] is not None:
                        held[1].close()
                    held = (archive, store.open_input_file(f"{path}/{archive}"))
                data = held[1].read_at(end - start, start)
                rows = []
                for (_, offset, n), refers_to, page_id in zip(wanted[i:j], refers[i:j], page_ids[i:j]):
                    warc, http, payload = parse_record(zlib.decompress(data[offset - start : offset - start + n], 31))
                    digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                    kind, size = warc["warc-type"], int(http["content-length"])
                    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"{archive} at {offset}: the payload is not what was written")
                    if warc["warc-record-id"] != _record_id(page_id) or kind == "revisit" and warc["warc-refers-to"] != _record_id(refers_to):
                        raise ValueError(f"{archive} at {offset}: another record than the index names")
                    rows.append((page_id, size, digest, kind, refers_to, warc.get("warc-target-uri")) + (payload.decode() if kind == "response" else None,) * with_payload)
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names[: 6 + with_payload])
                i = j
        if held[1] is not None:
            held[1].close()

    return run


def read_records(selected: DataFrame, work: Workspace, gap: int = 64 << 10, most: int = 8 << 20, with_payload: bool = False) -> DataFrame:
    """The records of selected index rows, read as coalesced byte ranges and verified.

    Ranges at most `gap` bytes apart are one read of up to `most` bytes.
    """
    n = shuffle_parts(selected.sparkSession)
    ranges = selected.select("archive", "offset", "length", "refers_to", "page_id").repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset")
    return ranges.mapInArrow(_reader(f"{work.path}/archives", gap, most, with_payload), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload string" * with_payload)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "warc")
    return read_records(write_archives(load(spark, sf_dir, "pages"), work), work).drop("url")


OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM g
"""
