"""WARC archives: a writer with revisit records, and a splittable reader.

Writing: one gzip member per record. Of pages with equal payloads the one with the largest
page_id is a response, the others are revisits that name it; a revisit keeps the HTTP head, so
the payload's length stays known.

Reading: archives are cut into byte ranges. A task scans its range for the gzip magic and takes a
place for a member's start if it inflates to a WARC header and the member ends at another
member or at the end of the file. It owns the records that start in its range and reads the last
of them past the end. No index is needed, and a file of any size is read in parallel.

Defined cases: null html is an empty payload; a null page_id gets a record without number and is
never named while its group has one; rows that repeat both page_id and payload are all
responses if theirs is the largest page_id; an empty table writes no archive and reads no
row; other columns are ignored. A damaged response payload raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import fresh_path, stored

SPLIT_BYTES = 8 << 20
MIN_BYTES = 0
DATE = "2020-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
RECORDS = "page_id long, record_type string, uri string, payload_bytes long, payload_digest string, refers_to long, payload binary, file string, position long"
_URN, _STEP = "urn:page:", 1 << 16


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system that holds a path, in whatever store the shared folder is."""
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = head + payload if refers_to is None else head
    name = lambda n: f"<{_URN}{'none' if n is None else n}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def decisions(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, refers_to."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    marked = pages.withColumn("_sha", F.sha1(F.col("html").cast("binary"))).withColumn("_size", F.octet_length("html"))
    kept = marked.groupBy("_sha").agg(F.max("page_id").alias("_keeper"))
    other = (F.col("_size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("_keeper"))
    return marked.join(kept, "_sha").select("page_id", "url", "html", F.when(other, F.col("_keeper")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes one archive per task; file, size, records of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = opened(folder)
        final = f"{base}/part-{task.partitionId():06d}.warc.gz"
        draft = f"{base}/.draft-{task.partitionId():06d}-{task.taskAttemptId()}"
        stream, size, n = None, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, refers = (batch.column(c)[i].as_py() for c in range(4))
                if stream is None:
                    fs.create_dir(base, recursive=True)
                    stream = fs.open_output_stream(draft)
                member = record(page_id, url, html.encode(), refers)
                stream.write(member)
                size, n = size + len(member), n + 1
        if stream is not None:
            stream.close()
            fs.move(draft, final)  # a repeated task writes the same rows: the archive appears whole or not at all
            yield pa.RecordBatch.from_pydict({"file": pa.array([f"{folder}/part-{task.partitionId():06d}.warc.gz"]), "size": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

    # sorted by digest's partition only; the order of rows in a file does not matter to readers
    return stored(decisions(pages, min_bytes).mapInArrow(run, "file string, size long, records long"), "warc-files")


def inflate(read, at: int, size: int) -> tuple[bytes, int] | None:
    """The member that starts at a place, and where it ends; None if none does."""
    gz, out = zlib.decompressobj(31), []
    try:
        while not gz.eof:
            if at >= size:
                return None
            step = read(at, min(_STEP, size - at))
            out.append(gz.decompress(step))
            if len(out) == 1 and not b"WARC/1.".startswith(out[0][:7]):
                return None
            at += len(step)
    except zlib.error:
        return None
    whole = b"".join(out)
    return (whole, at - len(gz.unused_data)) if whole.startswith(b"WARC/1.") else None


def header(member: bytes) -> tuple[dict[str, str], bytes] | None:
    """The record's named fields and its block."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    if not gap or "WARC-Type" not in fields or not fields.get("Content-Length", "").isdigit():
        return None
    return fields, rest[: int(fields["Content-Length"])]


def scan(read, start: int, end: int, size: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """The records that start in [start, end) of a file of that size; read(place, length)."""
    at, sure = start, start == 0
    window, base = b"", start
    while at < end:
        if not sure:
            # look for the next magic that begins in the range
            found = window.find(MAGIC, at - base)
            while found < 0 and base + len(window) < min(end + 2, size):
                tail = window[-2:]
                more = read(base + len(window), min(1 << 20, end + 2 - base - len(window), size - base - len(window)))
                base, window = base + len(window) - len(tail), tail + more
                found = window.find(MAGIC)
            if found < 0 or base + found >= end:
                return
            at = base + found
        got = inflate(read, at, size)
        parsed = got and header(got[0])
        if parsed and not sure and got[1] < size and read(got[1], 3) != MAGIC:
            parsed = None
        if parsed:
            yield at, *parsed
            at, sure = got[1], True
            continue
        if sure and at < size:
            window, base = b"", at
        at, sure = at + 1, False
        if at - base > len(window):
            window, base = b"", at


def _number(urn: str | None) -> int | None:
    text = (urn or "").strip("<>").removeprefix(_URN)
    return int(text) if text.lstrip("-").isdigit() else None


def read(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of archives (file, size), one task per byte range."""
    ranges = files.filter("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, path = opened(file)
                with fs.open_input_file(path) as f:
                    rows = []
                    for at, fields, block in scan(lambda a, n: f.read_at(n, a), start, min(start + split_bytes, size), size):  # noqa: B023
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                        digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
                        if fields["WARC-Type"] == "response" and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
                            raise ValueError(f"damaged payload at {at} of {file}")
                        rows.append((_number(fields.get("WARC-Record-ID")), fields["WARC-Type"], fields.get("WARC-Target-URI"), length, digest, _number(fields.get("WARC-Refers-To")), payload if with_payload else None, file, at))
                        if len(rows) == 256:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    n = max(1, ranges.count())
    return ranges.repartition(min(n, 100_000), "file", "start").mapInArrow(run, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
    names = [x.strip().split(" ")[0] for x in RECORDS.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def round_trip(pages: DataFrame, split_bytes: int = SPLIT_BYTES, min_bytes: int = MIN_BYTES, with_payload: bool = True) -> DataFrame:
    """Writes pages into the shared folder and reads the archives back."""
    spark = pages.sparkSession
    files = write(pages, fresh_path(spark, "warc"), min_bytes)
    return read(spark, files, split_bytes, with_payload)
