"""Operator 2: WARC archives, written by the executors, read back by a salvage reader.

Writing: every row gets one record in a gzip member of its own. Of rows with equal payloads of REVISIT_BYTES or more, that
with the largest id is the response and the others revisit it. Tasks roll archives at ROLL_BYTES and rename a finished
file into place, so a task that runs again replaces its own files.

Reading: a member or record that fails a check (gzip CRC, version line, length, closing blank lines, block digest) is
given up; the reader searches for the next gzip magic or WARC version line that starts a valid record, goes on there, and
reports the bytes between as a quarantined gap. Within a member's plain bytes it does the same. Of a member that breaks off
or fails its CRC, records before the last one begun are kept. No valid record after a gap is lost.

Nulls: a null payload is empty; a null url is empty; a row with null id is always a response. Rows repeated with id and
payload are all responses if theirs is the largest id. Other columns are ignored, whatever their names; an empty table
writes no archive. A very long payload is one record; an archive is read whole, so ROLL_BYTES bounds a reader's memory, a
record beyond it apart. A revisit without a readable length has payload_bytes null.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import saved, scratch, sized_broadcast, sliced, table

REVISIT_BYTES = 1000
ROLL_BYTES = 8 << 20
#: Groups of equal payloads up to this many are broadcast (a hash and an id each); more are joined by shuffle.
BROADCAST_GROUPS = 200_000
VERSION = b"WARC/1."
MAGIC = b"\x1f\x8b\x08"
RECORDS = "archive string, kind string, start long, stop long, reason string, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(record_id: str, url: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC record: a response, or a revisit that keeps the headers and digest of the payload but not its bytes."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1",
        "WARC-Type: " + ("revisit" if refers_to else "response"),
        f"WARC-Record-ID: <urn:page:{record_id}>",
        "WARC-Target-URI: " + "".join(c for c in url if c >= " "),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: {_sha1(payload)}",
        f"WARC-Block-Digest: {_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def parse_record(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record that starts at `at`; ValueError says which check fails."""
    if data[at : at + len(VERSION)] != VERSION:
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("headers don't end")
    head = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    try:
        size = int(head["content-length"])
    except (KeyError, ValueError):
        raise ValueError("no content length") from None
    block = data[end + 4 : end + 4 + size]
    if size < 0 or len(block) != size:
        raise ValueError("block is cut short")
    if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError("record isn't closed")
    if (digest := head.get("warc-block-digest", "")).startswith("sha1:") and digest != _sha1(block):
        raise ValueError("block digest differs")
    return head, block, end + 8 + size


def _member_at(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """Plain bytes and end of the gzip member; with an error, what came out before it."""
    z, out, view, step = zlib.decompressobj(31), [], memoryview(data), 1 << 16
    while not z.eof and at < len(data):
        before = z.copy()
        try:
            out.append(z.decompress(view[at : at + step]))
        except zlib.error as e:
            if step == 1:
                return b"".join(out), at, f"gzip: {str(e)[:60]}"
            z, step = before, 1  # the error is within these bytes: take what comes before it
            continue
        at = min(at + step, len(data)) - len(z.unused_data)
    return b"".join(out), at, None if z.eof else "gzip member is cut short"


def _inside(plain: bytes) -> list[tuple[str | None, dict | None, bytes | None]]:
    """Records of a member's plain bytes, and its gaps as reasons with their offsets."""
    out, p, gap, reason = [], 0, None, ""
    while p < len(plain):
        try:
            head, block, end = parse_record(plain, p)
        except ValueError as e:
            if gap is None:
                gap, reason = p, str(e)
            p = plain.find(VERSION, p + 1)
            p = len(plain) if p < 0 else p
            continue
        if gap is not None:
            out.append((f"{reason} (plain bytes {gap} to {p})", None, None))
            gap = None
        out.append((None, head, block))
        p = end
    if gap is not None:
        out.append((f"{reason} (plain bytes {gap} to {len(plain)})", None, None))
    return out


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict | None, bytes | None]]:
    """(start, stop, reason, headers, block) of every record; of a gap (reason is set), headers and block are None. A gap
    within a member has the member's start and stop. Of a damaged member, records before the damage come first, then its gap."""

    def read(at: int) -> tuple[list[tuple[str | None, dict | None, bytes | None]], int, str | None]:
        if data[at : at + 3] != MAGIC:
            head, block, end = parse_record(data, at)
            return [(None, head, block)], end, None
        plain, end, error = _member_at(data, at)
        if error:  # the last record begun is the one that the damage touches: it is given up
            return [x for x in _inside(plain[: max(0, plain.rfind(VERSION))]) if x[1] is not None], end, error
        got = _inside(plain)
        if got and all(x[1] is None for x in got):
            raise ValueError(got[0][0])
        return got, end, None

    at, gap, reason, size = 0, None, "", len(data)
    ahead = [-1, -1]
    while at < size:
        try:
            got, end, error = read(at)
            if error:
                yield from ((at, end, *x) for x in got)
                raise ValueError(error)
        except ValueError as e:
            if gap is None:
                gap, reason = at, str(e)
            for i, mark in enumerate((MAGIC, VERSION)):  # a mark that lies ahead isn't searched for again
                if ahead[i] <= at:
                    found = data.find(mark, at + 1)
                    ahead[i] = size if found < 0 else found
            at = min(ahead)
            continue
        if gap is not None:
            yield gap, at, reason, None, None
            gap = None
        yield from ((at, end, *x) for x in got)
        at = end
    if gap is not None:
        yield gap, size, reason, None, None


def _hex(digest: str) -> str | None:
    try:
        return base64.b32decode(digest.partition(":")[2]).hex()
    except ValueError:
        return None


def _urn(value: str | None) -> str | None:
    return value.removeprefix("<urn:page:").removesuffix(">") if value else None


def _write(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        to, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        task = TaskContext.get()
        done, held, size = [], [], 0

        def roll_out() -> None:
            nonlocal held, size
            name = f"part-{task.partitionId():06d}-{len(done):04d}.warc.gz"
            with to.open_output_stream(tmp := f"{path}/.{name}.{task.taskAttemptId()}") as out:
                for x in held:
                    out.write(x)
            to.move(tmp, f"{path}/{name}")
            done.append((name, len(held), size))
            held, size = [], 0

        for batch in sliced(batches, 100):
            for page, url, html, keep in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "keep")), strict=True):
                refers = str(keep) if keep is not None and page is not None and keep != page else None
                held.append(member(record_bytes("" if page is None else str(page), url or "", (html or "").encode("utf-8", "surrogatepass"), refers)))
                size += len(held[-1])
                if size >= roll:
                    roll_out()
        if held:
            roll_out()
        yield pa.RecordBatch.from_pylist([dict(zip(("archive", "records", "bytes"), x, strict=True)) for x in done], pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", roll: int = ROLL_BYTES) -> DataFrame:
    """Write all rows into .warc.gz files in folder; returns the manifest (archive, records, bytes), which is saved."""
    from pyarrow import fs

    to, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    to.create_dir(path, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"))
    rows = rows.withColumn("sha", F.when(F.octet_length("payload") >= REVISIT_BYTES, F.unhex(F.sha1("payload"))))
    groups = saved(rows.where("sha is not null").groupBy("sha").agg(F.max("id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("sha", "keep"), "payload-groups")
    joined = rows.join(sized_broadcast(groups, BROADCAST_GROUPS), "sha", "left").select("id", "url", "payload", "keep")
    return saved(joined.mapInArrow(_write(folder, roll), "archive string, records long, bytes long"), "manifest")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    for batch in batches:
        for path, data in zip(batch["path"], batch["content"], strict=True):
            rows, size = [], 0
            for start, stop, reason, head, block in salvage(bytes(data)):
                if head is None:
                    rows.append((path, "gap", start, stop, reason, *[None] * 7))
                    continue
                http, _, body = block.partition(b"\r\n\r\n")
                kind, length = head.get("warc-type"), None
                if kind == "revisit":
                    length = next((int(v) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:") and (v := x.partition(b":")[2].strip()).isdigit() and len(v) < 19), None)
                    digest, body = _hex(head.get("warc-payload-digest", "")), None
                else:
                    digest, length = hashlib.sha1(body).hexdigest(), len(body)
                rows.append((path, "record", start, stop, None, _urn(head.get("warc-record-id")), kind, head.get("warc-target-uri"), _urn(head.get("warc-refers-to")), digest, length, body))
                size += len(body or b"")
                if size > 32 << 20:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)


def read_archives(spark: SparkSession, folder: str, glob: str = "*.warc*") -> DataFrame:
    """Records and gaps of all archives in folder, plain or gzip. An archive is read whole by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select("path", "content").mapInPandas(_read, RECORDS)


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), folder)
    found = read_archives(spark, folder).where("kind = 'record'")
    return found.select(F.expr("try_cast(record_id as bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(refers_to as bigint)").alias("refers_to"))


SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
q as (select page_id, strlen(body) as n, sha1(body) as d,
      case when strlen(body) >= 1000 then max(page_id) over (partition by sha1(body)) else page_id end as keep from p)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
       case when keep = page_id then 'response' else 'revisit' end as record_type,
       case when keep = page_id then null else keep end as refers_to
from q"""
