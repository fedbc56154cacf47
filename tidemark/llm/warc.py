"""WARC archives: a writer that stores equal payloads once and a reader that salvages damaged files.

Files hold one gzip member per record (or plain records). The reader checks each record's member checksum, version
line, lengths and block digest. After a failed check it looks for the next member or version line at which a whole
record passes, goes on there, and reports the skipped bytes as a gap.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.files import new_file, resolve, shared_folder, written
from tidemark.llm.text import runs

ROLL_BYTES = 64 << 20
SPLIT_BYTES = 64 << 20
_CHUNK = 1 << 16
_HEAD_LIMIT = 1 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_uri(page_id: int | None) -> str:
    """The record id of a page; pages without an id get a random one."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit record of the page ``refers_to`` without the payload itself."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_uri(page_id)}",
            f"WARC-Date: {date}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"\s+", "%20", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_uri(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               least: int = 100, compress: bool = True) -> DataFrame:
    """Write one record per row to ``folder`` and return the manifest (path, n_records, bytes).

    Of the rows with equal payloads of at least ``least`` bytes the smallest id becomes a response and the other ids
    revisit it; all else are responses. A null payload is empty. Rows without an id are responses; a row repeated
    with the same id and payload is written as often as it occurs, each time with the type of its id. Other columns
    are ignored. An empty table gives an empty manifest.
    """
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # Narrow columns decide on revisits; the payload is then dealt by page, never by digest.
    keyed = rows.filter((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest").distinct()
    first = (keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").drop("n"))
    revisits = keyed.join(first, "digest").filter("page_id > refers_to")
    plan = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, stream, n, size = None, None, 0, 0
        for run in runs(batches, "payload", 4 << 20):
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in run.columns)):
                if stream is None:
                    path, stream = new_file(folder, ".warc.gz" if compress else ".warc")
                raw = record(page_id, url, payload, digest, refers_to)
                if compress:
                    member = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = member.compress(raw) + member.flush()
                stream.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= ROLL_BYTES:
                    stream.close()
                    yield pa.RecordBatch.from_pylist([{"path": path, "n_records": n, "bytes": size}])
                    stream, n, size = None, 0, 0
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "n_records": n, "bytes": size}])

    return written(plan.mapInArrow(write, "path string, n_records long, bytes long"), f"{folder}/manifest")


class Damaged(Exception):
    """A record that fails a check."""


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/1\.\d", lines[0]):
        raise Damaged("no version line")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("malformed header")
        out[name.strip().lower()] = value.strip()
    return out


def _length(headers: dict[str, str]) -> int:
    if not headers.get("content-length", "").isdigit():
        raise Damaged("no content length")
    return int(headers["content-length"])


def _checked(headers: dict[str, str], block: bytes) -> tuple[dict[str, str], bytes]:
    algorithm, _, value = headers.get("warc-block-digest", "").partition(":")
    if algorithm == "sha256" and hashlib.sha256(block).hexdigest() != value:
        raise Damaged("block digest differs")
    return headers, block


def _member(file, at: int, size: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the gzip member at ``at``."""
    inflate, out, got = zlib.decompressobj(31), [], 0
    start = b""
    while not inflate.eof:
        raw = file.read_at(min(_CHUNK, size - at - got), at + got)
        if not raw:
            raise Damaged("member cut short")
        try:
            out.append(inflate.decompress(raw))
        except zlib.error as e:
            raise Damaged("member checksum or coding") from e
        got += len(raw)
        if len(start) < 7:
            start += out[-1][:7]
            if not b"WARC/1.".startswith(start[:7]):
                raise Damaged("no version line")
    end = at + got - len(inflate.unused_data)
    head, sep, rest = b"".join(out).partition(b"\r\n\r\n")
    if not sep:
        raise Damaged("headers cut short")
    headers = _headers(head)
    n = _length(headers)
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise Damaged("content length differs")
    return *_checked(headers, rest[:n]), end


def _plain(file, at: int, size: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the plain record at ``at``."""
    head = b""
    while (cut := head.find(b"\r\n\r\n")) < 0:
        if head and not head.startswith(b"WARC/1."[:len(head)]):
            raise Damaged("no version line")
        raw = file.read_at(min(_CHUNK, size - at - len(head)), at + len(head))
        if not raw or len(head) > _HEAD_LIMIT:
            raise Damaged("headers cut short")
        head += raw
    headers = _headers(head[:cut])
    n, begin = _length(headers), at + cut + 4
    if begin + n + 4 > size:
        raise Damaged("content length differs")
    block = file.read_at(n + 4, begin)
    if block[n:] != b"\r\n\r\n":
        raise Damaged("content length differs")
    return *_checked(headers, block[:n]), begin + n + 4


def _next(file, mark: bytes, at: int, to: int) -> int:
    """Place of the next ``mark`` in [at, to), or ``to``."""
    while at < to:
        raw = file.read_at(min(1 << 20, to - at + len(mark) - 1), at)
        found = raw.find(mark)
        if found >= 0:
            return min(at + found, to)
        if len(raw) < len(mark):
            return to
        at += len(raw) - len(mark) + 1
    return to


def _reach(file, take, mark: bytes, start: int, size: int) -> int:
    """End of the last whole record that begins before ``start``; 0 if there is none."""
    while start > 0:
        begin = max(start - (1 << 20), 0)
        raw = file.read_at(min(start - begin + len(mark) - 1, size - begin), begin)
        found = raw.rfind(mark)
        while found >= 0:
            try:
                return take(file, begin + found, size)[2]
            except Damaged:
                found = raw.rfind(mark, 0, found + len(mark) - 1)
        start = begin
    return 0


def salvage(file, size: int, start: int, to: int, packed: bool) -> Iterator[tuple]:
    """What begins in [start, to): ("record", offset, end, headers, block) and ("gap", offset, end, reason).

    Splits of one file share no record: each takes those that begin in it. A gap belongs to the split of the record behind it, or
    to the last one if none follows: that split looks back for the end of the last whole record before itself. So records and
    gaps of all splits together make up the file, wherever the damage lies.
    """
    take, mark = (_member, b"\x1f\x8b\x08") if packed else (_plain, b"WARC/1.")
    at = _next(file, mark, start, to) if start else 0
    end, why = None, ""  # end of the record before, of this split or (once looked up) of an earlier one
    while at < to:
        try:
            headers, block, stop = take(file, at, size)
        except Damaged as e:
            why = why or str(e)
            at = _next(file, mark, at + 1, to)
            continue
        if end is None:
            end = _reach(file, take, mark, start, size)
        if end < at:
            yield "gap", end, at, why or "no record begins here"
        yield "record", at, stop, headers, block
        at = end = stop
        why = ""
    if to == size:
        if end is None:
            end = _reach(file, take, mark, start, size)
        if end < size:
            yield "gap", end, size, why or "no record begins here"


def _payload(headers: dict[str, str], block: bytes) -> tuple[int | None, str | None, bytes | None]:
    """(bytes, digest, payload) of the full payload; of a revisit as its headers tell."""
    head, _, body = block.partition(b"\r\n\r\n") if "http" in headers.get("content-type", "") else (b"", b"", block)
    if headers.get("warc-type") == "revisit":
        told = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
        return int(told[1]) if told else None, headers.get("warc-payload-digest", "").removeprefix("sha256:") or None, None
    return len(body), hashlib.sha256(body).hexdigest(), body


READ_SCHEMA = ("kind string, path string, offset long, length long, reason string, page_id long, url string, payload_bytes long, "
               "payload_digest string, record_type string, refers_to long, payload binary")


def read_warc(files: DataFrame, payloads: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records and gaps of the files named in ``files`` (path, bytes).

    ``kind`` is record or gap. A gap has its place and the first reason its split met. Records and gaps together make up every
    file byte by byte, also where damage crosses splits or fills whole ones; each damaged stretch is one gap.
    Plain files are read by one task each, packed ones in splits.
    """
    whole = F.col("path").endswith(".warc")
    spans = files.select("path", F.col("bytes").alias("size"), F.explode(F.when(whole | (F.col("bytes") <= split_bytes), F.array(F.lit(0).cast("long")))
                         .otherwise(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes)))).alias("at"))
    spans = spans.withColumn("to", F.when(whole, F.col("size")).otherwise(F.least("size", F.col("at") + split_bytes)))
    schema = pa.schema([("kind", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                        ("reason", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, size, at, to in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = resolve(path)
                with system.open_input_file(name) as file:
                    for item in salvage(file, size, at, to, not path.endswith(".warc")):
                        row = {"kind": item[0], "path": path, "offset": item[1], "length": item[2] - item[1]}
                        if item[0] == "gap":
                            row["reason"] = item[3]
                        else:
                            headers = item[3]
                            n, digest, body = _payload(headers, item[4])
                            number = lambda k: int(headers[k]) if re.fullmatch(r"-?\d+", headers.get(k, "")) else None
                            row |= {"page_id": number("x-page-id"), "url": headers.get("warc-target-uri"), "payload_bytes": n,
                                    "payload_digest": digest, "record_type": headers.get("warc-type"),
                                    "refers_to": number("x-refers-to-page-id"), "payload": body if payloads else None}
                            held += len(body or b"") * payloads
                        rows.append(row)
                        if len(rows) >= 2000 or held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # One task per span: without a number, so few rows would end in one task.
    return spans.select("path", "size", "at", "to").repartition(max(1, spans.count())).mapInArrow(read, READ_SCHEMA)


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read their records and gaps back."""
    return read_warc(write_warc(pages, shared_folder(spark, "warc")), payloads=False)
