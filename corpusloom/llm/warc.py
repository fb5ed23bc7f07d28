"""WARC archives: deduplicating writer, and a reader that reassembles segmented records and chunked bodies."""

from __future__ import annotations

import gzip
import hashlib
import io
import posixpath
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import dealt, filesystem, offer, scratch, store, tidy

#: A header of our own, beside the standard ones.
PAGE_ID = "X-Page-Id"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string"
PIECE = f"{RECORD}, origin string, segment int, total long, block binary, error string"


def chunked(body: bytes, size: int = 8192) -> bytes:
    """Chunked transfer framing of a body."""
    parts = [b"%x\r\n%s\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunk(framed: bytes) -> bytes:
    """The body of chunked framing; raises ValueError where the framing is broken or ends early."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line is cut off")
        size = int(framed[at:end].split(b";", 1)[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(framed[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block, with transfer framing undone."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of HTTP header")
    return dechunk(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body


def record(kind: str, rid: str, block: bytes, headers: dict[str, str]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_records(page_id: int | None, serial: str, url: str | None, html: str | None, digest: str, revisit: bool, segment_bytes: int, date: str) -> Iterator[bytes]:
    """The records of one page: a revisit, a response, or a response and its continuation segments.

    Record ids are UUIDs of page, payload digest and place in the archives: unique, and the same when a task is retried.
    A revisit is of the profile that names its response by the payload digest.
    """
    payload = (html or "").encode()
    name = lambda part: f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}:{serial}:{part}')}"
    rid = name(1)
    headers = {"WARC-Date": date, "WARC-Target-URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%-._~"), "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha256:{digest}"}
    headers |= {} if page_id is None else {PAGE_ID: str(page_id)}
    if revisit:
        yield record("revisit", rid, HTTP_HEAD, headers | {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Date": date})
        return
    block = HTTP_HEAD + chunked(payload)
    if len(block) <= segment_bytes:
        yield record("response", rid, block, headers)
        return
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for n, piece in enumerate(pieces, 1):
        own = {"WARC-Segment-Number": str(n), "WARC-Date": date}
        if n == 1:
            yield record("response", rid, piece, headers | own)
        else:
            own |= {"WARC-Segment-Origin-ID": f"<{rid}>"} | ({"WARC-Segment-Total-Length": str(len(block))} if n == len(pieces) else {})
            yield record("continuation", name(n), piece, own)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where one should begin: {line[:40]!r}")
        headers = {}
        while (line := stream.readline().strip()):
            k, _, v = line.decode().partition(":")
            headers[k.strip().lower()] = v.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("record is cut off")
        yield headers, block


def _writer(root: str, segment_bytes: int, archive_bytes: int, level: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_, base = filesystem(root)
        store_.create_dir(base, recursive=True)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        made: list[tuple[str, int, int]] = []
        out = temp = None
        size = count = serial = 0

        def close():
            out.close()
            final = posixpath.join(base, f"pages-{part:06d}-{len(made):05d}.warc.gz")
            store_.move(temp, final)  # a later attempt writes the same records under the same name
            made.append((posixpath.join(root, posixpath.basename(final)), count, size))

        for batch in batches:
            for page, url, html, digest, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    temp = posixpath.join(base, f".pages-{part}-{attempt}-{len(made)}")
                    out, size, count = store_.open_output_stream(temp, compression=None), 0, 0
                data = b"".join(gzip.compress(r, level, mtime=0) for r in page_records(page, f"{part}-{serial}", url, html, digest, revisit, segment_bytes, date))
                out.write(data)
                size, count, serial = size + len(data), count + 1, serial + 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], ["path", "records", "bytes"])

    return write


def classify(pages: DataFrame, smallest: int = 100, salts: int = 16) -> DataFrame:
    """Distinct (page_id, digest) of the pages whose payload another page with a smaller page_id holds.

    Only digests cross the shuffle. They are counted before it, and the rows of a digest are dealt over ``salts``
    tasks when they meet their smallest page_id. Null html is an empty payload; a null page_id is after all others,
    and names no response; repeated rows of one page are no revisits of each other; an empty table gives none.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    slim = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).where(f"n >= {smallest}")
    slim = store(slim, "warc_digests")
    same = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1 and first is not null")
    same = same.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    dealt_ = slim.select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int").alias("salt"))
    return dealt_.join(same, ["digest", "salt"]).where("page_id > first or page_id is null").select("page_id", "digest").distinct()


def write_archives(pages: DataFrame, root: str, segment_bytes: int = 32 << 10, archive_bytes: int = 128 << 20, level: int = 1) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); returns the archives (path, records, bytes).

    Of pages with equal payloads of at least 100 bytes, that with the smallest page_id is a response and the others
    are revisits of it; smaller ones are all responses. Null html is an empty payload, a null url an empty target;
    rows that repeat give repeated records. Blocks over ``segment_bytes`` are written as segments. All records bear the
    date of this call. Each task writes under a name of its own attempt and renames, so a retried task replaces its file.
    """
    revisits = classify(pages)
    rows = pages.select("page_id", "url", "html", F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256).alias("digest"))
    rows = rows.join(revisits.withColumnRenamed("page_id", "_page").withColumnRenamed("digest", "_digest"), F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    rows = rows.select("page_id", "url", "html", "digest", F.col("_digest").isNotNull().alias("revisit"))
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return rows.mapInArrow(tidy(_writer(root, segment_bytes, archive_bytes, level, date)), "path string, records long, bytes long")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of archives: whole ones as results, segments as pieces."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("error", pa.string())])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store_, at = filesystem(path)
            rows, held = [], 0
            with store_.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 20)) as stream:
                for headers, block in read_records(stream):
                    row = _row(headers, block)
                    rows.append(row)
                    held += len(row["block"] or b"")
                    if len(rows) >= 2000 or held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)


def _row(headers: dict[str, str], block: bytes) -> dict:
    kind, rid, page = headers["warc-type"], headers["warc-record-id"], headers.get(PAGE_ID.lower())
    row = dict.fromkeys(("page_id", "payload_bytes", "payload_digest", "record_type", "origin", "segment", "total", "block", "error")) | {"page_id": int(page) if page else None}
    if kind == "revisit":
        return row | {"payload_digest": headers["warc-payload-digest"].partition(":")[2], "record_type": kind}
    if "warc-segment-number" in headers:
        total = headers.get("warc-segment-total-length")
        return row | {"record_type": "response", "payload_digest": headers.get("warc-payload-digest"), "origin": headers.get("warc-segment-origin-id", rid), "segment": int(headers["warc-segment-number"]), "total": int(total) if total else None, "block": block}
    return row | _result(block, headers.get("warc-payload-digest")) | {"record_type": kind}


def _result(block: bytes, digest: str | None = None) -> dict:
    try:
        payload = http_payload(block)
    except ValueError as e:
        return {"error": str(e)}
    own = hashlib.sha256(payload).hexdigest()
    wrong = digest is not None and digest.partition(":")[2] != own
    return {"payload_bytes": len(payload), "payload_digest": own, "error": "payload digest differs" if wrong else None}


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a record: its segments joined in order, their number and total length and its digest verified."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("error", pa.string())])
    for batch in batches:
        rows = []
        for page, digest, numbers, total, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row = {"page_id": page, "payload_bytes": None, "payload_digest": None, "record_type": "response", "error": None}
            if numbers != list(range(1, len(numbers) + 1)):
                row["error"] = "segments are missing or doubled"
            elif total != sum(map(len, blocks)):
                row["error"] = "total length differs"
            else:
                row |= _result(b"".join(blocks), digest)
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives (path): page_id, payload_bytes, payload_digest, record_type, refers_to, error.

    Continuation records are grouped by the identifier of their origin, put in order of their segment numbers and
    checked against the total length; then chunked framing is undone. A revisit meets the response with its payload
    digest, whose smallest page_id and whose length it gets. A record that fails a check keeps its row, with the reason
    in ``error``; a broken response has a null digest. No archives, or empty ones, give no row.
    """
    pieces = store(dealt(archives.select("path"), "path").mapInArrow(tidy(_parse), PIECE), "warc_records")
    slim = ("page_id", "payload_bytes", "payload_digest", "record_type", "error")
    whole = pieces.where("segment is null and record_type <> 'revisit'").select(*slim)
    grouped = pieces.where("segment is not null").groupBy("origin").agg(F.max("page_id").alias("page_id"), F.max("payload_digest").alias("digest"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("s"), F.max("total").alias("total"))
    grouped = grouped.select("page_id", "digest", F.col("s.segment").alias("numbers"), "total", F.col("s.block").alias("blocks"))
    responses = whole.unionByName(grouped.mapInArrow(tidy(_reassemble), f"{RECORD}, error string"))
    responses = store(responses, "warc_responses")
    held = responses.where("error is null and page_id is not null").groupBy(F.col("payload_digest").alias("digest")).agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("bytes"))
    revisits = pieces.where("segment is null and record_type = 'revisit'").select("page_id", "payload_digest", "record_type")
    revisits = revisits.join(offer(held, 1_000_000), F.col("payload_digest") == F.col("digest"), "left")
    lost = F.when(F.col("refers_to").isNull(), F.lit("no response holds the payload"))
    revisits = revisits.select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", lost.alias("error"))
    return responses.select(*slim[:4], F.lit(None).cast("long").alias("refers_to"), "error").unionByName(revisits)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as WARC archives in the shared folder and read them back."""
    root = scratch(pages.sparkSession, "warc")
    archives = store(write_archives(pages, root), "warc_archives")
    return read_archives(archives)
