"""WARC archives written together with an index, and read back through it.

Every task writes an archive of its own, a gzip member per record, and returns one index row per record: archive,
offset, length, URL and digest. The index is a table, so records are selected before any archive is opened; the
selected rows are sorted by archive and offset, and neighbouring byte ranges are read in one request.

Archives get fresh names. A task that is run again writes a new archive and only its own rows reach the index, so an
archive left by a lost executor is never read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import materialise

REVISIT_BYTES = 1_000  # shorter payloads are always written
GAP = 1 << 16  # bytes between two records that are read along rather than asked for anew
READ_BYTES = 8 << 20  # bytes of one request, unless a record is longer
ARCHIVE_BYTES = 256 << 20  # a task starts a new archive beyond this size
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

INDEX = "archive string, offset long, length long, page_id {id}, url string, digest string, record_type string"


def _record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, revisit: bool) -> bytes:
    """One record; a revisit has the HTTP header but no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    lines = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], int, bytes | None]:
    """WARC header, payload length by the HTTP header, and the payload, None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    header = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(header["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
    return header, length, None if header["WARC-Type"] == "revisit" else payload


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row under ``folder`` and return the written index.

    ``folder`` is on storage that executors share and that Arrow can open. Of rows with equal payloads of at least
    1,000 bytes the one with the largest id is a response and the others revisit it; rows that repeat that id and
    payload are responses too, as are payloads whose ids are all NULL. A NULL html is an empty payload, a NULL URL
    leaves its header out. Which payloads are equal is decided by SHA-1 and length. Other columns are not read. Runs
    jobs.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size")
    )
    same = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max("page_id").alias("holder"), F.count("*").alias("_n"))
    holders = materialise(same.where("_n > 1 AND holder IS NOT NULL").drop("_n"), "repeated-payloads")
    joined = rows.join(holders, ["digest", "size"], "left")
    revisits = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    wanted = joined.select("page_id", "url", F.when(~revisits, F.col("payload")).alias("payload"), "size", "digest", "holder", revisits.alias("revisit"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        out, name, offset = None, "", 0
        for batch in batches:
            found = []
            for page_id, url, text, size, digest, holder, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or offset >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                # A revisit's payload is not sent here; only its length is written.
                plain = record(page_id, url, bytes(size) if revisit else text.encode(), digest, holder, revisit)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(plain) + packer.flush()
                out.write(member)
                found.append((name, offset, len(member), page_id, url, digest, "revisit" if revisit else "response"))
                offset += len(member)
            columns = list(zip(*found)) if found else [()] * 7
            types = [pa.string(), pa.int64(), pa.int64(), batch.schema.field(0).type, pa.string(), pa.string(), pa.string()]
            names = ["archive", "offset", "length", "page_id", "url", "digest", "record_type"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        if out is not None:
            out.close()

    return materialise(wanted.mapInArrow(written, INDEX.format(id=kind)), "warc-index")


def _requests(places: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted byte ranges put together: archive, first byte, end, and the ranges in it."""
    archive, first, end, held = "", 0, 0, []
    for name, offset, length in places:
        if held and (name != archive or offset - end > GAP or offset + length - first > READ_BYTES):
            yield archive, first, end, held
            held = []
        if not held:
            archive, first, end = name, offset, offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield archive, first, end, held


def read_records(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to[, payload])`` of the records in ``index``, any
    selection of a written index. Digest and length of a response are those of the payload as read; a digest that
    differs from the header's is an error. A revisit has those of the payload it refers to."""
    kind = index.schema["page_id"].dataType.simpleString()
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    schema = f"page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string{', payload string' if payloads else ''}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive, first, end, ranges in _requests(list(zip(*(c.to_pylist() for c in batch.columns)))):
                with store.open_input_file(f"{path}/{archive}") as file:
                    data = memoryview(file.read_at(end - first, first))
                found = []
                for offset, length in ranges:
                    header, size, payload = parse_record(zlib.decompress(data[offset - first : offset - first + length], 31))
                    digest = header["WARC-Payload-Digest"].removeprefix("sha1:")
                    if payload is not None and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"damaged record in {archive} at {offset}")
                    row = [header.get("X-Page-ID"), size, digest, header["WARC-Type"], header.get("X-Refers-To-Page-ID")]
                    found.append([*row, None if payload is None else payload.decode()] if payloads else row)
                types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()][: len(found[0])]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: len(found[0])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    records = places.mapInArrow(read, schema)
    return records.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
