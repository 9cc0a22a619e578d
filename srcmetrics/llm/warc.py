"""WARC archives with an index of byte ranges, and reads of selected records through it."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcmetrics.llm.store import bounded, shared_folder, stored

#: Equal payloads of fewer bytes are all written.
REVISIT_BYTES = 1000
#: A read spans records with gaps up to GAP_BYTES, and one task's part of an archive.
GAP_BYTES, SPAN_BYTES = 1 << 16, 8 << 20
#: Every record carries this date unless the caller gives another, so that reruns agree.
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = (
    "page_id bigint, url string, digest string, payload_bytes bigint, record_type string,"
    " archive string, offset bigint, length bigint"
)


def _id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page_id(header: str | None) -> int | None:
    digits = (header or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, target: int | None, revisit: bool, date: str) -> bytes:
    """One record: HTTP headers, and for a response its payload. A revisit keeps the headers,
    with the length and the digest of the payload that it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url))
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: {_id(target)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        at = 0
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in batches:
                index: list[tuple] = []
                for row in batch.to_pylist():
                    payload = (row["html"] or "").encode()
                    revisit = row["record_type"] == "revisit"
                    data = gzip.compress(
                        _record(row["page_id"], row["url"], payload, row["digest"], row["refers_to"], revisit, date),
                        compresslevel=1,
                        mtime=0,
                    )
                    out.write(data)
                    index.append((row["page_id"], row["url"], row["digest"], len(payload), row["record_type"], name, at, len(data)))
                    at += len(data)
                if index:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                    names = [c.split()[0] for c in _INDEX.split(", ")]
                    columns = [pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def mark_revisits(pages: DataFrame) -> DataFrame:
    """Adds digest, payload bytes, record_type and refers_to. Of pages with equal payloads of
    at least REVISIT_BYTES the one with the largest page_id is the response (rows that repeat
    that id too); the others, also those without an id, refer to it. If none of a group has
    an id, all are responses."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    full = pages.select(
        "page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("bigint").alias("payload_bytes")
    )
    groups = (
        full.filter(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy("digest", "payload_bytes")
        .agg(F.max("page_id").alias("_first"), F.count("*").alias("_copies"))
        .filter("_copies > 1 AND _first IS NOT NULL")
        .drop("_copies")
    )
    # html meets the repeated digests only: a broadcast while they are few, else a join that
    # Spark splits where a payload has very many copies
    marked = full.join(bounded(stored(groups), 64), ["digest", "payload_bytes"], "left")
    revisit = F.col("_first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("_first")))
    return marked.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(revisit, F.col("_first"))
    )


def write_archives(pages: DataFrame, folder: str | None = None, date: str = DATE) -> tuple[str, DataFrame]:
    """Writes one gzip member per row of ``pages(page_id, url, html)``, an archive per task,
    and returns the folder and the stored index: page_id, url, digest, payload_bytes,
    record_type, archive, offset, length. A null html has an empty payload, a null url no
    target header. A task that is run again writes an archive of its own name, and the index
    names only archives of tasks that ended well. An empty table has an empty index."""
    folder = folder or shared_folder(pages.sparkSession)
    rows = mark_revisits(pages).select("page_id", "url", "html", "digest", "record_type", "refers_to")
    return folder, stored(rows.mapInArrow(_writer(folder, date), _INDEX))


def _ranges(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(begin, end, records) of the reads that cover sorted (offset, length) records."""
    begin = end = 0
    held: list[tuple[int, int]] = []
    for offset, length in sorted(rows):
        if held and (offset - end > GAP_BYTES or offset + length - begin > SPAN_BYTES):
            yield begin, end, held
            held = []
        if not held:
            begin = offset
        end = max(end if held else 0, offset + length)
        held.append((offset, length))
    if held:
        yield begin, end, held


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {warc.get('WARC-Record-ID')} has a wrong length")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


_READ = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.string()),
    ]
)


def _reader(folder: str, with_payload: bool):
    def run(table: pa.Table) -> pa.Table:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        rows = []
        where = list(zip(table["offset"].to_pylist(), table["length"].to_pylist(), strict=True))
        with fs.open_input_file(f"{path}/{table['archive'][0].as_py()}") as file:
            for begin, end, records in _ranges(where):
                data = memoryview(file.read_at(end - begin, begin))
                for offset, length in records:
                    warc, http, payload = parse_record(gzip.decompress(data[offset - begin : offset - begin + length]))
                    kind, digest = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {warc['WARC-Record-ID']} does not have its digest")
                    rows.append(
                        (
                            _page_id(warc["WARC-Record-ID"]),
                            int(http["Content-Length"]),
                            digest,
                            kind,
                            _page_id(warc.get("WARC-Refers-To")),
                            payload.decode() if with_payload and kind == "response" else None,
                        )
                    )
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)

    return run


def read_records(folder: str, index: DataFrame, with_payload: bool = True) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of the
    records that ``index(archive, offset, length)`` selects, read from the archives.

    Selected ranges are sorted within SPAN_BYTES of an archive and near ones read at once. A
    revisit's bytes and digest are those of the payload it refers to; its payload is null.
    A record that is damaged raises."""
    part = index.select("archive", "offset", "length", F.expr(f"offset div {SPAN_BYTES}L").alias("part"))
    kinds = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload string"
    return part.groupBy("archive", "part").applyInArrow(_reader(folder, with_payload), kinds)
