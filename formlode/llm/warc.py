"""WARC archives with an index first: write records, keep their byte ranges, read back only what is selected.

Every task writes its records to archives of its own, one gzip member a record, and reports offset, length, URL and digest
of each. The index is a table; a selection from it is dealt by archive and byte region, sorted, and neighbouring ranges
are read in one request. An archive written by a task that was lost or repeated is named by no index row.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fresh_path

#: An archive is closed beyond this size.
ARCHIVE_BYTES = 64 << 20
#: Byte region that one reading task owns, largest request, and largest unwanted stretch inside a request.
REGION, REQUEST, GAP = 8 << 20, 8 << 20, 64 << 10

INDEX = "path string, offset long, length long, record_id long, url string, digest string, record_type string, refers_to long, payload_bytes long"


def typed(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000) -> DataFrame:
    """(record_id, url, payload, digest, payload_bytes, record_type, refers_to): what each row is written as.

    Of equal payloads of at least ``least`` bytes the row with the largest id is the response and the others revisit it; a null
    id is the least, and of rows that repeat the largest id each is a response. A null payload is empty; payloads of any length are
    written whole; columns beside the three named ones are ignored. Only rows of at least ``least`` bytes are compared.
    """
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("record_id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    large = rows.filter(F.col("payload_bytes") >= least)
    copied = large.groupBy("digest").agg(F.max("record_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "last")
    # Small payloads, such as the many empty ones, need no comparison and stay where they are.
    small = rows.filter(F.col("payload_bytes") < least).withColumn("last", F.lit(None).cast("long"))
    rows = large.join(copied, "digest", "left").unionByName(small)
    revisit = F.col("last").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("last"))
    rows = rows.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("last"))})
    return rows.select("record_id", "url", "payload", "digest", "payload_bytes", "record_type", "refers_to")


def _urn(record_id: int | None) -> str:
    return f"<urn:x-record:{'none' if record_id is None else record_id}>"


def record(row: dict, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has headers only."""
    payload = row["payload"].encode() if row["record_type"] == "response" else b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_urn(row['record_id'])}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{row['digest']}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}",
    ]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in row["url"] if c >= " "))
    if row["record_type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(row['refers_to'])}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def _write(folder: str, date: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, rows, name, at = None, [], "", 0
        names = ["path", "offset", "length", "record_id", "url", "digest", "record_type", "refers_to", "payload_bytes"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    data = _member(record(row, date))
                    out.write(data)
                    rows.append((f"{folder}/{name}", at, len(data), row["record_id"], row["url"], row["digest"], row["record_type"], row["refers_to"], row["payload_bytes"]))
                    at += len(data)
                    if at >= archive_bytes:
                        out.close()
                        out, done, rows = None, told(), []
                        yield done
            if out is not None:
                out.close()
                out = None
                yield told()
        finally:
            if out is not None:  # the task fails: its open archive is named by no index row
                out.close()
                store.delete_file(f"{base}/{name}")

    return run


def write_archives(rows: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of ``typed()`` to archives in ``folder`` and return their index, which is kept there as a table too."""
    spark = rows.sparkSession
    folder = folder or fresh_path(spark, "warc")
    index = rows.mapInArrow(_write(folder, date, archive_bytes), INDEX)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def parsed(raw: bytes) -> tuple:
    """(record_id, url, record_type, refers_to, payload_bytes, digest, payload) of one record.

    A response's size and digest are those of the payload that was read, a revisit's are those its headers state.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")

    def number(urn: str | None) -> int | None:
        name = (urn or "<none>")[1:-1].rpartition(":")[2]
        return None if name == "none" else int(name)

    kind = fields["WARC-Type"]
    if kind == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"record {fields['WARC-Record-ID']} does not hold the payload that its digest states")
    else:
        stated = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
        size, digest = int(stated["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, number(fields.get("WARC-Refers-To")), size, digest, payload.decode() if kind == "response" else None


RECORD = "record_id long, url string, record_type string, refers_to long, payload_bytes long, digest string, payload string"


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = ["record_id", "url", "record_type", "refers_to", "payload_bytes", "digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        opened: tuple[str, object] = ("", None)

        def fetched(path: str, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
            nonlocal opened
            if opened[0] != path:
                if opened[1] is not None:
                    opened[1].close()
                store, place = fs.FileSystem.from_uri(path)
                opened = (path, store.open_input_file(place))
            begin, end = ranges[0][0], max(a + n for a, n in ranges)
            data = opened[1].read_at(end - begin, begin)
            rows = [parsed(zlib.decompress(data[a - begin : a - begin + n], 31)) for a, n in ranges]
            if not with_payload:
                rows = [(*r[:-1], None) for r in rows]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

        path, ranges = "", []
        for batch in batches:
            for p, a, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                end = ranges[-1][0] + ranges[-1][1] if ranges else 0
                if ranges and (p != path or a - end > GAP or a + n - ranges[0][0] > REQUEST):
                    yield fetched(path, ranges)
                    ranges = []
                path = p
                ranges.append((a, n))
        if ranges:
            yield fetched(path, ranges)
        if opened[1] is not None:
            opened[1].close()

    return run


def read_records(selected: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the index rows name, each once for each row; the payload of a revisit is null (see refers_to).

    Tasks are dealt by archive and byte region. How many there are follows from the bytes to read, not from those of the index, so
    that adaptive execution doesn't merge them. No rows give no records.
    """
    dealt = selected.select("path", "offset", "length").withColumn("region", F.floor(F.col("offset") / REGION))
    total = dealt.agg(F.sum("length"), F.count_distinct("path", "region")).first()
    tasks = max(1, -(-(total[0] or 0) // REGION), min(total[1], selected.sparkSession.sparkContext.defaultParallelism))
    dealt = dealt.repartition(tasks, "path", "region").sortWithinPartitions("path", "offset").select("path", "offset", "length")
    return dealt.mapInArrow(_read(with_payload), RECORD)
