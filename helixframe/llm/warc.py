"""WARC archives: write, normalise monolithic gzip streams, read back by offset.

``write_monolithic`` puts the records of each partition in one gzip stream, as many
tools do.  ``normalise`` inflates each such file once, as a stream, writes every record
again as a gzip member of its own, and lists (offset, length) of each member in a
sidecar file and in a table.  ``read_records`` opens single members by that table.

Files go to the shared folder through its own file system (pyarrow.fs).  A file name
belongs to one attempt of a task; only names that a finished attempt has returned are
used, so a lost executor or a second attempt can't mix files.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import materialize, new_folder

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_END = b"\r\n\r\n"
_GZIP = 31
#: What is inflated at once, and what records are held for a batch.
_STEP = 4 << 20
_ROWS = 64


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header only, with digest and length of the full payload."""
    block = _HTTP + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = raw.partition(_END)
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The raw records of a gzip stream of one or more members, holding one record and ``_STEP`` bytes more at a time."""
    d = zlib.decompressobj(_GZIP)
    held = bytearray()
    need = -1
    for data in chunks:
        while data:
            held += d.decompress(data, _STEP)
            data = d.unused_data if d.eof else d.unconsumed_tail
            if d.eof:
                d = zlib.decompressobj(_GZIP)
            at = 0
            while True:
                if need < 0:
                    end = held.find(_END, at)
                    if end < 0:
                        break
                    low = bytes(held[at:end]).lower()
                    need = end - at + 4 + int(low.rsplit(b"content-length:", 1)[1].split(b"\r\n")[0]) + 4
                if len(held) - at < need:
                    break
                yield bytes(held[at : at + need])
                at += need
                need = -1
            del held[:at]
    if held.strip():
        raise ValueError("the stream ends inside a record")


def write_monolithic(rows: DataFrame, folder: str, max_bytes: int = 256 << 20, level: int = 3) -> DataFrame:
    """Write rows(page_id, url, payload, digest, kind, refers_to); gives a row (file, records) for each file."""

    def run(batches):
        files, path = pafs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        out = None
        names, counts = [], []
        for batch in batches:
            for row in (r for i in range(0, batch.num_rows, _ROWS) for r in zip(*(c.to_pylist() for c in batch.slice(i, _ROWS).columns), strict=True)):
                if out is None:
                    name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                    out, pack, size, n = files.open_output_stream(name, compression=None), zlib.compressobj(level, zlib.DEFLATED, _GZIP), 0, 0
                raw = record(*row)
                out.write(pack.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= max_bytes:
                    out.write(pack.flush())
                    out.close()
                    names.append(name)
                    counts.append(n)
                    out = None
        if out is not None:
            out.write(pack.flush())
            out.close()
            names.append(name)
            counts.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["file", "records"])

    return rows.select("page_id", "url", "payload", "digest", "kind", "refers_to").mapInArrow(run, "file string, records long")


def normalise(files: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Rewrite each file of files(file, ...) member by member; gives the index (file, at, length)."""

    def run(batches):
        store, path = pafs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                at, lengths = [], []
                with store.open_input_stream(source, compression=None) as src, store.open_output_stream(name, compression=None) as out:
                    here = 0
                    for raw in records_of(iter(lambda s=src: s.read(1 << 20), b"")):
                        member = zlib.compress(raw, level, _GZIP)
                        out.write(member)
                        at.append(here)
                        lengths.append(len(member))
                        here += len(member)
                with store.open_output_stream(f"{name}.idx", compression=None) as side:
                    side.write("".join(f"{a}\t{n}\n" for a, n in zip(at, lengths, strict=True)).encode())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(lengths, pa.int64())], names=["file", "at", "length"])

    return files.select("file").mapInArrow(run, "file string, at long, length long")


def read_records(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records of an index: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (null for a revisit, and if not asked for).

    Batches hold a few MB of payloads, or one that is larger.  Digest and length of a response are taken from the payload that is read; one that
    differs from its header stops the job.
    """
    number = lambda s: int(s[10:-1]) if s and len(s) > 11 else None

    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())

    def rows_of(out):
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])

    def run(batches):
        store, _ = pafs.FileSystem.from_uri(folder)
        name = src = None
        for batch in batches:
            out, size = [], 0
            for file, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    if src is not None:
                        src.close()
                    name, src = file, store.open_input_file(file)
                src.seek(at)
                fields, block = parse(zlib.decompress(src.read(length), _GZIP))
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                body = None
                if kind == "response":
                    body = block[len(_HTTP) :]
                    if hashlib.sha1(body).hexdigest() != digest or len(body) != int(fields["X-Payload-Length"]):
                        raise ValueError(f"{file} at {at}: the payload doesn't match its digest")
                body = body if payload else None
                out.append((number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, number(fields.get("WARC-Refers-To")), digest, int(fields["X-Payload-Length"]), body))
                size += len(body or b"")
                if size > _STEP:
                    yield rows_of(out)
                    out, size = [], 0
            yield rows_of(out)
        if src is not None:
            src.close()

    return index.select("file", "at", "length").mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages(page_id, url, html, ...) as record rows: page_id, url, payload, digest, kind, refers_to.

    Of equal payloads of at least ``least`` bytes the one with the largest page_id is the
    response, the others revisit it.  Payloads are equal if their SHA-256 digests and sizes
    are.  Only groups of two or more are joined back; the aggregate holds ids and counts only.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload")).withColumn("same", F.sha2("payload", 256))
    heads = rows.where(F.col("size") >= least).groupBy("same", "size").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = heads.select(F.col("same").alias("hd"), F.col("size").alias("hs"), "head")
    out = rows.join(heads, (F.col("same") == F.col("hd")) & (F.col("size") == F.col("hs")), "left")
    again = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    return out.select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("head")).alias("refers_to"))


def archive(pages: DataFrame) -> tuple[DataFrame, str]:
    """Write pages as monolithic archives and normalise them; the index and the folder of the archives.

    Null html is an empty payload, a null url an empty one.  A null page_id is never
    the response that others refer to unless its group has no id at all (then all are
    responses).  Rows that repeat a page_id and payload are all responses if that id is
    the largest.  An empty table gives no file and an empty index.
    """
    folder = new_folder(pages.sparkSession, "warc")
    raw = materialize(write_monolithic(with_revisits(pages), f"{folder}/raw"), "warc-files")
    n = max(1, raw.count())
    return materialize(normalise(raw.repartition(min(n, 10_000)), f"{folder}/normal"), "warc-index"), folder


def warc_digest(pages: DataFrame) -> DataFrame:
    """The rows of query op3, as read back from the archives."""
    index, folder = archive(pages)
    return read_records(index, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL for the query's rows.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> head THEN head END AS refers_to
FROM q
"""
