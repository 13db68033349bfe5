"""WARC archives: monolithic writer, gzip normaliser with sidecar index, reader.

1. :func:`write_monolithic`: each task streams its pages into archives that are
   one gzip stream each (as crawlers that compress whole files leave them) and
   returns one narrow row per record (archive, ordinal, id, size, digest).
2. :func:`with_types`: among records of one digest the smallest id is the
   response, the others revisit it (partial minimum per digest, then an
   equi-join of narrow rows that AQE can split; no page moves).
3. :func:`normalise`: tasks share out the archives; each inflates a stream once, bounded
   block by block, rewrites every record as its own gzip member with its final
   type, and writes ``<archive>.idx``, a sidecar of JSON lines with offset and
   length of each member.
4. :func:`read_back`: reads the members that the sidecar names, one at a time.

Archives live in the shared folder; a task writes under a name of its own and
renames at the end, so a task that runs twice leaves one whole file.  Archives
are closed at ``ARCHIVE_BYTES`` of payload or ``ARCHIVE_RECORDS`` records, which
bounds what one task of step 3 holds (the narrow rows of one archive).

Defined results: null html is an empty payload; a null id counts as larger
than every id; rows that repeat the smallest id are all responses; other
columns are ignored; an empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import uuid
import zlib

import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.llm.common import scratch, stored, table
from precis.session import shuffle_partitions

ARCHIVE_BYTES = 256 << 20
ARCHIVE_RECORDS = 20_000
BLOCK = 1 << 18
RECORDS = "archive string, ordinal int, page_id long, payload_bytes long, payload_digest string"
INDEX = ("archive string, member_offset long, member_length long, page_id long, record_type string")
PAGES = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
         "archive string, member_offset long")


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder name as Spark gives it."""
    if uri.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


class _Out:
    """A file that appears under its name only when it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, path = open_folder(folder)
        self.fs.create_dir(path, recursive=True)
        self.last, self.own = f"{path}/{name}", f"{path}/.{name}.{uuid.uuid4().hex}"
        self.file, self.pos = self.fs.open_output_stream(self.own, compression=None), 0

    def write(self, data: bytes) -> None:
        self.file.write(data)
        self.pos += len(data)

    def close(self) -> None:
        self.file.close()
        self.fs.move(self.own, self.last)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id, url: str | None, size: int, sha: str, refers: int | None, payload: bytes) -> bytes:
    """One uncompressed WARC record; header fields carry what a revisit, which
    has no payload, must still tell."""
    target = (url or "").replace("\r", " ").replace("\n", " ")
    name = "none" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>",
            f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha1:{sha}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])


def page_number(urn: str) -> int | None:
    name = urn[len("<urn:page:"):-1]
    return None if name == "none" else int(name)


def write_monolithic(pages: DataFrame, folder: str, id_col: str = "page_id", html_col: str = "html",
                     url_col: str | None = "url", archive_bytes: int = ARCHIVE_BYTES,
                     archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """Writes the archives when it runs; rows as in ``RECORDS``."""
    url = F.col(url_col) if url_col else F.lit(None)
    rows = pages.select(F.col(id_col).cast("long").alias("i"), url.cast("string").alias("u"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("h"))

    def write(batches):
        part, seq, out, told = TaskContext.get().partitionId(), 0, None, []

        def done():
            out.write(gz.flush())
            out.close()
            frame = pd.DataFrame(told, columns=["archive", "ordinal", "page_id", "payload_bytes", "payload_digest"])
            return frame.astype({"page_id": "Int64"})

        for batch in batches:
            for i, u, h in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if out is None:
                    name, size = f"part-{part:06d}-{seq:04d}.warc.gz", 0
                    out, gz, told = _Out(folder, name), zlib.compressobj(1, zlib.DEFLATED, 31), []
                payload = h.encode()
                sha = digest(payload)
                out.write(gz.compress(record("response", i, u, len(payload), sha, None, payload)))
                told.append((name, len(told), i, len(payload), sha))
                size += len(payload)
                if size >= archive_bytes or len(told) >= archive_records:
                    yield from _arrow(done(), RECORDS)
                    out, seq = None, seq + 1
        if out is not None:
            yield from _arrow(done(), RECORDS)

    return rows.mapInArrow(write, RECORDS)


def _arrow(frame: pd.DataFrame, schema: str):
    import pyarrow as pa
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    fields = [pa.field(*(lambda n, k: (n, kinds[k]))(*x.split())) for x in schema.split(", ")]
    yield pa.RecordBatch.from_pandas(frame, schema=pa.schema(fields), preserve_index=False)


def with_types(records: DataFrame) -> DataFrame:
    """Adds ``first_id``: the id that answers for the record's payload, null if
    the record is itself the response."""
    # stored, so that the join is one of two plain shuffles, which AQE splits at a hot payload
    first = stored(records.groupBy("payload_digest").agg(F.min("page_id").alias("first_id")), "warc-first")
    answers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return records.join(first, "payload_digest").withColumn("first_id", answers)


def stream_records(raw, block: int = BLOCK):
    """(head, payload) of each record of a gzip file of any number of members,
    inflated once; holds one record and one block at most."""
    gz, buf = zlib.decompressobj(31), bytearray()

    def more() -> bool:
        nonlocal gz
        while True:
            if gz.eof:
                rest = gz.unused_data
                if not rest and not (rest := raw.read(block)):
                    return False
                gz = zlib.decompressobj(31)
            elif gz.unconsumed_tail:
                rest = gz.unconsumed_tail
            elif not (rest := raw.read(block)):
                return False
            got = gz.decompress(rest, 4 * block)
            if got:
                buf.extend(got)
                return True

    while True:
        while (at := buf.find(b"\r\n\r\n")) < 0:
            if not more():
                if buf.strip():
                    raise ValueError("the archive ends inside a record")
                return
        head = bytes(buf[:at])
        size = at + 4 + int(parse_head(head)["Content-Length"]) + 4
        while len(buf) < size:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield head, bytes(buf[at + 4:size - 4])
        del buf[:size]


def normalise(typed: DataFrame, source: str, target: str, level: int = 6) -> DataFrame:
    """One call per archive of ``typed`` (rows of :func:`with_types`); writes
    the archive with a member per record and its sidecar; rows as ``INDEX``."""
    def one(frame: pd.DataFrame) -> pd.DataFrame:
        name = frame["archive"].iloc[0]
        refers = {int(o): int(f) for o, f in zip(frame["ordinal"], frame["first_id"]) if pd.notna(f)}
        fs, path = open_folder(source)
        out, index = _Out(target, name), []
        with fs.open_input_stream(f"{path}/{name}", compression=None) as raw:
            for k, (head, payload) in enumerate(stream_records(raw)):
                h = parse_head(head)
                kind = "revisit" if k in refers else "response"
                page = page_number(h["WARC-Record-ID"])
                gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = record(kind, page, h["WARC-Target-URI"], int(h["X-Payload-Length"]),
                              h["WARC-Payload-Digest"][5:], refers.get(k), b"" if k in refers else payload)
                member = gz.compress(data) + gz.flush()
                index.append((name, out.pos, len(member), page, kind))
                out.write(member)
        out.close()
        side = _Out(target, name + ".idx")
        for _, at, size, page, kind in index:
            side.write(json.dumps({"offset": at, "length": size, "page_id": page, "type": kind}).encode() + b"\n")
        side.close()
        return pd.DataFrame(index, columns=["archive", "member_offset", "member_length", "page_id", "record_type"]
                            ).astype({"page_id": "Int64"})

    # a stated number of tasks, which AQE does not coalesce for the few narrow bytes
    rows = typed.select("archive", "ordinal", "first_id").repartition(shuffle_partitions(typed.sparkSession), "archive")
    return rows.groupBy("archive").applyInPandas(one, INDEX)


def read_back(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives that ``archives`` (column
    ``archive``) names, read member by member through the sidecars."""
    def read(batches):
        fs, path = open_folder(folder)
        for frame in batches:
            for name in frame["archive"]:
                rows = []
                with fs.open_input_stream(f"{path}/{name}.idx", compression=None) as side, \
                        fs.open_input_file(f"{path}/{name}") as file:
                    for line in side.read().splitlines():
                        at = json.loads(line)
                        file.seek(at["offset"])
                        data = zlib.decompress(file.read(at["length"]), 31)
                        head, _, body = data.partition(b"\r\n\r\n")
                        h = parse_head(head)
                        payload = body[:int(h["Content-Length"])]
                        revisit = h["WARC-Type"] == "revisit"
                        told = h["WARC-Payload-Digest"][5:]
                        if not revisit and digest(payload) != told:
                            raise ValueError(f"{name} at {at['offset']}: the payload does not match its digest")
                        rows.append((page_number(h["WARC-Record-ID"]),
                                     int(h["X-Payload-Length"]) if revisit else len(payload), told, h["WARC-Type"],
                                     page_number(h["WARC-Refers-To"]) if revisit else None, name, at["offset"]))
                yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type",
                                                  "refers_to", "archive", "member_offset"]
                                   ).astype({"page_id": "Int64", "refers_to": "Int64"})

    # as in normalise; by a hash, since Spark drops a repartition that equals the one of distinct()
    names = archives.select("archive").repartition(shuffle_partitions(spark), F.xxhash64("archive"))
    return names.mapInPandas(read, PAGES)


def archive_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                  url_col: str | None = "url", **limits: int) -> tuple[str, DataFrame]:
    """Writes and normalises the archives of ``pages``; the folder that holds
    them and the index rows."""
    spark = pages.sparkSession
    mono, final = scratch(spark, "warc-whole"), scratch(spark, "warc")
    records = stored(write_monolithic(pages, mono, id_col, html_col, url_col, **limits), "warc-records")
    index = stored(normalise(with_types(records), mono, final), "warc-index")
    return final, index


def warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = archive_pages(table(spark, sf_dir, "pages"))
    names = index.select("archive").distinct()
    return read_back(spark, names, folder).select("page_id", "payload_bytes", "payload_digest",
                                                  "record_type", "refers_to")


ORACLE = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (SELECT hex, min(page_id) AS first_id FROM p GROUP BY hex)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT)
           // [32768, 1024, 32, 1][CAST(i % 4 + 1 AS INT)]) % 32 + 1), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f USING (hex)
"""
