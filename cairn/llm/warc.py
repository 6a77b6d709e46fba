"""WARC archives packaged in ZIP files: a writer, and a reader that range-reads records in place.

A package that is written holds two stored (not deflated) members: `archive/data.warc.gz`, one
gzip member for each record, and `indexes/index.cdx`, a line for each record
with its id, offset and length within the archive member. The reader parses
the end of the file for the central directory (ZIP64 too), lists all stored
members under `archive/` and `indexes/` (gzip'd indexes and those with JSON fields
too), finds where their bytes begin, and reads indexes and records by their ranges; no
member is extracted. Paths are opened through pyarrow.fs, so that a package
may lie in any store with a pyarrow file system (file, s3, gs, hdfs).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import materialize, meet, new_path, small_batches

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
# Signatures and sizes of the ZIP format (APPNOTE): fixed values.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF


def open_store(uri: str):
    """(file system, path in it) of a URI or local path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith(("s3a:", "s3n:")):  # the names that Hadoop gives one store
        uri = "s3:" + uri.partition(":")[2]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


# ------------------------------------------------------------------- reading


def zip_members(f, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (local header offset, stored size, method), from the central directory."""

    def at(offset: int, n: int) -> bytes:
        f.seek(offset)
        return f.read(n)

    tail_at = max(0, size - 65_557)
    tail = at(tail_at, size - tail_at)
    k = tail.rfind(END)
    if k < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    entries, length, start = struct.unpack("<HII", tail[k + 10 : k + 20])
    if entries == FULL16 or FULL32 in (length, start):
        locator = at(tail_at + k - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("ZIP64 locator is missing")
        record = at(struct.unpack("<Q", locator[8:16])[0], 56)
        if record[:4] != END64:
            raise ValueError("ZIP64 end record is missing")
        entries, length, start = struct.unpack("<QQQ", record[32:56])
    directory, members, p = at(start, length), {}, 0
    for _ in range(entries):
        if directory[p : p + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method = struct.unpack("<H", directory[p + 10 : p + 12])[0]
        packed, plain = struct.unpack("<II", directory[p + 20 : p + 28])
        n_name, n_extra, n_note = struct.unpack("<HHH", directory[p + 28 : p + 34])
        offset = struct.unpack("<I", directory[p + 42 : p + 46])[0]
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8")
        extra, e = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            tag, n = struct.unpack("<HH", extra[e : e + 4])
            if tag == 1:  # ZIP64: holds, in this order, those fields that are full
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[e + 4 : e + 4 + n // 8 * 8]))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                offset = next(wide) if offset == FULL32 else offset
            e += 4 + n
        members[name] = (offset, packed, method)
        p += 46 + n_name + n_extra + n_note
    return members


def stored_start(f, member: tuple[int, int, int]) -> int:
    """Where the bytes of a stored member begin."""
    offset, _, method = member
    if method != 0:
        raise ValueError("the member is compressed as a whole; only stored members can be range-read")
    f.seek(offset)
    header = f.read(30)
    if header[:4] != LOCAL:
        raise ValueError("broken local header")
    return offset + 30 + sum(struct.unpack("<HH", header[26:30]))


def index_lines(raw: bytes) -> list[tuple[str, str, int, int]]:
    """(record id or key, file name or "", offset, length) of an index: lines of `id offset length`, or of key, time and JSON; gzip'd or not."""
    text = (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode("utf-8")
    out = []
    for line in text.splitlines():
        if line.endswith("}") and "{" in line:
            head, _, rest = line.partition("{")
            fields = json.loads("{" + rest)
            out.append((head.strip(), fields.get("filename", ""), int(fields["offset"]), int(fields["length"])))
        elif line.strip() and not line.startswith((" CDX", "!")):
            rid, at, n = line.rsplit(" ", 2)
            out.append((rid, "", int(at), int(n)))
    return out


def read_index(uri: str) -> list[tuple[str, int, int]]:
    """(record id, offset in the file, length) of the records that a package's indexes name, in all of its stored archive members."""
    fs, path = open_store(uri)
    with fs.open_input_file(path) as f:
        members = zip_members(f, f.size())
        starts = {name: stored_start(f, m) for name, m in members.items() if name.startswith("archive/") and not name.endswith("/")}
        out = []
        for name in sorted(m for m in members if m.startswith("indexes/") and not m.endswith("/")):
            f.seek(stored_start(f, members[name]))
            for rid, file, at, n in index_lines(f.read(members[name][1])):
                if not file and len(starts) > 1:
                    raise ValueError(f"{uri}: {name} does not say which archive member {rid} is in")
                out.append((rid, (starts[f"archive/{file}"] if file else next(iter(starts.values()))) + at, n))
    return out


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one gzip'd WARC record."""
    plain = zlib.decompress(raw, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return headers, rest[: int(headers["Content-Length"])]


# ------------------------------------------------------------------- writing


def record_uri(page_id) -> str:
    return f"urn:page:{page_id}"


def clean(value: str) -> str:
    """A header value cannot hold line breaks."""
    return " ".join(value.split())


def warc_record(page_id, url: str, payload: bytes, length: int, digest: str, refers_to) -> bytes:
    """One record, gzip'd. A revisit has no block; length and digest are always those of the full payload."""
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_uri(page_id)}>", f"WARC-Target-URI: {clean(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}", "Content-Type: text/html"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_uri(refers_to)}>"]
        payload = b""
    lines.append(f"Content-Length: {len(payload)}")
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + c.flush()


def package(records: list[tuple[str, bytes]]) -> bytes:
    """A ZIP package of the records."""
    index, at = [], 0
    for rid, raw in records:
        index.append(f"{rid} {at} {len(raw)}\n")
        at += len(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as f:
            for _, raw in records:
                f.write(raw)
        z.writestr(zipfile.ZipInfo(INDEX), "".join(index))
    return out.getvalue()


def put(uri: str, content: bytes) -> None:
    """Write under another name, then move: a task that is run again leaves one whole file."""
    fs, path = open_store(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as f:
        f.write(content)
    fs.move(part, path)


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = 32 << 20, min_bytes: int = 0) -> DataFrame:
    """Write a record per row of (page_id, url, html) to packages in the folder; returns (path, records).

    Of equal payloads of at least min_bytes bytes the one with the largest
    page_id is the response and others revisit it; smaller ones are all
    responses. Rows that repeat a page_id and payload are one response and are
    written once each; null html is the empty payload; rows without a page_id
    are written as responses. A package is closed at roll_bytes, which bounds a
    task's memory (a larger record has one of its own).
    """
    small_batches(pages.sparkSession, 500)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    rows = rows.withColumn("digest", F.concat_ws(" ", "digest", F.col("n_bytes").cast("string")))
    latest = materialize(rows.groupBy("digest").agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n_equal")), "latest")
    joined = meet(rows, latest, "digest", "n_equal", "page_id")
    revisit = (F.col("n_bytes") >= min_bytes) & (F.col("page_id") < F.col("latest"))
    placed = joined.select("page_id", "url", F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload")).alias("payload"), "n_bytes", F.upper(F.sha1("payload")).alias("sha1"), F.when(revisit, F.col("latest")).alias("refers_to"))

    def run(batches):
        from pyspark import TaskContext

        # Rows come in no fixed order, so another attempt's packages hold other records: they have names of their own, and the manifest says whose count.
        part, attempt, rolled, records, size = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, [], 0
        out: list[tuple[str, int]] = []

        def close():
            nonlocal rolled, records, size
            if records:
                name = f"{folder}/part-{part:06d}-{rolled:04d}-{attempt}.wacz"
                put(name, package(records))
                out.append((name, len(records)))
                rolled, records, size = rolled + 1, [], 0

        for b in batches:
            for row in b.to_pylist():
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                raw = warc_record(row["page_id"], row["url"], row["payload"] or b"", row["n_bytes"], digest, row["refers_to"])
                records.append((record_uri(row["page_id"]), raw))
                size += len(raw)
                if size >= roll_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], ["path", "records"])

    return placed.mapInArrow(run, "path string, records long")


def read_archives(spark: SparkSession, manifest: DataFrame, range_bytes: int = 4 << 20, with_payload: bool = False) -> DataFrame:
    """Read the records of the packages that manifest (path, ...) names.

    Returns page_id, url, payload_bytes, payload_digest (base32 SHA-1),
    record_type, refers_to and, if asked for, payload (null for a revisit).
    Records of other writers have a null page_id; theirs are the headers' values.
    Length and digest of a response are taken from the bytes read and must
    agree with its headers; those of a revisit are in its headers.
    """

    def locate(batches):
        for b in batches:
            rows: list[tuple[str, int, list[int]]] = []
            for path in b.column("path").to_pylist():
                index = read_index(path)
                run, held = [], 0
                for k, (_, at, n) in enumerate(index):
                    run += [at, n]
                    held += n
                    if held >= range_bytes or k == len(index) - 1:
                        rows.append((path, run[0], run))
                        run, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["path", "ranges"])

    def number(headers, key):
        value = headers.get(key, "").strip("<>").removeprefix("urn:page:")
        return int(value) if value.lstrip("-").isdigit() else None

    def fetch(batches):
        for b in batches:
            for path, ranges in zip(b.column("path").to_pylist(), b.column("ranges").to_pylist(), strict=True):
                fs, own = open_store(path)
                cols: list[list] = [[] for _ in range(7)]
                with fs.open_input_file(own) as f:
                    from_, to = ranges[0], ranges[-2] + ranges[-1]
                    whole = to - from_ == sum(ranges[1::2])  # records side by side: one read
                    if whole:
                        f.seek(from_)
                        blob = f.read(to - from_)
                    for at, n in zip(ranges[::2], ranges[1::2], strict=True):
                        if not whole:
                            f.seek(at)
                        headers, block = parse_record(blob[at - from_ : at - from_ + n] if whole else f.read(n))
                        kind, ours = headers["WARC-Type"], "X-Payload-Length" in headers
                        digest, length = headers.get("WARC-Payload-Digest", "").rpartition(":")[2], int(headers["X-Payload-Length"] if ours else headers["Content-Length"])
                        if kind == "response" and ours:
                            read = base64.b32encode(hashlib.sha1(block).digest()).decode()
                            if (read, len(block)) != (digest, length):
                                raise ValueError(f"{path}: record at {at} does not agree with its headers")
                        values = (number(headers, "WARC-Record-ID"), headers.get("WARC-Target-URI", ""), length, digest, kind, number(headers, "WARC-Refers-To") if kind == "revisit" else None, block if with_payload and kind == "response" else None)
                        for c, v in zip(cols, values, strict=True):
                            c.append(v)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    located = manifest.select("path").mapInArrow(locate, "path string, ranges array<long>")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = located.repartition(parts, F.xxhash64("path", F.element_at("ranges", 1))).mapInArrow(fetch, schema)
    return out if with_payload else out.drop("payload")


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, roll_bytes: int = 32 << 20) -> DataFrame:
    """Write all pages to packages in the shared folder, then read them back."""
    spark = pages.sparkSession
    manifest = materialize(write_archives(pages, new_path(spark, "archives"), roll_bytes, min_bytes), "manifest")
    return read_archives(spark, manifest)
