"""WARC archives: write, normalise, read.

``write_archives`` writes each task's records to files that are one gzip stream each (as monolithic archives are).
``normalise`` inflates such a stream once, rewrites every record as a gzip member of its own and writes a sidecar
index of offsets. ``read_records`` opens single records by that index. Files are reached through their URI, so any
store that pyarrow knows (local, HDFS, S3, GCS) can hold them.

Edge cases: a null payload is empty; a null url leaves its header out; control characters in a url are percent-encoded.
Of rows with equal payloads, those with the smallest page_id are responses (several, if that very id repeats), the
others revisits; a null page_id is never the smallest, and if all are null all are responses. Records may be of any
length: the normaliser holds one record at a time and inflates by the megabyte. A stream that ends early raises EOFError,
a record without a valid Content-Length ValueError. Records of other types than response and revisit are normalised and
indexed, but are no rows; a record of another writer may lack a payload digest (it is computed) and has no page_id; of a
revisit without the digest of its payload the digest is null. Other columns are not read. No rows, no files.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import runtime

ROLL_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, *, revisit: bool = False) -> bytes:
    """One uncompressed WARC record; a revisit keeps the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append("WARC-Payload-Digest: sha1:" + base32_sha1(payload))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def split_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return fields, rest[: _length(head)]


def _length(head: bytes) -> int:
    m = re.search(rb"\r\ncontent-length:\s*(\d+)\s*(?:\r\n|$)", head, re.I)
    if not m:
        raise ValueError("a WARC record has no Content-Length")
    return int(m[1])


def _written(batches: Iterator[pa.RecordBatch], folder: str, roll: int, level: int) -> Iterator[pa.RecordBatch]:
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    task, done = TaskContext.get(), []
    out = pack = None
    name, raw, n = "", 0, 0

    def close():
        nonlocal out
        if out:
            out.write(pack.flush())
            out.close()
            done.append((f"{folder}/{name}", n, raw))
            out = None

    for batch in batches:
        for page_id, url, html, first, revisit in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if not out:
                name, raw, n = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):04d}-{uuid.uuid4().hex[:8]}.warc.gz", 0, 0
                out, pack = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
            data = record(page_id, url, (html or "").encode(), first, revisit=revisit)
            out.write(pack.compress(data))
            raw, n = raw + len(data), n + 1
            if raw >= roll:
                close()
    close()
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "raw_bytes"])


def stream_records(read) -> Iterator[bytes]:
    """Records of one gzip stream (or of several, one after another); read(n) gives compressed bytes."""
    inflate, buf, need, ended = zlib.decompressobj(31), bytearray(), None, True
    while chunk := read(1 << 18):
        while chunk:
            buf += inflate.decompress(chunk, 1 << 20)  # a small chunk can hold much
            chunk, ended = inflate.unconsumed_tail or inflate.unused_data, inflate.eof
            if ended:
                inflate = zlib.decompressobj(31)
            at = 0
            while True:
                if need is None:
                    end = buf.find(b"\r\n\r\n", at)
                    if end < 0:
                        break
                    need = end - at + 4 + _length(bytes(buf[at:end])) + 4
                if len(buf) - at < need:
                    break
                yield bytes(buf[at : at + need])
                at, need = at + need, None
            del buf[:at]
    if buf or not ended:
        raise EOFError("the archive ends early")


def _normalised(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = []
        for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, name = _open(path)
            base = re.sub(r"\.warc\.gz$", "", name) + f"-n{TaskContext.get().taskAttemptId()}"
            offset = n = 0
            with contextlib.ExitStack() as stack:
                src = stack.enter_context(fs.open_input_stream(name, compression=None))
                out = stack.enter_context(fs.open_output_stream(f"{base}.warc.gz", compression=None))
                index = stack.enter_context(fs.open_output_stream(f"{base}.idx.jsonl", compression=None))
                for data in stream_records(src.read):
                    fields, _ = split_record(data)
                    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = pack.compress(data) + pack.flush()
                    out.write(member)
                    index.write(json.dumps({"offset": offset, "length": len(member), "type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "digest": fields.get("warc-payload-digest")}).encode() + b"\n")
                    offset, n = offset + len(member), n + 1
            if n != records:
                raise EOFError(f"{path}: {n} records of {records}")
            uri = path[: len(path) - len(name.rpartition("/")[2])] + base.rpartition("/")[2]
            done.append((f"{uri}.warc.gz", f"{uri}.idx.jsonl", n, offset))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["path", "index_path", "records", "bytes"])


RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


def _page(uri: str | None) -> int | None:
    m = re.fullmatch(re.escape(ID) + r"(-?\d+)", (uri or "").strip("<>"))
    return int(m[1]) if m else None


def _read(batches: Iterator[pa.RecordBatch], keep_payload: bool) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    for batch in batches:
        for path, index_path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, name = _open(path)
            _, index_name = _open(index_path)
            with fs.open_input_stream(index_name, compression=None) as f:
                index = [json.loads(x) for x in f.read().splitlines()]  # an archive's records, bounded by the roll size
            with fs.open_input_file(name) as f:
                rows, held = [], 0
                for x in index:
                    if x["type"] in ("response", "revisit"):
                        fields, block = split_record(zlib.decompress(f.read_at(x["length"], x["offset"]), 31))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        told = re.search(rb"(?i)content-length:\s*(\d+)", http)
                        kind, digest = x["type"], fields.get("warc-payload-digest")
                        own = digest is not None and digest.startswith("sha1:")
                        size = int(told[1]) if told else len(payload)
                        if kind == "response" and own and (len(payload) != size or base32_sha1(payload) != digest[5:]):
                            raise ValueError(f"{path}: the record at {x['offset']} is damaged")
                        digest = digest[5:] if own else base32_sha1(payload) if kind == "response" else None
                        rows.append((_page(fields.get("warc-record-id")), size, digest, kind, _page(fields.get("warc-refers-to")) if kind == "revisit" else None, fields.get("warc-target-uri"), payload if keep_payload else None))
                        held += len(payload) * keep_payload + 200
                    if rows and (held > 4 << 20 or x is index[-1]):
                        n = 7 if keep_payload else 6
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(n)], names[:n])
                        rows, held = [], 0


def decide(pages: DataFrame) -> DataFrame:
    """Adds ``refers_to`` and ``revisit`` to page_id, url and html."""
    sha = F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8"))
    keyed = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("sha", sha)
    # partial sums make this one row per digest and task, however often a payload repeats; only repeated ones remain. They are
    # written: while they are few, Spark broadcasts them by the size of the files, and the html stays where it is
    repeated = keyed.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = runtime.materialize(repeated, "repeated-payloads")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return keyed.join(repeated, "sha", "left").select("page_id", "url", "html", "first", F.coalesce(revisit, F.lit(False)).alias("revisit"))


def write_archives(pages: DataFrame, folder: str, *, roll_bytes: int = ROLL_BYTES, level: int = 1) -> DataFrame:
    """Writes the records of ``decide``'s rows; returns path, records, raw_bytes of the files, as a stored table."""
    runtime.ship(pages.sparkSession)
    runtime.small_batches(pages.sparkSession)
    return runtime.materialize(pages.mapInArrow(lambda it: _written(it, folder, roll_bytes, level), "path string, records bigint, raw_bytes bigint"), "archives")


def normalise(archives: DataFrame, *, level: int = 6) -> DataFrame:
    """Rewrites each archive with a gzip member per record beside a sidecar index; returns their paths, as a stored table."""
    runtime.ship(archives.sparkSession)
    n = max(1, archives.count())
    own = archives.select("path", "records").repartition(n)
    return runtime.materialize(own.mapInArrow(lambda it: _normalised(it, level), "path string, index_path string, records bigint, bytes bigint"), "normalised")


def read_records(archives: DataFrame, *, keep_payload: bool = False) -> DataFrame:
    """All records of normalised archives, each opened by its offset; digests are checked."""
    runtime.ship(archives.sparkSession)
    own = archives.select("path", "index_path").repartition(max(1, archives.count()))
    return own.mapInArrow(lambda it: _read(it, keep_payload), RECORDS + (", payload binary" if keep_payload else ""))


def delete_files(archives: DataFrame) -> int:
    """Executors remove the archives' files; returns their number."""
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = _open(path)
                with contextlib.suppress(FileNotFoundError):  # a task that runs again
                    fs.delete_file(name)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return archives.select("path").mapInArrow(remove, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = runtime.scratch_path(spark, "warc")
    files = write_archives(decide(runtime.table(spark, sf_dir, "pages")), folder)
    normal = normalise(files)
    delete_files(files)
    return read_records(normal)


def _base32(hexa: str) -> str:
    """SQL: the base32 text of a hexadecimal one, five hexadecimal digits to four letters."""
    value = "list_reduce([instr('0123456789abcdef', x) - 1 for x in string_split(substr({h}, 1 + 5 * g, 5), '')], lambda a, b: a * 16 + b)"
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({value}) // {32**k}) % 32 + 1, 1)" for k in (3, 2, 1, 0))
    return f"array_to_string([{letters} for g in range(8)], '')".replace("{h}", hexa)


ORACLE = f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages), f AS (SELECT s, min(page_id) AS first FROM p GROUP BY s)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_base32("p.s")} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> first THEN first END AS refers_to, url FROM p JOIN f ON f.s = p.s"""
