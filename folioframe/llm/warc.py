"""WARC archives, compressed record by record with a Zstandard dictionary of their own.

An archive starts with a skippable frame that holds the dictionary; each record follows as a frame
of its own, so that it can be read alone. The writer keeps one copy of equal payloads and writes
revisit records for the others.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, shuffle_partitions, stash, text_or_empty

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads under this many bytes are always written whole.
REVISIT_BYTES = 100
#: Bytes (compressed) at which a task goes on to its next archive.
ARCHIVE_BYTES = 64 << 20
#: The dictionary is learnt from at most this many records and bytes, and has this size.
SAMPLE_ROWS, SAMPLE_BYTES, DICT_BYTES = 2000, 4 << 20, 64 << 10
#: Date of the records: the pages have none.
DATE = "2000-01-01T00:00:00Z"


def train_dictionary(
    pages: DataFrame, html_col: str = "html", rows: int = SAMPLE_ROWS, limit: int = SAMPLE_BYTES
) -> bytes:
    """A dictionary from a bounded sample of records, those with the lowest payload hashes.

    Of a payload longer than a 32nd of ``limit`` the sample takes so many bytes from its start: pages of any
    size are learnt from. Empty if there is too little to learn from.
    """
    html = text_or_empty(html_col)
    sized = pages.select(F.substring(html.cast("binary"), 1, limit // 32).alias("p"), F.xxhash64(html).alias("h")).select(
        "p", "h", F.octet_length("p").alias("n")
    ).where("n > 0")
    total, bound = 0, None
    for r in sized.select("h", "n").distinct().orderBy("h").limit(rows).collect():
        total += r["n"]
        if total > limit:
            break
        bound = r["h"]
    if bound is None:
        return b""
    samples = [bytes(r["p"]) for r in sized.where(F.col("h") <= bound).select("p").distinct().orderBy("p").collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _record(kind: str, page: object, url: str | None, digest: str, payload: bytes, refers_to: object) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def _urn(page: object) -> str:
    return f"<urn:x-page:{'' if page is None else page}>"


def _info(name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:x-archive:{name}>", f"WARC-Date: {DATE}",
            "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


#: Folder of what attempts of tasks have begun; it goes when all archives are written.
ATTEMPTS = "_attempts"


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path there of a URI as Spark writes it."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def _made(spark: SparkSession, folder: str) -> str:
    """``folder``, made by Spark's own file system, with the name that tasks reach it by.

    A path without a scheme is in Spark's default file system; a view becomes what it stands for.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{ATTEMPTS}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    at = system.resolvePath(path.getParent()).toString()
    return "/" + at.removeprefix("file:").lstrip("/") if at.startswith("file:") else at


def _clear_attempts(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{ATTEMPTS}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class _Archive:
    """One archive: written under a name of the attempt, moved to its own name at the end."""

    def __init__(self, folder: str, name: str, attempt: int, dictionary: bytes) -> None:
        self.system, root = _system(folder)
        self.path, self.part = f"{root}/{name}", f"{root}/{ATTEMPTS}/{name}.{attempt}"
        self.uri = f"{folder}/{name}"
        self.out = self.system.open_output_stream(self.part, compression=None)
        self.out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zip = zstandard.ZstdCompressor(level=3, dict_data=known)
        self.bytes = self.records = 0
        self.add(_info(name))

    def add(self, record: bytes) -> None:
        z = self.zip.compress(record)
        self.out.write(z)
        self.bytes += len(z)
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        # An earlier attempt of the task may have got so far: some file systems don't move onto a file.
        if self.system.get_file_info(self.path).type != fs.FileType.NotFound:
            self.system.delete_file(self.path)
        self.system.move(self.part, self.path)
        return self.uri, self.records, self.bytes


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Write every row as a WARC record under ``folder``; ``(path, records, bytes)`` of each archive.

    The payload is the HTML in UTF-8 (null: empty). Of records with equal payloads of at least
    ``REVISIT_BYTES`` bytes the smallest id is a response and the others are revisits of it. Rows
    repeated with the smallest id are all responses, and so is a row of null id. ``folder`` must be
    one that all executors reach: a shared local one, or one that pyarrow has a file system for (``hdfs``,
    ``s3`` also as ``s3a``, ``gs``, ``abfs``), alone or behind ``viewfs``; others are refused before anything is written.
    What attempts that were lost have begun is deleted. An empty table writes no archive.
    """
    spark = pages.sparkSession
    folder = _made(spark, folder)
    _system(folder)
    keyed = pages.select(
        F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), text_or_empty(html_col).alias("_payload")
    ).withColumn("_digest", F.sha2("_payload", 256))
    digests = keyed.where(F.octet_length("_payload") >= REVISIT_BYTES).select("_id", "_digest")
    firsts = stash(
        digests.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"),
        "payloads",
    )
    revisits = digests.join(firsts, "_digest").where(F.col("_id") != F.col("_first")).distinct()
    rows = keyed.join(stash(revisits, "revisits"), ["_id", "_digest"], "left")
    dictionary = train_dictionary(pages, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        archive, done = None, []
        for batch in batches:
            for page, digest, url, payload, first in zip(*[c.to_pylist() for c in batch.columns]):
                if archive is None:
                    name = f"part-{task.partitionId():05d}-{len(done):03d}.warc.zst"
                    archive = _Archive(folder, name, task.taskAttemptId(), dictionary)
                kind = "response" if first is None else "revisit"
                archive.add(_record(kind, page, url, digest, payload.encode(), first))
                if archive.bytes >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        paths, records, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())],
            ["path", "records", "bytes"],
        )

    out = stash(
        in_batches(rows.select("_id", "_digest", "_url", "_payload", "_first"), run, "path string, records long, bytes long"),
        "archives",
    )
    _clear_attempts(spark, folder)
    return out


def _records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, read as a stream."""
    system, name = _system(path)
    with system.open_input_stream(name, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path} has no dictionary frame in front")
        dictionary = source.read(size)
        known = zstandard.ZstdCompressionDict(dictionary) if size else None
        stream = zstandard.ZstdDecompressor(dict_data=known).stream_reader(source, read_across_frames=True)
        ahead = b""

        def read(n: int) -> bytes:
            nonlocal ahead
            parts = [ahead]
            have = len(ahead)
            while have < n and (more := stream.read(max(1 << 16, n - have))):
                parts.append(more)
                have += len(more)
            data = b"".join(parts)
            ahead = data[n:]
            return data[:n]

        while True:
            head = b""
            while b"\r\n\r\n" not in head and (more := read(512)):
                head += more
            if not head:
                return
            head, _, rest = head.partition(b"\r\n\r\n")
            ahead = rest + ahead
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            block = read(int(fields["Content-Length"]))
            if read(4) != b"\r\n\r\n":
                raise ValueError(f"{path}: a record ends too early")
            yield fields, block


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives in column ``path``; their payloads are checked against the digests.

    ``(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload)``; a revisit's
    payload is null, its size and digest are those of the payload it stands for. Memory is bounded
    by the largest record. Archives are dealt over tasks by their path.
    """
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    number = lambda urn: int(x) if urn and (x := urn.strip("<>").rpartition(":")[2]) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*rows) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for fields, block in _records(path):
                    kind = fields["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{path}: {fields['WARC-Record-ID']} doesn't match its digest")
                    rows.append(
                        (number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, size, digest,
                         number(fields.get("WARC-Refers-To")), payload if payloads and kind == "response" else None)
                    )
                    held += len(block) if payloads else 0
                    if len(rows) >= 10_000 or held >= 32 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    parts = shuffle_partitions(archives.sparkSession)
    return archives.select("path").repartition(parts, "path").mapInArrow(run, schema)
