"""WARC archives in Zstandard frames with an embedded dictionary.

Each archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, built from a sample of the records to be archived; every record follows
as a frame of its own, so records can be read one by one.  Of records with equal
payloads the one of the smallest page id is a ``response``, the others ``revisit``
it.  Writing and reading go over a partition's rows in a stream, through a file system
that driver and executors share; a file gets its final name only when it is whole, so
a repeated task replaces it by an equal one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from citemill.llm.common import arrow_schema, bounded_batches, record_batch, stored

DICT_MAGIC = 0x184D2A5D
_SPACE = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the namespace for object identifiers
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str | None) -> str:
    """The URL with what can't stand in a header line percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "")


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, length: int, date: str) -> bytes:
    """One WARC/1.1 record; a revisit (refers_to given) has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8") + block + b"\r\n\r\n"


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary of the samples; empty if there are too few to build one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes, level: int):
    import zstandard

    if not dictionary:
        return zstandard.ZstdCompressor(level=level)
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d)


def read_records(stream):
    """(headers, block) of every record of an archive open for reading."""
    import zstandard

    head = stream.read(8)
    dictionary, start = b"", 0
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICT_MAGIC:
        start = 8 + struct.unpack("<I", head[4:])[0]
        dictionary = stream.read(start - 8)
    stream.seek(start)
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    buf = b""
    with d.stream_reader(stream, read_across_frames=True, read_size=1 << 18) as r:

        def more(n: int) -> bool:
            nonlocal buf
            parts, have = [buf], len(buf)
            while have < n:
                got = r.read(max(1 << 16, n - have))
                if not got:
                    break
                parts.append(got)
                have += len(got)
            buf = b"".join(parts)
            return have >= n

        while more(1):
            while (end := buf.find(b"\r\n\r\n")) < 0:
                if not more(len(buf) + 1):
                    raise ValueError("an archive ends within a header")
            lines = buf[:end].decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a record: {lines[0][:40]!r}")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            size = int(headers["Content-Length"])
            if not more(end + 4 + size + 4):
                raise ValueError("an archive ends within a record")
            yield headers, buf[end + 4 : end + 4 + size]
            buf = buf[end + 8 + size :]


def classified(pages: DataFrame, key: str, url: str, html: str, least: int, most_broadcast: int) -> DataFrame:
    """Rows with digest and the page id that a revisit refers to.  Only digests that
    several rows share are joined back: sent to all where few, else shuffled."""
    body = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    base = base.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    shared = base.where(F.col("size") >= least).groupBy("sha").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").select("sha", "first")
    shared = stored(shared)
    small = F.broadcast(shared) if shared.count() <= most_broadcast else shared
    return base.join(small, "sha", "left").withColumn("refers_to", F.when(F.col("id").isNull() | (F.col("id") != F.col("first")), F.col("first"))).drop("first")


def write_archives(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 3, dictionary_bytes: int = 65_536, sample_rows: int = 512, records_per_file: int = 20_000, bytes_per_file: int = 256 << 20, most_broadcast: int = 200_000) -> DataFrame:
    """Write all pages to archives in ``folder``; a stored table (path, records, bytes).

    Null html is an empty payload; a null URL an empty target; a row without page id
    is written without one, as a revisit if its payload has a response with an id, else
    as a response; rows that repeat page id and payload of a response are responses too;
    payloads under ``least`` bytes are all responses; an empty table writes nothing; other
    columns are ignored.  The dictionary is built from ``sample_rows`` rows.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = classified(pages, key, url, html, least, most_broadcast).select("id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "sha", "size", "refers_to")
    body = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    sample = pages.select(F.col(key).cast("long"), F.col(url).cast("string"), body).where(F.octet_length(body) <= 65_536).limit(sample_rows).collect()
    dictionary = train([record(i, u, bytes(b), base32_sha1(bytes(b)), None, len(b), date) for i, u, b in sample], dictionary_bytes)
    ddl = "path string, records bigint, bytes bigint"
    out = arrow_schema(ddl)

    def run(batches):
        import pyarrow.fs

        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        context = TaskContext.get()
        compress = _compressor(dictionary, level).compress
        lead = struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary if dictionary else b""
        stream, done = None, []

        def close():
            nonlocal stream
            stream.close()
            fs.move(temporary, final)
            done.append((f"{folder}/{name}", records, written))
            stream = None

        try:
            for batch in batches:
                for i, u, payload, sha, size, refers in zip(*(batch.column(c).to_pylist() for c in range(6))):
                    if stream is None:
                        name = f"{context.partitionId():06d}-{len(done):05d}.warc.zst"
                        final, temporary = f"{base}/{name}", f"{base}/.{name}.{context.taskAttemptId()}"
                        stream, records, written = fs.open_output_stream(temporary), 0, len(lead)
                        stream.write(lead)
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    frame = compress(record(i, u, payload or b"", digest, refers, size, date))
                    stream.write(frame)
                    records, written = records + 1, written + len(frame)
                    if records >= records_per_file or written >= bytes_per_file:
                        close()
            if stream is not None:
                close()
        finally:
            if stream is not None:
                stream.close()
        if done:
            yield record_batch(out, zip(*done))

    return stored(rows.mapInArrow(run, ddl))


def read_archives(manifest: DataFrame, *, key: str = "page_id") -> DataFrame:
    """One row per record: key, payload_bytes, payload_digest, record_type, refers_to.
    Length and digest of a response are taken anew from what was read and must agree
    with its header; those of a revisit are its headers'."""
    ddl = f"`{key}` bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    out = arrow_schema(ddl)

    def rows_of(path: str):
        import pyarrow.fs

        fs, name = pyarrow.fs.FileSystem.from_uri(path)
        with fs.open_input_file(name) as stream:
            for headers, block in read_records(stream):
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = headers["WARC-Type"]
                if kind == "response" and (len(payload), base32_sha1(payload)) != (size, digest):
                    raise ValueError(f"{path}: a payload differs from its header")
                page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                yield (int(page) if page else None, size, digest, kind, int(refers) if refers else None)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for row in rows_of(path):
                    rows.append(row)
                    if len(rows) == 4_096:
                        yield record_batch(out, zip(*rows))
                        rows = []
                if rows:
                    yield record_batch(out, zip(*rows))

    files = max(1, manifest.count())
    spread = max(8, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(min(files, spread)).mapInArrow(run, ddl)
