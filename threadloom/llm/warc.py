"""WARC archives with dictionary-compressed records, written and read in parallel.

A file is a skippable Zstandard frame that holds the dictionary, then one frame a record."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import case_safe, hashed_sample, materialize, scratch, sliced, table

#: Magic number of the skippable frame that carries a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
#: The dictionary is built on the driver from at most this many whole records and bytes; longer records are passed over.
SAMPLE_RECORDS, SAMPLE_RECORD_BYTES, DICTIONARY_BYTES = 400, 1 << 16, 1 << 15
#: A file is closed once it holds this many compressed bytes.
FILE_BYTES, LEVEL = 64 << 20, 3

ARCHIVES = "path string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def base32_sha1(payload: Column) -> Column:
    """The upper-case base32 SHA-1 of a text's UTF-8 bytes: 20 bits, or 5 hexadecimal digits, give 4 letters."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    digits = F.sha1(F.encode(payload, "UTF-8"))
    parts = []
    for i in range(8):
        n = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(alphabet, F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def planned(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """`pages` (page_id, url, html) with payload_digest, payload_bytes, record_type and refers_to.

    Of payloads that are equal and of at least `least_bytes` bytes, that with the smallest page_id is the response and
    the others revisit it; smaller ones are all responses. A null html is an empty payload. Rows that share the
    smallest page_id of a group are all responses, as is a null page_id where the group has no other."""
    html = F.coalesce(F.col("html"), F.lit(""))
    df = pages.select("page_id", "url", html.alias("html"), base32_sha1(html).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    # digests that several pages share are found, and their pages told apart, in slim rows; pages meet what was decided by
    # their own ids, so that no digest, however common, gathers pages
    slim = df.select("page_id", "payload_digest", "payload_bytes")
    shared = slim.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first_id IS NOT NULL")
    shared = materialize(shared.drop("n"), "digests")
    revisit = (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    revisits = slim.join(shared, "payload_digest").where(revisit).select(F.col("page_id").alias("its_id"), F.col("payload_digest").alias("its_digest"), "first_id").distinct()
    met = df.join(revisits.hint("merge"), F.col("page_id").eqNullSafe(F.col("its_id")) & (F.col("payload_digest") == F.col("its_digest")), "left")
    return met.select(
        "page_id", "url", "html", "payload_digest", "payload_bytes",
        F.when(F.col("first_id").isNotNull(), "revisit").otherwise("response").alias("record_type"), F.col("first_id").alias("refers_to"),
    )


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, digest: str, size: int, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record: HTTP head and payload, or for a revisit the head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(4, "WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's page_id, url, record_type, payload_digest, payload_bytes, refers_to and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC/1.1 record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its Content-Length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(x[len("<urn:page:") : -1] or -1) if x and x != "<urn:page:>" else None
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_digest": digest,
        "payload_bytes": size, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None,
    }


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary of records; their own bytes where they are too few to train on, nothing if there are none."""
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def write_file(out, dictionary: bytes, records: Iterator[bytes], limit: int = FILE_BYTES) -> tuple[int, int]:
    """Write the dictionary frame and record frames until `limit` bytes; (records, bytes) written."""
    written = out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary) if dictionary else 0
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    compressor, n = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=True), 0
    for r in records:
        written += out.write(compressor.compress(r))
        n += 1
        if written >= limit:
            break
    return n, written


def read_file(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one frame after the other; memory holds one record and a chunk."""
    data = source.read(8)
    dictionary = None
    if len(data) == 8 and struct.unpack("<II", data)[0] == DICTIONARY_MAGIC:
        dictionary = zstandard.ZstdCompressionDict(source.read(struct.unpack("<II", data)[1]))
        data = b""
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        data = data or source.read(chunk)
        if not data:
            return
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if not data and not (data := source.read(chunk)):
                raise EOFError("the archive ends within a record")
            parts.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def sampled_dictionary(pages: DataFrame) -> bytes:
    """A dictionary of a bounded sample of the records that `pages` will make, whole records in hash order of page_id."""
    html = F.coalesce(F.col("html"), F.lit(""))
    small = pages.select("page_id", "url", html.alias("html")).where(F.octet_length("html") < SAMPLE_RECORD_BYTES)
    chosen = hashed_sample(small.where(F.col("page_id").isNotNull()).select("page_id"), SAMPLE_RECORDS, ["page_id"])
    some = small.join(F.broadcast(chosen.distinct()), "page_id", "left_semi")  # bounded: SAMPLE_RECORDS ids
    rows = some.withColumn("digest", base32_sha1(F.col("html"))).dropDuplicates(["page_id"]).orderBy("page_id").collect()
    return build_dictionary([record(r.page_id, r.url, data := r.html.encode(), r.digest, len(data), "response", None) for r in rows])


def write(planned_pages: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Write archives below `folder`, which all executors share; returns (path, records, bytes) of each file.

    Only files named in the returned table count: it is written by Spark's own commit, so a task that is run again
    after its executor was lost leaves files that nothing names."""


    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for b in sliced(batches):
                for p, u, h, d, n, k, r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "payload_bytes", "record_type", "refers_to")), strict=True):
                    yield record(p, u, h.encode(), d, n, k, r)

        left, (files, base) = records(), store(folder)
        files.create_dir(base, recursive=True)
        while (head := next(left, None)) is not None:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with files.open_output_stream(f"{base}/{name}", compression=None) as out:
                n, size = write_file(out, dictionary, (r for part in ([head], left) for r in part))
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": n, "bytes": size}])

    return planned_pages.mapInArrow(archive, ARCHIVES)


def read(archives: DataFrame) -> DataFrame:
    """The records of archives (path, ...) as rows, payloads of responses checked against their digests."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                files, at = store(path)
                part, held = [], 0
                with files.open_input_stream(at, compression=None) as source:
                    for data in read_file(source):
                        part.append(parse(data))
                        held += len(data)
                        if len(part) >= 256 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(part, schema)
                            part, held = [], 0
                if part:
                    yield pa.RecordBatch.from_pylist(part, schema)

    return archives.mapInArrow(rows, RECORDS)


@case_safe()
def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write `pages` (page_id, url, html) to archives and read them back: one row a page, with its payload.

    Null html is an empty payload, null urls have no target header and line breaks in others are blanks there, as a
    header is one line; repeated rows are archived each; an empty table
    gives no archive and no rows; other columns are ignored."""
    spark = pages.sparkSession
    archives = materialize(write(planned(pages), folder or scratch(spark, "warc"), sampled_dictionary(pages)), "archives")
    spread = archives.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("path"))
    return read(spread)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)" for i in range(8) for s in (15, 10, 5, 0)
)
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, {_LETTERS} AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM f AND f IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM q
"""
