"""Zstandard web archives: one frame for each record, the dictionary in the leading skippable frame.

Layout of an archive (record-at-a-time compression of ISO 28500 records):

* a skippable frame with magic 0x184D2A5D that holds the zstd dictionary,
  itself plain or compressed as one frame;
* one zstd frame for each record. Frames are separated by an empty skippable
  frame, which every decoder has to step over.

Writing needs no file system API on the executors: a record is a row, the
bytes go through Spark's text writer with the empty skippable frame (eight
ASCII bytes) as line separator, so archives reach any store Spark writes to.

Pages are read twice: once for digests and lengths, which are stored, and once
for the records. Rows go to archives by page and payload; a pair of these with
very many rows is dealt out over several archives.

Defined results
    null html           an empty payload
    very long html      one record in one frame; a reader's ``limit`` is 2 GiB
    empty table         no archive records, an empty result
    repeated rows       every row is a record; of rows with one payload all
                        that carry the smallest page_id are responses
    null page_id        sorts after every id; refers_to is then null
    extra columns       ignored
    damaged frames      a row with ``error`` set; the rest is still read
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freeing, fresh_path, stored

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
#: An empty skippable frame (magic 0x184D2A50, length 0); all eight bytes are ASCII.
SEPARATOR = "P*M\x18\0\0\0\0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"

RECORDS = (
    "archive string, offset long, record_id string, record_type string, target_uri string, record_date string, "
    "content_length long, payload_digest string, payload_bytes long, refers_to_id string, payload binary, error string"
)


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode("ascii")


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary for the archives; b"" where the samples are too few or too plain to train one."""
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def record_bytes(page_id, url, payload: bytes, sha1: bytes, refers_to, revisit: bool) -> bytes:
    """One response or revisit record. A revisit keeps the HTTP header, whose Content-Length is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = re.sub(r"[\r\n]+", "%0A", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {EPOCH}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest32(sha1)}",
        f"WARC-Block-Digest: sha1:{digest32(hashlib.sha1(block).digest())}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    used = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=used, write_content_size=True, write_checksum=True)


def frames(content: memoryview):
    """(offset, kind, bytes) of each frame; kind is ``skip:<magic>``, ``data`` or ``bad``.

    The end of a data frame comes from its block headers, so nothing is decompressed to find it.
    """
    at, end = 0, len(content)
    while at < end:
        start = at
        if end - at < 8:
            yield start, "bad", content[at:]
            return
        magic = struct.unpack_from("<I", content, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = struct.unpack_from("<I", content, at + 4)[0]
            at += 8 + size
            if at > end:
                yield start, "bad", content[start:]
                return
            yield start, f"skip:{magic:08x}", content[start + 8 : at]
            continue
        if magic != 0xFD2FB528:
            yield start, "bad", content[at:]
            return
        describe = content[at + 4]
        single = describe >> 5 & 1
        at += 5 + (0 if single else 1) + (0, 1, 2, 4)[describe & 3] + ((1 if single else 0), 2, 4, 8)[describe >> 6]
        last = False
        while not last:
            if at + 3 > end:
                yield start, "bad", content[start:]
                return
            block = content[at] | content[at + 1] << 8 | content[at + 2] << 16
            last = bool(block & 1)
            at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        at += 4 if describe >> 2 & 1 else 0
        if at > end:
            yield start, "bad", content[start:]
            return
        yield start, "data", content[start:at]


def _headers(lines: list[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError("malformed header line")
        found[name.strip().decode("utf-8").lower()] = value.strip().decode("utf-8")
    return found


def parse_record(raw: bytes) -> dict:
    """Header fields and payload of one record; ValueError says what is wrong with it."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC version line")
    fields = _headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name} header")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4:
        raise ValueError("content-length does not fit the block")
    if not rest.endswith(b"\r\n\r\n"):
        raise ValueError("record does not end in two line breaks")
    block = rest[:-4]
    said = fields.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != digest32(hashlib.sha1(block).digest()):
        raise ValueError("block digest does not fit")
    kind = fields["warc-type"]
    payload, size = (block, len(block)) if kind == "response" else (None, None)
    if fields.get("content-type", "").startswith("application/http"):
        http, gap, body = block.partition(b"\r\n\r\n")
        if not gap or not http.startswith(b"HTTP/"):
            raise ValueError("no HTTP header in the block")
        inner = _headers(http.split(b"\r\n")[1:])
        size = int(inner["content-length"]) if inner.get("content-length", "").isdigit() else len(body)
        if kind == "response":
            if size != len(body):
                raise ValueError("HTTP content-length does not fit the payload")
            payload = body
    digest = fields.get("warc-payload-digest", "")
    if payload is not None and digest.startswith("sha1:") and digest[5:] != digest32(hashlib.sha1(payload).digest()):
        raise ValueError("payload digest does not fit")
    return {
        "record_id": fields["warc-record-id"], "record_type": kind, "target_uri": fields.get("warc-target-uri"), "record_date": fields["warc-date"],
        "content_length": len(block), "payload_digest": digest.removeprefix("sha1:") or None, "payload_bytes": size,
        "refers_to_id": fields.get("warc-refers-to"), "payload": payload, "error": None,
    }


def read_archive(content: bytes, limit: int = 1 << 31):
    """(offset, record) of each record of an archive; damaged frames give a record with ``error`` only.

    ``limit`` is the largest size in bytes that one record may state; a frame that states more, or none, is an error.
    """
    dictionary = None
    for number, (offset, kind, part) in enumerate(frames(memoryview(content))):
        if kind.startswith("skip:"):
            if number == 0 and kind == f"skip:{DICTIONARY_MAGIC:08x}" and len(part):
                held = bytes(part)
                dictionary = zstandard.ZstdCompressionDict(zstandard.decompress(held) if held[:4] == FRAME_MAGIC else held)
            continue
        try:
            if kind == "bad":
                raise ValueError("truncated or foreign frame")
            stated = zstandard.frame_content_size(part)
            if stated < 0 or stated > limit:
                raise ValueError("frame states no size, or too large a one")
            raw = zstandard.ZstdDecompressor(dict_data=dictionary).decompress(part)
            if len(raw) != stated:
                raise ValueError("frame size does not fit")
            yield offset, parse_record(raw)
        except (ValueError, zstandard.ZstdError, UnicodeDecodeError) as problem:
            yield offset, {"error": str(problem)[:200]}


def plan_records(keys: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, sha1, first_id, revisit, rows) for each distinct pair of page and payload of ``keys`` (page_id, sha1, payload_bytes).

    Digests and ids are reduced to one row a digest before the join, so a
    payload that a third of the pages share costs one partial row for each task.
    """
    pairs = keys.groupBy("page_id", "sha1").agg(F.max("payload_bytes").alias("payload_bytes"), F.count("*").alias("rows"))
    firsts = keys.groupBy("sha1").agg(F.min("page_id").alias("first_id"))
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return pairs.join(firsts, "sha1").select("page_id", "sha1", "first_id", ((F.col("payload_bytes") >= least_bytes) & other).alias("revisit"), "rows")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = 32 << 20, dictionary_samples: int = 400, sample_bytes: int = 16 << 10, dictionary_bytes: int = 64 << 10, pair_rows: int = 1000) -> None:
    """Writes a record for each row (page_id, url, html) to zstd archives below ``path``.

    ``archive_bytes``: payload that one archive takes on average, so that a
    reader holds one bounded file at a time. ``dictionary_samples`` pages, each
    cut to ``sample_bytes``, are the bounded sample that trains the dictionary;
    it decides about compression only. ``pair_rows``: rows of one page and
    payload that stay together; it grows with the table so that at most
    100,000 pairs have more, which are broadcast.
    """
    base = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    keys = stored(base.select("page_id", F.unhex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes")), "digests")
    rows, total = keys.agg(F.count("*"), F.coalesce(F.sum(F.col("payload_bytes") + 600), F.lit(0))).first()
    samples = [bytes(r[0]) for r in base.select(F.substring("payload", 1, sample_bytes)).limit(dictionary_samples).collect()]
    dictionary = train_dictionary(samples, dictionary_bytes)
    count = max(1, -(-total // archive_bytes))
    plan = stored(plan_records(keys, least_bytes), "plan")
    together = max(pair_rows, rows // 100_000)
    parts = F.ceil(F.col("rows") / together).cast("int")
    many = plan.filter(F.col("rows") > together).select(F.col("page_id").alias("many_id"), F.col("sha1").alias("many_sha1"), parts.alias("parts"))
    left = base.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("own", F.monotonically_increasing_id())
    left = left.join(F.broadcast(many), left["page_id"].eqNullSafe(many["many_id"]) & (left["sha1"] == many["many_sha1"]), "left")
    left = left.withColumn("part", F.pmod(F.col("own"), F.coalesce("parts", F.lit(1))).cast("int")).select("page_id", "url", "payload", "sha1", "part")
    right = plan.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    # the one key of the join is the one of the partitioning, so the join keeps the number of archives
    key = F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.hex("sha1"), "part")
    left = left.withColumn("key", key).repartition(count, "key")
    right = right.withColumn("key", key).repartition(count, "key").hint("shuffle_hash").select("key", "first_id", "revisit")
    rows = left.join(right, "key").select("page_id", "url", "payload", "sha1", "first_id", "revisit")

    def compress(batches):
        packer = _compressor(dictionary)
        leading = [dictionary_frame(dictionary)]
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out = leading + [packer.compress(record_bytes(*row)) for row in zip(*columns)]
            leading = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    written = rows.mapInArrow(freeing(compress), "value binary")
    written.select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives below ``path``, schema RECORDS; a damaged record has ``error`` set.

    Without ``payloads`` they are decoded and checked all the same, but not returned.
    """

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held = [], 0
                for offset, record in read_archive(content.as_py()):
                    held += len(record.get("payload") or b"")
                    if not payloads:
                        record.pop("payload", None)
                    rows.append({"archive": name, "offset": offset} | record)
                    if len(rows) >= 2000 or held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    text, whole = pa.string(), pa.int64()
    schema = pa.schema([("archive", text), ("offset", whole), ("record_id", text), ("record_type", text), ("target_uri", text), ("record_date", text), ("content_length", whole), ("payload_digest", text), ("payload_bytes", whole), ("refers_to_id", text), ("payload", pa.binary()), ("error", text)])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(freeing(parse), RECORDS)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and returns the records read back from them."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path, payloads)


def page_number(column: str):
    return F.expr(f"try_cast(regexp_extract({column}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")


def page_records(pages: DataFrame) -> DataFrame:
    """The digest of a round trip: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return archive_round_trip(pages, payloads=False).select(
        page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", page_number("refers_to_id")).alias("refers_to"), "error",
    )
