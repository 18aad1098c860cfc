"""WARC archives: segmented records with chunked payloads, written and read back as Spark jobs.

A long record is cut into segments of a bounded size, so an archive file of a bounded number of records is itself
bounded. Every record is a gzip member of its own. The reader takes any WARC file, whoever wrote it: a task holds the
file as it is stored, one inflated piece and one record.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import settle

VERSION = b"WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: a gzip member without content, which is what stands between two members written by Spark's text writer
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 0xFF, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
LINE_ENDS = re.compile(rb"[\r\n]*")
CHUNKED = re.compile(rb"\r\ntransfer-encoding:[^\r\n]*\bchunked\b", re.IGNORECASE)
FIELDS = {
    "type": "WARC-Type", "id": "WARC-Record-ID", "url": "WARC-Target-URI", "digest": "WARC-Payload-Digest", "refers": "WARC-Refers-To",
    "origin": "WARC-Segment-Origin-ID", "segment": "WARC-Segment-Number", "total": "WARC-Segment-Total-Length", "length": "WARC-Payload-Length",
}
RECORD = pa.schema([(n, pa.int32() if n == "segment" else pa.int64() if n in ("total", "length") else pa.string()) for n in FIELDS] + [("block", pa.binary())])


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing of ``payload``."""
    parts = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload inside chunked framing; chunk extensions and trailers are skipped, broken framing is an error."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        piece = body[end + 2 : end + 2 + size]
        if len(piece) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(piece)
        at = end + 4 + size


def _record(kind: str, record: str, url: str, block: bytes, more: list[tuple[str, object]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record), ("WARC-Date", DATE), ("WARC-Target-URI", url), *more, ("Content-Length", len(block))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def inflated(content: memoryview | bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """The bytes of a file piece by piece: all its gzip members one after another, or a plain file as it is."""
    if bytes(content[:2]) != b"\x1f\x8b":
        yield from (bytes(content[at : at + step]) for at in range(0, len(content), step))
        return
    inside, machine = False, zlib.decompressobj(31)
    for at in range(0, len(content), step):
        given = bytes(content[at : at + step])
        while given:
            if not inside and not (given := given.lstrip(b"\0")):
                break  # zeros after a member are padding
            inside = True
            yield machine.decompress(given)
            given = machine.unused_data
            if machine.eof:
                inside, machine = False, zlib.decompressobj(31)
    if inside:
        raise ValueError("cut archive")


def warc_records(content: memoryview | bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record of one file, in order; a cut record is an error."""
    pieces, held, at = inflated(content), bytearray(), 0

    def more() -> bool:
        nonlocal at
        piece = next(pieces, None)
        if piece is None:
            return False
        del held[:at]
        at = 0
        held.extend(piece)
        return True

    while True:
        at = LINE_ENDS.match(held, at).end()
        while at == len(held):
            if not more():
                return
            at = LINE_ENDS.match(held, at).end()
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                raise ValueError("cut record")
        version, *lines = held[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        head, name = {}, ""
        for line in lines:
            if line[:1] in (" ", "\t") and name:
                head[name] += " " + line.strip()
                continue
            name, _, value = line.partition(":")
            name = name.strip().lower()
            head[name] = value.strip()
        size, at = int(head["content-length"]), end + 4
        while len(held) - at < size:
            if not more():
                raise ValueError("cut record")
        block = bytes(held[at : at + size])
        at += size
        yield head, block


def _uri(key: str, digest: str, row: int | None = None) -> str:
    return f"<urn:page:{key}:{digest[:16]}>" if row is None else f"<urn:page:{key}:{digest[:16]}:{row}>"


def _page_records(key: str, url: str, payload: bytes, digest: str, refers: str | None, row: int | None, segment: int, chunk: int) -> Iterator[bytes]:
    url, name = " ".join(url.split()), _uri(key, digest, row)
    about = [("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers is not None:
        about += [("WARC-Refers-To", _uri(refers, digest)), ("WARC-Profile", PROFILE), ("WARC-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response")]
        yield _record("revisit", name, url, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n", about)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    about.append(("Content-Type", "application/http; msgtype=response"))
    if len(block) <= segment:
        yield _record("response", name, url, block, about)
        return
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    for n, piece in enumerate(pieces, 1):
        numbered = [("WARC-Segment-Number", n)]
        if n == 1:
            yield _record("response", name, url, piece, about + numbered)
            continue
        numbered.append(("WARC-Segment-Origin-ID", name))
        if n == len(pieces):
            numbered.append(("WARC-Segment-Total-Length", len(block)))
        yield _record("continuation", f"{name[:-1]}:{n}>", url, piece, numbered)


def with_first_copies(pages: DataFrame, min_bytes: int = 100, hot_share: int = 200) -> DataFrame:
    """``pages`` (key, url, payload) plus digest, ``refers_to`` and ``target``, row by row.

    ``refers_to`` is the smallest key with an equal payload, for all rows but those of that key; ``target`` marks the
    row others refer to, where its key and payload do not repeat. Only digests and keys are grouped. A digest on more
    than one in ``hot_share`` of the repeated pages meets its copies in a broadcast of at most ``hot_share`` rows.
    """
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    facts = settle(pages.where((F.length("payload") >= min_bytes) & F.col("key").isNotNull()).groupBy("key", "digest").agg(F.count("*").alias("rows")))
    first = settle(facts.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1"))
    repeated = first.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(first.where(F.col("n") * hot_share > repeated).select("digest", "first"))
    cold = first.where(F.col("n") * hot_share <= repeated).select("digest", "first")
    copies = facts.join(hot, "digest").unionByName(facts.join(hot, "digest", "left_anti").join(cold, "digest"))
    linked = copies.select("key", "digest", F.when(F.col("key") != F.col("first"), F.col("first")).alias("refers_to"), ((F.col("key") == F.col("first")) & (F.col("rows") == 1)).alias("target"))
    return pages.join(linked, ["key", "digest"], "left").withColumn("target", F.coalesce("target", F.lit(False)))


def write_archive(pages: DataFrame, path: str, segment_bytes: int = 1 << 16, chunk_bytes: int = 1 << 14, records_per_file: int = 2048) -> None:
    """Write ``pages`` (key long, url, payload binary, digest, refers_to, target) as WARC files below ``path``.

    Every record is one gzip member. Spark's own text writer puts the members down, so a lost executor or a repeated
    task leaves no half-written file; its line separator, which may not be empty, is an empty member. Segments of at
    most ``segment_bytes`` bound a file by ``records_per_file`` segments. A row others refer to is named by its key
    and digest; all other names end in the number of the row, so rows that repeat stay records of their own.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            held = 0
            for key, url, payload, digest, refers, target, row in zip(*(c.to_pylist() for c in batch.columns)):
                name = "" if key is None else str(key)
                records = _page_records(name, url or "", payload, digest, None if refers is None else str(refers), None if target else row, segment_bytes, chunk_bytes)
                out.extend(gzip_member(r) for r in records)
                held += len(payload)
                if held > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows = pages.select("key", "url", "payload", "digest", "refers_to", "target", F.monotonically_increasing_id().alias("row"))
    records = rows.mapInArrow(encode, "record binary").select(F.col("record").cast("string"))
    writer = records.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
    writer.option("maxRecordsPerFile", records_per_file).text(path)


def read_records(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """One row per WARC record below ``path``: type, id, url, digest, refers, origin, segment, total, length, block (binary).

    Files whose names match ``names`` are read, gzip-compressed (any number of members) or plain, by their content. A
    file is one task's work, as gzip cannot be entered in the middle, and must stay below the 2 GB of a binary value.
    """
    numbers = [n for n in FIELDS if RECORD.field(n).type != pa.string()]
    schema = ", ".join(f"{f.name} {'binary' if f.name == 'block' else 'string' if f.name not in numbers else 'int' if f.name == 'segment' else 'long'}" for f in RECORD)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for content in batch.column(0):
                for head, block in warc_records(memoryview(content.as_buffer())):
                    values = [head.get(header.lower()) or None for header in FIELDS.values()]
                    rows.append((*(int(v) if v and n in numbers else v for n, v in zip(FIELDS, values)), block))
                    held += len(block)
                    if held > 1 << 23 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORD)], schema=RECORD)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORD)], schema=RECORD)

    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path)
    return files.select("content").mapInArrow(parse, schema)


def reassembled(records: DataFrame) -> DataFrame:
    """Whole records: unsegmented ones as they are, segmented ones joined by origin in segment order.

    A segmented record must have segments 1..n and the total length its last segment states, or the job fails. Only
    segments are shuffled; a group is one record, which must fit in a row like any text.
    """
    whole = records.where("segment is null").select("type", "id", "url", "digest", "refers", "length", "block")
    parts = records.where("segment is not null").withColumn("origin", F.coalesce("origin", "id"))
    ordered = F.array_sort(F.collect_list(F.struct("segment", "block", "type", "url", "digest")))
    joined = parts.groupBy("origin").agg(ordered.alias("s"), F.max("total").alias("total"), F.count("*").alias("n"))
    # a binary array is joined through its hexadecimal form: array_join takes strings
    block = F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["block"])), ""))
    right = (F.col("s")[F.col("n").cast("int") - 1]["segment"] == F.col("n")) & (F.length("block") == F.col("total"))
    joined = joined.select(F.col("s")[0]["type"].alias("type"), F.col("origin").alias("id"), F.col("s")[0]["url"].alias("url"), F.col("s")[0]["digest"].alias("digest"), F.lit(None).cast("string").alias("refers"), F.lit(None).cast("long").alias("length"), block.alias("block"), "s", "n", "total")
    checked = joined.withColumn("block", F.when(right, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments missing of "), F.col("id"))).cast("binary")))
    return whole.unionByName(checked.select(*whole.columns))


def payload_of(kind: str, block: bytes) -> bytes | None:
    """The payload of a response, out of its HTTP head and chunked framing, or of a resource; null for a revisit."""
    if kind == "revisit":
        return None
    if kind == "resource":
        return block
    end = block.find(b"\r\n\r\n")
    if end < 0:
        return b""
    body = block[end + 4 :]
    return unchunked(body) if CHUNKED.search(block, 0, end) else body


def pages_of(records: DataFrame) -> DataFrame:
    """Pages of whole records: id, key, url, record_type, payload (binary), payload_bytes, digest, refers_to.

    Responses, resources and revisits are pages; other records (requests, metadata, file heads) are none. A stated
    SHA-256 is verified, other digests are replaced by it. A revisit has no payload; its digest and length are those
    it states. ``key`` and ``refers_to`` are the page ids in names written here, null in other archives.
    """
    about = ["id", "url", "type", "refers", "length"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n))
            payloads, digests = [], []
            for kind, block, stated in zip(*(column(n).to_pylist() for n in ("type", "block", "digest"))):
                payload = payload_of(kind, block)
                payloads.append(payload)
                if payload is None:
                    digests.append(stated)
                    continue
                digests.append(f"sha256:{hashlib.sha256(payload).hexdigest()}")
                if re.fullmatch("sha256:[0-9a-f]{64}", stated or "") and digests[-1] != stated:
                    raise ValueError("payload digest differs")
            yield pa.RecordBatch.from_arrays([*map(column, about), pa.array(digests, pa.string()), pa.array(payloads, pa.binary())], [*about, "digest", "payload"])

    whole = records.where("type in ('response', 'resource', 'revisit')").select(*about, "digest", "block")
    pages = whole.mapInArrow(decode, "id string, url string, type string, refers string, length long, digest string, payload binary")
    key = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]*):", 1)
    number = lambda c: F.when(key(c) != "", key(c)).cast("long")
    size = F.coalesce(F.length("payload").cast("long"), F.col("length"))
    return pages.select("id", number("id").alias("key"), "url", F.col("type").alias("record_type"), "payload", size.alias("payload_bytes"), F.regexp_replace("digest", "^sha256:", "").alias("digest"), number("refers").alias("refers_to"))


def archived_pages(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 100, **sizes: int) -> DataFrame:
    """Write ``pages`` to ``path`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Payloads are the html in UTF-8, null as empty. Of pages with equal payloads of at least ``min_bytes`` the one
    with the smallest id is stored, the others are revisits of it and state its length; shorter payloads are always
    stored. Every row is a record, also where id and payload repeat: rows of the smallest id are each stored. A null id
    is stored and never referred to; a null url is empty. Other columns are not read.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("key"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    write_archive(with_first_copies(rows, min_bytes), path, **sizes)
    back = pages_of(reassembled(read_records(pages.sparkSession, path)))
    return back.select(F.col("key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
