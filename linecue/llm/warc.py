"""WARC archives: records with segments and chunked framing, written and read back by Spark tasks.

Writing: a page is an HTTP response; of pages with equal payloads the one with
the largest id is stored, the others revisit it. Blocks longer than
`segment_bytes` go into continuation records, which a reader puts together
again: grouped by the record they continue (WARC-Segment-Origin-ID), in order
of WARC-Segment-Number, checked against WARC-Segment-Total-Length; then the
chunked transfer framing of the payload is taken off. Every record is a gzip
member of its own. A task writes its file under a name that only its place
gives and moves it there when it is whole, so a task that runs again leaves
the same file.

Cases: a null html is an empty payload; rows of equal page_id are records of
their own (the digest decides who is stored; of equal ids one is); a null
page_id is kept, and stored only if no other page has the payload; null urls
are empty targets; an empty table gives no rows. Records with a missing
segment, a wrong total length or broken framing come back with an error and
without payload, not as a failure of the job.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecue.llm.common import checkpointed, shared_path, slices, table

#: Bytes of a block in one record, and of one chunk of the transfer framing.
SEGMENT_BYTES, CHUNK_BYTES = 16_384, 4_096
#: Compressed bytes taken from a file at once, and the gzip level of records.
READ_BYTES, LEVEL = 4_096, 1
#: Bytes of payload that one file holds, about.
FILE_BYTES = 64 << 20
#: Parts that the pages of one payload are dealt to for the look-up of the stored one.
SALTS = 32
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The payload of a chunked transfer; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        at = end + 2
        if framed[at + size : at + size + 2] != b"\r\n" or size < 0:
            raise ValueError("a chunk doesn't end where its size says")
        out.append(framed[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def records_of_page(key: str, url: str, payload: bytes, digest: str, stored: str | None, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The records of one page; stored: the record that holds its payload, None for itself."""
    name, target = f"<urn:page:{key}>", " ".join(url.split())
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target)]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if stored is not None:
        about = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{stored}>"), ("Content-Type", "application/http; msgtype=response")]
        return [record(about, f"{http}\r\n".encode())]
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload, chunk_bytes)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    about = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    found = [record([*about, ("WARC-Segment-Number", "1")] if len(parts) > 1 else about, parts[0])]
    for k, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
        found.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{key}:segment:{k}>"), *common, ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k)), *last], part))
    return found


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of a file of gzip members."""
    at = 0
    while at < len(data):
        unpacker, pieces = zlib.decompressobj(31), []
        while not unpacker.eof:  # piece by piece, as all that follows the member is copied with the last one
            piece = data[at : at + READ_BYTES]
            if not piece:
                raise ValueError("a record's gzip member doesn't end")
            pieces.append(unpacker.decompress(piece))
            at += len(piece)
        at -= len(unpacker.unused_data)
        text = b"".join(pieces)
        stream = io.BytesIO(text)
        if not stream.readline().startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while line := stream.readline().strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def stored_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, row_key, url, html) with payload_digest and refers_to, the stored page of an equal payload (null: itself)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.withColumn("sha", F.unhex(F.sha1(payload)))
    named = rows.groupBy("sha").agg(F.max(F.struct("page_id", "row_key")).alias("best"), F.count("*").alias("n")).where("n > 1")
    # A payload may have a third of all pages: its pages are dealt to SALTS parts, and so is its one row here.
    named = named.select("sha", F.col("best.page_id").alias("stored"), F.col("best.row_key").alias("stored_key"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).cast("int"))
    found = rows.join(named, ["sha", "salt"], "left")
    other = F.col("stored_key").isNotNull() & ~F.col("stored_key").eqNullSafe(F.col("row_key"))
    return found.select("page_id", "row_key", "url", "html", F.when(other, F.col("stored_key")).alias("refers_to"))


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes the archives below `path`; returns (file, n_records), already computed.

    pages: page_id, url, html. A record's id holds page_id and a hash of the
    row, so that rows of equal page_id have records of their own.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("row_key", F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lower(F.hex(F.xxhash64("url", "html")))))
    twin = rows.groupBy("row_key").count().where("count > 1").limit(1)
    if not twin.isEmpty():  # rows equal in everything: number them
        from pyspark.sql import Window

        rows = rows.withColumn("row_key", F.concat_ws("-", "row_key", F.row_number().over(Window.partitionBy("row_key").orderBy("url"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        task, seq, kept, size = TaskContext.get(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, size
            name = f"{folder}/part-{task.partitionId():06d}-{seq:05d}.warc.gz"
            with store.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp", compression=None) as out:
                out.write(b"".join(kept))
            store.move(f"{name}.{task.taskAttemptId()}.tmp", name)
            made = pa.RecordBatch.from_pydict({"file": [name], "n_records": [len(kept)]})
            seq, size = seq + 1, 0
            kept.clear()
            return made

        for batch in slices(batches, "html"):
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode()
                kept.extend(records_of_page(row["row_key"], row["url"] or "", payload, payload_digest(payload), row["refers_to"], segment_bytes, chunk_bytes))
                size += len(payload)
                if size >= FILE_BYTES:
                    yield flush()
        if kept:
            yield flush()

    return checkpointed(stored_pages(rows).select("row_key", "url", "html", "refers_to").mapInArrow(run, "file string, n_records long"))


_RECORDS = "record_id string, type string, target string, digest string, refers_to string, origin string, segment int, total long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives as it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "type", "target", "digest", "refers_to", "origin", "segment", "total", "block"]
        kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for h, block in parse(data.as_py()):
                    number = lambda x, h=h: int(h[x]) if x in h else None
                    rows.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:"), h.get("warc-refers-to"), h.get("warc-segment-origin-id"), number("warc-segment-number"), number("warc-segment-total-length"), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")
    return files.mapInArrow(run, _RECORDS)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: segments joined to the record they continue; error tells what is missing. Records of one segment aren't shuffled."""
    alone = records.where("origin is null and segment is null").withColumn("error", F.lit(None).cast("string"))
    parts = records.where("origin is not null or segment is not null").withColumn("origin", F.coalesce("origin", "record_id"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    joined = parts.groupBy("origin").agg(*(first(c) for c in ("record_id", "type", "target", "digest", "refers_to")), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    block = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), ""))  # joined at once: a concat for each part would copy all before it
    numbers = F.transform("parts", lambda p: p["segment"])
    joined = joined.withColumn("block", block)
    error = F.when(numbers != F.sequence(F.lit(1), F.size("parts")), "a segment is missing or twice there").when(F.col("total").isNull(), "the last segment is missing").when(F.octet_length("block") != F.col("total"), "the total length differs")
    joined = joined.select(F.coalesce("record_id", "origin").alias("record_id"), "type", "target", "digest", "refers_to", F.when(error.isNull(), F.col("block")).alias("block"), error.alias("error"))
    return alone.select(*joined.columns).unionByName(joined)


def payloads(records: DataFrame) -> DataFrame:
    """record_id, type, target, digest, refers_to, payload and payload_length (null for revisits), computed digest, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for kind, block, error in zip(batch.column(1).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                payload = length = None
                if error is None:
                    try:
                        head, end, body = block.partition(b"\r\n\r\n")
                        if not end:
                            raise ValueError("the HTTP headers don't end")
                        about = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
                        if kind == "response":
                            payload = unchunked(body) if about.get(b"transfer-encoding") == b"chunked" else body
                            length = len(payload)
                    except (ValueError, KeyError) as e:
                        payload, error = None, f"broken block: {e}"
                found.append((payload, length, None if payload is None else payload_digest(payload), error))
            columns = list(zip(*found, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(c, k) for c, k in zip(columns, [pa.binary(), pa.int64(), pa.string(), pa.string()], strict=True))], names=["record_id", "type", "target", "digest", "refers_to", "payload", "payload_length", "computed", "error"])

    return records.select("record_id", "type", "target", "digest", "refers_to", "block", "error").mapInArrow(run, "record_id string, type string, target string, digest string, refers_to string, payload binary, payload_length long, computed string, error string")


def page_of(record_id):
    """page_id in a record's id."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)-", 1).try_cast("long")


def archived_pages(pages: DataFrame, **sizes) -> DataFrame:
    """Writes the pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, error."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    if write(pages, path, **sizes).isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, error string")
    found = payloads(reassemble(read_records(spark, path)))
    wrong = F.when((F.col("type") == "response") & (F.col("computed") != F.col("digest")), "the digest differs")
    found = checkpointed(found.select("record_id", "type", "refers_to", "payload_length", F.coalesce("computed", "digest").alias("payload_digest"), F.coalesce("error", wrong).alias("error")))
    # What a revisit's payload is, the response that it refers to tells.
    stored = found.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload_length").alias("stored_length"))
    revisits = found.where("type <> 'response'").join(stored, "refers_to", "left")
    lost = F.when(F.col("stored_length").isNull(), "the response it refers to is missing")
    revisits = revisits.select("record_id", "type", "refers_to", F.col("stored_length").alias("payload_length"), "payload_digest", F.coalesce("error", lost).alias("error"))
    found = found.where("type = 'response'").unionByName(revisits)
    return found.select(page_of(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"), "error")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archives."""
    return archived_pages(table(spark, sf_dir, "pages"))


ORACLE = """
WITH hashed AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS h FROM pages),
bits AS (
  SELECT h, list_reduce(list_transform(range(32), lambda k:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (k // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1, 1)), lambda a, b: a || b) AS digest
  FROM (SELECT DISTINCT h FROM hashed)),
best AS (SELECT h, max(page_id) AS stored FROM hashed GROUP BY h)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = stored THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> stored THEN stored END AS refers_to, NULL::VARCHAR AS error
FROM hashed JOIN bits USING (h) JOIN best USING (h)"""
